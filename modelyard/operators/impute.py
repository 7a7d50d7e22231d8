"""Filling missing numbers and categories."""

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from modelyard.functions.values import is_missing
from modelyard.functions.vectors import pack_sums
from modelyard.operators import metric_index
from modelyard.operators.metric_index import BLOCK_ROWS, CELL_ROWS
from modelyard.operators.neighbours import first_k
from modelyard.operators.ordered import exact_percentiles
from modelyard.session import cut_lineage


def fit_simple(df: DataFrame, columns: Sequence[str], strategy: str = "mean", value=None) -> dict:
    """The fill value of every column. Strategies: mean, median, most_frequent, constant."""
    columns = list(columns)
    if strategy == "constant":
        return {c: value for c in columns}
    if strategy == "mean":
        row = df.agg(*[F.avg(F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`"))).alias(c) for c in columns]).first()
        return {c: row[c] for c in columns}
    if strategy == "median":
        return {c: v[0] for c, v in exact_percentiles(df, columns, [0.5]).items()}
    if strategy == "most_frequent":
        out = {}
        for c in columns:
            counts = df.where(~is_missing(df, c)).groupBy(F.col(f"`{c}`").alias("v")).agg(F.count("*").alias("n"))
            best = counts.orderBy(F.col("n").desc(), "v").first()
            out[c] = best["v"] if best else None
        return out
    raise ValueError(f"unknown strategy {strategy}")


def apply_simple(df: DataFrame, fitted: dict) -> DataFrame:
    """Fill what is NULL or NaN; a column without a fill value stays as it is."""
    filled = {c: F.coalesce(F.when(~is_missing(df, c), F.col(f"`{c}`")), F.lit(v)) for c, v in fitted.items() if v is not None}
    return df.withColumns(filled)


@dataclass
class IterativeFill:
    """Round-robin regressions: start values, then (column, weights, intercept) steps in order."""

    columns: list[str]
    means: list[float]
    steps: list[tuple[int, list[float], float]]
    rounds: int = 0

    def transform(self, df: DataFrame) -> DataFrame:
        """Replay the steps on every row that misses something; complete rows travel to Python as NULL only."""
        cells = {c: F.col(f"`{c}`").cast("double") for c in self.columns}
        if not self.steps:
            return df.withColumns(
                {c: F.coalesce(F.when(~F.isnan(v), v), F.lit(m)) for (c, v), m in zip(cells.items(), self.means)}
            )
        values = F.array(*cells.values())
        broken = F.exists(values, lambda x: x.isNull() | F.isnan(x))
        done = df.withColumn("_row", _replay(self)(F.when(broken, values)))
        return done.withColumns({c: F.coalesce(F.col("_row")[i], v) for i, (c, v) in enumerate(cells.items())}).drop("_row")


def _fill(x: np.ndarray, fill: IterativeFill) -> np.ndarray:
    missing = np.isnan(x)
    out = np.where(missing, fill.means, x)
    for column, weights, intercept in fill.steps:
        rows = missing[:, column]
        if rows.any():
            out[rows, column] = out[rows] @ np.asarray(weights) + intercept
    return out


def _replay(fill: IterativeFill):
    def apply(rows: pd.Series) -> pd.Series:
        kept = rows.notna().to_numpy()
        out = np.empty(len(rows), dtype=object)
        if kept.any():
            x = np.array([[np.nan if v is None else v for v in r] for r in rows[kept]], dtype=float)
            out[np.flatnonzero(kept)] = list(_fill(x, fill))
        return pd.Series(out)

    return pandas_udf(apply, "array<double>")


def fit_iterative(df: DataFrame, columns: Sequence[str], max_rounds: int = 10, tolerance: float = 1e-3) -> IterativeFill:
    """Fill every incomplete column by a Bayesian ridge regression on the others, round by round, fewest gaps first.

    All fills are affine in the observed cells of a row, and which affine map it is depends only on which cells are
    missing. So one aggregate per missing pattern (count, sums, products of the observed cells) is enough to run all
    rounds on p x p matrices, and one more pass measures the change of every round for the stop rule: two scans in
    place of rounds x columns scans.
    """
    columns = list(columns)
    p = len(columns)
    cells = [F.col(f"`{c}`").cast("double") for c in columns]
    clean = [F.when(~F.isnan(c), c) for c in cells]
    base = df.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(clean)],
        *[F.max(F.abs(c)).alias(f"x{i}") for i, c in enumerate(clean)],
        *[F.count(F.when(c.isNull(), 1)).alias(f"g{i}") for i, c in enumerate(clean)],
    ).first()
    means = np.array([base[f"m{i}"] for i in range(p)], dtype=float)
    if np.isnan(means).any():
        raise ValueError("a column has no value at all")
    largest = max(base[f"x{i}"] for i in range(p))
    gaps = [base[f"g{i}"] for i in range(p)]
    order = sorted((i for i in range(p) if gaps[i]), key=lambda i: gaps[i])
    fill = IterativeFill(columns, means.tolist(), [])
    if not order or p < 2:
        return fill

    pattern = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in clean])
    # Centred on the column means: a missing cell starts at 0.
    rows = df.select(
        pattern.alias("pattern"),
        F.array(*[F.coalesce(c - F.lit(float(m)), F.lit(0.0)) for c, m in zip(clean, means)]).alias("x"),
    )
    sums = pack_sums(rows, "pattern", "x")
    groups = []
    for name, (n, total, cross) in sums.items():
        missing = np.array([c == "1" for c in name])
        # Moments of z = (1, x); `maps` sends z of the observed cells to the filled row.
        second = np.zeros((p + 1, p + 1))
        second[0, 0], second[0, 1:], second[1:, 0], second[1:, 1:] = n, total, total, cross
        maps = np.zeros((p, p + 1))
        for i in np.flatnonzero(~missing):
            maps[i, i + 1] = 1.0
        groups.append({"missing": missing, "second": second, "maps": maps})

    steps: list[tuple[int, list[float], float]] = []
    for _ in range(max_rounds):
        for j in order:
            others = [i for i in range(p) if i != j]
            n, s, c = 0.0, np.zeros(p), np.zeros((p, p))
            for g in groups:
                if not g["missing"][j]:
                    n += g["second"][0, 0]
                    s += g["maps"] @ g["second"][:, 0]
                    c += g["maps"] @ g["second"] @ g["maps"].T
            weights, intercept = _bayesian_ridge(n, s, c, others, j)
            full = np.zeros(p)
            full[others] = weights
            for g in groups:
                if g["missing"][j]:
                    g["maps"][j] = full @ g["maps"]
                    g["maps"][j, 0] += intercept
            # Back from centred to plain values.
            steps.append((j, full.tolist(), float(intercept + means[j] - full @ means)))

    per_round = len(order)
    fill.steps = steps
    broken = rows.where(F.contains("pattern", F.lit("1")))
    changes = _round_changes(broken, fill, means, per_round, max_rounds)
    limit = tolerance * largest
    fill.rounds = next((i + 1 for i, change in enumerate(changes) if change < limit), max_rounds)
    fill.steps = steps[: fill.rounds * per_round]
    return fill


def _round_changes(broken: DataFrame, fill: IterativeFill, means, per_round: int, rounds: int) -> list[float]:
    """Largest row sum of absolute changes, per round."""

    def measure(batches):
        worst = np.zeros(rounds)
        for pdf in batches:
            missing = np.array([[c == "1" for c in name] for name in pdf["pattern"]])
            x = np.stack(pdf["x"].to_numpy()).astype(float) + means
            x[missing] = np.broadcast_to(means, x.shape)[missing]
            for r in range(rounds):
                before = x.copy()
                for column, weights, intercept in fill.steps[r * per_round : (r + 1) * per_round]:
                    rows = missing[:, column]
                    x[rows, column] = x[rows] @ np.asarray(weights) + intercept
                worst[r] = max(worst[r], np.abs(x - before).sum(axis=1).max(initial=0.0))
        yield pd.DataFrame({"round": range(rounds), "change": worst})

    found = broken.mapInPandas(measure, "round int, change double").groupBy("round").agg(F.max("change").alias("change"))
    by_round = {r["round"]: r["change"] for r in found.collect()}
    return [by_round.get(r, 0.0) for r in range(rounds)]


def _bayesian_ridge(n: float, s: np.ndarray, c: np.ndarray, others: list[int], j: int) -> tuple[np.ndarray, float]:
    """Bayesian ridge regression from moments: evidence updates of the noise and weight precision, up to 300 rounds."""
    mean = s / n
    gram = (c - n * np.outer(mean, mean))[np.ix_(others, others)]
    target = (c - n * np.outer(mean, mean))[others, j]
    square = max(0.0, c[j, j] - n * mean[j] ** 2)
    values, vectors = np.linalg.eigh(gram)
    values = np.clip(values, 0.0, None)
    turned = vectors.T @ target
    tiny = 1e-6  # shape and rate of both Gamma priors
    noise, weight = 1.0 / (square / n + np.finfo(float).eps), 1.0
    before = None

    def solve(noise, weight):
        beta = vectors @ (turned / (values + weight / noise))
        rest = max(0.0, square - 2 * beta @ target + beta @ gram @ beta)
        return beta, rest

    for _ in range(300):
        beta, rest = solve(noise, weight)
        gamma = np.sum(noise * values / (weight + noise * values))
        weight = (gamma + 2 * tiny) / (beta @ beta + 2 * tiny)
        noise = (n - gamma + 2 * tiny) / (rest + 2 * tiny)
        if before is not None and np.abs(before - beta).sum() < 1e-3:
            break
        before = beta
    beta, _ = solve(noise, weight)
    return beta, float(mean[j] - mean[others] @ beta)


# Boxes of all views together, gap patterns that are told apart, and how often a donor may be copied into views of its own patterns.
BOXES, PATTERNS, COPIES = 4096, 255, 64
# Donors that the cuts of the boxes are taken from.
SAMPLE_ROWS = 32_768


@dataclass(frozen=True)
class Boxes:
    """The boxes of a view: number, rows, least and largest value of each column; in an `exact` box all rows have the same gaps."""

    numbers: np.ndarray
    rows: np.ndarray
    low: np.ndarray
    high: np.ndarray
    exact: np.ndarray

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row and box the least and the largest distance that a row of the box can have."""
        p = x.shape[1]
        used = np.flatnonzero(~np.isnan(self.low).all(axis=0))
        low, high = self.low[:, used], self.high[:, used]
        near, far = np.empty((len(x), len(self.rows))), np.empty((len(x), len(self.rows)))
        for start in range(0, len(x), step := max(1, 2_000_000 // max(1, low.size))):
            own = x[start : start + step, None, used]
            inside = np.maximum(np.maximum(low - own, own - high), 0.0) ** 2
            across = np.maximum(np.abs(own - low), np.abs(own - high)) ** 2
            shared = ~np.isnan(inside)
            width = shared.sum(axis=2)
            scale = p / np.maximum(width, 1)
            # Rows with more gaps than their box may share any of its columns, but the mean over some is no less than the least.
            loose = p * np.where(shared, inside, np.inf).min(axis=2, initial=np.inf)
            least = np.where(self.exact, scale * np.where(shared, inside, 0.0).sum(axis=2), loose)
            most = np.where(self.exact, scale * np.where(shared, across, 0.0).sum(axis=2), np.inf)
            near[start : start + step] = np.where(width > 0, np.sqrt(least) * (1 - 1e-12), np.inf)
            far[start : start + step] = np.where(width > 0, np.sqrt(most) * (1 + 1e-12), np.inf)
        return near, far

    def home(self, x: np.ndarray, k: int) -> np.ndarray:
        """Boxes that surely hold `k` comparable rows near each row."""
        far = self.bounds(x)[1]
        mask, left = np.zeros(far.shape, bool), np.arange(len(x))
        # A few boxes nearly always do.
        for few in (min(16, far.shape[1]), far.shape[1]):
            own = far[left]
            order = np.argpartition(own, few - 1, axis=1)[:, :few]
            order = np.take_along_axis(order, np.argsort(np.take_along_axis(own, order, axis=1), axis=1, kind="stable"), axis=1)
            able = np.where(np.isfinite(np.take_along_axis(own, order, axis=1)), self.rows[order], 0)
            total = np.cumsum(able, axis=1)
            row, place = np.nonzero((total - able < k) & (able > 0))
            mask[left[row], order[row, place]] = True
            left = left[total[:, -1] < k]
            if not len(left):
                break
        return mask

    def within(self, x: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """Boxes that can hold a comparable row as near as `reach`."""
        near = self.bounds(x)[0]
        return np.isfinite(near) & (near <= reach[:, None])


def _tree(x: np.ndarray, leaves: int, first: int) -> tuple:
    """Cuts (column, value, below, above) of the widest column in halves, down to at most `leaves` numbered boxes, and the next number."""
    spread = x.max(axis=0) - x.min(axis=0) if len(x) and leaves > 1 else np.zeros(1)
    c = int(np.argmax(spread))
    if not spread[c] > 0:
        return first, first + 1
    values = np.sort(x[:, c])
    cut = values[(len(values) - 1) // 2]
    if cut == values[-1]:
        cut = values[np.searchsorted(values, cut) - 1]
    below = x[:, c] <= cut
    share = min(leaves - 1, max(1, round(leaves * below.mean())))
    low, number = _tree(x[below], share, first)
    high, number = _tree(x[~below], leaves - share, number)
    return (c, cut, low, high), number


def _drop(tree, x: np.ndarray, rows: np.ndarray, out: np.ndarray) -> None:
    """The box of each of the `rows` of x, into `out`."""
    if not isinstance(tree, tuple):
        out[rows] = tree
    elif len(rows):
        c, cut, low, high = tree
        below = x[rows, c] <= cut
        _drop(low, x, rows[below], out)
        _drop(high, x, rows[~below], out)


def _boxes(donors: DataFrame, p: int, means: list[float], cell_rows: int) -> tuple[DataFrame, dict[int, Boxes]]:
    """`donors` with the number of their box (`ring`), and the boxes of each view: near rows with the same gaps."""
    gaps = F.array_join(F.transform("x", lambda v: F.when(F.isnan(v), "0").otherwise("1")), "")
    donors = donors.withColumn("gaps", gaps)
    # Views are no more than COPIES and the columns.
    totals = {r["view"]: r["n"] for r in donors.groupBy("view").agg(F.count(F.lit(1)).alias("n")).collect()}
    often = donors.groupBy("view", "gaps").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "view", "gaps").limit(PATTERNS).collect()
    sizes = {(r["view"], r["gaps"]): r["n"] for r in often}
    rest = {view: n - sum(m for (v, _), m in sizes.items() if v == view) for view, n in totals.items()}
    sizes |= {(view, None): n for view, n in rest.items() if n}
    lean = donors.select("view", "gaps", "x", F.xxhash64("view", "x").alias("h")).orderBy("h").limit(SAMPLE_ROWS).toPandas()
    pooled = lambda batch: [(v, g) if (v, g) in sizes else (v, None) for v, g in zip(batch["view"], batch["gaps"])]
    whole = lambda batch: np.where(np.isnan(x := metric_index.stacked(batch["x"]).reshape(len(batch), p)), means, x)
    places, sample = pd.Series(pooled(lean), dtype=object), whole(lean)
    trees, group_of, number = {}, [], 0
    for group, n in sizes.items():
        leaves = ceil(n / max(cell_rows, sum(totals.values()) / BOXES))
        trees[group], after = _tree(sample[[g == group for g in places]], leaves, number)
        group_of += [group] * (after - number)
        number = after

    def place(batches):
        for batch in batches:
            if len(batch):
                x, ring = whole(batch), np.zeros(len(batch), np.int32)
                named = pd.Series(pooled(batch), dtype=object)
                for group, rows in named.groupby(named).indices.items() if named.nunique() > 1 else [(named[0], np.arange(len(batch)))]:
                    _drop(trees[group], x, rows, ring)
                yield batch.drop(columns="gaps").assign(ring=ring)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in donors.drop("gaps").schema.fields)
    placed = cut_lineage(donors.mapInPandas(place, f"{schema}, ring int"))
    cell = lambda i: F.when(~F.isnan(F.get("x", i)), F.get("x", i))
    parts = [f(cell(i)).alias(f"{n}{i}") for n, f in (("l", F.min), ("h", F.max)) for i in range(p)]
    # At most BOXES, and one more for each gap pattern and view.
    known = placed.groupBy("ring").agg(F.count(F.lit(1)).alias("n"), *parts).orderBy("ring").toPandas()
    views = {}
    for view in totals:
        own = known[[group_of[r][0] == view for r in known["ring"]]]
        low, high = (own[[f"{n}{i}" for i in range(p)]].to_numpy(dtype=float) for n in "lh")
        exact = np.array([group_of[r][1] is not None for r in own["ring"]])
        views[view] = Boxes(own["ring"].to_numpy(), own["n"].to_numpy(), low, high, exact)
    return placed, views


def _views(counts: list, p: int) -> dict[str | None, dict[int, int]]:
    """Per gap pattern of looking rows the view of each column that they lack; None stands for all patterns without views of their own."""
    views: dict[str | None, dict[int, int]] = {}
    number = 0
    for row in counts[:PATTERNS]:
        lacking = [c for c in range(p) if row["gaps"][c] == "0"]
        if 0 < len(lacking) < p and number + len(lacking) <= COPIES:
            views[row["gaps"]] = {c: number + i for i, c in enumerate(lacking)}
            number += len(lacking)
    rare = [row["gaps"] for row in counts[:PATTERNS] if row["gaps"] not in views and "1" in row["gaps"]]
    lacked = range(p) if len(counts) > PATTERNS else [c for c in range(p) if any(g[c] == "0" for g in rare)]
    views[None] = {c: number + i for i, c in enumerate(lacked)}
    return views


def knn_impute(
    df: DataFrame, columns: Sequence[str], key: str, k: int = 5, block_rows: int = BLOCK_ROWS, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """Fill a gap with the mean of the k nearest rows that have the value.

    The distance uses the cells both rows have, scaled up to the full width. Rows with equal cells look for donors once. Each frequent gap
    pattern has a view of the donors for each column that it lacks: their cells in the columns that the pattern has, and of equal ones
    only the first k by key, as no other can be among the nearest k. What is rarer shares a view with all cells. In a view rows
    lie in boxes of near rows with the same gaps, so a box's bounds give the least distance of any of its rows. A row meets first boxes
    that surely hold k donors, then all others that can hold one as near as the k-th of those. NaN is a gap; a gap without any donor
    takes the column's mean. Rows of the same key share what they find; a donor without a key comes last among equally near ones.
    """
    columns = list(columns)
    p = len(columns)
    cells = F.array(*[F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double")) for c in columns])
    nan = F.lit(float("nan"))
    marked = F.transform(cells, lambda v: F.coalesce(v, nan))
    gaps = F.array_join(F.transform(cells, lambda v: F.when(v.isNull(), "0").otherwise("1")), "")
    rows = cut_lineage(df.select(F.col(key).alias("key"), marked.alias("x"), gaps.alias("gaps")))
    means = fit_simple(df, columns, "mean")
    broken = rows.where(F.contains("gaps", F.lit("0")) & F.contains("gaps", F.lit("1")))
    counts = rows.where(F.contains("gaps", F.lit("0"))).groupBy("gaps").agg(F.count(F.lit(1)).alias("n"))
    # One more than are told apart shows whether there are others.
    views = _views(counts.orderBy(F.desc("n"), "gaps").limit(PATTERNS + 1).collect(), p)
    kind = df.schema[key].dataType.simpleString()

    def struct(view: int, c: int, pattern: str | None):
        shown = [F.get("x", i) if pattern is None or pattern[i] == "1" else nan for i in range(p)]
        return F.struct(F.lit(view).alias("view"), F.get("x", c).alias("value"), F.array(*shown).alias("seen"))

    seats = [struct(view, c, pattern) for pattern, own in views.items() for c, view in own.items()]
    if not seats:
        return df.withColumns({c: F.coalesce(cells[i], F.lit(means[c])) for i, c in enumerate(columns)})
    least = rows.agg(F.min("key")).first()[0]
    offered = rows.where(~F.exists("x", lambda v: F.abs(v) == float("inf"))).select("key", F.inline(F.array(*seats)))
    offered = offered.where(~F.isnan("value") & F.exists("seen", lambda v: ~F.isnan(v)))
    # A key without a gap keeps its type in Python; `keyless` says where there was one.
    keyed = F.coalesce("key", F.lit(least).cast(kind)).alias("key")
    offered = offered.select("view", F.col("seen").alias("x"), keyed, F.col("key").isNull().alias("keyless"), "value")
    donors = cut_lineage(metric_index.best(offered, ["view", "x"], ["keyless", "key", "value"], k))
    placed, boxes = _boxes(donors, p, [0.0 if means[c] is None else float(means[c]) for c in columns], cell_rows)

    def wanted(pattern: str | None):
        return F.array(*[F.struct(F.lit(c).alias("col"), F.lit(view).alias("view")) for c, view in views[pattern].items()])

    def asking() -> DataFrame:
        different = broken.select("gaps", "x").distinct()
        named = [pattern for pattern in views if pattern is not None]
        parts = [different.where(F.col("gaps") == pattern).select("x", F.inline(wanted(pattern))) for pattern in named]
        if views[None]:
            shared = different.where(~F.col("gaps").isin(named)) if named else different
            parts.append(shared.select("x", F.inline(wanted(None))).where(F.isnan(F.get("x", F.col("col")))))
        return reduce(DataFrame.unionByName, parts)

    asked = cut_lineage(asking().withColumn("key", F.monotonically_increasing_id()))
    names = ["key", "gap", "donor", "keyless", "value"]

    def nearest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            b = b.sort_values(["keyless", "key", "value"], kind="stable")
            x, y = np.stack(a["features"].to_numpy()), metric_index.stacked(b["x"])
            used = np.flatnonzero(~np.isnan(y).all(axis=0))
            keys, rest = a["key"].to_numpy(), [b[c].to_numpy() for c in ("key", "keyless", "value")]
            for start in range(0, len(x), step := max(1, 1_000_000 // len(y))):
                own = x[start : start + step]
                total, width = np.zeros((len(own), len(y))), np.zeros((len(own), len(y)), np.int32)
                for c in used:
                    square = (y[None, :, c] - own[:, None, c]) ** 2
                    shared = ~np.isnan(square)
                    total += np.where(shared, square, 0.0)
                    width += shared
                with np.errstate(divide="ignore", invalid="ignore"):
                    gaps = np.where(width > 0, np.sqrt(total * p / width), np.inf)
                row, donor = first_k(gaps, k)
                found = np.isfinite(gaps[row, donor])
                row, donor = row[found], donor[found]
                out.append(pd.DataFrame(dict(zip(names, (keys[start + row], gaps[row, donor], *[v[donor] for v in rest])))))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in names})

    order = ["gap", "keyless", "donor", "value"]

    def near(visitors: DataFrame) -> DataFrame:
        schema = f"key long, gap double, donor {kind}, keyless boolean, value double"
        found = metric_index.meet(visitors, placed, nearest, schema, block_rows)
        return cut_lineage(metric_index.best(found, ["key"], order, k))

    def visits(queries: DataFrame, later: bool) -> DataFrame:
        """Each row with the boxes of its view that it wants."""

        def run(batches):
            for batch in batches:
                for view, rows in batch.groupby("view") if len(batch) else ():
                    own = boxes.get(view)
                    for piece in metric_index.pieces(rows, len(own.rows)) if own else ():
                        x = metric_index.stacked(piece["features"])
                        mask = own.home(x, k)
                        if later:
                            mask = own.within(x, piece["reach"].fillna(np.inf).to_numpy(dtype=float)) & ~mask
                        row, box = np.nonzero(mask)
                        yield piece.iloc[row][["key", "features"]].assign(ring=own.numbers[box].astype(np.int32))

        return queries.mapInPandas(run, "key long, features array<double>, ring int")

    looking = asked.select("key", F.col("x").alias("features"), "view")
    first = near(visits(looking, False))
    reach = first.groupBy("key").agg(F.max("gap").alias("reach"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).drop("n")
    second = near(visits(looking.join(reach, "key", "left"), True))
    answers = metric_index.best(first.unionByName(second), ["key"], order, k)
    answers = answers.groupBy("key").agg(F.collect_list(F.struct(*order)).alias("near")).join(asked.select("key", "x", "col"), "key")
    # Rows of one key share their nearest.
    own = broken.where(F.col("key").isNotNull()).select("key", "x").join(answers.select("x", "col", "near"), "x")
    best = metric_index.best(own.select("key", "col", F.inline("near")), ["key", "col"], order, k)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(*order))), lambda d: d["value"])
    filled = best.groupBy("key", "col").agg(ordered.alias("near"))
    filled = filled.select("key", "col", (F.aggregate("near", F.lit(0.0), lambda s, d: s + d) / F.size("near")).alias("v"))
    maps = filled.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("col", "v"))).alias("_fill"))
    joined = df.join(maps.withColumnRenamed("key", key), key, "left")
    filled_in = {c: F.coalesce(cells[i], F.try_element_at("_fill", F.lit(i)), F.lit(means[c])) for i, c in enumerate(columns)}
    return joined.withColumns(filled_in).drop("_fill")
