"""Running totals, ranks, previous rows and exact percentiles without one global window.

An `orderBy` window without a partition puts every row on one task. Here the order key is cut into ranges by
approximate quantiles of the whole table, each (group, range) is a window partition of its own, and the totals of the
ranges (one row per group and range) are carried forward. No range holds much more than 1/ranges of the rows, however
the groups are skewed.
"""

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F


def join_groups(rows: DataFrame, groups: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join with a table that has one row per group; NULL is a group like any other."""
    named = groups.withColumnsRenamed({k: f"_own_{k}" for k in keys})
    same = [F.col(f"`{k}`").eqNullSafe(F.col(f"`_own_{k}`")) for k in keys]
    return rows.join(named, same, how).drop(*[f"_own_{k}" for k in keys])


def with_range(
    df: DataFrame, key: Column, ranges: int | None = None, name: str = "_range", source: DataFrame | None = None
) -> DataFrame:
    """Add the number of the quantile range that `key` (numeric or time) falls in; rows equal in `key` stay together.

    The cut points (4095 numbers at most) are read once and become constants of the plan, so a re-run task sees the
    same ones. Any cut points give the same results, so they may come from `source`, a table with the columns of `key`
    that is cheaper to run through than `df`.
    """
    pieces = max(2, min(4096, ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    keyed = df.withColumn("_key", key.cast("double"))
    at = [i / pieces for i in range(1, pieces)]
    spread = (df if source is None else source).select(key.cast("double").alias("_key"))
    cuts = spread.agg(F.percentile_approx("_key", at, max(1000, 4 * pieces)).alias("cuts")).first()["cuts"]
    splits = sorted({c for c in cuts or [] if c == c})
    if not splits:
        return keyed.withColumn(name, F.lit(0)).drop("_key")
    bucketizer = Bucketizer(
        splits=[float("-inf"), *splits, float("inf")], inputCol="_key", outputCol="_piece", handleInvalid="keep"
    )
    piece = F.coalesce(F.col("_piece").cast("int"), F.lit(0))
    return bucketizer.transform(keyed).withColumn(name, piece).drop("_key", "_piece")


def running_totals(
    df: DataFrame,
    value: str,
    sums: Sequence[str],
    group: Sequence[str] = (),
    descending: bool = False,
    ranges: int | None = None,
    look_ahead: bool = False,
    source: DataFrame | None = None,
) -> DataFrame:
    """Inclusive running totals `cum_<c>` of `sums` over rows ordered by `value` within `group`.

    `value` must be unique within a group (aggregate ties first). `look_ahead` also adds `next_<c>`, the value in the
    following row (NULL in the last one). `source` is where the range cuts come from (see `with_range`): the rows
    before they were aggregated, so that finding the cuts needs no shuffle.
    """
    group = list(group)
    cut = with_range(df, F.col(value), ranges, source=source)
    order = F.col(value).desc() if descending else F.col(value).asc()
    inner = Window.partitionBy(*group, "_range").orderBy(order)
    running = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.max_by if descending else F.min_by
    carried = cut.groupBy(*group, "_range").agg(
        *[F.sum(c).alias(f"_t_{c}") for c in sums],
        *([first(F.struct(*sums), F.col(value)).alias("_first")] if look_ahead else []),
    )
    range_order = F.col("_range").desc() if descending else F.col("_range").asc()
    # One row per (group, range), at most 4096 per group.
    outer = Window.partitionBy(*group).orderBy(range_order) if group else Window.partitionBy(F.lit(0)).orderBy(range_order)
    before = outer.rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.select(
        *group,
        "_range",
        *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sums],
        *([F.lead("_first").over(outer).alias("_next")] if look_ahead else []),
    )
    local = cut.select(
        "*",
        *[F.sum(c).over(running).alias(f"_l_{c}") for c in sums],
        *([F.lead(F.struct(*sums)).over(inner).alias("_follow")] if look_ahead else []),
    )
    joined = join_groups(local, carried, [*group, "_range"])
    return joined.select(
        *df.columns,
        *[(F.col(f"_l_{c}") + F.col(f"_o_{c}")).alias(f"cum_{c}") for c in sums],
        *([F.coalesce("_follow", "_next")[c].alias(f"next_{c}") for c in sums] if look_ahead else []),
    )


def row_rank(df: DataFrame, key: str, group: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """Add `row_rank`, 1..n by `key` (unique within `group`)."""
    return running_totals(df.withColumn("one", F.lit(1).cast("long")), key, ["one"], group, ranges=ranges).withColumnRenamed(
        "cum_one", "row_rank"
    ).drop("one")


def with_previous(
    df: DataFrame,
    columns: Sequence[str],
    order: str,
    group: Sequence[str] = (),
    tie: Sequence[str] = (),
    ranges: int | None = None,
) -> DataFrame:
    """Add `prev_<c>`, the value one row earlier by (`order`, `tie`) within `group`."""
    group, tie = list(group), list(tie)
    cut = with_range(df, F.col(order), ranges)
    inner = Window.partitionBy(*group, "_range").orderBy(order, *tie)
    lasts = cut.groupBy(*group, "_range").agg(F.max_by(F.struct(*columns), F.struct(order, *tie)).alias("_last"))
    outer = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_range")
    lasts = lasts.select(*group, "_range", F.lag("_last").over(outer).alias("_carry"))
    local = cut.withColumn("_before", F.lag(F.struct(*columns)).over(inner))
    joined = join_groups(local, lasts, [*group, "_range"])
    return joined.select(*df.columns, *[F.coalesce("_before", "_carry")[c].alias(f"prev_{c}") for c in columns])


def exact_percentiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], final_rows: int = 100_000
) -> dict[str, list[float | None]]:
    """Exact linearly interpolated percentiles of several columns.

    Spark's `percentile` keeps every distinct value of a column in one task. This narrows a bracket around each wanted
    rank with quantile sketches and counts only what is inside, so neither a task nor the driver holds a column.
    A bracket is read out when at most `final_rows` rows lie strictly inside it, whatever its edges weigh; every
    narrowing is checked by exact counts.
    """
    columns, probabilities = list(columns), list(probabilities)
    names = [f"c{i}" for i in range(len(columns))]
    view = df.select(*[F.col(f"`{c}`").cast("double").alias(n) for c, n in zip(columns, names)])
    view = view.select(*[F.when(~F.isnan(n), F.col(n)).alias(n) for n in names])
    head = []
    for n in names:
        head += [F.count(n).alias(f"n_{n}"), F.min(n).alias(f"lo_{n}"), F.max(n).alias(f"hi_{n}")]
        head.append(F.approx_count_distinct(n).alias(f"d_{n}"))
    seen = view.agg(*head).first()

    out: dict[str, list[float | None]] = {c: [None] * len(probabilities) for c in columns}
    todo = []
    for c, name in zip(columns, names):
        rows = seen[f"n_{name}"]
        # What a bracket may hold at most: rows, or distinct values when these are few.
        few = 2 * seen[f"d_{name}"] <= final_rows
        for k, p in enumerate(probabilities if rows else []):
            todo.append(
                {"column": c, "name": name, "slot": k, "at": p * (rows - 1), "below": 0, "inside": rows}
                | {"lo": seen[f"lo_{name}"], "hi": seen[f"hi_{name}"], "interior": 0 if few else rows, "margin": 0.002}
            )

    while True:
        wide = [t for t in todo if t["interior"] > final_rows and t["lo"] < t["hi"] and t["margin"] < 1]
        if not wide:
            break
        _narrow(view, wide)

    spans: dict = {}
    for t in todo:
        spans.setdefault((t["name"], t["lo"], t["hi"]), []).append(t)
    if spans:
        branches = [
            F.when(F.col(name).between(lo, hi), F.struct(F.lit(s).alias("s"), F.col(name).alias("v")))
            for s, (name, lo, hi) in enumerate(spans)
        ]
        counts = (
            view.select(F.explode(F.array(*branches)).alias("x"))
            .where("x IS NOT NULL")
            .groupBy("x.s", "x.v")
            .agg(F.count("*").alias("n"))
            .collect()
        )
        by_span: dict[int, list] = {}
        for row in counts:
            by_span.setdefault(row["s"], []).append((row["v"], row["n"]))
        for s, items in enumerate(spans.values()):
            values = sorted(by_span[s])
            for t in items:
                out[t["column"]][t["slot"]] = _interpolate(values, t["at"] - t["below"])
    return out


def _narrow(view: DataFrame, wide: list[dict]) -> None:
    """Move the brackets closer to their ranks: one pass of sketches, one pass of exact counts."""
    accuracy = 1000
    brackets: dict = {}
    for t in wide:
        brackets.setdefault((t["name"], t["lo"], t["hi"]), []).append(t)
    sketches = []
    for s, ((name, lo, hi), items) in enumerate(brackets.items()):
        around = []
        for t in items:
            share = (t["at"] - t["below"]) / max(1, t["inside"] - 1)
            around += [max(0.0, share - t["margin"]), min(1.0, share + t["margin"])]
        value = F.when(F.col(name).between(lo, hi), F.col(name))
        sketches.append(F.percentile_approx(value, around, accuracy).alias(f"s{s}"))
    guesses = view.agg(*sketches).first()
    for s, items in enumerate(brackets.values()):
        for k, t in enumerate(items):
            t["try"] = (guesses[f"s{s}"][2 * k], guesses[f"s{s}"][2 * k + 1])
    checks = []
    for j, t in enumerate(wide):
        value, (lo, hi) = F.col(t["name"]), t["try"]
        checks += [
            F.count(F.when(value < lo, 1)).alias(f"b{j}"),
            F.count(F.when(value.between(lo, hi), 1)).alias(f"m{j}"),
            F.count(F.when((value > lo) & (value < hi), 1)).alias(f"i{j}"),
        ]
    counted = view.agg(*checks).first()
    for j, t in enumerate(wide):
        below, inside, interior = counted[f"b{j}"], counted[f"m{j}"], counted[f"i{j}"]
        last = t["below"] + t["inside"] - 1
        first, second = int(t["at"]), min(int(t["at"]) + 1, last)
        holds = below <= first and second < below + inside
        if holds and interior < t["interior"]:
            t["lo"], t["hi"] = t["try"]
            t["below"], t["inside"], t["interior"] = below, inside, interior
        else:
            t["margin"] *= 8


def _interpolate(values: list[tuple[float, int]], position: float) -> float:
    """Value at a fractional 0-based rank of a (value, count) list in order."""
    lower = int(position)
    share = position - lower
    reached = 0
    low = None
    for value, count in values:
        reached += count
        if low is None and reached > lower:
            low = value
            if share == 0:
                return low
        if low is not None and reached > lower + 1:
            return low + share * (value - low)
    return low


def running_max(df: DataFrame, value: str, order: str, group: Sequence[str] = (), tie: Sequence[str] = ()) -> DataFrame:
    """Add `best`, the largest `value` so far by (`order`, `tie`) within `group`."""
    group, tie = list(group), list(tie)
    cut = with_range(df, F.col(order))
    inner = Window.partitionBy(*group, "_range").orderBy(order, *tie).rowsBetween(Window.unboundedPreceding, 0)
    outer = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    tops = cut.groupBy(*group, "_range").agg(F.max(value).alias("_top"))
    tops = tops.select(*group, "_range", F.max("_top").over(outer).alias("_before"))
    joined = join_groups(cut.withColumn("_here", F.max(value).over(inner)), tops, [*group, "_range"])
    return joined.select(*df.columns, F.greatest("_here", "_before").alias("best"))


def trailing(
    df: DataFrame, order: str, group: Sequence[str], n: int, outputs: dict[str, Column], block_rows: int = 10_000
) -> DataFrame:
    """Add aggregates over the last `n` rows (this one included) by a unique `order` within `group`.

    Rows are numbered, cut into blocks, and every block also gets the n - 1 rows before it, so that a long series is
    many window partitions.
    """
    ranked = row_rank(df, order, group)
    block = F.floor((F.col("row_rank") - 1) / block_rows).cast("long")
    place = F.pmod(F.col("row_rank") - 1, F.lit(block_rows))
    copies = F.when(place >= block_rows - (n - 1), F.array(block, block + 1)).otherwise(F.array(block))
    spread = ranked.withColumn("_own", block).withColumn("_block", F.explode(copies))
    window = Window.partitionBy(*group, "_block").orderBy("row_rank").rowsBetween(-(n - 1), 0)
    added = spread.select("*", *[c.over(window).alias(name) for name, c in outputs.items()])
    return added.where(F.col("_own") == F.col("_block")).drop("_own", "_block", "row_rank")
