"""Toxicity with a counterfactually regularised classifier.

A logistic model over the words of a text. Beside the usual loss it pays for every change of its score when identity terms of a
labelled text are swapped for others of the same kind: (w . (x - x'))**2, where x' is the text after the swap. A term that
merely stands near insults in the labelled texts so gets no weight of its own, and neutral mentions of a group stay
neutral.

The model is fitted on at most `max_labelled` labelled documents, taken in the order of a hash of their ids; this bound is a
parameter of the fit and nothing else is bounded. Its features are the `max_features` words that tell the classes apart best and
all identity terms that occur. Every document is scored over its whole text.

Defined results: a NULL or empty text has the score of a text without any feature word. Labels that are NULL are not used; an id
with contradicting labels counts as toxic. Rows that repeat an id are scored each. Without labels of both classes the score is
the share of toxic ones (0 without any). An empty table gives an empty result.
"""

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from modelyard.session import cut_lineage

WORD = re.compile(r"[^\W\d_]+")
# Identity terms by kind; a swap replaces a term by the next of its kind.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "catholic", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "catholics", "atheists"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens"),
    ("deaf", "blind", "disabled", "elderly", "young"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("femmes", "hommes", "filles", "garçons"),
    ("mujeres", "hombres", "niñas", "niños"),
)
SWAP = {term: kind[(i + 1) % len(kind)] for kind in IDENTITY_TERMS for i, term in enumerate(kind)}


def words_in(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def remainder(identity: Column, by: int) -> Column:
    return F.crc32(F.coalesce(identity.cast("string"), F.lit("")).cast("binary")) % by


def fit_weights(
    rows: list[np.ndarray], labels: np.ndarray, swaps: list[tuple[np.ndarray, np.ndarray]], width: int, ridge: float, fairness: float
) -> np.ndarray:
    """Weights and bias (last) of least logistic loss + ridge + fairness * mean squared score change, by limited-memory BFGS."""
    index = np.concatenate([np.append(r, width) for r in rows]).astype(np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) + 1 for r in rows])
    gone = np.concatenate([a for a, _ in swaps] or [np.zeros(0, np.int64)]).astype(np.int64)
    come = np.concatenate([b for _, b in swaps] or [np.zeros(0, np.int64)]).astype(np.int64)
    gone_of = np.repeat(np.arange(len(swaps)), [len(a) for a, _ in swaps]).astype(np.int64)
    come_of = np.repeat(np.arange(len(swaps)), [len(b) for _, b in swaps]).astype(np.int64)
    n = len(rows)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.bincount(owner, weights=w[index], minlength=n)
        value = (np.logaddexp(0, z) - labels * z).mean() + ridge / 2 * (w[:-1] ** 2).sum()
        error = (1 / (1 + np.exp(-z)) - labels) / n
        slope = np.bincount(index, weights=error[owner], minlength=width + 1)
        slope[:-1] += ridge * w[:-1]
        if swaps:
            change = np.bincount(come_of, weights=w[come], minlength=len(swaps)) - np.bincount(gone_of, weights=w[gone], minlength=len(swaps))
            value += fairness * (change**2).sum() / n
            pull = 2 * fairness * change / n
            slope += np.bincount(come, weights=pull[come_of], minlength=width + 1) - np.bincount(gone, weights=pull[gone_of], minlength=width + 1)
        return value, slope

    w = np.zeros(width + 1)
    value, slope = loss(w)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(300):
        way = slope.copy()
        kept = []
        for s, y, r in reversed(steps):
            a = r * (s @ way)
            way -= a * y
            kept.append(a)
        if steps:
            s, y, r = steps[-1]
            way *= 1 / (r * (y @ y))
        for (s, y, r), a in zip(steps, reversed(kept)):
            way += (a - r * (y @ way)) * s
        size = 1.0
        while size > 1e-10:
            fresh, fresh_slope = loss(w - size * way)
            if fresh <= value - 1e-4 * size * (slope @ way):
                break
            size /= 2
        else:
            break
        s, y = -size * way, fresh_slope - slope
        if s @ y > 1e-12:
            steps = [*steps[-9:], (s, y, 1 / (s @ y))]
        moved = value - fresh
        w, value, slope = w + s, fresh, fresh_slope
        if moved < 1e-9:
            break
    return w


def fit(labelled: DataFrame, max_features: int, ridge: float, fairness: float) -> tuple[dict[str, float], float]:
    """Word weights and bias from `text, toxic` rows, of which there is a bounded number."""

    def vocabulary(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[toxic].update(words_in(text))
        words = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_pydict(
            {"word": words, "clean": pa.array([counts[0][w] for w in words], pa.int64()), "toxic": pa.array([counts[1][w] for w in words], pa.int64())}
        )

    sizes = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not clean or not toxic:
        share = toxic / max(1, clean + toxic)
        return {}, float("inf") if share == 1 else float("-inf")
    counts = labelled.mapInArrow(vocabulary, "word string, clean long, toxic long")
    counts = counts.groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    # Difference of the shares in its standard deviations.
    both = (F.col("clean") + F.col("toxic")) / F.lit(clean + toxic)
    spread = F.sqrt(both * (1 - both) * (1 / clean + 1 / toxic))
    gap = F.abs(F.col("toxic") / toxic - F.col("clean") / clean) / F.greatest(spread, F.lit(1e-12))
    told = counts.where("clean + toxic >= 3").orderBy(gap.desc(), "word").limit(max_features).select("word").collect()
    terms = counts.where(F.col("word").isin(list(SWAP))).select("word").collect()
    words = sorted({r["word"] for r in told} | {t for r in terms for t in (r["word"], SWAP[r["word"]])})
    place = {w: i for i, w in enumerate(words)}

    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [words_in(t) for t in batch.column(0).to_pylist()]
            here = [sorted(place[w] for w in f if w in place) for f in found]
            gone = [sorted(place[w] for w in f if w in SWAP) for f in found]
            come = [sorted(place[SWAP[w]] for w in f if w in SWAP) for f in found]
            lists = [pa.array(x, pa.list_(pa.int32())) for x in (here, gone, come)]
            yield pa.RecordBatch.from_arrays([batch.column(1), *lists], ["toxic", "here", "gone", "come"])

    rows = labelled.mapInArrow(features, "toxic int, here array<int>, gone array<int>, come array<int>").collect()
    rows.sort(key=lambda r: (r["toxic"], r["here"]))
    vectors = [np.array(r["here"], np.int64) for r in rows]
    swaps = [(np.array(r["gone"], np.int64), np.array(r["come"], np.int64)) for r in rows if r["gone"]]
    weights = fit_weights(vectors, np.array([r["toxic"] for r in rows], float), swaps, len(words), ridge, fairness)
    return {w: float(weights[i]) for w, i in place.items()}, float(weights[-1])


def score(
    docs: DataFrame, labels: DataFrame, identity: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 5,
    max_labelled: int = 20_000, max_features: int = 2_000, ridge: float = 1e-4, fairness: float = 1.0,
) -> DataFrame:
    """One row per document: `doc_id`, `held_out` (never learned from), `score` from 0 to 1, `predicted`."""
    own = labels.select(F.col(f"`{identity}`").cast("long").alias("_own"), F.col(f"`{label}`").cast("int").alias("toxic"))
    own = own.where("toxic IN (0, 1) AND _own IS NOT NULL").where(remainder(F.col("_own"), folds) != 0)
    own = own.groupBy("_own").agg(F.max("toxic").alias("toxic"))
    chosen = cut_lineage(own.orderBy(F.xxhash64("_own"), "_own").limit(max_labelled))
    lean = docs.select(F.col(f"`{identity}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    # At most `max_labelled` rows of two numbers.
    labelled = lean.join(F.broadcast(chosen), F.col("doc_id") == F.col("_own")).select("text", "toxic")
    weights, bias = fit(labelled, max_features, ridge, fairness)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = weights.keys()
        for batch in batches:
            sums = [sum(weights[w] for w in sorted(words_in(t) & known)) for t in batch.column(2).to_pylist()]
            with np.errstate(over="ignore"):
                scores = 1 / (1 + np.exp(-(np.array(sums, float) + bias)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"])

    rows = lean.select("doc_id", (remainder(F.col("doc_id"), folds) == 0).alias("held_out"), "text")
    scored = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
