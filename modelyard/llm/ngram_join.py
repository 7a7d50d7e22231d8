"""Join of documents by the Jaccard similarity of their n-gram sets, with prefix filters under several token orders.

A pair of sets with similarity t or more shares a token among the first n - ceil(t n) + 1 tokens of each, under any order of all
tokens. Here every order goes from rare to frequent, with the exact number of documents of each token's cell, and the orders
differ in how they scramble equally frequent tokens. Tokens found in one document only are in no index. A pair is compared
in full only if it shares a prefix token under every order.

Documents with the same word sequence are one before anything else. What is asked for is groups, so a pair that is already
connected need not be compared. First every document goes to one bucket under each order, that of the prefix token which hashes lowest, and
meets one pivot there: near copies mostly agree on that token, so this connects most of them at a comparison each. Only
buckets of the whole index that still hold two components go on. In each such index bucket (a prefix token and its documents) some documents are pivots of a
round: first one, then up to 4, 16 and so on, and those that stand alone first. A pivot is compared with all documents of the
bucket that are not yet connected to it and leaves the bucket, since all its pairs are settled; a bucket whose documents are
all connected goes. So a bucket of near copies takes one comparison per document however large it is, and no pair is lost.

Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased. A document with fewer words than `n` has its whole sequence as its only
shingle. Shingles are compared by 64-bit keys.

Defined results: a NULL, empty or blank text has no shingle and is linked with nothing; its group is its own id. Rows that
repeat an id are all in the groups of their texts. A NULL id is never the smallest of a group unless it is alone. An empty
table gives an empty result.
"""

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from modelyard.llm import blocks
from modelyard.llm.common import (
    LOWER, UPPER, distinct, few, hashed_words, join_small, let, mixed, partitions, renamed, text_size, window_keys, word_array, words_of, written,
)
from modelyard.llm.components import merged

ORDERS = 3
# An odd number: what is hashed to choose a bucket differs from order to order.
# Tokens of a document that tell in which bucket a pair meets first.
EARLY = 8
SCRAMBLE = 0x5851F42D4C957F2D >> 2
# A set as a bitmap of so many 64-bit words: differing bits are differing tokens.
BIT_WORDS = 16
SETS = "k long, key binary, n long, shared long, weight double, first array<long>, opening array<long>, tokens binary, places binary, bits array<long>"


def sequence_key(text: str | None) -> tuple[bytes | None, int]:
    """A 128-bit key of the word sequence (None without words) and the number of words."""
    words = words_of(text)
    return (hashlib.md5(b" ".join(words)).digest() if words else None), len(words)


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """For each text the distinct keys of its runs of `n` words, ascending."""
    ids, sizes = hashed_words(texts)
    keys = window_keys(ids, n)
    sets, start = [], 0
    for size in sizes.tolist():
        own = keys[start : start + size - n + 1] if size >= n else window_keys(ids[start : start + size], max(1, size))
        sets.append(distinct(own)[0])
        start += size
    return sets


def prefix_size(n: int, percent: int) -> int:
    """Tokens of a set of `n` of which a partner must have one."""
    return n + (-percent * n) // 100 + 1


def _sequence_rows(docs: DataFrame) -> DataFrame:
    """`doc_id, key, words` of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sequence_key(t) for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array([k for k, _ in found], pa.binary()), pa.array([w for _, w in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "words"])

    return docs.mapInArrow(run, "doc_id long, key binary, words long")


def _distinct_texts(docs: DataFrame) -> DataFrame:
    """`key, text` where a word sequence comes once from each partition of `docs`, and all its rows are in one partition."""

    def first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            keys = [sequence_key(t)[0] for t in batch.column(0).to_pylist()]
            fresh = []
            for row, key in enumerate(keys):
                if key is not None and key not in seen:
                    seen.add(key)
                    fresh.append(row)
            columns = [pa.array([keys[r] for r in fresh], pa.binary()), batch.column(0).take(pa.array(fresh, pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "text"])

    return docs.select("text").mapInArrow(first, "key binary, text string").repartition(partitions(docs.sparkSession), "key")


def indexed_sets(texts: DataFrame, n: int, percent: int, size: int, block_bytes: int) -> DataFrame:
    """Every distinct text with its set size; where a partner is possible, its shared tokens and its prefixes."""
    spark = texts.sparkSession
    packed = blocks.pack_blocks(texts.withColumn("part", F.lit(0)), block_bytes, "join-blocks", once="key")
    # Wide enough that hardly two tokens share a cell; sharing one only makes a token look more frequent.
    bits = min(64, max(1, size).bit_length() + 7)
    shift = np.uint64(64 - bits)
    buckets = 2 * max(partitions(spark), -(-size // (2 * block_bytes)))

    def sets_of(rows: pa.Table) -> list[np.ndarray]:
        return shingle_sets(rows["text"].to_pylist(), n)

    def keys_of(rows: pa.Table, part: int) -> tuple[np.ndarray, np.ndarray]:
        cells, counts = distinct(np.concatenate(sets_of(rows)) >> shift)
        return cells, counts.astype(np.uint32)[None, :]

    def index(rows: pa.Table, part: int, totals: np.ndarray, block: int) -> pa.Table:
        sets = sets_of(rows)
        _, place = np.unique(np.concatenate(sets) >> shift, return_inverse=True)
        documents, start = totals[0][place], 0
        out: dict[str, list] = {c: [] for c in ("n", "shared", "weight", "first", "opening", "tokens", "places", "bits")}
        for tokens in sets:
            found = documents[start : start + len(tokens)]
            start += len(tokens)
            reach = prefix_size(len(tokens), percent)
            shared = int((found > 1).sum())
            row: list = [len(tokens), shared, *[None] * 6]
            # Rare tokens come first: enough tokens of its own fill the prefix under every order.
            if len(tokens) - shared < reach:
                # Prefixes as places among the shared tokens, in ascending order.
                rank = np.cumsum(found > 1) - 1
                orders = [np.lexsort((mixed(tokens + np.uint64(j)), found))[:reach] for j in range(ORDERS)]
                places = [np.sort(rank[o[found[o] > 1]]).astype(np.uint32) for o in orders]
                common = tokens[found > 1]
                prefixes = [common[p] for p in places]
                # A partner shares a token of every prefix.
                if all(map(len, prefixes)):
                    row[2] = float(np.log2(found).mean())
                    row[3] = prefixes[0].view(np.int64)
                    # Of each prefix the token that hashes lowest: near copies mostly agree on it.
                    row[4] = np.array([p[np.argmin(mixed(p ^ np.uint64(SCRAMBLE * (j + 1))))] for j, p in enumerate(prefixes)], np.uint64).view(np.int64)
                    row[5] = len(common).to_bytes(8, "little") + blocks.sorted_bytes(common)
                    row[6] = np.array([len(p) for p in places[1:]], np.uint32).tobytes() + np.concatenate(places[1:]).tobytes()
                    bits = np.zeros(64 * BIT_WORDS, np.uint8)
                    bits[mixed(tokens) % np.uint64(64 * BIT_WORDS)] = 1
                    row[7] = np.packbits(bits).view(np.int64)
            for values, value in zip(out.values(), row):
                values.append(value)
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.list_(pa.int64())]
        own = {"k": blocks.row_numbers(block, len(sets)), "key": rows["key"].combine_chunks()}
        return pa.table(own | {c: pa.array(v, t) for (c, v), t in zip(out.items(), kinds)})

    answers = blocks.answer(blocks.ask(packed, keys_of, 1, buckets, bits), 1, name="join-answers")
    return written(blocks.finish(packed, answers, 1, index, SETS), "join-sets")


class _Set:
    """What is compared of a document: its shared tokens, its prefixes under the orders after the first, its size."""

    def __init__(self, n: int, tokens: bytes, places: bytes):
        self.n = n
        self.tokens = blocks.sorted_keys(tokens[8:], int.from_bytes(tokens[:8], "little"))
        numbers = np.frombuffer(places, np.uint32)
        ends = ORDERS - 1 + np.cumsum(numbers[: ORDERS - 1])
        self.prefixes = [self.tokens[numbers[e - size : e]] for e, size in zip(ends, numbers)]


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many of two ascending lists of distinct tokens are in both."""
    small, large = (a, b) if len(a) < len(b) else (b, a)
    return int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())


def similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of `pairs` (x, y), found under the first order, those that also meet under the others and reach the similarity."""
    side = lambda end: sets.select(F.col("k").alias(end), *[F.col(c).alias(end + c) for c in ("n", "tokens", "places")])
    full = pairs.join(side("x"), "x").join(side("y"), "y")
    full = full.select("x", "y", "xn", "xtokens", "xplaces", "yn", "ytokens", "yplaces")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for row, (xn, xt, xp, yn, yt, yp) in enumerate(zip(*[batch.column(i).to_pylist() for i in range(2, 8)])):
                x, y = _Set(xn, xt, xp), _Set(yn, yt, yp)
                if all(_shared(p, q) for p, q in zip(x.prefixes, y.prefixes)):
                    both = _shared(x.tokens, y.tokens)
                    if 100 * both >= percent * (x.n + y.n - both):
                        good.append(row)
            picked = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(picked), batch.column(1).take(picked)], ["x", "y"])

    return full.mapInArrow(run, "x long, y long")


def _different_buckets(index: DataFrame) -> DataFrame:
    """The index without buckets of one component, and with one of the buckets that hold the same documents.

    Near copies share most of their prefix; the buckets of those tokens ask the same question. Buckets are told apart by
    their size and 128 bits over their documents.
    """
    marks = [F.bit_xor(F.xxhash64(F.lit(seed), F.col("k"))).alias(f"m{seed}") for seed in range(2)]
    ends = F.count(F.lit(1)).alias("m"), F.min("comp").alias("a"), F.max("comp").alias("b")
    buckets = index.groupBy("token").agg(*ends, *marks).where("a <> b")
    chosen = buckets.groupBy("m", "m0", "m1").agg(F.min("token").alias("token")).select("token")
    return index.join(chosen, "token", "left_semi")


BITS = [f"b{i}" for i in range(BIT_WORDS)]


def _may_be_similar(percent: int):
    """What a pair of rows `x_...` and `y_...` must meet before it is compared: different components, sizes, and bitmaps."""
    # Two sets can share no more than either shares with all others.
    most = F.least("x_n", "y_n", "x_shared", "y_shared")
    both = F.col("x_n") + F.col("y_n")
    apart = [F.bit_count(F.col(f"x_{b}").bitwiseXOR(F.col(f"y_{b}"))) for b in BITS]
    return (
        (F.col("x_comp") != F.col("y_comp"))
        & (most * 100 >= (both - most) * percent)
        & (sum(apart[1:], apart[0]) * (100 + percent) <= both * (100 - percent))
    )


def _sides(members: DataFrame, pivots: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) of a pivot and a member of its bucket that may be similar.

    With a column `early`, the smallest tokens that a document has in the index, a pair that shares one of those before the bucket's own
    is left to that bucket, where it has met or will meet: near copies share most buckets, and so meet in the first only.
    """
    columns = ["k", "n", "shared", "comp", *BITS, *[c for c in ("early",) if c in members.columns]]
    x, y = (rows.select("token", *[F.col(c).alias(f"{end}_{c}") for c in columns]) for rows, end in ((pivots, "x"), (members, "y")))
    meets = (y["token"] == x["token"]) & _may_be_similar(percent)
    if "early" in columns:
        meets = meets & ~F.arrays_overlap(F.filter("x_early", lambda t: t < x["token"]), F.col("y_early"))
    return y.join(x, meets).select(F.least("x_k", "y_k").alias("x"), F.greatest("x_k", "y_k").alias("y")).distinct()


def _opening(open_sets: DataFrame, percent: int) -> DataFrame:
    """Under each order, each set with one pivot of one bucket: that of its chosen token."""
    bits = [F.get("bits", i).alias(b) for i, b in enumerate(BITS)]
    chosen = F.posexplode("opening").alias("order", "token")
    rows = open_sets.select(chosen, "k", "n", "shared", "weight", F.col("k").alias("comp"), *bits)
    # The token of an order is a bucket of its own.
    rows = written(rows.withColumn("token", F.xxhash64("order", "token")).drop("order"), "join-opening")
    size = rows.count()
    pivot = F.struct("weight", "k", "n", "shared", "comp", *BITS).alias("best")
    tops = rows.groupBy("token").agg(F.max(pivot).alias("best"), F.count(F.lit(1)).alias("m")).where("m > 1")
    tops = written(few(tops.select("token", "best.*"), size), "join-pivots")
    return written(few(_sides(rows, tops, percent), size), "join-pairs")


def _early(index: DataFrame) -> DataFrame:
    """`k, early`: the smallest tokens of each document in `index`."""
    place = F.row_number().over(Window.partitionBy("k").orderBy("token"))
    first = index.select("k", "token").withColumn("place", place).where(F.col("place") <= EARLY)
    return written(first.groupBy("k").agg(F.collect_list("token").alias("early")), "join-early")


def _connected(open_sets: DataFrame, labels: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """`labels` after the pairs that are similar are linked."""
    needed = pairs.select(F.explode(F.array("x", "y")).alias("k")).distinct()
    compared = similar(pairs, join_small(open_sets, needed, "k", "left_semi", 2 * pairs.count()), percent)
    return merged(labels, written(compared, "join-links"))


def linked(sets: DataFrame, percent: int, most_rounds: int = 64) -> DataFrame:
    """`k, comp` of every set that may have a partner: the smallest key it is connected with."""
    open_sets = sets.where("first IS NOT NULL")
    labels = written(open_sets.select("k", F.col("k").alias("comp")), "join-labels")
    # One bucket a set and order: most near copies are connected by these, at a comparison each.
    labels = _connected(open_sets, labels, _opening(open_sets, percent), percent)
    kept = [F.col(c).cast("int").alias(c) for c in ("n", "shared")] + [F.col("weight").cast("float").alias("weight")]
    index = open_sets.join(labels, "k").select(F.explode("first").alias("token"), "k", *kept, "comp")
    index = written(index, "join-index")
    size = index.count()
    left = written(few(_different_buckets(index).drop("comp"), size), "join-left")
    size = left.count()
    early = _early(left)
    maps = open_sets.select("k", *[F.get("bits", i).alias(b) for i, b in enumerate(BITS)])
    maps = written(join_small(maps, early, "k", "inner", size), "join-maps")
    width = 1
    for _ in range(most_rounds):
        # Pivots have met all others of their buckets. What is left shrinks fast, and the sets with it.
        sizes = labels.groupBy("comp").agg(F.count(F.lit(1)).alias("members"))
        named = labels.join(sizes, "comp").select("k", "comp", "members").join(maps, "k")
        index = left.join(join_small(named, left.select("k").distinct(), "k", "left_semi", size), "k")
        index = written(few(index, size), "join-index")
        # Lone documents first: in a bucket of connected documents they are the only open question.
        best = F.struct(-F.col("members"), "weight", "k", "n", "shared", "comp", *BITS, "early").alias("best")
        salt = F.pmod(F.xxhash64("k"), F.lit(width)).alias("salt")
        tops = index.groupBy("token", salt).agg(F.max(best).alias("best"), F.min("comp").alias("a"), F.max("comp").alias("b"))
        tops = written(few(tops.select("token", "best.*", "a", "b"), size), "join-pivots")
        # Buckets with one component are settled.
        alive = tops.groupBy("token").agg(F.min("a").alias("a"), F.max("b").alias("b")).where("a <> b").select("token")
        pivots = tops.join(alive, "token", "left_semi")
        # A member meets at most `width` pivots of its bucket.
        pairs = written(few(_sides(index, pivots, percent), width * size), "join-pairs")
        if pairs.isEmpty() and alive.isEmpty():
            return labels
        labels = _connected(open_sets, labels, pairs, percent)
        left = index.join(alive, "token", "left_semi").join(pivots.select("token", "k"), ["token", "k"], "left_anti")
        left = written(few(left.select("token", "k", "n", "shared", "weight"), size), "join-left")
        size = left.count()
        width *= 4
    raise RuntimeError("the join did not settle")


def _grouped(docs: DataFrame, identity: str, text: str, n: int, percent: int, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """`doc_id, key, words` of every row, and `key, n_shingles, comp, component_id` of every word sequence."""
    lean = docs.select(F.col(f"`{identity}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    rows = written(_sequence_rows(lean), "join-rows")
    _, size = text_size(lean, "text")
    sets = indexed_sets(_distinct_texts(lean), n, percent, size, block_bytes)
    labels = linked(sets, percent)
    groups = rows.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("least"))
    groups = groups.join(sets.select("key", "k", "n"), "key").join(labels, "k", "left")
    groups = written(groups.select("key", "n", "least", F.coalesce("comp", "k").alias("comp")), "join-groups")
    least = groups.groupBy("comp").agg(F.min("least").alias("component_id"))
    return rows, written(groups.join(least, "comp").select("key", F.col("n").alias("n_shingles"), "comp", "component_id"), "join-groups")


def components(
    docs: DataFrame, identity: str = "doc_id", text: str = "text", n: int = 5, percent: int = 75, block_bytes: int = 4 << 20
) -> DataFrame:
    """One row per document: `doc_id`, `n_shingles`, `component_id` (the smallest id it is connected with)."""
    rows, groups = _grouped(docs, identity, text, n, percent, block_bytes)
    out = rows.join(groups, "key", "left")
    return out.select("doc_id", F.coalesce("n_shingles", F.lit(0)).alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_per_group(docs: DataFrame, identity: str = "doc_id", text: str = "text", n: int = 5, percent: int = 75) -> DataFrame:
    """One row of each group, with all its columns, and every row without words.

    The row with the smallest id stays, a NULL id last; ids may repeat. Of rows with the same id and word sequence the one with the
    smallest text stays.
    """
    numbered, groups = _grouped(docs, identity, text, n, percent, 4 << 20)
    cells = numbered.where("key IS NOT NULL").groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("rows"))
    cells = written(cells.join(groups.select("key", "comp"), "key"), "join-cells")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")
    heads = cells.groupBy("comp").agg(F.min(place).alias("head"))
    judged = cells.join(heads, "comp").select(F.col("doc_id").alias("_id"), F.col("key").alias("_of"), "rows", (place == F.col("head")).alias("is_head"))
    judged = written(judged.where("rows > 1 OR NOT is_head"), "join-judged")
    again = judged.where("is_head")

    rows, names = renamed(docs)
    at = {c: f"c{docs.columns.index(c)}" for c in (identity, text)}
    words = word_array(F.translate(F.col(at[text]), UPPER, LOWER))
    # The same bytes as those of `sequence_key`.
    keyed = rows.withColumn("_key", let(words, lambda w: F.when(F.size(w) > 0, F.unhex(F.md5(F.array_join(w, " "))))))
    same = (F.col("_key") == F.col("_of")) & F.col(at[identity]).cast("long").eqNullSafe(F.col("_id"))
    out = keyed.join(judged, same, "left_anti").select(*rows.columns)
    if not again.isEmpty():
        alike = keyed.join(again, same, "left_semi").groupBy(F.col(at[identity]).cast("long").alias("_id"), "_key")
        out = out.unionByName(alike.agg(F.min_by(F.struct(*rows.columns), at[text]).alias("_row")).select("_row.*"))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
