"""Exact deduplication by Grace hashing.

Records go to buckets by the hash of their content; a bucket whose distinct content does not fit the memory of a table
is divided again by further digits of the hash, and so on. Then each bucket runs through an open-addressing table that
compares whole contents. The partition files are Spark's shuffle files, so memory, spilling and recovery are Spark's; what is
recursive is the plan of the buckets, which is worked out beforehand on (hash, size) alone. A bucket of one hash is never
divided: it is one content (or a hash collision, which the table tells apart), however many rows have it.

Every input partition first runs its own rows through a table, so a content that a third of all rows share crosses the
network once per partition and not once per row.

Defined results: a NULL text counts as empty, and all empty texts are one group. Of equal texts the row with the most code
points stays, then the smallest id; a NULL id is the largest. Rows that are equal in everything count each in
`group_size`. An empty table gives an empty result. Other columns are carried untouched, whatever their names.
"""

from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from modelyard.llm.common import SPACES, partitions, renamed, written
from modelyard.session import cut_lineage

FANOUT_BITS = 4
DELETED = SPACES.encode()


def content(text: Column) -> Column:
    """The text without white space, which is what is compared."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


class ContentTable:
    """Open addressing with linear probing over complete contents; add() gives the number of the entry."""

    def __init__(self, slots: int = 1024):
        self.slots = [-1] * slots
        self.hashes: list[int] = []
        self.contents: list[bytes] = []

    def add(self, digest: int, value: bytes) -> int:
        mask = len(self.slots) - 1
        at = digest & mask
        while (entry := self.slots[at]) >= 0:
            if self.hashes[entry] == digest and self.contents[entry] == value:
                return entry
            at = (at + 1) & mask
        entry = self.slots[at] = len(self.hashes)
        self.hashes.append(digest)
        self.contents.append(value)
        if 10 * len(self.hashes) > 7 * len(self.slots):
            self._grow()
        return entry

    def _grow(self) -> None:
        self.slots = [-1] * (2 * len(self.slots))
        mask = len(self.slots) - 1
        for entry, digest in enumerate(self.hashes):
            at = digest & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = entry


def best_rows(rows: pa.Table, identity: str, text: str) -> pa.Table:
    """One row per content: the one that stays, with `n` summed and `h` filled in."""
    table, best, counts = ContentTable(), [], []
    ids, texts, sizes = rows[identity].to_pylist(), rows[text].to_pylist(), rows["n"].to_pylist()
    for row, (own, value, n) in enumerate(zip(ids, texts, sizes)):
        value = value or ""
        body = value.encode("utf-8", "surrogatepass").translate(None, DELETED)
        entry = table.add(xxhash.xxh64_intdigest(body, 42), body)
        rank = (-len(value), own is None, own)
        if entry == len(best):
            best.append((rank, row))
            counts.append(n)
        else:
            counts[entry] += n
            if rank[:2] < best[entry][0][:2] or rank[:2] == best[entry][0][:2] and own is not None and own < best[entry][0][2]:
                best[entry] = (rank, row)
    kept = rows.take(pa.array([row for _, row in best], pa.int64()))
    # Batches of one input share a schema, so the fields stay as they came.
    hashes = [h - (h >> 63 << 64) for h in table.hashes]
    for name, values in (("n", counts), ("h", hashes)):
        kept = kept.set_column(kept.schema.get_field_index(name), kept.schema.field(name), pa.array(values, pa.int64()))
    return kept


def _spread(batches: Iterable[pa.RecordBatch], identity: str, text: str, memory: int) -> Iterator[pa.RecordBatch]:
    """Before the shuffle: equal rows of this partition become one, in runs of about `memory` bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= memory:
            yield from best_rows(pa.Table.from_batches(held), identity, text).to_batches(max_chunksize=2000)
            held, size = [], 0
    if held:
        yield from best_rows(pa.Table.from_batches(held), identity, text).to_batches(max_chunksize=2000)


def _settle(batches: Iterable[pa.RecordBatch], identity: str, text: str) -> Iterator[pa.RecordBatch]:
    """After the shuffle: rows come bucket by bucket, and a bucket's distinct contents fit a table."""
    bucket, held = None, None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        marks = rows["bucket"].to_pylist()
        start = 0
        while start < len(marks):
            end = start + 1
            while end < len(marks) and marks[end] == marks[start]:
                end += 1
            part = rows.slice(start, end - start)
            if marks[start] != bucket and held is not None:
                yield from held.to_batches(max_chunksize=2000)
                held = None
            bucket = marks[start]
            held = best_rows(part if held is None else pa.concat_tables([held, part]), identity, text)
            start = end
    if held is not None:
        yield from held.to_batches(max_chunksize=2000)


def bucket_plan(keys: DataFrame, first: int, memory: int) -> DataFrame | None:
    """Of `keys` (h, bytes: one row per distinct hash), those whose first bucket had to be divided, with their bucket.

    None when every first bucket fits. The driver learns only whether a level still has a bucket that does not fit.
    """
    digits = F.xxhash64(F.lit("digits"), F.col("h"))
    level = keys.withColumn("bucket", F.pmod("h", F.lit(first)).cast("string"))
    plan: DataFrame | None = None
    for depth in range(64 // FANOUT_BITS):
        sizes = level.groupBy("bucket").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
        over = cut_lineage(sizes.where((F.col("bytes") > memory) & (F.col("n") > 1)).select("bucket"))
        if over.isEmpty():
            break
        if depth:
            fits = level.join(over, "bucket", "left_anti")
            plan = fits if plan is None else plan.unionByName(fits)
        digit = F.shiftright(digits, depth * FANOUT_BITS).bitwiseAND((1 << FANOUT_BITS) - 1).cast("string")
        level = cut_lineage(level.join(over, "bucket", "left_semi").withColumn("bucket", F.concat_ws(".", "bucket", digit)))
    else:
        depth += 1
    if not depth:
        return None
    plan = level if plan is None else plan.unionByName(level)
    return plan.select("h", "bucket")


def dedup(
    docs: DataFrame, identity: str = "doc_id", text: str = "text", memory: int = 64 << 20, keys: DataFrame | None = None,
    added: str | None = "dedup",
) -> DataFrame:
    """The rows that stay, with all their columns, and `group_size`, `text_sha256` in a struct column `added` (None: without).

    `memory` is what the distinct contents of one bucket may weigh. `keys` may give (h, bytes) per row, if they are known.
    """
    spark = docs.sparkSession
    rows, names = renamed(docs)
    own, body = f"c{docs.columns.index(identity)}", f"c{docs.columns.index(text)}"
    if keys is None:
        keys = rows.select(F.xxhash64(content(F.col(body))).alias("h"), F.octet_length(content(F.col(body))).cast("long").alias("bytes"))
    keys = cut_lineage(keys.groupBy("h").agg(F.max("bytes").alias("bytes")))
    total = keys.agg(F.sum("bytes")).first()[0] or 0
    parts = max(partitions(spark), -(-2 * total // memory))
    first = 4 * parts
    divided = bucket_plan(keys, first, memory)

    rows = rows.withColumns({"n": F.lit(1).cast("long"), "h": F.lit(0).cast("long")})
    spread = rows.mapInArrow(lambda it: _spread(it, own, body, memory), rows.schema)
    plain = F.pmod("h", F.lit(first)).cast("string")
    if divided is None:
        spread = spread.withColumn("bucket", plain)
    else:
        spread = spread.join(divided, "h", "left").withColumn("bucket", F.coalesce("bucket", plain))
        spread = spread.select(*rows.columns, "bucket")
    placed = spread.repartition(parts, "bucket").sortWithinPartitions("bucket")
    settled = placed.mapInArrow(lambda it: _settle(it, own, body), placed.schema)
    found = F.struct(F.col("n").alias("group_size"), F.sha2(content(F.col(body)), 256).alias("text_sha256"))
    return settled.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], *([found.alias(added)] if added else []))


def groups_of(docs: DataFrame, identity: str = "doc_id", text: str = "text", memory: int = 64 << 20) -> DataFrame:
    """Every row: `doc_id`, `keep_id` (the row that stays), `group_size`, `kept`, `text_sha256`.

    Rows and groups meet by digest in a sort-merge join of narrow rows, whose hot keys adaptive execution divides.
    Where a whole row is repeated with its id, each of them is marked kept.
    """
    lean = docs.select(F.col(f"`{identity}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    body = content(F.col("text"))
    rows = written(
        lean.select(
            "doc_id",
            F.unhex(F.sha2(body, 256)).alias("digest"),
            F.xxhash64(body).alias("h"),
            F.octet_length(body).cast("long").alias("bytes"),
            F.length(F.coalesce("text", F.lit(""))).alias("points"),
        ),
        "dedup-rows",
    )
    stay = dedup(lean, memory=memory, keys=rows.select("h", "bytes"))
    stay = stay.select(
        F.col("doc_id").alias("keep_id"),
        F.unhex(F.col("dedup.text_sha256")).alias("digest"),
        F.col("dedup.group_size").alias("group_size"),
        F.length(F.coalesce("text", F.lit(""))).alias("most"),
    )
    joined = rows.join(stay.hint("merge"), "digest")
    return joined.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("most"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )

