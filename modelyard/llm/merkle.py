"""Merkle manifest of a table: a tree of hashes per group, a tree over the groups, and a proof for every row.

A leaf is the hash of a row. Leaves of a group ascend by id; every `ARITY` neighbours become their hash until one node is left, the
subroot; the subroots, ordered by group, likewise give the root. H is the lower-case hex SHA-256 of hex digests in a row.

Rows are sorted once, as narrow rows of digests, into shards that are written; a shard hashes every run of nodes that lies wholly
inside it. Only what is left at its two ends, at most 2 x 15 nodes per level and group, leaves the shard, and the runs across
shards are put together level by level from those. No group is a task, so a hot group costs nothing.

Proofs are octopus multiproofs: for all its leaves together a shard works out which nodes of the tree it can neither have nor
derive, which is the least set that proves them all; it fetches those once, by coordinates, derives the shared inner nodes, and
expands the proof of each leaf from them locally.

Defined results: a NULL value is hashed as `-`, so it differs from an empty text. A NULL group is a group of its own and comes
first, as does a NULL id in its group. Rows that repeat an id in a group are leaves of their own, in the order of their hashes.
A row is hashed over the named columns only; others are ignored, and no name clashes. An empty table has no rows and no root.
"""

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from modelyard.llm.common import ROWS_PER_TASK, few, partitions, written

ARITY = 16
ROOT = "subroot binary, root binary"
PROOFS = f"doc_id long, leaf binary, {ROOT}, proof_sha256 string, folded_root binary, siblings array<binary>, places array<int>"


def digest_of(nodes: Iterable[bytes]) -> bytes:
    """The hash of nodes in a row; digests are hashed as their hex text and kept as 32 bytes."""
    return hashlib.sha256(b"".join(nodes).hex().encode()).digest()


def level_sizes(count: int) -> list[int]:
    """How many nodes each level has, from the leaves to the one at the top."""
    sizes = [count]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // ARITY))
    return sizes


def row_digest(fields: list[Column]) -> Column:
    """Hash of a row: `-` for NULL, else the UTF-8 bytes of the value, `:` and the value, of each field."""
    texts = [f.cast("string") for f in fields]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _sharded(leaves: DataFrame, name: str) -> DataFrame:
    """`leaves` (grp, id, leaf, other) in order of group, id and hash, with their shard and their row in it."""
    rows = leaves.count()
    shards = max(1, min(partitions(leaves.sparkSession), rows), -(-rows // (2 * ROWS_PER_TASK)))
    order = [F.col(c).asc_nulls_first() for c in ("grp", "id", "leaf")]

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            own = [pa.array([shard] * batch.num_rows, pa.int32()), pa.array(range(place, place + batch.num_rows), pa.int64())]
            place += batch.num_rows
            yield pa.RecordBatch.from_arrays([*own, *batch.columns], ["shard", "row", *batch.schema.names])

    schema = "shard int, row long, grp string, id long, leaf binary, other binary"
    ordered = leaves.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    return written(ordered.mapInArrow(number, schema), name)


def _segments(rows: DataFrame) -> DataFrame:
    """One row per shard and group: its `n` leaves, the place of the first in the group (`start`), the group's `count`."""
    counts = rows.groupBy("shard", "grp").agg(F.count(F.lit(1)).alias("n"))
    # One row per shard of a group, not one per leaf.
    group = Window.partitionBy("grp")
    before = group.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    found = counts.withColumns({"start": F.coalesce(F.sum("n").over(before), F.lit(0)), "count": F.sum("n").over(group)})
    return written(found.select("shard", "grp", "start", "n", "count"), "merkle-segments")


def _climb(digests: list[bytes], start: int, count: int) -> Iterator[tuple[int, int, list[bytes]]]:
    """Level, first place and nodes for every level of which consecutive leaves alone give nodes."""
    for level, size in enumerate(level_sizes(count)):
        yield level, start, digests
        first = -(-start // ARITY)
        last = -(-size // ARITY) if start + len(digests) == size else (start + len(digests)) // ARITY
        if last <= first or size == 1:
            return
        digests = [digest_of(digests[ARITY * i - start : ARITY * (i + 1) - start]) for i in range(first, last)]
        start = first


def _by_group(table: pa.Table) -> Iterator[tuple[str | None, int, int]]:
    """Runs of equal groups in a sorted shard: group, first row, end."""
    groups = table["grp"].to_pylist()
    a = 0
    for b in range(1, len(groups) + 1):
        if b == len(groups) or groups[b] != groups[a]:
            yield groups[a], a, b
            a = b


NODES = "grp string, level int, place long, digest binary, size long"


def _loose(rows: DataFrame, segments: DataFrame) -> DataFrame:
    """Nodes whose run is not wholly in their shard, and nodes at the top of a group: `grp, level, place, digest, size`."""

    def run(shard: pa.Table, found: pa.Table) -> pa.Table:
        shard = shard.sort_by("row")
        where = {s["grp"]: (s["start"], s["count"]) for s in found.to_pylist()}
        leaves = shard["leaf"].to_pylist()
        out: list[tuple] = []
        for group, a, b in _by_group(shard):
            start, count = where[group]
            sizes = level_sizes(count)
            for level, first, nodes in _climb(leaves[a:b], start, count):
                size, end = sizes[level], first + len(nodes)
                inner = range(-(-first // ARITY) * ARITY, end if end == size else end // ARITY * ARITY)
                out += [(group, level, first + i, d, size) for i, d in enumerate(nodes) if size == 1 or first + i not in inner]
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.int64()]
        return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["grp", "level", "place", "digest", "size"])

    return rows.select("shard", "row", "grp", "leaf").groupBy("shard").cogroup(segments.groupBy("shard")).applyInArrow(run, NODES)


def _tree(rows: DataFrame, segments: DataFrame) -> DataFrame:
    """Every node that some shard may have to fetch, and the top of each group."""
    loose = written(_loose(rows, segments), "merkle-nodes")
    rows = loose.count()
    if not rows:
        return loose
    counted = segments.agg(F.max("count").alias("most")).first()["most"]
    every, built = loose, None
    for level in range(len(level_sizes(counted)) - 1):
        own = loose.where(F.col("level") == level)
        own = own.unionByName(built) if built is not None else own
        run = F.array_sort(F.collect_list(F.struct("place", "digest")))
        up = own.where("size > 1").groupBy("grp", "size", F.expr(f"place div {ARITY}").alias("above")).agg(run.alias("run"))
        # At most ARITY nodes of 32 bytes.
        text = F.array_join(F.transform("run", lambda x: F.lower(F.hex(x["digest"]))), "")
        up = up.select(
            "grp", F.lit(level + 1).alias("level"), F.col("above").alias("place"), F.unhex(F.sha2(text, 256)).alias("digest"),
            F.ceil(F.col("size") / ARITY).alias("size"),
        )
        built = written(few(up, rows), "merkle-nodes")
        every = every.unionByName(built)
    return every


def missing(start: int, end: int, count: int) -> list[tuple[int, int]]:
    """Coordinates (level, place) of the nodes that leaves start .. end - 1 need for their proofs and cannot derive."""
    wanted = []
    for level, size in enumerate(level_sizes(count)):
        # Runs that hold a known node, and what is not known of them.
        low, high = start // ARITY * ARITY, min(size, -(-end // ARITY) * ARITY)
        wanted += [(level, i) for i in (*range(low, start), *range(end, high))]
        start, end = start // ARITY, -(-end // ARITY)
    return wanted


def _wanted(segments: DataFrame) -> DataFrame:
    """What each shard has to fetch: `shard, grp, level, place`."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                (s["shard"], s["grp"], level, place)
                for s in batch.to_pylist()
                for level, place in missing(s["start"], s["start"] + s["n"], s["count"])
            ]
            kinds = [pa.int32(), pa.string(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["shard", "grp", "level", "place"]
            )

    return segments.mapInArrow(run, "shard int, grp string, level int, place long")


class _Known:
    """The nodes of a group that a shard has, derived or fetched, and proofs from them."""

    def __init__(self, leaves: list[bytes], start: int, count: int, fetched: dict[tuple[int, int], bytes]):
        self.levels: list[tuple[int, list[bytes]]] = []
        self.sizes = level_sizes(count)
        for level, size in enumerate(self.sizes):
            low = start // ARITY * ARITY
            high = min(size, -(-(start + len(leaves)) // ARITY) * ARITY)
            run = [fetched[level, i] for i in range(low, start)] + leaves + [fetched[level, i] for i in range(start + len(leaves), high)]
            self.levels.append((low, run))
            if size > 1:
                leaves = [digest_of(run[i : i + ARITY]) for i in range(0, len(run), ARITY)]
                start = low // ARITY
        self.top = self.levels[-1][1][0]

    def proof(self, place: int) -> list[tuple[list[bytes], int]]:
        """Per level the run that holds the node, and the node's place in it."""
        steps = []
        for (low, nodes), size in zip(self.levels, self.sizes):
            if size > 1:
                a = place // ARITY * ARITY - low
                steps.append((nodes[a : a + ARITY], place % ARITY))
                place //= ARITY
        return steps


def fold(leaf: bytes, siblings: Iterable[list[bytes]], places: Iterable[int]) -> bytes:
    """The root that a leaf and its proof give: per level the other nodes of its run, and its place among them."""
    for others, place in zip(siblings, places):
        leaf = digest_of([*others[:place], leaf, *others[place:]])
    return leaf


def _prove(rows: DataFrame, nodes: DataFrame, segments: DataFrame, above: DataFrame | None, keep_siblings: bool) -> DataFrame:
    """A proof for each row of `rows`. `above` has the proof of each group's subroot: `doc_id` (its place), `grp`, proof columns."""
    wanted = _wanted(segments)
    same = [wanted[c].eqNullSafe(nodes[c]) for c in ("grp", "level", "place")]
    fetched = wanted.join(nodes, same[0] & same[1] & same[2]).select(wanted.shard, wanted.grp, wanted.level, wanted.place, "digest")
    fetched = fetched.withColumns({"start": F.lit(None).cast("long"), "count": F.lit(None).cast("long")})
    # One row per shard and group, so that a hot group is no hot key here.
    known = segments.select("shard", "grp", F.lit(-1).alias("level"), F.lit(0).cast("long").alias("place"), F.lit(None).cast("binary").alias("digest"), "start", "count")
    fetched = fetched.unionByName(known)
    if above is not None:
        up = above.select(F.col("grp").alias("g2"), "root", F.col("siblings").alias("up"), F.col("places").alias("up_places"))
        own = segments.join(up, F.col("grp").eqNullSafe(F.col("g2"))).select(
            "shard", "grp", F.lit(-2).alias("level"), F.lit(0).cast("long").alias("place"), F.col("root").alias("digest"),
            F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("count"), "up", "up_places",
        )
        fetched = fetched.withColumns({"up": F.lit(None).cast("array<binary>"), "up_places": F.lit(None).cast("array<int>")}).unionByName(own)

    def run(shard: pa.Table, found: pa.Table) -> pa.Table:
        shard = shard.sort_by("row")
        leaves, others, ids = (shard[c].to_pylist() for c in ("leaf", "other", "id"))
        got: dict[str | None, dict] = {}
        where: dict[str | None, tuple[int, int]] = {}
        higher: dict[str | None, tuple[bytes, list, list]] = {}
        for node in found.to_pylist():
            if node["level"] == -1:
                where[node["grp"]] = (node["start"], node["count"])
            elif node["level"] == -2:
                higher[node["grp"]] = (node["digest"], node["up"], node["up_places"])
            else:
                got.setdefault(node["grp"], {})[node["level"], node["place"]] = node["digest"]
        columns: list[list] = [[] for _ in range(8)]
        for group, a, b in _by_group(shard):
            start, count = where[group]
            tree = _Known(leaves[a:b], start, count, got.get(group, {}))
            root, flat, up_places = higher.get(group, (tree.top, [], []))
            tail = _unflattened(flat, up_places)
            for i in range(a, b):
                steps = tree.proof(start + i - a)
                siblings = [run[:place] + run[place + 1 :] for run, place in steps] + [s for s, _ in tail]
                places = [place for _, place in steps] + [place for _, place in tail]
                plain = [d for level in siblings for d in level]
                folded = fold(others[i] or leaves[i], siblings, places)
                values = (ids[i], leaves[i], tree.top, root, hashlib.sha256(b"".join(plain).hex().encode()).hexdigest(), folded)
                for column, value in zip(columns, values):
                    column.append(value)
                if keep_siblings:
                    columns[6].append(plain)
                    columns[7].append([x for level, place in zip(siblings, places) for x in (len(level), place)])
        if not keep_siblings:
            columns[6:] = [[None] * len(ids)] * 2
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.string(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32())]
        names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "siblings", "places"]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    lean = rows.select("shard", "row", "grp", "id", "leaf", "other")
    return lean.groupBy("shard").cogroup(fetched.groupBy("shard")).applyInArrow(run, PROOFS)


def _unflattened(siblings: list[bytes], places: list[int]) -> list[tuple[list[bytes], int]]:
    """Per level the siblings and the place, from the stored form: all siblings, and pairs of (number of siblings, place)."""
    out, at = [], 0
    for size, place in zip(places[::2], places[1::2]):
        out.append((siblings[at : at + size], place))
        at += size
    return out


def _manifest(leaves: DataFrame, keep_siblings: bool) -> DataFrame:
    """Proofs of `leaves` (grp, id, leaf, other), as `PROOFS`."""
    rows = _sharded(leaves, "merkle-leaves")
    segments = _segments(rows)
    nodes = _tree(rows, segments)
    # The tree over the groups is the same thing, with one row per group and one group.
    tops = written(nodes.where("size = 1").select("grp", "digest"), "merkle-subroots")
    # Its leaves are numbered by what they are sorted by: the group. A row has the group's name in place of an id.
    summit = tops.select(F.lit("").alias("grp"), F.lit(0).cast("long").alias("id"), F.col("digest").alias("leaf"), F.col("grp").alias("name"))
    above = _group_proofs(summit)
    return _prove(rows, nodes, segments, above, keep_siblings)


def _group_proofs(tops: DataFrame) -> DataFrame:
    """`grp, root, siblings, places` of each subroot, in the tree over all subroots ordered by group."""
    count = tops.count()
    shards = max(1, min(partitions(tops.sparkSession), -(-count // ROWS_PER_TASK)))
    order = F.col("name").asc_nulls_first()

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            out = [pa.array([shard] * batch.num_rows, pa.int32()), pa.array(range(row, row + batch.num_rows), pa.int64()), *batch.columns]
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays(out, ["shard", "row", "name", "leaf"])

    ordered = tops.select("name", "leaf").repartitionByRange(shards, order).sortWithinPartitions(order)
    placed = written(ordered.mapInArrow(number, "shard int, row long, name string, leaf binary"), "merkle-summit")
    # The id of a subroot is its shard and row; shards and rows ascend with the names.
    number_of = F.col("shard") * F.lit(1 << 40) + F.col("row")
    rows = placed.select("shard", "row", F.lit("").alias("grp"), number_of.alias("id"), "leaf", F.lit(None).cast("binary").alias("other"))
    segments = _segments(rows)
    proofs = _prove(rows, _tree(rows, segments), segments, None, True)
    names = placed.select(number_of.alias("doc_id"), F.col("name").alias("grp"))
    return written(names.join(proofs, "doc_id").select("grp", "root", "siblings", "places"), "merkle-summit")


def _leaves(docs: DataFrame, identity: str, group: str, fields: Sequence[str], text: str, tampered: Column | None) -> DataFrame:
    """`grp, id, leaf, other`; `other` is the hash with `text` lower-cased (A-Z) where `tampered` holds, else NULL."""
    columns = {c: F.col(f"`{c}`") for c in fields}
    leaf = row_digest(list(columns.values()))
    other = F.lit(None).cast("binary")
    if tampered is not None:
        changed = F.translate(columns[text], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        other = F.when(tampered, row_digest([changed if c == text else v for c, v in columns.items()]))
    named = [F.col(f"`{group}`").cast("string").alias("grp"), F.col(f"`{identity}`").cast("long").alias("id")]
    return written(docs.select(*named, leaf.alias("leaf"), other.alias("other")), "merkle-rows")


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def audit(docs: DataFrame, identity: str = "doc_id", group: str = "source", fields: Sequence[str] = FIELDS, text: str = "text") -> DataFrame:
    """Per row its leaf, subroot, root, the hash of its proof, and the root that a tampered row and the proof give.

    Tampered are the rows whose id has a CRC-32 (of its decimal digits) that 5 divides, a NULL id never: A-Z of `text` is lower-cased.
    """
    every_fifth = F.coalesce(F.crc32(F.col(f"`{identity}`").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    out = _manifest(_leaves(docs, identity, group, fields, text, every_fifth), False)
    shown = {c: F.lower(F.hex(c)) for c in ("leaf", "subroot", "root", "folded_root")}
    return out.select("doc_id", *[v.alias(c) for c, v in shown.items()], "proof_sha256", (F.col("folded_root") == F.col("root")).alias("verified"))


def proofs(docs: DataFrame, identity: str = "doc_id", group: str = "source", fields: Sequence[str] = FIELDS, text: str = "text") -> DataFrame:
    """Per row its leaf, subroot, root and whole proof: `proof`, an array of (place, siblings) from the leaf's level to the root's."""
    out = _manifest(_leaves(docs, identity, group, fields, text, None), True)
    sizes = F.filter("places", lambda _, i: i % 2 == 0)
    ends = F.transform(F.sequence(F.lit(1), F.size(sizes)), lambda k: F.aggregate(F.slice(sizes, F.lit(1), k), F.lit(0), lambda a, b: a + b))
    levels = F.transform(
        F.arrays_zip(sizes.alias("size"), ends.alias("end"), F.filter("places", lambda _, i: i % 2 == 1).alias("place")),
        lambda x: F.struct(x["place"].alias("place"), F.slice("siblings", x["end"] - x["size"] + 1, x["size"]).alias("siblings")),
    )
    steps = F.when(F.size("places") > 0, levels).otherwise(F.array().cast("array<struct<place:int,siblings:array<binary>>>"))
    return out.select("doc_id", "leaf", "subroot", "root", steps.alias("proof"))
