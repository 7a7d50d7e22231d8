"""Corpus-wide counts for every token of every document, without a shuffle of one row per token.

Documents are packed into blocks of a few megabytes and written once, which fixes what a block is. Each block asks for its
distinct keys: they are sorted, cut by key range into buckets, and a (block, bucket) chunk travels as one row of differences,
a few bytes per key. A bucket adds up what all blocks sent and answers each block with the totals in the order it asked.
Then block and answers meet, and the block works with the totals of its own keys. A key that all blocks hold is one number
per block in its bucket, so no key is hot; blocks and buckets have a bounded size, so no task grows with the data.
"""

import io
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from modelyard.llm.common import written

CHUNK = "bucket int, block long, n int, keys binary, counts binary"
ANSWER = "block long, bucket int, totals binary"


def packed_bytes(values: np.ndarray) -> bytes:
    """Whole numbers, byte plane by byte plane, compressed: planes of zeros cost nothing."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpacked(data: bytes, dtype, n: int) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(width, n).T).reshape(-1).view(dtype)


def sorted_bytes(keys: np.ndarray) -> bytes:
    """Ascending distinct keys as differences."""
    return packed_bytes(np.diff(keys, prepend=np.uint64(0)))


def sorted_keys(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpacked(data, np.uint64, n), dtype=np.uint64)


def row_numbers(block: int, rows: int) -> np.ndarray:
    """A number for each row of a block that no other row has: 20 bits of partition, 21 of block and 22 of row."""
    partition, made = divmod(block, 1 << 32)
    if partition >= 1 << 20 or made >= 1 << 21 or rows > 1 << 22:
        raise ValueError("more partitions or blocks than row numbers allow; use larger blocks or fewer partitions")
    return (partition << 43 | made << 22) + np.arange(rows, dtype=np.int64)


def table_bytes(rows: pa.Table) -> bytes:
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 4))) as out:
        out.write_table(rows)
    return sink.getvalue()


def table_of(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def block_batch(number: int, part: int, rows: pa.Table) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {"block": pa.array([number], pa.int64()), "part": pa.array([part], pa.int32()), "body": pa.array([table_bytes(rows)], pa.binary())}
    )


def pack_blocks(docs: DataFrame, block_bytes: int = 8 << 20, name: str = "blocks", once: str | None = None) -> DataFrame:
    """`docs` (any columns and `part` int) as rows `block, part, body`, written to the shared folder.

    A block holds rows of one part and about `block_bytes` of them, or one row that is larger. Of rows of a partition with the
    same value of the column `once`, the first is taken.
    """

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        held: dict[int, list] = {}
        size: dict[int, int] = {}
        made = 0
        seen: set = set()
        for batch in batches:
            if once:
                keys = batch.column(batch.schema.get_field_index(once)).to_pylist()
                fresh = [i for i, key in enumerate(keys) if not (key in seen or seen.add(key))]
                batch = batch.take(pa.array(fresh, pa.int64()))
            for piece in (batch.slice(i, 200) for i in range(0, batch.num_rows, 200)):
                parts = piece.column(piece.schema.get_field_index("part")).to_numpy(zero_copy_only=False)
                for part in np.unique(parts).tolist():
                    rows = piece.take(pa.array(np.flatnonzero(parts == part)))
                    held.setdefault(part, []).append(rows)
                    size[part] = size.get(part, 0) + rows.nbytes
                    if size[part] >= block_bytes:
                        yield block_batch(first + made, part, pa.Table.from_batches(held.pop(part)).drop_columns(["part"]))
                        made += 1
                        size[part] = 0
        for part, rows in held.items():
            yield block_batch(first + made, part, pa.Table.from_batches(rows).drop_columns(["part"]))
            made += 1

    return written(docs.mapInArrow(pack, "block long, part int, body binary"), name)


def bounds(buckets: int, bits: int) -> np.ndarray:
    return np.array([(i << bits) // buckets for i in range(buckets)], np.uint64)


def ask(
    blocks: DataFrame, keys_of: Callable[[pa.Table, int], tuple[np.ndarray, np.ndarray]], columns: int, buckets: int, bits: int = 64
) -> DataFrame:
    """What each block asks for: `keys_of(rows, part)` gives ascending distinct keys below 2**bits and their counts.

    Counts are a uint32 array of shape (columns, keys).
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = bounds(buckets, bits)
        for batch in batches:
            for block, part, body in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                keys, counts = keys_of(table_of(body), part)
                cuts = np.append(np.searchsorted(keys, edges), len(keys))
                out: dict[str, list] = {"bucket": [], "block": [], "n": [], "keys": [], "counts": []}
                for bucket in np.flatnonzero(np.diff(cuts)).tolist():
                    a, b = cuts[bucket], cuts[bucket + 1]
                    out["bucket"].append(bucket)
                    out["block"].append(block)
                    out["n"].append(int(b - a))
                    out["keys"].append(sorted_bytes(keys[a:b]))
                    out["counts"].append(packed_bytes(counts[:, a:b].reshape(-1)))
                if out["n"]:
                    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], list(out))

    return blocks.select("block", "part", "body").mapInArrow(run, CHUNK)


def answer(
    chunks: DataFrame, columns: int, summary: Callable[[np.ndarray, np.ndarray], list[int]] | None = None, name: str = "answers"
) -> DataFrame:
    """Totals for each chunk, in the order of its keys, written to the shared folder.

    `summary(keys, totals)` may give numbers about a bucket's distinct keys; they come as rows of block -1.
    """

    def run(rows: pa.Table) -> pa.Table:
        sizes = rows["n"].to_pylist()
        keys = np.concatenate([sorted_keys(k, n) for k, n in zip(rows["keys"].to_pylist(), sizes)])
        counts = [unpacked(c, np.uint32, columns * n).reshape(columns, n) for c, n in zip(rows["counts"].to_pylist(), sizes)]
        counts = np.concatenate(counts, axis=1)
        distinct, place = np.unique(keys, return_inverse=True)
        totals = np.stack([np.bincount(place, weights=c, minlength=len(distinct)).astype(np.uint64) for c in counts])
        blocks, data, start = rows["block"].to_pylist(), [], 0
        for n in sizes:
            data.append(packed_bytes(totals[:, place[start : start + n]].reshape(-1)))
            start += n
        if summary:
            blocks.append(-1)
            data.append(packed_bytes(np.array(summary(distinct, totals), np.uint64)))
        bucket = pa.array([rows["bucket"][0].as_py()] * len(blocks), pa.int32())
        return pa.table({"block": pa.array(blocks, pa.int64()), "bucket": bucket, "totals": pa.array(data, pa.binary())})

    return written(chunks.groupBy("bucket").applyInArrow(run, ANSWER), name)


def summaries(answers: DataFrame, width: int) -> np.ndarray:
    """The summed numbers of all buckets; one short row per bucket reaches the driver."""
    rows = answers.where("block = -1").select("totals").toLocalIterator()
    return sum((unpacked(bytes(r["totals"]), np.uint64, width).astype(np.int64) for r in rows), np.zeros(width, np.int64))


def finish(
    blocks: DataFrame, answers: DataFrame, columns: int, work: Callable[[pa.Table, int, np.ndarray, int], pa.Table], schema: str
) -> DataFrame:
    """`work(rows, part, totals, block)` for each block, with the totals of its keys in ascending order of the keys."""

    def run(block: pa.Table, found: pa.Table) -> pa.Table:
        if not block.num_rows:
            return empty(schema)
        order = np.argsort(found["bucket"].to_numpy()) if found.num_rows else []
        data = found["totals"].to_pylist()
        pieces = []
        for i in order:
            raw = zstandard.ZstdDecompressor().decompress(data[i])
            n = len(raw) // (8 * columns)
            pieces.append(unpacked(data[i], np.uint64, columns * n).reshape(columns, n))
        totals = np.concatenate(pieces, axis=1) if pieces else np.zeros((columns, 0), np.uint64)
        return work(table_of(block["body"][0].as_py()), block["part"][0].as_py(), totals, block["block"][0].as_py())

    asked = answers.where("block >= 0")
    return blocks.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(run, schema)


def empty(schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "boolean": pa.bool_()}
    kinds["array<long>"] = pa.list_(pa.int64())
    fields = [f.strip().split(" ") for f in schema.split(",")]
    return pa.schema([(n, kinds[t]) for n, t in fields]).empty_table()
