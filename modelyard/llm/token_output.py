"""Token ids in fixed-width bit-packed files.

A token file is a folder. `blocks` holds Parquet rows, one per block of whole documents: shard, block, place in the shard,
the documents with their lengths, and `payload`, where every id takes the least bits that the vocabulary needs. Ids are packed in
groups of 64, which are `bits` little-endian 64-bit words, so all groups pack and unpack in 64 vectorised steps and any id can
be reached without reading what is before it. `manifest` has one row per shard with the number of ids before it.

Shards follow each other in ascending document id, and blocks within a shard. Parquet's committer makes the folder safe
against lost executors: a block is in the files once or not at all.

Defined results: a NULL or empty text is only its end id. A NULL id comes first. Rows that repeat an id are each encoded, in the
order of a hash of their texts. An empty table gives an empty folder. A text longer than a block is a block of its own.
"""

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from modelyard.llm.common import join_small, partitions, scratch, text_size

GROUP = 64
# Texts that are cut and put together at a time.
ROWS = 2000
BLOCKS = "shard int, block int, first long, n_ids long, bits int, doc_ids array<long>, lengths array<long>, payload binary"
CACHED_PARTS = 500_000
# The parts of byte-level vocabularies, for visible ASCII, Latin letters, and single spaces and line ends.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
PLAIN = re.compile(rf"[ \t\n\r!-~{LETTERS}]*[\t\n\r!-~{LETTERS}]")
PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s")
# Bytes that are no visible Latin-1 character are named, in their order, from 256 on.
HIDDEN = [*range(33), *range(127, 161), 173]
BYTE_NAMES = {byte: 256 + i for i, byte in enumerate(HIDDEN)}
# White space in a row, in the widest sense; a text without it splits safely at single spaces.
DOUBLE_SPACE = re.compile(r"\s\s")
_encoders: dict[str, "Encoder"] = {}


def width_of(vocabulary: int) -> int:
    """Bits that hold every id below `vocabulary`."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids below 2**bits, 64 of them in `bits` words; the last group is filled with zeros."""
    groups = -(-len(ids) // GROUP)
    lanes = np.zeros(groups * GROUP, np.uint64)
    lanes[: len(ids)] = ids
    lanes = lanes.reshape(groups, GROUP)
    words = np.zeros((groups, bits), np.uint64)
    for lane in range(GROUP):
        word, shift = divmod(lane * bits, 64)
        words[:, word] |= lanes[:, lane] << np.uint64(shift)
        if shift + bits > 64:
            words[:, word + 1] |= lanes[:, lane] >> np.uint64(64 - shift)
    return words.astype("<u8").tobytes()


def unpack(payload: bytes, bits: int, first: int, count: int) -> np.ndarray:
    """`count` ids from place `first` on, reading only the groups that hold them."""
    start, end = first // GROUP, -(-(first + count) // GROUP)
    words = np.frombuffer(payload, "<u8", (end - start) * bits, start * bits * 8).reshape(end - start, bits)
    ids = np.empty((end - start, GROUP), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for lane in range(GROUP):
        word, shift = divmod(lane * bits, 64)
        value = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            value = value | words[:, word + 1] << np.uint64(64 - shift)
        ids[:, lane] = value & mask
    return ids.reshape(-1)[first - start * GROUP : first - start * GROUP + count]


class Encoder:
    """Ids of texts, with the ids of recurring words remembered.

    Byte-level vocabularies split a text before every single space that stands between two other characters. So a batch of such texts is
    cut at its spaces, every word of the batch is looked at once, and the ids are put together by place. An ASCII word is cut further,
    by the rule that all byte-level vocabularies share, into parts that the model itself encodes; the parts are remembered, and
    after `CACHED_PARTS` of them the memory starts anew, which changes no id. Other words, and texts with other white space in a
    row or with a literal mark of the vocabulary, are encoded whole by the library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        marks = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(marks)) if marks else None
        self.known: dict[str, bytes] = {}
        self.tokenize = self.tokenizer.model.tokenize
        before = self.tokenizer.pre_tokenizer
        plain = self.tokenizer.normalizer is None and isinstance(before, pre_tokenizers.ByteLevel)
        self.by_piece = plain and before.use_regex and not before.add_prefix_space

    def whole(self, texts: list[str]) -> list[bytes]:
        """Native 32-bit ids of each text, from the library."""
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The same, from pieces where that is safe."""
        if len(self.known) > CACHED_PARTS:
            self.known.clear()
        safe = [i for i, t in enumerate(texts) if self.splits(t)]
        out: list[bytes] = [b""] * len(texts)
        others = sorted(set(range(len(texts))).difference(safe))
        for i, ids in zip(others, self.whole([texts[i] for i in others])):
            out[i] = ids
        if not safe:
            return out
        split = pc.split_pattern(pa.array([texts[i] for i in safe], pa.large_string()), " ")
        starts = split.offsets.to_numpy()
        words = split.flatten().dictionary_encode()
        place = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        # A text's first word has no space before it: words of its own, behind the others.
        firsts = [w.as_py() for w in words.take(pa.array(starts[:-1]))]
        place[starts[:-1]] = len(words.dictionary) + np.arange(len(firsts))
        found = self.words([" " + w for w in words.dictionary.to_pylist()] + firsts)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat, begin = np.frombuffer(b"".join(found), np.uint32), np.cumsum(sizes) - sizes
        counts = sizes[place]
        ends = np.cumsum(counts)
        ids = flat[np.repeat(begin[place] - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        cuts = 4 * np.append(0, ends)[starts]
        for i, a, b in zip(safe, cuts[:-1].tolist(), cuts[1:].tolist()):
            out[i] = ids[a:b]
        return out

    def splits(self, text: str) -> bool:
        """Whether the ids of a text are those of its pieces."""
        return self.by_piece and not DOUBLE_SPACE.search(text) and not (self.added and self.added.search(text))

    def words(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece: a word with the space before it, if it has one."""
        known, part, parts, plain = self.known, self.part, PARTS.findall, PLAIN.fullmatch
        out = list(map(known.get, pieces))
        whole = []
        for i, ids in enumerate(out):
            if ids is None:
                piece = pieces[i]
                if plain(piece):
                    cut = parts(piece)
                    out[i] = part(piece) if len(cut) == 1 else b"".join([known.get(p) or part(p) for p in cut])
                else:
                    whole.append(i)
        for i, ids in zip(whole, self.whole([pieces[i] for i in whole])):
            out[i] = known[pieces[i]] = ids
        return out

    def part(self, part: str) -> bytes:
        """The ids of a part that no byte-level vocabulary cuts before its own merges."""
        if not part.isascii():
            name = part.encode().decode("latin-1").translate(BYTE_NAMES)
        elif part[0] == " ":
            name = "\u0120" + part[1:]
        else:
            name = part.translate(BYTE_NAMES)
        ids = self.known[part] = array("I", [t.id for t in self.tokenize(name)]).tobytes()
        return ids


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_ids(
    docs: DataFrame, tokenizer: str, path: str, end_id: int, identity: str = "doc_id", text: str = "text",
    block_ids: int = 1 << 18, shard_bytes: int = 64 << 20,
) -> None:
    """Encode every document, append `end_id`, and write the token file at `path`."""
    spark = docs.sparkSession
    vocabulary = max(encoder(tokenizer).tokenizer.get_vocab_size(), end_id + 1)
    bits = width_of(vocabulary)
    end = np.array([end_id], "<u4").tobytes()
    lean = docs.select(F.col(f"`{identity}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    shards = max(partitions(spark), -(-text_size(lean, "text")[1] // shard_bytes))
    tie = F.xxhash64("text")
    ordered = lean.withColumn("tie", tie).repartitionByRange(shards, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        shard, block, first = TaskContext.get().partitionId(), 0, 0
        ids: list[int | None] = []
        data: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            numbers = np.frombuffer(b"".join(data), "<u4")
            row = [shard, block, first, len(numbers), bits, ids, [len(d) // 4 for d in data], pack(numbers, bits)]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            names = ["shard", "block", "first", "n_ids", "bits", "doc_ids", "lengths", "payload"]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

        for batch in batches:
            encoded = (e for i in range(0, batch.num_rows, ROWS) for e in own.encode(batch.column(1)[i : i + ROWS].to_pylist()))
            for number, body in zip(batch.column(0).to_pylist(), encoded):
                ids.append(number)
                data.append(body + end)
                held += len(body) // 4 + 1
                if held >= block_ids:
                    yield flush()
                    block, first, held = block + 1, first + held, 0
                    ids, data = [], []
        if data:
            yield flush()

    ordered.select("doc_id", "text").mapInArrow(run, BLOCKS).write.option("compression", "zstd").parquet(f"{path}/blocks")
    sums = spark.read.parquet(f"{path}/blocks").groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
    # One row per shard.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    manifest = sums.select("shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("before"), "n_ids")
    manifest.write.parquet(f"{path}/manifest")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """From the files: `doc_id`, `start` (ids of all documents before it), `n_tokens`, `ids_crc32`, `max_id`."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["payload"], row["bits"], 0, row["n_ids"]).astype("<u4")
                sizes = np.array(row["lengths"], np.int64)
                ends = np.cumsum(sizes)
                raw = memoryview(ids.tobytes())
                sums = [zlib.crc32(raw[4 * (b - n) : 4 * b]) for b, n in zip(ends.tolist(), sizes.tolist())]
                columns = {
                    "shard": pa.array([row["shard"]] * len(sizes), pa.int32()),
                    "doc_id": pa.array(row["doc_ids"], pa.int64()),
                    "place": pa.array(row["first"] + ends - sizes, pa.int64()),
                    "n_tokens": pa.array(sizes),
                    "ids_crc32": pa.array(sums, pa.int64()),
                    "max_id": pa.array(np.maximum.reduceat(ids, ends - sizes).astype(np.int64)),
                }
                yield pa.RecordBatch.from_pydict(columns)

    blocks = spark.read.parquet(f"{path}/blocks").select("shard", "first", "n_ids", "bits", "doc_ids", "lengths", "payload")
    rows = blocks.mapInArrow(run, "shard int, doc_id long, place long, n_tokens long, ids_crc32 long, max_id long")
    manifest = spark.read.parquet(f"{path}/manifest").select("shard", "before")
    return join_small(rows, manifest, "shard", "inner").select(
        "doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32", "max_id"
    )


def read_range(spark: SparkSession, path: str, start: int, count: int) -> DataFrame:
    """`position`, `id` of the ids at global places start .. start + count - 1; only blocks that hold them are unpacked."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = row["before"] + row["first"]
                a, b = max(start, own), min(start + count, own + row["n_ids"])
                ids = unpack(row["payload"], row["bits"], a - own, b - a)
                yield pa.RecordBatch.from_pydict({"position": pa.array(np.arange(a, b)), "id": pa.array(ids.astype(np.int64))})

    blocks = spark.read.parquet(f"{path}/blocks").join(spark.read.parquet(f"{path}/manifest").select("shard", "before"), "shard")
    place = F.col("before") + F.col("first")
    inside = blocks.where((place < start + count) & (place + F.col("n_ids") > start)).select("before", "first", "n_ids", "bits", "payload")
    return inside.mapInArrow(run, "position long, id long")


def encode_and_read(docs: DataFrame, tokenizer: str, end_id: int, identity: str = "doc_id", text: str = "text") -> DataFrame:
    """Write a token file in the shared folder and give what `read_documents` finds in it."""
    path = scratch(docs.sparkSession, "tokens")
    write_ids(docs, tokenizer, path, end_id, identity, text)
    return read_documents(docs.sparkSession, path)
