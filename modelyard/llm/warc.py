r"""WARC archives without repeated payloads, and what is read back from them.

Of records with the same payload one is written as a response, the others as revisits that refer to it and carry no payload.
Headers alone decide that: digests and sizes are worked out next to the payloads, narrow rows are shuffled by digest, and each
digest's original is found with an aggregate. Payloads move once, to the archives, and only to be responses: an original
is joined by id and digest, which no other record shares, so a payload that a third of all pages have is no hot key. Revisits
never touch a payload. Their headers meet the originals by digest; the few digests with the most records are joined by a
broadcast of at most `HOT_DIGESTS` rows, which is all there can be of those that have more than that share of the records.

An archive is a gzip file of uncompressed-size-bounded parts, written by Spark's text sink: a record ends with two line ends, and so
does every line of that sink here. Lost executors leave no half-written archive. Archives are read as a stream of pieces that end
with two line ends, and records are cut by their Content-Length alone, so a payload may hold anything, also record headers.

Record ids are `urn:page:<id>:<digest>`. A response is an HTTP message with the payload as its body; a revisit is that message's head,
under the profile `identical-payload-digest`, with the Content-Length of the full payload.

Defined results: a NULL payload is an empty one, and has a digest. Payloads below `least_bytes` are all responses. A NULL id is
never an original unless all records of its payload have none. Records that repeat the id of an original with the same payload are
responses like it. A NULL URL has no target header; line ends and other control characters in a URL are percent-encoded. An empty table
gives archives without records. Other columns are ignored.
"""

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from modelyard.llm.common import partitions, scratch, written

END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# Digests that can each have more than this share of all records: fewer than its inverse.
HOT_DIGESTS = 1000
ARCHIVE_BYTES = 64 << 20
RECORDS = (
    "page_id long, url string, record_type string, record_id string, payload_digest string, payload_bytes long, "
    "refers_to long, refers_to_id string, date string, payload binary"
)


def base32_sha1(body: Column) -> Column:
    """The bare base-32 SHA-1 of bytes: 20 bits are five hexadecimal and four base-32 digits."""
    digits = [F.lpad(F.conv(F.substring(F.sha1(body), 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_id(identity: Column, digest: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(identity.cast("string"), F.lit("")), F.lit(":"), digest, F.lit(">"))


def _safe(url: Column) -> Column:
    """A URL as a header value: control characters and spaces are percent-encoded, one by one."""
    clean = url
    for code in (*range(33), 127):
        clean = F.replace(clean, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.when(F.regexp_like(url, F.lit(r"[\x00-\x20\x7F]")), clean).otherwise(url)


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for NULL."""
    return F.coalesce(F.concat(F.lit(f"\r\n{name}: "), value), F.lit(""))


def _record(kind: str, date: str) -> Column:
    """The record of a row with page_id, url, digest, bytes, and `payload` or the original's `target` and `target_url`."""
    message = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = F.concat(message, F.col("payload")) if kind == "response" else message
    lines = [
        F.lit(f"WARC/1.1\r\nWARC-Type: {kind}"),
        _line("WARC-Record-ID", record_id(F.col("page_id"), F.col("digest"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", _safe(F.col("url"))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
    ]
    if kind == "revisit":
        lines += [_line("WARC-Profile", F.lit(PROFILE)), _line("WARC-Truncated", F.lit("length"))]
        lines += [_line("WARC-Refers-To", record_id(F.col("target"), F.col("digest"))), _line("WARC-Refers-To-Date", F.lit(date))]
    return F.concat(*lines, _line("Content-Length", F.octet_length(block).cast("string")), F.lit(END), block)


def headers(pages: DataFrame) -> DataFrame:
    """`page_id, url, digest, bytes` of `pages` (page_id, url, payload)."""
    payload = F.coalesce("payload", F.lit("")).cast("binary")
    return pages.select("page_id", "url", base32_sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"))


def originals(heads: DataFrame, least_bytes: int) -> DataFrame:
    """Per digest with at least `least_bytes` and more than one record: `digest, target, records`."""
    groups = heads.where(F.col("bytes") >= least_bytes).groupBy("digest")
    return groups.agg(F.max("page_id").alias("target"), F.count(F.lit(1)).alias("records")).where("records > 1")


def revisits(heads: DataFrame, found: DataFrame) -> DataFrame:
    """The headers that are not their payload's original, with the `target` they refer to."""
    total = heads.count()
    # Fewer than HOT_DIGESTS digests can have more records than that.
    hot = F.col("records") * HOT_DIGESTS > total
    lean = found.select("digest", "target", "records")
    often, seldom = F.broadcast(lean.where(hot)), lean.where(~hot)
    cold = heads.join(often.select("digest"), "digest", "left_anti").join(seldom.hint("shuffle_hash"), "digest")
    joined = heads.join(often, "digest").unionByName(cold)
    return joined.where(~F.col("page_id").eqNullSafe(F.col("target"))).select("page_id", "url", "digest", "bytes", "target")


def write_archives(
    pages: DataFrame, path: str, identity: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0,
    date: str = "2024-01-01T00:00:00Z",
) -> None:
    """Write a record per row as gzipped WARC archives under `path`."""
    spark = pages.sparkSession
    lean = pages.select(
        F.col(f"`{identity}`").cast("long").alias("page_id"), F.col(f"`{url}`").alias("url"), F.coalesce(F.col(f"`{payload}`"), F.lit("")).alias("payload")
    )
    heads = written(headers(lean), "warc-headers")
    found = written(originals(heads, least_bytes), "warc-originals")
    visits = written(revisits(heads, found), "warc-revisits")

    size = heads.agg(F.sum("bytes").alias("b")).first()["b"] or 0
    shards = max(partitions(spark), -(-size // ARCHIVE_BYTES))
    keyed = lean.withColumns({"digest": base32_sha1(F.col("payload").cast("binary")), "bytes": F.octet_length("payload").cast("long")})
    if visits.isEmpty():
        bodies = keyed
    else:
        # A row that is in `visits` by id and digest is no response; no two originals share a digest, so no key is hot.
        seen = visits.select(F.col("page_id").alias("v_id"), F.col("digest").alias("v_digest")).distinct()
        same = F.col("page_id").eqNullSafe(F.col("v_id")) & (F.col("digest") == F.col("v_digest"))
        sides = keyed.repartition(shards, "page_id", "digest"), seen.repartition(shards, "v_id", "v_digest")
        bodies = sides[0].join(sides[1].hint("shuffle_hash"), same, "left_anti")
    options = {"lineSep": END, "compression": "gzip"}
    bodies.select(_record("response", date).alias("value")).write.options(**options).text(f"{path}/responses")
    visits.select(_record("revisit", date).alias("value")).write.options(**options).text(f"{path}/revisits")


class Archive:
    """Records of one archive from its pieces, which came between double line ends."""

    def __init__(self):
        self.head: bytes | None = None
        self.parts: list[bytes] = []
        self.held = 0
        self.wanted = 0

    def add(self, piece: bytes) -> Iterator[tuple[bytes, bytes]]:
        """Take the next piece; gives a record's head and block once it is whole."""
        if self.head is None:
            self._start(piece)
            return
        self.parts.append(piece)
        self.held += len(piece) + len(END)
        if self.held - len(END) >= self.wanted:
            body = END.encode().join(self.parts)
            yield self.head, body[: self.wanted]
            # A block that ends with a line end is cut early, and the next head comes with the rest.
            self._start(body[self.wanted :])

    def _start(self, piece: bytes) -> None:
        head = piece.lstrip(b"\r\n")
        self.head = head or None
        self.wanted = int(field(head, b"content-length") or 0) if head else 0
        self.parts, self.held = [], 0


def field(head: bytes, name: bytes) -> bytes | None:
    """A header's value, by its lower-case name."""
    for line in head.split(b"\r\n")[1:]:
        key, _, value = line.partition(b":")
        if key.strip().lower() == name:
            return value.strip()
    return None


def _page(record: bytes | None) -> int | None:
    digits = (record or b"").removeprefix(b"<urn:page:").split(b":")[0]
    return int(digits) if digits else None


def _fields(head: bytes, block: bytes, with_payload: bool) -> list:
    message, _, body = block.partition(END.encode())
    kind = field(head, b"warc-type")
    decoded = {name: None if (v := field(head, name)) is None else v.decode() for name in (b"warc-target-uri", b"warc-record-id", b"warc-date")}
    refers = field(head, b"warc-refers-to")
    size = len(body) if kind == b"response" else int(field(message, b"content-length") or 0)
    return [
        _page(field(head, b"warc-record-id")), decoded[b"warc-target-uri"], kind.decode() if kind else None, decoded[b"warc-record-id"],
        (field(head, b"warc-payload-digest") or b"").removeprefix(b"sha1:").decode(), size, _page(refers), refers.decode() if refers else None,
        decoded[b"warc-date"], body if with_payload and kind == b"response" else None,
    ]


def read_records(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Every record of the archives under `path`, as `RECORDS`; payloads only where asked for."""
    raw = spark.read.option("lineSep", END).text([f"{path}/responses", f"{path}/revisits"])
    pieces = raw.select(F.col("value").cast("binary").alias("piece"), F.col("_metadata.file_path").alias("file"))
    names = [f.split(" ")[0] for f in RECORDS.split(", ")]
    text = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, now = Archive(), None
        for batch in batches:
            rows = []
            for piece, file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if file != now:
                    archive, now = Archive(), file
                rows += [_fields(head, block, with_payload) for head, block in archive.add(piece)]
            columns = [pa.array([r[i] for r in rows], text.get(name, pa.string())) for i, name in enumerate(names)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return pieces.mapInArrow(run, RECORDS)


def restored(spark: SparkSession, path: str) -> DataFrame:
    """Every record with its full payload: revisits take that of the record they refer to.

    Revisits of one record are spread over `salt` copies of it, so that a record with very many revisits is no hot key.
    """
    records = written(read_records(spark, path, True), "warc-restored")
    responses, visits = records.where("record_type = 'response'"), records.where("record_type = 'revisit'").drop("payload")
    most = visits.groupBy("refers_to_id").agg(F.count(F.lit(1)).alias("n"))
    copies = most.select(F.col("refers_to_id").alias("id"), F.ceil(F.col("n") / 1000).cast("int").alias("copies"))
    bodies = responses.select(F.col("record_id").alias("id"), "payload").dropDuplicates(["id"])
    dealt = bodies.join(copies, "id").select("id", "payload", "copies", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"))
    salted = visits.join(copies.withColumnRenamed("id", "refers_to_id"), "refers_to_id")
    salted = salted.withColumn("salt", F.pmod(F.xxhash64("record_id"), F.col("copies")).cast("int")).drop("copies")
    full = salted.join(dealt.select(F.col("id").alias("refers_to_id"), "salt", "payload"), ["refers_to_id", "salt"])
    return responses.unionByName(full.select(*responses.columns))


def archive_and_read(pages: DataFrame, identity: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write archives in the shared folder and give what they hold: `page_id, payload_bytes, payload_digest, record_type, refers_to`."""
    path = scratch(pages.sparkSession, "warc")
    write_archives(pages, path, identity, url, payload, least_bytes)
    return read_records(pages.sparkSession, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
