"""Archives, whitening and the manifest against plain versions."""

import base64
import gzip
import hashlib
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from modelyard.llm import merkle, warc, whitening
from modelyard.llm.common import scratch
from modelyard.llm.queries import table
from tests.llm.texts import documents, row

PAGES = "page_id long, url string, html string, digest string, bytes int, target string, payload string, value string"


def page(number, url, html):
    return (number, url, html, "d", 1, "t", "p", "v")


def awkward_pages():
    ends = ["", "\r\n", "\r\n\r\n", "\r\n\r\n\r\n", "\r", "\n", "\r\n\r", "\n\r\n\r\n"]
    rows = [page(100 + i, f"http://a/{i}", f"<p>{i}</p>{end}") for i, end in enumerate(ends)]
    rows += [page(120 + i, f"http://b/{i}", end) for i, end in enumerate(ends)]
    rows += [page(140 + i, f"http://c/{i}", end + "x") for i, end in enumerate(ends)]
    inside = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nHTTP/1.1 200 OK\r\n\r\nq\r\n\r\nb"
    rows += [page(1, "http://x/", inside), page(2, None, None), page(3, "http://x/\r\nContent-Length: 0", ""), page(4, "http://y z/\t", "über 😀")]
    rows += [page(5 + i, f"http://copy/{i}", "same <html>") for i in range(30)] + [page(None, "u", "same <html>"), page(None, None, "lone"), page(None, None, None)]
    rows += [page(34, "http://again/", "same <html>"), page(60, "http://long/", "long line\r\n" * 60_000), (None,) * 8]
    return rows


def told(rows, least=0):
    """What reading the archives must give."""
    body = [(r[0], (r[2] or "").encode()) for r in rows]
    most = {}
    for number, data in body:
        best = most.get(data)
        most[data] = number if best is None else best if number is None else max(best, number)
    out = Counter()
    for number, data in body:
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        first = len(data) < least or most[data] == number
        out[(number, len(data), digest, "response" if first else "revisit", None if first else most[data])] += 1
    return out


@pytest.mark.parametrize("least", [0, 12])
def test_archives_of_awkward_pages(spark, least):
    rows = awkward_pages()
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    found = warc.archive_and_read(pages, least_bytes=least).collect()
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found)
    assert got == told(rows, least)


def test_archives_are_whole_and_give_every_payload_back(spark):
    rows = awkward_pages()
    path = scratch(spark, "test-warc")
    warc.write_archives(spark.createDataFrame(rows, PAGES), path)
    full = warc.restored(spark, path).collect()
    want = Counter(base64.b32encode(hashlib.sha1((r[2] or "").encode()).digest()).decode() for r in rows)
    assert Counter(r["payload_digest"] for r in full) == want
    assert all(base64.b32encode(hashlib.sha1(r["payload"]).digest()).decode() == r["payload_digest"] for r in full)
    urls = {r["page_id"]: r["url"] for r in full}
    assert urls[3] == "http://x/%0D%0AContent-Length:%200" and urls[4] == "http://y%20z/%09" and urls[2] is None
    # A plain reader of the files: heads and blocks by length.
    kinds, ids = Counter(), set()
    for file in Path(path.removeprefix("file:")).rglob("part-*.gz"):
        data = gzip.decompress(file.read_bytes())
        while data:
            assert data.startswith(b"WARC/1.1\r\n")
            head, _, rest = data.partition(b"\r\n\r\n")
            fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
            size = int(fields[b"Content-Length"])
            kinds[fields[b"WARC-Type"]] += 1
            ids.add(fields[b"WARC-Record-ID"])
            assert rest[size : size + 4] == b"\r\n\r\n"
            data = rest[size + 4 :]
    assert sum(kinds.values()) == len(rows) and kinds[b"revisit"] == sum(n for k, n in told(rows).items() if k[3] == "revisit")
    assert len(ids) == len({(r[0], r[2] or "") for r in rows})


def test_no_pages(spark):
    assert warc.archive_and_read(spark.createDataFrame([], PAGES)).count() == 0


def plain_whitening(vectors):
    x = np.floor(np.array(vectors, dtype=float) * 64).astype(np.int64) + 1_000_000
    n = len(x)
    sums = x.sum(axis=0)
    centred = x - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    deviation = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(r, sums)) for r in x]
    return centred, values[::-1], vectors[:, ::-1], deviation


def test_whitening_equals_plain_eigenvectors(spark):
    docs = table(spark, "/root/testdata/sf0.01", "embeddings")
    found = whitening.whiten(docs).collect()
    rows = docs.orderBy("vec_id").collect()
    centred, values, vectors, deviation = plain_whitening([r["embedding"] for r in rows])
    place = {r["vec_id"]: i for i, r in enumerate(rows)}
    got = np.zeros((len(rows), 32))
    for r in found:
        got[place[r["vec_id"]], r["component"] - 1] = r["whitened"]
        assert r["n"] == len(rows) and r["deviation"] == deviation[place[r["vec_id"]]] and r["identity_error"] < 1e-10
        assert abs(r["explained"] / (values[r["component"] - 1] / values.sum()) - 1) < 1e-10
    assert len(found) == 32 * len(rows)
    want = centred @ vectors[:, :32] / np.sqrt(values[:32])
    signs = np.sign((got * want).sum(axis=0))
    assert np.abs(got - want * signs).max() < 1e-8


def test_whitening_leaves_out_what_has_no_place(spark):
    rng = np.random.default_rng(4)
    good = [rng.normal(size=5).tolist() for _ in range(40)]
    # The last column is a copy of the first: rank 4.
    good = [[*v[:4], v[0]] for v in good]
    bad = [None, [1.0, None, 0.0, 0.0, 1.0], [float("nan")] * 5, [float("inf")] * 5, [1.0, 2.0], [], [1e300] * 5]
    schema = "vec_id long, embedding array<double>, x int, n int, component int"
    rows = [(i, v, 1, 1, 1) for i, v in enumerate(good)] + [(100 + i, v, 1, 1, 1) for i, v in enumerate(bad)] + [(None, good[0], 1, 1, 1)]
    found = whitening.whiten(spark.createDataFrame(rows, schema).repartition(3)).collect()
    centred, values, vectors, _ = plain_whitening([*good, good[0]])
    assert {r["component"] for r in found} == {1, 2, 3, 4} and {r["vec_id"] for r in found} == {*range(40), None}
    assert abs(sum(r["explained"] for r in found) / 41 - 1) < 1e-12 and found[0]["n"] == 41
    got = {(r["vec_id"], r["component"]): r["whitened"] for r in found}
    want = centred @ vectors[:, :4] / np.sqrt(values[:4])
    assert max(abs(abs(got[i, c + 1]) - abs(want[i, c])) for i in range(40) for c in range(4)) < 1e-8
    none = spark.createDataFrame([], schema)
    assert whitening.whiten(none).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 1, 1, 1)] * 3, schema)).count() == 0


def test_factor_and_rotations_keep_small_eigenvalues():
    rng = np.random.default_rng(7)
    for d in (1, 2, 7, 30):
        q, _ = np.linalg.qr(rng.normal(size=(d, d)))
        scale = 10.0 ** -np.arange(d)[: min(d, 12)]
        # Graded columns: the smallest eigenvalues are far below the rounding of the largest.
        half = q[:, : len(scale)]
        a = (half * scale) @ half.T
        factor = whitening.pivoted_cholesky(a)
        assert np.abs(factor @ factor.T - a).max() < 1e-15 * d * 4
        values, units = whitening.jacobi(factor)
        assert np.abs(units.T @ units - np.eye(len(values))).max() < 1e-12
        assert np.abs(values[:5] / scale[: len(values)][:5] - 1).max() < 1e-9
    deviation = whitening.Whitening(1 << 31, [5, 7], np.ones(1), np.ones((2, 1)), 1.0).deviations(np.array([[1 << 20, 3], [0, 0]]))
    assert deviation == [None, 5 * 5 + 7 * 7]


def plain_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded root) of each row, by building every level."""

    def digest(parts):
        return hashlib.sha256("".join(parts).encode()).hexdigest()

    def part(value):
        return "-" if value is None else f"{len(str(value).encode())}:{value}"

    def leaf(r, text):
        return digest([part(v) for v in (r[0], r[3], r[2], r[4], text)])

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([digest(out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
        return out

    groups = defaultdict(list)
    for r in rows:
        groups[r[3]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    trees = {}
    for g, members in groups.items():
        members.sort(key=lambda m: m[:3])
        trees[g] = levels([m[2] for m in members])
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    top = levels([trees[g][-1][0] for g in order])
    out = Counter()
    for k, g in enumerate(order):
        for i, (_, _, own, r) in enumerate(groups[g]):
            low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            now = leaf(r, r[1].translate(low)) if changed and r[1] is not None else own
            proof = []
            for tree, place in ((trees[g], i), (top, k)):
                for level in tree[:-1]:
                    run = level[place // 16 * 16 : place // 16 * 16 + 16]
                    at = place % 16
                    proof += run[:at] + run[at + 1 :]
                    now = digest(run[:at] + [now] + run[at + 1 :])
                    place //= 16
            out[(r[0], own, trees[g][-1][0], top[-1][0], digest(proof), now, now == top[-1][0])] += 1
    return out


def audited(docs):
    columns = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return Counter(tuple(r[c] for c in columns) for r in merkle.audit(docs).collect())


def test_manifest_of_awkward_texts(spark):
    docs = documents(spark)
    rows = [tuple(r) for r in docs.collect()]
    assert audited(docs.repartition(4)) == plain_manifest(rows)


def test_manifest_over_many_shards_and_groups(spark, monkeypatch):
    rng = random.Random(9)
    # One group has most rows, many have one; shards cut runs anywhere.
    rows = [row(i, rng.choice(["Aa b", "c", None, ""]) , "en", "hot" if i % 3 else f"g{i % 90}") for i in range(1000)]
    rows += [row(5000 + i, f"T{i}", None, f"single-{i}") for i in range(40)] + [row(None, "X", "en", None)] * 3
    monkeypatch.setattr(merkle, "ROWS_PER_TASK", 30)
    docs = documents(spark, rows)
    assert audited(docs) == plain_manifest(rows)


def test_proofs_are_least_and_lead_to_the_root(spark, monkeypatch):
    monkeypatch.setattr(merkle, "ROWS_PER_TASK", 40)
    docs = documents(spark, [row(i, f"text {i}", "en", "a" if i % 4 else "b") for i in range(700)])
    for r in merkle.proofs(docs).collect():
        assert merkle.fold(r["leaf"], [s["siblings"] for s in r["proof"]], [s["place"] for s in r["proof"]]) == r["root"]
    # 1,000 leaves of 5,000: what a shard lacks is at its two ends, and next to nothing if it holds all.
    assert merkle.missing(0, 5000, 5000) == []
    wanted = merkle.missing(1003, 2003, 5000)
    assert len(wanted) <= 30 * 4 and (0, 1002) in wanted and (0, 1003) not in wanted and (0, 2002) not in wanted
    lone = documents(spark, [row(1, "only")])
    only = merkle.proofs(lone).first()
    assert only["leaf"] == only["subroot"] == only["root"] and only["proof"] == []


def test_no_rows_no_root(spark):
    assert merkle.audit(documents(spark, [])).count() == 0
    assert merkle.proofs(documents(spark, [])).count() == 0


def test_the_check_of_a_digest_in_column_form(spark):
    texts = ["", "a", "über", "x" * 1000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(warc.base32_sha1(F.col("t").cast("binary"))).collect()]
    assert got == [base64.b32encode(hashlib.sha1(t.encode()).digest()).decode() for t in texts]
