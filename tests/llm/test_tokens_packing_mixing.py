"""Token files, length buckets and replication against exact round trips and brute force."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from modelyard.llm import mixing, packing, token_output
from modelyard.llm.queries import n_tokens
from tests.llm.texts import documents

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path():
    public = pytest.importorskip("public_tokenizers")
    return public.path(TOKENIZER)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.integers(0, 200), st.data())
def test_bits_round_trip_and_random_access(bits, count, data):
    ids = np.array(data.draw(st.lists(st.integers(0, (1 << bits) - 1), min_size=count, max_size=count)), np.uint32)
    payload = token_output.pack(ids, bits)
    assert len(payload) == -(-count // 64) * bits * 8
    first = data.draw(st.integers(0, count))
    size = data.draw(st.integers(0, count - first))
    assert token_output.unpack(payload, bits, first, size).tolist() == ids[first : first + size].tolist()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("ab'sé½9 .,!?_\n\t  ́😀<|>")), max_size=40), max_size=6))
def test_pieces_give_the_ids_of_the_whole_text(texts):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    found = token_output.encoder(tokenizer_path()).encode(texts)
    assert [np.frombuffer(f, np.uint32).tolist() for f in found] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_file_equals_the_library(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    docs = documents(spark)
    path = token_output.scratch(spark, "tokens")
    token_output.write_ids(docs, tokenizer_path(), path, 2, block_ids=500)
    found = token_output.read_documents(spark, path).orderBy("start").collect()
    rows = docs.select("doc_id", "text").collect()
    want = Counter()
    for r in rows:
        ids = plain.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        want[(r["doc_id"], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found) == want
    assert [r["start"] for r in found] == [0, *np.cumsum([r["n_tokens"] for r in found])[:-1].tolist()]
    order = [-1 if r["doc_id"] is None else r["doc_id"] for r in found]
    assert order == sorted(order)
    some = found[3]
    part = token_output.read_range(spark, path, some["start"], some["n_tokens"]).orderBy("position").collect()
    assert zlib.crc32(np.array([r["id"] for r in part], "<u4").tobytes()) == some["ids_crc32"]


def test_a_literal_mark_is_the_librarys_own_id():
    from tokenizers import Tokenizer

    texts = ["hello <|endoftext|> there", "<|endoftext|>", "a <|endoftext|>", "plain words", "< |endoftext|>"]
    plain = Tokenizer.from_file(tokenizer_path())
    found = [np.frombuffer(f, np.uint32).tolist() for f in token_output.encoder(tokenizer_path()).encode(texts)]
    assert found == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert 50256 in found[0] and len(found[0]) == 4


def test_time_does_not_depend_on_the_words_seen():
    import time

    own = token_output.Encoder(tokenizer_path())
    word = lambda n: "".join("abcdefghij"[int(d)] for d in str(n))
    texts = [[f"{word(7000 * i + j)}x and y{word(7000 * j + i)}, words." for i in range(500)] for j in range(40)]
    times = []
    for batch in texts:
        began = time.perf_counter()
        own.encode(batch)
        times.append(time.perf_counter() - began)
    assert len(own.known) > 30_000 and sum(times[-10:]) < 4 * sum(times[1:11])


def test_token_file_of_nothing(spark):
    assert token_output.encode_and_read(documents(spark, []), tokenizer_path(), 2).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 9), min_size=1, max_size=8), st.integers(1, 4))
def test_boundaries_have_the_least_padding(lengths, buckets):
    tops = sorted(lengths)
    counts = [lengths[t] for t in tops]

    def padding(ends):
        return sum((min(e for e in ends if e >= t) - t) * n for t, n in zip(tops, counts))

    choices = [c + (tops[-1],) for k in range(min(buckets, len(tops))) for c in itertools.combinations(tops[:-1], k)]
    found = packing.best_boundaries(np.array(tops), np.array(counts), np.array(tops) * np.array(counts), buckets)
    assert len(found) <= buckets
    assert padding(found) == min(map(padding, choices))


def test_batches_hold_every_document_within_the_budget(spark):
    docs = documents(spark)
    rows = packing.pack(docs, n_tokens(F.col("text")), buckets=4, budget=1000).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in docs.select("doc_id").collect())
    sizes = Counter((r["bucket"], r["batch"]) for r in rows)
    boundary = {r["bucket"]: r["boundary"] for r in rows}
    assert all(r["padding"] == r["boundary"] - r["n_tokens"] >= 0 for r in rows)
    for bucket, end in boundary.items():
        held = [sizes[k] for k in sorted(sizes) if k[0] == bucket]
        full = max(1, 1000 // end)
        assert [k[1] for k in sorted(sizes) if k[0] == bucket] == list(range(len(held)))
        assert all(h == full for h in held[:-1]) and held[-1] <= full


def test_packing_and_mixing_of_nothing(spark):
    empty = documents(spark, [])
    assert packing.pack(empty, n_tokens(F.col("text"))).count() == 0
    assert mixing.replicate(empty).count() == 0


@pytest.mark.parametrize("mean", [0.0, 0.01, 0.7, 3.0, 40.0, 900.0])
def test_poisson_quantile(spark, mean):
    uniforms = [i / 50 for i in range(50)]
    rows = spark.createDataFrame([(u,) for u in uniforms], "u double")
    found = [r["k"] for r in rows.select("u", mixing.poisson_count(F.lit(mean), F.col("u")).alias("k")).orderBy("u").collect()]

    def quantile(u):
        k, log, total = 0, -mean, math.exp(-mean)
        while total <= u:
            k += 1
            log += math.log(mean) - math.log(k)
            total += math.exp(log)
        return k

    assert found == [quantile(u) if mean else 0 for u in uniforms]


def test_copies_follow_rates_and_keep_columns(spark):
    docs = documents(spark)
    assert mixing.replicate(docs, added=None).columns == docs.columns
    docs = docs.drop("mix")
    out = mixing.replicate(docs, weights={"web": 3.0, "hot": 1.0})
    assert out.columns == [*docs.columns, "mix"]
    rows = out.select("doc_id", "source", F.col("mix.copies").alias("times"), F.col("mix.copy").alias("copy"), F.col("mix.shuffle_key").alias("at")).collect()
    assert {r["source"] for r in rows} <= {"web", "hot"}
    assert [r["at"] for r in rows] == sorted(r["at"] for r in rows)
    repeated = Counter(r["doc_id"] for r in docs.where("source IN ('web', 'hot')").select("doc_id").collect())
    for number, n in Counter(r["doc_id"] for r in rows).items():
        times = {r["times"] for r in rows if r["doc_id"] == number}
        assert len(times) == 1 and n == repeated[number] * times.pop()
    again = mixing.replicate(docs, weights={"web": 3.0, "hot": 1.0}).select("mix.shuffle_key").collect()
    assert [r[0] for r in again] == [r["at"] for r in rows]
