"""Exact and near copies against all pairs."""

import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from modelyard.llm import exact_dedup, ngram_join
from tests.llm.texts import GAPS, documents, equal_texts, groups, row, sentence, shingles


def check_groups(docs, memory):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = Counter()
    for body, members in equal_texts(rows).items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))
        digest = hashlib.sha256(body.encode()).hexdigest()
        for number, text in members:
            want[(number, keep[0], len(members), number == keep[0] and len(text) == len(keep[1]), digest)] += 1
    found = exact_dedup.groups_of(docs, memory=memory).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in found) == want


def test_groups_of_awkward_texts(spark):
    check_groups(documents(spark), 64 << 20)


def test_buckets_are_divided_until_they_fit(spark):
    docs = documents(spark).repartition(5)
    check_groups(docs, 600)
    keys = spark.range(400).select(F.xxhash64("id").alias("h"), F.lit(10).cast("long").alias("bytes"))
    plan = exact_dedup.bucket_plan(keys, 2, 100).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()
    assert sum(r["n"] for r in plan) == 400
    assert all(10 * r["n"] <= 100 for r in plan)


def test_open_addressing_compares_whole_contents():
    table = exact_dedup.ContentTable(4)
    bodies = [str(i).encode() for i in range(200)]
    # One digest for all: only the contents tell them apart.
    assert [table.add(7, b) for b in bodies] == list(range(200))
    assert [table.add(7, b) for b in bodies] == list(range(200))


def test_kept_rows_keep_their_columns(spark):
    docs = documents(spark)
    # The input has a column `dedup` too; the struct is the last one.
    assert exact_dedup.dedup(docs).columns == [*docs.columns, "dedup"]
    out = exact_dedup.dedup(docs, added=None)
    assert out.columns == docs.columns
    rows = [tuple(r) for r in out.collect()]
    texts = [(r[1] or "").translate(GAPS) for r in rows]
    assert len(set(texts)) == len(texts) == len(equal_texts([(r["doc_id"], r["text"]) for r in docs.collect()]))
    assert not set(map(str, rows)) - set(map(str, (tuple(r) for r in docs.collect())))


def test_nothing_in_nothing_out(spark):
    empty = documents(spark, [])
    assert exact_dedup.groups_of(empty).count() == 0
    assert exact_dedup.dedup(empty).count() == 0
    assert ngram_join.components(empty).count() == 0
    assert ngram_join.one_per_group(empty).count() == 0


def test_linked_groups_equal_all_pairs(spark):
    rng = random.Random(5)
    texts = [sentence(rng, rng.choice([3, 6, 12, 40, 80])) for _ in range(25)]
    for _ in range(120):
        words = rng.choice(texts).split(" ")
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(words))
            words[at : at + rng.randint(0, 2)] = [rng.choice("xyz")]
        texts.append(" ".join(words))
    # A passage that many share without being similar, and one large group.
    texts += [texts[0] + " " + sentence(rng, 60) for _ in range(20)] + [texts[1]] * 40
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = ngram_join.components(docs, block_bytes=4000).collect()
    want = groups(rows)
    assert {r["doc_id"]: r["component_id"] for r in found} == want
    assert {r["doc_id"]: r["n_shingles"] for r in found} == {i: len(shingles(t)) for i, t in rows}
    assert len(set(want.values())) < len(want)


def test_awkward_texts_in_the_join(spark):
    docs = documents(spark)
    found = ngram_join.components(docs).collect()
    assert len(found) == docs.count()
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").distinct().collect() if r["doc_id"] is not None]
    want = groups(rows)
    for r in found:
        if r["doc_id"] is not None:
            assert r["component_id"] == want[r["doc_id"]]
    kept = ngram_join.one_per_group(docs)
    assert kept.columns == docs.columns
    ids = Counter(r["doc_id"] for r in kept.select("doc_id").collect())
    assert {i for i in ids if i is not None} == set(want.values())


def test_one_row_of_each_group_with_repeated_and_missing_ids(spark):
    one, two, three, four = ("%s b c d e f g" % w for w in ("one", "two", "three", "four"))
    rows = [row(1, one), row(2, one), row(2, two), row(3, two), row(None, three), row(None, three.upper()), row(4, four), row(4, four), row(None, four)]
    rows += [row(5, ""), row(5, None), row(None, None)]
    kept = ngram_join.one_per_group(documents(spark, rows))
    found = Counter((r["doc_id"], r["text"]) for r in kept.select("doc_id", "text").collect())
    assert found == Counter([(1, one), (2, two), (None, three.upper()), (4, four), (5, ""), (5, None), (None, None)])


def test_a_link_at_exactly_the_threshold(spark):
    # 3 of 4 shingles: 7 words make 3, 8 words make 4.
    docs = spark.createDataFrame([row(2, "a b c d e f g"), row(1, "a b c d e f g h"), row(3, "a b c d e f")], documents(spark, []).schema)
    found = {r["doc_id"]: r["component_id"] for r in ngram_join.components(docs).collect()}
    assert found == groups([(2, "a b c d e f g"), (1, "a b c d e f g h"), (3, "a b c d e f")])
    assert found[2] == 1
