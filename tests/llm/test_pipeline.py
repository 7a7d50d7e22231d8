"""The pipeline, stage by stage, against plain versions on the smallest tables."""

import random
from collections import Counter

import corpus_pipeline
from modelyard.llm import quality
from modelyard.llm.common import written
from modelyard.llm.queries import table
from tests.llm.texts import awkward_rows, documents, equal_texts, groups, row, sentence, words

TINY = "/root/testdata/sf0.001"


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_stages(spark):
    docs = table(spark, TINY, "documents")
    columns = docs.columns
    steps = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, TINY)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
            docs = written(docs, f"test-stage-{k}")
        steps.append(docs)
    good, single, lone, copies, packed = steps

    judged = quality.judge(table(spark, TINY, "documents"), table(spark, TINY, "labels")).where("kept").collect()
    assert Counter(i for i, _ in pairs(good)) == Counter(r["doc_id"] for r in judged)

    keep = {min(m, key=lambda x: (-len(x[1]), x[0]))[0] for m in equal_texts(pairs(good)).values()}
    assert {i for i, _ in pairs(single)} == keep and single.count() == len(keep)

    heads = set(groups(pairs(single)).values())
    assert {i for i, _ in pairs(lone)} == heads and lone.count() == len(heads)

    drawn = Counter(i for i, _ in pairs(copies))
    assert set(drawn) <= heads and 0.6 * len(heads) < sum(drawn.values()) < 1.5 * len(heads)

    rows = packed.collect()
    assert Counter(r["doc_id"] for r in rows) == drawn
    length = {i: len(words(t)) + 1 for i, t in pairs(copies)}
    assert all(r["n_tokens"] == length[r["doc_id"]] <= r["boundary"] for r in rows)


def test_run_gives_the_rows_of_the_last_stage(spark):
    out = corpus_pipeline.run(spark, TINY)
    assert out.columns == ["doc_id", "n_tokens", "bucket", "boundary", "batch", "padding"]
    assert out.count() > 0


def test_stages_on_awkward_rows_and_on_none(spark):
    """NULLs, repeated ids, clashing names and long texts go through all stages; without rows nothing comes out."""
    rng = random.Random(8)
    texts = [sentence(rng, 90) for _ in range(4)]
    good = [row(200 + i, t) for i, t in enumerate(texts)] + [row(300 + i, t.replace(" ", "  ")) for i, t in enumerate(texts)]
    good += [row(None, texts[0], None, None), row(200, texts[1], "en", None)]
    for rows, some in ((awkward_rows() + good, True), ([], False)):
        docs = documents(spark, rows)
        columns = docs.columns
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = written(stage(spark, docs, TINY), f"test-awkward-{k}")
            if k < len(corpus_pipeline.STAGES) - 1:
                assert docs.columns == columns
                if k == 0 and some:
                    # Texts of fewer than 50 words fail the base rules, NULL and empty ones among them.
                    assert all(len(words(t)) >= 50 for _, t in pairs(docs))
                if k == 1 and some:
                    assert max(Counter("".join((t or "").split()) for _, t in pairs(docs)).values()) == 1
        assert (docs.count() > 0) == some
