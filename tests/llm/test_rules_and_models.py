"""Quality rules, licences, toxicity, URLs and scoring against plain versions."""

import math
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from modelyard.llm import licenses, lm_scoring, quality, toxicity, url_filter
from modelyard.llm.queries import URL_RULES, table
from tests.llm.texts import WORD, documents, row, words

SMALL = "/root/testdata/sf0.01"


def labels_of(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def base_counts(text):
    body = text or ""
    found = WORD.findall(body)
    windows = Counter(tuple(found[i : i + 3]) for i in range(len(found) - 2))
    covered = {i + d for i in range(len(found) - 2) if windows[tuple(found[i : i + 3])] > 1 for d in range(3)}
    seen, repeated = set(), 0
    for line in body.split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    chars = "".join(found)
    return len(found), len(chars), sum(c in "#*$%&|<>" for c in chars), repeated, len(covered)


def test_base_counts(spark):
    docs = documents(spark)
    found = quality.judge(docs, labels_of(spark)).collect()
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"]) for r in found)
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        n, chars, symbols, lines, repeats = base_counts(r["text"])
        bad = n < 50 or 100 * repeats > 50 * n
        want[(r["doc_id"], n, chars, symbols, lines, repeats, bad, not bad)] += 1
    assert got == want


@pytest.mark.parametrize("k,n,p", [(0, 10, 0.2), (3, 10, 0.2), (2, 500, 0.01), (12, 4000, 0.002)])
def test_binomial_bound_is_exact(spark, k, n, p):
    long = lambda x: F.lit(x).cast("long")
    found = spark.range(1).select(quality.binomial_cdf(long(k), long(n), F.lit(p)).alias("p")).first()["p"]
    share = Fraction(p)
    want = sum(math.comb(n, i) * share**i * (1 - share) ** (n - i) for i in range(k + 1))
    assert found == pytest.approx(float(want), rel=1e-9)


def test_cutoffs_keep_good_documents_and_reject_bad_ones(spark):
    good = " ".join(f"word{i}" for i in range(60))
    bad = good.replace("word", "$$$$$$$$$$$$$$$$$$$$")
    docs = documents(spark, [row(i, good, "en") for i in range(4000)] + [row(9000, bad, "en"), row(9001, bad, "xx"), row(9002, bad, None)])
    labels = labels_of(spark, [(i, 1, 0) for i in range(4000)] + [(9000, None, 0), (None, 1, 1)])
    found = {r["doc_id"]: r["kept"] for r in quality.judge(docs, labels).collect()}
    assert all(found[i] for i in range(4000))
    assert not found[9000]
    # Without good labels nothing is certified, so only the base holds.
    assert found[9001] and found[9002]
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {i for i, k in found.items() if k}


def test_few_labels_certify_nothing(spark):
    good = " ".join(f"word{i}" for i in range(60))
    docs = documents(spark, [row(i, good) for i in range(20)])
    found = quality.judge(docs, labels_of(spark, [(i, 1, 0) for i in range(20)])).collect()
    assert all(r["cutoff_symbol_share"] is None and r["kept"] for r in found)


def test_rules_come_in_the_order_of_what_they_add():
    kinds = [({"repeat_share"}, 5), ({"repeat_share", "upper_share"}, 4), ({"upper_share"}, 3), (set(), 9), ({"repeat_share", "dup_line_share"}, 2)]
    assert quality.useful_order(kinds) == ["repeat_share", "upper_share"]
    assert quality.useful_order([(set(), 3)]) == [] and quality.useful_order([]) == list(quality.RULES)


def test_cutoffs_of_a_stratum_stop_where_good_documents_would_go(spark):
    """Joint risk: 500 good labels of one stratum certify what loses none of them, and no rule that adds nothing is used."""
    good = " ".join(f"word{i}" for i in range(60))
    marked = good + " " + "|" * 40
    shouted = good.upper()
    rows = [row(i, good if i % 20 else shouted) for i in range(500)] + [row(600 + i, marked) for i in range(9)] + [row(700, shouted)]
    labels = [(i, 1, 0) for i in range(500)] + [(600 + i, 0, 0) for i in range(8)] + [(700, 0, 0), (3, None, None)]
    found = quality.judge(documents(spark, rows), labels_of(spark, labels)).collect()
    kept = {r["doc_id"]: r["kept"] for r in found}
    # The marks go. Capitals (0.69 of the characters) would reject the one bad document, but also one good document in twenty, so that rule
    # stays at its last cutoff that loses none.
    assert all(kept[i] for i in range(500)) and kept[700] and not any(kept[600 + i] for i in range(9))
    first = found[0]
    assert first["cutoff_symbol_share"] == 0.05 and first["cutoff_upper_share"] == 0.7 and first["cutoff_dup_line_share"] is None


def test_good_documents_of_the_other_half_are_kept(spark):
    """The given labels, halved: cutoffs from one half reject bad documents of the other and lose at most the risk of the good ones."""
    docs, labels = (table(spark, "/root/testdata/sf0.1", n) for n in ("documents", "labels"))
    half = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    judged = quality.judge(docs, labels.where(half)).where("NOT base_failed").join(labels.where(~half), "doc_id")
    counts = {(r["quality"], r["kept"]): r["count"] for r in judged.groupBy("quality", "kept").count().collect()}
    assert counts.get((0, False), 0) > 50
    assert counts.get((1, False), 0) <= 0.01 * sum(n for (q, _), n in counts.items() if q == 1)


def test_licences(spark):
    whole = "\n".join(licenses.SENTENCES[i] for i in (10, 11, 12, 13))
    cases = {
        1: (whole, "MIT", ""),
        2: ("Licensed under\nthe Apache License, Version 2.0. More text.", "Apache-2.0", ""),
        3: ("licensed   under CC BY 4.0! All rights reserved.", "CC-BY-4.0;Proprietary", ""),
        4: (licenses.SENTENCES[12], "", "<12>"),
        5: ("This talks of a licence and a permission only.", "", ""),
        6: (None, "", ""),
        7: ("", "", ""),
        8: (licenses.SENTENCES[1] + " " + licenses.SENTENCES[1], "MIT", ""),
    }
    docs = documents(spark, [row(i, text) for i, (text, _, _) in cases.items()])
    found = {r["doc_id"]: (r["licences"], r["unmatched"]) for r in licenses.scan(docs).collect()}
    assert found == {i: (names, left) for i, (_, names, left) in cases.items()}
    assert licenses.scan(documents(spark)).count() == documents(spark).count()


BSD = """Copyright 2020 Somebody
All  rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are
met:
1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by the
Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""


@pytest.mark.parametrize("prefix", ["", "    ", "# ", " * ", "// ", ";; ", "-- ", "\t"])
def test_licences_in_indented_and_commented_lines(spark, prefix):
    old_gpl = GPL.replace("software: you", "software; you").replace("Foundation, either version 3", "Foundation; either version 2")
    mit = "The MIT License\n" + "\n\n".join(licenses.SENTENCES[i].replace(", ", ",\n") for i in (10, 11, 12))
    cases = {1: (BSD, "BSD-2-Clause;Proprietary"), 2: (GPL, "GPL-3.0-or-later"), 3: (old_gpl, "GPL-2.0-or-later"), 4: (mit, "MIT")}
    cases |= {5: ("All rights  reserved.", "Proprietary"), 6: ("released into the public\tdomain.", ""), 7: ("Title\nLicensed under\n\nthe MIT License.", "")}
    lined = {i: "\r\n".join((prefix + line).rstrip() if i % 2 else prefix + line for line in text.split("\n")) for i, (text, _) in cases.items()}
    for ends in ("\n", "\r\n"):
        docs = documents(spark, [row(i, text.replace("\r\n", ends)) for i, text in lined.items()])
        found = {r["doc_id"]: (r["licences"], r["unmatched"]) for r in licenses.scan(docs).collect()}
        assert found == {i: (names, "") for i, (_, names) in cases.items()}


def test_every_known_sentence_has_a_cue():
    assert all(any(c in s for c in licenses.CUE_WORDS) for s in licenses.known_sentences())


def test_toxicity_on_held_out_labels(spark):
    labels = table(spark, SMALL, "labels")
    scored = toxicity.score(table(spark, SMALL, "documents"), labels)
    rows = scored.join(labels, "doc_id").where("held_out AND toxic IS NOT NULL").collect()
    positives = [r["score"] for r in rows if r["toxic"] == 1]
    negatives = [r["score"] for r in rows if r["toxic"] == 0]
    auc = np.mean([(p > n) + (p == n) / 2 for p in positives for n in negatives])
    assert auc > 0.9
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


def test_identity_terms_get_no_weight_of_their_own(spark):
    rows, labels = [], []
    for i in range(400):
        toxic = i % 2
        # Insults come with one group only, so a plain model would learn the group.
        rows.append(row(i, f"awful stupid idiot muslim filler{i % 7}" if toxic else f"kind friendly neighbour christian filler{i % 7}"))
        labels.append((i, 1, toxic))
    rows += [row(1000, "a muslim baker"), row(1001, "a christian baker")]
    docs = documents(spark, rows)
    gap = {}
    for fairness in (0.0, 10.0):
        found = {r["doc_id"]: r["score"] for r in toxicity.score(docs, labels_of(spark, labels), fairness=fairness).collect()}
        gap[fairness] = found[1000] - found[1001]
        assert found[1] > 0.9 and found[0] < 0.1
    assert gap[10.0] < 0.2 * gap[0.0]


def test_toxicity_of_awkward_rows(spark):
    docs = documents(spark)
    for labels in ([], [(1, 1, 1)], [(1, 1, 0), (None, None, None)], [(i, 1, i % 2) for i in range(50)]):
        rows = toxicity.score(docs, labels_of(spark, labels)).collect()
        assert len(rows) == docs.count()
        assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert toxicity.score(documents(spark, []), labels_of(spark)).count() == 0


def test_urls(spark):
    words_of_pages = "<p>" + "river bank garden river bank house " * 20 + "</p>"
    rows = [(i, f"https://riverbank.example.com/en/{i}", words_of_pages) for i in range(20)]
    rows += [(100 + i, f"http://gardenhouse.org.net/es/{i}", None) for i in range(20)]
    rows += [
        (200, "HTTP://WWW.Example.COM/en/x?q=://a/b", ""),
        (201, "https://example.com", ""),
        (202, "no scheme", None),
        (203, None, None),
        (204, "x://notexample.com#/en/", ""),
        (205, "x://gardenhouse.org/es/1", ""),
        (205, "x://gardenhouse.org/es/1", ""),
        (None, "", ""),
    ]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, verdict string")
    found = url_filter.judge(pages, URL_RULES).collect()
    assert len(found) == len(rows)
    by = {r["page_id"]: r for r in found}
    assert all(by[i]["rule"] == "example.com/en/" and by[i]["verdict"] == "block" for i in range(20))
    assert by[0]["host_words"] == "river bank example com"
    assert all(by[100 + i]["rule"] == "net/es/" for i in range(20))
    assert (by[200]["host"], by[200]["path"], by[200]["rule"]) == ("www.example.com", "/en/x", "www.example.com/en/")
    assert (by[201]["host"], by[201]["path"], by[201]["rule"]) == ("example.com", "", None)
    assert [(by[i]["host"], by[i]["path"], by[i]["rule"]) for i in (202, 203, None)] == [("", "", None)] * 3
    assert (by[204]["host"], by[204]["path"]) == ("notexample.com", "")
    assert by[205]["rule"] is None and by[205]["verdict"] == "block"
    assert url_filter.judge(pages.limit(0), URL_RULES).count() == 0


def test_rare_words_split_hosts(spark):
    letters = "abcdefghijklmnopqrst"
    common = ["x" + "".join(letters[i // 20**k % 20] for k in range(4)) for i in range(60_000)]
    rows = [(1, "x://quokkawombat.org/", " ".join(common + common)), (2, None, "quokka wombat")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r["page_id"]: r["host_words"] for r in url_filter.judge(pages, URL_RULES).collect()}
    assert found == {1: "quokka wombat org", 2: ""}


def test_tokens_are_counted_apart(spark):
    place = {}
    for i in range(100_000):
        name = "".join(chr(97 + int(d)) for d in str(i))
        other = place.setdefault(zlib.crc32(f"p{name}".encode()) % (1 << 16), name)
        if other != name:
            break
    urls = [f"http://net/es/{other}"] * 30 + [f"http://com/{name}"] * 30 + [f"http://a/{other}", f"http://a/{name}"]
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id long, url string, html string")
    found = {r["page_id"]: r for r in url_filter.judge(pages, URL_RULES).collect()}
    assert found[60]["block_score"] - found[61]["block_score"] == pytest.approx(2 * math.log(31))
    assert (found[60]["verdict"], found[61]["verdict"]) == ("block", "allow")


def test_segmentation_finds_the_likeliest_split():
    counts = {"a": 5, "ab": 3, "b": 4, "ba": 2, "bab": 6}
    segmenter = url_filter.Segmenter(counts, 100)

    def cost(parts):
        return sum(segmenter.cost.get(p, math.log(100) + math.log(10) * len(p)) for p in parts)

    for name in ("abab", "babab", "aab", "abcab"):
        cuts = range(1 << (len(name) - 1))
        splits = [re.sub("(.)", r"\1", "".join(c + (" " if i < len(name) - 1 and m >> i & 1 else "") for i, c in enumerate(name))).split() for m in cuts]
        assert cost(segmenter.split(name)) == pytest.approx(min(map(cost, splits)))


def test_bayes_scores_equal_plain_counts(spark):
    pages = table(spark, SMALL, "pages")
    found = {r["page_id"]: r for r in url_filter.judge(pages, URL_RULES).collect()}
    counts = {"allow": Counter(), "block": Counter()}
    urls = Counter()
    tokens = {}
    bins = 1 << 16
    for r in found.values():
        parts = ["#" if t[0].isdigit() else t for t in re.findall("[a-z]+|[0-9]+", r["path"].lower())]
        tokens[r["page_id"]] = [zlib.crc32(("h" + w).encode()) % bins for w in r["host_words"].split()] + [zlib.crc32(("p" + w).encode()) % bins for w in parts]
        if r["rule"]:
            counts[r["verdict"]].update(tokens[r["page_id"]])
            urls[r["verdict"]] += 1
    totals = {v: sum(c.values()) + bins for v, c in counts.items()}
    for number, r in found.items():
        score = math.log((urls["block"] + 0.5) / (urls["allow"] + 1))
        for t in tokens[number]:
            score += math.log((counts["block"][t] + 1) / totals["block"]) - math.log((counts["allow"][t] + 1) / totals["allow"])
        assert r["block_score"] == pytest.approx(score, abs=1e-6)
        if not r["rule"]:
            assert r["verdict"] == ("block" if score > 0 else "allow")


def test_scoring_equals_plain_counts(spark):
    docs = documents(spark)
    rows = docs.select("doc_id", "text").collect()
    fold = [zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 7 for r in rows]
    token_lists = [[w.encode() for w in words(r["text"])] + [None] for r in rows]
    grams = {part: [Counter(), Counter(), Counter()] for part in ("train", "deleted")}
    for f, tokens in zip(fold, token_lists):
        if f != 2:
            padded = ["<s>", "<s>", *tokens]
            for n in (1, 2, 3):
                grams["deleted" if f == 3 else "train"][n - 1].update(tuple(padded[i - n + 1 : i + 1]) for i in range(2, len(padded)))
    starts = {"train": sum(f not in (2, 3) for f in fold), "deleted": sum(f == 3 for f in fold)}
    full = [a + b for a, b in zip(grams["train"], grams["deleted"])]
    total, size = sum(full[0].values()), len(full[0])

    def places(tokens, counts, documents):
        lists = [np.array([c[tuple(["<s>", "<s>", *tokens][i - n + 1 : i + 1])] for i in range(2, len(tokens) + 2)], float) for n, c in enumerate(counts, 1)]
        return lm_scoring.estimates(lists, np.array([len(tokens)]), float(sum(counts[0].values())), documents, size)

    held = [places(t, grams["train"], starts["train"]) for f, t in zip(fold, token_lists) if f == 3]
    chosen = np.concatenate([c for _, c in held])
    values = np.concatenate([v for v, _ in held], axis=1)
    codes, at = np.unique(lm_scoring.cell_codes(values, chosen), return_inverse=True)
    sizes = np.bincount(at).astype(float)
    means = np.stack([np.bincount(at, weights=v) / sizes for v in values])
    weights = lm_scoring.learned_weights(codes // lm_scoring.LEVELS**3, sizes, means, 1 + 2 * lm_scoring.DOUBLINGS)
    assert weights.sum(axis=1) == pytest.approx(1)
    want = Counter()
    for r, f, tokens in zip(rows, fold, token_lists):
        base = sum(math.log10((full[0][(t,)] + 1) / (total + size + 1)) for t in tokens)
        values, chosen = places(tokens, full, sum(starts.values()))
        score = np.log10((weights[chosen].T * values).sum(axis=0)).sum()
        known = sum(full[0][(t,)] > 0 for t in tokens)
        want[(r["doc_id"], f == 2, len(tokens), known, total, f"{base:.6g}", f"{score:.6g}")] += 1
    found = lm_scoring.score(docs).collect()
    got = Counter((*tuple(r)[:5], f"{r['base_score']:.6g}", f"{r['score']:.6g}") for r in found)
    assert got == want


def test_scoring_of_nothing(spark):
    assert lm_scoring.score(documents(spark, [])).count() == 0
