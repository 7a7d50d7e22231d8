"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Base rules are fixed. Above them, each ratio rule may reject a document whose ratio is over a cutoff, and the cutoffs are chosen
together so that few good documents are lost, with a guarantee. The candidates are vectors of cutoffs in one sequence from lenient to
strict: first comes the rule whose strictest cutoff rejects most labelled bad documents, then the one that rejects most of the rest
(ties by the order of `RULES`), until no rule rejects any more (without bad labels all rules in their order); each is tightened step by step to its strictest cutoff before the next
one begins, and rules that add nothing are not used. The sequence depends on bad documents only, so the good ones of the holdout are untouched when it is tested: in every stratum a vector is accepted when the exact binomial
test rejects "these cutoffs together lose more than `risk` of the good documents" at the level `error` / strata, and all before
it were. Losses only grow along the sequence, so within a stratum no further correction is needed; across strata it is Bonferroni's.
With probability 1 - `error` over the labels no stratum loses more than `risk` of its good documents to the accepted cutoffs.

Defined results: a NULL text has no words and fails the base. A NULL stratum is a stratum of its own. A stratum without good
labels, or with fewer than ln(`error` / strata) / ln(1 - `risk`) of them (436 for four strata by default), has no cutoff and only
the base rules hold there. Labels that are NULL or contradict each other for one id count as neither good nor bad. Repeated rows are
judged each for itself. An empty table gives an empty result.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from modelyard.llm.common import SPACES, UPPER, join_small, let, renamed, word_array, written
from modelyard.session import cut_lineage

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
# A ratio rule rejects above a cutoff; candidates go from lenient to strict.
RULES: dict[str, tuple[float, ...]] = {
    "symbol_share": (0.60, 0.50, 0.40, 0.30, 0.25, 0.20, 0.15, 0.10, 0.05),
    "dup_line_share": (0.90, 0.80, 0.70, 0.60, 0.50, 0.40, 0.30, 0.20, 0.10),
    "repeat_share": (0.48, 0.45, 0.40, 0.35, 0.30, 0.25, 0.20, 0.15, 0.10),
    "long_word_share": (0.90, 0.80, 0.70, 0.60, 0.50, 0.40, 0.30, 0.20, 0.10),
    "upper_share": (0.90, 0.80, 0.70, 0.60, 0.50, 0.40, 0.30, 0.20, 0.10),
}


@dataclass(frozen=True)
class Risk:
    """At most `risk` of a stratum's good documents may be lost, but for a chance of `error` over all strata."""

    risk: float = 0.01
    error: float = 0.05


def repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more; windows are compared by 64-bit hashes within the text."""

    def covered(windows: Column) -> Column:
        placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            same = lambda x, other: F.coalesce(x["h"] == other["h"], F.lit(False))
            twice = F.transform(
                s, lambda x, j: F.when(same(x, F.get(s, j - 1)) | same(x, F.get(s, j + 1)), x["i"]).otherwise(F.lit(-1))
            )
            return F.array_sort(F.filter(twice, lambda i: i >= 0))

        def length(at: Column) -> Column:
            gaps = F.transform(at, lambda i, j: F.least(F.lit(3), F.coalesce(i - F.get(at, j - 1), F.lit(3))))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

        some = F.size(F.array_distinct(windows)) < F.size(windows)
        return F.when(some, let(let(placed, starts), length)).otherwise(F.lit(0).cast("long"))

    places = F.sequence(F.lit(0), F.size(words) - 3)
    windows = F.transform(places, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) >= 4, let(windows, covered)).otherwise(F.lit(0).cast("long"))


def signals(text: Column) -> dict[str, Column]:
    """Three structs with the counts that all rules are made of: of words, of characters, of lines."""
    body = F.coalesce(text, F.lit(""))
    wordy = F.filter(F.split(body, "\n"), lambda line: F.length(F.translate(line, SPACES, "")) > 0)
    return {
        "_words": let(
            word_array(text),
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                repeated_words(w).alias("n_repeat_words"),
                F.size(F.filter(w, lambda x: F.length(x) > 20)).cast("long").alias("n_long_words"),
            ),
        ),
        "_chars": let(
            F.translate(body, SPACES, ""),
            lambda s: F.struct(
                F.length(s).cast("long").alias("word_chars"),
                (F.length(s) - F.length(F.translate(s, SYMBOLS, ""))).cast("long").alias("n_symbols"),
                (F.length(s) - F.length(F.translate(s, UPPER, ""))).cast("long").alias("n_upper"),
            ),
        ),
        "_lines": let(
            wordy,
            lambda lines: F.struct(
                F.size(lines).cast("long").alias("n_lines"),
                (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            ),
        ),
    }


COUNTS = [
    ("_words", "n_words"),
    ("_chars", "word_chars"),
    ("_chars", "n_symbols"),
    ("_lines", "n_dup_lines"),
    ("_words", "n_repeat_words"),
    ("_lines", "n_lines"),
    ("_words", "n_long_words"),
    ("_chars", "n_upper"),
]


def with_signals(rows: DataFrame, text: str) -> DataFrame:
    """Add the counts of `COUNTS` and `base_failed`; each text is read once."""
    # Three columns and not one struct of them: the optimiser would put a struct's parts in place of every use.
    rows = rows.withColumns(signals(F.col(text)))
    rows = rows.withColumns({name: F.col(f"{part}.{name}") for part, name in COUNTS}).drop("_words", "_chars", "_lines")
    return rows.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def ratios() -> dict[str, Column]:
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {
        "symbol_share": share("n_symbols", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "long_word_share": share("n_long_words", "n_words"),
        "upper_share": share("n_upper", "word_chars"),
    }


def binomial_cdf(k: Column, n: Column, p: Column) -> Column:
    """P(at most k of n), exact, summed in logs."""
    first = n * F.log(1 - p)
    odds = F.log(p) - F.log(1 - p)

    def step(state: Column, i: Column) -> Column:
        log = state["log"] + F.log((n - i + 1) / i) + odds
        return F.struct(log.alias("log"), (state["sum"] + F.exp(log)).alias("sum"))

    start = F.struct(first.alias("log"), F.exp(first).alias("sum"))
    more = F.aggregate(F.sequence(F.lit(1).cast("long"), k), start, step, lambda s: s["sum"])
    return F.when(k < 1, F.exp(first)).otherwise(more)


def sequence(order: list[str]) -> list[tuple[str, float]]:
    """The steps of the cutoff vectors: a step tightens one rule, and all rules before it are at their strictest."""
    return [(rule, cut) for rule in order for cut in RULES[rule]]


def useful_order(kinds: list[tuple[set[str], int]]) -> list[str]:
    """Rules by the documents that each adds to those before it; `kinds` are the rules that reject a document, and how many are so.

    Without any labelled bad document there is nothing to choose by, and all rules take part in their own order.
    """
    order: list[str] = [] if kinds else list(RULES)
    while True:
        rest = [(rules, n) for rules, n in kinds if not rules.intersection(order)]
        adds = {rule: sum(n for rules, n in rest if rule in rules) for rule in RULES}
        best = max(RULES, key=lambda rule: adds[rule])
        if not adds[best]:
            return order
        order.append(best)


def cutoffs(measured: DataFrame, labels: DataFrame, risk: Risk) -> DataFrame:
    """Per stratum the strictest certified cutoff of each rule (NULL: none).

    `measured` has `_id`, `_stratum` and the counts; `labels` has an id and a quality of 1 for good.
    """
    ratio = ratios()
    ends = F.min("_good").alias("_good"), F.max("_good").alias("_top"), F.count("_good").alias("_k")
    told = labels.groupBy("_label_id").agg(*ends).where("_k > 0 AND _good = _top").select("_label_id", "_good")
    seen = measured.where(~F.col("base_failed")).join(told, F.col("_id") == F.col("_label_id"))
    # Labelled rows only, and only their counts.
    seen = written(seen.select("_stratum", "_good", *[name for _, name in COUNTS]), "quality-labelled")
    strictest = {rule: ratio[rule] > cuts[-1] for rule, cuts in RULES.items()}
    # At most 2^rules rows: which rules reject a bad document at their strictest.
    kinds = seen.where("_good = 0").groupBy(*[v.alias(r) for r, v in strictest.items()]).agg(F.count(F.lit(1)).alias("_n")).collect()
    order = useful_order([({r for r in RULES if kind[r]}, kind["_n"]) for kind in kinds])
    steps = sequence(order)
    before = F.lit(False)
    lost = []
    for rule in order:
        lost += [(before | (ratio[rule] > cut)).cast("long") for cut in RULES[rule]]
        before = before | strictest[rule]
    sums = [F.sum(v).alias(f"lost_{i}") for i, v in enumerate(lost)]
    table = cut_lineage(seen.where("_good = 1").groupBy("_stratum").agg(F.count(F.lit(1)).alias("good"), *sums))
    share, level = F.lit(risk.risk), F.lit(risk.error / max(1, table.count()))
    # The losses never fall along the sequence, so the steps that pass are the first ones. Above the allowed share itself no
    # test can reject; this also bounds the sum.
    losses = F.array(*[F.col(f"lost_{i}") for i in range(len(steps))]).cast("array<long>")
    passed = F.filter(losses, lambda k: F.when(k < share * F.col("good"), binomial_cdf(k, F.col("good"), share) <= level).otherwise(F.lit(False)))
    table = table.withColumn("_steps", F.size(passed))
    picks = []
    for rule in RULES:
        choice = F.lit(None).cast("double")
        for i, (own, cut) in enumerate(steps):
            if own == rule:
                choice = F.when(F.col("_steps") > i, F.lit(float(cut))).otherwise(choice)
        picks.append(choice.alias(f"_cut_{rule}"))
    return table.select(F.col("_stratum").alias("_cut_stratum"), F.col("good").alias("_good_labels"), *picks)


def judged(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """Add `kept`: base passed, and no certified cutoff is exceeded."""
    joined = join_small(measured, limits, F.col("_stratum").eqNullSafe(F.col("_cut_stratum")))
    over = F.lit(False)
    for rule, value in ratios().items():
        over = over | F.coalesce(value > F.col(f"_cut_{rule}"), F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & ~over)


def _labels(labels: DataFrame, identity: str, quality: str) -> DataFrame:
    return labels.select(F.col(f"`{identity}`").alias("_label_id"), (F.col(f"`{quality}`") == 1).cast("int").alias("_good"))


def judge(
    docs: DataFrame, labels: DataFrame, identity="doc_id", text="text", stratum="lang", quality="quality", risk: Risk = Risk()
) -> DataFrame:
    """One row per document: `doc_id`, the counts, `base_failed`, `kept` and the cutoffs that held for it."""
    lean = docs.select(F.col(f"`{identity}`").alias("_id"), F.col(f"`{stratum}`").alias("_stratum"), F.col(f"`{text}`").alias("_text"))
    measured = written(with_signals(lean, "_text").drop("_text"), "quality-signals")
    limits = cutoffs(measured, _labels(labels, identity, quality), risk)
    out = judged(measured, limits)
    return out.select(
        F.col("_id").alias("doc_id"), *[name for _, name in COUNTS], "base_failed", "kept", *[F.col(f"_cut_{r}").alias(f"cutoff_{r}") for r in RULES]
    )


def keep_good(
    docs: DataFrame, labels: DataFrame, identity="doc_id", text="text", stratum="lang", quality="quality", risk: Risk = Risk()
) -> DataFrame:
    """The documents that are kept, with all their columns.

    The counts are made once and written beside the rows, so the fit reads narrow columns of them, and the verdict needs no shuffle of texts.
    """
    rows, names = renamed(docs)
    at = {c: f"c{docs.columns.index(c)}" for c in (identity, text, stratum)}
    rows = rows.withColumns({"_id": F.col(at[identity]), "_stratum": F.col(at[stratum])})
    rows = written(with_signals(rows, at[text]), "quality-rows")
    limits = cutoffs(rows.select("_id", "_stratum", "base_failed", *[name for _, name in COUNTS]), _labels(labels, identity, quality), risk)
    out = judged(rows, limits).where("kept")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
