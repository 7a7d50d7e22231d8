"""URL filtering with segmented host names.

Rules come first: the longest rule that fits a URL decides. Other URLs are judged by multinomial naive Bayes over the words of the
host and the path. Host labels are often names run together ("tionsh"), so each is split into words by unigram Viterbi: the split
with the largest product of word probabilities, with counts from the visible text of all pages. The Bayes counts come from
all URLs that a rule decides.

Nothing is cut from the counts: each distinct host label is joined with the counts of exactly those of its pieces that are words,
and each distinct sequence of tokens with the exact weights of its tokens. The tables made of words, labels, hosts and tokens stay in
Spark. Laplace's rule is taken over `vocabulary` tokens.

Defined results: a URL that is NULL or has no `://` has an empty host and path and no rule. If rules decide nothing, or only one way,
the prior decides (allow when nothing is known). Rows that repeat an id are judged each. NULL pages add no words. An empty
table gives an empty result.
"""

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from modelyard.llm.common import join_small, written

UPPER_TO_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
MARKUP = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.S | re.I)
LETTERS = re.compile(r"[a-z]{1,20}(?![a-z])")
TOKEN = re.compile(r"[a-z]+|[0-9]+")
LONGEST = 20
PARSED = "page_id long, host string, path string, rule string, decided string, parts string"


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without `://`."""
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    path = re.split(r"[?#]", rest[end:], maxsplit=1)[0]
    return rest[:end].translate(UPPER_TO_LOWER), path


class Rules:
    """Host and path-prefix rules; the longest that fits wins."""

    def __init__(self, rules: Iterable[tuple[str, str]]):
        ordered = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
        self.rules = [(verdict, text, *self._parts(text)) for verdict, text in ordered]

    @staticmethod
    def _parts(text: str) -> tuple[str, str]:
        host, slash, path = text.partition("/")
        return host, slash + path

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        """The rule's text and verdict."""
        for verdict, text, own, prefix in self.rules:
            if path.startswith(prefix) and (host == own or host.endswith("." + own)):
                return text, verdict
        return None, None


class Segmenter:
    """Unigram Viterbi over a lexicon of log probabilities."""

    def __init__(self, counts: dict[str, int], total: int):
        self.total = max(1, total)
        self.cost = {w: -math.log(n / self.total) for w, n in counts.items()}
        self.seen: dict[str, list[str]] = {}

    def split(self, name: str) -> list[str]:
        if name not in self.seen:
            if len(self.seen) > 100_000:
                self.seen = {}
            self.seen[name] = self._split(name)
        return self.seen[name]

    def _split(self, name: str) -> list[str]:
        best, back = [0.0], [0]
        unknown = math.log(self.total)
        for end in range(1, len(name) + 1):
            options = []
            for start in range(max(0, end - LONGEST), end):
                piece = name[start:end]
                # An unknown word is rarer than any known one, the more so the longer it is.
                cost = self.cost.get(piece, unknown + math.log(10) * len(piece))
                options.append((best[start] + cost, start))
            cost, start = min(options)
            best.append(cost)
            back.append(start)
        words, end = [], len(name)
        while end:
            words.append(name[back[end] : end])
            end = back[end]
        return words[::-1]


def path_tokens(path: str) -> list[str]:
    """Tokens of the path, with numbers as one token."""
    return ["#" if t[0].isdigit() else t for t in TOKEN.findall(path.translate(UPPER_TO_LOWER))]


def word_counts(pages: DataFrame, html: str) -> DataFrame:
    """`word, n` over the visible text of all pages; each partition adds up its own first, in bounded pieces."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for body in batch.column(0).to_pylist():
                counts.update(LETTERS.findall(MARKUP.sub(" ", body or "").translate(UPPER_TO_LOWER)))
            if len(counts) > 500_000:
                yield pa.RecordBatch.from_pydict({"word": list(counts), "n": pa.array(counts.values(), pa.int64())})
                counts = Counter()
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.string()), "n": pa.array(counts.values(), pa.int64())})

    return pages.select(F.col(f"`{html}`")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def segmented(labels: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """`run, words`: each label of `run` split into words, from the counts of exactly its own pieces."""
    # Pieces carry a number and not the label, so that a long label is not repeated for each of them.
    labels = written(labels.withColumn("_label", F.monotonically_increasing_id()), "url-labels")
    starts = labels.select("_label", "run", F.explode(F.sequence(F.lit(1), F.length("run"))).alias("start"))
    ahead = starts.select("_label", F.expr(f"substring(run, start, {LONGEST})").alias("ahead"))
    pieces = ahead.select("_label", F.explode(F.transform(F.sequence(F.lit(1), F.length("ahead")), lambda k: F.left("ahead", k))).alias("word"))
    known = pieces.join(counts, "word").groupBy("_label").agg(F.collect_set(F.struct("word", "n")).alias("known"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            own = [{e["word"]: e["n"] for e in known or ()} for known in batch.column(1).to_pylist()]
            split = [" ".join(Segmenter(k, total).split(name)) for name, k in zip(names, own)]
            yield pa.RecordBatch.from_pydict({"run": batch.column(0), "words": pa.array(split, pa.string())})

    return labels.join(known, "_label", "left").select("run", "known").mapInArrow(run, "run string, words string")


def tokens_of(kind: str, sequence: Column) -> Column:
    """The tokens of a sequence written with spaces, each with the kind before it."""
    return F.transform(F.filter(F.split(sequence, " "), lambda t: t != ""), lambda t: F.concat(F.lit(kind), t))


def token_weights(rows: DataFrame, vocabulary: int) -> tuple[DataFrame, float, float]:
    """`token, weight` from the URLs that a rule decides, the weight of a token that none of them has, and the prior."""
    ruled = rows.where("decided IS NOT NULL").select((F.col("decided") == "block").cast("long").alias("block"), "names", "parts")
    tokens = ruled.select("block", F.explode(F.concat(tokens_of("h", F.col("names")), tokens_of("p", F.col("parts")))).alias("token"))
    counts = written(tokens.groupBy("token").agg(F.sum("block").alias("block"), F.sum(1 - F.col("block")).alias("allow")), "url-tokens")
    urls = ruled.agg(F.count(F.lit(1)).alias("n"), F.sum("block").alias("block")).first()
    block = urls["block"] or 0
    sums = counts.agg(F.sum("block").alias("block"), F.sum("allow").alias("allow")).first()
    over, under = math.log((sums["block"] or 0) + vocabulary), math.log((sums["allow"] or 0) + vocabulary)
    weight = (F.log(F.col("block") + 1) - over) - (F.log(F.col("allow") + 1) - under)
    return counts.select("token", weight.alias("weight")), under - over, math.log((block + 0.5) / (urls["n"] - block + 1.0))


def sequence_scores(rows: DataFrame, weights: DataFrame, unseen: float) -> DataFrame:
    """`sequence, score` of all distinct sequences of tokens that are not empty; the sum goes from first to last."""
    kinds = [rows.select(F.lit(kind).alias("kind"), F.col(name).alias("sequence")) for kind, name in (("h", "names"), ("p", "parts"))]
    found = kinds[0].unionByName(kinds[1]).where("sequence <> ''").distinct()
    found = written(found.withColumn("_sequence", F.monotonically_increasing_id()), "url-sequences")
    tokens = F.when(F.col("kind") == "h", tokens_of("h", F.col("sequence"))).otherwise(tokens_of("p", F.col("sequence")))
    placed = found.select("_sequence", F.posexplode(tokens).alias("at", "token"))
    weighed = join_small(placed, weights, "token").select("_sequence", F.struct("at", F.coalesce("weight", F.lit(unseen)).alias("weight")).alias("w"))
    add = F.aggregate(F.array_sort(F.collect_list("w")), F.lit(0.0), lambda a, w: a + w["weight"])
    return found.join(weighed.groupBy("_sequence").agg(add.alias("score")), "_sequence").select("kind", "sequence", "score")


def judge(
    pages: DataFrame, rules: list[tuple[str, str]], identity: str = "page_id", url: str = "url", html: str = "html",
    vocabulary: int = 1 << 16,
) -> DataFrame:
    """One row per page: `page_id`, `host`, `path`, `rule`, `verdict`, `block_score`, `host_words`.

    `rules` are (allow or block, text) with texts like `example.com/en/`.
    """
    book = Rules(rules)

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                host, path = split_url(text)
                out.append((host, path, *book.find(host, path), " ".join(path_tokens(path))))
            columns = list(zip(*out)) or [()] * 5
            names = ["page_id", "host", "path", "rule", "decided", "parts"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.string()) for c in columns]], names)

    lean = pages.select(F.col(f"`{identity}`").cast("long").alias("page_id"), F.col(f"`{url}`").alias("url"))
    parsed = written(lean.mapInArrow(parse, PARSED), "url-parsed")
    counts = written(word_counts(pages, html), "url-words")
    total = counts.agg(F.sum("n")).first()[0] or 0

    runs = parsed.select("host").distinct().select("host", F.posexplode(F.regexp_extract_all("host", F.lit(TOKEN.pattern), F.lit(0))).alias("at", "run"))
    runs = written(runs, "url-runs")
    words = segmented(runs.where(F.col("run").rlike("^[a-z]")).select("run").distinct(), counts, total)
    pieces = join_small(runs, words, "run").select("host", F.struct("at", F.coalesce("words", F.lit("#")).alias("words")).alias("piece"))
    in_order = F.transform(F.array_sort(F.collect_list("piece")), lambda x: x["words"])
    hosts = pieces.groupBy("host").agg(F.array_join(in_order, " ").alias("names"))
    rows = written(join_small(parsed, hosts, "host").withColumn("names", F.coalesce("names", F.lit(""))), "url-named")

    weights, unseen, prior = token_weights(rows, vocabulary)
    scores = written(sequence_scores(rows, weights, unseen), "url-scores")
    of_kind = lambda kind, name, score: scores.where(F.col("kind") == kind).select(F.col("sequence").alias(name), F.col("score").alias(score))
    rows = join_small(rows, of_kind("h", "names", "_host_score"), "names")
    rows = join_small(rows, of_kind("p", "parts", "_path_score"), "parts")
    score = F.lit(prior) + F.coalesce("_host_score", F.lit(0.0)) + F.coalesce("_path_score", F.lit(0.0))
    rows = rows.withColumn("block_score", score)
    verdict = F.coalesce("decided", F.when(F.col("block_score") > 0, F.lit("block")).otherwise(F.lit("allow")))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "block_score", F.col("names").alias("host_words"))
