"""Scoring documents with an n-gram model by deleted interpolation.

The probability of a token is a mixture of maximum-likelihood estimates of all orders up to `order` and a uniform one. The
mixture weights depend on how often the context was seen: one set of weights per order of the longest seen context and
doubling of its count. They are learned by expectation-maximisation on a deleted part of the training documents: counts come from
the others, and the weights are those under which the deleted part is likeliest. The final counts are of all training documents.

Counts of all n-grams reach the documents through `blocks`. The expectation-maximisation sees the deleted tokens as cells of
(weight set, doubling of each estimate): at most 97 x 32**3 cells by construction, however large the corpus is.

Defined results: a NULL or empty text is one end token. A document without id hashes like an empty id. Repeated rows count and
are scored each. Without training documents all counts are 0, V is 0 and every token has the uniform probability. A weight set
that no deleted token fell into uses equal weights of the estimates that exist there. An empty table gives an empty result.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from modelyard.llm import blocks
from modelyard.llm.common import distinct, hashed_words, partitions, text_size, window_keys

TRAIN, DELETED, UNSEEN = 0, 1, 2
DOUBLINGS, LEVELS = 48, 32
START, END = np.uint64(0x51), np.uint64(0xE4D)
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def token_ids(texts: list[str | None], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, each with its start marks before and its end mark after; tokens per text."""
    words, sizes = hashed_words(texts)
    sizes = sizes + 1
    ids = np.full(int((sizes + order - 1).sum()), START, np.uint64)
    ends = np.cumsum(sizes + order - 1) - 1
    ids[ends] = END
    # A word is moved by the start marks up to its own text's and by the end marks before it.
    own = np.repeat(np.arange(len(sizes)), sizes - 1)
    ids[np.arange(len(words)) + own * order + order - 1] = words
    return ids, sizes


def narrowed(keys: np.ndarray, order: int, bits: int) -> np.ndarray:
    """Keys of one order in `bits` bits, of which the last two tell the order."""
    return keys >> np.uint64(64 - bits) & ~np.uint64(3) | np.uint64(order - 1)


def token_keys(texts: list[str | None], order: int, bits: int = 64) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order the key of the n-gram that ends at each token."""
    ids, sizes = token_ids(texts, order)
    ends = np.repeat(np.cumsum(sizes + order - 1), sizes)
    place = ends - np.repeat(np.cumsum(sizes), sizes) + np.arange(sizes.sum())
    keys = []
    for n in range(1, order + 1):
        made = window_keys(ids, n)[place - (n - 1)] if len(place) else np.zeros(0, np.uint64)
        keys.append(narrowed(made, n, bits))
    return keys, sizes


def estimates(
    counts: list[np.ndarray], sizes: np.ndarray, tokens: float, documents: float, words: float
) -> tuple[np.ndarray, np.ndarray]:
    """The estimates of each token, shape (order + 1, tokens), from uniform to the longest; and its weight set."""
    first = np.cumsum(sizes) - sizes
    out = [np.full(len(counts[0]), 1.0 / (words + 1)), counts[0] / max(tokens, 1.0)]
    chosen = np.zeros(len(counts[0]), np.int64)
    for level, (own, shorter) in enumerate(zip(counts[1:], counts[:-1])):
        context = np.roll(shorter, 1)
        context[first] = documents  # a document's first token follows the start marks
        out.append(np.divide(own, context, out=np.zeros(len(own)), where=context > 0))
        doubling = np.minimum(np.log2(np.maximum(context, 1)).astype(np.int64), DOUBLINGS - 1)
        chosen = np.where(context > 0, 1 + level * DOUBLINGS + doubling, chosen)
    return np.stack(out), chosen


def learned_weights(cells: np.ndarray, sizes: np.ndarray, means: np.ndarray, sets: int, rounds: int = 200) -> np.ndarray:
    """Mixture weights, shape (sets, estimates), by expectation-maximisation over cells (set, tokens, mean estimates)."""
    width = means.shape[0]
    weights = np.zeros((sets, width))
    levels = 1 + (np.arange(sets) - 1) // DOUBLINGS
    levels[0] = 0
    for j in range(width):
        weights[:, j] = j <= levels + 1
    weights /= weights.sum(axis=1, keepdims=True)
    if not len(cells):
        return weights
    seen = np.bincount(cells, weights=sizes, minlength=sets)
    for _ in range(rounds):
        shares = weights[cells].T * means
        shares *= sizes / shares.sum(axis=0)
        sums = np.stack([np.bincount(cells, weights=s, minlength=sets) for s in shares], axis=1)
        fresh = np.where(seen[:, None] > 0, sums / np.maximum(seen, 1)[:, None], weights)
        moved = np.abs(fresh - weights).max()
        weights = fresh
        if moved < 1e-7:
            break
    return weights


def cell_codes(values: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The cell of each token: its weight set and the doubling of each estimate over the uniform one."""
    code = chosen.copy()
    for estimate in values[1:]:
        ratio = estimate / values[0]
        level = np.where(ratio > 0, np.clip(np.log2(np.maximum(ratio, 1e-300)) + 3, 1, LEVELS - 1), 0).astype(np.int64)
        code = code * LEVELS + level
    return code


def score(
    docs: DataFrame, identity: str = "doc_id", text: str = "text", order: int = 3, folds: int = 7, unseen: int = 2, deleted: int = 3,
    block_bytes: int = 8 << 20,
) -> DataFrame:
    """One row per document: `doc_id`, `held_out`, `n_tokens`, `n_known`, `train_tokens`, `base_score`, `score`.

    Documents whose crc32 of the id leaves `unseen` modulo `folds` are not learned from; those that leave `deleted` give the weights.
    """
    if not 2 <= order <= 3:
        raise ValueError("order must be 2 or 3")
    spark = docs.sparkSession
    lean = docs.select(F.col(f"`{identity}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds
    part = F.when(fold == unseen, UNSEEN).when(fold == deleted, DELETED).otherwise(TRAIN).cast("int")
    _, size = text_size(lean, "text")
    packed = blocks.pack_blocks(lean.withColumn("part", part), block_bytes, "lm-blocks")
    buckets = 2 * max(partitions(spark), -(-size // block_bytes))
    # Wide enough that a pair of n-grams with the same key is unlikely in the whole corpus (about one in ten corpora at six
    # bytes a token), until 64 bits are reached.
    bits = max(16, min(64, 2 * (order * size // 6).bit_length() - 2))

    def keys_of(rows: pa.Table, part: int) -> tuple[np.ndarray, np.ndarray]:
        keys, _ = token_keys(rows["text"].to_pylist(), order, bits)
        asked, n = distinct(np.concatenate(keys))
        counts = np.zeros((2, len(asked)), np.uint32)
        if part != UNSEEN:
            counts[part] = n
        return asked, counts

    end = narrowed(window_keys(np.array([END]), 1), 1, bits)[0]

    def summary(keys: np.ndarray, totals: np.ndarray) -> list[int]:
        single = keys & np.uint64(3) == 0
        sums = totals[:, single].sum(axis=1)
        known = (totals.sum(axis=0)[single] > 0).sum()
        documents = totals[:, keys == end].sum(axis=1)
        return [int(known), int(sums[0]), int(sums[1]), int(documents[0]), int(documents[1])]

    answers = blocks.answer(blocks.ask(packed, keys_of, 2, buckets, bits), 2, summary, "lm-answers")
    words, *numbers = (int(x) for x in blocks.summaries(answers, 5))
    tokens, documents = np.array(numbers[:2]), np.array(numbers[2:])
    sets = 1 + (order - 1) * DOUBLINGS

    def placed(rows: pa.Table, totals: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        keys, sizes = token_keys(rows["text"].to_pylist(), order, bits)
        _, place = np.unique(np.concatenate(keys), return_inverse=True)
        return np.split(totals[place].astype(np.float64), order), sizes

    def cells(rows: pa.Table, part: int, totals: np.ndarray, block: int) -> pa.Table:
        counts, sizes = placed(rows, totals[TRAIN])
        values, chosen = estimates(counts, sizes, tokens[TRAIN], documents[TRAIN], words)
        code, place = np.unique(cell_codes(values, chosen), return_inverse=True)
        sums = [np.bincount(place, weights=v) for v in values]
        return pa.table({"cell": code, "n": np.bincount(place).astype(np.int64)} | {f"s{j}": s for j, s in enumerate(sums)})

    wide = ", ".join(f"s{j} double" for j in range(order + 1))
    held = blocks.finish(packed.where(f"part = {DELETED}"), answers, 2, cells, f"cell long, n long, {wide}")
    held = held.groupBy("cell").agg(F.sum("n").alias("n"), *[F.sum(f"s{j}").alias(f"s{j}") for j in range(order + 1)]).orderBy("cell").collect()
    code = np.array([r["cell"] for r in held], np.int64)
    sizes = np.array([r["n"] for r in held], np.float64)
    means = np.array([[r[f"s{j}"] / r["n"] for r in held] for j in range(order + 1)]).reshape(order + 1, len(held))
    weights = learned_weights(code // LEVELS**order, sizes, means, sets)
    total_tokens, total_documents = int(tokens.sum()), int(documents.sum())

    def scored(rows: pa.Table, part: int, totals: np.ndarray, block: int) -> pa.Table:
        counts, sizes = placed(rows, totals.sum(axis=0))
        values, chosen = estimates(counts, sizes, total_tokens, total_documents, words)
        first = np.cumsum(sizes) - sizes
        mixed = np.log10((weights[chosen].T * values).sum(axis=0))
        base = np.log10((counts[0] + 1) / (total_tokens + words + 1))
        return pa.table(
            {
                "doc_id": rows["doc_id"].combine_chunks(),
                "held_out": np.full(len(sizes), part == UNSEEN),
                "n_tokens": sizes,
                "n_known": np.add.reduceat((counts[0] > 0).astype(np.int64), first),
                "train_tokens": np.full(len(sizes), total_tokens, np.int64),
                "base_score": np.add.reduceat(base, first),
                "score": np.add.reduceat(mixed, first),
            }
        )

    return blocks.finish(packed, answers, 2, scored, RESULT)
