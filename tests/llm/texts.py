"""Small tables with the awkward cases, and plain versions of what the operators count."""

import random
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
GAPS = str.maketrans("", "", " \t\n\x0b\f\r")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
# The last columns have names that operators use for their own columns.
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "h long, n long, bucket string, c0 string, copies int, rate double, key string, _id long, mix string, dedup string"
)


def row(number, text, lang="en", source="web"):
    return (number, text, lang, source, None if text is None else len(text), 1, 2, "b", "c", 3, 0.5, "k", 4, "m", "d")


def sentence(rng: random.Random, words: int) -> str:
    return " ".join("".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 7))) for _ in range(words))


def awkward_rows() -> list[tuple]:
    """NULLs in every column, empty and long texts, ties, repeated rows, odd spaces, near copies."""
    rng = random.Random(3)
    base = [sentence(rng, 120) for _ in range(6)]
    rows = [row(i, t) for i, t in enumerate(base)]
    for i, text in enumerate(base):
        words = text.split(" ")
        words[60] = "changed"
        rows.append(row(20 + i, " ".join(words), "de", "books"))
        rows.append(row(40 + i, text.upper(), None, None))
        rows.append(row(60 + i, text.replace(" ", "\n\t"), "en", "hot"))
    rows += [row(80, None), row(81, ""), row(82, " \t\n\x0b\f\r"), row(83, "one"), row(84, "one two three"), row(85, "ONE two\tthree")]
    rows += [row(86, "über straße ½ x y   z 😀"), row(87, "one"), row(83, "one"), row(None, base[0]), row(None, None, None, None)]
    rows += [row(90, sentence(rng, 30_000)), row(91, "same line\n" * 300), row(92, "#*$% |<> & a\n" * 80)]
    rows += [row(93, "x" * 200_000), row(94, "a b c a b c a b d"), row(95, None, None, None)]
    rows.append((None,) * 15)
    return rows


def documents(spark, rows=None):
    return spark.createDataFrame(awkward_rows() if rows is None else rows, SCHEMA)


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text, n=5):
    found = words(text)
    if not found:
        return frozenset()
    return frozenset(tuple(found[i : i + n]) for i in range(max(1, len(found) - n + 1)))


def groups(rows: list[tuple[int, str | None]], percent=75) -> dict[int, int]:
    """Smallest id that links reach, by comparing all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: root(i) for i, _ in rows}


def equal_texts(rows) -> dict[str, list]:
    found = defaultdict(list)
    for number, text in rows:
        found[(text or "").translate(GAPS)].append((number, text or ""))
    return found
