"""Licence recognition by sentence rules, in DataFrame functions only.

A text is cut into sentences, each is normalised (lower case, letters and digits, single spaces) and looked up among known
licence sentences. What is left is a short sequence of sentence numbers, and ordered rules name the licence of runs in it:
the first rule takes its runs out, then the next, so that a whole licence is not also reported as its parts.

Everything is an expression over one row: no text crosses the network. Lines that are wrapped within a sentence are joined
first (next line in lower case, or both sides in capitals). Any other line end without the end of a sentence before it may
lie within a sentence or between two: a known sentence is found across it as well as up to it, the longest first. Indentation and
comment marks at the start of a line count for nothing. No sentence goes over an empty line.

Defined results: a NULL or empty text has no sentences and no licence. Known sentences in an order that no rule has are kept in
`unmatched`. A sentence that is repeated counts each time, a licence once. Rows that repeat an id are judged each. An empty
table gives an empty result.
"""

from pyspark.sql import Column, DataFrame, functions as F

from modelyard.llm.common import let

# Known licence sentences by number.
SENTENCES = {
    1: "Released under the MIT License.",
    2: "Licensed under the Apache License, Version 2.0.",
    3: "This work is licensed under the GNU General Public License, version 3.",
    4: "Licensed under CC BY-NC 4.0.",
    5: "All rights reserved.",
    6: "Licensed under the MIT License.",
    7: "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    8: "Licensed under CC BY 4.0.",
    9: "Licensed under CC BY-SA 4.0.",
    10: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",  # noqa: E501
    11: "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    12: "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.",  # noqa: E501
    13: "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.",  # noqa: E501
    20: "Licensed under the Apache License, Version 2.0 (the License);",
    21: "you may not use this file except in compliance with the License.",
    22: "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",  # noqa: E501
    23: "See the License for the specific language governing permissions and limitations under the License.",
    30: "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    31: "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    32: "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",  # noqa: E501
    33: "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",  # noqa: E501
    40: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",  # noqa: E501
    41: "either version 2 of the License, or (at your option) any later version.",
    42: "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    43: "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    44: "See the GNU General Public License for more details.",
    50: "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    51: "This is free and unencumbered software released into the public domain.",
}
# Ordered rules; a run of sentences and the licence it means.
RULES = (
    ("MIT", (10, 11, 12, 13)),
    ("MIT", (10, 11, 12)),
    ("MIT", (10,)),
    ("BSD-3-Clause", (30, 31, 32, 33)),
    ("BSD-2-Clause", (30, 31, 32)),
    ("Apache-2.0", (20, 21, 22, 23)),
    ("Apache-2.0", (20, 21)),
    ("Apache-2.0", (20,)),
    ("GPL-3.0-or-later", (40, 42, 43, 44)),
    ("GPL-3.0-or-later", (40,)),
    ("GPL-2.0-or-later", (41, 42, 43, 44)),
    ("GPL-2.0-or-later", (41,)),
    ("MIT", (1,)),
    ("MIT", (6,)),
    ("Apache-2.0", (2,)),
    ("GPL-3.0", (3,)),
    ("CC-BY-NC-4.0", (4,)),
    ("CC-BY-4.0", (7,)),
    ("CC-BY-4.0", (8,)),
    ("CC-BY-SA-4.0", (9,)),
    ("CC0-1.0", (50,)),
    ("Unlicense", (51,)),
    ("Proprietary", (5,)),
)
# Every known sentence has one of these, so a text without any needs no cutting; single words, as spaces between words vary.
CUE_WORDS = ("licen", "permission", "copyright", "reserved", "warrant", "redistribut", "domain", "conditions", "liab")
# The cues of the query's SQL.
CUES = ("licen", "permission", "copyright", "rights reserved", "warrant", "redistribut", "public domain", "conditions", "liab")
SENTENCE_END = r"([.!?;])[\x20\x09-\x0D]+"
EMPTY_LINE = r"\n[^A-Za-z0-9\n]+(?=\n)"
LINE_START = r"(^|\n)[^a-z0-9\n]+"
WRAPPED = (r"([^.!?;:\n])\n([a-z])", r"([A-Z,])\n([A-Z][A-Z])")


def normalised(sentence: str) -> str:
    """The Python twin of the normalisation, for the table of known sentences."""
    plain = "".join(c if c.isascii() and c.isalnum() else " " for c in sentence.lower())
    return " ".join(plain.split())


def known_sentences() -> dict[str, int]:
    return {normalised(text): number for number, text in SENTENCES.items()}


def sentence_pattern() -> str:
    """Any known sentence between two line ends, with a space or a single line end between its words; the longest first."""
    known = sorted(known_sentences(), key=lambda s: (-len(s), s))
    return r"(?<![^\n])(?:" + "|".join(s.replace(" ", r"[ \n]") for s in known) + r")(?![^\n])"


def sentence_numbers(text: Column) -> Column:
    """The known sentences of a text in order, written <1><5>."""
    joined = F.regexp_replace(F.coalesce(text, F.lit("")), EMPTY_LINE, "\n")
    for pattern in WRAPPED:
        joined = F.regexp_replace(joined, pattern, "$1 $2")
    # A line end that stays may lie within a sentence, an empty line ends one.
    lines = F.regexp_replace(F.regexp_replace(F.lower(joined), LINE_START, "$1"), SENTENCE_END, "\n\n")
    plain = F.regexp_replace(F.regexp_replace(lines, r"[^a-z0-9\n]+", " "), r" ?\n ?", "\n")
    lookup = F.create_map(*[F.lit(x) for pair in known_sentences().items() for x in (pair[0], f"<{pair[1]}>")])
    number = lambda s: F.try_element_at(lookup, F.translate(s, "\n", " "))
    found = F.array_join(F.transform(F.regexp_extract_all(F.trim(plain), F.lit(sentence_pattern()), F.lit(0)), number), "")
    low = F.lower(F.coalesce(text, F.lit("")))
    cue = F.lit(False)
    for word in CUE_WORDS:
        cue = cue | F.contains(low, F.lit(word))
    return F.when(cue, found).otherwise("")


def pattern_of(run: tuple[int, ...]) -> str:
    return "".join(f"<{n}>" for n in run)


def recognised(numbers: Column) -> Column:
    """A struct: `left` (numbers that no rule took) and `names` (licences in the order of the rules)."""
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(pattern_of(run)).alias("run")) for name, run in RULES])

    def step(state: Column, rule: Column) -> Column:
        hit = F.contains(state["left"], rule["run"])
        names = F.when(hit & ~F.array_contains(state["names"], rule["name"]), F.array_append(state["names"], rule["name"]))
        return F.struct(F.replace(state["left"], rule["run"], F.lit("")).alias("left"), F.coalesce(names, state["names"]).alias("names"))

    start = F.struct(numbers.alias("left"), F.array().cast("array<string>").alias("names"))
    return F.when(numbers != "", F.aggregate(rules, start, step)).otherwise(start)


def scan(docs: DataFrame, identity: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: `doc_id`, `sentences`, `licences` (joined by ';'), `n_licences`, `unmatched`."""
    judged = let(sentence_numbers(F.col(f"`{text}`")), lambda n: F.struct(n.alias("sentences"), recognised(n).alias("found")))
    rows = docs.select(F.col(f"`{identity}`").alias("doc_id"), judged.alias("_judged"))
    return rows.select(
        "doc_id",
        F.col("_judged.sentences").alias("sentences"),
        F.array_join("_judged.found.names", ";").alias("licences"),
        F.size("_judged.found.names").cast("long").alias("n_licences"),
        F.col("_judged.found.left").alias("unmatched"),
    )
