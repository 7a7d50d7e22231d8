"""SQL that gives the rows of the queries, where SQL can say it."""

from modelyard.llm import licenses, quality

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
UNIT = "4503599627370496.0"


def seeded(seed: int, *parts: str) -> str:
    text = " || ':' || ".join([f"'{seed}'", *[f"coalesce(CAST({p} AS VARCHAR), '')" for p in parts]])
    return f"CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT)"


def quality_sql(risk: float = 0.01, error: float = 0.05) -> str:
    rules = quality.RULES
    ratios = {
        "symbol_share": ("n_symbols", "word_chars"),
        "dup_line_share": ("n_dup_lines", "n_lines"),
        "repeat_share": ("n_repeat_words", "n_words"),
        "long_word_share": ("n_long_words", "n_words"),
        "upper_share": ("n_upper", "word_chars"),
    }
    value = {r: f"CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0.0 END" for r, (a, b) in ratios.items()}
    values = " UNION ALL ".join(f"SELECT n, lang, good, {i} AS i, '{r}' AS rule, {value[r]} AS v, {rules[r][-1]} AS strictest FROM told" for i, r in enumerate(rules))
    candidates = ", ".join(f"('{r}', {k}, {cut})" for r, cuts in rules.items() for k, cut in enumerate(cuts))
    picked = ", ".join(f"min(cut) FILTER (rule = '{r}' AND ok) AS cutoff_{r}" for r in rules)
    passed = " AND ".join(f"NOT coalesce({value[r]} > cutoff_{r}, false)" for r in rules)
    return rf"""
    WITH RECURSIVE w AS (SELECT doc_id, lang, coalesce(text, '') AS text, {WORDS} AS ws FROM documents),
    windows AS (
      SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS win
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
    ),
    twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows) WHERE n > 1),
    repeats AS (
      SELECT doc_id, CAST(sum(least(3, coalesce(i - before, 3))) AS BIGINT) AS n_repeat_words
      FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM twice) GROUP BY doc_id
    ),
    m AS (
      SELECT w.doc_id, lang, len(ws) AS n_words,
        length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        len(lines) - len(list_distinct(lines)) AS n_dup_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines,
        len(list_filter(ws, lambda x: length(x) > 20)) AS n_long_words,
        length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper
      FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM w) w
      LEFT JOIN repeats r ON r.doc_id = w.doc_id
    ),
    b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
    told AS (
      SELECT b.*, g.good, row_number() OVER () AS n FROM b JOIN (
        SELECT doc_id, min(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good FROM labels WHERE quality IS NOT NULL
        GROUP BY doc_id HAVING min(CASE WHEN quality = 1 THEN 1 ELSE 0 END) = max(CASE WHEN quality = 1 THEN 1 ELSE 0 END)) g
      ON g.doc_id = b.doc_id WHERE NOT base_failed
    ),
    vals AS ({values}),
    kinds AS (SELECT mask, count(*) AS n FROM (SELECT n, sum(CASE WHEN v > strictest THEN CAST(2 ** i AS INTEGER) ELSE 0 END)::INTEGER AS mask FROM vals WHERE good = 0 GROUP BY n) GROUP BY mask),
    greedy(rank, chosen, i) AS (
      SELECT 0, 0, CAST(NULL AS INTEGER)
      UNION ALL
      SELECT rank + 1, chosen | CAST(2 ** r AS INTEGER), r FROM (
        SELECT rank, chosen, r, sum(n) AS adds FROM greedy, kinds, (SELECT unnest(range({len(rules)}))::INTEGER AS r)
        WHERE mask & chosen = 0 AND mask & CAST(2 ** r AS INTEGER) <> 0 GROUP BY rank, chosen, r
        QUALIFY row_number() OVER (ORDER BY adds DESC, r) = 1)
    ),
    ranks AS (
      SELECT DISTINCT rule, rank FROM vals JOIN greedy ON greedy.i = vals.i
      UNION ALL
      SELECT DISTINCT rule, i + 1 FROM vals WHERE NOT EXISTS (SELECT 1 FROM vals b WHERE b.good = 0)
    ),
    ranked AS (
      SELECT vals.*, rank, min(CASE WHEN v > strictest THEN rank END) OVER (PARTITION BY n) AS first_over
      FROM vals JOIN ranks ON ranks.rule = vals.rule WHERE good = 1
    ),
    c AS (
      SELECT lang, r.rule, rank, k, cut, count(*) AS n, count(*) FILTER (v > cut OR first_over < rank) AS lost
      FROM ranked r JOIN (VALUES {candidates}) t(rule, k, cut) ON t.rule = r.rule GROUP BY ALL
    ),
    strata AS (SELECT greatest(1, count(DISTINCT coalesce(lang, '') || CASE WHEN lang IS NULL THEN '-' ELSE '+' END)) AS s FROM ranked),
    single AS (
      SELECT c.*, CASE WHEN lost < {risk} * n THEN list_sum(list_transform(range(0, lost + 1), lambda i:
        exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({risk}) + (n - i) * ln(1 - {risk}))))
        <= {error} / s ELSE false END AS own
      FROM c CROSS JOIN strata
    ),
    tested AS (SELECT *, bool_and(own) OVER (PARTITION BY lang ORDER BY rank, k) AS ok FROM single),
    cutoffs AS (SELECT lang, {picked} FROM tested GROUP BY lang)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_long_words, n_upper, base_failed,
      NOT base_failed AND {passed} AS kept, {", ".join(f"CAST(cutoff_{r} AS DOUBLE) AS cutoff_{r}" for r in rules)}
    FROM b LEFT JOIN cutoffs ON b.lang IS NOT DISTINCT FROM cutoffs.lang
    """


def packing_sql(buckets: int = 16, budget: int = 65_536, seed: int = 11) -> str:
    return rf"""
    WITH RECURSIVE d AS (SELECT doc_id, len({WORDS}) + 1 AS n_tokens FROM documents),
    cells AS (
      SELECT cell, max(n_tokens) AS top, count(*) AS c, sum(n_tokens) AS s FROM (
        SELECT n_tokens, CASE WHEN n_tokens <= 4096 THEN n_tokens ELSE n_tokens - n_tokens % CAST(2 ** (length(bin(n_tokens)) - 7) AS BIGINT) END AS cell
        FROM d
      ) GROUP BY cell
    ),
    h AS (
      SELECT row_number() OVER (ORDER BY cell) AS i, top, CAST(sum(c) OVER (ORDER BY cell) AS BIGINT) AS ac,
        CAST(sum(s) OVER (ORDER BY cell) AS BIGINT) AS ta FROM cells
    ),
    e AS (SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS ac, CAST(0 AS BIGINT) AS ta UNION ALL SELECT i, ac, ta FROM h),
    steps(b, best) AS (
      SELECT 0, {{'cost': CAST(0 AS BIGINT), 'j': CAST(0 AS BIGINT), 'path': CAST([] AS BIGINT[])}} , CAST(0 AS BIGINT)
      UNION ALL
      SELECT b + 1, min({{'cost': best.cost + h.top * (h.ac - e.ac) - (h.ta - e.ta), 'j': steps.spot, 'path': list_append(best.path, h.top)}}), h.i
      FROM steps JOIN e ON e.i = steps.spot JOIN h ON h.i > steps.spot
      WHERE b < least({buckets}, (SELECT count(*) FROM h))
      GROUP BY b, h.i
    ),
    ends AS (
      SELECT best.path AS path FROM steps WHERE b = least({buckets}, (SELECT count(*) FROM h)) AND steps.spot = (SELECT max(i) FROM h)
    ),
    p AS (SELECT d.*, len(list_filter(path, lambda x: x < n_tokens)) AS bucket, path, {seeded(seed, "doc_id")} AS key FROM d CROSS JOIN ends),
    q AS (
      SELECT *, path[bucket + 1] AS boundary, row_number() OVER (PARTITION BY bucket ORDER BY key, doc_id NULLS FIRST, n_tokens) - 1 AS r FROM p
    )
    SELECT doc_id, n_tokens, bucket, boundary, r // greatest(1, {budget} // greatest(boundary, 1)) AS batch, boundary - n_tokens AS padding
    FROM q
    """.replace("steps(b, best) AS", "steps(b, best, spot) AS")


def licenses_sql() -> str:
    known = " UNION ALL ".join(f"SELECT '{text}' AS sentence, '<{number}>' AS mark" for text, number in licenses.known_sentences().items())
    joined = "coalesce(text, '')"
    for pattern in licenses.WRAPPED:
        joined = rf"regexp_replace({joined}, '{pattern}', '\1 \2', 'g')".replace(r"\n", "' || chr(10) || '")
    steps, last = [], "s0"
    for i, (name, run) in enumerate(licenses.RULES):
        mark = licenses.pattern_of(run)
        steps.append(
            f"s{i + 1} AS (SELECT doc_id, sentences, replace(left_, '{mark}', '') AS left_, "
            f"CASE WHEN contains(left_, '{mark}') AND NOT list_contains(names, '{name}') THEN list_append(names, '{name}') ELSE names END AS names FROM {last})"
        )
        last = f"s{i + 1}"
    cue = " OR ".join(f"contains(low, '{c}')" for c in licenses.CUES)
    return rf"""
    WITH known AS ({known}),
    t AS (SELECT doc_id, joined, lower(joined) AS low FROM (SELECT doc_id, {joined} AS joined FROM documents)),
    parts AS (
      SELECT doc_id, unnest(list) AS part, unnest(range(len(list))) AS i FROM (
        SELECT doc_id, string_split(regexp_replace(joined, '([.!?;])[\x20\x09-\x0D]+', '\1' || chr(10), 'g'), chr(10)) AS list
        FROM t WHERE {cue})
    ),
    found AS (
      SELECT doc_id, string_agg(mark, '' ORDER BY i) AS sentences
      FROM parts JOIN known ON sentence = trim(regexp_replace(lower(part), '[^a-z0-9]+', ' ', 'g')) GROUP BY doc_id
    ),
    s0 AS (
      SELECT d.doc_id, coalesce(sentences, '') AS sentences, coalesce(sentences, '') AS left_, CAST([] AS VARCHAR[]) AS names
      FROM documents d LEFT JOIN found f ON f.doc_id = d.doc_id
    ),
    {", ".join(steps)}
    SELECT doc_id, sentences, array_to_string(names, ';') AS licences, len(names) AS n_licences, left_ AS unmatched FROM {last}
    """


DEDUP_SQL = r"""
    WITH d AS (
      SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS c FROM documents
    )
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM (
      SELECT doc_id, first_value(doc_id) OVER (PARTITION BY c ORDER BY length(t) DESC, doc_id) AS keep_id,
        count(*) OVER (PARTITION BY c) AS group_size, sha256(c) AS text_sha256 FROM d)
"""


def mixing_sql(power: float = 0.5, epochs: float = 1.0, seed: int = 7) -> str:
    return f"""
    WITH n AS (SELECT source, count(*) AS documents FROM documents GROUP BY source),
    w AS (SELECT source, documents, CAST(documents AS DOUBLE) ** {power} AS weight FROM n),
    t AS (SELECT sum(documents) AS n, sum(weight) AS w FROM w),
    r AS (SELECT source, {epochs} * weight / t.w * t.n / documents AS rate FROM w CROSS JOIN t),
    k AS (SELECT source, rate, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 30) AS BIGINT) + 1)) AS k FROM r),
    cdf AS (SELECT source, rate, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS p FROM k),
    drawn AS (
      SELECT d.doc_id, d.source, d.text, rate, count(*) FILTER ({seeded(seed, "doc_id")} / {UNIT} >= p) AS copies
      FROM documents d JOIN cdf ON d.source IS NOT DISTINCT FROM cdf.source GROUP BY ALL
    ),
    copies AS (SELECT *, unnest(range(1, copies + 1)) AS copy FROM drawn)
    SELECT doc_id, source, text, round(rate, 9) AS rate, copies, copy, {seeded(seed + 1, "doc_id", "copy")} AS shuffle_key FROM copies
    """


JOIN_SQL = r"""
    WITH RECURSIVE w AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
      FROM documents
    ),
    s AS (
      SELECT DISTINCT doc_id, shingle FROM (
        SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
          ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS shingle FROM w)
    ),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
    one AS (
      SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 75 * (nx.n + ny.n - k)
    ),
    links AS (SELECT x, y FROM one UNION ALL SELECT y, x FROM one),
    reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, links.y FROM reach JOIN links ON links.x = reach.b),
    least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN least ON a = d.doc_id
"""


WARC_SQL = """
    WITH d AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
    k AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS hex, max(page_id) OVER (PARTITION BY sha1(body)) AS target FROM d)
    SELECT page_id, payload_bytes,
      list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + CAST(list_sum(list_transform(range(0, 5), lambda j: get_bit(CAST(unhex(hex) AS BIT), CAST(5 * i + j AS INTEGER)) * (16 // CAST(2 ** j AS INTEGER)))) AS INTEGER),
        1)), 'string_agg', '') AS payload_digest,
      CASE WHEN page_id = target THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN page_id = target THEN NULL ELSE target END AS refers_to
    FROM k
"""


def merkle_sql(arity: int = 16) -> str:
    def field(value: str) -> str:
        return f"coalesce(CAST(strlen(CAST({value} AS VARCHAR)) AS VARCHAR) || ':' || CAST({value} AS VARCHAR), '-')"

    def digest(text: str) -> str:
        return "sha256(" + " || ".join(field(f) for f in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = "list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(CAST(doc_id AS VARCHAR)[i]) AS UBIGINT))), lambda c, b: xor(c >> 8, table_[1 + CAST(xor(c, b) & 255 AS INTEGER)]))"
    same = "IS NOT DISTINCT FROM"
    return f"""
    WITH RECURSIVE
    crc_steps(n, k, v) AS (
      SELECT range, 0, CAST(range AS UBIGINT) FROM range(256)
      UNION ALL
      SELECT n, k + 1, CASE WHEN v & 1 = 1 THEN xor(CAST(3988292384 AS UBIGINT), v >> 1) ELSE v >> 1 END FROM crc_steps WHERE k < 8
    ),
    crc_table AS (SELECT list(v ORDER BY n) AS table_ FROM crc_steps WHERE k = 8),
    leaves AS (
      SELECT doc_id, source, {digest("text")} AS leaf,
        CASE WHEN xor({crc}, CAST(4294967295 AS UBIGINT)) % 5 = 0 THEN {digest(lowered)} ELSE {digest("text")} END AS told,
        row_number() OVER (PARTITION BY source ORDER BY doc_id, {digest("text")}) - 1 AS place, count(*) OVER (PARTITION BY source) AS size
      FROM documents CROSS JOIN crc_table
    ),
    nodes(source, level, place, node, size) AS (
      SELECT source, 0, place, leaf, size FROM leaves
      UNION ALL
      SELECT source, level + 1, place // {arity}, sha256(string_agg(node, '' ORDER BY place)), (size + {arity - 1}) // {arity}
      FROM nodes WHERE size > 1 GROUP BY source, level, place // {arity}, size
    ),
    tops AS (
      SELECT source, node, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS size, level AS height FROM nodes WHERE size = 1
    ),
    upper_(level, place, node, size) AS (
      SELECT 0, place, node, size FROM tops
      UNION ALL
      SELECT level + 1, place // {arity}, sha256(string_agg(node, '' ORDER BY place)), (size + {arity - 1}) // {arity}
      FROM upper_ WHERE size > 1 GROUP BY level, place // {arity}, size
    ),
    every AS (
      SELECT source, level, place, node, size FROM nodes WHERE size > 1
      UNION ALL
      SELECT t.source, t.height + u.level, u.place, u.node, u.size FROM tops t CROSS JOIN upper_ u WHERE u.size > 1
    ),
    runs AS (
      SELECT source, level, place // {arity} AS run, list(node ORDER BY place) AS nodes FROM every GROUP BY ALL
    ),
    climb(doc_id, leaf, source, level, place, told, proof) AS (
      SELECT doc_id, leaf, source, 0, CASE WHEN size > 1 THEN place ELSE (SELECT t.place FROM tops t WHERE t.source {same} leaves.source) END, told, '' FROM leaves
      UNION ALL
      SELECT doc_id, leaf, c.source, c.level + 1,
        CASE WHEN c.level + 1 = t.height THEN t.place ELSE c.place // {arity} END,
        sha256(array_to_string(nodes[:c.place % {arity}], '') || told || array_to_string(nodes[c.place % {arity} + 2:], '')),
        proof || array_to_string(nodes[:c.place % {arity}], '') || array_to_string(nodes[c.place % {arity} + 2:], '')
      FROM climb c JOIN tops t ON t.source {same} c.source JOIN runs r ON r.source {same} c.source AND r.level = c.level AND r.run = c.place // {arity}
    ),
    ended AS (
      SELECT c.* FROM climb c JOIN tops t ON t.source {same} c.source WHERE c.level = t.height + (SELECT max(level) FROM upper_)
    )
    SELECT doc_id, leaf, t.node AS subroot, (SELECT node FROM upper_ WHERE size = 1) AS root, sha256(proof) AS proof_sha256, told AS folded_root,
      told = (SELECT node FROM upper_ WHERE size = 1) AS verified
    FROM ended c JOIN tops t ON t.source {same} c.source
    """
