"""DuckDB SQL for the queries that SQL expresses on whole tables."""

from __future__ import annotations

from helispan.llm import jaccard, phrases, quality, vectors, warc

_WORDS = r"list_filter(string_split_regex(coalesce({0}, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

_TABLE = "['" + "','".join(quality.VOCABULARY) + "']"


def _histogram() -> tuple[str, str]:
    """Shares of the character classes and of the common words."""
    left, classes = "t", []
    for pattern in quality.CLASSES.values():
        escaped = pattern.replace("'", "''")
        after = f"regexp_replace({left}, '{escaped}', '', 'g')"
        classes.append(f"length({left}) - length({after})")
        left = after
    classes.append(f"length({left})")
    return "[" + ", ".join(f"({c})::DOUBLE" for c in classes) + "]", f"list_transform({_TABLE}, lambda v: len(list_filter(w, lambda x: x = v))::DOUBLE)"


def quality_sql() -> str:
    """Counts, distances and verdicts; the distances decide and are not returned."""
    classes, common = _histogram()
    window = quality.WINDOW
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, lang, coalesce(text, '') AS t, {_WORDS.format("text")} AS w FROM documents),
win AS (SELECT k, i, array_to_string(w[i:i + {window - 1}], ' ') AS g FROM (SELECT k, w, unnest(range(1, len(w) - {window - 2})) AS i FROM d)),
rep AS (SELECT k, i, lead(i) OVER (PARTITION BY k ORDER BY i) AS j FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT k, sum(least({window}, coalesce(j - i, {window})))::BIGINT AS n FROM rep GROUP BY k),
f AS (SELECT d.k, doc_id, lang, len(w)::BIGINT AS n_words, list_sum(list_transform(w, lambda x: length(x)))::BIGINT AS word_chars,
      length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, {classes} AS c0, {common} AS v0,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines, coalesce(cov.n, 0) AS n_repeat_words, length(t) AS n FROM d LEFT JOIN cov USING (k)),
h AS (SELECT *, list_transform(c0, lambda x: CASE WHEN n > 0 THEN x / n ELSE 0 END) AS c,
      list_transform(list_append(v0, n_words - list_sum(v0)), lambda x: CASE WHEN n_words > 0 THEN x / n_words ELSE 0 END) AS v, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
      n_words < {quality.MIN_BASE_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEATED_PERCENT} * n_words AS base_failed FROM f),
fit AS (SELECT * FROM h WHERE n_words >= {quality.MIN_WORDS} AND NOT base_failed QUALIFY count(*) OVER (PARTITION BY lang) >= {quality.MIN_REFERENCE}),
rc AS (SELECT lang, list(m ORDER BY i) AS p FROM (SELECT lang, i, round(avg(x), 9) AS m FROM (SELECT lang, unnest(c) AS x, generate_subscripts(c, 1) AS i FROM fit) GROUP BY 1, 2) GROUP BY 1),
rv AS (SELECT lang, list(m ORDER BY i) AS q FROM (SELECT lang, i, round(avg(x), 9) AS m FROM (SELECT lang, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM fit) GROUP BY 1, 2) GROUP BY 1),
b AS (SELECT h.*, {_distance("c", "p")} AS dc, {_distance("v", "q")} AS dv FROM h LEFT JOIN rc ON h.lang IS NOT DISTINCT FROM rc.lang LEFT JOIN rv ON h.lang IS NOT DISTINCT FROM rv.lang)
SELECT doc_id, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(n_words >= {quality.MIN_WORDS} AND (dc > {quality.MAX_CLASS_DISTANCE} OR dv > {quality.MAX_WORD_DISTANCE}), false) AS kept FROM b
"""


def _distance(a: str, b: str) -> str:
    part = "CASE WHEN {0} > 0 THEN {0} * log2({0} / ((z[1] + z[2]) / 2)) ELSE 0 END"
    return f"sqrt(greatest(list_sum(list_transform(list_zip({a}, {b}), lambda z: ({part.format('z[1]')} + {part.format('z[2]')}) / 2)), 0))"


def vectors_sql() -> str:
    """Links between all usable vectors, and components by reachability."""
    return f"""
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v
      WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
l AS (SELECT a.vec_id AS src, b.vec_id AS dst FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND a.n > 0 AND b.n > 0
      WHERE list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2])) / (a.n * b.n) >= {vectors.COSINE}),
r AS (SELECT src AS node, src AS seen FROM l UNION SELECT r.node, l.dst FROM r JOIN l ON r.seen = l.src),
c AS (SELECT node, min(seen) AS component FROM r GROUP BY node), k AS (SELECT src, count(*) AS n FROM l GROUP BY src)
SELECT vec_id, coalesce(k.n, 0) AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN c ON vec_id = node LEFT JOIN k ON vec_id = src
"""


def jaccard_sql() -> str:
    """Sets of shingles, links by counted common shingles, and components by reachability."""
    k, percent = jaccard.WORDS, jaccard.PERCENT
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS k, doc_id, {_WORDS.format(lower)} AS w FROM documents),
s AS (SELECT DISTINCT k, unnest(CASE WHEN len(w) >= {k} THEN list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' '))
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT k, count(*) AS n FROM s GROUP BY k),
c AS (SELECT a.k AS a, b.k AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.k <> b.k GROUP BY 1, 2),
l AS (SELECT c.a, c.b FROM c JOIN n x ON c.a = x.k JOIN n y ON c.b = y.k WHERE 100 * c.c >= {percent} * (x.n + y.n - c.c)),
r AS (SELECT a AS node, b AS seen FROM l UNION SELECT r.node, l.b FROM r JOIN l ON r.seen = l.a),
m AS (SELECT node, min(e.doc_id) AS low FROM r JOIN d e ON r.seen = e.k GROUP BY node), q AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least(m.low, doc_id), doc_id) AS component_id, coalesce(q.n, 0) AS n_links
FROM d LEFT JOIN n USING (k) LEFT JOIN m ON d.k = m.node LEFT JOIN q ON d.k = q.a
"""


def warc_sql() -> str:
    """Types of records by equal payloads, sizes and digests."""
    digits = " || ".join(f"to_base(('0x' || substr(sha1(h), {k}, 10))::BIGINT, 32, 8)" for k in (1, 11, 21, 31))
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT *, CASE WHEN strlen(h) >= {warc.MIN_REVISIT} THEN max(page_id) OVER (PARTITION BY h) END AS head FROM p),
r AS (SELECT *, coalesce(page_id IS DISTINCT FROM head AND head IS NOT NULL, false) AS again FROM f)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, translate({digits}, '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN head END AS refers_to FROM r
"""


def phrases_sql() -> str:
    """Counts of all phrases by language, the lowest-scoring cut of each candidate, and the first of each language."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH p AS (SELECT coalesce(lang, '{phrases.UNKNOWN}') AS lang, unnest(string_split_regex({lower}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w), s AS (SELECT lang, w, i, unnest(range(1, {phrases.DEPTH + 1})) AS k FROM g),
f AS (SELECT lang, k, w[i:i + k - 1] AS words, count(*) AS f FROM s WHERE i + k - 1 <= len(w) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1 AND f >= {phrases.MIN_COUNT}),
starts AS (SELECT lang, words, k, f, unnest(range(1, k)) AS i FROM c), spans AS (SELECT *, unnest(range(2, k)) AS m FROM starts),
held AS (SELECT lang, words[i:i + m - 1] AS words, max(f) AS longer FROM spans WHERE i + m - 1 <= k GROUP BY ALL),
cuts AS (SELECT lang, words, k, f, unnest(range(1, k)) AS cut FROM c),
scored AS (SELECT x.lang, x.words, x.f AS a, x.cut, a.f AS l, b.f AS r, ({phrases.SCALE}::HUGEINT * x.f) // (a.f + b.f) AS score FROM cuts x
           JOIN f a ON a.lang = x.lang AND a.words = x.words[1:x.cut] JOIN f b ON b.lang = x.lang AND b.words = x.words[x.cut + 1:x.k]),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, cut) = 1),
kept AS (SELECT b.*, array_to_string(b.words, ' ') AS phrase FROM best b LEFT JOIN held h ON h.lang = b.lang AND h.words = b.words WHERE coalesce(100 * h.longer < {phrases.WITHIN} * b.a, true))
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN n USING (lang) WHERE rank <= {phrases.TOP}
"""


ORACLES = {"op4_jaccard_join": jaccard_sql(), "op8_embedding_dedup": vectors_sql(), "op9_quality_rules": quality_sql(), "op11_warc": warc_sql(), "op13_collocations": phrases_sql()}
