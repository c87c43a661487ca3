"""DuckDB equivalents of the queries that SQL can express, written from their definitions."""

from __future__ import annotations

import math

from turnloom.llm import chat, quality_rules


def quality_rules_measure(m: str) -> str:
    return {"symbols": "n_symbols * 1000 // greatest(n_words, 1)",
            "repeats": "n_repeat_words * 1000 // greatest(n_words, 1)",
            "copies": "n_dup_lines * 1000 // greatest(n_lines, 1)",
            "width": "word_chars * 100 // greatest(n_words, 1)"}[m]


def quality_rules_sql() -> str:
    spreads, gamma, reach, least = (getattr(quality_rules, n) for n in ("SPREADS", "GAMMA", "REACH", "LEAST"))
    values = " UNION ALL ".join(
        f"SELECT lang, source, '{m}' AS measure, {quality_rules_measure(m)} AS v FROM f WHERE NOT base_failed"
        for m in spreads)
    unit = " ".join(f"WHEN '{m}' THEN {s}" for m, s in spreads.items())
    fence = ", ".join(
        f"max(q25 - {reach} * spread) FILTER (measure = '{m}') AS {m}_low, "
        f"max(q75 + {reach} * spread) FILTER (measure = '{m}') AS {m}_high" for m in spreads)
    inside = " AND ".join(f"{quality_rules_measure(m)} BETWEEN {m}_low AND {m}_high" for m in spreads)
    return rf"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
      FROM t),
three AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS tri
          FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 2)) AS i FROM w WHERE len(words) >= 3)),
again AS (SELECT doc_id, i FROM three QUALIFY count(*) OVER (PARTITION BY doc_id, tri) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again)
            GROUP BY doc_id),
c AS (SELECT doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words,
             CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
             CAST(len(lines) AS BIGINT) AS n_lines,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN covered USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
s AS (SELECT lang, source, measure, count(*) AS n,
             CASE WHEN v <= 0 THEN 0 ELSE CAST(ceil(ln(v) / {math.log(gamma)!r}) AS INT) + 1 END AS bucket
      FROM ({values}) GROUP BY ALL),
levels AS (SELECT 0 AS level, lang AS l, source AS s, * FROM s UNION ALL SELECT 1, lang, '', * FROM s
           UNION ALL SELECT 2, '', '', * FROM s),
merged AS (SELECT level, l, s, measure, bucket, sum(n) AS n FROM levels GROUP BY ALL),
run AS (SELECT *, sum(n) OVER (PARTITION BY level, l, s, measure ORDER BY bucket) AS upto,
               sum(n) OVER (PARTITION BY level, l, s, measure) AS total FROM merged),
q AS (SELECT level, l, s, measure, total, min(bucket) FILTER (upto >= 0.25 * total) AS b25,
             min(bucket) FILTER (upto >= 0.75 * total) AS b75 FROM run GROUP BY ALL),
e AS (SELECT *, CASE WHEN b25 = 0 THEN 0 ELSE 2 * pow({gamma!r}, b25 - 1) / ({gamma!r} + 1) END AS q25,
             CASE WHEN b75 = 0 THEN 0 ELSE 2 * pow({gamma!r}, b75 - 1) / ({gamma!r} + 1) END AS q75 FROM q),
b AS (SELECT *, greatest(q75 - q25, CASE measure {unit} END) AS spread FROM e),
wide AS (SELECT level, l, s, total, {fence} FROM b GROUP BY ALL),
best AS (SELECT g.lang, g.source, wide.* FROM (SELECT DISTINCT lang, source FROM s) g JOIN wide
         ON (level = 0 AND l = lang AND wide.s = g.source AND total >= {least})
         OR (level = 1 AND l = lang AND total >= {least}) OR level = 2
         QUALIFY row_number() OVER (PARTITION BY g.lang, g.source ORDER BY level) = 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce({inside}, true) AS kept
FROM f LEFT JOIN best ON f.lang = best.lang AND f.source = best.source"""


def chat_windows_sql(planted: str) -> str:
    token = chat.TOKEN.replace(r"\u000b", r"\x0b")
    span, history = chat.SPAN, chat.HISTORY
    return rf"""
WITH base AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
              UNION ALL VALUES (-7, 0, 'user', '{planted}'), (-7, 1, 'assistant', '{planted}')),
m AS (SELECT *, '### ' || url_encode(role) || ': ' AS head,
             replace(replace(replace(text, '\', '\\'), '##', '#\#'), '</turn>', '<\/turn>') AS body FROM base),
c AS (SELECT *, length(head) + length(body) + 8 AS chars,
             len(regexp_extract_all(head || body || '</turn>' || chr(10), '{token}')) AS n FROM m),
p AS (SELECT *, CAST(sum(n) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS BIGINT) - n
             AS a FROM c),
l AS (SELECT *, max(CASE WHEN a = 0 AND role = 'system' THEN n END) OVER (PARTITION BY conv_id) AS lead FROM p),
r AS (SELECT *, CASE WHEN lead <= {span // 2} THEN {span} - lead ELSE {span} END AS room FROM l),
o AS (SELECT *, a = 0 AND role = 'system' AS sys,
             2 * (a // room) + CASE WHEN a // room <> (a + n - 1) // room THEN 1 ELSE 0 END AS win FROM r),
s AS (SELECT conv_id, win, min(a) AS start FROM o WHERE NOT sys GROUP BY ALL),
again AS (SELECT o.conv_id, chars FROM o JOIN s ON o.conv_id = s.conv_id AND o.win <> s.win
          AND a < start AND start <= a + {history} WHERE NOT sys
          UNION ALL
          SELECT o.conv_id, chars FROM o JOIN (SELECT * FROM s QUALIFY win > min(win) OVER (PARTITION BY conv_id)) x
          ON o.conv_id = x.conv_id WHERE sys AND n <= {span // 2}),
extra AS (SELECT conv_id, sum(chars) AS chars FROM again GROUP BY ALL),
learned AS (SELECT conv_id, coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS t,
                   string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
                   count(*) AS n_turns, sum(chars) AS chars FROM o GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(t) AS BIGINT) AS loss_chars,
       sha256(t) AS loss_sha256, CAST(learned.chars + coalesce(extra.chars, 0) AS BIGINT) AS formatted_chars
FROM learned LEFT JOIN extra USING (conv_id)"""


def suffix_runs_sql(width: int = 50) -> str:
    return f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
n AS (SELECT doc_id, x, CAST(length(x) // 2 AS BIGINT) AS n FROM d),
blocks AS (SELECT doc_id, pos, substr(x, 2 * pos + 1, 4096 + 2 * {width}) AS y, n
           FROM (SELECT *, unnest(generate_series(0, n - {width}, 2048)) AS pos FROM n WHERE n >= {width})),
k AS (SELECT doc_id, pos + j AS s, substr(y, 2 * j + 1, 2 * {width}) AS w
      FROM (SELECT *, unnest(generate_series(0, least(2047, n - {width} - pos))) AS j FROM blocks)),
f AS (SELECT md5(w) AS h, min(doc_id) AS m FROM k GROUP BY h),
c AS (SELECT doc_id, s FROM k JOIN f ON md5(w) = h WHERE m < doc_id),
r AS (SELECT *, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + {width} THEN 0 ELSE 1 END AS new FROM c),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS span FROM r),
spans AS (SELECT doc_id, span, min(s) AS a, max(s) + {width} AS b FROM g GROUP BY ALL),
pieces AS (SELECT n.doc_id, a, substr(x, 2 * coalesce(lag(b) OVER w, 0) + 1, 2 * (a - coalesce(lag(b) OVER w, 0))) AS p,
                  b FROM spans JOIN n USING (doc_id) WINDOW w AS (PARTITION BY spans.doc_id ORDER BY a)),
kept AS (SELECT doc_id, string_agg(p, '' ORDER BY a) AS p, max(b) AS b, CAST(sum(b - a) AS BIGINT) AS gone,
                count(*) AS spans FROM pieces GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(spans, 0) AS n_spans,
       sha256(unhex(coalesce(p, '') || substr(x, 2 * coalesce(b, 0) + 1))) AS kept_sha256
FROM n LEFT JOIN kept USING (doc_id)"""


PACKED_NEGATIVES = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
             CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, vec_id AS negative_id, positive_score,
       score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 5"""


COLLOCATIONS = r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
           FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM pieces),
places AS (SELECT lang, words, unnest(generate_series(1, len(words))) AS i FROM w),
grams AS (SELECT lang, words[i:i + k] AS g FROM places, (VALUES (0), (1), (2), (3)) s(k) WHERE i + k <= len(words)),
f AS (SELECT lang, g, len(g) AS size, CAST(count(*) AS HUGEINT) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
total AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM w GROUP BY lang),
cuts AS (SELECT lang, g, size, f AS a, unnest(generate_series(1, size - 1)) AS k FROM f WHERE size > 1),
each AS (SELECT c.*, x.f AS l, y.f AS r, 2000000 * a // (x.f + y.f) AS score FROM cuts c
         JOIN f x ON c.lang = x.lang AND c.g[1:k] = x.g JOIN f y ON c.lang = y.lang AND c.g[k + 1:] = y.g),
cand AS (SELECT * FROM each QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
spans AS (SELECT lang, f, g[i:i + m] AS part FROM (
            SELECT lang, f, g, size, i, unnest(generate_series(1, size - i)) AS m FROM (
              SELECT lang, f, g, size, unnest(generate_series(1, size - 1)) AS i FROM f WHERE size > 2))
          WHERE m + 1 < size),
held AS (SELECT lang, part, max(f) AS f FROM spans GROUP BY ALL)
SELECT cand.lang, row_number() OVER o AS rank, array_to_string(cand.g, ' ') AS phrase, CAST(a AS BIGINT) AS a,
       CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score
FROM cand JOIN total USING (lang) LEFT JOIN held ON cand.lang = held.lang AND cand.g = held.part
WHERE held.f IS NULL OR 100 * held.f < 80 * a
WINDOW o AS (PARTITION BY cand.lang ORDER BY score DESC, a DESC, encode(array_to_string(cand.g, ' ')))
QUALIFY row_number() OVER o <= 2000"""
