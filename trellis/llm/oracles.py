"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP5 = rf"""
WITH base AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t, {WORDS} AS w FROM documents
), measured AS (
  SELECT rid, doc_id, source, w, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM base
), wins AS (
  SELECT rid, unnest(range(1, len(w) - 3)) AS i, w FROM measured WHERE len(w) >= 5
), keyed AS (
  SELECT rid, i, array_to_string(w[i:i+4], ' ') AS k FROM wins
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM keyed) WHERE c > 1
), covered AS (
  SELECT rid, sum(least(5, coalesce(nxt - i, 5))) AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM twice) GROUP BY rid
), full_ AS (
  SELECT m.rid, doc_id, source, n_words, word_chars, n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM measured m LEFT JOIN covered c ON m.rid = c.rid
), judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM full_
), per AS (
  SELECT source, count(*) AS n, count_if(base_failed) AS f1, count_if(10 * n_symbols > n_words) AS f2, count_if(100 * n_dup_lines > 30 * n_lines) AS f3, count_if(word_chars > 25 * n_words) AS f4 FROM judged GROUP BY source
), rules AS (
  SELECT source, n, unnest([1, 2, 3, 4]) AS rule, unnest([f1, f2, f3, f4]) AS failed FROM per
), prior AS (
  SELECT rule, sum(failed)::DOUBLE / sum(n) AS m, var_pop(failed::DOUBLE / n) AS v FROM rules GROUP BY rule
), hosts AS (
  SELECT source, max((failed + m * k) / (n + k)) <= 0.5 AS ok
  FROM rules JOIN (SELECT rule, m, CASE WHEN v <= 0 THEN 1000.0 ELSE greatest(2.0, least(1000.0, m * (1 - m) / v - 1)) END AS k FROM prior) USING (rule) GROUP BY source
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND coalesce(h.ok, true) AS kept
FROM judged j LEFT JOIN hosts h ON j.source IS NOT DISTINCT FROM h.source
"""

OP6 = rf"""
WITH sized AS (
  SELECT row_number() OVER () AS rid, doc_id, source, len({WORDS})::BIGINT AS size,
    (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS u
  FROM documents
), by0 AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM sized GROUP BY source
), by1 AS (
  SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS rest,
    sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_
  FROM by0
), by2 AS (
  SELECT *, rest / open_ * w >= 3 * source_size AS filled FROM by1
), by3 AS (
  SELECT *, max(CASE WHEN NOT filled THEN rest / open_ END) OVER () AS level FROM by2
), goals AS (
  SELECT source, source_size, CASE WHEN filled THEN (3 * source_size)::DOUBLE ELSE level * w END AS target FROM by3
), goal2 AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM goals
), goal3 AS (
  SELECT *, CASE WHEN source_size > 0 THEN target - whole * source_size ELSE 0 END AS rest FROM goal2
), weighed AS (
  SELECT *, CASE WHEN size < 64 THEN 1.0::DOUBLE WHEN size < 512 THEN 2.0::DOUBLE ELSE 4.0::DOUBLE END AS x FROM sized
), class0 AS (
  SELECT s.source, x, rest, sum(size)::DOUBLE AS words FROM weighed s JOIN goal3 g ON s.source IS NOT DISTINCT FROM g.source GROUP BY s.source, x, rest
), class1 AS (
  SELECT *, CASE WHEN sum(words * x) OVER low > 0 THEN (rest - coalesce(sum(words) OVER high, 0)) / sum(words * x) OVER low ELSE 0 END AS c FROM class0
  WINDOW high AS (PARTITION BY source ORDER BY x DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), low AS (PARTITION BY source ORDER BY x DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), class2 AS (
  SELECT source, x, c * x >= 1 AS filled, coalesce(max(CASE WHEN c * x < 1 THEN c END) OVER (PARTITION BY source), 0) AS level,
    rest - sum(CASE WHEN c * x >= 1 THEN words ELSE 0 END) OVER (PARTITION BY source) AS rest FROM class1
), ranked AS (
  SELECT s.rid, s.doc_id, s.source, s.size, g.source_size, g.target, g.whole + filled::BIGINT AS whole, k.rest,
    CASE WHEN NOT filled AND level * k.x > 0 THEN u / (1 - u) / (level * k.x / (1 - level * k.x)) END AS q
  FROM weighed s JOIN goal3 g ON s.source IS NOT DISTINCT FROM g.source JOIN class2 k ON s.source IS NOT DISTINCT FROM k.source AND s.x = k.x
), summed AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM ranked
)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN q IS NOT NULL AND upto - size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM summed
"""

OP4 = """
WITH q AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM q a JOIN q b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM pairs
)
SELECT * FROM ranked WHERE rank <= 5
"""

OP8 = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS hex, max(page_id) OVER (PARTITION BY payload) AS last FROM p
)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
      (('0x' || substr(hex || '0', 1 + (5 * i) // 4, 2))::INT >> (3 - (5 * i) % 4)) & 31), 1)), '') AS payload_digest,
  CASE WHEN last IS NULL OR page_id IS NOT DISTINCT FROM last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN last IS NULL OR page_id IS NOT DISTINCT FROM last THEN NULL ELSE last END AS refers_to
FROM d
"""

OP13 = r"""
WITH RECURSIVE codes AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t
), filled AS (
  SELECT row_number() OVER () AS rid, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 AS k
  FROM conversations, codes
), damaged AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE k WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM filled
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS place,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth, regexp_replace(text, '[\x20\x09-\x0D]', '', 'g') AS bare
  FROM damaged
), flagged AS (
  SELECT conv_id, turn, role, text, place, left(role, 1) AS i, CASE WHEN bare = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
    coalesce(lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY place) || left(role, 1) NOT IN ('su', 'ua', 'au'), false) AS illegal
  FROM ordered
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'blank') AS blank, count_if(fault = 'duplicate') AS duplicate,
    count_if(fault = 'truncated') AS truncated, count_if(illegal) AS illegal, max(place) AS n
  FROM flagged GROUP BY conv_id
), fold AS (
  SELECT conv_id, 0::BIGINT AS place, 0::BIGINT AS ec, '' AS ea, 1000000000::BIGINT AS sc, '' AS sa, 1000000000::BIGINT AS uc, '' AS ua, 1000000000::BIGINT AS ac, '' AS aa FROM counts
  UNION ALL
  SELECT conv_id, place, ec, ea, s.c, s.x, u.c, u.x, a.c, a.x FROM (
    SELECT conv_id, place, ec + 3 AS ec, ea || 'D' AS ea,
      list_min(list_filter([{c: sc + 3, x: sa || 'D'}, CASE WHEN free AND i = 's' THEN {c: ec + cut, x: ea || 'K'} END], lambda z: z IS NOT NULL)) AS s,
      list_min(list_filter([{c: uc + 3, x: ua || 'D'}, CASE WHEN free THEN {c: ec + us, x: ea || ul} END, CASE WHEN free THEN {c: sc + us, x: sa || ul} END,
        CASE WHEN free THEN {c: ac + us, x: aa || ul} END, CASE WHEN free THEN {c: uc + 2 + us, x: ua || 'J' || ul} END], lambda z: z IS NOT NULL)) AS u,
      list_min(list_filter([{c: ac + 3, x: aa || 'D'}, CASE WHEN free THEN {c: uc + s_, x: ua || al} END, CASE WHEN free THEN {c: ec + 2 + s_, x: ea || 'I' || al} END,
        CASE WHEN free THEN {c: sc + 2 + s_, x: sa || 'I' || al} END, CASE WHEN free THEN {c: ac + 2 + s_, x: aa || 'I' || al} END], lambda z: z IS NOT NULL)) AS a
    FROM (
      SELECT f.*, r.i, coalesce(r.fault, '') NOT IN ('blank', 'duplicate') AS free, CASE WHEN r.fault = 'truncated' THEN 1 ELSE 0 END AS cut,
        CASE WHEN i = 'u' THEN 0 ELSE 2 END + CASE WHEN r.fault = 'truncated' THEN 1 ELSE 0 END AS us, CASE WHEN i = 'u' THEN 'K' ELSE 'R' END AS ul,
        CASE WHEN i = 'a' THEN 0 ELSE 2 END + CASE WHEN r.fault = 'truncated' THEN 1 ELSE 0 END AS s_, CASE WHEN i = 'a' THEN 'K' ELSE 'S' END AS al
      FROM (SELECT conv_id, place + 1 AS place, ec, ea, sc, sa, uc, ua, ac, aa FROM fold) f
      JOIN flagged r ON r.conv_id IS NOT DISTINCT FROM f.conv_id AND r.place = f.place)
  )
), best AS (
  SELECT f.conv_id, list_min([{c: ec, x: ea}, {c: ac, x: aa}, {c: uc + 2, x: ua || 'J'}]) AS b FROM fold f JOIN counts c ON c.conv_id IS NOT DISTINCT FROM f.conv_id AND f.place = c.n
), edits AS (
  SELECT conv_id, b, unnest(l) AS edit, generate_subscripts(l, 1) AS place FROM (SELECT conv_id, b, regexp_extract_all(b.x, '[IJ]?[DKRS]|[IJ]$') AS l FROM best)
), lines AS (
  SELECT e.conv_id, e.place, concat_ws(chr(10), CASE WHEN starts_with(edit, 'I') THEN 'user:' WHEN starts_with(edit, 'J') THEN 'assistant:' END,
    CASE right(edit, 1) WHEN 'K' THEN role || ':' || text WHEN 'R' THEN 'user:' || text WHEN 'S' THEN 'assistant:' || text END) AS line, right(edit, 1) <> 'D' OR length(edit) > 1 AS said
  FROM edits e LEFT JOIN flagged r ON r.conv_id IS NOT DISTINCT FROM e.conv_id AND r.place = e.place
), texts AS (
  SELECT conv_id, string_agg(line, chr(10) ORDER BY place) AS repaired FROM lines WHERE said GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.c, 0)::BIGINT AS cost, coalesce(translate(b.x, 'JS', 'IR'), '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM o.conv_id
"""

ORACLES: dict[str, str] = {"op4_impact_topk": OP4, "op8_warc_zstd": OP8, "op5_host_rules": OP5, "op6_pareto_mix": OP6, "op13_conversation_repair": OP13}
