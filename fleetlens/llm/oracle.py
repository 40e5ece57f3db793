"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

SQL: dict[str, str] = {}

# Words of a text as a list; A-Z lowered where LOWERED is used.
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL["op5_neardup"] = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce({_WORDS.format(_LOWERED)}, []) AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS sh
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * common >= 75 * (x.n + y.n - common)
), reach(id, other) AS (
  SELECT a, b FROM links UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other
), comp AS (
  SELECT id, min(other) AS c FROM reach GROUP BY id
)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(c, w.doc_id)) AS component_id,
       w.doc_id = least(w.doc_id, coalesce(c, w.doc_id)) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN comp ON comp.id = w.doc_id
"""

SQL["op1_substring_dedup"] = f"""
WITH w AS (
  SELECT doc_id, coalesce({_WORDS.format("text")}, []) AS ws FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(ws[i : i + 49], ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)
), hits AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS low FROM windows) WHERE low < doc_id
), gone AS (
  SELECT DISTINCT doc_id, i + k AS i FROM hits, range(0, 50) r(k)
), kept AS (
  SELECT doc_id, i, ws[i] AS word
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w) ANTI JOIN gone USING (doc_id, i)
), texts AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM kept GROUP BY doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(t.text, '')) AS kept_sha256
FROM w LEFT JOIN texts t USING (doc_id)
"""

SQL["op6_warc"] = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to
FROM f
"""

SQL["op2_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_dot_product(q.e, d.e)::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id % 50 = 0 AND d.vec_id <> q.vec_id AND len(d.e) = len(q.e)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

# No seeds here: every pair of equal words, counted per document, item and shift.
SQL["op4_decontaminate"] = r"""
WITH d AS (
  SELECT doc_id, string_split_regex(lower(text), '[^\p{L}\p{N}]+') AS ws FROM documents WHERE text IS NOT NULL
), dw AS (
  SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM d
), t AS (
  SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS iw FROM benchmark
), tw AS (
  SELECT item_id, unnest(iw) AS w, unnest(range(len(iw))) AS j, len(iw) AS size, least(20, len(iw)) AS compared, CASE WHEN len(iw) < 13 THEN 100 ELSE 80 END AS percent FROM t WHERE len(iw) > 0
), same AS (
  SELECT doc_id, item_id, i - j AS shift, size, compared, percent, list(j) AS js, count(*) AS item_matched
  FROM dw JOIN tw USING (w) GROUP BY ALL HAVING count(*) * 100 >= compared * percent
), windows AS (
  SELECT *, len(list_filter(js, lambda j: j >= s AND j < s + compared)) AS matched
  FROM (SELECT *, unnest(range(size - compared + 1)) AS s FROM same)
), best AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, item_matched DESC, shift, s) AS r
  FROM windows WHERE matched * 100 >= compared * percent
)
SELECT doc_id, item_id, shift + s AS first_word, matched, compared, item_matched, size AS item_words FROM best WHERE r = 1
"""


def _spans(kind: str, ord_: int, pattern: str, group: int, least: int, extra: str = "true") -> str:
    """Spans of one kind in SQL: lengths of the pieces between matches, summed."""
    pattern = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, source, '{kind}' AS kind, {ord_} AS ord, start, start + length(a) AS stop, g AS value
  FROM (
    SELECT doc_id, source, unnest(a) AS a, unnest(g) AS g, unnest(range(1, len(a) + 1)) AS k,
           list_sum(list_transform(gaps[1 : k], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(a_all[1 : k - 1], lambda x: length(x))), 0)::BIGINT AS start
    FROM (
      SELECT doc_id, source, a, g, gaps, a AS a_all FROM (
        SELECT doc_id, source, regexp_extract_all(text, '{pattern}', 0) AS a, regexp_extract_all(text, '{pattern}', {group}) AS g,
               string_split_regex(text, '{pattern}') AS gaps FROM documents
      ) WHERE len(a) > 0
    )
  ) WHERE length(g) >= {least} AND {extra}"""


_ASSIGN = """(?i)(password|passwd|secret|token|api_?key)["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)""".replace("\\\\", "\\")
_MIXED = "regexp_matches(g, '[0-9]') AND regexp_matches(g, '[a-z]') AND regexp_matches(g, '[A-Z]')"

SQL["op7_secrets"] = f"""
WITH base AS (
  {_spans("assign", 0, _ASSIGN, 2, 6)} UNION ALL {_spans("access", 1, "AKIA[A-Z0-9]+", 0, 20)} UNION ALL {_spans("hex", 2, "[0-9a-f]+", 0, 24)}
), generic AS (
  SELECT * FROM ({_spans("owned", 3, "[A-Za-z0-9_-]+", 0, 20, _MIXED)}) m
  WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = m.doc_id AND b.start < m.stop AND m.start < b.stop)
), every AS (
  SELECT * FROM base UNION ALL SELECT * FROM generic
), judged AS (
  SELECT * FROM every JOIN (SELECT value, count(DISTINCT source) <= 2 AND count(DISTINCT doc_id) <= 100 AS live FROM every GROUP BY value) USING (value)
  WHERE kind <> 'owned' OR live
), docs AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) FILTER (kind <> 'owned') AS base,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) AS spans,
         count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example
  FROM judged GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM documents LEFT JOIN docs USING (doc_id)
"""


def _cluster_round(r: int) -> str:
    """Assignment ``a{r}`` to the centroids ``c{r}``, and the centroids after it."""
    return f"""
, a{r} AS MATERIALIZED (
  SELECT vec_id, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
    SELECT e.vec_id, c.c, sum((e.x - c.x) * (e.x - c.x))::BIGINT AS d FROM e JOIN c{r} c USING (i) GROUP BY ALL
  ) GROUP BY vec_id
), s{r} AS (
  SELECT a.c, e.i, sum(e.x)::BIGINT AS s, count(*)::BIGINT AS n FROM a{r} a JOIN e USING (vec_id) GROUP BY ALL
), c{r + 1} AS MATERIALIZED (
  SELECT c.c, c.i, coalesce((s - ((s % n) + n) % n) // n, c.x) AS x FROM c{r} c LEFT JOIN s{r} s USING (c, i)
)"""


SQL["op12_clusters"] = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), e AS MATERIALIZED (
  SELECT vec_id, unnest(v) AS x, unnest(range(64)) AS i FROM v
), c0 AS MATERIALIZED (
  SELECT c, unnest(v) AS x, unnest(range(64)) AS i
  FROM (SELECT v, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c FROM v) WHERE c < 16
)
{"".join(_cluster_round(r) for r in range(4))}
, h AS (
  SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c3 GROUP BY c
)
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a3 JOIN h USING (c)
"""


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text, from a table ``crc(t)`` of 256 numbers."""
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295::BIGINT)"


_LEVELS = 12  # periods below 6 * 2**_LEVELS


def _period_level(k: int) -> str:
    """Hashes of 6 * 2**k words, and the positions where they stand again at a
    distance whose double they reach (the first level: below 12)."""
    size, low = 6 * 2**k, 6 * 2**k if k else 1
    half = size // 2
    hashes = (
        "SELECT doc_id, i, hash(ws[i + 1 : i + 6]) AS h FROM p WHERE i + 6 <= n"
        if k == 0
        else f"SELECT * FROM (SELECT doc_id, i, hash(h, lead(h, {half}) OVER (PARTITION BY doc_id ORDER BY i)) AS h, lead(i, {half}) OVER (PARTITION BY doc_id ORDER BY i) AS j FROM g{k - 1}) WHERE j IS NOT NULL"
    )
    return f"""
, g{k} AS MATERIALIZED (
  {hashes}
), r{k} AS MATERIALIZED (
  SELECT doc_id, i, h FROM g{k} WHERE (doc_id, h) IN (SELECT (doc_id, h) FROM g{k} GROUP BY doc_id, h HAVING count(*) > 1)
), m{k} AS (
  SELECT a.doc_id, b.i - a.i AS q, a.i, {size} AS size FROM r{k} a JOIN r{k} b USING (doc_id, h) WHERE b.i - a.i BETWEEN {low} AND {2 * size - 1}
)"""


SQL["op13_periodic_runs"] = rf"""
WITH crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, i) AS c FROM range(256) r(i)
  )
), w AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws, {_crc32("doc_id::VARCHAR")} AS h FROM documents, crc
), f AS (
  SELECT doc_id, ws, h, len(ws) AS n, h // 10 AS g FROM w
), d AS MATERIALIZED (
  SELECT doc_id, n, CASE WHEN h % 10 <> 0 OR n = 0 THEN ws ELSE list_transform(range(n), lambda i: ws[CASE WHEN i < g % n THEN i ELSE g % n + (i - g % n) % (1 + (n - g % n) // (3 + g % 8)) END + 1]) END AS ws
  FROM f
), p AS (
  SELECT doc_id, n, ws, unnest(range(n)) AS i FROM d
)
{"".join(_period_level(k) for k in range(_LEVELS))}
, m AS (
  {" UNION ALL ".join(f"SELECT * FROM m{k}" for k in range(_LEVELS))}
), islands AS (
  SELECT doc_id, q, min(i) AS start, max(i) - min(i) + any_value(size) + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m) GROUP BY doc_id, q, island
), long AS (
  SELECT * FROM islands WHERE length >= greatest(12, 2 * q)
), runs AS MATERIALIZED (
  SELECT * FROM long a WHERE NOT EXISTS (
    SELECT 1 FROM long b WHERE b.doc_id = a.doc_id AND b.q < a.q AND b.start <= a.start AND b.start + b.length >= a.start + a.length)
), per AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS listed,
         arg_min({{'s': start, 'l': length, 'q': q}}, (-length, start, q)) AS top
  FROM runs GROUP BY doc_id
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(start + q, start + length)) AS i FROM runs
), kept AS (
  SELECT doc_id, string_agg(ws[i + 1], ' ' ORDER BY i) AS text FROM (SELECT * FROM p ANTI JOIN gone USING (doc_id, i)) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, top.s::BIGINT AS start, top.l::BIGINT AS length, top.q::BIGINT AS period,
       (1000 * top.l // top.q)::BIGINT AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM d LEFT JOIN per USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def _personal(kind: str, ord_: int, pattern: str, test: str, entity: str) -> str:
    """Base spans of one kind with their entity and the gaps beside them."""
    return f"""
  SELECT doc_id, text, '{kind}' AS kind, {ord_} AS ord, start, start + length(a) AS stop, '{kind} ' || {entity} AS entity, before, after
  FROM (
    SELECT doc_id, text, unnest(a) AS a, unnest(gaps[1 : len(a)]) AS before, unnest(gaps[2 :]) AS after, unnest(range(1, len(a) + 1)) AS k,
           list_sum(list_transform(gaps[1 : k], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(a_all[1 : k - 1], lambda x: length(x))), 0)::BIGINT AS start
    FROM (
      SELECT doc_id, text, a, gaps, a AS a_all FROM (
        SELECT doc_id, text, regexp_extract_all(text, '{pattern}', 0) AS a, string_split_regex(text, '{pattern}') AS gaps FROM documents
      ) WHERE len(a) > 0
    )
  ) WHERE {test}"""


_BLANK = r"\x20\x09-\x0D"
_PART = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_DIGITS = "regexp_replace(a, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum(list_transform(string_split(reverse({_DIGITS}), ''), lambda x, i: CASE WHEN i % 2 = 1 THEN x::INT WHEN x::INT > 4 THEN 2 * x::INT - 9 ELSE 2 * x::INT END)) % 10 = 0"""
_BEFORE = f"regexp_replace(CASE WHEN length(before) > 48 THEN right(before, 48) ELSE before END, '[^{_BLANK}]+$', '')"
_AFTER = f"regexp_replace(left(after, 48), '^[^{_BLANK}]+', '')"
_AROUND = f"""CASE WHEN length(before) > 48 THEN regexp_replace({_BEFORE}, '^[^{_BLANK}]+', '') ELSE {_BEFORE} END || ' ' ||
    CASE WHEN length(after) > 48 THEN regexp_replace({_AFTER}, '[^{_BLANK}]+$', '') ELSE {_AFTER} END"""


def _term(word: str) -> str:
    return rf"regexp_extract({word}, '^[^\p{{L}}\p{{N}}]*(\p{{L}}{{4,}})[^\p{{L}}\p{{N}}]*$', 1)"


SQL["op11_disclosure"] = rf"""
WITH base AS MATERIALIZED (
  {_personal("email", 0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true", "lower(a)")} UNION ALL
  {_personal("ip", 1, r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", f"regexp_full_match(a, '{_PART}(\\.{_PART}){{3}}')", "a")} UNION ALL
  {_personal("card", 2, r"[0-9]([\x20-]?[0-9])+", f"CASE WHEN length({_DIGITS}) BETWEEN 14 AND 19 THEN {_LUHN} ELSE false END", _DIGITS)} UNION ALL
  {_personal("phone", 3, r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 10 AND 15", _DIGITS)}
), tokens AS MATERIALIZED (
  SELECT doc_id, text, token, start FROM (
    SELECT doc_id, text, token, (sum(length(token)) OVER (PARTITION BY doc_id ORDER BY k) - length(token))::BIGINT AS start
    FROM (SELECT doc_id, text, unnest(t) AS token, unnest(range(len(t))) AS k FROM (SELECT doc_id, text, regexp_extract_all(text, '[^{_BLANK}]+|[{_BLANK}]+') AS t FROM documents))
  )
), words AS MATERIALIZED (
  SELECT doc_id, text, lower({_term("token")}) AS term, start + length(regexp_extract(token, '^[^\p{{L}}\p{{N}}]*')) AS start, length({_term("token")}) AS size
  FROM tokens WHERE {_term("token")} <> ''
), near AS MATERIALIZED (
  SELECT DISTINCT entity, text, lower({_term("w")}) AS term
  FROM (SELECT entity, text, unnest(string_split_regex({_AROUND}, '[{_BLANK}]+')) AS w FROM base) WHERE {_term("w")} <> ''
), entities AS (
  SELECT entity FROM base GROUP BY entity HAVING count(DISTINCT text) * 16 <= (SELECT count(DISTINCT coalesce(text, 'null')) FROM documents)
), pairs AS (
  SELECT term, max(n) AS n_pair FROM (SELECT term, entity, count(*) AS n FROM near JOIN entities USING (entity) GROUP BY ALL HAVING count(*) >= 2) GROUP BY term
), terms AS (
  SELECT term, 2 * n_pair >= n_term AS gone FROM (SELECT term, count(DISTINCT text) AS n_term FROM words GROUP BY term) JOIN pairs USING (term) WHERE 4 * n_pair >= n_term
), spans AS (
  SELECT doc_id, kind, ord, start, stop FROM base UNION ALL
  SELECT doc_id, CASE WHEN gone THEN 'reveals' ELSE 'hints' END, CASE WHEN gone THEN 4 ELSE 5 END, start, start + size FROM words JOIN terms USING (term)
), docs AS (
  SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in ("email", "ip", "card", "phone", "reveals", "hints"))},
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) FILTER (ord < 4) AS base,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) AS spans
  FROM spans GROUP BY doc_id
)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in ("email", "ip", "card", "phone", "reveals", "hints"))},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN docs USING (doc_id)
"""
