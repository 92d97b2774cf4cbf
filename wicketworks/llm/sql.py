"""The same results in DuckDB SQL, where SQL can express them."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINES = f"""
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (
  SELECT doc_id, i, parts[i] AS line, translate(trim(parts[i], {SPACES}), '{UPPER}', '{LOWER}') AS key
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM cut)
),
shared AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (shared.key IS NOT NULL AND doc_id <> keeper) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (shared.key IS NULL OR doc_id = keeper), '')) AS kept_sha256
FROM lines LEFT JOIN shared USING (key) GROUP BY doc_id
"""

MIX = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len({WORDS.format("text")}), 0)::BIGINT AS size,
    ('0x' || substr(md5('mix/' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT AS draw
  FROM documents
),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [1, 2, 3][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM sized GROUP BY source
),
levels AS (
  SELECT *, 3 * source_size AS most,
    (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER limits, 0))::DOUBLE
      / (sum(weight) OVER () - coalesce(sum(weight) OVER limits, 0))::DOUBLE AS level,
    row_number() OVER (ORDER BY 3 * source_size / weight, source NULLS LAST) AS place
  FROM sources
  WINDOW limits AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
targets AS (
  SELECT source, source_size,
    least(most::DOUBLE, coalesce((SELECT arg_min(level, place) FROM levels WHERE level * weight <= most) * weight, most::DOUBLE)) AS target
  FROM levels
),
ranked AS (
  SELECT doc_id, size, draw, s.source, source_size, target,
    CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole,
    sum(size) OVER (PARTITION BY s.source ORDER BY draw) AS upto
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
),
ends AS (
  SELECT source, arg_min(draw, (missing, draw)) AS last_draw, min(missing) AS missing, any_value(extra) AS extra
  FROM (SELECT source, draw, greatest(0, target - whole * source_size) AS extra,
      abs(upto - greatest(0, target - whole * source_size)) AS missing FROM ranked)
  GROUP BY source
)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN extra > 0 AND missing < extra AND draw <= last_draw THEN 1 ELSE 0 END))::BIGINT AS taken
FROM ranked r JOIN ends e ON r.source IS NOT DISTINCT FROM e.source
"""

NEAR = f"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, {WORDS.format(f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")} AS w FROM documents
),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 3], ' ')) AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1)) + 1)) AS i FROM words)
),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id
  GROUP BY ALL
),
links AS MATERIALIZED (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * shared.n >= 80 * (x.n + y.n - shared.n)
),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
reached AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT doc_id, b FROM reached JOIN both_ways ON other = a),
found AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM found LEFT JOIN sizes USING (doc_id)
"""

VECTORS = """
WITH RECURSIVE units AS MATERIALIZED (
  SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u
  FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
  WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(v, v) > 0
),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM units a JOIN units b ON a.vec_id <> b.vec_id
  WHERE list_dot_product(a.u, b.u) >= 0.9
),
reached AS (SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT vec_id, b FROM reached JOIN links ON other = a),
found AS (SELECT vec_id, min(other) AS component_id FROM reached GROUP BY vec_id)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM found LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a) USING (vec_id)
"""

TOP_K = """
WITH codes AS (SELECT vec_id, list_transform(embedding[1:64], lambda x: coalesce(x > 0, false)) AS bits FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    len(list_filter(list_zip(q.bits, c.bits), lambda x: x[1] <> x[2]))::BIGINT AS distance
  FROM codes q JOIN codes c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INT AS rank, vec_id, distance
FROM pairs QUALIFY rank <= 10
"""

TERMS = rf"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

LEXICAL = f"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id,
    coalesce({TERMS}, []) AS terms
  FROM documents
),
sized AS (SELECT r, doc_id, terms, len(terms)::BIGINT AS n FROM words),
totals AS (SELECT count(*) FILTER (n > 0) AS docs, sum(n)::BIGINT AS len FROM sized),
counts AS (
  SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(terms) AS term FROM sized) GROUP BY ALL
),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM counts, totals GROUP BY term
),
asked AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest({TERMS}) AS term FROM benchmark)
  GROUP BY ALL
),
scored AS (
  SELECT item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // len))))::BIGINT AS score
  FROM asked JOIN counts USING (term) JOIN weights USING (term), totals GROUP BY ALL
)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
WHERE rank <= 20
"""

URLS = f"""
WITH rests AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM rests
)
SELECT page_id, host, path,
  CASE WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN ('.' || host) LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule,
  CASE WHEN rule IN ('example.com/de/', 'net/') THEN 'block' ELSE 'allow' END AS verdict
FROM parts
"""

#: The states that role initials can be in (0: none yet) are carried through the turns, with the cheapest way to each.
CONVERSATIONS = """
WITH RECURSIVE bits AS (
  SELECT i, i AS c, 0 AS step FROM (SELECT unnest(range(256)) AS i)
  UNION ALL
  SELECT i, xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END), step + 1 FROM bits WHERE step < 8
),
crc_table AS (SELECT i, c FROM bits WHERE step = 8),
keys AS (SELECT DISTINCT coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
crcs AS (
  SELECT name, 0 AS done, 4294967295 AS c FROM keys
  UNION ALL
  SELECT name, done + 1, xor(crcs.c >> 8, t.c) FROM crcs JOIN crc_table t ON t.i = xor(crcs.c & 255, ascii(substr(name, done + 1, 1)))
  WHERE done < length(name)
),
damage AS (SELECT name, xor(c, 4294967295) % 20 AS kind FROM crcs WHERE done = length(name)),
plain AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, kind
  FROM conversations JOIN damage ON name = coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')
),
hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM plain
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said
  FROM hurt
),
marked AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS role_before,
    CASE WHEN said = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM placed
),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (i > 1 AND left(role_before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM marked GROUP BY conv_id
),
moves(before, letter, after) AS (
  VALUES ('0', 's', 's'), ('0', 'u', 'u'), ('s', 'u', 'u'), ('a', 'u', 'u'), ('u', 'a', 'a')
),
inserts(before, after, cost, edits, lines) AS (
  VALUES ('0', '0', 0, '', []::VARCHAR[]), ('s', 's', 0, '', []), ('u', 'u', 0, '', []), ('a', 'a', 0, '', []),
    ('0', 'u', 3, 'I', ['user:']), ('s', 'u', 3, 'I', ['user:']), ('a', 'u', 3, 'I', ['user:']), ('u', 'a', 3, 'I', ['assistant:']),
    ('0', 'a', 6, 'II', ['user:', 'assistant:']), ('s', 'a', 6, 'II', ['user:', 'assistant:'])
),
ways AS (
  SELECT conv_id, 0::BIGINT AS i, after AS state, {'cost': cost::BIGINT, 'audit': edits, 'lines': lines} AS best
  FROM counted JOIN inserts ON before = '0'
  UNION ALL
  SELECT conv_id, i, state, min(best) FROM (
    SELECT e.conv_id, e.i, ins.after AS state,
      {'cost': e.cost + ins.cost, 'audit': e.audit || ins.edits, 'lines': list_concat(e.lines, ins.lines)} AS best
    FROM (
      SELECT w.conv_id, m.i, w.state, w.best.cost + 4 AS cost, w.best.audit || 'D' AS audit, w.best.lines AS lines
      FROM ways w JOIN marked m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.i = w.i + 1
      UNION ALL
      SELECT w.conv_id, m.i, v.after, w.best.cost + CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END, w.best.audit || 'K',
        list_append(w.best.lines, role || ':' || text)
      FROM ways w JOIN marked m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.i = w.i + 1
        JOIN moves v ON v.before = w.state AND v.letter = left(role, 1)
      WHERE fault NOT IN ('blank', 'duplicate')
      UNION ALL
      SELECT w.conv_id, m.i, v.after, w.best.cost + CASE WHEN fault = 'truncated' THEN 6 ELSE 3 END, w.best.audit || 'R',
        list_append(w.best.lines, CASE v.letter WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text)
      FROM ways w JOIN marked m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.i = w.i + 1
        JOIN moves v ON v.before = w.state AND v.letter <> 's'
      WHERE fault NOT IN ('blank', 'duplicate')
    ) e JOIN inserts ins ON ins.before = e.state
  ) GROUP BY conv_id, i, state
),
chosen AS (
  SELECT w.conv_id, min(best) AS best FROM ways w JOIN counted c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i
  WHERE state IN ('0', 'a') GROUP BY w.conv_id
),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit,
  sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM ids LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM ids.conv_id
  LEFT JOIN chosen x ON x.conv_id IS NOT DISTINCT FROM ids.conv_id
"""

SQL = {
    "op6_embedding_near_dedup": VECTORS,
    "op10_exact_top_k": TOP_K,
    "op4_line_dedup": LINES,
    "op7_mix_sources": MIX,
    "op8_minhash_near_dedup": NEAR,
    "op11_conversation_repair": CONVERSATIONS,
    "op12_url_filters": URLS,
    "op13_ranked_search": LEXICAL,
}
