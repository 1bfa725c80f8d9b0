"""SQL for the queries that SQL can express.

Scores of fitted or learned models (op1, op2, op7), hashes that SQL lacks (op3, op10) and
tokenizers (op5, op9) have none; tests/llm compares them with brute force.
"""

ORACLES: dict[str, str] = {}

ORACLES["op4_nearest"] = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL)) = 0
    AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored
)
SELECT query_id, r::INTEGER AS rank, vec_id, score FROM ranked WHERE r <= 5
"""

ORACLES["op6_urls"] = """
WITH rules(h, p, v) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
         ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), u AS (
  SELECT page_id, row_number() OVER () AS n, coalesce(url, '') AS u FROM pages
), s AS (
  SELECT page_id, n,
    translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
              'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM u
), best AS (
  SELECT n, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
  FROM s JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY n
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM s LEFT JOIN best USING (n)
"""

ORACLES["op8_decontaminate"] = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS n, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), item AS (
  SELECT item_id, w, least(len(w), 10) AS l, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i
  FROM b WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item_id, l, array_to_string(w[i : i + l - 1], ' ') AS t FROM item
), place AS (
  SELECT n, l, w, unnest(range(1, len(w) - l + 2)) AS i
  FROM d, (SELECT DISTINCT l FROM windows) WHERE len(w) >= l
), hit AS (
  SELECT n, i, l, item_id FROM (
    SELECT n, i, l, array_to_string(w[i : i + l - 1], ' ') AS t FROM place
  ) JOIN windows USING (l, t)
), words AS (
  SELECT n, count(DISTINCT p) AS n_hit FROM (
    SELECT DISTINCT n, unnest(range(i, i + l)) AS p FROM hit
  ) GROUP BY n
), items AS (
  SELECT n, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT n, item_id::VARCHAR AS item_id FROM hit) GROUP BY n
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (n) LEFT JOIN items USING (n)
"""

ORACLES["op12_lexical"] = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), q AS (
  SELECT DISTINCT item_id, text, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark
), found AS (
  SELECT r, doc_id, n, term, count(*) AS tf
  FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY ALL
), total AS (
  SELECT count(*) AS docs, sum(len(w))::BIGINT AS terms FROM d WHERE len(w) > 0
), weight AS (
  SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w
  FROM found, total GROUP BY term, docs
), scored AS (
  SELECT item_id, text, r, doc_id,
    sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms))))::BIGINT
      AS score
  FROM q JOIN found USING (term) JOIN weight USING (term), total GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id) AS k
  FROM scored WHERE score > 0
)
SELECT item_id, k::INTEGER AS rank, doc_id, score FROM ranked WHERE k <= 10
"""


def _edit(state: str, cost: str, letters: str, line: str = "''") -> str:
    """SQL of a state (cost in 9 digits, edits, a sign below all letters, lines) after an edit."""
    sign, at = "chr(1)", f"instr({state}, chr(1))"
    body = f"{state}[{at} + 1:]"
    joined = f"CASE WHEN {line} = '' THEN {body} WHEN {body} = '' THEN {line} ELSE {body} || chr(10) || {line} END"
    return (
        f"(lpad(({state}[1:9]::INT + {cost})::VARCHAR, 9, '0') || {state}[10:{at} - 1] || '{letters}' "
        f"|| {sign} || {joined})"
    )


def _conversations_sql() -> str:
    user, assistant = "('user:' || text)", "('assistant:' || text)"
    own = "(role || ':' || text)"
    u1 = ", ".join(["u", *(_edit(x, "3", "I", "'user:'") for x in "bsa")])
    both = "('user:' || chr(10) || 'assistant:')"
    a1 = ", ".join(["a", _edit("u", "3", "I", "'assistant:'"), *(_edit(x, "6", "II", both) for x in "bs")])
    before = "least(b, s, a1)"

    def kept(initial: str, edit: str) -> str:
        return f"CASE WHEN ok AND initial = '{initial}' THEN {edit} END"

    return rf"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), hashed AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_concat([4294967295::BIGINT],
      list_transform(range(1, length(k) + 1), lambda i: ascii(k[i])::BIGINT)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
      lambda x, j: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)),
    4294967295::BIGINT) % 20 AS d FROM keyed
), damaged AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
    CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN d = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM hashed WHERE d <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id
    ORDER BY turn NULLS FIRST, role, left(text, 40), text, copy) AS i FROM damaged
), judged AS (
  SELECT *, left(role, 1) AS initial, regexp_extract(text, '([^ 	-])[ 	-]*$', 1) AS final,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS behind
  FROM placed
), faulty AS (
  SELECT *, CASE WHEN final = '' THEN 'blank' WHEN again THEN 'duplicate'
    WHEN final IN ('.', '!', '?') THEN '' ELSE 'truncated' END AS fault FROM judged
), edited AS (
  SELECT conv_id, i, initial, role, text, fault NOT IN ('blank', 'duplicate') AS ok,
    CASE fault WHEN 'truncated' THEN 3 ELSE 0 END AS t FROM faulty
), path AS (
  SELECT conv_id, 0::BIGINT AS i, '000000000' || chr(1) AS b, NULL::VARCHAR AS s, NULL::VARCHAR AS u,
    NULL::VARCHAR AS a FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, {_edit("b", "4", "D")} AS b,
    least({_edit("s", "4", "D")}, {kept("s", _edit("b", "t", "K", own))}) AS s,
    least({_edit("u1", "4", "D")}, CASE WHEN ok THEN {_edit(before, "3 + t", "R", user)} END,
      {kept("u", _edit(before, "t", "K", own))}) AS u,
    least({_edit("a1", "4", "D")}, CASE WHEN ok THEN {_edit("u1", "3 + t", "R", assistant)} END,
      {kept("a", _edit("u1", "t", "K", own))}) AS a
  FROM (SELECT e.*, b, s, least({u1}) AS u1, least({a1}) AS a1
    FROM path p JOIN edited e ON e.conv_id IS NOT DISTINCT FROM p.conv_id AND e.i = p.i + 1)
), counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (i > 1 AND behind || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id
), best AS (
  SELECT p.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
    coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
    least(b, a, {_edit("u", "3", "I", "'assistant:'")}, {_edit("s", "6", "II", both)}) AS x
  FROM path p LEFT JOIN counts c ON p.conv_id IS NOT DISTINCT FROM c.conv_id WHERE p.i = coalesce(c.n, 0)
)
SELECT conv_id, gaps, blank, duplicate, truncated, illegal, x[1:9]::BIGINT AS cost,
  x[10:instr(x, chr(1)) - 1] AS audit, sha256(x[instr(x, chr(1)) + 1:]) AS repaired_sha256 FROM best
"""


ORACLES["op11_conversations"] = _conversations_sql()
