"""The SQL equivalent of every registered query that has one, for DuckDB.

Word boundaries: RE2 has neither lookarounds nor a Unicode `\\b`, so words are compared as whole
tokens, and replacements consume the characters around a word; running a replacement twice
covers neighbours that share such a character.
"""

from __future__ import annotations

from cuespark.functions import lexicon
from cuespark.operators.label import _PROMPT_HEAD as LABEL_HEAD
from cuespark.operators.label import _PROMPT_TAIL as LABEL_TAIL
from cuespark.operators.scrub import _PROMPT_HEAD as SCRUB_HEAD
from cuespark.operators.scrub import _PROMPT_TAIL as SCRUB_TAIL
from cuespark.plans.corpus import CUE_SENTENCES
from cuespark.schema import FEMALE, MALE

W = r"[\p{L}\p{N}_]"
NOT_W = r"[^\p{L}\p{N}_]"
SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\p{Z}]"
NOT_SPACE = r"[^\x09-\x0D\x1C-\x20\x{85}\p{Z}]"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(words) -> str:
    return ", ".join(quoted(w) for w in words)


def tokens(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '{W}+')"


def hits(text: str, words) -> str:
    return f"list_filter({tokens(text)}, lambda t: t IN ({listed(words)}))"


def n_hits(text: str, words) -> str:
    return f"len({hits(text, words)})"


def strip(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '^{SPACE}+', ''), '{SPACE}+$', '')"


def word_count(text: str) -> str:
    return f"len(regexp_extract_all({text}, '{NOT_SPACE}+'))"


def brackets(text: str) -> str:
    return rf"len(regexp_extract_all({text}, '\[[^\n]*?\]'))"


def literal_count(text: str, literal: str) -> str:
    n = len(literal)
    return f"CAST((length({text}) - length(replace({text}, '{literal}', ''))) / {n} AS BIGINT)"


def r6(value: str) -> str:
    return f"(round({value}, 6) + 0.0::DOUBLE)"


def swap(text: str, words: str, to: str, tail: str = f"({NOT_W}|$)", flags: str = "gi") -> str:
    for _ in range(2):
        text = rf"regexp_replace({text}, '(^|{NOT_W})({words}){tail}', '\1{to}\3', '{flags}')"
    return text


def sql_pronouns(text: str) -> str:
    text = swap(text, "himself|herself", "[PRONOUN_REFLEXIVE]")
    # Letters as a stand-in, since the rule for `her` looks at the letter behind it.
    text = swap(text, "his|hers", "zzpossessivezz")
    text = swap(text, "her", "zzpossessivezz", rf"({SPACE}+\p{{L}})")
    text = f"replace({text}, 'zzpossessivezz', '[PRONOUN_POSSESSIVE]')"
    text = swap(text, "him|her", "[PRONOUN_OBJECT]")
    return swap(text, "he|she", "[PRONOUN]")


def sql_kinship(text: str) -> str:
    return swap(text, "|".join(lexicon.words_of(None, "kinship")), "[FAMILY_MEMBER]")


def sql_names(text: str, names=tuple(lexicon.NAMES)) -> str:
    return swap(text, "|".join(names), "[NAME]", flags="g")


def sql_titles(text: str) -> str:
    words = "|".join(lexicon.words_of(None, "title"))
    return swap(swap(text, words, "[TITLE]", r"(\.)").replace(r"[TITLE]\3", "[TITLE]"), words,
                "[TITLE]")


def sql_scrub(text: str) -> str:
    return sql_titles(sql_names(sql_kinship(sql_pronouns(text))))


def sql_gender(text: str) -> str:
    f, m = n_hits(text, lexicon.words_of(FEMALE)), n_hits(text, lexicon.words_of(MALE))
    return (
        f"CASE WHEN {f} > 0 AND {m} = 0 THEN 'FEMALE' WHEN {m} > 0 AND {f} = 0 THEN 'MALE' "
        "ELSE 'NEUTRAL' END"
    )


_N = len(CUE_SENTENCES)
_SENTENCES = f"list_extract([{listed(s for s, _ in CUE_SENTENCES)}], CAST(doc_id % {_N} AS INT) + 1)"
_GOLD = f"list_extract([{listed(g for _, g in CUE_SENTENCES)}], CAST(doc_id % {_N} AS INT) + 1)"

DOCUMENT_POSTS = f"""
  SELECT doc_id AS post_id, doc_id % 97 AS thread_id,
    {_SENTENCES} || ' ' || text AS raw_text, {_GOLD} AS gold,
    CASE WHEN lang = 'en' THEN 1.0 WHEN lang IN ('de', 'fr') THEN 0.0 END::DOUBLE AS female_pred
  FROM documents"""
BLANK = "chr(32) || chr(9) || chr(10) || chr(160) || chr(32)"
POSTS = f"""posts AS ({DOCUMENT_POSTS}
  UNION ALL
  SELECT -1 - doc_id, doc_id % 97, CASE WHEN toxic = 0 THEN {BLANK} END, 'NEUTRAL',
    CAST(quality AS DOUBLE)
  FROM labels)"""
KEPT = f"kept AS (SELECT * FROM posts WHERE regexp_matches(raw_text, '{NOT_SPACE}'))"
LABELLED = f"""labelled AS (
  SELECT *, {sql_gender('raw_text')} AS gender,
    'cues: ' || array_to_string(list_sort(list_distinct({hits('raw_text', lexicon.words_of())})), ' ')
      AS reasoning
  FROM kept)"""
SCRUBBED = f"""scrubbed AS (
  SELECT *, {sql_scrub('raw_text')} AS scrubbed_text FROM posts WHERE raw_text IS NOT NULL)"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


VECTORS = """vectors AS (
  SELECT vec_id, CASE label % 3 WHEN 0 THEN 'FEMALE' WHEN 1 THEN 'MALE' ELSE 'NEUTRAL' END AS gender,
    embedding
  FROM embeddings)"""
METHODS = """methods AS (
  SELECT vec_id, gender, 'full64' AS method, embedding FROM vectors
  UNION ALL
  SELECT vec_id, gender, 'half32', embedding[1:32] FROM vectors)"""


def _argmax(a: str) -> str:
    return (
        f"CASE list_position({a}, list_max({a})) WHEN 1 THEN 'FEMALE' WHEN 2 THEN 'MALE' "
        "ELSE 'NEUTRAL' END"
    )


PREDICTIONS = f"""predictions AS (
  SELECT vec_id, method, gender AS label, 'first three' AS model, 0 AS ord,
    {_argmax('embedding[1:3]')} AS prediction FROM methods
  UNION ALL
  SELECT vec_id, method, gender, 'last three', 1,
    {_argmax('embedding[len(embedding) - 2:]')} FROM methods
  UNION ALL
  SELECT vec_id, method, gender, 'constant', 2, 'FEMALE' FROM methods)"""
RESULTS = """results AS (
  SELECT method, model, ord, avg((label = prediction)::INT) AS accuracy, count(*) AS test_samples
  FROM predictions GROUP BY ALL)"""
JUDGED = "judged AS (SELECT post_id, gold AS label, gender AS prediction FROM labelled)"


def seeded(key: str, seed) -> str:
    return f"md5('{seed}:' || {key})"


def split_ctes(source: str, key: str, seed, share: str = "0.2", out: str = "parts") -> str:
    """Quotas by largest remainder, then a plain rank inside every class."""
    return f"""{out}_counts AS (
    SELECT gender, count(*) AS n, sum(count(*)) OVER () AS total,
      CAST(ceil({share} * sum(count(*)) OVER ()) AS BIGINT) AS n_test
    FROM {source} GROUP BY gender),
  {out}_shares AS (
    SELECT *, CAST(n * (total - n_test) // total AS BIGINT) AS base,
      row_number() OVER (ORDER BY (n * (total - n_test)) % total DESC, gender) AS place
    FROM {out}_counts),
  {out}_quotas AS (
    SELECT gender, n,
      base + CASE WHEN place <= total - n_test - sum(base) OVER () THEN 1 ELSE 0 END AS n_train
    FROM {out}_shares),
  {out} AS (
    SELECT s.*, CASE WHEN row_number() OVER (PARTITION BY s.gender ORDER BY {seeded('s.' + key, seed)})
        <= q.n - q.n_train THEN 'test' ELSE 'train' END AS split
    FROM {source} s JOIN {out}_quotas q USING (gender))"""


FOLDS = f"""fold_ranks AS (
    SELECT *, row_number() OVER (PARTITION BY gender ORDER BY {seeded('vec_id', 42)}) - 1 AS rank,
      row_number() OVER (ORDER BY gender, vec_id) - 1 AS place
    FROM vectors),
  fold_ends AS (
    SELECT gender, fold, sum(n) OVER (PARTITION BY gender ORDER BY fold) AS upto
    FROM (SELECT gender, place % 5 AS fold, count(*) AS n FROM fold_ranks GROUP BY ALL)),
  folds AS (
    SELECT r.vec_id, r.gender, (SELECT count(*) FROM fold_ends e
      WHERE e.gender = r.gender AND e.upto <= r.rank) AS fold
    FROM fold_ranks r)"""

_LABEL_SHAPES = """CASE post_id % 13 + CASE WHEN post_id % 13 < 0 THEN 13 ELSE 0 END
    WHEN 0 THEN '{"reasoning": "post ' || post_id || '", "answer": "FEMALE"}'
    WHEN 1 THEN '```json' || chr(10) || '{"reasoning": "post ' || post_id || '", "answer": "MALE"}' || chr(10) || '```'
    WHEN 2 THEN '```' || chr(10) || '{"reasoning": "post ' || post_id || '", "answer": "MALE"}' || chr(10) || '```'
    WHEN 3 THEN '  ' || chr(10) || '{"reasoning": "post ' || post_id || '", "answer": "female"} ' || chr(10)
    WHEN 4 THEN '{"reasoning": "post ' || post_id || '", "answer": "UNKNOWN"}'
    WHEN 5 THEN '{"reasoning": "post ' || post_id || '"}'
    WHEN 6 THEN 'No object here, post ' || post_id
    WHEN 7 THEN '{"reasoning": "", "answer": "NEUTRAL"}'
    WHEN 8 THEN '{"reasoning": "post ' || post_id || '", "answer": null}'
    WHEN 9 THEN '[1]'
    WHEN 10 THEN '{"reasoning": "post ' || post_id || '", "answer": "MALE"} extra'
    WHEN 11 THEN '{"reasoning": "post ' || post_id || '", "answer": " MALE"}' END"""
LABEL_ANSWERS = f"""answers AS (
  SELECT *, {strip(_LABEL_SHAPES)} AS raw FROM posts),
  unfenced AS (
  SELECT *, CASE WHEN starts_with(raw, '```json')
      THEN replace(replace(raw, '```json', ''), '```', '') ELSE raw END AS body FROM answers),
  typed AS (
  SELECT *, CASE WHEN json_valid(body) THEN body END AS j FROM unfenced),
  read AS (
  SELECT *, CASE WHEN j IS NULL THEN 0 WHEN json_type(j) <> 'OBJECT' THEN 1
      WHEN coalesce(json_type(j, '$.answer'), 'VARCHAR') <> 'VARCHAR' THEN 1 ELSE 0 END AS wrong_shape,
    upper(json_extract_string(j, '$.answer')) AS answer
  FROM typed),
  parsed AS (
  SELECT *, coalesce(answer IN ('FEMALE', 'MALE', 'NEUTRAL') AND wrong_shape = 0, FALSE) AS known
  FROM read)"""
_PARSED = """CASE WHEN known THEN answer ELSE 'NEUTRAL' END"""
_REASON = """CASE WHEN known THEN coalesce(json_extract_string(j, '$.reasoning'), '') ELSE '' END"""

_SCRUB_SHAPES = """CASE post_id % 11 + CASE WHEN post_id % 11 < 0 THEN 11 ELSE 0 END
    WHEN 0 THEN good WHEN 1 THEN '```json' || chr(10) || good || chr(10) || '```'
    WHEN 2 THEN '```' || chr(10) || good || '```' WHEN 3 THEN '  ' || good || chr(10)
    WHEN 4 THEN '{"scrubbed_text": 123}' WHEN 5 THEN '{"scrubbed_text": ""}'
    WHEN 6 THEN '{"other_field": "some value"}' WHEN 7 THEN good || ' extra'
    WHEN 8 THEN 'no braces at all' WHEN 9 THEN '[2]' END"""
SCRUB_ANSWERS = f"""good AS (
  SELECT post_id, raw_text, CAST(CASE WHEN raw_text IS NULL THEN '{{}}' ELSE
      json_object('scrubbed_text', {sql_scrub('raw_text')}) END AS VARCHAR) AS good FROM posts),
  answers AS (SELECT post_id, raw_text, {strip(_SCRUB_SHAPES)} AS raw FROM good),
  opened AS (
  SELECT *, CASE WHEN starts_with(raw, '```') AND contains(raw, chr(10))
      THEN substr(raw, strpos(raw, chr(10)) + 1) ELSE raw END AS body FROM answers),
  unfenced AS (
  SELECT *, CASE WHEN starts_with(raw, '```') AND ends_with(body, '```')
      THEN left(body, length(body) - 3) ELSE body END AS text FROM opened),
  typed AS (SELECT *, CASE WHEN json_valid(text) THEN text END AS j FROM unfenced),
  parsed AS (
  SELECT post_id, raw_text, CASE WHEN json_type(j, '$.scrubbed_text') = 'VARCHAR'
      AND json_extract_string(j, '$.scrubbed_text') <> ''
      THEN json_extract_string(j, '$.scrubbed_text') END AS value,
    post_id % 11 IN (10, -1) AS failed
  FROM typed)"""


def audit_sql(source: str, key: str, text: str) -> str:
    """Residual cues: word patterns on tokens, the dotted titles on tokens and separators."""
    parts = []
    for name, words in lexicon.AUDIT_WORDS.items():
        pattern = lexicon.audit_pattern(name)
        if name == "title":
            pieces = f"regexp_extract_all(lower({text}), '{W}+|{NOT_W}')"
            found = (
                f"list_transform(list_filter(range(1, len(p) + 1), lambda i: p[i] IN ('mr', 'mrs', "
                f"'ms') AND p[i + 1] = '.' AND regexp_matches(coalesce(p[i + 2], ''), '^{W}')), "
                "lambda i: p[i] || '.')"
            )
            parts.append(
                f"SELECT {key}, {text} AS t, {quoted(pattern)} AS pattern, {found} AS found "
                f"FROM (SELECT *, {pieces} AS p FROM {source})"
            )
        else:
            parts.append(
                f"SELECT {key}, {text} AS t, {quoted(pattern)} AS pattern, {hits(text, words)} "
                f"AS found FROM {source}"
            )
    return " UNION ALL ".join(parts)


_SAMPLED_ISSUES = f"""
      sample AS (SELECT * FROM scrubbed ORDER BY {seeded('post_id', 42)} LIMIT 100),
      found AS ({audit_sql('sample', 'post_id', 'scrubbed_text')})"""
_ISSUES = """SELECT post_id, substr(lower(t), 1, 100) || '...' AS text_snippet, pattern,
  array_to_string(found, ' ') AS missed_cues FROM found WHERE len(found) > 0"""


def digest_component(digest: str, j: int) -> str:
    return f"('0x' || substr({digest}, {4 * j + 1}, 4))::BIGINT"


def component(word: str, j: int) -> str:
    number = f"('0x' || substr({word}, {14 * (j // 8) + 1}, 14))::BIGINT"
    return f"(({number} >> {7 * (j % 8)}) & 127)"


def first_component(digests: str, j: int) -> str:
    return f"coalesce({component(f'{digests}[1]', j)} / 63.5 - 1.0, 0.0)::FLOAT::DOUBLE"


def mean_component(digests: str, j: int) -> str:
    total = f"list_sum(list_transform({digests}, lambda d: {component('d', j)}))"
    return f"coalesce({total} / len({digests}) / 63.5 - 1.0, 0.0)::FLOAT::DOUBLE"


def words_cte(source: str, text: str) -> str:
    return (
        f"worded AS (SELECT *, {tokens(f'coalesce({text}, chr(32))')} AS words FROM {source}),\n"
        "digested AS (SELECT *, list_transform(words, lambda w: md5(w)) AS digests,\n"
        "  list_transform(words, lambda w: md5(w || '#1')) AS digests_1 FROM worded)"
    )


def columns(make, n: int, source: str) -> str:
    """Components 16 and up come from a digest of their own."""
    return ", ".join(
        f"{r6(make(source if j < 16 else f'{source}_{j // 16}', j % 16))} AS c{j}" for j in range(n)
    )


def norm(a: str) -> str:
    return f"sqrt(list_sum(list_transform({a}, lambda x: x::DOUBLE * x::DOUBLE)))"


def dot(a: str, b: str) -> str:
    return (
        f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))"
    )


def strategy_sql(source: str) -> str:
    return with_(POSTS, words_cte(source, "raw_text")) + f""",
      pooled AS (SELECT [{", ".join(first_component('digests', j) for j in range(16))}] AS a,
        [{", ".join(mean_component('digests', j) for j in range(16))}] AS b FROM digested),
      measured AS (SELECT {norm('a')} AS na, {norm('b')} AS nb, {dot('a', 'b')} AS d FROM pooled),
      done AS (SELECT na, nb, CASE WHEN na * nb <> 0 THEN d / (na * nb) END AS c FROM measured)
      SELECT count(*) AS sample_size, {r6('avg(na)')} AS cls_avg_norm, {r6('avg(nb)')} AS mean_avg_norm,
        {r6('stddev_pop(na)')} AS cls_std_norm, {r6('stddev_pop(nb)')} AS mean_std_norm,
        {r6('avg(c)')} AS avg_cosine_similarity, {r6('stddev_pop(c)')} AS std_cosine_similarity,
        count(*) FILTER (c IS NULL) AS n_undefined FROM done"""


def scrub_step(step) -> str:
    return with_(POSTS) + (
        f"SELECT post_id, {step('raw_text')} AS scrubbed_text FROM posts WHERE raw_text IS NOT NULL"
    )


ORACLES: dict[str, str] = {
    "posts_filtered": with_(POSTS, KEPT) + "SELECT post_id, thread_id, raw_text FROM kept",
    "filter_gender": with_(POSTS, KEPT, LABELLED)
    + "SELECT post_id, gender FROM labelled WHERE gender = 'FEMALE'",
    "binary_only": with_(POSTS) + """SELECT post_id, gender FROM (
      SELECT post_id, CASE WHEN post_id >= 0 THEN gold END AS gender FROM posts)
      WHERE gender IS DISTINCT FROM 'NEUTRAL'""",
    "decode_label": with_(POSTS) + """SELECT post_id, female_pred,
      CASE female_pred WHEN 1 THEN 'FEMALE' ELSE 'MALE' END AS gender
      FROM posts WHERE female_pred IN (0, 1)""",
    "unpack_embedding": with_(VECTORS) + "SELECT vec_id, " + ", ".join(
        f"{r6(f'embedding[{i + 1}]::DOUBLE')} AS full_embed_{i}" for i in range(64)
    ) + " FROM vectors",
    "pack_embedding": with_(VECTORS) + "SELECT vec_id, len(embedding) AS dimension, " + ", ".join(
        f"{r6(f'embedding[{i + 1}]::DOUBLE')} AS e{i}" for i in range(64)
    ) + " FROM vectors",
    "label_requests": with_(POSTS) + f"""SELECT post_id, length(p) AS n_chars, md5(p) AS h FROM (
      SELECT post_id, CASE WHEN raw_text <> '' THEN
        {quoted(LABEL_HEAD)} || raw_text || {quoted(LABEL_TAIL)} END AS p FROM posts)""",
    "scrub_requests": with_(POSTS) + f"""SELECT post_id, length(p) AS n_chars, md5(p) AS h FROM (
      SELECT post_id, CASE WHEN raw_text <> '' THEN
        {quoted(SCRUB_HEAD)} || raw_text || {quoted(SCRUB_TAIL)} END AS p FROM posts)""",
    "parse_label_response": with_(POSTS, LABEL_ANSWERS)
    + f"SELECT post_id, {_PARSED} AS gender, {_REASON} AS reasoning, wrong_shape FROM parsed",
    "label_policy": with_(POSTS, LABEL_ANSWERS) + f"""SELECT post_id,
      CASE WHEN raw_text IS NULL OR failed OR wrong_shape = 1 THEN 'NEUTRAL' ELSE {_PARSED} END AS gender,
      CASE WHEN raw_text IS NULL THEN 'Empty text' WHEN failed OR wrong_shape = 1 THEN 'Error'
        ELSE {_REASON} END AS reasoning,
      CASE WHEN raw_text IS NULL THEN 'high'
        WHEN NOT failed AND wrong_shape = 0 AND {_REASON} <> '' THEN 'high' ELSE 'low' END AS confidence
      FROM (SELECT *, post_id % 13 IN (12, -1) AS failed FROM parsed)""",
    "label_posts": with_(POSTS, KEPT, LABELLED)
    + "SELECT post_id, gender, reasoning, 'high' AS confidence, raw_text AS text FROM labelled",
    "label_posts_backend": with_(POSTS, KEPT, LABELLED)
    + "SELECT post_id, gender, reasoning, 'high' AS confidence FROM labelled",
    "label_cues": with_(POSTS, KEPT) + f"""SELECT post_id, len(c) AS n_cues,
      array_to_string(c, ' ') AS cues
      FROM (SELECT post_id, {hits('raw_text', lexicon.words_of())} AS c FROM kept)""",
    "cue_hits": with_(
        POSTS, KEPT,
        "lexicon(token, cue_class, side) AS (VALUES "
        + ", ".join(f"({listed(row)})" for row in lexicon.lexicon_rows()) + ")",
        f"words AS (SELECT post_id, unnest({tokens('raw_text')}) AS token FROM kept)",
    ) + """SELECT post_id, token, cue_class, side, count(*) AS hits
      FROM words JOIN lexicon USING (token) GROUP BY ALL""",
    "label_counts": with_(POSTS, KEPT, LABELLED) + f"""SELECT gender, count(*) AS n,
      {r6('count(*) / sum(count(*)) OVER () * 100')} AS share FROM labelled GROUP BY gender""",
    "label_agreement": with_(POSTS, KEPT, LABELLED) + f""",
      sample AS (SELECT * FROM labelled ORDER BY {seeded('post_id', 42)} LIMIT 500)
      SELECT count(*) FILTER (gender = gold) AS agreements,
        count(*) FILTER (gender <> gold) AS disagreements,
        {r6('count(*) FILTER (gender = gold) / count(*)')} AS agreement_rate,
        count(*) AS sample_size FROM sample""",
    "inference_resume": with_(POSTS, KEPT) + f""",
      asked AS (SELECT post_id,
        sha256({quoted(LABEL_HEAD)} || raw_text || {quoted(LABEL_TAIL)}) AS request_hash FROM kept)
      SELECT DISTINCT request_hash FROM asked WHERE request_hash NOT IN (
        SELECT request_hash FROM asked JOIN labels ON post_id = doc_id)""",
    "parse_scrub_response": with_(POSTS, SCRUB_ANSWERS)
    + "SELECT post_id, value AS scrubbed_text FROM parsed",
    "scrub_policy": with_(POSTS, SCRUB_ANSWERS) + """SELECT post_id,
      CASE WHEN raw_text IS NULL OR failed OR value IS NULL THEN raw_text ELSE value END AS scrubbed_text,
      CASE WHEN raw_text IS NULL THEN 'empty' WHEN failed THEN 'error' WHEN value IS NULL THEN 'unparsed'
        WHEN value = raw_text THEN 'unchanged' ELSE 'scrubbed' END AS scrub_status FROM parsed""",
    "scrub_pronouns": scrub_step(sql_pronouns),
    "scrub_kinship": scrub_step(sql_kinship),
    "scrub_names": scrub_step(sql_names),
    "scrub_names_long": scrub_step(lambda t: sql_names(
        t, ("Mary Ann", "Mary", "O''Brien", "Jean-Luc", "John", "Sarah"))),
    "scrub_names_table": with_(POSTS) + """,
      listed AS (SELECT DISTINCT regexp_extract(text, '^[A-Z][a-z]+', 0) AS piece FROM documents),
      cut AS (SELECT post_id, regexp_extract_all(raw_text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_]+') AS p
        FROM posts WHERE raw_text IS NOT NULL),
      each AS (SELECT post_id, unnest(p) AS piece, unnest(range(0, len(p))) AS i FROM cut),
      named AS (SELECT post_id, string_agg(CASE WHEN listed.piece <> '' THEN '[NAME]' ELSE each.piece END,
        '' ORDER BY i) AS t FROM each LEFT JOIN listed USING (piece) GROUP BY post_id)
      SELECT post_id, CASE WHEN raw_text = '' THEN '' ELSE t END AS scrubbed_text
      FROM posts LEFT JOIN named USING (post_id)""",
    "scrub_titles": scrub_step(sql_titles),
    "scrub_posts": with_(POSTS, SCRUBBED) + "SELECT post_id, raw_text, scrubbed_text FROM scrubbed",
    "scrub_posts_backend": with_(POSTS) + f"""SELECT post_id, scrubbed_text,
      CASE WHEN scrubbed_text = raw_text THEN 'unchanged' ELSE 'scrubbed' END AS scrub_status
      FROM (SELECT post_id, raw_text, {sql_kinship('raw_text')} AS scrubbed_text FROM posts
        WHERE raw_text IS NOT NULL)""",
    "scrub_length_delta": with_(POSTS, SCRUBBED)
    + f"SELECT {r6('avg(length(raw_text) - length(scrubbed_text))')} AS avg_length_reduction FROM scrubbed",
    "scrub_impact": with_(POSTS) + f""",
      pair AS (SELECT coalesce(raw_text, '') AS a, coalesce({sql_scrub('raw_text')}, '') AS b FROM posts)
      SELECT count(*) AS total_texts, {r6('avg(length(a))')} AS avg_original_length,
        {r6('avg(length(b))')} AS avg_scrubbed_length,
        {r6(f"avg({word_count('a')} - {word_count('b')})")} AS avg_word_reduction,
        CAST(sum({' + '.join(literal_count('b', p) for p in lexicon.COUNTED_PLACEHOLDERS.values())})
          AS BIGINT) AS total_replacements,
        {', '.join(f"CAST(sum({literal_count('b', p)}) AS BIGINT) AS n_{n}"
                   for n, p in lexicon.COUNTED_PLACEHOLDERS.items())} FROM pair""",
    "replacement_counts": with_(POSTS, SCRUBBED)
    + f"SELECT post_id, {brackets('scrubbed_text')} AS num_replacements FROM scrubbed",
    "top_replacements": with_(POSTS, SCRUBBED) + f"""SELECT post_id, raw_text, scrubbed_text,
      {brackets('scrubbed_text')} AS num_replacements FROM scrubbed
      ORDER BY num_replacements DESC, post_id LIMIT 10""",
    "gender_scrub_report": with_(POSTS, KEPT, LABELLED) + f""",
      counted AS (SELECT gender, raw_text, {sql_scrub('raw_text')} AS s FROM labelled),
      sized AS (SELECT *, {brackets('s')} AS r FROM counted)
      SELECT gender, round_even(avg(r), 2) AS replacements_mean,
        round_even(stddev_samp(r), 2) AS replacements_std, max(r) AS replacements_max,
        round_even(avg(length(raw_text)), 2) AS original_length_mean,
        round_even(avg(length(s)), 2) AS scrubbed_length_mean FROM sized GROUP BY gender""",
    "scrub_issues": with_(POSTS, SCRUBBED, _SAMPLED_ISSUES) + _ISSUES,
    "first_issues": with_(POSTS, SCRUBBED, _SAMPLED_ISSUES)
    + _ISSUES + " ORDER BY post_id, pattern LIMIT 5",
    "scrub_issues_all": with_(POSTS) + f""",
      shown AS (SELECT * FROM posts WHERE raw_text IS NOT NULL),
      found AS ({audit_sql('shown', 'post_id', 'raw_text')}) {_ISSUES}""",
    "scrub_issue_rate": with_(POSTS, SCRUBBED) + f""",
      found AS ({audit_sql('scrubbed', 'post_id', 'scrubbed_text')}),
      per_post AS (SELECT post_id, count(*) FILTER (len(found) > 0) AS n FROM found GROUP BY post_id)
      SELECT count(*) AS total_texts, count(*) FILTER (n > 0) AS texts_with_issues,
        CAST(sum(n) AS BIGINT) AS total_issues, {r6('count(*) FILTER (n > 0) / count(*)')} AS issue_rate,
        array_to_string((SELECT list(post_id ORDER BY post_id) FROM (SELECT post_id FROM per_post
          WHERE n > 0 ORDER BY post_id LIMIT 5)), ' ') AS examples
      FROM per_post""",
    "scrub_modification": with_(POSTS, SCRUBBED) + f""",
      gained AS (SELECT post_id, raw_text <> scrubbed_text AS m,
        {brackets('scrubbed_text')} - {brackets('raw_text')} AS g FROM scrubbed)
      SELECT count(*) AS total_texts, count(*) FILTER (m) AS texts_modified,
        {r6('count(*) FILTER (m) / count(*)')} AS modification_rate,
        {r6('avg(g) FILTER (m)')} AS avg_words_replaced, max(g) FILTER (m) AS max_words_replaced,
        array_to_string((SELECT list(post_id ORDER BY g DESC, post_id) FROM (SELECT * FROM gained
          WHERE m ORDER BY g DESC, post_id LIMIT 5)), ' ') AS examples
      FROM gained""",
    "sample_posts": with_(POSTS, KEPT)
    + f"SELECT post_id, raw_text FROM kept ORDER BY {seeded('post_id', 42)} LIMIT 500",
    "sample_fraction": with_(POSTS, KEPT) + f"""SELECT post_id FROM kept
      WHERE ('0x' || substr({seeded('post_id', 39)}, 1, 8))::BIGINT / 4294967296.0 < 0.01""",
    "stratified_split": with_(VECTORS, split_ctes("vectors", "vec_id", 42))
    + "SELECT vec_id, gender, split FROM parts",
    "nested_split": with_(
        VECTORS, split_ctes("vectors", "vec_id", 42),
        "train AS (SELECT vec_id, gender FROM parts WHERE split = 'train')",
        split_ctes("train", "vec_id", "42-validation", out="nested"),
    ) + "SELECT vec_id, gender, split FROM nested",
    "stratified_split_posts": with_(POSTS, KEPT, LABELLED, split_ctes("labelled", "post_id", 42))
    + "SELECT post_id, gender, split FROM parts",
    "stratified_kfold": with_(VECTORS, FOLDS) + "SELECT vec_id, gender, fold FROM folds",
    "class_distribution": with_(VECTORS, split_ctes("vectors", "vec_id", 42))
    + "SELECT split, gender, count(*) AS n FROM parts GROUP BY ALL",
    "attach_embeddings": with_(POSTS) + f"""SELECT post_id, gold, {", ".join(
        f"{r6(f'embedding[{i + 1}]::DOUBLE')} AS e{i}" for i in range(64))}
      FROM posts LEFT JOIN embeddings ON post_id = vec_id WHERE raw_text IS NOT NULL""",
    "thread_sizes": with_(POSTS)
    + "SELECT thread_id, post_id, count(*) OVER (PARTITION BY thread_id) AS n_posts FROM posts",
    "clean_for_embedding": with_(POSTS)
    + f"SELECT post_id, {strip('replace(coalesce(raw_text, chr(32)), chr(10), chr(32))')} AS cleaned FROM posts",
    "embedding_cost": with_(POSTS, SCRUBBED) + f"""SELECT num_texts,
      CAST(floor(t) AS BIGINT) AS estimated_tokens, 0.00002::DOUBLE AS cost_per_1k_tokens,
      round(t / 1000 * 0.00002::DOUBLE, 9) AS estimated_cost_usd,
      'text-embedding-3-small' AS model, 1536::BIGINT AS dimension
      FROM (SELECT count(*) AS num_texts, sum({word_count('scrubbed_text')}) / 0.75::DOUBLE AS t
        FROM scrubbed)""",
    "pool_first": with_(POSTS, SCRUBBED, words_cte("scrubbed", "scrubbed_text"))
    + f"SELECT post_id, {columns(first_component, 16, 'digests')} FROM digested",
    "pool_mean": with_(POSTS, SCRUBBED, words_cte("scrubbed", "scrubbed_text"))
    + f"SELECT post_id, {columns(mean_component, 16, 'digests')} FROM digested",
    "embed_table": with_(POSTS, words_cte("posts", "raw_text"))
    + f"SELECT post_id, 'raw_mean' AS method, {columns(mean_component, 20, 'digests')} FROM digested",
    "embed_methods": with_(POSTS, SCRUBBED, words_cte("scrubbed", "scrubbed_text")) + f"""
      SELECT post_id, 'lexical_cls' AS method, {columns(first_component, 20, 'digests')} FROM digested
      UNION ALL
      SELECT post_id, 'lexical_mean', {columns(mean_component, 20, 'digests')} FROM digested""",
    "embed_external": with_(POSTS) + f""",
      hashed AS (SELECT post_id,
        md5({strip('replace(coalesce(raw_text, chr(32)), chr(10), chr(32))')}) AS h FROM posts)
      SELECT post_id, 'digest' AS method, {", ".join(
          f"{r6(f'({digest_component(chr(104), j)} / 32767.5 - 1.0)::FLOAT::DOUBLE')} AS c{j}" for j in range(8)
      )} FROM hashed""",
    "embed_store": with_(POSTS) + f""",
      cleaned AS (SELECT post_id,
        {strip('replace(coalesce(raw_text, chr(32)), chr(10), chr(32))')} AS t FROM posts),
      hashed AS (SELECT *, md5(t) AS h FROM cleaned)
      SELECT post_id, 'digest' AS method, NULL::VARCHAR AS embed_error,
        CASE WHEN length(t) % 2 = 0 THEN 'failed' END AS first_run, {", ".join(
          f"{r6(f'({digest_component(chr(104), j)} / 32767.5 - 1.0)::FLOAT::DOUBLE')} AS c{j}" for j in range(8)
      )} FROM hashed""",
    "csv_round_trip": with_(POSTS) + "SELECT post_id, raw_text, female_pred FROM posts",
    "json_round_trip": with_(POSTS) + "SELECT post_id, raw_text, female_pred FROM posts",
    "import_wide": with_(VECTORS) + "SELECT vec_id, (vec_id = 3)::BIGINT AS lost_cells, 1::BIGINT AS n_skipped, "
    + ", ".join(
        f"CASE WHEN {i} <> 5 OR vec_id <> 3 THEN {r6(f'embedding[{i + 1}]::DOUBLE')} END AS c{i}"
        for i in range(64)
    ) + " FROM vectors",
    "norm_stats": with_(VECTORS, METHODS) + f"""SELECT method, count(*) AS sample_size,
      {r6('avg(n)')} AS avg_norm, {r6('stddev_pop(n)')} AS std_norm
      FROM (SELECT method, {norm('embedding')} AS n FROM methods) GROUP BY method""",
    "strategy_compare": strategy_sql("posts"),
    "strategy_compare_sample": strategy_sql(
        f"(SELECT * FROM posts ORDER BY {seeded('post_id', 42)} LIMIT 100)"
    ),
    "pairwise_similarity": with_(VECTORS) + f""",
      first AS (SELECT * FROM vectors ORDER BY vec_id LIMIT 10)
      SELECT a.vec_id AS left_id, b.vec_id AS right_id,
        {r6(f"{dot('a.embedding', 'b.embedding')} / ({norm('a.embedding')} * {norm('b.embedding')})")}
          AS similarity
      FROM first a JOIN first b ON a.vec_id < b.vec_id""",
    "mean_similarity_all": with_(VECTORS, METHODS) + f""",
      units AS (SELECT method, {norm('embedding')} AS n, embedding FROM methods),
      parts AS (SELECT method, unnest(range(1, len(embedding) + 1)) AS dim,
        unnest(list_transform(embedding, lambda x: x::DOUBLE / n)) AS x FROM units),
      sums AS (SELECT method, dim, sum(x) AS s, count(*) AS c FROM parts GROUP BY method, dim)
      SELECT method, max(c) AS n_vectors,
        {r6('(sum(s * s) - max(c)) / (max(c) * (max(c) - 1))')} AS mean_similarity
      FROM sums GROUP BY method""",
    "similarity_spread": with_(VECTORS, METHODS) + f""",
      sizes AS (SELECT method, count(*) AS n, max(len(embedding)) AS d FROM methods GROUP BY method),
      pairs AS (SELECT a.method, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s
        FROM methods a JOIN methods b ON a.method = b.method AND a.vec_id < b.vec_id)
      SELECT method, d AS dimension, n AS n_vectors, {r6('avg(s)')} AS mean_similarity,
        {r6('stddev_pop(s)')} AS std_similarity
      FROM pairs JOIN sizes USING (method) GROUP BY ALL""",
    "embedding_report": with_(VECTORS) + f""",
      sample AS (SELECT * FROM vectors ORDER BY {seeded('vec_id', 42)} LIMIT 50),
      first AS (SELECT * FROM sample ORDER BY vec_id LIMIT 10),
      pairs AS (SELECT {dot('a.embedding', 'b.embedding')}
          / ({norm('a.embedding')} * {norm('b.embedding')}) AS s
        FROM first a JOIN first b ON a.vec_id < b.vec_id)
      SELECT count(*) AS sample_size, max(len(embedding)) AS embedding_dimension,
        {r6(f"avg({norm('embedding')})")} AS avg_norm, {r6(f"stddev_pop({norm('embedding')})")} AS std_norm,
        (SELECT {r6('avg(s)')} FROM pairs) AS avg_pairwise_similarity,
        (SELECT {r6('stddev_pop(s)')} FROM pairs) AS std_pairwise_similarity,
        'external' AS model FROM sample""",
    "method_catalog": with_(VECTORS, METHODS) + """SELECT method, count(*) AS n,
      min(len(embedding)) AS min_dimension, max(len(embedding)) AS max_dimension
      FROM methods GROUP BY method""",
    "nan_audit": with_(VECTORS) + """SELECT count(*) AS n_rows,
      count(*) FILTER (vec_id % 50 = 0) AS rows_with_gaps,
      max((vec_id % 50 = 0)::INT) AS any_gap FROM vectors""",
    "feature_moments": with_(VECTORS, METHODS) + f""",
      parts AS (SELECT method, unnest(range(0, len(embedding))) AS dim, unnest(embedding)::DOUBLE AS x
        FROM methods)
      SELECT method, dim, {r6('avg(x)')} AS mean, {r6('stddev_pop(x)')} AS std
      FROM parts GROUP BY method, dim""",
    "prepare_features": with_(VECTORS, split_ctes("vectors", "vec_id", 42)) + f""",
      filled AS (SELECT vec_id, gender, split, unnest(range(0, 64)) AS dim, unnest(embedding) AS e
        FROM parts),
      cleaned AS (SELECT vec_id, gender, split, dim,
        CASE WHEN dim = 0 AND vec_id % 50 = 0 THEN 0.0::DOUBLE ELSE e::DOUBLE END AS x FROM filled),
      moments AS (SELECT dim, avg(x) AS m, stddev_pop(x) AS s FROM cleaned
        WHERE split = 'train' GROUP BY dim)
      SELECT vec_id, split,
        CASE gender WHEN 'FEMALE' THEN 0 WHEN 'MALE' THEN 1 ELSE 2 END::DOUBLE AS label, dim,
        {r6('(x - m) / CASE WHEN s = 0 THEN 1 ELSE s END')} AS value
      FROM cleaned JOIN moments USING (dim)""",
    "accuracy": with_(POSTS, KEPT, LABELLED, JUDGED)
    + f"SELECT {r6('avg((label = prediction)::INT)')} AS accuracy, count(*) AS test_samples FROM judged",
    "confusion_matrix": with_(POSTS, KEPT, LABELLED, JUDGED) + """,
      names AS (SELECT label AS c FROM judged UNION SELECT prediction FROM judged)
      SELECT a.c AS label, b.c AS prediction, (SELECT count(*) FROM judged j
        WHERE j.label = a.c AND j.prediction = b.c) AS n FROM names a, names b""",
    "classification_report": with_(POSTS, KEPT, LABELLED, JUDGED) + f""",
      names AS (SELECT label AS c FROM judged UNION SELECT prediction FROM judged),
      sums AS (SELECT c, count(*) FILTER (label = c) AS support,
          count(*) FILTER (prediction = c) AS predicted,
          count(*) FILTER (label = c AND prediction = c) AS hits
        FROM names, judged GROUP BY c),
      ratios AS (SELECT c, support, hits, coalesce(hits / nullif(predicted, 0), 0) AS p,
          coalesce(hits / nullif(support, 0), 0) AS r,
          coalesce(2 * hits / nullif(predicted + support, 0), 0) AS f FROM sums)
      SELECT c AS "class", {r6('p')} AS "precision", {r6('r')} AS recall, {r6('f')} AS f1_score, support FROM ratios
      UNION ALL SELECT 'accuracy', {r6('sum(hits) / sum(support)')}, {r6('sum(hits) / sum(support)')},
        {r6('sum(hits) / sum(support)')}, CAST(sum(support) AS BIGINT) FROM ratios
      UNION ALL SELECT 'macro avg', {r6('avg(p)')}, {r6('avg(r)')}, {r6('avg(f)')},
        CAST(sum(support) AS BIGINT) FROM ratios
      UNION ALL SELECT 'weighted avg', {r6('sum(p * support) / sum(support)')},
        {r6('sum(r * support) / sum(support)')}, {r6('sum(f * support) / sum(support)')},
        CAST(sum(support) AS BIGINT) FROM ratios""",
    "evaluate": with_(VECTORS, METHODS, PREDICTIONS, RESULTS)
    + f"SELECT method, model, {r6('accuracy')} AS accuracy, test_samples FROM results",
    "cv_summary": with_(VECTORS, METHODS, PREDICTIONS, FOLDS) + f""",
      scores AS (SELECT method, model, fold, avg((label = prediction)::INT) AS a, count(*) AS n
        FROM predictions JOIN folds USING (vec_id) GROUP BY ALL)
      SELECT method, model, {r6('avg(a)')} AS cv_accuracy_mean, {r6('stddev_pop(a)')} AS cv_accuracy_std,
        CAST(sum(n) AS BIGINT) AS training_samples FROM scores GROUP BY ALL""",
    "best_model": with_(VECTORS, METHODS, PREDICTIONS, RESULTS) + f"""SELECT method,
      first(model ORDER BY accuracy DESC, ord) AS best_model, {r6('max(accuracy)')} AS best_accuracy,
      count(*) AS n_models FROM results GROUP BY method""",
    "method_ranking": with_(VECTORS, METHODS, PREDICTIONS, RESULTS) + f"""SELECT method,
      first(model ORDER BY accuracy DESC, ord) AS best_model, {r6('max(accuracy)')} AS best_accuracy
      FROM results GROUP BY method ORDER BY best_accuracy DESC, method""",
    "stream_label_scrub": with_(f"posts AS ({DOCUMENT_POSTS})") + f"""SELECT post_id,
      {sql_gender('raw_text')} AS gender, {sql_scrub('raw_text')} AS scrubbed_text FROM posts""",
    "stream_label_counts": with_(f"posts AS ({DOCUMENT_POSTS})")
    + f"SELECT {sql_gender('raw_text')} AS gender, count(*) AS n FROM posts GROUP BY ALL",
}
ORACLES["stream_revised_counts"] = with_(f"posts AS ({DOCUMENT_POSTS})") + f""",
  revised AS (SELECT post_id, CASE WHEN toxic = 0 THEN {_SENTENCES} END AS raw_text
    FROM (SELECT doc_id AS post_id, doc_id + 1 AS doc_id, toxic FROM labels)),
  latest AS (SELECT * FROM revised UNION ALL
    SELECT post_id, raw_text FROM posts WHERE post_id NOT IN (SELECT post_id FROM revised))
  SELECT {sql_gender('raw_text')} AS gender, count(*) AS n FROM latest WHERE raw_text IS NOT NULL
  GROUP BY ALL"""
ORACLES["report_round_trip"] = ORACLES["label_counts"]

BINARY = "two AS (SELECT * FROM vectors WHERE gender <> 'NEUTRAL')"


def trained(*models: str, rows: str = "two") -> str:
    return with_(VECTORS, BINARY, split_ctes(rows, "vec_id", 42)) + f""",
      shares AS (SELECT max(n) / sum(n) AS share
        FROM (SELECT count(*) AS n FROM parts WHERE split = 'train' GROUP BY gender))
      SELECT vec_id, CASE gender WHEN 'FEMALE' THEN 0 WHEN 'MALE' THEN 1 ELSE 2 END::DOUBLE AS label,
        model, {r6('share')} AS majority, true AS sound
      FROM parts, shares, (SELECT unnest([{listed(models)}]) AS model) WHERE split = 'test'"""


# The models in training order.
MODELS = ("Lasso Logistic", "Random Forest", "MLP", "Boosted Trees 0.05", "Boosted Trees 0.1")

ORACLES["train_lasso"] = trained(MODELS[0])
ORACLES["train_forest"] = trained(MODELS[1])
ORACLES["train_mlp"] = trained(MODELS[2])
ORACLES["train_boosted_slow"] = trained(MODELS[3])
ORACLES["train_boosted"] = trained(MODELS[4])
ORACLES["train_boosted_three"] = trained(MODELS[3], rows="vectors")
# Gradients of the start, in units of 2^-24, summed left of every cut; cuts are the values of the
# ranks ceil(k n / 255).
ORACLES["boosted_first_splits"] = with_(VECTORS, BINARY) + f""",
  parts AS (SELECT (gender = 'MALE')::INT AS y, unnest(range(0, 64)) AS dim,
    unnest(embedding)::DOUBLE AS x FROM two),
  start AS (SELECT count(*) AS n, avg((gender = 'MALE')::INT) AS p FROM two),
  units AS (SELECT n, round(p * 16777216) AS g0, round((p - 1) * 16777216) AS g1,
    round(p * (1 - p) * 16777216) AS h FROM start),
  points AS (SELECT dim, x, count(*) AS own, sum(y) AS ones FROM parts GROUP BY dim, x),
  sums AS (SELECT dim, x, own, sum(own) OVER w AS n_left, sum(ones) OVER w AS ones
    FROM points WINDOW w AS (PARTITION BY dim ORDER BY x)),
  cuts AS (SELECT DISTINCT sums.* FROM sums, start, (SELECT unnest(range(1, 255)) AS k)
    WHERE ceil(k * n / 255 - 1e-9) > n_left - own AND ceil(k * n / 255 - 1e-9) <= n_left),
  scored AS (SELECT dim, x, n_left, n - n_left AS n_right,
      ((n_left - ones) * g0 + ones * g1) / 16777216 AS gl, n_left * h / 16777216 + 1e-12 AS hl,
      (SELECT sum(CASE y WHEN 1 THEN g1 ELSE g0 END) / 16777216 FROM parts, units WHERE dim = 0) AS g,
      n * h / 16777216 + 1e-12 AS hh FROM cuts, units),
  gains AS (SELECT *, gl * gl / hl + (g - gl) * (g - gl) / (hh - hl) - g * g / hh AS gain FROM scored
    WHERE n_left >= 20 AND n_right >= 20),
  best AS (SELECT *, row_number() OVER (PARTITION BY dim ORDER BY gain DESC, x) AS r FROM gains)
  SELECT dim::INT AS dim, {r6('x')} AS threshold, {r6('gain')} AS gain, n_left::BIGINT AS n_left,
    n_right::BIGINT AS n_right FROM best WHERE r = 1 AND gain > 1e-9"""
ORACLES["train_all"] = trained(*MODELS)
ORACLES["train_cross_validated"] = with_(VECTORS, BINARY, split_ctes("two", "vec_id", 42)) + f"""
  SELECT 'full64' AS method, model, count(*) FILTER (split = 'train') AS training_samples,
    count(*) FILTER (split = 'test') AS test_samples, 64::BIGINT AS dimension,
    model <> 'MLP' AS validated, true AS sound
  FROM parts, (SELECT unnest([{listed(MODELS)}]) AS model) GROUP BY model"""
ORACLES["compare_embeddings"] = (
    "SELECT * FROM (VALUES ('full64', 64::BIGINT, 5::BIGINT, true), ('half32', 32, 5, true)) "
    "AS t(method, dimension, n_models, sound)"
)
ORACLES["grid_search"] = (
    "SELECT c::DOUBLE AS c, true AS sound FROM (VALUES (0.01), (0.1), (1), (10), (100)) AS t(c)"
)
ORACLES["grid_search_forest"] = (
    "SELECT t::INT AS trees, d::INT AS depth, r::INT AS leaf_rows, true AS sound "
    "FROM (VALUES (50), (100), (200)) AS a(t), (VALUES (5), (10), (15), (30)) AS b(d), "
    "(VALUES (1), (3), (5)) AS c(r)"
)
ORACLES["models_reloaded"] = with_(VECTORS, BINARY, split_ctes("two", "vec_id", 42)) + f"""
  SELECT vec_id, model, true AS same
  FROM parts, (SELECT unnest([{listed(MODELS[:2])}]) AS model) WHERE split = 'test'"""
ORACLES["train_single"] = with_(VECTORS, BINARY, split_ctes("two", "vec_id", 42)) + f""",
  counts AS (SELECT CASE gender WHEN 'FEMALE' THEN '0.0' ELSE '1.0' END AS c, count(*) AS n
    FROM parts WHERE split = 'test' GROUP BY gender),
  lines AS (SELECT c, n FROM counts UNION ALL
    SELECT unnest(['accuracy', 'macro avg', 'weighted avg']), sum(n)::BIGINT FROM counts)
  SELECT model, c AS "class", n AS support FROM lines, (SELECT unnest([{listed(MODELS[:2])}]) AS model)"""
ORACLES["row_keys"] = with_(POSTS) + """
  SELECT count(*) AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT raw_text, gold FROM posts)) AS n_keys,
    0::BIGINT AS without FROM posts"""
