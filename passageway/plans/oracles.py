"""The registered queries as SQL for another engine, over the same tables."""

from __future__ import annotations

from passageway.operators.uncertainty import poisson_edges
from passageway.plans import study

_WORDS = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"


def words(text: str) -> str:
    return _WORDS.format(text)


def hash_mod(modulus: int, *parts: str) -> str:
    joined = ", ".join(f"({p})::VARCHAR" for p in parts)
    return f"(('0x' || substr(md5(concat_ws('|', {joined})), 1, 6))::BIGINT % {modulus})"


def chunk_ctes(collection: str, name: str = "chunks", source: str = "documents") -> str:
    return f"""
{name}_n AS (
  SELECT {collection} AS collection, doc_id, text,
         CASE WHEN length(text) > 0 THEN greatest(ceil((length(text) - 400) / 400.0), 1) ELSE 0 END::BIGINT AS n
  FROM {source}),
{name}_b AS (
  SELECT *, coalesce(sum(n) OVER (PARTITION BY collection ORDER BY doc_id
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM {name}_n),
{name} AS (
  SELECT collection, (before + i + 1)::BIGINT AS chunk_no, doc_id, i::INT AS pos,
         substring(text, (i * 400 + 1)::BIGINT, 800) AS text
  FROM (SELECT *, unnest(range(n)) AS i FROM {name}_b))"""


def split_into(split: str, text: str) -> str:
    if split == "words":
        return words(text)
    return (
        f"flatten(list_transform({words(text)}, lambda w: CASE WHEN length(w) < 2 THEN [w] "
        "ELSE list_transform(range(1, length(w)), lambda i: substring(w, i, 2)) END))"
    )


def stats_ctes(units: str, split: str = "words") -> str:
    """``units``: a query with (id, text)."""
    tokens = split_into(split, "text")
    return f"""
unit AS ({units}),
unit_words AS (SELECT id, {tokens} AS words FROM unit),
postings AS (
  SELECT id, token, count(*)::BIGINT AS tf, any_value(len(words))::INT AS doc_len
  FROM (SELECT id, words, unnest(words) AS token FROM unit_words) GROUP BY id, token),
corpus AS (SELECT count(*) AS n_docs, sum(len(words)) AS total_len FROM unit_words),
terms AS (
  SELECT token, df, ln(1 + ((SELECT n_docs FROM corpus) - df + 0.5) / (df + 0.5)) AS idf
  FROM (SELECT token, count(*)::BIGINT AS df FROM postings GROUP BY token)),
question AS (SELECT item_id AS qid, text AS question FROM benchmark)"""


def lexical_cte(k: int, name: str = "lexical", split: str = "words") -> str:
    return f"""
{name}_terms AS (SELECT DISTINCT qid, unnest({split_into(split, "question")}) AS token FROM question),
{name}_scores AS (
  SELECT qid, id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len * (SELECT n_docs FROM corpus)
                                                         / (SELECT total_len FROM corpus)))), 10) AS score
  FROM {name}_terms JOIN terms USING (token) JOIN postings USING (token) GROUP BY qid, id),
{name} AS (
  SELECT qid, rank, id, round(score, 6) AS score FROM (
    SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INT AS rank FROM {name}_scores)
  WHERE rank <= {k})"""


_BUCKET = "('0x' || substr(md5(token), 1, 6))::BIGINT % 64"


def vector_cte(k: int, name: str = "vector", prefix: str = "") -> str:
    asked = f"'{prefix}' || question"
    return f"""
{name}_d AS (
  SELECT id, {_BUCKET} AS bucket, sum((1 + ln(tf)) * idf) AS w FROM postings JOIN terms USING (token) GROUP BY 1, 2),
{name}_qt AS (
  SELECT qid, token, count(*) AS tf FROM (SELECT qid, unnest({words(asked)}) AS token FROM question) GROUP BY 1, 2),
{name}_q AS (
  SELECT qid, {_BUCKET} AS bucket, sum((1 + ln(tf)) * idf) AS w FROM {name}_qt JOIN terms USING (token) GROUP BY 1, 2),
{name}_dn AS (SELECT id, sqrt(sum(w * w)) AS norm FROM {name}_d GROUP BY id),
{name}_qn AS (SELECT qid, sqrt(sum(w * w)) AS norm FROM {name}_q GROUP BY qid),
{name}_dots AS (
  SELECT qid, id, sum(q.w * d.w) AS dot FROM {name}_q q JOIN {name}_d d USING (bucket) GROUP BY 1, 2),
{name}_scores AS (
  SELECT qid, id, round(dot / (q.norm * d.norm), 10) AS score
  FROM {name}_dots JOIN {name}_qn q USING (qid) JOIN {name}_dn d USING (id)),
{name} AS (
  SELECT qid, rank, id, round(score, 6) AS score FROM (
    SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INT AS rank FROM {name}_scores)
  WHERE rank <= {k})"""


def gold_cte(units: str = "unit", name: str = "gold") -> str:
    spaced = "' ' || array_to_string({0}, ' ') || ' '"
    return f"""
{name}_hay AS (SELECT id, {spaced.format(words("text"))} AS hay FROM {units}),
{name}_needle AS (SELECT item_id AS qid, {spaced.format(words("text"))} AS needle FROM benchmark),
{name} AS (SELECT qid, id FROM {name}_needle, {name}_hay WHERE contains(hay, needle))"""


_DOCUMENT_UNITS = "SELECT doc_id AS id, text FROM documents"
_CHUNK_UNITS = "SELECT chunk_no AS id, text FROM chunks"
_QUESTION = "question AS (SELECT item_id AS qid, text AS question FROM benchmark)"
_DOC_STATS = stats_ctes(_DOCUMENT_UNITS)
_CHUNK_STATS = chunk_ctes("'corpus'") + "," + stats_ctes(_CHUNK_UNITS)

_EMBED = """
center_cells AS (SELECT label, i, avg(x) AS x FROM (
  SELECT label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1, 2),
centers AS (SELECT label::BIGINT AS qid, list(x ORDER BY i) AS q FROM center_cells GROUP BY label),
rows AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
scored AS (
  SELECT qid, id,
         round(list_dot_product(q, v) / (sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(v, v))), 10) AS score,
         round(list_dot_product(q[1:16], v[1:16])
               / (sqrt(list_dot_product(q[1:16], q[1:16])) * sqrt(list_dot_product(v[1:16], v[1:16]))), 10) AS coarse
  FROM centers, rows),
exact AS (
  SELECT qid, rank, id, round(score, 6) AS score FROM (
    SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INT AS rank FROM scored) WHERE rank <= 8)"""


def pooled_cte(ef: int, name: str = "pooled") -> str:
    return f"""
{name} AS (
  SELECT qid, rank, id, round(score, 6) AS score FROM (
    SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INT AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY qid ORDER BY coarse DESC, id) AS place FROM scored)
    WHERE place <= {ef})
  WHERE rank <= 8)"""


_TURNS = "(conv_id * 1000 + turn)"
_USER = f"user_question AS (SELECT {_TURNS} AS qid, text AS question FROM conversations WHERE role = 'user')"
_ASSISTANT = f"assistant AS (SELECT {_TURNS} AS qid, text FROM conversations WHERE role = 'assistant')"
_CITED = f"""
{_ASSISTANT},
runs AS (SELECT qid, text, unnest([1, 2, 3])::INT AS run FROM assistant),
numbers AS (
  SELECT *, {hash_mod(105, "qid", "run")} + 1 AS c1, {hash_mod(105, "'x'", "qid", "run")} + 1 AS c2,
         {hash_mod(105, "'y'", "qid", "run")} + 1 AS c3
  FROM runs),
cited AS (
  SELECT 'base' AS config_id, qid, run,
         text || ' [资料§' || c2 || ']、[资料§' || c1 || ']、[资料§' || c1 || '][资料§' || c3 || ']' AS answer
  FROM numbers),
supplied AS (
  SELECT qid, list({hash_mod(105, "qid", "rank")} + 1) AS ids
  FROM (SELECT qid, unnest(range(1, 9)) AS rank FROM assistant) GROUP BY qid),
parsed AS (
  SELECT config_id, qid, run, answer, ids,
         list_transform(regexp_extract_all(answer, '\\[资料§(\\d+)\\]', 1), lambda x: x::BIGINT) AS cites,
         regexp_extract_all(answer, '\\[资料§\\d+\\]') AS marks,
         regexp_split_to_array(answer, '\\[资料§\\d+\\]') AS parts
  FROM cited JOIN supplied USING (qid)),
illegal AS (
  SELECT config_id, qid, run, answer, list_filter(cites, lambda n: NOT list_contains(ids, n)) AS illegal FROM parsed),
marked AS (
  SELECT config_id, qid, run, ids,
         array_to_string(list_transform(range(1, len(parts) + 1), lambda i: parts[i] || CASE
           WHEN i > len(marks) THEN '' WHEN list_contains(ids, cites[i]) THEN marks[i] ELSE chr(1) END), '') AS text
  FROM parsed),
whitelisted AS (
  SELECT config_id, qid, run, ids,
         regexp_replace(regexp_replace(text, '[、，,]\\s*' || chr(1), '', 'g'), chr(1) || '([、，,]\\s*)?', '', 'g') AS answer
  FROM marked)"""

_JUDGED = f"""
j_assistant AS (SELECT {_TURNS} AS qid, text FROM conversations WHERE role = 'assistant'),
j_runs AS (SELECT qid, text, unnest([1, 2, 3])::INT AS run FROM j_assistant),
j_answers AS (
  SELECT 'base' AS config_id, qid, run,
         CASE WHEN u < 25 THEN '{study.REFUSAL}' WHEN u < 40 THEN 'There is no such information here.' ELSE text END AS answer
  FROM (SELECT *, {hash_mod(100, "'j'", "qid", "run")} AS u FROM j_runs)),
j_questions AS (
  SELECT qid, {hash_mod(2, "'q'", "qid")} = 0 AS in_corpus,
         CASE WHEN {hash_mod(100, "'t'", "qid")} < 70 THEN string_split(text, ' ')[1:2] ELSE ['absent term'] END AS expected
  FROM j_assistant)"""


def judged(answers: str) -> str:
    """Verdicts of a relation with (config_id, qid, run, answer)."""
    return f"""
  SELECT config_id, qid, run, in_corpus, refused,
         in_corpus AND NOT refused AND len(list_filter(expected, lambda t: NOT contains(answer, t))) = 0 AS correct
  FROM (SELECT *, regexp_matches(answer, '资料中没有相关内容|no such information') AS refused
        FROM {answers} JOIN j_questions USING (qid))"""


_RETRIED = """
retried AS (
  SELECT c.config_id, c.qid, c.run,
         CASE WHEN len(i.illegal) > 0 THEN j.answer ELSE c.answer END AS answer, len(i.illegal) > 0 AS retried
  FROM cited c JOIN illegal i USING (config_id, qid, run) JOIN j_answers j USING (config_id, qid, run))"""

_CONFIG_ROWS = ", ".join(f"('{c}', {a}, {b}, {d})" for c, a, b, d in study.CONFIGS)
_KEY = ("config_id", "qid", "run")
_VERDICTS = f"""
verdict_rows AS (
  SELECT config_id, doc_id AS qid, quality = 1 AS in_corpus, fp, tp, right_share, unnest([1, 2, 3])::INT AS run
  FROM labels, (VALUES {_CONFIG_ROWS}) AS c(config_id, fp, tp, right_share)),
verdicts AS (
  SELECT *, in_corpus AND NOT refused AND {hash_mod(100, "'c'", *_KEY)} < right_share AS correct
  FROM (SELECT *, {hash_mod(100, *_KEY)} < CASE WHEN in_corpus THEN fp ELSE tp END AS refused FROM verdict_rows)),
final AS (
  SELECT config_id, qid, in_corpus, count_if(refused) * 2 > count(*) AS refused, count_if(correct) * 2 > count(*) AS correct,
         count_if(refused) * 2 = count(*) OR count_if(correct) * 2 = count(*) AS tied,
         3 - count(DISTINCT run) AS missing_runs
  FROM verdicts GROUP BY config_id, qid, in_corpus)"""


def matrix(source: str, key: str = "config_id") -> str:
    return f"""
  SELECT *, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall,
         2 * tp / nullif(2 * tp + fp + fn, 0) AS f1
  FROM (SELECT {key}, count_if(NOT in_corpus AND refused)::BIGINT AS tp, count_if(in_corpus AND refused)::BIGINT AS fp,
               count_if(NOT in_corpus AND NOT refused)::BIGINT AS fn, count_if(in_corpus AND NOT refused)::BIGINT AS tn
        FROM {source} GROUP BY {key})"""


_MATRIX = _VERDICTS + f""",
matrix AS ({matrix("final")}),
matrix_r AS (SELECT config_id, tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1
             FROM matrix),
metrics AS (""" + " UNION ALL ".join(
    f"SELECT config_id, '{m}' AS metric, {m}::DOUBLE AS value FROM matrix_r" for m in study.METRICS
) + ")"

_RATES = _VERDICTS + """,
rates AS (
  SELECT config_id, count(*) AS n, count_if(in_corpus AND correct)::BIGINT AS n_correct,
         count_if(NOT in_corpus AND refused)::BIGINT AS n_refused,
         avg(CASE WHEN in_corpus THEN correct::INT END) AS correct_rate,
         avg(CASE WHEN NOT in_corpus THEN refused::INT END) AS refusal_rate,
         avg(CASE WHEN in_corpus THEN correct::INT ELSE refused::INT END) AS total_rate
  FROM final GROUP BY config_id)"""

_PAIR_ROWS = ", ".join(f"('{a}', '{b}')" for a, b in study.PAIRS)
_PAIRS = f"pairs(config_a, config_b) AS (VALUES {_PAIR_ROWS})"
_PARAM_ROWS = ", ".join(f"('{c}', '{k}', '{v}')" for c, p in study.PARAMS.items() for k, v in p.items())
_DELTAS = _RATES + f""",
{_PAIRS},
rate_metrics AS (
  SELECT config_id, 'correct_rate' AS metric, round(correct_rate, 6) AS value FROM rates
  UNION ALL SELECT config_id, 'refusal_rate', round(refusal_rate, 6) FROM rates
  UNION ALL SELECT config_id, 'total_rate', round(total_rate, 6) FROM rates),
deltas AS (
  SELECT config_a, config_b, metric, b.value - a.value AS delta
  FROM pairs JOIN rate_metrics a ON a.config_id = config_a JOIN rate_metrics b USING (metric) WHERE b.config_id = config_b),
direction AS (
  SELECT config_a, config_b, count_if(delta > 0)::BIGINT AS n_up, count_if(delta < 0)::BIGINT AS n_down,
         count(DISTINCT CASE WHEN delta <> 0 THEN sign(delta) END) = 1 AS same_direction
  FROM deltas GROUP BY 1, 2)"""

_RECORDS = f"""
records AS (
  SELECT {_TURNS} AS rec_id, CASE role WHEN 'assistant' THEN 'real' WHEN 'user' THEN 'synthetic' ELSE 'template' END AS kind,
         'src' || {hash_mod(22, "'r'", _TURNS)} AS source_ref, role AS prompt, text AS response
  FROM conversations),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY kind ORDER BY md5(concat_ws('|', rec_id::VARCHAR, '7')), rec_id) AS place
  FROM records)"""

_CHUNK_COLUMNS = "collection, chunk_no, doc_id, pos, text"

_PAIRED = _VERDICTS + f""",
{_PAIRS},
paired AS (
  SELECT config_a, config_b, a.qid, a.in_corpus, a.refused AS ra, b.refused AS rb,
         CASE WHEN a.in_corpus THEN a.correct ELSE a.refused END AS right_a, CASE WHEN a.in_corpus THEN b.correct ELSE b.refused END AS right_b
  FROM pairs JOIN final a ON a.config_id = config_a JOIN final b ON b.config_id = config_b AND b.qid = a.qid AND b.in_corpus = a.in_corpus)"""
_EDGES = ", ".join(map(str, poisson_edges()))


def _tail(left: str, right: str) -> str:
    """The exact two-sided tail of an even split."""
    n, m = f"({left} + {right})", f"least({left}, {right})"
    term = f"exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) - {n} * ln(2))"
    return f"CASE WHEN 2 * {m} >= {n} THEN 1 ELSE least(1, 2 * list_sum(list_transform(range(0, {m} + 1), lambda i: {term}))) END::DOUBLE"


def _pair_deltas(source: str, keys: str) -> str:
    f1 = lambda s: f"(2 * sum(w * (NOT in_corpus AND r{s})::INT) / nullif(2 * sum(w * (NOT in_corpus AND r{s})::INT) + sum(w * (in_corpus AND r{s})::INT) + sum(w * (NOT in_corpus AND NOT r{s})::INT), 0))"
    rate = lambda s: f"(sum(w * right_{s}::INT) / nullif(sum(w), 0))"
    return f"""
  SELECT {keys}, unnest(['f1', 'total_rate']) AS metric, sum(w)::BIGINT AS n,
         unnest([round({f1('b')} - {f1('a')}, 10), round({rate('b')} - {rate('a')}, 10)]) AS delta
  FROM {source} GROUP BY {keys}"""


ORACLES: dict[str, str] = {
    "paired_bootstrap": f"""
WITH {_PAIRED},
digests AS (SELECT *, md5(concat_ws('|', '7', qid::VARCHAR, g::VARCHAR)) AS d FROM paired, (SELECT unnest(range(40)) AS g)),
drawn AS (
  SELECT *, len(list_filter([{_EDGES}], lambda t: t <= ('0x' || substr(d, 1 + 6 * j, 6))::BIGINT)) AS w
  FROM (SELECT *, unnest(range(5)) AS j FROM digests)),
replicates AS ({_pair_deltas("drawn", "config_a, config_b, g, j")}),
ranked AS (SELECT config_a, config_b, metric, list(delta ORDER BY delta) FILTER (delta IS NOT NULL) AS ds FROM replicates GROUP BY ALL),
whole AS ({_pair_deltas("(SELECT *, 1 AS w FROM paired)", "config_a, config_b")})
SELECT config_a, config_b, metric, n, round(delta, 6) AS delta, len(ds)::INT AS n_replicates,
       round(ds[greatest(ceil(round(len(ds) * 0.025::DOUBLE, 9)), 1)::INT], 6) AS low,
       round(ds[(len(ds) + 1 - greatest(ceil(round(len(ds) * 0.025::DOUBLE, 9)), 1))::INT], 6) AS high
FROM whole JOIN ranked USING (config_a, config_b, metric)""",
    "mcnemar": f"""
WITH {_PAIRED},
counts AS (
  SELECT config_a, config_b, count(*) AS n, count_if(right_a AND NOT right_b)::BIGINT AS only_a, count_if(NOT right_a AND right_b)::BIGINT AS only_b
  FROM paired GROUP BY ALL)
SELECT *, round({_tail("only_a", "only_b")}, 6) AS p FROM counts""",
    "ablation_effects": f"""
WITH {_VERDICTS},
variants AS (SELECT *, (list_position({study.CONFIG_IDS}, config_id) - 1)::INT AS variant FROM final),
scored AS ({matrix("variants", "variant")}),
moved AS (
  SELECT b.variant, count(*) AS n_paired, count_if(a.refused = a.in_corpus AND b.refused <> b.in_corpus)::BIGINT AS gained,
         count_if(a.refused <> a.in_corpus AND b.refused = b.in_corpus)::BIGINT AS lost
  FROM variants b JOIN variants a ON a.qid = b.qid AND a.variant = 0 GROUP BY b.variant)
SELECT 'prompt' AS template_id, variant, tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       n_paired, gained, lost, round(f1 - (SELECT f1 FROM scored WHERE variant = 0), 6) AS delta_f1, round({_tail("lost", "gained")}, 6) AS p
FROM scored JOIN moved USING (variant)""",
    "corpus_scan": "SELECT doc_id, lang, source, n_chars FROM documents "
    "WHERE lang IN ('de', 'fr') AND source IN ('src1', 'src2', 'src3')",
    "ingest_stream": f"WITH {chunk_ctes('lang')} SELECT {_CHUNK_COLUMNS} FROM chunks",
    "ingest_blocks": f"""
WITH revised AS (SELECT doc_id, lang, CASE WHEN source = 'src1' THEN coalesce(text, '') || ' (revised)' ELSE text END AS text
  FROM documents WHERE lang IS NOT NULL), {chunk_ctes("lang", source="revised")}
SELECT {_CHUNK_COLUMNS} FROM chunks""",
    "chunk_documents": f"WITH {chunk_ctes('source')} SELECT {_CHUNK_COLUMNS} FROM chunks",
    "build_collection": f"""WITH {chunk_ctes("'sample'")} SELECT {_CHUNK_COLUMNS} FROM chunks""",
    "resolve_collection": f"""
WITH src AS (
  SELECT source AS session, doc_id,
         CASE WHEN {hash_mod(2, "'s'", "source")} = 0 AND {hash_mod(10, "'o'", "doc_id")} < 3
              THEN 'uploaded' ELSE 'builtin' END AS origin
  FROM documents)
SELECT session, origin, doc_id FROM src
WHERE origin = 'uploaded' OR session NOT IN (SELECT session FROM src WHERE origin = 'uploaded')""",
    "audit_collection": f"""
WITH {chunk_ctes("lang")},
stored AS (SELECT * FROM chunks UNION ALL SELECT * FROM chunks WHERE collection = 'fr'),
expected AS (SELECT collection, sum(n)::BIGINT AS expected FROM chunks_n GROUP BY 1)
SELECT collection, count(*) AS n_chunks, any_value(expected) AS expected,
       count(*) - count(DISTINCT chunk_no) AS repeated_numbers, count(*) - count(DISTINCT text) AS repeated_texts,
       count(*) = any_value(expected) AND count(*) = count(DISTINCT chunk_no) AS ok
FROM stored JOIN expected USING (collection) GROUP BY collection""",
    "align_numbering": f"""
WITH {chunk_ctes("'c'", "l")}, {chunk_ctes("'c'", "r", "(SELECT * FROM documents WHERE lang <> 'es')")}
SELECT chunk_no, CASE WHEN r.text IS NULL THEN 'left_only' WHEN l.text IS NULL THEN 'right_only'
                      WHEN l.text = r.text THEN 'same' ELSE 'different' END AS status
FROM l FULL OUTER JOIN r USING (chunk_no)""",
    # Nothing changes its order here, so no passage is moved.
    "rewrite_phrases": f"""
WITH RECURSIVE {_USER},
split AS (SELECT qid, string_split(question, ' ') AS w FROM user_question WHERE question IS NOT NULL),
terms AS (SELECT unnest([array_to_string(w[2:3], ' '), array_to_string(w[3:5], ' '), array_to_string(w[2:5], ' ')]) AS term FROM split),
rules AS (SELECT lower(term) AS term, min('<' || term || '>') AS replacement, any_value(len(string_split(term, ' '))) AS size FROM terms GROUP BY 1),
places AS (SELECT qid, w, unnest(range(1, len(w) + 1)) AS pos FROM split),
ends AS (
  SELECT qid, pos, max(size) AS size, max_by(replacement, size) AS replacement
  FROM (SELECT *, unnest(range(1, 5)) AS size FROM places) p JOIN rules r USING (size)
  WHERE pos + size - 1 <= len(w) AND lower(array_to_string(w[pos:pos + size - 1], ' ')) = r.term GROUP BY qid, pos),
walk AS (
  SELECT qid, 1::BIGINT AS pos, []::VARCHAR[] AS out FROM split
  UNION ALL
  SELECT qid, pos + coalesce(size, 1), list_append(out, coalesce(replacement, w[pos])) FROM walk JOIN split USING (qid) LEFT JOIN ends USING (qid, pos)
  WHERE pos <= len(w))
SELECT user_question.qid, array_to_string(out, ' ') AS rewritten FROM user_question
LEFT JOIN (SELECT walk.* FROM walk JOIN split USING (qid) WHERE pos > len(w)) USING (qid)""",
    "align_shifted": f"""
WITH {chunk_ctes("'corpus'", "l")},
later AS (SELECT doc_id, text FROM documents WHERE lang IS NULL OR lang <> 'es'
  UNION ALL SELECT -1 - doc_id, 'revised ' || text FROM documents WHERE lang = 'de'),
{chunk_ctes("'corpus'", "r", "later")},
lt AS (SELECT text, count(*) AS n, min(chunk_no) AS no FROM l GROUP BY text), rt AS (SELECT text, count(*) AS n, min(chunk_no) AS no FROM r GROUP BY text)
SELECT 'corpus' AS collection, lt.no AS left_no, rt.no AS right_no, CASE WHEN lt.no = rt.no THEN 'same' ELSE 'shifted' END AS status
FROM lt JOIN rt USING (text) WHERE lt.n = 1 AND rt.n = 1
UNION ALL SELECT 'corpus', l.chunk_no, 0, CASE WHEN rt.n IS NULL THEN 'deleted' ELSE 'repeated' END
FROM l JOIN lt USING (text) LEFT JOIN rt USING (text) WHERE NOT (lt.n = 1 AND coalesce(rt.n, 0) = 1)
UNION ALL SELECT 'corpus', 0, r.chunk_no, CASE WHEN lt.n IS NULL THEN 'inserted' ELSE 'repeated' END
FROM r JOIN rt USING (text) LEFT JOIN lt USING (text) WHERE NOT (rt.n = 1 AND coalesce(lt.n, 0) = 1)""",
    "open_collection": f"WITH {chunk_ctes('lang')} SELECT {_CHUNK_COLUMNS} FROM chunks WHERE collection = 'de'",
    "with_instruction": f"WITH {_USER} SELECT qid, '{study.INSTRUCTION}' || question AS question FROM user_question",
    "rewrite_queries": f"""
WITH {_USER},
vocabulary AS (SELECT list(DISTINCT w) AS known FROM (SELECT unnest({words("text")}) AS w FROM benchmark))
SELECT qid, array_to_string(list_transform(string_split(question, ' '),
         lambda w: CASE WHEN list_contains(known, lower(w)) THEN '<' || lower(w) || '>' ELSE w END), ' ') AS rewritten
FROM user_question, vocabulary""",
    "encode_text": f"""
WITH {_DOC_STATS},
weights AS (SELECT id, {_BUCKET} AS bucket, sum((1 + ln(tf)) * idf) AS w FROM postings JOIN terms USING (token) GROUP BY 1, 2)
SELECT id, bucket::INT AS bucket, round(coalesce(w, 0), 6) AS weight
FROM (SELECT id, unnest(range(64)) AS bucket FROM unit) LEFT JOIN weights USING (id, bucket)""",
    "encode_with_model": "SELECT doc_id AS id, length(text)::BIGINT AS x0, "
    "(length(text) - length(replace(text, ' ', '')))::BIGINT AS x1 FROM documents",
    "term_postings": f"WITH {_DOC_STATS} SELECT id, token, tf, doc_len FROM postings",
    "term_stats": f"WITH {_DOC_STATS} SELECT token, df, round(idf, 6) AS idf FROM terms",
    "term_stats_bigram": f"WITH {stats_ctes(_DOCUMENT_UNITS, 'bigram')} SELECT token, df, round(idf, 6) AS idf FROM terms",
    "exact_topk": f"WITH {_EMBED} SELECT * FROM exact",
    "exact_topk_text": f"WITH {_DOC_STATS}, {vector_cte(8)} SELECT * FROM vector",
    "ann_topk_prefix": f"WITH {_EMBED}, {pooled_cte(50)} SELECT * FROM pooled",
    "ann_topk_ivf_all_cells": f"WITH {_EMBED} SELECT * FROM exact",
    "ann_topk_tree_all_cells": f"WITH {_EMBED} SELECT * FROM exact",
    "exact_topk_bounded": f"WITH {_EMBED} SELECT * FROM exact",
    "ann_topk_ivf_label_cells": f"""
WITH {_EMBED},
cell_of AS (
  SELECT id, cell FROM (
    SELECT id, qid AS cell, row_number() OVER (
      PARTITION BY id ORDER BY round(list_dot_product(q, q) - 2 * list_dot_product(v, q), 9), qid) AS place FROM centers, rows)
  WHERE place = 1),
probes AS (
  SELECT qid, cell FROM (
    SELECT a.qid, b.qid AS cell, row_number() OVER (
      PARTITION BY a.qid ORDER BY round(list_dot_product(b.q, b.q) - 2 * list_dot_product(a.q, b.q), 9), b.qid) AS place
    FROM centers a, centers b)
  WHERE place <= 4)
SELECT qid, rank, id, round(score, 6) AS score FROM (
  SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INT AS rank
  FROM scored JOIN cell_of USING (id) JOIN probes USING (qid, cell))
WHERE rank <= 8""",
    "compare_topk": f"""
WITH {_EMBED}, {pooled_cte(10)},
a AS (SELECT qid, list(id ORDER BY rank) AS ids FROM exact GROUP BY qid),
b AS (SELECT qid, list(id ORDER BY rank) AS ids FROM pooled GROUP BY qid)
SELECT qid, array_to_string(a.ids, ',') AS a_ids, array_to_string(b.ids, ',') AS b_ids, a.ids = b.ids AS identical,
       round(len(list_intersect(a.ids, b.ids)) / 8, 6) AS overlap
FROM a JOIN b USING (qid)""",
    "compare_pools": f"""
WITH {_EMBED}, {pooled_cte(10, "p10")}, {pooled_cte(200, "p200")}, {pooled_cte(1_000_000_000, "pall")},
pools AS (SELECT '10' AS pool, * FROM p10 UNION ALL SELECT '200', * FROM p200 UNION ALL SELECT 'all', * FROM pall),
a AS (SELECT qid, list(id ORDER BY rank) AS ids FROM exact GROUP BY qid),
b AS (SELECT pool, qid, list(id ORDER BY rank) AS ids FROM pools GROUP BY pool, qid)
SELECT pool, count(*) AS n_queries, count_if(a.ids = b.ids)::BIGINT AS n_identical,
       round(avg(len(list_intersect(a.ids, b.ids)) / 8), 6) AS overlap FROM a JOIN b USING (qid) GROUP BY pool""",
    "bm25_topk_bigram": f"WITH {stats_ctes(_DOCUMENT_UNITS, 'bigram')}, {lexical_cte(8, split='bigram')} SELECT * FROM lexical",
    "encode_text_bigram": f"""
WITH {stats_ctes(_DOCUMENT_UNITS, "bigram")},
weights AS (SELECT id, {_BUCKET} AS bucket, sum((1 + ln(tf)) * idf) AS w FROM postings JOIN terms USING (token) GROUP BY 1, 2)
SELECT id, bucket::INT AS bucket, round(coalesce(w, 0), 6) AS weight
FROM (SELECT id, unnest(range(64)) AS bucket FROM unit) LEFT JOIN weights USING (id, bucket)""",
    "bm25_topk_postings": f"WITH {_DOC_STATS}, {lexical_cte(8)} SELECT * FROM lexical",
    "bm25_topk": f"WITH {_DOC_STATS}, {lexical_cte(8)} SELECT * FROM lexical",
    "rrf_fuse": f"""
WITH {_DOC_STATS}, {lexical_cte(50)}, {vector_cte(50)},
fused AS (
  SELECT qid, id, round(sum(1 / (60 + rank)), 9) AS score
  FROM (SELECT * FROM lexical UNION ALL SELECT * FROM vector) GROUP BY qid, id)
SELECT qid, rank, id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INT AS rank FROM fused) WHERE rank <= 8""",
    "sweep_k": f"""
WITH {_DOC_STATS}, {vector_cte(8)}, {gold_cte()},
best AS (SELECT qid, min(rank) AS r FROM gold LEFT JOIN vector USING (qid, id) GROUP BY qid)
SELECT k::INT AS k, count(*) AS n_questions, count_if(coalesce(r <= k, false))::BIGINT AS n_hits,
       round(avg(coalesce(r <= k, false)::INT), 6) AS hit_rate
FROM (SELECT r, unnest([1, 2, 4, 8]) AS k FROM best) GROUP BY k""",
    "smallest_window": f"""
WITH {_DOC_STATS}, {vector_cte(8)}, {gold_cte()},
best AS (SELECT qid, min(rank) AS r FROM gold LEFT JOIN vector USING (qid, id) GROUP BY qid)
SELECT qid, coalesce(r, 0)::INT AS gold_rank,
       (CASE WHEN r <= 1 THEN 1 WHEN r <= 2 THEN 2 WHEN r <= 4 THEN 4 WHEN r <= 8 THEN 8 ELSE 0 END)::INT AS k
FROM best""",
    "rank_displacement": f"""
WITH {_DOC_STATS}, {vector_cte(50, "va")}, {vector_cte(50, "vb", study.INSTRUCTION)}, {gold_cte()},
a AS (SELECT qid, min(rank) AS r FROM gold LEFT JOIN va USING (qid, id) GROUP BY qid),
b AS (SELECT qid, min(rank) AS r FROM gold LEFT JOIN vb USING (qid, id) GROUP BY qid)
SELECT qid, coalesce(a.r, 0)::INT AS rank_a, coalesce(b.r, 0)::INT AS rank_b, coalesce(b.r - a.r, 0)::INT AS displacement,
       CASE WHEN coalesce(a.r <= 4, false) AND NOT coalesce(b.r <= 4, false) THEN 'lost'
            WHEN NOT coalesce(a.r <= 4, false) AND coalesce(b.r <= 4, false) THEN 'gained' ELSE 'same' END AS border
FROM a JOIN b USING (qid)""",
    "assemble_context": f"""
WITH {_CHUNK_STATS}, {lexical_cte(8)},
context AS (
  SELECT qid, count(*)::INT AS n_passages, string_agg('[资料§' || id || '] ' || text, chr(10) ORDER BY rank) AS context
  FROM lexical JOIN unit USING (id) GROUP BY qid)
SELECT qid, coalesce(n_passages, 0)::INT AS n_passages,
       'Answer from the passages only.' || chr(10) || coalesce(context, '') || chr(10) || 'Question: ' || question
       || chr(10) || 'Answer:' AS prompt
FROM question LEFT JOIN context USING (qid)""",
    "extractive_answers": f"""
WITH {_CHUNK_STATS}, {lexical_cte(8)}, ANSWERS
SELECT * FROM answers""",
    "extract_citations": f"WITH {_CITED} SELECT config_id, qid, run, array_to_string(cites, ',') AS citations FROM parsed",
    "illegal_citations": f"""
WITH {_CITED} SELECT config_id, qid, run, array_to_string(illegal, ',') AS illegal, len(illegal)::INT AS n_illegal FROM illegal""",
    "enforce_whitelist": f"WITH {_CITED} SELECT config_id, qid, run, answer FROM whitelisted",
    "apply_retry": f"WITH {_CITED}, {_JUDGED}, {_RETRIED} SELECT * FROM retried",
    "dedupe_citations": f"""
WITH {_CITED}
SELECT config_id, qid, run, (len(cites) - len(list_distinct(cites)))::INT AS n_repeated,
       array_to_string(list_transform(range(1, len(parts) + 1), lambda i: CASE
         WHEN i > len(marks) THEN parts[i]
         WHEN i > 1 AND marks[i] = marks[i - 1] AND regexp_full_match(parts[i], '[、，,]?\\s*') THEN ''
         ELSE parts[i] || marks[i] END), '') AS answer
FROM parsed""",
    "verdict_flips": f"""
WITH {_CITED}, {_JUDGED}, {_RETRIED},
a AS ({judged("cited")}), b AS ({judged("retried")})
SELECT config_id, count_if(a.correct IS NOT NULL AND b.correct IS NOT NULL)::BIGINT AS n_compared, count_if(NOT a.correct AND b.correct)::BIGINT AS n_gained,
       count_if(a.correct AND NOT b.correct)::BIGINT AS n_lost, count_if(a.correct <> b.correct)::BIGINT AS n_flipped,
       count_if(a.correct IS NULL OR b.correct IS NULL)::BIGINT AS n_unmatched
FROM a FULL JOIN b USING (config_id, qid, run) GROUP BY config_id""",
    "judge": f"WITH {_JUDGED} {judged('j_answers')}",
    "majority": f"WITH {_VERDICTS} SELECT * FROM final",
    "retrieval_hits": f"""
WITH {_CHUNK_STATS}, {lexical_cte(8)}, {gold_cte("unit", "gold_c")}, {gold_cte(f"({_DOCUMENT_UNITS})", "gold_d")},
strict AS (SELECT DISTINCT qid FROM lexical JOIN gold_c USING (qid, id)),
loose AS (
  SELECT DISTINCT l.qid FROM lexical l JOIN chunks c ON c.chunk_no = l.id JOIN gold_d g ON g.qid = l.qid AND g.id = c.doc_id),
asked AS (SELECT DISTINCT qid FROM gold_d)
SELECT count(*) AS n_questions, count(s.qid) AS n_strict, count(l.qid) AS n_loose,
       round(count(s.qid) / count(*), 6) AS strict_rate, round(count(l.qid) / count(*), 6) AS loose_rate
FROM asked LEFT JOIN strict s USING (qid) LEFT JOIN loose l USING (qid)""",
    "answer_rates": f"""
WITH {_RATES}
SELECT config_id, n, n_correct, n_refused, round(correct_rate, 6) AS correct_rate, round(refusal_rate, 6) AS refusal_rate,
       round(total_rate, 6) AS total_rate FROM rates""",
    "confusion": f"WITH {_MATRIX} SELECT * FROM matrix_r",
    "answer_quality": f"""
WITH {_CHUNK_STATS}, {lexical_cte(8)}, ANSWERS, {gold_cte(f"({_DOCUMENT_UNITS})")},
scored AS (
  SELECT 'lexical' AS config_id, qid IN (SELECT qid FROM gold) AS in_corpus, answer = '{study.REFUSAL}' AS refused FROM answers)
SELECT config_id, tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1
FROM ({matrix("scored")})""",
    "proportion_ci": f"""
WITH {_RATES}
SELECT config_id, n, round(total_rate, 6) AS total_rate, round(1.96 * sqrt(0.25 / n), 6) AS half_width,
       round((p + zz / (2 * n)) / (1 + zz / n) - 1.96 * sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n), 6) AS wilson_low,
       round((p + zz / (2 * n)) / (1 + zz / n) + 1.96 * sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n), 6) AS wilson_high
FROM (SELECT *, total_rate AS p, 1.96::DOUBLE * 1.96::DOUBLE AS zz FROM rates)""",
    "check_consistency": f"""
WITH {_MATRIX},
stated AS (SELECT config_id, round(f1, 3) + CASE WHEN config_id = 'retry' THEN 0.01 ELSE 0 END AS f1, f1 AS recomputed FROM matrix)
SELECT config_id, round(f1, 6) AS f1, round(recomputed, 6) AS recomputed,
       coalesce(round(abs(f1 - recomputed), 9) <= 0.0005, false) AS ok FROM stated""",
    "parse_run_logs": f"WITH {_MATRIX} SELECT config_id, metric, coalesce(value, 0) AS value, CASE WHEN value IS NULL THEN 'absent' ELSE 'found' END AS state FROM metrics",
    "final_table": f"WITH {_MATRIX} SELECT metric, "
    + ", ".join(f"max(CASE WHEN config_id = '{c}' THEN value END) AS {c}" for c in study.CONFIG_IDS)
    + ", '' AS conflicts, '' AS unlisted FROM metrics GROUP BY metric",
    "compare_runs": f"""
WITH {_MATRIX}, {_PAIRS},
params(config_id, key, value) AS (VALUES {_PARAM_ROWS}),
keys AS (SELECT unnest({study.CALIBER}) AS key, unnest(range({len(study.CALIBER)})) AS place),
reasons AS (
  SELECT config_a, config_b,
         coalesce(string_agg(keys.key, ',' ORDER BY place) FILTER (NOT coalesce(a.value = b.value, false)), '') AS reason
  FROM pairs CROSS JOIN keys LEFT JOIN params a ON a.config_id = config_a AND a.key = keys.key
  LEFT JOIN params b ON b.config_id = config_b AND b.key = keys.key GROUP BY 1, 2)
SELECT config_a, config_b, a.metric, CASE WHEN reason = '' THEN round(b.value - a.value, 6) ELSE 0 END AS delta,
       CASE WHEN reason = '' THEN '' ELSE 'differs: ' || reason END AS reason
FROM reasons JOIN metrics a ON a.config_id = config_a JOIN metrics b ON b.config_id = config_b AND b.metric = a.metric""",
    "config_diff": """
WITH counted AS (
  SELECT conv_id, count_if(role = 'user') AS u, count_if(role = 'assistant') AS a, count_if(role = 'system') AS s
  FROM conversations GROUP BY conv_id),
flat AS (
  SELECT conv_id, 'user' AS key, u::VARCHAR AS value FROM counted
  UNION ALL SELECT conv_id, 'assistant', a::VARCHAR FROM counted
  UNION ALL SELECT conv_id, CASE WHEN s > 0 THEN 'system' ELSE 'plain' END, 'yes' FROM counted),
pairs AS (SELECT x.conv_id AS a, y.conv_id AS b FROM counted x JOIN counted y ON y.conv_id = x.conv_id + 1),
keys AS (SELECT DISTINCT a, b, key FROM pairs JOIN flat ON flat.conv_id IN (a, b)),
changed AS (
  SELECT keys.a, keys.b, keys.key FROM keys LEFT JOIN flat x ON x.conv_id = keys.a AND x.key = keys.key
  LEFT JOIN flat y ON y.conv_id = keys.b AND y.key = keys.key WHERE x.value IS DISTINCT FROM y.value)
SELECT a::VARCHAR AS config_a, b::VARCHAR AS config_b, coalesce(string_agg(key, ',' ORDER BY key), '') AS changed,
       count(key)::INT AS n_changed, count(key) = 1 AS single_variable
FROM pairs LEFT JOIN changed USING (a, b) GROUP BY a, b""",
    "same_direction": f"WITH {_DELTAS} SELECT * FROM direction",
    "paired_ab": f"""
WITH {_VERDICTS}
SELECT count_if(a.qid IS NOT NULL AND b.qid IS NOT NULL)::BIGINT AS n, count_if(a.correct AND b.correct)::BIGINT AS both, count_if(a.correct AND NOT b.correct)::BIGINT AS only_a,
       count_if(NOT a.correct AND b.correct)::BIGINT AS only_b, count_if(NOT a.correct AND NOT b.correct)::BIGINT AS neither,
       round(avg(b.correct::INT) FILTER (a.qid IS NOT NULL) - avg(a.correct::INT) FILTER (b.qid IS NOT NULL), 6) AS delta,
       count_if(a.qid IS NULL)::BIGINT AS missing_a, count_if(b.qid IS NULL)::BIGINT AS missing_b
FROM (SELECT * FROM final WHERE config_id = 'base') a FULL JOIN (SELECT * FROM final WHERE config_id = 'tuned') b ON a.qid = b.qid""",
    "effect_ledger": f"""
WITH {_DELTAS},
widths AS (SELECT config_id, 1.96 * sqrt(0.25 / n) AS width FROM rates)
SELECT config_a, config_b, round(delta, 6) AS delta, same_direction,
       CASE WHEN delta = 0 THEN 'none' WHEN abs(delta) <= greatest(a.width, b.width) AND NOT same_direction THEN 'inconclusive'
            WHEN delta > 0 THEN 'gain' ELSE 'regression' END AS effect
FROM deltas JOIN direction USING (config_a, config_b) JOIN widths a ON a.config_id = config_a
JOIN widths b ON b.config_id = config_b WHERE metric = 'total_rate'""",
    "ablation_variants": f"""
WITH {_QUESTION},
parts AS (SELECT qid AS template_id, regexp_extract_all(question, '[^。！？.!?\\s][^。！？.!?]*[。！？.!?]*') AS parts FROM question)
SELECT template_id, variant::INT AS variant, CASE WHEN variant > 0 THEN parts[variant] ELSE '' END AS removed,
       array_to_string(list_filter(parts, lambda s, i: i <> variant), ' ') AS text
FROM (SELECT *, unnest(range(len(parts) + 1)) AS variant FROM parts)""",
    "fingerprint": """
WITH keyed AS (
  SELECT concat_ws('|', coalesce(length(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(length(text) || ':' || text, '-'),
                   coalesce(length(lang) || ':' || lang, '-')) AS row
  FROM documents)
SELECT count(*) AS n_rows, sum(('0x' || substr(md5(row), 1, 15))::HUGEINT)::VARCHAR AS fingerprint FROM keyed""",
    "changed_questions": """
WITH now AS (SELECT doc_id, text, lang FROM documents),
later AS (
  SELECT doc_id, CASE WHEN lang = 'fr' THEN text || '!' ELSE text END AS text, lang FROM now WHERE lang IS NULL OR lang <> 'es'
  UNION ALL SELECT -1 - doc_id, text, lang FROM now WHERE lang = 'de')
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM now a FULL JOIN later b ON a.doc_id = b.doc_id
WHERE a.doc_id IS NULL OR b.doc_id IS NULL OR a.text IS DISTINCT FROM b.text OR a.lang IS DISTINCT FROM b.lang""",
    "log_current": """
WITH latest AS (SELECT conv_id, max(turn) AS turn, count(*) AS n_versions FROM conversations GROUP BY conv_id)
SELECT conv_id AS entry_id, turn AS version, text, n_versions, 1::BIGINT AS n_same FROM conversations JOIN latest USING (conv_id, turn)""",
    "log_history": """
SELECT conv_id AS entry_id, turn AS version, text, count(*) OVER w AS n_versions, count(*) OVER v AS n_same, turn = max(turn) OVER w AS is_current
FROM conversations WINDOW w AS (PARTITION BY conv_id), v AS (PARTITION BY conv_id, turn)""",
    "training_mix": f"""
WITH {_RECORDS} SELECT rec_id, kind, source_ref, prompt, response FROM ordered
WHERE (kind = 'real' AND place <= 201) OR (kind = 'synthetic' AND place <= 99)""",
    "mix_variants": f"""
WITH {_RECORDS},
specs(variant, kind, n) AS (VALUES ('real only', 'real', 201), ('aligned', 'real', 201), ('aligned', 'synthetic', 99),
                                   ('even', 'real', 150), ('even', 'synthetic', 150))
SELECT variant, kind, rec_id FROM ordered JOIN specs USING (kind) WHERE place <= n""",
    "provenance_audit": f"""
WITH {_RECORDS}
SELECT kind, count(*) AS n_records, count_if(lost)::BIGINT AS n_untraceable, count_if(lost) = 0 AS ok
FROM (SELECT *, kind = 'real' AND source_ref NOT IN (SELECT source FROM documents) AS lost FROM records) GROUP BY kind""",
    "distribution_gap": f"""
WITH {_RECORDS},
a AS (SELECT length(response) // 100 AS band, count(*) AS n FROM records WHERE kind = 'real' GROUP BY 1),
b AS (SELECT length(text) // 100 AS band, count(*) AS n FROM documents GROUP BY 1),
c AS (SELECT band, coalesce(a.n, 0) AS n_train, coalesce(b.n, 0) AS n_eval,
             coalesce(a.n, 0) / (SELECT sum(n) FROM a) AS p, coalesce(b.n, 0) / (SELECT sum(n) FROM b) AS q
      FROM a FULL OUTER JOIN b USING (band))
SELECT band, n_train, n_eval, round(p, 6) AS p_train, round(q, 6) AS p_eval, round(p - q, 6) AS gap,
       round((SELECT sum(abs(p - q)) / 2 FROM c), 6) AS total_variation FROM c""",
}

_ANSWERS = f"""
covered AS (
  SELECT qid, rank, id, text, round(len(list_intersect(asked, {words("text")})) / len(asked), 6) AS coverage
  FROM lexical JOIN unit USING (id) JOIN (SELECT qid, list_distinct({words("question")}) AS asked FROM question) USING (qid)),
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY coverage DESC, rank) AS place FROM covered) WHERE place = 1),
answers AS (
  SELECT qid, CASE WHEN coalesce(coverage >= {study.THRESHOLD}, false) THEN id ELSE 0 END AS chunk_no,
         coalesce(coverage, 0) AS coverage,
         CASE WHEN coalesce(coverage >= {study.THRESHOLD}, false) THEN text || ' [资料§' || id || ']' ELSE '{study.REFUSAL}' END AS answer
  FROM question LEFT JOIN best USING (qid))"""
for _name in ("extractive_answers", "answer_quality"):
    ORACLES[_name] = ORACLES[_name].replace("ANSWERS", _ANSWERS)

_LEFT_OVER = f"""
WITH {_CITED}
SELECT * FROM whitelisted
WHERE len(list_filter(regexp_extract_all(answer, '\\[资料§(\\d+)\\]', 1), lambda n: NOT list_contains(ids, n::BIGINT))) > 0"""
_GATE = {
    "collection": f"SELECT count(*) FROM ({ORACLES['audit_collection']}) WHERE NOT ok",
    "numbering": f"SELECT count(*) FROM ({ORACLES['align_numbering']}) WHERE status <> 'same'",
    "top_ids": f"SELECT count(*) FROM ({ORACLES['compare_topk']}) WHERE NOT identical",
    "citations": f"SELECT count(*) FROM ({_LEFT_OVER})",
    "matrix": f"SELECT count(*) FROM ({ORACLES['check_consistency']}) WHERE NOT ok",
}
ORACLES["release_gate"] = (
    "SELECT count(*) AS n_checks, bool_and(n = 0) AS passed, "
    "coalesce(string_agg(check_name, ',' ORDER BY check_name) FILTER (n > 0), '') AS failing, '' AS empty FROM ("
    + " UNION ALL ".join(f"SELECT '{name}' AS check_name, ({sql}) AS n" for name, sql in _GATE.items())
    + ")"
)
