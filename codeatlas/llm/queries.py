"""Registered queries of the operators and their DuckDB SQL.

Each query applies its operator with production parameters to its whole table.
Where SQL can't express an operator (learned models, tokenizers, wrappers) it
has none here and is tested against a brute-force version in ``tests/llm``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeatlas.llm.common import table
from codeatlas.session import checkpoint_dir


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeatlas.llm.toxicity import toxicity
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeatlas.llm.mixing import mix
    return mix(table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeatlas.llm.tokenfiles import read_documents, write_documents
    folder = f"{checkpoint_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_documents(table(spark, sf_dir, "documents"), folder)
    return read_documents(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeatlas.llm.near_dedup import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2, percent=80)


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeatlas.llm.topk import top_k
    return top_k(table(spark, sf_dir, "embeddings"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeatlas.llm.packing import pack
    return pack(table(spark, sf_dir, "documents")).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeatlas.llm.token_counts import token_counts
    return token_counts(table(spark, sf_dir, "documents"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeatlas.llm.wrappers import main_text
    return main_text(table(spark, sf_dir, "pages"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeatlas.llm.langid import languages
    return languages(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeatlas.llm.quality_rules import quality
    return quality(table(spark, sf_dir, "documents"))


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeatlas.llm.embedding_dedup import near_vectors
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeatlas.llm.divergence import divergence
    return divergence(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeatlas.llm.conversations import repair_digests
    return repair_digests(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_mixing, op3_token_files, op4_near_dedup, op5_top_k, op6_packing,
                                   op7_token_counts, op8_main_text, op9_language, op10_quality_rules,
                                   op11_embedding_dedup, op12_source_divergence, op13_conversation_repair)}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')"

ORACLE = {
    "op2_mixing": """
WITH size AS (SELECT source, CAST(sum(length(coalesce(text, ''))) AS DOUBLE) AS chars FROM documents GROUP BY source),
target AS (SELECT *, pow(chars, 0.5) AS weight FROM size),
rated AS (SELECT source, (SELECT sum(chars) FROM target) * weight / (SELECT sum(weight) FROM target WHERE chars > 0) / chars AS rate
          FROM target WHERE chars > 0 AND weight > 0),
parts AS (SELECT source, CAST(ceil(rate / 8.0) AS BIGINT) AS parts, rate / ceil(rate / 8.0) AS mean FROM rated WHERE rate > 0),
cdf AS (SELECT source, k, sum(exp(-mean + k * ln(mean) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c
        FROM parts, range(64) AS r(k)),
fields AS (SELECT *, coalesce(CAST(doc_id AS VARCHAR), 'null') AS ident, count(*) OVER (PARTITION BY doc_id) AS same,
                  md5(coalesce('1' || length(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '0') || coalesce('1' || length(text) || ':' || text, '0')
                      || coalesce('1' || length(lang) || ':' || lang, '0') || coalesce('1' || length(source) || ':' || source, '0')
                      || coalesce('1' || length(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '0')) AS digest FROM documents),
keyed AS (SELECT *, CASE WHEN same = 1 THEN ident ELSE ident || ':' || digest || ':' || row_number() OVER (PARTITION BY doc_id, digest) END AS key FROM fields),
draws AS (SELECT d.*, row_number() OVER () AS rid, p.parts FROM keyed d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source),
chances AS (SELECT rid, source, CAST('0x' || substr(md5('mix-1:' || key || ':' || j), 1, 13) AS BIGINT) / 4503599627370496.0 AS u
            FROM draws, range(1, 100000) AS r(j) WHERE j <= parts),
counts AS (SELECT rid, sum((SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM chances.source AND cdf.c <= chances.u)) AS n FROM chances GROUP BY rid)
SELECT doc_id, text, lang, source, n_chars, CAST(copy AS INTEGER) AS copy,
       md5('mix-1:' || key || ':' || copy || ':order') AS shuffle_key
FROM draws JOIN counts USING (rid), LATERAL (SELECT unnest(range(1, CAST(n AS BIGINT) + 1)) AS copy)
""",
    "op4_near_dedup": """
WITH RECURSIVE low AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                         '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM documents),
spread AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM low),
sh AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, n, word || ' ' || lead(word) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM spread) WHERE s IS NOT NULL
       UNION ALL SELECT doc_id, word FROM spread WHERE n = 1),
sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * common >= 80 * (p.n + q.n - common)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS id, doc_id AS r FROM documents UNION SELECT reach.id, edges.b FROM reach JOIN edges ON reach.r = edges.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT id, min(r) AS component_id FROM reach GROUP BY id) c ON c.id = d.doc_id
""",
    "op5_top_k": """
WITH v AS (SELECT row_number() OVER () AS nth, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.nth, q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score FROM v q JOIN v ON v.nth <> q.nth WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY nth ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY nth ORDER BY score DESC, vec_id) <= 20
""",
    "op10_quality_rules": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
spread AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
grams AS (SELECT rid, i, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS g FROM spread WINDOW o AS (PARTITION BY rid ORDER BY i)),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM grams WHERE g IS NOT NULL) WHERE n > 1),
repeats AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY rid),
lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
line_counts AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines
                WHERE regexp_matches(line, '[^ \\t\\n\\x0B\\f\\r]') GROUP BY rid),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
             length(regexp_replace(text, '[^A-Z]', '', 'g')) AS upper_n, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS letter_n,
             length(regexp_replace(text, '[^!]', '', 'g')) AS bang_n, len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\\x00-\\x7F]'))) AS lettered
      FROM d LEFT JOIN repeats USING (rid) LEFT JOIN line_counts USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines OR word_chars < 2 * n_words OR word_chars > 14 * n_words
                                OR 2 * upper_n > letter_n OR 10 * bang_n > 3 * n_words OR 100 * lettered < 80 * n_words) AS kept
FROM b
""",
    "op11_embedding_dedup": """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
sound AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
          AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT x.rid AS a, y.rid AS b FROM sound x JOIN sound y ON x.label = y.label AND len(x.e) = len(y.e) AND x.rid <> y.rid
          WHERE CASE WHEN len(x.e) = len(y.e) THEN list_cosine_similarity(x.e, y.e) >= 0.93 END),
reach AS (SELECT rid, rid AS r FROM v UNION SELECT reach.rid, links.b FROM reach JOIN links ON reach.r = links.a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, v.vec_id IS NULL OR v.vec_id = c.component_id AS kept
FROM v LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = v.rid
JOIN (SELECT reach.rid, min(o.vec_id) AS component_id FROM reach JOIN v o ON o.rid = reach.r GROUP BY reach.rid) c ON c.rid = v.rid
""",
    "op12_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
words AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT rid) >= 30),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT g.lang, g.source, CAST(coalesce(sum(n.n), 0) AS HUGEINT) AS total FROM groups g LEFT JOIN n USING (lang, source) GROUP BY ALL),
lang_totals AS (SELECT lang, sum(total) AS total FROM totals GROUP BY lang),
p AS (SELECT t.lang, t.source, k.term, coalesce(n.n, 0) AS n, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(n.n, 0) + 5) // (t.total + 5 * v.v) AS p
      FROM totals t JOIN v USING (lang) JOIN kept k USING (lang) LEFT JOIN n ON n.lang = t.lang AND n.source = t.source AND n.term = k.term),
q AS (SELECT lang, term, 1 + CAST(1000000000 AS HUGEINT) * (sum(n) + 5) // (any_value(l.total) + 5 * any_value(v.v)) AS q
      FROM p JOIN lang_totals l USING (lang) JOIN v USING (lang) GROUP BY lang, term),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
                 CAST(coalesce((SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term
                                WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS BIGINT) AS value
          FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST(p - q AS BIGINT) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
UNION ALL
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM terms
QUALIFY rank <= 50
""",
    "op13_conversation_repair": r"""
WITH RECURSIVE named AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
kinds AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                 xor(list_reduce(list_transform(string_split(name, ''), lambda c: CAST(ord(c) AS BIGINT)),
                                 lambda crc, b: list_reduce(range(8), lambda r, k: xor(r >> 1, (r & 1) * 3988292384), xor(crc, b)), CAST(4294967295 AS BIGINT)),
                     CAST(4294967295 AS BIGINT)) % 20 AS kind FROM named),
hurt AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS again FROM kinds WHERE kind <> 0),
ids AS (SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
placed AS (SELECT c, turn, role, text, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || ':' || text), again) AS i
           FROM hurt JOIN ids ON hurt.conv_id IS NOT DISTINCT FROM ids.conv_id),
body AS (SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS b, row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS again,
                substr(role, 1, 1) AS f FROM placed),
rows AS (SELECT *, CASE WHEN b = '' THEN 1 WHEN again THEN 2 WHEN right(b, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
                coalesce(f || lead(f) OVER (PARTITION BY c ORDER BY i) NOT IN ('su', 'ua', 'au'), false) AS wrong FROM body),
cost(c, i, v0, v1, v2, v3) AS (
  SELECT c, max(i) + 1, 0, 4, 2, 0 FROM rows GROUP BY c
  UNION ALL
  SELECT c, i, least(e0, 2 + least(e2, 2 + e3)), least(e1, 2 + least(e2, 2 + e3)), least(e2, 2 + e3), least(e3, 2 + e2) FROM (
    SELECT r.c, r.i,
           least(3 + v0, CASE WHEN ok AND f = 's' THEN t + v1 WHEN ok AND f = 'u' THEN t + v2 END, CASE WHEN ok THEN 2 + t + v2 END) AS e0,
           least(3 + v1, CASE WHEN ok AND f = 'u' THEN t + v2 END, CASE WHEN ok THEN 2 + t + v2 END) AS e1,
           least(3 + v2, CASE WHEN ok AND f = 'a' THEN t + v3 END, CASE WHEN ok THEN 2 + t + v3 END) AS e2,
           least(3 + v3, CASE WHEN ok AND f = 'u' THEN t + v2 END, CASE WHEN ok THEN 2 + t + v2 END) AS e3
    FROM cost JOIN (SELECT *, fault NOT IN (1, 2) AS ok, CASE WHEN fault = 3 THEN 1 ELSE 0 END AS t FROM rows) r ON r.c = cost.c AND r.i = cost.i - 1)),
togo AS (SELECT c, i, [v0, v1, v2, v3] AS v FROM cost),
walk(c, i, s, audit, said) AS (
  SELECT c, 1, 0, '', CAST([] AS VARCHAR[]) FROM (SELECT DISTINCT c FROM rows)
  UNION ALL
  SELECT c, i + (e <> 'I')::INT, CASE WHEN e = 'D' THEN s WHEN e = 'K' AND f = 's' THEN 1 WHEN s = 2 THEN 3 ELSE 2 END, audit || e,
         CASE WHEN e = 'D' THEN said WHEN e = 'K' THEN list_append(said, role || ':' || text)
              ELSE list_append(said, CASE WHEN s = 2 THEN 'assistant' ELSE 'user' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END) END
  FROM (SELECT w.*, r.f, r.role, r.text,
               CASE WHEN r.c IS NOT NULL AND 3 + after.v[w.s + 1] = now.v[w.s + 1] THEN 'D'
                    WHEN 2 + now.v[CASE WHEN w.s = 2 THEN 4 ELSE 3 END] = now.v[w.s + 1] THEN 'I'
                    WHEN r.c IS NULL THEN NULL
                    WHEN r.fault NOT IN (1, 2) AND ((r.f = 's' AND w.s = 0) OR (r.f = 'u' AND w.s <> 2) OR (r.f = 'a' AND w.s = 2))
                         AND CASE WHEN r.fault = 3 THEN 1 ELSE 0 END + after.v[CASE r.f WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END] = now.v[w.s + 1] THEN 'K'
                    ELSE 'R' END AS e
        FROM walk w JOIN togo now ON now.c = w.c AND now.i = w.i LEFT JOIN togo after ON after.c = w.c AND after.i = w.i + 1
        LEFT JOIN rows r ON r.c = w.c AND r.i = w.i) WHERE e IS NOT NULL),
ended AS (SELECT c, arg_max(audit, length(audit)) AS audit, arg_max(said, length(audit)) AS said FROM walk GROUP BY c),
counts AS (SELECT c, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
                  count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (wrong) AS illegal FROM rows GROUP BY c)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(togo.v[1], 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(said, chr(10)), '')) AS repaired_sha256
FROM ids LEFT JOIN counts USING (c) LEFT JOIN ended USING (c) LEFT JOIN togo ON togo.c = ids.c AND togo.i = 1
""",
}
