"""The queries of this subpackage, with production parameters over whole tables, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import embedding_dup, exact_dedup, language_id, line_dedup, lm_score, mixing, near_dup, packing, phrases, quality, substring_dup, token_counts, whitening


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op4_pack(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op5_mix_sources(spark, sf_dir):
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op7_jaccard_join(spark, sf_dir):
    return near_dup.jaccard_join(table(spark, sf_dir, "documents")).drop("text_hash")


def op3_embedding_dedup(spark, sf_dir):
    return embedding_dup.embedding_dedup(table(spark, sf_dir, "embeddings"))


def op2_lm_score(spark, sf_dir):
    return lm_score.lm_scores(table(spark, sf_dir, "documents"))


def op8_language_id(spark, sf_dir):
    """A row for each page (page_id), with all kinds of evidence, and for each document (doc_id), whose column lang is its declaration and source its host."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs, F.col("lang"), F.col("text"), key=F.col("doc_id"))
    pages = language_id.identify_pages(table(spark, sf_dir, "pages"), model).withColumn("doc_id", F.lit(None).cast("long"))
    documents = language_id.identify_documents(docs, model).drop("key").withColumns({"page_id": F.lit(None).cast("long"), "host": F.lit(None).cast("string")})
    return documents.unionByName(pages)


def op10_quality(spark, sf_dir):
    return quality.quality_scores(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark, sf_dir):
    return substring_dup.substring_dedup(table(spark, sf_dir, "documents")).drop("removed")


def op11_whiten(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_line_dedup(spark, sf_dir):
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"))


def op13_collocations(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents"))


OP3_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
r(n, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.n),
k AS (SELECT n, min(c) AS c FROM r GROUP BY n),
m AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n_links, 0) AS n_links, coalesce(k.c, e.vec_id) AS component_id, coalesce(e.vec_id = coalesce(k.c, e.vec_id), false) AS kept
FROM embeddings e LEFT JOIN k ON k.n = e.vec_id LEFT JOIN m ON m.a = e.vec_id
"""

OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS d, b.doc_id AS e, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT d, e FROM p JOIN n x ON x.doc_id = d JOIN n y ON y.doc_id = e WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
r(d, c) AS (SELECT doc_id, doc_id FROM w UNION SELECT l.e, r.c FROM r JOIN l ON l.d = r.d),
k AS (SELECT d, min(c) AS class_id FROM r GROUP BY d),
m AS (SELECT d, count(*) AS n_links FROM l GROUP BY d),
q AS (SELECT ws, count(*) AS n_copies FROM w GROUP BY ws)
SELECT w.doc_id, class_id, coalesce(n_links, 0) AS n_links, CASE WHEN len(w.ws) = 0 THEN 1 ELSE n_copies END AS n_copies, class_id = w.doc_id AS kept
FROM w JOIN k ON k.d = w.doc_id LEFT JOIN m ON m.d = w.doc_id JOIN q ON q.ws = w.ws
"""

OP1_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)
"""


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS s FROM d),
k AS (SELECT *, translate(regexp_replace(s, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT r) >= 3),
m AS (SELECT k.*, f.key IS NOT NULL AND k.doc_id IS DISTINCT FROM f.top AS gone FROM k LEFT JOIN f ON f.key = k.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(s, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY r
"""

OP13_SQL = r"""
WITH p AS (
  SELECT row_number() OVER () AS r, lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
t AS (SELECT lang, sum(len(ws))::HUGEINT AS n FROM p GROUP BY lang),
o AS (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM p, (VALUES (1), (2), (3), (4), (5)) v(m) WHERE len(ws) >= m),
f AS (SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase, count(*) AS c FROM o GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, m, phrase, c AS a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1),
s AS (SELECT c.lang, c.phrase, c.m, c.a, t.n, x.c AS l, y.c AS r, k, (1000 * c.a::HUGEINT * t.n) // (x.c::HUGEINT * y.c) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM c) c JOIN t USING (lang)
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[k + 1:c.m], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
h AS (SELECT DISTINCT b.lang, b.phrase FROM b JOIN c ON c.lang = b.lang AND c.m > b.m AND c.a >= b.a AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' '))
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b ANTI JOIN h USING (lang, phrase)) WHERE rank <= 2000
"""


def queries():
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_lm_score": op2_lm_score,
        "op3_embedding_dedup": op3_embedding_dedup,
        "op4_pack": op4_pack,
        "op5_mix_sources": op5_mix_sources,
        "op6_token_counts": op6_token_counts,
        "op7_jaccard_join": op7_jaccard_join,
        "op8_language_id": op8_language_id,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_quality": op10_quality,
        "op11_whiten": op11_whiten,
        "op12_line_dedup": op12_line_dedup,
        "op13_collocations": op13_collocations,
    }


def oracle_sql():
    return {"op1_exact_dedup": OP1_SQL, "op3_embedding_dedup": OP3_SQL, "op7_jaccard_join": OP7_SQL, "op12_line_dedup": OP12_SQL, "op13_collocations": OP13_SQL}
