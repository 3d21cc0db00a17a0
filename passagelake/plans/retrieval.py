"""Registered retrieval queries and their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..conf import SETTINGS
from ..functions import text as tx
from ..functions import vectors as vec
from ..operators import postings
from ..operators import retrieval as r
from ..operators import vector_index as index
from ..sources.shared import shared_path
from . import tables as t

ONE_EACH = replace(SETTINGS, per_document=1)


def _both(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return t.questions(spark, d), t.chunks(spark, d)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(r.vector_topk(*_both(spark, d)), "similarity")


def vector_topk_index(spark: SparkSession, d: str) -> DataFrame:
    """Dense search by an index that is built first; half the lists of these small tables are probed."""
    q, c = _both(spark, d)
    path = shared_path(spark, "index")
    index.build_index(c, path)
    return _rounded(index.vector_topk_index(q, path, probes=8), "similarity")


def lexical_topk(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(r.lexical_topk(*_both(spark, d)), "score")


def lexical_topk_index(spark: SparkSession, d: str) -> DataFrame:
    """Lexical search by an index: built while the texts of half the sources are still their titles, updated by those documents, and searched."""
    q, c = t.questions(spark, d), t.texts(spark, d)
    path, late = shared_path(spark, "postings"), F.pmod(F.xxhash64("document_id"), F.lit(2)) == 0
    postings.build_postings(c.withColumn("text", F.when(late, F.col("title")).otherwise(F.col("text"))), path)
    changed = c.where(late)
    postings.update_documents(changed, changed, path)
    return _rounded(postings.lexical_topk_index(q, path), "score")


def _fused(spark: SparkSession, d: str) -> DataFrame:
    q, c = _both(spark, d)
    return r.rrf_fusion(r.vector_topk(q, c), r.lexical_topk(q, c))


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_fused(spark, d), "fused_score")


def hydrate_chunks(spark: SparkSession, d: str) -> DataFrame:
    q, c = _both(spark, d)
    found = r.hydrate(_fused(spark, d).where(F.col("position") <= SETTINGS.shortlist), q, c)
    return found.select("question_id", "position", "chunk_id", "owner_id", "document_id", "chunk_index", "title", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def hydrate_order(spark: SparkSession, d: str) -> DataFrame:
    """The order of the fused list holds over what was found."""
    q, c = _both(spark, d)
    found = r.hydrate(_fused(spark, d).where(F.col("position") <= SETTINGS.shortlist), q, c.where(F.col("chunk_index") % 3 != 0))
    ordered = F.array_sort(F.collect_list(F.struct("position", "chunk_id")))
    return found.groupBy("question_id").agg(F.array_join(F.transform(ordered, lambda x: x["chunk_id"]), ",").alias("chunk_ids"))


def rerank_order(spark: SparkSession, d: str) -> DataFrame:
    q, c = _both(spark, d)
    found = r.rerank(r.hydrate(_fused(spark, d).where(F.col("position") <= SETTINGS.shortlist), q, c), q)
    return _rounded(found.select("question_id", "chunk_id", "rerank_score", "rerank_position"), "rerank_score")


def _final(df: DataFrame) -> DataFrame:
    return df.select("question_id", "chunk_id", "document_id", F.round("fused_score", 6).alias("fused_score"), "vector_rank", "lexical_rank", "final_rank")


def retrieve_hybrid(spark: SparkSession, d: str) -> DataFrame:
    return _final(r.retrieve(*_both(spark, d), ONE_EACH))


def diversity_cap(spark: SparkSession, d: str) -> DataFrame:
    """Two documents and a cap of 2, so that displaced rows fill the list."""
    q, c = _both(spark, d)
    halves = c.withColumn("document_id", (F.col("chunk_index") % 2).cast("string"))
    found = r.hydrate(_fused(spark, d).where(F.col("position") <= SETTINGS.shortlist), q, halves)
    return _final(r.diversity_cap(found, SETTINGS.top_k, 2))


def _ablation(ranked: DataFrame, rank: str) -> DataFrame:
    return ranked.where(F.col(rank) <= SETTINGS.top_k).select("question_id", "chunk_id", F.col(rank).alias("rank"))


def ablation_vector(spark: SparkSession, d: str) -> DataFrame:
    return _ablation(r.vector_topk(*_both(spark, d)), "rank")


def ablation_lexical(spark: SparkSession, d: str) -> DataFrame:
    return _ablation(r.lexical_topk(*_both(spark, d)), "rank")


def ablation_rrf(spark: SparkSession, d: str) -> DataFrame:
    return _ablation(_fused(spark, d), "position")


def ablation_rrf_rerank(spark: SparkSession, d: str) -> DataFrame:
    q, c = _both(spark, d)
    found = r.rerank(r.hydrate(_fused(spark, d).where(F.col("position") <= SETTINGS.shortlist), q, c), q)
    return _ablation(found, "rerank_position")


def embed_dim_guard(spark: SparkSession, d: str) -> DataFrame:
    """Vectors by whether they have the right size; a writer refuses the others."""
    e = t.table(spark, d, "embeddings")
    return e.groupBy((F.size("embedding") == 64).alias("fits")).agg(F.count(F.lit(1)).alias("n"))


def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    e = t.table(spark, d, "embeddings").withColumn("v", F.transform("embedding", lambda x: x.cast("double") * 3))
    unit = vec.l2_normalised(F.col("v"))
    return e.select("vec_id", F.round(F.element_at(unit, 1), 6).alias("first"), F.round(F.element_at(unit, -1), 6).alias("last"), F.round(vec.norm(unit), 6).alias("length"))


def tokenize_terms(spark: SparkSession, d: str) -> DataFrame:
    docs = t.table(spark, d, "documents").select("doc_id", tx.terms(F.col("text")).alias("w"))
    return docs.select("doc_id", F.size("w").cast("long").alias("n"), F.md5(F.array_join("w", " ").cast("binary")).alias("terms_md5"))


def query_expression(spark: SparkSession, d: str) -> DataFrame:
    return t.table(spark, d, "benchmark").select("item_id", tx.query_expression(F.col("text")).alias("expression"))


QUERIES = {f.__name__: f for f in (vector_topk, vector_topk_index, lexical_topk, lexical_topk_index, rrf_fusion, hydrate_chunks, hydrate_order, rerank_order, retrieve_hybrid, diversity_cap, ablation_vector, ablation_lexical, ablation_rrf, ablation_rrf_rerank, embed_dim_guard, l2_normalize, tokenize_terms, query_expression)}

_DOT = "list_dot_product({0}::DOUBLE[], {1}::DOUBLE[])"
_TERMS = "regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+')"
_BASE = f"""
chunks AS (SELECT CAST(doc_id AS VARCHAR) AS chunk_id, lang AS owner_id, source AS document_id, doc_id AS chunk_index, source AS title, text, embedding
  FROM documents LEFT JOIN embeddings ON vec_id = doc_id),
questions AS (SELECT item_id AS question_id, text, ['en','de','fr','es'][CAST(item_id % 4 + 1 AS INT)] AS owner_id, embedding
  FROM benchmark LEFT JOIN embeddings ON vec_id = item_id),
vscored AS (SELECT question_id, chunk_id, {_DOT.format('c.embedding', 'q.embedding')} / (sqrt({_DOT.format('c.embedding', 'c.embedding')}) * sqrt({_DOT.format('q.embedding', 'q.embedding')})) AS similarity
  FROM chunks c JOIN questions q USING (owner_id) WHERE c.embedding IS NOT NULL AND q.embedding IS NOT NULL),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY similarity DESC, chunk_id) AS rank FROM vscored) WHERE rank <= 40),
qall AS (SELECT question_id, owner_id, list_filter({_TERMS.format('text')}, lambda x: x NOT IN ('or', 'and', 'not')) AS l FROM questions),
qterms AS (SELECT question_id, owner_id, unnest(list_filter(l, lambda x, i: list_position(l, x) = i)[1:40]) AS term FROM qall),
cwords AS (SELECT chunk_id, owner_id, {_TERMS.format('text')} AS words FROM chunks),
placed AS (SELECT chunk_id, owner_id, len(words) AS n, unnest(words) AS term FROM cwords),
matched AS (SELECT question_id, chunk_id, n, count(*) AS m FROM placed JOIN qterms USING (owner_id, term) GROUP BY ALL),
lexical AS (SELECT * FROM (SELECT question_id, chunk_id, 0.1 * m / ln(1.0 + n) AS score, row_number() OVER (PARTITION BY question_id ORDER BY 0.1::DOUBLE * m / ln(1.0 + n) DESC, chunk_id) AS rank FROM matched) WHERE rank <= 40),
summed AS (SELECT question_id, chunk_id, d.rank AS vector_rank, x.rank AS lexical_rank,
  coalesce(1.0::DOUBLE / (60 + d.rank), 0) + coalesce(0.8::DOUBLE / (60 + x.rank), 0) AS fused_score
  FROM dense d FULL OUTER JOIN lexical x USING (question_id, chunk_id)),
fused AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY fused_score DESC, chunk_id) AS position FROM summed),
hydrated AS (SELECT f.*, q.owner_id, c.document_id, c.chunk_index, c.title, c.text, q.text AS question FROM fused f JOIN questions q USING (question_id) JOIN chunks c ON c.chunk_id = f.chunk_id AND c.owner_id = q.owner_id WHERE position <= 40),
asked AS (SELECT *, list_filter({_TERMS.format('question')}, lambda x: x NOT IN ('or', 'and', 'not')) AS l FROM hydrated),
listed AS (SELECT *, list_filter(l, lambda x, i: list_position(l, x) = i)[1:40] AS terms FROM asked),
reranked AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rerank_score DESC, fused_score DESC, position) AS rerank_position
  FROM (SELECT *, coalesce(len(list_intersect(terms, {_TERMS.format('text')})) / nullif(len(terms), 0)::DOUBLE, 0) AS rerank_score FROM listed))
"""


def _diverse(documents: str, cap: int) -> str:
    return f"""WITH {_BASE},
marked AS (SELECT *, {documents} AS doc, row_number() OVER (PARTITION BY question_id, {documents} ORDER BY position) > {cap} AS displaced FROM hydrated),
chosen AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY displaced, position) AS c FROM marked)
SELECT question_id, chunk_id, doc AS document_id, round(fused_score, 6) AS fused_score, vector_rank, lexical_rank, row_number() OVER (PARTITION BY question_id ORDER BY position) AS final_rank
FROM chosen WHERE c <= 6"""


ORACLES = {
    "vector_topk": f"WITH {_BASE} SELECT question_id, chunk_id, round(similarity, 6) AS similarity, rank FROM dense",
    "lexical_topk": f"WITH {_BASE} SELECT question_id, chunk_id, round(score, 6) AS score, rank FROM lexical",
    "lexical_topk_index": f"WITH {_BASE} SELECT question_id, chunk_id, round(score, 6) AS score, rank FROM lexical",
    "rrf_fusion": f"WITH {_BASE} SELECT question_id, chunk_id, vector_rank, lexical_rank, round(fused_score, 6) AS fused_score, position FROM fused",
    "hydrate_chunks": f"WITH {_BASE} SELECT question_id, position, chunk_id, owner_id, document_id, chunk_index, title, md5(text) AS text_md5 FROM hydrated",
    "hydrate_order": f"WITH {_BASE} SELECT question_id, string_agg(chunk_id, ',' ORDER BY position) AS chunk_ids FROM hydrated WHERE chunk_index % 3 <> 0 GROUP BY 1",
    "rerank_order": f"WITH {_BASE} SELECT question_id, chunk_id, round(rerank_score, 6) AS rerank_score, rerank_position FROM reranked",
    "retrieve_hybrid": _diverse("document_id", 1),
    "diversity_cap": _diverse("CAST(chunk_index % 2 AS VARCHAR)", 2),
    "ablation_vector": f"WITH {_BASE} SELECT question_id, chunk_id, rank FROM dense WHERE rank <= 6",
    "ablation_lexical": f"WITH {_BASE} SELECT question_id, chunk_id, rank FROM lexical WHERE rank <= 6",
    "ablation_rrf": f"WITH {_BASE} SELECT question_id, chunk_id, position AS rank FROM fused WHERE position <= 6",
    "ablation_rrf_rerank": f"WITH {_BASE} SELECT question_id, chunk_id, rerank_position AS rank FROM reranked WHERE rerank_position <= 6",
    "embed_dim_guard": "SELECT len(embedding) = 64 AS fits, count(*) AS n FROM embeddings GROUP BY 1",
    "l2_normalize": f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 3) AS v FROM embeddings),
u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt({_DOT.format('v', 'v')})) AS u FROM v)
SELECT vec_id, round(u[1], 6) AS first, round(u[-1], 6) AS last, round(sqrt({_DOT.format('u', 'u')}), 6) AS length FROM u""",
    "tokenize_terms": f"SELECT doc_id, len(w) AS n, md5(array_to_string(w, ' ')) AS terms_md5 FROM (SELECT doc_id, {_TERMS.format('text')} AS w FROM documents)",
    "query_expression": f"""WITH a AS (SELECT item_id, list_filter({_TERMS.format('text')}, lambda x: x NOT IN ('or', 'and', 'not')) AS l FROM benchmark)
SELECT item_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:40], ' or ') AS expression FROM a""",
}
