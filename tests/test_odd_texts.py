"""Queries over the small tables with odd documents beside the usual ones."""

import math
import os
import shutil

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from passagelake.operators import assistant, models
from passagelake.operators import chunking as ch
from passagelake.operators import retrieval as r
from passagelake.plans import registry


def tables_with(sf, at, texts):
    """A copy of the tables whose documents have these texts too, ids from 1000 on."""
    os.mkdir(at)
    for name in ("benchmark", "conversations", "embeddings"):
        shutil.copyfile(f"{sf}/{name}.parquet", f"{at}/{name}.parquet")
    docs = pq.read_table(f"{sf}/documents.parquet")
    rows = [{"doc_id": 1000 + i, "text": x, "lang": ("en", "de", "fr", "es")[i % 4], "source": "src1", "n_chars": len(x or "")} for i, x in enumerate(texts)]
    pq.write_table(pa.concat_tables([docs, pa.Table.from_pylist(rows, docs.schema)]), f"{at}/documents.parquet")
    return str(at)


def test_answers_beside_texts_without_words(spark, sf, tmp_path):
    odd = registry.QUERIES["answer_records"](spark, tables_with(sf, tmp_path / "odd", ["È.", "é è", "!!! ???", "日本語", "", None] * 4)).collect()
    assert sorted(odd) == sorted(registry.QUERIES["answer_records"](spark, sf).collect()) and len(odd) == 40


def test_vectors_of_length_zero(spark, sf, tmp_path):
    rows = [("a", "x", [1.0, 0.0]), ("b", "x", [0.0, 0.0]), ("c", "x", [0.5, 0.5]), ("d", "x", None)]
    chunks = spark.createDataFrame(rows, "chunk_id string, owner_id string, embedding array<float>")
    asked = spark.createDataFrame([(1, "x", [2.0, 0.0]), (2, "x", [0.0, 0.0])], "question_id int, owner_id string, embedding array<float>")
    found = {(x["question_id"], x["rank"]): (x["chunk_id"], x["similarity"]) for x in r.vector_topk(asked, chunks).collect()}
    assert [found[1, k][0] for k in (1, 2, 3)] == ["b", "a", "c"] and math.isnan(found[1, 1][1]) and found[1, 2][1] == 1
    assert [found[2, k][0] for k in (1, 2, 3)] == ["a", "b", "c"] and all(math.isnan(found[2, k][1]) for k in (1, 2, 3)) and len(found) == 6
    assert [x["chunk_id"] for x in r.vector_topk(r.directed(asked), r.directed(chunks)).orderBy("rank").collect()] == ["a", "c"]


def test_dense_search_with_vectors_of_length_zero_as_in_sql(spark, sf, tmp_path):
    at = tables_with(sf, tmp_path / "odd", [])
    e = pq.read_table(f"{sf}/embeddings.parquet")
    vectors = [[0.0] * 64 if i % 9 == 5 else v for i, v in zip(e["vec_id"].to_pylist(), e["embedding"].to_pylist())]
    pq.write_table(e.set_column(e.schema.get_field_index("embedding"), e.schema.field("embedding"), pa.array(vectors, e.schema.field("embedding").type)), f"{at}/embeddings.parquet")
    con = duckdb.connect()
    for t in ("benchmark", "documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{at}/{t}.parquet'")
    for name in ("vector_topk", "rrf_fusion"):
        got = registry.QUERIES[name](spark, at)
        want = con.sql(f"select {', '.join(got.columns)} from ({registry.ORACLES[name]})").fetchall()
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_texts_without_vectors_are_found_by_their_terms(spark):
    class Few(models.HashingEmbedder):
        def encode(self, texts):
            return super().encode(texts) * [[0.0 if "nothing" in t else 1.0] for t in texts]

    rows = [(f"{i}", "x", "d", i, "t", "", text) for i, text in enumerate(["red apples", "nothing but pears", "green plums"])]
    chunks = spark.createDataFrame(rows, "chunk_id string, owner_id string, document_id string, chunk_index int, title string, heading_path string, text string").withColumn("embedding", models.embed(F.col("text"), Few))
    questions = spark.createDataFrame([(1, 1, "x", "pears?"), (2, 2, "x", "nothing at all")], "question_id int, session_id int, owner_id string, text string")
    found = {(x["question_id"], x["chunk_id"]): x["vector_rank"] for x in assistant.context_of(questions, chunks, assistant.Models(embedder=Few)).collect()}
    assert found[1, "1"] is None and {k for k in found if k[0] == 1} == {(1, "0"), (1, "1"), (1, "2")} and set(found) - {(1, "0"), (1, "1"), (1, "2")} == {(2, "1")}


def test_blank_units_make_no_window():
    assert ch.pack(["", None, " \n", "\u00a0"], 10, 3, 2) == []
    assert ch.pack(["", "a b", None, "c", "  "], 10, 3, 0) == ["a b c"]


def test_hard_split_of_odd_texts_as_in_sql(spark, sf, tmp_path):
    blanks = [f"a{chr(c)}b {chr(c)} c" for c in (*range(14), *range(28, 33), 133, 160, 5760, *range(8192, 8204), 8232, 8233, 8239, 8287, 12288)]
    at = tables_with(sf, tmp_path / "odd", [None, "", " ", "\n\n", "\u00a0", "\x0b", "w " * 64, "w " * 65, " " + "w\n" * 128, "w" * 5000, *blanks])
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{at}/documents.parquet'")
    got = registry.QUERIES["hard_split"](spark, at)
    want = con.sql(f"select {', '.join(got.columns)} from ({registry.ORACLES['hard_split']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
