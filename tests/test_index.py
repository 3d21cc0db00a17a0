"""Approximate dense search, exact percentiles, sections of long files, and odd bytes and blanks."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from passagelake.functions import text as tx
from passagelake.operators import evaluation, retrieval, vector_index
from passagelake.plans import tables
from passagelake.sources import markdown


@pytest.fixture(scope="module")
def clustered(spark):
    rng = random.Random(4)
    middles = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(20)]
    near = lambda: [x + rng.gauss(0, 0.5) for x in rng.choice(middles)]
    chunks = [(f"c{i:05d}", "ab"[i % 3 == 0], near() if i % 50 else None) for i in range(6000)]
    questions = [(i, "abc"[i % 3 if i < 57 else 0], near()) for i in range(60)]
    return spark.createDataFrame(questions, "question_id long, owner_id string, embedding array<double>"), spark.createDataFrame(chunks, "chunk_id string, owner_id string, embedding array<double>")


def test_index_recall_and_pruning(spark, clustered, tmp_path):
    questions, chunks = clustered
    path = str(tmp_path / "index")
    vector_index.build_index(chunks, path)
    lists = spark.read.parquet(f"{path}/lists")
    assert lists.count() == chunks.where("embedding is not null").count()
    exact = {(r["question_id"], r["chunk_id"]): r["similarity"] for r in retrieval.vector_topk(questions, chunks, 40).collect()}
    recalls = []
    for probes in (1, 4, 16, 1000):
        got = vector_index.vector_topk_index(questions, path, 40, probes).collect()
        held = {(r["question_id"], r["chunk_id"]) for r in got}
        assert all(r["similarity"] == pytest.approx(exact[r["question_id"], r["chunk_id"]]) for r in got if (r["question_id"], r["chunk_id"]) in exact)
        recalls.append(len(held & set(exact)) / len(exact))
    assert recalls == sorted(recalls) and recalls[-1] == 1 and recalls[2] >= 0.95
    one = questions.limit(1)
    assert vector_index.probed_lists(one, spark, path, 4).count() == 4
    plan = vector_index.vector_topk_index(one, path, 40, 4)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
    files = lists.select("owner_id", "list").distinct().count()
    read = vector_index.probed_lists(questions, spark, path, 4).select("owner_id", "list").distinct().count()
    assert read < files / 2 or len({r["question_id"] for r in questions.collect()}) * 4 >= files


def test_index_of_odd_tables(spark, tmp_path):
    schema = "chunk_id string, owner_id string, embedding array<float>"
    questions = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "z", [1.0, 0.0]), (3, "a", None)], "question_id long, owner_id string, embedding array<float>")
    vector_index.build_index(spark.createDataFrame([], schema), str(tmp_path / "none"))
    vector_index.build_index(spark.createDataFrame([("c", "a", [0.0, 0.0]), ("d", "a", [2.0, 0.0]), ("d2", "a", [2.0, 0.0]), ("e", "b", None)], schema), str(tmp_path / "few"))
    found = vector_index.vector_topk_index(questions, str(tmp_path / "few"), 40, 10).collect()
    assert [(r["question_id"], r["chunk_id"]) for r in sorted(found, key=lambda r: r["rank"])] == [(1, "d"), (1, "d2"), (1, "c")]
    with pytest.raises(Exception, match="another size"):
        vector_index.build_index(spark.createDataFrame([("c", "a", [1.0]), ("d", "a", [2.0, 0.0])], schema), str(tmp_path / "bad"))


def test_table_recall(spark, sf, tmp_path):
    questions, chunks = tables.questions(spark, sf), tables.chunks(spark, sf)
    vector_index.build_index(chunks, str(tmp_path / "index"))
    pairs = lambda df: {(r["question_id"], r["chunk_id"]) for r in df.collect()}
    exact = pairs(retrieval.vector_topk(questions, chunks, 40))
    assert len(pairs(vector_index.vector_topk_index(questions, str(tmp_path / "index"), 40, 1000)) & exact) == len(exact)


@pytest.mark.parametrize("sorted_rows", [5, 20_000])
def test_percentiles_by_brute_force(spark, monkeypatch, sorted_rows):
    monkeypatch.setattr(evaluation, "BUCKETS", 128)
    monkeypatch.setattr(evaluation, "SORTED_ROWS", sorted_rows)
    rng = random.Random(2)
    groups = {
        "even": [float(i) for i in range(300)], "same": [7.5] * 200, "wide": [10.0 ** rng.uniform(-9, 9) * rng.choice((1, -1)) for _ in range(150)], "one": [3.0], "none": [None, None],
        None: [rng.gauss(0, 1) for _ in range(120)], "odd": [-math.inf] * 40 + [1.0] * 5 + [math.inf] * 60 + [2.0, 1.7e308, -1.7e308],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    got = {r["g"]: tuple(r)[1:] for r in evaluation.percentiles(spark.createDataFrame(rows, "g string, v double").repartition(4), "g", "v", 0.5, 0.95, 0.01).collect()}
    for g, vs in groups.items():
        vs = sorted(v for v in vs if v is not None)
        assert got[g] == tuple(vs[max(1, math.ceil(p * len(vs))) - 1] if vs else 0.0 for p in (0.5, 0.95, 0.01))
    assert evaluation.percentiles(spark.createDataFrame([], "g string, v double"), "g", "v", 0.5).count() == 0


def by_loop(body):
    """Sections as a plain loop finds them."""
    out, path, lines, fenced = [], [], [], False
    for line in body.split("\n"):
        plain = line.lstrip()
        mark = len(line) - len(line.lstrip("#"))
        if plain.startswith(("```", "~~~")):
            fenced = not fenced
        elif not fenced and 1 <= mark <= 6 and line[mark : mark + 1].isspace() and line[mark:].strip():
            out.append(([t for _, t in path], lines))
            title = line[mark:].strip().rstrip("#").rstrip()
            path, lines = [(n, t) for n, t in path if n < mark] + [(mark, title)], []
            continue
        lines.append(line)
    out.append(([t for _, t in path], lines))
    return [(p[:4], "\n".join(x).strip()) for p, x in out if "\n".join(x).strip()]


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_sections_in_blocks_are_those_of_a_loop(spark, block):
    rng = random.Random(8)
    line = lambda: rng.choice(["text", "", "  more", "```", "~~~ py", "# One", "## Two ##", "### Wide", "#### Four", "###### Six", "#none", "####### seven"]) + rng.choice(["", "", str(rng.randrange(9))])
    bodies = [(f"f{i}", "\n".join(line() for _ in range(rng.randrange(60)))) for i in range(60)] + [("empty", ""), ("null", None)]
    rows = markdown.sections(spark.createDataFrame(bodies, "path string, body string"), block=block).orderBy("path", "section_order").collect()
    for path, body in bodies:
        assert [(r["heading_path"], r["text"]) for r in rows if r["path"] == path] == (by_loop(body) if body else [])


def test_long_file_takes_many_tasks(spark):
    body = "\n".join(f"# Part {i}" if i % 1000 == 0 else f"line {i}" for i in range(60_000))
    rows = markdown.scanned(spark.createDataFrame([("long", body)], "path string, body string"), "path", "body")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    assert rows.agg(F.max("section")).first()[0] == 60 and rows.select(F.spark_partition_id()).distinct().count() > 1
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_bad_bytes_and_upper_case_suffixes(spark, tmp_path):
    for name, data in (("a.md", b"# T\nfine"), ("B.MD", b"# U\nbad \xff\xfe byte"), ("c.MarkDown", "# Wide \nx".encode()), ("d.txt", b"no")):
        (tmp_path / name).write_bytes(data)
    got = {os.path.basename(r["path"]): r["body"] for r in markdown.read_markdown(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.md", "B.MD", "c.MarkDown"} and got["B.MD"] == b"# U\nbad \xff\xfe byte".decode(errors="replace")


def test_questions_ids_and_addresses_with_odd_blanks(spark):
    one = lambda column, *values: [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").orderBy("i").select(column).collect()]
    drafts = ('["One?", " Two? ", ""]', '\n["A?",\n"B?"]', "1. First?\t\n- Second?\nnot one\n* \"Third?\",", "\t2. Tab? \r\n 3. Line?", "nothing", "[broken\n2. Is it?", None)
    assert one(tx.parse_questions(F.col("x")), *drafts) == [["One?", "Two?"], ["A?", "B?"], ["First?", "Second?", "Third?"], ["Tab?", "Line?"], [], ["Is it?"], []]
    headers = ("1.1.1.1, 2.2.2.2 ,3.3.3.3", "1.1.1.1,\t2.2.2.2\t, 3.3.3.3", "", " , ", "4.4.4.4", "5.5.5.5,,6.6.6.6")
    assert one(tx.client_address(F.col("x"), F.lit("peer"), 2), *headers) == ["2.2.2.2", "2.2.2.2", "peer", "peer", "peer", "5.5.5.5"]
    ids = ("edge-7f3a91", "two\nlines", "a" * 65, "a" * 64, "  ", " ok.1:2_3 ", "semi;colon", "abc\n", "abc\r\n", "\tid\n\n", "a\n;")
    assert one(tx.valid_request_id(F.col("x")), *ids) == [True, False, False, True, False, True, False, True, True, True, False]


def test_rounds_read_a_kept_sample(spark, tmp_path, monkeypatch):
    plans, real = [], vector_index._round
    monkeypatch.setattr(vector_index, "_round", lambda rows, *rest: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or real(rows, *rest))
    chunks = spark.createDataFrame([(f"c{i}", "a", [float(i % 7 + 1), float(i % 5)]) for i in range(200)], "chunk_id string, owner_id string, embedding array<float>")
    vector_index.build_index(chunks, str(tmp_path / "kept"))
    assert len(plans) == vector_index.ROUNDS and all("Join" not in p and "transform" not in p and "sample-" in p for p in plans)
