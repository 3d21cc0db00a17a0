"""Behaviour on small literal inputs."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from passagelake.conf import SETTINGS
from passagelake.functions import text as tx
from passagelake.functions import vectors as vec
from passagelake.operators import answers as a
from passagelake.operators import chunking as ch
from passagelake.operators import evaluation as ev
from passagelake.operators import jobs as jb
from passagelake.operators import observe as ob
from passagelake.operators import retrieval as r
from passagelake.sources import files, markdown, pdf_lines
from passagelake.streaming import sse


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


def pack(units, target=10, overlap=3, least=2):
    return ch.pack(units, target, overlap, least)


def test_windows_overlap_and_stay_bounded():
    out = pack([f"word{i} filler filler." for i in range(6)])
    assert len(out) > 1 and all(ch.words(w) <= 13 for w in out) and out[1].startswith("word2")


def test_long_units_are_cut():
    out = pack([" ".join(["w"] * 35)])
    assert len(out) > 1 and all(ch.words(w) <= 13 for w in out)
    assert pack(["x" * 50]) == ["x" * 50]


def test_short_tail_joins():
    out = pack([" ".join(f"{s}{i}" for i in range(10)) for s in "abc"] + ["tiny."], overlap=0)
    assert ch.words(out[-1]) >= 2 and "tiny." in out[-1]


def test_every_unit_is_kept_in_order():
    units = [f"u{i}" for i in range(57)]
    seen = [w for window in pack(units, 5, 0, 0) for w in window.split()]
    assert seen == units and pack([]) == []


def test_chunks_keep_to_sections(spark):
    s = spark.createDataFrame([("d", i, [h], "one two three", None, None) for i, h in enumerate("ABC")], "document_id string, section_order int, heading_path array<string>, text string, page_start int, page_end int")
    rows = sorted(ch.chunk_sections(s).collect(), key=lambda x: x["chunk_index"])
    assert [(x["chunk_id"], x["heading_path"]) for x in rows] == [("d:0", "A"), ("d:1", "B"), ("d:2", "C")]


def test_query_expression(spark):
    cases = {"What is ERROR, error?": "what or is or error", "a or b AND not c": "a or b or c", "!!! ???": "", "   ": "", "error E-4471": "error or e or 4471"}
    for raw, want in cases.items():
        assert one(spark, tx.query_expression(F.col("q")), q=raw) == want
    assert one(spark, F.size(tx.query_terms(F.col("q"))), q=" ".join(f"t{i}" for i in range(65))) == 40


def test_unicode_blanks(spark):
    assert one(spark, tx.strip(F.col("q")), q="  a\x1f ") == "a"
    assert one(spark, tx.word_count(F.col("q")), q="   ") == 0


def test_markers(spark):
    for answer, want in {"[2] [1] [2]": [2, 1], "none": [], "[123] [7]": [7]}.items():
        assert one(spark, tx.citation_markers(F.col("q")), q=answer) == want


def ranked(spark, rows):
    return spark.createDataFrame(rows, "question_id int, chunk_id string, rank int")


def test_fusion(spark):
    dense = ranked(spark, [(1, "solo", 1), (1, "agreed", 2), (2, "a", 1), (3, "d", 1)])
    lexical = ranked(spark, [(1, "other", 1), (1, "agreed", 2), (2, "a", 1), (3, "x", 1)])
    out = {(x["question_id"], x["chunk_id"]): x for x in r.rrf_fusion(dense, lexical).collect()}
    first = out[1, "agreed"]
    assert (first["position"], first["vector_rank"], first["lexical_rank"]) == (1, 2, 2)
    assert out[2, "a"]["fused_score"] == pytest.approx(1 / 61 + 0.8 / 61)
    assert out[3, "d"]["position"] == 1 and out[3, "x"]["vector_rank"] is None
    assert r.rrf_fusion(dense.limit(0), lexical.limit(0)).count() == 0


def greedy(docs, top_k, cap):
    taken, left, seen = [], [], {}
    for i, d in enumerate(docs):
        if seen.get(d, 0) < cap:
            seen[d] = seen.get(d, 0) + 1
            taken.append(i)
        else:
            left.append(i)
    taken = taken[:top_k]
    return sorted(taken + left[: top_k - len(taken)])


@pytest.mark.parametrize("docs", ["JJJJJJJJRRRR", "JJJJJRRRRR", "RRRRRRRRRR", "JR", "", "ABCABCABC", "AABBBBBBA"])
def test_diversity_is_greedy(spark, docs):
    df = spark.createDataFrame([(1, i, d) for i, d in enumerate(docs)], "question_id int, position int, document_id string")
    got = [x["position"] for x in r.diversity_cap(df).orderBy("final_rank").collect()]
    assert got == greedy(docs, SETTINGS.top_k, SETTINGS.per_document)


def corpus(spark):
    rows = []
    for owner in ("alice", "bob"):
        for i, (head, text) in enumerate((("finance", "Quarterly revenue recognition policy"), ("operations", "Warehouse safety manual"))):
            rows.append((f"{owner}:{i}", owner, owner, i, "t", head, text, [1.0 if j == i else 0.0 for j in range(4)]))
    return spark.createDataFrame(rows, "chunk_id string, document_id string, owner_id string, chunk_index int, title string, heading_path string, text string, embedding array<float>")


def test_tenants_and_searches(spark):
    chunks = corpus(spark)
    unit = [1.0, 0.0, 0.0, 0.0]
    asked = [(1, "alice", "quarterly revenue recognition", unit), (2, "bob", "quarterly revenue recognition", None), (3, "alice", "warehouse safety", None), (4, "alice", "operations", None), (5, "nobody", "revenue", unit), (6, "alice", "???", None), (7, "alice", "what is the revenue policy for mars", None)]
    q = spark.createDataFrame(asked, "question_id int, owner_id string, text string, embedding array<float>")
    lex = {}
    for x in r.lexical_topk(q, chunks).orderBy("rank").collect():
        lex.setdefault(x["question_id"], []).append(x["chunk_id"])
    assert lex == {1: ["alice:0"], 2: ["bob:0"], 3: ["alice:1"], 4: ["alice:1"], 7: ["alice:0"]}
    dense = r.vector_topk(q, chunks).where("question_id = 1").orderBy("rank").collect()
    assert [x["chunk_id"] for x in dense] == ["alice:0", "alice:1"] and dense[0]["similarity"] == pytest.approx(1)
    assert r.retrieve(q, chunks, reranked=True).where("question_id = 5").count() == 0


def test_plans_cut_before_the_shuffle(spark):
    q = spark.createDataFrame([(1, "alice", "x", [1.0])], "question_id int, owner_id string, text string, embedding array<float>")
    plan = r.vector_topk(q, corpus(spark))._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "BroadcastHashJoin" in plan


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0])], "a array<float>, b array<float>")
    x = df.select(vec.cosine(F.col("a"), F.col("b")).alias("c"), vec.l2_normalised(F.col("a")).alias("u")).first()
    assert x["c"] == pytest.approx(24 / 25) and x["u"] == pytest.approx([0.6, 0.8])


def test_metrics(spark):
    rows = [("c", 1, i + 1, s, "Refunds") for i, s in enumerate(("Introduction", "Billing > Refunds", "Glossary"))] + [("c", 2, 1, "Introduction", "Shipping"), ("c", 3, 1, "x", "")]
    ranks = ev.first_relevant_rank(spark.createDataFrame(rows, "config string, question_id int, rank int, section string, expected string"))
    assert {x["question_id"]: x["rank"] for x in ranks.collect()} == {1: 2, 2: None, 3: 1}
    low, high = ev.wilson(F.lit(27), F.lit(30))
    x = spark.range(1).select(low.alias("a"), high.alias("b"), ev.ndcg(F.lit(1), 6).alias("n"), ev.ndcg(F.lit(7), 6).alias("z")).first()
    assert x["a"] < 0.9 < x["b"] and x["a"] == pytest.approx(0.744, abs=0.002) and (x["n"], x["z"]) == (1.0, 0.0)
    low, high = ev.wilson(F.lit(0), F.lit(0))
    assert tuple(spark.range(1).select(low, high).first()) == (0.0, 0.0)
    p = ev.percentiles(spark.createDataFrame([("g", float(v)) for v in (10, 20, 30, 40, 50)], "k string, v double"), "k", "v", 0.5, 0.95).first()
    assert (p["p50"], p["p95"]) == (30.0, 50.0)


def test_citation_metrics(spark):
    df = spark.createDataFrame([([1, 7], [1]), ([2], [2]), ([], [])], "emitted array<int>, valid array<int>")
    x = a.citation_metrics(df).first()
    assert x["hallucinated_marker_rate"] == pytest.approx(1 / 3) and x["answers_with_citations"] == pytest.approx(2 / 3) and x["hallucinated_marker_count"] == 1
    assert tuple(a.citation_metrics(df.limit(0)).first()) == (0.0, 0.0, 0.0, 0, 0)


def test_context_stops_at_the_first_overflow(spark):
    c = spark.createDataFrame([(1, i, "T", "", None, "x" * 5000) for i in range(1, 8)], "question_id int, marker int, title string, heading_path string, page_start int, text string")
    x = a.context_block(c).first()
    assert x["n_blocks"] == 5 and x["context"].startswith("[1] T\nxxx")


NOW = datetime(2024, 1, 1, 12)


def job(spark, *rows):
    return spark.createDataFrame(list(rows), "job_id long, document_id long, status string, attempts int, max_attempts int, last_error string, run_after timestamp, heartbeat_at timestamp, locked_by string, created_at timestamp, updated_at timestamp")


def test_queue(spark):
    early, late = datetime(2024, 1, 1), datetime(2024, 1, 2)
    jobs = job(spark, (1, 1, "queued", 0, 3, None, late, None, None, early, early), (2, 2, "queued", 0, 3, None, early, None, None, early, early), (3, 3, "running", 2, 3, None, early, datetime(2024, 1, 1, 11, 54), "w", early, early), (4, 4, "running", 3, 3, None, early, NOW, "w", early, early), (5, 5, "running", 3, 3, None, early, None, "w", early, early))
    now = F.lit(NOW)
    assert [(x["job_id"], x["attempts"], x["status"]) for x in jb.claim(jobs, now, 2).collect()] == [(2, 1, "running")]
    assert [(x["job_id"], x["status"], x["document_status"]) for x in jb.reap(jobs, now).collect()] == [(3, "queued", "pending")]
    done = {x["job_id"]: x for x in jb.finish(jobs, F.lit("failed"), F.lit(" bad "), now).collect()}
    assert done[3]["status"] == "queued" and done[3]["run_after"] > NOW and done[4]["status"] == "dead" and done[4]["last_error"] == "bad"
    assert {x["status"]: x["n"] for x in jb.depth(jobs).collect()} == {"queued": 2, "running": 3, "succeeded": 0, "dead": 0}
    requests = spark.createDataFrame([(1, 10), (9, 12), (9, 11)], "document_id long, job_id long")
    assert [tuple(x) for x in jb.enqueue(requests, jobs).collect()] == [(9, 11)]
    delays = spark.createDataFrame([(n,) for n in (0, 1, 2, 3, 50)], "n int").select(jb.backoff_seconds(F.col("n")).alias("d"))
    assert [x["d"] for x in delays.collect()] == [30, 30, 60, 120, 900]


def test_limiter(spark):
    rows = [("k", i, t, "check") for i, t in enumerate((0.0, 1.0, 2.0, 3.0, 60.0, 61.5))] + [("j", 0, 3.0, "check"), ("r", 0, 0.0, "check"), ("r", 1, 0.1, "check"), ("r", 2, 0.2, "check"), ("r", 3, 0.3, "reset"), ("r", 4, 0.4, "check")]
    out = {(x["key"], x["seq"]): x for x in ob.rate_limit(spark.createDataFrame(rows, "key string, seq int, t double, kind string"), 3, 60.0).collect()}
    assert [out["k", i]["allowed"] for i in range(6)] == [True, True, True, False, False, True]
    assert out["k", 3]["retry_after"] == 58 and out["k", 4]["retry_after"] == 1 and out["j", 0]["allowed"] and out["r", 4]["allowed"]


def test_markdown(spark):
    docs = spark.createDataFrame([("a", "# One ##\r\nx\r\n##### Deep\ny\n"), ("b", ""), ("c", "# only a heading\n")], "path string, body string")
    got = [(x["path"], x["section_order"], x["heading_path"], x["text"]) for x in markdown.sections(docs).orderBy("path", "section_order").collect()]
    assert got == [("a", 0, ["One"], "x"), ("a", 1, ["One", "Deep"], "y")]


def test_pdf_lines(spark):
    lines = [(0, 1, "Title", 14.0, False), (1, 1, "body text here", 10.0, False), (2, 1, "Bold head", 10.0, True), (3, 1, "Bold sentence.", 10.0, True), (4, 2, "more", 10.0, False), (5, 2, "From contents", 10.0, False), (6, 3, " ".join(["w"] * 19), 14.0, False), (7, 3, "Sub", 12.0, False), (8, 3, "end", 10.0, False)]
    df = spark.createDataFrame([("d", *x) for x in lines], "doc_id string, line_no int, page int, text string, size double, bold boolean")
    toc = spark.createDataFrame([("d", "From contents")], "doc_id string, title string")
    got = {x["line_no"]: x["level"] for x in pdf_lines.heading_decision(df, toc).collect()}
    assert got == {0: 1, 1: None, 2: 4, 3: None, 4: None, 5: 4, 6: None, 7: 2, 8: None}
    s = [(x["heading_path"], x["page_start"], x["page_end"]) for x in pdf_lines.sections(df, toc).orderBy("section_order").collect()]
    assert s == [(["Title"], 1, 1), (["Title", "Bold head"], 1, 2), (["Title", "From contents"], 3, 3), (["Title", "Sub"], 3, 3)]


def test_files(spark, tmp_path):
    f = spark.createDataFrame([("/x/A.PDF",), ("b.md",), ("c.txt",), ("none",), (".md",)], "path string")
    assert [x["reader"] for x in files.readers(f).collect()] == ["pdf", "markdown", None, None, None]
    gold = spark.createDataFrame([(1, "o", "q?", "s", "t", "c", "r", None)], "version int, owner_email string, question string, expected_section string, document_title string, source_chunk_id string, reference_answer string, note string")
    files.write_goldset(gold, str(tmp_path / "g"))
    assert files.read_goldset(spark, str(tmp_path / "g")).collect() == gold.collect()
    (tmp_path / "up").mkdir()
    (tmp_path / "up" / "a.MD").write_text("hello")
    assert files.uploads(spark, str(tmp_path / "up")).first()["stored_name"].endswith("9824.md")


def test_chunk_table_replaces_only_its_documents(spark, tmp_path):
    path = str(tmp_path / "chunks")
    rows = spark.createDataFrame([("o", "d1", "old"), ("o", "d2", "kept")], "owner_id string, document_id string, text string")
    files.write_chunks(rows, path)
    files.write_chunks(spark.createDataFrame([("o", "d1", "new")], rows.schema), path)
    assert sorted((x["document_id"], x["text"]) for x in spark.read.parquet(path).collect()) == [("d1", "new"), ("d2", "kept")]


def test_frames(spark):
    body = ': hi\n\nevent: token\ndata: {"text":"a\\nb"}\n\ndata: {"x":1}\n\nevent: token\n\nevent: token\ndata: {bad\n\n'
    got = [(x["event"], x["data"]) for x in sse.decode(spark.createDataFrame([("s", body)], "stream_id string, body string")).collect()]
    assert got == [("token", '{"text":"a\\nb"}'), ("message", '{"x":1}')]
    e = spark.createDataFrame([("a", 0, "meta", ""), ("a", 1, "token", "x"), ("a", 2, "token", "y"), ("a", 3, "done", ""), ("b", 0, "meta", ""), ("b", 1, "token", "z"), ("b", 2, "error", ""), ("c", 0, "token", "")], "stream_id string, seq int, event string, data string")
    assert {x["stream_id"]: (x["valid"], x["complete"]) for x in sse.protocol(e).collect()} == {"a": (True, True), "b": (True, False), "c": (False, False)}
    assert [tuple(x) for x in sse.reconcile(e.where("stream_id <> 'c'")).collect()] == [("a", "xy")]


STEMS = """consign consign|consigned consign|consistency consist|consistently consist|knightly knight|happy happi|skies sky|dying die|generously generous|general general|communication communic|national nation|relational relat|caresses caress
ponies poni|ties tie|cries cri|hopping hop|hoped hope|running run|agreed agre|feed feed|gas gas|gaps gap|kiwis kiwi|by by|say say|cry cri|bed bed|shed shed|hopefulness hope|rational ration|formaliti formal|decisiveness decis|adjustment adjust
adoption adopt|controlling control|rolled roll|luxuriated luxuri|news news|succeeded succeed|yes yes|youth youth|boyish boyish|biology biolog|necessarily necessarili"""


def test_stems():
    from passagelake.functions.english import stem

    pairs = [x.split() for x in STEMS.replace("\n", "|").split("|")]
    assert {w: stem(w) for w, _ in pairs} == {w: s for w, s in pairs}


def test_english_search(spark):
    from passagelake.functions.english import english

    q = spark.createDataFrame([(1, "alice", "the policies recognized", None), (2, "alice", "the of and", None)], "question_id int, owner_id string, text string, embedding array<float>")
    assert [(x["question_id"], x["chunk_id"]) for x in r.lexical_topk(q, corpus(spark), analyzer=english).collect()] == [(1, "alice:0")]


def test_models(spark):
    from passagelake.operators import assistant, models

    df = spark.createDataFrame([(1, "some words"), (2, " "), (3, None)], "id int, x string")
    got = {x["id"]: x["v"] for x in df.select("id", models.embed(F.col("x"), models.HashingEmbedder).alias("v")).collect()}
    assert len(got[1]) == 64 and got[2] is None and got[3] is None
    chunks = corpus(spark).withColumn("embedding", models.embed(F.col("text"), models.HashingEmbedder))
    questions = spark.createDataFrame([(1, 1, "alice", "warehouse safety manual?"), (2, 2, "nobody", "revenue?")], "question_id int, session_id int, owner_id string, text string")
    context = assistant.context_of(questions, chunks, assistant.Models())
    first = context.where("marker = 1").first()
    assert first["chunk_id"] == "alice:1" and context.where("question_id = 2").count() == 0


def test_lengths_of_inputs_and_reference_answers(spark):
    texts = ["", "q", "q" * 4000, "q" * 4001, "p" * 9, "p" * 10, "p" * 72, "p" * 73, "é" * 36, "é" * 37, None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    rows = df.select("i", tx.valid_question(F.col("x"), 4000).alias("q"), tx.valid_password(F.col("x"), 10, 72).alias("p")).orderBy("i").collect()
    assert [r["q"] for r in rows] == [False, True, True, False, True, True, True, True, True, True, False]
    assert [r["p"] for r in rows] == [False, False, False, False, False, True, True, False, True, False, False]
    answers = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", ""), ("c", None)], "k string, r string")
    assert {r["k"]: r["referenced"] for r in ev.all_referenced(answers, "r", "k").collect()} == {"a": True, "b": False, "c": False}
    assert ev.all_referenced(answers.where("false"), "r").collect()[0]["referenced"] is True


def test_answers_of_texts_without_sentences(spark):
    from passagelake.operators import models

    write = models.ExtractiveGenerator().complete
    assert write("CONTEXT:\n[1] t\nOne. Two.\n\n[2] u\nx") == "One. [1]"
    assert write("CONTEXT:\n[1] t\nno end here\n\n[2] u\nnor here\n\nQUESTION:\nwhat") == "no end here [1]"
    assert write("CONTEXT:\n[1] t\n   \n\nQUESTION:\nwhat") == "[1]"


def test_records_run_models_and_searches_once(spark, sf):
    from passagelake.plans import texts

    plan = texts.answer_records(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "Generate" not in plan and "documents.parquet" not in plan


def test_units_are_packed_in_small_parts():
    import pyarrow as pa

    rows = [["ab"] * 3, None, [], ["abcdefgh" * 4], [None, "x"], *([["abcd"]] * 9)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array(rows, pa.list_(pa.string()))], names=["i", "units"])
    parts = list(ch.parts_of(batch, "units", 10))
    assert [r for p in parts for r in p.column("units").to_pylist()] == rows and [i for p in parts for i in p.column("i").to_pylist()] == list(range(len(rows)))
    assert all(p.num_rows == 1 or sum(len(u or "") for r in p.column("units").to_pylist() for u in r or []) <= 10 for p in parts)
    assert len(parts) > 5 and list(ch.parts_of(batch.slice(0, 0), "units")) == []
