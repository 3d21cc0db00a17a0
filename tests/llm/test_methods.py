"""Each operator against a brute-force version, an exact round trip or held-out rows."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagelake.llm import components, fingerprints, language, lm, media, mixing, packing, queries, sharding, simhash, toxicity, url_filter
from passagelake.llm.tokens import ByteBpe

SMALL = "/root/testdata/sf0.001"
MIDDLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}


def test_shards_hold_the_mixture(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "source")
    for buckets in (None, 64):
        rows = sharding.interleaved_shards(docs, 7, buckets=buckets).collect()
        by_source = {}
        for r in rows:
            h = int(hashlib.md5(f"42:{r['doc_id']}".encode()).hexdigest()[:10], 16)
            by_source.setdefault(r["source"], []).append((h, r["doc_id"]))
        order = sorted(((2 * k - 1) / (2 * len(v)), s, k, i) for s, v in by_source.items() for k, (_, i) in enumerate(sorted(v), 1))
        n = len(order)
        want, slots = {}, Counter()
        for p, (_, _, _, i) in enumerate(order):
            shard = p * 7 // n
            want[i] = (shard, slots[shard])
            slots[shard] += 1
        assert {r["doc_id"]: (r["shard"], r["slot"]) for r in rows} == want


def test_sharding_uses_no_python(spark):
    plan = queries.op1_sharding(spark, SMALL)._jdf.queryExecution().toString() + queries.op8_url_filter(spark, SMALL)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def naive_simhash(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    import xxhash

    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_fingerprints_by_the_contract(spark, texts):
    rows = queries.op2_simhash(spark, SMALL).collect()
    assert all(int(r["fingerprint"], 16) == naive_simhash(texts[r["doc_id"]]) for r in rows)
    ids = sorted(texts)
    fp = np.array([naive_simhash(texts[i]) for i in ids], dtype=np.uint64)
    near = np.argwhere(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3)
    want = {ids[i]: ids[r] for i, r in enumerate(roots(len(ids), near))}
    assert {r["doc_id"]: r["component_id"] for r in rows} == want


@pytest.mark.parametrize("parts,rows_per_tile", [(4, 4096), (4, 5), (2, 16), (1, 7)])
def test_tiles_find_all_links(spark, parts, rows_per_tile):
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 2**64, 60, dtype=np.uint64)
    fp = np.unique(np.concatenate([seeds, *(s ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (12, int(rng.integers(1, 6)))).astype(np.uint64), axis=1) for s in seeds)]))
    df = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long").repartition(3)
    links = simhash.links_within(df, 3, parts, rows_per_tile).collect()
    at = {int(x): i for i, x in enumerate(fp.view(np.int64))}
    near = np.argwhere(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3)
    assert roots(len(fp), [(at[r["a"]], at[r["b"]]) for r in links]) == roots(len(fp), near)
    assert len(links) < 60 * len(fp)


def test_components(spark):
    random.seed(5)
    links = [(i, i + 1) for i in range(0, 150)] + [(1000, 1000 + i) for i in range(1, 80)] + [(2000 + random.randrange(200), 2000 + random.randrange(200)) for _ in range(150)] + [(7, 7), (5, 4)]
    df = spark.createDataFrame([*links, (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.connected_components(df).collect()}
    want = roots(2300, links)
    assert got == {x: want[x] for a, b in links if a != b for x in (a, b)}
    assert components.connected_components(df.limit(0)).count() == 0


def container(sizes, chunks, keys, wide):
    box = lambda kind, *parts: struct.pack(">I4s", 8 + sum(map(len, parts)), kind) + b"".join(parts)
    full = lambda kind, *parts: box(kind, bytes(4), *parts)
    payload = [bytes([i % 256]) * n for i, n in enumerate(sizes)]
    head = box(b"ftyp", b"isom", bytes(4)) + box(b"free", b"gap")
    body, offsets, done = b"", [], 0
    for n in chunks:  # chunks lie apart
        offsets.append(len(head) + 8 + len(body) + 3)
        body += b"\xff\xff\xff" + b"".join(payload[done : done + n])
        done += n
    at = full(b"co64", struct.pack(">I", len(offsets)), struct.pack(f">{len(offsets)}Q", *offsets)) if wide else full(b"stco", struct.pack(">I", len(offsets)), struct.pack(f">{len(offsets)}I", *offsets))
    runs = [(i + 1, n, 1) for i, n in enumerate(chunks)]
    stbl = box(b"stbl", full(b"stsd", struct.pack(">I", 1), box(b"avc1", bytes(78))), full(b"stsz", struct.pack(">II", 0, len(sizes)), struct.pack(f">{len(sizes)}I", *sizes)), full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)), at, full(b"stss", struct.pack(">I", len(keys)), struct.pack(f">{len(keys)}I", *keys)))
    trak = box(b"trak", box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 1000, 2500, 0, 0)), full(b"hdlr", bytes(4), b"vide", bytes(13)), box(b"minf", stbl)))
    return head + box(b"mdat", body) + box(b"moov", trak), payload


@pytest.mark.parametrize("wide", [False, True])
def test_sample_tables(wide):
    data, payload = container([5, 0, 7, 100, 1, 30], [2, 3, 1], [1, 4], wide)
    (track,) = media.read_container(data)
    assert (track.codec, track.kind, track.duration / track.timescale) == ("avc1", "vide", 2.5)
    assert [data[o : o + n] for o, n in zip(track.offsets, track.sizes)] == payload
    assert [data[o : o + n] for o, n in track.keyframes()] == [payload[0], payload[3]]
    assert media.read_samples(data, track) == b"".join(payload)
    for broken in (b"", b"abc", data[:40], b"\xff" * 64):
        assert media.read_container(broken) == []


def test_damaged_containers_are_told_and_harmless():
    import tracemalloc

    made = [container([5, 0, 7, 100, 1, 30], [2, 3, 1], [1, 4], wide)[0] for wide in (False, True)] + [media.write_container(b"x" * 192 * 70)]
    rng = random.Random(1)
    tracemalloc.start()
    told = 0
    for k in range(10_000):
        data = bytearray(rng.choice(made))
        if k % 3 == 0:
            del data[rng.randrange(len(data)) :]
        for _ in range(rng.choice((0, 1, 1, 2, 8)) if k % 3 else 0):
            data[rng.randrange(len(data)) if k % 2 else len(data) - rng.randrange(1, 400)] = rng.randrange(256)
        try:
            for t in media.read_container(bytes(data)):
                t.keyframes()
                media.feature(t)
        except ValueError:
            told += 1
    assert told > 500 and tracemalloc.get_traced_memory()[1] < 64 << 20
    tracemalloc.stop()


def test_damaged_rows_give_rows(spark):
    good, _ = container([5, 7], [2], [1], False)
    at = good.index(b"stsz")
    huge = good[: at + 8] + struct.pack(">II", 1, 2**32 - 1) + good[at + 16 :]
    rows = [(1, bytearray(good), "x"), (2, bytearray(huge), "x"), (3, None, None), (4, bytearray(good[: len(good) - 30]), "x"), (5, bytearray(b""), "x")]
    df = spark.createDataFrame(rows, "id long, content binary, media_codec string")
    out = {r["id"]: r for r in media.media_columns(df).collect()}
    assert out[1]["media_codec"] == "avc1" and out[1]["media_error"] is None and len(out[1]["media_keyframes"]) == 1
    assert out[2]["media_error"] and out[2]["media_codec"] is None
    assert all(out[k]["media_codec"] is None for k in (3, 5)) and media.media_columns(df.limit(0)).count() == 0


def test_texts_make_the_round_trip(spark, texts):
    for r in queries.op3_media(spark, SMALL).collect():
        raw = texts[r["doc_id"]].encode()
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        data = media.write_container(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(data), hashlib.sha256(data).hexdigest())
    df = spark.createDataFrame([(1, bytearray(media.write_container(b"x" * 19200))), (2, None), (3, bytearray(b"junk"))], "id int, content binary")
    got = {r["id"]: r for r in media.media_columns(df).collect()}
    assert got[1]["media_codec"] == "raw" and [k["length"] for k in got[1]["media_keyframes"]] == [192] * 4 and got[2]["media_codec"] is None and got[3]["media_keyframes"] is None


def test_ids_are_the_tokenizers():
    bpe = ByteBpe(queries.tokenizer_path())
    assert bpe.pieces is not None
    rng = random.Random(1)
    odd = ["", " ", "  b", "a b ", "a\n b", "\n \n", "a<|endoftext|>b", "it's we'LL 12³ ½ x́y  é", "日本語 한글 \U0001f600"]
    odd += ["".join(rng.choice(["a", "bc", " ", " ", "\n", "\t", " ", ".", "'s", "1", "é"]) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    for x in odd:
        assert bpe.encode(x).tolist() == bpe.tokenizer.encode(x, add_special_tokens=False).ids, repr(x)


def test_packing_keeps_every_id(spark, texts):
    rows = queries.op4_packing(spark, SMALL).collect()
    bpe = ByteBpe(queries.tokenizer_path())
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i, text in texts.items():
        ids = np.array(bpe.tokenizer.encode(text, add_special_tokens=False).ids + [0], dtype="<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids)) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    padding = 0
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r["offset"])
        n = sum(r["length"] for r in pieces)
        assert [r["offset"] for r in pieces] == [sum(x["length"] for x in pieces[:i]) for i in range(len(pieces))]
        assert n <= 1024 and len(pieces) <= packing.SEGMENTS and sum(r["loss_tokens"] for r in pieces) <= packing.LOSS
        padding += 0 if n & (n - 1) == 0 else 1024 - n
    assert padding <= 0.01 * sum(r["length"] for r in rows)


@pytest.mark.parametrize("limits", [(1024, 64, 992), (1024, 64, 300), (1024, 3, 1024), (256, 64, 250), (1000, 7, 1), (64, 64, 64)])
def test_each_limit_binds(limits):
    rng = random.Random(str(limits))
    for lengths in ([700] * 30, [250] * 60, [rng.randint(1, 3000) for _ in range(120)], [1] * 500, [1, 5000], []):
        bins, done = packing.Bins(limits), []
        marks = {}
        for key, n in enumerate(lengths):
            lead = rng.choice((0, n // 8, n // 3, n - 1, n))
            loss = max(0, n - 1 - lead)
            marks[key] = [0] * lead + [1] * loss + [0] * (n - lead - loss)
            bins.add(packing.Piece(key, 0, np.arange(n, dtype="<u4"), n, 1, lead, loss, n))
            done += bins.closed()
        bins.finish()
        done += bins.closed()
        seen, padding, waste = {}, 0, 0
        for pieces in done:
            for p in pieces:  # against the marks, id by id
                assert p.ids.tolist() == list(range(p.start, p.start + p.tokens)) and sum(marks[p.key][p.start : p.start + p.tokens]) == p.loss
                seen.setdefault(p.key, []).extend(p.ids.tolist())
            tokens, loss = sum(p.tokens for p in pieces), sum(p.loss for p in pieces)
            assert pieces and tokens <= limits[0] and len(pieces) <= limits[1] and loss <= limits[2]
            full = tokens & (tokens - 1) == 0 or tokens == limits[0]
            assert full or len(pieces) == limits[1] or loss == limits[2]
            waste += not full
        assert {k: sorted(v) for k, v in seen.items()} == {k: list(range(n)) for k, n in enumerate(lengths)}
        if limits == (1024, 64, 992):
            assert waste == 0 or lengths == [1] * 500


def test_vectors_are_packed_under_all_limits(spark):
    rng = random.Random(2)
    rows = [(i, rng.randint(1, 900), rng.randint(1, 9), rng.randint(0, 300)) for i in range(800)] + [(800, 5000, 3, 10), (801, None, None, None)]
    out = packing.pack_vectors(spark.createDataFrame(rows, "key long, tokens long, segments long, loss long").coalesce(1), limits=(1024, 12, 400)).collect()
    assert sorted(r["key"] for r in out) == list(range(802))
    sums = {}
    for r in out:
        s = sums.setdefault(r["sequence_id"], [0, 0, 0, []])
        for k, c in enumerate(("tokens", "segments", "loss")):
            s[k] += r[c]
        s[3].append(r["key"])
    assert all((t <= 1024 and n <= 12 and x <= 400) or keys == [800] for t, n, x, keys in sums.values())
    lower = max(sum(r[1] or 0 for r in rows[:800]) / 1024, sum(r[2] or 0 for r in rows[:800]) / 12, sum(r[3] or 0 for r in rows[:800]) / 400)
    assert len(sums) <= 1.35 * lower + packing.OPEN
    turns = spark.read.parquet(f"{SMALL}/conversations.parquet")
    rows = queries.instruction_packing(spark, SMALL).collect()
    bpe, want = ByteBpe(queries.tokenizer_path()).tokenizer, {}
    for t in turns.collect():
        n = len(bpe.encode(t["text"] or "", add_special_tokens=False).ids) + 1
        x = want.setdefault(t["conv_id"], [0, 0, 0])
        x[:] = x[0] + n, x[1] + 1, x[2] + n * (t["role"] == "assistant")
    assert {r["conv_id"]: [r["tokens"], r["segments"], r["loss"]] for r in rows} == want and len(rows) == len(want)
    v = packing.conversation_vectors(turns, queries.tokenizer_path())
    assert v.where("loss > tokens or segments < 1").count() == 0 and packing.pack_vectors(v).count() == v.count()


def test_edited_texts(spark, texts):
    rows = {r["doc_id"]: r for r in queries.op5_fingerprints(spark, SMALL).collect()}
    order = sorted(texts, reverse=True)
    for i, following in zip(order, order[1:] + order[:1]):
        t, half = texts[i], len(texts[i]) // 2
        edited = t[: len(t) - half] + texts[following][:half]
        r = rows[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        bits = lambda x: int(x, 16)
        assert r["near_edited"] == 1 - (bits(r["fingerprint"]) ^ bits(r["edited_fingerprint"])).bit_count() / 128
        assert r["near_next"] == 1 - (bits(r["fingerprint"]) ^ bits(rows[following]["fingerprint"])).bit_count() / 128
    assert np.mean([r["near_edited"] > r["near_next"] for r in rows.values()]) > 0.95
    prints = [int(x, 16) for x in {r["fingerprint"] for r in rows.values()}]
    for i, r in rows.items():
        assert r["within_radius"] == (None if i % 100 else sum((int(r["fingerprint"], 16) ^ x).bit_count() <= 3 for x in prints) - 1)
    same = {}
    for i, r in rows.items():
        assert same.setdefault(texts[i], r["fingerprint"]) == r["fingerprint"]


def test_a_fingerprint_is_a_weighted_vote():
    words = "a b a c a b".encode().split()
    h = fingerprints._word_hashes(words)
    pairs = fingerprints._mixed(h[:-1], 2) + h[1:]
    votes = [0.0] * 128
    for term, n in Counter(h.tolist() + pairs.tolist()).items():
        both = [int(fingerprints._mixed(np.array([term], dtype=np.uint64), k)[0]) for k in (0, 1)]
        for b in range(128):
            votes[b] += (1 + math.log(n)) * (1 if both[b // 64] >> (b % 64) & 1 else -1)
    want = [sum((votes[k * 64 + b] > 1e-6) << b for b in range(64)) for k in (0, 1)]
    got = fingerprints.fingerprint("a B a c A b")
    assert all((int(g) ^ w).bit_count() <= sum(abs(v) < 1e-5 for v in votes) for g, w in zip(got, want))


@pytest.mark.parametrize("radius", [0, 3, 7])
def test_block_tables_find_all_within_the_radius(spark, radius):
    rng = random.Random(radius)
    seeds = [rng.getrandbits(128) for _ in range(40)]
    all_ = list({s ^ sum(1 << b for b in rng.sample(range(128), k)) for s in seeds for k in (0, 1, 2, 3, 5, 7, 8, 9)})
    df = spark.createDataFrame([(f"{x:032x}",) for x in all_] + [(None,)], "fingerprint string")
    got = {(r["query_fp"], r["fp"], r["distance"]) for r in fingerprints.within_radius(df, df, radius).collect()}
    assert got == {(f"{a:032x}", f"{b:032x}", (a ^ b).bit_count()) for a in all_ for b in all_ if (a ^ b).bit_count() <= radius}


def test_a_common_block_is_cut(spark):
    prints = spark.range(3000).select(F.concat(F.lpad(F.lower(F.hex("id")), 8, "0"), F.lit("0" * 24)).alias("fingerprint"))
    asked = F.col("fingerprint").isin("0" * 32, "00000001" + "0" * 24)
    got = {r["fingerprint"]: r["within_radius"] for r in fingerprints.count_within_radius(prints, asked).collect()}
    assert len(got) == 3000 and sum(v is not None for v in got.values()) == 2
    for k in (0, 1):
        assert got[f"{k:08x}" + "0" * 24] == sum((k ^ x).bit_count() <= 3 for x in range(3000)) - 1
    with pytest.raises(ValueError):
        fingerprints.within_radius(prints, prints, 32)


def test_language_of_held_out_rows(spark):
    rows = queries.op6_language(spark, MIDDLE).join(spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert len(held) > 100 and np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97


def test_spans_scripts_and_viterbi(spark):
    train = [("en", "the quick brown fox jumps over the lazy dog and then they went home together"), ("de", "der schnelle braune fuchs springt über den faulen hund und dann gingen sie nach hause"), ("ru", "быстрая коричневая лиса прыгает через ленивую собаку")]
    model = language.fit(spark.createDataFrame(train * 20, "lang string, text string"))
    text = "they went home together and then 12 der schnelle hund und dann gingen sie ленивую собаку"
    (row,) = language.language_spans(spark.createDataFrame([(1, text)], "doc_id int, text string"), model).collect()
    assert [(s["lang"], s["words"]) for s in row["spans"]] == [("en", 6), ("de", 7), ("ru", 2)]
    assert text[row["spans"][1]["start"] :].startswith("der") and text[row["spans"][2]["start"] :].startswith("лен")
    rng = np.random.default_rng(1)
    scores, doc = rng.normal(0, 3, (40, 3)), np.sort(rng.integers(0, 9, 40))
    path = language.viterbi(scores.copy(), doc, 2.0)
    total = lambda p, s: sum(s[i, k] for i, k in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))
    import itertools

    for d in set(doc.tolist()):
        own = scores[doc == d]
        if len(own) <= 7:
            assert total(path[doc == d], own) == pytest.approx(max(total(p, own) for p in itertools.product(range(3), repeat=len(own))))


def test_lm_scores(spark, texts):
    rows = {r["doc_id"]: r for r in queries.op7_lm(spark, SMALL).collect()}
    words = {i: [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) if w] + [""] for i, t in texts.items()}
    c = Counter(w for i, ws in words.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in words.items():
        r = rows[i]
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel=1e-9)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(ws), sum(c[w] > 0 for w in ws), n, zlib.crc32(str(i).encode()) % 5 == 1)


def test_lm_probabilities_add_up_and_beat_counts(spark):
    rng = random.Random(4)
    chains = {"en": "a b c d e f g h".split(), "de": "s t u v w x y z".split()}
    lines = [(i, " ".join(rng.choice(chains[lang]) for _ in range(60))) for i in range(600) for lang in (rng.choice(["en", "de"]),)]
    docs = spark.createDataFrame(lines, "doc_id long, text string")
    counted = lm.count_words(docs)
    known = lm.vocabulary(counted)
    model = lm.train(docs, known)
    before = np.array([[0, 1], [3, 2], [model.n, model.n], [5, model.n]])
    for b in before:
        p = np.exp(model.scores(np.repeat(b[None], model.n, 0), np.arange(model.n)) - model.log_normalisers(b[None]))
        assert p.sum() == pytest.approx(1, abs=1e-4)
    other = (known.counts[known.classes :] + 0.5).sum() + 0.5
    assert other == pytest.approx(known.other_denominator())
    rows = lm.score_texts(docs, counted, known, model).collect()
    assert np.mean([r["score"] > r["base_score"] for r in rows]) > 0.95


def test_two_level_probabilities_by_brute_force(monkeypatch):
    monkeypatch.setattr(lm, "CLASSES", 4)
    monkeypatch.setattr(lm, "GROUP", 5)
    counts = np.array([90, 70, 50, 20, 19, 18, 17, 16, 12, 9, 8, 7, 3, 1])
    known = lm.Vocabulary([b"w%d" % i for i in range(14)], counts, int(counts.sum()) + 4, 18)
    assert (known.classes, known.modelled, known.last) == (3, 11, 5)
    ids = np.array([*range(14), -1])
    assert known.classes_of(ids).tolist() == [0, 1, 2, 3, 3, 3, 3, 3, 4, 4, 4, 5, 5, 5, 5]
    assert known.grouped_of(ids).tolist() == [-1, -1, -1, *range(8), -1, -1, -1, -1]
    model, rng = lm.LogBilinear(known.shares(), known.grouped_shares()), np.random.default_rng(3)
    model.set(model.flat + rng.normal(0, 0.3, len(model.flat)))
    trainer, old = lm.Trainer(model, 1), model.grouped.copy()
    trainer.step(np.array([[0, 1], [2, 4]]), np.array([3, 0]), np.array([2, -1]))
    assert trainer.times.tolist() == [0, 0, 1, 0, 0, 0, 0, 0] and (model.grouped[2] != old[2]).all() and (model.grouped[5:] == old[5:]).all()
    for before in ([0, 1], [4, 6], [6, 6]):
        q = sum(model.context[c].astype(float) @ model.mix[i] for i, c in enumerate(before))
        of_class = np.exp(model.target @ q + model.bias)
        of_class /= of_class.sum()
        want = [of_class[i] for i in range(3)]
        for g, members in ((3, range(5)), (4, range(5, 8))):
            inside = [np.exp(model.grouped[j] @ q + model.grouped_bias[j]) for j in members]
            want += [of_class[g] * x / sum(inside) for x in inside]
        rows = np.repeat([before], 11, 0)
        got = model.scores(rows, known.classes_of(np.arange(11))) - model.log_normalisers(rows)
        got[3:] += model.log_within(rows[3:], np.arange(8))
        assert np.exp(got) == pytest.approx(want, rel=1e-4) and sum(want) + of_class[5] == pytest.approx(1)


def test_dictionary_and_table_agree(spark, texts, monkeypatch):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    counted = lm.count_words(docs)
    whole = lm.vocabulary(counted)
    part = lm.vocabulary(counted, 2000)
    assert part.classes == whole.classes and len(part.words) <= 2000 < len(whole.words) and (part.total, part.distinct) == (whole.total, whole.distinct)
    model = lm.LogBilinear(whole.shares(), whole.grouped_shares())
    a, b = ({r["doc_id"]: r for r in lm.score_texts(docs, counted, k, model).collect()} for k in (whole, part))
    for i in a:
        assert a[i]["n_known"] == b[i]["n_known"] == a[i]["n_tokens"]
        assert a[i]["score"] == pytest.approx(b[i]["score"], rel=1e-6) and a[i]["base_score"] == pytest.approx(b[i]["base_score"], rel=1e-9)


def test_filter_passes_all_listed_and_the_join_no_others(spark):
    listed = [(f"http://www.Host{i}.example/p/{i}/?b=2&a=1&utm_x=3#f",) for i in range(500)]
    pages = [(i, f"https://host{i}.example/p/{i}?a=1&b=2") for i in range(0, 2000)] + [(9999, "https://host7.example/p/7?a=1&b=2")] * 700
    lst = spark.createDataFrame(listed, "url string").select(url_filter.canonical_url(F.col("url")).alias("canonical"))
    got = url_filter.listed_pages(spark.createDataFrame(pages, "page_id long, url string"), lst)
    assert {r["page_id"] for r in got.where("is_listed").collect()} == {*range(500), 9999} and got.count() == len(pages)
    one = url_filter.bloom_filter(lst, "canonical", 1).collect()
    assert len(one) == 1 and url_filter.blocks_for(10**12) == url_filter.MOST_BLOCKS


def test_toxicity_scores_by_brute_force(spark):
    lexicon = toxicity.Lexicon({" vlix": 2.0, " moop ": 1.5, " oo": 0.25}, {" vlixor pudding ": 2.0}, (1.0, 0.9, -0.5))
    texts = ["", None, "Vlixor, pudding", "vlixor\n\npudding", "a vlixor", "MOOP m00p moop", "moopmoop", "vl1xxor!! oops vlixor pudding", "word " * 500 + "moop", "? ! 1"]

    def naive(text):
        words = [w for w in re.split("[^a-z]+", "".join({"1": "i", "0": "o", "l": "i", "!": " "}.get(c, c) for c in (text or "").lower().replace("!!", "  "))) if w]
        plain = " " + " ".join(words) + " "
        fold = lambda p: p.replace("l", "i")
        count = lambda p: sum(plain.startswith(fold(p), k) for k in range(len(plain)))
        total = sum(w * count(p) for p, w in lexicon.weights.items()) - sum(w * count(p) for p, w in lexicon.exceptions.items())
        b = lexicon.curve
        return 1 / (1 + math.exp(-(b[0] + b[1] * math.log(max(total, 0) + toxicity.EMPTY) + b[2] * math.log(len(words) + 2))))

    lexicon2 = toxicity.Lexicon({k.replace("l", "i"): v for k, v in lexicon.weights.items()}, {k.replace("l", "i"): v for k, v in lexicon.exceptions.items()}, lexicon.curve)
    got = toxicity.score_toxicity(spark.createDataFrame([(i, t, 7.0) for i, t in enumerate(texts)], "doc_id long, text string, score double"), lexicon2).collect()
    assert len(got) == len(texts)
    for r in got:
        assert abs(r["score"] - naive(texts[r["doc_id"]])) < 1e-12 and r["predicted"] == (r["score"] >= 0.5)
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[2] == by[3] < by[4]


def test_lexicon_folds_and_excepts(spark):
    rng = random.Random(6)
    filler = ["".join(rng.choice("aeioubcdfgmnprst") for _ in range(rng.randint(3, 8))) for _ in range(3000)]
    rows, labels = [], []
    for i in range(1200):
        words = [rng.choice(filler) for _ in range(rng.randint(5, 200))]
        toxic = i % 4 == 0
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["Vlixxor", "v1ixx0r", "zwerqual", "zwerquous", "zwerqish"]))
        elif i % 90 == 1:
            words.insert(rng.randrange(len(words)), "vlixxor pudding")
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lexicon = toxicity.fit_lexicon(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True))
    new = [(1, "you are a vlіхxor", 1), (2, "a V L", 0), (3, "we ate vlixxor pudding", 0), (4, "such zwerqness " + "word " * 3000, 1), (5, None, 0), (6, "", 0), (7, "VL1XX0R!", 1), (8, " ".join(filler[:500]), 0)]
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(spark.createDataFrame(new, "doc_id long, text string, y int"), lexicon).collect()}
    assert got == {i: y for i, _, y in new}


def test_toxicity_of_held_out_rows(spark):
    rows = queries.op9_toxicity(spark, MIDDLE).join(spark.read.parquet(f"{MIDDLE}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in rows]) > 0.95 and not any(r["predicted"] for r in rows if r["toxic"] == 0)


def test_shortages_go_to_siblings_first():
    leaves = {("x", "en"): 100, ("x", "de"): 10, ("y", "en"): 1000}
    got = mixing.budgets(leaves, ({"x": 0.5, "y": 0.5}, {}), 160, 1)
    assert got == {("x", "en"): 70, ("x", "de"): 10, ("y", "en"): 80}
    got = mixing.budgets(leaves, ({"x": 0.5, "y": 0.5}, {}), 400, 1)
    assert got == {("x", "en"): 100, ("x", "de"): 10, ("y", "en"): 290}
    assert sum(mixing.budgets(leaves, ({}, {}), 10**6, 2).values()) == 2220 and mixing.budgets({}, ({}, {}), 5, 1) == {}


def test_mixture_is_a_prefix_of_seeded_epochs(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("domain", queries.domain(F.col("source"))).toPandas()
    docs["tokens"] = [len(re.findall("[^\x20\x09-\x0d]+", t)) for t in docs.text]
    leaves = docs.groupby(["domain", "lang", "source"]).tokens.sum().to_dict()
    amounts = mixing.budgets(leaves, queries.MIX_WEIGHTS, int(queries.MIX_SHARE * docs.tokens.sum()), queries.MIX_EPOCHS)
    want = []
    for leaf, g in docs.groupby(["domain", "lang", "source"]):
        whole, rest = divmod(amounts[leaf], leaves[leaf])
        want += [(i, e) for e in range(whole) for i in g.doc_id]
        order = sorted((int(hashlib.md5(f"42:{whole}:{i}".encode()).hexdigest()[:15], 16), n, i) for i, n in zip(g.doc_id, g.tokens))
        before = 0
        for _, n, i in order:
            if 2 * before + n <= 2 * rest:
                want.append((i, whole))
            before += n
    assert sorted((r["doc_id"], r["epoch"]) for r in queries.op10_mixing(spark, SMALL).collect()) == sorted(want)


@pytest.mark.parametrize("rows_per_tile", [4096, 20])
def test_similar_texts_are_grouped_and_others_are_not(spark, rows_per_tile):
    from passagelake.llm import simhash_long as sl

    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(4000)]
    docs, near, far = [], [], []
    for i in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(120, 400))]
        docs.append((i, " ".join(base)))
        one = list(base)
        one[rng.randrange(len(one))] = "changed"
        docs.append((1000 + i, " ".join(one)))  # similarity above 0.9
        near.append((i, 1000 + i))
        half = base[: len(base) // 2] + [rng.choice(vocabulary) for _ in range(len(base) // 2)]
        docs.append((2000 + i, " ".join(half)))  # below 0.5
        far.append(2000 + i)
    base = [rng.choice(vocabulary) for _ in range(300)]
    for i in range(150):  # one large group
        docs.append((3000 + i, " ".join([*base[:i], f"new{i}", *base[i + 1 :]])))
        near.append((3000, 3000 + i))
    docs += [(5000, docs[0][1].upper()), (5001, ""), (5002, None), (None, docs[1][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    distinct, members = sl.similar_groups(df, rows_per_tile=rows_per_tile)
    key = {r["id"]: r["row"]["key"] for r in distinct.collect()}
    assert 5000 not in key.values() and 5002 not in key.values() and 5001 in key.values()
    found = {key[r["node"]]: r["component"] for r in members.collect()}
    assert all(found[a] == found[b] for a, b in near) and not any(x in found for x in far)
    kept = sorted(r["doc_id"] for r in sl.first_of_each(df).collect())
    assert kept == sorted([*range(60), *far, 3000, 5001])


@pytest.mark.parametrize("rows_per_tile", [4096, 24])
def test_tiles_hold_all_candidates_between_groups(spark, rows_per_tile):
    from passagelake.llm import simhash_long as sl

    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**64, 200, dtype=np.uint64)
    sets = [np.unique(np.append(base[rng.random(200) < 0.93], rng.integers(0, 2**64, 10, dtype=np.uint64))) for _ in range(120)]
    rows = [(i, len(s), bytearray(sl.long_fingerprint(s, sl.FINE)), sl.band_keys(s).tolist(), bytearray(sl.short_keys(s))) for i, s in enumerate(sets)]
    distinct = spark.createDataFrame(rows, "id long, n long, fp binary, bands array<bigint>, keys binary")
    group = [i // 40 * 40 if i < 80 else i for i in range(120)]
    groups = spark.createDataFrame(list(enumerate(group)), "id long, group long")
    tiles = sl.tile_rows(distinct).join(groups, "id").join(distinct.select("id", "fp", "keys"), "id")
    links = {(min(r), max(r)) for r in sl.candidates(tiles, rows_per_tile=rows_per_tile).collect()}
    fp = np.frombuffer(b"".join(bytes(r[2]) for r in rows), np.uint64).reshape(120, -1)
    within = sl.radii(0.8, sl.FINE_STEPS)[sl.LARGE, -1]
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if group[i] != group[j] and np.bitwise_count(fp[i] ^ fp[j]).sum() <= within and min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j])) and set(rows[i][3]) & set(rows[j][3])}
    sure = {(i, j) for i, j in want if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))}
    assert sure and sure <= links <= want


def test_keys_are_shared_as_often_as_the_similarity_tells():
    from passagelake.llm import simhash_long as sl

    rng = np.random.default_rng(6)
    for common, only in ((8, 1), (80, 10), (800, 100), (30, 10), (50, 50)):
        share, none = [], 0
        for _ in range(400):
            x = rng.integers(0, 2**64, common + 2 * only, dtype=np.uint64)
            equal = sl.band_keys(x[: common + only]) == sl.band_keys(np.append(x[:common], x[common + only :]))
            share.append(equal.mean())
            none += not equal.any()
        want = (common / (common + 2 * only)) ** sl.LEAST_OF
        assert abs(np.mean(share) - want) < 0.04
        if common == 8 * only:
            assert none == 0


def test_no_text_is_lost_where_keys_repeat(spark):
    from passagelake.llm import simhash_long as sl

    words = [f"w{i}" for i in range(400)]
    a, b = words[:100], words[200:300]
    near = lambda x: [*x[:50], "changed", *x[51:]]

    def kept(*rows):
        df = spark.createDataFrame([(k, " ".join(x), None) for k, x in rows], "doc_id long, text string, _hash string")
        return sorted((r["doc_id"], r["text"]) for r in sl.first_of_each(df).collect())

    text = " ".join
    assert kept((10, a), (10, b), (5, near(a))) == sorted([(5, text(near(a))), (10, text(b))])
    assert kept((10, a), (10, b), (20, near(a)), (30, near(b))) == sorted([(10, text(a)), (10, text(b))])
    assert len(kept((10, a), (10, near(a)), (10, near(a)))) == 1
    assert kept((None, a), (None, a), (7, near(a))) == [(7, text(near(a)))]
    rows = spark.createDataFrame([(None, text(a)), (None, text(a)), (None, text(b))], "doc_id long, text string")
    assert sorted(r["text"] for r in sl.first_of_each(rows).collect()) == sorted([text(a), text(b)])


def test_near_duplicates_are_decided_by_whole_shingle_sets(spark):
    from passagelake.llm import simhash_long as sl

    rng = random.Random(5)
    docs, made = [], iter(range(10**6))
    fresh = lambda n: [f"w{next(made)}" for _ in range(n)]

    def add(*texts):
        docs.extend([(len(docs) + k, " ".join(words)) for k, words in enumerate(texts)])

    for _ in range(12):
        for n, more in ((8, 1), (9, 1), (10, 1), (16, 3), (20, 4), (804, 200), (804, 201), (804, 210), (804, 180)):  # of n - 4 shingles, so many more
            base = fresh(n)
            add(base, base + fresh(more))
        for n in (8, 12, 20):
            base = fresh(n)
            add(base, base[:-1] + fresh(1), base[:-2] + fresh(2))
        base = fresh(200)
        for _ in range(3):  # chains and stars about the similarity
            at = rng.randrange(200)
            base = base[:at] + fresh(rng.randint(2, 40)) + base[at:]
            add(base)
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, x in docs for w in [x.split()]}
    links = [(i, j) for i in sets for j in sets if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    found = roots(len(docs), links)
    assert len(links) > 100
    kept = sorted(r["doc_id"] for r in sl.first_of_each(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert kept == sorted({found[i] for i in sets})
