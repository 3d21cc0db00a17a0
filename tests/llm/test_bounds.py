"""Small odd files and growing samples."""

import random
import struct
import tracemalloc

import pytest
from pyspark.sql import functions as F

from passagelake.llm import media, toxicity


def box(kind, *parts):
    return struct.pack(">I4s", 8 + sum(map(len, parts)), kind) + b"".join(parts)


def full(kind, *parts):
    return box(kind, bytes(4), *parts)


def track(n, size=1):
    tables = full(b"stsd", struct.pack(">I", 1), box(b"sowt", bytes(28))) + full(b"stsz", struct.pack(">II", size, n)) + full(b"stsc", struct.pack(">IIII", 1, 1, n, 1)) + full(b"stco", struct.pack(">II", 1, 32))
    return box(b"trak", box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 8000, n, 0, 0)), full(b"hdlr", bytes(4), b"soun", bytes(13)), box(b"minf", box(b"stbl", tables))))


def test_nested_boxes_and_many_samples_give_rows_in_little_memory(spark):
    nested = b""
    for _ in range(2000):
        nested = box(b"moov", nested)
    audio = lambda tracks, n: box(b"ftyp", b"isom", bytes(12)) + box(b"mdat", bytes(n)) + box(b"moov", *[track(n)] * tracks)
    files = [nested, audio(30, 1_000_000), audio(1, 4_000_000)]
    tracemalloc.start()
    for data in files[:2]:
        with pytest.raises(ValueError):
            media.read_container(data)
    (found,) = media.read_container(files[2])
    assert (found.keyframes(), found.n_keyframes(), found.codec) == ([(32, 4_000_000)], 4_000_000, "sowt") and media.feature(found)
    assert tracemalloc.get_traced_memory()[1] < 64 << 20
    tracemalloc.stop()
    rows = media.media_columns(spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(files)], "id int, content binary")).orderBy("id").collect()
    assert [r["media_error"] is None for r in rows] == [False, False, True] and rows[2]["media_codec"] == "sowt"


@pytest.mark.parametrize("terms, toxic", [(25, 500), (50, 1000)])
def test_more_rows_find_more_entries(spark, terms, toxic):
    rng = random.Random(1)
    letters = "abcdefghjkmnopqrstuvwxyz"
    names = ["".join(rng.choice(letters) for _ in range(3)) + "q" for _ in range(terms)]
    plain = [f"{a}{b}wort" for a in letters for b in letters[:12]]
    rows = [(i, " ".join(rng.choices(plain, k=20)) + (f" {names[i // 20]}" if i < toxic else ""), int(i < toxic)) for i in range(3 * toxic)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    found = toxicity.fit_lexicon(df.select("doc_id", "text"), df.select("doc_id", "toxic"), F.lit(True))
    assert sorted(e.strip() for e in found.weights) == sorted({toxicity.folded(x).strip() for x in names})
