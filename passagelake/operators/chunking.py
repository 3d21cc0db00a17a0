"""Sections into overlapping chunks of bounded size.

Splitting, joins, numbering and checks are DataFrame operations. Packing units is a fold over one section; it runs in Arrow
batches and takes time in proportion to the section.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..conf import SETTINGS, Settings
from ..functions.text import chunk_id, encode_path, sentence_units, word_count

Counter = Callable[[str], int]
#: Bytes of units that are packed at once.
PART_BYTES = 2 << 20


def words(text: str) -> int:
    return len(text.split())


def cut_long(unit: str, target: int, count: Counter) -> list[str]:
    """A unit beyond the target as runs of words; one word may still be too long."""
    runs: list[list[str]] = [[]]
    room = target
    for word in unit.split():
        cost = count(word)
        if runs[-1] and cost > room:
            runs.append([])
            room = target
        runs[-1].append(word)
        room -= cost
    return [" ".join(r) for r in runs if r]


def pack(units: list[str | None], target: int, overlap: int, least: int, count: Counter = words) -> list[str]:
    """Windows of units. A window closes before the unit that would overflow it; the next one begins with the units at its end that fit the overlap.

    A last window below ``least`` joins the one before. Null and blank units are left out.
    """
    pieces = [(p, count(p)) for u in units if u and u.strip() for p in ([u] if count(u) <= target else cut_long(u, target, count))]
    bounds: list[tuple[int, int]] = []
    start = held = 0
    for i, (_, cost) in enumerate(pieces):
        if i > start and held + cost > target:
            bounds.append((start, i))
            start, room = i, overlap
            while start > bounds[-1][0] and pieces[start - 1][1] <= room:
                start -= 1
                room -= pieces[start][1]
            held = sum(c for _, c in pieces[start:i])
        held += cost
    if pieces:
        bounds.append((start, len(pieces)))
    out = [" ".join(p for p, _ in pieces[a:b]) for a, b in bounds]
    if len(out) > 1 and count(out[-1]) < least:
        last = out.pop()
        out[-1] = f"{out[-1]} {last}"
    return out


def parts_of(batch: pa.RecordBatch, units: str, most: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows whose units have ``most`` bytes at most, or of one row, so that few rows are Python objects at once."""
    column = batch.column(units)
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(column.values), 0).to_numpy(zero_copy_only=False))])[column.offsets.to_numpy()]
    start = 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + most, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def pack_units(rows: DataFrame, units: str = "units", conf: Settings = SETTINGS, count: Counter = words) -> DataFrame:
    """Replace the array of units by the array windows. Other columns pass through; a null or empty array gives none."""
    target, overlap, least = conf.chunk_target, conf.chunk_overlap, conf.chunk_min
    others = [f for f in rows.schema.fields if f.name != units]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in parts_of(whole, units)):
            made = [pack(u or [], target, overlap, least, count) for u in batch.column(units).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in others), pa.array(made, pa.list_(pa.string()))], names=[*(f.name for f in others), "windows"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), "windows array<string>"])
    return rows.mapInArrow(run, schema)


def chunk_sections(sections: DataFrame, conf: Settings = SETTINGS, count: Counter = words) -> DataFrame:
    """Chunks of sections (document_id, section_order, heading_path as an array, text, page_start, page_end), numbered through the document."""
    keys = ["document_id", "section_order", "heading_path", "page_start", "page_end"]
    packed = pack_units(sections.select(*keys, sentence_units(F.col("text")).alias("units")), conf=conf, count=count)
    chunks = packed.select(*keys, F.posexplode("windows").alias("_pos", "text"))
    index = F.row_number().over(Window.partitionBy("document_id").orderBy("section_order", "_pos")) - 1
    numbered = chunks.withColumn("chunk_index", index)
    return numbered.select(
        chunk_id(F.col("document_id"), F.col("chunk_index")).alias("chunk_id"), "document_id", "chunk_index", encode_path(F.col("heading_path")).alias("heading_path"),
        "page_start", "page_end", "text", _tokens(count)(F.col("text")).alias("token_count"),
    )


def _tokens(count: Counter) -> Callable[[Column], Column]:
    """The counter that packed the chunks, for columns."""
    if count is words:
        return word_count
    return F.pandas_udf(lambda texts: texts.map(count).astype("int64"), "bigint", F.PandasUDFType.SCALAR)


def ingest_status(files: DataFrame, sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """document_id, status and reason: a file without sections or chunks has failed. files: document_id, readable."""
    s = sections.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_sections"))
    c = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    joined = files.join(s, "document_id", "left").join(c, "document_id", "left")
    reason = F.when(~F.col("readable"), "missing file").when(F.col("n_sections").isNull(), "no sections").when(F.col("n_chunks").isNull(), "no chunks")
    return joined.select("document_id", F.when(reason.isNull(), "ready").otherwise("failed").alias("status"), reason.alias("reason"), F.coalesce("n_chunks", F.lit(0)).alias("chunk_count"))
