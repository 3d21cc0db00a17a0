"""URL filters: host and path rules, and a blocked Bloom filter in front of an exact join.

The listed canonical URLs fill a blocked Bloom filter: one hash picks a block of eight 32-bit
words, eight others set one bit in each word, so a lookup touches one row. The filter is a DataFrame with
one row a block and a fixed number of blocks at most; only that bound makes it fit to broadcast.
Pages that pass it go to an exact hash join with the list, so a full filter costs time, never rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

WORDS = 8
MOST_BLOCKS = 1 << 17
#: A row of eight longs in Spark's own format.
BLOCK_BYTES = 96


def url_host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    return ascii_lower(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def canonical_url(url: Column) -> Column:
    """Host without www., path without closing slashes, the query's parameters sorted without utm_ ones; no scheme, no fragment."""
    host = F.regexp_replace(url_host(url), r"^www\.", "")
    path = F.regexp_replace(url_path(url), r"/+$", "")
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.startswith("utm_"))), "&")
    return F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks))


def bloom_filter(listed: DataFrame, url: str, blocks: int) -> DataFrame:
    """The filter's rows: _u_at (the block) and its words _u_w0 to _u_w7. Rows are combined before the shuffle."""
    c = F.col(url)
    bits = listed.select(_block(c, blocks).alias("_u_at"), F.xxhash64(c, F.lit("bits")).alias("mix"))
    words = [F.bit_or(F.expr(f"shiftleft(1L, cast(shiftright(mix, {5 * i}) & 31 as int))")).alias(f"_u_w{i}") for i in range(WORDS)]
    return bits.groupBy("_u_at").agg(*words)


def blocks_for(listed: int, bits_per_url: int = 16) -> int:
    return min(MOST_BLOCKS, max(1, math.ceil(listed * bits_per_url / (32 * WORDS))))


def listed_pages(pages: DataFrame, listed: DataFrame, url: str = "url") -> DataFrame:
    """Add is_listed: whether the page's canonical URL is one of those of ``listed`` (a column canonical).

    A null url is never listed. Repeated rows on either side are kept or counted once as a set should. A column ``is_listed`` of pages is replaced.
    """
    pages = pages.drop("is_listed")
    distinct = listed.select("canonical").where(F.col("canonical").isNotNull()).distinct()
    blocks = blocks_for(distinct.count())
    assert blocks * BLOCK_BYTES <= 16 << 20, "the filter's bound is what allows the broadcast"
    c = F.col("_u_c")
    probe = pages.withColumn("_u_c", F.when(F.col(url).isNotNull(), canonical_url(F.col(url)))).withColumns({"_u_block": _block(c, blocks), "_u_mix": F.xxhash64(c, F.lit("bits"))})
    tested = probe.join(F.broadcast(bloom_filter(distinct, "canonical", blocks)), F.col("_u_block") == F.col("_u_at"), "left")
    hit = F.lit(True)
    for i in range(WORDS):
        hit = hit & F.expr(f"(shiftright(_u_w{i}, cast(shiftright(_u_mix, {5 * i}) & 31 as int)) & 1) = 1")
    # Only possible hits are looked up; the others are dealt evenly by a key that no URL has.
    tested = tested.withColumn("_u_hit", F.coalesce(hit & c.isNotNull(), F.lit(False)))
    tested = tested.withColumn("_u_key", F.when(F.col("_u_hit"), c).otherwise(F.concat(F.lit("\0"), F.xxhash64(*pages.columns).cast("string"))))
    exact = distinct.select(F.col("canonical").alias("_u_exact"))
    joined = tested.join(exact, (F.col("_u_key") == F.col("_u_exact")) & F.col("_u_hit"), "left")
    return joined.withColumn("is_listed", F.col("_u_exact").isNotNull()).select(*pages.columns, "is_listed")


def best_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest of the (verdict, host, path) rules that fit, as its text and its verdict; null if none does.

    A rule fits its host and all subdomains where the path starts with the rule's.
    """
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, h + p).otherwise(text), F.when(fits, kind).otherwise(verdict)
    return text, verdict


def judge_pages(pages: DataFrame, rules: list[tuple[str, str, str]], listed: DataFrame, url: str = "url") -> DataFrame:
    """Add host, path, rule and verdict. Without a rule, a listed page is blocked and any other allowed.

    A null url, or one without ://, has an empty host and path, fits no rule and isn't listed unless such a
    text is. Empty input gives an empty result; other columns pass through, but columns of the names added are replaced.
    """
    seen = listed_pages(pages.drop("host", "path", "rule", "verdict"), listed, url)
    seen = seen.withColumns({"host": F.coalesce(url_host(F.col(url)), F.lit("")), "path": F.coalesce(url_path(F.col(url)), F.lit(""))})
    rule, verdict = best_rule(F.col("host"), F.col("path"), rules)
    return seen.withColumns({"rule": rule, "verdict": F.coalesce(verdict, F.when(F.col("is_listed"), "block").otherwise("allow"))})
