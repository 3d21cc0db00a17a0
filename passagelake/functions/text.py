"""Column functions over text: terms, query expressions, headings, citations, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..conf import SETTINGS

#: White space as Python strips it: Unicode's, and four control characters beside.
BLANK = r"[\s\x1c-\x1f]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\u0085\u2028\u2029]"
OPERATORS = ("or", "and", "not")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^{BLANK}+|{BLANK}+$", "")


def terms(c: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def query_terms(c: Column, most: int = SETTINGS.max_terms) -> Column:
    """Terms without operator words, each once in the order of appearance, ``most`` at most."""
    return F.slice(F.array_distinct(F.filter(terms(c), lambda t: ~t.isin(*OPERATORS))), 1, most)


def query_expression(c: Column, most: int = SETTINGS.max_terms) -> Column:
    return F.array_join(query_terms(c, most), " or ")


def sentence_units(c: Column) -> Column:
    """Sentences and paragraphs, stripped, without blank ones."""
    pieces = F.split(F.coalesce(c, F.lit("")), r"(?<=[.!?])\s+|\n{2,}")
    return F.filter(F.transform(pieces, strip), lambda u: u != "")


def word_count(c: Column) -> Column:
    """Words between white space; 0 for blank text."""
    clean = strip(F.coalesce(c, F.lit("")))
    return F.when(clean == "", 0).otherwise(F.size(F.split(clean, rf"(?U){BLANK}+")))


def encode_path(path: Column) -> Column:
    return F.array_join(path, SETTINGS.separator)


def decode_path(c: Column) -> Column:
    parts = F.split(F.coalesce(c, F.lit("")), SETTINGS.separator)
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def chunk_id(document: Column, index: Column) -> Column:
    return F.concat_ws(":", document.cast("string"), index.cast("string"))


def section_or_title(heading_path: Column, title: Column) -> Column:
    return F.coalesce(F.nullif(heading_path, F.lit("")), title)


def citation_markers(answer: Column) -> Column:
    """Numbers of one or two digits in brackets, each once in the order of appearance."""
    found = F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"\[(\d{1,2})\]"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda m: m.cast("int")))


def valid_markers(markers: Column, chunks: Column) -> Column:
    return F.filter(markers, lambda m: (m >= 1) & (m <= chunks))


def hallucinated(emitted: Column, valid: Column) -> Column:
    """Emitted markers that aren't valid, repeats included."""
    return F.filter(emitted, lambda m: ~F.array_contains(valid, m))


def answer_fragments(answer: Column) -> Column:
    """The answer cut at its markers, which are pieces of their own; empty pieces are dropped."""
    marked = F.regexp_replace(F.coalesce(answer, F.lit("")), r"(\[\d{1,2}\])", "\u0001$1\u0001")
    return F.filter(F.split(marked, "\u0001"), lambda p: p != "")


def source_label(title: Column, heading_path: Column, page: Column) -> Column:
    return F.concat_ws(" | ", title, F.nullif(heading_path, F.lit("")), F.concat(F.lit("p. "), page.cast("string")))


def normalised(c: Column) -> Column:
    return F.lower(strip(F.regexp_replace(F.coalesce(c, F.lit("")), rf"(?U){BLANK}+", " ")))


def section_matches(section: Column, expected: Column) -> Column:
    """Whether the normalised section contains the expected one; an empty expectation matches any."""
    return normalised(section).contains(normalised(expected))


def snippet(c: Column, most: int) -> Column:
    return F.substring(c, 1, most)


def iso_stamp(c: Column) -> Column:
    """A timestamp in UTC as ISO text; microseconds are written only where there are some."""
    micros = F.pmod(F.unix_micros(c), F.lit(1_000_000))
    part = F.when(micros == 0, F.lit("")).otherwise(F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0")))
    return F.concat(F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss"), part, F.lit("+00:00"))


def file_stamp(c: Column) -> Column:
    """A timestamp in UTC for names of files."""
    return F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyyMMdd'T'HHmmss'Z'")


def valid_question(c: Column, most: int) -> Column:
    """Of 1 to ``most`` characters; false for null."""
    return F.coalesce(F.length(c).between(1, most), F.lit(False))


def valid_password(c: Column, least: int, most_bytes: int) -> Column:
    """Of at least that many characters and at most that many bytes in UTF-8; false for null."""
    return F.coalesce((F.length(c) >= least) & (F.octet_length(c) <= most_bytes), F.lit(False))


def valid_request_id(c: Column) -> Column:
    return F.coalesce(strip(c).rlike(r"\A[A-Za-z0-9._:-]{1,64}\z"), F.lit(False))


def request_id(c: Column) -> Column:
    """The given id if it is well formed, else a new one of 16 hex digits."""
    return F.when(valid_request_id(c), strip(c)).otherwise(F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 16))


def client_address(forwarded: Column, peer: Column, hops: int) -> Column:
    """The address ``hops`` from the right of a forwarding header; the peer's if there are too few."""
    parts = F.filter(F.transform(F.split(F.coalesce(forwarded, F.lit("")), ","), strip), lambda p: p != "")
    return F.when((F.lit(hops) > 0) & (F.size(parts) >= hops), F.try_element_at(parts, F.lit(-max(hops, 1)))).otherwise(peer)


def parse_questions(raw: Column) -> Column:
    """Questions of a JSON array; else the lines that end in a question mark, without list marks."""
    listed = F.from_json(strip(raw), "array<string>")
    lines = F.transform(F.split(F.coalesce(raw, F.lit("")), LINE_END), lambda x: F.regexp_replace(strip(F.regexp_replace(strip(x), r"^[-*0-9. ]+", "")), r'^[",]+|[",]+$', ""))
    kept = F.filter(lines, lambda x: x.endswith("?"))
    clean = F.filter(F.transform(listed, strip), lambda x: F.coalesce(x != "", F.lit(False)))
    return F.when(listed.isNotNull() & strip(raw).startswith("["), clean).otherwise(kept)


def document_hue(key: Column) -> Column:
    """A colour angle from a 32-bit rolling hash of an ASCII key."""
    codes = F.transform(F.split(key, ""), lambda ch: F.ascii(ch).cast("long"))
    rolled = F.aggregate(codes, F.lit(0).cast("long"), lambda h, ch: (h * 31 + ch).bitwiseAND(F.lit(4294967295)))
    return F.floor(F.pmod(rolled * F.lit(137.508), F.lit(360.0)) + 0.5).cast("int")


def file_parts(path: Column) -> tuple[Column, Column, Column]:
    """Base name, stem and lower-cased suffix of a path."""
    base = F.element_at(F.split(path, "/"), -1)
    suffix = F.regexp_extract(base, r"(?<=.)(\.[^.]+)$", 1)
    return base, F.substr(base, F.lit(1), F.length(base) - F.length(suffix)), F.lower(suffix)
