"""The registered queries of this subpackage: thin calls of the operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import extraction, language, lm
from .common import fold, table, text_bytes, written
from .fingerprints import count_within_radius, edit_likeness
from .media import media_digests
from .mixing import mix_sources, word_count
from .negatives import embedding_vectors, hard_negatives
from .packing import conversation_vectors, pack_documents, pack_vectors
from .sharding import interleaved_shards
from .simhash import near_duplicates
from .toxicity import fit_lexicon, score_toxicity
from .trie import prefix_trie
from .url_filter import canonical_url, judge_pages, url_host

N_SHARDS = 40
#: A file of the installed package of public tokenizers; a path may be given instead.
TOKENIZER = "byte_bpe_50k.json"

#: (verdict, host, path)
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Stands in for a published list: pages of hosts with such a word are the listed URLs.
SPAM_HOST = r"(adult|ads-|casino|bets|pills|spam)"

#: Levels of the mixture's tree, and the weights of their names. Sources weigh the same.
MIX_LEVELS = ("domain", "lang", "source")
MIX_WEIGHTS = ({"crawl": 0.4, "reference": 0.35, "forum": 0.25}, {"en": 0.4, "de": 0.2, "es": 0.2, "fr": 0.2}, {})
MIX_SHARE = 0.6
MIX_EPOCHS = 2


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = text_bytes(F.col("text"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    sharded = interleaved_shards(docs, N_SHARDS, ties=("size", "text_crc32"))
    return sharded.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def instruction_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole conversations in sequences of at most 1024 tokens, 16 turns and 640 tokens of the assistant."""
    vectors = conversation_vectors(table(spark, sf_dir, "conversations"), tokenizer_path())
    return pack_vectors(vectors, limits=(1024, 16, 640)).withColumnRenamed("key", "conv_id")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    likeness = written(edit_likeness(table(spark, sf_dir, "documents")), "likeness")
    return count_within_radius(likeness, F.coalesce(F.col("doc_id") % 100 == 0, F.lit(False)))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(~fold(F.col("doc_id"), 0)))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", fold(F.col("doc_id"), 0).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.fit_and_score(table(spark, sf_dir, "documents").select("doc_id", "text"), ~fold(F.col("doc_id"), 1))
    return scored.withColumn("held_out", fold(F.col("doc_id"), 1))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.where(url_host(F.col("url")).rlike(SPAM_HOST)).select(canonical_url(F.col("url")).alias("canonical"))
    return judge_pages(pages, URL_RULES, listed).select("page_id", "host", "path", "rule", "verdict", "is_listed")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = fit_lexicon(docs, table(spark, sf_dir, "labels"), ~fold(F.col("doc_id"), 0))
    return score_toxicity(docs, lexicon).select("doc_id", fold(F.col("doc_id"), 0).alias("held_out"), "score", "predicted")


def domain(source: Column) -> Column:
    """The sources' domains: the first is a crawl, those of one digit are reference works, the others forums."""
    return F.when(source == "src0", "crawl").when(source.rlike("^src[1-9]$"), "reference").otherwise("forum")


def mixture(docs: DataFrame) -> DataFrame:
    """The rows of documents that the mixture takes, with domain and epoch."""
    return mix_sources(docs.withColumn("domain", domain(F.col("source"))), MIX_LEVELS, MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS, word_count(F.col("text")))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixture(table(spark, sf_dir, "documents"))
    return taken.select("doc_id", "domain", "lang", "source", "epoch", word_count(F.col("text")).alias("tokens"))


def op11_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extraction.extract_main(pages, extraction.fit(pages))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(embedding_vectors(table(spark, sf_dir, "embeddings"), label), F.col("vec_id") % 100 == 0)


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_simhash": op2_simhash,
    "op3_media": op3_media,
    "op4_packing": op4_packing,
    "op5_fingerprints": op5_fingerprints,
    "op6_language": op6_language,
    "op7_lm": op7_lm,
    "op8_url_filter": op8_url_filter,
    "op9_toxicity": op9_toxicity,
    "op10_mixing": op10_mixing,
    "op11_extraction": op11_extraction,
    "op12_negatives": op12_negatives,
    "op13_trie": op13_trie,
    "instruction_packing": instruction_packing,
}
