"""The registered queries of these operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from newsgrist.functions.lineage import scratch_path
from newsgrist.llm.bpe import encode_documents
from newsgrist.llm.common import table
from newsgrist.llm.decontam import find_leaks
from newsgrist.llm.exactdedup import exact_duplicates
from newsgrist.llm.filteraudit import audit_filters
from newsgrist.llm.html import extract_text
from newsgrist.llm.minhash import near_duplicates
from newsgrist.llm.orchard import compress_vectors
from newsgrist.llm.pseudonyms import pseudonymise
from newsgrist.llm.quality import score_quality
from newsgrist.llm.sharding import assign_shards
from newsgrist.llm.suffixes import remove_repeats
from newsgrist.llm.urlfilter import filter_captures, host_of, path_of
from newsgrist.llm.warc import archive_index, read_records, write_archives


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Text of a public vocabulary file; every driver has the package."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return archive_index(read_records(spark, path)).drop("url")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# Stands for a secret that a deployment passes in.
PSEUDONYM_KEY = "registered-query-key"


def op3_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pseudonymise(table(spark, sf_dir, "documents"), PSEUDONYM_KEY)
    return found.select("doc_id", "text", F.size("found").cast("bigint").alias("n_values"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"))


def list_entries(pages: DataFrame, events: DataFrame) -> DataFrame:
    """A dated list from two tables: an event is an entry for the page its user stands for,
    on the list of its type; even events put on, odd ones take off. By turns a key is the
    host, the domain above it, or the host with the first part of the path."""
    host, part = host_of(F.col("url")), F.split(path_of(F.col("url")), "/")[1]
    above = F.regexp_replace(host, r"^[^.]+[.](?=[^.]+[.][^.]+[.])", "")
    key = F.when(F.col("event_id") % 3 == 0, host).when(F.col("event_id") % 3 == 1, above).otherwise(F.concat_ws("/", host, part))
    named = events.select(F.col("event_type").alias("list"), F.col("ts").cast("timestamp").alias("at"), "event_id", F.col("user_id").alias("page_id"))
    return named.join(pages.select("page_id", "url"), "page_id").select("list", key.alias("key"), "at", (F.col("event_id") % 2 == 0).alias("listed"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a capture, one each minute from 2024-01-01 on, round the 30 days of the
    events."""
    pages, events = table(spark, sf_dir, "pages"), table(spark, sf_dir, "events")
    start = F.unix_seconds(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    fetched = F.timestamp_seconds(start + (F.col("page_id") * 997 % 43200) * 60)
    captures = pages.select(F.col("page_id").alias("capture_id"), "url", fetched.alias("fetched_at"))
    found = filter_captures(captures, list_entries(pages, events))
    return found.select(
        F.col("capture_id").alias("page_id"), "url", F.unix_seconds("fetched_at").alias("fetched_at"), "blocked", "n_lists",
        F.array_join("lists", ",").alias("lists"), F.array_join("keys", ",").alias("keys"),
    )


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(spark, table(spark, sf_dir, "documents"), vocabulary(), with_ids=False)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_vectors(table(spark, sf_dir, "embeddings"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), keep_text=False).drop("removed", "kept")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_quality": op2_quality,
    "op3_pseudonyms": op3_pseudonyms,
    "op4_sharding": op4_sharding,
    "op5_url_filter": op5_url_filter,
    "op6_decontamination": op6_decontamination,
    "op7_bpe": op7_bpe,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_near_dedup": op9_near_dedup,
    "op10_html": op10_html,
    "op11_vector_codes": op11_vector_codes,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_filter_audit": op13_filter_audit,
}
