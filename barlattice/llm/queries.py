"""Queries over the driver's tables: each applies one operator to a whole table."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_repair, decontaminate, html_extract, jaccard_join, lm_scoring, packing, pii, quality, spelling, toxicity, url_filter, vector_dedup, warc
from .common import load

#: The host rules of the URL query.
HOST_RULES = [
    url_filter.Rule("block", "com", "/en/"),
    url_filter.Rule("allow", "example.com", "/en/7"),
    url_filter.Rule("allow", "net", "/de/"),
    url_filter.Rule("block", "example.net", "/de/8"),
    url_filter.Rule("block", "org", "/es/"),
]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_overlap(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"), n=10)
    return found.select(
        "doc_id",
        "n_words",
        decontaminate.n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"),
    )


def held_out(key: str = "doc_id"):
    """The fifth of the rows that is never learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def learn_toxicity(docs: DataFrame, labels: DataFrame) -> toxicity.Lexicon:
    return toxicity.learn(docs, labels.where(~held_out()))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    scored = toxicity.score(docs, learn_toxicity(docs, load(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(load(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def digest_ids(batch: pa.RecordBatch) -> pa.RecordBatch:
    """``ids`` of each piece exchanged for its ids_crc32."""
    place = batch.schema.names.index("ids")
    lists = batch.column(place)
    values, at = np.asarray(lists.values).astype("<u4"), np.asarray(lists.offsets)
    columns, names = [*batch.columns], list(batch.schema.names)
    columns[place], names[place] = pa.array([zlib.crc32(values[a:b].tobytes()) for a, b in zip(at[:-1], at[1:])], pa.int64()), "ids_crc32"
    return pa.RecordBatch.from_arrays(columns, names=names)


def pack_documents(docs: DataFrame) -> DataFrame:
    """Packed pieces with a digest of their ids."""
    return packing.pack(
        docs, public_tokenizers.path("byte_bpe_50k.json"), ranks=public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN,
        finish=digest_ids, schema=packing.SCHEMA.replace("ids array<int>", "ids_crc32 long"),
    )


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(load(spark, sf_dir, "documents"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(load(spark, sf_dir, "documents"))


def good_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the documents that are labelled as good."""
    return load(spark, sf_dir, "labels").where("quality = 1").select("doc_id")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(load(spark, sf_dir, "documents"), good_documents(spark, sf_dir))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(load(spark, sf_dir, "documents"))
    counts = [F.size(f"pii_{k}").cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.listing(*pii.KINDS), 256).alias("base_sha256"), pii.listing(*pii.KINDS, "id").alias("spans"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(load(spark, sf_dir, "documents"), good_documents(spark, sf_dir))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.dedup(load(spark, sf_dir, "embeddings"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(load(spark, sf_dir, "pages"), [*HOST_RULES, *url_filter.PATTERNS])


def misspelled(doc_id: int | None) -> Callable[[str], str]:
    """How runs of a document are changed: of those whose crc32 with its key is a
    multiple of 97 one code point goes."""
    head = zlib.crc32(f"{' ' if doc_id is None else doc_id}:".encode())

    def change(run: str) -> str:
        h = zlib.crc32(run.encode(), head)
        at = h % len(run)
        return run if h % 97 else run[:at] + run[at + 1 :]

    return change


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.vocabulary(load(spark, sf_dir, "documents"), rewrite=misspelled)
    return spelling.variants(words).select("word", "form", "root", "n", "n_near", "form_n")


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` with a fifth of the rows dropped, emptied, stripped of full stops,
    repeated or given to the user, by the crc32 of conversation and turn. Dropped
    rows stay as the names of their conversations (``present`` is false)."""
    space = F.lit(" ")
    named = [F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")]
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    kind = F.col("kind")
    dealt = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(F.concat(named[0], F.lit(":"), named[1])) % 20).alias("kind"))
    return dealt.select(
        "conv_id", "turn",
        F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(kind <= 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (kind != 0).alias("present"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(damaged(load(spark, sf_dir, "conversations")))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.read(spark, warc.write(load(spark, sf_dir, "pages")), payload=False)
    return found.select(warc.page_of("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_of("refers_to").cast("long").alias("refers_to"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_toxicity": op2_toxicity,
    "op3_html_extraction": op3_html_extraction,
    "op4_packing": op4_packing,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_pii": op7_pii,
    "op8_quality": op8_quality,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_url_filters": op10_url_filters,
    "op11_spelling": op11_spelling,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_warc": op13_warc,
}
