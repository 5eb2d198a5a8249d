"""A corpus from raw documents to packed training sequences: language, lines, near copies, repeated passages, packing.

Each stage takes what its predecessor kept and returns the columns of ``documents``; the last returns the packed
pieces.  Between the stages the documents are a written table in the shared folder, so a lost executor never costs
more than the stage at work.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.llm import language, line_dedup, near_dup, packing, suffix_dedup
from driftloom.llm.queries import SEQUENCE
from driftloom.sources.stage import drop, stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(rows: DataFrame, text: str) -> DataFrame:
    """The columns of ``documents`` again, with the new text and its length."""
    n_chars = F.char_length(text).cast("long")
    return rows.select("doc_id", F.col(text).alias("text"), "carry.lang", "carry.source", n_chars.alias("n_chars"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that are far from every language, or have no letter."""
    rows = language.identify(docs, language.fit(docs), carry=COLUMNS)
    return rows.where(~F.col("rejected")).select("carry.*")


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops recurring lines; a document that loses all its lines goes."""
    rows = line_dedup.drop_lines(docs, carry=("lang", "source"))
    return _documents(rows.where((F.col("n_dropped") == 0) | (F.col("n_dropped") < F.col("n_lines"))), "text")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of near copies (five words, similarity 0.8); repeated rows go.

    Each distinct pair of doc_id and text is a document of its own.  They are ordered by doc_id, those without one
    last, then by the digest of the text; of rows that differ in the other columns alone, the least one stays.
    """
    pair = ["no_id", "id", "digest"]  # never null, so that the texts are dealt out once for the groups and the join
    none = F.lit(0).cast(docs.schema["doc_id"].dataType)
    digest = F.coalesce(F.sha2("text", 256), F.lit("")).alias("digest")
    rows = docs.select(*COLUMNS, F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", none).alias("id"), digest)
    least = rows.groupBy(pair).agg(F.min(F.struct("lang", "source", "n_chars")).alias("rest"), F.first("text").alias("text"))
    own = rows.select(pair).distinct().orderBy(pair).withColumn("key", F.monotonically_increasing_id())
    own = stage(own, "pipeline-near-keys")
    keyed = stage(least.join(own, pair).select("key", "text"), "pipeline-near-rows")
    found = near_dup.near_duplicates(keyed, width=5, percent=80, id_col="key")
    kept = own.join(found.where("kept").select(F.col("doc_id").alias("key")), "key", "left_semi")
    kept = stage(kept.select(pair), "pipeline-near-kept")
    drop(own, keyed, found)
    return least.join(kept, pair).select(F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), "text", "rest.*")


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes the characters of passages that an earlier document has; a document with nothing left goes."""
    rows = suffix_dedup.remove_repeats(docs, characters=True, carry=("lang", "source"))
    left = rows.where((F.octet_length("kept") > 0) | (F.col("n_bytes") == 0))
    return _documents(left.withColumn("left", F.decode("kept", "utf-8")), "left")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences."""
    pieces = packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), SEQUENCE)
    return packing.pack(pieces, SEQUENCE)


STAGES = [
    ("language", identify_language),
    ("lines", drop_recurring_lines),
    ("near_copies", drop_near_copies),
    ("passages", drop_repeated_passages),
    ("packing", pack_sequences),
]

#: SQL cannot state hashed registers, suffix sorting or tokenisation; tests/llm compares the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; what the next one has read goes."""
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, work in STAGES:
        docs = stage(work(spark, docs, sf_dir), f"pipeline-{name}")
        drop(*written)
        written = [docs]
    return docs
