"""A corpus pipeline over documents: judge quality, drop near copies, cut repeats, mask secrets, pack.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last keep the columns of documents, whatever others are there.  In every
stage a null text counts as empty and stays null, rows with a null doc_id are
compared with nothing, rows that repeat are one document to the stages that
look for copies and are packed each for itself, a text of any length is taken
whole, and an empty table gives an empty result.
"""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import cotrain, jaccard, packing, pfp, secrets
from millrace.llm._common import fresh, prepare, read


def _begin(spark: SparkSession) -> None:
    """Before a stage: what earlier ones no longer need goes.

    Spark removes broadcasts from executors and checkpoints from the shared
    folder once the driver's garbage collector finds that nothing uses them,
    which on an idle driver may take half an hour.
    """
    prepare(spark)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _names(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{n}`") for n in docs.columns]


def _with_text(docs: DataFrame, text) -> DataFrame:
    """docs with another text, and n_chars, where it is there, its length in characters."""
    docs = docs.withColumn("text", text)
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def judge_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier holds good."""
    _begin(spark)
    return cotrain.keep_good(docs, read(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of every group of near copies (five words, similarity of 0.8)."""
    _begin(spark)
    return jaccard.keep_first(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that repeat 50-byte strings of smaller documents.

    A character of which bytes were cut goes as a whole, and so do documents
    of which nothing but white space is left.
    """
    _begin(spark)
    spans, kept = fresh("spans", docs.columns), fresh("kept", docs.columns)
    cut = pfp.without_repeats(docs, window=50, spans_column=spans, kept_column=kept, whole_characters=True)
    touched, text = F.size(spans) > 0, F.col(kept).cast("string")
    left = cut.where(~(touched & (F.length(F.trim(text)) == 0)))
    return _with_text(left, F.when(touched, text).otherwise(F.col("text"))).select(_names(docs))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with secrets replaced by a mark."""
    _begin(spark)
    return _with_text(secrets.redact(docs), F.col("text")).select(_names(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths, each a sequence: ids as little-endian 32-bit integers."""
    import public_tokenizers

    _begin(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, most=4096, memo=50_000, batch_bytes=3 << 18)


STAGES = [
    ("quality classifier", judge_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("secret scans", mask_secrets),
    ("packing", pack_sequences),
]

#: SQL can express neither the classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; what each returns is stored in the shared folder before the next begins."""
    prepare(spark)
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = docs.checkpoint()
    return docs
