"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, cotrain, edits, jaccard, manifest, oracle, packing, pfp, recompress, repair, rules, secrets, shards, topk
from ._common import read


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_cotrained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrain.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = _vocabulary("byte_bpe_multi_50k.tiktoken")
    coded = bpe.decode(bpe.encode(read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN), path)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("data", 256).alias("decoded_sha256"),
    )


def op3_histogram_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20, scale=64)


def op4_edit_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = _vocabulary("byte_bpe_50k.tiktoken")
    docs = edits.revised(read(spark, sf_dir, "documents").select("doc_id", "text"))  # no leaves yet: they are counted, then edited, in one pass
    after = edits.edit(docs, path, public_tokenizers.PATTERN)
    leaves = F.sha2(F.array_join(F.col("piece_tokens").cast("array<string>"), ",").cast("binary"), 256)
    return after.select("doc_id", *edits.COUNTED, leaves.alias("leaves_sha256"))


def op5_monotone_tree_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_randomness_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["order"] < 4)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(secrets.listed(base).cast("binary"), 256).alias("base_sha256"),
        secrets.listed(F.col("spans")).alias("spans"),
    )


def base_of_op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op5 that SQL can express."""
    return op5_monotone_tree_rules(spark, sf_dir).drop("kept")


def base_of_op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op6 that SQL can express."""
    return op6_randomness_secrets(spark, sf_dir).drop("spans")


def op7_multi_order_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    membership, _ = jaccard.jaccard_join(read(spark, sf_dir, "documents"), k=5, percent=80)
    return membership.select("doc_id", "n_shingles", "component_id")


def op8_prefix_free_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = pfp.without_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"), window=50)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return cut.select(
        "doc_id",
        size.alias("n_bytes"),
        (size - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op9_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign(read(spark, sf_dir, "documents"), shards=40)


def op10_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(read(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), end_id=2, most=4096)
    # the checksum stands for the ids before rows move, so that ids aren't shuffled
    cut = cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids", "piece_no")
    return packing.place(cut).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    docs = read(spark, sf_dir, "documents").select(*fields)
    touched = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    chars = F.col("n_chars").cast("decimal(20,0)") + F.when(touched, 1).otherwise(0)
    tampered = manifest.digest_of([chars if f == "n_chars" else F.col(f) for f in fields])
    found = manifest.manifest(docs, fields, carry={"tampered": tampered}).withColumn("folded_root", manifest.fold(F.col("tampered"), F.col("proof")))
    return found.select("doc_id", "leaf", "subroot", "root", manifest.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = recompress.without_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"), window=20)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return cut.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op13_subsequence_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = repair.damaged(said)
    found = repair.summary(repair.repair(turns)).join(repair.gaps(turns), "conv")
    every = said.select("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("conv")).distinct()
    number = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return every.join(found, "conv", "left").select(
        "conv_id", *(number(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256")
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_cotrained_quality, op2_byte_bpe, op3_histogram_top_k, op4_edit_token_counts, op5_monotone_tree_rules, op6_randomness_secrets, op7_multi_order_jaccard, op8_prefix_free_dedup, op9_hash_tree_shards, op10_binary_packing, op11_merkle_manifest, op12_recompression_dedup, op13_subsequence_repair, base_of_op5, base_of_op6)}


def oracle_sql() -> dict[str, str]:
    return dict(oracle.QUERIES)
