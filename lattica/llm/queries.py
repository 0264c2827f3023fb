"""The registered queries of this package: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm import warc

    return warc.as_digest(warc.archived(table(spark, sf_dir, "pages")))


TOKENIZER = "byte_bpe_50k.json"


def op2_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lattica.llm import packing

    return packing.as_digest(packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER)))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list holds the urls of pages whose article has nothing below its heading."""
    from pyspark.sql import functions as F

    from lattica.llm import urlfilter

    pages = table(spark, sf_dir, "pages")
    return urlfilter.url_filter(pages, pages.where(F.contains("html", F.lit("<br></article>"))).select("url")).drop("possible")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm import substring

    return substring.as_digest(substring.substring_dedup(table(spark, sf_dir, "documents")))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm import jaccard

    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op6_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm import lm

    return lm.lm_scores(table(spark, sf_dir, "documents"))


def _segmented(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Four segmentations of every text: how many ids, their hash and that of what they decode to."""
    import public_tokenizers
    from pyspark.sql import functions as F

    from lattica.llm import segment

    path = public_tokenizers.path("piece_bpe_32k.model")
    found = segment.decoded(segment.sample_segmentations(rows, keys, path), path)
    ids = (F.octet_length("ids") / 4).cast("int").alias("n_ids"), F.crc32("ids").alias("ids_crc32")
    return found.select(*keys, "sample", *ids, "log_prob", "perturbed", "inclusion", F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_gumbel_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segmentations of every document."""
    return _segmented(table(spark, sf_dir, "documents"), ["doc_id"])


def op7_gumbel_top_k_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segmentations of every turn of the conversations."""
    return _segmented(table(spark, sf_dir, "conversations"), ["conv_id", "turn"])


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm import licenses

    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from lattica.llm import topk

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", topk.whole("embedding").alias("v"))
    return topk.top_k(vectors, F.col("vec_id") % 20 == 0)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm import quality

    return quality.as_digest(quality.quality_rules(table(spark, sf_dir, "documents")))


def op11_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lattica.llm import bpe

    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.as_digest(bpe.decoded(bpe.encoded(table(spark, sf_dir, "documents"), ["doc_id"], path), ["doc_id", "n_tokens", "ids"], path))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm import trie

    return trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm import audit

    return audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}
