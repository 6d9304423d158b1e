"""The queries of this subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from webstrata.llm.common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from webstrata.llm.license_scan import license_scan

    return license_scan(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from webstrata.llm.secret_scan import secret_scan

    return secret_scan(table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from webstrata.llm.url_filter import url_filter

    return url_filter(table(spark, sf_dir, "pages"))


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from webstrata.llm.topk_search import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from webstrata.llm.quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from webstrata.llm.jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), words=4, percent=85)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from webstrata.llm.line_dedup import line_dedup

    return line_dedup(table(spark, sf_dir, "documents"), digest=True)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from webstrata.llm.quality_classifier import quality_classifier

    return quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from webstrata.llm.sentencepieces import encode_pieces

    return encode_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from webstrata.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_license_scan, op2_secret_scan, op3_url_filter, op4_topk_search, op5_quality_rules, op6_jaccard_join, op7_line_dedup, op8_quality_classifier, op9_sentencepieces, op10_packing)}


def oracle_sql() -> dict[str, str]:
    from webstrata.llm import line_dedup, topk_search

    return {"op4_topk_search": topk_search.SQL, "op7_line_dedup": line_dedup.SQL}
