"""The registered queries of the corpus operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import brown_lm, exact_dedup, language_id, mixing, pieces, quality_rules, secret_scan, simhash, url_filters, weak_labels


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(fn: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: fn(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": documents(quality_rules.op1_rows),
        "op2_exact_dedup": documents(exact_dedup.op2_rows),
        "op3_language_id": documents(language_id.op3_rows),
        "op4_simhash": documents(simhash.op4_rows),
        "op5_sentencepiece": documents(pieces.op5_rows),
        "op6_url_filters": lambda spark, sf_dir: url_filters.op6_rows(table(spark, sf_dir, "pages")),
        "op7_quality_classifier": documents(weak_labels.op7_rows),
        "op8_secret_scan": documents(secret_scan.op8_rows),
        "op9_mixing": documents(mixing.op9_rows),
        "op10_brown_lm": documents(brown_lm.op10_rows),
        "quality_rule_ablations": documents(lambda d: quality_rules.ablations(quality_rules.ledger(d), quality_rules.POLICIES["v2"])),
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": quality_rules.OP1_SQL, "op2_exact_dedup": exact_dedup.OP2_SQL, "op6_url_filters": url_filters.OP6_SQL, "op9_mixing": mixing.OP9_SQL, "quality_rule_ablations": quality_rules.ABLATION_SQL}
