"""Problem 7: documents of several sources combined to target shares of tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kestrelgrid.llm.mixing import fit_classifier, mix_sources
from kestrelgrid.sources.tables import table


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_sources(documents, table(spark, sf_dir, "mix_targets"), fit_classifier(documents))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents taken in each mix and how often."""
    return _mixed(spark, sf_dir)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of each source in each mix."""
    return _mixed(spark, sf_dir)[1]


# no SQL: tokens are beyond it; the tests hold the shares and the repeats against the targets
SQL: dict[str, str] = {}
QUERIES = {"p7_mix": p7_mix, "p7_shares": p7_shares}
