"""Problem 6: passages of evaluation items in the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kestrelgrid.llm.leaks import find_leaks
from kestrelgrid.llm.page_layout import fit_on_sample
from kestrelgrid.sources.tables import table


def p6_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return find_leaks(documents, table(spark, sf_dir, "eval_items"), kinds=fit_on_sample(documents))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_leaks(spark, sf_dir).select("doc_id", "item_id")


# no SQL: fuzzy reading through layout; the tests hold it against a comparison of every document with every item
SQL: dict[str, str] = {}
QUERIES = {"p6_found": p6_found, "p6_leaks": p6_leaks}
