"""Queries of the incremental operator."""

from pyspark.sql import DataFrame, SparkSession

from weftmill.operators.incremental import changed_by_run
from weftmill.shared import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return changed_by_run(spark, table(spark, d, "fetch_results"), table(spark, d, "seeds"), table(spark, d, "crawl_runs"))


QUERIES = {"p3_found": p3_found}
