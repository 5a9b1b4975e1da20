"""Tables derived from others, written once and read by every query of a session."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kestrelgrid.operators.components import shared_folder

#: A table's shuffle files go when it is written; else they stay beside those of the next until the driver happens to collect its garbage.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _state_of(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of the files of a table; another state makes another derived table."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    found, files = [], system.listFiles(place, True)
    while files.hasNext():
        f = files.next()
        found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return "\n".join(sorted(found))


def written(df: DataFrame) -> DataFrame:
    """df as a parquet table of its own in the session's shared folder: lineage is cut, and readers take the columns they need."""
    at = f"{shared_folder(df.sparkSession)}/written/{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.parquet(at)


def derived(spark: SparkSession, sf_dir: str, source: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``make`` builds of ``source``, as parquet in the session's shared folder, so that later plans read only the columns and rows they need.

    It is made again where the source's files have changed, and never kept beyond the session's checkpoint folder.
    """
    key = hashlib.sha1(f"{name} {_state_of(spark, f'{sf_dir}/{source}.parquet')}".encode()).hexdigest()[:16]
    at = f"{shared_folder(spark)}/derived/{name}-{key}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        kept = spark.conf.get(DROP_SHUFFLES, "false")
        spark.conf.set(DROP_SHUFFLES, "true")
        try:
            make().write.mode("overwrite").parquet(at)
        finally:
            spark.conf.set(DROP_SHUFFLES, kept)
    return spark.read.parquet(at)
