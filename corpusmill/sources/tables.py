"""Reading tables of parquet files, spreading their rows, and writing what is to be read again."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: A scan of at least this many bytes a core is left as it is.
BYTES_PER_CORE = 8 << 20
#: What may stand between a scan and `spread`: nothing that moves rows, so rows lie as in the files.
_IN_PLACE = frozenset(("Project", "Filter", "Union", "LogicalRelation", "SubqueryAlias", "LocalRelation"))


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _nodes(plan):
    yield plan
    children = plan.children()
    for i in range(children.size()):
        yield from _nodes(children.apply(i))


def spread(df: DataFrame) -> DataFrame:
    """Rows of a small scan over twice as many partitions as there are cores: a table of one file and row group is one task otherwise.

    Decided from the sizes of the files alone, without a job.  Scans of BYTES_PER_CORE bytes a core or more, as of any large table, and
    plans that move rows already stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    nodes = list(_nodes(df._jdf.queryExecution().analyzed()))
    if any(n.nodeName() not in _IN_PLACE for n in nodes):
        return df
    size = sum(int(n.stats().sizeInBytes()) for n in nodes if n.children().isEmpty())
    return df.repartition(2 * cores) if size < cores * BYTES_PER_CORE else df


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in spark.checkpoint.dir.

    Only a session whose executors are threads of the driver (master local) may do without one and gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), f"corpusmill-{os.getuid()}")


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """The rows written once to the shared folder and read again: cuts the lineage and survives the loss of executors.

    With `by` there is a folder for each of its values.  The files are deleted when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    writer = df.write.partitionBy(by) if by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
