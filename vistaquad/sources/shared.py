"""Tables between the steps of a job, in the folder that all executors share."""

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. Where it is unset, a temporary one in local mode,
    in which one process holds driver and executors (tests); an error on a cluster, whose machines see different folders."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not hasattr(shared_dir, "own"):
        shared_dir.own = tempfile.mkdtemp(prefix="vistaquad-")
    return shared_dir.own


def settle(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df as a table in the shared folder and read it: lineage ends here, and a lost executor loses nothing.

    The tables lie in <shared folder>/vistaquad and can be deleted once the results that were read from them are written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/vistaquad/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
