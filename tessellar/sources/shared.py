"""The folder that all executors share, and lineage cuts in it."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Shuffle files of a finished write serve nobody: its rows are in the table.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """From spark.checkpoint.dir. Where the session names none, a local master (as in tests) gets a temporary folder;
    on a cluster that is an error, for executors would not see the driver's folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not (spark.sparkContext.master + "[").startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="tessellar-shared-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def importable(spark: SparkSession) -> None:
    """Lets Python workers that share the driver's disk import this package, whatever folder the driver started in.
    On a cluster it is installed or sent along with spark.submit.pyFiles."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if root not in known:
        env["PYTHONPATH"] = ":".join([root, *known])


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> None:
    """Write df as Parquet; its shuffle files go as soon as the table stands."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            conf.unset(CLEANUP)
        else:
            conf.set(CLEANUP, before)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: ends its lineage, survives lost executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    written(df, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that cut() wrote, once nothing will read them again."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.table_path)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
