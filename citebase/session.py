"""Session and table access shared by every operator."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: The folder that holds this package.
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def session(name: str = "citebase", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("CITEBASE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def importable_by_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from its folder, whatever folder the driver was started in."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder. Only Parquet footers are read here; columns and filters are pushed down by the planner."""
    importable_by_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder of ``spark.checkpoint.dir``.

    A folder of our own is set only where the session names none and runs on one machine (tests); on a cluster a folder
    of one machine would lose data with it, so a missing setting is an error there.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="citebase-"))
    return df.checkpoint(eager=True)


#: Rows up to which a small table is taken to the driver and broadcast; a longer one is joined as the planner sees fit.
SMALL = 20_000


def small(df: DataFrame, bound: int = SMALL) -> DataFrame:
    """A table made once, to be joined several times: broadcast if it is checked to have at most ``bound`` rows.

    A longer one is checkpointed and joined without a hint, with the same rows.
    """
    rows = df.limit(bound + 1).collect()
    if len(rows) > bound:
        return checkpointed(df)
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))
