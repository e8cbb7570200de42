"""Session helpers: where intermediate tables may be written, and table access."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``.

    Where the setting is absent the session must be local (tests): a temporary
    folder is made once and remembered on the context. On a cluster without the
    setting a machine-local folder would lose data, so that is refused.
    """
    sc = spark.sparkContext
    conf = spark.conf.get(CHECKPOINT_KEY, None) or sc.getConf().get(CHECKPOINT_KEY)
    if conf:
        return conf.rstrip("/")
    folder = getattr(sc, "_tmloom_folder", None)
    if folder is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder shared by all executors")
        folder = "file://" + tempfile.mkdtemp(prefix="tmloom-")
        sc._tmloom_folder = folder
    return folder


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, cutting its lineage.

    Unlike a cache this survives the loss of any executor, and every later
    reader sees the very same rows.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
