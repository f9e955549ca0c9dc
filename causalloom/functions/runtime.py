"""What operators share at run time: the package on Python workers, the cluster's shared folder, lineage cuts."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import weakref
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_roots: dict[str, str] = {}
_written: dict[int, tuple[weakref.ref, str]] = {}


def visible(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, where they see that folder."""
    home, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if home not in known:
        env["PYTHONPATH"] = os.pathsep.join([home, *filter(None, known)])


def _forget(spark: SparkSession, root: str) -> None:
    try:
        jvm, jsc = spark._jvm, spark._jsc
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session is already gone; the folder's owner cleans it up
        pass


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder that the driver and all executors see.

    It lies in the folder that the session names in spark.checkpoint.dir. Only a
    local-mode session may leave that unset; it then gets a temporary folder.
    """
    sc = spark.sparkContext
    root = _roots.get(sc.applicationId)
    if root is None:
        base = sc.getConf().get("spark.checkpoint.dir")
        if not base:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="causalloom-")
        root = _roots[sc.applicationId] = f"{base.rstrip('/')}/causalloom-{sc.applicationId}"
        atexit.register(_forget, spark, root)
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def release(spark: SparkSession) -> None:
    """Delete the tables that this application has written to the shared folder so far; results that read them end with it."""
    root = _roots.pop(spark.sparkContext.applicationId, None)
    if root is not None:
        _forget(spark, root)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df as Parquet in the shared folder and read it back.

    Unlike cached blocks, the written table outlives any executor.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[id(out)] = (weakref.ref(out), path)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize() returned, once all that was made of them is written; nothing may read them any more."""
    for df in tables:
        ref, path = _written.pop(id(df), (None, None))
        if path is not None and ref() is df:
            _forget(df.sparkSession, path)
