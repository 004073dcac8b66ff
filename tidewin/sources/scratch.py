"""Where jobs keep what they read again."""
from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, or the one set in the context.

    Where neither is set, a temporary one if the master is local (one machine: tests), else an error: executors and
    the driver of a cluster share no temporary folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not known.isDefined():
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidewin-"))
            known = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = known.get()
    return path.rstrip("/")


def _remove(jvm, conf, root: str) -> None:
    """Deletes an application's folder when its driver ends; if the JVM has gone before, the folder stays."""
    try:
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(conf).delete(path, True)
    except Exception:  # the interpreter is ending; nothing depends on it
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below ``<shared folder>/tidewin-<application>/``, which goes when the driver's Python ends."""
    sc = spark.sparkContext
    root = f"{shared_dir(spark)}/tidewin-{sc.applicationId}"
    if root not in _ROOTS:
        _ROOTS.add(root)
        atexit.register(_remove, sc._jvm, sc._jsc.hadoopConfiguration(), root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet below the shared folder and read again.

    It cuts the lineage as a reliable checkpoint does: the files outlive any executor.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
