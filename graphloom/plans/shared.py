"""Tables in the folder that driver and executors share: where iterative plans end their lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where that is unset and all runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="graphloom-")
    return _OWN[app]


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _clean() -> None:
    for spark, path in _WRITTEN:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone at exit; the folder is scratch
            return


atexit.register(_clean)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder; what is written there goes when Python exits."""
    path = f"{shared_dir(spark)}/graphloom/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` written as Parquet and read back: lineage ends here and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_and_free(df: DataFrame, name: str = "step") -> DataFrame:
    """As ``cut``, and what its exchanges left on executors' disks goes when it is written, not with some later collection."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = conf.get(key, None)
    conf.set(key, "true")
    try:
        return cut(df, name)
    finally:
        conf.unset(key) if was is None else conf.set(key, was)


def only(made: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``made`` returns as a table (``cut``); all tables that were written on the way to it are gone."""
    first = len(_WRITTEN)
    out = cut(made(), name)
    for spark, path in _WRITTEN[first:-1]:
        _delete(spark, path)
    del _WRITTEN[first:-1]
    return out
