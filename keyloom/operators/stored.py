"""Tables in the folder that driver and executors share: ``spark.checkpoint.dir``."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session.

    Where ``spark.checkpoint.dir`` is unset, a local master gets a temporary
    folder of its own and a cluster uses a folder beside its warehouse.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base and sc._jsc.getCheckpointDir().isPresent():
        base = sc._jsc.getCheckpointDir().get()
    if not base:
        if sc.master.startswith("local[") or sc.master == "local":
            base = "file://" + tempfile.mkdtemp(prefix="keyloom-")
        else:
            base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_keyloom"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/keyloom-{uuid.uuid4().hex[:12]}-{tag}"
    if not _own:
        atexit.register(_clean, spark)
    _own.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _clean(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the context may have ended already
        for path in _own.pop(spark.sparkContext.applicationId, []):
            _delete(spark, path)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage, survives lost executors, and leaves joins on the
    result free to insert exchanges that adaptive execution can split. What a
    row says of its partition is the same for every later reader.
    """
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._written_to = path
    return found


def release(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialize` that nothing reads any more."""
    for t in tables:
        path, own = t._written_to, _own.get(t.sparkSession.sparkContext.applicationId, [])
        if path in own:
            own.remove(path)
            _delete(t.sparkSession, path)
