"""Spark session defaults and the shared scratch space used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_CHECKPOINT_KEY = "spark.checkpoint.dir"
_local_scratch: dict[str, str] = {}
_written: dict[str, list[str]] = {}


def build_session(app_name: str = "riskgrain", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the library is written for.

    ``conf`` keys use ``__`` for dots.  Nothing here is required: every operator
    also runs on a session built elsewhere.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A local session without the setting gets a temporary folder.  On a cluster
    the setting is required, because a machine-local folder would be lost with
    its machine.
    """
    configured = spark.conf.get(_CHECKPOINT_KEY, None)
    if configured:
        return configured.rstrip("/")
    if not is_local(spark):
        raise RuntimeError(f"set {_CHECKPOINT_KEY} to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="riskgrain-")
    return _local_scratch[app]


def scratch_path(spark: SparkSession, stem: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_dir(spark)}/riskgrain/{stem}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialise(df: DataFrame, stem: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Later jobs start from the written table, so a lost executor costs a re-read
    and not a recomputation, and non-deterministic inputs are fixed.
    """
    spark = df.sparkSession
    path = scratch_path(spark, stem)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def literal(spark: SparkSession, rows: Sequence[Sequence], schema: StructType | str) -> DataFrame:
    """A few driver rows as a literal relation, whose size the optimiser knows."""
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    data = [dict(zip(kind.names, r)) for r in rows]
    return spark.createDataFrame(pa.Table.from_pylist(data, schema=to_arrow_schema(kind)), schema=kind)


def pin(df: DataFrame, max_rows: int, stem: str = "small", limit: int = 20_000) -> DataFrame:
    """Fix the rows of a table whose size is bounded by ``max_rows``.

    Up to ``limit`` rows travel as a literal relation; anything larger is
    materialised in the shared folder.
    """
    if max_rows <= limit:
        return literal(df.sparkSession, df.collect(), df.schema)
    return materialise(df, stem)


def delete(spark: SparkSession, paths: Sequence[str]) -> None:
    """Delete files or folders; those that are gone already are passed over."""
    jvm = spark.sparkContext._jvm
    hadoop_conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(hadoop_conf).delete(target, True)


def release(spark: SparkSession) -> int:
    """Delete the scratch tables written by this application."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    delete(spark, paths)
    return len(paths)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))
