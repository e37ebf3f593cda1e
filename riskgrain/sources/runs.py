"""Run log, versioned results and stored models."""

from __future__ import annotations

from pyspark.ml import Model, PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..operators.enrich import stored_results
from ..session import literal

# One log row per run: fixed column names.
RUN_LOG = (
    "train_size bigint, classifier string, auc_train double, auc_val double, auc_test double, "
    "ks_train double, ks_val double, ks_test double, acc_train double, acc_val double, acc_test double, "
    "time_spent string, result_path string, params_path string, config_path string, remark string"
)


def clock(seconds: float) -> str:
    minutes, rest = divmod(seconds, 60)
    return f"{int(minutes)}:{int(rest)}"


def append_run(spark: SparkSession, path: str, **fields) -> None:
    """Append one row to the run log; fields not given stay null."""
    schema = StructType.fromDDL(RUN_LOG)
    unknown = set(fields) - set(schema.names)
    if unknown:
        raise ValueError(f"unknown log fields {sorted(unknown)}")
    row = tuple(fields.get(n) for n in schema.names)
    literal(spark, [row], schema).write.mode("append").parquet(path)


def next_run_id(spark: SparkSession, path: str, classifier: str) -> str:
    """``name`` for a classifier's first run in a result table, then ``name1``, ``name2``, ..."""
    stored = stored_results(spark, path)
    if stored is None:
        return classifier
    pattern = f"^{classifier}[0-9]*$"
    used = {r[0] for r in stored.select(F.col("run_id").cast("string")).where(F.col("run_id").rlike(pattern)).distinct().collect()}
    if classifier not in used:
        return classifier
    number = 1
    while f"{classifier}{number}" in used:
        number += 1
    return f"{classifier}{number}"


def save_results(df: DataFrame, path: str, classifier: str) -> str:
    """Append results as a new version: a partition of the result table."""
    run_id = next_run_id(df.sparkSession, path, classifier)
    df.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)
    return run_id


def save_model(model: Model, path: str) -> None:
    pipeline = model if isinstance(model, PipelineModel) else PipelineModel([model])
    pipeline.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
