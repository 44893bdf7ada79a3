"""Writers: appended logs, dated portfolio snapshots and fitted models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.numeric import finite


def _finite_inside(c: Column, kind: T.DataType) -> Column:
    """``c`` with NaN and infinities as NULL at any depth; map keys stay."""
    if isinstance(kind, T.DoubleType | T.FloatType):
        return finite(c)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda v: _finite_inside(v, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: _finite_inside(v, kind.valueType))
    if isinstance(kind, T.StructType):
        fields = [_finite_inside(c.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]
        return F.when(c.isNotNull(), F.struct(*fields))
    return c


def sanitise(df: DataFrame) -> DataFrame:
    """NaN and infinities become NULL wherever they stand, in nested values too."""
    return df.select(*[_finite_inside(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def append_agent_log(entries: DataFrame, path: str) -> None:
    """Append entries under ``run_date=...``; nothing already written is read back."""
    sanitise(entries).write.mode("append").partitionBy("run_date").json(path)


def write_portfolio_state(positions: DataFrame, account: DataFrame, path: str, run_date: str) -> None:
    """Overwrite the snapshot of one run date: the positions, and the account (equity, starting_equity, last_update)."""
    root = path.rstrip("/")
    positions.write.mode("overwrite").parquet(f"{root}/positions/run_date={run_date}")
    account.select("equity", "starting_equity", "last_update").write.mode("overwrite").parquet(f"{root}/account/run_date={run_date}")


def read_portfolio_snapshot(spark: SparkSession, path: str, run_date: str) -> tuple[DataFrame, DataFrame]:
    """(positions, account) of one run date, as written by :func:`write_portfolio_state`."""
    root = path.rstrip("/")
    return tuple(spark.read.parquet(f"{root}/{part}/run_date={run_date}") for part in ("positions", "account"))


def save_model(model: PipelineModel, quality: DataFrame, path: str) -> None:
    model.write().overwrite().save(f"{path}/model")
    quality.write.mode("overwrite").parquet(f"{path}/quality")


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(f"{path}/model")


def load_quality(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/quality")


def is_usable(spark: SparkSession, path: str) -> bool:
    """True only for a saved model that passed its quality gate."""
    row = load_quality(spark, path).select("usable").first()
    return bool(row and row["usable"])
