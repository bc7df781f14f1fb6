"""Sources, sinks and fitted-artefact storage."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TESTDATA_TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
                   "lineitem", "events", "documents", "embeddings", "pages",
                   "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None,
               fmt: str | None = None, nan_as_null: bool = True) -> DataFrame:
    """Read a table. CSV takes a header row and an explicit schema
    (schema inference is a full extra scan and is only used when none is given).
    NaN cells of float columns become null (``nan_as_null``), as writers that have
    no null for numbers leave NaN for it."""
    df = _scan(spark, path, schema, fmt)
    return nan_to_null(df) if nan_as_null else df


def nan_to_null(df: DataFrame) -> DataFrame:
    return df.select(*[F.nullif(F.col(f"`{f.name}`"), F.lit(float("nan")).cast(f.dataType)).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`") for f in df.schema.fields])


def _scan(spark: SparkSession, path: str, schema: T.StructType | None, fmt: str | None) -> DataFrame:
    fmt = fmt or ("csv" if path.endswith(".csv") else "parquet")
    if fmt == "csv":
        reader = spark.read.option("header", True)
        reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
        return reader.csv(path)
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.format(fmt).load(path)


def testdata(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_columns(spark: SparkSession, path: str) -> list[str]:
    """Column list from the file footer / header only (no data job for Parquet)."""
    return read_table(spark, path).columns


def columns_frame(spark: SparkSession, df: DataFrame) -> DataFrame:
    """S02 as a table: one row per column with its ordinal and type name."""
    rows = [(i + 1, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "ordinal long, column_name string, data_type string")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: Iterable[str] | None = None) -> None:
    """Write without any index column; the writer creates the folders."""
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def _try_read(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame | None:
    try:
        return read_table(spark, path, fmt=fmt)
    except AnalysisException:
        return None


def load_or_build_features(spark: SparkSession, path: str,
                           build_fn: Callable[[], DataFrame],
                           expected: list[str] | None = None) -> DataFrame:
    """Reuse a materialised feature table when it holds every expected
    column (projected to the expected order), else rebuild, write and re-read.
    A rebuilt table that still lacks an expected column is an error."""
    cached = _try_read(spark, path)
    if cached is not None:
        if expected is None:
            return cached
        if not set(expected) - set(cached.columns):
            return cached.select(*[F.col(f"`{c}`") for c in expected])
    built = build_fn()
    write_table(built, path)
    out = read_table(spark, path)
    if expected is not None:
        missing = [c for c in expected if c not in out.columns]
        if missing:
            raise ValueError(f"the rebuilt table lacks columns {missing}")
        out = out.select(*[F.col(f"`{c}`") for c in expected])
    return out


# --- S06: fitted-artefact store --------------------------------------------

def save_artefacts(spark: SparkSession, directory: str, params: dict[str, DataFrame],
                   models: dict | None = None, meta: dict | None = None) -> str:
    """Parameters are small DataFrames written as Parquet; Spark ML models go
    through their own writers; lists/maps go into a one-row JSON table.

    Everything is written to a folder of its own, ``versions/<version>``; one row
    appended to ``manifest`` at the end makes it the current one.  A save that
    breaks off leaves the store as it was, and a reader of an older version keeps
    it: versions are not changed or removed.  Returns the version."""
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    place = f"{directory}/versions/{version}"
    for name, df in params.items():
        write_table(df, f"{place}/params/{name}")
    for name, model in (models or {}).items():
        model.write().overwrite().save(f"{place}/models/{name}")
    if meta is not None:
        m = spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "meta string")
        write_table(m.coalesce(1), f"{place}/meta", fmt="json")
    content = spark.createDataFrame([(version, sorted(params), sorted(models or {}), meta is not None)], "version string, params array<string>, models array<string>, meta boolean")
    write_table(content.coalesce(1), f"{directory}/manifest", mode="append")
    return version


def current_version(spark: SparkSession, directory: str) -> str:
    """The last version that was saved whole."""
    manifest = _try_read(spark, f"{directory}/manifest")
    version = manifest.agg(F.max("version")).first()[0] if manifest is not None else None
    if version is None:
        raise FileNotFoundError(f"{directory} holds no committed artefacts")
    return version


def load_artefacts(spark: SparkSession, directory: str, params: Iterable[str] = (),
                   models: dict | None = None, version: str | None = None) -> tuple[dict, dict, dict]:
    """Parameters, models (name -> loader) and meta of ``version``, the current one by
    default.  Two loads that belong together name the version of the first."""
    place = f"{directory}/versions/{version or current_version(spark, directory)}"
    p = {n: read_table(spark, f"{place}/params/{n}") for n in params}
    mods = {n: loader.load(f"{place}/models/{n}") for n, loader in (models or {}).items()}
    meta_df = _try_read(spark, f"{place}/meta", fmt="json")
    meta = json.loads(meta_df.first()["meta"]) if meta_df is not None else {}
    return p, mods, meta


# --- S07: records -> table ---------------------------------------------------

def records_to_df(json_df: DataFrame, raw_schema: T.StructType, col: str = "value",
                  keep: Iterable[str] = ()) -> DataFrame:
    """Parse a batch of JSON payloads (one per row) into the raw schema."""
    parsed = F.from_json(F.col(col), raw_schema)
    return json_df.select(*keep, parsed.alias("_r")).select(*keep, "_r.*")
