"""Append sink that a retry cannot double.

A table is a folder with ``data`` (one sub-folder per run) and ``manifest``
(one row per finished run).  A run first replaces its own sub-folder, then
adds its manifest row; readers see only runs that the manifest names.  A run
that died half-way is invisible, and its retry replaces what it left.  A run
already in the manifest is not written again.

Columns are fixed by the first run, as a file's header is written only when the
file is new; a later run with other names or types raises ``ValueError``
(their order may differ).

Run ids are any non-empty texts.  A run without rows is a run like any other.
Two writers of one run id at once write the same rows into the same folder; two
different first runs at once may each fix the columns, which the next read
reports.
"""
from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUN = "run_id"
_MANIFEST = T.StructType([T.StructField(RUN, T.StringType()), T.StructField("rows", T.LongType()),
                          T.StructField("columns", T.StringType())])


def runs(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, rows, columns as JSON) of the finished runs, one row each."""
    try:
        found = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _MANIFEST)
    # a retry between its data and its manifest row may name a run twice
    return found.groupBy(RUN).agg(F.max("rows").alias("rows"), F.max("columns").alias("columns"))


def _columns(schema: T.StructType) -> str:
    """Names and types in name order, all nullable, as JSON."""
    plain = T.StructType([T.StructField(f.name, f.dataType) for f in sorted(schema.fields, key=lambda f: f.name)])
    return json.dumps(json.loads(plain.json()), sort_keys=True)


def _fixed_columns(spark: SparkSession, path: str) -> str | None:
    """The columns all runs share, None before the first."""
    kinds = [r["columns"] for r in runs(spark, path).select("columns").distinct().limit(2).collect()]
    if len(kinds) > 1:
        raise ValueError(f"runs of {path} have different columns: {kinds}")
    return kinds[0] if kinds else None


def append_run(df: DataFrame, path: str, run_id: str) -> bool:
    """Append ``df`` to the table at ``path`` as run ``run_id``, once.

    Returns whether rows were written: False if the run is finished already."""
    spark = df.sparkSession
    if not run_id:
        raise ValueError("a run needs an id")
    if RUN in df.columns:
        raise ValueError(f"{RUN!r} names the run and cannot be a column")
    mine, fixed = _columns(df.schema), _fixed_columns(spark, path)
    if fixed is not None and fixed != mine:
        raise ValueError(f"run {run_id!r} has columns {mine}, the table has {fixed}")
    if runs(spark, path).filter(F.col(RUN) == run_id).head(1):
        return False
    target = _run_folder(path, run_id)
    df.write.mode("overwrite").parquet(target)
    rows = spark.read.schema(df.schema).parquet(target).count()
    spark.createDataFrame([(run_id, rows, mine)], _MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return True


def _run_folder(path: str, run_id: str) -> str:
    """A run's folder: its id in hexadecimal, as any text may be an id."""
    return f"{path}/data/{run_id.encode().hex()}"


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all finished runs with their ``run_id``; columns in name
    order after it.  Raises ``ValueError`` for a table without runs."""
    fixed = _fixed_columns(spark, path)
    if fixed is None:
        raise ValueError(f"no finished run at {path}")
    schema = T.StructType.fromJson(json.loads(fixed))
    # the names of runs (not their rows) are needed to name the folders
    names = [r[RUN] for r in runs(spark, path).select(RUN).collect()]
    data = spark.read.schema(schema).parquet(*[_run_folder(path, n) for n in names])
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return data.select(F.decode(F.unhex(folder), "utf-8").alias(RUN), *[F.col(f"`{f.name}`") for f in schema.fields])
