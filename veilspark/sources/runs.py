"""Datasets, saved runs and reports on disk.

A run is the folder run_id=<id>/output_name=<name>, so all outputs of all runs are one partitioned table.
"""

from __future__ import annotations

import json
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions.scalars import ENTITY_LABELS
from veilspark.schemas import DATASET_DDL

DATES = ("file_created_date", "last_modified_date", "dataset_created_at")


def read_dataset(spark: SparkSession, path: str, limit: int | None = None, order: str = "document_id") -> DataFrame:
    """The document dataset from CSV with quoted line breaks, or from Parquet. Dates that can't be read are null;
    ``limit`` takes the first rows in order of a column."""
    if path.rstrip("/").endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        text = ", ".join(f"{part.split()[0]} string" for part in DATASET_DDL.split(", "))
        df = spark.read.schema(text).option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", False).csv(path)
        kinds = dict(part.split() for part in DATASET_DDL.split(", "))
        df = df.select(*[as_date(F.col(c)).alias(c) if c in DATES else F.col(c).try_cast(t).alias(c) for c, t in kinds.items()])
    return df if limit is None else df.orderBy(order).limit(limit)


def as_date(c: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "dd.MM.yyyy", "MM/dd/yyyy")]).cast("date")


def for_training(df: DataFrame, required: tuple[str, ...] = ("full_text", "contains_personal_data")) -> DataFrame:
    """Absent entity columns become "no", null texts empty; an absent required column is an error."""
    gone = [c for c in required if c not in df.columns]
    if gone:
        raise ValueError(f"missing columns {gone}")
    return df.withColumns({f"{e}_yes_no": F.lit("no") for e in ENTITY_LABELS if f"{e}_yes_no" not in df.columns} | {"full_text": F.coalesce("full_text", F.lit(""))})


def write_output(df: DataFrame, root: str, run_id: str, name: str, form: str = "parquet") -> str:
    """One output of a run; an output of that name is replaced."""
    path = f"{root}/run_id={run_id}/output_name={name}"
    df.drop("run_id", "output_name").write.mode("overwrite").format(form).save(path)
    return path


def read_outputs(spark: SparkSession, root: str, run_id: str | None = None, form: str = "parquet") -> DataFrame:
    """All outputs of all runs or of one, with run_id and output_name as columns."""
    df = spark.read.format(form).option("basePath", root).option("mergeSchema", True).load(f"{root}/run_id={run_id or '*'}/output_name=*")
    return df.withColumns({"run_id": F.col("run_id").cast("string"), "output_name": F.col("output_name").cast("string")})


def runs(spark: SparkSession, root: str) -> list[str]:
    """Ids of the saved runs in order; the last is the latest, as ids begin with the time."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [PurePosixPath(f.getPath().toString()).name for f in fs.listStatus(path) if f.isDirectory()]
    return sorted(n.removeprefix("run_id=") for n in names if n.startswith("run_id="))


def latest_run(spark: SparkSession, root: str) -> str:
    found = runs(spark, root)
    if not found:
        raise FileNotFoundError(f"no runs under {root}")
    return found[-1]


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    """A document of metadata as one file, on any file system Spark can reach."""
    write_bytes(spark, json.dumps(value, indent=2, ensure_ascii=False, sort_keys=True).encode(), path)


def write_bytes(spark: SparkSession, data: bytes, path: str) -> None:
    """One file, on any file system Spark can reach."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def read_json(spark: SparkSession, path: str) -> dict:
    """The document, an empty one where there is none."""
    jvm = spark.sparkContext._jvm
    source = jvm.org.apache.hadoop.fs.Path(path)
    if not source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(source):
        return {}
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def write_csv(df: DataFrame, path: str, quote_all: bool = True, bom: bool = False) -> None:
    """CSV with a header; ``bom`` puts a byte order mark before each file's header, for spreadsheets."""
    if not bom:
        df.write.mode("overwrite").option("header", True).option("quoteAll", quote_all).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
        return
    # Lines are laid out here, as the built-in writer can't start a file with a mark; text files keep them as they are.
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    cells = [quoted(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) for c in df.columns]
    head = "\ufeff" + ",".join('"' + c.replace('"', '""') + '"' for c in df.columns)
    kind = df.select(F.concat_ws(",", *cells).alias("value"))

    def headed(batches):
        import pyarrow as pa

        started = False
        for batch in batches:
            if not started:
                yield pa.RecordBatch.from_arrays([pa.array([head], batch.schema.field(0).type)], schema=batch.schema)
            started = True
            yield batch
        if not started:
            yield pa.RecordBatch.from_pydict({"value": [head]})

    kind.mapInArrow(headed, "value string").write.mode("overwrite").text(path)


def read_csv_with_mark(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_csv`` wrote, with or without a mark; all columns are text."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.toDF(*[c.removeprefix("\ufeff").strip('"') for c in df.columns])


def write_parts(df: DataFrame, path: str, column: str, form: str = "parquet") -> None:
    """One folder for each value of a column; null values are left out."""
    df.where(F.col(column).isNotNull()).write.mode("overwrite").partitionBy(column).format(form).save(path)


def save_benchmark(rows: DataFrame, root: str, name: str) -> str:
    """Metric rows of a benchmark as one table."""
    path = f"{root}/benchmark={name}"
    rows.write.mode("overwrite").parquet(path)
    return path


def load_benchmarks(spark: SparkSession, root: str) -> DataFrame:
    """Metric rows of all saved benchmarks, with the benchmark's name as a column; columns that one lacks are null."""
    return spark.read.option("basePath", root).option("mergeSchema", True).parquet(f"{root}/benchmark=*")


def write_audit(spark: SparkSession, findings: DataFrame, path: str) -> dict:
    """An audit's findings (a few dozen rows) as JSON: status, counts by level and all findings."""
    rows = [r.asDict() for r in findings.collect()]
    levels = {level: sum(r["level"] == level for r in rows) for level in ("PASS", "WARN", "FAIL")}
    report = {"status": next((level for level in ("FAIL", "WARN") if levels[level]), "PASS"), "levels": levels, "findings": sorted(rows, key=lambda r: r["check"])}
    write_json(spark, report, path)
    return report


def save_reports(reports: dict[str, DataFrame], root: str, form: str = "parquet") -> None:
    for name, df in reports.items():
        df.write.mode("overwrite").format(form).save(f"{root}/{name}")
