"""Tables from and to files: format by extension or name, footers without rows, fixed schemas, contents by hash."""

from __future__ import annotations

import json
import os
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FORMATS = {".csv": "csv", ".parquet": "parquet", ".pq": "parquet", ".json": "json"}
#: Environment variable that names the default data set.
DATASET_VARIABLE = "TELEMILL_DATASET"


def file_format(path: str, fmt: str | None = None) -> str:
    fmt = (fmt or FORMATS.get(PurePosixPath(path.rstrip("/")).suffix.lower(), "")).lower()
    if fmt not in {"csv", "parquet", "json"}:
        raise ValueError(f"unknown format of {path!r}")
    return fmt


def read(spark: SparkSession, path: str, fmt: str | None = None, columns: list[str] | None = None, schema: StructType | str | None = None, separator: str = ",", header: bool = True) -> DataFrame:
    """A table; without a schema, CSV types are inferred.  ``columns`` limits what is read; a missing one is an error."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    kind = file_format(path, fmt)
    if kind == "csv":
        df = reader.csv(path, header=header, sep=separator, inferSchema=schema is None)
    else:
        df = getattr(reader, kind)(path)
    if columns is None:
        return df
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[F.col(quoted(c)) for c in unique_names(columns)])


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def literal(text: str | None) -> str:
    """A text as a SQL literal: in single quotes, with quotes and backslashes that stand for themselves."""
    return "NULL" if text is None else "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def unique_names(names: list[str]) -> list[str]:
    """Without repeats, in order."""
    return list(dict.fromkeys(names))


def column_names(spark: SparkSession, path: str, fmt: str | None = None) -> list[str]:
    """From the footer; no rows are read."""
    return read(spark, path, fmt).columns


def row_count(df: DataFrame) -> int:
    return df.count()


def resolve_dataset(candidates: list[str], default: str) -> str:
    """The path in the environment variable, else the first candidate that exists on this machine, else the default."""
    if path := os.environ.get(DATASET_VARIABLE):
        return path
    return next((c for c in candidates if os.path.exists(c)), default)


def is_public(df: DataFrame) -> bool:
    """The published column profile has a device column."""
    return "device" in df.columns


def load_dataset(spark: SparkSession, path: str, columns: list[str], row_id: str, device: str | None = None, without: list[str] = (), limit: int | None = None) -> DataFrame:
    """The wanted columns that exist, each once, with the row id first; rows of some devices left out (null ones stay)."""
    df = read(spark, path)
    if row_id not in df.columns:
        raise ValueError(f"no column {row_id}")
    if device and without:
        df = df.where(F.col(quoted(device)).isNull() | ~F.col(quoted(device)).isin(*without))
    out = df.select(*[F.col(quoted(c)) for c in unique_names([row_id, *columns]) if c in df.columns])
    return out.limit(limit) if limit else out


def storable(df: DataFrame) -> DataFrame:
    """Columns without a type (all null) as strings, which Parquet can hold."""
    return df.withColumns({c: F.col(quoted(c)).cast("string") for c, t in df.dtypes if t == "void"})


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Exactly the columns of ``schema``: cast, missing ones null, others dropped."""
    have = set(df.columns)
    return df.select(*[(F.col(quoted(f.name)) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def write(df: DataFrame, path: str, fmt: str | None = None, compression: str | None = None, mode: str = "error") -> None:
    """Zstandard for Parquet unless told otherwise (``none`` is uncompressed).  An empty table keeps its schema."""
    kind = file_format(path, fmt)
    writer = storable(df).write.mode(mode)
    if kind == "csv":
        writer.option("header", True).option("compression", compression or "none").csv(path)
    else:
        writer.option("compression", compression or ("zstd" if kind == "parquet" else "none")).format(kind).save(path)


def append_conforming(df: DataFrame, path: str, schema: StructType, compression: str = "zstd") -> None:
    write(conform(df, schema), path, "parquet", compression, "append")


def name_list(spark: SparkSession, path: str) -> list[str]:
    """One name a line; blank lines and what follows # don't count.  A configuration file, so it is small."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*", "")).alias("v")).where("v != ''")
    return unique_names([r.v for r in lines.collect()])


def manifest_channels(text: str) -> list[dict]:
    """Sensors and calibration entries of a manifest: flat, in categories, or per qubit and coupler.

    Gives path, kind (sensor, qubit or coupler) and category of what isn't disabled; a manifest without any is an error.
    """
    doc = json.loads(text)
    out: list[dict] = []

    def add(path, kind, category, spec=None):
        if not isinstance(spec, dict) or spec.get("enabled", True):
            out.append({"path": path, "kind": kind, "category": category})

    def sensors(group, category):
        entries = group.items() if isinstance(group, dict) else [(s["path"] if isinstance(s, dict) else s, s) for s in group]
        for path, spec in entries:
            add(path, "sensor", category, spec)

    sensors(doc.get("sensors", []), None)
    for category, group in doc.get("sensor_categories", {}).items():
        sensors(group.get("sensors", group) if isinstance(group, dict) else group, category)
    for key, kind in (("qubits", "qubit"), ("couplers", "coupler")):
        for owner, spec in doc.get(key, {}).items():
            if isinstance(spec, dict) and not spec.get("enabled", True):
                continue
            for metric, m in (spec.get("metrics", {}) if isinstance(spec, dict) else {}).items():
                add(f"{owner}/{metric}", kind, None, m)
    if not out:
        raise ValueError("the manifest lists nothing")
    return out


def select_value(text: str, selector: str):
    """One value of a result: ``a.b.c`` in JSON, or ``column|key=value|...`` in CSV with a header; None if it isn't there."""
    if "|" in selector:
        import csv
        import io

        column, *conditions = selector.split("|")
        wanted = dict(c.split("=", 1) for c in conditions)
        found = next((r for r in csv.DictReader(io.StringIO(text)) if all(r.get(k) == v for k, v in wanted.items())), {})
        return float(found[column]) if found.get(column) not in (None, "") else None
    at = json.loads(text)
    for part in selector.split("."):
        if isinstance(at, list):
            at = at[int(part)] if part.isdigit() and int(part) < len(at) else None
        else:
            at = at.get(part) if isinstance(at, dict) else None
    return at


def result_document(payload: dict, seed: int) -> str:
    return json.dumps({**payload, "seed": seed}, indent=2, sort_keys=True, default=str)


def write_document(spark: SparkSession, text: str, path: str) -> None:
    """A text as the only file of a folder, which any file system that Spark knows can hold."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_document(spark: SparkSession, path: str) -> str:
    """The text that ``write_document`` wrote; documents are small (a result, a list, a manifest)."""
    (row,) = spark.read.text(path, wholetext=True).collect()
    return row.value.removesuffix("\n")


def save_result(spark: SparkSession, payload: dict, seed: int, base: str, name: str, pool: str | None = None) -> str:
    """Write a result with its seed into its pool's folder; gives the path."""
    path = results_path(base, name, pool)
    write_document(spark, result_document(payload, seed), path)
    return path


def window_paths(arguments: list[str]) -> dict[int, str]:
    """``MINUTES=PATH`` arguments as a dictionary in the order of minutes."""
    out = {}
    for a in arguments:
        minutes, found, path = a.partition("=")
        if not found or not path or not minutes.strip().isdigit():
            raise ValueError(f"not MINUTES=PATH: {a!r}")
        out[int(minutes)] = path
    return dict(sorted(out.items()))


def arguments(argv: list[str]) -> dict:
    """Flags that all drivers share: seed, only, fast, list, windows, and a pool, which also redirects results."""
    import argparse

    p = argparse.ArgumentParser(add_help=False)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--pool")
    p.add_argument("--results", default="results")
    p.add_argument("--only", nargs="*", default=[])
    p.add_argument("--fast", action="store_true")
    p.add_argument("--list", action="store_true")
    p.add_argument("--windows", nargs="*", default=[])
    got = vars(p.parse_args(argv))
    return got | {"windows": window_paths(got["windows"]), "folder": results_path(got["results"], "", got["pool"]).rstrip("/")}


def column_report(decisions: list[tuple[str, str, str]], counts: dict[str, int]) -> str:
    """What became of every column and why, how many values it has, and how many columns each action took, as JSON."""
    actions: dict[str, int] = {}
    for _, action, _ in decisions:
        actions[action] = actions.get(action, 0) + 1
    rows = [{"column": c, "action": a, "reason": r, "values": counts.get(c)} for c, a, r in decisions]
    return json.dumps({"actions": actions, "columns": rows}, indent=2, sort_keys=True)


def results_path(base: str, name: str, pool: str | None = None) -> str:
    return f"{base}_{pool}/{name}" if pool else f"{base}/{name}"


def markdown_table(columns: list[str], rows: list[tuple]) -> str:
    cell = lambda v: "" if v is None else f"{v:.1f}" if isinstance(v, float) else str(v)
    return "\n".join("| " + " | ".join(map(cell, r)) + " |" for r in [columns, ["---"] * len(columns), *rows]) + "\n"


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(name, nbytes, sha256) of files, read by the executors; a file must fit into memory."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("nbytes"), F.sha2("content", 256).alias("sha256"))


def parquet_metadata(spark: SparkSession, path: str) -> dict[str, str]:
    """Key-value metadata of a Parquet file's footer, from any file system; rows aren't read."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(conf)
    if fs.getFileStatus(where).isDirectory():
        where = next(f.getPath() for f in fs.listStatus(where) if f.getPath().getName().endswith(".parquet"))
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(where, conf))
    try:
        return dict(reader.getFileMetaData().getKeyValueMetaData())
    finally:
        reader.close()
