"""SNK-1: CSV output."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

MANIFEST = "_manifest.json"  # hidden from readers of the folder by its name
MODES = ("errorifexists", "overwrite")


def _paths(spark: SparkSession, path: str):
    """The path's file system, through the session's JVM gateway, and a function that makes paths."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def _checksum(columns: list[str]) -> Column:
    """The sum of the rows' hashes, of the columns as text: it does not depend on their order."""
    text = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns]
    return F.coalesce(F.sum(F.xxhash64(*text).cast("decimal(38,0)")), F.lit(0)).cast("string")


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> dict:
    """Write with a header and no row index, one file per partition; returns the manifest.

    The files are written beside the target, with a manifest of their rows and a checksum that the same
    job counts, and take the target's name by one rename: a job that fails leaves no half export,
    and a reader sees all of it or none. With ``overwrite`` the old export is moved away first and
    deleted last, so that a failure in between leaves it to be found.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    spark = df.sparkSession
    path = path.rstrip("/")
    fs, make = _paths(spark, path)
    target = make(path)
    if mode == "errorifexists" and fs.exists(target):
        raise FileExistsError(path)
    run = uuid.uuid4().hex
    staged, replaced = f"{path}.staged-{run}", make(f"{path}.replaced-{run}")
    seen = Observation()
    counted = df.observe(seen, F.count("*").alias("rows"), _checksum(df.columns).alias("checksum"))
    try:
        counted.write.option("header", True).csv(staged)
        manifest = {**seen.get, "columns": df.columns}
        out = fs.create(make(f"{staged}/{MANIFEST}"), False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if mode == "overwrite" and fs.exists(target):
            _rename(fs, target, replaced)
        _rename(fs, make(staged), target)
    except BaseException:
        fs.delete(make(staged), True)
        if fs.exists(replaced) and not fs.exists(target):
            fs.rename(replaced, target)
        raise
    fs.delete(replaced, True)
    return manifest


def _rename(fs, source, target) -> None:
    if fs.exists(target) or not fs.rename(source, target):
        raise OSError(f"{source} could not be renamed to {target}")


def read_manifest(spark: SparkSession, path: str) -> dict:
    fs, make = _paths(spark, path)
    stream = fs.open(make(f"{path.rstrip('/')}/{MANIFEST}"))
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def read_csv(spark: SparkSession, path: str, schema: str, *, verify: bool = False) -> DataFrame:
    """An export of ``write_csv``, through its manifest: columns by name, and with ``verify`` rows and checksum."""
    manifest = read_manifest(spark, path)
    df = spark.read.schema(schema).option("header", True).csv(path)
    if df.columns != manifest["columns"]:
        raise ValueError(f"the export has the columns {manifest['columns']}")
    if verify:
        found = df.agg(F.count("*").alias("rows"), _checksum(df.columns).alias("checksum")).first()
        if found.asDict() != {k: manifest[k] for k in ("rows", "checksum")}:
            raise ValueError(f"{path} does not hold what its manifest says")
    return df
