"""Directories, key lists and JSON output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citegrid.functions.vocab import SYSTEM_TYPES
from citegrid.sources import bibtex


def bibliographies(spark: SparkSession, folder: str) -> DataFrame:
    """The .bib files (in any case) of a folder, not of those below it: file and size, empty ones too. None at all is an
    error. The driver lists the folder, as it does for any read."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    listed = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    found = [(s.getPath().toString(), s.getLen()) for s in listed if s.isFile() and s.getPath().getName().lower().endswith(".bib")]
    if not found:
        raise FileNotFoundError(f"no .bib files found in {folder}")
    return spark.createDataFrame(found, "file string, size long")


def scanned(spark: SparkSession, folder: str) -> DataFrame:
    """Every .bib file of a folder with its number of ordinary entries and the first error of its text, if there is one:
    a broken file does not keep the others from being read."""
    found = bibliographies(spark, folder)
    filled = [r["file"] for r in found.filter("size > 0").select("file").toLocalIterator()]
    none = found.select("file", "size", F.lit(0).cast("long").alias("entries"), F.lit(None).cast("string").alias("error"))
    if not filled:
        return none
    e = bibtex.scan(spark, *filled)
    ordinary = F.col("error").isNull() & (F.col("kind") != "string") & ~F.col("kind").isin(*SYSTEM_TYPES)
    g = e.groupBy(_plain(F.col("file")).alias("_f")).agg(F.count_if(ordinary).alias("entries"), F.min(F.when(F.col("error").isNotNull(), F.struct("at", "error"))).alias("_e"))
    return found.join(g, _plain(F.col("file")) == F.col("_f"), "left").select("file", "size", F.coalesce("entries", F.lit(0)).alias("entries"), F.col("_e.error").alias("error"))


def _plain(c):
    """A path without its scheme, however many slashes follow it."""
    return F.regexp_replace(c, "^[a-z0-9]+:/+", "/")


def keys(spark: SparkSession, path: str) -> DataFrame:
    """A list of keys, one a line, trimmed; blank lines count for nothing, a list without keys is an error."""
    found = spark.read.text(path).select(F.trim("value").alias("entry_key")).filter("entry_key <> ''")
    if not found.limit(1).count():
        raise ValueError(f"no citation keys found in {path}")
    return found


def write_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines, nulls left out."""
    df.write.mode("overwrite").json(path)


def write_json_array(df: DataFrame, path: str, order: list[str]) -> None:
    """Rows as one JSON array in one file, in order: for reports that are read as a whole. Sorted by Spark and streamed
    through the driver a row at a time."""
    system, target = spark_file(df.sparkSession, path)
    out = system.create(target, True)
    try:
        first = True
        for row in df.orderBy(*order).select(F.to_json(F.struct("*")).alias("j")).toLocalIterator():
            out.write(bytearray((("[" if first else ",") + "\n" + row["j"]).encode()))
            first = False
        out.write(bytearray(b"[]\n" if first else b"\n]\n"))
    finally:
        out.close()


def spark_file(spark: SparkSession, path: str):
    """The file system of a path, and the path, as Spark sees them."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target
