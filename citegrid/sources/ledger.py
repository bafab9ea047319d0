"""The ledger file (JSON) as tables, and versioned commits of tables with a manifest as the commit mark."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "struct<entry_type:string,entry_key:string,fields:map<string,string>>"
ENTRY = (
    f"struct<contentHash:string,snapshot:{RECORD},source:string,provider:string,providerId:string,integrity:struct<contentHash:string,source:string>,"
    "approval:struct<id:string,kind:string,method:string,reviewer:string,target:string,contentHash:string,timestamp:bigint,batchId:string>,head:string>"
)
REVISION = f"struct<target:string,previous:string,operation:string,actor:string,timestamp:bigint,snapshot:{RECORD},state:{ENTRY},snapshotSha256:string,revisionSha256:string>"
LEDGER = f"lockfileVersion string, toolVersion string, bibliography struct<contentHash:string>, entries map<string,{ENTRY}>, deletedEntries map<string,{ENTRY}>, sources map<string,map<string,string>>, revisions map<string,{REVISION}>"


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """header, entries, revisions and sources of ledger files; malformed JSON fails."""
    raw = spark.read.schema(LEDGER).option("multiLine", True).option("mode", "FAILFAST").json(path)
    each = lambda c, flag: raw.select(F.explode(c).alias("entry_key", "e"), F.lit(flag).alias("deleted"))
    entries = each("entries", False).unionByName(each("deletedEntries", True))
    e = F.col("e")
    approval = F.when(e["approval"].isNotNull(), F.struct(*[e["approval"][a].alias(b) for a, b in (("id", "id"), ("kind", "kind"), ("method", "method"), ("reviewer", "reviewer"), ("target", "target"), ("contentHash", "content_hash"), ("timestamp", "timestamp"), ("batchId", "batch_id"))]))
    return {
        "header": raw.select("lockfileVersion", "toolVersion", F.col("bibliography.contentHash").alias("content_hash")),
        "entries": entries.select("entry_key", "deleted", e["contentHash"].alias("content_hash"), e["snapshot"].alias("snapshot"), e["source"].alias("source"), e["provider"].alias("provider"), e["providerId"].alias("provider_id"), e["integrity"]["contentHash"].alias("integrity_hash"), e["integrity"]["source"].alias("integrity_source"), approval.alias("approval"), e["head"].alias("head")),
        "revisions": raw.select(F.explode("revisions").alias("id", "r")).select("id", "r.target", "r.previous", "r.operation", "r.actor", "r.timestamp", "r.snapshot", "r.state", F.col("r.snapshotSha256").alias("snapshot_sha256"), F.col("r.revisionSha256").alias("revision_sha256")),
        "sources": raw.select(F.explode("sources").alias("entry_key", "fields")),
    }


def hydrate(records: DataFrame, entries: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Records with their ledger state as virtual fields: source, provider, marker and approval, where there are any. With
    ``sources`` (entry_key, fields) the evidence follows as rows of its own; records then have an entry_type."""
    e = entries.filter(~F.col("deleted"))
    values = {
        "bibsource": F.col("source"), "bibprovider": F.col("provider"), "bibproviderid": F.col("provider_id"), "integrity": F.col("integrity_hash"), "bibapprovalid": F.col("approval.id"), "bibapprovalkind": F.col("approval.kind"),
        "bibapprovalmethod": F.col("approval.method"), "bibapprovalreviewer": F.col("approval.reviewer"), "bibapprovalcontent": F.col("approval.content_hash"), "bibapprovaltimestamp": F.col("approval.timestamp").cast("string"), "bibapprovalbatch": F.col("approval.batch_id"),
    }
    virtual = F.map_filter(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())
    v = e.select(F.col("entry_key").alias("_k"), virtual.alias("_v"))
    from citegrid.functions.projections import overlay

    none = F.create_map().cast("map<string,string>")
    out = records.join(v, F.col("entry_key") == F.col("_k"), "left").withColumn("fields", overlay(F.col("fields"), F.coalesce("_v", none))).drop("_k", "_v")
    return out if sources is None else out.unionByName(sources.select(F.lit("bibsource").alias("entry_type"), "entry_key", "fields"), allowMissingColumns=True)


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def current_version(spark: SparkSession, folder: str) -> int:
    """The newest committed version of a folder; 0 if there is none."""
    fs, p = _fs(spark, f"{folder}/_manifest")
    if not fs.exists(p):
        return 0
    return max((int(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().isdigit()), default=0)


def commit(tables: dict[str, DataFrame], folder: str, expected: int) -> int:
    """Write tables as version expected + 1. The manifest comes last and is created only if it isn't there, so a broken
    commit is never seen and of two concurrent ones the second fails."""
    spark = next(iter(tables.values())).sparkSession
    if current_version(spark, folder) != expected:
        raise RuntimeError("changed since it was read; retry")
    version = expected + 1
    attempt = spark.sparkContext._jvm.java.util.UUID.randomUUID().toString()
    for name, df in tables.items():
        df.write.parquet(f"{folder}/data/{version}-{attempt}/{name}")
    fs, p = _fs(spark, f"{folder}/_manifest/{version}")
    out = fs.create(p, False)
    try:
        out.write(bytearray(json.dumps({"attempt": attempt, "tables": sorted(tables)}).encode()))
    finally:
        out.close()
    return version


def load(spark: SparkSession, folder: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of a version, the newest by default."""
    version = version or current_version(spark, folder)
    body = json.loads(spark.read.text(f"{folder}/_manifest/{version}").first()[0])
    return {t: spark.read.parquet(f"{folder}/data/{version}-{body['attempt']}/{t}") for t in body["tables"]}
