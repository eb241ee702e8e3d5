"""Bundles: ordered NDJSON sequences with a manifest of counts and digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.operators.facts import missing

LOCATOR = (
    "struct<uri:string,source_id:string,artifact_id:string,path:string,member:string,start_line:int,start_column:int,"
    "end_line:int,end_column:int,byte_offset:bigint,byte_length:bigint>"
)
SCHEMAS = {
    "artifacts": "id string, source_id string, path string, type string, hash string, size long, kind string",
    "contributions": f"id string, artifact_id string, analyzer_id string, analyzer_version string, method string, type string, locator {LOCATOR}, observed_at timestamp, value string",
    "evidence": f"id string, source_id string, snapshot_id string, artifact_id string, locator {LOCATOR}, content_state string, content string, content_hash string, truncated boolean, classification string, findings array<string>",
    "facts": f"id string, scope string, predicate string, subject struct<kind:string,id:string>, object struct<kind:string,id:string>, producer struct<id:string,version:string,method:string>, evidence array<struct<id:string,locator:{LOCATOR}>>, lineage struct<rule_id:string,rule_version:string,input_fact_ids:array<string>>",
}


def _lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def sequence_stats(lines: DataFrame) -> dict:
    """Count, bytes and a digest of a sequence, whatever its order or partitions."""
    r = lines.agg(F.count("*").alias("count"), F.sum(F.octet_length("value") + 1).alias("bytes"), F.sum(F.conv(F.substring(F.sha2("value", 256), 1, 15), 16, 10).cast("decimal(38,0)")).alias("digest")).first()
    return {"count": r["count"], "bytes": r["bytes"] or 0, "digest": str(r["digest"] or 0)}


def write_bundle(spark: SparkSession, tables: dict[str, DataFrame], path: str) -> None:
    """Sequences first, the manifest last: a bundle without one isn't complete."""
    manifest = []
    for name, df in sorted(tables.items()):
        lines = _lines(df)
        lines.write.mode("overwrite").text(f"{path}/{name}.ndjson")
        manifest.append((name, *sequence_stats(lines).values()))
    spark.createDataFrame(manifest, "name string, count long, bytes long, digest string").coalesce(1).write.mode("overwrite").json(f"{path}/manifest.json")


def read_bundle(spark: SparkSession, path: str, schemas: dict[str, str] = SCHEMAS) -> dict[str, DataFrame]:
    """The tables of a bundle; ValueError if a sequence isn't what the manifest
    says, an exception of Spark's on the first malformed row."""
    out = {}
    for row in spark.read.schema("name string, count long, bytes long, digest string").json(f"{path}/manifest.json").collect():
        lines = spark.read.text(f"{path}/{row['name']}.ndjson")
        if sequence_stats(lines) != {k: row[k] for k in ("count", "bytes", "digest")}:
            raise ValueError(f"sequence {row['name']} differs from its manifest")
        schema = T.StructType.fromDDL(schemas[row["name"]])
        out[row["name"]] = spark.read.schema(schema).option("mode", "FAILFAST").json(f"{path}/{row['name']}.ndjson")
    return out


def broken_references(tables: dict[str, DataFrame], producers: DataFrame | None = None) -> DataFrame:
    """(reference, id) of every reference that leads nowhere; any rejects a bundle."""
    a, c, e, f = (tables[t] for t in ("artifacts", "contributions", "evidence", "facts"))
    cited = f.select("id", F.explode("evidence").alias("x")).select("id", F.col("x.id").alias("evidence_id"), "x.locator")
    known = e.select(F.col("id").alias("evidence_id"), F.col("locator").alias("own"))
    same = cited.join(known, (cited["evidence_id"] == known["evidence_id"]) & cited["locator"].eqNullSafe(known["own"]), "left_anti")
    parts = [
        missing(c, "artifact_id", a, "id").select(F.lit("contribution_artifact").alias("reference"), "id"),
        missing(e, "artifact_id", a, "id").select(F.lit("evidence_artifact").alias("reference"), "id"),
        same.select(F.lit("fact_evidence").alias("reference"), "id"),
        missing(f.select("id", F.explode("lineage.input_fact_ids").alias("i")), "i", f, "id").select(F.lit("lineage_input").alias("reference"), "id"),
        missing(f.filter("subject.kind = 'artifact'").select("id", F.col("subject.id").alias("s")), "s", a, "id").select(F.lit("fact_artifact").alias("reference"), "id"),
    ]
    if producers is not None:
        parts.append(missing(f.select("id", F.col("producer.id").alias("p")), "p", producers, "id").select(F.lit("fact_producer").alias("reference"), "id"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()
