"""Registered queries that write files made of the driver tables to a new shared folder, and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.plans.frames import table
from wayline.plans.registry import query
from wayline.session import scratch
from wayline.sources import tensors, versions

#: Vectors of an artifact, one to a layer.
LAYERS = 16


@query()
def tensor_scan(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as tensor artifacts of 16 layers in two tiers and modes, and what a scan of one tier and checkpoint finds of
    them: a row for each vector, with its digest's agreement with what was written."""
    root = scratch(spark, "tensors")
    place = F.floor(F.col("vec_id") / LAYERS)
    vectors = table(spark, d, "embeddings").where("embedding IS NOT NULL").select(place.alias("g"), (F.col("vec_id") % LAYERS).cast("int").alias("layer"), F.col("embedding").cast("array<float>").alias("x"))
    held = vectors.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("layer", "x"))).alias("v"))
    tier, mode = F.when(F.col("g") % 3 == 0, "definitive").otherwise("exploratory"), F.when(F.col("g") % 2 == 0, "off").otherwise("on")
    shifted = F.transform("v", lambda v: F.transform(v["x"], lambda x: (x * 2).cast("float")))
    rows = held.select(
        F.concat(tier, F.lit("/"), mode, F.lit("/run-"), F.col("g").cast("string"), F.lit(".npz")).alias("path"), F.transform("v", lambda v: v["layer"]).alias("layers"), F.lit("last").alias("primary"),
        F.to_json(F.struct(F.col("g").alias("group"))).alias("metadata"), F.map_from_arrays(F.array(F.lit("last"), F.lit("mid")), F.array(F.transform("v", lambda v: v["x"]), shifted)).alias("named"),
    )
    index = f"{root}-index"
    tensors.write_archives(rows, root).write.parquet(index)
    written = spark.read.parquet(index).select(F.regexp_extract("path", "run-([0-9]+)", 1).cast("long").alias("g"), F.col("sha256").alias("told"))
    read = tensors.metadata_fields(tensors.tensor_rows(spark, root).where("tier = 'exploratory' AND checkpoint = 'mid'"), "group")
    back = read.select(F.col("group").cast("long").alias("g"), "mode", "layer", "finite", "sha256", "vector", "problem")
    return back.join(written, "g").select(
        (F.col("g") * LAYERS + F.col("layer")).alias("vec_id"), "mode", "finite", (F.col("sha256") == F.col("told")).alias("as_written"), F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double")).alias("total"), "problem"
    )


@query()
def metadata_repairs(spark: SparkSession, d: str) -> DataFrame:
    """Activation metadata of events in a table of versions, written by two appends, of which every seventh event's is
    repaired; some repairs expect another checksum than the event has, some are of events that are not there."""
    path = scratch(spark, "live")
    meta = F.struct(F.concat(F.lit("live/"), F.col("event_id").cast("string")).alias("storage_path"), F.lit(0).cast("long").alias("sequence_length"), F.array(F.lit(8)).alias("layers_extracted"), F.lit("kept").alias("note"))
    live = table(spark, d, "events").select("event_id", F.sha2(F.col("event_id").cast("string"), 256).alias("checksum"), meta.alias("meta"))
    versions.append(live.where("event_id % 2 = 0"), path, ["event_id"])
    versions.append(live, path, ["event_id"])
    k = F.col("event_id")
    new = F.struct(F.concat(F.lit("repaired/"), k.cast("string")).alias("storage_path"), F.col("user_id").cast("long").alias("sequence_length"), F.array(F.lit(8), F.lit(40)).alias("layers"))
    was = F.when(k % 21 == 0, "another").otherwise(F.sha2(k.cast("string"), 256))
    changes = table(spark, d, "events").where("event_id % 7 = 0").select(F.when(k % 35 == 0, -k - 1).otherwise(k).alias("event_id"), was.alias("was"), new.alias("new"))
    update = lambda row, change: {"meta": versions.repaired_metadata(row("meta"), change("new"), ["storage_path", "sequence_length", "layers_extracted"])}
    refused = versions.upsert(changes, path, ["event_id"], update, {"checksum": "was"})
    rows = versions.read_version(spark, path).select("event_id", "meta.storage_path", "meta.sequence_length", F.size("meta.layers_extracted").alias("n_layers"))
    return rows.join(refused, "event_id", "full_outer")
