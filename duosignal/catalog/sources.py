"""Queries over readers, writers and inventories."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duosignal.catalog.registry import C, E, L, M, Tables, query
from duosignal.operators.series import normalise_label
from duosignal.sources import workspace as ws
from duosignal.sources.trials import save_trials
from duosignal.sources.trials import scan_trials as read_trials


@query("trial_catalog", "select distinct conv_id % 10 as session, turn as trial from conversations")
def trial_catalog(t: Tables) -> DataFrame:
    named = t["conversations"].select((F.col("conv_id") % 10).alias("session"), F.format_string("s%d.objects.%d.channel1.wav", F.col("conv_id") % 10, F.col("turn")).alias("path"))
    return named.select("session", ws.trial_of("path").alias("trial")).distinct()


@query("scan_intervals", f'with {C} select k, start_s as start, end_s as "end", \'turn \' || turn as text from C')
def scan_intervals(t: Tables) -> DataFrame:
    path = f"{ws.work_folder(t.spark)}/phrases-{uuid.uuid4().hex}"
    t.c.select("k", "start_s", "end_s", F.format_string("turn %d", "turn")).write.option("sep", "\t").csv(path)  # not a folder for each series
    return ws.scan_intervals(t.spark, path, "k long")


@query("scan_pitch", f"with {E} select k, t, case when label = 'view' then 0.0 else v end as pitch, case when label <> 'view' then v end as known from E")
def scan_pitch(t: Tables) -> DataFrame:
    raw = t.e.withColumn("raw", F.when(F.col("label") == "view", "--undefined--").otherwise(F.col("v").cast("string")))
    return raw.select("k", "t", ws.defined("raw").alias("pitch"), ws.defined("raw", None).alias("known"))


@query("scan_signal", f"with {M} select vec_id, label as session, cast(ch as bigint) as channel, v as y from M")
def scan_signal(t: Tables) -> DataFrame:
    """All channels of each sample, in long form."""
    return t["embeddings"].select("vec_id", F.col("label").cast("long").alias("session"), F.posexplode("embedding").alias("channel", "y")).select("vec_id", "session", F.col("channel").cast("long").alias("channel"), F.col("y").cast("double").alias("y"))


@query("sink_partitioned", f"with {E} select k, t, v, label from E")
def sink_partitioned(t: Tables) -> DataFrame:
    path = f"{ws.work_folder(t.spark)}/features-{uuid.uuid4().hex}"
    rows = t.e.select("k", "t", "v", "label")
    ws.save_partitioned(rows.withColumn("v", F.lit(0.0)), path, ["label"])
    ws.save_partitioned(rows, path, ["label"])
    return t.spark.read.parquet(path).select("k", "t", "v", "label")


@query("read_or_build", f"with {M} select vec_id, count(*) as n, max(ch) as last from M group by vec_id")
def read_or_build(t: Tables) -> DataFrame:
    path = f"{ws.work_folder(t.spark)}/cache-{uuid.uuid4().hex}"
    build = lambda: t.m.groupBy("vec_id").agg(F.count("*").alias("n"), F.max("ch").alias("last"))
    ws.read_or_build(t.spark, path, build)
    return ws.read_or_build(t.spark, path, build)


@query("stim_select", f"with {E} select k, t, 'value' as feature, 0 as position, v as x from E union all select k, t, 'state', 1, cast(state as double) from E")
def stim_select(t: Tables) -> DataFrame:
    long = t.e.select("k", "t", F.explode(F.map_from_arrays(F.array(F.lit("state"), F.lit("value"), F.lit("event")), F.array(F.col("state").cast("double"), F.col("v"), F.col("event_id").cast("double")))).alias("feature", "x"))
    return ws.select_features(long, "value_state", ["state", "value", "event"]).select("k", "t", "feature", F.col("position").cast("int").alias("position"), "x")


@query("label_inventory", "select distinct case when event_type in ('sil', 'sp', 'sile', 'silsil', 'SP', 's¡p', 'sils') then '' else replace(event_type, '-', '') end as label from events")
def label_inventory(t: Tables) -> DataFrame:
    return t["events"].select(normalise_label("event_type").alias("label")).distinct().orderBy("label")


@query("categorical_features", "select p_partkey as k, " + ", ".join(f"case when p_brand = 'Brand#{b}' then 1 else 0 end as \"b_{b}\"" for b in range(1, 6)) + ", case when p_brand is null then 0 else 0 end as kind, 'brand' as source from part union all select p_partkey, 0, 0, 0, 0, 0, case when p_size > 25 then 1 else 0 end, 'size' from part")
def categorical_features(t: Tables) -> DataFrame:
    part = t["part"].select(F.col("p_partkey").alias("k"), "p_brand", "p_size")
    brand = part.select("k", *[(F.col("p_brand") == f"Brand#{b}").cast("int").alias(f"b_{b}") for b in range(1, 6)], F.lit("brand").alias("source"))
    size = part.select("k", (F.col("p_size") > 25).cast("int").alias("kind"), F.lit("size").alias("source"))
    return brand.unionByName(size, allowMissingColumns=True).fillna(0).select("k", *[f"b_{b}" for b in range(1, 6)], "kind", "source")


@query("scan_trials", f'with {C} select cast(k % 10 as bigint) as session, cast(turn as bigint) as trial, cast(speaker as bigint) as channel, start_s as start, end_s as "end", \'turn \' || turn as text from C where k % 10 in (1, 4) and turn < 4')
def scan_trials(t: Tables) -> DataFrame:
    """Files of sessions, trials and channels, of which filters choose some before they are opened."""
    path = f"{ws.work_folder(t.spark)}/trials-{uuid.uuid4().hex}"
    save_trials(t.c.select((F.col("k") % 10).alias("session"), F.col("turn").alias("trial"), F.col("speaker").alias("channel"), F.col("start_s").alias("start"), F.col("end_s").alias("end"), F.format_string("turn %d", "turn").alias("text")), path)
    return read_trials(t.spark, path).where("session in (1, 4) and trial < 4")


@query("cached_partitions", f"with {E}, {L} select 'events' as part, cast(k as bigint) as k, count(*) as n from E group by k union all select 'lineitem', cast(k as bigint), count(*) from L group by k")
def cached_partitions(t: Tables) -> DataFrame:
    """Tables kept beside what they were built from; the second call finds both as they are."""
    path = f"{ws.work_folder(t.spark)}/cached-{uuid.uuid4().hex}"
    tables = {"events": lambda: t.e, "lineitem": lambda: t.l}
    for _ in range(2):
        found = ws.cached_partitions(t.spark, path, {n: [f"{t.folder}/{n}.parquet"] for n in tables}, lambda n: tables[n]().groupBy("k").agg(F.count("*").alias("n")))
    return found.select("part", "k", "n")
