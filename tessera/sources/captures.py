"""Nested capture files to flow rows.

A capture member is one JSON object ``{flow id: {container: {series name: [numbers]}}}``; the container is called
packet_data, packet_series or packets, and the folder the member lies in names the application.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tessera.session import scratch_path

# fixed values: names of the container that holds a flow's series, in order of preference
CONTAINERS = ["packet_data", "packet_series", "packets"]
MEMBER = "MAP<STRING, STRUCT<" + ", ".join(f"{c}: MAP<STRING, ARRAY<DOUBLE>>" for c in CONTAINERS) + ">>"

# fixed values: series names seen in the releases, in order of preference
LENGTH_SERIES = ["l4_payload_bytes", "packet_length", "l4_payload_len", "payload_len"]
GAP_SERIES = ["iat", "inter_arrival", "timestamp", "time"]
HEADER_SERIES = "L4_header_bytes"


def read_members(spark: SparkSession, path: str) -> DataFrame:
    """One row per member: its path, the folder as label, its size and the parsed object.

    Only the listed series are parsed; raw payloads never leave the scan.
    """
    raw = spark.read.option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").text(path)
    raw = raw.select("value", F.col("_metadata.file_path").alias("file_path"))
    folder = F.element_at(F.split("file_path", "/"), -2)
    return raw.select("file_path", F.regexp_replace(folder, "^app=", "").alias("label"), F.octet_length("value").alias("bytes"),
                      F.from_json("value", MEMBER).alias("flows"))


def series_of(flow: Column) -> Column:
    return F.coalesce(*[flow[c] for c in CONTAINERS])


def _series(data: Column, names: Sequence[str]) -> Column:
    """First series whose lower-cased name contains a wanted name, by preference."""
    keys = F.map_keys(data)
    hits = [F.try_element_at(F.filter(keys, lambda k: F.contains(F.lower(k), F.lit(n))), F.lit(1)) for n in names]
    return F.try_element_at(data, F.coalesce(*hits))


def _median(arr: Column) -> Column:
    s = F.array_sort(arr)
    n = F.size(s)
    return (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.ceil((n + 1) / 2).cast("int"))) / 2


def reduce_flows(members: DataFrame, max_packets: int = 20, min_packets: int = 5, max_per_member: int | None = None, udp_only: bool = True) -> DataFrame:
    """Padded lengths and gaps, validity mask and transport flag per flow."""
    f = members.select("file_path", "label", F.explode("flows").alias("flow_id", "rec")).select("file_path", "label", "flow_id", series_of(F.col("rec")).alias("d"))
    f = f.select("file_path", "label", "flow_id", _series(F.col("d"), LENGTH_SERIES).alias("l"), _series(F.col("d"), GAP_SERIES).alias("t"),
                 F.try_element_at("d", F.lit(HEADER_SERIES)).alias("hdr"))
    f = f.withColumn("n", F.least(F.size("l"), F.size("t"))).filter(F.col("l").isNotNull() & F.col("t").isNotNull() & (F.col("n") >= min_packets))
    f = f.withColumns({"l": F.transform(F.slice("l", F.lit(1), F.col("n")), F.abs), "t": F.slice("t", F.lit(1), F.col("n"))})
    f = f.filter(F.size(F.filter("l", lambda v: v != 0)) >= min_packets)
    udp = F.when(F.size(F.coalesce("hdr", F.array())) > 0, _median(F.slice("hdr", F.lit(1), F.col("n"))) == 8).otherwise(True)
    f = f.withColumn("is_udp", udp)
    if udp_only:
        f = f.filter("is_udp")
    f = f.withColumn("gaps", normalised_gaps(F.col("t")))
    if max_per_member is not None:
        w = Window.partitionBy("file_path").orderBy("flow_id")
        f = f.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= max_per_member)
    take = F.least(F.col("n"), F.lit(max_packets))
    pad = lambda c, zero: F.slice(F.concat(F.slice(c, F.lit(1), take), F.array_repeat(F.lit(zero), max_packets)), 1, max_packets)
    return f.select("file_path", "label", "flow_id", pad("l", 0.0).alias("lengths"), pad("gaps", 0.0).alias("gaps"),
                    F.concat(F.array_repeat(F.lit(True), take), F.array_repeat(F.lit(False), max_packets - take)).alias("mask"), "is_udp")


def normalised_gaps(t: Column) -> Column:
    """Rising series that start above 1e6 are clock times and are differenced; the first gap is 0."""
    n = F.size(t)
    steps = F.zip_with(F.slice(t, F.lit(2), n - 1), F.slice(t, F.lit(1), n - 1), lambda a, b: a - b)
    clock = F.forall(steps, lambda d: d >= 0) & (F.element_at(t, 1) > 1e6)
    tail = F.when(clock, steps).otherwise(F.slice(t, F.lit(2), n - 1))
    return F.concat(F.array(F.lit(0.0)), F.transform(tail, F.abs))


def reconnaissance(members: DataFrame) -> DataFrame:
    """Members, bytes and flows per folder, and the series names found."""
    keys = F.explode_outer(F.flatten(F.transform(F.map_values("flows"), lambda r: F.map_keys(series_of(r)))))
    head = members.groupBy("label").agg(F.count(F.lit(1)).alias("members"), F.sum("bytes").alias("bytes"), F.sum(F.size("flows")).alias("flows"))
    names = members.select("label", keys.alias("k")).distinct().groupBy("label").agg(F.array_join(F.sort_array(F.collect_list("k")), ",").alias("series"))
    return head.join(names, "label")


def global_codes(shards: DataFrame) -> DataFrame:
    """One code per label over all shards, by sorted name; the name list is as small as the folder list."""
    names = shards.select("label").distinct()
    codes = names.withColumn("label_code", F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy("label")) - 1)
    return shards.join(codes, "label")


def store_shards(reduced: DataFrame, n_shards: int, path: str | None = None) -> DataFrame:
    """Write reduced flows as Parquet partitioned by shard and read them back as one corpus."""
    spark = reduced.sparkSession
    path = path or scratch_path(spark, "reduced")
    shard = F.pmod(F.xxhash64("file_path"), F.lit(n_shards)).cast("int")
    reduced.withColumn("shard", shard).write.mode("overwrite").partitionBy("shard").parquet(path)
    return global_codes(spark.read.parquet(path))


def pad_flows(df: DataFrame, lengths: Column, gaps: Column, width: int, *keep: str) -> DataFrame:
    """Shorter flows in the same padded and masked form."""
    n = F.size(lengths)
    pad = lambda c: F.slice(F.concat(c, F.array_repeat(F.lit(0.0), width)), 1, width)
    return df.select(*keep, pad(lengths).alias("lengths"), pad(gaps).alias("gaps"),
                     F.concat(F.array_repeat(F.lit(True), n), F.array_repeat(F.lit(False), width - n)).alias("mask"))
