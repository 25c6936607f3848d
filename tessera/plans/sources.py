"""Registered source queries: flow files and capture files written from the flow view and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import flows
from tessera.plans.registry import register
from tessera.session import scratch_path
from tessera.sources import captures, files
from tessera.vocabulary import APPS


@register("s01_flow_file", "f_flow f_label", """
select count(*) as n_rows, count(*) filter (flow_id%97=0) as unknown_labels, count(*) filter (flow_id%89=0) as t0_not_zero, cast(0 as bigint) as null_cells from f_flow where split='train'""")
def _(t):
    c = F.col
    df = t.train.withColumn("label", F.when(c("flow_id") % 97 == 0, "zoom_Voice").otherwise(flows.label_text(c("label_id"))))
    df = df.withColumn("relative_time_0", F.when(c("flow_id") % 89 == 0, 0.25).otherwise(c("relative_time_0")))
    path = scratch_path(t.spark, "flows")
    files.write_flow_csv(df, path)
    return files.flow_violations(files.read_flow_csv(t.spark, path))


def write_captures(t) -> str:
    """Capture members per application folder; a member holds at most 50 flows of one user."""
    c = F.col
    at = lambda i: F.element_at("packets", i)
    tm = lambda i: (at(i)["us"] - c("us0")).cast("double") / 1e13
    lens = F.array(*[at(i)["length"] for i in range(1, 6)])
    clock = F.array(*[F.lit(1.6e9) + tm(i) for i in range(1, 6)])
    iat = F.array(F.lit(0.0), *[tm(i) - tm(i - 1) for i in range(2, 6)])
    cut = F.when(c("flow_id") % 7 == 0, 2).otherwise(5)
    first = at(1)["event_type"]
    label_id = (c("user_id") % 5) * 2 + F.when(first.isin("click", "view"), 1).otherwise(0)
    hdr = F.array_repeat(F.when(c("user_id") % 4 != 0, 8.0).otherwise(32.0), 5)
    series = F.map_from_arrays(
        F.array(F.lit("L4_payload_bytes"), F.lit("iat"), F.lit("L4_header_bytes")),
        F.array(F.slice(lens, F.lit(1), cut), F.slice(F.when(c("flow_id") % 9 == 0, clock).otherwise(iat), F.lit(1), cut), F.slice(hdr, F.lit(1), cut)))
    rows = t.flow_arrays.select("flow_id", "user_id", F.floor(c("flow_no") / 50).alias("part"), label_id.alias("label_id"),
                                F.struct(c("flow_id").cast("string").alias("k"), F.struct(*[F.when(c("user_id") % 3 == i, series).alias(n) for i, n in enumerate(captures.CONTAINERS)]).alias("v")).alias("e"))
    app = F.element_at(F.array(*[F.lit(a) for a in APPS]), (F.floor(c("label_id") / 2) + 1).cast("int"))
    members = rows.groupBy("label_id", "user_id", "part").agg(F.to_json(F.map_from_entries(F.collect_list("e"))).alias("value")).select(app.alias("app"), "value")
    path = scratch_path(t.spark, "captures")
    members.write.partitionBy("app").text(path)
    return path


def members(t):
    return captures.read_members(t.spark, write_captures(t))


GAPS = """, k as (select flow_id, user_id, label_id, row_number() over (order by flow_id) as o from f_flow where flow_id%7<>0 and user_id%4<>0),
g as (select p.flow_id, p.idx, p.length, case when p.idx=0 then 0.0 when p.flow_id%9=0 then (1.6e9+p.t)-(1.6e9+q.t) else p.t-q.t end as gap from f_pkt p left join f_pkt q on q.flow_id=p.flow_id and q.idx=p.idx-1)"""


@register("s03_reduced_flows", "f_flow f_label", GAPS + """
select l.app as label, cast(k.flow_id as varchar) as flow_id, string_agg(cast(cast(length as bigint) as varchar), ',' order by idx) || repeat(',0', 15) as lengths, round(sum(gap),6) as gap_sum, 5 as valid
from k join g using (flow_id) join f_label l using (label_id) group by all""")
def _(t):
    r = captures.reduce_flows(members(t))
    return r.select("label", "flow_id", F.array_join(F.transform("lengths", lambda v: v.cast("bigint").cast("string")), ",").alias("lengths"),
                    F.round(F.aggregate("gaps", F.lit(0.0), lambda a, v: a + v), 6).alias("gap_sum"), F.size(F.filter("mask", lambda m: m)).alias("valid"))


@register("s04_transport_filter", "f_flow", "select user_id%4<>0 as is_udp, count(*) as flows from f_flow where flow_id%7<>0 group by 1")
def _(t):
    return captures.reduce_flows(members(t), udp_only=False).groupBy("is_udp").agg(F.count(F.lit(1)).alias("flows"))


@register("s05_normalised_gaps", "f_flow", GAPS + " select cast(flow_id as varchar) as flow_id, idx as pos, round(gap,6) as gap from k join g using (flow_id)")
def _(t):
    r = captures.reduce_flows(members(t))
    return r.select("flow_id", F.posexplode(F.slice("gaps", 1, 5)).alias("pos", "gap")).withColumn("gap", F.round(F.col("gap") + F.lit(0.0), 6))


@register("s06_folder_labels", "f_flow f_label", "select l.app as label, count(*) as flows from f_flow join f_label l using (label_id) where flow_id%7<>0 and user_id%4<>0 group by l.app")
def _(t):
    return captures.reduce_flows(members(t)).groupBy("label").agg(F.count(F.lit(1)).alias("flows"))


@register("s07_reconnaissance", "f_flow f_label", """
select l.app as label, count(distinct (label_id, user_id, flow_no//50)) as members, count(*) as flows, 'L4_header_bytes,L4_payload_bytes,iat' as series from f_flow join f_label l using (label_id) group by l.app""")
def _(t):
    return captures.reconnaissance(members(t)).select("label", "members", "flows", "series")


@register("s08_stored_shards", "f_flow f_label", """
, d as (select l.app as label, flow_id from f_flow join f_label l using (label_id) where flow_id%7<>0 and user_id%4<>0),
u as (select label, cast(dense_rank() over (order by label)-1 as int) as label_code, flow_id from d)
select label, label_code, count(*) as flows, 20 as width from u group by all union all select 'target', -1, count(*), 20 from f_flow""")
def _(t):
    stored = captures.store_shards(captures.reduce_flows(members(t)), 4)
    width = F.max(F.size("lengths")).alias("width")
    corpus = stored.groupBy("label", "label_code").agg(F.count(F.lit(1)).alias("flows"), width)
    target = captures.pad_flows(t.flow, F.array(*flows.lens()), F.array(F.lit(0.0), *flows.gaps()), 20, "flow_id")
    target = target.agg(F.count(F.lit(1)).alias("flows"), width).select(F.lit("target").alias("label"), F.lit(-1).alias("label_code"), "flows", "width")
    return corpus.unionByName(target)
