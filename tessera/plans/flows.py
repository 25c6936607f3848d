"""Registered flow queries: keys, sequences and feature blocks."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tessera.functions.vectors import SUMMARY_NAMES
from tessera.operators import flows, ordered, profile
from tessera.functions.draws import unit_sql
from tessera.plans.registry import register
from tessera.vocabulary import BANDS, BURST_GAPS, FLOW_COLUMNS

R = 6


def rounded(df, keep, names, digits=R):
    return df.select(*keep, *[F.round(F.col(c).cast("double"), digits).alias(c) for c in names])


def sql_round(names, digits=R):
    return ", ".join(f"round(cast({n} as double), {digits}) as {n}" for n in names)


LN = [f"packet_length_{i}" for i in range(5)]
TN = [f"relative_time_{i}" for i in range(5)]
GAP = [f"({TN[i+1]}-{TN[i]})" for i in range(4)]
LIST_L = "[" + ",".join(LN) + "]"
LIST_G = "[" + ",".join(GAP) + "]"


@register("p01_audio_only", "f_flow", f"select flow_id, greatest({','.join(LN)}) < 300 as audio_only from f_flow")
def _(t):
    return flows.audio_only(t.flow).select("flow_id", "audio_only")


@register("p02_label_parts", "f_flow f_label", """
select f.flow_id, l.label, l.app, l.mode, f.label_id // 2 as app_id, f.label_id % 2 as mode_id from f_flow f join f_label l using (label_id)""")
def _(t):
    df = flows.label_parts(t.flow.join(F.broadcast(t.label_dim), "label_id"))
    return df.select("flow_id", "label", "app", "mode", F.floor(F.col("label_id") / 2).cast("int").alias("app_id"),
                     (F.col("label_id") % 2).alias("mode_id"))


@register("p03_inter_arrival", "f_flow", "select flow_id, " + ", ".join(
    f"round({g}, 9) as iat_{i+1}" for i, g in enumerate(GAP)) + " from f_flow")
def _(t):
    df = flows.inter_arrival(t.flow)
    return df.select("flow_id", *[F.round(F.col(f"iat_{i}"), 9).alias(f"iat_{i}") for i in range(1, 5)])


@register("p04_group_key", "f_group", "select flow_id, gkey from f_group")
def _(t):
    return t.grouped.select("flow_id", "gkey")


@register("p05_length_key", "f_flow", """
select flow_id, """ + ", ".join(
    "concat_ws('-', " + ",".join(f"cast(round_even({c}/{2*tol},0)*{2*tol} as bigint)" if tol else f"cast({c} as bigint)" for c in LN) + f") as key_{tol}"
    for tol in (0, 1, 2, 4)) + " from f_flow")
def _(t):
    df = t.flow
    for tol in (0, 1, 2, 4):
        df = flows.flow_key(df, tol, f"key_{tol}")
    text = lambda c: F.array_join(F.col(c).cast("array<bigint>").cast("array<string>"), "-")
    return df.select("flow_id", *[text(f"key_{tol}").alias(f"key_{tol}") for tol in (0, 1, 2, 4)])


@register("w01_first_packets", "", """
with r as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id)-1 as packet_index,
  epoch_us(ts)-min(epoch_us(ts)) over (partition by user_id) as relative_time from events)
select user_id, cast(packet_index as int) as packet_index, event_id, relative_time from r where packet_index < 5""")
def _(t):
    ev = t.table("events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    df = flows.first_packets(ev, "user_id", ["us", "event_id"], "us")
    return df.select("user_id", F.col("packet_index").cast("int").alias("packet_index"), "event_id", "relative_time")


@register("w02_burst_groups", "f_pkt", """
, g as (select flow_id, idx, length, t - lag(t) over (partition by flow_id order by idx) as gap from f_pkt),
th as (select unnest([0.0005, 0.001, 0.005, 0.020]) as threshold),
s as (select g.*, threshold, case when gap >= threshold then 1 else 0 end as st from g, th),
b as (select *, sum(st) over (partition by flow_id, threshold order by idx) as burst from s),
a as (select flow_id, threshold, burst, count(*) as n, sum(length) as bytes, sum(case when st=1 then gap end) as gp from b group by all)
select flow_id, cast(threshold as double) as threshold, count(*) as n_groups, max(n) as group_max_packets, max(bytes) as group_max_bytes,
 round(coalesce(avg(gp),0),9) as group_gap_mean, round(5.0/count(*),6) as packets_per_group from a group by flow_id, threshold""")
def _(t):
    df = flows.burst_table(t.pkt, "flow_id", "idx", "t", "length", BURST_GAPS)
    return df.withColumn("group_gap_mean", F.round("group_gap_mean", 9)).withColumn("packets_per_group", F.round("packets_per_group", 6))


@register("w03_longest_runs", "f_flow", f"""
, th as (select unnest([0.0005, 0.001, 0.005, 0.020]) as threshold, unnest([500,1000,5000,20000]) as us),
r as (select flow_id, us, list_transform({LIST_G}, lambda x: case when x < threshold then '1' else '0' end) as m from f_flow, th),
b as (select flow_id, us, 1 + list_max(list_transform(string_split(array_to_string(m,''), '0'), lambda s: length(s))) as v from r),
st as (select flow_id, [sign(packet_length_1-packet_length_0), sign(packet_length_2-packet_length_1), sign(packet_length_3-packet_length_2), sign(packet_length_4-packet_length_3)] as s from f_flow),
mono as (select flow_id, list_max(list_transform([[1,1],[1,2],[1,3],[1,4],[2,2],[2,3],[2,4],[3,3],[3,4],[4,4]], lambda w:
  case when w[1]=w[2] or (s[w[1]]<>0 and len(list_distinct(s[w[1]:w[2]]))=1) then w[2]-w[1]+1 else 0 end)) as mono from st)
select flow_id, cast(mono as double) as len_longest_monotone, {", ".join(f"cast(max(case when us={u} then v end) as double) as longest_burst_{u}us" for u in (500,1000,5000,20000))}
from b join mono using (flow_id) group by flow_id, mono""")
def _(t):
    df = flows.burst_block(flows.shape_block(t.flow))
    return df.select("flow_id", "len_longest_monotone", *[f"longest_burst_{u}us" for u in (500, 1000, 5000, 20000)])


@register("w04_rank_lengths", "f_flow", "select flow_id, " + ", ".join(
    f"list_reverse_sort({LIST_L})[{r+1}] as len_rank_{r}" for r in range(5)) + " from f_flow")
def _(t):
    return flows.rank_lengths(t.flow, "flow_id")


@register("w05_duration_ecdf", "f_flow", """
select distinct label_id, round(relative_time_4,9) as duration, round(cume_dist() over (partition by label_id order by relative_time_4),9) as ecdf from f_flow where split='train'""")
def _(t):
    df = profile.ecdf(t.train, ["label_id"], "relative_time_4")
    return df.select("label_id", F.round("relative_time_4", 9).alias("duration"), F.round("ecdf", 9).alias("ecdf")).distinct()


@register("w13_position_shares", "f_pkt", """
, g as (select flow_id, idx, length, t, coalesce(t - lag(t) over w, 0) as gap, greatest(max(t) over (partition by flow_id),1e-9) as span, sum(length) over (partition by flow_id) as tot
  from f_pkt window w as (partition by flow_id order by idx))
select flow_id, idx as packet_index, round(t/span,6) as time_share, round(gap/span,6) as gap_share, round(length/tot,6) as byte_share from g""")
def _(t):
    return rounded(flows.position_shares(t.flow, "flow_id"), ["flow_id", "packet_index"], ["time_share", "gap_share", "byte_share"])


# ---- feature blocks --------------------------------------------------------------------------

def _stats_sql(lst: str, p: str) -> list[str]:
    """Independent form of the thirteen statistics with list aggregates."""
    ag = lambda f, *a: f"list_aggregate({lst}, '{f}'{''.join(', ' + str(x) for x in a)})"
    return [f"list_min({lst}) as {p}_min", f"list_max({lst}) as {p}_max", f"{ag('avg')} as {p}_mean",
            f"{ag('stddev_pop')} as {p}_std", f"{ag('quantile_cont', 0.5)} as {p}_median",
            f"{ag('quantile_cont', 0.25)} as {p}_q25", f"{ag('quantile_cont', 0.75)} as {p}_q75",
            f"{ag('quantile_cont', 0.75)} - {ag('quantile_cont', 0.25)} as {p}_iqr",
            f"list_max({lst}) - list_min({lst}) as {p}_range", f"list_sum({lst}) as {p}_sum",
            f"{ag('stddev_pop')} / (abs({ag('avg')}) + 1e-9) as {p}_cv",
            f"case when len(list_distinct({lst}))=1 then 0 else coalesce({ag('skewness')},0) end as {p}_skew",
            f"case when len(list_distinct({lst}))=1 then 0 else coalesce({ag('kurtosis')},0) end as {p}_kurt"]


def stat_names(p):
    return [f"{p}_{s}" for s in SUMMARY_NAMES]


F01 = [n for i in range(5) for n in (f"len_{i}", f"log_len_{i}", f"t_{i}", f"log_t_{i}")]


@register("f01_raw_block", "f_flow", "select flow_id, " + ", ".join(
    f"round({LN[i]},6) as len_{i}, round(ln(1+{LN[i]}),6) as log_len_{i}, round({TN[i]},6) as t_{i}, round(ln(1+{TN[i]}),6) as log_t_{i}" for i in range(5)) + " from f_flow")
def _(t):
    return rounded(flows.raw_block(t.flow), ["flow_id"], F01)


F02 = [n for i in range(1, 5) for n in (f"iat_{i}", f"log_iat_{i}", f"iat_frac_{i}", f"tfrac_{i}")] + stat_names("iat") + ["duration", "log_duration"]


@register("f02_arrival_block", "f_flow", f"""
, x as (select *, {LIST_G} as d from f_flow),
s as (select flow_id, {", ".join(f"{GAP[i]} as iat_{i+1}, ln(1+{GAP[i]}) as log_iat_{i+1}, {GAP[i]}/(relative_time_4+1e-9) as iat_frac_{i+1}, {TN[i+1]}/(relative_time_4+1e-9) as tfrac_{i+1}" for i in range(4))},
 {", ".join(_stats_sql("d", "iat"))}, relative_time_4 as duration, ln(1+relative_time_4) as log_duration from x)
select flow_id, {sql_round(F02, 5)} from s""")
def _(t):
    return rounded(flows.arrival_block(t.flow), ["flow_id"], F02, 5)


F02B = stat_names("logiat")


@register("f02_log_arrival_stats", "f_flow", f"""
, x as (select *, list_transform({LIST_G}, lambda v: ln(1+v)) as d from f_flow), s as (select flow_id, {", ".join(_stats_sql("d", "logiat"))} from x)
select flow_id, {sql_round(F02B, 5)} from s""")
def _(t):
    return rounded(flows.arrival_block(t.flow), ["flow_id"], F02B, 5)


F03 = stat_names("len") + ["len_n_distinct", "len_all_equal", "len_argmax", "len_argmin", "len_entropy"]


@register("f03_length_block", "f_flow", f"""
, x as (select *, {LIST_L} as d from f_flow),
e as (select flow_id, -sum(n/5.0*ln(n/5.0))/ln(5) as len_entropy from (select flow_id, length, count(*) as n from f_pkt group by all) group by flow_id),
s as (select flow_id, {", ".join(_stats_sql("d", "len"))}, len(list_distinct(d)) as len_n_distinct, case when len(list_distinct(d))=1 then 1 else 0 end as len_all_equal,
  list_position(d, list_max(d))-1 as len_argmax, list_position(d, list_min(d))-1 as len_argmin, len_entropy from x join e using (flow_id))
select flow_id, {sql_round(F03, 5)} from s""")
def _(t):
    return rounded(flows.length_block(t.flow), ["flow_id"], F03, 5)


F04 = ([n for i in range(5) for j in range(i + 1, 5) for n in (f"len_diff_{i}{j}", f"len_ratio_{i}{j}")]
       + [n for i in range(1, 5) for n in (f"len_step_{i}", f"len_step_sign_{i}")]
       + ["len_n_increase", "len_n_decrease", "len_n_equal_step"]
       + [n for i in range(5) for n in (f"len_over_first_{i}", f"len_over_max_{i}")]
       + ["len_trend_slope", "len_trend_r2", "bytes_time_slope", "bytes_time_r2"])


@register("f04_shape_block", "f_flow", f"""
, c as (select flow_id, idx, length, t, sum(length) over (partition by flow_id order by idx) as cum from f_pkt),
m as (select flow_id, avg(idx) as mi, avg(length) as ml, avg(t) as mt, avg(cum) as mc from c group by flow_id),
q as (select flow_id, sum((idx-mi)*(length-ml)) as sxy, sum((idx-mi)*(idx-mi)) as sxx, sum((length-ml)*(length-ml)) as syy,
  sum((t-mt)*(cum-mc)) as bxy, sum((t-mt)*(t-mt)) as bxx, sum((cum-mc)*(cum-mc)) as byy from c join m using (flow_id) group by flow_id),
s as (select flow_id, {", ".join(f"{LN[j]}-{LN[i]} as len_diff_{i}{j}, {LN[j]}/({LN[i]}+1e-9) as len_ratio_{i}{j}" for i in range(5) for j in range(i+1,5))},
 {", ".join(f"{LN[i]}-{LN[i-1]} as len_step_{i}, sign({LN[i]}-{LN[i-1]}) as len_step_sign_{i}" for i in range(1,5))},
 {"+".join(f"(case when {LN[i]}>{LN[i-1]} then 1 else 0 end)" for i in range(1,5))} as len_n_increase,
 {"+".join(f"(case when {LN[i]}<{LN[i-1]} then 1 else 0 end)" for i in range(1,5))} as len_n_decrease,
 {"+".join(f"(case when {LN[i]}={LN[i-1]} then 1 else 0 end)" for i in range(1,5))} as len_n_equal_step,
 {", ".join(f"{LN[i]}/({LN[0]}+1e-9) as len_over_first_{i}, {LN[i]}/(greatest({','.join(LN)})+1e-9) as len_over_max_{i}" for i in range(5))},
 sxy/(sxx+1e-9) as len_trend_slope, sxy*sxy/(sxx*syy+1e-9) as len_trend_r2, bxy/(bxx+1e-9) as bytes_time_slope, bxy*bxy/(bxx*byy+1e-9) as bytes_time_r2
 from f_flow join q using (flow_id))
select flow_id, {sql_round(F04, 4)} from s""")
def _(t):
    return rounded(flows.shape_block(t.flow), ["flow_id"], F04, 4)


F05 = ([f"{p}_{b}" for b in BANDS for p in ("n", "frac", "first_is")] + ["n_len47", "is_constant_keepalive"]
       + [n for m in (4, 8, 16) for n in [f"len_mod{m}_{i}" for i in range(5)] + [f"len_mod{m}_n_zero", f"len_mod{m}_n_distinct"]]
       + ["rtp_payload_mean", "srtp_payload_mean", "first_vs_rest_diff", "first_vs_rest_ratio"])


@register("f05_protocol_block", "f_flow", f"""
, x as (select *, {LIST_L} as d from f_flow),
s as (select flow_id, {", ".join(f"len(list_filter(d, lambda v: v>={lo} and v<{hi})) as n_{b}, len(list_filter(d, lambda v: v>={lo} and v<{hi}))/5.0 as frac_{b}, case when d[1]>={lo} and d[1]<{hi} then 1 else 0 end as first_is_{b}" for b,(lo,hi) in BANDS.items())},
 len(list_filter(d, lambda v: v=47)) as n_len47, case when len(list_distinct(d))=1 and d[1]<100 then 1 else 0 end as is_constant_keepalive,
 {", ".join(", ".join(f"d[{i+1}] % {m} as len_mod{m}_{i}" for i in range(5)) + f", len(list_filter(d, lambda v: v%{m}=0)) as len_mod{m}_n_zero, len(list_distinct(list_transform(d, lambda v: v%{m}))) as len_mod{m}_n_distinct" for m in (4,8,16))},
 list_avg(list_transform(d, lambda v: greatest(v-12,0))) as rtp_payload_mean, list_avg(list_transform(d, lambda v: greatest(v-22,0))) as srtp_payload_mean,
 d[1]-list_avg(d[2:5]) as first_vs_rest_diff, d[1]/(list_avg(d[2:5])+1e-9) as first_vs_rest_ratio from x)
select flow_id, {sql_round(F05, 6)} from s""")
def _(t):
    return rounded(flows.protocol_block(t.flow), ["flow_id"], F05)


F06N = ["n_iat_below", "frac_iat_below", "n_groups", "group_max_packets", "group_max_bytes", "group_gap_mean", "packets_per_group"]
TAGS = {500: 0.0005, 1000: 0.001, 5000: 0.005, 20000: 0.02}


@register("f06_burst_block", "f_pkt", """
, g as (select flow_id, idx, length, t - lag(t) over (partition by flow_id order by idx) as gap from f_pkt),
th as (select unnest([0.0005, 0.001, 0.005, 0.020]) as threshold, unnest([500,1000,5000,20000]) as us),
s as (select g.*, us, case when gap >= threshold then 1 else 0 end as st, case when gap < threshold then 1 else 0 end as bl from g, th),
b as (select *, sum(st) over (partition by flow_id, us order by idx) as burst from s),
a as (select flow_id, us, burst, count(*) as n, sum(length) as bytes, sum(case when st=1 then gap end) as gp, sum(bl) as bl from b group by all),
r as (select flow_id, us, sum(bl) as n_iat_below, sum(bl)/4.0 as frac_iat_below, count(*) as n_groups, max(n) as group_max_packets, max(bytes) as group_max_bytes,
  coalesce(avg(gp),0) as group_gap_mean, 5.0/count(*) as packets_per_group from a group by flow_id, us)
select flow_id, """ + ", ".join(f"round(cast(max(case when us={u} then {n} end) as double), 6) as {n}_{u}us" for u in TAGS for n in F06N) + " from r group by flow_id")
def _(t):
    return rounded(flows.burst_block(t.flow), ["flow_id"], [f"{n}_{u}us" for u in TAGS for n in F06N])


F07 = ["total_bytes", "bytes_per_sec", "packets_per_sec", "log_bytes_per_sec"]
F07S = stat_names("log_inst_rate") + [f"inst_rate_{s}" for s in ("skew", "kurt", "cv")]
F07R = [f"inst_rate_{s}" for s in ("min", "max", "mean", "std", "median", "q25", "q75", "iqr", "range", "sum")]


@register("f07_rate_block", "f_flow", f"""
, x as (select *, [{",".join(f"{LN[i+1]}/({GAP[i]}+1e-9)" for i in range(4))}] as d from f_flow),
z as (select *, list_transform(d, lambda v: ln(1+v)) as ld, {"+".join(LN)} as total_bytes from x),
s as (select flow_id, {", ".join(_stats_sql("d", "inst_rate"))}, {", ".join(_stats_sql("ld", "log_inst_rate"))}, total_bytes, total_bytes/(relative_time_4+1e-9) as bytes_per_sec,
 5/(relative_time_4+1e-9) as packets_per_sec, ln(1+total_bytes/(relative_time_4+1e-9)) as log_bytes_per_sec from z)
select flow_id, {sql_round(F07 + F07S + F07R, 3)} from s""")
def _(t):
    return rounded(flows.rate_block(t.flow), ["flow_id"], F07 + F07S + F07R, 3)


F08 = [f"len_dct_{k}" for k in range(5)] + [f"logiat_dct_{k}" for k in range(4)] + [f"len_fftmag_{k}" for k in range(3)]


def _dct_sql(values, n, k):
    scale = f"sqrt({1 if k == 0 else 2}/{n}.0)"
    return scale + "*(" + "+".join(f"{v}*cos(pi()*{2*i+1}*{k}/{2*n})" for i, v in enumerate(values)) + ")"


@register("f08_spectral_block", "f_flow", "select flow_id, " + ", ".join(
    [f"round({_dct_sql(LN, 5, k)},5) as len_dct_{k}" for k in range(5)]
    + [f"round({_dct_sql([f'ln(1+{g})' for g in GAP], 4, k)},5) as logiat_dct_{k}" for k in range(4)]
    + ["round(sqrt(power(" + "+".join(f"{v}*cos(2*pi()*{k}*{i}/5)" for i, v in enumerate(LN)) + ",2)+power("
       + "+".join(f"{v}*sin(2*pi()*{k}*{i}/5)" for i, v in enumerate(LN)) + f",2)),5) as len_fftmag_{k}" for k in range(3)]) + " from f_flow")
def _(t):
    df = rounded(flows.spectral_block(t.flow), ["flow_id"], F08, 5)
    # an exact zero may come out as -0.0
    return df.select("flow_id", *[(F.col(c) + F.lit(0.0)).alias(c) for c in F08])


F09 = (LN + TN[1:] + [f"delta_len_{i}" for i in range(1, 5)] + [f"delta_t_{i}" for i in range(1, 5)] + [f"len_rank_{r}" for r in range(5)]
       + ["argmax_pos", "argmin_pos", "len_range", "len_mean", "len_std", "len_median", "total_span", "gp_log_pl3", "jump_pos"])


@register("f09_compact_features", "f_flow", f"""
, x as (select *, {LIST_L} as d, [{",".join(f"{LN[i]}-{LN[i-1]}" for i in range(1,5))}] as s from f_flow),
r as (select flow_id, {",".join(LN)}, {",".join(TN[1:])}, {", ".join(f"s[{i}] as delta_len_{i}" for i in range(1,5))}, {", ".join(f"{GAP[i-1]} as delta_t_{i}" for i in range(1,5))},
 {", ".join(f"list_reverse_sort(d)[{k+1}] as len_rank_{k}" for k in range(5))}, list_position(d, list_max(d))-1 as argmax_pos, list_position(d, list_min(d))-1 as argmin_pos,
 list_max(d)-list_min(d) as len_range, list_avg(d) as len_mean, list_aggregate(d,'stddev_pop') as len_std, list_median(d) as len_median, relative_time_4-relative_time_0 as total_span,
 ln(greatest(packet_length_3,1)) as gp_log_pl3, list_position(s, list_max(s)) as jump_pos from x)
select flow_id, {sql_round(F09)} from r""")
def _(t):
    return rounded(flows.compact_features(t.flow, ["flow_id"]), ["flow_id"], F09)


F10 = ["log_len", "rel_len", "log_gap_ms", "time_share", "gap_share", "sub_ms", "is_mtu", "is_small"]


@register("f10_packet_descriptors", "f_pkt", f"""
, e as (select distinct cast(round_even(20*power(70.0, i/23.0),0) as int) as edge from (select unnest(range(24)) as i)),
b as (select length, (select count(*) from e where edge <= length) as size_bin from (select distinct length from f_pkt)),
g as (select flow_id, idx, length, t, coalesce(t - lag(t) over (partition by flow_id order by idx),0) as gap, greatest(max(t) over (partition by flow_id),1e-9) as span from f_pkt),
r as (select flow_id, idx as packet_index, ln(1+length)/7.5 as log_len, length/1500 as rel_len, ln(1+gap*1000) as log_gap_ms, t/span as time_share, gap/span as gap_share,
 case when gap<1e-3 then 1 else 0 end as sub_ms, case when length>=1100 then 1 else 0 end as is_mtu, case when length<100 then 1 else 0 end as is_small, size_bin from g join b using (length))
select flow_id, packet_index, size_bin, {sql_round(F10)} from r""")
def _(t):
    df = flows.packet_descriptors(t.flow, "flow_id")
    return rounded(df, ["flow_id", "packet_index", F.col("size_bin").cast("bigint").alias("size_bin")], F10)


@register("f11_auxiliary_targets", "f_pkt", """
, g as (select flow_id, idx, length, coalesce(t - lag(t) over (partition by flow_id order by idx),0) as gap from f_pkt),
a as (select flow_id, sum(length) as b, greatest(sum(gap),1e-9) as span, avg(case when length>=1100 then 1.0 else 0 end) as mtu,
  avg(case when idx>0 then case when gap<1e-3 then 1.0 else 0.0 end end) as sub, avg(case when idx>0 then gap end) as mg,
  avg(case when length%2=0 then 1.0 else 0 end) as d2, avg(case when length%4=0 then 1.0 else 0 end) as d4, avg(case when length%8=0 then 1.0 else 0 end) as d8, avg(case when length%16=0 then 1.0 else 0 end) as d16 from g group by flow_id)
select flow_id, round(ln(1+b/span),6) as log_bitrate, round(ln(1+mg*1000),6) as log_mean_gap, round(mtu,6) as frac_mtu, cast(case when mtu>0.2 and sub>0.4 then 1 else 0 end as int) as video_like,
 cast(list_position([d2,d4,d8,d16], greatest(d2,d4,d8,d16))-1 as int) as padding_class,
 cast((case when d2>=0.8 then 1 else 0 end)+(case when d4>=0.8 then 1 else 0 end)+(case when d8>=0.8 then 1 else 0 end)+(case when d16>=0.8 then 1 else 0 end) as int) as alignment_level from a""")
def _(t):
    arr = t.flow.select("flow_id", F.array(*flows.lens()).alias("x"), F.array(F.lit(0.0), *flows.gaps()).alias("g"))
    df = flows.auxiliary_targets(arr, "x", "g", "flow_id")
    return df.withColumns({c: F.round(c, 6) for c in ("log_bitrate", "log_mean_gap", "frac_mtu")})


def _jitter_sql() -> str:
    draw = lambda n: unit_sql(7000 + n, "flow_id")
    gap = lambda i: f"(relative_time_{i} - relative_time_{i - 1}) * (0.9 + 0.2 * {draw(10 + i)})"
    rows = [f"""select flow_id, {i} as packet_index, {" + ".join(["0.0"] + [gap(j) for j in range(1, i + 1)])} as relative_time,
 greatest(packet_length_{i} + cast(floor({draw(20 + i)} * 5) as bigint) - 2, 1.0) as length, {draw(30 + i)} >= 0.1 as kept from f_flow where split = 'train'""" for i in range(5)]
    return ", j as (" + " union all ".join(rows) + ") select flow_id, cast(packet_index as int) as packet_index, round(relative_time, 9) as relative_time, cast(length as double) as length, kept from j"


@register("f12_transport_jitter", "f_flow", _jitter_sql())
def _(t):
    return flows.jitter(t.train, 7, "flow_id").withColumn("relative_time", F.round("relative_time", 9))


@register("s09_feature_cache", "f_group", """
select count(*) as n_rows, cast(241 as bigint) as n_features, count(distinct gkey) as n_groups from f_group where split='train'""")
def _(t):
    from tessera.sources.tables import feature_cache
    return feature_cache(t.grouped.filter("split = 'train'"), ["flow_id", "label_id", "gkey"])
