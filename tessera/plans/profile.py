"""Registered profiles and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import flows, profile
from tessera.plans.flows import GAP, LN, TN
from tessera.plans.registry import register

R6 = lambda df, *cols: df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in cols})
TRAIN = "f_flow where split='train'"


@register("a01_integrity", "f_flow", f"""
select count(*) as n_rows, cast(sum({"+".join(f"(case when {c} is null then 1 else 0 end)" for c in LN+TN)}) as bigint) as missing_cells, bool_and(abs(relative_time_0)<=1e-8) as t0_all_zero,
 cast(sum(case when {" or ".join(f"{g}<0" for g in GAP)} then 1 else 0 end) as bigint) as non_monotonic_rows, cast(sum(case when {" or ".join(f"{g}=0" for g in GAP)} then 1 else 0 end) as bigint) as zero_gap_rows,
 min(least({",".join(LN)})) as min_length, max(greatest({",".join(LN)})) as max_length, round(min(relative_time_4),9) as min_duration, round(max(relative_time_4),9) as max_duration from {TRAIN}""")
def _(t):
    df = profile.integrity(t.train)
    return df.withColumns({c: F.round(c, 9) for c in ("min_duration", "max_duration")})


@register("a02_collisions", "f_key", f"""
, k as (select lkey, count(*) as n, count(distinct label_id) as c from f_key where split='train' group by lkey),
d as (select count(*) as u from (select distinct {",".join(LN+TN)} from {TRAIN}))
select (select count(*) from {TRAIN}) - (select u from d) as exact_duplicate_rows, count(*) as unique_length_tuples, count(*) filter (c>1) as length_tuples_multiclass, cast(coalesce(sum(n) filter (c>1),0) as bigint) as rows_in_multiclass_tuples from k""")
def _(t):
    return profile.collisions(t.keyed.filter("split = 'train'"))


@register("a02_class_mix", "f_key", "select lkey, " + ", ".join(f"count(*) filter (label_id={k}) as c{k}" for k in range(10))
          + " from f_key where split='train' group by lkey having count(distinct label_id)>1")
def _(t):
    df = profile.class_mix(t.keyed.filter("split = 'train'"))
    return df.withColumn("lkey", F.array_join(F.transform("lkey", lambda v: v.cast("string")), "-"))


@register("a03_group_sizes", "f_group", """
, g as (select gkey, count(*) as n from f_group where split='train' group by gkey)
select count(*) as n_pseudo_groups, max(n) as largest_group, cast(sum(case when n>1 then n else 0 end) as bigint) as rows_in_groups_gt1, round(sum(case when n>1 then n else 0 end)/sum(n),6) as share_rows_in_groups_gt1 from g""")
def _(t):
    return R6(profile.group_sizes(t.grouped.filter("split = 'train'")), "share_rows_in_groups_gt1")


PK = "f_pkt join (select flow_id, label_id, split from f_flow) using (flow_id) where split='train'"


@register("a04_frequent_values", "f_flow", f"""
, c as (select label_id, length, count(*) as n from {PK} group by all), top as (select length from c group by length order by sum(n) desc, length limit 60)
select label_id, length, n, round(n/sum(n) over (partition by label_id),6) as share from c where length in (select length from top)""")
def _(t):
    return R6(profile.frequent_values(flows.packet_rows(t.train, "label_id")), "share")


@register("a05_top_values_text", "f_flow", f"""
, c as (select label_id, length, count(*) as n from {PK} group by all), r as (select *, row_number() over (partition by label_id order by n desc, length) as r from c)
select label_id, string_agg(cast(cast(length as bigint) as varchar)||'('||n||')', ', ' order by r) as top_lengths from r where r<=20 group by label_id""")
def _(t):
    return profile.top_values_text(flows.packet_rows(t.train, "label_id"))


@register("a06_band_mix", "f_flow", f"""
select label_id, round(avg(case when length<100 then 1.0 else 0 end),6) as share_tiny, round(avg(case when length>=100 and length<300 then 1.0 else 0 end),6) as share_audio,
 round(avg(case when length>=300 and length<1100 then 1.0 else 0 end),6) as share_mid, round(avg(case when length>=1100 and length<1600 then 1.0 else 0 end),6) as share_mtu from {PK} group by label_id""")
def _(t):
    return R6(profile.band_mix(flows.packet_rows(t.train, "label_id")), "share_tiny", "share_audio", "share_mid", "share_mtu")


@register("a06_mtu_contrast", "f_flow", f"""
, m as (select label_id, avg(case when length>=1100 and length<1600 then 1.0 else 0 end) as s from {PK} group by label_id)
select case when label_id%2=1 then 'video' else 'voice' end as mode, round(avg(s),6) as mean_mtu_share from m group by 1""")
def _(t):
    return R6(profile.mtu_contrast(flows.packet_rows(t.train, "label_id")), "mean_mtu_share")


@register("a07_mean_by_position", "f_flow", "select label_id, " + ", ".join(f"round(avg(packet_length_{i}),6) as pos_{i}" for i in range(5)) + f" from {TRAIN} group by label_id")
def _(t):
    return R6(profile.mean_by_position(flows.packet_rows(t.train, "label_id")), *[f"pos_{i}" for i in range(5)])


@register("a08_constant_flows", "f_flow", f"""
select label_id, count(*) filter (greatest({",".join(LN)})=least({",".join(LN)})) as constant_flows, count(*) as total_flows,
 round(count(*) filter (greatest({",".join(LN)})=least({",".join(LN)}))/count(*),6) as share from {TRAIN} group by label_id""")
def _(t):
    return R6(profile.constant_flows(t.train), "share")


@register("a09_burstiness", "f_gap", """
select label_id, round(avg(case when iat<1e-3 then 1.0 else 0 end),6) as sub_ms, round(avg(case when iat>0.02 then 1.0 else 0 end),6) as over_20ms, round(quantile_cont(iat,0.5),9) as median_iat
from f_gap where flow_id in (select flow_id from f_flow where split='train') group by label_id""")
def _(t):
    df = profile.burstiness(t.train)
    return R6(df, "sub_ms", "over_20ms").withColumn("median_iat", F.round("median_iat", 9))


def _describe_sql(source, value, digits):
    q = ", ".join(f"round(quantile_cont({value},{p}),{digits}) as {n}" for n, p in (("p10", .1), ("p50", .5), ("p90", .9), ("p99", .99)))
    return (f"select label_id, count(*) as count, round(avg({value}),{digits}) as mean, round(stddev_samp({value}),{digits}) as std, "
            f"round(min({value}),{digits}) as min, round(max({value}),{digits}) as max, {q} from {source} group by label_id")


DESC = ["mean", "std", "min", "max", "p10", "p50", "p90", "p99"]


@register("a10_describe_duration", "f_flow", _describe_sql(TRAIN, "relative_time_4", 6))
def _(t):
    return R6(profile.describe(t.train, ["label_id"], "relative_time_4"), *DESC)


@register("a10_describe_rate", "f_flow", _describe_sql(
    "(select label_id, unnest([" + ",".join(f"packet_length_{i+1}/({GAP[i]}+1e-9)" for i in range(4)) + f"]) as rate from {TRAIN})", "rate", 2))
def _(t):
    x, g = flows.lens(), flows.gaps()
    rate = t.train.select("label_id", F.explode(F.array(*[x[i + 1] / (g[i] + 1e-9) for i in range(4)])).alias("rate"))
    return profile.describe(rate, ["label_id"], "rate").withColumns({c: F.round(c, 2) for c in DESC})


@register("a10_describe_focus_lengths", "f_flow", "select feature, label_id, count(*) as count, round(avg(value),6) as mean, round(stddev_samp(value),6) as std, min(value) as min, max(value) as max, "
          "round(quantile_cont(value,0.1),6) as p10, round(quantile_cont(value,0.5),6) as p50, round(quantile_cont(value,0.9),6) as p90 from ("
          f"select label_id, unnest(['len_max','len_min','len_mean']) as feature, unnest([greatest({','.join(LN)}), least({','.join(LN)}), ({'+'.join(LN)})/5]) as value from {TRAIN} and label_id//2=4) group by feature, label_id")
def _(t):
    x = flows.lens()
    d = t.train.filter(F.floor(F.col("label_id") / 2) == profile.APP).select(
        "label_id", F.greatest(*x).alias("len_max"), F.least(*x).alias("len_min"), (sum(x[1:], x[0]) / 5).alias("len_mean"))
    long = profile.long_features(d, ["len_max", "len_min", "len_mean"], "label_id")
    return R6(profile.describe(long, ["feature", "label_id"], "value", {"p10": .1, "p50": .5, "p90": .9}), "mean", "std", "min", "max", "p10", "p50", "p90")


PRIOR = f"""select l.label_id, count(f.flow_id) as flows, count(f.flow_id)/40.0 as fpc, count(f.flow_id)/40.0*10 as itf from f_label l left join (select * from {TRAIN}) f using (label_id) group by l.label_id"""


@register("a11_class_prior", "f_flow f_label", f"""
, p as ({PRIOR}) select label_id, flows, round(cast(fpc as double),6) as flows_per_call, round(cast(itf as double),6) as implied_test_flows, round(itf/sum(itf) over (),6) as implied_test_share from p""")
def _(t):
    return R6(profile.class_prior(t.train), "flows_per_call", "implied_test_flows", "implied_test_share")


@register("a12_mix_against_prior", "f_pred_label f_label", f"""
, p as ({PRIOR}), q as (select l.label_id, count(x.row_id) as pf from f_label l left join (select p.row_id, p.pred from f_pred_label p join f_flow f on f.flow_id=p.row_id where model='a' and split='test') x on x.pred=l.label_id group by l.label_id),
j as (select label_id, pf, pf/sum(pf) over () as ps, itf/sum(itf) over () as prs from p join q using (label_id))
select label_id, pf as predicted_flows, round(ps,6) as predicted_share, round(prs,6) as prior_share, round(ps/prs,6) as ratio from j""")
def _(t):
    from tessera.operators.evaluate import argmax_rows
    pred = argmax_rows(t.prob_rows.filter("model = 'a'")).select(F.col("row_id").alias("flow_id"), F.col("pred").alias("label_id"))
    pred = pred.join(t.test.select("flow_id"), "flow_id", "left_semi")
    return R6(profile.mix_against_prior(pred, t.train), "predicted_share", "prior_share", "ratio")


KS_LONG = "(select split, unnest([" + ",".join(f"'{c}'" for c in LN + TN) + "]) as feature, unnest([" + ",".join(LN + TN) + "]) as value from f_flow)"


@register("a13_ks_statistic", "f_flow", f"""
, l as (select * from {KS_LONG}), v as (select feature, value, count(*) filter (split='train') as a, count(*) filter (split='test') as b from l group by all),
c as (select feature, sum(a) over w / sum(a) over (partition by feature) as fa, sum(b) over w / sum(b) over (partition by feature) as fb from v window w as (partition by feature order by value))
select feature, round(max(abs(fa-fb)),9) as ks_stat from c group by feature""")
def _(t):
    df = profile.ks_statistic(t.flow, LN + TN, F.col("split") == "train")
    return df.select("feature", F.round("ks_stat", 9).alias("ks_stat"))


@register("a13_ks_p_value", "f_flow", f"""
, l as (select * from {KS_LONG}), v as (select feature, value, count(*) filter (split='train') as a, count(*) filter (split='test') as b from l group by all),
c as (select feature, sum(a) over w / sum(a) over (partition by feature) as fa, sum(b) over w / sum(b) over (partition by feature) as fb, sum(a) over (partition by feature) as na, sum(b) over (partition by feature) as nb from v window w as (partition by feature order by value)),
s as (select feature, max(abs(fa-fb))*sqrt(any_value(na)*any_value(nb)/(any_value(na)+any_value(nb))) as lam from c group by feature)
select feature, round(case when lam<0.2 then 1.0 else greatest(0.0, least(1.0, list_sum(list_transform(range(1,101), lambda j: (case when j%2=1 then 2.0 else -2.0 end)*exp(-2.0*j*j*lam*lam))))) end, 6) as p_value from s""")
def _(t):
    df = profile.ks_p_value(profile.ks_statistic(t.flow, LN + TN, F.col("split") == "train"))
    return df.select("feature", F.round("p_value", 6).alias("p_value"))


@register("a20_regimes", "f_pred_label", f"""
, j as (select p.pred, p.y, greatest({",".join(LN)})<300 as ao from f_pred_label p join f_flow f on f.flow_id=p.row_id where model='a')
select case when ao then 'audio_only' else 'larger_packet' end as regime, count(*) as flows, round(count(*)/(select count(*) from j),6) as share, round(avg(case when pred=y then 1.0 else 0 end),6) as accuracy, count(*) filter (pred<>y) as errors from j group by ao""")
def _(t):
    from tessera.operators.evaluate import argmax_rows, regime_table
    ao = flows.audio_only(t.flow).select(F.col("flow_id").alias("row_id"), "audio_only")
    return R6(regime_table(argmax_rows(t.prob_rows.filter("model = 'a'")).join(ao, "row_id")), "share", "accuracy")


@register("a21_threshold_counts", "f_flow", f"""
, th as (select unnest([200,250,300,400,500]) as threshold_bytes)
select threshold_bytes, count(f.flow_id) as flows, count(*) filter (label_id=8) as voice, count(*) filter (label_id=9) as video
from th left join (select * from {TRAIN} and label_id//2=4) f on greatest({",".join(LN)})<threshold_bytes group by threshold_bytes""")
def _(t):
    return profile.threshold_counts(t.train)


@register("a22_ceiling_sweep", "f_flow", f"""
, c as (select cast(count(*) as double) as n, cast(count(*) filter (label_id=8 and greatest({",".join(LN)})<300) as double) as nv, cast(count(*) filter (label_id=9 and greatest({",".join(LN)})<300) as double) as nd,
  cast(count(*) filter (label_id=8) as double) as tv, cast(count(*) filter (label_id=9) as double) as td from {TRAIN}),
s as (select *, i/100.0::double as p from c, (select unnest(range(101)) as i)),
q as (select *, nv*p/greatest(nv*p+nd*p,1e-9) as pv, nv*p/tv as rv, (td-nd+nd*(1-p))/greatest(td-nd+nd*(1-p)+nv*(1-p),1e-9) as pd, (td-nd+nd*(1-p))/td as rd from s),
f as (select *, case when pv+rv=0 then 0 else 2*pv*rv/(pv+rv) end as f1_voice, 2*pd*rd/(pd+rd) as f1_video from q)
select round(p,6) as voice_fraction, round((8+f1_voice+f1_video)/10,6) as macro_f1, round(f1_voice,6) as f1_voice, round(f1_video,6) as f1_video, round((n-least(nv,nd))/n,6) as accuracy, cast(nv+nd as bigint) as ambiguous_flows
from f order by round((8+f1_voice+f1_video)/10,12) desc, p limit 1""")
def _(t):
    return R6(profile.ceiling_sweep(t.train), "voice_fraction", "macro_f1", "f1_voice", "f1_video", "accuracy")


@register("a23_majority_oracle", "f_key", """
, c as (select lkey, label_id, count(*) as n from f_key where split='train' group by all), m as (select lkey, max(n) as hit, sum(n) as n from c group by lkey)
select count(*) as keys, round(sum(hit)/sum(n),6) as oracle_accuracy from m""")
def _(t):
    return R6(profile.majority_oracle(t.keyed.filter("split = 'train'"), "lkey"), "oracle_accuracy")


FEAT = LN + TN[1:]
FEAT_LONG = "(select label_id, fold, unnest([" + ",".join(f"'{c}'" for c in FEAT) + "]) as feature, unnest([" + ",".join(FEAT) + f"]) as value from {TRAIN})"


@register("a40_anova_f", "f_flow", f"""
, l as (select * from {FEAT_LONG}), g as (select feature, avg(value) as g, count(*) as nn, count(distinct label_id) as k from l group by feature),
c as (select feature, label_id, count(*) as n, avg(value) as m from l group by all), b as (select feature, sum(n*(m-g)*(m-g)) as between_ss from c join g using (feature) group by feature),
w as (select feature, sum((value-m)*(value-m)) as within_ss from l join c using (feature,label_id) group by feature)
select feature, round((between_ss/(k-1))/(within_ss/(nn-k)),6) as anova_f from g join b using (feature) join w using (feature)""")
def _(t):
    return R6(profile.anova_f(t.train, FEAT), "anova_f")


@register("a40_binned_information", "f_flow", f"""
, l as (select * from {FEAT_LONG}), r as (select feature, label_id, floor((rank() over (partition by feature order by value)-1)*10/count(*) over (partition by feature)) as bin from l),
c as (select feature, bin, label_id, count(*) as n from r group by all),
m as (select *, sum(n) over (partition by feature) as nn, sum(n) over (partition by feature, bin) as nb, sum(n) over (partition by feature, label_id) as nl from c)
select feature, round(sum(n/nn*ln(n*nn/(nb*nl))),6) as mutual_info from m group by feature""")
def _(t):
    return R6(profile.binned_information(t.train, FEAT), "mutual_info")


def _digamma_sql(n):
    z = f"({n}+8.0)"
    series = f"ln({z})-1/(2*{z})-1/(12*{z}*{z})+1/(120*{z}*{z}*{z}*{z})-1/(252*{z}*{z}*{z}*{z}*{z}*{z})"
    return "(" + series + "".join(f"-1/({n}+{float(i)})" for i in range(8)) + ")"


@register("a40_neighbour_information", "f_flow", f"""
, l0 as (select row_number() over () as i, feature, label_id, cast(value as double) as value from {FEAT_LONG}), l as (select *, count(*) over (partition by feature, label_id) as c from l0 qualify c > 1),
d as (select a.feature, a.i, abs(a.value-b.value) as away, row_number() over (partition by a.feature, a.i order by abs(a.value-b.value)) as q from l a join l b on a.feature=b.feature and a.label_id=b.label_id and a.i<>b.i),
r as (select l.*, least(3, c-1) as kk, d.away as r from l join d on l.feature=d.feature and l.i=d.i and d.q=least(3, l.c-1)),
m as (select r.feature, r.i, r.c, r.kk, greatest(count(case when r.r=0 and x.value=r.value or r.r>0 and x.value>r.value-r.r and x.value<r.value+r.r then 1 end), 1) as m from r join l x on x.feature=r.feature group by all)
select feature, round(greatest({_digamma_sql("count(*)")}+avg({_digamma_sql("kk")}-{_digamma_sql("c")}-{_digamma_sql("m")}),0),6) as mutual_info from m group by feature""")
def _(t):
    return R6(profile.neighbour_information(t.train, FEAT), "mutual_info")


def _key_sql(tol):
    return "concat_ws('-', " + ",".join(f"cast(round_even({c}/{2*tol},0)*{2*tol} as bigint)" if tol else f"cast({c} as bigint)" for c in LN) + ")"


TOLS = (0, 1, 2, 4)
TOL_KEYS = ", tk as (" + " union all ".join(f"select {t} as tolerance, {_key_sql(t)} as k, flow_id, label_id, fold, split from f_flow" for t in TOLS) + ")"


def tolerant(df):
    """Every row once per tolerance, with its key: all tolerances run as one job."""
    for tol in TOLS:
        df = flows.flow_key(df, tol, f"k{tol}")
    alts = F.explode(F.array(*[F.struct(F.lit(tol).alias("tolerance"), F.col(f"k{tol}").alias("k")) for tol in TOLS]))
    return df.select("flow_id", "split", "fold", "label_id", alts.alias("r")).select("flow_id", "split", "fold", "label_id", "r.*")


@register("j01_exact_lookup", "f_flow", TOL_KEYS + """
, k as (select tolerance, k, count(distinct label_id) as c from tk where split='train' group by all),
n as (select tolerance, count(*) as distinct_train_tuples, count(*) filter (c=1) as pure_train_tuples from k group by tolerance),
m as (select t.tolerance, count(k.k) as test_rows_matched, count(*) filter (c=1) as test_rows_matched_pure, count(*) as tot from tk t left join k on t.tolerance=k.tolerance and t.k=k.k where split='test' group by t.tolerance)
select tolerance, distinct_train_tuples, pure_train_tuples, test_rows_matched, test_rows_matched_pure, round(test_rows_matched/tot,6) as matched_share, round(test_rows_matched_pure/tot,6) as matched_pure_share from n join m using (tolerance)""")
def _(t):
    df = tolerant(t.flow)
    return R6(profile.lookup_summary(df.filter("split = 'train'"), df.filter("split = 'test'"), "k", ["tolerance"]), "matched_share", "matched_pure_share")


FOLD_ANS = TOL_KEYS + """
, ans as (select a.tolerance, a.k, a.fold, min(b.label_id) as answer from (select distinct tolerance, k, fold from tk where split='train') a
  join (select * from tk where split='train') b on a.tolerance=b.tolerance and a.k=b.k and a.fold<>b.fold group by a.tolerance, a.k, a.fold having count(distinct b.label_id)=1)"""


@register("j02_fold_lookup", "f_flow", FOLD_ANS + """
, j as (select t.*, answer from tk t left join ans using (tolerance,k,fold) where split='train')
select tolerance, count(answer) as rows_with_lookup, round(count(answer)/count(*),6) as coverage, round(count(*) filter (answer=label_id)/greatest(count(answer),1),6) as accuracy_when_available from j group by tolerance""")
def _(t):
    return R6(profile.fold_lookup(tolerant(t.train), "k", ["tolerance"]), "coverage", "accuracy_when_available")


@register("j03_lookup_override", "f_pred_label", FOLD_ANS + """
, j as (select t.*, answer, p.pred from tk t join (select row_id, pred from f_pred_label where model='a') p on p.row_id=t.flow_id left join ans using (tolerance,k,fold) where split='train')
select tolerance, count(answer) as rows_covered, round(count(answer)/count(*),6) as coverage, round(count(*) filter (answer is not null and pred=label_id)/count(answer),6) as model_accuracy_on_covered,
 round(count(*) filter (answer=label_id)/count(answer),6) as lookup_accuracy_on_covered, round(count(*) filter (coalesce(answer,pred)=label_id)/count(*),6) as overall_accuracy,
 round((count(*) filter (coalesce(answer,pred)=label_id)-count(*) filter (pred=label_id))/count(*),6) as delta_vs_model, count(*) filter (coalesce(answer,pred)<>pred) as rows_changed from j group by tolerance""")
def _(t):
    from tessera.operators.evaluate import argmax_rows
    pred = argmax_rows(t.prob_rows.filter("model = 'a'")).select(F.col("row_id").alias("flow_id"), "pred")
    return R6(profile.lookup_override(tolerant(t.train), "k", pred, ["tolerance"]),
              "coverage", "model_accuracy_on_covered", "lookup_accuracy_on_covered", "overall_accuracy", "delta_vs_model")
