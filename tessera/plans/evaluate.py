"""Registered scoring queries over the probability view."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import evaluate as E, flows, ordered
from tessera.plans.registry import register

R6 = lambda df, *cols: df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in cols})


def decided(t, model=None):
    rows = t.prob_rows if model is None else t.prob_rows.filter(F.col("model") == model)
    return E.argmax_rows(rows)


def with_audio(t, rows):
    ao = flows.audio_only(t.flow).select(F.col("flow_id").alias("row_id"), "audio_only")
    return rows.join(ao, "row_id")


AO = "select flow_id as row_id, greatest(packet_length_0,packet_length_1,packet_length_2,packet_length_3,packet_length_4)<300 as ao from f_flow"
# per-class report of predictions in a CTE named r(y, pred)
REPORT = """c as (select unnest(range(10)) as label_id),
rep as (select label_id, (select count(*) from r where y=label_id and pred=label_id) as tp, (select count(*) from r where y=label_id) as support, (select count(*) from r where pred=label_id) as called from c),
sc as (select *, case when called>0 then tp/called else 0 end as precision, case when support>0 then tp/support else 0 end as recall, case when called+support>0 then 2*tp/(called+support) else 0 end as f1 from rep)"""


@register("p09_forced_class", "f_pred_label", f", ao as ({AO}) select p.row_id, p.pred, case when p.pred in (8,9) and ao then 8 else p.pred end as ruled from f_pred_label p join ao using (row_id) where model='a'")
def _(t):
    return E.force_class(with_audio(t, decided(t, "a")), "audio_only", [8, 9], 8).select("row_id", "pred", "ruled")


@register("p10_prior_correction", "f_prob", """
, pi as (select y as k, count(*)/sum(count(*)) over () as q from (select distinct row_id, y from f_prob) group by y),
d as (select row_id, k, p/q as w from f_prob join pi using (k) where model='a')
select row_id, k, round(w/sum(w) over (partition by row_id),6) as p from d""")
def _(t):
    rows = t.prob_rows.filter("model = 'a'")
    out = E.prior_correct(rows, E.prior_row(rows).scalar())
    return R6(out.select("row_id", F.posexplode("probs").alias("k", "p")), "p")


@register("p11_defer_within_pair", "f_prob", """
, pi as (select y as k, count(*) as q from (select distinct row_id, y from f_prob) group by y),
r as (select row_id, k, p, row_number() over (partition by row_id order by p desc, k) as r from f_prob where model='a'),
j as (select a.row_id, a.k as k1, b.k as k2, a.p-b.p as gap from r a join r b on a.row_id=b.row_id and a.r=1 and b.r=2)
select row_id, k1 as raw_pred, case when k1//2=k2//2 and gap<0.1 and p2.q>p1.q then k2 else k1 end as pred from j join pi p1 on p1.k=k1 join pi p2 on p2.k=k2""")
def _(t):
    rows = t.prob_rows.filter("model = 'a'")
    return E.defer_within_pair(rows, 0.1, E.prior_row(rows).scalar()).select("row_id", "raw_pred", "pred")


@register("s12_label_file", "f_pred_label f_label", """
select row_number() over (order by row_id) as idx, label from f_pred_label p join f_label l on l.label_id=p.pred where model='a' and row_id in (select flow_id from f_flow where split='test')""")
def _(t):
    from tessera.sources.files import label_file
    rows = decided(t, "a").join(t.test.select(F.col("flow_id").alias("row_id")), "row_id", "left_semi")
    return label_file(rows, "row_id")


@register("s12_label_file_checks", "f_pred_label", """
, p as (select * from f_pred_label where model='a' and row_id in (select flow_id from f_flow where split='test'))
select count(*) as n_rows, cast(0 as bigint) as index_gaps, cast(0 as bigint) as outside_vocabulary, count(distinct pred) as distinct_labels, round(avg(conf),6) as mean_confidence from p""")
def _(t):
    from tessera.sources.files import label_file, label_file_checks
    rows = decided(t, "a").join(t.test.select(F.col("flow_id").alias("row_id")), "row_id", "left_semi")
    checks = label_file_checks(label_file(rows, "row_id"))
    return R6(checks.withColumn("mean_confidence", rows.agg(F.avg("conf")).scalar()), "mean_confidence")


@register("a14_confusion", "f_pred_label", "select y, " + ", ".join(f"count(*) filter (pred={k}) as p{k}" for k in range(10)) + " from f_pred_label where model='a' group by y")
def _(t):
    return E.confusion(decided(t, "a"))


@register("a14_hard_pairs", "f_pred_label", "select y, pred, count(*) as count from f_pred_label where model='a' and y<>pred group by all order by count desc, y, pred limit 10")
def _(t):
    return E.hard_pairs(decided(t, "a"))


@register("a15_class_report", "f_pred_label", f", r as (select y, pred from f_pred_label where model='a'), {REPORT} select cast(label_id as int) as label_id, round(precision,6) as precision, round(recall,6) as recall, round(f1,6) as f1, support from sc")
def _(t):
    return R6(E.class_report(decided(t, "a")).drop("tp"), "precision", "recall", "f1")


@register("a15_macro_f1", "f_pred_label", """
, c as (select unnest(range(10)) as label_id), m as (select distinct model from f_pred_label),
rep as (select model, label_id, (select count(*) from f_pred_label p where p.model=m.model and y=label_id and pred=label_id) as tp, (select count(*) from f_pred_label p where p.model=m.model and y=label_id) as s, (select count(*) from f_pred_label p where p.model=m.model and pred=label_id) as q from c, m)
select model, round(sum(tp)/sum(s),6) as accuracy, round(avg(case when q+s>0 then 2*tp/(q+s) else 0 end),6) as macro_f1 from rep group by model""")
def _(t):
    return R6(E.summary(decided(t), ["model"]), "accuracy", "macro_f1")


@register("a16_log_loss", "f_pred_label", "select model, round(avg(-ln(greatest(p_true,1e-9))),6) as log_loss from f_pred_label group by model")
def _(t):
    return R6(E.log_loss(decided(t), ["model"]), "log_loss")


ECE = "b as (select {k}, ceil(conf*15) as bin, avg(case when pred=y then 1.0 else 0 end) as acc, avg(conf) as c, count(*) as n from {src} group by all), e as (select {k}, sum(n*abs(acc-c))/sum(n) as ece from b group by {k})"


@register("a17_calibration_error", "f_pred_label", ", " + ECE.format(k="model", src="f_pred_label") + " select model, round(ece,6) as ece from e")
def _(t):
    return R6(E.calibration_error(decided(t), ["model"]), "ece")


@register("a18_calibration_summary", "f_pred_label", ", " + ECE.format(k="model", src="f_pred_label") + """
, s as (select model, avg(case when pred=y then 1.0 else 0 end) as accuracy, avg(case when pred<>y then conf end) as wrong_confidence, avg(-ln(greatest(p_true,1e-9))) as log_loss from f_pred_label group by model),
j as (select *, accuracy >= (select accuracy from s where model='a')-0.01 as el from s join e using (model))
select model, round(accuracy,6) as accuracy, round(wrong_confidence,6) as wrong_confidence, round(log_loss,6) as log_loss, round(ece,6) as ece,
 row_number() over (order by log_loss, model)=1 as best_by_nll, row_number() over (order by ece, model)=1 as best_by_ece, row_number() over (order by el desc, log_loss, model)=1 as selected from j""")
def _(t):
    return R6(E.calibration_summary(decided(t), "model", "a"), "accuracy", "wrong_confidence", "log_loss", "ece")


@register("a19_error_budget", "f_pred_label", """
, p as (select y, count(*) as support, count(*) filter (pred<>y) as errors, coalesce(avg(conf) filter (pred<>y),0) as wc from f_pred_label where model='a' group by y)
select y, support, errors, round(wc,6) as wrong_confidence, round(errors/greatest(sum(errors) over (),1),6) as error_share from p""")
def _(t):
    return R6(E.error_budget(decided(t, "a")), "wrong_confidence", "error_share")


PAIR = """, j as (select a.y, a.pred=a.y as oa, b.pred=b.y as ob from f_pred_label a join f_pred_label b using (row_id) where a.model='{a}' and b.model='{b}'),
c as (select count(*) as rows, avg(case when oa then 1.0 else 0 end) as acc_a, avg(case when ob then 1.0 else 0 end) as acc_b, count(*) filter (ob and not oa) as b_only, count(*) filter (oa and not ob) as a_only from j)"""


@register("j15_paired_counts", "f_pred_label", PAIR.format(a="a", b="b") + " select rows, round(acc_a,6) as acc_a, round(acc_b,6) as acc_b, b_only, a_only from c")
def _(t):
    return R6(E.paired_counts(decided(t), "a", "b"), "acc_a", "acc_b")


MCN = """, n as (select *, a_only+b_only as n, least(a_only,b_only) as lo from c),
p as (select any_value(n) as discordant, any_value(a_only) as a_only, any_value(b_only) as b_only, sum(exp(lgamma(n+1)-lgamma(i+1)-lgamma(n-i+1)-n*ln(2.0))) as tail from n, (select unnest(range(100000)) as i) where i<=lo),
q as (select *, case when a_only=b_only then 1.0 else least(1.0, 2*tail) end as p_value from p)
select discordant, a_only, b_only, round(p_value,6) as p_value, case when p_value<0.05 and b_only>a_only then 'B significantly better' when p_value<0.05 and a_only>b_only then 'A significantly better' else 'not established' end as verdict from q"""


@register("a28_mcnemar", "f_pred_label", PAIR.format(a="a", b="b") + MCN)
def _(t):
    out = E.mcnemar(E.paired_counts(decided(t), "a", "b"))
    return R6(out.select("discordant", "a_only", "b_only", "p_value", "verdict"), "p_value")


@register("a28_mcnemar_close", "f_pred_label", PAIR.format(a="b", b="c") + MCN)
def _(t):
    out = E.mcnemar(E.paired_counts(decided(t), "b", "c"))
    return R6(out.select("discordant", "a_only", "b_only", "p_value", "verdict"), "p_value")


@register("a28_best_points", "f_pred_label", """, acc as (select model, case when model = 'c' then 'second' else 'first' end as family, avg(case when pred=y then 1.0 else 0 end) as g from f_pred_label group by model),
best as (select family, min_by(model, (-g, model)) as model from acc where g > 0 group by family), pa as (select model from best where family='first'), pb as (select model from best where family='second'),
j as (select a.y, a.pred=a.y as oa, b.pred=b.y as ob from f_pred_label a join f_pred_label b using (row_id) where a.model=(select model from pa) and b.model=(select model from pb)),
c as (select count(*) as rows, count(*) filter (ob and not oa) as b_only, count(*) filter (oa and not ob) as a_only from j)""" + MCN.replace("select discordant, a_only", "select (select model from pa) as point_a, (select model from pb) as point_b, discordant, a_only"))
def _(t):
    """The best of two stored points of one family against the stored point of another."""
    rows = decided(t)
    family = F.when(F.col("model") == "c", "second").otherwise("first")
    points = rows.groupBy(F.col("model").alias("point"), family.alias("family")).agg(F.avg(F.when(F.col("pred") == F.col("y"), 1.0).otherwise(0.0)).alias("group_acc"))
    out = E.compare_best(rows, points, "first", "second")
    return R6(out.select("point_a", "point_b", "discordant", "a_only", "b_only", "p_value", "verdict"), "p_value")


@register("a29_bootstrap_gain")
def _(t):
    rows = E.force_class(with_audio(t, decided(t, "a")), "audio_only", [8, 9], 8)
    return E.bootstrap_gain(rows, "pred", "ruled")


@register("a37_cluster_quality", "", """
with e as (select vec_id%12 as c, label from embeddings), cell as (select c, label, count(*) as n from e group by all), pc as (select c, sum(n) as n, max(n) as top from cell group by c), pl as (select label, sum(n) as n from cell group by label),
s as (select (select sum(n*(n-1)/2) from cell) as ab, (select sum(n*(n-1)/2) from pc) as a, (select sum(n*(n-1)/2) from pl) as b, (select count(*)*(count(*)-1)/2 from e) as t)
select count(*) as clusters, round(avg(top/n),6) as mean_purity, count(*) filter (n=1) as singletons, cast(max(n) as bigint) as largest, round((any_value(ab)-any_value(a)*any_value(b)/any_value(t))/((any_value(a)+any_value(b))/2-any_value(a)*any_value(b)/any_value(t)),6) as adjusted_rand from pc, s""")
def _(t):
    e = t.table("embeddings").select((F.col("vec_id") % 12).alias("c"), "label")
    return R6(E.cluster_quality(e, "c", "label"), "mean_purity", "adjusted_rand")


VOTE = """, g as (select flow_id as row_id, gkey from f_group), m as (select p.*, gkey from f_prob p join g using (row_id) where model='a'),
v as (select gkey, k, sum({expr}) as v, count(*) as n from m {join} group by all), b as (select gkey, arg_max(k, (round(v,9), -k)) as vote from v where n>1 group by gkey)
select l.row_id, l.pred, coalesce(b.vote, l.pred) as voted from f_pred_label l join g using (row_id) left join b using (gkey) where l.model='a'"""


def _grouped_probs(t):
    g = t.grouped.select(F.col("flow_id").alias("row_id"), "gkey")
    return t.prob_rows.filter("model = 'a'").join(g, "row_id")


@register("a38_group_vote_logsum", "f_group f_pred_label", VOTE.format(expr="ln(greatest(p,1e-9))", join=""))
def _(t):
    return E.group_vote(_grouped_probs(t), "gkey", "logsum").select("row_id", "pred", "voted")


@register("a38_group_vote_confidence", "f_group f_pred_label", VOTE.format(expr="p*power(conf,4)", join="join (select row_id, conf from f_pred_label where model='a') using (row_id)"))
def _(t):
    return E.group_vote(_grouped_probs(t), "gkey", "confidence").select("row_id", "pred", "voted")


@register("a39_rank_auc", "f_prob", """
, s as (select row_id, model, y%2 as pos, round(sum(case when k%2=1 then p end),9) as s from f_prob group by row_id, model, y),
r as (select *, rank() over (partition by model order by s) + (count(*) over (partition by model, s)-1)/2.0 as ar from s)
select model, round((sum(case when pos=1 then ar end)-count(*) filter (pos=1)*(count(*) filter (pos=1)+1)/2.0)/(count(*) filter (pos=1)*count(*) filter (pos=0)),6) as auc from r group by model""")
def _(t):
    s = F.round(sum((F.element_at("probs", k) for k in (4, 6, 8, 10)), F.element_at("probs", 2)), 9)
    rows = t.prob_rows.select("model", "y", s.alias("s"))
    return R6(ordered.rank_auc(rows, ["model"], "s", F.col("y") % 2 == 1), "auc")


@register("a41_app_crosstab", "f_pred_label", "select y//2 as true_app, " + ", ".join(f"count(*) filter (pred//2={a}) as app{a}" for a in range(5))
          + ", round(avg(case when pred//2=y//2 then 1.0 else 0 end),6) as agreement from f_pred_label where model='b' group by 1")
def _(t):
    return R6(E.app_crosstab(t.prob_rows.filter("model = 'b'")), "agreement")


@register("a41_restricted_agreement", "f_prob", """
, a as (select row_id, y//2 as ta, k//2 as app, sum(p) as p from f_prob where model='b' and k//2 in (0,2,4) and y//2 in (0,2,4) group by all),
m as (select row_id, any_value(ta) as ta, arg_max(app, (p, -app)) as best from a group by row_id) select count(*) as rows, round(avg(case when best=ta then 1.0 else 0 end),6) as restricted_agreement from m""")
def _(t):
    return R6(E.restricted_agreement(t.prob_rows.filter("model = 'b'"), [0, 2, 4]), "restricted_agreement")


@register("m16_blend", "f_prob", """
select row_id, k, round(sum(p*case model when 'a' then 0.4 when 'b' then 0.35 else 0.25 end),6) as p from f_prob group by row_id, k""")
def _(t):
    out = E.blend(t.prob_rows, {"a": 0.4, "b": 0.35, "c": 0.25})
    return R6(out.select("row_id", F.posexplode("probs").alias("k", "p")), "p")


@register("m17_rank_average", "f_prob", """
, q as (select row_id, model, k, round(p,12) as p from f_prob),
r as (select row_id, k, (rank() over (partition by model,k order by p) + (count(*) over (partition by model,k,p)-1)/2.0)/count(*) over (partition by model,k) as r from q)
select row_id, k, round(avg(r),6) as rank_score from r group by row_id, k""")
def _(t):
    return R6(E.rank_average(t.prob.withColumn("p", F.round("p", 12))), "rank_score")


@register("m21_temperature", "f_prob", """
, g as (select i, 0.4+3.6*i/72.0::double as t from (select unnest(range(73)) as i)), z as (select row_id, model, k, ln(greatest(p,1e-9)) as z, y from f_prob),
l as (select model, i, t, row_id, ln(sum(exp(z/t))) - max(case when k=y then z/t end) as loss from z, g group by all), a as (select model, i, t, avg(loss) as nll from l group by all)
select model, round(arg_min(t, (round(nll,12), i)),6) as temperature, round(min(nll),6) as nll from a group by model""")
def _(t):
    return R6(E.fit_temperature(t.prob_rows), "temperature", "nll")


@register("m21_tempered", "f_prob", """
select row_id, k, round(power(p,0.5)/sum(power(p,0.5)) over (partition by row_id),6) as p from f_prob where model='c'""")
def _(t):
    out = E.temper(t.prob_rows.filter("model = 'c'"), 2.0)
    return R6(out.select("row_id", F.posexplode("probs").alias("k", "p")), "p")


@register("m12_class_weights", "f_flow", """
, c as (select label_id, count(*) as n from f_flow where split='train' group by label_id)
select label_id, n, round(sum(n) over ()/(count(*) over ()*n),6) as weight from c""")
def _(t):
    from tessera.operators.folds import class_weights
    return R6(class_weights(t.train, "label_id"), "weight")


@register("m24_prior_control", "f_flow", """
, c as (select label_id, count(*) as n from f_flow where split='train' group by label_id) select round(max(n)/sum(n),6) as prior_accuracy from c""")
def _(t):
    from tessera.operators.folds import prior_accuracy
    return R6(prior_accuracy(t.train, "label_id"), "prior_accuracy")
