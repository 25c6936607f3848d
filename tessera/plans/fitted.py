"""Registered folds, fitted features and pair queries."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tessera.operators import fitted as X, folds, profile
from tessera.plans.flows import GAP, LN
from tessera.plans.profile import FEAT, FEAT_LONG
from tessera.functions.draws import hash_sql
from tessera.plans.registry import register
from tessera.session import cut

R6 = lambda df, *cols: df.withColumns({x: F.round(F.col(x).cast("double"), 6) for x in cols})
c = F.col


# ---- folds -----------------------------------------------------------------------------------

@register("m01_image_folds", "f_gt", f"""
, i as (select distinct image_id from f_gt)
select image_id, cast((row_number() over (order by {hash_sql(0, "image_id")}, image_id) - 1) % 5 as int) as fold from i""")
def _(t):
    return folds.permuted_folds(t.gt.select("image_id").distinct(), "image_id")


@register("m02_stratified_folds", "f_flow", f"""
, r as (select flow_id, label_id, cast(unnest(range(2)) as int) as repeat from f_flow where split = 'train')
select flow_id, label_id, repeat, cast((row_number() over (partition by repeat, label_id order by {hash_sql(42, "flow_id", "repeat")}, flow_id) - 1 + repeat) % 5 as int) as fold from r""")
def _(t):
    return folds.stratified_folds(t.train, "flow_id", "label_id", repeats=2)


@register("m03_group_folds", "f_group f_flow", f"""
, src as (select g.flow_id, g.gkey, g.label_id from f_group g join f_flow f using (flow_id) where f.split = 'train'),
per as (select gkey, label_id, count(*) as n from src group by all),
g as (select gkey, sum(n) as size, arg_max(label_id, struct_pack(n := n, l := -label_id)) as main from per group by gkey),
r as (select *, cast(unnest(range(2)) as int) as repeat from g),
o as (select *, row_number() over (partition by repeat, main order by size desc, {hash_sql(42, "gkey", "repeat")}, gkey) - 1 as o from r),
f as (select gkey, repeat, (case when (o // 5) % 2 = 0 then o % 5 else 4 - o % 5 end + main) % 5 as fold from o)
select s.flow_id, s.gkey, s.label_id, f.repeat, cast(f.fold as int) as fold from src s join f using (gkey)""")
def _(t):
    return folds.group_folds(t.grouped.filter("split = 'train'"), "flow_id", "gkey", "label_id")


@register("m24_shuffled_labels", "f_flow", f"""
, t as (select flow_id, label_id from f_flow where split = 'train'),
a as (select *, row_number() over (order by {hash_sql(1, "flow_id")}, flow_id) as o from t),
b as (select label_id as shuffled, row_number() over (order by {hash_sql(2, "flow_id")}, flow_id) as o from t)
select a.flow_id, a.label_id, b.shuffled from a join b using (o)""")
def _(t):
    return folds.shuffled_labels(t.train.select("flow_id", "label_id"), "flow_id", "label_id", 1)


@register("m08_fold_selection", "f_flow", f"""
, l0 as (select * from {FEAT_LONG}), l as (select f as held, l0.* from l0, (select unnest(range(5)) as f) where fold<>f),
g as (select held, feature, avg(value) as g, count(*) as nn, count(distinct label_id) as k from l group by all), c as (select held, feature, label_id, count(*) as n, avg(value) as m from l group by all),
b as (select held, feature, sum(n*(m-g)*(m-g)) as bs from c join g using (held, feature) group by all), w as (select held, feature, sum((value-m)*(value-m)) as ws from l join c using (held, feature, label_id) group by all),
f as (select held, feature, (bs/(k-1))/(ws/(nn-k)) as anova_f from g join b using (held, feature) join w using (held, feature)), r as (select *, row_number() over (partition by held order by round(anova_f,9) desc, feature) as rank from f)
select cast(held as int) as held, feature, cast(rank as int) as rank, round(anova_f,6) as anova_f from r where rank<=4""")
def _(t):
    held = t.train.withColumn("held", F.explode(F.filter(F.sequence(F.lit(0), F.lit(4)), lambda f: f != c("fold"))))
    f = profile.anova_f(held, FEAT, ["held"])
    w = Window.partitionBy("held").orderBy(F.desc(F.round("anova_f", 9)), "feature")
    return R6(f.withColumn("rank", F.row_number().over(w)).filter("rank <= 4"), "anova_f")


# ---- chains ----------------------------------------------------------------------------------

def chain_sql(kind, bins, train="true", held=False):
    """CTEs: sq(flow_id, label_id, split, fold, idx, v), edges e, states s, chain tables, ll(flow_id, k, ll)."""
    if kind == "len":
        sq = "sq as (select flow_id, label_id, split, fold, idx, round(length,12) as v from f_pkt join (select flow_id, label_id, split, fold from f_flow) using (flow_id))"
    else:
        sq = "sq as (select flow_id, label_id, split, fold, i as idx, round(log10(greatest(" + "([" + ",".join(GAP) + "])[i+1]" + ",1e-7)),12) as v from f_flow, (select unnest(range(4)) as i))"
    hk, hj = ("held,", "held, ") if held else ("", "")
    train_rows = "(select * from s where fold<>held and split='train')" if held else "(select * from s where split='train')"
    cuts = f"unnest(quantile_cont(v, [{','.join(repr(i / bins) for i in range(1, bins))}])) as edge"
    edges = (f"e as (select distinct held, round(edge,12) as edge from (select h as held, {cuts} from sq, (select unnest(range(5)) as h) where fold<>h and split='train' group by h))" if held
             else f"e as (select distinct round(edge,12) as edge from (select {cuts} from sq where split='train'))")
    placed = ("s as (select flow_id, label_id, split, fold, held, idx, (select count(*) from e where e.held=x.held and edge<=v) as st from (select sq.*, h as held from sq, (select unnest(range(5)) as h)) x)" if held
              else "s as (select flow_id, label_id, split, fold, idx, (select count(*) from e where edge<=v) as st from (select * from sq))")
    return f""", {sq},
{edges},
{placed},
tr as {train_rows}, stt as (select unnest(range({bins + 1})) as st), k as (select unnest(range(10)) as k){", hh as (select unnest(range(5)) as held)" if held else ""},
ini as (select {"hh.held," if held else ""} k.k, stt.st, ln((count(tr.flow_id)+0.5)/sum(count(tr.flow_id)+0.5) over (partition by {"hh.held," if held else ""} k.k)) as lp from k cross join stt {"cross join hh" if held else ""} left join tr on tr.idx=0 and tr.label_id=k.k and tr.st=stt.st {"and tr.held=hh.held" if held else ""} group by {"hh.held," if held else ""} k.k, stt.st),
pr as (select a.flow_id, a.label_id, {"a.held," if held else ""} a.st as s1, b.st as s2 from tr a join tr b on a.flow_id=b.flow_id and b.idx=a.idx+1 {"and a.held=b.held" if held else ""}),
pc as (select label_id, {"held," if held else ""} s1, s2, count(*) as n from pr group by all),
tra as (select {"hh.held," if held else ""} k.k, a.st as s1, b.st as s2, ln((coalesce(any_value(pc.n),0)+0.5)/sum(coalesce(any_value(pc.n),0)+0.5) over (partition by {"hh.held," if held else ""} k.k, a.st)) as lp from k cross join stt a cross join stt b {"cross join hh" if held else ""} left join pc on pc.label_id=k.k and pc.s1=a.st and pc.s2=b.st {"and pc.held=hh.held" if held else ""} group by {"hh.held," if held else ""} k.k, a.st, b.st),
sn as (select a.flow_id, a.fold, a.split, a.st as s1, b.st as s2 from s a join s b on a.flow_id=b.flow_id and b.idx=a.idx+1 {"and a.held=b.held and a.held=a.fold" if held else ""}),
ll as (select flow_id, k, sum(lp) as ll from (select s.flow_id, ini.k, ini.lp from s join ini on ini.st=s.st {"and ini.held=s.fold" if held else ""} where s.idx=0 {"and s.held=s.fold and s.split='train'" if held else ""}
 union all select sn.flow_id, tra.k, tra.lp from sn join tra on tra.s1=sn.s1 and tra.s2=sn.s2 {"and tra.held=sn.fold" if held else ""} {"where sn.split='train'" if held else ""}) group by all)"""


def chains(t, kind, bins):
    # edges, tables and scores all read the sequences: written once
    d = cut(t.flow.select("flow_id", "label_id", "split", X.sequence_values(t.flow, kind).alias("seq")))
    edges = X.quantile_edges(d.filter("split = 'train'"), "seq", bins)
    d = cut(X.states(d.withColumn("edges", edges.scalar()), "seq").select("flow_id", "label_id", "split", "states"))
    init, trans = X.fit_chains(d.filter("split = 'train'"), "label_id", bins)
    return X.likelihood_columns(X.chain_likelihood(d, "flow_id", init, trans), "flow_id", "mk")


CH_OUT = """, r as (select flow_id, arg_max(k, (round(ll,9), -k)) as am, max(ll) as mx, list(ll order by ll desc) as l from ll group by flow_id)
select flow_id, cast(am as int) as mk_argmax, round(mx,5) as mk_max, round(l[1]-l[2],5) as mk_margin from r"""


def chain_out(df):
    best = F.transform("ll", lambda v: F.round(v, 9))
    return df.select("flow_id", (F.array_position(best, F.array_max(best)) - 1).cast("int").alias("mk_argmax"), F.round("mk_max", 5).alias("mk_max"), F.round("mk_margin", 5).alias("mk_margin"))


@register("m04_length_chains", "f_flow", chain_sql("len", 16) + CH_OUT)
def _(t):
    return chain_out(chains(t, "len", 16))


@register("m04_gap_chains", "f_flow", chain_sql("iat", 12) + CH_OUT)
def _(t):
    return chain_out(chains(t, "iat", 12))


@register("m07_out_of_fold_chains", "f_flow", chain_sql("len", 16, held=True) + " select flow_id, cast(k as int) as k, round(ll,5) as ll from ll")
def _(t):
    d = cut(t.train.select("flow_id", "label_id", "fold", X.sequence_values(t.train, "len").alias("seq")))
    ll = X.out_of_fold_chains(d, "flow_id", "label_id", "seq", 16)
    return ll.select("flow_id", F.posexplode("ll").alias("k", "ll")).withColumn("ll", F.round("ll", 5))


@register("m07_nested_chains", "f_pkt f_flow", f"""
, base as (select flow_id, label_id, fold, cast((row_number() over (partition by label_id, fold order by {hash_sql(42, "flow_id")}, flow_id) - 1) % 5 as int) as inner_ from f_flow where split = 'train'),
sq as (select flow_id, label_id, fold, inner_, idx, round(length,12) as v from f_pkt join base using (flow_id)),
m as (select o, i from (select unnest(range(5)) as o), (select unnest(range(-1, 5)) as i)),
e as (select distinct o, i, round(edge,12) as edge from (select o, i, unnest(quantile_cont(v, [{','.join(repr(x / 16) for x in range(1, 16))}])) as edge from sq, m where fold<>o and inner_<>i group by o, i)),
s as (select sq.flow_id, label_id, fold, inner_, idx, o, i, (select count(*) from e where e.o=m.o and e.i=m.i and edge<=v) as st from sq, m),
tr as (select * from s where fold<>o and inner_<>i), stt as (select unnest(range(17)) as st), k as (select unnest(range(10)) as k),
n1 as (select o, i, label_id as k, st, count(*) as n from tr where idx=0 group by all),
n2 as (select a.o, a.i, a.label_id as k, a.st as s1, b.st as s2, count(*) as n from tr a join tr b on a.flow_id=b.flow_id and a.o=b.o and a.i=b.i and b.idx=a.idx+1 group by all),
ini as (select o, i, k, st, ln((coalesce(n,0)+0.5)/sum(coalesce(n,0)+0.5) over (partition by o, i, k)) as lp from m cross join k cross join stt left join n1 using (o, i, k, st)),
tra as (select o, i, k, s1, s2, ln((coalesce(n,0)+0.5)/sum(coalesce(n,0)+0.5) over (partition by o, i, k, s1)) as lp from m cross join k cross join (select st as s1 from stt) cross join (select st as s2 from stt) left join n2 using (o, i, k, s1, s2)),
q as (select * from s where (fold=o and i=-1) or (fold<>o and inner_=i)),
l as (select q.flow_id, q.o, q.fold, ini.k, lp from q join ini on ini.o=q.o and ini.i=q.i and ini.st=q.st where idx=0
 union all select a.flow_id, a.o, a.fold, tra.k, lp from q a join q b on a.flow_id=b.flow_id and a.o=b.o and b.idx=a.idx+1 join tra on tra.o=a.o and tra.i=a.i and tra.s1=a.st and tra.s2=b.st)
select flow_id, cast(o as int) as held, case when fold=o then 'valid' else 'train' end as role, cast(k as int) as k, round(sum(lp),5) as ll from l group by all""")
def _(t):
    """For every outer fold: training rows scored through inner folds, validation rows by the fit on all training rows."""
    d = t.train.select("flow_id", "label_id", "fold", X.sequence_values(t.train, "len").alias("seq"))
    ll = X.nested_chains(cut(X.nested_inner(d, "flow_id", "label_id")), "flow_id", "label_id", "seq", 16)
    return ll.select("flow_id", "held", "role", F.posexplode("ll").alias("k", "ll")).withColumn("ll", F.round("ll", 5))


# ---- densities -------------------------------------------------------------------------------

DENS = LN + ["relative_time_4"]


@register("m05_class_gaussians", "f_flow", f"""
, z as (select flow_id, label_id, split, {", ".join(f"coalesce(({x}-avg({x}) over ())/nullif(stddev_pop({x}) over (),0),0) as {x}" for x in DENS)} from f_flow where split='train'),
p as (select label_id as k, {", ".join(f"avg({x}) as m_{x}, var_pop({x})+1e-4 as v_{x}" for x in DENS)} from z group by label_id)
select flow_id, k, round({"+".join(f"(-0.5*(({x}-m_{x})*({x}-m_{x})/v_{x}+ln(2*pi()*v_{x})))" for x in DENS)},5) as density from z, p""")
def _(t):
    z = X.standardise(t.train, DENS, ["flow_id", "label_id"])
    return X.gaussian_scores(z, DENS, X.class_gaussians(z, DENS, "label_id"), "flow_id").withColumn("density", F.round("density", 5))


@register("m05_mixture_components")
def _(t):
    z = X.standardise(t.train, DENS, ["flow_id", "label_id"])
    return X.mixture_em(z, DENS, "label_id")


@register("m05_mixture_invariants", "f_flow", "select label_id as k, 1.0::double as weights, true as rises, true as settled from f_flow where split = 'train' group by label_id")
def _(t):
    """Weights of a class add up to one, no round lowers its likelihood, and it settles before the limit of rounds."""
    z = X.standardise(t.train, DENS, ["flow_id", "label_id"])
    em = X.mixture_em(z, DENS, "label_id")
    return em.groupBy("k").agg(F.round(F.sum("w"), 9).alias("weights"), (F.max("fell") < 1e-3).alias("rises"), (F.max("rounds") < 200).alias("settled"))


# ---- pairs -----------------------------------------------------------------------------------

@register("j10_pair_counts", "f_group", "select gkey, count(*) as n, count(*)*(count(*)-1)//2 as pairs from f_group where split='train' group by gkey having count(*)>1")
def _(t):
    return X.pair_counts(t.grouped.filter("split = 'train'"), "gkey")


@register("j11_pair_features", "f_group", f"""
, o as (select *, lead(flow_id) over w as flow_id_b, {", ".join(f"lead({x}) over w as b_{x}" for x in DENS)} from f_group where split='train' window w as (partition by gkey order by flow_id))
select gkey, flow_id, flow_id_b, {", ".join(f"round(abs({x}-b_{x}),9) as diff_{x}, round(({x}+b_{x})/2,9) as mean_{x}" for x in DENS)} from o where flow_id_b is not null""")
def _(t):
    p = X.neighbour_pairs(t.grouped.filter("split = 'train'"), "gkey", "flow_id", DENS)
    return p.select("gkey", "flow_id", "flow_id_b", *[F.round(f"{k}_{x}", 9).alias(f"{k}_{x}") for x in DENS for k in ("diff", "mean")])


@register("j10_negative_pairs", "f_group f_flow", f"""
, s as (select g.* from f_group g where g.split = 'train'), a as (select *, row_number() over (order by {hash_sql(42, "flow_id")}, flow_id) as o from s),
b as (""" + " union all ".join(f"select *, {i} as i, row_number() over (order by {hash_sql(43 + i, 'flow_id')}, flow_id) as o from s" for i in range(3)) + """)
select a.gkey, a.flow_id, b.flow_id as flow_id_b, """ + ", ".join(f"round(abs(a.{x}-b.{x}),9) as diff_{x}, round((a.{x}+b.{x})/2,9) as mean_{x}" for x in DENS) + " from a join b using (o) where a.gkey <> b.gkey")
def _(t):
    p = X.negative_pairs(t.grouped.filter("split = 'train'"), "gkey", "flow_id", DENS)
    return p.select("gkey", "flow_id", "flow_id_b", *[F.round(f"{k}_{x}", 9).alias(f"{k}_{x}") for x in DENS for k in ("diff", "mean")])


@register("j12_block_pair_means", "", """
with v as (select vec_id, label, cast(embedding as double[]) as e from embeddings)
select a.label as block_a, b.label as block_b, count(*) as pairs, round(avg(list_dot_product(a.e,b.e)/((sqrt(list_dot_product(a.e,a.e))+1e-9)*(sqrt(list_dot_product(b.e,b.e))+1e-9))),6) as mean_cosine
from v a join v b on (a.label=b.label and a.vec_id<b.vec_id) or a.label<b.label group by all""")
def _(t):
    return R6(X.block_pair_means(t.table("embeddings"), "label", "embedding", 64), "mean_cosine")
