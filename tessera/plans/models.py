"""Registered model queries.  Fitted results have no SQL form; they are checked by invariants in the tests."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tessera.operators import evaluate as E, fitted, flows, folds, models as M, raster, search
from tessera.plans.audit import DEDUPE
from tessera.plans.fitted import DENS
from tessera.functions.draws import hash_sql, unit
from tessera.plans.registry import register
from tessera.session import cut

c = F.col
COLS = ["len_range", "len_mean", "len_std", "total_span", "gp_log_pl3", "packet_length_0", "packet_length_1", "packet_length_2", "packet_length_3",
        "packet_length_4", "delta_t_1", "delta_t_2", "delta_t_3", "delta_t_4"]
KEEP = ["row_id", "y", "fold", "split", "audio_only"]
FOLDS = [0, 1, 2, 3, 4]
Q = M.QUICK  # these queries are run often


def data(t, split="train"):
    """Compact features; the folds are the view's user folds spread by flow, so every class is in every fold."""
    f = flows.audio_only(t.flow).withColumnsRenamed({"flow_id": "row_id", "label_id": "y"}).withColumn("fold", (c("flow_no") % 5).cast("int"))
    if split:
        f = f.filter(c("split") == split)
    if split == "train":  # the view sends every fifth flow to test: deal the rest again
        f = folds.permuted_folds(f.drop("fold"), "row_id")
    return M.assemble(flows.compact_features(f, KEEP), COLS, KEEP)


@register("m06_compressed_features")
def _(t):
    from pyspark.ml.functions import vector_to_array
    e = t.table("embeddings").select("vec_id", "label", array_to_vector(c("embedding").cast("array<double>")).alias("features"))
    return M.compress(e).select("vec_id", "label", vector_to_array("pca").alias("pca"))


@register("m09_oof_record")
def _(t):
    return M.oof_record(M.out_of_fold(data(t), "forest", FOLDS, params=Q["forest"]))


FOLD_SQL = f"fd as (select flow_id as row_id, label_id as y, cast((row_number() over (order by {hash_sql(0, 'flow_id')}, flow_id) - 1) % 5 as int) as fold from f_flow where split = 'train')"


@register("m09_out_of_fold_rows", "f_flow", ", " + FOLD_SQL + " select row_id, y, fold, true as is_distribution, 1 as times from fd")
def _(t):
    """Every training row is answered once, in its own fold, by a distribution over all classes."""
    oof = M.out_of_fold(data(t), "forest", FOLDS, params=Q["forest"])
    total = F.aggregate("probs", F.lit(0.0), lambda a, p: a + p)
    good = (F.abs(total - 1) < 1e-9) & (F.size("probs") == 10) & (F.array_min("probs") >= 0)
    return oof.groupBy("row_id", "y", "fold").agg(F.bool_and(good).alias("is_distribution"), F.count(F.lit(1)).cast("int").alias("times"))


@register("m09_repeated_schemes")
def _(t):
    """Records over two repeats of stratified and of grouped folds."""
    d, f = data(t), t.grouped.filter("split = 'train'")
    plain = folds.stratified_folds(f, "flow_id", "label_id", repeats=2).select(c("flow_id").alias("row_id"), "repeat", "fold")
    grouped = folds.group_folds(f, "flow_id", "gkey", "label_id").select(c("flow_id").alias("row_id"), "repeat", "fold")
    parts = [M.repeated_record(d, "forest", x, params=Q["forest"]).withColumn("scheme", F.lit(n)) for n, x in (("stratified", plain), ("grouped", grouped))]
    return parts[0].unionByName(parts[1])


@register("m09_test_rows", "f_flow", ", a as (select flow_id as row_id from f_flow where split = 'test') select row_id, true as is_distribution from a")
def _(t):
    """Refit on all training rows, one distribution per test row."""
    got = M.refit_predict("forest", data(t), data(t, "test"), params=Q["forest"])
    total = F.aggregate("probs", F.lit(0.0), lambda a, p: a + p)
    return got.select("row_id", ((F.abs(total - 1) < 1e-9) & (F.size("probs") == 10)).alias("is_distribution"))


@register("m11_grid_search")
def _(t):
    return M.grid_search(data(t), "forest", {"numTrees": [5, 10], "maxDepth": [3, 5]})


@register("m11_appended_record", "f_search", DEDUPE + """
, f as (select distinct features from d where features = 'full')
select model, count(*) as points, cast(0 as bigint) as full_records from d group by model union all select 'forest', 4*count(*), 4*count(*) from f""")
def _(t):
    """A search over the specs of one stage, appended to the record; counts by family and of rows that hold all scores."""
    specs = search.stage_specs(t.search.filter("features = 'full'").select("features").distinct(), {"forest": {"numTrees": [5, 10], "maxDepth": [3, 5]}})
    got = M.run_specs(data(t), specs, FOLDS).withColumn("group_acc", c("accuracy_mean"))
    rec = search.appended(t.search.withColumn("hash", c("hash").cast("string")), got)
    scored = c("accuracy_mean").between(0, 1) & c("macro_f1_mean").between(0, 1) & (c("log_loss_mean") > 0) & (c("fit_seconds") > 0)
    return rec.groupBy("model").agg(F.count(F.lit(1)).alias("points"), F.count(F.when(scored, 1)).alias("full_records"))


@register("m13_model_families")
def _(t):
    d = data(t)
    families = [*M.DIRECT, *reversed(M.FAMILIES)]  # the longest first
    rows = reduce(lambda a, b: a.unionByName(b), M.side_by_side(t.spark, lambda f: M.out_of_fold(d, f, FOLDS, params=Q[f]), families, 3))
    return E.summary(E.argmax_rows(rows), ["model"])


@register("m14_hierarchical_heads")
def _(t):
    rows = M.over_folds(data(t), FOLDS, lambda tr, va: M.hierarchical(tr, va, params=Q["forest"]))
    return E.summary(E.argmax_rows(rows), ["model"])


@register("m14_head_composition", "f_prob", """
, a as (select row_id, k//2 as app, sum(p) as pa from f_prob where model='a' group by all), b as (select row_id, k//2 as app, sum(case when k%2=1 then p end)/sum(p) as pv from f_prob where model='b' group by all)
select row_id, cast(app*2+m as int) as k, round(case when m=1 then pa*pv else pa*(1-pv) end,6) as p from a join b using (row_id, app), (select unnest([0,1]) as m)""")
def _(t):
    pair = lambda a: F.element_at("probs", 2 * a + 1) + F.element_at("probs", 2 * a + 2)
    app = t.prob_rows.filter("model = 'a'").select("row_id", F.array(*[pair(a) for a in range(5)]).alias("probs"))
    video = t.prob_rows.filter("model = 'b'").select("row_id", F.array(*[F.element_at("probs", 2 * a + 2) / pair(a) for a in range(5)]).alias("probs"))
    return M.compose_heads(app, video).select("row_id", F.posexplode("probs").alias("k", "p")).withColumn("p", F.round("p", 6))


@register("m15_mixture_view")
def _(t):
    rows = M.over_folds(data(t), FOLDS, lambda tr, va: M.mixture_view(tr, va, params=Q["forest"]))
    return E.summary(E.argmax_rows(rows), ["model"])


@register("m15_fold_back", "f_prob", """
, s as (select row_id, k, case when k%2=0 then p else p*0.25 end as p from f_prob where model='a' union all select row_id, k, p*0.75 from f_prob where model='a' and k%2=1)
select row_id, k, round(sum(p),6) as p from s group by all""")
def _(t):
    parts = []
    for a in range(5):
        v = F.element_at("probs", 2 * a + 2)
        parts += [F.element_at("probs", 2 * a + 1), v * 0.25, v * 0.75]
    rows = t.prob_rows.filter("model = 'a'").select("row_id", F.array(*parts).alias("probs"))
    return M.fold_back(rows).select("row_id", F.posexplode("probs").alias("k", "p")).withColumn("p", F.round("p", 6))


ABC = ["a", "b", "c"]


@register("m18_hill_climb")
def _(t):
    return M.weights_frame(t.spark, M.hill_climb(M.member_table(t.prob_rows, ABC), ABC))


@register("m18_nested_hill_climb")
def _(t):
    rows = M.nested_hill_climb(M.member_table(t.prob_rows, ABC), ABC, FOLDS)
    return E.summary(E.argmax_rows(rows), ["model"])


def refolded(t):
    """Members with folds by row, so every class is in every fold."""
    return M.member_table(t.prob_rows.withColumn("fold", F.floor(unit(5, "row_id") * 5).cast("int")), ABC)


@register("m19_stacking")
def _(t):
    return E.summary(E.argmax_rows(M.stack(refolded(t), ABC, FOLDS, params=Q["logistic"])), ["model"])


@register("m20_ensemble_choice")
def _(t):
    table = refolded(t)
    rows = t.prob_rows.unionByName(E.blend(t.prob_rows, {m: 1 / 3 for m in ABC}).select("row_id", "y", "fold", "model", "probs"))
    rows = rows.unionByName(M.nested_hill_climb(table, ABC, FOLDS).select(*rows.columns)).unionByName(M.stack(table, ABC, FOLDS, params=Q["logistic"]).select(*rows.columns))
    return M.choose_ensemble(rows)


@register("m22_vector_calibration")
def _(t):
    table = refolded(t)
    cal = [M.stack(table, ["a"], FOLDS, True, reg, name, Q["logistic"]) for name, reg in (("vector", 0.0), ("dirichlet", 0.01))]
    raw = t.prob_rows.filter("model = 'a'").withColumn("model", F.lit("raw"))
    rows = reduce(lambda x, z: x.unionByName(z.select(*raw.columns)), cal, raw)
    return E.calibration_summary(E.argmax_rows(rows), "model", "raw")


@register("m23_class_bias")
def _(t):
    rows = t.prob_rows.filter("model = 'a'")
    parts = [E.argmax_rows(M.apply_bias(rows, M.fit_bias(rows, kind=kind)).withColumn("model", F.lit(kind))) for kind in ("accuracy", "macro_f1")]
    return E.summary(reduce(lambda a, b: a.unionByName(b), parts, E.argmax_rows(rows)), ["model"])


@register("m24_shuffled_control")
def _(t):
    d = data(t)
    y = folds.shuffled_labels(d.select("row_id", "y"), "row_id", "y", 1).select("row_id", "shuffled")
    s = d.join(y, "row_id").withColumn("y", c("shuffled")).drop("shuffled")
    rows = M.out_of_fold(s, "forest", FOLDS, params=Q["forest"])
    return E.summary(E.argmax_rows(rows), ["model"])


@register("m25_adversarial_auc")
def _(t):
    d = data(t, None).withColumn("y", F.when(c("split") == "test", 1).otherwise(0))
    d = folds.permuted_folds(d.drop("fold"), "row_id")
    return M.adversarial_auc(d, FOLDS, params=Q["forest"])


@register("m26_factorised_targets")
def _(t):
    return M.factorised(data(t), FOLDS, params=Q["forest"])


@register("m27_separability")
def _(t):
    return M.separability(data(t), FOLDS, params=Q["forest"])


def embeddings(t):
    e = t.table("embeddings")
    v = c("embedding").cast("array<double>")
    level = F.log1p(F.aggregate(F.slice(v, 1, 8), F.lit(0.0), lambda a, x: a + x * x))
    return e.select(c("vec_id").alias("row_id"), c("label").alias("y"), array_to_vector(v).alias("features"), level.alias("level"))


@register("m28_probe_features")
def _(t):
    e = embeddings(t)
    out = M.probe_features(e.filter("row_id % 3 <> 0"), e.filter("row_id % 3 = 0"))
    return out.select("row_id", "y", "probs", "entropy", "margin", "residual")


@register("m29_probe_quality")
def _(t):
    e = embeddings(t)
    return M.probe_quality(M.probe_features(e.filter("row_id % 3 <> 0"), e.filter("row_id % 3 = 0")))


CLASSES = {"app": 5, "video_like": 2, "alignment_level": 5}
LEVELS = ["log_bitrate", "log_mean_gap", "frac_mtu"]


def probed(t):
    """Probe columns of two folds of the training flows; the other three stand for the auxiliary corpus."""
    arr = t.flow.select(c("flow_id").alias("row_id"), F.array(*flows.lens()).alias("x"), F.array(F.lit(0.0), *flows.gaps()).alias("g"))
    d = cut(data(t).withColumn("app", F.floor(c("y") / 2).cast("int")).join(flows.auxiliary_targets(arr, "x", "g", "row_id"), "row_id"))  # read by every probe
    return cut(M.probe_block(d.filter("fold < 3"), d.filter("fold >= 3"), CLASSES, LEVELS))


@register("m28_probe_block")
def _(t):
    names = [f"{k}_{x}" for x in CLASSES for k in ("probs", "entropy", "margin")] + [f"{k}_{x}" for x in LEVELS for k in ("pred", "resid")]
    return probed(t).select("row_id", "y", *names)


@register("m29_probe_report")
def _(t):
    return M.probe_report(probed(t), CLASSES, LEVELS)


@register("m29_probe_only_model")
def _(t):
    """A model of probe columns alone over folds of the rows that no probe was fitted on."""
    dealt = folds.permuted_folds(probed(t).drop("fold"), "row_id")
    rows = M.out_of_fold(M.probe_vectors(dealt, CLASSES, LEVELS, ["row_id", "y", "fold"]), "forest", FOLDS, params=Q["forest"])
    majority = rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).agg((F.max("n") / F.sum("n")).alias("majority"))
    return E.summary(E.argmax_rows(rows), ["model"]).withColumn("majority", majority.scalar())


@register("m30_same_source_scorer")
def _(t):
    g = cut(t.grouped.filter("split = 'train'").select("gkey", "flow_id", *DENS))  # read by both kinds of pairs and the clusters
    pos = fitted.neighbour_pairs(g, "gkey", "flow_id", DENS)
    neg = fitted.negative_pairs(g, "gkey", "flow_id", DENS)
    feats = [f"{k}_{x}" for x in DENS for k in ("diff", "mean")]
    _, scored = M.pair_scorer(pos, neg, "gkey", feats)
    from tessera.operators.ordered import rank_auc
    auc = rank_auc(scored.filter("not is_train"), [], "score", c("y") == 1)
    labels = raster.connected(g.select(c("flow_id").alias("node")), scored.filter("score >= 0.5").select(c("row_id").alias("a"), c("flow_id_b").alias("b")))
    quality = E.cluster_quality(labels.join(g.select(c("flow_id").alias("node"), "gkey").hint("merge"), "node"), "label", "gkey")
    return quality.withColumn("auc", auc.scalar()).withColumn("gate_passed", c("auc") >= 0.75)


@register("m31_shipped_labels")
def _(t):
    d = data(t, None)
    tr, te = d.filter("split = 'train'"), d.filter("split = 'test'")
    out = M.shipped(tr, te, t.prob_rows.filter("model = 'a'"), members=(("boosted", Q["boosted"]), ("forest", Q["forest"]), ("forest", Q["forest"] | {"featureSubsetStrategy": "all"})))
    return out.select("row_id", flows.label_text(c("pred")).alias("raw_label"), flows.label_text(c("ruled")).alias("label"))


@register("m33_importance")
def _(t):
    d = data(t)
    model = RandomForestClassifier(labelCol="y", numTrees=10, maxDepth=5, seed=42).fit(d.withColumn("y", c("y").cast("double")))
    return M.permutation_importance(model, d, COLS, "row_id")
