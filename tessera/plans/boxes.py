"""Registered box and raster queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import boxes as B, raster as X
from tessera.functions.draws import hash_sql, unit_sql
from tessera.plans.registry import register
from tessera.session import scratch_path
from tessera.sources import files

R6 = lambda df, *cols: df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in cols})
SIZES = [(0, 12, "<12px"), (12, 24, "12-24px"), (24, 10**9, ">24px")]  # fixed values: size bins

TILE, STRIDE = 192, 144


# ---- files -----------------------------------------------------------------------------------

@register("s02_box_annotations", "f_gt", "select image_id, cast(x1 as int) as left_x, cast(y1 as int) as top_y, cast(x2 as int) as right_x, cast(y2 as int) as bottom_y from f_gt")
def _(t):
    path = scratch_path(t.spark, "annotations")
    files.write_box_csv(t.gt, path)
    return files.read_box_csv(t.spark, path).drop("template_image", "photo_image")


@register("s10_pooled_candidates", "f_pred", "select cast(image_id%5 as int) as fold, count(*) as candidates, count(distinct image_id) as images from f_pred group by 1")
def _(t):
    pred = t.pred.withColumn("fold", (F.col("image_id") % 5).cast("int"))
    pool = files.pooled_candidates([pred.filter(F.col("fold") == k) for k in range(5)])
    return pool.groupBy("fold").agg(F.count(F.lit(1)).alias("candidates"), F.countDistinct("image_id").alias("images"))


@register("s11_box_submission", "f_pred", """
select 'template/pair_template_'||n||'.png' as template_image, 'photo/pair_photo_'||n||'.png' as photo_image, image_id, cast(round_even(x1,0) as int) as left_x, cast(round_even(y1,0) as int) as top_y, cast(round_even(x2,0) as int) as right_x, cast(round_even(y2,0) as int) as bottom_y
from (select image_id, x1+0.5 as x1, y1, x2+0.5 as x2, y2, case when image_id>=1000 then cast(image_id as varchar) else lpad(cast(image_id as varchar),3,'0') end as n from f_pred where score>=0.43)""")
def _(t):
    # half pixels exercise the rounding rule
    moved = t.pred.withColumn("x1", F.col("x1") + 0.5).withColumn("x2", F.col("x2") + 0.5)
    return files.box_submission(moved, 0.43)


@register("s21_merged_shards", "f_gt", """
, s as (select *, 0 as shard, cast(null as varchar) as src_split from f_gt where image_id%3=0 union all select *, 1, 'train' from f_gt where image_id%2=0 union all select *, 2, 'test' from f_gt where image_id%5=0),
l as (select image_id, max(shard) as shard from s group by image_id)
select s.image_id, s.box_id, cast(s.shard as int) as shard, src_split from s join l using (image_id, shard)""")
def _(t):
    g = t.gt.select("image_id", "box_id")
    shards = [g.filter("image_id % 3 = 0"), g.filter("image_id % 2 = 0").withColumn("src_split", F.lit("train")), g.filter("image_id % 5 = 0").withColumn("src_split", F.lit("test"))]
    return B.merge_shards(shards).select("image_id", "box_id", "shard", "src_split")


# ---- geometry --------------------------------------------------------------------------------

@register("p06_clipped_boxes", "f_pred", """
select image_id, cand_id, x1, y1, x2, y2 from (select image_id, cand_id, least(greatest(x1,0),360) as x1, least(greatest(y1,0),280) as y1, least(greatest(x2,0),360) as x2, least(greatest(y2,0),280) as y2 from f_pred) where x2-x1>2 and y2-y1>2""")
def _(t):
    return B.clip(t.pred, F.lit(360.0), F.lit(280.0)).select("image_id", "cand_id", *B.GEO)


def _images(t):
    return t.gt.select("image_id").distinct().withColumn("w", 400 + F.col("image_id") % 3 * 100).withColumn("h", 300 + F.col("image_id") % 2 * 120)


AXIS = """, img as (select distinct image_id, 400+image_id%3*100 as w, 300+image_id%2*120 as h from f_gt), k as (select unnest(range(20)) as k),
ax as (select distinct image_id, w, h, least(k*144, w-192) as tx from img, k), ay as (select distinct image_id, least(k*144, h-192) as ty from img, k),
tiles as (select ax.image_id, w, h, tx, ty from ax join ay using (image_id))"""


@register("p08_tile_origins", "f_gt", AXIS + " select image_id, tx, ty from tiles")
def _(t):
    return B.tile_origins(_images(t), TILE, STRIDE).select("image_id", "tx", "ty")


@register("p07_boxes_in_tiles", "f_gt", AXIS + """
, c as (select g.image_id, box_id, tx, ty, greatest(1.0,(x2-x1)*(y2-y1)) as area, least(greatest(x1-tx,0),192) as x1, least(greatest(y1-ty,0),192) as y1, least(greatest(x2-tx,0),192) as x2, least(greatest(y2-ty,0),192) as y2 from f_gt g join tiles using (image_id))
select image_id, box_id, tx, ty, x1, y1, x2, y2 from c where greatest(x2-x1,0)*greatest(y2-y1,0)/area>=0.7""")
def _(t):
    b = t.gt.withColumn("w", 400 + F.col("image_id") % 3 * 100).withColumn("h", 300 + F.col("image_id") % 2 * 120)
    return B.boxes_in_tiles(b, TILE, STRIDE).select("image_id", "box_id", "tx", "ty", *B.GEO)


def _windows_sql(n=4, seed=3, jitter=200):
    def start(lo, hi, size, k):
        centre = f"(p.{lo}+p.{hi})/2 - {TILE}/2 + floor({unit_sql(seed + k, 'd.image_id', 'd.win')}*{2 * jitter + 1}) - {jitter}"
        free = f"floor({unit_sql(seed + k + 10, 'd.image_id', 'd.win')}*(greatest({size}-{TILE},0)+1))"
        return f"cast(case when centred then floor(least(greatest({centre},0.0),greatest({size}-{TILE},0))) else least({free},greatest({size}-{TILE},0)) end as bigint)"
    return f""", im as (select distinct image_id, 400+image_id%3*100 as w, 300+image_id%2*120 as h from f_gt), d as (select *, cast(unnest(range({n})) as int) as win from im),
pk as (select g.*, d.win, row_number() over (partition by g.image_id, d.win order by {hash_sql(seed, 'g.image_id', 'd.win', 'g.box_id')}) as r from f_gt g join d using (image_id)),
j as (select d.image_id, d.win, d.w, d.h, {unit_sql(seed, 'd.image_id', 'd.win')} < 0.5 as centred, p.* exclude (image_id, win) from d join pk p on p.image_id=d.image_id and p.win=d.win and p.r=1)
select d.image_id, d.win, d.w, d.h, d.centred, {start('x1', 'x2', 'w', 1).replace('p.', 'd.')} as tx, {start('y1', 'y2', 'h', 2).replace('p.', 'd.')} as ty from j d"""


@register("p14_training_windows", "f_gt", _windows_sql())
def _(t):
    return B.training_windows(_images(t), t.gt, 4, TILE, seed=3)


@register("f13_crop_windows", "f_pred", """
, s as (select *, least(greatest(greatest(x2-x1,y2-y1)*2.5,32),256) as s from f_pred)
select image_id, cand_id, cast(round_even(least(greatest((x1+x2)/2-s/2,0),greatest(440-s,0)),0) as int) as crop_x, cast(round_even(least(greatest((y1+y2)/2-s/2,0),greatest(330-s,0)),0) as int) as crop_y, cast(round_even(s,0) as int) as crop_side from s""")
def _(t):
    return B.crop_window(t.pred, F.lit(440.0), F.lit(330.0)).select("image_id", "cand_id", "crop_x", "crop_y", "crop_side")


@register("f13_local_offsets", "f_iou", """
, b as (select image_id, cand_id, arg_max(box_id, (iou, -box_id)) as box_id, max(iou) as iou from f_iou group by all having max(iou)>=0.35),
s as (select p.*, least(greatest(greatest(p.x2-p.x1,p.y2-p.y1)*2.5,32),256) as s, b.box_id from f_pred p join b using (image_id,cand_id)),
w as (select *, round_even(least(greatest((x1+x2)/2-s/2,0),greatest(440-s,0)),0) as cx, round_even(least(greatest((y1+y2)/2-s/2,0),greatest(330-s,0)),0) as cy, 96/round_even(s,0) as sc from s)
select w.image_id, w.cand_id, """ + ", ".join(f"round((g.{c}-{o})*sc-(w.{c}-{o})*sc,6) as d_{c}" for c, o in (("x1", "cx"), ("y1", "cy"), ("x2", "cx"), ("y2", "cy"))) + " from w join f_gt g using (image_id, box_id)")
def _(t):
    best = B.best_truth(t.pred, t.gt).filter("band = 'positive'")
    g = t.gt.select("image_id", F.col("box_id").alias("best_box_id"), *[F.col(c).alias(f"g_{c}") for c in B.GEO])
    d = B.crop_window(best.join(g, ["image_id", "best_box_id"]), F.lit(440.0), F.lit(330.0))
    d = d.select("image_id", "cand_id", *B.in_crop(d, ""), *B.in_crop(d, "g_"))
    return d.select("image_id", "cand_id", *[F.round(F.col(f"local_g_{c}") - F.col(f"local_{c}"), 6).alias(f"d_{c}") for c in B.GEO])


VIEW_FLAGS = "select *, cand_id%2 as hflip, (cand_id//2)%2 as vflip, image_id%2 as transpose from f_pred"


@register("f13_dihedral_boxes", "f_pred", f"""
, v as ({VIEW_FLAGS}), a as (select *, case when hflip=1 then 512-x2 else x1 end as a1, case when hflip=1 then 512-x1 else x2 end as a2, case when vflip=1 then 512-y2 else y1 end as b1, case when vflip=1 then 512-y1 else y2 end as b2 from v)
select image_id, cand_id, case when transpose=1 then b1 else a1 end as x1, case when transpose=1 then a1 else b1 end as y1, case when transpose=1 then b2 else a2 end as x2, case when transpose=1 then a2 else b2 end as y2 from a""")
def _(t):
    return B.view_boxes(_flags(t), F.lit(512.0)).select("image_id", "cand_id", *B.GEO)


def _flags(t):
    c = F.col("cand_id")
    return t.pred.withColumns({"hflip": c % 2, "vflip": F.floor(c / 2) % 2, "transpose": F.col("image_id") % 2})


@register("w12_inverse_views", "f_pred", f"""
, v as ({VIEW_FLAGS}), s as (select *, case when transpose=1 then y1 else x1 end as a1, case when transpose=1 then x1 else y1 end as b1, case when transpose=1 then y2 else x2 end as a2, case when transpose=1 then x2 else y2 end as b2 from v)
select image_id, cand_id, case when hflip=1 then 512-a2 else a1 end as x1, case when vflip=1 then 512-b2 else b1 end as y1, case when hflip=1 then 512-a1 else a2 end as x2, case when vflip=1 then 512-b1 else b2 end as y2 from s""")
def _(t):
    return B.view_boxes(_flags(t), F.lit(512.0), inverse=True).select("image_id", "cand_id", *B.GEO)


@register("f14_blended_scores", "f_pred", "select image_id, cand_id, round((power(v1,0.5)*power(score,0.5)+power(v2,0.5)*power(score,0.5))/2,6) as blended from (select *, ((cand_id*7+image_id)%50+50)/100.0::double as v1, ((cand_id*3+image_id)%40+60)/100.0::double as v2 from f_pred)")
def _(t):
    c = F.col
    d = t.pred.withColumn("v1", ((c("cand_id") * 7 + c("image_id")) % 50 + 50) / 100.0).withColumn("v2", ((c("cand_id") * 3 + c("image_id")) % 40 + 60) / 100.0)
    return R6(B.blend_scores(d, "score", ["v1", "v2"]).select("image_id", "cand_id", "blended"), "blended")


# ---- joins and matching ----------------------------------------------------------------------

@register("j04_iou_join", "f_iou", "select image_id, cand_id, box_id, round(iou,10) as iou from f_iou")
def _(t):
    return B.iou_join(t.pred, t.gt).select("image_id", "cand_id", "box_id", F.round("iou", 10).alias("iou"))


@register("j05_greedy_match", "f_match", "select image_id, cand_id, tp from f_match")
def _(t):
    return B.flag_matches(t.pred, t.gt).select("image_id", "cand_id", "tp")


BEST = """, m as (select image_id, cand_id, max(iou) as iou, arg_max(box_id, (iou, -box_id)) as box from f_iou group by all),
bt as (select p.image_id, p.cand_id, p.score, coalesce(iou,0) as iou, box, case when coalesce(iou,0)>=0.35 then 'positive' when coalesce(iou,0)<0.2 then 'negative' else 'ignored' end as band from f_pred p left join m using (image_id,cand_id))"""


@register("j06_best_truth", "f_iou", BEST + " select image_id, cand_id, round(iou,10) as best_iou, box as best_box_id, band from bt")
def _(t):
    return B.best_truth(t.pred, t.gt).select("image_id", "cand_id", F.round("best_iou", 10).alias("best_iou"), "best_box_id", "band")


BC = ", bc as (select g.image_id, g.box_id, greatest(g.x2-g.x1,g.y2-g.y1) as side, coalesce(max(iou),0) as b from f_gt g left join f_iou i using (image_id,box_id) group by all)"


@register("j07_best_candidate", "f_iou", BC + " select image_id, box_id, round(b,10) as best_iou from bc")
def _(t):
    return B.best_candidate(t.gt, t.pred).select("image_id", "box_id", F.round("best_iou", 10).alias("best_iou"))


@register("j08_fold_safe", "f_gt", """
, s as (select distinct image_id as idx, case when image_id%7=0 then null else image_id*3%1000 end as src_idx, case when image_id%7=0 then null when image_id%3=0 then 'test' else 'train' end as src_split from f_gt),
f as (select unnest(range(5)) as fold)
select idx, cast(fold as int) as fold from s, f where src_split='test' or (src_split='train' and src_idx%5<>fold)""")
def _(t):
    c = F.col("image_id")
    ids = t.gt.select("image_id").distinct()
    derived = ids.select(c.alias("idx"), F.when(c % 7 != 0, c * 3 % 1000).alias("src_idx"), F.when(c % 7 == 0, None).when(c % 3 == 0, "test").otherwise("train").alias("src_split"))
    # every source page has a fold
    pages = derived.select(F.col("src_idx").alias("image_id")).dropna().distinct().withColumn("fold", (F.col("image_id") % 5).cast("int"))
    return B.fold_safe(derived, pages).select("idx", "fold")


# ---- scores ----------------------------------------------------------------------------------

def _prf(tp, fp, fn):
    return f"round({tp}/greatest(1,{tp}+{fp}),6) as precision, round({tp}/greatest(1,{tp}+{fn}),6) as recall, round(2*({tp}/greatest(1,{tp}+{fp}))*({tp}/greatest(1,{tp}+{fn}))/greatest(1e-9,{tp}/greatest(1,{tp}+{fp})+{tp}/greatest(1,{tp}+{fn})),6) as f1"


@register("a24_global_f1", "f_match", f", c as (select count(*) filter (tp) as tp, count(*) filter (not tp) as fp, (select count(*) from f_gt)-count(*) filter (tp) as fn from f_match) select tp, fp, fn, {_prf('tp','fp','fn')} from c")
def _(t):
    return R6(B.global_f1(B.flag_matches(t.pred, t.gt), t.gt), "precision", "recall", "f1")


SWEEP = """, th as (select i, 0.05::double+i*((0.05::double+0.01::double)-0.05::double) as thr from (select unnest(range(90)) as i)), sc as (select {k} score, count(*) as n, count(*) filter (tp) as t from {src} group by all),
cu as (select {k} i, thr, cast(sum(case when score>=thr then t else 0 end) as bigint) as tp, cast(sum(case when score>=thr then n-t else 0 end) as bigint) as fp from sc, th group by all)"""


@register("a25_threshold_sweep", "f_match", SWEEP.format(k="", src="f_match") + f", c as (select *, (select count(*) from f_gt)-tp as fn from cu) select round(thr,6) as threshold, tp, fp, fn, {_prf('tp','fp','fn')} from c")
def _(t):
    s = B.sweep(B.flag_matches(t.pred, t.gt), t.gt.agg(F.count(F.lit(1)).alias("n_gt")))
    return R6(s, "threshold", "precision", "recall", "f1")


@register("a25_best_threshold", "f_match", SWEEP.format(k="", src="f_match") + f", c as (select *, (select count(*) from f_gt)-tp as fn from cu), r as (select round(thr,6) as threshold, tp, fp, fn, {_prf('tp','fp','fn')}, 2*(tp/greatest(1,tp+fp))*(tp/greatest(1,tp+fn))/greatest(1e-9,tp/greatest(1,tp+fp)+tp/greatest(1,tp+fn)) as ff from c) select threshold, tp, fp, fn, precision, recall, f1 from r order by ff desc, threshold limit 1")
def _(t):
    s = B.sweep(B.flag_matches(t.pred, t.gt), t.gt.agg(F.count(F.lit(1)).alias("n_gt")))
    return R6(B.best_threshold(s), "threshold", "precision", "recall", "f1")


@register("a26_recall_ceiling", "f_iou", BC + " select count(*) as boxes, count(*) filter (b>=0.5) as reachable, round(count(*) filter (b>=0.5)/count(*),6) as ceiling, count(*) filter (side<12) as small_boxes, count(*) filter (b>=0.5 and side<12) as small_reachable from bc")
def _(t):
    return R6(B.recall_ceiling(B.best_candidate(t.gt, t.pred)), "ceiling")


@register("a27_error_causes", "f_iou", BC + " select case when side<12 then '<12px' when side<24 then '12-24px' else '>24px' end as size_bin, count(*) as boxes, count(*) filter (b>=0.5) as matched, count(*) filter (b>0 and b<0.5) as loose, count(*) filter (b=0) as never_proposed from bc group by 1")
def _(t):
    return B.error_causes(B.best_candidate(t.gt, t.pred), SIZES)


PCT = (("p1", .01), ("p25", .25), ("p50", .5), ("p75", .75), ("p99", .99))


@register("a30_size_profile", "f_gt", "select axis, " + ", ".join(f"round(quantile_cont(v,{p}),6) as {n}" for n, p in PCT) + " from (select unnest(['width','height']) as axis, unnest([x2-x1, y2-y1]) as v from f_gt) group by axis")
def _(t):
    from tessera.operators.ordered import exact_percentiles
    long = t.gt.select(F.explode(F.array(F.struct(F.lit("width").alias("axis"), (F.col("x2") - F.col("x1")).alias("v")),
                                         F.struct(F.lit("height").alias("axis"), (F.col("y2") - F.col("y1")).alias("v")))).alias("r")).select("r.*")
    return R6(exact_percentiles(long, ["axis"], "v", dict(PCT)), *[n for n, _ in PCT])


@register("a30_size_counts", "f_gt", "select count(*) as boxes, count(*) filter (x2-x1<16 and y2-y1<16) as small_boxes, count(*) filter (x2-x1=8 and y2-y1=8) as exact_8x8, (select max(n) from (select count(*) as n from f_gt group by image_id)) as max_per_image from f_gt")
def _(t):
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    per = t.gt.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), B.tally((w < 16) & (h < 16)).alias("s"), B.tally((w == 8) & (h == 8)).alias("e"))
    return per.agg(F.sum("n").alias("boxes"), F.sum("s").alias("small_boxes"), F.sum("e").alias("exact_8x8"), F.max("n").alias("max_per_image"))


AB = """, m1 as (select *, image_id%2 as part from f_match), arms as (select part, 'before' as arm, score, tp from m1 union all select part, 'after', round(sqrt(score*((cand_id*7+image_id)%50+50)/100.0),9), tp from m1)"""


@register("a44_part_thresholds", "f_match", ", src as (select image_id%5 as part, score, tp from f_match)" + SWEEP.format(k="part,", src="src") + f""",
g as (select image_id%5 as part, count(*) as n_gt from f_gt group by 1), c as (select *, n_gt-tp as fn from cu join g using (part)),
r as (select part, round(thr,6) as threshold, tp, fp, fn, {_prf('tp','fp','fn')}, row_number() over (partition by part order by 2*(tp/greatest(1,tp+fp))*(tp/greatest(1,tp+fn))/greatest(1e-9,tp/greatest(1,tp+fp)+tp/greatest(1,tp+fn)) desc, thr) as rn from c)
select part, threshold, tp, fp, fn, precision, recall, f1 from r where rn=1""")
def _(t):
    part = F.col("image_id") % 5
    flagged = B.flag_matches(t.pred, t.gt).withColumn("part", part)
    n = t.gt.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n_gt"))
    return R6(B.best_threshold(B.sweep(flagged, n, ["part"]), ["part"]), "threshold", "precision", "recall", "f1")


@register("a44_pooled_figure", "f_match", SWEEP.format(k="", src="f_match") + f""", own as (select count(*) as n from f_gt where image_id in (select image_id from f_match)), c as (select *, (select n from own)-tp as fn from cu),
r as (select round(thr,6) as threshold, tp, fp, fn, {_prf('tp','fp','fn')}, 2*(tp/greatest(1,tp+fp))*(tp/greatest(1,tp+fn))/greatest(1e-9,tp/greatest(1,tp+fp)+tp/greatest(1,tp+fn)) as ff from c)
select threshold, tp, fp, fn, precision, recall, f1, (select count(distinct image_id) from f_match) as pairs, (select n from own) as gt_boxes from r order by ff desc, threshold limit 1""")
def _(t):
    """The figure over the candidates of five parts pooled."""
    pooled = B.pooled_figure(t.pred.withColumn("part", F.col("image_id") % 5), t.gt)
    return R6(pooled, "threshold", "precision", "recall", "f1")


@register("a44_rescoring_ab")
def _(t):
    # rescoring changes the visit order, so each arm is matched on its own
    c = F.col
    v = ((c("cand_id") * 7 + c("image_id")) % 50 + 50) / 100.0
    # both arms from one row, so that they stay where the image is
    pred = t.pred.withColumn("part", c("image_id") % 2).withColumn("arm", F.explode(F.array(F.lit("before"), F.lit("after"))))
    pred = pred.withColumn("score", F.when(c("arm") == "before", c("score")).otherwise(F.sqrt(c("score") * v)))
    flagged = B.flag_matches(pred, t.gt, keys=["arm", "part"])
    n = t.gt.groupBy((c("image_id") % 2).alias("part")).agg(F.count(F.lit(1)).alias("n_gt")).withColumn("arm", F.explode(F.array(F.lit("before"), F.lit("after"))))
    best = B.best_threshold(B.sweep(flagged, n, ["arm", "part"]), ["arm", "part"])
    pick = lambda arm_name, col: F.max(F.when(c("arm") == arm_name, c(col)))
    return best.groupBy("part").agg(pick("before", "f1").alias("f1_before"), pick("after", "f1").alias("f1_after"), pick("before", "threshold").alias("thr_before"),
                                    pick("after", "threshold").alias("thr_after")).withColumn("delta_f1", c("f1_after") - c("f1_before"))


# ---- ranking ---------------------------------------------------------------------------------

@register("w06_top_boxes", "f_pred", "select image_id, cand_id, cast(r as int) as rank from (select *, row_number() over (partition by image_id order by score desc, cand_id) as r from f_pred) where r<=4")
def _(t):
    return B.top_per_image(t.pred, 4).select("image_id", "cand_id", "rank")


@register("w07_hard_negatives", "f_iou", BEST + """
, q as (select image_id, 1*greatest(count(*) filter (band='positive'),1) as quota from bt group by image_id),
n as (select *, row_number() over (partition by image_id order by score desc, cand_id) as r from bt where band='negative')
select image_id, cand_id, band from n join q using (image_id) where r<=quota union all select image_id, cand_id, band from bt where band='positive'""")
def _(t):
    return B.hard_negatives(B.best_truth(t.pred, t.gt), per_positive=1, sizes=t.pred).select("image_id", "cand_id", "band")


@register("w11_fused_boxes")
def _(t):
    return B.fuse_boxes(t.pred, n_sources=3)


# ---- rasters ---------------------------------------------------------------------------------

INK = """, ink as (select b.image_id, b.box_id, avg(t_ink) as t_mean, avg(p_ink) as p_mean from f_rbox b join f_raster r on r.image_id=b.image_id and r.x>=cast(trunc(b.x1) as int) and r.x<cast(trunc(b.x2) as int) and r.y>=cast(trunc(b.y1) as int) and r.y<cast(trunc(b.y2) as int) group by all)"""


@register("j17_polarity_filter", "f_rbox f_raster", INK + " select image_id, box_id, round(t_mean,6) as t_mean, round(p_mean,6) as p_mean from ink where not (t_mean>3.9 and p_mean<3.9)")
def _(t):
    return R6(X.polarity_filter(t.raster_boxes, t.raster, 3.9).select("image_id", "box_id", "t_mean", "p_mean"), "t_mean", "p_mean")


@register("a30_polarity_counts", "f_rbox f_raster", INK + " select count(*) as boxes, count(*) filter (t_mean<4 and p_mean>4) as additions, count(*) filter (p_mean<4 and t_mean>4) as deletions, count(*) filter (t_mean>=4 and p_mean>=4) as modifications, round(avg(case when p_mean>t_mean then 1.0 else 0 end),6) as more_ink_share from ink")
def _(t):
    return R6(X.polarity_counts(X.box_ink(t.raster_boxes, t.raster), 4.0), "more_ink_share")


@register("j18_snapped_boxes", "f_rbox f_raster", """
, d as (select image_id, y, x from f_raster where abs(p_ink-t_ink)>25),
fit as (select b.image_id, b.box_id, count(*) as n, min(x) as n_x1, min(y) as n_y1, max(x)+2 as n_x2, max(y)+2 as n_y2 from f_rbox b join d on d.image_id=b.image_id
  and d.x>=cast(trunc(greatest(b.x1-6,0)) as int) and d.x<cast(trunc(least(b.x2+6,12)) as int) and d.y>=cast(trunc(greatest(b.y1-6,0)) as int) and d.y<cast(trunc(least(b.y2+6,12)) as int) group by all having count(*)>=3),
j as (select b.*, n_x1, n_y1, n_x2, n_y2, coalesce(greatest(abs(n_x1-x1),abs(n_y1-y1),abs(n_x2-x2),abs(n_y2-y2))<=6, false) as ok from f_rbox b left join fit using (image_id,box_id))
select image_id, box_id, cast(case when ok then n_x1 else x1 end as double) as x1, cast(case when ok then n_y1 else y1 end as double) as y1, cast(case when ok then n_x2 else x2 end as double) as x2, cast(case when ok then n_y2 else y2 end as double) as y2, ok as snapped from j""")
def _(t):
    return X.snap_to_ink(t.raster_boxes, t.raster, 12, 12)


@register("w08_heatmap_boxes", "f_grid", """
, n as (select a.image_id, a.y, a.x, any_value(a.score) as score, any_value(a.w) as w, any_value(a.h) as h, max(b.score) as m from f_grid a join f_grid b on a.image_id=b.image_id and b.x between a.x-1 and a.x+1 and b.y between a.y-1 and a.y+1 group by a.image_id, a.y, a.x),
r as (select *, row_number() over (partition by image_id order by score desc, y, x) as rank from n where score=m)
select image_id, cast(rank as int) as rank, round(score,6) as score, x*4-w/2 as x1, y*4-h/2 as y1, x*4+w/2 as x2, y*4+h/2 as y2 from r where rank<=64 and score>=0.05""")
def _(t):
    return R6(X.heatmap_boxes(t.grid_tiles), "score")


CLOSED = """, m as (select image_id, y, x, case when abs(p_ink-t_ink)>25 then 1 else 0 end as m from f_raster),
g as (select a.image_id, a.y, a.x, max(b.m) as m from m a join m b on a.image_id=b.image_id and b.x between a.x-1 and a.x+1 and b.y between a.y-1 and a.y+1 group by all),
e as (select a.image_id, a.y, a.x, min(b.m) as m from g a join g b on a.image_id=b.image_id and b.x between a.x-1 and a.x+1 and b.y between a.y-1 and a.y+1 group by all),
px as (select image_id, y, x, y*12+x as id from e where m=1)"""


@register("m32_difference_blobs", "f_raster", CLOSED + """
, ed as (select a.image_id, a.id as a, b.id as b from px a join px b on a.image_id=b.image_id and b.x between a.x-1 and a.x+1 and b.y between a.y-1 and a.y+1),
reach as (select image_id, id as a, id as b from px union select r.image_id, r.a, ed.b from reach r join ed on ed.image_id=r.image_id and ed.a=r.b),
lab as (select image_id, a as id, min(b) as label from reach group by all),
c as (select image_id, min(x) as x1, min(y) as y1, max(x)+1 as x2, max(y)+1 as y2, count(*) as area from px join lab using (image_id,id) group by image_id, label)
select image_id, x1, y1, x2, y2, area, round(least(1.0, area/200.0),6) as score from c where area>=12""")
def _(t):
    return R6(X.difference_blobs(t.raster_tiles), "score")
