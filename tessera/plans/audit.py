"""Registered verdict, ledger and search-record queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import ledger, search, verdicts
from tessera.plans.registry import register

R6 = lambda df, *cols: df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in cols})
WIDE = lambda v, src: "select case_id, " + ", ".join(f"coalesce(max(case when cp={i} then {v} end),'') as CP{i}" for i in range(1, 42)) + f" from {src} group by case_id"


@register("s13_wide_verdicts", "f_verdict", WIDE("pred", "f_verdict where (case_id+cp)%10<>0"))
def _(t):
    return verdicts.wide(t.verdict.filter("(case_id + cp) % 10 <> 0"), "pred")


@register("s13_missing_cases", "f_verdict", "select distinct case_id from f_verdict where case_id%7=0")
def _(t):
    done = t.verdict.filter("case_id % 7 <> 0").select("case_id").distinct()
    return verdicts.missing_cases(t.verdict, done)


@register("s14_gold_export", "f_verdict", WIDE("gold", "f_verdict"))
def _(t):
    # drafts are nested, as they are stored: one row per case with an array of verdicts
    drafts = t.verdict.groupBy("case_id").agg(F.collect_list(F.struct("cp", F.col("gold").alias("verdict"))).alias("verdicts"))
    long = drafts.select("case_id", F.explode("verdicts").alias("v")).select("case_id", "v.*")
    return verdicts.wide(long, "verdict")


@register("s14_grid_problems", "f_verdict", """
select case_id, 41 - count(distinct cp) filter (not (case_id%5=0 and cp%9=0)) as missing, count(*) filter (case_id%6=0 and cp=3) as invalid from f_verdict group by case_id
having 41 - count(distinct cp) filter (not (case_id%5=0 and cp%9=0))>0 or count(*) filter (case_id%6=0 and cp=3)>0""")
def _(t):
    v = t.verdict.filter("not (case_id % 5 = 0 and cp % 9 = 0)").withColumn(
        "gold", F.when((F.col("case_id") % 6 == 0) & (F.col("cp") == 3), "yes").otherwise(F.col("gold")))
    return verdicts.grid_problems(v, "gold")


def _cells(t):
    gold = t.verdict.select("case_id", "cp", "element", "gold")
    # the prediction comes back from its wide form, as a scorer reads it
    pred = verdicts.long_form(verdicts.wide(t.verdict, "pred"), "pred").select("case_id", "cp", "pred")
    return verdicts.score_cells(gold, pred)


@register("j14_score_cells", "f_verdict", "select case_id, cp, gold, pred, gold=pred as ok from f_verdict")
def _(t):
    return _cells(t).select("case_id", "cp", "gold", "pred", "ok")


@register("a31_accuracy_report", "f_verdict", """
, g as (select element, cp, case_id, sum(case when gold=pred then 1 else 0 end) as correct, count(*) as total, grouping(element) as ge, grouping(cp) as gc, grouping(case_id) as gs from f_verdict group by grouping sets ((), (element), (cp), (case_id)))
select case when ge=0 then 'element' when gc=0 then 'cp' when gs=0 then 'case' else 'overall' end as level, coalesce(element, cast(cp as varchar), cast(case_id as varchar), 'all') as name, cast(correct as bigint) as correct, total, round(correct/total,6) as accuracy from g""")
def _(t):
    return R6(verdicts.accuracy_report(_cells(t)), "accuracy")


@register("a31_case_spread", "f_verdict", """
, c as (select case_id, avg(case when gold=pred then 1.0 else 0 end) as acc from f_verdict group by case_id) select count(*) as cases, round(avg(acc),6) as mean, round(stddev_pop(acc),6) as std, round(min(acc),6) as min, round(max(acc),6) as max from c""")
def _(t):
    return R6(verdicts.case_spread(_cells(t)), "mean", "std", "min", "max")


@register("a31_macro_scores", "f_verdict", """
, v as (select unnest(['1','0','N/A']) as v), s as (select v, (select count(*) from f_verdict where gold=v) as a, (select count(*) from f_verdict where pred=v) as c, (select count(*) from f_verdict where gold=v and pred=v) as tp from v)
select round(sum(tp)/sum(a),6) as micro_accuracy, round(avg(2*tp/(a+c)),6) as macro_f, round(avg(tp/a),6) as macro_accuracy from s""")
def _(t):
    return R6(verdicts.macro_scores(_cells(t)), "micro_accuracy", "macro_f", "macro_accuracy")


ARB = """, v as (select case_id, cp, confidence, case when (case_id+cp)%13=0 then null else pred end as v1, case when (case_id+cp)%17=0 then null else vote2 end as v2, vote3 as v3 from f_verdict),
n as (select *, len(list_filter([v1,v2,v3], lambda x: x is not null)) as n, v1 is not null and confidence>=0.8 as sure from v),
j as (select *, greatest((v1=v2 and v2=v3)::int*3, coalesce(v1=v2 or v1=v3 or v2=v3,false)::int*2) as top, case when v1=v2 or v1=v3 then v1 when v2=v3 then v2 end as maj from n)
select case_id, cp, case when sure then v1 when n<3 then coalesce(v1,v2,v3,'0') when top>=2 then maj else v1 end as verdict,
 case when sure then 'single_high_confidence' when n<3 then 'incomplete_escalation_votes' when top=3 then 'unanimous' when top=2 then 'majority' else 'split_pending_tiebreak' end as source,
 cast(case when sure then confidence when n<3 then 0.3 when top=3 then 1.0 when top=2 then 0.7 else 0.4 end as double) as final_confidence from j"""


@register("a32_arbitration", "f_verdict", ARB)
def _(t):
    gone = lambda m, c: F.when((F.col("case_id") + F.col("cp")) % m != 0, F.col(c))
    v = t.verdict.select("case_id", "cp", "confidence", gone(13, "pred").alias("v1"), gone(17, "vote2").alias("v2"), F.col("vote3").alias("v3"))
    return verdicts.arbitrate(v, ["v1", "v2", "v3"]).select("case_id", "cp", "verdict", "source", "final_confidence")


@register("r07_set_operations", "f_verdict", """
, a as (select case_id, cp from f_verdict where gold='1'), b as (select case_id, cp from f_verdict where pred='1')
select 'union' as op, count(*) as n from (select * from a union select * from b) union all select 'intersect', count(*) from (select * from a intersect select * from b)
union all select 'except', count(*) from (select * from a except select * from b) union all select 'distinct_cp', count(distinct cp) from a""")
def _(t):
    a, b = (t.verdict.filter(F.col(c) == "1").select("case_id", "cp") for c in ("gold", "pred"))
    named = lambda n, d: d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("op"), "n")
    return (named("union", a.union(b).distinct()).unionByName(named("intersect", a.intersect(b)))
            .unionByName(named("except", a.subtract(b))).unionByName(named("distinct_cp", a.select("cp").distinct())))


# ---- ledger ----------------------------------------------------------------------------------

@register("s18_request_log", "f_ledger", """
, r as (select case_id, turn, md5('provider|'||model||'|0.0|'||response) as prompt_hash from f_ledger)
select case_id, turn, prompt_hash, prompt_hash in (select prompt_hash from r where case_id%3=0) as cached from r""")
def _(t):
    reqs = t.ledger.select("case_id", "turn", ledger.request_key(F.lit("provider"), F.col("model"), F.lit("0.0"), F.col("response")).alias("prompt_hash"))
    log = ledger.append_log(reqs)
    return ledger.cache_hits(log, log.filter("case_id % 3 = 0")).select("case_id", "turn", "prompt_hash", "cached")


@register("s19_resumable_batch", "f_ledger", """
select case_id, turn, case when finish_reason='length' or completion_tokens>=600 then 'truncated' else 'ok' end as status from f_ledger
where case_id not in (select case_id from f_ledger where case_id%4=1)""")
def _(t):
    done = t.ledger.filter("case_id % 4 = 1")
    return ledger.call_status(ledger.resume(t.ledger, done), 600).select("case_id", "turn", "status")


@register("s19_followed_log", "f_ledger", "select case_id, turn, case when finish_reason='length' or completion_tokens>=600 then 'truncated' else 'ok' end as status from f_ledger")
def _(t):
    from tessera.session import scratch_path
    from tessera.streaming.ledger import follow_log
    log, out, progress = (scratch_path(t.spark, n) for n in ("log", "calls", "progress"))
    # two arrivals, and a second run that must take only what is new
    ledger.append_log(t.ledger.filter("case_id % 2 = 0"), log)
    follow_log(t.spark, log, out, progress, 600)
    ledger.append_log(t.ledger.filter("case_id % 2 = 1"), log)
    return follow_log(t.spark, log, out, progress, 600).select("case_id", "turn", "status")


@register("a33_ledger_totals", "f_ledger", """
select model, case_id, count(*) as calls, cast(sum(prompt_tokens) as bigint) as prompt_tokens, cast(sum(completion_tokens) as bigint) as completion_tokens, cast(sum(prompt_tokens+completion_tokens) as bigint) as total_tokens, count(*) filter (finish_reason='length') as finish_length, cast(grouping(model,case_id) as bigint) as level from f_ledger group by rollup(model,case_id)""")
def _(t):
    return ledger.totals(t.ledger)


@register("a33_finish_mix", "f_ledger", "select model, finish_reason, count(*) as calls from f_ledger group by all")
def _(t):
    return ledger.finish_mix(t.ledger)


@register("a42_status_counts", "f_ledger", "select case_id%8 as shard, case when finish_reason='length' or completion_tokens>=600 then 'truncated' else 'ok' end as status, count(*) as n from f_ledger group by all")
def _(t):
    return ledger.status_counts(ledger.call_status(t.ledger, 600), "status", F.col("case_id") % 8)


@register("f17_parsed_verdicts", "f_ledger", """
select case_id, turn, 'CP'||turn as cp, case when turn%4=3 then '1' else 'N/A' end as verdict from f_ledger where turn%4 in (1,3) and turn between 1 and 41""")
def _(t):
    return ledger.parse_verdicts(t.ledger, ["case_id", "turn"], "response")


@register("f17_parsed_damaged_text", "f_ledger", """
select case_id, turn, 'CP'||turn as cp, '0' as verdict from f_ledger where turn between 1 and 41""")
def _(t):
    # cut off after the second object: no closing bracket, so only the pattern can read it
    broken = t.ledger.withColumn("response", F.concat(F.lit('Result: [{"cp": "CP'), F.col("turn").cast("string"), F.lit('", "reason": "x", "verdict": "0"}, {"cp": "CP')))
    return ledger.parse_verdicts(broken, ["case_id", "turn"], "response")


@register("f18_rendered_prompt", "f_ledger", """
, s as (select case_id, list(distinct 'CP'||turn order by 'CP'||turn) as cps, min(response) as ctx from f_ledger group by case_id)
select case_id, 'Judge ' || case when len(cps)>=41 then 'all 41 checking points (CP1 through CP41)' else 'these '||len(cps)||' checking point(s): '||array_to_string(cps, ', ') end || ' on ' || ctx as prompt from s""")
def _(t):
    # at most 41 names per case
    s = t.ledger.groupBy("case_id").agg(F.sort_array(F.collect_set(F.concat(F.lit("CP"), F.col("turn").cast("string")))).alias("cps"), F.min("response").alias("ctx"))
    return s.select("case_id", ledger.render("Judge {CP_SCOPE_TEXT} on {CONTEXT_BLOCK}", {"CONTEXT_BLOCK": F.col("ctx"), "CP_SCOPE_TEXT": ledger.scope_text(F.col("cps"))}).alias("prompt"))


# ---- search record ---------------------------------------------------------------------------

DEDUPE = ", d as (select * from f_search qualify row_number() over (partition by hash order by seq desc)=1)"


@register("s20_rebuilt_record", "f_search", DEDUPE + " select model, count(*) as points, round(max(group_acc),6) as best_group_acc from d group by model")
def _(t):
    return R6(search.family_counts(search.last_per_key(t.search, "hash", "seq")), "best_group_acc")


@register("s20_members", "f_search", DEDUPE + " select hash, model, round(group_acc,6) as group_acc from d where group_acc>=0.7 and target_feats")
def _(t):
    rec = search.last_per_key(t.search, "hash", "seq")
    return R6(search.members(rec, 0.7, True, "target_feats").select("hash", "model", "group_acc"), "group_acc")


@register("a34_merged_record", "f_search", DEDUPE + " select hash, seq, model, features, target_feats, round(group_acc,6) as group_acc, round(fit_seconds,6) as fit_seconds from d")
def _(t):
    prev, new = t.search.filter("seq % 2 = 0"), t.search.filter("seq % 2 = 1")
    return R6(search.last_per_key(prev.unionByName(new), "hash", "seq"), "group_acc", "fit_seconds")


@register("a34_best_row", "f_search", DEDUPE + " select hash, model, round(group_acc,6) as group_acc from d order by group_acc desc, hash limit 1")
def _(t):
    return R6(search.best_row(search.last_per_key(t.search, "hash", "seq")).select("hash", "model", "group_acc"), "group_acc")


@register("a35_finalists", "f_search", DEDUPE + """
, r as (select *, row_number() over (partition by model order by group_acc desc, hash) as family_rank from d)
select hash, model, family_rank, round(group_acc,6) as group_acc from r where family_rank<=6 order by group_acc desc, hash limit 12""")
def _(t):
    out = search.finalists(search.last_per_key(t.search, "hash", "seq"), 6, 12)
    return R6(out.select("hash", "model", F.col("family_rank").cast("bigint").alias("family_rank"), "group_acc"), "group_acc")


@register("a36_ablation", "f_search", "select features, round(max(case when target_feats then group_acc end),6) as best_with, round(max(case when not target_feats then group_acc end),6) as best_without, round(sum(fit_seconds)/3600,6) as fit_hours from f_search group by features")
def _(t):
    return R6(search.ablation(t.search), "best_with", "best_without", "fit_hours")


@register("m10_spec_grid", "f_search", """
, b as (select distinct model, features from f_search), g as (select * from b, (select unnest([4,6,8]) as depth), (select unnest([100,300]) as trees), (select unnest([0,1]) as seed))
select model, features, depth, trees, seed, substring(sha1('{"depth":'||depth||',"features":"'||features||'","model":"'||model||'","seed":'||seed||',"trees":'||trees||'}'),1,16) as spec_key from g""")
def _(t):
    base = t.search.select("model", "features").distinct()
    grid = search.spec_grid(base, {"depth": [4, 6, 8], "trees": [100, 300], "seed": [0, 1]})
    return grid.withColumn("spec_key", search.spec_key(["model", "features", "depth", "trees", "seed"]))


STAGES = {"forest": {"numTrees": [600, 1200], "maxDepth": [12, 24], "minInstancesPerNode": [1, 2, 4]},
          "boosted": {"maxIter": [400, 800], "maxDepth": [3, 4, 6, 8], "stepSize": [0.03, 0.06, 0.12]}}


@register("m10_stage_specs", "f_search", """
, b as (select distinct features, target_feats from f_search),
f as (select features, target_feats, 'forest' as model, '{"maxDepth":'||d||',"minInstancesPerNode":'||l||',"numTrees":'||n||'}' as params
  from b, (select unnest([12,24]) as d), (select unnest([1,2,4]) as l), (select unnest([600,1200]) as n)),
g as (select features, target_feats, 'boosted' as model, '{"maxDepth":'||d||',"maxIter":'||n||',"stepSize":'||cast(r as double)||'}' as params
  from b, (select unnest([3,4,6,8]) as d), (select unnest([400,800]) as n), (select unnest([0.03,0.06,0.12]) as r))
select *, substring(sha1('{"features":"'||features||'","model":"'||model||'","params":'||params||',"target_feats":'||target_feats||'}'),1,16) as spec_key
from (from f union all from g)""")
def _(t):
    return search.stage_specs(t.search.select("features", "target_feats").distinct(), STAGES)


@register("m10_ablation_specs", "f_search", DEDUPE + """
, r as (select model, row_number() over (partition by model order by group_acc desc, hash) as k from d),
g as (select model, features, target_feats, probes from r, (select unnest(['full','top120','top60']) as features), (select unnest([true,false]) as target_feats),
  (select unnest([true,false]) as probes) where k=1)
select *, substring(sha1('{"features":"'||features||'","model":"'||model||'","probes":'||probes||',"target_feats":'||target_feats||'}'),1,16) as spec_key from g""")
def _(t):
    """The best family members under every setting of the feature blocks."""
    best = search.finalists(search.last_per_key(t.search, "hash", "seq"), 1, 100).select("model")
    specs = search.switched(best, {"features": ["full", "top120", "top60"], "target_feats": [True, False], "probes": [True, False]})
    return specs.withColumn("spec_key", search.spec_key(specs.columns))


@register("m10_open_seed_bags", "f_search", DEDUPE + """
, p as (select model, features from d order by group_acc desc, hash limit 12),
g as (select distinct model, features, bag, '{"numTrees":'||n||',"temperature":'||cast(x as double)||'}' as params
  from p, (select unnest([1,5]) as bag), (select unnest([8,16,32]) as n), (select unnest([0.75,0.9,1.05]) as x)),
k as (select *, substring(sha1('{"bag":'||bag||',"features":"'||features||'","model":"'||model||'","params":'||params||'}'),1,16) as spec_key from g)
select * from k where bag=5 or model not in (select model from d where group_acc<0.56)""")
def _(t):
    """Seed bags of the best points, without the single fits of families that have a poor record already."""
    rec = search.last_per_key(t.search, "hash", "seq")
    best = rec.orderBy(F.desc("group_acc"), "hash").limit(12).select("model", "features").distinct()
    specs = search.spec_list(search.switched(best, {"bag": [1, 5]}), {"numTrees": [8, 16, 32], "temperature": [0.75, 0.9, 1.05]})
    poor = rec.filter("group_acc < 0.56").select("model").distinct()
    tried = specs.filter("bag = 1").join(poor, "model", "left_semi")
    return search.open_specs(specs, tried)
