"""Registered retrieval queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tessera.operators import docs as D, retrieval as R
from tessera.plans.registry import register
from tessera.session import cut

R6 = lambda df, *cols: df.withColumns({x: F.round(F.col(x).cast("double"), 6) for x in cols})
c = F.col


def nth_vector(t, keyed, at):
    """The stored vector at a place that repeats through all of them."""
    e = t.table("embeddings")
    total = e.agg(F.count(F.lit(1))).scalar()
    return keyed.withColumn("__v", F.pmod(at, total)).join(e.select(c("vec_id").alias("__v"), c("embedding").cast("array<double>").alias("vector")), "__v").drop("__v")


def chunks(t, dims=64):
    """Every document as a chunk of its language's corpus, with a stored vector."""
    d = nth_vector(t, texts(t), c("doc_id"))
    return d.withColumn("vector", F.slice("vector", 1, dims))


def texts(t):
    """Every document as a chunk of its language's corpus."""
    return t.table("documents").select(c("lang").alias("corpus"), "doc_id", "text")


def queries(t, dims=64):
    """Every benchmark item, whole, with a stored vector."""
    q = nth_vector(t, t.table("benchmark").select(c("item_id").alias("query_id"), "text", c("text").alias("item")), c("query_id") * 7 + 3)
    return q.withColumn("vector", F.slice("vector", 1, dims))


BM = """with q as (select item_id as query_id, text as item, text from benchmark),
qt as (select query_id, term, count(*) as qtf from (select query_id, unnest(list_transform(regexp_extract_all(text,'[a-zA-Z0-9]+'), lambda x: lower(x))) as term from q) group by all),
dt as (select lang as corpus, doc_id, list_transform(regexp_extract_all(text,'[a-zA-Z0-9]+'), lambda x: lower(x)) as tk from documents),
st as (select corpus, count(*) as n, avg(len(tk)) as avgdl from dt group by corpus),
po as (select corpus, doc_id, len(tk) as dl, unnest(tk) as term from dt), tf as (select corpus, term, doc_id, count(*) as tf, any_value(dl) as dl from po group by all),
dfr as (select corpus, term, ln(n-count(*)+0.5)-ln(count(*)+0.5) as raw from tf join st using (corpus) group by corpus, term, n),
idf as (select corpus, term, case when raw<0 then 0.25*avg(raw) over (partition by corpus) else raw end as idf from dfr),
bm as (select query_id, corpus, doc_id, sum(qtf*idf*tf*2.5/(tf+1.5*(0.25+0.75*dl/avgdl))) as score, count(*) as mt from tf join qt using (term) join idf using (corpus,term) join st using (corpus) group by query_id, corpus, doc_id)"""


def dense_sql(dims=64, name=""):
    """CTEs ds (all cosines) and fu (both scores scaled) for vectors of some leading dimensions."""
    return f"""
nv{name} as (select count(*) as nv from embeddings),
dv{name} as (select d.doc_id, d.lang as corpus, cast(e.embedding[1:{dims}] as double[]) as de from documents d, nv{name} join embeddings e on e.vec_id = d.doc_id % nv),
qv{name} as (select b.item_id as query_id, cast(e.embedding[1:{dims}] as double[]) as qe from benchmark b, nv{name} join embeddings e on e.vec_id = (b.item_id * 7 + 3) % nv),
ds{name} as (select query_id, corpus, doc_id, list_dot_product(qe,de)/((sqrt(list_dot_product(qe,qe))+1e-9)*(sqrt(list_dot_product(de,de))+1e-9)) as dense from qv{name}, dv{name}),
lx{name} as (select ds{name}.*, coalesce(bm.score, 0) as lex from ds{name} left join bm using (query_id, corpus, doc_id)),
ex{name} as (select *, min(dense) over w as d0, max(dense) over w as d1, min(lex) over w as l0, max(lex) over w as l1 from lx{name} window w as (partition by query_id, corpus)),
fu{name} as (select query_id, corpus, doc_id, case when d1-d0<1e-9 then 0 else (dense-d0)/(d1-d0) end as dn, case when l1-l0<1e-9 then 0 else (lex-l0)/(l1-l0) end as bn from ex{name})"""


def ranked_sql(score, source, k, name="tk", order="desc"):
    return f"{name} as (select *, {score} as s, cast(row_number() over (partition by query_id, corpus order by round({score},9) {order}, doc_id) as int) as rank from {source} qualify rank<={k})"


@register("r01_bm25", "", BM + ", " + ranked_sql("score", "bm", 20) + " select query_id, corpus, doc_id, rank, round(score,6) as score from tk")
def _(t):
    return R6(R.bm25(texts(t), queries(t)).select("query_id", "corpus", "doc_id", "rank", "score"), "score")


@register("r02_dense_scores", "", BM + "," + dense_sql() + ", " + ranked_sql("dense", "ds", 20) + " select query_id, corpus, doc_id, rank, round(dense,6) as dense from tk")
def _(t):
    return R6(R.cosine_top(queries(t), chunks(t)), "dense")


@register("r03_fused_scores", "", BM + "," + dense_sql() + ", " + ranked_sql("0.5*dn+0.5*bn", "fu", 20) + " select query_id, corpus, doc_id, rank, round(round(s,9),6) as fused from tk")
def _(t):
    return R6(R.hybrid_top(chunks(t), queries(t), [0.5], 20).select("query_id", "corpus", "doc_id", "rank", "fused"), "fused")


def token_tables(t):
    """Four token vectors of sixteen dimensions out of each stored vector."""
    four = lambda v: F.array(*[F.slice(v, i * 16 + 1, 16) for i in range(4)])
    return queries(t).select("query_id", four("vector").alias("q_tokens")), chunks(t).select("doc_id", four("vector").alias("d_tokens"))


def rerank_sql(alpha):
    return (BM + "," + dense_sql() + ", " + ranked_sql(f"{alpha}*dn+{1 - alpha}*bn", "fu", 24, "f24") + """,
rr as (select f.query_id, f.corpus, f.doc_id, round(list_sum(list_transform(range(4), lambda i: list_max(list_transform(range(4), lambda j: list_dot_product(q.qe[i*16+1:i*16+16], d.de[j*16+1:j*16+16]))))),9) as rerank
 from f24 f join qv q using (query_id) join dv d using (doc_id)), """ + ranked_sql("rerank", "rr", 6, "t6"))


def reranked(t, alpha, top=6):
    q, d = token_tables(t)
    return R.two_stage(R.hybrid_top(chunks(t), queries(t), [alpha], 24), q, d, top)


@register("r04_two_stage", "", rerank_sql(0.5) + " select query_id, corpus, doc_id, rank from t6")
def _(t):
    return reranked(t, 0.5).select("query_id", "corpus", "doc_id", "rank")


@register("r05_late_interaction", "", rerank_sql(0.5) + " select query_id, corpus, doc_id, round(rerank,6) as rerank from rr")
def _(t):
    q, d = token_tables(t)
    first = R.hybrid_top(chunks(t), queries(t), [0.5], 24)
    return R6(R.late_interaction(first.select("query_id", "corpus", "doc_id"), q, d).withColumn("rerank", F.round("rerank", 9)), "rerank")


def vectors(t):
    e = t.table("embeddings")
    return (e.filter("vec_id % 25 = 0").select(c("vec_id").alias("query_id"), c("embedding").alias("vector")),
            e.filter("vec_id % 25 <> 0").select(c("vec_id").alias("doc_id"), c("embedding").alias("vector"), "label"))


NEAR = """with v as (select vec_id, label, cast(embedding as double[]) as e from embeddings), q as (select vec_id as query_id, e as qe from v where vec_id%25=0), d as (select vec_id as doc_id, e as de, label from v where vec_id%25<>0),
ds as (select query_id, doc_id, label, list_distance(qe,de) as dist from q, d), rk as (select *, row_number() over (partition by query_id, label order by dist, doc_id) as rank from ds)"""


def near(t):
    q, d = vectors(t)
    return R.class_neighbours(q, d)


@register("j09_class_distances", "", NEAR + " select query_id, label, " + ", ".join(f"round(avg(case when rank<={k} then dist end),6) as knn{k}_dist" for k in (1, 3, 5)) + " from rk group by all")
def _(t):
    return R6(R.class_distances(near(t)), "knn1_dist", "knn3_dist", "knn5_dist")


@register("j09_nearest_class", "", NEAR + """, a as (select query_id, list({'d':dist,'l':label} order by dist, label) as a from rk where rank=1 group by query_id), t as (select *, row_number() over (partition by query_id order by dist, doc_id) as r from ds)
select query_id, a[1].l as argmin, round(a[2].d-a[1].d,6) as margin, """ + ", ".join(f"round(count(*) filter (label={k})/10.0,6) as vote_{k}" for k in range(10)) + " from t join a using (query_id) where r<=10 group by query_id, a")
def _(t):
    return R6(R.nearest_class(near(t)), "margin", *[f"vote_{k}" for k in range(10)])


# ---- text retrieval with a known answer ------------------------------------------------------

AL = [0.0, 0.1, 0.25, 0.4, 0.5, 0.6, 0.75, 0.9, 1.0]
ENCODERS = {"full": 64, "half": 32}  # all dimensions of the stored vectors, or the leading half
REL = "rel as (select query_id, lang as corpus, doc_id from q join documents d on contains(d.text, q.item))"


def _grid_sql():
    part = lambda name: f"""tk_{name} as (select alpha, query_id, corpus, doc_id, row_number() over (partition by alpha, query_id, corpus order by round(alpha*dn+(1-alpha)*bn,9) desc, doc_id) as rank from fu_{name}, al qualify rank<=5),
fr_{name} as (select alpha, query_id, corpus, min(rank) as fr from tk_{name} join rel using (query_id,corpus,doc_id) group by all)"""
    one = lambda name: f"select '{name}' as encoder, alpha, k, count(*) filter (fr<=k) as hits, count(*) as asked, round(count(*) filter (fr<=k)/count(*),6) as hit_rate from ask left join fr_{name} using (alpha,query_id,corpus), k group by alpha, k"
    heads = ",".join(dense_sql(dims, f"_{name}") for name, dims in ENCODERS.items())
    return (BM + "," + heads + ", " + REL + f", al as (select unnest({AL}::double[]) as alpha), ask as (select distinct query_id, corpus, alpha from rel, al), k as (select unnest([3,5]) as k), "
            + ", ".join(map(part, ENCODERS)) + " " + " union all ".join(map(one, ENCODERS)))


@register("a43_hit_rates", "", _grid_sql())
def _(t):
    rel = cut(R.containing(texts(t), queries(t)))
    best = cut(R.hybrid_top(chunks(t), queries(t), AL, 5, list(ENCODERS.values())))
    parts = [R.hit_rates(best.filter(c("dims") == dims), rel).withColumn("encoder", F.lit(name)) for name, dims in ENCODERS.items()]
    return R6(reduce(lambda a, b: a.unionByName(b), parts), "hit_rate")


@register("a43_phrase_hits", "", BM + "," + dense_sql() + ", " + ranked_sql("0.25*dn+0.75*bn", "fu", 5) + f""",
ph as (select query_id, list_filter(list_distinct(list_transform(regexp_extract_all(text,'[a-zA-Z0-9]+'), lambda x: lower(x))), lambda w: not list_contains([{",".join(f"'{w}'" for w in D.STOP_WORDS)}], w)) as ph from q),
tx as (select query_id, tk.corpus, list(lower(d.text)) as ts from tk join documents d on d.doc_id=tk.doc_id group by all), r as (select query_id, corpus, len(list_filter(ph, lambda p: len(list_filter(ts, lambda x: contains(x,p)))=0))=0 as phrase_hit from tx join ph using (query_id))
select corpus, count(*) filter (phrase_hit) as hits, count(*) as asked from r group by corpus""")
def _(t):
    best = R.hybrid_top(chunks(t), queries(t), [0.25], 5)
    ph = queries(t).select("query_id", D.content_tokens(c("text")).alias("phrase"))
    r = R.phrase_hits(best, texts(t), ph, ["query_id", "corpus"], 5)
    return r.groupBy("corpus").agg(F.sum(F.when(c("phrase_hit"), 1).otherwise(0)).alias("hits"), F.count(F.lit(1)).alias("asked"))


@register("r06_batched_retrieval", "", rerank_sql(0.25) + " select query_id, corpus, doc_id, rank, round(rerank,6) as rerank from t6")
def _(t):
    return R6(reranked(t, 0.25).select("query_id", "corpus", "doc_id", "rank", "rerank"), "rerank")


@register("j16_context_pointers", "", rerank_sql(0.25) + """, r as (select t.*, 1+d.doc_id%9 as track, d.text as body from t6 t join documents d using (doc_id) where rank<=3),
s as (select corpus, track, body, min(query_id*100+rank) as first from r group by all), n as (select *, 'E'||row_number() over (partition by corpus order by first) as label from s)
select corpus, query_id, string_agg(label, ', ' order by rank) as pointers from r join n using (corpus, track, body) group by all""")
def _(t):
    tracked = texts(t).withColumn("track", (1 + c("doc_id") % 9).cast("int"))
    return R.context_pointers(tracked.join(R.few(reranked(t, 0.25, 3).select("query_id", "corpus", "doc_id", "rank")), ["corpus", "doc_id"]))
