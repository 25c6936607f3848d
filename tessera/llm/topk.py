"""Exact top-k by inner product: branch and bound over blocks of dimensions in vertical layout.

Queries and candidates are dealt into blocks of bounded size; a task holds one block of each.  Inside it, scores grow
block of dimensions by block of dimensions.  What the remaining dimensions can still add is bounded by the product of
the remaining norms (the remaining mass); candidates whose upper bound is below the k-th lower bound are compacted away.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tessera.session import cut

TOP = 5
#: A vector whose id this divides is a query.
EVERY = 50
SCALE = 256
CANDIDATE_BLOCK = 8192
QUERY_BLOCK = 2048
#: Dimensions accumulated between two prunings.
STEP = 8

FOUND = "query_row bigint, query_id bigint, vec_id bigint, score bigint"


def whole_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(row, vec_id, v, dim) of the vectors that take part: no null, NaN or infinite component, and an id.

    Rows that share an id, or repeat each other, are vectors of their own; ``row`` tells them apart once it is written.
    """
    v = F.col("embedding").cast("array<double>")
    sound = F.col("vec_id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    ints = F.transform(v, lambda x: F.floor(scale * x).cast("bigint"))
    return vectors.filter(sound).select(F.col("vec_id").cast("bigint").alias("vec_id"), ints.alias("v")).withColumns({"dim": F.size("v"), "row": F.monotonically_increasing_id()})


def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """Dimensions as rows, vectors as columns."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat.reshape(-1, dim).T)


def best_of(ids: np.ndarray, rows: np.ndarray, x: np.ndarray, query_rows: np.ndarray, q: np.ndarray, top: int, step: int = STEP) -> tuple[np.ndarray, ...]:
    """Each query's best candidates in one block as (place of the query, id, score); ``x`` and ``q`` have dimensions as rows and whole numbers."""
    dim = len(x)
    size = lambda m: int(np.abs(m).max(initial=0))
    if size(x) * size(q) * max(dim, 1) < 1 << 52:  # sums stay exact in doubles
        x, q = x.astype(np.float64), q.astype(np.float64)
    order = np.argsort(-(x.astype(np.float64) ** 2).sum(1), kind="stable")  # heavy dimensions first
    x, q = np.ascontiguousarray(x[order]), np.ascontiguousarray(q[order])
    steps = [slice(a, min(a + step, dim)) for a in range(0, dim, step)]
    rest = lambda m: [np.sqrt((m[s.stop:].astype(np.float64) ** 2).sum(0)) * (1 + 1e-9) for s in steps]
    x_rest, q_rest = rest(x), rest(q)
    out_q, out_id, out_score = [], [], []
    for j, own in enumerate(query_rows):
        alive = np.flatnonzero(rows != own)
        part = np.zeros(len(alive), x.dtype)
        for k, s in enumerate(steps):
            panel = x[s] if len(alive) == x.shape[1] else x[s][:, alive]
            part = part + q[s, j] @ panel
            if len(alive) <= top:
                continue
            slack = x_rest[k][alive] * q_rest[k][j]
            low = part - slack
            least = np.partition(low, len(low) - top)[len(low) - top]
            stay = part + slack >= least
            if not stay.all():
                alive, part = alive[stay], part[stay]
        pick = np.lexsort((ids[alive], -part))[:top]
        out_q.append(np.full(len(pick), j))
        out_id.append(ids[alive][pick])
        out_score.append(part[pick].astype(np.int64))
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return join(out_q), join(out_id), join(out_score)


def top_inner(vectors: DataFrame, every: int = EVERY, top: int = TOP, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the best scores of every query among all other vectors of its length.

    Only a query's own row is left out: rows that share its id are candidates, and each row of a query's id is a query
    with ranks of its own.  Ties go to the smaller id; a query with fewer candidates returns all; vectors without components score 0 against
    each other; an empty table gives an empty result.  Components stay below 2^31.
    """
    base = cut(whole_vectors(vectors, scale))
    n = base.count()
    cores = base.sparkSession.sparkContext.defaultParallelism
    c_blocks = max(-(-n // CANDIDATE_BLOCK), 4 * cores)
    q_blocks = max(1, -(-n // every // QUERY_BLOCK))
    hashed = lambda salt, m: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(m)).cast("int")
    spread = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    queries = base.filter(F.pmod("vec_id", F.lit(every)) == 0).withColumn("qb", hashed(1, q_blocks)).withColumn("cb", spread(c_blocks)).select("dim", "cb", "qb", F.lit(True).alias("asks"), "row", "vec_id", "v")
    others = base.withColumn("cb", hashed(2, c_blocks)).withColumn("qb", spread(q_blocks)).select("dim", "cb", "qb", F.lit(False).alias("asks"), "row", "vec_id", "v")

    def search(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        dim = table.column("dim")[0].as_py()
        ids, rows = table.column("vec_id").to_numpy(), table.column("row").to_numpy()
        if asks.all() or not asks.any():
            parts = (np.zeros(0, np.int64),) * 3
        else:
            all_ = matrix(table.column("v"), dim) if dim else np.zeros((0, len(ids)), np.int64)
            parts = best_of(ids[~asks], rows[~asks], all_[:, ~asks], rows[asks], all_[:, asks], top)
        at = parts[0].astype(np.int64)
        return pa.table({"query_row": rows[asks][at], "query_id": ids[asks][at], "vec_id": parts[1], "score": parts[2]})

    found = queries.unionByName(others).groupBy("dim", "cb", "qb").applyInArrow(search, FOUND)
    best = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


SQL = f"""
with e as (
  select row_number() over () rid, vec_id, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) v
  from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.rid, q.vec_id query_id, c.vec_id vec_id,
         cast(coalesce(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])), 0) as bigint) score
  from e q join e c on q.rid <> c.rid and len(q.v) = len(c.v)
  where q.vec_id % {EVERY} = 0),
r as (select *, cast(row_number() over (partition by rid order by score desc, vec_id) as integer) rank from s)
select query_id, rank, vec_id, score from r where rank <= {TOP}"""
