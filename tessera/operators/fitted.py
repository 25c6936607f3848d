"""Fitted, label-aware features: Markov chains, class densities, pair features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions import vectors as V
from tessera.operators.flows import gaps, lens
from tessera.operators.ordered import exact_percentiles, ordinal, percentile_ranks, ranked_percentiles, running_totals
from tessera.session import cut
from tessera.vocabulary import N_CLASSES

#: Room for the state numbers of one chain when two of them form a code.
STATES = 1 << 20
n_rows = lambda name="n": F.count(F.lit(1)).alias(name)


# ---- Markov chains ---------------------------------------------------------------------------

def sequence_values(df: DataFrame, kind: str) -> Column:
    """The sequence a chain runs over: packet lengths, or log10 of the gaps with a floor."""
    return F.array(*lens()) if kind == "len" else F.array(*[F.log10(F.greatest(g, F.lit(1e-7))) for g in gaps()])


def quantile_edges(df: DataFrame, seq: str, bins: int, keys: Sequence[str] = ()) -> DataFrame:
    """Inner quantile edges over all values, duplicates merged: one array row per key."""
    keys = list(keys)
    probs = {f"q{i}": i / bins for i in range(1, bins)}
    p = exact_percentiles(df.select(*keys, F.explode(seq).alias("v")), keys, "v", probs)
    return p.select(*keys, F.array_sort(F.array_distinct(F.array(*[F.round(F.col(n), 12) for n in probs]))).alias("edges"))


def states(df: DataFrame, seq: str, edges: str = "edges") -> DataFrame:
    """State of a value = number of edges at or below it."""
    return df.withColumn("states", F.transform(seq, lambda v: F.size(F.filter(edges, lambda e: e <= F.round(v, 12)))))


def fit_chains(df: DataFrame, label: str, bins: int, smoothing: float = 0.5, keys: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Log start and log transition tables per class with additive smoothing over all ``bins + 1`` states.

    Both tables have at most classes x states^2 rows (per key), whatever the input size.
    """
    keys = list(keys)
    classes = df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    first = df.groupBy(*keys, F.col(label).alias("k"), F.element_at("states", 1).alias("s")).agg(n_rows())
    steps = df.select(*keys, F.col(label).alias("k"), F.explode(steps_of("states")).alias("p")).groupBy(*keys, "k", "p.s", "p.s2").agg(n_rows())
    return log_tables(classes, first, steps, bins + 1, smoothing, keys)


def steps_of(states: str) -> Column:
    """Neighbouring states as (s, s2)."""
    part = lambda at: F.slice(states, F.lit(at), F.size(states) - 1)
    return F.arrays_zip(part(1).alias("s"), part(2).alias("s2"))


def log_tables(classes: DataFrame, first: DataFrame, steps: DataFrame, n: int, smoothing: float, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Log start and log transition tables from counts n of (k, s) and (k, s, s2), over all classes and ``n`` states of each key."""
    every = lambda name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    grid = classes.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(N_CLASSES - 1))).alias("k")).select(*keys, "k", every("s"))
    init = grid.join(first, [*keys, "k", "s"], "left").withColumn("w", F.coalesce("n", F.lit(0)) + smoothing)
    init = init.withColumn("log_p", F.log(F.col("w") / F.sum("w").over(Window.partitionBy(*keys, "k")))).drop("n", "w")
    trans = grid.select(*keys, "k", "s", every("s2")).join(steps, [*keys, "k", "s", "s2"], "left").withColumn("w", F.coalesce("n", F.lit(0)) + smoothing)
    trans = trans.withColumn("log_p", F.log(F.col("w") / F.sum("w").over(Window.partitionBy(*keys, "k", "s")))).drop("n", "w")
    return init, trans


def chain_likelihood(df: DataFrame, row: str, init: DataFrame, trans: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Log-likelihood of every row under every class.

    The two tables become one map per key (bounded by states^2), so scoring is a projection: rows are
    neither exploded nor shuffled.
    """
    keys = list(keys)
    vec = lambda t, s: t.groupBy(*keys, *s).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "log_p"))), lambda r: r["log_p"]).alias("v"))
    i = vec(init, ["s"]).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("s", "v"))).alias("mi"))
    t = vec(trans, ["s", "s2"]).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct((F.col("s") * F.lit(STATES).cast("bigint") + F.col("s2")).alias("c"), "v"))).alias("mt"))
    model = i.join(t, keys) if keys else i.withColumn("mt", t.scalar())
    d = df.join(F.broadcast(model), keys) if keys else df.withColumn("mi", i.scalar()).withColumn("mt", t.scalar())
    codes = F.zip_with(F.slice("states", F.lit(1), F.size("states") - 1), F.slice("states", F.lit(2), F.size("states") - 1), lambda a, b: a * F.lit(STATES).cast("bigint") + b)
    d = d.withColumn("__c", codes)
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    ll = F.aggregate("__c", F.col("mi")[F.element_at("states", 1)], lambda acc, code: add(acc, F.col("mt")[code]))
    return d.select(row, *keys, ll.alias("ll"))


def likelihood_columns(ll: DataFrame, row: str, prefix: str) -> DataFrame:
    """Posterior, best class, margin and maximum of a log-likelihood array."""
    s = F.array_sort("ll")
    n = N_CLASSES
    d = ll.withColumn("__m", F.array_max("ll")).withColumn("__e", F.transform("ll", lambda v: F.exp(F.greatest(v - F.col("__m"), F.lit(-60.0)))))
    d = d.withColumn("__t", F.aggregate("__e", F.lit(0.0), lambda a, b: a + b) + V.EPS)
    return d.select(row, "ll", F.transform("__e", lambda e: e / F.col("__t")).alias(f"{prefix}_post"), (F.array_position("ll", F.col("__m")) - 1).cast("int").alias(f"{prefix}_argmax"),
                    (F.element_at(s, n) - F.element_at(s, n - 1)).alias(f"{prefix}_margin"), F.col("__m").alias(f"{prefix}_max"))


def out_of_fold_chains(df: DataFrame, row: str, label: str, seq: str, bins: int, folds: int = 5) -> DataFrame:
    """Each row scored by chains fitted on the other folds, edges included; all folds in one job.

    Every row appears once for each held-out fold: as a training row of the folds that leave it in, and as the scored
    row of its own.  Edges are one row per fold.
    """
    held = df.select(row, label, "fold", seq).withColumn("held", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    edges = quantile_edges(held.filter(F.col("held") != F.col("fold")), seq, bins, ["held"])
    d = cut(states(held.join(F.broadcast(edges), "held"), seq).select(row, label, "fold", "held", "states"))
    init, trans = fit_chains(d.filter(F.col("held") != F.col("fold")), label, bins, keys=["held"])
    return chain_likelihood(d.filter(F.col("held") == F.col("fold")), row, init, trans, ["held"]).drop("held")


# ---- nested folds ----------------------------------------------------------------------------
#
# A model leaves out one outer fold, and one inner fold of the rest or none.  Rows are counted once per cell (outer, inner);
# what a model has seen is what all cells hold, less the cells it leaves out.  So neither rows nor counts are copied per model.

#: Edges that are looked through one by one when a value is placed among very many.
STRIDE = 24


def nested_inner(df: DataFrame, row: str, label: str, outer: str = "fold", inners: int = 5, seed: int = 42) -> DataFrame:
    """Adds ``inner``: rows of a class and an outer fold are dealt evenly, so the training rows of every outer fold are stratified."""
    from tessera.operators.folds import seeded_ordinal
    return seeded_ordinal(df, [label, outer], row, seed, "__o").withColumn("inner", (F.col("__o") % inners).cast("int")).drop("__o")


def nested_models(outers: int, inners: int) -> list[tuple[int, int]]:
    """(outer, inner) left out by each model; inner -1: the fit on all other outer folds."""
    return [(o, i) for o in range(outers) for i in range(-1, inners)]


def cell_counts(outer: str, inner: str, outers: int, inners: int, n: str | None = None) -> list[Column]:
    """One sum per cell."""
    one = F.col(n) if n else F.lit(1)
    return [F.sum(F.when((F.col(outer) == o) & (F.col(inner) == i), one).otherwise(0)).alias(f"c_{o}_{i}") for o in range(outers) for i in range(inners)]


def model_counts(outers: int, inners: int) -> list[Column]:
    """One difference of cell sums per model, in the order of ``nested_models``."""
    cell = lambda o, i: F.col(f"c_{o}_{i}")
    add = lambda xs: sum(xs[1:], xs[0])
    every = add([cell(o, i) for o in range(outers) for i in range(inners)])
    fold = lambda o: add([cell(o, i) for i in range(inners)])
    column = lambda i: add([cell(o, i) for o in range(outers)])
    return [(every - fold(o) - (column(i) - cell(o, i) if i >= 0 else F.lit(0))).alias(f"m{k}") for k, (o, i) in enumerate(nested_models(outers, inners))]


def nested_edges(df: DataFrame, seq: str, bins: int, outer: str, inner: str, outers: int, inners: int) -> DataFrame:
    """(model, edges): quantile edges of every model from one row per value."""
    probs = {f"q{i}": i / bins for i in range(1, bins)}
    names = [f"m{k}" for k in range(len(nested_models(outers, inners)))]
    values = df.select(outer, inner, F.explode(seq).alias("v")).filter("v is not null").groupBy("v").agg(*cell_counts(outer, inner, outers, inners))
    counts = cut(values.select("v", *model_counts(outers, inners)))
    totals = counts.agg(F.array(*[F.sum(m) for m in names]).alias("t")).scalar()
    run = running_totals(counts, [], "v", names).withColumn("__t", totals)
    each = F.array(*[F.struct(F.lit(k).alias("model"), F.col(m).alias("__c"), F.col(f"{m}_below").alias("__c_below"), F.get("__t", F.lit(k)).alias("__total")) for k, m in enumerate(names)])
    held = lambda x, r: (x["__c_below"] <= r) & (r < x["__c_below"] + x["__c"])
    wanted = lambda x: F.exists(F.array(*map(F.lit, probs.values())), lambda p: held(x, percentile_ranks(x["__total"], p)[0]) | held(x, percentile_ranks(x["__total"], p)[1]))
    hits = run.select("v", F.explode(F.filter(each, wanted)).alias("x")).select("v", "x.*")  # few values per model
    p = ranked_percentiles(hits, ["model"], "v", probs)
    return p.select("model", F.array_sort(F.array_distinct(F.array(*[F.round(F.col(n), 12) for n in probs]))).alias("edges"))


def placed(value: Column, edges: str, heads: str) -> Column:
    """Number of edges at or below a value; ``heads`` is every ``STRIDE``-th edge, so two short lists are looked through."""
    below = lambda xs: F.size(F.filter(xs, lambda e: e <= value))
    block = F.greatest(below(F.col(heads)) - 1, F.lit(0)) * STRIDE
    return block + below(F.slice(F.col(edges), block + 1, STRIDE))


def nested_chains(df: DataFrame, row: str, label: str, seq: str, bins: int, outer: str = "fold", inner: str = "inner", outers: int = 5, inners: int = 5, smoothing: float = 0.5) -> DataFrame:
    """Log-likelihoods for every outer fold: row, held (the outer fold left out), role (train or valid), ll.

    A training row of an outer fold is scored by the model that leaves out its inner fold as well, a validation row by
    the model of all training rows; edges are fitted like the tables.  Values are placed once among the edges of all
    models together, counted once per cell, and counts are then joined to the states of each model.
    """
    models = nested_models(outers, inners)
    edges = cut(nested_edges(df, seq, bins, outer, inner, outers, inners))  # one row per model
    fine = edges.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("edges")))).alias("fine"))
    fine = fine.select("fine", F.transform(F.sequence(F.lit(0), F.floor((F.size("fine") - 1) / STRIDE)), lambda i: F.get("fine", i.cast("int") * STRIDE)).alias("heads"))
    one = fine.select(F.struct("fine", "heads").alias("z")).scalar()
    d = df.select(row, F.col(label).alias("k"), outer, inner, F.filter(F.col(seq), lambda v: v.isNotNull()).alias("__x")).filter(F.size("__x") > 0).withColumn("__z", one)
    d = d.withColumn("__f", F.col("__z.fine")).withColumn("__h", F.col("__z.heads"))
    d = cut(d.select(row, "k", outer, inner, F.transform("__x", lambda v: placed(F.round(v, 12), "__f", "__h").cast("int")).alias("states")))
    # the state of each model that a fine state lies in: folds x bins entries per model
    own = F.transform(F.concat(F.array(F.lit(None).cast("double")), F.col("fine")), lambda v: F.when(v.isNull(), 0).otherwise(F.size(F.filter("edges", lambda e: e <= v))))
    maps = cut(edges.withColumn("fine", fine.select("fine").scalar()).select("model", own.alias("own")))
    every = F.array(*[F.struct(F.lit(k).alias("model"), F.col(f"m{k}").alias("n")) for k in range(len(models))])

    def by_model(counts: DataFrame, states: Sequence[str]) -> DataFrame:
        seen = counts.groupBy("k", *states).agg(*cell_counts(outer, inner, outers, inners, "n")).select("k", *states, *model_counts(outers, inners))
        long = seen.select("k", *states, F.explode(F.filter(every, lambda x: x["n"] > 0)).alias("x")).select("k", *states, "x.*")
        named = long.join(F.broadcast(maps), "model").select("model", "k", "n", *[F.get("own", F.col(s)).alias(s) for s in states])
        return named.groupBy("model", "k", *states).agg(F.sum("n").alias("n"))

    first = d.groupBy("k", outer, inner, F.get("states", F.lit(0)).alias("s")).agg(n_rows())
    steps = d.select("k", outer, inner, F.explode(steps_of("states")).alias("p")).groupBy("k", outer, inner, "p.s", "p.s2").agg(n_rows())
    init, trans = log_tables(maps.select("model"), by_model(first, ["s"]), by_model(steps, ["s", "s2"]), bins + 1, smoothing, ["model"])
    # each row meets one model per outer fold
    number = lambda o, i: o * (inners + 1) + i + 1
    uses = F.explode(F.array(*[F.struct(F.lit(o).alias("held"), F.when(F.col(outer) == o, "valid").otherwise("train").alias("role"),
                                        F.when(F.col(outer) == o, number(o, -1)).otherwise(number(o, F.col(inner))).cast("int").alias("model")) for o in range(outers)]))
    asked = d.select(row, "states", uses.alias("u")).select(row, "states", "u.*").join(F.broadcast(maps), "model")
    asked = asked.select(F.struct(row, "held", "role").alias("__row"), "model", F.transform("states", lambda s: F.get("own", s)).alias("states"))
    return chain_likelihood(asked, "__row", init, trans, ["model"]).select("__row.*", "ll")


# ---- class densities -------------------------------------------------------------------------

def standardise(df: DataFrame, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Zero mean, unit population deviation; constant columns become 0."""
    stats = df.agg(*[F.avg(x).alias(f"m_{x}") for x in columns], *[F.stddev_pop(x).alias(f"s_{x}") for x in columns])
    d = df
    one = stats.select(F.struct("*").alias("z")).scalar()
    d = d.withColumn("__z", one)
    return d.select(*keep, *[F.coalesce(F.try_divide(F.col(x) - F.col(f"__z.m_{x}"), F.col(f"__z.s_{x}")), F.lit(0.0)).alias(x) for x in columns])


def class_gaussians(df: DataFrame, columns: Sequence[str], label: str, ridge: float = 1e-4) -> DataFrame:
    """One diagonal Gaussian per class."""
    return df.groupBy(F.col(label).alias("k")).agg(*[F.avg(x).alias(f"m_{x}") for x in columns], *[(F.var_pop(x) + ridge).alias(f"v_{x}") for x in columns])


def gaussian_scores(df: DataFrame, columns: Sequence[str], params: DataFrame, row: str) -> DataFrame:
    """Log density of every row under every class; the parameters are one row per class."""
    entries = F.array_sort(F.collect_list(F.struct("k", *[f"m_{x}" for x in columns], *[f"v_{x}" for x in columns])))
    d = df.withColumn("__p", params.agg(entries.alias("p")).scalar())

    def dens(p: Column) -> Column:
        return V.total([-0.5 * ((F.col(x) - p[f"m_{x}"]) * (F.col(x) - p[f"m_{x}"]) / p[f"v_{x}"] + F.log(2 * 3.141592653589793 * p[f"v_{x}"])) for x in columns])

    return d.select(row, F.posexplode(F.transform("__p", lambda p: F.struct(p["k"].alias("k"), dens(p).alias("density")))).alias("i", "r")).select(row, "r.k", "r.density")


def mixture_em(df: DataFrame, columns: Sequence[str], label: str, rounds: int = 200, tolerance: float = 1e-3, ridge: float = 1e-4, min_rows: int = 25) -> DataFrame:
    """Two diagonal components per class by expectation-maximisation, one aggregate per round: two rows per class.

    A class is frozen once a round raises its mean log-likelihood by less than ``tolerance``, and leaves the rows that
    are read; the loop ends when all are frozen, or after ``rounds``.  Classes under ``2 * min_rows`` rows keep one
    component (both start alike and stay alike).  Adds to the parameters: ll (mean log-likelihood of the last round),
    first_ll, fell (most that a round lowered it), rounds.
    """
    x = list(columns)
    base = cut(df.select(F.col(label).alias("k"), *x))
    names = ["k", "comp", "w", *[f"m_{c}" for c in x], *[f"v_{c}" for c in x]]
    first = class_gaussians(base, x, "k", ridge).join(base.groupBy("k").agg(n_rows("rows")), "k")
    two = F.col("rows") >= 2 * min_rows
    shift = lambda c, s: F.when(two, F.col(f"m_{c}") + s * F.sqrt(f"v_{c}") * 0.5).otherwise(F.col(f"m_{c}"))
    par = cut(first.withColumn("comp", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        "k", "comp", F.lit(0.5).alias("w"), *[F.when(F.col("comp") == 0, shift(c, -1)).otherwise(shift(c, 1)).alias(f"m_{c}") for c in x], *[f"v_{c}" for c in x]))
    held: dict[int, list] = {}  # class -> parameter rows as the driver keeps them: two per class
    seen: dict[int, list[float]] = {}
    for _ in range(rounds):
        wide = par.groupBy("k").agg(F.array_sort(F.collect_list(F.struct(*names[1:]))).alias("p"))
        d = base.join(F.broadcast(wide), "k")  # one row per class; frozen classes are left out
        part = lambda i: F.col("p")[i]
        logd = lambda i: F.log(part(i)["w"]) + V.total([-0.5 * ((F.col(c) - part(i)[f"m_{c}"]) * (F.col(c) - part(i)[f"m_{c}"]) / part(i)[f"v_{c}"] + F.log(2 * 3.141592653589793 * part(i)[f"v_{c}"])) for c in x])
        d = d.withColumn("l0", logd(0)).withColumn("l1", logd(1))
        top = F.greatest("l0", "l1")
        d = d.withColumn("ll", top + F.log(F.exp(F.col("l0") - top) + F.exp(F.col("l1") - top)))
        r0 = F.exp(F.col("l0") - F.col("ll"))
        q = F.explode(F.array(F.struct(F.lit(0).alias("comp"), r0.alias("r")), F.struct(F.lit(1).alias("comp"), (1 - r0).alias("r"))))
        d = d.select("k", "ll", *x, q.alias("q")).select("k", "ll", *x, "q.comp", "q.r")
        sums = [F.sum(F.col("r") * F.col(c)).alias(f"s1_{c}") for c in x] + [F.sum(F.col("r") * F.col(c) * F.col(c)).alias(f"s2_{c}") for c in x]
        s = d.groupBy("k", "comp").agg(F.sum("r").alias("sr"), n_rows("n"), F.avg("ll").alias("ll"), *sums)
        sr = F.greatest("sr", F.lit(1e-9))
        mean = lambda c: F.col(f"s1_{c}") / sr
        moved = cut(s.select("k", "comp", (sr / F.col("n")).alias("w"), *[mean(c).alias(f"m_{c}") for c in x],
                             *[(F.greatest(F.col(f"s2_{c}") / sr - mean(c) * mean(c), F.lit(0.0)) + ridge).alias(f"v_{c}") for c in x], "ll"))
        done = []
        for r in moved.filter("comp = 0").select("k", "ll").collect():  # one row per class
            own = seen.setdefault(r["k"], [])
            own.append(r["ll"])
            if len(own) > 1 and own[-1] - own[-2] < tolerance:
                done.append(r["k"])
        if done:
            for r in moved.filter(F.col("k").isin(done)).select(*names).collect():
                held.setdefault(r["k"], []).append(tuple(r))
        par = moved.filter(~F.col("k").isin(done)).select(*names) if done else moved.select(*names)
        if len(held) == len(seen):
            break
    for r in par.collect() if len(held) < len(seen) else []:
        held.setdefault(r["k"], []).append(tuple(r))
    fell = lambda own: max([0.0, *[a - b for a, b in zip(own, own[1:])]])
    rows = [(*r, seen[k][-1], seen[k][0], fell(seen[k]), len(seen[k])) for k, own in held.items() for r in own]
    kinds = ", ".join(["k int", "comp int", *[f"{c} double" for c in names[2:]], "ll double", "first_ll double", "fell double", "rounds int"])
    return df.sparkSession.createDataFrame(rows, kinds)


# ---- pairs of one group ----------------------------------------------------------------------

def pair_counts(df: DataFrame, group: str) -> DataFrame:
    """How many same-group pairs each group has: counted, never listed."""
    g = df.groupBy(group).agg(n_rows()).filter("n > 1")
    return g.select(group, "n", (F.col("n") * (F.col("n") - 1) / 2).cast("bigint").alias("pairs"))


def neighbour_pairs(df: DataFrame, group: str, row: str, columns: Sequence[str]) -> DataFrame:
    """Every member of a group with its successor by row id, and their symmetric pair features.

    A chain through each group is linear in the group; the row numbers come from slices, so a group that
    holds a large part of all rows is not sorted in one task.
    """
    o = ordinal(df.select(group, row, *columns), [group], [row], "__o")
    nxt = o.select(group, (F.col("__o") - 1).alias("__o"), F.col(row).alias(f"{row}_b"), *[F.col(x).alias(f"b_{x}") for x in columns])
    j = o.join(nxt.hint("merge"), [group, "__o"])
    return j.select(group, row, f"{row}_b", *[F.abs(F.col(x) - F.col(f"b_{x}")).alias(f"diff_{x}") for x in columns],
                    *[((F.col(x) + F.col(f"b_{x}")) / 2).alias(f"mean_{x}") for x in columns])


def negative_pairs(df: DataFrame, group: str, row: str, columns: Sequence[str], per_row: int = 3, seed: int = 42) -> DataFrame:
    """Cross-group pairs: rows meet the row at the same place of another seeded order; same-group pairs are dropped."""
    from tessera.operators.folds import seeded_ordinal
    base = df.select(group, row, *columns)
    a = seeded_ordinal(base, [], row, seed, "__o")
    out = None
    for i in range(per_row):
        b = seeded_ordinal(base, [], row, seed + 1 + i, "__o").select("__o", F.col(group).alias("__g"), F.col(row).alias(f"{row}_b"), *[F.col(x).alias(f"b_{x}") for x in columns])
        j = a.join(b.hint("merge"), "__o").filter(F.col(group) != F.col("__g"))
        j = j.select(group, row, f"{row}_b", *[F.abs(F.col(x) - F.col(f"b_{x}")).alias(f"diff_{x}") for x in columns], *[((F.col(x) + F.col(f"b_{x}")) / 2).alias(f"mean_{x}") for x in columns])
        out = j if out is None else out.unionByName(j)
    return out


def block_pair_means(df: DataFrame, block: str, vector: str, dim: int) -> DataFrame:
    """Number of row pairs and their mean cosine inside and between blocks, exact and without listing pairs.

    The dot products of all pairs of two blocks add up to the dot product of the blocks' vector sums, so one
    aggregate over the rows is enough; pairs are made from one row per block.
    """
    v = [F.element_at(vector, i + 1).cast("double") for i in range(dim)]
    norm = F.sqrt(V.total([x * x for x in v])) + V.EPS
    unit = df.withColumn("__n", norm)
    sums = unit.groupBy(block).agg(n_rows(), F.array(*[F.sum(x / F.col("__n")) for x in v]).alias("s"), F.sum(V.total([x * x for x in v]) / (F.col("__n") * F.col("__n"))).alias("own"))
    # one side is dealt into parts by a hash of the block, the other visits every part: no task holds all blocks
    sums = cut(sums.select(F.struct(F.col(block).alias("b"), "n", "s", "own").alias("a")))
    parts = max(1, -(-sums.count() // 64))
    left = sums.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = sums.select(F.col("a").alias("c"), F.pmod(F.xxhash64("a.b"), F.lit(parts)).cast("int").alias("part"))
    j = left.join(right, "part").filter("a.b <= c.b")
    dot = F.aggregate(F.zip_with("a.s", "c.s", lambda x, y: x * y), F.lit(0.0), lambda p, q: p + q)
    same = F.col("a.b") == F.col("c.b")
    pairs = F.when(same, F.col("a.n") * (F.col("a.n") - 1) / 2).otherwise(F.col("a.n") * F.col("c.n"))
    total = F.when(same, (dot - F.col("a.own")) / 2).otherwise(dot)
    return j.select(F.col("a.b").alias("block_a"), F.col("c.b").alias("block_b"), pairs.cast("bigint").alias("pairs"), F.try_divide(total, pairs).alias("mean_cosine"))
