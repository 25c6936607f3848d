"""Model work on Spark ML: families, out-of-fold evaluation, heads, stacking, calibration, controls.

Models write probability rows ``(row_id, y, fold, model, probs)``, so every score in ``evaluate`` applies.
Feature frames are cut from their lineage once and reused by all fits.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Sequence
from functools import partial, reduce
from itertools import product
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator
from pyspark.ml.classification import LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.functions.draws import unit
from tessera.operators import boosting, evaluate as E, neighbours
from tessera.operators.ordered import rank_auc
from tessera.session import cut
from tessera.vocabulary import APPS, N_CLASSES

SEED = 42
#: Independent fits that run at a time; a fit is a driver loop over jobs that are short where rows are few.
SIDE_BY_SIDE = 4
#: Rows that make a task of its own worth while in a fit.
TASK_ROWS = 4_000

# name -> (number of features, number of classes, parameters) -> estimator; the defaults are full budgets
FAMILIES: dict[str, Callable[[int, int, dict], Estimator]] = {
    "forest": lambda d, k, p: RandomForestClassifier(labelCol="y", seed=SEED, **({"numTrees": 300, "maxDepth": 12} | p)),
    "logistic": lambda d, k, p: LogisticRegression(labelCol="y", family="multinomial", **({"maxIter": 200, "regParam": 0.01} | p)),
    "perceptron": lambda d, k, p: MultilayerPerceptronClassifier(labelCol="y", seed=SEED, layers=[d, p.get("hidden", 64), k],
                                                                 **({"maxIter": 200} | {x: v for x, v in p.items() if x != "hidden"})),
    "linear_svm": lambda d, k, p: OneVsRest(labelCol="y", parallelism=SIDE_BY_SIDE, classifier=LinearSVC(labelCol="y", **({"maxIter": 100, "regParam": 0.01} | p))),
}
#: Families without an estimator: boosted trees grow for all classes and folds at once, neighbours are looked up.
DIRECT = ["boosted", "neighbours"]
#: Budgets for quick runs; pass one as ``params`` where a query is run often.
QUICK: dict[str, dict] = {"forest": {"numTrees": 10, "maxDepth": 5}, "boosted": {"maxIter": 20, "maxDepth": 3, "stepSize": 0.2}, "logistic": {"maxIter": 20},
                          "perceptron": {"maxIter": 20, "hidden": 16}, "linear_svm": {"maxIter": 10}, "neighbours": {}}
#: Families that measure distances or sums over columns; their columns are scaled by a fit on the training rows.
SCALED = {"logistic", "perceptron", "linear_svm", "neighbours"}


def assemble(df: DataFrame, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Feature vectors, unscaled, materialised once; scaling belongs to a fit."""
    return spread(cut(VectorAssembler(inputCols=list(columns), outputCol="features").transform(df.select(*keep, *columns)).select(*keep, "features")), "row_id")


def spread(data: DataFrame, key: str, rows: int = TASK_ROWS) -> DataFrame:
    """Materialised rows over as many tasks as their number is worth, two per core at most or as they lie.

    Rows are compact, so their bytes alone would put a fit of a million rows on a few tasks.
    """
    parts = min(2 * data.sparkSession.sparkContext.defaultParallelism, -(-data.count() // rows))
    return data if parts <= data.rdd.getNumPartitions() else cut(data.repartition(parts, key))


def side_by_side(spark: SparkSession, run: Callable, items: Sequence, parallelism: int = SIDE_BY_SIDE) -> list:
    """``run`` of every item in order, some at a time."""
    jobs = [inheritable_thread_target(spark)(partial(run, x)) for x in items]
    with ThreadPool(max(min(parallelism, len(jobs)), 1)) as pool:
        return pool.map(lambda job: job(), jobs, chunksize=1)


def scaled(train: DataFrame, *others: DataFrame) -> list[DataFrame]:
    """The frames with features scaled by means and deviations of the first one."""
    fit = StandardScaler(inputCol="features", outputCol="__scaled", withMean=True).fit(train)
    return [fit.transform(d).drop("features").withColumnRenamed("__scaled", "features") for d in (train, *others)]


def compress(df: DataFrame, k: int = 16) -> DataFrame:
    """Principal components of the scaled features."""
    df, = scaled(df)
    return PCA(k=k, inputCol="features", outputCol="pca").fit(df).transform(df)


def pad(probs: Column, n: int) -> Column:
    return F.slice(F.concat(probs, F.array_repeat(F.lit(0.0), n)), 1, n)


def probabilities(scored: DataFrame, n: int) -> DataFrame:
    """Probability array of a scored frame; raw one-vs-rest scores are squashed and normalised."""
    if "probability" in scored.columns:
        return scored.withColumn("probs", pad(vector_to_array("probability"), n))
    raw = F.transform(vector_to_array("rawPrediction"), lambda r: 1 / (1 + F.exp(-r)))
    return E.normalise(scored.withColumn("probs", pad(raw, n)))


def neighbour_probabilities(train: DataFrame, valid: DataFrame, n: int, k: int = 5) -> DataFrame:
    """Share of each class among the ``k`` nearest training rows, exact."""
    own = lambda d, side: d.select("row_id", F.col("y").cast("long").alias("y"), F.lit(side).alias("fold"), "features")
    near = neighbours.other_folds(own(train, 0).unionByName(own(valid, 1)), {1: (0.0, 1.0)}, k)  # as they are scaled
    return valid.join(near.select("row_id", neighbours.shares("near", n).alias("probs")), "row_id")


def neighbour_folds(data: DataFrame, folds: Sequence[int], n: int, k: int = 5) -> DataFrame:
    """``neighbour_probabilities`` of every fold by the rows of the others, each fold in their scaling; one search serves all."""
    fit = lambda f: StandardScaler(inputCol="features", outputCol="__scaled", withMean=True).fit(data.filter(F.col("fold") != f))
    if data.isEmpty():
        return data.withColumn("probs", F.array().cast("array<double>"))
    some = [r[0] for r in data.select("fold").distinct().collect()]
    use = [f for f in folds if set(some) - {f, None}]  # a fold without others has no answers
    scales = {f: (m.mean.toArray(), np.divide(1.0, m.std.toArray(), out=np.zeros(len(m.std)), where=m.std.toArray() != 0)) for f, m in zip(use, side_by_side(data.sparkSession, fit, use))}
    near = neighbours.other_folds(data, scales, k)
    return near.select("row_id", "y", "fold", neighbours.shares("near", n).alias("probs"))


def fit_predict(family: str, train: DataFrame, valid: DataFrame, n: int = N_CLASSES, params: dict | None = None, weight: str | None = None) -> DataFrame:
    """Probability arrays of ``valid`` by a model, and a scaling where the family needs one, fitted on ``train`` alone."""
    params = dict(params or {})
    if family in SCALED:
        train, valid = scaled(train, valid)
    if family == "boosted":
        return boosting.score(boosting.fit(train, n, weight=weight, params=params), valid)
    if family == "neighbours":
        return neighbour_probabilities(train, valid, n, **params)
    dim = len(train.first()["features"]) if family == "perceptron" else 0
    est = FAMILIES[family](dim, n, params)
    if weight:
        est = est.setWeightCol(weight)
    return probabilities(est.fit(train.withColumn("y", F.col("y").cast("double"))).transform(valid), n)


def refit_predict(family: str, data: DataFrame, test: DataFrame, n: int = N_CLASSES, params: dict | None = None) -> DataFrame:
    """Probability rows of the test rows by a model of all training rows."""
    return cut(fit_predict(family, data, test, n, params).select("row_id", F.lit(family).alias("model"), "probs"))


def repeated_record(data: DataFrame, family: str, folds: DataFrame, n: int = N_CLASSES, params: dict | None = None) -> DataFrame:
    """Record over repeats of out-of-fold runs; ``folds`` has row_id, repeat, fold of any fold scheme."""
    repeats = [r[0] for r in folds.select("repeat").distinct().orderBy("repeat").collect()]  # one row per repeat
    parts = []
    for r in repeats:
        dealt = cut(data.drop("fold").join(folds.filter(F.col("repeat") == r).select("row_id", "fold"), "row_id"))
        k = dealt.agg(F.max("fold")).first()[0] + 1
        parts.append(out_of_fold(dealt, family, range(k), n, params).withColumn("model", F.concat_ws("#", F.lit(family), F.lit(str(r)))))
    rec = oof_record(reduce(lambda a, b: a.unionByName(b), parts))
    return rec.agg(F.lit(family).alias("model"), F.count(F.lit(1)).alias("repeats"), *[F.avg(f"{c}_mean").alias(f"{c}_mean") for c in ("accuracy", "macro_f1", "log_loss")])


def rows_of(scored: DataFrame, model: str) -> DataFrame:
    return scored.select("row_id", F.col("y").cast("int").alias("y"), "fold", F.lit(model).alias("model"), "probs")


def out_of_fold(data: DataFrame, family: str, folds: Sequence[int], n: int = N_CLASSES, params: dict | None = None, weight: str | None = None) -> DataFrame:
    """Probability rows of every fold by a model that did not see it."""
    if family == "boosted":  # one fit grows the models of all folds
        return cut(rows_of(boosting.score(boosting.fit(data, n, folds, weight, params), data, folds), family))
    if family == "neighbours":
        return cut(rows_of(neighbour_folds(data, folds, n, **(params or {})), family))
    one = lambda f: rows_of(fit_predict(family, data.filter(F.col("fold") != f), data.filter(F.col("fold") == f), n, params, weight), family)
    parts = side_by_side(data.sparkSession, one, folds)
    return cut(reduce(lambda a, b: a.unionByName(b), parts))


def oof_record(oof: DataFrame) -> DataFrame:
    """Mean and deviation over folds of accuracy, macro-F1 and log loss."""
    rows = E.argmax_rows(oof)
    s = E.summary(rows, ["model", "fold"]).join(E.log_loss(rows, ["model", "fold"]), ["model", "fold"])
    return s.groupBy("model").agg(*[f(c).alias(f"{c}_{n}") for c in ("accuracy", "macro_f1", "log_loss") for n, f in (("mean", F.avg), ("std", F.stddev_pop))])


def grid_search(data: DataFrame, family: str, grid: dict[str, Sequence], n: int = N_CLASSES, parallelism: int = 4) -> DataFrame:
    """One specification per grid point, evaluated over the fold column; families with an estimator fit side by side."""
    if family in DIRECT:
        folds = range(data.agg(F.max("fold")).first()[0] + 1)
        points = [dict(zip(grid, v)) for v in product(*grid.values())]
        accs = [oof_record(out_of_fold(data, family, folds, n, p)).first()["accuracy_mean"] for p in points]
        rows = [(family, ",".join(f"{k}={v}" for k, v in sorted(p.items())), float(a)) for p, a in zip(points, accs)]
        return data.sparkSession.createDataFrame(rows, "model string, params string, group_acc double")
    dim = len(data.first()["features"]) if family == "perceptron" else 0
    est = FAMILIES[family](dim, n, {})
    b = ParamGridBuilder()
    for name, values in grid.items():
        b = b.addGrid(est.getParam(name), list(values))
    maps = b.build()
    cv = CrossValidator(estimator=est, estimatorParamMaps=maps, evaluator=MulticlassClassificationEvaluator(labelCol="y", metricName="accuracy"),
                        foldCol="fold", numFolds=data.agg(F.max("fold")).first()[0] + 1, parallelism=parallelism)
    model = cv.fit(data.withColumn("y", F.col("y").cast("double")))
    rows = [(family, ",".join(f"{p.name}={v}" for p, v in sorted(m.items(), key=lambda x: x[0].name)), float(a)) for m, a in zip(maps, model.avgMetrics)]
    return data.sparkSession.createDataFrame(rows, "model string, params string, group_acc double")  # one row per specification


def run_specs(data: DataFrame, specs: DataFrame, folds: Sequence[int], n: int = N_CLASSES) -> DataFrame:
    """Full record of every spec (spec_key, model, params as JSON): accuracy, macro-F1 and log loss over the folds, and fit seconds.

    A spec is one run of distributed fits; the driver holds the list of specs only.
    """
    parts = []
    for s in specs.select("spec_key", "model", "params").orderBy("spec_key").collect():
        start = time.monotonic()
        rec = cut(oof_record(out_of_fold(data, s["model"], folds, n, json.loads(s["params"]))))
        parts.append(rec.select(F.lit(s["spec_key"]).alias("hash"), F.lit(s["params"]).alias("params"), "*", F.lit(time.monotonic() - start).alias("fit_seconds")))
    return reduce(lambda a, b: a.unionByName(b), parts)


# ---- composed targets ------------------------------------------------------------------------

def compose(rows: DataFrame, app: str, video: Column) -> DataFrame:
    """``probs`` as P(app) times P(mode | app), from arrays of one row."""
    j, parts = rows.withColumn("__v", video), []
    for a in range(len(APPS)):
        p, v = F.element_at(app, a + 1), F.element_at("__v", a + 1)
        parts += [p * (1 - v), p * v]
    return j.withColumn("probs", F.array(*parts)).drop("__v")


def compose_heads(app: DataFrame, video: DataFrame) -> DataFrame:
    """P(app) times P(mode | app): ``app`` has five probabilities, ``video`` one per application."""
    j = app.join(video.select("row_id", F.col("probs").alias("pv")), "row_id")
    return compose(j, "probs", F.col("pv")).drop("pv")


def fold_back(rows: DataFrame) -> DataFrame:
    """Fifteen-class probabilities (voice, video, audio-only video per application) summed back to ten."""
    parts = []
    for a in range(len(APPS)):
        parts += [F.element_at("probs", 3 * a + 1), F.element_at("probs", 3 * a + 2) + F.element_at("probs", 3 * a + 3)]
    return rows.withColumn("probs", F.array(*parts))


def fifteen(y: Column, audio_only: Column) -> Column:
    return F.floor(y / 2) * 3 + F.when(y % 2 == 0, 0).when(audio_only, 2).otherwise(1)


def hierarchical(train: DataFrame, valid: DataFrame, family: str = "forest", params: dict | None = None) -> DataFrame:
    """One application model, and one mode model per application fitted on its own rows."""
    as_y = lambda d, c: d.withColumn("y", c.cast("int"))
    targets = [(as_y(train, F.floor(F.col("y") / 2)), len(APPS))]
    targets += [(as_y(train.filter(F.floor(F.col("y") / 2) == a), F.col("y") % 2), 2) for a in range(len(APPS))]
    rows, kept = valid, valid.columns
    for i, (own, n) in enumerate(targets):  # every model adds its column to the same rows, so none is joined
        got = fit_predict(family, own, rows.withColumn("__raw", F.col("features")), n, params)
        kept = [*kept, f"__p{i}"]
        rows = got.withColumn(f"__p{i}", F.col("probs")).drop("features").withColumnRenamed("__raw", "features").select(*kept)
    video = F.array(*[F.element_at(f"__p{i + 1}", 2) for i in range(len(APPS))])
    return compose(rows, "__p0", video).select("row_id", "y", "fold", "probs", F.lit("hierarchical").alias("model"))


def mixture_view(train: DataFrame, valid: DataFrame, family: str = "forest", params: dict | None = None) -> DataFrame:
    t = train.withColumn("y", fifteen(F.col("y"), F.col("audio_only")).cast("int"))
    p = fit_predict(family, t, valid, 3 * len(APPS), params).select("row_id", "y", "fold", "probs")
    return fold_back(p).withColumn("model", F.lit("mixture"))


def over_folds(data: DataFrame, folds: Sequence[int], view: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Probability rows of every fold by ``view(training rows, held-out rows)``."""
    one = lambda f: view(data.filter(F.col("fold") != f), data.filter(F.col("fold") == f)).select("row_id", F.col("y").cast("int").alias("y"), "fold", "model", "probs")
    return cut(reduce(lambda a, b: a.unionByName(b), side_by_side(data.sparkSession, one, folds)))


# ---- ensembles -------------------------------------------------------------------------------

def member_table(prob_rows: DataFrame, members: Sequence[str]) -> DataFrame:
    """One row per row id with an array per member, materialised once for repeated passes."""
    return cut(prob_rows.filter(F.col("model").isin(*members)).groupBy("row_id").agg(
        F.first("y").alias("y"), F.first("fold").alias("fold"), *[F.max(F.when(F.col("model") == m, F.col("probs"))).alias(f"p_{m}") for m in members]))


def _mix(members: Sequence[str], weights: Sequence[float]) -> Column:
    out = None
    for m, w in zip(members, weights):
        if w:
            part = F.zip_with(f"p_{m}", F.array_repeat(F.lit(float(w)), N_CLASSES), lambda v, x: v * x)
            out = part if out is None else F.zip_with(out, part, lambda a, b: a + b)
    return out


def trial_hits(table: DataFrame, members: Sequence[str], trials: Sequence[tuple[int | None, Sequence[int]]]) -> list[float]:
    """Accuracy of every (held-out fold, member counts) over the rows outside that fold; tasks return sums only."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hits, rows = np.zeros(len(trials)), np.zeros(len(trials))
        for pdf in batches:
            if not len(pdf):
                continue
            p = np.stack([np.stack(pdf[f"p_{m}"].to_numpy()) for m in members])  # member, row, class
            y, fold = pdf["y"].to_numpy(), pdf["fold"].to_numpy()
            for i, (held, counts) in enumerate(trials):
                use = np.ones(len(y), bool) if held is None else fold != held
                hits[i] += (np.tensordot(np.asarray(counts, float), p, 1).argmax(1) == y)[use].sum()
                rows[i] += use.sum()
        yield pd.DataFrame({"trial": np.arange(len(trials)), "hits": hits, "rows": rows})

    got = table.select("y", "fold", *[f"p_{m}" for m in members]).mapInPandas(run, "trial int, hits double, rows double").groupBy("trial").agg(F.sum("hits").alias("h"), F.sum("rows").alias("n")).collect()
    found = {r["trial"]: r["h"] / max(r["n"], 1) for r in got}  # one row per trial
    return [found.get(i, 0.0) for i in range(len(trials))]


def hill_climbs(table: DataFrame, members: Sequence[str], held: Sequence[int | None], steps: int = 80) -> dict[int | None, dict[str, float]]:
    """Greedy forward selection with replacement, one climb per held-out fold (None: all rows).

    A step scores every member of every open climb in one pass; a climb ends when its best member lowers its score or
    after ``steps``.
    """
    counts = {f: [0] * len(members) for f in held}
    best, open_ = {f: 0.0 for f in held}, set(held)
    for step in range(steps):
        trials = [(f, [c + (j == i) for j, c in enumerate(counts[f])]) for f in held if f in open_ for i in range(len(members))]
        if not trials:
            break
        score = dict(zip([(f, i) for f in held if f in open_ for i in range(len(members))], trial_hits(table, members, trials)))
        for f in list(open_):
            top = max(range(len(members)), key=lambda i: (score[f, i], -i))
            if step and score[f, top] < best[f] - 1e-9:
                open_.discard(f)
                continue
            counts[f][top] += 1
            best[f] = score[f, top]
    return {f: {m: c / (sum(counts[f]) or 1) for m, c in zip(members, counts[f])} for f in held}


def hill_climb(table: DataFrame, members: Sequence[str], steps: int = 80) -> dict[str, float]:
    return hill_climbs(table, members, [None], steps)[None]


def weights_frame(spark, weights: dict[str, float]) -> DataFrame:
    return spark.createDataFrame(sorted(weights.items()), "member string, weight double")  # one row per member


def nested_hill_climb(table: DataFrame, members: Sequence[str], folds: Sequence[int], steps: int = 80) -> DataFrame:
    """Weights from the other folds, decisions on the held-out one."""
    weights = hill_climbs(table, members, list(folds), steps)
    part = lambda f: table.filter(F.col("fold") == f).select("row_id", "y", "fold", F.lit("nested_climb").alias("model"), _mix(members, [weights[f][m] for m in members]).alias("probs"))
    return reduce(lambda a, b: a.unionByName(b), map(part, folds))


def stack(table: DataFrame, members: Sequence[str], folds: Sequence[int], log: bool = False, reg: float = 0.01, name: str = "stack",
          params: dict | None = None) -> DataFrame:
    """Multinomial logistic model on the concatenated member arrays, out of fold; with ``log`` it calibrates."""
    arr = F.concat(*[F.col(f"p_{m}") for m in members])
    if log:
        arr = F.transform(arr, lambda p: F.log(F.greatest(p, F.lit(1e-9))))
    data = cut(table.select("row_id", "y", "fold", array_to_vector(arr).alias("features")))
    oof = out_of_fold(data, "logistic", folds, params={"regParam": reg} | (params or {}))
    return oof.withColumn("model", F.lit(name))


def choose_ensemble(candidates: DataFrame) -> DataFrame:
    """Honest scores of the candidate combinations, best first; the first by name wins a tie."""
    s = E.summary(E.argmax_rows(candidates), ["model"])
    best = s.agg(F.max_by("model", F.struct("accuracy", "macro_f1")).alias("m"))
    return s.withColumn("chosen", F.col("model") == best.scalar())


def objective(hits: np.ndarray, said: np.ndarray, true: np.ndarray, kind: str) -> float:
    """Accuracy or macro-F1 from counts per class."""
    if kind == "accuracy":
        return float(hits.sum() / max(true.sum(), 1))
    return float(np.mean(2 * hits / np.maximum(said + true, 1)))


def fit_bias(rows: DataFrame, folds: int = 5, rounds: int = 6, l2: float = 0.5, kind: str = "accuracy") -> DataFrame:
    """Per-class bias on log-probabilities by coordinate ascent, one bias vector per held-out fold; ``kind`` is the objective.

    With the other classes fixed, a row's answer turns to the class once its bias passes the row's gap to the best of
    the others.  So one aggregate per coordinate, counts by gap slot, gives either objective at all 25 grid values; it
    has at most folds x classes x classes x 26 rows.
    """
    grid = [round(-1.2 + 0.1 * i, 10) for i in range(25)]
    z = cut(rows.select("y", F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: f != F.col("fold"))).alias("held"),
                        F.transform("probs", lambda p: F.log(F.greatest(p, F.lit(1e-9)))).alias("z")))
    bias = {f: [0.0] * N_CLASSES for f in range(folds)}
    for _ in range(rounds):
        moved = False
        for k in range(N_CLASSES):
            table = F.array(*[F.array(*[F.lit(v) for v in bias[f]]) for f in range(folds)])
            s = z.withColumn("s", F.zip_with("z", F.element_at(table, F.col("held") + 1), lambda u, v: u + v))
            others = F.transform("s", lambda v, i: F.when(i == k, F.lit(-1e9)).otherwise(v))
            s = s.select("held", "y", (F.element_at("z", k + 1)).alias("zk"), F.array_max(others).alias("om"), E.argmax(others).alias("oa"))
            win = lambda v: (F.col("zk") + v > F.col("om")) | ((F.col("zk") + v == F.col("om")) & (F.col("oa") > k))
            slot = sum((F.when(win(v), 0).otherwise(1) for v in grid[1:]), F.when(win(grid[0]), 0).otherwise(1))  # grid values that do not win
            got = s.groupBy("held", "y", "oa", slot.alias("slot")).agg(F.count(F.lit(1)).alias("n")).collect()
            for f in range(folds):
                own = [(r["y"], r["oa"], r["slot"], r["n"]) for r in got if r["held"] == f]
                if not own:
                    continue
                y, oa, slots, n = (np.array(x) for x in zip(*own))
                true = np.bincount(y, n, N_CLASSES)
                old = bias[f]

                def value(i: int) -> float:
                    said = np.where(slots <= i, k, oa)
                    penalty = l2 * sum(v * v for v in old[:k] + [grid[i]] + old[k + 1:]) / N_CLASSES
                    return objective(np.bincount(y[said == y], n[said == y], N_CLASSES), np.bincount(said, n, N_CLASSES), true, kind) - penalty

                now = min(range(25), key=lambda i: abs(grid[i] - old[k]))
                top = max(range(25), key=lambda i: (value(i), -abs(grid[i])))
                if value(top) > value(now) + 1e-12:
                    bias[f] = old[:k] + [grid[top]] + old[k + 1:]
                    moved = True
        if not moved:
            break
    return rows.sparkSession.createDataFrame([(f, [float(v) for v in b]) for f, b in bias.items()], "fold int, bias array<double>")


def apply_bias(rows: DataFrame, bias: DataFrame) -> DataFrame:
    """Softmax of log-probability plus the bias of the row's fold; ``bias`` is one row per fold."""
    j = rows.join(F.broadcast(bias), "fold")
    return E.normalise(j.withColumn("probs", F.zip_with("probs", "bias", lambda p, b: F.greatest(p, F.lit(1e-9)) * F.exp(b))).drop("bias"))


# ---- controls and diagnostics ----------------------------------------------------------------

def adversarial_auc(data: DataFrame, folds: Sequence[int], family: str = "forest", params: dict | None = None) -> DataFrame:
    """AUC of telling train from test rows; ``y`` is the side."""
    oof = out_of_fold(data, family, folds, 2, params)
    return rank_auc(oof.select("y", F.round(F.element_at("probs", 2), 9).alias("s")), [], "s", F.col("y") == 1)


def separability(data: DataFrame, folds: Sequence[int], min_count: int = 10, family: str = "forest", params: dict | None = None) -> DataFrame:
    """Mode AUC per application inside the audio-only rows; null when a mode has too few rows."""
    sub = data.filter("audio_only").withColumn("app", F.floor(F.col("y") / 2).cast("int")).withColumn("y", (F.col("y") % 2).cast("int"))
    sizes = sub.groupBy("app").agg(F.count(F.lit(1)).alias("flows"), F.sum("y").alias("video"))
    parts = [sub.sparkSession.createDataFrame([], "app int, auc double")]
    for r in sizes.collect():  # one row per application
        if min(r["video"], r["flows"] - r["video"]) >= min_count:
            own = sub.filter(F.col("app") == r["app"])
            oof = out_of_fold(own, family, folds, 2, params)
            auc = rank_auc(oof.select("y", F.round(F.element_at("probs", 2), 9).alias("s")), [], "s", F.col("y") == 1)
            parts.append(auc.select(F.lit(r["app"]).alias("app"), "auc"))
    return sizes.join(reduce(lambda a, b: a.unionByName(b), parts), "app", "left")


def factorised(data: DataFrame, folds: Sequence[int], family: str = "forest", params: dict | None = None) -> DataFrame:
    """Accuracy of the flat label, the application, the mode, and the product of the last two."""
    acc = lambda name, y, n: E.argmax_rows(out_of_fold(data.withColumn("y", y.cast("int")), family, folds, n, params)).agg(
        F.avg(F.when(F.col("pred") == F.col("y"), 1.0).otherwise(0.0)).alias("accuracy")).select(F.lit(name).alias("target"), "accuracy")
    y = F.col("y")
    t = cut(acc("flat", y, N_CLASSES).unionByName(acc("application", F.floor(y / 2), len(APPS))).unionByName(acc("mode", y % 2, 2)))
    pick = lambda n: F.max(F.when(F.col("target") == n, F.col("accuracy")))
    return t.unionByName(t.agg((pick("application") * pick("mode")).alias("accuracy")).select(F.lit("product").alias("target"), "accuracy"))


def probe_features(aux: DataFrame, target: DataFrame, reg: float = 0.1) -> DataFrame:
    """Linear probes fitted on one corpus, read out on another: class probabilities, entropy, margin, level residual.

    Both frames hold ``features``; ``aux`` also holds ``y`` and ``level``.
    """
    clf = LogisticRegression(labelCol="y", maxIter=20, regParam=reg).fit(aux.withColumn("y", F.col("y").cast("double")))
    out = clf.transform(target).withColumn("probs", vector_to_array("probability")).drop("rawPrediction", "probability", "prediction")
    reg_m = LinearRegression(labelCol="level", regParam=reg, elasticNetParam=0.0, maxIter=20).fit(aux)
    out = reg_m.transform(out)
    s = F.array_sort("probs")
    entropy = F.aggregate("probs", F.lit(0.0), lambda a, p: a - p * F.log(F.greatest(p, F.lit(1e-9))))
    return out.withColumn("entropy", entropy).withColumn("margin", F.element_at(s, -1) - F.element_at(s, -2)).withColumn("residual", F.col("level") - F.col("prediction"))


def probe_quality(scored: DataFrame) -> DataFrame:
    """Accuracy of the class probe and R squared of the level probe on held-out rows."""
    mu = scored.agg(F.avg("level").alias("m")).scalar()
    d = scored.withColumn("__mu", mu)
    sse, sst = F.sum(F.col("residual") * F.col("residual")), F.sum((F.col("level") - F.col("__mu")) * (F.col("level") - F.col("__mu")))
    return d.agg(F.count(F.lit(1)).alias("rows"), F.avg(F.when(E.argmax("probs") == F.col("y"), 1.0).otherwise(0.0)).alias("accuracy"), (1 - sse / sst).alias("r2"))


def probe_block(aux: DataFrame, target: DataFrame, classes: dict[str, int], levels: Sequence[str], reg: float = 0.01, rounds: int = 200) -> DataFrame:
    """Linear probes of several targets, fitted on one corpus and read out on the rows of another.

    Both frames hold ``features`` and every target column.  A class target (name -> classes) adds probs_, entropy_ and
    margin_ columns, a level pred_ and resid_, how far the row lies from what the first corpus expects of it.  Features
    are scaled by the first corpus; its rows without a target are left out of that probe.
    """
    aux, out = scaled(aux, target)
    for name, n in classes.items():
        known = aux.filter(F.col(name).isNotNull()).select("features", F.col(name).cast("double").alias("y"))
        scored = FAMILIES["logistic"](0, n, {"regParam": reg, "maxIter": rounds}).fit(known).transform(out)
        out = probabilities(scored, n).withColumnRenamed("probs", f"probs_{name}").drop("rawPrediction", "probability", "prediction")
        s = F.array_sort(f"probs_{name}")
        entropy = F.aggregate(f"probs_{name}", F.lit(0.0), lambda a, p: a - p * F.log(F.greatest(p, F.lit(1e-9))))
        out = out.withColumns({f"entropy_{name}": entropy, f"margin_{name}": F.element_at(s, -1) - F.element_at(s, -2)})
    for name in levels:
        known = aux.filter(F.col(name).isNotNull()).select("features", name)
        ridge = LinearRegression(labelCol=name, predictionCol=f"pred_{name}", regParam=reg, elasticNetParam=0.0, maxIter=rounds).fit(known)
        out = ridge.transform(out).withColumn(f"resid_{name}", F.col(name) - F.col(f"pred_{name}"))
    return out


def probe_report(block: DataFrame, classes: dict[str, int], levels: Sequence[str]) -> DataFrame:
    """(probe, metric, value) on held-out rows: accuracy and the largest class share, AUC of two classes, R squared of levels."""
    n = F.count(F.lit(1))
    found = {}
    for name, k in classes.items():
        found[name, "accuracy"] = F.avg(F.when(E.argmax(f"probs_{name}") == F.col(name), 1.0).otherwise(0.0))
        found[name, "majority"] = F.greatest(*[F.sum(F.when(F.col(name) == c, 1).otherwise(0)) for c in range(k)]) / n
    for name in levels:
        found[name, "r2"] = 1 - F.avg(F.col(f"resid_{name}") * F.col(f"resid_{name}")) / F.nullif(F.var_pop(name), F.lit(0.0))
    row = block.agg(*[v.alias(f"v{i}") for i, v in enumerate(found.values())])
    long = F.explode(F.array(*[F.struct(F.lit(p).alias("probe"), F.lit(m).alias("metric"), F.col(f"v{i}").cast("double").alias("value")) for i, (p, m) in enumerate(found)]))
    parts = [row.select(long.alias("r")).select("r.*")]
    for name in (x for x, k in classes.items() if k == 2):
        auc = rank_auc(block.select(name, F.round(F.element_at(f"probs_{name}", 2), 9).alias("s")), [], "s", F.col(name) == 1)
        parts.append(auc.select(F.lit(name).alias("probe"), F.lit("auc").alias("metric"), F.col("auc").alias("value")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def probe_vectors(block: DataFrame, classes: dict[str, int], levels: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Feature vectors of nothing but probe columns, for a probe-only model."""
    arrays = [F.col(f"probs_{x}") for x in classes] + [F.array(f"entropy_{x}", f"margin_{x}") for x in classes] + [F.array(f"pred_{x}", f"resid_{x}") for x in levels]
    return cut(block.select(*keep, array_to_vector(F.concat(*arrays)).alias("features")))


def permutation_importance(model, data: DataFrame, columns: Sequence[str], row: str, seed: int = 7) -> DataFrame:
    """Split importance of a fitted forest and the accuracy lost when one column is shuffled.

    A column is shuffled by position in two seeded orders; all columns share the two orders.
    """
    from tessera.operators.folds import seeded_ordinal
    pos = seeded_ordinal(data.select(row, "y", "features"), [], row, seed, "__o")
    other = seeded_ordinal(data.select(row, F.col("features").alias("other")), [], row, seed + 1, "__o").drop(row)
    both = cut(pos.join(other, "__o"))
    swap = lambda i: array_to_vector(F.transform(vector_to_array("features"), lambda v, j: F.when(j == i, F.element_at(vector_to_array("other"), i + 1)).otherwise(v)))
    variants = F.explode(F.array(F.struct(F.lit(-1).alias("col"), F.col("features").alias("f")), *[F.struct(F.lit(i).alias("col"), swap(i).alias("f")) for i in range(len(columns))]))
    v = both.select("y", variants.alias("v")).select("y", "v.col", F.col("v.f").alias("features"))
    acc = model.transform(v).groupBy("col").agg(F.avg(F.when(F.col("prediction") == F.col("y"), 1.0).otherwise(0.0)).alias("acc"))
    base = acc.filter("col = -1").select("acc").scalar()
    names = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("col") + 1)
    split = F.element_at(F.array(*[F.lit(float(x)) for x in model.featureImportances.toArray()]), F.col("col") + 1)
    return acc.filter("col >= 0").select(names.alias("feature"), split.alias("split_importance"), (base - F.col("acc")).alias("accuracy_drop"))


def shipped(train: DataFrame, test: DataFrame, external: DataFrame, weight: float = 0.4, temperature: float = 2.0, members: Sequence[tuple[str, dict]] = (("boosted", {}), ("forest", {}), ("forest", {"featureSubsetStrategy": "all"}))) -> DataFrame:
    """Three tree families (boosted, random forest, bagged trees over all columns) averaged, tempered, corrected by the class prior, blended with an external matrix, ruled.

    ``test`` carries ``audio_only``; ``external`` is probability rows of the same rows.
    """
    fits = [rows_of(fit_predict(family, train, test, N_CLASSES, dict(p)), f"tree_{i}") for i, (family, p) in enumerate(members)]
    mean = E.blend(reduce(lambda a, b: a.unionByName(b), fits), {f"tree_{i}": 1 / len(fits) for i in range(len(fits))})
    own = E.prior_correct(E.temper(mean, temperature), E.prior_row(train).scalar()).withColumn("model", F.lit("own"))
    both = own.unionByName(external.withColumn("model", F.lit("external")).select(*own.columns))
    pred = E.argmax_rows(E.blend(both, {"own": weight, "external": 1 - weight}))
    last = 2 * (len(APPS) - 1)
    return E.force_class(pred.join(test.select("row_id", "audio_only"), "row_id"), "audio_only", [last, last + 1], last)


# ---- same-source scorer ----------------------------------------------------------------------

def pair_scorer(positives: DataFrame, negatives: DataFrame, group: str, columns: Sequence[str], train_share: float = 0.7, seed: int = 5) -> tuple[object, DataFrame]:
    """Forest on pair features; trained and tested on disjoint groups."""
    pairs = positives.withColumn("y", F.lit(1)).unionByName(negatives.withColumn("y", F.lit(0)))
    side = unit(seed, group) < train_share
    v = assemble(pairs.withColumn("is_train", side).withColumn("row_id", F.col("flow_id")), columns, ["row_id", "flow_id_b", "y", "is_train"])
    model = RandomForestClassifier(labelCol="y", numTrees=10, maxDepth=5, seed=SEED).fit(v.filter("is_train").withColumn("y", F.col("y").cast("double")))
    scored = cut(probabilities(model.transform(v), 2).select("row_id", "flow_id_b", "y", "is_train", F.round(F.element_at("probs", 2), 9).alias("score")))
    return model, scored
