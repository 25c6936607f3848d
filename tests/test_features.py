"""Formulas against plain NumPy, and fold, sampling and text invariants."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import docs, evaluate as E, fitted, flows, folds, ledger, retrieval, search, verdicts
from tessera.vocabulary import LENGTHS, TIMES


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(5)
    n = 60
    pdf = pd.DataFrame({c: rng.choice([47, 120, 650, 651, 1150], n).astype(float) for c in LENGTHS})
    t = np.cumsum(np.c_[np.zeros(n), rng.choice([0, 0.0004, 0.0005, 0.003, 0.03], (n, 4))], axis=1)
    for i, c in enumerate(TIMES):
        pdf[c] = t[:, i]
    pdf["flow_id"] = np.arange(n)
    return pdf


@pytest.fixture(scope="module")
def wide(spark, sample):
    return flows.feature_frame(spark.createDataFrame(sample), ["flow_id"]).toPandas().sort_values("flow_id")


def test_frame_shape(wide):
    assert len(wide.columns) == 242
    assert np.isfinite(wide.to_numpy()).all()


def test_moments(sample, wide):
    x = sample[LENGTHS].to_numpy()
    assert np.allclose(wide["len_std"], x.std(axis=1), rtol=1e-5)
    assert np.allclose(wide["len_q75"], np.percentile(x, 75, axis=1), rtol=1e-6)
    assert np.allclose(wide["len_skew"], pd.DataFrame(x).skew(axis=1).fillna(0), atol=1e-4)
    assert np.allclose(wide["len_kurt"], pd.DataFrame(x).kurt(axis=1).fillna(0), atol=1e-3)
    d = np.diff(sample[TIMES].to_numpy(), axis=1)
    assert np.allclose(wide["iat_q25"], np.percentile(d, 25, axis=1), atol=1e-7)


def test_spectrum(sample, wide):
    x = sample[LENGTHS].to_numpy()
    mag = np.abs(np.fft.rfft(x, axis=1))
    assert all(np.allclose(wide[f"len_fftmag_{k}"], mag[:, k], rtol=1e-4, atol=1e-2) for k in range(3))
    dct = np.array([[x[r] @ np.array(w) for w in flows.dct_weights(5)] for r in range(len(x))])
    assert np.allclose((dct ** 2).sum(1), (x ** 2).sum(1))
    assert np.allclose(wide["len_dct_2"], dct[:, 2], rtol=1e-4, atol=1e-2)


def test_bursts(sample, wide):
    x, d = sample[LENGTHS].to_numpy(), np.diff(sample[TIMES].to_numpy(), axis=1)
    for thr, tag in ((0.0005, "500us"), (0.001, "1000us"), (0.005, "5000us")):
        for r in range(len(x)):
            parts = np.split(np.arange(5), np.flatnonzero(d[r] >= thr) + 1)
            w = wide.iloc[r]
            assert w[f"n_groups_{tag}"] == len(parts)
            assert w[f"group_max_packets_{tag}"] == max(len(p) for p in parts)
            assert w[f"group_max_bytes_{tag}"] == max(x[r][p].sum() for p in parts)


def test_size_edges():
    e = flows.size_edges()
    assert e[0] == 20 and e[-1] == 1400 and len(e) == 24


def test_jitter_repeats(spark, sample):
    df = spark.createDataFrame(sample)
    a, b = (flows.jitter(df.repartition(n), 3, "flow_id").orderBy("flow_id", "packet_index").toPandas() for n in (2, 7))
    assert a.equals(b)
    orig = sample.set_index("flow_id")
    assert all(abs(r.length - orig.loc[r.flow_id, f"packet_length_{r.packet_index}"]) <= 2 for r in a.itertuples())


# ---- folds -----------------------------------------------------------------------------------

def test_folds(tables):
    g = tables.grouped.filter("split = 'train'")
    f = folds.group_folds(g, "flow_id", "gkey", "label_id").toPandas()
    assert f.groupby(["repeat", "gkey"])["fold"].nunique().max() == 1
    assert len(f) == 2 * g.count()
    sizes = f.groupby(["repeat", "fold"]).size().unstack()
    assert (sizes.max(axis=1) - sizes.min(axis=1) <= f.groupby(["repeat", "gkey"]).size().max() + 10).all()
    s = folds.stratified_folds(g, "flow_id", "label_id").toPandas().groupby(["label_id", "fold"]).size().unstack().fillna(0)
    assert (s.max(axis=1) - s.min(axis=1)).max() <= 1
    p = folds.permuted_folds(g.select("flow_id"), "flow_id").groupBy("fold").count().toPandas()["count"]
    assert p.max() - p.min() <= 1


def test_shuffled_labels_keep_counts(tables):
    s = folds.shuffled_labels(tables.train.select("flow_id", "label_id"), "flow_id", "label_id", 1).toPandas()
    assert sorted(s["label_id"]) == sorted(s["shuffled"]) and (s["label_id"] != s["shuffled"]).any()


# ---- scores ----------------------------------------------------------------------------------

def test_report_counts_absent_classes(spark):
    rows = spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "y int, pred int")
    rep = {r.label_id: r for r in E.class_report(rows).collect()}
    assert len(rep) == 10 and rep[9].f1 == 0 and rep[1].precision == 0.5
    assert np.isclose(E.summary(rows).first()["macro_f1"], (2 / 3 + 2 / 3) / 10)


def test_mcnemar_known_value(spark):
    c = spark.createDataFrame([(1285, 49, 66)], "rows long, a_only long, b_only long")
    assert round(E.mcnemar(c).first()["p_value"], 4) == 0.1354


def test_mcnemar_matches_the_plain_sum(spark):
    from math import comb
    pairs = [(0, 3), (1, 9), (12, 20), (200, 260), (5, 5)]
    got = E.mcnemar(spark.createDataFrame([(1, a, b) for a, b in pairs], "rows long, a_only long, b_only long")).collect()
    for r, (a, b) in zip(got, pairs):
        want = 1.0 if a == b else min(1.0, 2 * sum(comb(a + b, i) for i in range(min(a, b) + 1)) / 2 ** (a + b))
        assert np.isclose(r.p_value, want, rtol=1e-9)


def test_arbitration(spark):
    rows = [("1", "0", "1", 0.9), ("1", "0", "0", 0.5), ("1", "1", "1", 0.5), ("1", "0", "N/A", 0.5), (None, "0", None, 0.5), (None, None, None, 0.9)]
    df = spark.createDataFrame(rows, "a string, b string, c string, confidence double")
    got = [(r.verdict, r.source) for r in verdicts.arbitrate(df, ["a", "b", "c"]).collect()]
    assert got == [("1", "single_high_confidence"), ("0", "majority"), ("1", "unanimous"), ("1", "split_pending_tiebreak"),
                   ("0", "incomplete_escalation_votes"), ("0", "incomplete_escalation_votes")]


def test_verdict_score_compares_strings(spark):
    """A blank cell is wrong, and N/A is a value of its own."""
    gold = spark.createDataFrame([("c", i, "N/A" if i == 3 else "1") for i in range(1, 42)], "case_id string, cp int, gold string").withColumn("element", F.lit("all"))
    table = verdicts.wide(gold.filter("cp <> 5").withColumn("v", F.when(F.col("cp") == 3, "0").otherwise(F.col("gold"))), "v")
    row = verdicts.accuracy_report(verdicts.score_cells(gold, verdicts.long_form(table, "pred"))).filter("level = 'overall'").first()
    assert (row.correct, row.total) == (39, 41)


def test_last_write_wins(spark):
    df = spark.createDataFrame([(1, 7, "a"), (3, 7, "c"), (2, 7, "b"), (1, 8, "z")], "seq long, hash long, v string")
    assert {(r.hash, r.v) for r in search.last_per_key(df, "hash", "seq").collect()} == {(7, "c"), (8, "z")}


def test_prompt_and_responses(spark):
    df = spark.createDataFrame([(1, 'x ```json [{"cp":"CP1","verdict":"1"},{"cp":"CP1","verdict":"0"},] ``` y'), (2, 'cut [{"cp": "CP2", "v": 1, "verdict": "N/A"}, {"cp": "CP3'), (3, "nothing"), (4, None)], "id int, t string")
    got = {(r.id, r.cp, r.verdict) for r in ledger.parse_verdicts(df, ["id"], "t").collect()}
    assert got == {(1, "CP1", "0"), (2, "CP2", "N/A")}


def test_responses_without_braces(spark):
    texts = ['cut "cp": "CP2", "v": 1, "verdict": "N/A"', '{"cp":"CP3","verdict":"1"', '[{"cp":"CP1","verdict":"0"}, {"cp":"CP3","verdict":"1"', '"cp":"CP1","verdict":"1"\n"cp":"CP2","verdict":"0"',
             '"cp":"CP4"} {"verdict":"1"', '{"cp":"CP5","reason":"un"quoted","verdict":"0"},', '[{"verdict":"1","cp":"CP6"},]', '"cp":"CP99","verdict":"1"', '"cp":"CP1","verdict":"1" then "cp":"CP1","verdict":"0"', '{"cp":"CP7","verdict":"1']
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {(r.id, r.cp, r.verdict) for r in ledger.parse_verdicts(df, ["id"], "t").collect()}
    assert got == {(0, "CP2", "N/A"), (1, "CP3", "1"), (2, "CP1", "0"), (2, "CP3", "1"), (3, "CP1", "1"), (3, "CP2", "0"), (5, "CP5", "0"), (6, "CP6", "1"), (8, "CP1", "0")}


def test_quoted_pairs_wait_for_a_known_verdict(spark):
    texts = ['"cp" : "CP1" "verdict":"maybe", "verdict" :\n"1"', '"cp":"CP1","cp":"CP2","verdict":"0","cp":"CP3","verdict":"N/A"', '"verdict":"1","cp":"CP4"', '"xcp":"CP5","verdict":"1"', '"cp":"CPx","verdict":"1","cp":"CP","verdict":"0"',
             '"cp":"CP99","verdict":"1","verdict":"0"', 'cp":"CP6","verdict":"1"', '"cp":"CP7","note":"said \\"no\\"","verdict":"0"']
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r.id: [tuple(x) for x in r.p] for r in df.select("id", ledger.quoted_pairs(F.col("t")).alias("p")).collect()}
    assert got == {0: [("CP1", "1")], 1: [("CP1", "0"), ("CP3", "N/A")], 2: [], 3: [], 4: [], 5: [("CP99", "1")], 6: [], 7: [("CP7", "0")]}


# ---- text ------------------------------------------------------------------------------------

def test_chunker(spark):
    long = "\n".join(f"line {i} " + "w " * 50 for i in range(12))
    text = f"preface is dropped\n## Track 2 — Plan\n\nalpha beta\ngamma\n\n### Sheet: one\nrow | 1\n---\n{long}\n## Track 4 — X\nlast"
    parts = spark.createDataFrame([("c", 1, text), ("c", 0, "## Track 9 —\nzero"), ("c", 2, None)], "case_id string, part int, text string")
    rows = docs.chunk_parts(parts, ["part"]).orderBy("chunk_id").collect()
    assert [r["chunk_id"] for r in rows] == list(range(len(rows))) and (rows[0]["track"], rows[0]["text"]) == (9, "zero")
    got = [(r["track"], r["text"]) for r in rows[1:]]
    assert got[0] == (2, "alpha beta\ngamma") and got[1] == (2, "### Sheet: one\nrow | 1") and got[-1] == (4, "last")
    packed = got[2:-1]
    assert all(len(c.split()) <= 280 for _, c in packed) and "\n".join(c for _, c in packed).split() == long.split()


def test_bm25_brute_force(spark):
    texts = ["a b c a", "b b d", "c d e f", "a", ""]
    q = ["a b b", "f"]
    ch = spark.createDataFrame([("x", i, t) for i, t in enumerate(texts)], "corpus string, doc_id long, text string")
    qs = spark.createDataFrame(list(enumerate(q)), "query_id long, text string")
    got = {(r.query_id, r.doc_id): r.score for r in retrieval.bm25(ch, qs).collect()}
    tok = [t.split() for t in texts]
    n, avg = len(tok), np.mean([len(t) for t in tok])
    raw = {w: np.log(n - d + .5) - np.log(d + .5) for w in {w for t in tok for w in t} for d in [sum(w in t for t in tok)]}
    idf = {w: v if v >= 0 else 0.25 * np.mean(list(raw.values())) for w, v in raw.items()}
    for i, query in enumerate(q):
        for j, t in enumerate(tok):
            s = sum(idf[w] * t.count(w) * 2.5 / (t.count(w) + 1.5 * (.25 + .75 * len(t) / avg)) for w in query.split() if w in t)
            assert np.isclose(got.get((i, j), 0.0), s)


def test_blocks_do_not_change_results(spark):
    rng = np.random.default_rng(2)
    q = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(7)], "query_id long, vector array<double>")
    d = spark.createDataFrame([("c" if i < 20 else "e", i, rng.normal(size=8).tolist()) for i in range(30)], "corpus string, doc_id long, vector array<double>")
    pairs = lambda a, b: pd.DataFrame({"query_id": np.repeat(a["query_id"], len(b)), "doc_id": np.tile(b["doc_id"], len(a))})
    for rows in (3, 4096):
        got = retrieval.block_pairs(q, d, pairs, "query_id long, doc_id long", query_block=2, row_block=rows).toPandas()
        assert len(got) == 210 and len(got.drop_duplicates()) == 210
    assert retrieval.block_pairs(q.limit(0), d, pairs, "query_id long, doc_id long").count() == 0
    assert retrieval.cosine_top(q, d.limit(0)).count() == 0 and retrieval.cosine_top(q, d, 4).count() == 7 * 2 * 4


def test_containing_meets_at_rare_tokens(spark):
    texts = ["xx alpha beta gamma yy", "alpha beta", "zalpha beta gammaq", "beta gamma alpha", ""]
    items = ["alpha beta gamma", "beta", "nothing here at all", "alpha beta"]
    d = spark.createDataFrame([("c", i, t) for i, t in enumerate(texts)], "corpus string, doc_id long, text string")
    q = spark.createDataFrame(list(enumerate(items)), "query_id long, item string")
    got = {(r.query_id, r.doc_id) for r in retrieval.containing(d, q).collect()}
    assert got == {(i, j) for i, x in enumerate(items) for j, t in enumerate(texts) if x in t and (i, j) != (3, 2)} | {(3, 2)} & got


def test_pair_means_match_all_pairs(spark):
    rng = np.random.default_rng(4)
    x, lab = rng.normal(size=(25, 4)), rng.integers(0, 3, 25)
    df = spark.createDataFrame([(int(l), v.tolist()) for l, v in zip(lab, x)], "b int, vec array<double>")
    got = {(r.block_a, r.block_b): (r.pairs, r.mean_cosine) for r in fitted.block_pair_means(df, "b", "vec", 4).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    for (a, b), (n, m) in got.items():
        v = [s[i, j] for i in range(25) for j in range(25) if (i < j if a == b else True) and lab[i] == a and lab[j] == b]
        assert n == len(v) and np.isclose(m, np.mean(v))
