"""Every stage of the pipeline against plain Python on its own input."""

import zlib
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from tessera.llm import quality
from tests.conftest import SF
from tests.llm import brute


def lines_kept(text, gone):
    return "\n".join(x for x in text.split("\n") if " ".join(brute.WORD.findall(x.lower())) not in gone)


def after_quality(rows):
    often = brute.frequent([(i, t, s) for i, t, s in rows], quality.LINE_DOCS, quality.LINE_CONTEXTS)
    out = []
    for i, t, s in rows:
        n = brute.counts(t)
        gone = {x for h, x in often if h == s}
        lost = sum(len(x.split(" ")) for x, _, _ in brute.norm_lines(t) if x in gone)
        if n[0] >= 50 and 100 * n[4] <= 50 * n[0] and 100 * (n[0] - lost) >= 20 * n[0]:
            out.append((i, lines_kept(t, gone), s))
    return out


def after_lines(rows):
    gone = brute.spread(rows, 10, 10)
    return [(i, lines_kept(t, gone), s) for i, t, s in rows]


def after_near(rows):
    at = brute.components({i: brute.fingerprint(t) for i, t, _ in rows})
    return [r for r in rows if at[r[0]] == r[0]]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    read = lambda d: [(r["doc_id"], r["text"], r["source"]) for r in d.collect()]
    plain = {"quality_rules": after_quality, "line_dedup": after_lines, "near_dedup": after_near}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "mix", "pack"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        rows = read(docs)
        path = str(tmp_path / str(k))
        stage(spark, docs, SF).write.parquet(path)
        out = spark.read.parquet(path)
        if name in plain:
            assert out.columns == columns
            assert Counter(read(out)) == Counter(plain[name](rows)), name
        elif name == "mix":
            assert out.columns == columns
            size, took, n = Counter(), Counter(), Counter(read(out))
            for i, t, s in rows:
                size[s] += len(brute.WORD.findall(t))
            for (i, t, s), times in n.items():
                assert times <= 3
                took[s] += times * len(brute.WORD.findall(t))
            assert set(n) <= set(rows)
            aims = brute.targets(size)
            assert all(abs(took[s] - aims[s]) <= max(len(brute.WORD.findall(t)) for _, t, x in rows if x == s) for s in aims)
        else:
            check_packed(rows, out.collect())
        docs = out


def check_packed(rows, pieces):
    from tests.llm.test_operators import reference_tokenizer
    ref, want, places = reference_tokenizer(), Counter(), defaultdict(list)
    for i, t, _ in rows:
        ids = np.array(ref.encode(t, add_special_tokens=False).ids + [2], "<u4")
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)] if len(ids) > 1024 else [0, len(ids)]
        want.update((i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert Counter((p["doc_id"], p["piece"], p["start"], p["length"], p["ids_crc32"]) for p in pieces) == want
    for p in pieces:
        places[p["sequence_id"]].append((p["offset"], p["length"]))
    for p in places.values():
        p.sort()
        assert [a for a, _ in p] == np.cumsum([0] + [n for _, n in p])[:-1].tolist() and sum(n for _, n in p) <= 1024


def test_run_equals_its_stages(spark):
    packed = corpus_pipeline.run(spark, SF)
    again = corpus_pipeline.run(spark, SF)
    key = lambda d: Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in d.collect())
    assert key(packed) == key(again) and packed.count() > 0
