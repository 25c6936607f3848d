"""Compressed token files: exact round trips, random access, and the tokenizer file as it is."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import grammar
from tessera.llm.common import read, text_session
from tessera.llm.wordpieces import WordEncoder
from tessera.session import scratch_path

PATH = public_tokenizers.path(grammar.VOCABULARY)


def library():
    return Tokenizer.from_file(PATH)


ODD = ["", " ", "\n\n ", "a  b\n\nc", "Don't we'll I'VE", "naïve 😀 ½²Ⅳ 12a_b #2", "tab\tx \x1cy z", "<|endoftext|> end <|startoftext|>x", "x<|startoftext|>", "é ́a b́", "Σας ΟΔΟΣ İ ǅ", "日本語 text\r\nnext",
       "a\x85b c　d​e᠎f", "\x00 \x00", "ﬁ ½ Å K", "한글 각", "a" * 500, "!!!??? ... '' 's't"]


def slow_expand(base, rules, seq):
    def one(s):
        return [s] if s < base else one(int(rules[s - base][0])) + one(int(rules[s - base][1]))
    return [x for s in seq.tolist() for x in one(int(s))]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 5), min_size=1, max_size=6), st.integers(1, 30)), max_size=12), st.integers(2, 6))
def test_round_trip_and_slow_expansion(parts, least):
    ids = np.array([x for part, n in parts for x in part * n], "<u4")
    base, rules, seq = grammar.compress(ids, least, 0.0)
    assert slow_expand(base, rules, seq) == ids.tolist()
    shard = grammar.Shard(grammar.write_shard(ids, least, 0.0))
    assert shard.ids().tolist() == ids.tolist() and len(shard.ids()) == shard.n
    assert [len(slow_expand(base, rules, np.array([base + k]))) for k in range(len(rules))] == shard.lengths.tolist()


def test_no_frequent_pair_is_left_and_frequent_ones_are_rules():
    rng = np.random.default_rng(4)
    ids = np.concatenate([rng.permutation(40)[:3].tolist() * 3 + [7, 8, 9] for _ in range(3000)]).astype("<u4")
    base, rules, seq = grammar.compress(ids, 10, 0.0)
    times = Counter(zip(seq.tolist(), seq.tolist()[1:]))
    assert max(n for (a, b), n in times.items() if a != b) < 20  # overlapping occurrences count more often than they can be replaced
    assert [7, 8] in rules.tolist() or [8, 9] in rules.tolist()
    assert len(seq) < 0.65 * len(ids)
    run = grammar.compress(np.full(100_000, 5, "<u4"), 2, 0.0)
    assert len(run[2]) <= 8 and run[1].tolist()[0] == [5, 5]


def test_random_access_reads_only_the_blocks_it_needs():
    rng = np.random.default_rng(6)
    ids = (rng.zipf(1.3, 300_000) % 49_408).astype("<u4")
    data = grammar.write_shard(ids)
    assert len(data) < 2 * len(ids)  # under half of plain 32-bit ids
    shard, real = grammar.Shard(data), grammar.from_bits
    for a, b in [(0, 0), (0, 1), (299_999, 300_000), (123, 4567), (1023, 1025), (150_000, 150_100), *[sorted(x) for x in rng.integers(0, 300_001, (40, 2)).tolist()]]:
        assert shard.ids(a, b).tolist() == ids[a:b].tolist()
    seen = []
    grammar.from_bits = lambda raw, n, width: seen.append(n) or real(raw, n, width)
    try:
        shard.ids(150_000, 150_100)
    finally:
        grammar.from_bits = real
    assert seen[0] <= 2 * grammar.BLOCK
    with pytest.raises(IndexError):
        shard.ids(5, 300_001)
    with pytest.raises(ValueError):
        grammar.Shard(b"XXXX" + data[4:])


def test_encoder_equals_the_library():
    ref, enc = library(), WordEncoder(PATH)
    for t in ODD + [" ".join(ODD), "\n".join(ODD[::-1])]:
        assert np.frombuffer(enc.raws([t])[0], "<u4").tolist() == ref.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("letters", ["aeinostr", "0123456789a.,!'-_", "".join(map(chr, range(33, 127))), "éèàüßñçœæǆſ", "".join(map(chr, range(0xA1, 0x250))), "İIıi'sS'T", "жшαω한中☆─✿éa", "\x1c\x85\u00a0a\u00adb"])
def test_encoder_on_random_parts(letters):
    rng, ref, enc = np.random.default_rng(len(letters)), library(), WordEncoder(PATH)
    words = ["".join(rng.choice(list(letters), rng.integers(1, 24))) for _ in range(6000)]
    for k in range(0, len(words), 500):
        text = " ".join(words[k:k + 500])
        assert np.frombuffer(enc.raws([text])[0], "<u4").tolist() == ref.encode(text, add_special_tokens=False).ids


SCHEMA = "doc_id bigint, text string, h bigint, `from` string, part int, place int, n_ids int, value string"


def want_rows(rows):
    ref, out, at = library(), [], 0
    for i, t in rows:
        ids = np.array(ref.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes()))
        at += len(ids)
    return out


def test_files_of_hard_rows(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(50, None), (2 ** 40, "far"), (-7, "before all"), (60, "one two three " * 4000)]
    df = text_session(spark).createDataFrame([(*r, 1, "f", 2, 3, 4, "v") for r in rows], SCHEMA).repartition(5)
    path = scratch_path(spark, "ids")
    grammar.write_tokens(df, path, shard_ids=100)
    assert spark.read.parquet(path).count() > 5
    want = want_rows(sorted(rows))
    assert {tuple(r) for r in grammar.checksums(spark, path).collect()} == {r[:4] for r in want}
    assert {(r["doc_id"], r["start"], bytes(r["ids"])) for r in grammar.read_tokens(spark, path).collect()} == {(r[0], r[1], r[4]) for r in want}
    raw = np.frombuffer(b"".join(r[4] for r in want), "<u4")
    for a, b in ((0, len(raw)), (90, 350), (len(raw) - 3, len(raw)), (5, 5)):
        found = sorted((r["start"], bytes(r["ids"])) for r in grammar.read_range(spark, path, a, b).collect())
        assert b"".join(x for _, x in found) == raw[a:b].tobytes()


def test_files_of_repeated_and_empty_tables(spark):
    rows = [(3, "same row")] * 40 + [(3, "other text"), (None, "no id"), (None, None), (1, "first")]
    df = text_session(spark).createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    path = scratch_path(spark, "ids")
    grammar.write_tokens(df, path, shard_ids=20)
    got = [tuple(r) for r in grammar.checksums(spark, path).orderBy("start").collect()]
    assert Counter((r[0], r[2], r[3]) for r in got) == Counter((r[0], r[2], r[3]) for r in want_rows(rows))
    assert [r[0] for r in got] == [None, None, 1] + [3] * 41 and [r[1] for r in got] == np.cumsum([0] + [r[2] for r in got])[:-1].tolist()
    empty = scratch_path(spark, "ids")
    grammar.write_tokens(df.limit(0), empty)
    assert grammar.checksums(spark, empty).collect() == [] == grammar.read_tokens(spark, empty).collect()


def test_whole_table_equals_the_library(spark):
    docs = read(spark, "/root/testdata/sf0.001", "documents")
    path = scratch_path(spark, "ids")
    grammar.write_tokens(docs, path)
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    assert {tuple(r) for r in grammar.checksums(spark, path).collect()} == {r[:4] for r in want_rows(rows)}
    sizes = spark.read.parquet(path).agg(F.sum(F.length("data")), F.sum("n_ids")).first()
    assert sizes[0] < 2.5 * sizes[1]
