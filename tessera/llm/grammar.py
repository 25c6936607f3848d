"""Token files compressed by Re-Pair: frequent pairs of ids become symbols of a grammar, shard by shard.

In every round the pairs of a shard are counted and ranked, and a pair is replaced where it ranks before the pairs that
overlap it; this goes on until no pair is frequent.  A shard keeps its rules, the number of ids that each rule expands
to, the remaining symbols in as few bits as they need, and the ids before every ``BLOCK`` symbols, so any range of ids is
decoded from the symbols that cover it alone.  Shards are binary cells of Parquet files, one row per shard, which Spark
commits: a task that is lost leaves nothing behind.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm.common import pick, tokenizer_path
from tessera.llm.wordpieces import word_encoder
from tessera.operators.ordered import running_totals

VOCABULARY = "word_bpe_49k.json"
END = 2
#: Ids after which a shard is closed; the last document is not split.
SHARD_IDS = 1 << 20
#: Documents that one task sorts and writes.
PART_DOCS = 8_000
#: A pair is frequent if it is replaced so often in a round.
LEAST = 16
#: A round that replaces a smaller share of the symbols is the last.
GAIN = 0.005
#: Symbols between two entries of the offset table; a multiple of 8.
BLOCK = 1024
#: Pairs are counted in 2^BUCKET_BITS buckets; the pair of a bucket is then told apart exactly.
BUCKET_BITS = 20
MAGIC = b"RPG1"
HEAD = "<4sQIIIB"
NONE = np.int32(2 ** 31 - 1)


def ranked_pairs(seq: np.ndarray, least: int, bits: int = BUCKET_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Frequent pairs (left << 32 | right), most frequent first, and for each position the rank of its pair or NONE.

    Pairs meet in buckets; a bucket speaks for one of its pairs in a round, the others wait for a later round.
    """
    bucket = seq[:-1] * np.uint32(0x9E3779B1)
    bucket ^= seq[1:] * np.uint32(0x85EBCA6B)
    bucket >>= np.uint32(32 - bits)
    hot = np.flatnonzero(np.bincount(bucket, minlength=1 << bits) >= least)
    short = np.full(1 << bits, -1, np.int32)
    short[hot] = np.arange(len(hot), dtype=np.int32)
    bucket = short[bucket]
    at = np.flatnonzero(bucket >= 0)
    bucket = bucket[at]
    code = seq[at].astype(np.uint64) << np.uint64(32) | seq[at + 1]
    speaker = np.zeros(len(hot), np.uint64)
    speaker[bucket] = code
    own = speaker[bucket] == code
    at, bucket = at[own], bucket[own]
    n = np.bincount(bucket, minlength=len(hot))
    found = np.flatnonzero(n >= least)
    found = found[np.argsort(-n[found], kind="stable")]
    rank = np.full(len(hot), NONE, np.int32)
    rank[found] = np.arange(len(found), dtype=np.int32)
    place = np.full(len(seq) - 1, NONE, np.int32)
    place[at] = rank[bucket]
    return speaker[found], place


def chosen(place: np.ndarray) -> np.ndarray:
    """Positions whose pair ranks before both pairs that overlap it; in a run of one id, every other position."""
    again = np.flatnonzero((place[1:] == place[:-1]) & (place[1:] != NONE)) + 1
    if len(again):
        first = np.concatenate([[True], again[1:] - again[:-1] > 1])
        place = place.copy()
        place[again[(again - again[first][np.cumsum(first) - 1]) % 2 == 0]] = NONE
    edge = np.full(1, NONE, np.int32)
    around = np.concatenate([edge, place, edge])
    return np.flatnonzero((place < around[:-2]) & (place < around[2:]))


def compress(ids: np.ndarray, least: int = LEAST, gain: float = GAIN) -> tuple[int, np.ndarray, np.ndarray]:
    """(first nonterminal, rules as rows of left and right, symbols) of a sequence of ids below 2^31."""
    seq = ids.astype(np.uint32)
    base, rules, made = int(seq.max()) + 1 if len(seq) else 0, [], 0
    while len(seq) > 1:
        pairs, place = ranked_pairs(seq, least)
        at = chosen(place)
        used = np.flatnonzero(np.bincount(place[at], minlength=len(pairs)) >= least) if len(at) else at
        if not len(used):
            break
        symbol = np.zeros(len(pairs), np.uint32)
        symbol[used] = base + made + np.arange(len(used))
        rules.append(pairs[used])
        made += len(used)
        new = symbol[place[at]]
        at, new = at[new > 0], new[new > 0]
        before = len(seq)
        seq[at] = new
        keep = np.ones(before, bool)
        keep[at + 1] = False
        seq = seq[keep]
        if before - len(seq) < gain * before:
            break
    flat = np.concatenate(rules) if rules else np.zeros(0, np.uint64)
    return base, np.stack([flat >> np.uint64(32), flat & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32), seq


# ---- the shard --------------------------------------------------------------------------------

def to_bits(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bits of each number, high bit first, without gaps."""
    return np.packbits(np.unpackbits(values.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)[:, 32 - width:]).tobytes()


def from_bits(raw: bytes | memoryview, n: int, width: int) -> np.ndarray:
    bits = np.zeros((n, 32), np.uint8)
    bits[:, 32 - width:] = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * width).reshape(n, width)
    return np.packbits(bits, axis=1).view(">u4").ravel().astype(np.uint32)


def rule_lengths(base: int, rules: np.ndarray) -> np.ndarray:
    """Ids that each rule expands to; a rule uses earlier ones only."""
    sizes: list[int] = []
    size = lambda s: 1 if s < base else sizes[s - base]
    for left, right in rules.tolist():
        sizes.append(size(left) + size(right))
    return np.array(sizes, np.int64)


def write_shard(ids: np.ndarray, least: int = LEAST, gain: float = GAIN) -> bytes:
    """Head, rules, their lengths, offsets of blocks of symbols, symbols."""
    base, rules, seq = compress(ids, least, gain)
    lengths = rule_lengths(base, rules)
    width = max(1, int(base + len(rules)).bit_length())
    each = np.ones(len(seq), np.int64)
    each[seq >= base] = lengths[seq[seq >= base] - base]
    marks = np.concatenate([[0], np.cumsum(each)])[:-1:BLOCK]
    return b"".join([struct.pack(HEAD, MAGIC, len(ids), base, len(rules), len(seq), width), rules.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(),
                     marks.astype("<u8").tobytes(), to_bits(seq, width)])


class Shard:
    """A shard that is decoded as a whole or by ranges of ids."""

    def __init__(self, data: bytes):
        magic, self.n, self.base, n_rules, self.symbols, self.width = struct.unpack_from(HEAD, data)
        if magic != MAGIC:
            raise ValueError("not a shard of compressed ids")
        view, at = memoryview(data), struct.calcsize(HEAD)
        take = lambda kind, n: np.frombuffer(view, kind, n, at)
        self.rules = take("<u4", 2 * n_rules).reshape(-1, 2)
        at += 8 * n_rules
        self.lengths = take("<u4", n_rules).astype(np.int64)
        at += 4 * n_rules
        self.marks = take("<u8", -(-self.symbols // BLOCK)).astype(np.int64)
        self.body = view[at + 8 * len(self.marks):]
        self.size = np.concatenate([np.ones(self.base, np.int64), self.lengths])
        self.start = np.concatenate([np.arange(self.base), self.base + np.cumsum(self.lengths) - self.lengths])
        whole = [np.arange(self.base, dtype="<u4").tobytes()]
        known: list[bytes] = []
        one = lambda s: s.to_bytes(4, "little") if s < self.base else known[s - self.base]
        for left, right in self.rules.tolist():
            known.append(one(left) + one(right))
        self.expanded = np.frombuffer(b"".join(whole + known), "<u4")

    def expand(self, seq: np.ndarray) -> np.ndarray:
        size = self.size[seq]
        ends = np.cumsum(size)
        return self.expanded[np.repeat(self.start[seq] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids from ``start`` to ``stop``; only the blocks of symbols that hold them are read."""
        stop = self.n if stop is None else stop
        if not 0 <= start <= stop <= self.n:
            raise IndexError(f"{start}:{stop} of {self.n} ids")
        if start == stop:
            return np.zeros(0, "<u4")
        first = int(np.searchsorted(self.marks, start, "right")) - 1
        last = int(np.searchsorted(self.marks, stop, "left"))
        symbols = min(self.symbols, last * BLOCK) - first * BLOCK
        a, b = first * BLOCK * self.width // 8, -(-(first * BLOCK + symbols) * self.width // 8)
        seq = from_bits(self.body[a:b], symbols, self.width)
        skip = start - int(self.marks[first])
        return self.expand(seq)[skip:skip + stop - start]


# ---- files ------------------------------------------------------------------------------------

FILE = "part int, ix int, n_ids bigint, doc_ids array<bigint>, counts array<bigint>, data binary"


def shards_of(vocabulary: str, end: int, shard_ids: int):
    """Sorted documents of one part to its shards."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, mark = word_encoder(tokenizer_path(vocabulary)), np.array([end], "<u4").tobytes()
        raw, docs, counts, ix, size, part = [], [], [], 0, 0, None

        def close() -> pa.RecordBatch:
            data = write_shard(np.frombuffer(b"".join(raw), "<u4"))
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            row = [pa.array([x], k) for x, k in zip((part, ix, size, docs, counts, data), kinds)]
            return pa.RecordBatch.from_arrays(row, ["part", "ix", "n_ids", "doc_ids", "counts", "data"])

        for batch in batches:
            texts = encoder.raws([t or "" for t in batch.column(1).to_pylist()])
            for doc, ids, at in zip(batch.column(0).to_pylist(), texts, batch.column(2).to_pylist()):
                ids += mark
                part = at
                raw.append(ids)
                docs.append(doc)
                counts.append(len(ids) // 4)
                size += len(ids) // 4
                if size >= shard_ids:
                    yield close()
                    raw, docs, counts, ix, size = [], [], [], ix + 1, 0
        if docs:
            yield close()

    return run


def write_tokens(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end: int = END, shard_ids: int = SHARD_IDS) -> None:
    """Writes the ids of all documents in ascending doc_id, each followed by ``end``, as compressed shards.

    A null or empty text is the end mark alone; documents without an id come first; rows that repeat an id are ordered by
    their text, and each is a document of its own; extra columns are left out; an empty table gives files without shards.
    Texts are dealt by ranges of (id, text, part of the input), so that neither an id nor a row that repeats very often
    is one task's; they are encoded after that, and ids are never shuffled.
    """
    rows = pick(docs, doc_id="bigint", text="string").withColumns({"h": F.xxhash64("text"), "from": F.spark_partition_id()})
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-docs.count() // PART_DOCS))
    dealt = rows.repartitionByRange(parts, "doc_id", "h", "from").sortWithinPartitions("doc_id", "h")
    dealt.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInArrow(shards_of(vocabulary, end, shard_ids), FILE).write.parquet(path)


def per_document(spark: SparkSession, path: str, kind: str, value) -> DataFrame:
    """doc_id, start (ids before the document), n_tokens and ``value`` of the document's ids, decoded from the files."""
    files = spark.read.parquet(path)
    place = (F.col("part").cast("bigint") * (1 << 31) + F.col("ix")).alias("place")
    starts = running_totals(files.select(place, "n_ids"), [], "place", ["n_ids"]).select("place", F.col("n_ids_below").alias("before"))
    out = f"place bigint, doc_id bigint, at bigint, n_tokens bigint, value {kind}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, docs, counts, data in zip(*[batch.column(k).to_pylist() for k in range(4)]):
                raw = memoryview(Shard(data).ids().astype("<u4").tobytes())
                ends = np.cumsum(counts)
                cells = [value(raw[4 * (e - n):4 * e]) for e, n in zip(ends.tolist(), counts)]
                numbers = pa.array(np.full(len(docs), place)), pa.array(docs, pa.int64()), pa.array(ends - counts, pa.int64()), pa.array(counts, pa.int64())
                yield pa.RecordBatch.from_arrays([*numbers, pa.array(cells, pa.binary() if kind == "binary" else pa.int64())], ["place", "doc_id", "at", "n_tokens", "value"])

    found = files.select(place, "doc_ids", "counts", "data").mapInArrow(run, out)
    return found.join(starts, "place").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "value")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian 32-bit) of every document in the files."""
    return per_document(spark, path, "binary", bytes).withColumnRenamed("value", "ids")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from its decoded ids."""
    return per_document(spark, path, "bigint", zlib.crc32).withColumnRenamed("value", "ids_crc32")


def read_range(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """(start, ids) of the shards that hold ids from ``start`` to ``stop`` of the whole corpus, cut to that range."""
    files = spark.read.parquet(path)
    place = (F.col("part").cast("bigint") * (1 << 31) + F.col("ix")).alias("place")
    below = running_totals(files.select(place, "n_ids"), [], "place", ["n_ids"]).select("place", F.col("n_ids_below").alias("before"), (F.col("n_ids_below") + F.col("n_ids")).alias("after"))
    met = below.filter((F.col("before") < stop) & (F.col("after") > start))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for before, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = Shard(data)
                a, b = max(0, start - before), min(shard.n, stop - before)
                yield pa.RecordBatch.from_arrays([pa.array([before + a], pa.int64()), pa.array([shard.ids(a, b).astype("<u4").tobytes()], pa.binary())], ["start", "ids"])

    return files.select(place, "data").join(met, "place").select("before", "data").mapInArrow(run, "start bigint, ids binary")
