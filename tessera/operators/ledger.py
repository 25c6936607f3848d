"""Call ledgers: request keys, resumable batches, totals, tolerant response parsing, prompt text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tessera.session import scratch_path
from tessera.vocabulary import N_CHECKPOINTS

# The answers a checkpoint can have.
VERDICTS = ("1", "0", "N/A")
tally = lambda cond: F.sum(F.when(cond, 1).otherwise(0))


def request_key(provider: Column, model: Column, temperature: Column, prompt: Column) -> Column:
    return F.md5(F.concat_ws("|", provider, model, temperature, prompt))


def cache_hits(requests: DataFrame, cache: DataFrame, key: str = "prompt_hash") -> DataFrame:
    """Requests with a flag whether their key is stored; the cache side shrinks to its keys."""
    known = cache.select(key).distinct().withColumn("cached", F.lit(True))
    return requests.join(known, key, "left").withColumn("cached", F.coalesce("cached", F.lit(False)))


def append_log(requests: DataFrame, path: str | None = None) -> DataFrame:
    """Append the batch to a Parquet log and return the log."""
    path = path or scratch_path(requests.sparkSession, "requests")
    requests.write.mode("append").parquet(path)
    return requests.sparkSession.read.parquet(path)


def resume(ledger: DataFrame, done: DataFrame, key: str = "case_id") -> DataFrame:
    """Work that has no checkpoint yet."""
    return ledger.join(done.select(key).distinct(), key, "left_anti")


def call_status(ledger: DataFrame, max_tokens: int) -> DataFrame:
    cut_off = (F.col("finish_reason") == "length") | (F.col("completion_tokens") >= max_tokens)
    return ledger.withColumn("status", F.when(cut_off, "truncated").otherwise("ok"))


def totals(ledger: DataFrame) -> DataFrame:
    """Calls, tokens and truncated calls per model and case, with subtotals."""
    r = ledger.rollup("model", "case_id").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"),
        F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"), tally(F.col("finish_reason") == "length").alias("finish_length"),
        F.grouping_id().alias("level"))
    return r


def finish_mix(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("model", "finish_reason").agg(F.count(F.lit(1)).alias("calls"))


def status_counts(rows: DataFrame, status: str, shard: Column) -> DataFrame:
    return rows.groupBy(shard.alias("shard"), status).agg(F.count(F.lit(1)).alias("n"))


def quoted_pairs(piece: Column) -> Column:
    """(cp, verdict) pairs of a text without braces, read off the strings between its quotes.

    A key is a quoted name with a colon behind it, its value the next quoted string.  A checkpoint waits for the first
    verdict of the closed list after it; what else stands in between, another checkpoint too, is passed over.
    """
    parts = F.split(piece, '"')
    value = lambda i: F.get(parts, i + 2)
    number = lambda v: F.substring(v, 3, 99)
    cp = lambda v: v.startswith("CP") & (number(v) != "") & (F.translate(number(v), "0123456789", "") == "")
    is_key = lambda i: (i > 0) & (F.trim(F.translate(F.get(parts, i + 1), "\t\r\n", "   ")) == ":") & F.get(parts, i + 3).isNotNull()
    known = lambda x, i: F.when(is_key(i) & (x == "cp") & cp(value(i)), F.struct(value(i).alias("cp"), F.lit(None).cast("string").alias("verdict"))).when(
        is_key(i) & (x == "verdict") & value(i).isin(*VERDICTS), F.struct(F.lit(None).cast("string").alias("cp"), value(i).alias("verdict")))
    found = F.filter(F.transform(parts, known), lambda r: r.isNotNull())
    state = lambda cp, out: F.struct(cp.alias("cp"), out.alias("out"))
    pair = lambda a, r: F.array(F.struct(a["cp"].alias("cp"), r["verdict"].alias("verdict")))
    step = lambda a, r: F.when(r["cp"].isNotNull(), state(F.coalesce(a["cp"], r["cp"]), a["out"])).when(
        a["cp"].isNotNull(), state(F.lit(None).cast("string"), F.concat(a["out"], pair(a, r)))).otherwise(a)
    none = state(F.lit(None).cast("string"), F.array().cast("ARRAY<STRUCT<cp: STRING, verdict: STRING>>"))
    return F.aggregate(found, none, step)["out"]


def parse_verdicts(responses: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """(cp, verdict) pairs out of model text.

    What stands from the first opening to the last closing bracket is read as one array.  Where that gives nothing
    (trailing commas, a cut-off answer), the pieces between braces are read one by one, also those before the first and
    after the last brace: every checkpoint with the next verdict of its piece, or else the piece as an object, without
    a comma at the end.  A repeated checkpoint keeps its last answer.
    """
    keys = list(keys)
    t = F.coalesce(F.col(text), F.lit(""))
    kind = "STRUCT<cp: STRING, verdict: STRING>"
    known = F.array(*[F.lit(f"CP{i}") for i in range(1, N_CHECKPOINTS + 1)])
    named = lambda rows: F.filter(rows, lambda r: F.array_contains(known, r["cp"]) & r["verdict"].isNotNull())
    first, beyond = F.instr(t, "["), F.length(t) - F.instr(F.reverse(t), "]") + 2  # one past the last closing bracket
    body = F.when((first > 0) & (F.instr(t, "]") > 0) & (beyond > first), F.substring(t, first, beyond - first))
    whole = named(F.from_json(body, f"ARRAY<{kind}>"))
    read = lambda x: F.array(F.from_json(F.concat(F.lit("{"), F.rtrim(x, F.lit(", \t\r\n")), F.lit("}")), kind))
    single = named(F.flatten(F.transform(F.split(t, r"[{}]"), lambda x: F.when(F.size(quoted_pairs(x)) > 0, quoted_pairs(x)).otherwise(read(x)))))
    picked = F.when(F.size(F.coalesce(whole, F.array().cast(f"ARRAY<{kind}>"))) > 0, whole).otherwise(single)
    rows = responses.select(*keys, F.posexplode(picked).alias("pos", "r"))
    return rows.groupBy(*keys, F.col("r.cp").alias("cp")).agg(F.max_by("r.verdict", "pos").alias("verdict"))


def render(template: str, values: dict[str, Column]) -> Column:
    """Replace ``{NAME}`` placeholders in the given order."""
    out: Column = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def scope_text(cps: Column) -> Column:
    """Wording of the checkpoint scope for an ordered array of names."""
    # fixed values: the two wordings
    n = F.size(cps)
    return F.when(n >= N_CHECKPOINTS, F.lit("all 41 checking points (CP1 through CP41)")).otherwise(
        F.concat(F.lit("these "), n.cast("string"), F.lit(" checking point(s): "), F.array_join(cps, ", ")))
