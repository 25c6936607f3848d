"""Packet flows: keys, gaps, burst structure and per-row features."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import cos, pi, sin, sqrt

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions.draws import unit
from tessera.functions import vectors as V
from tessera.operators.ordered import SLICE_ROWS
from tessera.vocabulary import (AUDIO_LIMIT, BANDS, BURST_GAPS, GROUP_BYTES, LABELS, LENGTHS, N_PACKETS, TIMES)


def lens() -> list[Column]:
    return [F.col(c) for c in LENGTHS]


def times() -> list[Column]:
    return [F.col(c) for c in TIMES]


def gaps() -> list[Column]:
    t = times()
    return [t[i + 1] - t[i] for i in range(N_PACKETS - 1)]


# ---- keys and predicates ---------------------------------------------------------------------

def audio_only(df: DataFrame, out: str = "audio_only") -> DataFrame:
    """Every packet of the window lies below the audio limit."""
    return df.withColumn(out, F.greatest(*lens()) < AUDIO_LIMIT)


def label_parts(df: DataFrame, label: str = "label") -> DataFrame:
    """Split a label at its last underscore."""
    return (df.withColumn("app", F.regexp_extract(label, "^(.*)_([^_]*)$", 1))
            .withColumn("mode", F.regexp_extract(label, "^(.*)_([^_]*)$", 2)))


def label_text(label_id: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in LABELS]), label_id + 1)


def inter_arrival(df: DataFrame) -> DataFrame:
    return df.withColumns({f"iat_{i + 1}": g for i, g in enumerate(gaps())})


def gap_rows(df: DataFrame, *keep: str) -> DataFrame:
    """Long form of the gaps: one row per (flow, gap)."""
    items = F.array(*[F.struct(F.lit(i + 1).alias("gap_index"), g.alias("iat")) for i, g in enumerate(gaps())])
    return df.select(*keep, F.explode(items).alias("g")).select(*keep, "g.*")


def packet_rows(df: DataFrame, *keep: str) -> DataFrame:
    items = F.array(*[F.struct(F.lit(i).alias("packet_index"), c.alias("length")) for i, c in enumerate(lens())])
    return df.select(*keep, F.explode(items).alias("p")).select(*keep, "p.*")


def flow_key(df: DataFrame, tolerance: int = 0, out: str = "lkey") -> DataFrame:
    """Length-tuple key; with a tolerance lengths snap to a grid of twice its size, half to even."""
    step = 2.0 * tolerance
    parts = [F.rint(c / step) * step if tolerance else c for c in lens()]
    return df.withColumn(out, F.array(*parts))


def group_key(df: DataFrame, out: str = "gkey") -> DataFrame:
    """Pseudo-group: lengths to the next 8 bytes, log10 of duration to one decimal, both half to even."""
    sizes = [(F.rint(c / GROUP_BYTES) * GROUP_BYTES).cast("bigint").cast("string") for c in lens()]
    decade = F.rint(F.log10(F.greatest(F.col(TIMES[-1]), F.lit(1e-9))) * 10).cast("bigint").cast("string")
    return df.withColumn(out, F.concat(F.concat_ws("-", *sizes), F.lit("|"), decade))


# ---- sequences -------------------------------------------------------------------------------

def first_packets(packets: DataFrame, key: str, order: Sequence[str], time: str, n: int = N_PACKETS) -> DataFrame:
    """First ``n`` packets per key with time relative to the first one.

    The rank filter is pushed below the shuffle as a group limit, so a hot key ships at most ``n``
    rows per map task.
    """
    w = Window.partitionBy(key).orderBy(*order)
    head = packets.withColumn("packet_index", F.row_number().over(w) - 1).filter(F.col("packet_index") < n)
    start = F.min(time).over(Window.partitionBy(key))
    return head.withColumn("relative_time", F.col(time) - start)


def burst_rows(packets: DataFrame, key: str, index: str, time: str, length: str, thresholds: Sequence[float], rows: int = SLICE_ROWS) -> DataFrame:
    """Packets with the gap before them and, for every threshold, the number of their group and whether they start it.

    A flow is cut into slices of ``rows`` packet numbers, so no flow is ordered in one task.  A slice is summed up as its
    first and last time and its starts; the summaries of a flow, a few rows, give each slice the gap at its border and the
    number of its open group.  Packets without a number come first; equal numbers go by time, then length.
    """
    t = F.col("__at")[time]
    d = packets.select(F.struct(key).alias("__key"), F.struct(index, time, length).alias("__at"), F.coalesce(F.floor(F.col(index) / rows), F.lit(-1)).alias("__slice"))
    d = d.repartition("__key", "__slice")  # one exchange serves the summaries and the rows
    w = Window.partitionBy("__key", "__slice").orderBy("__at")
    starts = lambda gap: F.array(*[F.coalesce(gap >= x, F.lit(False)).cast("long") for x in thresholds])
    d = d.withColumn("gap", t - F.lag(t).over(w)).withColumn("__s", starts(F.col("gap")))
    each = range(len(thresholds))
    parts = d.groupBy("__key", "__slice").agg(F.min("__at").alias("__first"), F.max("__at").alias("__last"), F.array(*[F.sum(F.col("__s")[i]) for i in each]).alias("__n"))
    flow = Window.partitionBy("__key").orderBy("__slice")
    parts = parts.withColumn("__head_gap", F.col("__first")[time] - F.lag(F.col("__last")[time]).over(flow)).withColumn("__head", starts(F.col("__head_gap")))
    earlier = flow.rowsBetween(Window.unboundedPreceding, -1)
    before = F.array(*[F.coalesce(F.sum(F.col("__n")[i] + F.col("__head")[i]).over(earlier), F.lit(0)) + F.col("__head")[i] for i in each])
    parts = parts.select("__key", "__slice", "__head_gap", "__head", before.alias("__before"))
    d = d.withColumn("__leads", F.row_number().over(w) == 1).withColumn("__run", F.array(*[F.sum(F.col("__s")[i]).over(w) for i in each]))
    d = d.join(parts, ["__key", "__slice"])
    return d.select(F.col("__key")[key].alias(key), *[F.col("__at")[x].alias(x) for x in (index, time, length)], F.when(F.col("__leads"), F.col("__head_gap")).otherwise(F.col("gap")).alias("gap"),
                    F.when(F.col("__leads"), F.col("__head")).otherwise(F.col("__s")).alias("starts"), F.zip_with("__run", "__before", lambda r, b: r + b).alias("bursts"))


def burst_table(packets: DataFrame, key: str, index: str, time: str, length: str, thresholds: Sequence[float], rows: int = SLICE_ROWS) -> DataFrame:
    """Burst groups of each flow for several thresholds, long form, any flow length.

    A gap at or above the threshold starts a new group.  Groups that cross slices are added up from their parts.
    """
    d = burst_rows(packets, key, index, time, length, thresholds, rows)
    part = lambda i, x: F.struct(F.lit(x).alias("threshold"), F.col("bursts")[i].alias("burst"), F.when(F.col("starts")[i] == 1, F.col("gap")).alias("split_gap"))
    d = d.select(key, length, F.inline(F.array(*[part(i, x) for i, x in enumerate(thresholds)])))
    bursts = d.groupBy(key, "threshold", "burst").agg(
        F.count(F.lit(1)).alias("packets"), F.sum(length).alias("bytes"), F.sum("split_gap").alias("split_gap"))
    return bursts.groupBy(key, "threshold").agg(
        F.count(F.lit(1)).alias("n_groups"), F.max("packets").alias("group_max_packets"),
        F.max("bytes").alias("group_max_bytes"),
        F.coalesce(F.avg("split_gap"), F.lit(0.0)).alias("group_gap_mean"),
        (F.sum("packets") / F.count(F.lit(1))).alias("packets_per_group"))


def _windows(n: int, k: int) -> list[range]:
    return [range(i, i + k) for i in range(n - k + 1)]


def _all(conds: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds)


def _any(conds: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds)


def longest_run(conds: Sequence[Column]) -> Column:
    """Length of the longest stretch of true values: the widest window that is true throughout."""
    n = len(conds)
    out = F
    for k in range(n, 0, -1):
        out = out.when(_any([_all([conds[i] for i in w]) for w in _windows(n, k)]), F.lit(float(k)))
    return out.otherwise(F.lit(0.0))


def longest_monotone(signs: Sequence[Column]) -> Column:
    """Longest run of steps with one non-zero sign; a zero step counts as a run of one."""
    n = len(signs)
    out = F
    for k in range(n, 1, -1):
        same = [_all([signs[w[0]] != 0] + [signs[i] == signs[w[0]] for i in w[1:]]) for w in _windows(n, k)]
        out = out.when(_any(same), F.lit(float(k)))
    return out.otherwise(F.lit(1.0))


# ---- feature blocks --------------------------------------------------------------------------

def raw_block(df: DataFrame) -> DataFrame:
    cols = {}
    for i in range(N_PACKETS):
        cols |= {f"len_{i}": lens()[i], f"log_len_{i}": F.log1p(lens()[i]),
                 f"t_{i}": times()[i], f"log_t_{i}": F.log1p(times()[i])}
    return df.withColumns(cols)


def arrival_block(df: DataFrame) -> DataFrame:
    d, t = gaps(), times()
    dur = t[-1]
    cols = {}
    for i in range(N_PACKETS - 1):
        cols |= {f"iat_{i + 1}": d[i], f"log_iat_{i + 1}": F.log1p(d[i]),
                 f"iat_frac_{i + 1}": d[i] / (dur + V.EPS), f"tfrac_{i + 1}": t[i + 1] / (dur + V.EPS)}
    df = df.withColumns(cols | {"duration": dur, "log_duration": F.log1p(dur)})
    df = V.summary(df, [F.col(f"iat_{i + 1}") for i in range(4)], "iat")
    return V.summary(df, [F.col(f"log_iat_{i + 1}") for i in range(4)], "logiat")


def length_block(df: DataFrame) -> DataFrame:
    df = V.summary(df, lens(), "len")
    same = lambda i: V.count_true([lens()[j] == lens()[i] for j in range(N_PACKETS)])
    # summing -ln(p) / n over positions equals the entropy of the value counts
    entropy = V.total([-F.log(same(i) / N_PACKETS) / N_PACKETS for i in range(N_PACKETS)]) / F.log(F.lit(float(N_PACKETS)))
    df = df.withColumn("len_n_distinct", V.distinct_count(lens()))
    return df.withColumns({
        "len_all_equal": F.when(F.col("len_n_distinct") == 1, 1.0).otherwise(0.0),
        "len_argmax": V.first_index_of(lens(), F.col("len_max")),
        "len_argmin": V.first_index_of(lens(), F.col("len_min")),
        "len_entropy": entropy})


def shape_block(df: DataFrame) -> DataFrame:
    x = lens()
    cols: dict[str, Column] = {}
    for i in range(N_PACKETS):
        for j in range(i + 1, N_PACKETS):
            cols |= {f"len_diff_{i}{j}": x[j] - x[i], f"len_ratio_{i}{j}": x[j] / (x[i] + V.EPS)}
    steps = [x[i + 1] - x[i] for i in range(N_PACKETS - 1)]
    for i, s in enumerate(steps):
        cols |= {f"len_step_{i + 1}": s, f"len_step_sign_{i + 1}": F.signum(s)}
    cols |= {"len_n_increase": V.count_true([s > 0 for s in steps]),
             "len_n_decrease": V.count_true([s < 0 for s in steps]),
             "len_n_equal_step": V.count_true([s == 0 for s in steps])}
    top = F.greatest(*x)
    for i in range(N_PACKETS):
        cols |= {f"len_over_first_{i}": x[i] / (x[0] + V.EPS), f"len_over_max_{i}": x[i] / (top + V.EPS)}
    slope, r2 = V.linear_fit([F.lit(float(i)) for i in range(N_PACKETS)], x)
    running = [reduce(lambda a, b: a + b, x[:i + 1]) for i in range(N_PACKETS)]
    slope_b, r2_b = V.linear_fit(times(), running)
    cols |= {"len_trend_slope": slope, "len_trend_r2": r2, "bytes_time_slope": slope_b, "bytes_time_r2": r2_b}
    df = df.withColumns(cols)
    return df.withColumn("len_longest_monotone", longest_monotone([F.col(f"len_step_sign_{i}") for i in range(1, N_PACKETS)]))


def protocol_block(df: DataFrame) -> DataFrame:
    x = lens()
    cols: dict[str, Column] = {}
    for name, (lo, hi) in BANDS.items():
        inside = [(c >= lo) & (c < hi) for c in x]
        cols |= {f"n_{name}": V.count_true(inside), f"frac_{name}": V.count_true(inside) / N_PACKETS,
                 f"first_is_{name}": F.when(inside[0], 1.0).otherwise(0.0)}
    constant = reduce(lambda a, b: a & b, [c == x[0] for c in x[1:]])
    cols |= {"n_len47": V.count_true([c == 47 for c in x]),
             "is_constant_keepalive": F.when(constant & (x[0] < 100), 1.0).otherwise(0.0)}
    for m in (4, 8, 16):
        res = [F.pmod(c, F.lit(float(m))) for c in x]
        cols |= {f"len_mod{m}_{i}": r for i, r in enumerate(res)}
        cols |= {f"len_mod{m}_n_zero": V.count_true([r == 0 for r in res]),
                 f"len_mod{m}_n_distinct": V.distinct_count(res)}
    rest = V.mean(x[1:])
    cols |= {"rtp_payload_mean": V.mean([F.greatest(c - 12, F.lit(0.0)) for c in x]),
             "srtp_payload_mean": V.mean([F.greatest(c - 22, F.lit(0.0)) for c in x]),
             "first_vs_rest_diff": x[0] - rest, "first_vs_rest_ratio": x[0] / (rest + V.EPS)}
    return df.withColumns(cols)


def burst_block(df: DataFrame, thresholds: Sequence[float] = BURST_GAPS) -> DataFrame:
    """Burst columns in row form.

    The largest group is the heaviest window of packets joined by short gaps throughout: lengths are
    not negative, so a window inside a group never outweighs the group.
    """
    x, d = lens(), gaps()
    n = len(d)
    for thr in thresholds:
        tag = f"{round(thr * 1e6)}us"
        df = df.withColumns({f"__b{i}": g < thr for i, g in enumerate(d)})
        below = [F.col(f"__b{i}") for i in range(n)]
        joined = [F.when(_all([below[i] for i in range(a, b)]), V.total(x[a:b + 1]))
                  for a in range(N_PACKETS) for b in range(a + 1, N_PACKETS)]
        splits = V.count_true([~b for b in below])
        gap_sum = V.total([F.when(b, F.lit(0.0)).otherwise(g) for b, g in zip(below, d)])
        df = df.withColumns({
            f"n_iat_below_{tag}": V.count_true(below), f"longest_burst_{tag}": longest_run(below) + 1,
            f"n_groups_{tag}": splits + 1, f"group_max_bytes_{tag}": F.greatest(*x, *joined), "__gap_sum": gap_sum})
        groups = F.col(f"n_groups_{tag}")
        df = df.withColumns({
            f"frac_iat_below_{tag}": F.col(f"n_iat_below_{tag}") / n, f"group_max_packets_{tag}": F.col(f"longest_burst_{tag}"),
            f"group_gap_mean_{tag}": F.when(groups > 1, F.col("__gap_sum") / F.greatest(groups - 1, F.lit(1.0))).otherwise(0.0),
            f"packets_per_group_{tag}": N_PACKETS / groups})
        df = df.drop("__gap_sum", *[f"__b{i}" for i in range(n)])
    return df


def rate_block(df: DataFrame) -> DataFrame:
    x, d, dur = lens(), gaps(), times()[-1]
    df = df.withColumn("total_bytes", V.total(x))
    df = df.withColumns({
        "bytes_per_sec": F.col("total_bytes") / (dur + V.EPS), "packets_per_sec": N_PACKETS / (dur + V.EPS),
        "log_bytes_per_sec": F.log1p(F.col("total_bytes") / (dur + V.EPS)),
        **{f"__r{i}": x[i + 1] / (d[i] + V.EPS) for i in range(4)}})
    rates = [F.col(f"__r{i}") for i in range(4)]
    df = V.summary(df, rates, "inst_rate")
    df = V.summary(df, [F.log1p(r) for r in rates], "log_inst_rate")
    return df.drop("__r0", "__r1", "__r2", "__r3")


def dct_weights(n: int) -> list[list[float]]:
    """Orthonormal cosine transform of type two."""
    return [[(sqrt(1 / n) if k == 0 else sqrt(2 / n)) * cos(pi * (2 * i + 1) * k / (2 * n)) for i in range(n)]
            for k in range(n)]


def spectral_block(df: DataFrame) -> DataFrame:
    x, g = lens(), [F.log1p(d) for d in gaps()]
    dot = lambda w, v: V.total([c * F.lit(a) for a, c in zip(w, v)])
    cols = {f"len_dct_{k}": dot(w, x) for k, w in enumerate(dct_weights(5))}
    cols |= {f"logiat_dct_{k}": dot(w, g) for k, w in enumerate(dct_weights(4))}
    for k in range(3):
        re = dot([cos(2 * pi * k * i / 5) for i in range(5)], x)
        im = dot([sin(2 * pi * k * i / 5) for i in range(5)], x)
        cols[f"len_fftmag_{k}"] = F.sqrt(re * re + im * im)
    return df.withColumns(cols)


BLOCKS = [raw_block, arrival_block, length_block, shape_block, protocol_block, burst_block, rate_block, spectral_block]


def feature_frame(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """All eight blocks as one wide FLOAT frame; no shuffle, NaN and infinities become 0."""
    wide = reduce(lambda d, block: block(d), BLOCKS, df)
    base = set(df.columns)
    names = [c for c in wide.columns if c not in base]
    return wide.select(*keep, *[V.clean(F.col(c)).cast("float").alias(c) for c in names])


def compact_features(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The 31-column set of the shipped model."""
    x, t, d = lens(), times(), gaps()
    ascending = F.array_sort(F.array(*x))
    steps = [x[i + 1] - x[i] for i in range(N_PACKETS - 1)]
    mu = V.mean(x)
    top, low = F.greatest(*x), F.least(*x)
    cols = [F.col(c) for c in LENGTHS + TIMES[1:]]
    cols += [s.alias(f"delta_len_{i + 1}") for i, s in enumerate(steps)]
    cols += [g.alias(f"delta_t_{i + 1}") for i, g in enumerate(d)]
    cols += [F.element_at(ascending, N_PACKETS - r).alias(f"len_rank_{r}") for r in range(N_PACKETS)]
    cols += [V.first_index_of(x, top).alias("argmax_pos"), V.first_index_of(x, low).alias("argmin_pos"),
             (top - low).alias("len_range"), mu.alias("len_mean"),
             F.sqrt(V.central_moment(x, mu, 2)).alias("len_std"), F.element_at(ascending, 3).alias("len_median"),
             (t[-1] - t[0]).alias("total_span"), F.log(F.greatest(x[3], F.lit(1.0))).alias("gp_log_pl3"),
             (V.first_index_of(steps, F.greatest(*steps)) + 1).alias("jump_pos")]
    return df.select(*keep, *cols)


def rank_lengths(df: DataFrame, *keep: str) -> DataFrame:
    ascending = F.array_sort(F.array(*lens()))
    return df.select(*keep, *[F.element_at(ascending, N_PACKETS - r).alias(f"len_rank_{r}") for r in range(N_PACKETS)])


def position_shares(df: DataFrame, *keep: str) -> DataFrame:
    """Per packet: its gap and its time as shares of the span, and its share of all bytes."""
    t, x = times(), lens()
    span = F.greatest(t[-1], F.lit(1e-9))
    rows = [F.struct(F.lit(i).alias("packet_index"), (t[i] / span).alias("time_share"),
                     ((t[i] - t[i - 1]) / span if i else F.lit(0.0)).alias("gap_share"),
                     F.try_divide(x[i], V.total(x)).alias("byte_share")) for i in range(N_PACKETS)]
    return df.select(*keep, F.explode(F.array(*rows)).alias("r")).select(*keep, "r.*")


def size_edges(n: int = 24, lo: float = 20.0, hi: float = 1400.0) -> list[int]:
    """Geometric size-bin edges, rounded half to even, duplicates merged."""
    return sorted({round(lo * (hi / lo) ** (i / (n - 1))) for i in range(n)})


def packet_descriptors(df: DataFrame, *keep: str) -> DataFrame:
    """Eight descriptors and the size bin of every packet."""
    t, x = times(), lens()
    span = F.greatest(t[-1], F.lit(1e-9))
    edges = F.array(*[F.lit(float(e)) for e in size_edges()])
    rows = []
    for i in range(N_PACKETS):
        gap = t[i] - t[i - 1] if i else F.lit(0.0)
        flag = lambda c: F.when(c, 1.0).otherwise(0.0)
        rows.append(F.struct(
            F.lit(i).alias("packet_index"), (F.log1p(x[i]) / 7.5).alias("log_len"), (x[i] / 1500.0).alias("rel_len"),
            F.log1p(gap * 1e3).alias("log_gap_ms"), (t[i] / span).alias("time_share"), (gap / span).alias("gap_share"),
            flag(gap < 1e-3).alias("sub_ms"), flag(x[i] >= 1100).alias("is_mtu"), flag(x[i] < 100).alias("is_small"),
            x[i].alias("__len")))
    out = df.select(*keep, F.explode(F.array(*rows)).alias("r")).select(*keep, "r.*")
    return out.withColumn("size_bin", F.size(F.filter(edges, lambda e: e <= F.col("__len")))).drop("__len")


def jitter(df: DataFrame, seed: int, *keep: str) -> DataFrame:
    """Transport jitter: gaps scaled by 0.9..1.1, lengths moved by at most 2 bytes, random packet drop.

    Every draw is a hash of (row, seed, draw number): a retried task gives the same rows.
    """
    draw = lambda n: unit(seed * 1000 + n, *keep)
    x, d = lens(), gaps()
    acc: Column = F.lit(0.0)
    rows = []
    for i in range(N_PACKETS):
        if i:
            acc = acc + d[i - 1] * (0.9 + 0.2 * draw(10 + i))
        shift = F.floor(draw(20 + i) * 5) - 2
        rows.append(F.struct(F.lit(i).alias("packet_index"), acc.alias("relative_time"),
                             F.greatest(x[i] + shift, F.lit(1.0)).alias("length"),
                             (draw(30 + i) >= 0.1).alias("kept")))
    return df.select(*keep, F.explode(F.array(*rows)).alias("r")).select(*keep, "r.*")


def auxiliary_targets(df: DataFrame, lengths: str, gaps_col: str, *keep: str) -> DataFrame:
    """Targets computed from the flow itself, for padded arrays of any length."""
    x, g = F.col(lengths), F.col(gaps_col)
    n = F.size(x).cast("double")
    add = lambda arr: F.aggregate(arr, F.lit(0.0), lambda a, b: a + b)
    share = lambda arr, f, m: F.size(F.filter(arr, f)).cast("double") / m
    rest = F.slice(g, F.lit(2), F.size(g) - 1)
    span = F.greatest(add(g), F.lit(1e-9))
    div = lambda m: share(x, lambda v: v % m == 0, n)
    df = df.withColumns({"__mtu": share(x, lambda v: v >= 1100, n), "__sub": share(rest, lambda v: v < 1e-3, n - 1),
                         **{f"__d{m}": div(m) for m in (2, 4, 8, 16)}})
    shares = [F.col(f"__d{m}") for m in (2, 4, 8, 16)]
    return df.select(
        *keep, F.log1p(add(x) / span).alias("log_bitrate"), F.log1p(add(rest) / (n - 1) * 1e3).alias("log_mean_gap"),
        F.col("__mtu").alias("frac_mtu"),
        F.when((F.col("__mtu") > 0.2) & (F.col("__sub") > 0.4), 1).otherwise(0).alias("video_like"),
        V.first_index_of(shares, F.greatest(*shares)).cast("int").alias("padding_class"),
        V.count_true([s >= 0.8 for s in shares]).cast("int").alias("alignment_level"))
