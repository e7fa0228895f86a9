"""Implausible measurements, relative to what their source normally gives.

Model: the base-10 logarithm of a measurement is a level that wanders slowly
plus noise, one such state-space model per source, filtered by a Kalman filter
in time order.

* A source's prior comes from the whole table: the group's middle value plus
  the member's usual shift against its groups, drawn to the source's own middle
  value as its rows grow.  A source with few rows is thus judged by its like.
  Its noise is that of the side of its middle that spreads less.
* The innovation, standardised by its own variance (of the level and of the
  noise), decides: beyond the threshold a measurement is a spike and withheld
  from the filter, so that spikes do not move the level.  A least ratio keeps
  deviations out that are many deviations of a very regular source, but small.
  Other innovations count up to three standard deviations.
* Values that make up a regular share of a source are regimes of their own: an
  observation near one is normal, but only those nearest to the level move it.
* The variance of the latest innovations, all against one level, is compared
  with the variance that the filter expects.  Where it vanishes the source is
  stuck; that is flagged unless the source usually repeats values.

Scale: the profile is a histogram per source, combined before the shuffle.  The
filter runs over a range layout by (group, member, time), which splits a source
of any size.  Each partition holds back its first rows, and a second pass
filters them behind the last rows before them, from as many partitions as it
takes, which is enough for the filter to forget its start.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.plans.ranges import key_runs, range_sorted, walk
from weftline.plans.shape import cut, within

BIN = 0.05  # decades, of the profile's histogram
PRIOR_ROWS = 30.0  # rows that the prior level counts as
REGIME_NEAR_TENTHS = 2  # tenths of a decade on either side that count towards a regime
REGIME_SHARE = 0.06  # least share of a regime and its neighbourhood; a quarter of it must lie at its very place
REGIME_WIDTH = 0.5  # decades around a regime that it explains
DRIFT = 0.002  # variance of the level's step
START_VARIANCE = 0.01
MOST_VARIANCE = 0.02  # of the level, while measurements are withheld
NOISE = (0.02, 2.0)  # bounds of the observation's standard deviation
VANISHED = 1e-25  # innovation variance of a stuck source, against that expected: below any two measurements that differ
USUAL_REPEATS = 0.05  # share of repeated neighbours above which a source repeats
EDGE = 64  # rows held back at each side of a partition's edge
PRIORS = 50_000  # sources whose priors are sent to the tasks; with more they come along with the rows

_OUT = pa.schema(
    [("kind", pa.int32()), ("grp", pa.int64()), ("member", pa.int64()), ("id", pa.int64()), ("t", pa.int64()), ("d", pa.int64()),
     ("part", pa.int64()), ("back", pa.int64()), ("level0", pa.float64()), ("noise", pa.float64()), ("regimes", pa.list_(pa.float64())), ("pairs", pa.int64()), ("equal", pa.int64())]
)
_DDL = "kind int, grp bigint, member bigint, id bigint, t bigint, d bigint, part bigint, back bigint, level0 double, noise double, regimes array<double>, pairs bigint, equal bigint"
#: What a row of the walk's output is.
SPIKE, STUCK, HEAD, TAIL, SOURCE = range(5)


class SourceFilter:
    """Kalman filter of one source, fed in time order."""

    def __init__(self, level0: float, noise: float, regimes: list[float], threshold: float, least: float, run: int):
        self.level, self.variance = level0, START_VARIANCE
        self.r = noise * noise
        self.regimes = regimes
        self.threshold, self.least, self.run = threshold, least, run
        self.last: tuple[int, int] | None = None
        self.recent = (np.zeros(0, np.int64), np.zeros(0))  # ids and values, as far back as a window reaches
        self.value: int | None = None  # of the current run of equal measurements
        self.length = self.pairs = self.equal = self.rows = 0

    def feed(self, ids: np.ndarray, ts: np.ndarray, ds: np.ndarray) -> tuple[list[int], list[int]]:
        """Positions of spikes, and ids of rows whose innovations have no variance."""
        new = np.ones(len(ids), bool)  # the same record once more counts once
        new[1:] = (ts[1:] != ts[:-1]) | (ids[1:] != ids[:-1])
        new[0] = self.last != (int(ts[0]), int(ids[0]))
        at = np.flatnonzero(new)
        self.last = (int(ts[-1]), int(ids[-1]))
        if not len(at):
            return [], []
        ds, ids = ds[at], ids[at]
        self.rows += len(at)
        xs = np.log10(ds)
        self._repeats(ds)
        spikes = [int(at[i]) for i in self._filter(xs.tolist())]
        return spikes, self._vanished(ids, xs)

    def _filter(self, xs: list[float]) -> list[int]:
        spikes: list[int] = []
        level, variance, r, least, threshold, regimes = self.level, self.variance, self.r, self.least, self.threshold, self.regimes
        own = min((abs(o) for o in regimes), default=2 * least) / 2
        for i, x in enumerate(xs):
            variance = min(variance + DRIFT, MOST_VARIANCE)
            v = x - level
            expected = variance + r
            if v * v > threshold * threshold * expected and (v >= least or v <= -least):
                if not any(-REGIME_WIDTH < v - o < REGIME_WIDTH for o in regimes):
                    spikes.append(i)
                continue
            if v >= own or v <= -own:  # of another regime rather than of the level
                continue
            spread = 3 * math.sqrt(expected)
            gain = variance / expected
            level += gain * max(-spread, min(spread, v))
            variance *= 1 - gain
        self.level, self.variance = level, variance
        return spikes

    def _vanished(self, ids: np.ndarray, xs: np.ndarray) -> list[int]:
        """Rows of windows of ``run`` measurements whose innovations, against one level, do not vary."""
        ids, xs = np.concatenate([self.recent[0], ids]), np.concatenate([self.recent[1], xs])
        self.recent = (ids[-(self.run - 1) :], xs[-(self.run - 1) :]) if self.run > 1 else self.recent
        if len(xs) < self.run:
            return []
        varies = np.lib.stride_tricks.sliding_window_view(xs - self.level, self.run).var(axis=1)
        still = np.flatnonzero(varies <= VANISHED * (self.variance + self.r))
        return ids[np.unique(still[:, None] + np.arange(self.run))].tolist()

    def _repeats(self, ds: np.ndarray) -> None:
        """Counts neighbours that are equal, but for those of long runs, which tell nothing of the usual."""
        lengths = np.diff(np.concatenate([[0], np.flatnonzero(ds[1:] != ds[:-1]) + 1, [len(ds)]]))
        if self.value == int(ds[0]):
            lengths[0] += self.length
        elif self.value is not None:
            lengths = np.concatenate([[self.length], lengths])
        closed = lengths[:-1]
        inner = int((closed[closed < self.run] - 1).sum())
        self.pairs += len(closed) + inner
        self.equal += inner
        self.value, self.length = int(ds[-1]), int(lengths[-1])

    def repeats(self) -> tuple[int, int]:
        inner = self.length - 1 if 0 < self.length < self.run else 0
        return self.pairs + inner, self.equal + inner


def profiles(rows: DataFrame, grp: str = "grp", member: str = "member", d: str = "d") -> DataFrame:
    """Prior level, noise and regimes of each source, from all rows.

    ``d`` must be positive.  Built from histograms per source, so what is
    shuffled does not grow with a source's rows.
    """
    hist = cut(
        rows.select(F.col(grp).alias("grp"), F.col(member).alias("member"), F.floor(F.log10(F.col(d).cast("double")) / BIN).alias("b"))
        .groupBy("grp", "member", "b")
        .agg(F.count(F.lit(1)).alias("c"))
        .withColumn("x", (F.col("b") + 0.5) * BIN)
    )
    mid = lambda p: F.percentile("x", F.lit(p), F.col("c"))
    source = cut(hist.groupBy("grp", "member").agg(mid(0.5).alias("m"), mid(0.16).alias("lo"), mid(0.84).alias("hi"), F.sum("c").alias("n")))
    group = hist.groupBy("grp").agg(mid(0.5).alias("gm"))
    source = source.join(group, "grp")
    shift = source.where(F.col("n") >= 20).groupBy("member").agg(F.percentile(F.col("m") - F.col("gm"), F.lit(0.5)).alias("shift"))
    source = cut(source.join(shift, "member", "left").select(
        "grp", "member", "n",
        ((F.col("m") * F.col("n") + (F.col("gm") + F.coalesce("shift", F.lit(0.0))) * PRIOR_ROWS) / (F.col("n") + PRIOR_ROWS)).alias("level0"),
        F.greatest(F.lit(NOISE[0]), F.least(F.lit(NOISE[1]), F.col("hi") - F.col("m"), F.col("m") - F.col("lo"))).alias("noise"),  # a regime widens one side
    ))
    # Regimes: places at some distance from the level where the source, or for want of rows its group, has a regular share.
    y = F.round((F.col("x") - F.col("level0")) * 10).cast("int")  # in tenths of a decade
    near = F.transform(F.sequence(F.lit(-REGIME_NEAR_TENTHS), F.lit(REGIME_NEAR_TENTHS)), lambda k: F.struct((y + k).alias("y"), F.when(k == 0, F.col("c")).otherwise(0).alias("own")))
    local = cut(hist.join(source, ["grp", "member"]).select("grp", "member", "n", "c", F.explode(near).alias("at")).groupBy("grp", "member", "n", "at.y").agg(F.sum("c").alias("c"), F.sum("at.own").alias("own")))
    of_group = local.groupBy("grp", "y").agg(F.sum("c").alias("gc"), F.sum("own").alias("gown")).join(source.groupBy("grp").agg(F.sum("n").alias("gn")), "grp")
    of_group = of_group.select("grp", "y", (F.col("gc") / F.col("gn")).alias("p"), (F.col("gown") / F.col("gn")).alias("pown"))
    share = lambda c, p: (F.col(c) + F.coalesce(p, F.lit(0.0)) * PRIOR_ROWS) / (F.col("n") + PRIOR_ROWS)
    none = F.lit(0).cast("bigint")
    everywhere = source.select("grp", "member", "n").join(of_group.where(F.col("p") >= REGIME_SHARE / 2), "grp").select("grp", "member", "n", "y", none.alias("c"), none.alias("own"))
    regimes = (
        local.select("grp", "member", "n", "y", "c", "own").unionByName(everywhere)
        .where(F.abs("y") >= 6)
        .groupBy("grp", "member", "n", "y")
        .agg(F.sum("c").alias("c"), F.sum("own").alias("own"))
        .join(of_group, ["grp", "y"], "left")
        .where((share("c", "p") >= REGIME_SHARE) & (share("own", "pown") >= REGIME_SHARE / 4))
        .groupBy("grp", "member")
        .agg(F.array_sort(F.collect_set(F.col("y") / 10.0)).alias("regimes"))
    )
    return source.join(regimes, ["grp", "member"], "left").select("grp", "member", "level0", "noise", F.coalesce("regimes", F.array().cast("array<double>")).alias("regimes"))


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_OUT)


def _walk(threshold: float, least: float, run: int, priors: Mapping[tuple[int, int], tuple] | None):
    def prior_of(key: tuple[int, int], batch: pa.RecordBatch, row: int) -> dict:
        got = priors.value[key] if priors is not None else [batch.column(c)[row].as_py() for c in ("level0", "noise", "regimes")]
        return dict(zip(("level0", "noise", "regimes"), got, strict=True))

    def step(partition: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: SourceFilter | None = None
        key: tuple[int, int] | None = None
        first = None
        head = 0
        tail: deque = deque(maxlen=EDGE)
        prior: dict = {}

        def finish() -> dict:
            pairs, equal = now.repeats()
            return {"kind": SOURCE, "grp": key[0], "member": key[1], "part": partition, "back": now.rows, "pairs": pairs, "equal": equal}

        for batch in batches:
            grp, member, ids, ts, ds = (batch.column(c).to_numpy() for c in ("grp", "member", "id", "t", "d"))
            out: list[dict] = []
            for a, b in key_runs([grp, member]):
                here = (int(grp[a]), int(member[a]))
                if here != key:
                    if now is not None:
                        out.append(finish())
                    key = here
                    if first is None:
                        first = key
                    prior = prior_of(key, batch, a)
                    now = SourceFilter(**prior, threshold=threshold, least=least, run=run)
                    tail.clear()
                spikes, stuck = now.feed(ids[a:b], ts[a:b], ds[a:b])
                i, t, d = ids[a:b], ts[a:b], ds[a:b]
                cold = 0
                if key == first and head < EDGE:
                    cold = min(EDGE - head, b - a)
                    head += cold
                    out += [{"kind": HEAD, "grp": key[0], "member": key[1], "id": int(i[j]), "t": int(t[j]), "d": int(d[j]), "part": partition, **prior} for j in range(cold)]
                out += [{"kind": SPIKE, "grp": key[0], "member": key[1], "id": int(i[j])} for j in spikes if j >= cold]
                out += [{"kind": STUCK, "grp": key[0], "member": key[1], "id": k} for k in stuck]
                tail.extend(zip(i[-EDGE:].tolist(), t[-EDGE:].tolist(), d[-EDGE:].tolist(), strict=True))
            if out:
                yield _batch(out)
        if now is not None:
            ends = [{"kind": TAIL, "grp": key[0], "member": key[1], "id": i, "t": t, "d": d, "part": partition, "back": len(tail) - 1 - j, **prior} for j, (i, t, d) in enumerate(tail)]
            yield _batch([finish(), *ends])

    return step


def _reach(parts: pd.DataFrame) -> pd.DataFrame:
    """(grp, member, part, edge, between): the partitions behind whose rows a partition's first rows come, and how many rows lie between."""
    parts = parts.sort_values("part")
    number, rows = parts["part"].tolist(), parts["back"].tolist()
    out = []
    for k in range(1, len(number)):
        between, j = 0, k - 1
        while j >= 0 and between < EDGE:
            out.append((number[j], number[k], between))
            between += rows[j]
            j -= 1
    got = pd.DataFrame(out, columns=["part", "edge", "between"]).astype("int64")
    return got.assign(grp=parts["grp"].iloc[0], member=parts["member"].iloc[0])[["grp", "member", "part", "edge", "between"]]


def _stitch(threshold: float, least: float, run: int):
    def step(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["t", "id", "kind"])
        one = rows.iloc[0]
        source = SourceFilter(one.level0, one.noise, list(one.regimes), threshold, least, run)
        ids, head = rows["id"].tolist(), (rows["kind"] == HEAD).tolist()
        spikes, stuck = source.feed(*(rows[c].to_numpy(np.int64) for c in ("id", "t", "d")))
        found = [(SPIKE, ids[j]) for j in spikes if head[j]] + [(STUCK, k) for k in stuck]
        return pd.DataFrame({"kind": [k for k, _ in found], "grp": one.grp, "member": one.member, "id": [i for _, i in found]}).astype({"kind": "int32", "id": "int64", "grp": "int64", "member": "int64"})

    return step


def spikes(
    rows: DataFrame, group: str, member: str, row_id: str, start: str, end: str,
    *, latest: int | None = None, least_ratio: float = 5.0, threshold: float = 4.5, run: int = 6, partitions: int | None = None,
) -> DataFrame:
    """Implausible ends: (group, member, row_id, reason).

    A source is a (group, member) pair, the measurement is ``end - start``.
    reason is 'impossible' (end at or before start, or after ``latest``),
    'spike' (a standardised innovation beyond ``threshold``, and at least
    ``least_ratio`` times above or below the filter's level) or 'stuck' (in a
    window of ``run`` measurements whose innovation variance vanishes, of a
    source that does not usually repeat).

    Rows with a NULL end are no measurements.  Rows with a NULL in another of
    the named columns belong to no source; only 'impossible' ends are reported
    of them.  Repeated rows (same source, start and row_id) count once.  Ties in
    start are ordered by row_id.  An empty table gives no rows.  Other columns
    are not read.
    """
    base = rows.select(
        F.col(group).cast("bigint").alias("grp"), F.col(member).cast("bigint").alias("member"), F.col(row_id).cast("bigint").alias("id"),
        F.col(start).cast("bigint").alias("t"), F.col(end).cast("bigint").alias("e"),
    ).where(F.col("e").isNotNull())
    bad = F.col("e") <= F.col("t")
    if latest is not None:
        bad = bad | (F.col("e") > F.lit(latest))
    bad = F.coalesce(bad, F.lit(latest is not None) & (F.col("e") > F.lit(latest)), F.lit(False))
    impossible = base.where(bad).select("grp", "member", "id", F.lit("impossible").alias("reason"))
    valid = base.where(~bad).dropna().select("grp", "member", "id", "t", (F.col("e") - F.col("t")).alias("d"))

    least = math.log10(least_ratio)
    prior = cut(profiles(valid))
    sent = None
    if within(prior, PRIORS):  # a bounded number of sources: their priors go to the tasks, and not with every row
        known = {(r.grp, r.member): (r.level0, r.noise, list(r.regimes)) for r in prior.toLocalIterator()}
        sent = rows.sparkSession.sparkContext.broadcast(known)
    laid = range_sorted(valid if sent else valid.join(prior, ["grp", "member"]), ["grp", "member"], ["t", "id"], partitions)
    walked = cut(walk(laid, _walk(threshold, least, run, sent), _DDL))
    # The edges: a handful of rows per partition, grouped by the edge they meet at.  A source has a row of its own for each partition that holds it.
    parts = walked.where(F.col("kind") == SOURCE).select("grp", "member", "part", "back")
    parts = parts.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("grp", "member"))).where(F.col("n") > 1).drop("n")  # those that a partition's edge divides
    reach = parts.groupBy("grp", "member").applyInPandas(_reach, "grp bigint, member bigint, part bigint, edge bigint, between bigint")
    tails = walked.where(F.col("kind") == TAIL).join(reach, ["grp", "member", "part"]).where(F.col("back") + F.col("between") < EDGE).drop("between")
    heads = walked.where(F.col("kind") == HEAD).withColumn("edge", F.col("part"))
    edges = tails.unionByName(heads).groupBy("grp", "member", "edge").applyInPandas(_stitch(threshold, least, run), "kind int, grp bigint, member bigint, id bigint")
    found = walked.where(F.col("kind").isin(SPIKE, STUCK)).select("kind", "grp", "member", "id").unionByName(edges)
    of_source = walked.where(F.col("kind") == SOURCE).groupBy("grp", "member").agg(F.sum("pairs").alias("pairs"), F.sum("equal").alias("equal"))
    of_group = of_source.groupBy("grp").agg((F.sum("equal") / F.greatest(F.sum("pairs"), F.lit(1))).alias("rate"))
    usual = of_source.join(of_group, "grp").where((F.col("equal") + F.col("rate") * PRIOR_ROWS) / (F.col("pairs") + PRIOR_ROWS) > USUAL_REPEATS).select("grp", "member")
    spiked = found.where(F.col("kind") == SPIKE).select("grp", "member", "id", F.lit("spike").alias("reason"))
    stuck = found.where(F.col("kind") == STUCK).join(usual, ["grp", "member"], "left_anti").select("grp", "member", "id", F.lit("stuck").alias("reason"))
    return (
        impossible.unionByName(spiked).unionByName(stuck).distinct()
        .select(F.col("grp").alias(group), F.col("member").alias(member), F.col("id").alias(row_id), "reason")
    )
