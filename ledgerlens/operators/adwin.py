"""ADWIN change detection over ordered score streams (Bifet and Gavalda, 2007).

The smallest bucket of the exponential histogram is one score; the window is checked for a
cut every 32 scores, the usual interval of the detector.

Cuts follow one from another, but between two cuts the sizes of the buckets depend only on how
many scores came in, not on the scores. So the scores of a model are dealt out in chunks, and
all chunks are walked at once, each from the state it has if no chunk before it cuts: sizes by
counting, contents by prefix sums. Up to the first chunk that cuts, these walks were right;
behind it the next round starts from that chunk's true end. A model without changes takes one
round over many tasks, and rounds never outnumber the chunks with changes by more than one. A
chunk's walk takes constant memory beside its scores. Within a chunk the walk is the same as one over
all scores; buckets at a chunk's start can differ from it by rounding.

A walk can start from a stored state, so a detector may be primed, and the stream operator goes
on where its last trigger ended: batch and stream agree score for score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.errors import DataContractError
from ledgerlens.operators import drift
from ledgerlens.operators.ranking import numbered
from ledgerlens.operators.review import fold_rows
from ledgerlens.session import materialise

DELTA = 0.002
BLOCK = 32
BUCKETS_PER_LEVEL = 5
#: Scores of a chunk, which one task walks at once.
CHUNK = 32_768
REPLAY_LIMIT = 1000


@dataclass
class Detector:
    """Window of buckets, newest first; a bucket is (count, mean, squared deviation)."""

    delta: float = DELTA
    buckets: list[tuple[int, float, float]] = field(default_factory=list)
    observed: int = 0
    detections: int = 0
    changed: bool = False

    def __post_init__(self) -> None:
        if not 0 < self.delta < 1:
            raise DataContractError("delta must lie in (0, 1)")

    @property
    def width(self) -> int:
        return sum(n for n, _, _ in self.buckets)

    @property
    def mean(self) -> float | None:
        width = self.width
        return sum(n * mean for n, mean, _ in self.buckets) / width if width else None

    def add(self, score: float) -> bool:
        """Take one score; True when older data no longer fits the newer."""
        self.buckets.insert(0, (1, score, 0.0))
        self._compress()
        self.observed += 1
        self.changed = False
        if self.observed % BLOCK == 0:
            while self._cut():
                self.buckets.pop()
                self.changed = True
        self.detections += self.changed
        return self.changed

    def _compress(self) -> None:
        """Merge the two oldest of a size once a size has more than five buckets."""
        start = 0
        while start < len(self.buckets):
            size = self.buckets[start][0]
            end = start
            while end < len(self.buckets) and self.buckets[end][0] == size:
                end += 1
            if end - start <= BUCKETS_PER_LEVEL:
                start = end
                continue
            self.buckets[end - 2: end] = [_merge(self.buckets[end - 2], self.buckets[end - 1])]
            start = end - 2

    def _cut(self) -> bool:
        """Whether some split into older and newer buckets differs significantly."""
        if len(self.buckets) < 2:
            return False
        total = self.buckets[0]
        for bucket in self.buckets[1:]:
            total = _merge(total, bucket)
        width, mean, squares = total
        variance = squares / width
        log_term = math.log(2.0 * math.log(width) / self.delta)
        newer_n, newer_sum = 0, 0.0
        for n, bucket_mean, _ in self.buckets[:-1]:
            newer_n += n
            newer_sum += n * bucket_mean
            older_n = width - newer_n
            older_mean = (width * mean - newer_sum) / older_n
            inverse = 1.0 / newer_n + 1.0 / older_n
            bound = math.sqrt(2.0 * inverse * variance * log_term) + 2.0 / 3.0 * inverse * log_term
            if abs(newer_sum / newer_n - older_mean) > bound:
                return True
        return False

    def to_arrays(self) -> tuple[list[int], list[float], list[float]]:
        return (
            [b[0] for b in self.buckets], [b[1] for b in self.buckets],
            [b[2] for b in self.buckets],
        )


def _merge(a: tuple[int, float, float], b: tuple[int, float, float]) -> tuple[int, float, float]:
    n = a[0] + b[0]
    gap = b[1] - a[1]
    mean = a[1] + gap * b[0] / n
    return n, mean, a[2] + b[2] + gap * gap * a[0] * b[0] / n


def valid_scores(df: DataFrame, score: str = "score") -> DataFrame:
    value = F.col(score).cast("double")
    return df.filter(value.isNotNull() & ~F.isnan(value) & value.between(0.0, 1.0))


def sizes_after(sizes: Sequence[int], added: int) -> list[int]:
    """Sizes of the buckets, newest first, after so many more scores without a cut.

    A level that takes in buckets one by one merges two of them each time it would hold
    more than ``BUCKETS_PER_LEVEL``; each merge is one bucket for the level above."""
    found, size, held, coming = [], 1, list(sizes), added
    while held or coming:
        here = sum(n == size for n in held)
        held = [n for n in held if n != size]
        merges = max(0, -(-(here + coming - BUCKETS_PER_LEVEL) // 2)) if coming else 0
        found += [size] * (here + coming - 2 * merges)
        size, coming = 2 * size, merges
    return found


def chunked(
    scores: DataFrame, key: str, order: Sequence[str], score: str = "score", chunk: int = CHUNK,
) -> DataFrame:
    """(key, chunk, scores, ats, ahead, ahead_squares): a chunk's scores and times in order, and
    sums over all chunks before it, of scores less one half."""
    placed = numbered(
        scores.select(key, *order, F.col(score).cast("double").alias("score")), [key], order)
    entry = F.struct("position", "score", F.col(order[0]).cast("timestamp").alias("at"))
    def total(term):
        return F.aggregate(F.transform("scores", term), F.lit(0.0), lambda a, x: a + x)

    packed = placed.groupBy(key, F.floor((F.col("position") - 1) / chunk).alias("chunk")).agg(
        F.sort_array(F.collect_list(entry)).alias("entries")).select(
        key, "chunk", F.col("entries.score").alias("scores"), F.col("entries.at").alias("ats"))
    packed = materialise(packed.withColumns({
        "own": total(lambda x: x - 0.5),
        "own_squares": total(lambda x: (x - 0.5) * (x - 0.5))}), "chunks")
    before = W.partitionBy("_key").orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    sums = packed.select(F.col(key).alias("_key"), F.col("chunk").alias("_chunk"),
                         "own", "own_squares").select("_key", "_chunk", *[
        F.coalesce(F.sum(of).over(before), F.lit(0.0)).alias(name)
        for name, of in (("ahead", "own"), ("ahead_squares", "own_squares"))])
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("chunk") == F.col("_chunk"))
    return packed.drop("own", "own_squares").join(sums, same).drop("_key", "_chunk")


STATE_COLUMNS = (
    "score_stream_count bigint, latest_score double, window_width bigint, window_mean double, "
    "detections bigint, last_change_at bigint, adwin_change_detected boolean, "
    "bucket_counts array<bigint>, bucket_means array<double>, bucket_squares array<double>"
)
STATE = [c.split()[0] for c in STATE_COLUMNS.split(", ")]


EVENTS = f"{STATE_COLUMNS}, at timestamp, fresh bigint, final boolean"


def walk(
    scores: DataFrame, key: str = "model_version",
    order: Sequence[str] = ("created_at", "prediction_id"), *, score: str = "score",
    delta: float = DELTA, initial: DataFrame | None = None, chunk: int = CHUNK,
) -> DataFrame:
    """(key, state..., at, fresh, final): the detector's state at each detected change and,
    marked ``final``, after all scores of a key; ``fresh`` counts the scores taken here.

    ``initial`` has states to start from, as this function returns them."""
    Detector(delta)
    chunks = chunked(valid_scores(scores, score), key, order, score, chunk)
    kind = chunks.schema[key].dataType.simpleString()
    empty = chunks.sparkSession.createDataFrame([], f"`{key}` {kind}, {STATE_COLUMNS}")
    stored = empty if initial is None else initial.select(F.col(key).cast(kind).alias(key), *STATE)
    keys = chunks.groupBy(key).agg(F.max("chunk").alias("last_chunk"))
    states = keys.join(stored, keys[key].eqNullSafe(stored[key]), "left").select(
        keys[key], F.lit(0).cast("long").alias("from_chunk"), "last_chunk", *STATE)
    rounds = []
    while True:
        tried = materialise(_round(chunks, states, key, kind, delta, chunk), "walked")
        cuts = tried.filter("NOT end").groupBy(key).agg(F.min("chunk").alias("first_cut"))
        valid = tried.join(cuts.withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(
            F.col("_key")), "left").drop("_key").filter("first_cut IS NULL OR chunk <= first_cut")
        rounds.append(valid.filter("NOT end OR chunk = last_chunk").withColumn(
            "final", F.col("end")).select(key, *STATE, "at", "fresh", "final"))
        left = valid.filter("end AND chunk = first_cut AND chunk < last_chunk")
        if left.isEmpty():
            break
        states = left.select(key, (F.col("chunk") + 1).alias("from_chunk"), "last_chunk", *STATE)
    idle = stored.join(keys.select(F.col(key).alias("_key")), stored[key].eqNullSafe(
        F.col("_key")), "left_anti").select(
        key, *STATE, F.lit(None).cast("timestamp").alias("at"),
        F.lit(0).cast("long").alias("fresh"), F.lit(True).alias("final"))
    result = idle
    for found in rounds:
        result = result.unionByName(found)
    return result


def _round(chunks: DataFrame, states: DataFrame, key: str, kind: str, delta: float,
           chunk: int) -> DataFrame:
    """All chunks from the states on, walked as if none before them cut: their changes, and
    one row (``end``) for the state after each."""
    ours = states.withColumnRenamed(key, "_key")
    begun = chunks.select(F.col(key), F.col("chunk"), F.col("scores"), "ats", "ahead",
                          "ahead_squares").join(
        ours, F.col(key).eqNullSafe(F.col("_key"))).drop("_key").filter("chunk >= from_chunk")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.to_dict("records"):
                for place in _open_bounds(row, chunk):
                    rows.append((row[key], row["chunk"], place, place // chunk))
            yield pd.DataFrame(rows, columns=[key, "chunk", "place", "of"])

    asked = begun.select(key, "chunk", "from_chunk", "bucket_counts").mapInPandas(
        ask, f"`{key}` {kind}, chunk bigint, place bigint, of bigint")

    def answer(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or held.empty:
            return pd.DataFrame([], columns=[key, "chunk", "place", "total", "squares"])
        row = held.iloc[0]
        centred = np.asarray(row["scores"], float) - 0.5
        sums = np.concatenate([[0.0], np.cumsum(centred)]) + row["ahead"]
        squares = np.concatenate([[0.0], np.cumsum(centred * centred)]) + row["ahead_squares"]
        inside = (asked["place"] - row["chunk"] * chunk).to_numpy()
        return asked[[key, "chunk", "place"]].assign(total=sums[inside], squares=squares[inside])

    answers = asked.groupBy(key, "of").cogroup(
        chunks.select(key, "chunk", "scores", "ahead", "ahead_squares").groupBy(
            key, F.col("chunk").alias("of"))).applyInPandas(
        answer, f"`{key}` {kind}, chunk bigint, place bigint, total double, squares double")

    def go(held: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        row = held.iloc[0].to_dict()
        sums = {int(p): (t, q) for p, t, q in zip(
            answers["place"], answers["total"], answers["squares"])}
        walker = _Walker(key, row[key], delta)
        walker.start(row, row["chunk"] * chunk, row["from_chunk"] * chunk, sums)
        found = list(walker.take(row["scores"], row["ats"]))
        ended = pd.concat([*found, walker.row(True)], ignore_index=True)
        return ended.rename(columns={"final": "end"}).assign(
            chunk=row["chunk"], last_chunk=row["last_chunk"])

    shape = EVENTS.replace("final", "end")
    return begun.groupBy(key, "chunk").cogroup(answers.groupBy(key, "chunk")).applyInPandas(
        go, f"`{key}` {kind}, {shape}, chunk bigint, last_chunk bigint")


def _open_bounds(row: dict, chunk: int) -> list[int]:
    """Places (scores before them) between the state and the chunk where a bucket ends, and
    the state's own place."""
    start, place = row["from_chunk"] * chunk, row["chunk"] * chunk
    if place == start:
        return []
    counts = row["bucket_counts"]
    bounds = [place]
    for size in sizes_after([] if counts is None else list(counts), place - start):
        if bounds[-1] <= start:
            break
        bounds.append(bounds[-1] - size)
    # The chunk's own beginning is that of its first score, so it is asked of the chunk itself.
    return sorted({start, *(b for b in bounds if b > start)})


def _between(sums: dict[int, tuple[float, float]], first: int, end: int):
    """The bucket of the scores between two places, from running totals less one half."""
    n, total, squares = end - first, *(b - a for a, b in zip(sums[first], sums[end]))
    return n, 0.5 + total / n, max(0.0, squares - total * total / n)


class _Walker:
    """One key's detector and counts."""

    def __init__(self, key: str, name, delta: float):
        self.key, self.name, self.detector = key, name, Detector(delta)
        self.seen, self.fresh, self.latest, self.change, self.at = 0, 0, None, None, None

    def start(self, row: dict, place: int, begun: int, sums: dict[int, tuple[float, float]]):
        """Take over the state at score ``begun`` and bring it forward to ``place`` as if
        nothing was cut; ``sums`` has running totals where a new bucket begins or ends."""
        counts = row["bucket_counts"]
        held = [] if counts is None else list(zip(
            map(int, counts), map(float, row["bucket_means"]), map(float, row["bucket_squares"])))
        seen = 0 if pd.isna(row["score_stream_count"]) else int(row["score_stream_count"])
        self.detector.detections = 0 if pd.isna(row["detections"]) else int(row["detections"])
        self.change = None if pd.isna(row["last_change_at"]) else int(row["last_change_at"])
        self.seen, self.fresh = seen + place - begun, place
        self.detector.observed = self.seen
        if place == begun:
            self.detector.buckets = held
            return
        end = place
        for size in sizes_after([n for n, _, _ in held], place - begun):
            first = end - size
            bucket = None
            if end > begun:
                bucket = _between(sums, max(first, begun), end)
            need = begun - first if end > begun else size
            while need > 0:  # of the state's own buckets, newest first
                old = held.pop(0)
                bucket = old if bucket is None else _merge(bucket, old)
                need -= old[0]
            self.detector.buckets.append(bucket)
            end = first

    def take(self, scores, times) -> Iterator[pd.DataFrame]:
        for value, at in zip(scores, times):
            self.seen += 1
            self.fresh += 1
            self.latest, self.at = float(value), at
            if self.detector.add(self.latest):
                self.change = self.seen
                yield self.row(False)

    def row(self, final: bool) -> pd.DataFrame:
        counts, means, squares = self.detector.to_arrays()
        return pd.DataFrame({
            self.key: [self.name],
            "score_stream_count": [self.seen],
            "latest_score": [self.latest],
            "window_width": [self.detector.width],
            "window_mean": [self.detector.mean],
            "detections": [self.detector.detections],
            "last_change_at": pd.array([self.change], dtype="Int64"),
            "adwin_change_detected": [self.detector.changed],
            "bucket_counts": [counts],
            "bucket_means": [means],
            "bucket_squares": [squares],
            "at": pd.to_datetime([self.at]),
            "fresh": [self.fresh],
            "final": [final],
        })


def detect(
    scores: DataFrame, key: str = "model_version",
    order: Sequence[str] = ("created_at", "prediction_id"), *, score: str = "score",
    delta: float = DELTA, initial: DataFrame | None = None, chunk: int = CHUNK,
) -> DataFrame:
    """Final detector state per key after all scores, taken in order."""
    return walk(scores, key, order, score=score, delta=delta, initial=initial, chunk=chunk).filter(
        "final").drop("at", "fresh", "final")


def replay_window(
    predictions: DataFrame, limit: int = REPLAY_LIMIT,
    order: Sequence[str] = ("created_at", "prediction_id"),
) -> DataFrame:
    """The newest ``limit`` scores, oldest first."""
    return drift.newest(predictions, limit, order)


def replay_state(
    predictions: DataFrame, snapshots: DataFrame, *, limit: int = REPLAY_LIMIT,
    delta: float = DELTA, primed: DataFrame | None = None,
) -> DataFrame:
    """Rebuild monitoring state from the newest scores and merge the latest
    persisted snapshot: counts take the maximum, alerts combine with or, a latest
    score is only borrowed when nothing was replayed.

    ``snapshots``: snapshot_id, created_at, snapshot (JSON). Both inputs shrink to
    at most ``limit`` rows and one row before anything is combined. ``primed``: a stored
    detector state of one row to start from; its scores do not count as replayed.
    """
    recent = replay_window(predictions.select("prediction_id", "created_at", "score"), limit)
    start = primed.withColumn("model_version", F.lit("all")) if primed is not None else None
    state = walk(recent.withColumn("model_version", F.lit("all")), delta=delta,
                 initial=start).filter("final AND fresh > 0").select(
        F.col("fresh").alias("replayed"),
        F.col("latest_score").alias("replayed_score"),
        F.col("adwin_change_detected").alias("replayed_change"),
    )
    latest = snapshots.orderBy(F.col("created_at").desc(), F.col("snapshot_id").desc()).limit(1)
    saved = drift.read_snapshots(latest).drop("snapshot_id", "created_at", "snapshot")
    both = fold_rows([state, saved])
    replayed = F.coalesce("replayed", F.lit(0))
    changed = F.coalesce("replayed_change", F.lit(False)) | F.coalesce(
        "adwin_change_detected", F.lit(False)
    )
    results = F.coalesce(
        F.col("feature_results"), F.array().cast(f"array<{drift.FEATURE_RESULT}>")
    )
    return both.select(
        F.greatest(replayed, F.coalesce("score_stream_count", F.lit(0))).alias(
            "score_stream_count"),
        F.coalesce("replayed_score", "latest_score").alias("latest_score"),
        changed.alias("adwin_change_detected"),
        F.size(F.filter(results, lambda r: r["drift_detected"])).alias("feature_drift_count"),
        results.alias("feature_results"),
        "updated_at",
    ).withColumn(
        "status",
        drift.drift_status(
            F.col("adwin_change_detected"), F.col("feature_drift_count"),
            F.col("score_stream_count"),
        ),
    )
