"""Live-check sessions as keyed streaming state with a time to live and one-time results."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions.policies import auth_reason
from ..functions.tensor import dot_similarity

STATE = "frames int, yaw_min double, yaw_max double, pitch_min double, pitch_max double, best double, feature array<double>, expires long"
OUTPUT = "session_id string, seq int, frames int, shake double, nod double, complete boolean, submitted boolean, accepted boolean, live_score double, feature array<double>"
#: A session ends so long after its first row; ranges of a full head shake and nod; frames needed and at most taken.
TTL_MS, YAW_RANGE, PITCH_RANGE, LEAST_FRAMES, MOST_FRAMES = 120_000, 0.20, 0.12, 2, 60
_NEW = [0, None, None, None, None, None, None, 0]


def _progress(lo: float | None, hi: float | None, need: float) -> float:
    span = 0.0 if lo is None else hi - lo
    return 0.0 if not span > 0 else min(1.0, span / need)


class _Sessions(StatefulProcessor):
    def __init__(self, ttl_ms: int, most_frames: int):
        self.ttl_ms, self.most_frames = ttl_ms, most_frames

    def init(self, handle) -> None:
        # the store forgets abandoned sessions; what ends a session is the time it was created with
        self.state = handle.getValueState("session", STATE, self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = int(timerValues.getCurrentProcessingTimeInMs())
        s = list(self.state.get()) if self.state.exists() else None
        if s is not None and now > s[7]:
            s = None
        out = []
        for r in pd.concat(list(rows), ignore_index=True).sort_values("seq", kind="stable").itertuples(index=False):
            if s is None:
                s = [*_NEW[:7], now + self.ttl_ms]
            taken = bool(r.submit) or s[0] < self.most_frames
            if taken and not r.submit:
                s[0] += 1  # refused frames count too
                if not (pd.isna(r.yaw) or pd.isna(r.pitch)):
                    for k, v in ((1, r.yaw), (3, r.pitch)):
                        s[k] = v if s[k] is None else min(s[k], v)
                        s[k + 1] = v if s[k + 1] is None else max(s[k + 1], v)
                    if r.feature is not None and not pd.isna(r.live_score) and (s[5] is None or r.live_score > s[5]):
                        s[5], s[6] = float(r.live_score), [float(x) for x in r.feature]
            shake, nod = _progress(s[1], s[2], YAW_RANGE), _progress(s[3], s[4], PITCH_RANGE)
            done = shake >= 1 and nod >= 1 and s[0] >= LEAST_FRAMES
            given = bool(r.submit) and done
            out.append((key[0], int(r.seq), s[0], shake, nod, done, bool(r.submit), taken, s[5] if given else None, s[6] if given else None))
            if r.submit:  # whatever comes of it, a session is submitted once
                s = None
        if s is None:
            self.state.clear()
        else:
            self.state.update(tuple(s))
        yield pd.DataFrame(out, columns=[c.strip().split(" ")[0] for c in OUTPUT.split(", ")])

    def close(self) -> None:
        pass


def sessions(frames: DataFrame, ttl_ms: int = TTL_MS, most_frames: int = MOST_FRAMES) -> DataFrame:
    """A progress row for every frame or submission of a stream.

    ``frames``: session_id, seq, yaw, pitch (null where the frame was refused),
    live_score, feature, submit.  A submission of a complete session returns the
    best feature and its live score; every submission, complete or not, ends
    the session, and later rows begin a new, empty one.  Frames beyond
    ``most_frames`` are not accepted and change nothing.  A session ends
    ``ttl_ms`` after its first row, whatever follows.
    """
    cols = frames.select("session_id", "seq", F.col("yaw").cast("double").alias("yaw"), F.col("pitch").cast("double").alias("pitch"), F.col("live_score").cast("double").alias("live_score"), F.col("feature").cast("array<double>").alias("feature"), F.coalesce("submit", F.lit(False)).alias("submit"))
    return cols.groupBy("session_id").transformWithStateInPandas(_Sessions(ttl_ms, most_frames), OUTPUT, "Append", "ProcessingTime")


def outcomes(progress: DataFrame, references: DataFrame, threshold: float = 0.35, live_least: float = 0.85) -> DataFrame:
    """session_id, seq, passed, reason, similarity of the submissions among ``progress`` rows.

    ``references``: session_id, reference (the enrolled feature), one row a
    session.  Similarity is null where there is nothing to compare.
    """
    both = progress.where("submitted").join(references.select("session_id", "reference"), "session_id", "left")
    usable = F.col("feature").isNotNull() & F.col("reference").isNotNull()
    near = F.when(usable, dot_similarity(F.col("feature"), F.col("reference").cast("array<double>")))
    out = both.withColumn("similarity", near)
    out = out.withColumn("reason", auth_reason(F.col("complete"), F.col("feature"), F.col("similarity"), F.col("live_score"), threshold, live_least))
    return out.select("session_id", "seq", (F.col("reason") == "OK").alias("passed"), "reason", "similarity")
