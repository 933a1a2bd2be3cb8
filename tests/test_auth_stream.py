"""Sessions in a stream: progress, the best feature, one-time submission; equal to the batch form."""

import numpy as np
import pandas as pd
import pytest

from sightline.functions import pixels
from sightline.operators import choose
from sightline.streaming import auth

SCHEMA = "session_id string, seq int, yaw double, pitch double, live_score double, feature array<double>, submit boolean"
ROWS = [("a", 1, -0.1, 0.0, 0.5, [1.0], False), ("a", 2, None, None, 0.99, [9.0], False), ("a", 3, 0.15, 0.13, 0.7, [2.0], False), ("a", 4, 0.0, 0.0, 0.7, [3.0], False), ("b", 1, 0.0, 0.0, 0.9, [5.0], False), ("b", 2, None, None, None, None, True)]


def test_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame(ROWS, SCHEMA).coalesce(1).write.parquet(src)
    df = spark.readStream.schema(SCHEMA).parquet(src)

    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # one-time runs end when all rows are read

    def go():
        q = auth.sessions(df).writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(240)
        return {(r.session_id, r.seq): r for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    got = go()
    last, batch = got["a", 4], choose.auth_progress(spark.createDataFrame([r[:6] for r in ROWS if r[0] == "a"], ", ".join(SCHEMA.split(", ")[:6]))).collect()[0]
    assert (last.frames, last.complete) == (4, True) and (last.shake, last.nod) == pytest.approx((batch.shake, batch.nod))
    assert not got["b", 2].complete and got["b", 2].feature is None
    spark.createDataFrame([("a", 5, None, None, None, None, True), ("a", 6, None, None, None, None, True)], SCHEMA).coalesce(1).write.mode("append").parquet(src)
    again = go()
    assert again["a", 5].feature == batch.best_feature == [2.0]
    assert again["a", 6].feature is None and again["a", 6].frames == 0
    refs = spark.createDataFrame([("a", [2.0]), ("b", [1.0])], "session_id string, reference array<double>")
    ends = {(r.session_id, r.seq): (r.passed, r.reason) for r in auth.outcomes(spark.read.parquet(str(tmp_path / "out")), refs, live_least=0.6).collect()}
    assert ends == {("a", 5): (True, "OK"), ("a", 6): (False, "ACTION_INCOMPLETE"), ("b", 2): (False, "ACTION_INCOMPLETE")}


class _Value:
    """A state handle and timer of one key."""

    def __init__(self):
        self.v, self.now = None, 1000

    getValueState = lambda self, *_: self
    exists = lambda self: self.v is not None
    get = lambda self: self.v
    getCurrentProcessingTimeInMs = lambda self: self.now

    def update(self, v):
        self.v = v

    def clear(self):
        self.v = None


def test_sessions_end_with_any_submission_and_at_a_fixed_time():
    h, p = _Value(), auth._Sessions(500, 3)
    p.init(h)

    def send(*rows):
        cols = ["seq", "yaw", "pitch", "live_score", "feature", "submit"]
        return next(p.handleInputRows(("s",), [pd.DataFrame(rows, columns=cols)], h)).to_dict("records")

    assert send((1, 0.0, 0.0, 0.9, [1.0], False))[0]["frames"] == 1
    h.now = 1400
    assert send((2, 0.0, 0.0, 0.9, [1.0], False))[0]["frames"] == 2
    h.now = 1501  # 501 after the first row, though 101 after the last
    assert send((3, 0.0, 0.0, 0.9, [1.0], False))[0]["frames"] == 1
    # an incomplete submission ends the session too
    assert not send((4, None, None, None, None, True))[0]["complete"] and h.v is None
    got = send(*((k, 0.1 * k, 0.1 * k, 0.9, [float(k)], False) for k in range(5)))
    assert [(r["frames"], r["accepted"]) for r in got] == [(1, True), (2, True), (3, True), (3, False), (3, False)]


def test_tiled_upscale_equals_whole():
    img = np.random.default_rng(1).integers(0, 255, (50, 70, 3)).astype(np.uint8)
    twice = lambda a: a.repeat(2, 0).repeat(2, 1)
    assert (pixels.upscale_tiled(img, twice, 2, 24, 6) == twice(img)).all()
    assert pixels.upscale_tiled(img, twice, 2, 24, 6, long_side=35).shape == (50, 70, 3)
