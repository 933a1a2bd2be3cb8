"""Boundary cases of functions and operators with known answers."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.functions import decoding, geometry, pixels, policies, tensor
from sightline.operators import choose, layout, nms, sequences, vectors
from sightline.plans import composites, decoders, inference
from sightline.sources import readers


def one(df):
    return df.collect()[0][0]


def val(spark, col):
    return one(spark.range(1).select(col))


def farr(*v):
    return F.array(*(F.lit(float(x)) for x in v)).cast("array<float>")


DET = "image_id int, det_idx int, x1 float, y1 float, x2 float, y2 float, score float, class_id int"


def test_nms_equality_keeps_both_and_classes(spark):
    rows = [(1, 0, 0, 0, 100, 100, 0.9, 0), (1, 1, 0, 0, 50, 100, 0.8, 0), (2, 0, 0, 0, 100, 100, 0.9, 0), (2, 1, 2, 2, 100, 100, 0.8, 1)]
    df = spark.createDataFrame([(i, d, *map(float, b), s, c) for i, d, *b, s, c in rows], DET)
    assert nms.detections(df, ["image_id"], threshold=0.5).count() == 4
    assert {(r.image_id, r.det_idx) for r in nms.detections(df, ["image_id"], threshold=0.5, class_agnostic=True).collect()} == {(1, 0), (1, 1), (2, 0)}
    many = spark.range(10).select(F.lit(1).alias("image_id"), F.col("id").cast("int").alias("det_idx"), *((F.col("id") * 100 + d).cast("float").alias(n) for n, d in (("x1", 0), ("y1", 0), ("x2", 10), ("y2", 10))), (F.col("id") / 10).cast("float").alias("score"), F.lit(0).alias("class_id"))
    assert [r.det_idx for r in nms.detections(many, ["image_id"], limit=3).orderBy("rank").collect()] == [9, 8, 7]


def test_ious(spark):
    b = lambda *v: geometry.box(*(F.lit(float(x)) for x in v), F.lit(0.0), F.lit(0))
    assert val(spark, geometry.iou(b(0, 0, 10, 10), b(5, 0, 15, 10))) == pytest.approx(1 / 3)
    assert val(spark, geometry.iou(b(0, 0, 100, 100), b(50, 50, 150, 150))) == pytest.approx(1 / 7)
    assert val(spark, geometry.iou_floored(b(0.9, 0.9, 0.95, 0.95), b(0.9, 0.9, 0.95, 0.95))) == 0


def test_top_k_and_ties(spark):
    labels = F.array(*map(F.lit, ("0", "90", "180", "270")))
    got = val(spark, tensor.top_k(farr(0.1, 0.9, 0.4, 0.2), labels, 2))
    assert [(r["index"], r["label"]) for r in got] == [(1, "90"), (2, "180")]
    assert [r["index"] for r in val(spark, tensor.top_k(farr(0.5, 0.5, 0.5, 0.5), labels, 4))] == [0, 1, 2, 3]
    assert val(spark, tensor.argmax(farr("nan", 1, 1))) == 1


def test_similarities(spark):
    assert val(spark, tensor.cosine(farr(1, 0), farr(1, 0, 0))) == 0 and val(spark, tensor.cosine(farr(0, 0), farr(1, 0))) == 0
    with pytest.raises(Exception, match="lengths differ"):
        val(spark, tensor.dot_similarity(farr(1), farr(1, 2)))
    assert val(spark, tensor.l2_normalize(farr(0, 0))) == [0, 0]
    assert val(spark, tensor.half_up(F.lit(-2.5))) == -2 and val(spark, tensor.round3(F.lit(float("nan")))) == 0


def test_vector_store(spark):
    log = spark.createDataFrame([("a", 1, "save", [1.0, 0.0, 0.0]), ("b", 2, "save", [0.0, 1.0, 0.0]), ("c", 3, "save", [1.0, 1.0, 0.0]), ("d", 4, "save", [1.0, 0.0, 0.0]), ("d", 5, "delete", None), (None, 6, "save", [1.0]), ("a", 0, "save", [0.0, 0.0, 1.0])], "person_id string, seq long, op string, feature array<float>")
    store = vectors.current(log)
    q = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "query_id int, query array<float>")
    assert [(r.person_id, round(r.similarity, 4)) for r in vectors.search(store, q, 2).orderBy("rank").collect()] == [("a", 1.0), ("c", 0.7071)]
    assert vectors.search(store, q, -1).count() == 0


def raw(spark, rows):
    return spark.createDataFrame([(1, i, float(c), float(s), 0.0, float(20 * i), 10.0, float(20 * i + 10), o, 1.0, 0, 0, 1000, 500) for i, (c, s, o) in enumerate(rows)], "image_id int, row_idx int, cls double, score double, x1 double, y1 double, x2 double, y2 double, order_key double, scale double, pad_left int, pad_top int, width int, height int").withColumns({c: F.col(c).cast("float") for c in ("cls", "score", "x1", "y1", "x2", "y2", "order_key")})


def test_layout(spark):
    order = lambda df: [r.reading_order for r in df.orderBy("ord").collect()]
    assert order(layout.post_process(raw(spark, [(22, 0.9, 30.0), (22, 0.8, 10.0), (22, 0.7, 20.0)]))) == [3, 1, 2]
    assert order(layout.post_process(raw(spark, [(17, 0.9, 1.0), (21, 0.8, 2.0), (22, 0.7, 3.0), (14, 0.6, 4.0), (4, 0.5, 5.0)]))) == [1, -1, 2, -1, 3]
    assert order(layout.post_process(raw(spark, [(22, 0.9, 3.0), (22, 0.8, float("nan")), (22, 0.7, 1.0)]))) == [1, 2, 3]
    assert layout.decode(raw(spark, [(22, 0.9, 1.0), (22, 0.6, 1.0), (22, 0.5, 1.0), (30, 0.99, 1.0)]), ratio=0.6).count() == 2
    assert val(spark, layout.to_image(F.lit(100.0), F.lit(0), F.lit(0.5), F.lit(1000))) == 200


def test_content_type_policy(spark):
    r = lambda lab, s, **k: val(spark, policies.resolve_label(F.lit(lab), F.lit(s), F.lit(k.pop("text", False)), **k))
    assert r("png", 0.5, thresholds={"png": 0.99}) == "unknown" and r("png", 0.995, thresholds={"png": 0.99}) == "png"
    assert r("python", 0.1, mode="MEDIUM_CONFIDENCE", overwrite={"python": "txt"}, text=True) == "txt"
    few = lambda b: val(spark, policies.few_bytes_label(F.lit(b)))
    assert few(b"") == "empty" and few(b"abc") == "txt" and few(b"\xff\xfe\x00") == "unknown" and few(b"a" * 100) is None and few(b"          abc") == "txt"
    f = val(spark, policies.byte_features(F.lit(bytes([0x20, 9, 0x0A, 0x41, 0x42, 0x43, 0x0D, 0x44]))))
    assert len(f) == 2048 and f[:6] == [0x41, 0x42, 0x43, 0x0D, 0x44, 256] and f[-3:] == [0x43, 0x0D, 0x44]


def test_decisions(spark):
    d = lambda *p: val(spark, policies.liveness(farr(*p)))
    assert d(0.1, 0.9, 0).live and d(0.2, 0.85, 0.1).attack == "print" and d(0.1, 0.2, 0.7).attack == "replay"
    assert val(spark, policies.orientation(farr(0.5, 0.5))).degrees == 0 and val(spark, policies.orientation(farr(0.2, 0.8))).degrees == 180
    assert val(spark, policies.hex_colour(F.lit("#fA0"))).asDict() == {"r": 255, "g": 170, "b": 0} and val(spark, policies.hex_colour(F.lit("red"))) is None
    assert val(spark, policies.lines(F.lit("a\r\nb\rc\n"))) == ["a", "b", "c"]
    assert bytes(val(spark, policies.base64_bytes(F.lit("data:x,aGk=")))) == b"hi"


def test_ctc(spark):
    rows = F.array(farr(0, 9, 0), farr(0, 9, 0), farr(9, 0, 0), farr(0, 9, 0), farr(0, 0, 9))
    cs = F.array(F.lit(""), F.lit("x"), F.lit("y"))
    assert val(spark, decoding.ctc_text(rows, cs)).text == "xxy" and val(spark, decoding.ctc_plate(rows, cs)).asDict() == {"text": "xxy", "confidence": 9.0}
    with pytest.raises(Exception, match="charset size"):
        val(spark, decoding.ctc_text(rows, F.array(F.lit(""))))


def test_tiles(spark):
    s = val(spark, geometry.tile_starts(F.lit(1000), 480, 336))
    assert s[0] == 0 and s[-1] == 520 and max(np.diff(s)) <= 336 and val(spark, geometry.tile_starts(F.lit(480), 480, 336)) == [0]


def points(spark, xs, ts=None):
    return spark.createDataFrame([(1, i, float(x), 10.0, ts[i] if ts else i) for i, x in enumerate(xs)], "k int, i int, x double, y double, t long")


def test_rules(spark):
    got = sequences.line_crossings(points(spark, [50, 100, 150, 50]), ["k"], ["i"], (100, 0, 100, 200)).orderBy("i").collect()
    assert [(r.i, r.direction) for r in got] == [(2, "BACKWARD"), (3, "FORWARD")]
    ts = [0, 500, 1200, 1500, 1600, 1700, 2800]
    d = sequences.dwells(points(spark, [1, 1, 1, 1, 9, 1, 1], ts), ["k"], ["i"], "t", F.col("x") < 5, 1000).orderBy("i").collect()
    assert [(r.t, r.stay_ms) for r in d] == [(1200, 1200), (2800, 1100)]
    t = sequences.turns(points(spark, [0, 50, 10]), ["k"], ["i"]).collect()
    assert [(r.i, r.turn_angle, r.from_dir, r.to_dir) for r in t] == [(2, 180.0, "右", "左")]
    assert val(spark, sequences.cooldown(F.array(*map(F.lit, (1, 3, 8, 12, 13, 25))), 10)) == [1, 12, 25]
    with pytest.raises(Exception, match="backwards"):
        sequences.assert_monotonic(points(spark, [1, 1], [5, 3]), ["k"], ["i"], "t").collect()
    assert sequences.presence_changes(points(spark, []), ["k"], ["i"], F.lit(True)).count() == 0


def test_faces(spark):
    f = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 10.0, 0.5), (1, 1, 0.0, 0.0, 10.0, 10.0, 0.5)], "image_id int, det_idx int, x1 double, y1 double, x2 double, y2 double, score double")
    for s in ("LARGEST_AREA", "HIGHEST_SCORE"):
        assert choose.one_face(f, "image_id", s).collect()[0].det_idx == 0
    with pytest.raises(Exception, match="more than one face"):
        choose.one_face(f, "image_id", "REJECT").collect()


def test_sources(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"x" * 5000)
    r = readers.files(spark, str(tmp_path)).select("length", *readers.head_tail(F.col("content"))).collect()[0]
    assert r[0] == 5000 and len(r[1]) == len(r[2]) == 4096
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.files(spark, str(tmp_path / "no")).collect()
    assert val(spark, readers.label_array(F.lit(" a \n\nb\r\n"))) == ["a", "b"]
    assert val(spark, readers.charset(F.lit("ab\na"))) == ["", "a", "b", "a"]
    (tmp_path / "m.json").write_text('{"beg_size": 1024, "other": 1, "overwrite_map": {"a": "b"}}')
    m = readers.model_config(spark, str(tmp_path / "m.json")).collect()[0]
    assert m.beg_size == 1024 and m.overwrite_map == {"a": "b"} and m.end_size is None


def test_pixels(spark):
    img = np.arange(12, dtype=np.uint8).reshape(2, 2, 3)
    assert pixels.chw(img, scale=1).tolist() == img.transpose(2, 0, 1).tolist() and pixels.resize_nearest(img, 4, 4).shape == (4, 4, 3)
    m = np.zeros((8, 8))
    m[2:5, 3:6] = 0.9
    m[7, 7] = 0.95
    assert pixels.heatmap_corner(m) == (4.0, 3.0, 0.95) and pixels.heatmap_corner(m / 10)[:2] == (7.0, 7.0)
    sq = [(0, 0), (2, 0), (2, 2), (0, 2)]
    assert pixels.polygon_iou(sq, [(x + 1, y) for x, y in sq]) == pytest.approx(1 / 3)
    h = pixels.homography(np.array(sq), np.array(sq) * 2.0)
    assert np.allclose(h @ [1, 1, 1] / (h @ [1, 1, 1])[2], [2, 2, 1])
    assert pixels.laplacian_variance(np.ones((5, 5))) == 0
    df = spark.createDataFrame([(img.tobytes(), 2, 2)], "c binary, w int, h int")
    assert bytes(one(df.select(pixels.apply(lambda a: a[::-1, ::-1], F.col("c"), F.col("w"), F.col("h"), "binary")))) == img[::-1, ::-1].tobytes()
    with pytest.raises(ValueError):
        pixels.image(b"123", 2, 2)


def test_inference_shell(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0], "unused") for i in range(5)], "id int, x array<float>, t string")
    got = inference.infer(df, lambda p: [[float(sum(v))] for v in p["x"]], ["x"], ["id"], "y", "array<float>", batch=2)
    assert {r.id: r.y for r in got.collect()} == {i: [i + 1.0] for i in range(5)}
    assert inference.resolve_output(["a", "my_alpha"], "alpha") == "my_alpha"


def test_photo_reason(spark):
    assert val(spark, composites.photo_reason(F.lit(0), F.lit(1.0), F.lit(True))) == "NO_FACE"
    assert val(spark, composites.photo_reason(F.lit(1), F.lit(0.1), F.lit(True), gate=True)) == "LOW_QUALITY"
    assert val(spark, composites.labels_match(F.array(F.lit("b"), F.lit("a")), ["a", "b"]))


def test_unknown_labels_take_the_unknown_row(spark):
    df = spark.createDataFrame([(1, "pdf"), (2, "zzz"), (3, None)], "id int, label string")
    kinds = "label string, mime_type string, grp string, description string, extensions array<string>, is_text boolean"
    some = [("pdf", None, "document", None, ["pdf"], None), ("unknown", "a/b", "g", "Unknown data", None, False)]
    got = {r.id: r for r in policies.with_content_type(df, spark.createDataFrame(some, kinds)).collect()}
    assert (got[1].label, got[1].mime_type, got[1].description, got[1].is_text) == ("pdf", "application/octet-stream", "pdf", False)
    assert [(got[i].label, got[i].mime_type, got[i].grp, got[i].description) for i in (2, 3)] == [("unknown", "a/b", "g", "Unknown data")] * 2
    got = {r.id: r for r in policies.with_content_type(df, spark.createDataFrame(some[:1], kinds)).collect()}
    assert (got[2].label, got[2].mime_type, got[2].description, got[2].extensions) == ("unknown", "application/octet-stream", "unknown", [])


def test_cards_without_area(spark):
    rows = choose.card_scores(spark.createDataFrame([(1, 0.0, 0.5), (1, 0.0, 1.0), (2, 4.0, 1.0), (2, 2.0, 1.0)], "k int, area double, ratio_score double"), "k").collect()
    assert sorted(round(r.rank_score, 6) for r in rows) == [0.5, 0.7, 1.0, 1.0]


def test_similar_quadrilaterals_by_polygon(spark):
    """Diamonds in the same bounding box as a square overlap it by half only."""
    p = "id int, k int, score double, points array<struct<x:double,y:double>>"
    square, diamond = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)], [(5.0, 0.0), (10.0, 5.0), (5.0, 10.0), (0.0, 5.0)]
    rows = [(1, 7, 0.9, square), (2, 7, 0.8, diamond), (3, 7, 0.7, [(x + 1, y) for x, y in square])]
    df = spark.createDataFrame(rows, p)
    assert [r.id for r in nms.quadrilaterals(df, ["k"], "id").orderBy("rank").collect()] == [1, 2]
    assert [r.id for r in nms.quadrilaterals(df, ["k"], "id", threshold=0.4).collect()] == [1]


def test_label_lists(spark, tmp_path):
    got = readers.labels(spark.createDataFrame([("a\n\n b \r\nc",)], "text string")).collect()
    assert [tuple(r) for r in got] == [(0, "a"), (1, "b"), (2, "c")]
    with pytest.raises(Exception, match="no labels"):
        readers.labels(spark.createDataFrame([(" \n",)], "text string")).collect()
    (tmp_path / "f").write_text("x")
    assert readers.path_label(spark, str(tmp_path)) == "directory" and readers.path_label(spark, str(tmp_path / "f")) is None and readers.path_label(spark, "/dev/null") == "unknown"
    with pytest.raises(FileNotFoundError):
        readers.path_label(spark, str(tmp_path / "none"))


def test_image_files(spark, tmp_path):
    img = np.random.default_rng(3).integers(0, 255, (5, 7, 3)).astype(np.uint8)
    df = spark.createDataFrame([("a", bytearray(img.tobytes()), 7, 5)], "name string, pixels binary, width int, height int")
    for form in ("png", "bmp"):
        assert readers.write_images(df, f"file://{tmp_path}/{form}", form).collect()[0].bytes == (tmp_path / form / f"a.{form}").stat().st_size
    raw = (tmp_path / "png" / "a.png").read_bytes()
    at = raw.index(b"IDAT")
    rows = np.frombuffer(zlib.decompress(raw[at + 4 : at + 4 + int.from_bytes(raw[at - 4 : at], "big")]), np.uint8).reshape(5, 22)
    assert (rows[:, 1:].reshape(5, 7, 3)[:, :, ::-1] == img).all()
    bmp = (tmp_path / "bmp" / "a.bmp").read_bytes()
    assert (np.frombuffer(bmp, np.uint8, offset=54).reshape(5, 24)[::-1, :21].reshape(5, 7, 3) == img).all()
    with pytest.raises(ValueError, match="codec"):
        readers.write_images(df, str(tmp_path), "jpg")


def test_captcha_shapes(spark):
    def shaped(t):
        return val(spark, tensor.as_matrix(F.array(*(F.array(*(F.array(*(F.lit(float(x)).cast("float") for x in r)) for r in m)) for m in t))))

    assert shaped([[[1], [2]], [[3], [4]]]) == [[1, 2], [3, 4]] and shaped([[[1, 2]], [[3, 4]]]) == [[1, 2], [3, 4]] and shaped([[[1, 2], [3, 4]]]) == [[1, 2], [3, 4]]
    with pytest.raises(Exception, match="size 1"):
        shaped([[[1, 2], [3, 4]], [[1, 2], [3, 4]]])


def test_detector_outputs_are_checked(spark):
    df = spark.createDataFrame([(1, [[0.1] * 8] * 3, [[0.9] * 3] * 4)], "id int, d array<array<float>>, c array<array<float>>")
    with pytest.raises(Exception, match="stride"):
        decoders.nanodet(df, ["id"], ["d", "c"], side=16, strides=(8,)).collect()
    with pytest.raises(ValueError, match="threshold"):
        decoders.yolox(df, ["id"], "d", threshold=1.5)
    with pytest.raises(ValueError, match="multiple"):
        decoders.yolox(df, ["id"], "d", side=415)
    marks = [[0.0] * 10, [float("nan")] + [0.0] * 9, [0.0] * 10, [0.0] * 10]
    one = spark.createDataFrame([(1, [[1.0]] * 4, [[1.0]] * 4, [[0.5, 0.5, 0.0, 0.0]] * 3 + [[0.5, 0.5, -9.0, 0.0]], marks, 1.0, 16, 16)], "id int, c array<array<float>>, o array<array<float>>, b array<array<float>>, k array<array<float>>, scale double, width int, height int")
    got = decoders.yunet(one, ["id"], {8: ("c", "o", "b", "k")}, 16).collect()
    assert sorted(r.det_idx.anchor for r in got) == [0, 2]  # no number; under a pixel


def test_softmax_is_linear(spark):
    """A thousand classes cost about what they are, not their square or cube."""
    import time

    took = {}
    for n in (300, 3000):
        df = spark.range(60).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.sin(i + F.col("id")).cast("float")).alias("v")).cache()
        df.count()
        f = lambda: df.select(tensor.softmax(F.col("v")).alias("s"), tensor.l2_normalize(F.col("v")).alias("l"), tensor.minmax(F.col("v")).alias("m")).write.format("noop").mode("overwrite").save()  # noqa: B023, E731
        f()
        began = time.time()
        f()
        took[n] = time.time() - began
    assert took[3000] < 40 * took[300] + 2


def test_window_and_its_corners(spark):
    box = F.struct(*(F.lit(v).alias(n) for n, v in (("x1", 10.0), ("y1", 20.0), ("x2", 30.0), ("y2", 60.0))))
    eyes = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((12.0, 30.0), (22.0, 40.0))))
    w = val(spark, geometry.window_affine(box, eyes, face_scale=2.0))
    quad = val(spark, geometry.window_quad(geometry.window_affine(box, eyes, face_scale=2.0)))
    assert w.side == 80
    for p, (x, y) in zip(quad, ((0, 0), (80, 0), (80, 80), (0, 80)), strict=True):
        assert w.m00 * p.x + w.m01 * p.y + w.tx == pytest.approx(x, abs=1e-3) and w.m10 * p.x + w.m11 * p.y + w.ty == pytest.approx(y, abs=1e-3)
    with pytest.raises(Exception, match="extent"):
        val(spark, geometry.window_affine(F.struct(*(F.lit(0.0).alias(n) for n in ("x1", "y1", "x2", "y2")))))
