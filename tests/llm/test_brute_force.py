"""Operators against plain re-computations, and their bounds on memory and links."""

import itertools
import re
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sightline.llm import common, decontaminate, language_id, lm, near_duplicates, packing, quality, rans, sharding, tokens
from sightline.llm.common import id_fold

from tests.llm.test_edge_cases import BASE, edited, text


def tokens_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


# --- shared plumbing ----------------------------------------------------------------


def test_shared_folder_must_be_named_on_a_cluster():
    conf = SimpleNamespace(get=lambda *_: None)
    fake = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://somewhere:7077", getConf=lambda: conf))
    with pytest.raises(ValueError):
        common.shared_root(fake)


def test_session_settings_are_left_alone(spark):
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    before = [spark.conf.get(k, None) for k in keys]
    docs = spark.createDataFrame([(i, text(i, 20)) for i in range(6)], "doc_id long, text string")
    near_duplicates.near_duplicates(docs).count()
    lm.score(docs, F.lit(False)).count()
    assert [spark.conf.get(k, None) for k in keys] == before


def test_salted_join(spark):
    big = spark.createDataFrame([(i % 3 or None, i) for i in range(300)], "k int, v int")
    small = spark.createDataFrame([(1, "a"), (2, "b"), (9, "c")], "k int, w string")
    got = sorted((r.k, r.v, r.w) for r in common.salted_join(big, small, "k", F.col("v")).collect())
    assert got == sorted((i % 3, i, " ab"[i % 3]) for i in range(300) if i % 3)


# --- near duplicates ----------------------------------------------------------------


def test_repeated_rows_stage_one_link(spark, monkeypatch):
    """A thousand repeats of each of two near copies: one link, not a million."""
    seen, real = [], near_duplicates.components
    monkeypatch.setattr(near_duplicates, "components", lambda ws, edges: seen.append(edges.count()) or real(ws, edges))
    rows = [(1 + i % 2, BASE if i % 2 else edited(BASE, 2, 5)) for i in range(2000)] + [(3, text(77, 40))]
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("doc_id", "component_id", "kept").count().collect()
    assert sorted(map(tuple, got)) == [(1, 1, True, 1000), (2, 1, False, 1000), (3, 3, True, 1)]
    assert max(seen) <= 1


def test_hot_pivot_dealt_over_copies_of_its_set(spark, monkeypatch):
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[:59] + [f"x{i}"] if i else base)) for i in range(40)] + [(40 + i, " ".join(f"v{i}_{k}" for k in range(30))) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r.doc_id: r.component_id for r in near_duplicates.near_duplicates(docs).collect()}
    assert want == {i: 0 if i < 40 else i for i in range(45)}
    staged, real = [], common.Workspace.stage
    monkeypatch.setattr(near_duplicates, "PIVOT_PAIRS", 3)
    monkeypatch.setattr(common.Workspace, "stage", lambda ws, df, name, *a, **k: staged.append((name, out := real(ws, df, name, *a, **k))) or out)
    got = {r.doc_id: r.component_id for r in near_duplicates.near_duplicates(docs).collect()}
    assert got == want
    links = next(t for name, t in staged if name == "links")
    assert links.distinct().count() == links.count() >= 39


def test_one_id_with_several_texts(spark):
    rows = [(7, BASE), (7, text(90, 60)), (8, edited(BASE, 1, 2)), (9, edited(text(90, 60), 1, 3))]
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(7, 7, True), (7, 7, True), (8, 7, False), (9, 7, False)]


# --- quality ------------------------------------------------------------------------


def plain_cells(t):
    raw = (t or "").encode()
    out = set()
    for n in (2, 3, 4):
        for i in range(len(raw) - n + 1):
            g = 0 if n == 4 else n
            for x in raw[i : i + n]:
                g = (g << 8 | x) & 0xFFFFFFFF
            g = g * 0x9E3779B1 & 0xFFFFFFFF
            g ^= g >> 15
            out.add((g * 0x85EBCA6B & 0xFFFFFFFF) >> (32 - quality.CELLS_BITS))
    for w in tokens_of(t):
        h = quality.words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))[0]
        out.add(int(quality.mix(h ^ np.uint64(0x77))[0] >> np.uint64(64 - quality.CELLS_BITS)))
    return sorted(out)


def test_quality_scores_against_plain_sums(spark):
    docs = spark.createDataFrame([(i, " ".join(w + ("!!" if i % 2 else "") for w in text(i, 50).split())) for i in range(200)] + [(900, None), (901, ""), (902, "Ärger über 日本")], "doc_id long, text string")
    m = quality.train(docs, docs.where("doc_id < 200").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")))
    got = {r.doc_id: r.score for r in quality.score(docs, m).collect()}
    for r in docs.collect():
        cells = plain_cells(r.text)
        size = sum(float(m.ratio2[c]) for c in cells) ** 0.5 or 1.0
        z = m.slope * (sum(float(m.weights[c]) for c in cells) / size + m.bias) + m.shift
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-z))) < 1e-6


def test_quality_sample_is_bounded_where_ids_repeat(spark, monkeypatch):
    seen, real = [], quality.fit_arrays
    monkeypatch.setattr(quality, "fit_arrays", lambda rows, y, share: seen.append(rows) or real(rows, y, share))
    docs = spark.createDataFrame([(i % 40, f"{text(i, 30)} {'good' if i % 2 else 'bad'}") for i in range(4000)] + [(1, "".join(chr(200 + i % 4000) for i in range(60_000)))], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    quality.train(docs, labels)
    assert len(seen[0]) == 40 and max(map(len, seen[0])) <= quality.CELLS // 8
    for n in (0, 3, 8191, 8192, 100_000):
        cells = np.sort(np.random.default_rng(n).choice(quality.CELLS, n, replace=False))
        assert (quality.decode_cells(quality.encode_cells(cells)) == cells).all()


# --- sharding -----------------------------------------------------------------------


def test_shards_against_plain_sums(spark):
    rows = [(i if i % 50 else None, text(i, 1 + i % 90) if i % 7 else None) for i in range(3000)] + [(5, BASE)] * 1500
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 4, slots=512).collect()
    want = sorted((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows if i is not None)
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in got if r.doc_id is not None) == want and len(got) == len(rows)
    for s in range(4):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    # near-equal bytes but for the slot that 1500 equal rows share
    load = np.bincount([r.shard for r in got], weights=[r["size"] for r in got])
    hot = 1500 * (len(BASE) + 16)
    assert load.sum() - hot > 0 and sorted(load)[-2] <= max(load.mean(), hot) * 1.02
    spread = sharding.shard(spark.createDataFrame([(i, text(i % 300, 40)) for i in range(6000)], "doc_id long, text string"), 4).collect()
    load = np.bincount([r.shard for r in spread], weights=[r["size"] for r in spread])
    assert load.max() <= 1.01 * load.mean() and load.min() >= 0.99 * load.mean()


# --- token files and packing --------------------------------------------------------


def test_one_block_alone():
    r = np.random.default_rng(4)
    ids = (r.zipf(1.4, 40_000) % 900).astype(np.uint32)
    t = rans.Table(rans.quantise(np.bincount(ids, minlength=900)))
    for n in (7, 16384, 40_000):
        data = rans.pack(np.array([1]), np.array([1]), np.array([n]), ids[:n], t)
        for i in range(-(-n // rans.BLOCK)):
            assert (rans.unpack_block(data, i, t) == ids[:n][i * rans.BLOCK : (i + 1) * rans.BLOCK]).all()


def test_text_with_more_pieces_than_the_table(monkeypatch):
    monkeypatch.setattr(tokens, "TABLE_BITS", 8)
    for name, kind in (("byte_bpe_50k.json", "bytes"), ("word_bpe_49k.json", "words")):
        e = tokens.PieceEncoder(tokens.tokenizer_file(name), kind)
        texts = [" ".join(f"q{i}z" for i in range(3000)), "a few words", " ".join(f"q{i}z" for i in range(100)), None]
        got = [ids for _, _, ids, _ in e.encode(pa.array(texts))]
        assert np.concatenate(got).tolist() == [i for t in texts for i in e.tok.encode(t or "", add_special_tokens=False).ids]
        assert e.bits == 8


def test_packing_against_the_library(spark):
    path = tokens.tokenizer_file("word_bpe_49k.json")
    rows = [(i, text(i, int(n))) for i, n in enumerate(np.random.default_rng(8).integers(0, 700, 300))] + [(1000, text(4, 9000)), (1001, None)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), path, 0).collect()
    tok, want, total = tokens.PieceEncoder.get(path, "words").tok, [], 0
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        for k in range(0, len(ids), 2048):
            part = np.array(ids[k : k + 2048], "<u4")
            want.append((i, k // 2048, k, len(part), zlib.crc32(part.tobytes())))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert len({r.sequence_id for r in got}) <= 1.02 * total / 2048 + 1


def test_best_two_fit_against_brute_force():
    """No bin that two waiting pieces in place of its smallest would fill better."""
    r = np.random.default_rng(6)
    for _ in range(40):
        lengths, room = r.integers(1, 40, 30), 60
        bins, offsets = packing.pack_lengths(lengths, room)
        for b in range(bins.max() + 1):
            own = np.flatnonzero(bins == b)
            assert lengths[own].sum() <= room
            at = np.sort(offsets[own])
            assert at.tolist() == (np.cumsum(lengths[own][np.argsort(offsets[own])]) - lengths[own][np.argsort(offsets[own])]).tolist()
        first = np.flatnonzero(bins == 0)
        free = room - lengths[first].sum()
        rest = lengths[bins > 0]
        if free and len(rest) > 1:
            small = lengths[first].min()
            fuller = [x + y for x, y in itertools.combinations(rest.tolist(), 2) if small < x + y <= small + free]
            # whatever was exchanged, the gap that is left could not be closed by one waiting piece
            assert not any(x <= free for x in rest.tolist()) or not fuller
    # a bin of one piece is improved too: 7 of 12 gives way to 6 + 6
    bins, _ = packing.pack_lengths(np.array([7, 6, 6]), 12)
    assert sorted(np.bincount(bins, weights=[7, 6, 6]).tolist()) == [7, 12]


# --- language -----------------------------------------------------------------------


def test_language_profiles_against_plain_bundles(spark):
    en, de = ["the quick brown fox", "and the other thing, THE end"], ["der schnelle braune Fuchs", "und das andere Ding übrig"]
    p = language_id.train(spark.createDataFrame([("en", t) for t in en] + [("de", t) for t in de], "lang string, text string"))

    def bundle(t):
        cls = language_id.letter_classes()
        seq, out = [], np.zeros(language_id.DIMENSION)
        for ch in f" {t} ":
            c = int(cls[ord(ch)])
            if c or (seq and seq[-1]) or not seq:
                seq.append(c)
        for a, b, c in zip(seq, seq[1:], seq[2:], strict=False):
            out += np.roll(language_id._L0[a], 2).astype(int) * np.roll(language_id._L0[b], 1) * language_id._L0[c]
        return out

    sums = {"de": sum(map(bundle, de)), "en": sum(map(bundle, en))}
    unit = np.array([sums[x] / np.linalg.norm(sums[x]) for x in p.languages])
    centre = unit.mean(0)
    want = (unit - centre) / np.linalg.norm(unit - centre, axis=1, keepdims=True)
    assert np.allclose(want, p.vectors, atol=1e-5)
    some = ["the fox", "das Ding", "a", "Übrig und der"]
    got = language_id.predict(spark.createDataFrame(list(enumerate(some)), "doc_id long, text string"), p).orderBy("doc_id").collect()
    for t, r in zip(some, got, strict=True):
        v = bundle(t) / np.linalg.norm(bundle(t)) - centre
        cos = want @ (v / np.linalg.norm(v))
        assert r.lang_pred == p.languages[int(cos.argmax())] and abs(r.score - (1 + cos.max()) / 2) < 1e-4


# --- language model -----------------------------------------------------------------


def test_base_scores_exactly_and_held_out_gain(spark):
    r = np.random.default_rng(12)
    follow = r.permutation(60)
    rows = []
    for i in range(1200):
        w = [int(r.integers(60))]
        for _ in range(int(r.integers(5, 60))):
            w.append(int(follow[w[-1]]) if r.random() < 0.8 else int(r.integers(60)))
        rows.append((i, " ".join(f"W{x}" for x in w) + (f" rare{i}" if i % 3 else "")))
    rows += [(5000, None), (5001, ""), (5002, "never seen words"), (None, "w1 w2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x.doc_id: x for x in lm.score(docs, id_fold(F.col("doc_id"), 5) == 1).collect()}
    fold = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    count: dict = {}
    for i, t in rows:
        if not fold(i):
            for w in [*tokens_of(t), None]:
                count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    gain = []
    for i, t in rows:
        w, x = [*tokens_of(t), None], got[i]
        base = sum(np.log10((count.get(k, 0) + 0.5) / (n + 0.5 * (v + 1))) for k in w)
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (fold(i), len(w), sum(count.get(k, 0) > 0 for k in w), n)
        assert abs(x.base_score - base) < 1e-8 * max(1, abs(base))
        if fold(i):
            gain.append(((x.score - x.base_score) / x.n_tokens, x.n_tokens))
    assert np.average([g for g, _ in gain], weights=[k for _, k in gain]) > 0.05


def test_each_training_document_is_learnt_from_once(spark, monkeypatch):
    """Rounds share a chunk's documents out."""
    took = []
    monkeypatch.setattr(lm, "_average", lambda chunks, start, short, end, rate, share: took.append(share) or start)
    docs = spark.createDataFrame([(i, text(i, 9)) for i in range(50)], "doc_id long, text string")
    assert lm.score(docs, F.lit(False), rounds=3).count() == 50 and took == [(0, 3), (1, 3), (2, 3)]


def test_softmax_without_a_pass_for_the_largest(monkeypatch):
    """Log probabilities and gradients against float64, with logits that exp takes as they are and with some that it does not."""
    r = np.random.default_rng(3)
    monkeypatch.setattr(lm.gru, "OUTPUT_ROWS", 16)
    for bias, fits in ((0.0, True), (300.0, False)):
        m = lm.gru.Model.unigram(np.full(38, 1 / 38))
        for k in ("C", "W", "c", "w"):
            m.p[k] += r.normal(0, 0.5, m.p[k].shape).astype(np.float32)
        m.p["c"][2] += bias
        m.p["w"][1] -= bias
        s, target = r.uniform(-1, 1, (90, lm.gru.HIDDEN)).astype(np.float32), r.integers(0, 38, 90)
        assert bool(lm.gru._in_range(np.concatenate([m.p["C"], m.p["c"][None]]))) is fits
        logp, g, ds = lm.gru._output(m, s, target, np.float32(0.5))
        want, wg, wds = np.zeros(90), {k: np.zeros(m.p[k].shape) for k in ("C", "c", "W", "w")}, np.zeros(s.shape)
        for i, t in enumerate(target):
            k = t // m.width if t < m.words else m.classes
            for C, c, at, gC, gc in [(m.p["C"], m.p["c"], k, wg["C"], wg["c"]), *([(m.p["W"][k], m.p["w"][k], t % m.width, wg["W"][k], wg["w"][k])] if t < m.words else [])]:
                x = s[i].astype(float) @ C + c
                x -= x.max()
                q = np.exp(x) / np.exp(x).sum()
                want[i] += x[at] - np.log(np.exp(x).sum())
                q[at] -= 1
                gC += 0.5 * np.outer(s[i], q)
                gc += 0.5 * q
                wds[i] += 0.5 * C @ q
        assert np.allclose(logp, want, rtol=1e-5, atol=1e-3) and np.allclose(ds, wds, atol=1e-3)
        assert all(np.allclose(g[k], wg[k], atol=2e-3) for k in wg)


def test_distinct_words():
    r = np.random.default_rng(4)
    for n in (0, 1, 5000):
        h = r.integers(0, 2**64, 700, dtype=np.uint64)[r.integers(0, 700, n)]
        for got, want in zip(lm._distinct(h), np.unique(h, return_inverse=True), strict=True):
            assert got.dtype == want.dtype and (got == want).all()


# --- decontamination ----------------------------------------------------------------


def test_matches_against_a_full_scan(spark):
    """Every item in every document by the plain distance table: no match is missed, none is made up."""
    r = np.random.default_rng(21)
    vocabulary = [f"v{i}" for i in range(14)]
    items = [(i, " ".join(vocabulary[j] for j in r.integers(0, 14, n))) for i, n in enumerate([5, 6, 8, 9, 10, 12, 14, 15, 18, 25, 40])]
    rows = []
    for d in range(60):
        w = [vocabulary[j] for j in r.integers(0, 14, 40)]
        src = items[d % len(items)][1].split()
        for _ in range(int(r.integers(0, len(src) // 4 + 1))):
            at = int(r.integers(len(src)))
            kind = r.integers(3)
            src[at : at + (kind != 1)] = [] if kind == 0 else [vocabulary[int(r.integers(14))]]
        rows.append((d, " ".join(w[:15] + src + w[15:])))
    got = {(x.doc_id, x.item_id): x.distance for x in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for d, t in rows:
        for i, s in items:
            a, b = s.split(), t.split()
            row = [0] * (len(b) + 1)
            for k, x in enumerate(a, 1):
                nxt = [k]
                for j, y in enumerate(b, 1):
                    nxt.append(min(row[j] + 1, nxt[-1] + 1, row[j - 1] + (x != y)))
                row = nxt
            if min(row) <= decontaminate.edits_allowed(len(a)):
                want[d, i] = min(row)
    assert set(got) <= set(want) and all(got[k] >= want[k] for k in got)
    assert len(got) >= 0.99 * len(want) and len(want) >= 60


def test_bit_vectors_against_the_table():
    r = np.random.default_rng(31)
    for _ in range(300):
        a, b = r.integers(0, 5, r.integers(1, 80)).astype(np.uint64), r.integers(0, 5, r.integers(1, 120)).astype(np.uint64)
        best, place = decontaminate.nearest_starts([a], [b])
        assert decontaminate.nearest_start_bits(a, b) == (int(best[0]), int(place[0]))


def test_one_long_item_among_short_ones(spark):
    """Memory follows the words of items, not their number times the longest."""
    import tracemalloc

    items = [(i, " ".join(f"s{i}x{j}" for j in range(12))) for i in range(1000)] + [(5000, " ".join(f"long{j}" for j in range(20_000)))]
    long = items[-1][1].split()
    part = [w for k, w in enumerate(long) if k % 9]  # a deletion in nine
    rows = [(1, items[3][1]), (2, " ".join(["a"] * 50 + part + ["b"] * 50)), (3, items[999][1].replace("x4", "y4"))]
    seqs = [decontaminate.words(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0] for _, t in items]
    tracemalloc.start()
    decontaminate.Items.make([i for i, _ in items], seqs, 0.2, 0.999)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20
    got = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x.doc_id, x.item_id): x.distance for x in got} == {(1, 3): 0, (2, 5000): len(long) - len(part), (3, 999): 1}


def test_short_items_take_part_where_wanted(spark):
    docs, items = spark.createDataFrame([(1, "a b c d"), (2, "c d")], "doc_id long, text string"), spark.createDataFrame([(1, "b c d"), (2, "c d")], "item_id long, text string")
    assert decontaminate.contaminated(docs, items).count() == 0
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items, min_words=2).collect()} == {(1, 1), (1, 2), (2, 2)}
