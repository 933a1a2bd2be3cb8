"""Nulls, empty and very long texts, ties, repeats, empty tables, clashing columns."""

import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.llm import language_id, lm, packing, quality, rans, sharding, token_files, vptree, warc
from sightline.llm.decontaminate import contaminated, edit_distances, nearest_starts
from sightline.llm.near_duplicates import near_duplicates
from sightline.llm.tokens import PieceEncoder, tokenizer_file

WORDS = [f"w{i}" for i in range(400)]


def text(seed, n):
    r = np.random.default_rng(seed)
    return " ".join(WORDS[i] for i in r.integers(0, len(WORDS), n))


def edited(t, k, seed):
    r, w = np.random.default_rng(seed), t.split(" ")
    for i in r.choice(len(w), k, replace=False):
        w[i] = f"e{seed}x{i}"
    return " ".join(w)


BASE, LONG = text(1, 200), text(2, 60_000)
ROWS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "ONE  two"), (6, BASE), (7, BASE), (7, BASE), (8, edited(BASE, 3, 8)), (9, edited(BASE, 3, 9)), (10, edited(BASE, 60, 10)),
    (11, LONG), (12, LONG + " tail"), (None, BASE), (13, text(3, 50)), (14, "aé ß 😀".encode("utf-16", "surrogatepass").decode("utf-16")),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    clash = {c: F.lit(i) for i, c in enumerate(("score", "lang_pred", "fp", "bucket", "shard", "size", "a", "b", "n", "lang", "start", "piece", "row", "__text"))}
    return df.withColumns(clash)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    comp = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if rows[i][0] is None or rows[j][0] is None or not sets[i]:
            continue
        c = len(sets[i] & sets[j])
        if 100 * c >= 75 * len(sets[i] | sets[j]):
            comp = [comp[i] if x == comp[j] else x for x in comp]
    ids = {c: min((r[0] for r, x in zip(rows, comp, strict=True) if x == c and r[0] is not None), default=None) for c in comp}
    return sorted(((r[0], len(s), ids[c] if r[0] is not None else None) for r, s, c in zip(rows, sets, comp, strict=True)), key=repr)


def test_near_duplicates(docs, empty):
    got = near_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(ROWS)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)
    assert near_duplicates(empty).count() == 0


def test_near_duplicates_hot_group(spark):
    """Copies that mostly differ from each other more than from the base: chains and mixed buckets."""
    rows = [(i, edited(BASE, 1 + i % 12, i)) for i in range(300)] + [(1000 + i, text(i, 40)) for i in range(30)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows)


def test_language(spark, docs, empty):
    train = spark.createDataFrame([("en", "the quick brown fox and the other thing"), ("de", "der schnelle braune fuchs und das andere"), (None, "nothing")], "lang string, text string")
    p = language_id.train(train)
    assert p.languages == ("de", "en")
    got = {r.doc_id: r for r in language_id.predict(spark.createDataFrame([(1, "the fox and the thing"), (2, "und der fuchs"), (3, None), (4, "12 !!"), (5, "x" * 300_000)], "doc_id long, text string"), p).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4)] == ["en", "de", "und", "und"] and got[3].score == 0 and all(0 <= r.score <= 1 for r in got.values())
    assert language_id.predict(docs, p).count() == len(ROWS) and language_id.predict(empty, p).count() == 0
    nothing = language_id.train(train.where("false"))
    assert {r.lang_pred for r in language_id.predict(docs, nothing).collect()} == {"und"}


def test_language_of_one_letter_beside_other_texts():
    texts = ["A", "1 b", "ab", "12", "c ", "dog"]
    def grams(some):
        raw = [t.encode() for t in some]
        doc, gram = language_id.trigrams(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        return [gram[doc == i].tolist() for i in range(len(some))]
    assert grams(texts) == [grams([t])[0] for t in texts]
    assert [bool(g) for g in grams(texts)] == [True, True, True, False, True, True]


def test_quality(spark, docs, empty):
    rows = [(i, " ".join(w + ("$$$" if i % 2 else "") for w in text(i, 60).split())) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = d.select("doc_id", (1 - F.col("doc_id") % 2).cast("int").alias("quality")).union(spark.createDataFrame([(None, 1), (5, None)], "doc_id long, quality int"))
    m = quality.train(d, labels.where("doc_id < 300 or doc_id is null"))
    held = [r for r in quality.score(d, m).collect() if r.doc_id >= 300]
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 2 == 0) for r in held]) > 0.97
    got = quality.score(docs, m).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got) and quality.score(empty, m).count() == 0
    assert quality.score(docs, quality.train(d, labels.where("false"))).count() == len(ROWS)


def test_sharding(spark, docs, empty, tmp_path):
    path = f"file://{tmp_path}/map"
    got = sharding.shard(docs, 3, map_path=path).collect()
    assert len(got) == len(ROWS) and all(r.size == len((t or "").encode()) + 16 for r, t in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0)), [t for _, t in sorted(ROWS, key=lambda x: (x[0] is None, x[0] or 0))], strict=True))
    for s in range(3):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard(empty, 3).count() == 0
    grown = {(r.doc_id, r.vslot, r.text_crc32): r.shard for r in sharding.shard(docs, 4, map_path=path).collect()}
    first, second = sharding.load_map(spark, path, 0), sharding.load_map(spark, path)
    assert (first.version, first.shards, second.version, second.shards) == (0, 3, 1, 4)
    assert all(grown[r.doc_id, r.vslot, r.text_crc32] == second.shard_of[r.vslot] and r.shard == first.shard_of[r.vslot] for r in got)
    spread = np.bincount(second.shard_of, minlength=4)
    assert spread.min() > 0.9 * spread.mean() and (first.shard_of == second.shard_of).mean() > 0.7
    with pytest.raises(ValueError):
        sharding.shard(docs, 4, map_path=path, slots=64)
    # few rows in many shards: the count is kept, empty slots are spread
    wide = sharding.assign(np.array([5, 0, 0, 7, 0, 0, 0, 0]), 4)
    assert wide.shards == 4 and np.bincount(wide.shard_of).min() >= 1
    size = np.random.default_rng(1).integers(1, 1000, 4000)
    m = sharding.assign(size, 10)
    grown = sharding.rebalance(m, size, 11)
    load = np.bincount(grown.shard_of, weights=size)
    assert load.max() <= 1.01 * load.mean() and ((grown.shard_of == m.shard_of) | (grown.shard_of == 10)).mean() > 0.95


def test_range_coder():
    r = np.random.default_rng(1)
    ids = np.concatenate([r.zipf(1.3, 100_000) % 5000, [4999] * 7]).astype(np.uint32)
    t = rans.Table(rans.quantise(np.bincount(ids, minlength=5000)))
    for n in (0, 1, 15, 16384, 16385, len(ids)):
        data = rans.pack(np.array([5]), np.array([1]), np.array([n]), ids[:n], t)
        assert (rans.unpack(data, t)[3] == ids[:n]).all()
    assert len(data) < 2 * len(ids)
    with pytest.raises(ValueError):
        rans.unpack(data[:-9] + b"x" + data[-8:], t)


def test_token_files(docs, empty):
    path = tokenizer_file("byte_bpe_50k.json")
    got = token_files.token_index(docs, path, 2).orderBy("start").collect()
    enc = PieceEncoder.get(path, "bytes").tok
    start, seen = 0, []
    for r in got:
        assert r.start == start
        start += r.n_tokens
        seen.append((r.doc_id, r.n_tokens, r.ids_crc32))
    want = []
    for i, t in ROWS:
        ids = np.array(enc.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((i, len(ids), zlib.crc32(ids.tobytes())))
    assert sorted(seen, key=repr) == sorted(want, key=repr)
    assert [s[0] for s in seen] == sorted((i for i, _ in ROWS), key=lambda i: -1 if i is None else i)
    assert token_files.token_index(empty, path, 2).count() == 0


@pytest.mark.parametrize(("name", "kind"), [("byte_bpe_50k.json", "bytes"), ("word_bpe_49k.json", "words")])
def test_piece_encoder_equals_library(name, kind):
    import pyarrow as pa

    r = np.random.default_rng(3)
    parts = ["a", "B", "'s", "'", "re", " ", "  ", "\n", "\t", "\r\n", ".", "!!", "1", "é", "ß", "Ω", " ", " ", "́", "日本", "it's", "x_y", "$$$", "'LL", "<|endoftext|>", "\x1c", "İ", "²"]
    texts = ["".join(parts[i] for i in r.integers(0, len(parts), r.integers(0, 30))) for _ in range(1500)] + [None, "", "x" * 50_000 + " " * 50_000]
    e = PieceEncoder.get(tokenizer_file(name), kind)
    got = []
    for lo, hi, ids, n in e.encode(pa.array(texts)):
        at = np.concatenate([[0], np.cumsum(n)])
        got += [ids[at[i] : at[i + 1]].tolist() for i in range(hi - lo)]
    assert got == [x.ids for x in e.tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_packing(docs, empty):
    path = tokenizer_file("word_bpe_49k.json")
    got = packing.pack(docs, path, 0).toPandas()
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g.offset.to_numpy() == np.cumsum(g.length) - g.length).all() and g.length.sum() <= 2048
    for _, g in got[got.doc_id.notna() & (got.doc_id != 7)].groupby("doc_id"):
        g = g.sort_values("piece")
        assert g.piece.tolist() == list(range(len(g))) and (g.length.iloc[:-1] == 2048).all()
    assert packing.pack(empty, path, 0).count() == 0
    bins, _ = packing.pack_lengths(np.array([6, 5, 4, 3]), 9)  # 6 + 3; 5 + 4
    assert bins.max() == 1
    # greedy takes 6, 3 and leaves a gap of 1 of 10; the 3 gives way to 2 + 2
    bins, _ = packing.pack_lengths(np.array([6, 3, 2, 2]), 10)
    assert sorted(np.bincount(bins, weights=[6, 3, 2, 2]).tolist()) == [3, 10]


@pytest.mark.parametrize("leaf", [8, 512])
def test_vptree(spark, leaf):
    r = np.random.default_rng(5)
    x = r.normal(size=(700, 16)).astype(np.float32)
    x[100:160] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(700, None), (701, [0.0] * 16), (702, [float("nan")] * 16), (703, [None] * 16), (704, [1.0]), (None, x[1].tolist()), (3, x[3].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1))
    d = x.astype(float)
    for factor, shard, least in ((1.0, 150, 1.0), (vptree.FACTOR, 10_000, 0.9)):
        got = vptree.search(df, 20, 20, factor, shard_rows=shard, leaf=leaf).toPandas().sort_values(["query_id", "rank"])
        hit = 0
        for q in range(0, 700, 20):
            s = np.einsum("ij,j->i", d, d[q])
            best = [i for i in np.lexsort((np.arange(700), -np.round(s, 12))) if i != q][:20]
            mine = got[got.query_id == q].vec_id.tolist()
            assert len(mine) == 20
            hit += len(set(mine) & set(best))
            if factor == 1:
                assert mine == best
        assert hit >= least * 35 * 20
    assert vptree.search(df.where("false")).count() == 0


def test_warc(spark):
    pages = spark.createDataFrame([(1, "http://a b", "x"), (2, None, "x"), (3, "u", None), (4, "u", ""), (5, "u", "é\r\n\r\n" * 9), (None, "u", "x"), (1, "http://a b", "x"), (6, "u", "y" * 300_000)], "page_id long, url string, html string").withColumn("size", F.lit(1))
    got = {(r.page_id, r.record_type, r.refers_to): r for r in warc.archive(pages).collect()}
    assert set(got) == {(1, "response", None), (2, "revisit", 1), (3, "response", None), (4, "revisit", 3), (5, "response", None), (None, "revisit", 1), (6, "response", None)}
    assert got[2, "revisit", 1].payload is None and got[2, "revisit", 1].payload_bytes == 1 and bytes(got[5, "response", None].payload) == ("é\r\n\r\n" * 9).encode()
    assert warc.archive(pages).count() == 8 and warc.archive(pages.where("false")).count() == 0
    assert {r.record_type for r in warc.archive(pages, min_bytes=100).collect()} == {"response"}


def test_lm(spark, docs, empty):
    held = F.col("doc_id") == 10
    got = {(r.doc_id, r.n_tokens): r for r in lm.score(docs, held).collect()}
    assert len(got) < len(ROWS) + 1 and got[1, 1].n_known == 1 and got[10, 201].held_out and not got[6, 201].held_out
    assert got[10, 201].n_known < 201 and all(np.isfinite(r.score) for r in got.values())
    # a repeated text is learnt
    assert got[6, 201].score > got[6, 201].base_score
    assert lm.score(empty, F.lit(False)).count() == 0
    assert all(r.score == r.base_score == 0 for r in lm.score(docs.where("doc_id = 6"), F.lit(True)).collect())


def test_lm_shortlist_grows(spark, monkeypatch):
    """More than 1024 words have inputs and outputs of their own where the vocabulary is large."""
    made = []
    monkeypatch.setattr(lm, "GROWTH", 16)
    monkeypatch.setattr(lm.gru.Model, "unigram", classmethod(lambda cls, p, seed=9, make=lm.gru.Model.unigram.__func__: made.append(make(cls, p, seed)) or made[-1]))
    rows = [(i, " ".join(f"v{(7 * i + j) % 9000}" for j in range(90))) for i in range(1300)]
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") < 0).collect()
    assert made[0].words == lm.shortlist_words(9001) > 1024 and made[0].classes <= made[0].width < 1.1 * made[0].words**0.5
    assert len(got) == 1300 and all(np.isfinite(r.score) for r in got)
    assert lm.shortlist_words(4_000_000) == 2 * lm.shortlist_words(1_000_000)


def test_lm_learning_grows(monkeypatch):
    """Updates grow with a chunk's tokens, rounds with the number of chunks."""
    steps = []
    monkeypatch.setattr(lm.gru.Adagrad, "step", lambda self, *_: steps.append(1))
    made = []
    for docs in (50, 2000):
        length = np.full(docs, 200)
        steps.clear()
        lm.gru.run(lm.gru.Model.unigram(np.full(9, 1 / 9)), np.zeros(200 * docs, np.int64), np.cumsum(length) - length, length, 0, 0.1)
        made.append(len(steps))
    assert made[0] >= 30 and 200 * 2000 / made[1] <= 64 * 256
    assert [lm.rounds_for(n) for n in (0, 1, 7, 8, 63, 64, 4096)] == [1, 1, 1, 2, 2, 3, 5]


def test_decontamination(spark, empty):
    items = [(i, text(100 + i, 20 + i)) for i in range(12)]
    bench = spark.createDataFrame([*items, (50, None), (51, "too short"), (None, BASE)], "item_id long, text string").withColumn("doc_id", F.lit(0))
    rows = [(i, f"{text(i, 30)} {edited(t, k, i) if k else t.upper()} {text(50 + i, 30)}") for i, t in items for k in [len(t.split()) * (i % 5) // 20]]
    rows += [(100, None), (101, ""), (102, LONG), (103, items[0][1]), (None, items[1][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit(9))
    got = {(r.doc_id, r.item_id): r.distance for r in contaminated(docs, bench).collect()}
    assert {k for k in got if k[0] is not None and k[0] < 100} == {(i, i) for i, _ in items} and got[103, 0] == 0 and (None, 1) in got
    assert all(got[i, i] == len(t.split()) * (i % 5) // 20 for i, t in items)
    blocks = {(r.doc_id, r.item_id): r.distance for r in contaminated(docs, bench, block_words=60).collect()}
    assert blocks == got
    assert contaminated(empty, bench).count() == 0 and contaminated(docs, bench.where("false")).count() == 0


@pytest.mark.parametrize("kind", ["deletions", "insertions", "contiguous"])
def test_decontamination_recall_at_the_limit(spark, kind):
    """Items of 14 to 500 words with as many insertions or deletions as allowed: all are found."""
    r = np.random.default_rng(11)
    items, rows = [], []
    for n, copies in ((14, 40), (60, 40), (120, 20), (500, 3)):
        for _ in range(copies):
            i, k = len(items), n // 5
            w = [f"i{i}x{j}" for j in range(n)]
            items.append((i, " ".join(w)))
            if kind == "deletions":
                w = [w[j] for j in sorted(r.choice(n, n - k, replace=False))]
            elif kind == "contiguous":
                at = int(r.integers(1, n - k))
                w = w[:at] + w[at + k :]
            else:
                for j in range(k):
                    w.insert(int(r.integers(1, len(w))), f"n{j}")
            rows.append((i, f"{text(i, 30)} {' '.join(w)} {text(50 + i, 30)}"))
    found = contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x.doc_id, x.item_id) for x in found} == {(i, i) for i, _ in items}


def test_nearest_starts_against_brute_force():
    r = np.random.default_rng(3)
    items = [r.integers(0, 4, r.integers(1, 9)).astype(np.uint64) for _ in range(80)]
    spans = [r.integers(0, 4, r.integers(1, 14)).astype(np.uint64) for _ in range(80)]
    best, place = nearest_starts(items, spans)
    for a, b, d, s in zip(items, spans, best.tolist(), place.tolist(), strict=True):
        each = [int(edit_distances([a], [b[i:]], np.array([99]))[0]) for i in range(len(b))] + [len(a)]
        assert d == min(each) and s == each.index(d)


def test_edit_distance_against_brute_force():
    r = np.random.default_rng(2)
    for _ in range(60):
        a, b = r.integers(0, 4, r.integers(1, 9)).astype(np.uint64), r.integers(0, 4, r.integers(1, 12)).astype(np.uint64)
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            d = _row(d, x, b, i)
        assert edit_distances([a], [b], np.array([99]))[0] == min(d)


def _row(d, x, b, i):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(d[j] + 1, out[-1] + 1, d[j - 1] + (x != y)))
    return out
