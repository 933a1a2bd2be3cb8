"""Benchmark passages in documents: CGK embedding, bit-sampling LSH, edit check.

Texts are sequences of words.  An item and a document window of its size are
walked through by the same random rule (CGK): at each step the current word is
put out, and a coin that depends on step and word says whether to move on.
Texts a few edits apart soon walk in step again, so small edit distance becomes
small Hamming distance, and sampled places of the walk are LSH keys.
Repetitions with fresh coins and places bring the wanted recall; every
collision is decided by the exact edit distance.

Each deletion or insertion lets two walks drift, so agreement falls as their
number grows and no fixed count of repetitions holds for long items.  Keys
serve items that allow at most CGK_EDITS edits; places of longer items are
counted by item instead of by size and decided by exact distance, every one.

Windows are embedded only where a match is possible at all: a passage within k
edits of an item of L words keeps at least L - 1 - 2 k of its word pairs (the
q-gram lemma), so places with fewer pairs known from items hold no match.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import tidy
from .textscan import U64, gram_hashes, iter_words, mix, words

#: Edits allowed, as a share of the item's words, rounded down.
EDIT_SHARE = 0.2
#: Items of fewer words are too common to tell anything and take no part by default.
MIN_WORDS = 5
#: Items of more words are compared one at a time, with bit vectors instead of a table.
BIT_WORDS = 256
#: Places sampled for a key; agreement of walks that keys are designed for; wanted recall.
SAMPLES, AGREEMENT, RECALL = 3, 0.5, 0.999
#: Most edits at which walks keep that agreement, be they deletions or insertions.
CGK_EDITS = 2
#: Words of items that one pass over the documents looks for.
BLOCK_WORDS = 2_000_000
_CHUNK = 128


def repetitions(samples: int = SAMPLES, agreement: float = AGREEMENT, recall: float = RECALL) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - agreement**samples))


def edits_allowed(n_words: int, share: float = EDIT_SHARE) -> int:
    return int(n_words * share + 1e-9)


def cgk_keys(w: np.ndarray, row: np.ndarray, size: np.ndarray, reps: int, samples: int = SAMPLES) -> np.ndarray:
    """(pairs, repetitions) LSH keys of beginnings, ``size`` words long, of word-hash rows ``w`` (0: no word).

    A walk does not depend on the size, so each row is walked once; places are
    sampled from its first 1.6 * size steps, about four fifths of the words.
    """
    rng = np.random.Generator(np.random.PCG64(0xC6C))
    place = rng.random((reps, samples))
    salt = mix(np.arange(reps, dtype=np.uint64) + U64(0x5A17))
    out = np.empty((len(row), reps), np.uint64)
    padded = np.concatenate([w, np.zeros((len(w), 1), np.uint64)], 1)
    bound = np.searchsorted(row, np.arange(0, len(w) + _CHUNK, _CHUNK))  # row is sorted
    for c in range(len(bound) - 1):
        part, own = padded[c * _CHUNK : (c + 1) * _CHUNK], slice(bound[c], bound[c + 1])
        if not len(part) or bound[c] == bound[c + 1]:
            continue
        rows, rep = np.arange(len(part))[:, None], np.arange(reps)[None]
        steps = int(1.6 * int(size[own].max())) + 1
        at = np.zeros((len(part), reps), np.int64)
        trail = np.empty((steps, len(part), reps), np.uint64)
        for j in range(steps):
            sym = part[rows, np.minimum(at, w.shape[1])]
            trail[j] = sym
            at += (((sym ^ (salt + U64(j * 0x9E3779B97F4A7C15 % 2**64))) * U64(0xD6E8FEB86659FD93)) >> U64(63)).astype(np.int64)
        r, z = row[own] - c * _CHUNK, size[own]
        key = salt[None] + mix(z.astype(np.uint64))[:, None]
        for m in range(samples):
            pick = (place[None, :, m] * (1.6 * z)[:, None]).astype(np.int64)
            key = mix(key * U64(3) ^ trail[pick, r[:, None], rep])
        out[own] = key
    return out


def edit_distances(items: list[np.ndarray], windows: list[np.ndarray], limits: np.ndarray) -> np.ndarray:
    """Least edits turning each item into a beginning of its window; limit + 1 where more."""
    n = len(items)
    la, lb = np.array([len(x) for x in items]), np.array([len(x) for x in windows])
    a, b = np.zeros((n, la.max()), np.uint64), np.ones((n, lb.max()), np.uint64)
    for i in range(n):
        a[i, : la[i]], b[i, : lb[i]] = items[i], windows[i]
    col = np.arange(b.shape[1] + 1)
    row = np.broadcast_to(col, (n, len(col))).astype(np.int64)
    big = 1 << 20
    row = np.where(col[None] <= lb[:, None], row, big)
    best = np.where(la == 0, 0, big)
    for i in range(a.shape[1]):
        nxt = np.empty_like(row)
        nxt[:, 0] = i + 1
        nxt[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (a[:, i : i + 1] != b))
        # insertions: a running minimum of (cost - column) along the row
        nxt = np.minimum.accumulate(nxt - col, axis=1) + col
        row = np.where(col[None] <= lb[:, None], nxt, big)
        best = np.where(la == i + 1, row.min(1), best)
    return np.minimum(best, limits + 1)


def nearest_starts(items: list[np.ndarray], spans: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Least edits turning each item into a run of its span, and the first place where such a run begins.

    Both are read backwards, so that the last row has the least edits of every beginning.
    """
    n = len(items)
    la, lb = np.array([len(x) for x in items]), np.array([len(x) for x in spans])
    a, b = np.zeros((n, la.max()), np.uint64), np.ones((n, lb.max()), np.uint64)
    for i in range(n):
        a[i, : la[i]], b[i, : lb[i]] = items[i][::-1], spans[i][::-1]
    col = np.arange(b.shape[1] + 1, dtype=np.int32)
    row = np.zeros((n, len(col)), np.int32)  # a run may end anywhere
    last = np.empty_like(row)
    for i in range(a.shape[1]):
        nxt = np.empty_like(row)
        nxt[:, 0] = i + 1
        nxt[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (a[:, i : i + 1] != b))
        row = np.minimum.accumulate(nxt - col, axis=1) + col
        last[la == i + 1] = row[la == i + 1]
    last[col[None] > lb[:, None]] = 1 << 20
    best = last.min(1)
    # the largest place backwards is the first forwards
    back = last.shape[1] - 1 - (last == best[:, None])[:, ::-1].argmax(1)
    return best, lb - back


def nearest_start_bits(item: np.ndarray, span: np.ndarray) -> tuple[int, int]:
    """What :func:`nearest_starts` gives for one pair, by bit-parallel columns (Myers): memory is one bit an item word.

    A column of the table is two integers, the places where it rises and falls
    by one; both texts are read backwards, so the last entry of a column is the
    distance to a run that begins there.
    """
    m = len(item)
    has: dict[int, int] = {}
    for i, x in enumerate(item[::-1].tolist()):
        has[x] = has.get(x, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, cost = full, 0, m
    best, place = m, len(span)
    for j, x in enumerate(span[::-1].tolist(), 1):
        eq = has.get(x, 0)
        flat = (((eq & up) + up) ^ up) | eq | down
        rise, fall = down | (full & ~(flat | up)), up & flat
        cost += bool(rise & top) - bool(fall & top)
        rise, fall = (rise << 1) & full, (fall << 1) & full
        same = eq | down
        up, down = fall | (full & ~(same | rise)), rise & same
        if cost <= best:  # of equal ones the last backwards is the first forwards
            best, place = cost, len(span) - j
    return best, place


@dataclass
class Items:
    ids: np.ndarray
    seqs: list[np.ndarray]
    pairs: np.ndarray  # sorted distinct word-pair hashes of all items
    pair_at: np.ndarray  # where a pair's sizes begin in pair_sizes
    pair_sizes: np.ndarray  # numbers of the sizes of the items that have the pair
    item_at: np.ndarray  # where the items of a pair and size begin in pair_items
    pair_items: np.ndarray
    bloom: np.ndarray
    sizes: np.ndarray  # distinct lengths
    keys: np.ndarray  # sorted
    owner: np.ndarray
    reps: int
    share: float

    @classmethod
    def make(cls, ids: list[int], seqs: list[np.ndarray], share: float, recall: float) -> Items:
        reps = repetitions(recall=recall)
        length = np.array([len(s) for s in seqs])
        few = np.array([i for i, n in enumerate(length.tolist()) if edits_allowed(n, share) <= CGK_EDITS], np.int64)
        w = np.zeros((len(few), max(length[few], default=0)), np.uint64)
        for i, s in enumerate(few.tolist()):
            w[i, : length[s]] = seqs[s]
        keys = cgk_keys(w, np.arange(len(few)), length[few], reps)
        owner = np.repeat(few, reps)
        order = np.argsort(keys.ravel(), kind="stable")
        sizes = np.unique(length)
        every = np.concatenate([gram_hashes(s, 2) for s in seqs])
        pairs, which = np.unique(every, return_inverse=True)
        code = which * len(sizes) + np.searchsorted(sizes, np.repeat(length, length - 1))
        holder = np.repeat(np.arange(len(seqs)), length - 1)
        by = np.lexsort((holder, code))
        code, holder = code[by], holder[by]
        new = np.append(True, (code[1:] != code[:-1]) | (holder[1:] != holder[:-1]))
        code, holder = code[new], holder[new]
        both, item_at = np.unique(code, return_index=True)
        pair_at = np.searchsorted(both, np.arange(len(pairs) + 1) * len(sizes))
        bloom = np.zeros(1 << 22, bool)
        bloom[pairs >> U64(42)] = True
        return cls(np.array(ids), seqs, pairs, pair_at, both % len(sizes), np.append(item_at, len(code)), holder, bloom, sizes, keys.ravel()[order], owner[order], reps, share)


def _runs(hit: np.ndarray, group: np.ndarray, need: int, span: int) -> np.ndarray:
    """Where ``need`` hits of one group begin that lie within ``span`` words."""
    i = np.arange(max(0, len(hit) - need + 1))
    last = i + need - 1
    return i[(group[i] == group[last]) & (hit[last] + 1 - hit[i] < span)]


def _windows(h: np.ndarray, where: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int, int]]]:
    """(text, first word, size) of windows that may hold an item with few edits; of other items (text, item, first, last beginning)."""
    none = np.empty(0, np.int64)
    g = gram_hashes(h, 2)
    hit = np.flatnonzero(items.bloom[g >> U64(42)]) if len(g) else none
    if not len(hit):
        return none, none, none, []
    at = np.minimum(np.searchsorted(items.pairs, g[hit]), len(items.pairs) - 1)
    owner = np.searchsorted(where, hit, side="right") - 1
    real = (items.pairs[at] == g[hit]) & (hit + 1 < where[owner + 1])
    all_hit, all_text, at = hit[real], owner[real], at[real]
    # a size class counts only pairs that its own items have
    n = items.pair_at[at + 1] - items.pair_at[at]
    row = np.repeat(np.arange(len(at)), n)
    entry = np.repeat(items.pair_at[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    cls = items.pair_sizes[entry]
    order = np.argsort(cls, kind="stable")
    row, cls, entry = row[order], cls[order], entry[order]
    found, whole = [], []
    for c in np.unique(cls).tolist():
        size = int(items.sizes[c])
        own = slice(np.searchsorted(cls, c), np.searchsorted(cls, c, side="right"))
        hit, text = all_hit[row[own]], all_text[row[own]]
        k = edits_allowed(size, items.share)
        need = max(1, size - 1 - 2 * k)
        i = _runs(hit, text, need, size + k)
        if not len(i):
            continue
        if k > CGK_EDITS:
            whole += _places(hit, text, entry[own], i, where, items, size, k, need)
            continue
        starts = (hit[i][:, None] - np.arange(2 * k + 1)[None]).ravel()
        ok = starts >= where[np.repeat(text[i], 2 * k + 1)]
        code = np.unique(starts[ok])
        found.append((np.searchsorted(where, code, side="right") - 1, code, np.full(len(code), size)))
    if not found:
        return none, none, none, whole
    return *(np.concatenate(x) for x in zip(*found, strict=True)), whole


def _places(hit: np.ndarray, text: np.ndarray, entry: np.ndarray, runs: np.ndarray, where: np.ndarray, items: Items, size: int, k: int, need: int) -> list[tuple[int, int, int, int]]:
    """(text, item, first, last beginning) wherever pairs of one item suffice; only ``runs`` of the size's pairs are looked at."""
    edge = np.zeros(len(hit) + 1, np.int64)
    np.add.at(edge, runs, 1)
    np.add.at(edge, runs + need, -1)
    near = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    hit, text, entry = hit[near], text[near], entry[near]
    n = items.item_at[entry + 1] - items.item_at[entry]
    row = np.repeat(np.arange(len(entry)), n)
    item = items.pair_items[np.repeat(items.item_at[entry] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    order = np.argsort(item, kind="stable")
    item, hit, text = item[order], hit[row[order]], text[row[order]]
    group = item * len(where) + text
    i = _runs(hit, group, need, size + k)
    if not len(i):
        return []
    hit, text, item, group = hit[i], text[i], item[i], group[i]
    # neighbouring beginnings are looked at together, up to a length
    lo = np.maximum(hit - 2 * k, where[text])
    cut = (group[1:] != group[:-1]) | (lo[1:] > hit[:-1] + 1) | (hit[1:] // (4 * size) != hit[:-1] // (4 * size))
    first = np.append(0, np.flatnonzero(cut) + 1)
    last = np.append(first[1:], len(hit)) - 1
    return list(zip(text[first].tolist(), item[first].tolist(), lo[first].tolist(), hit[last].tolist(), strict=True))


def _matches(h: np.ndarray, where: np.ndarray, items: Items) -> list[tuple[int, int, int, int]]:
    """(text, item, first word, distance), the nearest place of each item in each text."""
    text, start, size, whole = _windows(h, where, items)
    best: dict[tuple[int, int], tuple[int, int]] = {}
    whole.sort(key=lambda x: len(items.seqs[x[1]]))
    while whole:
        part = whole[-256:]  # longest items last
        del whole[-len(part) :]
        seqs = [items.seqs[o] for _, o, _, _ in part]
        limit = [edits_allowed(len(x), items.share) for x in seqs]
        stop = [min(y + len(x) + k, int(where[t + 1])) for (t, _, _, y), x, k in zip(part, seqs, limit, strict=True)]
        spans = [h[p[2] : e] for p, e in zip(part, stop, strict=True)]
        if len(seqs[-1]) > BIT_WORDS:
            dist, place = (np.array(x) for x in zip(*map(nearest_start_bits, seqs, spans), strict=True))
        else:
            dist, place = nearest_starts(seqs, spans)
        for (t, o, x, _), d, s, k in zip(part, dist.tolist(), place.tolist(), limit, strict=True):
            if d <= k:
                value = (d, int(x + s - where[t]))
                best[t, o] = min(best.get((t, o), value), value)
    for lo in range(0, len(text), 8192):
        t, s, z = text[lo : lo + 8192], start[lo : lo + 8192], size[lo : lo + 8192]
        first, row = np.unique(s, return_inverse=True)
        order = np.argsort(row, kind="stable")
        t, s, z, row = t[order], s[order], z[order], row[order]
        end = where[np.searchsorted(where, first, side="right")]
        col = first[:, None] + np.arange(int(z.max()))[None]
        w = np.where(col < end[:, None], h[np.minimum(col, len(h) - 1)], U64(0))
        keys = cgk_keys(w, row, z, items.reps)
        a, b = np.searchsorted(items.keys, keys.ravel()), np.searchsorted(items.keys, keys.ravel(), side="right")
        live = np.flatnonzero(b > a)
        n = (b - a)[live]
        win = np.repeat(live // items.reps, n)
        own = items.owner[np.repeat(a[live] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        code = np.unique(win * len(items.seqs) + own)
        for clo in range(0, len(code), 1024):
            win, own = np.divmod(code[clo : clo + 1024], len(items.seqs))
            seqs = [items.seqs[o] for o in own]
            limit = np.array([edits_allowed(len(x), items.share) for x in seqs])
            stop = np.minimum(s[win] + z[win] + limit, where[t[win] + 1])
            d = edit_distances(seqs, [h[x:y] for x, y in zip(s[win], stop, strict=True)], limit)
            for i in np.flatnonzero(d <= limit):
                key, value = (int(t[win[i]]), int(own[i])), (int(d[i]), int(s[win[i]] - where[t[win[i]]]))
                best[key] = min(best.get(key, value), value)
    return [(t, o, s, d) for (t, o), (d, s) in sorted(best.items())]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, limit: int, least: int):
    """Items in blocks of about ``limit`` words; a longer item is a block of its own."""
    ids, seqs, total = [], [], 0
    for r in benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where("i is not null and t is not null").orderBy("i", "t").toLocalIterator():
        raw = np.frombuffer(r.t.encode(), np.uint8)
        h = words(raw, np.array([0, len(raw)]))[0]
        if len(h) < max(least, 2):
            continue
        if total and total + len(h) > limit:
            yield ids, seqs
            ids, seqs, total = [], [], 0
        ids.append(r.i)
        seqs.append(h)
        total += len(h)
        if total >= limit:
            yield ids, seqs
            ids, seqs, total = [], [], 0
    if ids:
        yield ids, seqs


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", share: float = EDIT_SHARE, recall: float = RECALL, block_words: int = BLOCK_WORDS, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, item_id, start_word, distance: each benchmark item found in each document.

    A match is a run of document words within floor(share * words) word edits
    of a whole item; A-Z are lower-cased, words end at white space.  One row a
    document row and item: the place with fewest edits, of these the first.
    Items are read in blocks of bounded size, one pass over the documents each,
    so no broadcast grows with the benchmark.  Document ids are numbers or
    structs.  Null and empty texts match nothing; documents and items of any
    length are read whole, and a long item costs memory in proportion to its
    words only; items of under ``min_words`` words (2 at least, a pair of words
    being what is looked up), and rows without item id or text, take no part;
    document rows without id are reported with a null id; repeated rows are
    reported each.  Other columns are not read.  Empty tables give an empty
    result.
    """
    spark = docs.sparkSession
    struct = isinstance(docs.schema[id_col].dataType, T.StructType)
    src = docs.select((F.col(id_col) if struct else F.col(id_col).cast("long")).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = f"doc_id {src.schema['doc_id'].dataType.simpleString()}, item_id long, start_word int, distance int"
    out = spark.createDataFrame([], schema)
    for ids, seqs in _blocks(benchmark, item_col, item_text_col, block_words, min_words):
        items = Items.make(ids, seqs, share, recall)

        @tidy
        def run(batches, items=items):
            for b in batches:
                found = []
                for lo, _, (h, where) in iter_words(b.column(1)):
                    found += [(lo + t, o, s, d) for t, o, s, d in _matches(h, where, items)]
                if found:
                    rows = b.column(0).take(pa.array([f[0] for f in found]))
                    yield pa.RecordBatch.from_arrays([rows, pa.array(items.ids[[f[1] for f in found]]), pa.array([f[2] for f in found], pa.int32()), pa.array([f[3] for f in found], pa.int32())], names=["doc_id", "item_id", "start_word", "distance"])

        out = out.union(src.mapInArrow(run, schema))
    return out
