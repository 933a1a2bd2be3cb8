"""Near-duplicate components: MinHash bands, Odd sketches, exact verification.

Plan
----
1. One Arrow pass gives each document its shingle set's fingerprint, MinHash
   band keys and an Odd sketch: every MinHash sample toggles one bit of a
   256-bit map, so the population count of two maps' XOR tells how many samples
   differ, and with it the similarity, most precisely where it is high.
2. Documents with equal sets collapse to a class at once (a grouped minimum),
   whose smallest (id, text hash) stands for it and which gets a number of
   eight bytes; buckets, links and components are of these numbers.
3. In every band bucket each class is paired with the bucket's smallest class
   only: linear in the bucket, however hot it is.
4. Sketch estimates discard hopeless pairs, full sets decide the others.
5. Links become components by alternating star contraction.  Joins on nodes,
   roots and fingerprints deal the rows of a hot key over many tasks.
6. Buckets that still hold several components are searched whole: their
   members meet in blocks of bounded size inside which numpy compares classes
   of different components, by sketch and then on full sets, and emits only
   links that join components.  No link found by banding is lost and no bucket
   is capped.  A bucket of b blocks sends each member to b pairs of blocks, so
   this step is quadratic in buckets with very many dissimilar members.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SALTS, Workspace, salted_join, tidy
from .textscan import U64, iter_words, mix, shingle_set

SHINGLE_WORDS = 5
BANDS, ROWS = 32, 4
SKETCH_BITS = 256
NUM, DEN = 75, 100
#: Most classes and shingles of a bucket in one block.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 21
#: Pairs of one pivot that share a copy of its set.
PIVOT_PAIRS = 512

_rng = np.random.Generator(np.random.PCG64(0x0DD))
_A = (_rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint64) | U64(1)).astype(np.uint32)[:, None]
_B = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)[:, None]
_LANE = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64))
_BAND = mix(np.arange(1001, 1001 + BANDS, dtype=np.uint64))


def minhash(shingles: np.ndarray) -> np.ndarray:
    """128 minima of independent multiply-add permutations over 32-bit hashes."""
    h = (shingles >> U64(32)).astype(np.uint32)
    out = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(h), 2048):
        x = _A * h[i : i + 2048]
        x += _B
        np.minimum(out, x.min(axis=1), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key a band; ``sig`` is (documents, 128)."""
    x = mix(sig.astype(np.uint64) + _LANE).reshape(len(sig), BANDS, ROWS)
    k = x[:, :, 0] * U64(3)
    for r in range(1, ROWS):
        k = mix(k + x[:, :, r] * U64(2 * r + 3))
    return mix(k ^ _BAND)


def odd_sketch(sig: np.ndarray) -> np.ndarray:
    """(documents, 4) 64-bit words: the parity of samples falling on each of 256 bits."""
    pos = (mix(sig.astype(np.uint64) * U64(0x9E3779B97F4A7C15) + _LANE) >> U64(56)).astype(np.int64)
    flat = np.bincount((pos + np.arange(len(sig))[:, None] * SKETCH_BITS).ravel(), minlength=len(sig) * SKETCH_BITS)
    bits = (flat & 1).astype(np.uint8).reshape(len(sig), SKETCH_BITS)
    return np.packbits(bits, axis=1).view(np.uint64)


def sketch_limit(num: int = NUM, den: int = DEN, sigmas: float = 6.0) -> int:
    """Largest XOR population count that a pair at the threshold can plausibly show."""
    k, n = BANDS * ROWS, SKETCH_BITS
    differ = 1 - num / den
    worst = min(1.0, differ + sigmas * math.sqrt(differ * (1 - differ) / k))
    toggles = 2 * k * worst
    mean = n / 2 * (1 - (1 - 2 / n) ** toggles)
    return min(n, math.ceil(mean + 3 * math.sqrt(n) / 2))


def jaccard_estimate(xor_bits: Column) -> Column:
    """Similarity from an XOR population count (the Odd sketch estimator)."""
    n, k = float(SKETCH_BITS), float(BANDS * ROWS)
    return 1.0 + F.log(F.greatest(F.lit(1e-9), 1.0 - 2.0 * xor_bits / n)) * n / (4.0 * k)


def _rows(batches, id_col: str, text_col: str) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index(id_col))
        for lo, hi, (h, where) in iter_words(batch.column(batch.schema.get_field_index(text_col))):
            yield ids.slice(lo, hi - lo), [shingle_set(h[where[i] : where[i + 1]], SHINGLE_WORDS) for i in range(hi - lo)]


def _fingerprint(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def signatures(docs: DataFrame) -> DataFrame:
    """key, n_shingles, fp (fingerprint; null for an empty set), bands, s0..s3, salt (a running number) of (key, text)."""

    @tidy
    def run(batches):
        count = 0
        for ids, sets in _rows(batches, "key", "text"):
            sig = np.stack([minhash(s) for s in sets])
            keys = band_keys(sig).view(np.int64)
            sk = odd_sketch(sig).view(np.int64)
            full = np.array([len(s) > 0 for s in sets])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(sets) * BANDS + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel()))
            salt = pa.array(np.arange(count, count + len(sets)))
            count += len(sets)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([len(s) for s in sets], pa.int64()), pa.array([_fingerprint(s) for s in sets], pa.binary()), lists, *(pa.array(sk[:, i].copy(), mask=~full) for i in range(4)), salt],
                names=["key", "n_shingles", "fp", "bands", "s0", "s1", "s2", "s3", "salt"],
            )

    kind = docs.schema["key"].dataType.simpleString()
    return docs.mapInArrow(run, f"key {kind}, n_shingles long, fp binary, bands array<long>, s0 long, s1 long, s2 long, s3 long, salt long")


def _sets(docs: DataFrame) -> DataFrame:
    """One row (fp, shingles) a distinct set, however often its text repeats."""

    @tidy
    def run(batches):
        for _, sets in _rows(batches, "key", "text"):
            off = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([_fingerprint(s) for s in sets], pa.binary()), lists], names=["fp", "shingles"])

    return docs.mapInArrow(run, "fp binary, shingles array<long>").groupBy("fp").agg(F.first("shingles").alias("shingles"))


def _sets_of(reps: DataFrame, docs: DataFrame) -> DataFrame:
    """Sets of the classes that ``reps`` stand for, one text a class cut anew; eight bytes tell a row, sets by mistake match nothing."""
    wanted = reps.select(F.col("rep.h").alias("h")).distinct()
    return _sets(docs.withColumn("h", F.col("key.h")).join(wanted, "h", "left_semi"))


def _xor_bits(a: str, b: str) -> Column:
    return sum((F.bit_count(F.col(f"{a}s{i}").bitwiseXOR(F.col(f"{b}s{i}"))) for i in range(1, 4)), F.bit_count(F.col(f"{a}s0").bitwiseXOR(F.col(f"{b}s0"))))


def _verified(ws: Workspace, pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (a, b) of class numbers whose full sets reach the threshold; staged."""
    side = lambda p: classes.select(F.col("cls").alias(p), *(F.col(c).alias(f"{p}{c}") for c in ("n", "fp", "rep", "s0", "s1", "s2", "s3")))
    near = (
        pairs.join(side("a"), "a")
        .join(side("b"), "b")
        .where((_xor_bits("a", "b") <= sketch_limit()) & (F.least("an", "bn") * DEN >= F.greatest("an", "bn") * NUM))
        .select("a", "b", "afp", "bfp", "arep", "brep", "an", "bn")
    )
    near = ws.stage(near, "near")
    # whole texts of the classes concerned only, one text a class, cut to sets anew
    # both joins read one shuffle of the sets
    sets = _sets_of(near.select(F.col("arep").alias("rep")).union(near.select("brep")), docs)
    x, y = (sets.select(F.col("fp").alias(f"{p}fp"), F.col("shingles").alias(v)) for p, v in (("a", "x"), ("b", "y")))
    # a class is b in one pair a band at most; as a it may be the pivot of any number, which copies of its set share
    hot = near.groupBy("afp").agg(F.count("*").alias("pairs")).where(F.col("pairs") > PIVOT_PAIRS)
    hot = ws.stage(hot.select("afp", F.ceil(F.col("pairs") / PIVOT_PAIRS).cast("int").alias("parts")), "hot")
    near_x = near.drop("arep", "brep")
    if hot.head(1):
        dealt = near_x.join(hot, "afp", "left").withColumn("part", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int"))
        copies = x.join(hot, "afp", "left").select("afp", "x", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
        near_x = dealt.drop("parts").join(copies, ["afp", "part"]).drop("part")
    else:
        near_x = near_x.join(x, "afp")
    both = (
        near_x.join(y, "bfp")
        .withColumn("common", F.size(F.array_intersect("x", "y")).cast("long"))
        .where(F.col("common") * DEN >= (F.col("an") + F.col("bn") - F.col("common")) * NUM)
        .select("a", "b")
    )
    out = ws.stage(both, "links")
    ws.drop(near, hot)
    return out


def components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of ``edges`` (a, b).

    Alternating large-star and small-star steps.  The rows of a node with any
    number of neighbours are dealt over SALTS tasks: minima are taken a (node,
    salt) pair first, and only these pairs meet at the node.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        e = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v")
        if large:
            e = e.union(e.select(F.col("v"), F.col("u")).toDF("u", "v"))
        e = e.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
        part = e.groupBy("u", "salt").agg(F.min("v").alias("m"))
        low = part.groupBy("u").agg(F.min("m").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = e.join(part.select("u", "salt").join(low, "u"), ["u", "salt"])
        if large:
            return moved.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        return moved.select(F.col("v").alias("a"), F.col("m").alias("b")).where("a != b").union(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()

    state, cur = None, None
    while True:
        # a step reads its edges several times: staged in between, plans stay small
        mid = ws.stage(star(edges if cur is None else cur, True), "large")
        nxt = ws.stage(star(mid, False), "star")
        ws.drop(mid)
        new = tuple(nxt.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
        if cur is not None:
            ws.drop(cur)
        cur = nxt
        if new == state:
            break
        state = new
    return cur.select(F.col("a").alias("node"), F.col("b").alias("root")).union(cur.select("b", "b").distinct())


def _block_links(t: pa.Table, same: bool) -> list[tuple[int, int]]:
    """Links that join components inside one block of a bucket, each verified on full sets.

    Sketches choose whom a class is compared with; classes that a link has
    joined meanwhile are not compared again, so links are at most as many as
    rows, whatever the bucket's size.
    """
    cls = t.column("cls").to_numpy()
    roots, label = np.unique(t.column("root").to_numpy(), return_inverse=True)
    if len(roots) < 2:
        return []
    n = t.column("n").to_numpy()
    # unsigned: of negative numbers numpy counts the magnitude's bits
    sk = np.stack([t.column(f"s{k}").to_numpy() for k in range(4)], 1).view(np.uint64)
    left = t.column("left").to_numpy(zero_copy_only=False)
    lists = t.column("shingles").combine_chunks()
    flat = lists.flatten().to_numpy()
    _, flat = np.unique(flat, return_inverse=True)
    start = np.concatenate([[0], np.cumsum(n)])
    mark = np.zeros(int(flat.max()) + 1, bool)
    limit, out = sketch_limit(), []
    targets = np.arange(len(cls)) if same else np.flatnonzero(~left)
    for x in np.flatnonzero(left):
        y = targets[label[targets] != label[x]]
        if same:
            y = y[y > x]
        y = y[np.minimum(n[y], n[x]) * DEN >= np.maximum(n[y], n[x]) * NUM]
        y = y[np.bitwise_count(sk[y] ^ sk[x]).sum(1) <= limit]
        if not len(y):
            continue
        own = flat[start[x] : start[x + 1]]
        mark[own] = True
        if n[y].sum() * 4 > len(flat):
            common = np.add.reduceat(mark[flat], start[:-1], dtype=np.int64)[y]
        else:
            common = np.array([np.count_nonzero(mark[flat[start[v] : start[v + 1]]]) for v in y])
        mark[own] = False
        for v in y[common * DEN >= (n[y] + n[x] - common) * NUM]:
            if label[v] != label[x]:
                label[label == label[v]] = label[x]
                out.append((int(min(cls[x], cls[v])), int(max(cls[x], cls[v]))))
    return out


def _mixed_links(ws: Workspace, bands: DataFrame, classes: DataFrame, comp: DataFrame, docs: DataFrame) -> DataFrame:
    """Verified links between different components that share a bucket."""
    rows = bands.join(comp, bands.cls == comp.node, "left").select("bucket", "cls", F.coalesce("root", "cls").alias("root"))
    mixed = rows.join(classes.select("cls", "n"), "cls").groupBy("bucket").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 != r1 and size > 2")
    mixed = mixed.select("bucket", F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    rows = ws.stage(rows.join(mixed, "bucket").join(classes, "cls"), "mixed")
    sets = _sets_of(rows.select("rep"), docs)
    # a bucket's members meet in blocks: member k of block b goes to all pairs of blocks with b
    rows = rows.join(sets, "fp").withColumn("mine", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("bucket", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") <= F.col("other")).alias("left"), "cls", "root", "n", "s0", "s1", "s2", "s3", "shingles")
    rows = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    @tidy
    def run(batches):
        held, key, out = [], None, []

        def batch(pairs):
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            k = np.stack([b.column(c).to_numpy() for c in range(3)], 1)
            cut = np.concatenate([[0], np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1, [len(k)]])
            for s, e in zip(cut[:-1], cut[1:], strict=True):
                if key is not None and tuple(k[s]) != key:
                    out += _block_links(pa.Table.from_batches(held), key[1] == key[2])
                    held = []
                key = tuple(k[s])
                held.append(b.slice(s, e - s))
            if len(out) > 10_000:
                yield batch(out)
                out = []
        if held:
            out += _block_links(pa.Table.from_batches(held), key[1] == key[2])
        if out:
            yield batch(out)

    out = ws.stage(rows.mapInArrow(run, "a long, b long").distinct(), "more")
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Component of every document under the 75 % shingle-set similarity.

    Returns doc_id, n_shingles, component_id, kept and fp (the set's
    fingerprint), one row per input row; no other input column is read.  Ids
    are numbers or structs, which are ordered by their fields.

    Null, empty and blank texts have an empty set (n_shingles 0, fp null), link
    to nothing and are kept.  Texts under five words are one shingle; texts of
    any length are read whole.  A row without id takes part in nothing:
    component_id null, kept true.  Repeated rows are in the same component and
    equally kept, and cost no more links than one row; rows that share an id
    and differ in text are told apart by their text, so each is linked for
    itself, and both are kept if they are of one component and have its
    smallest id.  An empty table gives an empty result.  Ties do not arise:
    links are decided on exact counts and a component is named by its smallest
    id.
    """
    ws = Workspace(docs.sparkSession, "near")
    struct = isinstance(docs.schema[id_col].dataType, T.StructType)
    ident = F.col(id_col) if struct else F.col(id_col).cast("long")
    src = docs.select(ident.alias("id"), F.col(text_col).cast("string").alias("text"))
    src = src.select(F.struct("id", F.xxhash64("id", "text").alias("h")).alias("key"), "text")
    sig = ws.stage(signatures(src), "signatures")
    live = sig.where("fp is not null and key.id is not null")
    picked = F.struct("key", F.col("n_shingles").alias("n"), "s0", "s1", "s2", "s3", "bands")
    classes = live.groupBy("fp").agg(F.min_by(picked, "key").alias("v"))
    # numbers follow partitions and hold once they are stored
    classes = ws.stage(classes.select(F.monotonically_increasing_id().alias("cls"), "fp", F.col("v.key").alias("rep"), *(F.col(f"v.{c}").alias(c) for c in ("n", "s0", "s1", "s2", "s3", "bands"))), "classes")
    bands = classes.select("cls", F.explode("bands").alias("bucket"))
    classes = classes.drop("bands")
    pivots = bands.groupBy("bucket").agg(F.min("cls").alias("a"), F.max("cls").alias("z")).where("a != z").select("bucket", "a")
    # a hot bucket's rows stream through this merge join and AQE splits it: the pivot's side has one row
    shared = ws.stage(bands.join(pivots, "bucket"), "buckets")
    pairs = shared.where("a != cls").select("a", F.col("cls").alias("b")).distinct()
    links = _verified(ws, pairs, classes, src)
    comp = ws.stage(components(ws, links), "components")
    more = _mixed_links(ws, shared.select("bucket", "cls"), classes, comp, src)
    if more.head(1):
        comp = ws.stage(components(ws, links.union(more)), "components")
    named = ws.stage(classes.select("cls", "fp", F.col("rep.id").alias("rep")).join(comp, F.col("cls") == comp.node, "left").select("fp", "rep", F.coalesce("root", "cls").alias("root")), "named")
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    final = salted_join(named, least, "root", F.xxhash64("fp")).select("fp", "component_id")
    out = salted_join(live.select(F.col("key.id").alias("doc_id"), "n_shingles", "fp", "salt"), final, "fp", F.col("salt")).select("doc_id", "n_shingles", "component_id", "fp")
    rest = sig.where("fp is null or key.id is null").select(F.col("key.id").alias("doc_id"), "n_shingles", F.col("key.id").alias("component_id"), "fp")
    return out.union(rest).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "fp")
