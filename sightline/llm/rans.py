"""Static range asymmetric numeral coding of token ids, vectorised over blocks.

All blocks share one frequency table of total 2**20.  A block holds up to
16384 tokens, dealt in turn to 16 interleaved lanes; a lane has a 64-bit state
in [2**31, 2**63) and moves 32-bit words to and from the block's word stream.
Blocks are independent: each has its own lane states, word count and checksum,
so any block can be decoded alone.  numpy codes the same step of all lanes of
all blocks at once.
"""

from __future__ import annotations

import json
import zlib

import numpy as np

SCALE = 20
LANES = 16
BLOCK = 16384
LOW = np.uint64(1 << 31)
MAGIC = b"SLRANS1\0"
_WORD = np.uint64(32)
_SLOT = np.uint64((1 << SCALE) - 1)
_SCALE = np.uint64(SCALE)


def quantise(counts: np.ndarray) -> np.ndarray:
    """Frequencies summing to 2**20, at least 1 for every token that occurs."""
    counts = np.asarray(counts, np.float64)
    some = counts > 0
    total = 1 << SCALE
    if some.sum() > total // 2:
        raise ValueError("too many distinct tokens for the table")
    freq = np.zeros(len(counts), np.int64)
    if not some.any():
        return freq.astype(np.uint32)
    freq[some] = np.maximum(1, np.floor(counts[some] / counts.sum() * total))
    order = np.argsort(-freq, kind="stable")
    k = 0
    while (diff := total - int(freq.sum())) != 0:
        i = order[k % int(some.sum())]
        step = diff if diff > 0 else -min(-diff, int(freq[i]) // 4)
        freq[i] += step
        k += 1
        if step == 0 and k > 4 * len(counts):
            raise ValueError("frequencies cannot be scaled")
    return freq.astype(np.uint32)


class Table:
    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.cum = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.pad = int(freq.argmax()) if len(freq) else 0
        self.crc = zlib.crc32(freq.astype("<u4").tobytes())


def encode_blocks(ids: np.ndarray, table: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lane states, words a block, words) of a run of ids."""
    nb = -(-len(ids) // BLOCK)
    steps = BLOCK // LANES if nb > 1 else -(-len(ids) // LANES)
    full = np.full(nb * steps * LANES, table.pad, np.int64)
    full[: len(ids)] = ids
    # (steps, blocks, lanes); the last block's padding is coded and ignored
    full = full.reshape(nb, steps, LANES).transpose(1, 0, 2).reshape(steps, nb * LANES)
    x = np.full(nb * LANES, LOW, np.uint64)
    out = np.empty((steps, nb * LANES), np.uint32)
    used = np.empty((steps, nb * LANES), bool)
    for s in range(steps - 1, -1, -1):
        f, c = table.freq[full[s]], table.cum[full[s]]
        full_up = x >= f << np.uint64(63 - SCALE)
        out[s] = x  # the low word
        used[s] = full_up
        x = np.where(full_up, x >> _WORD, x)
        q = x // f
        x = (q << _SCALE) + (x - q * f) + c
    used = used.reshape(steps, nb, LANES).transpose(1, 0, 2)
    words = out.reshape(steps, nb, LANES).transpose(1, 0, 2)[used]
    return x, used.sum((1, 2)).astype(np.uint32), words


def decode_blocks(states: np.ndarray, sizes: np.ndarray, words: np.ndarray, n: int, table: Table) -> np.ndarray:
    nb = len(sizes)
    steps = BLOCK // LANES if nb > 1 else -(-n // LANES)
    x = states.reshape(nb, LANES).astype(np.uint64)
    at = np.cumsum(sizes.astype(np.int64)) - sizes
    words = np.append(words, np.zeros(LANES, np.uint32)).astype(np.uint64)
    out = np.empty((steps, nb, LANES), np.uint32)
    for s in range(steps):
        slot = x & _SLOT
        sym = table.symbol[slot]
        out[s] = sym
        x = table.freq[sym] * (x >> _SCALE) + slot - table.cum[sym]
        low = x < LOW
        turn = np.cumsum(low, axis=1)
        place = at[:, None] + turn - 1
        x = np.where(low, (x << _WORD) | words[np.maximum(place, 0)], x)
        at += turn[:, -1]
    return out.transpose(1, 0, 2).reshape(-1)[:n]


def pack(doc_ids: np.ndarray, valid: np.ndarray, lengths: np.ndarray, ids: np.ndarray, table: Table) -> bytes:
    """One file: header, document index, block checkpoints, block words."""
    states, sizes, words = encode_blocks(ids, table) if len(ids) else (np.empty(0, np.uint64), np.empty(0, np.uint32), np.empty(0, np.uint32))
    ends = np.cumsum(sizes.astype(np.int64))
    sums = [zlib.crc32(words[e - n : e].tobytes(), zlib.crc32(states[i * LANES : (i + 1) * LANES].tobytes())) for i, (e, n) in enumerate(zip(ends, sizes.astype(np.int64), strict=True))]
    body = b"".join(x.tobytes() for x in (doc_ids.astype("<i8"), valid.astype("u1"), lengths.astype("<i8"), sizes.astype("<u4"), np.array(sums, "<u4"), states.astype("<u8")))
    head = json.dumps({"scale": SCALE, "lanes": LANES, "block": BLOCK, "docs": len(doc_ids), "tokens": len(ids), "blocks": len(sizes), "table": table.crc, "index": zlib.crc32(body)}).encode()
    return MAGIC + len(head).to_bytes(4, "little") + head + body + words.astype("<u4").tobytes()


def _open(data: bytes, table: Table) -> tuple[dict, list[np.ndarray], np.ndarray]:
    """(header, index arrays, words) of a file whose index is intact."""
    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    n = int.from_bytes(data[8:12], "little")
    h, at = json.loads(data[12 : 12 + n]), 12 + n
    if h["table"] != table.crc:
        raise ValueError("another frequency table")
    begin, parts = at, []
    for kind, size in (("<i8", h["docs"]), ("u1", h["docs"]), ("<i8", h["docs"]), ("<u4", h["blocks"]), ("<u4", h["blocks"]), ("<u8", h["blocks"] * LANES)):
        parts.append(np.frombuffer(data, kind, size, at))
        at += parts[-1].nbytes
    if zlib.crc32(data[begin:at]) != h["index"]:
        raise ValueError("index checksum")
    return h, parts, np.frombuffer(data, "<u4", -1, at)


def _checked(i: int, words: np.ndarray, states: np.ndarray, wanted: int) -> None:
    if zlib.crc32(words.tobytes(), zlib.crc32(states.tobytes())) != wanted:
        raise ValueError(f"checksum of block {i}")


def unpack(data: bytes, table: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc ids, their validity, lengths, ids); raises where a checksum differs."""
    h, (doc_ids, valid, lengths, sizes, sums, states), words = _open(data, table)
    e = 0
    for i, size in enumerate(sizes.astype(np.int64)):
        _checked(i, words[e : e + size], states[i * LANES : (i + 1) * LANES], sums[i])
        e += size
    ids = decode_blocks(states, sizes, words, h["tokens"], table) if h["tokens"] else np.empty(0, np.uint32)
    return doc_ids, valid.astype(bool), lengths, ids


def unpack_block(data: bytes, i: int, table: Table) -> np.ndarray:
    """The ids of block ``i`` alone, from its checkpoint: lane states, place among the words and checksum."""
    h, (_, _, _, sizes, sums, states), words = _open(data, table)
    at, mine = int(sizes[:i].sum(dtype=np.int64)), states[i * LANES : (i + 1) * LANES]
    words = words[at : at + int(sizes[i])]
    _checked(i, words, mine, sums[i])
    n = min(BLOCK, h["tokens"] - i * BLOCK)
    # a block of a file of several is coded at full length, the last with padding
    coded = BLOCK if h["blocks"] > 1 else n
    return decode_blocks(mine, sizes[i : i + 1], words, coded, table)[:n]
