"""Whole texts to token ids with the tokenizers library, each distinct piece once.

A byte-pair tokenizer never merges across its pre-token boundaries, so a text
may be cut at boundaries that do not depend on context and every distinct piece
encoded once per Python worker.  Pieces are found and hashed for a whole slice
of texts in numpy; the library sees only pieces that the worker has not met.
Texts with white space outside ASCII take the library's plain path whole.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa

from .textscan import IS_SPACE, U64, slices, span_hashes, text_buffers

#: A worker's piece table has 2**21 places (32 MB) and starts anew when it is this full or holds this many ids.
#: A slice with more distinct pieces than that (one very long text) has a larger table for itself alone.
TABLE_BITS = 21
TABLE_LOAD = 0.43
TABLE_IDS = 6_000_000
#: Texts with a piece longer than this are encoded whole, without the table.
LONG_PIECE = 20_000

_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[33:48] = _MARK[58:65] = _MARK[91:97] = _MARK[123:127] = True


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _longest_run(buf: np.ndarray) -> int:
    """Most bytes in a row that are all white space or all not."""
    space = IS_SPACE[buf]
    cut = np.flatnonzero(space[1:] != space[:-1])
    return int(np.diff(np.concatenate([[-1], cut, [len(buf) - 1]])).max())


class PieceEncoder:
    """Encodes Arrow text columns; holds one growing table of pieces.

    ``joined`` kinds: "bytes" for byte-level pieces that carry their leading
    blank, "words" for tokenizers that drop white space.
    """

    _made: dict[tuple[str, str], PieceEncoder] = {}

    @classmethod
    def get(cls, path: str, kind: str) -> PieceEncoder:
        """One encoder a worker process, whatever number of tasks it runs."""
        if (path, kind) not in cls._made:
            cls._made[path, kind] = cls(path, kind)
        return cls._made[path, kind]

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.kind = kind
        vocab = self.tok.get_vocab()
        self.lengths = np.zeros(max(vocab.values()) + 1, np.int64)
        for piece, i in vocab.items():
            self.lengths[i] = len(piece.removesuffix("</w>") if kind == "words" else piece)
        self._forget()

    def _forget(self, least: int = 0) -> None:
        """An empty table with room for ``least`` pieces."""
        self.bits = max(TABLE_BITS, int(least / TABLE_LOAD).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.value = np.zeros(1 << self.bits, np.int64)  # place in ids << 16 | number of ids
        self.ids = np.empty(1 << 16, np.uint32)
        self.n_ids = self.n_pieces = 0

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Values of hashes by linear probing; -1 where unknown."""
        mask = U64((1 << self.bits) - 1)
        slot = h & mask
        got = self.keys[slot]
        out = np.where(got == h, self.value[slot], -1)
        left = np.flatnonzero((got != h) & (got != 0))
        while len(left):
            slot[left] = (slot[left] + U64(1)) & mask
            got = self.keys[slot[left]]
            same = got == h[left]
            out[left[same]] = self.value[slot[left[same]]]
            left = left[~same & (got != 0)]
        return out

    def _insert(self, h: np.ndarray, value: np.ndarray) -> None:
        """Add hashes that are not in the table; they are distinct."""
        mask = U64((1 << self.bits) - 1)
        slot = h & mask
        left = np.arange(len(h))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            self.keys[slot[free]] = h[free]  # of several for one place the last stays
            self.value[slot[free]] = value[free]
            left = left[self.keys[slot[left]] != h[left]]
            slot[left] = (slot[left] + U64(1)) & mask
        self.n_pieces += len(h)

    # --- pieces -------------------------------------------------------------------

    def _cut(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte starts and ends of pieces; ``offsets`` are text boundaries from 0."""
        n = len(buf)
        space = IS_SPACE[buf]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        prev = np.empty(n, bool)
        prev[0] = False
        prev[1:] = space[:-1]
        fresh = edge[:n]
        mark = _MARK[buf]
        mark[1:] &= _LETTER[buf[:-1]]
        mark[0] = False
        if self.kind == "words":
            before = prev | fresh
            starts = np.flatnonzero(~space & (before | mark))
            gap = np.empty(n, bool)
            gap[-1] = True
            gap[:-1] = space[1:] | mark[1:]
            gap |= edge[1:]
            return starts, np.flatnonzero(~space & gap) + 1
        blank = np.empty(n, bool)
        blank[0] = False
        blank[1:] = buf[:-1] == 32
        nxt = np.empty(n, bool)  # the next byte is no white space, in the same text
        nxt[-1] = False
        nxt[:-1] = ~space[1:]
        nxt &= ~edge[1:]
        start = fresh | mark | np.where(space, ~prev | nxt, prev & ~blank)
        starts = np.flatnonzero(start)
        return starts, np.append(starts[1:], n)

    def _library(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids a piece) of pieces, from one joined text."""
        texts = [p.decode("utf-8", "replace") for p in pieces]
        if self.kind == "words":
            norm = self.tok.normalizer.normalize_str("\n".join(texts).replace("\n", " "))
            size = np.array([len(w.encode()) for w in norm.split(" ")], np.int64)
            ids = np.array(self.tok.encode(norm, add_special_tokens=False).ids, np.uint32)
            drop = 0
        else:
            size = np.array([len(t.encode()) + 1 for t in texts], np.int64)
            ids = np.array(self.tok.encode("\n" + "\n".join(texts), add_special_tokens=False).ids, np.uint32)
            drop = 1
        if len(size) == len(texts):
            ends = np.cumsum(self.lengths[ids])
            count = np.diff(np.concatenate([[0], np.searchsorted(ends, np.cumsum(size), side="right")]))
            if len(ends) and ends[-1] == size.sum() and np.isin(np.cumsum(size), ends).all() and (count > drop).all():
                if drop:
                    first = np.concatenate([[0], np.cumsum(count)[:-1]])
                    keep = np.ones(len(ids), bool)
                    keep[first] = False
                    if (self.lengths[ids[first]] == 1).all():
                        return ids[keep], count - 1
                else:
                    return ids, count
        each = [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate(each), np.array([len(x) for x in each], np.int64)

    def _learn(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        ids, count = [], []
        plain = [i for i, p in enumerate(pieces) if not IS_SPACE[p[-1]]]
        other = [i for i, p in enumerate(pieces) if IS_SPACE[p[-1]]]
        for lo in range(0, len(plain), 20_000):
            a, c = self._library([pieces[i] for i in plain[lo : lo + 20_000]])
            ids.append(a)
            count.append(c)
        for i in other:
            e = self.tok.encode(pieces[i].decode("utf-8", "replace"), add_special_tokens=False).ids
            ids.append(np.array(e, np.uint32))
            count.append(np.array([len(e)], np.int64))
        c, new = np.concatenate(count), np.concatenate(ids)
        place = self.n_ids + np.cumsum(c) - c
        while self.n_ids + len(new) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.ids[self.n_ids : self.n_ids + len(new)] = new
        self.n_ids += len(new)
        self._insert(keys[np.array(plain + other, np.int64)], (place << 16) | c)

    def _slice(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids a text) of texts without odd white space."""
        n = len(offsets) - 1
        if not len(buf):
            return np.empty(0, np.uint32), np.zeros(n, np.int64)
        starts, ends = self._cut(buf, offsets)
        if not len(starts):
            return np.empty(0, np.uint32), np.zeros(n, np.int64)
        h = span_hashes(buf, starts, ends) | U64(1)
        value = self._find(h)
        miss = np.flatnonzero(value < 0)
        if len(miss):
            new, first = np.unique(h[miss], return_index=True)
            if self.n_pieces + len(new) > TABLE_LOAD * (1 << self.bits) or self.n_ids > TABLE_IDS:
                miss = np.arange(len(h))
                new, first = np.unique(h, return_index=True)
                self._forget(len(new))
            idx = miss[first]
            raw = buf.tobytes()
            self._learn(new, [raw[s:e] for s, e in zip(starts[idx].tolist(), ends[idx].tolist(), strict=True)])
            value[miss] = self._find(h[miss])
        place, count = value >> 16, value & 0xFFFF
        total = np.cumsum(count)
        gather = np.repeat(place - (total - count), count)
        gather += np.arange(len(gather))
        sums = np.concatenate([[0], total])
        bound = sums[np.searchsorted(starts, offsets)]
        ids = self.ids[gather]
        if self.bits > TABLE_BITS:
            self._forget()
        return ids, np.diff(bound)

    def encode(self, column: pa.Array):
        """Yield (first row, last row, ids, ids a text) through a column; nulls are empty."""
        buf, offsets = text_buffers(column)
        for lo, hi in slices(offsets):
            a, b = int(offsets[lo]), int(offsets[hi])
            part, off = buf[a:b], offsets[lo : hi + 1] - a
            odd = [i for i in range(hi - lo) if off[i + 1] - off[i] > LONG_PIECE and _longest_run(part[off[i] : off[i + 1]]) > LONG_PIECE]
            if len(part) and int(part.max()) >= 0xC2 or len(part) and ((part >= 0x1C) & (part <= 0x1F)).any():
                text = part.tobytes().decode("utf-8", "replace")
                if _ODD_SPACE.search(text):
                    odd += [i for i in range(hi - lo) if _ODD_SPACE.search(part[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace"))]
            if not odd:
                ids, count = self._slice(part, off)
                yield lo, hi, ids, count
                continue
            for i in range(hi - lo):
                one = part[off[i] : off[i + 1]]
                if i in odd:
                    ids = np.array(self.tok.encode(one.tobytes().decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)
                    yield lo + i, lo + i + 1, ids, np.array([len(ids)], np.int64)
                else:
                    ids, count = self._slice(one, off[i : i + 2] - off[i])
                    yield lo + i, lo + i + 1, ids, count
