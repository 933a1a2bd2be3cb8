"""A gated recurrent language model in numpy with a class-factored softmax.

The model predicts the next token's class from the state, then the word inside
the class.  Frequent words have ids 0 .. n-1 and are dealt by rank to about
sqrt(n) classes of as many words, so a token costs O(sqrt(n));
every other word is id n, the tail, a class without a softmax of its own.
Documents lie end to end in lanes; a lane's state runs on from window to window
and is cleared where a document begins, so windows bound memory and the reach
of gradients but not what the state has seen.
"""

from __future__ import annotations

import heapq
import math

import numpy as np

HIDDEN = 24
WINDOW = 64
MAX_LANES = 1024
#: When the model learns: lanes at most, and steps a lane should have, so that updates grow with the tokens.
LEARN_LANES, LEARN_STEPS = 256, 2048
#: Rows of logits at once.
OUTPUT_ROWS = 2048
#: Logits up to this size need no row's largest subtracted before exp: sums stay within float32.
LOGIT_RANGE = 60


class Model:
    """Parameters: X input gates a token, U recurrent, C and c class softmax, W and w words by class."""

    NAMES = ("X", "U", "C", "c", "W", "w")

    def __init__(self, params: dict[str, np.ndarray], words: int):
        self.p, self.words = params, words
        self.classes, _, self.width = params["W"].shape

    @classmethod
    def unigram(cls, probability: np.ndarray, seed: int = 9) -> Model:
        """Starts as the unigram model; ``probability`` of ids 0 .. n-1, then of the tail."""
        n = len(probability) - 1
        width = math.isqrt(max(n, 1) - 1) + 1
        k = -(-n // width)
        rng = np.random.Generator(np.random.PCG64(seed))
        by_word = np.zeros(k * width)
        by_word[:n] = probability[:n]
        by_word = by_word.reshape(k, width)
        mass = np.append(by_word.sum(1), probability[n])
        with np.errstate(divide="ignore"):
            w = np.where(by_word > 0, np.log(by_word), -60.0)
            c = np.where(mass > 0, np.log(mass), -60.0)
        h = HIDDEN
        p = {
            "X": rng.normal(0, 0.3, (n + 1, 3 * h)), "U": rng.normal(0, 1 / np.sqrt(h), (h, 3 * h)),
            "C": np.zeros((h, k + 1)), "c": c, "W": np.zeros((k, h, width)), "w": w,
        }
        return cls({a: v.astype(np.float32) for a, v in p.items()}, n)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[a].ravel() for a in self.NAMES])

    def like(self, flat: np.ndarray) -> Model:
        out, at = {}, 0
        for a in self.NAMES:
            n = self.p[a].size
            out[a] = flat[at : at + n].reshape(self.p[a].shape).astype(np.float32)
            at += n
        return Model(out, self.words)


def lanes(lengths: np.ndarray, most: int = MAX_LANES, steps: int = 256) -> tuple[list[list[int]], int]:
    """Documents (positive lengths) dealt to lanes of nearly equal length, and the longest."""
    total = int(lengths.sum())
    count = int(min(most, max(1, -(-total // max(int(lengths.max()), steps)))))
    heap = [(0, i) for i in range(count)]
    out: list[list[int]] = [[] for _ in range(count)]
    for d in np.argsort(-lengths, kind="stable").tolist():
        n, i = heapq.heappop(heap)
        out[i].append(d)
        heapq.heappush(heap, (n + int(lengths[d]), i))
    return out, max(n for n, _ in heap)


def _order(x: np.ndarray, most: int) -> np.ndarray:
    """Stable order of numbers from 0 to ``most``; by radix where 16 bits hold them."""
    return np.argsort(x.astype(np.uint16) if most < 1 << 16 else x, kind="stable")


def _in_range(w: np.ndarray) -> np.ndarray:
    """Whether logits of a state have a sum of exponentials that float32 holds as they are; by layer, biases in the last row.

    A state's components lie between -1 and 1, so a logit is within the sum of its weights' sizes of its bias.
    """
    reach, b = np.abs(w[..., :-1, :]).sum(-2), w[..., -1, :]
    return ((b + reach).max(-1) <= LOGIT_RANGE) & ((b - reach).max(-1) >= -LOGIT_RANGE)


def _softmax(s: np.ndarray, w: np.ndarray, fits: bool, own: np.ndarray, x: np.ndarray, weight: np.float32 | None, g: np.ndarray | None, ds: np.ndarray | None) -> np.ndarray:
    """Log probability of column ``own`` of each row of s @ w; the last column of s is 1, the last row of w the biases.

    ``fits``: what _in_range says of w.  With ``weight`` the gradients of -weight * sum(log p) are added to g and ds.  ``x`` is room for the logits; rows
    are scaled in the narrow factors of the products, never in the logits.
    """
    logp = np.empty(len(s), np.float32)
    one, rows = np.ones(w.shape[1], np.float32), np.arange(min(len(s), len(x)))
    for lo in range(0, len(s), len(x)):  # so many rows at once stay in the cache
        part, k = s[lo : lo + len(x)], own[lo : lo + len(x)]
        e, at = x[: len(part)], rows[: len(part)]
        np.matmul(part, w, out=e)
        if not fits:
            e -= e.max(1, keepdims=True)
        mine = e[at, k]
        np.exp(e, out=e)
        total = e @ one
        logp[lo : lo + len(x)] = mine - np.log(total)
        if weight is not None:
            e[at, k] -= total
            scale = (weight / total)[:, None]
            g += (part * scale).T @ e
            d = e @ w[:-1].T
            d *= scale
            ds[lo : lo + len(x)] += d
    return logp


class Adagrad:
    def __init__(self, model: Model, rate: float):
        self.m, self.rate = model, rate
        self.sum = {a: np.full_like(v, 1e-3) for a, v in model.p.items()}

    def step(self, grads: dict[str, np.ndarray], seen: np.ndarray) -> None:
        """``seen``: the rows of X that the gradient of X is of."""
        for a, g in grads.items():
            at = seen if a == "X" else slice(None)
            size = self.sum[a][at]
            size += g * g
            self.sum[a][at] = size
            move = np.sqrt(size)
            np.divide(g, move, out=move)
            move *= self.rate
            self.m.p[a][at] -= move


def _forward(m: Model, h: np.ndarray, prev: np.ndarray, fresh: np.ndarray, keep: bool):
    """States before each step's target; (steps, lanes, hidden), the last state, what backward needs."""
    n, (steps, wide) = HIDDEN, prev.shape
    # gates apart, so that a step's part of each is one block: z, r and candidates, at first their inputs
    zrc = np.ascontiguousarray(m.p["X"].take(prev.ravel(), axis=0).reshape(steps, wide, 3, n).transpose(0, 2, 1, 3))
    U = np.ascontiguousarray(m.p["U"].reshape(n, 3, n).transpose(1, 0, 2))
    u = np.empty((steps if keep else 1, 3, wide, n), np.float32)
    out, rc = np.empty((steps, wide, n), np.float32), np.empty((wide, n), np.float32)
    clear, start = fresh.any(1), h
    for t in range(steps):
        if clear[t]:
            h = np.where(fresh[t][:, None], np.float32(0), h)
        v = u[t if keep else 0]
        np.matmul(h, U, out=v)
        zr, c = zrc[t, :2], zrc[t, 2]
        zr += v[:2]
        # logistic function, in place
        np.negative(zr, out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        c += np.multiply(zr[1], v[2], out=rc)
        np.tanh(c, out=c)
        new = np.subtract(h, c, out=out[t])
        new *= zr[0]
        new += c
        h = new
    if not keep:
        return out, h, []
    before = np.concatenate([start[None], out[:-1]])
    before[fresh] = 0
    return out, h, [before, zrc, u[:, 2]]


def _output(m: Model, s: np.ndarray, target: np.ndarray, weight: np.float32 | None):
    """Log probability of each target; with ``weight`` also gradients of -weight * sum(log p)."""
    cls = np.where(target < m.words, target // m.width, m.classes)
    order = _order(cls, m.classes)
    cls, target = cls[order], target[order]
    bound = np.searchsorted(cls, np.arange(m.classes + 1))
    inside = target[: bound[-1]] % m.width
    n = HIDDEN
    own = np.ones((len(s), n + 1), np.float32)
    own[:, :n] = s.take(order, axis=0)
    C, W = np.concatenate([m.p["C"], m.p["c"][None]]), np.concatenate([m.p["W"], m.p["w"][:, None]], axis=1)
    gC = gW = ds = None
    if weight is not None:
        gC, gW, ds = np.zeros_like(C), np.zeros_like(W), np.zeros_like(s)
    logp = _softmax(own, C, _in_range(C), cls, np.empty((OUTPUT_ROWS, C.shape[1]), np.float32), weight, gC, ds)
    room, fits = np.empty((OUTPUT_ROWS, m.width), np.float32), _in_range(W)
    for k in np.flatnonzero(np.diff(bound)):
        at = slice(bound[k], bound[k + 1])
        logp[at] += _softmax(own[at], W[k], fits[k], inside[at], room, weight, *((None, None) if weight is None else (gW[k], ds[at])))
    back = np.empty(len(s), np.float64)
    back[order] = logp
    if weight is None:
        return back, {}, None
    unsorted = np.empty_like(ds)
    unsorted[order] = ds
    return back, {"C": gC[:n], "c": gC[n], "W": gW[:, :n], "w": gW[:, n]}, unsorted


def _backward(m: Model, kept: list, ds: np.ndarray, prev: np.ndarray, fresh: np.ndarray, g: dict[str, np.ndarray]) -> np.ndarray:
    U, n = m.p["U"], HIDDEN
    h, zrc, un = kept
    z, r, c = zrc[:, 0], zrc[:, 1], zrc[:, 2]
    # what does not depend on later steps, for the whole window at once
    to_c, to_z, to_r = (1 - z) * (1 - c * c), (h - c) * z * (1 - z), un * r * (1 - r)
    du = np.empty((*prev.shape, 3 * n), np.float32)
    dc = np.empty((*prev.shape, n), np.float32)
    dh, clear, back = np.zeros_like(ds[0]), fresh.any(1), np.ascontiguousarray(U.T)
    for t in range(len(prev) - 1, -1, -1):
        dh += ds[t]
        np.multiply(dh, to_c[t], out=dc[t])
        np.multiply(dh, to_z[t], out=du[t, :, :n])
        np.multiply(dc[t], to_r[t], out=du[t, :, n : 2 * n])
        np.multiply(dc[t], r[t], out=du[t, :, 2 * n :])
        dh *= z[t]
        dh += du[t] @ back
        if clear[t]:
            dh[fresh[t]] = 0
    flat = du.reshape(-1, 3 * n)
    g["U"] = h.reshape(-1, n).T @ flat
    flat[:, 2 * n :] = dc.reshape(-1, n)  # what the inputs get
    tok = prev.ravel()
    order = _order(tok, len(m.p["X"]))
    tok = tok[order]
    first = np.flatnonzero(np.append(True, tok[1:] != tok[:-1]))
    g["X"] = np.add.reduceat(flat.take(order, axis=0), first, axis=0)
    return tok[first]


def run(m: Model, tokens: np.ndarray, starts: np.ndarray, lengths: np.ndarray, end: int, rate: float = 0.0) -> np.ndarray:
    """Natural log probability of every document; with ``rate`` the model learns on the way.

    Document d is tokens[starts[d] : starts[d] + lengths[d]]; each begins from
    a cleared state with ``end`` as the token before.
    """
    total = np.zeros(len(lengths))
    if not len(lengths):
        return total
    learn = rate > 0
    plan, longest = lanes(lengths, LEARN_LANES, LEARN_STEPS) if learn else lanes(lengths)
    wide = len(plan)
    opt = Adagrad(m, rate) if learn else None
    # place[i, t]: which token lane i meets at step t
    place = np.full((wide, -(-longest // WINDOW) * WINDOW), -1, np.int32)
    for i, lane in enumerate(plan):
        n = lengths[lane]
        flat = np.repeat(starts[lane] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        place[i, : len(flat)] = flat
    owner = np.full(len(tokens), -1, np.int32)
    owner[place[place >= 0]] = np.repeat(np.concatenate([np.array(x, np.int32) for x in plan]), np.concatenate([lengths[x] for x in plan]))
    first = np.zeros(len(tokens), bool)
    first[starts] = True
    h = np.zeros((wide, HIDDEN), np.float32)
    for lo in range(0, longest, WINDOW):
        at = place[:, lo : lo + WINDOW].T.astype(np.int64)
        there = at >= 0
        target = np.where(there, tokens[at], end)
        fresh = there & first[at]
        prev = np.where(there & ~fresh, tokens[at - 1], end)
        doc = np.where(there, owner[at], -1)
        s, h, kept = _forward(m, h, prev, fresh, learn)
        live = np.flatnonzero(there.ravel())
        flat = s.reshape(-1, HIDDEN)[live]
        weight = np.float32(1 / max(1, len(live)) ** 0.5) if learn else None
        logp, g, ds = _output(m, flat, target.ravel()[live], weight)
        total += np.bincount(doc.ravel()[live], weights=logp, minlength=len(total))
        if learn:
            back = np.zeros((WINDOW * wide, HIDDEN), np.float32)
            back[live] = ds
            opt.step(g, _backward(m, kept, back.reshape(WINDOW, wide, HIDDEN), prev, fresh, g))
    return total
