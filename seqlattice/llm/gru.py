"""A gated recurrent language model with a class-factored output, in numpy.

The next item is predicted as class, then member of the class.  Items are the
most frequent words, in classes of MEMBERS by frequency, and one item for each
class of other words.  Training is truncated backpropagation over windows of
STEPS items; hidden states are carried from a text's window to its next one,
also when scoring, so that a text's log-likelihood covers it from its first
item to its last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

HIDDEN, STEPS, WORD_CLASSES, MEMBERS, OTHER_CLASSES = 16, 32, 20, 24, 12
WORDS, CLASSES = WORD_CLASSES * MEMBERS, WORD_CLASSES + OTHER_CLASSES
ITEMS = WORDS + OTHER_CLASSES
RATE, EPSILON = 0.08, 1e-6
#: The item before a text's first: the end mark, which is the first of the words.
START = 0

CLASS_OF = np.concatenate([np.repeat(np.arange(WORD_CLASSES), MEMBERS), np.arange(WORD_CLASSES, CLASSES)])
MEMBER_OF = np.concatenate([np.tile(np.arange(MEMBERS), WORD_CLASSES), np.full(OTHER_CLASSES, -1)])

ONES = np.ones(max(CLASSES, MEMBERS), np.float32)
SHAPES = {"e": (ITEMS, 3 * HIDDEN), "u": (HIDDEN, 3 * HIDDEN), "c": (HIDDEN, CLASSES), "cb": (CLASSES,), "m": (WORD_CLASSES, HIDDEN, MEMBERS), "mb": (WORD_CLASSES, MEMBERS)}
SIZE = sum(int(np.prod(s)) for s in SHAPES.values())


def views(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def start_weights(counts: np.ndarray, seed: int = 7) -> np.ndarray:
    """Small random weights; biases give the items' frequencies, and those of words that don't exist leave them no chance.  Without any counts all are equal."""
    flat = (np.random.Generator(np.random.PCG64(seed)).standard_normal(SIZE) * 0.15).astype(np.float32)
    w = views(flat)
    if not counts.sum():
        w["cb"][:] = w["mb"][:] = 0
        return flat
    by_class = np.bincount(CLASS_OF, counts, CLASSES)
    w["cb"][:] = np.where(by_class > 0, np.log(np.maximum(by_class, 1e-9)) - np.log(max(by_class.sum(), 1)), -1e9)
    words = counts[:WORDS].reshape(WORD_CLASSES, MEMBERS)
    w["mb"][:] = np.where(words > 0, np.log(np.maximum(words, 1e-9) / np.maximum(words.sum(axis=1, keepdims=True), 1e-9)), -1e9)
    return flat


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.minimum(x, 60, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Lanes:
    """Texts side by side: each call gives the next window of every text that is under way."""

    def __init__(self, texts: list[np.ndarray], width: int):
        self.texts, self.width = texts, width

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Inputs and targets, both STEPS x lanes, -1 for none; the texts' numbers; where the lanes were in the window before, -1 at a text's start."""
        order = sorted(range(len(self.texts)), key=lambda i: -len(self.texts[i]))
        lanes: list[list[int]] = []
        at = 0
        while True:
            before = list(range(len(lanes)))
            kept = [(k, lane) for k, lane in zip(before, lanes) if lane[1] < len(self.texts[lane[0]])]
            was, lanes = [k for k, _ in kept], [lane for _, lane in kept]
            while len(lanes) < self.width and at < len(order):
                lanes.append([order[at], 0])
                was.append(-1)
                at += 1
            if not lanes:
                return
            x, y = np.full((len(lanes), STEPS), START, np.int64), np.full((len(lanes), STEPS), -1, np.int64)
            for k, lane in enumerate(lanes):
                text, pos = self.texts[lane[0]], lane[1]
                part = text[pos : pos + STEPS]
                n = len(part)
                y[k, :n] = part
                x[k, 1:n] = part[: n - 1]
                if pos:
                    x[k, 0] = text[pos - 1]
                lane[1] += n
            used = int((y >= 0).any(axis=0).sum())
            yield x.T[:used], y.T[:used], np.array([lane[0] for lane in lanes]), np.array(was)


class Run:
    """Forward (and backward) passes over windows."""

    def __init__(self, flat: np.ndarray):
        self.flat, self.w = flat, views(flat)
        self.h = np.zeros((0, HIDDEN), np.float32)

    def _carry(self, was: np.ndarray) -> np.ndarray:
        h = np.zeros((len(was), HIDDEN), np.float32)
        old = was >= 0
        h[old] = self.h[was[old]]
        return h

    def states(self, x: np.ndarray, was: np.ndarray, keep: list | None = None) -> np.ndarray:
        h, u, p = self._carry(was), self.w["u"], self.w["e"][x]
        out = np.empty((len(x), *h.shape), np.float32)
        for t in range(len(x)):
            hu = h @ u
            gates = _sigmoid(p[t, :, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
            z, r, hn = gates[:, :HIDDEN], gates[:, HIDDEN:], hu[:, 2 * HIDDEN :]
            n = np.tanh(p[t, :, 2 * HIDDEN :] + r * hn)
            if keep is not None:
                keep.append((h, z, r, hn, n))
            h = n + z * (h - n)
            out[t] = h
        self.h = h
        return out

    def outputs(self, hs: np.ndarray, y: np.ndarray, grads: dict[str, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """The natural log-probabilities of targets y for states hs; with grads, adds to them and returns the states' gradients."""
        w, c = self.w, CLASS_OF[y]
        rows, member = np.arange(len(y)), MEMBER_OF[y]
        logit = hs @ w["c"]
        logit += w["cb"]  # states are below 1, so no exponent can overflow
        picked = logit[rows, c]
        np.exp(logit, out=logit)
        total = logit @ ONES[:CLASSES]
        logp = picked - np.log(total)
        dh = None
        if grads is not None:
            logit /= total[:, None]
            logit[rows, c] -= 1
            grads["c"] += hs.T @ logit
            grads["cb"] += np.ones(len(logit), np.float32) @ logit
            dh = logit @ w["c"].T
        by = np.argsort(c, kind="stable")
        edges = np.searchsorted(c[by], np.arange(WORD_CLASSES + 1))
        for k in range(WORD_CLASSES):
            i = by[edges[k] : edges[k + 1]]
            if not len(i):
                continue
            own, m, r = hs.take(i, axis=0), member[i], rows[: len(i)]
            logit = own @ w["m"][k]
            logit += w["mb"][k]
            picked = logit[r, m]
            np.exp(logit, out=logit)
            total = logit @ ONES[:MEMBERS]
            logp[i] += picked - np.log(total)
            if grads is not None:
                logit /= total[:, None]
                logit[r, m] -= 1
                grads["m"][k] += own.T @ logit
                grads["mb"][k] += np.ones(len(logit), np.float32) @ logit
                dh[i] += logit @ w["m"][k].T
        return logp, dh


def scores(flat: np.ndarray, texts: list[np.ndarray], width: int = 512) -> np.ndarray:
    """The natural log-likelihood of each whole text."""
    run, out = Run(flat), np.zeros(len(texts))
    for x, y, who, was in Lanes(texts, width):
        hs, has = run.states(x, was), y >= 0
        logp = np.zeros(y.shape)
        logp[has] = run.outputs(hs[has], y[has])[0]
        out[who] += logp.sum(axis=0)
    return out


def train(flat: np.ndarray, squares: np.ndarray, texts: list[np.ndarray], width: int = 256) -> None:
    """One pass over the texts, in place: truncated backpropagation with steps scaled by past squares."""
    run, w, squared = Run(flat), views(flat), views(squares)
    for x, y, _, was in Lanes(texts, width):
        keep: list = []
        hs, has = run.states(x, was, keep), y >= 0
        grads = {k: np.zeros(w[k].shape, np.float32) for k in ("c", "cb", "m", "mb")}
        dout = np.zeros_like(hs)
        dout[has] = run.outputs(hs[has], y[has], grads)[1]
        into = np.empty((*x.shape, 3 * HIDDEN), np.float32)
        back = np.empty_like(into)
        carried = np.zeros_like(hs[0])
        ut = w["u"].T.copy()
        for t in range(len(x) - 1, -1, -1):
            h, z, r, hn, n = keep[t]
            d = dout[t]
            d += carried
            dz_pass = d * z
            dn = into[t, :, 2 * HIDDEN :]
            np.multiply(d - dz_pass, 1 - n * n, out=dn)
            np.multiply(dn * hn, r - r * r, out=into[t, :, HIDDEN : 2 * HIDDEN])
            np.multiply((dz_pass - dz_pass * z), h - n, out=into[t, :, :HIDDEN])
            back[t] = into[t]
            back[t, :, 2 * HIDDEN :] *= r
            carried = back[t] @ ut
            carried += dz_pass
        before = np.stack([k[0] for k in keep]).reshape(-1, HIDDEN)
        grads["u"] = before.T @ back.reshape(-1, 3 * HIDDEN)
        ids = x.reshape(-1)
        by = np.argsort(ids, kind="stable")
        ids, at = np.unique(ids[by], return_index=True)
        step = np.add.reduceat(into.reshape(-1, 3 * HIDDEN).take(by, axis=0), at, axis=0)
        squared["e"][ids] += step * step
        w["e"][ids] -= RATE * step / np.sqrt(squared["e"][ids] + EPSILON)
        for name, g in grads.items():
            squared[name] += g * g
            w[name] -= RATE * g / np.sqrt(squared[name] + EPSILON)
