"""A gated recurrent language model in numpy: truncated backpropagation, class-factored softmax.

Symbols are the ``frequent`` words, in classes of equal size, and then one symbol for each *rare class*
of other words. Input weights are one row of three gates for each symbol. The output is factored:
P(symbol) = P(class | h) * P(word | class, h) for frequent words, P(class | h) for rare classes; the
share of a word inside a rare class comes from corpus counts and does not depend on h.

Sequences run in lanes: each lane reads documents one after another, its state set to zero where a
document starts and carried over window borders elsewhere, so a document's log-likelihood is that of
the whole text.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

F32 = np.float32


@dataclass(frozen=True)
class Shape:
    hidden: int = 16
    classes: int = 32
    per_class: int = 64
    rare: int = 64

    @property
    def frequent(self) -> int:
        return self.classes * self.per_class

    @property
    def symbols(self) -> int:
        return self.frequent + self.rare

    def sizes(self) -> dict[str, tuple[int, ...]]:
        h, c = self.hidden, self.classes + self.rare
        return {"u": (self.symbols, 3 * h), "w": (h, 3 * h), "cw": (h, c), "cb": (c,), "ow": (self.classes, h, self.per_class), "ob": (self.classes, self.per_class)}

    @property
    def total(self) -> int:
        return sum(int(np.prod(s)) for s in self.sizes().values())


class Model:
    def __init__(self, shape: Shape, flat: np.ndarray):
        self.shape, self.flat = shape, flat
        at = 0
        for k, s in shape.sizes().items():
            n = int(np.prod(s))
            setattr(self, k, flat[at : at + n].reshape(s))
            at += n

    @classmethod
    def born(cls, shape: Shape, frequent: np.ndarray, rare: np.ndarray) -> Model:
        """Small random weights; output biases are the log counts, so that training starts at the unigram model."""
        rng = np.random.default_rng(20_260_101)
        m = cls(shape, np.zeros(shape.total, F32))
        m.u[:] = rng.normal(0, 0.3, m.u.shape)
        m.w[:] = rng.normal(0, 1 / np.sqrt(shape.hidden), m.w.shape)
        m.cw[:] = rng.normal(0, 0.05, m.cw.shape)
        m.ow[:] = rng.normal(0, 0.05, m.ow.shape)
        f = np.log(frequent.reshape(shape.classes, shape.per_class) + 0.1)
        m.ob[:] = f - f.max(axis=1, keepdims=True)
        m.cb[:] = np.log(np.concatenate([frequent.reshape(shape.classes, -1).sum(axis=1), rare]) + 1.0)
        m.cb -= m.cb.max()
        return m

    # ------------------------------------------------------------ forward

    def steps(self, x: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: bool) -> tuple[np.ndarray, tuple]:
        """States of a window. x: (T, B) symbols; fresh: (T, B), false where a document starts; h: (B, H).

        Gates lie one after another, (T, 3, B, H), so that every step works on contiguous memory.
        """
        t, b = x.shape
        n = self.shape.hidden
        out = np.empty((t, b, n), F32)
        before = np.empty((t, b, n), F32) if keep else None
        inner = np.empty((t, b, n), F32) if keep else None
        sign = np.repeat(np.array([-1, -1, 2], F32), n)  # what the logistic function below takes: -z, -r, 2 c
        gates = np.ascontiguousarray((self.u * sign)[x].reshape(t, b, 3, n).transpose(0, 2, 1, 3))
        w = np.ascontiguousarray((self.w * sign).reshape(n, 3, n).transpose(1, 0, 2))
        starts = (fresh == 0).any(axis=1)
        a = np.empty((3, b, n), F32)
        with np.errstate(over="ignore"):
            for k in range(t):
                if starts[k]:
                    h = h * fresh[k][:, None]
                np.matmul(h, w, out=a)
                zr, c, part = gates[k, :2], gates[k, 2], a[2]
                zr += a[:2]
                _logistic(zr)
                if keep:
                    before[k], inner[k] = h, part
                part *= zr[1]
                c += part
                np.negative(c, out=c)  # tanh(v) = 2 / (1 + exp(-2 v)) - 1
                _logistic(c)
                c *= F32(2)
                c -= F32(1)
                h = np.subtract(h, c, out=out[k])
                h *= zr[0]
                h += c
        return out, (gates, before, inner)

    def losses(self, h: np.ndarray, y: np.ndarray, grad: Model | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log probability of each target; with ``grad``, also d(-sum)/dh, weight gradients added to it."""
        sh, per = self.shape, self.shape.per_class
        freq = y < sh.frequent
        cls = np.where(freq, y // per, y - sh.frequent + sh.classes).astype(np.int16)
        score = np.empty(len(y), F32)
        dh = np.empty_like(h) if grad is not None else None
        for i in range(0, len(y), PART):
            j = min(len(y), i + PART)
            score[i:j] = _softmax(h[i:j], self.cw, self.cb, cls[i:j], grad and (grad.cw, grad.cb), dh is not None and dh[i:j])
        at = np.flatnonzero(freq)
        at = at[np.argsort(cls[at], kind="stable")]
        cut = np.searchsorted(cls[at], np.arange(sh.classes + 1)).tolist()
        hs, ys = h[at], y[at] % per
        got, back = np.empty(len(at), F32), np.empty_like(hs) if grad is not None else None
        for c in range(sh.classes):
            i, j = cut[c], cut[c + 1]
            if i < j:
                got[i:j] = _softmax(hs[i:j], self.ow[c], self.ob[c], ys[i:j], grad and (grad.ow[c], grad.ob[c]), back is not None and back[i:j])
        score[at] += got
        if grad is not None:
            dh[at] += back
        return score, dh

    def backward(self, x: np.ndarray, fresh: np.ndarray, kept: tuple, dout: np.ndarray, grad: Model) -> None:
        """Gradients through the window's steps; none goes to before the window."""
        gates, before, inner = kept
        t, b, n = dout.shape
        z, r, c = gates[:, 0], gates[:, 1], gates[:, 2]
        dg = np.empty_like(gates)  # first what dh is to be multiplied with, then the gradients
        np.multiply(before - c, z, out=dg[:, 0])
        dg[:, 0] *= 1 - z
        np.multiply(inner, r, out=dg[:, 1])
        dg[:, 1] *= F32(0.5)  # inner is kept doubled
        dg[:, 1] *= 1 - r
        np.multiply(1 - z, 1 - c * c, out=dg[:, 2])
        da = np.empty_like(gates)
        starts = (fresh == 0).any(axis=1)
        dh = np.zeros((b, n), F32)
        wt = np.ascontiguousarray(self.w.reshape(n, 3, n).transpose(1, 2, 0))
        for k in range(t - 1, -1, -1):
            dh += dout[k]
            g, d = dg[k], da[k]
            g[2] *= dh
            g[0] *= dh
            g[1] *= g[2]
            d[:2] = g[:2]
            np.multiply(g[2], r[k], out=d[2])
            dh *= z[k]
            dh += np.matmul(d, wt).sum(axis=0)
            if starts[k]:
                dh *= fresh[k][:, None]
        flat = before.reshape(-1, n).T
        for q in range(3):
            grad.w[:, q * n : (q + 1) * n] += flat @ np.ascontiguousarray(da[:, q]).reshape(-1, n)
        sym = x.ravel().astype(np.int16 if self.shape.symbols < 1 << 15 else np.int64)
        order = np.argsort(sym, kind="stable")
        s = sym[order]
        first = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        grad.u[s[first]] += np.add.reduceat(dg.transpose(0, 2, 1, 3).reshape(-1, 3 * n)[order], first, axis=0)


#: Rows of a softmax at once: what they need stays in the processor's cache.
PART = 2048


def _logistic(x: np.ndarray) -> None:
    """1 / (1 + exp(x)), in place."""
    np.exp(x, out=x)
    x += F32(1)
    np.reciprocal(x, out=x)


def _softmax(h: np.ndarray, w: np.ndarray, bias: np.ndarray, y: np.ndarray, grad=None, back=None) -> np.ndarray:
    """Log probability of each target; with ``grad`` (for w and bias), gradients are added to it and d(-sum)/dh goes to ``back``.

    States are within (-1, 1), which bounds the logits from above; a row that is far below the bound is shifted by its own
    largest one.
    """
    top = F32((bias + np.abs(w).sum(axis=0)).max())
    one = np.empty((len(h), h.shape[1] + 1), F32)  # the bias is a weight of a constant input
    one[:, :-1], one[:, -1] = h, 1
    p = one @ np.vstack([w, bias - top])
    rows = np.arange(len(y))
    own = p[rows, y]
    np.exp(p, out=p)
    total = p @ np.ones(p.shape[1], F32)
    low = np.flatnonzero(total < 1e-25)
    if len(low):
        q = h[low] @ w + bias
        q -= q.max(axis=1, keepdims=True)
        own[low] = q[np.arange(len(low)), y[low]]
        p[low] = np.exp(q)
        total[low] = p[low].sum(axis=1)
    if grad:  # p / total - 1 at the target, with the division left to the narrow side of each product
        p[rows, y] -= total
        share = (1 / total)[:, None]
        one *= share
        got = one.T @ p
        grad[0][:] += got[:-1]
        grad[1][:] += got[-1]
        np.matmul(p, w.T, out=back)
        back *= share
    return own - np.log(total)


# ---------------------------------------------------------------- lanes


def lanes(lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Token places in time-major lanes, (L, B) with -1 past a lane's end, and whether a step goes on with a document (not at its start).

    ``lengths``: tokens of each document; documents lie one after another. Longest first, to the shortest lane; no more
    lanes than ``most``, nor than are filled beside the longest document (but 64).
    """
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    b = max(1, min(most, len(lengths), max(64, -(-int(lengths.sum()) // max(1, int(lengths.max()))))))
    own: list[list[int]] = [[] for _ in range(b)]
    heap = [(0, k) for k in range(b)]
    for d in np.argsort(-lengths, kind="stable").tolist():
        n, k = heapq.heappop(heap)
        own[k].append(d)
        heapq.heappush(heap, (n + int(lengths[d]), k))
    deep = max(sum(int(lengths[d]) for d in o) for o in own)
    at = np.full((deep, b), -1, np.int32 if lengths.sum() < 1 << 31 else np.int64)
    fresh = np.ones((deep, b), bool)
    for k, o in enumerate(own):
        p = 0
        for d in o:
            n = int(lengths[d])
            at[p : p + n, k] = np.arange(starts[d], starts[d] + n)
            fresh[p, k] = False
            p += n
    return at, fresh


def score(model: Model, symbols: np.ndarray, lengths: np.ndarray, end: int, most: int = 256, window: int = 32) -> np.ndarray:
    """Natural log probability of each token."""
    out = np.zeros(len(symbols), F32)
    if not len(symbols):
        return out
    at, fresh = lanes(lengths, most)
    y = np.where(at >= 0, symbols[at], end)
    x = np.full_like(y, end)
    x[1:] = y[:-1]
    x[fresh == 0] = end
    h = np.zeros((y.shape[1], model.shape.hidden), F32)
    live = (at >= 0).any(axis=0)
    for k in range(0, len(y), window):
        some = np.flatnonzero(live & (at[k] >= 0)) if k else np.arange(y.shape[1])
        yk, xk, fk, ak = y[k : k + window, some], x[k : k + window, some], fresh[k : k + window, some], at[k : k + window, some]
        states, _ = model.steps(xk, fk, h[some], False)
        h[some] = states[-1]
        ok = ak.ravel() >= 0
        got, _ = model.losses(states.reshape(-1, states.shape[2])[ok], yk.ravel()[ok])
        out[ak.ravel()[ok]] = got
    return out


def train(model: Model, symbols: np.ndarray, lengths: np.ndarray, end: int, memory: np.ndarray, rate: float, most: int = 256, window: int = 16) -> float:
    """One pass of Adagrad over the documents, in place; ``memory`` holds the squared gradients. Returns the summed log probability."""
    at, fresh = lanes(lengths, most)
    y = np.where(at >= 0, symbols[at], end)
    x = np.full_like(y, end)
    x[1:] = y[:-1]
    x[fresh == 0] = end
    h = np.zeros((y.shape[1], model.shape.hidden), F32)
    total = 0.0
    grad, step = Model(model.shape, np.zeros_like(model.flat)), np.empty_like(model.flat)
    for k in range(0, len(y), window):
        some = np.flatnonzero(at[k] >= 0)
        yk, xk, fk, ak = y[k : k + window, some], x[k : k + window, some], fresh[k : k + window, some], at[k : k + window, some]
        states, kept = model.steps(xk, fk, h[some], True)
        h[some] = states[-1]
        ok = ak.ravel() >= 0
        flat = states.reshape(-1, states.shape[2])
        got, dh = model.losses(flat[ok], yk.ravel()[ok], grad)
        total += float(got.sum())
        full = np.zeros_like(flat)
        full[ok] = dh
        model.backward(xk, fk, kept, full.reshape(states.shape), grad)
        g = grad.flat
        g *= F32(1 / max(1, int(ok.sum())))
        np.multiply(g, g, out=step)
        memory += step
        np.sqrt(memory, out=step)
        step += F32(1e-6)
        g /= step
        g *= F32(rate)
        model.flat -= g
        g[:] = 0
    return total
