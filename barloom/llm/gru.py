"""A gated recurrent language model in numpy: forward, truncated backpropagation, class-factored softmax.

Token 0 stands for all tokens outside the vocabulary and token 1 for the end of a text, which also starts
one. Vocabulary slots are dealt into equal classes; p(token) = p(class | h) * p(token | class, h). The state
is carried from window to window through a whole text and reset where a text starts.

Texts lie one after another in lanes of about equal length, which take each step together. States and gates
hold one column a lane, so that each gate is one block of memory; the softmax takes one row a token, sorted by
class, so that each class is one matrix product.
"""

from __future__ import annotations

import heapq

import numpy as np

UNKNOWN, END = 0, 1
_F = np.float32
#: Rows of one token from which on they are summed by a matrix product of their own.
_MANY = 32


def init(counts: np.ndarray, hidden: int, classes: int, seed: int = 0) -> dict[str, np.ndarray]:
    """Small random weights; the biases start at the unigram model of ``counts``, one per slot."""
    rng, v = np.random.default_rng(seed), len(counts)
    p = (counts + 0.5) / (counts.sum() + 0.5 * v)
    grouped = p.reshape(classes, v // classes)
    s = 1 / np.sqrt(hidden)
    return {k: a.astype(_F) for k, a in {
        "E": rng.normal(0, 0.3, (v, 3 * hidden)), "b": np.zeros(3 * hidden), "U": rng.normal(0, s, (hidden, 3 * hidden)),
        "C": rng.normal(0, 0.1, (hidden, classes)), "c": np.log(grouped.sum(1)),
        "W": rng.normal(0, 0.1, (classes, hidden, v // classes)), "w": np.log(grouped / grouped.sum(1, keepdims=True)),
    }.items()}


def flat(model: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([a.ravel() for a in model.values()])


def unflat(values: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, a in like.items():
        out[k] = np.ascontiguousarray(values[at : at + a.size].reshape(a.shape).astype(_F))
        at += a.size
    return out


class _Lanes:
    """Texts dealt to at most ``most`` lanes, the longest first, each to the shortest lane so far."""

    def __init__(self, texts: list[np.ndarray], most: int):
        lens = np.array([len(t) for t in texts])
        heap = [(0, k) for k in range(min(most, len(texts)))]
        held: list[list[int]] = [[] for _ in heap]
        for i in np.argsort(-lens, kind="stable"):
            n, k = heap[0]
            held[k].append(i)
            heapq.heapreplace(heap, (n + int(lens[i]), k))
        held.sort(key=lambda lane: -lens[lane].sum())
        self.order = np.concatenate(held)
        self.lens = lens[self.order]
        self.length = np.array([lens[lane].sum() for lane in held])
        self.begin = np.cumsum(self.length) - self.length
        self.y = np.concatenate([texts[i] for i in self.order])
        first = (np.cumsum(self.lens) - self.lens)[self.lens > 0]
        self.x = np.empty_like(self.y)
        self.x[1:] = self.y[:-1]
        self.x[first] = END
        self.fresh = np.zeros(len(self.y), bool)
        self.fresh[first] = True

    def windows(self, window: int):
        """For each window its steps' places in ``x`` and ``y``; lanes that are through fall out."""
        for s in range(0, self.length[0], window):
            steps = np.arange(s, min(self.length[0], s + window))
            running = np.searchsorted(-self.length, -steps)
            yield [self.begin[:n] + t for t, n in zip(steps, running)]

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sums of the tokens' values, in the order of the texts given."""
        return np.bincount(np.repeat(self.order, self.lens), values, minlength=len(self.order))


def _gates(m: dict) -> tuple[np.ndarray, np.ndarray]:
    """Input weights, one row a token, and state weights, one row a gate unit. A sigmoid is 1 / (1 + exp(-x)), so
    those of the reset and update gates are negated."""
    sign = np.ones(m["b"].shape, m["b"].dtype)
    sign[: 2 * m["U"].shape[0]] = -1
    return (m["E"] + m["b"]) * sign, np.ascontiguousarray((m["U"] * sign).T)


def _forward(gates: tuple, h: np.ndarray, lanes: _Lanes, places: list[np.ndarray], tape: list | None = None) -> list[np.ndarray]:
    """The states after each step of a window; with ``tape``, also what backpropagation needs."""
    (xs, us), n = gates, len(h)
    inputs, end = xs.take(lanes.x[np.concatenate(places)], axis=0), 0
    out = []
    with np.errstate(over="ignore"):  # 1 / (1 + inf) is the sigmoid's limit
        for at in places:
            h = h[:, : len(at)]
            fresh = lanes.fresh[at]
            if fresh.any():
                h = h * ~fresh
            x, end = inputs[end : end + len(at)].T, end + len(at)
            u = us @ h
            rz = x[: 2 * n] + u[: 2 * n]
            np.exp(rz, out=rz)
            rz += _F(1)
            np.reciprocal(rz, out=rz)
            r, z, un = rz[:n], rz[n:], u[2 * n :]
            c = r * un
            c += x[2 * n :]
            np.tanh(c, out=c)
            new = h - c
            if tape is not None:
                tape.append((h, fresh, r, z, un, c, new.copy()))
            new *= z
            new += c
            h = new
            out.append(h)
    return out


def _rows(hs: list[np.ndarray]) -> np.ndarray:
    """States as rows, with a column of ones that takes up the bias."""
    out = np.empty((sum(h.shape[1] for h in hs), len(hs[0]) + 1), hs[0].dtype)
    out[:, -1] = 1
    i = 0
    for h in hs:
        out[i : i + h.shape[1], :-1] = h.T
        i += h.shape[1]
    return out


class _Softmax:
    """One softmax a row. States lie within -1 and 1, so the weights bound the logits; the largest is
    subtracted only where they could overflow."""

    def __init__(self, logits: np.ndarray, weights: np.ndarray, target: np.ndarray):
        if np.abs(weights).sum(-2).max() > 80:
            logits -= logits.max(1, keepdims=True)
        self.pick = np.arange(len(logits)) * logits.shape[1] + target
        picked = logits.ravel()[self.pick]
        self.e = np.exp(logits, out=logits)
        self.sum = self.e @ np.ones(logits.shape[1], logits.dtype)
        self.log_p = picked - np.log(self.sum)

    def gradient(self) -> np.ndarray:
        """Of -sum log p, by logit."""
        self.e *= (1 / self.sum)[:, None]
        self.e.reshape(-1)[self.pick] -= 1
        return self.e


def _output(m: dict, h: np.ndarray, targets: np.ndarray, grad: dict | None = None):
    """log p of each target given the row of its state; with ``grad``, sets the gradients of -sum log p and
    returns that of the states too."""
    k, n, per = m["W"].shape
    cls = targets // per
    order = np.argsort(cls.astype(np.uint16), kind="stable")
    cls, h = cls[order], h.take(order, axis=0)
    word = targets[order] - cls * per
    cuts = np.searchsorted(cls, np.arange(k + 1))
    spans = [(i, a, b) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
    big = np.concatenate([m["C"], m["c"][None]])
    small = np.concatenate([m["W"], m["w"][:, None]], 1)
    logits = np.empty((len(h), per), h.dtype)
    for i, a, b in spans:
        np.matmul(h[a:b], small[i], out=logits[a:b])
    of_class, of_word = _Softmax(h @ big, big, cls), _Softmax(logits, small, word)
    out = np.empty(len(h))
    out[order] = of_class.log_p + of_word.log_p
    if grad is None:
        return out
    d = of_class.gradient()
    g = h.T @ d
    grad["C"], grad["c"] = g[:n], g[n]
    dh = d @ m["C"].T
    d = of_word.gradient()
    grad["W"], grad["w"] = np.zeros_like(m["W"]), np.zeros_like(m["w"])
    for i, a, b in spans:
        g = h[a:b].T @ d[a:b]
        grad["W"][i], grad["w"][i] = g[:n], g[n]
        dh[a:b] += d[a:b] @ m["W"][i].T
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    return out, dh.take(place, axis=0)


def _sums(rows: np.ndarray, keys: np.ndarray, size: int) -> np.ndarray:
    """For each key below ``size`` the sum of its rows. Those of a frequent key lie together and are one product; of
    all others the first rows are added at once, then the second ones, and so on."""
    counts = np.bincount(keys, minlength=size)
    begin = np.cumsum(counts) - counts
    rows = rows.take(np.argsort(keys.astype(np.uint16), kind="stable"), axis=0)
    out = np.zeros((size, rows.shape[1]), rows.dtype)
    for k in np.flatnonzero(counts >= _MANY):
        out[k] = np.ones(counts[k], rows.dtype) @ rows[begin[k] : begin[k] + counts[k]]
    few = np.flatnonzero((counts > 0) & (counts < _MANY))
    if len(few):
        few = few[np.argsort(-counts[few], kind="stable")]
        first, left = begin[few], np.searchsorted(-counts[few], -np.arange(counts[few[0]]))
        total = rows.take(first, axis=0)
        for j, n in enumerate(left[1:], 1):
            total[:n] += rows.take(first[:n] + j, axis=0)
        out[few] = total
    return out


def _backward(m: dict, tape: list, dh: np.ndarray, tokens: np.ndarray, grad: dict) -> None:
    """Truncated backpropagation through the steps of one window; ``dh`` has the loss gradient of the state
    after each step, one row a token, and ``tokens`` what the step read."""
    n = m["U"].shape[0]
    # the rows of ``d``: candidate, reset and update gate by input, then the candidate by state
    back = np.ascontiguousarray(m["U"])
    d_rows = np.empty((len(dh), 4 * n), dh.dtype)
    carry, end = None, len(dh)
    for h, fresh, r, z, un, c, diff in reversed(tape):
        a = h.shape[1]
        got = np.ascontiguousarray(dh[end - a : end].T)
        if carry is not None:
            got[:, : carry.shape[1]] += carry
        d = np.empty((4 * n, a), dh.dtype)
        kept = got * z
        dc = d[:n]
        np.subtract(got, kept, out=dc)
        dc *= 1 - c * c
        np.multiply(dc, r, out=d[3 * n :])
        dr = d[n : 2 * n]
        np.multiply(d[3 * n :], un, out=dr)
        dr *= 1 - r
        dz = d[2 * n : 3 * n]
        np.multiply(kept, diff, out=dz)
        dz *= 1 - z
        carry = back @ d[n:]
        carry += kept
        if fresh.any():
            carry *= ~fresh
        d_rows[end - a : end] = d.T
        end -= a
    before = _rows([x[0] for x in tape])[:, :n]
    grad["U"] = before.T @ d_rows[:, n:]
    sums = _sums(d_rows, tokens, len(m["E"]))
    grad["E"] = np.concatenate([sums[:, n : 3 * n], sums[:, :n]], 1)  # as in the model: reset, update, candidate
    grad["b"] = grad["E"].sum(0)


def score(m: dict, texts: list[np.ndarray], window: int = 32, batch: int = 300) -> np.ndarray:
    """Natural-log probability of each whole text; windows of any length give the same result, as the
    state goes on from one to the next."""
    if not texts:
        return np.zeros(0)
    lanes, gates = _Lanes(texts, batch), _gates(m)
    out = np.zeros(len(lanes.y))
    h = np.zeros((m["U"].shape[0], len(lanes.length)), _F)
    for places in lanes.windows(window):
        hs = _forward(gates, h, lanes, places)
        at = np.concatenate(places)
        out[at] = _output(m, _rows(hs), lanes.y[at])
        h = hs[-1]
    return lanes.per_text(out)


class Adam:
    """Adam over the flat parameters."""

    def __init__(self, model: dict, rate: float):
        self.model, self.rate, self.t = model, rate, 0
        self.m, self.v = ({k: np.zeros_like(a) for k, a in model.items()} for _ in range(2))

    def update(self, grad: dict) -> None:
        self.t += 1
        fix = np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grad.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.model[k] -= _F(self.rate * fix) * self.m[k] / (np.sqrt(self.v[k]) + _F(1e-8))


def train(m: dict, texts: list[np.ndarray], opt: Adam, window: int = 32, batch: int = 300) -> None:
    """One pass over all texts. The state runs through the windows of a text, and each is learned from."""
    lanes = _Lanes(texts, batch)
    h = np.zeros((m["U"].shape[0], len(lanes.length)), _F)
    for places in lanes.windows(window):
        tape, grad = [], {}
        hs = _forward(_gates(m), h, lanes, places, tape)
        at = np.concatenate(places)
        _, dh = _output(m, _rows(hs), lanes.y[at], grad)
        _backward(m, tape, dh, lanes.x[at], grad)
        n = _F(1 / len(at))
        for g in grad.values():
            g *= n
            np.clip(g, -0.5, 0.5, out=g)
        opt.update(grad)
        h = hs[-1]
