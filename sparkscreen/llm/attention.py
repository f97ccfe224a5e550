"""A small causal self-attention language model in numpy: training by back-propagation, scoring in overlapping windows.

The model predicts the class of the next subword: the log share of the class after the current subword, as counted, plus what
attention adds. One head with a learned bias for each distance looks at the current and earlier subwords, followed by a
two-layer feed-forward part, both with residual connections; the output weights begin at 0, so training begins at the counts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Width, hidden width of the feed-forward part, scored subwords a window; a window sees 2 * STRIDE subwords.
WIDTH, HIDDEN, STRIDE = 16, 32, 16
FAR = 2 * STRIDE
#: Windows of a training step; windows scored at once, so few that the arrays stay in a core's cache.
STEP, BLOCK = 48, 96
#: Positions whose classes training goes through at once.
PART = 768
#: How far back of each position each other one is, and what bars later ones.
BACK = np.maximum(np.arange(FAR)[:, None] - np.arange(FAR), 0)
LATER = np.where(np.arange(FAR)[:, None] < np.arange(FAR), np.float32(-1e9), np.float32(0))
NAMES = ("emb", "wq", "wk", "wv", "wo", "rel", "w1", "b1", "w2", "out")

Params = dict[str, np.ndarray]


@dataclass
class After:
    """The counted log shares of the classes after a unit: row says which of the table's rows is a unit's. Where the functions get
    rows, one for each unit given, those hold instead."""

    table: np.ndarray
    row: np.ndarray


def shapes(units: int, classes: int) -> dict[str, tuple[int, ...]]:
    d, h = WIDTH, HIDDEN
    return {"emb": (units, d), "wq": (d, d), "wk": (d, d), "wv": (d, d), "wo": (d, d), "rel": (FAR,), "w1": (d, h), "b1": (h,), "w2": (h, d), "out": (d, classes)}


def start(units: int, classes: int, seed: int = 0) -> Params:
    rng = np.random.default_rng(seed)
    scale = lambda k, s: 0.0 if k == "out" or len(s) == 1 else 0.5 if k == "emb" else s[0] ** -0.5
    return {k: (rng.standard_normal(s) * scale(k, s)).astype(np.float32) for k, s in shapes(units, classes).items()}


def pack(p: Params) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in NAMES])


def unpack(flat: np.ndarray, units: int, classes: int) -> Params:
    out, at = {}, 0
    for k, s in shapes(units, classes).items():
        n = int(np.prod(s))
        out[k] = flat[at : at + n].reshape(s).astype(np.float32)
        at += n
    return out


def wide(table: np.ndarray, fill: float = -200.0) -> np.ndarray:
    """The columns and further ones, which have no share, up to a multiple of 16: rows that begin where cache lines do multiply faster."""
    if table.shape[1] % 16 == 0:
        return table
    out = np.full((len(table), -(-table.shape[1] // 16) * 16), fill, np.float32)
    out[:, : table.shape[1]] = table
    return out


def gradients(p: Params, units: np.ndarray, targets: np.ndarray, after: After, rows: np.ndarray | None = None) -> tuple[float, Params]:
    """Mean cross-entropy and its gradients for windows of FAR units (B, FAR) and next classes (B, FAR). Shorter windows are
    filled up at their end with any unit and the class -1, which count for nothing. The gradient of emb is (rows, their gradients).

    Queries, keys and values come from one product, and the scale of the queries is part of it; sums over a row are products
    with ones. The classes are gone through PART positions at a time, so that their arrays stay in a core's cache."""
    b, n = units.shape
    d, scale = WIDTH, np.float32(WIDTH**-0.5)
    rows = (after.row[units] if rows is None else rows).ravel()
    table, out, whole = wide(after.table), wide(p["out"], 0.0), units.ravel()
    ones = np.ones(max(b * n, table.shape[1]), np.float32)
    qkv = np.concatenate([p["wq"] * scale, p["wk"], p["wv"]], axis=1)
    x = np.take(p["emb"], whole, axis=0)
    q, k, v = ((x @ qkv[:, c * d : (c + 1) * d]).reshape(b, n, d) for c in range(3))
    a = q @ k.transpose(0, 2, 1)
    a += p["rel"][BACK[:n, :n]] + LATER[:n, :n]
    if a.max() > 60:
        np.minimum(a, 60, out=a)
    np.exp(a, out=a)
    a /= (a.reshape(b * n, n) @ ones[:n]).reshape(b, n, 1)
    c = (a @ v).reshape(b * n, d)
    h = c @ p["wo"]
    h += x
    f = h @ p["w1"]
    f += p["b1"]
    np.maximum(f, 0, out=f)
    g = f @ p["w2"]
    g += h
    goal = targets.ravel()
    own = np.flatnonzero(goal >= 0)
    filled = len(own) < b * n
    rows, said, goal = (rows[own], g[own], goal[own]) if filled else (rows, g, goal)
    each, loss = np.float32(1 / len(own)), 0.0
    of_out, dg, by_class = np.zeros((table.shape[1], d), np.float32), np.empty((len(own), d), np.float32), np.ascontiguousarray(out.T)
    most = min(PART, len(own))
    e_all, t_all, here_all = np.empty((most, table.shape[1]), np.float32), np.empty((most, table.shape[1]), np.float32), np.arange(most) * table.shape[1]
    for at in range(0, len(own), PART):
        some = said[at : at + PART]
        m = len(some)
        e = np.matmul(some, out, out=e_all[:m])
        e += np.take(table, rows[at : at + m], axis=0, out=t_all[:m], mode="clip")
        if e.max() > 80:
            np.minimum(e, 80, out=e)
        np.exp(e, out=e)
        total = e @ ones[: e.shape[1]]
        flat, here = e.reshape(-1), here_all[:m] + goal[at : at + m]
        loss -= float(np.log(np.maximum(flat[here] / total, 1e-30)).sum())
        e *= (each / total)[:, None]
        flat[here] -= each
        of_out += e.T @ some
        np.matmul(e, by_class, out=dg[at : at + m])
    grad: Params = {"out": of_out.T[:, : p["out"].shape[1]]}
    if filled:
        dg, part = np.zeros((b * n, d), np.float32), dg
        dg[own] = part
    df = dg @ p["w2"].T
    df *= f > 0
    grad |= {"w2": f.T @ dg, "w1": h.T @ df, "b1": ones[: b * n] @ df}
    dh = df @ p["w1"].T
    dh += dg
    grad["wo"] = c.T @ dh
    dc = dh @ p["wo"].T
    each_c = dc.reshape(b, n, d)
    ds = each_c @ v.transpose(0, 2, 1)
    ds -= np.einsum("ij,ij->i", dc, c).reshape(b, n, 1)
    ds *= a
    grad["rel"] = np.bincount(BACK[:n, :n].ravel(), ones[:b] @ ds.reshape(b, n * n), n).astype(np.float32)  # 0 where j > i
    back = np.concatenate([t.reshape(b * n, d) for t in (ds @ k, ds.transpose(0, 2, 1) @ q, a.transpose(0, 2, 1) @ each_c)], axis=1)
    grad["wq"], grad["wk"], grad["wv"] = np.split(x.T @ back, 3, axis=1)
    grad["wq"] *= scale
    dx = back @ qkv.T
    dx += dh
    order = np.argsort(whole.astype(np.uint16 if len(p["emb"]) <= 1 << 16 else np.int64), kind="stable")
    of = whole[order]
    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    grad["emb"] = (of[first], np.add.reduceat(dx[order], first, axis=0))
    return loss / len(own), grad


class Adam:
    """Adam whose moments of an embedding change when its unit occurs."""

    def __init__(self, p: Params):
        self.p, self.step = p, 0
        self.m, self.s = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))

    def learn(self, units: np.ndarray, targets: np.ndarray, after: After, rate: float, rows: np.ndarray) -> float:
        self.step += 1
        loss, grad = gradients(self.p, units, targets, after, rows)
        scale = np.float32(rate * np.sqrt(1 - 0.99**self.step) / (1 - 0.9**self.step))
        for k, g in grad.items():
            at, g = g if k == "emb" else (slice(None), g)
            m, s = self.m[k][at], self.s[k][at]
            m += (g - m) * np.float32(0.1)
            s += (g * g - s) * np.float32(0.01)
            self.m[k][at], self.s[k][at] = m, s
            self.p[k][at] -= scale * m / (np.sqrt(s) + np.float32(1e-8))
        return loss

    def train(self, units: np.ndarray, targets: np.ndarray, after: After, rate: float, rows: np.ndarray | None = None) -> list[float]:
        """One pass over the windows; the losses of its steps."""
        after = After(wide(after.table), after.row)
        rows = after.row[units] if rows is None else rows
        return [self.learn(*(t[at : at + STEP] for t in (units, targets)), after, rate, rows[at : at + STEP]) for at in range(0, len(units), STEP)]


def score(p: Params, units: np.ndarray, targets: np.ndarray, doc: np.ndarray, after: After, rows: np.ndarray | None = None) -> np.ndarray:
    """Natural log probability of each target class. units: the current subword's unit at each position of a flat run of
    texts, doc: its text. Each window scores STRIDE positions of a text and sees those before them in the window of the same
    text; windows begin where a text does, so that its score doesn't depend on its neighbours.

    What depends on the unit alone is computed once a unit, and large arrays are used again from block to block. The counted shares
    multiply the exponentials of what attention adds; only the target's logarithm is looked up."""
    d, st = WIDTH, STRIDE
    begin = np.flatnonzero(np.diff(doc, prepend=-1))
    size = np.diff(begin, append=len(doc))
    whole = -(-size // st) * st
    place = np.arange(len(doc)) + np.repeat(st + np.cumsum(whole) - whole - begin, size)
    n = int(whole.sum())
    rows = after.row[units] if rows is None else rows
    seen, goal, counted = (np.zeros(n + st, np.int32) for _ in range(3))
    seen[place], goal[place], counted[place] = units, targets, rows
    opens = np.zeros(n // st, bool)  # windows with which a text begins: nothing is before
    opens[(np.cumsum(whole) - whole) // st] = True
    i, j = np.arange(st)[:, None] + st, np.arange(FAR)[None, :]
    bias = np.where(j <= i, p["rel"][np.clip(i - j, 0, FAR - 1)], np.float32(-1e9)).astype(np.float32)
    by_unit = p["emb"], p["emb"] @ p["wq"] * np.float32(d**-0.5), p["emb"] @ p["wk"], p["emb"] @ p["wv"] @ p["wo"]
    share, out, ones = np.exp(wide(after.table)), wide(p["out"], 0.0), np.ones(FAR, np.float32)
    most = min(BLOCK * st, n)
    taken = [np.empty((most + st, d), np.float32) for _ in by_unit]
    near = np.empty((most // st, st, FAR), np.float32)
    z, y = (np.empty((most, out.shape[1]), np.float32) for _ in range(2))
    here = np.arange(most) * out.shape[1]
    own, total = (np.empty(n + st, np.float32) for _ in range(2))
    for at in range(0, n, most):
        m = min(most, n - at)
        w, now = m // st, slice(at + st, at + st + m)
        x, q = (np.take(by_unit[t], seen[now], axis=0, out=taken[t][:m], mode="clip") for t in (0, 1))
        k, v = (np.take(by_unit[t], seen[at : now.stop], axis=0, out=taken[t][: m + st], mode="clip") for t in (2, 3))
        window = lambda t: np.lib.stride_tricks.as_strided(t, (w, FAR, d), (st * t.strides[0], *t.strides))
        a = np.matmul(q.reshape(w, st, d), window(k).transpose(0, 2, 1), out=near[:w])
        a += bias
        if a.max() > 60:
            np.minimum(a, 60, out=a)
        np.exp(a, out=a)
        a[opens[at // st : at // st + w], :, :st] = 0
        h = (a @ window(v)).reshape(m, d)
        h /= (a.reshape(m, FAR) @ ones)[:, None]
        h += x
        f = h @ p["w1"]
        f += p["b1"]
        h += np.maximum(f, 0, out=f) @ p["w2"]
        s = np.matmul(h, out, out=z[:m])
        if s.max() > 80:
            np.minimum(s, 80, out=s)
        np.take(s.reshape(-1), here[:m] + goal[now], out=own[now], mode="clip")
        np.exp(s, out=s)
        np.einsum("ij,ij->i", s, np.take(share, counted[now], axis=0, out=y[:m], mode="clip"), out=total[now])
    return own[place] + after.table[rows, targets] - np.log(total[place].astype(np.float64))
