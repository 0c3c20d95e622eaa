"""A small causal self-attention model over subword ids, in numpy.

One attention layer and one feed-forward layer read windows of ids.  Keys and values
are the inputs' vectors themselves: with one head of full width, a key matrix times
the query matrix is one matrix (``Q``), a value matrix times the output matrix another
(``W``), so matrices of their own would add work and no model.  The next id's
probability has two factors, so every id of the vocabulary has a share and the
shares add to one: the id's class, then the id within its class.  The most
frequent ids are classes of their own, the other ids seen in training are dealt
by frequency into ``tails`` classes, and all unseen ids form one class and share
it evenly.  Biases start at the log frequencies of the whole training text.

Windows of ``width`` inputs overlap by ``width - stride``: the first scores all
its targets, each later one its last ``stride``, so each id is scored once.
"""

from __future__ import annotations

import ctypes

import numpy as np

START = 1
DENSE = ("P", "Q", "W", "A", "a", "B", "C", "c")


class Vocabulary:
    """Classes of ids from their counts in training (index: id)."""

    def __init__(self, counts: np.ndarray, heads: int = 32, tails: int = 32):
        order = np.argsort(-counts, kind="stable")
        seen = order[: int((counts > 0).sum())]
        self.seen, self.size = seen.size, counts.size
        self.index = np.full(counts.size, self.seen, np.int64)  # unseen ids share the last row
        self.index[seen] = np.arange(self.seen)
        self.heads = min(heads, self.seen)
        rest = self.seen - self.heads
        self.tails = min(tails, rest)
        self.classes = self.heads + self.tails + 1
        of = np.arange(self.heads), self.heads + np.arange(rest) * self.tails // max(rest, 1), [self.classes - 1]
        self.class_of = np.concatenate(of).astype(np.int64)
        self.first = np.searchsorted(self.class_of, np.arange(self.classes + 1))
        self.counts = counts[seen].astype(np.float64)

    def unseen_log(self) -> float:
        return -float(np.log(max(self.size - self.seen, 1)))


def start(v: Vocabulary, d: int = 32, hidden: int = 64, width: int = 64, seed: int = 7) -> dict[str, np.ndarray]:
    """First parameters: the unigram model."""
    rng = np.random.default_rng(seed)

    def normal(*shape: int, scale: float = 0.1) -> np.ndarray:
        return rng.normal(0, scale, shape).astype(np.float32)

    mass = np.bincount(v.class_of[:-1], weights=v.counts, minlength=v.classes) + 0.5
    return {
        "E": normal(v.seen + 1, d, scale=0.5), "P": normal(width, d), "Q": normal(d, d, scale=d**-0.5), "W": normal(d, d),
        "A": normal(d, hidden, scale=d**-0.5), "a": np.zeros(hidden, np.float32),
        "B": normal(hidden, d), "C": normal(d, v.classes, scale=0.02), "c": np.log(mass / mass.sum()).astype(np.float32),
        "O": normal(v.seen, d, scale=0.02), "o": np.log(v.counts / max(v.counts.sum(), 1)).astype(np.float32),
    }


def keep_heap() -> None:
    """Have the C library keep up to 256 MB of freed arrays in this process: it would else give their pages back, and each
    step would have them zeroed anew.  Elsewhere than with glibc nothing changes."""
    try:
        of = ctypes.CDLL(None).mallopt
    except (AttributeError, OSError, TypeError):
        return
    of(-3, 32 << 20)  # M_MMAP_THRESHOLD: its greatest value
    of(-1, 256 << 20)  # M_TRIM_THRESHOLD


def windows(n: int, width: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows over ``n`` inputs and the first target in each that counts."""
    starts = np.arange(1 + max(0, -(-(n - width) // stride))) * stride
    return starts, np.where(starts > 0, width - stride, 0)


def _first(count: np.ndarray) -> int:
    """First place that has a counted target in any window; places before it are keys and values only."""
    return int(count.any(axis=0).argmax())


def _body(p: dict, x: np.ndarray, lo: int = 0) -> tuple:
    """Hidden vectors of the index windows ``x`` (B, L) from place ``lo`` on, and what the way back needs."""
    e = p["E"].take(x, axis=0)
    e += p["P"][: x.shape[1]]
    n, length, d = e.shape
    own = e[:, lo:].reshape(-1, d)
    q = (own @ (p["Q"] * np.float32(d**-0.5))).reshape(n, length - lo, d)
    s = q @ e.transpose(0, 2, 1)
    if not s.max() <= 60:
        np.minimum(s, 60, out=s)  # keeps exp finite
    np.exp(s, out=s)
    rows = s.reshape(n, -1)
    rows *= np.tri(length - lo, length, lo, np.float32).ravel()
    total = _row_sums(s.reshape(-1, length)).reshape(n, length - lo, 1)
    m = s @ e
    m /= total
    h = m.reshape(-1, d) @ p["W"]
    h += own
    r = h @ p["A"]
    r += p["a"]
    np.maximum(r, 0, out=r)
    g = r @ p["B"]
    g += h
    return g.reshape(n, length - lo, d), (e, own, q, s, total, m, h, r)


def _row_sums(z: np.ndarray) -> np.ndarray:
    return z @ np.ones(z.shape[1], z.dtype)


def _fits(z: np.ndarray) -> bool:
    """No row's exponentials leave the range of floats, so no row needs its greatest number taken off."""
    return bool(z.max() < 60 and z.min() > -60)


def _picked(z: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log softmax of one column per row and the sums of the rows' exponentials, which take the place of ``z``."""
    if not _fits(z):
        z -= z.max(axis=1, keepdims=True)
    got = z[np.arange(len(z)), at]
    np.exp(z, out=z)
    total = _row_sums(z)
    return got - np.log(total), total


def _order(at: np.ndarray) -> np.ndarray:
    """Stable order; of small numbers by a radix sort."""
    return np.argsort(at.astype(np.uint16) if at.size and at.max() < 1 << 16 else at, kind="stable")


def _within(p: dict, v: Vocabulary, g: np.ndarray, cls: np.ndarray, y: np.ndarray) -> tuple:
    """Log softmax of the targets of tail classes within their class: rows in order of class, logs, and for the way back
    the rows' vectors, exponentials of all their classes' ids in one array, the targets' places there, sums of the rows,
    and per class (rows, ids, exponentials)."""
    order = _order(cls)
    of = cls[order]
    a, b = np.searchsorted(of, [v.heads, v.classes - 1])
    rows, of = order[a:b], of[a:b]
    if not rows.size:
        return rows, np.empty(0), None, None, None, None, []
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    n = np.diff(np.r_[first, rows.size])
    wide = (v.first[1:] - v.first[:-1])[of[first]]
    begin = np.cumsum(n * wide) - n * wide
    mine, flat, parts = g[rows], np.empty(int((n * wide).sum()), g.dtype), []
    for c, r, k, w, at in zip(of[first].tolist(), first.tolist(), n.tolist(), wide.tolist(), begin.tolist()):
        ids = slice(int(v.first[c]), int(v.first[c]) + w)
        u = flat[at : at + k * w].reshape(k, w)
        np.matmul(mine[r : r + k], p["O"][ids].T, out=u)
        u += p["o"][ids]
        parts.append((slice(r, r + k), ids, u))
    if not _fits(flat):
        for _, _, u in parts:
            u -= u.max(axis=1, keepdims=True)
    place = np.repeat(begin - first * wide, n) + np.arange(rows.size) * np.repeat(wide, n) + y[rows] - v.first[of]
    got = flat[place]
    np.exp(flat, out=flat)
    total = np.empty(rows.size, g.dtype)
    for r, _, u in parts:
        total[r] = _row_sums(u)
    return rows, got - np.log(total), mine, flat, place, total, parts


def log_probs(p: dict, v: Vocabulary, x: np.ndarray, y: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Natural log probabilities of the targets y (B, L) marked in ``count``, in row order."""
    g = []
    for at in range(0, len(x), 32):
        lo = _first(count[at : at + 32])
        g.append(_body(p, x[at : at + 32], lo)[0][count[at : at + 32, lo:]])
    g, y = np.concatenate(g), y[count]
    cls = v.class_of[y]
    out = np.empty(y.size, np.float64)
    for at in range(0, y.size, 1024):
        part = slice(at, at + 1024)
        z = g[part] @ p["C"]
        z += p["c"]
        out[part] = _picked(z, cls[part])[0]
    for at in range(0, y.size, 4096):
        part = slice(at, at + 4096)
        rows, logs, *_ = _within(p, v, g[part], cls[part], y[part])
        out[at + rows] += logs
    out[cls == v.classes - 1] += v.unseen_log()
    return out


def _sum_rows(at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = _order(at)
    at = at[order]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return at[first], np.add.reduceat(values.take(order, axis=0), first, axis=0)


def gradients(p: dict, v: Vocabulary, x: np.ndarray, y: np.ndarray, count: np.ndarray) -> tuple[float, dict, dict]:
    """Summed loss, gradients of the dense parameters, and (rows, gradients) of E, O and o; both are means."""
    lo = _first(count)
    top, (e, own, q, s, total, m, h, r) = _body(p, x, lo)
    s /= total
    shape, picked = top.shape, np.flatnonzero(count[:, lo:])
    d = shape[2]
    g, t = top.reshape(-1, d), y[:, lo:].ravel()
    whole = picked.size == t.size
    if not whole:
        g, t = g[picked], t[picked]
    n = t.size
    cls = v.class_of[t]
    dz = g @ p["C"]
    dz += p["c"]
    logs, sums = _picked(dz, cls)
    loss = -float(logs.sum())
    dz *= (1 / (n * sums))[:, None]
    dz[np.arange(n), cls] -= np.float32(1 / n)
    dense = {"C": g.T @ dz, "c": np.ones(n, dz.dtype) @ dz}
    dg = dz @ p["C"].T
    rows, logs, mine, u, place, sums, parts = _within(p, v, g, cls, t)
    if parts:
        loss -= float(logs.sum())
        share = 1 / (n * sums)
        for span, _, of in parts:
            of *= share[span, None]
        u[place] -= np.float32(1 / n)
        back, rows_o = np.empty_like(mine), np.concatenate([np.arange(ids.start, ids.stop) for _, ids, _ in parts])
        grad_o, grad_b, at = np.empty((rows_o.size, d), g.dtype), np.empty(rows_o.size, g.dtype), 0
        for span, ids, of in parts:
            np.matmul(of, p["O"][ids], out=back[span])
            z = at + of.shape[1]
            np.matmul(of.T, mine[span], out=grad_o[at:z])
            np.matmul(np.ones(len(of), g.dtype), of, out=grad_b[at:z])
            at = z
        dg[rows] += back
    dtop = dg if whole else np.zeros((top.size // d, d), top.dtype)
    if not whole:
        dtop[picked] = dg
    flat = lambda t: t.reshape(-1, t.shape[-1])
    dr = dtop @ p["B"].T
    dr *= r > 0
    dh = dr @ p["A"].T
    dh += dtop
    dense |= {"B": r.T @ dtop, "A": h.T @ dr, "a": dr.sum(axis=0), "W": flat(m).T @ dh}
    dm = (dh @ p["W"].T).reshape(shape)
    root = np.float32(d**-0.5)
    ds = dm @ e.transpose(0, 2, 1)
    ds -= np.einsum("ijk,ijk->ij", dm, m)[:, :, None]  # the sum of ds * s
    ds *= s
    dq = flat(ds @ e)
    dq *= root
    de = ds.transpose(0, 2, 1) @ q  # q is scaled already
    de += s.transpose(0, 2, 1) @ dm
    dh += dq @ p["Q"].T
    de[:, lo:] += dh.reshape(shape)
    dense["Q"] = own.T @ dq
    dense["P"] = np.zeros_like(p["P"])
    dense["P"][: x.shape[1]] = de.sum(axis=0)
    sparse = {"E": _sum_rows(x.ravel(), flat(de))}
    if parts:
        sparse |= {"O": (rows_o, grad_o), "o": (rows_o, grad_b)}
    return loss, dense, sparse


class Trainer:
    """Adagrad steps from given parameters; rows that a batch doesn't touch cost nothing."""

    def __init__(self, p: dict, v: Vocabulary, rate: float = 0.1, dense_rate: float = 0.04):
        self.p, self.v = {k: a.copy() for k, a in p.items()}, v
        self.rate, self.dense_rate = rate, dense_rate
        self.seen = {k: np.full_like(a, 1e-8) for k, a in p.items()}
        self.tokens, self.loss = 0, 0.0

    def step(self, x: np.ndarray, y: np.ndarray, count: np.ndarray) -> None:
        loss, dense, sparse = gradients(self.p, self.v, x, y, count)
        for k, g in dense.items():
            self.seen[k] += g * g
            self.p[k] -= self.dense_rate * g / np.sqrt(self.seen[k])
        for k, (rows, g) in sparse.items():
            if rows[-1] - rows[0] == rows.size - 1:
                rows = slice(int(rows[0]), int(rows[-1]) + 1)  # views, not copies
            seen = self.seen[k][rows]
            seen += g * g
            if not isinstance(rows, slice):
                self.seen[k][rows] = seen
            g *= self.rate
            g /= np.sqrt(seen)
            self.p[k][rows] -= g
        self.tokens += int(count.sum())
        self.loss += loss


def batches(docs: list[np.ndarray], v: Vocabulary, width: int, stride: int, group: int, pick=None):
    """(x, y, count, doc of each counted target) of windows of about one length and one first target, ``group`` at a time.

    ``docs`` are id sequences with their end id; ``pick(doc, starts)`` may choose windows.
    """
    if not docs:
        return
    seqs = [v.index[np.concatenate([[START], d.astype(np.int64)])] for d in docs]
    base = np.concatenate([[0], np.cumsum([s.size for s in seqs])])
    flat = np.concatenate([*seqs, np.zeros(width + 1, np.int64)])
    doc, begin, skip, length = [], [], [], []
    for i, s in enumerate(seqs):
        n = s.size - 1
        starts, first = windows(n, width, stride)
        if pick is not None:
            chosen = pick(i, starts)
            starts, first = starts[chosen], first[chosen]
        doc.append(np.full(starts.size, i))
        begin.append(base[i] + starts)
        skip.append(first)
        length.append(np.minimum(width, n - starts))
    doc, begin, skip, length = map(np.concatenate, (doc, begin, skip, length))
    order = np.lexsort((length, skip))
    for at in range(0, order.size, group):
        part = order[at : at + group]
        span = np.arange(int(length[part].max()))
        place = np.minimum(begin[part, None] + span, flat.size - 2)
        count = (span >= skip[part, None]) & (span < length[part, None])
        yield flat[place], flat[place + 1], count, np.repeat(doc[part], count.sum(axis=1))
