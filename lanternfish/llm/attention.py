"""A small causal self-attention language model in numpy: training and batched scoring.

One attention layer over token embeddings, with a learnt bias for each distance. Queries,
keys and values depend on the token alone, so each is one table row per vocabulary entry.
The next token is predicted in two steps, its class and then its place in the class.
Classes are runs of entries in order of frequency, each wider than the one before as far
as entries get rarer, so that rare entries need few classes. Entries never met in training
share the last class evenly, so every sequence has a probability.
"""

from __future__ import annotations

import numpy as np

#: Tokens of a window, and how many of them are context only.
WINDOW, CONTEXT = 32, 8
#: Weights that a step of Adam changes at once, so that they stay in a core's cache.
ADAM_AT_ONCE = 1 << 15
#: Width of a class over that of the one before, at most, and outputs of one class held at once.
GROWTH, OUTPUTS = 1.3, 1 << 18


class Vocabulary:
    """Entries by falling training count: rank, class, place in the class."""

    def __init__(self, counts: np.ndarray):
        self.size = len(counts)
        order = np.lexsort((np.arange(self.size), -counts))
        self.seen = max(1, int((counts > 0).sum()))
        self.rank = np.empty(self.size, np.int64)
        self.rank[order] = np.arange(self.size)
        met = counts[order][: self.seen].astype(np.float64) + 0.5
        share = met / met.sum()
        self.log_count = np.log(share)
        self.unseen = self.size - self.seen
        #: ranks at which classes begin, and the end of the last
        self.begin = [0]
        width, sums = int(np.ceil(np.sqrt(self.seen))), np.append(0, np.cumsum(share))
        outputs = lambda n: n * (sums[min(self.begin[-1] + n, self.seen)] - sums[self.begin[-1]])
        while self.begin[-1] < self.seen:
            need = outputs(width)  # outputs inside this class that a token needs on average: the next class needs no more
            self.begin.append(min(self.begin[-1] + width, self.seen))
            wider = int(np.ceil(width * GROWTH))
            width = wider if outputs(wider) <= need else width
        self.classes = len(self.begin) - 1  # and one more for entries never met
        small = np.int16 if self.seen < 30_000 else np.int32
        #: class and place of each rank; rank seen stands for all entries never met
        self.begin = np.array(self.begin)
        self.cls = np.append(np.repeat(np.arange(self.classes), np.diff(self.begin)), self.classes).astype(small)
        self.place = np.append(np.arange(self.seen) - self.begin[self.cls[:-1]], 0).astype(small)


def start(v: Vocabulary, dim: int, seed: int = 3) -> dict[str, np.ndarray]:
    """Weights before training: biases hold the unigram model."""
    rng = np.random.default_rng(seed)
    mass = np.log(np.add.reduceat(np.exp(v.log_count), v.begin[:-1]))
    normal = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
    w = {"emb": normal(v.seen + 2, dim), "q": normal(dim, dim) * 3, "k": normal(dim, dim) * 3, "v": normal(dim, dim), "far": np.zeros(WINDOW, np.float32)}
    # row seen is any entry never met, row seen + 1 the start of a text
    w |= {"cls": normal(dim, v.classes + 1), "cls_b": np.append(mass, -12.0).astype(np.float32), "out": normal(v.seen, dim), "out_b": v.log_count.astype(np.float32)}
    return w


def _rows(v: Vocabulary, ids: np.ndarray) -> np.ndarray:
    """Embedding rows of entries; id -1 is the start of a text."""
    r = np.minimum(v.rank[ids], v.seen)
    return np.where(ids < 0, v.seen + 1, r)


_LAG = np.arange(WINDOW)[:, None] - np.arange(WINDOW)[None]


def _exps(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | float]:
    """Exponentials over the last axis less a shift a row, their sums, and the shift; none where no value is too large or small."""
    ones = np.ones(z.shape[-1], z.dtype)
    if z.size and z.max() < 50:
        e = np.exp(z)
        total = (e.reshape(-1, e.shape[-1]) @ ones).reshape(*e.shape[:-1], 1)
        if total.min() > 1e-20:
            return e, total, 0.0
    shift = z.max(axis=-1, keepdims=True, initial=-np.inf)
    e = z - shift
    np.exp(e, out=e)
    return e, (e.reshape(-1, e.shape[-1]) @ ones).reshape(*e.shape[:-1], 1), shift


def _attend(q, k, v, far, first):
    """Context of each window's last tokens (windows, tokens, dim); the first windows of texts don't see what is before them."""
    n = q.shape[1]
    before = k.shape[1] - n
    lag = _LAG[before : before + n, : k.shape[1]]
    bias = np.where(lag >= 0, far[np.abs(lag)], -1e9).astype(np.float32)
    a = q @ k.transpose(0, 2, 1)
    a += bias
    a[first, :, :before] = -1e9
    a, total, _ = _exps(a)
    c = a @ v
    c /= total
    return c


def _parts(a: int, b: int, width: int):
    """Slices of a..b that have at most OUTPUTS outputs of this width each."""
    step = max(1, OUTPUTS // width)
    for i in range(a, b, step):
        yield slice(i, min(i + step, b))


class Scorer:
    """Log probabilities with fixed weights."""

    def __init__(self, v: Vocabulary, w: dict[str, np.ndarray]):
        self.v, self.w = v, w
        dim = w["emb"].shape[1]
        self.q = (w["emb"] @ w["q"] / np.sqrt(dim)).astype(np.float32)
        self.k, self.val = (w["emb"] @ w["k"]).astype(np.float32), (w["emb"] @ w["v"]).astype(np.float32)
        # a token's rows of two tables lie together: one look-up each
        # a state ends in 1, so that biases are one more row of the output matrices
        one = np.ones((len(self.q), 1), np.float32)
        self.key_value = np.ascontiguousarray(np.hstack([self.k, self.val]))
        self.query_own = np.ascontiguousarray(np.hstack([self.q, w["emb"], one]))
        self.classes = np.vstack([w["cls"], w["cls_b"][None]]).astype(np.float32)
        turned = np.vstack([w["out"].T, w["out_b"][None]]).astype(np.float32)
        self.turned = [np.ascontiguousarray(turned[:, a:b]) for a, b in zip(v.begin[:-1], v.begin[1:], strict=True)]

    def next_log_prob(self, h: np.ndarray, ranks: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """Natural log probability of entries (by rank) after states h, or after the states at these places."""
        v = self.v
        if h.shape[1] < len(self.classes):
            h = np.hstack([h, np.ones((len(h), 1))]).astype(np.float32)
        ranks = np.minimum(ranks, v.seen)
        # by class, so that each class is one matrix product
        cls = v.cls[ranks]
        order = np.argsort(cls, kind="stable")
        h, cls, place = np.take(h, order if at is None else at[order], axis=0, mode="clip"), cls[order], v.place[ranks[order]]
        cut = np.searchsorted(cls, np.arange(v.classes + 2)).tolist()
        line = np.arange(len(h))
        z = h @ self.classes
        _, total, shift = _exps(z)
        lp = (z[line, cls] - np.ravel(shift)).astype(np.float64) - np.log(total[:, 0])
        for c, turned in enumerate(self.turned):
            for some in _parts(cut[c], cut[c + 1], turned.shape[1]):
                z = h[some] @ turned
                _, total, shift = _exps(z)
                lp[some] += z[line[: len(z)], place[some]] - np.ravel(shift) - np.log(total[:, 0])
        lp[cut[v.classes] :] -= np.log(max(1, v.unseen))
        out = np.empty(len(h))
        out[order] = lp
        return out

    def score(self, ids: np.ndarray, lengths: np.ndarray, at_once: int = 240) -> np.ndarray:
        """Natural log probability of each text; ids: all texts' tokens, one after the other."""
        return np.bincount(np.repeat(np.arange(len(lengths)), lengths), self.log_probs(ids, lengths, at_once), len(lengths))

    def log_probs(self, ids: np.ndarray, lengths: np.ndarray, at_once: int = 240) -> np.ndarray:
        """Natural log probability of each token, given those before it in its text.

        Each text is cut into windows that overlap by CONTEXT tokens; a window scores
        the tokens that no window before it has scored, so each token is scored once.
        """
        v, new, dim = self.v, WINDOW - CONTEXT, self.q.shape[1]
        n = -(-lengths // new)
        # each text's ranks from a window's start on, -1 between its end and the next text
        ranks = np.full(int(n.sum()) * new, -1, np.int32)
        ranks[np.repeat(np.cumsum(n) * new - n * new - np.cumsum(lengths) + lengths, lengths) + np.arange(len(ids))] = np.minimum(v.rank[ids], v.seen)
        # inputs of a window: the token before each scored token, and CONTEXT more before these
        inputs = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(CONTEXT + 1, np.int32), ranks]), WINDOW)[::new]
        opens = np.zeros(len(inputs), bool)  # first windows of texts
        opens[(np.cumsum(n) - n)[n > 0]] = True
        total = []
        for a in range(0, len(ranks) // new, at_once):
            rows, goal = inputs[a : min(a + at_once, len(ranks) // new)].copy(), ranks[a * new : (a + at_once) * new]
            first = np.flatnonzero(opens[a : a + at_once])
            rows[first, : CONTEXT + 1] = v.seen + 1  # the start of a text; what is before it isn't seen
            kv = np.take(self.key_value, rows, axis=0, mode="clip")
            own = np.take(self.query_own, rows[:, CONTEXT:], axis=0, mode="clip")
            h = own[..., dim:]
            h[..., :dim] += _attend(own[..., :dim], kv[..., :dim], kv[..., dim:], self.w["far"], first)
            live = np.flatnonzero(goal >= 0)
            total.append(self.next_log_prob(h.reshape(-1, dim + 1), goal[live], live))
        return np.concatenate(total or [np.zeros(0)])


class Goals:
    """Windows (n, WINDOW + 1) of ids as embedding rows of the inputs, and class and place of the token after each."""

    def __init__(self, v: Vocabulary, windows: np.ndarray):
        ids, goal = windows[:, :-1], windows[:, 1:]
        small = np.int16 if v.seen < 30_000 else np.int32
        self.rows = np.where(ids == -2, v.seen + 1, _rows(v, np.maximum(ids, -1))).astype(small)
        ranks = np.minimum(v.rank[np.maximum(goal, 0)], v.seen)
        self.cls = np.where(goal < 0, v.cls.dtype.type(-1), v.cls[ranks])
        self.place = v.place[ranks]

    def part(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.rows[at], self.cls[at], self.place[at]


def train(v: Vocabulary, w: dict[str, np.ndarray], windows: np.ndarray, *, rate: float, batch: int = 256, least_steps: int = 300, seed: int = 0) -> dict[str, np.ndarray]:
    """Adam over windows (n, WINDOW + 1) of ids, -1 before a text's start, -2 after its end.

    One pass over all windows, or as many as make `least_steps`; where windows are few, batches are smaller.
    """
    # all weights in one array, of which w has views; so have their gradients
    flat = np.concatenate([x.ravel() for x in w.values()])
    grads, m, s = np.zeros_like(flat), np.zeros_like(flat), np.zeros_like(flat)
    ends = np.cumsum([x.size for x in w.values()])
    views = lambda one: {k: one[e - x.size : e].reshape(x.shape) for (k, x), e in zip(w.items(), ends, strict=True)}
    w, into = views(flat), views(grads)
    rng = np.random.default_rng(seed)
    batch = int(np.clip(len(windows) // least_steps, 128, batch))
    passes = max(1, -(-least_steps * batch // max(1, len(windows))))
    order = np.concatenate([rng.permutation(len(windows)) for _ in range(passes)])
    steps = -(-len(order) // batch)
    goals = Goals(v, windows)
    temp = np.empty(min(ADAM_AT_ONCE, len(flat)), flat.dtype)
    one = flat.dtype.type
    for i in range(steps):
        gradient(v, w, *goals.part(order[i * batch : (i + 1) * batch]), into)
        lr = rate * min(1.0, (i + 1) / 20) * (1 - 0.9 * i / steps)
        far, near = one(lr / (1 - 0.9 ** (i + 1))), one(1 / (1 - 0.98 ** (i + 1)))
        for a in range(0, len(flat), ADAM_AT_ONCE):
            g, mean, square = (x[a : a + ADAM_AT_ONCE] for x in (grads, m, s))
            t = temp[: len(g)]
            np.multiply(g, one(0.1), out=t)
            mean *= one(0.9)
            mean += t
            np.multiply(g, g, out=t)
            t *= one(0.02)
            square *= one(0.98)
            square += t
            np.multiply(square, near, out=t)
            np.sqrt(t, out=t)
            t += one(1e-8)
            np.divide(mean, t, out=t)
            t *= far
            flat[a : a + ADAM_AT_ONCE] -= t
    return {k: x.copy() for k, x in w.items()}


def gradient(v: Vocabulary, w: dict[str, np.ndarray], rows: np.ndarray, cls: np.ndarray, place: np.ndarray, into: dict[str, np.ndarray] | None = None) -> dict[str, np.ndarray]:
    """Gradient of the mean negative log probability of the windows' tokens; arguments as Goals gives them.

    It goes into the arrays of `into`, where given.
    """
    g = {k: np.empty_like(x) for k, x in w.items()} if into is None else into
    dim = w["emb"].shape[1]
    x = np.take(w["emb"], rows, axis=0, mode="clip")
    root = float(np.sqrt(dim))  # a NumPy scalar would make all that follows double
    # queries and keys only meet in products: one matrix turns a token into what its keys' tokens are multiplied with
    both = w["q"] @ w["k"].T / root
    wide = x.reshape(-1, dim) @ np.hstack([both, w["v"]])
    wide = wide.reshape(*rows.shape, 2 * dim)
    q, val = wide[..., :dim], wide[..., dim:]
    lag = _LAG[: rows.shape[1], : rows.shape[1]]
    a = q @ x.transpose(0, 2, 1)
    a += np.where(lag >= 0, w["far"][np.abs(lag)], -1e9).astype(a.dtype)
    # a softmax's rows are divided by their sums where they are narrowest, in what they are multiplied with
    a, total, _ = _exps(a)
    c = a @ val
    c /= total
    # a state ends in 1, so that biases are one more column of the output matrices
    h = np.ones((rows.size, dim + 1), x.dtype)
    np.add(x.reshape(-1, dim), c.reshape(-1, dim), out=h[:, :dim])
    # tokens in order of class, so that each class is one matrix product; those after a text's end drop out
    order = np.argsort(cls.ravel(), kind="stable")
    cls = cls.ravel()[order]
    cut = np.searchsorted(cls, np.arange(v.classes + 2))
    order, cls = order[cut[0] :], cls[cut[0] :]
    cut = (cut - cut[0]).tolist()
    hl, place = np.take(h, order, axis=0, mode="clip"), place.ravel()[order]
    each = 1 / max(1, len(hl))
    line = np.arange(len(hl))
    p, sums, _ = _exps(hl @ np.vstack([w["cls"], w["cls_b"]]))
    p[line, cls] -= sums[:, 0]
    scale = p.dtype.type(each) / sums
    side = (hl * scale).T @ p
    g["cls"][...], g["cls_b"][...] = side[:dim], side[dim]
    gh = p @ w["cls"].T
    gh *= scale
    g["out"][...], g["out_b"][...] = 0, 0
    turned = np.vstack([w["out"].T, w["out_b"]])
    for j in range(v.classes):
        its = slice(v.begin[j], v.begin[j + 1])
        out = w["out"][its]
        for some in _parts(cut[j], cut[j + 1], len(out)):
            hj = hl[some]
            p, sums, _ = _exps(hj @ turned[:, its])
            p[line[: len(p)], place[some]] -= sums[:, 0]
            scale = p.dtype.type(each) / sums
            side = (hj * scale).T @ p
            g["out"][its] += side[:dim].T
            g["out_b"][its] += side[dim]
            back = p @ out
            back *= scale
            gh[some] += back
    dh = np.zeros((rows.size, dim), x.dtype)
    dh[order] = gh
    dh = dh.reshape(x.shape)
    scaled = dh / total
    da = scaled @ val.transpose(0, 2, 1)
    # the sum of a row of a * da is the product of the row's own dh and context
    da -= np.einsum("bti,bti->bt", scaled, c)[..., None]
    da *= a
    g["far"][...] = np.bincount(lag[lag >= 0], da.sum(axis=0)[lag >= 0], WINDOW)
    d = np.empty((*rows.shape, 2 * dim), x.dtype)
    np.matmul(da, x, out=d[..., :dim])
    np.matmul(a.transpose(0, 2, 1), scaled, out=d[..., dim:])
    d = d.reshape(-1, 2 * dim)
    side = x.reshape(-1, dim).T @ d
    g["q"][...], g["k"][...], g["v"][...] = side[:, :dim] @ w["k"] / root, side[:, :dim].T @ w["q"] / root, side[:, dim:]
    dx = d @ np.hstack([both, w["v"]]).T
    dx += dh.reshape(-1, dim)
    dx += (da.transpose(0, 2, 1) @ q).reshape(-1, dim)
    by = np.argsort(rows.ravel(), kind="stable")
    row = rows.ravel()[by]
    begin = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    g["emb"][...] = 0
    g["emb"][row[begin]] = np.add.reduceat(np.take(dx, by, axis=0, mode="clip"), begin, axis=0)
    return g
