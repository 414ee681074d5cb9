"""A small causal self-attention language model over subword ids, in numpy.

One layer.  Inputs are the most frequent subword ids, one symbol each, and
``HASHED`` symbols that the other ids are hashed to.  Outputs are classes of ids in
two levels: ``GROUPS`` groups of about equal corpus mass (ids that begin a word and
others apart), each of ``MEMBERS`` members; the most frequent ids are members alone.
Inside a member an id has its share of the corpus counts (add one).  So
p(id | before) = p(group | before) * p(member | group, before) * p(id | member).

Learning takes windows of ``SPAN`` inputs that do not overlap and a loss at each
place.  A text is scored in windows of ``SPAN`` inputs that overlap by half: a
window scores its second half, so each token is scored once, with ``STEP`` to
``SPAN - 1`` tokens before it (fewer only at the start of a text).
"""

from __future__ import annotations

import numpy as np

STEP = 16
SPAN = 2 * STEP
WIDTH = 16
ALONE = 1536
HASHED = 512
INPUTS = ALONE + HASHED
GROUPS = 16
MEMBERS = 16
BATCH = 512  # windows of a scoring step
PASS_BATCH = 128  # windows of a learning step, at most
BLOCK = 32  # rows of one group that a product takes together
F32 = np.float32
TOP = F32(40)  # bound of logits: exp stays finite without a maximum per row
TINY = F32(1e-30)  # least sum of exponentials


def _bands(mass: np.ndarray, n: int) -> np.ndarray:
    """Numbers 0 to n - 1 that cut a row of masses into parts of about the same sum."""
    before = np.cumsum(mass) - mass
    return np.minimum((before / max(1.0, mass.sum()) * n).astype(int), n - 1)


class Codes:
    """Input symbols and output classes of ids, from corpus counts of the ids."""

    def __init__(self, counts: np.ndarray, begins: np.ndarray):
        n = len(counts)
        order = np.lexsort((np.arange(n), -counts))
        mixed = np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)
        self.symbol = (ALONE + mixed % np.uint64(HASHED)).astype(np.int32)
        self.symbol[order[:ALONE]] = np.arange(min(n, ALONE))
        self.cls = np.empty(n, np.int32)
        for part, first in ((order[begins[order]], 0), (order[~begins[order]], GROUPS // 2)):
            group = _bands(counts[part] + 1.0, GROUPS // 2)
            for g in range(GROUPS // 2):
                some = part[group == g]
                self.cls[some] = (first + g) * MEMBERS + _bands(counts[some] + 1.0, MEMBERS)
        self.mass = np.bincount(self.cls, counts + 1.0, GROUPS * MEMBERS)
        self.inside = (np.log(counts + 1.0) - np.log(self.mass[self.cls])).astype(F32)


def views(symbols: np.ndarray, first: np.ndarray, start: int):
    """Overlapping windows of documents whose input symbols stand in a row
    (``first``: n + 1 offsets): (inputs (windows, SPAN), flat place of each scored
    token or -1)."""
    n = np.diff(first)
    per = -(-n // STEP)
    doc = np.repeat(np.arange(len(n)), per)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    at = first[doc] + STEP * nth  # first scored token
    place = at[:, None] + np.arange(-STEP, STEP)
    padded = np.concatenate([symbols, np.full(STEP, start, symbols.dtype)])
    x = padded.take(np.maximum(place, 0))
    x[nth == 0, :STEP] = INPUTS  # nothing before the text
    last = place >= first[doc + 1][:, None]
    x[last] = start  # beyond the end: never scored
    return x, np.where(last[:, STEP:], -1, place[:, STEP:])


def spans(symbols: np.ndarray, first: np.ndarray, start: int):
    """As ``views``, for learning: windows that do not overlap, all places scored."""
    n = np.diff(first)
    per = -(-n // SPAN)
    doc = np.repeat(np.arange(len(n)), per)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    place = (first[doc] + SPAN * nth)[:, None] + np.arange(SPAN)
    last = place >= first[doc + 1][:, None]
    x = np.concatenate([symbols, np.full(SPAN, start, symbols.dtype)]).take(place)
    x[last] = start
    return x, np.where(last, -1, place)


_REL = np.arange(SPAN)[None, :] - np.arange(SPAN)[:, None]  # key place less query place
_CAUSAL = np.where(_REL <= 0, 0, -1e9).astype(F32)
_DIST = np.clip(-_REL, 0, SPAN - 1)
_ONES = np.ones(max(SPAN, WIDTH, GROUPS, MEMBERS), F32)
_TOPS = np.full((SPAN, SPAN), TOP)  # an array: the minimum with a number takes three times as long
_TOP_BLOCK = np.full((BLOCK, GROUPS + MEMBERS), TOP)


def start_model(codes: Codes | None = None, seed: int = 0) -> dict:
    """First parameters: small seeded tables, and with ``codes`` the corpus shares
    of groups and members as biases (next to nothing where no id is).  ``t`` holds a row an input symbol, ``w`` its
    maps to query, key and value, ``d`` a bias a distance, ``g`` and ``c`` the
    output weights of groups and members, ``gb`` and ``cb`` their biases."""
    r = np.random.default_rng(seed)
    draw = lambda by, *s: (r.standard_normal(s) * by).astype(F32)
    mass = np.ones((GROUPS, MEMBERS)) if codes is None else codes.mass.reshape(GROUPS, MEMBERS) + 1e-9
    return {"t": draw(0.3, INPUTS, WIDTH), "w": draw(WIDTH ** -0.5, 3, WIDTH, WIDTH), "d": np.zeros(SPAN, F32),
            "g": draw(0.1, WIDTH, GROUPS), "gb": np.log(mass.sum(1) / mass.sum()).astype(F32),
            "c": draw(0.1, GROUPS, WIDTH, MEMBERS), "cb": np.log(mass / mass.sum(1, keepdims=True)).astype(F32)}


def _weights(m, u, turned, empty=None):
    """Causal attention of the last places of each window over all, from their
    queries mapped to the keys' inputs, and the inputs turned: (weights, not yet
    divided by their sums; one over the sums).  ``empty``: windows with nothing before their second half."""
    s = np.matmul(u, turned)
    n = s.shape[1]
    np.minimum(s, _TOPS[:n], out=s)
    s += (m["d"][_DIST] + _CAUSAL)[-n:]
    np.exp(s, out=s)
    if empty is not None:
        s[empty, :, :STEP] = 0
    return s, (1 / np.maximum(s.reshape(-1, SPAN) @ _ONES[:SPAN], TINY)).reshape(*s.shape[:2], 1)


def _levels(m):
    """Weights of both output levels side by side, for each group; their last row
    are the biases."""
    out = np.empty((GROUPS, WIDTH + 1, GROUPS + MEMBERS), F32)
    out[:, :WIDTH, :GROUPS], out[:, WIDTH, :GROUPS] = m["g"], m["gb"]
    out[:, :WIDTH, GROUPS:], out[:, WIDTH, GROUPS:] = m["c"], m["cb"]
    return out


def _ones_beside(t):
    """``t`` and a last column of ones: it carries the biases, and what else is added
    to a whole row, through the products."""
    out = np.ones((len(t), WIDTH + 1), F32)
    out[:, :WIDTH] = t
    return out


def _wide(w):
    """A map that leaves the last column to be added."""
    out = np.zeros((WIDTH + 1, WIDTH + 1), F32)
    out[:WIDTH, :WIDTH] = w
    return out


class _Scored:
    """Scored rows in the order of their groups, each group's filled up to whole
    blocks of ``BLOCK`` rows: one product takes the blocks of all groups.  ``rows``
    are the scored rows, ``slot`` their places in the blocks, ``of`` the blocks' groups, ``mine`` the flat places of the two
    own logits of each row."""

    def __init__(self, y):
        flat = y.reshape(-1)
        group = (flat // MEMBERS).astype(np.uint8)  # 255: not scored
        n = np.bincount(group, minlength=GROUPS)[:GROUPS]
        self.rows = np.argsort(group, kind="stable")[:n.sum()]
        own = flat.take(self.rows)
        per = -(-n // BLOCK)
        self.of = np.repeat(np.arange(GROUPS), per)
        self.slot = np.arange(len(own)) + np.repeat((np.cumsum(per) - per) * BLOCK - (np.cumsum(n) - n), n)
        group, begin = np.repeat(np.arange(GROUPS), n), self.slot * (GROUPS + MEMBERS)
        self.mine = np.concatenate([begin + group, begin + (own + (GROUPS - MEMBERS * group))])

    def free(self):
        """Places with no row."""
        out = np.ones(len(self.of) * BLOCK, bool)
        out[self.slot] = False
        return out

    def hidden(self, h):
        """Hidden values in blocks; a place with no row repeats the last's."""
        at = np.full(len(self.of) * BLOCK, -1)
        at[self.slot] = self.rows
        return h.take(at, 0, mode="wrap").reshape(-1, BLOCK, WIDTH + 1)

    def exps(self, h, weights):
        """The softmaxes of both levels: (own logits of the groups, then of the
        members; exponentials; their sums (places, 2))."""
        z = np.matmul(h, weights[self.of])
        np.minimum(z, _TOP_BLOCK, out=z)
        mine = z.reshape(-1).take(self.mine)
        np.exp(z, out=z)
        return mine, z, np.maximum(z.reshape(-1, GROUPS) @ _ONES[:GROUPS], TINY).reshape(-1, 2)


def class_logs(m, x, y):
    """Natural log probability of the classes ``y`` (windows, STEP; -1: not scored,
    0 there) at the second halves of the windows ``x``."""
    symbols = _ones_beside(np.vstack([m["t"], np.zeros((1, WIDTH), F32)]))  # a last row for "nothing there"
    queries, values = symbols[:, :WIDTH] @ (m["w"][0] @ m["w"][1].T), _wide(m["w"][2])[:WIDTH]
    weights = _levels(m)
    out = np.zeros(y.size, F32)
    for a in range(0, len(x), BATCH):
        xb = x[a:a + BATCH]
        e = symbols.take(xb, 0)
        s, inv = _weights(m, queries.take(xb[:, STEP:], 0), e[..., :WIDTH].transpose(0, 2, 1),
                          np.flatnonzero(xb[:, 0] == INPUTS))
        mixed = np.matmul(s, e[..., :WIDTH])
        mixed *= inv
        h = mixed.reshape(-1, WIDTH) @ values
        h += e[:, STEP:].reshape(h.shape)
        places = _Scored(y[a:a + BATCH])
        mine, _, total = places.exps(places.hidden(h), weights)
        total = np.log(total)
        n = len(places.rows)
        out[a * STEP + places.rows] = mine[:n] + mine[n:] - (total[:, 0] + total[:, 1]).take(places.slot)
    return out.reshape(y.shape)


def gradients(m, x: np.ndarray, y: np.ndarray) -> dict:
    """Mean loss gradients on windows ``x`` (windows, SPAN) with classes ``y`` of all
    places (-1: not scored).  That of ``t`` is (symbols of the batch, their rows).
    Query times key is input * (query map * key map') * input', so neither queries,
    keys nor values are worked out for a place."""
    rows = _ones_beside(m["t"]).take(x.reshape(-1), 0)
    wide = rows.reshape(*x.shape, WIDTH + 1)
    e, turned = wide[..., :WIDTH], np.ascontiguousarray(wide.transpose(0, 2, 1))
    wq, wk, wv = m["w"]
    pair = wq @ wk.T
    u = (rows[:, :WIDTH] @ pair).reshape(e.shape)
    s, inv = _weights(m, u, turned[:, :WIDTH])
    s *= inv
    mixed = np.matmul(s, wide).reshape(rows.shape)
    h = mixed @ _wide(wv)
    h += rows
    # both output levels
    places = _Scored(y)
    weights = _levels(m)
    h = places.hidden(h)
    _, z, total = places.exps(h, weights)
    scale = F32(1 / max(1, len(places.rows)))
    by = scale / total
    by[places.free()] = 0
    flat = z.reshape(-1, GROUPS)
    flat *= by.reshape(-1, 1)
    z.reshape(-1)[places.mine] -= scale
    dh = np.zeros((len(by) + 1, WIDTH), F32)  # a last row for what is not scored
    np.matmul(z, np.ascontiguousarray(weights[:, :WIDTH].transpose(0, 2, 1))[places.of],
              out=dh[:-1].reshape(-1, BLOCK, WIDTH))
    at = np.full(x.size, -1)
    at[places.rows] = places.slot
    dh = dh.take(at, 0, mode="wrap")
    groups = (np.arange(GROUPS)[:, None] == places.of).astype(F32)  # adds up the blocks of each group
    dw = (groups @ np.matmul(h.transpose(0, 2, 1), z).reshape(len(z), weights[0].size)).reshape(weights.shape)
    # attention
    part = dh @ _wide(wv.T)[:WIDTH]
    part[:, WIDTH] = -((part * mixed) @ _ONES[:WIDTH + 1])  # the mean over the keys
    part = part.reshape(wide.shape)
    ds = np.matmul(part, turned)
    ds *= s
    dwv = mixed[:, :WIDTH].T @ dh
    du = np.matmul(ds, e).reshape(-1, WIDTH)
    dpair = rows[:, :WIDTH].T @ du
    dh += du @ pair.T
    dh += np.matmul(ds.transpose(0, 2, 1), u).reshape(-1, WIDTH)
    dh += np.matmul(s.transpose(0, 2, 1), part[..., :WIDTH]).reshape(-1, WIDTH)
    flat = x.reshape(-1).astype(np.uint16)
    order = np.argsort(flat, kind="stable")
    flat = flat[order]
    begin = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
    # pairs of columns as complex numbers: half as many sums to go through
    sums = np.add.reduceat(dh.take(order, 0).view(np.complex64), begin, axis=0).view(F32)
    return {"t": (flat[begin].astype(np.int64), sums),
            "w": np.stack([dpair @ wk, dpair.T @ wq, dwv]),
            "d": np.bincount(_DIST.reshape(-1), ds.sum(0).reshape(-1), SPAN).astype(F32),
            "g": dw[:, :WIDTH, :GROUPS].sum(0), "gb": dw[:, WIDTH, :GROUPS].sum(0),
            "c": dw[:, :WIDTH, GROUPS:], "cb": dw[:, WIDTH, GROUPS:]}


class Adam:
    """Steps of bounded size; rows of ``t`` that a batch does not hold stay as they
    are, their averages too.  The other parameters step as one array."""

    def __init__(self, m):
        self.rest, self.t = [k for k in m if k != "t"], 0
        flat = np.concatenate([m[k].reshape(-1) for k in self.rest])
        ends = np.cumsum([m[k].size for k in self.rest])
        self.parts = {"t": m["t"].copy(), "rest": flat}
        self.m = {"t": self.parts["t"],
                  **{k: flat[e - m[k].size:e].reshape(m[k].shape) for k, e in zip(self.rest, ends)}}
        self.first, self.second = ({k: np.zeros_like(v) for k, v in self.parts.items()} for _ in range(2))

    def step(self, g, lr):
        self.t += 1
        a, b = 1 - 0.9 ** self.t, 1 - 0.99 ** self.t
        if not g:
            return
        for name, at, d in (("t", *g["t"]),
                            ("rest", slice(None), np.concatenate([g[k].reshape(-1) for k in self.rest]))):
            one, two = self.first[name][at], self.second[name][at]
            one += F32(0.1) * (d - one)
            d *= d
            two += F32(0.01) * (d - two)
            if name == "t":
                self.first[name][at], self.second[name][at] = one, two
            self.parts[name][at] -= F32(lr / a) * one / (np.sqrt(two * F32(1 / b)) + F32(1e-6))


def go_on(m: dict, x: np.ndarray, y: np.ndarray, rate: float, seed: int, batch: int | None = None) -> dict:
    """``m`` after one pass over all windows in a seeded order, each used once; a
    short pass takes smaller steps, about a hundred of them."""
    adam = Adam(m)
    batch = batch or min(PASS_BATCH, max(8, len(x) // 100))
    order = np.random.default_rng(seed).permutation(len(x))
    n = -(-len(x) // batch)
    for t, pick in enumerate(np.array_split(order, n) if n else []):
        adam.step(gradients(adam.m, x[pick], y[pick]), rate * min(1, (t + 1) / 10))
    return adam.m


def packed(m: dict) -> np.ndarray:
    return np.concatenate([m[k].reshape(-1) for k in sorted(m)])


def unpacked(flat: np.ndarray) -> dict:
    out, at = {}, 0
    for k, v in sorted(start_model().items()):
        out[k] = flat[at:at + v.size].reshape(v.shape).astype(F32)
        at += v.size
    return out


def token_logs(m, codes: Codes, ids: np.ndarray, first: np.ndarray, start: int) -> np.ndarray:
    """Natural log probability of every id of documents that stand in a row; the
    input at a place is the id before it, ``start`` at the first.  Documents are
    worked through in groups of some ten thousand ids, to stay in cache."""
    out = np.empty(len(ids), F32)
    lo = 0
    while lo < len(first) - 1:
        hi = int(np.searchsorted(first, first[lo] + 30_000))
        hi = min(max(hi, lo + 1), len(first) - 1)
        a, b = int(first[lo]), int(first[hi])
        if b > a:
            out[a:b] = _group_logs(m, codes, ids[a:b], first[lo:hi + 1] - a, start)
        lo = hi
    return out


def inputs(codes: Codes, ids: np.ndarray, first: np.ndarray, start: int) -> np.ndarray:
    """Input symbols: the id before each, ``start`` at the first of a document."""
    symbols = np.empty(len(ids), np.int32)
    symbols[1:] = codes.symbol[ids[:-1]]
    symbols[first[:-1][np.diff(first) > 0]] = codes.symbol[start]
    return symbols


def _group_logs(m, codes, ids, first, start):
    x, place = views(inputs(codes, ids, first, start), first, codes.symbol[start])
    y = np.append(codes.cls[ids], -1).take(place, mode="wrap")
    return codes.inside[ids] + class_logs(m, x, y)[place >= 0]  # scored places stand in the order of the ids
