"""op8 learns from whole texts of all training documents."""

import math
import zlib

import numpy as np

from cohortlens.llm import attention, lm

F32 = np.float32
HELD = [i for i in range(34) if zlib.crc32(str(i).encode()) % 7 == 2]


def gain(spark, rows):
    """Score a token over the base of the held-out documents."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = [r for r in lm.lm_scores(df).collect() if r["held_out"]]
    assert len(out) == len(HELD)
    return min((r["score"] - r["base_score"]) / r["n_tokens"] for r in out)


def test_what_stands_behind_the_first_ids_is_learned(spark):
    head, cycle = "same " * 600, "red green blue black white brown " * 700
    rows = [(i, cycle[:2000] if i in HELD else head + cycle) for i in range(34)]
    assert gain(spark, rows) > 0.2


def test_all_training_documents_are_learned(spark):
    cycle = "red green blue black white brown " * 700
    ids = [i for i in range(34) if i not in HELD]
    rows = [(i, "same " * 2000 if i == ids[0] else cycle[:2000] if i in HELD else cycle) for i in ids + HELD]
    assert gain(spark, rows) > 0.2


def test_a_pass_uses_each_window_once(monkeypatch):
    seen = []
    monkeypatch.setattr(attention, "gradients", lambda m, x, y: seen.extend(x[:, 0].tolist()) or {})
    x = np.repeat(np.arange(1237)[:, None], 32, 1)
    attention.go_on(attention.start_model(), x, np.zeros((1237, 32), int), 0.01, 1)
    assert sorted(seen) == list(range(1237))


def test_learning_windows_hold_each_place_once():
    first = np.array([0, 0, 1, 32, 33, 97, 160])
    x, place = attention.spans(np.arange(160, dtype=np.int32), first, 7)
    assert sorted(place[place >= 0]) == list(range(160))
    assert (x[place >= 0] == place[place >= 0]).all() and (x[place < 0] == 7).all()
    assert ((place // 200 == 0) <= (np.searchsorted(first, place, "right") == np.searchsorted(first, place[:, :1], "right"))).all()


def log_softmax(z):
    top = max(z)
    return [v - top - math.log(sum(math.exp(w - top) for w in z)) for v in z]


def plain_hidden(m, symbols, nth):
    """Hidden values at the last of ``symbols``, number by number."""
    rows = [m["t"][s].tolist() for s in symbols]
    maps = m["w"].tolist()
    q, k, v = ([[sum(r[i] * w[i][j] for i in range(len(r))) for j in range(len(r))] for r in rows] for w in maps)
    weights = [math.exp(sum(a * b for a, b in zip(q[nth], k[j])) + float(m["d"][nth - j])) for j in range(nth + 1)]
    total = sum(weights)
    return [rows[nth][i] + sum(w * v[j][i] for j, w in enumerate(weights)) / total for i in range(len(rows[0]))]


def plain_class(m, h, cls):
    group, member = divmod(cls, attention.MEMBERS)
    z = [sum(h[i] * float(m["g"][i, g]) for i in range(len(h))) + float(m["gb"][g]) for g in range(attention.GROUPS)]
    y = [sum(h[i] * float(m["c"][group, i, j]) for i in range(len(h))) + float(m["cb"][group, j])
         for j in range(attention.MEMBERS)]
    return log_softmax(z)[group] + log_softmax(y)[member]


def some_model(n=400):
    r = np.random.default_rng(3)
    counts = r.integers(0, 90, n).astype(float)
    codes = attention.Codes(counts, r.random(n) < .5)
    m = {k: v * F32(1.5) for k, v in attention.start_model(codes, 5).items()}
    m["d"] = r.normal(size=attention.SPAN).astype(F32)
    return r, counts, codes, m


def test_token_logs_equal_a_plain_forward_pass():
    """Windows, batches and masks against sums number by number."""
    r, counts, codes, m = some_model()
    ids, first, start = r.integers(0, 400, 90), np.array([0, 1, 18, 18, 90]), 399
    mine = attention.token_logs(m, codes, ids, first, start)
    for a, b in zip(first[:-1], first[1:]):
        symbols = [codes.symbol[start]] + [codes.symbol[i] for i in ids[a:b - 1]]
        for t in range(a, b):
            own = t - a
            lo = max(0, own // attention.STEP * attention.STEP - attention.STEP)  # where the place's window begins
            same = codes.cls == codes.cls[ids[t]]
            share = math.log((counts[ids[t]] + 1) / (counts[same] + 1).sum())
            want = plain_class(m, plain_hidden(m, symbols[lo:own + 1], own - lo), codes.cls[ids[t]]) + share
            assert math.isclose(mine[t], want, abs_tol=2e-3)


def test_gradients_equal_differences_of_the_plain_loss():
    r, _, codes, m = some_model()
    x, y = r.integers(0, 60, (2, 32)).astype(np.int32), r.integers(-1, 256, (2, 32))
    y[1, 20:] = -1

    def loss():
        own = [(b, t) for b in range(2) for t in range(32) if y[b, t] >= 0]
        return -sum(plain_class(m, plain_hidden(m, x[b, :t + 1], t), y[b, t]) for b, t in own) / len(own)
    g = attention.gradients({k: v.astype(F32) for k, v in m.items()}, x, y)
    whole = np.zeros_like(m["t"])
    whole[g["t"][0]] = g["t"][1]
    g["t"] = whole
    m.update({k: v.astype(float) for k, v in m.items()})
    for name in m:
        at = np.unravel_index(np.abs(g[name]).argmax(), m[name].shape)
        was = m[name][at]
        m[name][at] = was + 1e-4
        up = loss()
        m[name][at] = was - 1e-4
        down = loss()
        m[name][at] = was
        assert math.isclose((up - down) / 2e-4, g[name][at], rel_tol=2e-3, abs_tol=1e-6), name
