"""op8's work for an id: a step's calls do not grow with the groups, a chunk's words
go to the encoder together.  The results are those of the plain ways."""

import sys

import numpy as np

from cohortlens.llm import attention, common, lm


def calls(f):
    """Calls into compiled code while ``f`` runs."""
    n = 0

    def count(_frame, event, _arg):
        nonlocal n
        n += event == "c_call"
    sys.setprofile(count)
    try:
        f()
    finally:
        sys.setprofile(None)
    return n


def some(n, seed=0):
    r = np.random.default_rng(seed)
    codes = attention.Codes(r.integers(0, 90, 400).astype(float), r.random(400) < .5)
    return r, attention.start_model(codes, 5), r.integers(0, 400, (n, 32)).astype(np.int32), r.integers(0, 256, (n, 32))


def test_calls_of_a_learning_step_do_not_grow_with_the_groups():
    _, m, x, y = some(64)
    one = np.where(y < attention.MEMBERS, y, 0)  # classes of a single group
    attention.gradients(m, x, y)
    assert calls(lambda: attention.gradients(m, x, y)) <= calls(lambda: attention.gradients(m, x, one)) + 5


def test_calls_of_a_scoring_step_do_not_grow_with_the_groups():
    _, m, x, y = some(64)
    y = y[:, 16:]
    one = np.where(y < attention.MEMBERS, y, 0)
    attention.class_logs(m, x, y)
    assert calls(lambda: attention.class_logs(m, x, y)) <= calls(lambda: attention.class_logs(m, x, one)) + 5


def test_windows_score_the_same_alone_and_together():
    """Blocks of a group are filled up: what fills them changes nothing."""
    r, m, x, y = some(37)
    y = np.where(r.random(y.shape) < .3, -1, y)[:, 16:]
    x[::5, :16] = attention.INPUTS
    alone = np.vstack([attention.class_logs(m, x[i:i + 1], y[i:i + 1]) for i in range(len(x))])
    assert np.allclose(attention.class_logs(m, x, y), alone, atol=1e-4)
    assert (alone[y < 0] == 0).all() and (alone[y >= 0] < 0).all()


def test_gradients_of_a_batch_are_the_mean_of_its_parts():
    r, m, x, y = some(24)
    y = np.where(r.random(y.shape) < .3, -1, y)
    y[5] = -1  # a window with nothing to learn
    y[y // attention.MEMBERS == 3] = -1  # a group with no row

    def whole(rows):
        g = attention.gradients(m, x[rows], y[rows])
        t = np.zeros_like(m["t"])
        t[g["t"][0]] = g["t"][1]
        return {**g, "t": t}
    scored = (y >= 0).sum(1)
    both = whole(slice(None))
    parts = [(scored[i], whole(slice(i, i + 1))) for i in range(len(x))]
    for name, d in both.items():
        mean = sum(n * g[name] for n, g in parts) / scored.sum()
        assert np.allclose(d, mean, atol=1e-5), name
    assert not both["c"][3].any() and not both["cb"][3].any()


def test_a_step_is_adams_of_each_parameter():
    r, m, x, y = some(16)
    adam = attention.Adam(m)
    want, first, second = ({k: v.astype(float) * by for k, v in m.items()} for by in (1, 0, 0))
    for t in range(1, 4):
        g = attention.gradients(adam.m, x, y)
        for k in m:
            at, d = g[k] if isinstance(g[k], tuple) else (slice(None), g[k])
            first[k][at] += .1 * (d - first[k][at])
            second[k][at] += .01 * (d.astype(float) ** 2 - second[k][at])
            want[k][at] -= .02 / (1 - .9 ** t) * first[k][at] / (np.sqrt(second[k][at] / (1 - .99 ** t)) + 1e-6)
        adam.step(g, .02)
    assert all(np.allclose(adam.m[k], want[k], atol=1e-4) for k in m)


def words_of(texts):
    body = np.frombuffer(b" ".join(texts), np.uint8)
    lens = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lens + 1) - 1
    return body, ends - lens, ends


ODD = ["a", "the", "été", " ", " x", "\x00", "a\x1cb", "x" * 3000, "\U0001f600!", "don't", "<|endoftext|>", "1234567"]


def test_words_are_cut_as_each_alone():
    encode = lm.encoder(lm.read_vocabulary())
    for texts in ([t.encode() for t in ODD], [b"ok", b"\xff\xfe", b"\xc3", b"\xa9"], [b"one"], []):
        lens, ids = lm.word_ids(encode, *words_of(texts))
        want = [encode[0]._core_bpe.encode_single_piece(b" " + t) for t in texts]
        assert lens.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_calls_to_cut_words_do_not_grow_with_the_words():
    encode = lm.encoder(lm.read_vocabulary())
    few, many = (words_of([f"w{i}".encode() for i in range(n)]) for n in (3, 3000))
    lm.word_ids(encode, *few)
    assert calls(lambda: lm.word_ids(encode, *many)) == calls(lambda: lm.word_ids(encode, *few))


def test_distinct_is_unique():
    r = np.random.default_rng(0)
    for n in (0, 1, 5000):
        codes = r.integers(0, 700, n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for a, b in zip(lm.distinct(codes), np.unique(codes, return_index=True, return_inverse=True)):
            assert np.array_equal(a, b)


def test_windows_with_nothing_scored():
    _, m, x, y = some(3)
    assert not attention.class_logs(m, x, np.full((3, 16), -1)).any()
    assert not any(np.any(d[1] if isinstance(d, tuple) else d)
                   for d in attention.gradients(m, x, np.full((3, 32), -1)).values())


def test_word_hashes_do_not_depend_on_the_block():
    body, starts, ends = words_of([(f"w{i * 7919 % 100}" * (1 + i % 5)).encode() for i in range(300)])
    whole = common.word_codes(body, starts, ends)
    assert all(np.array_equal(common.word_codes(body, starts, ends, n), whole) for n in (1, 7, 299))
    assert len(np.unique(whole)) == len({body[a:b].tobytes() for a, b in zip(starts, ends)})


def test_ids_of_picked_documents_stand_in_turn():
    a = {"first": np.array([0, 2, 2, 5]), "words": np.array([1, 0, 2, 2, 1]), "lens": np.array([1, 3, 2]),
         "ids": np.array([9, 4, 5, 6, 7, 8])}
    ids, upto, word, begin, first = lm._documents_ids(a)
    e = lm.END
    assert ids.tolist() == [4, 5, 6, 9, e, e, 7, 8, 7, 8, 4, 5, 6, e] and upto.tolist() == [0, 5, 6, 14]
    assert word.tolist() == [1, 0, -1, -1, 2, 2, 1, -1] and begin.tolist() == [0, 3, 4, 5, 6, 8, 10, 13]
    assert first.tolist() == [0, 3, 4, 8]
    assert lm._documents_ids(a, np.array([0]))[0].tolist() == [4, 5, 6, 9, e]
