"""Neighbours and the tagger."""

import numpy as np
import pytest

from inkmill.llm import neighbours, tagger


def brute(rows, k):
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids = np.array([r for r, _ in rows])
    out = set()
    for i in range(len(rows)):
        s = np.round(x @ x[i], 12)
        order = [j for j in np.lexsort((ids, -s)) if j != i][:k]
        out |= {tuple(sorted((int(ids[i]), int(ids[j])))) for j in order}
    return out


def test_neighbours_recall_and_ties(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((60, 64))
    vectors = [(int(i) * 3, (centres[i % 60] + 0.3 * rng.standard_normal(64)).astype(np.float32).tolist()) for i in range(1500)]
    vectors += [(9000 + i, vectors[0][1]) for i in range(40)]  # exact copies: ties go to the smaller row
    rows = [(r, f"c{r}", v, "2024-01-01 00:00:00") for r, v in vectors]
    rows += [(8001, "c3", [1.0] * 64, "2023-01-01 00:00:00"), (8002, "n", None, None), (8003, "z", [0.0] * 64, None), (8004, "i", [float("inf")] * 64, None), (8005, "w", [1.0] * 3, None), (8006, None, [1.0] * 64, None)]
    frame = spark.createDataFrame(rows, "row bigint, chunk string, embedding array<float>, at string").selectExpr("row", "chunk", "embedding", "cast(at as timestamp) at", "1 as cosine")
    got = {tuple(r) for r in neighbours.neighbour_pairs(frame, 5, top=500).collect()}
    want = brute(vectors, 5)
    assert len(got & want) / len(want) > 0.97 and len(got & want) / len(got) > 0.97
    copies = {p for p in want if p[0] >= 9000 or p[1] >= 9000}
    assert copies <= got
    few = frame.where("row < 9")
    assert {tuple(r) for r in neighbours.neighbour_pairs(few).collect()} == {(0, 3), (0, 6), (3, 6)}
    assert neighbours.neighbour_pairs(frame.limit(0)).collect() == []


def test_quantiser_beats_its_cells():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((800, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q = neighbours.fit(x, 8)
    cell = q.cells(x)[:, 0]
    codes = q.encode(x, cell)
    assert codes.max() < 16
    coded = ((q.decode(codes) + q.centroids[cell] - x) ** 2).sum(1).mean()
    assert coded < 0.7 * ((q.centroids[cell] - x) ** 2).sum(1).mean()


def test_gradients_and_paths(monkeypatch):
    monkeypatch.setattr(tagger, "HIDDEN", 5)
    monkeypatch.setattr(tagger, "WIDTH", 4)
    rng = np.random.default_rng(1)
    m = tagger.new_tagger(np.arange(9, dtype=np.int32), 9, 4, rng)
    for n in m.NAMES:
        setattr(m, n, getattr(m, n).astype(float) + 0.3 * rng.standard_normal(getattr(m, n).shape))
    ids, tags, mask = rng.integers(0, 9, (3, 7)), rng.integers(0, 4, (3, 7)), np.ones((3, 7), bool)
    mask[1, 4:] = False
    _, d = tagger.gradients(m, ids, tags, mask)
    for n in m.NAMES:
        w = getattr(m, n)
        at = (ids[0, 2], 1) if n == "embed" else (tags[0, 1], tags[0, 2]) if n == "change" else tuple(0 for _ in w.shape)
        w[at] += 1e-2
        up = tagger.gradients(m, ids, tags, mask)[0]
        w[at] -= 2e-2
        down = tagger.gradients(m, ids, tags, mask)[0]
        w[at] += 1e-2
        assert (up - down) / 2e-2 == pytest.approx(float(d[n][at]), abs=2e-3)


def test_emissions_of_windows_of_all_lengths(monkeypatch):
    monkeypatch.setattr(tagger, "TOGETHER", 48)
    rng = np.random.default_rng(4)
    m = tagger.new_tagger(np.arange(9, dtype=np.int32), 9, 5, rng)
    m.bias += rng.standard_normal(m.bias.shape).astype(np.float32)
    points = rng.integers(0, 9, 400).astype(np.uint32)
    size = np.concatenate([rng.integers(1, 40, 110), [1, 40]])
    start = rng.integers(0, 360, len(size))
    got, h = tagger.emissions(m, points, start, size), tagger.HIDDEN
    want = []
    for a, n in zip(start, size):
        x = m.embed[points[a : a + n]]
        states = np.zeros((2, n, h))
        for side in (0, 1):
            s, c = np.zeros(h), np.zeros(h)
            for i in range(n) if side == 0 else range(n - 1, -1, -1):
                g = x[i] @ m.into[side] + s @ m.again[side] + m.bias[side, 0]
                enter, forget, leave = np.clip(tagger.SLOPE * g[: 3 * h] + 0.5, 0, 1).reshape(3, h)
                c = forget * c + enter * g[3 * h :] / (1 + np.abs(g[3 * h :]))
                states[side, i] = s = leave * c / (1 + np.abs(c))
        want.append(np.concatenate(states, 1) @ m.out + m.out_bias)
    assert np.abs(got - np.concatenate(want)).max() < 1e-4


def test_gradients_do_not_depend_on_padding():
    rng = np.random.default_rng(6)
    m = tagger.new_tagger(np.arange(9, dtype=np.int32), 9, 5, rng)
    mask = np.arange(12) < np.array([7, 1, 5])[:, None]
    ids, tags = rng.integers(0, 9, (3, 12)), rng.integers(0, 5, (3, 12))
    short, one = tagger.gradients(m, ids[:, :7], tags[:, :7], mask[:, :7])
    long, other = tagger.gradients(m, ids, tags, mask)
    assert short == pytest.approx(long, abs=1e-4)
    assert all(np.abs(one[n] - other[n]).max() < 1e-5 for n in m.NAMES)


def test_few_characters_are_left_to_decode():
    rng = np.random.default_rng(8)
    m = tagger.new_tagger(np.arange(9, dtype=np.int32), 9, 3, rng)
    # Tag 2 goes on from tag 1 and does not follow tag 0.
    m.change[:] = [[0, -1, -9], [-4, -4, 1], [-4, -4, 0.5]]
    m.first[:] = [0, -1, -9]
    size = np.array([30, 1, 29])
    begin = np.cumsum(size) - size
    emit = np.tile(np.float32([0, -6, -6]), (60, 1))
    emit[10, 2] = 4  # cannot open a stretch
    assert not len(tagger.undecided(m, emit, begin, size))
    emit[20:23] = [[0, 3, -6], [0, -6, 3], [0, -6, 3]]
    assert {20, 21, 22} <= set(tagger.undecided(m, emit, begin, size)) <= set(range(18, 26))
    for scale in (1, 3):
        emit = (scale * rng.standard_normal((60, 3)) - [0, 2, 2]).astype(np.float32)
        whole = np.ones(3, bool)
        path = tagger.best_paths(m, emit, begin, size, whole, whole)
        assert set(np.flatnonzero(path)) <= set(tagger.undecided(m, emit, begin, size))
