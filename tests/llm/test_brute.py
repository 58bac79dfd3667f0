"""The discriminant against plain densities, and differencing against its definition and the best of all divisions."""

import itertools
import random

import numpy as np

from graphloom.llm import packing, quality


def test_discriminant_is_the_difference_of_log_densities():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(300, 6)), rng.normal(size=(180, 6)) @ np.diag([1, 2, 0.3, 1, 1, 1]) + 0.7])
    y = np.array([0] * 300 + [1] * 180)
    model = quality.fit(x, y)
    own = [np.cov(x[y == c].T, bias=True) for c in (0, 1)]
    pooled = (300 * own[0] + 180 * own[1]) / 480

    def log_density(points, c):
        s = (1 - quality.TO_POOLED) * own[c] + quality.TO_POOLED * pooled
        s = (1 - quality.TO_DIAGONAL) * s + quality.TO_DIAGONAL * np.diag(np.diag(s)) + (1e-4 + 0.01 * np.trace(pooled) / 6) * np.eye(6)
        d = points - x[y == c].mean(0)
        return np.array([-0.5 * (v @ np.linalg.inv(s) @ v) for v in d]) - 0.5 * np.linalg.slogdet(s)[1]

    want = (log_density(x, 1) - log_density(x, 0)) / 6
    assert np.allclose(model.difference(x), np.clip(want, -30, 30), atol=1e-9)
    p = model.score(x)
    assert np.allclose(p, 1 / (1 + np.exp(-(model.slope * want + model.offset)))) and ((p > 0.5) == y).mean() > 0.85
    # the curve is where the log loss, with its little ridge, is flat
    assert abs(((p - y) * want).sum() + 1e-3 * model.slope) < 1e-5 and abs((p - y).sum()) < 1e-5


def differencing(sizes, k):
    """The method step by step: always the two partial divisions of the greatest difference, largest against smallest."""
    parts = [[[s, *[0] * (k - 1)], [[i], *[[] for _ in range(k - 1)]], i] for i, s in enumerate(sizes)]
    born = len(sizes)
    while len(parts) > 1:
        parts.sort(key=lambda p: (-(p[0][0] - p[0][-1]), p[2]))
        a, b, *parts = parts
        rows = sorted(((x + y, u + v, i) for i, (x, y, u, v) in enumerate(zip(a[0], b[0][::-1], a[1], b[1][::-1]))), key=lambda r: (-r[0], r[2]))
        parts.append([[r[0] for r in rows], [r[1] for r in rows], born])
        born += 1
    return sorted(parts[0][0]) if parts else [0] * k


def test_differencing_equals_its_definition_and_is_near_the_best():
    rng = random.Random(11)
    for _ in range(120):
        k, sizes = rng.randrange(1, 5), [rng.randrange(1, 60) for _ in range(rng.randrange(0, 8))]
        windows = packing.differencing(sizes, k)
        sums = [sum(s for s, w in zip(sizes, windows) if w == i) for i in range(k)]
        assert len(windows) == len(sizes)
        if sizes:
            assert sorted(sums) == differencing(sizes, k)
            best = min(max(sum(s for s, w in zip(sizes, way) if w == i) for i in range(k)) for way in itertools.product(range(k), repeat=len(sizes)))
            assert best <= max(sums) <= 4 / 3 * best
