"""Depths and passes of the projection passes: few meetings of unlike vectors, all links found, on spread and on dense labels."""

import numpy as np
import pandas as pd
import pytest

pytest.importorskip("factsieve.llm")
from factsieve.llm import projection_passes as pp  # noqa: E402


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def vectors(n, background, rng):
    """n unit vectors with that cosine between each two on average."""
    mean = unit(rng.standard_normal(64))
    return unit(background ** 0.5 * mean + (1 - background) ** 0.5 * unit(rng.standard_normal((n, 64))))


def depth_of(x, n):
    rows = pd.DataFrame({"cell": 1, "n": n, "v": list(x[:pp.SAMPLE])})
    return pp._depth(0.98, pp.WINDOW, pp.BLOCK)(rows).iloc[0]


@pytest.mark.parametrize("background", [0.0, 0.6, 0.9])
def test_planned_passes_find_pairs_at_the_threshold(background):
    rng = np.random.default_rng(3)
    x = vectors(4000, background, rng)
    away = rng.standard_normal(x.shape)
    y = unit(0.98 * x + (1 - 0.98 ** 2) ** 0.5 * unit(away - (away * x).sum(1, keepdims=True) * x))
    plan = depth_of(x, 1_000_000)
    assert 0 < plan["depth"] <= pp.MAX_DEPTH
    missed = np.ones(len(x), bool)
    for number in range(plan["passes"]):
        missed &= pp._keys(x, number, plan["depth"]) != pp._keys(y, number, plan["depth"])
    assert missed.mean() <= 0.001  # a recall of 0.999 at the threshold itself


def test_work_grows_less_than_the_square():
    rng = np.random.default_rng(4)
    for background, most in ((0.0, 1.35), (0.6, 1.6)):
        x = vectors(pp.SAMPLE, background, rng)
        work = []
        for n in (100_000, 1_000_000):
            plan = depth_of(x, n)
            share = 0.0
            for number in range(4):
                counts = np.unique(pp._keys(x, number, plan["depth"]), return_counts=True)[1].astype(float)
                share += (counts * (counts - 1)).sum() / (len(x) * (len(x) - 1)) / 4
            work.append(plan["passes"] * (n * n * max(share, 0.5 ** plan["depth"]) / 2 + n * pp.MOVE))
        assert np.log10(work[1] / work[0]) < most


def test_small_labels_and_more_signs_need_more_passes():
    assert pp.passes_for(0) == 1 and pp.passes_for(10) == 16
    assert all(pp.passes_for(d) <= pp.passes_for(d + 1) for d in range(pp.MAX_DEPTH))
    assert pp.passes_for(12, 1.0) == 1
    assert depth_of(vectors(1, 0.0, np.random.default_rng(1)), 1)["depth"] == 0
