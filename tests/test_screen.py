"""Owners by single precision and differences, and rounds that measure all rows against rounds that keep gaps."""

import numpy as np
import pytest
from conftest import series_rows

from strandlab.operators import cluster, lloyd, screen


def nearest(x, centres):
    with np.errstate(all="ignore"):
        return ((x[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)


@pytest.mark.parametrize("k, offset, scale", [(1, 0, 1), (2, 0, 1), (7, 1e6, 1), (300, 0, 1), (5, 0, 1e-21), (5, 0, 1e25)])
def test_owners_are_those_of_exact_distances(k, offset, scale):
    rng = np.random.default_rng(k)
    x = rng.normal(size=(700, 6))
    centres = rng.normal(size=(3, k, 6))
    centres[0, k // 2] = centres[0, 0]  # equal centres: the first wins
    x[0] = centres[1, 0]
    x[1] = (centres[1, 0] + centres[1, -1]) / 2  # between two
    x[2:200] = x[1] + 1e-9 * rng.normal(size=(198, 6))
    x, centres = offset + scale * x, offset + scale * centres
    rows = screen.Screen(x)
    to = screen.Centres(centres, rows.middle)
    found = np.concatenate([rows.owners(lo, hi, to) for lo, hi in rows.chunks(3, k)], axis=1)
    far = [((x[:, None, :] - c[None]) ** 2).sum(axis=2) for c in centres]
    for own, d2 in zip(found, far):
        assert d2[np.arange(700), own] == pytest.approx(d2.min(axis=1), rel=1e-12, abs=0)
    assert (found[0] == nearest(x, centres[0])).all()


def test_rows_that_are_not_finite_go_to_the_first_centre():
    x = np.array([[1.0, 2.0], [np.nan, 0.0], [np.inf, 0.0], [8.0, 9.0]])
    rows = screen.Screen(x)
    assert rows.owners(0, 4, screen.Centres(np.array([[[1.0, 1.0], [9.0, 9.0]]]), rows.middle)).tolist() == [[0, 0, 0, 1]]


def test_side_by_side_fits_are_plain_rounds():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 4))
    starts = np.stack([x[rng.permutation(900)[:6]] for _ in range(5)])
    starts[0, 5] = 1e3  # a cluster without rows keeps its centre
    centres, rounds = screen.fit(x, starts, 1e-5, 300)
    for r, c in enumerate(starts):
        for turn in range(1, 301):
            n, means, _ = lloyd.block_sums(x, c)
            moved = np.where(n[:, None] > 0, means, c)
            shift, c = ((moved - c) ** 2).sum(), moved
            if shift <= 1e-5:
                break
        assert rounds[r] == turn and centres[r] == pytest.approx(c)
    assert centres[0, 5].tolist() == [1e3] * 4


def test_rounds_of_narrow_data_sets_write_their_blocks_once(spark, monkeypatch):
    rng = np.random.default_rng(4)
    y = np.arange(120) % 4
    df = series_rows(spark, rng.normal(size=(120, 3)) + y[:, None], y)
    written, real = [], lloyd.materialise
    monkeypatch.setattr(lloyd, "materialise", lambda df, name, *a: written.append(name) or real(df, name, *a))
    fits, blocks = {}, {}
    for how, numbers in (("whole", lloyd.GAP_NUMBERS), ("gaps", 1)):
        written.clear()
        monkeypatch.setattr(lloyd, "GAP_NUMBERS", numbers)
        fits[how] = cluster.kmeans(df, restarts=3, max_iter=4, block_bytes=600).orderBy("restart").collect()
        blocks[how] = written.count("kmeans-blocks")
    assert blocks["whole"] == 1 and blocks["gaps"] == 1 + max(r["rounds"] for r in fits["gaps"]) > 2
    for a, b in zip(fits["whole"], fits["gaps"], strict=True):
        assert a["rounds"] == b["rounds"] and a["inertia"] == pytest.approx(b["inertia"])
        assert np.array(a["centres"]) == pytest.approx(np.array(b["centres"]))
