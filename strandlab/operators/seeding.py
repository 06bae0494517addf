"""Start centres of k-means: weighted draws of rows by hash keys.

``one_by_one`` draws each centre with a probability in proportion to its squared distance from the centres before it, so it needs one look
at all rows per centre. ``oversampled`` draws many candidates in each of a few rounds, weighs each by the rows nearest to it, and draws the
centres among the candidates. Draws are races: a row's key is ``-ln(u) / weight`` with a uniform number ``u`` from its id, and the least
keys win, so tasks can draw apart and their winners be compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from strandlab.operators.blocks import BLOCK_BYTES

ROUNDS = 4
PER_ROUND = 2  # candidates of a round per centre wanted
FINAL_PICK = 100  # numbers of the picks among the candidates start here


def uniform(ids: np.ndarray, seed: int, restart: int, pick: int) -> np.ndarray:
    """Uniform numbers in (0, 1) from row id, seed, restart and pick (splitmix64)."""
    with np.errstate(over="ignore"):
        x = ids.astype("int64").view("uint64") + np.uint64((seed * 1_000_003 + restart * 10_007 + pick) & (2**63 - 1)) * np.uint64(
            0x9E3779B97F4A7C15
        )
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = x ^ (x >> np.uint64(31))
    return ((x >> np.uint64(11)).astype("float64") + 0.5) / 2.0**53


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d2 = (x * x).sum(axis=1)[:, None] - 2.0 * (x @ c.T) + (c * c).sum(axis=1)[None, :]
    return np.maximum(d2, 0.0)


def chunks(x: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of one block each, so that their distances to many centres can be held."""
    step = max(1, BLOCK_BYTES // max(1, 8 * x.shape[1]))
    return ((lo, min(lo + step, len(x))) for lo in range(0, max(1, len(x)), step))


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distance of every row to the nearest of ``c``."""
    return np.concatenate([squared_distances(x[lo:hi], c).min(axis=1) for lo, hi in chunks(x)])


def race_keys(ids: np.ndarray, weight: np.ndarray, seed: int, restart: int, pick: int) -> np.ndarray:
    """Keys of a draw; rows without weight come last."""
    u = uniform(ids, seed, restart, pick)
    with np.errstate(divide="ignore"):
        return np.where(weight > 0, -np.log(u) / weight, 1e300 * (1.0 + u))


def race(ids: np.ndarray, weight: np.ndarray, seed: int, restart: int, pick: int) -> tuple[int, float]:
    """Row that wins a draw with the given weights, and its key; keys of blocks can be compared."""
    keys = race_keys(ids, weight, seed, restart, pick)
    won = int(keys.argmin())
    return won, float(keys[won])


def winners(ids: np.ndarray, weight: np.ndarray, seed: int, restart: int, pick: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the least keys among those with weight, at most ``most``, and their keys."""
    rows = np.flatnonzero(weight > 0)
    keys = race_keys(ids[rows], weight[rows], seed, restart, pick)
    if len(rows) > most:  # only the least keys are ordered, ties of the last one with them
        least = np.flatnonzero(~(keys > np.partition(keys, most - 1)[most - 1]))
        rows, keys = rows[least], keys[least]
    order = np.lexsort((ids[rows], keys))[:most]
    return rows[order], keys[order]


def weights_of(x: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Rows nearest to each candidate, the first one on a tie."""
    owners = (squared_distances(x[lo:hi], candidates).argmin(axis=1) for lo, hi in chunks(x))
    return sum(np.bincount(owner, minlength=len(candidates)) for owner in owners).astype("float64")


def draw_among(candidates: np.ndarray, ids: np.ndarray, counts: np.ndarray, k: int, seed: int, restart: int) -> np.ndarray:
    """``k`` start centres among weighted candidates, each in proportion to count and squared distance from those before it."""
    picks, near = [], None
    for pick in range(k):
        weight = counts if near is None else counts * near
        picks.append(race(ids, weight, seed, restart, FINAL_PICK + pick)[0])
        d2 = squared_distances(candidates, candidates[picks[-1:]])[:, 0]
        near = d2 if near is None else np.minimum(near, d2)
    return candidates[picks].copy()


def oversampled(x: np.ndarray, ids: np.ndarray, k: int, seed: int, restart: int) -> np.ndarray:
    """Start centres of a data set that lies here as a whole."""
    chosen = winners(ids, np.ones(len(x)), seed, restart, 0, 1)[0]
    near = nearest(x, x[chosen])
    for turn in range(1, ROUNDS + 1):
        new = winners(ids, near, seed, restart, turn, PER_ROUND * k)[0]
        if not len(new):
            break
        chosen = np.concatenate([chosen, new])
        near = np.minimum(near, nearest(x, x[new]))
    chosen = chosen[np.argsort(ids[chosen], kind="stable")]
    return draw_among(x[chosen], ids[chosen], weights_of(x, x[chosen]), k, seed, restart)


def one_by_one(x: np.ndarray, ids: np.ndarray, k: int, seed: int, restart: int) -> np.ndarray:
    """Start centres of a data set that lies here as a whole, by one draw after the other."""
    weight, picks = np.ones(len(x)), []
    for pick in range(k):
        picks.append(race(ids, weight, seed, restart, pick)[0])
        d2 = nearest(x, x[picks[-1:]])
        weight = d2 if pick == 0 else np.minimum(weight, d2)
    return x[picks].copy()


SEEDINGS = {"oversampled": oversampled, "one_by_one": one_by_one}
