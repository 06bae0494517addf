"""Nearest centres of many restarts at once.

One product in single precision measures the rows against the centres of all restarts. Where its rounding could change which centre is
nearest, the differences are measured in double precision, so the owners are those of exact distances; the first centre wins a tie.
"""

from __future__ import annotations

import numpy as np

CENTRES = 1024  # centres measured by one product
CELLS = 1 << 18  # distances held at a time
PAIR_CELLS = 1 << 20  # differences held at a time
OWNER_BYTES = 32 << 20  # owners of the restarts that are fitted side by side
UNIT = 2.0**-24  # rounding of single precision
TINY = 2.0**-125  # below this, single precision rounds by more than a share


class Centres:
    """Centres of some restarts (restart, cluster, number), prepared for rows that were moved by ``middle``."""

    def __init__(self, centres: np.ndarray, middle: np.ndarray):
        self.centres = centres
        r, k, d = centres.shape
        with np.errstate(all="ignore"):
            moved = centres - middle
            squares = (moved * moved).sum(axis=2)
            # one more number per centre, half its squared length, and a 1 per row: the product is half the distance less the row's own part
            self.left = np.concatenate([-moved, squares[:, :, None] / 2], axis=2).transpose(1, 0, 2).reshape(k * r, d + 1).astype(np.float32)
            self.longest = np.sqrt(squares.max(axis=1))


class Screen:
    """Rows of one data set."""

    def __init__(self, x: np.ndarray):
        self.x = x
        with np.errstate(all="ignore"):
            middle = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
            self.middle = np.where(np.isfinite(middle), middle, 0.0)
            moved = x - self.middle
            self.length = np.sqrt((moved * moved).sum(axis=1))
            self.right = np.concatenate([moved, np.ones((len(x), 1))], axis=1).astype(np.float32)

    def chunks(self, restarts: int, k: int):
        """Ranges of rows whose distances to all centres can be held."""
        step = max(256, CELLS // max(1, restarts * k))
        return [(lo, min(lo + step, len(self.x))) for lo in range(0, len(self.x), step)]

    def owners(self, lo: int, hi: int, to: Centres) -> np.ndarray:
        """Nearest centre per restart and row."""
        r, k, d = to.centres.shape
        kind = np.uint8 if k < 256 else np.uint32
        own, hits = np.zeros((r, hi - lo), kind), np.zeros((r, hi - lo), kind)
        if k == 1:
            return own
        with np.errstate(all="ignore"):
            far = (to.left @ self.right[lo:hi].T).reshape(k, r, hi - lo)
            # twice the rounding of a product of d + 1 numbers, of what goes into it and of the limit itself
            slack = 3 * (d + 8) * (UNIT * to.longest[:, None] * (self.length[lo:hi] + to.longest[:, None]) + TINY)
            limit = far.min(axis=0) + slack.astype(np.float32)
            for j in range(k):
                hit = (far[j] <= limit).view(np.uint8)
                hits += hit
                if j:
                    own += hit * kind(j)  # holds where nothing else hits
            which, rows = np.nonzero(hits != 1)
            step = max(1, PAIR_CELLS // max(1, k * d))
            for at in range(0, len(rows), step):
                p, i = which[at : at + step], rows[at : at + step]
                gaps = self.x[lo:hi][i][:, None, :] - to.centres[p]
                own[p, i] = np.einsum("pkd,pkd->pk", gaps, gaps).argmin(axis=1)
        return own


def side_by_side(k: int, rows: int = 0) -> int:
    """Restarts that are measured by one product, and whose owners can be held."""
    return max(1, min(CENTRES // max(1, k), OWNER_BYTES // max(1, rows * (1 if k < 256 else 4))))


def add_all(x: np.ndarray, own: np.ndarray, n: np.ndarray, total: np.ndarray) -> None:
    """Adds rows to the sizes (restart, cluster) and sums (restart, cluster, number) of the clusters that own them."""
    r, k, d = total.shape
    one_hot = np.empty((k, r, len(x)))
    for j in range(k):
        np.equal(own, j, out=one_hot[j])
    n += one_hot.sum(axis=2).T
    total += (one_hot.reshape(k * r, len(x)) @ x).reshape(k, r, d).transpose(1, 0, 2)


def add_changes(x: np.ndarray, old: np.ndarray, new: np.ndarray, n: np.ndarray, total: np.ndarray) -> None:
    """Moves the rows whose cluster changes from one sum to the other."""
    r, k, d = total.shape
    which, rows = np.nonzero(old != new)
    if not len(rows):
        return
    for own, sign in ((new, 1.0), (old, -1.0)):
        cell = which * k + own[which, rows]
        order = np.argsort(cell, kind="stable")
        cells, starts, sizes = np.unique(cell[order], return_index=True, return_counts=True)
        n.reshape(-1)[cells] += sign * sizes
        total.reshape(-1, d)[cells] += sign * np.add.reduceat(x[rows[order]], starts, axis=0)


def step(centres: np.ndarray, n: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New centres (any leading axes) and the squared way they move in all per restart. A cluster without rows keeps its centre."""
    moved = np.where(n[..., None] > 0, total / np.maximum(n, 1)[..., None], centres)
    return moved, ((moved - centres) ** 2).sum(axis=(-2, -1))


def fit(x: np.ndarray, starts: np.ndarray, tol: float, max_iter: int) -> tuple[np.ndarray, np.ndarray]:
    """Centres and rounds of restarts of one data set that lies here as a whole, side by side."""
    (r, k, _), screen = starts.shape, Screen(x)
    centres, rounds = starts.copy(), np.zeros(r, int)
    n, total = np.zeros((r, k)), np.zeros(starts.shape)
    own = np.zeros((r, len(x)), np.uint8 if k < 256 else np.uint32)
    moving = np.arange(r)
    for turn in range(1, max_iter + 1):
        to, sizes, sums = Centres(centres[moving], screen.middle), n[moving], total[moving]
        for lo, hi in screen.chunks(len(moving), k):
            new = screen.owners(lo, hi, to)
            if turn == 1:
                add_all(x[lo:hi], new, sizes, sums)
            else:
                add_changes(x[lo:hi], own[moving, lo:hi], new, sizes, sums)
            own[moving, lo:hi] = new
        n[moving], total[moving], rounds[moving] = sizes, sums, turn
        centres[moving], shift = step(to.centres, sizes, sums)
        moving = moving[~(shift <= tol)]
        if not len(moving):
            break
    return centres, rounds
