"""A small bidirectional recurrent labeller in numpy: one label per step of a sequence of hashed features."""

from __future__ import annotations

import numpy as np

Weights = dict[str, np.ndarray]


def new_weights(features: int, numbers: int, width: int, hidden: int, seed: int = 0) -> Weights:
    rng = np.random.default_rng(seed)
    w: Weights = {
        "E": rng.normal(0, 0.1, (features, width)),
        "N": rng.normal(0, 0.1, (numbers, width)),
        "O": rng.normal(0, 0.1, 2 * hidden + width),
        "o": np.zeros(1),
    }
    for d in "fb":
        w[f"W{d}"] = rng.normal(0, width**-0.5, (width, 4 * hidden))
        w[f"U{d}"] = rng.normal(0, hidden**-0.5, (hidden, 4 * hidden))
        bias = np.zeros(4 * hidden)
        bias[hidden : 2 * hidden] = 1.0  # remember by default
        w[f"c{d}"] = bias
    return w


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def _run(x, mask, W, U, bias, reverse, keep):
    """Hidden states (steps, rows, hidden); padded steps carry the state on."""
    steps, rows, _ = x.shape
    hidden = U.shape[0]
    h = np.zeros((rows, hidden))
    c = np.zeros((rows, hidden))
    out = np.zeros((steps, rows, hidden))
    saved = []
    z_in = x @ W + bias
    for t in range(steps - 1, -1, -1) if reverse else range(steps):
        z = z_in[t] + h @ U
        gates = _sigmoid(z[:, : 3 * hidden])
        i, f, o = gates[:, :hidden], gates[:, hidden : 2 * hidden], gates[:, 2 * hidden :]
        g = np.tanh(z[:, 3 * hidden :])
        c_new = f * c + i * g
        tc = np.tanh(c_new)
        m = mask[t][:, None]
        if keep:
            saved.append((t, h, c, i, f, o, g, tc, m))
        h, c = m * (o * tc) + (1 - m) * h, m * c_new + (1 - m) * c
        out[t] = h
    return out, saved


def _back(grad_out, x, U, saved):
    """Gradients of the inputs' products, of U, from the gradients of the hidden states."""
    steps, rows, hidden = grad_out.shape
    dz_all = np.zeros((steps, rows, 4 * hidden))
    dU = np.zeros_like(U)
    dh = np.zeros((rows, hidden))
    dc = np.zeros((rows, hidden))
    for t, h0, c0, i, f, o, g, tc, m in reversed(saved):
        dh = dh + grad_out[t]
        on = m * dh
        dcell = m * dc + on * o * (1 - tc**2)
        dz = np.concatenate(
            [dcell * g * i * (1 - i), dcell * c0 * f * (1 - f), on * tc * o * (1 - o), dcell * i * (1 - g**2)], axis=1
        )
        dz_all[t] = dz
        dU += h0.T @ dz
        dh = (1 - m) * dh + dz @ U.T
        dc = (1 - m) * dc + dcell * f
    return dz_all, dU


def forward(w: Weights, x: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Scores (steps, rows) before the sigmoid. ``x``: embedded steps; ``mask``: 1 for real steps."""
    hf, sf = _run(x, mask, w["Wf"], w["Uf"], w["cf"], False, keep)
    hb, sb = _run(x, mask, w["Wb"], w["Ub"], w["cb"], True, keep)
    both = np.concatenate([hf, hb, x], axis=2)
    return both @ w["O"] + w["o"][0], both, sf, sb


def embed(w: Weights, counts: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Steps to inputs: weighted sums of feature vectors, plus plain numbers."""
    return np.tanh(counts @ w["E"] + numbers @ w["N"])


def probabilities(w: Weights, x: np.ndarray, starts: np.ndarray, cells: int = 1 << 15) -> np.ndarray:
    """Chance of label 1 for every step of many sequences. ``x``: embedded steps of all sequences, one after the other;
    ``starts``: first step of each sequence, one more than sequences. A batch holds sequences of similar length."""
    out = np.zeros(len(x))
    sizes = np.diff(starts)
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and sizes[order[hi]] * (hi + 1 - lo) <= cells:
            hi += 1
        rows = order[lo:hi]
        inside = np.arange(sizes[rows].max())[:, None] < sizes[rows][None, :]
        at = np.where(inside, starts[rows][None, :] + np.arange(len(inside))[:, None], 0)
        out[at[inside]] = _sigmoid(forward(w, x[at], inside.astype(float))[0][inside])
        lo = hi
    return out


def gradients(w: Weights, counts, numbers, mask, labels) -> tuple[float, Weights]:
    """Mean cross entropy over real steps and its gradients. Arrays are (steps, rows, ...)."""
    x = embed(w, counts, numbers)
    score, both, sf, sb = forward(w, x, mask, keep=True)
    p = _sigmoid(score)
    n = max(mask.sum(), 1.0)
    loss = -(mask * (labels * np.log(p + 1e-12) + (1 - labels) * np.log(1 - p + 1e-12))).sum() / n
    d = mask * (p - labels) / n
    g: Weights = {"O": np.einsum("tb,tbk->k", d, both), "o": np.array([d.sum()])}
    hidden = w["Uf"].shape[0]
    d_both = d[..., None] * w["O"]
    dx = d_both[..., 2 * hidden :].copy()
    for k, (name, saved) in enumerate((("f", sf), ("b", sb))):
        dz, dU = _back(d_both[..., k * hidden : (k + 1) * hidden], x, w[f"U{name}"], saved)
        g[f"U{name}"], g[f"c{name}"] = dU, dz.sum((0, 1))
        g[f"W{name}"] = np.einsum("tbi,tbj->ij", x, dz)
        dx += dz @ w[f"W{name}"].T
    dx *= 1 - x**2
    flat = dx.reshape(-1, dx.shape[-1])
    g["E"] = counts.reshape(len(flat), -1).T @ flat
    g["N"] = numbers.reshape(len(flat), -1).T @ flat
    return float(loss), g


def fit(
    w: Weights, sequences: list[tuple[np.ndarray, np.ndarray, np.ndarray]], epochs: int = 12, rows: int = 32, rate: float = 0.02, seed: int = 1
) -> tuple[Weights, list[float]]:
    """Adam over batches of sequences ``(counts, numbers, labels)`` of similar length; returns the weights and the mean loss per epoch."""
    rng = np.random.default_rng(seed)
    m, v, step, losses = {k: np.zeros_like(a) for k, a in w.items()}, {k: np.zeros_like(a) for k, a in w.items()}, 0, []
    sequences = sorted((s for s in sequences if len(s[2])), key=lambda s: len(s[2]))
    batches = [sequences[i : i + rows] for i in range(0, len(sequences), rows)]
    for _ in range(epochs):
        total = 0.0
        for b in rng.permutation(len(batches)):
            batch = batches[b]
            steps = max(len(s[2]) for s in batch)
            counts = np.zeros((steps, len(batch), w["E"].shape[0]))
            numbers = np.zeros((steps, len(batch), w["N"].shape[0]))
            mask, labels = np.zeros((2, steps, len(batch)))
            for r, (x, y, z) in enumerate(batch):
                counts[: len(z), r], numbers[: len(z), r], labels[: len(z), r], mask[: len(z), r] = x, y, z, 1
            loss, g = gradients(w, counts, numbers, mask, labels)
            total += loss
            step += 1
            for k in w:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                w[k] = w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        losses.append(total / max(len(batches), 1))
    return w, losses
