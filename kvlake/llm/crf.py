"""A two-state linear-chain conditional random field over many texts at once.

States: 0 (clean) and 1 (toxic). The texts' tokens lie one after the other; each text is a chain of its own, cut into
blocks from its first token on. The blocks' products of 2 x 2 matrices are made side by side, so forward and backward
passes are array operations whatever the texts' lengths, and a text's values are the same to the last bit whatever
texts lie beside it. A token takes some 50 bytes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

BLOCK = 64
Matrix = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _scan(x: np.ndarray, first: np.ndarray, inner: Callable[[np.ndarray], Matrix], head: Callable[[np.ndarray], Matrix]) -> np.ndarray:
    """Share of state 1 in the row vectors v_t = v_{t-1} m_t, from v = (1/2, 1/2) at each text's start.

    m_t is inner(x_t), or head(x_t) at the places ``first`` (all texts' first tokens); all entries are positive.
    """
    size = np.diff(np.append(first, len(x)))
    count = -(-size // BLOCK)
    base = np.cumsum(count) - count  # each text's first block
    blocks = int(count.sum())
    place = np.arange(len(x)) + np.repeat(base * BLOCK - first, size)
    pad = np.ones(blocks * BLOCK)
    pad[place] = x
    pad = np.ascontiguousarray(pad.reshape(blocks, BLOCK).T)

    def matrix(k: int) -> Matrix:
        if k:
            return inner(pad[k])
        out = tuple(np.array(np.broadcast_to(c, blocks)) for c in inner(pad[0]))
        for own, c in zip(out, head(pad[0][base]), strict=True):
            own[base] = c
        return out

    p, q, r, s = matrix(0)
    for k in range(1, BLOCK):
        a, b, c, d = matrix(k)
        p, q, r, s = p * a + q * c, p * b + q * d, r * a + s * c, r * b + s * d
        total = p + q + r + s
        p, q, r, s = p / total, q / total, r / total, s / total
    v0, v1 = np.full(blocks, 0.5), np.full(blocks, 0.5)
    order = np.argsort(-count, kind="stable")
    active = np.searchsorted(-count[order], -np.arange(1, int(count.max(initial=1)) + 1), "right")
    for j in range(1, int(count.max(initial=1))):
        at = base[order[: active[j]]] + j
        x0, x1 = v0[at - 1] * p[at - 1] + v1[at - 1] * r[at - 1], v0[at - 1] * q[at - 1] + v1[at - 1] * s[at - 1]
        v0[at], v1[at] = x0 / (x0 + x1), x1 / (x0 + x1)
    out = np.empty((BLOCK, blocks))
    for k in range(BLOCK):
        a, b, c, d = matrix(k)
        v0, v1 = v0 * a + v1 * c, v0 * b + v1 * d
        total = v0 + v1
        v0, v1 = v0 / total, v1 / total
        out[k] = v1
    return out.T.reshape(-1)[place]


def potentials(emission: np.ndarray, first: np.ndarray, start: np.ndarray, move: np.ndarray) -> np.ndarray:
    """m_t[i, j]: the weight of state j at t after state i. emission: score of state 1 at each token; first: its texts' first tokens."""
    m = np.empty((len(emission), 2, 2))
    e = np.exp(np.clip(emission, -30, 30))
    t = np.exp(move)
    m[:, :, 0] = t[:, 0]
    m[:, :, 1] = t[:, 1] * e[:, None]
    s = np.exp(start)
    m[first, :, 0] = s[0]
    m[first, :, 1] = (s[1] * e[first])[:, None]
    return m


def marginals(emission: np.ndarray, first: np.ndarray, start: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(state 1) of each token by forward-backward, and state 1's share of the scaled forward and backward vectors. first: the first tokens of all texts that have any."""
    n = len(emission)
    if not n:
        return np.zeros(0), np.zeros(0), np.zeros(0)
    e = np.exp(np.clip(emission, -30, 30))
    (t00, t01), (t10, t11) = np.exp(move).tolist()
    s0, s1 = np.exp(start).tolist()
    forward = _scan(e, first, lambda x: (t00, t01 * x, t10, t11 * x), lambda x: (np.full(len(x), s0), s1 * x, np.full(len(x), s0), s1 * x))
    # from each text's end: the token after it, turned about
    after = np.empty(n)
    after[:-1], after[-1] = e[1:], 1.0
    ends = np.append(first[1:], n)
    half = lambda x: (np.full(len(x), 0.5),) * 4
    backward = _scan(after[::-1], (n - ends)[::-1], lambda x: (t00, t10, t01 * x, t11 * x), half)[::-1]
    one, none = forward * backward, (1 - forward) * (1 - backward)
    return one / (one + none), forward, backward


def fit(emit_at: tuple[np.ndarray, np.ndarray], n_features: int, n: int, first: np.ndarray, y: np.ndarray, rounds: int = 60, l2: float = 0.05, rate: float = 0.3):
    """Weights (one a feature, then a bias), start and move scores by gradient ascent (Adam) on the penalised likelihood.

    emit_at: (tokens, features) pairs; n tokens in all; y: states.
    """
    tok, feat = emit_at
    w, start, move = np.zeros(n_features + 1), np.zeros(2), np.zeros((2, 2))
    w[-1] = -3.0
    is_first = np.zeros(n, bool)
    is_first[first] = True
    inner = np.flatnonzero(~is_first)
    inner = inner[inner > 0]
    y = y.astype(np.int64)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[inner - 1], y[inner]), 1)
    texts = max(len(first), 1)
    state = [np.zeros(w.size + 6), np.zeros(w.size + 6)]
    for k in range(1, rounds + 1):
        e = np.full(n, w[-1])
        np.add.at(e, tok, w[feat])
        m = potentials(e, first, start, move)
        p, f, b = marginals(e, first, start, move)
        f, b = np.stack([1 - f, f], 1), np.stack([1 - b, b], 1)
        pair = f[inner - 1][:, :, None] * m[inner] * b[inner][:, None, :]
        pair /= pair.sum(axis=(1, 2), keepdims=True)
        gap = y - p
        g = np.concatenate([np.bincount(feat, gap[tok], n_features), [gap.sum()], [-gap[first].sum(), gap[first].sum()], (seen - pair.sum(axis=0)).ravel()])
        theta = np.concatenate([w, start, move.ravel()])
        g = g / texts - l2 * theta / texts
        state[0] = 0.9 * state[0] + 0.1 * g
        state[1] = 0.99 * state[1] + 0.01 * g * g
        theta = theta + rate * (state[0] / (1 - 0.9**k)) / (np.sqrt(state[1] / (1 - 0.99**k)) + 1e-8)
        w, start, move = theta[: w.size], theta[w.size : w.size + 2], theta[w.size + 2 :].reshape(2, 2)
    return w, start, move
