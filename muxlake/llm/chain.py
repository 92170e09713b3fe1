"""Marginals of two-label linear chains, for the operators that label lines or tokens.

Sequences lie end to end. The chain is cut into blocks of equal length that step together: one pass gives each block's transfer
matrix, the products of these give what enters each block from both sides, and two more passes give the messages inside.
So the number of steps grows with the square root of the tokens, however they are spread over sequences.
"""

from __future__ import annotations

import numpy as np


def _weights(unary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of label 0 and label 1 that a score gives."""
    e = np.exp(-np.abs(unary))
    low, high = e / (1 + e), 1 / (1 + e)
    up = unary > 0
    return np.where(up, low, high), np.where(up, high, low)


def forward_backward(unary: np.ndarray, same: float, sizes: np.ndarray, pairs: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(1) of each place, P(equal to the place before) and the log of each sequence's normaliser; the last two are empty without pairs.

    A place adds unary if its label is 1, and same if its label is that of the place before. sizes: places of each sequence.
    """
    n, none = len(unary), np.zeros(0)
    starts = np.cumsum(sizes) - sizes
    if not n:
        return none, none, np.zeros(len(sizes)) if pairs else none
    length = max(1, int(n**0.5 / 4))
    blocks = -(-n // length)

    def dealt(values: np.ndarray, rest: float) -> np.ndarray:
        out = np.full(blocks * length, rest, values.dtype)
        out[:n] = values
        return np.ascontiguousarray(out.reshape(blocks, length).T)

    begins = np.zeros(n, bool)
    begins[starts[sizes > 0]] = True
    first, u = dealt(begins, True), dealt(np.clip(unary, -600.0, 600.0), 0.0)
    stay = 1 / (1 + np.exp(-same))
    change = 1 - stay if same < 30 else np.exp(-same)

    def step(t: int):
        """Weights of the labels at place t of each block, and of keeping and changing the label before."""
        w0, w1 = _weights(u[t])
        return w0, w1, np.where(first[t], 1.0, stay), np.where(first[t], 1.0, change)

    m = np.tile(np.array([1.0, 0.0, 0.0, 1.0])[:, None], blocks)  # the rows of each block's transfer matrix, end to end
    for t in range(length):
        w0, w1, s, c = step(t)
        m = np.stack([(m[0] * s + m[1] * c) * w0, (m[0] * c + m[1] * s) * w1, (m[2] * s + m[3] * c) * w0, (m[2] * c + m[3] * s) * w1])
        m /= m.sum(0)
    enter, leave = np.zeros((2, blocks)), np.zeros((2, blocks))
    v0, v1 = 0.5, 0.5
    for k, (a, b, c, d) in enumerate(m.T.tolist()):
        enter[0, k], enter[1, k] = v0, v1
        v0, v1 = v0 * a + v1 * c, v0 * b + v1 * d
        v0, v1 = v0 / (v0 + v1), v1 / (v0 + v1)
    v0, v1 = 0.5, 0.5
    for k, (a, b, c, d) in zip(range(blocks - 1, -1, -1), m.T[::-1].tolist()):
        leave[0, k], leave[1, k] = v0, v1
        v0, v1 = a * v0 + b * v1, c * v0 + d * v1
        v0, v1 = v0 / (v0 + v1), v1 / (v0 + v1)
    ahead = np.empty((2, length, blocks))
    scale = np.empty((length, blocks)) if pairs else None
    v = enter
    for t in range(length):
        w0, w1, s, c = step(t)
        x0, x1 = (v[0] * s + v[1] * c) * w0, (v[0] * c + v[1] * s) * w1
        total = x0 + x1
        v = ahead[:, t] = np.stack([x0, x1]) / total
        if pairs:
            scale[t] = np.log(total)
    one = np.empty((length, blocks))
    equal = np.empty((length, blocks)) if pairs else None
    back = leave
    for t in range(length - 1, -1, -1):
        w0, w1, s, c = step(t)
        x0, x1 = ahead[0, t] * back[0], ahead[1, t] * back[1]
        one[t] = x1 / (x0 + x1)
        b0, b1 = w0 * back[0], w1 * back[1]
        if pairs:
            before = ahead[:, t - 1] if t else enter
            keep, turn = s * (before[0] * b0 + before[1] * b1), c * (before[0] * b1 + before[1] * b0)
            equal[t] = np.where(first[t], 0.0, keep / (keep + turn))
        x0, x1 = s * b0 + c * b1, c * b0 + s * b1
        back = np.stack([x0, x1]) / (x0 + x1)
    out = one.T.reshape(-1)[:n]
    if not pairs:
        return out, none, none
    logs = scale.T.reshape(-1)[:n] + np.logaddexp(0.0, unary) + np.where(begins, 0.0, np.logaddexp(0.0, same))
    norm = np.zeros(len(sizes))
    some = sizes > 0
    norm[some] = np.add.reduceat(logs, starts[some])
    return out, equal.T.reshape(-1)[:n], norm
