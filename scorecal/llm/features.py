"""Hashed n-gram features and linear models fitted by dual coordinate descent."""

from __future__ import annotations

import numpy as np

from scorecal.llm.text import BLOCK, SPACE, Words, mix


def byte_grams(data: np.ndarray, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """Feature numbers of all byte runs of the given lengths in one text, white space as one blank."""
    values = data.astype(np.uint64)
    values[SPACE[data]] = 0x20
    out = []
    for n in orders:
        if len(values) < n:
            continue
        code = np.full(len(values) - n + 1, np.uint64(n))
        for i in range(n):
            code = (code << np.uint64(8)) | values[i : len(values) - n + 1 + i]
        out.append((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def counts(data: np.ndarray, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """How often each feature occurs in one text, however long, in blocks."""
    out = np.zeros(1 << bits)
    overlap = max(orders) - 1
    for at in range(0, max(1, len(data)), BLOCK):
        block = data[at : at + BLOCK]
        out += np.bincount(byte_grams(block, orders, bits), minlength=1 << bits)
        if at:  # runs across the seam
            seam = data[max(0, at - overlap) : at + overlap]
            inner = sum(np.bincount(byte_grams(part, orders, bits), minlength=1 << bits) for part in (data[max(0, at - overlap) : at], data[at : at + overlap]))
            out += np.bincount(byte_grams(seam, orders, bits), minlength=1 << bits) - inner
    return out


_KIND = np.zeros(256, np.int64)  # of a byte: 0 other, 1 lower, 2 upper, 3 digit, 4 sentence mark, 5 symbol
_KIND[97:123], _KIND[128:] = 1, 1
_KIND[65:91], _KIND[48:58] = 2, 3
for _c in b".,;:?'\")(-":
    _KIND[_c] = 4
for _c in b"#*$%&|<>!@^~=+_{}[]\\/`":
    _KIND[_c] = 5


def word_shapes(words: Words) -> np.ndarray:
    """A small number for each word: its letters' case, marks, length, and whether it repeats a neighbour."""
    if not len(words.hashes):
        return np.zeros(0, np.int64)
    kind = _KIND[words.data]
    size = words.ends - words.starts

    def count(k: int) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(kind == k)])
        return total[words.ends] - total[words.starts]

    lower, upper, symbol = count(1), count(2), count(5)
    case = np.where(upper == 0, 0, np.where(lower == 0, np.where(upper > 1, 3, 2), 1))
    length = np.digitize(size, [2, 4, 8, 16])
    same = np.zeros(len(size), np.int64)
    for back in (1, 2):
        same[back:] |= (words.hashes[back:] == words.hashes[:-back]).astype(np.int64) << (back - 1)
    return ((((case * 5 + length) * 6 + kind[words.ends - 1]) * 4 + np.minimum(symbol, 3)) * 4 + same) * 2 + (count(3) > 0)


def shape_grams(shapes: np.ndarray, bits: int, orders: tuple[int, ...] = (1, 2, 3)) -> np.ndarray:
    out = []
    for n in orders:
        if len(shapes) >= n:
            code = np.full(len(shapes) - n + 1, np.uint64(1000 + n))
            for i in range(n):
                code = mix(code ^ shapes[i : len(shapes) - n + 1 + i].astype(np.uint64))
            out.append(code >> np.uint64(64 - bits))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def hinge(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, size: int, cost: np.ndarray, epochs: int = 12, seed: int = 0) -> np.ndarray:
    """Weights of a linear hinge-loss model by dual coordinate descent.

    rows: (feature numbers, values) of each example; labels +1 or -1; cost:
    the upper bound of each dual variable.  The last feature may be a bias.
    """
    weights, dual = np.zeros(size), np.zeros(len(rows))
    norms = np.array([np.dot(v, v) for _, v in rows])
    rng = np.random.Generator(np.random.PCG64(seed))
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            if not norms[i]:
                continue
            at, value = rows[i]
            gradient = labels[i] * np.dot(weights[at], value) - 1
            new = min(max(dual[i] - gradient / norms[i], 0.0), cost[i])
            if new != dual[i]:
                weights[at] += (new - dual[i]) * labels[i] * value
                moved = max(moved, abs(new - dual[i]))
                dual[i] = new
        if moved < 1e-4:
            break
    return weights


def sigmoid_fit(margins: np.ndarray, labels: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """(a, b) of probability = 1 / (1 + exp(-(a * margin + b))), with smoothed targets."""
    positive = labels > 0
    n1, n0 = positive.sum(), (~positive).sum()
    target = np.where(positive, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -40, 40)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([np.dot(p - target, margins) + 1e-3 * (a - 1), (p - target).sum() + 1e-3 * b])
        h = np.array([[np.dot(w * margins, margins) + 1e-3, np.dot(w, margins)], [np.dot(w, margins), w.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return max(float(a), 1e-3), float(b)


def probability(margin: np.ndarray | float, fit: tuple[float, float]) -> np.ndarray | float:
    return 1 / (1 + np.exp(-np.clip(fit[0] * margin + fit[1], -40, 40)))
