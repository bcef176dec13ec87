"""Hashed character subsequences of many texts at once, and linear models on them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


@dataclass
class Grams:
    """Ids of the grams of all texts one after the other; text[i] is the text that gram i is of."""

    ids: np.ndarray
    text: np.ndarray
    weight: np.ndarray
    texts: int


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each between two spaces, and the number of the text they are of."""
    data = "".join(f" {t} " for t in texts).encode("utf-32-le", "surrogatepass")
    lengths = np.fromiter((len(t) + 2 for t in texts), np.int64, len(texts))
    return np.frombuffer(data, np.uint32).astype(np.uint64), np.repeat(np.arange(len(texts)), lengths)


def hashed(texts: list[str], shapes: list[tuple[int, ...]], bits: int, weights: list[float] | None = None) -> Grams:
    """One gram per position and shape; a shape lists the offsets of the characters taken, (0, 1, 2) or with gaps (0, 2, 3).

    Shapes with the same number of characters share ids, so a gapped gram equals the plain gram of its characters. weights: one a shape, by default 1.
    """
    point, text = code_points(texts)
    ids, owner, weight = [], [], []
    for of, shape in enumerate(shapes):
        last = shape[-1]
        if len(point) <= last:
            continue
        inside = text[last:] == text[: len(text) - last]
        h = np.full(len(point) - last, len(shape), np.uint64)
        for k, off in enumerate(shape):
            h = (h ^ point[off : off + len(h)]) * _MULTIPLIERS[k]
            h ^= h >> np.uint64(29)
        ids.append((h >> np.uint64(64 - bits))[inside].astype(np.int64))
        owner.append(text[: len(inside)][inside])
        weight.append(np.full(int(inside.sum()), weights[of] if weights else 1.0))
    if not ids:
        return Grams(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), len(texts))
    return Grams(np.concatenate(ids), np.concatenate(owner), np.concatenate(weight), len(texts))


def norms(g: Grams) -> np.ndarray:
    return np.sqrt(np.maximum(np.bincount(g.text, weights=g.weight**2, minlength=g.texts), 1e-12))


def project(g: Grams, weights: np.ndarray) -> np.ndarray:
    """Sum over each text's grams of gram weight times model weight."""
    return np.bincount(g.text, weights=g.weight * weights[g.ids], minlength=g.texts)


def logistic(ids: np.ndarray, text: np.ndarray, value: np.ndarray, label: np.ndarray, bits: int, l2: float = 1e-4, epochs: int = 12, rate: float = 0.3, seed: int = 5, balance: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression with L2 penalty, by Adagrad over batches of texts. text must rise."""
    rng = np.random.default_rng(seed)
    w, g2, bias, b2 = np.zeros(1 << bits), np.full(1 << bits, 1e-2), 0.0, 1e-2
    first = np.searchsorted(text, np.arange(len(label) + 1))
    cost = np.where(label > 0, balance, 1.0)
    for _ in range(epochs):
        order = rng.permutation(len(label))
        for i in range(0, len(order), 64):
            batch = order[i : i + 64]
            n = first[batch + 1] - first[batch]
            at = np.repeat(first[batch] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            of = np.repeat(np.arange(len(batch)), n)
            score = np.bincount(of, weights=value[at] * w[ids[at]], minlength=len(batch)) + bias
            err = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - label[batch]) * cost[batch] / len(batch)
            u, back = np.unique(ids[at], return_inverse=True)
            grad = np.bincount(back, weights=value[at] * err[of], minlength=len(u)) + l2 * w[u]
            g2[u] += grad**2
            w[u] -= rate * grad / np.sqrt(g2[u])
            gb = err.sum()
            b2 += gb**2
            bias -= rate * gb / np.sqrt(b2)
    return w, float(bias)
