"""Hashed n-gram features and small models, in numpy, for whole batches of short texts."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

#: Hash buckets of n-gram features.
BUCKETS = 1 << 15
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_+").findall
_MEMORY_TOKENS = 300_000


class _Hashes(dict):
    """64-bit hash of a token; digits are all alike. Bounded."""

    def __missing__(self, token: str) -> int:
        if len(self) >= _MEMORY_TOKENS:
            self.clear()
        key = "0" if token.isdigit() else token
        data = key.encode("utf-8", "surrogatepass")
        value = zlib.crc32(data) | zlib.crc32(data, 0x9E3779B9) << 31
        self[token] = value
        return value


_HASHES = _Hashes()
_EDGE = zlib.crc32(b"\x02") | zlib.crc32(b"\x02", 0x9E3779B9) << 31


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(uni, bi, starts): bucket of each token and token pair, and where each text begins.

    Every text begins with a mark, so pairs with it stand for first and last
    tokens, and an empty text still has features. Texts are lower-cased.
    """
    tokens: list[str] = []
    sizes = np.empty(len(texts), np.int64)
    for i, t in enumerate(texts):
        found = _TOKEN(t.lower())
        tokens += found
        sizes[i] = len(found)
    ends = np.cumsum(sizes)
    ids = np.fromiter(map(_HASHES.__getitem__, tokens), np.int64, len(tokens))
    starts = ends - sizes + np.arange(len(texts))
    full = np.full(len(ids) + len(texts), _EDGE, np.int64)
    keep = np.ones(len(full), bool)
    keep[starts] = False
    full[keep] = ids
    u = full.view(np.uint64)
    mixed = u * np.uint64(0x9E3779B97F4A7C15)
    uni = (mixed >> np.uint64(49)).astype(np.int64) % BUCKETS
    nxt = np.append(u[1:], np.uint64(_EDGE))
    pair = (mixed ^ (nxt * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0xD6E8FEB86659FD93)
    bi = (pair >> np.uint64(49)).astype(np.int64) % BUCKETS
    return uni, bi, starts


@dataclass
class Softmax:
    """Regularised multinomial logistic regression over hashed n-grams and dense features."""

    weights: np.ndarray  # BUCKETS x classes
    dense: np.ndarray  # features + 1 x classes, the last row is the bias

    def logits(self, texts: list[str], dense: np.ndarray) -> np.ndarray:
        if not len(texts):
            return np.zeros((0, self.dense.shape[1]), np.float32)
        uni, bi, starts = grams(texts)
        n = np.diff(np.append(starts, len(uni)))
        s = np.add.reduceat(self.weights[uni] + self.weights[bi], starts, axis=0)
        return s / np.sqrt(n)[:, None] + dense @ self.dense[:-1] + self.dense[-1]

    def probabilities(self, texts: list[str], dense: np.ndarray) -> np.ndarray:
        z = self.logits(texts, dense)
        z = np.exp(z - z.max(axis=1, keepdims=True)) if len(z) else z
        return z / z.sum(axis=1, keepdims=True)


def train_softmax(
    texts: list[str], dense: np.ndarray, labels: np.ndarray, classes: int, sample_weight: np.ndarray | None = None, l2: float = 3e-7, rounds: int = 100, rate: float = 0.3
) -> Softmax:
    """Full-batch Adam from zero weights; deterministic. Of two classes only the second gets weights, as only their difference matters."""
    if classes == 2:
        one = _train(texts, dense, np.asarray(labels, float)[:, None], sample_weight, l2 / 2, rounds, 2 * rate)
        return Softmax(*(np.concatenate([np.zeros_like(m), m], axis=1) for m in one))
    target = np.zeros((len(texts), classes))
    target[np.arange(len(texts)), labels] = 1
    return Softmax(*_train(texts, dense, target, sample_weight, l2, rounds, rate))


def _train(texts: list[str], dense: np.ndarray, target: np.ndarray, sample_weight: np.ndarray | None, l2: float, rounds: int, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights of n-grams and of dense features: logistic for one column of targets, multinomial for several."""
    classes = target.shape[1]
    uni, bi, starts = grams(texts)
    n = np.diff(np.append(starts, len(uni)))
    scale = 1 / np.sqrt(n)
    w = np.ones(len(texts)) if sample_weight is None else sample_weight
    w = w / w.sum()
    x = np.hstack([dense, np.ones((len(texts), 1))])
    idx = np.concatenate([uni, bi])
    used, idx = np.unique(idx, return_inverse=True)
    owner = np.concatenate([np.repeat(np.arange(len(texts)), n)] * 2)
    a, b = np.zeros((len(used), classes)), np.zeros((x.shape[1], classes))
    moments = [np.zeros_like(p) for p in (a, a, b, b)]
    half = len(uni)
    for step in range(1, rounds + 1):
        s = np.add.reduceat(a[idx[:half]] + a[idx[half:]], starts, axis=0)
        z = s * scale[:, None] + x @ b
        if classes == 1:
            z = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        else:
            z = np.exp(z - z.max(axis=1, keepdims=True))
            z /= z.sum(axis=1, keepdims=True)
        g = (z - target) * w[:, None]
        gs = (g * scale[:, None])[owner]
        ga = np.stack([np.bincount(idx, weights=gs[:, k], minlength=len(used)) for k in range(classes)], 1) + l2 * a
        gb = x.T @ g + l2 * b
        lr = rate * min(1.0, 2 * (1 - step / (rounds + 1)))
        for p, grad, m, v in ((a, ga, moments[0], moments[1]), (b, gb, moments[2], moments[3])):
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            p -= lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros((BUCKETS, classes), np.float32)
    weights[used] = a
    return weights, b.astype(np.float32)


def hash_sample(rows: DataFrame, text: str, most: int, where: Column | None = None) -> tuple[list[Row], int]:
    """(rows, number of all): about ``most`` of the rows with text, chosen by a hash of the text, one row a text.

    Which texts are chosen depends on the texts and on the number of all; copies
    are chosen together, once. Never more than twice ``most``. Null and blank
    texts are left out. A table with no more than ``most`` rows gives all texts.
    """
    some = rows.where(F.trim(text) != "") if where is None else rows.where((F.trim(text) != "") & where)
    total = some.count()
    if not total:
        return [], 0
    key = F.shiftrightunsigned(F.xxhash64(text), 1)
    bound = min(int(most / total * 2**63), 2**63 - 1)
    one = some.withColumn("hash_", key).where(F.col("hash_") <= F.lit(bound)).groupBy("hash_").agg(F.min(F.struct(*rows.columns)).alias("row_"))
    return [r["row_"] for r in one.orderBy("hash_").limit(2 * most).collect()], total  # bounded by ``most``
