"""Quality classifier: hashed word n-gram logistic regression, fitted with follow-the-regularised-leader updates.

Tokens are runs of letters and digits and runs of other signs; single tokens and pairs of
neighbours are hashed into a table of 2**18 weights; all pairs of equal tokens share one. A text's features are their mean
frequencies, so long and short texts weigh the same, and a score is a sparse dot product:
the mean weight of the hashed tokens and pairs, passed through the logistic function.

Defined results: a null or empty text has no tokens and gets the intercept's score; without
labelled rows every score is 0.5; labels other than 0 and 1 are not learned from; repeated
ids in ``docs`` are scored row by row; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from notewell.llm import labelled, words
from notewell.llm.tables import bounded_batches

TRAIN_ROWS = 8192  # bound of the labelled sample
BITS = 18
SCALE = 64.0  # mean frequencies are small numbers; this brings them near 1
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.01
_SAME = words.mix(np.zeros(1, np.uint64), 2)[0]
_KIND = np.full(256, 2, np.uint8)  # 0: space, 1: letters, digits and bytes beyond ASCII, 2: other signs
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed indexes of tokens and pairs in text order, and the border of each text in them."""
    kind = _KIND[data]
    change = np.ones(len(data) + 1, bool)
    change[1:-1] = kind[1:] != kind[:-1]
    change[at] = True
    edge = np.flatnonzero(change)
    starts, ends = edge[:-1], edge[1:]
    real = kind[starts] != 0
    starts, ends = starts[real], ends[real]
    h = words.mix(words.range_hash(words.prefix_hash(data), starts, ends))
    border = np.searchsorted(starts, at)
    pair = np.zeros(len(h), np.uint64)
    pair[1:] = np.where(h[:-1] == h[1:], _SAME, words.mix(h[:-1] * np.uint64(3) + h[1:], 1))
    both = np.empty(2 * len(h), np.uint64)
    both[0::2], both[1::2] = h, pair
    keep = np.ones(2 * len(h), bool)
    keep[2 * border[:-1][border[:-1] < border[1:]] + 1] = False  # a text's first token has no left neighbour
    n = np.concatenate(([0], np.cumsum(keep)))
    return (both[keep] >> np.uint64(64 - BITS)).astype(np.int32), n[2 * border]


def train(batches: list[pa.RecordBatch]) -> bytes:
    """Weights and, last, the intercept, as float32."""
    rows = []
    for batch in batches:
        label = batch.column(1).to_numpy(zero_copy_only=False)
        for lo, hi, data, at in words.chunks(batch.column(0)):
            index, border = features(data, at)
            for k in range(hi - lo):
                i, c = np.unique(index[border[k] : border[k + 1]], return_counts=True)
                rows.append((i, (c * (SCALE / max(1, c.sum()))).astype(np.float32), float(label[lo + k])))
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    last = np.array([1 << BITS])
    for _ in range(EPOCHS):
        for i, x, y in rows:
            i, x = np.concatenate((i, last)), np.concatenate((x, [1.0]))
            zi, ni = z[i], n[i]
            w = np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x
            z[i] += g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[i] += g * g
    w = np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    return w.astype(np.float32).tobytes()


def score_texts(weights: np.ndarray, column: pa.Array) -> np.ndarray:
    out = np.zeros(len(column))
    for lo, hi, data, at in words.chunks(column):
        index, border = features(data, at)
        total = np.concatenate(([0.0], np.cumsum(weights[index], dtype=np.float64)))
        size = np.diff(border)
        dot = (total[border[1:]] - total[border[:-1]]) * SCALE / np.maximum(size, 1)
        out[lo:hi] = 1 / (1 + np.exp(-np.clip(dot + weights[-1], -30, 30)))
    return out


def fit(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> bytes:
    """Model from ``labels`` (``doc_id``, ``label``) of the texts in ``docs``."""
    return labelled.fit(labelled.sample(docs, labels, limit), train)


def score(docs: DataFrame, model: bytes) -> DataFrame:
    """``doc_id`` and ``score``, the probability of label 1, for every row of ``docs``."""

    def run(batches):
        weights = np.frombuffer(model, np.float32)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score_texts(weights, batch.column(1)))], ["doc_id", "score"])

    bounded_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
