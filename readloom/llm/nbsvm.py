"""Quality classifier: n-gram indicators scaled by log-count ratios, hinge loss by dual coordinate descent.

Tokens are runs of letters of one case, of digits and of other signs, hashed from
the bytes; a document's features are the distinct hashed 1- and 2-grams of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import numbered, quoted, spread
from .textkit import chunks, mix, runs

BUCKETS = 1 << 18
#: Most labelled documents that the model is fitted on, drawn evenly by a hash of their id.
MOST_LABELLED = 6000


#: Shapes of a word in capitals alone and of a run of signs.
_CAPITALS, _SIGNS = 1 * 16 + 1 * 2 + 1, 4


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) pairs, each once, sorted.

    1- and 2-grams of tokens, 3-grams of shapes (signs count as their own
    shape), and n-grams that say a token or pair came three times in a row.
    """
    h, _, _, at, shape = runs(raw, offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    h = mix(h + (shape == _CAPITALS).astype(np.uint64))
    form = np.where(shape // 16 == _SIGNS, h, mix(shape.astype(np.uint64) + np.uint64(99)))
    texts, grams = [text], [h]

    def gram(width: int, value: np.ndarray, on: np.ndarray | None = None) -> None:
        same = text[: len(text) - width + 1] == text[width - 1 :]
        same = same if on is None else same & on
        texts.append(text[: len(same)][same])
        grams.append(value[same])

    n = len(h)
    if n > 1:
        gram(2, mix(h[:-1] * np.uint64(3) + h[1:]))
    if n > 2:
        gram(3, mix(form[:-2] * np.uint64(5) + form[1:-1] * np.uint64(7) + form[2:] * np.uint64(11)))
    for k in (1, 2, 3):
        if n > 2 * k:
            again = (h[: n - 2 * k] == h[k : n - k]) & (h[k : n - k] == h[2 * k :]) & (shape[: n - 2 * k] // 16 != _SIGNS)
            gram(2 * k + 1, np.full(n - 2 * k, 1000 + k, dtype=np.uint64), again)
    keys = np.unique(np.concatenate(texts).astype(np.int64) << 18 | (np.concatenate(grams) % np.uint64(BUCKETS)).astype(np.int64))
    return keys >> 18, keys & (BUCKETS - 1)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def scores(self, text: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        """Probability of label 1 for each of ``n`` texts."""
        size = np.maximum(1, np.bincount(text, minlength=n))
        margin = np.bincount(text, self.weights[bucket], n) / np.sqrt(size) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


def _descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, c: np.ndarray, rounds: int, seed: int) -> tuple[np.ndarray, float]:
    """Dual coordinate descent of the L2-regularised hinge loss."""
    values = [ratio[r] / np.sqrt(max(1, len(r))) for r in rows]
    square = np.array([v @ v + 1 for v in values])
    w, b, alpha, rng = np.zeros(len(ratio)), 0.0, np.zeros(len(rows)), np.random.default_rng(seed)
    for _ in range(rounds):
        most = 0.0
        for i in rng.permutation(len(rows)):
            slope = y[i] * (values[i] @ w[rows[i]] + b) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), c[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[rows[i]] += step * values[i]
                b += step
                most = max(most, abs(new - alpha[i]))
                alpha[i] = new
        if most < 1e-3:
            break
    return w * ratio, b


def _platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through held-back margins, by Newton steps."""
    up, down = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x, theta = np.stack([margin, np.ones_like(margin)], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - target) + 1e-3 * (theta - [1.0, 0.0]))
        theta = theta - step
        if np.abs(step).max() < 1e-8:
            break
    return float(max(theta[0], 1e-3)), float(theta[1])


def fit(rows: list[np.ndarray], labels: np.ndarray, cost: float = 1.0, smooth: float = 1.0, blend: float = 0.9, rounds: int = 30, seed: int = 5) -> Model:
    """Fit on bucket lists and 0/1 labels; with one class only, every score is that class."""
    y = np.where(labels > 0, 1.0, -1.0)
    if not len(rows) or (y > 0).all() or (y < 0).all():
        sure = 0.0 if not len(rows) else 4.0 * y[0]
        return Model(np.zeros(BUCKETS), 0.0, 1.0, sure)
    p, q = np.full(BUCKETS, smooth), np.full(BUCKETS, smooth)
    for r, s in zip(rows, y, strict=True):
        (p if s > 0 else q)[r] += 1
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    each = cost * np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))

    def fitted(on: np.ndarray) -> tuple[np.ndarray, float]:
        w, b = _descend([rows[i] for i in on], y[on], ratio, each[on], rounds, seed)
        used = np.abs(w) > 0
        mean = np.abs(w[used] / np.where(ratio[used] == 0, 1, ratio[used])).mean() if used.any() else 0.0
        return blend * w + (1 - blend) * mean * ratio, b

    margins = np.zeros(len(rows))
    parts = np.random.default_rng(seed).integers(0, 3, len(rows))
    for k in range(3):
        if len(set(y[parts != k])) == 2:
            w, b = fitted(np.flatnonzero(parts != k))
            for i in np.flatnonzero(parts == k):
                margins[i] = w[rows[i]].sum() / np.sqrt(max(1, len(rows[i]))) + b
    w, b = fitted(np.arange(len(rows)))
    return Model(w, b, *_platt(margins, y))


def train(df: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MOST_LABELLED) -> Model:
    """Fit on at most about ``most`` rows of ``labels`` that are ``usable`` (a condition on its id), with the texts of ``df``."""
    marked = labels.filter(usable & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    marked = marked.groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_label"))
    n = marked.count()
    share = min(1.0, most / max(1, n))
    sample = marked.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    joined = df.select(df[id_col].alias("_id"), df[text_col].cast("string").alias("_text")).join(F.broadcast(sample), "_id").select("_id", "_text", "_label")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, raw, offsets in chunks(batch.column(1)):
                text, bucket = features(raw, offsets)
                cut = np.searchsorted(text, np.arange(last - first + 1))
                packed = [bucket[a:b].astype(np.uint32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first).cast(pa.string()), pa.array(packed, pa.binary()), batch.column(2).slice(first, last - first)], ["id", "buckets", "label"])

    rows = sorted(joined.mapInArrow(pack, "id string, buckets binary, label int").collect(), key=lambda r: (r["id"], bytes(r["buckets"])))
    return fit([np.frombuffer(r["buckets"], np.uint32).astype(np.int64) for r in rows], np.array([r["label"] for r in rows]))


def classify(df: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7, keep: list[str] | None = None, out: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``df`` (or its columns ``keep``) with ``score`` and ``predicted``, or as ``out`` names them, of every whole text.

    Null and empty texts have no features and get the score of the bias. Columns
    of these two names that ``df`` has are replaced, all others pass through
    whatever their names. Repeated rows score alike, an empty table gives none.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = [c for c in (df.columns if keep is None else keep) if c not in out]
    kept = df.select(*map(quoted, names))
    asked = df.select(*numbered(names), F.col(quoted(text_col)).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.zeros(batch.num_rows)
            for first, last, raw, offsets in chunks(batch.column(len(names))):
                score[first:last] = shared.value.scores(*features(raw, offsets), last - first)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*names, *out])

    return spread(asked).mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(out[0], T.DoubleType()), T.StructField(out[1], T.IntegerType())]))
