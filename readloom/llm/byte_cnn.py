"""Language identification by a byte convolutional network trained in numpy.

Bytes are embedded, filters of several widths slide over fixed-length windows,
each filter keeps its maximum over the window, and a softmax layer names the
language. A text's distribution is the mean over all its windows, weighted by
their letters. For application each filter bank is folded into tables indexed by
neighbouring byte pairs, so a position costs one or two table rows per width.
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
from .textkit import chunks

WIDTHS, FILTERS, EMBED, WINDOW = (2, 3, 4), 16, 8, 256
#: Most labelled texts of one language, and windows of one text, that the network is fitted on.
MOST_TEXTS, MOST_WINDOWS = 500, 3
UNDETERMINED = "und"

_LETTER = np.zeros(256, dtype=np.float32)
_LETTER[[*range(65, 91), *range(97, 123), *range(192, 256)]] = 1


@dataclass
class Network:
    classes: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]
    shift: list[np.ndarray]
    dense: np.ndarray
    bias: np.ndarray

    def tables(self) -> list[list[np.ndarray]]:
        """For each width: responses to the first byte pair and to what follows it."""
        out = []
        for w, k in zip(self.filters, self.shift, strict=True):
            single = [(self.embed @ w[o]).astype(np.float32) for o in range(len(w))]
            pair = lambda a, b: (single[a][:, None, :] + single[b][None, :, :]).reshape(65536, -1)
            head = pair(0, 1) + k.astype(np.float32)
            out.append([head] if len(w) == 2 else [head, single[2]] if len(w) == 3 else [head, pair(2, 3)])
        return out


def _pooled(windows: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
    """Largest response of every filter in every window of ``windows`` (n x WINDOW bytes)."""
    n, length = windows.shape
    pairs = windows[:, :-1].astype(np.int32) << 8 | windows[:, 1:]
    out = []
    for width, table in zip(WIDTHS, tables, strict=True):
        m = length - width + 1
        x = np.take(table[0], pairs[:, :m], axis=0)
        if width == 3:
            x += np.take(table[1], windows[:, 2:], axis=0)
        elif width == 4:
            x += np.take(table[1], pairs[:, 2:], axis=0)
        out.append(x.max(axis=1))
    return np.maximum(np.concatenate(out, axis=1), 0)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def cut(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows that cover every byte of every text, zero-padded at each text's end, and their texts."""
    sizes = np.diff(offsets)
    count = -(-sizes // WINDOW)
    text = np.repeat(np.arange(len(sizes)), count)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    at = (offsets[:-1][text] + nth * WINDOW)[:, None] + np.arange(WINDOW)
    inside = at < offsets[1:][text][:, None]
    out = raw[np.minimum(at, max(0, len(raw) - 1))] if len(raw) else np.zeros(at.shape, np.uint8)
    out[~inside] = 0
    return out, text


def probabilities(net: Network, tables: list[list[np.ndarray]], raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean class distribution of each text over all its windows; zeros for an empty text."""
    windows, text = cut(raw, offsets)
    n = len(offsets) - 1
    total, weight = np.zeros((n, len(net.classes))), np.zeros(n)
    for a in range(0, len(windows), 256):
        part, own = windows[a : a + 256], text[a : a + 256]
        p = _softmax(_pooled(part, tables) @ net.dense + net.bias)
        w = _LETTER[part].sum(axis=1) + 1e-3
        np.add.at(total, own, p * w[:, None])
        np.add.at(weight, own, w)
    return total / np.maximum(weight, 1e-9)[:, None]


def fit(windows: np.ndarray, labels: np.ndarray, classes: list[str], epochs: int = 12, batch: int = 64, rate: float = 0.01, seed: int = 3) -> Network:
    """Adam on the cross entropy; max pooling sends each gradient to one position, so only those bytes are touched."""
    rng = np.random.default_rng(seed)
    c = len(classes)
    p: dict[str, np.ndarray] = {"e": rng.normal(0, 0.5, (256, EMBED)), "d": rng.normal(0, 0.1, (FILTERS * len(WIDTHS), c)), "b": np.zeros(c)}
    for w in WIDTHS:
        p[f"w{w}"], p[f"s{w}"] = rng.normal(0, (2 / (w * EMBED)) ** 0.5, (w, EMBED, FILTERS)), np.zeros(FILTERS)
    first, second, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    share = np.bincount(labels, minlength=c) / max(1, len(labels))
    weight = 1 / np.maximum(share * c, 1e-9)
    steps = max(1, epochs * -(-len(windows) // batch))
    order = np.concatenate([rng.permutation(len(windows)) for _ in range(epochs)]) if len(windows) else np.zeros(0, int)
    for a in range(0, len(order), batch):
        on = order[a : a + batch]
        x, y = windows[on], labels[on]
        n, emb = len(on), p["e"][x]
        pooled, where = [], []
        for w in WIDTHS:
            m = WINDOW - w + 1
            z = sum(emb[:, o : o + m] @ p[f"w{w}"][o] for o in range(w)) + p[f"s{w}"]
            at = z.argmax(axis=1)
            where.append(at)
            pooled.append(np.take_along_axis(z, at[:, None], axis=1)[:, 0])
        h = np.concatenate(pooled, axis=1)
        act = np.maximum(h, 0)
        g = _softmax(act @ p["d"] + p["b"])
        g[np.arange(n), y] -= 1
        g *= weight[y][:, None] / n
        grad = {"d": act.T @ g, "b": g.sum(axis=0), "e": np.zeros_like(p["e"])}
        back = (g @ p["d"].T) * (h > 0)
        for i, w in enumerate(WIDTHS):
            gw = back[:, i * FILTERS : (i + 1) * FILTERS]
            grad[f"s{w}"], grad[f"w{w}"] = gw.sum(axis=0), np.zeros_like(p[f"w{w}"])
            for o in range(w):
                b = np.take_along_axis(x, where[i] + o, axis=1)
                grad[f"w{w}"][o] = np.einsum("nfe,nf->ef", p["e"][b], gw)
                np.add.at(grad["e"], b.ravel(), (gw[:, :, None] * p[f"w{w}"][o].T[None]).reshape(-1, EMBED))
        step += 1
        now = rate * (1 - (step - 1) / steps)
        for k, v in grad.items():
            first[k] = 0.9 * first[k] + 0.1 * v
            second[k] = 0.999 * second[k] + 0.001 * v * v
            p[k] = p[k] - now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Network(classes, p["e"], [p[f"w{w}"] for w in WIDTHS], [p[f"s{w}"] for w in WIDTHS], p["d"].astype(np.float32), p["b"].astype(np.float32))


def train(df: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = MOST_TEXTS) -> Network:
    """Fit on about ``most`` texts of each language whose rows are ``usable``, drawn evenly by a hash of the id."""
    known = df.filter(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text"))
    counts = {r["_lang"]: r["n"] for r in known.groupBy("_lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return fit(np.zeros((0, WINDOW), np.uint8), np.zeros(0, int), [UNDETERMINED])
    share = F.coalesce(*[F.when(F.col("_lang") == k, F.lit(int(min(1.0, most / n) * (1 << 30)))) for k, n in sorted(counts.items())])
    sample = known.filter(F.pmod(F.xxhash64(F.col("_id").cast("string"), F.lit(11)), F.lit(1 << 30)) < share)
    size = F.octet_length("_text")
    ends = [F.col("_text").cast("binary").substr(F.greatest(F.lit(1), (size * F.lit(k / MOST_WINDOWS)).cast("int") + 1), F.lit(WINDOW)) for k in range(MOST_WINDOWS)]
    rows = sample.select(F.col("_id").cast("string").alias("_id"), "_lang", *[e.alias(f"_w{k}") for k, e in enumerate(ends)]).collect()
    rows = sorted(rows, key=lambda r: (r["_id"] or "", r["_lang"], bytes(r["_w0"])))
    classes = sorted(counts)
    windows, labels = [], []
    for r in rows:
        for piece in dict.fromkeys(bytes(r[f"_w{k}"]) for k in range(MOST_WINDOWS)):
            if piece:
                for shown in (piece, piece.decode("utf-8", "ignore").upper().encode())[: 1 + (len(windows) % 6 == 0)]:
                    windows.append(np.frombuffer(shown[:WINDOW].ljust(WINDOW, b"\0"), np.uint8))
                    labels.append(classes.index(r["_lang"]))
    return fit(np.array(windows, dtype=np.uint8).reshape(-1, WINDOW), np.array(labels, dtype=int), classes)


def identify(df: DataFrame, net: Network, text_col: str = "text", keep: list[str] | None = None, out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``df`` (or its columns ``keep``) with ``lang_pred`` and ``score`` (its mean probability), or as ``out`` names them, of every whole text.

    A null text, or one without a letter, gets ``und`` and 0.0. Columns of these
    two names that ``df`` has are replaced, all others pass through whatever their
    names; repeated rows get the same answer, an empty table an empty one.
    """
    shared = df.sparkSession.sparkContext.broadcast(net)
    names = [c for c in (df.columns if keep is None else keep) if c not in out]
    text = F.col(quoted(text_col)).cast("string")
    kept = df.select(*map(quoted, names))
    asked = df.select(*numbered(names), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letter"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        tables = model.tables()
        for batch in batches:
            best, score = np.zeros(batch.num_rows, int), np.zeros(batch.num_rows)
            for first, last, raw, offsets in chunks(batch.column(len(names) + 1)):
                p = probabilities(model, tables, raw, offsets)
                best[first:last], score[first:last] = p.argmax(axis=1), p.max(axis=1)
            ok = batch.column(len(names)).to_numpy(zero_copy_only=False).astype(bool)
            lang = pa.array([model.classes[b] if k else UNDETERMINED for b, k in zip(best, ok, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], lang, pa.array(np.where(ok, np.clip(score, 0, 1), 0.0))], [*names, *out])

    return spread(asked).mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(out[0], T.StringType()), T.StructField(out[1], T.DoubleType())]))
