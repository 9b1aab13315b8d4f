"""Language-model scoring from a log-frequency Bloom filter.

Counts of words and of word pairs are gathered from the whole training part in
shards of the key space (packed sorted keys and counts, so the shuffle moves few
rows). Each shard then builds its own piece of one Bloom filter: an n-gram whose
count has quantised level L is entered L times, as (n-gram, 1) to (n-gram, L).
The pieces are broadcast; a worker finds a level again by repeated probes. Pairs
enter from ``min_pair`` occurrences on (all of them by default), so their lowest
level is that count's.

    P(w | h) = (c(h w) + mu * P(w)) / (r(h) + mu)

with P(w) from the quantised word counts and r(h) the entered pair total of h.

The unsmoothed base score needs exact word counts. It never holds the vocabulary
in one place: words travel to the shard that owns them, and each shard returns
partial sums for each document. Shards, and salts of a shard that each have its
counts, follow the vocabulary and the texts, so a look-up stays small.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_staged, release, row_name, spread, staged, trim
from .textkit import chunks, mix, words

#: Bits of filter for one entry, and how many of a 64-bit word's bits one membership test looks at.
BITS, PROBES = 16, 5
#: Most bytes broadcast at once, for words and for pairs. A larger filter is broadcast in slices, and texts are routed to them.
MOST_BROADCAST = 64 << 20
#: Bytes of text handled at once; more, up to the second, where the vocabulary has so many shards that pieces would get tiny.
CHUNK, MOST_CHUNK = 1 << 19, 8 << 20
#: Words whose counts one look-up of the base score holds, and input bytes whose words it takes.
OWNED, LOOK_UP_BYTES = 1 << 20, 8 << 20
#: Input bytes for one shard of the counts, and distinct keys a task holds before it passes them on.
SHARD_BYTES, FLUSH = 2 << 20, 1_500_000
#: Keys from the flushes of a shard that a task takes in before it sums them; more where the shard has more distinct ones.
MERGE_KEYS = 1 << 18

_END = np.uint64(0x5EED0FE11D0C0DE5)
_BEGIN = np.uint64(0xB0B0CAFE12345677)
WORD, PAIR, HISTORY = 1, 2, 3


def level_edges(most: int = 1 << 40, step: float = 1.1) -> np.ndarray:
    """Smallest count of each level: exact for small counts, then a tenth apart."""
    edges = [0, 1]
    while edges[-1] < most:
        edges.append(max(edges[-1] + 1, int(edges[-1] * step)))
    return np.array(edges, dtype=np.int64)


EDGES = level_edges()
#: The count that a level stands for: the middle of those it covers.
VALUES = np.append((EDGES[:-1] + EDGES[1:] - 1) / 2.0, float(EDGES[-1]))


def level(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(EDGES, counts, side="right") - 1


def _place(keys: np.ndarray, j: np.ndarray | int, size: np.ndarray | int, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """The word of the filter that an (n-gram, j) falls in, among ``size``, and the bits that it sets there."""
    item = mix(keys + np.uint64(kind * 0x9E3779B97F4A7C15 % (1 << 64)) + np.asarray(j, dtype=np.uint64) * np.asarray(0xD1B54A32D192ED03, dtype=np.uint64))
    bits = np.zeros(len(item), dtype=np.uint64)
    for i in range(PROBES):
        bits |= np.uint64(1) << (item >> np.uint64(6 * i) & np.uint64(63))
    return (item >> np.uint64(32)) * np.asarray(size, dtype=np.uint64) >> np.uint64(32), bits


def build_piece(entries: list[tuple[int, np.ndarray, np.ndarray]], lowest: int = 1) -> np.ndarray:
    """One shard's piece of the filter, from (kind, keys, counts); levels below ``lowest`` are left out."""
    total = sum(int(np.maximum(level(c) - lowest + 1, 0).sum()) for _, _, c in entries)
    piece = np.zeros(max(1, -(-total * BITS // 64)), dtype=np.uint64)
    for kind, keys, counts in entries:
        reach = level(counts)
        for j in range(lowest, int(reach.max(initial=0)) + 1):
            on = keys[reach >= j]
            for at in range(0, len(on), 1 << 18):
                word, bits = _place(on[at : at + (1 << 18)], j, len(piece), kind)
                order = np.argsort(word, kind="stable")
                word, bits = word[order], bits[order]
                first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
                piece[word[first]] |= np.bitwise_or.reduceat(bits, first)
    return piece


class Filter:
    """The broadcast filter: pieces end to end, found by the top bits of a key."""

    def __init__(self, sizes: dict[int, int], pieces, shard_bits: int):
        """``sizes``: 64-bit words of each shard's piece; ``pieces``: (shard, bytes), read one by one."""
        self.shift = np.uint64(64 - shard_bits)
        self.size = np.array([sizes.get(k, 0) for k in range(1 << shard_bits)], dtype=np.uint64)
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]]).astype(np.uint64)
        self.words = np.zeros(int(self.size.sum()), dtype=np.uint64)
        for shard, piece in pieces:
            at = int(self.start[shard])
            self.words[at : at + sizes[shard]] = np.frombuffer(piece, dtype=np.uint64)

    def _shard(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> self.shift).astype(np.int64)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """Whether this slice has the shard of each key."""
        return self.size[self._shard(keys)] > 0

    def has(self, keys: np.ndarray, j: np.ndarray | int, kind: int) -> np.ndarray:
        """Membership of each (n-gram, j)."""
        shard = self._shard(keys)
        word, bits = _place(keys, j, self.size[shard], kind)
        return self.words[self.start[shard] + word] & bits == bits

    def levels(self, keys: np.ndarray, kind: int, lowest: int = 1) -> np.ndarray:
        """Level of each key by repeated probes: ``lowest`` times 1, 2, 4, ... until one fails, then between the last two."""
        low = np.zeros(len(keys), dtype=np.int64)
        left, j = np.flatnonzero(self.holds(keys)), lowest
        while len(left):
            left = left[self.has(keys[left], j, kind)]
            low[left] = j
            j *= 2
        high = low * 2
        left = np.flatnonzero(high - low > 1)
        while len(left):
            middle = (low[left] + high[left]) // 2
            ok = self.has(keys[left], middle, kind)
            low[left[ok]] = middle[ok]
            high[left[~ok]] = middle[~ok]
            left = left[high[left] - low[left] > 1]
        return np.minimum(low, len(VALUES) - 1)


def _tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes with an end after each text; the text of each; the history of each."""
    h, _, _, at = words(raw, offsets)
    n = len(offsets) - 1
    sizes = np.diff(at) + 1
    ends = np.cumsum(sizes) - 1
    out = np.empty(len(h) + n, dtype=np.uint64)
    is_end = np.zeros(len(out), dtype=bool)
    is_end[ends] = True
    out[is_end], out[~is_end] = _END, h
    before = np.empty_like(out)
    before[1:] = out[:-1]
    before[ends - sizes + 1] = _BEGIN
    return out, np.repeat(np.arange(n), sizes), before


def pair_keys(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """32 bits of the history, then 32 of the word."""
    return (before >> np.uint64(32) << np.uint64(32)) | (tokens >> np.uint64(32))


def _runs(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their summed counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    if not len(keys):
        return keys, counts
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first, dtype=counts.dtype)


def _cut(keys: np.ndarray, shard_bits: int) -> np.ndarray:
    return np.searchsorted(keys >> np.uint64(64 - shard_bits), np.arange((1 << shard_bits) + 1, dtype=np.uint64))


def input_bytes(df: DataFrame) -> int:
    """The optimiser's estimate of the input's size; measured by one pass only where it has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 55 else int(df.agg(F.sum(F.octet_length("_text"))).first()[0] or 0)


def gather_counts(texts: DataFrame, shard_bits: int) -> DataFrame:
    """Counts of words and pairs of a column ``_text``: a row for each kind and shard with packed keys and counts.

    The flushes of a shard grow with the input, most of all where a frequent
    history's pairs stand, so they are summed as they come: besides one batch a
    task holds at most twice the shard's distinct keys, or ``MERGE_KEYS`` more.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        held: dict[int, list] = {WORD: [], PAIR: []}

        def flush() -> pa.RecordBatch:
            rows = []
            for kind, parts in held.items():
                if parts:
                    keys, counts = _runs(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))
                    cut = _cut(keys, shard_bits)
                    rows += [(kind, s, keys[a:b].tobytes(), counts[a:b].tobytes()) for s, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
                    parts.clear()
            return pa.RecordBatch.from_pylist([dict(zip(("kind", "shard", "keys", "counts"), r, strict=True)) for r in rows], schema=_PACKED)

        size = 0
        for batch in batches:
            for _, _, raw, offsets in chunks(batch.column(0), CHUNK):
                tokens, _, before = _tokens(raw, offsets)
                for kind, keys in ((WORD, tokens), (PAIR, pair_keys(before, tokens))):
                    k, c = np.unique(keys, return_counts=True)
                    held[kind].append((k, c.astype(np.uint32)))
                    size += len(k)
                if size > FLUSH:
                    yield flush()
                    size = 0
        if size:
            yield flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by kind and shard; what came is put together whenever it outgrows the distinct keys so far."""
        trim()
        group, keys, counts, parts, size = None, np.zeros(0, np.uint64), np.zeros(0, np.uint64), [], 0

        def fold() -> None:
            nonlocal keys, counts, size
            if parts:
                keys, counts = _runs(np.concatenate([keys, *(k for k, _ in parts)]), np.concatenate([counts, *(c.astype(np.uint64) for _, c in parts)]))
                parts.clear()
                size = 0

        def whole() -> pa.RecordBatch:
            fold()
            row = {"kind": group[0], "shard": group[1], "keys": keys.tobytes(), "counts": counts.tobytes(), "types": len(keys), "total": int(counts.sum())}
            return pa.RecordBatch.from_pylist([row], schema=_MERGED)

        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(i)[k].as_py() for i, name in enumerate(_PACKED.names)}
                if (row["kind"], row["shard"]) != group:
                    if group:
                        yield whole()
                    group, keys, counts = (row["kind"], row["shard"]), keys[:0].copy(), counts[:0].copy()
                parts.append((np.frombuffer(row["keys"], np.uint64), np.frombuffer(row["counts"], np.uint32)))
                size += len(parts[-1][0])
                if size > max(len(keys), MERGE_KEYS):
                    fold()
        if group:
            yield whole()

    packed = texts.mapInArrow(count, "kind int, shard int, keys binary, counts binary")
    together = packed.repartition("kind", "shard").sortWithinPartitions("kind", "shard")
    return together.mapInArrow(merge, "kind int, shard int, keys binary, counts binary, types bigint, total bigint")


_PACKED = pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
_MERGED = pa.schema([*_PACKED, ("types", pa.int64()), ("total", pa.int64())])


def filter_pieces(counts: DataFrame, min_pair: int) -> DataFrame:
    """A row for each kind and shard with its piece of the filter; history totals stand with their pairs."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trim()
        for pdf in batches:
            for row in pdf.itertuples():
                keys, n = np.frombuffer(row.keys, np.uint64), np.frombuffer(row.counts, np.uint64).astype(np.int64)
                if row.kind == WORD:
                    entries = [(WORD, keys, n)]
                else:
                    keys, n = keys[n >= min_pair], n[n >= min_pair]
                    entries = [(PAIR, keys, n), (HISTORY, *_runs(keys >> np.uint64(32) << np.uint64(32), n))]
                lowest = 1 if row.kind == WORD else int(level(np.array([min_pair]))[0])
                yield pd.DataFrame({"kind": [row.kind], "shard": [row.shard], "piece": [build_piece(entries, lowest).tobytes()]})

    return counts.select("kind", "shard", "keys", "counts").mapInPandas(build, "kind int, shard int, piece binary")


def _twins(batch: pa.RecordBatch) -> np.ndarray:
    """The two halves of each row's name, n x 2."""
    return np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)


def _named(names: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(names[:, 0]), pa.array(names[:, 1]), *map(pa.array, columns.values())], ["_row", "_twin", *columns])


def base_scores(rows: DataFrame, counts: DataFrame, shard_bits: int, total: int, types: int, most_words: int = OWNED, most_bytes: int = LOOK_UP_BYTES) -> DataFrame:
    """Exact base score and known tokens of each row: words go to the shard of their counts, partial sums come back.

    A look-up holds the counts of about ``most_words`` words at most and the words
    of about ``most_bytes`` of input: shards follow the vocabulary, so that a text
    gets few partial sums, and salts of a shard, which all get its counts, the input.
    """
    scale = total + 0.5 * (types + 1)
    own_bits = min(shard_bits, max(4, (types // most_words).bit_length()))
    salts = max(1, -(-input_bytes(rows) // (most_bytes << own_bits)))
    chunk = min(MOST_CHUNK, max(CHUNK, 1024 << own_bits))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        for batch in batches:
            names = _twins(batch)
            for first, last, raw, offsets in chunks(batch.column(2), chunk):
                tokens, text, _ = _tokens(raw, offsets)
                order = np.argsort(tokens, kind="stable")
                keys, text = tokens[order], text[order]
                starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                keys, at = keys[starts], np.append(starts, len(text))
                times, cut = np.diff(at).astype(np.uint32), _cut(keys, own_bits)
                salt = int(names[first, 0]) % salts
                pieces = []
                for s, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                    if b > a:
                        own, which = np.unique(text[at[a] : at[b]], return_inverse=True)
                        which = which.astype(np.uint16 if len(own) < 65536 else np.uint32)
                        pieces.append({"unit": s * salts + salt, "names": names[first + own].tobytes(), "wide": which.itemsize, "keys": keys[a:b].tobytes(), "runs": times[a:b].tobytes(), "texts": which.tobytes()})
                yield pa.RecordBatch.from_pylist(pieces, schema=_SENT)

    def look_up(known: np.ndarray, n: np.ndarray, row) -> pa.RecordBatch:
        keys = np.frombuffer(row["keys"], np.uint64)
        c = np.zeros(len(keys))
        if len(known):
            at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            c = np.where(known[at] == keys, n[at], 0).astype(float)
        names, runs = np.frombuffer(row["names"], np.int64).reshape(-1, 2), np.frombuffer(row["runs"], np.uint32)
        texts = np.frombuffer(row["texts"], np.uint16 if row["wide"] == 2 else np.uint32)
        logs = np.bincount(texts, np.repeat(np.log10((c + 0.5) / scale), runs), len(names))
        return _named(names, {"base_score": logs, "n_known": np.bincount(texts, np.repeat(c > 0, runs), len(names)).astype(np.int64)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by unit, the counts of its shard before its texts; counts are put together once."""
        trim()
        unit, owned, known, n = None, [], None, None
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)}
                if row["unit"] != unit:
                    unit, owned, known = row["unit"], [], None
                if row["counts"] is not None:
                    owned.append((np.frombuffer(row["keys"], np.uint64), np.frombuffer(row["counts"], np.uint64)))
                    continue
                if known is None:
                    known, n = (np.concatenate([o[i] for o in owned] or [np.zeros(0, np.uint64)]) for i in (0, 1))
                    owned = []
                yield look_up(known, n, row)

    sent = rows.select("_row", "_twin", "_text").mapInArrow(send, "unit int, names binary, wide int, keys binary, runs binary, texts binary")
    shard = F.shiftright("shard", shard_bits - own_bits)
    owned = counts.filter(F.col("kind") == WORD).select(F.explode(F.sequence(shard * salts, shard * salts + salts - 1)).alias("unit"), F.col("shard").alias("place"), "keys", "counts")
    none = F.lit(None).cast("binary")
    together = sent.withColumns({"counts": none, "place": F.lit(None).cast("int")}).unionByName(owned.withColumns({"names": none, "wide": F.lit(0), "runs": none, "texts": none}))
    dealt = together.repartitionById(salts << own_bits, F.col("unit")).sortWithinPartitions("unit", F.col("place").asc_nulls_last()).drop("place")
    partial = dealt.mapInArrow(run, "_row bigint, _twin bigint, base_score double, n_known bigint")
    return partial.groupBy("_row", "_twin").agg(F.sum("base_score").alias("base_score"), F.sum("n_known").alias("n_known"))


_SENT = pa.schema([("unit", pa.int32()), ("names", pa.binary()), ("wide", pa.int32()), ("keys", pa.binary()), ("runs", pa.binary()), ("texts", pa.binary())])


def word_levels(rows: DataFrame, shared_words) -> DataFrame:
    """``rows`` with the level of each token whose word this slice of the filter holds; other tokens keep theirs."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        unigrams = shared_words.value
        for batch in batches:
            for first, last, raw, offsets in chunks(batch.column(2), CHUNK):
                tokens, text, _ = _tokens(raw, offsets)
                w, at = np.unique(tokens, return_inverse=True)
                found = unigrams.levels(w, WORD).astype(np.uint16)[at]
                part = batch.slice(first, last - first)
                before = b"".join(x.as_py() or b"" for x in part.column(3))
                if before:
                    found = np.maximum(found, np.frombuffer(before, np.uint16))
                ends = np.cumsum(np.bincount(text, minlength=last - first))
                packed = [x.tobytes() for x in np.split(found, ends[:-1])]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(packed, pa.binary())], ["_row", "_twin", "_text", "_levels"])

    return rows.select("_row", "_twin", "_text", "_levels").mapInArrow(find, "_row bigint, _twin bigint, _text string, _levels binary")


_SCORED = "_row bigint, _twin bigint, n_tokens bigint, times bigint, score double"


def _scored(pairs: Filter, names: np.ndarray, text: np.ndarray, keys: np.ndarray, first: np.ndarray, known: np.ndarray, scale: float, mu: float, lowest: int) -> pa.RecordBatch:
    """Sums for each text over some of its tokens, given by pair key, whether they begin the text, and word level."""
    single = (VALUES[known] + 0.5) / scale
    b, at = np.unique(keys, return_inverse=True)
    pair = VALUES[pairs.levels(b, PAIR, lowest)][at]
    h, at = np.unique(keys >> np.uint64(32) << np.uint64(32), return_inverse=True)
    rest = VALUES[pairs.levels(h, HISTORY, lowest)][at]
    p = (np.minimum(pair, rest) + mu * single) / (rest + mu)
    n = len(names)
    return _named(names, {"n_tokens": np.bincount(text, minlength=n).astype(np.int64), "times": np.bincount(text[first], minlength=n).astype(np.int64), "score": np.bincount(text, np.log10(p), n).astype(float)})


def _levelled(shared_words, use):
    """A mapInArrow function: ``use(names, text, tokens, histories, word levels)`` on each chunk of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        for batch in batches:
            names = _twins(batch)
            for first, last, raw, offsets in chunks(batch.column(2), CHUNK):
                tokens, text, before = _tokens(raw, offsets)
                if shared_words:
                    w, at = np.unique(tokens, return_inverse=True)
                    known = shared_words.value.levels(w, WORD)[at]
                else:
                    known = np.frombuffer(b"".join(x.as_py() for x in batch.column(3).slice(first, last - first)), np.uint16)
                yield from use(names[first:last], text, tokens, before, known)

    return run


def pair_scores(rows: DataFrame, shared_words, shared_pairs, scale: float, mu: float, lowest: int) -> DataFrame:
    """Tokens and log10 probability of each row, with all pairs in one broadcast."""

    def use(names, text, tokens, before, known):
        yield _scored(shared_pairs.value, names, text, pair_keys(before, tokens), before == _BEGIN, known, scale, mu, lowest)

    columns = ["_row", "_twin", "_text", *([] if shared_words else ["_levels"])]
    return rows.select(*columns).mapInArrow(_levelled(shared_words, use), _SCORED)


_ROUTED = {"names": np.int64, "texts": None, "begins": bool, "words": np.uint64, "levels": np.uint16, "word": None, "histories": np.uint32, "history": None}


def _narrow(index: np.ndarray, size: int) -> np.ndarray:
    return index.astype(np.uint16 if size <= 65536 else np.uint32)


def routed(rows: DataFrame, shared_words, slice_of_shard: np.ndarray, shard_bits: int) -> DataFrame:
    """The tokens of all texts dealt to the slice of the pair filter that holds them, so that no slice needs another's.

    Words and histories of a chunk stand there once, tokens point to them.
    """

    def use(names, text, tokens, before, known):
        to = slice_of_shard[(before >> np.uint64(64 - shard_bits)).astype(np.int64)]
        order = np.argsort(to, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(to[order])) + 1):
            own, which = np.unique(text[part], return_inverse=True)
            words_, first, word = np.unique(tokens[part], return_index=True, return_inverse=True)
            left, history = np.unique((before[part] >> np.uint64(32)).astype(np.uint32), return_inverse=True)
            packed = [names[own], _narrow(which, len(own)), before[part] == _BEGIN, words_, known[part][first].astype(np.uint16), _narrow(word, len(words_)), left, _narrow(history, len(left))]
            yield pa.RecordBatch.from_arrays([pa.array([int(to[part[0]])], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in packed)], ["slice", *_ROUTED])

    columns = ["_row", "_twin", "_text", *([] if shared_words else ["_levels"])]
    return rows.select(*columns).mapInArrow(_levelled(shared_words, use), "slice int, " + ", ".join(f"{c} binary" for c in _ROUTED))


def routed_scores(tokens: DataFrame, shared_pairs, scale: float, mu: float, lowest: int) -> DataFrame:
    """pair_scores() of tokens that came to their slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(i)[k].as_py() for i, c in enumerate(_ROUTED)}
                n = len(row["begins"])
                got = {c: np.frombuffer(row[c], t or (np.uint16 if len(row[c]) == 2 * n else np.uint32)) for c, t in _ROUTED.items()}
                tokens, before = got["words"][got["word"]], got["histories"][got["history"]].astype(np.uint64) << np.uint64(32)
                yield _scored(shared_pairs.value, got["names"].reshape(-1, 2), got["texts"], pair_keys(before, tokens), got["begins"], got["levels"][got["word"]], scale, mu, lowest)

    return tokens.select(*_ROUTED).mapInArrow(run, _SCORED)


def score_texts(df: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_pair: int = 1, mu: float = 20.0, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """Log10 probabilities of whole texts under a model of all ``training`` texts.

    Returns id, n_tokens, n_known, train_tokens, base_score and score for every
    row. A null or empty text is its end token alone. Repeated rows and rows with
    a null id are scored like any other; only the two named columns are read, so
    other columns cannot clash. With no training text every count is 0.
    Rows are told apart by 128 bits of hash of id and text, so a scan that is dealt
    anew after a lost executor gives the same result.
    """
    spark = df.sparkSession
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    rows = df.select(*row_name(df[id_col], text), df[id_col].alias("_id"), text.alias("_text"))
    learn = training.select(F.coalesce(training[text_col].cast("string"), F.lit("")).alias("_text"))
    shard_bits = max(4, (max(1, input_bytes(learn) // SHARD_BYTES)).bit_length())
    counts = staged(gather_counts(spread(learn), shard_bits))
    sums = counts.filter(F.col("kind") == WORD).agg(F.sum("total").alias("n"), F.sum("types").alias("v")).first()
    total, types = int(sums["n"] or 0), int(sums["v"] or 0)
    scale, lowest = total + 0.5 * (types + 1), int(level(np.array([min_pair]))[0])
    pieces, pairs_too = staged(filter_pieces(counts, min_pair)), counts
    counts = staged(pairs_too.filter(F.col("kind") == WORD))
    drop_staged(pairs_too)
    release(spark)
    sizes = {(r["kind"], r["shard"]): r["size"] // 8 for r in pieces.select("kind", "shard", F.length("piece").alias("size")).collect()}

    def slice_of(kind: int, shards: list[int]):
        found = pieces.filter((F.col("kind") == kind) & F.col("shard").isin(shards)).select("shard", "piece")
        own = {s: sizes.get((kind, s), 1) for s in shards}
        return spark.sparkContext.broadcast(Filter(own, ((r["shard"], r["piece"]) for r in found.toLocalIterator()), shard_bits))

    def cut(kind: int) -> list[list[int]]:
        slices, size = [[]], 0
        for s in range(1 << shard_bits):
            own = 8 * sizes.get((kind, s), 1)
            if slices[-1] and size + own > most_broadcast:
                slices.append([])
                size = 0
            slices[-1].append(s)
            size += own
        return slices

    spread_rows, parts, slices = spread(rows), cut(WORD), cut(PAIR)
    with_words, shared_words = spread_rows, None
    if len(parts) == 1:
        shared_words = slice_of(WORD, parts[0])
    else:
        with_words = spread_rows.select("_row", "_twin", "_text", F.lit(None).cast("binary").alias("_levels"))
        for k, shards in enumerate(parts):
            held = slice_of(WORD, shards)
            new = staged(word_levels(with_words, held))
            held.destroy()
            if k:
                drop_staged(with_words)
            with_words = new
    summed = [F.sum("n_tokens").alias("n_tokens"), F.sum("times").alias("times"), F.sum("score").alias("score")]
    if len(slices) == 1:
        held = slice_of(PAIR, slices[0])
        together = staged(pair_scores(with_words, shared_words, held, scale, mu, lowest).groupBy("_row", "_twin").agg(*summed))
        held.destroy()
    else:
        where = np.repeat(np.arange(len(slices)), [len(x) for x in slices])
        tokens, found = staged(routed(with_words, shared_words, where, shard_bits), by="slice"), []
        for k, shards in enumerate(slices):
            held = slice_of(PAIR, shards)
            found.append(staged(routed_scores(tokens.filter(F.col("slice") == k), held, scale, mu, lowest).groupBy("_row", "_twin").agg(*summed)))
            held.destroy()
        drop_staged(tokens)
        release(spark)
        together = reduce(DataFrame.unionByName, found).groupBy("_row", "_twin").agg(*summed)
    if shared_words:
        shared_words.destroy()
    base = staged(base_scores(spread_rows, counts, shard_bits, total, types))
    for done in (counts, pieces, *([with_words] if len(parts) > 1 else [])):
        drop_staged(done)
    return (
        rows.select("_row", "_twin", F.col("_id").alias(id_col))
        .join(together, ["_row", "_twin"])
        .join(base, ["_row", "_twin"])
        .select(
            id_col,
            # a repeated row came as often as it is there
            *[F.round(F.col(c) / F.col("times")).cast("bigint").alias(c) for c in ("n_tokens", "n_known")],
            F.lit(total).cast("bigint").alias("train_tokens"),
            *[(F.col(c) / F.col("times")).alias(c) for c in ("base_score", "score")],
        )
    )
