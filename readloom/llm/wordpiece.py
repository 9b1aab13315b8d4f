"""Token counts by a linear longest-match automaton.

A trie of word-initial and continuing pieces gets a failure link and a number of
popped tokens on every node: on a byte without an arc, the pieces matched so far
are popped and matching goes on from the link. Counting adds up the popped
numbers, so no piece is built and each byte is read once. Words of a chunk are
hashed, each different one is run once, and all run in step as numpy arrays.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import spread
from .textkit import chunks, words

NONE = -1
#: Words longer than this are counted one by one; all others run in step.
LONG = 512


@dataclass
class Counter:
    """Flat arrays of the automaton; nodes 0 and 1 are the roots of initial and continuing pieces."""

    row: np.ndarray
    many: np.ndarray
    byte: np.ndarray
    next: np.ndarray
    link: np.ndarray
    pops: np.ndarray
    _lists: tuple | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_lists": None}

    def _go(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        row = self.row[node]
        one = np.where(self.byte[node] == byte, self.next[node], NONE)
        return np.where(row >= 0, self.many[np.maximum(row, 0), byte], one)

    def count(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Pieces of each word; a word that pieces cannot cover is one unknown token."""
        n = np.zeros(len(starts), dtype=np.int64)
        long = np.flatnonzero(ends - starts > LONG)
        if len(long):
            for k in long:
                n[k] = self.count_one(raw[starts[k] : ends[k]].tobytes())
            rest = np.flatnonzero(ends - starts <= LONG)
            n[rest] = self.count(raw, starts[rest], ends[rest])
            return n
        order = np.argsort(starts - ends, kind="stable")
        at, stop = starts[order], ends[order]
        longest = stop - at
        node = np.zeros(len(order), dtype=np.int64)
        lost = np.zeros(len(order), dtype=bool)
        got = np.zeros(len(order), dtype=np.int64)
        for k in range(int(longest.max(initial=0))):
            live = int(np.searchsorted(-longest, -k, side="left"))
            todo = np.flatnonzero(~lost[:live])
            byte = raw[at[todo] + k]
            while len(todo):
                to = self._go(node[todo], byte)
                ok = to >= 0
                node[todo[ok]] = to[ok]
                todo, byte = todo[~ok], byte[~ok]
                todo, byte = self._fall(todo, node, got, lost, byte)
        todo = np.flatnonzero(~lost & (node != 1))
        while len(todo):
            todo, _ = self._fall(todo, node, got, lost, todo)
            todo = todo[node[todo] != 1]
        n[order] = np.where(lost, 1, got)
        return n

    def count_one(self, word: bytes) -> int:
        """Pieces of one word, byte by byte: for long words, which have no others to run in step with."""
        row, byte, to, link, pops = (x.tolist() for x in (self.row, self.byte, self.next, self.link, self.pops)) if self._lists is None else self._lists
        self._lists = row, byte, to, link, pops
        many, node, got = self.many, 0, 0
        for b in word:
            while True:
                next_ = many.item(row[node], b) if row[node] >= 0 else to[node] if byte[node] == b else NONE
                if next_ >= 0:
                    node = next_
                    break
                if link[node] < 0:
                    return 1
                got += pops[node]
                node = link[node]
        while node != 1:
            if link[node] < 0:
                return 1
            got += pops[node]
            node = link[node]
        return got

    def _fall(self, todo, node, got, lost, byte):
        link = self.link[node[todo]]
        stuck = link < 0
        lost[todo[stuck]] = True
        todo, byte, link = todo[~stuck], byte[~stuck], link[~stuck]
        got[todo] += self.pops[node[todo]]
        node[todo] = link
        return todo, byte


def build(initial: Iterable[bytes], continuing: Iterable[bytes]) -> Counter:
    """The automaton of a vocabulary split into word-initial and continuing pieces."""
    arcs: list[dict[int, int]] = [{}, {}]
    final = [False, False]
    for root, pieces in ((0, initial), (1, continuing)):
        for piece in pieces:
            node = root
            for b in piece:
                node = arcs[node].setdefault(b, len(arcs))
                if node == len(arcs):
                    arcs.append({})
                    final.append(False)
            final[node] = final[node] or bool(piece)
    link, pops = [NONE] * len(arcs), [0] * len(arcs)
    layer = [0, 1]
    while layer:
        below = []
        for u in layer:
            for b, v in arcs[u].items():
                below.append(v)
                if final[v]:
                    link[v], pops[v] = 1, 1
                    continue
                z, popped = link[u], pops[u]
                while z != NONE and b not in arcs[z]:
                    popped += pops[z]
                    z = link[z]
                if z != NONE:
                    link[v], pops[v] = arcs[z][b], popped
        layer = below
    size = len(arcs)
    branching = [k for k, a in enumerate(arcs) if len(a) > 1]
    row, many = np.full(size, NONE, dtype=np.int32), np.full((max(1, len(branching)), 256), NONE, dtype=np.int32)
    byte, following = np.full(size, NONE, dtype=np.int16), np.full(size, NONE, dtype=np.int32)
    for r, k in enumerate(branching):
        row[k] = r
        many[r, list(arcs[k])] = list(arcs[k].values())
    for k, a in enumerate(arcs):
        if len(a) == 1:
            ((byte[k], following[k]),) = a.items()
    return Counter(row, many, byte, following, np.array(link, dtype=np.int32), np.array(pops, dtype=np.int32))


def count_tokens(df: DataFrame, counter: Counter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words and n_tokens of every whole text; a null or empty text has none of either.

    Other columns are not read, so their names cannot clash. Repeated rows and null
    ids give rows like any other, an empty table none. A word of any length takes
    time in proportion to it.
    """
    shared = df.sparkSession.sparkContext.broadcast(counter)
    picked = df.select(df[id_col].alias("_id"), df[text_col].cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, raw, offsets in chunks(batch.column(1)):
                h, starts, ends, at = words(raw, offsets, lower=False)
                _, one, back = np.unique(h, return_index=True, return_inverse=True)
                each = shared.value.count(raw, starts[one], ends[one])[back]
                total = np.concatenate([[0], np.cumsum(each)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(np.diff(at)), pa.array(total[at[1:]] - total[at[:-1]])], [id_col, "n_words", "n_tokens"])

    return spread(picked).mapInArrow(run, f"`{id_col}` {picked.schema['_id'].dataType.simpleString()}, n_words bigint, n_tokens bigint")


def byte_level_pieces(tokenizer_json: str) -> tuple[list[bytes], list[bytes]]:
    """Pieces of a byte-level vocabulary file: those written with a leading space start a word, all others continue it."""
    import json

    from .bpe import byte_alphabet

    with open(tokenizer_json, encoding="utf-8") as f:
        vocab, alphabet = json.load(f)["model"]["vocab"], byte_alphabet()
    pieces = [bytes(map(alphabet.__getitem__, text)) for text in vocab]
    return [p[1:] for p in pieces if p[:1] == b" " and len(p) > 1], [p for p in pieces if p[:1] != b" "]
