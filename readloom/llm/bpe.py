"""Byte-level BPE through a tokenisation automaton.

``compile_automaton`` starts from the one-state automaton that accepts every
byte sequence and adds the merges in order of rank. The gadget of a merge
``(u, v) -> uv`` splits the state that ``u`` leads to: the copy loses its arc
``v``, every arc ``u`` now ends in the copy, and a new arc ``uv`` bypasses both,
starting wherever ``u`` started and ending where ``v`` ended. What remains
accepts exactly the token sequences that BPE makes, so every prefix of a word
has one path. States are kept as the list of arcs that splits took away, which
is linear in the number of merges; arcs are worked out from that list when first
used and then looked up in a table.
"""

from __future__ import annotations

import gc
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .shared import spread

#: The published byte-level word pattern, spelt with the Unicode white-space property.
WHITE = "\t-\r \x85\xa0" + "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_GENERAL = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
)
#: The same over ASCII and Latin letters alone, which the standard library matches faster.
_LATIN = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-" + chr(0x24F)
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
_FAST = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[{_NUMBER}]+| ?[^{WHITE}{_LATIN}{_NUMBER}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
)
_OTHER = re.compile(f"[^\x00-{chr(0x24F)}{chr(0x2000)}-{chr(0x206F)}]")
_NEVER = 1 << 60


def byte_alphabet() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@dataclass
class Automaton:
    """Deterministic automaton over tokens with the byte trie of its arc labels."""

    labels: list[bytes]
    left: list[int]
    right: list[int]
    born: list[int]
    split: dict[int, int]
    trie: dict[int, int]
    emits: list[int]
    special: dict[str, int] = field(default_factory=dict)
    arcs: dict[int, bool] = field(default_factory=dict)

    def step(self, last: int, token: int) -> bool:
        """Is there an arc ``token`` from the state that ``last`` leads to?"""
        until, r = _NEVER, last
        while r >= 0:
            before, t = _NEVER, token
            while t >= 0:
                rank = self.split.get(r << 17 | t)
                if rank is not None and rank < until and rank <= before:
                    return False
                before, t = self.born[t], self.left[t]
            until, r = self.born[r], self.right[r]
        return True

    def encode_word(self, word: bytes) -> list[int]:
        """Follow the one path whose labels spell ``word``."""
        n, trie, emits, arcs = len(word), self.trie, self.emits, self.arcs
        at = [-1] * (n + 1)
        for i in range(n):
            last = at[i]
            if i and last < 0:
                continue
            node, j = 0, i
            while j < n:
                node = trie.get(node << 8 | word[j], -1)
                if node < 0:
                    break
                j += 1
                token = emits[node]
                if token >= 0 and at[j] < 0:
                    if i:
                        key = last << 17 | token
                        ok = arcs.get(key)
                        if ok is None:
                            if len(arcs) > 2_000_000:
                                arcs.clear()
                            ok = arcs[key] = self.step(last, token)
                        if not ok:
                            continue
                    at[j] = token
        out, j = [], n
        while j:
            out.append(at[j])
            j -= len(self.labels[at[j]])
        out.reverse()
        return out

    def decode(self, ids) -> bytes:
        """Emit the labels of the arcs."""
        return b"".join(map(self.labels.__getitem__, ids))


def compile_automaton(tokenizer_json: str) -> Automaton:
    """Compile the vocabulary and merges of a byte-level tokenizer file."""
    with open(tokenizer_json, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
    for x in spec.get("added_tokens", ()):
        if any(x.get(flag) for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"The added token {x['content']!r} takes in what stands beside it, which is not supported.")
    added = {x["content"]: x["id"] for x in spec.get("added_tokens", ())}
    size = max([*vocab.values(), *added.values()]) + 1
    labels = [b""] * size
    for text, k in vocab.items():
        labels[k] = bytes(map(alphabet.__getitem__, text))
    for text, k in added.items():
        labels[k] = text.encode()
    a = Automaton(labels, [-1] * size, [-1] * size, [-1] * size, {}, {}, [-1], added)
    alive = [len(x) == 1 for x in labels]
    for rank, merge in enumerate(spec["model"]["merges"]):
        u, v = (vocab[x] for x in (merge.split(" ") if isinstance(merge, str) else merge))
        new = vocab["".join(merge.split(" ") if isinstance(merge, str) else merge)]
        if not (alive[u] and alive[v] and a.step(u, v)) or alive[new]:
            continue  # no path u v is left, so the gadget would change nothing
        a.split[u << 17 | v] = rank
        a.left[new], a.right[new], a.born[new], alive[new] = u, v, rank, True
    for token, label in enumerate(labels):
        if alive[token]:
            node = 0
            for b in label:
                key = node << 8 | b
                if key not in a.trie:
                    a.trie[key] = len(a.emits)
                    a.emits.append(-1)
                node = a.trie[key]
            a.emits[node] = token
    return a


class _Followed(dict):
    """Words already followed: the first ``most`` for good, later ones in a second table that is emptied when full."""

    def __init__(self, automaton: Automaton, most: int):
        self.automaton, self.most, self.later = automaton, most, {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.later.get(word)
        if ids is None:
            ids = tuple(self.automaton.encode_word(word.encode()))
            if len(self) < self.most:
                self[word] = ids
            else:
                if len(self.later) * 2 > self.most:
                    self.later.clear()
                self.later[word] = ids
        return ids


class Codec:
    """Whole texts to ids and back, with a bounded table of words already followed."""

    def __init__(self, automaton: Automaton, most_words: int = 600_000):
        self.automaton = automaton
        self.known = _Followed(automaton, most_words)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, automaton.special)) + ")") if automaton.special else None

    def _plain(self, text: str) -> list[int]:
        found = (_GENERAL if not text.isascii() and _OTHER.search(text) else _FAST).findall(text)
        return list(chain.from_iterable(map(self.known.__getitem__, found)))

    def encode(self, text: str | None) -> list[int]:
        """Ids of the whole text; a null text is empty. Special tokens written in it become their ids."""
        if not text:
            return []
        special = self.automaton.special
        if self.marks is None or not any(x in text for x in special):
            return self._plain(text)
        return [k for part in self.marks.split(text) if part for k in ([special[part]] if part in special else self._plain(part))]

    def decode(self, ids) -> str:
        return self.automaton.decode(ids).decode("utf-8", errors="replace")


#: Output columns of tokenize(): type and function of (codec, ids, decimal spelling of each id).
_OUTPUTS = {
    "ids": ("array<int>", lambda c, ids, spelt: ids),
    "n_tokens": ("bigint", lambda c, ids, spelt: len(ids)),
    "ids_sha256": ("string", lambda c, ids, spelt: sha256(",".join(map(spelt.__getitem__, ids)).encode()).hexdigest()),
    "decoded": ("string", lambda c, ids, spelt: c.decode(ids)),
    "decoded_sha256": ("string", lambda c, ids, spelt: sha256(c.decode(ids).encode()).hexdigest()),
}
_ARROW = {"array<int>": pa.list_(pa.int32()), "bigint": pa.int64(), "string": pa.string()}


def tokenize(df: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("ids",)) -> DataFrame:
    """Encode every whole text, and decode it again where an output asks for that.

    Returns the id column and the chosen ``outputs``; other columns of ``df`` do
    not take part, so their names cannot clash. A null or empty text has no
    tokens. Repeated rows give repeated results; an empty table gives none.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(compile_automaton(tokenizer_json))
    picked = df.select(df[id_col].alias("_id"), df[text_col].cast("string").alias("_text"))
    id_type = picked.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # nothing here makes cycles, and the tables are large
        codec = Codec(shared.value)
        spelt = list(map(str, range(len(codec.automaton.labels))))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows: list[list] = [[] for _ in outputs]
                for text in part.column(1):
                    ids = codec.encode(text.as_py())
                    for kept, name in zip(rows, outputs, strict=True):
                        kept.append(_OUTPUTS[name][1](codec, ids, spelt))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(r, _ARROW[_OUTPUTS[n][0]]) for r, n in zip(rows, outputs, strict=True))], [id_col, *outputs]
                )

    return spread(picked).mapInArrow(run, f"`{id_col}` {id_type}, " + ", ".join(f"{n} {_OUTPUTS[n][0]}" for n in outputs))


def decode_ids(df: DataFrame, tokenizer_json: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts of token id lists, as columns ``id_col`` and ``decoded``; a null list gives an empty text."""
    shared = df.sparkSession.sparkContext.broadcast(compile_automaton(tokenizer_json))
    picked = df.select(df[id_col].alias("_id"), df[ids_col].cast("array<int>").alias("_ids"))

    def run(batches):
        a = shared.value
        for batch in batches:
            texts = [a.decode(x.as_py() or ()).decode("utf-8", errors="replace") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "decoded"])

    return picked.mapInArrow(run, f"`{id_col}` {picked.schema['_id'].dataType.simpleString()}, decoded string")
