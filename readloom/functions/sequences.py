"""Column expressions over nucleotide strings; all run inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Adapters and the length of the probe that stands for each.
ADAPTERS = {"NEXTERA": "CTGTCTCTTATACACATCT", "TRUSEQ_R1": "AGATCGGAAGAGC"}
PROBE = 13
_PLAIN, _PAIRED = "ACGTUNacgtun", "TGCAANtgcaan"
_COMPLEMENT = str.maketrans(_PLAIN, _PAIRED)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def reverse_complement(c: Column | str) -> Column:
    """Reverse complement; case is kept, U pairs with A, other characters stay."""
    return F.reverse(F.translate(col(c), _PLAIN, _PAIRED))


def reverse_complement_text(text: str) -> str:
    return text.translate(_COMPLEMENT)[::-1]


def reverse_complement_read(c: Column | str) -> Column:
    """As reverse_complement(), but what is no base becomes N."""
    return F.regexp_replace(reverse_complement(c), "[^ACGTNacgtn]", "N")


def normalised(c: Column | str) -> Column:
    """Upper case, RNA as DNA."""
    return F.translate(F.upper(col(c)), "U", "T")


def near(c: Column, text: str) -> Column:
    """Same length and at most one mismatch: for equal lengths one edit can only be a substitution."""
    return (F.length(c) == len(text)) & (F.levenshtein(c, F.lit(text), 1) >= 0)


def near_prefix(c: Column | str, text: str) -> Column:
    """Does the sequence begin with ``text``, one mismatch allowed?"""
    return near(F.substring(normalised(c), 1, len(text)), text.upper().replace("U", "T"))


def near_at(c: Column, text: str, shift: int, prefix: bool) -> Column:
    """Is ``text`` at ``shift`` bases from the start or the end, one mismatch allowed?"""
    n = len(text)
    place = F.lit(shift + 1) if prefix else F.length(c) - (n + shift - 1)
    return (F.length(c) >= n + shift) & near(F.substring(c, place, F.lit(n)), text)


def near_pattern(text: str) -> str:
    """A pattern that finds ``text`` anywhere with one mismatch at most."""
    return "|".join(re.escape(text[:k]) + "." + re.escape(text[k + 1 :]) for k in range(len(text)))


def contains_near(c: Column, text: str) -> Column:
    return F.coalesce(c.contains(text) | c.rlike(f"(?s){near_pattern(text)}"), F.lit(False))


def places(c: Column, core: str, prefix: bool, window: int) -> Column:
    """Every place of ``core``, overlapping ones too, in the first or last ``window`` bases.

    Places count from 0, from the start of the read or from its end.
    """
    n, size = len(core), F.length(c)
    begin = F.lit(0) if prefix else F.greatest(F.lit(0), size - window)
    end = F.least(size, F.lit(window)) if prefix else size
    starts = F.when(end - begin >= n, F.sequence(begin, end - n)).otherwise(F.array().cast("array<int>"))
    found = F.filter(starts, lambda i: F.substring(c, i + 1, F.lit(n)) == core)
    return found if prefix else F.transform(found, lambda i: size - i - n)


def occurrences(c: Column | str, pattern: str) -> Column:
    """Number of places of ``pattern``, overlapping ones too."""
    c = col(c)
    return F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.substring(c, i, F.lit(len(pattern))) == pattern))


def kmers(c: Column | str, k: int) -> Column:
    """All k-mers of a sequence, in order; none if it is shorter."""
    c = col(c)
    return F.when(F.length(c) >= k, F.transform(F.sequence(F.lit(1), F.length(c) - (k - 1)), lambda i: F.substring(c, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def canonical(c: Column | str) -> Column:
    """The smaller of a k-mer and its reverse complement."""
    c = normalised(c)
    return F.least(c, reverse_complement(c))


def gc_share(c: Column | str) -> Column:
    upper = F.upper(col(c))
    return (F.length(upper) - F.length(F.translate(upper, "GC", ""))) / F.length(upper)


def has_adapter(c: Column, name: str) -> Column:
    """Does the read contain the adapter's probe on either strand?"""
    forward, back = ADAPTERS[name][:PROBE], reverse_complement_text(ADAPTERS[name])[:PROBE]
    return c.contains(forward) | c.contains(back)


def is_adapter(primer: str | None) -> bool:
    """Does a primer begin with an adapter's probe on either strand?"""
    probes = {x[:PROBE] for a in ADAPTERS.values() for x in (a, reverse_complement_text(a))}
    return bool(primer) and primer[:PROBE] in probes


def trailing_number(c: Column | str) -> Column:
    """The number that a round's name ends with; null if none."""
    return F.regexp_extract(col(c), "([0-9]+)$", 1).try_cast("bigint")


def round_order(c: Column | str) -> list[Column]:
    """Sort keys of round names: numbered ones by number first, then by name."""
    n = trailing_number(c)
    return [n.isNull(), n, col(c)]
