"""Inference of constant regions from reads.

Everything that touches reads is a handful of Spark aggregates whose results are
bounded by read length and number of rounds; the decisions on them are plain
Python. Order of first appearance breaks ties, so reads carry ``read_index``.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field
from statistics import mean, median, stdev

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequences as S
from ..plans.report import UNABLE, LibraryReport
from .counting import round_key, top_rows

#: Fixed values of the procedure.
FLOOR_READS, MOST_OFFSETS, LEAST_FLANK, CALLED, CORE = 500, 60, 14, 0.75, 12
FOUND, DOUBTFUL, SURE_LENGTH = 0.7, 0.4, 0.8
WEIGHTS = {
    True: {"match_5p": 0.15, "match_3p": 0.15, "pos_5p": 0.15, "pos_3p": 0.15, "persistence": 0.25, "n_length": 0.1, "adapter_clean": 0.05},
    False: {"match_5p": 0.225, "match_3p": 0.225, "pos_5p": 0.225, "pos_3p": 0.225, "persistence": 0.0, "n_length": 0.05, "adapter_clean": 0.05},
}


def first_seen_mode(counts: list[tuple]) -> tuple | None:
    """(value, count) of the most frequent of (value, count, first index); the first seen wins a tie."""
    return max(((v, n) for v, n, _ in sorted(counts, key=lambda x: x[2])), key=lambda x: x[1], default=None)


def oriented(c: Column, prefix: bool) -> Column:
    return c if prefix else F.reverse(c)


def consensus_counts(reads: DataFrame, prefix: bool) -> DataFrame:
    """offset, base, n, first: how often each base stands at each of the first 60 offsets of one end."""
    width = F.least(F.length("sequence"), F.lit(MOST_OFFSETS))
    bases = F.when(width > 0, F.transform(F.sequence(F.lit(1), width), lambda i: F.substring(oriented(F.col("sequence"), prefix), i, F.lit(1))))
    each = reads.select("read_index", F.posexplode(bases).alias("offset", "base"))
    return each.groupBy("offset", "base").agg(F.count("*").alias("n"), F.min("read_index").alias("first"))


def consensus(reads: DataFrame, prefix: bool, least: int = FLOOR_READS) -> tuple[str, list[float]]:
    """Bases and their supports outward in from one end, as far as ``least`` reads reach."""
    at = defaultdict(list)
    for r in consensus_counts(reads, prefix).collect():
        at[r["offset"]].append((r["base"], r["n"], r["first"]))
    bases, supports = "", []
    for offset in range(MOST_OFFSETS):
        covered = sum(n for _, n, _ in at[offset])
        if covered < least or not covered:
            break
        base, n = first_seen_mode(at[offset])
        bases += base
        supports.append(n / covered)
    return bases, supports


def boundary(supports: list[float], least: int = LEAST_FLANK, called: float = CALLED) -> int:
    """Length of the constant region under a curve of supports; 0 if there is none."""
    n = len(supports)
    if n < least:
        return 0
    drops = (
        k for k in range(least, n - 1)
        if (base := median(supports[k - least : k])) >= 0.9 and supports[k] <= base - 0.12 and max(supports[k : k + 2]) < 0.85
    )
    end = next(drops, n)
    weak = min(called, 0.55)
    end = next((k for k in range(min(end, n - 1)) if max(supports[k : k + 2]) < weak), end)
    if end < least or sum(s >= called for s in supports[:end]) / end < 0.8:
        return 0
    return end


@dataclass
class Flank:
    sequence: str | None = None
    confidence: float = 0.0
    supports: list[float] = field(default_factory=list)


def flank(reads: DataFrame, prefix: bool) -> Flank:
    """The constant region at one end, its supports in reading order, and the share of reads that have it."""
    bases, supports = consensus(reads, prefix)
    n = boundary(supports)
    if not n:
        return Flank()
    text = bases[:n] if prefix else bases[:n][::-1]
    s = F.col("sequence")
    found = reads.filter(F.length(s) >= n).agg(F.count("*").alias("n"), F.avg(S.near_at(s, text, 0, prefix).cast("int")).alias("rate")).first()
    if found["n"] < FLOOR_READS:
        return Flank()
    return Flank(text, found["rate"], supports[:n] if prefix else supports[:n][::-1])


def strong_core(sequence: str | None, supports: list[float], prefix: bool) -> str | None:
    """The part inside a noisy outer edge, if three firm bases follow the edge and 12 are left."""
    if sequence is None or len(supports) != len(sequence):
        return None
    cut = firm = 0
    for k, s in enumerate(supports if prefix else supports[::-1], 1):
        cut, firm = (k, 0) if s < 0.9 else (cut, firm + 1)
        if firm == 3:
            break
    if not cut or len(sequence) - cut < CORE:
        return None
    return sequence[cut:] if prefix else sequence[:-cut]


def match_rate(reads: DataFrame, primer: str | None) -> float:
    """Share of long enough reads that contain the primer anywhere, one mismatch allowed."""
    if primer is None:
        return 0.0
    s = F.col("sequence")
    return reads.filter(F.length(s) >= len(primer)).agg(F.avg(S.contains_near(s, primer).cast("int"))).first()[0] or 0.0


def at_position(primer: str, prefix: bool, offset: Column | int, offsets: list[int]) -> Column:
    """Is the primer within three bases of its round's offset?"""
    s = F.col("sequence")
    shifts = sorted({k for o in offsets for k in range(max(0, o - 3), o + 4)})
    hit = F.lit(False)
    for k in shifts:
        hit = hit | ((F.abs(F.lit(k) - offset) <= 3) & S.near_at(s, primer, k, prefix))
    return hit


def position_rates(reads: DataFrame, rounds: list[str], primer: str | None, prefix: bool, offsets: dict[str, int]) -> list[float]:
    """For each round the share of long enough reads that have the primer in place."""
    if primer is None:
        return [0.0] * len(rounds)
    offset = F.lit(0)
    for name, o in offsets.items():
        offset = F.when(F.col("round") == name, o).otherwise(offset)
    hit = at_position(primer, prefix, offset, list(offsets.values()))
    found = {r["round"]: r["rate"] for r in reads.filter(F.length("sequence") >= len(primer)).groupBy("round").agg(F.avg(hit.cast("int")).alias("rate")).collect()}
    return [found.get(name, 0.0) for name in rounds]


def fragment(length: int, prefix: bool, offset: int) -> Column:
    s = F.col("sequence")
    place = F.lit(offset + 1) if prefix else F.length(s) - (offset + length - 1)
    return F.when(F.length(s) >= length + offset, F.substring(s, place, F.lit(length)))


def top_variants(reads: DataFrame, length: int, prefix: bool, offset: int = 0, k: int = 3) -> list:
    """The k most frequent fragments in the primer's place."""
    if not length:
        return []
    return [[r["v"], r["n"]] for r in variant_counts(reads, length, prefix, offset).orderBy(F.desc("n"), "first").limit(k).collect()]


def variant_counts(reads: DataFrame, length: int, prefix: bool, offset: int = 0) -> DataFrame:
    return reads.select("read_index", fragment(length, prefix, offset).alias("v")).filter("v is not null").groupBy("v").agg(F.count("*").alias("n"), F.min("read_index").alias("first"))


def insert_lengths(reads: DataFrame, outside: int) -> DataFrame:
    """length, n, first: reads by what is left of them without both flanks."""
    length = F.greatest(F.lit(0), F.length("sequence") - outside)
    return reads.groupBy(length.alias("length")).agg(F.count("*").alias("n"), F.min("read_index").alias("first"))


def strand(primer_5p: str | None, primer_3p: str | None) -> Column:
    """forward, reverse or ambiguous, from the read's first bases; forward is tried first."""
    s = F.col("sequence")
    out = F.lit("ambiguous")
    if primer_3p:
        out = F.when(S.near_prefix(s, S.reverse_complement_text(primer_3p)), "reverse").otherwise(out)
    return F.when(S.near_prefix(s, primer_5p), "forward").otherwise(out) if primer_5p else out


def orientation(reads: DataFrame, primer_5p: str | None, primer_3p: str | None) -> str:
    if primer_5p is None and primer_3p is None:
        return "FORWARD"
    n = {r["strand"]: r["count"] for r in reads.groupBy(strand(primer_5p, primer_3p).alias("strand")).count().collect()}
    ahead, back = n.get("forward", 0), n.get("reverse", 0)
    share = back / (ahead + back) if ahead + back else 0.0
    return "FORWARD" if share < 0.05 else "REVERSE" if share > 0.95 else "MIXED"


def adapter_hits(reads: DataFrame) -> dict[str, int]:
    """Reads that contain each known adapter."""
    s = F.col("sequence")
    found = reads.agg(*[F.count_if(S.has_adapter(s, name)).alias(name) for name in S.ADAPTERS]).first()
    return {name: int(found[name]) for name in sorted(S.ADAPTERS)}


def shared_constant(text: str, reads: DataFrame, rounds: list[str], prefix: bool) -> tuple[str, dict[str, int | None]]:
    """The part of a flank that anchored rounds share, and where it stands in each round.

    The inner 12 bases stay; the outer edge ends at the first base that an
    anchored round does not share. A round is anchored if half its reads have the
    core in one agreed place.
    """
    n_core = min(CORE, len(text))
    core, edge = (text[-n_core:], text[: len(text) - n_core][::-1]) if prefix else (text[:n_core], text[n_core:])
    whole = (text, dict.fromkeys(rounds, 0))
    marked = reads.select("round", "read_index", "sequence", S.places(F.col("sequence"), core, prefix, len(text) + 12).alias("at")).persist()
    try:
        single: dict[str, list] = defaultdict(list)
        for r in marked.filter(F.size("at") == 1).groupBy("round", F.col("at")[0].alias("p")).agg(F.count("*").alias("n"), F.min("read_index").alias("first")).collect():
            single[r["round"]].append((r["p"], r["n"], r["first"]))
        agreed = {name: m[0] for name, c in single.items() if (m := first_seen_mode(c))[1] >= 0.8 * sum(n for _, n, _ in c)}
        choice = F.lit(None).cast("int")
        for name, p in agreed.items():
            choice = F.when(F.col("round") == name, p).otherwise(choice)
        place = F.when(F.size("at") == 1, F.col("at")[0]).when(F.array_contains("at", choice), choice)
        placed = marked.select("round", "read_index", "sequence", place.alias("p"))
        sizes = {r["round"]: (r["n"], r["on"]) for r in placed.groupBy("round").agg(F.count("*").alias("n"), F.count("p").alias("on")).collect()}
        spots: dict[str, list] = defaultdict(list)
        for r in placed.filter("p is not null").groupBy("round", "p").agg(F.count("*").alias("n"), F.min("read_index").alias("first")).collect():
            spots[r["round"]].append((r["p"], r["n"], r["first"]))
        s, p = F.col("sequence"), F.col("p")
        if prefix:
            begin = F.greatest(F.lit(1), p - len(edge) + 1)
            outer = F.reverse(F.substring(s, begin, p - begin + 1))
        else:
            outer = F.substring(s, F.length(s) - p + 1, F.least(F.lit(len(edge)), p))
        bases: dict[tuple, dict] = defaultdict(dict)
        if edge:
            outer = F.when(p > 0, F.split(outer, ""))
            for r in placed.filter("p is not null").select("round", F.posexplode(outer).alias("k", "base")).filter("base <> ''").groupBy("round", "k", "base").count().collect():
                bases[r["round"], r["k"]][r["base"]] = r["count"]
    finally:
        marked.unpersist()
    kept, core_at = len(edge), dict.fromkeys(rounds)
    for k, name in enumerate(rounds):
        n, on = sizes.get(name, (0, 0))
        if not n or on < 0.5 * n:
            if k == 0:
                return whole
            continue
        core_at[name] = first_seen_mode(spots[name])[0]

        def shared(place: int, name: str = name, on: int = on) -> bool:
            seen = {b: c for b, c in bases[name, place].items() if b != "."}
            covered = sum(seen.values())
            base = max("ACGT", key=lambda b: seen.get(b, 0))
            return covered >= 0.5 * on and base == edge[place] and seen.get(base, 0) >= 0.55 * covered

        kept = next((place for place in range(kept) if not shared(place)), kept)
    constant = text[len(text) - n_core - kept :] if prefix else text[: n_core + kept]
    if sum(text.startswith(constant, k) for k in range(len(text))) > 1:
        return whole
    return constant, {name: None if at is None else at - kept for name, at in core_at.items()}


def agree(left: str | None, right: str | None) -> bool:
    """One contains the other with one mismatch at most."""
    if left is None or right is None:
        return False
    long, short = sorted((left, right), key=len, reverse=True)
    return any(sum(a != b for a, b in zip(long[k:], short, strict=False)) <= 1 for k in range(len(long) - len(short) + 1))


def persistence_score(rates: list[float]) -> float | None:
    if len(rates) < 2 or mean(rates) < 0.1:
        return None
    return max(0.0, min(1.0, 1 - stdev(rates) / mean(rates)))


def persistence(rates_5p: list[float], rates_3p: list[float], primer_5p: str | None, primer_3p: str | None) -> float | None:
    scores = [persistence_score(r) for r, p in ((rates_5p, primer_5p), (rates_3p, primer_3p)) if p is not None]
    scores = [x for x in scores if x is not None]
    return sum(scores) / len(scores) if scores else None


def composite(signals: dict, several_rounds: bool) -> float:
    total = 0.0
    for name, weight in WEIGHTS[several_rounds].items():
        if signals[name] is not None:
            total += weight * signals[name]
    return max(0.0, min(1.0, total))


def status(mode: str, confidence: float, several_rounds: bool) -> str:
    if mode == UNABLE or confidence < 0.3:
        return "UNABLE_TO_INFER"
    level = "HIGH" if confidence >= 0.85 else "MEDIUM" if confidence >= 0.6 else "LOW"
    return "MEDIUM" if level == "HIGH" and not several_rounds else level


def classify(rate_5p: float, rate_3p: float, length_confidence: float, split: bool, several_rounds: bool, confidence: float) -> dict:
    """Mode, action, status and reason from the rates."""

    # fixed values: reasons stand in reports, byte for byte
    def able(mode: str, action: str = "NONE") -> dict:
        return {"extraction_mode": mode, "full_insert_recovered": mode == "BOTH_PRIMERS_SINGLE_READ", "required_action": action, "status": status(mode, confidence, several_rounds), "failure_reason": None}

    def unable(reason: str) -> dict:
        return {"extraction_mode": UNABLE, "full_insert_recovered": False, "required_action": "MANUAL_PRIMERS_REQUIRED", "status": "UNABLE_TO_INFER", "failure_reason": reason}

    has_5p, has_3p = rate_5p > FOUND, rate_3p > FOUND
    if rate_5p < DOUBTFUL and rate_3p < DOUBTFUL:
        return unable(f"Both primer match rates below 0.40 (5'={rate_5p:.2f}, 3'={rate_3p:.2f})")
    if split:
        return able("PAIRED_END_SPLIT_PRIMERS", "READ_MERGING_RECOMMENDED")
    if has_5p and has_3p:
        return able("BOTH_PRIMERS_SINGLE_READ")
    if not has_5p and not has_3p:
        return unable(f"Ambiguous primer evidence: 5'={rate_5p:.2f}, 3'={rate_3p:.2f}, neither side passes the 0.70 'primer found' threshold")
    if length_confidence > SURE_LENGTH:
        return able("FIVE_PRIME_ONLY" if has_5p else "THREE_PRIME_ONLY")
    side = "5'" if has_5p else "3'"
    return unable(f"Only {side} primer detected but N-length confidence ({length_confidence:.2f}) <= threshold (0.80)")


def sampled(reads: DataFrame, most: int | None, seed: int) -> DataFrame:
    """Exactly ``most`` reads of each round and mate, drawn by a seeded hash; all where it is None, not positive or not reached."""
    if most is None or most <= 0:
        return reads
    lot = F.xxhash64(F.lit(int(seed)), "file_index", "read_index")
    return top_rows(reads, ["round", "mate"], [lot, F.col("file_index"), F.col("read_index")], F.xxhash64("read_index", "file_index"), most, "_lot").drop("_lot")


def detect(reads: DataFrame, read_source: str = "R1", sampling_seed: int = 42, max_reads_per_round: int | None = None) -> LibraryReport:
    """Infer a library's constant regions from the earliest round and verify them across rounds.

    ``reads`` has round, mate (R1, or R2 for the paired stream), file_index,
    read_index and sequence. What cannot be inferred is reported, not guessed.
    """
    base = LibraryReport(read_source=read_source, sampling_seed=sampling_seed)
    sizes = {(r["round"], r["mate"]): r["count"] for r in reads.groupBy("round", "mate").count().collect()}
    rounds = sorted({r for r, m in sizes if m == "R1"}, key=round_key)
    if not rounds:
        return _with(base, failure_reason="No sequences provided")
    paired = any(m == "R2" for _, m in sizes)
    if paired and {r for r, m in sizes if m == "R2"} != set(rounds):
        raise ValueError("The paired mates must have the same rounds as the reads.")
    cap = max_reads_per_round if max_reads_per_round and max_reads_per_round > 0 else None
    fractions = [min(1.0, cap / sizes[r, "R1"]) if cap else 1.0 for r in rounds]
    order = F.col("read_index") if "file_index" not in reads.columns else F.coalesce(F.col("file_index"), F.lit(0)).cast("bigint") * (1 << 40) + F.col("read_index")
    pool = sampled(reads, cap, sampling_seed).select("round", "mate", S.normalised("sequence").alias("sequence"), order.alias("read_index")).persist()
    try:
        return _detect(pool, rounds, sizes, paired, cap, sum(fractions) / len(fractions), base)
    finally:
        pool.unpersist()


def _with(report: LibraryReport, **change) -> LibraryReport:
    from dataclasses import replace

    return replace(report, **change)


def _detect(pool: DataFrame, rounds: list[str], sizes: dict, paired: bool, cap: int | None, fraction: float, base: LibraryReport) -> LibraryReport:
    first = rounds[0]
    r1, r2 = pool.filter("mate = 'R1'"), pool.filter("mate = 'R2'")
    early = r1.filter(F.col("round") == first)
    hits = adapter_hits(early)
    base = _with(base, known_adapter_hits=hits)

    def enough(mate: str) -> bool:
        return min(sizes.get((first, mate), 0), cap or 1 << 62) >= FLOOR_READS

    if not enough("R1"):
        return _with(base, failure_reason="Earliest round has fewer than 500 sequences — below detection floor")
    seen_5p, seen_3p = flank(early, True), flank(early, False)
    full_5p, full_3p = (None if S.is_adapter(f.sequence) else f.sequence for f in (seen_5p, seen_3p))
    clean = not (S.is_adapter(seen_5p.sequence) or S.is_adapter(seen_3p.sequence))
    split, pool_3p, prefix_3p, look_3p = False, r1, False, full_3p
    if paired and enough("R2"):
        mate = flank(r2.filter(F.col("round") == first), True)
        far = S.reverse_complement_text(mate.sequence) if mate.sequence else None
        if seen_5p.confidence > FOUND and mate.confidence > FOUND and far and not (seen_3p.confidence > FOUND and agree(seen_3p.sequence, far)):
            split, pool_3p, prefix_3p, look_3p, full_3p = True, r2, True, mate.sequence, far
    primer_5p, offsets_5p = shared_constant(full_5p, r1, rounds, True) if full_5p else (None, dict.fromkeys(rounds, 0))
    primer_look, offsets_3p = shared_constant(look_3p, pool_3p, rounds, prefix_3p) if look_3p else (None, dict.fromkeys(rounds, 0))
    primer_3p = S.reverse_complement_text(primer_look) if split and primer_look else primer_look

    def settled(offsets: dict) -> dict[str, int]:
        start = offsets[first] if offsets[first] is not None else 0
        return {name: start if o is None else o for name, o in offsets.items()}

    offsets_5p, offsets_3p = settled(offsets_5p), settled(offsets_3p)
    rates_5p = position_rates(r1, rounds, primer_5p, True, offsets_5p)
    rates_3p = position_rates(pool_3p, rounds, primer_look, prefix_3p, offsets_3p)
    early_3p = pool_3p.filter(F.col("round") == first)
    rate_5p, rate_3p = match_rate(early, primer_5p), match_rate(early_3p, primer_look)
    if rate_5p <= FOUND and primer_5p and primer_5p == seen_5p.sequence and (core := strong_core(primer_5p, seen_5p.supports, True)):
        rate_5p = max(rate_5p, match_rate(early, core))
    if not split and rate_3p <= FOUND and primer_look and primer_look == seen_3p.sequence and (core := strong_core(primer_look, seen_3p.supports, False)):
        rate_3p = max(rate_3p, match_rate(early_3p, core))
    length_mode, lengths, length_confidence = None, {}, 0.0
    if not split:
        counts = [(r["length"], r["n"], r["first"]) for r in insert_lengths(early, len(full_5p or "") + len(full_3p or "")).collect()]
        length_mode, n = first_seen_mode(counts)
        lengths = {str(v): c for v, c, _ in counts}
        length_confidence = n / sum(lengths.values())
        if length_mode == 0:
            return _with(
                base,
                failure_reason="Inferred random-region length is 0 nt: the flanks meet, so no constant/random boundary can be identified. "
                "Supply reviewed primer_5p and primer_3p overrides if this is a selection library.",
            )
    several = len(rounds) >= 2
    confidence = composite(
        {"match_5p": rate_5p, "match_3p": rate_3p, "pos_5p": rates_5p[0], "pos_3p": rates_3p[0], "persistence": persistence(rates_5p, rates_3p, primer_5p, primer_3p), "n_length": length_confidence, "adapter_clean": float(clean)},
        several,
    )
    return _with(
        base,
        primer_5p=primer_5p,
        primer_3p=primer_3p,
        variants_5p=top_variants(early, len(primer_5p or ""), True, offsets_5p[first]),
        variants_3p=top_variants(early_3p, len(primer_look or ""), prefix_3p, offsets_3p[first]),
        orientation=orientation(early, full_5p, full_3p),
        n_length_mode=length_mode,
        n_length_distribution=lengths,
        n_length_confidence=length_confidence,
        match_rate_5p=rate_5p,
        match_rate_3p=rate_3p,
        position_consistency_5p=rates_5p[0],
        position_consistency_3p=rates_3p[0],
        read_fraction_used_for_inference=fraction,
        confidence=confidence,
        **classify(rate_5p, rate_3p, length_confidence, split, several, confidence),
    )
