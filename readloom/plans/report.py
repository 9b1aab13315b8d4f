"""The library report: a fixed, ordered record, its validation, its JSON and manual corrections."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import asdict, dataclass, field, fields, replace

#: Fixed values of the record's closed fields.
MODES = ("BOTH_PRIMERS_SINGLE_READ", "FIVE_PRIME_ONLY", "THREE_PRIME_ONLY", "PAIRED_END_SPLIT_PRIMERS", "UNABLE_TO_EXTRACT")
READ_SOURCES = ("R1", "R2", "R1_AND_R2", "INTERLEAVED", "UNKNOWN")
ACTIONS = ("NONE", "MANUAL_PRIMERS_REQUIRED", "READ_MERGING_RECOMMENDED")
ORIENTATIONS = ("FORWARD", "REVERSE", "MIXED")
STATUSES = ("HIGH", "MEDIUM", "LOW", "UNABLE_TO_INFER")
UNABLE = "UNABLE_TO_EXTRACT"
NEEDS = {"BOTH_PRIMERS_SINGLE_READ": ("primer_5p", "primer_3p"), "FIVE_PRIME_ONLY": ("primer_5p",), "THREE_PRIME_ONLY": ("primer_3p",), "PAIRED_END_SPLIT_PRIMERS": ("primer_5p", "primer_3p")}


@dataclass(frozen=True)
class LibraryReport:
    """What was inferred about a library, in the order in which it is written."""

    primer_5p: str | None = None
    primer_3p: str | None = None
    variants_5p: list = field(default_factory=list)
    variants_3p: list = field(default_factory=list)
    known_adapter_hits: dict = field(default_factory=dict)
    extraction_mode: str = UNABLE
    full_insert_recovered: bool = False
    read_source: str = "R1"
    required_action: str = "MANUAL_PRIMERS_REQUIRED"
    orientation: str = "FORWARD"
    n_length_mode: int | None = None
    n_length_distribution: dict = field(default_factory=dict)
    n_length_confidence: float = 0.0
    match_rate_5p: float = 0.0
    match_rate_3p: float = 0.0
    position_consistency_5p: float = 0.0
    position_consistency_3p: float = 0.0
    read_fraction_used_for_inference: float = 0.0
    sampling_seed: int = 42
    confidence: float = 0.0
    status: str = "UNABLE_TO_INFER"
    failure_reason: str | None = None

    def __post_init__(self):
        closed = {"extraction_mode": MODES, "read_source": READ_SOURCES, "required_action": ACTIONS, "orientation": ORIENTATIONS, "status": STATUSES}
        for name, allowed in closed.items():
            if getattr(self, name) not in allowed:
                raise ValueError(f"`{name}` contains an unsupported value.")
        for name in ("primer_5p", "primer_3p", "failure_reason"):
            if not isinstance(getattr(self, name), str | None):
                raise ValueError(f"`{name}` must be None or one string.")
        if not isinstance(self.full_insert_recovered, bool):
            raise ValueError("`full_insert_recovered` must be true or false.")
        for name in RATES:
            if not isinstance(getattr(self, name), int | float):
                raise ValueError(f"`{name}` must be a number.")

    def payload(self) -> dict:
        """The record with its maps in their written order."""
        out = asdict(self)
        out["n_length_distribution"] = {k: int(v) for k, v in sorted(out["n_length_distribution"].items(), key=lambda x: float(x[0]))}
        out["known_adapter_hits"] = {k: int(v) for k, v in sorted(out["known_adapter_hits"].items())}
        for name in ("variants_5p", "variants_3p"):
            out[name] = [[s, int(n)] for s, n in out[name]]
        return out | {name: float(out[name]) for name in RATES}


FIELDS = tuple(f.name for f in fields(LibraryReport))
RATES = ("n_length_confidence", "match_rate_5p", "match_rate_3p", "position_consistency_5p", "position_consistency_3p", "read_fraction_used_for_inference", "confidence")


def write_text(text: str, path: str) -> str:
    """Write UTF-8 with line feeds only; the SHA-256 of the bytes."""
    data = text.encode()
    with open(path, "wb") as f:
        f.write(data)
    return hashlib.sha256(data).hexdigest()


def to_json(payload: dict) -> str:
    return json.dumps(payload, indent=2, ensure_ascii=False) + "\n"


def write_report(report: LibraryReport, path: str) -> str:
    return write_text(to_json(report.payload()), path)


def report_from(payload: dict) -> LibraryReport:
    if tuple(payload) != FIELDS:
        raise ValueError("The file does not hold the fields of a library report.")
    return LibraryReport(**payload)


def read_report(path: str) -> LibraryReport:
    with open(path, encoding="utf-8") as f:
        return report_from(json.load(f))


def corrected(report: LibraryReport, primer_5p: str | None = None, primer_3p: str | None = None, extraction_mode: str | None = None) -> LibraryReport:
    """A report with reviewed primers or mode in place; it stands as LOW with no confidence, rates stay."""
    if primer_5p is None and primer_3p is None and extraction_mode is None:
        return report
    change: dict = {}
    for side, primer in (("5p", primer_5p), ("3p", primer_3p)):
        if primer is not None:
            if not isinstance(primer, str) or not re.fullmatch("[ACGTUacgtu]+", primer):
                raise ValueError(f"`primer_{side}` must be one non-empty DNA or RNA sequence.")
            change |= {f"primer_{side}": primer.upper(), f"variants_{side}": []}
    report = replace(report, **change)
    mode = extraction_mode or report.extraction_mode
    if extraction_mode is None and mode == UNABLE:
        have = tuple(name for name in ("primer_5p", "primer_3p") if getattr(report, name))
        mode = next((m for m in MODES[:3] if NEEDS[m] == have), UNABLE)
    if mode not in NEEDS:
        raise ValueError("`extraction_mode` must name an extractable mode.")
    if any(getattr(report, name) is None for name in NEEDS[mode]):
        raise ValueError("The selected extraction mode requires additional primers.")
    action = "READ_MERGING_RECOMMENDED" if mode == "PAIRED_END_SPLIT_PRIMERS" else "NONE"
    return replace(report, extraction_mode=mode, full_insert_recovered=mode == "BOTH_PRIMERS_SINGLE_READ", required_action=action, status="LOW", confidence=0.0, failure_reason=None)
