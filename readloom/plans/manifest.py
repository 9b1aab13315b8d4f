"""The record of a run: inputs, outputs, decisions and versions, as ordered JSON."""

from __future__ import annotations

import json
import platform
import re

from .. import __version__
from ..sources.fastq import hash_paths
from .report import LibraryReport, report_from, to_json, write_text

#: Names and order of the fields.
VERSION = "readloom_manifest_v2"
_COMMON = "accession bioproject_id runs input_sha256 output_sha256 library_report extraction_mode read_source required_action full_insert_recovered parameters runtime_seconds_per_stage flags sampling_seed".split()
MAPS = ("input_sha256", "output_sha256", "parameters", "runtime_seconds_per_stage")
#: Runtime versions between the engine's own version and the accession, by manifest layout. The second layout's two
#: describe the language and the distribution; ours writes Python and Spark there.
_RUNTIMES = {1: ["python_version", "cutadapt_version", "dnaio_version", "pyarrow_version"], 2: None}


def _checked(payload: dict) -> dict:
    """Validate field order, types and agreement with the embedded report; both layouts can be read."""
    m = re.fullmatch(r"(\w+)_manifest_v([12])", str(payload.get("manifest_version")))
    if m is None:
        raise ValueError("Unsupported manifest version.")
    names = list(payload)
    runtimes = names[2 : len(names) - len(_COMMON)]
    expected = _RUNTIMES[int(m[2])]
    if names[:2] != ["manifest_version", f"{m[1]}_version"] or names[2 + len(runtimes) :] != _COMMON or (runtimes != expected if expected else len(runtimes) != 2):
        raise ValueError("The manifest does not contain the stable field set for its version.")
    report = report_from(payload["library_report"])
    for name in ("extraction_mode", "read_source", "required_action", "full_insert_recovered", "sampling_seed"):
        if payload[name] != getattr(report, name):
            raise ValueError(f"`{name}` must agree with `library_report`.")
    for name in MAPS:
        if not isinstance(payload[name], dict):
            raise ValueError(f"`{name}` must be a mapping.")
    for name in ("accession", "bioproject_id"):
        if not isinstance(payload[name], str | None):
            raise ValueError(f"`{name}` must be None or one string.")
    for name in ("runs", "flags"):
        value = payload[name]
        payload[name] = [] if value is None else [value] if isinstance(value, str) else list(value)
    return payload


def build(
    report: LibraryReport, input_paths: list[str] = (), output_paths: list[str] = (), accession: str | None = None, bioproject_id: str | None = None, runs: list[str] = (), parameters: dict | None = None,
    runtime_seconds_per_stage: dict | None = None, flags: list[str] = (), input_root: str | None = None, output_root: str | None = None,
) -> dict:
    import pyspark

    return _checked(
        {
            "manifest_version": VERSION,
            "readloom_version": __version__,
            "python_version": platform.python_version(),
            "spark_version": pyspark.__version__,
            "accession": accession,
            "bioproject_id": bioproject_id,
            "runs": list(runs),
            "input_sha256": hash_paths(list(input_paths), input_root),
            "output_sha256": hash_paths(list(output_paths), output_root),
            "library_report": report.payload(),
            "extraction_mode": report.extraction_mode,
            "read_source": report.read_source,
            "required_action": report.required_action,
            "full_insert_recovered": report.full_insert_recovered,
            "parameters": {k: str(v) for k, v in (parameters or {}).items()},
            "runtime_seconds_per_stage": dict(runtime_seconds_per_stage or {}),
            "flags": list(flags),
            "sampling_seed": report.sampling_seed,
        }
    )


def write(manifest: dict, path: str) -> str:
    """Write with sorted maps; the SHA-256 of the bytes."""
    return write_text(to_json({k: dict(sorted(v.items())) if k in MAPS else v for k, v in _checked(dict(manifest)).items()}), path)


def read(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return _checked(json.load(f))
