"""Selection rounds from run metadata, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What counts as a round indicator in text, in the order in which it is tried.
_BEFORE, _AFTER = r"(?<![^\s_\-./])", r"(?=[\s_\-./]|$)"
PATTERNS = {
    "round_word_digit": rf"{_BEFORE}[Rr]ound[\s_\-]*(\d+){_AFTER}",
    "cycle_word_digit": rf"{_BEFORE}[Cc]ycle[\s_\-]*(\d+){_AFTER}",
    "iteration_digit": rf"{_BEFORE}[Ii]teration[\s_\-]*(\d+){_AFTER}",
    "pool_digit": rf"{_BEFORE}[Pp]ool[\s_\-]*(\d+){_AFTER}",
    "r_digit_boundary": rf"{_BEFORE}[Rr](\d+){_AFTER}",
    "c_digit_boundary": rf"{_BEFORE}[Cc](\d+){_AFTER}",
    "digit_r_suffix": rf"{_BEFORE}(\d+)[Rr]{_AFTER}",
    "glued_word_r_digit": rf"[A-Z][A-Za-z]{{2,}}R(\d+){_AFTER}",
    "digit_cyc_suffix": rf"(?i){_BEFORE}(\d+)[\s_\-]*cyc(?:les?)?{_AFTER}",
}
ROUND_WORDS = ("round", "cycle", "iteration", "r")
OTHER_WORDS = ("selex", "selection", "enrichment", "of", "number", "num", "no", "pcr")
VALUE = r"(?i)^(?:(?:round|cycle|r|c)[\s_\-]*)?(\d+)$"
HINT = r"^([A-Z][A-Za-z0-9_-]+)[\s_-]+(?:[Rr]ound|[Rr]\d|[Cc]ycle)"
TEXTS = (("sample_title", "HIGH"), ("library_name", "MEDIUM"), ("experiment_title", "MEDIUM"), ("design_description", "MEDIUM"))

RESULT = "struct<round_number:int,confidence:string,source_field:string,matched_pattern:string,round_candidates:array<int>,parser_notes:string>"

NAMES = ("round_number", "confidence", "source_field", "matched_pattern", "round_candidates", "parser_notes")


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def key_confidence(key: Column) -> Column:
    """HIGH or MEDIUM if an attribute's key names a round, else null."""
    k = F.regexp_replace(trimmed(F.lower(key)), r"^characteristics?\s*\[(.*)\]$", "$1")
    words = F.filter(F.split(F.regexp_replace(trimmed(k), r"[\s\-]+", "_"), "_"), lambda w: w != "")
    others = F.filter(words, lambda w: ~w.isin(*ROUND_WORDS))
    good = (F.size(words) - F.size(others) == 1) & F.forall(others, lambda w: w.isin(*OTHER_WORDS))
    return F.when(good, F.when(F.array_contains(others, "pcr"), "MEDIUM").otherwise("HIGH"))


def attribute_value(value: Column) -> Column:
    """The round that an attribute's value names, or null."""
    return F.regexp_extract(trimmed(value), VALUE, 1).try_cast("int")


def matches(text: Column) -> Column:
    """All (pattern, value) found in a text: by pattern, then by place."""

    def named(name: str):
        return lambda v: F.struct(F.lit(name).alias("pattern"), v.try_cast("int").alias("value"))

    each = [F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), named(name)) for name, p in PATTERNS.items()]
    found = F.filter(F.concat(*each), lambda m: m["value"].isNotNull())
    return F.when(text.isNull() | (trimmed(text) == ""), F.slice(found, 1, 0)).otherwise(found)


def _values(found: Column) -> Column:
    return F.array_distinct(F.transform(found, lambda m: m["value"]))


def _joined(values: Column, by: str) -> Column:
    return F.array_join(values.cast("array<string>"), by)


def target_hint(title: Column) -> Column:
    return F.nullif(F.regexp_extract(trimmed(title), HINT, 1), F.lit(""))


def _record(number, confidence, source, pattern, candidates, notes) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(number.cast("int"), lit(confidence), lit(source), lit(pattern), candidates.cast("array<int>"), lit(notes)).cast(RESULT)


def _text_record(text: Column, name: str, confidence: str) -> Column:
    found = matches(text)
    values, patterns = _values(found), F.array_distinct(F.transform(found, lambda m: m["pattern"]))
    one = F.size(values) == 1
    short = F.substring(text, 1, 120)
    notes = F.when(one, F.concat(F.lit("matched '"), patterns[0], F.lit(f"' in {name}: '"), short, F.lit("'"))).otherwise(
        F.concat(F.lit("conflicting candidates "), _joined(values, ","), F.lit(" from patterns "), F.array_join(patterns, ","), F.lit(f" in {name}: '"), short, F.lit("'"))
    )
    return F.when(F.size(values) > 0, _record(values[0], F.when(one, confidence).otherwise("MEDIUM"), name, patterns[0], values, notes))


def infer_rounds(runs: DataFrame, overrides: dict[str, int] | None = None) -> DataFrame:
    """One row for each run: round, confidence, source, pattern, candidates, notes and target.

    ``sample_attributes`` is a map, or an array of (key, value) where their order
    matters for conflicting rounds. A reviewed mapping comes first, then structured attributes, then the first text
    field with any indicator. Several candidates are all listed and make it unsafe.
    """
    if "run_accession" not in runs.columns:
        raise ValueError("`runs` must contain a `run_accession` column.")
    overrides = overrides or {}
    if any(not k or not isinstance(v, int) or v < 0 for k, v in overrides.items()):
        raise ValueError("`overrides` must map accessions to non-negative integers.")
    have = lambda n, d: F.coalesce(F.col(n), d) if n in runs.columns else d
    texts = {name: have(name, F.lit("")) for name, _ in TEXTS}
    attributes = have("sample_attributes", F.lit(None).cast("map<string,string>")) if "sample_attributes" not in runs.columns else F.col("sample_attributes")
    ordered = "sample_attributes" in runs.columns and runs.schema["sample_attributes"].dataType.typeName() == "array"
    pairs = F.col("sample_attributes") if ordered else F.map_entries(attributes)
    entries = F.transform(pairs, lambda e: F.struct(e["key"].alias("key"), key_confidence(e["key"]).alias("level"), attribute_value(e["value"]).alias("value")))
    entries = F.filter(F.coalesce(entries, F.array().cast("array<struct<key:string,level:string,value:int>>")), lambda e: e["level"].isNotNull() & e["value"].isNotNull())
    base = runs.select("run_accession", *[t.alias(f"_{n}") for n, t in texts.items()], entries.alias("_entries"))
    strong, weak = F.filter("_entries", lambda e: e["level"] == "HIGH"), F.filter("_entries", lambda e: e["level"] == "MEDIUM")
    base = base.withColumns({"_strong": strong, "_weak": weak}).withColumns({"_s": _values(F.col("_strong")), "_w": _values(F.col("_weak"))})
    text = F.coalesce(*[_text_record(F.col(f"_{n}"), n, c) for n, c in TEXTS])
    base = base.select("*", F.inline(F.array(F.struct(text.alias("_text")))))
    listed = F.array_join(F.transform(F.concat("_strong", "_weak"), lambda e: F.concat(e["key"], F.lit("='"), e["value"].cast("string"), F.lit("'"))), "; ")
    rounds = F.when(F.size("_s") > 0, F.col("_s")).otherwise(F.col("_w"))
    notes = F.concat(F.lit("structured attribute "), listed)
    notes = F.concat(
        notes,
        F.when(F.size("_s") == 0, "; the key can also mean amplification cycles, read as the round")
        .when((F.size("_w") > 0) & (F.col("_w") != rounds), F.concat(F.lit("; ambiguous attribute reads as round ["), _joined(F.col("_w"), ", "), F.lit("], not used")))
        .otherwise(""),
    )

    def aside(name: str) -> Column:
        other = _values(matches(F.col(f"_{name}")))
        said = F.concat(F.lit(f"; {name} reads as round ["), _joined(other, ", "), F.lit("] ('"), F.substring(F.col(f"_{name}"), 1, 60), F.lit("'), the attribute is kept"))
        return F.when((F.size(other) > 0) & (other != F.slice(rounds, 1, 1)), said).otherwise("")

    notes = reduce(lambda a, n: F.concat(a, aside(n)), [n for n, _ in TEXTS], notes)
    conflict = _record(F.col("_s")[0], "MEDIUM", "sample_attributes", "structured_attr", F.col("_s"), F.concat(F.lit("conflicting round attributes ["), _joined(F.col("_s"), ", "), F.lit("]: "), listed))
    structured = _record(rounds[0], F.when(F.size("_s") > 0, "HIGH").otherwise("MEDIUM"), "sample_attributes", "structured_attr", rounds, notes)
    unused = F.when((F.size("_w") > 0) & (F.col("_w") != F.array(F.col("_text.round_number"))), F.concat(F.lit("; ambiguous attribute "), listed, F.lit(" not used over the text field"))).otherwise("")
    from_text = F.col("_text").withField("parser_notes", F.concat(F.col("_text.parser_notes"), unused)).cast(RESULT)
    none = _record(F.lit(None), "NONE", "none", "none", F.array(), "no round indicator found in supplied metadata fields")
    chosen = (
        F.when(F.size("_s") > 1, conflict)
        .when((F.size("_s") > 0) | ((F.size("_w") > 0) & F.col("_text").isNull()), structured)
        .when(F.col("_text").isNotNull(), from_text)
        .otherwise(none)
    )
    if overrides:
        given = F.element_at(F.create_map(*[F.lit(x) for kv in overrides.items() for x in kv]), F.col("run_accession"))
        by_hand = _record(given, "HIGH", "seed_override", "manual", F.array(given), F.concat(F.lit("overridden by supplied mapping: round="), given.cast("string")))
        chosen = F.when(given.isNotNull(), by_hand).otherwise(chosen)
    # inline() keeps later filters and columns from copying the whole decision into themselves
    hint = target_hint(F.col("_sample_title")).alias("target_hint")
    return base.select("run_accession", hint, F.inline(F.array(chosen))).select("run_accession", *NAMES, "target_hint")


def is_safe() -> Column:
    """One round and no other candidate."""
    return F.col("round_number").isNotNull() & (F.size("round_candidates") == 1)


def rounds_with_several_samples(runs: DataFrame, assignments: DataFrame) -> DataFrame:
    """Safe rounds whose runs come from more than one sample, with those runs."""
    sample = F.coalesce(F.nullif(F.col("sample_accession"), F.lit("")), F.col("run_accession")) if "sample_accession" in runs.columns else F.col("run_accession")
    both = runs.select("run_accession", sample.alias("sample")).join(assignments.filter(is_safe()).select("run_accession", "round_number"), "run_accession")
    per = both.groupBy("round_number").agg(F.count_distinct("sample").alias("n_samples"), F.sort_array(F.collect_list("run_accession")).alias("runs"))
    return per.filter("n_samples > 1")
