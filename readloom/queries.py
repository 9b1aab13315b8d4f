"""The registered queries of the read-processing operators and their SQL.

The driver's tables hold no sequencing reads, so reads are derived from whole
``events`` by one rule, written once and used on both sides.
"""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import sequences as S
from .plans.report import LibraryReport
from .operators import catalog, counting, demultiplex, detection, extraction, quality, rounds
from .sources import archive, counts_io, fastq

P5, P3 = "GGTAATACGACTCACTATAGGG", "CCATGCATGCATGCATGCAT"
ROUNDS = ["round_00", "round_01", "round_02"]
CODES = {"AAAAA": 0, "TTTTT": 1, "CCCCC": 2}

#: Reads of three rounds, ever less diverse: one in ten with a mismatch in the 5' primer, one in 33 from an adapter, one
#: in nine from the other strand, one in 50 with an odd letter, one in 200 without primers. STRING is a type of both engines.
_INSERT = "translate(substr(md5(CAST(user_id % (CASE event_id % 3 WHEN 0 THEN 97 WHEN 1 THEN 31 ELSE 7 END) AS STRING)), 1, CASE WHEN event_id % 11 = 0 THEN 18 ELSE 20 END), '0123456789abcdef', 'ACGTACGTACGTACGT')"
_FORWARD = f"concat(CASE WHEN event_id % 10 = 0 THEN 'GGTAATTCGACTCACTATAGGG' ELSE '{P5}' END, {_INSERT}, CASE WHEN event_id % 50 = 7 THEN 'X' ELSE '' END, CASE WHEN event_id % 33 = 5 THEN 'AGATCGGAAGAGC' ELSE '' END, '{P3}')"
READS = f"""
SELECT concat('round_0', CAST(event_id % 3 AS STRING)) AS round, 'R1' AS mate, CAST(event_id % 2 AS INTEGER) AS file_index, event_id AS read_index,
       CASE WHEN event_id % 200 = 13 THEN {_INSERT}
            WHEN event_id % 9 = 4 THEN reverse(translate({_FORWARD}, 'ACGT', 'TGCA'))
            ELSE {_FORWARD} END AS sequence
FROM events
"""
CODED = f"SELECT event_id AS read_index, 'R1' AS mate, concat(CASE event_id % 5 WHEN 0 THEN 'AAAAA' WHEN 1 THEN 'TTTTT' WHEN 2 THEN 'CCCCC' WHEN 3 THEN 'AAAAT' ELSE 'GGGGG' END, {_INSERT}) AS sequence FROM events"
RUNS = """
SELECT concat('RUN', CAST(p_partkey AS STRING)) AS run_accession,
       concat('S', CAST(p_partkey % 400 AS STRING)) AS sample_accession,
       CASE p_partkey % 6 WHEN 0 THEN concat(p_name, ' Round ', CAST(p_size AS STRING)) WHEN 1 THEN concat(p_name, ' R', CAST(p_size AS STRING)) WHEN 2 THEN concat('round', CAST(p_size AS STRING), ' cycle-', CAST(p_size % 9 AS STRING))
            WHEN 3 THEN concat('SelexR', CAST(p_size AS STRING)) ELSE p_name END AS sample_title,
       CASE WHEN p_partkey % 6 = 4 THEN concat('pool_', CAST(p_size AS STRING), ' x') ELSE p_type END AS library_name
FROM part
"""


def _view(spark: SparkSession, sf_dir: str, sql: str, table: str) -> DataFrame:
    return spark.sql(sql.replace(f"FROM {table}", "FROM {t}"), t=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, READS, "events")


def coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, CODED, "events")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, RUNS, "part")


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads(spark, sf_dir).groupBy("round", "sequence").agg(F.count("*").alias("reads"))


def near_sql(text: str) -> str:
    return "(" + S.near_pattern(text) + ")"


WITH = f"WITH reads AS ({READS}), counts AS (SELECT round, sequence, count(*) AS reads FROM reads GROUP BY ALL), ranked AS (SELECT *, row_number() OVER (PARTITION BY round ORDER BY reads DESC, sequence) AS rank FROM counts) "
REVERSED = "reverse(translate({0}, 'ACGTUNacgtun', 'TGCAANtgcaan'))"
STRAND = f"CASE WHEN length(sequence) >= 22 AND hamming(substr(sequence, 1, 22), '{P5}') <= 1 THEN 'forward' WHEN length(sequence) >= 20 AND hamming(substr(sequence, 1, 20), '{S.reverse_complement_text(P3)}') <= 1 THEN 'reverse' ELSE 'ambiguous' END"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(sql: str | None = None):
    def put(query: Callable[[SparkSession, str], DataFrame]):
        QUERIES[query.__name__] = query
        if sql is not None:
            ORACLE[query.__name__] = sql
        return query

    return put


# counts


@register(WITH + "SELECT round, sequence, reads::DOUBLE AS reads, rank::BIGINT AS rank, round(reads / sum(reads) OVER (PARTITION BY round) * 1e6, 6) AS rpm FROM ranked")
def count_table(spark, sf_dir):
    t = counting.count_sequences(reads(spark, sf_dir))
    return t.select("round", "sequence", "reads", F.col("rank").cast("bigint").alias("rank"), F.round("rpm", 6).alias("rpm"))


@register("SELECT source AS round, text AS sequence, count(*)::DOUBLE AS reads, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, text)::BIGINT AS rank FROM documents GROUP BY source, text")
def count_table_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("source").alias("round"), F.col("text").alias("sequence"))
    return counting.count_sequences(docs).select("round", "sequence", "reads", F.col("rank").cast("bigint").alias("rank"))


@register(WITH + "SELECT sequence, round, reads::BIGINT AS reads FROM counts")
def sparse_counts_long(spark, sf_dir):
    return counting.experiment(counts(spark, sf_dir))


@register(WITH + "SELECT sequence, " + ", ".join(f"sum(CASE WHEN round = '{r}' THEN reads ELSE 0 END)::BIGINT AS {r}" for r in ROUNDS) + " FROM counts GROUP BY sequence")
def sparse_counts_wide(spark, sf_dir):
    return counting.wide(counting.experiment(counts(spark, sf_dir)), ROUNDS)


@register("SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{e}')::BIGINT AS {e}" for e in ("click", "purchase", "view")) + " FROM events GROUP BY user_id")
def sparse_event_matrix(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.groupBy("user_id").pivot("event_type", ["click", "purchase", "view"]).agg(F.count(F.lit(1))).fillna(0)


@register(WITH + "SELECT DISTINCT sequence FROM counts")
def distinct_sequences(spark, sf_dir):
    return counts(spark, sf_dir).select("sequence").distinct()


# scalar functions


@register(WITH + f"SELECT read_index, {REVERSED.format('sequence')} AS out FROM reads")
def reverse_complement(spark, sf_dir):
    return reads(spark, sf_dir).select("read_index", S.reverse_complement("sequence").alias("out"))


@register(WITH + f"SELECT read_index, regexp_replace({REVERSED.format('sequence')}, '[^ACGTNacgtn]', 'N', 'g') AS out FROM reads")
def reverse_complement_read(spark, sf_dir):
    return reads(spark, sf_dir).select("read_index", S.reverse_complement_read("sequence").alias("out"))


@register(WITH + "SELECT read_index, replace(upper(translate(sequence, 'T', 'u')), 'U', 'T') AS out FROM reads")
def normalise_alphabet(spark, sf_dir):
    return reads(spark, sf_dir).select("read_index", S.normalised(F.translate("sequence", "T", "u")).alias("out"))


@register(WITH + f"SELECT read_index, CASE WHEN length(sequence) >= 22 THEN hamming(substr(sequence, 1, 22), '{P5}') <= 1 ELSE false END AS hit FROM reads")
def hamming_prefix(spark, sf_dir):
    return reads(spark, sf_dir).select("read_index", S.near_prefix("sequence", P5).alias("hit"))


@register(WITH + "SELECT read_index, len(list_filter(range(1, length(sequence) + 1), lambda i: substr(sequence, i, 3) = 'ATA'))::BIGINT AS n FROM reads")
def overlapping_occurrences(spark, sf_dir):
    return reads(spark, sf_dir).select("read_index", S.occurrences("sequence", "ATA").cast("bigint").alias("n"))


@register(WITH + f"SELECT kmer, least(kmer, {REVERSED.format('kmer')}) AS canonical, count(*) AS n FROM (SELECT unnest(list_transform(range(1, length(sequence) - 4), lambda i: substr(sequence, i, 6))) AS kmer FROM counts) GROUP BY ALL")
def canonical_kmers(spark, sf_dir):
    each = counts(spark, sf_dir).select(F.explode(S.kmers("sequence", 6)).alias("kmer"))
    return each.groupBy("kmer", S.canonical("kmer").alias("canonical")).agg(F.count("*").alias("n"))


@register(WITH + "SELECT read_index, length(sequence)::BIGINT AS n, round((length(sequence) - length(replace(replace(sequence, 'G', ''), 'C', ''))) / length(sequence), 9) AS gc FROM reads")
def gc_share(spark, sf_dir):
    return reads(spark, sf_dir).select("read_index", F.length("sequence").cast("bigint").alias("n"), F.round(S.gc_share("sequence"), 9).alias("gc"))


# detection


@register(WITH + f"SELECT round, round(avg((regexp_matches(sequence, '{near_sql(P5)}'))::INT), 9) AS rate FROM reads WHERE length(sequence) >= 22 GROUP BY round")
def substring_match_rate(spark, sf_dir):
    hit = S.contains_near(F.col("sequence"), P5).cast("int")
    return reads(spark, sf_dir).filter(F.length("sequence") >= len(P5)).groupBy("round").agg(F.round(F.avg(hit), 9).alias("rate"))


_PLACE = " OR ".join(f"(length(sequence) >= {22 + k} AND hamming(substr(sequence, {k + 1}, 22), '{P5}') <= 1)" for k in range(4))


@register(WITH + f"SELECT round, round(avg(({_PLACE})::INT), 9) AS rate FROM reads WHERE length(sequence) >= 22 GROUP BY round")
def position_consistency(spark, sf_dir):
    hit = detection.at_position(P5, True, F.lit(0), [0]).cast("int")
    return reads(spark, sf_dir).filter(F.length("sequence") >= len(P5)).groupBy("round").agg(F.round(F.avg(hit), 9).alias("rate"))


def _consensus_sql(base: str) -> str:
    return WITH + f"SELECT k::BIGINT AS \"offset\", base, count(*) AS n, min(read_index) AS first FROM (SELECT read_index, unnest(range(0, least(length(sequence), 60))) AS k, {base} AS base FROM reads) WHERE base IS NOT NULL GROUP BY ALL"


@register(_consensus_sql("substr(sequence, k::INT + 1, 1)"))
def positional_consensus_5p(spark, sf_dir):
    c = detection.consensus_counts(reads(spark, sf_dir), True)
    return c.select(F.col("offset").cast("bigint").alias("offset"), "base", "n", "first")


@register(_consensus_sql("substr(reverse(sequence), k::INT + 1, 1)"))
def positional_consensus_3p(spark, sf_dir):
    c = detection.consensus_counts(reads(spark, sf_dir), False)
    return c.select(F.col("offset").cast("bigint").alias("offset"), "base", "n", "first")


@register(WITH + "SELECT v, n, first FROM (SELECT substr(sequence, 1, 22) AS v, count(*) AS n, min(read_index) AS first FROM reads WHERE length(sequence) >= 22 GROUP BY 1) ORDER BY n DESC, first LIMIT 3")
def top_variants(spark, sf_dir):
    return detection.variant_counts(reads(spark, sf_dir), 22, True).orderBy(F.desc("n"), "first").limit(3)


@register(WITH + "SELECT greatest(0, length(sequence) - 42)::BIGINT AS length, count(*) AS n, min(read_index) AS first FROM reads GROUP BY 1")
def insert_length_distribution(spark, sf_dir):
    t = detection.insert_lengths(reads(spark, sf_dir), 42)
    return t.select(F.col("length").cast("bigint").alias("length"), "n", "first")


def _adapter_sql(name: str) -> str:
    a = S.ADAPTERS[name]
    return f"count(*) FILTER (contains(sequence, '{a[:13]}') OR contains(sequence, '{S.reverse_complement_text(a)[:13]}')) AS {name}"


@register(WITH + f"SELECT round, {', '.join(map(_adapter_sql, S.ADAPTERS))} FROM reads GROUP BY round")
def adapter_hits(spark, sf_dir):
    return reads(spark, sf_dir).groupBy("round").agg(*[F.count_if(S.has_adapter(F.col("sequence"), n)).alias(n) for n in S.ADAPTERS])


@register(WITH + f"SELECT {STRAND} AS strand, count(*) AS n FROM reads GROUP BY 1")
def orientation_counts(spark, sf_dir):
    return reads(spark, sf_dir).groupBy(detection.strand(P5, P3).alias("strand")).agg(F.count("*").alias("n"))


@register(WITH + "SELECT read_index, list_filter(range(0, least(length(sequence), 34) - 11), lambda i: substr(sequence, i::INT + 1, 12) = 'CTCACTATAGGG') AS places FROM reads")
def core_places(spark, sf_dir):
    return reads(spark, sf_dir).select("read_index", S.places(F.col("sequence"), P5[-12:], True, 34).cast("array<bigint>").alias("places"))


@register()
def detect_report(spark, sf_dir):
    from .plans.report import to_json

    report = detection.detect(reads(spark, sf_dir))
    return spark.createDataFrame([(report.status, report.extraction_mode, to_json(report.payload()))], "status string, mode string, report string")


@register(WITH + "SELECT round, count(*) AS n FROM (SELECT round, row_number() OVER (PARTITION BY round ORDER BY read_index) AS k FROM reads) WHERE k <= 700 GROUP BY round")
def subsample_exact_n(spark, sf_dir):
    return detection.sampled(reads(spark, sf_dir), 700, 42).groupBy("round").agg(F.count("*").alias("n"))


# extraction

_FIVE = f"strpos(sequence, '{P5}')"
_REST = f"substr(sequence, {_FIVE} + 22)"
_BOTH = f"SELECT round, file_index, read_index, substr({_REST}, 1, strpos({_REST}, '{P3}') - 1) AS sequence FROM reads WHERE {_FIVE} > 0 AND strpos({_REST}, '{P3}') > 0"


@register(WITH + _BOTH.replace("file_index, ", ""))
def extract_exact_both(spark, sf_dir):
    return extraction.trimmed(reads(spark, sf_dir), "BOTH_PRIMERS_SINGLE_READ", P5, P3, approximate=False).select("round", "read_index", "sequence")


@register(WITH + f"SELECT round, read_index, {_REST} AS sequence FROM reads WHERE {_FIVE} > 0")
def extract_five_prime_only(spark, sf_dir):
    return extraction.trimmed(reads(spark, sf_dir), "FIVE_PRIME_ONLY", P5, None, approximate=False).select("round", "read_index", "sequence")


@register(WITH + f"SELECT round, read_index, substr(sequence, 1, strpos(sequence, '{P3}') - 1) AS sequence FROM reads WHERE strpos(sequence, '{P3}') > 0")
def extract_three_prime_only(spark, sf_dir):
    return extraction.trimmed(reads(spark, sf_dir), "THREE_PRIME_ONLY", None, P3, approximate=False).select("round", "read_index", "sequence")


_TWO = f"{REVERSED.format('sequence')}"
_R3 = S.reverse_complement_text(P3)


@register(WITH + f"SELECT round, read_index, {_REST} AS r1, substr({_TWO}, strpos({_TWO}, '{_R3}') + 20) AS r2 FROM reads WHERE {_FIVE} > 0 AND strpos({_TWO}, '{_R3}') > 0")
def extract_paired_split(spark, sf_dir):
    """Mates made by turning each read around; a pair stays if both have their primer."""
    r1 = reads(spark, sf_dir)
    r2 = r1.withColumn("sequence", S.reverse_complement("sequence"))
    left = extraction.trimmed(r1, "FIVE_PRIME_ONLY", P5, None, approximate=False).select("round", "read_index", F.col("sequence").alias("r1"))
    right = extraction.trimmed(r2, "FIVE_PRIME_ONLY", _R3, None, approximate=False).select("round", "read_index", F.col("sequence").alias("r2"))
    return left.join(right, ["round", "read_index"])


_YIELD = "SELECT r.{k}, count(*) AS input_reads, count(e.read_index) AS output_reads, round(count(e.read_index) / count(*), 9) AS fraction_kept FROM reads r LEFT JOIN (" + _BOTH + ") e ON e.read_index = r.read_index GROUP BY r.{k}"


def _yields(spark, sf_dir, key):
    r = reads(spark, sf_dir)
    return extraction.yields(r, extraction.trimmed(r, "BOTH_PRIMERS_SINGLE_READ", P5, P3, approximate=False), key)


@register(WITH + _YIELD.format(k="round"))
def extract_yields(spark, sf_dir):
    return _yields(spark, sf_dir, "round").withColumn("fraction_kept", F.round("fraction_kept", 9))


@register(WITH + _YIELD.format(k="file_index"))
def file_yields(spark, sf_dir):
    return _yields(spark, sf_dir, "file_index").withColumn("fraction_kept", F.round("fraction_kept", 9))


@register("WITH y AS (SELECT event_type AS round, count(*) AS i, count(*) FILTER (event_type = 'view' OR value < 20) AS o FROM events GROUP BY 1) SELECT round, i AS input_reads, o AS output_reads, round(o / i, 9) AS fraction_kept FROM y WHERE o / i < 0.5 OR o / i < 0.5 * (SELECT max(o / i) FROM y)")
def low_yield_rounds(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("round"), "value")
    low = extraction.low_yields(extraction.yields(e, e.filter("round = 'view' or value < 20")))
    return low.select("round", "input_reads", "output_reads", F.round("fraction_kept", 9).alias("fraction_kept"))


@register(WITH + "SELECT round, " + ", ".join(f"count(*) FILTER ({STRAND} = '{k}') AS {k}" for k in ("forward", "reverse", "ambiguous")) + " FROM reads GROUP BY round")
def strand_distribution(spark, sf_dir):
    return extraction.strand_counts(reads(spark, sf_dir), P5, P3)


def _closest(frm: str, text: str, primer: str) -> str:
    """Best approximate place (rid, s, w) of a primer by trying every place: highest score, fewest errors, leftmost, longest."""
    n, k = len(primer), len(primer) // 10
    return f"""SELECT rid, arg_min(struct_pack(s := s, w := w), [e * 2 - least({n}, w), e, s, -w]) AS m FROM (
      SELECT rid, s, w, levenshtein(substr({text}, s::INT, w::INT), '{primer}') AS e
      FROM (SELECT rid, {text}, unnest(range(1, length({text}) + 1)) AS s FROM {frm}) CROSS JOIN (SELECT unnest(range({n - k}, {n + k + 1})) AS w)
      WHERE s + w - 1 <= length({text})) WHERE e <= {k} GROUP BY rid"""


_APPROXIMATE = (
    WITH
    + f""", plain AS (SELECT *, read_index AS rid, replace(upper(sequence), 'U', 'T') AS t FROM reads), rest AS (SELECT * FROM plain WHERE NOT (strpos(t, '{P5}') > 0 AND strpos(substr(t, strpos(t, '{P5}') + 22), '{P3}') > 0)),
 five AS ({_closest("rest", "t", P5)}), cut AS (SELECT rid, round, read_index, substr(sequence, (m.s + m.w)::INT) AS sequence, substr(t, (m.s + m.w)::INT) AS u FROM rest JOIN five USING (rid)),
 three AS ({_closest("cut", "u", P3)}), near AS (SELECT round, read_index, substr(sequence, 1, (m.s - 1)::INT) AS sequence FROM cut JOIN three USING (rid)),
 inserts AS ({_BOTH.replace("file_index, ", "")} UNION ALL SELECT * FROM near) """
)


@register(_APPROXIMATE + "SELECT * FROM inserts")
def extract_approximate(spark, sf_dir):
    return extraction.trimmed(reads(spark, sf_dir), "BOTH_PRIMERS_SINGLE_READ", P5, P3).select("round", "read_index", "sequence")


# demultiplexing

_HITS = "list_filter([" + ", ".join(f"CASE WHEN hamming(substr(sequence, 1, 5), '{b}') <= 1 THEN {r} END" for b, r in CODES.items()) + "], lambda x: x IS NOT NULL)"
_CODED = f"WITH coded AS ({CODED}), a AS (SELECT *, CASE WHEN len({_HITS}) = 1 THEN ({_HITS})[1] END AS r FROM coded) "


@register(_CODED + "SELECT read_index, concat('round_0', r::STRING) AS round, substr(sequence, 6) AS sequence FROM a WHERE r IS NOT NULL")
def demultiplex_assign(spark, sf_dir):
    return demultiplex.demultiplex(coded(spark, sf_dir), CODES).reads.select("read_index", "round", "sequence")


@register(_CODED + "SELECT 'round_0' || k AS round, k::INTEGER AS round_number, count(r) AS assigned_reads, round(count(r) / (SELECT count(*) FROM a), 9) AS assigned_fraction FROM (VALUES (0), (1), (2)) t(k) LEFT JOIN a ON r = k GROUP BY k")
def demultiplex_summary(spark, sf_dir):
    return demultiplex.demultiplex(coded(spark, sf_dir), CODES).summary.withColumn("assigned_fraction", F.round("assigned_fraction", 9))


@register(_CODED + "SELECT read_index, sequence FROM a WHERE r IS NULL")
def demultiplex_unassigned(spark, sf_dir):
    return demultiplex.demultiplex(coded(spark, sf_dir), CODES).unassigned.select("read_index", "sequence")


# quality


@register(WITH + "SELECT round, round(-sum(p * log2(p)), 8) AS shannon_entropy_bits FROM (SELECT round, reads / sum(reads) OVER (PARTITION BY round) AS p FROM counts) GROUP BY round")
def qc_shannon(spark, sf_dir):
    return quality.basics(counts(spark, sf_dir)).select("round", F.round("shannon_entropy_bits", 8).alias("shannon_entropy_bits"))


@register(WITH + "SELECT round, round(sum(CASE WHEN rank <= 1 THEN reads END) / sum(reads), 9) AS top_1_coverage, round(sum(CASE WHEN rank <= 100 THEN reads END) / sum(reads), 9) AS top_100_coverage FROM ranked GROUP BY round")
def qc_top_coverage(spark, sf_dir):
    return quality.basics(counts(spark, sf_dir)).select("round", F.round("top_1_coverage", 9).alias("top_1_coverage"), F.round("top_100_coverage", 9).alias("top_100_coverage"))


@register(WITH + "SELECT round, count(*) AS n_unique, sum(reads)::DOUBLE AS n_reads, round(avg((reads = 1)::INT), 9) AS singleton_fraction FROM counts GROUP BY round")
def qc_singletons(spark, sf_dir):
    return quality.basics(counts(spark, sf_dir)).select("round", "n_unique", "n_reads", F.round("singleton_fraction", 9).alias("singleton_fraction"))


_GC = "(length(sequence) - length(replace(replace(sequence, 'G', ''), 'C', ''))) / length(sequence)"


@register(WITH + f"SELECT g.round, round(any_value(m), 9) AS mean_gc, round(sqrt(sum(reads * (g - m) * (g - m)) / sum(reads)), 8) AS gc_sd FROM (SELECT round, reads, {_GC} AS g FROM counts) g JOIN (SELECT round, sum({_GC} * reads) / sum(reads) AS m FROM counts GROUP BY round) h ON g.round = h.round GROUP BY g.round")
def qc_gc(spark, sf_dir):
    return quality.gc_content(counts(spark, sf_dir)).select("round", F.round("mean_gc", 9).alias("mean_gc"), F.round("gc_sd", 8).alias("gc_sd"))


@register(WITH + "SELECT round, round(sum(CASE WHEN regexp_matches(upper(sequence), '[^ACGTUN]') THEN reads ELSE 0 END) / sum(reads), 9) AS nonstandard_alphabet_fraction FROM counts GROUP BY round")
def qc_bad_alphabet(spark, sf_dir):
    return quality.basics(counts(spark, sf_dir)).select("round", F.round("nonstandard_alphabet_fraction", 9).alias("nonstandard_alphabet_fraction"))


@register(WITH + "SELECT round, round(sum(CASE WHEN contains(upper(sequence), 'AGATCGGAAGAGC') THEN reads ELSE 0 END) / sum(reads), 9) AS truseq_reads_fraction FROM counts GROUP BY round")
def qc_truseq(spark, sf_dir):
    return quality.basics(counts(spark, sf_dir)).select("round", F.round("truseq_reads_fraction", 9).alias("truseq_reads_fraction"))


@register(WITH + "SELECT round, length::DOUBLE AS modal_sequence_length FROM (SELECT *, row_number() OVER (PARTITION BY round ORDER BY n DESC, s) AS k FROM (SELECT round, length(sequence) AS length, sum(reads) AS n, min(sequence) AS s FROM counts GROUP BY ALL)) WHERE k = 1")
def qc_modal_length(spark, sf_dir):
    return quality.modal_length(counts(spark, sf_dir))


_KMERS = "SELECT round, reads, unnest(list_transform(range(1, length(sequence) - 4), lambda i: substr(upper(sequence), i, 6))) AS kmer FROM ranked WHERE rank <= 10000"


@register(WITH + f"SELECT round, round(max(n) / sum(n), 9) AS top_kmer_fraction FROM (SELECT round, kmer, sum(reads) AS n FROM ({_KMERS}) GROUP BY ALL) GROUP BY round")
def qc_top_kmer(spark, sf_dir):
    return quality.top_kmer(counts(spark, sf_dir)).select("round", F.round("top_kmer_fraction", 9).alias("top_kmer_fraction"))


_SETS = WITH + f", sets AS (SELECT DISTINCT round, least(kmer, {REVERSED.format('kmer')}) AS kmer FROM ({_KMERS})), sizes AS (SELECT round, count(*) AS n FROM sets GROUP BY round), both_ AS (SELECT a.round AS f, b.round AS t, count(*) AS same FROM sets a JOIN sets b ON a.kmer = b.kmer AND a.round < b.round GROUP BY ALL), sim AS (SELECT x.round AS from_round, y.round AS to_round, 1 - coalesce(same, 0) / (x.n + y.n - coalesce(same, 0)) AS d FROM sizes x JOIN sizes y ON x.round < y.round LEFT JOIN both_ ON f = x.round AND t = y.round) "


@register(_SETS + "SELECT from_round, to_round, round(d, 9) AS jaccard_distance FROM sim")
def qc_kmer_jaccard(spark, sf_dir):
    return quality.round_similarity(counts(spark, sf_dir), ROUNDS).withColumn("jaccard_distance", F.round("jaccard_distance", 9))


@register(_SETS + "SELECT n.from_round, n.to_round AS neighbour_round, f.to_round AS distant_round, round(n.d, 9) AS near, round(f.d, 9) AS far FROM sim n JOIN sim f ON n.from_round = f.from_round WHERE n.from_round = 'round_00' AND n.to_round = 'round_02' AND f.to_round = 'round_01' AND n.d > f.d * 1.1")
def qc_kmer_monotonicity(spark, sf_dir):
    """The least diverse round taken as the second one: farther from the first than the one after it."""
    order = ["round_00", "round_02", "round_01"]
    found = quality.nonmonotonic(quality.round_similarity(counts(spark, sf_dir), order), order)
    return found.select("from_round", "neighbour_round", "distant_round", F.round("consecutive_distance", 9).alias("near"), F.round("distant_distance", 9).alias("far"))


@register(WITH + "SELECT round, n_unique, n_unique - lag(n_unique) OVER (ORDER BY round) AS change FROM (SELECT round, count(*) AS n_unique FROM counts GROUP BY round)")
def qc_diversity_delta(spark, sf_dir):
    from pyspark.sql import Window

    per = counts(spark, sf_dir).groupBy("round").agg(F.count("*").alias("n_unique"))
    return per.select("round", "n_unique", (F.col("n_unique") - F.lag("n_unique").over(Window.partitionBy(F.lit(0)).orderBy(*S.round_order("round")))).alias("change"))


@register()
def rarefied_unique(spark, sf_dir):
    return quality.rarefied_unique(counts(spark, sf_dir), 1000)[0]


@register(WITH + "SELECT round, least(1000, sum(reads))::BIGINT AS reads, true AS within FROM counts GROUP BY round")
def rarefied_sizes(spark, sf_dir):
    """A sample has the depth's reads, and of no sequence more than there are."""
    c = counts(spark, sf_dir)
    drawn = quality.rarefied(c, 1000).withColumnRenamed("reads", "drawn")
    return drawn.join(c, ["round", "sequence"]).groupBy("round").agg(F.sum("drawn").alias("reads"), F.bool_and(F.col("drawn") <= F.col("reads")).alias("within"))


@register(WITH + "SELECT round, sequence, reads::BIGINT AS reads FROM counts")
def rarefied_whole(spark, sf_dir):
    """Rounds that are shallower than the depth stay whole."""
    return quality.rarefied(counts(spark, sf_dir), 100_000_000)


def _per_round_sql() -> str:
    return f""", base AS (SELECT round, sum(reads)::DOUBLE AS n_reads, count(*) AS n_unique, avg((reads = 1)::INT) AS singleton_fraction, max(reads) / sum(reads) AS top_1_coverage,
      sum(CASE WHEN rank <= 100 THEN reads END) / sum(reads) AS top_100_coverage, sum(CASE WHEN regexp_matches(upper(sequence), '[^ACGTUN]') THEN reads ELSE 0 END) / sum(reads) AS nonstandard_alphabet_fraction,
      sum(CASE WHEN contains(upper(sequence), 'AGATCGGAAGAGC') THEN reads ELSE 0 END) / sum(reads) AS truseq_reads_fraction FROM ranked GROUP BY round),
     entropy AS (SELECT round, -sum(p * log2(p)) AS shannon_entropy_bits FROM (SELECT round, reads / sum(reads) OVER (PARTITION BY round) AS p FROM counts) GROUP BY round),
     modes AS (SELECT round, length::DOUBLE AS modal_sequence_length FROM (SELECT *, row_number() OVER (PARTITION BY round ORDER BY n DESC, s) AS k FROM (SELECT round, length(sequence) AS length, sum(reads) AS n, min(sequence) AS s FROM counts GROUP BY ALL)) WHERE k = 1),
     gc AS (SELECT g.round, any_value(m) AS mean_gc, sqrt(sum(reads * (g - m) * (g - m)) / sum(reads)) AS gc_sd FROM (SELECT round, reads, {_GC} AS g FROM counts) g JOIN (SELECT round, sum({_GC} * reads) / sum(reads) AS m FROM counts GROUP BY round) h ON g.round = h.round GROUP BY g.round),
     kmer AS (SELECT round, max(n) / sum(n) AS top_kmer_fraction FROM (SELECT round, kmer, sum(reads) AS n FROM ({_KMERS}) GROUP BY ALL) GROUP BY round),
     metrics AS (SELECT *, n_unique AS rarefied_unique FROM base JOIN entropy USING (round) JOIN modes USING (round) JOIN gc USING (round) JOIN kmer USING (round)) """


_METRICS = "n_reads shannon_entropy_bits singleton_fraction top_1_coverage top_100_coverage modal_sequence_length mean_gc gc_sd nonstandard_alphabet_fraction truseq_reads_fraction top_kmer_fraction".split()


@register(WITH + _per_round_sql() + "SELECT round, n_unique, rarefied_unique, " + ", ".join(f"round({c}, 8) AS {c}" for c in _METRICS) + " FROM metrics")
def qc_per_round(spark, sf_dir):
    """All metrics; at a depth beyond every round the rarefied count is that of all sequences."""
    found = quality.per_round(counts(spark, sf_dir), 100_000_000)
    return found.select("round", "n_unique", "rarefied_unique", *[F.round(c, 8).alias(c) for c in _METRICS])


#: Rounds in an order in which the least diverse one comes between, so that flags on order have something to find.
_TURNED = "CASE round WHEN 'round_00' THEN 'round_00' WHEN 'round_01' THEN 'round_02' ELSE 'round_01' END"
_TURNED_WITH = f"WITH reads AS ({READS}), counts AS (SELECT {_TURNED} AS round, sequence, count(*) AS reads FROM reads GROUP BY ALL), ranked AS (SELECT *, row_number() OVER (PARTITION BY round ORDER BY reads DESC, sequence) AS rank FROM counts) "
_FLAGS = f"""{_TURNED_WITH} {_per_round_sql()}, strands AS (SELECT {_TURNED} AS round, avg(({STRAND} = 'reverse')::INT) AS share FROM reads GROUP BY 1),
 steps AS (SELECT *, lag(rarefied_unique) OVER (ORDER BY round) AS was FROM metrics), limits AS (SELECT median(n_reads) AS least FROM metrics),
 flags AS (
  SELECT 'low_total_reads' AS name, count(*) AS rounds FROM metrics, limits WHERE n_reads < least
  UNION ALL SELECT 'unexpected_rarefied_diversity_increase', count(*) FROM steps WHERE rarefied_unique > was
  UNION ALL SELECT 'nonstandard_alphabet', count(*) FROM metrics WHERE nonstandard_alphabet_fraction > 0.001
  UNION ALL SELECT 'truseq_residual', count(*) FROM metrics WHERE truseq_reads_fraction > 0.01
  UNION ALL SELECT 'strand_mix', count(*) FROM strands WHERE share > 0.2
  UNION ALL SELECT 'low_primer_match', 1 UNION ALL SELECT 'requires_read_merging_for_full_insert', 1 UNION ALL SELECT 'adapter_contamination_high', 1)"""


def _turned(spark, sf_dir):
    return reads(spark, sf_dir).withColumn("round", F.expr(_TURNED))


@register(_FLAGS + "SELECT name, CASE WHEN name LIKE 'requires%' THEN 'info' ELSE 'warn' END AS severity, rounds FROM flags WHERE rounds > 0")
def qc_flags(spark, sf_dir):
    """Every flag on data, and those on a report that says the worst, by the number of rounds they name."""
    r = _turned(spark, sf_dir)
    c = r.groupBy("round", "sequence").agg(F.count("*").alias("reads"))
    totals = {x["round"]: x["n"] for x in r.groupBy("round").agg(F.count("*").alias("n")).collect()}
    worst = LibraryReport(primer_5p=P5, primer_3p=P3, extraction_mode="PAIRED_END_SPLIT_PRIMERS", required_action="READ_MERGING_RECOMMENDED", status="LOW", match_rate_5p=0.2, match_rate_3p=0.9, known_adapter_hits={"TRUSEQ_R1": 10**9}, read_fraction_used_for_inference=1.0)
    least = sorted(totals.values())[len(totals) // 2]
    found = quality.qc(c, ROUNDS, worst, low_total_reads=least, rarefaction_depth=100_000_000, input_reads=totals, strands=extraction.strand_counts(r, P5, P3))
    size = {"unexpected_rarefied_diversity_increase": "increases", "strand_mix": "rounds_above_threshold"}
    rows = [(n, sev, len(e[size.get(n, "rounds")]) if size.get(n, "rounds") in e else 1) for n, sev, e in found.flags if n not in ("round_kmer_nonmonotonic", "n_length_variation_across_rounds")]
    return spark.createDataFrame(rows, "name string, severity string, rounds bigint")


@register(WITH + ", l AS (SELECT round, length(sequence) AS length, sum(reads) AS n FROM counts GROUP BY ALL) SELECT r.round, x.length::BIGINT AS length, round(coalesce(n, 0) / (SELECT sum(n) FROM l WHERE l.round = r.round), 9) AS fraction FROM (SELECT DISTINCT round FROM l) r CROSS JOIN (SELECT DISTINCT length FROM l) x LEFT JOIN l ON l.round = r.round AND l.length = x.length")
def plot_length_distribution(spark, sf_dir):
    t = quality.length_distribution(counts(spark, sf_dir))
    return t.select("round", F.col("length").cast("bigint").alias("length"), F.round("fraction", 9).alias("fraction"))


@register(WITH + _YIELD.format(k="round").replace(", round(count(e.read_index) / count(*), 9) AS fraction_kept", ""))
def plot_retention(spark, sf_dir):
    return quality.retention(_yields(spark, sf_dir, "round"))


# metadata

_SEPARATED = "(SELECT *, regexp_replace(' ' || sample_title || ' ', '([\\s_\\-./])', '\\1\\1', 'g') AS t, regexp_replace(' ' || library_name || ' ', '([\\s_\\-./])', '\\1\\1', 'g') AS l FROM runs)"
_B, _A = r"[\s_\-./]", r"[\s_\-./]"
_RE2 = [rf"{_B}[Rr]ound[\s_\-]*(\d+){_A}", rf"{_B}[Cc]ycle[\s_\-]*(\d+){_A}", rf"{_B}[Ii]teration[\s_\-]*(\d+){_A}", rf"{_B}[Pp]ool[\s_\-]*(\d+){_A}", rf"{_B}[Rr](\d+){_A}", rf"{_B}[Cc](\d+){_A}", rf"{_B}(\d+)[Rr]{_A}", rf"[A-Z][A-Za-z]{{2,}}R(\d+){_A}", rf"(?i){_B}(\d+)[\s_\-]*cyc(?:les?)?{_A}"]


def _found(column: str) -> str:
    each = " || ".join(f"regexp_extract_all({column}, '{p}', 1)" for p in _RE2)
    return f"list_transform({each}, lambda v: v::INTEGER)"


@register(f"WITH runs AS ({RUNS}), f AS (SELECT run_accession, {_found('t')} AS a, {_found('l')} AS b FROM {_SEPARATED}) SELECT run_accession, CASE WHEN len(a) > 0 THEN a[1] WHEN len(b) > 0 THEN b[1] END AS round_number, CASE WHEN len(a) > 0 THEN CASE WHEN len(list_distinct(a)) = 1 THEN 'HIGH' ELSE 'MEDIUM' END WHEN len(b) > 0 THEN 'MEDIUM' ELSE 'NONE' END AS confidence, CASE WHEN len(a) > 0 THEN 'sample_title' WHEN len(b) > 0 THEN 'library_name' ELSE 'none' END AS source_field, (CASE WHEN len(a) > 0 THEN len(list_distinct(a)) WHEN len(b) > 0 THEN len(list_distinct(b)) ELSE 0 END)::BIGINT AS candidates FROM f")
def round_inference(spark, sf_dir):
    found = rounds.infer_rounds(runs(spark, sf_dir))
    return found.select("run_accession", "round_number", "confidence", "source_field", F.size("round_candidates").cast("bigint").alias("candidates"))


@register("SELECT key, CASE WHEN key = 'selex_round' OR key = 'Round' OR key = 'Characteristics [selection cycle]' THEN 'HIGH' WHEN key = 'pcr cycle' THEN 'MEDIUM' END AS level, count(*) AS n FROM (SELECT CASE event_id % 6 WHEN 0 THEN 'selex_round' WHEN 1 THEN 'Round' WHEN 2 THEN 'Characteristics [selection cycle]' WHEN 3 THEN 'pcr cycle' WHEN 4 THEN 'round cycle' ELSE event_type END AS key FROM events) GROUP BY ALL")
def attribute_key_confidence(spark, sf_dir):
    sql = "SELECT CASE event_id % 6 WHEN 0 THEN 'selex_round' WHEN 1 THEN 'Round' WHEN 2 THEN 'Characteristics [selection cycle]' WHEN 3 THEN 'pcr cycle' WHEN 4 THEN 'round cycle' ELSE event_type END AS key FROM events"
    return _view(spark, sf_dir, sql, "events").groupBy("key", rounds.key_confidence(F.col("key")).alias("level")).agg(F.count("*").alias("n"))


FILES = "SELECT concat('RUN', CAST(p_partkey AS STRING)) AS run_accession, concat('ftp://host/', p_brand, '/', CAST(p_partkey AS STRING), '_1.fq.gz?x=1;host/', CAST(p_partkey AS STRING), '_2.fq.gz') AS fastq_ftp, md5(p_name) AS fastq_md5 FROM part"


@register(f"WITH f AS ({FILES}), e AS (SELECT run_accession, fastq_md5, unnest(string_split(fastq_ftp, ';')) AS u, unnest([1, 2]) AS k FROM f) SELECT run_accession, parse_filename(regexp_replace(u, '\\?.*$', '')) AS file_name, 'https://' || regexp_replace(u, '^ftp://', '') AS url, CASE WHEN k = 1 THEN fastq_md5 END AS expected_md5 FROM e")
def fetch_plan_explode(spark, sf_dir):
    f = _view(spark, sf_dir, FILES, "part")
    table = f.select("run_accession", archive.parts(F.col("fastq_ftp")).alias("fastq_urls"), archive.parts(F.col("fastq_md5")).alias("fastq_md5"), F.array().cast("array<double>").alias("fastq_bytes"))
    return archive.plan_rows(table, rounds.infer_rounds(table)).select("run_accession", "file_name", "url", "expected_md5")


@register(f"WITH runs AS ({RUNS}), f AS (SELECT run_accession, sample_accession, {_found('t')} AS a, {_found('l')} AS b FROM {_SEPARATED}), s AS (SELECT *, CASE WHEN len(list_distinct(a)) = 1 THEN a[1] WHEN len(a) = 0 AND len(list_distinct(b)) = 1 THEN b[1] END AS r FROM f) SELECT r AS round_number, count(DISTINCT sample_accession) AS n_samples, count(*) AS n_runs FROM s WHERE r IS NOT NULL GROUP BY r HAVING count(DISTINCT sample_accession) > 1")
def rounds_with_several_samples(spark, sf_dir):
    r = runs(spark, sf_dir)
    return rounds.rounds_with_several_samples(r, rounds.infer_rounds(r)).select("round_number", "n_samples", F.size("runs").cast("bigint").alias("n_runs"))


@register("SELECT p_partkey, p_name FROM part WHERE contains(lower(concat_ws(' ', p_brand, p_name, p_type)), 'brand#1')")
def catalog_search(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return catalog.search(part, "BRAND#1", ("p_brand", "p_name", "p_type")).select("p_partkey", "p_name")


@register("SELECT page_id, url FROM pages WHERE contains(lower(url), '.example.org/en')")
def catalog_search_pages(spark, sf_dir):
    return catalog.search(spark.read.parquet(f"{sf_dir}/pages.parquet"), ".example.ORG/en", ("url",)).select("page_id", "url")


@register(_APPROXIMATE + ", c AS (SELECT round, sequence, count(*)::DOUBLE AS reads FROM inserts GROUP BY ALL) SELECT round, sequence, reads, row_number() OVER (PARTITION BY round ORDER BY reads DESC, sequence)::INTEGER AS rank, round(reads / sum(reads) OVER (PARTITION BY round) * 1e6, 6) AS rpm FROM c")
def run_pipeline(spark, sf_dir):
    import warnings

    from .plans.pipeline import run

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return run(reads(spark, sf_dir), primer_5p=P5, primer_3p=P3, extraction_mode="BOTH_PRIMERS_SINGLE_READ").counts.withColumn("rpm", F.round("rpm", 6))


# pairs: mates are made by turning reads around; each round has two files of each mate

_MATES = f"SELECT round, mate, (CASE WHEN mate = 'R1' THEN 0 ELSE 2 END + file_index)::INTEGER AS file_index, row_number() OVER (PARTITION BY round, mate, file_index ORDER BY event_id) - 1 AS read_index, event_id, CASE WHEN mate = 'R1' THEN sequence ELSE {REVERSED.format('sequence')} END AS sequence FROM (SELECT r.round, m.mate, r.file_index, r.read_index AS event_id, r.sequence FROM reads r CROSS JOIN (VALUES ('R1'), ('R2')) AS m(mate))"


def _mates(spark, sf_dir):
    r1 = reads(spark, sf_dir).withColumnRenamed("read_index", "event_id")
    r2 = r1.withColumns({"mate": F.lit("R2"), "sequence": S.reverse_complement("sequence"), "file_index": F.col("file_index") + 2})
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("round", "mate", "file_index").orderBy("event_id")) - 1
    return fastq.with_pairs(r1.unionByName(r2).withColumn("read_index", place.cast("bigint")))


@register(WITH + f", mates AS ({_MATES}) SELECT a.round, m.mate, a.event_id, CASE WHEN m.mate = 'R1' THEN a.r1 ELSE a.r2 END AS sequence FROM (SELECT round, read_index AS event_id, {_REST} AS r1, substr({_TWO}, strpos({_TWO}, '{_R3}') + 20) AS r2 FROM reads WHERE {_FIVE} > 0 AND strpos({_TWO}, '{_R3}') > 0) a CROSS JOIN (VALUES ('R1'), ('R2')) AS m(mate)")
def extract_pairs(spark, sf_dir):
    """extract() on pairs of files: a pair stays if both mates have their primer."""
    split = LibraryReport(primer_5p=P5, primer_3p=P3, extraction_mode="PAIRED_END_SPLIT_PRIMERS", required_action="READ_MERGING_RECOMMENDED", status="HIGH")
    return extraction.extract(_mates(spark, sf_dir), split, approximate=False).inserts.select("round", "mate", "event_id", "sequence")


@register(_CODED + "SELECT read_index AS event_id, concat('round_0', r::STRING) AS round, m.mate, CASE WHEN m.mate = 'R1' THEN substr(sequence, 6) ELSE concat('mate_', read_index) END AS sequence FROM a CROSS JOIN (VALUES ('R1'), ('R2')) AS m(mate) WHERE r IS NOT NULL")
def demultiplex_pairs(spark, sf_dir):
    """Mates follow their first read's barcode through two pairs of files."""
    from pyspark.sql import Window

    r1 = coded(spark, sf_dir).withColumnRenamed("read_index", "event_id").withColumns({"round": F.lit("pool"), "file_index": (F.col("event_id") % 2).cast("int")})
    r2 = r1.withColumns({"mate": F.lit("R2"), "sequence": F.format_string("mate_%d", "event_id"), "file_index": F.col("file_index") + 2})
    place = F.row_number().over(Window.partitionBy("mate", "file_index").orderBy("event_id")) - 1
    paired = fastq.with_pairs(r1.unionByName(r2).withColumn("read_index", place.cast("bigint")))
    return demultiplex.demultiplex(paired, CODES).reads.select("event_id", "round", "mate", "sequence")


@register("WITH c AS (SELECT * FROM (VALUES ('AAAAA'), ('TTTTT'), ('CCCCC')) AS t(code)) SELECT a.code AS a, b.code AS b, hamming(a.code, b.code)::BIGINT AS distance FROM c a JOIN c b ON a.code < b.code")
def barcode_distances(spark, sf_dir):
    rows = demultiplex.distances(demultiplex.checked_barcodes(CODES))
    return spark.createDataFrame([(*sorted((a, b)), d) for a, b, d in rows], "a string, b string, distance bigint")


# files: written from the same reads to shared storage, and read back

_FASTQ = "concat('@', CAST(read_index AS STRING), chr(10), sequence, chr(10), '+', chr(10), repeat('I', length(sequence)))"


def _folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see: in ``spark.checkpoint.dir`` where that is a mounted path; only a local master may do without one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    root = re.sub("^file:(//)?(?=/)", "", root) if root else None
    if root and root.startswith("/"):
        os.makedirs(root, exist_ok=True)
    elif re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        root = None
    else:
        raise ValueError("spark.checkpoint.dir must be a mounted path that the driver and all executors share.")
    return tempfile.mkdtemp(prefix="readloom-files-", dir=root)


def _written(spark, sf_dir) -> dict[str, str]:
    """A FASTQ file of each round's reads by read_index; rounds are few, and a file is one task by nature."""
    folder, out = _folder(spark), {}
    for name in ROUNDS:
        path = f"{folder}/{name}.fastq"
        rows = reads(spark, sf_dir).filter(F.col("round") == name).orderBy("read_index").select(F.expr(_FASTQ))
        with open(path, "w", encoding="latin-1", newline="") as f:
            f.writelines(r[0] + "\n" for r in rows.toLocalIterator())
        out[name] = path
    return out


@register(WITH + "SELECT round, (row_number() OVER (PARTITION BY round ORDER BY read_index) - 1)::BIGINT AS read_index, sequence FROM reads")
def read_fastq_splits(spark, sf_dir):
    """FASTQ files in small splits: every record at its place."""
    files = _written(spark, sf_dir)
    found = fastq.read_fastq(spark, list(files.values()), split_bytes=20_000)
    return found.select(F.element_at(F.array(*map(F.lit, files)), F.col("file_index") + 1).alias("round"), "read_index", "sequence")


@register(WITH + "SELECT round, sequence FROM (SELECT *, row_number() OVER (PARTITION BY round ORDER BY read_index) AS k FROM reads) WHERE k <= 100")
def read_fastq_capped(spark, sf_dir):
    files = _written(spark, sf_dir)
    found = fastq.read_fastq(spark, list(files.values()), max_reads=100)
    return found.select(F.element_at(F.array(*map(F.lit, files)), F.col("file_index") + 1).alias("round"), "sequence")


@register(WITH + f", t AS (SELECT round, count(*) AS n, string_agg({_FASTQ} || chr(10), '' ORDER BY read_index) AS body FROM reads GROUP BY round) SELECT right(round, 1)::INTEGER AS round_number, 'R1' AS mate, n::INTEGER AS reads_loaded, strlen(body)::BIGINT AS file_size, md5(body) AS md5, sha256(body) AS sha256 FROM t")
def read_inputs_files(spark, sf_dir):
    return fastq.read_inputs(spark, _written(spark, sf_dir)).files.select("round_number", "mate", "reads_loaded", "file_size", "md5", "sha256")


@register(WITH + "SELECT k AS format, sequence, reads::DOUBLE AS reads, rank::INTEGER AS rank FROM ranked CROSS JOIN (VALUES ('csv'), ('parquet'), ('tsv')) AS f(k) WHERE round = 'round_01'")
def count_files(spark, sf_dir):
    """One round's counts written to every format and read back under the contract."""
    from functools import reduce

    folder = _folder(spark)
    one = counting.count_sequences(reads(spark, sf_dir).filter("round = 'round_01'")).drop("round")
    out = []
    for kind in ("csv", "parquet", "tsv"):
        counts_io.write_counts(one, f"{folder}/c.{kind}")
        out.append(counts_io.read_counts(spark, f"{folder}/c.{kind}").select(F.lit(kind).alias("format"), "sequence", "reads", "rank"))
    return reduce(DataFrame.unionByName, out)


_NAMES = "SELECT n_nationkey AS k, concat('/data/', n_name, CASE n_nationkey % 5 WHEN 0 THEN '_R1' WHEN 1 THEN '.r2' WHEN 2 THEN '_2' WHEN 3 THEN '-R12' ELSE '' END, CASE WHEN n_nationkey % 2 = 0 THEN '.fastq.gz' ELSE '.FQ' END) AS path, concat(n_name, '_', CAST(n_nationkey % 7 AS STRING), CASE WHEN n_nationkey % 3 = 0 THEN 'x' ELSE '' END) AS label FROM nation"


@register(f"WITH n AS ({_NAMES}), s AS (SELECT *, regexp_replace(parse_filename(path), '(?i)\\.(fastq|fq)(\\.gz)?$', '') AS stem FROM n) SELECT path, CASE WHEN regexp_matches(stem, '(?i)(^|[._-])R[12]([._-]|$)') THEN 'R' || regexp_extract(stem, '(?i)(?:^|[._-])R([12])(?:[._-]|$)', 1) WHEN regexp_matches(stem, '(^|[._-])[12]$') THEN 'R' || right(stem, 1) END AS mate, try_cast(nullif(regexp_extract(label, '([0-9]+)$', 1), '') AS BIGINT) AS round FROM s")
def file_names(spark, sf_dir):
    """Mate and round that file names and labels tell; a list of files is small by nature."""
    rows = [(r["path"], fastq.mate_of(r["path"]), fastq.round_of(r["label"])) for r in _view(spark, sf_dir, _NAMES, "nation").collect()]
    return spark.createDataFrame(rows, "path string, mate string, round bigint")


# decisions on small records

_PRIMERS = "SELECT n_nationkey AS k, translate(substr(md5(n_name), 1, CASE WHEN n_nationkey % 2 = 0 THEN 6 ELSE 4 END), '0123456789abcdef', 'ACACACACACACACAC') AS p FROM nation"


@register(f"WITH n AS ({_PRIMERS}), x AS (SELECT a.k AS a, b.k AS b, CASE WHEN length(a.p) >= length(b.p) THEN a.p ELSE b.p END AS l, CASE WHEN length(a.p) >= length(b.p) THEN b.p ELSE a.p END AS s FROM n a CROSS JOIN n b) SELECT a, b, len(list_filter(range(1, length(l) - length(s) + 2), lambda i: hamming(substr(l, i::INT, length(s)::INT), s) <= 1)) > 0 AS agree FROM x")
def primers_agree(spark, sf_dir):
    rows = _view(spark, sf_dir, _PRIMERS, "nation").collect()
    return spark.createDataFrame([(x["k"], y["k"], detection.agree(x["p"], y["p"])) for x in rows for y in rows], "a int, b int, agree boolean")


_RATES = "SELECT n_nationkey AS k, (n_nationkey % 11) / 10.0 AS a, (n_nationkey * 7 % 11) / 10.0 AS b, (n_nationkey * 3 % 10) / 10.0 AS l, (n_nationkey * 5 % 13) / 12.0 AS c, n_nationkey % 6 = 1 AS split, n_nationkey % 2 = 0 AS several FROM nation"


@register(f"""WITH r AS ({_RATES}), m AS (SELECT *, CASE WHEN a < 0.4 AND b < 0.4 THEN 'UNABLE_TO_EXTRACT' WHEN split THEN 'PAIRED_END_SPLIT_PRIMERS' WHEN a > 0.7 AND b > 0.7 THEN 'BOTH_PRIMERS_SINGLE_READ'
 WHEN a <= 0.7 AND b <= 0.7 THEN 'UNABLE_TO_EXTRACT' WHEN l > 0.8 AND a > 0.7 THEN 'FIVE_PRIME_ONLY' WHEN l > 0.8 THEN 'THREE_PRIME_ONLY' ELSE 'UNABLE_TO_EXTRACT' END AS mode FROM r)
 SELECT k, mode, CASE mode WHEN 'UNABLE_TO_EXTRACT' THEN 'MANUAL_PRIMERS_REQUIRED' WHEN 'PAIRED_END_SPLIT_PRIMERS' THEN 'READ_MERGING_RECOMMENDED' ELSE 'NONE' END AS action,
 CASE WHEN mode = 'UNABLE_TO_EXTRACT' OR c < 0.3 THEN 'UNABLE_TO_INFER' WHEN c >= 0.85 AND several THEN 'HIGH' WHEN c >= 0.6 THEN 'MEDIUM' ELSE 'LOW' END AS status FROM m""")
def library_classes(spark, sf_dir):
    rows = []
    for r in _view(spark, sf_dir, _RATES, "nation").collect():
        found = detection.classify(float(r["a"]), float(r["b"]), float(r["l"]), r["split"], r["several"], float(r["c"]))
        rows.append((r["k"], found["extraction_mode"], found["required_action"], found["status"]))
    return spark.createDataFrame(rows, "k int, mode string, action string, status string")


@register(f"WITH r AS ({_RATES}) SELECT k, round(CASE WHEN several THEN 0.15 * a + 0.15 * b + 0.15 * a + 0.15 * b + 0.25 * c + 0.1 * l + 0.05 ELSE 0.225 * a + 0.225 * b + 0.225 * a + 0.225 * b + 0.05 * l + 0.05 END, 9) AS confidence FROM r")
def composite_confidence(spark, sf_dir):
    rows = []
    for r in _view(spark, sf_dir, _RATES, "nation").collect():
        a, b, c, x = (float(r[n]) for n in "abcl")
        signals = {"match_5p": a, "match_3p": b, "pos_5p": a, "pos_3p": b, "persistence": c, "n_length": x, "adapter_clean": 1.0}
        rows.append((r["k"], round(detection.composite(signals, r["several"]), 9)))
    return spark.createDataFrame(rows, "k int, confidence double")


@register("WITH r AS (SELECT n_regionkey AS k, (n_nationkey % 11) / 10.0 AS x FROM nation) SELECT k, round(CASE WHEN avg(x) >= 0.1 THEN greatest(0.0, least(1.0, 1 - stddev_samp(x) / avg(x))) END, 9) AS score FROM r GROUP BY k")
def persistence_scores(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").groupBy("n_regionkey").agg(F.collect_list(F.col("n_nationkey") % 11 / 10.0).alias("x")).collect()
    score = lambda x: None if (v := detection.persistence_score(x)) is None else round(v, 9)
    return spark.createDataFrame([(r[0], score([float(v) for v in r["x"]])) for r in rows], "k int, score double")


_CURVES = "SELECT n_nationkey AS c, k, CASE WHEN k < 14 + n_nationkey THEN 0.99 - ((n_nationkey * 13 + k * 7) % 10) / 200.0 ELSE 0.4 + ((n_nationkey * 5 + k * 11) % 30) / 100.0 END AS s FROM nation CROSS JOIN (SELECT explode(sequence(0, 59)) AS k)"


@register(f"""WITH c AS ({_CURVES.replace("explode(sequence(0, 59))", "unnest(range(0, 60))")}), w AS (SELECT *, median(s) OVER (PARTITION BY c ORDER BY k ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) AS base, greatest(s, coalesce(lead(s) OVER (PARTITION BY c ORDER BY k), s)) AS two FROM c),
 d AS (SELECT c, coalesce(min(k) FILTER (k >= 14 AND k < 59 AND base >= 0.9 AND s <= base - 0.12 AND two < 0.85), 60) AS e FROM w GROUP BY c), x AS (SELECT w.c, any_value(e) AS e, min(k) FILTER (k < least(e, 59) AND two < 0.55) AS weak FROM w JOIN d ON w.c = d.c GROUP BY w.c),
 y AS (SELECT c, coalesce(weak, e) AS e FROM x) SELECT y.c, CASE WHEN any_value(e) < 14 OR avg((s >= 0.75)::INT) FILTER (k < e) < 0.8 THEN 0 ELSE any_value(e) END::BIGINT AS boundary FROM y JOIN c ON c.c = y.c GROUP BY y.c""")
def flank_boundaries(spark, sf_dir):
    """Ends of constant regions under curves of supports."""
    t = spark.sql(_CURVES.replace("FROM nation", "FROM {t}"), t=spark.read.parquet(f"{sf_dir}/nation.parquet"))
    rows = t.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("k", "s"))).alias("x")).collect()
    return spark.createDataFrame([(r["c"], detection.boundary([float(v["s"]) for v in r["x"]])) for r in rows], "c int, boundary bigint")


@register(WITH + "SELECT k::BIGINT AS \"offset\", base, round(n / total, 9) AS support FROM (SELECT k, base, n, sum(n) OVER (PARTITION BY k) AS total, row_number() OVER (PARTITION BY k ORDER BY n DESC, first) AS place FROM (SELECT k, substr(sequence, k::INT + 1, 1) AS base, count(*) AS n, min(read_index) AS first FROM (SELECT read_index, sequence, unnest(range(0, least(length(sequence), 60))) AS k FROM reads) GROUP BY ALL)) WHERE place = 1 AND total >= 100 AND k < (SELECT coalesce(min(k), 60) FROM (SELECT r.k, count(q.read_index) AS covered FROM (SELECT unnest(range(0, 60)) AS k) r LEFT JOIN reads q ON length(q.sequence) > r.k GROUP BY r.k) WHERE covered < 100)")
def consensus_5p(spark, sf_dir):
    bases, supports = detection.consensus(reads(spark, sf_dir), True, 100)
    return spark.createDataFrame([(k, b, round(x, 9)) for k, (b, x) in enumerate(zip(bases, supports, strict=True))], "offset bigint, base string, support double")


# metadata with attributes, overrides and the archive's answers

ATTRIBUTED = """
SELECT run_accession, sample_title, library_name, CASE p % 5
  WHEN 0 THEN map('selex round', CAST(p % 9 AS STRING)) WHEN 1 THEN map('PCR cycle', concat('R', CAST(p % 9 AS STRING)))
  WHEN 2 THEN map('age', '5') WHEN 3 THEN map('round', 'x') ELSE map('Characteristics [selection cycle]', concat('cycle ', CAST(p % 9 AS STRING))) END AS sample_attributes
FROM (SELECT *, CAST(substr(run_accession, 4) AS INTEGER) AS p FROM runs)
"""
_OVERRIDES = {"RUN1": 90, "RUN7": 91, "RUN20": 92}


@register(f"WITH runs AS ({RUNS}), f AS (SELECT run_accession, CAST(substr(run_accession, 4) AS INTEGER) AS p, {_found('t')} AS a, {_found('l')} AS b FROM {_SEPARATED}), t AS (SELECT *, CASE WHEN len(a) > 0 THEN a[1] WHEN len(b) > 0 THEN b[1] END AS r, CASE WHEN len(a) > 0 THEN CASE WHEN len(list_distinct(a)) = 1 THEN 'HIGH' ELSE 'MEDIUM' END WHEN len(b) > 0 THEN 'MEDIUM' ELSE 'NONE' END AS c, CASE WHEN len(a) > 0 THEN 'sample_title' WHEN len(b) > 0 THEN 'library_name' ELSE 'none' END AS s FROM f) SELECT run_accession, CASE run_accession WHEN 'RUN1' THEN 90 WHEN 'RUN7' THEN 91 WHEN 'RUN20' THEN 92 ELSE CASE WHEN p % 5 IN (0, 4) OR (p % 5 = 1 AND r IS NULL) THEN p % 9 ELSE r END END AS round_number, CASE WHEN run_accession IN ('RUN1', 'RUN7', 'RUN20') OR p % 5 IN (0, 4) THEN 'HIGH' WHEN p % 5 = 1 AND r IS NULL THEN 'MEDIUM' ELSE c END AS confidence, CASE WHEN run_accession IN ('RUN1', 'RUN7', 'RUN20') THEN 'seed_override' WHEN p % 5 IN (0, 4) OR (p % 5 = 1 AND r IS NULL) THEN 'sample_attributes' ELSE s END AS source_field FROM t")
def round_inference_attributes(spark, sf_dir):
    """The whole cascade: overrides, attributes that are sure or not, texts."""
    runs(spark, sf_dir).createOrReplaceTempView("readloom_runs")
    table = spark.sql(ATTRIBUTED.replace("FROM runs", "FROM readloom_runs"))
    return rounds.infer_rounds(table, _OVERRIDES).select("run_accession", "round_number", "confidence", "source_field")


_VALUES = "SELECT p_partkey, concat(CASE p_partkey % 6 WHEN 0 THEN 'Round ' WHEN 1 THEN 'c-' WHEN 2 THEN '' WHEN 3 THEN ' R_' WHEN 4 THEN 'cycle' ELSE 'x' END, CAST(p_size AS STRING), CASE WHEN p_partkey % 7 = 0 THEN 'th' ELSE ' ' END) AS v, concat(CASE WHEN p_partkey % 2 = 0 THEN 'Thrombin_2 ' ELSE 'lower ' END, CASE p_partkey % 3 WHEN 0 THEN 'Round 3' WHEN 1 THEN 'R5' ELSE 'pool' END) AS t FROM part"


@register(f"SELECT p_partkey, try_cast(nullif(regexp_extract(trim(v), '(?i)^(?:(?:round|cycle|r|c)[\\s_\\-]*)?(\\d+)$', 1), '') AS INTEGER) AS value, nullif(regexp_extract(trim(t), '^([A-Z][A-Za-z0-9_-]+)[\\s_-]+(?:[Rr]ound|[Rr]\\d|[Cc]ycle)', 1), '') AS hint FROM ({_VALUES})")
def attribute_values(spark, sf_dir):
    t = _view(spark, sf_dir, _VALUES, "part")
    return t.select("p_partkey", rounds.attribute_value(F.col("v")).alias("value"), rounds.target_hint(F.col("t")).alias("hint"))


@register("SELECT concat('RUN', n_nationkey) AS run_accession, concat('S', n_nationkey % 10) AS sample_accession, CASE WHEN n_nationkey % 10 < 7 THEN concat('v', n_nationkey % 10) END AS tag, [concat('host/', n_name, '_1.fq.gz'), concat('host/', n_name, '_2.fq.gz')] AS fastq_urls, [10.0, 20.0] AS fastq_bytes FROM nation")
def archive_runs(spark, sf_dir):
    """A run report and its samples, as an archive would answer: a busy service, a missing batch, then one by one."""
    nations = [(r["n_nationkey"], r["n_name"]) for r in spark.read.parquet(f"{sf_dir}/nation.parquet").collect()]
    own = {"run_accession": "RUN{k}", "sample_accession": "S{m}", "fastq_ftp": "host/{n}_1.fq.gz; host/{n}_2.fq.gz;", "fastq_bytes": "10;x;20", "study_accession": "P"}
    lines = ["\t".join(archive.FIELDS)] + ["\t".join(own.get(f, "NA").format(k=k, m=k % 10, n=n) for f in archive.FIELDS) for k, n in nations]
    busy = [(200, b"ERROR occurred")]

    def transport(url: str, timeout: float) -> tuple[int, bytes]:
        if url.startswith(archive.REPORT_URL):
            return busy.pop() if busy else (200, "\n".join(lines).encode())
        names = url[len(archive.SAMPLE_URL) :].split(",")
        if len(names) > 1 or int(names[0][1:]) >= 7:
            return 404, b""
        pairs = f"<SAMPLE_ATTRIBUTE><TAG>tag</TAG><VALUE>v{names[0][1:]}</VALUE></SAMPLE_ATTRIBUTE>" * 2 + "<SAMPLE_ATTRIBUTE><TAG>ENA-X</TAG><VALUE>1</VALUE></SAMPLE_ATTRIBUTE>"
        return 200, f"<S><SAMPLE accession='{names[0]}'>{pairs}</SAMPLE></S>".encode()

    found = archive.inspect(spark, "P", transport=transport, sleep=lambda s: None).runs
    return found.select("run_accession", "sample_accession", F.try_element_at("sample_attributes", F.lit("tag")).alias("tag"), "fastq_urls", "fastq_bytes")


# plots and manifests


@register(WITH + _YIELD.format(k="round").replace("count(*) AS input_reads, count(e.read_index) AS output_reads, ", "").replace("AS fraction_kept", 'AS "yield", 0.9::DOUBLE AS match_rate_5p, 0.8::DOUBLE AS match_rate_3p').replace("round(count(e", "round(count(e"))
def plot_primer_match(spark, sf_dir):
    report = LibraryReport(match_rate_5p=0.9, match_rate_3p=0.8)
    return quality.primer_match(_yields(spark, sf_dir, "round"), report).withColumn("yield", F.round("yield", 9))


@register(WITH + _per_round_sql() + "SELECT round, n_unique, round(shannon_entropy_bits, 8) AS shannon_entropy_bits, round(top_100_coverage, 9) AS top_100_coverage FROM metrics")
def plot_diversity(spark, sf_dir):
    t = quality.diversity(quality.basics(counts(spark, sf_dir)))
    return t.select("round", "n_unique", F.round("shannon_entropy_bits", 8).alias("shannon_entropy_bits"), F.round("top_100_coverage", 9).alias("top_100_coverage"))


@register("SELECT * FROM (VALUES ('bare', 'retention', true, 2, 3), ('bare', 'primer_match', false, 2, 3), ('bare', 'length', false, 2, 3), ('bare', 'diversity', true, 2, 3), ('full', 'retention', true, 1, 3), ('full', 'primer_match', true, 1, 3), ('full', 'length', true, 1, 3)) AS t(kind, panel, available, rows, columns)")
def plot_panels(spark, sf_dir):
    """Which plots have their data, and their grid."""
    c = counts(spark, sf_dir)
    found = quality.Quality(quality.basics(c), None, [], {})
    out = []
    for kind, which, more in (("bare", quality.PANELS, {}), ("full", quality.PANELS[:3], {"counts": c, "rates": _yields(spark, sf_dir, "round")})):
        panels, (rows, columns) = quality.panels(found, which=which, **more)
        out += [(kind, p.name, p.available, rows, columns) for p in panels]
    return spark.createDataFrame(out, "kind string, panel string, available boolean, rows int, columns int")


@register("SELECT * FROM (VALUES ('accession', 'ACC'), ('extraction_mode', 'BOTH_PRIMERS_SINGLE_READ'), ('flags', 'a,b'), ('full_insert_recovered', 'true'), ('parameters', '{\"a\": \"x\", \"b\": \"2\"}'), ('primer_5p', '" + P5 + "'), ('read_source', 'R1'), ('required_action', 'NONE'), ('runs', 'R1,R2'), ('sampling_seed', '42'), ('status', 'LOW')) AS t(field, value)")
def manifest_fields(spark, sf_dir):
    """A manifest of a corrected report, written and read back."""
    import json

    from .plans import manifest
    from .plans.report import corrected, read_report, write_report

    folder = _folder(spark)
    write_report(corrected(LibraryReport(), P5, P3), f"{folder}/report.json")
    report = read_report(f"{folder}/report.json")
    manifest.write(manifest.build(report, accession="ACC", runs=["R1", "R2"], parameters={"b": 2, "a": "x"}, flags=["a", "b"]), f"{folder}/m.json")
    m = manifest.read(f"{folder}/m.json")
    rows = [(k, m[k]) for k in ("accession", "extraction_mode", "read_source", "required_action")] + [(k, ",".join(m[k])) for k in ("flags", "runs")]
    rows += [("full_insert_recovered", str(m["full_insert_recovered"]).lower()), ("parameters", json.dumps(m["parameters"])), ("sampling_seed", str(m["sampling_seed"])), ("primer_5p", m["library_report"]["primer_5p"]), ("status", m["library_report"]["status"])]
    return spark.createDataFrame(rows, "field string, value string")
