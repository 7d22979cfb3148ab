"""The pN_ queries of the text problems, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfish.llm import credentials, mixing, packing, syntax, truncation
from lanternfish.llm.tokens import token_counts
from lanternfish.sources.storage import cut, spread, table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every literal credential in the source files."""
    found = credentials.credential_candidates(spread(table(spark, sf_dir, "source_files").select("file_id", "text")))
    return credentials.credentials(found).distinct()


def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source file with its credentials blanked."""
    files = table(spark, sf_dir, "source_files").select("file_id", "text")
    return credentials.redact(files, cut(p2_found(spark, sf_dir), "credentials"))


def p2_by_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by context, alphabet and reason of exclusion."""
    found = credentials.credential_candidates(spread(table(spark, sf_dir, "source_files").select("file_id", "text")))
    reason = F.coalesce("excluded", F.when(F.col("entropy") < credentials.threshold(), F.lit("low entropy")), F.lit("credential"))
    return found.groupBy("context", "alphabet", reason.alias("decision")).agg(F.count(F.lit(1)).alias("n"))


def _invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "source_files").select("file_id", "path", "text")
    return syntax.invalid_files(spark, cut(syntax.lexed(spread(files)), "lexed"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files that aren't valid in the language of their suffix."""
    return _invalid(spark, sf_dir).select("file_id").distinct()


def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of invalid files per repository and language."""
    return syntax.invalid_rates(table(spark, sf_dir, "source_files"), table(spark, sf_dir, "packages"), cut(_invalid(spark, sf_dir), "invalid"))


def p5_wrong_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which impermissible pairs of tokens files have, by language."""
    rows = syntax.lexed(spread(table(spark, sf_dir, "source_files").select("file_id", "path", "text")))
    return syntax.wrong_pairs(spark, rows).groupBy("lang", "pair").agg(F.count(F.lit(1)).alias("n_files"))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = token_counts(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return packing.pack(cut(items, "sizes"), table(spark, sf_dir, "pack_sizes"))


def p6_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which part of which document lies in which container, for each capacity."""
    return _packed(spark, sf_dir)


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers and unused space of each capacity."""
    return packing.fill_report(cut(_packed(spark, sf_dir), "packed"), table(spark, sf_dir, "pack_sizes"))


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = cut(token_counts(spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text")), keep=("doc_id", "source")), "sizes")
    return mixing.mix(records, table(spark, sf_dir, "source_targets"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen records with their number of copies."""
    return _mixed(spark, sf_dir)


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source."""
    return mixing.share_report(cut(_mixed(spark, sf_dir), "mixed"), table(spark, sf_dir, "source_targets"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that were cut off before their end."""
    return truncation.truncated(truncation.truncation_scores(spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))))


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of cut documents per source."""
    return truncation.truncation_rates(table(spark, sf_dir, "documents"), p8_found(spark, sf_dir))


_NAMES = ["p2_found", "p2_redacted", "p2_by_context", "p5_found", "p5_rates", "p5_wrong_pairs", "p6_packs", "p6_fill", "p7_mix", "p7_shares", "p8_found", "p8_rates"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name to function(spark, folder)."""
    return {n: globals()[n] for n in _NAMES}


def oracle_sql() -> dict[str, str]:
    """These operators can't be expressed in SQL; tests/llm hold brute-force versions."""
    return {}
