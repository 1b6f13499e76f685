"""The whole analysis of a corpus: files and tool reports in; findings, statistics, scores and chunks out."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.operators.chunks import chunk_files
from corpuslens.operators.css import css_checks
from corpuslens.operators.dependencies import dependency_findings
from corpuslens.operators.files import repo_facts, repo_gate, repo_stats
from corpuslens.operators.findings import dedup_findings, union_findings
from corpuslens.operators.rules import scan_findings
from corpuslens.operators.scores import score_repos
from corpuslens.session import join_small, scratch_path
from corpuslens.sources.tool_reports import ingest_reports


class Analysis(NamedTuple):
    gate: DataFrame
    rejects: DataFrame
    findings: DataFrame
    stats: DataFrame
    scores: DataFrame
    record: DataFrame
    chunks: DataFrame


def corpus_findings(files: DataFrame, reports: DataFrame | None = None, security_max_bytes: int | None = None) -> DataFrame:
    """Every analyzer's findings, appended in order and de-duplicated."""
    parts = [scan_findings(files, security_max_bytes), css_checks(files), dependency_findings(files)]
    if reports is not None:
        parts.append(ingest_reports(reports, files))
    return dedup_findings(union_findings(*parts))


def analysis_record(stats: DataFrame, scores: DataFrame) -> DataFrame:
    """The stored row of a finished analysis per repository: counts, languages by size, scores and status."""
    by_lines = F.array_sort(
        F.transform(F.map_entries("language_lines"), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("language")))
    )
    facts = stats.select("repo_id", "file_count", "lines_of_code", F.transform(by_lines, lambda x: x["language"]).alias("languages"))
    none = F.array().cast("array<string>")
    return scores.join(facts, "repo_id", "left").select(
        F.col("repo_id").alias("repository_id"), F.lit("complete").alias("status"), F.lit(100).alias("progress_percent"),
        *[c for c in scores.columns if c != "repo_id"],
        F.coalesce("file_count", F.lit(0)).alias("file_count"), F.coalesce("lines_of_code", F.lit(0)).alias("lines_of_code"),
        F.coalesce("languages", none).alias("languages"), F.current_timestamp().alias("completed_at"),
    )


def analyze_corpus(
    files: DataFrame, reports: DataFrame | None = None, limits: dict[str, float] | None = None, security_max_bytes: int | None = None
) -> Analysis:
    """Frames of one analysis. Every repository is analysed: ``gate`` only reports what the admission checks say.

    With ``limits`` (arguments of ``repo_gate``) the repositories that break one are listed in ``rejects`` and left
    out; the others go on. Findings are written once below the shared folder and scored from there.
    """
    gate = repo_gate(files, **(limits or {}))
    rejects = gate.where(F.col("reject_reason").isNotNull()).select(
        "repo_id", F.lit("admission").alias("stage"), F.col("reject_reason").alias("reason")
    )
    if limits is None:
        rejects, admitted = rejects.where(F.lit(False)), files
    else:
        admitted = join_small(files, rejects.select("repo_id"), "repo_id", "left_anti")
    place = scratch_path(files.sparkSession, "findings")
    found = corpus_findings(admitted, reports, security_max_bytes)
    found.write.parquet(place)
    findings = files.sparkSession.read.schema(found.schema).parquet(place)
    stats, scores = repo_stats(admitted), score_repos(findings, repo_facts(admitted))
    return Analysis(gate, rejects, findings, stats, scores, analysis_record(stats, scores), chunk_files(admitted))
