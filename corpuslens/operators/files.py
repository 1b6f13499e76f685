"""File scans and per-repository statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens import catalogue as cat
from corpuslens.functions.lookup import literal_map, lookup
from corpuslens.functions.predicates import (
    is_analyzable,
    is_entry_point,
    is_manifest,
    is_root_readme,
    is_test_path,
    language_of,
    not_in_ignored_dir,
)
from corpuslens.functions.text import basename, line_count, lines_array
from corpuslens.session import join_small


def with_language(files: DataFrame) -> DataFrame:
    """Files outside ignored directories whose extension maps to a language. Needs no content and no join."""
    return (
        files.where(not_in_ignored_dir("path", "language"))
        .withColumn("language", language_of("path"))
        .where(F.col("language").isNotNull())
    )


def explode_lines(files: DataFrame, *keep: str) -> DataFrame:
    """One row per numbered line. Narrow: the rows stay where their file was read."""
    cols = keep or tuple(c for c in files.columns if c != "content")
    return files.select(*cols, F.posexplode(lines_array("content")).alias("_pos", "line")).select(
        *cols, (F.col("_pos") + 1).cast("int").alias("line_no"), "line"
    )


def language_stats(files: DataFrame) -> DataFrame:
    """Files and physical lines per (repository, language); the map side combines before the shuffle."""
    return (
        with_language(files)
        .select("repo_id", "language", line_count("content").alias("n"))
        .groupBy("repo_id", "language")
        .agg(F.count("*").alias("files"), F.sum("n").alias("lines"))
    )


def repo_stats(files: DataFrame) -> DataFrame:
    """One row per repository: counts and two maps over at most 25 languages."""
    return (
        language_stats(files)
        .groupBy("repo_id")
        .agg(
            F.sum("files").alias("file_count"),
            F.sum("lines").alias("lines_of_code"),
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "files")))).alias("languages"),
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "lines")))).alias("language_lines"),
        )
    )


def dependency_manifests(files: DataFrame) -> DataFrame:
    """Manifest paths with their ecosystem ('.csproj' files have none in the table)."""
    return files.where(not_in_ignored_dir("path", "language") & is_manifest("path")).select(
        "repo_id", "path", F.coalesce(lookup(basename("path"), cat.MANIFESTS), F.lit(".NET")).alias("ecosystem")
    )


def package_json_frameworks(content: Column) -> Column:
    """Framework labels of the dependencies declared in a package.json text."""
    parsed = F.try_parse_json(content)
    names = F.concat(
        *[
            F.coalesce(
                F.map_keys(F.try_variant_get(parsed, f"$.{key}", "map<string,variant>")),
                F.array().cast("array<string>"),
            )
            for key in ("dependencies", "devDependencies")
        ]
    )
    return F.array_compact(F.transform(names, lambda n: F.try_element_at(literal_map(cat.FRAMEWORK_PACKAGES), n)))


def detect_frameworks(files: DataFrame) -> DataFrame:
    """Distinct (repository, framework); the set has at most 29 labels."""
    hits = files.where(not_in_ignored_dir("path", "language")).withColumn("_name", basename("path"))
    wanted = (*cat.FRAMEWORK_FILES, "package.json")
    by_name = F.array_compact(F.array(lookup(F.col("_name"), cat.FRAMEWORK_FILES)))
    labels = F.when(
        F.col("_name") == "package.json", F.concat(by_name, F.coalesce(package_json_frameworks(F.col("content")), F.array().cast("array<string>")))
    ).otherwise(by_name)
    return (
        hits.where(F.col("_name").isin(*wanted))
        .select("repo_id", F.explode(labels).alias("framework"))
        .distinct()
    )


def repo_facts(files: DataFrame) -> DataFrame:
    """Facts the scores need, from path and metadata only: the content column is pruned."""
    language = F.when(not_in_ignored_dir("path", "language"), language_of("path"))
    return files.groupBy("repo_id").agg(
        F.count(language).alias("file_count"),
        F.coalesce(F.bool_or(language.isNotNull() & is_test_path("path")), F.lit(False)).alias("has_tests"),
        F.coalesce(F.bool_or(is_root_readme("path")), F.lit(False)).alias("has_docs"),
    )


def repo_tree(files: DataFrame) -> DataFrame:
    """All listed paths, sorted by repository and path over range partitions (no list per repository)."""
    return files.where(not_in_ignored_dir("path", "tree")).select("repo_id", "path").orderBy("repo_id", "path")


def entry_points(files: DataFrame) -> DataFrame:
    return files.where(not_in_ignored_dir("path", "language") & is_entry_point("path")).select("repo_id", "path")


def first_paths(files: DataFrame, n: int, walk: str = "tree", n_salts: int = 64) -> DataFrame:
    """The first n paths of every repository in path order.

    Two exact steps: first within (repository, path hash), then within the repository, so a
    repository holding most of the files sends at most n rows per salt to its final group.
    """
    listed = files.where(not_in_ignored_dir("path", walk)).select(
        "repo_id", "path", F.pmod(F.xxhash64("path"), F.lit(n_salts)).alias("_salt")
    )
    part = Window.partitionBy("repo_id", "_salt").orderBy("path")
    whole = Window.partitionBy("repo_id").orderBy("path")
    return (
        listed.withColumn("_rn", F.row_number().over(part))
        .where(F.col("_rn") <= n)
        .drop("_rn", "_salt")
        .withColumn("position", F.row_number().over(whole))
        .where(F.col("position") <= n)
    )


def cap_language_files(files: DataFrame, max_files: int | None = None) -> DataFrame:
    """The language files of every repository; with ``max_files`` the first so many in path order."""
    listed = with_language(files)
    if max_files is None:
        return listed
    last = first_paths(listed.select("repo_id", "path"), max_files, walk="language").where(
        F.col("position") == max_files
    )
    # Only repositories that reach the cap have a row here, so the file contents need not be shuffled.
    bound = last.select("repo_id", F.col("path").alias("_last"))
    return (
        join_small(listed, bound, "repo_id", "left")
        .where(F.col("_last").isNull() | (F.col("path") <= F.col("_last")))
        .drop("_last")
    )


def repo_gate(
    files: DataFrame, max_file_kb: float = math.inf, max_files: float = math.inf, max_repo_mb: float = math.inf
) -> DataFrame:
    """Admission report per repository with the first failing check; without limits only links are reported."""
    inside = not_in_ignored_dir("path", "clone")
    size = F.when(inside & is_analyzable("path"), F.col("size_bytes"))
    gate = (
        files.groupBy("repo_id")
        .agg(
            F.coalesce(F.bool_or(F.col("is_symlink") & inside), F.lit(False)).alias("has_symlink"),
            F.coalesce(F.max(size), F.lit(0)).alias("largest_file"),
            F.count(size).alias("source_files"),
            F.coalesce(F.sum(size), F.lit(0)).alias("source_bytes"),
        )
    )
    reason = (
        F.when(F.col("has_symlink"), "symlink")
        .when(F.col("largest_file") > F.lit(max_file_kb * 1024), "file too large")
        .when(F.col("source_files") > F.lit(max_files), "too many files")
        .when(F.col("source_bytes") > F.lit(max_repo_mb * 1024 * 1024), "repository too large")
    )
    return gate.withColumn("reject_reason", reason)
