"""One query per operator over the given tables. Every query reads its whole input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import views as v
from corpuslens.functions import naming
from corpuslens.functions.text import safe_rel_path
from corpuslens.operators import chunk_store as cs, chunks as ch
from corpuslens.operators import css, dependencies as deps, evidence, files as fl, findings as fd
from corpuslens.operators import issues as iss, patches as pt, progress as pg, reports as rp
from corpuslens.operators import retrieval as rt, rules as rl, scores as sc, tests_plan as tp, vector_index as vi
from corpuslens import catalogue as cat
from corpuslens.plans import analysis as an
from corpuslens.plans.analysis import corpus_findings
from corpuslens.session import scratch_path
from corpuslens.sources import progress_log as lg, python_source as py, report_sink as rs, tables as tb, tool_reports as tr, tree
from corpuslens.streaming import progress as sp, scan as ss

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
FINDING = ("repo_id", "rule_id", "title", "severity", "category", "file_path", "line_number", "language", "source_tool")
ISSUE = ("id", "analysis_id", "title", "severity", "category", "file_path", "line_number", "language", "source_tool", "status")


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def _files(spark: SparkSession, sf: str) -> DataFrame:
    return v.spark_view(spark, sf, v.FILES_ALL)


def _manifests(spark: SparkSession, sf: str) -> DataFrame:
    return v.spark_view(spark, sf, v.MANIFEST_FILES)


def _issues(spark: SparkSession, sf: str) -> DataFrame:
    return v.spark_view(spark, sf, v.ISSUES)


def _analyses(spark: SparkSession, sf: str) -> DataFrame:
    """Analyses with every column of the table; those the orders cannot supply are NULL."""
    a = v.spark_view(spark, sf, v.ANALYSES)
    none = F.lit(None)
    return a.select(
        "*", F.array(F.lit("Go"), F.lit("Python")).alias("languages"), none.cast("string").alias("architecture_summary"),
        *[none.cast("int").alias(f"{s}_score") for s in ("maintainability", "performance", "documentation", "testing", "architecture")],
    )


def _pairs(name: str):
    return F.array_join(
        F.transform(F.map_entries(name), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ","
    ).alias(name)


# Files and statistics

@query
def repo_stats(spark, sf):
    return fl.repo_stats(_files(spark, sf)).select(
        "repo_id", "file_count", "lines_of_code", _pairs("languages"), _pairs("language_lines")
    )


@query
def language_stats(spark, sf):
    return fl.language_stats(_files(spark, sf))


@query
def explode_lines(spark, sf):
    lines = fl.explode_lines(fl.with_language(_files(spark, sf)), "repo_id", "path", "language")
    return lines.groupBy("repo_id", "path", "language").agg(
        F.max("line_no").alias("lines"), F.sum(F.char_length("line")).alias("chars")
    )


@query
def detect_frameworks(spark, sf):
    return fl.detect_frameworks(_files(spark, sf).unionByName(_manifests(spark, sf)))


@query
def dependency_manifests(spark, sf):
    return fl.dependency_manifests(_files(spark, sf).unionByName(_manifests(spark, sf)))


@query
def entry_points(spark, sf):
    return fl.entry_points(_files(spark, sf))


@query
def repo_tree(spark, sf):
    return fl.repo_tree(_files(spark, sf))


@query
def first_paths(spark, sf):
    return fl.first_paths(_files(spark, sf), 10)


@query
def cap_language_files(spark, sf):
    return fl.cap_language_files(_files(spark, sf), 20).select("repo_id", "path", "language")


@query
def repo_gate(spark, sf):
    return fl.repo_gate(_files(spark, sf), max_file_kb=18, max_files=37, max_repo_mb=500)


@query
def repo_facts(spark, sf):
    return fl.repo_facts(_files(spark, sf))


@query
def parse_repo_url(spark, sf):
    r = v.spark_view(spark, sf, v.REPO_REQUESTS).withColumn("p", naming.parse_repo_url("clone_url"))
    return r.select("request_id", "clone_url", "p.owner", "p.name", "p.full_name", "p.normalized_url",
                    F.col("p.error").isNull().alias("valid"))


@query
def rel_paths(spark, sf):
    p = v.spark_view(spark, sf, RAW_PATHS)
    return p.withColumn("s", safe_rel_path("raw")).select("raw", F.col("s.path").alias("path"), F.col("s.error").isNotNull().alias("escapes"))


RAW_PATHS = """
SELECT CASE doc_id % 6 WHEN 0 THEN '/src/' WHEN 1 THEN 'a/../' WHEN 2 THEN '../' WHEN 3 THEN './a' || chr(92) || 'b/'
         WHEN 4 THEN 'a/b/../../' ELSE 'a/../../x/' END || lang || CAST(doc_id AS STRING) || '.py' AS raw
FROM $documents$
"""


# Rules

@query
def common_rules(spark, sf):
    return rl.match_rules(_files(spark, sf), ("common",)).select(*FINDING)


@query
def language_rules(spark, sf):
    return rl.match_rules(_files(spark, sf), ("language",)).select(*FINDING)


@query
def security_rules(spark, sf):
    return rl.match_rules(_files(spark, sf), ("security",), security_max_bytes=cat.SECURITY_MAX_BYTES).select(*FINDING)


@query
def php_rules(spark, sf):
    return rl.match_rules(_files(spark, sf), ("php",)).select(*FINDING)


@query
def html_rules(spark, sf):
    pages = v.spark_view(spark, sf, v.HTML)
    return rl.match_rules(pages, ("html",)).unionByName(
        rl.file_findings(pages).where(F.col("rule_id") == "RH6")
    ).select(*FINDING)


@query
def match_rules(spark, sf):
    return rl.match_rules(_files(spark, sf)).select(*FINDING)


@query
def scan_findings(spark, sf):
    """Line and file rules in one pass."""
    return rl.scan_findings(_files(spark, sf)).select(*FINDING)


@query
def css_checks(spark, sf):
    return css.css_checks(v.spark_view(spark, sf, v.CSS)).select(*FINDING)


@query
def nested_loops(spark, sf):
    return rl.nested_loops(_files(spark, sf))


@query
def file_findings(spark, sf):
    every = _files(spark, sf).unionByName(v.spark_view(spark, sf, v.CSS))
    return rl.file_findings(every).select(*FINDING)


# Manifests

@query
def package_json_rules(spark, sf):
    return deps.package_json_rules(_manifests(spark, sf)).select(*FINDING)


@query
def composer_rules(spark, sf):
    return deps.composer_rules(_manifests(spark, sf)).select(*FINDING)


@query
def requirement_rules(spark, sf):
    return deps.requirement_rules(_manifests(spark, sf)).select(*FINDING)


@query
def text_manifest_rules(spark, sf):
    return deps.text_manifest_rules(_manifests(spark, sf)).select(*FINDING)


@query
def maven_rules(spark, sf):
    return deps.maven_rules(_manifests(spark, sf)).select(*FINDING)


@query
def missing_lockfile(spark, sf):
    return deps.missing_lockfile(_manifests(spark, sf))


@query
def dependencies(spark, sf):
    return deps.dependencies(_manifests(spark, sf))


# Tool reports

REPORT_FINDING = ("repo_id", "title", "severity", "category", "file_path", "line_number", "language", "risk", "source_tool")


def _ingest(name: str):
    def run(spark, sf):
        return getattr(tr, name)(v.spark_view(spark, sf, v.TOOL_REPORTS)).select(*REPORT_FINDING)

    return run


for _name in ("ingest_bandit", "ingest_ruff", "ingest_radon", "ingest_eslint", "ingest_npm_audit"):
    REGISTRY[_name] = _ingest(_name)

SOURCE_REPORTS = f"SELECT repo_id, repo_id AS report_id, tool, report FROM ({v.TOOL_REPORTS}) t"


@query
def gated_reports(spark, sf):
    reports = v.spark_view(spark, sf, SOURCE_REPORTS)
    # Every document's files are a repository of their own here, so that some have code of a report's language and some not.
    code = _files(spark, sf).withColumn("repo_id", F.concat("repo_id", F.lit("-"), F.regexp_extract("path", r"/d(\d+)/", 1)))
    return tr.gate_by_language(reports, code).select("repo_id", "report_id", "tool")


# Findings and scores

@query
def dedup_issues(spark, sf):
    found = _issues(spark, sf)
    kept = fd.first_wins(found, fd.GLOBAL_KEY, ["seq_1", "seq_2", "seq_3", "seq_4"])
    return kept.select("repo_id", "title", "file_path", "line_number", "category", "source_tool", "severity", "id")


@query
def dedup_within_tool(spark, sf):
    kept = fd.first_wins(_issues(spark, sf), fd.TOOL_KEY, ["seq_1", "seq_2", "seq_3", "seq_4"])
    return kept.select("repo_id", "title", "file_path", "line_number", "source_tool", "severity", "id")


@query
def diff_issues(spark, sf):
    found = _issues(spark, sf)
    return fd.diff_issues(found.where(F.col("status") == "resolved"), found.where(F.col("status") == "open"))


@query
def score_repos(spark, sf):
    """Every analysis is scored, also those without findings."""
    found = _issues(spark, sf).withColumn("repo_id", F.col("analysis_id"))
    kept = fd.first_wins(found, fd.GLOBAL_KEY, ["seq_1", "seq_2", "seq_3", "seq_4"])
    facts = v.spark_view(spark, sf, v.ANALYSES).select(F.col("id").alias("repo_id"), "file_count", "has_tests", "has_docs")
    return sc.score_repos(kept, facts)


@query
def corpus_findings_by_rule(spark, sf):
    every = _files(spark, sf).unionByName(_manifests(spark, sf))
    return corpus_findings(every).groupBy("repo_id", "source_tool", "title", "severity").agg(F.count("*").alias("findings"))


@query
def corpus_scores(spark, sf):
    """Files to scores: rules, file checks, de-duplication and scoring of whole repositories."""
    files = _files(spark, sf)
    found = fd.dedup_findings(rl.scan_findings(files))
    return sc.score_repos(found, fl.repo_facts(files))


@query
def analysis_record(spark, sf):
    """Files to the stored row of a finished analysis."""
    files = _files(spark, sf)
    found = fd.dedup_findings(rl.scan_findings(files))
    record = an.analysis_record(fl.repo_stats(files), sc.score_repos(found, fl.repo_facts(files)))
    return record.select("repository_id", "status", "overall_score", "security_score", "file_count", "lines_of_code")


@query
def stored_issues(spark, sf):
    """Secrets found in files, written as issues and read again by their order of discovery."""
    found = rl.match_rules(_files(spark, sf), ("security",))
    place = scratch_path(spark, "issues")
    tb.write_issues(found, place)
    stored = tb.read_table(spark, "issues", place)
    return rp.numbered_issues(stored).select(
        "analysis_id", "title", "severity", "category", "file_path", "line_number", "language", "source_tool", "status"
    )


@query
def scanned_tree(spark, sf):
    """The documents written as a tree of files, one folder per source, and scanned back line by line."""
    place = scratch_path(spark, "tree") + "/repos"
    docs = spark.read.parquet(f"{sf.rstrip('/')}/documents.parquet")
    lines = docs.select("source", F.lit("in").alias("lang"), F.explode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line"))
    lines.write.partitionBy("source", "lang").text(place)
    files = tb.scan_files(spark, place).where(F.col("path").endswith(".txt") & F.col("path").startswith("lang=in/"))
    found = files.select("repo_id", F.explode(F.split("content", "\n", -1)).alias("line")).where("line <> ''")
    return found.groupBy(F.substring_index("repo_id", "=", -1).alias("source")).agg(
        F.count("*").alias("lines"), F.sum(F.char_length("line")).alias("chars")
    )


@query
def report_documents(spark, sf):
    """Every analysis's report as one JSON and one CSV file, written by many tasks, read back whole and taken apart."""
    place = scratch_path(spark, "documents")
    analyses, issues = _analyses(spark, sf), _issues(spark, sf).withColumn("risk", F.lit(None).cast("string"))
    rs.write_json_documents(rp.report_json(analyses, v.spark_view(spark, sf, v.REPOSITORIES), issues), f"{place}/json")
    rs.write_csv_documents(analyses, issues, f"{place}/csv")
    # Read as a tree by tasks: Spark's own text source needs a status of every file in the driver and a task for every few.
    document = "analysis struct<id: string, branch: string>, issues array<struct<id: string, title: string>>"
    value, sheet = F.col("raw").cast("string"), F.col("repo_id") == "csv"
    parsed = tree.read_tree(spark, place).select(
        "repo_id", F.regexp_extract("path", r"([^/]*)\.\w+$", 1).alias("analysis_id"),
        F.when(~sheet, F.from_json(value, document, {"mode": "FAILFAST"})).alias("d"),
        F.when(sheet, value.startswith("\ufefftitle,severity")).alias("marked"),
        F.when(sheet, F.size(F.split(value, "\r\n", -1)) - 2).cast("bigint").alias("rows"),
    )
    ids = F.transform("d.issues", lambda i: i["id"])
    facts = parsed.select(
        "repo_id", "analysis_id", F.col("d.analysis.branch").alias("branch"), F.size(ids).cast("bigint").alias("issues"),
        F.md5(F.encode(F.array_join(ids, ","), "utf-8")).alias("ids_in_order"), "marked", "rows",
    )
    facts.write.parquet(f"{place}-read")
    read = spark.read.schema(facts.schema).parquet(f"{place}-read")
    reports = read.where("repo_id = 'json'").select("analysis_id", "branch", "issues", "ids_in_order")
    return reports.join(read.where("repo_id = 'csv'").select("analysis_id", "marked", "rows"), "analysis_id")


@query
def scanned_files(spark, sf):
    """The documents written as a tree, one file each, with empty packages and READMEs beside them, listed and read back."""
    docs = spark.read.parquet(f"{sf.rstrip('/')}/documents.parquet")
    texts = docs.select(
        F.col("source").alias("repo_id"), F.concat(F.lit("docs/"), F.coalesce("lang", F.lit("_none")), F.lit("/"), F.col("doc_id"), F.lit(".txt")).alias("path"),
        F.coalesce("text", F.lit("")).alias("content"),
    )
    names = F.explode(F.array(*[F.lit(n) for n in EMPTY_FILES]))
    empty = docs.select(F.col("source").alias("repo_id")).distinct().select("repo_id", names.alias("path"), F.lit("").alias("content"))
    place = scratch_path(spark, "files") + "/repos"
    tree.write_tree(texts.unionByName(empty), place)
    files = tb.scan_files(spark, place)
    return files.select("repo_id", "path", "size_bytes", "is_symlink", F.char_length("content").cast("bigint").alias("chars"), F.md5(F.encode("content", "utf-8")).alias("digest"))


#: Empty files that make a package and a documented repository; two of the names are hidden from Spark's own sources.
EMPTY_FILES = ("pkg/__init__.py", "pkg/.keep", "README.md")


@query
def scanned_stats(spark, sf):
    """What counts per repository in the tree of ``scanned_files``: code files, among them the empty ones, and documentation."""
    docs = spark.read.parquet(f"{sf.rstrip('/')}/documents.parquet")
    code = docs.select(F.col("source").alias("repo_id"), F.concat(F.lit("src/d"), F.col("doc_id"), F.lit(".py")).alias("path"), F.coalesce("text", F.lit("")).alias("content"))
    names = F.explode(F.array(*[F.lit(n) for n in EMPTY_FILES]))
    empty = docs.select(F.col("source").alias("repo_id")).distinct().select("repo_id", names.alias("path"), F.lit("").alias("content"))
    place = scratch_path(spark, "code") + "/repos"
    tree.write_tree(code.unionByName(empty), place)
    files = tb.scan_files(spark, place)
    stats = fl.repo_stats(files).select("repo_id", "file_count", "lines_of_code")
    return stats.join(fl.repo_facts(files).select("repo_id", "has_docs"), "repo_id")


@query
def parsed_events(spark, sf):
    """Progress events as JSON text, among lines that are no events, read back."""
    events = v.spark_view(spark, sf, v.EVENTS)
    text = events.select(F.to_json(F.struct(F.col("analysis_id"), "event_id", "status", "progress_percent", "error_message")).alias("value"))
    noise = events.where("event_id % 7 = 0").select(F.explode(F.array(F.lit("not json"), F.lit("{}"), F.lit(""))).alias("value"))
    return sp.parse_events(text.unionByName(noise)).drop("ts")


@query
def severity_counts(spark, sf):
    return sc.severity_counts(_issues(spark, sf))


@query
def findings_total(spark, sf):
    return sc.findings_total(_issues(spark, sf))


@query
def repo_summary(spark, sf):
    return sc.repo_summary(v.spark_view(spark, sf, v.REPOSITORIES))


@query
def corpus_rollup(spark, sf):
    return sc.corpus_rollup(_issues(spark, sf))


# Issue tables

@query
def owned_analyses(spark, sf):
    return iss.owned_analyses(_analyses(spark, sf), v.spark_view(spark, sf, v.REPOSITORIES), "7").select(
        "id", "repository_id", "owner_id", "repository_name", "status", "lines_of_code"
    )


@query
def query_issues(spark, sf):
    return iss.query_issues(_issues(spark, sf), severity="high", category="", language="Python").select(*ISSUE)


@query
def search_issues(spark, sf):
    return iss.search_issues(_issues(spark, sf), " Seen BY r ", severity="low").select(*ISSUE)


@query
def dependency_issues(spark, sf):
    return iss.dependency_issues(_issues(spark, sf)).select(*ISSUE)


@query
def list_repositories(spark, sf):
    repos = v.spark_view(spark, sf, v.REPOSITORIES).withColumn("created_at", F.col("c_acctbal"))
    return iss.list_repositories(repos, "3").select("id", "name", "full_name", "is_private")


# Three updates per issue, one of them in front; issues of some parts are unknown.
UPDATES = " UNION ALL ".join(
    f"""
SELECT CASE WHEN l_partkey % 9 = 0 THEN 'unknown' ELSE CAST(l_orderkey AS STRING) END AS analysis_id,
       CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-'
         || CAST(l_suppkey AS STRING) AS issue_id,
       {status} AS status,
       {fix} AS suggested_fix,
       CAST(NULL AS STRING) AS generated_patch,
       l_shipdate AS shipped, CASE WHEN l_suppkey % 3 = {k} THEN 9 ELSE {k} END AS nth
FROM $lineitem$"""
    for k, (status, fix) in enumerate((
        ("'false_positive'", "CAST(NULL AS STRING)"),
        ("CAST(NULL AS STRING)", "'explained ' || CAST(l_partkey AS STRING)"),
        ("'resolved'", "CAST(NULL AS STRING)"),
    ))
)


def _updates(spark, sf):
    return v.spark_view(spark, sf, UPDATES).withColumn("updated_at", F.struct("shipped", "nth"))


@query
def apply_issue_updates(spark, sf):
    return iss.apply_issue_updates(_issues(spark, sf), _updates(spark, sf)).select("id", "analysis_id", "status", "suggested_fix")


@query
def unmatched_updates(spark, sf):
    return iss.unmatched_updates(_issues(spark, sf), _updates(spark, sf)).select("analysis_id", "issue_id", "nth")


@query
def upsert_repositories(spark, sf):
    return iss.upsert_repositories(v.spark_view(spark, sf, v.REPOSITORIES), v.spark_view(spark, sf, v.REPO_REQUESTS))


PULLS = """
SELECT CAST(l_orderkey AS STRING) AS analysis_id, CASE WHEN l_linestatus = 'O' THEN 'open' ELSE 'closed' END AS status
FROM $lineitem$
"""


@query
def merge_repositories(spark, sf):
    return iss.merge_repositories(v.spark_view(spark, sf, v.REPOSITORIES), v.spark_view(spark, sf, v.REPO_REQUESTS))


@query
def rejected_repositories(spark, sf):
    return iss.rejected_repositories(v.spark_view(spark, sf, v.REPO_REQUESTS)).select("request_id", "clone_url")


@query
def analyses_needing_pr(spark, sf):
    return iss.analyses_needing_pr(_analyses(spark, sf), v.spark_view(spark, sf, PULLS)).select("id", "repository_id", "status")


@query
def top_findings(spark, sf):
    by_repo = _issues(spark, sf).withColumn("analysis_id", F.col("repo_id"))
    return iss.top_findings(by_repo, 200).select("analysis_id", "position", "id", "title")


# Patches

@query
def latest_patches(spark, sf):
    return pt.latest_patches(_issues(spark, sf), "repo_id").select("repo_id", "file_path", "id", "generated_patch")


@query
def patch_commit_check(spark, sf):
    return pt.patch_commit_check(pt.latest_patches(_issues(spark, sf), "repo_id")).select("repo_id", "file_path", "id", "reject_reason")


@query
def patch_generation_check(spark, sf):
    return pt.patch_generation_check(v.spark_view(spark, sf, v.RESPONSES)).select("issue_id", "file_path", "reject_reason")


@query
def pr_change_set(spark, sf):
    return pt.pr_change_set(_issues(spark, sf))


@query
def parse_fix_sections(spark, sf):
    return pt.parse_fix_sections(v.spark_view(spark, sf, v.RESPONSES)).select(
        "issue_id", "improved_code", "explanation", "side_effects", "improvement", "valid"
    )


@query
def clean_fences(spark, sf):
    fenced = v.spark_view(spark, sf, FENCED)
    return fenced.select("doc_id", pt.clean_fences("body").alias("cleaned"), pt.clean_code_error(pt.clean_fences("body")).alias("error"))


FENCED = """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '```python' || chr(10) || text || chr(10) || '```' WHEN 1 THEN ' ``` ' || text
         WHEN 2 THEN text || ' ``` x' ELSE 'Explanation: ' || text END AS body
FROM $documents$
"""


# Tests to write

def _file_issues(spark, sf):
    return rl.match_rules(_files(spark, sf), ("security",))


@query
def test_candidates(spark, sf):
    return tp.test_candidates(_file_issues(spark, sf), _files(spark, sf))


@query
def suggested_tests(spark, sf):
    every = fl.with_language(_files(spark, sf)).select("repo_id", "path", "language")
    return tp.suggested_tests(every)


@query
def source_excerpts(spark, sf):
    files = _files(spark, sf)
    listed = fl.with_language(files).select("repo_id", "path", "language")
    return tp.source_excerpts(listed, files, limit=14_000)


# Chunks and retrieval

@query
def chunk_files(spark, sf):
    return ch.chunk_files(_files(spark, sf))


@query
def build_chunk_index(spark, sf):
    return ch.build_chunk_index(_files(spark, sf)).select("repo_id", "chunk_id", "file_path", "start_line", "end_line")


@query
def updated_chunk_index(spark, sf):
    """An index of earlier versions of the files, their vectors, and an update to the files as they are: chunks whose content
    stayed keep the vector, which here is their length."""
    files, place = _files(spark, sf), scratch_path(spark, "chunk-index")
    earlier = F.when(F.col("path").endswith(".py"), F.concat(F.lit("# earlier\n"), "content", F.lit("\n# earlier"))).otherwise(F.col("content"))
    cs.update_chunk_index(ch.chunk_files(files.withColumn("content", earlier)), place, buckets=32)
    cs.set_vectors(cs.without_vectors(spark, place).withColumn("embedding", F.array(F.char_length("content").cast("float"))), place)
    cs.update_chunk_index(ch.chunk_files(files), place, buckets=32)
    rows = cs.read_chunk_index(spark, place)
    kept = F.coalesce(F.col("embedding")[0] == F.char_length("content"), F.col("file_path").endswith(".py")).alias("vector_kept")
    return rows.select("repo_id", "chunk_id", "file_path", "start_line", "end_line", F.md5(F.encode("content", "utf-8")).alias("digest"), kept)


@query
def retrieve_chunks(spark, sf):
    found = rt.retrieve_chunks(v.spark_view(spark, sf, v.QUESTIONS), v.spark_view(spark, sf, v.CHUNKS))
    return found.select("question_id", "repo_id", "chunk_id", "rank", F.round("distance", 6).alias("distance"))


@query
def indexed_retrieval(spark, sf):
    """The chunks stored in the lists of an inverted-file index and searched in all of their repository's lists."""
    place = scratch_path(spark, "vector-index")
    index = vi.build_vector_index(v.spark_view(spark, sf, v.CHUNKS), place)
    found = vi.search_vectors(v.spark_view(spark, sf, v.QUESTIONS), index, probes=None)
    return found.select("question_id", "repo_id", "chunk_id", "rank", F.round("distance", 6).alias("distance"))


@query
def rag_context(spark, sf):
    return rt.rag_context(v.spark_view(spark, sf, v.QUESTIONS), v.spark_view(spark, sf, v.CHUNKS), content_chars=1500)


@query
def append_chat_turns(spark, sf):
    chat = v.spark_view(spark, sf, v.CHAT)
    answers = chat.select("session_id", "turn", "answer", F.array("ref_a", "ref_b").alias("refs"))
    return tb.append_chat_turns(chat.select("session_id", "turn", "message"), answers)


# Evidence and exports

@query
def architecture_evidence(spark, sf):
    return evidence.architecture_evidence(_files(spark, sf), entries=400)


@query
def documentation_evidence(spark, sf):
    every = _files(spark, sf).unionByName(_manifests(spark, sf))
    return evidence.documentation_evidence(every, entries=250).select("repo_id", "section_no", "section", "line")


@query
def routes(spark, sf):
    return py.routes(_files(spark, sf)).withColumn("methods", F.array_join("methods", ","))


@query
def env_vars(spark, sf):
    return py.env_vars(_files(spark, sf))


@query
def route_methods(spark, sf):
    return py.route_methods(_files(spark, sf))


@query
def variable_table(spark, sf):
    return py.variable_table(_files(spark, sf))


@query
def export_issues_csv(spark, sf):
    return rp.export_rows(_issues(spark, sf))


@query
def report_markdown(spark, sf):
    return rp.report_markdown(_analyses(spark, sf), v.spark_view(spark, sf, v.REPOSITORIES), _issues(spark, sf))


@query
def report_json(spark, sf):
    return rp.report_json(_analyses(spark, sf), v.spark_view(spark, sf, v.REPOSITORIES),
                          _issues(spark, sf).withColumn("risk", F.lit(None).cast("string")))


@query
def numbered_issues(spark, sf):
    by_repo = _issues(spark, sf).withColumn("analysis_id", F.col("repo_id"))
    return rp.numbered_issues(by_repo).select("analysis_id", "number", "id")


@query
def report_labels(spark, sf):
    """Links, locations, bands and names that reports print."""
    i = _issues(spark, sf)
    return i.select(
        "id",
        naming.location("file_path", "line_number").alias("location"),
        naming.blob_url(F.concat(F.lit("https://github.com/o/"), "repo_id", F.lit(".git")), F.lit("a b/(c)"),
                        F.concat("file_path", F.lit("\\#é!")), "line_number").alias("url"),
        naming.score_band(F.col("line_number") * 30).alias("band"),
        naming.safe_file_name(F.concat(F.lit("-é "), "title")).alias("file_name"),
    )


@query
def branch_defaults(spark, sf):
    r = v.spark_view(spark, sf, v.REPOSITORIES)
    return r.select("id", naming.default_branch(F.when(F.col("is_private"), "  ").otherwise(F.substring("name", 16, 1)),
                                               "default_branch").alias("branch"))


# Progress

@query
def latest_status(spark, sf):
    return pg.latest_status(v.spark_view(spark, sf, v.EVENTS))


@query
def progress_sessions(spark, sf):
    return pg.progress_sessions(v.spark_view(spark, sf, v.EVENTS))


@query
def stage_durations(spark, sf):
    return pg.stage_durations(v.spark_view(spark, sf, v.EVENTS)).select("analysis_id", "event_id", "status", "seconds")


@query
def step_state(spark, sf):
    steps = F.explode(F.array(*[F.lit(s) for s in naming.STEPS[1:-1]]))
    return v.spark_view(spark, sf, v.EVENTS).select("event_id", "status", steps.alias("step")).withColumn(
        "state", naming.step_state("step", "status")
    )


def _stream_table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def _stream_view(spark: SparkSession, sf: str, sql: str, name: str) -> DataFrame:
    view = f"stream_{name}"
    _stream_table(spark, sf, name).createOrReplaceTempView(view)
    return v.spark_view(spark, sf, sql.replace(f"${name}$", view))


@query
def stream_rules(spark, sf):
    files = _stream_view(spark, sf, v.FILES, "documents")
    return ss.run_available(ss.stream_rules(files, ("security",)).select(*FINDING), "stream-rules")


def _timed_events(spark, sf, slices: int = 3, jitter_seconds: int = 0):
    """The events as JSON lines that arrive slice by slice, each one micro-batch of as many files as there are shuffle
    partitions. They arrive in time order, or up to ``jitter_seconds`` later than their time, each by a hash of its id."""
    events = v.spark_view(spark, sf, v.EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))
    at = F.unix_micros("ts") + F.pmod(F.xxhash64("event_id"), F.lit(jitter_seconds * 1_000_000)) if jitter_seconds else F.unix_micros("ts")
    shares = [i / slices for i in range(1, slices)]
    ends = events.agg(F.percentile_approx(at, shares, F.lit(1000))).first()[0] or []
    folder, files = scratch_path(spark, "events"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.to_json(F.struct("analysis_id", "event_id", "status", "progress_percent", "error_message", "ts"),
                     {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}).alias("value")
    # A line that is no event in every part: each part is one file of each slice, so that the count of files is the slice's.
    marks = spark.range(files).select(F.lit("-").alias("value"), F.col("id").cast("int").alias("part"))
    for low, high in zip([None, *ends], [*ends, None]):
        part = events if low is None else events.where(at > low)
        lines = (part if high is None else part.where(at <= high)).select(text, F.pmod(F.xxhash64("event_id", "ts"), F.lit(files)).cast("int").alias("part"))
        lines.unionByName(marks).repartition(files, "part").write.mode("append").partitionBy("part").text(folder)
    return sp.progress_stream(spark, folder, max_files_per_trigger=files)


@query
def latest_status_stream(spark, sf):
    stream = sp.latest_status_stream(_timed_events(spark, sf))
    last = ss.run_updates(stream, ["analysis_id"], "latest-status", newest=("ts",))
    return last.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query
def log_stream(spark, sf):
    """Events as logs of their analyses: a stream reads the first half, stops, and reads on when the rest has come."""
    events = v.spark_view(spark, sf, v.EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))
    place = scratch_path(spark, "progress-logs")
    text = F.to_json(F.struct("event_id", "status", "progress_percent", "error_message", "ts"), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    middle = events.agg(F.percentile_approx(F.unix_micros("ts"), 0.5)).first()[0] or 0
    lines = events.select("analysis_id", text.alias("value"), "ts", (F.unix_micros("ts") <= middle).alias("early"))
    stream = lg.log_stream(spark, f"{place}/logs")
    for early in (True, False):
        lg.write_logs(lines.where(F.col("early") == early), f"{place}/logs")
        lg.write_logs(lines.where(F.col("early") == early).select("analysis_id", F.lit("no event").alias("value"), "ts"), f"{place}/logs")
        run = stream.writeStream.format("parquet").option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start(f"{place}/out")
        run.awaitTermination()
    found = spark.read.schema(stream.schema).parquet(f"{place}/out")
    return found.select("analysis_id", "event_id", "status", "progress_percent", "error_message", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query
def progress_sessions_stream(spark, sf):
    """Lists that have expired by the end of the stream, per the watermark."""
    sessions = sp.progress_sessions_stream(_timed_events(spark, sf), delay="0 seconds")
    done = ss.run_available(sessions, "sessions")
    return done.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "expires_at")})


@query
def stage_durations_stream(spark, sf):
    """Events arrive out of order within the delay; what the watermark has passed by the end is told."""
    return ss.run_available(sp.stage_durations_stream(_timed_events(spark, sf, jitter_seconds=599)), "durations")


@query
def stalled_stages_stream(spark, sf):
    told = ss.run_available(sp.stage_events_stream(_timed_events(spark, sf, jitter_seconds=599)), "stalled")
    return told.where("kind <> 'stage'").select("kind", "analysis_id", "event_id", "status", "seconds")
