"""Linter reports (JSON text) to findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.catalogue import SCRIPT_LANGUAGES, SEQ
from corpuslens.functions.lookup import lookup
from corpuslens.functions.predicates import language_of, not_in_ignored_dir
from corpuslens.functions.text import strip_dot_slash

BANDIT = (
    "struct<results:array<struct<test_name:string,issue_severity:string,filename:string,line_number:int,"
    "issue_text:string,issue_confidence:string>>>"
)
RUFF = (
    "array<struct<code:string,message:string,filename:string,location:struct<row:int>,fix:struct<message:string>>>"
)
ESLINT = (
    "array<struct<filePath:string,messages:array<struct<ruleId:string,severity:int,line:int,message:string>>>>"
)
NPM = "struct<vulnerabilities:map<string,struct<severity:string>>>"
RADON_BLOCK = "array<struct<name:string,lineno:int,complexity:int>>"


def _of_tool(reports: DataFrame, tool: str) -> DataFrame:
    return reports.where(F.col("tool") == tool)


def _layout(df: DataFrame, tool: str, seq: str, minor: int, **cols: Column) -> DataFrame:
    none = F.lit(None).cast("string")
    given = {"risk": none, "suggested_fix": none, **cols}
    return df.select(
        "repo_id",
        given["title"].alias("title"),
        given["severity"].alias("severity"),
        given["category"].alias("category"),
        given["file_path"].alias("file_path"),
        given["line_number"].cast("int").alias("line_number"),
        given["language"].alias("language"),
        given["description"].alias("description"),
        given["risk"].alias("risk"),
        given["suggested_fix"].alias("suggested_fix"),
        none.alias("generated_patch"),
        F.lit(tool).alias("source_tool"),
        F.lit(SEQ[seq]).alias("seq_major"),
        # Report order within a tool: the outer and inner positions of the entry.
        (F.lit(minor * 10**15).cast("bigint") + F.col("_at")).alias("seq_minor"),
    )


def ingest_bandit(reports: DataFrame) -> DataFrame:
    rows = (
        _of_tool(reports, "bandit")
        .select("repo_id", F.posexplode(F.from_json("report", BANDIT)["results"]).alias("_at", "r"))
    )
    r = F.col("r")
    level = lookup(r["issue_severity"], {"HIGH": "high", "MEDIUM": "medium", "LOW": "low"})
    return _layout(
        rows, "bandit", "python", 0,
        title=F.coalesce(r["test_name"], F.lit("Security issue")),
        severity=F.coalesce(level, F.lit("medium")),
        category=F.lit("security"),
        file_path=strip_dot_slash(F.coalesce(r["filename"], F.lit(""))),
        line_number=r["line_number"],
        language=F.lit("Python"),
        description=r["issue_text"],
        risk=F.concat(F.lit("Confidence: "), F.coalesce(r["issue_confidence"], F.lit("UNKNOWN"))),
    )


def ingest_ruff(reports: DataFrame) -> DataFrame:
    rows = _of_tool(reports, "ruff").select("repo_id", F.posexplode(F.from_json("report", RUFF)).alias("_at", "r"))
    r = F.col("r")
    code = F.coalesce(r["code"], F.lit(""))
    bug = code.startswith("F") | code.startswith("E7") | code.startswith("E9")
    return _layout(
        rows, "ruff", "python", 1,
        title=F.coalesce(r["message"], F.lit("Lint issue")),
        severity=F.when(bug, "medium").otherwise("low"),
        category=F.when(bug, "bug").otherwise("code_quality"),
        file_path=strip_dot_slash(F.coalesce(r["filename"], F.lit(""))),
        line_number=r["location"]["row"],
        language=F.lit("Python"),
        description=F.concat(F.lit("["), code, F.lit("] "), F.coalesce(r["message"], F.lit("None"))),
        suggested_fix=r["fix"]["message"],
    )


def ingest_radon(reports: DataFrame) -> DataFrame:
    """Blocks of complexity 10 and more. A file whose entry is not a list of blocks is passed over."""
    entries = F.try_variant_get(F.try_parse_json("report"), "$", "map<string,variant>")
    per_file = _of_tool(reports, "radon").select("repo_id", F.explode(entries).alias("file", "_v"))
    rows = per_file.select(
        "repo_id", "file", F.posexplode(F.try_variant_get("_v", "$", RADON_BLOCK)).alias("_at", "r")
    ).where(F.col("r.complexity") >= 10)
    r = F.col("r")
    name = F.coalesce(r["name"], F.lit("None"))
    return _layout(
        rows, "radon", "python", 2,
        # Fixed value: the title.
        title=F.concat(F.lit("High cyclomatic complexity in `"), name, F.lit("`")),
        severity=F.when(r["complexity"] >= 20, "high").otherwise("medium"),
        category=F.lit("code_quality"),
        file_path=strip_dot_slash("file"),
        line_number=r["lineno"],
        language=F.lit("Python"),
        description=F.concat(F.lit("Complexity "), r["complexity"].cast("string"), F.lit(" in "), name),
        risk=F.lit("Such code is hard to test."),
        suggested_fix=F.lit("Split it into smaller parts."),
    )


def ingest_eslint(reports: DataFrame) -> DataFrame:
    """A ``repo_root`` column, if present, is the prefix that file paths are made relative to."""
    root = F.col("repo_root") if "repo_root" in reports.columns else F.lit("")
    files = _of_tool(reports, "eslint").select(
        "repo_id", root.alias("_root"), F.posexplode(F.from_json("report", ESLINT)).alias("_f", "file")
    )
    rows = files.select("repo_id", "_root", "_f", "file.filePath", F.posexplode("file.messages").alias("_m", "r"))
    rows = rows.withColumn("_at", F.col("_f").cast("bigint") * 1_000_000 + F.col("_m"))
    r = F.col("r")
    rule = F.coalesce(r["ruleId"], F.lit(""))
    path = F.coalesce(F.col("filePath"), F.lit(""))
    under = (F.col("_root") != "") & path.startswith(F.concat(F.col("_root"), F.lit("/")))
    return _layout(
        rows, "eslint", "javascript", 0,
        title=F.when(rule == "", "Lint issue").otherwise(rule),
        severity=F.when(r["severity"] == 2, "high").otherwise("low"),
        category=F.when(rule.contains("security"), "security").otherwise("code_quality"),
        file_path=F.when(under, F.substring(path, F.char_length("_root") + 2, F.char_length(path))).otherwise(path),
        line_number=r["line"],
        language=F.lit("JavaScript/TypeScript"),
        description=r["message"],
    )


def ingest_npm_audit(reports: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Vulnerable packages; with ``files``, only for repositories that have a package.json at the root."""
    chosen = _of_tool(reports, "npm-audit")
    if files is not None:
        roots = files.where(F.col("path") == "package.json").select("repo_id")
        chosen = chosen.join(roots, "repo_id", "left_semi")
    entries = F.map_entries(F.from_json("report", NPM)["vulnerabilities"])
    rows = chosen.select("repo_id", F.posexplode(entries).alias("_at", "r"))
    name, level = F.col("r.key"), F.col("r.value.severity")
    mapped = lookup(level, {"critical": "critical", "high": "high", "moderate": "medium", "low": "low"})
    return _layout(
        rows, "npm-audit", "javascript", 1,
        title=F.concat(F.lit("Vulnerable dependency: "), name),
        severity=F.coalesce(mapped, F.lit("medium")),
        category=F.lit("security"),
        file_path=F.lit("package.json"),
        line_number=F.lit(None),
        language=F.lit("JavaScript/TypeScript"),
        description=F.concat(name, F.lit(" has known vulnerabilities, severity "), F.coalesce(level, F.lit("None"))),
        risk=F.lit("Published details help an attacker."),
        suggested_fix=F.lit("Move to a fixed version."),
    )


def gate_by_language(reports: DataFrame, files: DataFrame) -> DataFrame:
    """Keeps Python reports of repositories with Python files and script reports of those with script files."""
    langs = (
        files.where(not_in_ignored_dir("path", "language"))
        .select("repo_id", language_of("path").alias("language"))
        .where(F.col("language").isin("Python", *SCRIPT_LANGUAGES))
        .select("repo_id", F.when(F.col("language") == "Python", "python").otherwise("script").alias("_group"))
        .distinct()
    )
    group = F.when(F.col("tool").isin("bandit", "ruff", "radon"), "python").otherwise("script")
    return reports.withColumn("_group", group).join(langs, ["repo_id", "_group"], "left_semi").drop("_group")


def ingest_reports(reports: DataFrame, files: DataFrame) -> DataFrame:
    gated = gate_by_language(reports, files)
    return (
        ingest_bandit(gated)
        .unionByName(ingest_ruff(gated))
        .unionByName(ingest_radon(gated))
        .unionByName(ingest_eslint(gated))
        .unionByName(ingest_npm_audit(gated, files))
    )
