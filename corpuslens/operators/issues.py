"""Issue tables: queries, updates, ownership and repository upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions.naming import parse_repo_url
from corpuslens.schemas import content_key

SEARCH_COLUMNS = ("title", "description", "file_path", "category", "severity", "source_tool", "language", "status")


def query_issues(issues: DataFrame, **equals: str | None) -> DataFrame:
    """Equality filters on severity, category, file_path or language; None and '' mean no filter."""
    for name, value in equals.items():
        if value:
            issues = issues.where(F.col(name) == value)
    return issues


def search_issues(issues: DataFrame, text: str = "", severity: str = "all", category: str | None = None) -> DataFrame:
    """Case-insensitive substring over eight columns, with optional severity and category."""
    if category:
        issues = issues.where(F.col("category") == category)
    if severity != "all":
        issues = issues.where(F.col("severity") == severity)
    needle = text.strip().lower()
    if needle:
        hit = F.lit(False)
        for name in SEARCH_COLUMNS:
            hit = hit | F.coalesce(F.lower(F.col(name)).contains(needle), F.lit(False))
        issues = issues.where(hit)
    return issues


def dependency_issues(issues: DataFrame) -> DataFrame:
    return issues.where((F.col("source_tool") == "npm-audit") | F.lower("title").contains("dependency"))


def ordered_issues(issues: DataFrame) -> DataFrame:
    """By analysis and creation; issues created together in the order they were found in, where that is stored."""
    return issues.orderBy(*[c for c in ("analysis_id", "created_at", "seq_major", "seq_minor", "id") if c in issues.columns])


def list_repositories(repositories: DataFrame, owner: Column | str) -> DataFrame:
    return repositories.where(F.col("owner_id") == owner).orderBy(F.col("created_at").desc(), "id")


def owned_analyses(analyses: DataFrame, repositories: DataFrame, owner=None) -> DataFrame:
    """Analyses joined with their repository; with ``owner``, only that owner's, filtered before the join."""
    if owner is not None:
        repositories = repositories.where(F.col("owner_id") == owner)
    repos = repositories.select(
        F.col("id").alias("repository_id"), "owner_id", F.col("name").alias("repository_name"), "clone_url"
    )
    return analyses.join(repos, "repository_id")


def apply_issue_updates(issues: DataFrame, updates: DataFrame) -> DataFrame:
    """Issues with their updates applied in order: each field takes the newest value that is not NULL.

    One aggregate, so an issue with many updates arrives as one row per map task.
    """

    def newest(field: str, out: str) -> Column:
        given = F.when(F.col(field).isNotNull(), F.struct("updated_at", F.col(field).alias("value")))
        return F.max(given)["value"].alias(out)

    changed = updates.groupBy("analysis_id", F.col("issue_id").alias("id")).agg(
        newest("status", "_status"), newest("suggested_fix", "_fix"), newest("generated_patch", "_patch")
    )
    out = issues.join(changed, ["analysis_id", "id"], "left")
    return (
        out.withColumn("status", F.coalesce("_status", "status"))
        .withColumn("suggested_fix", F.coalesce("_fix", "suggested_fix"))
        .withColumn("generated_patch", F.coalesce("_patch", "generated_patch"))
        .drop("_status", "_fix", "_patch")
        .select(*issues.columns)
    )


def unmatched_updates(issues: DataFrame, updates: DataFrame) -> DataFrame:
    """Updates that name no known issue."""
    known = issues.select("analysis_id", F.col("id").alias("issue_id"))
    return updates.join(known, ["analysis_id", "issue_id"], "left_anti")


def analyses_needing_pr(analyses: DataFrame, pull_requests: DataFrame) -> DataFrame:
    """Analyses without an open pull request."""
    taken = pull_requests.where(F.col("status") == "open").select(F.col("analysis_id").alias("id"))
    return analyses.join(taken, "id", "left_anti")


def upsert_repositories(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Updates or inserts connected repositories; returns one row per valid request with its action.

    A request matches the owner's repository by full name, else by one of three spellings of its URL.
    Both are equi-joins; the best match per request is kept. Of several requests for a repository that is new, the
    first by request_id inserts it, under an id made from owner and full name; the others update it. A request that
    leaves the branch open keeps the one that the last request before it has given. Requests with an invalid URL are left
    out, see rejected_repositories.
    """
    parsed = incoming.withColumn("_p", parse_repo_url("clone_url")).where(F.col("_p.error").isNull()).select(
        "request_id", "owner_id", "clone_url", "is_private", "default_branch",
        F.col("_p.name").alias("_name"), F.col("_p.full_name").alias("_full"), F.col("_p.normalized_url").alias("_url"),
    )
    keys = existing.select(
        F.col("id").alias("_id"), "owner_id", F.col("full_name").alias("_full"),
        F.col("clone_url").alias("_known"), F.col("default_branch").alias("_branch"),
    )
    by_name = parsed.select("request_id", "owner_id", "_full").join(
        keys.select("_id", "_branch", "owner_id", "_full"), ["owner_id", "_full"]
    ).select("request_id", F.lit(0).alias("_tier"), "_id", "_branch")
    spelled = parsed.select(
        "request_id", "owner_id",
        F.explode(F.array_distinct(F.array("clone_url", "_url", F.concat("_url", F.lit(".git"))))).alias("_known"),
    )
    by_url = spelled.join(keys.select("_id", "_branch", "owner_id", "_known"), ["owner_id", "_known"]).select(
        "request_id", F.lit(1).alias("_tier"), "_id", "_branch"
    )
    best = by_name.unionByName(by_url).groupBy("request_id").agg(
        F.min(F.struct("_tier", "_id", "_branch")).alias("_m")
    )
    opens = parsed.groupBy("owner_id", "_full").agg(F.min("request_id").alias("_first"))
    new = F.col("_m").isNull()
    matched = parsed.join(best, "request_id", "left").join(opens, ["owner_id", "_full"])
    matched = matched.withColumn("_to", F.coalesce("_m._id", content_key("owner_id", "_full")))
    earlier = Window.partitionBy("_to").orderBy("request_id").rowsBetween(Window.unboundedPreceding, 0)
    matched = matched.withColumn("_asked", F.last(F.nullif("default_branch", F.lit("")), ignorenulls=True).over(earlier))
    return matched.select(
        "request_id",
        F.when(new & (F.col("request_id") == F.col("_first")), "insert").otherwise("update").alias("action"),
        F.col("_to").alias("id"),
        "owner_id",
        F.col("_name").alias("name"),
        F.col("_full").alias("full_name"),
        F.col("_url").alias("clone_url"),
        "is_private",
        F.coalesce("_asked", F.nullif(F.col("_m._branch"), F.lit("")), F.lit("main")).alias("default_branch"),
    )


def merge_repositories(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """The repositories after all requests, in order of request_id: (id, owner_id, name, full_name, clone_url,
    is_private, default_branch). The last request of a repository counts; a branch it leaves open stays as it was.
    """
    columns = ["id", "owner_id", "name", "full_name", "clone_url", "is_private"]
    asked = incoming.select("request_id", F.nullif("default_branch", F.lit("")).alias("_asked"))
    requests = upsert_repositories(existing, incoming).join(asked, "request_id")
    given = F.when(F.col("_asked").isNotNull(), F.struct("request_id", "_asked"))
    news = requests.groupBy("id").agg(
        F.max(F.struct("request_id", *[F.col(c) for c in columns[1:]])).alias("_n"), F.max(given)["_asked"].alias("_branch")
    )
    old = existing.select("id", F.struct(*columns[1:], "default_branch").alias("_o"))
    both = old.join(news, "id", "full_outer")
    fields = [F.when(F.col("_n").isNotNull(), F.col(f"_n.{c}")).otherwise(F.col(f"_o.{c}")).alias(c) for c in columns[1:]]
    branch = F.when(F.col("_n").isNull(), F.col("_o.default_branch")).otherwise(
        F.coalesce("_branch", F.nullif(F.col("_o.default_branch"), F.lit("")), F.lit("main"))
    )
    return both.select("id", *fields, branch.alias("default_branch"))


def rejected_repositories(incoming: DataFrame) -> DataFrame:
    return incoming.withColumn("reason", parse_repo_url("clone_url")["error"]).where(F.col("reason").isNotNull())


def top_findings(issues: DataFrame, n: int = 200) -> DataFrame:
    """The first n findings of every analysis, numbered. Map tasks already drop what lies beyond n."""
    w = Window.partitionBy("analysis_id").orderBy("created_at", "id")
    return issues.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)


