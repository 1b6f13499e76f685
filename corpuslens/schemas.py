"""Table schemas (as DDL) and the allowed values of their enumerated columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FILES = (
    "repo_id string, path string, size_bytes bigint, is_symlink boolean, content string, utf8_valid boolean"
)
ISSUES = (
    "id string, analysis_id string, title string, severity string, category string, file_path string, "
    "line_number int, language string, description string, risk string, suggested_fix string, "
    "generated_patch string, source_tool string, status string, created_at timestamp, seq_major bigint, seq_minor bigint"
)
TABLES = {
    "users": "id string, email string, full_name string, avatar_url string, created_at timestamp",
    "repositories": "id string, owner_id string, name string, full_name string, clone_url string, "
    "is_private boolean, default_branch string, created_at timestamp",
    "repository_branches": "id string, repository_id string, name string",
    "analyses": "id string, repository_id string, branch string, status string, progress_percent int, "
    "modules_enabled array<string>, overall_score int, security_score int, maintainability_score int, "
    "performance_score int, documentation_score int, testing_score int, architecture_score int, "
    "file_count int, lines_of_code int, languages array<string>, architecture_summary string, "
    "error_message string, created_at timestamp, completed_at timestamp",
    "issue_updates": "analysis_id string, issue_id string, status string, suggested_fix string, "
    "generated_patch string, updated_at timestamp",
    "generated_tests": "id string, analysis_id string, target_file string, framework string, "
    "file_name string, content string, created_at timestamp",
    "generated_documents": "id string, analysis_id string, doc_type string, title string, "
    "content string, created_at timestamp",
    "chat_sessions": "id string, repository_id string, user_id string, created_at timestamp",
    "chat_messages": "id string, session_id string, role string, content string, "
    "referenced_files array<string>, created_at timestamp",
    "reports": "id string, analysis_id string, format string, file_path string, created_at timestamp",
    "pull_requests": "id string, analysis_id string, github_pr_number int, github_pr_url string, "
    "title string, status string, created_at timestamp",
    "tool_reports": "repo_id string, tool string, report string",
    "progress_events": "analysis_id string, status string, progress_percent int, error_message string, ts timestamp",
    "questions": "question_id string, repo_id string, text string, embedding array<float>",
    "chunk_embeddings": "repo_id string, chunk_id string, file_path string, start_line int, end_line int, "
    "content string, embedding array<float>",
    "fix_responses": "issue_id string, file_path string, language string, original_code string, raw_response string",
}
SCHEMAS = TABLES | {"files": FILES, "issues": ISSUES}

# The enumerations of the data model, in their defined order.
ANALYSIS_STATUSES = (
    "pending", "cloning", "detecting_languages", "running_static_analysis", "building_index",
    "running_ai_review", "generating_report", "complete", "failed",
)
SEVERITIES = ("critical", "high", "medium", "low", "info")
CATEGORIES = ("bug", "security", "performance", "architecture", "code_quality", "documentation", "testing")
ISSUE_STATUSES = ("open", "resolved", "false_positive")

FINDING_COLUMNS = (
    "repo_id", "title", "severity", "category", "file_path", "line_number", "language", "description",
    "risk", "suggested_fix", "generated_patch", "source_tool", "seq_major", "seq_minor",
)


def content_key(*cols: Column | str) -> Column:
    """Deterministic row key. NULL, 0 and '' all hash differently."""
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("∅")) for c in cols]
    return F.sha2(F.concat_ws("\u0001", *parts), 256)
