"""Small derived values: names, labels, URLs and bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslens import catalogue as cat
from corpuslens.functions.lookup import contains_any, lookup
from corpuslens.functions.text import stem, strip

# Steps of an analysis in order.
STEPS = (
    "pending", "cloning", "detecting_languages", "running_static_analysis", "building_index",
    "running_ai_review", "generating_report", "complete",
)


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def suggested_framework(language: Column | str, path: Column | str) -> Column:
    language, path = _c(language), _c(path)
    endpoint = F.when(
        contains_any(F.lower(path), cat.ENDPOINT_MARKERS), lookup(language, cat.ENDPOINT_FRAMEWORK)
    )
    return F.coalesce(endpoint, lookup(language, cat.TEST_FRAMEWORK), F.lit(cat.TEST_FRAMEWORK_DEFAULT))


def test_file_name(language: Column | str, path: Column | str) -> Column:
    base = stem(path)
    capital = F.concat(
        F.upper(F.substring(base, F.lit(1), F.lit(1))), F.lower(F.substring(base, F.lit(2), F.char_length(base)))
    )
    form = F.coalesce(lookup(_c(language), cat.TEST_FILE_NAME), F.lit(cat.TEST_FILE_DEFAULT))
    return F.replace(F.replace(form, F.lit("{b}"), base), F.lit("{c}"), capital)


def safe_file_name(name: Column | str) -> Column:
    cleaned = F.btrim(F.regexp_replace(_c(name), r"[^\p{L}\p{N}_-]", "-"), F.lit("-"))
    return F.when(cleaned == "", "repository").otherwise(cleaned)


def score_band(score: Column | str) -> Column:
    value = F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(_c(score), F.lit(0))))
    return F.when(value >= 80, "Healthy").when(value >= 60, "Needs review").otherwise("Needs attention")


def step_state(step: Column | str, status: Column | str) -> Column:
    order = F.array(*[F.lit(s) for s in STEPS])
    at, now = F.array_position(order, _c(step)), F.array_position(order, _c(status))
    return F.when((_c(status) == "complete") | (at < now), "done").when(at == now, "active").otherwise("pending")


def location(path: Column | str, line: Column | str) -> Column:
    """'path' or 'path:line'; line 0 counts as none."""
    path, line = _c(path), _c(line)
    known = line.isNotNull() & (line != 0)
    return F.when(known, F.concat_ws(":", path, line.cast("string"))).otherwise(path)


def default_branch(branch: Column | str, repo_default: Column | str) -> Column:
    return F.coalesce(
        F.nullif(strip(branch), F.lit("")), F.nullif(_c(repo_default), F.lit("")), F.lit("main")
    )


def _encode_component(c: Column) -> Column:
    """Percent-encoding that leaves A-Z a-z 0-9 - _ . ! ~ * ' ( ) alone."""
    out = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    for code, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def blob_url(repo_url: Column | str, branch: Column | str, path: Column | str, line: Column | str) -> Column:
    """Link to a file (and line) on the hosting site; NULL without a repository URL or a path."""
    repo_url, branch, line = _c(repo_url), _c(branch), _c(line)
    base = F.regexp_replace(F.regexp_replace(strip(repo_url), r"\.git\z", ""), r"/\z", "")
    parts = F.filter(F.split(F.replace(_c(path), F.lit("\\"), F.lit("/")), "/"), lambda s: s != "")
    file_part = F.array_join(F.transform(parts, _encode_component), "/")
    ref = _encode_component(F.coalesce(F.nullif(branch, F.lit("")), F.lit("main")))
    anchor = F.when(line.isNotNull() & (line != 0), F.concat(F.lit("#L"), line.cast("string"))).otherwise("")
    return F.when(
        (repo_url != "") & (file_part != ""), F.concat(base, F.lit("/blob/"), ref, F.lit("/"), file_part, anchor)
    )


def parse_repo_url(url: Column | str) -> Column:
    """Struct(owner, name, full_name, normalized_url, error) for a hosted repository root URL."""
    text = strip(url)
    scheme = F.lower(F.regexp_extract(text, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    rest = F.regexp_extract(text, r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)", 0)
    authority = F.regexp_extract(rest, r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://([^/]*)", 1)
    host = F.lower(F.regexp_extract(F.substring_index(authority, "@", -1), r"^([^:]*)", 1))
    raw_path = F.regexp_replace(rest, r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    parts = F.filter(F.split(raw_path, "/"), lambda p: p != "")
    owner = strip(F.get(parts, 0))
    name = F.regexp_replace(strip(F.get(parts, 1)), r"\.git\z", "")
    error = (
        F.when(scheme != "https", "not https")
        .when(~host.isin("github.com", "www.github.com"), "unknown host")
        .when(F.size(parts) != 2, "not owner/name")
        .when((owner == "") | (name == ""), "empty owner or name")
    )
    ok = error.isNull() & text.isNotNull()
    full = F.concat_ws("/", owner, name)
    return F.struct(
        F.when(ok, owner).alias("owner"),
        F.when(ok, name).alias("name"),
        F.when(ok, full).alias("full_name"),
        F.when(ok, F.concat(F.lit("https://github.com/"), full)).alias("normalized_url"),
        F.coalesce(error, F.when(text.isNull(), F.lit("not https"))).alias("error"),
    )


