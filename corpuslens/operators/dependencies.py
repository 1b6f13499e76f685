"""Dependency manifests: declared dependencies and manifest findings.

Manifests are a thin slice of a corpus and are picked by file name before their content is read into
any expression. JSON manifests are parsed in the JVM; only XML goes through a small pandas function.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from corpuslens.catalogue import NODE_LOCKFILES, REQUIREMENT_FILES, SEQ, TEXT_MANIFESTS
from corpuslens.functions.predicates import not_in_ignored_dir
from corpuslens.functions.text import basename, dirname, lines_array, strip, wide_lines_array
from corpuslens.session import pin

RISK = "Builds can change, or pull in unsafe code, without a change in the repository."
POM = T.StructType([T.StructField("valid", T.BooleanType()), T.StructField("versions", T.ArrayType(T.StringType()))])
# Fixed value: a requirement line -> name, operator, rest.
REQUIREMENT = r"(?Ud)^([A-Za-z0-9_.-]+)\s*(==|~=|>=|<=|>|<)?\s*(.*)\z"


def manifests_named(files: DataFrame, *names: str) -> DataFrame:
    return files.where(not_in_ignored_dir("path", "language") & basename("path").isin(*names))


#: A JSON string, a stretch without quotes, or a quote that ends nothing.
TOKENS = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^"]++|"'


def _outside_strings(text: Column, change) -> Column:
    """``change`` applied to what stands outside of the strings of a JSON text."""
    parts = F.regexp_extract_all(text, F.lit(f"(?s)({TOKENS})"), F.lit(1))
    return F.array_join(F.transform(parts, lambda t: F.when(t.startswith('"') & (F.length(t) > 1), t).otherwise(change(t))), "")


def _finite(content: Column) -> Column:
    """The text with a number in place of NaN and the infinities, which are values here although JSON has none."""
    bare = r"(?<![\w.+-])(?:NaN|-?Infinity)(?![\w.])"
    return F.when(content.rlike(bare), _outside_strings(content, lambda t: F.regexp_replace(t, bare, "0"))).otherwise(content)


def _object(content: Column) -> Column:
    """The JSON text as a variant; NULL if it is not exactly one well-formed value."""
    whole = F.try_parse_json(F.concat(F.lit("["), _finite(content), F.lit("]")))
    alone = F.try_variant_get(whole, "$[1]", "variant").isNull()
    return F.when(alone, F.try_variant_get(whole, "$[0]", "variant"))


def _word(text: Column) -> Column:
    """A string as a literal inside a printed list or map."""
    quote = F.when(text.contains("'") & ~text.contains('"'), F.lit('"')).otherwise(F.lit("'"))
    body = F.replace(F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t"))
    return F.concat(quote, F.when(quote == "'", F.replace(body, F.lit("'"), F.lit("\\'"))).otherwise(body), quote)


def _printed(text: Column, kind: Column) -> Column:
    """A member's JSON text as it is shown: words for booleans and for what is no number, lists and maps with spaces."""

    def outside(t: Column) -> Column:
        for a, b in ((r"\btrue\b", "True"), (r"\bfalse\b", "False"), (r"\bnull\b", "None"), (r"([:,])", "$1 ")):
            t = F.regexp_replace(t, a, b)
        return t

    parts = F.regexp_extract_all(text, F.lit(f"(?s)({TOKENS})"), F.lit(1))
    nested = F.array_join(F.transform(parts, lambda t: F.when(t.startswith('"'), _word(F.from_json(F.concat(F.lit("["), t, F.lit("]")), "array<string>")[0])).otherwise(outside(t))), "")
    bare = F.replace(text, F.lit('"'), F.lit(""))
    number = F.when(bare == "NaN", "nan").when(bare.isin("Infinity", "-Infinity"), F.lower(F.replace(bare, F.lit("inity"), F.lit("")))).otherwise(_float(text))
    return (
        F.when(kind == "STRING", text).when(kind == "BOOLEAN", F.initcap(text))
        .when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), nested).otherwise(number)
    )


def _float(text: Column) -> Column:
    """A number with an exponent or many digits as a double is printed in full or with a two-digit exponent."""
    value, digits = text.try_cast("double"), F.regexp_extract(text, r"^-?(\d+)\.?(\d*)(?:[eE]([+-]?\d+))?$", 3)
    plain = F.regexp_replace(value.cast("decimal(38,20)").cast("string"), r"(\.\d+?)0+$", "$1")
    power = F.regexp_replace(F.regexp_replace(F.lower(text), r"\.0e", "e"), r"e(-?)\+?(\d)$", "e$10$2")
    small = (F.abs(value) < 1e16) & ((F.abs(value) >= 1e-4) | (value == 0))
    return F.when(digits == "", text).when(small, plain).otherwise(F.regexp_replace(power, r"e(\d)", "e+$1"))


def _members(parsed: Column, content: Column, key: str) -> Column:
    """Member map of an object-valued key, its values as text; anything else counts as no members.

    The kind of a value comes from the variant, its text from the source: a variant has no ``1.0`` and no order of keys.
    The last of repeated keys counts.
    """
    kinds = F.try_variant_get(parsed, f"$.{key}", "map<string,variant>")
    options = {"allowNonNumericNumbers": "true", "allowSingleQuotes": "false"}
    texts = F.map_entries(F.from_json(content, f"`{key}` map<string,string>", options)[key])
    found = F.transform_values(kinds, lambda k, v: F.when(
        ~F.is_variant_null(v), _printed(F.element_at(F.filter(texts, lambda e: e["key"] == k), -1)["value"], F.schema_of_variant(v))))
    return F.coalesce(found, F.create_map().cast("map<string,string>"))


def _named(members: Column, *versions: str) -> Column:
    """Names whose version, stripped, is one of those given. A JSON null reads as the word None."""
    return F.map_keys(F.map_filter(members, lambda _, v: strip(F.coalesce(v, F.lit("None"))).isin(*versions)))


def _named_in_merge(main: Column, dev: Column, *versions: str) -> Column:
    """The same over both maps merged, where the second map's version wins."""
    return F.concat(_named(dev, *versions), F.array_except(_named(main, *versions), F.map_keys(dev)))


def _json_manifest(files: DataFrame, name: str, main: str, dev: str) -> DataFrame:
    valid_utf8 = F.col("utf8_valid") if "utf8_valid" in files.columns else F.lit(True)
    return (
        manifests_named(files, name)
        .select("repo_id", "path", "content", valid_utf8.alias("_utf8"), _object(F.col("content")).alias("_v"))
        .select(
            "repo_id", "path",
            (F.col("_v").isNotNull() & F.col("_utf8")).alias("valid"),
            _members(F.col("_v"), F.col("content"), main).alias("main"),
            _members(F.col("_v"), F.col("content"), dev).alias("dev"),
        )
    )


def _issue(df: DataFrame, rule_id: str, severity: str, title: Column, description: Column, fix: str,
           line: Column | None = None, seq: int = 0) -> DataFrame:
    return df.select(
        "repo_id",
        F.lit(rule_id).alias("rule_id"),
        title.alias("title"),
        F.lit(severity).alias("severity"),
        F.lit("security").alias("category"),
        F.col("path").alias("file_path"),
        (F.lit(None) if line is None else line).cast("int").alias("line_number"),
        F.lit("Dependencies").alias("language"),
        description.alias("description"),
        F.lit(RISK).alias("risk"),
        F.lit(fix).alias("suggested_fix"),
        F.lit(None).cast("string").alias("generated_patch"),
        F.lit("scan-dependency-checks").alias("source_tool"),
        F.lit(SEQ["dependencies"]).alias("seq_major"),
        F.lit(seq).cast("bigint").alias("seq_minor"),
    )


def missing_lockfile(files: DataFrame) -> DataFrame:
    """package.json with at least one dependency and no lockfile beside it (anti join on the folder)."""
    declared = _json_manifest(files, "package.json", "dependencies", "devDependencies").where(
        (F.size("main") > 0) | (F.size("dev") > 0)
    )
    # The lockfile is looked for on disk, so it counts whatever directory holds it.
    locks = files.where(basename("path").isin(*NODE_LOCKFILES)).select("repo_id", dirname("path").alias("_dir"))
    return declared.withColumn("_dir", dirname("path")).join(locks, ["repo_id", "_dir"], "left_anti").select(
        "repo_id", "path"
    )


# The titles of manifest findings, here and in the rules below.
def package_json_rules(files: DataFrame) -> DataFrame:
    parsed = _json_manifest(files, "package.json", "dependencies", "devDependencies")
    invalid = _issue(parsed.where(~F.col("valid")), "RD1", "medium", F.lit("Invalid package.json"),
                     F.lit("The file is not well-formed JSON."), "Correct the file.")
    loose = parsed.select("repo_id", "path", F.explode(
        _named_in_merge(F.col("main"), F.col("dev"), "*", "latest", "")
    ).alias("name"))
    unpinned = _issue(loose, "RD2", "medium", F.concat(F.lit("Unpinned dependency: "), "name"),
                      F.concat("name", F.lit(" accepts any version.")), "State a version or range.", seq=1)
    no_lock = _issue(missing_lockfile(files), "RD3", "medium", F.lit("Node dependency lockfile missing"),
                     F.lit("Dependencies are declared but not locked."), "Commit a lockfile.", seq=2)
    return invalid.unionByName(unpinned).unionByName(no_lock)


def composer_rules(files: DataFrame) -> DataFrame:
    parsed = _json_manifest(files, "composer.json", "require", "require-dev")
    invalid = _issue(parsed.where(~F.col("valid")), "RD5", "medium", F.lit("Invalid composer.json"),
                     F.lit("The file is not well-formed JSON."), "Correct the file.", seq=3)
    loose = parsed.select("repo_id", "path", F.explode(
        _named_in_merge(F.col("main"), F.col("dev"), "*", "dev-master", "dev-main")
    ).alias("name"))
    unstable = _issue(loose, "RD6", "medium", F.concat(F.lit("Unstable Composer dependency: "), "name"),
                      F.concat("name", F.lit(" follows a moving version.")), "State a released version.", seq=4)
    return invalid.unionByName(unstable)


def requirement_rules(files: DataFrame) -> DataFrame:
    lines = (
        manifests_named(files, *REQUIREMENT_FILES)
        .select("repo_id", "path", F.posexplode(lines_array("content")).alias("_pos", "_raw"))
        .withColumn("_line", strip("_raw"))
        .where(
            (F.col("_line") != "") & ~F.col("_line").startswith("#") & ~F.col("_line").startswith("-")
            & ~F.col("_line").rlike("[<>]|==|~=")
        )
    )
    return _issue(lines, "RD4", "low", F.lit("Unpinned Python dependency"),
                  F.concat(F.lit("No version is stated: "), "_line"), "State a version or range.",
                  line=F.col("_pos") + 1, seq=5)


def text_manifest_rules(files: DataFrame) -> DataFrame:
    hits = manifests_named(files, *TEXT_MANIFESTS).where(
        F.col("content").rlike(r"""(?iU)(version\s*=\s*["']\*["']|latest)""")
    )
    return _issue(hits, "RD9", "medium", F.lit("Unpinned dependency version"),
                  F.lit("A wildcard or latest version is used."), "State a version.", seq=6)


@pandas_udf(POM)
def read_pom(content: pd.Series) -> pd.DataFrame:
    """Text of every element whose tag ends in 'version'; valid is false for malformed XML."""
    rows = []
    for text in content:
        try:
            root = ET.fromstring(text.encode("utf-8"))
        except (ET.ParseError, AttributeError, LookupError, ValueError):
            rows.append((False, []))
            continue
        found = [(e.text or "").strip() for e in root.iter() if isinstance(e.tag, str) and e.tag.endswith("version")]
        rows.append((True, found))
    return pd.DataFrame(rows, columns=["valid", "versions"])


def maven_rules(files: DataFrame) -> DataFrame:
    poms = manifests_named(files, "pom.xml").select("repo_id", "path", read_pom("content").alias("_p"))
    invalid = _issue(poms.where(~F.col("_p.valid")), "RD7", "medium", F.lit("Invalid Maven pom.xml"),
                     F.lit("The file is not well-formed XML."), "Correct the file.", seq=7)
    moving = poms.select("repo_id", "path", F.explode("_p.versions").alias("version")).where(
        F.upper("version").isin("LATEST", "RELEASE")
    )
    unstable = _issue(moving, "RD8", "medium", F.lit("Unstable Maven dependency version"),
                      F.concat(F.lit("The version is "), "version"), "State a released version.", seq=8)
    return invalid.unionByName(unstable)


def manifest_slice(files: DataFrame) -> DataFrame:
    """Manifests and lockfiles of a corpus, cut out once and kept in the shared folder.

    They are a tiny share of all files but several checks read them; without this each check would scan
    every file's content again. Lockfiles are only looked up by name, so their content is left behind.
    """
    utf8 = F.col("utf8_valid") if "utf8_valid" in files.columns else F.lit(True)
    name = basename("path")
    checked = (*REQUIREMENT_FILES, *TEXT_MANIFESTS, "package.json", "composer.json", "pom.xml")
    return pin(
        files.where(name.isin(*checked, *NODE_LOCKFILES)).select(
            "repo_id", "path", F.when(name.isin(*checked), F.col("content")).alias("content"), utf8.alias("utf8_valid")
        )
    )


def dependency_findings(files: DataFrame) -> DataFrame:
    """All manifest findings, from one scan of the corpus."""
    sliced = manifest_slice(files)
    return (
        package_json_rules(sliced)
        .unionByName(requirement_rules(sliced))
        .unionByName(composer_rules(sliced))
        .unionByName(maven_rules(sliced))
        .unionByName(text_manifest_rules(sliced))
    )


def requirement_entry(line: Column) -> Column:
    """Struct(name, version) of one stripped requirement line."""
    name = F.regexp_extract(line, REQUIREMENT, 1)
    op = F.regexp_extract(line, REQUIREMENT, 2)
    rest = strip(F.regexp_extract(line, REQUIREMENT, 3))
    return F.struct(
        F.when(name == "", line).otherwise(name).alias("name"),
        F.when((name != "") & (op != "") & (rest != ""), F.concat(op, rest)).alias("version"),
        F.lit(None).cast("string").alias("scope"),
    )


def _entries(members: Column) -> Column:
    return F.transform(F.map_entries(members), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("version")))


def _scoped(entries: Column, scope: str) -> Column:
    return F.transform(
        entries, lambda e: F.struct(e["name"].alias("name"), e["version"].alias("version"), F.lit(scope).alias("scope"))
    )


def _both_scopes(main: Column, dev: Column) -> Column:
    """Production entries, then the development entries not already listed with the same version."""
    fresh = F.array_except(_entries(dev), _entries(main))
    return F.concat(_scoped(_entries(main), "production"), _scoped(fresh, "development"))


def dependencies(files: DataFrame) -> DataFrame:
    """Declared dependencies. Duplicates can only occur inside one manifest, so they go in its own row."""
    python = manifests_named(files, *REQUIREMENT_FILES).select(
        "repo_id", F.col("path").alias("manifest"), F.lit("Python").alias("ecosystem"),
        F.array_distinct(
            F.transform(
                F.filter(
                    F.transform(wide_lines_array("content"), strip),
                    lambda x: (x != "") & ~x.startswith("#") & ~x.startswith("-"),
                ),
                requirement_entry,
            )
        ).alias("_deps"),
    )
    node = _json_manifest(files, "package.json", "dependencies", "devDependencies").select(
        "repo_id", F.col("path").alias("manifest"), F.lit("Node.js").alias("ecosystem"),
        _both_scopes(F.col("main"), F.col("dev")).alias("_deps"),
    )
    php = _json_manifest(files, "composer.json", "require", "require-dev").select(
        "repo_id", F.col("path").alias("manifest"), F.lit("PHP").alias("ecosystem"),
        _both_scopes(F.col("main"), F.col("dev")).alias("_deps"),
    )
    return (
        python.unionByName(node)
        .unionByName(php)
        .select("repo_id", "manifest", "ecosystem", F.explode_outer("_deps").alias("_d"))
        .where(F.col("_d").isNotNull())
        .select("repo_id", "_d.name", "_d.version", "ecosystem", "manifest", "_d.scope")
    )
