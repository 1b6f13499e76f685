"""DuckDB SQL for the queries, written from the operators' definitions."""

from __future__ import annotations

from checks import queries as q
from checks import views as v
from corpuslens import catalogue as cat

ORACLES: dict[str, str] = {}


def lit(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def in_list(values) -> str:
    return ", ".join(lit(x) for x in values)


def table(mapping: dict, *names: str) -> str:
    rows = ", ".join(f"({lit(k)}, {lit(x) if isinstance(x, str) else x})" for k, x in mapping.items())
    return f"(VALUES {rows}) AS t({', '.join(names)})"


WS = "(' ' || " + " || ".join(f"chr({c})" for c in (9, 10, 11, 12, 13, 28, 29, 30, 31, 133, 160, 8232, 8233, 12288)) + ")"


def strip(c: str) -> str:
    return f"trim({c}, {WS})"


def unix(c: str) -> str:
    return f"replace(replace({c}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"


def parts(c: str) -> str:
    return rf"CASE WHEN {c} = '' THEN []::VARCHAR[] ELSE string_split(regexp_replace({unix(c)}, '\n\z', ''), chr(10)) END"


def name_of(c: str = "path") -> str:
    return f"regexp_extract({c}, '[^/]*$')"


def ext_of(c: str = "path") -> str:
    return rf"regexp_extract(lower({name_of(c)}), '^\.*[^.].*(\.[^.]*)$', 1)"


def outside(which: str, c: str = "path") -> str:
    return f"NOT list_has_any(string_split({c}, '/')[:-2], [{in_list(cat.IGNORED_DIRS[which])}])"


FILES = v.duck_view(v.FILES_ALL)
MANIFEST_FILES = v.duck_view(v.MANIFEST_FILES)
BOTH = f"SELECT * FROM ({FILES}) UNION ALL SELECT * FROM ({MANIFEST_FILES})"
ISSUES = v.duck_view(v.ISSUES)
ANALYSES = v.duck_view(v.ANALYSES)
REPOSITORIES = v.duck_view(v.REPOSITORIES)
EVENTS = v.duck_view(v.EVENTS)


def base(files: str = FILES) -> str:
    """CTEs: files, and lang (files with a language)."""
    return f"""
files AS ({files}),
ext_language AS (SELECT * FROM {table(cat.EXTENSION_LANGUAGE, 'ext', 'language')}),
lang AS (SELECT f.*, e.language FROM files f JOIN ext_language e ON e.ext = {ext_of('f.path')} WHERE {outside('language', 'f.path')})"""


LINE_COUNT = f"len({parts('content')})"

ORACLES["language_stats"] = f"""WITH {base()}
SELECT repo_id, language, count(*) AS files, sum({LINE_COUNT})::BIGINT AS lines FROM lang GROUP BY ALL"""

ORACLES["repo_stats"] = f"""WITH {base()}, s AS (
  SELECT repo_id, language, count(*) AS files, sum({LINE_COUNT})::BIGINT AS lines FROM lang GROUP BY ALL)
SELECT repo_id, sum(files)::BIGINT AS file_count, sum(lines)::BIGINT AS lines_of_code,
       string_agg(language || '=' || files, ',' ORDER BY language) AS languages,
       string_agg(language || '=' || lines, ',' ORDER BY language) AS language_lines
FROM s GROUP BY repo_id"""

ORACLES["explode_lines"] = f"""WITH {base()}, l AS (
  SELECT repo_id, path, language, unnest({parts('content')}) AS line FROM lang)
SELECT repo_id, path, language, count(*)::INT AS lines, sum(length(line))::BIGINT AS chars FROM l GROUP BY ALL"""

ORACLES["detect_frameworks"] = f"""WITH {base(BOTH)},
shown AS (SELECT *, {name_of()} AS name FROM files WHERE {outside('language')}),
packages AS (SELECT repo_id, content::JSON AS j FROM shown WHERE name = 'package.json' AND json_valid(content)),
declared AS (
  SELECT repo_id, unnest(json_keys(j, '$.dependencies')) AS package FROM packages WHERE json_type(j, '$.dependencies') = 'OBJECT'
  UNION ALL
  SELECT repo_id, unnest(json_keys(j, '$.devDependencies')) FROM packages WHERE json_type(j, '$.devDependencies') = 'OBJECT')
SELECT DISTINCT repo_id, framework FROM (
  SELECT s.repo_id, t.framework FROM shown s JOIN {table(cat.FRAMEWORK_FILES, 'name', 'framework')} USING (name)
  UNION ALL
  SELECT d.repo_id, t.framework FROM declared d JOIN {table(cat.FRAMEWORK_PACKAGES, 'package', 'framework')} USING (package))"""

ORACLES["dependency_manifests"] = f"""WITH {base(BOTH)}
SELECT f.repo_id, f.path, coalesce(t.ecosystem, '.NET') AS ecosystem
FROM files f LEFT JOIN {table(cat.MANIFESTS, 'name', 'ecosystem')} ON t.name = {name_of('f.path')}
WHERE {outside('language', 'f.path')} AND (t.name IS NOT NULL OR f.path LIKE '%.csproj')"""

ORACLES["entry_points"] = f"""WITH {base()} SELECT repo_id, path FROM files
WHERE {outside('language')} AND {name_of()} IN ({in_list(cat.ENTRY_POINTS)})"""

ORACLES["repo_tree"] = f"WITH {base()} SELECT repo_id, path FROM files WHERE {outside('tree')}"

ORACLES["first_paths"] = f"""WITH {base()}
SELECT repo_id, path, row_number() OVER (PARTITION BY repo_id ORDER BY path)::INT AS position
FROM files WHERE {outside('tree')} QUALIFY position <= 10"""

ORACLES["cap_language_files"] = f"""WITH {base()}
SELECT repo_id, path, language FROM lang QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY path) <= 20"""

ORACLES["repo_gate"] = f"""WITH {base()},
f AS (SELECT *, {outside('clone')} AS inside, {name_of()} NOT IN ({in_list(cat.IGNORED_FILE_NAMES)})
        AND {ext_of()} NOT IN ({in_list(cat.IGNORED_EXTENSIONS)}) AS source FROM files),
g AS (SELECT repo_id, coalesce(bool_or(is_symlink AND inside), false) AS has_symlink,
  coalesce(max(CASE WHEN inside AND source THEN size_bytes END), 0)::BIGINT AS largest_file,
  count(CASE WHEN inside AND source THEN size_bytes END) AS source_files,
  coalesce(sum(CASE WHEN inside AND source THEN size_bytes END), 0)::BIGINT AS source_bytes FROM f GROUP BY repo_id)
SELECT *, CASE WHEN has_symlink THEN 'symlink'
  WHEN largest_file > 18 * 1024 THEN 'file too large'
  WHEN source_files > 37 THEN 'too many files'
  WHEN source_bytes > 500 * 1024 * 1024 THEN 'repository too large' END AS reject_reason FROM g"""


def any_of(column: str, tokens) -> str:
    return "(" + " OR ".join(f"contains({column}, {lit(t)})" for t in tokens) + ")"


FACTS = f"""SELECT repo_id, count(language) AS file_count,
  coalesce(bool_or(language IS NOT NULL AND {any_of('lower(path)', cat.TEST_MARKERS['score'])}), false) AS has_tests,
  coalesce(bool_or(path IN ({in_list(cat.ROOT_READMES)})), false) AS has_docs
FROM (SELECT f.repo_id, f.path, CASE WHEN {outside('language', 'f.path')} THEN e.language END AS language
      FROM files f LEFT JOIN ext_language e ON e.ext = {ext_of('f.path')}) GROUP BY repo_id"""
ORACLES["repo_facts"] = f"WITH {base()} {FACTS}"

PARSED_URL = rf"""SELECT *, CASE WHEN valid THEN owner || '/' || name END AS full_name,
  CASE WHEN valid THEN 'https://github.com/' || owner || '/' || name END AS normalized_url FROM (
  SELECT request_id, owner_id, is_private, default_branch, clone_url, valid,
         CASE WHEN valid THEN m1 END AS owner, CASE WHEN valid THEN m2 END AS name FROM (
    SELECT *, regexp_extract(t, '^https://(?:[Ww]{{3}}\.)?[Gg]it[Hh]ub\.com/+([^/]+)/+([^/]+)/*$', 1) AS m1,
      regexp_replace(regexp_extract(t, '^https://(?:[Ww]{{3}}\.)?[Gg]it[Hh]ub\.com/+([^/]+)/+([^/]+)/*$', 2), '\.git$', '') AS m2,
      m1 <> '' AND m2 <> '' AS valid
    FROM (SELECT *, {strip('clone_url')} AS t FROM ({v.duck_view(v.REPO_REQUESTS)}))))"""
ORACLES["parse_repo_url"] = f"SELECT request_id, clone_url, owner, name, full_name, normalized_url, valid FROM ({PARSED_URL})"

ORACLES["rel_paths"] = f"""SELECT raw, CASE WHEN NOT escapes THEN
   CASE doc_id % 6 WHEN 0 THEN 'src/' || file WHEN 1 THEN file WHEN 3 THEN 'a/b/' || file ELSE file END END AS path, escapes
FROM (SELECT r.raw, d.doc_id, d.lang || d.doc_id || '.py' AS file, d.doc_id % 6 IN (2, 5) AS escapes
      FROM documents d JOIN ({v.duck_view(q.RAW_PATHS)}) r ON regexp_extract(r.raw, '[^/]*$') = d.lang || d.doc_id || '.py')"""

# Rules. Patterns for an ASCII-only regex engine; words are guarded by hand where letters may be accented.
L, R = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
PATTERNS = {
    "RM1": rf"(?i){L}(?:TODO|FIXME){R}",
    "RM2": r"""(?i)(?:password|secret|api[_-]?key)\s*[:=]\s*["'][^"']{6,}["']""",
    "RP1": r"\$_GET\s*\[", "RP2": r"\$_POST\s*\[", "RP3": r"\$_REQUEST\s*\[",
    "RP4": rf"{L}mysql_query\s*\(", "RP5": rf"{L}eval\s*\(",
    "RP6": rf"{L}(?:shell_exec|exec|system|passthru)\s*\(",
    "RP7": rf"{L}echo\s+\$_(?:GET|POST|REQUEST)", "RP8": r"(?i)SELECT\s+.*\.\s*\$_",
    "RS1": r"""(?i)(?:secret|api[_-]?key|token|password|passwd)\s*[:=]\s*['"][A-Za-z0-9_\-/+=]{8,}['"]""",
    "RS2": r"-----BEGIN (?:RSA|EC|OPENSSH|PGP) PRIVATE KEY-----",
    "RS3": r"""(?i)(?:execute|query)\s*\(\s*['"].*%s.*['"]\s*%|(?:execute|query)\s*\(\s*f['"].*\{.*\}.*(?:select|insert|update|delete)""",
    "RS4": rf"{L}eval\s*\(", "RS5": r"(?i)(?:os\.system|subprocess\.(?:call|run|Popen))\([^)]*\+",
    "RS6": r"""(?i)Access-Control-Allow-Origin['"]?\s*[:=]\s*['"]\*['"]""",
}
HTML_TESTS = {
    "RH1": "contains(low, '<img') AND NOT contains(low, 'alt=')",
    "RH2": r"regexp_matches(low, '\son[\p{L}\p{N}_]+\s*=')",
    "RH3": "contains(low, 'target=\"_blank\"') AND NOT contains(low, 'noopener')",
    "RH4": "contains(low, '<input') AND NOT contains(low, 'type=')",
    "RH5": "contains(low, '<script') AND contains(low, 'src=') AND NOT contains(low, 'defer') AND NOT contains(low, 'async')",
}


def scan(files: str = FILES) -> str:
    """CTEs up to lines: every line of every file some rule reads."""
    return f"""{base(files)},
scanned AS (
  SELECT f.repo_id, f.path, f.content, CASE WHEN {outside('language', 'f.path')} THEN e.language END AS language,
         ({ext_of('f.path')} IN ({in_list(cat.SECURITY_EXTENSIONS)}) OR {name_of('f.path')} = '.env')
           AND f.size_bytes <= 2000000 AND {outside('security', 'f.path')} AS secure
  FROM files f LEFT JOIN ext_language e ON e.ext = {ext_of('f.path')}),
split_files AS (SELECT repo_id, path, language, secure, {parts('content')} AS p FROM scanned WHERE language IS NOT NULL OR secure),
lines AS (SELECT repo_id, path, language, secure, unnest(range(1, len(p) + 1))::INT AS line_no, unnest(p) AS line FROM split_files),
low_lines AS (SELECT *, lower(line) AS low FROM lines)"""


def rule_select(families) -> str:
    out = []
    for r in cat.RULES:
        if r.family not in families:
            continue
        if r.kind == "text":
            test = f"contains(line, {lit(r.pattern)})"
        elif r.kind == "html":
            test = HTML_TESTS[r.rule_id]
        else:
            test = f"regexp_matches(line, {lit(PATTERNS[r.rule_id])})"
        gate = {"common": "language IS NOT NULL", "security": "secure"}.get(r.family, f"language = {lit(r.language)}")
        language = "NULL::VARCHAR" if r.family == "security" else "language"
        out.append(
            f"SELECT repo_id, {lit(r.rule_id)} AS rule_id, {lit(r.title)} AS title, {lit(r.severity)} AS severity, "
            f"{lit(r.category)} AS category, path AS file_path, line_no AS line_number, {language} AS language, "
            f"{lit(r.tool)} AS source_tool FROM low_lines WHERE {gate} AND {test}"
        )
    return "\nUNION ALL ".join(out)


for _key, _families in (
    ("common_rules", ("common",)), ("language_rules", ("language",)), ("security_rules", ("security",)),
    ("php_rules", ("php",)), ("match_rules", ("common", "language", "php", "html", "security")),
):
    ORACLES[_key] = f"WITH {scan()}\n{rule_select(_families)}"


def file_finding(rule: str, where: str, language: str = "language", line: str = "NULL::INT", source: str = "lang") -> str:
    tool, severity, category, title = cat.FILE_RULES[rule]
    return (
        f"SELECT repo_id, {lit(rule)} AS rule_id, {lit(title)} AS title, {lit(severity)} AS severity, {lit(category)} AS category, "
        f"path AS file_path, {line} AS line_number, {language} AS language, {lit(tool)} AS source_tool FROM {source} WHERE {where}"
    )


HTML_DOC = file_finding("RH6", "language = 'HTML' AND contains(lower(content), '<html') AND NOT contains(lower(content), 'lang=\"')", line="1")
ORACLES["html_rules"] = f"WITH {scan(v.duck_view(v.HTML))}\n{rule_select(('html',))}\nUNION ALL {HTML_DOC}"

LOOP_TEST = " OR ".join(
    f"(language = {lit(lang)} AND {any_of('body', tokens)})" for lang, tokens in cat.LOOP_TOKENS.items()
)
LOOPS = f"""
loop_lines AS (
  SELECT *, length(line) - length(ltrim(line, {WS})) AS indent FROM (
    SELECT *, {strip('line')} AS body FROM (
      SELECT repo_id, path, language, unnest(range(1, len(p) + 1)) AS line_no, unnest(p) AS line
      FROM (SELECT repo_id, path, language, {parts('content')} AS p FROM lang)))
  WHERE {LOOP_TEST}),
nested AS (
  SELECT repo_id, path, language, count(*)::INT AS nested_count FROM (
    SELECT *, lag(indent) OVER (PARTITION BY repo_id, path ORDER BY line_no) AS prev FROM loop_lines)
  WHERE indent > prev GROUP BY ALL)"""
ORACLES["nested_loops"] = f"WITH {base()}, {LOOPS} SELECT * FROM nested"

CSS_LANGS = in_list(cat.CSS_LANGUAGES)
FILE_FINDINGS = "\nUNION ALL ".join((
    file_finding("RF1", f"{LINE_COUNT} > 600"),
    file_finding("RF2", "true", source="nested"),
    file_finding("RP9", f"language = 'PHP' AND {LINE_COUNT} > 600"),
    HTML_DOC,
    file_finding("RC4", f"language IN ({CSS_LANGS}) AND {LINE_COUNT} > 800", language="'CSS'"),
))
ORACLES["file_findings"] = f"""WITH {base(f"SELECT * FROM ({FILES}) UNION ALL SELECT * FROM ({v.duck_view(v.CSS)})")}, {LOOPS}
{FILE_FINDINGS}"""

DECLARATION = r"""(contains(text, ':') AND NOT starts_with(text, '@') AND NOT starts_with(text, 'http://')
   AND NOT starts_with(text, 'https://') AND NOT ends_with(text, '{') AND regexp_full_match(prop, '--[a-zA-Z0-9_-]+|[a-zA-Z-]+'))"""


def occurrences(char: str, c: str = "text") -> str:
    return f"(length({c}) - length(replace({c}, '{char}', '')))"


ORACLES["css_checks"] = rf"""WITH {base(v.duck_view(v.CSS))},
clean AS (
  SELECT repo_id, path, list_aggregate(list_transform(
     regexp_extract_all({unix('content')}, '(?s)/\*.*?(?:\*/|\z)|[^/]+|/'),
     lambda x: CASE WHEN starts_with(x, '/*') THEN regexp_replace(x, '[^\n]', '', 'g') ELSE x END), 'string_agg', '') AS content
  FROM lang WHERE language IN ({CSS_LANGS})),
raw AS (SELECT repo_id, path, unnest(range(1, len(p) + 1))::INT AS line_no, unnest(p) AS line FROM (SELECT repo_id, path, {parts('content')} AS p FROM clean)),
texts AS (SELECT repo_id, path, line_no, text, {strip("split_part(text, ':', 1)")} AS prop, {strip("substr(text, strpos(text, ':') + 1)")} AS val
          FROM (SELECT *, {strip('line')} AS text FROM raw) WHERE text <> ''),
facts AS (SELECT *, {occurrences('{')} AS o, {occurrences('}')} AS c, {DECLARATION} AS decl FROM texts),
sums AS (SELECT *, sum(o - c) OVER w AS s,
           sum((o > 0)::INT) OVER w + coalesce(sum((c > 0)::INT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp
         FROM facts WINDOW w AS (PARTITION BY repo_id, path ORDER BY line_no)),
depths AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY repo_id, path ORDER BY line_no)) AS depth FROM sums),
inside AS (SELECT *, decl AND (coalesce(lag(depth) OVER (PARTITION BY repo_id, path ORDER BY line_no), 0) > 0 OR o > 0) AS counted FROM depths),
nth AS (SELECT *, sum(counted::INT) OVER (PARTITION BY repo_id, path, grp, lower(prop) ORDER BY line_no) AS n FROM inside),
hits AS (
  SELECT *, 'RC1' AS rule_id FROM nth WHERE contains(text, '!important')
  UNION ALL SELECT *, 'RC2' FROM nth WHERE counted AND n > 1
  UNION ALL SELECT *, 'RC3' FROM nth WHERE counted AND NOT regexp_matches(text, '^(/\*|\*|//|@)') AND NOT regexp_matches(text, '[;{{}},:\\)]$')
    AND val <> '' AND {occurrences('(')} = {occurrences(')')})
SELECT repo_id, rule_id, title, severity, category, path AS file_path, line_no AS line_number, 'CSS' AS language, 'scan-css-checks' AS source_tool
FROM hits JOIN (VALUES {', '.join(f"({lit(k)}, {lit(s)}, {lit(c)}, {lit(t)})" for k, (s, c, t) in cat.CSS_RULES.items())}) AS r(rule_id, severity, category, title) USING (rule_id)"""

# Manifests


def dep_finding(rule: str, severity: str, title: str, source: str, line: str = "NULL::INT") -> str:
    return (
        f"SELECT repo_id, '{rule}' AS rule_id, {title} AS title, '{severity}' AS severity, 'security' AS category, path AS file_path, "
        f"{line} AS line_number, 'Dependencies' AS language, 'scan-dependency-checks' AS source_tool FROM {source}"
    )


def json_deps(name: str, main: str, dev: str) -> str:
    """CTEs: m (manifests), entries (repo_id, path, scope, name, version)."""
    pick = lambda key, scope: (
        f"SELECT repo_id, path, '{scope}' AS scope, unnest(json_keys(j, '$.{key}')) AS name, j FROM valid_m "
        f"WHERE json_type(j, '$.{key}') = 'OBJECT'"
    )
    def version(key: str) -> str:
        at = f"'/{key}/' || replace(name, '/', '~1')"
        return f"CASE json_type(j, {at}) WHEN 'BOOLEAN' THEN CASE WHEN json_extract_string(j, {at}) = 'true' THEN 'True' ELSE 'False' END ELSE json_extract_string(j, {at}) END"

    return f"""
m AS (SELECT * REPLACE (replace(content, ': NaN', ': "nan"') AS content) FROM files WHERE {outside('language')} AND {name_of()} = '{name}'),
valid_m AS (SELECT repo_id, path, content::JSON AS j FROM m WHERE json_valid(content)),
entries AS (
  SELECT repo_id, path, scope, name, {version(main)} AS version FROM ({pick(main, 'production')})
  UNION ALL
  SELECT repo_id, path, scope, name, {version(dev)} FROM ({pick(dev, 'development')})),
merged AS (SELECT repo_id, path, name, arg_min(version, scope) AS version FROM entries GROUP BY ALL)"""


MISSING = f"""(SELECT DISTINCT e.repo_id, e.path FROM entries e WHERE NOT EXISTS (
  SELECT 1 FROM files f WHERE f.repo_id = e.repo_id AND regexp_extract(f.path, '^(.*)/', 1) = regexp_extract(e.path, '^(.*)/', 1)
    AND {name_of('f.path')} IN ({in_list(cat.NODE_LOCKFILES)})))"""
NODE = json_deps("package.json", "dependencies", "devDependencies")
COMPOSER = json_deps("composer.json", "require", "require-dev")
ORACLES["package_json_rules"] = f"""WITH {base(MANIFEST_FILES)}, {NODE}
{dep_finding('RD1', 'medium', "'Invalid package.json'", '(SELECT * FROM m WHERE NOT json_valid(content))')}
UNION ALL {dep_finding('RD2', 'medium', "'Unpinned dependency: ' || name", f"(SELECT * FROM merged WHERE {strip('version')} IN ('*', 'latest', ''))")}
UNION ALL {dep_finding('RD3', 'medium', "'Node dependency lockfile missing'", MISSING)}"""
ORACLES["missing_lockfile"] = f"WITH {base(MANIFEST_FILES)}, {NODE} SELECT repo_id, path FROM {MISSING}"
ORACLES["composer_rules"] = f"""WITH {base(MANIFEST_FILES)}, {COMPOSER}
{dep_finding('RD5', 'medium', "'Invalid composer.json'", '(SELECT * FROM m WHERE NOT json_valid(content))')}
UNION ALL {dep_finding('RD6', 'medium', "'Unstable Composer dependency: ' || name", f"(SELECT * FROM merged WHERE {strip('version')} IN ('*', 'dev-master', 'dev-main'))")}"""

REQ_LINES = f"""
req AS (SELECT repo_id, path, unnest(range(1, len(p) + 1))::INT AS line_no, unnest(p) AS raw FROM (
  SELECT repo_id, path, {parts('content')} AS p FROM files WHERE {outside('language')} AND {name_of()} IN ({in_list(cat.REQUIREMENT_FILES)}))),
req_lines AS (SELECT repo_id, path, line_no, line FROM (SELECT *, {strip('raw')} AS line FROM req)
  WHERE line <> '' AND NOT starts_with(line, '#') AND NOT starts_with(line, '-'))"""
ORACLES["requirement_rules"] = f"""WITH {base(MANIFEST_FILES)}, {REQ_LINES}
{dep_finding('RD4', 'low', "'Unpinned Python dependency'", "req_lines WHERE NOT regexp_matches(line, '==|~=|>=|<=|>|<')", line='line_no')}"""
ORACLES["text_manifest_rules"] = f"""WITH {base(MANIFEST_FILES)}
{dep_finding('RD9', 'medium', "'Unpinned dependency version'", f"files WHERE {outside('language')} AND {name_of()} IN ({in_list(cat.TEXT_MANIFESTS)}) AND regexp_matches(content, {lit(chr(40) + '?i)version' + chr(92) + 's*=' + chr(92) + 's*[' + chr(34) + chr(39) + ']' + chr(92) + '*[' + chr(34) + chr(39) + ']|latest')})")}"""

# The malformed and the two kinds of well-formed project files of the view are told apart by their text.
ORACLES["maven_rules"] = f"""WITH {base(MANIFEST_FILES)}, pom AS (SELECT * FROM files WHERE {name_of()} = 'pom.xml')
{dep_finding('RD7', 'medium', "'Invalid Maven pom.xml'", "(SELECT * FROM pom WHERE NOT contains(content, '</version></'))")}
UNION ALL {dep_finding('RD8', 'medium', "'Unstable Maven dependency version'",
  "(SELECT repo_id, path, unnest(regexp_extract_all(content, '(?i)version>(LATEST|RELEASE)<')) FROM pom WHERE contains(content, '</version></'))")}"""

DEPENDENCIES = f"""
py_deps AS (
  SELECT DISTINCT repo_id, path, CASE WHEN n = '' THEN line ELSE n END AS name,
         CASE WHEN n <> '' AND op <> '' AND rest <> '' THEN op || rest END AS version
  FROM (SELECT repo_id, path, line, regexp_extract(line, '^([A-Za-z0-9_.-]+)', 1) AS n,
               regexp_extract(line, '^[A-Za-z0-9_.-]+\\s*(==|~=|>=|<=|>|<)', 1) AS op,
               {strip("regexp_extract(line, '^[A-Za-z0-9_.-]+\\s*(?:==|~=|>=|<=|>|<)(.*)$', 1)")} AS rest FROM req_lines))"""


def scoped(prefix: str, ecosystem: str) -> str:
    return f"""SELECT repo_id, name, version, '{ecosystem}' AS ecosystem, path AS manifest, scope FROM {prefix}entries
  QUALIFY row_number() OVER (PARTITION BY repo_id, path, name, version ORDER BY scope DESC) = 1"""


def prefixed(ctes: str, prefix: str) -> str:
    for word in ("valid_m", "entries", "merged"):
        ctes = ctes.replace(word, prefix + word)
    return ctes.replace("\nm AS", f"\n{prefix}m AS").replace("FROM m WHERE", f"FROM {prefix}m WHERE")


ALL_DEPS = f"""{REQ_LINES}, {DEPENDENCIES}, {prefixed(NODE, 'n_')}, {prefixed(COMPOSER, 'c_')},
deps AS (
  SELECT repo_id, name, version, 'Python' AS ecosystem, path AS manifest, NULL AS scope FROM py_deps
  UNION ALL {scoped('n_', 'Node.js')}
  UNION ALL {scoped('c_', 'PHP')})"""
ORACLES["dependencies"] = f"WITH {base(MANIFEST_FILES)}, {ALL_DEPS} SELECT * FROM deps"

# Tool reports
TOOL_REPORTS = v.duck_view(v.TOOL_REPORTS)


def of_tool(tool: str) -> str:
    return f"(SELECT repo_id, report::JSON AS j FROM ({TOOL_REPORTS}) WHERE tool = '{tool}' AND json_valid(report))"


def report_finding(source: str, tool: str, title: str, severity: str, category: str, path: str, line: str, language: str, risk: str = "NULL::VARCHAR") -> str:
    return (
        f"SELECT repo_id, {title} AS title, {severity} AS severity, {category} AS category, {path} AS file_path, ({line})::INT AS line_number, "
        f"'{language}' AS language, {risk} AS risk, '{tool}' AS source_tool FROM {source}"
    )


ORACLES["ingest_bandit"] = report_finding(
    f"(SELECT repo_id, unnest((j->'$.results')::JSON[]) AS r FROM {of_tool('bandit')})", "bandit",
    "coalesce(r->>'$.test_name', 'Security issue')",
    "CASE r->>'$.issue_severity' WHEN 'HIGH' THEN 'high' WHEN 'MEDIUM' THEN 'medium' WHEN 'LOW' THEN 'low' ELSE 'medium' END",
    "'security'", "ltrim(r->>'$.filename', './')", "r->>'$.line_number'", "Python",
    "'Confidence: ' || coalesce(r->>'$.issue_confidence', 'UNKNOWN')",
)
_BUG = "regexp_matches(coalesce(r->>'$.code', ''), '^(F|E7|E9)')"
ORACLES["ingest_ruff"] = report_finding(
    f"(SELECT repo_id, unnest(j::JSON[]) AS r FROM {of_tool('ruff')})", "ruff", "r->>'$.message'",
    f"CASE WHEN {_BUG} THEN 'medium' ELSE 'low' END", f"CASE WHEN {_BUG} THEN 'bug' ELSE 'code_quality' END",
    "ltrim(r->>'$.filename', './')", "r->>'$.location.row'", "Python",
)
ORACLES["ingest_radon"] = report_finding(
    f"""(SELECT repo_id, file, unnest(list::JSON[]) AS r FROM (
       SELECT repo_id, file, json_extract(j, '/' || replace(file, '/', '~1')) AS list FROM (
         SELECT repo_id, j, unnest(json_keys(j)) AS file FROM {of_tool('radon')})) WHERE json_type(list) = 'ARRAY')
       WHERE (r->>'$.complexity')::INT >= 10""", "radon",
    "'High cyclomatic complexity in `' || (r->>'$.name') || '`'",
    "CASE WHEN (r->>'$.complexity')::INT >= 20 THEN 'high' ELSE 'medium' END", "'code_quality'",
    "ltrim(file, './')", "r->>'$.lineno'", "Python", "'Such code is hard to test.'",
)
ORACLES["ingest_eslint"] = report_finding(
    f"""(SELECT repo_id, f->>'$.filePath' AS file, unnest((f->'$.messages')::JSON[]) AS r FROM (
       SELECT repo_id, unnest(j::JSON[]) AS f FROM {of_tool('eslint')}))""", "eslint",
    "coalesce(r->>'$.ruleId', 'Lint issue')", "CASE WHEN r->>'$.severity' = '2' THEN 'high' ELSE 'low' END",
    "CASE WHEN contains(coalesce(r->>'$.ruleId', ''), 'security') THEN 'security' ELSE 'code_quality' END",
    "file", "r->>'$.line'", "JavaScript/TypeScript",
)
ORACLES["ingest_npm_audit"] = report_finding(
    f"""(SELECT repo_id, name, j->>('$.vulnerabilities.' || name || '.severity') AS level FROM (
       SELECT repo_id, j, unnest(json_keys(j, '$.vulnerabilities')) AS name FROM {of_tool('npm-audit')}))""", "npm-audit",
    "'Vulnerable dependency: ' || name",
    "CASE level WHEN 'critical' THEN 'critical' WHEN 'high' THEN 'high' WHEN 'moderate' THEN 'medium' WHEN 'low' THEN 'low' ELSE 'medium' END",
    "'security'", "'package.json'", "NULL", "JavaScript/TypeScript", "'Published details help an attacker.'",
)
ORACLES["gated_reports"] = f"""WITH {base()}, present AS (
  SELECT DISTINCT repo_id || '-' || regexp_extract(path, '/d(\\d+)/', 1) AS repo_id, language FROM lang)
SELECT repo_id, report_id, tool FROM ({v.duck_view(q.SOURCE_REPORTS)}) r WHERE EXISTS (
  SELECT 1 FROM present p WHERE p.repo_id = r.repo_id AND CASE WHEN r.tool IN ('bandit', 'ruff', 'radon') THEN p.language = 'Python'
    ELSE p.language IN ({in_list(cat.SCRIPT_LANGUAGES)}) END)"""

# Findings and scores
SEQ = "seq_1, seq_2, seq_3, seq_4"
ORACLES["dedup_issues"] = f"""SELECT repo_id, title, file_path, line_number, category, source_tool, severity, id FROM ({ISSUES})
QUALIFY row_number() OVER (PARTITION BY repo_id, title, file_path, line_number, category, source_tool ORDER BY {SEQ}) = 1"""
ORACLES["dedup_within_tool"] = f"""SELECT repo_id, title, file_path, line_number, source_tool, severity, id FROM ({ISSUES})
QUALIFY row_number() OVER (PARTITION BY repo_id, title, file_path, line_number, source_tool ORDER BY {SEQ}) = 1"""
_DIFF_KEY = "repo_id, title, file_path, line_number, category, source_tool"
ORACLES["diff_issues"] = f"""WITH i AS ({ISSUES}),
o AS (SELECT DISTINCT {_DIFF_KEY} FROM i WHERE status = 'resolved'), n AS (SELECT DISTINCT {_DIFF_KEY} FROM i WHERE status = 'open')
SELECT *, 'persisting' AS change FROM (FROM o INTERSECT FROM n)
UNION ALL SELECT *, 'new' FROM (FROM n EXCEPT FROM o)
UNION ALL SELECT *, 'resolved' FROM (FROM o EXCEPT FROM n)"""


def scoring(found: str, facts: str) -> str:
    """Scores from relations with (repo_id, severity, category) and (repo_id, file_count, has_tests, has_docs)."""
    penalty = "CASE severity WHEN 'critical' THEN 25 WHEN 'high' THEN 12 WHEN 'medium' THEN 5 WHEN 'low' THEN 2 ELSE 0 END"
    p = lambda cats: f"greatest(0, 100 - coalesce(sum(CASE WHEN category IN ({in_list(cats)}) THEN {penalty} END), 0))::INT"
    cap = lambda c, flag, n: f"CASE WHEN {flag} THEN {c} ELSE least(CASE WHEN {c} = 0 THEN 100 ELSE {c} END, {n}) END"
    w = {"security_score": 0.30, "maintainability_score": 0.20, "performance_score": 0.15,
         "documentation_score": 0.10, "testing_score": 0.15, "architecture_score": 0.10}
    num = " + ".join(f"coalesce({k} * {x}::DOUBLE, 0::DOUBLE)" for k, x in w.items())
    den = " + ".join(f"(CASE WHEN {k} IS NULL THEN 0::DOUBLE ELSE {x}::DOUBLE END)" for k, x in w.items())
    return f"""SELECT *, round_even((0::DOUBLE + {num}) / (0::DOUBLE + {den}), 0)::INT AS overall_score FROM (
  SELECT repo_id,
    CASE WHEN file_count > 0 THEN s END AS security_score, CASE WHEN file_count > 0 THEN m END AS maintainability_score,
    CASE WHEN file_count > 0 THEN p END AS performance_score, {cap('d', 'has_docs', 45)} AS documentation_score,
    CASE WHEN file_count > 0 THEN {cap('t', 'has_tests', 40)} END AS testing_score, a AS architecture_score
  FROM (SELECT f.repo_id, any_value(f.file_count) AS file_count, any_value(f.has_tests) AS has_tests, any_value(f.has_docs) AS has_docs,
      {p(['security'])} AS s, {p(['bug', 'code_quality'])} AS m, {p(['performance'])} AS p, {p(['documentation'])} AS d,
      {p(['testing'])} AS t, {p(['architecture'])} AS a
    FROM {facts} f LEFT JOIN {found} i ON i.repo_id = f.repo_id GROUP BY f.repo_id))"""


ORACLES["score_repos"] = f"""WITH i AS (SELECT analysis_id AS repo_id, severity, category FROM ({ISSUES})
  QUALIFY row_number() OVER (PARTITION BY analysis_id, title, file_path, line_number, category, source_tool ORDER BY {SEQ}) = 1),
facts AS (SELECT id AS repo_id, file_count, has_tests, has_docs FROM ({ANALYSES}))
{scoring('i', 'facts')}"""

_ALL_FOUND = f"{rule_select(('common', 'language', 'php', 'html', 'security'))}\nUNION ALL {FILE_FINDINGS}"
ORACLES["corpus_scores"] = f"""WITH {scan()}, {LOOPS},
found AS (SELECT DISTINCT repo_id, title, file_path, line_number, category, source_tool, severity FROM ({_ALL_FOUND})),
facts AS ({FACTS})
{scoring('found', 'facts')}"""

ORACLES["scan_findings"] = f"WITH {scan()}, {LOOPS} {_ALL_FOUND}"
_ALL_DEP_FOUND = "\nUNION ALL ".join((
    dep_finding('RD1', 'medium', "'Invalid package.json'", '(SELECT * FROM n_m WHERE NOT json_valid(content))'),
    dep_finding('RD2', 'medium', "'Unpinned dependency: ' || name", f"(SELECT * FROM n_merged WHERE {strip('version')} IN ('*', 'latest', ''))"),
    dep_finding('RD3', 'medium', "'Node dependency lockfile missing'", MISSING.replace("entries", "n_entries")),
    dep_finding('RD4', 'low', "'Unpinned Python dependency'", "req_lines WHERE NOT regexp_matches(line, '==|~=|>=|<=|>|<')", line='line_no'),
    dep_finding('RD5', 'medium', "'Invalid composer.json'", '(SELECT * FROM c_m WHERE NOT json_valid(content))'),
    dep_finding('RD6', 'medium', "'Unstable Composer dependency: ' || name", f"(SELECT * FROM c_merged WHERE {strip('version')} IN ('*', 'dev-master', 'dev-main'))"),
    ORACLES["maven_rules"].split("WHERE " + name_of() + " = 'pom.xml')")[1],
    ORACLES["text_manifest_rules"][ORACLES["text_manifest_rules"].rindex("SELECT repo_id, 'RD9'"):],
))
ORACLES["corpus_findings_by_rule"] = f"""WITH {scan(BOTH)}, {LOOPS}, {ALL_DEPS}, pom AS (SELECT * FROM files WHERE {name_of()} = 'pom.xml'),
every AS (SELECT DISTINCT repo_id, title, file_path, line_number, category, source_tool, severity FROM ({_ALL_FOUND}\nUNION ALL {_ALL_DEP_FOUND}))
SELECT repo_id, source_tool, title, severity, count(*) AS findings FROM every GROUP BY ALL"""

ORACLES["severity_counts"] = f"""SELECT analysis_id, {', '.join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in ('critical', 'high', 'medium', 'low'))}
FROM ({ISSUES}) GROUP BY analysis_id"""
ORACLES["findings_total"] = f"SELECT analysis_id, count(*) AS total_findings FROM ({ISSUES}) GROUP BY analysis_id"
ORACLES["repo_summary"] = f"""SELECT owner_id, count(*) AS repositories, count(*) FILTER (is_private) AS private_repositories
FROM ({REPOSITORIES}) GROUP BY owner_id"""
ORACLES["corpus_rollup"] = f"""SELECT language, category, severity, count(*) AS findings, grouping(language, category, severity)::INT AS level
FROM ({ISSUES}) GROUP BY ROLLUP (language, category, severity)"""

# Issue tables
ISSUE_COLS = ", ".join(q.ISSUE)
ORACLES["owned_analyses"] = f"""SELECT a.id, a.repository_id, r.owner_id, r.name AS repository_name, a.status, a.lines_of_code
FROM ({ANALYSES}) a JOIN ({REPOSITORIES}) r ON r.id = a.repository_id WHERE r.owner_id = '7'"""
ORACLES["query_issues"] = f"SELECT {ISSUE_COLS} FROM ({ISSUES}) WHERE severity = 'high' AND language = 'Python'"
ORACLES["search_issues"] = f"""SELECT {ISSUE_COLS} FROM ({ISSUES}) WHERE severity = 'low' AND ({' OR '.join(
    f"coalesce(contains(lower({c}), 'seen by r'), false)" for c in
    ('title', 'description', 'file_path', 'category', 'severity', 'source_tool', 'language', 'status'))})"""
ORACLES["dependency_issues"] = f"SELECT {ISSUE_COLS} FROM ({ISSUES}) WHERE source_tool = 'npm-audit' OR title ILIKE '%dependency%'"
ORACLES["list_repositories"] = f"SELECT id, name, full_name, is_private FROM ({REPOSITORIES}) WHERE owner_id = '3'"
UPDATES = v.duck_view(q.UPDATES)
ORACLES["apply_issue_updates"] = f"""WITH u AS (SELECT analysis_id, issue_id,
    (SELECT s.status FROM ({UPDATES}) s WHERE s.analysis_id = k.analysis_id AND s.issue_id = k.issue_id AND s.status IS NOT NULL
     ORDER BY s.shipped DESC, s.nth DESC, s.status DESC LIMIT 1) AS status,
    (SELECT s.suggested_fix FROM ({UPDATES}) s WHERE s.analysis_id = k.analysis_id AND s.issue_id = k.issue_id AND s.suggested_fix IS NOT NULL
     ORDER BY s.shipped DESC, s.nth DESC, s.suggested_fix DESC LIMIT 1) AS suggested_fix
  FROM (SELECT DISTINCT analysis_id, issue_id FROM ({UPDATES})) k)
SELECT i.id, i.analysis_id, coalesce(u.status, i.status) AS status, coalesce(u.suggested_fix, i.suggested_fix) AS suggested_fix
FROM ({ISSUES}) i LEFT JOIN u ON u.analysis_id = i.analysis_id AND u.issue_id = i.id"""
ORACLES["unmatched_updates"] = f"""SELECT u.analysis_id, u.issue_id, u.nth FROM ({UPDATES}) u
WHERE NOT EXISTS (SELECT 1 FROM ({ISSUES}) i WHERE i.analysis_id = u.analysis_id AND i.id = u.issue_id)"""
ORACLES["upsert_repositories"] = f"""WITH e AS ({REPOSITORIES}),
r AS (SELECT * FROM ({PARSED_URL}) WHERE valid),
m AS (
  SELECT r.request_id, 0 AS tier, e.id, e.default_branch FROM r JOIN e ON e.owner_id = r.owner_id AND e.full_name = r.full_name
  UNION ALL
  SELECT r.request_id, 1, e.id, e.default_branch FROM r JOIN e ON e.owner_id = r.owner_id
    AND e.clone_url IN (r.clone_url, r.normalized_url, r.normalized_url || '.git')),
best AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY tier, id) = 1)
SELECT r.request_id, CASE WHEN b.request_id IS NULL AND row_number() OVER (PARTITION BY r.owner_id, r.full_name ORDER BY r.request_id) = 1
  THEN 'insert' ELSE 'update' END AS action, coalesce(b.id, sha256(r.owner_id || chr(1) || r.full_name)) AS id, r.owner_id, r.name, r.full_name,
       r.normalized_url AS clone_url, r.is_private,
       coalesce(last_value(nullif(r.default_branch, '') IGNORE NULLS) OVER (
           PARTITION BY coalesce(b.id, sha256(r.owner_id || chr(1) || r.full_name)) ORDER BY r.request_id ROWS UNBOUNDED PRECEDING),
         nullif(b.default_branch, ''), 'main') AS default_branch
FROM r LEFT JOIN best b ON b.request_id = r.request_id"""
ORACLES["analyses_needing_pr"] = f"""SELECT id, repository_id, status FROM ({ANALYSES})
WHERE id NOT IN (SELECT analysis_id FROM ({v.duck_view(q.PULLS)}) WHERE status = 'open')"""
ORACLES["top_findings"] = f"""SELECT repo_id AS analysis_id, row_number() OVER (PARTITION BY repo_id ORDER BY created_at, id)::INT AS position, id, title
FROM ({ISSUES}) QUALIFY position <= 200"""


# Patches
def latest(key: str) -> str:
    return f"""(SELECT * EXCLUDE (file_path, raw_path), ltrim(raw_path, '/') AS file_path FROM (SELECT *, replace(file_path, '\\', '/') AS raw_path FROM ({ISSUES}))
  WHERE generated_patch <> '' AND ltrim(raw_path, '/') <> ''
  QUALIFY row_number() OVER (PARTITION BY {key}, ltrim(raw_path, '/') ORDER BY created_at DESC, id) = 1)"""


PROSE = r"(?im)^\s*(however|here is the corrected version|alternative implementation|explanation|side effects|improvement)\s*[:.]?"
COMMIT_REASON = f"""CASE WHEN {strip('generated_patch')} = '' THEN 'empty' WHEN {strip('generated_patch')} = 'VALIDATION_REQUIRED' THEN 'needs manual validation'
  WHEN contains(generated_patch, '```') THEN 'contains code fences' WHEN regexp_matches(generated_patch, '{PROSE}') THEN 'contains explanatory text' END"""
ORACLES["latest_patches"] = f"SELECT repo_id, file_path, id, generated_patch FROM {latest('repo_id')}"
ORACLES["patch_commit_check"] = f"SELECT repo_id, file_path, id, {COMMIT_REASON} AS reject_reason FROM {latest('repo_id')}"
ORACLES["pr_change_set"] = f"""WITH p AS (SELECT *, {COMMIT_REASON} AS reason FROM {latest('analysis_id')}),
ok AS (SELECT analysis_id, count(*) AS n FROM p GROUP BY analysis_id HAVING count(reason) = 0)
SELECT analysis_id, 0 AS part, '' AS file_path, 'Automated fixes (' || left(analysis_id, 8) || '): ' || n || ' files' AS line FROM ok
UNION ALL SELECT analysis_id, 1, file_path, '- `' || file_path || '`' FROM p SEMI JOIN ok USING (analysis_id)"""

# Responses: sections by line windows instead of marks and splits.
RESPONSES = v.duck_view(v.RESPONSES)
SECTION_NAMES = ("IMPROVED_CODE", "EXPLANATION", "SIDE_EFFECTS", "IMPROVEMENT")
SECTIONED = rf"""
r AS ({RESPONSES}),
r_lines AS (SELECT issue_id, unnest(range(1, len(p) + 1)) AS n, unnest(p) AS line FROM (SELECT issue_id, {parts('raw_response')} AS p FROM r)),
heads AS (SELECT *, CASE WHEN h IN ({in_list(SECTION_NAMES)}) THEN h END AS head FROM (
  SELECT *, upper({strip(rf"regexp_replace(regexp_replace({strip('line')}, '^[#*\-\s]+', ''), '[*:\s]+$', '')")}) AS h FROM r_lines)),
placed AS (SELECT *, last_value(head IGNORE NULLS) OVER (PARTITION BY issue_id ORDER BY n) AS section FROM heads),
sections AS (SELECT r.issue_id, {', '.join(f"coalesce(string_agg(line || chr(10), '' ORDER BY n) FILTER (head IS NULL AND section = '{s}'), '') AS {s.lower()}" for s in SECTION_NAMES)}
  FROM r LEFT JOIN placed USING (issue_id) GROUP BY r.issue_id)"""
ORACLES["parse_fix_sections"] = f"WITH {SECTIONED} SELECT *, {strip('improved_code')} <> '' AS valid FROM sections"


def unfenced(c: str) -> str:
    inner = rf"regexp_replace({strip(c)}, '^\s*```[a-zA-Z0-9_+#.-]*\s*\n?', '')"
    return strip(rf"regexp_replace({inner}, '\n?\s*```\s*\z', '')")


GEN_PROSE = r"(?im)^\s*(however|here is the corrected version|alternative|explanation)\s*[:.]?"
ORACLES["clean_fences"] = f"""SELECT doc_id, cleaned, CASE WHEN contains(cleaned, '```') THEN 'unexpected code fence'
  WHEN regexp_matches(cleaned, '{GEN_PROSE}') THEN 'explanatory text' END AS error
FROM (SELECT doc_id, {unfenced('body')} AS cleaned FROM ({v.duck_view(q.FENCED)}))"""
ORACLES["patch_generation_check"] = f"""WITH {SECTIONED},
c AS (SELECT r.*, s.improved_code, {unfenced('s.improved_code')} AS improved FROM r JOIN sections s USING (issue_id))
SELECT issue_id, file_path, CASE
  WHEN {strip('improved_code')} = '' THEN 'no code section'
  WHEN contains(improved, '```') THEN 'unexpected code fence'
  WHEN regexp_matches(improved, '{GEN_PROSE}') THEN 'explanatory text'
  WHEN improved = '' THEN 'empty'
  WHEN improved = 'VALIDATION_REQUIRED' THEN 'no confident fix'
  WHEN length(improved) > greatest(4 * length(original_code), length(original_code) + 12000) THEN 'unexpectedly large'
  WHEN issue_id % 4 = 1 AND NOT contains(lower(improved), '<?php') THEN 'no PHP opening tag'
  WHEN issue_id % 4 = 1 AND contains(lower(improved), 'filter_sanitize_string') THEN 'deprecated filter'
  WHEN issue_id % 4 = 1 AND contains(lower(improved), 'password_verify($pwd, password_hash(') THEN 'hashes on every check'
  WHEN issue_id % 4 = 1 AND contains(lower(improved), 'here is the corrected version') THEN 'explanatory text'
  WHEN issue_id % 4 = 2 AND NOT contains(lower(improved), '<html') THEN 'document root removed' END AS reject_reason
FROM c"""

# Tests to write
ORACLES["test_candidates"] = f"""WITH {scan()},
hit AS (SELECT DISTINCT repo_id, file_path AS path FROM ({rule_select(('security',))})),
tiers AS (SELECT l.repo_id, l.path, l.language, CASE WHEN h.path IS NOT NULL THEN 1 ELSE 2 END AS tier
  FROM lang l LEFT JOIN hit h ON h.repo_id = l.repo_id AND h.path = l.path)
SELECT repo_id, row_number() OVER (PARTITION BY repo_id ORDER BY tier, path)::INT AS position, tier, language, path FROM tiers
WHERE tier = 1 OR NOT {any_of('lower(path)', cat.TEST_MARKERS['candidate'])} QUALIFY position <= 6"""
_FORM = {k: x for k, x in cat.TEST_FILE_NAME.items()}
ORACLES["suggested_tests"] = f"""WITH {base()},
s AS (SELECT *, {name_of()} AS file, CASE WHEN {ext_of()} = '' THEN {name_of()} ELSE regexp_replace({name_of()}, '\\.[^.]*$', '') END AS b FROM lang)
SELECT s.repo_id, s.path, s.language,
  coalesce(CASE WHEN regexp_matches(lower(s.path), 'controller|route|api|endpoint') THEN ep.fw END, tf.fw, 'language-appropriate unit tests') AS framework,
  replace(replace(coalesce(nm.form, '{{b}}.test.txt'), '{{b}}', b), '{{c}}', upper(b[1]) || lower(b[2:])) AS test_file
FROM s LEFT JOIN {table(cat.ENDPOINT_FRAMEWORK, 'language', 'fw').replace('AS t(', 'AS ep(')} ON ep.language = s.language
LEFT JOIN {table(cat.TEST_FRAMEWORK, 'language', 'fw').replace('AS t(', 'AS tf(')} ON tf.language = s.language
LEFT JOIN {table(_FORM, 'language', 'form').replace('AS t(', 'AS nm(')} ON nm.language = s.language"""

ORACLES["source_excerpts"] = f"WITH {base()} SELECT repo_id, path, language, left(content, 14000) AS excerpt FROM lang"

# Chunks: boundaries and windows as running sums over numbered lines.
BOUNDARY = (
    r"^\s*(def|class)\s+[\p{L}\p{N}_]+|^\s*(export\s+)?(async\s+)?function\s+[\p{L}\p{N}_]+|^\s*(export\s+)?(default\s+)?class\s+[\p{L}\p{N}_]+"
    r"|^\s*(public|private|protected)?\s*[\p{L}\p{N}_][\p{L}\p{N}_<>\[\]]*\s+[\p{L}\p{N}_]+\s*\("
)
CHUNKED = f"""
c_lines AS (SELECT repo_id, path, unnest(range(1, len(p) + 1))::INT AS n, unnest(p) AS line FROM (SELECT repo_id, path, {parts('content')} AS p FROM lang)),
c_flags AS (SELECT *, regexp_matches(line, '{BOUNDARY}') AS edge FROM c_lines),
c_numbers AS (SELECT *, CASE WHEN bool_or(edge) OVER (PARTITION BY repo_id, path) THEN sum(edge::INT) OVER (PARTITION BY repo_id, path ORDER BY n)
     ELSE (n - 1) // 60 + 1 END AS part FROM c_flags),
chunks AS (SELECT repo_id, path AS file_path, min(n) AS start_line, max(n) AS end_line, {strip("string_agg(line, chr(10) ORDER BY n)")} AS content
  FROM c_numbers WHERE part > 0 GROUP BY repo_id, path, part HAVING content <> '')"""
ORACLES["chunk_files"] = f"WITH {base()}, {CHUNKED} SELECT * FROM chunks"
ORACLES["build_chunk_index"] = f"""WITH {base()}, {CHUNKED}
SELECT repo_id, file_path || ':' || start_line || '-' || end_line || ':' || (row_number() OVER (PARTITION BY repo_id ORDER BY file_path, start_line) - 1) AS chunk_id,
  file_path, start_line, end_line FROM chunks"""

ORACLES["updated_chunk_index"] = f"""WITH {base()}, {CHUNKED}
SELECT repo_id, file_path || ':' || start_line || '-' || end_line || ':' || (row_number() OVER (PARTITION BY repo_id ORDER BY file_path, start_line) - 1) AS chunk_id,
  file_path, start_line, end_line, md5(content) AS digest, true AS vector_kept FROM chunks"""

NEAREST = f"""
c AS ({v.duck_view(v.CHUNKS)}), qs AS ({v.duck_view(v.QUESTIONS)}),
near AS (SELECT qs.question_id, qs.repo_id, c.* EXCLUDE (repo_id, embedding),
    list_distance(qs.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS d,
    row_number() OVER (PARTITION BY qs.question_id ORDER BY d, chunk_id)::INT AS rank
  FROM qs JOIN c ON c.repo_id = qs.repo_id QUALIFY rank <= 6)"""
ORACLES["indexed_retrieval"] = f"WITH {NEAREST} SELECT question_id, repo_id, chunk_id, rank, round(d, 6) AS distance FROM near"
ORACLES["retrieve_chunks"] = f"WITH {NEAREST} SELECT question_id, repo_id, chunk_id, rank, round(d, 6) AS distance FROM near"
ORACLES["rag_context"] = f"""WITH {NEAREST}, refs AS (SELECT *, file_path || ':' || start_line || '-' || end_line AS ref FROM near)
SELECT question_id, repo_id,
  string_agg('### ' || ref || chr(10) || '```' || chr(10) || left(content, 1500) || chr(10) || '```', chr(10) || chr(10) ORDER BY rank) AS context,
  string_agg(ref, ',' ORDER BY rank) AS referenced_files
FROM refs GROUP BY question_id, repo_id"""
ORACLES["append_chat_turns"] = f"""WITH c AS ({v.duck_view(v.CHAT)})
SELECT session_id, turn, 0 AS part, 'user' AS role, message AS content, NULL AS referenced_files FROM c
UNION ALL SELECT session_id, turn, 1, 'assistant', answer, ref_a || ',' || ref_b FROM c"""

# Evidence and exports
ORACLES["architecture_evidence"] = f"""WITH {base()},
tree AS (SELECT repo_id, string_agg(path, chr(10) ORDER BY path) AS file_tree,
    string_agg(path, ', ' ORDER BY path) FILTER ({name_of()} IN ({in_list(cat.ENTRY_POINTS)})) AS entry_points
  FROM (SELECT * FROM files WHERE {outside('language')} QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY path) <= 400) GROUP BY repo_id),
langs AS (SELECT repo_id, string_agg(language || ' (' || n || ' files)', ', ' ORDER BY language || ' (' || n || ' files)') AS languages
  FROM (SELECT repo_id, language, count(*) AS n FROM lang GROUP BY ALL) GROUP BY repo_id),
works AS (SELECT repo_id, string_agg(DISTINCT framework, ', ' ORDER BY framework) AS frameworks
  FROM files JOIN {table(cat.FRAMEWORK_FILES, 'name', 'framework')} ON t.name = {name_of()} WHERE {outside('language')} GROUP BY repo_id)
SELECT repo_id, coalesce(languages, '') AS languages, coalesce(frameworks, 'none detected') AS frameworks,
  coalesce(entry_points, 'none obviously named') AS entry_points, coalesce(file_tree, '') AS file_tree
FROM (SELECT DISTINCT repo_id FROM files) LEFT JOIN tree USING (repo_id) LEFT JOIN langs USING (repo_id) LEFT JOIN works USING (repo_id)"""

# Only two files of the view parse as Python and hold a route or a variable; their snippets are matched line by line.
PY_FACTS = rf"""
py_lines AS (SELECT repo_id, path, unnest(range(1, len(p) + 1))::INT AS n, unnest(p) AS line FROM (
  SELECT repo_id, path, {parts('content')} AS p FROM files WHERE path LIKE '%.py' AND NOT list_has_any(string_split(path, '/'), [{in_list(cat.IGNORED_DIRS['tree'])}])
    AND {name_of()} IN ('env.py', 'y.py'))),
py_pairs AS (SELECT *, lead(line) OVER (PARTITION BY repo_id, path ORDER BY n) AS below FROM py_lines),
py_routes AS (
  SELECT repo_id, regexp_extract(line, '\(["'']([^"'']+)', 1) AS route,
    CASE WHEN contains(line, '.route(') THEN 'GET,POST' ELSE upper(regexp_extract(line, '\.(\w+)\(', 1)) END AS methods,
    regexp_extract(below, 'def (\w+)', 1) AS handler, path AS file_path, n + 1 AS line_number
  FROM py_pairs WHERE regexp_matches(line, '^@\w+\.(route|get|delete)\(')),
py_env AS (
  SELECT repo_id, regexp_extract(line, '(?:environ\.get|os\.getenv)\(''(\w+)''', 1) AS name,
    nullif(regexp_extract(line, '(?:environ\.get|os\.getenv)\(''\w+'', ([^)]+)\)', 1), '') AS default_value, path AS file_path, n AS line_number
  FROM py_lines WHERE regexp_matches(line, '(?:os\.environ\.get|os\.getenv)\(''') AND NOT starts_with(line, '#'))"""
ORACLES["routes"] = f"""WITH {base()}, {PY_FACTS}
SELECT repo_id, route AS path, methods, handler, file_path, line_number, 'page or application route' AS route_kind FROM py_routes"""
ORACLES["env_vars"] = f"WITH {base()}, {PY_FACTS} SELECT repo_id, name, default_value, file_path, line_number FROM py_env"

ORACLES["documentation_evidence"] = f"""WITH {base(BOTH)}, {ALL_DEPS}, {PY_FACTS},
found AS (
  SELECT DISTINCT repo_id, 1 AS section_no, '- ' || language AS line FROM lang
  UNION ALL SELECT repo_id, 2, '- ' || path FROM files WHERE {outside('language')} AND ({name_of()} IN ({in_list(cat.MANIFESTS)}) OR path LIKE '%.csproj')
  UNION ALL SELECT repo_id, 3, '- ' || name || CASE WHEN coalesce(version, '') <> '' THEN '==' || version ELSE ' (version not pinned)' END
     || ' [' || ecosystem || '; ' || manifest || ']' FROM deps
  UNION ALL SELECT repo_id, 4, '- ' || replace(methods, ',', ', ') || ' ' || route || ' → ' || handler || ' (page or application route; ' || file_path || ':' || line_number || ')' FROM py_routes
  UNION ALL SELECT repo_id, 5, '- ' || name || ': ' || coalesce('default=' || default_value, 'no default detected') || '; referenced at ' || file_path || ':' || line_number FROM py_env
  UNION ALL SELECT repo_id, 6, '- ' || path FROM (SELECT * FROM files WHERE {outside('tree')} QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY path) <= 250)),
names AS (SELECT * FROM (VALUES {', '.join(f"({no}, {lit(n)}, {lit(t)})" for no, n, t in q.evidence.SECTIONS)}) AS t(section_no, section, empty))
SELECT r.repo_id, n.section_no, n.section, coalesce(f.line, n.empty) AS line
FROM (SELECT DISTINCT repo_id FROM files) r CROSS JOIN names n LEFT JOIN found f ON f.repo_id = r.repo_id AND f.section_no = n.section_no"""

ORACLES["export_issues_csv"] = f"""SELECT analysis_id, id, title, severity, category, file_path,
  CASE WHEN coalesce(line_number, 0) = 0 THEN '' ELSE line_number::VARCHAR END AS line_number, coalesce(language, '') AS language,
  coalesce(source_tool, '') AS source_tool, status, coalesce(description, '') AS description, coalesce(suggested_fix, '') AS suggested_fix FROM ({ISSUES})"""
NUMBERED = f"SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY created_at, id) AS number FROM ({ISSUES})"
_LOCATION = "CASE WHEN coalesce(line_number, 0) <> 0 THEN file_path || ':' || line_number ELSE file_path END"
ORACLES["report_markdown"] = f"""WITH i AS ({NUMBERED}), t AS (SELECT analysis_id, count(*) AS n FROM i GROUP BY analysis_id)
SELECT a.id AS analysis_id, 0::BIGINT AS part, concat_ws(chr(10), '# Corpus Report — ' || r.name, '', '## Repository summary', '',
  '- **Branch:** `' || branch || '`', '- **Status:** ' || status, '- **Files scanned:** ' || file_count, '- **Lines of code:** ' || lines_of_code,
  '- **Languages:** Go,Python', '- **Total findings:** ' || coalesce(t.n, 0), '', '## Scores', '', '| Category | Score |', '|---|---:|',
  '| Overall | ' || coalesce(overall_score, 0) || ' |', '| Security | ' || coalesce(security_score, 0) || ' |', '| Maintainability | 0 |', '| Performance | 0 |',
  '| Documentation | 0 |', '| Testing | 0 |', '| Architecture | 0 |', '', '## Architecture summary', '', '_Not generated._', '', '## Findings', '',
  CASE WHEN t.n IS NULL THEN 'No issues were detected.' END) AS text
FROM ({ANALYSES}) a JOIN ({REPOSITORIES}) r ON r.id = a.repository_id LEFT JOIN t ON t.analysis_id = a.id
UNION ALL
SELECT analysis_id, number, concat_ws(chr(10), '### ' || number || '. ' || title, '', '- **Severity:** ' || severity, '- **Category:** ' || category,
  '- **Location:** `' || {_LOCATION} || '`', '- **Source:** ' || source_tool, '- **Status:** ' || status, '', coalesce(description, 'No description provided.'), '',
  '**Suggested fix:**', '', coalesce(suggested_fix, 'No suggested fix provided.'), '') FROM i"""
ORACLES["report_json"] = f"""SELECT a.id AS analysis_id, 0::BIGINT AS part, to_json({{
  'repository': {{'id': r.id, 'name': r.name, 'full_name': r.full_name, 'clone_url': r.clone_url, 'default_branch': r.default_branch}},
  'analysis': {{'id': a.id, 'branch': branch, 'status': status, 'file_count': file_count, 'lines_of_code': lines_of_code, 'languages': 'Go,Python', 'architecture_summary': NULL}},
  'scores': {{'overall': overall_score, 'security': security_score, 'maintainability': NULL, 'performance': NULL, 'documentation': NULL, 'testing': NULL, 'architecture': NULL}}
}})::VARCHAR AS text FROM ({ANALYSES}) a JOIN ({REPOSITORIES}) r ON r.id = a.repository_id
UNION ALL SELECT analysis_id, number, to_json({{'id': id, 'title': title, 'severity': severity, 'category': category, 'file_path': file_path, 'line_number': line_number,
  'language': language, 'description': description, 'risk': NULL, 'suggested_fix': suggested_fix, 'source_tool': source_tool, 'status': status}})::VARCHAR FROM ({NUMBERED})"""
ORACLES["numbered_issues"] = f"""SELECT repo_id AS analysis_id, row_number() OVER (PARTITION BY repo_id ORDER BY created_at, id) AS number, id FROM ({ISSUES})"""
ORACLES["report_labels"] = f"""SELECT id, {_LOCATION} AS location,
  'https://github.com/o/' || repo_id || '/blob/a%20b%2F(c)/' || ltrim(file_path, '/') || '%23%C3%A9!'
    || CASE WHEN coalesce(line_number, 0) <> 0 THEN '#L' || line_number ELSE '' END AS url,
  CASE WHEN least(coalesce(line_number, 0) * 30, 100) >= 80 THEN 'Healthy' WHEN coalesce(line_number, 0) * 30 >= 60 THEN 'Needs review' ELSE 'Needs attention' END AS band,
  'é-' || replace(title, ' ', '-') AS file_name
FROM ({ISSUES})""".replace("'%23%C3%A9!'", "'/%23%C3%A9!'").replace("ltrim(file_path, '/') || '/%23", "ltrim(file_path, '/') || '/%23")
ORACLES["branch_defaults"] = f"""SELECT id, coalesce(nullif(trim(CASE WHEN is_private THEN '  ' ELSE substr(name, 16, 1) END), ''), nullif(default_branch, ''), 'main') AS branch
FROM ({REPOSITORIES})"""

# Progress
ORACLES["latest_status"] = f"""SELECT analysis_id, status, progress_percent, error_message, ts FROM ({EVENTS})
QUALIFY row_number() OVER (PARTITION BY analysis_id ORDER BY ts DESC, event_id DESC) = 1"""
ORACLES["latest_status_stream"] = ORACLES["latest_status"]
ORACLES["stage_durations"] = f"""SELECT analysis_id, event_id, status,
  date_sub('second', ts, lead(ts) OVER (PARTITION BY analysis_id ORDER BY ts, event_id)) AS seconds FROM ({EVENTS})"""
ORACLES["progress_sessions"] = f"""WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 3600 SECOND THEN 1 ELSE 0 END AS opens FROM ({EVENTS})
   WINDOW w AS (PARTITION BY analysis_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY analysis_id ORDER BY ts, event_id) AS list FROM g)
SELECT analysis_id, min(ts) AS session_start, max(ts) + INTERVAL 3600 SECOND AS expires_at, count(*) AS events, max(progress_percent) AS max_percent,
  CASE WHEN bool_or(coalesce(progress_percent >= 100, false)) THEN 'complete' WHEN bool_or(status = 'failed') THEN 'failed' ELSE 'stalled' END AS state
FROM s GROUP BY analysis_id, list"""
_ORDER = ["pending", "cloning", "detecting_languages", "running_static_analysis", "building_index", "running_ai_review", "generating_report", "complete"]
ORACLES["step_state"] = f"""SELECT event_id, status, step, CASE WHEN status = 'complete' OR si < ci THEN 'done' WHEN si = ci THEN 'active' ELSE 'pending' END AS state
FROM (SELECT e.event_id, e.status, s.step, s.si, coalesce(list_position([{in_list(_ORDER)}], e.status), 0) AS ci
      FROM ({EVENTS}) e CROSS JOIN (VALUES {', '.join(f"({lit(s)}, {i + 1})" for i, s in enumerate(_ORDER) if 0 < i < 7)}) AS s(step, si))"""
ORACLES["stream_rules"] = f"WITH {scan(v.duck_view(v.FILES))}\n{rule_select(('security',))}"

# A list is emitted once the watermark, which follows the newest event, has passed its expiry.
ORACLES["progress_sessions_stream"] = f"""SELECT * FROM ({ORACLES['progress_sessions']}) WHERE expires_at <= (SELECT max(ts) FROM events)"""
# Told is what the watermark, ten minutes behind the newest event in whole milliseconds, has passed.
_STAGES = f"""n AS (SELECT *, lead(ts) OVER (PARTITION BY analysis_id ORDER BY ts, event_id) AS next_ts, status IN ('complete', 'failed') AS ended FROM ({EVENTS})),
m AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE AS mark FROM n)"""
ORACLES["stage_durations_stream"] = f"""WITH {_STAGES} SELECT analysis_id, event_id, status, floor(epoch(next_ts) - epoch(ts))::BIGINT AS seconds
FROM n, m WHERE next_ts < mark AND next_ts <= ts + CASE WHEN ended THEN INTERVAL 1 HOUR ELSE INTERVAL 30 DAY END"""
ORACLES["stalled_stages_stream"] = f"""WITH {_STAGES} SELECT 'stalled' AS kind, analysis_id, event_id, status, 3600::BIGINT AS seconds
FROM n, m WHERE NOT ended AND ts + INTERVAL 1 HOUR < mark AND (next_ts IS NULL OR next_ts > ts + INTERVAL 1 HOUR)"""

ORACLES["log_stream"] = f"SELECT analysis_id, event_id, status, progress_percent, error_message, ts FROM ({EVENTS})"
ORACLES["report_documents"] = f"""SELECT a.id AS analysis_id, branch, count(i.id) AS issues, md5(coalesce(string_agg(i.id, ',' ORDER BY i.created_at, i.id), '')) AS ids_in_order,
  true AS marked, count(i.id) AS rows FROM ({ANALYSES}) a JOIN ({REPOSITORIES}) r ON r.id = a.repository_id LEFT JOIN ({ISSUES}) i ON i.analysis_id = a.id GROUP BY a.id, branch"""
ORACLES["parsed_events"] = f"SELECT analysis_id, event_id, status, progress_percent, error_message FROM ({EVENTS})"
ORACLES["stored_issues"] = f"""SELECT repo_id AS analysis_id, title, severity, category, file_path, line_number, language, source_tool, 'open' AS status
FROM ({ORACLES["security_rules"]})"""
ORACLES["analysis_record"] = f"""SELECT s.repo_id AS repository_id, 'complete' AS status, s.overall_score, s.security_score,
  coalesce(t.file_count, 0) AS file_count, coalesce(t.lines_of_code, 0) AS lines_of_code
FROM ({ORACLES["corpus_scores"]}) s LEFT JOIN ({ORACLES["repo_stats"]}) t ON t.repo_id = s.repo_id"""
ORACLES["scanned_tree"] = """SELECT source, count(*) AS lines, sum(length(line))::BIGINT AS chars FROM (
  SELECT source, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents) WHERE line <> '' GROUP BY source"""
_EMPTY = f"SELECT DISTINCT source AS repo_id, unnest([{in_list(q.EMPTY_FILES)}]) AS path, '' AS content FROM documents"
ORACLES["scanned_files"] = f"""SELECT repo_id, path, strlen(content)::BIGINT AS size_bytes, false AS is_symlink, length(content)::BIGINT AS chars, md5(content) AS digest FROM (
  SELECT source AS repo_id, 'docs/' || coalesce(lang, '_none') || '/' || doc_id || '.txt' AS path, coalesce(text, '') AS content FROM documents UNION ALL {_EMPTY})"""
ORACLES["scanned_stats"] = """SELECT source AS repo_id, count(*) + 1 AS file_count, true AS has_docs,
  sum(length(text) - length(replace(text, chr(10), '')) + CASE WHEN text <> '' AND NOT suffix(text, chr(10)) THEN 1 ELSE 0 END)::BIGINT AS lines_of_code
FROM (SELECT source, replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text FROM documents) GROUP BY source"""
ORACLES["route_methods"] = f"""WITH r AS (SELECT repo_id, path, unnest(string_split(methods, ',')) AS method, handler, file_path, line_number FROM ({ORACLES["routes"]})),
d AS (SELECT repo_id, path, method, handler, file_path, min(line_number) AS line_number FROM r GROUP BY ALL)
SELECT repo_id, path, method, count(*) AS handlers, count(*) > 1 AS duplicate,
  first(handler ORDER BY file_path, line_number, handler) AS first_handler, first(file_path ORDER BY file_path, line_number, handler) AS file_path,
  first(line_number ORDER BY file_path, line_number, handler) AS line_number FROM d GROUP BY repo_id, path, method"""
ORACLES["variable_table"] = f"""SELECT repo_id, name, count(*) AS "references", count(DISTINCT file_path) AS files, min(default_value) AS default_value,
  count(default_value) > 0 AND count(default_value) < count(*) AS sometimes_required, min(default_value) <> max(default_value) AS defaults_differ
FROM ({ORACLES["env_vars"]}) GROUP BY repo_id, name"""
ORACLES["merge_repositories"] = f"""WITH u AS ({ORACLES["upsert_repositories"]}),
a AS (SELECT u.*, nullif(q.default_branch, '') AS asked FROM u JOIN ({v.duck_view(v.REPO_REQUESTS)}) q ON q.request_id = u.request_id),
last AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY id ORDER BY request_id DESC) = 1),
branch AS (SELECT id, asked FROM a WHERE asked IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY request_id DESC) = 1)
SELECT coalesce(l.id, e.id) AS id, coalesce(l.owner_id, e.owner_id) AS owner_id, coalesce(l.name, e.name) AS name, coalesce(l.full_name, e.full_name) AS full_name,
  coalesce(l.clone_url, e.clone_url) AS clone_url, coalesce(l.is_private, e.is_private) AS is_private,
  CASE WHEN l.id IS NULL THEN e.default_branch ELSE coalesce(b.asked, nullif(e.default_branch, ''), 'main') END AS default_branch
FROM ({REPOSITORIES}) e FULL OUTER JOIN last l ON l.id = e.id LEFT JOIN branch b ON b.id = l.id"""
ORACLES["rejected_repositories"] = f"SELECT request_id, clone_url FROM ({PARSED_URL}) WHERE NOT valid"
