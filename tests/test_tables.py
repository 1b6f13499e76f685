import csv
import json
import random
from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from corpuslens.operators import dependencies as deps
from corpuslens.operators.files import cap_language_files, first_paths, repo_facts, repo_gate, repo_stats
from corpuslens.operators.findings import dedup_findings, diff_issues, first_wins
from corpuslens.operators.numbering import neighbour_on, number_within, offsets_within, ranged
from corpuslens.operators.patches import commit_reject_reason, parse_fix_sections
from corpuslens.operators.reports import json_document, report_json, report_markdown, write_issues_csv, write_reports
from corpuslens.operators.dependencies import dependencies, dependency_findings
from corpuslens.operators.issues import apply_issue_updates, upsert_repositories
from corpuslens.operators.retrieval import NO_INDEX, nearest, rag_context, retrieve_chunks, without_vector
from corpuslens.operators.scores import score_repos
from corpuslens.plans.analysis import analyze_corpus
from corpuslens.schemas import FILES, FINDING_COLUMNS, ISSUES, TABLES
from corpuslens.sources import tool_reports as tr
from corpuslens.sources.python_source import source_facts
from corpuslens.sources.tables import read_table, scan_files, write_issues
from corpuslens.operators.chunks import build_chunk_index, write_chunk_index


def score_in_python(rows, files, tests, docs):
    weights = [("security", ["security"], 0.30), ("maintainability", ["bug", "code_quality"], 0.20), ("performance", ["performance"], 0.15),
               ("documentation", ["documentation"], 0.10), ("testing", ["testing"], 0.15), ("architecture", ["architecture"], 0.10)]
    cost = {"critical": 25, "high": 12, "medium": 5, "low": 2}
    out, num, den = {}, 0.0, 0.0
    for name, cats, w in weights:
        value = max(0, 100 - sum(cost.get(s, 0) for c, s in rows if c in cats))
        if name == "testing" and not tests:
            value = min(value or 100, 40)
        if name == "documentation" and not docs:
            value = min(value or 100, 45)
        if not files and name not in ("documentation", "architecture"):
            out[name] = None
            continue
        out[name] = value
        num, den = num + value * w, den + w
    return {**out, "overall": round(num / den)}


def test_scores_agree(spark):
    rng = random.Random(17)
    cats = ["security", "bug", "performance", "architecture", "code_quality", "documentation", "testing", "odd"]
    sevs = ["critical", "high", "medium", "low", "info", "odd"]
    facts = [(f"r{i}", rng.choice([0, 3, 3]), rng.random() < 0.5, rng.random() < 0.5) for i in range(300)]
    facts += [("none", 1, False, False), ("sec", 1, True, True), ("zero", 1, False, True)]
    found = [(r, rng.choice(cats), rng.choice(sevs)) for r, *_ in facts[:300] for _ in range(rng.randint(0, 30))]
    found += [("sec", "security", "high")] * 9 + [("zero", "testing", "critical")] * 4
    got = score_repos(
        spark.createDataFrame(found, "repo_id string, category string, severity string"),
        spark.createDataFrame(facts, "repo_id string, file_count long, has_tests boolean, has_docs boolean"),
    )
    got = {r.repo_id: {k.removesuffix("_score"): r[k] for k in r.asDict() if k != "repo_id"} for r in got.collect()}
    want = {r: score_in_python([(c, s) for x, c, s in found if x == r], n, t, d) for r, n, t, d in facts}
    assert got == want
    assert (got["none"]["testing"], got["none"]["documentation"], got["none"]["overall"]) == (40, 45, 86)
    assert (got["sec"]["security"], got["sec"]["overall"], got["zero"]["testing"]) == (0, 70, 40)


def finding(**kw):
    base = dict.fromkeys(FINDING_COLUMNS)
    return tuple({**base, "repo_id": "r", "title": "t", "file_path": "f", "category": "bug", "source_tool": "x", "seq_major": 1, "seq_minor": 0, **kw}.values())


FINDING_DDL = ", ".join(f"{c} {'int' if c in ('line_number', 'seq_major') else 'long' if c == 'seq_minor' else 'string'}" for c in FINDING_COLUMNS)


def test_first_finding_is_kept(spark):
    rows = [finding(severity="low", seq_major=8), finding(severity="high", seq_major=2), finding(severity="info", seq_major=2, seq_minor=5),
            finding(severity="low", line_number=0), finding(severity="low", category="security")]
    kept = dedup_findings(spark.createDataFrame(rows, FINDING_DDL)).collect()
    assert {(k.line_number, k.category, k.severity) for k in kept} == {(None, "bug", "high"), (0, "bug", "low"), (None, "security", "low")}


def test_group_limit_runs_before_the_shuffle(spark):
    plan = first_wins(spark.range(10).withColumn("k", F.col("id") % 2), ("k",), ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_diff(spark):
    ddl = FINDING_DDL
    old = spark.createDataFrame([finding(title="a"), finding(title="b"), finding(title="b", severity="x")], ddl)
    new = spark.createDataFrame([finding(title="b"), finding(title="c")], ddl)
    assert {(r.title, r.change) for r in diff_issues(old, new).collect()} == {("a", "resolved"), ("b", "persisting"), ("c", "new")}


def test_numbering_splits_a_group_that_holds_most_rows(spark, request):
    rng = random.Random(19)
    rows = [("hot" if i % 3 else f"g{i % 30}", i, rng.randint(0, 5)) for i in rng.sample(range(4000), 4000)]
    df = spark.createDataFrame(rows, "g string, i long, w long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # keep the small partitions apart
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    placed = ranged(df, ["g"], ["i"])
    assert placed.where("g = 'hot'").select("_pid").distinct().count() > 1
    by_group = {}
    for g, i, w in sorted(rows):
        by_group.setdefault(g, []).append((i, w))
    want_n, want_o, want_prev, want_next = {}, {}, {}, {}
    for g, items in by_group.items():
        total = 0
        for k, (i, w) in enumerate(items):
            want_n[i], want_o[i] = k + 1, total
            want_prev[i] = items[k - 1][1] if k else None
            want_next[i] = items[k + 1][1] if k + 1 < len(items) else None
            total += w
    assert {r.i: r.n for r in number_within(df, ["g"], ["i"], "n").collect()} == want_n
    assert {r.i: r.o for r in offsets_within(df, ["g"], ["i"], "w", "o").collect()} == want_o
    assert {r.i: r.p for r in neighbour_on(placed, ["g"], ["i"], "w", "p", -1).collect()} == want_prev
    assert {r.i: r.p for r in neighbour_on(placed, ["g"], ["i"], "w", "p", 1).collect()} == want_next


def test_nearest_chunks_do_not_depend_on_blocks(spark):
    rng = np.random.default_rng(23)
    vec = lambda: [float(x) for x in rng.integers(0, 4, 5)]
    chunks = [("hot" if i % 3 else f"r{i % 9}", f"c{i:04d}", f"f{i}.py", i, i + 1, "x" * 2000, vec()) for i in range(600)]
    questions = [(f"q{i}", "hot" if i % 2 else f"r{i % 9}", vec()) for i in range(40)] + [("lost", "nowhere", vec())]
    c = spark.createDataFrame(chunks, "repo_id string, chunk_id string, file_path string, start_line int, end_line int, content string, embedding array<float>")
    q = spark.createDataFrame(questions, "question_id string, repo_id string, embedding array<float>")
    want = set()
    for qid, repo, v in questions:
        near = sorted((np.linalg.norm(np.array(v) - np.array(x[6])), x[1]) for x in chunks if x[0] == repo)[:6]
        want |= {(qid, cid, rank) for rank, (_, cid) in enumerate(near, 1)}
    for sizes in ({}, {"block_rows": 30, "question_rows": 4}):
        assert {(r.question_id, r.chunk_id, r.rank) for r in retrieve_chunks(q, c, **sizes).collect()} == want
    context = {r.question_id: r for r in rag_context(q, c, content_chars=1500).collect()}
    assert context["lost"].context == NO_INDEX and context["lost"].referenced_files == ""
    assert context["q1"].context.startswith("### f") and context["q1"].context.count("x" * 1500) == 6 and "x" * 1501 not in context["q1"].context


def test_requirement_lines(make_files):
    text = "uvicorn[standard]==0.30\na>=1,<2\ngit+https://x\n@x\nb!=2\n\n# c\n-r d\nflask\x0bz==1\n"
    files = make_files(("r", "requirements.txt", text))
    got = {(r.name, r.version) for r in deps.dependencies(files).collect()}
    assert got == {("uvicorn", None), ("a", ">=1,<2"), ("git", None), ("@x", None), ("b", None), ("flask", None), ("z", "==1")}
    lines = {r.line_number for r in deps.requirement_rules(files).collect()}
    assert lines == {3, 4, 5}


def test_json_manifests(spark, make_files):
    big = json.dumps({"dependencies": {f"p{i}": "*" for i in range(500)}, "devDependencies": {"p0": "1", "q": None, "n": 3}})
    files = make_files(
        ("r", "a/package.json", big), ("r", "b/package.json", '{"a": 1} x'), ("r", "c/package.json", "[1]"), ("r", "d/package.json", ""),
        ("r", "e/package.json", '{"dependencies": {"x": "1"}}'), ("r", "e/yarn.lock", ""), ("r", "f/package.json", '{"dependencies": null}'),
        ("r", "vendor/package.json", "bad"), ("r", "g/composer.json", '{"require": {"a/b": "dev-main", "c": "1"}, "require-dev": {"a/b": "2"}}'),
    )
    found = deps.dependency_findings(files).collect()
    assert sum(r.rule_id == "RD2" for r in found) == 499
    assert {(r.rule_id, r.file_path) for r in found if r.rule_id != "RD2"} == {
        ("RD1", "b/package.json"), ("RD1", "d/package.json"), ("RD3", "a/package.json")}
    listed = {(r.name, r.version, r.scope) for r in deps.dependencies(files).where("manifest = 'a/package.json' and name in ('p0','q','n')").collect()}
    assert listed == {("p0", "*", "production"), ("p0", "1", "development"), ("q", None, "development"), ("n", "3", "development")}
    bad = spark.createDataFrame([("r", "package.json", 2, False, "{}", False)], FILES)
    assert [r.rule_id for r in deps.package_json_rules(bad).collect()] == ["RD1"]


def test_pom(make_files):
    files = make_files(("r", "a/pom.xml", "<p><v.version> latest </v.version><version>RELEASE</version><version>1</version></p>"),
                       ("r", "b/pom.xml", "<p>"), ("r", "c/pom.xml", "<p xmlns='u'><version/></p>"))
    assert sorted((r.rule_id, r.file_path) for r in deps.maven_rules(files).collect()) == [
        ("RD7", "b/pom.xml"), ("RD8", "a/pom.xml"), ("RD8", "a/pom.xml")]


def test_ruff_and_radon_oddities(spark):
    ruff = json.dumps([{"code": c, "message": "m", "filename": "./x.py"} for c in ("F401", "E711", "W291", None)])
    radon = json.dumps({"a.py": [{"name": "f", "lineno": 1, "complexity": 20}, {"name": "g", "complexity": 9}], "b.py": {"error": "x"}})
    reports = spark.createDataFrame([("r", "ruff", ruff), ("r", "radon", radon), ("r", "ruff", "oops")], TABLES["tool_reports"])
    assert [r.category for r in tr.ingest_ruff(reports).orderBy("seq_minor").collect()] == ["bug", "bug", "code_quality", "code_quality"]
    assert [(r.severity, r.title) for r in tr.ingest_radon(reports).collect()] == [("high", "High cyclomatic complexity in `f`")]


def test_gate(spark):
    rows = [("ok", "a.py", 5, False), ("link", "a", 1, True), ("link", "big.py", 10**9, False), ("hidden", "node_modules/a", 1, True),
            ("hidden", "x.png", 10**9, False), ("large", "a.py", 1024 * 1024 + 1, False), ("edge", "a.py", 1024 * 1024, False)]
    rows += [("many", f"f{i}.py", 1, False) for i in range(4)]
    files = spark.createDataFrame([(r, p, n, s, "", True) for r, p, n, s in rows], FILES)
    limits = {"max_file_kb": 1024, "max_files": 3}
    got = {r.repo_id: r.reject_reason for r in repo_gate(files, **limits).collect()}
    assert [k for k, x in got.items() if x is None] and {k for k, x in got.items() if x is None} == {"ok", "hidden", "edge"}
    assert (got["link"], got["large"], got["many"]) == ("symlink", "file too large", "too many files")
    result = analyze_corpus(files, limits=limits)
    assert {r.repo_id for r in result.rejects.collect()} == {"link", "large", "many"}
    assert {r.repo_id for r in result.scores.collect()} == {"ok", "hidden", "edge"}


def test_nothing_is_left_out_by_default(spark):
    secret = "token = 'abcdefgh1'\n"
    rows = [("big", f"src/f{i}.py", 1, False, "x = 1\n", True) for i in range(6000)]
    rows.append(("big", "src/large.py", 3_000_019, False, "#" * 3_000_000 + "\n" + secret, True))
    result = analyze_corpus(spark.createDataFrame(rows, FILES).repartition(8))
    assert result.rejects.count() == 0 and {r.reject_reason for r in result.gate.collect()} == {None}
    assert [(r.file_path, r.line_number) for r in result.findings.where("category = 'security'").collect()] == [("src/large.py", 2)]
    record = result.record.first()
    assert (record.repository_id, record.status, record.file_count, record.languages) == ("big", "complete", 6001, ["Python"])
    assert record.lines_of_code == 6002 and record.security_score == result.scores.first().security_score < 100


def test_updates_keep_earlier_fields(spark):
    issues = spark.createDataFrame([("a", "1", "open", "old", None), ("a", "2", "open", None, None)],
                                   "analysis_id string, id string, status string, suggested_fix string, generated_patch string")
    updates = spark.createDataFrame([("a", "1", "resolved", None, None, 1), ("a", "1", None, "new", "p", 2), ("a", "1", None, "newer", None, 3)],
                                    "analysis_id string, issue_id string, status string, suggested_fix string, generated_patch string, updated_at int")
    got = {r.id: (r.status, r.suggested_fix, r.generated_patch) for r in apply_issue_updates(issues, updates).collect()}
    assert got == {"1": ("resolved", "newer", "p"), "2": ("open", None, None)}


def test_one_question_id_in_two_repositories(spark):
    questions = spark.createDataFrame([("q", "a", [0.0, 0.0]), ("q", "b", [0.0, 1.0]), ("q2", "a", None)], "question_id string, repo_id string, embedding array<float>")
    chunks = spark.createDataFrame(
        [("a", 1, "fa.py", 1, 2, "xa", [0.0, 0.0]), ("b", 2, "fb.py", 1, 2, "xb", [0.0, 0.0]), ("a", 3, "n.py", 1, 2, "n", None), ("a", 4, "d.py", 1, 2, "d", [1.0])],
        "repo_id string, chunk_id int, file_path string, start_line int, end_line int, content string, embedding array<float>")
    got = {(r.question_id, r.repo_id): r.referenced_files for r in rag_context(questions, chunks).collect()}
    assert got == {("q", "a"): "fa.py:1-2", ("q", "b"): "fb.py:1-2", ("q2", "a"): ""}
    assert without_vector(chunks).count() == 1 and without_vector(questions).count() == 1


def test_nearest_matches_differences():
    rng = np.random.default_rng(1)
    chunks = np.repeat(rng.normal(size=(400, 8)), 2, axis=0) + 1000
    questions = np.concatenate([rng.normal(size=(300, 8)) + 1000, chunks[:40]])
    at, distance = nearest(chunks, questions, 5)
    plain = np.sqrt(((questions[:, None, :] - chunks[None]) ** 2).sum(axis=2))
    assert (at == np.argsort(plain, axis=1, kind="stable")[:, :5]).all()
    assert np.allclose(distance, np.sort(plain, axis=1)[:, :5])


def test_caps_and_facts(make_files):
    rows = [("hot", f"s/f{i:03d}.py", "") for i in range(150)] + [("b", "x.py", "a\nb"), ("b", "README.md", ""), ("b", "tests/a.py", ""), ("c", "src/latest_x.go", "")]
    files = make_files(*rows)
    assert {r.path for r in cap_language_files(files, 20).where("repo_id = 'hot'").collect()} == {f"s/f{i:03d}.py" for i in range(20)}
    assert cap_language_files(files, 20).where("repo_id = 'b'").count() == 2
    assert [r.position for r in first_paths(files, 3).where("repo_id = 'hot'").orderBy("path").collect()] == [1, 2, 3]
    facts = {r.repo_id: (r.file_count, r.has_tests, r.has_docs) for r in repo_facts(files).collect()}
    assert facts == {"hot": (150, False, False), "b": (2, False, True), "c": (1, True, False)}
    stats = {r.repo_id: r.lines_of_code for r in repo_stats(files).collect()}
    assert stats == {"hot": 0, "b": 2, "c": 0}


def test_patch_reasons(spark):
    rows = [("a.py", "```x```"), ("a.py", "  "), ("a.py", " VALIDATION_REQUIRED "), ("a.py", "ok\n  However x"), ("a.php", "echo 1"), ("a.php", "<?php filter_sanitize_string"),
            ("a.HTML", "<html>"), ("a.htm", "<html></HTML>"), ("a.py", "x = explanation"), ("a.py", None),
            ("a.py", "x\rHowever"), ("a.py", "s = 'a\u0085Explanation'"), ("a.py", "s = 'a\u2028Explanation'")]
    df = spark.createDataFrame(rows, "p string, t string")
    assert [r[0] for r in df.select(commit_reject_reason("p", "t")).collect()] == [
        "contains code fences", "empty", "needs manual validation", "contains explanatory text", "no PHP opening tag", "deprecated filter",
        "incomplete HTML", None, None, "empty", None, None, None]


def test_response_sections(spark):
    df = spark.createDataFrame([("x\n## improved_code:\r\na\n\nb\n** EXPLANATION **\ne\nIMPROVED_CODE\nc",)], "raw_response string")
    r = parse_fix_sections(df).first()
    assert (r.improved_code, r.explanation, r.side_effects, r.valid) == ("a\n\nb\nc\n", "e\n", "", True)


def test_python_facts():
    src = ("@app.Route('/a', methods=['get', X, 'post'])\n@app.get(P)\n@get('/n')\n@x.y.head('/h')\nasync def f(): pass\n"
           "os.environ.get('A', 1)\ngetenv('B')\nenviron.get('C')\no.getenv('D', None)\nos.environ['E']\nx = os.getenv('F', 'q'); y = os.getenv('F')\n")
    got = source_facts(src)
    assert [(g[1], g[2], g[4]) for g in got if g[0] == "route"] == [("/a", 5, ["GET", "POST"]), ("/h", 5, ["HEAD"])]
    assert sorted((g[1], g[2], g[5]) for g in got if g[0] == "env") == [("A", 6, "1"), ("D", 9, None), ("F", 11, "'q'")]
    assert source_facts("def (") == [] and source_facts("\x00") == []


def test_scan_and_write(spark, tmp_path):
    root = tmp_path / "repos"
    inner = f"src/vendor{root}/a.py"  # the root's own text again, inside a path
    for path, data in {inner: b"y", "r1/src/a.py": b"token = 'abcdefgh1'\n\xff", "r1/README.md": b"x", "r2/b.js": b"eval(x)"}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(data)
    files = scan_files(spark, str(root))
    assert {(r.repo_id, r.path, r.size_bytes, r.utf8_valid) for r in files.collect()} == {
        ("r1", "src/a.py", 21, False), ("r1", "README.md", 1, True), ("r2", "b.js", 7, True), ("src", inner[4:], 1, True)}
    links = spark.createDataFrame([("r2", "b.js")], "repo_id string, path string")
    assert [r.path for r in scan_files(spark, "file:" + str(root), links=links).where("is_symlink").collect()] == ["b.js"]
    result = analyze_corpus(files)
    out = str(tmp_path / "issues")
    write_issues(result.findings, out)
    write_issues(result.findings, out)
    issues = read_table(spark, "issues", out)
    first = issues.orderBy("analysis_id", "created_at", "seq_major", "seq_minor").select("title").collect()
    assert first[: len(first) // 2]
    assert issues.count() == 2 * result.findings.count() == 2 * issues.select("id").distinct().count() > 0

    index = str(tmp_path / "index")
    write_chunk_index(build_chunk_index(files), index)
    (root / "r1/src/a.py").unlink()
    spark.catalog.clearCache()
    write_chunk_index(build_chunk_index(scan_files(spark, str(root)).where("repo_id = 'r2'")), index)
    assert {(r.repo_id, r.chunk_id) for r in spark.read.parquet(index).collect()} == {("r1", "src/a.py:1-1:0"), ("r2", "b.js:1-1:0")}


def test_exports(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [(f"i{k}", "a1", "t", "high", "bug", "f.py", k, None, 'say "x", y\nz' if k else None, None, None, None, None, "open", t, 0, k) for k in (1, 0)]
    issues = spark.createDataFrame(rows, ISSUES)
    repos = spark.createDataFrame([("p", "o", "n", "o/n", "u", False, "main", t)], TABLES["repositories"])
    analysis = dict.fromkeys([f.split()[0] for f in TABLES["analyses"].split(", ")])
    analyses = spark.createDataFrame(
        [tuple({**analysis, "id": i, "repository_id": "p", "branch": "b", "status": "complete"}.values()) for i in ("a1", "a2")], TABLES["analyses"])
    write_issues_csv(issues, str(tmp_path / "csv"), folders=True)
    [part] = (tmp_path / "csv" / "analysis_id=a1").glob("*.csv")
    assert part.read_bytes().startswith(b"\xef\xbb\xbf")
    cells = list(csv.reader(open(part, encoding="utf-8-sig", newline="")))
    assert cells[0][:2] == ["title", "severity"] and [c[4] for c in cells[1:]] == ["", "1"] and cells[2][8] == 'say "x", y\nz'
    parts = report_markdown(analyses, repos, issues)
    texts = {(r.analysis_id, r.part): r.text for r in parts.collect()}
    assert "- **Languages:** Unknown" in texts["a1", 0] and "| Overall | 0 |" in texts["a1", 0] and texts["a2", 0].endswith("No issues were detected.")
    assert "- **Location:** `f.py`" in texts["a1", 1] and "`f.py:1`" in texts["a1", 2]
    write_reports(parts, str(tmp_path / "md"), folders=True)
    written = "\n".join(p.read_text() for p in sorted((tmp_path / "md" / "analysis_id=a1").glob("*.txt")))
    assert written.index("# Corpus Report") < written.index("### 1.") < written.index("### 2.")
    heads = {(r.analysis_id, r.part): json.loads(r.text) for r in report_json(analyses, repos, issues).collect()}
    assert heads["a1", 0]["scores"]["overall"] is None and heads["a1", 1]["risk"] is None and "generated_patch" not in heads["a1", 1]
    lines = json_document(report_json(analyses, repos, issues)).orderBy("analysis_id", "part").collect()
    for analysis_id, n in (("a1", 2), ("a2", 0)):
        document = json.loads("\n".join(r.text for r in lines if r.analysis_id == analysis_id))
        assert len(document["issues"]) == n and document["repository"]["name"] == "n"
    write_reports(parts, str(tmp_path / "parts"))
    stored = spark.read.parquet(str(tmp_path / "parts")).orderBy("analysis_id", "part").collect()
    assert [r.text for r in stored] == [r.text for r in parts.orderBy("analysis_id", "part").collect()]
    write_issues_csv(issues, str(tmp_path / "table"))
    assert spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(str(tmp_path / "table")).count() == 2


def test_scan_to_report(spark, make_files):
    """From files to a stored analysis and its report."""
    files = make_files(("o/n", "src/a.py", "password = 'hunter22'\n"), ("o/n", "README.md", "x"))
    result = analyze_corpus(files)
    t = datetime(2024, 1, 1)
    repos = spark.createDataFrame([("o/n", "o", "n", "o/n", "u", False, "main", t)], TABLES["repositories"])
    missing = {c.split()[0]: c.split()[1] for c in TABLES["analyses"].split(", ") if c.split()[0] not in result.record.columns}
    analyses = result.record.withColumns({c: F.lit(None).cast(k) for c, k in missing.items()}).withColumn("id", F.col("repository_id"))
    issues = result.findings.withColumns({"analysis_id": F.col("repo_id"), "id": F.col("title"), "status": F.lit("open"), "created_at": F.lit(t)})
    text = "\n".join(r.text for r in report_markdown(analyses, repos, issues).orderBy("part").collect() if r.text)
    assert "- **Files scanned:** 1" in text and "- **Languages:** Python" in text and f"- **Total findings:** {issues.count()}" in text
    order = [r.title for r in result.findings.orderBy("seq_major", "seq_minor").collect()]
    assert [text.index(f". {x}\n") for x in order] == sorted(text.index(f". {x}\n") for x in order)


def test_versions_are_shown_as_the_manifest_has_them(spark):
    """Numbers, booleans, lists and maps as the words of Python's own printing; NaN and the infinities are values."""
    body = (
        '{"dependencies": {"a": 1.0, "b": true, "c": null, "d": 1, "e": "x", "f": 1e3, "g": NaN, "h": -Infinity, "i": {"z": 1.5, "k": [true, null, '
        '"it\'s \\"q\\" NaN"]}, "j": 12345678901234567890, "k": 1.10, "l": 1e22, "m": 0.00001, "n": "true", "o": "NaN", "p": false, "q": 123456789.25, '
        '"r": [], "s": 1E5, "t": -2.50, "u": "*", "v": Infinity}, "devDependencies": {"a": 2, "z": 3.0}}'
    )
    texts = {
        "r": ("package.json", body), "bad": ("package.json", '{"dependencies": {"a": nan}}'), "two": ("package.json", '{"dependencies": {"a": 1}} {}'),
        "php": ("composer.json", '{"require": {"a": Infinity, "b": "*", "c": 1.0}}'), "twice": ("package.json", '{"devDependencies": {"q": "1", "q": 2.0}}'),
        "list": ("package.json", '{"dependencies": ["a"], "devDependencies": 5}'), "text": ("package.json", '{"name": "NaN , Infinity", "dependencies": {"a": "NaN"}}'),
    }
    files = spark.createDataFrame([(repo, name, len(t), False, t, True) for repo, (name, t) in texts.items()], FILES)
    got = {(r.repo_id, r.scope, r.name): r.version for r in dependencies(files).collect()}
    want = {}
    for repo, (name, text) in texts.items():
        try:
            loaded = json.loads(text)
        except ValueError:
            continue
        keys = ("require", "require-dev") if name == "composer.json" else ("dependencies", "devDependencies")
        for scope, key in zip(("production", "development"), keys):
            members = loaded.get(key)
            for k, value in members.items() if isinstance(members, dict) else ():
                want[repo, scope, k] = None if value is None else str(value)
    assert got == want
    found = {(r.repo_id, r.rule_id) for r in dependency_findings(files).collect()}
    assert found == {("bad", "RD1"), ("two", "RD1"), ("r", "RD2"), ("r", "RD3"), ("php", "RD6"), ("twice", "RD3"), ("text", "RD3")}


def test_a_request_keeps_the_branch_of_the_one_before(spark):
    known = spark.createDataFrame([("k", "o", "old", "o/old", "https://github.com/o/old", False, "dev", None)], TABLES["repositories"])
    asked = [("1", ""), ("2", "rel"), ("3", ""), ("4", None), ("5", "next"), ("6", "")]
    rows = [(i, "me", "https://github.com/o/new", False, b) for i, b in asked] + [("7", "o", "https://github.com/o/old", False, ""), ("8", "o", "https://github.com/o/old", True, "x"), ("9", "o", "https://github.com/o/old", True, "")]
    got = {r.request_id: (r.action, r.default_branch) for r in upsert_repositories(known, spark.createDataFrame(rows, "request_id string, owner_id string, clone_url string, is_private boolean, default_branch string")).collect()}
    assert [got[str(i)] for i in range(1, 7)] == [("insert", "main"), ("update", "rel"), ("update", "rel"), ("update", "rel"), ("update", "next"), ("update", "next")]
    assert [got[str(i)][1] for i in range(7, 10)] == ["dev", "x", "x"]


def test_numbering_exchanges_rows_once_and_broadcasts_by_tasks(spark):
    """Many groups, more than may be broadcast: no second exchange of the rows, and rows without a group are left out."""
    df = spark.range(300_000).select(F.when(F.col("id") % 1000 != 7, F.concat(F.lit("g"), F.col("id") % 250_000)).alias("g"), "id", (F.col("id") % 3).alias("w"))
    numbered = number_within(df, ["g"], ["id"], "n")
    assert "SortMergeJoin" not in numbered._jdf.queryExecution().toString()
    got = numbered.join(offsets_within(df.withColumn("w", F.when(F.col("w") > 0, F.col("w"))), ["g"], ["id"], "w", "o").select("id", "o"), "id")
    first = got.where("id < 250000").agg(F.count("*"), F.max("n"), F.max("o")).first()
    again = got.where("id >= 250000").agg(F.count("*"), F.min("n"), F.max("n")).first()
    assert tuple(first) == (249_750, 1, 0) and tuple(again) == (49_950, 2, 2)
    assert got.where("id >= 250000 AND o <> (id - 250000) % 3").isEmpty()
