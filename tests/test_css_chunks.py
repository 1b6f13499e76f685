import random
import re

from corpuslens.operators.chunks import build_chunk_index, chunk_files
from corpuslens.operators.css import css_checks, strip_block_comments

NAME = re.compile(r"--[a-zA-Z0-9_-]+|[a-zA-Z-]+")


def without_comments(text):
    """Comments blanked by position: newlines stay, all else between the marks goes."""
    out, i = [], 0
    while i < len(text):
        if text.startswith("/*", i):
            end = text.find("*/", i + 2)
            end = len(text) if end < 0 else end + 2
            out.append("\n" * text.count("\n", i, end))
            i = end
        else:
            out.append(text[i])
            i += 1
    return "".join(out)


def model(text):
    """Findings of one stylesheet, tracked with an explicit depth and the set of names seen since the last brace."""
    found, depth, seen = set(), 0, set()
    for no, raw in enumerate(without_comments(text).split("\n"), 1):
        line = raw.strip()
        if not line:
            continue
        if "!important" in line:
            found.add(("RC1", no))
        ups, downs = line.count("{"), line.count("}")
        seen = set() if ups else seen
        head, colon, tail = line.partition(":")
        plain = colon and line[0] != "@" and not line.startswith(("http://", "https://")) and line[-1] != "{"
        if (depth or ups) and plain and NAME.fullmatch(head.strip()):
            name = head.strip().lower()
            if name in seen:
                found.add(("RC2", no))
            seen.add(name)
            closed = line[-1] in ";{},:)\\" or line.startswith(("*", "//"))
            if not closed and tail.strip() and line.count("(") == line.count(")"):
                found.add(("RC3", no))
        depth = max(0, depth + ups - downs)
        seen = set() if downs else seen
    return found


def test_css_agrees_on_random_stylesheets(make_files):
    rng = random.Random(11)
    parts = ["a {", "}", "{", "color: red", "color: red;", "COLOR:blue;", "--v: 1", "--v:", "/*", "*/", "x /* y */ top: 1;", "}}", "@media x {",
             "!important", "b: c !important;", "url(x", "y: f(1)", "http://z: 1", "* zoom: 1", ".a:hover {", "m: 1,", "m: 1}", "k: v\\", "", "  ", "/*/"]
    rows, want = [], {}
    for i in range(250):
        text = "\n".join(" " * rng.randint(0, 2) + rng.choice(parts) for _ in range(rng.randint(0, 25)))
        rows.append(("r", f"f{i}.{rng.choice(['css', 'scss', 'sass', 'less'])}", text))
        want |= {(rows[-1][1], *hit): 1 for hit in model(text)}
    got = {(r.file_path, r.rule_id, r.line_number) for r in css_checks(make_files(*rows)).collect()}
    assert got == set(want)
    assert {k[1] for k in want} == {"RC1", "RC2", "RC3"}


def test_css_golden(make_files):
    hits = css_checks(make_files(("r", "a.css", "a{\ncolor:red;\ncolor:blue;\n}\n}\nb {\nx: y\n}"))).collect()
    assert {(h.rule_id, h.line_number, h.language) for h in hits} == {("RC2", 3, "CSS"), ("RC3", 7, "CSS")}


def test_comment_removal(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("/* x\r\ny */ color: red;",), ("a/b /*/ c */ d",), ("/* open\n",)], "c string")
    assert [r[0] for r in df.select(strip_block_comments(F.col("c"))).collect()] == ["\n color: red;", "a/b  d", "\n"]


# The four boundary patterns.
EDGE = [
    re.compile(r"^\s*(def|class)\s+\w+"), re.compile(r"^\s*(export\s+)?(async\s+)?function\s+\w+"),
    re.compile(r"^\s*(export\s+)?(default\s+)?class\s+\w+"),
    re.compile(r"^\s*(public|private|protected)?\s*\w[\w<>\[\]]*\s+\w+\s*\("),
]


def chunks_of(text):
    lines = text.split("\n")[: -1 if text.endswith("\n") else None] if text else []
    starts = [i for i, x in enumerate(lines) if any(p.match(x) for p in EDGE)] or list(range(0, len(lines), 60))
    for a, b in zip(starts, [*starts[1:], len(lines)]):
        body = "\n".join(lines[a:b]).strip()
        if body:
            yield a + 1, b, body


def test_chunks_agree_on_random_files(make_files):
    rng = random.Random(13)
    parts = ["def f(a):", "  class B", "export async function é(", "export default class Q {", "public int go (", "return foo(", "else if (x)",
             "x = 1", "", "   ", "\x01", "List<int> f(", "def", "classy x", "\tprivate void a("]
    rows, want = [], {}
    for i in range(150):
        pool = parts if i % 3 else ["x = 1", "", "y"]
        text = "\n".join(rng.choice(pool) for _ in range(rng.choice([0, 1, 5, 40, 130])))
        rows.append((f"r{i % 3}", f"f{i:03d}.py", text))
        want[rows[-1][1]] = list(chunks_of(text))
    files = make_files(*rows)
    got = {}
    for r in chunk_files(files).orderBy("file_path", "start_line").collect():
        got.setdefault(r.file_path, []).append((r.start_line, r.end_line, r.content))
    assert got == {k: v for k, v in want.items() if v}

    for repo in ("r0", "r1", "r2"):
        ids = [r.chunk_id for r in build_chunk_index(files).where(f"repo_id = '{repo}'").orderBy("file_path", "start_line").collect()]
        paths = [(p, c) for r, p, _ in sorted(rows, key=lambda x: x[1]) if r == repo for c in want[p]]
        assert ids == [f"{p}:{a}-{b}:{n}" for n, (p, (a, b, _)) in enumerate(paths)]


def test_chunk_golden(make_files):
    files = make_files(("r", "a.py", "import x\n\n# y\n\ndef f():\n  1\n  2\n  3\n"), ("r", "b.py", "a\n" * 130))
    got = {(r.file_path, r.start_line, r.end_line) for r in chunk_files(files).collect()}
    assert got == {("a.py", 5, 8), ("b.py", 1, 60), ("b.py", 61, 120), ("b.py", 121, 130)}


def test_stylesheet_tasks_grow_with_the_bytes(spark):
    from corpuslens.operators import css
    from corpuslens.schemas import FILES

    rows = [("r", f"{i}.css", 1 << 20, False, "a{\ncolor:red;\ncolor:blue;\n}\n", True) for i in range(400)]
    files = spark.createDataFrame(rows, FILES)
    assert css.tasks_for(files) == 50 and css.tasks_for(files.limit(1)) < 50
    found = css.css_checks(files)
    assert found.rdd.getNumPartitions() == 50
    assert found.count() == 400
