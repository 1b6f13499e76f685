import random
import re

from corpuslens import catalogue as cat
from corpuslens.operators.rules import file_findings, match_rules, nested_loops, scan_findings

EXT = {v: k for k, v in reversed(cat.EXTENSION_LANGUAGE.items())}


# rule -> (lines that fire, lines that do not)
GOLDEN = {
    "RM1": (["# todo", "x FIXME:", "TODO-1"], ["todos", "éTODO", "prefixme", "TODO_1"]),
    "RM2": (["password = 'abcdef'", 'my_API-KEY:"123456"'], ["password = 'abc'", "password = abcdefgh", "passwd='abcdefgh'"]),
    "RS1": (["token='abcd1234'", "PASSWD = \"a/b+c=-_9\"", "my_secret: 'abcdefgh'"], ["token='abc d1234'", "token='abc'", "token = x"]),
    "RS2": (["-----BEGIN RSA PRIVATE KEY-----"], ["-----BEGIN PRIVATE KEY-----", "-----BEGIN DSA PRIVATE KEY-----"]),
    "RS3": (["cur.execute('a %s b' % x)", "QUERY(f'{x} SELECT')"], ["cur.execute('a %s', x)", "query('{x} select')"]),
    "RS4": (["eval(x)", "a.eval  (x)", "eval\u00a0(x)"], ["myeval(x)", "evaluate(x)", "éeval(x)"]),
    "RS5": (["os.system('a' + b)", "SUBPROCESS.popen(x + y)"], ["os.system(a)", "subprocess.run(a) + b", "subprocess.check_output(a+b)"]),
    "RS6": (["Access-Control-Allow-Origin: '*'", "access-control-allow-origin' = \"*\""], ["Access-Control-Allow-Origin: *"]),
    "RP1": (["$_GET['a']", "$_GET  ["], ["$_get['a']", "$_GET()"]),
    "RP2": (["$_POST["], ["$_POSTS["]),
    "RP3": (["$_REQUEST ['x']"], ["REQUEST['x']"]),
    "RP4": (["mysql_query ($q)"], ["my_mysql_query($q)", "mysql_query"]),
    "RP5": (["eval($x)"], ["EVAL($x)"]),
    "RP6": (["exec('x')", "passthru (1)", "shell_exec(1)"], ["curl_exec(1)", "execute(1)"]),
    "RP7": (["echo $_GET['x']"], ["echo$_GET['x']", "print $_GET['x']"]),
    "RP8": (["select a . $_GET", "SELECT x.$_POST"], ["SELECT.$_x", "select a , $_GET"]),
    "RH1": (["<IMG src=x>"], ["<img ALT=''>", "<p>"]),
    "RH2": (["<a onclick = x>", "<a ONLOAD=x>"], ["<a data-on=x>", "onclick=x", "<a on=1>"]),
    "RH3": (['<a TARGET="_blank">'], ["<a target='_blank'>", '<a target="_blank" rel="noopener">']),
    "RH4": (["<input>"], ["<input type=a>", "<inpt>"]),
    "RH5": (["<script src=a>"], ["<script defer src=a>", "<script>", "<script ASYNC src=a>"]),
}


def test_golden_lines(make_files):
    """One job over one file per rule: exactly the firing lines fire."""
    rows, want = [], {}
    for rule in cat.RULES:
        if rule.rule_id in GOLDEN:
            fires, quiet = GOLDEN[rule.rule_id]
            ext = {"php": ".php", "html": ".html"}.get(rule.family, ".py")
            rows.append(("r", f"{rule.rule_id}{ext}", "\n".join(fires + quiet)))
            want[rule.rule_id] = list(range(1, len(fires) + 1))
    got = {}
    for f in match_rules(make_files(*rows)).collect():
        if f.file_path.startswith(f"{f.rule_id}."):
            got.setdefault(f.rule_id, []).append(f.line_number)
    assert {k: sorted(x) for k, x in got.items()} == want


def test_every_language_rule_fires_in_its_language_only(make_files):
    text = [r for r in cat.RULES if r.family == "language"]
    assert len(text) == 30
    rows = [("r", f"f{i}{EXT[r.language]}", f"\nx {r.pattern} y".replace("x  as!", "x as!")) for i, r in enumerate(text)]
    rows.append(("r", "other.sql", "\n".join(r.pattern for r in text)))
    found = match_rules(make_files(*rows), ("language",)).collect()
    assert {r.rule_id for r in found} == {r.rule_id for r in text}
    assert all(f.file_path != "other.sql" for f in found)
    assert {f.source_tool for f in found} >= {"scan-c#-checks", "scan-react-typescript-checks", "scan-c++-checks"}


def test_directories_and_names_decide_who_reads_a_file(make_files):
    secret = "token = 'abcdefgh1'\n# TODO"
    files = make_files(
        ("r", ".github/a.py", secret), ("r", "bin/a.py", secret), ("r", "node_modules/a.py", secret), ("r", "x/.env", secret),
        ("r", "x/prod.env", secret), ("r", "a.md", secret), ("r", "build.py", secret), ("r", "h.hpp", secret),
    )
    got = {(r.file_path, r.rule_id) for r in match_rules(files).collect()}
    assert got == {(".github/a.py", "RS1"), ("bin/a.py", "RS1"), ("x/.env", "RS1"), ("x/prod.env", "RS1"),
                   ("build.py", "RS1"), ("build.py", "RM1"), ("h.hpp", "RM1")}


def test_size_cap_of_the_security_scan(spark):
    from corpuslens.schemas import FILES

    rows = [("r", f"{n}.py", n, False, "eval(x)", True) for n in (2_000_000, 2_000_001)]
    files = spark.createDataFrame(rows, FILES)
    found = match_rules(files, ("security",), security_max_bytes=cat.SECURITY_MAX_BYTES).collect()
    assert [f.file_path for f in found] == ["2000000.py"]
    assert match_rules(files, ("security",)).count() == 2  # no cut unless asked for


def python_patterns():
    """The catalogue's patterns as Python expressions: the flag group is dialect, the rest is shared."""
    for r in cat.RULES:
        if r.kind == "regex":
            flags = re.match(r"\(\?([a-zA-Z]+)\)", r.pattern)
            body = r.pattern[flags.end():] if flags else r.pattern
            yield r, re.compile(body, re.IGNORECASE if flags and "i" in flags[1] else 0)


def test_patterns_agree_with_python_on_random_lines(make_files):
    rng = random.Random(5)
    words = ["todo", "FIXME", "fıxme", "é", " ", "=", ":", "'", '"', "abcdefgh1", "password", "api_key", "ſecret", "TOKEN", "eval", "(", ")",
             "%s", "%", "query", "f'", "{x}", "select", "$_GET", "[", "echo", "exec", ".", "os.system", "+", "\u00a0", "_", "*", "\u2028",
             "mysql_query", "Access-Control-Allow-Origin", "SELECT ", "$_", "-----BEGIN EC PRIVATE KEY-----"]
    lines = ["".join(rng.choices(words, k=rng.randint(1, 9))) for _ in range(3000)]
    found = match_rules(make_files(("r", "a.php", "\n".join(lines))), ("common", "security", "php"))
    got = {(r.rule_id, r.line_number) for r in found.collect()}
    want = {(r.rule_id, i) for r, p in python_patterns() for i, line in enumerate(lines, 1) if p.search(line)}
    assert got == want
    assert {rule for rule, _ in want} >= {"RM1", "RM2", "RS2", "RS4", "RP1", "RP5", "RP6"}


def count_nested(language, text):
    depths = [len(x) - len(x.lstrip()) for x in text.split("\n") if any(t in x.strip() for t in cat.LOOP_TOKENS[language])]
    return sum(b > a for a, b in zip(depths, depths[1:]))


def test_nested_loops_agree_on_random_files(make_files):
    rng = random.Random(7)
    rows, want = [], {}
    for i in range(200):
        language = rng.choice(list(cat.LOOP_TOKENS))
        tokens = [*cat.LOOP_TOKENS[language], "for", "x", "while"]
        text = "\n".join(rng.choice(["", " ", "  ", "\t", "\u00a0"]) * rng.randint(0, 3) + rng.choice(tokens) + rng.choice(["", "a", " b"])
                         for _ in range(rng.randint(0, 15)))
        path = f"f{i}{EXT[language]}"
        rows.append(("r", path, text))
        if n := count_nested(language, text):
            want[path] = n
    files = make_files(*rows)
    assert {r.path: r.nested_count for r in nested_loops(files).collect()} == want
    flagged = {r.file_path for r in file_findings(files).where("rule_id = 'RF2'").collect()}
    assert flagged == set(want)


def test_loop_indents_golden(make_files):
    text = "for a in b:\n    for c in d:\nfor e in f:\n    for g in h:\n        for i in j:"
    assert [r.nested_count for r in nested_loops(make_files(("r", "a.py", text))).collect()] == [3]


def test_file_rules_and_one_pass_scan(make_files):
    files = make_files(
        ("r", "a.py", "x\n" * 601), ("r", "b.py", "x\n" * 600), ("r", "c.php", "x\n" * 601), ("r", "d.css", "x\n" * 801),
        ("r", "e.less", "x\n" * 800), ("r", "f.html", "\n\n<HTML>"), ("r", "g.html", "<html LANG=\"x\">"), ("r", "h.py", ""),
    )
    alone = {(r.rule_id, r.file_path, r.line_number, r.language) for r in file_findings(files).collect()}
    assert alone == {
        ("RF1", "a.py", None, "Python"), ("RF1", "c.php", None, "PHP"), ("RP9", "c.php", None, "PHP"), ("RF1", "d.css", None, "CSS"),
        ("RF1", "e.less", None, "Less"), ("RC4", "d.css", None, "CSS"), ("RH6", "f.html", 1, "HTML"),
    }
    both = scan_findings(files)
    assert {(r.rule_id, r.file_path, r.line_number, r.language) for r in both.collect()} == alone


def test_catalogue_counts():
    families = [r.family for r in cat.RULES]
    assert {f: families.count(f) for f in set(families)} == {"common": 2, "language": 30, "security": 6, "php": 8, "html": 5}
    assert len(set(cat.EXTENSION_LANGUAGE.values())) == 25 and len(cat.EXTENSION_LANGUAGE) == 32
    assert len(cat.IGNORED_EXTENSIONS) == 54 and len(cat.MANIFESTS) == 24
    assert [len(cat.IGNORED_DIRS[k]) for k in ("clone", "language", "security", "tree")] == [25, 21, 10, 19]
