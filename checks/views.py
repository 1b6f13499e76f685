"""Input views over the given tables, written once in SQL that Spark and DuckDB both read.

Every view covers its whole table and the whole text of each row. ``$name$`` stands for a table and
``OCTETS(`` for the byte-length function, the only two things the engines spell differently.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession



# Stand-ins inside literals for line feed, carriage return and backslash, which the engines escape differently.
_STAND_INS = (("\n", "¶", 10), ("\r", "¬", 13), ("\\", "⧵", 92))


def _lit(text: str) -> str:
    for char, mark, _ in _STAND_INS:
        text = text.replace(char, mark)
    return "'" + text.replace("'", "''") + "'"


def _values(rows: list[tuple[str, ...]], *names: str) -> str:
    """A literal table (k, names...) with the stand-ins undone."""
    body = ", ".join(f"({i}, {', '.join(_lit(c) for c in row)})" for i, row in enumerate(rows))
    cols = []
    for name in names:
        expr = name
        for _, mark, code in _STAND_INS:
            expr = f"replace({expr}, '{mark}', chr({code}))"
        cols.append(f"{expr} AS {name}")
    return f"(SELECT k, {', '.join(cols)} FROM (VALUES {body}) AS t(k, {', '.join(names)}))"


# (file name, snippet): for every rule a line that fires, a near miss, and the traps.
SNIPPETS: list[tuple[str, str]] = [
    ("main.py", "import os\nfor a in b:\n    for c in d:\n        while e:\n            pass\nfor x in y:\n  pass\n# TODO later\n"),
    ("app.py", "password = 'short'\npassword = \"longenough\"\nAPI_KEY: 'abcdefghijkl'\nevaluate(x)\neval (x)\nmyeval(x)\n"),
    ("manage.py", "def f(a):\n    return 1\n\nclass B:\n    def g(self):\n        pass\n"),
    ("test_x.py", "os.system(\"ls \" + x)\nsubprocess.run(a, b + c)\nsubprocess.run(a)\n-----BEGIN RSA PRIVATE KEY-----\n-----BEGIN DSA PRIVATE KEY-----\n"),
    ("latest.py", "cur.execute(\"select %s\" % x)\ncur.execute(\"select %s\", x)\ndb.query(f\"x {y} from select\")\nquery(f'{a}') insert\n"),
    ("cfg.py", "token = \"abcd1234\"\ntoken = \"abc d1234\"\nAccess-Control-Allow-Origin: '*'\nAccess-Control-Allow-Origin = \"x\"\nFIXME\nfixmes\n"),
    ("a.js", "eval(x);\nel.innerHTML = y;\nconsole.log(1);\ndocument.querySelector('a');\nfor (i) {\n  for(j) {\n    while (k) {}\n  }\n}\n"),
    ("b.mjs", "console.Log(1)\nevaluated\nexport async function go(a) {\n  return 1\n}\nexport default class Q {\n}\n"),
    ("c.jsx", "<div dangerouslySetInnerHTML={x} />\nconsole.log(2)\nxs.map(x =>\n  ys.map(y =>\n    y))\n"),
    ("x.test.ts", "let a: any = 1;\nlet b: Any;\neval('x')\nfor (const a of b) {\n\tfor (;;) {}\n}\n"),
    ("d.tsx", "const a: any = <p dangerouslySetInnerHTML={h}/>;\r\nfunction go(a) {\r\n  return a\r\n}\r\n"),
    ("Main.java", "public class Main {\n  public void run(int a) {\n    System.out.println(1);\n    Runtime.getRuntime().exec(x);\n    new Random();\n    for (;;) {\n      while (x) { }\n    }\n  }\n}\n"),
    ("e.c", "fgets(buf, n, f);\nstrcpy(a, b);\nvsprintf(a, b);\nsnprintf(a, 3, b);\nstrncpy(a, b, 3);\n"),
    ("f.cpp", "int* p = new int;\nrenew x\nstrcpy(a,b);\nint main(int a) {\n  for (;;) {\n    for(;;) {}\n  }\n}\n"),
    ("g.h", "int strcpy(char* a);\n"),
    ("h.cs", "Console.WriteLine(1);\nProcess.Start(x);\nforeach (var a in b) {\n  foreach (var c in d) {}\n}\n"),
    ("main.go", "exec.Command(\"ls\")\nfmt.Println(1)\nfor i := range x {\n\tfor j := range y {\n\t}\n}\n"),
    ("k.rs", "x.unwrap();\nx.unwrap_or(1);\nunsafe {\n}\nfor a in b {\n    while c {\n    }\n}\n"),
    ("l.kt", "a!!.b\nprintln(1)\nfor (a in b) {\n  while (c) {}\n}\n"),
    ("m.swift", "try! go()\nx as! Y\nx as? Y\nfor a in b {\n  for c in d {}\n}\n"),
    ("n.rb", "eval(x)\nsystem('ls')\nxs.each do |x|\n  while y\n  end\nend\n"),
    ("o.php", "<?php\n$a = $_GET['x'];\n$b = $_POST ['y'];\n$c = $_REQUEST[0];\nmysql_query('x');\neval($x);\nshell_exec('ls');\nfile_exec('x');\necho $_GET['x'];\n$q = 'SELECT a ' . $_GET['x'];\n"),
    ("p.php", "$_GETX['a']\nmy_mysql_query(1)\necho  $_POST['z'];\npassthru ('x');\nselect 1 .$_REQUEST\n"),
    ("q.sh", "password='secretsecret'\n"),
    ("r.sql", "-- todo\nselect 1\n"),
    ("s.vue", "// FIXME: x\n"),
    ("t.svelte", "no marker here\n"),
    (".env", "TOKEN='abcdefgh12'\n"),
    ("u.json", "{\"api_key\": \"abcdefgh\"}\n"),
    ("v.png", "password = 'abcdefghij'\n"),
    ("Dockerfile", "FROM x\n"),
    ("next.config.js", "module.exports = {}\n"),
    ("w.yaml", "secret: 'abcdefgh'\n"),
    ("README.md", "docs\n"),
    ("big.py", "x = 1\n" * 601),
    ("big.php", "$x = 1;\n" * 600 + "$y = 2;"),
    ("plain.py", "a = 1\n" * 130),
    ("empty.go", ""),
    ("x.spec.js", "while(a) {\n    for(b) {}\n  while (c) {}\n}\n"),
    ("env.py", "import os\n\n@app.route('/a', methods=['get', 'POST'])\ndef a():\n    return os.environ.get('HOME', 'x')\n\n@api.get('/b')\nasync def b():\n    return os.getenv('B') or os.environ['C']\n"),
    ("y.py", "@router.delete(\"/items/{id}\")\ndef drop(id): pass\nZ = os.getenv('Z', 3)\nW = getenv('W')\n"),
]

# The text becomes a comment in these sources, so that they parse; the others start with it as it is.
FILES = f"""
SELECT d.source AS repo_id,
       CASE CAST(d.doc_id AS BIGINT) % 7 WHEN 0 THEN 'src' WHEN 1 THEN 'tests' WHEN 2 THEN 'src/api'
            WHEN 3 THEN 'node_modules/x' WHEN 4 THEN 'docs' WHEN 5 THEN '.github' ELSE 'lib' END
         || '/d' || CAST(d.doc_id AS STRING) || '/' || s.name AS path,
       CAST(OCTETS(d.text || s.snippet) AS BIGINT) AS size_bytes,
       (d.doc_id % 997 = 996) AS is_symlink,
       CASE WHEN s.name IN ('env.py', 'y.py', 'manage.py')
            THEN '# ' || replace(d.text, chr(10), chr(10) || '# ') || chr(10) || s.snippet
            WHEN s.name = 'empty.go' THEN ''
            ELSE d.text || chr(10) || s.snippet END AS content
FROM $documents$ d
JOIN {_values(SNIPPETS, 'name', 'snippet')} AS s ON s.k = d.doc_id % {len(SNIPPETS)}
"""

# The batch view adds one root readme to about half of the repositories.
FILES_ALL = f"""
{FILES}
UNION ALL
SELECT source, 'README.md', CAST(OCTETS(max(text)) AS BIGINT), false, max(text)
FROM $documents$ WHERE length(source) = 4 GROUP BY source
"""

HTML_SNIPPETS = [
    ("<img src=\"a.png\">\n<IMG SRC='b' ALT='x'>\n",),
    ("<a href=x onclick=\"go()\">\n<p onx =1>\n<p data-on=1>\n",),
    ("<a target=\"_blank\" href=x>\n<a target=\"_blank\" rel=\"noopener\">\n",),
    ("<input name=a>\n<input type=text>\n",),
    ("<script src=a.js></script>\n<script defer src=b.js></script>\n<SCRIPT SRC=c.js ASYNC></SCRIPT>\n",),
    ("",),
]
HTML = f"""
SELECT 'site' || CAST(p.page_id % 10 AS STRING) AS repo_id,
       'p' || CAST(p.page_id AS STRING) || '/index.html' AS path,
       CAST(OCTETS(p.html) AS BIGINT) AS size_bytes,
       false AS is_symlink,
       CASE WHEN p.page_id % 6 = 5 THEN replace(p.html, ' lang="', ' data-l="') ELSE p.html END
         || chr(10) || s.snippet AS content
FROM $pages$ p JOIN {_values(HTML_SNIPPETS, 'snippet')} AS s ON s.k = p.page_id % {len(HTML_SNIPPETS)}
"""

CSS_SNIPPETS = [
    ("a{\ncolor:red;\ncolor:blue;\n}\nb{\ncolor:red;\n}\n",),
    ("}\n}\na {\n  margin: 0;\n  padding: 1px\n}\nx:y;\n",),
    ("@media x {\n a {\n  color: red !important;\n  --v: 1;\n  --v: 2;\n }\n color: blue\n}\n",),
    (".a { color: red }\n.b { color: red; }\nfont-size: 3px\n!important\n",),
    ("a {\n background: url(x\n  y);\n background:\n  red;\n width: calc(1px +\n  2px)\n}\n",),
    ("a {\n/* c */ color: red; /* d */\n/* e\n f */ color: blue /* g */\n}\n",),
    ("a {\n http://x\n //y: z\n *zoom: 1\n COLOR: red;\n color: red;\n top: 1\\\n}\n",),
    ("a {\n left: 1px;\n}\n" * 280,),
]
CSS = f"""
SELECT d.source AS repo_id,
       'css/d' || CAST(d.doc_id AS STRING) || CASE d.doc_id % 4 WHEN 0 THEN '.css' WHEN 1 THEN '.scss'
         WHEN 2 THEN '.sass' ELSE '.less' END AS path,
       CAST(OCTETS(d.text) AS BIGINT) AS size_bytes,
       false AS is_symlink,
       '/* ' || replace(d.text, '*/', '* /') || ' */' || chr(10) || s.snippet AS content
FROM $documents$ d JOIN {_values(CSS_SNIPPETS, 'snippet')} AS s
  ON s.k = CAST(floor(d.doc_id / 4) AS BIGINT) % {len(CSS_SNIPPETS)}
"""

# The word @ stands for a name made from the document; the text itself is a member or a comment.
MANIFESTS = [
    ("package.json", "{\"name\": \"x\", \"dependencies\": {\"@\": \"*\", \"react\": \"1.2\", \"b\": \" latest \"}, \"devDependencies\": {\"@\": \"^2\", \"vite\": \"\", \"react\": \"1.2\"}, \"description\": \"TEXT\"}"),
    ("package.json", "{\"dependencies\": {\"@\": \"1.0\", \"express\": \"~3\"}, \"description\": \"TEXT\"}"),
    ("package.json", "{\"dependencies\": {\"@\": }, \"description\": \"TEXT\"}"),
    ("package.json", "{\"dependencies\": null, \"devDependencies\": [1], \"description\": \"TEXT\"}"),
    ("yarn.lock", "# TEXT\n"),
    ("requirements.txt", "# TEXT\n@==1.0\nflask\nuvicorn[standard]==0.30\na>=1,<2\ngit+https://x\n-r other.txt\n\nb!=2\n @y \nflask\nc ~= 1\n"),
    ("requirements-dev.txt", "pytest>8\nruff<1\n@\nx == \n# TEXT\n"),
    ("composer.json", "{\"require\": {\"php\": \"^8\", \"@/p\": \"dev-master\", \"q\": \"*\"}, \"require-dev\": {\"q\": \"1\", \"r\": \"dev-main\"}, \"description\": \"TEXT\"}"),
    ("composer.json", "[\"TEXT\", "),
    ("pom.xml", "<project><a><version>LATEST</version></a><b><x.version>release</x.version></b><version>1</version></project>"),
    ("pom.xml", "<project><version>LATEST</project>"),
    ("Cargo.toml", "[dependencies]\n@ = { version = \"*\" }\n# TEXT\n"),
    ("go.mod", "module @\nrequire x v1\n"),
    ("Gemfile", "gem '@', version = '*'\n# TEXT\n"),
    ("pyproject.toml", "[project]\nname = '@'\nversion = '1'\n"),
    ("app.csproj", "<Project/>"),
    ("go.sum", "x\n"),
    ("package.json", "{\"name\": \"TEXT\", \"dependencies\": {\"@a\": 1.0, \"@b\": true, \"@c\": 2, \"@d\": null}, \"devDependencies\": {\"@b\": false, \"@e\": 10.25}}"),
    ("package.json", "{\"name\": \"TEXT\", \"dependencies\": {\"@n\": NaN, \"@m\": \"*\"}}"),
    ("composer.json", "{\"name\": \"TEXT\", \"require\": {\"@n\": NaN, \"@m\": \"dev-main\", \"@o\": 3.0}}"),
]
MANIFEST_FILES = f"""
SELECT d.source AS repo_id,
       CASE WHEN s.name = 'yarn.lock' THEN 'm/d' || CAST(d.doc_id - 3 AS STRING)
            ELSE 'm/d' || CAST(d.doc_id AS STRING) END || '/' || s.name AS path,
       CAST(OCTETS(d.text) AS BIGINT) AS size_bytes,
       false AS is_symlink,
       replace(replace(s.body, '@', d.lang || CAST(d.doc_id % 50 AS STRING)), 'TEXT',
               replace(replace(replace(replace(replace(d.text, chr(92), ' '), '"', ' '), chr(10), ' '), chr(9), ' '),
                       chr(13), ' ')) AS content
FROM $documents$ d JOIN {_values(MANIFESTS, 'name', 'body')} AS s ON s.k = d.doc_id % {len(MANIFESTS)}
"""

REPORTS = [
    ("bandit", "{\"results\": [{\"test_name\": \"N\", \"issue_severity\": \"HIGH\", \"filename\": \"./src/N.py\", \"line_number\": 3, \"issue_text\": \"t\", \"issue_confidence\": \"LOW\"}, {\"issue_severity\": \"ODD\", \"filename\": \".github/x.py\"}]}"),
    ("bandit", "{\"results\": []}"),
    ("ruff", "[{\"code\": \"F401\", \"message\": \"N\", \"filename\": \"a/N.py\", \"location\": {\"row\": 4}, \"fix\": {\"message\": \"drop\"}}, {\"code\": \"W291\", \"message\": \"w\", \"filename\": \"/b.py\", \"location\": {\"row\": 1}, \"fix\": null}, {\"code\": null, \"message\": \"s\", \"filename\": \"c.py\"}, {\"code\": \"E711\", \"message\": \"e\", \"filename\": \"d.py\"}]"),
    ("ruff", "not json"),
    ("radon", "{\"./m/N.py\": [{\"name\": \"f\", \"lineno\": 7, \"complexity\": 21}, {\"name\": \"g\", \"lineno\": 9, \"complexity\": 10}, {\"name\": \"h\", \"lineno\": 11, \"complexity\": 9}], \"bad.py\": {\"error\": \"x\"}}"),
    ("eslint", "[{\"filePath\": \"src/N.js\", \"messages\": [{\"ruleId\": \"security/x\", \"severity\": 2, \"line\": 5, \"message\": \"m\"}, {\"ruleId\": null, \"severity\": 1, \"line\": null, \"message\": \"p\"}]}, {\"filePath\": \"b.js\", \"messages\": []}]"),
    ("npm-audit", "{\"vulnerabilities\": {\"N\": {\"severity\": \"moderate\"}, \"lodash\": {\"severity\": \"critical\"}, \"odd\": {\"severity\": \"none\"}}}"),
    ("npm-audit", "{}"),
]
TOOL_REPORTS = f"""
SELECT d.source || '-' || CAST(d.doc_id AS STRING) AS repo_id, r.tool AS tool,
       replace(r.body, 'N', d.lang || CAST(d.doc_id AS STRING)) AS report
FROM $documents$ d JOIN {_values(REPORTS, 'tool', 'body')} AS r ON r.k = d.doc_id % {len(REPORTS)}
"""

REPOSITORIES = """
SELECT CAST(c_custkey AS STRING) AS id, CAST(c_nationkey AS STRING) AS owner_id, c_name AS name,
       lower(c_mktsegment) || '/' || replace(c_name, '#', '-') AS full_name,
       'https://github.com/' || lower(c_mktsegment) || '/' || replace(c_name, '#', '-') AS clone_url,
       c_acctbal < 0 AS is_private,
       CASE c_custkey % 3 WHEN 0 THEN 'main' WHEN 1 THEN '' ELSE 'dev' END AS default_branch,
       c_acctbal
FROM $customer$
"""

REPO_REQUESTS = """
SELECT CAST(c_custkey AS STRING) AS request_id,
       CAST(c_nationkey AS STRING) AS owner_id,
       CASE c_custkey % 9
         WHEN 0 THEN 'https://github.com/' || lower(c_mktsegment) || '/' || replace(c_name, '#', '-')
         WHEN 1 THEN ' https://WWW.GitHub.com/' || lower(c_mktsegment) || '/' || replace(c_name, '#', '-') || '.git/ '
         WHEN 2 THEN 'http://github.com/' || lower(c_mktsegment) || '/' || replace(c_name, '#', '-')
         WHEN 3 THEN 'https://localhost/evil/' || replace(c_name, '#', '-') || '.git'
         WHEN 4 THEN 'https://github.com/' || replace(c_name, '#', '-')
         WHEN 5 THEN 'https://github.com/o/' || replace(c_name, '#', '-') || '/tree/main'
         WHEN 6 THEN 'https://github.com/new/' || replace(c_name, '#', '-') || '.git'
         WHEN 7 THEN 'https://github.com/o/.git'
         ELSE 'not a url ' || replace(c_name, '#', '-') END AS clone_url,
       c_acctbal > 5000 AS is_private,
       CASE c_custkey % 2 WHEN 0 THEN '' ELSE 'trunk' END AS default_branch
FROM $customer$
UNION ALL
SELECT CAST(c_custkey AS STRING) || CASE WHEN c_custkey % 4 < 2 THEN '-again' ELSE ' first' END, CAST(c_nationkey AS STRING),
       'https://github.com/new/' || replace(c_name, '#', '-'), c_acctbal > 0, CASE c_custkey % 3 WHEN 0 THEN '' ELSE 'later' END
FROM $customer$ WHERE c_custkey % 9 = 6
"""

ANALYSES = """
SELECT CAST(o_orderkey AS STRING) AS id, CAST(o_custkey AS STRING) AS repository_id, 'main' AS branch,
       CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'building_index' ELSE 'complete' END AS status,
       CASE WHEN o_orderstatus = 'O' THEN CAST(NULL AS INT) ELSE CAST(o_orderkey % 101 AS INT) END AS overall_score,
       CAST(o_custkey % 101 AS INT) AS security_score,
       CAST(o_orderkey % 7 AS INT) AS file_count,
       CAST(floor(o_totalprice) AS INT) AS lines_of_code,
       o_orderstatus = 'O' AS has_tests,
       o_orderpriority LIKE '1%' AS has_docs,
       o_orderdate AS created_at
FROM $orders$
"""

ISSUES = """
SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-'
         || CAST(l_suppkey AS STRING) AS id,
       CAST(l_orderkey AS STRING) AS analysis_id,
       CAST(l_orderkey % 100 AS STRING) AS repo_id,
       'rule ' || CAST(l_partkey % 13 AS STRING) || CASE WHEN l_partkey % 13 = 4 THEN ' Dependency' ELSE '' END AS title,
       CASE l_linenumber % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'info' END AS severity,
       CASE l_partkey % 13 % 7 WHEN 0 THEN 'bug' WHEN 1 THEN 'security' WHEN 2 THEN 'performance' WHEN 3 THEN 'architecture'
         WHEN 4 THEN 'code_quality' WHEN 5 THEN 'documentation' ELSE 'testing' END AS category,
       CASE WHEN l_suppkey % 3 = 0 THEN '/' ELSE '' END || 'src/f' || CAST(l_suppkey % 5 AS STRING) || '.py' AS file_path,
       CASE WHEN l_partkey % 11 = 0 THEN CAST(NULL AS INT) ELSE CAST(l_quantity AS INT) % 5 END AS line_number,
       CASE l_suppkey % 3 WHEN 0 THEN 'Python' WHEN 1 THEN 'Go' ELSE CAST(NULL AS STRING) END AS language,
       CASE WHEN l_partkey % 5 = 0 THEN CAST(NULL AS STRING) ELSE 'seen by ' || l_returnflag END AS description,
       CASE WHEN l_partkey % 4 = 0 THEN CAST(NULL AS STRING) ELSE 'fix, "' || l_linestatus || '"' END AS suggested_fix,
       CASE l_partkey % 3 WHEN 0 THEN CAST(NULL AS STRING) WHEN 1 THEN '' ELSE
         CASE l_suppkey % 4 WHEN 0 THEN 'patch ' || CAST(l_partkey AS STRING) WHEN 1 THEN 'VALIDATION_REQUIRED'
           WHEN 2 THEN 'x' || chr(10) || ' However: y' ELSE '```' END END AS generated_patch,
       CASE l_partkey % 13 % 4 WHEN 0 THEN 'bandit' WHEN 1 THEN 'ruff' WHEN 2 THEN 'npm-audit' ELSE 'eslint' END AS source_tool,
       CASE l_linestatus WHEN 'O' THEN 'open' ELSE 'resolved' END AS status,
       l_shipdate AS created_at,
       l_orderkey AS seq_1, l_linenumber AS seq_2, l_partkey AS seq_3, l_suppkey AS seq_4
FROM $lineitem$
"""

EVENTS = """
SELECT CAST(user_id AS STRING) AS analysis_id, event_id, ts,
       CASE event_type WHEN 'signup' THEN 'cloning' WHEN 'view' THEN 'detecting_languages'
         WHEN 'click' THEN 'running_static_analysis' WHEN 'purchase' THEN 'complete' ELSE 'failed' END AS status,
       CASE event_type WHEN 'signup' THEN 5 WHEN 'view' THEN 20 WHEN 'click' THEN 40 WHEN 'purchase' THEN 100
         ELSE CAST(NULL AS INT) END AS progress_percent,
       CASE WHEN event_type = 'error' THEN props ELSE CAST(NULL AS STRING) END AS error_message
FROM $events$
"""

CHUNKS = """
SELECT CAST(label AS STRING) AS repo_id, vec_id AS chunk_id, 'f' || CAST(vec_id % 17 AS STRING) || '.py' AS file_path,
       CAST(vec_id AS INT) + 1 AS start_line, CAST(vec_id AS INT) + 9 AS end_line,
       coalesce(d.text, 'chunk ' || CAST(vec_id AS STRING)) AS content, embedding
FROM $embeddings$ e LEFT JOIN $documents$ d ON d.doc_id = e.vec_id
"""

# Every user turn of a conversation asks with the vector that carries the conversation's number.
QUESTIONS = """
SELECT CAST(c.conv_id AS STRING) || ':' || CAST(c.turn AS STRING) AS question_id,
       CAST(e.label AS STRING) AS repo_id, e.embedding
FROM $conversations$ c JOIN $embeddings$ e ON e.vec_id = c.conv_id
WHERE c.role = 'user'
"""

RESPONSE_HEADS = [
    ("## IMPROVED_CODE:\n```python\n", "\n```\n**EXPLANATION**\n", "\n- SIDE_EFFECTS -\nnone\nIMPROVEMENT:\nfaster\n"),
    ("preamble\nIMPROVED_CODE\n", "\n# explanation :\n", "\nIMPROVED_CODE\nmore()\n"),
    ("EXPLANATION\n", "\nIMPROVED_CODE\n   \n", "\nIMPROVEMENT\nx\n"),
    ("IMPROVED_CODE\nVALIDATION_REQUIRED\n", "EXPLANATION\n", ""),
    ("no heading here\n", "", ""),
    ("IMPROVED_CODE\r\n<?php eval(1);\r\nSIDE_EFFECTS\r\n", "", "EXPLANATION\n"),
    ("IMPROVED_CODE\nHowever, x\n", "EXPLANATION\n", ""),
]
RESPONSES = f"""
SELECT d.doc_id AS issue_id,
       'src/d' || CAST(d.doc_id AS STRING) || CASE d.doc_id % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.php' WHEN 2 THEN '.html' ELSE '.js' END AS file_path,
       CASE d.doc_id % 4 WHEN 0 THEN 'Python' WHEN 1 THEN ' PHP ' WHEN 2 THEN 'HTML' ELSE 'JavaScript' END AS language,
       CASE d.doc_id % 4 WHEN 2 THEN '<html>' || d.lang ELSE d.lang END AS original_code,
       h.a || d.text || h.b || d.source || h.c AS raw_response
FROM $documents$ d JOIN {_values(RESPONSE_HEADS, 'a', 'b', 'c')} AS h ON h.k = d.doc_id % {len(RESPONSE_HEADS)}
"""

CHAT = """
SELECT CAST(conv_id AS STRING) AS session_id, turn, text AS message, 'answer to ' || text AS answer,
       'f' || CAST(turn AS STRING) || '.py:1-2' AS ref_a, role || '.py:3-4' AS ref_b
FROM $conversations$
"""

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def spread(table: DataFrame) -> DataFrame:
    """Deals the rows of a small fixture table, one file with one split, out to every core. No part of the engine."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= cores else table.repartition(cores)


def spark_table(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Registers a table as a view, spread over the cores if it is one small file, and returns the view's name."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    view = f"{name}_{zlib.crc32(path.encode()):08x}"
    spread(spark.read.parquet(path)).createOrReplaceTempView(view)
    return view


def spark_view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    for name in TABLES:
        if f"${name}$" in sql:
            sql = sql.replace(f"${name}$", spark_table(spark, sf_dir, name))
    return spark.sql(sql.replace("OCTETS(", "octet_length("))


def duck_view(sql: str) -> str:
    for name in TABLES:
        sql = sql.replace(f"${name}$", name)
    return sql.replace("OCTETS(", "strlen(")
