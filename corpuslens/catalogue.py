"""Rules and lookup tables as data. Patterns are Java regexes; (?U) gives Unicode \\w, \\s and \\b."""

from __future__ import annotations

from typing import NamedTuple

# File extension -> language label.
EXTENSION_LANGUAGE = {
    ".py": "Python", ".js": "JavaScript", ".mjs": "JavaScript", ".cjs": "JavaScript", ".jsx": "React",
    ".ts": "TypeScript", ".tsx": "React TypeScript", ".java": "Java", ".go": "Go", ".rb": "Ruby",
    ".php": "PHP", ".html": "HTML", ".htm": "HTML", ".css": "CSS", ".scss": "SCSS", ".sass": "Sass",
    ".less": "Less", ".cs": "C#", ".cpp": "C++", ".cc": "C++", ".cxx": "C++", ".c": "C",
    ".h": "C/C++ Header", ".hpp": "C/C++ Header", ".rs": "Rust", ".kt": "Kotlin", ".kts": "Kotlin",
    ".swift": "Swift", ".sh": "Shell", ".sql": "SQL", ".vue": "Vue", ".svelte": "Svelte",
}
CSS_LANGUAGES = ("CSS", "SCSS", "Sass", "Less")
SCRIPT_LANGUAGES = ("JavaScript", "TypeScript", "React", "React TypeScript")

# Directory names skipped by each kind of walk.
IGNORED_DIRS = {
    "language": (
        ".git", ".github", "node_modules", "venv", ".venv", "__pycache__", "dist", "build", ".next", ".nuxt",
        "target", "vendor", "coverage", ".coverage", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".idea",
        ".vscode", "bin", "obj",
    ),
    "clone": (
        ".git", ".github", ".idea", ".vscode", ".next", ".nuxt", ".cache", ".pytest_cache", ".mypy_cache",
        ".ruff_cache", "__pycache__", "node_modules", "vendor", "venv", ".venv", "env", ".env", "dist",
        "build", "coverage", ".coverage", "target", "bin", "obj", "out",
    ),
    "security": (
        ".git", "node_modules", "venv", ".venv", "__pycache__", "dist", "build", ".next", "target", "vendor",
    ),
    "tree": (
        ".git", ".github", "node_modules", "venv", ".venv", "env", "dist", "build", "coverage", "__pycache__",
        ".next", ".nuxt", "vendor", "target", ".idea", ".vscode", ".pytest_cache", ".mypy_cache",
        ".ruff_cache",
    ),
}

# File names and extensions that are never analysed.
IGNORED_FILE_NAMES = (".DS_Store", "Thumbs.db")
IGNORED_EXTENSIONS = (
    ".pyc", ".pyo", ".class", ".o", ".obj", ".so", ".dll", ".dylib", ".exe", ".bin", ".pack", ".idx",
    ".jpg", ".jpeg", ".png", ".gif", ".webp", ".bmp", ".ico", ".svg", ".tiff", ".tif", ".avif",
    ".mp4", ".mov", ".avi", ".mkv", ".webm", ".mp3", ".wav", ".ogg", ".flac", ".m4a",
    ".ttf", ".otf", ".woff", ".woff2", ".eot", ".zip", ".tar", ".gz", ".tgz", ".rar", ".7z",
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".db", ".sqlite", ".sqlite3",
)

# Extensions the security scan reads.
SECURITY_EXTENSIONS = (
    ".py", ".js", ".jsx", ".ts", ".tsx", ".java", ".go", ".rb", ".php", ".cs", ".cpp", ".c", ".rs",
    ".yml", ".yaml", ".env", ".json", ".config", ".txt",
)
SECURITY_MAX_BYTES = 2_000_000

# Dependency manifest file name -> ecosystem.
MANIFESTS = {
    "package.json": "Node.js", "package-lock.json": "Node.js", "yarn.lock": "Node.js",
    "pnpm-lock.yaml": "Node.js", "requirements.txt": "Python", "requirement.txt": "Python",
    "requirements-dev.txt": "Python", "requirements-prod.txt": "Python", "pyproject.toml": "Python",
    "Pipfile": "Python", "Pipfile.lock": "Python", "poetry.lock": "Python", "composer.json": "PHP",
    "composer.lock": "PHP", "pom.xml": "Java", "build.gradle": "Java/Kotlin", "build.gradle.kts": "Kotlin",
    "go.mod": "Go", "go.sum": "Go", "Cargo.toml": "Rust", "Cargo.lock": "Rust", "Gemfile": "Ruby",
    "Gemfile.lock": "Ruby", "Package.swift": "Swift",
}
REQUIREMENT_FILES = ("requirements.txt", "requirement.txt", "requirements-dev.txt", "requirements-prod.txt")
NODE_LOCKFILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml")
TEXT_MANIFESTS = ("Cargo.toml", "go.mod", "Gemfile", "pyproject.toml")

# File name -> framework, and package.json dependency -> framework.
FRAMEWORK_FILES = {
    "manage.py": "Django", "flask.py": "Flask", "next.config.js": "Next.js", "next.config.mjs": "Next.js",
    "next.config.ts": "Next.js", "vite.config.js": "Vite", "vite.config.ts": "Vite",
    "angular.json": "Angular", "vue.config.js": "Vue", "svelte.config.js": "Svelte",
    "docker-compose.yml": "Docker Compose", "docker-compose.yaml": "Docker Compose",
    "Dockerfile": "Docker", "pom.xml": "Maven", "go.mod": "Go Modules", "Gemfile": "Ruby/Bundler",
    "Cargo.toml": "Cargo",
}
FRAMEWORK_PACKAGES = {
    "react": "React", "react-dom": "React", "vue": "Vue", "express": "Express", "next": "Next.js",
    "@nestjs/core": "NestJS", "svelte": "Svelte", "tailwindcss": "Tailwind CSS", "fastify": "Fastify",
    "vite": "Vite", "@angular/core": "Angular", "electron": "Electron",
}

# Base names that hint at an entry point, root readmes, and test-path markers.
ENTRY_POINTS = (
    "main.py", "app.py", "manage.py", "index.js", "index.ts", "server.js", "server.ts", "main.go",
    "Program.cs", "Main.java",
)
ROOT_READMES = ("README.md", "README.rst", "README.txt", "readme.md")
TEST_MARKERS = {
    "score": ("/tests/", "\\tests\\", "/test/", "\\test\\", ".test.", ".spec.", "_test.", "test_"),
    "candidate": (".test.", ".spec.", "_test.", "test_", "/tests/", "\\tests\\"),
}

# Loop tokens per language, looked up in the stripped line.
LOOP_TOKENS = {
    "Python": ("for ", "while "),
    "JavaScript": ("for (", "for(", "while (", "while("),
    "React": ("for (", "for(", ".map("),
    "TypeScript": ("for (", "for(", "while ("),
    "React TypeScript": ("for (", "for(", ".map("),
    "Java": ("for (", "for(", "while ("),
    "C": ("for (", "for(", "while ("),
    "C++": ("for (", "for(", "while ("),
    "C#": ("for (", "foreach (", "while ("),
    "Go": ("for ",),
    "Rust": ("for ", "while "),
    "Kotlin": ("for (", "while ("),
    "Swift": ("for ", "while "),
    "Ruby": (".each do", "while ", "for "),
}
LARGE_SOURCE_LINES = 600
LARGE_STYLESHEET_LINES = 800

# Chunk boundaries (function and class heads), matched at the start of a line.
CHUNK_BOUNDARY = (
    r"(?U)^\s*(?:"
    r"(?:def|class)\s+\w+"
    r"|(?:export\s+)?(?:async\s+)?function\s+\w+"
    r"|(?:export\s+)?(?:default\s+)?class\s+\w+"
    r"|(?:public|private|protected)?\s*\w[\w<>\[\]]*\s+\w+\s*\("
    r")"
)
CHUNK_WINDOW_LINES = 60

# Score model.
SEVERITY_PENALTY = {"critical": 25, "high": 12, "medium": 5, "low": 2, "info": 0}
CATEGORY_SCORE = {
    "security": "security_score", "bug": "maintainability_score", "performance": "performance_score",
    "architecture": "architecture_score", "code_quality": "maintainability_score",
    "documentation": "documentation_score", "testing": "testing_score",
}
SCORE_WEIGHTS = {
    "security_score": 0.30, "maintainability_score": 0.20, "performance_score": 0.15,
    "documentation_score": 0.10, "testing_score": 0.15, "architecture_score": 0.10,
}

# Test framework and test file name per language ({b} is the file's stem, {c} the stem capitalised).
TEST_FRAMEWORK = {
    "Python": "pytest", "JavaScript": "Vitest", "React": "Vitest + React Testing Library",
    "TypeScript": "Vitest", "React TypeScript": "Vitest + React Testing Library", "Java": "JUnit 5",
    "C": "Unity Test Framework", "C++": "GoogleTest", "C/C++ Header": "GoogleTest",
    "Go": "Go testing package", "Ruby": "RSpec", "PHP": "PHPUnit", "C#": "xUnit",
    "Rust": "Rust built-in tests", "Kotlin": "JUnit 5", "Swift": "XCTest", "HTML": "Playwright Test",
    "CSS": "Playwright Test", "SCSS": "Playwright Test", "Vue": "Vitest + Vue Test Utils",
    "Svelte": "Vitest + Testing Library", "Shell": "Bats", "SQL": "database integration tests",
}
TEST_FRAMEWORK_DEFAULT = "language-appropriate unit tests"
ENDPOINT_MARKERS = ("controller", "route", "api", "endpoint")
ENDPOINT_FRAMEWORK = {
    "JavaScript": "Supertest + Vitest", "TypeScript": "Supertest + Vitest",
    "Python": "pytest + framework test client", "Java": "JUnit 5 + MockMvc", "PHP": "PHPUnit HTTP tests",
}
TEST_FILE_NAME = {
    "Python": "test_{b}.py", "JavaScript": "{b}.test.js", "React": "{b}.test.jsx",
    "TypeScript": "{b}.test.ts", "React TypeScript": "{b}.test.tsx", "Java": "{b}Test.java",
    "C": "test_{b}.c", "C++": "{b}Test.cpp", "C/C++ Header": "{b}Test.cpp", "Go": "{b}_test.go",
    "PHP": "{c}Test.php", "C#": "{b}Tests.cs", "Rust": "{b}_test.rs", "Kotlin": "{b}Test.kt",
    "Swift": "{b}Tests.swift", "Ruby": "{b}_spec.rb", "HTML": "{b}.spec.ts", "CSS": "{b}.spec.ts",
    "SCSS": "{b}.spec.ts", "Vue": "{b}.spec.ts", "Svelte": "{b}.spec.ts", "Shell": "{b}.bats",
    "SQL": "test_{b}.sql",
}
TEST_FILE_DEFAULT = "{b}.test.txt"

# Order in which the analyzers' findings are appended; the first of two equal findings is kept.
SEQ = {
    "python": 1, "javascript": 2, "php": 3, "html": 4, "css": 5, "language": 6, "dependencies": 7,
    "security": 8,
}


class Rule(NamedTuple):
    rule_id: str
    family: str          # common | language | security | php | html
    language: str | None  # gate for language rules
    kind: str            # regex | text | html
    pattern: str
    severity: str
    category: str
    title: str
    description: str
    risk: str | None
    suggested_fix: str

    @property
    def tool(self) -> str:
        if self.family == "language":
            return f"scan-{self.language.lower().replace(' ', '-')}-checks"
        return {"common": "scan-common-checks", "security": "scan-pattern-scanner",
                "php": "scan-php-checks", "html": "scan-html-checks"}[self.family]


def _r(rule_id, family, language, kind, pattern, severity, category, title, description, fix, risk=None):
    return Rule(rule_id, family, language, kind, pattern, severity, category, title, description, risk, fix)


# Id, gate, pattern, severity, category and title of every line rule. Descriptions and fixes are ours.
RULES: tuple[Rule, ...] = (
    _r("RM1", "common", None, "regex", r"(?iU)\bTODO\b|\bFIXME\b", "info", "code_quality",
       "Unresolved TODO or FIXME", "A work marker was left in this line.", "Do the work or move it to the tracker."),
    _r("RM2", "common", None, "regex", r"""(?iU)(password|secret|api[_-]?key)\s*[:=]\s*["'][^"']{6,}["']""",
       "high", "security", "Possible hard-coded secret", "The quoted value looks like a credential.",
       "Read the value from configuration kept outside the sources."),
    _r("RL01", "language", "JavaScript", "text", "eval(", "high", "security", "Unsafe eval usage",
       "Text is executed as code.", "Parse the input or look the operation up in a table."),
    _r("RL02", "language", "JavaScript", "text", ".innerHTML", "medium", "security",
       "Potential unsafe HTML injection", "Markup is assigned without escaping.", "Assign text, or sanitise first."),
    _r("RL03", "language", "JavaScript", "text", "console.log(", "low", "code_quality",
       "Debug logging left in source", "Debug output ships with the code.", "Delete it or log through a logger."),
    _r("RL04", "language", "JavaScript", "text", "document.querySelector", "low", "performance",
       "Repeated DOM lookup may affect performance", "The element is searched for on each call.",
       "Look the element up once and keep the reference."),
    _r("RL05", "language", "React", "text", "dangerouslySetInnerHTML", "high", "security",
       "Unsafe React HTML rendering", "Raw markup bypasses escaping.", "Render elements, or sanitise first."),
    _r("RL06", "language", "React", "text", "console.log(", "low", "code_quality",
       "Debug logging left in React code", "Debug output ships with the component.", "Delete it."),
    _r("RL07", "language", "TypeScript", "text", ": any", "low", "code_quality",
       "Use of any weakens type safety", "The value is not type-checked.", "Name the type, or use unknown."),
    _r("RL08", "language", "TypeScript", "text", "eval(", "high", "security", "Unsafe eval usage",
       "Text is executed as code.", "Parse the input or look the operation up in a table."),
    _r("RL09", "language", "React TypeScript", "text", "dangerouslySetInnerHTML", "high", "security",
       "Unsafe React HTML rendering", "Raw markup bypasses escaping.", "Render elements, or sanitise first."),
    _r("RL10", "language", "React TypeScript", "text", ": any", "low", "code_quality",
       "Use of any weakens type safety", "The value is not type-checked.", "Name the type, or use unknown."),
    _r("RL11", "language", "Java", "text", "System.out.println(", "low", "code_quality",
       "Console output in application code", "Output goes to the console.", "Log through a logger."),
    _r("RL12", "language", "Java", "text", "Runtime.getRuntime().exec(", "high", "security",
       "Operating system command execution", "A command is started.", "Avoid it, or check every argument."),
    _r("RL13", "language", "Java", "text", "new Random(", "medium", "security",
       "Non-cryptographic random generator", "The sequence can be predicted.", "Use SecureRandom for secrets."),
    _r("RL14", "language", "C", "text", "gets(", "critical", "security", "Unsafe gets function",
       "The read has no bound.", "Read with an explicit size."),
    _r("RL15", "language", "C", "text", "strcpy(", "high", "security", "Potential unsafe string copy",
       "The copy has no bound.", "Copy with an explicit size."),
    _r("RL16", "language", "C", "text", "sprintf(", "high", "security", "Potential unbounded formatting",
       "The formatted text has no bound.", "Format with an explicit size."),
    _r("RL17", "language", "C++", "text", "strcpy(", "high", "security", "Potential unsafe string copy",
       "The copy has no bound.", "Use a string class or an explicit size."),
    _r("RL18", "language", "C++", "text", "new ", "low", "code_quality", "Manual memory allocation",
       "The object must be freed by hand.", "Let an owning object manage it."),
    _r("RL19", "language", "C#", "text", "Console.WriteLine(", "low", "code_quality",
       "Console output in application code", "Output goes to the console.", "Log through a logger."),
    _r("RL20", "language", "C#", "text", "Process.Start(", "high", "security", "External process execution",
       "A process is started.", "Allow only known commands."),
    _r("RL21", "language", "Go", "text", "exec.Command(", "high", "security", "External command execution",
       "A command is started.", "Allow only known commands."),
    _r("RL22", "language", "Go", "text", "fmt.Println(", "low", "code_quality",
       "Console logging in application code", "Output goes to the console.", "Log through a logger."),
    _r("RL23", "language", "Rust", "text", "unwrap()", "medium", "bug", "Potential panic from unwrap",
       "An error here ends the program.", "Handle the error case."),
    _r("RL24", "language", "Rust", "text", "unsafe {", "medium", "security", "Unsafe Rust block",
       "Memory checks are off in the block.", "Keep the block small and state why it holds."),
    _r("RL25", "language", "Kotlin", "text", "!!", "medium", "bug", "Unsafe Kotlin non-null assertion",
       "A null here throws.", "Handle the null case."),
    _r("RL26", "language", "Kotlin", "text", "println(", "low", "code_quality",
       "Console output in application code", "Output goes to the console.", "Log through a logger."),
    _r("RL27", "language", "Swift", "text", "try!", "medium", "bug", "Forced Swift error handling",
       "An error here ends the program.", "Catch or pass on the error."),
    _r("RL28", "language", "Swift", "text", " as!", "medium", "bug", "Forced Swift type cast",
       "A wrong type ends the program.", "Cast with as? and handle nil."),
    _r("RL29", "language", "Ruby", "text", "eval(", "high", "security", "Unsafe Ruby eval usage",
       "Text is executed as code.", "Parse the input or look the operation up in a table."),
    _r("RL30", "language", "Ruby", "text", "system(", "high", "security", "Shell command execution",
       "A shell command is started.", "Avoid the shell, or check every argument."),
    _r("RP1", "php", "PHP", "regex", r"(?U)\$_GET\s*\[", "medium", "security", "Direct GET input usage",
       "A query parameter is used as it came.", "Check the parameter first."),
    _r("RP2", "php", "PHP", "regex", r"(?U)\$_POST\s*\[", "medium", "security", "Direct POST input usage",
       "A form field is used as it came.", "Check the field first."),
    _r("RP3", "php", "PHP", "regex", r"(?U)\$_REQUEST\s*\[", "high", "security", "Unsafe REQUEST input usage",
       "The value may come from several sources.", "Read from one named source and check it."),
    _r("RP4", "php", "PHP", "regex", r"(?U)\bmysql_query\s*\(", "high", "security", "Deprecated MySQL API",
       "The function was removed from PHP.", "Use PDO or mysqli with bound parameters."),
    _r("RP5", "php", "PHP", "regex", r"(?U)\beval\s*\(", "critical", "security", "Unsafe PHP eval usage",
       "Text is executed as code.", "Remove the call."),
    _r("RP6", "php", "PHP", "regex", r"(?U)\b(shell_exec|exec|system|passthru)\s*\(", "high", "security",
       "Operating system command execution", "A shell command is started.", "Avoid it, or escape every argument."),
    _r("RP7", "php", "PHP", "regex", r"(?U)\becho\s+\$_(GET|POST|REQUEST)", "high", "security",
       "Potential reflected XSS", "Request data is printed as it came.", "Escape it for HTML."),
    _r("RP8", "php", "PHP", "regex", r"(?iUd)SELECT\s+.*\.\s*\$_", "critical", "security",
       "Potential SQL injection", "Request data is joined into a statement.", "Bind it as a parameter."),
    _r("RH1", "html", "HTML", "html", "img_alt", "low", "code_quality", "Image missing alt text",
       "The image has no text alternative.", "Add an alt attribute."),
    _r("RH2", "html", "HTML", "html", "inline_handler", "low", "code_quality", "Inline JavaScript event handler",
       "Script is mixed into the markup.", "Attach the handler from a script file."),
    _r("RH3", "html", "HTML", "html", "noopener", "low", "security", "External link missing noopener",
       "The opened page can reach this one.", "Add rel=noopener."),
    _r("RH4", "html", "HTML", "html", "input_type", "low", "code_quality", "Input element missing explicit type",
       "The input falls back to text.", "State the type."),
    _r("RH5", "html", "HTML", "html", "blocking_script", "low", "performance", "Blocking external script",
       "The page waits for this script.", "Add defer or async."),
    _r("RS1", "security", None, "regex",
       r"""(?iU)(secret|api[_-]?key|token|password|passwd)\s*[:=]\s*['"][A-Za-z0-9_\-/+=]{8,}['"]""",
       "critical", "security", "Hard-coded secret / API key", "The line assigns a literal credential.",
       "Take it out of the sources and replace the credential.", "The credential is open to every reader."),
    _r("RS2", "security", None, "regex", r"-----BEGIN (RSA|EC|OPENSSH|PGP) PRIVATE KEY-----", "critical", "security",
       "Private key committed to repository", "The line starts a private key.",
       "Remove it from the history and issue a new key.", "The key's owner can be impersonated."),
    _r("RS3", "security", None, "regex",
       r"""(?iUd)(execute|query)\s*\(\s*['"].*%s.*['"]\s*%"""
       r"""|(execute|query)\s*\(\s*f['"].*\{.*\}.*(select|insert|update|delete)""",
       "critical", "security", "Potential SQL injection (string-built query)", "A statement is built from text.",
       "Bind values as parameters.", "Input can change the statement."),
    _r("RS4", "security", None, "regex", r"(?U)\beval\s*\(", "high", "security", "Use of unsafe eval",
       "Text is executed as code.", "Parse the input instead.", "Input can run as code."),
    _r("RS5", "security", None, "regex", r"(?iU)(os\.system|subprocess\.(call|run|Popen))\([^)]*\+", "high",
       "security", "Shell command built from untrusted input", "A command is built from text.",
       "Pass an argument list without a shell.", "Input can change the command."),
    _r("RS6", "security", None, "regex", r"""(?iU)Access-Control-Allow-Origin['"]?\s*[:=]\s*['"]\*['"]""", "medium",
       "security", "Permissive CORS configuration", "Every origin is allowed.", "List the allowed origins.",
       "Any site can call this service."),
)

# Text every match of a pattern must hold, as groups of which one alternative each is required. Testing for it
# first spares the regex on nearly all lines. Letters with odd case forms (s, k, i) are left out of lower-case groups.
QUOTES = ("'", '"')
NEEDS: dict[str, tuple[tuple[str, ...], ...]] = {
    "RM2": (QUOTES, (":", "=")),
    "RS1": (QUOTES, (":", "=")),
    "RS2": (("-----BEGIN ",),),
    "RS3": (QUOTES, ("(",)),
    "RS4": (("eval",), ("(",)),
    "RS5": (("(",), ("+",)),
    "RS6": (("*",), QUOTES),
    "RP1": (("$_GET",),),
    "RP2": (("$_POST",),),
    "RP3": (("$_REQUEST",),),
    "RP4": (("mysql_query",),),
    "RP5": (("eval",),),
    "RP6": (("exec", "system", "passthru"),),
    "RP7": (("$_",),),
    "RP8": (("$_",),),
}
NEEDS_LOWER: dict[str, tuple[str, ...]] = {"RM1": ("todo", "xme")}
CHUNK_NEEDS = ("(", "def", "class", "function")

# File-level findings (rule id, tool, severity, category, title).
FILE_RULES = {
    "RF1": ("scan-file-size-check", "medium", "code_quality", "Very large source file"),
    "RF2": ("scan-performance-checks", "medium", "performance", "Potential nested-loop performance issue"),
    "RP9": ("scan-php-checks", "medium", "code_quality", "Very large PHP file"),
    "RH6": ("scan-html-checks", "low", "code_quality", "HTML document missing language"),
    "RC4": ("scan-css-checks", "medium", "code_quality", "Very large stylesheet"),
}
CSS_RULES = {
    "RC1": ("low", "code_quality", "Use of !important"),
    "RC2": ("low", "code_quality", "Duplicate CSS property in the same rule"),
    "RC3": ("low", "bug", "CSS declaration may be missing semicolon"),
}
