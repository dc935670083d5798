"""Languages, their file suffixes and the patterns that reveal them in text."""

# In rank order. ``suffixes`` classify a file, ``scan_suffixes`` select files for file statistics,
# ``search_suffixes`` select files for pattern search (None: every name with a dot).
LANGUAGES = [
    {"language": "java", "suffixes": [".java"], "scan_suffixes": [".java"], "search_suffixes": [".java"]},
    {"language": "python", "suffixes": [".py"], "scan_suffixes": [".py"], "search_suffixes": [".py"]},
    {
        "language": "javascript",
        "suffixes": [".js", ".jsx"],
        "scan_suffixes": [".js", ".jsx"],
        "search_suffixes": [".js", ".mjs"],
    },
    {
        "language": "typescript",
        "suffixes": [".ts", ".tsx"],
        "scan_suffixes": [".ts", ".tsx"],
        "search_suffixes": [".ts", ".tsx"],
    },
    {"language": "csharp", "suffixes": [".cs"], "scan_suffixes": [".cs"], "search_suffixes": [".cs"]},
    {
        "language": "dotnet",
        "suffixes": [".vb", ".fs"],
        "scan_suffixes": [".cs", ".vb", ".fs"],
        "search_suffixes": None,
    },
]
LANGUAGE_ORD = {row["language"]: i for i, row in enumerate(LANGUAGES)}

# Checked in this order; two hits in the head of a file decide. Case matters.
CONTENT_PATTERNS = {
    "java": [
        r"package\s+[\w.]+;",
        r"import\s+[\w.]+;",
        r"public\s+class\s+\w+",
        r"@\w+\s*\(.*\)",
        r"System\.out\.print",
    ],
    "python": [
        r"import\s+\w+",
        r"from\s+\w+\s+import",
        r"def\s+\w+\s*\(",
        r"class\s+\w+\s*\(",
        r"""if\s+__name__\s*==\s*["\']__main__["\']:""",
        r"print\s*\(",
    ],
    "javascript": [
        r"function\s+\w+\s*\(",
        r"const\s+\w+\s*=",
        r"let\s+\w+\s*=",
        r"var\s+\w+\s*=",
        r"""require\s*\(["\'][\w./]+["\']\)""",
        r"module\.exports\s*=",
        r"console\.log\s*\(",
    ],
    "typescript": [
        r"interface\s+\w+\s*\{",
        r"type\s+\w+\s*=",
        r"enum\s+\w+\s*\{",
        r"export\s+\w+",
        r"""import.*from\s+["\'][\w./]+["\']""",
        r":\s*\w+\s*=",
        r"<\w+>",
    ],
    "csharp": [
        r"using\s+\w+;",
        r"namespace\s+[\w.]+",
        r"public\s+class\s+\w+",
        r"public\s+static\s+void\s+Main",
        r"Console\.WriteLine\s*\(",
        r"\[.*\]\s*public",
    ],
}
CLASSIFY_CHARS = 1024
SCORE_CHARS = 2048

# Manifest names that show a language is used; an entry with * is a prefix pattern.
MANIFESTS = {
    "java": ["pom.xml", "build.gradle", "build.gradle.kts", "maven.xml", "ivy.xml"],
    "python": ["requirements.txt", "setup.py", "pyproject.toml", "Pipfile", "poetry.lock", "conda.yml"],
    "javascript": ["package.json", "bower.json", "gulpfile.js", "webpack.config.js", "rollup.config.js"],
    "typescript": ["tsconfig.json", "tslint.json", "webpack.config.ts"],
    "csharp": ["*.csproj", "*.sln", "packages.config", "project.json", "Directory.Build.props"],
}

# Directories that hold version control or build output.
SKIPPED_DIRS = (
    ".git .svn .hg node_modules __pycache__ target bin obj .vscode .idea venv env .env dist build".split()
)
BASIC_SKIPPED_DIRS = ".git node_modules __pycache__ target bin obj".split()

# How a function or class header looks, first pattern first. The words before a bracket in the Java
# and C# forms are written as one character run so that long lines cannot exhaust the regex stack.
HEADER_PATTERNS = {
    "python": [r"^\s*def\s+(\w+)", r"^\s*class\s+(\w+)", r"^\s*async\s+def\s+(\w+)"],
    "java": [
        r"^\s*(?:public|private|protected)?\s*(?:static\s+)?(?:[\w\s]*\s)?(\w+)\s*\(",
        r"^\s*(?:public|private|protected)?\s*class\s+(\w+)",
    ],
    "javascript": [r"^\s*function\s+(\w+)", r"^\s*const\s+(\w+)\s*=", r"^\s*(\w+)\s*:\s*function"],
    "typescript": [
        r"^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)",
        r"^\s*(?:export\s+)?class\s+(\w+)",
    ],
    "csharp": [
        r"^\s*(?:public|private|protected|internal)?\s*(?:static\s+)?(?:[\w\s]*\s)?(\w+)\s*\(",
        r"^\s*(?:public|private|protected|internal)?\s*class\s+(\w+)",
    ],
}
HEADER_LOOK_BACK = 48
CONTEXT_LINES = 3
