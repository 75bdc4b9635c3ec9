"""Source trees: files with language, kind, and ignore rules."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Languages by file extension.
LANGUAGES = {
    ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".py": "python", ".java": "java", ".go": "go", ".rs": "rust", ".rb": "ruby", ".php": "php",
    ".c": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".h": "c", ".hpp": "cpp", ".cs": "c_sharp", ".swift": "swift", ".kt": "kotlin", ".dart": "dart",
    ".scala": "scala", ".clj": "clojure", ".cljs": "clojure", ".hs": "haskell", ".ml": "ocaml", ".sh": "bash", ".bash": "bash", ".zsh": "bash", ".fish": "fish",
    ".sql": "sql", ".proto": "proto", ".graphql": "graphql", ".md": "markdown", ".markdown": "markdown", ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml", ".xml": "xml",
    ".vue": "vue", ".svelte": "svelte",
}
# What is never indexed unless an ignore file says otherwise.
BUILTIN_IGNORE = [
    "node_modules/", ".next/", ".nuxt/", "_nuxt/", ".svelte-kit/", ".vite/", ".parcel-cache/", ".turbo/", "out/", ".cache/", "__pycache__/", "*.pyc", ".pytest_cache/", ".mypy_cache/",
    ".ruff_cache/", ".tox/", ".nox/", "htmlcov/", "*.egg-info/", ".venv/", "venv/", ".bundle/", "vendor/bundle/", "target/", ".gradle/", ".git/", ".svn/", ".hg/", ".DS_Store", "*.log",
    "coverage/", ".idea/", ".vscode/", "*.min.js", "*.min.css", "*.bundle.js", "*-min.js", "*-bundle.js", "*.chunk.js", "**/vendor/assets/**", "public/assets/**", "public/packs/**",
    "dist/**", "*.json", "*.yaml", "*.yml", "!package.json", "!tsconfig.json", "!tsconfig.*.json", "!*.config.json", "!composer.json", "!deno.json",
]
IGNORE_FILES = (".gitignore", ".dockerignore", ".npmignore", ".contextignore", ".contextignore.local")
# Names of test files by language.
TESTS = {
    "python": r"(^|/)(test_[^/]*|[^/]*_test|conftest)\.py$", "typescript": r"\.(test|spec)\.tsx?$|(^|/)__tests__/", "javascript": r"\.(test|spec)\.jsx?$|(^|/)__tests__/", "ruby": r"(^|/)(spec|test)/.*_(spec|test)\.rb$|_(spec|test)\.rb$",
    "go": r"_test\.go$", "java": r"(^|/)src/test/|Tests?\.java$", "rust": r"(^|/)tests/.*\.rs$", "php": r"Test\.php$",
}
GENERATED_PATHS = r"(^|/)(generated|gen|__generated__)/|\.(generated|g|pb)\.[^/]+$|_pb2\.py$"
GENERATED_MARKS = r"(?i)@generated|do not edit|code generated by"
DOCUMENTATION = r"(^|/)docs?/|\.(md|markdown|rst|adoc|txt)$|(^|/)(README|CHANGELOG|LICENSE)[^/]*$"


def extension(path) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def language(path) -> Column:
    """The language of a path's extension, or null."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return table[extension(path)]


def extensions(languages: list[str]) -> list[str]:
    return [e for e, name in LANGUAGES.items() if name in languages]


def ignore_regex(pattern: str) -> str:
    """A regular expression for one ignore pattern (without its ``!``)."""
    p = pattern.rstrip()
    folder = p.endswith("/")
    p = p.rstrip("/")
    anchored = "/" in p
    p = p.lstrip("/")
    out, i = "", 0
    while i < len(p):
        if p.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif p.startswith("/**", i) and i + 3 == len(p):
            out, i = out + "/.*", i + 3
        elif p.startswith("**", i):
            out, i = out + ".*", i + 2
        elif p[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        elif p[i] == "[" and "]" in p[i + 1 :]:
            j = p.index("]", i + 1)
            out, i = out + p[i : j + 1].replace("[!", "[^"), j + 1
        else:
            out, i = out + re.escape(p[i]), i + 1
    return f"^{'' if anchored else '(?:.*/)?'}{out}{'/.*' if folder else '(?:/.*)?'}$"


def ignored(path, patterns: list[str]) -> Column:
    """Whether ignore rules drop a relative path; the last rule that matches decides."""
    c, out = F.col(path) if isinstance(path, str) else path, F.lit(False)
    for p in patterns:
        p = p.strip()
        if p and not p.startswith("#"):
            keep = p.startswith("!")
            out = F.when(c.rlike(ignore_regex(p[keep:])), F.lit(not keep)).otherwise(out)
    return out


def kind(path, head) -> Column:
    """generated, test, documentation or source, by path and the head of the text."""
    test = reduce(lambda a, b: a | b, [(language(path) == name) & F.col(path).rlike(p) for name, p in TESTS.items()])
    return F.when(F.col(path).rlike(GENERATED_PATHS) | F.substring(F.coalesce(head, F.lit("")), 1, 500).rlike(GENERATED_MARKS), "generated").when(F.coalesce(test, F.lit(False)), "test").when(F.col(path).rlike(DOCUMENTATION), "documentation").otherwise("source")


def _read(spark: SparkSession, path: str) -> str:
    """A small file's text, or nothing; Spark's file source skips names with a leading dot."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return ""
    stream = fs.open(p)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


#: Levels of folders that are listed before anything is read.
LISTED = 3


def kept_roots(spark: SparkSession, root: str, rules: list[str]) -> list[str]:
    """What to read of a tree: folders without those that the rules drop, so that their files are not opened.

    Listed to a depth of ``LISTED``; a folder none of whose folders is dropped stays whole.
    Rules that take something back in may reach into any folder, so with one nothing is cut.
    """
    rules = [r.strip() for r in rules if r.strip() and not r.strip().startswith("#")]
    if any(r.startswith("!") for r in rules):
        return [root]
    dropped = [re.compile(ignore_regex(r)) for r in rules]
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def walk(path, rel: str, depth: int) -> tuple[list[str], bool]:
        out, cut = [], False
        for s in fs.listStatus(path):
            name = s.getPath().getName()
            inner = f"{rel}{name}"
            if name[0] in "._":  # not seen by Spark's file source
                continue
            if any(d.search(inner) for d in dropped):
                cut = True
                continue
            if s.isDirectory() and depth < LISTED:
                below, less = walk(s.getPath(), f"{inner}/", depth + 1)
                cut |= less
                out += below if less else [s.getPath().toString()]
            else:
                out.append(s.getPath().toString())
        return out, cut

    found, cut = walk(p, "", 1)
    return found if cut else [root]


def scan(spark: SparkSession, root: str, patterns: list[str] = (), languages: list[str] | None = None) -> DataFrame:
    """(path, language, kind, mtime, size, text) of the files that are not ignored.

    Rules: the built-in ones, the tree's ignore files in their order, then ``patterns``.
    Paths are read by Spark's file source, so a tree in any store it knows is fine.
    """
    rules = [*BUILTIN_IGNORE, *(x for name in IGNORE_FILES for x in _read(spark, f"{root.rstrip('/')}/{name}").splitlines()), *patterns]
    roots = kept_roots(spark, root, rules)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(roots or root)
    files = files if roots else files.limit(0)
    base = re.sub(r"^[a-z0-9]+:/*", "/", root).rstrip("/")
    rel = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/*", "/"), f"^{re.escape(base)}/", "")
    files = files.select(rel.alias("path"), F.col("modificationTime").cast("double").alias("mtime"), F.col("length").alias("size"), "content")
    kept = files.where(~ignored("path", rules)).withColumn("language", language("path")).where("language IS NOT NULL")
    if languages:
        kept = kept.where(F.col("language").isin(languages))
    return kept.withColumn("text", F.col("content").cast("string")).select("path", "language", kind("path", F.col("text")).alias("kind"), "mtime", "size", "text")
