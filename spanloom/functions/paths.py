"""Column expressions over paths: prefixes, classes of files, languages, tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of directories and files by which paths are classified.
DOC_DIRS = ("docs", "doc", "documentation")
TEST_DIRS = ("test", "tests", "__tests__", "spec", "specs")
EXAMPLE_DIRS = ("examples", "example", "samples", "sample", "demo", "demos")
GENERATED_DIRS = ("dist", "build", "out", "target", "node_modules", "vendor", "coverage", "__snapshots__", "__pycache__", "obj", "bin", "__generated__", "generated", "codegen", ".next", ".nuxt")
DOC_STEMS = ("readme", "changelog", "contributing", "license", "copying", "notes")
DOC_EXTENSIONS = ("md", "markdown", "rst", "adoc", "txt")

# Languages by file extension.
LANGUAGES = {
    "python": ("py", "pyi"),
    "rust": ("rs",),
    "javascript": ("js", "jsx", "mjs", "cjs"),
    "typescript": ("ts", "mts", "cts"),
    "tsx": ("tsx",),
    "csharp": ("cs", "csx"),
    "sql": ("sql",),
    "postgres": ("psql", "pgsql"),
    "tsql": ("tsql",),
    "proto": ("proto",),
    "go": ("go",),
    "yaml": ("yaml", "yml"),
    "bicep": ("bicep", "bicepparam"),
}
BY_EXTENSION = {e: language for language, extensions in LANGUAGES.items() for e in extensions}

#: A path of any of these forms is a test file.
TEST_FILE = r"/test/|/tests/|/_test/|/__tests__/|/spec/|test_|_test\.|\.test\.|\.spec\.|_spec\.rb$|test\.java$"
#: The narrower form for a file's own context.
TEST_PATH = r"/test|\\test|^test_|^tests/|_test\.py$|_test\.go$|\.test\.ts$|\.test\.js$|\.spec\.ts$|\.spec\.js$"


def first_segment(path: Column) -> Column:
    return F.substring_index(path, "/", 1)


def module_prefix(path: Column, depth: int) -> Column:
    """The first ``depth`` directories with a slash; for shallower files their directory; ``.`` at the root."""
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.when(F.size(folders) == 0, ".").otherwise(F.concat(F.array_join(F.slice(folders, 1, depth), "/"), F.lit("/")))


def under(path: Column, prefixes: list[str]) -> Column:
    """Whether a path is one of the prefixes or below it. Blank prefixes and ``.`` do not restrict."""
    kept = [p for p in (prefix.strip().replace("\\", "/").removeprefix("./").rstrip("/") for prefix in prefixes) if p not in ("", ".")]
    if not kept:
        return F.lit(True)
    out = F.lit(False)
    for prefix in kept:
        out = out | (path == prefix) | path.startswith(prefix + "/")
    return out


def normal(path: Column) -> Column:
    """A path with single slashes and without a leading ``./``."""
    return F.regexp_replace(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/+", "/"), r"^(\./)+", "")


def escapes(path: str) -> bool:
    """Whether a path given from outside would leave the repository."""
    parts = path.replace("\\", "/").split("/")
    depth = 0
    for part in parts:
        depth += -1 if part == ".." else 0 if part in ("", ".") else 1
        if depth < 0:
            return True
    return path.startswith(("/", "\\", "~")) or ":" in parts[0]


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def language(path: Column) -> Column:
    """Language of a file by its extension, null if it is none of the known ones."""
    known = F.create_map(*(F.lit(x) for kv in BY_EXTENSION.items() for x in kv))
    return F.try_element_at(known, extension(path))


def path_class(path: Column) -> Column:
    """A struct of flags: docs, tests, examples, generated, src, lib, app."""
    lower = F.lower(path)
    parts = F.split(lower, "/")
    name = F.element_at(parts, -1)
    has = lambda names: F.arrays_overlap(parts, F.array(*map(F.lit, names)))
    docs = has(DOC_DIRS) | F.substring_index(name, ".", 1).isin(*DOC_STEMS) | F.substring_index(name, ".", -1).isin(*DOC_EXTENSIONS)
    tests = has(TEST_DIRS) | name.rlike(r"^test_|_test\.|\.test\.|\.spec\.")
    generated = has(GENERATED_DIRS) | name.rlike(r"\.min\.|\.generated\.")
    return F.struct(docs.alias("docs"), tests.alias("tests"), has(EXAMPLE_DIRS).alias("examples"), generated.alias("generated"), has(("src",)).alias("src"), has(("lib",)).alias("lib"), has(("app",)).alias("app"))


def in_scope(path: Column, scope: str, exclude_generated: bool = False) -> Column:
    """Whether a path is in a search scope: code, docs, tests, examples or all."""
    flags = path_class(path)
    wanted = {"code": ~flags.docs & ~flags.tests & ~flags.examples, "docs": flags.docs, "tests": flags.tests, "examples": flags.examples, "all": F.lit(True)}
    if scope not in wanted:
        raise ValueError(f"no such scope: {scope}")
    return wanted[scope] & ~flags.generated if exclude_generated else wanted[scope]


def path_bonus(path: Column) -> Column:
    """What a hit's rank gains or loses by where its file lies."""
    flags = path_class(path)
    out = F.when(flags.generated, -2.5)
    for flag, bonus in (("docs", -2.0), ("tests", -1.5), ("examples", -1.0), ("src", 1.5), ("lib", 1.3), ("app", 1.1)):
        out = out.when(flags[flag], bonus)
    return out.otherwise(0.0)


def is_test_file(path: Column) -> Column:
    return F.lower(path).rlike(TEST_FILE)


def is_test_path(path: Column) -> Column:
    return F.lower(path).rlike(TEST_PATH)


def is_test_symbol(kind: Column, name: Column, path: Column, signature: Column, qualname: Column) -> Column:
    """Whether a symbol is a test, by the conventions of its file's language."""
    file, lower, in_test_file = F.lower(path), F.lower(name), is_test_file(path)
    python = file.endswith(".py") & (lower.startswith("test_") | in_test_file & kind.isin("function", "method", "class"))
    marked = F.lower(F.coalesce(signature, F.lit(""))).rlike(r"#\[(test|tokio::test|actix_rt::test)\]")
    rust = file.endswith(".rs") & (marked | file.rlike("(^|/)tests?/") & (kind == "function") & lower.rlike("^test_|_test$|_test_"))
    script = file.rlike(r"\.(js|ts|jsx|tsx)$") & (lower.rlike("^test|spec|^(it|describe|beforeeach|aftereach)$") | in_test_file & kind.isin("function", "method", "arrow_function"))
    java = file.endswith(".java") & (lower.startswith("test") | in_test_file & (kind == "method"))
    csharp = file.endswith(".cs") & (in_test_file & kind.isin("method", "function", "class") | qualname.rlike(r"\.Tests?\."))
    go = file.endswith("_test.go") & lower.startswith("test")
    return (F.lower(kind) == "test") | python | rust | script | java | csharp | go


def test_type(path: Column, name: Column) -> Column:
    """unit, integration or e2e."""
    lower = F.lower(path)
    return F.when(lower.rlike("/(e2e|e2e_tests|end_to_end|functional)/"), "e2e").when(lower.rlike("/(integration|integration_tests|integrationtests)/") | F.lower(name).contains("integration"), "integration").otherwise("unit")
