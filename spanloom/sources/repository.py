"""Repositories as tables: files with content, ignore rules, commits, unified diffs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions.paths import BY_EXTENSION, LANGUAGES, escapes, language

# Files with ignore rules, directories that are never scanned, and other names of languages.
IGNORE_FILES = (".gitignore", ".ignore")
SKIPPED = (".git", ".hg", ".svn", "node_modules", "target", "__pycache__")
ALIASES = {
    "py": ("python",), "rs": ("rust",), "js": ("javascript",), "node": ("javascript",), "ts": ("typescript", "tsx"), "typescript": ("typescript", "tsx"), "c#": ("csharp",), "cs": ("csharp",), "dotnet": ("csharp",), "dot-net": ("csharp",),
    "sql": ("sql", "postgres", "tsql"), "postgresql": ("postgres",), "psql": ("postgres",), "mssql": ("tsql",), "golang": ("go",), "yml": ("yaml",), "k8s": ("yaml",), "grpc": ("proto",), "protobuf": ("proto",),
}


def language_filter(names: list[str]) -> list[str]:
    """Languages of a list of names, sorted; none for an empty list, an error for an unknown one."""
    out: set[str] = set()
    for name in (n.strip().lower() for n in names if n.strip()):
        if name not in ALIASES and name not in LANGUAGES:
            raise ValueError(f"no such language: {name}")
        out |= set(ALIASES.get(name, (name,)))
    return sorted(out)


def extensions(languages: list[str]) -> list[str]:
    return list(dict.fromkeys(e for name in languages for e in LANGUAGES[name]))


def glob_pattern(glob: str) -> str:
    """A glob as a regular expression: ``*`` and ``?`` stay in a folder, ``**`` does not, ``[..]`` is a class."""
    parts = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    out = []
    for piece in re.findall(r"\*\*/|\*\*|\*|\?|\[!?[^\]]+\]|.", glob):
        if piece in parts:
            out.append(parts[piece])
        elif len(piece) > 1:
            out.append("[^" + piece[2:] if piece[1] == "!" else piece)
        else:
            out.append(re.escape(piece))
    return "".join(out)


def ignored(path: Column, rules: list[str]) -> Column:
    """Whether the last of the ignore rules that fits a path excludes it (``!`` includes again)."""
    out = F.lit(False)
    for rule in (r.strip() for r in rules):
        if not rule or rule.startswith("#"):
            continue
        keep, pattern = rule.startswith("!"), rule.lstrip("!").rstrip("/")
        anchored = pattern.startswith("/") or "/" in pattern
        out = F.when(path.rlike(f"{'^' if anchored else '(^|/)'}(?:{glob_pattern(pattern.lstrip('/'))})(/|$)"), F.lit(not keep)).otherwise(out)
    return out


RULES = "folder string, layer int, nth int, pattern string, keeps boolean, folders_only boolean"


def parsed_rules(lines: list[str]) -> Iterator[tuple[int, str, bool, bool]]:
    """nth, pattern (of a whole path below the file's folder), keeps, folders_only of an ignore file's lines."""
    for nth, line in enumerate(lines):
        rule = line.rstrip()
        if not rule or rule.startswith("#"):
            continue
        keeps, rule = rule.startswith("!"), rule.removeprefix("!")
        folders_only, rule = rule.endswith("/"), rule.rstrip("/")
        if rule:
            yield nth, ("" if "/" in rule else "(?:.*/)?") + glob_pattern(rule.removeprefix("/")), keeps, folders_only


def layered_rules(folders: DataFrame, root: str) -> DataFrame:
    """The rules of all ignore files in ``folders`` (folder, below the root; "" is the root), read where the
    folders are dealt to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as pafs

        fs, base = pafs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")
        for batch in batches:
            rows = []
            for folder in batch.column(0).to_pylist():
                for layer, name in enumerate(IGNORE_FILES):
                    try:
                        with fs.open_input_stream("/".join(filter(None, (base.rstrip("/"), folder, name)))) as file:
                            lines = file.read().decode("utf-8", "replace").splitlines()
                    except FileNotFoundError:
                        continue
                    rows += [(folder, layer, *rule) for rule in parsed_rules(lines)]
            if rows:
                kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["folder", "layer", "nth", "pattern", "keeps", "folders_only"])

    return folders.select("folder").mapInArrow(run, RULES)


def _steps(parts: Column, first: int) -> Column:
    """The beginnings of a path: its folders, from ``first`` names on, and with ``first`` 1 the path itself."""
    return F.transform(F.sequence(F.lit(first), F.size(parts) - 1 + first), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def ignored_paths(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """path of those of ``paths`` (path) that the ignore files above them exclude.

    Rules (``RULES``) meet the paths below their folder by equality. Of the rules that fit, one of the later kind of
    file decides, then one of a deeper folder, then one that fits the path itself or the nearest folder above
    it, then the last one. A rule of a folder does not fit files.
    """
    c = F.col
    asked = paths.select("path").distinct().select("path", F.posexplode(_steps(F.split("path", "/"), 0)).alias("depth", "folder"))
    rest = F.when(c("folder") == "", c("path")).otherwise(F.substr("path", F.length("folder") + 2))
    met = asked.join(rules, "folder").select("path", "depth", "layer", "nth", "pattern", "keeps", "folders_only", rest.alias("rest"))
    tried = met.select("*", F.posexplode(_steps(F.split("rest", "/"), 1)).alias("far", "part"))
    fits = F.rlike("part", F.concat(F.lit("^(?:"), "pattern", F.lit(")$"))) & ~(c("folders_only") & (c("part") == c("rest")))
    return tried.where(fits).groupBy("path").agg(F.max_by("keeps", F.struct("layer", "depth", "far", "nth")).alias("keeps")).where("not keeps").select("path")


def scan_file(spark: SparkSession, root: str, path: str) -> DataFrame:
    """What ``scan`` gives of one file; a path that leaves the tree is an error."""
    if escapes(path):
        raise ValueError(f"outside of the repository: {path}")
    return _scanned(spark.read.format("binaryFile").load(f"{root.rstrip('/')}/{path}"), root.rstrip("/"))


def scan(spark: SparkSession, root: str, rules: list[str] | None = None, languages: list[str] | None = None) -> DataFrame:
    """path, language, size, modified, hash, text of a tree's source files.

    ``rules`` tell what to leave out; by default those of the ignore files in all of the tree's folders do.
    """
    base = root.rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(sorted(BY_EXTENSION)) + "}").load(base)
    rows = _scanned(found, base, rules, languages)
    if rules is not None:
        return rows
    paths = rows.select("path")  # without contents, which are not read for it
    folders = paths.select(F.explode(_steps(F.split("path", "/"), 0)).alias("folder")).distinct()
    return rows.join(ignored_paths(paths, layered_rules(folders, base)), "path", "left_anti")


def _scanned(found: DataFrame, base: str, rules: list[str] | None = None, languages: list[str] | None = None) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*(?=/)", ""), F.lit("^" + _quoted(base)), F.lit(""))
    rows = found.select(path.alias("path"), F.col("length").alias("size"), F.unix_seconds("modificationTime").alias("modified"), "content")
    rows = rows.withColumn("language", language(F.col("path"))).where(F.col("language").isNotNull() & ~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, SKIPPED))))
    if rules:
        rows = rows.where(~ignored(F.col("path"), rules))
    if languages:
        rows = rows.where(F.col("language").isin(*language_filter(languages)))
    return rows.select("path", "language", "size", "modified", F.sha2("content", 256).alias("hash"), F.decode("content", "UTF-8").alias("text"))


def _quoted(base: str) -> str:
    return re.escape(base.split("://", 1)[-1]) + "/"


def commits(log: DataFrame) -> DataFrame:
    """sha, ts, files of a history dump: rows (no, value) with ``commit <sha> <epoch>`` headers and
    ``added<TAB>deleted<TAB>path`` lines."""
    head = r"^commit ([0-9a-f]+) ([0-9]+)$"
    order = Window.orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    marked = log.withColumn("own", F.when(F.col("value").rlike(head), F.regexp_extract("value", head, 1))).withColumn("own_ts", F.when(F.col("own").isNotNull(), F.regexp_extract("value", head, 2).cast("long")))
    carried = marked.withColumn("sha", F.last("own", ignorenulls=True).over(order)).withColumn("ts", F.last("own_ts", ignorenulls=True).over(order))
    changed = carried.where(F.col("own").isNull() & F.col("sha").isNotNull() & F.col("value").rlike(r"^[0-9-]+\t[0-9-]+\t"))
    return changed.groupBy("sha", "ts").agg(F.array_sort(F.collect_set(F.regexp_extract("value", r"^[0-9-]+\t[0-9-]+\t(.*)$", 1))).alias("files"))


def hunks(diffs: DataFrame) -> DataFrame:
    """diff_id, path, hunk_start, hunk_end, kind of the changed ranges of unified diffs (diff_id, text).

    Deleted files have no range; a hunk of no new lines marks the line before it.
    """
    rows = diffs.select("diff_id", F.posexplode(F.split("text", "\n")).alias("no", "value"))
    order = Window.partitionBy("diff_id").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    named = rows.withColumn("path", F.last(F.when(F.col("value").startswith("+++ "), F.regexp_replace(F.regexp_replace("value", r"^\+\+\+ (b/)?", ""), r"\t.*$", "")), ignorenulls=True).over(order))
    head = r"^@@ -[0-9]+(?:,([0-9]+))? \+([0-9]+)(?:,([0-9]+))? @@"
    size = lambda i: F.when(F.regexp_extract("value", head, i) == "", 1).otherwise(F.regexp_extract("value", head, i).cast("long"))
    found = named.where(F.col("value").rlike(head) & F.col("path").isNotNull() & (F.col("path") != "/dev/null"))
    start = F.regexp_extract("value", head, 2).cast("long")
    kind = F.when(size(1) == 0, "added").when(size(3) == 0, "deleted").otherwise("changed")
    return found.select("diff_id", "path", F.greatest(start, F.lit(1)).alias("hunk_start"), F.greatest(start + size(3) - 1, start, F.lit(1)).alias("hunk_end"), kind.alias("kind"))
