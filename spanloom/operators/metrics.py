"""Line measures of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.search import lines

#: Lines of a stretch. What a stretch leaves open is handed on, so a long file is no single task's.
STRETCH = 4_096

# Signs of line comments and block comments by language.
LINE_SIGNS = {"python": "#", "yaml": "#", "sql": "--", "postgres": "--", "tsql": "--"}
BLOCK_SIGNS = {"sql": ("/*", "*/"), "postgres": ("/*", "*/"), "tsql": ("/*", "*/"), "rust": ("/*", "*/"), "javascript": ("/*", "*/"), "typescript": ("/*", "*/"), "tsx": ("/*", "*/"), "csharp": ("/*", "*/"), "go": ("/*", "*/")}


def line_counts(sources: DataFrame, language: str = "python") -> DataFrame:
    """path, loc, blank, comment, code of each file.

    A block comment is open on a line if more have begun than ended on the lines before: a running sum.
    """
    sign = LINE_SIGNS.get(language, "//")
    rows = lines(sources).withColumn("t", F.trim("content"))
    if language in BLOCK_SIGNS:
        begin, end = BLOCK_SIGNS[language]
        turn = F.when(F.col("t").contains(begin) & ~F.col("t").contains(end), 1).when(F.col("t").contains(end) & ~F.col("t").contains(begin), -1).otherwise(0)
        before = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("inside", F.coalesce(F.sum(turn).over(before), F.lit(0)) > 0)
        comment = F.col("inside") | F.col("t").startswith(sign) | F.col("t").startswith(begin)
    else:
        comment = F.col("t").startswith(sign)
    blank = F.col("t") == ""
    return rows.groupBy("path").agg(F.count(F.lit(1)).alias("loc"), F.count_if(blank).alias("blank"), F.count_if(comment & ~blank).alias("comment"), F.count_if(~comment & ~blank).alias("code"))


def file_metrics(sources: DataFrame) -> DataFrame:
    """path, loc, blank, comment, code of files (path, language, text) of all languages.

    What a line does to the state (in a block comment or not) is a small function. There are three: it opens
    a comment whatever was before, it closes one, or it leaves things as they are. So what holds before a line
    is what the last line that does anything did, and that composes: first within stretches of lines, then
    over stretches. An empty file counts as one line.
    """
    c = F.col
    of = lambda signs: F.try_element_at(F.create_map(*(F.lit(x) for kv in signs.items() for x in kv)), c("language"))
    begins, ends = ({k: v[i] for k, v in BLOCK_SIGNS.items()} for i in (0, 1))
    sign = F.coalesce(of(LINE_SIGNS), F.when(c("language").isin(*BLOCK_SIGNS), "//"))
    signs = sources.select("path", sign.alias("sign"), of(begins).alias("begin"), of(ends).alias("end"))
    rows = lines(sources).join(signs, "path").withColumn("t", F.regexp_replace("content", r"^\s+|\s+$", ""))
    no = F.lit(False)
    by_line = F.coalesce(F.startswith("t", "sign"), no)
    by_block = F.coalesce(F.startswith("t", "begin"), no) & ~by_line
    closes = F.coalesce(F.contains("t", "end"), no)
    does = F.when(closes, False).when(by_block, True)
    marked = rows.select("path", "line", F.expr(f"line div {STRETCH}").alias("stretch"), (c("t") == "").alias("blank"), by_line.alias("by_line"), by_block.alias("by_block"), does.alias("does"))
    left = marked.where("does is not null").groupBy("path", "stretch").agg(F.max_by("does", "line").alias("left"))
    all_ = marked.select("path", "stretch").distinct().join(left, ["path", "stretch"], "left")
    handed = all_.withColumn("handed", F.last("left", ignorenulls=True).over(Window.partitionBy("path").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1))).drop("left")
    inside = F.last("does", ignorenulls=True).over(Window.partitionBy("path", "stretch").orderBy("line").rowsBetween(Window.unboundedPreceding, -1))
    known = marked.withColumn("inside", inside).join(handed, ["path", "stretch"]).withColumn("open", F.coalesce("inside", "handed", no))
    comment = ~c("blank") & (c("open") | c("by_line") | c("by_block"))
    counted = known.groupBy("path").agg(F.count(F.lit(1)).alias("loc"), F.count_if("blank").alias("blank"), F.count_if(comment).alias("comment"), F.count_if(~c("blank") & ~comment).alias("code"))
    return counted
