"""Text search over lines: exact, regex with context, ranked and fuzzy; token cross-references."""

from __future__ import annotations

import re
from functools import reduce
from re import _constants, _parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.paths import path_bonus
from spanloom.functions.text import line_tokens, similarity
from spanloom.functions.text import words as plain_words
from spanloom.operators.shared import cut

# What hits score, how many are ranked for each one shown, and the length of a lone token.
EXACT_SCORE, FUZZY_WEIGHT = 10.0, 1.5
FETCH_TIMES, FETCH_CAP = 4, 500
LEAST_TOKEN = 4

def _cut(text: Column) -> Column:
    return F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\n$", ""), "\n")


def lines(sources: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """path, line (from 1), content of every line; a last empty line is none."""
    return sources.select(F.col(path).alias("path"), F.posexplode(_cut(F.col(text))).alias("at", "content")).select("path", (F.col("at") + 1).cast("long").alias("line"), "content")


def exact(rows: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """path, line, col, content of the first place of the query in each line."""
    found = rows.where(F.instr("content", query) > 0).select("path", "line", F.instr("content", query).cast("long").alias("col"), "content")
    return found if limit is None else found.orderBy("path", "line").limit(limit)


def regex(sources: DataFrame, pattern: str, context: int = 0) -> DataFrame:
    """path, line, content, before, after of the lines that match, with lines around them.

    ``sources``: path, text. Only lines that match leave a text, with their neighbours, so nothing is shuffled.
    """
    if not pattern or len(pattern.encode()) > 10_000:
        raise ValueError("a pattern of 1 to 10000 bytes is needed")
    rows = sources.select("path", _cut(F.col("text")).alias("rows"))
    at = F.filter(F.sequence(F.lit(1), F.size("rows")), lambda i: F.element_at("rows", i).rlike(pattern))
    first = lambda i: F.greatest(i - context, F.lit(1))
    joined = lambda start, n: F.array_join(F.slice("rows", start, n), "\n")
    around = (lambda i: (joined(first(i), i - first(i)), joined(i + 1, F.lit(context)))) if context else (lambda i: (F.lit(""), F.lit("")))
    shown = F.transform(at, lambda i: F.struct(i.cast("long").alias("line"), F.element_at("rows", i).alias("content"), around(i)[0].alias("before"), around(i)[1].alias("after")))
    return rows.select("path", F.inline(shown))


GRAM = 3


def gram_index(sources: DataFrame) -> DataFrame:
    """gram, path: the trigrams of each text of ``sources`` (path, text), each once."""
    grams = F.regexp_extract_all("text", F.lit(f"(?s)(?=(.{{{GRAM}}}))."), F.lit(1))  # one pass: a substring is counted from a text's beginning
    return sources.where(F.length("text") >= GRAM).select(F.explode(F.array_distinct(grams)).alias("gram"), "path")


def refreshed_index(index: DataFrame, away: DataFrame, sources: DataFrame) -> DataFrame:
    """An index after a change: without the paths of ``away`` (path), and with what ``sources`` have now."""
    return index.join(away.select("path").distinct(), "path", "left_anti").select("gram", "path").union(gram_index(sources))


def _grams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + GRAM] for i in range(len(text) - GRAM + 1))


def required_grams(pattern: str) -> list[list[frozenset[str]]]:
    """What a text must have for a regular expression to match: of each list, all trigrams of one set.

    They come of the plain characters of the expression. Where nothing can be told (other flags, an expression
    that only Java reads, no three characters in a row) the list is empty: every text may match.
    """
    try:
        parsed = _parser.parse(pattern)
    except (re.error, OverflowError):
        return []
    if parsed.state.flags & ~re.UNICODE:
        return []

    def clauses(items) -> list[list[frozenset[str]]]:
        found, run = [], ""
        for kind, value in [*items, (None, None)]:
            if kind is _constants.LITERAL:
                run += chr(value)
                continue
            if kind is _constants.SUBPATTERN and (value[1] or value[2]):
                return []
            if grams := _grams(run):
                found.append([grams])
            run = ""
            if kind is _constants.SUBPATTERN:
                found += clauses(value[3])
            elif kind in (_constants.MAX_REPEAT, _constants.MIN_REPEAT) and value[0] > 0:
                found += clauses(value[2])
            elif kind is _constants.BRANCH:
                ways = [frozenset().union(*(c[0] for c in clauses(way) if len(c) == 1)) for way in value[1]]
                if all(ways):
                    found.append(ways)
        return found

    return clauses(parsed)


def candidates(index: DataFrame, pattern: str) -> DataFrame | None:
    """path of the texts that have what a regular expression requires; None where that is nothing."""
    required = required_grams(pattern)
    if not required:
        return None
    asked = sorted({g for ways in required for grams in ways for g in grams})
    have = index.where(F.col("gram").isin(*asked)).groupBy("path").agg(F.collect_set("gram").alias("have"))
    holds = lambda grams: F.size(F.array_intersect("have", F.array(*map(F.lit, sorted(grams))))) == len(grams)
    return have.where(reduce(Column.__and__, (reduce(Column.__or__, map(holds, ways)) for ways in required))).select("path")


def indexed_regex(index: DataFrame, sources: DataFrame, pattern: str, context: int = 0) -> DataFrame:
    """What ``regex`` finds, in the texts alone that the index does not rule out."""
    some = candidates(index, pattern)
    return regex(sources if some is None else sources.join(some, "path", "left_semi"), pattern, context)


def query_tokens(spark: SparkSession, query: str) -> list[str]:
    """The distinct tokens of a query, in order; none if they do not suffice for a fuzzy search."""
    found = spark.range(1).select(F.array_distinct(line_tokens(F.lit(query))).alias("t")).first()["t"]
    return found if len(found) > 1 or found and len(found[0]) >= LEAST_TOKEN else []


def fuzzy(rows: DataFrame, tokens: list[str]) -> DataFrame:
    """path, score, line of files in which a line comes close to each token.

    Similarities are taken once for each distinct word, and the few that are similar to a token are
    joined back to the lines. Best similarities are taken per line and token first, then per file: two
    aggregations with map-side combination, whatever a file's length. Files must reach a token's least
    score for every token; near lines and many lines add to the score. The line reported has the largest
    sum, the first of equals.
    """
    if not tokens:
        raise ValueError("a token is needed")
    base = 0.45 if len(tokens) > 1 else 0.6
    asked = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(t).alias("token"), F.lit(base + (0.1 if len(t) <= 3 else 0.0)).alias("least")) for i, t in enumerate(tokens)))
    words = rows.select("path", "line", F.explode(plain_words(F.col("content"))).alias("word"))
    forms = words.select("word").distinct().select("word", F.explode(line_tokens(F.col("word"))).alias("form"))
    close = forms.select("word", "form", F.inline(asked)).withColumn("s", similarity(F.col("token"), F.col("form"))).where("s > 0")
    near = cut(close.groupBy("word", "i", "least").agg(F.max("s").alias("s")))
    per_line = words.join(near, "word").groupBy("path", "line", "i", "least").agg(F.max("s").alias("s"))
    per_token = per_line.groupBy("path", "i", "least").agg(F.max("s").alias("best"), F.max(F.struct("s", (-F.col("line")).alias("l"))).alias("where")).where("best >= least - 1e-9")
    per_file = per_token.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.sum("best").alias("total"), (F.max("where.l") - F.min("where.l")).alias("span")).where(F.col("n") == len(tokens))
    sums = per_line.groupBy("path", "line").agg(F.sum("s").alias("sum")).groupBy("path").agg(F.count(F.lit(1)).alias("hits"), F.max(F.struct(F.round("sum", 9).alias("s"), (-F.col("line")).alias("l"))).alias("top"))
    close_by = F.when(F.lit(len(tokens) < 2), 0.0).when(F.col("span") == 0, 2.0).when(F.col("span") <= 3, 1.0).when(F.col("span") <= 10, 0.5).otherwise(0.0)
    score = F.col("total") + close_by + F.least(F.col("hits") * 0.1, F.lit(1.0))
    return per_file.join(sums, "path").select("path", F.round(score, 6).alias("score"), (-F.col("top.l")).alias("line"))


def fetch_limit(limit: int) -> int:
    """How many hits are ranked to find the best ``limit``."""
    return min(FETCH_CAP, max(limit, FETCH_TIMES * limit))


def merged(hits: DataFrame, loose: DataFrame) -> DataFrame:
    """Hits (path, line, score, engine) and those of ``loose`` at other places."""
    return hits.union(loose.join(hits.select("path", "line"), ["path", "line"], "left_anti"))


def ranked(rows: DataFrame, query: str, limit: int) -> DataFrame:
    """path, line, score, engine: exact hits and, where they are too few or none is in code, fuzzy hits
    of other lines, best first. A query with a path or address in it is searched exactly alone."""
    best = [F.desc("score"), "path", "line"]
    most = fetch_limit(limit)
    score = lambda c: F.round(c + path_bonus(F.col("path")), 6).alias("score")
    hits = cut(exact(rows, query).select("path", "line", score(F.lit(EXACT_SCORE)), F.lit("exact").alias("engine")).orderBy(*best).limit(most))
    literal = any(sign in query for sign in ("/", "\\"))
    if not literal and (hits.limit(limit).count() < limit or hits.where(F.col("score") >= EXACT_SCORE).isEmpty()):
        if tokens := query_tokens(rows.sparkSession, query):
            loose = fuzzy(rows, tokens).orderBy(F.desc("score"), "path").limit(most)
            hits = merged(hits, loose.select("path", "line", score(F.col("score") * FUZZY_WEIGHT), F.lit("fuzzy").alias("engine")))
    return hits.orderBy(*best).limit(limit)
