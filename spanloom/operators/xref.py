"""References from string literals: routes, and names of symbols of other languages.

``edges`` is the whole of it: literals of source texts, the symbols around them, the symbols of other
languages and the routes that they name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.normalize import route
from spanloom.operators.resolve import enclosing
from spanloom.operators.shared import bounded_batches

# Words that are no reference to a symbol, and lengths of tokens.
STOPWORDS = ("a", "an", "and", "any", "as", "asc", "begin", "between", "by", "case", "create", "delete", "desc", "distinct", "drop", "else", "end", "exists", "false", "from", "full", "group", "having", "if", "in", "inner", "insert", "into", "is", "join", "left", "like", "limit", "not", "null", "offset", "on", "or", "order", "outer", "primary", "return", "right", "select", "set", "then", "true", "union", "update", "values", "when", "where", "with")
LEAST_TOKEN, LEAST_LOWER = 4, 6
# How sure a match by each form of a symbol's key is, what each form of a token costs, the
# least confidence of a match, that of a route, and languages whose literals are not read.
KEY_SCORES = {"qualname": 0.7, "plain": 0.65, "lower": 0.6, "lower_plain": 0.55, "name": 0.55, "lower_name": 0.45}
FORM_COSTS = {"exact": 0.0, "plain": 0.05, "lower": 0.1, "lower_plain": 0.15}
LEAST_XREF, ROUTE_CONFIDENCE = 0.7, 0.85
UNREAD = ("yaml", "bicep")

#: String literals: verbatim, raw, with three quotes, with one.
LITERAL = re.compile(
    r"""(?:@\$?|\$@)"(?P<verbatim>(?:[^"]|"")*+)"(?!")"""
    r"""|b?r(?P<marks>\#*)"(?P<raw>.*?)"(?P=marks)"""
    r"""|(?P<three>\"{3}|'{3})(?P<long>.*?)(?P=three)"""
    r"""|(?P<one>["'`])(?!(?<=")""|(?<=')'')(?P<plain>(?:\\.|(?!(?P=one))[^\\])*+)(?P=one)""",
    re.DOTALL | re.VERBOSE,
)


def literals(text: str) -> Iterator[tuple[int, int, str, bool]]:
    """Place, end, content of each string literal of a text, and whether it has three quotes."""
    for m in LITERAL.finditer(text):
        kind = m.lastgroup if m.lastgroup in ("verbatim", "raw", "long", "plain") else next(k for k in ("verbatim", "raw", "long", "plain") if m[k] is not None)
        yield m.start(kind), m.end(kind), m[kind], kind == "long"


def string_literals(sources: DataFrame) -> DataFrame:
    """path, language, line, end_line, literal, long (three quotes) of all string literals of ``sources``
    (path, language, text)."""
    given = sources.where(F.col("text").isNotNull() & ~F.coalesce("language", F.lit("")).isin(*UNREAD)).select("path", "language", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, language, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, line, at = [], 1, 0
                for start, stop, literal, long in literals(text):
                    line += text.count("\n", at, start)
                    at = start
                    rows.append((path, language, line, line + text.count("\n", start, stop), literal, long))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["path", "language", "line", "end_line", "literal", "long"])

    return bounded_batches(given).mapInArrow(run, "path string, language string, line long, end_line long, literal string, long boolean")


def routes(found: DataFrame) -> DataFrame:
    """source, route, confidence: the distinct routes that literals (source, text) of each source name."""
    named = found.select("source", route(F.col("text")).alias("route")).where("route is not null").distinct()
    return named.withColumn("confidence", F.lit(ROUTE_CONFIDENCE))


def literal_tokens(text: Column) -> Column:
    """Words of a string literal that may name a symbol."""
    words = F.transform(F.regexp_extract_all(text, F.lit("([A-Za-z0-9_.:/$@]+)"), F.lit(1)), lambda w: F.regexp_replace(w, "^[.:/]+|[.:/]+$", ""))
    short = lambda w: ~w.rlike("[./]|::") & (F.lower(w) == w) & (F.length(w) < LEAST_LOWER)
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= LEAST_TOKEN) & w.rlike("[A-Za-z]") & ~F.lower(w).isin(*STOPWORDS) & ~short(w)))


def _plain(name: Column) -> Column:
    return F.replace(F.replace(name, F.lit("::"), F.lit(".")), F.lit("/"), F.lit("."))


def cross_references(asked: DataFrame, symbols: DataFrame) -> DataFrame:
    """source_language, token, id, confidence: the one symbol of another language that a token names.

    ``asked``: language, token. Forms of tokens and keys of symbols meet by equality; a form that is the
    same as a better one is none. A token that names two symbols equally well names none.
    """
    c = F.col
    entry = lambda value, name, number: F.struct(value.alias("key"), F.lit(number).alias(name))
    unless = lambda form, same: F.when(form != same, form)
    token, qualname, name = c("token"), F.trim("qualname"), F.trim("name")
    forms = {"exact": token, "plain": unless(_plain(token), token), "lower": unless(F.lower(token), token), "lower_plain": unless(F.lower(_plain(token)), F.lower(token))}
    keys = {"qualname": qualname, "plain": unless(_plain(qualname), qualname), "lower": unless(F.lower(qualname), qualname), "lower_plain": unless(F.lower(_plain(qualname)), F.lower(qualname)), "name": name, "lower_name": unless(F.lower(name), name)}
    wanted = asked.distinct().select("language", "token", F.inline(F.array(*(entry(v, "cost", FORM_COSTS[k]) for k, v in forms.items())))).where("key is not null").groupBy("language", "token", "key").agg(F.min("cost").alias("cost"))
    known = symbols.select("id", c("language").alias("symbol_language"), F.inline(F.array(*(entry(v, "base", KEY_SCORES[k]) for k, v in keys.items())))).where("key <> ''").groupBy("id", "symbol_language", "key").agg(F.max("base").alias("base"))
    bonus = F.when(token.rlike("[./]|::"), 0.2).otherwise(0.0) + F.when(F.length(token) >= 12, 0.2).when(F.length(token) >= 8, 0.1).otherwise(0.0) + F.when(token.rlike("[a-z]") & token.rlike("[A-Z]"), 0.05).otherwise(0.0)
    scored = wanted.join(known, "key").where(c("language") != c("symbol_language")).groupBy("language", "token", "id").agg(F.max(c("base") - c("cost")).alias("match"))
    scored = scored.withColumn("score", F.round(F.least(c("match") + bonus, F.lit(1.0)), 6)).where(c("score") >= LEAST_XREF)
    top = scored.groupBy("language", "token").agg(F.max(F.struct("score", (-c("id")).alias("id"))).alias("best"), F.max("score").alias("confidence"))
    ties = scored.join(top, ["language", "token"]).where("score = confidence").groupBy("language", "token").agg(F.count(F.lit(1)).alias("n"))
    return top.join(ties.where("n = 1"), ["language", "token"]).select(c("language").alias("source_language"), "token", (-c("best.id")).alias("id"), "confidence")


# Kinds of the edges that come of literals.
XREF, ROUTE = KINDS = ("XREF", "ROUTE")


def owned_literals(sources: DataFrame, symbols: DataFrame) -> DataFrame:
    """file_id, source (the innermost symbol around), language, line, literal, long; literals outside of all
    symbols take no part."""
    found = string_literals(sources).join(symbols.select("path", "file_id").distinct(), "path").withColumn("at", F.col("line"))
    around = enclosing(found.select("file_id", "at").distinct(), symbols, ["file_id", "at"]).select("file_id", "at", F.col("id").alias("source"))
    return found.join(around, ["file_id", "at"]).select("file_id", "source", "language", "line", "literal", "long")


def tokens(owned: DataFrame) -> DataFrame:
    """file_id, source, language, token, line: what owned literals may name, each word of a line once."""
    return owned.select("file_id", "source", "language", F.explode(literal_tokens(F.col("literal"))).alias("token"), "line").distinct()


def by_token(named: DataFrame, symbols: DataFrame) -> DataFrame:
    """XREF edges of tokens. Of several references of one symbol to another the surest counts, of equal ones
    the first line."""
    found = cross_references(named.select("language", "token"), symbols).withColumnRenamed("source_language", "language")
    hit = named.join(found, ["language", "token"]).join(symbols.select("id", F.col("qualname").alias("target_qualname")), "id")
    best = hit.groupBy("file_id", "source", F.col("id").alias("target"), "target_qualname").agg(F.max(F.struct("confidence", (-F.col("line")).alias("line"))).alias("b"))
    return best.select(F.lit(XREF).alias("kind"), "file_id", "source", "target", "target_qualname", (-F.col("b.line")).alias("line"), F.col("b.confidence").alias("confidence"))


def by_route(owned: DataFrame) -> DataFrame:
    """ROUTE edges of owned literals, from the first line that has a route."""
    paths = owned.where("not long").select("file_id", "source", "line", route(F.col("literal")).alias("target_qualname")).where("target_qualname is not null").groupBy("file_id", "source", "target_qualname").agg(F.min("line").alias("line"))
    return paths.select(F.lit(ROUTE).alias("kind"), "file_id", "source", F.lit(None).cast("long").alias("target"), "target_qualname", "line", F.lit(ROUTE_CONFIDENCE).alias("confidence"))


def naming(named: DataFrame, moved: DataFrame) -> DataFrame:
    """The rows of ``named`` (token) of which one of the forms is a key of a symbol of ``moved`` (qualname, name)."""
    folded = lambda name: F.lower(_plain(F.trim(name)))  # noqa: E731  all forms and keys of one spelling
    keys = moved.select(F.explode(F.array(folded(F.col("qualname")), folded(F.col("name")))).alias("folded")).distinct()
    return named.withColumn("folded", folded(F.col("token"))).join(keys, "folded", "left_semi").select(*named.columns)


def edges(sources: DataFrame, symbols: DataFrame) -> DataFrame:
    """kind (XREF or ROUTE), file_id, source, target, target_qualname, line, confidence: what literals refer to."""
    owned = owned_literals(sources, symbols)
    return by_token(tokens(owned), symbols).union(by_route(owned))
