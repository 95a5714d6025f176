"""Queries over source text, names, routes and event streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import names, normalize, paths, text
from spanloom.operators import budget, search, snapshot, xref
from spanloom.plans.model import PREFIX, as_of, graph, read
from spanloom.streaming import watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(run: Callable[[SparkSession, str], DataFrame]) -> Callable:
        if name in QUERIES:
            raise ValueError(f"two queries have the name {name}")
        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return run

    return add


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as source files."""
    folder = F.when(F.col("doc_id") % 7 == 0, "docs/").when(F.col("doc_id") % 7 == 1, "src/").when(F.col("doc_id") % 7 == 2, "tests/").otherwise("")
    return read(spark, sf_dir, "documents").select("doc_id", F.concat(folder, "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), "text")


SOURCES = "WITH sources AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'docs/' WHEN 1 THEN 'src/' WHEN 2 THEN 'tests/' ELSE '' END || source || '/' || doc_id || '.py' AS path, text FROM documents), lines AS (SELECT path, i AS line, string_split(t, chr(10))[i] AS content FROM (SELECT path, regexp_replace(text, '\\n$', '') AS t, unnest(range(1, len(string_split(regexp_replace(text, '\\n$', ''), chr(10))) + 1)) AS i FROM sources))"
BONUS = "CASE WHEN path LIKE 'docs/%' THEN -2.0 WHEN path LIKE 'tests/%' THEN -1.5 WHEN path LIKE 'src/%' THEN 1.5 ELSE 0.0 END"


@query("text_search_exact", SOURCES + " SELECT path, line, CAST(instr(content, 'tion') AS BIGINT) AS col FROM lines WHERE contains(content, 'tion')")
def _(spark: SparkSession, d: str) -> DataFrame:
    return search.exact(search.lines(sources(spark, d)), "tion").select("path", "line", "col")


@query("regex_search", SOURCES + ", c AS (SELECT path, line, content, coalesce(lag(content) OVER w, '') AS before, coalesce(lead(content) OVER w, '') AS after FROM lines WINDOW w AS (PARTITION BY path ORDER BY line)) SELECT path, line, md5(content) AS content_md5, md5(before) AS before_md5, md5(after) AS after_md5 FROM c WHERE regexp_matches(content, '(ing|tion) the ')")
def _(spark: SparkSession, d: str) -> DataFrame:
    found = search.regex(sources(spark, d), "(ing|tion) the ", context=1)
    return found.select("path", "line", F.md5("content").alias("content_md5"), F.md5("before").alias("before_md5"), F.md5("after").alias("after_md5"))


@query("indexed_regex_search", SOURCES + " SELECT path, line, md5(content) AS content_md5 FROM lines WHERE regexp_matches(content, '(anre+d|hest[a-z]+) [a-m]')")
def _(spark: SparkSession, d: str) -> DataFrame:
    texts = sources(spark, d)
    return search.indexed_regex(search.gram_index(texts), texts, "(anre+d|hest[a-z]+) [a-m]").select("path", "line", F.md5("content").alias("content_md5"))


@query("scope_filter", SOURCES + f" SELECT path, NOT (path LIKE 'docs/%' OR path LIKE 'tests/%') AS code, path LIKE 'docs/%' AS docs, path LIKE 'tests/%' AS tests, CAST({BONUS} AS DOUBLE) AS bonus FROM sources")
def _(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("path")
    return sources(spark, d).select("path", paths.in_scope(p, "code").alias("code"), paths.in_scope(p, "docs").alias("docs"), paths.in_scope(p, "tests").alias("tests"), paths.path_bonus(p).alias("bonus"))


SPLIT = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(w, '([a-z])([A-Z])', '\\1_\\2', 'g'), '([0-9])([A-Za-z])', '\\1_\\2', 'g'), '([A-Za-z])([0-9])', '\\1_\\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1_\\2', 'g')"
STEM = "CASE WHEN length(t) > 5 AND regexp_matches(t, '(ing|ers)$') THEN left(t, length(t) - 3) WHEN length(t) > 4 AND regexp_matches(t, '(er|ed|es)$') THEN left(t, length(t) - 2) WHEN length(t) > 3 AND regexp_matches(t, '[^s]s$') THEN left(t, length(t) - 1) ELSE t END"


@query("tokenize", "SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z0-9_-]+')) AS INTEGER) AS words, CAST(list_sum([length(w) FOR w IN regexp_extract_all(text, '[A-Za-z0-9_-]+')]) AS BIGINT) AS letters FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    found = text.words(F.col("text"))
    return read(spark, d, "documents").select("doc_id", F.size(found).alias("words"), F.when(F.size(found) > 0, F.aggregate(found, F.lit(0).cast("long"), lambda a, w: a + F.length(w))).alias("letters"))




@query("identifier_split", f"SELECT w, array_to_string([x FOR x IN regexp_split_to_array({SPLIT}, '[_-]') IF x <> ''], ' ') AS parts FROM (SELECT DISTINCT split_part(p_name, ' ', 1) || upper(left(split_part(p_name, ' ', 2), 1)) || substr(split_part(p_name, ' ', 2), 2) || p_size || '_' || p_type || 'Key' AS w FROM part)")
def _(spark: SparkSession, d: str) -> DataFrame:
    second = F.split_part("p_name", F.lit(" "), F.lit(2))
    word = F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.upper(F.left(second, F.lit(1))), F.substring(second, 2, 1 << 30), F.col("p_size").cast("string"), F.lit("_"), "p_type", F.lit("Key"))
    return read(spark, d, "part").select(word.alias("w")).distinct().select("w", F.array_join(text.identifier_parts(F.col("w")), " ").alias("parts"))


@query("stem", f"SELECT DISTINCT t, {STEM} AS s FROM (SELECT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS t FROM documents)")
def _(spark: SparkSession, d: str) -> DataFrame:
    words = read(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1))).alias("w")).select(F.lower("w").alias("t")).distinct()
    return words.select("t", text.stem(F.col("t")).alias("s"))


SIMILAR = "CASE WHEN q = t THEN 1.0 WHEN starts_with(t, q) OR starts_with(q, t) THEN 0.9 WHEN contains(t, q) OR contains(q, t) THEN 0.8 WHEN least(length(q), length(t)) BETWEEN 2 AND 3 AND greatest(length(q), length(t)) >= least(length(q), length(t)) + 3 AND regexp_matches(CASE WHEN length(q) <= length(t) THEN t ELSE q END, regexp_replace(CASE WHEN length(q) <= length(t) THEN q ELSE t END, '(.)', '\\1.*', 'g')) THEN 0.6 WHEN 1 - CAST(levenshtein(q, t) AS DOUBLE) / greatest(length(q), length(t)) >= 0.65 THEN 1 - CAST(levenshtein(q, t) AS DOUBLE) / greatest(length(q), length(t)) ELSE 0.0 END"


@query("token_similarity", f"SELECT q, t, round(CAST({SIMILAR} AS DOUBLE), 6) AS score FROM (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS t FROM benchmark), (SELECT unnest(['ther', 'tion', 'ing', 'th', 'onen']) AS q)")
def _(spark: SparkSession, d: str) -> DataFrame:
    words = read(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1))).alias("w")).select(F.lower("w").alias("t")).distinct()
    asked = words.select("t", F.explode(F.array(*map(F.lit, ("ther", "tion", "ing", "th", "onen")))).alias("q"))
    return asked.select("q", "t", F.round(text.similarity(F.col("q"), F.col("t")), 6).alias("score"))


def fuzzy_sql(tokens: list[str]) -> str:
    """The table fuzz (path, score, line) over lines."""
    least = "0.45" if len(tokens) > 1 else "0.6"
    return f"""w AS (SELECT path, line, unnest(regexp_extract_all(content, '[A-Za-z0-9_-]+')) AS w FROM lines
), parts AS (SELECT path, line, unnest(list_concat([w], [x FOR x IN regexp_split_to_array({SPLIT}, '[_-]') IF x <> ''])) AS r FROM w
), plain AS (SELECT path, line, lower(regexp_replace(r, '[^A-Za-z0-9]', '', 'g')) AS t FROM parts
), tokens AS (SELECT DISTINCT path, line, {STEM} AS t FROM plain WHERE length(t) >= 2 AND regexp_matches(t, '[a-z]')
), known AS (SELECT q, t, CAST({SIMILAR} AS DOUBLE) AS s FROM (SELECT DISTINCT t FROM tokens), (SELECT unnest({tokens}) AS q)
), near AS (SELECT path, line, q, s FROM tokens JOIN known USING (t)
), per_line AS (SELECT path, line, q, max(s) AS s FROM near WHERE s > 0 GROUP BY ALL
), per_token AS (SELECT path, q, max(s) AS best, max(struct_pack(s := s, l := -line)) AS place FROM per_line GROUP BY ALL HAVING max(s) >= {least} + CASE WHEN length(q) <= 3 THEN 0.1 ELSE 0 END - 1e-9
), per_file AS (SELECT path, sum(best) AS total, max(place.l) - min(place.l) AS span FROM per_token GROUP BY path HAVING count(*) = {len(tokens)}
), sums AS (SELECT path, count(*) AS hits, max(struct_pack(s := round(s, 9), l := -line)) AS top FROM (SELECT path, line, sum(s) AS s FROM per_line GROUP BY ALL) GROUP BY path
), fuzz AS (SELECT path, round(total + {"CASE WHEN span = 0 THEN 2.0 WHEN span <= 3 THEN 1.0 WHEN span <= 10 THEN 0.5 ELSE 0.0 END" if len(tokens) > 1 else "0.0"} + least(hits * CAST(0.1 AS DOUBLE), 1.0), 6) AS score, -top.l AS line FROM per_file JOIN sums USING (path))"""


@query("text_search_fuzzy", f"{SOURCES}, {fuzzy_sql(['heedthe', 'erinand'])} SELECT * FROM fuzz")
def _(spark: SparkSession, d: str) -> DataFrame:
    return search.fuzzy(search.lines(sources(spark, d)), ["heedthe", "erinand"])


def ranked_sql(query_text: str, limit: int) -> str:
    most = search.fetch_limit(limit)
    return f"""best AS (SELECT path, line, round(10.0 + {BONUS}, 6) AS score, 'exact' AS engine FROM lines WHERE contains(content, '{query_text}') ORDER BY score DESC, path, line LIMIT {most}
), loose AS (SELECT path, line, round(score * CAST(1.5 AS DOUBLE) + {BONUS}, 6) AS score, 'fuzzy' AS engine FROM (SELECT * FROM fuzz ORDER BY score DESC, path LIMIT {most})
), merged AS (SELECT * FROM best UNION ALL SELECT * FROM loose WHERE (path, line) NOT IN (SELECT path, line FROM best))"""


@query("text_search_ranked", f"{SOURCES}, {fuzzy_sql(['anre', 'hestwh'])}, {ranked_sql('anreed hestwh', 400)} SELECT path, line, score, engine FROM merged ORDER BY score DESC, path, line LIMIT 400")
def _(spark: SparkSession, d: str) -> DataFrame:
    return search.ranked(search.lines(sources(spark, d)), "anreed hestwh", 400)


@query("over_fetch_topk", SOURCES + f" SELECT path, line, round(10.0 + {BONUS}, 6) AS score, 'exact' AS engine FROM lines WHERE contains(content, 'nd the e') ORDER BY score DESC, path, line LIMIT 10")
def _(spark: SparkSession, d: str) -> DataFrame:
    return search.ranked(search.lines(sources(spark, d)), "nd the e", 10)


PLAIN = "replace(replace({}, '::', '.'), '/', '.')"
XREF = f"""{PREFIX}, tokens AS (
  SELECT DISTINCT language, token FROM (SELECT 'html' AS language, unnest([regexp_replace(w, '^[.:/]+|[.:/]+$', '', 'g') FOR w IN regexp_extract_all(lit, '[A-Za-z0-9_.:/$@]+')]) AS token FROM (SELECT unnest(regexp_extract_all(html, '"([^"]*)"', 1)) AS lit FROM pages))
  WHERE length(token) >= 4 AND regexp_matches(token, '[A-Za-z]') AND lower(token) NOT IN {xref.STOPWORDS} AND NOT (NOT regexp_matches(token, '[./]|::') AND lower(token) = token AND length(token) < 6)
  UNION SELECT 'script', 'orders.o.order_' || l_orderkey FROM lineitem UNION SELECT 'script', upper(replace(p_brand, '#', '')) || '/Part_' || (p_partkey // 3) FROM part
), forms AS (
  SELECT language, token, token AS key, 0.0 AS cost FROM tokens UNION ALL SELECT language, token, {PLAIN.format("token")}, 0.05 FROM tokens WHERE {PLAIN.format("token")} <> token
  UNION ALL SELECT language, token, lower(token), 0.1 FROM tokens WHERE lower(token) <> token UNION ALL SELECT language, token, lower({PLAIN.format("token")}), 0.15 FROM tokens WHERE lower({PLAIN.format("token")}) <> lower(token)
), keys AS (
  SELECT id, language, qualname AS key, 0.7 AS base FROM s UNION ALL SELECT id, language, {PLAIN.format("qualname")}, 0.65 FROM s WHERE {PLAIN.format("qualname")} <> qualname
  UNION ALL SELECT id, language, lower(qualname), 0.6 FROM s WHERE lower(qualname) <> qualname UNION ALL SELECT id, language, lower({PLAIN.format("qualname")}), 0.55 FROM s WHERE lower({PLAIN.format("qualname")}) <> lower(qualname)
  UNION ALL SELECT id, language, name, 0.55 FROM s UNION ALL SELECT id, language, lower(name), 0.45 FROM s WHERE lower(name) <> name
), scored AS (
  SELECT f.language, token, id, round(CAST(least(1.0, max(base - cost) + CASE WHEN regexp_matches(token, '[./]|::') THEN 0.2 ELSE 0 END + CASE WHEN length(token) >= 12 THEN 0.2 WHEN length(token) >= 8 THEN 0.1 ELSE 0 END + CASE WHEN regexp_matches(token, '[a-z]') AND regexp_matches(token, '[A-Z]') THEN 0.05 ELSE 0 END) AS DOUBLE), 6) AS score
  FROM forms f JOIN keys k USING (key) WHERE f.language <> k.language GROUP BY f.language, token, id
), top AS (SELECT *, max(score) OVER (PARTITION BY language, token) AS best FROM scored WHERE score >= 0.7)
SELECT language AS source_language, token, min(id) AS id, any_value(score) AS confidence FROM top WHERE score = best GROUP BY language, token HAVING count(*) = 1"""


@query("token_cross_references", XREF)
def _(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    quoted = F.explode(F.regexp_extract_all("html", F.lit('"([^"]*)"'), F.lit(1))).alias("literal")
    literals = read(spark, d, "pages").select(quoted).select(F.lit("html").alias("language"), F.explode(xref.literal_tokens(F.col("literal"))).alias("token"))
    called = read(spark, d, "lineitem").select(F.lit("script").alias("language"), F.concat(F.lit("orders.o.order_"), F.col("l_orderkey").cast("string")).alias("token"))
    named = read(spark, d, "part").select(F.lit("script").alias("language"), F.concat(F.upper(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit("/Part_"), F.expr("p_partkey div 3").cast("string")).alias("token"))
    return xref.cross_references(literals.union(called).union(named), as_of(g.symbols, g.files))


# names and normal forms

@query("route_normalize", "SELECT page_id, lower('/' || array_to_string([CASE WHEN regexp_matches(p, '^[0-9]+$') THEN '{}' ELSE p END FOR p IN string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^https?://[^/]*', ''), '[?#].*$', ''), '/+', '/', 'g'), '(.)/$', '\\1'), '^/', ''), '/')], '/')) AS route FROM pages")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", normalize.route(F.col("url")).alias("route"))


ROUTE = """lower('/' || array_to_string([CASE WHEN regexp_matches(x, '^[:{<$]|[$][{]|[*]|^[0-9]+$') OR (regexp_matches(x, '^[0-9A-Fa-f-]+$') AND contains(x, '-') AND length(replace(x, '-', '')) >= 16) THEN '{}' ELSE x END
  FOR x IN string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(h), '[?#].*$', ''), '/+', '/', 'g'), '(.)/$', '\\1'), '^/', ''), '/')], '/'))"""


@query("href_routes", f"SELECT DISTINCT page_id AS source, {ROUTE} AS route, CAST(0.85 AS DOUBLE) AS confidence FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"(/[^\"]*)\"', 1)) AS h FROM pages) WHERE strlen(trim(h)) <= 200 AND NOT regexp_matches(trim(h), '[\\s\\\\]') AND regexp_matches({ROUTE}, '[a-z]')")
def _(spark: SparkSession, d: str) -> DataFrame:
    links = read(spark, d, "pages").select(F.col("page_id").alias("source"), F.explode(F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), F.lit(1))).alias("text"))
    return xref.routes(links)


@query("channel_normalize", "SELECT DISTINCT raw, CASE WHEN replace(n, '_', '') <> '' THEN 'channel://' || lower(replace(n, '_', '')) END AS channel FROM (SELECT raw, regexp_replace(raw, '^(Topics|EventTypes)[.]', '') AS n FROM (SELECT CASE event_type WHEN 'click' THEN 'Topics.' WHEN 'view' THEN 'EventTypes.' WHEN 'error' THEN 'other.' ELSE '' END || upper(event_type) || '_' || (user_id % 20) AS raw FROM events))")
def _(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "Topics.").when(F.col("event_type") == "view", "EventTypes.").when(F.col("event_type") == "error", "other.").otherwise("")
    raw = read(spark, d, "events").select(F.concat(kind, F.upper("event_type"), F.lit("_"), (F.col("user_id") % 20).cast("string")).alias("raw")).distinct()
    return raw.select("raw", normalize.channel(F.col("raw")).alias("channel"))


@query("env_normalize", "SELECT DISTINCT c_mktsegment AS raw, 'env://' || upper(trim(c_mktsegment)) AS env, 'secret://' || lower(trim(c_mktsegment)) AS secret FROM customer")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").select(F.col("c_mktsegment").alias("raw")).distinct().select("raw", normalize.env(F.col("raw")).alias("env"), normalize.secret(F.col("raw")).alias("secret"))


WORDS = ("get", '"post"', "GET", "all", "Any", "fetch", "DELETE", "put", "options")
METHODS = "('GET','POST','PUT','PATCH','DELETE','OPTIONS','HEAD')"


@query("http_method_normalize", f"SELECT DISTINCT raw, CASE WHEN u IN ('ALL', 'ANY') THEN 'ANY' WHEN u IN {METHODS} THEN u WHEN regexp_replace(u, '(.)ASYNC$', '\\1') IN {METHODS} THEN regexp_replace(u, '(.)ASYNC$', '\\1') END AS method FROM (SELECT raw, upper(trim(raw, '\"')) AS u FROM (SELECT {list(WORDS)}[event_id % 9 + 1] || CASE user_id % 3 WHEN 0 THEN 'Async' ELSE '' END AS raw FROM events))")
def _(spark: SparkSession, d: str) -> DataFrame:
    word = F.element_at(F.array(*map(F.lit, WORDS)), (F.col("event_id") % 9 + 1).cast("int"))
    raw = read(spark, d, "events").select(F.concat(word, F.when(F.col("user_id") % 3 == 0, "Async").otherwise("")).alias("raw")).distinct()
    return raw.select("raw", normalize.http_method(F.col("raw")).alias("method"))


@query("json_detail", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '{\"kind\":\"' || event_type || '\",\"user\":' || user_id || '}' AS detail FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    detail = F.to_json(F.struct(F.col("event_type").alias("kind"), F.col("user_id").alias("user")))
    return read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), detail.alias("detail"))


@query("line_metrics", SOURCES + " SELECT path, count(*) AS loc, count(*) FILTER (trim(content) = '') AS blank, count(*) FILTER (starts_with(trim(content), '#')) AS comment, count(*) FILTER (trim(content) <> '' AND NOT starts_with(trim(content), '#')) AS code FROM lines GROUP BY path")
def _(spark: SparkSession, d: str) -> DataFrame:
    from spanloom.operators import metrics

    return metrics.line_counts(sources(spark, d))


@query("complexity", "SELECT doc_id, 1 + len(regexp_extract_all(' ' || regexp_replace(text, '[^\\pL\\pN_]+', '  ', 'g') || ' ', ' (if|elif|for|while|except|case|and|or|with) ')) AS complexity FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", text.complexity(F.col("text"), F.lit("python")).alias("complexity"))


@query("dup_hash", "SELECT doc_id, CASE WHEN regexp_replace(text, '\\s', '', 'g') <> '' THEN md5(regexp_replace(text, '\\s', '', 'g')) END AS hash FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", text.duplication_hash(F.col("text")).alias("hash"))


@query("stable_id", PREFIX + " SELECT id, 'sym_' || left(sha256(qualname || chr(0) || coalesce(signature, '') || chr(0) || kind), 16) AS stable_id FROM s")
def _(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    return as_of(g.symbols, g.files).select("id", names.stable_id(F.col("qualname"), F.col("signature"), F.col("kind")).alias("stable_id"))


@query("trailing_names", PREFIX + " SELECT id, regexp_extract(qualname, '([^.:]*)$', 1) AS trailing, array_to_string(list_slice(string_split(qualname, '.'), -2, -1), '.') AS short, split_part(path, '/', 1) AS top, split_part(path, '/', 1) || '/' || split_part(path, '/', 2) || '/' AS prefix FROM s")
def _(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    p = F.col("path")
    return as_of(g.symbols, g.files).select("id", names.trailing_name(F.col("qualname")).alias("trailing"), names.short_name(F.col("qualname")).alias("short"), paths.first_segment(p).alias("top"), paths.module_prefix(p, 2).alias("prefix"))


ENDINGS = ("py", "pyi", "PY", "rs", "js", "jsx", "mjs", "cjs", "ts", "mts", "cts", "tsx", "cs", "csx", "sql", "psql", "pgsql", "tsql", "proto", "go", "yaml", "yml", "bicep", "bicepparam", "txt")
BY_ENDING = "CASE WHEN x IN ('py', 'pyi') THEN 'python' WHEN x = 'rs' THEN 'rust' WHEN x IN ('js', 'jsx', 'mjs', 'cjs') THEN 'javascript' WHEN x IN ('ts', 'mts', 'cts') THEN 'typescript' WHEN x = 'tsx' THEN 'tsx' WHEN x IN ('cs', 'csx') THEN 'csharp' WHEN x = 'sql' THEN 'sql' WHEN x IN ('psql', 'pgsql') THEN 'postgres' WHEN x = 'tsql' THEN 'tsql' WHEN x = 'proto' THEN 'proto' WHEN x = 'go' THEN 'go' WHEN x IN ('yaml', 'yml') THEN 'yaml' WHEN x IN ('bicep', 'bicepparam') THEN 'bicep' END"


@query("language_detection", f"SELECT path, {BY_ENDING} AS language FROM (SELECT 'a.b/' || source || '/' || doc_id || '.' || {list(ENDINGS)}[doc_id % 25 + 1] AS path, lower({list(ENDINGS)}[doc_id % 25 + 1]) AS x FROM documents)")
def _(spark: SparkSession, d: str) -> DataFrame:
    ending = F.element_at(F.array(*map(F.lit, ENDINGS)), (F.col("doc_id") % 25 + 1).cast("int"))
    found = read(spark, d, "documents").select(F.concat(F.lit("a.b/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), ending).alias("path"))
    return found.select("path", paths.language(F.col("path")).alias("language"))


@query("evidence_snippet", "SELECT doc_id, CASE WHEN strlen(one) <= 200 THEN one ELSE left(one, list_max([n FOR n IN range(0, 201) IF strlen(left(one, CAST(n AS INTEGER))) <= 200])) END AS snippet FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS one FROM documents)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", text.snippet(F.col("text")).alias("snippet"))


# budgets and snapshots

@query("byte_budget_prefix", "SELECT doc_id, source, CAST(used AS BIGINT) AS used, CAST(least(strlen(text), 20000 - used) AS BIGINT) >= strlen(text) AS whole FROM (SELECT doc_id, source, text, coalesce(sum(strlen(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM documents) WHERE used < 20000")
def _(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", "source", "text", F.octet_length("text").alias("n"))
    kept = budget.byte_prefix(docs, ["source"], ["doc_id"], "text", 20_000)
    return kept.select("doc_id", "source", F.col("used").cast("long").alias("used"), (F.octet_length("text") == F.col("n")).alias("whole"))


@query("section_budgets", "SELECT conv_id, role, turn FROM (SELECT conv_id, turn, role, sum(strlen(text)) OVER (PARTITION BY conv_id, role ORDER BY turn, text ROWS UNBOUNDED PRECEDING) AS used FROM conversations) WHERE used <= 2000 * CASE role WHEN 'user' THEN 20 WHEN 'assistant' THEN 30 ELSE 10 END / 100")
def _(spark: SparkSession, d: str) -> DataFrame:
    section = F.when(F.col("role") == "user", "callers").when(F.col("role") == "assistant", "source").otherwise("tests")
    kept = budget.sections(read(spark, d, "conversations").withColumn("section", section), ["conv_id"], "section", ["turn", "text"], "text", 2_000)
    return kept.select("conv_id", "role", "turn")


@query("snapshot_diff", "WITH a AS (SELECT p_partkey AS id, p_name, p_size FROM part WHERE p_partkey % 10 <> 3), b AS (SELECT p_partkey AS id, p_name, CASE WHEN p_partkey % 4 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_partkey % 10 <> 7) SELECT id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'deleted' WHEN (a.p_name, a.p_size) IS DISTINCT FROM (b.p_name, b.p_size) THEN 'modified' ELSE 'unchanged' END AS state FROM a FULL JOIN b USING (id)")
def _(spark: SparkSession, d: str) -> DataFrame:
    part = read(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_size")
    after = part.where("id % 10 <> 7").withColumn("p_size", F.when(F.col("id") % 4 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return snapshot.diff(part.where("id % 10 <> 3"), after, "id", ["p_name", "p_size"])


@query("upsert_merge", "SELECT key, value FROM (SELECT user_id AS key, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type = 'purchase') WHERE n = 1 UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def _(spark: SparkSession, d: str) -> DataFrame:
    current = read(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value"))
    changes = read(spark, d, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("key"), "value", "ts", "event_id")
    return snapshot.upsert(current, changes, ["key"], [F.desc("ts"), F.desc("event_id")])


@query("soft_delete", PREFIX + " SELECT file_id, path, CAST(CASE WHEN file_id % 3 = 0 THEN least(coalesce(deleted_version, 5), 5) ELSE deleted_version END AS BIGINT) AS deleted_version FROM g_files")
def _(spark: SparkSession, d: str) -> DataFrame:
    files = graph(spark, d).files
    return snapshot.soft_delete(files, files.where("file_id % 3 = 0"), 5).select("file_id", "path", "deleted_version")


SHORT = "WITH lines AS (SELECT 'src/' || item_id AS path, i AS line, string_split(text, chr(10))[i] AS content FROM (SELECT item_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM benchmark))"


@query("hit_merge", f"{SHORT}, {fuzzy_sql(['heed'])}, x AS (SELECT path, line FROM lines WHERE contains(content, 'the')) SELECT path, line, CAST(10.0 AS DOUBLE) AS score, 'exact' AS engine FROM x UNION ALL SELECT path, line, score, 'fuzzy' FROM fuzz WHERE (path, line) NOT IN (SELECT path, line FROM x)")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = search.lines(read(spark, d, "benchmark").select(F.concat(F.lit("src/"), F.col("item_id").cast("string")).alias("path"), "text"))
    first = search.exact(rows, "the").select("path", "line", F.lit(search.EXACT_SCORE).alias("score"), F.lit("exact").alias("engine"))
    return search.merged(first, search.fuzzy(rows, ["heed"]).select("path", "line", "score", F.lit("fuzzy").alias("engine")))


# change streams

@query("debounce_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS first FROM events), n AS (SELECT user_id, ts, sum(first) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g) SELECT user_id AS key, CAST(min(ts) AS TIMESTAMP) AS start, count(*) AS events FROM n GROUP BY user_id, n")
def _(spark: SparkSession, d: str) -> DataFrame:
    events = read(spark, d, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    return watch.debounced(events, "6 hours").select("key", F.col("start").cast("timestamp_ntz").alias("start"), "events")


@query("urgent_classification", "SELECT event_id, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) < 3600000000, false) AS urgent FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    events = read(spark, d, "events").select("event_id", F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    return watch.urgent(events, 3_600).select("event_id", "urgent")


@query("batch_flush", "SELECT n // 100 AS batch, count(*) AS changes, CAST(sum(length(props)) AS BIGINT) AS bytes FROM (SELECT props, row_number() OVER (ORDER BY ts, event_id) - 1 AS n FROM events) GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    events = read(spark, d, "events").select("event_id", "ts", F.length("props").alias("size"))
    return watch.batches(events, ["ts", "event_id"], "size", 100)
