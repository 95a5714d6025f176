"""Hand-made graphs, texts and repositories."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from spanloom.functions import names, normalize, paths, text
from spanloom.operators import analytics, budget, cochange, filters, impact, index, resolve, search, snapshot, traverse, xref
from spanloom.sources import extract, repository
from spanloom.streaming import watch


def column(spark, expression, *values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(expression(F.col("x"))).collect()]


EDGES = "source long, target long, kind string, target_qualname string, language string"


def graph_edges(spark, *more):
    rows = [(1, 2, "CALLS"), (2, 3, "CALLS"), (3, 1, "CALLS"), (3, 4, "CALLS"), (4, 4, "CALLS"), (2, 77, "CALLS")]
    return spark.createDataFrame([(*r, None, "py") for r in rows] + [(4, None, "CHANNEL_PUBLISH", "channel://x", "py"), (9, None, "CHANNEL_SUBSCRIBE", "channel://x", "go"), *more], EDGES)


def graph_symbols(spark):
    languages = {9: "go", 12: "go"}
    return spark.createDataFrame([(i, f"f{i}", f"m.f{i}", "function", languages.get(i, "py"), f"src/f{i}.{languages.get(i, 'py')}") for i in (1, 2, 3, 4, 9, 11, 12)], "id long, name string, qualname string, kind string, language string, path string")


def test_bfs_through_a_cycle_and_a_bridge(spark) -> None:
    near = traverse.ways(graph_symbols(spark), graph_edges(spark), traverse.DOWN)
    seeds = spark.createDataFrame([(1,)], "id long")
    found = {r.id: (r.distance, r.parent, r.kind) for r in traverse.bfs(seeds, near, 9).collect()}
    assert found == {1: (0, None, None), 2: (1, 1, "CALLS"), 3: (2, 2, "CALLS"), 4: (3, 3, "CALLS"), 9: (4, 4, "CHANNEL_PUBLISH")}
    assert {r.id for r in traverse.bfs(seeds, near, 1).collect()} == {1, 2}
    steps = {r.id: r.steps for r in traverse.paths(traverse.bfs(seeds, near, 9), 9).collect()}
    assert steps[9] == [1, 2, 3, 4, 9]


def test_names_and_dead_ends_in_a_walk(spark) -> None:
    loose = [(4, None, "CALLS", "lib.f11", "py"), (4, None, "CALLS", "lib.f12", "py"), (4, None, "XREF", "lib.f12", "py"), (12, None, "CALLS", "x.f1", "go"), (11, None, "XREF", "x.f1", "py")]
    symbols, edges = graph_symbols(spark), graph_edges(spark, *loose)
    seeds = spark.createDataFrame([(1,)], "id long")
    down = {r.id: (r.distance, r.kind, r.via) for r in traverse.bfs(seeds, traverse.ways(symbols, edges, traverse.DOWN), 9).collect()}
    assert down[11] == (4, "CALLS", "name") and down[12] == (4, "XREF", "name") and 77 not in down
    up = lambda **by: {r.id: r.distance for r in traverse.bfs(seeds, traverse.ways(symbols, edges, traverse.UP, **by), 1).collect()}
    assert up() == {1: 0, 3: 1, 12: 1} and up(by_name=None) == {1: 0, 3: 1, 11: 1, 12: 1} and up(by_name=("XREF",)) == {1: 0, 3: 1, 11: 1}
    callers = {r.id: (r.distance, r.confidence) for r in impact.diff_downstream(seeds, symbols, edges, 2).collect()}
    assert callers == {3: (1, 0.9), 12: (1, 0.72), 2: (2, 0.72), 4: (2, 0.576)}


def test_a_trace_tells_its_boundaries_and_keeps_to_its_budget(spark) -> None:
    edges = graph_edges(spark).withColumn("detail", F.when(F.col("kind") == "CHANNEL_SUBSCRIBE", '{"framework":"bus","channel":"x","role":"subscriber"}'))
    seeds = spark.createDataFrame([(1,)], "id long")
    hops = traverse.trace_flow(seeds, graph_symbols(spark), edges)
    rows = hops.orderBy("position").collect()
    assert [(r.id, r.distance, r.edge_kind, r.cross_language) for r in rows] == [(2, 1, "CALLS", False), (3, 2, "CALLS", False), (4, 3, "CALLS", False), (9, 4, "CHANNEL_SUBSCRIBE", True)]
    assert (rows[3].boundary_type, rows[3].boundary_detail) == ("message_bus", "py \u2192 go via message bus") and rows[3].protocol == '{"framework":"bus","channel":"x","role":"subscriber"}'
    assert [r.id for r in traverse.trace_flow(seeds, graph_symbols(spark), edges, max_bytes=1, offset=1).collect()] == [3]
    to = traverse.trace_flow(seeds, graph_symbols(spark), edges, end=3)
    assert sorted(r.id for r in to.collect()) == [2, 3] and tuple(traverse.paths_found(to, 3).first()) == (2, 1, True)
    assert tuple(traverse.paths_found(hops).first()) == (4, 1, False) and tuple(traverse.paths_found(hops.where("false"), 5).first()) == (0, 0, False)


def test_dead_code_by_its_rules(spark) -> None:
    kinds = [(1, "function", "main"), (2, "class", "Used"), (3, "class", "Dead"), (4, "method", "route"), (5, "variable", "x"), (6, "function", "setup"), (7, "struct", "Base"), (8, "function", "test_gone"), (9, "function", "only_xref")]
    symbols = spark.createDataFrame([(i, k, n, n, "src/a.py") for i, k, n in kinds], "id long, kind string, name string, qualname string, path string")
    rows = [(1, 2, "CALLS", "Used", 1), (4, None, "HTTP_ROUTE", "/x", 1), (2, 7, "EXTENDS", "Base", 1), (2, 9, "XREF", "o", 1), (1, None, "IMPORTS", "a.b", 1), (1, None, "XREF", "a.b", 1), (1, None, "IMPORTS", "a.c", 1), (1, None, "CALLS", "a.c", 1), (1, None, "CALLS", "a.b", 2)]
    edges = spark.createDataFrame(rows, "source long, target long, kind string, target_qualname string, file_id long")
    assert {r.id for r in resolve.dead_symbols(symbols, edges).collect()} == {3, 8, 9}
    assert [(r.file_id, r.target_qualname) for r in resolve.unused_imports(edges).collect()] == [(1, "a.b")]
    by_path = symbols.union(spark.createDataFrame([(20, "method", "check", "c.check", "src/spec/b.py"), (21, "method", "TestUsed", "T", "src/c.py")], symbols.schema))
    assert {(r.id, r.wanted) for r in resolve.orphan_tests(by_path).collect()} == {(8, "gone")}
    assert resolve.orphan_tests(by_path.where("id <> 2 and id <> 20").union(spark.createDataFrame([(22, "method", "", "", "test/x.py")], symbols.schema))).count() == 2


def test_risk_of_a_change(spark) -> None:
    changed = spark.createDataFrame([(1, "signature_changed", "interface", "a.I", "py"), (2, "modified", "function", "a.f", "py")], "id long, change string, kind string, qualname string, language string")
    coverage = spark.createDataFrame([(1, "covered"), (2, "uncovered")], "id long, status string")
    callers = lambda n, language="py": spark.createDataFrame([(100 + i, f"p{i % 4}", language) for i in range(n)], "id long, path string, language string")
    found = lambda down: {(r.factor, r.severity, r.n) for r in analytics.risk_factors(changed, down, coverage).collect()}
    always = {("Interface/contract change", "high", 1), ("Missing test coverage", "medium", 1)}
    assert found(callers(0)) == always
    assert found(callers(3)) == always | {("Signature change", "high", 3)}
    assert found(callers(11, "go")) == always | {("Signature changed on high-traffic symbol", "critical", 11), ("Cross-language impact", "high", 11), ("High fan-in", "high", 11), ("Wide blast radius", "medium", 4)}
    assert analytics.risk_level(analytics.risk_factors(changed, callers(11), coverage)).first().level == "critical"
    assert tuple(analytics.risk_level(analytics.risk_factors(changed.where("false"), callers(0), coverage.where("false"))).first()) == ("low", 0)


def test_intervals_by_brute_force(spark) -> None:
    r = random.Random(6)
    rows = [(i, r.randint(1, 3), r.choice(["class", "module", "method"]), s := r.randint(1, 400), s + r.choice([0, 3, 60, 64, 200])) for i in range(250)]
    symbols = spark.createDataFrame(rows, "id long, file_id long, kind string, start_line long, end_line long")
    points = [(f, at) for f in (1, 2, 3) for at in r.sample(range(1, 700), 60)]
    given = spark.createDataFrame(points, "file_id long, at long")
    got = {(x.file_id, x.at): x.id for x in resolve.enclosing(given, symbols, ["file_id", "at"]).collect()}
    want = {(f, at): min((k == "module", b - a, -a, i) for i, g, k, a, b in rows if g == f and a <= at <= b)[3] for f, at in points if any(g == f and a <= at <= b for _, g, _, a, b in rows)}
    assert got == want
    inner = {x.id for x in resolve.innermost_only(symbols).collect()}
    assert inner == {i for i, f, _, a, b in rows if not any(g == f and c >= a and d <= b and (c > a or d < b) for _, g, _, c, d in rows)}
    pairs = sorted(tuple(x) for x in resolve.members(symbols.where("kind = 'class'"), symbols).collect())
    assert pairs == sorted((i, j) for i, f, k, a, b in rows if k == "class" for j, g, _, c, d in rows if g == f and c >= a and d <= b and i != j)
    hunks = [(r.randint(1, 3), s := r.randint(1, 400), s + r.choice([0, 10, 130])) for _ in range(20)]
    touched = {x.id: (x.change, x.hunks) for x in resolve.overlapping(spark.createDataFrame(hunks, "file_id long, hunk_start long, hunk_end long"), symbols).collect()}
    for i, f, _, a, b in rows:
        met = [(x, y) for g, x, y in hunks if g == f and a <= y and b >= x]
        assert touched.get(i) == (("added" if any(a >= x and b <= y for x, y in met) else "modified", len(met)) if met else None)


def test_directions_are_read() -> None:
    assert [traverse.direction(d) for d in ("callers", "OUT", "x")] == [traverse.UP, traverse.DOWN, traverse.BOTH]


def test_suffix_resolution_prefers_the_language_and_crosses_for_bridges(spark) -> None:
    symbols = spark.createDataFrame([(1, "function", "a.run", "py"), (2, "function", "x.y.run", "py"), (3, "function", "other::run", "go"), (4, "variable", "run", "py")], "id long, kind string, qualname string, language string")
    asked = spark.createDataFrame([("svc.run", "py", "CALLS"), ("svc.run", "rs", "CALLS"), ("svc.run", "rs", "RPC_CALL")], "target_qualname string, language string, kind string")
    got = {(r.language, r.may_cross): r.resolved_id for r in resolve.resolve_by_suffix(asked, symbols).collect()}
    assert got == {("py", False): 1, ("rs", True): 1}


def test_noisy_or_is_capped_from_three_sources_on(spark) -> None:
    rows = [(1, 0.5), (2, 0.5), (2, 0.5), (3, 0.9), (3, 0.9), (3, 0.9)]
    got = {r.id: r.confidence for r in cochange.noisy_or(spark.createDataFrame(rows, "id long, confidence double")).collect()}
    assert got == {1: 0.5, 2: 0.75, 3: 0.95}


def test_large_commits_make_no_pairs(spark) -> None:
    rows = [("a", "2024-01-01", f) for f in ("x", "y")] + [("b", "2024-01-01", f"f{i}") for i in range(51)]
    changes = spark.createDataFrame(rows, "sha string, ts string, file string").withColumn("ts", F.col("ts").cast("date"))
    got = cochange.mine_pairs(changes, F.lit("2024-01-01").cast("date")).collect()
    assert [(r.file_a, r.file_b, r.together, r.confidence) for r in got] == [("x", "y", 1.0, 1.0)]


def test_paths_are_classified(spark) -> None:
    flags = lambda c: F.concat_ws(",", *(F.when(paths.path_class(c)[f], f) for f in ("docs", "tests", "generated", "src")))
    assert column(spark, flags, "src/a.py", "README.md", "a/tests/b.py", "dist/x.min.js", "a/b_test.go") == ["src", "docs", "tests", "generated", "tests"]
    assert column(spark, lambda c: paths.module_prefix(c, 2), "a/b/c/d.py", "a/x.py", "x.py") == ["a/b/", "a/", "."]
    assert column(spark, paths.language, "a.tsx", "b.psql", "c.unknown", "noext") == ["tsx", "postgres", None, None]


def test_routes_are_normalized(spark) -> None:
    got = column(spark, normalize.route, "/api/Users/:id/", "https://h/a//12?x=1#y", "/x/550e8400-e29b-41d4-a716-446655440000", "api/x", "/1/2", "/a b", "./x/y")
    assert got == ["/api/users/{}", "/a/{}", "/x/{}", None, None, None, None]
    assert column(spark, normalize.channel, "Topics.Order_Made", "plain", " ", "x.Y") == ["channel://ordermade", "channel://plain", None, "channel://x.y"]
    assert column(spark, normalize.http_method, "GetAsync", '"all"', "fetch") == ["GET", "ANY", None]


def test_identifiers_are_split(spark) -> None:
    assert column(spark, text.identifier_parts, "HTTPServer2Go", "snake_case-kebab", "fooBar") == [["HTTP", "Server", "2", "Go"], ["snake", "case", "kebab"], ["foo", "Bar"]]
    assert column(spark, text.normal_token, "Running", "glasses", "class", "x", "12", "Users") == ["runn", "glass", "class", None, None, "user"]
    assert column(spark, lambda c: text.utf8_prefix(c, 4), "aéé", "日本", "abcdef", "") == ["aé", "日", "abcd", ""]
    assert column(spark, names.test_target, "test_a", "a_test", "testFoo", "TestFoo", "fooTest", "fooSpec", "other") == ["a", "a", "Foo", "Foo", "foo", "foo", None]


def test_similarity_by_brute_force(spark) -> None:
    def lev(a: str, b: str) -> int:
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    def one(q: str, t: str) -> float:
        if q == t:
            return 1.0
        if t.startswith(q) or q.startswith(t):
            return 0.9
        if q in t or t in q:
            return 0.8
        short, long = sorted((q, t), key=len) if len(q) != len(t) else (q, t)
        it = iter(long)
        if 2 <= len(short) <= 3 and len(long) >= len(short) + 3 and all(c in it for c in short):
            return 0.6
        ratio = 1 - lev(q, t) / max(len(q), len(t))
        return ratio if ratio >= 0.65 else 0.0

    r = random.Random(4)
    pairs = [("".join(r.choice("abc") for _ in range(r.randint(1, 8))), "".join(r.choice("abc") for _ in range(r.randint(1, 8)))) for _ in range(300)]
    got = spark.createDataFrame(pairs, "q string, t string").select("q", "t", text.similarity(F.col("q"), F.col("t")).alias("s")).collect()
    assert all(abs(row.s - one(row.q, row.t)) < 1e-9 for row in got)


def test_fuzzy_search_reports_the_best_line(spark) -> None:
    files = spark.createDataFrame([("a.py", "x = 1\ndef parse_config(path):\n  pass\n"), ("b.py", "nothing here\n"), ("c.py", None)], "path string, text string")
    rows = search.lines(files)
    assert [(r.path, r.line) for r in search.fuzzy(rows, ["parse", "config"]).collect()] == [("a.py", 2)]
    assert [r.engine for r in search.ranked(rows, "parse_config", 5).collect()] == ["exact"]
    assert [(r.path, r.line, r.engine) for r in search.ranked(rows, "parsing configs", 5).collect()] == [("a.py", 2, "fuzzy")]
    assert search.ranked(rows, "parsing/configs", 5).count() == 0 and search.query_tokens(spark, "abc") == [] and search.query_tokens(spark, "getUser") == ["getus", "get", "user"]


def test_regex_search_shows_lines_around(spark) -> None:
    files = spark.createDataFrame([("a", "one\ntwo\nthree\nfour\n"), ("b", None), ("c", "two")], "path string, text string")
    got = sorted(search.regex(files, "t[wh]", 2).collect())
    assert [tuple(r) for r in got] == [("a", 2, "two", "one", "three\nfour"), ("a", 3, "three", "one\ntwo", "four"), ("c", 1, "two", "", "")]
    with pytest.raises(ValueError):
        search.regex(files, "")


def test_cross_references_drop_ambiguous_names(spark) -> None:
    symbols = spark.createDataFrame([(1, "sql", "users_table", "app.users_table"), (2, "sql", "orders_old", "a.orders_old"), (3, "sql", "orders_old", "b.orders_old")], "id long, language string, name string, qualname string")
    literals = spark.createDataFrame([("csharp", "app.users_table"), ("csharp", "orders_old"), ("sql", "app.users_table")], "language string, token string")
    assert [(r.source_language, r.token, r.id) for r in xref.cross_references(literals, symbols).collect()] == [("csharp", "app.users_table", 1)]


def test_budgets_cut_whole_characters(spark) -> None:
    items = spark.createDataFrame([(1, 1, "abc"), (1, 2, "éé"), (1, 3, "z")], "k long, n long, text string")
    got = [(r.n, r.text) for r in budget.byte_prefix(items, ["k"], ["n"], "text", 6).orderBy("n").collect()]
    assert got == [(1, "abc"), (2, "é")]


def test_diffs_and_commits_are_read(spark) -> None:
    diff = "--- a/x.py\n+++ b/x.py\n@@ -1,2 +1,3 @@\n+a\n@@ -9 +10,0 @@\n-b\n--- a/y.py\n+++ /dev/null\n@@ -1 +0,0 @@\n"
    got = repository.hunks(spark.createDataFrame([(1, diff)], "diff_id long, text string")).collect()
    assert [(r.path, r.hunk_start, r.hunk_end, r.kind) for r in got] == [("x.py", 1, 3, "changed"), ("x.py", 10, 10, "deleted")]
    log = ["commit abc1 100", "", "1\t2\tx.py", "-\t-\tb.bin", "commit def2 200", "3\t0\tx.py"]
    rows = repository.commits(spark.createDataFrame(list(enumerate(log)), "no long, value string")).orderBy("ts").collect()
    assert [(r.sha, r.ts, r.files) for r in rows] == [("abc1", 100, ["b.bin", "x.py"]), ("def2", 200, ["x.py"])]


def test_a_repository_is_scanned_and_extracted(spark, tmp_path) -> None:
    (tmp_path / "pkg").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "pkg" / "core.py").write_text("import os\nclass A(B):\n    @app.get('/u/{id}')\n    def run(self, x):\n        os.getenv('key')\n        return helper(x)\n")
    (tmp_path / "pkg" / "bad.py").write_text("def broken(:\n")
    (tmp_path / "node_modules" / "x.js").write_text("function f() {}\n")
    (tmp_path / "s.sql").write_text("create table a.t (id int references b.u(id));\n")
    files = repository.scan(spark, str(tmp_path))
    assert {r.path for r in files.collect()} == {"pkg/core.py", "pkg/bad.py", "s.sql"}
    assert {r.path for r in repository.scan(spark, str(tmp_path), rules=["pkg/", "!pkg/core.py"]).collect()} == {"pkg/core.py", "s.sql"}
    rows = extract.extract(files).collect()
    symbols = {(r.kind, r.qualname) for r in rows if r["item"] == "symbol"}
    assert {("class", "pkg.core.A"), ("method", "pkg.core.A.run"), ("table", "a.t")} <= symbols
    edges = {(r.kind, r.source_qualname, r.target_qualname) for r in rows if r["item"] == "edge"}
    assert {("EXTENDS", "pkg.core.A", "B"), ("HTTP_ROUTE", "pkg.core.A.run", "/u/{id}"), ("CONFIG_READ", "pkg.core.A.run", "env://KEY"), ("CALLS", "pkg.core.A.run", "helper"), ("REFERENCES", "a.t", "b.u")} <= edges
    assert [r.path for r in rows if r["item"] == "error"] == ["pkg/bad.py"]


@pytest.mark.parametrize("name", ["ts", "k8s"])
def test_language_aliases(name: str) -> None:
    assert repository.language_filter([name, name]) == {"ts": ["tsx", "typescript"], "k8s": ["yaml"]}[name]
    with pytest.raises(ValueError):
        repository.language_filter(["klingon"])


def test_apply_diff_unlinks_deleted_symbols(spark) -> None:
    before = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, v string")
    after = spark.createDataFrame([(1, "a"), (2, "B"), (4, "d")], "id long, v string")
    states = snapshot.diff(before, after, "id", ["v"])
    assert {r.id: r.state for r in states.collect()} == {1: "unchanged", 2: "modified", 3: "deleted", 4: "added"}
    symbols, edges = snapshot.apply_diff(before, spark.createDataFrame([(1, 3), (3, 2)], "source long, target long"), states, after)
    assert {(r.id, r.v) for r in symbols.collect()} == {(1, "a"), (2, "B"), (4, "d")}
    assert {(r.source, r.target) for r in edges.collect()} == {(1, None), (None, 2)}


def test_streams_agree_with_batches(spark, tmp_path) -> None:
    rows = [(i, i % 3, 1_700_000_000 + 25 * i) for i in range(40)]
    events = spark.createDataFrame(rows, "event_id long, key long, t long").select("event_id", "key", F.timestamp_seconds("t").alias("ts"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = watch.events(spark, str(tmp_path / "in"), "event_id long, key long, ts timestamp")
    query = watch.urgent_stream(stream, 80).writeStream.format("memory").queryName("urgent").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    want = {r.event_id: r.urgent for r in watch.urgent(events, 80).collect()}
    assert {r.event_id: r.urgent for r in spark.table("urgent").collect()} == want


def test_maintenance_takes_the_last_change_of_a_path(spark, tmp_path) -> None:
    rows = [("a", 1, "edit"), ("a", 2, "delete"), ("b", 1, "edit")]
    spark.createDataFrame(rows, "path string, t long, event string").select("path", F.timestamp_seconds("t").alias("ts"), "event").coalesce(1).write.parquet(str(tmp_path / "in"))
    seen: list = []
    stream = watch.events(spark, str(tmp_path / "in"), "path string, ts timestamp, event string")
    watch.maintain(stream, lambda df, _: seen.extend((r.path, r.event) for r in df.collect()), lambda: seen.append("rebuilt"), str(tmp_path / "c")).awaitTermination(120)
    assert sorted(seen) == [("a", "delete"), ("b", "edit")]
    again: list = []
    watch.maintain(watch.events(spark, str(tmp_path / "in"), "path string, ts timestamp, event string"), lambda df, _: None, lambda: again.append("rebuilt"), str(tmp_path / "d"), overflow=2).awaitTermination(120)
    assert again == ["rebuilt"]


def test_literals_name_routes_and_symbols(spark) -> None:
    texts = 'x = "a\\"b" + @"v""w" + r#"raw "q" s"# + """long\n"x" y""" + `t` + "" + "open'
    assert [(text, long) for *_, text, long in xref.literals(texts)] == [('a\\"b', False), ('v""w', False), ('raw "q" s', False), ('long\n"x" y', True), ("t", False), ("", False)]
    code = 'def f():\n    get("/API/users/42/")\n    get("/api/Users/7")\n    run("call app.users_table now")\n    """/not/a/route"""\n'
    sources = spark.createDataFrame([("a.py", "python", code), ("b.yaml", "yaml", 'x: "/y/z"'), ("c.py", "python", None)], "path string, language string, text string")
    symbols = spark.createDataFrame([(1, 1, "a.py", "python", "function", "f", "a.f", 1, 5), (2, 2, "t.sql", "sql", "table", "users_table", "app.users_table", 1, 2)], "id long, file_id long, path string, language string, kind string, name string, qualname string, start_line long, end_line long")
    got = {(r.kind, r.source, r.target, r.target_qualname, r.line, r.confidence) for r in xref.edges(sources, symbols).collect()}
    assert got == {("ROUTE", 1, None, "/api/users/{}", 2, 0.85), ("XREF", 1, 2, "app.users_table", 4, 1.0)}


def test_projections_orders_and_slices(spark) -> None:
    symbols = spark.createDataFrame([(1, "b"), (2, "a")], "id long, qualname string")
    edges = spark.createDataFrame([(1, 2, "CALLS", None, 1), (2, 1, "CALLS", None, 2), (1, None, "OTHER", "z", 3), (1, 2, "CONTAINS", None, 4)], "source long, target long, kind string, target_qualname string, line long")
    assert [r.line for r in filters.edge_order(edges, symbols).collect()] == [4, 2, 1, 3]
    rows = spark.createDataFrame([(1, "q", "sig", 0.4), (2, "r", "sig", None)], "id long, qualname string, signature string, confidence double")
    assert filters.projected(rows, ["signature", "id"]).columns == ["id", "signature"] and filters.compact(rows).columns == ["id", "qualname", "confidence"]
    assert [r.id for r in filters.sure(rows, 0.3).collect()] == [1] and filters.sure(rows, 0).count() == 2
    with pytest.raises(ValueError):
        filters.projected(rows, ["nothing"])
    c = F.lit("aé\nb\n\nd")
    cut = spark.range(1).select(text.slice_lines(c, F.lit(2), F.lit(3)).alias("a"), text.line_bytes(c, F.lit(2), F.lit(4)).alias("b"), text.slice_bytes(c, F.lit(0), F.lit(2)).alias("c"), text.slice_bytes(c, F.lit(2), F.lit(6)).alias("d"), text.slice_lines(c, F.lit(9), F.lit(12)).alias("e")).first()
    assert (cut.a, tuple(cut.b), cut.c, cut.d, cut.e) == ("b\n", (4, 8), "a", "\nb\n", "")
    assert column(spark, paths.normal, "./a//b", "a\\b") == ["a/b", "a/b"] and column(spark, lambda x: paths.under(x, [".\\src"]), "src/x", "lib/x") == [True, False]
    assert [paths.escapes(p) for p in ("a/../b", "a/../../b", "/etc", "~x", "C:\\x", "./a")] == [False, True, True, True, True, False]


def test_polling_and_the_next_batch(spark) -> None:
    scans = [spark.createDataFrame(rows, "path string, hash string") for rows in ([("a", "1"), ("b", "1"), ("c", "1")], [("a", "1"), ("b", "2"), ("d", "1")])]
    assert {tuple(r) for r in watch.polled(*scans).collect()} == {("b", "modified"), ("c", "deleted"), ("d", "created")}
    assert {r.event for r in watch.polled(scans[0].where("false"), scans[1]).collect()} == {"created"}
    rows = [(1, 5, False, 10), (2, 9, True, 10), (3, 4, False, 10), (4, 8, True, 10)]
    pending = spark.createDataFrame(rows, "event_id long, ts long, urgent boolean, size long")
    ids = lambda *bounds: [r.event_id for r in watch.next_batch(pending, *bounds).collect()]
    assert ids() == [4, 2, 3, 1] and ids(3) == [4, 2, 3] and ids(100, 20) == [4, 2] and ids(100, 1) == [4]


def test_globs_and_ignore_files(spark, tmp_path) -> None:
    rules = ["*.log.py", "build/", "/top.py", "a/**/z.py", "!keep.log.py", "data[0-9].py", "x/*.py"]
    names = {"m.log.py": True, "d/build/q.py": True, "top.py": True, "d/top.py": False, "a/z.py": True, "a/b/c/z.py": True, "keep.log.py": False, "data7.py": True, "datax.py": False, "x/y.py": True, "x/y/z.py": False}
    assert dict(zip(names, column(spark, lambda p: repository.ignored(p, rules), *names), strict=True)) == names
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x = 1\n")
    (tmp_path / ".gitignore").write_text("\n".join(rules))
    assert {r.path for r in repository.scan(spark, str(tmp_path)).collect()} == {n for n, out in names.items() if not out}
    assert [(r.path, r.text) for r in repository.scan_file(spark, str(tmp_path), "d/top.py").collect()] == [("d/top.py", "x = 1\n")]
    with pytest.raises(ValueError):
        repository.scan_file(spark, str(tmp_path), "../x.py")


def test_buses_routes_and_extensions(spark) -> None:
    calls = spark.createDataFrame([("this._bus", "PublishAsync"), ("eventBus", "on"), ("eventBus", "other"), ("db", "send")], "receiver string, method string")
    assert [r[0] for r in calls.select(normalize.bus_role(F.col("receiver"), F.col("method"))).collect()] == ["publisher", "subscriber", None, None]
    joins = spark.createDataFrame([("/api/", "/users"), ("", ""), ("/api", None), (None, "x")], "a string, b string")
    assert [r[0] for r in joins.select(normalize.join_route(F.col("a"), F.col("b"))).collect()] == ["/api/users", "/", "/api", "/x"]
    rpc = spark.createDataFrame([("shop.v1", "Orders", "Get"), (None, "Orders", "Get")], "p string, s string, m string")
    assert [r[0] for r in rpc.select(normalize.rpc_path(F.col("p"), F.col("s"), F.col("m"))).collect()] == ["/shop.v1.orders/get", "/orders/get"]
    assert repository.extensions(["tsx", "typescript"]) == ["tsx", "ts", "mts", "cts"]
    assert column(spark, paths.is_test_file, "a/tests/x.py", "a/x_test.go", "a/x.spec.ts", "src/x.py") == [True, True, True, False]


def test_owners_and_listed_edges(spark) -> None:
    symbols = spark.createDataFrame([(1, "class", "a.C"), (2, "property", "a.C.x"), (3, "method", "a.C.m"), (4, "const", "lone")], "id long, kind string, qualname string")
    assert [tuple(r) for r in resolve.parents(symbols.select("id"), symbols).collect()] == [(2, 1)]
    rows = [(1, 2, "CALLS", "q", 1, "py", "p", 0.5, 10, "t"), (None, 2, "CALLS", "q", 2, "py", "p", 0.5, 10, "t"), (1, None, "XREF", "r", 3, "go", "p", 0.9, 20, None)]
    edges = spark.createDataFrame(rows, "source long, target long, kind string, target_qualname string, line long, language string, path string, confidence double, event_ts long, trace_id string")
    got = lambda **by: [r.line for r in filters.list_edges(edges, **by).collect()]
    assert got() == [2, 1, 3] or got() == [1, 2, 3]
    assert got(resolved_only=True) == [1] and got(source=1) == [1, 3] and got(target=2, kinds=["CALLS"], source=1) == [1] and got(target_qualname="r") == [3] and got(languages=["go"]) == [3] and got(languages=[]) == [] and got(since=15) == [3] and got(trace_id="t", source=1) == [1]
