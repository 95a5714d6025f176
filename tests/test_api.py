"""The methods end to end over the smallest tables."""

from __future__ import annotations

import json
import os

import pytest

from spanloom.api import METHODS, Engine
from spanloom.plans.model import graph, read
from tests.oracle import DATA

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def engine(spark) -> Engine:
    g = graph(spark, DATA)
    paths = g.files.select("path").limit(1).collect()[0].path
    sources = read(spark, DATA, "documents").limit(1).selectExpr(f"'{paths}' AS path", "text")
    return Engine(g.files, g.symbols, g.edges, g.metrics, sources)


def test_all_methods_are_there() -> None:
    assert len(METHODS) == 13


@pytest.mark.parametrize(
    ("method", "params", "part"),
    [
        ("orient", {}, "counts"),
        ("onboard", {}, "map"),
        ("repo_map", {"max_bytes": 1000}, "rows"),
        ("top_complexity", {"limit": 3}, "rows"),
        ("dead_symbols", {}, "symbols"),
        ("explain_symbol", {"query": "1000004"}, "rows"),
        ("trace_flow", {"start": "supply.supplier_7", "direction": "up", "max_hops": 1}, "hops"),
        ("analyze_impact", {"query": "1000004", "max_depth": 1}, "rows"),
        ("context", {"path": "ASIA/NATION_2/core.py"}, "rows"),
        ("search", {"query": "[a-z]"}, "rows"),
        ("gather_context", {"query": "supplier", "depth": 0}, "rows"),
        ("analyze_diff", {"diff": "--- a/x\n+++ b/ASIA/NATION_2/core.py\n@@ -1,60 +1,60 @@\n", "max_depth": 1}, "risk"),
    ],
)
def test_methods_answer(engine: Engine, method: str, params: dict, part: str) -> None:
    got = json.loads(engine.answer(json.dumps({"id": 7, "method": method, "params": params})))
    assert got["id"] == 7 and part in got["result"], got
    if method not in ("gather_context",):
        assert got["result"][part]


def test_reindex_reads_a_tree(engine: Engine, tmp_path) -> None:
    (tmp_path / "a.py").write_text("def f():\n    return g()\n")
    own = Engine(engine.files, engine.symbols, engine.edges, engine.metrics)
    got = json.loads(own.answer(json.dumps({"method": "reindex", "params": {"root": str(tmp_path)}})))
    assert {i.get("qualname") for i in got["result"]["symbols"]} >= {"a", "a.f"}
    (again,) = own.serve(["", json.dumps({"method": "explain_symbol", "params": {"query": "a.f", "fields": ["qualname"]}})])
    assert json.loads(again)["result"]["rows"] == [{"qualname": "a.f"}]
    assert "error" in json.loads(own.answer('{"method": "orient", "params": {"paths": ["../x"]}}'))


def test_wrong_requests_are_told(engine: Engine) -> None:
    for request in ('{"method": "nothing"}', "no json", '{"method": "trace_flow", "params": {"start": "x", "max_hops": 99}}', '{"method": "orient", "params": {"languages": ["klingon"]}}'):
        assert "error" in json.loads(engine.answer(request))


def test_names_that_nothing_fits_are_answered_with_what_is_near(engine: Engine) -> None:
    got = json.loads(engine.answer('{"method": "explain_symbol", "params": {"query": "suply.sxplixr_7x"}}'))
    assert "did you mean" not in got["error"]  # more than two edits away
    got = json.loads(engine.answer('{"method": "explain_symbol", "params": {"query": "supply.suplier_7"}}'))
    assert "supply.supplier_7" in got["error"]
    alone = engine.call("explain_symbol", {"query": "supply.supplier_7"}).collect()
    assert alone and engine.call("explain_symbol", {"query": "supply.supplier_7", "languages": ["go"]}) is not None


def test_several_queries_are_answered_each(engine: Engine) -> None:
    got = json.loads(engine.answer('{"method": "analyze_impact", "params": {"query": ["1000004", "no_such_thing_at_all", "1000005"], "max_depth": 1}}'))["result"]
    assert {r["query"] for r in got["rows"]} == {"1000004", "1000005"} and [e["query"] for e in got["errors"]] == ["no_such_thing_at_all"]


def test_impact_reads_the_history_it_is_given(spark, engine) -> None:
    here, there = 1000004, 1000005
    files = {r.id: r.file_id for r in engine.symbols.where(f"id in ({here}, {there})").collect()}
    assert files[here] != files[there]
    pairs = spark.createDataFrame([(files[here], files[there], 9.0, 0.75)], "file_a long, file_b long, together double, confidence double")
    for mined in (None, pairs):
        found = Engine(engine.files, engine.symbols, engine.edges, engine.metrics, pairs=mined).call("analyze_impact", {"query": str(here), "max_depth": 1})
        by_history = found.where("relationship = 'COCHANGE'").count()
        assert (by_history > 0) == (mined is not None)
