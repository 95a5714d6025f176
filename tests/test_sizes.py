"""Cases that only larger or odder tables had shown."""

from __future__ import annotations

import time
import types
import zlib

from pyspark.sql import functions as F

from spanloom.operators import analytics, impact, resolve, search, shared, snapshot, spelling, traverse
from spanloom.plans import core
from spanloom.streaming import watch
from tests.oracle import DATA, TABLES, agree


def test_blank_texts_among_those_that_go_round(spark, tmp_path) -> None:
    from spanloom.llm import queries

    turned = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    for text in (None, "", " \n\t "):
        spark.createDataFrame([(turned, text)], "doc_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        row = queries.op11_word_runs(spark, str(tmp_path)).first()
        assert row.n_runs == 0 and row.start is None


def test_batches_are_counted_on_one_sort(spark) -> None:
    events = spark.range(40_000).selectExpr("id as event_id", "timestamp_micros(pmod(hash(id), 1000) * 1000) as ts", "pmod(id * 7, 50) + 1 as size")
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = watch.batches(events, ["ts", "event_id"], "size", 100).collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sorted((r.batch, r.changes) for r in got) == [(i, 100) for i in range(400)]
    assert sum(r.bytes for r in got) == sum(i * 7 % 50 + 1 for i in range(40_000))


def test_risk_where_symbols_share_ids(spark, tmp_path) -> None:
    from spanloom.plans import registry

    for name in TABLES:
        rows = spark.read.parquet(f"{DATA}/{name}.parquet")
        if name == "part":  # their symbols have ids of suppliers' and of orders' too
            rows = rows.union(rows.withColumn("p_partkey", F.expr("p_partkey + 1000000"))).union(rows.withColumn("p_partkey", F.expr("p_partkey + 2000000")))
        rows.coalesce(1).write.parquet(f"{tmp_path}/raw/{name}")
        (part,) = (tmp_path / "raw" / name).glob("*.parquet")
        part.rename(tmp_path / f"{name}.parquet")
    for name in ("risk_level", "test_coverage"):
        agree(spark, registry.QUERIES[name], registry.ORACLE_SQL[name], str(tmp_path))


def test_risk_is_by_all_callers(spark, monkeypatch) -> None:
    symbols = spark.createDataFrame([(i, "function", f"f{i}", f"a.f{i}", f"p{i % 3}", "go" if i == 60 else "py") for i in range(61)], "id long, kind string, name string, qualname string, path string, language string")
    edges = spark.range(1, 61).selectExpr("id as source", "0L as target", "'CALLS' as kind", "cast(null as string) as target_qualname", "'py' as language")
    monkeypatch.setattr(core, "changed", lambda g: spark.createDataFrame([(0, "modified")], "id long, change string"))
    g = types.SimpleNamespace(s=symbols, e=edges)
    rows = lambda *most: {(r.factor, r.n) for r in core.risk_factors(g, *most).collect()}
    assert rows() == {("Missing test coverage", 1), ("High fan-in", 60), ("Cross-language impact", 1)}
    assert rows(impact.MOST) == {("Missing test coverage", 1), ("High fan-in", 50)}
    assert impact.diff_downstream(symbols.where("id = 0"), symbols, edges, 1).count() == 60


def test_trigrams_of_long_texts_and_wide_characters(spark) -> None:
    text = "ab\n😀é" * 60_000
    began = time.monotonic()
    got = {r.gram for r in search.gram_index(spark.createDataFrame([("p", text), ("q", "ab")], "path string, text string")).collect()}
    assert got == {text[i : i + 3] for i in range(10)} and time.monotonic() - began < 20


def test_numbered_names_share_variants_with_near_ones_alone(spark) -> None:
    names = spark.createDataFrame([("supplier_123456",), ("supplier_123987",), ("supplier_12345",)], "name string")
    one, far, near = (set(r.d) for r in names.select(spelling.deletions(F.col("name")).alias("d")).collect())
    assert not one & far and one & near


def test_a_trace_ends_with_the_level_that_is_enough(spark) -> None:
    symbols = spark.createDataFrame([(i, f"n{i}", f"n{i}", "function", "x") for i in range(8)], "id long, name string, qualname string, kind string, language string")
    edges = spark.createDataFrame([(i, i + 1, "CALLS", None, "x") for i in range(7)], "source long, target long, kind string, target_qualname string, language string")
    reached = traverse.bfs(symbols.where("id = 0").select("id"), traverse.ways(symbols, edges, traverse.DOWN), 7, enough=3)
    assert sorted(r.id for r in reached.collect()) == [0, 1, 2, 3]


def test_tasks_grow_with_the_rows(spark, monkeypatch) -> None:
    monkeypatch.setattr(shared, "TASK_ROWS", 100)
    assert core.changes(spark, DATA).rdd.getNumPartitions() >= 50
    history = spark.range(3_000).selectExpr("id % 500 as source", "id % 5 as target", "id % 3 as graph_version")
    assert snapshot.validity(history, ["source", "target"]).rdd.getNumPartitions() == 30


def test_evidence_of_an_impact_is_dealt_out(spark, monkeypatch) -> None:
    monkeypatch.setattr(shared, "TASK_ROWS", 100)
    symbols = spark.range(3_000).selectExpr("id", "'function' as kind", "concat('n', id) as qualname", "'p' as path")
    reached = spark.createDataFrame([(1, 0), (2, 1)], "id long, distance int")
    fused = impact.fuse(reached, spark.createDataFrame([(2, "test_call")], "id long, source string"), spark.range(2, 3_000).selectExpr("id", "0.5D as frequency"), symbols)
    rows = {r.id: (r.sources, r.confidence, r.distance, r.relationship) for r in fused.collect()}
    assert len(rows) == 2_999 and rows[1] == (1, 0.95, 0, "SEED") and rows[2] == (3, 0.95, 1, "DIRECT") and rows[3] == (1, 0.5, 1, "COCHANGE")
    assert fused.rdd.getNumPartitions() == 30


def test_bridges_of_a_name_are_dealt_over_shares(spark, monkeypatch) -> None:
    monkeypatch.setattr(resolve, "SHARE", 2)
    rows = [(i, "HTTP_CALL" if i % 3 else "HTTP_ROUTE", "/hot" if i % 5 else "/other") for i in range(40)] + [(7, "HTTP_ROUTE", "/hot"), (99, "RPC_CALL", "/alone"), (None, "HTTP_CALL", "/hot")]
    want = {(n, k, l, a, b) for a, k, n in rows for b, l, m in rows if n == m and {k, l} == {"HTTP_CALL", "HTTP_ROUTE"} and a != b and a is not None and b is not None}
    got = resolve.bridges(spark.createDataFrame(rows + rows[:3], "source long, kind string, target_qualname string")).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_sources_meet_shares_before_pairs_are_made(spark, monkeypatch) -> None:
    edges = spark.range(90).selectExpr("id as source", "if(id < 60, 'HTTP_CALL', 'HTTP_ROUTE') as kind", "'/hot' as target_qualname")
    for share, rows in ((1_000, 60 + 30), (30, 60 * 1 + 30 * 2)):
        monkeypatch.setattr(resolve, "SHARE", share)
        met = resolve.meetings(edges).collect()
        assert len(met) == rows and sum(len(r.to_ids) for r in met) == 2 * 60 * 30 == resolve.bridges(edges).count()


def test_edges_without_an_end_are_dealt_out(spark) -> None:
    symbols = spark.createDataFrame([(1, "function", "a.b", "p", 1, 2, None)], "id long, kind string, qualname string, path string, start_line long, end_line long, signature string")
    edges = spark.range(2_000).selectExpr("1L as source", "cast(null as long) as target", "'CALLS' as kind", "concat('n', id) as target_qualname", "'p' as path", "id as line", "0.5D as confidence", "1L as event_ts", "'t' as trace_id", "'d' as detail")
    seen = []
    whole = analytics.multiset_digest
    analytics.multiset_digest = lambda df, columns: (seen.append(df) if "target_name" in columns else None) or whole(df, columns)
    try:
        files = spark.createDataFrame([("p", "x", None)], "path string, language string, deleted_version long")
        metrics = spark.createDataFrame([(1, 1, 1, "h")], "symbol_id long, loc long, complexity long, duplication_hash string")
        analytics.graph_digests(files, symbols, edges, metrics)
    finally:
        analytics.multiset_digest = whole
    spread = seen[0].groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(spread) > 1 and max(r["count"] for r in spread) < 1_500
