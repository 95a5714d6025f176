"""The property graph's relations, and their binding to the test tables.

Files, symbols, edges and metrics have the columns that every operator expects. ``graph`` makes them
from the star-schema tables; ``PREFIX`` is the same as SQL, for the oracles.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The snapshot that the queries read.
VERSION = 2

# Edge kinds whose ends meet by a shared target name, kinds that may cross languages,
# and the kinds that are followed by default.
COMPLEMENTS = {"CHANNEL_PUBLISH": "CHANNEL_SUBSCRIBE", "CHANNEL_SUBSCRIBE": "CHANNEL_PUBLISH", "RPC_CALL": "RPC_IMPL", "RPC_IMPL": "RPC_CALL", "HTTP_CALL": "HTTP_ROUTE", "HTTP_ROUTE": "HTTP_CALL", "CONFIG_SOURCE": "CONFIG_READ", "CONFIG_READ": "CONFIG_SOURCE"}
BRIDGE_KINDS = ("RPC_IMPL", "RPC_CALL", "RPC_ROUTE", "HTTP_ROUTE", "HTTP_CALL", "CHANNEL_PUBLISH", "CHANNEL_SUBSCRIBE", "CONFIG_SOURCE", "CONFIG_READ", "CONFIG_BIND", "XREF")


@dataclass(frozen=True)
class Graph:
    files: DataFrame
    symbols: DataFrame
    edges: DataFrame
    metrics: DataFrame


def alive(version: int = VERSION) -> Column:
    """Whether a file is part of a snapshot."""
    return F.col("deleted_version").isNull() | (F.col("deleted_version") > version)


def as_of(rows: DataFrame, files: DataFrame, version: int = VERSION, languages: list[str] | None = None) -> DataFrame:
    """Symbols or edges of a snapshot with path and language of their files."""
    kept = files.where(alive(version)).select("file_id", "path", "language")
    if languages:
        kept = kept.where(F.col("language").isin(*languages))
    return rows.where(F.col("graph_version") == version).join(kept, "file_id")


_schemas: dict[tuple[str, str], StructType] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table. Its schema is read from the files once in a session."""
    path = f"{sf_dir}/{name}.parquet"
    known = _schemas.get((spark.sparkContext.applicationId, path))
    found = spark.read.schema(known).parquet(path) if known else spark.read.parquet(path)
    _schemas[spark.sparkContext.applicationId, path] = found.schema
    return found


def _symbols(id_: str, file: str, kind: str, name: str, qualname: str, start: str, end: str, signature: str = "cast(null as string)", version: int = VERSION) -> list[str]:
    return [f"cast({id_} as long) as id", f"cast({file} + 1000 as long) as file_id", f"{kind} as kind", f"{name} as name", f"{qualname} as qualname", f"cast({start} as long) as start_line", f"cast({end} as long) as end_line", f"{signature} as signature", f"{version}L as graph_version"]


def _edges(source: str, target: str, kind: str, name: str, file: str, line: str, confidence: str, ts: str = "null", trace: str = "null", detail: str = "null") -> list[str]:
    return [f"cast({source} as long) as source", f"cast({target} as long) as target", f"{kind} as kind", f"{name} as target_qualname", f"cast({file} + 1000 as long) as file_id", f"cast({line} as long) as line", f"cast({confidence} as double) as confidence", f"cast({ts} as long) as event_ts", f"cast({trace} as string) as trace_id", f"cast({detail} as string) as detail", f"{VERSION}L as graph_version"]


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The four relations, as expressions in SQL: a plan of this size is built quickest from text."""
    tables = {name: read(spark, sf_dir, name) for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}
    t = tables.__getitem__
    folder = "case n_nationkey % 6 when 5 then 'tests/' when 4 then 'integration/' when 1 then 'e2e/' else '' end"
    files = t("nation").join(F.broadcast(t("region")), F.expr("n_regionkey = r_regionkey")).selectExpr(
        "cast(n_nationkey + 1000 as long) as file_id",
        f"concat(r_name, '/', n_name, '/', {folder}, 'core.py') as path",
        "r_name as language",
        "cast(case when n_nationkey % 7 = 3 then 2 end as long) as deleted_version",
    )
    name = "if(p_partkey % 97 = 5, 'setup', concat('part_', p_partkey div 3))"
    kind = "case p_type when 'PROMO' then 'function' when 'STANDARD' then 'method' when 'ECONOMY' then 'class' when 'SMALL' then 'struct' when 'LARGE' then 'module' when 'MEDIUM' then if(p_partkey % 2 = 0, 'property', 'variable') end"
    owner, start = "replace(p_brand, '#', '')", "p_partkey * 13 % 900 + 1"
    parts = t("part").selectExpr(*_symbols("p_partkey + 1000000", "p_partkey % 25", kind, name, f"concat({owner}, if(p_partkey % 3 < 2, '.', '::'), {name})", start, f"{start} + p_size", "concat('(', p_name, ')')"))
    changed = "case p_partkey % 4 when 0 then concat('(', p_name, ', old)') when 1 then concat('(', p_name, ')') end"
    earlier = t("part").where("p_partkey % 3 = 0").selectExpr(*_symbols("p_partkey + 5000000", "p_partkey % 25", kind, name, f"concat({owner}, '.', {name})", start, f"{start} + p_size", changed, VERSION - 1))
    suppliers = t("supplier").selectExpr(*_symbols("s_suppkey + 2000000", "s_nationkey", "'interface'", "concat('supplier_', s_suppkey)", "concat('supply.supplier_', s_suppkey)", "s_suppkey % 500 + 1", "s_suppkey % 500 + 21"))
    order = "if(o_orderkey % 10 = 0, concat('test_part_', o_orderkey % 3000), concat('order_', o_orderkey))"
    orders = t("orders").selectExpr(*_symbols("o_orderkey + 3000000", "o_custkey % 25", "'function'", order, f"concat('orders.', lower(o_orderstatus), '.', {order})", "o_orderkey % 800 + 1", "o_orderkey % 800 + 1 + o_orderkey % 40"))
    customers = t("customer").selectExpr(*_symbols("c_custkey + 20000000", "c_nationkey", "'service'", "concat('customer_', c_custkey)", "concat(lower(c_mktsegment), '.customer_', c_custkey)", "c_custkey % 300 + 1", "c_custkey % 300 + 9"))
    brands = t("customer").where("c_custkey between 11 and 55").selectExpr(*_symbols("c_custkey + 6000000", "c_custkey % 25", "'class'", "concat('Brand', c_custkey)", "concat('Brand', c_custkey)", "1", "900"))

    shipped, ordered = "unix_date(cast(l_shipdate as date)) * 86400L", "unix_date(cast(o_orderdate as date)) * 86400L"
    path = "concat('/api/orders/', o_orderkey % 1000)"
    edges = [
        t("lineitem").selectExpr(*_edges("l_orderkey + 3000000", "if(l_linenumber % 5 <> 0, l_partkey + 1000000, null)", "case l_returnflag when 'R' then 'CALLS' when 'A' then 'IMPORTS' else 'XREF' end", "concat('lib.part_', l_partkey div 3)", "l_suppkey % 25", "l_linenumber", "round(l_discount * 10, 4)", shipped, "concat('trace_', l_orderkey % 100)")),
        t("lineitem").where("l_linenumber = 1").selectExpr(*_edges("l_partkey + 1000000", "l_suppkey + 2000000", "'CONFIG_BIND'", "concat('env://S', l_suppkey)", "l_partkey % 25", "1", "0.8", shipped)),
        t("orders").selectExpr(*_edges("o_custkey + 20000000", "o_orderkey + 3000000", "'HTTP_CALL'", path, "o_custkey % 25", "o_orderkey % 50 + 1", "0.9", ordered, detail=f"""concat('{{"framework":"fetch","method":"GET","path":"', {path}, '"}}')""")),
        t("part").where("p_partkey % 10 = 0").selectExpr(*_edges("p_partkey + 1000000", "null", "'HTTP_ROUTE'", "concat('/api/orders/', p_partkey % 1000)", "p_partkey % 25", "p_partkey % 50 + 1", "0.85")),
        t("part").where("p_partkey % 6 in (1, 2)").selectExpr(*_edges("p_partkey + 1000000", "p_partkey * 7 % 1000 + 1000001", "case when p_partkey % 12 = 1 then 'EXTENDS' when p_partkey % 6 = 1 then 'IMPLEMENTS' else 'CONTAINS' end", "concat('lib.part_', (p_partkey * 7 % 1000 + 1) div 3)", "p_partkey % 25", "p_partkey % 70 + 1", "0.7")),
        t("supplier").selectExpr(*_edges("s_suppkey + 2000000", "null", "'RPC_IMPL'", "concat('/orders/get', s_suppkey % 50)", "s_suppkey % 25", "s_suppkey % 50 + 1", "0.75", detail="""concat('{"service":"Orders","rpc":"Get', s_suppkey % 50, '"}')""")),
        t("customer").where("c_custkey % 10 = 0").selectExpr(*_edges("c_custkey + 20000000", "null", "'RPC_CALL'", "concat('/orders/get', c_custkey % 50)", "c_custkey % 25", "c_custkey % 50 + 1", "0.65")),
    ]
    metrics = t("part").selectExpr("cast(p_partkey + 1000000 as long) as symbol_id", "cast(p_size + 1 as long) as loc", "cast(p_size as long) as complexity", "md5(concat(p_name, p_brand)) as duplication_hash")
    return Graph(files, reduce(DataFrame.unionByName, [parts, earlier, suppliers, orders, customers, brands]), reduce(DataFrame.unionByName, edges), metrics)


PREFIX = f"""
WITH RECURSIVE g_files AS (
  SELECT CAST(1000 + n_nationkey AS BIGINT) AS file_id, r_name || '/' || n_name || '/' || CASE n_nationkey % 6 WHEN 5 THEN 'tests/' WHEN 4 THEN 'integration/' WHEN 1 THEN 'e2e/' ELSE '' END || 'core.py' AS path, r_name AS language,
         CAST(CASE WHEN n_nationkey % 7 = 3 THEN 2 END AS BIGINT) AS deleted_version
  FROM nation JOIN region ON n_regionkey = r_regionkey
), named AS (
  SELECT *, CASE WHEN p_partkey % 97 = 5 THEN 'setup' ELSE 'part_' || (p_partkey // 3) END AS name,
         CASE p_type WHEN 'PROMO' THEN 'function' WHEN 'STANDARD' THEN 'method' WHEN 'ECONOMY' THEN 'class' WHEN 'SMALL' THEN 'struct' WHEN 'LARGE' THEN 'module' WHEN 'MEDIUM' THEN CASE WHEN p_partkey % 2 = 0 THEN 'property' ELSE 'variable' END END AS kind
  FROM part
), g_symbols AS (
  SELECT CAST(p_partkey + 1000000 AS BIGINT) AS id, CAST(p_partkey % 25 + 1000 AS BIGINT) AS file_id, kind, name,
         replace(p_brand, '#', '') || CASE WHEN p_partkey % 3 < 2 THEN '.' ELSE '::' END || name AS qualname,
         CAST(p_partkey * 13 % 900 + 1 AS BIGINT) AS start_line, CAST(p_partkey * 13 % 900 + 1 + p_size AS BIGINT) AS end_line, '(' || p_name || ')' AS signature, CAST({VERSION} AS BIGINT) AS graph_version
  FROM named
  UNION ALL SELECT p_partkey + 5000000, p_partkey % 25 + 1000, kind, name, replace(p_brand, '#', '') || '.' || name, p_partkey * 13 % 900 + 1, p_partkey * 13 % 900 + 1 + p_size,
         CASE p_partkey % 4 WHEN 0 THEN '(' || p_name || ', old)' WHEN 1 THEN '(' || p_name || ')' END, {VERSION - 1}
  FROM named WHERE p_partkey % 3 = 0
  UNION ALL SELECT s_suppkey + 2000000, s_nationkey + 1000, 'interface', 'supplier_' || s_suppkey, 'supply.supplier_' || s_suppkey, s_suppkey % 500 + 1, s_suppkey % 500 + 21, NULL, {VERSION} FROM supplier
  UNION ALL SELECT o_orderkey + 3000000, o_custkey % 25 + 1000, 'function', CASE WHEN o_orderkey % 10 = 0 THEN 'test_part_' || (o_orderkey % 3000) ELSE 'order_' || o_orderkey END,
         'orders.' || lower(o_orderstatus) || '.' || CASE WHEN o_orderkey % 10 = 0 THEN 'test_part_' || (o_orderkey % 3000) ELSE 'order_' || o_orderkey END, o_orderkey % 800 + 1, o_orderkey % 800 + 1 + o_orderkey % 40, NULL, {VERSION} FROM orders
  UNION ALL SELECT c_custkey + 20000000, c_nationkey + 1000, 'service', 'customer_' || c_custkey, lower(c_mktsegment) || '.customer_' || c_custkey, c_custkey % 300 + 1, c_custkey % 300 + 9, NULL, {VERSION} FROM customer
  UNION ALL SELECT c_custkey + 6000000, c_custkey % 25 + 1000, 'class', 'Brand' || c_custkey, 'Brand' || c_custkey, 1, 900, NULL, {VERSION} FROM customer WHERE c_custkey BETWEEN 11 AND 55
), g_edges AS (
  SELECT CAST(l_orderkey + 3000000 AS BIGINT) AS source, CAST(CASE WHEN l_linenumber % 5 <> 0 THEN l_partkey + 1000000 END AS BIGINT) AS target,
         CASE l_returnflag WHEN 'R' THEN 'CALLS' WHEN 'A' THEN 'IMPORTS' ELSE 'XREF' END AS kind, 'lib.part_' || (l_partkey // 3) AS target_qualname,
         CAST(l_suppkey % 25 + 1000 AS BIGINT) AS file_id, CAST(l_linenumber AS BIGINT) AS line, round(l_discount * 10, 4) AS confidence,
         CAST(epoch(CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP)) AS BIGINT) AS event_ts, 'trace_' || (l_orderkey % 100) AS trace_id, CAST(NULL AS VARCHAR) AS detail, CAST({VERSION} AS BIGINT) AS graph_version
  FROM lineitem
  UNION ALL SELECT l_partkey + 1000000, l_suppkey + 2000000, 'CONFIG_BIND', 'env://S' || l_suppkey, l_partkey % 25 + 1000, 1, CAST(0.8 AS DOUBLE), CAST(epoch(CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP)) AS BIGINT), NULL, NULL, {VERSION} FROM lineitem WHERE l_linenumber = 1
  UNION ALL SELECT o_custkey + 20000000, o_orderkey + 3000000, 'HTTP_CALL', '/api/orders/' || (o_orderkey % 1000), o_custkey % 25 + 1000, o_orderkey % 50 + 1, CAST(0.9 AS DOUBLE), CAST(epoch(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)) AS BIGINT), NULL, '{{"framework":"fetch","method":"GET","path":"/api/orders/' || (o_orderkey % 1000) || '"}}', {VERSION} FROM orders
  UNION ALL SELECT p_partkey + 1000000, NULL, 'HTTP_ROUTE', '/api/orders/' || (p_partkey % 1000), p_partkey % 25 + 1000, p_partkey % 50 + 1, CAST(0.85 AS DOUBLE), NULL, NULL, NULL, {VERSION} FROM part WHERE p_partkey % 10 = 0
  UNION ALL SELECT p_partkey + 1000000, p_partkey * 7 % 1000 + 1000001, CASE WHEN p_partkey % 12 = 1 THEN 'EXTENDS' WHEN p_partkey % 6 = 1 THEN 'IMPLEMENTS' ELSE 'CONTAINS' END, 'lib.part_' || ((p_partkey * 7 % 1000 + 1) // 3), p_partkey % 25 + 1000, p_partkey % 70 + 1, CAST(0.7 AS DOUBLE), NULL, NULL, NULL, {VERSION} FROM part WHERE p_partkey % 6 IN (1, 2)
  UNION ALL SELECT s_suppkey + 2000000, NULL, 'RPC_IMPL', '/orders/get' || (s_suppkey % 50), s_suppkey % 25 + 1000, s_suppkey % 50 + 1, CAST(0.75 AS DOUBLE), NULL, NULL, '{{"service":"Orders","rpc":"Get' || (s_suppkey % 50) || '"}}', {VERSION} FROM supplier
  UNION ALL SELECT c_custkey + 20000000, NULL, 'RPC_CALL', '/orders/get' || (c_custkey % 50), c_custkey % 25 + 1000, c_custkey % 50 + 1, CAST(0.65 AS DOUBLE), NULL, NULL, NULL, {VERSION} FROM customer WHERE c_custkey % 10 = 0
), g_metrics AS (
  SELECT CAST(p_partkey + 1000000 AS BIGINT) AS symbol_id, CAST(p_size + 1 AS BIGINT) AS loc, CAST(p_size AS BIGINT) AS complexity, md5(p_name || p_brand) AS duplication_hash FROM part
), f AS (
  SELECT * FROM g_files WHERE deleted_version IS NULL OR deleted_version > {VERSION}
), s AS (
  SELECT g_symbols.*, path, language FROM g_symbols JOIN f USING (file_id) WHERE graph_version = {VERSION}
), e AS (
  SELECT g_edges.*, path, language FROM g_edges JOIN f USING (file_id) WHERE graph_version = {VERSION}
)
"""
