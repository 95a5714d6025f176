"""Column expressions over steps between languages: kinds of boundaries, their texts and protocols."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Boundaries by edge kind, what they are called, and how languages are written.
BOUNDARIES = {"grpc": ("RPC_IMPL", "RPC_CALL", "RPC_ROUTE"), "http": ("HTTP_CALL", "HTTP_ROUTE"), "message_bus": ("CHANNEL_PUBLISH", "CHANNEL_SUBSCRIBE"), "config": ("CONFIG_SOURCE", "CONFIG_READ")}
BOUNDARY_TEXTS = {"grpc": "gRPC", "http": "HTTP", "message_bus": "message bus", "config": "config/env", "stored_procedure": "stored procedure", "xref": "cross-reference"}
LANGUAGE_TEXTS = {"csharp": "C#", "javascript": "JavaScript", "typescript": "TypeScript", "tsx": "TypeScript"}


def plain_language(language: Column) -> Column:
    """The language by which boundaries are told: tsx is typescript, none is unknown."""
    return F.when(language == "tsx", "typescript").otherwise(F.coalesce(language, F.lit("unknown")))


def boundary_type(kind: Column, source: Column, target: Column) -> Column:
    procedure = (source == "csharp") & (target == "sql") | (source == "sql") & (target == "csharp")
    out = F.when((kind == "XREF") & procedure, "stored_procedure").when(kind == "XREF", "xref")
    for name, kinds in BOUNDARIES.items():
        out = out.when(kind.isin(*kinds), name)
    return out.otherwise("other")


def _named(names: dict[str, str], value: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), value)


def boundary_detail(kind: Column, source: Column, target: Column) -> Column:
    """``Python -> C# via HTTP`` and the like, with an arrow."""
    show = lambda language: F.coalesce(_named(LANGUAGE_TEXTS, language), language, F.lit("unknown"))
    via = _named(BOUNDARY_TEXTS, kind)
    return F.concat(show(source), F.lit(" \u2192 "), show(target), F.when(via.isNotNull(), F.concat(F.lit(" via "), via)).otherwise(""))


def protocol_context(kind: Column, detail: Column) -> Column:
    """JSON of what an edge's detail says about the protocol; null if nothing."""
    get = lambda name: F.get_json_object(detail, f"$.{name}")
    either = lambda name, other: F.coalesce(get(name), F.lit(other)).alias(name)
    rpc = F.when(get("service").isNotNull() & get("rpc").isNotNull(), F.to_json(F.struct(either("framework", "grpc"), get("service").alias("service"), get("rpc").alias("rpc"), get("package").alias("package"))))
    channel = F.to_json(F.struct(either("framework", "unknown"), get("channel").alias("channel"), either("role", "unknown")))
    config = F.to_json(F.struct(either("source_type", "env"), get("config_uri").alias("config_uri"), either("role", "unknown")))
    http = F.to_json(F.struct(either("framework", "http"), get("method").alias("method"), get("path").alias("path")))
    forms = {"grpc": rpc, "message_bus": channel, "config": config, "http": http}
    sound = F.try_parse_json(detail).isNotNull()
    out = F.when(~sound | detail.isNull(), F.lit(None).cast("string"))
    for name, form in forms.items():
        out = out.when(kind.isin(*BOUNDARIES[name]), form)
    return out
