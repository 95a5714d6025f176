"""Column expressions that bring channels, settings, routes and methods to one form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Classes that hold topic names; receivers and methods of message buses; HTTP methods.
TOPIC_CONTAINERS = ("Topics", "TopicName", "TopicNames", "Topic", "Channels", "Channel", "Queues", "Queue", "QueueName", "QueueNames", "EventType", "EventTypes", "Subjects", "Subject")
BUS_RECEIVERS = ("_bus", "_messages", "_messageBus", "bus", "Bus", "messageBus", "MessageBus", "_publisher", "publisher", "_eventBus", "eventBus", "_serviceBus", "serviceBus", "_queue", "_channel")
PUBLISH_METHODS = ("PublishAsync", "Publish", "publish", "publish_async", "SendAsync", "Send", "send", "emit", "Emit", "dispatch", "Dispatch")
SUBSCRIBE_METHODS = ("SubscribeAsync", "Subscribe", "subscribe", "subscribe_async", "on", "On", "AddHandler", "add_handler", "listen", "Listen")
HTTP_METHODS = ("GET", "POST", "PUT", "PATCH", "DELETE", "OPTIONS", "HEAD")

PARAMETER = "{}"
ROUTE_MOST = 200


def _filled(value: Column) -> Column:
    return F.when(value != "", value)


def channel(raw: Column) -> Column:
    """``channel://`` and the topic's name without container, underscores and case; null if empty."""
    value = F.trim(raw)
    holder = F.substring_index(F.substring_index(value, ".", 1), ".", -1)
    topic = F.when(value.contains(".") & holder.isin(*TOPIC_CONTAINERS), F.regexp_replace(value, r"^[^.]*\.", "")).otherwise(value)
    name = _filled(F.lower(F.replace(topic, F.lit("_"), F.lit(""))))
    return F.when(name.isNotNull(), F.concat(F.lit("channel://"), name))


def bus_role(receiver: Column, method: Column) -> Column:
    """publisher or subscriber for a method call on a message bus, else null."""
    bus = F.trim(F.substring_index(receiver, ".", -1)).isin(*BUS_RECEIVERS)
    return F.when(bus & method.isin(*PUBLISH_METHODS), "publisher").when(bus & method.isin(*SUBSCRIBE_METHODS), "subscriber")


def env(raw: Column) -> Column:
    name = _filled(F.upper(F.trim(raw)))
    return F.when(name.isNotNull(), F.concat(F.lit("env://"), name))


def secret(raw: Column) -> Column:
    name = _filled(F.lower(F.trim(raw)))
    return F.when(name.isNotNull(), F.concat(F.lit("secret://"), name))


def http_method(raw: Column) -> Column:
    """An HTTP method in upper case, ANY for all, null if it is none."""
    upper = F.upper(F.regexp_replace(F.trim(raw), '^"+|"+$', ""))
    short = F.regexp_replace(upper, "(.)ASYNC$", "$1")
    return F.when(upper.isin("ALL", "ANY"), "ANY").when(upper.isin(*HTTP_METHODS), upper).when(short.isin(*HTTP_METHODS), short)


def route(raw: Column) -> Column:
    """A route's path in lower case with ``{}`` for parameters, numbers and ids; null if it is no route."""
    value = F.trim(raw)
    usable = (F.octet_length(value) <= ROUTE_MOST) & ~value.rlike(r"[\s\\]") & ~value.rlike(r"^\.\.?/")
    bare = F.regexp_replace(F.regexp_replace(value, "^https?://[^/]*(?=/)", ""), "[?#].*$", "")
    path = F.regexp_replace(F.regexp_replace(bare, "/+", "/"), "(.)/$", "$1")

    def segment(part: Column) -> Column:
        open_ = part.rlike(r"^[:{<$]|\$\{|\*|^[0-9]+$")
        identity = part.rlike("^[0-9A-Fa-f-]+$") & part.contains("-") & (F.length(F.replace(part, F.lit("-"), F.lit(""))) >= 16)
        return F.when(open_ | identity, PARAMETER).otherwise(part)

    out = F.lower(F.concat(F.lit("/"), F.array_join(F.transform(F.split(F.regexp_replace(path, "^/", ""), "/"), segment), "/")))
    return F.when(usable & bare.startswith("/") & out.rlike("[a-z]"), out)


def join_route(prefix: Column, suffix: Column) -> Column:
    """Two parts of a route with one slash between them."""
    left, right = F.regexp_replace(F.coalesce(prefix, F.lit("")), "/+$", ""), F.regexp_replace(F.coalesce(suffix, F.lit("")), "^/+", "")
    return F.when(right == "", F.when(left == "", "/").otherwise(left)).otherwise(F.concat(left, F.lit("/"), right))


def rpc_path(package: Column, service: Column, method: Column) -> Column:
    owner = F.when(F.coalesce(package, F.lit("")) == "", service).otherwise(F.concat_ws(".", package, service))
    return route(F.concat(F.lit("/"), owner, F.lit("/"), method))
