"""Symbols and edges of source files, by language.

``extract`` runs the language's extractor on every file with ``mapInArrow``, one file at a time, so
memory is bounded by the largest file. Python is parsed; other languages are read by declarations
and calls at the level of tokens. Every extractor gives the same rows:

symbols: kind, name, qualname, start_line, end_line, signature
edges: kind, source_qualname, target_qualname, line, detail (JSON)
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from spanloom.operators.shared import bounded_batches
from pyspark.sql import functions as F

ROW = "path string, language string, item string, kind string, name string, qualname string, start_line long, end_line long, signature string, source_qualname string, target_qualname string, detail string"
Found = list[dict]

# Names by which libraries register routes, make calls and read settings.
VERBS = ("get", "post", "put", "patch", "delete", "options", "head")
CLIENTS = ("requests", "httpx", "session", "client", "axios", "http", "fetch")


def symbol(kind: str, name: str, qualname: str, start: int, end: int, signature: str | None = None) -> dict:
    return {"item": "symbol", "kind": kind, "name": name, "qualname": qualname, "start_line": start, "end_line": end, "signature": signature}


def edge(kind: str, source: str, target: str, line: int, **detail: str) -> dict:
    return {"item": "edge", "kind": kind, "source_qualname": source, "target_qualname": target, "start_line": line, "detail": json.dumps(detail, sort_keys=True) if detail else None}


def module_name(path: str, language: str) -> str:
    stem = re.sub(r"\.[^./]+$", "", path)
    if language == "python":
        return re.sub(r"(^|\.)__init__$", "", stem.replace("/", "."))
    if language == "rust":
        return re.sub(r"(::)?(mod|lib|main)$", "", re.sub("^src/", "", stem).replace("/", "::")) or "crate"
    return stem.replace("/", ".")


class _Python(ast.NodeVisitor):
    """Definitions, calls, imports, routes, requests and settings of a module."""

    def __init__(self, module: str):
        self.scope, self.kinds, self.out = [module], ["module"], []

    def add(self, node: ast.AST, kind: str, signature: str | None) -> None:
        name = f"{self.scope[-1]}.{node.name}"
        self.out += [symbol(kind, node.name, name, node.lineno, node.end_lineno, signature), edge("CONTAINS", self.scope[-1], name, node.lineno)]
        for decorator in node.decorator_list:
            call = decorator if isinstance(decorator, ast.Call) else None
            if call and isinstance(call.func, ast.Attribute) and call.args and isinstance(call.args[0], ast.Constant) and isinstance(call.args[0].value, str):
                verbs = [call.func.attr.upper()] if call.func.attr in VERBS else []
                if call.func.attr == "route":
                    verbs = next(([e.value for e in k.value.elts if isinstance(e, ast.Constant)] for k in call.keywords if k.arg == "methods" and isinstance(k.value, (ast.List, ast.Tuple))), ["ANY"])
                self.out += [edge("HTTP_ROUTE", name, call.args[0].value, decorator.lineno, method=v) for v in verbs]
        self.scope.append(name)
        self.kinds.append(kind)
        self.generic_visit(node)
        self.scope.pop()
        self.kinds.pop()

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self.out += [edge("EXTENDS", f"{self.scope[-1]}.{node.name}", ast.unparse(b), node.lineno) for b in node.bases]
        self.add(node, "class", None)

    def visit_FunctionDef(self, node: ast.FunctionDef) -> None:
        self.add(node, "method" if self.kinds[-1] == "class" else "function", f"({ast.unparse(node.args)})")

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Import(self, node: ast.Import) -> None:
        self.out += [edge("IMPORTS", self.scope[0], a.name, node.lineno) for a in node.names]

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        parts = self.scope[0].split(".")
        base = ".".join(parts[: len(parts) - node.level]) if node.level else ""
        owner = ".".join(filter(None, [base, node.module or ""]))
        self.out += [edge("IMPORTS", self.scope[0], f"{owner}.{a.name}" if owner else a.name, node.lineno) for a in node.names]

    def visit_Call(self, node: ast.Call) -> None:
        target = ast.unparse(node.func)
        first = node.args[0].value if node.args and isinstance(node.args[0], ast.Constant) and isinstance(node.args[0].value, str) else None
        here = self.scope[-1]
        self.out.append(edge("CALLS", here, target, node.lineno))
        head, _, last = target.rpartition(".")
        if first is not None and last in VERBS and head.split(".")[-1] in CLIENTS:
            self.out.append(edge("HTTP_CALL", here, first, node.lineno, method=last.upper()))
        if first is not None and target in ("os.getenv", "os.environ.get", "getenv"):
            self.out.append(edge("CONFIG_READ", here, f"env://{first.upper()}", node.lineno))
        if first is not None and head.split(".")[-1] in ("bus", "publisher", "queue", "channel", "_bus", "_publisher") and last in ("publish", "send", "emit", "subscribe", "on", "listen"):
            self.out.append(edge("CHANNEL_SUBSCRIBE" if last in ("subscribe", "on", "listen") else "CHANNEL_PUBLISH", here, "channel://" + first.replace("_", "").lower(), node.lineno))
        self.generic_visit(node)

    def visit_Subscript(self, node: ast.Subscript) -> None:
        if ast.unparse(node.value) == "os.environ" and isinstance(node.slice, ast.Constant):
            self.out.append(edge("CONFIG_READ", self.scope[-1], f"env://{str(node.slice.value).upper()}", node.lineno))
        self.generic_visit(node)


def python(text: str, module: str) -> Found:
    tree = ast.parse(text)
    walk = _Python(module)
    walk.visit(tree)
    return [symbol("module", module.split(".")[-1], module, 1, text.count("\n") + 1), *walk.out]


def lines_of(text: str) -> Callable[[int], int]:
    """The line number of a place in a text."""
    import bisect

    ends = [m.start() for m in re.finditer("\n", text)]
    return lambda at: bisect.bisect_left(ends, at) + 1


def closing(text: str, start: int) -> int:
    """The place of the brace that closes the first one at or after ``start``; quotes are skipped."""
    depth = 0
    for m in re.compile(r"""//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|[{};]""", re.S).finditer(text, start):
        sign = m.group()
        if sign == "{":
            depth += 1
        elif sign == "}":
            depth -= 1
            if depth <= 0:
                return m.start()
        elif sign == ";" and depth == 0:
            return m.start()
    return len(text)


# Declarations by language, as (pattern with the group ``name``, kind).
DECLARATIONS = {
    "rust": ((r"\bfn\s+(?P<name>\w+)", "function"), (r"\bstruct\s+(?P<name>\w+)", "struct"), (r"\benum\s+(?P<name>\w+)", "enum"), (r"\btrait\s+(?P<name>\w+)", "trait"), (r"\bmod\s+(?P<name>\w+)", "module"), (r"\bconst\s+(?P<name>[A-Z]\w*)\s*:", "const")),
    "go": ((r"\bfunc\s+(?P<name>[A-Za-z_]\w*)\s*[(\[]", "function"), (r"\bfunc\s+\([^)]*\)\s*(?P<name>\w+)\s*\(", "method"), (r"\btype\s+(?P<name>\w+)\s+struct\b", "struct"), (r"\btype\s+(?P<name>\w+)\s+interface\b", "interface")),
    "javascript": ((r"\bfunction\s*\*?\s*(?P<name>[A-Za-z_$][\w$]*)", "function"), (r"\bclass\s+(?P<name>[A-Za-z_$][\w$]*)", "class"), (r"\b(?:const|let|var)\s+(?P<name>[A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:\([^()]*\)|[A-Za-z_$][\w$]*)\s*=>", "function"), (r"\binterface\s+(?P<name>[A-Za-z_$][\w$]*)", "interface"), (r"\benum\s+(?P<name>[A-Za-z_$][\w$]*)", "enum"), (r"^\s+(?:async\s+|static\s+)*(?P<name>(?!(?:if|for|while|switch|catch|function|return)\b)[A-Za-z_$][\w$]*)\s*\([^()]*\)\s*(?::[^{;=]+)?\{", "method")),
    "csharp": ((r"\bnamespace\s+(?P<name>[\w.]+)", "namespace"), (r"\bclass\s+(?P<name>\w+)", "class"), (r"\binterface\s+(?P<name>\w+)", "interface"), (r"\brecord\s+(?:struct\s+|class\s+)?(?P<name>\w+)", "record"), (r"\bstruct\s+(?P<name>\w+)", "struct"), (r"\benum\s+(?P<name>\w+)", "enum"), (r"\b(?:public|private|protected|internal|static|async|override|virtual)\s+(?:[\w<>\[\],.?]+\s+)+(?P<name>\w+)\s*\([^()]*\)\s*(?:=>|\{)", "method")),
}
IMPORTS = {"rust": r"\buse\s+([\w:]+)", "go": r'^\s*(?:import\s+)?(?:\w+\s+)?"([\w./-]+)"\s*$', "javascript": r"""(?:\bfrom\s+|\brequire\(\s*|\bimport\s+)["']([^"']+)["']""", "csharp": r"^\s*using\s+(?:static\s+)?([\w.]+)\s*;"}
EXTENDS = {"javascript": r"\bclass\s+([\w$]+)(?:<[^>]*>)?\s+extends\s+([\w$.]+)", "csharp": r"\b(?:class|record|interface)\s+(\w+)[^{;:]*:\s*([\w.]+)", "rust": r"\bimpl(?:<[^>]*>)?\s+(?:[\w:]+::)?(\w+)(?:<[^>]*>)?\s+for\s+(\w+)"}
ROUTES = {
    "javascript": r"""\b(?:app|router|server|fastify)\.(get|post|put|patch|delete|options|head|all)\(\s*["'`]([^"'`]+)["'`]""",
    "csharp": r"""(?:\bMap|\[Http)(Get|Post|Put|Patch|Delete)\(\s*"([^"]+)\"""",
    "go": r"""\.(GET|POST|PUT|PATCH|DELETE|HandleFunc|Handle)\(\s*"([^"]+)\"""",
    "rust": r"""(?:#\[|\.)(get|post|put|patch|delete|route)\(\s*"([^"]+)\"""",
}
REQUESTS = {"javascript": r"""\b(?:axios|http)\.(get|post|put|patch|delete)\(\s*["'`]([^"'`]+)["'`]|\bfetch\(\s*["'`]([^"'`]+)["'`]""", "csharp": r"""\.(Get|Post|Put|Patch|Delete)(?:\w*Async)\(\s*"([^"]+)\"""", "go": r"""\bhttp\.(Get|Post|Head)\(\s*"([^"]+)\"""", "rust": r"""\b(?:client|reqwest)(?:::|\.)(get|post|put|delete)\(\s*"([^"]+)\""""}
SETTINGS = {"javascript": r"process\.env\.([A-Za-z_]\w*)|process\.env\[[\"']([^\"']+)[\"']\]", "csharp": r"""GetEnvironmentVariable\(\s*"([^"]+)\"""", "go": r"""os\.(?:Getenv|LookupEnv)\(\s*"([^"]+)\"""", "rust": r"""env::var\(\s*"([^"]+)\"|env!\(\s*"([^"]+)\""""}
CHANNELS = r"""\b(?:bus|_bus|messageBus|MessageBus|_messageBus|publisher|_publisher|eventBus|_eventBus|serviceBus|_serviceBus)\.(\w+)\(\s*(?:"([^"]+)"|'([^']+)'|([\w.]+))"""
RESERVED = frozenset("if for while switch catch return match loop fn func function sizeof typeof new await using lock foreach nameof super assert".split())


def braces(language: str) -> Callable[[str, str], Found]:
    """An extractor for a language with braces."""

    def run(text: str, module: str) -> Found:
        line = lines_of(text)
        spans = []
        for pattern, kind in DECLARATIONS[language]:
            for m in re.finditer(pattern, text, re.M):
                spans.append((m.start("name"), closing(text, m.end()), kind, m.group("name"), m))
        spans.sort(key=lambda s: (s[0], -s[1]))
        out = [symbol("module", module.split("::" if language == "rust" else ".")[-1], module, 1, text.count("\n") + 1)]
        open_: list[tuple[int, str, str]] = []
        owners: list[tuple[int, int, str]] = []
        glue = "::" if language == "rust" else "."
        for start, end, kind, name, m in spans:
            while open_ and open_[-1][0] < start:
                open_.pop()
            parent = open_[-1][1] if open_ else module
            own = f"{parent}{glue}{name}"
            if kind == "function" and open_ and open_[-1][2] in ("class", "struct", "trait", "interface"):
                kind = "method"
            rest = re.match(r"\s*(?:<[^>]*>)?\s*(\([^)]*\))", text[m.end("name") :])
            out += [symbol(kind, name, own, line(start), line(end), rest.group(1) if rest and kind in ("function", "method") else None), edge("CONTAINS", parent, own, line(start))]
            owners.append((start, end, own))
            open_.append((end, own, kind))

        def owner(at: int) -> str:
            around = [o for o in owners if o[0] <= at <= o[1]]
            return max(around)[2] if around else module

        for m in re.finditer(IMPORTS[language], text, re.M):
            out.append(edge("MODULE_FILE" if language == "javascript" and m.group(1).startswith(".") else "IMPORTS", module, m.group(1), line(m.start())))
        for m in re.finditer(EXTENDS[language], text) if language in EXTENDS else ():
            a, b = (m.group(2), m.group(1)) if language == "rust" else m.groups()
            out.append(edge("IMPLEMENTS" if language == "rust" else "EXTENDS", f"{module}{glue}{a}", b, line(m.start())))
        for m in re.finditer(ROUTES[language], text):
            verb = m.group(1).upper().removeprefix("MAP")
            out.append(edge("HTTP_ROUTE", owner(m.start()), m.group(2), line(m.start()), method=verb if verb.lower() in VERBS else "ANY"))
        for m in re.finditer(REQUESTS[language], text):
            got = [g for g in m.groups() if g]
            out.append(edge("HTTP_CALL", owner(m.start()), got[-1], line(m.start()), method=got[0].upper() if len(got) > 1 else "GET"))
        for m in re.finditer(SETTINGS[language], text):
            out.append(edge("CONFIG_READ", owner(m.start()), "env://" + next(g for g in m.groups() if g).upper(), line(m.start())))
        for m in re.finditer(CHANNELS, text):
            verb = m.group(1).lower().removesuffix("async")
            if verb in ("publish", "send", "emit", "dispatch", "subscribe", "on", "listen", "addhandler"):
                raw = next(g for g in m.groups()[1:] if g)
                out.append(edge("CHANNEL_SUBSCRIBE" if verb in ("subscribe", "on", "listen", "addhandler") else "CHANNEL_PUBLISH", owner(m.start()), "channel://" + raw.split(".")[-1].replace("_", "").lower(), line(m.start())))
        declared = {s[0] for s in spans}
        for m in re.finditer(r"([A-Za-z_$][\w$]*(?:(?:\.|::)[A-Za-z_$][\w$]*)*)!?\s*\(", text):
            last = re.split(r"\.|::", m.group(1))[-1]
            if last not in RESERVED and m.start() not in declared and m.end(1) - len(last) not in declared:
                out.append(edge("CALLS", owner(m.start()), m.group(1), line(m.start())))
        return out

    return run


SQL_OBJECTS = "table|view|materialized view|function|procedure|index|trigger|type|schema|sequence|database|extension|role"


def sql(text: str, module: str) -> Found:
    """DDL objects, foreign keys as REFERENCES, and calls from bodies and triggers."""
    line, out = lines_of(text), []
    for m in re.finditer(rf"\bcreate\s+(?:or\s+(?:replace|alter)\s+)?(?:unique\s+|temp(?:orary)?\s+|global\s+)*({SQL_OBJECTS})\s+(?:concurrently\s+)?(?:if\s+not\s+exists\s+)?([\w.\"\[\]]+)", text, re.I):
        kind, name = re.sub(r"\s+", "_", m.group(1).lower()), re.sub(r'["\[\]]', "", m.group(2))
        body_end = re.compile(r"\$\$.*?\$\$[^;]*;|;|\bgo\b", re.S | re.I).search(text, m.end())
        end = body_end.end() if body_end else len(text)
        out += [symbol("function" if kind == "procedure" else kind, name.split(".")[-1], name, line(m.start()), line(end - 1)), edge("CONTAINS", module, name, line(m.start()))]
        body = text[m.end() : end]
        out += [edge("REFERENCES", name, re.sub(r'["\[\]]', "", r.group(1)), line(m.end() + r.start())) for r in re.finditer(r"\breferences\s+([\w.\"\[\]]+)", body, re.I)]
        if kind in ("view", "materialized_view"):
            out += [edge("REFERENCES", name, r.group(1), line(m.end() + r.start())) for r in re.finditer(r"\b(?:from|join)\s+([\w.]+)", body, re.I)]
        if kind in ("function", "procedure", "trigger"):
            out += [edge("CALLS", name, r.group(1), line(m.end() + r.start())) for r in re.finditer(r"\b(?:perform|execute(?:\s+(?:function|procedure))?|exec|call)\s+([\w.]+)", body, re.I)]
    for n, m in enumerate(re.finditer(r"\bdo\s+\$\$", text, re.I), 1):
        end = text.find("$$", m.end())
        out.append(symbol("do_block", f"do_{n}", f"{module}.do_{n}", line(m.start()), line(end if end >= 0 else len(text))))
    return out


def proto(text: str, module: str) -> Found:
    """Services and their calls, with the path of each."""
    bare = re.sub(r"//[^\n]*", lambda m: " " * len(m.group()), text)
    line = lines_of(bare)
    package = re.search(r"\bpackage\s+([\w.]+)\s*;", bare)
    prefix = package.group(1) + "." if package else ""
    out = []
    for m in re.finditer(r"\bservice\s+(\w+)", bare):
        end, own = closing(bare, m.end()), prefix + m.group(1)
        out.append(symbol("service", m.group(1), own, line(m.start()), line(end)))
        for r in re.finditer(r"\brpc\s+(\w+)\s*(\([^)]*\)\s*returns\s*\([^)]*\))", bare[m.end() : end]):
            at, name = line(m.end() + r.start()), f"{own}.{r.group(1)}"
            out += [symbol("rpc", r.group(1), name, at, at, re.sub(r"\s+", " ", r.group(2))), edge("CONTAINS", own, name, at), edge("RPC_ROUTE", name, f"/{own}/{r.group(1)}".lower(), at)]
    return out


def yaml(text: str, module: str) -> Found:
    """Kubernetes resources, containers, and settings they give."""
    out, at = [], 1
    for part in re.split(r"(?m)^---\s*$", text):
        kind, name = re.search(r"(?m)^kind:\s*(\w+)", part), re.search(r"(?ms)^metadata:\s*\n(?:[ \t]+.*\n)*?[ \t]+name:\s*[\"']?([\w.-]+)", part)
        count = part.count("\n")
        if kind and name:
            own = f"{kind.group(1).lower()}/{name.group(1)}"
            out.append(symbol(kind.group(1).lower(), name.group(1), own, at, at + count))
            line = lines_of(part)
            for m in re.finditer(r"(?m)^[ \t]+- name:\s*[\"']?([\w.-]+)[\"']?\s*\n[ \t]+image:", part):
                out += [symbol("container", m.group(1), f"{own}/{m.group(1)}", at + line(m.start()), at + line(m.start())), edge("CONTAINS", own, f"{own}/{m.group(1)}", at + line(m.start()))]
            for m in re.finditer(r"(?m)^[ \t]+- name:\s*[\"']?([A-Za-z_]\w*)[\"']?\s*\n[ \t]+value(?:From)?:", part):
                words = m.group(1).split("__")
                out += [edge("CONFIG_SOURCE", own, "env://" + "__".join(words[:k]).upper(), at + line(m.start())) for k in range(1, len(words) + 1)]
            out += [edge("CONFIG_SOURCE", own, f"secret://{m.group(1).lower()}", at + line(m.start())) for m in re.finditer(r"secretKeyRef:\s*\n(?:[ \t]+.*\n)*?[ \t]+name:\s*[\"']?([\w.-]+)", part)]
        at += count
    return out


def bicep(text: str, module: str) -> Found:
    """Resources, modules, parameters, variables and outputs; uses of names; topics and secrets."""
    line, out, known = lines_of(text), [], {}
    for m in re.finditer(r"(?m)^\s*(resource|module|param|var|output|type|func)\s+(\w+)(?:\s+'([^']*)')?", text):
        own = f"{module}.{m.group(2)}"
        known[m.group(2)] = own
        end = closing(text, m.end()) if m.group(1) in ("resource", "module") else m.end()
        out += [symbol(m.group(1), m.group(2), own, line(m.start(2)), line(end), m.group(3)), edge("CONTAINS", module, own, line(m.start(2)))]
        if m.group(1) == "module" and m.group(3):
            out.append(edge("MODULE_FILE", own, m.group(3), line(m.start(2))))
        body = text[m.end() : end]
        out += [edge("REFERENCES", own, f"{module}.{r}", line(m.start(2))) for r in sorted(set(re.findall(r"\b(\w+)\.(?:id|name|properties|outputs)\b", body)))]
        topic = re.search(r"name:\s*'([^']+)'", body)
        if m.group(3) and topic and re.search("ServiceBus.*/(topics|queues)@", m.group(3)):
            out.append(edge("CHANNEL_PUBLISH", own, "channel://" + topic.group(1).replace("_", "").replace("-", "").lower(), line(m.start(2))))
        if m.group(3) and topic and "vaults/secrets@" in m.group(3):
            out.append(edge("CONFIG_SOURCE", own, f"secret://{topic.group(1).lower()}", line(m.start(2))))
    return out


#: Extractors by language: functions of a text and its module's name.
EXTRACTORS: dict[str, Callable[[str, str], Found]] = {"python": python, "rust": braces("rust"), "go": braces("go"), "javascript": braces("javascript"), "typescript": braces("javascript"), "tsx": braces("javascript"), "csharp": braces("csharp"), "sql": sql, "postgres": sql, "tsql": sql, "proto": proto, "yaml": yaml, "bicep": bicep}


def extract(files: DataFrame) -> DataFrame:
    """Symbols and edges (``item``) of files (path, language, text). A file that cannot be read gives
    one row with the item ``error``."""
    schema = pa.schema([(name, pa.int64() if kind == "long" else pa.string()) for name, kind in (c.split() for c in ROW.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, language, text in zip(*(batch.column(c).to_pylist() for c in ("path", "language", "text")), strict=True):
                if language not in EXTRACTORS:
                    continue
                try:
                    found = EXTRACTORS[language](text or "", module_name(path, language))
                except (SyntaxError, ValueError, RecursionError) as e:
                    found = [{"item": "error", "name": type(e).__name__, "detail": str(e)[:200]}]
                if found:
                    yield pa.RecordBatch.from_pylist([f | {"path": path, "language": language} for f in found], schema=schema)

    return bounded_batches(files.select("path", "language", "text")).mapInArrow(run, ROW)


def import_files(edges: DataFrame, files: DataFrame) -> DataFrame:
    """IMPORTS_FILE edges: path, target_path of imports that name a file of the repository."""
    dotted = F.regexp_replace("target_qualname", r"\.|::", "/")
    here = F.regexp_replace("path", "[^/]*$", "")
    near = F.regexp_replace(F.concat(here, F.regexp_replace("target_qualname", r"^\./", "")), r"[^/]+/\.\./", "")
    stems = F.array(dotted, F.regexp_replace(dotted, "/[^/]*$", ""), F.concat(dotted, F.lit("/__init__")), F.concat(F.regexp_replace(dotted, "/[^/]*$", ""), F.lit("/__init__")), near, F.concat(near, F.lit("/index")))
    asked = edges.where(F.col("kind").isin("IMPORTS", "MODULE_FILE")).select("path", F.explode(F.array_distinct(stems)).alias("stem"))
    known = files.select(F.col("path").alias("target_path"), F.regexp_replace("path", r"\.[^./]+$", "").alias("stem"))
    return asked.join(known, "stem").select("path", "target_path").where("path <> target_path").distinct()
