"""Names kept up to date, bounded neighbourhoods, near names, digests, queues and line states on small cases."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import analytics, budget, filters, impact, index, metrics, resolve, search, snapshot, spelling, traverse
from spanloom.sources import repository
from spanloom.streaming import watch


def test_names_kept_up_to_date_are_those_resolved_anew(spark) -> None:
    r = random.Random(2)
    name = lambda: r.choice(["", "a.", "b::", "x.y."]) + r.choice(["get", "set", "put", "run"])
    rows = [(i, r.choice(["function", "class", "variable"]), name(), r.choice(["go", "python"])) for i in range(40)]
    schema = "id long, kind string, qualname string, language string"
    frame = lambda kept: spark.createDataFrame(kept, schema).withColumn("name", F.col("qualname"))
    before, after = frame(rows[:30]), frame(rows[10:])
    names = spark.createDataFrame([(name(), r.choice(["go", "python", "java"]), r.choice(["CALLS", "HTTP_CALL"])) for _ in range(60)], "target_qualname string, language string, kind string")
    fewer = names.limit(20)
    known = resolve.resolve_by_suffix(names, before)
    moved = index.moved_names(before, after)
    for asked in (names, fewer):
        assert sorted(resolve.re_resolved(known, asked, moved, after).collect()) == sorted(resolve.resolve_by_suffix(asked, after).collect())
    nothing = index.moved_names(before, before)
    assert nothing.count() == 0 and sorted(resolve.re_resolved(known, names, nothing, before).collect()) == sorted(known.collect())


def queue_walk(seeds: list[int], names: dict[int, str], edges: list[tuple], depth: int, most: int):
    """The same neighbourhood with a queue, one node at a time."""
    visited, queue, out = dict.fromkeys(sorted(set(seeds) & set(names)), 0), [], set()
    queue = list(visited)
    while queue:
        node = queue.pop(0)
        if visited[node] >= depth:
            continue
        near = []
        for source, target, kind, qualname, detail, _ in edges:
            if node not in (source, target):
                continue
            if target is None and qualname and kind in ("MODULE_FILE", "IMPORTS_FILE"):
                target = min((i for i, q in names.items() if q == qualname), default=None)
            if source is not None and source not in names or target is not None and target not in names:
                continue
            rank = filters.EDGE_RANKS.get(kind, 10)
            key = (rank, names.get(source, ""), names.get(target, qualname or ""), detail or "", kind)
            near.append((key, target if source == node else source, (source, target, kind, qualname, detail)))
        for _, other, edge in sorted(near, key=lambda n: (n[0], n[1] or 0)):
            out.add(edge)
            if other is not None and len(visited) < most and other not in visited:
                visited[other] = visited[node] + 1
                queue.append(other)
        if len(visited) >= most:
            break
    return visited, out


@pytest.mark.parametrize("most", [1, 6, 40])
def test_bounded_neighbourhoods_are_those_of_a_queue(spark, most: int) -> None:
    r = random.Random(most)
    names = {i: f"n{r.randrange(100):02d}.{i}" for i in range(30)}
    kinds = ["CONTAINS", "IMPORTS_FILE", "MODULE_FILE", "READS", "XREF"]
    end = lambda: r.choice([None, *range(33)])  # noqa: E731  some are no symbols
    edges = list({(end(), t := end(), r.choice(kinds), r.choice([None, names[3], "open"]) if t is None else None, r.choice([None, "d"]), "go") for _ in range(60)})
    symbols = spark.createDataFrame([(i, q, "function", q, "go") for i, q in names.items()], "id long, qualname string, kind string, name string, language string")
    frame = spark.createDataFrame(edges, "source long, target long, kind string, target_qualname string, detail string, language string")
    seeds = [5, 2, 99]
    nodes, found = traverse.bounded_subgraph(spark.createDataFrame([(s,) for s in seeds], "id long"), symbols, frame, 3, most)
    visited, out = queue_walk(seeds, names, edges, 3, most)
    assert {x.id: x.distance for x in nodes.collect()} == visited
    assert set(map(tuple, found.collect())) == out


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_near_names_by_all_pairs(spark, monkeypatch) -> None:
    monkeypatch.setattr(spelling, "SHARE", 3)
    r = random.Random(7)
    names = ["", "a", "ab", *("".join(r.choices("abC_", k=r.randint(1, 7))) for _ in range(80)), *(f"common_prefix_of_{i}" for i in range(30))]
    asked = [*r.sample(names, 25), "common_prefx_of_7", "comon_prefix_f_12", "zzzzzz", "A", "longcommon_prefix_of_3"]
    frame = lambda rows: spark.createDataFrame([(n,) for n in [*rows, None]], "name string")
    got: dict[str, list] = {}
    for row in spelling.near_names(frame(asked), frame(names)).orderBy("rank").collect():
        got.setdefault(row.asked, []).append((row.edits, row["name"]))
    for a in set(asked):
        near = sorted((d, len(n), n) for n in set(names) if (d := distance(a.lower(), n.lower())) <= 2)
        assert got.get(a, []) == [(d, n) for d, _, n in near[:3]]


def test_digests_tell_bags_of_rows_apart(spark) -> None:
    rows = [("a", "b|c", 1), ("a|b", "c", 1), (None, "n", 2), ("x", "", None), ("x", "", None)]
    frame = lambda r: spark.createDataFrame(r, "p string, q string, v long")
    of = lambda r, n=1: tuple(analytics.multiset_digest(frame(r).repartition(n), ["p", "q", "v"]).first())
    whole = of(rows)
    assert of(rows[::-1], 3) == whole and len({of(rows[:i]) for i in range(6)}) == 6
    assert len({of([r]) for r in [("a", "b|c", 1), ("a|b", "c", 1), ("n", "n", 2), (None, "n", 2), ("1:n", None, 2)]}) == 5
    parts = analytics.multiset_digest(frame(rows[:2]), ["p", "q", "v"]).union(analytics.multiset_digest(frame(rows[2:]), ["p", "q", "v"]))
    assert tuple(analytics.merged_digests(parts).first()) == whole


def test_runs_of_versions_answer_for_each(spark) -> None:
    rows = [(1, 2, v) for v in (1, 2, 3, 6, 7, 7)] + [(1, 3, 5), (2, 3, 3), (None, 3, 3), (2, None, 6)]
    runs = snapshot.validity(spark.createDataFrame(rows, "source long, target long, graph_version long"), ["source", "target"])
    assert {tuple(r) for r in runs.collect()} == {(1, 2, 1, 3), (1, 2, 6, 7), (1, 3, 5, 5), (2, 3, 3, 3), (None, 3, 3, 3), (2, None, 6, 6)}
    assert {tuple(r) for r in snapshot.neighbours_between(runs, 3, 6).collect()} == {(1, 2, "stable"), (2, 3, "removed")}
    assert {tuple(r) for r in snapshot.neighbours_between(runs, 4, 5).collect()} == {(1, 3, "new")}


def test_batches_end_as_they_would_one_by_one(spark) -> None:
    r = random.Random(9)
    for trial, (most, most_bytes, most_ms) in enumerate([(4, 50, 1_000), (7, 1 << 30, 1 << 30), (5, 1, 10), (3, 40, 300)]):
        at, rows = 0, []
        for i in range(60):
            at += r.choice([0, 0, 5, 90, 400, 5_000])
            rows.append((i, at, r.choice([0, 3, 20, 200])))
        queue = spark.createDataFrame(rows, "event_id long, ms long, size long").select("event_id", F.timestamp_millis("ms").alias("ts"), "size")
        got = sorted(map(tuple, watch.flushes(queue.repartition(3), ["ts", "event_id"], "ts", "size", most, most_bytes, most_ms).collect()))
        want, batch = [], []
        for n, (_, ms, size) in enumerate(rows):
            batch.append((n, ms, size))
            if len(batch) >= most or sum(b[2] for b in batch) >= most_bytes or ms - batch[0][1] >= most_ms:
                want.append((batch[0][0], len(batch), sum(b[2] for b in batch)))
                batch = []
        if batch:
            want.append((batch[0][0], len(batch), sum(b[2] for b in batch)))
        assert got == want, trial
    assert watch.flushes(queue.where("false"), ["ts", "event_id"], "ts", "size").count() == 0


def line_states(text: str, language: str) -> tuple[int, int, int, int]:
    """loc, blank, comment, code by reading line after line."""
    sign = metrics.LINE_SIGNS.get(language, "//" if language in metrics.BLOCK_SIGNS else None)
    begin, end = metrics.BLOCK_SIGNS.get(language, (None, None))
    inside, n = False, [0, 0, 0, 0]
    for line in text.removesuffix("\n").split("\n"):
        n[0] += 1
        t = line.strip()
        if not t:
            n[1] += 1
        elif inside:
            n[2] += 1
            inside = end not in t
        elif sign and t.startswith(sign):
            n[2] += 1
        elif begin and t.startswith(begin):
            n[2] += 1
            inside = end not in t
        else:
            n[3] += 1
    return tuple(n)


def test_line_states_of_all_languages(spark, monkeypatch) -> None:
    monkeypatch.setattr(metrics, "STRETCH", 5)
    r = random.Random(3)
    parts = ["", "  ", "x = 1", "/* a", "b */", "*/ x /*", "// c */", "-- d", "# e", "\t/* f */ g", 'say("/* no")', "/* h */ /* i", "---", "*/", "\t# j"]
    languages = ["python", "rust", "sql", "postgres", "tsql", "typescript", "javascript", "tsx", "csharp", "go", "yaml", "proto", "bicep"]
    rows = [(f"{i}", languages[i % len(languages)], "\n".join(r.choices(parts, k=r.randint(1, 40)))) for i in range(130)] + [("none", "go", ""), ("null", "go", None)]
    got = {x.path: (x.loc, x.blank, x.comment, x.code) for x in metrics.file_metrics(spark.createDataFrame(rows, "path string, language string, text string")).collect()}
    assert got == {path: line_states(text or "", language) for path, language, text in rows}


def test_no_confidence_is_full_confidence(spark) -> None:
    rows = spark.createDataFrame([(1, None, 1, "a"), (2, 0.4, 1, "b"), (3, 0.9, 1, "c")], "id long, confidence double, distance int, qualname string")
    for kept in (filters.sure(rows, 0.5), impact.ranked(rows, 0.5)):
        assert sorted(r.id for r in kept.collect()) == [1, 3]
    assert impact.ranked(rows).count() == 3


def test_layers_of_ignore_files(spark, tmp_path) -> None:
    """The last rule of the deepest file that has one for a path decides; .ignore comes after .gitignore."""
    files = {
        ".gitignore": "# all\n*.tmp.py\n/top.py\nbuild/\nlogs/**/x.py\n!keep.tmp.py\n",
        "sub/.gitignore": "!a.tmp.py\nown.py\n/only/here.py\n",
        "sub/deep/.gitignore": "*\n!open.py\n",
        ".ignore": "late.py\n",
        "sub/deep/.ignore": "!late.py\n",
    }
    kept = ["a.py", "keep.tmp.py", "sub/a.tmp.py", "sub/top.py", "sub/deep/open.py", "sub/deep/late.py", "other/own.py", "sub/x/only/here.py", "logs/y.py", "sub/buildx/a.py", "build.py"]
    gone = ["b.tmp.py", "top.py", "build/a.py", "sub/build/q/a.py", "logs/x.py", "logs/q/r/x.py", "sub/b.tmp.py", "sub/own.py", "sub/q/own.py", "sub/only/here.py", "sub/deep/closed.py", "sub/late.py", "late.py"]
    for path, text in (files | dict.fromkeys(kept + gone, "x = 1\n")).items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    assert sorted(r.path for r in repository.scan(spark, str(tmp_path)).select("path").collect()) == sorted(kept)
    assert repository.scan(spark, str(tmp_path), rules=[]).count() == len(kept + gone)
    assert repository.scan(spark, str(tmp_path), rules=["*.tmp.py"]).count() == len(kept + gone) - 4


def test_shared_budgets_by_pouring(spark) -> None:
    r = random.Random(1)
    rows = [(k, p, i, r.randint(1, 30)) for k in range(12) for p in "abcd"[: r.randint(1, 4)] for i in range(r.randint(1, 9))]
    got = {(x.k, x.p, x.i) for x in budget.shared_prefix(spark.createDataFrame(rows, "k long, p string, i long, size long"), ["k"], "p", ["i"], "size", 150).collect()}
    want = set()
    for k in range(12):
        sizes = {p: [s for a, b, _, s in rows if (a, b) == (k, p)] for p in "abcd"}
        totals = {p: sum(s) for p, s in sizes.items() if s}
        room, open_ = 150.0, sorted(totals, key=totals.get)
        while open_ and totals[open_[0]] <= room / len(open_):
            room -= totals[open_.pop(0)]
        for p, s in sizes.items():
            used = 0
            for i, size in enumerate(s):
                used += size
                if p not in open_ or used <= room / len(open_):
                    want.add((k, p, i))
    assert got == want


def test_the_index_finds_what_a_scan_does(spark) -> None:
    r = random.Random(5)
    texts = [(f"f{i}", "".join(r.choices(["load", "save", " ", "\n", "(x)", "ab", "über"], k=r.randint(0, 30)))) for i in range(60)] + [("none", None)]
    sources = spark.createDataFrame(texts, "path string, text string").cache()
    index = search.gram_index(sources).cache()
    patterns = {"loadsave": True, "(load|save) save": True, "load|x": False, "lo+ad": False, "(?i)LOAD": False, "a.c": False, "(?:load){2}": True, r"save\(x\)": True, "über|load": True, "(load)?save+ab": True, r"\Qload\E ": False, "l[o]ad": True, "l[ou]ad": False, "ab(load )*über": True}
    for pattern, narrow in patterns.items():
        assert (search.candidates(index, pattern) is not None) == narrow, pattern
        want = sorted((x.path, x.line) for x in search.regex(sources, pattern).collect())
        assert sorted((x.path, x.line) for x in search.indexed_regex(index, sources, pattern).collect()) == want
    assert search.required_grams("ab(load|sa.e) xyz") == [[frozenset({" xy", "xyz"})]]
    assert search.required_grams("(load|save)") == [[frozenset({"loa", "oad"}), frozenset({"sav", "ave"})]]
    assert 0 < search.candidates(index, "loadsave").count() < 60
    changed = spark.createDataFrame([("f0", "quite new"), ("extra", "quite")], "path string, text string")
    fresh = search.refreshed_index(index, changed.union(spark.createDataFrame([("f1", "")], "path string, text string")), changed)
    now = sources.where("path not in ('f0', 'f1')").union(changed)
    assert sorted(fresh.collect()) == sorted(search.gram_index(now).select("gram", "path").collect())
