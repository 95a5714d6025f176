"""The write path: versions, what they carry over, the view of names, the log."""

from __future__ import annotations

import random
from pathlib import Path

import pytest

from spanloom.operators import index, resolve, snapshot


def tree(spark, files: dict[str, str]):
    """Paths of Python, SQL and TypeScript files with their texts, as a scan."""
    ends = {"py": "python", "sql": "sql", "ts": "typescript"}
    rows = [(path, ends[path.rsplit(".", 1)[1]], text, str(hash(text))) for path, text in files.items()]
    return spark.createDataFrame(rows, "path string, language string, text string, hash string")


def state(tables: index.Tables, version: int) -> dict[str, list]:
    """All rows of a version, without the version."""
    found = {name: index.rows_at(tables, name, version).drop("graph_version") for name in index.WRITTEN_AT}
    found["files"] = index.files_at(tables, version).where("deleted_version is null").select("file_id", "path", "language", "hash")
    return {name: sorted(map(str, (r.asDict() for r in df.collect()))) for name, df in found.items()}


MAIN = "import lib\n\ndef run():\n    return lib.load(1)\n\ndef idle():\n    pass\n"


def test_versions_carry_what_did_not_change(spark, tmp_path) -> None:
    first = index.reindex(index.empty(spark), tree(spark, {"main.py": MAIN, "lib.py": "def load(x):\n    return x\n", "old.py": "def gone():\n    pass\n"}), "c1")
    index.save(first, str(tmp_path / "one"))
    first = index.load(spark, str(tmp_path / "one"))
    second = index.reindex(first, tree(spark, {"main.py": MAIN, "lib.py": "def load(x):\n    if x:\n        return x\n\ndef more():\n    pass\n", "new.py": "def fresh():\n    pass\n"}), "c2")
    index.save(second, str(tmp_path / "two"))
    tables = index.load(spark, str(tmp_path / "two"))
    assert [tuple(r) for r in tables.versions.select("version", "commit_sha").orderBy("version").collect()] == [(1, "c1"), (2, "c2")] and index.next_version(tables.versions) == 3
    names = lambda v: {r.qualname: r.id for r in index.snapshot(tables, v)[0].collect()}
    one, two = names(1), names(2)
    assert set(one) == {"main", "main.run", "main.idle", "lib", "lib.load", "old", "old.gone"} and set(two) == {"main", "main.run", "main.idle", "lib", "lib.load", "lib.more", "new", "new.fresh"}
    assert one["main.run"] == two["main.run"] and one["lib.load"] == two["lib.load"] and len(set(two.values())) == len(two)
    assert {r.path: r.deleted_version for r in index.files_at(tables, 2).collect()} == {"main.py": None, "lib.py": None, "old.py": 2, "new.py": None}
    assert {r.path: r.deleted_version for r in index.files_at(tables, 1).collect()} == {"main.py": None, "lib.py": None, "old.py": None}
    calls = [(r.source, r.target) for r in index.snapshot(tables, 2)[1].where("kind = 'CALLS'").collect()]
    assert (two["main.run"], two["lib.load"]) in calls
    assert {r.symbol_id: (r.loc, r.complexity) for r in index.rows_at(tables, "metrics", 2).collect()}[two["lib.load"]] == (3, 2)
    before, after = (index.rows_at(tables, "symbols", v) for v in (1, 2))
    states = [r.state for r in snapshot.diff(before, after, "stable_id", ["name", "end_line"]).collect()]
    assert sorted(states) == ["added"] * 3 + ["deleted"] * 2 + ["modified"] * 2 + ["unchanged"] * 3
    fewer = index.delete_files(tables, index.files_at(tables, 2).where("path = 'lib.py'"))
    assert index.rows_at(fewer, "symbols", 3).count() == 5 and index.rows_at(fewer, "symbols", 2).count() == 8 and index.rows_at(fewer, "symbols", 1).count() == 7
    assert index.rows_at(fewer, "edges", 3).where(f"target = {two['lib.load']}").count() == 0
    one_less = index.drop_version(fewer, 1)
    assert state(one_less, 2) == state(fewer, 2) and state(one_less, 3) == state(fewer, 3) and one_less.symbols.count() < fewer.symbols.count()
    with pytest.raises(ValueError):
        index.drop_version(fewer, 3)


def test_open_names_are_found_when_they_come_and_lost_when_they_go(spark) -> None:
    caller = {"a.py": "def go():\n    return helper_fn(1)\n"}
    helper = {"b.py": "def helper_fn(x):\n    return x\n"}
    target = lambda tables, v: [r.target for r in index.rows_at(tables, "edges", v).where("kind = 'CALLS' and target_qualname like '%helper_fn'").collect()]
    tables = index.reindex(index.empty(spark), tree(spark, caller))
    assert target(tables, 1) == [None]
    tables = index.reindex(tables, tree(spark, caller | helper))
    assert target(tables, 2) != [None] and tables.delta["symbols"].select("file_id").distinct().count() == 1
    tables = index.reindex(tables, tree(spark, caller))
    assert target(tables, 3) == [None] and target(tables, 2) != [None]
    tables = index.reindex(tables, tree(spark, caller | {"other.py": "def unlike():\n    pass\n"}))
    assert tables.delta["edges"].where("kind = 'CALLS'").count() == 0  # nothing there met the new names


def some_file(r: random.Random, path: str) -> str:
    word = lambda: r.choice("load save run Helper users_table make_it".split())
    module = lambda: r.choice("a b pkg.c d".split())
    if path.endswith(".sql"):
        return "".join(f"CREATE TABLE {r.choice(['app.', ''])}{word()} (id int);\n" for _ in range(r.randint(1, 2)))
    if path.endswith(".ts"):
        return "".join(f'export function {word()}(x) {{ return {word()}("call {r.choice(["app.", ""])}{word()} or /api/{word()}/7"); }}\n' for _ in range(r.randint(1, 2)))
    out = [f"import {module()}\n" for _ in range(r.randint(0, 2))]
    for _ in range(r.randint(0, 3)):
        out.append(f'def {word()}(x):\n    {r.choice([module() + ".", ""])}{word()}(x)\n    return "see {r.choice(["app.", ""])}{word()} at /v1/{word()}"\n\n')
    if r.random() < 0.4:
        out.append(f"class {word()}({word()}):\n    def {word()}(self):\n        return {word()}(self)\n")
    return "".join(out)


def test_steps_lead_where_a_full_index_does(spark, tmp_path) -> None:
    """Files come, change and go; every version is that of a full index, row for row, also from the log."""
    r = random.Random(4)
    paths = [f"{p}{i}.{end}" for i in range(3) for p, end in (("a", "py"), ("pkg/c", "py"), ("d", "py"), ("e", "sql"), ("pkg/h", "ts"))]
    files = {p: some_file(r, p) for p in r.sample(paths, 8)}
    folder, states = str(tmp_path / "graph"), {}
    for version in range(1, 4):
        scan = tree(spark, files)
        index.save(index.reindex(index.load(spark, folder), scan), folder)
        states[version] = state(index.load(spark, folder), version)
        assert states[version] == state(index.reindex(index.empty(spark), scan), 1)
        for path in r.sample(paths, r.randint(2, 4)):
            if path in files and r.random() < 0.4:
                del files[path]
            else:
                files[path] = some_file(r, path)
    tables = index.load(spark, folder)
    assert all(state(tables, v) == states[v] for v in (1, 2))


def bytes_of(folder: Path) -> int:
    return sum(p.stat().st_size for p in folder.rglob("*.parquet"))


def test_the_log_shows_whole_versions_alone(spark, tmp_path, monkeypatch) -> None:
    where, folder = tmp_path / "graph", str(tmp_path / "graph")
    files = {f"m{i}.py": f"def f{i}(x):\n    return f{i}(x)\n" for i in range(30)}
    index.save(index.reindex(index.empty(spark), tree(spark, files), "c1"), folder)
    first, sizes = state(index.load(spark, folder), 1), [bytes_of(where)]

    second = index.reindex(index.load(spark, folder), tree(spark, files | {"m0.py": "def f0(x):\n    return 0\n"}), "c2")
    with monkeypatch.context() as m:  # the writer ends before its commit
        m.setattr(index.Log, "commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            index.save(second, folder)
    assert index.next_version(index.load(spark, folder).versions) == 2 and state(index.load(spark, folder), 1) == first
    sizes.append(bytes_of(where))
    index.save(second, folder)
    sizes.append(bytes_of(where))
    assert sizes[2] - sizes[1] == sizes[1] - sizes[0] < sizes[0]
    with pytest.raises(ValueError):  # another has made this version
        index.save(second, folder)
    with pytest.raises(ValueError):
        index.Log(spark, folder).commit(2, {})

    third = index.reindex(index.load(spark, folder), tree(spark, files), "c3")
    index.save(third, folder)
    before = {v: state(index.load(spark, folder), v) for v in (1, 2, 3)}
    assert before[3] == first
    index.forget(spark, folder, 2)
    for wrong in (2, 3, 7):
        with pytest.raises(ValueError):
            index.forget(spark, folder, wrong)
    index.vacuum(spark, folder)
    tables = index.load(spark, folder)
    assert [r.version for r in tables.versions.orderBy("version").collect()] == [1, 3]
    assert {v: state(tables, v) for v in (1, 3)} == {v: before[v] for v in (1, 3)}
    assert len(list((where / "symbols").iterdir())) == 1
    index.save(index.reindex(tables, tree(spark, {}), "c4"), folder)
    assert not any(state(index.load(spark, folder), 4).values())


def test_best_of_many_names_by_pairs(spark) -> None:
    """Four small joins give what ranking all pairs gives."""
    r = random.Random(8)
    part = lambda: r.choice(["get", "set", "Get", "x"])
    name = lambda: r.choice(["", "a.", "b::", "a.c.", "long.er."]) + part()
    symbols = [(i, r.choice(["function", "class", "variable"]), name(), r.choice(["python", "go", "rust"])) for i in r.sample(range(1000), 60)]
    names = [(name(), r.choice(["python", "go", "java"]), r.choice(["CALLS", "HTTP_CALL", "IMPORTS"])) for _ in range(150)] + [("", "go", "CALLS"), ("nothing", "go", "HTTP_CALL")]
    got = resolve.resolve_by_suffix(spark.createDataFrame(names, "target_qualname string, language string, kind string"), spark.createDataFrame(symbols, "id long, kind string, qualname string, language string"))
    last = lambda q: q.replace("::", ".").rsplit(".", 1)[-1]
    want = {}
    for target, language, kind in names:
        cross = kind == "HTTP_CALL"
        fit = [(lang != language, q != target, len(q), q, i) for i, k, q, lang in symbols if k != "variable" and last(q) == last(target) and (cross or lang == language)]
        if fit:
            want[target, language, cross] = min(fit)[-1]
    assert {(x.target_qualname, x.language, x.may_cross): x.resolved_id for x in got.collect()} == want
