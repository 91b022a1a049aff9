"""Files of a repository, what is written back, states and repair."""

import json
import os
import subprocess

import pytest

from symgraph.operators import transition as T
from symgraph.plans import serving as P
from symgraph.sources import files as S
from symgraph.sources.texts import chain_frames


def test_cargo_inputs(spark, tmp_path):
    for rel in ("ws/Cargo.toml", "ws/a/Cargo.toml", "ws/target/Cargo.toml", "ws/.x/Cargo.toml", "rust-toolchain", "ws/Cargo.lock", "Cargo.lock"):
        os.makedirs(tmp_path / os.path.dirname(rel), exist_ok=True)
        (tmp_path / rel).write_text("x")
    inputs, topology = S.cargo_inputs(spark, str(tmp_path), ["ws"])
    assert {r["rel"] for r in inputs.collect()} == {"ws/Cargo.toml", "ws/a/Cargo.toml", "ws/Cargo.lock", "rust-toolchain"}
    t = {r["key"] for r in topology.collect()}
    assert {"mode", "root[0]", "absent:.cargo/config", "absent:ws/rust-toolchain"} <= t and "absent:rust-toolchain" not in t


def test_git_diff(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "a.py").write_text("1\n2\n3\n")
    git("add", ".")
    git("commit", "-qm", "one")
    (tmp_path / "a.py").write_text("1\nx\ny\n3\n")
    assert [tuple(r) for r in S.git_diff(spark, str(tmp_path), "HEAD").collect()] == [("a.py", 2, 3)]
    for bad in ("HEAD; rm", "--output=x"):
        with pytest.raises(ValueError):
            S.git_diff(spark, str(tmp_path), bad)


def test_tours_and_manifest(spark, tmp_path):
    for rel, title in (("01 - a.tour", "01 - a"), ("sub/b.tour", "b"), ("delta/c.tour", "c")):
        os.makedirs(tmp_path / "t" / os.path.dirname(rel), exist_ok=True)
        (tmp_path / "t" / rel).write_text(json.dumps({"title": title, "steps": [{"file": "x.py", "line": 3}]}))
    assert {r["title"] for r in S.read_tours(spark, str(tmp_path / "t")).collect()} == {"01 - a", "b"}
    assert S.read_tours(spark, str(tmp_path / "t"), everything=True).count() == 3
    path = str(tmp_path / "m.toml")
    rows, other = S.read_manifest(spark, path)
    assert rows.count() == 0 and other == {}
    new = spark.createDataFrame([("a b.tour", json.dumps({"title": "é \"q\"", "n": 3, "ok": True, "list": ["x"]}))], "rel string, row string")
    S.write_manifest(new, {"version": 2, "delta_arc": [{"to": "x"}]}, path)
    rows, other = S.read_manifest(spark, path)
    assert json.loads(rows.first()["row"]) == {"title": "é \"q\"", "n": 3, "ok": True, "list": ["x"]} and other == {"version": 2, "delta_arc": [{"to": "x"}]}
    (tmp_path / "bad.toml").write_text("tour = 3\n")
    with pytest.raises(ValueError):
        S.read_manifest(spark, str(tmp_path / "bad.toml"))


def test_chain_blocks_and_frames(spark):
    text = "# One\n```\nrun()\n├── a()\n│     └── deep()\n└── b()\n```\n## Two\n```\nno tree\n```\n```python\n# not a title\n└── c\n```"
    b = S.chain_blocks(spark.createDataFrame([("d", text)], "doc string, text string"))
    rows = b.orderBy("pos").collect()
    assert {(r["block"], r["heading"]) for r in rows} == {(1, "One"), (3, "Two")}
    got = chain_frames(spark.createDataFrame([(1, "\n".join(r["line"] for r in rows if r["block"] == 1))], "block_id int, text string")).orderBy("ord").collect()
    assert [(r["depth"], r["text"]) for r in got] == [(0, "run()"), (1, "a()"), (2, "deep()"), (1, "b()")]


def test_writes(spark, tmp_path):
    stats = spark.createDataFrame([("a", "b", 2, 5), ("c", "d", 9, 7), ("e", "f", 2, 1)], "caller string, callee string, count long, first_seen long")
    p = S.write_runtime_edges(stats, str(tmp_path / "trace.json"))
    assert p.endswith("trace.edges.json") and [r["caller"] for r in json.load(open(p))] == ["c", "e", "a"]
    for n, b in (("rust.scip", b"R"), ("python.scip", b"P"), ("other.scip", b"O")):
        (tmp_path / n).write_bytes(b)
    out = S.concat_indexes([str(tmp_path / n) for n in ("other.scip", "rust.scip", "python.scip")], str(tmp_path / "all.scip"))
    assert open(out, "rb").read() == b"PRO"
    assert {os.path.basename(r["path"]) for r in S.glob_files(spark, str(tmp_path), ["*.scip", "r*.scip"]).collect()} == {"rust.scip", "python.scip", "other.scip", "all.scip"}


def test_two_faces(spark, tmp_path):
    made = []
    rows = lambda: made.append(1) or spark.range(3)
    cache = str(tmp_path / "cache")
    assert P.two_faces(spark, cache, "k1", rows)[1] == "rebuilt" and P.two_faces(spark, cache, "k1", rows)[1] == "cache" and len(made) == 1
    got, face, _ = P.two_faces(spark, cache, "k2", rows)
    assert face == "rebuilt" and got.count() == 3
    (tmp_path / "file").write_text("x")
    got, face, warning = P.two_faces(spark, str(tmp_path / "file"), "k", rows)
    assert face == "index" and warning and got.count() == 3


def test_heal(tmp_path):
    now, stale, repairs = [1000.0], [True], []
    h = P.Heal(str(tmp_path), wait=0, clock=lambda: now[0])
    fix = lambda: repairs.append(1) or stale.__setitem__(0, False)
    assert h.ensure(lambda: stale[0], fix) == "healed" and h.ensure(lambda: stale[0], fix) == "fresh" and len(repairs) == 1
    stale[0] = True
    assert h.ensure(lambda: True, lambda: None) == "served-stale"
    assert h.ensure(lambda: True, fix) == "cooling" and len(repairs) == 1
    assert h.ensure(lambda: stale[0], fix, head_moved=True) == "healed"
    stale[0] = True
    open(h.lock, "w").close()
    os.utime(h.lock, (now[0], now[0]))
    assert h.ensure(lambda: stale[0], fix) == "served-stale"
    now[0] += 601
    assert h.ensure(lambda: stale[0], fix) == "healed" and not os.path.exists(h.lock)


def test_writer_lock(tmp_path):
    with P.writer_lock(str(tmp_path / "l")):
        with pytest.raises(TimeoutError):
            with P.writer_lock(str(tmp_path / "l"), budget=0.1):
                pass
    with P.writer_lock(str(tmp_path / "l"), budget=0.1):
        pass


def test_sidecar(spark):
    c = spark.createDataFrame([("a", "c1", 5), ("b", "c2", 9)], "path string, commit string, mtime long")
    assert P.pick_sidecar(c, "c1") == ({"path": "a", "commit": "c1", "mtime": 5}, None)
    row, warning = P.pick_sidecar(c, "c9")
    assert row["path"] == "b" and "c9" in warning
    assert P.pick_sidecar(c.limit(0), "c1")[0] is None


def test_guards():
    assert T.guards({"n_files": 0}, {"n_files": 0}) == ["both_empty"]
    assert T.guards({"n_files": 1, "files_face": "a", "generation": "x"}, {"n_files": 0, "generation": "y"}) == ["after_empty", "face_mismatch", "generation_mismatch"]
    assert T.guards({"n_files": 1, "generation": "x"}, {"n_files": 1}) == []
