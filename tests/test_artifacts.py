"""Files of runs: round trips, damage, generations, and the order of stages."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import workflow as W
from millrace.sources import artifacts as A

MAGIC = b"TESTREC\0"


def test_layouts():
    assert (A.LABEL_HEADER.itemsize, A.LABEL_V1.itemsize, A.LABEL_V2.itemsize, A.FEATURE_HEADER.itemsize, A.FEATURE.itemsize) == (112, 112, 140, 128, 432)
    places = {n: A.FEATURE.fields[n][1] for n in A.FEATURE.names}
    assert (places["source_id"], places["nodes"], places["shard"], places["value"], places["duplicates"], places["policy_id"], places["ply"], places["patterns"], places["own_gains"], places["opponent_gains"], places["reserved"]) == (32, 72, 104, 112, 136, 140, 144, 160, 232, 330, 428)
    assert (A.LABEL_V2.fields["deepest_nodes"][1], A.LABEL_V2.fields["previous_best_move"][1]) == (112, 139)


def test_records_of_both_versions(spark, tmp_path):
    n = 25_000
    rows = {"player_one": np.arange(n, dtype=np.uint64) << np.uint64(40), "source_id": np.full(n, 2**63 + 5, np.uint64), "value": np.arange(n) - 9, "completed_nodes": np.arange(n) + 7, "completed_depth": np.full(n, 4), "best_move": np.full(n, 48)}
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.bin").write_bytes(A.encode_records("labels", 1, MAGIC, rows, {"shard": 0}))
    (tmp_path / "a" / "two.bin").write_bytes(A.encode_records("labels", 2, MAGIC, rows | {"deepest_value": np.full(n, 3), "previous_best_move": np.full(n, 1)}, {"shard": 1}))
    got = A.read_records(spark, f"file://{tmp_path}/a", "labels", MAGIC)
    assert got.groupBy(F.regexp_extract("path", r"(\w+)\.bin$", 1).alias("f")).agg(F.count("*"), F.sum("value"), F.min("source_id"), F.sum("deepest_value"), F.min("previous_best_move"), F.max("place")).orderBy("f").collect() == [
        ("one", n, n * (n - 1) // 2 - 9 * n, 5 - 2**63, n * (n - 1) // 2 - 9 * n, 255, n - 1), ("two", n, n * (n - 1) // 2 - 9 * n, 5 - 2**63, 3 * n, 1, n - 1)
    ]
    heads = A.read_headers(spark, f"file://{tmp_path}/a", "labels", MAGIC).collect()
    assert {(h.schema, h.records, h.error) for h in heads} == {(1, n, None), (2, n, None)}
    good = A.encode_records("features", 1, MAGIC, {"patterns": np.arange(72).reshape(2, 36), "own_gains": np.full((2, 49), -32768), "residual": np.array([5, -5])}, {"lines": 36})
    assert A.header_error(good, "features", MAGIC) is None
    for bad, why in ((good[:-1], "length"), (b"X" + good[1:], "magic"), (good[:50], "shorter"), (good[:8] + b"\x09" + good[9:], "schema"), (good[:20] + b"\0" + good[21:], "byte order")):
        assert why in A.header_error(bad, "features", MAGIC)
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "x.bin").write_bytes(good)
    r = A.read_records(spark, f"file://{tmp_path}/f", "features", MAGIC).orderBy("place").collect()
    assert r[1].patterns == list(range(36, 72)) and r[0].own_gains == [-32768] * 49 and [x.residual for x in r] == [5, -5]


def test_reports_and_markers(tmp_path):
    with pytest.raises(FileExistsError):
        A.write_bytes(tmp_path / "x", b"1") and A.write_bytes(tmp_path / "x", b"2")
    assert (tmp_path / "x").read_bytes() == b"1"
    assert A.path_state(tmp_path / "r") == "missing" and A.path_state(tmp_path / "x") == "unexpected"
    report = A.Report(tmp_path / "r")
    report.attach("data.csv", b"a,b\n")
    assert A.path_state(tmp_path / "r") == "incomplete"
    with pytest.raises(ValueError):
        A.open_report(tmp_path / "r")
    report.complete({"n": 1})
    assert A.open_report(tmp_path / "r")["n"] == 1 and A.path_state(tmp_path / "r") == "complete"
    (tmp_path / "r" / "data.csv").write_bytes(b"a,c\n")
    with pytest.raises(ValueError, match="data.csv"):
        A.open_report(tmp_path / "r")
    with pytest.raises(FileExistsError):
        A.Report(tmp_path / "r")
    text = A.marker("h", {"a": "0" * 64}).decode()
    assert A.read_marker(text, "h", {"a"}) == {"a": "0" * 64}
    for bad in (text.replace("0" * 64, "xyz"), text + "a=" + "1" * 64, "other\n", text + "b=" + "1" * 64):
        with pytest.raises(ValueError):
            A.read_marker(bad, "h", {"a"})


def test_ledger_generations(tmp_path):
    path = tmp_path / "ledger.csv"
    old = ("run_id", "score", "note")
    path.write_text('run_id,score,note\nr1,50,"a, ""b"""\n')
    ledger = A.Ledger(path, [*old, "valid", "model"], older={old: {"valid": "true", "model": "=score"}})
    assert ledger.rows() == [{"run_id": "r1", "score": "50", "note": 'a, "b"', "valid": "true", "model": "50"}]
    W.promote({"run_id": "r2", "score": "51.0", "valid": "false"}, {"score": 51, "valid": "false"}, ledger)
    assert [r["run_id"] for r in ledger.rows()] == ["r1", "r2"] and path.read_text().startswith("run_id,score,note,valid,model\n")
    for row, want in (({"run_id": "r2"}, {}), ({"run_id": "r3", "score": "1"}, {"score": 2}), ({"run_id": "r4", "x": 1}, {}), ({"run_id": "r5"}, {"score": 1})):
        with pytest.raises(ValueError):
            W.promote(row, want, ledger)
    with pytest.raises(Exception, match="unexpected end"):
        A.csv_fields('a,"b')
    path.write_text("other\n")
    with pytest.raises(ValueError):
        ledger.rows()


def test_text_sources(spark, tmp_path):
    (tmp_path / "boards.txt").write_text("000000000000000f 0000000000000010\n\nbad line\n")
    assert [tuple(r) for r in A.read_hex_boards(spark, f"file://{tmp_path}/boards.txt").collect()] == [(15, 16), (None, None)]
    got = spark.createDataFrame([("info nodes=12 speed=1.5 name=a=b plain",)], "line string").select(A.typed_pairs(F.col("line")).alias("m")).first().m
    assert (got["nodes"].int, got["speed"].float, got["name"].text) == (12, 1.5, "a=b") and len(got) == 3
    books = spark.createDataFrame([("a1 b2",), ("c3",), ("a1 a2",)], "moves string")
    A.write_books(books, f"file://{tmp_path}/book", "openings")
    lines = [x for f in sorted((tmp_path / "book").glob("part-*")) for x in f.read_text().splitlines()]
    assert lines == ["# openings", "# depth 1: 1", "# depth 2: 2", "c3", "a1 a2", "a1 b2"]
    (tmp_path / "m.json").write_text(json.dumps({"a": 1, "b": {"c": "x"}}, indent=1))
    assert A.read_manifest(spark, f"file://{tmp_path}/m.json", "a int, b struct<c: string>").first().b.c == "x"


def test_runs(tmp_path):
    needs = {"source": [], "labels": ["source"], "features": ["labels"], "report": ["features", "source"]}
    assert W.in_order(needs) == ["source", "labels", "features", "report"] and W.in_order(needs, ["labels"]) == ["source", "labels"]
    with pytest.raises(ValueError, match="a needs b needs a"):
        W.in_order({"a": ["b"], "b": ["a"]})
    settings = {"labels": {"nodes": 5}}
    one, two = W.stage_fingerprints(settings, needs), W.stage_fingerprints({"labels": {"nodes": 6}}, needs)
    assert one["source"] == two["source"] and all(one[k] != two[k] for k in ("labels", "features", "report"))
    log, ran = W.RunLog(tmp_path / "run"), []
    assert log.accept_config(b"x = 1\n", one) == (1, True) and log.accept_config(b"x = 1\n", one) == (1, False)

    def fails() -> float:
        raise RuntimeError("no")

    stages = {k: (lambda k=k: ran.append(k) or 1.5) for k in needs}
    with pytest.raises(RuntimeError):
        log.run(stages | {"features": fails}, needs, settings)
    assert json.loads((tmp_path / "run" / "summary.json").read_text())["state"] == "failed"
    log = W.RunLog(tmp_path / "run")
    log.append("stage_started", stage="features", fingerprint=one["features"])  # a run that broke off
    log = W.RunLog(tmp_path / "run")
    out = log.run(stages, needs, settings)
    assert out["state"] == "complete" and ran == ["source", "labels", "features", "report"] and out["stages"]["features"]["attempts"] == 3 and out["seconds"] == 6.0
    assert "stage_abandoned" in [e["type"] for e in log.events]
    with pytest.raises(ValueError, match="changes started stage labels"):
        log.run(stages, needs, {"labels": {"nodes": 6}})
    with open(log.path, "a") as f:
        f.write("\n")
    with pytest.raises(ValueError):
        W.RunLog(tmp_path / "run")
    assert [W.overall(x) for x in (["complete", "running", "failed"], ["running", "pending"], ["complete"], ["complete", "pending"], [])] == ["failed", "running", "complete", "pending", "pending"]


def test_configurations(tmp_path):
    schema = {"name": str, "seed": int, "rate?": float, "stage": [{"kind": str, "on?": bool}]}
    path = tmp_path / "c.toml"
    path.write_text('name = "x"\nseed = 4\n[[stage]]\nkind = "a"\non = true\n')
    config, digest = W.load_config(path, schema)
    assert config["stage"] == [{"kind": "a", "on": True}] and len(digest) == 64
    for text in ('name = "x"\nseed = true\nstage = []\n', 'name = "x"\nseed = 1\nstage = []\nmore = 1\n', 'name = "x"\nstage = []\n', 'name = "x"\nseed = 1\nstage = [1]\n'):
        path.write_text(text)
        with pytest.raises(ValueError):
            W.load_config(path, schema)
    assert W.fingerprint({"b": (1, 2), "a": tmp_path}) == W.fingerprint({"a": str(tmp_path), "b": [1, 2]})
    assert W.handoff({"a": b"1", "b": b"2"}, tmp_path) == {"a": "new", "b": "new"}
    W.handoff({"a": b"1"}, tmp_path, apply=True)
    assert W.handoff({"a": b"1", "b": b"2"}, tmp_path) == {"a": "same", "b": "new"}
