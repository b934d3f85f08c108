"""The command line, its reports and the text notation."""

import io
import json
import os

import pytest
from gauges import GAUGES, PLAIN, WHOLE, body, gauge

from contractlog import cli, present


@pytest.fixture
def here(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "schema-gauges.yaml").write_text(GAUGES)
    return tmp_path


@pytest.fixture
def call(spark, here):
    return lambda *argv, stdin=None: cli.run(spark, list(argv), stdin)


FILE = ("-f", "gauges.jsonl")


def test_a_store_from_first_to_last(call, here):
    assert call(*FILE, "list") == ({"records": "0 records in gauges.jsonl", "help": ["Run `contractlog -f gauges.jsonl put ...` to add one"]}, 0)
    assert call(*FILE, "keys")[0]["keys"].startswith("0 records") and call(*FILE, "validate") == ({"valid": 0, "bad": 0}, 0)
    assert call(*FILE, "put", json.dumps(PLAIN)) == ({"written": 1, "rejected_count": 0, "records": [{"id": "G10", "op": "created"}]}, 0)
    lines = io.StringIO("\n".join(json.dumps(gauge(c)) for c in ("G11", "G12", "G13")) + "\n\n")
    report, code = call("put", *FILE, "-", "--set", "level=7", stdin=lines)  # the flags after the command as well
    assert code == 0 and report["written"] == 3, report
    assert call(*FILE, "put", "--set", "code=G14", "--set", "river=Main", "--set", "level=1")[0]["records"] == [{"id": "G14", "op": "created"}]
    assert call(*FILE, "put", json.dumps(PLAIN))[0]["records"][0]["op"] == "unchanged"
    report, code = call(*FILE, "put", json.dumps(gauge("G15", level=99, x=1)))
    assert code == 2 and report["code"] == "CONTRACT_VIOLATION" and report["written"] == 0
    assert report["rejected"] == [{"id": "G15", "problem": "level: Input should be less than 60; x: Extra inputs are not permitted"}]
    report, code = call(*FILE, "list", "--limit", "2")
    assert code == 0 and report["count"] == "2 of 5 total" and report["gauges"] == [{"code": "G10", "river": "Elbe", "level": 3.5, "checked": None}, {"code": "G11", "river": "Elbe", "level": 7.0, "checked": None}]
    assert any("--limit 5" in h for h in report["help"])
    assert call(*FILE, "list", "--fields", "owners, code")[0]["gauges"][0] == {"owners": "[]", "code": "G10"}
    assert call(*FILE, "keys", "--limit", "2")[0]["keys"] == ["G10", "G11"] and call(*FILE, "keys")[0]["count"] == "5 of 5 total"
    assert call(*FILE, "get", "G10") == ({"record": WHOLE}, 0)
    assert call(*FILE, "delete", "G12")[0]["delete"] == "G12 removed" and call(*FILE, "delete", "G12") == ({"delete": "G12 already absent (no-op)"}, 0)
    report, code = call(*FILE, "get", "G12")
    assert code == 1 and report["code"] == "NOT_FOUND" and report["help"]
    assert call(*FILE, "compact")[0]["kept"] == 4
    report, code = call(*FILE, "roll")
    assert code == 0 and report["records"] == 4 and call(*FILE, "keys")[0]["keys"].startswith("0 records")
    assert call("-f", "archive/manifest.jsonl", "list")[0]["manifest"][0]["segment"] == report["rolled"]
    assert call(*FILE, "roll", "--if-larger-than", "1k")[0]["roll"].endswith("under 1k (no-op)")


def test_damage_is_reported(call, here):
    (here / "gauges.jsonl").write_bytes(body(PLAIN, "oops", gauge("G20", river="")))
    report, code = call(*FILE, "validate")
    assert code == 0 and (report["valid"], report["bad"]) == (1, 2) and [x["line"] for x in report["issues"]] == [2, 3] and len(report["help"]) == 2
    assert call(*FILE, "validate", "--strict")[1] == 1 and call(*FILE, "list")[0]["bad"] == 2
    report, code = call(*FILE, "get", "G10", "--json")
    assert code == 0 and report["record"] == WHOLE and len(report["bad_lines"]) == 2 and report["revision"]["size"] == os.path.getsize("gauges.jsonl")
    report, code = call(*FILE, "get", "G20", "--json")
    assert code == 1 and report["record"] is None and report["code"] == "NOT_FOUND" and len(report["bad_lines"]) == 2
    report, _ = call(*FILE, "list", "--json", "--fields", "code")
    assert report["records"] == [{"code": "G10"}] and [b["line"] for b in report["bad_lines"]] == [2, 3]
    report, code = call(*FILE, "repair")
    assert code == 0 and report["kept"] == 1 and report["quarantined"] == 2 and os.path.exists(report["quarantine"])
    assert call(*FILE, "validate", "--strict") == ({"valid": 1, "bad": 0}, 0)


def test_long_values_are_cut(call, here):
    (here / "notes.yaml").write_text("key: id\nfields: {id: str, text: str}")
    long = "word " * 300
    call("-f", "notes.jsonl", "put", json.dumps({"id": "a", "text": long}))
    report, _ = call("-f", "notes.jsonl", "get", "a")
    assert report["record"]["text"] == long[:800] + "..." and report["truncated"] == [{"field": "text", "shown": 800, "total": 1500}]
    assert call("-f", "notes.jsonl", "get", "a", "--full")[0]["record"]["text"] == long
    report, _ = call("-f", "notes.jsonl", "list")
    assert report["notes"][0]["text"] == long[:80] + "..." and any("--full" in h for h in report["help"])


def test_wrong_usage_is_a_report(call, here):
    for argv, said in (
        (["list"], "--file is required"), (["-f", "other.jsonl", "list"], "no contract"), ([*FILE, "list", "--lim", "3"], "unrecognized"), (["frobnicate"], "invalid choice"),
        ([*FILE, "put"], "put takes"), ([*FILE, "put", "{x"], "invalid json"), ([*FILE, "put", "[1]"], "not an object"), ([*FILE, "put", "--set", "x"], "FIELD=VALUE"),
        ([*FILE, "list", "--fields", "nope"], "unknown fields"), ([*FILE, "roll", "--if-larger-than", "many"], "not a size"),
    ):
        report, code = call(*argv)
        assert code in (1, 2) and said in report["error"] and report["code"] in ("USAGE_ERROR",), (argv, report)
    (here / "bad.yaml").write_text("fields: 3")
    assert call("-f", "bad.jsonl", "list")[0]["code"] == "CONTRACT_ERROR"
    assert call("-f", "no/such/folder/gauges.jsonl", "-c", "schema-gauges.yaml", "put", json.dumps(PLAIN))[0]["code"] == "IO_ERROR"
    assert call("--version") == (cli.VERSION, 0) and "COMMAND" in call("--help")[0] and "--fields" in call("list", "--help")[0]


def test_home_and_stores(call, here):
    report, code = call()
    assert code == 0 and report["stores"].startswith("0 stores") and report["version"] == cli.VERSION
    (here / "gauges.jsonl").write_bytes(body(PLAIN, gauge("G11"), {"code": "G10", "_deleted": True}))
    (here / "sub").mkdir()
    (here / "sub" / "plain.jsonl").write_text("{}\n")
    (here / "sub" / "odd.jsonl").write_text("{}\n")
    (here / "sub" / "odd.yml").write_text("fields: 1")
    call("-f", "sub/folder", "-c", "schema-gauges.yaml", "put", json.dumps(PLAIN))
    report, code = call("stores")
    assert code == 0 and report["count"] == 4 and report["stores"][0] == {"file": "gauges.jsonl", "contract": "schema-gauges.yaml", "records": 1}
    assert {r["file"]: r["contract"] for r in report["stores"][1:]} == {"sub/folder": None, "sub/odd.jsonl": "sub/odd.yml (invalid)", "sub/plain.jsonl": None}
    assert call()[0]["stores"] == report["stores"] and "list" in call()[0]["help"][0]
    assert call("stores", "--depth", "0")[0]["count"] == 1


def test_schema(call):
    report, _ = call(*FILE, "schema")
    assert report["model"] == "Gauge" and report["key"] == "code" and report["fields"][2] == {"name": "level", "type": "float", "required": True, "rules": "gt=-5; lt=60"}
    assert json.loads(call(*FILE, "schema", "--json-schema")[0]["schema"])["required"] == ["code", "river", "level"]


def test_discovery_is_bounded(tmp_path):
    for p in ("q.jsonl", "one/r.jsonl", "one/two/s.jsonl", ".git/t.jsonl", "node_modules/u.jsonl"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("")
    names = lambda **more: [f["file"] for f in present.discover(str(tmp_path), **more)[0]]
    assert names() == ["q.jsonl", "one/r.jsonl", "one/two/s.jsonl"] and names(depth=1) == ["q.jsonl", "one/r.jsonl"]
    assert present.discover(str(tmp_path), most=2)[1] and not present.discover(str(tmp_path), most=3)[1]


def test_scalars_of_the_notation():
    bare = ["é", "a b", "1.2.3", "e5", "+", "x-y", "nullable", "a'b"]
    quoted = ["", "null", "+5", "-3.1e7", "00", "12E+4", "k:v", "[x", "a,b", "-x", "#x", " x", "x\t", 'say "hi"', "back\\slash", "line\nfeed"]
    assert [present.scalar(x) for x in bare] == bare
    assert all(present.scalar(x) == f'"{present.escape(x)}"' for x in quoted)
    numbers = {1.0: "1", -0.0: "0", 0.5: "0.5", 1e15: "1000000000000000", 1e16: "1e+16", 1e-5: "1e-05", float("inf"): "null", 12: "12"}
    assert all(present.scalar(x) == s for x, s in numbers.items()) and [present.scalar(x) for x in (None, True, False)] == ["null", "true", "false"]


def test_lists_and_keys_of_the_notation():
    assert present.notation({"a": {}, "b": {"c-d": 1, "e:f": "x y", "": None}, "g": []}) == 'a: {}\nb:\n  c-d: 1\n  "e:f": x y\n  "": null\ng: []'
    assert present.notation({"r": [{"id": "p", "x:y": 2.0}, {"id": "+1", "z": None}]}) == 'r[2]{id,x:y,z}:\n  p,2,null\n  "+1",null,null'
    assert present.notation({"t": [1, "two", None]}) == "t[3]: 1,two,null" and present.notation({"t": ["1", "-"]}) == 't[2]: "1","-"'
    prose = present.notation({"help": ["Run `x: y`, then wait", "-", " led", "null", ""]})
    assert prose == 'help[5]:\n  Run `x: y`, then wait\n  -\n  " led"\n  null\n  ""'
    assert present.notation({"m": [1, {"k": [2]}, "s"]}) == 'm[3]:\n  "1"\n  "{\\"k\\": [2]}"\n  "\\"s\\""'
    assert present.notation({"o": [{"k": {"n": 1}}]}) == 'o[1]:\n  "{\\"k\\": {\\"n\\": 1}}"'


def test_numbers_as_cells(spark):
    import struct

    from pyspark.sql import functions as F

    from contractlog.functions import text

    values = [0.0, -0.0, 1.0, -2.5, 1e15, 123456789.25, 1e16, 1.5e16, -1.25e20, 1e22, 1e-4, 0.00012, 1e-5, -3.5e-7, 1e100, 2.5e-100, 12345678.5, 1e7, 9999999.75, 0.001, float("inf"), float("nan"), 1 / 3, 1e300]
    values += [struct.unpack("<d", struct.pack("<q", k * 0x0123456789ABCDEF & 0x7FDFFFFFFFFFFFFF))[0] for k in range(1, 40)]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double").select("k", text.number(F.col("v")).alias("s"))
    got = {r.k: r.s for r in df.collect()}
    wrong = [(v, got[k], present.number(v)) for k, v in enumerate(values) if got[k] != present.number(v) and (got[k] == "null" or float(got[k]) != v)]
    assert not wrong
    assert all(got[k] == present.number(v) for k, v in enumerate(values[:24]))


def test_home_folder_is_short(monkeypatch):
    monkeypatch.setenv("HOME", "/home/u")
    assert present.from_home("/home/u/x") == "~/x" and present.from_home("/home/u") == "~" and present.from_home("/home/uv") == "/home/uv"
