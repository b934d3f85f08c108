"""Stores in folders and in files: folds, bad lines, positions, writes and maintenance, against a plain model."""

import gzip
import hashlib
import json
import os
import random

import pytest
from gauges import GAUGES, PLAIN, WHOLE, body, gauge

from contractlog.contract import ContractError, parse_contract
from contractlog.storage import FileStore, Store, StoreError, open_store

CONTRACT = parse_contract(GAUGES)


@pytest.fixture
def log(spark, tmp_path):
    """A file store whose log holds the given lines."""

    def make(*lines):
        path = tmp_path / f"log{len(list(tmp_path.iterdir()))}.jsonl"
        path.write_bytes(body(*lines))
        return open_store(spark, str(path), CONTRACT)

    return make


@pytest.fixture(params=["folder", "file"])
def store(spark, tmp_path, request):
    return open_store(spark, str(tmp_path / ("gauges" if request.param == "folder" else "gauges.jsonl")), CONTRACT)


def shown(s):
    return [json.loads(r.record) for r in s.live().orderBy("pos").collect()]


def test_kinds_of_stores(spark, tmp_path, log):
    assert isinstance(log(), FileStore) and isinstance(open_store(spark, str(tmp_path / "new.jsonl"), CONTRACT), FileStore)
    (tmp_path / "dir.jsonl").mkdir()
    for name in ("folder", "dir.jsonl"):
        assert type(open_store(spark, str(tmp_path / name), CONTRACT)) is Store


def test_damage_is_isolated(log):
    s = log(gauge("G77"), '{"code":"G12","river":', "\t ", gauge("G13", river="E", level=60), '["G14"]', gauge("G15", river="Oder"), '{"river":"Spree","level":1}', b'{"code":"G16","ri')
    assert [r["code"] for r in shown(s)] == ["G77", "G15"] and shown(s)[0] == WHOLE | {"code": "G77"}
    got = s.validate()
    assert (got["valid"], got["bad"]) == (2, 5) and [x["line"] for x in got["issues"]] == [2, 4, 5, 7, 8]
    reasons = [x["reason"] for x in got["issues"]]
    assert reasons[0].startswith("invalid json: ") and " at col " in reasons[0]
    assert reasons[1] == "contract violation: river: String should have at least 2 characters; level: Input should be less than 60"
    assert reasons[2:4] == ["missing key 'code'"] * 2 and reasons[4].startswith("torn tail")
    assert len(s.validate(most=1)["issues"]) == 1


def test_fold_and_index(log):
    s = log(PLAIN, gauge("G21"), {"code": "G10", "_deleted": True}, PLAIN, gauge("G22"), gauge("G22", level=99), {"code": "G21", "_deleted": 1})
    assert [r["code"] for r in shown(s)] == ["G10", "G22"] and s.keys() == ["G10", "G22"] and s.count() == 2
    assert s.get("G22")["level"] == 3.5 and s.get("G22", by_index=True) is None
    assert s.get("G21") is None and s.get("nowhere") is None and s.get("G10", by_index=True) == WHOLE
    rows, total, bad = s.page(1, ["level", "code"])
    assert rows == [{"level": 3.5, "code": "G10"}] and list(rows[0]) == ["level", "code"] and (total, bad) == (2, 1)
    assert s.page(0)[0] == [] and s.append_only_violations() == (2, 2)
    with pytest.raises(StoreError):
        s.page(5, ["depth"])
    assert [r.reason for r in log(PLAIN | {"_deleted": False}).bad_lines().collect()] == ["contract violation: _deleted: Extra inputs are not permitted"]


def test_keys_by_their_coerced_value(spark, tmp_path):
    path = tmp_path / "n.jsonl"
    path.write_text('{"n":1,"t":"a"}\n{"n":"1","t":"b"}\n{"n":1.0,"t":"c"}\n{"n":2,"t":"d"}\n{"n":" 2 ","_deleted":true}\n')
    s = open_store(spark, str(path), parse_contract("key: n\nfields: {n: int, t: str}"))
    assert shown(s) == [{"n": 1, "t": "c"}] and s.get(1) == {"n": 1, "t": "c"} and s.get("2") is None
    assert s.delete([1, 3]) == [("1", "deleted"), ("3", "absent")] and s.keys() == []


def test_positions_and_line_ends(log, spark):
    lines = [json.dumps(gauge("G31", river="Łaba 🌊" * 20), ensure_ascii=False).encode() + b"\r\n", b"\n", b"\xc3\x28 bad\n", body(PLAIN)] + [b'{"code":"G3'] * 3
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        got = sorted((r.line, r.offset, r.torn) for r in log(*lines).lines().collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    whole, want, at = b"".join(lines), [], 0
    for k, part in enumerate(whole.split(b"\n")):
        want.append((k + 1, at, at + len(part) + 1 > len(whole)))
        at += len(part) + 1
    assert got == want


def test_every_cut_of_the_tail(log):
    last = body(gauge("G41", river="Łódź 🌊"))
    for cut in range(0, len(last), 19):
        live = [r["code"] for r in shown(log(PLAIN, gauge("G40"), last[:cut]))]
        assert live == ["G10", "G40"]
    assert len(shown(log(PLAIN, last))) == 2


def test_writes(store):
    put = lambda *r, **o: [(x.key, x.op) for x in store.put(store.incoming(r, **o)).orderBy("seq").collect()]
    assert store.keys() == [] and store.get("G10") is None and store.validate() == {"valid": 0, "bad": 0, "issues": []}
    assert put(PLAIN, gauge("G11"), gauge("G10", level="4"), gauge("G10", level=4), gauge("G12", level=400)) == [
        ("G10", "created"), ("G11", "created"), ("G10", "updated"), ("G10", "unchanged"), ("G12", "rejected"),
    ]
    assert put(gauge("G10", level=4.0), '{"code":"G13","river":"Ems","level":0}') == [("G10", "unchanged"), ("G13", "created")]
    assert put(gauge("G11"), overrides={"state": "shut"}) == [("G11", "updated")] and store.get("G11")["state"] == "shut"
    assert sorted(store.delete(["G11", "G99"])) == [("G11", "deleted"), ("G99", "absent")]
    assert store.keys() == ["G10", "G13"] and put(gauge("G11")) == [("G11", "created")] and store.keys() == ["G10", "G13", "G11"]
    before = shown(store)
    got = store.compact()
    assert got["kept"] == 3 and got["bad"] == 0 and got["reclaimed_bytes"] > 0 and shown(store) == before
    with pytest.raises(StoreError):
        store.incoming(["{code"])


def test_append_closes_a_torn_tail(log):
    s = log(PLAIN, b'{"code":"G5')
    s.put(s.incoming([gauge("G50")]))
    assert s.keys() == ["G10", "G50"] and [r.reason[:12] for r in s.bad_lines().collect()] == ["invalid json"]
    assert open(s.local, "rb").read().startswith(body(PLAIN) + b'{"code":"G5\n')


def test_repair_keeps_what_it_drops(log):
    s = log(PLAIN, "nonsense", gauge("G60", level=-9), gauge("G61"), {"code": "G10", "_deleted": True}, b"half")
    with pytest.raises(StoreError):
        s.compact(on_bad="error")
    assert s.repair() == {"kept": 1, "dropped": 3} and s.keys() == ["G61"]
    assert [(r.line, r.raw) for r in s.quarantine().orderBy("offset").collect()] == [(2, "nonsense"), (3, json.dumps(gauge("G60", level=-9))), (6, "half")]
    assert open(s.local, "rb").read() == json.dumps(WHOLE | {"code": "G61"}, separators=(",", ":")).encode() + b"\n"
    assert s.repair() == {"kept": 1, "dropped": 0} and s.quarantine().count() == 3


def test_repair_of_a_folder(spark, tmp_path):
    s = Store(spark, str(tmp_path / "g"), CONTRACT)
    made = s._write_parts(spark.createDataFrame([("{oops",), (json.dumps(PLAIN),)], "value string").coalesce(1), "value")
    assert s._commit(1, made) and not s._commit(1, made)
    assert s.repair() == {"kept": 1, "dropped": 1} and s.quarantine().first().reason.startswith("invalid json")
    assert s.repair() == {"kept": 1, "dropped": 0} and s.quarantine().count() == 1


def test_roll_seals_the_bytes(store, spark):
    store.put(store.incoming([gauge(f"G{k}") for k in range(100, 120)]))
    if isinstance(store, FileStore):
        open(store.local, "ab").write(b'  \n{"torn')
    raw = b"".join(open(p, "rb").read() for p in store.snapshot().parts)
    assert store.roll(threshold=10**9) is None
    row = store.roll()
    sealed = gzip.decompress(open(f"{store.archive}/{row['segment']}", "rb").read())
    assert sealed == raw and row["bytes"] == len(raw) and row["sha256"] == hashlib.sha256(raw).hexdigest()
    assert row["records"] == 20 + isinstance(store, FileStore) and store.keys() == [] and store.roll() is None
    listed = open_store(spark, f"{store.archive}/manifest.jsonl", f"{store.archive}/schema-manifest.yaml")
    assert listed.keys() == [row["segment"]] and store.audit() == [{"segment": row["segment"], "ok": True}]
    store.put(store.incoming([PLAIN]))
    again = store.roll()
    assert listed.keys() == [row["segment"], again["segment"]]
    with open(f"{store.archive}/{again['segment']}", "wb") as f:
        f.write(gzip.compress(b"something else"))
    os.unlink(f"{store.archive}/{row['segment']}")
    assert [x["ok"] for x in store.audit()] == [False, False]


def test_roll_is_guarded(store):
    store.put(store.incoming([PLAIN]))
    store.put(store.incoming([gauge("G10", level=1), gauge("G11")]))
    store.delete(["G11"])
    with pytest.raises(StoreError) as e:
        store.roll()
    assert e.value.code == "UNSAFE_ROLL" and e.value.extra["updated_keys"] == 1 and e.value.extra["tombstones"] == 1
    assert store.roll(force=True)["records"] == 4


def test_many_commits_are_listed_now_and_then(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("contractlog.storage.CHECKPOINT", 2)
    s = Store(spark, str(tmp_path / "g"), CONTRACT)
    for k in range(5):
        s.put(s.incoming([gauge(f"G{10 + k}")]))
    assert sum(n.endswith(".parts.json") for n in s._names("_commits")) == 2
    at = s.snapshot()
    assert at.version == 5 and len(at.parts) == 5 and at.size == sum(os.path.getsize(p) for p in at.parts)
    assert s.keys() == [f"G{10 + k}" for k in range(5)] and s.compact()["kept"] == 5 and s.snapshot().version == 6


def test_index_of_a_folder(spark, tmp_path, monkeypatch):
    """Reads by the index and the parts after it equal those of the whole log."""
    monkeypatch.setattr("contractlog.storage.INDEX_AFTER", 3)
    s, rng, live = Store(spark, str(tmp_path / "g"), CONTRACT), random.Random(8), {}
    bad = json.dumps(gauge("G12", level=99))
    for k in range(5):
        if k == 3:
            live.pop("G11", None)
            s.delete(["G11"])
        codes = [f"G{10 + rng.randrange(5)}" for _ in range(4)] + ["G11"] * (k < 3)
        for c in codes:
            live[c] = float(k)
        s.put(s.incoming([gauge(c, level=k) for c in dict.fromkeys(codes)]))
        if k == 1:  # an off-contract version hides the valid one from the index only
            s._commit(s.snapshot().version + 1, s._write_parts(spark.createDataFrame([(bad,)], "value string"), "value"))
    at = s.snapshot()
    state, known = s._state(at)
    assert state is not None and 0 < known <= len(at.parts)
    whole = {r.key: (r.seq, r.pos) for r in Store._live(s.classified(at, record=True)).collect()}
    assert {r["code"]: r["level"] for r in shown(s)} == live and [k for k, _ in sorted(whole.items(), key=lambda x: x[1][1])] == [k for k in s.keys() if k in whole]
    for c in (*live, "G11", "G99"):
        got = s.get(c)
        assert (got and got["level"]) == live.get(c) and (s.get(c, by_index=True) is not None) == (c in live and s.index().where(f"key = '{c}' and fine").count() == 1)
    s.refresh_index()
    assert s._state(s.snapshot())[1] == len(s.snapshot().parts) and s.get("G10") == (None if "G10" not in live else WHOLE | {"level": live["G10"]})
    s.compact()
    assert s._state(s.snapshot())[0] is None and {r["code"]: r["level"] for r in shown(s)} == live and s.count() == len(live)


def test_follow_hands_over_new_parts(spark, tmp_path):
    from contractlog.streaming.incremental import follow

    s, seen = Store(spark, str(tmp_path / "g"), CONTRACT), []
    for codes in (("G10", "G11"), ("G12",)):
        s.put(s.incoming([gauge(c) for c in codes]))
        follow(spark, f"{s.path}/log", str(tmp_path / "checkpoint"), lambda df, k: seen.append(sorted(json.loads(r.value)["code"] for r in df.collect()))).awaitTermination()
    assert seen == [["G10", "G11"], ["G12"]]


def test_tail_from_an_offset(log):
    from contractlog.sources import lines

    s = log(PLAIN, gauge("G70"), gauge("G71"))
    start = len(body(PLAIN))
    got = lines.tail(s.lines(), start).orderBy("offset").collect()
    assert [r.offset for r in got] == [start, start + len(body(gauge("G70")))] and {r.line for r in got} == {None}


def test_fold_equals_a_plain_model(log):
    rng = random.Random(6)
    lines, live = [], {}
    for _ in range(300):
        code, kind = f"G{rng.randrange(10, 22)}", rng.random()
        if kind < 0.2:
            lines.append({"code": code, "_deleted": True})
            live.pop(code, None)
        elif kind < 0.3:
            lines.append(gauge(code, level=-70))
        else:
            level = float(rng.randrange(50))
            lines.append(gauge(code, level=level))
            live[code] = level
    assert [(r["code"], r["level"]) for r in shown(log(*lines))] == list(live.items())


@pytest.mark.parametrize(
    ("text", "said"),
    [
        ("just text", "must be a mapping"),
        ("name: X", "non-empty 'fields'"),
        ("key: a\nfields: {a: [str]}", "must be a type name or a mapping"),
        ("key: a\nfields: {a: {ge: 1}}", "missing 'type'"),
        ("key: a\nfields: {a: decimal}", "unknown type"),
        ("key: a\nfields: {a: {type: int, maximum: 9}}", "unknown key"),
        ("key: a\nfields: {a: str, b: {type: choice, values: []}}", "non-empty 'values'"),
        ("key: a\nfields: {a: str, b: {type: bool, le: 1}}", "doesn't apply"),
        ("key: b\nfields: {a: str}", "is not among fields"),
        ("key: a\nfields: {a: {type: list, items: int}}", "must be a scalar"),
        ("key: a\nextra: warn\nfields: {a: str}", "forbid|ignore|allow"),
        ("key: a\nfields: {a: str", "invalid YAML"),
    ],
)
def test_wrong_contracts(text, said):
    with pytest.raises(ContractError) as e:
        parse_contract(text)
    assert said in str(e.value)


def test_coercions_of_moments_and_numbers(spark):
    """(type, JSON value) -> (coerced, message), by the rules of the format."""
    from pyspark.sql import functions as F

    from contractlog.contract import Kind
    from contractlog.functions import checks

    cases = {
        ("datetime", "1700000000000"): "2023-11-14T22:13:20Z", ("datetime", "1700000000"): "2023-11-14T22:13:20Z", ("datetime", "-1.5"): "1969-12-31T23:59:58.500000Z",
        ("datetime", '"2024-05-06T07:08:09+0200"'): "2024-05-06T07:08:09+02:00", ("datetime", '"2024-05-06T07:08:09+00:00"'): "2024-05-06T07:08:09Z",
        ("datetime", '"2024-05-06 07:08z"'): "2024-05-06T07:08:00Z", ("datetime", '"2024-05-06T07:08:09.12"'): "2024-05-06T07:08:09.120000", ("datetime", '"2024-05-06T07:08:09.000-03:30"'): "2024-05-06T07:08:09-03:30",
        ("datetime", "1e30"): None, ("datetime", "[]"): None, ("date", "0"): "1970-01-01", ("date", "1700006400"): "2023-11-15", ("date", "1700006400000"): "2023-11-15", ("date", "1"): None,
        ("date", '"2024-02-30"'): None, ("date", '"2024-02-29T00:00:00"'): "2024-02-29", ("time", '"07:08:09.5+0100"'): "07:08:09.500000+01:00", ("time", "86399"): "23:59:59Z", ("time", "86400"): None,
        ("int", '"1_000"'): "1000", ("int", '" +7.00 "'): "7", ("int", "12345678901234567890"): None, ("int", "1e30"): None, ("int", "9007199254740993.0"): "9007199254740993", ("int", '"_1"'): None,
        ("float", '"1_0"'): "10.0", ("float", '"1__0"'): None, ("float", '".5e1"'): "5.0",
    }
    for kind in {k for k, _ in cases}:
        given = [(v,) for k, v in cases if k == kind]
        x, said = checks.typed(Kind(kind), F.col("v"))
        rows = spark.createDataFrame(given, "j string").withColumn("v", F.parse_json("j")).select("j", F.when(said.isNull(), x.cast("string")).alias("x"), said.alias("said")).collect()
        assert {r.j: r.x for r in rows} == {v: w for (k, v), w in cases.items() if k == kind}
        assert all((r.x is None) == (r.said is not None) for r in rows)
        long = [r.said for r in rows if kind == "int" and r.j in ("12345678901234567890", "1e30")]
        assert all("64 bits" in s for s in long)
