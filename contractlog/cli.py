"""The command line: ``python -m contractlog.cli [-f STORE] [-c CONTRACT] COMMAND ...``.

Without a command it shows the stores below the working folder. Every command returns a report,
a dict, that is printed in the text notation or, for ``list`` and ``get`` with --json, as JSON.
Reports of failures have the keys error, code and, where something can be done, help.

Exit codes: 0 done, 1 failed or nothing found, 2 wrong usage, rejected input or an unsafe roll.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException

from contractlog import present
from contractlog.contract import ContractError, load_contract
from contractlog.functions.text import CELL, DETAIL, parse_size
from contractlog.storage import StoreError, open_store

NAME, VERSION, ABOUT = "contractlog", "0.2", "Record logs read under a contract, on Spark"
LIMIT = 100
REFUSED = ("USAGE_ERROR", "CONTRACT_ERROR", "CONTRACT_VIOLATION", "UNSAFE_ROLL")


class Shown(Exception):
    """A text that was asked for (--help, --version)."""


class Parser(argparse.ArgumentParser):
    """argparse without output of its own and without guessing at flags."""

    def __init__(self, *args, **more):
        super().__init__(*args, **{"allow_abbrev": False} | more)

    def error(self, message):
        flags = sorted({s for a in self._actions for s in a.option_strings if s.startswith("--")})
        raise StoreError("USAGE_ERROR", message, help=[f"Flags of `{self.prog}`: {', '.join(flags)}", f"Run `{self.prog} --help` for all of it"])

    def print_help(self, file=None):
        raise Shown(self.format_help())


def parser() -> Parser:
    top = Parser(prog=NAME, description=ABOUT)
    top.add_argument("-v", "-V", "--version", action="store_true")
    sub = top.add_subparsers(dest="command", parser_class=Parser, metavar="COMMAND")
    made = {name: sub.add_parser(name, help=said) for name, (_, said) in COMMANDS.items()}
    for p in (top, *(p for name, p in made.items() if name != "stores")):
        default = None if p is top else argparse.SUPPRESS
        p.add_argument("-f", "--file", default=default, help="the store: a .jsonl file or a folder")
        p.add_argument("-c", "--contract", default=default, help="its contract; by default the one beside the store")
    for name in ("get", "list"):
        made[name].add_argument("--json", action="store_true", help="JSON with the revision and all bad lines")
    made["put"].add_argument("record", nargs="?", help="a JSON object, or - for JSON lines on stdin")
    made["put"].add_argument("--set", action="append", default=[], metavar="FIELD=VALUE", help="one field; overrides the record's")
    for name in ("get", "delete"):
        made[name].add_argument("id")
    made["get"].add_argument("--full", action="store_true", help="long values whole")
    made["list"].add_argument("--fields", help="names with commas between them; by default the key and three more")
    for name in ("list", "keys"):
        made[name].add_argument("--limit", type=int, default=LIMIT)
    made["stores"].add_argument("--depth", type=int, default=present.DEPTH)
    made["stores"].add_argument("--all", action="store_true", help="every folder, every store")
    made["validate"].add_argument("--strict", action="store_true", help="exit code 1 if there are bad lines")
    made["roll"].add_argument("--if-larger-than", default="0", metavar="SIZE")
    made["roll"].add_argument("--archive-dir", metavar="DIR")
    made["roll"].add_argument("--force", action="store_true")
    made["schema"].add_argument("--json-schema", action="store_true")
    return top


# ---- reports --------------------------------------------------------------------------------


def _run(args, command: str, more: str = "") -> str:
    return f"`{NAME} -f {args.file} {command}`{more}"


def _overrides(pairs: list[str]) -> dict:
    out = {}
    for pair in pairs:
        name, sep, value = pair.partition("=")
        if not sep:
            raise StoreError("USAGE_ERROR", f"--set takes FIELD=VALUE, not {pair!r}", help=[f"Run `{NAME} put --set id=a1 --set name=Ada`"])
        try:
            out[name] = json.loads(value)
        except json.JSONDecodeError:
            out[name] = value
    return out


def _put(store, args, stdin):
    overrides = _overrides(args.set)
    if args.record is None and not overrides:
        raise StoreError("USAGE_ERROR", "put takes a JSON object, - for stdin, or --set", help=[f"Run `{NAME} put '{{\"id\":\"a1\"}}'`", f"Run `cat records.jsonl | {NAME} put -`"])
    given = (stdin if stdin is not None else sys.stdin) if args.record == "-" else [args.record or "{}"]
    done = store.put(store.incoming(list(given), overrides)).orderBy("seq").collect()  # as many as were given
    took = [{"id": r.key, "op": r.op} for r in done if r.op != "rejected"]
    refused = [{"id": "<no key>" if r.key is None else r.key, "problem": r.issues} for r in done if r.op == "rejected"]
    out = {"error": f"{len(refused)} records rejected by the contract", "code": "CONTRACT_VIOLATION"} if refused else {}
    out |= {"written": len(took), "rejected_count": len(refused)} | ({"records": took} if took else {})
    if refused:
        out |= {"rejected": refused, "help": [f"Run {_run(args, 'schema')} to see the contract"]}
    return out, 2 if refused else 0


def _missing(args, store, **more):
    return {"error": f"no record with {store.contract.key} {args.id!r} in {args.file}", "code": "NOT_FOUND", **more, "help": [f"Run {_run(args, 'list')} to see ids"]}, 1


def _get(store, args, stdin):
    if args.json:
        at = store.snapshot()
        found = {"revision": at.revision, "record": store.get(args.id, at=at), "bad_lines": store.first_bad_lines(at)}
        return (found, 0) if found["record"] is not None else _missing(args, store, **found)
    record = store.get(args.id, by_index=True)
    if record is None:
        return _missing(args, store)
    shown, cut = dict(record), []
    for name, value in record.items():
        text, full = (value, None) if args.full else present.truncated(value, DETAIL)
        if full is not None:
            shown[name] = text
            cut.append({"field": name, "shown": DETAIL, "total": full})
    return {"record": shown} | ({"truncated": cut, "help": [f"Run {_run(args, f'get {args.id} --full')} for whole values"]} if cut else {}), 0


def _list(store, args, stdin):
    fields = [f.strip() for f in (args.fields or "").split(",") if f.strip()]
    if unknown := [f for f in fields if f not in store.contract.names]:
        raise StoreError("USAGE_ERROR", f"unknown fields for this contract: {', '.join(unknown)}", help=[f"Fields: {', '.join(store.contract.names)}"])
    if args.json:
        return present.envelope(store, args.limit, fields), 0
    rows, total, bad = store.page(args.limit, fields or store.contract.default_fields())
    see_bad = [f"Run {_run(args, 'validate')} to see {bad} unreadable lines"] if bad else []
    if not total:
        return {"records": f"0 records in {args.file}"} | ({"bad": bad} if bad else {}) | {"help": [f"Run {_run(args, 'put ...')} to add one", *see_bad]}, 0
    cells = [{k: present.truncated(v if not isinstance(v, (dict, list)) else json.dumps(v, ensure_ascii=False, separators=(",", ":")), CELL) for k, v in r.items()} for r in rows]
    clipped = any(full is not None for r in cells for _, full in r.values())
    out = {"count": f"{len(rows)} of {total} total"} | ({"bad": bad} if bad else {})
    out[store.stem or "records"] = [{k: text for k, (text, _) in r.items()} for r in cells]
    tips = [f"Run {_run(args, 'get <id>')} for one record with all fields"]
    tips += [f"Run {_run(args, f'list --limit {total}')} for all {total} records"] if len(rows) == args.limit < total else []
    tips += [f"Run {_run(args, 'get <id> --full')} for whole values"] if clipped else []
    return out | {"help": tips + see_bad}, 0


def _keys(store, args, stdin):
    total = store.count()
    if not total:
        return {"keys": f"0 records in {args.file}", "help": [f"Run {_run(args, 'put ...')} to add one"]}, 0
    keys = store.keys(args.limit)
    out = {"count": f"{len(keys)} of {total} total", "keys": keys}
    return out | ({"help": [f"Run {_run(args, f'keys --limit {total}')} for all {total} ids"]} if len(keys) < total else {}), 0


def _delete(store, args, stdin):
    ((_, op),) = store.delete([args.id])
    if op == "absent":
        return {"delete": f"{args.id} already absent (no-op)"}, 0
    return {"delete": f"{args.id} removed", "help": [f"Run {_run(args, 'compact')} to reclaim its space"]}, 0


def _validate(store, args, stdin):
    found = store.validate()
    if not found["bad"]:
        return {"valid": found["valid"], "bad": 0}, 0
    issues = [x | {"line": "-" if x["line"] is None else x["line"]} for x in found["issues"]]
    tips = [f"Run {_run(args, 'repair')} to quarantine bad lines and compact", f"Run {_run(args, 'schema')} to see what the contract asks for"]
    tips += [f"The first {len(issues)} of {found['bad']} bad lines are shown"] if len(issues) < found["bad"] else []
    return {"valid": found["valid"], "bad": found["bad"], "issues": issues, "help": tips}, int(args.strict)


def _repair(store, args, stdin):
    done = store.repair()
    out = {"kept": done["kept"], "quarantined": done["dropped"]}
    if done["dropped"]:
        out["quarantine"] = getattr(store, "quarantine_path", f"{store.path}/quarantine")
        out["help"] = [f"Run {_run(args, 'validate')} to confirm that the store is clean"]
    return out, 0


def _compact(store, args, stdin):
    done = store.compact()
    return {"kept": done["kept"], "reclaimed_bytes": done["reclaimed_bytes"]}, 0


def _roll(store, args, stdin):
    try:
        threshold = parse_size(args.if_larger_than)
    except ValueError as e:
        raise StoreError("USAGE_ERROR", str(e), help=["A size is a number of bytes or has a unit: 50MB, 512k, 2GB"]) from e
    row = store.roll(args.archive_dir, threshold, args.force)
    if row is None:
        return {"roll": f"{args.file} is {store.snapshot().size:,} bytes, under {args.if_larger_than} (no-op)"}, 0
    folder = args.archive_dir or store.archive
    tips = [f"Run `{NAME} -f {os.path.join(folder, 'manifest.jsonl')} list` to see every segment", f"Run `gunzip -c {os.path.join(folder, row['segment'])}` to read this one"]
    return {"rolled": row["segment"], "records": row["records"], "bytes": row["bytes"], "gz_bytes": row["gz_bytes"], "help": tips}, 0


def _schema(store, args, stdin):
    c = store.contract
    if args.json_schema:
        return {"schema": json.dumps(c.json_schema())}, 0
    fields = [{"name": n, "type": t, "required": r, "rules": "; ".join(rules.split(" ")) if rules else None} for n, t, r, rules in c.summary()]
    return {"contract": args.contract or present.find_contract(args.file), "model": c.name, "key": c.key, "extra": c.extra, "fields": fields}, 0


def _discovered(spark, depth: int, most: int | None):
    return present.discover(".", depth, most, lambda path, contract: open_store(spark, path, contract).count())


def _stores(spark, args):
    depth = 99 if args.all else args.depth
    rows, more = _discovered(spark, depth, None if args.all else present.MOST)
    if not rows:
        return {"stores": f"0 stores found under {present.from_home(os.getcwd())} within {depth} levels", "help": [f"Run `{NAME} stores --all` to search without a limit"]}, 0
    return {"count": len(rows), "stores": rows} | ({"help": [f"Run `{NAME} stores --all` to see every store"]} if more else {}), 0


def _home(spark):
    out = {"bin": present.from_home(os.path.abspath(__file__)), "description": ABOUT, "version": VERSION}
    rows, more = _discovered(spark, present.DEPTH, present.MOST)
    if not rows:
        tips = [f"Write a contract to schema-<name>.yaml, then run `{NAME} -f <name>.jsonl put '{{...}}'`", f"Run `{NAME} --help` for all commands"]
        return out | {"stores": f"0 stores found in {present.from_home(os.getcwd())}", "help": tips}, 0
    first = f"-f {rows[0]['file']}" + (f" -c {rows[0]['contract']}" if rows[0]["contract"] else "")
    tips = [f"The first {present.MOST} stores are shown; run `{NAME} stores --all` to see every one"] if more else []
    tips += [f"Run `{NAME} {first} {what}`" for what in ("list", "get <id>", "validate")]
    return out | {"stores": rows, "help": tips}, 0


#: name -> (report of (store, args, stdin), what it does)
COMMANDS = {
    "put": (_put, "insert or update records"),
    "get": (_get, "one record by its key"),
    "list": (_list, "records in order of insertion"),
    "keys": (_keys, "keys in order of insertion"),
    "delete": (_delete, "remove a record"),
    "validate": (_validate, "hold every line against the contract"),
    "repair": (_repair, "quarantine bad lines, then compact"),
    "compact": (_compact, "rewrite the log as its live records"),
    "roll": (_roll, "seal the log into a compressed segment"),
    "schema": (_schema, "the contract"),
    "stores": (None, "stores below the working folder"),
}


def _opened(spark, args):
    if not args.file:
        raise StoreError("USAGE_ERROR", "--file is required", help=[f"Run `{NAME}` to list the stores below this folder"])
    at = args.contract or present.find_contract(args.file)
    if not at:
        stem = os.path.basename(args.file).removesuffix(".jsonl")
        raise StoreError("USAGE_ERROR", f"no contract given and none found for {args.file}", help=[f"Run `{NAME} -f {args.file} -c <contract.yaml> {args.command}`", f"Or write {stem}.yaml beside it"])
    try:
        return open_store(spark, args.file, load_contract(at))
    except ContractError as e:
        raise StoreError("CONTRACT_ERROR", str(e), help=[f"Run `{NAME} -f {args.file} -c <contract> schema` to inspect a contract"]) from e


def run(spark, argv: list[str], stdin=None) -> tuple[dict | str, int]:
    """(report or text, exit code) of one command; nothing is raised."""
    try:
        args = parser().parse_args(argv)
        if args.version:
            return VERSION, 0
        if not args.command:
            return _home(spark)
        if args.command == "stores":
            return _stores(spark, args)
        return COMMANDS[args.command][0](_opened(spark, args), args, stdin)
    except Shown as e:
        return str(e), 0
    except StoreError as e:
        return {"error": str(e), "code": e.code, **e.extra}, 2 if e.code in REFUSED else 1
    except (OSError, Py4JError, PySparkException) as e:
        return {"error": f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}", "code": "IO_ERROR", "help": ["Check that the store's folder is there and can be written"]}, 1
    except Exception as e:  # a report, never a traceback
        return {"error": f"{type(e).__name__}: {e}", "code": "INTERNAL_ERROR", "help": [f"Run `{NAME} -f <store> validate` to check the store"]}, 1


def wants_json(argv: list[str]) -> bool:
    return "--json" in argv and any(a in ("list", "get") for a in argv)


def main(argv: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    argv = sys.argv[1:] if argv is None else argv
    spark = SparkSession.builder.appName(NAME).config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    report, code = run(spark, argv)
    try:
        print(report if isinstance(report, str) else json.dumps(report, ensure_ascii=False, indent=2) if wants_json(argv) else present.notation(report))
    except BrokenPipeError:
        return 0
    return code


if __name__ == "__main__":
    sys.exit(main())
