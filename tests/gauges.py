"""Records of river gauges: the domain of the store and command line tests."""

import json

GAUGES = """
name: Gauge
key: code
fields:
  code: {type: str, pattern: '^G[0-9]{2,4}$'}
  river: {type: str, min_length: 2, max_length: 40}
  level: {type: float, gt: -5, lt: 60}
  checked: {type: date, required: false}
  state: {type: enum, values: [open, shut, iced], default: open}
  owners: {type: list, items: str, default: []}
"""
PLAIN = {"code": "G10", "river": "Elbe", "level": 3.5}
WHOLE = {"code": "G10", "river": "Elbe", "level": 3.5, "checked": None, "state": "open", "owners": []}


def gauge(code, **more):
    return PLAIN | {"code": code} | more


def body(*lines: bytes | dict | str) -> bytes:
    """Lines as bytes; what is bytes already stands as it is, with no line feed added."""
    return b"".join(x if isinstance(x, bytes) else (x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)).encode() + b"\n" for x in lines)
