"""Contracts: what a record may hold, read from YAML at run time.

A contract names the fields of a record, the key field, and what happens to undeclared
fields. Everything about it is decided here, on the driver, before any row is read; the
column expressions that apply it are in ``contractlog.functions.checks``.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

import yaml
from pyspark.sql import types as T

#: The type names of a contract and the kind that each stands for.
TYPE_NAMES = {
    "str": "str", "string": "str", "text": "str",
    "int": "int", "integer": "int",
    "float": "float", "number": "float",
    "bool": "bool", "boolean": "bool",
    "datetime": "datetime", "date": "date", "time": "time",
    "uuid": "uuid", "email": "email", "any": "any",
}
ENUMS, LISTS, DICTS = ("enum", "choice"), ("list", "array"), ("dict", "object", "map")
#: The keys of a field, beside its type.
RULES = ("ge", "le", "gt", "lt", "multiple_of", "min_length", "max_length", "pattern")
SPEC_KEYS = {"type", "values", "items", "required", "default", "description", "title", *RULES}
EXTRAS = ("forbid", "ignore", "allow")

NUMERIC, TEXTUAL = ("int", "float"), ("str", "email", "uuid")
SPARK_TYPES = {
    "str": T.StringType(), "int": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType(),
    "datetime": T.StringType(), "date": T.StringType(), "time": T.StringType(), "uuid": T.StringType(), "email": T.StringType(),
    "any": T.VariantType(), "dict": T.VariantType(),
}


class ContractError(ValueError):
    """The contract itself is wrong."""


@dataclass(frozen=True)
class Kind:
    """A resolved type: its name, an enum's values, a list's items."""

    name: str
    values: tuple = ()
    items: "Kind | None" = None

    @property
    def spark(self) -> T.DataType:
        if self.name == "enum":
            if all(isinstance(v, bool) for v in self.values):
                return T.BooleanType()
            if all(isinstance(v, int) and not isinstance(v, bool) for v in self.values):
                return T.LongType()
            return T.StringType()
        if self.name == "list":
            return T.ArrayType(self.items.spark)
        return SPARK_TYPES[self.name]

    def told(self) -> str:
        """How a schema report writes it."""
        if self.name == "enum":
            return "enum[" + ",".join(map(str, self.values)) + "]"
        return f"list[{self.items.told()}]" if self.name == "list" else self.name

    @property
    def scalar(self) -> bool:
        return self.name not in ("list", "dict", "any")


@dataclass(frozen=True)
class Field:
    name: str
    kind: Kind
    required: bool = True
    nullable: bool = False
    default: Any = None
    rules: dict[str, Any] = field(default_factory=dict)
    description: str = ""


@dataclass(frozen=True)
class Contract:
    name: str
    key: str
    extra: str
    fields: tuple[Field, ...]

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    def __getitem__(self, name: str) -> Field:
        return next(f for f in self.fields if f.name == name)

    def default_fields(self, count: int = 4) -> list[str]:
        """What a list shows unasked: the key, then required and then optional scalars."""
        rest = [f for f in self.fields if f.name != self.key and f.kind.scalar]
        ordered = [f.name for f in rest if f.required] + [f.name for f in rest if not f.required]
        return [self.key, *ordered[: count - 1]]

    def summary(self) -> list[tuple[str, str, bool, str]]:
        """(field, type, required, rules) in order."""
        return [(f.name, f.kind.told(), f.required, " ".join(f"{k}={f.rules[k]}" for k in RULES if k in f.rules)) for f in self.fields]

    def json_schema(self) -> dict:
        """A JSON schema of one record."""
        names = {"str": "string", "int": "integer", "float": "number", "bool": "boolean", "dict": "object"}

        def of(kind: Kind) -> dict:
            if kind.name == "enum":
                return {"enum": list(kind.values)}
            if kind.name == "list":
                return {"type": "array", "items": of(kind.items)}
            if kind.name == "any":
                return {}
            if kind.name in names:
                return {"type": names[kind.name]}
            return {"type": "string", "format": {"datetime": "date-time"}.get(kind.name, kind.name)}

        said = {"ge": "minimum", "le": "maximum", "gt": "exclusiveMinimum", "lt": "exclusiveMaximum", "multiple_of": "multipleOf", "pattern": "pattern"}
        props = {}
        for f in self.fields:
            one = of(f.kind)
            for rule, value in f.rules.items():
                unit = "Items" if f.kind.name == "list" else "Length"
                one[said.get(rule) or rule.split("_")[0] + unit] = value
            if f.nullable:
                one = {"anyOf": [one, {"type": "null"}]}
            if not f.required:
                one["default"] = f.default
            props[f.name] = one
        out = {"title": self.name, "type": "object", "properties": props, "required": [f.name for f in self.fields if f.required]}
        return out | ({"additionalProperties": False} if self.extra == "forbid" else {})


def _kind(spec: Any, where: str) -> Kind:
    if isinstance(spec, str):
        spec = {"type": spec}
    if not isinstance(spec, dict):
        raise ContractError(f"{where}: must be a type name or a mapping")
    name = spec.get("type")
    if name is None:
        raise ContractError(f"{where}: missing 'type'")
    if name in ENUMS:
        values = spec.get("values")
        if not isinstance(values, list) or not values:
            raise ContractError(f"{where}: an enum needs a non-empty 'values' list")
        return Kind("enum", tuple(values))
    if name in LISTS:
        return Kind("list", items=_kind(spec.get("items", "str"), f"{where}.items"))
    if name in DICTS:
        return Kind("dict")
    if name not in TYPE_NAMES:
        raise ContractError(f"{where}: unknown type {name!r}; known: {', '.join(sorted({*TYPE_NAMES, *ENUMS, *LISTS, *DICTS}))}")
    return Kind(TYPE_NAMES[name])


def _field(name: str, spec: Any) -> Field:
    if not isinstance(name, str) or name.startswith("_"):
        raise ContractError(f"field {name!r}: a name is text without a leading underscore")
    if isinstance(spec, str):
        return Field(name, _kind(spec, f"field {name!r}"))
    kind = _kind(spec, f"field {name!r}")
    if unknown := set(spec) - SPEC_KEYS:
        raise ContractError(f"field {name!r}: unknown key {', '.join(sorted(map(str, unknown)))}; known: {', '.join(sorted(SPEC_KEYS))}")
    rules = {k: spec[k] for k in RULES if spec.get(k) is not None}
    for rule in rules:
        fits = NUMERIC if rule in ("ge", "le", "gt", "lt", "multiple_of") else (*TEXTUAL, *(("list",) if rule != "pattern" else ()))
        if kind.name not in fits:
            raise ContractError(f"field {name!r}: {rule} doesn't apply to {kind.name}")
    more = {"rules": rules, "description": str(spec.get("description") or spec.get("title") or "")}
    if "default" in spec:
        return Field(name, kind, required=False, nullable=spec["default"] is None, default=spec["default"], **more)
    if spec.get("required") is False:
        return Field(name, kind, required=False, nullable=True, **more)
    return Field(name, kind, nullable=kind.name == "any", **more)


def parse_contract(text: str) -> Contract:
    try:
        body = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise ContractError(f"invalid YAML: {e}") from e
    if not isinstance(body, dict):
        raise ContractError("a contract must be a mapping")
    fields = body.get("fields")
    if not isinstance(fields, dict) or not fields:
        raise ContractError("a contract needs a non-empty 'fields' mapping")
    key, extra = body.get("key", "id"), body.get("extra", "forbid")
    if extra not in EXTRAS:
        raise ContractError(f"extra must be one of {'|'.join(EXTRAS)}")
    made = tuple(_field(n, s) for n, s in fields.items())
    if key not in fields:
        raise ContractError(f"key {key!r} is not among fields: {', '.join(fields)}")
    if not next(f for f in made if f.name == key).kind.scalar:
        raise ContractError(f"key {key!r} must be a scalar")
    return Contract(str(body.get("name", "Record")), key, extra, made)


def load_contract(path: str) -> Contract:
    try:
        with open(path, encoding="utf-8") as f:
            return parse_contract(f.read())
    except FileNotFoundError as e:
        raise ContractError(f"contract not found: {path}") from e


#: The contract of archive manifests.
SEGMENT_TEXT = """name: Segment
key: segment
fields:
  segment: str
  records: {type: int, ge: 0}
  bytes: {type: int, ge: 0}
  gz_bytes: {type: int, ge: 0}
  sha256: str
  rolled_at: datetime
"""
SEGMENT = parse_contract(SEGMENT_TEXT)
