"""From Spark schemas to the columns that can be compared."""

from __future__ import annotations

from collections.abc import Collection, Iterable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import types as T

from ..functions.kinds import KINDS, SKETCHES, Kind, Settings

#: Which kind each atomic type has.
ATOMIC: dict[type[T.DataType], str] = {
    T.ByteType: "INTEGER",
    T.ShortType: "INTEGER",
    T.IntegerType: "INTEGER",
    T.LongType: "INTEGER",
    T.FloatType: "FLOAT",
    T.DoubleType: "FLOAT",
    T.DecimalType: "FLOAT",
    T.StringType: "STRING",
    T.CharType: "STRING",
    T.VarcharType: "STRING",
    T.TimestampType: "TIMESTAMP",
    T.TimestampNTZType: "TIMESTAMP",
    T.DateType: "DATE",
    T.BooleanType: "BOOLEAN",
}


class KeyColumnError(ValueError):
    """A key column is missing."""


@dataclass(frozen=True)
class Column:
    """name: with dots for fields of structs; type: as Spark writes it."""

    name: str
    kind: str
    type: str
    nullable: bool = True

    @property
    def alias(self) -> str:
        return alias_of(self.name)

    @property
    def path(self) -> str:
        return ".".join(f"`{part}`" for part in self.name.split("."))

    @property
    def strategy(self) -> Kind:
        return KINDS.get(f"{self.kind} {self.type}") or KINDS[self.kind]

    @property
    def supported(self) -> bool:
        return self.kind != "UNSUPPORTED"

    @property
    def struct(self) -> bool:
        return self.type.startswith("struct<")


def alias_of(name: str) -> str:
    return name.replace(".", "__")


def split_names(text: str | None) -> list[str] | None:
    """Names between commas; None if there is none."""
    return [n.strip() for n in (text or "").split(",") if n.strip()] or None


def kind_of(kind: T.DataType) -> str:
    if isinstance(kind, T.ArrayType):
        inner = kind.elementType
        parts = [f.dataType for f in inner.fields] if isinstance(inner, T.StructType) else [inner]
        return "ARRAY" if parts and all(type(p) in ATOMIC for p in parts) else "UNSUPPORTED"
    return ATOMIC.get(type(kind), "UNSUPPORTED")


def flatten(schema: T.StructType, prefix: str = "", whole: Collection[str] = ()) -> list[Column]:
    """The leaves of nested structs; arrays stay whole, and so do the structs named in `whole`."""
    found: list[Column] = []
    for f in schema.fields:
        name = prefix + f.name
        if isinstance(f.dataType, T.StructType) and name not in whole:
            found += flatten(f.dataType, name + ".", whole)
        else:
            found.append(Column(name, kind_of(f.dataType), f.dataType.simpleString(), f.nullable))
    return found


def describe(schema: T.StructType, sketches: Collection[str] = (), int_sketches: Collection[str] = (), geography: Collection[str] = ()) -> list[Column]:
    """The columns with their kinds; sketches and geography are opted into by name."""
    columns = flatten(schema, whole=geography)
    if both := sorted({*sketches} & {*int_sketches}):
        raise ValueError(f"columns in both kinds of sketches: {', '.join(both)}")
    known = {c.name: c for c in columns}
    chosen = {n: SKETCHES[0] for n in sketches} | {n: SKETCHES[1] for n in int_sketches} | {n: "GEOGRAPHY" for n in geography}
    if missing := sorted(chosen.keys() - known.keys()):
        raise ValueError(f"no such columns: {', '.join(missing)}")
    for name, kind in chosen.items():
        c = known[name]
        if kind in SKETCHES and c.type != "binary":
            raise ValueError(f"{name} is no binary column, so it holds no sketches")
        if kind == "GEOGRAPHY" and c.type != "string" and not {"lon", "lat"} <= {
            p.split(":")[0] for p in c.type.removeprefix("struct<").removesuffix(">").split(",")
        }:
            raise ValueError(f"{name} is neither text nor a struct with lon and lat")
    found = [replace(c, kind=chosen.get(c.name, c.kind)) for c in columns]
    by_alias: dict[str, str] = {}
    for c in found:
        if by_alias.setdefault(c.alias, c.name) != c.name:
            raise ValueError(f"{c.name} and {by_alias[c.alias]} would have the same name in the output")
    return found


def by_kind(columns: Iterable[Column], *kinds: str) -> list[str]:
    return [c.name for c in columns if c.kind in kinds]


@dataclass(frozen=True)
class Intersection:
    """columns: in both tables with one type, in A's order; the rest says what is left out and why."""

    columns: list[Column]
    only_in_a: list[str]
    only_in_b: list[str]
    type_differs: list[tuple[str, str, str]]

    def warnings(self) -> list[str]:
        out = [f"only in {side}: {', '.join(names)}" for side, names in (("A", self.only_in_a), ("B", self.only_in_b)) if names]
        return out + [f"types differ: {n} ({a} and {b})" for n, a, b in self.type_differs]

    @property
    def values(self) -> list[Column]:
        return [c for c in self.columns if c.supported]

    @property
    def excluded(self) -> list[tuple[str, str]]:
        return [(c.name, c.type) for c in self.columns if not c.supported]


def intersect(a: Sequence[Column], b: Sequence[Column], keys: Sequence[str], coerce_numeric: bool = False) -> Intersection:
    """coerce_numeric: integers of different widths, or floats, also match."""
    in_a, in_b = {c.name: c for c in a}, {c.name: c for c in b}
    if not keys:
        raise KeyColumnError("no key columns")
    for side, known in (("A", in_a), ("B", in_b)):
        if missing := [k for k in keys if k not in known]:
            raise KeyColumnError(f"key columns missing in {side}: {', '.join(missing)}")
    same = lambda x, y: x.kind == y.kind and (x.type == y.type or (coerce_numeric and x.kind in ("INTEGER", "FLOAT")))
    common = [c for c in a if c.name in in_b]
    differs = [(c.name, c.type, in_b[c.name].type) for c in common if not same(c, in_b[c.name])]
    lost = {n for n, _, _ in differs}
    if bad := [k for k in keys if k in lost]:
        raise KeyColumnError(f"key columns of different types: {', '.join(bad)}")
    found = Intersection(
        [c for c in common if c.name not in lost],
        [c.name for c in a if c.name not in in_b],
        [c.name for c in b if c.name not in in_a],
        differs,
    )
    check_key_names([in_a[k] for k in keys], found.values)
    return found


#: What the output adds to a column's name for its differences and flags.
SUFFIXES = ("delta", "abs_delta", "rel_delta", "match", "mismatch", "len_delta", "max_abs_value_diff", "distance_meters", "within_tolerance", "eq")


def check_key_names(keys: Iterable[Column], values: Iterable[Column]) -> None:
    """Keys keep their names in the output, so none may be called like what stands beside them there."""
    taken = {"in_a", "in_b"} | {f"{side}__{c.alias}" for c in values for side in "ab"} | {f"{c.alias}__{s}" for c in values for s in SUFFIXES}
    if bad := [k.name for k in keys if k.alias in taken]:
        raise KeyColumnError(f"key columns named like columns of the output: {', '.join(bad)}; rename them first")


def check_tolerances(columns: Iterable[Column], settings: Settings) -> None:
    """A tolerance may not name a column whose kind has none of its own: arrays and sketches."""
    named = settings.tolerance.named()
    for kinds, what in ((("ARRAY",), "array"), (SKETCHES, "sketch")):
        if bad := sorted(named & set(by_kind(columns, *kinds))):
            raise ValueError(f"no tolerance can be given for the {what} columns {', '.join(bad)}")
