"""Types, schemas and relation keys."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import types as T

NAME = re.compile(r"^[a-zA-Z_]\w*$")
#: The eight types and what Spark calls them.
TYPES = {
    "INT_TYPE": T.IntegerType(),
    "FLOAT_TYPE": T.FloatType(),
    "DOUBLE_TYPE": T.DoubleType(),
    "BOOLEAN_TYPE": T.BooleanType(),
    "STRING_TYPE": T.StringType(),
    "LONG_TYPE": T.LongType(),
    "BLOB_TYPE": T.BinaryType(),
    "DATETIME_TYPE": T.TimestampType(),
}
NAMES = {t: n for n, t in TYPES.items()}


class PlanError(ValueError):
    """A plan, schema or relation that can't be accepted."""


@dataclass(frozen=True)
class Schema:
    """Ordered, uniquely named columns."""

    types: tuple[str, ...]
    names: tuple[str, ...] = ()

    def __post_init__(self):
        if not self.names:
            object.__setattr__(self, "names", tuple(f"col{i}" for i in range(len(self.types))))
        if len(self.names) != len(self.types):
            raise PlanError("as many names as types are needed")
        if len(set(self.names)) != len(self.names):
            raise PlanError(f"repeated column names in {self.names}")
        for n in self.names:
            if not NAME.match(n):
                raise PlanError(f"bad column name {n!r}")
        for t in self.types:
            if t not in TYPES:
                raise PlanError(f"unknown type {t!r}")

    @staticmethod
    def of(struct: T.StructType) -> Schema:
        return Schema(tuple(NAMES[f.dataType] for f in struct), tuple(f.name for f in struct))

    @staticmethod
    def parse(x: dict) -> Schema:
        return Schema(tuple(x["columnTypes"]), tuple(x.get("columnNames") or ()))

    @property
    def spark(self) -> T.StructType:
        return T.StructType([T.StructField(n, TYPES[t]) for n, t in zip(self.names, self.types, strict=True)])

    def compatible(self, other: Schema) -> bool:
        """Equal types, whatever the names."""
        return self.types == other.types

    def sub(self, columns) -> Schema:
        return Schema(tuple(self.types[i] for i in columns), tuple(self.names[i] for i in columns))

    def merge(self, other: Schema) -> Schema:
        return Schema(self.types + other.types, tuple(merged_names(self.names, other.names)))


def merged_names(left, right) -> list[str]:
    """The names of both sides; a name that both have gets _1 and _2."""
    both = set(left) & set(right)
    return [f"{n}_1" if n in both else n for n in left] + [f"{n}_2" if n in both else n for n in right]


@dataclass(frozen=True)
class RelationKey:
    user: str
    program: str
    relation: str

    def __post_init__(self):
        for part in (self.user, self.program, self.relation):
            if not NAME.match(part):
                raise PlanError(f"bad name {part!r} in a relation key")

    @staticmethod
    def parse(x) -> RelationKey:
        if isinstance(x, RelationKey):
            return x
        if isinstance(x, str):
            return RelationKey(*x.split(":"))
        return RelationKey(x["userName"], x["programName"], x["relationName"])

    @property
    def table(self) -> str:
        """A table name of its own for each key, in lower-case letters, digits and underscores.

        An underscore becomes _0, a capital _ and its small letter, anything else its
        number between _1 and z; the parts stand between two underscores.
        """
        one = lambda c: "_0" if c == "_" else c if "a" <= c <= "z" or "0" <= c <= "9" else f"_{c.lower()}" if "A" <= c <= "Z" else f"_1{ord(c)}z"
        return "__".join("".join(map(one, x)) for x in (self.user, self.program, self.relation))

    @staticmethod
    def of_table(name: str) -> RelationKey:
        """The key whose table this is."""
        parts = []
        for part in re.findall(r"((?:[a-z0-9]|_0|_1\d+z|_[a-z])+)(?:__|$)", name):
            parts.append(re.sub(r"_(?:(0)|1(\d+)z|([a-z]))", lambda m: "_" if m[1] else chr(int(m[2])) if m[2] else m[3].upper(), part))
        return RelationKey(*parts)

    def __str__(self) -> str:
        return f"{self.user}:{self.program}:{self.relation}"
