"""Expression trees over a row (and a state), compiled to Spark columns."""

from __future__ import annotations

import base64
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import TYPES, PlanError

#: Expressions that give a list for each row.
MULTI = {"SPLIT", "NGRAM", "SEQUENCE", "BITSET"}
COMPARE = {"EQ": "__eq__", "NEQ": "__ne__", "GT": "__gt__", "GTEQ": "__ge__", "LT": "__lt__", "LTEQ": "__le__"}
#: From narrow to wide.
WIDTH = [T.IntegerType(), T.LongType(), T.FloatType(), T.DoubleType()]


def is_multi(e: dict) -> bool:
    return e["type"] in MULTI or bool(e.get("isMultiValued"))


def like(value: Column, pattern: str) -> Column:
    """Case-insensitive match of the whole string; % is any run, ? any character, _ itself."""
    parts = [".*" if c == "%" else "." if c == "?" else re.escape(c) for c in pattern.lower()]
    return F.lower(value).rlike("(?s)^" + "".join(parts) + "$")


def md5_long(value: Column, kind: T.DataType) -> Column:
    """The first eight bytes of the MD5, as a little-endian long; integers hash their little-endian bytes."""
    if isinstance(kind, (T.IntegerType, T.LongType)):
        digits = 8 if isinstance(kind, T.IntegerType) else 16
        h = F.substring(F.lpad(F.hex(value.cast("long")), 16, "0"), 17 - digits, digits)
        value = F.unhex(reverse_bytes(h, digits // 2))
    h = F.upper(F.md5(value.cast("binary")))
    return hex_long(reverse_bytes(F.substring(h, 1, 16), 8))


def hex_long(h: Column) -> Column:
    """The signed long that sixteen hexadecimal digits stand for."""
    high, low = (F.conv(F.substring(h, i, 8), 16, 10).cast("long") for i in (1, 9))
    return F.shiftleft(high, 32).bitwiseOR(low)


def reverse_bytes(h: Column, n: int) -> Column:
    return F.concat(*[F.substring(h, 2 * i + 1, 2) for i in reversed(range(n))])


#: Bytes of a blob that is fetched, at most; a larger one counts as not to be had.
BLOB = 64 << 20


def fetched(uri: str | None, folders: tuple[str, ...] = (), seconds: float = 60, most: int = BLOB) -> bytes | None:
    import os
    import urllib.parse
    import urllib.request

    try:
        parts = urllib.parse.urlsplit(uri or "")
        if parts.scheme in ("http", "https"):
            with urllib.request.urlopen(uri, timeout=seconds) as f:
                found = f.read(most + 1)
            return found if len(found) <= most else None
        path = os.path.realpath(urllib.parse.unquote(parts.path))
        if parts.scheme in ("", "file") and any(path.startswith(os.path.realpath(x) + os.sep) for x in folders):
            with open(path, "rb") as f:
                found = f.read(most + 1)
            return found if len(found) <= most else None
    except (OSError, ValueError):
        pass
    return None


class Compiler:
    """Compiles expressions against the columns of ``df`` and, by position, of a state."""

    def __init__(self, df: DataFrame, state: list[Column] | None = None, functions: dict | None = None):
        self.df, self.state, self.functions = df, state, functions or {}

    def type(self, c: Column) -> T.DataType:
        return self.df.select(c).schema[0].dataType

    def __call__(self, e: dict) -> Column:
        e = e.get("rootExpressionOperator", e)
        try:
            f = getattr(self, "do_" + e["type"].lower(), None)
        except (KeyError, AttributeError):
            raise PlanError(f"not an expression: {e}") from None
        if f:
            return f(e)
        if e["type"] in COMPARE:
            return getattr(self(e["left"]), COMPARE[e["type"]])(self(e["right"]))
        raise PlanError(f"unknown expression {e['type']!r}")

    def numeric(self, *cs: Column) -> None:
        for c in cs:
            if not isinstance(self.type(c), T.NumericType):
                raise PlanError("a number is needed")

    def do_constant(self, e):
        kind, v = e["valueType"], e["value"]
        if kind == "BLOB_TYPE":
            return F.lit(base64.b64decode(v))
        if kind == "BOOLEAN_TYPE":
            return F.lit(str(v).lower() == "true")
        return F.lit(v if kind == "STRING_TYPE" else str(v)).cast(TYPES[kind])

    def do_variable(self, e):
        try:
            return F.col(f"`{self.df.columns[e['columnIdx']]}`")
        except IndexError:
            raise PlanError(f"no column {e['columnIdx']}") from None

    def do_state(self, e):
        if self.state is None:
            raise PlanError("there is no state here")
        return self.state[e["columnIdx"]]

    def do_workerid(self, e):
        return F.spark_partition_id() + 1

    def do_random(self, e):
        return F.rand()

    def arithmetic(self, e, op):
        a, b = self(e["left"]), self(e["right"])
        self.numeric(a, b)
        return getattr(a, op)(b)

    def do_plus(self, e):
        return self.arithmetic(e, "__add__")

    def do_minus(self, e):
        return self.arithmetic(e, "__sub__")

    def do_times(self, e):
        return self.arithmetic(e, "__mul__")

    def do_divide(self, e):
        a, b = self(e["left"]).cast("double"), self(e["right"]).cast("double")
        ieee = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
        return F.when(b == 0, ieee).otherwise(F.try_divide(a, b))

    def do_idivide(self, e):
        a, b = self(e["left"]), self(e["right"])
        kinds = [self.type(a), self.type(b)]
        if any(isinstance(k, (T.FloatType, T.DoubleType)) for k in kinds):
            return (a.cast("double") / b.cast("double")).cast("long")
        both = all(isinstance(k, T.IntegerType) for k in kinds)
        # the decimal quotient of what divides evenly is exact
        whole = (a - a % b).cast("decimal(20,0)") / b.cast("decimal(20,0)")
        return whole.cast("int" if both else "long")

    def do_modulo(self, e):
        return self.arithmetic(e, "__mod__")

    def do_neg(self, e):
        return -self(e["operand"])

    def do_abs(self, e):
        return F.abs(self(e["operand"]))

    def unary(name, double=True):  # noqa: N805
        def f(self, e):
            c = self(e["operand"])
            return getattr(F, name)(c.cast("double") if double else c).cast("double")

        return f

    do_ceil, do_floor = unary("ceil"), unary("floor")
    do_sqrt, do_log, do_sin, do_cos, do_tan = unary("sqrt"), unary("ln"), unary("sin"), unary("cos"), unary("tan")

    def do_pow(self, e):
        return F.pow(self(e["left"]).cast("double"), self(e["right"]).cast("double"))

    def do_greater(self, e):
        return F.greatest(*self.widened(e["left"], e["right"]))

    def do_lesser(self, e):
        return F.least(*self.widened(e["left"], e["right"]))

    def widened(self, *es):
        cs = [self(e) for e in es]
        kinds = [self.type(c) for c in cs]
        if all(k in WIDTH for k in kinds):
            wide = max(kinds, key=WIDTH.index)
            return [c.cast(wide) for c in cs]
        if len(set(map(str, kinds))) > 1:
            raise PlanError(f"different types {kinds}")
        return cs

    def do_like(self, e):
        p = e["right"]
        if p["type"] == "CONSTANT":
            return like(self(e["left"]), p["value"])
        # a pattern of a row: its letters quoted one by one, but % and ?
        quoted = F.regexp_replace(F.lower(self(p)), r"([^\p{L}\p{N}\s%?])", r"\\$1")
        pattern = F.concat(F.lit("(?s)^"), F.replace(F.replace(quoted, F.lit("%"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))
        return F.rlike(F.lower(self(e["left"])), pattern)

    def do_and(self, e):
        return self(e["left"]) & self(e["right"])

    def do_or(self, e):
        return self(e["left"]) | self(e["right"])

    def do_not(self, e):
        return ~self(e["operand"])

    def do_condition(self, e):
        test, yes, no = e["children"] if "children" in e else (e["firstOperand"], e["secondOperand"], e["thirdOperand"])
        yes, no = self.widened(yes, no)
        return F.when(self(test), yes).otherwise(no)

    def do_cast(self, e):
        c, to = self(e["left"]), e["right"]
        kind = TYPES[to["outputType"]] if to["type"] == "TYPE" else self.type(F.col(f"`{self.df.columns[to['columnIdx']]}`"))
        return self.cast(c, self.type(c), kind)

    def cast(self, c: Column, a: T.DataType, b: T.DataType) -> Column:
        """Checked: what does not fit, or is not written as the type is, raises."""
        if isinstance(a, T.BinaryType) and isinstance(b, (T.IntegerType, T.LongType)):
            n = 4 if isinstance(b, T.IntegerType) else 8
            h = F.hex(c)
            value = hex_long(h) if n == 8 else F.conv(F.substring(h, 1, 8), 16, 10).cast("long")
            value = value if n == 8 else F.when(value >= 2**31, value - 2**32).otherwise(value)
            return F.when(F.octet_length(c) == n, value).otherwise(F.raise_error(F.lit(f"a blob of {n} bytes is needed"))).cast(b)
        if isinstance(a, T.StringType) and isinstance(b, T.NumericType):
            strict = c.rlike(r"^[+-]?\d+$" if isinstance(b, T.IntegralType) else r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
            return F.when(strict, c).otherwise(F.raise_error(F.concat(F.lit("not a number: "), c))).cast(b)
        if isinstance(a, T.DoubleType) and isinstance(b, T.FloatType):
            return F.when(F.abs(c) <= 3.4028234663852886e38, c).otherwise(F.raise_error(F.lit("out of the range of a float"))).cast(b)
        return c.cast(b)

    def do_concat(self, e):
        return F.concat(self(e["left"]), self(e["right"]))

    def do_substr(self, e):
        s, begin, end = (self(x) for x in (e["children"] if "children" in e else (e["firstOperand"], e["secondOperand"], e["thirdOperand"])))
        begin, end = begin.cast("int"), end.cast("int")
        good = (begin >= 0) & (begin <= end) & (end <= F.length(s))
        return F.when(good, F.substring(s, begin + 1, end - begin)).otherwise(F.raise_error(F.lit("substring out of range")).cast("string"))

    def do_len(self, e):
        return F.length(self(e["operand"]))

    def do_upper(self, e):
        return F.upper(self(e["operand"]))

    def do_hash_md5(self, e):
        c = self(e["operand"])
        return md5_long(c, self.type(c))

    do_md5 = do_hash_md5

    def do_split(self, e):
        """Parts of a string; empty ones at the end are left out."""
        p = F.split(self(e["left"]), e["right"]["value"])
        last = F.aggregate(F.transform(p, lambda x, i: F.when(x != "", i + 1).otherwise(0)), F.lit(0), lambda m, x: F.greatest(m, x))
        return F.when((F.size(p) == 1), p).otherwise(F.slice(p, 1, last))

    def do_ngram(self, e):
        s, n = self(e["left"]), self(e["right"]).cast("int")
        return F.when(F.length(s) >= n, F.transform(F.sequence(F.lit(0), F.greatest(F.length(s) - n, F.lit(0))), lambda i: F.substring(s, i + 1, n))).otherwise(F.array().cast("array<string>"))

    def do_sequence(self, e):
        n = self(e["operand"]).cast("long")
        return F.when(n > 0, F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<bigint>"))

    def do_bitset(self, e):
        h = F.hex(self(e["operand"]))
        bits = F.sequence(F.lit(0), F.greatest(F.length(h) * 4 - 1, F.lit(0)))
        byte = lambda i: F.conv(F.substring(h, (i / 8).cast("int") * 2 + 1, F.lit(2)), 16, 10).cast("int")
        one = F.transform(bits, lambda i: F.call_function("getbit", byte(i).cast("long"), (i % 8).cast("int")) == 1)
        return F.when(F.length(h) > 0, one).otherwise(F.array().cast("array<boolean>"))

    def do_byterange(self, e):
        b, begin, end = (self(x) for x in (e["children"] if "children" in e else (e["firstOperand"], e["secondOperand"], e["thirdOperand"])))
        begin, end = begin.cast("int"), end.cast("int")
        good = (begin >= 0) & (begin <= end) & (end <= F.octet_length(b))
        return F.when(good, F.substring(b, begin + 1, end - begin)).otherwise(F.raise_error(F.lit("byte range out of bounds")).cast("binary"))

    def do_downloadblob(self, e):
        """The bytes at a URI, null if there are none to be had, or more than quernel.blobBytes (64 MB unless set).

        Files are read only below the folders of the session's quernel.blobFolders.
        A batch's blobs are fetched at the same time, eight at once.
        """
        conf = self.df.sparkSession.conf
        folders = tuple(x for x in (conf.get("quernel.blobFolders", None) or "").split(",") if x)
        most = int(conf.get("quernel.blobBytes", None) or BLOB)

        def blobs(uris):
            from concurrent.futures import ThreadPoolExecutor

            import pandas as pd

            with ThreadPoolExecutor(8) as pool:
                return pd.Series(list(pool.map(lambda u: fetched(u, folders, most=most), uris)), dtype=object)

        return F.pandas_udf(blobs, "binary", F.PandasUDFType.SCALAR)(self(e["operand"]))

    def do_pyudf(self, e):
        f = self.functions.get(e["name"])
        if f is None:
            raise PlanError(f"no function {e['name']!r}")
        return f(*[self(x) for x in e["children"]])


class Typed(Compiler):
    """Compiles expressions whose variables and states are parts of other columns, with the types that they have on a row.

    ``row`` gives the column of a variable's name; ``kinds`` are the state's types.
    """

    def __init__(self, df: DataFrame, row, state: list[Column] | None, kinds: list[T.DataType], functions: dict | None = None):
        super().__init__(df, state, functions)
        self.row, self.known = row, {}
        self.probe = Compiler(df, [F.lit(None).cast(k) for k in kinds], functions)

    def __call__(self, e: dict) -> Column:
        c = super().__call__(e)
        self.known[id(c)] = (c, e.get("rootExpressionOperator", e))  # held, so that no other column gets its id
        return c

    def type(self, c: Column) -> T.DataType:
        return self.probe.type(self.probe(self.known[id(c)][1]) if id(c) in self.known else c)

    def do_variable(self, e):
        super().do_variable(e)
        if self.row is None:
            raise PlanError("there is no row here")
        return self.row(self.df.columns[e["columnIdx"]])
