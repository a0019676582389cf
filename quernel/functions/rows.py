"""Expression trees as Python functions of a row and a state, for scans whose steps depend on one another.

Results follow the types that the same tree has as a Spark column: integers are
checked for overflow, nulls make nulls, and so on.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
import struct
from collections.abc import Callable

from pyspark.sql import types as T

from ..model import PlanError
from .expressions import COMPARE, WIDTH, Compiler

BITS = {T.IntegerType: 32, T.LongType: 64}


def fit(value, kind: T.DataType):
    """A number as a value of a type; what does not fit raises."""
    if value is None:
        return None
    if type(kind) in BITS:
        n = BITS[type(kind)] - 1
        if isinstance(value, float):
            value = 0 if math.isnan(value) else value
            if math.isinf(value) or not -(1 << n) <= int(value) < 1 << n:
                raise OverflowError(f"{value} as {kind.simpleString()}")
            return int(value)
        value = int(value)
        if not -(1 << n) <= value < 1 << n:
            raise OverflowError(f"{value} as {kind.simpleString()}")
        return value
    if isinstance(kind, T.FloatType):
        return struct.unpack("f", struct.pack("f", value))[0] if math.isfinite(value) else float(value)
    if isinstance(kind, T.DoubleType):
        return float(value)
    return value


def modulo(a, b):
    if b == 0:
        raise ZeroDivisionError("modulo")
    return math.fmod(a, b) if isinstance(a, float) or isinstance(b, float) else a - b * quotient(a, b)


def quotient(a, b):
    """Towards zero."""
    if b == 0:
        raise ZeroDivisionError("division")
    q = abs(a) // abs(b)
    return int(q if (a < 0) == (b < 0) else -q)


def divided(a, b):
    a, b = float(a), float(b)
    return (math.nan if not a or math.isnan(a) else math.copysign(math.inf, a)) if b == 0 else a / b


def part(s, begin, end):
    if not 0 <= begin <= end <= len(s):
        raise IndexError("out of range")
    return s[begin:end]


def text(v) -> str:
    return str(v).lower() if isinstance(v, bool) else str(v)


class Rows:
    """Compiles trees against the columns of ``compiler``'s table and the types of its state."""

    TWO = {"PLUS": lambda a, b: a + b, "MINUS": lambda a, b: a - b, "TIMES": lambda a, b: a * b, "DIVIDE": divided, "IDIVIDE": quotient, "MODULO": modulo, "POW": lambda a, b: float(a) ** float(b), "CONCAT": lambda a, b: a + b, "GREATER": max, "LESSER": min}
    ONE = {"NEG": lambda a: -a, "ABS": abs, "CEIL": lambda a: float(math.ceil(a)), "FLOOR": lambda a: float(math.floor(a)), "SQRT": lambda a: math.sqrt(a) if a >= 0 else math.nan, "LOG": lambda a: math.log(a) if a > 0 else None, "SIN": math.sin, "COS": math.cos, "TAN": math.tan, "LEN": len, "UPPER": lambda a: a.upper()}
    TESTS = {"EQ": lambda a, b: a == b, "NEQ": lambda a, b: a != b, "GT": lambda a, b: a > b, "GTEQ": lambda a, b: a >= b, "LT": lambda a, b: a < b, "LTEQ": lambda a, b: a <= b}

    def __init__(self, compiler: Compiler):
        self.compiler = compiler

    def type(self, e: dict) -> T.DataType:
        return self.compiler.type(self.compiler(e))

    def __call__(self, e: dict) -> Callable:
        """A function of (row, state)."""
        e = e.get("rootExpressionOperator", e)
        kind, type_ = e["type"], self.type(e)
        if kind == "CONSTANT":
            v = e["value"]
            t = e["valueType"]
            v = base64.b64decode(v) if t == "BLOB_TYPE" else str(v).lower() == "true" if t == "BOOLEAN_TYPE" else v if t == "STRING_TYPE" else fit(int(v) if isinstance(type_, T.IntegralType) else float(v), type_)
            return lambda row, state: v
        if kind == "VARIABLE":
            i = e["columnIdx"]
            return lambda row, state: row[i]
        if kind == "STATE":
            i = e["columnIdx"]
            return lambda row, state: state[i]
        if kind in ("AND", "OR"):
            a, b, stop = self(e["left"]), self(e["right"]), kind == "OR"

            def both(row, state):
                x, y = a(row, state), b(row, state)
                return stop if x is stop or y is stop else None if x is None or y is None else not stop

            return both
        if kind == "NOT":
            a = self(e["operand"])
            return lambda row, state: None if (x := a(row, state)) is None else not x
        if kind == "CONDITION":
            test, yes, no = (self(x) for x in (e["children"] if "children" in e else (e["firstOperand"], e["secondOperand"], e["thirdOperand"])))
            return lambda row, state: fit(yes(row, state) if test(row, state) else no(row, state), type_)
        if kind in ("GREATER", "LESSER"):  # a null is no candidate
            a, b, pick = self(e["left"]), self(e["right"]), self.TWO[kind]
            return lambda row, state: fit(pick(xs) if (xs := [x for x in (a(row, state), b(row, state)) if x is not None]) else None, type_)
        if kind == "CAST":
            return self.cast(self(e["left"]), self.type(e["left"]), type_)
        if kind == "LIKE":
            a, p = self(e["left"]), self(e["right"])
            seen: dict[str, re.Pattern] = {}

            def like(row, state):
                x, y = a(row, state), p(row, state)
                if x is None or y is None:
                    return None
                if y not in seen:
                    seen.clear()
                    seen[y] = re.compile("(?s)" + "".join(".*" if c == "%" else "." if c == "?" else re.escape(c) for c in y.lower()))
                return bool(seen[y].fullmatch(x.lower()))

            return like
        if kind in ("HASH_MD5", "MD5"):
            a, t = self(e["operand"]), self.type(e["operand"])
            raw = (lambda x: struct.pack("<i" if isinstance(t, T.IntegerType) else "<q", x)) if type(t) in BITS else lambda x: bytes(x) if isinstance(x, (bytes, bytearray)) else str(x).encode()
            return lambda row, state: None if (x := a(row, state)) is None else struct.unpack("<q", hashlib.md5(raw(x)).digest()[:8])[0]
        if kind in ("SUBSTR", "BYTERANGE"):
            es = [self(x) for x in (e["children"] if "children" in e else (e["firstOperand"], e["secondOperand"], e["thirdOperand"]))]
            return lambda row, state: None if None in (v := [x(row, state) for x in es]) else part(*v)
        if kind in COMPARE:
            a, b, f = self(e["left"]), self(e["right"]), self.TESTS[kind]
            return lambda row, state: None if (x := a(row, state)) is None or (y := b(row, state)) is None else f(x, y)
        if kind in self.TWO:
            a, b, f = self(e["left"]), self(e["right"]), self.TWO[kind]
            if kind == "IDIVIDE" and any(isinstance(self.type(e[k]), T.FractionalType) for k in ("left", "right")):
                f = lambda x, y: divided(x, y)
            return lambda row, state: None if (x := a(row, state)) is None or (y := b(row, state)) is None else fit(f(x, y), type_)
        if kind in self.ONE:
            a, f = self(e["operand"]), self.ONE[kind]
            return lambda row, state: None if (x := a(row, state)) is None else fit(f(x), type_)
        raise PlanError(f"{kind} can't stand in a scan with a state")

    def cast(self, a: Callable, old: T.DataType, new: T.DataType) -> Callable:
        if old == new:
            return a
        if isinstance(new, T.StringType) and (isinstance(old, (T.IntegralType, T.BooleanType))):
            return lambda row, state: None if (x := a(row, state)) is None else text(x)
        if old in WIDTH and new in WIDTH:
            return lambda row, state: fit(a(row, state), new)
        if isinstance(new, T.BooleanType) and old in WIDTH:
            return lambda row, state: None if (x := a(row, state)) is None else x != 0
        if isinstance(old, T.BooleanType) and new in WIDTH:
            return lambda row, state: None if (x := a(row, state)) is None else fit(int(x), new)
        if isinstance(old, T.StringType) and new in WIDTH:
            whole = re.compile(r"[+-]?\d+" if isinstance(new, T.IntegralType) else r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?")

            def number(row, state):
                x = a(row, state)
                if x is not None and not whole.fullmatch(x):
                    raise ValueError(f"not a number: {x}")
                return None if x is None else fit(int(x) if isinstance(new, T.IntegralType) else float(x), new)

            return number
        raise PlanError(f"{old.simpleString()} as {new.simpleString()} in a scan with a state")
