"""Declared storage formats: level expressions over (i, j), compression of levels, indirect functions and layout."""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


class EncodingError(ValueError):
    """A format that can't be used; the message names the level."""


def _tree(text: str) -> ast.expr:
    """A level expression as Python syntax: + - * floordiv mod ceildiv, `minus x`, parentheses, whole numbers, i, j and indirect(...)."""
    s = re.sub(r"\bfloordiv\b", "//", text)
    s = re.sub(r"\bmod\b", "%", s)
    s = re.sub(r"\bceildiv\b", "@", s)
    s = re.sub(r"\bminus\b", "-", s)
    try:
        return ast.parse(s, mode="eval").body
    except SyntaxError as e:
        raise EncodingError(f"level {text!r} can't be read") from e


@dataclass(frozen=True)
class Level:
    """One level: a * i + b * j + c, whole (kind flat), its quotient or its rest by `by`; or an indirect level made from data."""

    text: str
    a: int = 0
    b: int = 0
    c: int = 0
    kind: str = "flat"
    by: int = 1

    @classmethod
    def read(cls, text: str) -> Level:
        t = _tree(text)
        if isinstance(t, ast.Call):
            if getattr(t.func, "id", "") != "indirect":
                raise EncodingError(f"level {text!r}: unknown function")
            return replace(cls._linear(t.args[0], text), text=text, kind="indirect")
        if isinstance(t, ast.BinOp) and isinstance(t.op, (ast.FloorDiv, ast.Mod)):
            by = _number(t.right, text)
            if by <= 0:
                raise EncodingError(f"level {text!r}: divisor must be positive")
            return replace(cls._linear(t.left, text), text=text, kind="div" if isinstance(t.op, ast.FloorDiv) else "mod", by=by)
        return replace(cls._linear(t, text), text=text)

    @classmethod
    def _linear(cls, t: ast.expr, text: str) -> Level:
        if isinstance(t, ast.Name) and t.id in "ij" and len(t.id) == 1:
            return cls(text, int(t.id == "i"), int(t.id == "j"))
        if isinstance(t, ast.Constant) and isinstance(t.value, int):
            return cls(text, c=t.value)
        if isinstance(t, ast.UnaryOp) and isinstance(t.op, ast.USub):
            x = cls._linear(t.operand, text)
            return cls(text, -x.a, -x.b, -x.c)
        if isinstance(t, ast.BinOp) and isinstance(t.op, (ast.Add, ast.Sub)):
            x, y, s = cls._linear(t.left, text), cls._linear(t.right, text), 1 if isinstance(t.op, ast.Add) else -1
            return cls(text, x.a + s * y.a, x.b + s * y.b, x.c + s * y.c)
        if isinstance(t, ast.BinOp) and isinstance(t.op, ast.Mult):
            x, y = cls._linear(t.left, text), cls._linear(t.right, text)
            if x.a or x.b:
                x, y = y, x
            if x.a or x.b:
                raise EncodingError(f"level {text!r} isn't linear")
            return cls(text, x.c * y.a, x.c * y.b, x.c * y.c)
        raise EncodingError(f"level {text!r} has a form that isn't supported (ceildiv, symbols and nested quotients are read but not usable)")

    def flat(self, i, j):
        return self.a * i + self.b * j + self.c

    def column(self, i: Column, j: Column) -> Column:
        x = F.lit(self.c)
        for k, v in ((self.a, i), (self.b, j)):
            if k:
                x = x + (v if k == 1 else -v if k == -1 else v * k)
        x = x.cast("long")
        if self.kind == "div":
            return F.floor(x / self.by).cast("long")
        return F.pmod(x, F.lit(self.by).cast("long")) if self.kind == "mod" else x

    def range(self, shape: tuple[int, int]) -> tuple[int, int]:
        """(least value, size) over the matrix: size is the span of the expression over the corners and 0."""
        v = [self.flat(i, j) for i in (0, shape[0]) for j in (0, shape[1])] + [0]
        lo, hi = min(v), max(v)
        if self.kind == "mod":
            return 0, self.by
        if self.kind == "div":
            return lo // self.by, -(-hi // self.by) - lo // self.by
        return (lo + 1 if lo < 0 else 0), hi - lo


def _number(t: ast.expr, text: str) -> int:
    if isinstance(t, ast.Constant) and isinstance(t.value, int):
        return t.value
    raise EncodingError(f"level {text!r}: the divisor must be a whole number")


@dataclass(frozen=True)
class Encoding:
    """A format. trim: first and last level with stored coordinates; fuse: levels stored once per distinct prefix. Levels before trim are dense (a pointer
    array stands on the last of them, or on the root), levels after it are dense blocks of values. Validated when made.

    indirect holds options of indirect levels: {"sum": level, "enumerate": True, "reorder": True, "schedule": buckets}; sum names the level of the matrix whose entries are
    counted (0: rows, 1: columns). layout: {"pack": ..} draws the coordinates of the last stored level and the values into one array of pairs, {"partition": (level,)}
    lays the entries out by a level. Formats with other options aren't equal. bit_width is kept as a note.
    """

    name: str
    levels: tuple[str, ...]
    trim: tuple[int, int]
    fuse: tuple[int, ...] = ()
    indirect: dict = field(default_factory=dict, hash=False)
    layout: dict = field(default_factory=dict, hash=False)
    bit_width: int = 8

    def __post_init__(self):
        n = len(self.levels)
        a, b = self.trim
        if not 0 <= a <= b < n:
            raise EncodingError(f"{self.name}: trim({a}, {b}) is outside levels 0 to {n - 1}")
        if any(not 0 <= k < n for k in self.fuse):
            raise EncodingError(f"{self.name}: fuse{self.fuse} names a level outside 0 to {n - 1}")
        self._inverse()

    @property
    def parsed(self) -> list[Level]:
        return [Level.read(x) for x in self.levels]

    @property
    def blocks(self) -> bool:
        return self.trim[1] < len(self.levels) - 1

    def forward(self, i: Column, j: Column) -> list[Column]:
        """Level columns l0.. of a coordinate; indirect levels are null here and come from the data."""
        return [(F.lit(None).cast("long") if x.kind == "indirect" else x.column(i, j)).alias(f"l{k}") for k, x in enumerate(self.parsed)]

    def _flat(self) -> list[tuple[Level, list[int]]]:
        """Whole levels, and quotient and rest drawn together, each with the levels it comes from."""
        out, parts = [], {}
        for k, x in enumerate(self.parsed):
            if x.kind == "flat":
                out.append((x, [k]))
            elif x.kind in ("div", "mod"):
                parts.setdefault((x.a, x.b, x.c, x.by), {})[x.kind] = k
        for (a, b, c, by), p in parts.items():
            if set(p) != {"div", "mod"}:
                k = next(iter(p.values()))
                raise EncodingError(f"{self.name}: level {k} ({self.levels[k]}) has no matching {'rest' if 'div' in p else 'quotient'}")
            out.append((Level(self.levels[p["div"]], a, b, c, "flat", by), [p["div"], p["mod"]]))
        return out

    def _inverse(self):
        flat = self._flat()
        for n, (x, px) in enumerate(flat):
            for y, py in flat[n + 1 :]:
                det = x.a * y.b - x.b * y.a
                if abs(det) == 1:
                    return (x, px), (y, py), det
        raise EncodingError(f"{self.name}: levels {self.levels} don't determine (i, j)")

    def backward(self, level=lambda k: F.col(f"l{k}")) -> tuple[Column, Column]:
        """(i, j) from level columns: tile pairs merge, then the 2 x 2 whole-number inverse."""
        (x, px), (y, py), det = self._inverse()
        whole = lambda f, p: (level(p[0]) if len(p) == 1 else level(p[0]) * f.by + level(p[1])) - f.c
        u, v = whole(x, px), whole(y, py)
        return ((u * y.b - v * x.b) * det).cast("long"), ((v * x.a - u * y.a) * det).cast("long")

    def ranges(self, shape: tuple[int, int]) -> list[tuple[int, int]]:
        """(least value, size) of each level. An indirect level has as many places as buckets; the number of slots isn't known without the data (size -1)."""
        return [(0, -1 if self.indirect.get("enumerate") else self.indirect.get("schedule", -1)) if x.kind == "indirect" else x.range(shape) for x in self.parsed]


def _tiles(r: int, c: int) -> tuple[str, ...]:
    return (f"i floordiv {r}", f"j floordiv {c}", f"i mod {r}", f"j mod {c}")


COO = Encoding("COO", ("i", "j"), (0, 1))
CSR = Encoding("CSR", ("i", "j"), (1, 1), (0,))
CSC = Encoding("CSC", ("j", "i"), (1, 1), (0,))
DCSR = Encoding("DCSR", ("i", "j"), (0, 1), (0,))
DCSC = Encoding("DCSC", ("j", "i"), (0, 1), (0,))
DIA1 = Encoding("DIA1", ("j - i", "j"), (0, 0), (0,))
DIA2 = Encoding("DIA2", ("i - j", "i"), (0, 0), (0,))
DIA3 = Encoding("DIA3", ("i - j", "j"), (0, 0), (0,))
DIA4 = Encoding("DIA4", ("j - i", "i"), (0, 0), (0,))
DIA = Encoding("DIA", ("j - i", "i"), (0, 0))
HISPARSE = Encoding("hiSparse", ("i", "j"), (1, 1), (0,), layout={"pack": (1, 2)})


def bcsr(r: int, c: int) -> Encoding:
    return Encoding("BCSR", _tiles(r, c), (1, 1), (0, 1))


def bcsc(r: int, c: int) -> Encoding:
    t = _tiles(r, c)
    return Encoding("BCSC", (t[1], t[0], t[2], t[3]), (1, 1), (0, 1))


def bdcsr(r: int, c: int) -> Encoding:
    return Encoding("BDCSR", _tiles(r, c), (0, 1), (0, 1))


def bcoo(r: int, c: int) -> Encoding:
    return Encoding("BCOO", _tiles(r, c), (0, 1))


def csb(r: int, c: int) -> Encoding:
    return Encoding("CSB", _tiles(r, c), (2, 3), (0, 1))


def ne_csb(r: int, c: int) -> Encoding:
    return Encoding("NE_CSB", _tiles(r, c), (1, 3), (1,))


def csbcsr(r: int, c: int) -> Encoding:
    return Encoding("CSBCSR", _tiles(r, c), (3, 3), (0, 1, 2))


def csbdcsr(r: int, c: int) -> Encoding:
    return Encoding("CSBDCSR", _tiles(r, c), (2, 3), (0, 1, 2))


def bdia(f: int) -> Encoding:
    return Encoding("BDIA", (f"i floordiv {f}", "j - i", f"i mod {f}"), (1, 1), (0, 1))


def c2sr(channels: int) -> Encoding:
    return Encoding("C2SR", (f"i mod {channels}", f"i floordiv {channels}", "j"), (2, 2), (0, 1))


def ell() -> Encoding:
    return Encoding("ELL", ("indirect(j)", "i", "j"), (0, 0), (0,), {"sum": 0, "enumerate": True})


def cisr(buckets: int) -> Encoding:
    return Encoding("CISR", ("indirect(i)", "i", "j"), (1, 2), (0, 1), {"sum": 0, "schedule": buckets}, {"partition": (0,)})


def cisr_plus(buckets: int) -> Encoding:
    return Encoding("CISR_plus", ("indirect(i)", "i", "j"), (0, 2), (0, 1), {"sum": 0, "reorder": True, "schedule": buckets})
