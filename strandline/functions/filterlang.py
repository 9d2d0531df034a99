"""A record-filter language translated to columns, so that Catalyst can push it down.

Levels from tight to loose: unary ``+ - ! ~``; ``* / %``; ``+ -``; ``&``, ``^``, ``|``; ordering;
equality with ``=~ !~``; and one level for ``&&`` and ``||`` from left to right. Undefined is null:
``!undefined`` holds; ``&&`` is undefined if a side is; ``||`` holds if a defined side does.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"""\s*(?:(?P<num>0x[0-9a-fA-F]+|\d+\.?\d*(?:[eE][-+]?\d+)?|\.\d+)|"(?P<str>(?:[^"\\]|\\.)*)"|\[(?P<tag>\w\w)\]|(?P<name>[A-Za-z_][\w.]*)|(?P<op>&&|\|\||==|!=|=~|!~|>=|<=|[-+*/%&|^~!()<>,]))""")
_LEVELS = (("&&", "||"), ("==", "!=", "=~", "!~"), (">", ">=", "<", "<="), ("|",), ("^",), ("&",), ("+", "-"), ("*", "/", "%"))


#: Named classes of bracket expressions, as Java spells them.
_CLASSES = {n: n.capitalize() for n in ("alpha", "digit", "alnum", "upper", "lower", "punct", "graph", "print", "blank", "cntrl", "space")} | {"xdigit": "XDigit"}


def _java(pattern: str) -> str:
    """An extended regular expression as Java reads it: its named classes are spelt otherwise."""
    return re.sub(r"\[:(\w+):\]", lambda m: rf"\p{{{_CLASSES[m[1]]}}}" if m[1] in _CLASSES else m[0], pattern)


class Value:
    def __init__(self, col: Column, text: bool = False, pattern: str | None = None):
        self.col, self.text, self.pattern = col, text, pattern

    def truth(self) -> Column:
        """Null where undefined; any defined string holds."""
        return F.when(self.col.isNotNull(), F.lit(True) if self.text else self.col.cast("double") != 0)


def _bool(c: Column) -> Value:
    return Value(c.cast("double"))


class _Parser:
    def __init__(self, text: str, symbols: dict[str, tuple[Column, bool]], tag: Callable[[str], tuple[Column, bool]]):
        self.tokens, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"can't read the filter at {text[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at, self.symbols, self.tag = 0, symbols, tag

    def peek(self) -> str | None:
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        return text if kind == "op" else None

    def take(self, want: str) -> None:
        if self.peek() != want:
            raise ValueError(f"{want!r} is missing in the filter")
        self.at += 1

    def level(self, k: int = 0) -> Value:
        if k == len(_LEVELS):
            return self.unary()
        left = self.level(k + 1)
        while (op := self.peek()) in _LEVELS[k]:
            self.at += 1
            left = _binary(op, left, self.level(k + 1))
        return left

    def unary(self) -> Value:
        op = self.peek()
        if op in ("+", "-", "!", "~"):
            self.at += 1
            v = self.unary()
            if op == "!":
                return _bool(F.coalesce(~v.truth(), F.lit(True))) if not v.text else _bool(F.coalesce(F.when(v.col.isNotNull(), False), F.lit(True)))
            return v if op == "+" else Value(-v.col.cast("double")) if op == "-" else Value(F.bitwise_not(v.col.cast("long")))
        if op == "(":
            self.at += 1
            v = self.level()
            self.take(")")
            return v
        if self.at >= len(self.tokens):
            raise ValueError("the filter ends early")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "num":
            return Value(F.lit(float(int(text, 16)) if text.startswith("0x") else float(text)))
        if kind == "str":
            text = re.sub(r"\\(.)", r"\1", text) if "\\\"" in text else text
            return Value(F.lit(text), True, text)
        if kind == "tag":
            return Value(*self.tag(text))
        if kind == "name" and self.peek() == "(":
            return self.call(text)
        if kind == "name" and text in self.symbols:
            return Value(*self.symbols[text])
        raise ValueError(f"the filter has no symbol {text!r}")

    def call(self, name: str) -> Value:
        self.take("(")
        args = [self.level()]
        while self.peek() == ",":
            self.at += 1
            args.append(self.level())
        self.take(")")
        x = args[0].col
        d = x.cast("double")
        # of bytes, not of characters
        codes = lambda: F.transform(F.regexp_extract_all(F.hex(x), F.lit(".."), 0), lambda c: F.conv(c, 16, 10).cast("int"))
        known = {
            "length": lambda: Value(F.octet_length(x).cast("double")),
            "min": lambda: Value(F.array_min(codes()).cast("double")),
            "max": lambda: Value(F.array_max(codes()).cast("double")),
            "avg": lambda: Value(F.aggregate(codes(), F.lit(0.0), lambda a, c: a + c) / F.nullif(F.octet_length(x), F.lit(0))),
            "exists": lambda: _bool(x.isNotNull()),
            "default": lambda: Value(F.coalesce(x, args[1].col), args[1].text),
            "exp": lambda: Value(F.exp(d)),
            "log": lambda: Value(F.nanvl(F.ln(d), F.lit(None).cast("double"))),
            "sqrt": lambda: Value(F.when(d >= 0, F.sqrt(d))),
            "pow": lambda: Value(F.nanvl(F.pow(d, args[1].col.cast("double")), F.lit(None).cast("double"))),
        }
        if name not in known:
            raise ValueError(f"the filter has no function {name!r}")
        return known[name]()


def _binary(op: str, a: Value, b: Value) -> Value:
    x, y = a.col, b.col
    if op in ("&&", "||"):
        p, q = a.truth(), b.truth()
        if op == "&&":
            return _bool(F.when(p.isNotNull() & q.isNotNull(), p & q))
        return _bool(F.when(F.coalesce(p, F.lit(False)) | F.coalesce(q, F.lit(False)), True).when(p.isNotNull() & q.isNotNull(), False))
    if op in ("=~", "!~"):
        hit = x.cast("string").rlike(_java(b.pattern)) if b.pattern is not None else F.rlike(x.cast("string"), y)
        return _bool(hit if op == "=~" else ~hit)
    if op in ("==", "!=", ">", ">=", "<", "<="):
        if a.text != b.text:
            return _bool(F.when(x.isNotNull() & y.isNotNull(), F.lit(op == "!=")))
        if not a.text:
            x, y = x.cast("double"), y.cast("double")
        return _bool({"==": x == y, "!=": x != y, ">": x > y, ">=": x >= y, "<": x < y, "<=": x <= y}[op])
    if op in "&|^":
        x, y = x.cast("long"), y.cast("long")
        return Value({"&": x.bitwiseAND(y), "|": x.bitwiseOR(y), "^": x.bitwiseXOR(y)}[op])
    if op == "%":
        return Value(F.when(y.cast("long") != 0, x.cast("long") % F.nullif(y.cast("long"), F.lit(0))))
    x, y = x.cast("double"), y.cast("double")
    return Value({"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: x / F.nullif(y, F.lit(0.0))}[op]())


def compile_filter(text: str, symbols: dict[str, Column], strings: set[str] = frozenset(), tags: dict[str, Column] | None = None) -> Column:
    """A boolean column, false where the expression is undefined. strings: symbols and tags that are text."""
    from .sam import FLAGS

    known = {k: (c, k in strings) for k, c in symbols.items()}
    if "flag" in symbols:
        known |= {f"flag.{n}": (symbols["flag"].bitwiseAND(bit), False) for n, bit in FLAGS.items()}
    absent = F.lit(None).cast("double")
    parser = _Parser(text, known, lambda t: ((tags or {}).get(t, absent), t in strings))
    out = parser.level()
    if parser.at != len(parser.tokens):
        raise ValueError("the filter goes on after its end")
    return F.coalesce(out.truth(), F.lit(False))
