r"""Conditional compilation: the lines of a source that its own conditions leave.

A text is one ordered fold over lines with a stack of conditions and a table of macros, which no column expression
has; it runs inside tasks on batches of texts. Lines that a condition excludes and all directives are blanked, so
line numbers agree.

Rules: a condition is a name or a number, with ``!`` and ``defined`` before it and brackets around it. A name that nothing
is known of is taken as defined and true where the test asks for it, and as undefined where it asks for the
contrary (``ifndef``); from then on it is known as that. A macro without a value, with parameters or with a value that is no number is
true. Any other expression is worked out if all its names are known and it has integers and the usual signs only; else it
counts as true. Branches after one that was taken are not looked at, nor are conditions in excluded lines.

Defined cases: a null text gives null; an ``else`` without its ``if`` or after another gives null, as nothing sure can be said of
the text; an ``endif`` too many is passed over, and a missing one ends with the text; ``undef`` makes a name undefined.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_DIRECTIVE = re.compile(r"[ \t]*#\s*(\w+)[ \t]*(.*)", re.S)
_SIMPLE = re.compile(r"\s*([\s!(]*)(defined\b)?[\s(]*(\w+)[\s)]*\Z")
_PART = re.compile(r"\s*(defined\s*\(\s*\w+\s*\)|defined\s+\w+|0[xX][0-9a-fA-F]+|\d+|\w+|&&|\|\||[=!<>]=|<<|>>|[-+*/%<>!~&|^()])(?:[uUlL]+\b)?")
_SIGNS = [["||"], ["&&"], ["|"], ["^"], ["&"], ["==", "!="], ["<", ">", "<=", ">="], ["<<", ">>"], ["+", "-"], ["*", "/", "%"]]


class Unknown(Exception):
    """An expression that can't be worked out."""


class Expression:
    """Integer expressions by precedence climbing."""

    def __init__(self, text: str, macros: dict[str, str | None]) -> None:
        self.macros, self.parts, at = macros, [], 0
        text = text.rstrip()
        while at < len(text):
            m = _PART.match(text, at)
            if not m:
                raise Unknown
            self.parts.append(m[1])
            at = m.end()
        self.parts.append("")

    def value(self) -> int:
        out = self.level(0)
        if self.parts != [""]:
            raise Unknown
        return out

    def level(self, k: int) -> int:
        if k == len(_SIGNS):
            return self.unary()
        out = self.level(k + 1)
        while self.parts[0] in _SIGNS[k]:
            sign = self.parts.pop(0)
            out = self.applied(sign, out, self.level(k + 1))
        return out

    def applied(self, sign: str, a: int, b: int) -> int:
        if sign in ("/", "%"):
            if not b:
                raise Unknown
            whole = abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)
            return whole if sign == "/" else a - b * whole
        if sign in ("<<", ">>"):
            if not 0 <= b < 64:
                raise Unknown
            return a << b if sign == "<<" else a >> b
        if sign in ("||", "&&"):
            return int(bool(a or b) if sign == "||" else bool(a and b))
        return int({"==": a == b, "!=": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b, "|": a | b, "^": a ^ b, "&": a & b, "+": a + b, "-": a - b, "*": a * b}[sign])

    def unary(self) -> int:
        part = self.parts.pop(0)
        if part == "(":
            out = self.level(0)
            if self.parts.pop(0) != ")":
                raise Unknown
            return out
        if part in ("!", "-", "+", "~"):
            x = self.unary()
            return {"!": int(not x), "-": -x, "+": x, "~": ~x}[part]
        if part.startswith("defined") and part != "defined":
            name = re.findall(r"\w+", part)[1]
            if name not in self.macros:
                raise Unknown
            return int(self.macros[name] is not None)
        if re.fullmatch(r"0[xX][0-9a-fA-F]+|\d+", part):
            return int(part, 16 if part[:2] in ("0x", "0X") else 10)
        if part not in self.macros:
            raise Unknown
        own = self.macros[part]
        if own is None:
            return 0
        if not own.isdigit():
            raise Unknown
        return int(own)


def _tested(directive: str, expression: str, macros: dict[str, str | None]) -> bool:
    m = _SIMPLE.match(expression)
    if not m:
        try:
            return Expression(expression, macros).value() != 0
        except (Unknown, IndexError, RecursionError):
            return True
    negated = ("!" in m[1]) or directive in ("ifndef", "elifndef")
    name = m[3]
    if name.isdigit():
        found = int(name) != 0
    elif directive in ("if", "elif", "elsif") and not m[2]:
        own = macros.setdefault(name, "1")
        found = own is not None and not (own.isdigit() and int(own) == 0)
    else:
        found = macros.setdefault(name, None if negated else "1") is not None
    return found != negated


def preprocessed_text(text: str) -> tuple[str | None, int]:
    """What conditions leave of a text, and the number of lines with something on them that they exclude."""
    macros: dict[str, str | None] = {}
    stack = [("root", "taken")]  # what opened the branch; whether it is taken, open (none was yet), or over
    out, removed, lines, at = [], 0, text.split("\n"), 0
    while at < len(lines):
        own = [lines[at]]
        m = _DIRECTIVE.match(lines[at])
        while m and own[-1].endswith("\\") and at + len(own) < len(lines):
            own.append(lines[at + len(own)])
        at += len(own)
        kind, state = stack[-1]
        if not m:
            out.append(own[0] if state == "taken" else "")
            removed += state != "taken" and own[0].strip() != ""
            continue
        out += [""] * len(own)
        directive, expression = m[1], "\n".join([m[2], *own[1:]]).replace("\\\n", " ")
        if directive == "define" and state == "taken":
            d = re.match(r"\s*(\w+)(\()?\s*(\S*)", expression)
            if d:
                macros[d[1]] = "1" if d[2] or not d[3] else d[3]
        elif directive == "undef" and state == "taken":
            macros[expression.strip()] = None
        elif directive in ("if", "ifdef", "ifndef"):
            stack.append(("if", ("taken" if _tested(directive, expression, macros) else "open") if state == "taken" else "over"))
        elif directive in ("elif", "elsif", "elifdef", "elifndef", "else"):
            if kind != "if":
                return None, 0
            taken = state == "open" and (directive == "else" or _tested(directive.replace("elifdef", "ifdef").replace("elifndef", "ifndef"), expression, macros))
            stack[-1] = ("else" if directive == "else" else "if", "taken" if taken else "open" if state == "open" else "over")
        elif directive == "endif" and len(stack) > 1:
            stack.pop()
    return "\n".join(out), removed


def preprocessed(code: Column) -> Column:
    """A struct of prepro (the view, for a text without its comments) and removed (excluded lines that hold something)."""

    @F.pandas_udf("prepro string, removed long")
    def fold(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, 0) if t is None else preprocessed_text(t) for t in texts], columns=["prepro", "removed"])

    return fold(code)
