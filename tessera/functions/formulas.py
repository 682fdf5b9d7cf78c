"""Formulas over named counts, compiled to columns.

A formula is valid if it names every item, names nothing else, and doesn't mix arithmetic with ``and`` and
``or``. It is rebuilt from its own checked words and signs, so nothing else can reach the SQL parser.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_SIGNS = re.compile(r"\s+|[A-Za-z_]\w*|\d+(?:\.\d+)?|[()+\-*/]")


def checked(formula: str, items: set[str]) -> list[str] | None:
    """The words and signs of a valid formula, else null."""
    found = _SIGNS.findall(formula)
    if "".join(found) != formula:
        return None
    words = [w for w in found if re.match(r"[A-Za-z_]", w)]
    logic = [w for w in words if w.lower() in ("and", "or")]
    names = {w for w in words if w.lower() not in ("and", "or")}
    if names != items or (logic and any(w in "+-*/" for w in found)):
        return None
    return [w for w in found if w.strip()]


def formula_column(formula: str, columns: dict[str, str], logical: bool = True) -> Column | None:
    """The formula over the count columns that ``columns`` names for its items, or null if it isn't valid.

    With ``logical`` the result is a boolean: items are true over zero in a formula of ``and`` and ``or``,
    and count as 1 or 0 in an arithmetic one, which is true if it isn't zero. Otherwise it is the number.
    """
    parts = checked(formula, set(columns))
    if parts is None:
        return None
    logic = any(p.lower() in ("and", "or") for p in parts) or len(columns) == 1

    def written(part: str) -> str:
        if part not in columns:
            return part.upper()
        own = f"coalesce(`{columns[part]}`, 0)"
        return f"({own} > 0)" if logical and logic else f"cast({own} > 0 AS int)" if logical else own

    whole = F.expr(" ".join(map(written, parts)))
    return whole != 0 if logical and not logic else whole
