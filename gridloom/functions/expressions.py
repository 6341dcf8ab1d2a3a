"""Column builders for pixel arithmetic: guarded division, null-safe logic, band expressions."""

from __future__ import annotations

import ast
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """``a / b``; no value where ``b`` is 0."""
    return F.when(b == 0, None).otherwise(a / b)


def known(x: Column) -> Column:
    """No value for NaN and infinities."""
    x = x.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def nearest(x: Column | str, digits: int = 6) -> Column:
    """``x`` rounded half away from zero as scaled doubles, which is how other engines round doubles."""
    x = F.col(x) if isinstance(x, str) else x
    p = 10.0**digits
    return F.signum(x) * F.floor(F.abs(x) * p + 0.5) / p


def clean(x: Column, digits: int = 6) -> Column:
    """Rounded for comparison, NaN as null, no negative zero."""
    return nearest(F.when(F.isnan(x), None).otherwise(x), digits) + F.lit(0.0)


_FUNCTIONS = {"sin": F.sin, "cos": F.cos, "tan": F.tan, "exp": F.exp, "ln": F.log, "log10": F.log10, "sqrt": F.sqrt, "abs": F.abs, "asin": F.asin, "acos": F.acos, "atan": F.atan, "pow": F.pow, "atan2": F.atan2, "pi": lambda: F.lit(3.141592653589793)}


def _split(text: str, mark: str) -> list[str]:
    """Parts of ``text`` between marks that stand outside brackets."""
    parts, depth = [""], 0
    for ch in text:
        depth += (ch == "(") - (ch == ")")
        if ch == mark and depth == 0:
            parts.append("")
        else:
            parts[-1] += ch
    return parts


def _ternary(text: str) -> str:
    """``c ? a : b`` as Python's conditional expression, bracket by bracket."""
    out, k = "", 0
    while k < len(text):
        if text[k] != "(":
            out, k = out + text[k], k + 1
            continue
        end, depth = k + 1, 1
        while depth:
            depth += (text[end] == "(") - (text[end] == ")")
            end += 1
        out, k = out + "(" + ",".join(_ternary(p) for p in _split(text[k + 1 : end - 1], ",")) + ")", end
    head, *rest = _split(out, "?")
    if not rest:
        return out
    tail, open_ = "?".join(rest), 0
    depth = 0
    for k, ch in enumerate(tail):
        depth += (ch == "(") - (ch == ")")
        if depth == 0 and ch == "?":
            open_ += 1
        elif depth == 0 and ch == ":":
            if not open_:
                return f"(({_ternary(tail[:k])}) if ({head}) else ({_ternary(tail[k + 1 :])}))"
            open_ -= 1
    raise ValueError("'?' without ':'")


def _tree(expression: str) -> ast.expr:
    text = _ternary(expression).replace("&&", " and ").replace("||", " or ")
    return ast.parse(text.strip(), mode="eval").body


def referenced_bands(expression: str) -> list[str]:
    """Sorted band names ``b1..bN`` that an expression uses; only those need to be read."""
    names = {n.id for n in ast.walk(_tree(expression)) if isinstance(n, ast.Name) and re.fullmatch(r"b\d+", n.id)}
    return sorted(names, key=lambda b: int(b[1:]))


def band_math(expression: str) -> Column:
    """Column of a band expression: ``+ - * /``, comparisons, ``&& || ?:`` and the
    usual functions over ``b1..bN``.  Comparisons and logic give 1.0 or 0.0.
    A missing operand, or division by 0, leaves no value, in logic too."""
    number = lambda c: F.when(c, 1.0).otherwise(F.when(~c, 0.0))

    def walk(n) -> Column:
        if isinstance(n, ast.Constant):
            return F.lit(float(n.value))
        if isinstance(n, ast.Name):
            if not re.fullmatch(r"b\d+", n.id):
                raise ValueError(f"unknown name {n.id}")
            return known(F.col(n.id))
        if isinstance(n, ast.UnaryOp):
            return -walk(n.operand) if isinstance(n.op, ast.USub) else walk(n.operand)
        if isinstance(n, ast.BinOp):
            a, b = walk(n.left), walk(n.right)
            ops = {ast.Add: lambda: a + b, ast.Sub: lambda: a - b, ast.Mult: lambda: a * b, ast.Div: lambda: ratio(a, b)}
            return ops[type(n.op)]()
        if isinstance(n, ast.Compare) and len(n.ops) == 1:
            a, b = walk(n.left), walk(n.comparators[0])
            ops = {ast.Lt: a < b, ast.Gt: a > b, ast.LtE: a <= b, ast.GtE: a >= b, ast.Eq: a == b, ast.NotEq: a != b}
            return number(ops[type(n.ops[0])])
        if isinstance(n, ast.BoolOp):
            parts = [walk(v) for v in n.values]
            out = parts[0] != 0
            for p in parts[1:]:
                # either side missing: no value
                out = F.when(out.isNull() | p.isNull(), None).otherwise((out & (p != 0)) if isinstance(n.op, ast.And) else (out | (p != 0)))
            return number(out)
        if isinstance(n, ast.IfExp):
            c = walk(n.test)
            return F.when(c.isNull(), None).when(c != 0, walk(n.body)).otherwise(walk(n.orelse))
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Name):
            args = [walk(a) for a in n.args]
            if n.func.id in ("min", "max"):
                pick = F.least if n.func.id == "min" else F.greatest
                return F.when(args[0].isNull() | args[1].isNull(), None).otherwise(pick(*args))
            return known(_FUNCTIONS[n.func.id](*args))
        raise ValueError(f"not a band expression: {ast.dump(n)[:60]}")

    return walk(_tree(expression))
