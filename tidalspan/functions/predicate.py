"""Filter text to Column: a whitelist of Python expression syntax, never evaluated as code."""

from __future__ import annotations

import ast
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

_BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Mod: operator.mod, ast.Pow: lambda a, b: F.pow(a, b), ast.BitAnd: operator.and_, ast.BitOr: operator.or_}
_COMPARE = {ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge}
_FUNCTIONS = {"abs": F.abs, "sqrt": F.sqrt, "exp": F.exp, "log": F.log, "sin": F.sin, "cos": F.cos, "min": F.least, "max": F.greatest}


class PredicateSyntaxError(ValueError):
    """The text uses something outside the whitelist."""


def compile_predicate(text: str, columns: list[str] | None = None) -> Column:
    """The Column for text, which may use columns, numbers, strings, arithmetic, comparisons
    (chained ones too), and/or/not and a few functions. columns: the names that may occur."""
    try:
        tree = ast.parse(text.strip(), mode="eval")
    except SyntaxError as e:
        raise PredicateSyntaxError(f"cannot parse {text!r}") from e

    def walk(node: ast.AST) -> Column:
        match node:
            case ast.Expression(body=body):
                return walk(body)
            case ast.Constant(value=bool() | int() | float() | str() as value):
                return F.lit(value)
            case ast.Name(id=name):
                if columns is not None and name not in columns:
                    raise PredicateSyntaxError(f"no column {name!r}")
                return F.col(f"`{name}`")
            case ast.UnaryOp(op=ast.Not(), operand=x):
                return ~walk(x)
            case ast.UnaryOp(op=ast.USub(), operand=x):
                return -walk(x)
            case ast.UnaryOp(op=ast.UAdd(), operand=x):
                return walk(x)
            case ast.BinOp(left=a, op=op, right=b) if type(op) in _BINARY:
                return _BINARY[type(op)](walk(a), walk(b))
            case ast.BoolOp(op=op, values=parts):
                out = walk(parts[0])
                for part in parts[1:]:
                    out = out & walk(part) if isinstance(op, ast.And) else out | walk(part)
                return out
            case ast.Compare(left=a, ops=ops, comparators=rest):
                out, left = None, walk(a)
                for op, part in zip(ops, rest, strict=True):
                    right = walk(part)
                    if type(op) not in _COMPARE:
                        break
                    one = _COMPARE[type(op)](left, right)
                    out, left = one if out is None else out & one, right
                else:
                    return out
            case ast.Call(func=ast.Name(id=name), args=args, keywords=[]) if name in _FUNCTIONS:
                return _FUNCTIONS[name](*(walk(a) for a in args))
        raise PredicateSyntaxError(f"{ast.unparse(node)!r} is not allowed")

    return walk(tree)
