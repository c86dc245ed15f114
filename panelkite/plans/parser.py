"""From text to tree.  Python's own grammar, with a short list of what is let through; nothing is evaluated."""

from __future__ import annotations

import ast
import re

from panelkite.plans.tree import Call, Field, Literal, Node, PeriodField

_BINARY = {ast.Add: "Add", ast.Sub: "Sub", ast.Mult: "Mul", ast.Div: "Div", ast.Pow: "Power", ast.BitAnd: "And", ast.BitOr: "Or"}
_COMPARE = {ast.Gt: "Gt", ast.GtE: "Ge", ast.Lt: "Lt", ast.LtE: "Le", ast.Eq: "Eq", ast.NotEq: "Ne"}
_NAME = re.compile(r"(\$\$?)([^\W\d]\w*)")


class ExpressionError(ValueError):
    """The text is no expression of the language."""


def parse(text: str) -> Node:
    """The tree of an expression such as "Mean($close, 5) / $close"."""
    marked = _NAME.sub(lambda m: f"{'_period_' if m[1] == '$$' else '_field_'}{m[2]}", text.strip())
    try:
        return _convert(ast.parse(marked, mode="eval").body, text)
    except SyntaxError as error:
        raise ExpressionError(f"{text!r}: {error.msg}") from None


def _convert(part: ast.AST, text: str) -> Node:
    match part:
        case ast.Constant(value=bool() | int() | float() | str() as value):
            return Literal(value)
        case ast.Name(id=name) if name.startswith("_field_"):
            return Field(name.removeprefix("_field_"))
        case ast.Name(id=name) if name.startswith("_period_"):
            return PeriodField(name.removeprefix("_period_"))
        case ast.UnaryOp(op=ast.USub(), operand=ast.Constant(value=int() | float() as value)):
            return Literal(-value)
        case ast.UnaryOp(op=ast.UAdd(), operand=operand):
            return _convert(operand, text)
        case ast.UnaryOp(op=ast.USub(), operand=operand):
            return Call("Mul", (Literal(-1), _convert(operand, text)))
        case ast.UnaryOp(op=ast.Invert(), operand=operand):
            return Call("Not", (_convert(operand, text),))
        case ast.BinOp(left=left, op=op, right=right) if type(op) in _BINARY:
            return Call(_BINARY[type(op)], (_convert(left, text), _convert(right, text)))
        case ast.Compare(left=left, ops=[op], comparators=[right]) if type(op) in _COMPARE:
            return Call(_COMPARE[type(op)], (_convert(left, text), _convert(right, text)))
        case ast.Call(func=ast.Name(id=name), args=args, keywords=[]) if not name.startswith("_"):
            return Call(name, tuple(_convert(a, text) for a in args))
    raise ExpressionError(f"{text!r}: {ast.unparse(part)} isn't part of the language")
