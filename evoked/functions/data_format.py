"""The format of recordings: sample rate, units, channels; and conversions between milliseconds and ticks."""

from __future__ import annotations

import ast
import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_ROUND = {"nearest": (round, F.rint), "down": (math.floor, F.floor), "up": (math.ceil, F.ceil)}


@dataclass(frozen=True)
class DataFormat:
    exact_sample_rate_hz: float
    units: str
    channel_names: tuple[str, ...]

    def __post_init__(self):
        object.__setattr__(self, "channel_names", tuple(self.channel_names))
        if len(set(self.channel_names)) != len(self.channel_names):
            raise ValueError("channel names are not distinct")

    @property
    def approx_sample_period_ms(self) -> int | float:
        period = 1000.0 / self.exact_sample_rate_hz
        return int(period) if period == int(period) else period

    def ms_to_ticks(self, ms, round: str = "nearest"):
        """Ticks of a number, or of a Column; nearest goes to even at halves."""
        if round not in _ROUND:
            raise ValueError(f"unknown rounding {round!r}")
        scalar, column = _ROUND[round]
        if isinstance(ms, Column):
            return column(ms * self.exact_sample_rate_hz / 1000.0).cast("long")
        return int(scalar(ms * self.exact_sample_rate_hz / 1000.0))

    def ticks_to_ms(self, ticks):
        return ticks * 1000.0 / self.exact_sample_rate_hz

    def ms_span_to_ticks(self, start, stop) -> tuple[int, int]:
        """The half-open ticks inside a closed span of milliseconds."""
        return self.ms_to_ticks(start, "up"), self.ms_to_ticks(stop, "down") + 1

    def compute_symbolic_transform(self, expression: str, exclude=()) -> list[list[float]]:
        """The square matrix that adds a linear expression of channels to every channel but those in ``exclude``."""
        row = linear_expression(expression, self.channel_names)
        for name in exclude:
            if name not in self.channel_names:
                raise ValueError(f"no channel {name!r}")
        n = len(self.channel_names)
        return [[float(i == j) + (0.0 if self.channel_names[i] in exclude else row[j]) for j in range(n)] for i in range(n)]


def linear_expression(text: str, names) -> list[float]:
    """Coefficients of ``names`` in a linear expression such as ``-A2/2``. Constants and products of names are errors."""
    names = list(names)

    def walk(node) -> tuple[list[float], float]:
        match node:
            case ast.Expression(body=body):
                return walk(body)
            case ast.Constant(value=int() | float() as v):
                return [0.0] * len(names), float(v)
            case ast.Name(id=name) if name in names:
                return [float(n == name) for n in names], 0.0
            case ast.UnaryOp(op=ast.USub() | ast.UAdd() as op, operand=x):
                sign = -1.0 if isinstance(op, ast.USub) else 1.0
                c, k = walk(x)
                return [sign * v for v in c], sign * k
            case ast.BinOp(left=a, op=ast.Add() | ast.Sub() as op, right=b):
                (c, k), (d, m), sign = walk(a), walk(b), -1.0 if isinstance(op, ast.Sub) else 1.0
                return [x + sign * y for x, y in zip(c, d, strict=True)], k + sign * m
            case ast.BinOp(left=a, op=ast.Mult(), right=b):
                (c, k), (d, m) = walk(a), walk(b)
                if any(c) and any(d):
                    raise ValueError(f"not linear: {text!r}")
                return ([x * m for x in c], k * m) if any(c) else ([x * k for x in d], k * m)
            case ast.BinOp(left=a, op=ast.Div(), right=b):
                (c, k), (d, m) = walk(a), walk(b)
                if any(d) or not m:
                    raise ValueError(f"not linear: {text!r}")
                return [x / m for x in c], k / m
        raise ValueError(f"not a linear expression of channels: {text!r}")

    if "," in text or "=" in text:
        raise ValueError(f"one linear expression is expected: {text!r}")
    try:
        coefs, constant = walk(ast.parse(text.strip(), mode="eval"))
    except SyntaxError as e:
        raise ValueError(f"not an expression: {text!r}") from e
    if constant:
        raise ValueError(f"affine, not linear: {text!r}")
    return coefs
