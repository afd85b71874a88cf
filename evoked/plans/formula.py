"""Right-hand-side model formulas compiled to one array column of Spark expressions.

``+ - : * ** ( ) 0 1``, names, ``C(name)``, ``I(arithmetic)`` and ``_RECSPAN_INFO.name``. Text and bool factors are
categorical, with sorted levels, one grouped query for all of them. A categorical factor loses its first level wherever
the term without it is in the model. Columns go: intercept, categorical terms, terms with numbers.
"""

from __future__ import annotations

import ast
import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Term = frozenset


@dataclass(frozen=True)
class Factor:
    name: str
    value: Column
    categorical: bool


@dataclass(frozen=True)
class Design:
    """names of the columns; array of their values, null where a predictor is null."""

    names: tuple[str, ...]
    array: Column
    terms: tuple[tuple[str, tuple[int, ...]], ...]


def _terms(text: str) -> tuple[list[Term], bool]:
    text = text.strip()
    if "~" in text:
        left, _, text = text.partition("~")
        if left.strip():
            raise ValueError("a formula has no left-hand side here")
    # Names with a dot are calls for the parser's sake; ':' binds like a product of terms, as '@' does in Python.
    tree = ast.parse(text.replace("_RECSPAN_INFO.", "_RECSPAN_INFO__").replace(":", "@"), mode="eval").body

    def walk(n) -> list[Term] | int:
        match n:
            case ast.Constant(value=0 | 1 as v):
                return int(v)
            case ast.Name() | ast.Call():
                return [Term([ast.unparse(n).replace("_RECSPAN_INFO__", "_RECSPAN_INFO.")])]
            case ast.BinOp(left=a, op=ast.MatMult(), right=b):
                return [x | y for x, y in itertools.product(walk(a), walk(b))]
            case ast.BinOp(left=a, op=ast.Mult(), right=b):
                x, y = walk(a), walk(b)
                return [*x, *y, *(s | t for s, t in itertools.product(x, y))]
            case ast.BinOp(left=a, op=ast.Pow(), right=ast.Constant(value=int(k))):
                x = walk(a)
                out = list(x)
                for _ in range(k - 1):
                    out += [s | t for s, t in itertools.product(out, x)]
                return out
        raise ValueError(f"cannot read {ast.unparse(n)!r} in a formula")

    terms, intercept = [], True

    def add(n, sign: int) -> None:
        nonlocal intercept
        match n:
            case ast.BinOp(left=a, op=ast.Add() | ast.Sub() as op, right=b):
                add(a, sign)
                add(b, sign if isinstance(op, ast.Add) else -sign)
                return
            case ast.UnaryOp(op=ast.USub(), operand=a):
                return add(a, -sign)
        got = walk(n)
        if isinstance(got, int):
            intercept = (got == 1) == (sign > 0)
        elif sign > 0:
            terms.extend(t for t in got if t not in terms)
        else:
            terms[:] = [t for t in terms if t not in got]

    add(tree, 1)
    return list(dict.fromkeys(terms)), intercept


def _arithmetic(n, lookup) -> Column:
    match n:
        case ast.Constant(value=int() | float() as v):
            return F.lit(float(v))
        case ast.Name(id=name):
            return lookup(name)[0].cast("double")
        case ast.UnaryOp(op=ast.USub(), operand=x):
            return -_arithmetic(x, lookup)
        case ast.BinOp(left=a, op=op, right=b):
            x, y = _arithmetic(a, lookup), _arithmetic(b, lookup)
            match op:
                case ast.Add():
                    return x + y
                case ast.Sub():
                    return x - y
                case ast.Mult():
                    return x * y
                case ast.Div():
                    return x / y
                case ast.Pow():
                    return F.pow(x, y)
    raise ValueError(f"cannot compute {ast.unparse(n)!r} in a formula")


def compile_formula(text: str, events: DataFrame, attrs, recspan_attrs=None, registered: dict[str, Column] | None = None) -> Design:
    """``registered`` names further columns. A key that no event has is an error."""
    terms, intercept = _terms(text)
    registered = registered or {}

    def lookup(name: str) -> tuple[Column, str | None]:
        space, key = (recspan_attrs, name.partition(".")[2].removeprefix("_RECSPAN_INFO__")) if name.startswith("_RECSPAN_INFO") else (attrs, name)
        if name.startswith("_RECSPAN_INFO__"):
            key = name.removeprefix("_RECSPAN_INFO__")
        if space is not None and key in space.types:
            return space.value(key), space.kind(key)
        if name in registered:
            return registered[name], "numeric"
        raise KeyError(name)

    factors: dict[str, Factor] = {}
    for name in dict.fromkeys(f for t in terms for f in sorted(t)):
        call = ast.parse(name.replace("_RECSPAN_INFO.", "_RECSPAN_INFO__"), mode="eval").body
        if isinstance(call, ast.Call):
            if not isinstance(call.func, ast.Name) or call.func.id not in ("I", "C") or len(call.args) != 1:
                raise ValueError(f"unknown function in {name!r}")
            if call.func.id == "I":
                factors[name] = Factor(name, _arithmetic(call.args[0], lookup), False)
            else:
                factors[name] = Factor(name, lookup(ast.unparse(call.args[0]).replace("_RECSPAN_INFO__", "_RECSPAN_INFO."))[0], True)
        else:
            value, kind = lookup(name)
            factors[name] = Factor(name, value if kind in ("text", "bool") else value.cast("double"), kind in ("text", "bool"))
    levels: dict[str, list] = {}
    cats = [f for f in factors.values() if f.categorical]
    if cats:
        row = events.agg(*(F.sort_array(F.collect_set(f.value)).alias(f"c{i}") for i, f in enumerate(cats))).first()
        levels = {f.name: list(row[i]) for i, f in enumerate(cats)}
    present = {Term(), *terms} if intercept else set(terms)
    names, values, owners = [], [], []
    # Terms with the same numeric factors stand together, those without any first, the others as they appear.
    numerics = lambda t: frozenset(f for f in t if not factors[f].categorical)
    place = {n: i for i, n in enumerate(dict.fromkeys([frozenset(), *map(numerics, terms)]))}
    order = sorted(terms, key=lambda t: (place[numerics(t)], len(t)))
    if intercept:
        names.append("Intercept")
        values.append(F.lit(1.0))
        owners.append("Intercept")
    full_used = intercept
    for t in order:
        parts = []
        for f in sorted(t, key=list(factors).index):
            if not factors[f].categorical:
                parts.append([(f, factors[f].value)])
                continue
            numeric = Term(x for x in t if not factors[x].categorical)
            reduced = (t - {f}) in present or (not numeric and len(t) == 1 and full_used)
            own = levels[f][1:] if reduced else levels[f]
            full_used = full_used or not numeric
            parts.append([(f"{f}[{'T.' if reduced else ''}{v}]", (factors[f].value == F.lit(v)).cast("double")) for v in own])
        for combo in itertools.product(*parts):
            names.append(":".join(n for n, _ in combo))
            value = combo[0][1]
            for _, v in combo[1:]:
                value = value * v
            values.append(value)
            owners.append(":".join(sorted(t, key=list(factors).index)))
    array = F.array(*values)
    for f in factors.values():
        missing = f.value.isNull() if f.categorical else f.value.isNull() | F.isnan(f.value)
        array = F.when(~missing, array)
    by_term = tuple((o, tuple(i for i, x in enumerate(owners) if x == o)) for o in dict.fromkeys(owners))
    return Design(tuple(names), array, by_term)
