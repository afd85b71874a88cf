"""The event query language: operators on placeholders, dicts and strings, compiled to one Spark predicate.

Mentioning an attribute as a value anywhere in a query asks that the event has it: presence of all such keys is joined to
the root by AND, however they are nested. Only ``has`` asks by itself. Types are checked when a query is built.

In strings ``and``, ``or``, ``not`` and ``has`` have one precedence and bind from the left: ``a or b and c`` is
``(a or b) and c``. Comparisons bind closer, and ``.`` closest.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from evoked.functions.attrs import EventsError, kind_of

INDEX_FIELDS = {"_RECSPAN_ID": "recspan_id", "_START_TICK": "start_tick", "_STOP_TICK": "stop_tick"}
RECSPAN = "_RECSPAN_INFO"


@dataclass(frozen=True, eq=False)
class Query:
    """A node: op and its arguments; kind is numeric, text, bool or None (untyped)."""

    op: str
    args: tuple
    kind: str | None
    owner: object = field(default=None, repr=False)

    def __bool__(self):
        raise TypeError("a query is no truth value; combine queries with & | ~")

    __hash__ = object.__hash__

    def __eq__(self, other):
        return make("==", self, other)

    def __ne__(self, other):
        return make("!=", self, other)

    def __lt__(self, other):
        return make("<", self, other)

    def __gt__(self, other):
        return make(">", self, other)

    def __le__(self, other):
        return make("<=", self, other)

    def __ge__(self, other):
        return make(">=", self, other)

    def __and__(self, other):
        return make("and", self, other)

    __rand__ = __and__

    def __or__(self, other):
        return make("or", self, other)

    __ror__ = __or__

    def __invert__(self):
        return make("not", self)

    def exists(self) -> Query:
        if self.op != "attr":
            raise EventsError("only attributes can be asked for with has")
        return Query("has", self.args, "bool", self.owner)


def literal(value) -> Query:
    if isinstance(value, Query):
        return value
    try:
        return Query("lit", (value,), kind_of(value))
    except TypeError as e:
        raise EventsError(f"{value!r} is no value of a query") from e


def make(op: str, *args) -> Query:
    nodes = tuple(literal(a) for a in args)
    owners = {id(n.owner): n.owner for n in nodes if n.owner is not None}
    if len(owners) > 1:
        raise ValueError("queries of different timelines")
    if op in ("and", "or", "not"):
        if any(n.kind != "bool" for n in nodes):
            raise EventsError(f"{op} takes truth values")
    else:
        kinds = {n.kind for n in nodes} - {None}
        if len(kinds) > 1:
            raise EventsError(f"{' and '.join(sorted(kinds))} values cannot be compared")
    return Query(op, nodes, "bool", next(iter(owners.values()), None))


class Placeholder:
    """Any event of a timeline: ``p["key"]``, ``p.start_tick``, ``p.recspan_info["key"]``, ``p.overlaps(...)``."""

    def __init__(self, attrs, recspan_attrs=None, owner=None):
        self._spaces, self._owner = {"event": attrs, "recspan": recspan_attrs}, owner
        for name, column in INDEX_FIELDS.items():
            setattr(self, column, Query("field", (column,), "numeric", owner))
            del name

    def _attr(self, space: str, key: str) -> Query:
        own = self._spaces[space]
        return Query("attr", (space, key), own.kind(key) if own else None, self._owner)

    def __getitem__(self, key: str) -> Query:
        return self._attr("event", key)

    def has_key(self, key: str) -> Query:
        return self[key].exists()

    @property
    def recspan_info(self):
        outer = self

        class Info:
            def __getitem__(self, key):
                return outer._attr("recspan", key)

            def has_key(self, key):
                return self[key].exists()

        return Info()

    def overlaps(self, *args) -> Query:
        """Of (recspan_id, start_tick, stop_tick), or of a row that has these."""
        if len(args) == 1:
            if isinstance(args[0], Placeholder):
                raise ValueError("a placeholder overlaps events, no placeholders")
            args = (args[0].recspan_id, args[0].start_tick, args[0].stop_tick)
        return Query("overlap", tuple(int(a) for a in args), "bool", self._owner)

    def matches(self, query: Query) -> Query:
        return query


_TOKEN = re.compile(
    r"""\s*(?:(?P<paren>[()])|(?P<op>==|!=|<=|>=|<|>|\.(?![0-9]))|(?P<number>[+-]?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)(?:e[+-]?[0-9]+)?)|(?P<quote>["'`])|(?P<word>\w+))""",
    re.I,
)
_QUOTED = re.compile(r"""\\(.)|([^\\])""", re.S)
#: Operators by how closely they bind, the closest first; those of one rank bind from the left.
_RANKS = ((".",), ("==", "!=", "<", ">", "<=", ">="), ("and", "or", "not", "has"))
_RANK = {op: rank for rank, ops in enumerate(_RANKS) for op in ops}
_UNARY = ("not", "has")


def lex(text: str) -> list[tuple[str, object]]:
    out, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise EventsError(f"cannot read {text[at:]!r}")
        at = m.end()
        if m["quote"]:
            chars = []
            while True:
                if at >= len(text):
                    raise EventsError("unclosed quote")
                if text[at] == m["quote"]:
                    at += 1
                    break
                c = _QUOTED.match(text, at)
                if not c or (c[1] is not None and c[1] not in "\"'`\\"):
                    raise EventsError("bad escape")
                chars.append(c[1] or c[2])
                at = c.end()
            out.append(("attr" if m["quote"] == "`" else "value", "".join(chars)))
        elif m["number"]:
            try:
                out.append(("value", int(m["number"])))
            except ValueError:
                out.append(("value", float(m["number"])))
        elif m["word"]:
            w = m["word"]
            if w in ("and", "or"):
                out.append(("op", w))
            elif w in _UNARY:
                out.append(("unary", w))
            elif w.lower() in ("true", "false", "none"):
                out.append(("value", {"true": True, "false": False, "none": None}[w.lower()]))
            elif w in INDEX_FIELDS or w == RECSPAN:
                out.append(("magic", w))
            else:
                out.append(("attr", w))
        else:
            out.append(("paren" if m["paren"] else "op", m["paren"] or m["op"]))
    return out


def parse(text: str, p: Placeholder) -> Query:
    tokens, at = lex(text), 0

    def reduce(ops: list, args: list) -> None:
        name, arity = ops.pop()
        if len(args) < arity:
            raise EventsError(f"{name} lacks an argument")
        own = args[len(args) - arity :]
        del args[len(args) - arity :]
        args.append(apply(name, own))

    def apply(name: str, own: list):
        if name == ".":
            left, right = own
            if left != ("magic", RECSPAN) or not (isinstance(right, tuple) and right[0] == "attr"):
                raise EventsError(f"only {RECSPAN} has attributes")
            return p.recspan_info[right[1]]
        if name == "has":
            node = resolve(own[0])
            return node.exists()
        return make(name, *map(resolve, own))

    def resolve(item) -> Query:
        if isinstance(item, Query):
            return item
        kind, value = item
        if kind == "attr":
            return p[value]
        if kind == "value":
            return literal(value)
        if value == RECSPAN:
            raise EventsError(f"{RECSPAN} is no value")
        return getattr(p, INDEX_FIELDS[value])

    def expression(closing: bool):
        nonlocal at
        ops, args, expect = [], [], True
        while at < len(tokens):
            kind, value = tokens[at]
            at += 1
            if kind == "paren" and value == ")":
                if not closing:
                    raise EventsError("unmatched )")
                closing = False
                break
            if expect:
                if kind == "unary":
                    ops.append((value, 1))
                elif kind == "paren":
                    args.append(resolve(expression(True)))
                    expect = False
                elif kind == "op":
                    raise EventsError(f"{value} lacks an argument")
                else:
                    args.append((kind, value))
                    expect = False
            else:
                if kind != "op":
                    raise EventsError(f"an operator is expected before {value!r}")
                while ops and _RANK[ops[-1][0]] <= _RANK[value]:
                    reduce(ops, args)
                ops.append((value, 2))
                expect = True
        if closing or expect:
            raise EventsError("the query breaks off")
        while ops:
            reduce(ops, args)
        return args[0]

    return resolve(expression(False))


def as_query(restrict, p: Placeholder, owner=None) -> Query:
    """The query of a Query, dict, string, bool or None (all events)."""
    if isinstance(restrict, Query):
        if restrict.owner is not None and owner is not None and restrict.owner is not owner:
            raise ValueError("a query of another timeline")
        return restrict
    if restrict is None:
        return literal(True)
    if isinstance(restrict, bool):
        return literal(restrict)
    if isinstance(restrict, str):
        return parse(restrict, p)
    if isinstance(restrict, dict):
        out = literal(True)
        for key, value in restrict.items():
            out = out & ((getattr(p, INDEX_FIELDS[key]) if key in INDEX_FIELDS else p[key]) == value)
        return out
    raise ValueError(f"no query: {restrict!r}")


def compile_query(q: Query, attrs, recspan_attrs=None) -> Column:
    """The predicate of a query whose root is a truth value."""
    if q.kind != "bool":
        raise EventsError("a query must be a truth value")
    spaces, needed = {"event": attrs, "recspan": recspan_attrs}, {}

    def walk(n: Query) -> Column:
        match n.op:
            case "lit":
                return F.lit(n.args[0])
            case "field":
                return F.col(n.args[0])
            case "attr":
                space, key = n.args
                needed[space, key] = spaces[space].present(key)
                return spaces[space].value(key)
            case "has":
                space, key = n.args
                return spaces[space].present(key)
            case "overlap":
                r, a, b = n.args
                hit = (F.col("recspan_id") == r) & (F.col("start_tick") < b) & (F.col("stop_tick") > a)
                return hit if a < b else F.lit(False)
            case "not":
                return ~walk(n.args[0])
        a, b = map(walk, n.args)
        return {
            "==": lambda: a.eqNullSafe(b), "!=": lambda: ~a.eqNullSafe(b), "<": lambda: a < b, ">": lambda: a > b,
            "<=": lambda: a <= b, ">=": lambda: a >= b, "and": lambda: a & b, "or": lambda: a | b,
        }[n.op]()

    out = walk(q)
    for present in needed.values():
        out = out & present
    return out


def needs_recspan(q: Query) -> bool:
    return any(needs_recspan(a) for a in q.args if isinstance(a, Query)) or (q.op in ("attr", "has") and q.args[0] == "recspan")
