"""The event store: events (event_id, recspan_id, start_tick, stop_tick, attributes) and recordings with their metadata.

Timelines are immutable; what changes events returns a new timeline and works on all events that a query matches.
"""

from __future__ import annotations

import numbers
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evoked.functions.attrs import ATTR, ColumnAttrs, EventsError, MapAttrs, Registry, agree, decode, encode, kind_of, kind_of_type
from evoked.plans.query import Placeholder, Query, as_query, compile_query, needs_recspan

EVENTS = f"event_id bigint, recspan_id bigint, start_tick bigint, stop_tick bigint, attrs map<string,{ATTR}>"
RECSPANS = f"recspan_id bigint, ticks bigint, recspan_attrs map<string,{ATTR}>"


EVENT_KEYS = ("event_id", "recspan_id", "start_tick", "stop_tick")
RECSPAN_KEYS = ("recspan_id", "ticks")


def literal_type(value) -> str:
    kind = kind_of(value)
    if kind == "numeric":
        return "bigint" if isinstance(value, numbers.Integral) else "double"
    return {None: "void", "text": "string", "bool": "boolean"}[kind]


def check_events(df: DataFrame) -> DataFrame:
    """``df``, failing where an event is empty, begins before its recording or has none."""
    bad = (F.col("start_tick") >= F.col("stop_tick")) | (F.col("start_tick") < 0)
    return df.withColumn("start_tick", F.when(bad, F.raise_error(F.lit("events need 0 <= start_tick < stop_tick"))).otherwise(F.col("start_tick")))


def numbered(df: DataFrame, name: str, *order) -> DataFrame:
    """``df`` with the place of each row, from 0, by recording and ``order``. Rows are ranked inside their recordings; what
    comes before a recording is summed up over counts, in blocks of recordings, so that no task gets all of them."""
    inside = F.row_number().over(W.partitionBy("recspan_id").orderBy(*order)) - 1
    sizes = df.groupBy("recspan_id").agg(F.count("*").alias("_n")).withColumn("_block", F.expr("recspan_id div 10000"))
    upto = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    blocks = sizes.groupBy("_block").agg(F.sum("_n").alias("_sum")).select("_block", F.coalesce(F.sum("_sum").over(upto(W.orderBy("_block"))), F.lit(0)).alias("_base"))
    own = F.coalesce(F.sum("_n").over(upto(W.partitionBy("_block").orderBy("recspan_id"))), F.lit(0))
    before = sizes.withColumn("_own", own).join(blocks, "_block").select("recspan_id", (F.col("_own") + F.col("_base")).alias("_before"))
    return df.withColumn("_in", inside).join(before, "recspan_id").withColumn(name, F.col("_in") + F.col("_before")).drop("_in", "_before")


def both(df: DataFrame, attrs, new: DataFrame, new_attrs, keep) -> tuple[DataFrame, MapAttrs | ColumnAttrs]:
    """The rows of both with the columns ``keep`` and all attributes, in the encoding of the first."""
    new, after = attrs.take(new, new_attrs, keep)
    old, _ = after.take(df, attrs, keep)
    return old.unionByName(new), after


@dataclass(frozen=True)
class Timeline:
    events: DataFrame
    recspans: DataFrame
    attrs: MapAttrs | ColumnAttrs
    recspan_attrs: MapAttrs | ColumnAttrs = field(default_factory=lambda: MapAttrs({}, "recspan_attrs"))
    #: What queries of this timeline belong to; new timelines made of it share it.
    token: object = field(default_factory=object)

    @staticmethod
    def from_rows(spark: SparkSession, recspans, events) -> Timeline:
        """recspans: (ticks, attributes), numbered from 0; events: (recspan_id, start_tick, stop_tick, attributes)."""
        types, recspan_types, n = Registry(), Registry(), len(recspans := list(recspans))
        rows = []
        for i, (r, a, b, attrs) in enumerate(events):
            if not 0 <= r < n:
                raise EventsError(f"no recording {r}")
            if not 0 <= a < b:
                raise ValueError("events need 0 <= start_tick < stop_tick")
            for k, v in attrs.items():
                types.learn(k, v)
            rows.append((i, r, a, b, {k: encode(v) for k, v in attrs.items()}))
        for _, attrs in recspans:
            for k, v in attrs.items():
                recspan_types.learn(k, v)
        spans = [(i, t, {k: encode(v) for k, v in a.items()}) for i, (t, a) in enumerate(recspans)]
        return Timeline(spark.createDataFrame(rows, EVENTS), spark.createDataFrame(spans, RECSPANS), MapAttrs(types), MapAttrs(recspan_types, "recspan_attrs"))

    @staticmethod
    def from_columns(events: DataFrame, recspans: DataFrame, keys, recspan_keys=()) -> Timeline:
        """Over typed columns; recordings' keys are columns of ``recspans`` and must differ from those of ``events``."""
        return Timeline(events, recspans, ColumnAttrs.of(events, keys), ColumnAttrs.of(recspans, recspan_keys))

    def add_recspan(self, ticks: int, attrs: dict | None = None) -> Timeline:
        """With the next id."""
        attrs, types = attrs or {}, Registry()
        for k, v in attrs.items():
            types.learn(k, v)
        spark = self.recspans.sparkSession
        row = spark.createDataFrame([(ticks, {k: encode(v) for k, v in attrs.items()})], f"ticks bigint, recspan_attrs map<string,{ATTR}>")
        top = self.recspans.agg(F.coalesce(F.max("recspan_id") + 1, F.lit(0)).alias("recspan_id"))
        recspans, after = both(self.recspans, self.recspan_attrs, top.crossJoin(row), MapAttrs(types, "recspan_attrs"), RECSPAN_KEYS)
        return replace(self, recspans=recspans, recspan_attrs=after)

    def add_events(self, new: DataFrame, types: dict[str, str | None]) -> Timeline:
        """``new``: recspan_id, start_tick, stop_tick, attrs (a map). Ids go on after the largest without gaps, by recording,
        ticks and attributes, so that a repeated task gives the same ones; recordings must exist."""
        there = self.recspans.select("recspan_id", F.lit(True).alias("_there"))
        new = check_events(new).join(there, "recspan_id", "left")
        new = new.withColumn("recspan_id", F.when(F.col("_there"), F.col("recspan_id")).otherwise(F.raise_error(F.lit("no such recording")).cast("bigint")))
        base = self.events.agg(F.coalesce(F.max("event_id") + 1, F.lit(0)).alias("_base"))
        new = numbered(new, "_no", "start_tick", "stop_tick", F.to_json("attrs")).crossJoin(F.broadcast(base)).withColumn("event_id", F.col("_base") + F.col("_no"))
        events, after = both(self.events, self.attrs, new, MapAttrs(dict(types)), EVENT_KEYS)
        return replace(self, events=events, attrs=after)

    def add_event(self, recspan_id: int, start_tick: int, stop_tick: int, attrs: dict) -> Timeline:
        spark, types = self.events.sparkSession, Registry()
        for k, v in attrs.items():
            types.learn(k, v)
        row = [(recspan_id, start_tick, stop_tick, {k: encode(v) for k, v in attrs.items()})]
        return self.add_events(spark.createDataFrame(row, f"recspan_id bigint, start_tick bigint, stop_tick bigint, attrs map<string,{ATTR}>"), types)

    # Queries.

    def placeholder(self) -> Placeholder:
        return Placeholder(self.attrs, self.recspan_attrs, self.token)

    def query(self, restrict=None) -> Query:
        return as_query(restrict, self.placeholder(), self.token)

    def with_recspans(self) -> DataFrame:
        """Events with their recordings' columns; there are few recordings for each event, and Spark picks the join."""
        return self.events.join(self.recspans, "recspan_id")

    def predicate(self, restrict=None) -> tuple[Column, bool]:
        """The compiled predicate and whether it needs the columns of recordings."""
        q = self.query(restrict)
        return compile_query(q, self.attrs, self.recspan_attrs), needs_recspan(q)

    def find(self, restrict=None) -> DataFrame:
        """Matching events, unsorted; ``sorted_events`` sorts them."""
        where, joined = self.predicate(restrict)
        if not joined:
            return self.events.where(where)
        return self.with_recspans().where(where).select(*self.events.columns)

    def sorted_events(self, restrict=None) -> DataFrame:
        return self.find(restrict).orderBy("recspan_id", "start_tick", "event_id")

    def count(self, restrict=None) -> int:
        return self.find(restrict).count()

    def matches(self, restrict) -> DataFrame:
        """All events with the column ``matches``."""
        hit = self.find(restrict).select("event_id", F.lit(True).alias("matches"))
        return self.events.join(hit, "event_id", "left").fillna(False, ["matches"])

    def at(self, recspan_id: int, start_tick: int, stop_tick: int | None = None, restrict=None) -> DataFrame:
        """Events that overlap the ticks, one tick by default."""
        stop_tick = start_tick + 1 if stop_tick is None else stop_tick
        return self.find(self.placeholder().overlaps(recspan_id, start_tick, stop_tick) & self.query(restrict))

    def relative(self, count: int, restrict=None) -> DataFrame:
        """(event_id, other_id): the count-th matching event with a later start (earlier, if negative) in the recording;
        null if there is none. Distinct starts are ranked, so that ties count as events do, by id."""
        if not count:
            raise IndexError("an event is not relative to itself")
        where, joined = self.predicate(restrict)
        base = (self.with_recspans() if joined else self.events).withColumn("_hit", F.coalesce(where, F.lit(False)))
        step = F.lit(1 if count > 0 else -1)
        order = W.partitionBy("recspan_id").orderBy(step * F.col("start_tick"), step * F.col("event_id"))
        # Matches with the same start don't follow each other: the n-th after is the n-th of those after the last equal start.
        upto = W.partitionBy("recspan_id").orderBy(step * F.col("start_tick")).rangeBetween(W.unboundedPreceding, 0)
        ranked = base.select("event_id", "recspan_id", "start_tick", "_hit", F.sum(F.col("_hit").cast("long")).over(upto).alias("_seen"), F.sum(F.col("_hit").cast("long")).over(order.rowsBetween(W.unboundedPreceding, 0)).alias("_rank"))
        others = ranked.where("_hit").select("recspan_id", F.col("_rank").alias("_want"), F.col("event_id").alias("other_id"))
        own = ranked.select("event_id", "recspan_id", (F.col("_seen") + abs(count)).alias("_want"))
        return own.join(others, ["recspan_id", "_want"], "left").select("event_id", "other_id")

    # Changes.

    def _where(self, restrict) -> tuple[DataFrame, Column]:
        where, joined = self.predicate(restrict)
        if not joined:
            return self.events, F.coalesce(where, F.lit(False))
        df = self.matches(restrict)
        return df, F.col("matches")

    def set_attr(self, key: str, value, restrict=None) -> Timeline:
        df, hit = self._where(restrict)
        df, after = self.attrs.put(df, key, F.lit(value), literal_type(value), hit)
        return replace(self, events=df.select(*EVENT_KEYS, *after.columns()), attrs=after)

    def update(self, values: dict, restrict=None) -> Timeline:
        """Several keys; which events match is asked of the events as they are."""
        out, hit = self.matches(restrict), F.col("matches")
        attrs = self.attrs
        for key, value in values.items():
            out, attrs = attrs.put(out, key, F.lit(value), literal_type(value), hit)
        return replace(self, events=out.select(*EVENT_KEYS, *attrs.columns()), attrs=attrs)

    def delete_attr(self, key: str, restrict=None) -> Timeline:
        """An event without the key is an error."""
        df, hit = self._where(restrict)
        df = self.attrs.without(df, key, hit)
        after = replace(self.attrs, optional=self.attrs.optional | {key}) if isinstance(self.attrs, ColumnAttrs) and key in self.attrs.types else self.attrs
        return replace(self, events=df.select(*EVENT_KEYS, *after.columns()), attrs=after)

    def move(self, offset: int, restrict=None) -> Timeline:
        df, hit = self._where(restrict)
        by = F.when(hit, offset).otherwise(0)
        df = df.withColumn("_by", by).withColumns({c: F.col(c) + F.col("_by") for c in ("start_tick", "stop_tick")})
        return replace(self, events=df.select(*self.events.columns))

    def delete(self, restrict=None) -> Timeline:
        return replace(self, events=self.events.join(self.find(restrict).select("event_id"), "event_id", "left_anti").select(*self.events.columns))

    def union(self, other: Timeline) -> Timeline:
        """Both, in the encoding of this one; the other's recordings and events get ids after the own ones."""
        r = F.broadcast(self.recspans.agg(F.coalesce(F.max("recspan_id") + 1, F.lit(0)).alias("_r")))
        e = F.broadcast(self.events.agg(F.coalesce(F.max("event_id") + 1, F.lit(0)).alias("_e")))
        spans = other.recspans.crossJoin(r).withColumn("recspan_id", F.col("recspan_id") + F.col("_r"))
        events = other.events.crossJoin(r).crossJoin(e).withColumns({"recspan_id": F.col("recspan_id") + F.col("_r"), "event_id": F.col("event_id") + F.col("_e")})
        recspans, recspan_attrs = both(self.recspans, self.recspan_attrs, spans, other.recspan_attrs, RECSPAN_KEYS)
        events, attrs = both(self.events, self.attrs, events, other.attrs, EVENT_KEYS)
        return replace(self, events=events, recspans=recspans, attrs=attrs, recspan_attrs=recspan_attrs)

    def merge_df(self, lookup: DataFrame, on, restrict=None) -> Timeline:
        """Copies the columns of ``lookup`` that are not in ``on`` to the events whose keys equal theirs, null-safely.
        ``on``: a name, names, or {column: key}. A value that an event already has must be equal; else nothing changes."""
        on = {on: on} if isinstance(on, str) else dict(on) if isinstance(on, dict) else {k: k for k in on}
        dtypes, new = dict(lookup.dtypes), [c for c in lookup.columns if c not in on]
        agree(self.attrs.types, {c: kind_of_type(dtypes[c]) for c in new})
        df, hit = self._where(restrict)
        right = lookup.select(*(F.col(c).alias(f"_k_{c}") for c in on), *(F.col(c).alias(f"_v_{c}") for c in new), F.lit(True).alias("_found"))
        cond = hit
        for column, key in on.items():
            cond = cond & (F.col(INDEX[key]) if key in INDEX else self.attrs.value(key)).eqNullSafe(F.col(f"_k_{column}"))
            cond = cond & (F.lit(True) if key in INDEX else self.attrs.present(key))
        df = df.join(right, cond, "left")
        clash = F.lit(False)
        for c in new:
            if c in self.attrs.types:
                clash = clash | (F.col("_found") & self.attrs.present(c) & ~self.attrs.value(c).eqNullSafe(F.col(f"_v_{c}")))
        if not df.where(clash).isEmpty():
            raise ValueError("the merge would overwrite values with others")
        if not df.groupBy("event_id").count().where("count > 1").isEmpty():
            raise ValueError("several rows of the lookup fit one event")
        after, found = self.attrs, F.coalesce(F.col("_found"), F.lit(False))
        for c in new:
            df, after = after.put(df, c, F.col(f"_v_{c}"), dtypes[c], found)
        return replace(self, events=df.select(*EVENT_KEYS, *after.columns()), attrs=after)

    # Single events and reports.

    def items(self, restrict=None) -> DataFrame:
        """(event_id, key, value): a row for each attribute that a matching event has, values as text."""
        found, _ = MapAttrs().take(self.find(restrict), self.attrs, EVENT_KEYS)
        pairs = found.select("event_id", F.explode("attrs").alias("key", "a"))
        return pairs.select("event_id", "key", F.coalesce(F.col("a.s"), F.col("a.b").cast("string"), F.col("a.l").cast("string"), F.col("a.d").cast("string")).alias("value"))

    def event(self, event_id: int) -> dict:
        """The attributes of one event, as a dict of its own; ``update`` and ``delete_attr`` write. KeyError if it is gone."""
        found, _ = MapAttrs().take(self.events.where(F.col("event_id") == event_id), self.attrs, EVENT_KEYS)
        rows = found.take(1)
        if not rows:
            raise KeyError(event_id)
        return {k: decode(v) for k, v in (rows[0].attrs or {}).items()}

    def exists(self, event_id: int) -> bool:
        return not self.events.where(F.col("event_id") == event_id).isEmpty()

    def sorted_recspans(self) -> DataFrame:
        return self.recspans.orderBy("recspan_id")

    def save(self, path: str) -> None:
        """As Parquet; the encodings and the types of keys are a small third table."""
        self.events.write.parquet(f"{path}/events")
        self.recspans.write.parquet(f"{path}/recspans")
        rows = []
        for space, a in (("event", self.attrs), ("recspan", self.recspan_attrs)):
            rows.append((space, None, "columns" if isinstance(a, ColumnAttrs) else "map"))
            rows += [(space, k, v) for k, v in a.types.items()]
        self.events.sparkSession.createDataFrame(rows, "space string, key string, kind string").write.parquet(f"{path}/types")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Timeline:
        types: dict[str, dict] = {"event": {}, "recspan": {}}
        how = dict.fromkeys(types, "map")
        for r in spark.read.parquet(f"{path}/types").collect():
            if r.key is None:
                how[r.space] = r.kind
            else:
                types[r.space][r.key] = r.kind
        events, recspans = spark.read.parquet(f"{path}/events"), spark.read.parquet(f"{path}/recspans")

        def attrs(space: str, df: DataFrame, column: str):
            own = types[space]
            return ColumnAttrs(own, "", frozenset(k for k in own if f"{k}__present" in df.columns)) if how[space] == "columns" else MapAttrs(own, column)

        return Timeline(events, recspans, attrs("event", events, "attrs"), attrs("recspan", recspans, "recspan_attrs"))


INDEX = {"_RECSPAN_ID": "recspan_id", "_START_TICK": "start_tick", "_STOP_TICK": "stop_tick"}
