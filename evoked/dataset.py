"""The facade over a recording's signal, its timeline and its format."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evoked.functions.data_format import DataFormat
from evoked.operators import epochs as ep
from evoked.operators.regression import Fit, Request, multi_rerp
from evoked.operators.timeline import Timeline
from evoked.sources.lookup import read_lookup


@dataclass(frozen=True)
class Dataset:
    """signal: recspan_id, tick and a double column for each channel. All methods that change something return a new one."""

    data_format: DataFormat
    signal: DataFrame
    timeline: Timeline

    def add_recspan(self, data: DataFrame, ticks: int, metadata: dict | None = None) -> Dataset:
        """``data``: tick and the channels."""
        channels = self.data_format.channel_names
        if [c for c in data.columns if c != "tick"] != list(channels):
            raise ValueError("the channels differ")
        t = self.timeline.add_recspan(ticks, metadata)
        top = F.broadcast(t.recspans.agg(F.max("recspan_id").alias("recspan_id")))
        rows = data.select(F.col("tick").cast("long"), *(F.col(c).cast("double") for c in channels)).crossJoin(top)
        return replace(self, signal=self.signal.unionByName(rows), timeline=t)

    def __getitem__(self, i: int) -> DataFrame:
        if not isinstance(i, int):
            raise TypeError("recordings are taken one by one")
        period = self.data_format.approx_sample_period_ms
        return self.signal.where(F.col("recspan_id") == i).withColumn("time_ms", F.col("tick") * float(period))

    def __len__(self) -> int:
        return self.timeline.recspans.count()

    def __iter__(self):
        return (self[i] for i in range(len(self)))

    def __repr__(self) -> str:
        r = self.timeline.recspans.agg(F.count("*").alias("n"), F.coalesce(F.sum("ticks"), F.lit(0)).alias("t")).first()
        return f"<Dataset: {self.timeline.count()} events, {r.t} ticks in {r.n} recordings>"

    def raw_slice(self, recspan_id: int, start_tick: int, stop_tick: int) -> DataFrame:
        return ep.raw_slice(self.signal, recspan_id, start_tick, stop_tick)

    def transform(self, matrix, exclude=()) -> Dataset:
        if isinstance(matrix, str):
            matrix = self.data_format.compute_symbolic_transform(matrix, exclude)
        elif exclude:
            raise ValueError("exclude goes with expressions")
        return replace(self, signal=ep.transform(self.signal, list(self.data_format.channel_names), matrix))

    def add_dataset(self, other: Dataset) -> Dataset:
        if other.data_format != self.data_format:
            raise ValueError("the formats differ")
        top = F.broadcast(self.timeline.recspans.agg(F.coalesce(F.max("recspan_id") + 1, F.lit(0)).alias("_r")))
        rows = other.signal.crossJoin(top).withColumn("recspan_id", F.col("recspan_id") + F.col("_r")).drop("_r")
        return replace(self, signal=self.signal.unionByName(rows), timeline=self.timeline.union(other.timeline))

    def events(self, restrict=None) -> DataFrame:
        return self.timeline.sorted_events(restrict)

    def events_at(self, recspan_id: int, start_tick: int, stop_tick: int | None = None, restrict=None) -> DataFrame:
        return self.timeline.at(recspan_id, start_tick, stop_tick, restrict)

    def epochs(self, event_query, start_time: float, stop_time: float, incomplete_action: str = "raise") -> DataFrame:
        return self.epochs_ticks(event_query, *self.data_format.ms_span_to_ticks(start_time, stop_time), incomplete_action)

    def epochs_ticks(self, event_query, start_tick: int, stop_tick: int, incomplete_action: str = "raise") -> DataFrame:
        out = ep.epochs(self.timeline.find(event_query), self.signal, self.timeline.recspans, start_tick, stop_tick, incomplete_action)
        return out.withColumn("latency_ms", self.data_format.ticks_to_ms(F.col("latency_tick")))

    def merge_df(self, df: DataFrame, on, restrict=None) -> Dataset:
        return replace(self, timeline=self.timeline.merge_df(df, on, restrict))

    def merge_csv(self, path: str, on, restrict=None, **options) -> Dataset:
        return self.merge_df(read_lookup(self.signal.sparkSession, path, **options), on, restrict)

    def rerp(self, event_query, start_time, stop_time, formula, name=None, bad_event_query=None, all_or_nothing=False, **options) -> Fit:
        return self.multi_rerp([Request(event_query, start_time, stop_time, formula, name, bad_event_query, all_or_nothing)], **options)[0]

    def multi_rerp(self, requests: list[Request], **options) -> list[Fit]:
        return multi_rerp(self.timeline, self.signal, self.data_format, requests, **options)

    def calibrated(self, calibrate_half_width_ticks: int = 5, calibrate_low_cursor_time=None, calibrate_high_cursor_time=None, calibrate_pulse_size=None, calibrate_polarity: int = 1) -> Dataset:
        """In microvolts, by the mean of calibration pulses about two cursors."""
        if None in (calibrate_low_cursor_time, calibrate_high_cursor_time, calibrate_pulse_size):
            raise ValueError("calibration needs cursors and the size of the pulse")
        fmt, half, means = self.data_format, calibrate_half_width_ticks, []
        for time in (calibrate_low_cursor_time, calibrate_high_cursor_time):
            at = fmt.ms_to_ticks(time)
            span = [fmt.ticks_to_ms(at - half), fmt.ticks_to_ms(at + half)]
            fit = self.rerp("has calibration_pulse", *span, "1", all_or_nothing=True, overlap_correction=False)
            means.append(fit.betas.agg(*(F.avg(c).alias(c) for c in fmt.channel_names)).first())
        n = len(fmt.channel_names)
        matrix = [[calibrate_pulse_size * calibrate_polarity / (means[1][c] - means[0][c]) if i == j else 0.0 for j in range(n)] for i, c in enumerate(fmt.channel_names)]
        return replace(self.transform(matrix), data_format=replace(fmt, units="uV"))
