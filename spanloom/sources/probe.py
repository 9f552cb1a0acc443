"""The duration that a media probe's JSON gives."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEMA = "streams array<struct<duration:string>>, format struct<duration:string,start_time:string>"


def probed_duration(probe: Column) -> Column:
    """Seconds: the first stream's usable duration, else the container's, less a start that it counts in; null if neither is usable.

    Usable is a finite number that isn't negative.
    """
    read = F.from_json(probe, SCHEMA)

    def seconds(text: Column) -> Column:
        value = text.try_cast("double")
        return F.when((value >= 0) & (value < float("inf")) & ~F.isnan(value), value)

    streams = F.filter(F.transform(read["streams"], lambda s: seconds(s["duration"])), lambda d: d.isNotNull())
    whole, start = seconds(read["format"]["duration"]), seconds(read["format"]["start_time"])
    return F.coalesce(F.get(streams, F.lit(0)), F.when((start > 0) & (whole > start), whole - start).otherwise(whole))
