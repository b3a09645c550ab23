"""Normalising dates and times: an as-of join of local readings to zone-offset intervals."""

from __future__ import annotations

import calendar
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeweave.functions import moments as M


FIRST_YEAR, LAST_YEAR = 1800, M.RULES_END - 1


def _year(c: Column) -> Column:
    return F.year(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(c / 86400).cast("int")))


def _decade(year: Column) -> Column:
    """No zone changed before 1800, none that the table lists after its last year: both ends hold what lies beyond."""
    return F.floor(F.greatest(F.lit(FIRST_YEAR), F.least(F.lit(LAST_YEAR), year)) / 10).cast("int")


def _days_back(year: Column) -> Column:
    """Days from a year beyond the table back to one in it that has the same calendar, so the same days of change."""
    like = {(date(y, 1, 1).weekday(), calendar.isleap(y)): y for y in range(LAST_YEAR - 27, LAST_YEAR + 1)}
    same = F.create_map(*[F.lit(x) for (day, leap), y in like.items() for x in (2 * day + leap, y)])
    new_year = lambda y: F.make_date(y, F.lit(1), F.lit(1))
    leap = (F.dayofyear(F.make_date(year, F.lit(12), F.lit(31))) == 366).cast("int")
    return F.when(year > LAST_YEAR, F.date_diff(new_year(year), new_year(same[2 * F.weekday(new_year(year)) + leap]))).otherwise(0)


def offset_intervals(spark: SparkSession, zones: list[str] | None = None) -> DataFrame:
    """Zone-offset intervals exploded to the local decades that they touch: ``(zone, decade, spans)``.

    Every interval ``[utc_from, utc_to)`` with one offset covers the wall-clock times
    ``[utc_from + offset, utc_to + offset)``. Exploding by decade turns the range condition into an equi-join;
    ``spans`` holds the few intervals of that decade, the first and the last of a zone being open. The size depends on
    the tz database alone (about 600 zones x 33 decades), never on the data, so the broadcast is bounded.
    """
    import pyarrow as pa

    rows = M.zone_intervals(zones or M.ZONES)
    names = ["zone", "utc_from", "utc_to", "offset_s", "abbr"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
    spans = spark.createDataFrame(pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names))
    return (
        spans.withColumn("lo", F.col("utc_from") + F.col("offset_s"))
        .withColumn("hi", F.col("utc_to") + F.col("offset_s"))
        .withColumn("decade", F.explode(F.sequence(_decade(_year(F.col("lo"))), _decade(_year(F.col("hi"))))))
        .groupBy("zone", "decade")
        .agg(F.collect_list(F.struct("lo", "hi", "offset_s", "abbr")).alias("spans"))
    )


def resolve_instants(readings: DataFrame, reading: str = "reading") -> DataFrame:
    """Add ``epoch_s`` and ``status`` to rows with a reading (see ``functions.moments``).

    * a stated offset or an epoch decides by itself (``stated``);
    * else the reading joins the intervals of its zone as of its wall-clock time: one gives the offset
      (``exact``); two mean ``ambiguous``, and only a written abbreviation such as EST picks one of them
      (``exact``), else ``epoch_s`` is null; none means ``nonexistent``, ``epoch_s`` null;
    * a zone that the tz database lacks gives ``unknown_zone``, ``epoch_s`` null. Years beyond the table take the
      offset of a year with the same calendar.

    The join broadcasts the interval table, whose size is fixed; readings are never shuffled.
    """
    r = F.col(reading)
    zones = offset_intervals(readings.sparkSession)
    df = readings.withColumn("_zone", r["zone"]).withColumn("_at", r["local_s"] - 86400 * _days_back(_year(r["local_s"])).cast("long"))
    df = df.withColumn("_decade", _decade(_year(F.col("_at"))))
    z = zones.select(F.col("zone").alias("_z"), F.col("decade").alias("_d"), F.col("spans").alias("_spans"))
    df = df.join(F.broadcast(z), (F.col("_zone") == F.col("_z")) & (F.col("_decade") == F.col("_d")), "left")
    hits = F.filter("_spans", lambda s: (s["lo"] <= F.col("_at")) & (F.col("_at") < s["hi"]))
    named = F.filter("_hits", lambda s: s["abbr"] == r["abbr"])
    pick = F.when(F.size("_hits") == 1, F.col("_hits")[0]).when(F.size(named) == 1, F.get(named, F.lit(0)))
    return (
        df.withColumn("_hits", hits)
        .withColumn("_one", pick)
        .withColumn("epoch_s", F.coalesce(r["epoch_s"], r["local_s"] - F.col("_one.offset_s")))
        .withColumn(
            "status",
            F.when(r["epoch_s"].isNotNull(), "stated")
            .when(F.col("_one").isNotNull(), "exact")
            .when(F.col("_spans").isNull(), "unknown_zone")
            .when(F.size("_hits") > 1, "ambiguous")
            .otherwise("nonexistent"),
        )
        .drop("_zone", "_decade", "_at", "_z", "_d", "_spans", "_hits", "_one")
    )


def _valid_day(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^\d{4}-\d{2}-\d{2}\z") & F.try_to_date(c, "yyyy-MM-dd").isNotNull(), F.lit(False))


def normalise_subsidy_times(subsidies: DataFrame) -> DataFrame:
    """``(id, field, raw, raw_time, status, epoch_s, normalised)`` of each value that is not yet in the one form.

    Fields: ``announce_date`` gives the Taipei date, ``deadline_text`` and ``apply_end`` (with ``apply_end_time``)
    the closing instant in UTC. Nulls, empty texts and values that name no existing, complete date give no row, and
    neither do nonexistent or undecidable local times. A zone that nobody knows keeps its row, with status
    ``unknown_zone`` and no instant, and is never taken for Taipei. A time field that names no hour, such as a bare half of the
    day, counts as absent. Repeated rows give repeated results; extra columns are ignored.
    """
    s = subsidies.select("id", "announce_date", "apply_end", "apply_end_time", "deadline_text")
    odd_time = F.coalesce(~F.col("apply_end_time").rlike(r"^([01]\d|2[0-3]):[0-5]\d\z"), F.lit(False))
    # Only texts with a digit or numeral can name a date; the rest reaches Python as null.
    dated = lambda c: F.when(c.rlike("[0-9０-９一二三四五六七八九十]"), c)
    s = s.select(
        "id",
        F.when(~_valid_day(F.col("announce_date")), dated(F.col("announce_date"))).alias("day"),
        dated(F.col("deadline_text")).alias("text"),
        F.when(~_valid_day(F.col("apply_end")) | odd_time, dated(F.col("apply_end"))).alias("end"),
        F.col("apply_end_time").alias("end_time"),
    )
    # One pass over the rows evaluates the three readers in the same Arrow batches.
    s = s.select("*", M.read_day("day").alias("r1"), M.read_closing("text").alias("r2"), M.read_closing_of("end", "end_time").alias("r3"))
    part = lambda field, raw, time, r: F.struct(
        F.lit(field).alias("field"), F.col(raw).alias("raw"), time.alias("raw_time"), F.col(r).alias("reading")
    )
    none = F.lit(None).cast("string")
    parts = F.array(
        part("announce_date", "day", none, "r1"),
        part("deadline_text", "text", none, "r2"),
        part("apply_end", "end", F.col("end_time"), "r3"),
    )
    longer = s.select("id", F.inline(F.filter(parts, lambda p: p["reading"]["local_s"].isNotNull())))
    got = resolve_instants(longer)
    # Wall time without a zone plus an interval: nothing depends on the session's time zone.
    utc = F.expr("timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, epoch_s)")
    taipei = F.expr("timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, epoch_s + 28800)")
    return got.where("epoch_s is not null or status = 'unknown_zone'").withColumn(
        "normalised",
        F.when(F.col("field") == "announce_date", F.date_format(taipei, "yyyy-MM-dd")).otherwise(
            F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss'Z'")
        ),
    ).select("id", "field", "raw", "raw_time", "status", "epoch_s", "normalised")


def timestamps_found(subsidies: DataFrame) -> DataFrame:
    """Distinct ``(id, field, normalised)``; see ``normalise_subsidy_times``."""
    return normalise_subsidy_times(subsidies).where("normalised is not null").select("id", "field", "normalised").distinct()
