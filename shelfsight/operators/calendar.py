"""Commerce calendar: promotion status, dated templates, event categories, calendar windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsight.functions import fixed
from shelfsight.functions.num import c, cascade, clamp, half_up
from shelfsight.operators.content import season_of
from shelfsight.operators.joins import any_contained

DAY = 86400


def string_list(x) -> Column:
    """A JSON array as an array; empty when missing or malformed."""
    return F.coalesce(F.from_json(c(x), "array<string>"), F.array().cast("array<string>"))


def promotion_status(promos: DataFrame, as_of: int) -> DataFrame:
    """promos(start_s, end_s epoch seconds, active): live flag, remaining time and progress."""
    now = F.lit(as_of)
    left = F.greatest(F.lit(0), F.col("end_s") - now)
    dur = F.col("end_s") - F.col("start_s")
    return promos.withColumn("is_live", (now >= F.col("start_s")) & (now <= F.col("end_s")) & F.col("active")).withColumn(
        "days_ceil", F.ceil(left / DAY)).withColumn("hours_floor", F.floor(left / 3600)).withColumn(
        "progress", F.when(dur > 0, clamp((now - F.col("start_s")) / dur * 100, 0, 100)).otherwise(0.0))


def promotion_slug(title) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(c(title)), r"[^A-Za-z0-9_\s-]", ""), r"\s+", "-"), 1, 100)


def event_categories(event: Column, plants: Column) -> Column:
    """Category set of an event: `Plants` plus every rule that matches the event or a plant."""
    parts = [F.array(F.lit("Plants"))]
    ev = F.lower(event)
    names = F.transform(plants, F.lower)
    for field, words, cats in fixed.EVENT_CATEGORY_RULES:
        pat = "|".join(words)
        hit = any_contained(ev, words) if field == "event" else F.array_join(names, "\n").rlike(pat)
        parts.append(F.when(hit, F.lit(cats)).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.concat(*parts))


def badge_color(priority, season) -> Column:
    return cascade([(c(priority) == "high", fixed.HIGH_PRIORITY_COLOR)]
                   + [(c(season) == k, v) for k, v in fixed.SEASON_COLORS.items()], fixed.DEFAULT_COLOR)


def seasonal_promotions(events: DataFrame, month: int, hemisphere: str) -> DataFrame:
    """events(event, plants[], priority): high first, badge text and colour, categories."""
    season = season_of(F.lit(month), F.lit(hemisphere))
    high = F.col("priority") == "high"
    return events.withColumn("badge_color", badge_color("priority", season)).withColumn(
        "badge_text", F.when(high, F.col("event")).otherwise(F.array_join(F.slice(F.split("event", " "), 1, 2), " "))).withColumn(
        "keywords", F.concat(F.array(F.lower("event")), F.when(high, F.transform("plants", lambda p: F.concat(p, F.lit(" plants")))).otherwise(
            F.transform(F.slice("plants", 1, 3), F.lower)))).withColumn(
        "categories", event_categories(F.col("event"), F.col("plants"))).withColumn("ord", F.when(high, 0).otherwise(1))


def dated_promotions(templates: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """Templates (0-based months) to dated rows; a template that wraps ends in the next year.

    Days beyond a month's length roll over, as date arithmetic from the first of the month does.
    """
    t = templates.withColumn("year", F.explode(F.sequence(F.lit(first_year), F.lit(last_year))))
    day = lambda y, mo, dd: F.date_add(F.make_date(y, mo + 1, F.lit(1)), (dd - 1).cast("int"))
    end_year = F.col("year") + F.when(F.col("month_end") < F.col("month_start"), 1).otherwise(0)
    start = F.unix_date(day(F.col("year"), F.col("month_start"), F.col("day_start"))).cast("long") * DAY
    end = F.unix_date(day(end_year, F.col("month_end"), F.col("day_end"))).cast("long") * DAY + (DAY - 1)
    return t.withColumn("start_s", start).withColumn("end_s", end)


def demand_multiplier() -> Column:
    base = cascade([(F.col("type") == k, v) for k, v in fixed.PROMOTION_MULTIPLIERS.items()], 1.0)
    m = base * F.when(F.col("featured"), 1.2).otherwise(1.0) * F.when(F.col("is_live"), 1.3).otherwise(1.0)
    m = m * cascade([(F.col("is_live") & (F.col("days_floor") <= 3), 1.5), (F.col("is_live") & (F.col("days_floor") <= 7), 1.2)], 1.0)
    return half_up(m, 2)


def calendar(promos: DataFrame, as_of: int, until: int, region: str) -> DataFrame:
    """Dated promotions that overlap [as_of, until] in the region or everywhere."""
    region_ok = F.col("region").isNull() | F.col("region").isin("GLOBAL", region.upper())
    d = promos.where((F.col("start_s") <= until) & (F.col("end_s") >= as_of) & region_ok)
    d = d.withColumn("is_live", F.lit(as_of) >= F.col("start_s")).withColumn(
        "days_floor", F.floor(F.greatest(F.lit(0), F.col("end_s") - as_of) / DAY))
    return d.withColumn("demand_multiplier", demand_multiplier()).orderBy(F.desc("is_live"), "start_s", "title")


def month_events(events: DataFrame, first: int, last: int, region: str) -> DataFrame:
    mo = F.col("month")
    window = mo.between(first, last) if last >= first else (mo >= first) | (mo <= last)
    return events.where(F.col("region").isin("GLOBAL", region.upper()) & window)


def next_peak(cal: DataFrame) -> DataFrame:
    return cal.agg(F.max_by(F.struct("title", "start_s", "demand_multiplier"),
                            F.struct("demand_multiplier", -F.col("start_s"), -F.col("ord"))).alias("p")).select("p.*")
