"""Trading sessions and calendars: Column expressions over epoch milliseconds (UTC)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DAY_MS = 86_400_000
MINUTE_MS = 60_000


def new_york(ms: Column) -> Column:
    """Wall-clock time in New York, with daylight saving."""
    return F.from_utc_timestamp(F.timestamp_millis(ms), "America/New_York")


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def us_equity_status(ms: Column, is_holiday: Column | None = None) -> Column:
    """Open 09:30-16:00, Extended 04:00-09:30 and 16:00-20:00 New York time, else Closed; Closed at weekends and on holidays."""
    ts = new_york(ms)
    minute = minute_of_day(ts)
    closed = F.dayofweek(ts).isin(1, 7)
    if is_holiday is not None:
        closed = closed | F.coalesce(is_holiday, F.lit(False))
    return F.when(closed, "Closed").when((minute >= 570) & (minute < 960), "Open").when((minute >= 240) & (minute < 1200), "Extended").otherwise("Closed")


def forex_status(ms: Column) -> Column:
    """Closed from Friday 22:00 to Sunday 22:00 UTC."""
    minute_of_week = (F.floor(ms / MINUTE_MS) + 3 * 1440) % 10080  # from Monday 00:00
    return F.when((minute_of_week >= 4 * 1440 + 1320) & (minute_of_week < 6 * 1440 + 1320), "Closed").otherwise("Open")


def is_weekend(ms: Column) -> Column:
    return (F.floor(ms / DAY_MS) + 3) % 7 >= 5


def fraction_of_day(ms: Column) -> Column:
    return (ms % DAY_MS) / DAY_MS


def is_triple_witching(day: Column) -> Column:
    """The third Friday of March, June, September or December."""
    return F.month(day).isin(3, 6, 9, 12) & (F.dayofweek(day) == 6) & F.dayofmonth(day).between(15, 21)


def is_earnings_season(day: Column) -> Column:
    return F.month(day).isin(1, 4, 7, 10)


def week_of_month(day: Column) -> Column:
    return F.floor((F.dayofmonth(day) - 1) / 7) + 1


def easter(year: int) -> dt.date:
    """Easter Sunday of the Gregorian calendar."""
    golden, century = year % 19, year // 100
    moon = (century - century // 4 - (8 * century + 13) // 25 + 19 * golden + 15) % 30
    moon -= (moon // 28) * (1 - (29 // (moon + 1)) * ((21 - golden) // 11))
    weekday = (year + year // 4 + moon + 2 - century + century // 4) % 7
    away = moon - weekday
    month = 3 + (away + 40) // 44
    return dt.date(year, month, away + 28 - 31 * (month // 4))


def us_holidays(year: int) -> list[dt.date]:
    """Market holidays: fixed dates observed on the nearest weekday, floating Mondays, Good Friday, Thanksgiving."""

    def nth(month: int, weekday: int, n: int) -> dt.date:
        first = dt.date(year, month, 1)
        return first + dt.timedelta((weekday - first.weekday()) % 7 + 7 * (n - 1))

    def observed(month: int, day: int) -> dt.date:
        on = dt.date(year, month, day)
        return on + dt.timedelta({5: -1, 6: 1}.get(on.weekday(), 0))

    last_of_may = dt.date(year, 5, 31)
    days = [observed(1, 1), nth(1, 0, 3), nth(2, 0, 3), easter(year) - dt.timedelta(2), last_of_may - dt.timedelta(last_of_may.weekday()), observed(7, 4), nth(9, 0, 1), nth(11, 3, 4), observed(12, 25)]
    return sorted(days + ([observed(6, 19)] if year >= 2022 else []))


def calendar(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """day, is_holiday, is_trading_day of every day: some hundred rows a year."""
    holidays = [(d,) for y in range(first_year, last_year + 2) for d in us_holidays(y)]
    days = spark.range(1).select(F.explode(F.sequence(F.lit(dt.date(first_year, 1, 1)), F.lit(dt.date(last_year, 12, 31)))).alias("day"))
    marked = days.join(spark.createDataFrame(holidays, "day date").withColumn("is_holiday", F.lit(True)).distinct(), "day", "left").withColumn("is_holiday", F.coalesce("is_holiday", F.lit(False)))
    return marked.withColumn("is_trading_day", ~F.col("is_holiday") & ~F.dayofweek("day").isin(1, 7))


#: Regular hours of US equities in minutes of the New York day, the extended hours about them, and a session's length.
OPEN, CLOSE, PRE_MARKET, AFTER_HOURS = 570, 960, 240, 1200
SESSION_MS = (CLOSE - OPEN) * MINUTE_MS
#: Opening and closing minute of the UTC day. There is no summer time, weekend or holiday in these.
FIXED_HOURS = {"NYSE": (870, 1260), "LSE": (480, 990), "CRYPTO": (0, 1439)}


def us_equity_clock(ms: Column, is_trading_day: Column, margin_ms: int) -> dict[str, Column]:
    """Where a moment lies in the regular session of a New York day; progress and what follows from it are null outside."""
    ts = new_york(ms)
    minute = minute_of_day(ts)
    status = us_equity_status(ms, ~is_trading_day)
    is_open = status == "Open"
    elapsed = F.when(is_open, (minute - OPEN).cast("long") * MINUTE_MS + ms % MINUTE_MS)
    progress = elapsed / SESSION_MS

    def within(test: Column) -> Column:
        return F.coalesce(test, F.lit(False))

    extended = status == "Extended"
    return {
        "label": F.when(is_open, "open").when(extended & (minute < OPEN), "pre-market").when(extended, "after-hours").otherwise("closed"),
        "time_in_session_ms": elapsed,
        "remaining_ms": SESSION_MS - elapsed,
        "progress": progress,
        "half": F.when(progress < 0.5, 1).when(is_open, 2).otherwise(0),
        "is_pre_market": extended & (minute < OPEN),
        "is_after_hours": extended & (minute >= CLOSE),
        "is_overnight": (status == "Closed") & ~is_weekend(ms),
        "is_mid_session": within(progress.between(0.25, 0.75)),
        "is_near_close": within(elapsed + margin_ms >= SESSION_MS),
        "is_opening_range": within(elapsed < 30 * MINUTE_MS),
        "is_lunch_hour": within((elapsed >= 150 * MINUTE_MS) & (elapsed < 210 * MINUTE_MS)),
        "is_power_hour": within(progress > 5.5 / 6.5),
        "is_opening_bell_minute": within(elapsed <= MINUTE_MS),
        "is_closing_bell_minute": within(elapsed + MINUTE_MS >= SESSION_MS),
    }


def with_next_trading_day(days: DataFrame) -> DataFrame:
    """A calendar with `next_day`, the first trading day after each day: a window over some hundred rows a year."""
    after = Window.orderBy("day").rowsBetween(1, Window.unboundedFollowing)
    return days.withColumn("next_day", F.min(F.when(F.col("is_trading_day"), F.col("day"))).over(after))


def us_equity_next(ms: Column, is_trading_day: Column, next_day: Column) -> dict[str, Column]:
    """The next opening, closing and end of the extended hours after a moment, in epoch milliseconds."""
    ts = new_york(ms)
    minute, day = minute_of_day(ts), F.to_date(ts)

    def following(at: int) -> Column:
        on = F.when(is_trading_day & (minute < at), day).otherwise(next_day)
        return F.unix_millis(F.to_utc_timestamp(on.cast("timestamp") + F.make_dt_interval(mins=F.lit(at)), "America/New_York"))

    return {"next_open_ms": following(OPEN), "next_close_ms": following(CLOSE), "next_extended_close_ms": following(AFTER_HOURS)}


def fixed_hours(ms: Column, opens: int, closes: int) -> dict[str, Column]:
    """An exchange that opens and closes at fixed minutes of each UTC day: open, the next opening (now, if open), time until it closes."""
    minute, midnight = F.floor(ms / MINUTE_MS) % 1440, ms - ms % DAY_MS
    is_open = (minute >= opens) & (minute < closes)
    opening = midnight + opens * MINUTE_MS
    later = F.when(opening > ms, opening).otherwise(opening + DAY_MS)
    return {"is_open": is_open, "next_open_ms": F.when(is_open, ms).otherwise(later), "until_close_ms": F.when(is_open, midnight + closes * MINUTE_MS - ms)}


def weekdays_between(first: Column, last: Column) -> Column:
    """Mondays to Fridays from first to last, both included; holidays count."""
    monday = F.lit(dt.date(1970, 1, 5))

    def upto(day: Column) -> Column:  # weekdays from that Monday to the day
        n = F.datediff(day, monday) + 1
        return F.floor(n / 7) * 5 + F.least(F.pmod(n, F.lit(7)), F.lit(5))

    return upto(last) - upto(F.date_sub(first, 1))


def date_flags(day: Column) -> dict[str, Column]:
    """Weekday name, last week of the month, the central bank's quiet weeks (about), and days beside a market holiday."""
    month, of_month = F.month(day), F.dayofmonth(day)
    beside = ((month == 12) & of_month.isin(24, 26, 31)) | ((month == 1) & (of_month == 2)) | ((month == 7) & of_month.isin(3, 5))
    return {
        "weekday": F.date_format(day, "EEEE"),
        "is_expiry_week": of_month >= 22,
        "is_quiet_window": month.isin(1, 3, 5, 7, 9, 11) & (of_month >= 18),
        "is_beside_holiday": beside | ((month == 11) & (F.dayofweek(day) == 6) & of_month.between(23, 29)),
    }
