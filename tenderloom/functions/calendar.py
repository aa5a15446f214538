"""State holidays, business days and the two clocks that run on them.

Everything is arithmetic on the row's own days, whatever years they lie in: no
calendar table, no join. Weekend days through a day follow from whole weeks,
holidays from whole years and the nine of the day's own year; the next business
days are found among the few days ahead that can hold them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderloom.functions.base import let

PROTEST_BUSINESS_DAYS = 3  # fixed value: 72 hours
RECORDS_RIPE_DAYS = 31     # fixed value
#: No run of idle days is longer: Thursday to Sunday.
LONGEST_REST = 4
HOLIDAYS_A_YEAR = 9


def _weekday(day: Column) -> Column:
    """Monday is 0."""
    return F.weekday(day)


def _observed(day: Column) -> Column:
    return F.when(_weekday(day) == 5, F.date_sub(day, 1)).when(_weekday(day) == 6, F.date_add(day, 1)).otherwise(day)


def is_holiday(day: Column) -> Column:
    """Whether `day` is an observed state holiday of its own year.

    New Year's Day falling on a Saturday is observed in the year before, whose
    own list does not hold it, so that 31 December stays a business day.
    """
    year, month, dom, wd = F.year(day), F.month(day), F.dayofmonth(day), _weekday(day)
    nth = F.floor((dom - 1) / 7) + 1
    fixed = F.lit(False)
    for m, d in ((1, 1), (7, 4), (11, 11), (12, 25)):  # fixed values
        fixed = fixed | (day == _observed(F.make_date(year, F.lit(m), F.lit(d))))
    last_of_may = (month == 5) & (wd == 0) & (dom > 24)
    day_after_thanksgiving = (month == 11) & (wd == 4) & (F.floor((dom - 2) / 7) + 1 == 4) & (dom > 1)
    return (fixed
            | ((month == 1) & (wd == 0) & (nth == 3))
            | last_of_may
            | ((month == 9) & (wd == 0) & (nth == 1))
            | ((month == 11) & (wd == 3) & (nth == 4))
            | day_after_thanksgiving)


def is_business_day(day: Column) -> Column:
    return (_weekday(day) < 5) & ~is_holiday(day)


def _nth(year: Column, month: int, weekday: int, nth: int) -> Column:
    """The nth such weekday of a month."""
    first = F.make_date(year, F.lit(month), F.lit(1))
    return F.date_add(first, F.pmod(F.lit(weekday) - _weekday(first), F.lit(7)) + 7 * (nth - 1))


def _holidays(year: Column) -> list[Column]:
    """The observed holidays of a year, all of them weekdays; New Year's Day is null when it is observed the year before."""
    new_year = F.make_date(year, F.lit(1), F.lit(1))
    fixed = [_observed(F.make_date(year, F.lit(m), F.lit(d))) for m, d in ((7, 4), (11, 11), (12, 25))]
    thanksgiving = _nth(year, 11, 3, 4)
    fifth = _nth(year, 5, 0, 5)
    return [F.when(_weekday(new_year) != 5, _observed(new_year)), *fixed, _nth(year, 1, 0, 3), F.when(F.month(fifth) == 5, fifth).otherwise(_nth(year, 5, 0, 4)),
            _nth(year, 9, 0, 1), thanksgiving, F.date_add(thanksgiving, 1)]


def _holidays_so_far(day: Column) -> Column:
    """Holidays of the day's year up to and with the day."""
    out = F.lit(0)
    for holiday in _holidays(F.year(day)):
        out = out + F.when(holiday <= day, 1).otherwise(0)
    return out


def _weekend_days(day: Column) -> Column:
    """Saturdays and Sundays through a day, counted from a Monday; meant for differences."""
    monday = F.unix_date(day) + 3  # the day numbered 0 is a Thursday
    return F.floor(monday / 7) * 2 + F.greatest(F.pmod(monday, F.lit(7)) - 4, F.lit(0))


def idle_days(after: Column, through: Column) -> Column:
    """Weekend days and holidays later than `after` and not later than `through`; 0 where there are no days between."""
    def between(a: Column, t: Column) -> Column:
        years = F.when(F.year(a) < F.year(t), F.sequence(F.year(a), F.year(t) - 1)).otherwise(F.array().cast("array<int>"))
        # a New Year's Day on Saturday is no holiday of either year
        short = F.size(F.filter(years, lambda y: _weekday(F.make_date(y, F.lit(1), F.lit(1))) == 5))
        holidays = HOLIDAYS_A_YEAR * F.size(years) - short + _holidays_so_far(t) - _holidays_so_far(a)
        return F.when(t > a, _weekend_days(t) - _weekend_days(a) + holidays).otherwise(F.lit(0))

    return let(after, lambda a: let(through, lambda t: between(a, t)))


def business_days_on(day: Column, days: int) -> Column:
    """The business day `days` business days after `day`; one that is none counts from the next."""
    # no rest is longer, and none comes after fewer than three business days
    ahead = days + LONGEST_REST * (1 + -(-days // 3))

    def among(d: Column, holidays: Column) -> Column:
        return F.get(F.filter(F.sequence(d, F.date_add(d, ahead)), lambda x: (_weekday(x) < 5) & ~F.array_contains(holidays, x)), F.lit(days))

    def of(d: Column) -> Column:
        both = F.array(*_holidays(F.year(d)), *[F.when(F.year(F.date_add(d, ahead)) > F.year(d), h) for h in _holidays(F.year(d) + 1)])
        return let(F.array_compact(both), lambda holidays: among(d, holidays))

    return let(day, of)


def _midnight_offset(ts: Column) -> Column:
    return ts - ts.cast("date").cast("timestamp_ntz")


def protest_deadline(df: DataFrame, posted: str, out: str, days: int = PROTEST_BUSINESS_DAYS) -> DataFrame:
    """Add the moment a protest is due: `days` business days on, same time of day.

    A posting on a non-business day starts from the next business day.
    """
    ts = F.col(posted).cast("timestamp_ntz")
    return df.withColumn(out, business_days_on(ts.cast("date"), days).cast("timestamp_ntz") + _midnight_offset(ts))


def business_hours_left(df: DataFrame, deadline: str, now: str, out: str) -> DataFrame:
    """Add hours from `now` to the deadline, less whole idle days strictly between.

    Negative once the deadline has passed.
    """
    present = F.lit(now).cast("timestamp_ntz")

    def hours(early: Column, late: Column) -> Column:
        seconds = (F.unix_micros(late.cast("timestamp")) - F.unix_micros(early.cast("timestamp"))) / F.lit(1_000_000)
        return seconds / 3600 - idle_days(early.cast("date"), F.date_sub(late.cast("date"), 1)) * 24

    # the deadline may itself be computed: it is named once, however often it is used
    left = let(F.col(deadline).cast("timestamp_ntz"), lambda at: F.when(at.isNotNull(), F.when(present >= at, -hours(at, present)).otherwise(hours(present, at))))
    return df.withColumn(out, left)


def records_ripe_on(opening: Column) -> Column:
    return F.date_add(opening.cast("date"), RECORDS_RIPE_DAYS)
