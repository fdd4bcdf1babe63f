"""Calendar columns of a date: Gregorian, ISO, fiscal, 4-4-5."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def date_spine(spark: SparkSession, start: str, end: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("Date"))


def day(text: str) -> Column:
    return F.lit(text).cast("date")


def previous(date: Column, months: int) -> Column:
    """The same day so many months before; a month's last day goes to a month's last day."""
    before = F.add_months(date, -months)
    return F.when(date == F.last_day(date), F.last_day(before)).otherwise(before)


def gregorian(df: DataFrame, as_of: str, date: str = "Date") -> DataFrame:
    """Keys, names, bounds, Sunday-based weeks, flags and offsets from a given day. DayOfWeek is 0 on Sunday."""
    d, today = F.col(date), day(as_of)
    dow = F.dayofweek(d) - 1
    jan1 = F.dayofweek(F.trunc(d, "year")) - 1
    index = F.year(d) * 12 + F.month(d)
    return df.withColumns({
        "DateKey": (F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)), "Serial": F.datediff(d, day("1899-12-30")),
        "Year": F.year(d), "Quarter": F.quarter(d), "Month": F.month(d), "Day": F.dayofmonth(d), "DayOfYear": F.dayofyear(d), "DayOfWeek": dow,
        "MonthName": F.date_format(d, "MMMM"), "DayName": F.date_format(d, "EEEE"),
        "MonthStart": F.trunc(d, "month"), "MonthEnd": F.last_day(d), "QuarterStart": F.trunc(d, "quarter"), "YearStart": F.trunc(d, "year"),
        "DaysInMonth": F.dayofmonth(F.last_day(d)), "WeekStart": F.date_sub(d, dow), "WeekEnd": F.date_add(d, 6 - dow),
        "CalendarWeek": ((F.dayofyear(d) + jan1 - 1) / 7).cast("int") + 1, "MonthIndex": index,
        "IsWeekend": dow.isin(0, 6), "IsMonthEnd": d == F.last_day(d), "IsMonthStart": F.dayofmonth(d) == 1,
        "DayOffset": F.datediff(d, today), "MonthOffset": index - (F.year(today) * 12 + F.month(today)), "YearOffset": F.year(d) - F.year(today),
        "PreviousWeek": F.date_sub(d, 7), "PreviousMonth": previous(d, 1), "PreviousQuarter": previous(d, 3), "PreviousYear": previous(d, 12),
    })


def iso(df: DataFrame, as_of: str, date: str = "Date") -> DataFrame:
    """ISO week and year, Monday to Sunday, weeks from a given day's."""
    d = F.col(date)
    monday = F.trunc(d, "week")
    return df.withColumns({"IsoWeek": F.weekofyear(d), "IsoYear": F.extract(F.lit("YEAROFWEEK"), d).cast("int"), "IsoStart": monday, "IsoEnd": F.date_add(monday, 6), "IsoOffset": (F.datediff(monday, F.trunc(day(as_of), "week")) / 7).cast("int")})


def fiscal(df: DataFrame, start_month: int, as_of: str, date: str = "Date") -> DataFrame:
    """Fiscal year by months, named by its end year unless it begins in January."""
    d = F.col(date)

    def parts(c: Column) -> tuple[Column, Column]:
        shift = (F.month(c) >= start_month).cast("int")
        return F.year(c) + (shift - 1 if start_month > 1 else 0), F.pmod(F.month(c) - start_month, F.lit(12)) + 1

    start_year, month = parts(d)
    label = start_year + (1 if start_month > 1 else 0)
    today_year, today_month = parts(day(as_of))
    begin = F.make_date(start_year, F.lit(start_month), F.lit(1))
    quarter = ((month - 1) / 3).cast("int") + 1
    return df.withColumns({"FiscalYear": label, "FiscalMonth": month, "FiscalQuarter": quarter, "FiscalYearStart": begin, "FiscalYearEnd": F.date_sub(F.add_months(begin, 12), 1), "FiscalQuarterStart": F.add_months(begin, (quarter - 1) * 3), "FiscalLabel": F.concat(F.lit("FY"), label.cast("string"), F.lit(" Q"), quarter.cast("string")), "FiscalMonthOffset": start_year * 12 + month - (today_year * 12 + today_month)})


def fiscal_year_start(year: Column, start_month: int, first_weekday: int, nearest: bool) -> Column:
    """The first day of a week-based fiscal year: the last such weekday on or before the month's first day, or the nearest. Weekdays are 0 on Sunday."""
    first = F.make_date(year, F.lit(start_month), F.lit(1))
    back = F.pmod(F.dayofweek(first) - 1 - first_weekday, F.lit(7))
    last = F.date_sub(first, back)
    return F.when(back > 3, F.date_add(last, 7)).otherwise(last) if nearest else last


def weekly_fiscal(df: DataFrame, start_month: int = 2, first_weekday: int = 0, pattern: tuple[int, int, int] = (4, 4, 5), nearest: bool = True, date: str = "Date") -> DataFrame:
    """A 4-4-5 (4-5-4, 5-4-4) calendar. Years have 52 or 53 weeks; a 53rd week belongs to the last period."""
    d = F.col(date)
    guess = F.year(d)
    starts = [fiscal_year_start(guess + k, start_month, first_weekday, nearest) for k in (-1, 0, 1)]
    start = F.when(d >= starts[2], starts[2]).when(d >= starts[1], starts[1]).otherwise(starts[0])
    year = F.when(d >= starts[2], guess + 1).when(d >= starts[1], guess).otherwise(guess - 1)
    week = (F.datediff(d, start) / 7).cast("int") + 1
    quarter = F.least(((week - 1) / 13).cast("int") + 1, F.lit(4))
    in_quarter = week - (quarter - 1) * 13
    period = (quarter - 1) * 3 + F.when(in_quarter <= pattern[0], 1).when(in_quarter <= pattern[0] + pattern[1], 2).otherwise(3)
    return df.withColumns({"FwYear": year + (1 if start_month > 1 else 0), "FwWeek": week, "FwQuarter": quarter, "FwPeriod": period, "FwYearStart": start, "FwWeekStart": F.date_add(start, (week - 1) * 7)})


def week_label(start: Column, end: Column) -> Column:
    return F.concat(F.date_format(start, "MMM dd"), F.lit(" - "), F.date_format(end, "MMM dd, yyyy"))


def time_of_day(spark: SparkSession) -> DataFrame:
    """1,440 minutes with hours, halves of the day, periods and bins."""
    m = F.col("id").cast("int")
    hour = (m / 60).cast("int")
    bin_start = lambda n: (m - m % n)
    clock = lambda c: F.concat(F.lpad((c / 60).cast("int").cast("string"), 2, "0"), F.lit(":"), F.lpad((c % 60).cast("string"), 2, "0"))
    return spark.range(1440).select(m.alias("TimeKey"), hour.alias("Hour"), (m % 60).alias("Minute"), F.when(hour % 12 == 0, 12).otherwise(hour % 12).alias("Hour12"), F.when(hour < 12, "AM").otherwise("PM").alias("Half"), F.when(hour < 6, "Night").when(hour < 12, "Morning").when(hour < 18, "Afternoon").otherwise("Evening").alias("Period"), clock(m).alias("Clock"), clock(bin_start(15)).alias("Bin15"), clock(bin_start(60)).alias("Bin60"), clock(bin_start(360)).alias("Bin360"))


def next_prev_business_day(df: DataFrame, date: str = "Date") -> DataFrame:
    """The nearest weekdays strictly after and before each day, by arithmetic."""
    d, dow = F.col(date), F.dayofweek(date) - 1
    after = F.when(dow == 5, 3).when(dow == 6, 2).otherwise(1)
    before = F.when(dow == 1, 3).when(dow == 0, 2).otherwise(1)
    return df.withColumns({"NextBusinessDay": F.date_add(d, after), "PreviousBusinessDay": F.date_sub(d, before)})


def date_columns(include: dict[str, bool], groups: dict[str, list[str]]) -> list[str]:
    """The columns of the groups that are asked for, in order, once each."""
    return list(dict.fromkeys(c for name, columns in groups.items() if include.get(name, False) for c in columns))
