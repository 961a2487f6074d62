"""Due dates and ages; every judgement takes its day explicitly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from girderlake.functions.text import first_of

#: Days before its date from which an inspection counts as due soon.
SOON_DAYS = 180


def due_on(inspected_on: Column, cycle_months: Column) -> Column:
    """The inspection's date and its cycle, cut to the month's last day."""
    return F.add_months(inspected_on, cycle_months.cast("int"))


def due_status(due: Column, as_of: Column) -> Column:
    """D3: OVERDUE, DUE_SOON, CURRENT, or UNKNOWN without a due date."""
    return first_of((due.isNull(), "UNKNOWN"), (due < as_of, "OVERDUE"), (due <= F.date_add(as_of, SOON_DAYS), "DUE_SOON")).otherwise("CURRENT")


def completed_years(since: Column, until: Column) -> Column:
    """Birthdays between two dates, 0 at least."""
    early = (F.month(until) * 100 + F.dayofmonth(until)) < (F.month(since) * 100 + F.dayofmonth(since))
    return F.greatest(F.year(until) - F.year(since) - early.cast("int"), F.lit(0))
