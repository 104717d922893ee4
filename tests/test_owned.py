"""Who owns which week or day, against plain Python, whatever the size of the input."""

import contextlib
import datetime as dt
import io
import random

import pytest
from pyspark.sql import functions as F

from spanworks.operators import teams, weeks

AS_OF = "2015-06-01"
SCHEMA = "k string, s date, e date, id long, note string, worth double"


def _spans(n: int) -> list[tuple]:
    """Spans over more than 3,600 days, some open, some empty, many of one start, some of no key."""
    pick = random.Random(7)
    rows = []
    for i in range(n):
        start = dt.date(2000, 1, 1) + dt.timedelta(pick.choice([0, 0, 61, 366, pick.randrange(5000)]))
        days = pick.choice([0, 1, 6, 59, 60, 61, 420, 421, 2000, 5000])
        end = None if pick.random() < 0.1 else start + dt.timedelta(days)
        rows.append((pick.choice(["a", "b", "c", None]), start, end, i, pick.choice(["x", None]), pick.choice([1.5, None])))
    return rows


def _holders(rows: list[tuple], days: int) -> dict:
    """The id that holds each unit of each key, by listing the units."""
    held = {}
    for k, s, e, i, *_ in sorted(rows, key=lambda r: (r[1], r[3])):
        day, stop = s, min(e or dt.date.max, dt.date.fromisoformat(AS_OF))
        while day < stop:
            held[k, day if days == 1 else day - dt.timedelta(day.weekday())] = i
            day += dt.timedelta(1)
    return held


@pytest.mark.parametrize("pieces", [None, 1, 5])
@pytest.mark.parametrize("days", [1, 7])
def test_ranges_hold_what_listing_gives(spark, days, pieces):
    rows = _spans(300)
    make, first, last = (weeks.day_ranges, "start_day", "end_day") if days == 1 else (weeks.week_ranges, "start_week", "end_week")
    got = make(spark.createDataFrame(rows, SCHEMA), ["k"], "s", "e", "id", AS_OF, pieces).collect()
    found = {}
    for r in got:
        day = r[first]
        while day <= r[last]:
            assert (r.k, day) not in found
            found[r.k, day] = r.id
            day += dt.timedelta(days)
    assert found == _holders(rows, days)
    ends = {(r.k, r.id, r[last]) for r in got}
    assert not any((r.k, r.id, r[first] - dt.timedelta(days)) in ends for r in got)  # as long as can be
    if days == 7:
        for r in got:
            assert r.last_week == max(x.end_week for x in got if (x.k, x.id) == (r.k, r.id))
            assert r.since_week == min(x.start_week for x in got if x.k == r.k)


def _plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.mark.parametrize("pieces", [1, 5])
def test_ranges_list_no_unit(spark, pieces):
    """A span that outlasts the next one is not listed unit by unit before it moves."""
    df = spark.createDataFrame(_spans(10), SCHEMA)
    for make in (weeks.day_ranges, weeks.week_ranges):
        plan = _plan(make(df, ["k"], "s", "e", "id", AS_OF, pieces))
        assert "_contested" not in plan and "INTERVAL" not in plan.upper()


def test_weekly_rows_move_as_bits(spark, monkeypatch):
    rows = _spans(300)
    df = spark.createDataFrame(rows, SCHEMA)
    weekly = weeks.weekly_episodes(df, "s", "e", AS_OF)
    plain = sorted(map(tuple, weeks.weekly_unique(weekly, ["k"], "s", "id").collect()), key=str)
    monkeypatch.setattr(weeks, "SPAN_BYTES", 1)
    monkeypatch.setattr(weeks, "MOST_PIECES", 4)
    unique = weeks.weekly_unique(weekly, ["k"], "s", "id")
    assert unique.columns == weekly.columns
    assert {(r.k, r.week_start): r.id for r in unique.collect()} == _holders(rows, 7)
    assert sorted(map(tuple, unique.collect()), key=str) == plain
    # every shuffle is of masks: the weeks are listed after the last one
    plan = _plan(weeks.start_stop(unique, ["k"], ["note"]))
    last = plan.index("Exchange")
    assert plan.index("explode(filter") < last and "_mask" in plan[last:]
    # weeks that begin on any day, and none, are weeks of their own
    odd = spark.createDataFrame(
        [("a", 1, 5, dt.date(2020, 1, 7)), ("a", 2, 6, dt.date(2020, 1, 6)), ("a", 3, 7, None), ("a", 2, 8, None), ("b", 1, 9, dt.date(1960, 5, 4))],
        "k string, s int, id int, week_start date")
    got = {tuple(r) for r in weeks.weekly_unique(odd, ["k"], "s", "id").collect()}
    assert got == {tuple(r) for r in odd.filter("id <> 8").collect()}
