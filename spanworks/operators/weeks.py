"""Validity spans to weekly rows and to start-stop episodes.

A span is half-open ``[start, end)``; a null end means it is still running and is
read as ``as_of`` (exclusive). Weeks are ISO weeks, starting on Monday. When two
spans of an entity touch the same week, the one that starts later owns it. A gap
of at least one week always starts a new episode.

After reduction to weeks an entity has at most one row per calendar week, so the
windows below run on groups bounded by the calendar, however many spans there are.

Which span owns which unit (week or day) is settled without listing units: those of a span are
bits, ``BLOCK`` to a block, and the blocks that it fills are bits of blocks of blocks. A block
belongs to its spans in their order: what earlier ones have taken is masked out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanworks.functions.dates import iso_week, week_start
from spanworks.operators.ordered import MOST_PIECES, PIECE_BYTES, latest_per_key, next_value
from spanworks.workdir import UNKNOWN_BYTES, estimated_bytes, materialize

#: Units of a block, so that their bits stay within a positive long; the units are counted from a Monday.
BLOCK, _MONDAY = 60, "1970-01-05"
#: Bytes of the spans of a partition, by Spark's estimate, where spans become weeks: some fifty thousand spans.
SPAN_BYTES = 1 << 20


def spans_from_events(
    df: DataFrame, entity: Sequence[str], start: str, tie: str, end: str = "end_date", pieces: int | None = None,
) -> DataFrame:
    """Each row is valid until the next row of the entity; the last one stays open."""
    return next_value(df, entity, [start, tie], start, end, pieces, spread=True)


def _clip(spans: DataFrame, start: str, end: str, as_of: str) -> DataFrame:
    """Dates, open ends at ``as_of``; empty spans and spans after ``as_of`` are gone."""
    last = F.least(F.to_date(F.col(end)), F.to_date(F.lit(as_of)))
    dated = spans.withColumns({"_from": F.to_date(F.col(start)), "_to": last})
    return dated.filter(F.col("_from") < F.col("_to"))


def _weeks(first, last):
    return F.explode(F.sequence(first, last, F.expr("interval 7 days")))


def weekly_episodes(spans: DataFrame, start: str, end: str, as_of: str) -> DataFrame:
    """One row per span and ISO week it touches; adds ``week_start`` and ``iso_week``."""
    clipped = _clip(spans, start, end, as_of)
    first = week_start(F.col("_from"))
    last = week_start(F.date_sub(F.col("_to"), 1))
    weekly = clipped.withColumn("week_start", _weeks(first, last)).drop("_from", "_to")
    return weekly.withColumn("iso_week", iso_week(F.col("week_start")))


def _shifted(mask: Column, by: Column) -> Column:
    return F.call_function("shiftleft", mask, by)


def _has(mask: Column, place: Column) -> Column:
    return F.call_function("shiftright", mask, place).bitwiseAND(F.lit(1).cast("long")) == 1


def _stretch(first: Column, last: Column) -> Column:
    """The mask of the places ``first`` .. ``last`` of a block."""
    return _shifted(_shifted(F.lit(1).cast("long"), last - first + 1) - 1, first)


def _places(mask: Column) -> Column:
    """The places of a mask that are set."""
    return F.filter(F.sequence(F.lit(0), F.lit(BLOCK - 1)), lambda b: _has(mask, b))


def _runs(mask: Column) -> Column:
    """The runs of set places of a mask that is not 0, as an array of ``first`` and ``last``."""
    def run(first: Column) -> Column:
        rest = F.call_function("shiftright", mask, first)
        return F.struct(first.alias("first"), (first + F.bit_count(rest.bitwiseXOR(rest + 1)) - 2).alias("last"))

    begins = mask.bitwiseAND(F.bitwise_not(_shifted(mask, F.lit(1))))
    lowest = F.bit_count(mask.bitwiseXOR(mask - 1)) - 1
    return F.when(F.bit_count(begins) == 1, F.array(run(lowest))).otherwise(F.transform(_places(begins), run))


def _left_over(rows: DataFrame, block: Sequence[str], newest_first: Sequence[Column]) -> DataFrame:
    """Rows with what is left of ``_mask`` by the rows before them in their block; those left with nothing are gone."""
    before = W.partitionBy(*block).orderBy(*newest_first).rowsBetween(W.unboundedPreceding, -1)
    taken = F.coalesce(F.bit_or("_mask").over(before), F.lit(0).cast("long"))
    return rows.withColumn("_mask", F.col("_mask").bitwiseAND(F.bitwise_not(taken))).filter("_mask <> 0")


def _partitions(df: DataFrame, size: int) -> int:
    """Partitions for rows that will be multiplied: as many as asked for, more if they would be large."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_PIECES, size // SPAN_BYTES))


def weekly_unique(weekly: DataFrame, entity: Sequence[str], start: str, tie: str) -> DataFrame:
    """One row per entity and week: the span that starts last, then the larger ``tie``.

    Beyond ``SPAN_BYTES`` weekly rows do not move: those that differ in nothing but the week (and
    ``iso_week``, its label) become the bits of blocks of weeks first, and are listed again where
    all that is left of their entity is. Before that, of equal bits of a block only the winner moves.
    """
    size = estimated_bytes(weekly)
    newest_first = [F.desc(start), F.desc(tie)]
    if size <= SPAN_BYTES or dict(weekly.dtypes)["week_start"] != "date":
        return latest_per_key(weekly, [*entity, "week_start"], newest_first)
    days = F.datediff("week_start", F.lit(_MONDAY).cast("date"))
    block = F.floor(days / (7 * BLOCK)).cast("int")
    place = F.coalesce(F.floor(days / 7).cast("int") - block * BLOCK, F.lit(0))
    own = [F.col(f"`{c}`") for c in weekly.columns if c not in ("week_start", "iso_week")]
    masks = weekly.groupBy(*own, F.pmod(days, F.lit(7)).alias("_day"), block.alias("_block")).agg(
        F.bit_or(_shifted(F.lit(1).cast("long"), place)).alias("_mask"))
    in_block = [*entity, "_day", "_block"]
    fewer = latest_per_key(masks, [*in_block, "_mask"], newest_first).repartition(_partitions(weekly, size), *entity)
    listed = _left_over(fewer, in_block, newest_first).withColumn("_place", F.explode(_places(F.col("_mask"))))
    listed = listed.withColumn("week_start", F.date_add(
        F.lit(_MONDAY).cast("date"), (F.col("_block") * BLOCK + F.col("_place")) * 7 + F.col("_day")))
    return listed.withColumn("iso_week", iso_week(F.col("week_start"))).select(*[F.col(f"`{c}`") for c in weekly.columns])


def weekly_owned(
    spans: DataFrame, entity: Sequence[str], start: str, end: str, tie: str, as_of: str, pieces: int | None = None,
) -> DataFrame:
    """``weekly_unique`` of ``weekly_episodes``, by way of the ranges that each span owns."""
    return expand_weeks(week_ranges(spans, entity, start, end, tie, as_of, pieces).drop("since_week", "last_week"))


def week_ranges(
    spans: DataFrame, entity: Sequence[str], start: str, end: str, tie: str, as_of: str, pieces: int | None = None,
) -> DataFrame:
    """The weeks each span owns, as ``start_week`` .. ``end_week``, without listing any.

    Equal to ``weekly_episodes`` + ``weekly_unique``, for overlapping spans too, but moves a
    few rows per span instead of one per week. Adds ``since_week``, the first week of the entity,
    and ``last_week``, the last week that the span owns, as a span may own several ranges.

    The spans of an entity meet in one partition. If there are more than one piece holds by Spark's
    estimate (or ``pieces`` is above 1), only the winner of equal bits of a block goes there, so
    that an entity sends as many rows as the calendar allows, however many spans it has.
    """
    clipped = _clip(spans, start, end, as_of)
    first, last = week_start(F.col("_from")), week_start(F.date_sub(F.col("_to"), 1))
    return _owned(clipped, first, last, 7, entity, tie, pieces)


def day_ranges(
    spans: DataFrame, entity: Sequence[str], start: str, end: str, tie: str, as_of: str, pieces: int | None = None,
) -> DataFrame:
    """The days each span owns, as ``start_day`` .. ``end_day``: a day belongs to the span that starts last, then to the larger ``tie``."""
    clipped = _clip(spans, start, end, as_of)
    owned = _owned(clipped, F.col("_from"), F.date_sub(F.col("_to"), 1), 1, entity, tie, pieces)
    return owned.drop("since_week", "last_week").withColumnsRenamed({"start_week": "start_day", "end_week": "end_day"})


def _owned(
    clipped: DataFrame, first: Column, last: Column, days: int, entity: Sequence[str], tie: str, pieces: int | None,
) -> DataFrame:
    """The units of ``days`` days that each span owns; ``first`` and ``last`` are the units it touches."""
    size = estimated_bytes(clipped)
    if size >= UNKNOWN_BYTES:
        clipped = materialize(clipped, "clipped")
        size = estimated_bytes(clipped)
    large = size > PIECE_BYTES if pieces is None else pieces > 1
    monday, newest_first = F.lit(_MONDAY).cast("date"), [F.desc("_from"), F.desc(tie)]
    spans = clipped.withColumns(
        {"_low": (F.datediff(first, monday) / days).cast("int"), "_high": (F.datediff(last, monday) / days).cast("int")}).drop("_to")
    if not large:
        spans = spans.repartition(_partitions(clipped, size), *entity)

    def within(unit: Column) -> Column:
        return F.floor(unit / BLOCK).cast("int")

    def piece(level: int, block: Column, mask: Column) -> Column:
        return F.struct(F.lit(level).alias("level"), block.alias("block"), mask.alias("mask"))

    def filled(outer: Column) -> Column:
        at = outer * BLOCK
        return piece(1, outer, _stretch(F.greatest(begin + 1 - at, F.lit(0)), F.least(stop - 1 - at, F.lit(BLOCK - 1))))

    low, high = F.col("_low"), F.col("_high")
    begin, stop = within(low), within(high)
    one = F.array(piece(0, begin, _stretch(low - begin * BLOCK, high - begin * BLOCK)))
    two = F.array(
        piece(0, begin, _stretch(low - begin * BLOCK, F.lit(BLOCK - 1))), piece(0, stop, _stretch(F.lit(0), high - stop * BLOCK)))
    between = F.transform(F.sequence(within(begin + 1), within(stop - 1)), filled)
    cut = F.when(begin == stop, one).when(begin + 1 == stop, two).otherwise(F.concat(two, between))
    bits = spans.withColumn("_piece", F.explode(cut)).withColumns(
        {"_level": F.col("_piece.level"), "_block": F.col("_piece.block"), "_mask": F.col("_piece.mask")}).drop("_piece", "_low", "_high")
    if large:
        bits = latest_per_key(bits, [*entity, "_level", "_block", "_mask"], newest_first).repartition(
            _partitions(clipped, size), *entity)
    bits = _left_over(bits, [*entity, "_level", "_block"], newest_first)
    # the owner of a filled block meets the spans that begin or end in the block
    opened = F.when(F.col("_level") == 0, F.array(F.struct(F.col("_block").alias("block"), F.col("_mask").alias("mask")))).otherwise(
        F.transform(_places(F.col("_mask")), lambda b: F.struct(
            (F.col("_block") * BLOCK + b).alias("block"), F.lit((1 << BLOCK) - 1).cast("long").alias("mask"))))
    bits = bits.withColumn("_piece", F.explode(opened)).withColumns(
        {"_block": F.col("_piece.block"), "_mask": F.col("_piece.mask")}).drop("_piece", "_level")
    bits = _left_over(bits, [*entity, "_block"], newest_first)

    def date(place: Column) -> Column:
        return F.date_add(monday, (F.col("_block") * BLOCK + place) * days)

    # from here on an entity has at most one row per unit of the calendar
    owned = bits.withColumn("_piece", F.explode(_runs(F.col("_mask")))).withColumns(
        {"start_week": date(F.col("_piece.first")), "end_week": date(F.col("_piece.last"))}).drop("_piece", "_block", "_mask")
    by_span = W.partitionBy(*entity, "_from", tie)
    ordered = by_span.orderBy("start_week")
    touching = F.col("start_week") == F.date_add(F.lag("end_week").over(ordered), days)
    numbered = owned.withColumn("_new", (~F.coalesce(touching, F.lit(False))).cast("int")).withColumn(
        "_run", F.sum("_new").over(ordered.rowsBetween(W.unboundedPreceding, W.currentRow)))
    by_run = W.partitionBy(*entity, "_from", tie, "_run")
    return numbered.withColumns(
        {
            "end_week": F.max("end_week").over(by_run),
            "last_week": F.max("end_week").over(by_span),
            "since_week": F.min("start_week").over(W.partitionBy(*entity)),
        }
    ).filter("_new = 1").drop("_from", "_new", "_run")


def expand_weeks(ranges: DataFrame) -> DataFrame:
    """Week ranges as one row per week."""
    weeks = ranges.withColumn("week_start", _weeks(F.col("start_week"), F.col("end_week")))
    return weeks.drop("start_week", "end_week").withColumn("iso_week", iso_week(F.col("week_start")))


def merge_ranges(
    ranges: DataFrame, entity: Sequence[str], covariates: Sequence[str],
    term: str | None = None, span: str | None = None,
) -> DataFrame:
    """Join touching week ranges of an entity while no covariate changes.

    With ``term`` and ``span``, a span whose ``term`` is not null ends in a termination and
    never merges with the next span, whatever the covariates.
    """
    w = W.partitionBy(*entity).orderBy("start_week")
    values = F.struct(*covariates)
    same = F.lag(values).over(w).eqNullSafe(values)
    if term and span:
        same = same & (F.lag(term).over(w).isNull() | (F.lag(span).over(w) == F.col(span)))
    touching = F.col("start_week") == F.date_add(F.lag("end_week").over(w), 7)
    marked = ranges.withColumn("_new", (~F.coalesce(same & touching, F.lit(False))).cast("int"))
    numbered = marked.withColumn(
        "_island", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    )
    merged = numbered.groupBy(*entity, "_island", *covariates).agg(
        F.min("start_week").alias("_first"), F.max("end_week").alias("_last")
    )
    return merged.select(
        *entity,
        iso_week(F.col("_first")).alias("start_week"),
        iso_week(F.col("_last")).alias("end_week"),
        F.col("_first").alias("start_date"),
        F.col("_last").alias("end_week_date"),
        *covariates,
    )


def start_stop(
    weekly: DataFrame, entity: Sequence[str], covariates: Sequence[str], term: str | None = None, span: str | None = None,
) -> DataFrame:
    """Weekly rows (one per entity and week) to periods in which no covariate changes."""
    ranges = weekly.withColumns(
        {"start_week": F.col("week_start"), "end_week": F.col("week_start")}
    )
    return merge_ranges(ranges, entity, covariates, term, span)


def start_stop_from_spans(
    spans: DataFrame, entity: Sequence[str], start: str, end: str, tie: str, as_of: str,
    covariates: Sequence[str], term: str | None = None, pieces: int | None = None,
) -> DataFrame:
    """Start-stop rows straight from spans, overlapping or not; same result as the weekly way."""
    ranges = week_ranges(spans, entity, start, end, tie, as_of, pieces)
    return merge_ranges(ranges, entity, covariates, term, tie)


def calendar(df: DataFrame, date: str) -> DataFrame:
    """Every day between the first and last date of ``df``, with week and quarter."""
    day = F.to_date(F.col(date))
    bounds = df.agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
    days = bounds.filter("lo IS NOT NULL").select(
        F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("day")
    )
    return days.select(
        "day",
        iso_week(F.col("day")).alias("iso_week"),
        week_start(F.col("day")).alias("week_start"),
        F.quarter("day").alias("quarter"),
        F.year("day").alias("year"),
    )


def survival_summary(
    episodes: DataFrame, entity: Sequence[str], term_type: str = "term_type"
) -> DataFrame:
    """Per entity: weeks at risk and whether (and how) the last episode ended in a termination."""
    weeks = (F.datediff("end_week_date", "start_date") / 7 + 1).cast("long")
    per_entity = episodes.groupBy(*entity).agg(
        F.min("start_date").alias("first_week"),
        F.max("end_week_date").alias("last_week"),
        F.sum(weeks).alias("weeks_at_risk"),
        F.max_by(term_type, "end_week_date").alias("type"),
    )
    return per_entity.withColumn("event", F.col("type").isNotNull().cast("int"))
