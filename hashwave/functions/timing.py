"""Time buckets, time slices of a trend, and their labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Seconds per unit, the share of a trend's life at which each of its five slices
# starts, the slice colours, and the look of points newer than the recorded ones.
UNIT_SECONDS = {"sec": 1, "minute": 60, "hr": 3600, "day": 86400}
SLICE_STARTS = [0.0, 0.2, 0.4, 0.6, 0.8]
SLICE_COLOURS = ["#43C6DB", "#FF69B4", "#FBB917", "#C36241", "#4B0082"]
LIVE_COLOUR = "#000000"
LIVE_LABEL = "More Recent"
ICON_SUFFIX = ".gif"

LIVE_SLICE = len(SLICE_COLOURS) + 1


def timebucket(instant: Column, bucket: str) -> Column:
    """End of the tumbling interval holding the instant, in epoch seconds."""
    return F.unix_seconds(F.window(instant, bucket).getField("end"))


def day_of(bucket_end: Column) -> Column:
    """UTC day of a time bucket, the partition column of stored tables."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(bucket_end / 86400).cast("int"))


def _edges(span: str) -> list[str]:
    """Ends of the slices of a span, as SQL, the first slice's start in front."""
    return [f"{share}D * {span}" for share in SLICE_STARTS] + [span]


def time_slice(bucket: str, oldest: str, newest: str) -> Column:
    """Number (1-5) of the slice of [oldest, newest) holding the bucket, all three SQL operands.

    Slices are half-open, so the newest bucket itself lies in none and gives NULL.
    """
    edges = _edges(f"double({newest} - {oldest})")
    cases = [
        f"WHEN {bucket} >= {oldest} + {start} AND {bucket} < {oldest} + {end} THEN {number}"
        for number, (start, end) in enumerate(zip(edges, edges[1:]), 1)
    ]
    return F.expr(f"CASE {' '.join(cases)} END")


def slice_colour(number: str) -> Column:
    colours = ", ".join(f"'{colour}'" for colour in SLICE_COLOURS)
    return F.expr(f"get(array({colours}), {number} - 1)")


def _icon(colour: str) -> str:
    return f"concat(substring({colour}, 2), '{ICON_SUFFIX}')"


def colour_icon(colour: str) -> Column:
    """Icon file of a ``#RRGGBB`` colour."""
    return F.expr(_icon(colour))


def _pick(seconds: str, values: dict[str, object]) -> str:
    """SQL choosing a value by the largest unit the duration fills."""
    cases = [
        f"WHEN {seconds} >= {UNIT_SECONDS[unit]} THEN {values[unit]}"
        for unit in ("day", "hr", "minute")
    ]
    return f"CASE {' '.join(cases)} ELSE {values['sec']} END"


def _label(seconds: str, sizes: dict[str, int], names: dict[str, str]) -> str:
    size = _pick(seconds, sizes)
    name = _pick(seconds, {unit: f"' {text}'" for unit, text in names.items()})
    return f"concat(bigint(floor(floor({seconds}) / {size})), {name})"


_AUTO_NAMES = {"day": "day(s)", "hr": "hr(s)", "minute": "minute(s)", "sec": "sec"}


def _auto_label(seconds: str) -> str:
    return _label(seconds, UNIT_SECONDS, _AUTO_NAMES)


def _finer_label(seconds: str) -> str:
    """In the unit below the one the duration would read in; plain seconds have none below."""
    finer = {"day": "hr", "hr": "minute", "minute": "sec"}
    sizes = {unit: UNIT_SECONDS[finer.get(unit, unit)] for unit in UNIT_SECONDS}
    names = {unit: f"{below}(s)" for unit, below in finer.items()} | {"sec": "sec"}
    return _label(seconds, sizes, names)


def humanize_seconds(seconds: str, unit: str | None = None) -> Column:
    """A duration (an SQL operand) in whole units: the named one, or the largest it fills."""
    if unit is None:
        return F.expr(_auto_label(seconds))
    size = UNIT_SECONDS[unit]
    return F.expr(f"concat(bigint(floor(floor({seconds}) / {size})), ' {unit}(s)')")


def legend_steps(ranges: DataFrame) -> tuple[DataFrame, Column]:
    """Ranges (oldest, newest) with helper columns, and the array of their six legend rows.

    Everything is made within the row. A slice whose two ends read the same takes its end in the next finer unit, and its start from
    the end of the closest earlier slice treated like that, if there is one.
    """
    numbers = range(1, len(SLICE_COLOURS) + 1)
    edges = _edges("_span")
    spans = ranges.withColumn("_span", F.expr("double(newest - oldest)"))
    spans = spans.withColumns({f"_edge{i}": F.expr(edge) for i, edge in enumerate(edges)})
    labels = {f"_auto{i}": F.expr(_auto_label(f"_edge{i}")) for i in range(len(edges))}
    finer = {f"_finer{i}": F.expr(_finer_label(f"_edge{i}")) for i in numbers}
    labelled = spans.withColumns(labels | finer)

    def clash(i: int) -> str:
        return f"_auto{i - 1} = _auto{i}"

    ends = {
        f"_end{i}": F.expr(f"CASE WHEN {clash(i)} THEN _finer{i} ELSE _auto{i} END")
        for i in numbers
    }
    starts = {}
    for i in numbers:
        earlier = "".join(f"WHEN {clash(j)} THEN _finer{j} " for j in range(i - 1, 0, -1))
        starts[f"_start{i}"] = F.expr(
            f"CASE WHEN NOT {clash(i)} THEN _auto{i - 1} {earlier}ELSE _auto{i - 1} END"
        )
    rows = [
        _legend_row(f"{i}", f"_start{i}", f"_end{i}", f"concat(_start{i}, ' - ', _end{i})", colour)
        for i, colour in zip(numbers, SLICE_COLOURS)
    ]
    none = "CAST(NULL AS string)"
    rows.append(_legend_row(f"{LIVE_SLICE}", none, none, f"'{LIVE_LABEL}'", LIVE_COLOUR))
    return labelled.withColumns(starts | ends), F.expr(f"array({', '.join(rows)})")


def _legend_row(number: str, start: str, end: str, name: str, colour: str) -> str:
    return f"""struct({number} AS slice, {start} AS start_label, {end} AS end_label, {name} AS name,
                      '{colour}' AS colour, {_icon(f"'{colour}'")} AS icon)"""
