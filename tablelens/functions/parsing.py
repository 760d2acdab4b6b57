"""Readings of a text value: number, date, boolean, shape.

Everything here is a Spark SQL expression, so a value is read inside the same
generated code that scans or aggregates it.  Functions ending in ``_sql`` take
and return expression text; the others wrap it in a Column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.config.fixed_values import BOOLEAN_WORDS, DETECTOR_PATTERNS, MONTH_NAMES, SHAPE_PATTERNS
from tablelens.functions.text import as_text_sql, is_numeric, quoted, sql_list, sql_string

# Java's double parser also takes "1d" and "5f"; this guard does not.
_NUMBER = r"^[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity))$"

# A text is a date, or a date, a blank or T, and a time of the day.  How far the
# time goes (not at all, to the minute, to the second) belongs to the format.
_TIME = r"[0-9]{1,2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]{1,9})?)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?"
_DATED = rf"^([^:]+?)[ T]({_TIME})$"
TIME_KINDS = 3
_MONTH_NAME = "[A-Z][a-z]{2,8}"

# Ways to write a date: (name, cheap test, guard, year, month and day of the guard's groups, may a time follow).
# The cheap test spares most values the regular expression.
DATE_FORMATS = [
    ("year_dash", "char_length({d}) = 10 AND substr({d}, 5, 1) = '-'", "^([0-9]{4})-([0-9]{2})-([0-9]{2})$", "123", True),
    ("year_slash", "substr({d}, 5, 1) = '/'", "^([0-9]{4})/([0-9]{1,2})/([0-9]{1,2})$", "123", True),
    ("month_slash", "substr({d}, -5, 1) = '/'", "^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})$", "312", True),
    ("month_dash", "substr({d}, -5, 1) = '-'", "^([0-9]{1,2})-([0-9]{1,2})-([0-9]{4})$", "312", True),
    ("digits", "char_length({d}) = 8", "^([0-9]{4})([0-9]{2})([0-9]{2})$", "123", True),
    ("month_only", "char_length({d}) = 7", "^([0-9]{4})-([0-9]{2})$", "12", False),
    ("year_only", "char_length({d}) = 4", "^([0-9]{4})$", "1", False),
    ("day_dot", "substr({d}, -5, 1) = '.'", r"^([0-9]{1,2})\.([0-9]{1,2})\.([0-9]{4})$", "321", True),
    ("day_name", "substr({d}, -5, 1) IN (' ', '-')", f"^([0-9]{{1,2}})[ -]({_MONTH_NAME})[ -]([0-9]{{4}})$", "321", True),
    ("name_day", "substr({d}, -6, 1) = ','", f"^({_MONTH_NAME}) ([0-9]{{1,2}}), ([0-9]{{4}})$", "312", True),
    ("short_year", "substr({d}, -3, 1) = '/'", "^([0-9]{1,2})/([0-9]{1,2})/([0-9]{2})$", "312", True),
]
_NAMED_MONTH = {"day_name", "name_day"}
# Formats that do not tell whether the month or the day comes first: month first, unless only day first gives a date.
_OPEN_ORDER = ["month_slash", "month_dash", "short_year"]
# No date is shorter than a year; none is longer than the longest date, a blank and the longest time.
SHORTEST_DATE = 4
LONGEST_DATE = len("30 September 2024") + 1 + len("10:00:00.123456789+00:00")

# The same for the value shapes: a test every match passes.
_CHEAP_SHAPE_TESTS = {
    "YYYY-MM-DD": "substr({t}, 5, 1) = '-'",
    "ISO_DATETIME": "substr({t}, 11, 1) = 'T'",
    "MM/DD/YYYY": "substr({t}, 3, 1) = '/'",
    "DATE_SLASH": "contains({t}, '/')",
    "THREE_LETTER_CODE": "char_length({t}) <= 4",
    "TWO_LETTER_CODE": "char_length({t}) <= 3",
    "UUID": "char_length({t}) BETWEEN 36 AND 37",
    "EMAIL": "contains({t}, '@')",
    "PHONE": "char_length({t}) >= 8",
    "DECIMAL_2DP": "contains({t}, '.')",
}

PATTERN_LABELS = [label for label, _ in SHAPE_PATTERNS]
_DATE_BIT = len(SHAPE_PATTERNS)
# one bit per format and time kind, then one per open order and time kind for its day-first reading
_DAY_FIRST_BIT = _DATE_BIT + TIME_KINDS * len(DATE_FORMATS)
_BOOL_BIT = _DAY_FIRST_BIT + TIME_KINDS * len(_OPEN_ORDER)
FLAG_BITS = _BOOL_BIT + 1
PATTERN_BITS = slice(0, _DATE_BIT)
DATE_BITS = slice(_DATE_BIT, _BOOL_BIT)
BOOLEAN_BIT = _BOOL_BIT

# Shapes without an upper length.  No other shape, date or boolean is longer
# than a few dozen characters once trimmed.
_UNBOUNDED = {"ISO_DATETIME", "EMAIL", "PHONE", "DECIMAL_2DP", "INTEGER", "NUMERIC"}


def _trimmed(text: str) -> str:
    return rf"trim(BOTH ' \t\n\r\u000B\u000C' FROM {text})"


def number_sql(text: str) -> str:
    return f"CASE WHEN {_trimmed(text)} RLIKE {sql_string(_NUMBER)} THEN try_cast({_trimmed(text)} AS double) END"


def boolean_sql(text: str) -> str:
    return f"lower({_trimmed(text)}) IN {sql_list(BOOLEAN_WORDS)}"


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` (no column's name) bound to a value that is computed once.

    A higher-order function is not unrolled into generated code.  Together with
    the statements around it the date formats would make a method beyond the
    size the JVM compiles, which runs far slower than the lambda.
    """
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _iso_sql(name: str, guard: str, order: str, day_first: bool = False) -> str:
    """The date ``tl_parts.d`` as year-month-day."""
    year, month, day = (f"${order[i]}" if i < len(order) else "01" for i in range(3))
    if day_first:
        month, day = day, month
    groups = f"regexp_replace(tl_parts.d, {sql_string(guard)}, {sql_string(f'{year}-{month}-{day}')})"
    if name in _NAMED_MONTH:
        # the name stands between two dashes; three letters of a month or all of it, else there is no such month
        named = f"substring_index(substring_index({groups}, '-', 2), '-', -1)"
        number = (f"CASE WHEN char_length({named}) = 3 OR array_contains(array{sql_list(MONTH_NAMES)}, {named}) "
                  f"THEN array_position(transform(array{sql_list(MONTH_NAMES)}, tl_month -> left(tl_month, 3)), left({named}, 3)) ELSE 0 END")
        return f"concat(left({groups}, 5), {number}, '-', substring_index({groups}, '-', -1))"
    if name == "short_year":
        # the century of two-digit years turns at 69
        return f"concat(if(substr(tl_parts.d, -2) >= '69', '19', '20'), {groups})"
    return groups


def _dated(readings: list[tuple[int, str, str, str, bool]]) -> str:
    """The first of (bit, cheap test, guard, ISO form, ...) that ``tl_parts`` fits: struct of bit and ISO form."""
    branches = " ".join(
        f"WHEN {cheap.format(d='tl_parts.d')} AND tl_parts.d RLIKE {sql_string(guard)}{'' if timed else ' AND tl_parts.kind = 0'} "
        f"THEN named_struct('bit', {bit} + tl_parts.kind, 'iso', concat({iso}, tl_parts.time))"
        for bit, cheap, guard, iso, timed in readings
    )
    return f"CASE {branches} END"


_FIRST = _dated([(_DATE_BIT + TIME_KINDS * i, cheap, guard, _iso_sql(name, guard, order), timed)
                 for i, (name, cheap, guard, order, timed) in enumerate(DATE_FORMATS)])
_SECOND = _dated([(_DAY_FIRST_BIT + TIME_KINDS * _OPEN_ORDER.index(name), cheap, guard, _iso_sql(name, guard, order, day_first=True), timed)
                  for name, cheap, guard, order, timed in DATE_FORMATS if name in _OPEN_ORDER])


def _valid_sql(dated: str) -> str:
    """A reading that names a time a nanosecond timestamp can hold, with that time; else null."""
    kept = f"if(tl_ts IS NULL, NULL, named_struct('bit', {dated}.bit, 'ts', tl_ts))"
    return (f"CASE WHEN left({dated}.iso, 4) BETWEEN '1678' AND '2261' THEN "
            f"{_let(f'try_cast({dated}.iso AS timestamp)', 'tl_ts', kept)} END")


def dates_sql(text: str) -> str:
    """The readings of a text as a date: month first or order known, and day first where the order is open.

    A struct of ``first`` and ``second``, each null or a bit and a timestamp.
    """
    # a time without seconds gets them, since a zone may follow only after seconds
    timed = _let(
        f"regexp_extract({text}, {sql_string(_DATED)}, 2)", "tl_time",
        f"named_struct('d', regexp_extract({text}, {sql_string(_DATED)}, 1), 'time', concat('T', "
        "if(tl_time RLIKE '^[0-9]+:[0-9]+:', tl_time, regexp_replace(tl_time, '^([0-9]+:[0-9]+)', '$1:00'))), 'kind', if(tl_time RLIKE '^[0-9]+:[0-9]+:', 2, 1))")
    parts = f"CASE WHEN contains({text}, ':') THEN {timed} ELSE named_struct('d', {text}, 'time', '', 'kind', 0) END"
    first, second = _let(_FIRST, "tl_read", _valid_sql("tl_read")), _let(_SECOND, "tl_read", _valid_sql("tl_read"))
    read = _let(parts, "tl_parts", f"named_struct('first', {first}, 'second', {second})")
    # a date ends in a digit, or in the zone Z after one
    likely = f"char_length({text}) BETWEEN {SHORTEST_DATE} AND {LONGEST_DATE} AND {text} RLIKE '[0-9]Z?$'"
    return f"CASE WHEN {likely} THEN {read} END"


def timestamp_sql(text: str) -> str:
    """Month-first where the order is open, else day-first."""
    return _let(dates_sql(text), "tl_dates", "coalesce(tl_dates.first.ts, tl_dates.second.ts)")


def _bit(condition: str, i: int) -> str:
    return f"CASE WHEN {condition} THEN {1 << i}L ELSE 0L END"


def shape_sql(text: str, label: str, regex: str) -> str:
    cheap = _CHEAP_SHAPE_TESTS.get(label)
    match = f"{text} RLIKE {sql_string(regex)}"
    return f"{cheap.format(t=text)} AND {match}" if cheap else match


def _shape_bits(*labels: str) -> int:
    return sum(1 << PATTERN_LABELS.index(label) for label in labels)


def flags_sql(text: str) -> str:
    """One bit per shape pattern, per date reading, and for booleans."""
    bits = [_bit(shape_sql("tl_value", label, regex), i) for i, (label, regex) in enumerate(SHAPE_PATTERNS)]
    bits.append(_let(dates_sql("tl_value"), "tl_dates", "coalesce(shiftleft(1L, tl_dates.first.bit), 0L) + coalesce(shiftleft(1L, tl_dates.second.bit), 0L)"))
    bits.append(_bit(boolean_sql("tl_value"), _BOOL_BIT))
    return _let(text, "tl_value", f"aggregate(array({', '.join(bits)}), 0L, (tl_flags, tl_bit) -> tl_flags + tl_bit)")


def whole_flags_sql(whole: str, text: str) -> str:
    """``flags_sql`` of a bigint and its text: only those that may be a year or a day are read as a text."""
    return (f"CASE WHEN {whole} < 0 THEN {_shape_bits('NUMERIC')}L "
            f"WHEN {whole} BETWEEN 1678 AND 2261 OR {whole} BETWEEN 16780101 AND 22611231 THEN {flags_sql(text)} "
            f"WHEN {whole} <= 1 THEN {_shape_bits('INTEGER', 'NUMERIC') | 1 << _BOOL_BIT}L "
            f"WHEN {whole} < 10000000 THEN {_shape_bits('INTEGER', 'NUMERIC')}L ELSE {_shape_bits('PHONE', 'INTEGER', 'NUMERIC')}L END")


def real_flags_sql(text: str) -> str:
    """``flags_sql`` of the text of a double, which has one dot or is infinite: no date, no word."""
    return " + ".join(_bit(f"{text} RLIKE {sql_string(regex)}", i)
                      for i, (label, regex) in enumerate(SHAPE_PATTERNS) if label in ("DECIMAL_2DP", "NUMERIC"))


def long_flags_sql(text: str) -> str:
    """``flags_sql`` of a text too long for the bounded shapes."""
    bits = [_bit(shape_sql(text, label, regex), i)
            for i, (label, regex) in enumerate(SHAPE_PATTERNS) if label in _UNBOUNDED]
    bits.append(_bit(boolean_sql(text), _BOOL_BIT))
    return " + ".join(bits)


def number(text: str) -> Column:
    """A text expression as a double, null when it is not a number."""
    return F.expr(number_sql(text))


def timestamp(text: str) -> Column:
    """A text expression as a timestamp, null when no format reads it."""
    return F.expr(timestamp_sql(text))


def numeric_sql(df: DataFrame, name: str) -> str:
    """A column as double; native for numeric types, parsed for text."""
    dtype = df.schema[name].dataType
    column = quoted(name)
    if is_numeric(dtype):
        return f"nullif(double({column}), double('NaN'))"
    if isinstance(dtype, T.StringType):
        return number_sql(column)
    return "CAST(NULL AS double)"


def numeric_value(df: DataFrame, name: str) -> Column:
    return F.expr(numeric_sql(df, name))


def timestamp_value(df: DataFrame, name: str) -> Column:
    """A column as timestamp; native for temporal types, parsed for text, null for numbers."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.expr(f"CAST({quoted(name)} AS timestamp)")
    if is_numeric(dtype) or isinstance(dtype, T.BooleanType):
        return F.expr("CAST(NULL AS timestamp)")
    return timestamp(as_text_sql(df, name))


def starts_with_match(text: Column, pattern: str) -> Column:
    """Match anchored at the start of the text only."""
    return text.rlike(f"^(?:{pattern})")


def month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def detector_patterns() -> list[tuple[str, str]]:
    """The stand-alone detector's list: same labels, a looser ISO datetime."""
    return [(label, DETECTOR_PATTERNS.get(label, regex)) for label, regex in SHAPE_PATTERNS]
