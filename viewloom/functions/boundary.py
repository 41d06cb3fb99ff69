"""lowBoundary() and highBoundary(): the least and the greatest value that a value of limited precision stands for."""

from __future__ import annotations


def decimal_value(t: str, high: bool) -> str:
    """Half a unit of the last digit below or above, as DECIMAL(38,18)."""
    digits = f"greatest(0, length(regexp_extract({t}, '[.]([0-9]*)', 1)))"
    half = f"CAST(concat('0.', repeat('0', {digits}), '5') AS DECIMAL(38,18))"
    return f"try_cast({t} AS DECIMAL(38,18)) {'+' if high else '-'} {half}"


def number_text(d: str) -> str:
    """A decimal as text, without zeros at the end of its fraction."""
    return f"regexp_replace(regexp_replace(CAST({d} AS STRING), '([.][0-9]*?)0+$', '$1'), '[.]$', '')"


def date(t: str, high: bool) -> str:
    year = f"concat({t}, '-12-31')" if high else f"concat({t}, '-01-01')"
    month = f"date_format(last_day(try_to_date(concat({t}, '-01'))), 'yyyy-MM-dd')" if high else f"concat({t}, '-01')"
    return f"CASE length({t}) WHEN 4 THEN {year} WHEN 7 THEN {month} ELSE {t} END"


def time(t: str, high: bool) -> str:
    minute, second = (":59.999", ".999") if high else (":00.000", ".000")
    return f"CASE length({t}) WHEN 5 THEN concat({t}, '{minute}') WHEN 8 THEN concat({t}, '{second}') ELSE {t} END"


def date_time(t: str, high: bool) -> str:
    rest, zone = ("T23:59:59.999", "-12:00") if high else ("T00:00:00.000", "+14:00")
    day = date(t, high)
    # An offset that is given stays; only a missing one is unknown.
    given = f"regexp_extract({t}, '(Z|[+-][0-9]{{2}}:[0-9]{{2}})$', 1)"
    clock = time(f"regexp_replace(substring({t}, 12), '(Z|[+-][0-9]{{2}}:[0-9]{{2}})$', '')", high)
    offset = f"IF({given} = '', '{zone}', {given})"
    return f"CASE WHEN instr({t}, 'T') = 0 THEN concat({day}, '{rest}{zone}') ELSE concat(left({t}, 10), 'T', {clock}, {offset}) END"


def by_lexeme(t: str, high: bool, is_number: str | None) -> str:
    """The boundary of a value whose type only its text tells; is_number: SQL that tells a JSON number from a string, if it can be told."""
    year = f"WHEN NOT {is_number} AND {t} RLIKE '^[0-9]{{4}}$' THEN {date(t, high)} " if is_number else ""
    return (
        f"CASE WHEN instr({t}, 'T') > 0 THEN {date_time(t, high)} WHEN instr({t}, ':') > 0 THEN {time(t, high)} "
        f"WHEN instr(substring({t}, 2), '-') > 0 THEN {date(t, high)} {year}"
        f"ELSE {number_text(decimal_value(t, high))} END"
    )
