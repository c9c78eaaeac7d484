"""Date and time functions as Spark SQL over timestamps without a zone."""

from __future__ import annotations

import re

EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def seconds_after_epoch(sql: str) -> str:
    return f"({EPOCH} + make_dt_interval(0, 0, 0, CAST({sql} AS DECIMAL(18, 6))))"


def moment(sql: str, kind: str) -> str:
    """A time value: text of a date, a time or both; whole numbers are unix seconds, others julian days up to 100000."""
    if kind == "int":
        return seconds_after_epoch(sql)
    if kind == "real":
        return f"(CASE WHEN {sql} > 100000 THEN {seconds_after_epoch(f'floor({sql})')} ELSE {seconds_after_epoch(f'round(({sql} - 2440587.5D) * 86400)')} END)"
    if kind in ("text", "json"):
        if sql == "'now'":
            return "date_trunc('SECOND', CAST(current_timestamp() AS TIMESTAMP_NTZ))"
        clean = f"replace({sql}, 'T', ' ')"
        return f"(CASE WHEN {sql} = 'now' THEN CAST(current_timestamp() AS TIMESTAMP_NTZ) WHEN length({sql}) = 8 THEN TRY_CAST(concat('2000-01-01 ', {sql}) AS TIMESTAMP_NTZ) WHEN length({sql}) = 10 THEN TRY_CAST({sql} AS TIMESTAMP_NTZ) WHEN length({sql}) >= 19 THEN TRY_CAST(substr({clean}, 1, 19) AS TIMESTAMP_NTZ) END)"
    if kind == "null":
        return "CAST(NULL AS TIMESTAMP_NTZ)"
    return f"CAST({sql} AS TIMESTAMP_NTZ)"


def day(t: str) -> str:
    return f"CAST(CAST({t} AS DATE) AS TIMESTAMP_NTZ)"


def modified(t: str, modifier: str) -> str:
    m = modifier.strip().lower()
    if m == "start of day":
        return day(t)
    if m in ("start of month", "start of year"):
        return f"CAST(trunc(CAST({t} AS DATE), '{'MM' if m[9:] == 'month' else 'YEAR'}') AS TIMESTAMP_NTZ)"
    got = re.fullmatch(r"([+-]?\d+(?:\.\d+)?)\s+(second|minute|hour|day|month|year)s?", m)
    if not got:
        return t  # unknown ones are ignored
    n, unit = float(got[1]), got[2]
    if unit in ("month", "year"):
        return f"(CAST(add_months(CAST({t} AS DATE), {int(n) * (12 if unit == 'year' else 1)}) AS TIMESTAMP_NTZ) + ({t} - {day(t)}))"
    seconds = int(n * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit])
    return f"({t} + make_dt_interval(0, 0, 0, CAST({seconds} AS DECIMAL(18, 6))))"


def unix(t: str) -> str:
    return f"timestampdiff(SECOND, {EPOCH}, {t})"


def julian(t: str) -> str:
    return f"({unix(t)} / 86400.0D + 2440587.5D)"


def strftime(form: str, t: str) -> str:
    plain = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "j": "DDD"}
    weekday = f"(dayofweek({t}) - 1)"
    special = {
        "s": f"CAST({unix(t)} AS STRING)", "w": f"CAST({weekday} AS STRING)", "J": f"format_string('%.10f', {julian(t)})", "f": f"concat(date_format({t}, 'ss'), '.000')", "%": "'%'",
        "W": f"lpad(CAST((dayofyear({t}) + 6 - {weekday}) DIV 7 AS STRING), 2, '0')",
    }
    parts, i = [], 0
    while i < len(form):
        if form[i] == "%" and i + 1 < len(form):
            c = form[i + 1]
            parts.append(f"date_format({t}, '{plain[c]}')" if c in plain else special.get(c, "'%" + c.replace("'", "\\'") + "'"))
            i += 2
        else:
            end = form.find("%", i + 1) if form.find("%", i + 1) > 0 else len(form)
            parts.append("'" + form[i:end].replace("\\", "\\\\").replace("'", "\\'") + "'")
            i = end
    return f"concat({', '.join(parts)})" if parts else "''"
