"""Date and time functions as Spark SQL: ISO texts, Julian days, epochs and modifiers."""

from __future__ import annotations

import re

from strataql.plans.typed import E, NUMBERS, as_number, as_text, literal
from strataql.sql.lexer import SqlError

_UNIT = {"second": "SECOND", "minute": "MINUTE", "hour": "HOUR", "day": "DAY"}
_MOVE = re.compile(r"([+-]?\d+(?:\.\d+)?)\s+(second|minute|hour|day|month|year)s?$")
_DAYS = {0: "SUNDAY", 1: "MONDAY", 2: "TUESDAY", 3: "WEDNESDAY", 4: "THURSDAY", 5: "FRIDAY", 6: "SATURDAY"}


def _text_of(e: E) -> str | None:
    """The text of a modifier, or None if rows make it."""
    m = re.fullmatch(r"'((?:[^'\\]|\\.)*)'", e.sql)
    return m[1].replace("\\'", "'").replace("\\\\", "\\").strip().lower() if m else None


def _from_julian(days: str) -> str:
    return f"timestamp_micros(cast(round(({days} - 2440587.5D) * 86400000) AS BIGINT) * 1000)"


def instant(args: list[E]) -> str:
    """A timestamp (UTC) from a time value and its modifiers."""
    if not args:
        return "current_timestamp()"
    first, mods = args[0], [_text_of(a) or a for a in args[1:]]
    if first.type == "ts":
        at = f"cast({first.sql} AS TIMESTAMP)"
    elif first.type in NUMBERS:
        n = as_number(first).sql
        if mods and mods[0] in ("unixepoch", "auto"):
            epoch = f"timestamp_millis(cast(round({n} * 1000) AS BIGINT))"
            at = epoch if mods[0] == "unixepoch" else f"CASE WHEN {n} BETWEEN 0.0D AND 5373484.5D THEN {_from_julian(n)} ELSE {epoch} END"
            mods = mods[1:]
        else:
            mods = mods[1:] if mods and mods[0] == "julianday" else mods
            at = f"CASE WHEN {n} BETWEEN 0.0D AND 5373484.5D THEN {_from_julian(n)} END"
    elif first.sql.lower() == "'now'":
        at = "current_timestamp()"
    else:
        s = f"trim({as_text(first).sql})"
        if mods and mods[0] in ("unixepoch", "auto"):
            return instant([E(f"try_cast({s} AS DOUBLE)", "real"), *args[1:]])
        zone = f"regexp_extract({s}, '^\\\\d{{4}}-\\\\d\\\\d-\\\\d\\\\d[ T]\\\\d\\\\d:\\\\d\\\\d(:\\\\d\\\\d(\\\\.\\\\d+)?)?\\\\s*(Z|[+-]\\\\d\\\\d:\\\\d\\\\d)?$', 3)"
        whole = f"{s} RLIKE '^\\\\d{{4}}-\\\\d\\\\d-\\\\d\\\\d([ T]\\\\d\\\\d:\\\\d\\\\d(:\\\\d\\\\d(\\\\.\\\\d+)?)?\\\\s*(Z|[+-]\\\\d\\\\d:\\\\d\\\\d)?)?$'"
        clock = f"{s} RLIKE '^\\\\d\\\\d:\\\\d\\\\d(:\\\\d\\\\d(\\\\.\\\\d+)?)?$'"
        day = f"try_cast(substr({s}, 1, 10) AS DATE)"
        # a day past the month's end rolls over into the next month, up to 31
        lenient = f"coalesce({day}, CASE WHEN cast(substr({s}, 9, 2) AS INT) BETWEEN 1 AND 31 AND cast(substr({s}, 6, 2) AS INT) BETWEEN 1 AND 12 THEN date_add(make_date(cast(substr({s}, 1, 4) AS INT), cast(substr({s}, 6, 2) AS INT), 1), cast(substr({s}, 9, 2) AS INT) - 1) END)"
        rest = f"regexp_extract({s}, '[ T](\\\\d\\\\d:\\\\d\\\\d(:\\\\d\\\\d(\\\\.\\\\d+)?)?)', 1)"
        clocked = f"CASE WHEN {rest} = '' THEN '00:00:00' WHEN char_length({rest}) = 5 THEN concat({rest}, ':00') ELSE {rest} END"
        joined = f"try_cast(concat(cast({lenient} AS STRING), ' ', {clocked}, CASE WHEN {zone} = '' THEN 'Z' ELSE {zone} END) AS TIMESTAMP)"
        number = f"try_cast({s} AS DOUBLE)"
        at = f"CASE WHEN {whole} THEN {joined} WHEN {clock} THEN try_cast(concat('2000-01-01 ', {s}, CASE WHEN char_length({s}) = 5 THEN ':00' ELSE '' END, 'Z') AS TIMESTAMP) WHEN lower({s}) = 'now' THEN current_timestamp() WHEN {number} BETWEEN 0.0D AND 5373484.5D THEN {_from_julian(number)} END"
    floor = False
    for m in mods:
        if isinstance(m, E):
            at = _moved_by_row(at, f"lower(trim({as_text(m).sql}))", floor)
            continue
        if m in ("subsec", "subsecond", "utc", "localtime", "ceiling"):
            continue
        if m == "floor":
            floor = True
            continue
        at = _moved(at, m, floor)
    return at


def _moved_by_row(at: str, m: str, floor: bool) -> str:
    """A modifier that each row makes: amounts of a unit, starts, weekdays and clock times; NULL for any other."""
    n = f"try_cast(regexp_extract({m}, '^([+-]?[0-9]+([.][0-9]+)?)[ ]+(second|minute|hour|day|month|year)s?$', 1) AS DOUBLE)"
    unit = f"regexp_extract({m}, '^([+-]?[0-9]+([.][0-9]+)?)[ ]+(second|minute|hour|day|month|year)s?$', 3)"
    seconds = f"cast({n} * CASE {unit} WHEN 'second' THEN 1 WHEN 'minute' THEN 60 WHEN 'hour' THEN 3600 ELSE 86400 END AS DECIMAL(18, 6))"
    months = f"(cast({n} AS INT) * CASE {unit} WHEN 'year' THEN 12 ELSE 1 END)"
    clock = "^([+-]?)([0-9]{2}):([0-9]{2})(:([0-9]{2}([.][0-9]+)?))?$"
    part = lambda k: f"regexp_extract({m}, '{clock}', {k})"
    told = f"cast((cast({part(2)} AS INT) * 3600 + cast({part(3)} AS INT) * 60 + coalesce(try_cast({part(5)} AS DOUBLE), 0)) * CASE {part(1)} WHEN '-' THEN -1 ELSE 1 END AS DECIMAL(18, 6))"
    return (
        f"CASE WHEN {unit} IN ('month', 'year') THEN {months_moved(at, months, floor)} WHEN {unit} <> '' THEN ({at} + make_dt_interval(0, 0, 0, {seconds})) "
        + " ".join(f"WHEN {m} = 'start of {u}' THEN {_trunc(u.upper(), at)}" for u in ("day", "month", "year"))
        + f" WHEN {m} RLIKE '^weekday [0-6]$' THEN ({at} + make_dt_interval(pmod(cast(substr({m}, 9) AS INT) - (dayofweek({at}) - 1), 7)))"
        f" WHEN {m} RLIKE '{clock}' THEN ({at} + make_dt_interval(0, 0, 0, {told})) WHEN {m} IN ('subsec', 'subsecond', 'utc', 'localtime', 'ceiling', 'floor') THEN {at} END"
    )


def months_moved(at: str, months: str, floor: bool = False) -> str:
    """Months later; a day that the month lacks rolls over (or with floor is its last)."""
    if floor:
        return f"({at} + make_ym_interval(0, cast({months} AS INT)))"
    start = f"({_trunc('MONTH', at)} + make_ym_interval(0, cast({months} AS INT)))"
    return f"({start} + make_dt_interval(day({at}) - 1) + ({at} - {_trunc('DAY', at)}))"


def _trunc(unit: str, at: str) -> str:
    return f"date_trunc('{unit}', {at})"


def _moved(at: str, m: str, floor: bool) -> str:
    if m.startswith("start of "):
        return _trunc(m[9:].strip().upper(), at)
    if m.startswith("weekday "):
        day = int(m[8:])
        ahead = f"pmod({day} - (dayofweek({at}) - 1), 7)"
        return f"({at} + make_dt_interval({ahead}))"
    if got := _MOVE.fullmatch(m):
        n, unit = got[1], got[2]
        if unit in ("month", "year"):
            return months_moved(at, str(int(float(n)) * (12 if unit == "year" else 1)), floor)
        micros = round(float(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit] * 1_000_000)
        return f"({at} + make_dt_interval(0, 0, 0, {micros / 1e6:.6f}))"
    if got := re.fullmatch(r"([+-])?(\d\d):(\d\d)(?::(\d\d(?:\.\d+)?))?", m):
        seconds = (int(got[2]) * 3600 + int(got[3]) * 60 + float(got[4] or 0)) * (-1 if got[1] == "-" else 1)
        return f"({at} + make_dt_interval(0, 0, 0, {seconds:.6f}))"
    if got := re.fullmatch(r"([+-])(\d{4})-(\d\d)-(\d\d)(?: (\d\d):(\d\d)(?::(\d\d))?)?", m):
        sign = -1 if got[1] == "-" else 1
        at = months_moved(at, str(sign * (int(got[2]) * 12 + int(got[3]))), floor)
        seconds = sign * (int(got[4]) * 86400 + int(got[5] or 0) * 3600 + int(got[6] or 0) * 60 + int(got[7] or 0))
        return f"({at} + make_dt_interval(0, 0, 0, {seconds:.6f}))"
    return "cast(NULL AS TIMESTAMP)"


def julian(at: str) -> str:
    return f"((unix_millis({at}) + 210866760000000L) / 86400000.0D)"


def exact_round(x: str, digits: int) -> str:
    """Rounds the exact binary value half away from zero.

    The product with the power of ten is kept as a rounded double and its exact error, by splitting
    both factors; the error decides where the rounded product seems to lie halfway.
    """
    scale = 10.0**digits
    cut = 134217729.0 * scale
    high = cut - (cut - scale)
    low = scale - high
    v = f"abs({x})"
    p = f"({v} * {scale!r}D)"
    vh = f"(134217729.0D * {v} - (134217729.0D * {v} - {v}))"
    vl = f"({v} - {vh})"
    error = f"((({vh} * {high!r}D - {p}) + {vh} * {low!r}D + {vl} * {high!r}D) + {vl} * {low!r}D)"
    rest = f"({p} - floor({p}))"
    up = f"CASE WHEN {rest} > 0.5D OR ({rest} = 0.5D AND {error} >= 0) THEN 1 ELSE 0 END"
    return f"CASE WHEN {p} >= 4503599627370496.0D THEN {x} ELSE sign({x}) * (floor({p}) + {up}) / {scale!r}D END"


def _week(at: str, first: int) -> str:
    """Weeks since the first Sunday (0) or Monday (1)."""
    weekday = f"pmod(dayofweek({at}) - 1 - {first}, 7)"
    return f"lpad(cast((dayofyear({at}) - 1 - {weekday} + 7) DIV 7 AS STRING), 2, '0')"


def strftime(args: list[E]) -> E:
    template, whole, at = _format_of(args[0]), instant(args[1:]), "t__"  # a lambda binds the instant: its fields are many
    fmt = lambda p: f"date_format({at}, '{p}')"
    pad = lambda x, n, c="0": f"lpad(cast({x} AS STRING), {n}, '{c}')"
    twelve = f"(hour({at}) + 11) % 12 + 1"
    made = {
        "d": fmt("dd"), "e": pad(f"day({at})", 2, " "), "f": fmt("ss.SSS"), "F": fmt("yyyy-MM-dd"), "H": fmt("HH"), "I": pad(twelve, 2), "j": fmt("DDD"), "k": pad(f"hour({at})", 2, " "),
        "l": pad(twelve, 2, " "), "m": fmt("MM"), "M": fmt("mm"), "p": f"CASE WHEN hour({at}) < 12 THEN 'AM' ELSE 'PM' END", "P": f"CASE WHEN hour({at}) < 12 THEN 'am' ELSE 'pm' END",
        "R": fmt("HH:mm"), "s": f"cast(unix_seconds({at}) AS STRING)", "S": fmt("ss"), "T": fmt("HH:mm:ss"), "u": f"cast(weekday({at}) + 1 AS STRING)", "w": f"cast(dayofweek({at}) - 1 AS STRING)",
        "U": _week(at, 0), "W": _week(at, 1), "V": pad(f"weekofyear({at})", 2), "G": f"cast(extract(YEAROFWEEK FROM {at}) AS STRING)", "g": pad(f"extract(YEAROFWEEK FROM {at}) % 100", 2),
        "Y": fmt("yyyy"), "J": f"cast({exact_round(julian(at), 9)} AS STRING)", "%": "'%'",
    }
    parts, rest = [], ""
    i = 0
    while i < len(template):
        if template[i] == "%" and i + 1 < len(template):
            if template[i + 1] not in made:
                return E("cast(NULL AS STRING)", "text")
            if rest:
                parts.append(literal(rest))
                rest = ""
            parts.append(made[template[i + 1]])
            i += 2
        else:
            rest += template[i]
            i += 1
    if rest:
        parts.append(literal(rest))
    return E(f"transform(array({whole}), {at} -> CASE WHEN {at} IS NOT NULL THEN concat({', '.join(parts) or literal('')}) END)[0]", "text")


def _format_of(e: E) -> str:
    m = re.fullmatch(r"'((?:[^'\\]|\\.)*)'", e.sql)
    if not m:
        raise SqlError("strftime needs a literal format")
    return m[1].replace("\\'", "'").replace("\\\\", "\\")


def _shown(pattern: str, with_time: bool = True):
    def make(args: list[E]) -> E:
        fine = with_time and any(a.sql.lower() in ("'subsec'", "'subsecond'") for a in args[1:])
        return E(f"date_format({instant(args)}, '{pattern}{'.SSS' if fine else ''}')", "text")

    return make


def unixepoch(args: list[E]) -> E:
    at = instant(args)
    if any(a.sql.lower() in ("'subsec'", "'subsecond'") for a in args[1:]):
        return E(f"(unix_millis({at}) / 1000.0D)", "real")
    return E(f"unix_seconds({at})", "int")


def timediff(args: list[E]) -> E:
    return E(f"s_timediff(date_format({instant(args[:1])}, 'yyyy-MM-dd HH:mm:ss.SSS'), date_format({instant(args[1:])}, 'yyyy-MM-dd HH:mm:ss.SSS'))", "text")


FUNCTIONS = {
    "date": _shown("yyyy-MM-dd", False),
    "time": _shown("HH:mm:ss"),
    "datetime": _shown("yyyy-MM-dd HH:mm:ss"),
    "julianday": lambda a: E(julian(instant(a)), "real"),
    "unixepoch": unixepoch,
    "strftime": strftime,
    "timediff": timediff,
    "current_date": lambda a: E("date_format(current_timestamp(), 'yyyy-MM-dd')", "text"),
    "current_time": lambda a: E("date_format(current_timestamp(), 'HH:mm:ss')", "text"),
    "current_timestamp": lambda a: E("date_format(current_timestamp(), 'yyyy-MM-dd HH:mm:ss')", "text"),
}
