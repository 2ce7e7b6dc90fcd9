"""Typed SQL fragments and the dialect's conversions between value classes.

Types: int, real, text, json (text that JSON functions embed as it is), blob, bool, ts (a Spark date
or timestamp), any (arrays and the like) and null.
"""

from __future__ import annotations

from typing import NamedTuple


class E(NamedTuple):
    """``affinity``: text or num for a column or CAST, any where values of both classes come as text.

    ``known``: what else a text is known to be, for built-in paths around a UDF: ("text", value),
    ("point", x, y), ("words", text) of a simple tsvector or ("query", tree).
    """

    sql: str
    type: str
    affinity: str = ""
    known: tuple = ()


def column(sql: str, kind: str) -> E:
    """A column of a source; kind dyn is text that may stand for numbers."""
    if kind == "dyn":
        return E(sql, "text", "any")
    return E(sql, kind, "text" if kind in TEXTS else "num" if kind in NUMBERS else "")


def kind_of(e: E) -> str:
    """The kind that a result column has for the query above."""
    return "dyn" if e.affinity == "any" and e.type in TEXTS else e.type


NULL = E("NULL", "null")
TEXTS = ("text", "json")
NUMBERS = ("int", "real", "bool")
#: the longest numeric prefix of a text
PREFIX = r"^\\s*([+-]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][+-]?\\d+)?)"
INT_PREFIX = r"^\\s*([+-]?\\d+)"


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


#: powers of ten that a double holds exactly
_TENS = ", ".join(f"1E{i}D" for i in range(23))


def real_text(x: str) -> str:
    """The text of a real: its shortest digits up to 15, else 17 digits; an exponent below 1e-4 and from 1e17.

    A lambda over an array of one binds what is used often. The 17 digits are the product with a
    power of ten, with the exact error of that product, which two halves of each factor tell; beyond
    1e-5 and 1e17 the shortest digits stand. NaN is NULL.
    """
    let = lambda value, name, body: f"transform(array({value}), {name} -> {body})[0]"
    digits = "regexp_replace(split(v.s, 'E')[0], '[.]', '')"
    point = "(instr(v.s, '.') - 1 + coalesce(try_cast(get(split(v.s, 'E'), 1) AS INT), 0))"
    cut = lambda n: f"(134217729.0D * {n} - (134217729.0D * {n} - {n}))"
    xh, th = cut("w.x"), cut("w.t")
    error = f"((({xh} * {th} - w.x * w.t) + {xh} * (w.t - {th}) + (w.x - {xh}) * {th}) + (w.x - {xh}) * (w.t - {th}))"
    long_ = f"cast(cast(w.x * w.t AS BIGINT) + cast(rint({error}) AS BIGINT) AS STRING)"
    seventeen = let(f"named_struct('x', u.x, 't', element_at(array({_TENS}), 17 - u.e), 'e', u.e)", "w", let(f"named_struct('d', {long_}, 'e', w.e)", "q", "named_struct('d', rtrim('0', q.d), 'e', q.e + char_length(q.d) - 17)"))
    exact = f"CASE WHEN char_length(u.d) > 15 AND u.e BETWEEN -5 AND 16 THEN {seventeen} ELSE named_struct('d', u.d, 'e', u.e) END"
    shown = (
        "CASE WHEN f.d = '' THEN '0.0' WHEN f.e < -4 OR f.e > 16 THEN concat(substr(f.d, 1, 1), '.', CASE WHEN char_length(f.d) > 1 THEN substr(f.d, 2) ELSE '0' END, CASE WHEN f.e < 0 THEN 'e-' ELSE 'e+' END, "
        "CASE WHEN abs(f.e) < 10 THEN '0' ELSE '' END, cast(abs(f.e) AS STRING)) WHEN f.e < 0 THEN concat('0.', repeat('0', -f.e - 1), f.d) "
        "WHEN char_length(f.d) <= f.e + 1 THEN concat(f.d, repeat('0', f.e + 1 - char_length(f.d)), '.0') ELSE concat(substr(f.d, 1, f.e + 1), '.', substr(f.d, f.e + 2)) END"
    )
    parts = let(f"named_struct('x', v.x, 'd', {digits}, 'p', {point})", "r", let("named_struct('x', r.x, 'd', rtrim('0', ltrim('0', r.d)), 'e', r.p - 1 - (char_length(r.d) - char_length(ltrim('0', r.d))))", "u", let(exact, "f", shown)))
    whole = let(f"named_struct('x', abs({x}), 's', cast(abs({x}) AS STRING))", "v", parts)
    plain = f"cast({x} AS STRING)"
    return (
        f"CASE WHEN {x} IS NULL OR isnan({x}) THEN NULL WHEN char_length({plain}) <= 16 AND instr({plain}, 'E') = 0 AND instr({plain}, 'I') = 0 AND {x} <> 0 THEN {plain} "
        f"WHEN abs({x}) = cast('Infinity' AS DOUBLE) THEN CASE WHEN {x} > 0 THEN 'Inf' ELSE '-Inf' END ELSE concat(CASE WHEN {x} < 0 THEN '-' ELSE '' END, {whole}) END"
    )


def as_text(e: E) -> E:
    if e.type in TEXTS:
        return E(e.sql, "text", e.affinity)
    if e.type == "real":
        return E(real_text(e.sql), "text")
    if e.type == "bool":
        return E(f"cast(cast({e.sql} AS BIGINT) AS STRING)", "text")
    if e.type == "ts":
        return E(f"date_format({e.sql}, 'yyyy-MM-dd HH:mm:ss')", "text")
    return E(f"cast({e.sql} AS STRING)", "text")


def as_number(e: E) -> E:
    if e.type in ("int", "real", "null"):
        return e
    if e.type == "bool":
        return E(f"cast({e.sql} AS BIGINT)", "int")
    s = as_text(e).sql
    return E(f"CASE WHEN {s} IS NOT NULL THEN coalesce(try_cast(regexp_extract({s}, '{PREFIX}', 1) AS DOUBLE), 0.0D) END", "real")


def as_int(e: E) -> E:
    n = as_number(e)
    return n if n.type in ("int", "null") else E(clamped(n.sql), "int")


def clamped(x: str) -> str:
    """A real as an integer: towards zero, and the nearest one there is."""
    return f"CASE WHEN {x} >= 9.223372036854775807E18D THEN 9223372036854775807L WHEN {x} <= -9.223372036854775808E18D THEN (-9223372036854775807L - 1L) ELSE cast({x} AS BIGINT) END"


def as_real(e: E) -> E:
    n = as_number(e)
    return n if n.type == "real" else E(f"cast({n.sql} AS DOUBLE)", "real")


def as_truth(e: E) -> E:
    if e.type == "bool":
        return e
    if e.type == "null":
        return E("cast(NULL AS BOOLEAN)", "bool")
    return E(f"({as_number(e).sql} <> 0)", "bool")


def as_value(e: E) -> E:
    """What a result column shows: truth values are 1 and 0."""
    return as_number(e) if e.type == "bool" else e


def common(types: list[str]) -> str:
    if set(types) - {"null"} == {"dyn"}:
        return "dyn"
    types = ["text" if t == "dyn" else t for t in types if t != "null"]
    if not types:
        return "null"
    if len(set(types)) == 1:
        return types[0]
    if set(types) <= {"int", "bool"}:
        return "int"
    if set(types) <= set(NUMBERS):
        return "real"
    return "text" if set(types) <= {*NUMBERS, *TEXTS, "ts", "blob"} else "any"


def to_type(e: E, kind: str) -> E:
    if e.type == kind or kind in ("any", "null"):
        return e
    if kind == "int":
        return as_int(e)
    if kind == "real":
        return as_real(e)
    if kind in TEXTS or kind == "dyn":
        return as_text(e)
    return e


def _whole(sql: str) -> int | None:
    """The value of an integer literal."""
    digits = sql.strip("()").rstrip("L")
    return int(digits) if digits.lstrip("-").isdigit() else None


#: a factor or summand from which a column's integers would overflow: the result is a real
LARGE = 1 << 53


def arithmetic(op: str, a: E, b: E) -> E:
    a, b = as_number(a), as_number(b)
    if "null" in (a.type, b.type):
        return NULL
    both_int = a.type == b.type == "int"
    if op in "+-*":
        if not both_int:
            return E(f"({as_real(a).sql} {op} {as_real(b).sql})", "real")
        x, y = _whole(a.sql), _whole(b.sql)
        if x is not None and y is not None:
            made = x + y if op == "+" else x - y if op == "-" else x * y
            if not -(1 << 63) < made < 1 << 63:
                return E(f"{float(made)!r}D", "real")
            return E(f"({made}L)" if abs(made) > 2147483647 else f"({made})", "int")
        if any(v is not None and abs(v) >= LARGE for v in (x, y)):
            return E(f"(cast({a.sql} AS DOUBLE) {op} cast({b.sql} AS DOUBLE))", "real")
        return E(f"(cast({a.sql} AS BIGINT) {op} cast({b.sql} AS BIGINT))", "int")  # an overflow is an error, as the column's type is fixed
    if op == "/":
        if both_int:
            return E(f"({a.sql} DIV nullif({b.sql}, 0))", "int")
        return E(f"({as_real(a).sql} / nullif({as_real(b).sql}, 0.0D))", "real")
    if both_int:
        return E(f"try_mod({a.sql}, {b.sql})", "int")
    return E(f"cast(try_mod({as_int(a).sql}, {as_int(b).sql}) AS DOUBLE)", "real")


def bits(op: str, a: E, b: E) -> E:
    x, y = f"cast({as_int(a).sql} AS BIGINT)", as_int(b).sql
    if op in "&|":
        return E(f"({x} {op} cast({y} AS BIGINT))", "int")

    def left(n: str) -> str:
        return f"CASE WHEN {n} > 63 THEN 0L ELSE shiftleft({x}, cast({n} AS INT)) END"

    def right(n: str) -> str:
        return f"shiftright({x}, cast(least({n}, 63) AS INT))"

    first, second = (left, right) if op == "<<" else (right, left)
    return E(f"CASE WHEN {x} IS NULL OR {y} IS NULL THEN NULL WHEN {y} >= 0 THEN {first(y)} ELSE {second(f'(0 - {y})')} END", "int")


def compare(op: str, a: E, b: E) -> E:
    """Comparison after affinity: a numeric column reads a text as a number where it is one, a text column
    a number as text; what is left of both classes is ordered by class, numbers below texts."""
    if a.type in NUMBERS and b.type in TEXTS:
        return _mixed(op, a, b)
    if b.type in NUMBERS and a.type in TEXTS:
        return _mixed({"<": ">", ">": "<", "<=": ">=", ">=": "<="}.get(op, op), b, a)
    if "bool" in (a.type, b.type) and (a.type, b.type) != ("bool", "bool"):
        a, b = as_value(a), as_value(b)
    return E(f"({a.sql} {op} {b.sql})", "bool")


def _mixed(op: str, number: E, text: E) -> E:
    below = "TRUE" if op in ("<", "<=", "<>") else "FALSE"
    numeric = number.affinity == "num" or text.affinity == "any"
    if text.affinity == "text" and not numeric:
        return E(f"({as_text(number).sql} {op} {text.sql})", "bool")
    number = as_number(number)
    if not numeric:
        return E(f"CASE WHEN {text.sql} IS NOT NULL AND {number.sql} IS NOT NULL THEN {below} END", "bool")
    parsed = f"try_cast({text.sql} AS DOUBLE)"
    return E(f"CASE WHEN {parsed} IS NOT NULL THEN {number.sql} {op} {parsed} WHEN {text.sql} IS NOT NULL AND {number.sql} IS NOT NULL THEN {below} END", "bool")


def same(a: E, b: E) -> E:
    """IS: equality that holds between NULLs."""
    if (a.type in TEXTS) != (b.type in TEXTS) and {a.type, b.type} <= {*NUMBERS, *TEXTS}:
        return E(f"CASE WHEN {a.sql} IS NULL OR {b.sql} IS NULL THEN {a.sql} IS NULL AND {b.sql} IS NULL ELSE {compare('=', a, b).sql} END", "bool")
    if "bool" in (a.type, b.type):
        a, b = as_value(a), as_value(b)
    return E(f"({a.sql} <=> {b.sql})", "bool")


def cast(e: E, kind: str) -> E:
    """CAST by the declared type's affinity, which the result has; it never fails."""
    made = _cast(e, kind)
    return made._replace(affinity="num" if made.type in NUMBERS else "text" if made.type in TEXTS else "")


def _cast(e: E, kind: str) -> E:
    if e.type == "null":
        return E("cast(NULL AS STRING)" if "CHAR" in kind or "TEXT" in kind else "cast(NULL AS BIGINT)" if "INT" in kind else "cast(NULL AS DOUBLE)", "null")
    if "INT" in kind:
        if e.type in NUMBERS:
            n = as_number(e)
            return E(clamped(n.sql) if n.type == "real" else f"cast({n.sql} AS BIGINT)", "int")
        s = as_text(e).sql
        found = f"regexp_extract({s}, '{INT_PREFIX}', 1)"
        return E(f"CASE WHEN {s} IS NOT NULL THEN coalesce(try_cast({found} AS BIGINT), {clamped(f'try_cast({found} AS DOUBLE)')}, 0L) END", "int")
    if any(w in kind for w in ("CHAR", "CLOB", "TEXT")):
        return as_text(e)
    if "BLOB" in kind or not kind:
        return E(f"cast({as_text(e).sql} AS BINARY)", "blob") if e.type != "blob" else e
    if "BOOL" in kind:
        if e.type in TEXTS:
            s = f"lower(trim({e.sql}))"
            return E(f"CASE WHEN {s} IN ('true','t','yes','y','on','1') THEN 1L WHEN {s} IN ('false','f','no','n','off','0') THEN 0L WHEN {s} IS NOT NULL THEN cast({as_truth(e).sql} AS BIGINT) END", "int")
        return E(f"cast({as_truth(e).sql} AS BIGINT)", "int")
    if any(w in kind for w in ("REAL", "FLOA", "DOUB")):
        return as_real(e)
    if (kind.startswith("DECIMAL") or kind.startswith("NUMERIC")) and "," in kind:
        scale = int(kind.split(",")[1].rstrip(" )"))
        return E(f"round({as_real(e).sql}, {scale})", "real")
    return as_number(e)
