"""All functions of the dialect by name, as makers of typed Spark SQL.

Names that begin with ``s_`` in the emitted SQL are Arrow UDFs or table functions of this package,
registered by ``install``; all else is built into Spark.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from strataql.plans.typed import NULL, NUMBERS, TEXTS, E, as_int, as_number, as_real, as_text, as_truth, as_value, common, literal, to_type
from strataql.sql.lexer import SqlError

from . import dates, fts, geo

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold(sql: str) -> str:
    """ASCII letters lowered, others kept."""
    return f"translate({sql}, '{UPPER}', '{LOWER}')"


def lowered(text: str) -> str:
    """The same of a text at hand."""
    return text.translate(str.maketrans(UPPER, LOWER))


def glob_regex(pattern: str) -> str:
    """An anchored Java pattern for a GLOB pattern."""
    out, i = "(?s)^", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[":
            end = pattern.find("]", i + 2 + (pattern[i + 1 : i + 2] == "^"))
            if end < 0:
                return "(?!)"
            body = pattern[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out += f"[{body}]"
            i = end
        else:
            out += "\\" + c if not c.isalnum() and c.isascii() else c
        i += 1
    return out + "$"


# --- helpers ------------------------------------------------------------------------------------


def _t(a: E) -> str:
    return as_text(a).sql


def _r(a: E) -> str:
    return as_real(a).sql


def _real(sql: str) -> E:
    """A real whose NaN is NULL."""
    return E(f"nullif({sql}, cast('NaN' AS DOUBLE))", "real")


def _math(name: str) -> Callable[[list[E]], E]:
    return lambda a: _real(f"{name}({_r(a[0])})")


def _udf(name: str, kind: str, *types: str) -> Callable[[list[E]], E]:
    """A call of an Arrow UDF, its arguments cast to the given types; the last one repeats."""

    def make(args: list[E]) -> E:
        cast = {"t": _t, "r": _r, "i": lambda a: f"cast({as_int(a).sql} AS BIGINT)"}
        given = [cast[types[min(i, len(types) - 1)]](a) for i, a in enumerate(args)]
        return E(f"{name}({', '.join(given)})", kind)

    return make


def _listed(name: str, kind: str, first: int = 0) -> Callable[[list[E]], E]:
    """A call of an Arrow UDF with the arguments from ``first`` on as one array of texts."""

    def make(args: list[E]) -> E:
        given = [_t(a) for a in args[:first]]
        rest = ", ".join(f"cast({_json_element(a)} AS STRING)" for a in args[first:])
        return E(f"{name}({', '.join([*given, f'array({rest})' if rest else 'cast(array() AS array<string>)'])})", kind)

    return make


# --- core and text ------------------------------------------------------------------------------


def _substr(a: list[E]) -> E:
    if a[0].type == "blob":
        s, n = a[0].sql, f"octet_length({a[0].sql})"
    else:
        s = _t(a[0])
        n = f"char_length({s})"
    p = f"cast({as_int(a[1]).sql} AS INT)"
    kind = "blob" if a[0].type == "blob" else "text"
    begin = f"CASE WHEN {p} > 0 THEN {p} WHEN {p} < 0 THEN {n} + {p} + 1 ELSE 0 END"  # 1-based; may lie before the text
    if len(a) == 2:
        return E(f"substr({s}, greatest({begin}, 1))", kind)
    z = f"cast({as_int(a[2]).sql} AS INT)"
    low = f"CASE WHEN {z} >= 0 THEN {begin} ELSE ({begin}) + {z} END"
    high = f"CASE WHEN {z} >= 0 THEN ({begin}) + {z} ELSE {begin} END"
    return E(f"CASE WHEN {p} IS NULL OR {z} IS NULL THEN NULL ELSE substr({s}, greatest({low}, 1), greatest(greatest({high}, 1) - greatest({low}, 1), 0)) END", kind)


def _length(a: list[E]) -> E:
    return E(f"cast(octet_length({a[0].sql}) AS BIGINT)" if a[0].type == "blob" else f"cast(char_length({_t(a[0])}) AS BIGINT)", "int")


def _trim(word: str) -> Callable[[list[E]], E]:
    return lambda a: E(f"trim({word} {_t(a[1]) if len(a) > 1 else literal(' ')} FROM {_t(a[0])})", "text")


def _choice(pick: Callable[[list[str]], str]) -> Callable[[list[E]], E]:
    def make(args: list[E]) -> E:
        args = [as_value(a) for a in args]
        kind = common([a.type for a in args])
        return E(pick([to_type(a, kind).sql for a in args]), kind)

    return make


def _iif(a: list[E]) -> E:
    pairs = [(as_truth(a[i]), as_value(a[i + 1])) for i in range(0, len(a) - 1, 2)]
    other = as_value(a[-1]) if len(a) % 2 else NULL
    kind = common([v.type for _, v in pairs] + [other.type])
    return E(f"CASE {' '.join(f'WHEN {c.sql} THEN {to_type(v, kind).sql}' for c, v in pairs)} ELSE {to_type(other, kind).sql} END", kind)


def _quote(a: list[E]) -> E:
    e = a[0]
    if e.type == "null":
        return E("'NULL'", "text")
    if e.type == "blob":
        return E(f"coalesce(concat('X\\'', hex({e.sql}), '\\''), 'NULL')", "text")
    if e.type in NUMBERS:
        return E(f"coalesce({_t(e)}, 'NULL')", "text")
    return E(f"coalesce(concat('\\'', replace({_t(e)}, '\\'', '\\'\\''), '\\''), 'NULL')", "text")


def _typeof(a: list[E]) -> E:
    name = {"int": "integer", "bool": "integer", "real": "real", "blob": "blob", "null": "null"}.get(a[0].type, "text")
    return E("'null'" if name == "null" else f"CASE WHEN {a[0].sql} IS NULL THEN 'null' ELSE '{name}' END", "text")


def _extreme(name: str) -> Callable[[list[E]], E]:
    def pick(parts: list[str]) -> str:
        absent = " OR ".join(f"{p} IS NULL" for p in parts)
        return f"CASE WHEN {absent} THEN NULL ELSE {name}({', '.join(parts)}) END"

    return _choice(pick)


def _round(a: list[E]) -> E:
    if len(a) == 1:
        return E(f"round({_r(a[0])}, 0)", "real")
    try:
        digits = min(max(int(a[1].sql), 0), 30)
    except ValueError:
        return E(f"s_round({_r(a[0])}, {as_int(a[1]).sql})", "real")
    return E(dates.exact_round(_r(a[0]), digits) if digits <= 15 else f"s_round({_r(a[0])}, {digits})", "real")


def _step(name: str) -> Callable[[list[E]], E]:
    def make(a: list[E]) -> E:
        n = as_number(a[0])
        if n.type == "int":
            return n
        if name == "trunc":
            return E(f"CASE WHEN {n.sql} < 0 THEN cast(ceil({n.sql}) AS DOUBLE) ELSE cast(floor({n.sql}) AS DOUBLE) END", "real")
        return E(f"cast({name}({n.sql}) AS DOUBLE)", "real")

    return make


def _log(a: list[E]) -> E:
    if len(a) == 1:
        return _real(f"log10({_r(a[0])})")
    return _real(f"(ln({_r(a[1])}) / nullif(ln({_r(a[0])}), 0.0D))")


def _positive(name: str) -> Callable[[list[E]], E]:
    return lambda a: E(f"CASE WHEN {_r(a[0])} > 0 THEN {name}({_r(a[0])}) END", "real")


def _abs(a: list[E]) -> E:
    n = as_number(a[0])
    return E(f"abs({n.sql})", n.type)


def _sign(a: list[E]) -> E:
    if a[0].type in TEXTS:
        return E(f"cast(sign(try_cast({a[0].sql} AS DOUBLE)) AS BIGINT)", "int")
    return E(f"cast(sign({as_number(a[0]).sql}) AS BIGINT)", "int")


def _hex(a: list[E]) -> E:
    return E(f"hex({a[0].sql})" if a[0].type == "blob" else f"coalesce(hex({_t(a[0])}), '')", "text")


def _instr(a: list[E]) -> E:
    return E(f"cast(instr({_t(a[0])}, {_t(a[1])}) AS BIGINT)", "int")


# --- JSON by composition ------------------------------------------------------------------------


def _json_element(e: E) -> str:
    """The JSON text of a value; NULL is null."""
    if e.type == "null":
        return "'null'"
    if e.type == "json":
        return f"coalesce({e.sql}, 'null')"
    if e.type in NUMBERS:
        return f"coalesce({_t(e)}, 'null')"
    s = _t(e)
    quoted = f"to_json(array({s}))"
    return f"CASE WHEN {s} IS NULL THEN 'null' ELSE substr({quoted}, 2, char_length({quoted}) - 2) END"


def _json_array(a: list[E]) -> E:
    parts = ", ',', ".join(_json_element(x) for x in a)
    return E(f"concat('[', {parts}, ']')" if a else "'[]'", "json")


def _json_object(a: list[E]) -> E:
    if len(a) % 2:
        raise SqlError("json_object() requires an even number of arguments")
    parts = ", ',', ".join(f"{_json_element(E(_t(a[i]), 'text'))}, ':', {_json_element(a[i + 1])}" for i in range(0, len(a), 2))
    return E(f"concat('{{', {parts}, '}}')" if a else "'{}'", "json")


def _json_extract(a: list[E]) -> E:
    if len(a) == 2:
        return E(f"s_json_extract({_t(a[0])}, {_t(a[1])})", "text", "any") if not _plain_path(a[1]) else E(f"get_json_object({_t(a[0])}, {a[1].sql})", "text", "any")
    paths = ", ".join(_t(p) for p in a[1:])
    return E(f"s_json_extract_many({_t(a[0])}, array({paths}))", "json")


def _plain_path(e: E) -> bool:
    """A literal path of plain names and places from the start, which the built-in reads alike."""
    import re

    return bool(re.fullmatch(r"'\$(?:\.[A-Za-z_]\w*|\[\d+\])*'", e.sql))


def _arrow(kind: str) -> Callable[[list[E]], E]:
    def make(a: list[E]) -> E:
        if a[1].type == "int":
            path = f"concat('$[', CASE WHEN {a[1].sql} < 0 THEN '#' ELSE '' END, cast({a[1].sql} AS STRING), ']')"
        else:
            p = _t(a[1])
            path = f"CASE WHEN substr({p}, 1, 1) = '$' THEN {p} ELSE concat('$.\"', {p}, '\"') END"
        return E(f"s_json_{'raw' if kind == 'json' else 'extract'}({_t(a[0])}, {path})", kind, "" if kind == "json" else "any")

    return make


# --- regex, trigrams ----------------------------------------------------------------------------


def _regexp_like(a: list[E]) -> E:
    pattern = _t(a[1])
    if len(a) > 2:
        pattern = f"concat(CASE WHEN instr({_t(a[2])}, 'i') > 0 THEN '(?i)' ELSE '' END, {pattern})"
    return E(f"({_t(a[0])} RLIKE {pattern})", "bool")


def _trigrams(s: str) -> str:
    """The distinct trigrams of a text: each word, lowered, between two spaces and one."""
    words = f"filter(split(regexp_replace(lower({s}), '[^\\\\p{{L}}\\\\p{{N}}]+', ' '), ' '), w -> w <> '')"
    return f"array_distinct(flatten(transform({words}, w -> transform(sequence(1, char_length(w) + 1), i -> substr(concat('  ', w, ' '), i, 3)))))"


def _jaccard(x: str, y: str) -> str:
    return f"CASE WHEN size({x}) = 0 AND size({y}) = 0 THEN 1.0D ELSE size(array_intersect({x}, {y})) / cast(size(array_union({x}, {y})) AS DOUBLE) END"


def _similarity(a: list[E]) -> E:
    x, y = _t(a[0]), _t(a[1])
    return E(f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN {_jaccard(_trigrams(x), _trigrams(y))} END", "real")


def _show_trgm(a: list[E]) -> E:
    s = _trigrams(_t(a[0]))
    return E(f"concat('{{', array_join(transform(array_sort({s}), g -> concat('\"', g, '\"')), ','), '}}')", "text")


def _haversine(a: list[E]) -> E:
    """Metres between two points; pure arithmetic on their coordinates."""
    x1, y1, x2, y2 = (call(f"st_{c}", [p]).sql for p in a[:2] for c in ("x", "y"))
    return great_circle(x1, y1, x2, y2, _r(a[2]) if len(a) > 2 else "6371008.8D")


def great_circle(x1: str, y1: str, x2: str, y2: str, radius: str) -> E:
    dy, dx = f"radians(({y2} - {y1}) / 2)", f"radians(({x2} - {x1}) / 2)"
    h = f"(pow(sin({dy}), 2) + cos(radians({y1})) * cos(radians({y2})) * pow(sin({dx}), 2))"
    return E(f"(2 * {radius} * asin(sqrt(least(1.0D, {h}))))", "real")


FUNCTIONS: dict[str, tuple[int, int, Callable[[list[E]], E]]] = {}
#: collations of users, by the UDF that makes their sort keys
COLLATIONS: dict[str, str] = {}
MANY = 1000


def _add(low: int, high: int, **made: Callable[[list[E]], E]) -> None:
    for name, make in made.items():
        FUNCTIONS[name] = (low, high, make)


_add(1, 1, abs=_abs, length=_length, octet_length=lambda a: E(f"cast(octet_length({a[0].sql if a[0].type == 'blob' else _t(a[0])}) AS BIGINT)", "int"), lower=lambda a: E(fold(_t(a[0])), "text"), upper=lambda a: E(f"translate({_t(a[0])}, '{LOWER}', '{UPPER}')", "text"), hex=_hex, quote=_quote, typeof=_typeof, pg_typeof=_typeof, sign=_sign, unicode=lambda a: E(f"CASE WHEN {_t(a[0])} <> '' THEN cast(ascii({_t(a[0])}) AS BIGINT) END", "int"), soundex=lambda a: E(f"CASE WHEN {_t(a[0])} RLIKE '[A-Za-z]' THEN soundex(regexp_extract({_t(a[0])}, '[A-Za-z].*', 0)) ELSE '?000' END", "text"), zeroblob=lambda a: E(f"unhex(repeat('00', cast({as_int(a[0]).sql} AS INT)))", "blob"), likely=lambda a: a[0], unlikely=lambda a: a[0], unistr=_udf("s_unistr", "text", "t"), unistr_quote=_udf("s_unistr_quote", "text", "t"))
_add(2, 2, likelihood=lambda a: a[0], instr=_instr, nullif=lambda a: E(f"nullif({as_value(a[0]).sql}, {as_value(a[1]).sql})", as_value(a[0]).type), ifnull=_choice(lambda p: f"coalesce({', '.join(p)})"), power=lambda a: _real(f"power({_r(a[0])}, {_r(a[1])})"), pow=lambda a: _real(f"power({_r(a[0])}, {_r(a[1])})"), mod=lambda a: E(f"try_mod({_r(a[0])}, {_r(a[1])})", "real"), atan2=lambda a: _real(f"atan2({_r(a[0])}, {_r(a[1])})"), like=lambda a: E(f"({fold(_t(a[1]))} LIKE {fold(_t(a[0]))})", "bool"), glob=lambda a: E(f"s_glob({_t(a[0])}, {_t(a[1])})", "bool"))
_add(1, MANY, concat=lambda a: E(f"concat_ws('', {', '.join(_t(x) for x in a)})", "text"), printf=_listed("s_printf", "text", 1), format=_listed("s_printf", "text", 1), char=lambda a: E("s_char(array(" + ", ".join(f"cast({as_int(x).sql} AS BIGINT)" for x in a) + "))", "text"))
_add(2, MANY, concat_ws=lambda a: E(f"concat_ws({', '.join(_t(x) for x in a)})", "text"), coalesce=_choice(lambda p: f"coalesce({', '.join(p)})"), min=_extreme("least"), max=_extreme("greatest"), iif=_iif)
FUNCTIONS["if"] = FUNCTIONS["iif"]
_add(1, 2, trim=_trim("BOTH"), ltrim=_trim("LEADING"), rtrim=_trim("TRAILING"), round=_round, unhex=lambda a: E(f"try_to_binary({f'translate({_t(a[0])}, {_t(a[1])}, {literal("")})' if len(a) > 1 else _t(a[0])}, 'hex')", "blob"), log=_log)
_add(3, 3, replace=lambda a: E(f"CASE WHEN {_t(a[1])} = '' THEN {_t(a[0])} ELSE replace({_t(a[0])}, {_t(a[1])}, {_t(a[2])}) END", "text"))
_add(2, 3, substr=_substr, substring=_substr)
_add(1, 1, exp=_math("exp"), sqrt=_math("sqrt"), ln=_positive("ln"), log10=_positive("log10"), log2=_positive("log2"), floor=_step("floor"), ceil=_step("ceil"), ceiling=_step("ceil"), trunc=_step("trunc"), **{n: _math(n) for n in "sin cos tan asin acos atan sinh cosh tanh asinh acosh atanh degrees radians cot sec csc".split()})
_add(0, 0, pi=lambda a: E("pi()", "real"), random=lambda a: E("cast((rand() - 0.5D) * 18446744073709551615D AS BIGINT)", "int"), sqlite_version=lambda a: E("'3.53.0'", "text"))
_add(1, 1, randomblob=lambda a: E(f"unhex(substr(sha2(cast(rand() AS STRING), 512), 1, 2 * cast({as_int(a[0]).sql} AS INT)))", "blob"))
_add(1, 2, sha3=lambda a: E(f"s_sha3({_t(a[0])}, cast({a[1].sql if len(a) > 1 else 256} AS BIGINT))", "blob"))
_add(0, MANY, **{k: f for k, f in dates.FUNCTIONS.items() if k != "strftime"})
_add(1, MANY, strftime=dates.strftime)
for _prefix in ("json", "jsonb"):  # the binary form is kept as text
    _add(0, MANY, **{f"{_prefix}_array": _json_array, f"{_prefix}_object": _json_object})
    _add(2, MANY, **{f"{_prefix}_extract": _json_extract})
    _add(3, MANY, **{f"{_prefix}_set": _listed("s_json_set", "json", 1), f"{_prefix}_insert": _listed("s_json_insert", "json", 1), f"{_prefix}_replace": _listed("s_json_replace", "json", 1)})
    _add(1, MANY, **{f"{_prefix}_remove": lambda a: E(f"s_json_remove({_t(a[0])}, array({', '.join(_t(x) for x in a[1:])}))" if len(a) > 1 else _t(a[0]), "json")})
    _add(2, 2, **{f"{_prefix}_patch": _udf("s_json_patch", "json", "t")})
    _add(1, 1, **{_prefix: _udf("s_json", "json", "t")})
_add(1, 2, json_valid=lambda a: E(f"s_json_valid({_t(a[0])})", "bool"), json_type=lambda a: E(f"s_json_type({_t(a[0])}, {_t(a[1]) if len(a) > 1 else literal('$')})", "text"), json_array_length=lambda a: E(f"s_json_array_length({_t(a[0])}, {_t(a[1]) if len(a) > 1 else literal('$')})", "int"), json_pretty=lambda a: E(f"s_json_pretty({_t(a[0])}, {_t(a[1]) if len(a) > 1 else literal('    ')})", "text"))
_add(1, 1, json_quote=lambda a: E(_json_element(a[0]), "json"), json_error_position=_udf("s_json_error_position", "int", "t"))
_add(2, 2, json_arrow=_arrow("json"), json_arrow_text=_arrow("text"))
_add(2, 2, regexp=lambda a: E(f"({_t(a[1])} RLIKE {_t(a[0])})", "bool"), similarity=_similarity, word_similarity=_udf("s_word_similarity", "real", "t"))
_add(2, 3, regexp_like=_regexp_like)
_add(3, 4, regexp_replace=lambda a: E(f"s_regexp_replace({', '.join(_t(x) for x in a)}{', ' + literal('') if len(a) == 3 else ''})", "text"))
_add(2, 4, regexp_substr=lambda a: E(f"s_regexp_substr({_t(a[0])}, {_t(a[1])}, cast({a[2].sql if len(a) > 2 else 1} AS BIGINT), cast({a[3].sql if len(a) > 3 else 1} AS BIGINT))", "text"), regexp_instr=lambda a: E(f"s_regexp_instr({_t(a[0])}, {_t(a[1])}, cast({a[2].sql if len(a) > 2 else 1} AS BIGINT), cast({a[3].sql if len(a) > 3 else 1} AS BIGINT))", "int"))
_add(2, 3, regexp_count=lambda a: E(f"cast(regexp_count({_t(a[0]) if len(a) < 3 else f'substr({_t(a[0])}, cast({a[2].sql} AS INT))'}, {_t(a[1])}) AS BIGINT)", "int"))
_add(1, 1, show_trgm=_show_trgm)


def _vector(a: list[E]) -> E:
    """to_tsvector; that of the simple configuration is known by its text."""
    config = a[0].known[1:] if len(a) > 1 else ("english",)
    return E(f"s_to_tsvector({_t(a[0]) if len(a) > 1 else literal('english')}, {_t(a[-1])})", "text", known=("words", _t(a[-1])) if config == ("simple",) else ())


def _query(name: str) -> Callable[[list[E]], E]:
    """A maker of a tsquery, which constants give here and now; faulty ones are left to fail in the query."""

    def make(a: list[E]) -> E:
        config = a[0].known if len(a) > 1 else ("text", "english")
        if config[:1] == ("text",) and a[-1].known[:1] == ("text",):
            try:
                made = fts.QUERIES[name](config[1], a[-1].known[1])
                return E(literal(made), "text", known=("query", fts.parsed(made)))
            except ValueError:
                pass
        return E(f"s_{name}({_t(a[0]) if len(a) > 1 else literal('english')}, {_t(a[-1])})", "text")

    return make


def _ts_match(a: list[E]) -> E:
    """Built-in functions where the words and the query are known and hold no phrase."""
    if a[0].known[:1] == ("words",) and a[1].known[:1] == ("query",) and (sql := fts.native_match(a[0].known[1], a[1].known[1])):
        return E(sql, "bool")
    return E(f"s_ts_match({_t(a[0])}, {_t(a[1])})", "bool")


def _fts_match(a: list[E]) -> E:
    if a[1].known[:1] == ("text",):
        try:
            if sql := fts.native_match(_t(a[0]), fts.bare_query(a[1].known[1])):
                return E(sql, "bool")
        except ValueError:
            pass
    return E(f"s_fts_match({_t(a[0])}, {_t(a[1])})", "bool")


_add(1, 2, to_tsvector=_vector, **{_name: _query(_name) for _name in fts.QUERIES})
_add(2, 2, ts_match=_ts_match, tsvector_concat=_udf("s_tsvector_concat", "text", "t"), fts_match=_fts_match)
_add(2, 3, ts_rank=lambda a: E(f"s_ts_rank({_t(a[0])}, {_t(a[1])}, {_r(a[2]) if len(a) > 2 else '0.1D'})", "real"), ts_rank_cd=lambda a: E(f"s_ts_rank({_t(a[0])}, {_t(a[1])}, {_r(a[2]) if len(a) > 2 else '0.1D'})", "real"))
_add(1, 1, strip=_udf("s_ts_strip", "text", "t"), numnode=_udf("s_numnode", "int", "t"))
_add(2, 3, ts_headline=lambda a: E(f"s_ts_headline({_t(a[-2])}, {_t(a[-1])})", "text"))



def _coordinates(a: E) -> tuple[str, str] | None:
    """The coordinates of what is known to be a point."""
    if a.known[:1] == ("point",):
        return a.known[1:]
    shape = geo.parse(a.known[1]) if a.known[:1] == ("text",) else None
    return tuple(f"{v!r}D" for v in shape.points[0]) if shape is not None and shape.kind == "POINT" and shape.points and all(map(math.isfinite, shape.points[0])) else None


def _st_point(a: list[E]) -> E:
    x, y = _r(a[0]), _r(a[1])
    return E(f"s_st_point({x}, {y})", "text", known=("point", x, y))


def _coordinate(i: int) -> Callable[[list[E]], E]:
    """A point's x or y, NULL where either is."""

    def make(a: list[E]) -> E:
        if (at := _coordinates(a[0])) is not None:
            return E(at[i] if a[0].known[0] == "text" else f"CASE WHEN {at[1 - i]} IS NOT NULL THEN {at[i]} END", "real")
        return E(f"s_st_{'xy'[i]}({_t(a[0])})", "real")

    return make


def _st_distance(a: list[E]) -> E:
    """Arithmetic between two known points, else the UDF of shapes."""
    p, q = _coordinates(a[0]), _coordinates(a[1])
    if p is None or q is None:
        return E(f"s_st_distance({_t(a[0])}, {_t(a[1])})", "real")
    return E(f"hypot({p[0]} - {q[0]}, {p[1]} - {q[1]})", "real")


_GEO1 = {"st_srid": "int", "st_astext": "text", "st_asgeojson": "text", "st_geometrytype": "text", "st_npoints": "int", "st_numpoints": "int", "st_isvalid": "bool", "st_startpoint": "text", "st_endpoint": "text", "st_numinteriorrings": "int", "st_exteriorring": "text", "st_isclosed": "bool", "st_isring": "bool", "st_area": "real", "st_length": "real", "st_perimeter": "real", "st_envelope": "text", "st_centroid": "text", "st_reverse": "text", "st_convexhull": "text", "geopoly_area": "real", "geopoly_bbox": "text", "geopoly_ccw": "text", "geopoly_json": "text", "geopoly_blob": "text", "geopoly_svg": "text"}
for _name, _kind in _GEO1.items():
    _add(1, MANY if _name == "geopoly_svg" else 1, **{_name: _udf(f"s_{_name}", _kind, "t")})
_add(1, 1, st_x=_coordinate(0), st_y=_coordinate(1))
for _name in ("st_contains", "st_within", "st_intersects", "st_disjoint", "st_touches", "st_crosses", "st_overlaps", "st_equals"):
    _add(2, 2, **{_name: _udf(f"s_{_name}", "bool", "t")})
_add(2, 2, st_distance=_st_distance, st_pointn=_udf("s_st_pointn", "text", "t", "i"), st_interiorringn=_udf("s_st_interiorringn", "text", "t", "i"), st_setsrid=_udf("s_st_setsrid", "text", "t", "i"), st_makeline=_udf("s_st_makeline", "text", "t"), st_point=_st_point, st_makepoint=_st_point, st_distancespheroid=_udf("s_st_distancespheroid", "real", "t"), geopoly_overlap=_udf("s_geopoly_overlap", "int", "t"), geopoly_within=_udf("s_geopoly_within", "int", "t"))
_add(2, 3, st_distancesphere=_haversine, st_rotate=_udf("s_st_rotate", "text", "t", "r"), st_expand=lambda a: E(f"s_st_expand({_t(a[0])}, {_r(a[1])}, {_r(a[-1])})", "text"))
_add(3, 3, st_translate=_udf("s_st_translate", "text", "t", "r"), st_scale=_udf("s_st_scale", "text", "t", "r"), geopoly_contains_point=_udf("s_geopoly_contains_point", "int", "t", "r"))
_add(1, 2, st_geomfromtext=lambda a: E(f"s_st_geomfromtext({_t(a[0])}, cast({a[1].sql if len(a) > 1 else 0} AS BIGINT))", "text"))
_add(4, 5, st_makeenvelope=lambda a: E(f"s_st_makeenvelope({', '.join(_r(x) for x in a[:4])}, cast({a[4].sql if len(a) > 4 else 0} AS BIGINT))", "text"))
_add(3, 4, st_dwithin=lambda a: E(f"({(call('st_distance', a[:2]) if len(a) == 3 else E(f'CASE WHEN {as_truth(a[3]).sql} THEN {call("st_distancespheroid", a[:2]).sql} ELSE {call("st_distancesphere", a[:2]).sql} END', 'real')).sql} <= {_r(a[2])})", "bool"))
_add(4, 4, geopoly_regular=_udf("s_geopoly_regular", "text", "r"))
_add(7, 7, geopoly_xform=_udf("s_geopoly_xform", "text", "t", "r"))


def call(name: str, args: list[E]) -> E:
    if name not in FUNCTIONS:
        raise SqlError(f"no such function: {name}")
    low, high, make = FUNCTIONS[name]
    if not low <= len(args) <= high:
        raise SqlError(f"wrong number of arguments to function {name}()")
    return make(args)


# --- aggregates ---------------------------------------------------------------------------------

Aggregate = Callable[[list[E], bool, str, str], E]


def _simple(name: str, kind: str | None = None, change: Callable[[E], E] = as_value) -> Aggregate:
    def make(a: list[E], distinct: bool, order: str, where: str) -> E:
        e = change(a[0])
        return E(f"{name}({'DISTINCT ' if distinct else ''}{e.sql}){where}", kind or e.type)

    return make


def _count(a: list[E], distinct: bool, order: str, where: str) -> E:
    return E(f"count({'DISTINCT ' if distinct else ''}{as_value(a[0]).sql if a else '*'}){where}", "int")


def _total(a: list[E], distinct: bool, order: str, where: str) -> E:
    return E(f"coalesce(sum({'DISTINCT ' if distinct else ''}{_r(a[0])}){where}, 0.0D)", "real")


def exact(name: str, x: E, where: str) -> E:
    """The sum, total or avg of REALs by their 32-bit digits from 2^64 to 2^-64, added as integers: the same
    values give the same result in any order and over any partitions. What is beyond or below those
    digits is added as REAL. A group may have 2^31 rows; more are an overflow error."""
    v = _r(x)
    unit, least = "4294967296D", "18446744073709551616D"
    inside = f"(CASE WHEN abs({v}) < {least} THEN {v} WHEN {v} IS NOT NULL THEN 0D END)"
    parts = (f"{inside} % (1D / {unit}) * {least}", f"{inside} % 1D * {unit}", f"{inside} % {unit}", f"{inside} / {unit}")
    carry, digits = "0L", []
    for part in parts:  # from the lowest; each digit keeps what is nearest to zero, so a sum has one form
        got = f"(sum(cast({part} AS BIGINT)){where} + {carry})"
        carry = f"shiftright({got} + 2147483648L, 32)"
        digits.append(f"cast({got} - shiftleft({carry}, 32) AS DOUBLE)" if part is not parts[-1] else f"cast({got} AS DOUBLE)")
    rest = f"sum(CASE WHEN abs({v}) < {least} THEN {v} % (1D / {least}) ELSE {v} END){where}"
    total = f"({rest} + ({digits[0]} / {least} + {digits[1]} / {unit} + {digits[2]} + {digits[3]} * {unit}))"
    return E({"sum": total, "total": f"coalesce({total}, 0.0D)", "avg": f"({total} / nullif(count({v}){where}, 0))"}[name], "real")


def _join(a: list[E], distinct: bool, order: str, where: str) -> E:
    separator = _t(a[1]) if len(a) > 1 else "','"
    s = _t(a[0])
    if distinct:
        direction = " DESC" if order.endswith(" DESC") else ""
        within = f" WITHIN GROUP (ORDER BY {s}{direction})" if order else ""
        return E(f"listagg(DISTINCT {s}, {separator}){within}{where}", "text")
    within = f" WITHIN GROUP (ORDER BY {order})" if order else ""
    if not separator.startswith("'"):  # each value after the first comes after its own row's separator
        rows = f"collect_list(CASE WHEN {s} IS NOT NULL THEN struct({order.replace(' DESC', '') + ', ' if order else ''}{separator} AS sep, {s} AS v) END){where}"
        rows = f"array_sort({rows})" if order else rows
        return E(f"CASE WHEN size({rows}) > 0 THEN aggregate({rows}, cast(NULL AS STRING), (x, y) -> CASE WHEN x IS NULL THEN y.v ELSE concat(x, coalesce(y.sep, ''), y.v) END) END", "text")
    return E(f"listagg({s}, {separator}){within}{where}", "text")


def _json_group_array(a: list[E], distinct: bool, order: str, where: str) -> E:
    within = f" WITHIN GROUP (ORDER BY {order})" if order else ""
    return E(f"concat('[', coalesce(listagg({'DISTINCT ' if distinct else ''}{_json_element(a[0])}, ','){within}{where}, ''), ']')", "json")


def _json_group_object(a: list[E], distinct: bool, order: str, where: str) -> E:
    key = _t(a[0])
    pair = f"CASE WHEN {key} IS NOT NULL THEN concat({_json_element(E(key, 'text'))}, ':', {_json_element(a[1])}) END"
    within = f" WITHIN GROUP (ORDER BY {order})" if order else f" WITHIN GROUP (ORDER BY {key})"
    return E(f"concat('{{', coalesce(listagg({pair}, ','){within}{where}, ''), '}}')", "json")


def _percentile(name: str, hundred: bool) -> Aggregate:
    def make(a: list[E], distinct: bool, order: str, where: str) -> E:
        share = f"{float(a[1].sql.rstrip('D')) / (100 if hundred else 1)!r}D"
        return E(f"cast({name}({share}) WITHIN GROUP (ORDER BY {_r(a[0])}){where} AS DOUBLE)", "real")

    return make


def _by(name: str) -> Aggregate:
    """The value where the keys are least or greatest, NULL being the least."""

    def make(a: list[E], distinct: bool, order: str, where: str) -> E:
        e = as_value(a[0])
        keys = ", ".join(f"{k.sql} IS NOT NULL, {k.sql}" for k in map(as_value, a[1:]))
        return E(f"{name}(struct({e.sql} AS v), struct({keys})).v", e.type, e.affinity)

    return make


AGGREGATES: dict[str, Aggregate] = {
    "__first": lambda a, d, o, w: E(f"first({as_value(a[0]).sql})", as_value(a[0]).type, a[0].affinity), "__least_by": _by("min_by"), "__most_by": _by("max_by"),
    "count": _count, "sum": _simple("sum", None, as_number), "total": _total, "avg": _simple("avg", "real", as_number), "min": _simple("min"), "max": _simple("max"),
    "group_concat": _join, "string_agg": _join, "json_group_array": _json_group_array, "jsonb_group_array": _json_group_array, "json_group_object": _json_group_object, "jsonb_group_object": _json_group_object,
    "median": _simple("median", "real", as_real), "percentile": _percentile("percentile_cont", True), "percentile_cont": _percentile("percentile_cont", True), "percentile_disc": _percentile("percentile_disc", True),
    "percentile_cont_within": _percentile("percentile_cont", False), "percentile_disc_within": _percentile("percentile_disc", False),
    "stddev": _simple("stddev_samp", "real", as_real), "stddev_samp": _simple("stddev_samp", "real", as_real), "stddev_pop": _simple("stddev_pop", "real", as_real), "variance": _simple("var_samp", "real", as_real), "var_pop": _simple("var_pop", "real", as_real),
    "geopoly_group_bbox": lambda a, d, o, w: E(f"s_bbox_of(min(s_st_xmin({_t(a[0])})){w}, min(s_st_ymin({_t(a[0])})){w}, max(s_st_xmax({_t(a[0])})){w}, max(s_st_ymax({_t(a[0])})){w})", "text"),
    "sha3_agg": lambda a, d, o, w: E(f"s_sha3(array_join(array_sort(collect_list({_t(a[0])}){w}), ''), 256L)", "blob"),
}


def window_aggregate(name: str, args: list[E], window: str) -> E:
    over = f" OVER {window}"
    if name == "count":
        return E(f"count({as_value(args[0]).sql if args else '*'}){over}", "int")
    if name == "total":
        return E(f"coalesce(sum({_r(args[0])}){over}, 0.0D)", "real")
    if name in ("group_concat", "string_agg"):
        rows = f"collect_list({_t(args[0])}){over}"
        return E(f"CASE WHEN size({rows}) > 0 THEN array_join({rows}, {_t(args[1]) if len(args) > 1 else literal(',')}) END", "text")
    if name == "json_group_array":
        return E(f"concat('[', array_join(collect_list({_json_element(args[0])}){over}, ','), ']')", "json")
    e = AGGREGATES[name](args, False, "", "")
    return E(e.sql + over, e.type)


def fold_array(name: str, rows: str, value: E, args: list[E], star: bool) -> E:
    """An aggregate or value function over an array that stands for a frame."""
    some = f"filter({rows}, v -> v IS NOT NULL)"
    if name == "count":
        return E(f"cast(size({rows if star or not args else some}) AS BIGINT)", "int")
    if name in ("sum", "total", "avg"):
        whole = name == "sum" and value.type == "int"
        zero = "cast(0 AS BIGINT)" if whole else "0.0D"
        total = f"aggregate({some}, {zero}, (x, v) -> x + cast(v AS {'BIGINT' if whole else 'DOUBLE'}))"
        if name == "total":
            return E(total, "real")
        total = total if name == "sum" else f"{total} / size({some})"
        return E(f"CASE WHEN size({some}) > 0 THEN {total} END", "int" if whole else "real")
    if name in ("min", "max"):
        return E(f"array_{name}({some})", value.type)
    if name == "first_value":
        return E(f"get({rows}, 0)", value.type)
    if name == "last_value":
        return E(f"get({rows}, size({rows}) - 1)", value.type)
    if name == "nth_value":
        return E(f"get({rows}, cast({args[1].sql} AS INT) - 1)", value.type)
    if name in ("group_concat", "string_agg"):
        return E(f"CASE WHEN size({some}) > 0 THEN array_join({some}, {_t(args[1]) if len(args) > 1 else literal(',')}) END", "text")
    raise SqlError(f"EXCLUDE isn't supported for {name}()")


# --- table functions ----------------------------------------------------------------------------

_EACH = [("key", "dyn"), ("value", "dyn"), ("type", "text"), ("atom", "dyn"), ("id", "int"), ("parent", "int"), ("fullkey", "text"), ("path", "text")]


def _each(name: str):
    return lambda a: f"s_{name}({_t(a[0])}, {_t(a[1]) if len(a) > 1 else literal('$')})"


def _series(a: list[E]) -> str:
    low, high = as_int(a[0]).sql, as_int(a[1]).sql
    step = as_int(a[2]).sql if len(a) > 2 else "1"
    return f"(SELECT explode(CASE WHEN ({high} - {low}) * sign({step}) >= 0 THEN sequence(cast({low} AS BIGINT), cast({high} AS BIGINT), cast({step} AS BIGINT)) ELSE cast(array() AS array<bigint>) END))"


TABLE_FUNCTIONS: dict[str, tuple[Callable[[list[E]], str], list[tuple[str, str]]]] = {
    "json_each": (_each("json_each"), _EACH),
    "json_tree": (_each("json_tree"), _EACH),
    "jsonb_each": (_each("json_each"), _EACH),
    "jsonb_tree": (_each("json_tree"), _EACH),
    "generate_series": (_series, [("value", "int")]),
}


def install(spark) -> None:
    """Registers the package's UDFs and table functions with a session, once."""
    from . import jsons, texts

    for module in (texts, jsons, fts, geo):
        module.register(spark)
