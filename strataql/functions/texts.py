"""Text functions that Spark lacks: printf, escapes, GLOB with column patterns, regex editing, hashes."""

from __future__ import annotations

import hashlib
import json
import re
from datetime import datetime
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache

from .arrow import register_all

_SPEC = re.compile(r"%([-+ 0#,!]*)(\*|\d+)?(?:\.(\*|\d+))?(?:ll|l|h)?([a-zA-Z%])")


def number(x) -> float | int:
    """A value as a number, by its longest numeric prefix."""
    if isinstance(x, bool):
        return int(x)
    if isinstance(x, int | float):
        return x
    m = re.match(r"\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", str(x or ""))
    if not m:
        return 0
    return int(m[1]) if re.fullmatch(r"[+-]?\d+", m[1]) else float(m[1])


def _value(element: str):
    """An argument from its JSON text."""
    return json.loads(element)


def _grouped(digits: str) -> str:
    return re.sub(r"(?<=\d)(?=(\d{3})+$)", ",", digits)


def printf(template: str, elements: list[str]) -> str:
    values = [_value(e) for e in elements]
    at = 0

    def take():
        nonlocal at
        at += 1
        return values[at - 1] if at <= len(values) else None

    def one(m: re.Match) -> str:
        flags, width, precision, kind = m.groups()
        if kind == "%":
            return "%"
        width = int(number(take())) if width == "*" else int(width or 0)
        if width < 0:
            flags, width = flags + "-", -width
        precision = int(number(take())) if precision == "*" else int(precision) if precision is not None else None
        value = take()
        sign = "+" if "+" in flags else " " if " " in flags else ""
        if kind in "di":
            n = int(number(value))
            digits = str(abs(n)).rjust(precision or 1, "0")
            body = _grouped(digits) if "," in flags else digits
            head = "-" if n < 0 else sign
        elif kind in "uxXo":
            n = int(number(value)) & 0xFFFFFFFFFFFFFFFF
            body = {"u": str(n), "x": f"{n:x}", "X": f"{n:X}", "o": f"{n:o}"}[kind].rjust(precision or 1, "0")
            head = {"x": "0x", "X": "0X", "o": "0"}.get(kind, "") if "#" in flags and n else ""
        elif kind in "feEgG":
            x = float(number(value))
            precision = 6 if precision is None else precision
            head = "-" if x < 0 or (x == 0 and str(x)[0] == "-" and False) else sign
            if kind == "f":
                body = str(Decimal(abs(x)).quantize(Decimal(1).scaleb(-precision), ROUND_HALF_UP))
            else:
                body = format(abs(x), ("#" if "#" in flags else "") + f".{precision}{kind}")
            if "," in flags:
                whole, dot, rest = body.partition(".")
                body = _grouped(whole) + dot + rest
        elif kind == "c":
            body, head = str(value if value is not None else "")[:1] * (precision or 1), ""
        elif kind in "szqQw":
            text = "" if value is None else value if isinstance(value, str) else str(value)
            if kind == "Q" and value is None:
                body = "NULL"
            else:
                text = text.replace('"', '""') if kind == "w" else text.replace("'", "''") if kind in "qQ" else text
                body = text if precision is None else text[:precision]
                if kind == "q" and value is None:
                    body = "(NULL)"
                body = f"'{body}'" if kind == "Q" else body
            head = ""
        else:
            return ""
        room = width - len(head) - len(body)
        if room <= 0:
            return head + body
        if "-" in flags:
            return head + body + " " * room
        if "0" in flags and kind not in "szqQwc":
            return head + "0" * room + body
        return " " * room + head + body

    return _SPEC.sub(one, template)


def unistr(text: str) -> str | None:
    bad = False

    def one(m: re.Match) -> str:
        nonlocal bad
        code = m[1] or m[2] or m[3] or m[4]
        if m[5]:
            return "\\"
        if code is None or int(code, 16) > 0x10FFFF:
            bad = True
            return ""
        return chr(int(code, 16))

    out = re.sub(r"\\(?:\+([0-9A-Fa-f]{6})|U([0-9A-Fa-f]{8})|u([0-9A-Fa-f]{4})|([0-9A-Fa-f]{4})|(\\)|)", one, text)
    return None if bad else out


def unistr_quote(text: str) -> str:
    if not any(ord(c) < 32 for c in text):
        return "'" + text.replace("'", "''") + "'"
    body = "".join(f"\\u{ord(c):04x}" if ord(c) < 32 else "\\\\" if c == "\\" else c for c in text)
    return "unistr('" + body.replace("'", "''") + "')"


def char(codes: list[int]) -> str:
    return "".join(chr(c) if c is not None and 0 <= c <= 0x10FFFF and not 0xD800 <= c < 0xE000 else "\ufffd" for c in codes)


def exact_round(x: float, digits: int) -> float:
    return float(Decimal(x).quantize(Decimal(1).scaleb(-min(max(digits, 0), 30)), ROUND_HALF_UP)) if abs(x) < 1e15 else x


@lru_cache(512)
def _pattern(pattern: str, flags: str = "") -> re.Pattern:
    return re.compile(pattern, (re.I if "i" in flags else 0) | (re.S if "s" in flags else 0) | (re.M if "m" in flags or "n" in flags else 0))


def regexp_replace(text: str, pattern: str, replacement: str, flags: str) -> str:
    """The first match, or with flag g all; \\1 to \\9 are groups, \\& the match."""

    def one(m: re.Match) -> str:
        return re.sub(r"\\([0-9&\\])", lambda e: "\\" if e[1] == "\\" else m[0] if e[1] in "&0" else (m[int(e[1])] or "") if int(e[1]) <= (m.re.groups) else "", replacement)

    return _pattern(pattern, flags).sub(one, text, 0 if "g" in flags else 1)


def _nth(text: str, pattern: str, start: int, occurrence: int) -> re.Match | None:
    for k, m in enumerate(_pattern(pattern).finditer(text, max(start, 1) - 1), 1):
        if k == occurrence:
            return m
    return None


def regexp_substr(text: str, pattern: str, start: int, occurrence: int) -> str | None:
    m = _nth(text, pattern, start, occurrence)
    return m[0] if m else None


def regexp_instr(text: str, pattern: str, start: int, occurrence: int) -> int:
    m = _nth(text, pattern, start, occurrence)
    return m.start() + 1 if m else 0


@lru_cache(512)
def _glob(pattern: str) -> re.Pattern:
    from .registry import glob_regex

    return re.compile(glob_regex(pattern).replace("[^]", "(?!)"))


def glob(pattern: str, text: str) -> bool:
    return bool(_glob(pattern).match(text))


def trigrams(text: str) -> set[str]:
    words = re.findall(r"[^\W_]+", text.lower())
    return {f"  {w} "[i : i + 3] for w in words for i in range(len(w) + 1)}


def jaccard(a: set[str], b: set[str]) -> float:
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def word_similarity(a: str, b: str) -> float:
    """The best similarity of a to any run of words of b; over 32 words, to single words and the whole."""
    mine, words = trigrams(a), re.findall(r"[^\W_]+", b.lower())
    if not words:
        return jaccard(mine, set())
    if len(words) > 32:
        return max(*(jaccard(mine, trigrams(w)) for w in words), jaccard(mine, trigrams(b)))
    best = 0.0
    for i in range(len(words)):
        held: set[str] = set()
        for w in words[i:]:
            held |= trigrams(w)
            best = max(best, jaccard(mine, held))
    return best


def sha3(text: str, size: int) -> bytes | None:
    return hashlib.new(f"sha3_{size}", text.encode()).digest() if size in (224, 256, 384, 512) else None


def timediff(a: str, b: str) -> str:
    """What to add to b to get a: years, months, days and a time of day."""
    x, y = (datetime.strptime(s, "%Y-%m-%d %H:%M:%S.%f") for s in (a, b))
    sign = "+" if x >= y else "-"
    forward = x >= y
    months = (x.year - y.year) * 12 + x.month - y.month
    months = abs(months)

    def moved(n: int) -> datetime:
        n = n if forward else -n
        month0 = y.year * 12 + y.month - 1 + n
        first = datetime(month0 // 12, month0 % 12 + 1, 1)
        from datetime import timedelta

        return first + timedelta(days=y.day - 1) + (y - datetime(y.year, y.month, y.day))

    while months and ((moved(months) > x) if forward else (moved(months) < x)):
        months -= 1
    rest = abs(x - moved(months))
    seconds = rest.seconds
    return f"{sign}{months // 12:04d}-{months % 12:02d}-{rest.days:02d} {seconds // 3600:02d}:{seconds // 60 % 60:02d}:{seconds % 60:02d}.{rest.microseconds // 1000:03d}"


def register(spark) -> None:
    register_all(
        spark,
        {
            "s_printf": (printf, "string", 2), "s_unistr": (unistr, "string", 1), "s_unistr_quote": (unistr_quote, "string", 1), "s_char": (char, "string", 1), "s_round": (exact_round, "double", 2),
            "s_regexp_replace": (regexp_replace, "string", 4), "s_regexp_substr": (regexp_substr, "string", 4), "s_regexp_instr": (regexp_instr, "bigint", 4), "s_glob": (glob, "boolean", 2),
            "s_word_similarity": (word_similarity, "double", 2), "s_sha3": (lambda t, n=256: sha3(t, n), "binary", 2), "s_timediff": (timediff, "string", 2),
        },
    )
