"""JSON functions on text: lenient reading, paths, editing, and the table functions json_each and json_tree.

Numbers keep their text, so editing a document doesn't rewrite them. Paths: $, .name, ."name", [n],
[#-n] and [#].
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from .arrow import register_all


class Raw(str):
    """A number as it was written."""


class Pairs(list):
    """An object's members in order, duplicates kept."""


_SPACE = re.compile(r"(?:\s|//[^\n]*|/\*.*?\*/)*", re.S)
_NUMBER = re.compile(r"[+-]?(?:0[xX][0-9a-fA-F]+|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|Infinity|inf|NaN)")
_WORD = re.compile(r"[A-Za-z_$][\w$]*")
_STRING = {q: re.compile(rf"{q}((?:[^{q}\\]|\\.)*){q}", re.S) for q in "\"'"}
_ESCAPE = re.compile(r"\\(u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|\r\n|.)", re.S)
_PLAIN = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": "", "\r\n": ""}


class Bad(ValueError):
    def __init__(self, at: int):
        super().__init__(f"malformed JSON at {at}")
        self.at = at


def _unescape(body: str) -> str:
    def one(m: re.Match) -> str:
        c = m[1]
        if c[0] in "ux" and len(c) > 1:
            return chr(int(c[1:], 16))
        return _PLAIN.get(c, c)

    out = _ESCAPE.sub(one, body)
    return out.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if any(0xD800 <= ord(c) < 0xE000 for c in out) else out


class Reader:
    """A recursive reader of JSON and its lenient fifth edition; ``strict`` allows the former alone."""

    def __init__(self, text: str, strict: bool = False):
        self.text, self.at, self.strict = text, 0, strict

    def space(self) -> None:
        self.at = re.compile(r"[ \t\r\n]*").match(self.text, self.at).end() if self.strict else _SPACE.match(self.text, self.at).end()

    def whole(self):
        out = self.value()
        self.space()
        if self.at < len(self.text):
            raise Bad(self.at)
        return out

    def value(self):
        self.space()
        text, at = self.text, self.at
        c = text[at : at + 1]
        if c == "{":
            return self.object()
        if c == "[":
            return self.array()
        if c == '"' or (c == "'" and not self.strict):
            return self.string()
        for word, value in (("true", True), ("false", False), ("null", None)):
            if text.startswith(word, at):
                self.at += len(word)
                return value
        m = (re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?") if self.strict else _NUMBER).match(text, at)
        if not m:
            raise Bad(at)
        self.at = m.end()
        return Raw(_number_text(m[0]))

    def string(self) -> str:
        m = _STRING[self.text[self.at]].match(self.text, self.at)
        if not m:
            raise Bad(self.at)
        self.at = m.end()
        return _unescape(m[1])

    def items(self, close: str, one) -> Iterator:
        self.at += 1
        self.space()
        while not self.text.startswith(close, self.at):
            yield one()
            self.space()
            if self.text.startswith(",", self.at):
                self.at += 1
                self.space()
                if self.strict and self.text.startswith(close, self.at):
                    raise Bad(self.at)
            elif not self.text.startswith(close, self.at):
                raise Bad(self.at)
        self.at += 1

    def array(self) -> list:
        return list(self.items("]", self.value))

    def object(self) -> Pairs:
        return Pairs(self.items("}", self.member))

    def member(self) -> tuple:
        self.space()
        if self.text[self.at : self.at + 1] in ('"', "'"):
            key = self.string()
        else:
            m = None if self.strict else _WORD.match(self.text, self.at)
            if not m:
                raise Bad(self.at)
            self.at, key = m.end(), m[0]
        self.space()
        if not self.text.startswith(":", self.at):
            raise Bad(self.at)
        self.at += 1
        return key, self.value()


def _number_text(raw: str) -> str:
    raw = raw.lstrip("+")
    sign, digits = ("-", raw[1:]) if raw.startswith("-") else ("", raw)
    if digits[:2].lower() == "0x":
        return sign + str(int(digits, 16))
    if digits in ("Infinity", "inf"):
        return sign + "9e999"
    if digits == "NaN":
        return "null"
    if digits.startswith("."):
        digits = "0" + digits
    return sign + re.sub(r"\.(?=[eE]|$)", ".0", digits)


def parse(text: str):
    return Reader(text).whole()


def dump(v, indent: str | None = None, level: int = 0) -> str:
    if isinstance(v, Raw):
        return str(v)
    if isinstance(v, str):
        return json.dumps(v, ensure_ascii=False)
    if v is None or isinstance(v, bool):
        return {None: "null", True: "true", False: "false"}[v]
    if not v:
        return "{}" if isinstance(v, Pairs) else "[]"
    opening, closing = "{}" if isinstance(v, Pairs) else "[]"
    if indent is None:
        parts = [f"{json.dumps(k, ensure_ascii=False)}:{dump(x)}" for k, x in v] if isinstance(v, Pairs) else [dump(x) for x in v]
        return opening + ",".join(parts) + closing
    pad, end = "\n" + indent * (level + 1), "\n" + indent * level
    parts = [f"{json.dumps(k, ensure_ascii=False)}: {dump(x, indent, level + 1)}" for k, x in v] if isinstance(v, Pairs) else [dump(x, indent, level + 1) for x in v]
    return opening + pad + ("," + pad).join(parts) + end + closing


_STEP = re.compile(r'\.(?:"((?:[^"\\]|\\.)*)"|([^.\[]+))|\[(#)?(-)?(\d*)\]')


def steps(path: str) -> list[str | int | tuple]:
    """A path's steps: names, places, and (n,) for places from the end."""
    if not path.startswith("$"):
        raise ValueError(f"bad JSON path: {path!r}")
    out, at = [], 1
    while at < len(path):
        m = _STEP.match(path, at)
        if not m:
            raise ValueError(f"bad JSON path: {path!r}")
        if m[1] is not None or m[2] is not None:
            out.append(_unescape(m[1]) if m[1] is not None else m[2])
        elif m[3]:
            out.append((int(m[5] or 0),))
        else:
            out.append(int(m[5]))
        at = m.end()
    return out


_ABSENT = object()


def step_into(v, step):
    if isinstance(step, str):
        return next((x for k, x in v if k == step), _ABSENT) if isinstance(v, Pairs) else _ABSENT
    if not isinstance(v, list) or isinstance(v, Pairs):
        return _ABSENT
    at = len(v) - step[0] if isinstance(step, tuple) else step
    return v[at] if 0 <= at < len(v) else _ABSENT


def find(v, path: str):
    for s in steps(path):
        v = step_into(v, s)
        if v is _ABSENT:
            break
    return v


def shown(v) -> str | None:
    """A value as SQL text: strings bare, truth values as 1 and 0."""
    if v is None or v is _ABSENT:
        return None
    if isinstance(v, bool):
        return "1" if v else "0"
    return str(v) if isinstance(v, str) else dump(v)


def _lenient(fn):
    """Malformed documents and paths give None."""

    def safe(*args):
        try:
            return fn(*args)
        except (ValueError, RecursionError):
            return None

    return safe


def extract(text: str, path: str) -> str | None:
    return shown(find(parse(text), path))


def raw(text: str, path: str) -> str | None:
    v = find(parse(text), path)
    return None if v is _ABSENT else dump(v)


def extract_many(text: str, paths: list[str]) -> str:
    doc = parse(text)
    found = [find(doc, p) for p in paths]
    return dump([None if v is _ABSENT else v for v in found])


def _put(v, path: list, value, insert: bool, replace: bool):
    if not path:
        return value if replace else v
    step, rest = path[0], path[1:]
    have = step_into(v, step)
    if have is not _ABSENT:
        new = _put(have, rest, value, insert, replace)
    elif insert:
        new = _made(rest, value)
    else:
        return v
    if isinstance(step, str) and isinstance(v, Pairs):
        if have is _ABSENT:
            return Pairs([*v, (step, new)])
        at = next(i for i, (k, _) in enumerate(v) if k == step)
        return Pairs([*v[:at], (step, new), *v[at + 1 :]])
    if not isinstance(step, str) and isinstance(v, list) and not isinstance(v, Pairs):
        at = len(v) - step[0] if isinstance(step, tuple) else step
        if have is _ABSENT:
            return [*v, new] if at == len(v) else v
        return [*v[:at], new, *v[at + 1 :]]
    return v


def _made(path: list, value):
    if not path:
        return value
    inner = _made(path[1:], value)
    return Pairs([(path[0], inner)]) if isinstance(path[0], str) else [inner]


def _edit(insert: bool, replace: bool):
    def run(text: str, pairs: list[str]) -> str:
        doc = parse(text)
        for i in range(0, len(pairs) - 1, 2):
            doc = _put(doc, steps(json.loads(pairs[i])), parse(pairs[i + 1]), insert, replace)
        return dump(doc)

    return run


def remove(text: str, paths: list[str]) -> str | None:
    doc = parse(text)

    def without(v, path):
        step = path[0]
        have = step_into(v, step)
        if have is _ABSENT:
            return v
        if isinstance(step, str):
            at = next(i for i, (k, _) in enumerate(v) if k == step)
            return Pairs([*v[:at], *([] if len(path) == 1 else [(step, without(have, path[1:]))]), *v[at + 1 :]])
        at = len(v) - step[0] if isinstance(step, tuple) else step
        return [*v[:at], *([] if len(path) == 1 else [without(have, path[1:])]), *v[at + 1 :]]

    for p in paths:
        found = steps(p)
        if not found:
            return None
        doc = without(doc, found)
    return dump(doc)


def patch(target, change):
    """Merge patch: members of null are removed, objects merge, all else replaces."""
    if not isinstance(change, Pairs):
        return change
    out = Pairs(target) if isinstance(target, Pairs) else Pairs()
    for k, v in change:
        at = next((i for i, (have, _) in enumerate(out) if have == k), None)
        if v is None:
            if at is not None:
                del out[at]
        elif at is None:
            out.append((k, patch(None, v)))
        else:
            out[at] = (k, patch(out[at][1], v))
    return out


def kind(v) -> str | None:
    if v is _ABSENT:
        return None
    if v is None or isinstance(v, bool):
        return {None: "null", True: "true", False: "false"}[v]
    if isinstance(v, Raw):
        return "integer" if re.fullmatch(r"-?\d+", v) else "real"
    return "text" if isinstance(v, str) else "object" if isinstance(v, Pairs) else "array"


def valid(text: str) -> bool:
    try:
        Reader(text, strict=True).whole()
        return True
    except (ValueError, RecursionError):
        return False


def error_position(text: str) -> int:
    try:
        parse(text)
        return 0
    except Bad as e:
        return e.at + 1


def array_length(text: str, path: str) -> int | None:
    v = find(parse(text), path)
    return None if v is _ABSENT else len(v) if isinstance(v, list) and not isinstance(v, Pairs) else 0


def pretty(text: str, indent: str) -> str:
    return dump(parse(text), indent)


def _key_path(base: str, key) -> str:
    if isinstance(key, int):
        return f"{base}[{key}]"
    return f"{base}.{key}" if re.fullmatch(r"[A-Za-z]\w*", key) else f"{base}.{json.dumps(key, ensure_ascii=False)}"


def walk(text: str | None, path: str, deep: bool) -> Iterator[tuple]:
    """Rows of json_each or (deep) json_tree."""
    if text is None:
        return
    try:
        root = find(parse(text), path)
    except ValueError:
        return
    if root is _ABSENT:
        return
    number = 0

    def row(key, v, me: int, parent, full: str, base: str) -> tuple:
        nested = isinstance(v, list)
        return (None if key is None else str(key), dump(v) if nested else shown(v), kind(v), None if nested else shown(v), me, parent, full, base)

    def below(v):
        return list(v) if isinstance(v, Pairs) else list(enumerate(v)) if isinstance(v, list) else []

    def visit(key, v, parent, full, base):
        nonlocal number
        me = number
        number += 1
        yield row(key, v, me, parent, full, base)
        for k, x in below(v):
            yield from visit(k, x, me, _key_path(full, k), full)

    if deep:
        yield from visit(None, root, None, path, path)
    elif isinstance(root, list):
        for n, (k, x) in enumerate(below(root), 1):
            yield row(k, x, n, None, _key_path(path, k), path)
    else:
        yield row(None, root, 0, None, path, path)


_ROW = "key string, value string, type string, atom string, id bigint, parent bigint, fullkey string, path string"


class JsonEach:
    def eval(self, text: str, path: str):
        yield from walk(text, path, False)


class JsonTree:
    def eval(self, text: str, path: str):
        yield from walk(text, path, True)


def register(spark) -> None:
    from pyspark.sql.functions import udtf

    register_all(
        spark,
        {
            "s_json": (_lenient(lambda t: dump(parse(t))), "string", 1), "s_json_extract": (_lenient(extract), "string", 2), "s_json_raw": (_lenient(raw), "string", 2), "s_json_extract_many": (_lenient(extract_many), "string", 2),
            "s_json_set": (_lenient(_edit(True, True)), "string", 2), "s_json_insert": (_lenient(_edit(True, False)), "string", 2), "s_json_replace": (_lenient(_edit(False, True)), "string", 2), "s_json_remove": (_lenient(remove), "string", 2),
            "s_json_patch": (_lenient(lambda a, b: dump(patch(parse(a), parse(b)))), "string", 2), "s_json_valid": (valid, "boolean", 1), "s_json_type": (_lenient(lambda t, p: kind(find(parse(t), p))), "string", 2),
            "s_json_array_length": (_lenient(array_length), "bigint", 2), "s_json_pretty": (_lenient(pretty), "string", 2), "s_json_error_position": (error_position, "bigint", 1),
        },
    )
    spark.udtf.register("s_json_each", udtf(JsonEach, returnType=_ROW))
    spark.udtf.register("s_json_tree", udtf(JsonTree, returnType=_ROW))
