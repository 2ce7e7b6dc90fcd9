"""Full-text search: tsvector and tsquery as canonical texts, matching, ranking and headlines."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import lru_cache

from strataql.plans.typed import literal

from .arrow import register_all

# The English stop words.
STOP_WORDS = frozenset(
    """a about above after again against all am an and any are arent as at be because been before being below between both but by can cannot cant could couldnt did didnt do does doesnt doing dont down
    during each few for from further had hadnt has hasnt have havent having he her here hers herself him himself his how i if in into is isnt it its itself just me more most mustnt my myself no nor not of
    off on once only or other ought our ours ourselves out over own same shant she should shouldnt so some such than that the their theirs them themselves then there these they this those through to too
    under until up very was wasnt we were werent what when where which while who whom why will with wont would wouldnt you your yours yourself yourselves""".split()
)

_WORD = re.compile(r"[^\W_](?:[^\W_]|')*")
#: the same words and their possessive ending as Java's patterns
WORD_PATTERN, POSSESSIVE = r"[\p{L}\p{N}][\p{L}\p{N}']*", "'s$"
#: endings of words, as in the public description of Porter's second English stemmer
VOWELS, SIBILANTS, DOUBLES, NO_SHORT = "aeiouy", ("s", "x", "z", "ch", "sh"), {"bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"}, "wxY"
#: endings that go where they lie in the region R1 and STEM letters stay
ENDINGS, STEM = ("ment", "ness", "ly"), 4
# Words whose stems differ from the rules.
IRREGULAR = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "atlas": "atlas", "bias": "bias", "lens": "lens"}


def _region(word: str) -> int:
    """Where R1 begins: after the first consonant that follows a vowel."""
    return next((i + 1 for i in range(1, len(word)) if word[i - 1] in VOWELS and word[i] not in VOWELS), len(word))


def _is_short(word: str) -> bool:
    """A short word ends in a short syllable and has no R1."""
    if _region(word) < len(word):
        return False
    if len(word) == 2:
        return word[0] in VOWELS and word[1] not in VOWELS
    return len(word) > 2 and word[-3] not in VOWELS and word[-2] in VOWELS and word[-1] not in VOWELS + NO_SHORT


def _singular(word: str) -> str:
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith(("ies", "ied")):
        return word[:-2] if len(word) > 4 else word[:-1]
    if word.endswith("es") and word[:-2].endswith(SIBILANTS):
        return word[:-2]
    if word.endswith("s") and not word.endswith(("ss", "us")) and any(c in VOWELS for c in word[:-2]):
        return word[:-1]
    return word


def _present(word: str) -> str:
    for ending in ("eedly", "eed"):
        if word.endswith(ending):
            return word[: len(word) - len(ending)] + "ee" if len(word) - len(ending) >= _region(word) else word
    for ending in ("ingly", "edly", "ing", "ed"):
        base = word.removesuffix(ending)
        if base != word:
            if not any(c in VOWELS for c in base):
                return word
            if base.endswith(("at", "bl", "iz")) or _is_short(base):
                return base + "e"
            return base[:-1] if base[-2:] in DOUBLES else base
    return word


@lru_cache(100_000)
def stem(word: str) -> str:
    """Plural, past and participle endings and a final y by Porter's second stemmer (its steps 1a to 1c), and ``ENDINGS``.

    Its other steps are left out, as the dialect keeps derived words apart (source stays whole); so an
    e that a plural puts behind a sibilant goes with the plural.
    """
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) < 3:
        return word
    marked = "".join("Y" if c == "y" and (not i or word[i - 1] in VOWELS) else c for i, c in enumerate(word))
    marked = _present(_singular(marked))
    for ending in ENDINGS:
        cut = len(marked) - len(ending)
        if marked.endswith(ending) and cut >= max(STEM, _region(marked)):
            marked = marked[:cut]
            break
    if marked.endswith(("y", "Y")) and len(marked) > 2 and marked[-2] not in VOWELS:
        marked = marked[:-1] + "i"
    return marked.lower()


def tokens(text: str) -> list[tuple[str, int, int, int]]:
    """(word, position from 1, start, end) of each word; a possessive 's and apostrophes go."""
    out = []
    for n, m in enumerate(_WORD.finditer(text), 1):
        word = m[0].lower()
        out.append((word.removesuffix("'s").replace("'", ""), min(n, 16383), m.start(), m.end()))
    return out


def lexeme(config: str, word: str) -> str | None:
    name = config.rsplit(".", 1)[-1].strip().lower()
    if name == "simple":
        return word
    if name != "english":
        raise ValueError(f'text search configuration "{config}" is not recognized (supported: english, simple)')
    return None if word in STOP_WORDS else stem(word)


Vector = dict[str, list[int]]


def vector(config: str, text: str) -> Vector:
    out: Vector = {}
    for word, at, _, _ in tokens(text):
        if word and (x := lexeme(config, word)):
            out.setdefault(x, []).append(at)
    return out


def _quoted(word: str) -> str:
    return "'" + word.replace("\\", "\\\\").replace("'", "''") + "'"


def render(v: Vector) -> str:
    return " ".join(_quoted(w) + (":" + ",".join(map(str, sorted(set(at)))) if at else "") for w, at in sorted(v.items()))


_ENTRY = re.compile(r"\s*'((?:[^']|'')*)'(?::([\d,]+))?|\s*([^\s':]+)(?::([\d,]+))?")


@lru_cache(4096)
def parse_vector(text: str) -> Vector:
    out: Vector = {}
    for m in _ENTRY.finditer(text):
        word = m[1].replace("''", "'").replace("\\\\", "\\") if m[1] is not None else m[3]
        out.setdefault(word, []).extend(int(x) for x in (m[2] or m[4] or "").split(",") if x)
    return out


@dataclass(frozen=True)
class Word:
    text: str
    prefix: bool = False


@dataclass(frozen=True)
class Node:
    op: str  # & | ! <->
    parts: tuple
    gap: int = 1


_RANK = {"|": 1, "&": 2, "<->": 3, "!": 4}
_QTOKEN = re.compile(r"\s*(?:'((?:[^']|'')*)'|(<->|<\d+>|[&|!()])|([^\s&|!()<':]+(?:'[^\s&|!()<':]+)*))(:\*?[a-dA-D]*\*?)?")


class _QueryParser:
    """Precedence climbing over ! <-> & |; stop words drop out of the tree."""

    def __init__(self, config: str | None, text: str):
        self.config, self.items, at = config, [], 0
        text = text.strip()
        while at < len(text):
            m = _QTOKEN.match(text, at)
            if not m or m.end() == at:
                raise ValueError(f"syntax error in tsquery: {text!r}")
            self.items.append(("op", m[2], False) if m[2] else ("word", (m[1] or "").replace("''", "'") if m[1] is not None else m[3], "*" in (m[4] or "")))
            at = m.end()
        self.at = 0

    def whole(self):
        out = self.level(1)
        if self.at < len(self.items):
            raise ValueError("syntax error in tsquery")
        return out

    def level(self, rank: int):
        left = self.unary()
        while self.at < len(self.items) and self.items[self.at][0] == "op" and self.items[self.at][1] not in "()!":
            op = self.items[self.at][1]
            name, gap = ("<->", 1 if op == "<->" else int(op[1:-1])) if op[0] == "<" else (op, 1)
            if _RANK[name] < rank:
                break
            self.at += 1
            right = self.level(_RANK[name] + 1)
            left = right if left is None else left if right is None else Node(name, (left, right), gap)
        return left

    def unary(self):
        if self.at >= len(self.items):
            raise ValueError("syntax error in tsquery")
        kind, value, prefix = self.items[self.at]
        self.at += 1
        if kind == "op" and value == "!":
            inner = self.unary()
            return None if inner is None else Node("!", (inner,))
        if kind == "op" and value == "(":
            inner = self.level(1)
            if self.at >= len(self.items) or self.items[self.at][1] != ")":
                raise ValueError("syntax error in tsquery")
            self.at += 1
            return inner
        if kind != "word":
            raise ValueError("syntax error in tsquery")
        if self.config is None:
            return Word(value, prefix)
        found = [Word(x, prefix) for w, *_ in tokens(value) if w and (x := (w if prefix and lexeme(self.config, w) is None else lexeme(self.config, w)))]
        return _folded("<->", found)


def _folded(op: str, parts: list):
    out = None
    for p in parts:
        out = p if out is None else Node(op, (out, p))
    return out


def render_query(q) -> str:
    if isinstance(q, Word):
        return _quoted(q.text) + (":*" if q.prefix else "")

    def inner(p) -> str:
        s = render_query(p)
        return f"({s})" if isinstance(p, Node) and _RANK[p.op] < _RANK[q.op] else s

    if q.op == "!":
        return "!" + inner(q.parts[0])
    sign = q.op if q.op != "<->" or q.gap == 1 else f"<{q.gap}>"
    return f" {sign} ".join(inner(p) for p in q.parts)


@lru_cache(4096)
def parse_query(text: str, config: str | None = None):
    return _QueryParser(config, text).whole()


def to_tsquery(config: str, text: str) -> str:
    q = parse_query(text, config)
    if q is None:
        raise ValueError("text-search query contains only stop words or doesn't contain lexemes")
    return render_query(q)


def _words(config: str, text: str) -> list[Word]:
    return [Word(x) for w, *_ in tokens(text) if w and (x := lexeme(config, w))]


def plain(op: str):
    def make(config: str, text: str) -> str:
        q = _folded(op, _words(config, text))
        return render_query(q) if q is not None else ""

    return make


def websearch(config: str, text: str) -> str:
    """Quoted phrases, OR and -word; everything else is joined by &."""
    groups: list[list] = [[]]
    for m in re.finditer(r'(-?)(?:"([^"]*)"|(\S+))', text):
        if m[3] is not None and m[3].upper() == "OR" and not m[1]:
            groups.append([])
            continue
        q = _folded("<->", _words(config, m[2] if m[2] is not None else m[3]))
        if q is not None:
            groups[-1].append(Node("!", (q,)) if m[1] else q)
    q = _folded("|", [g for g in (_folded("&", g) for g in groups) if g is not None])
    return render_query(q) if q is not None else ""


def _ends(v: Vector, q) -> set[int]:
    """Positions where a word or phrase ends."""
    if isinstance(q, Word):
        return {p for w, at in v.items() if (w.startswith(q.text) if q.prefix else w == q.text) for p in at}
    if q.op == "<->":
        left, right = _ends(v, q.parts[0]), _ends(v, q.parts[1])
        return {p for p in right if p - q.gap in left}
    if q.op == "|":
        return _ends(v, q.parts[0]) | _ends(v, q.parts[1])
    if q.op == "&":
        return _ends(v, q.parts[0]) & _ends(v, q.parts[1])
    return {p for at in v.values() for p in at} - _ends(v, q.parts[0])


def matches(v: Vector, q) -> bool:
    if q is None:
        return False
    if isinstance(q, Word):
        return any(w.startswith(q.text) for w in v) if q.prefix else q.text in v
    if q.op == "!":
        return not matches(v, q.parts[0])
    if q.op == "<->":
        return bool(_ends(v, q))
    return (any if q.op == "|" else all)(matches(v, p) for p in q.parts)


def positive(q) -> list[Word]:
    if isinstance(q, Word):
        return [q]
    return [] if q is None or q.op == "!" else [w for p in q.parts for w in positive(p)]


def rank(v: Vector, q, damping: float = 0.1, weight: float = 0.1) -> float:
    total = 0.0
    for w in positive(q):
        if any(x.startswith(w.text) for x in v) if w.prefix else w.text in v:
            total += weight * (1 + math.log(max(1, len(v.get(w.text, ())))))
    return total / (1 + min(abs(damping), 16) * max(1, sum(map(len, v.values()))))


def headline(config: str, text: str, q) -> str:
    wanted, out, at = positive(q), "", 0
    for word, _, start, end in tokens(text):
        x = lexeme(config, word) if word else None
        if x and any(x.startswith(w.text) if w.prefix else x == w.text for w in wanted):
            out += f"{text[at:start]}<b>{text[start:end]}</b>"
            at = end
    return out + text[at:]


def joined(a: str, b: str) -> str:
    x, y = parse_vector(a), parse_vector(b)
    shift = max((p for at in x.values() for p in at), default=0)
    out = {w: list(at) for w, at in x.items()}
    for w, at in y.items():
        out.setdefault(w, []).extend(p + shift for p in at)
    return render(out)


def nodes(q) -> int:
    return 0 if q is None else 1 if isinstance(q, Word) else 1 + sum(map(nodes, q.parts))


def parsed(text: str):
    """The tree of a canonical query, None of an empty one."""
    return parse_query(text) if text.strip() else None


#: the makers of queries, by the dialect's names
QUERIES = {"to_tsquery": to_tsquery, "plainto_tsquery": plain("&"), "phraseto_tsquery": plain("<->"), "websearch_to_tsquery": websearch}


@lru_cache(4096)
def bare_query(query: str):
    """A query of bare words (all needed), phrases, AND, OR, NOT and word*."""
    sql = re.sub(r"\bAND\b", "&", re.sub(r"\bOR\b", "|", re.sub(r"\bNOT\b", "&!", query)))
    sql = re.sub(r'"([^"]*)"', lambda m: "(" + " <-> ".join(m[1].split()) + ")", sql)
    sql = re.sub(r"(\w)\*", r"\1:*", sql)
    sql = re.sub(r"(?<=[\w)*])\s+(?=[\w(])", " & ", re.sub(r"\s*(<->|[&|!])\s*", r"\1", sql))
    return parse_query(sql, "simple")


def fts_match(text: str, query: str) -> bool:
    return matches(vector("simple", text), bare_query(query))


def _needed(q) -> list[str]:
    """ASCII words without which nothing matches."""
    if isinstance(q, Word):
        return [q.text] if q.text.isascii() else []
    return [w for p in q.parts for w in _needed(p)] if q.op == "&" else []


def _over_words(q) -> str | None:
    """The condition of a query over an array d of words; None for a phrase."""
    if isinstance(q, Word):
        return f"exists(d, x -> startswith(x, {literal(q.text)}))" if q.prefix else f"array_contains(d, {literal(q.text)})"
    parts = [_over_words(p) for p in q.parts]
    if q.op == "<->" or None in parts:
        return None
    return f"(NOT {parts[0]})" if q.op == "!" else f"({(' OR ' if q.op == '|' else ' AND ').join(parts)})"


def native_match(text: str, q) -> str | None:
    """Spark SQL for ``matches`` of a text's simple vector; None where built-in functions don't express it.

    A text without the needed words isn't split; apostrophes go first, as they do from words.
    """
    if q is None:
        return f"CASE WHEN {text} IS NOT NULL THEN FALSE END"
    inside = _over_words(q)
    if inside is None:
        return None
    pieces = f"regexp_extract_all({text}, {literal(WORD_PATTERN)}, 0)"
    words = f"filter(transform({pieces}, w -> replace(regexp_replace(lower(w), {literal(POSSESSIVE)}, ''), {literal(chr(39))}, '')), w -> w <> '')"
    missing = "".join(f" WHEN NOT contains(replace(lower({text}), {literal(chr(39))}, ''), {literal(w)}) THEN FALSE" for w in _needed(q))
    return f"CASE WHEN {text} IS NULL THEN NULL{missing} ELSE transform(array({words}), d -> {inside})[0] END"


def register(spark) -> None:
    register_all(
        spark,
        {
            "s_to_tsvector": (lambda c, t: render(vector(c, t)), "string", 2), **{f"s_{name}": (make, "string", 2) for name, make in QUERIES.items()},
            "s_ts_match": (lambda v, q: matches(parse_vector(v), parsed(q)), "boolean", 2), "s_ts_rank": (lambda v, q, d: rank(parse_vector(v), parsed(q), d), "double", 3),
            "s_ts_strip": (lambda v: render(dict.fromkeys(parse_vector(v), [])), "string", 1), "s_numnode": (lambda q: nodes(parsed(q)), "bigint", 1), "s_tsvector_concat": (joined, "string", 2),
            "s_ts_headline": (lambda t, q: headline("english", t, parsed(q)), "string", 2), "s_fts_match": (fts_match, "boolean", 2),
        },
    )
