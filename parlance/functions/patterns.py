"""Wildcard keywords as Java regular expressions.

``*x*`` matches inside words, ``*x`` and ``x*`` at their end or start, ``x`` whole words; a ``*`` inside stands for word
characters. ``(?iU)`` makes case, ``\\w`` and ``\\b`` follow Unicode.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
import zlib
from dataclasses import dataclass, field
from functools import cache

#: What may follow a keyword: the end of a word, or white space, a dot, a comma or the end of the text.
END = r"(?:\b|(?=\s|\.|,|$))"
EDGES = {"sentence": (r"\b", END), "word": (r"\b", r"\b"), "space": (r"\s", r"(?:\s|\.|,)")}


def wildcard_regex(keyword: str, edges: str = "sentence") -> str:
    """The pattern of one keyword; ``edges`` names what stands for the border of a word."""
    before, after = EDGES[edges]
    word = keyword.strip()
    left, right = word.startswith("*"), word.endswith("*") and len(word) > 1
    core = word[1 if left else 0 : -1 if right else None]
    if edges == "space":
        body = re.escape(core)
    else:
        body = r"\w*".join(re.escape(part) for part in core.split("*"))
    if left and right:
        return f"(?iU){body}"
    if left:
        return rf"(?iU)\w*{body}{after}"
    if right:
        return rf"(?iU){before}{body}\w*"
    return f"(?iU){before}{body}{after}"


def valid_patterns(spark, keywords: list[str], edges: str = "sentence") -> tuple[dict[str, str], list[str]]:
    """Patterns that the JVM compiles, by keyword, and the keywords whose patterns it refuses."""
    good, bad = {}, []
    compiler = spark.sparkContext._jvm.java.util.regex.Pattern
    for keyword in keywords:
        pattern = wildcard_regex(keyword, edges)
        try:
            compiler.compile(pattern)
        except Exception:  # the JVM's PatternSyntaxException
            bad.append(keyword)
        else:
            good[keyword] = pattern
    return good, bad


def sql_quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


# An index of patterns: each keyword is found by one piece of itself, so that a text is compared only with the keywords
# that share a piece with it, however many there are.

#: Characters of a piece at the start or end of a word, and inside one.
EDGE, INSIDE = 4, 3
#: Bytes that an index may have: it goes with every task.
MOST_BYTES = 32 << 20
#: Keywords up to which one alternation of all patterns is the cheaper guard.
FEW = 16


@cache
def _case() -> tuple[str, str]:
    """Characters that differ from the lower case of their upper case, and these: what ``(?iU)`` compares."""
    one = lambda x, c: x if len(x) == 1 else c
    pairs = []
    for k in range(sys.maxunicode + 1):
        c = chr(k)
        up = one(c.upper(), c)
        low = up.lower()[0]  # one character has a mark behind its lower case
        if low != c and not 0xD800 <= k < 0xE000:
            pairs.append((c, low))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def folded(text: str) -> str:
    """SQL for a text in the case that patterns compare by, character by character."""
    return f"translate({text}, {sql_quote(_case()[0])}, {sql_quote(_case()[1])})"


@cache
def _folds() -> dict[int, int]:
    return str.maketrans(*_case())


def fold(text: str) -> str:
    return text.translate(_folds())


def _certain(c: str) -> bool:
    """Whether ``\\w`` surely holds the character."""
    return c == "_" or unicodedata.category(c) in ("Lu", "Ll", "Lt", "Lm", "Lo", "Nd")


def _outside(c: str) -> bool:
    """Whether ``\\w`` surely doesn't hold it: a word ends here."""
    return c.isspace() or c in "!\"#$%&'()+,-./:;<=>?@[]^`{|}~" or c == "\\"


def anchor(keyword: str, edges: str = "sentence") -> tuple[str, str] | None:
    """(kind, piece) that every match of a keyword holds: ``e`` a whole word, ``p4`` the first 4 characters of one, ``s4`` the last, ``i3`` any; null if it has no letters."""
    word = fold(keyword.strip())
    left, right = word.startswith("*"), word.endswith("*") and len(word) > 1
    core = word[1 if left else 0 : -1 if right else None]
    found: list[tuple[int, int, str, str]] = []
    for m in re.finditer(r"[^*]+" if edges != "space" else r"(?s).+", core):
        start = m.start()
        part = m.group()
        k = 0
        while k < len(part):
            if not _certain(part[k]):
                k += 1
                continue
            end = k
            while end < len(part) and _certain(part[end]):
                end += 1
            at = start + k
            before = core[at - 1] if at else None
            after = core[start + end] if start + end < len(core) else None
            opens = _outside(before) or (before == "*" and edges == "space") if before is not None else not left
            closes = _outside(after) or (after == "*" and edges == "space") if after is not None else not right
            piece = part[k:end]
            if opens and closes:
                found.append((3, len(piece), "e", piece))
            elif opens:
                found.append((2, len(piece), f"p{min(EDGE, len(piece))}", piece[:EDGE]))
            elif closes:
                found.append((2, len(piece), f"s{min(EDGE, len(piece))}", piece[-EDGE:]))
            else:
                found.append((1, len(piece), f"i{min(INSIDE, len(piece))}", piece[:INSIDE]))
            k = end
    if not found:
        return None
    _, _, kind, piece = max(found, key=lambda x: (min(x[1], EDGE), x[0], x[1]))
    return kind, piece


def plain(keyword: str) -> tuple[str, str] | None:
    """(kind, letters) of a keyword that is one word: whole (``e``), the start (``p``) or the end (``s``) of one. Its matches are the words that it fits, so no pattern need run."""
    word = keyword.strip()
    left, right = word.startswith("*"), word.endswith("*") and len(word) > 1
    core = word[1 if left else 0 : -1 if right else None]
    if not core or (left and right) or not all(map(_certain, core + fold(core))):
        return None
    return "s" if left else "p" if right else "e", fold(core)


def word_hits(keywords: list[str], text: str, folded_text: str) -> str:
    """SQL for structs of a ``plain`` keyword ``k`` and one word ``h`` that it matches; a word looks for keywords by a piece of itself."""
    found: dict[str, list[dict]] = {}
    for k in keywords:
        kind, core = plain(k)
        found.setdefault(kind if kind == "e" else f"{kind}{min(EDGE, len(core))}", []).append({"c": core, "k": k})
    parts, held = [], 0
    for kind, entries in sorted(found.items()):
        n = int(kind[1:] or 0)
        cut = (lambda x: x[:n]) if kind[0] == "p" else (lambda x: x[-n:]) if kind[0] == "s" else (lambda x: x)  # noqa: B023
        size = 1 << (2 * len(entries)).bit_length()
        buckets: list[list[dict]] = [[] for _ in range(size)]
        for e in entries:
            buckets[zlib.crc32(cut(e["c"]).encode()) % size].append(e)
        held += len(table := json.dumps(buckets))
        piece = {"e": "w.f", "p": f"left(w.f, {n})", "s": f"right(w.f, {n})"}[kind[0]]
        fits = {"e": "w.f = e.c", "p": "startswith(w.f, e.c)", "s": "endswith(w.f, e.c)"}[kind[0]]
        bucket = f"from_json({sql_quote(table)}, 'array<array<struct<c:string,k:string>>>')[cast(crc32(cast({piece} as binary)) % {size} as int)]"
        parts.append(f"transform(filter({bucket}, e -> {fits}), e -> named_struct('k', e.k, 'h', array(w.o)))")
    if held > MOST_BYTES:
        raise ValueError(f"the index of {len(keywords)} words takes {held} bytes, more than {MOST_BYTES}: split the dictionary")
    words = lambda x: f"regexp_extract_all({x}, {sql_quote(r'(?U)\w+')}, 0)"
    both = f"zip_with({words(text)}, {words(folded_text)}, (o, f) -> named_struct('o', o, 'f', f))"
    return f"flatten(transform({both}, w -> concat({', '.join(parts)})))"


@dataclass
class PatternIndex:
    """Keywords in buckets by the checksum of their pieces, as SQL literals; ``always`` are those without a piece."""

    keywords: list[str]
    edges: str = "sentence"
    kinds: list[str] = field(default_factory=list)
    always: list[int] = field(default_factory=list)
    buckets: list[list[dict]] = field(default_factory=list)

    def __post_init__(self):
        anchors = [anchor(k, self.edges) for k in self.keywords]
        self.always = [n for n, a in enumerate(anchors) if a is None]
        keys = [(a[0] + a[1], n) for n, a in enumerate(anchors) if a is not None]
        self.kinds = sorted({a[0] for a in anchors if a is not None})
        size = 1
        while size < 2 * len(keys):
            size *= 2
        self.buckets = [[] for _ in range(size)]
        for key, n in keys:
            self.buckets[zlib.crc32(key.encode()) % size].append({"key": key, "n": n})
        if (held := len(self._json())) > MOST_BYTES:
            raise ValueError(f"the index of {len(self.keywords)} patterns takes {held} bytes, more than {MOST_BYTES}: split the dictionary")

    def _json(self) -> str:
        return json.dumps(self.buckets) + json.dumps(self._patterns())

    def _patterns(self) -> list[dict]:
        return [{"k": k, "p": wildcard_regex(k, self.edges)} for k in self.keywords]

    def candidates(self, folded_text: str) -> str:
        """SQL for the keywords ``k`` with their patterns ``p``, in order, that share a piece with a text in ``folded`` case."""
        scan = {"e": r"(?U)(?<!\w)\w+", "p": r"(?U)(?<!\w)\w{N}", "s": r"(?U)\w{N}(?!\w)", "i": r"(?U)(?=(\w{N}))"}
        parts = []
        for kind in self.kinds:
            pattern = scan[kind[0]].replace("N", kind[1:])
            parts.append(f"transform(regexp_extract_all({folded_text}, {sql_quote(pattern)}, {int(kind[0] == 'i')}), x -> concat('{kind}', x))")
        numbers = f"array({', '.join(map(str, self.always))})" if self.always else "cast(array() as array<int>)"
        if parts:
            table = f"from_json({sql_quote(json.dumps(self.buckets))}, 'array<array<struct<key:string,n:int>>>')"
            bucket = f"{table}[cast(crc32(cast(x as binary)) % {len(self.buckets)} as int)]"
            numbers = f"concat({numbers}, flatten(transform(array_distinct(concat({', '.join(parts)})), x -> transform(filter({bucket}, e -> e.key = x), e -> e.n))))"
        patterns = f"from_json({sql_quote(json.dumps(self._patterns()))}, 'array<struct<k:string,p:string>>')"
        return f"transform(array_sort(array_distinct({numbers})), n -> {patterns}[n])"
