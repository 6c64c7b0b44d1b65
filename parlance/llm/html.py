"""HTML extraction by equivalence-class template deduction.

Each page is parsed once, into a row of tokens: tags and the strings between them, each told apart by the path of tags above it. Over the pages of one host each
token has an occurrence vector: how often it stands on each page. Tokens with the same vector form an equivalence class;
large and frequent classes are the template that the host fills in. Vectors are compared by a sum of prints of
(page, count), which Spark adds up on the map side first, so a host with a third of all pages is no heavier than its
number of different tokens. A host may have many classes, each on some of its pages: layouts, notices, sections. All tokens of
a class stand on the same pages, so their mean places give its order; tags and strings carry their path, so opening and closing
tags of one element fall into one class and enclose what is nested in it.

Classes are nested by their support: a token of a rarer class has to stand in the same gap of each more frequent class (between the same two
of its tokens) on ``SURE_GAP`` of the pages that hold both, else it moves about freely and is no part of the template. On each page every class that the page holds is
put in order by itself, and those of its tokens count that stand in it. What stands between template tokens are slots. Slots
inside menus, footers, adverts and the like (by the tags and class names on their path) are dropped, strings that belong to
the template are dropped, and what is left is the page's own text.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.scratch import stash

#: Different pages that a class must stand on, tokens that it must have, share of the host's pages with tokens that must hold it.
LEAST_PAGES, LEAST_TOKENS, LEAST_SUPPORT = 3, 2, 0.1
#: A class may be any share of its pages' text if it stands on ``SURE_SUPPORT`` of a host of ``LEAST_DIFFERENT`` different pages;
#: else ``MOST_SHARE`` of the text outside furniture, or a few near copies would take their text for a template.
LEAST_DIFFERENT, SURE_SUPPORT, MOST_SHARE = 8, 0.5, 0.8
#: Share of the pages with both on which a token has to stand in one gap of a more frequent class.
SURE_GAP = 0.9
#: What an event of a page is to its text: a string, one in furniture, a space, the border of a block, another tag.
TEXT, ASIDE, SPACE, BORDER, TAG = range(5)
#: Prints of paths and short strings that a worker remembers.
REMEMBERED, LONGEST = 100_000, 60
#: Templates up to this size in all are broadcast; beyond, pages and templates meet in a salted join.
BROADCAST_BYTES, SALTS = 32 << 20, 32

# Elements by their role in HTML, and class or id words of page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose inside isn't parsed: it runs to their end tag.
RAW = frozenset("script style textarea title".split())
#: Elements that hold no text of the page; without an end tag of their own they hold nothing, and some can't stand in each other.
HIDDEN = frozenset("noscript template iframe svg object select button datalist canvas audio video".split())
NESTED = frozenset("template svg object".split())
HEAD = frozenset("base link meta noscript script style template title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FURNITURE = frozenset("nav footer aside form dialog menu fieldset label".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted related share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split()
)
MAIN_WORDS = frozenset("article-body article-content article__body entry-content post-content post-body story-body main-content articlebody".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)(>|\Z)", re.S)
NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW}
HIDDEN_NEXT = {name: re.compile(rf"<{'/' if name in NESTED else '(/?)'}{name}(?=[\s/>])", re.I) for name in HIDDEN}


def _print(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


_known: dict[tuple[int, str], int] = {}


def _path_print(above: int, name: str) -> int:
    """The print of a path with one name more; short ones are remembered."""
    found = _known.get((above, name))
    if found is None:
        found = _print(str(above), name)
        if len(name) <= LONGEST:
            if len(_known) >= REMEMBERED:
                _known.clear()
            _known[above, name] = found
    return found


class Element:
    __slots__ = ("furniture", "main", "name", "path")

    def __init__(self, name: str, attributes: str, above: Element | None):
        self.name = name
        words: set[str] = set()  # of class names, roles and ids, cut at hyphens
        classes: set[str] = set()  # whole class names and roles
        whole: set[str] = set()  # those, and ids
        label = name
        inside = bool(above and above.main)
        if attributes and "=" in attributes:
            for key, value in NAMES.findall(attributes):
                value, key = value.strip("\"'").lower(), key.lower()
                each = set(value.split())
                whole |= each
                if key != "id":
                    label += f"[{key}={value}]"
                    classes |= each
                if key != "id" or name not in HEADINGS and name != "section":
                    words |= set(re.split(r"[\s_-]+", value))
        self.path = _path_print(above.path if above else 0, label)
        self.main = inside or name in ("article", "main") or "main" in whole or bool(whole & MAIN_WORDS)
        # names tell furniture: in the main element and on headings whole class names only, on sections outside whole ids too
        if inside or name in HEADINGS:
            found = classes
        else:
            found = words | whole
        named = name not in ("html", "body", "article", "main")
        self.furniture = bool(above and above.furniture) or name in FURNITURE or name in HIDDEN or name == "head" or bool(named and found & FURNITURE_WORDS) or (not inside and (name == "header" or named and name not in HEADINGS and "header" in found))


def events(page: str) -> Iterator[tuple[str, Element | None, str]]:
    """("open" | "close", element, name) and ("text", element above, string) in page order."""
    stack: list[Element] = []
    at, n = 0, len(page)
    ends: dict[str, re.Match | None] = {}  # where hidden elements next end, or none do

    def pop_to(k: int):
        while len(stack) > k:
            gone = stack.pop()
            yield "close", gone, gone.name

    while at < n:
        m = TOKEN.search(page, at)
        between = page[at : m.start() if m else n]
        if between:
            if stack and stack[-1].name == "head" and not between.isspace():
                yield from pop_to(len(stack) - 1)
            yield "text", stack[-1] if stack else None, between
        if m is None:
            break
        at = m.end()
        name = m[2]
        if name is None or not m[4]:  # a comment, a declaration, or a tag that the page's end cuts off
            continue
        name = name.lower()
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].name == name:
                    yield from pop_to(k)
                    break
            continue
        if stack and (stack[-1].name == "head" and name not in HEAD or name == "body"):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].name == "head":
                    yield from pop_to(k)
                    break
        if name in CLOSES_P or name in ("li", "dt", "dd", "tr", "td", "th", "option"):
            closes = {"p"} if name in CLOSES_P else set()
            closes |= {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}.get(name, set())
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].name in closes:
                    yield from pop_to(k)
                    break
                if stack[k].name in BLOCK:
                    break
        element = Element(name, m[3], stack[-1] if stack else None)
        if name in VOID or m[3].endswith("/") and name not in BLOCK:
            yield "void", element, name
            continue
        if name in HIDDEN:
            end = ends[name] if name in ends and (ends[name] is None or ends[name].start() >= at) else HIDDEN_NEXT[name].search(page, at)
            ends[name] = end
            if end is None or name not in NESTED and not end[1]:
                yield "void", element, name
                continue
        if name in RAW:
            end = RAW_END[name].search(page, at)
            yield "open", element, name
            at = end.end() if end else n
            continue
        stack.append(element)
        yield "open", element, name
    yield from pop_to(0)


KINDS = {"open": 0x1F83D9ABFB41BD6B, "close": 0x5BE0CD19137E2179, "void": 0x3C6EF372FE94F82B}


def _token(kind: str, element: Element | None, value: str) -> int | None:
    """The print of one event; a string is one token, white space made even, a blank one none."""
    if kind == "text":
        value = " ".join(value.split())
        return _path_print(~element.path if element else -1, value) if value else None
    return element.path ^ KINDS[kind]


def parsed(page: str) -> tuple[list[int | None], bytes, list[str]]:
    """Token and kind of each event of a page, and the strings outside furniture."""
    tokens, kinds, texts = [], bytearray(), []
    for kind, element, value in events(page):
        tokens.append(_token(kind, element, value))
        if kind == "text":
            aside = element is not None and element.furniture
            kinds.append(ASIDE if aside else TEXT)
            if not aside:
                texts.append(value)
        else:
            kinds.append(SPACE if value == "br" else BORDER if value in BLOCK or value in RAW or value in HIDDEN else TAG)
    return tokens, bytes(kinds), texts


def page_tokens(tokens: list[int | None], kinds: bytes, texts: list[str]) -> tuple[dict[int, tuple[int, int, int]], int]:
    """Each token of a page with its count, the place where it first stands and its characters of text outside furniture; all such characters."""
    counts: dict[int, tuple[int, int, int]] = {}
    whole, strings_ = 0, iter(texts)
    for place, (token, kind) in enumerate(zip(tokens, kinds, strict=True)):
        own = len(next(strings_).strip()) if kind == TEXT else 0
        if token is not None:
            count, first, size = counts.get(token, (0, place, 0))
            counts[token] = (count + 1, first, size + own)
            whole += own
    return counts, whole


def in_order(found: list[int], template: dict[int, int]) -> frozenset[int]:
    """Tokens of one class that stand in its order (a longest such sequence)."""
    tops: list[int] = []  # least last rank of an ordered sequence, by its length
    where: list[tuple[int, int]] = []
    for t in found:
        k = bisect_left(tops, template[t])
        tops[k : k + 1] = [template[t]]
        where.append((k, t))
    kept, k = [], len(tops) - 1
    last = 1 << 62
    for length, t in reversed(where):
        if length == k and template[t] < last:
            kept.append(t)
            last, k = template[t], k - 1
    return frozenset(kept)


def template_tokens(tokens: list[int | None], template: dict[int, int]) -> set[int]:
    """Tokens of all classes that a page holds, each class in its own order; ``template`` maps tokens to class << 32 | rank."""
    found: dict[int, list[int]] = {}
    for t in tokens:
        if t in template:
            found.setdefault(template[t] >> 32, []).append(t)
    return {t for held in found.values() for t in in_order(held, template)}


def slots(tokens: list[int | None], kinds: bytes, texts: list[str], template: dict[int, int], between: str) -> str:
    """The strings of a parsed page's own slots, as blocks with ``between`` between them."""
    fixed = template_tokens(tokens, template) if template else ()
    blocks: list[str] = []
    parts: list[str] = []
    strings_ = iter(texts)

    def flush() -> None:
        text = " ".join(unescape("".join(parts)).split())
        if text:
            blocks.append(text)
        parts.clear()

    for token, kind in zip(tokens, kinds, strict=True):
        if kind == TEXT:
            value = next(strings_)
            if token not in fixed:
                parts.append(value)
        elif kind == SPACE:
            parts.append(" ")
        elif kind == BORDER and parts:
            flush()
    flush()
    return between.join(blocks)


def main_text(page: str, template: dict[int, int], between: str = "\n") -> str:
    """The text of one page; ``template`` maps tokens to class << 32 | rank."""
    return slots(*parsed(page), template, between)


def host(url: str = "url") -> str:
    return f"lower(regexp_extract(coalesce({url}, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"


def _marks(x: int) -> int:
    """One bit in each quarter of 64 for a page's print, so that the bits of several pages tell how many differ."""
    return sum(1 << (16 * k + (x >> 4 * k & 15)) for k in range(4))


def read(rows: DataFrame) -> DataFrame:
    """``__id, __url, host, page, content`` (print of the html), ``tokens, kinds, texts`` of every row (__id, __url, html, host, page)."""
    names = ["__id", "__url", "host", "page", "content", "tokens", "kinds", "texts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                pages = [p or "" for p in batch.column("html").to_pylist()]
                each = [parsed(p) for p in pages]
                columns = [pa.array([e[0] for e in each], pa.list_(pa.int64())), pa.array([e[1] for e in each], pa.binary()), pa.array([e[2] for e in each], pa.list_(pa.string()))]
                yield pa.record_batch([*(batch.column(c) for c in names[:4]), pa.array([_print(p) for p in pages], pa.int64()), *columns], names=names)

    kind = rows.schema["__id"].dataType.simpleString()
    return rows.mapInArrow(run, f"__id {kind}, __url string, host string, page long, content long, tokens array<long>, kinds binary, texts array<string>")


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """host, page, content and the parsed page of each row."""
    return zip(*[batch.column(c).to_pylist() for c in ("host", "page", "content", "tokens", "kinds", "texts")], strict=True)


def templates(pages: DataFrame) -> DataFrame:
    """``host, tokens, classes`` of parsed pages: tags and strings of the host's classes, frequent classes first, each class in the mean order of its tokens on its pages.

    A class is kept if it stands on enough different pages of its host and on enough of those that have tokens, has enough
    tokens, and leaves its pages text of their own; else a host of a few copies would take their text for its template.
    """
    names = ["host", "token", "pages", "vector", "place", "own", "around", "marks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple, list[int]] = {}  # by host and token; by host, no token and page
            for h, number, content, *page in _rows(batch):
                tokens, whole = page_tokens(*page)
                marks, vector = _marks(content), {}
                for token, (count, first, own) in tokens.items():
                    if count not in vector:
                        vector[count] = _print(str(number), str(count))
                    got = sums.setdefault((h, token), [0, 0, 0, 0, 0, 0])
                    got[0] += 1
                    got[1] = (got[1] + vector[count]) & (2**62 - 1)
                    got[2] += first
                    got[3] += own
                    got[4] += whole
                    got[5] |= marks
                if tokens:
                    alike = sums.setdefault((h, None, content), [0, content, 0, 0, 0, 0])
                    alike[0] += 1
            values = [pa.array([v[k] for v in sums.values()], pa.int64()) for k in range(5)]
            marks = pa.array([v[5] - (v[5] >> 63 << 64) for v in sums.values()], pa.int64())
            yield pa.record_batch([pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.int64()), *values, marks], names=names)

    tokens = pages.mapInArrow(run, ", ".join(["host string", *[f"{c} long" for c in names[1:]]]))
    modulus = F.lit(2**62)
    added = tokens.groupBy("host", "token", F.when(F.col("token").isNull(), F.col("vector")).alias("page")).agg(
        F.sum("pages").alias("pages"), (F.sum("place") / F.sum("pages")).alias("place"), F.pmod(F.sum(F.col("vector").cast("decimal(38,0)")), modulus.cast("decimal(38,0)")).cast("long").alias("vector"), F.sum("own").alias("own"), F.sum("around").alias("around"), F.bit_or("marks").alias("marks")
    )
    added = stash(added.filter(f"token is null or pages >= {LEAST_PAGES}"), "tokens")
    hosts = added.filter("token is null").groupBy("host").agg(F.sum("pages").alias("all"), F.count("*").alias("different"))
    frequent = added.filter("token is not null").join(hosts, "host").filter(f"pages >= {LEAST_SUPPORT} * all")
    classes = frequent.groupBy("host", "vector", "pages", "around", "all", "different").agg(F.count("*").alias("n"), F.sum("own").alias("own"), F.bit_or("marks").alias("marks"))
    differ = F.greatest(*[F.bit_count(F.shiftrightunsigned("marks", 16 * k).bitwiseAND(F.lit(65535))) for k in range(4)])
    valid = classes.filter(f"n >= {LEAST_TOKENS}").filter(differ >= LEAST_PAGES).filter(f"different >= {LEAST_DIFFERENT} and pages >= {SURE_SUPPORT} * all or own <= {MOST_SHARE} * around").select("host", "vector")
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("pages")).alias("less"), "vector", "place", "token")))
    met = frequent.join(valid, ["host", "vector"]).groupBy("host").agg(ranked.alias("ranked"))
    return met.select("host", F.expr("transform(ranked, x -> x.token)").alias("tokens"), F.expr("transform(ranked, x -> x.vector)").alias("classes"))


def numbered(tokens: list[int] | None, classes: list[int] | None) -> dict[int, int]:
    """Tokens by class << 32 | rank; those of one class stand together, in their order."""
    number: dict[int, int] = {}
    return {t: number.setdefault(c, len(number)) << 32 | k for k, (t, c) in enumerate(zip(tokens or (), classes or (), strict=True))}


def _with_templates(pages: DataFrame, found: DataFrame) -> DataFrame:
    """Parsed pages with ``template_tokens`` and ``template_classes`` of their host, broadcast up to a checked size, else by a salted join."""
    named = found.select("host", F.col("tokens").alias("template_tokens"), F.col("classes").alias("template_classes"))
    size = found.agg(F.coalesce(F.sum(F.size("tokens") * 16 + F.length("host")), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        return pages.join(F.broadcast(named), "host", "left")
    salted = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return pages.withColumn("salt", F.pmod("page", F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left").drop("salt")


def _numbers(batch: pa.RecordBatch) -> Iterator[dict[int, int]]:
    """The numbered template of each row's host."""
    known: dict[str, dict[int, int]] = {}
    for i, h in enumerate(batch.column("host").to_pylist()):
        if h not in known:
            known[h] = numbered(batch.column("template_tokens")[i].as_py(), batch.column("template_classes")[i].as_py())
        yield known[h]


def gaps(tokens: list[int | None], template: dict[int, int]) -> Iterator[tuple[int, int, int]]:
    """On one page: each token of a class, each more frequent class there, and how many of that class's tokens stand before."""
    first: dict[int, int] = {}
    for place, t in enumerate(tokens):
        if t in template:
            first.setdefault(t, place)
    held: dict[int, list[int]] = {}
    for t in first:
        held.setdefault(template[t] >> 32, []).append(t)
    above: list[tuple[int, list[int]]] = []
    for number in sorted(held):
        kept = [t for t in held[number] if t in in_order(held[number], template)]
        for other, places in above:
            for t in kept:
                yield t, other, bisect_left(places, first[t])
        above.append((number, [first[t] for t in kept]))


def nested(pages: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` without the tokens that don't keep to one gap of a more frequent class, and without classes too small then."""
    names = ["host", "token", "other", "gap", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple, int] = {}
            for h, tokens, template in zip(batch.column("host").to_pylist(), batch.column("tokens").to_pylist(), _numbers(batch), strict=True):
                for place in gaps(tokens, template) if template else ():
                    seen[h, *place] = seen.get((h, *place), 0) + 1
            columns = [pa.array([k[i] for k in seen], pa.string() if i == 0 else pa.int64()) for i in range(4)]
            yield pa.record_batch([*columns, pa.array(list(seen.values()), pa.int64())], names=names)

    counts = _with_templates(pages.select("host", "page", "tokens"), found).mapInArrow(run, "host string, token long, other long, gap long, n long")
    counts = counts.groupBy("host", "token", "other", "gap").agg(F.sum("n").alias("n"))
    free = counts.groupBy("host", "token", "other").agg((F.max("n") < SURE_GAP * F.sum("n")).alias("free")).filter("free")
    loose = stash(free.groupBy("host").agg(F.collect_set("token").alias("loose")), "loose")
    pairs = F.expr("filter(arrays_zip(tokens, classes), x -> loose is null or not array_contains(loose, x.tokens))")
    kept = found.join(loose, "host", "left").select("host", pairs.alias("p"))
    large = F.expr(f"filter(p, x -> size(filter(p, y -> y.classes = x.classes)) >= {LEAST_TOKENS})")
    return kept.select("host", large.alias("p")).select("host", F.col("p.tokens").alias("tokens"), F.col("p.classes").alias("classes"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", between: str = "\n") -> DataFrame:
    """``text`` and ``n_chars`` (code points) of every page, beside its id and url.

    A null or empty page has the empty text; a null url makes pages of one nameless host. Repeated pages are extracted
    each; other columns are not read.
    """
    rows = pages.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{url_col}`").cast("string").alias("__url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    rows = rows.withColumn("host", F.expr(host("__url"))).withColumn("page", F.xxhash64("__id", "__url", "html"))
    known = stash(read(rows), "parsed")
    found = stash(templates(known), "classes")
    found = stash(nested(known, found), "templates")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [slots(*page, template, between) for (_, _, _, *page), template in zip(_rows(batch), _numbers(batch), strict=True)]
            yield pa.record_batch([batch.column("__id"), batch.column("__url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["__id", "__url", "text", "n_chars"])

    kind = known.schema["__id"].dataType.simpleString()
    out = _with_templates(known, found).mapInArrow(run, f"__id {kind}, __url string, text string, n_chars long")
    return out.withColumnRenamed("__id", id_col).withColumnRenamed("__url", url_col)
