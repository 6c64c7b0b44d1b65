"""Secret scans: fixed patterns, and a battery of randomness tests under false-discovery control.

Only DataFrame and SQL functions run here. Positions of all matches of a pattern come from the pieces between
them: ``split`` and ``regexp_extract_all`` walk the text by the same matcher, so the running sum of the lengths of
piece and match gives each start in code points. Running sums and maxima over arrays go by blocks (``scanned``), and no
text is walked from its start for each match, so time grows with the text, however many matches it has.

Candidates are runs of 20 or more characters of base64 and its URL form. The encoding is inferred from the
characters used (hex, base32, base64). Three tests ask whether the run could be random in that encoding:
chi-squared against equal shares of the alphabet, the number of runs of letters and digits, and the circular
serial correlation of neighbouring symbols; Fisher's method joins them. The false-discovery control asks how often ordinary
text would give such statistics: chi-squared is held against the collisions of symbols that ordinary text has, the runs against its
changes between lower case, upper case and digits, and characters against those of the inferred alphabet. These p-values, over all candidates of all documents, are held
against Benjamini and Hochberg's line for each encoding and class of length, so that a corpus of many long words doesn't bring in more false finds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")
#: Share of false finds allowed, and the least p-value of the battery at which a run still counts as random.
FALSE_SHARE, LEAST_RANDOM = 0.001, 0.001
#: Of ordinary text: how often two letters are the same, how often neighbours differ in class, how many letters are a to f.
TEXT_COLLISION, TEXT_CHANGE, TEXT_HEX = 0.065, 0.05, 0.3

#: Items of an array that are added up one by one; beyond, blocks of so many are. Characters in a piece of a text that is cut.
BLOCK, CHUNK = 256, 4096


def _literal(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\x27") + "'"


def _let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def scanned(values: str, zero: str, own: Callable[[str], str], joined: Callable[[str, str], str], kind: str = "int") -> str:
    """For each item of an array what ``joined`` makes of ``own`` of all items before it, and at the end what it makes of all.

    Arrays can only be extended by copying them, so blocks are scanned each for itself, then the blocks' results.
    """
    empty = f"cast(array() as array<{kind}>)"
    blocks = f"transform(sequence(0, greatest(size({values}) - 1, 0) div {BLOCK}), b_ -> slice({values}, b_ * {BLOCK} + 1, {BLOCK}))"
    inner = f"transform({blocks}, k_ -> aggregate(k_, struct({zero} as at, {empty} as out), (a_, x_) -> struct({joined('a_.at', own('x_'))} as at, concat(a_.out, array(a_.at)) as out)))"
    offsets = f"aggregate(i_, struct({zero} as at, {empty} as out), (a_, r_) -> struct({joined('a_.at', 'r_.at')} as at, concat(a_.out, array(a_.at)) as out))"
    whole = _let("o_", offsets, f"concat(flatten(zip_with(i_, o_.out, (r_, s_) -> transform(r_.out, y_ -> {joined('s_', 'y_')}))), array(o_.at))")
    return _let("i_", inner, whole)


def _plus(a: str, b: str) -> str:
    return f"{a} + {b}"


def _most(a: str, b: str) -> str:
    return f"greatest({a}, {b})"


def _least(a: str, b: str) -> str:
    return f"least({a}, {b})"


def located(pattern: str, least: int = 0, hits: bool = False) -> Column:
    """Start and end (code points, end exclusive) of the matches of a pattern in ``__text``; with ``least``, of those whose group 2 is that long, with ``hits``, the matches too."""
    p = _literal(pattern)
    group = f"regexp_extract_all(__text, {p}, 2)" if least else "h_"
    pieces = f"zip_with(zip_with(h_, {group}, (h, g) -> struct(h, g)), slice(split(__text, {p}, -1), 1, size(h_)), (x, p) -> struct(length(p) as gap, length(x.h) as n, length(x.g) as g, x.h as h))"
    more = ", x.h as h" if hits else ""
    empty = f"cast(array() as array<struct<s:int,e:int{',h:string' if hits else ''}>>)"
    ends = scanned("p_", "0", lambda x: f"{x}.gap + {x}.n", _plus)
    placed = f"zip_with(p_, slice(e_, 1, size(p_)), (x, o) -> struct(o + x.gap as s, o + x.gap + x.n as e, x.g as g{more}))"
    placed = f"transform(filter({placed}, x -> x.g >= {least}), x -> struct(x.s as s, x.e as e{more}))"
    body = _let("h_", f"regexp_extract_all(__text, {p}, 0)", _let("p_", pieces, _let("e_", ends, placed)))
    return F.expr(f"case when regexp_like(__text, {p}) then {body} else {empty} end")


def _tail(z: str) -> str:
    """Upper tail of the normal distribution (a polynomial in t = 1 / (1 + 0.2316419 z), error below 1e-7)."""
    a = f"least(abs({z}), 37.0)"
    t = f"(1 / (1 + 0.2316419 * {a}))"
    upper = f"(exp(-{a} * {a} / 2) * 0.3989422804 * {t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429)))))"
    return f"case when {z} >= 0 then {upper} else 1 - {upper} end"


def judged() -> Column:
    """Of each candidate in ``__text``: place, length, p-value of the battery and log10 of the p-value under ordinary text."""
    spans = "__spans"
    step = lambda over, name, fields: f"transform({over}, x -> struct(x.*, {fields}))".replace("x.*", name)
    one = f"transform({spans}, x -> struct(x.s as s, x.e as e, x.h as v, x.e - x.s as n))"
    keep = "x.s as s, x.e as e, x.v as v, x.n as n"
    two = step(one, keep, "case when x.v rlike '^([0-9a-f]+|[0-9A-F]+)$' then '0123456789abcdef' when x.v rlike '^[A-Z2-7]+=*$' then 'abcdefghijklmnopqrstuvwxyz234567' else 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/' end as abc")
    three = step(two, keep, "x.abc as abc, translate(case when length(x.abc) < 64 then lower(x.v) else x.v end, '-_=', '+/') as w")
    keep += ", x.abc as abc, x.w as w"
    # occurrences of each symbol; the numbers of the symbols in order
    four = step(three, keep, "aggregate(transform(split(x.abc, ''), a -> cast(length(x.w) - length(replace(x.w, a, '')) as double)), 0D, (t, c) -> t + c * c) as squares, cast(length(x.w) as double) as m, cast(length(x.abc) as double) as k, transform(split(x.w, ''), c -> cast(instr(x.abc, c) as double)) as xs")
    keep4 = "x.s as s, x.e as e, x.n as n, x.k as k, x.m as m"
    five = (
        f"transform({four}, x -> struct({keep4}, x.k / x.m * x.squares - x.m as chi, (x.squares - x.m) / 2 as same, x.m * (x.m - 1) / 2 as pairs,"
        " aggregate(x.xs, 0D, (t, c) -> t + c) as sx, aggregate(x.xs, 0D, (t, c) -> t + c * c) as sxx,"
        " aggregate(zip_with(x.xs, concat(slice(x.xs, 2, size(x.xs)), slice(x.xs, 1, 1)), (a, b) -> a * b), 0D, (t, c) -> t + coalesce(c, 0D)) as sxy,"
        " cast(regexp_count(x.w, '[0-9]+|[^0-9]+') as double) as runs, cast(length(regexp_replace(x.w, '[^0-9]', '')) as double) as digits,"
        " cast(regexp_count(x.v, '(?<=[a-z])[A-Z0-9]|(?<=[A-Z])[a-z0-9]|(?<=[0-9])[A-Za-z]') as double) as changes))"
    )
    six = (
        f"transform({five}, x -> struct(x.s as s, x.e as e, x.n as n, x.k as k, x.m as m,"
        " (pow(greatest(x.chi, 0D) / (x.k - 1), 1D / 3) - (1 - 2D / (9 * (x.k - 1)))) / sqrt(2D / (9 * (x.k - 1))) as z_chi,"
        " case when x.digits = 0 or x.digits = x.m then 0D else (x.runs - (2 * x.digits * (x.m - x.digits) / x.m + 1)) / sqrt(greatest(1e-9, (2 * x.digits * (x.m - x.digits) / x.m) * (2 * x.digits * (x.m - x.digits) / x.m - 1) / (x.m - 1))) end as z_runs,"
        " case when x.m * x.sxx - x.sx * x.sx <= 0 then 99D else ((x.m * x.sxy - x.sx * x.sx) / (x.m * x.sxx - x.sx * x.sx) + 1 / (x.m - 1)) * sqrt(x.m - 1) end as z_serial,"
        f" case when x.k = 16 then 0D else (x.pairs * {TEXT_COLLISION} - x.same) / sqrt(x.pairs * {TEXT_COLLISION} * (1 - {TEXT_COLLISION})) end as z_same,"
        f" (x.changes - (x.m - 1) * {TEXT_CHANGE}) / sqrt((x.m - 1) * {TEXT_CHANGE} * (1 - {TEXT_CHANGE})) as z_changes))"
    )
    seven = (
        f"transform({six}, x -> struct(x.s as s, x.e as e, x.n as n, x.k as k, -ln(greatest(1e-300, {_tail('x.z_chi')})) - ln(greatest(1e-300, 2 * ({_tail('abs(x.z_runs)')}))) - ln(greatest(1e-300, 2 * ({_tail('abs(x.z_serial)')}))) as half,"
        f" log10(greatest(1e-290, {_tail('((x.z_same + x.z_changes) / 1.4142135623730951)')})) + case when x.k = 16 then x.n * log10({TEXT_HEX}D) else 0D end as text_log))"
    )
    last = f"transform({seven}, x -> struct(x.s as s, x.e as e, {_class('x.k', 'x.n')} as c, exp(-x.half) * (1 + x.half + x.half * x.half / 2) as p_random, x.text_log as text_log))"
    empty = "cast(array() as array<struct<s:int,e:int,c:int,p_random:double,text_log:double>>)"
    return F.expr(f"case when size(__spans) > 0 then {last} else {empty} end")


def _class(k: str, n: str) -> str:
    """Encoding and length of a candidate: three of each."""
    return f"case {k} when 16 then 0 when 32 then 3 else 6 end + case when {n} < 32 then 0 when {n} < 48 then 1 else 2 end"


def thresholds(rows: DataFrame) -> dict[int, float]:
    """For each encoding and class of length, the largest log10 p-value that Benjamini and Hochberg's line lets through.

    P-values are counted in tenths of a power of ten, so that nine short histograms hold those of all documents.
    """
    each = rows.filter(F.size("__judged") > 0).select(F.explode("__judged").alias("c"))
    counts = each.groupBy(F.col("c.c").alias("k"), F.expr("cast(greatest(ceil(c.text_log * 10), -4000) as int)").alias("tenth")).count()
    found = sorted(counts.collect())  # at most 4001 rows for each of nine classes
    below: dict[int, float] = {}
    for k in range(9):
        bins = [(r["tenth"], r["count"]) for r in found if r["k"] == k]
        m, seen, best = sum(c for _, c in bins), 0, None
        for tenth, c in bins:
            seen += c
            if 10.0 ** (tenth / 10) <= FALSE_SHARE * seen / m:
                best = tenth / 10
        below[k] = best if best is not None else -1e9
    return below


def _apart(base: str, found: str) -> str:
    """Those of the spans ``found`` that overlap none of ``base``: the bases before must have ended, the next one must not have begun."""
    both = f"array_sort(concat(transform({base}, x -> struct(x.s as s, 0 as t, x.e as e)), transform({found}, x -> struct(x.s as s, 1 as t, x.e as e))))"
    ended = scanned("m_", "-1", lambda x: f"case when {x}.t = 0 then {x}.e else -1 end", _most)
    begun = scanned("reverse(m_)", "2147483647", lambda x: f"case when {x}.t = 0 then {x}.s else 2147483647 end", _least)
    known = f"zip_with(zip_with(m_, slice(f_, 1, size(m_)), (x, o) -> struct(x.s as s, x.t as t, x.e as e, o as ended)), reverse(slice(n_, 1, size(m_))), (x, o) -> struct(x.s as s, x.t as t, x.e as e, x.ended as ended, o as begun))"
    kept = f"transform(filter({known}, x -> x.t = 1 and x.ended <= x.s and x.begun >= x.e), x -> struct(x.s as s, x.e as e))"
    return _let("m_", both, _let("f_", ended, _let("n_", begun, kept)))


def scan(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """All spans of every document, beside the counts of the fixed patterns.

    Null texts count as empty and have no span. Equal texts get equal spans, whatever their ids; other columns are
    returned only if ``carry`` names them. ``found`` holds the spans as structs of start, end and kind number.
    """
    inner = [F.col(f"`{c}`").alias(f"__carry_{i}") for i, c in enumerate(carry or [])]
    rows = documents.select(F.col(f"`{id_col}`").alias("__id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("__text"), *inner)
    candidates = rows.select("__text").filter(F.expr(f"regexp_like(__text, {_literal(CANDIDATE)})")).withColumn("__spans", located(CANDIDATE, hits=True))
    line = thresholds(candidates.select(judged().alias("__judged")))
    let = " or ".join(f"(c.c = {k} and c.text_log <= {v}D)" for k, v in line.items())
    marked = rows.withColumn("__assign", located(ASSIGN, 6)).withColumn("__access", located(ACCESS)).withColumn("__hex", located(HEX)).withColumn("__spans", located(CANDIDATE, hits=True))
    tag = lambda name, k: f"transform({name}, x -> struct(x.s as s, {k} as k, x.e as e))"
    marked = marked.withColumn("__base", F.expr(f"array_sort(concat({tag('__assign', 0)}, {tag('__access', 1)}, {tag('__hex', 2)}))"))
    marked = marked.withColumn("__random", judged())
    marked = marked.withColumn("__added", F.expr(f"filter(__random, c -> c.p_random >= {LEAST_RANDOM}D and ({let}))"))
    marked = marked.withColumn("__added", F.expr(f"case when size(__added) = 0 or size(__base) = 0 then transform(__added, x -> struct(x.s as s, x.e as e)) else {_apart('__base', '__added')} end"))
    marked = marked.withColumn("found", F.expr(f"case when size(__added) = 0 then __base else array_sort(concat(__base, {tag('__added', 3)})) end"))
    names = "array('assign', 'access', 'hex', 'random')"
    joined = lambda over: F.expr(f"array_join(transform({over}, x -> concat({names}[x.k], ':', x.s, ':', x.e)), ',')")
    size = lambda c: F.size(c).cast("long")
    out = marked.select(F.col("__id").alias(id_col), size("__assign").alias("n_assign"), size("__access").alias("n_access"), size("__hex").alias("n_hex"), F.sha2(joined("__base"), 256).alias("base_sha256"), joined("found").alias("spans"), "found", "__text", *[f"__carry_{i}" for i in range(len(inner))])
    for i, c in enumerate(carry or []):
        out = out.withColumnRenamed(f"__carry_{i}", c)
    return out


def redacted(mask: str = "[SECRET]") -> Column:
    """``__text`` with each span of ``found`` (overlapping ones together) replaced by the mask."""
    at, to = f"(x.a div {CHUNK})", f"(x.b div {CHUNK})"
    gap = f"""case when x.a >= x.b then ''
        when {at} = {to} then substring(get(c_, {at}), x.a % {CHUNK} + 1, x.b - x.a)
        else concat(substring(get(c_, {at}), x.a % {CHUNK} + 1), array_join(slice(c_, cast({at} as int) + 2, cast({to} - {at} as int) - 1), ''), coalesce(substring(get(c_, {to}), 1, x.b % {CHUNK}), '')) end"""
    parts = f"transform(concat(filter(zip_with(found, slice(r_, 1, size(found)), (x, o) -> struct(o as a, x.s as b, '{mask}' as m)), x -> x.a <= x.b), array(struct(element_at(r_, -1) as a, length(__text) as b, '' as m))), x -> concat({gap}, x.m))"
    ends = scanned("found", "0", lambda x: f"{x}.e", _most)
    body = _let("c_", f"regexp_extract_all(__text, '(?s).{{1,{CHUNK}}}', 0)", _let("r_", ends, f"array_join({parts}, '')"))
    return F.expr(f"case when size(found) = 0 then __text else {body} end")
