"""The registered ``opN_<name>`` queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parlance.llm import audio, divergence, html, imatch, jaccard, merkle, mixing, quality, recompression, secrets, suffix_dedup, tokens, wfst

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), tokens.model_path())


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents")).drop("row_key")


def op5_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents played as notes; all recordings against those whose id is divisible by 100."""
    return audio.search(audio.recordings(table(spark, sf_dir, "documents")), "doc_id % 100 = 0")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wfst.encode(table(spark, sf_dir, "documents"), tokens.model_path())


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of a page are joined by two line breaks."""
    return html.extract(table(spark, sf_dir, "pages"), between="\n\n")


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.dedup(table(spark, sf_dir, "documents"))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.proofs(merkle.manifest(table(spark, sf_dir, "documents")))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.compare(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


WORDS = "list_filter(string_split_regex({text}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

FIELD = "coalesce(strlen({0}) || ':' || {0}, '-')"
LEAF = "sha256(" + " || ".join(FIELD.format(f"cast({c} as varchar)") for c in ("doc_id", "source", "lang", "{chars}", "text")) + ")"
#: The checksum bit by bit, over the bytes of a number's digits.
CRC32 = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(doc_id as varchar), ''), lambda c: ascii(c)::bigint)), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295)"
FOLD = "sha256(case when s.h is null then w.fold when w.j % 2 = 1 then s.h || w.fold else w.fold || s.h end)"

APART = "(({0} - {1}) * ({0} - {1})) // ({0} + {1})"
SHARE = "1 + (1000000000::hugeint * ({n} + 2)) // ({of} + 2 * {v})"

ORACLE = {
    "op12_source_divergence": f"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
o as (select r, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from d),
c as (select lang, source, term, count(*) as n from o group by all),
k as (select lang, term, count(*) as whole from o group by all having count(distinct r) >= 10),
l as (select lang, count(*) as v, sum(whole) as total from k group by lang),
g as (select distinct lang, source from d),
s as (select g.lang, g.source, coalesce(sum(c.n), 0) as size from g left join (select c.* from c join k using (lang, term)) c using (lang, source) group by all),
x as (select s.lang, s.source, k.term, coalesce(c.n, 0) as n, {SHARE.format(n="coalesce(c.n, 0)", of="s.size", v="l.v")} as p, {SHARE.format(n="k.whole", of="l.total", v="l.v")} as q
  from s join l using (lang) join k using (lang) left join c on c.lang = s.lang and c.source = s.source and c.term = k.term),
f as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(sum({APART.format("x.p", "y.p")}), 0) as value
  from g a join g b on a.lang = b.lang and a.source <> b.source left join x on x.lang = a.lang and x.source = a.source left join x y on y.lang = b.lang and y.source = b.source and y.term = x.term group by all
  union all select lang, source, 'term', term, {APART.format("p", "q")} from x where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as k from f)
select lang, source, part, item, cast(value as bigint) as value, cast(k as integer) as rank from ranked where part = 'pair' or k <= 10""",
    "op11_merkle_manifest": f"""
with recursive d as (select doc_id, lang, {LEAF.format(chars="n_chars")} as leaf, case when {CRC32} % 7 = 0 then {LEAF.format(chars="n_chars + 1")} end as forged from documents),
leaves as (select *, row_number() over (partition by lang order by doc_id, leaf) - 1 as i, count(*) over (partition by lang) as n from d),
nodes as (select lang, 0 as lv, i as j, n, leaf as h from leaves
  union all select lang, lv + 1, j // 2, (n + 1) // 2, sha256(string_agg(h, '' order by j)) from nodes where n > 1 group by lang, lv, j // 2, n),
subs as (select lang, h as subroot, row_number() over (order by lang nulls first) - 1 as i, count(*) over () as n from nodes where n = 1),
crown as (select 0 as lv, i as j, n, subroot as h from subs union all select lv + 1, j // 2, (n + 1) // 2, sha256(string_agg(h, '' order by j)) from crown where n > 1 group by lv, j // 2, n),
up as (select doc_id, lang, leaf, 0 as lv, i as j, n, '' as proof, coalesce(forged, leaf) as fold from leaves
  union all select w.doc_id, w.lang, w.leaf, w.lv + 1, w.j // 2, (w.n + 1) // 2, w.proof || coalesce(s.h, ''), {FOLD}
  from up w left join nodes s on s.lang is not distinct from w.lang and s.lv = w.lv and s.j = xor(w.j, 1) where w.n > 1),
over as (select u.doc_id, u.leaf, b.subroot, 0 as lv, b.i as j, b.n, u.proof, u.fold from up u join subs b on b.lang is not distinct from u.lang where u.n = 1
  union all select w.doc_id, w.leaf, w.subroot, w.lv + 1, w.j // 2, (w.n + 1) // 2, w.proof || coalesce(s.h, ''), {FOLD} from over w left join crown s on s.lv = w.lv and s.j = xor(w.j, 1) where w.n > 1)
select doc_id, leaf, subroot, (select h from crown where n = 1) as root, sha256(proof) as proof_sha256, fold as folded_root, fold = (select h from crown where n = 1) as verified from over where n = 1""",
    "op4_ngram_jaccard": f"""
with recursive w as (select doc_id, {WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as ws from documents),
g as (select distinct doc_id, array_to_string(ws[p : p + 4], ' ') as s from w, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) u(p) where len(ws) > 0),
n as (select doc_id, count(*) as n from g group by doc_id),
o as (select x.doc_id as a, y.doc_id as b, count(*) as k from g x join g y on x.s = y.s and x.doc_id <> y.doc_id group by all),
links as (select a, b from o join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 75 * (x.n + y.n - k)),
reach as (select doc_id as a, doc_id as b from documents union select r.a, l.b from reach r join links l on r.b = l.a)
select r.a as doc_id, coalesce(any_value(n.n), 0) as n_shingles, min(r.b) as component_id from reach r left join n on n.doc_id = r.a group by r.a""",
    "op9_substring_dedup": f"""
with w as (select doc_id, {WORDS.format(text="coalesce(text, '')")} as ws from documents),
win as (select doc_id, p, array_to_string(ws[p : p + 19], ' ') as s from w, unnest(range(1, len(ws) - 18)) u(p)),
dup as (select doc_id, p from (select doc_id, p, row_number() over (partition by s order by doc_id, p) as k from win) where k > 1),
gone as (select distinct doc_id, p + j as i from dup, unnest(range(0, 20)) u(j)),
each as (select doc_id, ws[i] as t, i from w, unnest(range(1, len(ws) + 1)) u(i)),
kept as (select e.doc_id, string_agg(t, ' ' order by e.i) as t, count(*) as n from each e left join gone g on g.doc_id = e.doc_id and g.i = e.i where g.i is null group by e.doc_id)
select w.doc_id, len(ws) as n_words, len(ws) - coalesce(n, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from w left join kept using (doc_id)""",
}


def oracle_sql() -> dict[str, str]:
    """SQL of those queries whose rows SQL can give in time (byte windows take it over a minute); the others are tested against brute force."""
    return dict(ORACLE)
