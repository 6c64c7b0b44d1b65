"""Empty tables, repeated rows, columns named like inner ones, ties, and texts far over the usual length."""

from __future__ import annotations

import corpus_pipeline
from parlance.llm import jaccard, mixing, quality, recompression, secrets, suffix_dedup, tokens, wfst
from tests.llm.test_dedup import expected_bytes, expected_words

INNER = "key long, id string, h long, s string, rows int, c string, found string, size int, taken string, target string, carry_0 string, __text string, __id string"
FILL = (1, "a", 2, "b", 3, "c", "d", 4, "e", "f", "g", "h", "i")


def clashing(spark, rows):
    return spark.createDataFrame([(k, t, "s", *FILL) for k, t in rows], f"doc_id long, text string, source string, {INNER}")


TEXTS = [(k, " ".join(f"w{k}x{j}" for j in range(60))) for k in range(6)] + [(6, " ".join(f"w1x{j}" for j in range(60))), (7, None), (8, ""), (2, " ".join(f"w2x{j}" for j in range(60)))]


def test_columns_named_like_inner_ones(spark):
    df = clashing(spark, TEXTS)
    plain = spark.createDataFrame(TEXTS, "doc_id long, text string")
    for f in (jaccard.join, suffix_dedup.dedup, recompression.dedup, lambda d: tokens.count_tokens(d, tokens.model_path()), lambda d: wfst.encode(d, tokens.model_path()), lambda d: quality.score(d, None), lambda d: secrets.scan(d).drop("found", "__text")):
        assert sorted(map(str, f(df).collect())) == sorted(map(str, f(plain).collect()))
    assert mixing.mix(df).count() == len(TEXTS)


def test_mix_of_repeated_rows_and_one_long_document(spark):
    rows = [(k, "w " * 10, "a") for k in range(20)] + [(1, "w " * 10, "a")] * 3 + [(50, "w " * 50_000, "b"), (51, "w", "b"), (None, None, None)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(out) == len(rows)
    for source, size in (("a", 230), ("b", 50_001)):
        got = [r for r, x in zip(sorted(out, key=lambda r: str(r.doc_id)), sorted(rows, key=lambda r: str(r[0])), strict=True) if x[2] == source]
        assert {r.source_size for r in got} == {size} and all(r.taken <= 2 * r.size for r in got)


def test_texts_over_the_chunk_of_every_operator(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=tokens.model_path())
    long = " ".join(f"word{k % 997} {'é' * (k % 5)}漢 {k}" for k in range(40_000))
    rows = [(1, long), (2, long[1000:300_000]), (3, "ab" * 60_000), (4, "ab" * 60_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {k: library.encode(t) for k, t in rows}
    assert {r.doc_id: (r.n_tokens, r.n_bytes) for r in tokens.count_tokens(df, tokens.model_path()).collect()} == {k: (len(want[k]), len(t.encode())) for k, t in rows}
    assert {r.doc_id: r.ids for r in wfst.encode(df, tokens.model_path()).collect()} == want
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in recompression.dedup(df).collect()} == expected_words(rows, 20)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(df).collect()} == expected_bytes(rows, 100)


def test_pipeline_of_an_empty_table_and_more_columns(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"river {k} " * 40 if k % 3 else "BUY $$$ " * 60, "en", "s", 9, "own") for k in range(60)], "doc_id long, text string, lang string, source string, n_chars long, rows string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(30)], "doc_id long, quality int, toxic int")
    for name, table in (("all", docs), ("none", docs.limit(0))):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        (labels if name == "all" else labels.limit(0)).write.parquet(f"{tmp_path}/{name}/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    assert corpus_pipeline.run(spark, f"{tmp_path}/all").columns == ["doc_id", "ids", "n_tokens"]
