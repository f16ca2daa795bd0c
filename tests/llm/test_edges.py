"""Every operator and pipeline stage on nulls, empty and long texts, repeats, no rows and clashing columns."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from nutriyield.llm import (bestfit_rows, byte_bpe, importance, interpolated_lm, language_bits, length_buckets, near_dups,
                            quality_lines, scaled_sketch, toxicity_gru)
from nutriyield.llm.common import held_out

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: names that the operators use for their own columns
CLASHES = ["words", "lines", "passed", "kept", "rank", "part", "copy", "hub", "doc", "key", "score", "good", "role", "block", "ids", "n", "seg", "bucket", "row"]

PROSE = " ".join(f"word{i} and{i} other{i} of it{i}." for i in range(40))


def rows():
    long = " ".join(f"w{i % 997}x{i % 31}" for i in range(30_000)) + "."
    texts = [None, "", "   \n\t ", "a", "é", "1234 5678", "!!! ???", "x" * 5000, long, PROSE, PROSE, PROSE + " more", "\n".join([PROSE] * 3),
             "\x1c\x85", "漢字かな", "😀 😀", "áb"]
    out = [(i, t, "en" if i % 2 else None, None if i % 3 else "src0", None) for i, t in enumerate(texts)]
    out += [(9, PROSE, "en", "src0", 3), (9, PROSE, "en", "src0", 3), (None, PROSE, "en", None, None), (None, None, None, None, None), (-5, "Minus. " * 60, "fr", "s", 1)]
    return out


def labels(spark):
    return spark.createDataFrame([(9, 1, 1), (10, 1, 0), (8, 0, 0), (9, 1, 0), (None, 1, 1), (99, 0, 1), (11, None, None)],
                                 "doc_id bigint, quality int, toxic int")


def toxicity(df):
    small = toxicity_gru.Settings(steps=3, max_docs=10)
    return toxicity_gru.score_toxicity(df, toxicity_gru.fit(df, labels(df.sparkSession), small))


OPERATORS = {
    "length_buckets": lambda d: length_buckets.pack_buckets(d, max_tokens=1000),
    "quality_lines": quality_lines.clean_lines,
    "bestfit_rows": lambda d: bestfit_rows.pack_rows(d, row=512),
    "toxicity": toxicity,
    "interpolated_lm": lambda d: interpolated_lm.score_documents(d, held_out(F.col("doc_id"), 7, 2)),
    "trigram_lm": lambda d: interpolated_lm.score_documents(d, held_out(F.col("doc_id"), 7, 2), order=3),
    "scaled_sketch": scaled_sketch.edit_report,
    "fingerprints": scaled_sketch.fingerprints,
    "language_bits": lambda d: language_bits.identify(d, language_bits.learn(d)),
    "byte_bpe": byte_bpe.encode_documents,
    "near_dups": near_dups.near_duplicates,
    "importance": lambda d: importance.resample(d, labels(d.sparkSession).where("quality = 1").select("doc_id")),
}
PER_ROW = ["quality_lines", "toxicity", "interpolated_lm", "trigram_lm", "scaled_sketch", "fingerprints", "language_bits", "byte_bpe", "near_dups", "importance"]


def plain(r):
    return tuple(round(x, 9) if isinstance(x, float) else tuple(x) if isinstance(x, list) else x for x in r)


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3, F.col("source")).cache()


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_clashing_columns(spark, edge, name):
    run = OPERATORS[name]
    got = run(edge).collect()
    if name in PER_ROW:
        assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows())
        again = run(edge.withColumns({c: F.lit(1) for c in CLASHES}))
        if name != "scaled_sketch":
            assert sorted(map(str, map(plain, got))) == sorted(map(str, map(plain, again.collect())))
    if name in ("quality_lines", "language_bits", "byte_bpe", "near_dups", "toxicity", "fingerprints"):
        same = {str(plain(r)[1:]) for r in got if r["doc_id"] == 9}
        assert len(same) == 1  # repeated rows are treated alike


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], SCHEMA)).collect() == []


def test_pipeline_learns_from_every_labelled_document(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(corpus_pipeline.language_bits, "learn", lambda d: seen.append(d.count()))
    monkeypatch.setattr(corpus_pipeline.language_bits, "identify", lambda rows, filters, id_col: rows.select(F.col("row").alias("doc_id"), F.lit("xx").alias("lang_pred"), F.lit(1.0).alias("score")))
    docs = spark.createDataFrame([(i, "some text", "xx", "s", 9) for i in range(30)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert corpus_pipeline.language_stage(spark, docs, "").count() == 30 and seen == [30]


def test_pipeline_stages_on_odd_rows(spark, edge):
    for table in (edge, edge.limit(0)):
        docs = table
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, "")
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == corpus_pipeline.COLUMNS
                docs = spark.createDataFrame(out.collect(), SCHEMA)
            else:
                packed = out.collect()
        if table is edge:
            ids = [r["doc_id"] for r in packed]
            assert 9 in ids and ids.count(9) == 1  # repeated rows and the exact copy are one document
            assert 10 not in ids and 0 not in ids and 1 not in ids and 7 not in ids
            assert sum(r["n_tokens"] for r in packed) == sum(len((r["text"] or "").split()) for r in docs.collect())
        else:
            assert packed == []
