"""The pipeline against a plain version of each stage."""

import hashlib

import corpus_pipeline
from pyspark.sql import functions as F
from spanisle.llm import pii

from .test_ops import components_by_hand


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("score", F.lit(1)).withColumn("terms", F.lit("x"))
    (_, language), (_, near), (_, private), (_, mix), (_, encode) = corpus_pipeline.STAGES
    a = language(spark, docs.union(docs.limit(1).withColumn("doc_id", F.lit(10**6).cast("long")).withColumn("text", F.lit("123 !!"))), sf).cache()
    assert a.columns == docs.columns and {r[0] for r in a.select("doc_id").collect()} == {r[0] for r in docs.select("doc_id").collect()}
    b = near(spark, a, sf).cache()
    texts = {r["doc_id"]: r["text"] for r in a.collect()}
    want, _ = components_by_hand(texts, corpus_pipeline.WORDS, corpus_pipeline.PER_CENT)
    assert b.columns == docs.columns and {r["doc_id"] for r in b.collect()} == set(want.values()) and b.count() < a.count()
    c = private(spark, b, sf).cache()
    assert c.columns == docs.columns and c.count() == b.count()
    before = {r["doc_id"]: r["text"] for r in b.collect()}
    for r in c.collect():
        assert not pii.base_spans(r["text"]) and r["n_chars"] == len(r["text"])
        assert pii.base_spans(before[r["doc_id"]]) or r["text"] == before[r["doc_id"]]
    d = mix(spark, c, sf).cache()
    total, kept = (df.agg(F.sum(F.size(F.filter(F.split("text", r"[ \t\n\r]+"), lambda w: w != "")))).first()[0] for df in (c, d))
    assert d.columns == docs.columns and d.count() == d.select("doc_id").distinct().count() and 0 < kept < total
    e = encode(spark, d, sf)
    text = {r["doc_id"]: r["text"] for r in d.collect()}
    assert {r["doc_id"]: r["decoded_sha256"] for r in e.collect()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in text.items()}


def test_run_is_the_stages(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert got.count() > 0 and got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


ODD = [
    (1, "Le petit chat dort sur la grande table de la cuisine.", "fr", "src1", 5, "a"), (1, "Le petit chat dort sur la grande table de la cuisine.", "fr", "src1", 5, "a"),
    (2, None, None, None, None, None), (3, "", "en", "src2", 0, "b"), (4, "12 !?", "en", "x", 4, "c"), (None, "the cat and the dog sleep on the old table in the kitchen today", "en", "src2", 9, "d"),
    (5, "the cat and the dog sleep on the old table in the kitchen today", "en", "src3", 9, "e"), (6, "the cat and the dog sleep on the old table in the kitchen today", None, None, 9, "e"),
    (7, "write to a@b.co about the old table " * 300, "en", "src3", 1, "f"), (8, "\u00e9\u00e8 \u65e5\u672c", "en", "src1", 3, "g"),
]


def test_odd_tables(spark, sf):
    """Nulls in every column, empty and long texts, repeated rows, and columns named as operators name theirs inside."""
    kinds = "doc_id long, text string, lang string, source string, n_chars long, _spanisle_lang string"
    docs = spark.createDataFrame(ODD, kinds)
    docs = docs.withColumnRenamed("_spanisle_lang", "_spanisle_row").withColumn("_spanisle_k", F.lit(1)).withColumn("score", F.lit(2)).withColumn("_spanisle_bit", F.lit(None).cast("int"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, sf)
        assert got.columns == docs.columns and got.count() <= len(ODD)
        assert stage(spark, docs.where("false"), sf).count() == 0
        assert stage(spark, docs.where("doc_id = 2"), sf).count() <= 1
    language, near, private, mix = (f for _, f in corpus_pipeline.STAGES[:-1])
    assert sorted(r["doc_id"] or -1 for r in language(spark, docs, sf).collect() if r["doc_id"] not in (8, 7)) in ([-1, 1, 1, 5, 6], [-1, 5, 6])
    assert sorted(r["doc_id"] or -1 for r in near(spark, docs, sf).collect()) == [-1, 1, 1, 2, 3, 4, 5, 7, 8]
    assert private(spark, docs, sf).count() == len(ODD) and private(spark, docs.drop("n_chars"), sf).where("text LIKE '%@%'").count() == 0
    assert {r["doc_id"] for r in mix(spark, docs, sf).collect()}.isdisjoint({2, 3})
    encoded = corpus_pipeline.encode(spark, docs, sf)
    assert encoded.count() == len(ODD) and corpus_pipeline.encode(spark, docs.where("false"), sf).count() == 0
    # without a label to learn from, nothing is rejected
    assert language(spark, docs.withColumn("lang", F.lit(None).cast("string")), sf).count() == len(ODD)


def test_language_keeps_capitals(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    shouted = docs.where("doc_id % 7 = 0").select((F.col("doc_id") + 10**6).alias("doc_id"), F.upper("text").alias("text"), "lang", "source", "n_chars")
    got = corpus_pipeline.language(spark, docs.union(shouted), sf)
    assert got.where("doc_id >= 1000000").count() == shouted.where("text RLIKE '\\\\p{L}'").count()
