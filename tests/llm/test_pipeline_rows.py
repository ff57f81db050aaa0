"""The pipeline's decisions by row: rare and missing labels, null and repeated ids."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from driftspan.llm import decontaminate, langid

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_language_keeps_short_texts_of_a_rare_label(spark):
    common = spark.range(3_000).select(F.col("id").alias("doc_id"), F.lit("the cat").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    rare = spark.createDataFrame([(90_000, "il gatto", "it", "s", 1), (90_001, "12 !?", "en", "s", 1), (90_002, None, "en", "s", 1)], SCHEMA)
    docs = common.union(rare)
    found = langid.predict(docs.filter("doc_id = 90000"), langid.train(docs, "text", "lang")).first()
    assert found["lang_pred"] == "it" and found["score"] < 0.5
    kept = P.identify_language(spark, docs, "")
    assert kept.count() == 3_001 and [r["lang"] for r in kept.filter("doc_id >= 90000").collect()] == ["it"]


def test_language_without_labels(spark):
    docs = spark.createDataFrame([(1, "the cat", None, "s", 1), (2, "é", None, "s", 1), (3, "12 !?", None, "s", 1), (4, None, None, "s", 1)], SCHEMA)
    assert sorted((r["doc_id"], r["lang"]) for r in P.identify_language(spark, docs, "").collect()) == [(1, "und"), (2, "und")]


def test_more_languages_than_the_model_holds(spark):
    docs = spark.range(langid.MOST_LANGUAGES + 1).select(F.lit("a b").alias("text"), F.col("id").cast("string").alias("lang"))
    with pytest.raises(ValueError, match="more than"):
        langid.train(docs, "text", "lang")
    assert len(langid.train(docs.limit(langid.MOST_LANGUAGES), "text", "lang").languages) == langid.MOST_LANGUAGES


def words(n, seed):
    return " ".join(f"x{seed}y{k}" for k in range(n))


def test_near_duplicates_with_null_and_repeated_ids(spark):
    a, b, c, d, e = (words(40, k) for k in range(5))
    rows = [(None, a), (None, b), (None, b), (3, c), (3, c), (3, c), (4, d), (9, d + " more"), (9, e), (2, e + " more"), (None, d), (None, None), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", f"s{k}", 1) for k, (i, t) in enumerate(rows)], SCHEMA).repartition(3)
    kept = [(r["doc_id"], r["text"]) for r in P.drop_near_duplicates(spark, docs, "").collect()]
    assert sorted(kept, key=str) == sorted([(None, a), (None, b), (3, c), (4, d), (2, e + " more"), (None, None), (8, "")], key=str)


def test_contamination_with_null_and_repeated_ids(spark, tmp_path):
    item = words(12, 0)
    rows = [(None, f"in {item} here"), (None, words(20, 1)), (None, None), (5, item), (5, words(20, 2)), (5, item), (6, words(20, 3))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA).repartition(3)
    bench = spark.createDataFrame([("q", item)], "item_id string, text string")
    found = decontaminate.contamination(docs, bench, width=10, keep=["text"]).collect()
    assert sorted(((r["doc_id"], r["text"], r["n_hit"]) for r in found), key=str) == sorted(((i, t, 12 * (item in (t or ""))) for i, t in rows), key=str)
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = [(r["doc_id"], r["text"]) for r in P.drop_contaminated(spark, docs, str(tmp_path)).collect()]
    assert sorted(kept, key=str) == sorted(((i, t) for i, t in rows if item not in (t or "")), key=str)
