"""The queries of this package and, where SQL can express them, their SQL for DuckDB."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, euclid_lsh, geometric_means, jaccard, langid, ngram_trie, packing, quotes, revisits, sharding, subword_quality, token_counts, whitening
from ._spark import held_out, read_table
from .oracle import ORACLE_SQL as ORACLE_SQL


def tokenizer(name: str) -> str:
    """A file of the public tokenizers, which are installed as a package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learned from documents outside the fold 2 of 4."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    fold = held_out("doc_id", 4, 2)
    model = langid.train(docs.filter(~fold), "text", "lang")
    return langid.predict(docs, model, keep=[fold.alias("held_out")])


def page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive records from the pages: of each page a response and, later, a revisit.

    The tables hold no archive records, so times come from the page's number, every eleventh
    response failed, revisits carry a weak entity tag or only a modification time, and a header
    that a revisit may not pass on.
    """
    pages = read_table(spark, sf_dir, "pages", "page_id", "url", "html")
    tag, changed = F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 16), F.lit('"')), F.concat(F.lit("lm-"), (F.col("page_id") % 97).cast("string"))
    first = pages.select(
        F.concat(F.lit("r"), "page_id").alias("record_id"), "url", (F.col("page_id") * 10).alias("ts"), F.lit("response").alias("kind"), F.when(F.col("page_id") % 11 == 5, 503).otherwise(200).alias("status"),
        F.create_map(F.lit("etag"), tag, F.lit("last-modified"), changed, F.lit("content-type"), F.lit("text/html"), F.lit("date"), F.concat(F.lit("d"), "page_id")).alias("headers"),
    )
    again = pages.select(
        F.concat(F.lit("v"), "page_id").alias("record_id"), "url", (F.col("page_id") * 10 + 5 + 10 * (F.col("page_id") % 500)).alias("ts"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"),
        F.create_map(F.lit("etag"), F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("W/"), tag)), F.lit("last-modified"), changed, F.lit("content-type"), F.lit("none"), F.lit("date"), F.concat(F.lit("e"), "page_id")).alias("headers"),
    )
    return first.union(again)


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every revisit of the pages' records, resolved."""
    found = revisits.resolve_revisits(page_records(spark, sf_dir))
    return found.select("record_id", "url_key", "response_id", "outcome", *[F.col("headers")[h].alias(h.replace("-", "_")) for h in ("etag", "last-modified", "content-type", "date")])


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents: 3-word shingles, Jaccard of 0.9 or more."""
    return jaccard.jaccard_groups(read_table(spark, sf_dir, "documents", "doc_id", "text"), n=3, num=90, den=100)


def quoted_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations with the quotes a mail reader would add.

    Of turn mod 5 = 3, the last turn's first and last line, each above a part of the answer; of 4,
    the last turn without its first line; else of every third turn the turn before last, or else
    the last one, every other time with the one before it nested inside.
    """
    turns = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    one, two = (turns.select("conv_id", (F.col("turn") + k).alias("turn"), F.col("text").alias(f"back{k}"), F.split("text", "\n").alias(f"lines{k}")) for k in (1, 2))
    rows = turns.join(one, ["conv_id", "turn"], "left").join(two.drop("lines2"), ["conv_id", "turn"], "left").withColumn("own", F.split(F.coalesce("text", F.lit("")), "\n"))

    def quoted(text, mark: str):
        return F.concat(F.lit(mark), F.replace(text, F.lit("\n"), F.lit("\n" + mark)), F.lit("\n"))

    def rest(lines):
        return F.array_join(F.slice(lines, 2, F.size(lines)), "\n")

    third, nested, lines = F.col("turn") % 3 == 2, F.col("turn") % 2 == 0, F.col("lines1")
    has1, has2, text = F.col("back1").isNotNull(), F.col("back2").isNotNull(), F.coalesce("text", F.lit(""))
    answers = F.concat(quoted(F.get(lines, 0), "> "), F.get("own", 0), F.lit("\n> "), F.element_at(lines, -1), F.when(F.size("own") > 1, F.concat(F.lit("\n"), rest(F.col("own")))).otherwise(""))
    part = quoted(F.when(F.size(lines) > 1, rest(lines)).otherwise(F.col("back1")), "> ")
    whole = F.when(third & has2, quoted(F.col("back2"), "> ")).when(has1, F.concat(F.when(nested & has2, quoted(F.col("back2"), "> > ")).otherwise(""), quoted(F.col("back1"), "> "))).otherwise("")
    turn = F.col("turn") % 5
    return rows.select("conv_id", "turn", F.when((turn == 3) & has1, answers).when((turn == 4) & has1, F.concat(part, text)).otherwise(F.concat(whole, text)).alias("text"))


def op4_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations in reply order without their quotes."""
    return quotes.link_quotes(quoted_conversations(spark, sf_dir))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of all documents."""
    return token_counts.token_counts(read_table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer("piece_bpe_32k.model"))


def op6_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards of at most a mebibyte."""
    return sharding.extendible_shards(read_table(spark, sf_dir, "documents", "doc_id", "text"), limit=1 << 20)


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside any 10 words in a row of a benchmark item."""
    found = decontaminate.contamination(read_table(spark, sf_dir, "documents", "doc_id", "text"), read_table(spark, sf_dir, "benchmark", "item_id", "text"), width=10)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op8_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all vectors at a cosine of 0.93 or more within their label."""
    return euclid_lsh.near_vectors(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"), least=0.93)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    return packing.pack(read_table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer("byte_bpe_50k.json"), capacity=1024, ids=False)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bigram scores of all documents; learned from documents outside the fold 1 of 5."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    scores, _ = ngram_trie.fit_and_score(docs, ~held_out("doc_id", 5, 1))
    # a null id is in no fold, so it is trained on
    return scores


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; learned from labels outside the fold 0 of 5."""
    docs, labels = read_table(spark, sf_dir, "documents", "doc_id", "text"), read_table(spark, sf_dir, "labels", "doc_id", "quality")
    fold = held_out("doc_id", 5, 0)
    weights = subword_quality.train(subword_quality.train_sample(docs.filter(~fold), labels))
    score = F.col("probabilities")[1]
    return subword_quality.predict(docs, weights, keep=[fold.alias("held_out")]).select("doc_id", "held_out", score.alias("score"), (score >= 0.3).cast("int").alias("predicted"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four whitened components of all vectors, fitted on the distinct ones."""
    found = whitening.whiten(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding"), components=4)
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen clusters of all vectors after three rounds."""
    found = geometric_means.cluster_vectors(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding"), clusters=16, rounds=3)
    return found.withColumns({c: F.col(c).cast("long") for c in ("cluster_inertia", "inertia")})


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_warc_revisits": op2_warc_revisits,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_quotation_links": op4_quotation_links,
    "op5_token_counts": op5_token_counts,
    "op6_extendible_shards": op6_extendible_shards,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_embedding_neardup": op8_embedding_neardup,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_quality_classifier": op11_quality_classifier,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_centroid_clustering": op13_centroid_clustering,
}
