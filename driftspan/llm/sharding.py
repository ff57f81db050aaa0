"""Shards of bounded size by extendible hashing.

A document's hash bits decide its shard. The directory starts with one bucket; a bucket above the
byte limit splits on its next bit, and only it. Which buckets split follows from the bytes of each
hash prefix, so a round adds up the bytes of the cells of its next bits, rolls them up to all
shorter prefixes, and takes for every cell the shortest prefix that fits. Cells that do not fit at
the round's full depth go through another round with further bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import checkpointed

HASH_BITS, ROUND_BITS = 60, 20


def extendible_shards(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text", round_bits: int = ROUND_BITS) -> DataFrame:
    """One row per input row: id_col, shard (its hash bits, '' if nothing split), depth, n_bytes, shard_bytes.

    The hash is the first 60 bits of the MD5 of the id as text; n_bytes is the text's UTF-8 size.
    Every shard has at most `limit` bytes, but for rows that no bit of the hash tells apart (one
    document above the limit, an id that repeats): they stay together at depth 60, with
    shard_bytes above the limit. Null and empty texts have no bytes and take the shard of their
    hash; a null id hashes as the empty string. Other columns are ignored; no rows give none.
    """
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    rows = docs.select(F.col(id_col).alias("id"), F.conv(F.substring(key, 1, 15), 16, 10).cast("long").alias("h"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    rows = checkpointed(rows)
    # cells of the rows still to place, by their first `depth` bits
    done, depth, left = None, 0, None
    while True:
        step = min(round_bits, HASH_BITS - depth)
        cell = F.shiftright("h", HASH_BITS - depth - step)
        now = rows if left is None else rows.join(left.select(F.col("cell").alias("outer")), F.shiftright("h", HASH_BITS - depth) == F.col("outer"), "left_semi")
        cells = checkpointed(now.groupBy(cell.alias("cell")).agg(F.sum("n_bytes").alias("bytes")))
        prefixes = cells.select("cell", "bytes", F.explode(F.sequence(F.lit(0), F.lit(step))).alias("k"))
        prefixes = prefixes.groupBy("k", F.expr(f"shiftright(cell, {step} - k)").alias("prefix")).agg(F.sum("bytes").alias("bytes"))
        fits = prefixes.filter((F.col("bytes") <= limit) | ((F.lit(depth) + F.col("k")) == HASH_BITS))
        ways = cells.select("cell", F.explode(F.sequence(F.lit(0), F.lit(step))).alias("k")).withColumn("prefix", F.expr(f"shiftright(cell, {step} - k)"))
        leaf = ways.join(fits, ["k", "prefix"]).groupBy("cell").agg(F.min(F.struct("k", "prefix", "bytes")).alias("leaf"))
        placed = checkpointed(cells.select("cell").join(leaf, "cell", "left"))
        own = now.withColumn("cell", cell).join(placed.filter("leaf is not null"), "cell").select("id", F.right(F.lpad(F.conv(F.col("leaf.prefix").cast("string"), 10, 2), HASH_BITS, "0"), F.lit(depth) + F.col("leaf.k")).alias("shard"), (F.lit(depth) + F.col("leaf.k")).cast("int").alias("depth"), "n_bytes", F.col("leaf.bytes").alias("shard_bytes"))
        done = own if done is None else done.union(own)
        left = placed.filter("leaf is null").select("cell")
        depth += step
        if depth >= HASH_BITS or left.isEmpty():
            return done.withColumnRenamed("id", id_col)
