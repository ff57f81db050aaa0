"""Digests of tables as multisets of rows, kept as trees over ranges of row hashes.

A row's hash is the SHA-256 of an encoding in which every column is marked as null or given with
its length, so rows that differ in any value have different hashes. A digest is the sum of the
hashes of its rows, limb by limb: it does not depend on order, counts every copy, and adds up, so
that a node of the tree is the sum of its children, and the digest of a table that has grown is
that of the old one plus that of the new rows. Two trees are compared from the root down, and only
below nodes that differ, which names the ranges that hold the altered rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Levels below the root; each digit of a hash is a level, so there are 16**DEPTH leaves.
DEPTH = 2
#: Hexadecimal digits of a limb, and limbs of a digest. Sums of 24-bit limbs fit a long up to 2**39 rows.
LIMB_DIGITS, LIMBS, FIRST_DIGIT = 6, 10, 4


def _text(column: Column, kind: T.DataType) -> Column:
    """The value as text, different for different values of its type, null for null."""
    if isinstance(kind, T.MapType):
        return F.to_json(F.array_sort(F.map_entries(column)), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    if isinstance(kind, (T.ArrayType, T.StructType)):
        return F.to_json(column, {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column).cast("string")
    return F.hex(column) if isinstance(kind, T.BinaryType) else column.cast("string")


def row_encoding(df: DataFrame) -> Column:
    """All columns in order of name: the schema, then n for a null or v, the length in bytes and the text."""
    fields = sorted(df.schema.fields, key=lambda f: f.name)
    parts = [F.lit(",".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ";")]
    for f in fields:
        text = _text(F.col(f"`{f.name}`"), f.dataType)
        parts.append(F.coalesce(F.concat(F.lit("v"), F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("n")))
    return F.concat(*parts)


def row_hash(df: DataFrame) -> Column:
    return F.sha2(row_encoding(df), 256)


def _sums(limbs: list[Column]) -> list[Column]:
    return [F.sum(x).alias(f"__{i}") for i, x in enumerate(limbs)]


def _digest() -> Column:
    return F.array(*[f"__{i}" for i in range(LIMBS)]).alias("digest")


def digest_tree(df: DataFrame, keys: list[str], depth: int = DEPTH) -> DataFrame:
    """(keys, level, node, rows, digest) for every node with rows, from the root (level 0, node '')
    to the leaves; node is the beginning of the hashes of its rows. Tasks add up before the shuffle,
    so a key with most rows is no single task's work."""
    rows = df.select(*[F.col(k) for k in keys], row_hash(df).alias("__h"))
    limbs = [F.conv(F.substring("__h", 1 + FIRST_DIGIT + LIMB_DIGITS * i, LIMB_DIGITS), 16, 10).cast("long") for i in range(LIMBS)]
    leaves = rows.groupBy(*keys, F.substring("__h", 1, depth).alias("node")).agg(F.count("*").alias("rows"), *_sums(limbs))
    up = leaves.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth)))).withColumn("node", F.expr("substring(node, 1, level)"))
    nodes = up.groupBy(*keys, "level", "node").agg(F.sum("rows").alias("rows"), *_sums([F.col(f"__{i}") for i in range(LIMBS)]))
    return nodes.select(*keys, "level", "node", "rows", _digest())


def merged(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """The tree of two tables' rows together, from their trees."""
    limbs = [F.col("digest")[i] for i in range(LIMBS)]
    nodes = a.unionByName(b).groupBy(*keys, "level", "node").agg(F.sum("rows").alias("rows"), *_sums(limbs))
    return nodes.select(*keys, "level", "node", "rows", _digest())


def differing_nodes(a: DataFrame, b: DataFrame, keys: list[str], depth: int = DEPTH) -> DataFrame:
    """(keys, node, rows_a, rows_b): the leaves whose digests differ, found from the root down.

    Trees stored by level are read only as far as nodes above differ. A node that one side lacks
    has no rows there.
    """
    above = None
    for level in range(depth + 1):
        x, y = (t.filter(F.col("level") == level).select(*keys, "node", F.col("rows").alias(f"rows_{n}"), F.col("digest").alias(f"digest_{n}")) for t, n in ((a, "a"), (b, "b")))
        if above is not None:
            x, y = (t.withColumn("__up", F.substring("node", 1, level - 1)).join(above, [*keys, "__up"], "left_semi").drop("__up") for t in (x, y))
        both = x.join(y, [*keys, "node"], "full_outer").filter(~F.col("digest_a").eqNullSafe(F.col("digest_b")))
        above = both.select(*keys, F.col("node").alias("__up"))
    return both.select(*keys, "node", F.coalesce("rows_a", F.lit(0)).alias("rows_a"), F.coalesce("rows_b", F.lit(0)).alias("rows_b"))


def altered_rows(a: DataFrame, b: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row, n_a, n_b): the rows below these nodes that a and b hold different numbers of, as encoded.

    nodes: keys, node. Only rows of the ranges are grouped.
    """
    ranges = nodes.select(*keys, F.col("node").alias("__node")).distinct()

    def rows(df: DataFrame, n: int) -> DataFrame:
        enc = df.select(*[F.col(k) for k in keys], row_encoding(df).alias("row"), F.lit(n).alias("side"))
        near = reduce(lambda x, y: x & y, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys])
        return enc.withColumn("h", F.sha2("row", 256)).alias("l").join(ranges.alias("r"), near & F.expr("startswith(l.h, r.__node)"), "left_semi")

    both = rows(a, 0).unionByName(rows(b, 1)).groupBy(*keys, "row").agg(F.count_if(F.col("side") == 0).alias("n_a"), F.count_if(F.col("side") == 1).alias("n_b"))
    return both.filter("n_a <> n_b")
