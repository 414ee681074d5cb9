"""Operator 13: exact dedup by progressive refinement, in DataFrame functions only.

Texts are equal when they agree byte for byte after A-Z are lower-cased.  Three
passes over the table look at ever more of ever fewer texts:

1. the byte length of every text, counted per length;
2. of texts whose length occurs twice, a hash of the first ``PREFIX`` characters,
   counted per (length, prefix hash);
3. of texts whose (length, prefix hash) occurs twice, the SHA-256 of the whole
   normalised text.

What survives a pass is kept as a bitmap of ``2 ** FILTER_BITS`` bits by key hash,
so the bitmap's size does not follow the data and it can be broadcast: texts are
never shuffled.  A chance hit in the bitmap lets a text through to the next pass,
where its full key decides; no text is lost, and at any size equality is that of
length and SHA-256.  Only (length, digest, id) rows meet in a shuffle.

A group that holds a third of the table is reduced per (digest, ``SALTS`` cells of
the row number) first; the answers go back by (digest, cell), so neither step
brings a group into one task.

Edge cases: a null text counts as empty and equals other empty texts.  Of equal
texts the row with the largest id stays, null ids counting as smallest; of rows
that share that id too (repeats) one stays, the one of the largest row number.
Other letters than A-Z keep their case, whatever their alphabet.  Extra columns
are only read where the caller asks to ``carry`` them, under any names; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .registry import query

PREFIX = 256
FILTER_BITS = 24
SALTS = 256
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z lower-cased; texts of one byte a character take Spark's
    quick path, which changes nothing else in them."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)) \
        .otherwise(F.translate(text, UPPER, LOWER))


def _place(*key: Column) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(1 << FILTER_BITS)).cast("long")


def _repeated(keys: DataFrame, *key: str) -> DataFrame:
    """(word, bits): the bitmap of the keys that occur more than once, at most
    ``2 ** FILTER_BITS / 64`` rows."""
    p = _place(*[F.col(k) for k in key])
    return keys.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1") \
        .select(F.shiftright(p, 6).alias("word"), F.expr("1L").alias("one"), (p % 64).cast("int").alias("bit")) \
        .groupBy("word").agg(F.bit_or(F.expr("shiftleft(one, bit)")).alias("bits"))


def _marked(df: DataFrame, bitmap: DataFrame, name: str, *key: str) -> DataFrame:
    """``df`` with the boolean ``name``: is the key's bit set?"""
    p = _place(*[F.col(k) for k in key])
    d = df.withColumn("word", F.shiftright(p, 6)).join(F.broadcast(bitmap), "word", "left")
    set_ = F.expr(f"getbit(bits, cast(pmod(xxhash64({', '.join(key)}), {1 << FILTER_BITS}) % 64 as int)) = 1")
    return d.withColumn(name, F.coalesce(set_, F.lit(False))).drop("word", "bits")


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 carry: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, and a column for each entry of ``carry``,
    an expression over ``docs``) for every input row.  See the module head."""
    carry = carry or {}
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    length = F.octet_length(t)
    sizes = docs.select(length.alias("len"))
    lens = C.store(_repeated(sizes, "len"), "op13-lengths")
    prefix = F.xxhash64(lower_ascii(F.substring(t, 1, PREFIX)))
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), length.alias("len"), t.alias("t"),
                       F.struct(*[e.alias(f"c{k}") for k, e in enumerate(carry.values())] or [F.lit(0).alias("none")])
                       .alias("carry"))
    second = _marked(rows.select("len", F.col("t")), lens, "again", "len").filter("again")
    heads = C.store(_repeated(second.select("len", F.xxhash64(lower_ascii(F.substring("t", 1, PREFIX))).alias("head")),
                              "len", "head"), "op13-prefixes")
    third = _marked(_marked(rows, lens, "a", "len").withColumn(
        "head", F.when(F.col("a"), F.xxhash64(lower_ascii(F.substring("t", 1, PREFIX))))), heads, "b", "len", "head")
    digest = F.when(F.col("a") & F.col("b"), F.unhex(F.sha2(F.encode(lower_ascii(F.col("t")), "UTF-8"), 256)))
    slim = C.store(third.select("id", "len", digest.alias("digest"), "carry",
                                F.monotonically_increasing_id().alias("row")), "op13-rows")
    cell = F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")
    hashed = slim.filter("digest is not null").withColumn("cell", cell)
    best = F.max(F.struct("id", "row")).alias("best")
    cells = hashed.groupBy("len", "digest", "cell").agg(best, F.count("*").alias("n"))
    groups = cells.groupBy("len", "digest").agg(F.max("best").alias("best"), F.sum("n").alias("n"))
    answers = cells.select("len", "digest", "cell").join(groups, ["len", "digest"])
    one = F.lit(1).cast("long")
    inside = hashed.join(answers, ["len", "digest", "cell"]) \
        .select("id", F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"),
                (F.col("best.row") == F.col("row")).alias("kept"), "carry")
    alone = slim.filter("digest is null") \
        .select("id", F.col("id").alias("keep_id"), one.alias("group_size"), F.lit(True).alias("kept"), "carry")
    out = inside.unionByName(alone)
    return out.select(F.col("id").alias(doc_id), "keep_id", "group_size", "kept",
                      *[F.col(f"carry.c{k}").alias(c) for k, c in enumerate(carry)])


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    row = C.fresh(docs, "row")
    out = exact_groups(docs, doc_id, text, {row: F.struct(*[F.col(f"`{c}`") for c in docs.columns])})
    return out.filter("kept").select(f"`{row}`.*")


@query("op13_exact_dedup", f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id,
       CAST(count(*) OVER (PARTITION BY t) AS BIGINT) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
""")
def op13(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    return exact_groups(C.table(spark, sf_dir, "documents"),
                        carry={"text_sha256": F.sha2(F.encode(lower_ascii(t), "UTF-8"), 256)})
