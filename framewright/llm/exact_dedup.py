"""Exact dedup: two passes with a Bloom filter, DataFrame functions only.

Pass 1 sets two filter positions for each text's hash and keeps the positions that were set twice or more; a text of
which another copy exists has both of its positions there. Pass 2 tests every row against these positions, which are
broadcast as 64-bit words: at most filter_bits / 64 rows of 16 bytes, whatever the input. Rows that fail the test are
the only one of their text and pass straight through; only the others shuffle. As the input outgrows the filter, more
rows shuffle than need be, and the result stays exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, whole_row, without_white

#: 2^27 positions: a broadcast of 32 MB at most.
FILTER_BITS = 1 << 27


#: Texts that occur more than once, as their hash, id and length; more are joined by a shuffle instead of a broadcast of some 10 MB.
BROADCAST_GROUPS = 100_000


def text_key(text: Column) -> Column:
    return F.sha2(without_white(F.coalesce(text, F.lit(""))), 256)


def _positions(key: Column, bits: int) -> tuple[Column, Column]:
    h = F.xxhash64(key)
    return h.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(bits - 1))


def repeated_words(hashes: DataFrame, bits: int) -> DataFrame:
    """Filter words (w, bits) of the positions that the keys of `hashes` set at least twice; no more than bits / 64 rows."""
    positions = hashes.select(F.explode(F.array(*_positions(F.col("text_sha256"), bits))).alias("p"))
    twice = positions.groupBy("p").agg(F.count("*").alias("n")).filter("n > 1")
    return twice.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits"))


def mark_repeated(df: DataFrame, words: DataFrame, bits: int) -> DataFrame:
    """df with `maybe`: whether another row may have the same text_sha256 (never wrongly false)."""
    df = df.withColumns(dict(zip(("_p1", "_p2"), _positions(F.col("text_sha256"), bits))))
    for i in ("1", "2"):
        word = F.broadcast(words.select(F.col("w").alias("_w" + i), F.col("bits").alias("_b" + i)))
        df = df.join(word, F.shiftright(F.col("_p" + i), 6) == F.col("_w" + i), "left")
    hit = lambda i: F.coalesce(F.getbit(F.col("_b" + i), F.col("_p" + i).bitwiseAND(F.lit(63)).cast("int")), F.lit(0)) == 1
    return df.withColumn("maybe", hit("1") & hit("2")).drop("_p1", "_p2", "_w1", "_w2", "_b1", "_b2")


def _groups(rows: DataFrame) -> DataFrame:
    """Of each text the row that stays: the most code points, then the smallest id (null last), then the first row."""
    best = F.max(F.struct("_n", (-F.col("_id")).alias("i"), (-F.col("_row")).alias("r")))
    return rows.groupBy("text_sha256").agg(F.count("*").alias("group_size"), best.alias("_best"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_bits: int = FILTER_BITS) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are after deleting white space; null counts as empty. Of rows that share both id and text,
    exactly one is kept. A null id loses against any other. An empty table gives an empty result; columns other than
    the two named play no part, whatever their names.
    """
    base = docs.select(F.col(id_col).cast("long").alias("_id"), text_key(F.col(text_col)).alias("text_sha256"), F.char_length(F.coalesce(F.col(text_col), F.lit(""))).alias("_n"))
    base = materialize(base.withColumn("_row", F.monotonically_increasing_id()), "exact-hashes")
    words = materialize(repeated_words(base, filter_bits), "exact-filter")
    marked = mark_repeated(base, words, filter_bits)
    some = marked.filter("maybe")
    groups = materialize(_groups(some).filter("group_size > 1"), "exact-groups")
    some = some.join(groups, "text_sha256", "left")  # both sides come from tables, so that a hot text's rows can be split
    alone = F.col("group_size").isNull()
    some = some.select(
        F.col("_id").alias(id_col), F.when(alone, F.col("_id")).otherwise(-F.col("_best.i")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (alone | (-F.col("_best.r") == F.col("_row"))).alias("kept"), "text_sha256",
    )
    rest = marked.filter("not maybe").select(F.col("_id").alias(id_col), F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    return rest.unionByName(some)


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_bits: int = FILTER_BITS) -> DataFrame:
    """docs without the rows that exact_duplicates() does not keep; all columns stay. Rows that the filter clears are never shuffled,
    nor are others while the texts that occur twice are few enough to broadcast.

    Null counts as empty, a null id loses against any other. Of rows with equal id and text just one stays, whichever
    comes first, whatever other columns hold. Texts are read whole; an empty table gives an empty result; columns other
    than the two named play no part, whatever their names.
    """
    keyed = docs.select(whole_row(docs).alias("_row"), F.col(id_col).cast("long").alias("_id"), text_key(F.col(text_col)).alias("text_sha256"), F.char_length(F.coalesce(F.col(text_col), F.lit(""))).alias("_n"))
    base = materialize(keyed.select("_id", "text_sha256", "_n"), "exact-hashes")
    words = materialize(repeated_words(base, filter_bits), "exact-filter")
    # rows that agree in all three are counted first, so that however many they are they never meet in one group
    equal = mark_repeated(base, words, filter_bits).filter("maybe").groupBy("text_sha256", "_id", "_n").agg(F.count("*").alias("rows"))
    equal = materialize(equal, "exact-equal")
    best = equal.groupBy("text_sha256").agg(F.max(F.struct("_n", (-F.col("_id")).alias("i"), "rows")).alias("b"), F.sum("rows").alias("size"))
    groups = materialize(best.filter("size > 1").select(F.col("text_sha256").alias("k"), (-F.col("b.i")).alias("i"), F.col("b._n").alias("m"), (F.col("b.rows") > 1).alias("again")), "exact-stay")
    won, again = F.col("_id").eqNullSafe(F.col("i")) & (F.col("_n") == F.col("m")), F.col("again")
    if groups.count() <= BROADCAST_GROUPS:  # one pass, in which no text is shuffled
        held = keyed.join(F.broadcast(groups), F.col("text_sha256") == F.col("k"), "left")
        kept = held.filter(F.col("k").isNull() | (won & ~again))
    else:
        marked = mark_repeated(keyed, words, filter_bits)
        held = marked.filter("maybe").join(groups, F.col("text_sha256") == F.col("k"), "left")
        kept = marked.filter("not maybe").select("_row").unionByName(held.filter(F.col("k").isNull() | (won & ~again)).select("_row"))
    kept = kept.select("_row")
    if not groups.filter("again").isEmpty():
        kept = kept.unionByName(held.filter(F.col("k").isNotNull() & won & again).dropDuplicates(["text_sha256", "_id", "_n"]).select("_row"))
    return kept.select("_row.*")
