"""Document fingerprints by winnowing, in DataFrame functions only.

A gram is `GRAM` consecutive words; its hash is built by doubling (pairs, then pairs of pairs).
Of every `WINDOW` consecutive grams the least hash is kept, the rightmost of equal ones, with its
position. Any run of GRAM + WINDOW - 1 equal words in two texts therefore leaves a common entry.

The least of a window is found by doubling as well, on values that hold the hash above the
complement of the position: three passes for a window of eight, whatever the text's length.

Defined cases: a null text counts as empty; an empty or blank text has no entries; under GRAM words
all words are one gram; under WINDOW grams all grams are one window. Two texts without entries
are alike (1.0), one without and one with entries are not (0.0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, saved

#: Powers of two, as both come of doubling.
GRAM, WINDOW = 4, 8
#: Low bits for the position: the most entries an array can have.
_BITS, _LAST = 31, (1 << 31) - 1


def _from(a: Column, start: int) -> Column:
    return F.slice(a, start, F.greatest(F.size(a) - (start - 1), F.lit(0)))


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with `out`: array<bigint> of entries in text order, each hash << 31 | complement of the position."""
    w, h, g, v, m = (f"{out}_{x}" for x in "whgvm")
    df = df.withColumn(w, F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), "[ \\x09-\\x0D]+"), ""))
    df = df.withColumn(h, F.transform(w, lambda x: F.xxhash64(x)))
    df = df.withColumn(g, F.col(h))
    step = 1
    while step < GRAM:
        df = df.withColumn(g, F.zip_with(F.col(g), _from(F.col(g), step + 1), lambda a, b: F.xxhash64(a, b)))
        step *= 2
    n = F.size(h)
    whole = F.when(n > 0, F.array(F.xxhash64(F.col(h)))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn(g, F.when(n >= GRAM, F.slice(g, 1, F.greatest(n - (GRAM - 1), F.lit(0)))).otherwise(whole))
    df = df.withColumn(v, F.transform(g, lambda x, i: F.shiftleft(F.hash(x).cast("bigint"), _BITS).bitwiseOR(F.lit(_LAST).cast("bigint") - i)))
    df = df.withColumn(m, F.col(v))
    step = 1
    while step < WINDOW:
        df = df.withColumn(m, F.zip_with(F.col(m), _from(F.col(m), step + 1), lambda a, b: F.least(a, b)))
        step *= 2
    k = F.size(v)
    few = F.when(k > 0, F.array(F.array_min(v))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn(out, F.when(k >= WINDOW, F.array_distinct(F.slice(m, 1, F.greatest(k - (WINDOW - 1), F.lit(0))))).otherwise(few))
    return df.drop(w, h, g, v, m)


def hashes(entries: Column) -> Column:
    """The distinct hashes of the entries."""
    return F.array_distinct(F.transform(entries, lambda x: F.shiftright(x, _BITS).cast("int")))


def positions(entries: Column) -> Column:
    """The gram positions of the entries."""
    return F.transform(entries, lambda x: (F.lit(_LAST).cast("bigint") - x.bitwiseAND(F.lit(_LAST).cast("bigint"))).cast("int"))


def as_string(entries: Column) -> Column:
    """hash:position of each entry, in text order."""
    pair = F.transform(
        entries,
        lambda x: F.concat(F.shiftright(x, _BITS).cast("string"), F.lit(":"), (F.lit(_LAST).cast("bigint") - x.bitwiseAND(F.lit(_LAST).cast("bigint"))).cast("string")),
    )
    return F.array_join(pair, " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct hashes."""
    both = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - both
    return F.when(total == 0, F.lit(1.0)).otherwise(both / total)


def followers(docs: DataFrame) -> DataFrame:
    """(doc_id, th, n_chars, next_id, next_th): the following row in descending doc_id, round again at the end.

    Rows are cut into ranges of ids; inside a range a window finds the next row, and the first rows
    of the ranges (one each) link the ranges up. th is the text's hash: it orders rows that share
    an id; null ids come last.
    """
    spark = docs.sparkSession
    ids = docs.select("doc_id", F.xxhash64("text").alias("th"), F.length("text").alias("n_chars")).distinct()
    order = [F.col("doc_id").desc_nulls_last(), F.col("th")]
    ids = saved(ids.repartitionByRange(partitions(spark), *order).withColumn("range", F.spark_partition_id()))
    inside = Window.partitionBy("range").orderBy(*order)
    me = F.struct("doc_id", "th")
    ids = ids.withColumn("next", F.lead(me).over(inside)).withColumn("place", F.row_number().over(inside))
    firsts = ids.filter("place = 1").select("range", me.alias("first"))
    ranges = Window.orderBy("range")  # one row a range
    everything = ranges.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = firsts.select("range", F.coalesce(F.lead("first").over(ranges), F.first("first").over(everything)).alias("after"))
    ids = ids.join(after, "range").withColumn("next", F.coalesce("next", "after"))
    return ids.select("doc_id", "th", "n_chars", F.col("next.doc_id").alias("next_id"), F.col("next.th").alias("next_th"))


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they and the next text's are.

    The edited text has its last third replaced by as many code points from the start of the next
    document. Only that much of the next text, and its hashes, travel to the document.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    links = followers(rows)

    def key(i: str, t: Column) -> list[Column]:
        """A key of columns that are never null, so that joins and grouping share one partitioning."""
        return [F.coalesce(i, F.lit(0)).alias("i"), F.isnull(i).alias("nil"), t.alias("t")]

    names = ["i", "nil", "t"]
    base = rows.select(*key("doc_id", F.xxhash64("text")), "text")
    before = links.select(
        *key("next_id", F.col("next_th")),
        F.struct(*(c.alias(n) for c, n in zip(key("doc_id", F.col("th")), names, strict=True))).alias("prev"),
        F.floor(F.col("n_chars") / 3).cast("int").alias("cut"),
    )
    giving = base.join(before, names, "left").dropDuplicates(names)
    giving = with_fingerprint(giving, "text", "next_fp")
    given = giving.select("prev.*", F.substring("text", F.lit(1), F.col("cut")).alias("prefix"), hashes(F.col("next_fp")).alias("next_hashes"))
    out = base.join(given, names, "left").withColumn("n_chars", F.length("text"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    out = out.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars") - cut), "prefix"))
    out = with_fingerprint(with_fingerprint(out, "text", "fp"), "edited", "edited_fp")
    out = out.withColumn("own", hashes(F.col("fp"))).withColumn("other", hashes(F.col("edited_fp")))
    return out.select(
        F.when(~F.col("nil"), F.col("i")).alias("doc_id"),
        F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_string(F.col("fp")).alias("fingerprint"),
        as_string(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_hashes")).alias("near_next"),
    )
