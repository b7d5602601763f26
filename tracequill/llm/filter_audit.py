"""Filter interaction audit: what five filters remove, for every order in which they can be applied.

Each document fails a set of filters. A step of an order is an edge of the lattice of filter sets,
from the set already applied to that set with one filter more; there are 80 edges (16 sets without
the filter, for each of 5 filters), and a document counts on each in one of a few ways. Counts are
aggregated by part and failing set first, so that at most 32 rows a part meet the 80 edges; the
aggregated edges are then joined to the 600 steps of the 120 orders, which are paths in the lattice.

Filters (a text fails): A under 50 words; B fewer than 65 distinct words in 100; C over 5 capitals
A-Z in 100 code points; D one of `#$%&*|`; E equal to the text of a smaller doc_id. Since A to D
depend on the text alone and E on the smallest id of a text, rows are grouped by the text's hash:
all rows of a text but those of its smallest id fail E, and no row is joined to its copies.

Defined cases: a null text is empty; a null source is the part ''; a row with a null doc_id neither
fails E nor makes others fail it, and has no label; repeated rows count each; rows of the smallest id
do not fail E, however many; of several labels of one document the positive one holds; an empty
table gives no rows; other columns, clashing names included, are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The filters' letters; filter k is bit k of a failing set.
LETTERS = "ABCDE"
#: Words are what stands between these characters.
SPACES = r"[\x20\x09-\x0D]+"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_failures(text: Column) -> Column:
    """The failing set of filters A to D as bits 0 to 3."""
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    seen = F.size(words)
    few = seen < 50
    repeated = 100 * F.size(F.array_distinct(words)) < 65 * seen
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    loud = 100 * capitals > 5 * F.length(text)
    marked = text.rlike(r"[#$%&*|]")
    return sum((F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate((few, repeated, loud, marked))), F.lit(0))


def failing_sets(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the set of filters they fail."""
    text = F.coalesce("text", F.lit(""))
    digest = F.unhex(F.substring(F.sha2(text, 256), 1, 32))
    rows = docs.select(
        # Rows without an id meet no label; their key spreads them.
        F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(text)).alias("key"),
        F.col("doc_id").isNull().alias("absent"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        digest.alias("digest"),
        text_failures(text).alias("mask"),
    )
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("key"), F.lit(False).alias("absent"))
    marks = marks.agg(*(F.max(F.coalesce(F.col(c) == 1, F.lit(False))).cast("int").alias(to) for c, to in (("quality", "good"), ("toxic", "toxic"))))
    marks = marks.withColumn("absent", F.lit(False))
    rows = rows.join(marks, ["key", "absent"], "left").fillna(0, ["good", "toxic"])
    kind = ["digest", "mask", "part", "good", "toxic"]
    ids = rows.groupBy("key", "absent", *kind).agg(F.count("*").alias("n"))
    known = F.when(~F.col("absent"), F.struct("key", "n"))
    texts = ids.groupBy(*kind).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("absent"), F.col("n")).otherwise(0)).alias("n_absent"), F.min(known).alias("least")
    )
    # A row here is a text within a part and its labels: few a text, however often it occurs.
    first = F.min("least.key").over(Window.partitionBy("digest"))
    own = F.when(F.col("least.key") == F.col("first"), F.col("least.n")).otherwise(0)
    texts = texts.withColumn("first", first).withColumn("clear", F.col("n_absent") + own)
    both = F.array(
        F.struct(F.col("mask").alias("mask"), F.col("clear").alias("n")),
        F.struct((F.col("mask") + (1 << 4)).alias("mask"), (F.col("n") - F.col("clear")).alias("n")),
    )
    sets = texts.select("part", "good", "toxic", F.explode(both).alias("s")).select("part", "good", "toxic", "s.*")
    n = F.col("n")
    return sets.groupBy("part", "mask").agg(F.sum("n").alias("n"), *(F.sum(n * F.col(c)).alias(c) for c in ("good", "toxic")))


def edge_counts(sets: DataFrame) -> DataFrame:
    """(part, applied, filter, counts): the 80 edges of each part; applied is a set, filter a bit's number."""
    edges = [(s, f) for f in range(5) for s in range(32) if not s >> f & 1]
    table = F.array(*(F.struct(F.lit(s).alias("applied"), F.lit(f).alias("filter")) for s, f in edges))
    rows = sets.select("*", F.explode(table).alias("e")).select(*sets.columns, "e.*")
    hit = F.expr("shiftright(mask, filter) & 1 = 1")
    before = F.expr("mask & applied <> 0")
    alone = F.expr("mask = shiftleft(1, filter)")

    def total(when: Column, what: str = "n") -> Column:
        return F.sum(F.when(when, F.col(what)).otherwise(F.lit(0)))

    counts = (total(~before & ~hit), total(~before & hit), total(before & hit), total(alone), total(~before & hit, "good"), total(~before & hit, "toxic"))
    return rows.groupBy("part", "applied", "filter").agg(*(c.alias(name) for c, name in zip(counts, COUNTS, strict=True)))


def order_steps(spark) -> DataFrame:
    """(filter_order, step, applied, filter): the 600 steps of all orders."""
    rows = []
    for order in permutations(range(5)):
        for k, f in enumerate(order):
            rows.append(("".join(LETTERS[i] for i in order), k + 1, sum(1 << i for i in order[:k]), f))
    return spark.createDataFrame(rows, "filter_order string, step int, applied int, filter int")


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part of docs (doc_id, text, source), order of the filters and step.

    kept, removed: documents of the part that pass, or fall at, this step; redundant: fail its filter
    but fell earlier; unique_fails: fail its filter alone; good_lost, toxic_lost: removed here with that
    label; shapley: removed by its filter over all orders.
    """
    steps = F.broadcast(order_steps(docs.sparkSession))  # always 600 rows
    paths = edge_counts(failing_sets(docs, labels)).join(steps, ["applied", "filter"])
    shapley = F.sum("removed").over(Window.partitionBy("part", "filter"))
    return paths.select("part", "filter_order", "step", *COUNTS, shapley.alias("shapley"))
