"""Comparison of a normal and a faulty run: normalise, align, diverge, filter noise, score.

Runs come in pairs: a column (`pair`) names the pair that an event belongs to, so any number of pairs
are compared in one job. Equal beginnings and ends are matched by joins on the position; what lies between
is cut where a match is forced or a place is passed whatever lies around it, and only the fingerprints of a piece travel to the aligner, one task a piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import RUN_KEYS, canonical_map, context_text
from ..plans.stages import saved
from .asof import as_of
from .banded import aligned, meeting

#: The least half-width of the band around the diagonal, and the least significance reported.
BAND, LEAST = 256, 0.3
#: Events between places where a cut is tried, and the widest offset for which it is.
STEP, WIDEST = 8192, 4096
#: Kinds of difference that change the path taken, and context keys that may differ freely.
PATH_KINDS = ("error-introduced", "stack-change", "event-inserted", "event-missing", "channel-sequence")
CHURN = r"(?i)^(timestamp|time|now|monotonic|duration|cost|latency|elapsed|bytes|count)"
_EVENT = ("channel", "event_type", "ts_ms", "duration_ms", "operation_id", "context_json", "error_message", "error_stack")


def _placed(rows: DataFrame, pair: str) -> DataFrame:
    """rows with their place i in the pair and rel_ms: counted in ranges of equal size, so that one long run is many tasks."""
    order = ["ts_ms", "channel", "seq"]
    count = 4 * max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cut = saved(rows.repartitionByRange(count, pair, *order).withColumn("_block", F.spark_partition_id()))
    sizes = cut.groupBy(F.col(pair).alias("_pair"), F.col("_block").alias("_at")).agg(F.count("*").alias("_n"), F.min("ts_ms").alias("_low"))
    earlier = Window.partitionBy("_pair").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_pair", "_at", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.min("_low").over(Window.partitionBy("_pair")).alias("_low"))
    placed = cut.withColumn("_own", F.row_number().over(Window.partitionBy("_block", pair).orderBy(*order)))
    placed = placed.join(sizes, F.col(pair).eqNullSafe(F.col("_pair")) & (F.col("_block") == F.col("_at")))
    return placed.select(*rows.columns, (F.col("_before") + F.col("_own") - 1).alias("i"), (F.col("ts_ms") - F.col("_low")).alias("rel_ms"))


def normalise(events: DataFrame, pair: str, ignore: tuple[str, ...] = ()) -> DataFrame:
    """Events in order of time and channel with their place i, rel_ms since the first, signature, fingerprint and entries.

    Rows without a channel or a time are left out.
    """
    rows = events.filter("channel <> '' AND ts_ms IS NOT NULL")
    for name in ("error_stack", "error_message"):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("string"))
    rows = _placed(rows, pair)
    rows = rows.withColumn("signature", F.concat_ws("|", "channel", "event_type")).withColumn("entries", canonical_map("context_json"))
    return rows.withColumn("fingerprint", F.concat_ws("|", "signature", context_text("entries", RUN_KEYS + tuple(ignore))))


def _piece(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    left, right = left.sort_values("i"), right.sort_values("i")
    some = (left if len(left) else right).iloc[0]
    low, high = -int(some["reach"]) - int(some["shift"]), int(some["reach"]) - int(some["shift"])
    pa, pb, cost = aligned(*(x[c].to_numpy() for c in ("f", "s") for x in (left, right)), low, high)
    # The last element stands for "none": places of -1 pick it.
    ia, ib = (np.append(x["i"].to_numpy(np.int64), -1) for x in (left, right))
    return pd.DataFrame({"pair": some["pair"], "piece": int(some["piece"]), "k": np.arange(len(pa)), "a": ia[pa], "b": ib[pb], "cost": cost})


def forced(a: DataFrame, b: DataFrame, reach: DataFrame) -> DataFrame:
    """a, b (pair, x, f), reach (pair, reach: widest offset) -> runs of a that every cheapest alignment matches with b.

    (pair, piece, start, end, shift): a's places start to end - 1 meet those of b that are shift further on.

    Places of a are cut into blocks of 2 * reach + 1. A block is solid if each of its fingerprints occurs once
    in a and once in b and all on one diagonal. A way that keeps off it pays at least 1 a place; to go over to
    it and back costs at most 8 * reach. So between four solid blocks and four more every cheapest way is on
    that diagonal. Needs counts by fingerprint and by block, no order of events.
    """
    once = lambda x, n: x.groupBy("pair", "f").agg(F.min("x").alias(n), F.count("*").alias("n")).filter("n = 1").drop("n")
    met = once(a, "x").join(once(b, "y"), ["pair", "f"]).join(reach, "pair").withColumn("shift", F.col("y") - F.col("x"))
    met = met.filter(F.abs("shift") <= F.col("reach")).withColumn("size", 2 * F.col("reach") + 1)
    blocks = met.groupBy("pair", "size", F.expr("x div size").alias("block")).agg(F.count("*").alias("n"), F.min("shift").alias("shift"), F.max("shift").alias("_most"))
    blocks = blocks.filter("n = size AND shift = _most")
    around = Window.partitionBy("pair", "shift").orderBy("block").rangeBetween(-4, 4)
    core = blocks.withColumn("_near", F.count("*").over(around)).filter("_near = 9")
    by = Window.partitionBy("pair").orderBy("block")
    new = F.coalesce((F.lag("block").over(by) != F.col("block") - 1).cast("int"), F.lit(1))
    core = core.withColumn("_new", new).withColumn("piece", F.sum("_new").over(by))
    ends = core.groupBy("pair", "piece", "shift").agg(F.min(F.col("block") * F.col("size")).alias("start"), F.max((F.col("block") + 1) * F.col("size")).alias("end"))
    return ends.select("pair", "piece", "start", "end", "shift")


def _met(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    none = pd.DataFrame({"pair": [], "start": [], "shift": []})
    if not len(left) or not len(right):
        return none
    left, right = left.sort_values("x"), right.sort_values("x")
    reach, start = int(left["reach"].iloc[0]), int(left["at"].iloc[0])
    if len(left) != 4 * reach or len(right) != 6 * reach:
        return none
    shift = meeting(*(x[c].to_numpy() for c in ("f", "s") for x in (left, right)), reach)
    return none if shift is None else pd.DataFrame({"pair": [left["pair"].iloc[0]], "start": [start], "shift": [shift]})


def met(a: DataFrame, b: DataFrame, step: int = STEP) -> DataFrame:
    """a, b (pair, x, f, s, reach) -> (pair, start, shift): places that every cheapest alignment passes, tried every `step` events.

    Up to a's place start and b's place start + shift all is aligned on its own, and so is what follows. Needs
    no fingerprints that occur once, and edits may be as close as they like, if only equal events are rare
    off the offset. A task looks at 4 * reach events of a and 6 * reach of b.
    """
    wide = F.greatest(F.lit(step), 16 * F.col("reach"))

    def near(x: DataFrame, most: Column) -> DataFrame:
        spot = F.floor((F.col("x") + most) / wide).cast("long") * wide
        return x.withColumn("at", spot).filter((F.col("at") > 0) & (F.col("x") < F.col("at") + most)).select("pair", "at", "x", "f", "s", "reach")

    kind = a.schema["pair"].dataType.simpleString()
    windows = near(a, 2 * F.col("reach")).groupBy("pair", "at").cogroup(near(b, 3 * F.col("reach")).groupBy("pair", "at"))
    return windows.applyInPandas(_met, f"pair {kind}, start long, shift long")


def align(normal: DataFrame, fault: DataFrame, pair: str, band: int = BAND) -> DataFrame:
    """Normalised runs -> (pair, place, normal_index, fault_index, kind, cost): match, substitute, delete or insert.

    place is the order of the pairs: the common beginning, what lies between, the common end from its last
    event on. What lies between is cut by forced() and met(), and the pieces are aligned in tasks of their
    own; the result is that of one alignment of the whole.
    """
    def slim(x: DataFrame) -> DataFrame:
        x = saved(x.select(F.col(pair).alias("pair"), "i", F.xxhash64("fingerprint").alias("f"), F.xxhash64("signature").alias("s")))
        last = x.groupBy("pair").agg(F.max("i").alias("_last"))
        return saved(x.join(last, "pair").select("pair", "i", (F.col("_last") - F.col("i")).alias("r"), "f", "s"))

    a, b = slim(normal), slim(fault)
    sizes = a.groupBy("pair").agg(F.count("*").alias("n")).join(b.groupBy("pair").agg(F.count("*").alias("m")), "pair", "full").fillna(0)

    def common(by: str) -> DataFrame:
        """How many events from one end on are the same."""
        both = a.select("pair", by, "f").join(b.select("pair", by, F.col("f").alias("g")), ["pair", by], "full")
        return both.filter(~F.col("f").eqNullSafe(F.col("g"))).groupBy("pair").agg(F.min(by).alias(by))

    least = F.least("n", "m")
    cuts = sizes.join(common("i"), "pair", "left").join(common("r"), "pair", "left").withColumn("p", F.coalesce("i", least))
    cuts = cuts.withColumn("e", F.least(F.coalesce("r", least), least - F.col("p"))).withColumn("reach", F.greatest(F.lit(band), F.abs(F.col("n") - F.col("m"))))
    cuts = saved(cuts.select("pair", "n", "m", "p", "e", "reach"))

    def between(x: DataFrame) -> DataFrame:
        return saved(x.join(cuts, "pair").filter((F.col("i") >= F.col("p")) & (F.col("r") >= F.col("e"))).select("pair", (F.col("i") - F.col("p")).cast("long").alias("x"), F.col("i").cast("long").alias("i"), "f", "s", "reach"))

    mid_a, mid_b = between(a), between(b)
    # Shorter ones have no room for nine solid blocks.
    long = cuts.filter(least - F.col("p") - F.col("e") >= 9 * (2 * F.col("reach") + 1)).select("pair", "reach")
    runs = None
    if not long.isEmpty():
        runs = saved(forced(*(x.select("pair", "x", "f").join(long, "pair", "left_semi") for x in (mid_a, mid_b)), long))
        room = long.filter(F.col("reach") <= WIDEST).select("pair")
        cells = saved(met(*(x.join(room, "pair", "left_semi") for x in (mid_a, mid_b))))
        # Inside of a run or at its ends there is nothing to cut.
        taken = runs.select(F.col("pair").alias("_pair"), F.col("start").alias("_from"), F.col("end").alias("_to"))
        cells = cells.join(taken, (F.col("pair") == F.col("_pair")) & (F.col("start") >= F.col("_from")) & (F.col("start") <= F.col("_to")), "left_anti")
        both = runs.drop("piece").unionByName(cells.select("pair", "start", F.col("start").alias("end"), "shift"))
        runs = saved(both.withColumn("piece", F.row_number().over(Window.partitionBy("pair").orderBy("start")).cast("long")))
    if runs is None or runs.isEmpty():
        whole = lambda x: x.withColumn("piece", F.lit(0).cast("long")).withColumn("shift", F.lit(0).cast("long"))
        left, right, matched = whole(mid_a), whole(mid_b), None
    else:
        in_b = runs.withColumn("start", F.col("start") + F.col("shift")).withColumn("end", F.col("end") + F.col("shift"))

        def split(x: DataFrame, runs: DataFrame) -> DataFrame:
            """The last run that begins at or before a place, and whether the place is in it."""
            at = as_of(x, runs.select("pair", F.col("start").alias("x"), "piece", "end", "shift"), ["pair"], "x", ["piece", "end", "shift"], "_run")
            return saved(at.select(*x.columns, (F.coalesce("_run.piece", F.lit(0)).cast("long")).alias("piece"), F.coalesce("_run.shift", F.lit(0)).cast("long").alias("shift"), F.coalesce(F.col("x") < F.col("_run.end"), F.lit(False)).alias("_in")))

        left, right = split(mid_a, runs), split(mid_b, in_b)
        matched = left.filter("_in").select("pair", "piece", "x", F.col("i").alias("a"), (F.col("i") + F.col("shift")).alias("b"))
        left, right = left.filter("NOT _in"), right.filter("NOT _in")

    kind = a.schema["pair"].dataType.simpleString()
    pieces = left.groupBy("pair", "piece").cogroup(right.groupBy("pair", "piece")).applyInPandas(_piece, f"pair {kind}, piece long, k long, a long, b long, cost long")
    pieces = saved(pieces)
    lengths = pieces.groupBy("pair", "piece").agg(F.count("*").alias("own")).withColumn("run", F.lit(0).cast("long"))
    if runs is not None:
        lengths = lengths.unionByName(runs.select("pair", "piece", F.lit(0).cast("long").alias("own"), (F.col("end") - F.col("start")).alias("run")))
    lengths = lengths.groupBy("pair", "piece").agg(F.sum("own").alias("own"), F.sum("run").alias("run"))
    # A run goes before the piece of its number.
    before = Window.partitionBy("pair").orderBy("piece")
    spots = lengths.withColumn("_to", F.sum(F.col("own") + F.col("run")).over(before)).join(cuts.select("pair", "p"), "pair")
    spots = saved(spots.select("pair", "piece", (F.col("p") + F.col("_to") - F.col("own")).alias("first"), (F.col("p") + F.col("_to") - F.col("own") - F.col("run")).alias("first_run"), "own", "run"))
    middle = pieces.join(spots, ["pair", "piece"]).select("pair", (F.col("first") + F.col("k")).alias("place"), "a", "b", "cost")
    if matched is not None:
        at = matched.join(spots, ["pair", "piece"]).join(runs.select("pair", "piece", "start"), ["pair", "piece"])
        middle = middle.unionByName(at.select("pair", (F.col("first_run") + F.col("x") - F.col("start")).alias("place"), "a", "b", F.lit(0).cast("long").alias("cost")))
    size = spots.groupBy("pair").agg(F.sum(F.col("own") + F.col("run")).alias("size"))
    ends = a.join(cuts, "pair").join(size, "pair", "left").filter((F.col("i") < F.col("p")) | (F.col("r") < F.col("e")))
    tail = F.col("i") >= F.col("p")
    ends = ends.select(
        "pair", F.when(tail, F.col("p") + F.coalesce("size", F.lit(0)) + F.col("r")).otherwise(F.col("i")).cast("long").alias("place"), F.col("i").cast("long").alias("a"),
        F.when(tail, F.col("m") - 1 - F.col("r")).otherwise(F.col("i")).cast("long").alias("b"), F.lit(0).cast("long").alias("cost"),
    )
    named = F.when(F.col("cost") == 0, "match").when(F.col("b") < 0, "delete").when(F.col("a") < 0, "insert").otherwise("substitute")
    return ends.unionByName(middle).select(F.col("pair").alias(pair), "place", F.col("a").alias("normal_index"), F.col("b").alias("fault_index"), named.alias("kind"), "cost")


def alignment_summary(pairs: DataFrame, pair: str) -> DataFrame:
    """(pair, cost, edits, matches, similarity): matches as a share of the longer run."""
    c = pairs.groupBy(pair).agg(
        F.sum("cost").alias("cost"), F.count_if(F.col("kind") != "match").alias("edits"), F.count_if(F.col("kind") == "match").alias("matches"),
        F.greatest(F.count_if(F.col("normal_index") >= 0), F.count_if(F.col("fault_index") >= 0), F.lit(1)).alias("longest"),
    )
    return c.select(pair, "cost", "edits", "matches", (F.col("matches") / F.col("longest")).alias("similarity"))


def _lines(stack: str) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(stack, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def event_diffs(pairs: DataFrame, normal: DataFrame, fault: DataFrame, pair: str) -> DataFrame:
    """What differs in each pair that is no match: values by context key, stack lines by level, kind and significance."""

    def side(x: DataFrame, name: str) -> DataFrame:
        given = [c for c in _EVENT if c in x.columns]
        return x.select(pair, F.col("i").cast("long").alias(f"{name}_index"), F.struct(*given, "entries").alias(name))

    rows = pairs.filter("kind <> 'match'").join(side(normal, "normal"), [pair, "normal_index"], "left").join(side(fault, "fault"), [pair, "fault_index"], "left")
    empty = F.create_map().cast("map<string,string>")
    raw = lambda s: F.coalesce(F.from_json(f"{s}.context_json", "map<string,string>"), empty)
    zipped = F.map_zip_with(F.coalesce("normal.entries", empty), F.coalesce("fault.entries", empty), lambda k, x, y: F.struct(x.alias("x"), y.alias("y")))
    changed = F.filter(F.map_entries(zipped), lambda e: ~e["value"]["x"].eqNullSafe(e["value"]["y"]))
    how = lambda v: F.when(v["y"].isNull(), "removed").when(v["x"].isNull(), "added").otherwise("changed")
    values = F.array_sort(F.transform(changed, lambda e: F.struct(e["key"].alias("key"), how(e["value"]).alias("change"), F.col("_before")[e["key"]].alias("before"), F.col("_after")[e["key"]].alias("after"))))
    rows = rows.withColumn("_before", raw("normal")).withColumn("_after", raw("fault")).withColumn("value_diffs", values)
    levels = F.transform(F.arrays_zip(_lines("normal.error_stack").alias("x"), _lines("fault.error_stack").alias("y")), lambda z, i: F.struct(i.alias("level"), z["x"].alias("before"), z["y"].alias("after")))
    rows = rows.withColumn("stack_diffs", F.filter(levels, lambda z: ~z["before"].eqNullSafe(z["after"])))
    failed = lambda s: F.coalesce(f"{s}.error_message", f"{s}.error_stack").isNotNull()
    rows = rows.withColumn("introduced", failed("fault") & ~failed("normal"))
    kind = (
        F.when(F.col("introduced"), "error-introduced").when(F.col("kind") == "insert", "event-inserted").when(F.col("kind") == "delete", "event-missing")
        .when(F.size("stack_diffs") > 0, "stack-change").otherwise("event-value-change")
    )
    rows = rows.withColumn("diff_kind", kind)
    return rows.withColumn("significance", significance("diff_kind", "value_diffs", "stack_diffs")).drop("_before", "_after")


def significance(kind: str, values: str, stacks: str) -> Column:
    """How much a kind of difference says; value changes by their number."""
    k = F.col(kind)
    few = F.when(F.size(values) >= 3, 0.7).when((F.size(values) == 0) & (F.size(stacks) == 0), 0.3).otherwise(0.5)
    return F.when(k == "error-introduced", 1.0).when(k == "stack-change", 0.9).when(k.isin("event-missing", "event-inserted"), 0.8).when(k == "channel-sequence", 0.75).otherwise(few)


def _told(side: str) -> Column:
    """An event in words, with up to three of its context's keys."""
    keys = F.json_object_keys(f"{side}.context_json")
    some = F.concat(F.array_join(F.slice(keys, 1, 3), ", "), F.when(F.size(keys) > 3, ", …").otherwise(""))
    context = F.when(F.size(keys) > 0, F.concat(F.lit(" context {"), some, F.lit("}"))).otherwise("")
    return F.when(F.col(side).isNull(), f"{side}: (none)").otherwise(F.concat(F.lit(f"{side}: "), f"{side}.channel", F.lit(" "), f"{side}.event_type", F.coalesce(context, F.lit(""))))


#: Kinds in words.
KIND_WORDS = {
    "event-value-change": "an event ran with different variable values",
    "event-inserted": "the fault run executed an extra event",
    "event-missing": "the fault run skipped an event that the normal run executed",
    "error-introduced": "the fault run threw an error",
    "stack-change": "the same operation produced a different stack trace",
    "channel-sequence": "events executed in a different order",
}


def divergences(diffs: DataFrame, pair: str, least: float = LEAST, effects: tuple[str, ...] = ()) -> DataFrame:
    """Regions of consecutive differences, each with its representative, role, confidence and a sentence.

    The representative is the first pair that brings an error in, else the first one. Only the first
    region of a pair is a cause; later ones on its channel, or with errors, are effects.
    """
    by = Window.partitionBy(pair).orderBy("place")
    rows = diffs.withColumn("region", F.col("place") - F.row_number().over(by))
    body = F.struct("normal_index", "fault_index", "normal", "fault", "diff_kind", "significance", "value_diffs", "stack_diffs")
    c = rows.groupBy(pair, "region").agg(
        F.count("*").alias("size"), F.min("place").alias("at"), F.min_by(body, "place").alias("first"), F.bool_or("introduced").alias("introduces"),
        F.min_by(body, F.when(F.col("introduced"), F.col("place"))).alias("failing"),
        F.min(F.when(F.col("normal_index") >= 0, F.col("normal_index"))).alias("low_normal"), F.min(F.when(F.col("fault_index") >= 0, F.col("fault_index"))).alias("low_fault"),
    )
    order = Window.partitionBy(pair).orderBy("at")
    c = c.withColumn("r", F.row_number().over(order) - 1).withColumn("rep", F.coalesce("failing", "first"))
    channel = F.coalesce("first.normal.channel", "first.fault.channel")
    c = c.withColumn("channel_", channel).withColumn("primary", F.first("channel_").over(order))
    same = (F.col("channel_") == F.col("primary")) | F.col("channel_").isin(*effects) if effects else F.col("channel_") == F.col("primary")
    both = (F.col("first.normal_index") >= 0) & (F.col("first.fault_index") >= 0)
    role = F.when(F.col("r") == 0, "cause").when(same | F.col("introduces"), "effect").otherwise("ambiguous")
    reason = (
        F.when((F.col("r") == 0) & F.col("introduces"), "the first event where the fault run raises an error the normal run does not")
        .when(F.col("r") == 0, F.concat(F.lit("the first event where the two runs diverge ("), F.translate("first.diff_kind", "-", " "), F.lit(")")))
        .when(same, "same channel as the primary divergence — a downstream symptom")
        .when(F.col("introduces"), "error surfaced downstream of the original divergence")
        .when(both, "independent divergence not on the primary channel")
        .otherwise("structural difference with unclear causality")
    )
    kind, weight = F.col("rep.diff_kind"), F.col("rep.significance")
    base = F.when(kind.isin("error-introduced", "event-missing"), F.greatest(weight, F.lit(0.85))).when(kind == "stack-change", F.greatest(weight, F.lit(0.8))).otherwise(weight)
    sure = F.least(F.lit(1.0), F.greatest(F.lit(0.0), base + F.least(F.lit(0.15), F.col("size") * 0.03) - F.least(F.lit(0.3), F.col("r") * 0.05)))
    words = F.coalesce(*(F.when(kind == k, v) for k, v in KIND_WORDS.items()), F.lit("the runs diverged"))
    c = c.withColumn("normal", F.col("rep.normal")).withColumn("fault", F.col("rep.fault"))
    told = F.concat(words, F.when(F.col("size") > 1, F.concat(F.lit(" ("), F.col("size"), F.lit(" consecutive differing events)"))).otherwise(""), F.lit(". "), _told("normal"), F.lit(" vs "), _told("fault"))
    c = c.withColumn("role", role).withColumn("reason", reason).withColumn("confidence", sure).withColumn("description", told)
    c = c.filter(weight >= least).withColumn("order", F.row_number().over(order))
    return c.select(
        pair, "order", kind.alias("kind"), "rep.normal_index", "rep.fault_index", "role", "reason", "confidence", weight.alias("significance"), "description", F.col("size").cast("long").alias("size"),
        "rep.value_diffs", "rep.stack_diffs", "normal", "fault", F.coalesce("low_normal", F.lit(-1)).alias("low_normal"), F.coalesce("low_fault", F.lit(-1)).alias("low_fault"),
    )


def first_divergence(points: DataFrame) -> DataFrame:
    return points.filter(F.col("order") == 1)


def unmasked(points: DataFrame, noise_normal: DataFrame | None, noise_fault: DataFrame | None, pair: str) -> DataFrame:
    """Divergences whose place lies in no noise region (pair, first, last) of either run."""
    for noise, index in ((noise_normal, "normal_index"), (noise_fault, "fault_index")):
        if noise is not None:
            region = noise.select(F.col(pair).alias("_pair"), "first", "last")
            inside = (points[pair] == region["_pair"]) & (points[index] >= region["first"]) & (points[index] <= region["last"])
            points = points.join(region, inside, "left_anti")
    return points


def semantic(points: DataFrame, pair: str, noise_normal: DataFrame | None = None, noise_fault: DataFrame | None = None, least: float = LEAST) -> DataFrame:
    """Divergences that are neither noise nor mere churn of times and counts, with the change of duration."""
    rows = unmasked(points, noise_normal, noise_fault, pair)
    structural = F.exists("value_diffs", lambda v: ~v["key"].rlike(CHURN))
    churn = (F.col("kind") == "event-value-change") & ~structural & (F.col("significance") < 0.6)
    rows = rows.filter(~churn & (F.col("significance") >= least))
    delta = F.coalesce(F.col("fault.duration_ms") - F.col("normal.duration_ms"), F.col("fault.ts_ms") - F.col("normal.ts_ms"), F.lit(0.0))
    return rows.select(
        pair, "order", "kind", F.coalesce("fault.channel", "normal.channel", F.lit("unknown")).alias("channel"), F.coalesce("fault.operation_id", "normal.operation_id").alias("operation_id"),
        delta.alias("delta_ms"), F.col("kind").isin(*PATH_KINDS).alias("path_changed"), "significance",
    )


def channel_regressions(rows: DataFrame, pair: str, least_ms: float = 0.0) -> DataFrame:
    """Per channel: the summed changes of at least least_ms, the number of divergences, errors and path changes."""
    c = rows.groupBy(pair, "channel").agg(
        F.sum(F.when(F.abs("delta_ms") >= least_ms, F.col("delta_ms")).otherwise(0.0)).alias("delta_ms"), F.count("*").alias("n"),
        F.bool_or(F.col("kind") == "error-introduced").alias("error_introduced"), F.bool_or("path_changed").alias("path_changed"),
    )
    return c.filter((F.col("delta_ms") != 0) | F.col("error_introduced") | F.col("path_changed"))


def regression_score(rows: DataFrame, pair: str, least_ms: float = 0.0) -> DataFrame:
    """(pair, severity, confidence, impact, total_delta_ms, channels): confidence by the share that changes the path, impact by mean weight and breadth.

    Pairs without divergences are absent: their score is 0.
    """
    channels = channel_regressions(rows, pair, least_ms).groupBy(pair).agg(F.count("*").alias("channels"), F.sum("delta_ms").alias("total_delta_ms"))
    c = rows.groupBy(pair).agg(F.greatest(F.lit(0.2), F.count_if(F.col("path_changed")) / F.count("*")).alias("confidence"), F.avg("significance").alias("mean"))
    c = c.join(channels, pair, "left").fillna(0, ["channels", "total_delta_ms"])
    impact = F.least(F.lit(1.0), F.col("mean") * (0.6 + 0.4 * F.least(F.lit(1.0), F.col("channels") / 3)))
    c = c.withColumn("impact", impact)
    return c.select(pair, F.least(F.lit(1.0), F.col("confidence") * F.col("impact")).alias("severity"), "confidence", "impact", "total_delta_ms", "channels")


def compare_runs(normal: DataFrame, fault: DataFrame, pair: str, band: int = BAND, ignore: tuple[str, ...] = (), least: float = LEAST, least_ms: float = 0.0) -> dict[str, DataFrame]:
    """The whole comparison: frames `pairs`, `summary`, `divergences`, `semantic`, `regression`, `report`."""
    from .signals import noise_regions

    a, b = normalise(normal, pair, ignore), normalise(fault, pair, ignore)
    pairs = saved(align(a, b, pair, band))
    points = saved(divergences(event_diffs(pairs, a, b, pair), pair, least))
    kept = semantic(points, pair, noise_regions(a, pair), noise_regions(b, pair), least)
    summary = alignment_summary(pairs, pair)
    return {"pairs": pairs, "summary": summary, "divergences": points, "semantic": kept, "regression": regression_score(kept, pair, least_ms), "report": run_report(summary, points, pair)}


def run_report(summary: DataFrame, points: DataFrame, pair: str) -> DataFrame:
    """(pair, report): the similarity and every divergence in words, in order."""
    line = F.format_string("%d. [%s, %.0f%% sure] %s (%s)", "order", "role", F.col("confidence") * 100, "description", "reason")
    lines = points.groupBy(pair).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    head = F.format_string("The runs are %.1f%% alike.", F.col("similarity") * 100)
    return summary.join(lines, pair, "left").select(pair, F.concat_ws("\n", head, F.coalesce("lines", F.lit("No divergence was found."))).alias("report"))


def exact(a: np.ndarray, b: np.ndarray, kind_a: np.ndarray, kind_b: np.ndarray) -> Iterator[tuple[int, int]]:
    """The alignment without a band, for tests and small inputs."""
    pa, pb, _ = aligned(a, b, kind_a, kind_b, -len(a), len(b))
    return zip(pa.tolist(), pb.tolist(), strict=True)
