"""Just-in-time compiler logs: lines to events, call sites, functions, the graph of hidden classes, findings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import cache_state, clamp, severity

#: How the engine's statements begin, and what each is called here.
STATEMENTS = {"[marking ": "marking", "[disabled optimization for ": "disabled", "[compiling method ": "compiling", "[optimizing ": "optimized", "[reoptimizing ": "reoptimize"}
#: Endings of a cache's name, and words for its state; two of them mean megamorphic.
CACHES = ("IC", "BCH", "MEG")
STATES = ("uninitialized", "monomorphic", "polymorphic", "megamorphic", "slow", "generic")
#: Thresholds of the findings.
MAPS, STORM, STORM_WINDOW, FRAGMENTS = 4, 3, 40, 3


#: The fields of a record, in the order of parse(); a class fills those it has.
FIELDS = {
    "class": "string", "kind": "string", "site": "string", "offset": "int", "key": "string", "state": "string", "maps": "array<string>", "address": "string",
    "target": "string", "name": "string", "reason": "string", "took_ms": "double", "begins": "boolean",
}


def _record(**known: Column) -> Column:
    return F.struct(*(known.get(k, F.lit(None)).cast(t).alias(k) for k, t in FIELDS.items()))


# The helpers below name their text once each: nested, an expression stays linear in its depth.
def _after(text: Column, mark: str) -> Column:
    """What follows the first mark in text, null where it does not occur."""
    return F.get(F.split(text, re.escape(mark), 2), F.lit(1))


def _kept(text: Column, test) -> Column:
    """text where test holds, else null."""
    return F.get(F.filter(F.array(text), test), F.lit(0))


def _until(text: Column, *marks: str) -> Column:
    """The text before the first of the marks; null where nothing stands there."""
    for mark in marks:
        text = F.substring_index(text, mark, 1)
    return _kept(F.trim(text), lambda w: w != "")


def _address(text: Column) -> Column:
    """The first word of text if it is an address, else null."""
    return _kept(F.substring_index(text, " ", 1), lambda w: w.rlike("^0x[0-9a-f]+$"))


def _caches(rows: DataFrame) -> DataFrame:
    """rows with _ic: fields of an inline cache's line, null without a cache's name.

    The name is the first word of letters with one of the known endings; the address in brackets right after
    it is the cache's own and no map.
    """
    line = F.col("line")
    named = lambda w: w.rlike("^[A-Za-z]+$") & F.exists(F.array(*map(F.lit, CACHES)), lambda e: w.endswith(e) & (F.length(w) > F.length(e)))
    rows = rows.withColumn("_words", F.split(line, r"\W+")).withColumn("_name", F.get(F.filter("_words", named), F.lit(0)))
    lead = F.replace(F.translate(F.substring_index(line, "(0x", 1), "[] 0123456789", ""), F.lit("inoptimizedcode"), F.lit(""))
    rest = F.when(line.contains("(0x") & (lead == F.col("_name")), _after(line, ")")).otherwise(line)
    here = F.col("_name").isNotNull()
    rows = rows.withColumn("_maps", F.when(here, F.array_distinct(F.regexp_extract_all(rest, F.lit(r"0[xX]\p{XDigit}+"), 0))))
    rows = rows.withColumn("_said", F.when(here, F.get(F.filter(F.transform("_words", F.lower), lambda w: w.isin(*STATES)), F.lit(0))))
    state = F.when(F.col("_said").isin("slow", "generic"), "megamorphic").otherwise(F.coalesce("_said", cache_state(F.size("_maps"))))
    offset = F.regexp_extract(_after(line, "offset "), r"^\d+", 0).try_cast("int")
    fields = _record(**{"class": F.lit("ic")}, kind=F.col("_name"), site=_until(_after(line, " at "), " "), offset=offset, key=_until(_after(line, "[key:"), "]"), state=state, maps=F.col("_maps"))
    return rows.withColumn("_ic", F.when(here, fields)).drop("_name", "_maps", "_said")


def _optimizations(rows: DataFrame) -> DataFrame:
    """rows with _opt: fields of a statement about a function's optimisation; detail is its reason, compiler or time."""
    line, kind, tail, detail = F.col("line"), F.col("_kind"), F.col("_tail"), F.col("_detail")
    rows = rows.withColumn("_kind", F.coalesce(*(F.when(line.startswith(k), v) for k, v in STATEMENTS.items())))
    rows = rows.withColumn("_rest", F.coalesce(*(F.when(kind == v, _after(line, k)) for k, v in STATEMENTS.items())))
    rows = rows.withColumn("_tail", _after(F.col("_rest"), ">"))
    told = (
        F.when(kind.isin("marking", "disabled") & tail.contains("reason:"), _until(F.substring_index(tail, "reason:", -1), ",", "]"))
        .when((kind == "compiling") & tail.startswith(" using "), _until(_after(tail, " using "), "]")).when(kind == "optimized", _until(_after(tail, "- took "), " ms]"))
    )
    rows = rows.withColumn("_detail", told)
    whole = F.when(kind == "reoptimize", tail.isNotNull()).when(kind == "optimized", F.ltrim(tail).startswith("]") | detail.try_cast("double").isNotNull()).when(kind == "compiling", detail.rlike("^[A-Za-z]+$")).otherwise(detail.isNotNull())
    named = F.when((kind == "compiling") & F.array_contains("_words", "OSR"), "osr").otherwise(kind)
    name, took = _until(_after(F.col("_rest"), "<SharedFunctionInfo "), ">"), F.when(kind == "optimized", detail.try_cast("double"))
    fields = _record(**{"class": F.lit("opt")}, kind=named, address=_address(F.col("_rest")), name=name, reason=detail, took_ms=took)
    here = whole & F.col("_rest").contains("<SharedFunctionInfo ") & _address(F.col("_rest")).isNotNull()
    return rows.withColumn("_opt", F.when(here, fields)).drop("_kind", "_rest", "_tail", "_detail")


def _deoptimizations(rows: DataFrame) -> DataFrame:
    """rows with _deopt: fields of the beginning or end of a deoptimisation."""
    begins, told, tail = F.col("_begins"), F.col("_told"), F.col("_tail")
    rows = rows.withColumn("_rest", _after(F.col("line"), "[deoptimizing (DEOPT ")).withColumn("_begins", F.col("_rest").contains("): begin "))
    rows = rows.withColumn("_told", F.when(begins, _after(F.col("_rest"), "): begin ")).otherwise(_after(F.col("_rest"), "): end "))).withColumn("_tail", F.ltrim(_after(told, ">")))
    whole = tail.isNotNull() & (~begins | tail.startswith("]") | (tail.startswith("at ") & tail.contains("]"))) & F.col("line").startswith("[") & _address(told).isNotNull()
    site = F.when(begins & tail.startswith("at "), _until(_after(tail, "at "), "]"))
    fields = _record(**{"class": F.lit("deopt")}, kind=_until(F.col("_rest"), ")"), address=_address(told), name=_until(_after(told, "<"), ">"), site=site, begins=begins)
    return rows.withColumn("_deopt", F.when(whole, fields)).drop("_rest", "_begins", "_told", "_tail")


def _transitions(rows: DataFrame) -> DataFrame:
    """rows with _map: fields of a step from one hidden class to another."""
    told, tail, rest = F.col("_told"), F.col("_tail"), F.col("_rest")
    rows = rows.withColumn("_told", F.when(F.col("line").startswith("Map"), _after(F.col("line"), "transition from "))).withColumn("_tail", _after(told, " to "))
    rows = rows.withColumn("_rest", _after(tail, " ")).withColumn("_key", F.when(rest.startswith('for "'), _until(_after(rest, 'for "'), '"')))
    rows = rows.withColumn("_rest", F.when(F.col("_key").isNotNull(), F.ltrim(F.substring_index(rest, '"', -1))).otherwise(rest))
    site = F.when(rest.startswith("at "), _until(_after(rest, "at "), " "))
    fields = _record(**{"class": F.lit("map")}, kind=F.lit("transition"), address=_address(told), target=_address(tail), key=F.col("_key"), site=site)
    return rows.withColumn("_map", F.when(_address(told).isNotNull() & _address(tail).isNotNull(), fields)).drop("_told", "_tail", "_rest", "_key")


def parse(lines: DataFrame) -> DataFrame:
    """lines (series, seq, line) -> a row per line of a known form: its class, and the fields of that class.

    A line is of the first class that fits: bailout, ic, opt, deopt, map. A deoptimisation's reason is
    that of the last bailout since one ended; a beginning without takes that of the next bailout before
    another begins. Each line is read once, by brackets and keywords; reasons pass along two sorted runs
    of a log, forward and backward, so time is linear in its lines.
    """
    rows = lines.select("series", "seq", F.trim(F.regexp_replace("line", r"\s+", " ")).alias("line")).filter("line <> ''")
    rows = rows.withColumn("_told", F.when(F.col("line").startswith("[bailout (kind: deopt-") & F.col("line").contains(")]"), _after(F.col("line"), "(kind: deopt-")))
    bailout = _record(**{"class": F.lit("bailout")}, kind=_until(F.col("_told"), ","), reason=_until(_after(F.col("_told"), "reason: "), ")", "]"))
    rows = rows.withColumn("_bail", F.when(F.col("_told").contains("reason: "), bailout)).drop("_told")
    rows = _transitions(_deoptimizations(_optimizations(_caches(rows))))
    # inline() drops lines of no class and keeps the optimizer from writing the fields out once for each that is read later.
    first = F.coalesce("_bail", "_ic", "_opt", "_deopt", "_map")
    rows = _with_reasons(rows.select("series", "seq", "line", F.inline(F.array_compact(F.array(first)))))
    compiler = F.when(F.col("class") == "opt", _kept(F.col("reason"), lambda w: w.rlike("^[A-Za-z]+$")))
    rows = rows.withColumn("compiler", compiler).withColumn("reason", F.coalesce("reason", "_why")).withColumn("begins", F.coalesce("begins", F.lit(False)))
    return rows.select("series", "seq", *(c for c in FIELDS if c not in ("took_ms", "begins")), "compiler", "took_ms", "begins", F.col("line").alias("raw"))


def _with_reasons(rows: DataFrame) -> DataFrame:
    """rows with _why: the bailout that a deoptimisation's line belongs to. Both frames grow from the start of their order."""
    ends = ~F.col("begins")
    said = F.when(F.col("class") == "bailout", F.struct("seq", F.col("reason").alias("why")))
    back, ahead = (Window.partitionBy("series").orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in ("seq", F.desc("seq")))
    last, ended = F.last(said, True).over(back), F.last(F.when(ends, F.col("seq")), True).over(back)
    following, again = F.last(said, True).over(ahead), F.last(F.when(F.col("begins"), F.col("seq")), True).over(ahead)
    rows = rows.withColumn("_last", last).withColumn("_ended", ended).withColumn("_next", following).withColumn("_again", again)
    pending = F.when(F.col("_ended").isNull() | (F.col("_last.seq") > F.col("_ended")), F.col("_last.why"))
    later = F.when(F.col("begins") & (F.col("_again").isNull() | (F.col("_next.seq") < F.col("_again"))), F.col("_next.why"))
    return rows.withColumn("_why", F.when(F.col("class") == "deopt", F.coalesce(pending, later)))


def log_files(events: DataFrame) -> DataFrame:
    """(series, file): the source files that sites name."""
    file = F.split_part("site", F.lit(":"), F.lit(1))
    return events.filter("site IS NOT NULL").select("series", file.alias("file")).filter("file <> ''").distinct()


def site_key() -> Column:
    return F.concat("kind", F.lit("@"), F.coalesce("site", F.lit("<anonymous>")))


def sites(events: DataFrame) -> DataFrame:
    """Call sites by how often they were hit: hits, distinct maps and keys in order of appearance, state by the number of maps."""
    rows = events.filter("class = 'ic'").withColumn("id", site_key())
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("seq", F.col(c).alias("x")))), lambda e: e["x"])
    s = rows.groupBy("series", "id").agg(
        F.min_by("kind", "seq").alias("kind"), F.min_by("site", "seq").alias("site"), F.min_by("offset", "seq").alias("offset"), F.count("*").alias("hits"),
        F.array_distinct(F.flatten(ordered("maps"))).alias("maps"), F.array_distinct(F.array_compact(ordered("key"))).alias("keys"), F.min("seq").alias("first_seq"),
    )
    return s.withColumn("state", cache_state(F.size("maps")))


def functions(events: DataFrame, window: int = STORM_WINDOW) -> DataFrame:
    """Functions by address: optimisations, deoptimisations, their densest burst, how often one followed the other, status and reasons."""
    made = F.col("kind").isin("optimized", "osr", "reoptimize")
    opt = F.col("class") == "opt"
    rows = events.filter((F.col("class") == "opt") | F.col("begins")).withColumn("id", F.coalesce("address", "name", F.lit("unknown")))
    span = Window.partitionBy("series", "id").orderBy("seq").rangeBetween(-window, 0)
    rows = rows.withColumn("_burst", F.count(F.when(F.col("begins"), 1)).over(span)).withColumn("_place", F.struct(F.when(opt, 0).otherwise(1), "seq"))
    status = F.when(opt & F.coalesce(F.col("reason") == "NeverOptimize", F.lit(False)), "never").when(opt & made, "optimized").when(opt & (F.col("kind") == "disabled"), "disabled")
    said = F.when(F.col("begins") | (opt & F.col("kind").isin("marking", "disabled")), F.col("reason"))
    first_opt = F.min(F.when(opt & made, F.col("seq"))).over(Window.partitionBy("series", "id"))
    rows = rows.withColumn("_first", first_opt).withColumn("_status", status).withColumn("_said", said)
    told = F.array_sort(F.collect_list(F.when(F.col("_said").isNotNull(), F.struct("_place", F.col("_said").alias("x"), (F.col("kind") != "disabled").alias("once")))))
    reasons = F.aggregate(told, F.array().cast("array<string>"), lambda a, e: F.when(e["once"] & F.array_contains(a, e["x"]), a).otherwise(F.array_append(a, e["x"])))
    f = rows.groupBy("series", "id").agg(
        F.coalesce(F.min_by("name", "_place"), F.min_by("address", "_place"), F.lit("unknown")).alias("name"), F.count_if(opt & made).alias("opts"), F.count_if("begins").alias("deopts"),
        F.count_if(F.col("begins") & (F.col("seq") > F.col("_first"))).alias("_after"), F.max_by("compiler", F.when(opt & made & F.col("compiler").isNotNull(), F.col("seq"))).alias("compiler"),
        F.coalesce(F.max_by("_status", F.when(F.col("_status").isNotNull(), F.col("seq"))), F.lit("none")).alias("status"), reasons.alias("reasons"), F.max(F.when(F.col("begins"), F.col("_burst")).otherwise(0)).alias("burst"),
    )
    return f.withColumn("reopts", F.least("opts", "_after")).drop("_after")


def top_sites(found: DataFrame, most: int) -> DataFrame:
    return found.orderBy(F.desc("hits"), "series", "first_seq").limit(most)


def top_functions(found: DataFrame, most: int) -> DataFrame:
    return found.orderBy(F.desc(F.col("opts") + F.col("deopts")), "series", "id").limit(most)


def graph_edges(events: DataFrame, found: DataFrame) -> DataFrame:
    """(series, source, target, kind, property, weight): maps seen at sites, and transitions between maps."""
    seen = found.select("series", F.col("id").alias("source"), F.explode("maps").alias("target"), F.lit("observed").alias("kind"), F.lit(None).cast("string").alias("property"), F.lit(1).cast("long").alias("weight"))
    moved = events.filter("class = 'map'").groupBy("series", F.col("address").alias("source"), "target").agg(F.min_by("key", "seq").alias("property"), F.count("*").alias("weight"))
    return seen.unionByName(moved.withColumn("kind", F.lit("transition")))


def graph_nodes(events: DataFrame, found: DataFrame) -> DataFrame:
    """(series, id, type, count): sites with their hits; maps with how many cache events saw them."""
    hits = events.filter("class = 'ic'").select("series", F.explode("maps").alias("id"))
    ends = events.filter("class = 'map'").select("series", F.explode(F.array("address", "target")).alias("id"))
    maps = hits.withColumn("n", F.lit(1)).unionByName(ends.withColumn("n", F.lit(0))).groupBy("series", "id").agg(F.sum("n").alias("count"))
    return found.select("series", "id", F.lit("site").alias("type"), F.col("hits").alias("count")).unionByName(maps.select("series", "id", F.lit("map").alias("type"), "count"))


def findings(found: DataFrame, funcs: DataFrame, maps: int = MAPS, storm: int = STORM, fragments: int = FRAGMENTS) -> DataFrame:
    """(series, rule, target, score, severity): megamorphic sites, deoptimisation storms and loops, fragmented lines, suppressed functions."""
    n = F.size("maps")
    mega = found.filter(n > maps).select("series", F.lit("megamorphic-ic").alias("rule"), F.coalesce("site", "kind").alias("target"), clamp((n - maps) / 4).alias("score"))
    storms = funcs.filter((F.col("deopts") > 0) & (F.col("burst") >= storm)).select("series", F.lit("deopt-storm").alias("rule"), F.col("name").alias("target"), clamp(F.col("burst") / 10).alias("score"))
    loops = funcs.filter((F.col("deopts") > 0) & (F.col("reopts") >= 2)).select("series", F.lit("deopt-loop").alias("rule"), F.col("name").alias("target"), clamp(0.4 + F.col("reopts") * 0.05).alias("score"))
    line = F.array_join(F.slice(F.split(F.coalesce("site", F.lit("")), ":"), 1, 2), ":")
    lines = found.withColumn("line", line).filter("line <> ''").groupBy("series", "line").agg(F.size(F.array_distinct(F.flatten(F.collect_list("maps")))).alias("n")).filter(F.col("n") > fragments)
    broken = lines.select("series", F.lit("hidden-class-fragmentation").alias("rule"), F.col("line").alias("target"), clamp(F.col("n") / 8).alias("score"))
    stopped = funcs.filter(F.col("status").isin("never", "disabled")).select("series", F.lit("optimization-suppressed").alias("rule"), F.col("name").alias("target"), F.lit(0.8).alias("score"))
    rows = mega.unionByName(storms).unionByName(loops).unionByName(broken).unionByName(stopped)
    level = F.when(F.col("rule").isin("deopt-loop", "optimization-suppressed"), "warning").otherwise(severity(F.col("score")))
    return rows.withColumn("severity", level)


def in_sources(found: DataFrame, files: DataFrame, functions: DataFrame, block: int = 256) -> DataFrame:
    """findings (target, ...) with file, function and scope: the place in the sources that each is about.

    files (file_id, name), functions (file_id, name, start_line, end_line, seq). A target is a function's name
    or file:line:column. Of the files with the same last path part, cases aside, the first counts, else the
    first that has a function named like the target. In it a line means the largest function that holds it,
    of equal ones the first by seq; without a line the first function of that name. scope: function, file or none.

    Ranges are joined with lines by blocks of lines. Of those that hold a whole block one is kept, of equal
    ranges one too, and each line is looked up once, however many findings name it.
    """
    target, last = F.coalesce("target", F.lit("")), lambda c: F.lower(F.element_at(F.split(c, r"[/\\\\]"), -1))
    rest = F.regexp_extract(F.split_part(target, F.lit(":"), F.lit(2)), "^[0-9]+", 0)
    path = F.split_part(target, F.lit(":"), F.lit(1))
    rows = found.withColumn("_target", target).withColumn("_base", F.when(path != "", last(path))).withColumn("_line", F.when((path != "") & (rest != ""), rest.cast("long")))
    bases = files.groupBy(last(F.col("name")).alias("_base")).agg(F.min("file_id").alias("_by_base"))
    named = functions.groupBy(F.col("name").alias("_target")).agg(F.min("file_id").alias("_by_name"))
    rows = rows.join(bases, "_base", "left").join(named, "_target", "left").withColumn("file_id", F.coalesce("_by_base", "_by_name")).drop("_by_base", "_by_name", "_base")

    best = F.max(F.struct((F.col("end_line") - F.col("start_line")).alias("size"), (-F.col("seq")).alias("late"), F.col("name").alias("function"))).alias("best")
    spread = functions.filter("start_line <= end_line").withColumn("_block", F.explode(F.expr(f"sequence(start_line div {block}, end_line div {block})")))
    full = (F.col("start_line") <= F.col("_block") * block) & (F.col("end_line") >= F.col("_block") * block + block - 1)
    whole = spread.filter(full).groupBy("file_id", "_block").agg(best)
    part = spread.filter(~full).groupBy("file_id", "_block", "start_line", "end_line").agg(best)
    lines = rows.select("file_id", "_line").dropna().distinct().withColumn("_block", F.expr(f"_line div {block}"))
    inside = lines.join(part, ["file_id", "_block"]).filter("_line BETWEEN start_line AND end_line").select("file_id", "_line", "best")
    at_line = inside.unionByName(lines.join(whole, ["file_id", "_block"]).select("file_id", "_line", "best")).groupBy("file_id", "_line").agg(F.max("best").alias("_best"))
    at_name = functions.groupBy("file_id", F.col("name").alias("_target")).agg(F.min_by("name", "seq").alias("_named"))

    rows = rows.join(at_line, ["file_id", "_line"], "left").join(at_name, ["file_id", "_target"], "left")
    # A function without a name is a place all the same.
    held = F.when(F.col("_line").isNotNull(), F.col("_best").isNotNull()).otherwise(F.col("_named").isNotNull())
    name = F.when(F.col("_line").isNotNull(), F.col("_best.function")).otherwise(F.col("_named"))
    rows = rows.withColumn("function", name).withColumn("scope", F.when(F.col("file_id").isNull(), "none").when(held, "function").otherwise("file"))
    places = files.select("file_id", F.col("name").alias("file"))
    return rows.join(places, "file_id", "left").select(*found.columns, "file", "function", "scope")


def health(rows: DataFrame, weight: float = 0.12) -> DataFrame:
    """(series, health): 1 less a share of all findings' scores."""
    return rows.groupBy("series").agg(F.round(clamp(1 - F.sum("score") * weight), 9).alias("health"))
