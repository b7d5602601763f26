"""Memory series, collector logs, alert rules, snapshot history and live detectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIB = 1024 * 1024
def _slope(y: str, x: str) -> Column:
    return F.coalesce(F.expr(f"regr_slope({y}, {x})"), F.lit(0.0))


def growth(samples: DataFrame) -> DataFrame:
    """samples (series, ts_ms, rss, heap_used, external) -> MB/s of the last half of each series, and a flag.

    The slope is least squares; flagged over 1 MB/s of external or 2 MB/s of resident memory.
    """
    by = Window.partitionBy("series").orderBy("ts_ms")
    rows = samples.withColumn("i", F.row_number().over(by) - 1).withColumn("n", F.count("*").over(Window.partitionBy("series")))
    half = rows.filter(F.col("i") >= F.floor(F.col("n") / 2))
    rate = lambda c: F.round(_slope(c, "ts_ms") * 1000 / MIB, 6)
    out = half.groupBy("series").agg(rate("external").alias("external_mb_s"), rate("heap_used").alias("heap_mb_s"), rate("rss").alias("rss_mb_s"))
    return out.withColumn("flagged", (F.col("external_mb_s") > 1) | (F.col("rss_mb_s") > 2))


def _collector_fields(line: Column) -> Column:
    """A collector's line as an array of one struct, null where the line is none.

    Before `ms:` stands the time; after it come words: the kind, the heap and its committed size in
    brackets, an arrow, both again, `MB,`, and two pauses with a slash between. The line and its words are
    variables of functions over arrays, so that each is worked out once a line, not once for each use.
    """
    plain = F.regexp_replace(F.replace(F.replace(line, F.lit("->"), F.lit(" -> ")), F.lit("/"), F.lit(" / ")), r"\s+", " ")
    number = lambda x: F.translate(x, "ms", "").try_cast("double")
    bracketed = lambda x: x.startswith("(") & x.endswith(")")

    def fields(plain: Column, words: Column) -> Column:
        word = lambda k: F.get(words, F.lit(k))
        found = F.struct(
            F.regexp_extract(F.rtrim(F.substring_index(plain, "ms:", 1)), r"\d+$", 0).try_cast("long").alias("ts_ms"), word(0).alias("type"), number(word(1)).alias("before_mb"), number(word(4)).alias("after_mb"),
            (number(word(7)) + number(word(9))).alias("pause_ms"),
        )
        form = (plain.contains("ms:")) & (word(3) == "->") & (word(6) == "MB,") & (word(8) == "/") & bracketed(word(2)) & bracketed(word(5))
        return F.when(form, found)

    split = lambda plain: F.split(F.ltrim(F.substring_index(plain, "ms:", -1)), " ")
    return F.flatten(F.transform(F.array(plain), lambda p: F.transform(F.array(split(p)), lambda words: fields(p, words))))


def gc_entries(lines: DataFrame) -> DataFrame:
    """lines (seq, line) -> collector runs; lines of another form are left out."""
    rows = lines.select("seq", F.inline(_collector_fields(F.col("line")))).dropna()
    bytes_of = lambda c: F.floor(F.col(c) * MIB)
    return rows.select(
        "seq", "ts_ms", "type", bytes_of("before_mb").alias("heap_before"), bytes_of("after_mb").alias("heap_after"), "pause_ms",
        F.when(F.lower("type").contains("scavenge"), "minor").otherwise("major").alias("pause_type"),
    )


def gc_summary(entries: DataFrame) -> DataFrame:
    """One row: runs and pauses by class, growth from the first run's start to the last one's end, and a flag over 50 MB."""
    major = F.col("pause_type") == "major"
    out = entries.agg(
        F.count("*").alias("runs"), F.count_if(major).alias("major"), F.count_if(~major).alias("minor"), F.round(F.sum("pause_ms"), 6).alias("pause_ms"),
        F.round(F.coalesce(F.avg(F.when(major, F.col("pause_ms"))), F.lit(0.0)), 6).alias("avg_major_ms"),
        F.round(F.coalesce(F.avg(F.when(~major, F.col("pause_ms"))), F.lit(0.0)), 6).alias("avg_minor_ms"),
        F.round((F.max_by("heap_after", "seq") - F.min_by("heap_before", "seq")) / MIB, 6).alias("growth_mb"),
    )
    return out.withColumn("unmanaged", F.col("growth_mb") > 50)


def metrics(samples: DataFrame, rates: DataFrame) -> DataFrame:
    """(series, metric, value): state of the last sample, slopes of the last 20, and the given error and event rates."""
    back = Window.partitionBy("series").orderBy(F.desc("ts_ms"))
    rows = samples.withColumn("r", F.row_number().over(back)).filter("r <= 20")
    m = rows.groupBy("series").agg(
        F.max(F.when(F.col("r") == 1, F.when(F.col("heap_total") > 0, F.col("heap_used") / F.col("heap_total") * 100).otherwise(0.0))).alias("heapUsedPercent"),
        F.max(F.when(F.col("r") == 1, F.col("external") / MIB)).alias("externalMemory"),
        (_slope("heap_used", "ts_ms") * 1000 / MIB).alias("heapGrowthRate"),
        (_slope("rss", "ts_ms") * 1000 / MIB).alias("rssGrowthRate"),
    )
    m = m.join(rates.select("series", F.col("error_rate").cast("double").alias("errorRate"), F.col("event_rate").cast("double").alias("eventRate")), "series", "left").na.fill(0.0)
    names = ["heapUsedPercent", "externalMemory", "heapGrowthRate", "rssGrowthRate", "errorRate", "eventRate"]
    return m.unpivot("series", names, "metric", "value").withColumn("value", F.round("value", 6))


def fired(rules: DataFrame, values: DataFrame) -> DataFrame:
    """Enabled rules (id, metric, operator, threshold, level, enabled) that a metric value meets, with a message."""
    x, t = F.col("value"), F.col("threshold")
    meets = F.when(F.col("operator") == "greaterThan", x > t).when(F.col("operator") == "greaterThanOrEqual", x >= t).when(F.col("operator") == "lessThan", x < t).when(F.col("operator") == "lessThanOrEqual", x <= t).otherwise(False)
    # Labels, decimals and units of the metrics, and signs of the operators.
    label = F.create_map(*(F.lit(v) for p in (("heapUsedPercent", "Heap Used %"), ("externalMemory", "External Memory"), ("heapGrowthRate", "Heap Growth Rate"), ("rssGrowthRate", "RSS Growth Rate"), ("errorRate", "Error Rate"), ("eventRate", "Event Rate")) for v in p))
    sign = F.create_map(*(F.lit(v) for p in (("greaterThan", ">"), ("greaterThanOrEqual", ">="), ("lessThan", "<"), ("lessThanOrEqual", "<=")) for v in p))

    def shown(v: Column) -> Column:
        m = F.col("metric")
        return F.when(m.isin("heapUsedPercent", "errorRate"), F.format_string("%.1f%%", F.round(v, 1))).when(m == "externalMemory", F.format_string("%.1f MB", F.round(v, 1))).when(m == "eventRate", F.format_string("%.0f evt/s", v)).otherwise(F.format_string("%.2f MB/s", F.round(v, 2)))

    rows = values.join(rules.filter("enabled"), "metric").filter(meets)
    message = F.concat(label[F.col("metric")], F.lit(" "), sign[F.col("operator")], F.lit(" "), shown(t), F.lit(". Current: "), shown(x))
    return rows.select("series", "id", "metric", "value", "threshold", "level", message.alias("message"))


def inferred_runs(samples: DataFrame) -> DataFrame:
    """(series, ts_ms, reclaimed_mb): samples whose heap fell by more than 1 MiB."""
    by = Window.partitionBy("series").orderBy("ts_ms")
    drop = F.lag("heap_used").over(by) - F.col("heap_used")
    return samples.withColumn("drop", drop).filter(F.col("drop") > MIB).select("series", "ts_ms", (F.col("drop") / MIB).alias("reclaimed_mb"))


def _streak(rows: DataFrame, breach: Column) -> DataFrame:
    """rows with `streak`: how many breaches in a row end here (0 where there is none)."""
    by = Window.partitionBy("series").orderBy("ts_ms")
    rows = rows.withColumn("_b", breach).withColumn("_island", F.sum(F.when(F.col("_b"), 0).otherwise(1)).over(by))
    inside = Window.partitionBy("series", "_island").orderBy("ts_ms")
    return rows.withColumn("streak", F.sum(F.when(F.col("_b"), 1).otherwise(0)).over(inside)).drop("_b", "_island")


def gc_pressure(runs: DataFrame, window_ms: int = 10_000, most_mb: float = 64.0, every: int = 5) -> DataFrame:
    """Runs at which more than most_mb were reclaimed within the window, each `every`-th time in a row."""
    span = Window.partitionBy("series").orderBy(F.col("ts_ms").cast("long")).rangeBetween(-(window_ms - 1), 0)
    rows = _streak(runs.withColumn("churn_mb", F.round(F.sum("reclaimed_mb").over(span), 6)), F.col("churn_mb") > most_mb)
    return rows.filter((F.col("streak") > 0) & (F.col("streak") % every == 0)).select("series", "ts_ms", "churn_mb", "streak")


def leak_trend(samples: DataFrame, rate_bps: float = 2 * MIB, size: int = 20, sustained: int = 3, percent: float = 90.0) -> DataFrame:
    """Alerts where, a multiple of `sustained` times in a row, the slope of the last `size` samples or the share of the heap in use has been too high.

    A slope over the rate is critical; a heap over the percentage alone a warning. heap_total is the limit, where given.
    """
    frame = Window.partitionBy("series").orderBy("ts_ms").rowsBetween(-(size - 1), 0)
    rows = samples.withColumn("rate", F.greatest(F.coalesce(F.regr_slope("heap_used", F.col("ts_ms") / 1000).over(frame), F.lit(0.0)), F.lit(0.0)))
    used = F.when(F.col("heap_total") > 0, F.col("heap_used") / F.col("heap_total") * 100) if "heap_total" in samples.columns else F.lit(0.0)
    rows = rows.withColumn("used", F.coalesce(used, F.lit(0.0)))
    rows = _streak(rows, (F.col("rate") > rate_bps) | (F.col("used") > percent)).filter((F.col("streak") >= sustained) & (F.col("streak") % sustained == 0))
    fast = F.col("rate") > rate_bps
    return rows.select(
        "series", "ts_ms", F.when(fast, "critical").otherwise("warning").alias("level"), F.when(fast, "heapGrowthRate").otherwise("heapUsedPercent").alias("metric"),
        F.round(F.when(fast, F.col("rate") / MIB).otherwise(F.col("used")), 6).alias("value"), "streak",
    )


def leak_pattern(history: DataFrame) -> DataFrame:
    """history (series, ts_ms, delta) -> pattern of the last records: growing if the last three all grew."""
    back = Window.partitionBy("series").orderBy(F.desc("ts_ms"))
    last = history.withColumn("r", F.row_number().over(back)).filter("r <= 3")
    p = last.groupBy("series").agg(F.count("*").alias("n"), F.bool_and(F.col("delta") > 0).alias("up"), F.max(F.when(F.col("r") == 1, F.col("delta"))).alias("last"))
    growing = (F.col("n") >= 3) & F.col("up")
    pattern = F.when(growing, "growing").when(F.col("last") < 0, "shrinking").otherwise("stable")
    return p.select("series", pattern.alias("pattern"), growing.alias("flagged"))


def history_summary(history: DataFrame) -> DataFrame:
    """history (growth_rate, flagged) -> records, mean growth with unknown ones as 0, flagged records."""
    return history.agg(F.count("*").alias("records"), F.round(F.avg(F.coalesce("growth_rate", F.lit(0.0))), 6).alias("avg_growth"), F.count_if("flagged").alias("flagged"))
