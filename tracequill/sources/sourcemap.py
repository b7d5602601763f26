"""Source maps: the packed mappings as rows, and the way from compiled positions to source ones and back."""

from __future__ import annotations

import itertools
import json
import string
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.asof import as_of

#: Mappings of a section of a map that is written, and rows of a batch of mappings that are read.
SECTION, BATCH = 100_000, 100_000
MAPPING = "map_id string, gen_line int, gen_col int, source string, line int, col int, name string"
_ALPHABET = string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/"
_DIGIT = [_ALPHABET.find(chr(k)) for k in range(256)]


def _fields(segment: str) -> list[int]:
    """The signed numbers of a segment: six bits a letter, low ones first, the sixth says that more follow."""
    out, value, shift = [], 0, 0
    for letter in segment.encode("latin-1"):
        digit = _DIGIT[letter]
        if digit < 0:
            raise ValueError(f"no base 64 letter in {segment!r}")
        value |= (digit & 31) << shift
        if digit & 32:
            shift += 5
        else:
            out.append(-(value >> 1) if value & 1 else value >> 1)
            value, shift = 0, 0
    return out


def _parted(text: str, mark: str) -> Iterator[str]:
    """text.split(mark), a part at a time."""
    start = 0
    while (end := text.find(mark, start)) >= 0:
        yield text[start:end]
        start = end + 1
    yield text[start:]


def _rows(map_id: str, mappings: str, sources: list[str], names: list[str], first_line: int = 0, first_column: int = 0) -> Iterator[tuple]:
    """The rows of a map, or of a section that begins at first_line and, in that line, at first_column."""
    at = [0, 0, 0, 0]  # source, line, column and name go on from segment to segment; the generated column starts anew each line
    for number, line in enumerate(_parted(mappings, ";"), 1):
        column = first_column if number == 1 else 0
        for segment in filter(None, _parted(line, ",")):
            step = _fields(segment)
            column += step[0]
            if len(step) < 4:
                continue
            at = [a + b for a, b in zip(at, step[1:] + [0] * (5 - len(step)), strict=True)]
            yield map_id, first_line + number, column, sources[at[0]] if at[0] < len(sources) else "", at[1] + 1, at[2], names[at[3]] if len(step) == 5 and at[3] < len(names) else None


def mappings(maps: DataFrame) -> DataFrame:
    """maps (map_id, json) -> MAPPING rows, lines from 1 and columns from 0. Sources get the map's root in front.

    A map may be cut into sections, each with the place where it begins, in one document or in several of the
    same map_id; sections are read by many tasks.
    """
    one = "version int, mappings string, sourceRoot string, sources array<string>, names array<string>"
    # Texts of JSON may be as long as a string can be; by default longer ones than the parser's limit make the document null.
    doc = maps.select("map_id", F.from_json("json", f"{one}, sections array<struct<offset struct<line int, column int>, map struct<{one}>>>", {"maxStringLen": str(2**31 - 1)}).alias("d"))
    plain = F.struct(F.struct(F.lit(0).alias("line"), F.lit(0).alias("column")).alias("offset"), F.struct(*(F.col(f"d.{c}").alias(c) for c in ("version", "mappings", "sourceRoot", "sources", "names"))).alias("map"))
    doc = doc.select("map_id", F.explode(F.coalesce("d.sections", F.array(plain))).alias("s")).select("map_id", F.coalesce("s.offset.line", F.lit(0)).alias("first_line"), F.coalesce("s.offset.column", F.lit(0)).alias("first_column"), F.col("s.map").alias("m"))
    doc = doc.filter("m.mappings IS NOT NULL").select("map_id", "first_line", "first_column", "m.mappings", "m.sources", F.coalesce("m.sourceRoot", F.lit("")).alias("root"), F.coalesce("m.names", F.array().cast("array<string>")).alias("names"))
    root = F.when((F.col("root") == "") | F.col("root").endswith("/"), F.col("root")).otherwise(F.concat("root", F.lit("/")))
    doc = doc.withColumn("sources", F.transform(F.coalesce("sources", F.array().cast("array<string>")), lambda s: F.concat(root, s)))
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string()]

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                m = batch.slice(k, 1).to_pylist()[0]
                rows = _rows(m["map_id"], m["mappings"], m["sources"], m["names"], m["first_line"], m["first_column"])
                while some := list(itertools.islice(rows, BATCH)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), kinds, strict=True)], names=[f.split()[0] for f in MAPPING.split(", ")])

    return doc.select("map_id", "mappings", "sources", "names", "first_line", "first_column").mapInArrow(run, MAPPING)


def resolve(frames: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """frames (key..., map_id, line, col) -> with the source position of the last mapping at or before the column of the line.

    An as-of join, linear in frames and mappings: a bundle of one line costs no more than many lines.
    """
    m = rows.select("map_id", F.col("gen_line").alias("line"), F.col("gen_col").alias("col"), "source", F.col("line").alias("_line"), F.col("col").alias("_col"), "name")
    found = as_of(frames, m, ["map_id", "line"], "col", ["source", "_line", "_col", "name"], "_o")
    original = F.when(F.col("_o").isNotNull(), F.struct(F.col("_o.source").alias("source"), F.col("_o._line").alias("line"), F.col("_o._col").alias("col"), F.col("_o.name").alias("name")))
    return found.select(*frames.columns, original.alias("original"))


def _letters(number: int) -> str:
    """A signed number as base 64 letters of six bits each."""
    value, out = (-number << 1) | 1 if number < 0 else number << 1, []
    while True:
        value, digit = value >> 5, value & 31
        out.append(_ALPHABET[digit | (32 if value else 0)])
        if not value:
            return "".join(out)


def _packed(frame: pd.DataFrame, first_line: int = 0, first_column: int = 0) -> dict:
    """A map of ordered MAPPING rows, whose places are given from first_line and first_column on."""
    sources, names = ({v: k for k, v in enumerate(dict.fromkeys(x for x in frame[c] if x is not None))} for c in ("source", "name"))
    lines, column, at = [[]], first_column, [0, 0, 0, 0]
    for gen_line, gen_col, source, line, col, name in zip(*(frame[c].tolist() for c in ("gen_line", "gen_col", "source", "line", "col", "name")), strict=True):
        while len(lines) < gen_line - first_line:
            lines.append([])
            column = 0
        place = [sources[source], line - 1, col, at[3] if name is None else names[name]]
        steps = [gen_col - column, *(b - a for a, b in zip(at, place, strict=True))]
        lines[-1].append("".join(map(_letters, steps[: 4 if name is None else 5])))
        column, at = gen_col, place
    return {"version": 3, "sources": list(sources), "names": list(names), "mappings": ";".join(",".join(x) for x in lines)}


def pack(rows: DataFrame, section: int = SECTION) -> DataFrame:
    """MAPPING rows -> maps (map_id, json): what mappings() reads.

    A map of up to `section` mappings is one document. A larger one is cut by line and column into several
    documents of the same map_id, each a map with one section that says where it begins, made by many tasks.
    """
    sizes = rows.groupBy("map_id").agg(F.count("*").alias("_n"))
    large = sizes.filter(F.col("_n") > section).select("map_id")
    small = rows.join(large, "map_id", "left_anti")

    def whole(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["gen_line", "gen_col"], kind="stable")
        return pd.DataFrame({"map_id": [frame["map_id"].iloc[0]], "json": [json.dumps(_packed(frame))]})

    def sections(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def document() -> pd.DataFrame:
            frame = pd.concat(held)
            first = frame.iloc[0]
            line, column = int(first["gen_line"]) - 1, int(first["gen_col"])
            text = {"version": 3, "sections": [{"offset": {"line": line, "column": column}, "map": _packed(frame, line, column)}]}
            return pd.DataFrame({"map_id": [first["map_id"]], "json": [json.dumps(text)]})

        for batch in frames:
            for map_id, frame in batch.groupby("map_id", sort=False):
                for part in (frame.iloc[k : k + section] for k in range(0, len(frame), section)):
                    if held and (held[0]["map_id"].iloc[0] != map_id or sum(map(len, held)) + len(part) > section):
                        yield document()
                        held = []
                    held.append(part)
        if held:
            yield document()

    count = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cut = rows.join(large, "map_id", "left_semi").repartitionByRange(count, "map_id", "gen_line", "gen_col").sortWithinPartitions("map_id", "gen_line", "gen_col")
    return small.groupBy("map_id").applyInPandas(whole, "map_id string, json string").unionByName(cut.mapInPandas(sections, "map_id string, json string"))


def generated_lines(rows: DataFrame, source: str, line: int) -> DataFrame:
    """(map_id, gen_line) of the compiled lines that come from a line of a source."""
    return rows.filter((F.col("source") == source) & (F.col("line") == line)).select("map_id", "gen_line").distinct()


def covered(positions: DataFrame, rows: DataFrame) -> DataFrame:
    """positions (map_id, gen_line) that have a mapping."""
    return positions.join(rows.select("map_id", "gen_line").distinct(), ["map_id", "gen_line"], "left_semi")


def is_runtime(file: Column) -> Column:
    """Whether a frame's file is the runtime's own."""
    inner = file.startswith("internal/") | file.startswith("node:internal/") | file.isin("[eval]", "<anonymous>")
    return F.when(F.coalesce(file, F.lit("")) == "", True).otherwise(inner | (~file.contains("node_modules/") & file.contains("node:")))


def is_native(file: Column, function: Column) -> Column:
    """Whether a frame is compiled code of the runtime."""
    name = F.coalesce(function, F.lit(""))
    return file.contains("native") | name.contains("*") | name.contains("::")
