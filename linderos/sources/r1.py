"""The previous registry list ("R1"): a CSV whose first '*predial*' column counts.

A quoted field may hold line breaks, so a line need not be a record, and a byte range of a file may begin inside a
field.  The file is still read in ranges, one task each:

1. At a line break the reader is either outside a field or inside a quoted one.  What a line, and a range of lines, does
   to that state is a map of two states; each range yields its own.
2. The maps are composed along the ranges of a file by a prefix scan: that tells the state in which each range begins.
3. Each range is then parsed from its state.  What belongs to a record that crosses ranges comes back as a piece, and
   the pieces of a record, a handful, are put together and parsed last.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

R1_VIEW = "_r1_predios"

# Characters a registry number is stripped of at both ends (all whitespace, not only spaces).
_WHITESPACE = "".join(chr(c) for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))


class R1Error(ValueError):
    """The registry list cannot be read."""


@dataclass(frozen=True)
class R1List:
    """Distinct registry numbers and the non-blank rows they came from."""

    numbers: DataFrame
    rows: DataFrame

    def counts(self) -> tuple[int, int]:
        """Non-blank rows with repeated numbers included, and distinct numbers."""
        row = self.rows.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("numero_predial").alias("numbers")).head()
        return row["rows"], row["numbers"]


def _number_column(columns: list[str]) -> int:
    """Place of the first column naming 'predial'."""
    for at, name in enumerate(columns):
        if "predial" in name.lower():
            return at
    raise R1Error(f"no column named like 'predial'; columns found: {columns}")


def _listed(raw: DataFrame, number: Column) -> R1List:
    rows = raw.select(F.trim(number.cast("string"), F.lit(_WHITESPACE)).alias("numero_predial")).filter("numero_predial <> ''")
    return R1List(numbers=rows.distinct(), rows=rows)


def registry_numbers(raw: DataFrame) -> R1List:
    """Numbers of a frame: first column naming 'predial', stripped, blanks dropped, distinct."""
    quoted = raw.columns[_number_column(raw.columns)].replace("`", "``")
    return _listed(raw, F.col(f"`{quoted}`"))


def read_r1_csv(spark: SparkSession, path: str, **options) -> R1List:
    """UTF-8 CSV with a header (byte-order mark allowed) from any Spark-readable path; a folder's files have one each.

    Fields may be quoted, with quotes doubled inside and line breaks (read as \\n).  Files are cut into ranges of
    `spark.sql.files.maxPartitionBytes`.  With options of Spark's CSV reader the file is left to that reader.
    """
    reader = spark.read.option("header", True).option("encoding", "UTF-8").option("escape", '"').option("multiLine", True)
    try:
        raw = reader.options(**options).csv(path)
        if options:
            return registry_numbers(raw)
        at = _number_column(raw.columns)
        return _listed(csv_column(spark, path, at), F.col("field"))
    except AnalysisException as problem:
        raise R1Error(f"registry list not readable: {path}") from problem


# ------------------------------------------------------------------ ranges of a file

# After a line: still inside a quoted field (1) or not (0), by the state before it.
_RANGE = "file string, begin long, from_outside int, from_inside int"
# A parsed field; or a piece of a record that crosses ranges: `opens` where the record begins in this range.
_PARSED = "field string, file string, begin long, opens boolean, header boolean, piece string"


def _state_after() -> Callable[[str, bool], bool]:
    """Whether a line that begins inside a quoted field (or not) ends inside one.

    A quote opens a field only as its first character; inside, a doubled quote is one character.  Made here so that
    workers get the code and need no package of ours.
    """
    import re

    tokens = re.compile('"+|,|[^",]+')

    def ends_inside(line: str, inside: bool) -> bool:
        if '"' not in line:
            return inside
        state = "quoted" if inside else "start"
        for token in tokens.findall(line):
            if token[0] == '"':
                if state == "start":
                    state = "quoted" if len(token) % 2 else "closed"
                elif state == "quoted":
                    state = "closed" if len(token) % 2 else "quoted"
            elif state != "quoted":
                state = "start" if token == "," else "plain"
        return state == "quoted"

    return ends_inside


def _maps() -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    ends_inside = _state_after()

    def maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The map of each range; a task's ranges come one after the other."""
        here, states = None, (False, True)
        for pdf in batches:
            for file, begin, line in zip(pdf["file"], pdf["begin"], pdf["value"]):
                if here != (file, begin):
                    if here is not None:
                        yield pd.DataFrame([(*here, *map(int, states))], columns=["file", "begin", "from_outside", "from_inside"])
                    here, states = (file, begin), (False, True)
                states = ends_inside(line, states[0]), ends_inside(line, states[1])
        if here is not None:
            yield pd.DataFrame([(*here, *map(int, states))], columns=["file", "begin", "from_outside", "from_inside"])

    return maps


def _field_of(at: int) -> Callable[[str], str | None]:
    def field_of(record: str) -> str | None:
        import csv

        csv.field_size_limit(2**31 - 1)
        row = next(csv.reader([record]), [])
        return row[at] if at < len(row) else None

    return field_of


def _parse(at: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    ends_inside = _state_after()

    field_of = _field_of(at)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["field", "file", "begin", "opens", "header", "piece"]
        here, held, inside, opened, header = None, [], False, True, False
        for pdf in batches:
            out = []
            for file, begin, line, entered in zip(pdf["file"], pdf["begin"], pdf["value"], pdf["inside"]):
                if here != (file, begin):
                    if held:
                        out.append((None, *here, opened, header, "\n".join(held)))
                    here, held, inside, opened, header = (file, begin), [], bool(entered), not entered, begin == 0
                    if begin == 0:
                        line = line.removeprefix("\ufeff")
                held.append(line)
                inside = ends_inside(line, inside)
                if inside:
                    continue
                record = "\n".join(held)
                if not opened:
                    out.append((None, file, begin, False, False, record))
                elif record and not header:
                    out.append((field_of(record), file, begin, True, False, None))
                header = header and not record
                held, opened = [], True
            if out:
                yield pd.DataFrame(out, columns=columns)
        if held:
            yield pd.DataFrame([(None, *here, opened, header, "\n".join(held))], columns=columns)

    return parse


def _joined(at: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    field_of = _field_of(at)

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"field": [field_of(record) for record in pdf["record"]]})

    return joined


def range_states(lines: DataFrame) -> DataFrame:
    """file, begin, inside: whether each range of a file begins inside a quoted field.

    Of the maps before a range only the last constant one counts, and the swaps after it.
    """
    maps = lines.mapInPandas(_maps(), _RANGE)
    swaps, fixed = F.col("from_outside") > F.col("from_inside"), F.col("from_outside") == F.col("from_inside")
    before = Window.partitionBy("file").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    counted = maps.withColumn("swaps", F.sum(swaps.cast("int")).over(Window.partitionBy("file").orderBy("begin")))
    last = F.last(F.when(fixed, F.struct("from_outside", "swaps")), ignorenulls=True).over(before)
    turned = F.coalesce(F.last("swaps").over(before), F.lit(0))
    state = F.coalesce(last["from_outside"], F.lit(0)) + turned - F.coalesce(last["swaps"], F.lit(0))
    return counted.select("file", "begin", (state % 2 == 1).alias("inside"))


def csv_column(spark: SparkSession, path: str, at: int) -> DataFrame:
    """field: the values of one column, by place, of all records of a file or folder without the headers."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), "value")
    # One row per range of a file: the ranges of 100 TB at 128 MB each are under a million.
    states = F.broadcast(range_states(lines))
    parsed = lines.join(states, ["file", "begin"]).mapInPandas(_parse(at), _PARSED)
    whole = parsed.where("piece is null").select("field")
    along = Window.partitionBy("file").orderBy("begin", "opens")
    pieces = parsed.where("piece is not null").withColumn("record", F.sum(F.col("opens").cast("int")).over(along))
    records = pieces.groupBy("file", "record").agg(
        F.max("header").alias("header"), F.array_sort(F.collect_list(F.struct("begin", "opens", "piece"))).alias("parts"))
    crossed = records.where(~F.col("header")).select(F.array_join(F.transform("parts", lambda p: p["piece"]), "\n").alias("record"))
    return whole.unionAll(crossed.mapInPandas(_joined(at), "field string"))
