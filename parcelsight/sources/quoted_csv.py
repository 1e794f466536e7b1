"""CSV files with line breaks in quotes, read in ranges by many tasks.

Spark's own reader takes such a file in one piece, because a task that begins in the middle cannot know whether it
is inside quotes. Here one pass counts the quotes of each range; the parity of all before it says whether a
range begins inside. A second pass then cuts every range into records by itself. What lies across ranges (the end of one
and the beginning of the next) is put together apart: two pieces a range at most.

Files follow RFC 4180: fields that hold quotes are quoted, with quotes doubled. Where the header ends in a carriage
return, all line breaks are such pairs, and a pair within quotes is read as one line feed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

#: What a range is cut into: records, the end of a record from before, the beginning of one, a part from the middle.
_WHOLE, _END, _BEGIN, _MIDDLE = 0, 1, 2, 3
_OPTIONS = {"quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, value): lines in their order within the range of a file that begins at ``start``."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def range_parities(lines: DataFrame) -> DataFrame:
    """(file, start, inside, closed, pairs): whether a range begins inside quotes, whether its file ends outside, and
    whether its file has carriage returns before line feeds."""
    quotes = F.sum(F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))))
    # a range is read by one task, in order
    ranges = lines.groupBy("file", "start").agg(quotes.alias("quotes"), F.first(F.endswith("value", F.lit("\r"))).alias("pair"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return ranges.select(
        "file", "start", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("inside"),
        (F.sum("quotes").over(Window.partitionBy("file")) % 2 == 0).alias("closed"),
        F.max((F.col("start") == 0) & F.col("pair")).over(Window.partitionBy("file")).alias("pairs"))


def _cut(inside: dict[tuple[str, int], bool], pairs: set[str], whole: bool):
    """Records of ranges, or the pieces at their ends. The header, a file's first line, is left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, open_, kind, held = None, False, _WHOLE, []
        out: list[tuple[str, int, int, str]] = []

        def end_of_range() -> None:
            if held:  # the record goes on in the next range
                out.append((*place, _MIDDLE if kind == _END else _BEGIN, "\n".join(held)))

        def flush() -> pa.RecordBatch:
            rows = [r for r in out if (r[2] == _WHOLE) == whole]
            out.clear()
            file, start, kinds, text = zip(*rows, strict=True) if rows else ((), (), (), ())
            return pa.RecordBatch.from_arrays([pa.array(file, pa.string()), pa.array(start, pa.int64()),
                                               pa.array(kinds, pa.int32()), pa.array(text, pa.string())],
                                              names=["file", "start", "kind", "text"])

        for batch in batches:
            for here in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                *now, line = here
                if tuple(now) != place:
                    end_of_range()
                    place, held = tuple(now), []
                    if place not in inside:
                        raise RuntimeError("the ranges of the file have changed between two passes; read it again")
                    open_ = inside[place]
                    kind = _END if open_ else _WHOLE
                    header, paired = place[1] == 0, place[0] in pairs
                if line.count('"') % 2:
                    open_ = not open_
                held.append(line.removesuffix("\r") if paired else line)
                if not open_:
                    text = "\n".join(held)
                    if not header and (text or kind == _END):
                        out.append((*place, kind, text))
                    held, kind, header = [], _WHOLE, False
            yield flush()
        end_of_range()
        yield flush()
    return run


def quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """(text) of each record of the files at ``path``, without their headers and empty lines.

    The driver learns a flag for each range of ``spark.sql.files.maxPartitionBytes``. A file whose quotes do not
    close stops the job.
    """
    lines = _lines(spark, path)
    ranges = range_parities(lines).collect()
    broken = sorted({r["file"] for r in ranges if not r["closed"]})
    if broken:
        raise ValueError(f"quotes that are not closed in {', '.join(broken)}")
    inside = {(r["file"], r["start"]): r["inside"] for r in ranges}
    pairs = {r["file"] for r in ranges if r["pairs"]}
    schema = "file string, start long, kind int, text string"
    whole = lines.mapInArrow(_cut(inside, pairs, True), schema).select("text")
    pieces = lines.mapInArrow(_cut(inside, pairs, False), schema)
    # a piece belongs to the range where its record has begun
    so_far = Window.partitionBy("file").orderBy("start", "kind")
    begun = F.max(F.when(F.col("kind") == _BEGIN, F.col("start"))).over(so_far)
    chains = pieces.withColumn("begun", begun).groupBy("file", "begun").agg(
        F.sort_array(F.collect_list(F.struct("start", "kind", "text"))).alias("parts"))
    across = chains.select(F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"))
    return whole.unionByName(across)


def read_quoted_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns of CSV files as text, named by the header, whatever line breaks their quotes hold."""
    names = spark.read.option("header", True).option("escape", '"').csv(path).columns
    columns = ", ".join(f"`{n.replace('`', '``')}` STRING" for n in names)
    return quoted_records(spark, path).select(F.from_csv("text", columns, _OPTIONS).alias("r")).select("r.*")
