"""Large CSV and JSON files read by many tasks, though records hold line feeds or the file is one array.

Spark's text reader cuts a file at line feeds (CSV) or closing braces (JSON), in as many tasks as there are blocks; no
block says whether it begins inside quotes. A first pass so follows both cases through every block at once and
gives what each would end in. Composing these few values per block, by windows over the blocks of a file, tells every
block its true start: a block that ends the same way in both cases settles what follows, and blocks in between
either keep or swap the state. Bracket depth is a running sum. A second pass cuts records. A record that reaches into
further blocks leaves a fragment in each, under the block in which it began, and only fragments are shuffled.

CSV: a quote opens a quoted cell at its start only; two quotes in one are one. Carriage returns at line ends go. JSON:
an array of objects, or objects one after the other. Text is UTF-8, a byte-order mark goes. Unclosed quotes take in the
rest of the file, as a reader of the whole file would. Compressed files that can't be split are one block.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilframe.plans.budget import PrivacyError
from veilframe.plans.storage import persisted, shared_dir

#: Blocks whose starts are broadcast (some 100 bytes each); more are joined.
BLOCKS = 100_000
_PIECE = "file string, block long, part long, text string, first boolean"


# -- CSV: what a line does to the state ----------------------------------------------------------------

_CLOSE = re.compile(r'(?:[^"]|"")*"(?!")')


def _cells(sep: str) -> tuple[re.Pattern, re.Pattern]:
    start = rf'(?:^|(?<={re.escape(sep)}))"'
    return re.compile(start + r'(?:[^"]|"")*"(?!")'), re.compile(start)


def after_line(line: str, inside: bool, sep: str, patterns: tuple[re.Pattern, re.Pattern] | None = None) -> bool:
    """Whether the end of a line is inside a quoted cell, by whether its start is."""
    if '"' not in line:
        return inside
    whole, start = patterns or _cells(sep)
    if inside:
        close = _CLOSE.match(line)
        if not close:
            return True
        # What follows up to the next separator still belongs to the cell.
        line = " " + line[close.end() :]
    return bool(start.search(whole.sub(" ", line)))


# -- JSON: what a piece up to a closing brace does ------------------------------------------------------

_ESCAPED = re.compile(r"\\.", re.S)


def after_piece(piece: str, inside: bool) -> tuple[bool, int]:
    """(inside a string, change of depth) after a piece and the brace that ends it."""
    parts = (_ESCAPED.sub("", piece) if "\\" in piece else piece).split('"')
    bare = "".join(parts[inside::2])
    end = inside ^ (len(parts) % 2 == 0)
    return end, bare.count("{") + bare.count("[") - bare.count("]") - (not end)


# -- passes --------------------------------------------------------------------------------------------


def _pieces(spark: SparkSession, path: str | list[str], sep: str) -> DataFrame:
    lines = spark.read.option("lineSep", sep).text(path)
    meta = {"file": "file_path", "block": "file_block_start", "size": "file_size"}
    return lines.select("value", *(F.col(f"_metadata.{m}").alias(c) for c, m in meta.items()), F.monotonically_increasing_id().alias("seq"), (F.octet_length("value") + 1).cast("long").alias("bytes"))


def _rows(batches) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def _summaries(pieces: DataFrame, step: Callable[[str, bool], tuple[bool, int]]) -> DataFrame:
    """(file, block, size, out0, out1, low0, low1, deep0, deep1, head, bytes): of each block, for a start outside (0) and inside (1)
    quotes: the state at its end, the least change of depth at the start of a piece outside quotes (null if there is none),
    the change of depth at its end; its first sign and its bytes."""
    schema = "file string, block long, size long, out0 boolean, out1 boolean, low0 long, low1 long, deep0 long, deep1 long, head string, bytes long"

    def run(batches):
        own, state = None, [None] * 7

        def told():
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), *[pa.int64()] * 4, pa.string(), pa.int64())
            return pa.record_batch([pa.array([x], k) for x, k in zip((*own, *state), kinds, strict=True)], ["file", "block", "size", "out0", "out1", "low0", "low1", "deep0", "deep1", "head", "bytes"])

        for value, file, block, size, n in _rows(batches):
            if own != (file, block, size):
                if own:
                    yield told()
                own, state = (file, block, size), [False, True, None, None, 0, 0, None, 0]
            state[7] += n
            for i in (0, 1):
                if not state[i]:
                    state[2 + i] = state[4 + i] if state[2 + i] is None else min(state[2 + i], state[4 + i])
            if state[6] is None and (bare := value.lstrip("﻿ \t\r\n")):
                state[6] = bare[0]
            (state[0], a), (state[1], b) = step(value, state[0]), step(value, state[1])
            state[4], state[5] = state[4] + a, state[5] + b
        if own:
            yield told()

    return pieces.select("value", "file", "block", "size", "bytes").mapInArrow(run, schema)


def _base(head: Column) -> Column:
    """The depth at which a JSON file's objects stand."""
    return F.when(head == "[", 1).otherwise(0)


def _starts(summaries: DataFrame, base: Callable[[Column], Column] = lambda head: F.lit(0)) -> DataFrame:
    """(file, block, inside, depth, opener, head, ends, size, bytes): how each block begins; ``opener`` is the block in which
    the record began that reaches into this one, ``head`` the file's first sign, ``ends`` the depth at the block's end."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    settled, swaps = F.col("out0") == F.col("out1"), F.col("out0") & ~F.col("out1")
    # Since the last block that settles the state: what it settled, and how often it has been swapped.
    run = summaries.withColumn("n", F.coalesce(F.count_if(settled).over(before), F.lit(0)))
    run = run.withColumn("value", F.coalesce(F.last(F.when(settled, F.col("out0")), True).over(before), F.lit(False)))
    since = Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # A settling block still belongs to the run that it ends.
    run = run.withColumn("run", F.col("n"))
    run = run.withColumn("inside", F.col("value") != (F.coalesce(F.count_if(swaps).over(since), F.lit(0)) % 2 == 1))
    first = F.first("head", True).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    mine = lambda name: F.when(F.col("inside"), F.col(f"{name}1")).otherwise(F.col(f"{name}0"))
    run = run.withColumn("depth", F.coalesce(F.sum(mine("deep")).over(before), F.lit(0)).cast("long")).withColumn("first", first)
    # A record begins where a piece starts between records; of what is open at a block's end it is the last that does.
    began = F.when(F.col("depth") + mine("low") <= base(F.col("first")), F.col("block"))
    return run.select("file", "block", "inside", "depth", F.last(began, True).over(before).alias("opener"), F.col("first").alias("head"), (F.col("depth") + mine("deep")).alias("ends"), "size", "bytes")


def _placed(pieces: DataFrame, starts: DataFrame, blocks: int) -> DataFrame:
    """Pieces in order with how their block begins."""
    columns = ["value", "file", "block", "inside", "depth", "opener", "head"]
    if blocks <= BLOCKS:
        return pieces.join(F.broadcast(starts), ["file", "block"]).select(*columns)
    return pieces.join(starts, ["file", "block"]).repartition("file", "block").sortWithinPartitions("file", "block", "seq").select(*columns)


def _csv_cutter(sep: str, fragments: bool):
    """Of lines in order: the records that lie in one block, or the fragments of the others."""
    patterns = _cells(sep)

    def run(batches):
        own, state, held, whole, out, first = None, False, [], True, [], False

        def fragment():
            if held and fragments:
                out.append((own[0], own[2] if not whole else own[1], own[1], "\n".join(held), first and whole))

        for value, file, block, inside, _, opener, _ in _rows(batches):
            if own is None or own[:2] != (file, block):
                if own is not None:
                    fragment()
                own, state, held, whole, first = (file, block, opener), inside, [], not inside, block == 0
                if block == 0:
                    value = value.removeprefix("﻿")
            held.append(value.removesuffix("\r"))
            state = after_line(value, state, sep, patterns)
            if not state:
                if whole and not fragments and (len(held) > 1 or held[0]):
                    out.append((file, block, None, "\n".join(held), first))
                elif not whole:
                    fragment()
                first = first and not any(held)  # blank lines before the header
                held, whole = [], True
            if len(out) >= 4096:
                yield _batch(out)
                out.clear()
        if own is not None:
            fragment()
        if out:
            yield _batch(out)

    return run


def _json_cutter(fragments: bool):
    """Of pieces in order: the objects that lie in one block, or the fragments of the others."""

    def run(batches):
        own, inside, depth, base, held, whole, opened, out = None, False, 0, 0, [], True, False, []

        def fragment():
            if held and fragments:
                out.append((own[0], own[1] if whole else own[2], own[1], "".join(held), False))

        for value, file, block, starts_inside, starts_depth, opener, head in _rows(batches):
            if own is None or own[:2] != (file, block):
                if own is not None and opened:
                    fragment()
                own, inside, depth, base, held = (file, block, opener), starts_inside, starts_depth, int(head == "["), []
                opened = inside or depth > base
                whole = not opened
            if not opened:
                at = value.find("{")
                if at >= 0:
                    opened, whole, value = True, True, value[at:]
                    # What stands before an object is the array's own bracket, if anything counts.
                    depth = base
                else:
                    continue
            inside, change = after_piece(value, inside)
            depth += change
            held.append(value + "}")
            if not inside and depth <= base:
                if whole and not fragments:
                    out.append((file, block, None, "".join(held), False))
                elif not whole:
                    fragment()
                held, opened, whole = [], False, True
            if len(out) >= 4096:
                yield _batch(out)
                out.clear()
        if own is not None and opened:
            fragment()
        if out:
            yield _batch(out)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["file", "block", "part", "text", "first"])


def _records(placed: DataFrame, cutter: Callable[[bool], Callable], between: str, reach: bool) -> DataFrame:
    """(file, text, first) of every record. ``reach``: whether any reaches into a further block."""
    whole = placed.mapInArrow(cutter(False), _PIECE).select("file", "text", "first")
    if not reach:
        return whole
    parts = placed.mapInArrow(cutter(True), _PIECE).groupBy("file", "block").agg(F.array_sort(F.collect_list(F.struct("part", "text"))).alias("all"), F.max("first").alias("first"))
    return whole.unionByName(parts.select("file", F.array_join(F.transform("all", lambda x: x["text"]), between).alias("text"), "first"))


def csv_records(spark: SparkSession, path: str | list[str], sep: str = ",") -> DataFrame:
    """(file, text, first): the records of CSV files, line feeds in quoted cells included; ``first`` marks a file's
    first one."""
    pieces, patterns = _pieces(spark, path, "\n"), _cells(sep)
    starts = persisted(_starts(_summaries(pieces, lambda line, inside: (after_line(line, inside, sep, patterns), 0))), "starts")
    blocks, reach = starts.agg(F.count("*"), F.bool_or("inside")).first()
    return _records(_placed(pieces, starts, blocks), lambda fragments: _csv_cutter(sep, fragments), "\n", bool(reach))


def json_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, text): the objects of JSON files. Files that hold anything else, or end within an object, are refused."""
    pieces = _pieces(spark, path, "}")
    starts = persisted(_starts(_summaries(pieces, after_piece), _base), "starts")
    base = _base(F.col("head"))
    blocks, reach, odd = starts.agg(F.count("*"), F.bool_or(F.col("inside") | (F.col("depth") > base)), F.count_if(~F.coalesce(F.col("head").isin("[", "{"), F.lit(True)))).first()
    # A brace is counted after every piece. Where a file has one byte less than that, a mark of three bytes or none before
    # it, its last piece has none; of compressed files it can't be told.
    more = (F.sum("bytes") - F.max("size")).alias("more")
    ends = starts.groupBy("file").agg(F.max_by("ends", "block").alias("ends"), more)
    fits = F.when(F.col("more").isin(1, -2), F.col("ends") == -1).when(F.col("more").isin(0, -3), F.col("ends") == 0).otherwise(F.col("ends").isin(0, -1))
    if odd or not ends.filter(~fits).isEmpty():
        raise PrivacyError("not an array of objects")
    return _records(_placed(pieces, starts, blocks), _json_cutter, "", bool(reach)).select("file", "text")


def read_csv(spark: SparkSession, path: str | list[str], sep: str = ",") -> DataFrame:
    """What ``ingest.read_csv`` gives, with a file read by many tasks: all strings, short rows padded with "", extra cells
    dropped, a header in every file."""
    columns = spark.read.csv(path, header=True, multiLine=True, sep=sep, quote='"', escape='"', encoding="UTF-8").columns  # the first record
    if not columns:
        raise PrivacyError("the file is empty")
    names = [f"c{i}" for i in range(len(columns))]
    schema = ", ".join(f"{n} string" for n in names)
    cells = F.from_csv("text", F.lit(schema), {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE"})
    rows = csv_records(spark, path, sep).filter("NOT first").select(cells.alias("r"))
    return rows.select(*(F.coalesce(F.col(f"r.{n}"), F.lit("")).alias(c) for n, c in zip(names, columns, strict=True)))


def json_lines(spark: SparkSession, path: str | list[str]) -> str:
    """The objects of JSON files written as lines into the shared folder, for readers that split at line feeds; its path."""
    target = f"{shared_dir(spark)}/veilframe/lines-{uuid.uuid4().hex}"
    json_records(spark, path).select(F.translate("text", "\r\n", "  ").alias("text")).write.text(target)
    return target
