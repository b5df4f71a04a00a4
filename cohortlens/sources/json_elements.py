"""Large JSON lists read by many tasks (SRC-05, SRC-06).

A file that holds one list of records has no line to split at, so Spark's JSON
reader takes it whole in one task. Here it is read as text that ends at every
``}``, which Spark splits by byte ranges on any file system, and the structure
is found in two passes over the ranges:

1. Every range says what it does to a reader that enters it: how deep it goes
   and comes back, whether it ends inside a string, and where the wanted list
   opens, once for a reader that enters outside a string and once for one that
   enters inside. That is one small row per range (per 128 MB, say). Folded in
   file order they give the state in which every range starts.
2. With its state, every range cuts out the elements that lie in it. The pieces
   of an element that spans ranges are put together by its first range. What
   lies outside the elements (a few bytes) is the file's skeleton, which shows
   whether the file as a whole is well-formed.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TOKEN = re.compile(rb'"(?:[^"\\]|\\.)*"?|[{}\[\]]', re.S)
_STRING_END = re.compile(rb'(?:[^"\\]|\\.)*"', re.S)
_GAP = re.compile(rb"[\s,]*")
_QUOTE, _MARK = 0x22, b"\xef\xbb\xbf"


@dataclass
class Walk:
    """What a range does to a reader; depths are relative to its start."""

    in_string: bool = False
    depth: int = 0
    least: int = 0
    #: (depth before it, least depth from then on) of every list that opens behind the wanted key.
    opens: list[list[int]] = field(default_factory=list)
    #: The first byte that is no blank.
    first: int = -1

    def feed(self, data: bytes, key: bytes | None) -> None:
        if self.first < 0:
            self.first = next(iter(data.removeprefix(_MARK).lstrip()), -1)
        at = 0
        if self.in_string:
            m = _STRING_END.match(data)
            if not m:
                return
            self.in_string, at = False, m.end()
        name = None
        for m in _TOKEN.finditer(data, at):
            c = data[m.start()]
            if c == _QUOTE:
                if m.end() - m.start() == 1 or data[m.end() - 1] != _QUOTE:
                    self.in_string = True
                    break
                name = m
            elif c in b"{[":
                if key is not None and opens_list(data, m, name, key):
                    self.opens.append([self.depth, self.depth + 1])
                self.depth += 1
            else:
                self.depth -= 1
                self.least = min(self.least, self.depth)
                if self.opens:
                    self.opens[-1][1] = min(self.opens[-1][1], self.depth)


def opens_list(data: bytes, bracket: re.Match, name: re.Match | None, key: bytes) -> bool:
    """Whether ``bracket`` opens a list that is the value of ``key``; ``name`` is the last string before it."""
    return (data[bracket.start()] == 0x5B and name is not None and name.group() == key
            and data[name.end():bracket.start()].strip() == b":")


@dataclass
class Start:
    """The state in which a range begins."""

    in_string: bool = False
    depth: int = 0
    inside: bool = False  # the wanted list
    element: int = -1  # the range in which the element that is open here began
    open_end: bool = False  # the file ends here, and not with a closing brace


def ranges(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, data): the text up to every closing brace, in order within a task."""
    return (spark.read.option("lineSep", "}").text(path)
            .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                    F.col("value").cast("binary").alias("data")))


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, int, bytes, bool]]:
    """(file, block, data, first): the bytes of consecutive rows of one range in a batch, closing braces restored.

    ``first`` marks the first bytes of a range; the rows of a range follow each other.
    """
    now = None
    for b in batches:
        files, blocks, data = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)
        at = 0
        while at < b.num_rows:
            end, here = at + 1, (files[at], blocks[at])
            while end < b.num_rows and (files[end], blocks[end]) == here:
                end += 1
            yield *here, b"".join(x + b"}" for x in data.slice(at, end - at).to_pylist()), here != now
            now, at = here, end


def plain_name(name: str) -> str:
    return re.sub("^file:/+", "file:/", unquote(name))


def file_sizes(spark: SparkSession, path: str) -> dict[str, int]:
    """Bytes of every file at ``path``, from metadata only; empty files count."""
    listed = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path"), F.col("_metadata.file_size"))
    found = {r[0]: r[1] for r in listed.collect()}
    # Spark gives no row for a file without bytes, but lists it (in another spelling of its place).
    listed = {plain_name(name) for name in spark.read.text(path).inputFiles()}
    return found | dict.fromkeys(listed - {plain_name(name) for name in found}, 0)


def starts(spark: SparkSession, path: str, key: str | None, sizes: dict[str, int]) -> dict[tuple[str, int], Start]:
    """The state at the start of every range: a fold of one small row per range, file by file."""
    wanted = None if key is None else json.dumps(key).encode()

    def run(batches):
        walks, name, n = None, None, 0

        def row():
            return pa.RecordBatch.from_pydict({"file": [name[0]], "block": [name[1]], "n": [n], "walks": [json.dumps(
                [[w.in_string, w.depth, w.least, w.opens, w.first] for w in walks])]})

        for file, block, data, first in _runs(batches):
            if first:
                if walks:
                    yield row()
                name, walks, n = (file, block), (Walk(), Walk(in_string=True)), 0
            n += len(data)
            for w in walks:
                w.feed(data, wanted)
        if walks:
            yield row()

    rows = sorted(((r["file"], r["block"], json.loads(r["walks"]), r["n"]) for r in
                   ranges(spark, path).mapInArrow(run, "file string, block long, n long, walks string").collect()),
                  key=lambda r: r[:2])
    # A brace is put behind every text. Behind the last it may be one too many, which the size of the file tells (a
    # byte order mark of 3 bytes is no text).
    total: dict[str, int] = {}
    for file, _, _, n in rows:
        total[file] = total.get(file, 0) + n
    found: dict[tuple[str, int], Start] = {}
    level, state = (1 if key is None else 2), Start()
    for i, (file, block, walks, _) in enumerate(rows):
        begins = not i or rows[i - 1][0] != file
        state = Start() if begins else state
        found[file, block] = state
        state.open_end = (i + 1 == len(rows) or rows[i + 1][0] != file) and (total[file] - sizes[file]) % 3 == 1
        in_string, depth, least, opens, first = walks[state.in_string]
        end = state.depth + depth
        if key is None:  # the list is the file
            inside = first == 0x5B and end >= level if begins else state.inside and state.depth + least >= level
        else:
            inside = state.inside and state.depth + least >= level
            for before, after in opens:
                if state.depth + before == 1:
                    inside = state.depth + after >= level
        element = -1
        if inside and end > level:
            through = state.element >= 0 and state.depth + least > level
            element = state.element if through else block
        state = Start(in_string, end, inside, element)
    return found


class Cutter:
    """Cuts the elements out of one range; ``rows`` are (start, data, kind)."""

    def __init__(self, start: Start, block: int, key: bytes | None):
        self.level, self.key, self.block, self.open_end = (1 if key is None else 2), key, block, start.open_end
        self.in_string, self.depth, self.inside, self.element = start.in_string, start.depth, start.inside, start.element
        self.held, self.rows, self.elements, self.commas = bytearray(), [], 0, 0

    def give(self, kind: str, data: bytes, start: int = -1) -> None:
        self.rows.append((start, bytes(data), kind))

    def gap(self) -> None:
        """What was held lies between elements."""
        self.commas += self.held.count(b",")
        if self.held.count(b",") > 1 or not _GAP.fullmatch(self.held):
            self.give("misplaced", self.held[:80])
        self.held.clear()

    def feed(self, data: bytes) -> None:
        at = pos = 0  # what lies before pos has been dealt with
        if self.in_string:
            m = _STRING_END.match(data)
            if not m:
                self.held += data
                return
            self.in_string, at = False, m.end()
        name = None
        for m in _TOKEN.finditer(data, at):
            i, c = m.start(), data[m.start()]
            if c == _QUOTE:
                if m.end() - i == 1 or data[m.end() - 1] != _QUOTE:
                    self.in_string = True
                    break
                name = m
            elif c in b"{[":
                if self.element < 0 and self.inside and self.depth == self.level:
                    self.held += data[pos:i]
                    self.gap()
                    if c != 0x7B:
                        self.give("misplaced", data[i:i + 80])
                    self.element, pos = self.block, i
                elif not self.inside and (self.depth == 0 and c == 0x5B if self.key is None else
                                          self.depth == 1 and opens_list(data, m, name, self.key)):
                    self.held += data[pos:i + 1]
                    self.give("outside", self.held)
                    self.held.clear()
                    self.inside, pos = True, i + 1
                self.depth += 1
            else:
                self.depth -= 1
                if self.element >= 0 and self.depth == self.level:
                    self.held += data[pos:i + 1]
                    whole = self.element == self.block
                    self.give("element" if whole else "part", self.held, -1 if whole else self.element)
                    self.held.clear()
                    self.element, pos = -1, i + 1
                    self.elements += 1
                elif self.inside and self.depth < self.level:
                    self.held += data[pos:i]
                    self.gap()
                    self.inside, pos = False, i
        self.held += data[pos:]

    def end(self) -> None:
        """The range ends: an open element goes on in the next one."""
        if self.element >= 0:
            self.give("part", self.held, self.element)
        elif self.inside:
            self.gap()
        elif self.held:
            self.give("outside", self.held)
        self.held.clear()


_PIECES = pa.schema([("file", pa.string()), ("block", pa.int64()), ("ord", pa.int32()), ("start", pa.int64()),
                     ("data", pa.binary()), ("kind", pa.string()), ("elements", pa.int64()), ("commas", pa.int64())])
_PIECES_DDL = ("file string, block long, ord int, start long, data binary, kind string, elements long, commas long")


def pieces(spark: SparkSession, path: str, key: str | None, sizes: dict[str, int] | None = None) -> DataFrame:
    """(file, block, ord, start, data, kind, elements, commas) of every range.

    ``kind``: a whole ``element``, the ``part`` of one that spans ranges (``start``
    is its first), ``outside`` text, something ``misplaced`` in the list, or the
    ``count`` of the elements that end in the range and of the commas between.
    """
    sizes = file_sizes(spark, path) if sizes is None else sizes
    shared = spark.sparkContext.broadcast(starts(spark, path, key, sizes))  # one entry per range
    wanted = None if key is None else json.dumps(key).encode()

    def run(batches):
        name = cutter = pending = None
        at = 0

        def out(done: bool):
            nonlocal at
            if done:
                cutter.end()
            rows = [(*name, at + n, start, data, kind, None, None) for n, (start, data, kind) in enumerate(cutter.rows)]
            at += len(rows)
            cutter.rows.clear()
            if done:
                rows.append((*name, at, -1, b"", "count", cutter.elements, cutter.commas))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * len(_PIECES), _PIECES.types)], schema=_PIECES)

        for file, block, data, first in _runs(batches):
            if cutter is not None:
                cutter.feed(pending[:-1] if first and cutter.open_end else pending)
                yield out(first)
            if first:
                name, at = (file, block), 0
                cutter = Cutter(shared.value[file, block], block, wanted)
                data = data.removeprefix(_MARK) if block == 0 else data
            pending = data
        if cutter is not None:
            cutter.feed(pending[:-1] if cutter.open_end else pending)
            yield out(True)

    return ranges(spark, path).mapInArrow(run, _PIECES_DDL)


#: Text outside the wanted list that a file may have.
MOST_OUTSIDE = 1 << 24


def read_elements(spark: SparkSession, path: str, key: str | None = None) -> tuple[DataFrame, dict[str, object]]:
    """((file, text) of every element of the list, what each file holds besides).

    ``key`` names the list in a file that holds an object; without it the file
    itself is the list. Each element is an object. A file that is no such list
    or object, is broken, or has anything but objects in the list is an error
    that names it.
    """
    files = file_sizes(spark, path)
    found = pieces(spark, path, key, files)
    summary = found.filter("kind <> 'element'").groupBy("file").agg(
        F.sum("elements").alias("elements"), F.sum("commas").alias("commas"),
        F.min(F.when(F.col("kind") == "misplaced", F.col("data"))).alias("misplaced"),
        F.sum(F.when(F.col("kind") == "outside", F.octet_length("data"))).alias("bytes_outside"))
    stats = {r["file"]: r for r in summary.collect()}  # one row per file
    outside: dict[str, bytes] = {}
    if all((r["bytes_outside"] or 0) <= MOST_OUTSIDE for r in stats.values()):
        for r in found.filter("kind = 'outside'").select("file", "block", "ord", "data").orderBy(
                "file", "block", "ord").collect():  # the skeletons
            outside[r["file"]] = outside.get(r["file"], b"") + bytes(r["data"])
    skeletons: dict[str, object] = {}
    for file in files:
        what = "a list of records" if key is None else f"an object with a list of records in {key!r}"
        r = stats.get(file)
        try:
            skeletons[file] = json.loads(outside[file])
        except (KeyError, ValueError):
            text = outside.get(file, b"").lstrip()
            whole = text[:1] == (b"[" if key is None else b"{")
            raise ValueError(f"{file}: " + ("broken JSON" if whole else f"not {what}")) from None
        if (skeletons[file] if key is None else skeletons[file].get(key) if isinstance(skeletons[file], dict) else None) != []:
            raise ValueError(f"{file}: not {what}")
        if r["misplaced"] is not None or r["commas"] != max(0, r["elements"] - 1):
            raise ValueError(f"{file}: broken JSON")
    whole = found.filter("kind = 'element'").select("file", F.col("data").cast("string").alias("text"))
    spanning = found.filter("kind = 'part'").groupBy("file", "start").agg(
        F.sort_array(F.collect_list(F.struct("block", F.col("data").cast("string").alias("text")))).alias("p"))
    return whole.unionByName(spanning.select("file", F.concat_ws("", F.col("p.text")).alias("text"))), skeletons
