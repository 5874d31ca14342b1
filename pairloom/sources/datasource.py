"""`format("edgelist")` and `format("mtx")`: graph files as data sources, read in byte ranges and written with a commit.

Reading. Every file is cut into ranges of `split` bytes (32 MB). A range holds the lines that begin in it, so a line is in one
range only, whatever its length; the first line that says what the others mean is read once, when the scan is planned, checked,
and passed to all ranges. A folder that the sink has written is one graph: its parts are ranges too. With option
`sorted`, for files in ascending order of the first id, ranges whose first ids cannot meet the filters on it are not read (the
option needs spark.sql.python.filterPushdown.enabled; Spark applies the filters again).

Writing. Each task writes a file of its own under a random name and reports name, lines and place; the commit, which has the
reports of the tasks that counted and no other, renames these in order, writes the header with their sum, last of all the
manifest, and removes what failed or repeated tasks have left. Until then there is no graph to read. Option `n` (bipartite:
`left`, `right`) is the number of vertices. Option `single` joins the parts to one file of the classic form, in pieces.

Paths are any that pyarrow's file systems know by their scheme (local, HDFS, object stores); a `*` stands in the last component.
"""

from __future__ import annotations

import fnmatch
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

SPLIT, BLOCK, BATCH = 32 << 20, 4 << 20, 1 << 16
MANIFEST = "_GRAPH.json"


def _store(path: str):
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def _files(store, path: str) -> list[tuple[str, int]]:
    """Names and sizes of the files that a path means; a graph folder's parts in order."""
    from pyarrow import fs

    if "*" in path:
        folder, _, last = path.rpartition("/")
        found = [f for f in store.get_file_info(fs.FileSelector(folder)) if fnmatch.fnmatch(f.base_name, last)]
        return [x for f in sorted(found, key=lambda f: f.path) for x in _files(store, f.path)]
    info = store.get_file_info(path)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    if store.get_file_info(f"{path}/{MANIFEST}").type == fs.FileType.NotFound:
        names = [f.path for f in store.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
        return [x for f in sorted(names) for x in _files(store, f)]
    with store.open_input_stream(f"{path}/{MANIFEST}") as f:
        parts = json.loads(f.read())["parts"]
    return [(f"{path}/{p}", store.get_file_info(f"{path}/{p}").size) for p in parts]


@dataclass
class Range(InputPartition):
    """Lines that begin at `start` or after, and before `end`; header: the first line's numbers."""

    path: str
    start: int
    end: int
    header: tuple[int, ...]

    def __init__(self, path: str, start: int, end: int, header: tuple[int, ...]):
        self.path, self.start, self.end, self.header = path, start, end, header


def _lines(f, start: int, end: int, at_line: bool) -> Iterator[tuple[int, bytes]]:
    """Place and content of the lines that begin in [start, end); at_line: start is known to be the beginning of one."""
    at = start if at_line else start - 1
    f.seek(at)
    rest, skip = b"", not at_line
    while at < end or rest:
        block = f.read(BLOCK)
        if not block:
            if rest and not skip and at < end:
                yield at, rest
            return
        parts = (rest + block).split(b"\n")
        rest = parts.pop()
        for line in parts:
            if at >= end:
                return
            if not skip:
                yield at, line
            skip = False
            at += len(line) + 1
        if at >= end:
            return


class GraphReader(DataSourceReader):
    def __init__(self, options: dict[str, str], fields: int, shift: int, first: str):
        self.path, self.fields, self.shift, self.first = options["path"], fields, shift, first
        self.split = int(options.get("split", SPLIT))

    def partitions(self) -> list[Range]:
        store, path = _store(self.path)
        out, header, graph = [], None, None
        for name, size in _files(store, path):
            folder, _, base = name.rpartition("/")
            if header is None or not base.startswith("part-") or graph != folder:  # parts of a graph share its header
                header, at = self._header(store, name, size)
                graph = folder if base == "part-header" else None
            else:
                at = 0
            out += [Range(name, a, min(a + self.split, size), header) for a in range(at, size, self.split)]
        return out

    def _header(self, store, name: str, size: int) -> tuple[tuple[int, ...], int]:
        with store.open_input_file(name) as f:
            for at, line in _lines(f, 0, size, True):
                x = line.split()
                if x and not line.startswith(b"%"):
                    if len(x) != self.fields:
                        raise ValueError(f"{name}: the first line must have {self.fields} numbers")
                    return tuple(int(v) for v in x), min(size, at + len(line) + 1)
        raise ValueError(f"{name}: no first line")

    def read(self, partition: Range | None):
        import pyarrow as pa

        if partition is None:  # Spark's stand-in where there are no ranges
            return
        store, _ = _store(self.path)
        names = ("l", "r") if self.first == "l" else ("u", "v")
        a, b = [], []
        with store.open_input_file(partition.path) as f:
            at_line = partition.start == 0 or _begins(f, partition.start)
            for _, line in _lines(f, partition.start, partition.end, at_line):
                x = line.split(None, 2)
                if len(x) < 2 or line.startswith(b"%"):
                    continue
                a.append(int(x[0]) - self.shift)
                b.append(int(x[1]) - self.shift)
                if len(a) == BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=list(names))
                    a, b = [], []
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=list(names))


class SortedReader(GraphReader):
    def __init__(self, options: dict[str, str], fields: int, shift: int, first: str):
        super().__init__(options, fields, shift, first)
        self.low, self.high = None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds of the first id, for ranges to be left out; all filters are Spark's to apply."""
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute == (self.first,) and isinstance(f.value, int):
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.low = f.value if self.low is None else max(self.low, f.value)
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.high = f.value if self.high is None else min(self.high, f.value)
            yield f

    def partitions(self) -> list[Range]:
        out = super().partitions()
        return out if self.low is None and self.high is None else self._met(_store(self.path)[0], out)

    def _met(self, store, ranges: list[Range]) -> list[Range]:
        """Without ranges of a sorted file whose first ids lie outside the bounds: a range's ids end where the next one's begin."""
        heads = []
        for r in ranges:
            with store.open_input_file(r.path) as f:
                at_line = r.start == 0 or _begins(f, r.start)
                heads.append((r.path, next((int(x[0]) - self.shift for _, line in _lines(f, r.start, f.size(), at_line) if len(x := line.split()) >= 2 and not line.startswith(b"%")), None)))
        out = []
        for k, r in enumerate(ranges):
            first = heads[k][1]
            after = heads[k + 1][1] if k + 1 < len(ranges) and heads[k + 1][0] == r.path else None
            if first is None or (self.high is not None and first > self.high) or (self.low is not None and after is not None and after < self.low):
                continue
            out.append(r)
        return out


def _reader(options: dict[str, str], fields: int, shift: int, first: str) -> GraphReader:
    """Option sorted asks for filters, which Spark only grants with spark.sql.python.filterPushdown.enabled."""
    kind = SortedReader if options.get("sorted", "false").lower() == "true" else GraphReader
    return kind(options, fields, shift, first)


def _begins(f, at: int) -> bool:
    """Whether a line begins at this place."""
    f.seek(at - 1)
    return f.read(1) == b"\n"


@dataclass
class Part(WriterCommitMessage):
    place: int
    name: str
    lines: int


class GraphWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool, bipartite: bool):
        self.path, self.overwrite, self.bipartite = options["path"].rstrip("/"), overwrite, bipartite
        self.sides = [int(options["left"]), int(options["right"])] if bipartite else [int(options["n"])]
        self.single = options.get("single", "false").lower() == "true"
        self.run = uuid.uuid4().hex

    def write(self, rows) -> Part:
        from pyspark import TaskContext

        store, path = _store(self.path)
        place, name = TaskContext.get().partitionId(), f"_tmp-{self.run}-{uuid.uuid4().hex}"
        store.create_dir(path, recursive=True)
        lines = 0
        with store.open_output_stream(f"{path}/{name}") as f:
            for a, b in rows:
                f.write(b"%d %d\n" % (a, b))
                lines += 1
        return Part(place, name, lines)

    def commit(self, messages: list[Part | None]) -> None:
        from pyarrow import fs

        store, path = _store(self.path)
        store.create_dir(path, recursive=True)
        parts = sorted((m for m in messages if m is not None and m.lines), key=lambda m: m.place)
        if store.get_file_info(f"{path}/{MANIFEST}").type != fs.FileType.NotFound:
            if not self.overwrite:
                raise FileExistsError(f"{path}: there is a graph already; a header counts all edges, so nothing can be appended")
            store.delete_file(f"{path}/{MANIFEST}")
        names = ["part-header"] + [f"part-{k:06d}" for k in range(len(parts))]
        with store.open_output_stream(f"{path}/part-header") as f:
            f.write((" ".join(map(str, [*self.sides, sum(p.lines for p in parts)])) + "\n").encode())
        for name, p in zip(names[1:], parts, strict=True):
            store.move(f"{path}/{p.name}", f"{path}/{name}")
        with store.open_output_stream(f"{path}/{MANIFEST}") as f:
            f.write(json.dumps({"parts": names}).encode())
        self._clear(store, path, {*names, MANIFEST})
        if self.single:
            with store.open_output_stream(f"{path}.txt") as out:
                for name in names:
                    with store.open_input_stream(f"{path}/{name}") as f:
                        while block := f.read(BLOCK):
                            out.write(block)

    def abort(self, messages: list[Part | None]) -> None:
        store, path = _store(self.path)
        self._clear(store, path, None)

    def _clear(self, store, path: str, keep: set[str] | None) -> None:
        """Removes this run's unfinished files, and with `keep` every other one that is not in it."""
        from pyarrow import fs

        for f in store.get_file_info(fs.FileSelector(path, allow_not_found=True)):
            if f.type == fs.FileType.File and (f.base_name.startswith(f"_tmp-{self.run}") or keep is not None and f.base_name not in keep):
                store.delete_file(f.path)


class EdgeList(DataSource):
    """Option kind: general (u, v) or bipartite (l, r)."""

    @classmethod
    def name(cls) -> str:
        return "edgelist"

    def _bipartite(self) -> bool:
        return self.options.get("kind", "general") == "bipartite"

    def schema(self) -> str:
        return "l long, r long" if self._bipartite() else "u long, v long"

    def reader(self, schema) -> DataSourceReader:
        return _reader(self.options, 3 if self._bipartite() else 2, 0, "l" if self._bipartite() else "u")

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return GraphWriter(self.options, overwrite, self._bipartite())


class MatrixMarket(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mtx"

    def schema(self) -> str:
        return "u long, v long"

    def reader(self, schema) -> DataSourceReader:
        return _reader(self.options, 3, 1, "u")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EdgeList)
    spark.dataSource.register(MatrixMarket)


def write_graph(edges, path: str, n: int | None = None, sides: tuple[int, int] | None = None, single: bool = False) -> None:
    """Edges (u, v), or (l, r) with sides, in ascending order as a graph folder at path, and with `single` as the file path.txt."""
    register(edges.sparkSession)
    names = ("l", "r") if sides else ("u", "v")
    w = edges.select(*names).repartitionByRange(*names).sortWithinPartitions(*names).write.format("edgelist").mode("overwrite").option("single", str(single).lower())
    w = w.options(kind="bipartite", left=sides[0], right=sides[1]) if sides else w.option("n", n)
    w.save(path)
