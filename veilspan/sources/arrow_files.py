"""Data sets saved as Arrow files: folders of record batches, one folder for each split.

Registered as the format ``arrow_files``. A partition is a run of record batches of one file, found from the headers of its messages alone, so that
no file is read whole and large files are read by many tasks. Files in the stream and in the random-access format are both read. Paths may be of any store that
``pyarrow.fs`` opens; on a cluster it must be one that the driver and the executors share.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of record batches in a partition, unless the option batchBytes says otherwise; a larger batch is a partition of its own.
BATCH_BYTES = 32 << 20
# What the Arrow format begins files and messages with, and the kinds of messages.
_MAGIC, _CONTINUES = b"ARROW1\0\0", 0xFFFFFFFF
_SCHEMA, _DICTIONARY, _BATCH = 1, 2, 3
#: Files that name a data set's splits and a split's files in their order.
_SPLITS, _STATE = "dataset_dict.json", "state.json"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _json(store: fs.FileSystem, path: str) -> dict | None:
    if store.get_file_info(path).type != fs.FileType.File:
        return None
    with store.open_input_stream(path) as f:
        return json.loads(f.read())


def split_folder(path: str, split: str | None = None) -> str:
    """The folder of a data set's split: the named one, else ``train``, else the first; a folder that holds Arrow files itself is its own."""
    store, root = _store(path)
    root = root.rstrip("/")
    found = store.get_file_info(fs.FileSelector(root))
    if split is None and any(x.type == fs.FileType.File and x.extension == "arrow" for x in found):
        return root
    listed = (_json(store, f"{root}/{_SPLITS}") or {}).get("splits")
    splits = listed or sorted(x.base_name for x in found if x.type == fs.FileType.Directory)
    if not splits or split is not None and split not in splits:
        raise FileNotFoundError(f"{path} has no split {split or ''}".rstrip())
    return f"{root}/{split or ('train' if 'train' in splits else splits[0])}"


def _files(store: fs.FileSystem, folder: str) -> list[str]:
    listed = (_json(store, f"{folder}/{_STATE}") or {}).get("_data_files")
    if listed is not None:
        return [f"{folder}/{x['filename']}" for x in listed]
    return sorted(x.path for x in store.get_file_info(fs.FileSelector(folder)) if x.type == fs.FileType.File and x.extension == "arrow")


def _field(data: bytes, table: int, number: int, kind: str) -> int:
    """A number in a table of a message's header; 0 where it is left out."""
    vtable = table - struct.unpack_from("<i", data, table)[0]
    size = struct.unpack_from("<H", data, vtable)[0]
    at = struct.unpack_from("<H", data, vtable + 4 + 2 * number)[0] if 4 + 2 * number < size else 0
    return struct.unpack_from(kind, data, table + at)[0] if at else 0


def messages(source: pa.NativeFile) -> Iterator[tuple[int, int, int]]:
    """(kind, offset, bytes) of the messages of an open file; bodies are skipped."""
    end = source.size()
    source.seek(0)
    at = len(_MAGIC) if source.read(len(_MAGIC)) == _MAGIC else 0
    while at + 8 <= end:
        source.seek(at)
        first, size = struct.unpack("<II", source.read(8))
        begins = at + 8
        if first != _CONTINUES:  # as older files have it
            first, size, begins = _CONTINUES, first, at + 4
            source.seek(begins)
        if not size:
            return
        header = source.read(size)
        root = struct.unpack_from("<I", header)[0]
        kind, body = _field(header, root, 1, "<B"), _field(header, root, 3, "<q")
        yield kind, at, begins + size + body - at
        at = begins + size + body


@dataclass
class Run(InputPartition):
    """Record batches of a file: at these offsets of a stream, or the first and one past the last of a file; all of it where it has dictionaries in between."""

    path: str
    offsets: tuple[int, ...] = ()
    first: int = 0
    last: int | None = None


def runs(path: str, most: int = BATCH_BYTES) -> list[Run]:
    """The partitions of a split's folder."""
    store, folder = _store(path)
    out = []
    for file in _files(store, folder):
        with store.open_input_file(file) as source:
            found = list(messages(source))
            source.seek(0)
            random_access = source.read(len(_MAGIC)) == _MAGIC
        batches = [(at, size) for kind, at, size in found if kind == _BATCH]
        if not random_access and any(kind == _DICTIONARY for kind, _, _ in found):
            out.append(Run(file))
            continue
        group, held = [], 0
        for number, (at, size) in enumerate(batches):
            if group and held + size > most:
                out.append(_run(file, group, random_access))
                group, held = [], 0
            group.append((number, at))
            held += size
        if group:
            out.append(_run(file, group, random_access))
    return out


def _run(file: str, group: list[tuple[int, int]], random_access: bool) -> Run:
    return Run(file, first=group[0][0], last=group[-1][0] + 1) if random_access else Run(file, tuple(at for _, at in group))


def _stored_schema(path: str) -> pa.Schema:
    store, folder = _store(path)
    files = _files(store, folder)
    if not files:
        raise FileNotFoundError(f"{path} has no Arrow file")
    with store.open_input_file(files[0]) as source:
        at = next(at for kind, at, _ in messages(source) if kind == _SCHEMA)
        source.seek(at)
        return pa.ipc.read_schema(pa.ipc.read_message(source))


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, most: int):
        self.path, self.schema, self.most = path, schema, most

    def partitions(self) -> list[Run]:
        return runs(self.path, self.most) or [Run("")]

    def read(self, run: Run) -> Iterator[pa.RecordBatch]:
        if not run.path:
            return
        wanted = to_arrow_schema(self.schema)
        store, _ = _store(self.path)
        with store.open_input_file(run.path) as source:
            for batch in self._batches(source, run, wanted.names):
                lost = [n for n in wanted.names if n not in batch.schema.names]
                if lost:
                    raise ValueError(f"{run.path} has no column {', '.join(lost)}")
                plain = pa.table({n: _plain(batch.column(n)) for n in wanted.names}) if wanted.names else pa.table({})
                yield from plain.cast(wanted).combine_chunks().to_batches()

    @staticmethod
    def _batches(source: pa.NativeFile, run: Run, names: list[str]) -> Iterator[pa.RecordBatch]:
        some = lambda schema: pa.ipc.IpcReadOptions(included_fields=[k for k, n in enumerate(schema.names) if n in names], use_threads=False)
        if run.last is not None:
            reader = pa.ipc.open_file(source, options=some(pa.ipc.open_file(source).schema))
            for k in range(run.first, run.last):
                yield reader.get_batch(k)
        elif not run.offsets:
            yield from pa.ipc.open_stream(source)
        else:
            at = next(at for kind, at, _ in messages(source) if kind == _SCHEMA)
            source.seek(at)
            schema = pa.ipc.read_schema(pa.ipc.read_message(source))
            for offset in run.offsets:
                source.seek(offset)
                yield pa.ipc.read_record_batch(pa.ipc.read_message(source), schema)


def _plain(column: pa.Array) -> pa.Array:
    return column.dictionary_decode() if pa.types.is_dictionary(column.type) else column


@dataclass
class _Written(WriterCommitMessage):
    task: int
    file: str | None


class _Writer(DataSourceArrowWriter):
    """A file for each task; those of tasks that count are named in the state file, so that a repeated task's are never read."""

    def __init__(self, path: str, schema: StructType, overwrite: bool):
        self.path, self.schema, self.overwrite = path, schema, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        from pyspark import TaskContext

        store, folder = _store(self.path)
        store.create_dir(folder)
        task, name = TaskContext.get().partitionId(), f"data-{uuid.uuid4().hex}.arrow"
        schema, out = to_arrow_schema(self.schema), None
        try:
            for batch in iterator:
                if out is None:
                    sink = store.open_output_stream(f"{folder}/{name}")
                    out = pa.ipc.new_stream(sink, schema)
                out.write_table(pa.Table.from_batches([batch]).cast(schema))
        finally:
            if out is not None:
                out.close()
                sink.close()
        return _Written(task, name if out is not None else None)

    def commit(self, messages: list[_Written | None]) -> None:
        store, folder = _store(self.path)
        store.create_dir(folder)
        new = [m.file for m in sorted((m for m in messages if m), key=lambda m: m.task) if m.file]
        state = _json(store, f"{folder}/{_STATE}") or {}
        old = [x["filename"] for x in state.get("_data_files", [])]
        kept = [] if self.overwrite else old
        if not kept and not new:  # an empty table keeps its schema
            new = [f"data-{uuid.uuid4().hex}.arrow"]
            with store.open_output_stream(f"{folder}/{new[0]}") as sink, pa.ipc.new_stream(sink, to_arrow_schema(self.schema)):
                pass
        with store.open_output_stream(f"{folder}/{_STATE}") as f:
            f.write(json.dumps(state | {"_data_files": [{"filename": x} for x in kept + new]}).encode())
        for name in set(old) - set(kept):
            store.delete_file(f"{folder}/{name}")

    def abort(self, messages: list[_Written | None]) -> None:
        store, folder = _store(self.path)
        for m in messages:
            if m and m.file:
                store.delete_file(f"{folder}/{m.file}")


class ArrowFiles(DataSource):
    """Options: path, split (not for writing), batchBytes."""

    @classmethod
    def name(cls) -> str:
        return "arrow_files"

    def _folder(self) -> str:
        return split_folder(self.options["path"], self.options.get("split"))

    def schema(self) -> StructType:
        stored = _stored_schema(self._folder())
        plain = pa.schema([pa.field(f.name, f.type.value_type if pa.types.is_dictionary(f.type) else f.type) for f in stored])
        return from_arrow_schema(plain)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self._folder(), schema, int(self.options.get("batchbytes", BATCH_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], schema, overwrite)


def arrow_dataset(spark: SparkSession, path: str, schema: str | StructType | None = None, split: str | None = None, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """A saved data set's rows: of the named split, else ``train``, else the first one.

    With a schema only its columns are decoded, in its order and types; else all columns are read as they are stored.
    """
    spark.dataSource.register(ArrowFiles)
    reader = spark.read.format("arrow_files").option("batchBytes", batch_bytes)
    reader = reader if split is None else reader.option("split", split)
    return (reader if schema is None else reader.schema(schema)).load(path)


def save_arrow_dataset(rows: DataFrame, path: str, split: str | None = None, mode: str = "overwrite") -> None:
    """Save rows as an Arrow data set, or as one split of it."""
    rows.sparkSession.dataSource.register(ArrowFiles)
    rows.write.format("arrow_files").mode(mode).save(path if split is None else f"{path.rstrip('/')}/{split}")
    if split is not None:
        store, root = _store(path.rstrip("/"))
        known = (_json(store, f"{root}/{_SPLITS}") or {}).get("splits", [])
        with store.open_output_stream(f"{root}/{_SPLITS}") as f:
            f.write(json.dumps({"splits": [*known, *([] if split in known else [split])]}).encode())
