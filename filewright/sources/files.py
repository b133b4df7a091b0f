"""Files where they lie: a listing as a data source, and the first characters of texts.

Both run in tasks over any file system that Arrow can open, and keep the scheme of the folder they were given.
"""

from __future__ import annotations

import codecs
import io
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LISTING = "path string, size_bytes long, modified_at timestamp"
CHUNK = 1 << 15  # bytes read at once


def opened(folder: str):
    """(file system, its path of the folder, what stands before a path for it to be found from anywhere)."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    at = folder.rstrip("/").rfind(path.rstrip("/")) if path.rstrip("/") else -1
    before = "" if isinstance(system, fs.LocalFileSystem) or at < 0 else folder[:at]
    return system, path.rstrip("/") or "/", before


class FolderPart(InputPartition):
    """One folder: its own files, or those of the whole tree below it."""

    def __init__(self, path: str, deep: bool) -> None:
        super().__init__(path)
        self.path, self.deep = path, deep


class FolderReader(DataSourceReader):
    def __init__(self, folder: str, recursive: bool) -> None:
        self.folder, self.recursive = folder, recursive

    def partitions(self) -> list[InputPartition]:
        """The folder itself and, if subfolders count, each folder right below it, to be walked by a task of its own."""
        from pyarrow import fs

        system, path, _ = opened(self.folder)
        parts: list[InputPartition] = [FolderPart(path, False)]
        if self.recursive:
            found = system.get_file_info(fs.FileSelector(path, recursive=False))
            parts += [FolderPart(f.path, True) for f in found if f.type == fs.FileType.Directory]
        return parts

    def read(self, part: FolderPart) -> Iterator[tuple]:
        from pyarrow import fs

        system, _, before = opened(self.folder)
        left = [part.path]
        while left:
            for f in system.get_file_info(fs.FileSelector(left.pop(), recursive=False)):
                if f.type == fs.FileType.File:
                    yield before + f.path, f.size, f.mtime
                elif f.type == fs.FileType.Directory and part.deep:
                    left.append(f.path)


class FolderListing(DataSource):
    """Regular files of a folder, hidden ones and ones whose names begin with an underscore included. Options: ``path``, ``recursive``."""

    @classmethod
    def name(cls) -> str:
        return "folder_listing"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> DataSourceReader:
        return FolderReader(self.options["path"], self.options.get("recursive", "false").lower() == "true")


def list_files(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """Paths, sizes and times of the files in a folder, one task for each folder right below it."""
    spark.dataSource.register(FolderListing)
    return spark.read.format("folder_listing").option("recursive", str(recursive).lower()).load(folder)


def first_text(stream, chars: int | None, translate: bool) -> str:
    """The first ``chars`` characters of UTF-8 bytes, all for None: bytes that are no UTF-8 are dropped, real replacement
    characters stay, a character that a read cuts in two is put together again, newlines become one character."""
    decoder = codecs.getincrementaldecoder("utf-8")("ignore")
    if translate:
        decoder = io.IncrementalNewlineDecoder(decoder, translate=True)
    parts, held = [], 0
    while chars is None or held < chars:
        data = stream.read(CHUNK)
        parts.append(decoder.decode(data, final=not data))
        held += len(parts[-1])
        if not data:
            break
    return "".join(parts)[:chars]


def read_text(spark: SparkSession, folder: str, recursive: bool = False, chars: int | None = None) -> DataFrame:
    """``path size_bytes text``: each file's first ``chars`` characters, and no more of it read than they take, in steps of
    ``CHUNK`` bytes. CSV texts keep their line breaks as they are."""

    def run(batches):
        import pyarrow as pa

        systems: dict[str, tuple] = {}
        for batch in batches:
            # A row at a time, so that a batch of long texts is never held.
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                scheme = path.split("://", 1)[0] if "://" in path else ""
                if scheme not in systems:
                    systems[scheme] = opened(path if scheme else "/")
                system, _, _ = systems[scheme]
                own = opened(path)[1] if scheme else path
                with system.open_input_stream(own) as stream:
                    text = first_text(stream, chars, not path.lower().endswith(".csv"))
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64()), pa.array([text])], ["path", "size_bytes", "text"])

    listed = list_files(spark, folder, recursive).select("path", "size_bytes")
    return listed.mapInArrow(run, "path string, size_bytes long, text string")


def write_texts(files: DataFrame, folder: str) -> DataFrame:
    """Write ``text`` of each row as the file ``name`` below a folder; (name, size_bytes) of what was written. A task that is
    run again writes the same files."""

    def run(batches):
        import pyarrow as pa

        system, path, _ = opened(folder)
        for batch in batches:
            names, sizes = batch.column(0).to_pylist(), []
            for name, text in zip(names, batch.column(1).to_pylist()):
                data = (text or "").encode()
                if "/" in name:
                    system.create_dir(f"{path}/{name.rsplit('/', 1)[0]}", recursive=True)
                with system.open_output_stream(f"{path}/{name}") as out:
                    out.write(data)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(sizes, pa.int64())], ["name", "size_bytes"])

    system, path, _ = opened(folder)
    system.create_dir(path, recursive=True)
    return files.select("name", "text").mapInArrow(run, "name string, size_bytes long")
