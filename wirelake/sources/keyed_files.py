"""A sink for formats that want one file per key, such as label files or netlists: rows (path, text) become files of that name below a folder.

    keyed_files.write(docs.select(path, "text"), folder)

It is a Spark data source. A task stages its files beside the output, each closed before the next is begun, and moves them to their names once all of
them are whole; the driver writes _SUCCESS after all tasks. So no reader meets half a file, a task that is tried again replaces its files by
equal ones, and nothing is listed or moved file by file on the driver. Readers skip what begins with an underscore."""
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FORMAT = "keyed_files"
STAGING, DONE = "_staging", "_SUCCESS"


def file_system(folder: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


@dataclass
class _Written(WriterCommitMessage):
    files: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder, self.job = folder, uuid.uuid4().hex

    def _root(self):
        return file_system(self.folder)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        fs, root = self._root()
        stage, names, made = f"{root}/{STAGING}/{self.job}/{uuid.uuid4().hex}", set(), set()

        def folder_of(path: str) -> None:
            d = path.rsplit("/", 1)[0]
            if d not in made:
                fs.create_dir(d, recursive=True)
                made.add(d)
        for batch in iterator:
            for name, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if name is None or any(p in ("", ".", "..") or p.startswith("_") for p in name.split("/")):
                    raise ValueError(f"no name for a file: {name!r}")
                folder_of(f"{stage}/{name}")
                with fs.open_output_stream(f"{stage}/{name}") as out:
                    out.write((text or "").encode())
                names.add(name)
        for name in sorted(names):
            folder_of(f"{root}/{name}")
            fs.move(f"{stage}/{name}", f"{root}/{name}")
        if names:
            fs.delete_dir(stage)
        return _Written(len(names))

    def commit(self, messages: list[_Written | None]) -> None:
        fs, root = self._root()
        self._clean()
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{DONE}") as out:
            out.write(f"{sum(m.files for m in messages if m)}\n".encode())

    def abort(self, messages: list[_Written | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        from pyarrow.fs import FileType
        fs, root = self._root()
        if fs.get_file_info(f"{root}/{STAGING}/{self.job}").type != FileType.NotFound:
            fs.delete_dir(f"{root}/{STAGING}/{self.job}")


class KeyedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "path string, text string"

    def writer(self, schema, overwrite: bool) -> _Writer:
        if overwrite:
            raise ValueError("files are added to a folder, or replaced by ones of the same name; use mode append")
        return _Writer(self.options["path"])


def write(docs: DataFrame, folder: str) -> None:
    """docs(path, text): one row for each file, path relative to the folder. Null texts are empty files (which Spark's readers don't list); of several rows with one path the last written stays."""
    spark = docs.sparkSession
    spark.dataSource.register(KeyedFiles)
    docs.select(F.col("path").cast("string"), F.col("text").cast("string")).write.format(FORMAT).mode("append").save(folder)
