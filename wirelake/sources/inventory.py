"""File listings: photo lookup, document selection, unprocessed files."""
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import cut, spread
from ..vocabulary import DOCUMENT_SUFFIXES, IMAGE_SUFFIXES
from .keyed_files import file_system

_ENTRY = pa.schema([("path", pa.string()), ("length", pa.int64()), ("folder", pa.bool_())])
#: entries that travel together
_BATCH = 10_000


def _entries(folder: str) -> Iterator[tuple[str, int, bool]]:
    """What lies in one folder: name, length, whether it is a folder. A local folder is read as a stream, of another one all entries come at once."""
    from pyarrow import fs as A
    fs, at = file_system(folder)
    if isinstance(fs, A.LocalFileSystem):
        with os.scandir(at) as found:
            for e in found:
                yield (e.name, 0, True) if e.is_dir() else (e.name, e.stat().st_size, False)
    else:
        for e in fs.get_file_info(A.FileSelector(at)):
            yield e.base_name, e.size or 0, e.type == A.FileType.Directory


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for b in batches:
        for folder in b.column("path").to_pylist():
            for name, length, is_folder in _entries(folder):
                if not name.startswith(("_", ".")):
                    rows.append({"path": f"{folder.rstrip('/')}/{name}", "length": length, "folder": is_folder})
                if len(rows) == _BATCH:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ENTRY)
                    rows = []
    yield pa.RecordBatch.from_pylist(rows, schema=_ENTRY)


def list_files(spark: SparkSession, path: str, empty: bool = False) -> DataFrame:
    """Paths and sizes of all files below the folder `path`; none is opened. Names that begin with an underscore or a dot are left out, and like Spark's readers, empty
    files, unless `empty` asks for them.

    Tasks list the folders, one level after the other, and write what they find; no name reaches the driver (Spark's own readers keep the status of every file there).
    A folder is listed by one task."""
    folders, files = spark.createDataFrame([(path,)], "path string"), None
    while True:
        found = cut(spread(folders).mapInArrow(_list, "path string, length long, folder boolean"))
        here = found.filter("NOT folder" if empty else "NOT folder AND length > 0").select("path", "length")
        files = here if files is None else files.unionByName(here)
        folders = found.filter("folder").select("path")
        if folders.isEmpty():
            return files


def below(files: DataFrame, root: str) -> DataFrame:
    """Listed files with paths relative to root."""
    return files.withColumn("path", F.substring_index("path", root.rstrip("/") + "/", -1))


def parts(files: DataFrame) -> DataFrame:
    """Adds drafter, folder, stem and suffix of relative paths drafter/folder/stem.suffix."""
    p = F.split("path", "/")
    name = F.element_at(p, -1)
    return files.select("path", "length", F.get(p, F.lit(0)).alias("drafter"), F.get(p, F.size(p) - 2).alias("folder"),
                        F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.regexp_extract(name, r"(\.[^.]*)$", 1).alias("suffix"),
                        F.size(p).alias("depth"))


def photos(files: DataFrame) -> DataFrame:
    """One photo per (drafter, stem): jpg before jpeg before png, lower case before upper case."""
    order = [s for x in IMAGE_SUFFIXES for s in (x, x.upper())]
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("suffix"))
    d = parts(files).filter((F.col("folder") == "images") & (rank > 0))
    return d.groupBy("drafter", "stem").agg(F.min_by("path", rank).alias("path"), F.count("*").alias("candidates"))


def dataset_documents(files: DataFrame, max_bytes: int = 2_000_000, max_depth: int = 3) -> DataFrame:
    d = parts(files)
    return d.filter(F.lower("suffix").isin(*DOCUMENT_SUFFIXES) & (F.col("length") <= max_bytes)
                    & (F.col("depth") <= max_depth) & ~F.col("drafter").startswith("drafter_")).select("path", "length")


def unprocessed(files: DataFrame, done: DataFrame) -> DataFrame:
    return files.join(done, "path", "left_anti")
