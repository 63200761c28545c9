"""Files one by one, from tasks: where Spark's own readers and writers deal in folders of parts.

Tasks run in Python and reach a file system through pyarrow, which knows local and mounted paths,
HDFS, S3, GCS and Azure by their URIs.
"""

from __future__ import annotations

import io
import posixpath
import re
import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from quern.sources import sinks

#: Renames that are under way together when a write is committed, and places that are held for them.
RENAMES_AT_ONCE, PLACES_AT_ONCE = 16, 10_000
#: Rows of a listing, and bytes of bodies, that a task hands on together.
LISTED_AT_ONCE, READ_BYTES = 10_000, 8 << 20


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI, as Hadoop writes it, and the path inside it. A path without scheme is local."""
    uri = re.sub(r"^s3[an]:", "s3:", uri)
    uri = re.sub(r"^file:/+", "file:///", uri)
    return fs.FileSystem.from_uri(uri if re.match(r"^[a-z][a-z0-9+.-]*:", uri) else f"file://{posixpath.abspath(uri) if not uri.startswith('/') else uri}")


@dataclass
class _Staged(WriterCommitMessage):
    """Where a task has left its files and the list of their places."""

    folder: str


class _TreeWriter(DataSourceArrowWriter):
    """Two steps, as Spark's own committers have: tasks write their files into staging folders of their own, each with a list of the places they belong in; when all tasks have ended well the files are moved there, each by one rename.

    A file is there whole or not at all, and a job that fails places none. A task that is run again or
    twice at once has another folder, and only one of them is committed. Task messages name
    folders, not files.
    """

    def __init__(self, root: str) -> None:
        self.root, self.staging = root.rstrip("/"), f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Staged:
        system, root = located(self.root)
        own, n = f"{self.staging}/{uuid.uuid4().hex}", 0
        system.create_dir(f"{root}/{own}")
        with system.open_output_stream(f"{root}/{own}/places") as places:
            for batch in iterator:
                for path, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    inside = posixpath.normpath(path or "")
                    if inside in (".", "..") or inside.startswith(("/", "../")) or "\n" in inside:
                        raise ValueError(f"not a path inside the tree: {path!r}")
                    with system.open_output_stream(f"{root}/{own}/{n}") as out:
                        out.write(body if isinstance(body, bytes) else (body or "").encode())
                    places.write(f"{inside}\n".encode())
                    n += 1
        return _Staged(own)

    def commit(self, messages: list) -> None:
        system, root = located(self.root)
        with ThreadPoolExecutor(RENAMES_AT_ONCE) as pool:
            for message in messages:
                own = f"{root}/{message.folder}"
                with system.open_input_stream(f"{own}/places") as f:
                    numbered = enumerate(line.decode().removesuffix("\n") for line in io.BufferedReader(f))
                    while places := list(islice(numbered, PLACES_AT_ONCE)):
                        list(pool.map(lambda folder: system.create_dir(f"{root}/{folder}"), {posixpath.dirname(p) for _, p in places}))
                        list(pool.map(lambda job: system.move(f"{own}/{job[0]}", f"{root}/{job[1]}"), places))  # noqa: B023
        self._clean()

    def _clean(self) -> None:
        """Staging folders go. A task that is being stopped may still write into one, so this tries a few times; what it can't remove begins with an underscore, which Spark's readers pass over."""
        system, root = located(self.root)
        for wait in (0.0, 0.2, 1.0, 3.0):
            time.sleep(wait)
            try:
                if system.get_file_info(f"{root}/{self.staging}").type == fs.FileType.Directory:
                    system.delete_dir(f"{root}/{self.staging}")
                return
            except OSError:
                continue

    def abort(self, messages: list) -> None:
        self._clean()


class FileTree(DataSource):
    """format("filetree"): rows (path, body) as files under option path. Append mode."""

    @classmethod
    def name(cls) -> str:
        return "filetree"

    def writer(self, schema: StructType, overwrite: bool) -> _TreeWriter:
        if schema.fieldNames() != ["path", "body"]:
            raise ValueError("a file tree is written from columns path and body")
        if overwrite:
            raise ValueError("a file tree is appended to: equal paths are replaced")
        return _TreeWriter(self.options["path"])


def put_files(rows: DataFrame, root: str) -> None:
    """Writes each row's body (text or bytes; null: empty) to the file root/path, from the tasks that have the rows. Equal paths in one write must have equal bodies."""
    rows.sparkSession.dataSource.register(FileTree)
    body = F.col("body") if dict(rows.dtypes)["body"] == "binary" else F.col("body").cast("string")
    rows.select(F.col("path").cast("string").alias("path"), body.alias("body")).write.format("filetree").mode("append").option("path", root).save()


def listed(spark: SparkSession, root: str, deep: bool = True) -> DataFrame:
    """path, inside (the path from root on) of every file under root, in folders of any depth or, unless deep, in root alone; names that begin with a dot or underscore are passed over, as by Spark's readers. A root that is a file is that file.

    Folders are listed by tasks, one level of the tree after another, and what they find stays in a table
    in the shared folder: the driver sees no names, however many files there are.
    """
    base, n = root.rstrip("/"), max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = located(base)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                top = system.get_file_info(f"{inner}/{folder}" if folder else inner)
                found = iter([top] if top.type == fs.FileType.File else system.get_file_info(fs.FileSelector(top.path)))
                while some := list(islice(found, LISTED_AT_ONCE)):
                    some = [x for x in some if not x.base_name.startswith(("_", "."))]
                    inside = ["" if x.path == inner else f"{folder}/{x.base_name}" if folder else x.base_name for x in some]
                    yield pa.RecordBatch.from_arrays([pa.array(inside, pa.string()), pa.array([x.type == fs.FileType.Directory for x in some], pa.bool_())], ["inside", "folder"])

    folders, levels = spark.createDataFrame([("",)], "inside string"), []
    while not levels or deep and not folders.isEmpty():
        found = sinks.settled((folders.repartition(n) if levels else folders.coalesce(1)).mapInArrow(entries, "inside string, folder boolean"), "listed")
        levels.append(found.where("not folder").select("inside"))
        folders = found.where("folder").select("inside")
    path = F.when(F.col("inside") == "", F.lit(base)).otherwise(F.concat(F.lit(f"{base}/"), F.col("inside")))
    return reduce(DataFrame.unionAll, levels).select(path.alias("path"), "inside")


def bodies(files: DataFrame) -> DataFrame:
    """path, inside and value, the whole text, of files that were listed, read by tasks that share them evenly."""
    spark = files.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner, base = None, "", ""

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.string(), pa.binary()))], ["path", "inside", "value"])

        for batch in batches:
            rows, held = [], 0
            for path, inside in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if system is None or path[: len(base)] != base:
                    base = path.removesuffix(inside)
                    system, inner = located(base or path)
                with system.open_input_stream(f"{inner.rstrip('/')}/{inside}" if inside else inner) as f:
                    rows.append((path, inside, f.read()))
                held += len(rows[-1][2])
                if held >= READ_BYTES:
                    yield table(rows)
                    rows, held = [], 0
            if rows:
                yield table(rows)

    out = files.select("path", "inside").repartition(n).mapInArrow(read, "path string, inside string, value binary")
    return out.select("path", "inside", F.col("value").cast("string").alias("value"))
