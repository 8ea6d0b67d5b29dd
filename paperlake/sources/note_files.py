"""Notes as files: a sink that publishes all notes of a job or none, and a reader that reads only their heads.

Executors write and read through ``pyarrow.fs``, so a vault can be in any store it knows (local or mounted folders, HDFS,
object stores). Neither the names of notes nor their contents go through the driver.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from paperlake.session import exists, names_in, remove
from paperlake.sources.files import front_matter

FORMAT = "paperlake_notes"
#: Bytes of a note that are read at a time until its front matter ends.
STEP = 4096


def _opened(path: str):
    """File system and path in it. Only scheme and host are read as a URI: names may hold characters that it cannot."""
    from pyarrow import fs

    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    scheme, rest = path.split("://", 1)
    host, _, name = rest.partition("/")
    files, root = fs.FileSystem.from_uri(f"{scheme}://{host}/")
    return files, f"{root.rstrip('/')}/{name}"


def _inside(relative: str) -> bool:
    parts = relative.split("/")
    return bool(relative) and not relative.startswith("/") and not any(p in ("", ".", "..") for p in parts)


@dataclass
class _Written(WriterCommitMessage):
    """What a task tells the driver: the name of the list of its notes, and how many there are."""

    manifest: str
    notes: int


class _NoteWriter(DataSourceWriter):
    """Tasks write below a staging folder beside the vault. The commit makes the staged notes the vault's, in one rename
    of a folder, or marks them as complete where they are to be added; an abort removes them."""

    def __init__(self, path: str, staging: str, replace: bool) -> None:
        self.path, self.staging, self.replace = path.rstrip("/"), staging.rstrip("/"), replace

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        files, root = _opened(self.staging)
        attempt, made, names = uuid.uuid4().hex, set(), []
        for row in iterator:
            if not _inside(row["relative_path"]):
                raise ValueError(f"not a path inside the vault: {row['relative_path']!r}")
            target = f"{root}/tree/{row['relative_path']}"
            # Folders are made one by one below the tree, so that nothing comes back once an abort has removed it.
            parts = row["relative_path"].split("/")[:-1]
            for folder in (f"{root}/tree/{'/'.join(parts[: k + 1])}" for k in range(len(parts))):
                if folder not in made:
                    files.create_dir(folder, recursive=False)
                    made.add(folder)
            # An attempt that is ended midway leaves a draft and never half a note.
            draft = f"{root}/draft/{attempt}"
            with files.open_output_stream(draft) as out:
                out.write(row["content"].encode("utf-8"))
            _move(files, draft, target)
            names.append(row["relative_path"])
        with files.open_output_stream(f"{root}/manifest/{attempt}") as out:
            out.write("".join(json.dumps(x) + "\n" for x in names).encode())
        return _Written(attempt, len(names))

    def commit(self, messages: list) -> None:
        files, root = _opened(self.staging)
        if not self.replace:
            with files.open_output_stream(f"{root}/committed") as out:
                out.write("".join(m.manifest + "\n" for m in messages if m is not None).encode())
            return
        _, vault = _opened(self.path)
        old = f"{root}/old"
        if _is_there(files, vault):
            files.move(vault, old)
        else:
            files.create_dir(vault.rsplit("/", 1)[0], recursive=True)
        files.move(f"{root}/tree", vault)
        files.delete_dir(root)

    def abort(self, messages: list) -> None:
        files, root = _opened(self.staging)
        for _ in range(10):
            if not _is_there(files, root):
                return
            try:
                files.delete_dir(root)
            except OSError:  # a task that has not heard of it yet has just written there
                time.sleep(0.2)


def _is_there(files, path: str) -> bool:
    from pyarrow import fs

    return files.get_file_info(path).type != fs.FileType.NotFound


def _move(files, source: str, target: str) -> None:
    try:
        files.move(source, target)
    except OSError:  # stores that do not rename over a file
        if not _is_there(files, target):
            raise
        files.delete_file(target)
        files.move(source, target)


class NoteFiles(DataSource):
    """Sink for rows (relative_path, content): one UTF-8 file each below ``path``. Options: ``path``, ``staging``.
    Mode ``overwrite`` replaces the vault, ``append`` leaves complete staged notes for :func:`publish`."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "relative_path string, content string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _NoteWriter(self.options["path"], self.options["staging"], overwrite)


def _stage_prefix(path: str) -> tuple[str, str]:
    parent, _, name = path.rstrip("/").rpartition("/")
    return parent, f".{name}.notes-"


def write_note_files(notes: DataFrame, path: str, replace: bool = True) -> None:
    """Write whole notes ``(relative_path, content)`` as files below ``path``, all of them or none.

    Tasks write beside the vault. If one fails for good nothing is published and nothing is left. When all are done,
    ``replace`` exchanges the whole vault for the new notes in one rename; without it, the notes are added to the vault,
    each over an older one of its name in one rename, as a Spark job that a later run takes up again if it is ended
    midway. A path that is absolute or leads out of the vault, and a null content, fail the job. ``path`` must be a
    folder that all executors reach, and one job at a time writes to it.
    """
    spark = notes.sparkSession
    publish(spark, path)
    parent, prefix = _stage_prefix(path)
    staging = f"{parent}/{prefix}{uuid.uuid4().hex}"
    files, root = _opened(staging)
    for folder in ("tree", "draft", "manifest"):
        files.create_dir(f"{root}/{folder}", recursive=True)
    spark.dataSource.register(NoteFiles)
    rows = notes.select(F.col("relative_path").cast("string"), F.col("content").cast("string"))
    rows.write.format(FORMAT).mode("overwrite" if replace else "append").options(path=path, staging=staging).save()
    if not replace:
        publish(spark, path)


def publish(spark: SparkSession, path: str) -> None:
    """Finish what earlier jobs have staged for the vault at ``path``: add complete sets of notes, put a vault back whose
    exchange was ended midway, and remove what no job has completed."""
    parent, prefix = _stage_prefix(path)
    for name in names_in(spark, parent):
        if not name.startswith(prefix):
            continue
        staging = f"{parent}/{name}"
        if exists(spark, f"{staging}/old") and not exists(spark, path):
            files, root = _opened(staging)
            files.move(f"{root}/tree" if _is_there(files, f"{root}/tree") else f"{root}/old", _opened(path)[1])
        elif exists(spark, f"{staging}/committed"):
            _add_staged(spark, staging, path)
        remove(spark, staging)


def _add_staged(spark: SparkSession, staging: str, path: str) -> None:
    done = spark.read.text(f"{staging}/committed").select(F.col("value").alias("_manifest"))
    file = F.element_at(F.split("_metadata.file_path", "/"), -1)
    lists = spark.read.text(f"{staging}/manifest").select("value", file.alias("_manifest"))
    names = lists.join(done, "_manifest", "left_semi").select("value")

    def move(rows: Iterator) -> None:
        files, root = _opened(staging)
        _, vault = _opened(path)
        made = set()
        for row in rows:
            name = json.loads(row["value"])
            folder = f"{vault}/{name}".rsplit("/", 1)[0]
            if folder not in made:
                files.create_dir(folder, recursive=True)
                made.add(folder)
            if _is_there(files, f"{root}/tree/{name}"):  # not there: an earlier try has moved it
                _move(files, f"{root}/tree/{name}", f"{vault}/{name}")

    names.foreachPartition(move)


def head_of(stream) -> bytes:
    """The start of a note up to the end of its front matter, read in steps; little of a note that has none."""
    head = stream.read(STEP)
    while head.startswith(b"---") and b"---" not in head[3:]:
        more = stream.read(STEP)
        if not more:
            break
        head += more
    if not head.startswith(b"---"):
        return b""
    end = head.find(b"---", 3)
    return head[: end + 3] if end >= 0 else head


def _hidden(name: str) -> bool:
    """Names that Spark leaves out where it reads files."""
    return (name.startswith("_") and "=" not in name) or name.startswith(".") or name.endswith("._COPYING_")


def _listing(path: str, deep: bool):
    """For rows (name, folder), names below ``path``: what is in the folders, at any depth with ``deep``, and the rest as
    it is."""
    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, root = _opened(path)
        root = root.rstrip("/")

        def found() -> Iterator[tuple[str, bool]]:
            for batch in batches:
                todo = list(zip(batch.column("name").to_pylist(), batch.column("folder").to_pylist(), strict=True))
                while todo:
                    name, folder = todo.pop()
                    if not folder:
                        yield name, False
                        continue
                    for info in files.get_file_info(fs.FileSelector(f"{root}/{name}".rstrip("/"))):
                        below, inner = f"{name}/{info.base_name}".lstrip("/"), info.type == fs.FileType.Directory
                        # As where Spark reads files, empty ones are none.
                        if _hidden(info.base_name) or not (inner or (below.endswith(".md") and info.size)):
                            continue
                        if inner and deep:
                            todo.append((below, True))
                        else:
                            yield below, inner

        rows = found()
        while some := list(islice(rows, 10_000)):
            names, folders = zip(*some, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(folders, pa.bool_())], ["name", "folder"])

    return entries


def _heads(path: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _opened(path)
        for batch in batches:
            heads = []
            for name in batch.column("name").to_pylist():
                with files.open_input_stream(f"{root.rstrip('/')}/{name}") as stream:
                    heads.append(head_of(stream).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(heads, pa.string())], ["relative_path", "head"])

    return read


def read_note_heads(spark: SparkSession, path: str) -> DataFrame:
    """Markdown notes below ``path``, outside dot folders: ``(relative_path, front_matter)``, as ``files.read_notes``.

    Tasks list the folders and read each note only as far as its front matter goes: what is read does not grow with the
    notes' bodies. One task lists ``path`` itself; the folders in it are dealt to tasks, and so are the notes then found,
    however many a folder has. A task has many notes: a job of Spark's own for so small files has tasks of a few.
    """
    tasks, entries = int(spark.conf.get("spark.sql.shuffle.partitions")), "name string, folder boolean"
    top = spark.range(0, 1, 1, 1).select(F.lit("").alias("name"), F.lit(True).alias("folder")).mapInArrow(_listing(path, False), entries)
    below = top.repartition(tasks, "name").mapInArrow(_listing(path, True), entries)
    heads = below.select("name").repartition(tasks, "name").mapInArrow(_heads(path), "relative_path string, head string")
    return heads.select("relative_path", front_matter(F.col("head")).alias("front_matter"))
