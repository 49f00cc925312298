"""Scripts as files: a data source that writes one file for each row, all of them or none."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

SCRIPT = "path string, text string"
#: Files that the driver moves at a time.
MOVERS = 16


@dataclass
class Staged(WriterCommitMessage):
    """What a task has written: its folder, and the paths of the files in it."""

    folder: str
    paths: list[str]


def _checked(path: str | None) -> str:
    parts = (path or "").replace("\\", "/").split("/")
    if not path or any(p in ("", ".", "..") for p in parts) or ":" in parts[0]:
        raise ValueError(f"not a path below the target folder: {path!r}")
    return "/".join(parts)


class ScriptWriter(DataSourceWriter):
    """Each attempt of a task writes into a staging folder of its own; the driver moves the files of the attempts that
    count once all tasks have ended, so a lost executor or a second attempt leaves nothing behind."""

    def __init__(self, root: str, replace: bool):
        self.root, self.replace = root.rstrip("/"), replace
        self.staging = f"{self.root}/_staging-{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> Staged:
        store, folder = fs.FileSystem.from_uri(f"{self.staging}/{uuid.uuid4().hex}")
        paths = []
        for row in rows:
            if row.text is None:
                continue
            paths.append(_checked(row.path))
            store.create_dir(f"{folder}/{paths[-1]}".rpartition("/")[0], recursive=True)
            with store.open_output_stream(f"{folder}/{paths[-1]}") as out:
                out.write(row.text.encode())
        return Staged(folder, paths)

    def commit(self, messages: list[Staged | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.root)
        moves = [(f"{m.folder}/{p}", f"{root}/{p}") for m in messages if m for p in m.paths]
        targets = {b for _, b in moves}
        if len(targets) < len(moves):
            raise ValueError("two rows have the same path")
        with ThreadPoolExecutor(MOVERS) as pool:
            if not self.replace:
                there = [i.path for found in pool.map(lambda b: store.get_file_info([b]), targets) for i in found if i.type != fs.FileType.NotFound]
                if there:
                    raise FileExistsError(sorted(there)[0])
            for folder in {b.rpartition("/")[0] for b in targets}:
                store.create_dir(folder, recursive=True)
            list(pool.map(lambda m: store.move(*m), moves))
        self._clear()

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, folder = fs.FileSystem.from_uri(self.staging)
        if store.get_file_info([folder])[0].type != fs.FileType.NotFound:
            store.delete_dir(folder)


class ScriptFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "script_files"

    def schema(self) -> str:
        return SCRIPT

    def writer(self, schema: StructType, overwrite: bool) -> ScriptWriter:
        return ScriptWriter(self.options["path"], overwrite)


def write_scripts(scripts: DataFrame, root: str, replace: bool = False) -> None:
    """A file below root, a folder that driver and executors share, for each row (path, text); a null text has none.

    Files that are there are replaced only if asked to; else nothing is written, and neither is it if two rows
    have one path or a path leaves the folder. Other files stay.
    """
    scripts.sparkSession.dataSource.register(ScriptFiles)
    rows = scripts.select(F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    rows.write.format("script_files").mode("overwrite" if replace else "append").save(root)
