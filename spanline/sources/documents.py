"""A sink that streams sorted rows into one document for each project."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import quote

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

NAME = "spanline-documents"
#: Bytes that are held before they are written.
BUFFER = 1 << 20


@dataclass
class Written(WriterCommitMessage):
    """Temporary files of a task, and where they belong."""

    moves: list[tuple[str, str]]


class DocumentWriter(DataSourceWriter):
    """Rows (project, value), sorted by project: values between ``head`` and ``tail``, parted by ``between``.

    A task writes below a folder of its own attempt; files move to their places when
    all tasks are done, so neither failed nor repeated tasks leave a trace.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.name = options["path"].rstrip("/"), options["name"]
        self.column, self.file, self.overwrite = options["column"], options["file"], overwrite
        self.head, self.between, self.tail = (options[c].encode() for c in ("head", "between", "tail"))

    def write(self, rows: Iterator) -> Written:
        store, base = fs.FileSystem.from_uri(self.path)
        own, moves, held, out = f"{base}/{self.name}/{uuid.uuid4().hex}", [], None, None
        buffer: list[bytes] = []

        def flush() -> None:
            out.write(b"".join(buffer))
            buffer.clear()

        def close() -> None:
            buffer.append(self.tail)
            flush()
            out.close()

        size = 0
        for project, value in rows:
            if out is None or project != held:
                if out is not None:
                    close()
                held = project
                folder = "__HIVE_DEFAULT_PARTITION__" if project is None else quote(str(project), safe=" ")
                final = f"{base}/{self.column}={folder}/{self.file}"
                if not moves:
                    store.create_dir(own)
                moves.append((f"{own}/{len(moves)}", final))
                out = store.open_output_stream(moves[-1][0])
                buffer.append(self.head)
            else:
                buffer.append(self.between)
            buffer.append((value or "").encode())
            size += len(buffer[-1])
            if size > BUFFER:
                flush()
                size = 0
        if out is not None:
            close()
        return Written(moves)

    def commit(self, messages: list[Written | None]) -> None:
        store, base = fs.FileSystem.from_uri(self.path)
        if self.overwrite and store.get_file_info(base).type == fs.FileType.Directory:
            for f in store.get_file_info(fs.FileSelector(base)):
                if f.base_name.startswith(f"{self.column}="):
                    store.delete_dir(f.path)
        moves = [m for x in messages if x for m in x.moves]

        def move(pair: tuple[str, str]) -> None:
            store.create_dir(pair[1].rsplit("/", 1)[0])
            store.move(*pair)

        with ThreadPoolExecutor(16) as pool:
            list(pool.map(move, moves))
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        """Drops what tasks have left in their own folders."""
        store, base = fs.FileSystem.from_uri(self.path)
        if store.get_file_info(f"{base}/{self.name}").type == fs.FileType.Directory:
            store.delete_dir(f"{base}/{self.name}")


class Documents(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(dict(self.options), overwrite)


def write_documents(rows: DataFrame, path: str, project: str, order: list[str], value: str, file: str, head: str = "", between: str = "", tail: str = "") -> None:
    """``path``/project=.../``file`` for each project: its values in order; no project is held in memory.

    A folder that was there loses its earlier projects.  Paths are opened by
    pyarrow, which must know their scheme.
    """
    rows.sparkSession.dataSource.register(Documents)
    one = rows.repartition(project).sortWithinPartitions(project, *order).selectExpr(f"cast(`{project}` as string) as project", f"`{value}` as value")
    options = {"name": f"_temporary-{uuid.uuid4().hex}", "column": project, "file": file, "head": head, "between": between, "tail": tail}
    one.write.format(NAME).options(**options).mode("overwrite").save(path)
