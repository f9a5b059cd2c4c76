"""Binary files in the shared folder, written and read by tasks.

A file gets a name of its own for each attempt and is known only by the row that the attempt returned, so an attempt
that died leaves at most an unused file. Folders are URIs that pyarrow's file systems or a local mount can open.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import BinaryIO

from pyarrow import fs


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")


def make_folder(folder: str) -> str:
    system, path = _at(folder)
    system.create_dir(path, recursive=True)
    return folder


@contextmanager
def writing(folder: str) -> Iterator[tuple[str, BinaryIO]]:
    """(path, open file) of a new file."""
    path = f"{folder}/{uuid.uuid4().hex}.bin"
    system, own = _at(path)
    with system.open_output_stream(own) as out:
        yield path, out


def write(folder: str, parts: list[bytes]) -> str:
    """The path of a new file with these parts."""
    with writing(folder) as (path, out):
        for part in parts:
            out.write(part)
    return path


def read(path: str, start: int = 0, size: int | None = None) -> bytes:
    system, own = _at(path)
    with system.open_input_file(own) as file:
        return file.read_at(file.size() - start if size is None else size, start)


def size(path: str) -> int:
    system, own = _at(path)
    return system.get_file_info(own).size


def put(path: str, data: bytes) -> None:
    """A small file under a fixed name, replaced as a whole."""
    make_folder(path.rsplit("/", 1)[0])
    new = f"{path}.{uuid.uuid4().hex}"
    system, own = _at(new)
    with system.open_output_stream(own) as out:
        out.write(data)
    system.move(own, _at(path)[1])


def get(path: str) -> bytes | None:
    """What put() wrote, or None."""
    system, own = _at(path)
    return read(path) if system.get_file_info(own).type == fs.FileType.File else None
