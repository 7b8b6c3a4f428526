"""Small binary files in the shared folder, written and read by executors through its URI."""

from __future__ import annotations

import uuid

from pyarrow import fs


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def make_folder(uri: str) -> None:
    system, path = _open(uri)
    system.create_dir(path, recursive=True)


def put(folder: str, name: str, data: bytes) -> None:
    """Writes under another name first: a repeated attempt replaces the file with the same bytes at once."""
    system, path = _open(folder)
    own = f"{path}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(own, compression=None) as f:
        f.write(data)
    system.move(own, f"{path}/{name}")


def get(folder: str, name: str) -> bytes:
    system, path = _open(folder)
    with system.open_input_file(f"{path}/{name}") as f:
        return f.read()
