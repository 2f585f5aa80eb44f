"""Files of the operators' own formats, in any store that Arrow can open, below the shared folder."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs


def place(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path and path.startswith("file:"):
        path = path.removeprefix("file:")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@contextmanager
def new_file(folder: str, name: str, suffix: str):
    """A file of a name that no other attempt at the task uses. Yields its stream and path; files of failed attempts are in no manifest and so are never read."""
    path = f"{folder}/{name}-{uuid.uuid4().hex}{suffix}"
    store, inner = place(path)
    store.create_dir(inner.rpartition("/")[0], recursive=True)
    with store.open_output_stream(inner, compression=None) as out:
        yield out, path


def open_file(path: str):
    store, inner = place(path)
    return store.open_input_file(inner)


def remove(path: str) -> None:
    """Removes a folder and all that is in it; nothing happens if there is none."""
    store, inner = place(path)
    if store.get_file_info(inner).type != fs.FileType.NotFound:
        store.delete_dir(inner)
