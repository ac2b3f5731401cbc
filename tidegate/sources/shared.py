"""Small files on storage that driver and tasks share, through pyarrow, which must know it."""

from __future__ import annotations

import os
import re
import uuid


def storage(path: str):
    """(file system, path) of a path or URI; a plain path is one of this machine, or of a folder that all machines share."""
    import pyarrow.fs as fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path if re.match(r"^[a-z][a-z0-9+.-]*:", path) else f"file://{os.path.abspath(path)}"))


def read_bytes(path: str) -> bytes | None:
    files, at = storage(path)
    try:
        with files.open_input_stream(at, compression=None) as f:
            return f.read()
    except FileNotFoundError:
        return None


def put_whole(path: str, data: bytes) -> None:
    """Writes beside the path and moves there, so that no reader finds half of it."""
    files, at = storage(path)
    files.create_dir(at.rsplit("/", 1)[0], recursive=True)
    staged = f"{at}.{uuid.uuid4().hex}"
    with files.open_output_stream(staged, compression=None) as f:
        f.write(data)
    files.move(staged, at)
