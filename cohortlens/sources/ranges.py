"""Parts of files in any store that Arrow opens."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
import pyarrow.fs

from cohortlens.errors import DatasetError


def opened(path: str) -> pa.NativeFile:
    """A file that can be read from any place on."""
    try:
        # Hadoop writes local URIs with one slash, Arrow with three
        uri = re.sub(r"^file:/+", "file:///", path)
        store, inner = pyarrow.fs.FileSystem.from_uri(uri) if re.match(r"[a-z0-9+]+:/", uri) else (pyarrow.fs.LocalFileSystem(), path)
        return store.open_input_file(inner)
    except (OSError, pa.ArrowException) as e:
        raise DatasetError(f"{path} can't be read: {e}") from e


def ranges(path: str) -> Callable[[int, int], bytes]:
    """(offset, size) -> bytes of a file."""
    file = opened(path)

    def read(offset: int, size: int) -> bytes:
        return file.read_at(size, offset) if offset < file.size() else b""

    return read
