"""Files of a local or mounted file system, or of a store that pyarrow knows by its URI, as tasks see them: ranges and folders."""

from __future__ import annotations

import os
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import pyarrow.fs


def stored_at(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system and path of a URI, or of a plain path."""
    if "://" in uri or uri.startswith("file:"):
        return pyarrow.fs.FileSystem.from_uri(uri)
    return pyarrow.fs.LocalFileSystem(), uri


def below(uri: str, name: str) -> str:
    """Where a file of a folder is."""
    if "://" in uri and not uri.startswith("file:"):
        return f"{uri.rstrip('/')}/{name}"
    path = unquote(urlsplit(uri).path) if uri.startswith("file:") else uri
    return f"{path.rstrip('/')}/{name}"


class Part:
    """A range of a file that reads like a file."""

    def __init__(self, file, base: int, size: int):
        self.file, self.base, self.size, self.at = file, base, size, 0

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, to: int, whence: int = 0) -> int:
        to += (0, self.at, self.size)[whence]
        if to < 0:
            raise OSError("a place before the start")
        self.at = to
        return to

    def read(self, n: int | None = -1) -> bytes:
        left = max(0, self.size - self.at)
        n = left if n is None or n < 0 else min(n, left)
        self.file.seek(self.base + self.at)
        data = self.file.read(n)
        self.at += len(data)
        return data

    def close(self) -> None:
        self.file.close()


def opened(uri: str) -> Part:
    fs, path = stored_at(uri)
    file = fs.open_input_file(path)
    return Part(file, 0, file.size())


def put(uri: str, data: bytes) -> None:
    """Writes a file and the folders above it; a repeated task writes the same."""
    fs, path = stored_at(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    with fs.open_output_stream(path) as out:
        out.write(data)


def put_folder(uri: str) -> None:
    fs, path = stored_at(uri)
    fs.create_dir(path, recursive=True)


def remove_folder(uri: str) -> None:
    """Removes a folder and all below it; a repeated task may find it gone."""
    fs, path = stored_at(uri)
    try:
        fs.delete_dir(path)
    except FileNotFoundError:
        pass


def children(uri: str) -> Iterator[tuple[str, bool, int]]:
    """(name, is a folder, size) of what a folder holds. A link to a folder is none, so walks end."""
    fs, path = stored_at(uri)
    if isinstance(fs, pyarrow.fs.LocalFileSystem):
        with os.scandir(path) as found:
            for x in found:
                folder = x.is_dir(follow_symlinks=False)
                yield x.name, folder, 0 if folder else x.stat(follow_symlinks=False).st_size
    else:
        for x in fs.get_file_info(pyarrow.fs.FileSelector(path)):
            yield x.base_name, x.type == pyarrow.fs.FileType.Directory, x.size or 0
