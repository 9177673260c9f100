"""Files of a folder that driver and executors share, by local path or through pyarrow's file systems."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator
from contextlib import suppress
from typing import BinaryIO
from urllib.parse import unquote, urlparse


class Store:
    """A folder; names are relative to it.  Writes appear whole: a file is written under a hidden name and renamed."""

    def __init__(self, uri: str):
        u = urlparse(uri)
        self.fs = None
        if u.scheme in ("", "file"):
            self.top = unquote(u.path) if u.scheme else uri
        else:
            from pyarrow import fs

            self.fs, self.top = fs.FileSystem.from_uri(uri)

    def path(self, name: str = "") -> str:
        return f"{self.top.rstrip('/')}/{name}" if name else self.top

    def entries(self, name: str = "") -> list[tuple[str, bool]]:
        """(name, whether it is a folder) of what is not hidden (_ or . first), by name; none of a folder that is not there."""
        if self.fs is None:
            try:
                with os.scandir(self.path(name)) as found:
                    out = [(e.name, e.is_dir()) for e in found]
            except FileNotFoundError:
                return []
        else:
            from pyarrow import fs

            out = [(f.base_name, f.type == fs.FileType.Directory) for f in self.fs.get_file_info(fs.FileSelector(self.path(name), allow_not_found=True))]
        return sorted(e for e in out if e[0][0] not in "._")

    def files(self, name: str = "") -> Iterator[str]:
        """Names of a folder's files that are not hidden, one by one, as the folder has them."""
        if self.fs is not None:
            yield from (n for n, is_dir in self.entries(name) if not is_dir)
            return
        with suppress(FileNotFoundError), os.scandir(self.path(name)) as found:
            for e in found:
                if e.name[0] not in "._" and not e.is_dir():
                    yield e.name

    def size(self, name: str = "") -> int:
        return os.path.getsize(self.path(name)) if self.fs is None else self.fs.get_file_info(self.path(name)).size

    def open(self, name: str = "") -> BinaryIO:
        """For reading at any place."""
        return open(self.path(name), "rb") if self.fs is None else self.fs.open_input_file(self.path(name))

    def read(self, name: str) -> bytes:
        with self.open(name) as f:
            return f.read()

    def create(self, name: str, data: bytes) -> bool:
        """Write a file that must not be there yet; False if it is."""
        if self.fs is not None:
            from pyarrow import fs

            if self.fs.get_file_info(self.path(name)).type != fs.FileType.NotFound:
                return False
            self.write(name, [data])
            return True
        os.makedirs(os.path.dirname(self.path(name)), exist_ok=True)
        hidden = f"{os.path.dirname(self.path(name))}/.{uuid.uuid4().hex}"
        with open(hidden, "wb") as f:
            f.write(data)
        try:
            os.link(hidden, self.path(name))  # fails if the name is taken, in one step
        except FileExistsError:
            return False
        finally:
            os.unlink(hidden)
        return True

    def write(self, name: str, parts: Iterable[bytes]) -> None:
        """Write or replace a file; whoever writes it again writes the same name."""
        path = self.path(name)
        if self.fs is not None:
            self.fs.create_dir(os.path.dirname(path), recursive=True)
            with self.fs.open_output_stream(path) as f:
                for x in parts:
                    f.write(x)
            return
        hidden = f"{os.path.dirname(path)}/.{uuid.uuid4().hex}"
        try:
            f = open(hidden, "wb")  # noqa: SIM115 - closed below
        except FileNotFoundError:
            os.makedirs(os.path.dirname(path), exist_ok=True)
            f = open(hidden, "wb")  # noqa: SIM115 - closed below
        try:
            with f:
                for x in parts:
                    f.write(x)
            os.replace(hidden, path)
        except BaseException:
            with suppress(FileNotFoundError):
                os.unlink(hidden)
            raise
