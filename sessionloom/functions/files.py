"""Small documents in a folder of this machine or one that is mounted: whole or not there, one writer at a time."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from .payloads import dumps


def save(path: str | os.PathLike, data: bytes) -> None:
    """Write a file so that readers see the old one or the new one, also after a crash."""
    at = Path(path)
    at.parent.mkdir(parents=True, exist_ok=True)
    tmp = at.parent / f".tmp-{uuid.uuid4().hex}"
    try:
        with open(tmp, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(tmp, at)
    finally:
        tmp.unlink(missing_ok=True)
    folder = os.open(at.parent, os.O_RDONLY)
    try:
        os.fsync(folder)
    finally:
        os.close(folder)


class Folder:
    def __init__(self, path: str):
        self.path = Path(path.removeprefix("file://"))

    def read(self, name: str) -> bytes:
        return (self.path / name).read_bytes()

    def has(self, name: str) -> bool:
        return (self.path / name).exists()

    def write(self, name: str, data: bytes) -> None:
        save(self.path / name, data)

    def remove(self, name: str) -> None:
        (self.path / name).unlink(missing_ok=True)

    def pin(self, name: str, value: dict, otherwise: str) -> None:
        """Keep the inputs a folder's results rest on; other ones later are an error."""
        if self.has(name):
            if json.loads(self.read(name)) != value:
                raise ValueError(otherwise)
        else:
            self.write(name, dumps(value).encode())

    @contextmanager
    def locked(self, name: str, wait: bool = False) -> Iterator[None]:
        """Hold the folder's lock of that name; a second holder waits or is an error, and a dead one's lock is free."""
        import fcntl

        self.path.mkdir(parents=True, exist_ok=True)
        with open(self.path / f".{name}.lock", "a") as f:
            try:
                fcntl.flock(f, fcntl.LOCK_EX | (0 if wait else fcntl.LOCK_NB))
            except OSError:
                raise ValueError(f"another process is using {self.path}") from None
            yield
