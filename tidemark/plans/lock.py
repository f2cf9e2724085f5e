"""One owner of a store at a time, in this process and across processes."""

from __future__ import annotations

import fcntl
import os
import threading

_held: set[str] = set()
_guard = threading.Lock()


class Locked(OSError):
    pass


class DirectoryLock:
    def __init__(self, directory: str):
        self.path = os.path.join(os.path.realpath(directory), "LOCK")
        with _guard:
            if self.path in _held:
                raise Locked(f"{directory} is open in this process")
            self.fd = os.open(self.path, os.O_RDWR | os.O_CREAT, 0o644)
            try:
                fcntl.lockf(self.fd, fcntl.LOCK_EX | fcntl.LOCK_NB)
            except OSError as e:
                os.close(self.fd)
                raise Locked(f"{directory} is open in another process") from e
            _held.add(self.path)

    def release(self) -> None:
        with _guard:
            if self.path in _held:
                _held.discard(self.path)
                os.close(self.fd)
