"""Small state files of a single driver: locked, written whole or not at all."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from pathlib import Path


@contextmanager
def file_lock(target: Path | str, timeout: float = 10.0, stale: float = 120.0) -> Iterator[None]:
    """One process at a time: a file beside the target that only one can make.  One that is older than `stale` seconds is taken away."""
    lock = Path(f"{target}.lock")
    lock.parent.mkdir(parents=True, exist_ok=True)
    until = time.monotonic() + timeout
    while True:
        try:
            held = os.open(lock, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
            break
        except FileExistsError:
            try:
                if time.time() - lock.stat().st_mtime > stale:
                    # Renamed first, so that of several that wait only one takes it away.
                    gone = lock.with_name(f"{lock.name}.{os.getpid()}.stale")
                    os.replace(lock, gone)
                    gone.unlink()
                    continue
            except FileNotFoundError:
                continue
            if time.monotonic() > until:
                raise TimeoutError(f"{lock} is held") from None
            time.sleep(0.02)
    try:
        os.write(held, str(os.getpid()).encode())
        os.close(held)
        yield
    finally:
        lock.unlink(missing_ok=True)


def _replace(path: Path, data: bytes) -> None:
    """The whole file at once: readers see the old or the new one."""
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(f".{path.name}.{os.getpid()}.part")
    with part.open("wb") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)


def append_line(path: Path | str, line: str) -> None:
    """One line at the end, on disk when the call returns; a short write raises and is taken back.  The caller holds the lock."""
    path, raw = Path(path), (line + "\n").encode()
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("ab") as f:
        at = f.tell()
        if os.write(f.fileno(), raw) != len(raw):
            os.ftruncate(f.fileno(), at)
            raise OSError(f"short write to {path}")
        os.fsync(f.fileno())


def write_json(path: Path | str, payload) -> None:
    """A JSON document, whole or not at all."""
    with file_lock(path):
        _replace(Path(path), json.dumps(payload, sort_keys=True, indent=2, allow_nan=False).encode())


class Lines:
    """A file of JSON rows."""

    def __init__(self, path: Path | str):
        self.path = Path(path)

    def read(self) -> list[dict]:
        return [json.loads(x) for x in self.path.read_text("utf-8").splitlines() if x.strip()] if self.path.exists() else []

    def append(self, row: Mapping) -> None:
        with file_lock(self.path):
            append_line(self.path, json.dumps(dict(row), sort_keys=True))

    def rewrite(self, rows: Sequence[Mapping]) -> None:
        with file_lock(self.path):
            self._rewrite(rows)

    def _rewrite(self, rows: Sequence[Mapping]) -> None:
        _replace(self.path, "".join(json.dumps(dict(r), sort_keys=True) + "\n" for r in rows).encode())

    def update(self, change: Callable[[list[dict]], tuple[Sequence[Mapping], object]]) -> object:
        """Read, change and write back under one lock; gives the change's second value."""
        with file_lock(self.path):
            rows, out = change(self.read())
            self._rewrite(rows)
            return out
