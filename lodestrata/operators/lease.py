"""Leases: a file whose modification time says that its holder lives."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable


class Lease:
    """Renews the time of ``path`` while it is held, four times within ``expiry_s``, for as long as ``owns()``. A holder that
    dies renews no more; whoever finds the file older than ``expiry_s`` may take over what it stood for. Times are those of
    the callers' clocks, so that ``expiry_s`` has to be well above the difference between any two of them."""

    def __init__(self, fs, path, expiry_s: float, owns: Callable[[], bool] = lambda: True):
        self.fs, self.path, self.expiry_s, self.owns = fs, path, expiry_s, owns
        self._over, self._thread = threading.Event(), None

    def renew(self) -> None:
        if self.owns():
            self.fs.setTimes(self.path, int(time.time() * 1000), -1)

    def _keep(self) -> None:
        while not self._over.wait(max(self.expiry_s / 4, 0.05)):
            try:
                self.renew()
            except Exception:  # noqa: S112  gone, or out of reach for now: the next turn tells
                continue

    def __enter__(self) -> Lease:
        self._thread = threading.Thread(target=self._keep, daemon=True)
        self._thread.start()
        return self

    def __exit__(self, *_) -> None:
        self._over.set()
        self._thread.join()


def age(fs, path) -> float | None:
    """Seconds since the last renewal; None if there is no such lease."""
    try:
        return time.time() - fs.getFileStatus(path).getModificationTime() / 1000
    except Exception:  # missing
        return None
