"""Progress events of long stages."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass


@dataclass
class ProgressEvent:
    stage: str
    step: str
    current: int
    total: int
    message: str
    elapsed_seconds: float
    estimated_remaining_seconds: float | None


ProgressCallback = Callable[[ProgressEvent], None]


class ProgressTracker:
    """Sends events of one stage to a callback; threads may report at the same time."""

    def __init__(self, stage: str, total: int, callback: ProgressCallback | None = None):
        self.stage, self.total, self.callback = stage, total, callback
        self.began, self.lock = time.monotonic(), threading.Lock()

    def _send(self, current: int, step: str, message: str, left: float | None) -> None:
        if self.callback:
            with self.lock:
                self.callback(ProgressEvent(self.stage, step, current, self.total, message, round(time.monotonic() - self.began, 1), left))

    def update(self, current: int, step: str, message: str) -> None:
        spent = time.monotonic() - self.began
        self._send(current, step, message, round(spent * (self.total - current) / current, 1) if 0 < current < self.total else None)

    def complete(self, message: str = "Done") -> None:
        self._send(self.total, "complete", message, 0.0)


def default_progress_callback(event: ProgressEvent) -> None:
    share = 100 * event.current / event.total if event.total else 0
    left = event.estimated_remaining_seconds
    eta = "" if not left else f", {left / 60:.1f} min left" if left >= 60 else f", {left:.0f} s left"
    print(f"[{event.stage}] {event.current}/{event.total} ({share:.0f}%) {event.message} ({event.elapsed_seconds:.1f} s{eta})", flush=True)
