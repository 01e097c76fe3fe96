"""Wall-clock time of an action."""

from __future__ import annotations

import sys
import time
from contextlib import contextmanager


@contextmanager
def timed(name: str, out=sys.stderr):
    """Print the milliseconds of the block, which should hold an action."""
    s = time.perf_counter()
    yield
    print(f"{name} {(time.perf_counter() - s) * 1000:.1f} ms", file=out)
