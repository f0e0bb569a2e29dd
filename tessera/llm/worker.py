"""Memory of Python processes, which live on from task to task and from stage to stage."""

from __future__ import annotations

import ctypes
import gc
import sys


def lean() -> None:
    """Give up what encoding tasks keep for each other. Called at the start of tasks that encode nothing."""
    encoding = sys.modules.get("tessera.llm.encoding")
    if encoding is None or not encoding._ENCODERS:  # noqa: SLF001
        return
    encoding._ENCODERS.clear()  # noqa: SLF001
    trim()


def trim() -> None:
    """Give freed memory back to the system."""
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library frees as it likes
        pass
