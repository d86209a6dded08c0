"""Keeps dense algebra on one thread: matrices here are small, tasks run side by side, and a pool of threads in a forked process can stall."""

from __future__ import annotations

import contextlib
import ctypes
from pathlib import Path

import numpy as np


def one_thread() -> bool:
    """Tells the linear-algebra library that NumPy has loaded to use one thread; whether one took the call."""
    done = False
    for folder in (Path(np.__file__).parent.parent / "numpy.libs", Path(np.__file__).parent / ".libs"):
        for file in folder.glob("*openblas*"):
            with contextlib.suppress(OSError):
                library = ctypes.CDLL(str(file))
                for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
                    if hasattr(library, name):
                        getattr(library, name)(1)
                        done = True
                        break
    return done
