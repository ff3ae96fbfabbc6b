"""How Python workers give memory back.

Spark keeps as many idle workers as ever ran at once and takes them in turn, so each of them would hold on to what its largest task
had needed, for the rest of the application. In a worker, large blocks therefore go back to the system as soon as they are freed.
"""

from __future__ import annotations

import ctypes
import sys

import pyarrow as pa

#: glibc's parameters of mallopt.
TRIM_THRESHOLD, MMAP_THRESHOLD, ARENA_MAX = -1, -3, -8
#: Bytes of a block from which it is mapped by itself; bytes that may stay free at the heap's end.
BLOCK, FREE = 1 << 20, 4 << 20


def settle() -> None:
    """Where this is a Python worker of Spark: no pool of freed Arrow buffers, and blocks of BLOCK bytes mapped by themselves."""
    if "pyspark.worker" not in sys.modules:
        return
    pa.set_memory_pool(pa.system_memory_pool())
    if mallopt := getattr(ctypes.CDLL(None), "mallopt", None):
        for parameter, value in ((MMAP_THRESHOLD, BLOCK), (TRIM_THRESHOLD, FREE), (ARENA_MAX, 1)):
            mallopt(parameter, value)


def tidied(work):
    """``work`` on the batches of a task, after which the worker also gives back what is free between the blocks that it keeps."""

    def run(batches):
        try:
            yield from work(batches)
        finally:
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return run
