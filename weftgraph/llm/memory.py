"""Give a Python worker's freed memory back after each group or partition: workers outlive their
tasks, and what an allocator keeps counts against the executor for all later stages."""

from __future__ import annotations

import ctypes
import functools
import inspect

import pyarrow as pa


def release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(f):
    """Wrap a function of groups, or a generator over batches."""
    if inspect.isgeneratorfunction(f):

        @functools.wraps(f)
        def each(batches):
            yield from f(batches)
            release()

        return each

    def done(out):
        release()
        return out

    # Spark counts the parameters of the function it is given.
    once = {1: lambda a: done(f(a)), 2: lambda a, b: done(f(a, b)), 3: lambda a, b, c: done(f(a, b, c))}[len(inspect.signature(f).parameters)]
    return functools.wraps(f)(once)
