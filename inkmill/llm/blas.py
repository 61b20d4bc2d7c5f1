"""Matrix products on one thread: tasks already fill the cores, and more threads only wait for each other on small products."""

import ctypes
import re
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np

_NAMES = ("scipy_openblas_{}_num_threads64_", "openblas_{}_num_threads64_", "scipy_openblas_{}_num_threads", "openblas_{}_num_threads")


@lru_cache(1)
def _controls() -> list[tuple]:
    """Functions that say and set the number of threads of the OpenBLAS libraries of this process; none where there are none."""
    np.ones((2, 2)) @ np.ones((2, 2))
    try:
        with open("/proc/self/maps") as f:
            paths = sorted(set(re.findall(r"(/\S*openblas\S*\.so\S*)", f.read())))
        libraries = [ctypes.CDLL(p) for p in paths]
    except OSError:
        return []
    found = [[(getattr(x, n.format("get")), getattr(x, n.format("set"))) for n in _NAMES if hasattr(x, n.format("set"))][:1] for x in libraries]
    return [pair for pairs in found for pair in pairs]


@contextmanager
def one_thread() -> Iterator[None]:
    before = [(put, get()) for get, put in _controls()]
    for put, _ in before:
        put(1)
    try:
        yield
    finally:
        for put, n in before:
            put(n)
