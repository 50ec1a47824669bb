"""One BLAS thread on the driver.

Model state there is a few kilobytes; a thread pool beside the JVM's gains
nothing and can stall when all cores are taken.
"""

from __future__ import annotations

import ctypes
import functools
import glob
import os

import numpy as np


@functools.cache
def single_thread() -> None:
    folder = os.path.join(os.path.dirname(os.path.dirname(np.__file__)), "numpy.libs")
    for path in glob.glob(os.path.join(folder, "*openblas*")):
        lib = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(lib, name):
                getattr(lib, name)(1)
                break
