"""Broadcast of objects whose classes the executors need not have."""

import ctypes
import pickle
import sys
from collections.abc import Callable
from types import ModuleType

from pyspark import Broadcast, cloudpickle
from pyspark.sql import SparkSession


def share(session: SparkSession, value: object) -> Broadcast:
    """``value`` and the code of its class, as bytes; ``opened`` gives it back in a task."""
    return session.sparkContext.broadcast(cloudpickle.dumps(value))


def opened(shared: Broadcast):
    return pickle.loads(shared.value)


def kept_in_worker(name: str, make: Callable):
    """A value that a Python worker makes once and keeps for its later tasks."""
    kept = sys.modules.setdefault("_kept_in_worker", ModuleType("_kept_in_worker")).__dict__
    if name not in kept:
        kept[name] = make()
    return kept[name]


def let_go_in_worker() -> None:
    """Forget what a Python worker keeps, at the beginning of work that needs its memory.

    Spark hands a worker on from one operator of a session to the next.
    """
    sys.modules.pop("_kept_in_worker", None)


def tidied(rows: Callable) -> Callable:
    """``rows`` (of mapInArrow), after which its worker hands what was freed back to the system.

    The C library keeps it otherwise, beside the memory of whatever runs next in that executor.
    """

    def run(batches):
        yield from rows(batches)
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return run
