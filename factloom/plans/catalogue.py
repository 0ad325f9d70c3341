"""Relations that are made once: per program, and per input of a session.

What is derived from a program is written when it is first asked for and read from then on, so two
queries of a session share it; it is made again when the input has changed, and its tables are deleted
when it is dropped.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .fixpoint import cut, drop


class Catalogue:
    """Named relations with what each is made of.

    ``add(name, make, *needs)`` says how; ``get(name)`` gives the written table, made on the first
    call after those it needs; ``release(name)`` deletes it and all that was made of it."""

    def __init__(self):
        self._makers: dict[str, tuple[Callable[..., DataFrame], tuple[str, ...]]] = {}
        self._made: dict[str, DataFrame] = {}

    def add(self, name: str, make: Callable[..., DataFrame], *needs: str) -> None:
        for n in needs:
            if n not in self._makers:
                raise KeyError(f"{name} needs {n}, which must be added before it")
        if name in self._makers:
            raise KeyError(f"{name} is there already")
        self._makers[name] = (make, needs)

    def __contains__(self, name: str) -> bool:
        return name in self._makers

    @property
    def made(self) -> tuple[str, ...]:
        """The relations that are written, in the order of their making."""
        return tuple(self._made)

    def get(self, name: str) -> DataFrame:
        if name not in self._made:
            make, needs = self._makers[name]
            self._made[name] = cut(make(*[self.get(n) for n in needs]))
        return self._made[name]

    def release(self, *names: str) -> None:
        """The named relations, all without a name, and those that need them go."""
        gone = set(names or self._made)
        while more := {n for n, (_, needs) in self._makers.items() if n not in gone and gone & set(needs)}:
            gone |= more
        for n in [n for n in self._made if n in gone]:
            drop(self._made.pop(n))


#: (application, kind, path) to (state of the input, what was made).
_shared: dict[tuple[str, str, str], tuple[tuple, Any]] = {}


def state_of(spark: SparkSession, path: str) -> tuple:
    """Files under a path with their lengths and times of change."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(root, True)
    out = []
    while files.hasNext():
        f = files.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def shared(spark: SparkSession, kind: str, path: str, make: Callable[[], Any], dropped: Callable[[Any], None]) -> Any:
    """What ``make`` makes of the input at a path, the same object for all queries of the application
    until the input changes; then ``dropped`` gets the old one."""
    key = (spark.sparkContext.applicationId, kind, path)
    now = state_of(spark, path)
    held = _shared.get(key)
    if held and held[0] == now:
        return held[1]
    if held:
        dropped(held[1])
    made = make()
    _shared[key] = (now, made)
    return made


def release_shared(spark: SparkSession, dropped: Callable[[Any], None]) -> None:
    """Everything that the application shares goes."""
    for key in [k for k in _shared if k[0] == spark.sparkContext.applicationId]:
        dropped(_shared.pop(key)[1])
