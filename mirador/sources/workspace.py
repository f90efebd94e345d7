"""Folders of staged tables, with an owner who deletes them.

Tables staged while a ``Workspace`` is open go to its folder, which is deleted when it is
closed: after the caller has written or collected the result, as results read staged tables.
Without one they go to a folder of the application, which is deleted when the driver ends or
``close_all`` is called.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import SparkSession

from mirador.session import staging_root


class Workspace:
    """A folder below the cluster's shared one; use it as a context manager or close it."""

    def __init__(self, spark: SparkSession):
        self.path = f"{staging_root(spark)}/mirador-{uuid.uuid4().hex}"
        # kept so that closing needs no live session
        self._jvm, self._hadoop = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def __enter__(self) -> "Workspace":
        _open.append(self)
        return self

    def __exit__(self, *error) -> None:
        _open.remove(self)
        self.close()

    def new(self, name: str) -> str:
        """A path that nothing else uses."""
        return f"{self.path}/{name}-{uuid.uuid4().hex}"

    def close(self) -> None:
        folder = self._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(self._hadoop).delete(folder, True)


_open: list[Workspace] = []
_own: dict[str, Workspace] = {}


def workspace(spark: SparkSession) -> Workspace:
    """The innermost open workspace, or the application's own."""
    if _open:
        return _open[-1]
    application = spark.sparkContext.applicationId
    if application not in _own:
        _own[application] = Workspace(spark)
    return _own[application]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the current workspace."""
    return workspace(spark).new(name)


@atexit.register
def close_all() -> None:
    """Delete what the applications of this driver have staged."""
    while _own:
        with contextlib.suppress(Exception):  # the JVM may be gone already
            _own.popitem()[1].close()
