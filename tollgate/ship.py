"""Send this package to the executors' Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

_SENT: set[str] = set()


def ship(spark) -> None:
    """Add the package to the session's Python files, once per application; workers
    then find it wherever they run."""
    app = spark.sparkContext.applicationId
    if app in _SENT:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    name = os.path.join(tempfile.mkdtemp(prefix="tollgate"), "tollgate.zip")
    with zipfile.ZipFile(name, "w") as z:
        for folder, _, files in os.walk(here):
            for f in files:
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.relpath(path, os.path.dirname(here)))
    spark.sparkContext.addPyFile(name)
    _SENT.add(app)
