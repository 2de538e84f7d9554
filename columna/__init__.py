"""columna: labelled numeric frames, statistics, small models and calendars on Spark DataFrames."""

from __future__ import annotations

import os
import tempfile
import zipfile


def ship(spark) -> None:
    """Sends this package to the executors, once a Spark context, so that their Python finds it too."""
    sc = spark.sparkContext
    if getattr(sc, "_columna_shipped", False):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="columna-package-"), "columna-package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for d, _, names in os.walk(home):
            for n in sorted(names):
                if n.endswith(".py"):
                    z.write(os.path.join(d, n), os.path.join("columna", os.path.relpath(os.path.join(d, n), home)))
    sc.addPyFile(path)
    sc._columna_shipped = True
