"""helixframe: molecular-structure analytics on PySpark DataFrames."""

from __future__ import annotations

import os

__version__ = "0.1.0"


def on_workers(spark) -> None:
    """Lets this session's Python workers import the package from where the driver found it, if they see that folder.

    Where they don't, install the package on the executors or ship it with --py-files.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])
