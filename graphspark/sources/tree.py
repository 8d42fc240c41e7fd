"""Source trees as DataFrames of files.

The driver lists paths; tasks read the files. Spark's own file sources are no use here: they skip names that start with
an underscore, and with them every ``__init__.py``.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from graphspark.schema import FILE
from graphspark.sources.languages import detect_language

# Folders that hold no sources of their own; folders that start with a dot are left out as well.
PRUNED = frozenset("__pycache__ venv env node_modules build dist".split())


def list_sources(root: str, language: str | None = None) -> list[str]:
    """Paths below ``root`` with slashes, sorted, of files of a known language or of one language."""
    out = []
    for folder, folders, files in os.walk(root):
        folders[:] = sorted(d for d in folders if d not in PRUNED and not d.startswith("."))
        for name in sorted(files):
            found = detect_language(name)
            if found and (language is None or found == language):
                out.append(os.path.relpath(os.path.join(folder, name), root).replace(os.sep, "/"))
    return out


def scan(spark: SparkSession, root: str, language: str | None = None, files_per_task: int = 200) -> DataFrame:
    """``FILE`` rows of a tree in a folder that all executors can read; files that can't be read are left out."""
    paths = list_sources(root, language)
    root = os.path.abspath(root)

    def read(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path in batch["path"]:
                try:
                    with open(os.path.join(root, path), "rb") as f:
                        content = f.read()
                except OSError:
                    continue
                rows.append((path, detect_language(path), hashlib.sha256(content).hexdigest(), len(content), content))
            yield pd.DataFrame(rows, columns=FILE.names)

    tasks = max(1, -(-len(paths) // files_per_task))
    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(tasks)
    return listed.mapInPandas(read, FILE)
