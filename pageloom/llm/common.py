"""What several operators share: words, stable hashes and columns of clashing names."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.storage import in_place as checkpoint
from pageloom.storage import remove, shared_folder, written

__all__ = ["checkpoint", "remove", "shared_folder", "written"]

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the library to the executors' Python, once an application: operators with Python tasks call it."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(prefix="pageloom-"), f"{package.name}.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)


def hex_key(*parts: Column | str) -> Column:
    """A 60-bit hash of the parts, as a long: the first 15 hex digits of an MD5, the same in any SQL engine."""
    text = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def in_fold(doc_id: Column, folds: int, fold: int) -> Column:
    """crc32 of the id as text, modulo folds, is fold; a null id counts as the empty text."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % F.lit(folds) == F.lit(fold)


def free_name(columns: list[str], name: str) -> str:
    """The name, with underscores before it if a column has it already (names differ by more than case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def without(columns: list[str], *names: str) -> list[str]:
    """The columns but those of these names, in any case."""
    return [c for c in columns if c.lower() not in names]


_KEPT: dict[str, tuple[Any, Any]] = {}


def kept(name: str, key: Any, make: Callable[[], Any]) -> Any:
    """What ``make`` gave for this key, kept for the next tasks of the same Python worker; one thing for each name."""
    if name not in _KEPT or _KEPT[name][0] != key:
        _KEPT[name] = key, make()
    return _KEPT[name][1]
