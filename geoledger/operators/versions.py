"""Entity tables as a row of snapshots: upserts, soft deletes and edits that can be rerun and lose nothing when a driver dies."""

from __future__ import annotations

import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F


class VersionedTable:
    """A table below ``path`` whose content is one Parquet snapshot, named by the last of its version marks.

    A change reads the current snapshot, writes a whole new one beside it and then makes mark N + 1, a new file with the
    snapshot's name, which only one writer can make. Until then readers see the old snapshot; a snapshot that no mark names, or a
    mark left empty (its driver died), is never read. A change that changes nothing, as a rerun, makes no version. ``path``
    must lie where all executors see it.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _hadoop(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _marks(self) -> list[tuple[int, int]]:
        """(number, bytes) of all marks, in order."""
        p, fs = self._hadoop(f"{self.path}/marks")
        found = [(s.getPath().getName(), s.getLen()) for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted((int(n), size) for n, size in found if re.fullmatch(r"\d{9}", n))

    @property
    def number(self) -> int:
        found = self._marks()
        return found[-1][0] if found else 0

    def read(self, number: int | None = None) -> DataFrame:
        """The current content, or that of an earlier version; empty before the first."""
        found = [n for n, size in self._marks() if size and (number is None or n == number)]
        if number is not None and not found:
            raise ValueError(f"there is no version {number}")
        if not found:
            return self.spark.createDataFrame([], self.schema)
        snapshot = self.spark.read.text(f"{self.path}/marks/{found[-1]:09d}").first().value
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{snapshot}")

    def replace(self, content: DataFrame, based_on: int) -> int:
        """Make ``content`` the next version; fails if another writer has made one since ``based_on``."""
        snapshot = f"s{uuid.uuid4().hex}"
        content.select(*self.read().columns).write.parquet(f"{self.path}/{snapshot}")
        mark, fs = self._hadoop(f"{self.path}/marks/{based_on + 1:09d}")
        try:
            out = fs.create(mark, False)
        except Py4JJavaError as e:
            raise RuntimeError(f"version {based_on + 1} was made by another writer") from e
        out.write(bytearray(snapshot.encode()))
        out.close()
        return based_on + 1

    def _change(self, make) -> int:
        number = self.number
        old = self.read()
        new, changed = make(old)
        return number if changed.isEmpty() else self.replace(new, number)

    def insert_new(self, rows: DataFrame, keys: list[str], order: list[Column]) -> int:
        """Add the rows whose keys aren't stored yet; of several with equal keys the first in ``order`` is taken.

        Rows with a null key are never added. Stored rows stay as they are. Returns the current version's number.
        """

        def make(old: DataFrame):
            known = rows.where(" and ".join(f"`{k}` is not null" for k in keys))
            first = known.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")
            new = first.join(old.select(*keys), keys, "left_anti").select(*old.columns)
            return old.unionByName(new), new

        return self._change(make)

    def put(self, rows: DataFrame, keys: list[str]) -> int:
        """Replace stored rows by those of ``rows`` (whole rows with unique keys) with the same keys, and add the others."""

        def make(old: DataFrame):
            new = rows.select(*old.columns)
            return old.join(new.select(*keys), keys, "left_anti").select(*old.columns).unionByName(new), new.exceptAll(old)

        return self._change(make)

    def edit(self, where: str, values: dict[str, Column]) -> int:
        """Set columns of the rows that a condition names. A row that has the values already isn't changed."""

        def make(old: DataFrame):
            hit = F.coalesce(F.expr(where), F.lit(False))
            new = old.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in old.columns])
            differs = " or ".join(f"not (`{c}` <=> `_new_{c}`)" for c in values)
            changed = old.where(hit).withColumns({f"_new_{c}": v for c, v in values.items()}).where(differs)
            return new, changed

        return self._change(make)

    def archive(self, at: Column, column: str = "archived_at", where: str = "true") -> int:
        """Soft delete: rows that aren't archived yet are given the time; those that are keep theirs."""
        return self.edit(f"`{column}` is null and ({where})", {column: at})

    def remove_then_insert(self, rows: DataFrame, keys: list[str], superseded: DataFrame) -> int:
        """Take out the stored rows that match ``superseded`` on all its columns, then add those of ``rows`` whose keys aren't stored."""

        def make(old: DataFrame):
            gone = superseded.distinct()
            kept = old.join(gone, gone.columns, "left_anti").select(*old.columns)
            new = rows.dropDuplicates(keys).join(kept.select(*keys), keys, "left_anti").select(*old.columns)
            content = kept.unionByName(new)
            return content, content.exceptAll(old).union(old.exceptAll(content))

        return self._change(make)
