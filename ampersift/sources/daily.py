"""Tables stored by day, appended to one day at a time.

An append reads and rewrites the days of its new rows only; the files of every
other day stay as they are. The rewritten days are staged beside the table first
and then put in place by a dynamic partition overwrite. A run that dies in
between leaves the complete stage behind, and the next use of the table puts it
in place, so that neither stored nor new rows are lost.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ampersift.functions.columns import quoted
from ampersift.operators.upserts import keep_first, keep_last, stack
from ampersift.streaming.jobs import stream_batches

DAY = "_day"
# The folder of rows without a time.
NO_DAY = "none"


def day_of(ts: str | Column) -> Column:
    """The day of a timestamp as text, ``none`` where there is none."""
    at = quoted(ts) if isinstance(ts, str) else ts
    return F.coalesce(F.date_format(at, "yyyy-MM-dd"), F.lit(NO_DAY))


class DailyTable:
    """One row per ``keys`` and time in ``path``, a folder per day of ``ts``.

    ``keep`` decides between a stored and a new row with the same key: the
    ``"last"`` or the ``"first"`` to arrive; with ``order`` the greatest or the
    smallest by those columns, and arrival where they are equal. ``tie`` orders
    equal keys within one append. A key has to fall on one day, so ``keys``
    holds ``ts`` or something that fixes its day.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: T.StructType,
        keys: Sequence[str],
        ts: str = "datetime",
        keep: str = "last",
        order: Sequence[str] = (),
        tie: Sequence[str] = (),
    ):
        if keep not in ("last", "first"):
            raise ValueError(f"keep must be last or first, not {keep!r}")
        self.spark, self.path, self.keys, self.ts = spark, path.rstrip("/"), list(keys), ts
        self.schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
        self.stored_schema = T.StructType([*self.schema.fields, T.StructField(DAY, T.StringType())])
        self.choose = keep_last if keep == "last" else keep_first
        self.order, self.tie = list(order), list(tie)

    @property
    def _stage(self) -> str:
        return f"{self.path}_stage"

    def _folder(self, path: str):
        """Hadoop's file system and path, of whatever store the table is in."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), hadoop

    def _exists(self, path: str) -> bool:
        fs, where = self._folder(path)
        return fs.exists(where)

    def _drop(self, path: str) -> None:
        fs, where = self._folder(path)
        fs.delete(where, True)

    def recover(self) -> bool:
        """Finish the append that a dead run has staged; drop an incomplete stage."""
        complete = self._exists(f"{self._stage}/_SUCCESS")
        if complete:
            self._put_in_place()
        elif self._exists(self._stage):
            self._drop(self._stage)
        return complete

    def _stored(self, days: Sequence[str] | None = None) -> DataFrame:
        """Rows with their day; only the folders of ``days`` are listed and read."""
        if not self._exists(self.path):
            return self.spark.createDataFrame([], self.stored_schema)
        rows = self.spark.read.schema(self.stored_schema).parquet(self.path)
        return rows if days is None else rows.where(F.col(DAY).isin(list(days)))

    def read(self, first: str | None = None, last: str | None = None) -> DataFrame:
        """All rows, or those of the days ``first`` to ``last`` (yyyy-MM-dd, inclusive)."""
        self.recover()
        rows = self._stored()
        if first is not None:
            rows = rows.where((F.col(DAY) >= first) & (F.col(DAY) != NO_DAY))
        if last is not None:
            rows = rows.where(F.col(DAY) <= last)
        return rows.select(*[quoted(f.name) for f in self.schema])

    def append(self, new: DataFrame) -> list[str]:
        """Merge ``new`` into the table; the days that were rewritten.

        The days of the new rows come to the driver, one short text each.
        """
        self.recover()
        fresh = new.select(*[quoted(f.name).cast(f.dataType).alias(f.name) for f in self.schema]).withColumn(DAY, day_of(self.ts))
        days = sorted(r[0] for r in fresh.select(DAY).distinct().collect())
        if not days:
            return []
        both = stack([self._stored(days), fresh], "_arrival")
        rank = [*self.order, "_arrival", *self.tie]
        merged = self.choose(both, [*self.keys, DAY], rank).drop("_arrival")
        # one file for a small day, several for one that holds much
        merged.hint("rebalance", DAY).write.mode("overwrite").partitionBy(DAY).parquet(self._stage)
        self._put_in_place()
        return days

    def _put_in_place(self) -> None:
        staged = self.spark.read.schema(self.stored_schema).parquet(self._stage)
        writer = staged.hint("rebalance", DAY).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(DAY).parquet(self.path)
        self._drop(self._stage)

    def append_stream(self, stream: DataFrame, checkpoint: str) -> None:
        """Merge everything a stream has available, micro-batch by micro-batch.

        A batch that is tried again changes nothing: its rows meet themselves.
        """
        stream_batches(stream, checkpoint, lambda batch, number: self.append(batch))
