"""References to records that do not exist, kept up to date by increments.

State: keyed tables in a folder that all executors share, divided by a hash of
(parent, key) into buckets: the parents' live keys, the references by their
key, and the pending references whose parent is not live.  An increment brings
new references, arriving parents and deleted parents, in any mix:

* new references probe the index of live keys,
* arriving parents resolve the references that wait for them,
* deleted parents reopen the references to them.

Only the buckets that an increment's keys fall in are read and written anew; a
small list of each bucket's version is what makes an increment count.  It names
the batch, so that a batch that comes again changes nothing, and a new driver
goes on where the last one ended.  Counts are added to a table of snapshots.

Scale: an increment probes with the distinct keys of its references, combined
before the shuffle, so that a key which most references share is one row there.
References are matched with missing keys by a broadcast of a checked size, or
salted, and buckets are written by several tasks where they are large.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.plans.shape import cut, semi_by_keys
from weftline.plans.store import Folder, scratch

REFERENCE = T.StructType([
    T.StructField("table_name", T.StringType()), T.StructField("field_name", T.StringType()), T.StructField("parent", T.StringType()), T.StructField("ref_key", T.LongType()),
    T.StructField("key_1", T.LongType()), T.StructField("key_2", T.LongType()), T.StructField("period", T.LongType()),
])
PARENT = T.StructType([T.StructField("parent", T.StringType()), T.StructField("ref_key", T.LongType())])
KEY = ["parent", "ref_key"]


def references(rows: DataFrame, table_name: str, field: str, parent: str, key_1: str, key_2: str | None = None, time: str | None = None, period_us: int = 5_000_000) -> DataFrame:
    """The non-NULL references of one column; period -1 without a time.

    A NULL time, or one before 0, is rounded down like any other (NULL stays NULL).
    """
    number = lambda c: F.lit(-1).cast("bigint") if c is None else F.col(c).cast("bigint")
    period = F.lit(-1).cast("bigint") if time is None else F.floor(F.col(time) / period_us)
    return rows.where(F.col(field).isNotNull()).select(
        F.lit(table_name).alias("table_name"), F.lit(field).alias("field_name"), F.lit(parent).alias("parent"), F.col(field).cast("bigint").alias("ref_key"),
        number(key_1).alias("key_1"), number(key_2).alias("key_2"), period.alias("period"),
    )


def parents(rows: DataFrame, parent: str, key: str) -> DataFrame:
    return rows.where(F.col(key).isNotNull()).select(F.lit(parent).alias("parent"), F.col(key).cast("bigint").alias("ref_key"))


_SCHEMAS = {"live": PARENT, "pending": REFERENCE, "references": REFERENCE}


class OrphanTable:
    """Pending orphans over increments of references and parents.

    Within one increment arrivals are applied first, then deletions, then the
    new references.  A parent that arrives twice is live once; deleting a key
    that is not live changes nothing.  Repeated references are one record.

    ``buckets`` divide the state; an increment writes those anew that its keys
    fall in, so a state of terabytes wants thousands.

    With ``keep_references`` False references are not kept by key: nothing is
    copied, and parents cannot be deleted.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, *, buckets: int = 16, keep_references: bool = True, snapshot_every: int = 1):
        self.spark, self.folder = spark, Folder(spark, folder or scratch(spark, "orphans"))
        self.keep, self.every = keep_references, snapshot_every
        #: The last batch that counts, and the batch that last wrote each bucket.
        self.state = {"batch": -1, "buckets": buckets, "live": {}, "pending": {}, "references": []}
        if versions := [n for n in self.folder.names("versions") if n.isdigit()]:
            self.state = json.loads(self.folder.read(f"versions/{max(versions, key=int)}"))

    def _bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(*KEY), F.lit(self.state["buckets"])).cast("int"))

    def _empty(self, schema: T.StructType) -> DataFrame:
        """No rows, as a plan that joins with it are dropped for."""
        return self.spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema])

    def _keys(self, df: DataFrame | None) -> DataFrame:
        return self._bucketed(self._empty(PARENT) if df is None else df.select(*[F.col(k).cast(t.dataType).alias(k) for k, t in zip(KEY, PARENT, strict=True)]).dropna().distinct())

    def _read(self, kind: str, buckets: set[int] | None = None, state: dict | None = None) -> DataFrame:
        """Rows of some or all buckets."""
        state = state or self.state
        if kind == "references":
            paths = [self.folder.at(f"references/{v}") for v in state[kind]]
        else:
            paths = [self.folder.at(f"{kind}/{v}/bucket={b}") for b, v in state[kind].items() if buckets is None or int(b) in buckets]
        if not paths:
            return self._bucketed(self._empty(_SCHEMAS[kind]))
        if kind != "references":
            return self._bucketed(self.spark.read.schema(_SCHEMAS[kind]).parquet(*paths))
        rows = [self.spark.read.schema(T.StructType([*_SCHEMAS[kind], T.StructField("bucket", T.IntegerType())])).parquet(p) for p in paths]
        every = reduce(DataFrame.unionByName, rows)
        return every if buckets is None else every.where(F.col("bucket").isin(sorted(buckets)))

    def _write(self, df: DataFrame, kind: str, batch: int) -> set[int]:
        """Writes buckets under the batch's number, and says which have rows."""
        df.select(*_SCHEMAS[kind].names, "bucket").hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(self.folder.at(f"{kind}/{batch}"))
        return {int(n.partition("=")[2]) for n in self.folder.names(f"{kind}/{batch}") if n.startswith("bucket=")}

    @staticmethod
    def _buckets(df: DataFrame) -> set[int]:
        return {r.bucket for r in df.select("bucket").distinct().toLocalIterator()}  # at most as many as there are buckets

    def advance(self, new: DataFrame | None = None, arrived: DataFrame | None = None, deleted: DataFrame | None = None, batch: int | None = None) -> OrphanTable:
        """Applies an increment; one whose ``batch`` number was applied before changes nothing."""
        batch = self.state["batch"] + 1 if batch is None else batch
        if batch <= self.state["batch"]:
            return self
        if deleted is not None and not self.keep:
            raise ValueError("deletions reopen references, which keep_references=False does not keep")
        state = json.loads(json.dumps(self.state)) | {"batch": batch}
        turn = lambda kind, touched, written: state[kind].update({str(b): batch for b in written}) or [state[kind].pop(str(b), None) for b in touched - written]
        come, gone, touched = self._keys(None), self._keys(None), set()
        if arrived is not None or deleted is not None:
            come = cut(self._keys(arrived))
            dropped = cut(self._keys(deleted)) if deleted is not None else gone
            touched = self._buckets(come) | self._buckets(dropped)
            live = self._read("live", touched).unionByName(come).distinct()
            if deleted is not None:
                live = cut(live)
                gone = cut(live.join(dropped, KEY, "left_semi"))
                live = live.join(gone, KEY, "left_anti")
            turn("live", touched, self._write(live, "live", batch))
        parts = []
        if new is not None:
            new = self._bucketed(new.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in REFERENCE]).where(F.col("ref_key").isNotNull()))
            missing = cut(self._bucketed(new.select(*KEY).distinct().join(self._read("live", state=state), KEY, "left_anti")))
            touched = touched | self._buckets(missing)
            parts.append(semi_by_keys(new, missing.select(*KEY), KEY))
        before = self._read("pending", touched)
        parts.append(before.join(come.select(*KEY), KEY, "left_anti"))
        if deleted is not None:
            parts.append(semi_by_keys(self._read("references", self._buckets(gone)), gone.select(*KEY), KEY))
        columns = [*REFERENCE.names, "bucket"]
        turn("pending", touched, self._write(reduce(DataFrame.unionByName, [p.select(*columns) for p in parts]).distinct(), "pending", batch))
        if new is not None and self.keep and self._write(new, "references", batch):
            state["references"].append(batch)
        before, self.state = self.state, state
        if self.every and batch % self.every == 0:
            self.counts().withColumn("batch", F.lit(batch).cast("bigint")).write.mode("overwrite").parquet(self.folder.at(f"counts/{batch}"))
        self.folder.write(f"versions/{batch}", json.dumps(state))
        self._clear(before)
        return self

    def _clear(self, before: dict) -> None:
        """Removes what no bucket refers to any more, but for the version before, which a reader may still be at."""
        for kind in ("live", "pending"):
            used = {str(v) for s in (before, self.state) for v in s[kind].values()} | {str(self.state["batch"])}
            for n in set(self.folder.names(kind)) - used:
                self.folder.delete(f"{kind}/{n}")

    def orphans(self) -> DataFrame:
        """The references that wait for a parent now."""
        return self._read("pending").select(*REFERENCE.names)

    def counts(self) -> DataFrame:
        """Waiting references by table, field and period."""
        return self.orphans().groupBy("table_name", "field_name", "period").agg(F.count(F.lit(1)).alias("orphans"), F.countDistinct("ref_key").alias("keys"))

    def snapshots(self) -> DataFrame:
        """The counts after each increment, with its number as ``batch``."""
        paths = [self.folder.at(f"counts/{n}") for n in self.folder.names("counts") if n.isdigit() and int(n) <= self.state["batch"]]
        schema = "table_name string, field_name string, period bigint, orphans bigint, keys bigint, batch bigint"
        return self.spark.read.schema(schema).parquet(*paths) if paths else self._empty(T.StructType.fromDDL(schema))

    def follow(self, stream: DataFrame, kind: str = "kind"):
        """A started-on-demand writer that advances by micro-batches, each of them once.

        ``stream`` has the REFERENCE columns and ``kind`` ('reference',
        'arrived' or 'deleted').
        """

        def advance(rows: DataFrame, number: int) -> None:
            rows = rows.persist()
            part = lambda k: rows.where(F.col(kind) == k)
            deleted = part("deleted").select(*KEY) if self.keep else None
            self.advance(part("reference"), part("arrived").select(*KEY), deleted, batch=number)
            rows.unpersist()

        return stream.writeStream.foreachBatch(advance)
