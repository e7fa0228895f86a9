"""The trace tables from log lines: pairing, linkage, migration and steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.operators.pairing import brackets, by_key, last_seen, toggles
from weftline.plans.ids import numbered
from weftline.plans.shape import broadcast_within
from weftline.plans.store import scratch
from weftline.sources import logs as L
from weftline.sources.schemas import PAPI, SCHEMAS
from weftline.sources.symbols import Symbols

INDEX = [f"index_{i}" for i in range(6)]
DEFAULT_ARITY = 4


def conform(df: DataFrame, name: str) -> DataFrame:
    """Columns and types of a trace table."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMAS[name]])


def _named(spark: SparkSession, names: dict[int, str], key: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(list(names.items()), f"{key} bigint, name string"))  # the symbol table's own names


class Reconstruction:
    """Tables of a run from its lines (pe, line_no, value).

    With ``stage`` lines are read and taken apart once, and written by type of
    record to the shared folder; each table then reads the types that it needs.
    """

    def __init__(self, lines: DataFrame, symbols: Symbols, global_start: int = 0, step_event: int = -1, keep_open: bool = False, stage: bool = False):
        #: Whether executions that never end are kept, with NULL ends.
        self.keep_open = keep_open
        self.spark, self.symbols, self.start, self.step_event = lines.sparkSession, symbols, global_start, step_event
        self.rows = self._staged(L.tokens(lines)) if stage else L.tokens(lines)

    def _staged(self, rows: DataFrame) -> DataFrame:
        known = rows.where(F.col("code").isin(*L.KNOWN))
        folder = scratch(self.spark, "lines")
        # Only notes are read from the line itself.
        known.select("pe", "line_no", "tok", F.when(F.col("code").isin(L.NOTE, L.BRACKETED_NOTE), F.col("value")).alias("value"), "code").write.partitionBy("code").parquet(folder)
        return self.spark.read.schema("pe int, line_no bigint, tok array<string>, value string, code int").parquet(folder)

    def of(self, *codes: int) -> DataFrame:
        return self.rows.where(F.col("code").isin(*codes))

    def aligned(self, time: Column) -> Column:
        return time - F.lit(self.start)

    # Begin records: the index has as many numbers as the method's collection has dimensions.
    def begins(self) -> DataFrame:
        layout = self.spark.createDataFrame(self.symbols.layout(), "ep_id bigint, collection_id bigint, ndims bigint")
        rows = self.of(L.BEGIN).withColumn("ep_id", L.token(2)).join(broadcast_within(layout), "ep_id", "left")
        arity = F.when(F.col("ndims") >= 1, F.col("ndims")).otherwise(DEFAULT_ARITY).cast("int")
        rows = rows.withColumn("arity", arity)
        return rows.select(
            "pe", "line_no", "ep_id", "ndims", F.col("collection_id").alias("known"), L.token(1).alias("msg_idx"), L.token(3).alias("time"), L.token(4).alias("event"), L.token(5).alias("src_pe"),
            L.token(6).alias("msg_len"), _receive(7).alias("recv"), *[F.when(F.col("arity") > i, L.token(8 + i)).otherwise(0).alias(c) for i, c in enumerate(INDEX)],
            L.token(F.col("arity") + 8).alias("cpu"), *[L.token(F.col("arity") + 9 + i).alias(f"papi_{i}") for i in range(PAPI)],
        )

    def ends(self) -> DataFrame:
        return self.of(L.END).select("pe", "line_no", L.token(3).alias("time"), L.token(4).alias("event"), L.token(7).alias("cpu"), *[L.token(8 + i).alias(f"papi_{i}") for i in range(PAPI)])

    def chare_instance(self) -> DataFrame:
        """Distinct (collection, index), numbered by first appearance."""
        keyed = self.begins().withColumn("collection_id", F.coalesce("known", F.lit(self.symbols.first_collection)))
        first = keyed.groupBy("collection_id", *INDEX).agg(F.min(F.struct("pe", "line_no")).alias("seen")).select("collection_id", *INDEX, "seen.pe", "seen.line_no")
        return conform(numbered(first, ["pe", "line_no"], "instance_id"), "chare_instance")

    def paired(self) -> DataFrame:
        begins, ends = self.begins().withColumn("is_begin", F.lit(True)), self.ends().withColumn("is_begin", F.lit(False))
        both = begins.unionByName(ends, allowMissingColumns=True)
        return by_key(both, ["pe", "event"], "line_no", F.col("is_begin"), [c for c in begins.columns if c not in ("pe", "event", "is_begin")], self.keep_open)

    def execution(self, instances: DataFrame | None = None) -> DataFrame:
        rows = self.paired()
        keys = instances if instances is not None else self.chare_instance()
        counters = max(0, min(self.symbols.papi_total, PAPI))
        b = lambda c: F.col(f"begin.{c}")
        papi = {}
        for i in range(PAPI):
            use = i < counters
            papi[f"papi_begin_{i}"] = b(f"papi_{i}") if use else F.lit(None)
            papi[f"papi_end_{i}"] = F.col(f"papi_{i}") if use else F.lit(None)
            papi[f"papi_delta_{i}"] = F.col(f"papi_{i}") - b(f"papi_{i}") if use else F.lit(None)
        flat = rows.select(
            F.col("pe").alias("pe_id"), "event", b("ep_id").alias("ep_id"), b("src_pe").alias("src_pe"), b("msg_idx").alias("msg_idx"), b("msg_len").alias("msg_len"), b("line_no").alias("line_no"),
            self.aligned(b("time")).alias("start_time_us"), self.aligned(b("recv")).alias("recv_time_us"), b("cpu").alias("start_cpu_us"), self.aligned(F.col("time")).alias("end_time_us"),
            F.col("cpu").alias("end_cpu_us"), (F.col("time") - b("time")).alias("wall_duration_us"), (F.col("cpu") - b("cpu")).alias("cpu_duration_us"), (b("time") - b("recv")).alias("queue_wait_us"),
            F.coalesce(b("known"), F.lit(0)).alias("collection_id"), *[b(c).alias(c) for c in INDEX], *[v.alias(k) for k, v in papi.items()],
        )
        joined = flat.join(keys.select("instance_id", F.col("collection_id").cast("bigint").alias("collection_id"), *[F.col(c).cast("bigint").alias(c) for c in INDEX]), ["collection_id", *INDEX], "left")
        out = conform(joined, "execution")
        for i, name in self.symbols.papi_names.items():
            if name and i < PAPI:
                for part in ("begin", "end", "delta"):
                    out = out.withMetadata(f"papi_{part}_{i}", {"papi_event": name})
        return out

    def idle_interval(self) -> DataFrame:
        """An end takes the latest begin of its file, used or not; without one it counts from 0 on PE 0."""
        rows = self.of(L.BEGIN_IDLE, L.END_IDLE).select("pe", "line_no", "code", L.token(1).alias("time"), L.token(2).alias("own"))
        ended = last_seen(rows, ["pe"], "line_no", F.col("code") == L.BEGIN_IDLE, F.struct("time", "own"))
        time, own = F.coalesce("begin.time", F.lit(0)), F.coalesce("begin.own", F.lit(0))
        return conform(ended.select(own.alias("pe_id"), self.aligned(time).alias("start_time_us"), self.aligned(F.col("time")).alias("end_time_us"), (F.col("time") - time).alias("duration_us")), "idle_interval")

    def processing_element(self) -> DataFrame:
        """A row per begin of a PE's computation, with the last end behind it in the file (NULL if none)."""
        rows = self.of(L.BEGIN_COMPUTATION, L.END_COMPUTATION).select("pe", "line_no", "code", L.token(1).alias("time"))
        behind = W.partitionBy("pe").orderBy("line_no").rowsBetween(1, W.unboundedFollowing)
        end = F.last(F.when(F.col("code") == L.END_COMPUTATION, F.col("time")), ignorenulls=True).over(behind)
        got = rows.withColumn("end", end).where(F.col("code") == L.BEGIN_COMPUTATION).withColumn("end", F.when(F.col("end") > 0, F.col("end")))
        return conform(got.select(
            F.col("pe").alias("pe_id"), F.lit(self.symbols.processors).alias("total_pes"), F.col("time").alias("begin_time_us"), self.aligned(F.col("end")).alias("end_time_us"),
            F.lit(self.start).alias("global_start_us"), (F.col("end") - F.col("time")).alias("computation_duration_us"), self.aligned(F.col("time")).alias("aligned_begin_us"),
        ), "processing_element")

    def message(self) -> DataFrame:
        """Creations with the execution they led to: the last begin of the sender's serial."""
        rows = self.of(L.CREATION, L.CREATION_BCAST, L.CREATION_MULTICAST).select(
            F.col("pe").alias("src_pe"), "line_no", "code", L.token(1).alias("msg_idx"), L.token(2).alias("ep_id"), L.token(3).alias("time"), L.token(4).alias("event"),
            L.token(6).alias("msg_len"), L.token(7).alias("enqueue"), L.token(8).alias("numpes"),
        )
        kept = ["code", "msg_idx", "ep_id", "time", "msg_len", "enqueue", "numpes"]
        created = rows.groupBy("src_pe", "event").agg(F.max_by(F.struct(*kept), "line_no").alias("c")).select("src_pe", "event", "c.*")
        begun = self.begins().groupBy("src_pe", "event").agg(F.max_by(F.struct(F.col("pe").alias("dst_pe"), "recv", F.col("time").alias("begun")), F.struct("pe", "line_no")).alias("b")).select("src_pe", "event", "b.*")
        linked = created.join(begun, ["src_pe", "event"], "left")
        out = linked.select(
            "src_pe", "event", "ep_id", "msg_idx", "msg_len", self.aligned(F.col("time")).alias("send_time_us"), F.when(F.col("enqueue") > 0, self.aligned(F.col("enqueue"))).alias("enqueue_time_us"),
            (F.col("code") == L.CREATION_BCAST).alias("is_broadcast"), F.when(F.col("code") == L.CREATION_BCAST, F.col("numpes")).otherwise(1).alias("broadcast_fanout"),
            "dst_pe", self.aligned(F.col("recv")).alias("recv_time_us"), self.aligned(F.col("begun")).alias("exec_start_time_us"),
            *[F.lit(None).cast("bigint").alias(c) for c in ("send_to_enqueue_us", "enqueue_to_exec_us", "end_to_end_us")],
        )
        return conform(numbered(out, ["src_pe", "event"], "message_id"), "message")

    def migration_episode(self, executions: DataFrame, instances: DataFrame) -> DataFrame:
        arrays = [c for c, _, n in self.symbols.collections if n >= 1]
        mobile = instances.where(F.col("collection_id").isin(arrays)).select("instance_id", "collection_id")
        return migrations(executions, mobile)

    def user_event(self) -> DataFrame:
        id_ = L.token(1)
        point = self.of(L.POINT).select("pe", "code", id_.alias("id"), L.token(3).alias("event"), F.lit(None).alias("nested"), L.token(2).alias("s"))
        supplied = self.of(L.SUPPLIED).select("pe", "code", L.token(2).alias("s"), id_.alias("datum"))
        noted = self.of(L.NOTE).select("pe", "code", id_.alias("s"), L.note(L.after(2)).alias("note"))
        bracketed = self.of(L.BRACKETED_NOTE).select("pe", "code", id_.alias("s"), L.token(2).alias("e"), L.token(3).alias("event"), L.note(L.after(4)).alias("note"))
        all_ = point.unionByName(supplied, True).unionByName(noted, True).unionByName(bracketed, True).unionByName(self.bracket_events(), True)
        named = all_.join(_named(self.spark, self.symbols.events, "id"), "id", "left")
        return conform(named.select(
            F.col("pe").alias("pe_id"), F.col("code").alias("record_type"), F.col("id").alias("user_event_id"), "name", "event", F.col("nested").alias("nested_id"), self.aligned(F.col("s")).alias("start_time_us"),
            self.aligned(F.col("e")).alias("end_time_us"), (F.col("e") - F.col("s")).alias("duration_us"), F.col("datum").alias("user_supplied_int"), "note",
        ), "user_event")

    def bracket_events(self) -> DataFrame:
        """Pairs by serial, and nested brackets by (event, nested id); open ones have no end."""
        fields = ["pe", "line_no", "code"]
        records = self.of(L.PAIR, L.BRACKET_BEGIN, L.BRACKET_END).select(*fields, L.token(1).alias("id"), L.token(2).alias("s"), L.token(3).alias("event"), L.token(5).alias("nested"))
        pairs = toggles(records.where(F.col("code") == L.PAIR), ["pe", "event"], "line_no", ["s"])
        nested = brackets(records.where(F.col("code") != L.PAIR), ["pe", "id", "nested"], "line_no", F.col("code") == L.BRACKET_BEGIN, ["s"])
        return pairs.withColumn("matched", F.lit(True)).unionByName(nested.withColumn("end", F.struct(F.col("end.s").alias("s")))).select("pe", "code", "id", "event", "nested", "s", F.col("end.s").alias("e"))

    def simulation_step(self) -> DataFrame:
        rows = self.bracket_events().where(F.col("id") == self.step_event)
        return fold_steps(rows.select(F.col("nested").alias("step_id"), F.col("pe").alias("pe_id"), self.aligned(F.col("s")).alias("start_time_us"), self.aligned(F.col("e")).alias("end_time_us")))

    def user_stat(self) -> DataFrame:
        real = lambda i: F.coalesce(F.get("tok", F.lit(i)).try_cast("double"), F.lit(0.0))
        rows = self.of(L.STAT).select("pe", L.token(1).alias("time"), real(2).alias("own"), real(3).alias("value"), L.token(5).alias("id")).join(_named(self.spark, self.symbols.stats, "id"), "id", "left")
        return conform(rows.select(
            F.col("pe").alias("pe_id"), F.col("id").alias("stat_id"), "name", self.aligned(F.col("time")).alias("time_us"), F.col("value").alias("stat_value"), F.when(F.col("own") != -1.0, F.col("own")).alias("user_time_s"),
        ), "user_stat")

    def memory_sample(self) -> DataFrame:
        return conform(self.of(L.MEMORY).select(F.col("pe").alias("pe_id"), self.aligned(L.token(2)).alias("time_us"), L.token(1).alias("bytes")), "memory_sample")

    def tables(self, instances: DataFrame | None = None, executions: DataFrame | None = None) -> dict[str, DataFrame]:
        """All 13 tables; instances and executions may be given as they were written."""
        instances = self.chare_instance() if instances is None else instances
        executions = self.execution(instances) if executions is None else executions
        return self.symbols.tables(self.spark) | {
            "processing_element": self.processing_element(), "chare_instance": instances, "execution": executions, "message": self.message(), "idle_interval": self.idle_interval(),
            "migration_episode": self.migration_episode(executions, instances), "user_event": self.user_event(), "simulation_step": self.simulation_step(), "user_stat": self.user_stat(), "memory_sample": self.memory_sample(),
        }


def _receive(i: int) -> Column:
    """A receive time; unset (all bits set, in either spelling) is NULL, a missing one 0."""
    raw = F.get("tok", F.lit(i))
    return F.when(raw.isin("-1", L.UNSET), F.lit(None)).otherwise(F.coalesce(raw.try_cast("bigint"), F.lit(0).cast("bigint")))


def migrations(executions: DataFrame, mobile: DataFrame, slice_us: int = 10_000_000) -> DataFrame:
    """Episodes of instances of ``mobile`` (instance_id, collection_id) that run on another PE than before.

    Executions of an instance are ordered by start, PE and serial.  The order is
    cut in slices of time; the last execution of a slice is carried to the next
    one that has any, so that no instance is one task.
    """
    rows = executions.where(F.col("instance_id").isNotNull()).select("instance_id", "pe_id", "event", F.col("start_time_us").alias("s"), F.col("end_time_us").alias("e"))
    rows = rows.join(mobile.groupBy("instance_id").agg(F.first("collection_id").alias("collection_id")), "instance_id").withColumn("slice", F.floor(F.col("s") / slice_us))
    order = ["s", "pe_id", "event", "e"]
    tail = rows.groupBy("instance_id", "slice").agg(F.max(F.struct(*order)).alias("tail"))
    carried = tail.select("instance_id", "slice", F.lag("tail").over(W.partitionBy("instance_id").orderBy("slice")).alias("carried"))
    inside = W.partitionBy("instance_id", "slice").orderBy(*order)
    moved = rows.join(carried, ["instance_id", "slice"]).withColumn("before", F.coalesce(F.lag(F.struct(*order)).over(inside), F.col("carried"))).where(F.col("before.pe_id") != F.col("pe_id"))
    episodes = moved.select(
        "instance_id", "collection_id", F.col("before.pe_id").alias("src_pe"), F.col("pe_id").alias("dst_pe"), F.col("before.e").alias("last_exec_end_src_us"), F.col("s").alias("first_exec_start_dst_us"),
        (F.col("s") - F.col("before.e")).alias("gap_us"), "event",
    )
    sequence = F.row_number().over(W.partitionBy("instance_id").orderBy("first_exec_start_dst_us", "dst_pe", "event"))
    return conform(numbered(episodes.withColumn("migration_seq", sequence), ["instance_id", "migration_seq"], "migration_id"), "migration_episode")


def fold_steps(rows: DataFrame) -> DataFrame:
    """(step_id, pe_id, start, end) folded to a row per step and PE, with the step's extent over all PEs."""
    of_pe = rows.groupBy("step_id", "pe_id").agg(F.min("start_time_us").alias("start_time_us"), F.max("end_time_us").alias("end_time_us"))
    whole = of_pe.groupBy("step_id").agg(F.min("start_time_us").alias("global_start_time_us"), F.max("end_time_us").alias("global_end_time_us"), F.count(F.lit(1)).alias("pe_count"))
    return conform(of_pe.join(whole, "step_id").withColumn("duration_us", F.col("end_time_us") - F.col("start_time_us")), "simulation_step")


def step_attribution(executions: DataFrame, steps: DataFrame, slice_us: int = 10_000_000) -> DataFrame:
    """Executions with the steps whose interval on their own PE contains them.

    A range join by slices of time: a step stands in every slice it touches, an
    execution in the slice of its start.
    """
    at = F.floor(F.col("start_time_us") / slice_us)
    own = steps.where(F.col("end_time_us") >= F.col("start_time_us")).select(
        "step_id", "pe_id", F.col("start_time_us").alias("_s"), F.col("end_time_us").alias("_e"), F.explode(F.sequence(at, F.floor(F.col("end_time_us") / slice_us))).alias("_slice")
    )
    rows = executions.withColumn("_slice", at).join(own, ["pe_id", "_slice"])
    return rows.where((F.col("start_time_us") >= F.col("_s")) & (F.col("end_time_us") <= F.col("_e"))).drop("_s", "_e", "_slice")
