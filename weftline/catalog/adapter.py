"""The test tables as a run, with what they lack derived from them.

``events`` gives application statistics, user events and steps; ``execution``
and ``message`` give log lines for the parser.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.catalog.tables import table
from weftline.operators.rebuild import Reconstruction, conform, fold_steps, migrations
from weftline.plans.store import Folder, scratch
from weftline.sources.dataset import TraceDataset
from weftline.sources.sink import convert
from weftline.sources.symbols import VERSION, Symbols

TYPES = ["click", "error", "purchase", "signup", "view"]
ORIGIN_US = 1_704_067_200_000_000
HALF = 2  # runs that the execution table is split into, by PE parity


def events(spark: SparkSession, folder: str) -> DataFrame:
    """(pe_id, event, kind, k, s, e, value): events as spans of 16 PEs."""
    raw = table(spark, folder, "events")
    start = F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(ORIGIN_US)
    return raw.select(
        (F.col("user_id") % 16).cast("int").alias("pe_id"), F.col("event_id").cast("int").alias("event"), (F.array_position(F.array(*[F.lit(t) for t in TYPES]), F.col("event_type")) - 1).cast("int").alias("kind"),
        F.col("event_type").alias("name"), F.get_json_object("props", "$.k").cast("bigint").alias("k"), start.alias("s"), (start + F.round(F.col("value") * 1e6).cast("bigint")).alias("e"), "value",
    )


def user_stat(spark: SparkSession, folder: str) -> DataFrame:
    e = events(spark, folder)
    return conform(e.select("pe_id", F.col("kind").alias("stat_id"), "name", F.col("s").alias("time_us"), F.col("value").alias("stat_value"), F.when(F.col("k") % 2 == 0, F.col("k").cast("double")).alias("user_time_s")), "user_stat")


def steps(spark: SparkSession, folder: str) -> DataFrame:
    return fold_steps(events(spark, folder).select(F.floor(F.col("s") / 86_400_000_000).alias("step_id"), "pe_id", F.col("s").alias("start_time_us"), F.col("e").alias("end_time_us")))


def mobile(spark: SparkSession, folder: str) -> DataFrame:
    arrays = table(spark, folder, "chare_collection").where("ndims >= 1").select("collection_id")
    return table(spark, folder, "chare_instance").select("instance_id", "collection_id").distinct().join(arrays, "collection_id", "left_semi")


def dataset(spark: SparkSession, folder: str) -> TraceDataset:
    names = ["processing_element", "chare_collection", "entry_method", "chare_instance", "execution", "message", "idle_interval", "memory_sample"]
    tables = {n: lambda n=n: table(spark, folder, n) for n in names}
    tables["user_stat"] = lambda: user_stat(spark, folder)
    tables["simulation_step"] = lambda: steps(spark, folder)
    return TraceDataset(spark, tables | {"migration_episode": lambda: episodes(spark, folder)}, where=folder)


def half(ds: TraceDataset, parity: int) -> TraceDataset:
    """A run of the PEs of one parity, to compare runs with."""
    return TraceDataset(ds.spark, ds.tables | {"execution": ds.execution.where(F.col("pe_id") % HALF == parity)}, where=f"{ds.where}#{parity}")


def episodes(spark: SparkSession, folder: str) -> DataFrame:
    return migrations(table(spark, folder, "execution").dropDuplicates(["pe_id", "event"]), mobile(spark, folder))


def symbols(spark: SparkSession, folder: str) -> Symbols:
    """The symbol table of the run; symbol tables are small by nature."""
    rows = lambda n, c: [tuple(r) for r in table(spark, folder, n).select(*c).orderBy(*c).toLocalIterator()]
    return Symbols(
        processors=48, papi_total=2, papi_names={0: "cycles", 1: "misses"}, collections=rows("chare_collection", ["collection_id", "name", "ndims"]),
        methods=rows("entry_method", ["ep_id", "name", "collection_id", "msg_idx"]), events={i: t for i, t in enumerate(TYPES)}, stats={i: t for i, t in enumerate(TYPES)},
    )


#: Clock of the run's start in log lines, which the tables' times are taken from.
CLOCK = 7_000_000


def log_lines(spark: SparkSession, folder: str, start: int = 0) -> DataFrame:
    """A begin line of every execution, an end line where it ends, and the messages' creation lines, by a clock that shows ``start`` at the run's start.

    Every fifth message goes to a list of PEs.
    """
    s = symbols(spark, folder)
    layout = spark.createDataFrame([(e, n if n >= 1 else 4) for e, _, n in s.layout()], "ep_id int, arity int")
    names = ["instance_id", "ep_id", "src_pe", "msg_idx", "msg_len", "start_time_us", "recv_time_us", "start_cpu_us", "end_time_us", "end_cpu_us", "papi_begin_0", "papi_begin_1", "papi_end_0", "papi_end_1"]
    runs = table(spark, folder, "execution").groupBy("pe_id", "event").agg(*[F.max(c).alias(c) for c in names])
    runs = runs.join(F.broadcast(layout), "ep_id", "left").withColumn("arity", F.coalesce("arity", F.lit(4)))  # a row per registered method
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    text = lambda *c: F.concat_ws(" ", *[x.cast("string") for x in c])
    begin = text(
        F.lit(2), F.col("msg_idx"), F.col("ep_id"), F.col("start_time_us") + start, F.col("event"), F.col("src_pe"), F.col("msg_len"), F.coalesce(F.col("recv_time_us") + start, F.lit(-1)), zero("instance_id"),
        F.when(F.col("arity") > 1, F.array_join(F.array_repeat(F.lit("0"), F.col("arity") - 1), " ")), zero("start_cpu_us"), zero("papi_begin_0"), zero("papi_begin_1"),
    )
    end = text(F.lit(3), F.col("msg_idx"), F.col("ep_id"), F.col("end_time_us") + start, F.col("event"), F.col("pe_id"), F.col("msg_len"), zero("end_cpu_us"), zero("papi_end_0"), zero("papi_end_1"))
    line = lambda no, value: F.struct(no.cast("bigint").alias("line_no"), value.alias("value"))
    run_lines = runs.select(F.col("pe_id").alias("pe"), F.explode(F.array(line(F.col("event") * 2, begin), line(F.col("event") * 2 + 1, F.when(F.col("end_time_us").isNotNull(), end)))).alias("l")).select("pe", "l.line_no", "l.value").where(F.col("value").isNotNull())
    sent = table(spark, folder, "message").groupBy("message_id").agg(*[F.max(c).alias(c) for c in ("src_pe", "event", "ep_id", "msg_idx", "msg_len", "send_time_us", "enqueue_time_us", "is_broadcast", "broadcast_fanout")])
    created = text(
        F.when(F.col("is_broadcast"), 20).when(F.col("message_id") % 5 == 0, 21).otherwise(1), F.col("msg_idx"), F.col("ep_id"), F.col("send_time_us") + start, F.col("event"), F.col("src_pe"), F.col("msg_len"),
        F.coalesce(F.when(F.col("enqueue_time_us") > 0, F.col("enqueue_time_us") + start), F.lit(0)), F.when(F.col("is_broadcast"), zero("broadcast_fanout").cast("string")).when(F.col("message_id") % 5 == 0, F.lit("2 0 1")),
    )
    return run_lines.unionByName(sent.select(F.col("src_pe").alias("pe"), (F.lit(1 << 40) + F.col("message_id")).alias("line_no"), created.alias("value")))


def event_lines(spark: SparkSession, folder: str) -> DataFrame:
    """User-event, idle, statistics and memory lines from ``events``: several records to an event, in event order."""
    e = events(spark, folder)
    text = lambda *c: F.concat_ws(" ", *[x.cast("string") for x in c])
    nested = F.col("event") % 2
    bracket = text(F.when(F.col("kind") >= 3, 99).otherwise(98), F.col("event") % 3, F.col("s"), F.col("event"), F.lit(0), nested)
    idle = text(F.when(F.col("kind") % 2 == 0, 14).otherwise(15), F.col("s"), F.col("pe_id"))
    pair = text(F.lit(100), F.col("kind"), F.col("s"), F.col("k") % 10, F.lit(0), nested)
    stat = text(F.lit(32), F.col("s"), F.when(F.col("k") % 2 == 0, F.col("k").cast("double")).otherwise(-1), F.col("value"), F.col("pe_id"), F.col("kind"))
    memory = text(F.lit(27), F.col("k") * 1_048_576, F.col("s"))
    note_text = F.concat(F.lit("ü "), F.col("name"))
    noted = text(F.lit(28), F.col("s"), F.concat(F.octet_length(note_text).cast("string"), note_text))
    supplied = text(F.lit(26), F.col("k"), F.col("s"))
    bracketed = text(F.lit(29), F.col("s"), F.col("e"), F.col("event"), F.concat(F.octet_length(note_text).cast("string"), note_text, F.lit(" more")))
    point = text(F.lit(13), F.col("kind"), F.col("s"), F.col("event"), F.col("pe_id"))
    all_ = F.array(bracket, idle, pair, stat, memory, noted, point, supplied, bracketed)
    return e.select(F.col("pe_id").alias("pe"), "event", F.posexplode(all_).alias("i", "value")).select("pe", (F.col("event").cast("bigint") * 16 + F.col("i")).alias("line_no"), "value")


def element_lines(spark: SparkSession, folder: str, start: int) -> DataFrame:
    """A line of each begin of a PE's computation, and one of its end where it has one."""
    text = lambda *c: F.concat_ws(" ", *[x.cast("string") for x in c])
    line = lambda no, value: F.struct(F.lit(no).cast("bigint").alias("line_no"), value.alias("value"))
    end = F.when(F.col("end_time_us").isNotNull(), text(F.lit(7), F.col("end_time_us") + start))
    rows = table(spark, folder, "processing_element").select(F.col("pe_id").alias("pe"), F.explode(F.array(line(0, text(F.lit(6), F.col("begin_time_us"))), line(1 << 41, end))).alias("l"))
    return rows.select("pe", "l.line_no", "l.value").where(F.col("value").isNotNull())


def rebuilt(spark: SparkSession, folder: str) -> Reconstruction:
    return Reconstruction(log_lines(spark, folder, CLOCK), symbols(spark, folder), CLOCK, stage=True)


def global_start(spark: SparkSession, folder: str) -> int:
    """The run's start by the elements' clock: one small aggregate."""
    return table(spark, folder, "processing_element").agg(F.min("global_start_us")).first()[0] or 0


def rebuilt_elements(spark: SparkSession, folder: str) -> DataFrame:
    start = global_start(spark, folder)
    return Reconstruction(element_lines(spark, folder, start), symbols(spark, folder), start).processing_element()


def symbol_text(s: Symbols) -> str:
    """A symbol table as a trace directory holds it."""
    lines = [f'VERSION "{VERSION}"', f"PROCESSORS {s.processors}", f"TOTAL_PAPI_EVENTS {s.papi_total}", *[f"PAPI_EVENT {i} {n}" for i, n in s.papi_names.items()]]
    lines += [f'CHARE {c} "{n}" {d}' for c, n, d in s.collections] + [f'ENTRY CHARE {e} "{n}" {c} {m}' for e, n, c, m in s.methods] + [f"MESSAGE {i} {n}" for i, n in s.messages]
    return "\n".join([*lines, *[f"EVENT {i} {n}" for i, n in s.events.items()], *[f"STAT {i} {n}" for i, n in s.stats.items()], ""])


def log_folder(spark: SparkSession, lines: DataFrame, s: Symbols, start: int) -> str:
    """A trace directory: a file for each PE, as the format has it, the symbol table, the clock, and a stray file."""
    logs = Folder(spark, scratch(spark, "logs"))
    headers = lines.select("pe").distinct().select("pe", F.lit(-1).cast("bigint").alias("line_no"), F.lit("PROJECTIONS-RECORD 0").alias("value"))
    ordered = lines.select("pe", "line_no", "value").unionByName(headers).repartition("pe").sortWithinPartitions("pe", "line_no")
    ordered.select("pe", "value").write.partitionBy("pe").text(logs.at("parts"))
    for part in logs.names("parts"):
        for n, name in enumerate(f for f in logs.names(f"parts/{part}") if f.startswith("part-")):
            if n:
                raise ValueError("a PE's log is one file: its lines were written by several tasks")
            logs.rename(f"parts/{part}/{name}", f"run.{part.partition('=')[2]}.log")
    logs.delete("parts")
    logs.write("run.sts", symbol_text(s))
    logs.write("run.projrc", f"RC_GLOBAL_START_TIME {start}\nRC_GLOBAL_END_TIME 0\n")
    logs.write("notes.tar", "header\n2 0 0 1 1 0 0 0 0 0\n")
    return logs.address


def converted(spark: SparkSession, folder: str) -> TraceDataset:
    """The run written as a trace directory, converted from there, and opened."""
    logs = log_folder(spark, log_lines(spark, folder, CLOCK).unionByName(element_lines(spark, folder, CLOCK)), symbols(spark, folder), CLOCK)
    out = scratch(spark, "run")
    convert(spark, logs, out)
    return TraceDataset.open(spark, out)


def rebuilt_events(spark: SparkSession, folder: str) -> Reconstruction:
    return Reconstruction(event_lines(spark, folder), symbols(spark, folder), 0, 1)
