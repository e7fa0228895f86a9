"""Writing the trace tables."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.rebuild import Reconstruction
from weftline.sources.logs import discover, read_lines

ROW_GROUP_ROWS = 100_000


#: Tables written at the same time: most are small, and wait for their own few tasks.
AT_ONCE = 6


def write_tables(tables: dict[str, DataFrame], folder: str, *, compression: str = "zstd", partitions: int | None = None) -> None:
    """Each table as ``folder/<name>.parquet``.

    Tables with a start time are laid out by (PE, start), so that filters on
    either skip row groups.
    """

    def write(named: tuple[str, DataFrame]) -> None:
        name, out = named
        layout = [c for c in ("pe_id", "start_time_us") if c in out.columns]
        if len(layout) == 2:
            out = (out.repartitionByRange(partitions, *layout) if partitions else out.repartitionByRange(*layout)).sortWithinPartitions(*layout)
        out.write.mode("overwrite").option("compression", compression).option("parquet.block.row.count.limit", ROW_GROUP_ROWS).parquet(f"{folder}/{name}.parquet")

    with ThreadPoolExecutor(AT_ONCE) as pool:
        list(pool.map(write, tables.items()))


def convert(spark: SparkSession, logs: str, folder: str, *, step_event: str = "SimulationStep", compression: str = "zstd") -> None:
    """A trace directory into the 13 tables, and the counters' names."""
    symbols, (start, _), files = discover(spark, logs)
    run = Reconstruction(read_lines(spark, files), symbols, start, symbols.event_id(step_event), stage=True)
    names = spark.createDataFrame([(i, n) for i, n in symbols.papi_names.items() if n], "idx int, name string")
    instances = run.chare_instance()
    write_tables({"execution": run.execution(instances)}, folder, compression=compression)
    # Migrations are read off the executions as they were written, which are not put together a second time.
    written = spark.read.parquet(f"{folder}/execution.parquet")
    others = {n: t for n, t in run.tables(instances, written).items() if n != "execution"}
    write_tables(others | {"papi_counter": names.where(F.col("idx").isNotNull())}, folder, compression=compression)


def main(argv: list[str] | None = None) -> None:
    """``python -m weftline.sources.sink -l LOGS -o OUT [-s STEP_EVENT]``"""
    import argparse

    p = argparse.ArgumentParser(description="Convert a trace directory to tables")
    p.add_argument("-l", "--logs", required=True)
    p.add_argument("-o", "--output", required=True)
    p.add_argument("-s", "--step-event", default="SimulationStep")
    a = p.parse_args(argv)
    convert(SparkSession.builder.getOrCreate(), a.logs, a.output, step_event=a.step_event)


if __name__ == "__main__":
    main()
