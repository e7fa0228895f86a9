"""Trace directories: per-PE text logs, plain or gzipped, as lines and typed records.

A record is a line of white-space separated numbers whose first is its type.
Missing or malformed numbers count as 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.sources.symbols import Symbols, parse_clock, parse_symbols

LOG_NAME = r"\.(\d+)\.log(\.gz)?$"
# Record types.
CREATION, BEGIN, END, BEGIN_COMPUTATION, END_COMPUTATION = 1, 2, 3, 6, 7
POINT, BEGIN_IDLE, END_IDLE, CREATION_BCAST, CREATION_MULTICAST = 13, 14, 15, 20, 21
SUPPLIED, MEMORY, NOTE, BRACKETED_NOTE, STAT = 26, 27, 28, 29, 32
BRACKET_BEGIN, BRACKET_END, PAIR = 98, 99, 100
KNOWN = (
    CREATION, BEGIN, END, BEGIN_COMPUTATION, END_COMPUTATION, POINT, BEGIN_IDLE, END_IDLE, CREATION_BCAST, CREATION_MULTICAST, SUPPLIED, MEMORY, NOTE, BRACKETED_NOTE, STAT, BRACKET_BEGIN, BRACKET_END, PAIR,
)
#: Bits of a line's number for its row in a scan's task; the rest is its split's start in KiB.
SPLIT_BITS = 31
#: The unset receive time as an unsigned number.
UNSET = "18446744073709551615"


def discover(spark: SparkSession, folder: str) -> tuple[Symbols, tuple[int, int], list[str]]:
    """Symbols, clock and log files of a directory; other files are ignored."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(str(f.getPath().toString()) for f in files.listStatus(path(folder)) if f.isFile())
    read = lambda p: "\n".join(r.value for r in spark.read.option("lineSep", "\n").text(p).toLocalIterator())
    import re

    sts = next((n for n in names if n.endswith(".sts")), None)
    clock = next((n for n in names if n.endswith(".projrc")), None)
    logs = [n for n in names if re.search(LOG_NAME, n)]
    return (parse_symbols(read(sts)) if sts else Symbols()), (parse_clock(read(clock)) if clock else (0, 0)), logs


def read_lines(spark: SparkSession, logs: list[str]) -> DataFrame:
    """(pe, line_no, value): lines without the header line, numbered in file order, with steps.

    A number is made of the place of the line's split in the file and of its row
    in the scan, so that a file of any size is many tasks and nothing is
    shuffled.  Empty lines are left out.
    """
    if not logs:
        return spark.createDataFrame([], "pe int, line_no bigint, value string")
    # One column without quotes or escapes; the reader leaves out each file's first line.
    whole = spark.read.schema("value string").options(sep="\u0001", header=True, quote="", escape="", enforceSchema=True, nullValue="", maxCharsPerColumn=-1).csv(logs)
    raw = whole.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    line = F.shiftleft(F.shiftright("block", 10), SPLIT_BITS).bitwiseOR(F.col("at").bitwiseAND(F.lit((1 << SPLIT_BITS) - 1)))
    return raw.where(F.col("value").isNotNull()).select(F.regexp_extract("path", LOG_NAME, 1).cast("int").alias("pe"), (line + 2).alias("line_no"), "value")  # the header is line 1


def token(i: int | Column) -> Column:
    """Number at a place of the line, 0 if missing."""
    at = F.lit(i) if isinstance(i, int) else i
    return F.coalesce(F.get("tok", at).try_cast("bigint"), F.lit(0).cast("bigint"))


def tokens(lines: DataFrame) -> DataFrame:
    """Lines with their tokens and type; empty lines are dropped."""
    tok = F.split(F.trim("value"), r"\s+")
    return lines.where(F.trim("value") != "").withColumn("tok", tok).withColumn("code", F.get("tok", F.lit(0)).try_cast("int"))


def note(text: Column) -> Column:
    """A length-prefixed string: so many bytes after the number, fewer if the line ends."""
    length = F.coalesce(F.regexp_extract(text, r"^\s*(\d+)", 1).try_cast("int"), F.lit(0))
    rest = F.regexp_replace(text, r"^\s*\d+", "")
    return F.decode(F.substring(F.encode(rest, "UTF-8"), F.lit(1), length), "UTF-8")


def after(n: int) -> Column:
    """The line behind its first n tokens."""
    return F.regexp_replace(F.ltrim("value"), rf"^(?:\S+\s+){{{n - 1}}}\S+", "")
