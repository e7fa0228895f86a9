"""Queries of the text and quantile problems (pN_...)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm.leakage import leaks
from weftline.llm.packing import CAPACITY, GROUP, fill, pack, token_counts
from weftline.llm.relative_quantiles import merge_sketches, quantiles, sketch_by
from weftline.llm.sentences import sentences

#: Stretch of the run that a sketch covers.
STRETCH_US = 25_000_000


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _durations(spark: SparkSession, folder: str) -> DataFrame:
    rows = _table(spark, folder, "execution").select("ep_id", "pe_id", F.floor(F.col("start_time_us") / STRETCH_US).alias("stretch"), (F.col("end_time_us") - F.col("start_time_us")).alias("duration_us"))
    return rows.where(F.col("duration_us") >= 0)


def p2_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles of an entry method on a PE for each stretch of the run, and (stretch -1) for all stretches put together."""
    keys = ["ep_id", "pe_id", "stretch"]
    stretches = sketch_by(_durations(spark, folder), keys, "duration_us")
    whole = merge_sketches(stretches, keys[:2], salts=16).withColumn("stretch", F.lit(-1).cast("bigint"))
    return quantiles(stretches.unionByName(whole), keys)


def p2_within(spark: SparkSession, folder: str) -> DataFrame:
    """(ep_id, pe_id, stretch, n, greatest, exact_bounds): whether all of a key's percentiles lie within the bound that they come with, counted over all rows."""
    keys = ["ep_id", "pe_id", "stretch"]
    rows = _durations(spark, folder)
    rows = rows.unionByName(rows.withColumn("stretch", F.lit(-1).cast("bigint"))).groupBy(*keys, "duration_us").agg(F.count(F.lit(1)).alias("c"))
    got = p2_percentiles(spark, folder)
    below = lambda c: F.coalesce(F.sum(F.when(F.col("duration_us") < F.col(c), F.col("c"))), F.lit(0))
    upto = lambda c: F.coalesce(F.sum(F.when(F.col("duration_us") <= F.col(c), F.col("c"))), F.lit(0))
    names = {"p50": 0.5, "p90": 0.9, "p99": 0.99, "p99_9": 0.999}
    counted = rows.join(got, keys).groupBy(*keys, "n", "greatest", *names, *[f"{c}_rank_error" for c in names]).agg(
        F.sum("c").alias("rows"), F.max("duration_us").alias("top"), *[below(c).alias(f"{c}_below") for c in names], *[upto(c).alias(f"{c}_upto") for c in names]
    )
    off = lambda c, q: F.greatest(F.lit(0.0), F.col(f"{c}_below") + 1 - F.ceil(F.col("n") * q), F.ceil(F.col("n") * q) - F.col(f"{c}_upto")) / F.col("n")
    bounds = reduce(lambda a, b: a & b, [off(c, q) <= F.col(f"{c}_rank_error") + 1e-12 for c, q in names.items()])
    return counted.select(*keys, "n", "greatest", (bounds & (F.col("rows") == F.col("n")) & (F.col("top") == F.col("greatest"))).alias("exact_bounds"))


def p7_packed(spark: SparkSession, folder: str) -> DataFrame:
    return pack(_table(spark, folder, "documents"))


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    return fill(p7_packed(spark, folder))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return p7_packed(spark, folder).where(F.col("parts") > 1).select("doc_id").distinct()


def p7_sound(spark: SparkSession, folder: str) -> DataFrame:
    """(rule, n): texts that were packed, and violations of what the packing promises."""
    docs = _table(spark, folder, "documents")
    packed = p7_packed(spark, folder)
    containers = fill(packed)
    counted = token_counts(docs, "doc_id", "text").groupBy("id").agg(F.sum("tokens").alias("want")).where(F.col("want") > 0)
    own = packed.groupBy(F.col("doc_id").alias("id")).agg(F.sum("tokens").alias("got"), F.max("parts").alias("parts"), F.max("tokens").alias("most"))
    both = counted.join(own, "id", "full")
    group = containers.groupBy("step_group").agg(F.sum("work").alias("work"), F.count(F.lit(1)).alias("n")).where(F.col("n") == GROUP)
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("rule"), "n")
    rules = [
        count(packed.where("part = 0"), "texts"), count(containers.where(F.col("tokens") > CAPACITY), "container too full"), count(both.where(~F.col("want").eqNullSafe(F.col("got"))), "tokens lost or repeated"),
        count(both.where((F.col("parts") > 1) & (F.col("want") <= CAPACITY)), "text split in vain"), count(packed.groupBy("container", "pack", "context").agg(F.sum("tokens").alias("t")).where(F.col("t") > F.col("context")), "pack beyond its context"),
        containers.agg((F.sum("unused") > CAPACITY + 0.01 * F.sum("tokens")).cast("bigint").alias("n")).select(F.lit("container space unused").alias("rule"), "n"),
        group.agg(F.coalesce((F.max("work") > 1.5 * F.min("work")).cast("bigint"), F.lit(0).cast("bigint")).alias("n")).select(F.lit("step group out of balance").alias("rule"), "n"),
    ]
    return reduce(DataFrame.unionByName, rules)


def p8_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaks(_table(spark, folder, "documents"), _table(spark, folder, "eval_items"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_leaks(spark, folder).select("doc_id", "item_id")


def p8_verbatim(spark: SparkSession, folder: str) -> DataFrame:
    """The leaks whose item stands in the document letter by letter."""
    docs, items = _table(spark, folder, "documents").select("doc_id", "text"), _table(spark, folder, "eval_items").select("item_id", F.col("text").alias("item_text"))
    wording = F.regexp_replace("item_text", r"^[^\n]*\n\n", "")
    return p8_found(spark, folder).join(docs, "doc_id").join(items, "item_id").where(F.contains("text", wording)).select("doc_id", "item_id").distinct()


def p9_units(spark: SparkSession, folder: str) -> DataFrame:
    return sentences(_table(spark, folder, "documents"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return p9_units(spark, folder).select("doc_id", "start_char", "end_char").distinct()


#: White space of any script, as a class that all engines read alike.
SPACE = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def p9_letters(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, letters, first_char, last_char, unsound): characters of a document's units but white space, where units begin and end, and units that overlap the one before or are not trimmed."""
    units = p9_units(spark, folder)
    at = W.partitionBy("doc_id").orderBy("unit_no")
    trimmed = F.regexp_replace("unit", f"^{SPACE}+|{SPACE}+$", "")
    wrong = (F.col("start_char") < F.lag("end_char", 1, 0).over(at)) | (F.length("unit") != F.col("end_char") - F.col("start_char")) | (trimmed != F.col("unit")) | (F.col("unit") == "")
    rows = units.select("doc_id", "start_char", "end_char", F.length(F.regexp_replace("unit", SPACE, "")).alias("letters"), wrong.cast("bigint").alias("wrong"))
    return rows.groupBy("doc_id").agg(F.sum("letters").alias("letters"), F.min("start_char").alias("first_char"), F.max("end_char").alias("last_char"), F.sum("wrong").alias("unsound"))


QUERIES = {
    "p2_percentiles": p2_percentiles, "p2_within": p2_within, "p7_found": p7_found, "p7_packed": p7_packed, "p7_containers": p7_containers, "p7_sound": p7_sound,
    "p8_found": p8_found, "p8_leaks": p8_leaks, "p8_verbatim": p8_verbatim, "p9_found": p9_found, "p9_units": p9_units, "p9_letters": p9_letters,
}
#: SQL cannot express the others; they are tested against brute force.  These compare what SQL can say of them, over whole tables.
SQL: dict[str, str] = {
    "p2_within": """WITH d AS (SELECT ep_id, pe_id, (start_time_us // 25000000)::BIGINT AS stretch, end_time_us - start_time_us AS v FROM execution WHERE end_time_us >= start_time_us)
SELECT ep_id, pe_id, stretch, count(*) AS n, max(v) AS greatest, true AS exact_bounds FROM (FROM d UNION ALL SELECT ep_id, pe_id, -1, v FROM d) GROUP BY ALL""",
    "p7_sound": """SELECT 'texts' AS rule, count(*) AS n FROM documents WHERE text <> '' UNION ALL SELECT r, 0 FROM (VALUES ('container too full'), ('tokens lost or repeated'), ('text split in vain'),
  ('pack beyond its context'), ('container space unused'), ('step group out of balance')) v(r)""",
    "p8_verbatim": """SELECT DISTINCT doc_id, item_id FROM documents d JOIN (SELECT item_id, regexp_replace(text, '^[^\n]*\n\n', '') AS w FROM eval_items) i ON contains(d.text, i.w)""",
    "p9_letters": f"""WITH t AS (SELECT doc_id, text, regexp_replace(text, '^{SPACE}+', '') AS led, regexp_replace(text, '{SPACE}+$', '') AS ended, regexp_replace(text, '{SPACE}', '', 'g') AS letters FROM documents)
SELECT doc_id, length(letters)::BIGINT AS letters, (length(text) - length(led))::BIGINT AS first_char, length(ended)::BIGINT AS last_char, 0::BIGINT AS unsound FROM t WHERE length(letters) > 0""",
}
