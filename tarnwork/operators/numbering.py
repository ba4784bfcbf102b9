"""Numbers and digests that follow an order over a whole table, strings included."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwork.sources.scratch import stored

SEGMENT = 1024  # rows, or digests, folded into one


def numbered(rows: DataFrame, *keys: str, into: str = "number") -> DataFrame:
    """``rows`` numbered from 0 in order of ``keys``; the result does not depend on partitions if no two rows share all keys.

    Ranges of the order are sorted where they lie and written once, each row with its
    place in its range; the sizes of the ranges, one row each, give where a range begins.
    Further keys split a range that one value of the first would fill.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    kept = stored(dealt.withColumn("__id", F.monotonically_increasing_id()), "numbered")
    part, place = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    before = F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
    begins = kept.groupBy(part.alias("__part")).agg(F.count("*").alias("__n")).select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    both = kept.withColumn("__part", part).join(begins, "__part")
    return both.select(*rows.columns, (F.col("__before") + place).alias(into))


def batched(numbers: DataFrame, size: int, number: str = "number") -> DataFrame:
    """(batch, slot) of numbered rows."""
    return numbers.withColumns({"batch": F.floor(F.col(number) / size), "slot": F.col(number) % size})


def ordered_digest(rows: DataFrame, key: str, content: str) -> DataFrame:
    """One row: n, and 16 hex digits over all (key, content) in order of key, then content.

    A change of any key, content or neighbourhood changes it; a change of partitions does
    not. Every row becomes a digest of its two lengths and texts; ``SEGMENT`` neighbours
    are folded into one, three times, and what is left is folded at the end, so that no
    task holds more than a segment below 10^12 rows. Nulls differ from empty texts.
    """
    shown = lambda c: F.concat(F.coalesce(F.octet_length(c).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(F.col(c), F.lit("")))
    texts = rows.select(F.col(key).cast("string").alias("key"), F.col(content).cast("string").alias("content"))
    each = texts.select("key", "content", F.sha2(F.concat(shown("key"), shown("content")), 256).alias("digest"))
    level = numbered(each, "key", "content").select(F.col("number").alias("at"), "digest", F.lit(1).cast("long").alias("n"))
    in_order = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "digest"))), lambda x: x["digest"]), "")
    for _ in range(3):
        level = level.groupBy(F.floor(F.col("at") / SEGMENT).alias("segment")).agg(F.sha2(in_order, 256).alias("digest"), F.sum("n").alias("n")).withColumnRenamed("segment", "at")
    whole = level.agg(in_order.alias("digests"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return whole.select("n", F.substring(F.sha1("digests"), 1, 16).alias("digest"))
