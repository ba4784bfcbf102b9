"""Content grouping, stratified largest-remainder splits, leakage and output names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SPLITS = ("train", "val", "test")
RATIOS = (0.8, 0.1, 0.1)


def seeded(seed: int, *cols: str) -> Column:
    """A deterministic order that depends on the seed and the key only."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]), 256)


def ranked_within(rows: DataFrame, keys: list[str], digest: str, ident: str, name: str) -> DataFrame:
    """``rows`` with ``name``, the rank from 1 inside ``keys`` by (digest, ident).

    Two-level: by the digest's first two hexadecimal digits, then inside them, so that one
    key with a third of all rows is 256 tasks and not one.
    """
    cut = rows.withColumn("__part", F.substring(digest, 1, 2))
    local = cut.withColumn("__local", F.row_number().over(W.partitionBy(*keys, "__part").orderBy(digest, ident)))
    sizes = cut.groupBy(*keys, "__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*keys, "__part", before.alias("__before"))
    return local.join(sizes, [*keys, "__part"]).withColumn(name, F.col("__before") + F.col("__local")).drop("__part", "__local", "__before")


def content_groups(files: DataFrame, ident: str, content: str) -> DataFrame:
    """``files`` with image_group: the hash of contents that some other file shares the size of.

    Contents are hashed where they are read; only sizes and hashes are shuffled, unless
    the caller asks for the contents themselves. A size met once stands for its file.
    """
    sized = files.withColumn("size", F.octet_length(content)).withColumn("__sha", F.sha2(F.col(content), 256))
    met = sized.groupBy("size").agg(F.count("*").alias("met")).repartition("met")  # an exchange of its own: a hot size can be split
    alone = F.concat(F.lit("file:"), F.col(ident).cast("string"))
    return sized.join(met, "size").withColumn("image_group", F.when(F.col("met") > 1, F.col("__sha")).otherwise(alone)).drop("met", "__sha")


def split_counts(n: Column) -> list[Column]:
    """How many of n go to train, val and test: largest remainder, each non-empty from n = 3 on.

    Ties of remainders go to the earlier split; what an empty split gets is taken from the largest.
    """
    exact = [n * F.lit(r) for r in RATIOS]
    base = [F.floor(x) for x in exact]
    rest = [x - b for x, b in zip(exact, base, strict=True)]
    left = n - sum(base[1:], base[0])
    counts = []
    for i in range(3):
        ahead = sum(((rest[j] > rest[i]) | ((rest[j] == rest[i]) & F.lit(j < i))).cast("int") for j in range(3) if j != i)
        counts.append(base[i] + (ahead < left).cast("int"))
    empty = [F.when((n >= 3) & (c == 0), 1).otherwise(0) for c in counts]
    taken = empty[0] + empty[1] + empty[2]
    top = F.greatest(*counts)
    donor = [counts[i] == top if i == 0 else (counts[i] == top) & F.greatest(*counts[:i], F.lit(-1)).__lt__(top) for i in range(3)]
    return [(c + e - F.when(d, taken).otherwise(0)).cast("long") for c, e, d in zip(counts, empty, donor, strict=True)]


def stratified_split(items: DataFrame, group: str, model: str, seed: int = 42) -> DataFrame:
    """``items`` with stratum and split; a content group never straddles splits.

    A stratum is the sorted set of all models of a group, so differently labelled copies
    stay together. Groups are ranked inside their stratum by a seeded hash. The ranking
    is two-level (hash prefix ranges inside a stratum), so that a stratum with a third of
    all groups is not one task.
    """
    groups = items.groupBy(group).agg(F.concat_ws(",", F.array_sort(F.collect_set(F.coalesce(model, F.lit("无"))))).alias("stratum"))
    ranked = ranked_within(groups.withColumn("h", seeded(seed, group)), ["stratum"], "h", group, "at")
    ranked = ranked.join(groups.groupBy("stratum").agg(F.count("*").alias("n")), "stratum")
    train, val, _ = split_counts(F.col("n"))
    at = F.col("at")
    named = ranked.select(group, "stratum", F.when(at <= train, SPLITS[0]).when(at <= train + val, SPLITS[1]).otherwise(SPLITS[2]).alias("split"))
    return items.join(named, group)


def split_leakage(items: DataFrame, ident: str, content: str, split: str = "split") -> DataFrame:
    """(sha256, size, n, n_splits): equal contents in two splits or more.

    Contents are hashed where they are read and combined map side; no content is shuffled.
    """
    hashed = items.select(ident, split, F.octet_length(content).alias("size"), F.sha2(F.col(content), 256).alias("sha256"))
    return hashed.groupBy("size", "sha256").agg(F.count("*").alias("n"), F.count_distinct(split).alias("n_splits"), F.min(ident).alias("example")).where("n_splits > 1")


def unique_stems(files: DataFrame, ident: str, stem: str) -> DataFrame:
    """``files`` with output_stem: case-insensitive collisions get a hash of the identifier.

    ``lower`` stands for case folding.
    """
    def counted(rows: DataFrame, name: str, n: str) -> DataFrame:
        """``rows`` with how many share a name: grouped counts, dealt anew so that a common name can be split."""
        keyed = rows.withColumn("__key", F.lower(name))
        return keyed.join(keyed.groupBy("__key").agg(F.count("*").alias(n)).repartition(n), "__key", "left").drop("__key")

    tail = F.substring(F.sha2(F.col(ident).cast("string"), 256), 1, 12)
    named = counted(files, stem, "__many")
    named = named.withColumn("output_stem", F.when(F.col("__many") > 1, F.concat_ws("_", F.col(stem), tail)).otherwise(F.col(stem)))
    named = counted(named, "output_stem", "__again")
    # hashes differ unless identifiers repeat, so what is ranked here are a few rows
    clash = named.where("__again > 1")
    rank = F.row_number().over(W.partitionBy(F.lower("output_stem")).orderBy(F.col(ident)))
    clash = clash.withColumn("__rank", rank).withColumn("output_stem", F.when(F.col("__rank") > 1, F.concat_ws("_", "output_stem", (F.col("__rank") - 1).cast("string"))).otherwise(F.col("output_stem"))).drop("__rank")
    return named.where(F.coalesce(F.col("__again") <= 1, F.lit(True))).unionByName(clash).drop("__many", "__again")


def split_summary(items: DataFrame, model: str, multi_rack: str) -> DataFrame:
    return items.groupBy("split").agg(F.count("*").alias("n"), F.count_distinct(model).alias("n_models"), F.count_if(F.col(model).isin("未知", "未知型号")).alias("n_external"), F.count_if(multi_rack).alias("n_multi_rack"))
