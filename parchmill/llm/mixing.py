"""Mix sources to target weights by Pareto order sampling, in SQL functions only.

Each source gets a target in words, and each of its documents an expected number of
copies, so that the expected words meet the target. The whole part of that number is
taken for certain. For the rest documents are ranked by the odds of a random number
over the odds of their inclusion, and taken in that order until the source's words
are reached: a sample whose size, in words, is fixed and whose chances are unequal.

A source may hold any share of the rows. Its cumulated sizes come from sums over
RANK_BUCKETS intervals of the rank; only documents of the one interval in which the
target falls are put in order, those of equal rank, id and size as one. Where only some
of such equals are taken, they are counted by partition and numbered in one of these.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchmill.session import scratch_path

RANK_BUCKETS = 4096
_RANDOM_BITS = 52


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(seed: int, id_value: Column) -> Column:
    """A number from 0 to below 1 that the seed and the id decide."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_value.cast("string"), F.lit(""))))
    bits = F.conv(F.substring(digest, 1, _RANDOM_BITS // 4), 16, 10).cast("long")
    return bits.cast("double") / F.lit(float(1 << _RANDOM_BITS))


def source_targets(
    sizes: DataFrame, weights: Sequence[float], cap: float, total: Column | None = None
) -> DataFrame:
    """source, source_size and target, from one row (source, source_size) a source.

    Sources in order of their code points, null last, take the weights in turn and
    share `total` (by default all sizes). Targets stop at `cap` times their source's
    size; the excess goes to the others by weight until none is above: sources fill up
    in order of cap over weight, and all that are left share what is left.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    turn = F.array(*[F.lit(float(w)) for w in weights])
    at = (F.row_number().over(by_name) - 1) % len(weights)
    rows = sizes.select(
        "source",
        "source_size",
        F.element_at(turn, (at + 1).cast("int")).alias("weight"),
        (F.col("source_size") * F.lit(float(cap))).alias("most"),
        (total if total is not None else F.sum("source_size").over(everything)).alias("total"),
    ).withColumn("fills_at", F.col("most") / F.col("weight"))
    order = Window.orderBy("fills_at", F.asc_nulls_last("source"))
    filled = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = rows.withColumn("level", (F.col("total") - filled) / left)
    # The level is that of the first source that does not fill up.
    open_level = F.when(F.col("level") < F.col("fills_at"), F.struct("fills_at", "source", "level"))
    rows = rows.withColumn("shared", F.min(open_level).over(everything)["level"])
    target = F.coalesce(F.least(F.col("shared") * F.col("weight"), F.col("most")), F.col("most"))
    return rows.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    size: Column,
    id_col: str = "doc_id",
    source_col: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    cap: int = 3,
    seed: int = 7,
    propensity: Column | None = None,
    row_col: str | None = None,
) -> DataFrame:
    """For each row its id, source, size, source_size, target (its source's) and
    copies, how often the mix takes it: 0 to `cap`. `row_col` names a further column
    that holds the row itself, as a struct.

    `size` and `propensity` are expressions over `docs`; sizes are whole and 0 or more
    (null: 0). A document's expected copies are in proportion to its propensity (1 if
    none is given or it is null or not positive), `cap` at most. The words taken miss
    the target by half of one document's size at most, unless the source's documents at
    `cap` copies are fewer than that. Ids decide the random numbers, so reruns agree;
    equal ranks go by id, then by size, and rows equal in both may change places.

    Sources are compared by code points; null is a source of its own, the last. Rows
    without words get their whole copies like others. Only columns named in the
    arguments are read, and all with `row_col`. An empty table gives an empty result.
    """
    spark = docs.sparkSession

    def stored(df: DataFrame, label: str) -> DataFrame:
        """A table of sources with a known size: Spark sends a small one to the rows, so
        that the rows are not shuffled by a source that most of them may have."""
        path = scratch_path(spark, f"mix-{label}")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    liking = F.lit(1.0) if propensity is None else propensity.cast("double")
    whole = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if row_col else []
    path = scratch_path(spark, "mix")
    docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{source_col}`").cast("string").alias("source"),
        F.coalesce(size.cast("long"), F.lit(0)).alias("size"),
        F.when(liking > 0, liking).otherwise(1.0).alias("liking"),
        uniform(seed, F.col(f"`{id_col}`")).alias("u"),
        F.monotonically_increasing_id().alias("place"),
        *whole,
    ).write.parquet(path)  # the texts are read once
    rows = spark.read.parquet(path)

    sizes = rows.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("liking")).alias("liked")
    )
    targets = source_targets(sizes.select("source", "source_size"), weights, cap)
    targets = targets.alias("t").join(
        sizes.select("source", "liked").alias("s"), F.col("t.source").eqNullSafe(F.col("s.source"))
    )
    targets = stored(targets.select("t.*", "s.liked"), "targets")

    def with_source(df: DataFrame, per_source: DataFrame) -> DataFrame:
        """Joined on the source; columns of `per_source` are new ones."""
        other = per_source.withColumnRenamed("source", "its_source")
        return df.join(other, F.col("source").eqNullSafe(F.col("its_source")), "left").drop("its_source")

    expected = F.when(
        F.col("liked") > 0,
        F.least(F.lit(float(cap)), F.col("target") * F.col("liking") / F.col("liked")),
    ).otherwise(0.0)
    rows = with_source(rows, targets).withColumn("expected", expected)
    rows = rows.withColumn("certain", F.floor("expected"))
    sure = rows.groupBy("source").agg(F.sum(F.col("certain") * F.col("size")).alias("sure"))
    rest = targets.join(
        sure.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2")), "left"
    ).select("source", (F.col("target") - F.col("sure")).alias("rest"))
    rows = with_source(rows, stored(rest, "rest"))

    chance = F.col("expected") - F.col("certain")
    usual = F.col("rest") / F.col("source_size")  # the mean chance, by words
    odds = (F.col("u") / (1 - F.col("u"))) / (chance / (1 - chance))
    rows = rows.withColumn(
        "rank",
        F.when(F.col("certain") >= cap, F.lit(None).cast("double"))
        .when(chance > 0, odds)
        .otherwise(F.lit(float("inf"))),
    )
    # About uniform, whatever the chances; the last interval also has the infinite ranks.
    spread = F.col("rank") * F.when((usual > 0) & (usual < 1), usual / (1 - usual)).otherwise(1.0)
    interval = F.when(F.col("rank") == float("inf"), RANK_BUCKETS).otherwise(
        F.least(F.floor(spread / (1 + spread) * RANK_BUCKETS), F.lit(RANK_BUCKETS - 1))
    )
    rows = rows.withColumn("interval", F.when(F.col("rank").isNotNull(), interval.cast("int")))

    # Rows of no chance or of a source that needs no more are not taken.
    ranked = F.coalesce((F.col("interval") < RANK_BUCKETS) & (F.col("rest") > 0), F.lit(False))
    sums = rows.where(ranked).groupBy("source", "interval")
    sums = sums.agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    upto = Window.partitionBy("source").orderBy("interval")
    sums = sums.withColumn("upto", F.sum("words").over(upto))
    # The first interval that ends beyond the target, and the words before it.
    border = sums.where("upto > rest").groupBy("source").agg(
        F.min("interval").alias("border"), F.min_by(F.col("upto") - F.col("words"), "interval").alias("before")
    )
    border = stored(border, "border")
    at_border = with_source(rows, border).where(ranked & (F.col("interval") == F.col("border")))
    at_border = stored(at_border.select("source", "rank", "id", "size", "place", "rest", "before"), "at-border")
    last = stored(_last_taken(at_border, with_source), "last")
    rows = with_source(with_source(rows, border), last)
    # In the order of the rank what is taken comes first, so the last of it decides.
    at_last = F.struct("rank", "id", "size", "place") <= F.col("last")
    # Without a border all ranked rows are taken.
    more = F.when(F.col("border").isNull() | (F.col("interval") < F.col("border")), F.lit(True))
    more = more.otherwise((F.col("interval") == F.col("border")) & F.coalesce(at_last, F.lit(False)))
    rows = rows.withColumn("more", (ranked & more).cast("long"))
    return rows.select(
        F.col("id").alias(id_col),
        F.col("source").alias(source_col),
        "size",
        "source_size",
        "target",
        (F.col("certain") + F.col("more")).cast("long").alias("copies"),
        *([F.col("row").alias(row_col)] if row_col else []),
    )


def _last_taken(
    at_border: DataFrame, with_source: Callable[[DataFrame, DataFrame], DataFrame]
) -> DataFrame:
    """source and last, the (rank, id, size, place) of the last row taken of its border;
    sources of whose border nothing is taken are left out."""
    groups = at_border.groupBy("source", "rank", "id", "size").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("place").alias("place"),
        F.first("rest").alias("rest"),
        F.first("before").alias("before"),
    )
    order = Window.partitionBy("source").orderBy("rank", "id", "size")
    earlier = F.sum(F.col("size") * F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    groups = groups.withColumn("before", F.col("before") + F.coalesce(earlier, F.lit(0)))

    def fits(k: Column) -> Column:
        return F.col("before") + k * F.col("size") - F.col("size") / 2 <= F.col("rest")

    about = F.when(F.col("size") > 0, F.floor((F.col("rest") - F.col("before")) / F.col("size") + 0.5))
    about = F.least(F.greatest(F.coalesce(about, F.col("n")), F.lit(0)), F.col("n"))
    groups = groups.withColumn("about", about)
    k = F.col("about")
    # Rounding may put the number beside the last one that fits.
    taken = F.when((k < F.col("n")) & fits(k + 1), k + 1).when((k < 1) | fits(k), k).otherwise(
        F.when(F.col("size") > 0, k - 1).otherwise(0)
    )
    ends = groups.withColumn("taken", taken).where("taken > 0").groupBy("source")
    ends = ends.agg(F.max(F.struct("rank", "id", "size", "taken", "n", "place")).alias("end"))

    # The place of the last taken one of equal rows: first its partition, then the row.
    some = with_source(at_border, ends.where("end.taken < end.n"))
    equal = (F.col("rank") == F.col("end.rank")) & F.col("id").eqNullSafe(F.col("end.id"))
    some = some.where(equal & (F.col("size") == F.col("end.size")))
    some = some.select("source", "place", F.shiftright("place", 33).alias("part"), F.col("end.taken").alias("taken"))
    parts = some.groupBy("source", "part").agg(F.count(F.lit(1)).alias("n"), F.first("taken").alias("taken"))
    upto = F.sum("n").over(Window.partitionBy("source").orderBy("part"))
    parts = parts.withColumn("left", F.col("taken") - (upto - F.col("n")))
    parts = parts.where((F.col("left") > 0) & (F.col("left") <= F.col("n")))
    parts = parts.select("source", F.col("part").alias("its_part"), "left")
    number = F.row_number().over(Window.partitionBy("source").orderBy("place"))
    inside = with_source(some, parts).where(F.col("part") == F.col("its_part")).withColumn("number", number)
    inside = inside.where(F.col("number") == F.col("left")).select("source", F.col("place").alias("at"))
    last = F.struct("end.rank", "end.id", "end.size", F.coalesce("at", "end.place").alias("place"))
    return with_source(ends, inside).select("source", last.alias("last"))
