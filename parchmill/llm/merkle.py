"""A Merkle manifest of a table, with proofs by a recursive query.

Every group of rows is a tree of SHA-256 digests, RUN nodes to a parent; the subroots of
the groups are the leaves of a last tree, whose top is the root. Levels are built from
the bottom and stored as rows that name their parent. A recursive query of Spark then
climbs from the leaves: each step meets the parent's row, appends the siblings and folds
the digest of a row that may have been tampered with. The leaves of one run have all
further siblings in common, so one row climbs for them, with a fold of each.

Digests are kept as 32 bytes; what is hashed is their hexadecimal text.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchmill.session import scratch_path

RUN = 8
SPREAD = 4096  # rows that meet one copy of a node in a step, about
_SIZE = 32  # bytes of a digest
_TOP = 32  # levels from here on are those of the tree over the subroots


def hashed(text: Column) -> Column:
    """SHA-256 of a text, as bytes."""
    return F.unhex(F.sha2(text, 256))


def as_text(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def field(value: Column) -> Column:
    """`-` for null, else the length in UTF-8 bytes, `:` and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def _stored(df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(df.sparkSession, f"merkle-{label}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _numbered(df: DataFrame, order: list[str], label: str) -> DataFrame:
    """The rows, stored, with their place `at` (from 0) in the order of the columns.

    They are sorted in ranges. A range's first number comes from the sizes of those
    before it, one row a range. Equal rows are dealt to several ranges by a random
    number, which is the same whenever the scan is repeated.
    """
    salted = df.withColumn("salt", F.rand(7))
    ranged = salted.repartitionByRange(*order, "salt").sortWithinPartitions(*order, "salt")
    placed = _stored(ranged.drop("salt").withColumn("place", F.monotonically_increasing_id()), label)
    part = F.shiftright("place", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    first = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    at = F.col("first") + F.col("place") - F.shiftleft("part", 33)
    return placed.join(first, part == F.col("part")).select(*df.columns, at.alias("at"))


def _id(level: int, number: Column) -> Column:
    """A node's name: its level and its number in that level."""
    return F.shiftleft(F.lit(level).cast("long"), 56).bitwiseOR(number)


def _place(i: str) -> Column:
    return (F.col(i) % RUN).cast("int")


def _levels(nodes: DataFrame, level: int, label: str) -> tuple[list[DataFrame], list[DataFrame]]:
    """(runs by level, from the one above `nodes`; the last nodes of trees by level).

    `nodes` have tree (the number of its first node), size (its number of nodes), i
    (place in the tree), digest, beneath (rows that climb from below) and leaf, which
    the runs of the first level keep. A tree's nodes are numbered from its own number on
    in every level, which keeps the numbers of a level apart.
    """
    runs, tops = [], []
    most = nodes.agg(F.max("size")).first()[0] or 0
    tops.append(nodes.where("size = 1").select("tree", _id(level, F.col("tree")).alias("id"), "digest", "beneath"))
    while most > 1:
        level, most = level + 1, math.ceil(most / RUN)
        lowest = not runs
        kid = F.struct("i", "digest", *(["leaf"] if lowest else []))
        grouped = nodes.where("size > 1").groupBy("tree", "size", F.floor(F.col("i") / RUN).alias("run"))
        made = grouped.agg(F.sort_array(F.collect_list(kid)).alias("kids"), F.sum("beneath").alias("beneath"))
        listed = F.aggregate("kids", F.lit(b""), lambda so_far, k: F.concat(so_far, k["digest"]))
        made = made.select(
            "tree",
            F.ceil(F.col("size") / RUN).alias("size"),
            F.col("run").alias("i"),
            "beneath",
            listed.alias("listed"),
            *([F.transform("kids", lambda k: k["leaf"]).alias("leaves")] if lowest else []),
        )
        parent = _id(level + 1, F.col("tree") + F.floor(F.col("i") / RUN))
        made = made.withColumns(
            {
                "id": _id(level, F.col("tree") + F.col("i")),
                "parent": F.when(F.col("size") > 1, parent),
                "digest": hashed(as_text(F.col("listed"))),
            }
        )
        nodes = _stored(made, f"{label}-{level}")
        runs.append(nodes)
        tops.append(nodes.where("size = 1").select("tree", "id", "digest", "beneath"))
    return runs, tops


def _union(frames: list[DataFrame], *columns: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [f.select(*columns) for f in frames])


def _beside(listed: Column, place: Column) -> tuple[Column, Column]:
    """The digests of a run before a place and after it."""
    return F.substring(listed, F.lit(1), place * _SIZE), F.substring(listed, (place + 1) * _SIZE + 1, F.lit(RUN * _SIZE))


_LEFT = f"substring(n.listed, 1, {_SIZE} * c.place)"
_RIGHT = f"substring(n.listed, {_SIZE} * (c.place + 1) + 1, {RUN * _SIZE})"
_CLIMB = f"""
WITH RECURSIVE climb AS (
  SELECT run, up, copies, place, folds, CAST('' AS BINARY) AS siblings FROM {{starts}}
  UNION ALL
  SELECT c.run, n.up, n.up_copies, n.place,
         transform(c.folds, f -> unhex(sha2(lower(hex(concat({_LEFT}, f, {_RIGHT}))), 256))),
         concat(c.siblings, {_LEFT}, {_RIGHT})
  FROM climb c JOIN {{nodes}} n ON n.id = c.up AND n.copy = pmod(hash(c.run), c.copies)
)
SELECT run, folds, siblings FROM climb WHERE up IS NULL
"""
_ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def _climbed(starts: DataFrame, nodes: DataFrame) -> DataFrame:
    """run, folds and siblings of every start when it has come to the root."""
    spark = starts.sparkSession
    before = spark.conf.get(_ROW_LIMIT)
    spark.conf.set(_ROW_LIMIT, "-1")  # rows grow with the table; steps do not
    try:
        return _stored(spark.sql(_CLIMB, starts=starts, nodes=nodes), "climbed")
    finally:
        spark.conf.set(_ROW_LIMIT, before)


def manifest(
    rows: DataFrame, key: Column, group: Column, leaf: Column, tampered: Column | None = None, spread: int = SPREAD
) -> DataFrame:
    """For each row its key, leaf, subroot, root, proof_sha256, folded_root and verified.

    `leaf` is the text that is hashed for the row; `tampered` is what a verifier sees
    instead, null where that is the same. Groups are ordered by `group`, null first and
    strings by their bytes; a group's rows by `key`, null first, then by leaf, so that
    repeated keys have a defined order too. Every RUN consecutive nodes become a parent,
    the last ones too if they are fewer, until one is left: the subroot, and over the
    subroots in the same way the root. proof_sha256 hashes the digests beside the row's
    way, level by level, from left to right; folded_root is what the way gives with the
    row as the verifier sees it.

    Texts of any length are hashed where they are read; only digests move. Rows get
    their numbers from sorted ranges and runs have RUN children at most, so no group
    meets in one task. A node that many rows pass has one copy for about `spread` of
    them. Columns are used through the given expressions only, whatever their names. An
    empty table gives an empty result.
    """
    spark = rows.sparkSession
    other = F.lit(None).cast("string") if tampered is None else tampered
    taken = rows.select(
        key.alias("key"), group.alias("name"), hashed(leaf).alias("digest"), hashed(other).alias("altered")
    )
    numbered = _numbered(taken, ["name", "key", "digest"], "leaves")
    trees = numbered.groupBy(F.col("name").alias("its")).agg(F.min("at").alias("tree"), F.count("*").alias("size"))
    trees = _numbered(trees, ["tree"], "trees").withColumnRenamed("at", "k")  # in the order of names
    several = trees.count()
    leaves = numbered.join(trees, F.col("name").eqNullSafe(F.col("its"))).select(
        "tree",
        "size",
        (F.col("at") - F.col("tree")).alias("i"),
        "digest",
        F.lit(1).cast("long").alias("beneath"),
        F.struct("key", "digest", "altered").alias("leaf"),
    )
    runs, tops = _levels(leaves, 0, "level")
    subroots = _union(tops, "tree", "id", "digest", "beneath").withColumnRenamed("tree", "of")
    subroots = _stored(subroots.join(trees, F.col("of") == F.col("tree")).drop("its", "of", "size"), "subroots")
    over = subroots.select(
        F.lit(0).cast("long").alias("tree"),
        F.lit(several).cast("long").alias("size"),
        F.col("k").alias("i"),
        "digest",
        "beneath",
        F.lit(0).alias("leaf"),
    )
    high_runs, high_tops = _levels(over, _TOP, "top")
    root = (_union(high_tops, "digest").first() or [b""])[0]

    above = subroots.select(
        F.col("id").alias("subroot_id"),
        F.when(F.lit(several > 1), _id(_TOP + 1, F.floor(F.col("k") / RUN))).alias("above"),
        _place("k").alias("above_place"),
    )

    def linked(df: DataFrame) -> DataFrame:
        """With `up` and `place`; a subroot's are those in the tree over the subroots."""
        place = F.when(F.col("parent").isNull(), F.col("above_place")).otherwise(_place("i"))
        up = F.coalesce("parent", "above").alias("up")
        kept = [c for c in df.columns if c not in ("parent", "i")]
        return df.join(above, F.col("id") == F.col("subroot_id"), "left").select(*kept, up, place.alias("place"))

    # A row climbs for a run of leaves, or for the only leaf of a tree.
    lone = leaves.where("size = 1").select(
        "tree",
        _id(0, F.col("tree")).alias("id"),
        F.lit(None).cast("long").alias("parent"),
        "i",
        F.col("digest").alias("listed"),
        F.array("leaf").alias("leaves"),
    )
    starts = linked(_union([*runs[:1], lone], "tree", "id", "parent", "i", "listed", "leaves"))
    nodes = _union([*runs[1:], *high_runs], "id", "parent", "i", "listed", "beneath") if runs[1:] + high_runs else None
    if nodes is None:
        nodes = spark.createDataFrame([], "id long, up long, place int, listed binary, copies long")
    else:
        copies = (F.floor(F.col("beneath") / spread) + 1).alias("copies")
        nodes = _stored(linked(nodes).select("id", "up", "place", "listed", copies), "nodes")
    of_parent = nodes.select(F.col("id").alias("up_id"), F.col("copies").alias("up_copies"))

    def with_copies(df: DataFrame) -> DataFrame:
        return df.join(of_parent, F.col("up") == F.col("up_id"), "left")

    def seen(one: Column) -> Column:
        return F.coalesce(one["altered"], one["digest"])

    def first_fold(one: Column, k: Column) -> Column:
        left, right = _beside(F.col("listed"), k)
        return hashed(as_text(F.concat(left, seen(one), right)))

    is_run = F.col("id") >= 1 << 56
    folds = F.when(is_run, F.transform("leaves", first_fold)).otherwise(F.transform("leaves", seen))
    begun = with_copies(starts).select(
        F.col("id").alias("run"), "up", F.col("up_copies").alias("copies"), "place", folds.alias("folds")
    )
    number = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy")
    climbed = _climbed(begun, with_copies(nodes).select("id", "up", "up_copies", "place", "listed", number))

    done = starts.join(climbed, F.col("id") == F.col("run"))
    done = done.join(subroots.select(F.col("tree").alias("of"), F.col("digest").alias("subroot")), F.col("tree") == F.col("of"))
    each = done.select("subroot", "listed", "siblings", "folds", F.posexplode("leaves").alias("at", "leaf"))
    left, right = _beside(F.col("listed"), F.col("at"))
    folded = F.get("folds", F.col("at"))
    return each.select(
        F.col("leaf.key").alias("key"),
        as_text(F.col("leaf.digest")).alias("leaf"),
        as_text(F.col("subroot")).alias("subroot"),
        as_text(F.lit(root)).alias("root"),
        # The only leaf of a tree has itself beside nothing.
        F.sha2(as_text(F.concat(left, right, F.col("siblings"))), 256).alias("proof_sha256"),
        as_text(folded).alias("folded_root"),
        (folded == F.lit(root)).alias("verified"),
    )
