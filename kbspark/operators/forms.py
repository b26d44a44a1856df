"""The form index: which rows hold which identifier forms, stored by batch, and who shares how many."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.functions import text as t
from kbspark.session import materialise

# A form with more pairs than this goes by classes; a block of a class is about so many rows.
HEAVY_PAIRS = 1 << 20
CLASS_BLOCK = 4096
# Pairs that a task makes and adds up; more of them make more tasks, so that no task grows with the input.
TASK_PAIRS, MOST_PARTS = 1 << 19, 20_000
PARTS = 16


def forms(rows: DataFrame, id_col: str, identifiers: str = "identifiers") -> DataFrame:
    """Distinct (id, key, norm) of every row's identifiers.

    The rows are read once; only identifiers that are not ASCII go to Python, where the
    Unicode rules are.
    """
    found = rows.select(F.col(id_col), F.explode(identifiers).alias("identifier"))
    return found.where("identifier is not null").withColumn("f", t.join_form(F.col("identifier"))).select(id_col, "f.key", "f.norm").distinct()


def _part() -> Column:
    return F.pmod(F.xxhash64("key", "norm"), F.lit(PARTS)).cast("int").alias("part")


def write_index(found: DataFrame, path: str, batch: int = 0) -> None:
    """Store a batch's forms (id, key, norm) under its number; a batch that runs again replaces its own rows only.

    Rows lie in PARTS folders by the hash of the form, in order of the form, so that a reader
    of a few forms opens a few of them.
    """
    columns = [c for c in found.columns if c not in ("key", "norm")]
    out = found.select(*columns, "key", "norm", _part()).repartition("part").sortWithinPartitions("part", "key", "norm")
    out.write.mode("overwrite").partitionBy("part").parquet(f"{path}/batch={batch}")


def read_index(spark: SparkSession, path: str, id_col: str, before: int | None = None) -> DataFrame:
    """(id, key, norm) of all batches, or of those under a number; a row that several batches hold counts once."""
    found = spark.read.schema(f"{id_col} string, key string, norm string, part int, batch int").parquet(path)
    found = found if before is None else found.where(F.col("batch") < before)
    return found.select(id_col, "key", "norm").distinct()


def _block(owner: str, blocks: Column) -> Column:
    """The block of an owner among so many; the blocks of one number cut those of another only at its ends."""
    return F.shiftright(F.pmod(F.xxhash64(owner), F.lit(1 << 20)) * blocks.cast("long"), 20).cast("int")


def _classes(held: DataFrame, heavy: DataFrame, owner: str) -> DataFrame:
    """(owner, class, held): rows by the set of heavy forms they hold."""
    own = held.join(heavy, ["key", "norm"], "left_semi").groupBy(owner).agg(F.array_sort(F.collect_list(F.struct("key", "norm"))).alias("held"))
    return materialise(own.withColumn("class", F.md5(F.to_json("held").cast("binary"))))


def _heavy(left: DataFrame, right: DataFrame, heavy: DataFrame, value: Column, deal: Column) -> DataFrame:
    """Boxes (deal, value, digests, stories) of rows that share heavy forms, by way of classes.

    Rows that hold the same heavy forms are one class; what two classes share is counted once.
    Digests of a class, and stories that share the same with it, are cut into blocks of about
    CLASS_BLOCK rows each: no list is longer.
    """
    sides = [_classes(held, heavy, owner).withColumnRenamed("class", tag) for held, owner, tag in ((left, "digest", "l_class"), (right, "story", "r_class"))]
    blocks = F.ceil(F.col("n") / CLASS_BLOCK).cast("int")
    sizes = [s.groupBy(tag).agg(F.first("held").alias("held"), F.count("*").alias("n")) for s, tag in zip(sides, ("l_class", "r_class"))]
    kinds = [size.select(tag, "n", F.explode("held").alias("form")) for size, tag in zip(sizes, ("l_class", "r_class"))]
    met = materialise(kinds[0].drop("n").join(kinds[1], "form").groupBy("l_class", "r_class", "n").agg(value.alias("value")))
    told = met.groupBy("l_class", "value").agg(F.sum("n").alias("n")).select("l_class", "value", blocks.alias("r_blocks"))
    told = materialise(told.join(sizes[0].select("l_class", blocks.alias("l_blocks")), "l_class"))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    both = materialise(told.withColumn("l_block", every("l_blocks")).withColumn("r_block", every("r_blocks")).drop("l_blocks", "r_blocks"))
    digests = sides[0].select("digest", "l_class").join(told.select("l_class", "l_blocks").distinct(), "l_class")
    digests = digests.groupBy("l_class", _block("digest", F.col("l_blocks")).alias("l_block"), deal.alias("deal")).agg(F.collect_list("digest").alias("digests"))
    stories = sides[1].select("story", "r_class").join(met.drop("n"), "r_class").join(told, ["l_class", "value"])
    stories = stories.groupBy("l_class", "value", _block("story", F.col("r_blocks")).alias("r_block")).agg(F.collect_list("story").alias("stories"))
    return digests.join(both, ["l_class", "l_block"]).join(stories, ["l_class", "value", "r_block"]).select("deal", "value", "digests", "stories")


def by_class(rows: DataFrame, owner: str) -> tuple[DataFrame, DataFrame]:
    """(class, key, norm) and (class, owner) of rows (owner, key, norm): those that hold the same forms are one class."""
    own = rows.groupBy(owner).agg(F.array_sort(F.collect_set(F.struct("key", "norm"))).alias("held"))
    own = materialise(own.withColumn("class", F.md5(F.to_json("held").cast("binary"))))
    kinds = own.groupBy("class").agg(F.first("held").alias("held")).select("class", F.explode("held").alias("f"))
    return kinds.select("class", "f.key", "f.norm"), own.select("class", owner)


def expanded(pairs: DataFrame, members: DataFrame, owner: str) -> DataFrame:
    """pairs (digest, class, ...) with each owner of the class from members (class, owner).

    A class is dealt as pairs of blocks of about TASK_PAIRS rows at most, so no task makes more of
    it than its share; the owners of a block travel as one list and the rows made are not shuffled.
    """
    side = 1 << ((TASK_PAIRS.bit_length() - 1) // 2)
    n = pairs.groupBy("class").agg(F.count("*").alias("n_left")).join(members.groupBy("class").agg(F.count("*").alias("n_right")), "class")
    n = materialise(n.select("class", "n_left", "n_right"))
    total = n.agg(F.coalesce(F.sum(F.col("n_left") * F.col("n_right")), F.lit(0)).alias("all")).first()["all"]
    parts = min(MOST_PARTS, max(pairs.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_PAIRS)))
    blocks = lambda c: F.ceil(F.col(c) / side).cast("int")
    n = n.select("class", blocks("n_left").alias("l_blocks"), blocks("n_right").alias("r_blocks"))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    block = lambda c, blocks: F.pmod(F.xxhash64(c), F.col(blocks)).cast("int")
    by = ["class", "l_block", "r_block"]
    left = pairs.join(n, "class").withColumn("l_block", block("digest", "l_blocks")).withColumn("r_block", every("r_blocks")).drop("l_blocks", "r_blocks")
    lists = members.join(n, "class").withColumn("r_block", block(owner, "r_blocks")).groupBy("class", "r_block").agg(F.first("l_blocks").alias("l_blocks"), F.collect_list(owner).alias("owners"))
    right = lists.withColumn("l_block", every("l_blocks")).drop("l_blocks")
    met = left.repartition(parts, *by).join(right.repartition(parts, *by), by)
    return met.withColumn(owner, F.explode("owners")).drop("owners", *by)


class Deals(NamedTuple):
    """How digests are dealt: into so many parts, one a task."""

    parts: int
    met: DataFrame  # (key, norm, pairs) of the forms that both sides hold
    heavy: DataFrame | None  # (key, norm) of those with too many pairs to be joined as they are

    def of(self) -> Column:
        return _block("digest", F.lit(self.parts)).alias("deal")

    def dealt(self, rows: DataFrame) -> DataFrame:
        """rows (digest, ...) with `deal`, each where the pairs of its digest are: a join by (deal, digest) shuffles neither side."""
        return rows.withColumn("deal", self.of()).repartitionById(self.parts, F.col("deal"))


def deal_out(left: DataFrame, right: DataFrame, heavy_pairs: int = HEAVY_PAIRS, least: int = 1) -> Deals:
    """The deals of left (digest, key, norm) and right (story, key, norm): as many as their pairs ask for, and at least so many."""
    n = [side.groupBy("key", "norm").agg(F.count("*").alias(name)) for side, name in ((left, "n_left"), (right, "n_right"))]
    pairs = F.col("n_left") * F.col("n_right")
    met = materialise(n[0].join(n[1], ["key", "norm"]).select("key", "norm", pairs.alias("pairs")))
    total = met.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("all"), F.count_if(F.col("pairs") > heavy_pairs).alias("heavy")).first()
    parts = min(MOST_PARTS, max(left.sparkSession.sparkContext.defaultParallelism, least, -(-total["all"] // TASK_PAIRS)))
    return Deals(parts, met, met.where(F.col("pairs") > heavy_pairs).select("key", "norm") if total["heavy"] else None)


def shared(left: DataFrame, right: DataFrame, lists: bool = False, heavy_pairs: int = HEAVY_PAIRS, dealt: bool = False, deals: Deals | None = None) -> DataFrame:
    """(digest, story, shared) of left (digest, key, norm) and right (story, key, norm): how many forms, or which (lists).

    Digests are dealt, and what a deal needs of a form goes to it as one box: the deal's digests and
    the form's stories. Pairs are made and added up where the boxes are, so none is shuffled.
    A form of up to heavy_pairs pairs is joined as it is, so its lists are no longer. Others, which
    would make longer ones, are counted once for all rows that hold the same ones. The rows are
    the same either way. With dealt there is a column `deal`: rows of a digest are in one deal, a deal in one
    partition, so what is ordered by (deal, digest) needs no shuffle. A story may be a struct, which
    carries more of it than its name. `deals` are those of deal_out(), if the caller has them.
    """
    deals = deals or deal_out(left, right, heavy_pairs)
    rest = (lambda df: df.join(deals.heavy, ["key", "norm"], "left_anti")) if deals.heavy else (lambda df: df)
    by_form = lambda df: rest(df).repartition("key", "norm")
    digests = by_form(left).groupBy("key", "norm", deals.of()).agg(F.collect_list("digest").alias("digests"))
    stories = by_form(right).groupBy("key", "norm").agg(F.collect_list("story").alias("stories"))
    value = F.array(F.struct("key", "norm")) if lists else F.lit(1).cast("long")
    boxes = digests.join(stories, ["key", "norm"]).select("deal", value.alias("value"), "digests", "stories")
    if deals.heavy:
        boxes = boxes.unionByName(_heavy(left, right, deals.heavy, F.array_sort(F.collect_list("form")) if lists else F.count("*"), deals.of()))
    made = boxes.repartitionById(deals.parts, F.col("deal")).select("deal", "value", "stories", F.explode("digests").alias("digest")).select("deal", "value", "digest", F.explode("stories").alias("story"))
    value = F.array_sort(F.flatten(F.collect_list("value"))) if lists else F.sum("value")
    return made.groupBy("deal", "digest", "story").agg(value.alias("shared")).select(*["deal"][: int(dealt)], "digest", "story", "shared")
