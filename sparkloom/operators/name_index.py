"""Names found by a part of them: postings of one, two and three characters.

An index has a row (gram, id) for every gram of an entity's names, in one folder for
each bucket of grams, and how many ids each gram has. A search reads the list of each
term's rarest gram only, and verifies by ``contains`` what it finds there.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.storage import freed, new_folder, written

SIZES = 1, 2, 3


def grams(text: Column, size: int) -> Column:
    """The different runs of ``size`` characters."""
    places = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(text, i, F.lit(size))))


@dataclass(frozen=True)
class NameIndex:
    spark: SparkSession
    path: str
    nodes: DataFrame
    buckets: int

    def rows(self, name: str, kind: str) -> DataFrame:
        return self.spark.read.schema(kind).parquet(f"{self.path}/{name}")

    def postings(self) -> DataFrame:
        return self.rows("postings", "gram string, id string, bucket int")

    def counts(self) -> DataFrame:
        return self.rows("counts", "gram string, ids long, bucket int")


#: Names whose grams one task of a build sorts.
TASK_NAMES = 50_000


def built(nodes: DataFrame, buckets: int = 64) -> NameIndex:
    """An index of entities (id, canonical_name, display_name, mentions_count, ...); nodes, which are a table, are read again when a search verifies.

    Names are dealt over tasks before their grams are made, of which there are tens to a
    name; each task sorts its own and writes them into the buckets' folders.
    """
    spark, path = nodes.sparkSession, new_folder(nodes.sparkSession, "names")
    tasks = -(-nodes.count() // TASK_NAMES) or 1
    names = F.array("canonical_name", F.lower("display_name"))
    own = F.array_distinct(F.flatten(F.transform(F.filter(names, lambda x: x.isNotNull()), lambda x: F.concat(*[grams(x, n) for n in SIZES]))))
    dealt = nodes.select("id", "canonical_name", "display_name").repartition(tasks, "id")
    rows = dealt.select("id", F.explode(own).alias("gram")).withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int"))
    with freed(spark):
        rows.sortWithinPartitions("bucket", "gram", "id").write.partitionBy("bucket").option("compression", "zstd").parquet(f"{path}/postings")
    index = NameIndex(spark, path, nodes, buckets)
    with freed(spark):
        index.postings().groupBy("bucket", "gram").agg(F.count("*").alias("ids")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "bucket").write.partitionBy("bucket").parquet(f"{path}/counts")
    return index


def candidates(index: NameIndex, terms: DataFrame) -> DataFrame:
    """query_id, id of all entities that have the rarest gram of a query's term, of the longest size that it has."""
    lowered = terms.select("query_id", F.lower("term").alias("term"))
    own = grams(F.col("term"), SIZES[0])
    for size in SIZES[1:]:
        own = F.when(F.length("term") >= size, grams(F.col("term"), size)).otherwise(own)
    wanted = written(lowered.select("query_id", F.explode(own).alias("gram")).withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(index.buckets)).cast("int")), "grams")
    buckets = [r[0] for r in wanted.select("bucket").distinct().collect()]  # at most index.buckets
    known = index.counts().where(F.col("bucket").isin(buckets))
    # a gram that no name has is the rarest
    ranked = wanted.join(known, ["bucket", "gram"], "left").withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.coalesce("ids", F.lit(0)), "gram")))
    rarest = written(ranked.where("n = 1").select("query_id", "bucket", "gram"), "rarest")
    read = [r[0] for r in rarest.select("bucket").distinct().collect()]
    return index.postings().where(F.col("bucket").isin(read)).join(rarest, ["bucket", "gram"]).select("query_id", "id")


def search(index: NameIndex, terms: DataFrame, limit: int) -> DataFrame:
    """query_id, rank and the entity for each query's term (query_id, term), as ``graph.search`` has it: equal names first, then by mentions; null and empty terms find nothing."""
    asked = terms.where(F.length("term") > 0).select("query_id", F.lower("term").alias("term"))
    found = candidates(index, asked).join(asked, "query_id").join(index.nodes, "id")
    hit = F.contains("canonical_name", F.col("term")) | F.contains(F.lower("display_name"), F.col("term"))
    equal = F.when((F.col("canonical_name") == F.col("term")) | (F.lower("display_name") == F.col("term")), 0).otherwise(1)
    order = Window.partitionBy("query_id").orderBy(equal, F.desc("mentions_count"), "id")
    return found.where(hit).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).drop("term")
