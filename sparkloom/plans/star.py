"""Graph contributions from a star schema by a fixed mapping of its keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import canonical_name, display_name


def _values(seq: Column, source: tuple[str, str], kind: str, target: tuple[str, str], predicate: str, confidence: Column, polarity: Column, sentence: Column) -> list[Column]:
    """A relation's columns but for its document."""
    return [
        seq.cast("int").alias("seq"),
        F.lit(source[0]).alias("source_type"), F.col(f"{source[1]}_canonical").alias("source_canonical"), F.col(f"{source[1]}_display").alias("source_display"),
        F.lit(kind).alias("type"),
        F.lit(target[0]).alias("target_type"), F.col(f"{target[1]}_canonical").alias("target_canonical"), F.col(f"{target[1]}_display").alias("target_display"),
        F.lit(predicate).alias("predicate"), confidence.alias("confidence"), polarity.alias("polarity"), sentence.alias("sentence"), F.lit("").alias("chunk_id"),
    ]


def _named(rows: DataFrame, kind: str, column: str, *others: str) -> DataFrame:
    """A table's other columns with its name's canonical and shown forms: made once for each of its rows, not for each line that names it."""
    return rows.select(*others, canonical_name(F.col(column), F.lit(kind)).alias(f"{column}_canonical"), display_name(F.col(column)).alias(f"{column}_display"))


def _copies(rows: DataFrame, key: str, copy: str) -> DataFrame:
    """Rows that have a key, numbered within it."""
    order = Window.partitionBy(key).orderBy(*[c for c in rows.columns if c != key])
    return rows.where(F.col(key).isNotNull()).withColumn(copy, F.row_number().over(order))


def relation_contributions(customer: DataFrame, supplier: DataFrame, nation: DataFrame, region: DataFrame, part: DataFrame, orders: DataFrame, lineitem: DataFrame, tasks: int | None = None) -> DataFrame:
    """The log, dealt by document_id over ``tasks`` tasks. A line meets its part, its supplier and its order once, and makes both of its relations then."""

    def dealt(rows: DataFrame, key: str) -> DataFrame:
        return rows.repartition(tasks, key) if tasks else rows.repartition(key)

    positive, one = F.lit("positive"), F.lit(1)
    customer, supplier = _named(customer, "PERSON", "c_name", "c_custkey", "c_nationkey", "c_acctbal"), _named(supplier, "ORG", "s_name", "s_suppkey", "s_nationkey")
    nation, region = _named(nation, "LOCATION", "n_name", "n_nationkey", "n_regionkey"), _named(region, "LOCATION", "r_name", "r_regionkey")
    part = _named(part, "PRODUCT", "p_name", "p_partkey")
    where_customer = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    where_supplier = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    where_nation = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    person, org, place, product = ("PERSON", "c_name"), ("ORG", "s_name"), ("LOCATION", "n_name"), ("PRODUCT", "p_name")
    polarity = F.when(F.col("c_acctbal") < 0, "negative").otherwise("positive")
    parts = [
        where_customer.select(F.concat(F.lit("c"), "c_custkey").alias("document_id"), *_values(one, person, "LOCATED_IN", place, "locate in", F.lit(0.8), polarity, F.lit("customer in nation"))),
        where_supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("document_id"), *_values(one, org, "LOCATED_IN", place, "base in", F.lit(0.85), positive, F.lit("supplier in nation"))),
        where_nation.select(F.concat(F.lit("n"), "n_nationkey").alias("document_id"), *_values(one, place, "PART_OF", ("LOCATION", "r_name"), "be part of", F.lit(0.95), positive, F.lit("nation in region"))),
    ]
    lines = lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_discount", "l_tax").join(part, F.col("l_partkey") == F.col("p_partkey")).drop("l_partkey", "p_partkey")
    sellers = _copies(supplier.select("s_suppkey", "s_name_canonical", "s_name_display"), "s_suppkey", "s_copy")
    buyers = orders.select("o_orderkey", "o_custkey").join(customer.select("c_custkey", "c_name_canonical", "c_name_display"), F.col("o_custkey") == F.col("c_custkey"))
    buyers = _copies(dealt(buyers.select(F.concat(F.lit("o"), "o_orderkey").alias("o_document"), "c_name_canonical", "c_name_display"), "o_document"), "o_document", "o_copy")
    lines = lines.join(sellers, F.col("l_suppkey") == F.col("s_suppkey"), "left").drop("l_suppkey", "s_suppkey")
    lines = dealt(lines.withColumn("document_id", F.concat(F.lit("o"), "l_orderkey")).drop("l_orderkey"), "document_id")
    lines = lines.join(buyers, F.col("document_id") == F.col("o_document"), "left")
    # where a key has several suppliers or orders, each makes its relation once, not with each of the other's
    sells = F.col("s_copy").isNotNull() & (F.coalesce("o_copy", one) == 1)
    buys = F.col("o_copy").isNotNull() & (F.coalesce("s_copy", one) == 1)
    line = F.concat(F.lit("line "), "l_linenumber")
    sold = F.struct(*_values(F.col("l_linenumber") * 2, org, "PROVIDES", product, "supply", F.round(0.7 + F.col("l_discount"), 2), positive, line))
    bought = F.struct(*_values(F.col("l_linenumber") * 2 + 1, person, "USES", product, "use", F.round(0.7 + F.col("l_tax"), 2), positive, line))
    made = lines.select("document_id", F.inline(F.filter(F.array(F.when(sells, sold), F.when(buys, bought)), lambda x: x.isNotNull())))
    return made.union(dealt(reduce(DataFrame.union, parts), "document_id"))


def entity_contributions(relations: DataFrame) -> DataFrame:
    """Both ends of every relation, from one read of the log."""
    ends = [F.struct(F.col(f"{e}_type").alias("type"), F.col(f"{e}_canonical").alias("canonical_name"), F.col(f"{e}_display").alias("display_name"), "confidence") for e in ("source", "target")]
    return relations.select("document_id", "seq", F.inline(F.array(*ends)))
