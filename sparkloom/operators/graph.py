"""The evidence graph as aggregates of a contribution log.

``entity_contrib`` (document_id, seq, type, canonical_name, display_name, confidence)
and ``relation_contrib`` (document_id, seq, source_type, source_canonical, type,
target_type, target_canonical, predicate, confidence, polarity, sentence, chunk_id)
are append-only; a document that is ingested again or deleted is dropped from the
log by its key, and what no contribution supports does not exist.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.config import DEFAULTS
from sparkloom.functions.text import entity_id, relation_id
from sparkloom.storage import written

# The types of entities and relations; anything else is OTHER or RELATED_TO.
ENTITY_TYPES = ("PERSON", "ORG", "LOCATION", "DATE", "PRODUCT", "ROLE", "DEPARTMENT", "PROJECT", "TECHNOLOGY", "EVENT", "MONEY", "OTHER")
RELATION_TYPES = (
    "WORKS_IN", "WORKS_FOR", "REPORTS_TO", "MANAGES", "MANAGED_BY", "LEADS", "RESPONSIBLE_FOR", "OWNS", "OWNED_BY", "PART_OF",
    "BELONGS_TO", "MEMBER_OF", "LOCATED_IN", "USES", "DEVELOPS", "PROVIDES", "ACQUIRED", "FOUNDED", "CREATED", "RELATED_TO",
)


#: The most edges of one read.
MOST_EDGES = 500


def safe(value: Column, known: tuple[str, ...]) -> Column:
    return F.when(value.isin(*known), value).otherwise(known[-1])


def without(log: DataFrame, tombstones: DataFrame) -> DataFrame:
    """The log without some documents."""
    return log.join(tombstones.select("document_id").distinct(), "document_id", "left_anti")


def endpoints(relations: DataFrame) -> DataFrame:
    """Relations with source_id, target_id and their own id."""
    rows = relations.withColumn("source_id", entity_id(F.col("source_type"), F.col("source_canonical"))).withColumn("target_id", entity_id(F.col("target_type"), F.col("target_canonical")))
    return rows.withColumn("id", relation_id(F.col("source_id"), F.col("type"), F.col("target_id"), F.col("polarity")))


def entities(log: DataFrame) -> DataFrame:
    """id, canonical_name, display_name (the first), type, mentions_count (documents), confidence (the most)."""
    rows = log.withColumn("type", safe(F.col("type"), ENTITY_TYPES))
    first = F.min_by("display_name", F.struct("document_id", "seq"))
    once = rows.groupBy("type", "canonical_name", "document_id").agg(F.min(F.struct("seq", "display_name")).alias("f"), F.max("confidence").alias("confidence"))
    once = once.select("type", "canonical_name", "document_id", "f.seq", "f.display_name", "confidence")
    found = once.groupBy("type", "canonical_name").agg(first.alias("display_name"), F.count("*").alias("mentions_count"), F.max("confidence").alias("confidence"))
    return found.select(entity_id(F.col("type"), F.col("canonical_name")).alias("id"), "type", "canonical_name", "display_name", "mentions_count", "confidence")


def sources(log: DataFrame) -> DataFrame:
    """id, document_id: a row for each document of an entity, as a hub may have millions."""
    return log.where("document_id <> ''").select(entity_id(safe(F.col("type"), ENTITY_TYPES), F.col("canonical_name")).alias("id"), "document_id").distinct()


def replaced(log: DataFrame, rows: DataFrame) -> DataFrame:
    """The log with ``rows`` in place of all that their documents contributed; documents come again as often as one likes."""
    return without(log, rows).unionByName(rows)


def packed_ends(log: DataFrame) -> DataFrame:
    """Relations with the 8 bytes of their ends' ids as s and t, which sorts and shuffles take in place of text."""
    ends = [F.unhex(F.substring(entity_id(F.col(f"{e}_type"), F.col(f"{e}_canonical")), 3, 16)).alias(e[0]) for e in ("source", "target")]
    return log.select(*ends, safe(F.col("type"), RELATION_TYPES).alias("type"), "polarity", "document_id", "sentence", "seq", "predicate", "confidence")


def unpacked_ends(rows: DataFrame, *others: str | Column) -> DataFrame:
    """id, source_id, target_id, type and polarity of rows with s and t, and other columns."""
    ends = [F.concat(F.lit("e_"), F.lower(F.hex(e[0]))).alias(f"{e}_id") for e in ("source", "target")]
    found = rows.select(*ends, "type", "polarity", *others)
    edge = relation_id(F.col("source_id"), F.col("type"), F.col("target_id"), F.col("polarity"))
    return found.select(edge.alias("id"), *found.columns)


def relationships(log: DataFrame) -> DataFrame:
    """id, source_id, target_id, type, predicate (the last), confidence (the most), polarity, evidence_count.

    Where the log lies in buckets of documents, only the aggregates of a bucket's edges are shuffled.
    """
    last = F.max_by("predicate", F.struct("document_id", "seq"))
    once = packed_ends(log).groupBy("s", "t", "type", "polarity", "document_id", "sentence").agg(F.max(F.struct("seq", "predicate")).alias("f"), F.max("confidence").alias("confidence"))
    once = once.select("s", "t", "type", "polarity", "document_id", "f.seq", "f.predicate", "confidence")
    found = once.groupBy("s", "t", "type", "polarity").agg(last.alias("predicate"), F.max("confidence").alias("confidence"), F.count("*").alias("evidence_count"))
    return unpacked_ends(found, "predicate", "confidence", "evidence_count")


def evidence(log: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """One row for each relation, document and sentence: the latest; with ``of`` (id), only of the relations that touch some entities, chosen before rows are grouped."""
    rows = endpoints(log.withColumn("type", safe(F.col("type"), RELATION_TYPES)))
    if of is not None:
        rows = touching(rows, of)
    latest = F.max(F.struct("seq", "chunk_id", "confidence")).alias("l")
    return rows.groupBy(F.col("id").alias("relationship_id"), "document_id", "sentence").agg(latest).select("relationship_id", "document_id", "sentence", "l.chunk_id", "l.confidence")


def matching(nodes: DataFrame, term: str) -> Column:
    """Names that hold the term, as it is."""
    return F.contains("canonical_name", F.lit(term.lower())) | F.contains(F.lower("display_name"), F.lit(term.lower()))


def bounded(limit: int | None) -> int:
    """A limit of edges as given, from 1 to 500; 150 where none is."""
    return DEFAULTS.graph_limit if limit is None else max(1, min(limit, MOST_EDGES))


def labelled(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges whose both ends exist, with source_name and target_name."""
    out = edges
    for end in ("source", "target"):
        out = out.join(nodes.select(F.col("id").alias(f"{end}_id"), F.col("display_name").alias(f"{end}_name")), f"{end}_id")
    return out.select(*edges.columns, "source_name", "target_name")


def sliced_edges(edges: DataFrame, limit: int = 150, least: float = 0.0) -> DataFrame:
    """Positive edges by falling confidence, ``limit`` at most and one more that tells of truncation."""
    rows = edges.where((F.col("polarity") == "positive") & (F.col("confidence") >= least))
    w = F.col("confidence").desc(), F.col("id")
    ranked = rows.orderBy(*w).limit(limit + 1).withColumn("rank", F.row_number().over(Window.orderBy(*w)))  # limit + 1 rows
    truncated = F.max("rank").over(Window.partitionBy()) > limit
    return ranked.withColumn("truncated", truncated).where(F.col("rank") <= limit)


def sliced(nodes: DataFrame, edges: DataFrame, limit: int = 150, least: float = 0.0, kind: str | None = None, entity_kind: str | None = None, term: str | None = None, of_document: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``sliced_edges`` of the edges that pass the filters, and their nodes by mentions."""
    rows = edges.where((F.col("polarity") == "positive") & (F.col("confidence") >= least))
    if kind:
        rows = rows.where(F.col("type") == kind)
    if of_document is not None:
        rows = rows.join(of_document.select(F.col("relationship_id").alias("id")).distinct(), "id", "left_semi")
    if entity_kind or term:
        wanted = nodes
        if entity_kind:
            wanted = wanted.where(F.col("type") == entity_kind)
        if term:
            wanted = wanted.where(matching(wanted, term))
        ids = wanted.select("id")
        either = rows.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").select("id").union(rows.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select("id")).distinct()
        rows = rows.join(either, "id", "left_semi")
    shown = sliced_edges(rows, limit, least)
    ids = shown.select(F.col("source_id").alias("id")).union(shown.select(F.col("target_id").alias("id"))).distinct()
    return shown, nodes.join(ids, "id", "left_semi")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, degree: ends of edges at each node; a loop has two."""
    ends = edges.select(F.col("source_id").alias("id")).union(edges.select(F.col("target_id").alias("id"))).groupBy("id").agg(F.count("*").alias("n"))
    return nodes.select("id").join(ends, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("degree"))


def touching(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with either end among the ids: two equal joins of one read, not one with or; no edge is moved where the ids are a small table."""
    own, out = ids.select("id").distinct(), edges
    for end in ("source_id", "target_id"):
        out = out.join(own.select(F.col("id").alias(f"_of_{end}")), F.col(end) == F.col(f"_of_{end}"), "left")
    return out.where("_of_source_id IS NOT NULL OR _of_target_id IS NOT NULL").select(*edges.columns)


def detail(edges: DataFrame, ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """entity_id, rank, the edge, and its other end (neighbor_id, neighbor_name) for each of some entities: positive edges first, then by confidence."""
    own = ids.select(F.col("id").alias("entity_id")).distinct()
    ends = [edges.withColumn("entity_id", F.col(a)).withColumn("neighbor_id", F.col(b)) for a, b in (("source_id", "target_id"), ("target_id", "source_id"))]
    rows = ends[0].union(ends[1].where("source_id <> target_id")).join(own, "entity_id", "left_semi")
    w = Window.partitionBy("entity_id").orderBy(F.when(F.col("polarity") == "positive", 0).otherwise(1), F.desc("confidence"), "id")
    return rows.withColumn("rank", F.row_number().over(w)).join(nodes.select(F.col("id").alias("neighbor_id"), F.col("display_name").alias("neighbor_name")), "neighbor_id", "left")


def neighbours(edges: DataFrame, ids: DataFrame, depth: int = 1, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """What positive edges reach in 1 to 3 hops: id, distance of the entities, and the edges followed with hop, rank and truncated.

    A hop follows ``limit`` edges at most, the most confident; none begins once so many
    edges are found. Of these at most ``limit`` are shown, in the order in which they
    were found, and truncated tells whether there are more. Each hop reads ``edges``
    once, so these should be a table.
    """
    limit = bounded(limit)
    positive = edges.where("polarity = 'positive'")
    seen = written(ids.select("id").distinct().withColumn("distance", F.lit(0)), "seen")
    found = None
    for hop in range(1, max(1, min(3, depth)) + 1):
        front = seen.where(F.col("distance") == hop - 1)
        used = touching(positive, front).orderBy(F.desc("confidence"), "id").limit(limit).withColumn("hop", F.lit(hop))
        used = written(used, "hop")
        found = used if found is None else found.union(used.join(found.select("id"), "id", "left_anti").select(*used.columns))
        reached = used.select(F.col("source_id").alias("id")).union(used.select(F.col("target_id").alias("id"))).distinct()
        seen = seen.union(written(reached.join(seen.select("id"), "id", "left_anti").withColumn("distance", F.lit(hop)), "seen"))  # a hop is computed once
        if found.count() >= limit:  # at most three times the limit
            break
    ranked = found.withColumn("rank", F.row_number().over(Window.orderBy("hop", F.desc("confidence"), "id")))
    return seen, ranked.withColumn("truncated", F.max("rank").over(Window.partitionBy()) > limit).where(F.col("rank") <= limit)


def adjacency(edges: DataFrame, most: int = MOST_EDGES) -> DataFrame:
    """id, place and the edge for both ends of each positive edge: of each entity the ``most`` most confident, written in the order of ids. No traversal with such a limit follows others."""
    positive = edges.where("polarity = 'positive'")
    ends = positive.withColumn("node", F.col("source_id")).union(positive.where("source_id <> target_id").withColumn("node", F.col("target_id")))
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("confidence"), "id"))
    return written(ends.withColumn("place", place).where(F.col("place") <= most).sortWithinPartitions("node"), "adjacency")


def neighbours_of_each(adjacent: DataFrame, ids: DataFrame, depth: int = 1, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``neighbours`` of many entities (id), each on its own, from an ``adjacency``: start, id, distance, and the edges with start, hop, rank and truncated.

    Frontiers are keyed by the entity they started from; a hop is one join of all of
    them, which meets ``limit`` edges of an entity at most.
    """
    limit = bounded(limit)
    seen = written(ids.select(F.col("id").alias("start")).distinct().withColumns({"id": F.col("start"), "distance": F.lit(0)}), "seen")
    near = adjacent.where(F.col("place") <= limit).drop("place")
    names = [c for c in near.columns if c != "node"]
    found = None
    for hop in range(1, max(1, min(3, depth)) + 1):
        front = seen.where(F.col("distance") == hop - 1).select("start", F.col("id").alias("node"))
        if found is not None:  # starts that have enough edges stop
            front = front.join(found.groupBy("start").count().where(F.col("count") >= limit), "start", "left_anti")
        order = Window.partitionBy("start").orderBy(F.desc("confidence"), "id")
        met = front.join(near, "node").select("start", *names).dropDuplicates(["start", "id"])
        used = written(met.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit).drop("n").withColumn("hop", F.lit(hop)), "hop")
        reached = used.select("start", F.col("source_id").alias("id")).union(used.select("start", F.col("target_id").alias("id"))).distinct()
        new = written(reached.join(seen.select("start", "id"), ["start", "id"], "left_anti").withColumn("distance", F.lit(hop)), "seen")
        found = used if found is None else found.union(used.join(found.select("start", "id"), ["start", "id"], "left_anti").select(*used.columns))
        seen = seen.union(new.select(*seen.columns))
    order = Window.partitionBy("start").orderBy("hop", F.desc("confidence"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).withColumn("truncated", F.count("*").over(Window.partitionBy("start")) > limit)
    return seen, ranked.where(F.col("rank") <= limit)


def search(nodes: DataFrame, term: str, limit: int) -> DataFrame:
    """Entities whose name holds the term: equal names first, then by mentions."""
    equal = F.when((F.col("canonical_name") == term.lower()) | (F.lower("display_name") == term.lower()), 0).otherwise(1)
    return nodes.where(matching(nodes, term)).orderBy(equal, F.desc("mentions_count"), "id").limit(limit)


def stats(nodes: DataFrame, edges: DataFrame, log: DataFrame) -> DataFrame:
    """measure, key, n: totals, entities and positive relations by type, documents."""
    positive = edges.where("polarity = 'positive'")
    parts = [
        nodes.groupBy("type").agg(F.count("*").alias("n")).select(F.lit("entities").alias("measure"), F.col("type").alias("key"), "n"),
        positive.groupBy("type").agg(F.count("*").alias("n")).select(F.lit("relationships"), "type", "n"),
        nodes.agg(F.count("*").alias("n")).select(F.lit("total_entities"), F.lit(""), "n"),
        positive.agg(F.count("*").alias("n")).select(F.lit("total_relationships"), F.lit(""), "n"),
        log.agg(F.count_distinct("document_id").alias("n")).select(F.lit("documents"), F.lit(""), "n"),
    ]
    return reduce(DataFrame.union, parts)


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Entities that no positive edge touches."""
    ends = edges.where("polarity = 'positive'")
    ids = ends.select(F.col("source_id").alias("id")).union(ends.select(F.col("target_id").alias("id"))).distinct()
    return nodes.join(ids, "id", "left_anti")


def deduplicated(relations: DataFrame) -> DataFrame:
    """The most confident, then the first, relation of each document, pair of names, type and polarity."""
    key = ("document_id", "source_canonical", "type", "target_canonical", "polarity")
    w = Window.partitionBy(*key).orderBy(F.desc("confidence"), "seq")
    return relations.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def of_type(nodes: DataFrame, kind: str) -> DataFrame:
    """Entities by the name of their type; an unknown name is the last type's."""
    return nodes.where(F.col("type") == (kind.strip().upper() if kind.strip().upper() in ENTITY_TYPES else ENTITY_TYPES[-1]))


def shown_nodes(nodes: DataFrame, of_edges: DataFrame, log: DataFrame, limit: int, kind: str | None = None, term: str | None = None, document: str | None = None) -> DataFrame:
    """A slice's nodes; where a filter leaves no edge, the entities that pass it themselves, by mentions, ``limit`` at most."""
    if not of_edges.isEmpty() or not (kind or term or document):
        return of_edges
    rows = nodes if not kind else nodes.where(F.col("type") == kind)
    if term:
        rows = rows.where(F.contains("canonical_name", F.lit(term.lower())))
    if document:
        own = written(sources(log.where(F.col("document_id") == document)).select("id"), "ids")  # a document's entities: with a small table the log is read for these alone
        rows = rows.join(own, "id", "left_semi")
    return rows.orderBy(F.desc("mentions_count"), "id").limit(limit)
