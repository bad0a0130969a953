"""Entities and relationships kept up to date: a change touches its own keys only.

Two tables of versions hold each view. *Parts* are what a document contributes to a key
(an entity, or an edge and sentence), reduced to one row; *states* are the aggregates
of all parts of a key: how many, the ``HELD`` greatest confidences with their counts,
and the ``HELD`` first (entities) or last (edges) names. A change of documents
takes their parts back and merges theirs into the states: counts are added up, and
held values lose what went and gain what comes, as far as these reach into what is held.
Only a key whose held values are used up is aggregated anew, from its own parts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import entity_id
from sparkloom.operators import graph as G
from sparkloom.sources.versioned import VersionedTable
from sparkloom.storage import large, written, written_by

HELD = 8
_PLACE = ("document_id", "seq", "name", "unit")


def entity_parts(log: DataFrame) -> DataFrame:
    """One row for each entity and document."""
    rows = log.withColumn("type", G.safe(F.col("type"), G.ENTITY_TYPES))
    once = rows.groupBy("type", "canonical_name", "document_id").agg(F.min(F.struct("seq", "display_name")).alias("f"), F.max("confidence").alias("confidence"))
    return once.select(entity_id(F.col("type"), F.col("canonical_name")).alias("id"), "type", "canonical_name", "document_id", "f.seq", F.col("f.display_name").alias("name"), F.lit("").alias("unit"), "confidence")


def edge_parts(log: DataFrame) -> DataFrame:
    """One row for each edge, document and sentence."""
    rows = G.packed_ends(log)
    once = rows.groupBy("s", "t", "type", "polarity", "document_id", "sentence").agg(F.max(F.struct("seq", "predicate")).alias("f"), F.max("confidence").alias("confidence"))
    return G.unpacked_ends(once, "document_id", "f.seq", F.col("f.predicate").alias("name"), F.col("sentence").alias("unit"), "confidence")


@dataclass(frozen=True)
class View:
    """A view's parts and states; ``keys`` tell of a key what its id stands for, ``last`` whether the last name is shown."""

    parts: VersionedTable
    states: VersionedTable
    keys: tuple[str, ...]
    last: bool


def _held_names(rows: DataFrame, last: bool) -> DataFrame:
    """id, names: the held ones, the shown one first."""
    order = [F.desc(c) if last else F.asc(c) for c in _PLACE]
    best = rows.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy(*order))).where(F.col("n") <= HELD)
    return best.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", *_PLACE))), lambda x: F.struct(*[x[c].alias(c) for c in _PLACE])).alias("names"))


def _held_confidences(counts: DataFrame) -> DataFrame:
    """id, confidences: the greatest with their counts."""
    best = counts.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("confidence")))).where(F.col("place") <= HELD)
    return best.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "confidence", "n"))), lambda x: F.struct(x["confidence"].alias("confidence"), x["n"].alias("n"))).alias("confidences"))


def _aggregated(parts: DataFrame, keys: tuple[str, ...], last: bool) -> DataFrame:
    """The states of all keys of some parts.

    One aggregate is written after the other, so that the disks hold one's shuffle at a
    time; they lie in buckets by id and are joined where they lie. Ids go as their 8 bytes.
    """
    prefix = {"id": "r_" if last else "e_"} | {k: "e_" for k in keys if k.endswith("_id")}
    parts = parts.withColumns({c: F.unhex(F.substring(c, 3, 16)) for c in prefix})
    total = written_by(parts.groupBy("id").agg(F.count("*").alias("n"), *[F.min(k).alias(k) for k in keys]), "total", "id")
    names = written_by(_held_names(parts.select("id", *_PLACE), last), "names", "id")
    confidences = written_by(_held_confidences(parts.groupBy("id", "confidence").agg(F.count("*").alias("n"))), "confidences", "id")
    found = total.join(large(names), "id").join(large(confidences), "id")
    return found.withColumns({c: F.concat(F.lit(p), F.lower(F.hex(c))) for c, p in prefix.items()}).select("id", *keys, "n", "names", "confidences")


def _view(parts: DataFrame, keys: tuple[str, ...], last: bool) -> View:
    own = VersionedTable.create(parts, found_by=("id", "document_id"))
    return View(own, VersionedTable.create(_aggregated(own.read(), keys, last), found_by=("id",)), keys, last)


def _changed(view: View, came: DataFrame, documents: DataFrame) -> int:
    """Brings a view up to date; tells how many keys had to be aggregated anew."""
    went = written(view.parts.of(documents, "document_id").select("id", "document_id", "unit", "confidence"), "went")
    came = written(came, "came")
    view.parts.change(came, ((documents, "document_id"),))
    ids = written(came.select("id").union(went.select("id")).distinct(), "ids")
    old = written(view.states.of(ids, "id"), "states")
    count = lambda rows, sign: rows.groupBy("id").agg((F.lit(sign) * F.count("*")).alias("n"))
    total = old.select("id", "n").union(count(came, 1)).union(count(went, -1)).groupBy("id").agg(F.sum("n").alias("n"))
    # what is held of old keys, and how far: of a key whose values are not all held, a new one counts only within
    whole_names = F.size("names") == F.col("n")
    reach = old.select("id", F.when(whole_names, F.lit(None)).otherwise(F.element_at("names", -1)).alias("end"), (F.aggregate("confidences", F.lit(0).cast("long"), lambda a, x: a + x["n"]) == F.col("n")).alias("whole"), F.element_at("confidences", -1)["confidence"].alias("least"))
    place = F.struct(*_PLACE)
    within = F.col("end").isNull() | ((place >= F.col("end")) if view.last else (place <= F.col("end")))
    new = came.join(reach, "id", "left")
    # a part is told by its key, document and sentence
    left = old.select("id", F.inline("names")).join(went.select("id", "document_id", "unit"), ["id", "document_id", "unit"], "left_anti").select("id", *_PLACE)
    names = _held_names(left.union(new.where(within).select("id", *_PLACE)), view.last)
    ups = new.where(F.col("least").isNull() | F.col("whole") | (F.col("confidence") >= F.col("least"))).groupBy("id", "confidence").agg(F.count("*").alias("n"))
    downs = went.groupBy("id", "confidence").agg((-F.count("*")).alias("n")).join(old.select("id", F.explode("confidences.confidence").alias("confidence")), ["id", "confidence"], "left_semi")
    counts = old.select("id", F.inline("confidences")).union(ups).union(downs).groupBy("id", "confidence").agg(F.sum("n").alias("n")).where("n > 0")
    marks = came.select("id", *view.keys).union(old.select("id", *view.keys)).dropDuplicates(["id"])
    merged = written(marks.join(total, "id").join(names, "id", "left").join(_held_confidences(counts), "id", "left"), "merged")
    living = merged.where("n > 0")
    used_up = F.col("names").isNull() | F.col("confidences").isNull()
    anew = living.where(used_up).select("id")
    rows = living.where(~used_up).select("id", *view.keys, "n", "names", "confidences")
    if n := anew.count():
        rows = rows.union(_aggregated(view.parts.of(anew, "id"), view.keys, view.last))
    view.states.change(written(rows, "states"), ((ids, "id"),))
    return n


class GraphStore:
    """The graph of contribution logs (see ``operators.graph``), changed document by document; keeps the views that are given a log."""

    def __init__(self, entities: DataFrame | None = None, relations: DataFrame | None = None):
        self.nodes = None if entities is None else _view(entity_parts(entities), ("type", "canonical_name"), last=False)
        self.edges = None if relations is None else _view(edge_parts(relations), ("source_id", "target_id", "type", "polarity"), last=True)

    def replace(self, entities: DataFrame, relations: DataFrame, removed: DataFrame | None = None) -> int:
        """The contributions of some documents in place of all that these had, and none of the documents of ``removed``; tells how many keys were aggregated anew."""
        gone = entities.select("document_id").union(relations.select("document_id"))
        gone = written((gone if removed is None else gone.union(removed.select("document_id"))).distinct(), "documents")
        return sum(_changed(v, parts(log), gone) for v, parts, log in ((self.nodes, entity_parts, entities), (self.edges, edge_parts, relations)) if v)

    def remove(self, documents: DataFrame) -> int:
        """Without some documents; what no other document supports is no more."""
        gone = written(documents.select("document_id").distinct(), "documents")
        return sum(_changed(v, v.parts.read().limit(0), gone) for v in (self.nodes, self.edges) if v)

    def entities(self) -> DataFrame:
        """As ``graph.entities`` of the log as it is now."""
        shown = F.col("names")[0]["name"].alias("display_name"), F.col("n").alias("mentions_count"), F.col("confidences")[0]["confidence"].alias("confidence")
        return self.nodes.states.read().select("id", "type", "canonical_name", *shown)

    def relationships(self) -> DataFrame:
        """As ``graph.relationships`` of the log as it is now."""
        shown = F.col("names")[0]["name"].alias("predicate"), F.col("confidences")[0]["confidence"].alias("confidence"), F.col("n").alias("evidence_count")
        return self.edges.states.read().select("id", "source_id", "target_id", "type", "polarity", *shown)
