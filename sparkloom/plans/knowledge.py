"""From parses to the evidence graph's contribution logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.config import DEFAULTS, Config
from sparkloom.operators import documents as D
from sparkloom.operators import graph as G
from sparkloom.operators import relations as K
from sparkloom.operators import resolve
from sparkloom.storage import large, written

S = K.S
# The confidence of an entity of a known kind, and of any other.
KNOWN, OTHER = 0.9, 0.6


def document_graph(tokens: DataFrame, chunked: DataFrame | None = None, config: Config = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """The logs entity_contrib and relation_contrib (see ``operators.graph``) of parsed documents.

    Names are resolved within a document in the order in which they are met: a
    sentence's marked entities, then the ends of its relations. The first mention of a
    name gives its entity's kind and wording. Of relations with one source, type,
    target and polarity the most confident, then the first, stays; ends that have
    become one name go. ``chunked`` (document_id, vector_id, start, end) places each
    sentence in a chunk.
    """
    kept = K.sentences(tokens, config.sentence_chars)
    t = written(tokens.join(large(kept.select(*S)), [*S], "left_semi"), "tokens")
    found = written(K.extracted(t, config.relation_threshold, config.sentence_chars), "relations")
    zero = F.lit(0).cast("long")
    marked = K.mentions(t).select(*S, zero.alias("later"), F.col("token").cast("long").alias("at"), zero.alias("end"), F.col("name"), F.col("canonical"), F.col("kind"))
    ends = [
        found.select(*S, F.lit(1).cast("long"), (F.col("verb") * 100_000 + F.col("object")).cast("long"), F.lit(place).cast("long"), F.col(end), F.col(f"{end}_canonical"), F.col(f"{end}_kind"))
        for place, end in enumerate(("source", "target"))
    ]
    order = F.row_number().over(Window.partitionBy("document_id").orderBy("sent_id", "later", "at", "end", "canonical"))
    named = written(marked.union(ends[0]).union(ends[1]).withColumn("seq", order), "names")
    first = named.groupBy("document_id", "kind", "canonical").agg(F.min("seq").alias("seq"))
    one = written(resolve.resolved(first, config.merge_threshold).select("document_id", "kind", "canonical", "resolved"), "resolved")
    resolved = named.join(large(one), ["document_id", "kind", "canonical"])
    best = resolved.groupBy("document_id", F.col("resolved").alias("canonical_name")).agg(F.min(F.struct("seq", F.col("kind").alias("type"), F.col("name").alias("display_name"))).alias("f"))
    entities = best.select("document_id", "f.seq", "f.type", "canonical_name", "f.display_name", F.when(F.col("f.type") == "OTHER", OTHER).otherwise(KNOWN).alias("confidence"))

    own = entities.select("document_id", "canonical_name", F.col("type").alias("own_type"))
    rows = found.join(large(kept), [*S])
    for end in ("source", "target"):
        key = one.select("document_id", F.col("kind").alias(f"{end}_kind"), F.col("canonical").alias(f"{end}_canonical"), F.col("resolved").alias(f"{end}_name"))
        rows = rows.join(large(key), ["document_id", f"{end}_kind", f"{end}_canonical"])
        rows = rows.join(large(own.withColumnsRenamed({"canonical_name": f"{end}_name", "own_type": f"{end}_type"})), ["document_id", f"{end}_name"])
    rows = rows.where("source_name <> target_name")
    seq = F.row_number().over(Window.partitionBy("document_id").orderBy("sent_id", "verb", "object", "source_name", "target_name"))
    if chunked is None:
        placed = rows.withColumn("chunk_id", F.lit(""))
    else:
        places = D.located(kept.select("document_id", F.col("sentence_start").alias("offset")).distinct(), chunked, "document_id")
        placed = rows.join(large(places.select("document_id", F.col("offset").alias("sentence_start"), F.col("vector_id").alias("chunk_id"))), ["document_id", "sentence_start"])
    relations = placed.select(
        "document_id", seq.alias("seq"), "source_type", F.col("source_name").alias("source_canonical"), "type", "target_type", F.col("target_name").alias("target_canonical"),
        "predicate", "confidence", "polarity", "sentence", "chunk_id",
    )
    return entities, G.deduplicated(relations)


def projection(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A document's own graph: nodes (document_id, text, label) and its positive edges (document_id, source, relation, target); ends that are no entity become nodes of kind UNKNOWN."""
    edges = relations.where("polarity = 'positive'").select("document_id", F.col("source_canonical").alias("source"), F.col("type").alias("relation"), F.col("target_canonical").alias("target"))
    nodes = entities.select("document_id", F.col("canonical_name").alias("text"), F.col("type").alias("label"))
    ends = edges.select("document_id", F.col("source").alias("text")).union(edges.select("document_id", F.col("target").alias("text"))).distinct()
    more = ends.join(large(nodes), ["document_id", "text"], "left_anti").withColumn("label", F.lit("UNKNOWN"))
    return nodes.unionByName(more), edges
