"""The graph kept up to date against aggregates of the whole log."""

import numpy as np
from pyspark.sql import functions as F

from sparkloom.operators import graph as G
from sparkloom.operators.graph_upkeep import GraphStore

ENTITY = "document_id string, seq int, type string, canonical_name string, display_name string, confidence double"
RELATION = "document_id string, seq int, source_type string, source_canonical string, type string, target_type string, target_canonical string, predicate string, confidence double, polarity string, sentence string, chunk_id string"


def logs(spark, documents, seed):
    """Every document names a hub, and some of a few entities."""
    rng = np.random.default_rng(seed)
    entities, relations = [], []
    for d in documents:
        entities.append((f"d{d:03}", 0, "ORG", "hub", f"Hub {seed}.{d}", float(rng.integers(70, 100)) / 100))
        for i in range(rng.integers(1, 5)):
            a, b = rng.integers(0, 12, 2)
            entities.append((f"d{d:03}", i + 1, "PERSON", f"p{a}", f"P{a} of {d}", float(rng.integers(70, 80)) / 100))
            relations.append((f"d{d:03}", i, "ORG", "hub", "USES", "PERSON", f"p{a}", f"use{i}", float(rng.integers(70, 75)) / 100, "positive", f"s{b % 2}", ""))
            relations.append((f"d{d:03}", i, "PERSON", f"p{a}", "LEADS", "PERSON", f"p{b}", f"lead{d}", 0.9, ("positive", "negative")[b % 2], "same", ""))
    return spark.createDataFrame(entities, ENTITY), spark.createDataFrame(relations, RELATION)


def rows(df, by):
    return sorted(tuple(r[c] for c in by) for r in df.collect())


def same(store, entities, relations):
    names = ("id", "type", "canonical_name", "display_name", "mentions_count", "confidence")
    assert rows(store.entities(), names) == rows(G.entities(entities), names)
    names = ("id", "source_id", "target_id", "type", "polarity", "predicate", "confidence", "evidence_count")
    want = G.relationships(relations)
    assert rows(store.relationships(), names) == rows(want, names)


def test_changes_equal_a_full_build(spark):
    entities, relations = logs(spark, range(60), 1)
    store = GraphStore(entities, relations)
    same(store, entities, relations)
    # some documents come again, some are new, some go
    new = logs(spark, [3, 4, 59, 70, 71], 2)
    removed = spark.createDataFrame([("d000",), ("d007",), ("nobody",)], "document_id string")
    store.replace(*new, removed)
    gone = new[0].select("document_id").union(removed)
    entities, relations = (G.without(log, gone).unionByName(more) for log, more in zip((entities, relations), new, strict=True))
    same(store, entities, relations)
    # more than is held of the hub's names and confidences
    many = spark.createDataFrame([(f"d{i:03}",) for i in range(30)], "document_id string")
    assert store.remove(many) > 0
    entities, relations = G.without(entities, many), G.without(relations, many)
    same(store, entities, relations)
    store.remove(entities.select("document_id"))
    assert store.entities().count() == store.relationships().count() == 0


def test_a_change_writes_its_own_keys_only(spark):
    entities, relations = logs(spark, range(40), 5)
    lone = entities.where("document_id = 'd001'").withColumns({"canonical_name": F.lit("alone"), "document_id": F.lit("new")})
    store = GraphStore(entities, relations)
    assert store.replace(lone, relations.limit(0)) == 0
    states = store.nodes.states
    assert {r.canonical_name for r in states.changed(states.versions()[-1]).collect()} == {"alone"}
    parts = store.nodes.parts
    assert {r.document_id for r in parts.changed(parts.versions()[-1]).collect()} == {"new"}
