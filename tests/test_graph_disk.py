"""The graph's queries move few bytes: what is done for each document needs no shuffle, and shuffle files of written tables go at once."""

import re

from sparkloom import catalog as C
from sparkloom import catalog_index as I
from sparkloom import storage
from sparkloom.operators import graph as G
from sparkloom.operators import graph_upkeep as U
from sparkloom.operators import name_index as N
from sparkloom.plans import star

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return re.findall(r"Exchange (\w+\([^)]*\))", plan(df))


def shuffle_files(spark):
    return spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().toString().count(".data")


def test_documents_of_the_log_are_grouped_without_a_shuffle(spark):
    own, relations = C.graph_logs(spark, SF)
    for df in (G.relationships(relations), G.entities(own)):
        found = exchanges(df)
        assert len(found) == 1 and "document_id" not in found[0]
    assert exchanges(G.entities(own).groupBy("type").count())[0].startswith("hashpartitioning(type")


def test_shuffle_files_of_written_tables_go_at_once(spark):
    before = shuffle_files(spark)
    made = storage.written(spark.range(1000).repartition(7, "id"), "dealt")
    kept = storage.kept_by(spark, "dealt", [f"{SF}/nation.parquet"], "id", lambda n: spark.range(1000).repartition(n, "id"))
    assert shuffle_files(spark) <= before
    assert made.count() == kept.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_lines_of_several_suppliers_and_orders_make_each_relation_once(spark):
    def rows(kind, *values):
        return spark.createDataFrame(list(values), kind)

    log = star.relation_contributions(
        rows("c_custkey long, c_name string, c_nationkey long, c_acctbal double", (1, "Ada", 1, 1.0), (2, "Bob", 1, 1.0)), rows("s_suppkey long, s_name string, s_nationkey long", (1, "Acme", 1), (1, "Acme", 1), (1, "Best", 1)),
        rows("n_nationkey long, n_name string, n_regionkey long", (1, "Ruritania", 1)), rows("r_regionkey long, r_name string", (1, "Asia")), rows("p_partkey long, p_name string", (1, "Bolt"), (1, "Nut")),
        rows("o_orderkey long, o_custkey long", (5, 1), (5, 2)),
        rows("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_discount double, l_tax double", (5, 1, 1, 1, 0.1, 0.2), (5, 1, 9, 2, 0.1, 0.2), (7, 1, 1, 3, 0.1, 0.2), (None, 1, 1, 4, 0.1, 0.2), (5, 9, 1, 5, 0.1, 0.2)), tasks=3,
    )
    got = sorted((r.document_id or "", r.seq, r.source_canonical, r.target_canonical) for r in log.where("type IN ('PROVIDES', 'USES')").collect())
    sold = [(d, n * 2, s, p) for d, n in (("o5", 1), ("o7", 3), ("", 4)) for s in ("acme", "acme", "best") for p in ("bolt", "nut")]
    bought = [("o5", n * 2 + 1, c, p) for n in (1, 2) for c in ("ada", "bob") for p in ("bolt", "nut")]
    assert got == sorted(sold + bought)


def kept_of(monkeypatch):
    """The tags of tables that are looked for or built from now on."""
    tags = []
    for name in ("kept", "kept_by"):
        monkeypatch.setattr(storage, name, lambda spark, tag, *rest, make=getattr(storage, name): tags.append(tag) or make(spark, tag, *rest))
    return tags


def test_a_slice_of_edges_builds_no_entities(spark, monkeypatch):
    tags = kept_of(monkeypatch)
    assert C.graph_slice(spark, SF).count() == 150
    assert not [t for t in tags if t.startswith("entities")] and [t for t in tags if t.startswith("relationships")]


def test_searches_of_names_build_no_edges(spark, monkeypatch):
    tags = kept_of(monkeypatch)
    assert C.graph_search(spark, SF).count() and I.graph_search_batch(spark, SF).count() and C.graph_entities_of_type(spark, SF).count()
    assert not [t for t in tags if t.startswith("relationships")]


def test_hops_copy_no_edges_and_move_none(spark, monkeypatch):
    tags, made = [], G.written
    monkeypatch.setattr(G, "written", lambda df, tag: tags.append(tag) or made(df, tag))
    assert C.graph_neighbors_d2(spark, SF).count() and set(tags) == {"seen", "hop"}
    edges, few = C.graph_edges(spark, SF), made(C.graph_nodes(spark, SF).where("type = 'LOCATION'").select("id"), "ids")
    touched = G.touching(edges, few)
    assert not [e for e in exchanges(touched) if "source_id" in e or "target_id" in e]
    own = {r.id for r in few.collect()}
    assert sorted(r.id for r in touched.collect()) == sorted(r.id for r in edges.collect() if r.source_id in own or r.target_id in own)


def test_evidence_of_some_edges_is_chosen_where_it_lies(spark, monkeypatch):
    tags = kept_of(monkeypatch)
    found = C.graph_detail_evidence(spark, SF)
    assert not [e for e in exchanges(found) if "document_id" in e] and not [t for t in tags if t.startswith("relationships")]


def test_a_documents_entities_are_aggregated_alone(spark, monkeypatch):
    tags = kept_of(monkeypatch)
    found = plan(I.graph_document_fallback(spark, SF))
    assert found.rindex("LeftSemi") > found.rindex("HashAggregate") and not [t for t in tags if t.startswith(("relationships", "entities"))]


def test_names_are_dealt_before_their_grams_are_made(spark, monkeypatch):
    nodes, terms = C.graph_nodes(spark, SF), spark.createDataFrame([(1, "an"), (2, "e"), (3, "supplier")], "query_id long, term string")
    want = sorted(map(tuple, N.search(N.built(nodes), terms, 20).select("query_id", "rank", "id").collect()))
    monkeypatch.setattr(N, "TASK_NAMES", 40)
    index = N.built(nodes)
    assert sorted(map(tuple, N.search(index, terms, 20).select("query_id", "rank", "id").collect())) == want
    assert index.postings().count() == index.counts().groupBy().sum("ids").collect()[0][0]


def test_parts_need_no_shuffle_and_states_are_joined_where_they_lie(spark):
    own, relations = C.graph_logs(spark, SF)
    parts = U.edge_parts(relations)
    assert not exchanges(U.entity_parts(own)) and not exchanges(parts)
    states = U._aggregated(storage.written(parts, "parts"), ("source_id", "target_id", "type", "polarity"), last=True)
    assert not exchanges(states)
    got = {(r.id, r.source_id, r.target_id, r.n, r.names[0].name, r.confidences[0].confidence) for r in states.collect()}
    assert got == {(r.id, r.source_id, r.target_id, r.evidence_count, r.predicate, r.confidence) for r in G.relationships(relations).collect()}


def test_a_store_keeps_the_views_it_is_given(spark):
    _, relations = C.graph_logs(spark, SF)
    store = U.GraphStore(relations=relations.where("document_id < 'o2'"))
    assert store.nodes is None and store.relationships().count() == G.relationships(relations.where("document_id < 'o2'")).count()
