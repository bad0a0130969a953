"""Tables that grow with the input are not sent whole through the driver, however few bytes their files have."""

from sparkloom import catalog_knowledge as C
from sparkloom.operators import relations as K
from sparkloom.plans import knowledge, star
from sparkloom.storage import written


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def sold(spark, tmp_path):
    spark.createDataFrame([(i, f"Supplier {i}", 1) for i in range(3)], "s_suppkey long, s_name string, s_nationkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(1, "Ruritania", 1)], "n_nationkey long, n_name string, n_regionkey long").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(1, "Somewhere")], "r_regionkey long, r_name string").write.parquet(f"{tmp_path}/region.parquet")
    return str(tmp_path)


def test_relations_and_graphs_of_parses_broadcast_no_table(spark, tmp_path):
    tokens = written(C.tokens(spark, sold(spark, tmp_path), together=True), "tokens")
    found = K.extracted(tokens)
    entities, relations = knowledge.document_graph(tokens)
    nodes, edges = knowledge.projection(entities, relations)
    for df in (found, entities, relations, nodes, edges):
        assert "Broadcast" not in plan(df)
    assert found.count() == 3 * sum(len(r) for _, r in C.SENTENCES.values())


def test_names_are_made_once_for_each_row_of_their_table(spark, monkeypatch):
    """Below the joins with the lines, not above them."""
    def rows(kind, *values):
        return spark.createDataFrame(list(values), kind)

    made, canonical_name = [], star.canonical_name
    monkeypatch.setattr(star, "canonical_name", lambda name, kind: made.append(name._jc.toString()) or canonical_name(name, kind))
    log = star.relation_contributions(
        rows("c_custkey long, c_name string, c_nationkey long, c_acctbal double", (1, "Dr. Ada", 1, -1.0)), rows("s_suppkey long, s_name string, s_nationkey long", (1, "The Acme Inc.", 1)),
        rows("n_nationkey long, n_name string, n_regionkey long", (1, "Ruritania", 1)), rows("r_regionkey long, r_name string", (1, "Asia")), rows("p_partkey long, p_name string", (1, "Red Bolt")),
        rows("o_orderkey long, o_custkey long", (5, 1)), rows("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_discount double, l_tax double", (5, 1, 1, 1, 0.1, 0.2)),
    )
    got = {(r.document_id, r.seq): (r.source_canonical, r.source_display, r.target_canonical, r.polarity) for r in log.collect()}
    assert got[("o5", 2)][::2] == ("acme", "red bolt") and got[("o5", 3)][::2] == ("ada", "red bolt") and got[("c1", 1)][3] == "negative" and len(got) == 5
    assert made == ["c_name", "s_name", "n_name", "r_name", "p_name"]
