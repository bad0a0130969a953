"""The document operators on small inline tables."""

import io
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from sparkloom.config import Config
from sparkloom.functions import filters
from sparkloom.functions import text as T
from sparkloom.operators import documents as D
from sparkloom.operators import graph as G
from sparkloom.operators import questions as Q
from sparkloom.operators import relations as K
from sparkloom.operators import resolve
from sparkloom.operators import retrieval as R
from sparkloom import ports
from sparkloom.plans import ask
from sparkloom.sources import formats, web
from sparkloom.streaming import ingest

HANDBOOK = "1. WELCOME\nWe are glad you joined.\n2. LEAVE POLICY\nEmployees accrue leave monthly.\n3. PAYROLL\nSalaries are paid on the last day."


def values(spark, column, rows):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], "x string").select(column(F.col("x"))).collect()]


def test_cleaning(spark):
    assert values(spark, T.clean, ["a\t\tb\r\nc   d\n\n\n\ne", "po​licy﻿", None, " \n "]) == ["a b\nc d\n\ne", "policy", "", ""]


def test_sections_titles_and_offsets(spark):
    docs = spark.createDataFrame([(1, HANDBOOK), (2, ""), (3, None)], "doc_id long, text string")
    rows = D.sections(docs).orderBy("section_id").collect()
    assert [(r.section_id, r.title) for r in rows] == [(0, "1. WELCOME"), (1, "2. LEAVE POLICY"), (2, "3. PAYROLL")]
    assert all(HANDBOOK[r.start :].startswith(r.content) for r in rows)
    assert D.rejected(docs).count() == 2


def test_chunks_are_dense_and_placed(spark):
    docs = spark.createDataFrame([(1, HANDBOOK)], "doc_id long, text string")
    small = Config(chunk_size=30, chunk_overlap=10)
    rows = sorted(D.chunks(docs, config=small).collect(), key=lambda r: r.chunk_id)
    assert [r.chunk_id for r in rows] == list(range(len(rows))) and len(rows) > 3
    assert all(HANDBOOK[r.start : r.end] == r.text and r.vector_id == f"1_{r.chunk_id}" for r in rows)
    at = spark.createDataFrame([(1, rows[1].start), (1, 10_000)], "doc_id long, offset int")
    assert {r.offset: r.vector_id for r in D.located(at, D.chunks(docs, config=small)).collect()} == {rows[1].start: "1_0", 10_000: ""}


def test_terms_and_phrases(spark):
    assert values(spark, T.terms, ["What is the Über_x été 42 of a b?"]) == [["über_x", "été", "42"]]
    texts = ["What does Acme Corp pay?", "Ünder Den Bäumen A. B-C & D", "ABC"]
    assert values(spark, T.phrases, texts) == [re.findall(T.PROPER_PHRASE, t) for t in texts]


def test_names(spark):
    rows = [("Microsoft Corporation", "ORG"), ("Microsoft Corp.", "ORG"), ("the Microsoft", "ORG"), ("Priya Group", "PERSON"), ("The Finance Department's", "DEPARTMENT"), ("Group", "ORG"), ("Dr. the", None)]
    got = spark.createDataFrame(rows, "n string, k string").select(T.canonical_name(F.col("n"), F.col("k"))).collect()
    assert [r[0] for r in got] == ["microsoft", "microsoft", "microsoft", "priya group", "finance department", "group", ""]
    assert values(spark, T.display_name, ["the  Head of  Finance", "The", "Priya's"]) == ["Head of Finance", "The", "Priya"]


def test_filters(spark):
    df = spark.createDataFrame([("x", "a"), ("y", None)], "document_id string, lang string")
    keep = lambda f: [r.document_id for r in df.where(filters.predicate(df, f)).collect()]
    assert keep({"document_id": "x"}) == ["x"] and keep({"document_id": ["x", "y"], "lang": []}) == ["x", "y"]
    assert keep({"lang": "a", "none": 1}) == [] and keep(None) == ["x", "y"] and keep({"lang": {}}) == ["x", "y"]
    with pytest.raises(ValueError):
        keep({"lang": {"$gt": 1}})


CHUNKS = [("d1_0", "The leave policy gives twenty days of leave.", "d1"), ("d2_0", "Payroll salary is paid monthly.", "d2"), ("d3_0", "Office dogs are welcome.", "d3"), ("d3_1", "Parking is free.", "d3")]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(CHUNKS, "vector_id string, text string, document_id string")


def test_keyword_search_and_filter_after_scoring(spark, chunks):
    asked = spark.createDataFrame([(1, "payroll salary"), (2, "leave leave"), (3, "zebra"), (4, " ")], "query_id long, query string")
    scores = R.bm25_scores(chunks, asked)
    best = {r.query_id: r.vector_id for r in R.top(scores, 1).collect()}
    assert best == {1: "d2_0", 2: "d1_0"}
    kept = {(r.query_id, r.vector_id): r.score for r in R.filtered(scores, chunks, {"document_id": "d2"}).collect()}
    assert kept == {(1, "d2_0"): next(r.score for r in scores.collect() if r.query_id == 1)}
    assert {r.vector_id for r in R.overlap_scores(chunks, asked).where("query_id = 1").collect()} == {"d2_0"}


def test_bm25_floors_negative_idf(spark):
    rows = spark.createDataFrame([(str(i), f"common word{i}") for i in range(5)], "vector_id string, text string")
    asked = spark.createDataFrame([(1, "common")], "query_id long, query string")
    got = R.bm25_scores(rows, asked).collect()
    import math

    rare, often = math.log(4.5 / 1.5), math.log(0.5 / 5.5)
    mean = (5 * rare + often) / 6
    assert len(got) == 5 and got[0].score == pytest.approx(0.25 * mean * 1 * 2.5 / (1 + 1.5))


def test_fusion_keeps_sources_and_scores(spark):
    ranked = lambda rows: spark.createDataFrame([(1, *r) for r in rows], "query_id long, vector_id string, score double, rank int")
    got = R.fused([("semantic", ranked([("a", 0.9, 1), ("b", 0.8, 2)])), ("keyword", ranked([("b", 4.0, 1), ("c", 3.0, 2)]))], 10).orderBy("rank").collect()
    assert [(r.vector_id, r.source) for r in got] == [("b", "hybrid"), ("a", "semantic"), ("c", "keyword")]
    assert got[0].scores == {"semantic": 0.8, "keyword": 4.0} and got[0].score == pytest.approx(1 / 62 + 1 / 61)


def test_reranking(spark):
    rows = spark.createDataFrame([(1, "payroll salary", "a", "nothing here", 0.5, 1), (1, "payroll salary", "b", "payroll salary", 0.5, 2)], "query_id long, query string, vector_id string, text string, score double, rank int")
    assert [r.vector_id for r in R.reranked(rows, 5).orderBy("rerank_rank").collect()] == ["b", "a"] and R.reranked(rows, 1).count() == 1


def test_nearest_equals_brute_force(spark):
    import numpy as np

    x = np.random.default_rng(0).normal(size=(120, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {(r.query_id, r["rank"]): r.vec_id for r in R.nearest(df, df.where("vec_id % 50 = 0"), 5, block=2).collect()}
    d = ((x[[0, 50, 100], None].astype(np.float32) - x.astype(np.float32)[None]) ** 2).sum(-1)
    assert got == {(q, k + 1): int(i) for q, row in zip((0, 50, 100), np.argsort(d, axis=1)[:, :5], strict=True) for k, i in enumerate(row)}


def test_understanding_and_rewrites(spark):
    texts = ["Summarize the leave policy", "Compare the 2023 and 2024 policies", "What is the leave policy?", "leave policy", "What does Acme Corp pay?", ""]
    rows = Q.understood(spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")).orderBy("query_id").collect()
    assert [r.intent for r in rows] == ["summarization", "analysis", "question_answering", "lookup", "question_answering", "lookup"]
    assert (rows[4].token_count, rows[4].entities) == (5, ["What", "Acme Corp"]) and rows[0].complexity == pytest.approx(0.15 + 4 / 80 + 0.2)
    got = Q.rewritten(spark.createDataFrame([(1, "hey tell me about pto")], "query_id long, query string"), {"PTO": "paid time off"}).orderBy("variant_no").collect()
    assert [r.rewrite for r in got] == ["What do the indexed documents say about pto paid time off?", "Which document or policy section covers pto paid time off?", "What are the specific rules, limits, and conditions for pto?"]


def test_context_routes_and_answers(spark):
    rows = [(1, "a", "Same text.", 0.95, 1), (1, "b", "Same   text.", 0.9, 2), (1, "c", "Other text.", 0.8, 3), (2, "d", "x" * 30, 4.2, 1), (2, "e", "y" * 30, 0.2, 2)]
    found = spark.createDataFrame(rows, "query_id long, vector_id string, text string, score double, rank int")
    assert {(r.query_id, r.vector_id) for r in Q.context(found, Config(context_tokens=10)).collect()} == {(1, "a"), (1, "c"), (2, "d")}
    asked = spark.createDataFrame([(1, "leave policy"), (2, "explain it"), (3, "nothing")], "query_id long, query string")
    selected = Q.context(found)
    routes = {r.query_id: (r.route, r.confidence) for r in Q.routed(Q.understood(asked), selected).collect()}
    assert routes == {1: ("direct", 0.95), 2: ("local_llm", 1.0), 3: ("local_llm", 0.0)}
    answers = {r.query_id: r.answer for r in Q.extractive_answers(asked, selected).collect()}
    assert answers[1] == "Same text. [1] Other text. [2]" and answers[3] == Q.NO_CONTEXT
    assert {r.query_id: r.context for r in Q.context_text(selected).collect()}[1] == "[1] Same text.\n\n[2] Other text."


@pytest.mark.parametrize("mode", ["keyword", "semantic", "hybrid"])
def test_answers_end_to_end(spark, chunks, mode):
    asked = spark.createDataFrame([(1, "payroll salary"), (2, " ")], "query_id long, query string")
    rows = {r.query_id: r for r in ask.answer(chunks, asked, mode=mode, rewrite=mode == "hybrid").collect()}
    assert "Payroll salary" in rows[1].answer and rows[2].answer == Q.NO_CONTEXT


def test_store_listing_and_deletion(spark):
    store = spark.createDataFrame([("a_0", "a", 0, "f.txt", "2024-01-01"), ("a_1", "a", 1, "f.txt", "2024-01-01"), ("b_0", "b", 0, "", "2024-02-01"), ("_0", "", 0, "g", "2024-03-01")], "vector_id string, document_id string, chunk_id int, filename string, indexed_at string")
    assert [tuple(r) for r in D.listing(store).collect()] == [("b", "b", "2024-02-01", 1), ("a", "f.txt", "2024-01-01", 2)]
    left, counts = D.deleted(store, spark.createDataFrame([("a",), ("z",)], "document_id string"))
    assert left.count() == 2 and {tuple(r) for r in counts.collect()} == {("a", 2), ("z", 0)}
    assert D.upserted(store, store.limit(1)).count() == 4
    assert D.emptied(store).columns == store.columns and D.emptied(store).count() == 0


def test_an_updated_index_answers_like_a_new_one(spark, chunks):
    index = R.indexed(chunks)
    new = spark.createDataFrame([("d3_0", "Cats are payroll.", "d3"), ("d4_0", "Nothing else.", "d4")], "vector_id string, text string, document_id string")
    changed = R.updated(index, new, spark.createDataFrame([("d1",)], "document_id string"))
    again = R.indexed(chunks.where("document_id = 'd2'").union(new))
    asked = spark.createDataFrame([(1, "payroll salary cats nothing")], "query_id long, query string")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(changed.select("vector_id", "terms")) == key(again.select("vector_id", "terms")) and key(R.bm25_scores(changed, asked)) == key(R.bm25_scores(again, asked))


def test_cosine(spark):
    rows = [([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])]
    got = spark.createDataFrame(rows, "a array<double>, b array<double>").select(R.cosine(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == pytest.approx([0.5**0.5, 0.0])


def test_generators_by_route(spark):
    routes = spark.createDataFrame([(1, "q", "c", "direct"), (2, "q", "c", "online_llm"), (3, "q", "c", None)], "query_id long, query string, context string, route string")
    named = lambda name: lambda df: df.select("query_id", F.lit(name).alias("reply"))
    assert sorted(map(tuple, ports.by_route(routes, {"online_llm": named("model")}, named("plain")).collect())) == [(1, "plain"), (2, "model"), (3, "plain")]


def test_an_archive_says_what_it_leaves_out():
    data = archive([(f"{i}.txt", f"text {i}") for i in range(5)])
    text, n, remark = formats.archive_text(data, Config(archive_members=3))
    assert n == 3 and "2 members" in remark and "text 2" in text and "text 3" not in text
    assert formats.archive_text(data)[2] is None
    with pytest.raises(formats.Unreadable):
        formats.archive_text(data, Config(archive_bytes=10))


ENTITY = "document_id string, seq int, type string, canonical_name string, display_name string, confidence double"
RELATION = "document_id string, seq int, source_type string, source_canonical string, type string, target_type string, target_canonical string, predicate string, confidence double, polarity string, sentence string, chunk_id string"


def test_graph_from_contributions(spark):
    e = spark.createDataFrame([("d1", 1, "PERSON", "priya", "Priya", 0.9), ("d1", 2, "ORG", "finance", "Finance", 0.9), ("d2", 1, "PERSON", "priya", "PRIYA", 0.95), ("d2", 2, "ORG", "finance", "Finance", 0.9), ("d2", 3, "ODD", "atlas", "Atlas", 0.6)], ENTITY)
    r = spark.createDataFrame(
        [("d1", 1, "PERSON", "priya", "REPORTS_TO", "ORG", "finance", "report to", 0.8, "positive", "s1", "c1"), ("d2", 1, "PERSON", "priya", "REPORTS_TO", "ORG", "finance", "reports to", 0.9, "positive", "s2", "c2"), ("d2", 2, "PERSON", "priya", "MANAGES", "ORG", "finance", "manage", 0.9, "negative", "s3", "c2")],
        RELATION,
    )
    nodes, edges = G.entities(e), G.relationships(r)
    people = {x.canonical_name: (x.display_name, x.mentions_count, x.confidence, x.type) for x in nodes.collect()}
    assert people == {"priya": ("Priya", 2, 0.95, "PERSON"), "finance": ("Finance", 2, 0.9, "ORG"), "atlas": ("Atlas", 1, 0.6, "OTHER")}
    positive = [x for x in edges.collect() if x.polarity == "positive"]
    assert [(x.predicate, x.confidence, x.evidence_count) for x in positive] == [("reports to", 0.9, 2)]
    shown, of = G.sliced(nodes, edges)
    assert shown.count() == 1 and {x.canonical_name for x in of.collect()} == {"priya", "finance"}
    assert [x.canonical_name for x in G.isolated(nodes, edges).collect()] == ["atlas"]
    pruned = G.entities(G.without(e, spark.createDataFrame([("d2",)], "document_id string")))
    assert {x.canonical_name for x in pruned.collect()} == {"priya", "finance"}
    seen, followed = G.neighbours(edges, nodes.where("canonical_name = 'priya'"), 1, 10)
    assert {x.distance for x in seen.collect()} == {0, 1} and [(x.hop, x.truncated) for x in followed.collect()] == [(1, False)]
    assert [x.neighbor_name for x in G.detail(edges, nodes.where("canonical_name = 'priya'"), nodes).orderBy("rank").collect()] == ["Finance", "Finance"]
    assert [G.bounded(x) for x in (None, 0, 7, 9999)] == [150, 1, 7, 500] and G.of_type(nodes, "nonsense").count() == 1
    assert G.evidence(r).count() == 3 and [x.canonical_name for x in G.search(nodes, "PRI", 5).collect()] == ["priya"]
    assert {tuple(x) for x in G.degrees(of, shown).select("degree").collect()} == {(1,)}
    assert {(x.measure, x.key): x.n for x in G.stats(nodes, edges, e).collect()}["relationships", "REPORTS_TO"] == 1


#: Parses by hand. For each word: lemma, part of speech, dependency, head, its entity's label. What is extracted.
PARSES = {
    "Priya works in Finance": (
        [("Priya", "PROPN", "nsubj", 1, "PERSON"), ("work", "VERB", "ROOT", 1, ""), ("in", "ADP", "prep", 1, ""), ("Finance", "PROPN", "pobj", 2, "ORG")],
        {("Priya", "WORKS_IN", "Finance", "positive", 0.95)},
    ),
    "Priya reports to the Head of Finance who reports to Ada": (
        [("Priya", "PROPN", "nsubj", 1, "PERSON"), ("report", "VERB", "ROOT", 1, ""), ("to", "ADP", "prep", 1, ""), ("the", "DET", "det", 4, ""), ("head", "NOUN", "pobj", 2, ""), ("of", "ADP", "prep", 4, ""), ("Finance", "PROPN", "pobj", 5, "ORG"), ("who", "PRON", "nsubj", 8, ""), ("report", "VERB", "relcl", 4, ""), ("to", "ADP", "prep", 8, ""), ("Ada", "PROPN", "pobj", 9, "PERSON")],
        {("Priya", "REPORTS_TO", "Head of Finance", "positive", 0.95), ("Head of Finance", "REPORTS_TO", "Ada", "positive", 0.9)},
    ),
    "Priya never manages Finance": (
        [("Priya", "PROPN", "nsubj", 2, "PERSON"), ("never", "ADV", "neg", 2, ""), ("manage", "VERB", "ROOT", 2, ""), ("Finance", "PROPN", "dobj", 2, "ORG")],
        {("Priya", "MANAGES", "Finance", "negative", 1.0)},
    ),
    "nobody manages Finance": ([("nobody", "PRON", "nsubj", 1, ""), ("manage", "VERB", "ROOT", 1, ""), ("Finance", "PROPN", "dobj", 1, "ORG")], set()),
    "Helios is used by Engineering": (
        [("Helios", "PROPN", "nsubjpass", 2, "PRODUCT"), ("be", "AUX", "auxpass", 2, ""), ("use", "VERB", "ROOT", 2, ""), ("by", "ADP", "agent", 2, ""), ("Engineering", "PROPN", "pobj", 3, "ORG")],
        {("Engineering", "USES", "Helios", "positive", 0.95)},
    ),
    "Finance is managed by Priya": (
        [("Finance", "PROPN", "nsubjpass", 2, "ORG"), ("be", "AUX", "auxpass", 2, ""), ("manage", "VERB", "ROOT", 2, ""), ("by", "ADP", "agent", 2, ""), ("Priya", "PROPN", "pobj", 3, "PERSON")],
        {("Finance", "MANAGED_BY", "Priya", "positive", 0.9)},
    ),
    "Payroll is part of Finance": (
        [("Payroll", "PROPN", "nsubj", 1, "ORG"), ("be", "AUX", "ROOT", 1, ""), ("part", "NOUN", "attr", 1, ""), ("of", "ADP", "prep", 2, ""), ("Finance", "PROPN", "pobj", 3, "ORG")],
        {("Payroll", "PART_OF", "Finance", "positive", 0.95)},
    ),
}


def test_relations_of_hand_parses(spark):
    rows = []
    for sentence, (parse, _) in PARSES.items():
        for i, (word, (lemma, pos, dep, head, label)) in enumerate(zip(sentence.split(), parse, strict=True)):
            rows.append((sentence, 0, i, word, word.lower(), lemma, pos, "WP" if word == "who" else "", dep, head, label, i if label else None, i * 10))
    frame = spark.createDataFrame(rows, "document_id string, sent_id int, i long, text string, lower string, lemma string, pos string, tag string, dep string, head long, ent_label string, ent_id long, start_char int")
    got = {s: set() for s in PARSES}
    for r in K.extracted(frame).collect():
        got[r.document_id].add((r.source, r.type, r.target, r.polarity, r.confidence))
    assert got == {s: want for s, (_, want) in PARSES.items()}


def test_headings_become_sentences(spark):
    assert values(spark, K.terminated, ["Leadership\nPriya leads.\n\nOne two three four five six seven eight nine"]) == ["Leadership.\nPriya leads.\n\nOne two three four five six seven eight nine"]


def test_resolution(spark):
    assert resolve.sorted_ratio("finance team", "team finance") == 100
    names = [("ORG", "acme widgets international"), ("ORG", "acme widget international"), ("ORG", "awi"), ("PERSON", "awi"), ("ORG", "finance"), ("ORG", "finance committee")]
    assert resolve.resolve_names(names, 92) == ["acme widgets international", "acme widgets international", "acme widgets international", "awi", "finance", "finance committee"]
    df = spark.createDataFrame([("d", i, k, n, "x") for i, (k, n) in enumerate(names)], "document_id string, seq int, kind string, canonical string, resolved string")
    assert [r.resolved for r in resolve.resolved(df).orderBy("seq").collect()] == resolve.resolve_names(names, 92)


def archive(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members:
            z.writestr(name, data)
    return out.getvalue()


def test_files(spark, tmp_path):
    page = "<html><title>T</title><nav>no</nav><h1>Head <b>ing</b></h1><p>Text</p><ul><li>one</li></ul><table><tr><td>a</td><td>b</td></tr></table><script>x</script></html>"
    docx = archive([("word/document.xml", f'<w:document xmlns:w="{formats._W[1:-1]}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>y</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:t>Body</w:t></w:r></w:p></w:body></w:document>')])
    files = {
        "a.html": page.encode(), "b.csv": b"Name;Role\nAda;Engineer\nBo;\n", "c.md": b"# T\n**bold** [l](u) ![i](u) `c`\n> q", "d.txt": b"caf\xe9", "e.xyz": b"?", "f.docx": docx, "g.tsv": b"a\tb\n1\t2", "i.zip": b"bad",
        "h.zip": archive([("Page 0123456789abcdef0123456789abcdef.md", "hello"), ("__MACOSX/x.md", "no"), ("t.csv", "n,v\n1,2"), ("p.png", "x"), (".hid/x.txt", "no")]),
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    rows = {r.path.rsplit("/", 1)[-1]: r for r in formats.extracted(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    text = {k: r.text for k, r in rows.items()}
    assert text["a.html"] == "T\n# Head ing\nText\n- one\na | b" and text["b.csv"] == "Name: Ada | Role: Engineer\nName: Bo"
    assert text["c.md"] == "# T\nbold l i c\nq" and text["d.txt"] == "café" and text["f.docx"] == "## Top\n\nBody\n\nx | y" and text["g.tsv"] == "a: 1 | b: 2"
    assert text["h.zip"] == "# Page\n\nhello\n\n# t\n\nn: 1 | v: 2" and rows["h.zip"].page_count == 2
    assert "unsupported" in rows["e.xyz"].error and "archive" in rows["i.zip"].error
    assert ".md" in formats.supported()


def test_recursive_splitting():
    text = "\n\n".join(f"Paragraph {i}. " + "word " * 40 for i in range(6))
    pieces = formats.split_recursively(text, 300, 40)
    assert all(len(p) <= 300 and p in text for p in pieces) and len(pieces) >= 5
    assert formats.split_recursively("x" * 25, 10, 3) == ["xxxxxxxxxx"] * 2 + ["x" * 10, "xxxx"] or all(len(p) <= 10 for p in formats.split_recursively("x" * 25, 10, 3))


def test_page_names(spark):
    df = spark.createDataFrame([("<TITLE a=1> A\n b </title>", "http://h/x/"), (None, "http://h/a/b%20c/"), ("", "http://h")], "html string, url string")
    assert [r[0] for r in df.select(web.title_or_path(F.col("html"), F.col("url"))).collect()] == ["A b", "b c", "h"]
    assert values(spark, web.page_filename, ["../../etc/passwd", "", "a b"]) == ["etc_passwd.html", "web-page.html", "a_b.html"]


def test_streaming_ingest_is_idempotent(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "chunks")
    source.mkdir()
    (source / "a.txt").write_text("Hello there. This is a text.")
    for _ in range(2):
        ingest.run(spark, str(source), out, str(tmp_path / "checkpoint"))
    (source / "b.txt").write_text("Another text.")
    ingest.run(spark, str(source), out, str(tmp_path / "checkpoint"))
    assert spark.read.parquet(out).count() == 2
