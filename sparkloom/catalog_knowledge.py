"""Queries of relation extraction and of the graph that comes from it, over parses of stated sentences about the suppliers.

No parser is installed, so the sentences below are parsed by hand: for each word its
lemma, part of speech, tag, dependency, head, entity label and entity number. Each is
said of every supplier, its nation and region ({s}, {n}, {r}). What must come out is
written beside the parse, worked out from the rules, and becomes the SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.catalog import _CANON, _CLEAN, _ORG, query, table
from sparkloom.operators import documents as D
from sparkloom.operators import relations as K
from sparkloom.operators import resolve
from sparkloom.plans import knowledge
from sparkloom.storage import large, spread, written

_S, _N, _R = ("{s}", "{s}", "PROPN"), ("{n}", "{n}", "PROPN"), ("{r}", "{r}", "PROPN")
#: name: words (text, lemma, pos, tag, dep, head, label, entity) and relations (source, kind, type, target, kind, predicate, confidence, polarity).
SENTENCES: dict[str, tuple[tuple, tuple]] = {
    "works": (
        ((*_S, "", "nsubj", 1, "ORG", 0), ("works", "work", "VERB", "", "ROOT", 1, "", None), ("in", "in", "ADP", "", "prep", 1, "", None), (*_N, "", "pobj", 2, "GPE", 3)),
        (("{s}", "ORG", "WORKS_IN", "{n}", "LOCATION", "work in", 0.95, "positive"),),
    ),
    "conjuncts": (
        ((*_S, "", "nsubj", 3, "ORG", 0), ("and", "and", "CCONJ", "", "cc", 0, "", None), ("Atlas", "Atlas", "PROPN", "", "conj", 0, "", None), ("use", "use", "VERB", "", "ROOT", 3, "", None),
         (*_N, "", "dobj", 3, "GPE", 4), ("and", "and", "CCONJ", "", "cc", 4, "", None), ("Helios", "Helios", "PROPN", "", "conj", 4, "PRODUCT", 6)),
        (("{s}", "ORG", "USES", "{n}", "LOCATION", "use", 1.0, "positive"), ("{s}", "ORG", "USES", "Helios", "PRODUCT", "use", 0.95, "positive"),
         ("Atlas", "OTHER", "USES", "{n}", "LOCATION", "use", 0.85, "positive"), ("Atlas", "OTHER", "USES", "Helios", "PRODUCT", "use", 0.85, "positive")),
    ),
    "passive": (
        ((*_N, "", "nsubjpass", 2, "GPE", 0), ("is", "be", "AUX", "", "auxpass", 2, "", None), ("managed", "manage", "VERB", "", "ROOT", 2, "", None), ("by", "by", "ADP", "", "agent", 2, "", None), (*_S, "", "pobj", 3, "ORG", 4)),
        (("{n}", "LOCATION", "MANAGED_BY", "{s}", "ORG", "manage", 0.9, "positive"),),
    ),
    "swapped": (
        ((*_N, "", "nsubjpass", 2, "GPE", 0), ("is", "be", "AUX", "", "auxpass", 2, "", None), ("used", "use", "VERB", "", "ROOT", 2, "", None), ("by", "by", "ADP", "", "agent", 2, "", None), (*_S, "", "pobj", 3, "ORG", 4)),
        (("{s}", "ORG", "USES", "{n}", "LOCATION", "use", 0.95, "positive"),),
    ),
    "part": (
        ((*_S, "", "nsubj", 1, "ORG", 0), ("is", "be", "AUX", "", "ROOT", 1, "", None), ("part", "part", "NOUN", "", "attr", 1, "", None), ("of", "of", "ADP", "", "prep", 2, "", None), (*_N, "", "pobj", 3, "GPE", 4)),
        (("{s}", "ORG", "PART_OF", "{n}", "LOCATION", "be part of", 0.95, "positive"),),
    ),
    "never": (
        ((*_S, "", "nsubj", 2, "ORG", 0), ("never", "never", "ADV", "", "neg", 2, "", None), ("manages", "manage", "VERB", "", "ROOT", 2, "", None), (*_N, "", "dobj", 2, "GPE", 3)),
        (("{s}", "ORG", "MANAGES", "{n}", "LOCATION", "manage", 1.0, "negative"),),
    ),
    "neither": (
        (("neither", "neither", "DET", "", "det", 1, "", None), (*_S, "", "nsubj", 2, "ORG", 1), ("supplies", "supply", "VERB", "", "ROOT", 2, "", None), (*_N, "", "dobj", 2, "GPE", 3)),
        (("{s}", "ORG", "PROVIDES", "{n}", "LOCATION", "supply", 1.0, "negative"),),
    ),
    "nobody": ((("Nobody", "nobody", "PROPN", "", "nsubj", 1, "PERSON", 0), ("manages", "manage", "VERB", "", "ROOT", 1, "", None), (*_N, "", "dobj", 1, "GPE", 2)), ()),
    "everyone": ((("Everyone", "everyone", "PROPN", "", "nsubj", 2, "ORG", 0), ("else", "else", "ADV", "", "advmod", 0, "", None), ("uses", "use", "VERB", "", "ROOT", 2, "", None), (*_N, "", "dobj", 2, "GPE", 3)), ()),
    "relative": (
        ((*_S, "", "nsubj", 1, "ORG", 0), ("reports", "report", "VERB", "", "ROOT", 1, "", None), ("to", "to", "ADP", "", "prep", 1, "", None), ("the", "the", "DET", "", "det", 4, "", None), ("Head", "head", "NOUN", "", "pobj", 2, "", None),
         ("of", "of", "ADP", "", "prep", 4, "", None), (*_N, "", "pobj", 5, "GPE", 6), ("who", "who", "PRON", "WP", "nsubj", 8, "", None), ("reports", "report", "VERB", "", "relcl", 4, "", None), ("to", "to", "ADP", "", "prep", 8, "", None), (*_R, "", "pobj", 9, "LOC", 10)),
        (("{s}", "ORG", "REPORTS_TO", "Head of {n}", "ROLE", "report to", 0.95, "positive"), ("Head of {n}", "ROLE", "REPORTS_TO", "{r}", "LOCATION", "report to", 0.9, "positive")),
    ),
    "unclassified": (
        ((*_S, "", "nsubj", 1, "ORG", 0), ("visits", "visit", "VERB", "", "ROOT", 1, "", None), (*_N, "", "dobj", 1, "GPE", 2)),
        (("{s}", "ORG", "RELATED_TO", "{n}", "LOCATION", "visit", 0.75, "positive"),),
    ),
    "unsure": ((("Atlas", "Atlas", "PROPN", "", "nsubj", 1, "", None), ("visits", "visit", "VERB", "", "ROOT", 1, "", None), (*_N, "", "dobj", 1, "GPE", 2)), ()),
    "date": (((*_S, "", "nsubj", 1, "ORG", 0), ("launched", "launch", "VERB", "", "ROOT", 1, "", None), ("2020", "2020", "NUM", "", "dobj", 1, "DATE", 2)), ()),
    "pronoun": (((*_S, "", "nsubj", 1, "ORG", 0), ("uses", "use", "VERB", "", "ROOT", 1, "", None), ("it", "it", "PRON", "", "dobj", 1, "", None)), ()),
    "itself": (((*_S, "", "nsubj", 1, "ORG", 0), ("uses", "use", "VERB", "", "ROOT", 1, "", None), (*_S, "", "dobj", 1, "ORG", 2)), ()),
    "team": (
        ((*_S, "", "nsubj", 1, "ORG", 0), ("leads", "lead", "VERB", "", "ROOT", 1, "", None), ("the", "the", "DET", "", "det", 4, "", None), ("Finance", "Finance", "PROPN", "", "compound", 4, "", None), ("team", "team", "NOUN", "", "dobj", 1, "", None)),
        (("{s}", "ORG", "LEADS", "Finance team", "DEPARTMENT", "lead", 1.0, "positive"),),
    ),
    "platform": (
        ((*_S, "", "nsubj", 1, "ORG", 0), ("develops", "develop", "VERB", "", "ROOT", 1, "", None), ("the", "the", "DET", "", "det", 4, "", None), ("billing", "billing", "NOUN", "", "compound", 4, "", None), ("platform", "platform", "NOUN", "", "dobj", 1, "", None)),
        (("{s}", "ORG", "DEVELOPS", "billing platform", "TECHNOLOGY", "develop", 1.0, "positive"),),
    ),
    "project": (
        ((*_S, "", "nsubj", 1, "ORG", 0), ("launched", "launch", "VERB", "", "ROOT", 1, "", None), ("Project", "Project", "PROPN", "", "compound", 3, "", None), ("Atlas", "Atlas", "PROPN", "", "dobj", 1, "PERSON", 3)),
        (("{s}", "ORG", "CREATED", "Project Atlas", "PROJECT", "launch", 1.0, "positive"),),
    ),
    "recovered": (
        ((*_S, "", "nsubj", 1, "ORG", 0), ("is", "be", "AUX", "", "ROOT", 1, "", None), ("part", "part", "NOUN", "", "attr", 1, "", None), ("of", "of", "ADP", "", "prep", 2, "", None), (*_N, "", "pobj", 3, "GPE", 4), ("and", "and", "CCONJ", "", "cc", 4, "", None),
         (*_R, "", "conj", 4, "LOC", 6), ("is", "be", "AUX", "", "auxpass", 8, "", None), ("managed", "manage", "VERB", "", "conj", 1, "", None), ("by", "by", "ADP", "", "agent", 8, "", None), ("Ada", "Ada", "PROPN", "", "pobj", 9, "PERSON", 10)),
        (("{s}", "ORG", "PART_OF", "{n}", "LOCATION", "be part of", 0.95, "positive"), ("{r}", "LOCATION", "MANAGED_BY", "Ada", "PERSON", "manage", 0.85, "positive")),
    ),
    "distant": (
        ((*_S, "", "nsubj", 17, "ORG", 0), *(("really", "really", "ADV", "", "advmod", 17, "", None) for _ in range(16)), ("owns", "own", "VERB", "", "ROOT", 17, "", None), (*_N, "", "dobj", 17, "GPE", 18)),
        (("{s}", "ORG", "OWNS", "{n}", "LOCATION", "own", 0.85, "positive"),),
    ),
    "endless": (
        ((*_S, "", "nsubj", 1, "ORG", 0), ("owns", "own", "VERB", "", "ROOT", 1, "", None), (*_N, "", "dobj", 1, "GPE", 2), *(("immeasurably", "immeasurably", "ADV", "", "advmod", 1, "", None) for _ in range(90))),
        (),  # more than a thousand characters
    ),
}
_FROM = "FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
_NAMES = {"{s}": "s_name", "{n}": "n_name", "{r}": "r_name"}
_TOKEN = "i long, text string, lemma string, pos string, tag string, dep string, head long, ent_label string, ent_id long"


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", *_NAMES.values())


def _filled(text: Column) -> Column:
    for mark, column in _NAMES.items():
        text = F.when(text == mark, F.col(column)).otherwise(text)
    return text


def tokens(spark: SparkSession, sf_dir: str, together: bool = False) -> DataFrame:
    """The token table of all sentences about all suppliers: a document for each sentence, or for each supplier."""
    words = [(name, i, *word[:6], word[6], word[7]) for name, (sentence, _) in SENTENCES.items() for i, word in enumerate(sentence)]
    stated = spark.createDataFrame(words, f"name string, {_TOKEN}")
    rows = spread(suppliers(spark, sf_dir)).crossJoin(F.broadcast(stated))  # a stated set of some two hundred words
    order = {name: i for i, name in enumerate(SENTENCES)}
    number = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])[F.col("name")]
    text = _filled(F.col("text"))
    document = F.concat(F.lit("s-"), "s_suppkey") if together else F.concat_ws("-", "name", "s_suppkey")
    start = (number * 1200 if together else F.lit(0)) + F.col("i") * 13
    own = [document.alias("document_id"), (number if together else F.lit(0)).cast("int").alias("sent_id"), "i", text.alias("text"), F.lower(text).alias("lower"), _filled(F.col("lemma")).alias("lemma")]
    return rows.select(*own, "pos", "tag", "dep", "head", "ent_label", "ent_id", start.cast("int").alias("start_char"))


def _sql_name(text: str) -> str:
    """The wording of an end, with the names of the row's supplier, nation and region."""
    for mark, column in _NAMES.items():
        if mark in text:
            before, after = text.split(mark)
            return " || ".join([f"'{x}'" if x else "''" for x in (before,)] + [column] + [f"'{x}'" for x in (after,) if x])
    return f"'{text}'"


def _sql_canonical(text: str, kind: str) -> str:
    return (_ORG if kind in ("ORG", "DEPARTMENT") else _CANON).format(x=_sql_name(text))


def _sql_relations(document: str) -> str:
    parts = []
    for at, (name, (_, relations)) in enumerate(SENTENCES.items()):
        for source, sk, kind, target, tk, predicate, confidence, polarity in relations:
            parts.append(
                f"SELECT {document.format(name=name)} AS document_id, {at} AS sent_id, {_sql_name(source)} AS source, '{sk}' AS source_kind, {_sql_canonical(source, sk)} AS source_canonical, "
                f"{_sql_name(target)} AS target, '{tk}' AS target_kind, {_sql_canonical(target, tk)} AS target_canonical, '{kind}' AS type, '{predicate}' AS predicate, CAST({confidence} AS DOUBLE) AS confidence, '{polarity}' AS polarity {_FROM}"
            )
    return " UNION ALL ".join(parts)


_COLUMNS = ("document_id", "source", "source_kind", "source_canonical", "target", "target_kind", "target_canonical", "type", "predicate", "confidence", "polarity")
_EACH, _ALL = "'{name}-' || s_suppkey", "'s-' || s_suppkey"


@query(f"SELECT {', '.join(_COLUMNS)} FROM ({_sql_relations(_EACH)})")
def relation_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.extracted(tokens(spark, sf_dir)).select(*_COLUMNS)


def _sql_mentions() -> str:
    """The marked entities of all sentences, but dates; longer sentences have none."""
    parts = []
    for at, (name, (words, _)) in enumerate(SENTENCES.items()):
        if name == "endless":
            continue
        for i, (text, *_rest, label, entity) in enumerate(words):
            if entity is not None and K.LABELS[label] not in K.UNLINKED:
                kind = K.LABELS[label]
                parts.append(f"SELECT {_EACH.format(name=name)} AS document_id, {i} AS token, {_sql_name(text)} AS name, '{kind}' AS kind, {_sql_canonical(text, kind)} AS canonical {_FROM}")
    return " UNION ALL ".join(parts)


@query(_sql_mentions())
def entity_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the parser marked, typed; the sentence that is too long is left out first."""
    t = K.with_extents(tokens(spark, sf_dir))
    kept = K.sentences(t)
    return K.mentions(t.join(large(kept.select(*K.S)), [*K.S], "left_semi")).select("document_id", "token", "name", "kind", "canonical")


def _sql_sentences() -> str:
    parts = []
    for at, (name, (words, _)) in enumerate(SENTENCES.items()):
        if name != "endless":
            parts.append(f"SELECT 's-' || s_suppkey AS document_id, {at} AS sent_id, " + " || ' ' || ".join(_sql_name(w[0]) for w in words) + f" AS sentence, {at * 1200} AS sentence_start {_FROM}")
    return " UNION ALL ".join(parts)


@query(_sql_sentences())
def parsed_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.sentences(tokens(spark, sf_dir, together=True))


# A supplier's document as a whole: of relations that repeat the most confident stays, then the first.
_DOCUMENT = f"""x AS ({_sql_relations(_ALL)}),
y AS (SELECT *, row_number() OVER (PARTITION BY document_id, source_canonical, type, target_canonical, polarity ORDER BY confidence DESC, sent_id) AS n FROM x),
d AS (SELECT * EXCLUDE (n) FROM y WHERE n = 1)"""


def document_graphs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = tokens(spark, sf_dir, together=True)
    places = t.select("document_id").distinct().select("document_id", F.explode(F.sequence(F.lit(0), F.lit(len(SENTENCES) * 1200), F.lit(2400))).alias("start"))
    chunked = places.select("document_id", F.concat_ws("_", "document_id", (F.col("start") / 2400).cast("int")).alias("vector_id"), "start", (F.col("start") + 2400).alias("end"))
    return knowledge.document_graph(t, chunked)


@query(f"WITH {_DOCUMENT} SELECT document_id, source_canonical, type, target_canonical, predicate, confidence, polarity, document_id || '_' || (sent_id // 2) AS chunk_id FROM d")
def document_graph_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relation log of the suppliers' documents, each relation with the chunk that holds its sentence."""
    return document_graphs(spark, sf_dir)[1].select("document_id", "source_canonical", "type", "target_canonical", "predicate", "confidence", "polarity", "chunk_id")


def _sql_entities() -> str:
    """Every name of a supplier's document with the kind of its first mention: marked entities of a sentence, then the ends of its relations."""
    seen: dict[str, tuple[str, str]] = {}
    for name, (words, relations) in SENTENCES.items():
        if name == "endless":
            continue
        met = [(w[0], K.LABELS[w[6]]) for w in words if w[7] is not None and K.LABELS[w[6]] not in K.UNLINKED]
        met += [(r[i], r[i + 1]) for r in relations for i in (0, 3)]
        for text, kind in met:
            seen.setdefault(text.lower(), (text, kind))
    parts = [f"SELECT 's-' || s_suppkey AS document_id, {_sql_canonical(text, kind)} AS canonical_name, '{kind}' AS type, {_sql_name(text)} AS display_name, CAST({0.6 if kind == 'OTHER' else 0.9} AS DOUBLE) AS confidence {_FROM}" for text, kind in seen.values()]
    return " UNION ALL ".join(parts)


@query(_sql_entities())
def document_graph_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_graphs(spark, sf_dir)[0].select("document_id", "canonical_name", "type", "display_name", "confidence")


@query(
    f"WITH {_DOCUMENT}, e AS ({_sql_entities()}), p AS (SELECT document_id, source_canonical, type, target_canonical FROM d WHERE polarity = 'positive') "
    "SELECT document_id, (SELECT count(*) FROM e WHERE e.document_id = s.document_id) AS nodes, (SELECT count(*) FROM p WHERE p.document_id = s.document_id) AS edges FROM (SELECT 's-' || s_suppkey AS document_id FROM supplier) s"
)
def document_graph_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and positive edges of each document's own graph."""
    nodes, edges = knowledge.projection(*(written(x, "log") for x in document_graphs(spark, sf_dir)))
    counts = nodes.groupBy("document_id").agg(F.count("*").alias("nodes"))
    return counts.join(large(edges.groupBy("document_id").agg(F.count("*").alias("edges"))), "document_id")


#: Names in the order of a document, and what each is resolved to; % stands for the supplier's number.
MENTIONS = (
    ("ORG", "acme widgets international %", "acme widgets international %"),
    ("ORG", "acme widget international %", "acme widgets international %"),
    ("PERSON", "acme widget international %", "acme widget international %"),
    ("ORG", "international widgets acme %", "acme widgets international %"),
    ("ORG", "aw", "aw"),
    ("ORG", "finance", "finance"),
    ("ORG", "finance committee", "finance committee"),
    ("PERSON", "priya raman", "priya raman"),
    ("PERSON", "pr", "priya raman"),
    ("PERSON", "priya ramann", "priya raman"),
    ("ORG", "pr", "pr"),
)


@query(" UNION ALL ".join(f"SELECT 's' || s_suppkey AS document_id, {i} AS seq, '{kind}' AS kind, replace('{name}', '%', CAST(s_suppkey AS VARCHAR)) AS canonical, replace('{known}', '%', CAST(s_suppkey AS VARCHAR)) AS resolved FROM supplier" for i, (kind, name, known) in enumerate(MENTIONS)))
def resolve_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("seq"), F.lit(kind).alias("kind"), F.lit(name).alias("name")) for i, (kind, name, _) in enumerate(MENTIONS)])).alias("m")
    rows = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("document_id"), F.col("s_suppkey").cast("string").alias("k"), each)
    return resolve.resolved(rows.select("document_id", "m.seq", "m.kind", F.replace(F.col("m.name"), F.lit("%"), F.col("k")).alias("canonical")))


_LINES = f"""{_CLEAN},
li AS (SELECT doc_id, t, string_split(t, chr(10)) AS lines FROM cl WHERE length(t) > 0),
le AS (SELECT doc_id, t, list_transform(lines, lambda x: CASE WHEN trim(x, ' ') <> '' AND NOT regexp_matches(trim(x, ' '), '[.!?:;]$') AND len(regexp_split_to_array(trim(x, ' '), '\\s+')) <= 8 THEN rtrim(x, ' ') || '.' ELSE x END) AS ended,
  list_filter(lines, lambda x: trim(x, ' ') <> '' AND NOT regexp_matches(trim(x, ' '), '[.!?:;]$') AND len(regexp_split_to_array(trim(x, ' '), '\\s+')) <= 8) AS headings FROM li)"""


@query(f"WITH {_LINES} SELECT doc_id, array_to_string(ended, chr(10)) AS text, CAST(len(headings) AS INTEGER) AS n_inserted, CAST(length(t) AS INTEGER) AS original_end, 0 AS original_begin FROM le")
def heading_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with ended headings, and the places of their begin and end mapped back to the text as it was."""
    rows = D.cleaned(table(spark, sf_dir, "documents")).select("doc_id", K.terminated(F.col("clean_text")).alias("text"), K.insertions(F.col("clean_text")).alias("inserted"))
    begin, end = (K.original_offset(x, F.col("inserted")) for x in (F.lit(0), F.length("text")))
    return rows.select("doc_id", "text", F.size("inserted").alias("n_inserted"), end.alias("original_end"), begin.alias("original_begin"))


