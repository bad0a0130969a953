"""Relations from dependency parses, as joins on a token table.

A parser (a port, see ``ports``) gives one row for each token: document_id, sent_id,
i, text, lower, lemma, pos, tag, dep, head (its own i for a root), ent_label, ent_id,
start_char. All rules join tokens with their children on (document_id, sent_id, head);
only the extent of a token's subtree, a recursion, is computed a sentence at a time,
on arrays of whole sentences.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.config import DEFAULTS
from sparkloom.functions import text as T
from sparkloom.functions.text import canonical_name, display_name
from sparkloom.storage import large, written

# Entity labels of the parser, and head nouns of enterprise types.
LABELS = {
    "PERSON": "PERSON", "ORG": "ORG", "GPE": "LOCATION", "LOC": "LOCATION", "FAC": "LOCATION", "DATE": "DATE", "TIME": "DATE",
    "PRODUCT": "PRODUCT", "EVENT": "EVENT", "MONEY": "MONEY", "WORK_OF_ART": "OTHER", "LAW": "OTHER", "NORP": "OTHER", "LANGUAGE": "OTHER",
}
ROLE_HEADS = (
    "ceo", "cfo", "cto", "coo", "cio", "ciso", "chair", "chairman",
    "chairwoman", "president", "director", "manager", "supervisor",
    "head", "lead", "officer", "administrator", "analyst", "engineer",
    "architect", "designer", "controller", "treasurer", "secretary",
    "partner", "principal", "founder", "owner", "executive", "vp",
)
DEPARTMENT_HEADS = ("department", "team", "division", "unit", "group", "office", "bureau", "function", "practice", "squad", "guild")
PROJECT_HEADS = ("project", "programme", "program", "initiative", "workstream")
TECHNOLOGY_HEADS = ("platform", "framework", "database", "api", "service", "system", "library", "toolkit", "sdk", "protocol", "pipeline", "stack")
ENTERPRISE = ("ROLE", "DEPARTMENT", "PROJECT", "TECHNOLOGY")
# Predicates and their relation; what a passive turns a relation into; relations with a direction.
PREDICATES = {
    "work in": "WORKS_IN", "work at": "WORKS_IN", "work for": "WORKS_FOR", "report to": "REPORTS_TO", "employ": "WORKS_FOR",
    "manage": "MANAGES", "oversee": "MANAGES", "supervise": "MANAGES", "lead": "LEADS", "head": "LEADS", "run": "MANAGES",
    "be responsible for": "RESPONSIBLE_FOR", "be accountable for": "RESPONSIBLE_FOR",
    "own": "OWNS", "be part of": "PART_OF", "belong to": "BELONGS_TO", "be member of": "MEMBER_OF", "be a member of": "MEMBER_OF", "join": "MEMBER_OF", "include": "PART_OF",
    "be located in": "LOCATED_IN", "be based in": "LOCATED_IN", "headquarter in": "LOCATED_IN", "locate in": "LOCATED_IN", "base in": "LOCATED_IN", "operate in": "LOCATED_IN",
    "use": "USES", "adopt": "USES", "develop": "DEVELOPS", "build": "DEVELOPS", "maintain": "DEVELOPS", "provide": "PROVIDES", "offer": "PROVIDES", "supply": "PROVIDES",
    "acquire": "ACQUIRED", "buy": "ACQUIRED", "purchase": "ACQUIRED", "found": "FOUNDED", "establish": "FOUNDED", "create": "CREATED", "launch": "CREATED",
}
PASSIVE = {
    "MANAGES": "MANAGED_BY", "OWNS": "OWNED_BY", "LEADS": "MANAGED_BY", "WORKS_FOR": "WORKS_FOR", "DEVELOPS": "DEVELOPS",
    "CREATED": "CREATED", "PROVIDES": "PROVIDES", "ACQUIRED": "ACQUIRED", "FOUNDED": "FOUNDED", "USES": "USES",
}
DIRECTIONAL = ("REPORTS_TO", "MANAGES", "MANAGED_BY", "OWNS", "OWNED_BY", "PART_OF", "ACQUIRED")
# Negation, arguments that name nothing, complements, heads that take an of-phrase, dependency labels.
NEGATION = ("not", "n't", "never", "no", "none", "nobody", "no-one", "noone", "nothing", "nowhere", "neither", "nor", "without", "cannot")
QUANTIFIERS = ("nobody", "no one", "noone", "none", "nothing", "neither", "no-one")
VACUOUS = (
    "anyone", "anyone else", "anybody", "anybody else", "someone",
    "somebody", "everyone", "everybody", "no one", "nobody", "nothing",
    "anything", "something", "everything", "each other", "one another",
    "it", "they", "them", "this", "that", "these", "those", "he", "she",
    "him", "her", "his", "hers", "we", "us", "you", "i", "me", "who",
    "which", "what", "there", "here",
)
COMPLEMENTS = ("part", "member", "responsible", "accountable", "owner", "parent", "subsidiary")
OF_HEADS = ("head", "director", "chief", "manager", "lead", "vp", "president", "owner", "member", "part", "chair", "chairman", "officer", "board")
SUBJECTS, OBJECTS, WITHIN = ("nsubj", "nsubjpass", "expl"), ("dobj", "obj", "dative", "attr", "oprd"), ("compound", "amod", "nmod", "poss", "nummod")
MOST_TOKENS = 8
#: Kinds that are found and scored, but are no nodes of a graph.
UNLINKED = ("DATE", "MONEY")
S = ("document_id", "sent_id")


def _map(known: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in known.items() for x in kv])[key]


def vacuous(text: Column) -> Column:
    """Whether an argument names nothing: by itself or by its first word."""
    plain = F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))
    return (plain == "") | plain.isin(*VACUOUS) | F.split(plain, " ")[0].isin(*VACUOUS, *QUANTIFIERS)


def _extent(tokens: list[int], heads: list[int]) -> list[dict]:
    """The first and last token of each token's subtree."""
    left, right, head = dict(zip(tokens, tokens, strict=True)), dict(zip(tokens, tokens, strict=True)), dict(zip(tokens, heads, strict=True))
    for i in tokens:
        at, seen = i, set()
        while at in head and at not in seen:  # every ancestor spans this token
            seen.add(at)
            left[at], right[at] = min(left[at], i), max(right[at], i)
            at = head[at]
    return [{"left": left[i], "right": right[i]} for i in tokens]


def with_extents(tokens: DataFrame) -> DataFrame:
    """Adds left and right, the first and last token of each token's subtree."""

    @F.pandas_udf("array<struct<left:long,right:long>>")
    def extents(numbers: pd.Series, heads: pd.Series) -> pd.Series:
        return pd.Series([_extent(i.tolist(), h.tolist()) for i, h in zip(numbers, heads, strict=True)])

    others = [c for c in tokens.columns if c not in (*S, "i")]
    rows = tokens.groupBy(*S).agg(F.sort_array(F.collect_list(F.struct(F.col("i").cast("long").alias("i"), *others))).alias("t"))
    both = rows.withColumn("e", extents(F.transform("t", lambda t: t["i"]), F.transform("t", lambda t: t["head"].cast("long"))))
    return both.select(*S, F.explode(F.arrays_zip("t", "e")).alias("z")).select(*S, "z.t.*", "z.e.*")


def sentences(tokens: DataFrame, most: int = DEFAULTS.sentence_chars) -> DataFrame:
    """document_id, sent_id, sentence, sentence_start of the sentences with 1 to ``most`` characters; longer ones are mostly tables."""
    words = F.sort_array(F.collect_list(F.struct("i", "text")))
    size = F.max(F.col("start_char") + F.length("text")) - F.min("start_char")
    rows = tokens.groupBy(*S).agg(words.alias("w"), F.min("start_char").alias("sentence_start"), size.alias("size"))
    return rows.where((F.col("size") > 0) & (F.col("size") <= most)).select(*S, T.strip(F.array_join(F.transform("w", lambda w: w["text"]), " ")).alias("sentence"), "sentence_start")


def mentions(tokens: DataFrame) -> DataFrame:
    """document_id, sent_id, token (its first), name, canonical, kind of every entity that the parser marked; dates and money are none."""
    entity = tokens.where("ent_id is not null")
    bounds = entity.groupBy(*S, "ent_id").agg(F.min("i").alias("first"), F.max("i").alias("last"))
    roots = entity.join(large(bounds), [*S, "ent_id"]).where((F.col("head") == F.col("i")) | (F.col("head") < F.col("first")) | (F.col("head") > F.col("last")))
    spans = bounds.join(large(roots.groupBy(*S, "ent_id").agg(F.min("i").alias("root"))), [*S, "ent_id"])
    named = _named(spans, tokens, ["ent_id"]).where(~F.col("kind").isin(*UNLINKED))
    return named.join(large(bounds.select(*S, "ent_id", F.col("first").alias("token"))), [*S, "ent_id"]).select(*S, "token", "name", "canonical", "kind")


def _children(tokens: DataFrame, prefix: str, parent: str) -> DataFrame:
    """Tokens with prefixed columns, keyed by their head's number as ``parent``."""
    own = tokens.where("head <> i")
    return own.select(*S, F.col("head").alias(parent), *[F.col(c).alias(f"{prefix}_{c}") for c in ("i", "lower", "dep", "tag")])


def predicates(tokens: DataFrame) -> DataFrame:
    """document_id, sent_id, verb, verb_head, verb_dep, type, predicate, passive, negated of each verb."""
    verbs = tokens.where(F.col("pos").isin("VERB", "AUX")).select(*S, F.col("i").alias("verb"), F.lower("lemma").alias("lemma"), F.col("head").alias("verb_head"), F.col("dep").alias("verb_dep"))
    below = _children(tokens, "c", "verb")
    grand = _children(tokens, "g", "c_i").groupBy(*S, "c_i").agg(
        F.min(F.when(F.col("g_dep") == "prep", F.struct("g_i", "g_lower")))["g_lower"].alias("c_prep"), F.max(F.col("g_lower").isin("no", "neither")).alias("c_no")
    )
    both = below.join(large(grand), [*S, "c_i"], "left")
    subject = F.col("c_dep").isin("nsubj", "nsubjpass") & (F.col("c_lower").isin(*QUANTIFIERS) | F.coalesce("c_no", F.lit(False)))
    facts = both.groupBy(*S, "verb").agg(
        F.max(F.col("c_dep").isin("auxpass", "nsubjpass")).alias("passive"),
        F.max((F.col("c_dep") == "neg") | F.col("c_lower").isin(*NEGATION) | subject).alias("negated"),
        F.min(F.when(F.col("c_dep") == "prep", F.struct("c_i", "c_lower")))["c_lower"].alias("prep"),
        F.min(F.when(F.col("c_dep").isin("acomp", "attr", "oprd") & F.col("c_lower").isin(*COMPLEMENTS), F.struct("c_i", F.concat_ws(" ", "c_lower", "c_prep").alias("words"))))["words"].alias("complement"),
    )
    rows = verbs.join(large(facts), [*S, "verb"], "left")
    said = F.concat_ws(" ", "lemma", F.coalesce("complement", "prep"))
    kind = F.coalesce(_map(PREDICATES, said), _map(PREDICATES, F.col("lemma")))
    passive = F.coalesce("passive", F.lit(False))
    kind = F.coalesce(F.when(passive, F.coalesce(_map(PASSIVE, kind), kind)).otherwise(kind), F.lit("RELATED_TO"))
    return rows.select(*S, "verb", "verb_head", "verb_dep", kind.alias("type"), said.alias("predicate"), passive.alias("passive"), F.coalesce("negated", F.lit(False)).alias("negated"))


def subjects(tokens: DataFrame, verbs: DataFrame) -> DataFrame:
    """document_id, sent_id, verb, subject, relative: subjects and their conjuncts, antecedents of relatives, the noun before a conjoined verb."""
    key = [*S, "verb"]
    own = verbs.join(large(_children(tokens, "c", "verb").where(F.col("c_dep").isin(*SUBJECTS))), key)
    relative = (F.col("c_tag") == "WP") | F.col("c_lower").isin("who", "which", "that")
    head = F.col("verb_head") != F.col("verb")
    named = own.where(~relative).select(*key, F.col("c_i").alias("subject"), F.lit(False).alias("relative"))
    more = named.join(large(_children(tokens, "g", "subject").where("g_dep = 'conj'")), [*S, "subject"]).select(*key, F.col("g_i").alias("subject"), "relative")
    found = named.union(more).union(own.where(relative & head).select(*key, "verb_head", F.lit(True)))
    without = verbs.join(large(found.select(*key)), key, "left_anti")
    clause = without.where((F.col("verb_dep") == "relcl") & head).select(*key, "verb_head", F.lit(True))
    before = tokens.where(F.col("pos").isin("NOUN", "PROPN", "VERB")).select(*S, "i", "pos")
    nearest = without.where("verb_dep = 'conj'").join(large(before), [*S]).where(F.col("i") < F.col("verb")).groupBy(*key).agg(F.max_by(F.struct("i", "pos"), "i").alias("n"))
    return found.union(clause).union(nearest.where("n.pos <> 'VERB'").select(*key, "n.i", F.lit(True))).distinct()


def objects(tokens: DataFrame, verbs: DataFrame) -> DataFrame:
    """document_id, sent_id, verb, object: objects and their conjuncts, prepositions' objects, a passive's agent."""
    key = [*S, "verb"]
    below = verbs.select(*key, "passive").join(large(_children(tokens, "c", "verb")), key)
    agent = F.col("passive") & (F.col("c_dep") == "agent")
    complement = F.col("c_dep").isin(*OBJECTS) & F.col("c_lower").isin(*COMPLEMENTS)
    direct = below.where(F.col("c_dep").isin(*OBJECTS) & ~complement & ~agent).select(*key, F.col("c_i").alias("object"))
    of_child = _children(tokens, "g", "c_i")
    pobj = below.where(agent | (F.col("c_dep") == "prep")).join(large(of_child), [*S, "c_i"]).where("g_dep = 'pobj'").select(*key, "c_dep", F.col("g_i").alias("object"))
    deeper = below.where(complement).join(large(of_child), [*S, "c_i"]).where("g_dep = 'prep'").select(*key, "g_i").join(large(_children(tokens, "p", "g_i")), [*S, "g_i"]).where("p_dep = 'pobj'").select(*key, F.col("p_i").alias("object"))
    joined = direct.union(pobj.where("c_dep = 'prep'").select(*key, "object"))
    more = joined.join(large(_children(tokens, "k", "object").where("k_dep = 'conj'")), [*S, "object"]).select(*key, F.col("k_i").alias("object"))
    return reduce(DataFrame.union, [joined, more, pobj.where("c_dep <> 'prep'").select(*key, "object"), deeper]).distinct()


def _typed(first: Column, root: Column, label: Column, pos: Column) -> Column:
    """ROLE, DEPARTMENT, PROJECT, TECHNOLOGY by head noun or first word, else by label, else OTHER for proper nouns, else null."""
    return (
        F.when(root.isin(*ROLE_HEADS) | first.isin(*ROLE_HEADS), "ROLE")
        .when(root.isin(*DEPARTMENT_HEADS), "DEPARTMENT")
        .when(first.isin(*PROJECT_HEADS), "PROJECT")
        .when(root.isin(*TECHNOLOGY_HEADS), "TECHNOLOGY")
        .when(label.isNotNull() & (label != ""), F.coalesce(_map(LABELS, label), F.lit("OTHER")))
        .when(pos == "PROPN", "OTHER")
    )


def _named(spans: DataFrame, tokens: DataFrame, keys: list[str]) -> DataFrame:
    """keys, name, canonical, kind of spans (document_id, sent_id, first, last, root): leading determiners go; null kinds and names of one letter too."""
    inside = tokens.select(*S, "i", "text", "lower", "pos", "ent_label")
    rows = spans.join(large(inside), [*S]).where((F.col("i") >= F.col("first")) & (F.col("i") <= F.col("last")))
    start = F.coalesce(F.min(F.when(F.col("pos") != "DET", F.col("i"))).over(Window.partitionBy(*S, *keys)), F.col("last"))
    rows = rows.withColumn("start", start).where("i >= start")
    words = F.array_sort(F.collect_list(F.struct("i", "text", "lower", "pos")))
    at_root = F.max(F.when(F.col("i") == F.col("root"), F.struct("lower", "pos", "ent_label")))
    grouped = rows.groupBy(*S, *keys).agg(words.alias("w"), at_root.alias("r"))
    spoken = F.filter("w", lambda x: x["pos"] != "PUNCT")
    kind = _typed(spoken[0]["lower"], F.col("r.lower"), F.col("r.ent_label"), F.col("r.pos"))
    name = display_name(F.array_join(F.transform("w", lambda x: x["text"]), " "))
    out = grouped.select(*S, *keys, name.alias("name"), kind.alias("kind")).where("kind is not null and length(name) >= 2")
    return out.withColumn("canonical", canonical_name(F.col("name"), F.col("kind"))).where("canonical <> ''")


def arguments(tokens: DataFrame, wanted: DataFrame) -> DataFrame:
    """document_id, sent_id, token, name, canonical, kind of each token in ``wanted``: its noun phrase if that has an enterprise type, else the entity it is in, else the phrase."""
    own = wanted.select(*S, "token").distinct()
    # left and right are of the children here
    near = tokens.where("head <> i").select(*S, F.col("head").alias("token"), F.col("dep").alias("c_dep"), F.col("lower").alias("c_lower"), "left", "right")
    rows = own.join(large(tokens.select(*S, F.col("i").alias("token"), "lower")), [*S, "token"]).join(large(near), [*S, "token"], "left")
    part = F.col("c_dep").isin(*WITHIN)
    of = F.col("lower").isin(*OF_HEADS) & (F.col("c_dep") == "prep") & (F.col("c_lower") == "of")
    spans = rows.groupBy(*S, "token").agg(F.least("token", F.min(F.when(part, F.col("left")))).alias("first"), F.greatest("token", F.max(F.when(part | of, F.col("right")))).alias("last"))
    spans = spans.withColumn("last", F.least("last", F.col("first") + MOST_TOKENS - 1)).withColumn("root", F.col("token"))
    phrase = _named(spans, tokens, ["token"])
    entity = tokens.where("ent_id is not null")
    bounds = entity.groupBy(*S, "ent_id").agg(F.min("i").alias("first"), F.max("i").alias("last"))
    roots = entity.join(large(bounds), [*S, "ent_id"]).where((F.col("head") == F.col("i")) | (F.col("head") < F.col("first")) | (F.col("head") > F.col("last")))
    spanned = bounds.join(large(roots.groupBy(*S, "ent_id").agg(F.min("i").alias("root"))), [*S, "ent_id"])
    of_entity = _named(spanned, tokens, ["ent_id"])
    in_entity = own.join(large(entity.select(*S, F.col("i").alias("token"), "ent_id")), [*S, "token"]).join(large(of_entity), [*S, "ent_id"])
    p = phrase.select(*S, "token", F.struct("name", "canonical", "kind").alias("p"))
    e = in_entity.select(*S, "token", F.struct("name", "canonical", "kind").alias("e"))
    best = F.when(F.col("p.kind").isin(*ENTERPRISE), F.col("p")).otherwise(F.coalesce("e", "p"))
    return own.join(large(p), [*S, "token"], "left").join(large(e), [*S, "token"], "left").select(*S, "token", best.alias("b")).where("b is not null").select(*S, "token", "b.*")


def extracted(tokens: DataFrame, threshold: float = DEFAULTS.relation_threshold, most: int = DEFAULTS.sentence_chars) -> DataFrame:
    """Relations of all sentences of at most ``most`` characters: document_id, sent_id, verb, object, source, source_kind, source_canonical, target..., type, predicate, confidence, polarity."""
    t = written(with_extents(tokens.join(large(sentences(tokens, most).select(*S)), [*S], "left_semi")), "parse")  # many rules read it
    verbs = written(predicates(t), "verbs")
    key = [*S, "verb"]
    pairs = verbs.join(large(subjects(t, verbs)), key).join(large(objects(t, verbs)), key)
    swap = F.col("passive") & (_map(PASSIVE, F.col("type")) == F.col("type"))
    swap = F.coalesce(swap, F.lit(False))
    pairs = pairs.withColumn("a", F.when(swap, F.col("object")).otherwise(F.col("subject"))).withColumn("b", F.when(swap, F.col("subject")).otherwise(F.col("object")))
    pairs = written(pairs, "pairs")
    known = arguments(t, pairs.select(*S, F.col("a").alias("token")).union(pairs.select(*S, F.col("b").alias("token"))))
    rows = pairs
    for end, name in (("a", "source"), ("b", "target")):
        side = known.select(*S, F.col("token").alias(end), F.col("name").alias(name), F.col("kind").alias(f"{name}_kind"), F.col("canonical").alias(f"{name}_canonical"))
        heads = t.select(*S, F.col("i").alias(end), F.col("head").alias(f"{end}_head"))
        rows = rows.join(large(side), [*S, end]).join(large(heads), [*S, end])
    away = F.abs(F.col("a") - F.col("b"))
    # What each sign adds to the confidence.
    score = (
        F.lit(0.45)
        + F.when(F.col("type") != "RELATED_TO", 0.25).otherwise(0.0)
        + 0.10 * ((F.col("source_kind") != "OTHER").cast("int") + (F.col("target_kind") != "OTHER").cast("int"))
        + F.when(F.col("a_head") == F.col("b_head"), 0.05).otherwise(0.0)
        + F.when(away <= 6, 0.05).when(away > 15, -0.10).otherwise(0.0)
        - F.when(F.col("relative"), 0.05).otherwise(0.0)
        - F.when(F.col("passive") & F.col("type").isin(*DIRECTIONAL), 0.05).otherwise(0.0)
    )
    rows = rows.withColumn("confidence", F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 3)).withColumn("polarity", F.when(F.col("negated"), "negative").otherwise("positive"))
    rows = rows.where((F.col("source_canonical") != F.col("target_canonical")) & ~vacuous(F.col("source")) & ~vacuous(F.col("target")))
    rows = rows.where(((F.col("confidence") >= threshold) | F.col("negated")) & ~F.col("source_kind").isin(*UNLINKED) & ~F.col("target_kind").isin(*UNLINKED))
    names = ["source", "source_kind", "source_canonical", "target", "target_kind", "target_canonical", "type", "predicate", "confidence", "polarity"]
    return rows.select(*S, "verb", "object", *names)


def _heading(line: Column) -> Column:
    """Whether a line is short and ends without a closing sign."""
    bare = F.trim(line)
    return (bare != "") & ~F.rlike(bare, F.lit(r"[.!?:;]$")) & (F.size(F.split(bare, r"\s+")) <= 8)


def _ended(line: Column) -> Column:
    return F.when(_heading(line), F.concat(F.rtrim(line), F.lit("."))).otherwise(line)


def terminated(text: Column) -> Column:
    """Text whose short lines without closing sign end in a full stop, so that a heading is a sentence."""
    return F.array_join(F.transform(F.split(text, "\n"), _ended), "\n")


def insertions(text: Column) -> Column:
    """Where in the terminated text a full stop was put in, in order; where blanks at a line's end went instead, the place all the same."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.struct(F.length(_ended(x)).alias("n"), _heading(x).alias("h")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, line: Column) -> Column:
        out = F.when(line["h"], F.concat(acc["out"], F.array(acc["at"] + line["n"] - 1))).otherwise(acc["out"])
        return F.struct((acc["at"] + line["n"] + 1).alias("at"), out.alias("out"))

    return F.aggregate(lines, start, step, lambda acc: acc["out"])


def original_offset(offset: Column, inserted: Column) -> Column:
    """A place in the terminated text as a place in the text itself."""
    return F.greatest(F.lit(0), offset - F.size(F.filter(inserted, lambda i: i < offset)))
