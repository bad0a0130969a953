"""Operator 11 against plain Python on whole texts."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from sparkloom.llm import token_alignment as A
from sparkloom.llm.tokenize import public_tokenizer

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
TEXTS = [
    None, "", " ", "\n", "a", "hello world", " leading", "trailing  ", "two  blanks   three", "tab\tand\n new\n\n line", "it's we'll don't 's", "x▁y and more", "nb sp ace wide   mix",
    "<|endoftext|> <s> </s> <unk> <0x41> text", "emoji 😀😀 and é è ß", "日本語 の テキスト と 漢字", "12 345 6789 3.14,15", "\x00zero \x01 \x7f bytes", "a" * 3000, "ab " * 2000, "no_space_" * 500,
    "hello world", "hello world again", "﻿ bom ​ zero", "“quoted” — dash … end", " \n x", "x \n", "　 wide 　", "é combining ́ alone",
]


def brute(texts):
    a, b = Tokenizer.from_file(public_tokenizer(A_FILE)), SentencePieceProcessor(model_file=public_tokenizer(B_FILE))
    a.encode_special_tokens = True
    coders = A._coders(public_tokenizer(A_FILE), public_tokenizer(B_FILE))  # for the bytes of ids only
    docs, held = [], Counter()
    for t in texts:
        whole = (" " + t).encode() if t else b""
        sides = [a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)] if t else [[], []]
        parts = [[table[i] for i in ids] for ids, table in zip(sides, coders[2:], strict=True)]
        if not t or any(b"".join(p) != whole for p in parts):
            docs.append((0, 0, 0, Counter(), ""))
            continue
        ends = [np.cumsum([len(x) for x in p]).tolist() for p in parts]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        starts = [[0, *e[:-1]] for e in ends]
        groups, lo = [], 0
        for hi in cuts:
            groups.append("|".join(",".join(str(i) for i, e in zip(ids, es, strict=True) if lo < e <= hi) for ids, es in zip(sides, ends, strict=True)))
            lo = hi
        links = Counter()
        j = 0
        for x, s, e in zip(sides[0], starts[0], ends[0], strict=True):
            while j and starts[1][j] > s:
                j -= 1
            while ends[1][j] <= s:
                j += 1
            k = j
            while k < len(sides[1]) and starts[1][k] < e:
                links[x, sides[1][k]] += 1
                k += 1
        held.update(set(links))
        docs.append((len(sides[0]), len(sides[1]), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    top = Counter()
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    return [(na, nb, ng, sum(k.values()), sum(n for p, n in k.items() if held[p] == top[p[0]]), sum(n * held[p] for p, n in k.items()), h) for na, nb, ng, k, h in docs]


def run(spark, texts, **options):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, segment string")
    rows = A.alignment(docs, public_tokenizer(A_FILE), public_tokenizer(B_FILE), **options).collect()
    return [tuple(r)[1:] for r in sorted(rows, key=lambda r: r.doc_id)]


def test_against_whole_texts(spark):
    want = brute(TEXTS)
    assert run(spark, TEXTS) == want
    assert want[11] == (0, 0, 0, 0, 0, 0, "") and want[21] == want[5] and sum(w[0] > 0 for w in want) >= 24
    assert run(spark, TEXTS, block_bytes=100) == want  # however documents are dealt into blocks


def test_documents_against_whole_texts(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()]
    assert run(spark, texts) == brute(texts)


def test_empty_table_and_empty_texts(spark):
    assert run(spark, []) == []
    assert run(spark, [None, ""]) == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_segments_are_the_text():
    codes, starts, different = A.segments(pa.array(TEXTS, pa.string()))
    names = different.to_pylist()
    for i, t in enumerate(TEXTS):
        assert "".join(names[c] for c in codes[starts[i] : starts[i + 1]]) == (" " + t if t else "")


def test_plan_sorts_narrow_rows_and_collects_none(spark):
    rows = [(0, 7, [[2 << A.ID_BITS | 5, 1 << A.ID_BITS | 6, 3 << A.ID_BITS | 7], [1 << A.ID_BITS | 8, 2 << A.ID_BITS | 9, 3 << A.ID_BITS | 5]]), (1, 7, [[1 << A.ID_BITS | 5], [1 << A.ID_BITS | 5]])]
    tokens = spark.createDataFrame(rows, "run int, place long, tokens array<array<int>>").repartition(2, "place")
    links = A.aligned(tokens, "run", "place")
    plan = links._jdf.queryExecution().executedPlan().toString()
    # one exchange (that of the rows given), two sorts, and no lists that are put together row by row
    assert "Aggregate" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert plan.count("Sort [") == 2 and plan.count("Sort [run") == 2
    got = sorted((r.run, r.end, r.pair >> 32, r.pair & 0xFFFFFFFF, r.of_a, r.of_b, r.group) for r in links.collect())
    assert got == [(0, 1, 5, 8, False, True, 2), (0, 2, 5, 9, True, False, 2), (0, 3, 6, 9, True, True, 2), (0, 6, 7, 5, True, True, 1), (1, 1, 5, 5, True, True, 1)]


def test_documents_are_kept_in_few_bytes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = A._cut(docs, 1 << 22).collect()
    names = {(r.block, A.RUN * r.run + i): t for r in rows if r.run is not None for i, t in enumerate(r.segments)}
    kept = {r.doc_id: [names[r.block, c] for c in A._unpacked(r.codes).tolist()] for r in rows if r.run is None}
    assert {i: "".join(x) for i, x in kept.items()} == {r.doc_id: " " + r.text if r.text else "" for r in docs.collect()}
    # less than two bytes for each segment
    assert sum(len(r.codes) for r in rows if r.run is None) < 1.8 * sum(map(len, kept.values()))
    numbers = np.array([0, 1, 255, 256, 70_000, 2**32 - 1], np.uint32)
    assert A._unpacked(A._packed(numbers)).tolist() == numbers.tolist() and A._unpacked(A._packed(numbers[:0])).tolist() == []
