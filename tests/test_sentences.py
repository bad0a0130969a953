"""Sentences of raw text: stated cases, and every text against a plain walk by characters."""

from sparkloom.functions import sentences as S

CASES = {
    "": [], "  \n ": [], "One. Two! Three? Four": ["One.", "Two!", "Three?", "Four"], "No end": ["No end"],
    "Dr. Smith met Mr. A. Jones. They talked.": ["Dr. Smith met Mr. A. Jones.", "They talked."],
    'He said "Stop." Then he left.': ['He said "Stop."', "Then he left."], "It cost 3.50 in all. 12 came.": ["It cost 3.50 in all.", "12 came."],
    "A title\n\nA text. and on": ["A title", "A text. and on"], "1. First thing\n2. Second thing": ["1. First thing\n2. Second thing"],
    "Wait... What?! (Yes.) Done.": ["Wait...", "What?!", "(Yes.)", "Done."], "これは文。次の文。": ["これは文。", "次の文。"], "e.g. This one. U.S. Army": ["e.g. This one.", "U.S. Army"],
}


def plain(text):
    """The same rules, one character after the other."""
    out, begin, i, n = [], 0, 0, len(text)

    def cut(a, b):
        own = text[a:b]
        if own.strip():
            start = a + len(own) - len(own.lstrip())
            out.append((start, start + len(own.strip())))

    while i < n:
        if text[i] == "\n":
            j = i + 1
            while j < n and text[j].isspace() and text[j] != "\n":
                j += 1
            if j < n and text[j] == "\n":
                while j < n and text[j].isspace():
                    j += 1
                cut(begin, i)
                begin = i = j
                continue
        if text[i] in ".!?…。！？":
            a = i
            while i < n and text[i] in ".!?…。！？":
                i += 1
            sign = text[a:i]
            j = i
            while j < n and text[j] in "\"'”’»)]}":
                j += 1
            k = j
            while k < n and text[k].isspace():
                k += 1
            m = k
            while m < n and text[m] in "\"'“‘«([{":
                m += 1
            starts = k > j and m < n and (text[m].isupper() or text[m].isdecimal() or text[m].isalpha() and not text[m].islower())
            word = ""
            b = a
            while b > 0 and not text[b - 1].isspace() and text[b - 1] not in "([{\"'“‘«":
                b -= 1
            word = text[b:a][-24:]
            held = sign == "." and (word.lower() in S.ABBREVIATIONS or len(word) == 1 and word.isalpha() and word.isupper() or word.isdecimal() and (b == 0 or text[b - 1] == "\n"))
            if starts and not held:
                cut(begin, j)
                begin = i = k
            elif k == j and sign[-1] in "。！？" and j == i and i < n:
                cut(begin, i)
                begin = i
            continue
        i += 1
    cut(begin, n)
    return out


def test_cases():
    for text, want in CASES.items():
        assert [text[a:b] for a, b in S.spans(text)] == want, text


def test_documents_against_a_plain_walk(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {}
    for r in S.sentences(docs, most=None).collect():
        got.setdefault(r.doc_id, []).append((r.sent_id, r.start, r.end, r.sentence))
    n = 0
    for r in docs.collect():
        want = plain(r.text or "")
        assert [(i, a, b, r.text[a:b]) for i, (a, b) in enumerate(want)] == sorted(got.get(r.doc_id, [])), r.doc_id
        n += len(want)
    assert n > 1000


def test_length_gate_nulls_and_long_texts(spark):
    docs = spark.createDataFrame([(1, "Short. X" + "x" * 1001 + ". Short again."), (2, None), (3, "")], "doc_id long, text string")
    rows = S.sentences(docs).collect()
    assert sorted((r.doc_id, r.sent_id, r.sentence) for r in rows) == [(1, 0, "Short."), (1, 2, "Short again.")]
    long = "A sentence of some words. " * 200_000
    assert sum(1 for _ in S.spans(long)) == 200_000
