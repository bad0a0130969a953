"""Operators 1, 7, 8 and 10: exact round trips and planted damage."""

import base64
import hashlib
import uuid
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from sparkloom.llm import media, packing, tokenids, tokenize, warc
from sparkloom.storage import new_folder

PATH = tokenize.public_tokenizer("word_bpe_49k.json")
TEXTS = [
    (1, "Plain words, and more WORDS. It's 12 o'clock"),
    (2, None),
    (3, ""),
    (4, "été naïve İstanbul ΣΑΣ   x\x1cy <|endoftext|> z"),
    (5, "word " * 9000),
    (5, "word " * 9000),
    (6, "a"),
    (None, "no number"),
    (7, "\n\t "),
    *((100 + i, f"text number {i} " * (i % 97)) for i in range(300)),
]
SCHEMA = "doc_id long, text string, ids string, start string, ref string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, "clash", "clash", "clash") for d, t in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def expected():
    tokenizer = Tokenizer.from_file(PATH)
    return [(d, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for d, t in TEXTS]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing_places_every_id_once(docs, expected):
    rows = packing.pack(docs, PATH, 1, keep_ids=True).collect()
    whole = {}
    for r in rows:
        assert r.ids_crc32 == crc(r.ids) and len(r.ids) == r.length > 0
        whole.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.ids))
    want = {}
    for d, ids in expected:
        want.setdefault((d, len(ids)), []).append(ids)
    assert set(whole) == set(want)
    for key, pieces in whole.items():
        ends = sorted(pieces, key=lambda p: p[0])
        assert sum(len(p[1]) for p in ends) == sum(map(len, want[key]))
        if len(want[key]) == 1:
            assert [i for _, p in ends for i in p] == want[key][0]
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at & (at - 1) == 0 and at <= 2048
    steps = {}
    for r in rows:
        steps.setdefault(r.step_group, set()).add(r.sequence_id)
    assert max(len(s) for s in steps.values()) <= packing.STEP_TOKENS


def test_packer_fills_long_windows_from_short_tiers():
    packer = packing.Packer(waiting=2)
    filled = []
    for i, n in enumerate([1500, 300, 300, 1100, 2000, 1900, 1800, 5000, 40, 2048]):
        filled += packer.add(i, np.arange(n))
    assert any(tier == 2048 and len(pieces) > 1 for pieces, tier in filled)
    filled += packer.finish()
    assert sum(len(p[2]) for pieces, _ in filled for p in pieces) == 1500 + 600 + 1100 + 2000 + 1900 + 1800 + 5000 + 40 + 2048
    assert all(sum(len(p[2]) for p in pieces) == tier for pieces, tier in filled)


def test_packing_and_ids_of_an_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert packing.pack(empty, PATH, 1).collect() == []
    assert tokenids.documents_through_files(spark, empty, new_folder(spark, "ids"), PATH, 1).collect() == []


def test_numbers_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 1001):
        x = (rng.integers(0, 2**32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        control, data = tokenids.encode_numbers(x)
        assert (tokenids.decode_numbers(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n) == x).all()


@pytest.mark.parametrize("size", [50, 1 << 22])
def test_ids_come_back_from_files(spark, docs, expected, size):
    folder = new_folder(spark, "ids")
    manifest = tokenids.write_ids(docs, folder, PATH, 1, ids_in_file=size)
    rows = tokenids.read_ids(manifest, keep_ids=True).collect()
    order = sorted(zip(expected, TEXTS, strict=True), key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1][1] is not None, x[1][1] or ""))
    start, want = 0, []
    for (d, ids), _ in order:
        want.append((d, start, len(ids), crc(ids), ids))
        start += len(ids)
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == want


def test_cut_words_have_the_ids_of_whole_texts(monkeypatch):
    monkeypatch.setattr(tokenize, "WINDOW", 64)
    encode = tokenize.Encoder(PATH)
    texts = ["a,b;c 12th 3.14 x--y (z) don't 'tis it's' o'12", "×÷ a×b é÷ñ été, ñandú. ªº µ¿qué? “quoted” dash–ed", "", None, "ÀÉÎ ÿ ĀĂ ȘȚ Ǆ", "a" * 300 + " , " + "b" * 200, "..,, 1 2 33", "\t\n x\r\n", "<|x|>", "x'S 'LL y'd"]
    texts += [" ".join(texts[i % 9] or "" for i in range(j)) for j in range(1, 30, 3)]
    ids, starts = encode.encode(texts)
    want = [encode.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:], strict=True)] == want


def test_other_tokenizers_encode_whole_texts():
    encode = tokenize.encoder(tokenize.public_tokenizer("byte_bpe_50k.json"))
    assert encode.pattern is None
    ids, starts = encode.encode(["two  words", None, " x"])
    assert [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:], strict=True)] == [encode.tokenizer.encode(t, add_special_tokens=False).ids for t in ("two  words", "", " x")]


def test_png_round_trip():
    for data in (b"", b"x", b"\0" * 64, b"end\0", bytes(range(256)) * 9):
        padded, length = media.from_png(media.to_png(data))
        assert length == len(data) and padded == data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
    with pytest.raises(ValueError):
        media.from_png(media.to_png(b"abc").replace(b"Length", b"Lengtx"))


def test_html_order_and_captions():
    page = "<p>One <b>two</b><img src=a alt=A>three</p><script>x<img src=no></script><figure><img src=b><figcaption>Cap &amp; tion</figcaption></figure>tail"
    got = [(x["position"], x["kind"], x["text"], x["ref"], x["caption"]) for x in media.parse_html(page)]
    assert got == [(0, "text", "One two", None, None), (1, "media", None, "a", "A"), (2, "text", "three", None, None), (3, "media", None, "b", "Cap & tion"), (4, "text", "tail", None, None)]
    assert media.parse_html(None) == [] and media.parse_html("<img src=x>")[0]["position"] == 0


def test_digest_join_keeps_order_and_missing_media(spark):
    pages = spark.createDataFrame([(1, "a<img src=r1>b<img src=r2>", 5), (2, None, 5), (3, "<img src=r1>", 5)], "page_id long, html string, position int")
    known = spark.createDataFrame([("r1", 9)], "ref string, size long")
    rows = {r.page_id: r.elements for r in media.documents_of(media.resolved(media.interleaved(pages, "page_id", "html"), known), "page_id").collect()}
    assert [(e.kind, e.text, e.ref, e.size, e.resolved) for e in rows[1]] == [("text", "a", None, None, False), ("media", None, "r1", 9, True), ("text", "b", None, None, False), ("media", None, "r2", None, False)]
    assert set(rows) == {1, 3}


def test_texts_as_media(docs):
    rows = media.documents_as_media(docs).collect()
    assert len(rows) == len(TEXTS)
    want = sorted((d if d is not None else -1, hashlib.sha256(p := (t or "").encode().ljust(max(64, -(-len((t or "").encode()) // 64) * 64), b"\0")).hexdigest(), zlib.crc32(p[-64:]), len((t or "").encode()), len(p)) for d, t in TEXTS)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.payload_sha256, r.tail_crc32, r.n_bytes, r.payload_bytes) for r in rows) == want
    assert all(r.position == 1 and r.caption.startswith(f"{r.n_bytes} bytes") and r.ref == f"sha256:{r.media_sha256}" for r in rows)
    for r in rows:  # the whole sequence, in order
        assert [e.position for e in r.elements] == list(range(len(r.elements))) and [e.kind for e in r.elements if e.kind == "media"] == ["media"] * 2
        assert r.elements[0].text == f"Document {r.doc_id}" and r.elements[-1].text == f"End of Document {r.doc_id}"
        assert [(e.ref[:5], e.caption, e.resolved) for e in r.elements if e.kind == "media"] == [("sha25", r.caption, True), ("page:", "another place", False)]
    shown = {r.doc_id: r.elements[2].text for r in rows}
    assert shown[1] == TEXTS[0][1] and shown[2] == "Seen at" and shown[5] == "word " * 15 + "word"
    assert media.documents_as_media(docs.limit(0)).collect() == []


PAGES = [(i, f"http://x/{i}", h) for i, h in enumerate(["<p>a</p>", "<p>b</p>", "<p>a</p>", None, "", "<p>a</p>", "WARC/1.1\r\nWARC-Type: response\r\n\r\nfake", "é" * 50_000])]


def test_archives_round_trip(spark):
    pages = spark.createDataFrame([(*p, "x") for p in [*PAGES, (None, None, "<p>a</p>")]], "page_id long, url string, html string, digest string")
    for compress in (True, False):
        rows = warc.read_archives(warc.write_archives(pages, new_folder(spark, "warc"), compress=compress, archive_bytes=2000)).collect()
        assert {r.kind for r in rows} == {"record"} and {r.reason for r in rows} == {None}
        first = {0: None, 1: None, 2: 0, 3: None, 4: 3, 5: 0, 6: None, 7: None, None: None}
        text = {p[0]: (p[2] or "").encode() for p in PAGES} | {None: b"<p>a</p>"}
        assert len(rows) == 9
        for r in rows:
            assert r.refers_to == first[r.page_id] and r.record_type == ("response" if r.refers_to is None else "revisit")
            assert r.payload_bytes == len(text[r.page_id])
            assert r.payload_digest == base64.b32encode(hashlib.sha1(text[r.page_id]).digest()).decode()
    least = warc.with_referrals(pages, least=9).collect()
    assert {r.refers_to for r in least} == {None}
    assert warc.read_archives(warc.write_archives(pages.limit(0), new_folder(spark, "warc"))).collect() == []


@pytest.mark.parametrize("compress", [True, False])
def test_damaged_archives_lose_only_what_is_damaged(compress):
    parts = [warc.record(i, "http://x", f"payload {i} ".encode() * 40, None, "2024-01-01T00:00:00Z") for i in range(6)]
    if compress:
        parts = [(p := zlib.compressobj(6, zlib.DEFLATED, 31)).compress(x) + p.flush() for x in parts]
    data = bytearray(b"".join(parts))
    begins = np.cumsum([0, *map(len, parts)]).tolist()
    data[begins[2] + len(parts[2]) // 2] ^= 0x55  # damage inside one record
    data[begins[4] : begins[4] + 8] = b""  # and the start of another is missing
    got = list(warc.salvage(bytes(data)))
    assert [warc._page(f["warc-record-id"]) for k, _, _, f, _ in got if k == "record"] == [0, 1, 3, 5]
    assert [(a, b) for k, a, b, _, _ in got if k == "gap"] == [(begins[2], begins[3]), (begins[4], begins[5] - 8)]
    assert [a for _, a, _, _, _ in got][1:] == [b for _, _, b, _, _ in got][:-1] and got[-1][2] == len(data)
    cut = list(warc.salvage(bytes(data[:-5])))
    assert cut[-1][0] == "gap" and list(warc.salvage(b"")) == [] and [x[0] for x in warc.salvage(b"noise")] == ["gap"]


def test_members_of_several_records_mixed_archives_and_long_headers():
    one, two, three = (warc.record(i, f"http://x/{i}", b"payload", None, "2024-01-01T00:00:00Z") for i in range(3))
    packed = (p := zlib.compressobj(6, zlib.DEFLATED, 31)).compress(one + b"junk" + two) + p.flush()
    got = list(warc.salvage(three + packed + three.replace(b"WARC-Type: ", b"WARC-Type:")))
    assert [(k, f.get("warc-target-uri")) for k, _, _, f, _ in got] == [("record", "http://x/2"), ("record", "http://x/0"), ("gap", None), ("record", "http://x/1"), ("record", "http://x/2")]
    assert {(a, b) for _, a, b, _, _ in got[1:4]} == {(len(three), len(three) + len(packed))}
    folded = three.replace(b"WARC-Date: ", b"X-Note: a\r\n  b\r\nWARC-Date: ")
    assert [f["x-note"] for _, _, _, f, _ in warc.salvage(folded)] == ["a b"]
    assert [k for k, *_ in warc.salvage(three.replace(b"WARC-Date: ", b"no colon\r\nWARC-Date: "))] == ["gap"]


def test_a_very_long_url_comes_back(spark):
    pages = spark.createDataFrame([(1, "http://x/" + "u" * 1_500_000, "<p>a</p>"), (2, "http://y", "<p>b</p>")], "page_id long, url string, html string")
    for compress in (True, False):
        rows = warc.read_archives(warc.write_archives(pages, new_folder(spark, "warc"), compress=compress)).collect()
        assert sorted((r.kind, r.page_id, len(r.url)) for r in rows) == [("record", 1, 1_500_009), ("record", 2, 8)]


def test_spark_reads_archives_itself(spark, tmp_path):
    name = tmp_path / f"{uuid.uuid4().hex}.warc"
    name.write_bytes(b"junk" + warc.record(3, None, b"hi", None, "2024-01-01T00:00:00Z"))
    rows = warc.read_binary(spark.read.format("binaryFile").load(str(name))).collect()
    assert [(r.kind, r.page_id, r.length) for r in rows if r.kind == "gap"] == [("gap", None, 4)]
    assert [(r.page_id, r.payload_bytes, r.url) for r in rows if r.kind == "record"] == [(3, 2, "urn:x-page:3")]


def test_a_damaged_member_of_many_records_gives_those_before():
    """A member of 100 records, damaged or cut at each tenth of its length."""
    records = [warc.record(i, f"http://x/{i}", f"page {i} {hashlib.sha256(str(i).encode()).hexdigest()}".encode(), None, "2024-01-01T00:00:00Z") for i in range(100)]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    member = packer.compress(b"".join(records)) + packer.flush()
    after = zlib.compressobj(6, zlib.DEFLATED, 31)
    after = after.compress(records[0]) + after.flush()
    whole = list(warc.salvage(member))
    assert [k for k, *_ in whole] == ["record"] * 100
    for tenth in range(1, 10):
        at = len(member) * tenth // 10
        damaged = bytearray(member)
        damaged[at : at + 8] = b"\xff" * 8
        for data, next_there in ((bytes(damaged) + after, True), (member[:at], False)):
            rows = list(warc.salvage(data))
            got = [block for kind, _, _, _, block in rows if kind == "record"]
            assert len(got) - next_there >= 100 * (tenth - 1) // 10 and any(kind == "gap" for kind, *_ in rows)
            assert got[: len(got) - next_there] == [row[4] for row in whole[: len(got) - next_there]]
            assert not next_there or got[-1] == whole[0][4]
            # every byte is in a record's place or in a gap
            places = sorted({(a, b) for _, a, b, _, _ in rows})
            assert places[0][0] == 0 and places[-1][1] == len(data) and all(x[1] >= y[0] for x, y in zip(places[:-1], places[1:], strict=True))
