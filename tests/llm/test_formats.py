import hashlib
import struct
import zlib
from collections import Counter

import pytest
import zstandard

from gleanery.llm import media, token_packing, warc
from gleanery.session import staged


def test_packing_round_trip(spark, odd, none):
    rows = staged(token_packing.packed(odd.where("doc_id <> 4"), row=64), "rows")
    want = {r.doc_id: r.text or "" for r in odd.where("doc_id <> 4").collect()}
    assert {r.doc_id: r.text for r in token_packing.unpacked(rows).collect()} == want
    for r in rows.collect():
        assert r.n_tokens <= 64 and len(r.ids) == 128 and r.cu_seqlens[-1] == r.n_tokens and r.position_resets == r.cu_seqlens[:-1]
    assert token_packing.packed(none).count() == 0
    assert token_packing.packed(odd).selectExpr("explode(doc_ids) i").where("i is null").count() == 2


def plain_ids(text):
    with open(token_packing.VOCABULARY, "rb") as f:
        return token_packing.encoding(f.read()).encode_ordinary(text)


def test_long_runs_are_tokenized_alike():
    with open(token_packing.VOCABULARY, "rb") as f:
        enc = token_packing.encoding(f.read())
    for text in ("a" + " " * 2500 + "b", "a" + "\n" * 1200, " " * 1500 + "x y", "q\t \n" * 600 + " z", "x" * 3000 + " " * 1001 + "\n" + " " * 999):
        assert token_packing.token_ids(enc, text) == plain_ids(text)
    for text in (" " * 1_000_000 + "x", "ab" * 500_000):  # too long for the pattern's matcher, or one word of a megabyte
        assert enc.decode(token_packing.token_ids(enc, text)) == text


def test_packed_rows_are_those_of_the_plain_form_however_the_table_is_read(spark, odd):
    want, width = Counter(), 64
    for r in odd.collect():
        ids = [*plain_ids(r.text or ""), 50256]
        for a in range(0, len(ids), width):
            want[r.doc_id, a, tuple(ids[a : a + width])] += 1
    runs = []
    for docs in (odd, odd.repartition(7, "source")):
        rows = token_packing.packed(docs, row=width, shard_tokens=2000).collect()
        got = Counter()
        for r in rows:
            ids = struct.unpack(f"<{width}H", r.ids)
            for k, (doc, start) in enumerate(zip(r.doc_ids, r.piece_starts, strict=True)):
                got[doc, start, ids[r.cu_seqlens[k] : r.cu_seqlens[k + 1]]] += 1
            assert set(ids[r.n_tokens :]) <= {50256}
        assert got == want
        shards = {}
        for r in rows:
            shards.setdefault(r.row_id >> 33, []).append(r)
        for shard in shards.values():  # each is packed as the plain form of best fit packs its pieces
            sizes = sorted((b - a for r in shard for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:], strict=False)), reverse=True)
            room = []
            for n in sizes:
                k = min((k for k, x in enumerate(room) if x >= n), key=lambda k: room[k], default=None)
                if k is None:
                    room.append(width - n)
                else:
                    room[k] -= n
            assert sorted(room) == sorted(width - r.n_tokens for r in shard)
        runs.append(sorted(map(repr, rows)))
    assert runs[0] == runs[1]


def test_best_fit():
    sizes = [5, 4, 3, 3, 2, 2, 1, 8, 8]
    rows = token_packing.best_fit(sizes, 8)
    assert sorted(i for r in rows for i in r) == list(range(9)) and all(sum(sizes[i] for i in r) <= 8 for r in rows)
    assert len(rows) == 5
    room = [0] * 0
    for i in sorted(range(9), key=lambda k: -sizes[k]):  # the plain form: the least room that fits
        k = min((k for k, x in enumerate(room) if x >= sizes[i]), key=lambda k: room[k], default=None)
        if k is None:
            room.append(8 - sizes[i])
        else:
            room[k] -= sizes[i]
    assert sorted(room) == sorted(8 - sum(sizes[i] for i in r) for r in rows)


def test_media_of_texts(odd, none):
    got = Counter(tuple(r) for r in media.round_trip(odd).collect())
    want = Counter()
    for x in odd.collect():
        raw = (x.text or "").encode()
        data = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        steps = [abs(a - b) for a, b in zip(data, data[1:], strict=False)]
        cross = sum((a >= 128) != (b >= 128) for a, b in zip(data, data[1:], strict=False))
        feature = f"wav8:n={len(data)};sum={sum(data)};sq={sum(b * b for b in data)};cross={cross};step={max(steps)}"
        file = b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", len(data)) + data
        found = media.sniff(file)
        sha = lambda d: hashlib.sha256(d).hexdigest()
        want[x.doc_id, len(raw), len(data), sha(data), zlib.crc32(data[-64:]), len(file), sha(file), feature, "audio/wav", len(found)] += 1
    assert got == want
    assert media.round_trip(none).count() == 0


def test_webp_kinds_and_riff():
    def riff(form, *kinds):
        body = form + b"".join(k + struct.pack("<I", 3) + b"abc\0" for k in kinds)
        return b"RIFF" + struct.pack("<I", len(body)) + body

    for kinds in ((b"VP8 ",), (b"VP8L",), (b"VP8X", b"ANIM", b"ANMF"), (b"VP8X", b"ALPH", b"VP8 ")):
        assert media.sniff(riff(b"WEBP", *kinds)) == [("image/webp", 0, len(riff(b"WEBP", *kinds)))]
    assert media.sniff(riff(b"WEBP", b"ICCP")) == [] and media.sniff(riff(b"WAVE", b"fmt ")) == [] and media.sniff(riff(b"WAVE", b"data")) == []
    assert media.sniff(riff(b"WAVE", b"fmt ", b"LIST", b"data"))[0][0] == "audio/wav"


def png(data=b"x"):
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0" + data)) + chunk(b"IEND", b"")


def test_sniffing_corrects_and_carves(spark):
    gif = b"GIF89a\1\0\1\0\x80\0\0\0\0\0\xff\xff\xff,\0\0\0\0\1\0\1\0\0\2\2D\1\0;"
    assert media.sniff(gif) == [("image/gif", 0, len(gif))]
    inside = b"BM and RIFF text " + png() + b"PK" + media.wav(b"ab") + gif[:-1]
    assert [(k, n) for k, _, n in media.sniff(inside)] == [("image/png", len(png())), ("audio/wav", 46)]
    assert media.sniff(png()[:-1]) == [] and media.sniff(png()[:40] + b"?" + png()[41:]) == []
    rows = spark.createDataFrame([(1, "image/gif", bytearray(png())), (2, "text/plain", None), (3, "x", bytearray(inside))], "doc_id long, declared string, media binary")
    found = media.sniffed(rows)
    assert found.where("doc_id = 1").first().corrected and found.where("doc_id = 2").first().type is None
    assert bytes(media.carved(rows, found).where("doc_id = 3 and type = 'image/png'").first().bytes) == png()


@pytest.fixture(scope="module")
def pages(spark):
    same = "<p>" + "same " * 60 + "</p>"
    rows = [(5, "http://a/\r\nx: y", same), (2, None, same), (9, "http://b/", same), (None, "http://c/", same), (3, "u", None), (4, "u", None), (6, "u", "short"), (7, "u", "short"), (2, "again", same), (8, "u", "é" * 500)]
    return spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")


def test_warc_round_trip(spark, pages):
    rows = warc.round_trip(pages).collect()
    assert len(rows) == 10 and not any(r.error for r in rows)
    got = Counter((r.page_id, r.record_type, r.refers_to) for r in rows)
    assert got == Counter({(2, "response", None): 2, (5, "revisit", 2): 1, (9, "revisit", 2): 1, (None, "revisit", 2): 1, **{(i, "response", None): 1 for i in (3, 4, 6, 7, 8)}})
    for r in rows:
        if r.page_id in (3, 8):
            raw = ("" if r.page_id == 3 else "é" * 500).encode()
            assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_faults():
    html = [(f"<html>{'body ' * 50}{i}</html>" * (i % 5 + 1)).encode() for i in range(40)]
    dictionary = zstandard.train_dictionary(2000, html).as_bytes()
    press = warc._compressor(dictionary)
    frames = [press.compress(warc.record(i, "u", x, len(x), hashlib.sha256(x).hexdigest(), None)) for i, x in enumerate(html)]
    data = warc.opening(dictionary) + b"".join(frames)
    good = list(warc.records(data))
    assert [r["payload"] for r in good] == html and not any(r.get("error") for r in good)
    cut = list(warc.records(data[:-3]))
    assert len(cut) == 40 and cut[-1]["error"]
    wrong = press.compress(warc.record(1, "u", b"abc", 3, "00", None))
    out = list(warc.records(warc.opening(dictionary) + wrong + frames[0]))
    assert "digest" in out[0]["error"] and out[1]["payload"] == html[0]
    assert list(warc.records(b"nonsense"))[0]["error"] and list(warc.records(b"")) == []
