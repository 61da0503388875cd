import hashlib
import io
import math
import random
import re
import struct
import time
import zipfile
import zlib

import pytest

from heronry.llm import media, secret_scan

from .fixtures import documents, odd_documents

KEY = "Zk3v9QpL7xWq2RtY8uBn4MsD"


def brute_base(text):
    spans = []
    for m in re.finditer(r"""(?i)(?a:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII):
        if len(m[2]) >= 6:
            spans.append((m.start(), 0, "assign", m.end()))
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 20:
            spans.append((m.start(), 1, "access", m.end()))
    for m in re.finditer(r"[0-9a-f]+", text):
        if len(m[0]) >= 24:
            spans.append((m.start(), 2, "hex", m.end()))
    return [(a, kind, b) for a, _, kind, b in sorted(spans)]


@pytest.mark.parametrize(
    "text",
    [
        "é😀 Password = 'abc123xyz' and token:short token: longer-one",
        'api_key="AKIA' + "A" * 16 + '" apikey=' + "0123456789abcdef" * 2,
        "AKIA" + "B" * 15 + " AKIAAKIA" + "7" * 30,
        "deadbeef" * 3 + "g" + "a" * 23 + " ſecret=abcdefgh toKen=abcdefgh",
        "passwordpassword  :  x passwd=------ secret",
        "",
    ],
)
def test_base_spans_equal_plain_patterns(text):
    assert [s for s in secret_scan.scan(text) if s[1] != "entropy"] == brute_base(text)


def test_incremental_entropy_equals_counting():
    run = b"abcaabbccdd0123456789ZZZZ" * 3
    for w in (5, 20):
        for i, bits in enumerate(secret_scan.window_entropies(run, w)):
            part = run[i : i + w]
            assert bits == pytest.approx(-sum(part.count(c) / w * math.log2(part.count(c) / w) for c in set(part)))


def test_entropy_adds_spans_and_the_allow_list_takes_them():
    assert secret_scan.scan(f"see {KEY} here") == [(4, "entropy", 4 + len(KEY))]
    assert secret_scan.scan("see 123e4567-e89b-42d3-a456-426614174000 here") == []
    assert secret_scan.scan(f"integrity: sha384-{KEY}") == []
    assert secret_scan.scan("thatthtihetionanerehaingoredandthwh " * 20) == []
    assert [s[1] for s in secret_scan.scan(f"token={KEY}")] == ["assign"]


@pytest.mark.parametrize(
    "before, after",
    [("DB_URL=postgres://db.internal:5432/app\nSIGNING_KEY: ", ""), ("see https://a.b/c\t", ""), ("see https://a.b/c\u3000", ""), ('{"url":"https://a.b","key":"', '"}'), ("2024-01-15 ", ""), ("for example ", ""), ("", " example"), ("checksum:\n", "")],
)
def test_the_allow_list_judges_the_candidate_alone(before, after):
    assert (len(before), "entropy", len(before) + len(KEY)) in secret_scan.scan(before + KEY + after)


def test_only_the_allowed_or_known_part_of_a_span_goes():
    assert secret_scan.scan(f"see https://a.b/{KEY} md5:{KEY}") == []
    uuid = "123e4567-e89b-42d3-a456-426614174000"
    assert secret_scan.scan(f"{KEY}/{uuid}") == [(0, "entropy", len(KEY) + 1)]
    run = "0a1b2c3d" * 3
    text = f"{KEY}{run}{KEY[::-1]}"
    found = secret_scan.scan(text)
    assert any(k == "hex" for _, k, _ in found)
    covered = {i for a, _, b in found for i in range(a, b)}
    assert covered == set(range(len(text))) and secret_scan.redact(text, found).replace("[secret]", "") == ""


def test_scan_of_tables(spark):
    df = odd_documents(spark).unionByName(documents(spark, [f"token={KEY} x"]).selectExpr("99L as doc_id", "* except (doc_id)"))
    rows = secret_scan.secret_scan(df).collect()
    assert len(rows) == df.count()
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[2]["spans"] == "" and by_id[2]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert by_id[99]["n_assign"] == 1 and by_id[99]["base_sha256"] == hashlib.sha256(f"assign:0:{6 + len(KEY)}".encode()).hexdigest()
    clean = {r["doc_id"]: r for r in secret_scan.redacted(df).collect()}
    assert clean[99]["text"] == "[secret] x" and clean[99]["n_chars"] == 10
    assert clean[0]["text"] == [r["text"] for r in df.collect() if r["doc_id"] == 0][0] and clean[2]["text"] is None
    assert secret_scan.secret_scan(df.limit(0)).count() == 0


def test_redaction_merges_overlaps():
    assert secret_scan.redact("abcdefgh", [(1, "x", 4), (2, "y", 6), (6, "z", 7)]) == "a[secret][secret]h"


def png():
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def test_sniffing_confirms_structure_and_carves():
    image, sound = png(), media.to_wav(bytes(range(64)))
    assert media.sniff(image) == ("image/png", [])
    assert media.sniff(sound)[0] == "audio/wav"
    assert media.sniff(image[:-1])[0] == media.OTHER
    assert media.sniff(image[:20] + b"!" + image[21:])[0] == media.OTHER
    assert media.sniff(b"junk" + image + b"RIFF" + sound) == (media.OTHER, [("image/png", 4, len(image)), ("audio/wav", 8 + len(image), len(sound))])
    assert media.sniff(b"GIF89a%PDF-BMPK\x03\x04\xff\xd8\xff")[0] == media.OTHER
    gif = b"GIF89a\x01\0\x01\0\0\0\0,\0\0\0\0\x01\0\x01\0\0\x02\x02D\x01\0;"
    assert media.sniff(gif) == ("image/gif", [])
    assert media.sniff(zlib.compress(b"x" * 9, wbits=31))[0] == "application/gzip"
    assert media.sniff(b"") == (media.OTHER, [])


def flac(total=32):
    """Two frames of 16 samples: a constant one, and one of fixed order 0 whose residual is Rice-coded."""
    packed = 8000 << 44 | 7 << 36 | total
    out = b"fLaC\x80\x00\x00\x22" + struct.pack(">HH", 16, 16) + bytes(6) + packed.to_bytes(8) + bytes(16)
    for n, body in enumerate((b"\x00\x55", bytes([16, 0, 0b01101010]) + b"\xaa" * 3 + b"\x80")):
        head = b"\xff\xf8\x60\x00" + bytes([n, 15])
        frame = head + bytes([media._crc(head, 7, 8)]) + body
        out += frame + media._crc(frame, 0x8005, 16).to_bytes(2)
    return out


def pdf():
    body = b"%PDF-1.4\n1 0 obj\n<<>>\nendobj\n"
    once = body + b"xref\n0 1\ntrailer\n<<>>\nstartxref\n%d\n%%%%EOF" % len(body)
    return once + b"\n2 0 obj\n<<>>\nendobj\nxref\n0 1\ntrailer\n<<>>\nstartxref\n%d\n%%%%EOF" % (len(once) + 21)


def archive(name, data):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(name, data)
    return out.getvalue()


def test_media_behind_flac_pdf_and_zip_are_carved():
    assert media._crc(b"123456789", 7, 8) == 0xF4 and media._crc(b"123456789", 0x8005, 16) == 0xFEE8
    image, first = png(), pdf().index(b"%%EOF") + 5
    head = b"%PDF-1.4\nxref\n0 1\ntrailer\n<<>>\nstartxref\n0\n%%EOF\n1 0 obj\nendobj\n"
    for kind, whole in (("audio/flac", flac()), ("audio/flac", flac(0)), ("application/pdf", pdf()), ("application/pdf", head + b"startxref\n9\n%%EOF"), ("application/zip", archive("in.zip", archive("a.txt", b"text")))):
        found = media.sniff(b"junk" + whole + b"--" + image)
        assert found == (media.OTHER, [(kind, 4, len(whole)), ("image/png", 6 + len(whole), len(image))])
        assert media.sniff(whole)[0] == kind
    assert media._flac(flac()[:-1], 0) is None
    assert media.sniff(b"junk" + pdf()[:first] + pdf())[1] == [("application/pdf", 4, first), ("application/pdf", 4 + first, len(pdf()))]


def test_declared_types_are_corrected(spark):
    rows = [(1, bytearray(png()), "image/gif", 1), (2, bytearray(png()), "image/png", 1), (3, None, None, 1), (4, bytearray(b""), "image/png", 1)]
    df = spark.createDataFrame(rows, "id long, data binary, kind string, media_type int")
    got = {r["id"]: (r["media_type"], r["corrected"]) for r in media.sniffed(df, "id", "data", "kind").collect()}
    assert got == {1: ("image/png", True), 2: ("image/png", False), 3: (media.OTHER, False), 4: (media.OTHER, True)}


def test_texts_survive_storage(spark):
    df = odd_documents(spark)
    rows = media.text_media(df).collect()
    assert len(rows) == df.count()
    texts = {r["doc_id"]: r["text"] or "" for r in df.collect()}
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert r["n_bytes"] == len(raw) and r["payload_bytes"] == len(payload) and len(payload) % 64 == 0
        assert media.from_wav(bytes(r["media"])) == payload
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest() and r["media_bytes"] == len(r["media"])
    same = [r["feature"] for r in rows if r["doc_id"] in (0, 8)]
    assert same[0] == same[1]
    assert media.text_media(df.limit(0)).count() == 0


ADVERSARIAL = [b"%PDF-", b"%PDF-1 startxref 5 %%EOF ", b"PK\3\4", b"PK\3\4PK\5\6" + bytes(18), b"\xff\xd8\xff\xe0\0\2", b"\xff\xd8\xff\xda\0\2", b"GIF87a1234567!!x", b"GIF87a\0\0\0\0\0\0\0!!\5", b"RIFF\xff\xff\1\0WAVE\0\0\0\0", b"\x1f\x8b\x08\0\0\0\0\0", b"BM", b"fLaC"]


@pytest.mark.parametrize("unit", ADVERSARIAL)
def test_texts_full_of_magic_bytes_take_linear_time(unit):
    began = time.time()
    media.sniff(unit * (1_500_000 // len(unit)))
    assert time.time() - began < 10


def test_walks_kept_for_one_magic_hold_for_the_others():
    inner = media.to_wav(b"ab" * 40)
    outer = media.to_wav(inner + b"zz")
    data = b"RIFF" + outer + b"%PDF-" + outer + b"GIF87a" + inner[:-3]
    kind, carved = media.sniff(data)
    assert kind == media.OTHER
    assert carved == [("audio/wav", 4, len(outer)), ("audio/wav", 4 + len(outer) + 5, len(outer))]


def test_a_pdf_with_many_ends_is_followed_through_all_of_them():
    body = b"%PDF-1.4\nxref\n0 1\nstartxref\n9\n%%EOF\n" + b"startxref\n7\n%%EOF\n" * 70 + b"(a quoted %PDF-1.7)\n" + b"startxref\n8\n%%EOF\n" * 70
    body += b"xref\n0 2\nstartxref\n%d\n%%%%EOF" % len(body)
    assert media.sniff(b"junk" + body)[1] == [("application/pdf", 4, len(body))]


def test_pdf_ends_are_those_of_a_plain_scan():
    def plain(b, at):
        places, last, best, first = {m.start() for m in media._XREF.finditer(b)}, 0, None, None
        for m in media._EOF.finditer(b, at):
            first, to = first or m.end(), int(m[1])
            if at + to in places and at + to < m.start() and to >= last:
                last, best = m.end() - at, m.end()
        return (best or first) - at if first else None

    rng = random.Random(7)
    for _ in range(300):
        b = b"".join(rng.choice((b"%PDF-", b"xref ", b"xref ", b"fill", b"startxref %d %%%%EOF " % rng.randrange(60))) for _ in range(40))
        for at in (m.start() for m in re.finditer(b"%PDF-", b)):
            assert media._pdf(media.Data(b), at) == plain(b, at)
