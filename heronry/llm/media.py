"""Media columns: types by signature sniffing, corrected declarations, and carved embedded media.

An Aho-Corasick automaton locates the magic bytes of all formats in one pass; a validator of the format then
confirms the structure from there and its length. Bytes only count as media where a validator accepts them.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import struct
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from heronry.llm.common import flat_map


class Data(bytes):
    """Bytes with what validators have learned about them, so that many magics in one text cost a walk once.

    Walks depend on their place alone: each remembers where it ended for every place it passed. Markers are located
    once for the whole text.
    """

    def __new__(cls, raw: bytes):
        self = super().__new__(cls, raw)
        self.memo = {}
        return self

    def known(self, what: str) -> dict:
        return self.memo.setdefault(what, {})

    def markers(self, marker: bytes) -> list[int]:
        """Places of a marker, ascending."""
        if marker not in self.memo:
            self.memo[marker] = [m.start() for m in re.finditer(re.escape(marker), self)]
        return self.memo[marker]


def _walk(known: dict, i: int, step: Callable[[int], int | None], ended: Callable[[int], int | None]) -> int | None:
    """Follows ``step`` from i until ``ended`` gives a result or there is no next place; all places passed learn it."""
    path, result = [], None
    while True:
        if i in known:
            result = known[i]
            break
        path.append(i)
        if (result := ended(i)) is not None:
            break
        nxt = step(i)
        if nxt is None or nxt <= i:
            break
        i = nxt
    for x in path:
        known[x] = result
    return result


def _riff(kind: bytes) -> Callable[[Data, int], int | None]:
    def check(b: Data, at: int) -> int | None:
        if len(b) < at + 12 or b[at + 8 : at + 12] != kind:
            return None
        end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
        if end > len(b):
            return None
        # Chunks must tile the file. Chains of chunks merge, so each is kept as a number and followed once.
        places = b.known(f"riff {at % 2}")  # place: chain, rank in it
        chains = b.known(f"chains {at % 2}")  # chain: the place where it runs into an older one, or None
        i, chain = at + 12, at
        if i >= end:
            return None
        rank = 0
        while i not in places and i + 8 <= len(b):
            places[i] = (chain, rank)
            rank += 1
            i += 8 + struct.unpack_from("<I", b, i + 4)[0]
            i += (i - at) % 2
        chains[chain] = i if i in places and places[i][0] != chain else None
        ends = b.known(f"ends {at % 2}")
        if chains[chain] is None:
            ends[chain] = i  # where the chain leaves the text
        i = at + 12
        while True:  # is ``end`` further along this chain, or along those it runs into?
            if i not in places:
                return end - at if i in (end, end + (end - at) % 2) else None
            chain, rank = places[i]
            for e in (end, end + (end - at) % 2):  # the last chunk's pad byte may lie outside
                if e in places and places[e][0] == chain and places[e][1] >= rank:
                    return end - at
            if chains[chain] is None:
                return end - at if ends[chain] in (end, end + (end - at) % 2) else None
            i = chains[chain]

    return check


def _png(b: Data, at: int) -> int | None:
    if b[at + 12 : at + 16] != b"IHDR":
        return None

    def step(i: int) -> int | None:
        if i + 12 > len(b):
            return None
        size = struct.unpack_from(">I", b, i)[0]
        if i + 12 + size > len(b) or b[i + 4 : i + 8] == b"IEND" or zlib.crc32(memoryview(b)[i + 4 : i + 8 + size]) != struct.unpack_from(">I", b, i + 8 + size)[0]:
            return None
        return i + 12 + size

    def ended(i: int) -> int | None:
        return i + 12 if b[i : i + 12] == b"\0\0\0\0IEND\xaeB`\x82" else None

    end = _walk(b.known("png"), at + 8, step, ended)
    return end - at if end else None


def _gif(b: Data, at: int) -> int | None:
    if len(b) < at + 13:
        return None

    def blocks(i: int) -> int | None:
        return _walk(b.known("gif blocks"), i, lambda i: i + 1 + b[i] if i < len(b) else None, lambda i: i + 1 if i < len(b) and not b[i] else None)

    def step(i: int) -> int | None:
        if i < len(b) and b[i] == 0x21:
            return blocks(i + 2)
        if i + 10 < len(b) and b[i] == 0x2C:
            return blocks(i + 11 + (3 << ((b[i + 9] & 7) + 1) if b[i + 9] & 128 else 0))
        return None

    end = _walk(b.known("gif"), at + 13 + (3 << ((b[at + 10] & 7) + 1) if b[at + 10] & 128 else 0), step, lambda i: i + 1 if i < len(b) and b[i] == 0x3B else None)
    return end - at if end else None


def _jpeg(b: Data, at: int) -> int | None:
    def step(i: int) -> int | None:
        if i + 4 > len(b) or b[i] != 0xFF or not 0xC0 <= b[i + 1] <= 0xFE or b[i + 1] == 0xDA:
            return None
        size = struct.unpack_from(">H", b, i + 2)[0]
        return i + 2 + size if size >= 2 else None

    def ended(i: int) -> int | None:
        if i + 4 > len(b) or b[i : i + 2] != b"\xff\xda":
            return None
        markers = b.markers(b"\xff\xd9")  # entropy-coded data up to the end marker
        k = bisect.bisect_left(markers, i + 2 + struct.unpack_from(">H", b, i + 2)[0])
        return markers[k] + 2 if k < len(markers) else None

    end = _walk(b.known("jpeg"), at + 2, step, ended)
    return end - at if end else None


def _bmp(b: bytes, at: int) -> int | None:
    if len(b) < at + 30:
        return None
    size, zero, start, head = struct.unpack_from("<IIII", b, at + 2)
    return size if not zero and head in (12, 40, 108, 124) and 14 + head <= start <= size <= len(b) - at else None


_XREF = re.compile(rb"xref|\d{1,12}\s{1,8}\d{1,12}\s{1,8}obj")
_EOF = re.compile(rb"startxref\s{1,8}(\d{1,12})\s{1,8}%%EOF")


class _Ends:
    """Sections and %%EOF ends of all PDFs of a text, located once; ends are also kept by the offset that they state."""

    def __init__(self, b: bytes) -> None:
        self.sections = np.array([m.start() for m in _XREF.finditer(b)], np.int64)
        found = [(int(m[1]), m.start(), m.end()) for m in _EOF.finditer(b)]
        self.starts, self.ends = [f[1] for f in found], [f[2] for f in found]
        self.by_offset: dict[int, list[int]] = {}
        for k, (to, _, _) in enumerate(found):
            if to < len(b):
                self.by_offset.setdefault(to, []).append(k)
        self.offsets = np.array(sorted(self.by_offset), np.int64)
        self.is_section, self.is_offset = np.zeros(len(b), bool), np.zeros(len(b), bool)
        self.is_section[self.sections] = True
        self.is_offset[self.offsets] = True

    def stated(self, at: int) -> list[int]:
        """The offsets stated anywhere that lead from ``at`` to a section: over the fewer of offsets and sections left."""
        sections = self.sections[np.searchsorted(self.sections, at) :]
        if len(sections) < len(self.offsets):
            return (sections - at)[self.is_offset[sections - at]].tolist()
        offsets = self.offsets[: np.searchsorted(self.offsets, len(self.is_section) - at)]
        return offsets[self.is_section[at + offsets]].tolist()


def _pdf(b: Data, at: int) -> int | None:
    """To the last %%EOF whose startxref points to a cross-reference section, each behind what came before (updates).

    Of the ends that state one offset only the first behind the section can count, so ends that repeat cost nothing.
    """
    known = b.memo.get("pdf")
    if known is None:
        known = b.memo["pdf"] = _Ends(b)
    first = bisect.bisect_left(known.starts, at)
    if first == len(known.starts):
        return None
    near = []
    for to in known.stated(at):
        own = known.by_offset[to]
        k = bisect.bisect_right(own, at + to, key=known.starts.__getitem__)
        if k < len(own):
            near.append((own[k], to))
    last = 0
    for k, to in sorted(near):
        if to >= last:
            last = known.ends[k] - at
    return last or known.ends[first] - at


def _zip(b: Data, at: int) -> int | None:
    """To the end record whose directory lies where it says; stored archives have end records too.

    Which start an end record implies does not depend on ``at``, so all records are read once.
    """
    starts = b.memo.get("zip")
    if starts is None:
        starts = b.memo["zip"] = {}
        for end in b.markers(b"PK\x05\x06"):
            if end + 22 <= len(b):
                size, start, comment = struct.unpack_from("<IIH", b, end + 12)
                if end + 22 + comment <= len(b) and (not size or b.startswith(b"PK\x01\x02", end - size)):
                    starts.setdefault(end - size - start, []).append(end + 22 + comment)
    ends = starts.get(at, [])
    k = bisect.bisect_right(ends, at + 22)
    return ends[k] - at if k < len(ends) else None


def _gzip(b: Data, at: int) -> int | None:
    """Decompresses, in blocks, to the stream's end; its checksum and length are confirmed by that."""
    reader, view, i = zlib.decompressobj(31), memoryview(b), at
    try:
        while i < len(b) and not reader.eof:
            left = view[i : i + 65536]
            i += len(left)
            while left and not reader.eof:
                reader.decompress(left, 1 << 20)
                left = reader.unconsumed_tail
    except zlib.error:
        return None
    return i - len(reader.unused_data) - at if reader.eof else None


def _crc(data: bytes, poly: int, bits: int) -> int:
    crc, top = 0, 1 << bits - 1
    for byte in data:
        crc ^= byte << bits - 8
        for _ in range(8):
            crc = (crc << 1 ^ poly if crc & top else crc << 1) & (2 << bits - 1) - 1
    return crc


class _Bits:
    def __init__(self, b: bytes, at: int) -> None:
        self.b, self.at = b, at * 8

    def read(self, n: int) -> int:
        lo, hi = self.at // 8, (self.at + n + 7) // 8
        if hi > len(self.b):
            raise EOFError
        found = int.from_bytes(self.b[lo:hi]) >> hi * 8 - self.at - n & (1 << n) - 1
        self.at += n
        return found

    def skip(self, n: int) -> None:
        self.at += n
        if self.at > 8 * len(self.b):
            raise EOFError

    def unary(self) -> int:
        n = 0
        while not self.read(1):
            n += 1
        return n


def _flac_frame(b: bytes, at: int, default: int) -> tuple[int, int] | None:
    """Where the frame ends, and its samples; its subframes are walked and both its checksums confirmed."""
    r = _Bits(b, at)
    if r.read(15) != 0x7FFC:
        return None
    r.skip(1)
    block, rate, channels, width = r.read(4), r.read(4), r.read(4), r.read(3)
    if r.read(1) or not block or rate == 15 or channels > 10 or width == 3:
        return None
    lead = r.read(8)
    r.skip(8 * max(0, (8 - (lead ^ 255).bit_length()) - 1))
    n = 192 if block == 1 else 576 << block - 2 if block < 6 else r.read(8 * (block - 5)) + 1 if block < 8 else 256 << block - 8
    r.skip({12: 8, 13: 16, 14: 16}.get(rate, 0))
    if _crc(b[at : r.at // 8], 0x07, 8) != r.read(8):
        return None
    bits = (default, 8, 12, 0, 16, 20, 24, 32)[width]
    for c in range(channels + 1 if channels < 8 else 2):
        depth = bits + ((channels, c) in ((8, 1), (9, 0), (10, 1)))
        if r.read(1):
            return None
        kind = r.read(6)
        if r.read(1):
            depth -= r.unary() + 1
        order = kind - 8 if 8 <= kind <= 12 else kind - 31 if kind >= 32 else None
        if kind < 2:
            r.skip(depth * (n if kind else 1))
            continue
        if order is None or order > n:
            return None
        r.skip(depth * order)
        if kind >= 32:
            precision = r.read(4) + 1
            r.skip(5 + order * precision)
        method, parts = r.read(2), r.read(4)
        if method > 1:
            return None
        for p in range(1 << parts):
            param, samples = r.read(4 + method), (n >> parts) - (0 if p else order)
            if param == (31 if method else 15):
                r.skip(r.read(5) * samples)
                continue
            for _ in range(samples):
                r.unary()
                r.skip(param)
    end = -(-r.at // 8) + 2
    return (end, n) if end <= len(b) and not _crc(b[at:end], 0x8005, 16) else None


def _flac(b: bytes, at: int) -> int | None:
    """Metadata blocks, then frames until the stream's samples are met (where it states none, to the last whole frame)."""
    if len(b) < at + 42 or b[at + 4] & 127 or b[at + 5 : at + 8] != b"\x00\x00\x22":
        return None
    packed = int.from_bytes(b[at + 18 : at + 26])
    total, bits, i, last = packed & (1 << 36) - 1, (packed >> 36 & 31) + 1, at + 4, False
    while not last:
        if i + 4 > len(b):
            return None
        last, i = b[i] > 127, i + 4 + int.from_bytes(b[i + 1 : i + 4])
    if i > len(b):
        return None
    met = 0
    while not total or met < total:
        try:
            frame = _flac_frame(b, i, bits)
        except EOFError:
            frame = None
        if frame is None:
            return None if total else i - at
        i, met = frame[0], met + frame[1]
    return i - at


#: Magic bytes, media type and validator of each format.
FORMATS: tuple[tuple[bytes, str, Callable[[bytes, int], int | None]], ...] = (
    (b"RIFF", "audio/wav", _riff(b"WAVE")),
    (b"RIFF", "image/webp", _riff(b"WEBP")),
    (b"RIFF", "video/x-msvideo", _riff(b"AVI ")),
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"GIF87a", "image/gif", _gif),
    (b"GIF89a", "image/gif", _gif),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"BM", "image/bmp", _bmp),
    (b"%PDF-", "application/pdf", _pdf),
    (b"PK\x03\x04", "application/zip", _zip),
    (b"\x1f\x8b\x08", "application/gzip", _gzip),
    (b"fLaC", "audio/flac", _flac),
)
OTHER = "application/octet-stream"
_AUTOMATON = []


def _automaton():
    if not _AUTOMATON:
        import ahocorasick

        found = ahocorasick.Automaton()
        for magic in {m for m, _, _ in FORMATS}:
            found.add_word(magic.decode("latin-1"), magic)
        found.make_automaton()
        _AUTOMATON.append(found)
    return _AUTOMATON[0]


def sniff(data: bytes) -> tuple[str, list[tuple[str, int, int]]]:
    """The whole's type, and the media embedded in it as (type, offset, length), outermost first and not nested.

    The whole's type is that of the format confirmed at offset 0, else octet-stream. Embedded media are looked for
    behind the whole's header too, so a container's payload is searched. Very long texts full of magic bytes are
    walked in time near to linear: RIFF, PNG, GIF and JPEG chains, ZIP ends and PDF sections are followed once.
    """
    whole, carved, until = OTHER, [], 0
    data = Data(data)
    for last, magic in _automaton().iter(data.decode("latin-1")):
        at = last - len(magic) + 1
        if 0 < at < until:
            continue
        for m, kind, check in FORMATS:
            if m == magic and (size := check(data, at)):
                if at == 0:
                    whole = kind
                else:
                    carved.append((kind, at, size))
                    until = at + size
                break
    return whole, carved


def to_wav(payload: bytes) -> bytes:
    """A mono 8-bit PCM file at 8 kHz whose samples are the payload (of even length)."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", len(payload))
    return head + payload


def from_wav(media: bytes) -> bytes:
    """The samples of the data chunk; the structure is confirmed first."""
    if media[:4] != b"RIFF" or not _riff(b"WAVE")(Data(media), 0):
        raise ValueError("not a WAV file")
    i, fmt = 12, None
    while i + 8 <= len(media):
        kind, size = struct.unpack_from("<4sI", media, i)
        if kind == b"fmt ":
            fmt = struct.unpack_from("<HHIIHH", media, i + 8)
        if kind == b"data":
            if fmt is None or fmt[0] != 1 or fmt[5] != 8:
                raise ValueError("not 8-bit PCM")
            return media[i + 8 : i + 8 + size]
        i += 8 + size + size % 2
    raise ValueError("no samples")


def padded(text: str | None) -> tuple[int, bytes]:
    """A text's UTF-8 length, and its bytes with zeros up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(64 - len(raw) % 64 if len(raw) % 64 or not raw else 0)


def sample_feature(samples: bytes) -> str:
    """Mean, deviation and entropy of the 8-bit samples."""
    counts = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
    share = counts / counts.sum()
    value = np.arange(256)
    mean = float(share @ value)
    spread = float(share @ (value - mean) ** 2) ** 0.5
    bits = float(-(share[share > 0] * np.log2(share[share > 0])).sum())
    return f"mean={mean:.4f};sd={spread:.4f};bits={bits:.4f}"


def sniffed(df: DataFrame, id_col: str, bytes_col: str, declared_col: str | None = None) -> DataFrame:
    """Types of a binary column: id, declared, media_type, corrected, embedded (type, offset, length).

    ``corrected`` says that a declared type differs from the confirmed one. Null and empty bytes are octet-stream
    with nothing embedded; a null declaration is never wrong. Each input row gives one row.
    """

    def factory():
        def kernel(key, data, declared=None):
            kind, carved = sniff(data or b"")
            yield key, declared, kind, declared is not None and declared != kind, [{"media_type": k, "start": a, "size": n} for k, a, n in carved]

        return kernel

    kind = df.schema[id_col].dataType.simpleString()
    return flat_map(df, [id_col, bytes_col, *([declared_col] if declared_col else [])], f"{id_col} {kind}, declared string, media_type string, corrected boolean, embedded array<struct<media_type: string, start: long, size: long>>", factory, 256)


def text_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = True, declared: str = OTHER) -> DataFrame:
    """Stores every whole text as a WAV file and reads the stored bytes back.

    The stored bytes are declared as ``declared``; sniffing corrects that, and only a file confirmed as WAV is read.
    Null texts count as empty. With ``keep_media=False`` the stored bytes are left out of the result. ``feature``
    has the confirmed type, the media carved from within and statistics of the samples read back.
    """

    def factory():
        sha = hashlib.sha256

        def kernel(key, text):
            n, payload = padded(text)
            media = to_wav(payload)
            kind, carved = sniff(media)
            if kind != "audio/wav":
                raise ValueError(f"stored bytes are {kind}, declared as {declared}")
            back = from_wav(media)
            embedded = ",".join(f"{k}@{a}+{size}" for k, a, size in carved)
            feature = f"{kind};corrected={kind != declared};embedded={embedded};{sample_feature(back)}"
            row = (key, n, len(back), sha(back).hexdigest(), zlib.crc32(back[-64:]), len(media), sha(media).hexdigest(), feature)
            yield (*row, media) if keep_media else row

        return kernel

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return flat_map(df, [id_col, text_col], schema + ", media binary" * keep_media, factory, 128 if keep_media else 2048)
