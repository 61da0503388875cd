"""Secret scans: fixed patterns, and Shannon entropy in sliding windows over candidate strings.

A window's entropy is kept by incremental counts (one character leaves, one comes in), each character class having
its own window and threshold; parts of a span that are on the allow list are suppressed. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame

from heronry.llm.common import flat_map

KINDS = ("assign", "access", "hex", "entropy")
#: The base patterns, and the least lengths of group 2, of the whole match and of the run.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
_WORDS = (b"passw", b"secret", b"token", b"api_key", b"apikey")


@dataclass(frozen=True)
class CharacterClass:
    """Candidates are maximal runs over ``alphabet``; windows of ``window`` characters with at least ``bits``."""

    name: str
    alphabet: bytes
    window: int
    bits: float


_LOWER, _UPPER, _DIGITS = b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
#: From the narrowest class to the widest: a candidate is judged by the narrowest class that holds it whole.
CLASSES = (
    CharacterClass("hex", _DIGITS + b"abcdefABCDEF", 20, 2.9),
    CharacterClass("alphanumeric", _DIGITS + _LOWER + _UPPER, 20, 3.5),
    CharacterClass("base64", _DIGITS + _LOWER + _UPPER + b"+/_=-", 20, 3.6),
)


def _on(head: str, tail: str) -> str:
    """A pattern of ``head`` and as much of ``tail``, from its start, as follows."""
    more = ""
    for c in reversed(tail):
        more = f"(?:{c}{more})?"
    return head + more


#: Harmless parts of a candidate: identifiers, documentation placeholders, runs of the alphabet, dates.
ALLOWED = (
    re.compile(rb"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", re.IGNORECASE),
    re.compile(rb"example|placeholder|changeme|redacted|dummy|x{4,}", re.IGNORECASE),
    re.compile("|".join((_on("0123456789", "abcdef"), _on("abcdefghij", "klmnopqrstuvwxyz"), _on("qwertyuiop", "asdfghjklzxcvbnm"))).encode(), re.IGNORECASE),
    re.compile(rb"(?:19|20)\d\d-[01]\d-[0-3]\d"),
)
#: A digest with the word for it on the same line, and a URL (to the next white space, quote or angle bracket).
DIGEST = re.compile(rb"(?<![0-9a-z])(?:sha(?:1|256|384|512)|md5|integrity|commit|checksum)[^\w\r\n]{0,3}(?:sha(?:1|256|384|512)-)?[0-9a-z+/]{1,128}={0,2}", re.IGNORECASE)
URL = re.compile(rb"://[^\s\x85\xa0\"'`<>]*")
#: How far before a candidate a digest's word and a URL may begin.
DIGEST_BEFORE, URL_BEFORE = 16, 200
#: White space that Latin-1 lacks; it ends a URL like any other.
_SPACES = re.compile("[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def _marks(alphabet: bytes) -> bytes:
    return bytes(120 if b in alphabet else 32 for b in range(256))


_HEX_MARKS, _WIDE_MARKS = _marks(_DIGITS + b"abcdef"), _marks(CLASSES[-1].alphabet)


def _runs(marked: bytes, least: int) -> Iterator[tuple[int, int]]:
    """Maximal runs of marks of ``least`` or more."""
    probe, at = b"x" * least, 0
    while (at := marked.find(probe, at)) >= 0:
        end = marked.find(b" ", at)
        end = len(marked) if end < 0 else end
        yield at, end
        at = end


def base_spans(raw: bytes) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end) of the fixed patterns, leftmost and non-overlapping within a kind."""
    found = []
    low = raw.lower()
    if any(w in low for w in _WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(raw) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if b"AKIA" in raw:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(raw) if m.end() - m.start() >= MIN_ACCESS]
    found += [(a, 2, b) for a, b in _runs(raw.translate(_HEX_MARKS), MIN_HEX)]
    return sorted(found)


def window_entropies(run: bytes, window: int) -> list[float]:
    """Shannon entropy in bits of each window, by incremental counts: H = log2 W - sum(c log2 c) / W."""
    if len(run) < window:
        return []
    weight = [0.0, 0.0, *(c * math.log2(c) for c in range(2, window + 1))]
    counts = [0] * 256
    total = 0.0
    out = []
    for i, b in enumerate(run):
        if i >= window:
            old = run[i - window]
            c = counts[old]
            counts[old] = c - 1
            total += weight[c - 1] - weight[c]
        c = counts[b]
        counts[b] = c + 1
        total += weight[c + 1] - weight[c]
        if i >= window - 1:
            out.append(math.log2(window) - total / window)
    return out


def outside(a: int, b: int, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """The parts of a span that no taken span covers."""
    for x, y in sorted(taken):
        if y <= a or x >= b:
            continue
        if x > a:
            yield a, x
        a = max(a, y)
    if a < b:
        yield a, b


def allowed_parts(raw: bytes, a: int, b: int) -> list[tuple[int, int]]:
    """What of the candidate from ``a`` to ``b`` is on the allow list."""
    found = [m.span() for p in ALLOWED for m in p.finditer(raw, a, b)]
    found += [m.span() for m in DIGEST.finditer(raw, max(0, a - DIGEST_BEFORE), b) if m.end() > a]
    return found + [m.span() for m in URL.finditer(raw, max(0, a - URL_BEFORE), b) if m.end() > a]


def entropy_spans(raw: bytes, classes: tuple[CharacterClass, ...] = CLASSES) -> list[tuple[int, int]]:
    """Unions of windows of high entropy that hold two digits and two letters at least, less the allow list."""
    found = []
    least = min(c.window for c in classes)
    digit = [48 <= b <= 57 for b in range(256)]
    for a, b in _runs(raw.translate(_WIDE_MARKS), least):
        run = raw[a:b]
        kind = next((c for c in classes if not run.strip(c.alphabet) and not run.translate(None, c.alphabet)), None)
        if kind is None or len(run) < kind.window or not any(map(digit.__getitem__, run)):
            continue
        w = kind.window
        digits = sum(digit[x] for x in run[:w])
        letters = sum(chr(x).isalpha() for x in run[:w])
        start = end = -1
        spans = []
        for i, bits in enumerate(window_entropies(run, w)):
            if i:
                digits += digit[run[i + w - 1]] - digit[run[i - 1]]
                letters += chr(run[i + w - 1]).isalpha() - chr(run[i - 1]).isalpha()
            if bits >= kind.bits and digits >= 2 and letters >= 2:
                if start >= 0 and i > end:
                    spans.append((start, end))
                    start = -1
                start = i if start < 0 else start
                end = i + w
        if start >= 0:
            spans.append((start, end))
        if spans:
            allowed = allowed_parts(raw, a, b)
            found += [x for s, e in spans for x in outside(a + s, a + e, allowed) if any(chr(c).isalnum() for c in raw[x[0] : x[1]])]
    return found


def scan(text: str | None) -> list[tuple[int, str, int]]:
    """(start, kind, end) of all findings, by start and then by kind. Of high-entropy spans what lies outside base spans counts."""
    if not text:
        return []
    raw = (text if text.isascii() else _SPACES.sub("\n", text)).encode("latin-1", "replace")  # one byte for each code point; what is outside Latin-1 is in no class
    base = base_spans(raw)
    taken = [(x, y) for x, _, y in base]
    more = [(x, 3, y) for a, b in entropy_spans(raw) for x, y in outside(a, b, taken)]
    return [(a, KINDS[k], b) for a, k, b in sorted(base + more)]


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


def redact(text: str, spans: list[tuple[int, str, int]], mark: str = "[secret]") -> str:
    """Replaces the union of the spans; overlapping spans become one mark."""
    out, at = [], 0
    for a, _, b in spans:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def secret_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Findings of every whole text: counts by base kind, the digest of the base spans, and all spans.

    A null text counts as empty: no findings. Each input row gives one row, repeated or null ids included.
    """

    def factory():
        def kernel(key, text):
            spans = scan(text)
            base = [s for s in spans if s[1] != "entropy"]
            n = [sum(s[1] == k for s in base) for k in KINDS[:3]]
            yield (key, *n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans) - len(base))

        return kernel

    kind = df.schema[id_col].dataType.simpleString()
    return flat_map(df, [id_col, text_col], f"{id_col} {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long", factory)


def redacted(df: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The same rows and columns with secrets replaced in the text (and its length updated)."""
    names = [f.name for f in df.schema]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    at, n = names.index(text_col), names.index(chars_col) if chars_col in names else None

    def factory():
        def kernel(*row):
            text = row[at]
            if spans := scan(text):
                row = list(row)
                row[at] = redact(text, spans)
                if n is not None:
                    row[n] = len(row[at])
            yield tuple(row)

        return kernel

    return flat_map(df, names, schema, factory, 256)
