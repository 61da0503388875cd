"""BPE encoding and decoding over a minimal acyclic transducer lexicon.

Frequent words are compiled, with their id sequences, into a minimal acyclic automaton (words share prefixes and
suffixes). Each edge carries the number of words that sort before those behind it, so a walk yields the word's
index and through it its ids; outputs therefore never hinder the sharing of suffixes. The automaton is a flat
block of integers that workers memory-map. Words outside the lexicon are merged exactly, by merge rank.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import re
import struct
import tempfile
from collections import Counter

import numpy as np
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry.llm.common import block_map, drop, flat_map, most_frequent, stored

#: The pre-tokenisation pattern of the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens that a worker's memo holds before it starts anew, and the characters of the lexicon's longest word.
MEMO_ENTRIES, MEMO_LENGTH = 800_000, 48
#: Words up to this many bytes are merged together, array-wise; longer ones each by a heap.
SHORT_WORD = 48
#: Runs of white space or of anything else longer than this go to the exact merger, whose cost per run is n log n.
LONG_RUN = 2000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}
    return [rest.get(b) or chr(b) for b in range(256)]


class Vocabulary:
    """A byte-level BPE vocabulary from a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, symbols = spec["model"], byte_symbols()
        back = {s: bytes([b]) for b, s in enumerate(symbols)}
        ids = model["vocab"]
        self.byte_ids = [ids[s] for s in symbols]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = 1 + max([*ids.values(), *self.special.values()])
        self.bytes_of = [b""] * size
        for token, i in ids.items():
            self.bytes_of[i] = b"".join(back[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[ids[a], ids[b]] = (rank, ids[a + b])
        pairs = sorted((a << 32 | b, rank, new) for (a, b), (rank, new) in self.merges.items())
        self._pairs, self._ranks, self._news = (np.array(c, dtype=np.int64) for c in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 3
        self._byte_ids = np.array(self.byte_ids, dtype=np.int64)

    def proper(self) -> bool:
        """Whether merging by the id of the result gives the same ids as merging by listed pairs.

        It does if ids rise with the merge ranks and every token's bytes merge to that token alone. Then two
        neighbours that together spell a token are the last state but one of that token's own merging, which has
        just one such state, so they are the pair that is listed.
        """
        news = [new for _, new in sorted(self.merges.values())]
        tokens = [(i, b) for i, b in enumerate(self.bytes_of) if b and b.decode("utf-8", "replace") not in self.special]
        if any(a >= b for a, b in zip(news, news[1:])) or len({b for _, b in tokens}) < len(tokens):
            return False
        return all(ids == struct.pack("<I", i) for (i, _), ids in zip(tokens, self.merge_many([b for _, b in tokens])))

    def merge(self, word: bytes) -> list[int]:
        """Exact ids of one pre-token: the lowest rank first, the leftmost among equal ranks."""
        return self._merge_long([self.byte_ids[b] for b in word])

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """``merge`` of many short, non-empty words at once, packed: each round does the next merge of every word."""
        out: list[bytes] = [b""] * len(words)
        symbols = self._byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        never = len(self._pairs)

        def look(left, right):
            """Place of each pair in the table; ``never`` where it does not merge."""
            key = left << 32 | right
            at = np.searchsorted(self._pairs, key)
            at[at == never] = 0
            return np.where(self._pairs[at] == key, at, -1) if never else np.full(len(key), -1)

        def rank_of(at):
            return np.where(at >= 0, self._ranks[at] if never else 0, never)

        place = np.full(len(symbols), -1)
        same = owner[:-1] == owner[1:]
        place[:-1][same] = look(symbols[:-1][same], symbols[1:][same])
        rank = rank_of(place)
        while len(symbols):
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.concatenate((starts, [len(symbols)])))
            open_word = best < never
            if not open_word.all():
                done = symbols.astype("<u4")
                for k in np.flatnonzero(~open_word):
                    out[owner[starts[k]]] = done[starts[k] : starts[k] + sizes[k]].tobytes()
                keep = np.repeat(open_word, sizes)
                symbols, owner, place, rank = symbols[keep], owner[keep], place[keep], rank[keep]
                best, sizes = best[open_word], sizes[open_word]
                if not len(symbols):
                    break
            hits = np.flatnonzero(rank == np.repeat(best, sizes))
            hits = hits[np.concatenate(([True], owner[hits[1:]] != owner[hits[:-1]]))]  # the leftmost of each word
            symbols[hits] = self._news[place[hits]]
            keep = np.ones(len(symbols), bool)
            keep[hits + 1] = False
            merged = hits - np.arange(len(hits))  # each hit's place once the symbols merged away are gone
            symbols, owner, place, rank = symbols[keep], owner[keep], place[keep], rank[keep]
            for left in (merged, merged[merged > 0] - 1):
                last = left == len(symbols) - 1
                inner = left[~last]
                pair = owner[inner] == owner[inner + 1]
                place[left] = -1
                place[inner[pair]] = look(symbols[inner[pair]], symbols[inner[pair] + 1])
                rank[left] = rank_of(place[left])
        return out

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same for long words in n log n: a heap of pairs over a linked list."""
        n, get = len(parts), self.merges.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(f[0], i, parts[i], parts[i + 1], f[1]) for i in range(n - 1) if (f := get((parts[i], parts[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i] if parts[i] == a else n
            if j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = new, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else n
                if left >= 0 and right < n and (f := get((parts[left], parts[right]))):
                    heapq.heappush(heap, (f[0], left, parts[left], parts[right], f[1]))
        return [p for p in parts if p >= 0]


class Lexicon:
    """The memory-mapped automaton. Layout: a header of four counts, then 32-bit arrays."""

    def __init__(self, block):
        view = memoryview(block)
        n_states, n_edges, n_words, n_ids = struct.unpack_from("<4I", view, 0)
        ints, at = view[16:].cast("B"), 0

        def take(n: int):
            nonlocal at
            part = ints[at : at + 4 * n].cast("I")
            at += 4 * n
            return part

        self.first, self.final = take(n_states + 1), take(n_states)
        self.label, self.target, self.before = take(n_edges), take(n_edges), take(n_edges)
        self.start = take(n_words + 1)
        self.ids = ints[at : at + 4 * n_ids]
        self.words = n_words
        degree = np.diff(np.asarray(self.first))
        self._keys = np.repeat(np.arange(n_states, dtype=np.int64), degree) << 8 | np.asarray(self.label)
        self._target, self._before, self._final = (np.asarray(x) for x in (self.target, self.before, self.final))

    def find(self, word: bytes) -> bytes | None:
        """The word's ids as little-endian 32-bit integers, or None."""
        return self.find_many([word])[0]

    def find_many(self, words: list[bytes]) -> list[bytes | None]:
        """``find`` of many words at once: all walk a byte further each round."""
        out: list[bytes | None] = [None] * len(words)
        lengths = np.array([len(w) for w in words])
        text = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(lengths) - lengths
        alive = np.arange(len(words))
        state, index = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        depth = 0
        while len(alive):
            ended = lengths[alive] == depth
            for k in alive[ended & (self._final[state[alive]] > 0)]:
                out[k] = bytes(self.ids[4 * self.start[index[k]] : 4 * self.start[index[k] + 1]])
            alive = alive[~ended]
            if not len(alive) or not len(self._keys):
                break
            key = state[alive] << 8 | text[begin[alive] + depth]
            edge = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
            found = self._keys[edge] == key
            alive, edge = alive[found], edge[found]
            index[alive] += self._before[edge]
            state[alive] = self._target[edge]
            depth += 1
        return out


def compile_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """Builds the minimal automaton of the words incrementally in sorted order, and lays it out flat."""
    nodes: list[tuple[dict[int, int], bool]] = []  # registered states: edges, final
    register: dict[tuple, int] = {}
    path: list[tuple[dict[int, int], bool]] = [({}, False)]  # the states of the last word, not yet registered
    previous = b""

    def settle(keep: int) -> None:
        while len(path) > keep + 1:
            edges, final = path.pop()
            key = (final, tuple(edges.items()))
            if key not in register:
                register[key] = len(nodes)
                nodes.append((edges, final))
            path[-1][0][previous[len(path) - 1]] = register[key]

    ordered = sorted(words)
    for word in ordered:
        common = next((i for i, (a, b) in enumerate(zip(previous, word)) if a != b), min(len(previous), len(word)))
        settle(common)
        path.extend(({}, False) for _ in word[common:])
        path[-1] = (path[-1][0], True)
        previous = word
    settle(0)
    root = len(nodes)
    nodes.append(path[0])
    counts: list[int] = []  # words behind each state; children are registered before their parents
    for edges, final in nodes:
        counts.append(final + sum(counts[t] for t in edges.values()))
    order = [root, *(i for i in range(root))]  # the root is state 0
    place = {old: new for new, old in enumerate(order)}
    first, final, label, target, before = [0], [], [], [], []
    for old in order:
        edges, ends = nodes[old]
        seen = int(ends)
        for b in sorted(edges):
            label.append(b)
            target.append(place[edges[b]])
            before.append(seen)
            seen += counts[edges[b]]
        first.append(len(label))
        final.append(int(ends))
    start = np.concatenate(([0], np.cumsum([len(words[w]) for w in ordered], dtype=np.int64)))
    ids = [i for w in ordered for i in words[w]]
    head = struct.pack("<4I", len(order), len(label), len(ordered), len(ids))
    return head + b"".join(np.asarray(x, dtype="<u4").tobytes() for x in (first, final, label, target, before, start, ids))


def map_lexicon(block: bytes) -> Lexicon:
    """Memory-maps the block from a local file that is unlinked at once, so nothing stays behind."""
    with tempfile.TemporaryFile() as f:
        f.write(block)
        f.flush()
        return Lexicon(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))


class Encoder:
    """Encodes whole texts to ids packed as little-endian unsigned 32-bit integers, and decodes them."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None = None, memo: int = MEMO_ENTRIES):
        self.vocabulary, self.lexicon, self.memo = vocabulary, lexicon, memo
        self.pieces = regex.compile(PATTERN).findall
        self.words: dict[str, bytes] = {}  # ids of pre-tokens
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")") if vocabulary.special else None

    def learn(self, new: set[str], held: set[str]) -> None:
        """Puts pre-tokens into the memo: by the lexicon, or else by exact merging. ``held`` are all needed next."""
        if len(self.words) + len(new) > self.memo:
            self.words.clear()
            new = held
        new = list(new)
        raw = [w.encode("utf-8", "surrogatepass") for w in new]
        ids = self.lexicon.find_many(raw) if self.lexicon and raw else [None] * len(raw)
        rest = [k for k, found in enumerate(ids) if found is None and len(raw[k]) <= SHORT_WORD]
        for k, found in zip(rest, self.vocabulary.merge_many([raw[k] for k in rest]) if rest else ()):
            ids[k] = found
        for k, found in enumerate(ids):
            if found is None:
                long = self.vocabulary.merge(raw[k])
                ids[k] = struct.pack(f"<{len(long)}I", *long)
        self.words.update(zip(new, ids))

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Encodes texts together, in blocks of about a million characters."""
        out: list[bytes] = []
        block: list[str] = []
        size = 0
        for text in texts:
            block.append(text)
            size += len(text)
            if size > 1_000_000:
                out += self._encode_block(block)
                block, size = [], 0
        return out + self._encode_block(block)

    def _encode_block(self, texts: list[str]) -> list[bytes]:
        special, plans = self.vocabulary.special, []
        new: set[str] = set()
        held: set[str] = set()
        for text in texts:
            parts = self.specials.split(text) if special and any(s in text for s in special) else (text,)
            plan = [(struct.pack("<I", special[p]), ()) if p in special else (b"", self.pieces(p)) for p in parts]
            for _, pieces in plan:
                kinds = set(pieces)
                held |= kinds
                new |= kinds.difference(self.words)
            plans.append(plan)
        self.learn(new, held)
        get = self.words.__getitem__
        return [b"".join([fixed + b"".join(map(get, pieces)) for fixed, pieces in plan]) for plan in plans]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


class RankEncoder:
    """The same ids, where neither lexicon nor decoding is asked for: merging by rank in compiled code.

    Only for ``proper`` vocabularies; others, and texts with runs that compiled merging takes quadratic time for, go
    to the exact encoder whole.
    """

    def __init__(self, path: str, memo: int = MEMO_ENTRIES):
        self.exact = encoder(path, memo=memo)
        vocabulary = self.exact.vocabulary
        self.ranks = None
        if vocabulary.proper():
            ranks = {b: i for i, b in enumerate(vocabulary.bytes_of) if b and b.decode("utf-8", "replace") not in vocabulary.special}
            self.ranks = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids(self, text: str) -> list[int]:
        words = text.split()
        blanks = len(text) - sum(map(len, words)) - len(words)
        if self.ranks is None or blanks > LONG_RUN or max(map(len, words), default=0) > LONG_RUN:
            return np.frombuffer(self.exact.encode(text), "<u4").tolist()
        special = self.exact.vocabulary.special
        if not any(s in text for s in special):
            return self.ranks(text)
        parts = self.exact.specials.split(text)
        return [i for p in parts for i in ([special[p]] if p in special else self.ranks(p))]


_LOADED: dict[tuple[str, str, int], Encoder] = {}
_RANKED: dict[tuple[str, int], RankEncoder] = {}


def rank_encoder(path: str, memo: int = MEMO_ENTRIES) -> RankEncoder:
    """The worker's rank encoder for a vocabulary file; kept from task to task."""
    if (path, memo) not in _RANKED:
        _RANKED.clear()
        _RANKED[path, memo] = RankEncoder(path, memo)
    return _RANKED[path, memo]


def encoder(path: str, block: bytes | None = None, memo: int = MEMO_ENTRIES) -> Encoder:
    """The worker's encoder for a vocabulary file and a lexicon; kept from task to task."""
    key = (path, hashlib.sha1(block).hexdigest() if block else "", memo)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Encoder(Vocabulary(path), map_lexicon(block) if block else None, memo)
    return _LOADED[key]


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def frequent_words(df: DataFrame, text_col: str, size: int) -> list[str]:
    """The most frequent blank-separated words of all whole texts, ``size`` at most, in code-point order.

    Tasks count before anything is shuffled; the driver gets ``size`` words at most.
    """

    def factory():
        counts: Counter = Counter()

        def flush():
            rows = list(counts.items())
            counts.clear()
            return rows

        def kernel(text):
            counts.update((text or "").split(" "))
            return flush() if len(counts) > 150_000 else ()

        return kernel, flush

    out = flat_map(df, [text_col], "word string, n long", factory, 20_000)
    counts = stored(out.where(F.length("word").between(1, MEMO_LENGTH)).groupBy("word").agg(F.sum("n").alias("n")).where("n > 1"), "words")
    words = sorted(r["word"] for r in most_frequent(counts, "n", size).select("word").collect())
    drop(counts)
    return words


def build_lexicon(df: DataFrame, text_col: str, path: str, size: int = 20_000) -> bytes:
    """Compiles the corpus's most frequent words, with a blank before them as in running text, with their ids.

    ``size`` bounds the block (20,000 words take about 1 MB), so it can be broadcast whatever the corpus is.
    """
    coder, words = encoder(path), {}
    for w in frequent_words(df, text_col, size):
        for piece in coder.pieces(" " + w):
            raw = piece.encode("utf-8", "surrogatepass")
            words[raw] = coder.vocabulary.merge(raw)
    return compile_lexicon(words)


def bpe_round_trip(df: DataFrame, path: str, lexicon_size: int = 20_000, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Encodes every whole text and decodes the ids again: id, n_tokens, ids (packed), decoded.

    Null and empty texts have no tokens and decode to the empty text. Rows with equal or null ids each keep their
    row. Strings of special tokens in a text become the special ids, as the tokenizers library has it by default.
    With ``keep_ids=False`` the packed ids and the decoded text are replaced by their SHA-256 digests.
    """
    spark: SparkSession = df.sparkSession
    block = spark.sparkContext.broadcast(build_lexicon(df, text_col, path, lexicon_size))

    def factory():
        coder, sha = encoder(path, block.value), hashlib.sha256

        def kernel(keys, texts):
            for key, ids in zip(keys, coder.encode_many([t or "" for t in texts])):
                back = coder.decode(ids)
                if keep_ids:
                    yield key, len(ids) // 4, ids, back
                else:
                    yield key, len(ids) // 4, sha(ids).hexdigest(), sha(back.encode("utf-8", "surrogatepass")).hexdigest()

        return kernel

    kind = df.schema[id_col].dataType.simpleString()
    if keep_ids:
        return block_map(df, [id_col, text_col], f"{id_col} {kind}, n_tokens long, ids binary, decoded string", factory, 128)
    return block_map(df, [id_col, text_col], f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", factory)


def encoded_lengths(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The number of tokens of every whole text (0 for null or empty texts)."""

    def factory():
        coder = rank_encoder(path)
        return lambda keys, texts: zip(keys, (len(coder.ids(t or "")) for t in texts))

    return block_map(df, [id_col, text_col], f"{id_col} {df.schema[id_col].dataType.simpleString()}, n_tokens long", factory)


__all__ = ["Encoder", "Lexicon", "RankEncoder", "Vocabulary", "bpe_round_trip", "build_lexicon", "compile_lexicon", "encoded_lengths", "encoder", "frequent_words", "map_lexicon", "rank_encoder", "vocabulary_path"]
