import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from heronry.llm import bpe, packing, token_counts

from .fixtures import documents, odd_documents

PATH = bpe.vocabulary_path()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_lexicon_maps_words_to_ids_and_shares_suffixes():
    words = {w.encode(): [i, 2 * i] for i, w in enumerate(["talking", "walking", "walk", "talk", "stalking", "é"])}
    block = bpe.compile_lexicon(words)
    lexicon = bpe.map_lexicon(block)
    found = lexicon.find_many([*words, b"wal", b"walkin", b"zz", b"talkings"])
    assert [ids(x) for x in found[:6]] == list(words.values())
    assert found[6:] == [None] * 4
    assert len(lexicon.label) < sum(map(len, words))
    assert bpe.map_lexicon(bpe.compile_lexicon({})).find(b"a") is None


@pytest.mark.parametrize("with_lexicon", [False, True])
def test_encoding_equals_the_library(library, with_lexicon):
    vocabulary = bpe.Vocabulary(PATH)
    block = bpe.compile_lexicon({w.encode(): vocabulary.merge(w.encode()) for w in (" the", " quick", " a", "'s", "\n")})
    coder = bpe.Encoder(vocabulary, bpe.map_lexicon(block) if with_lexicon else None)
    random.seed(3)
    alphabet = "ab c  \n\t'sdtm re12½²é漢😀\x1c\x85\xa0.,! \r<|endoftext|>"
    texts = ["".join(random.choice(alphabet) for _ in range(random.randint(0, 40))) + "<|endoftext|>" * (k % 7 == 0) for k in range(2000)]
    texts += ["", " ", "a" * 3000, "the quick " * 500]
    for text, packed in zip(texts, coder.encode_many(texts)):
        expected = library.encode(text, add_special_tokens=False).ids
        assert ids(packed) == expected
        assert coder.decode(packed) == library.decode(expected, skip_special_tokens=False)


def test_rank_merging_equals_the_library_and_needs_a_proper_vocabulary(library):
    coder = bpe.rank_encoder(PATH)
    assert coder.ranks is not None
    random.seed(4)
    alphabet = "ab c  \n\t'sdtm re12½²é漢😀\x1c\x85\xa0.,! \r\u3000"
    texts = ["".join(random.choice(alphabet) for _ in range(random.randint(0, 60))) + "<|endoftext|>x" * (k % 7 == 0) for k in range(3000)]
    texts += ["".join(chr(random.choice((random.randrange(1, 0xD800), random.randrange(0xE000, 0x110000)))) for _ in range(50)) for _ in range(300)]
    texts += ["", " ", " " * 9000, "a" * 30_000, "ab" * 999 + " x", "\x1c" * 9000, "<|endoftext|>" * 3, "the quick " * 500]
    for text in texts:
        assert coder.ids(text) == library.encode(text, add_special_tokens=False).ids
    twisted = bpe.Vocabulary(PATH)
    (a, b), (rank, new) = next(iter(twisted.merges.items()))
    twisted.bytes_of[new] = b"never merged to"
    assert not twisted.proper()


def test_memo_starts_anew_without_changing_results(library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_ENTRIES", 5)
    coder = bpe.Encoder(bpe.Vocabulary(PATH))
    for text in ("one two three four five six seven", "eight nine one two"):
        assert ids(coder.encode(text)) == library.encode(text, add_special_tokens=False).ids


def test_round_trip_of_odd_documents(spark, library):
    df = odd_documents(spark)
    rows = bpe.bpe_round_trip(df, PATH, lexicon_size=50).collect()
    texts = sorted((r["doc_id"], r["text"] or "") for r in df.collect() if r["doc_id"] is not None)
    assert len(rows) == df.count()
    got = sorted((r["doc_id"], r["decoded"]) for r in rows if r["doc_id"] is not None)
    assert got == texts
    digests = {r["doc_id"]: r for r in bpe.bpe_round_trip(df, PATH, lexicon_size=50, keep_ids=False).collect()}
    for r in rows:
        assert ids(r["ids"]) == library.encode(r["decoded"], add_special_tokens=False).ids
        if r["doc_id"] in (0, 5, 7):
            assert digests[r["doc_id"]]["ids_sha256"] == hashlib.sha256(r["ids"]).hexdigest()
    assert bpe.bpe_round_trip(df.limit(0), PATH).count() == 0


def test_token_counts_against_brute_force(spark, library):
    df = odd_documents(spark)
    lengths = [len(library.encode(r["text"] or "", add_special_tokens=False).ids) for r in df.collect()]
    rows = {r["context_limit"]: r for r in token_counts.token_counts(df, PATH).collect()}
    assert sorted(rows) == sorted(set(lengths))
    for limit, r in rows.items():
        assert r["n_docs"] == lengths.count(limit)
        assert r["docs_within"] == sum(n <= limit for n in lengths)
        assert r["docs_over"] == sum(n > limit for n in lengths)
        assert r["total_tokens"] == sum(lengths)
        assert r["tokens_kept"] == sum(min(n, limit) for n in lengths)
        assert r["tokens_lost"] == sum(lengths) - r["tokens_kept"]
        assert r["quantile"] == pytest.approx(r["docs_within"] / len(lengths))
    assert token_counts.token_counts(df.limit(0), PATH).count() == 0


def packed_counts(patterns):
    out = {}
    for pattern, n in patterns:
        for x in pattern:
            out[x] = out.get(x, 0) + n
    return out


def test_bin_completion_is_whole_and_optimal_on_small_inputs():
    random.seed(5)

    def fewest(items, capacity):
        best = [len(items)]

        def place(i, rooms):
            if len(rooms) >= best[0]:
                return
            if i == len(items):
                best[0] = len(rooms)
                return
            for k in range(len(rooms)):
                if rooms[k] >= items[i]:
                    rooms[k] -= items[i]
                    place(i + 1, rooms)
                    rooms[k] += items[i]
            place(i + 1, [*rooms, capacity - items[i]])

        place(0, [])
        return best[0]

    exact = 0
    for _ in range(60):
        items = sorted((random.randint(1, 20) for _ in range(random.randint(1, 9))), reverse=True)
        counts = {n: items.count(n) for n in items}
        patterns, proven = packing.bin_completion(counts, 20)
        assert packed_counts(patterns) == counts and all(sum(p) <= 20 for p, _ in patterns)
        size = sum(n for _, n in patterns)
        assert packing.lower_bound(counts, 20) <= fewest(items, 20) <= size <= sum(n for _, n in packing.best_fit_decreasing(counts, 20))
        exact += size == fewest(items, 20)
        assert not proven or size == fewest(items, 20)
    assert exact >= 58


def test_bin_completion_tries_all_undominated_fillings():
    counts = dict.fromkeys((512, 502, 460, 419, 409, 307, 205, 155, 103), 1)
    assert sum(n for _, n in packing.best_fit_decreasing(counts, 1024)) == 4
    patterns, proven = packing.bin_completion(counts, 1024)
    assert proven and sum(n for _, n in patterns) == 3 and packed_counts(patterns) == counts
    assert sorted(f for f in packing.fillings(512, counts | {512: 0}, 0) if f) == [(307, 205), (409, 103)]
    twice = {n: 2 * c for n, c in counts.items()}
    assert sum(n for _, n in packing.bin_completion(twice, 1024)[0]) == 6


def test_any_limit_and_quantile_is_answered(spark):
    lengths = [3, 3, 5, 8, 13, 700, 2000]
    df = token_counts.length_histogram(spark.createDataFrame([(n,) for n in lengths], "n_tokens long"))
    limits = [0, 1, 3, 4, 512, 1024, 5000]
    got = sorted(map(tuple, token_counts.at_limits(df, limits).collect()))
    assert got == [(x, sum(n <= x for n in lengths), sum(n > x for n in lengths), sum(min(n, x) for n in lengths), sum(max(0, n - x) for n in lengths)) for x in limits]
    assert sorted(map(tuple, token_counts.at_quantiles(df, [0.0, 0.25, 0.5, 1.0]).collect())) == [(0.0, 3), (0.25, 3), (0.5, 8), (1.0, 2000)]


def test_packing_places_every_token_once(spark, library):
    import zlib

    df = odd_documents(spark)
    rows = packing.pack(df, PATH, capacity=64, salts=3).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in df.collect()}
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append(r)
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    for doc in (0, 2, 3, 6, 7):
        whole = [*library.encode(texts[doc], add_special_tokens=False).ids, 2]
        pieces = sorted(by_doc[doc], key=lambda r: r["piece"])
        assert sum(r["length"] for r in pieces) == len(whole)
        assert all(r["length"] == 64 for r in pieces[1:])
        for r in pieces:
            raw = np.array(whole[r["start"] : r["start"] + r["length"]], "<u4").tobytes()
            assert zlib.crc32(raw) == r["ids_crc32"]
    total = sum(r["length"] for r in rows)
    assert len(by_sequence) <= -(-total // 64) + 1
    assert packing.pack(documents(spark, []), PATH).count() == 0
