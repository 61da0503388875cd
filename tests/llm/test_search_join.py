import random
import time

import numpy as np
import pyarrow as pa
import pytest

from heronry.llm import common, jaccard_join, pivot_topk

from .fixtures import DOCS, documents, odd_documents, prose


def brute_components(rows, p=85, q=100):
    """Components by id, over rows (id, text)."""
    nodes = []
    for key, text in rows:
        words = (text or "").encode().lower().split()
        nodes.append((key, {tuple(words[i : i + 4]) for i in range(len(words) - 3)} if len(words) > 3 else {tuple(words)} if words else set()))
    root = list(range(len(nodes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(nodes):
        for j in range(i):
            b = nodes[j][1]
            if a and b and q * len(a & b) >= p * len(a | b):
                root[find(i)] = find(j)
    low = {}
    for i, (key, _) in enumerate(nodes):
        if key is not None:
            low[find(i)] = min(low.get(find(i), key), key)
    return sorted((key if key is not None else -1, len(s), low.get(find(i), -1)) for i, (key, s) in enumerate(nodes))


def edited(text, n, seed):
    words = text.split()
    rng = random.Random(seed)
    for k in range(n):
        words[rng.randrange(len(words))] = f"edit{seed}x{k}"
    return " ".join(words)


def near_copies():
    texts = []
    for seed in range(6):
        base = " ".join(f"w{seed}_{(i * 31 + seed) % 97}" for i in range(40 + 60 * seed))
        texts += [base, base, *(edited(base, 1 + k % 4, 10 * seed + k) for k in range(12))]
    boiler = " ".join(f"license{i}" for i in range(60))
    texts += [boiler + " " + " ".join(f"own{k}_{i}" for i in range(20 + 5 * k)) for k in range(12)]
    texts += ["a b c", "A  b\tc", "a b", "one", "One", "é É", "É É"]
    return texts


def near_misses():
    """Many texts that share signatures; most are linked with few others, some with the first ones."""
    base = [f"w{i}" for i in range(300)]
    texts = []
    for seed in range(60):
        words = list(base)
        rng = random.Random(seed)
        for k in range(0 if seed < 15 else 12):
            words[rng.randrange(300)] = f"x{seed}_{k}"
        texts.append(" ".join(words[: 300 - seed % 7]))
    return texts


def joined(df, **options):
    rows = jaccard_join.jaccard_components(df, **options).collect()
    return sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_shingles"], r["component_id"] if r["component_id"] is not None else -1) for r in rows)


@pytest.mark.parametrize("tile", [512, 3])
def test_join_equals_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(jaccard_join, "TILE_SETS", tile)
    texts = near_copies() + near_misses()
    assert joined(documents(spark, texts)) == brute_components(list(enumerate(texts)))


def test_pairs_of_tiles_take_rounds_of_bounded_size(spark, monkeypatch):
    sent, links = [], jaccard_join.tile_links
    size = lambda rows: sum(len(jaccard_join.shingle_hashes(r["text"])) for r in rows.select("text").collect())
    monkeypatch.setattr(jaccard_join, "tile_links", lambda rows, *a: sent.append(size(rows)) or links(rows, *a))
    monkeypatch.setattr(jaccard_join, "TILE_SETS", 3)
    monkeypatch.setattr(jaccard_join, "ROUND_SHINGLES", 2_000, raising=False)
    texts = near_misses()
    assert joined(documents(spark, texts)) == brute_components(list(enumerate(texts)))
    every = sum(len(jaccard_join.shingle_hashes(t)) for t in set(texts))
    assert sum(sent) > 2 * every > 2 * max(sent)  # far more is compared than is on its way at once


def test_passage_in_common_makes_no_candidates(spark, monkeypatch):
    sent, links = [], jaccard_join.tile_links
    monkeypatch.setattr(jaccard_join, "tile_links", lambda rows, *a: sent.append(rows.count()) or links(rows, *a))
    own = lambda k: " ".join(f"own{k}_{i}" for i in range(120))
    texts = [" ".join(f"passage{k % 5}_{i}" for i in range(30)) + " " + own(k) for k in range(60)]
    assert joined(documents(spark, texts)) == brute_components(list(enumerate(texts)))
    assert sum(sent) == 0
    pair = [texts[0], edited(texts[0], 3, 1)]
    assert joined(documents(spark, texts + pair[1:])) == brute_components(list(enumerate(texts + pair[1:])))
    assert sum(sent) == 2


def test_join_with_signatures_of_large_groups(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "GROUP", 2)
    texts = near_copies() + near_misses()
    assert joined(documents(spark, texts)) == brute_components(list(enumerate(texts)))


def test_rows_of_one_signature_are_paired_across_batches(monkeypatch):
    monkeypatch.setattr(jaccard_join, "GROUP", 3)
    sigs, rows = [1, 2, 2, 2, 3, 4, 4, 4, 4, 4, 5, 5], list(range(12))
    expected = sorted([(1, 2, False), (1, 3, False), (2, 3, False), *((5, k, True) for k in range(6, 10)), (10, 11, False)])
    for size in range(1, 13):
        batches = [pa.record_batch([pa.array(sigs[i : i + size]), pa.array(rows[i : i + size])], names=["sig", "row"]) for i in range(0, 12, size)]
        assert sorted(tuple(r.values()) for b in jaccard_join.together(batches) for r in b.to_pylist()) == expected


def test_sets_of_a_block_are_those_of_each_text(monkeypatch):
    rng = random.Random(5)
    texts = [None, "", " ", "a", "A b\x0bc", "\x00 a\x00 b\x85c d", "x" * 256, "x" * 257 + " y", *("".join(rng.choice("ab \n\x00é\U0001f600") for _ in range(rng.randrange(300))) for _ in range(200))]
    shingles = lambda w: {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set()
    plain = [shingles((t or "").encode().lower().split()) for t in texts]
    for block in (1, 100, 1 << 18):
        monkeypatch.setattr(jaccard_join, "BLOCK", block)
        for column in (pa.array(texts), pa.array(["z z", *texts], pa.large_string()).slice(1)):
            sets = [flat[a:b].tolist() for _, _, flat, cuts in jaccard_join._blocks(column, 4) for a, b in zip(cuts, cuts[1:])]
            assert sets == [jaccard_join.shingle_hashes(t).tolist() for t in texts]
            assert [len(x) for x in sets] == [len(x) for x in plain]
            assert len(set(map(tuple, sets))) == len(set(map(frozenset, plain)))


def test_words_are_hashed_at_about_the_speed_of_splitting():
    text = " ".join(f"w{i:x}" for i in range(1_000_000))
    best = lambda f: min((f(), time.perf_counter() - began)[1] for _ in range(3) for began in [time.perf_counter()])
    assert best(lambda: jaccard_join.shingle_hashes(text)) < 5 * best(lambda: text.encode().lower().split())


def test_join_of_odd_documents(spark):
    df = odd_documents(spark)
    assert joined(df) == brute_components([(r["doc_id"], r["text"]) for r in df.collect()])
    assert jaccard_join.jaccard_components(df.limit(0)).count() == 0
    kept = jaccard_join.one_of_each(df).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == [0, 1, 2, 3, 4, 5, 6, 7]
    assert jaccard_join.one_of_each(df).columns == df.columns


def test_one_of_each_decides_by_row(spark):
    prose = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    alone = [(None, prose(i, 30 + i)) for i in range(20, 25)] + [(7, prose(31, 40)), (7, prose(32, 50))]
    linked = [(1, prose(2, 45)), (3, prose(2, 45)), (3, prose(33, 35)), (None, prose(2, 45)), (3, prose(33, 35))]
    bare = [(9, ""), (9, ""), (9, " \n"), (10, None), (None, "\t")]
    df = spark.createDataFrame([(i, t, 1) for i, t in alone + linked + bare], "doc_id long, text string, n int")
    expected = [*alone, (1, prose(2, 45)), (3, prose(33, 35)), (9, ""), (9, " \n"), (10, None), (None, "\t")]
    got = [(r["doc_id"], r["text"]) for r in jaccard_join.one_of_each(df).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, expected))


def test_sets_without_enough_fragments_are_compared_in_full(spark, monkeypatch):
    whole = jaccard_join.signatures
    monkeypatch.setattr(jaccard_join, "signatures", lambda h, f, p, q: None if len(h) < 40 else whole(h, f, p, q))
    texts = near_copies()[:14]
    assert joined(documents(spark, texts)) == brute_components(list(enumerate(texts)))


def test_no_link_escapes_the_signatures():
    rng = np.random.default_rng(4)
    for n in [1, 2, 3, 5, 7, 8, 13, 16, 31, 60, 200, 700]:
        for _ in range(30):
            base = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            most = jaccard_join.most_differences(len(base), len(base) * 100 // 85, 85, 100)
            gone = rng.integers(0, most + 1)
            gone = min(gone, len(base) - 1)
            other = np.unique(np.concatenate((base[gone:], rng.integers(0, 2**63, rng.integers(0, most - gone + 1) if most > gone else 0).astype(np.uint64))))
            common = len(np.intersect1d(base, other))
            if 100 * common < 85 * (len(base) + len(other) - common):
                continue
            often = np.sort(rng.choice(base, len(base) // 3, replace=False))
            for frequent in (np.zeros(0, np.uint64), often):
                a, b = (jaccard_join.signatures(x, frequent, 85, 100) for x in (base, other))
                if a is not None and b is not None:
                    assert np.intersect1d(a, b).size


def test_partial_overlaps_sum_to_intersections(monkeypatch):
    monkeypatch.setattr(jaccard_join, "COARSE", 7)
    rng = np.random.default_rng(1)
    left, right = ([np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64)) for _ in range(k)] for k in (9, 5))
    expected = [[len(np.intersect1d(a, b)) for b in right] for a in left]
    assert jaccard_join.overlaps(left, right).tolist() == expected


def test_fragments_are_dealt_and_their_counts_summed(spark, monkeypatch):
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 2**64, 80, dtype=np.uint64)) for _ in range(3)]
    sets.append(np.unique(np.concatenate((sets[0][:70], sets[1][:3]))))
    frequent = sets[0][::5]
    parts = [dict(jaccard_join.cut(s, frequent)) for s in sets]
    assert set(parts[0]) == set(range(jaccard_join.FRAGMENTS + 1))
    total = {}
    for f in range(jaccard_join.FRAGMENTS + 1):
        here = [(k, len(sets[k]), p[f]) for k, p in enumerate(parts) if f in p]
        for a, b, n, need in jaccard_join.partial_counts(here, None, 10, 100).tolist():
            total[a, b] = total.get((a, b), 0) + n
            assert need == -(-10 * (len(sets[a]) + len(sets[b])) // 110)
    assert total[0, 3] == len(np.intersect1d(sets[0], sets[3]))


def test_hot_signatures_and_classes(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HOT_FROM", 3)
    texts = near_copies() + near_copies()[:20] * 4
    assert joined(documents(spark, texts)) == brute_components(list(enumerate(texts)))


def test_repeated_and_null_ids_with_other_texts(spark):
    texts = near_copies()
    rows = [(None if i % 3 == 0 else i % 5, t) for i, t in enumerate(texts)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert joined(df) == brute_components(rows)


def test_one_of_each_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(i, prose(i % 3, 40), 77 + i, "a", i, True) for i in range(6)], "doc_id long, text string, _bucket int, t string, _t int, kept boolean")
    kept = jaccard_join.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(tuple(r) for r in kept.collect()) == [(i, prose(i, 40), 77 + i, "a", i, True) for i in range(3)]
    assert jaccard_join.one_of_each(df.limit(0)).count() == 0


def test_components_of_chains_and_hubs(spark):
    edges = [(f"{i:04d}", f"{i + 1:04d}") for i in range(1, 60)] + [("a", f"b{i}") for i in range(50)]
    found = {(r["node"], r["component"]) for r in jaccard_join.connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert found == {(f"{i:04d}", "0001") for i in range(2, 61)} | {(f"b{i}", "a") for i in range(50)}


VECTORS = "vec_id long, embedding array<float>, label int, rank int, score string, dim int, far double"


def brute_topk(rows, k, every):
    """Each row is a query and a candidate of its own."""
    usable = [(i, [int(np.floor(256.0 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for at, (qi, q) in enumerate(usable):
        if qi % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v)), i) for j, (i, v) in enumerate(usable) if j != at and len(v) == len(q))[:k]
            out += [(qi, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


def found_topk(spark, rows, every):
    df = spark.createDataFrame([(i, v, 0, 1, "x", 5, 0.5) for i, v in rows], VECTORS)
    return sorted(tuple(r) for r in pivot_topk.top_k(df, every=every).select("query_id", "rank", "vec_id", "score").collect())


@pytest.mark.parametrize("block", [4096, 13])
def test_topk_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(pivot_topk, "CANDIDATE_BLOCK", block)
    monkeypatch.setattr(pivot_topk, "QUERY_BLOCK", block)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(120)]
    rows += [(200 + i, rows[3][1]) for i in range(10)]  # copies: ties go to smaller ids
    rows += [(300, None), (301, [1.0, None] + [0.0] * 6), (302, [float("nan")] * 8), (303, [float("inf")] * 8), (None, [1.0] * 8), (310, [1.0, 2.0]), (320, [2.0, 1.0]), (330, []), (340, [0.0] * 8), (350, [])]
    assert found_topk(spark, rows, 10) == brute_topk(rows, 5, 10)
    df = spark.createDataFrame([], VECTORS)
    assert pivot_topk.top_k(df).count() == 0


def test_topk_of_repeated_ids_and_a_hot_vector(spark, monkeypatch):
    monkeypatch.setattr(pivot_topk, "CANDIDATE_BLOCK", 20)
    monkeypatch.setattr(pivot_topk, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    rows = [(i % 70, (centres[i % 6] + rng.normal(size=8) / 50).astype(np.float32).tolist()) for i in range(140)]
    rows += [(10, rows[0][1])] * 40 + [(0, rows[1][1]), (0, rows[1][1]), (500, rows[1][1])]
    assert found_topk(spark, rows, 10) == brute_topk(rows, 5, 10)


def test_topk_of_large_numbers(spark):
    rows = [(i, [3e5 * (i + 1), -2e5 * i, 1.0 + i]) for i in range(25)] + [(50, [1e3, 2.0, 3.0])]
    assert found_topk(spark, rows, 5) == brute_topk(rows, 5, 5)


def clusters(n=4000):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16)) * 400
    return np.floor(centres[rng.integers(0, 20, n)] + rng.normal(size=(n, 16)) * 8)


def test_elimination_stops_early_and_is_exact():
    data = clusters()
    pivots = pivot_topk.far_apart(data[:960], 48)
    table = pivot_topk.distances(data, pivots)
    asked = np.arange(0, 4000, 100)
    found, n = pivot_topk.search_block(data[asked], table[asked], asked, np.full(len(asked), -np.inf), np.arange(4000), data, table, 5)
    for q, best in zip(asked, found):
        scores = data @ data[q]
        assert [i for i, _ in best] == [int(i) for i in np.lexsort((np.arange(4000), -scores)) if i != q][:5]
    assert n < 0.2 * len(asked) * 4000  # most candidates are never evaluated


def test_whole_clusters_are_out_of_reach():
    data = clusters()
    pivots = pivot_topk.far_apart(data[:960], 20)
    table = pivot_topk.distances(data, pivots)
    cell = table.argmin(axis=1)
    wide = np.column_stack((table, (data * data).sum(axis=1)))
    cells = sorted(set(cell.tolist()))
    low, high = (np.array([f(wide[cell == c], axis=0) for c in cells]) for f in (np.min, np.max))
    visited = 0
    for q in range(0, 4000, 200):
        scores = data @ data[q]
        kth = np.sort(scores[cell == cell[q]])[-6]
        may = pivot_topk.reachable(data[q], table[q], kth, low, high)
        best = [i for i in np.lexsort((np.arange(4000), -scores)) if i != q][:5]
        assert all(may[cells.index(cell[i])] for i in best)
        visited += may.sum()
    assert visited < 0.5 * 20 * len(cells)


def test_schema_of_documents_is_not_needed(spark):
    df = spark.createDataFrame([(1, prose(1, 20))], "doc_id long, text string")
    assert jaccard_join.jaccard_components(df).columns == ["doc_id", "n_shingles", "component_id"]
    assert DOCS


def test_shuffle_files_go_once_a_table_is_stored(spark):
    def shuffled():
        blocks = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllBlocks()
        return {n for i in range(blocks.size()) if (n := blocks.apply(i).name()).startswith("shuffle_")}

    before = shuffled()
    common.stored(spark.range(1000).repartition(3, "id"), "shuffled")
    until = time.time() + 20
    while not shuffled() <= before and time.time() < until:
        time.sleep(0.2)
    assert shuffled() <= before
    assert spark.conf.get(common.CLEANUP) == "false"
