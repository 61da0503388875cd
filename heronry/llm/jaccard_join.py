"""N-gram Jaccard join by vertical partitioning.

The global n-gram order has frequent n-grams last, and is by 64-bit hash otherwise. It is cut into fragments twice: into
fine ones to find candidates, and into FRAGMENTS + 1 wide ones to count overlaps. Which n-grams count as frequent only
decides speed.

Candidates. Sets of a and b n-grams with a Jaccard similarity of p/q or more differ in at most
(q - p)(a + b) / (q + p) n-grams. A set of n n-grams therefore shares with any partner at least one whole non-empty
fine fragment among its first F(n) non-empty ones, F(n) being one more than the most differences that a partner of any
admissible size may have: every fragment that differs costs a difference. Each set emits a signature of each of
those fragments and a few more, so that linked sets share at least the fewer of their signatures less the differences.
Pairs that share a signature of few sets are counted, and those that share too few, or whose sizes do not match, are no
candidates: a passage in common does not make them one blob, however many documents there are. Signatures of more than
GROUP sets join all of them. The number of fragments is that of a size class (sizes up to twice the least); sets that may have
partners in the next class emit there too. No link can be missed, and as frequent n-grams lie in fragments of their
own at the end, passages common to many documents do not make them candidates.

Blobs. Equal sets form one class, so copies are never expanded. Classes that share a signature, directly or by way
of others, form a blob: every link lies within one. Blobs are dealt into tiles of bounded size, by length.

Partial counts. Each set of a tile is cut along the global order, and each wide fragment of a pair of tiles goes to a
task of its own, which counts the overlaps of all its pairs there. Pairs whose lengths do not match, or that already
differ too much in one fragment, are dropped. The partial counts, packed by pair of tiles, are shuffled once more and
summed per pair; of the links found only a spanning forest leaves that task.

Large blobs. First each tile is compared with itself and with the first one of its length; then only tiles that are not
yet of one component, large components apart. A large group of near copies thus costs in proportion to its size;
only sets that share signatures without being linked are all compared, tile by tile.

Rounds. How often a set is compared depends on its blob, so pairs of tiles whose n-grams exceed a share of those of all
sets take several rounds, and the shuffle files of a round are deleted before the next. Disk is in proportion to the
input, whatever the pairs are; all pairs are compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronry.llm.common import drop, most_frequent, new_name, released, stored

#: Wide fragments of the order in which overlaps are counted (a power of two; frequent n-grams have one more), columns
#: of a product of incidence matrices, and buckets of the bounded prefilter of candidates.
FRAGMENTS, COARSE, BUCKETS = 4, 4096, 1 << 20
#: What a tile holds on average: sets, and n-grams (one set may have more).
TILE_SETS, TILE_SHINGLES = 1024, 400_000
#: Signatures in a batch of output, bytes of texts hashed together (one text may have more), and bytes of a word from
#: which it is hashed by itself.
BATCH, BLOCK, LONG = 400_000, 1 << 18, 256
#: Frequent n-grams at most (they are broadcast), the documents that make one frequent, n-grams of a task counted
#: together, and repeats among those that are reported.
FREQUENT, FREQUENT_FROM, COUNTED, REPEATS = 100_000, 16, 1_000_000, 3
#: Signatures, or classes of equal sets, that are joined by broadcast as hot ones: at most so many, of at least so many rows.
HOT, HOT_FROM = 10_000, 256
#: Sets of one signature that are paired with each other; those of larger groups with one. Signatures beyond the F(n)
#: that are needed: this part of them, and two.
GROUP, SPARE = 32, 10
#: N-grams that may be on their way to their tasks at once: this part of those of all sets, and so many at least.
ROUND_PART, ROUND_SHINGLES = 4, 20_000_000
_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)
#: The first 0 to 8 bytes of eight.
_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the words ``low[start:end]``, all words at once by eight bytes at a time; ``low`` goes on for 8 bytes."""
    size = ends - starts
    eight = np.ndarray(len(low) - 7, "<u8", low, strides=(1,))
    with np.errstate(over="ignore"):
        h = _mix(_mix(eight[starts] & _BYTES[np.minimum(size, 8)]) + size.astype(np.uint64) * _ODD)
        more = np.flatnonzero(size > 8)
        for at in range(8, LONG, 8):
            if not len(more):
                break
            h[more] = _mix(h[more] * _ODD + (eight[starts[more] + at] & _BYTES[np.minimum(size[more] - at, 8)]))
            more = more[size[more] > at + 8]
    for k in more.tolist():
        h[k] = xxhash.xxh3_64_intdigest(low[starts[k] : ends[k]])
    return h


def _windows(h: np.ndarray, width: int) -> np.ndarray:
    out = np.full(len(h) - width + 1, width, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = _mix(out * _ODD + h[k : len(h) - width + 1 + k])
    return out


def block_sets(data: bytes | memoryview, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sets of hashed shingles of the texts ``data[bounds[k]:bounds[k + 1]]``, ascending: one after the other, and where
    they begin and end.

    ASCII letters are lower-cased and words end at ASCII white space. Fewer words than ``width`` make one shingle of
    them all; no words make an empty set.
    """
    n = len(data)
    low = np.frombuffer(bytes(data).lower() + bytes(8), np.uint8)
    inside = np.zeros(n + 2, bool)
    np.logical_not((low[:n] == 32) | (low[:n] - np.uint8(9) < 5), out=inside[1:-1])
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    starts = np.flatnonzero(inside[1:] & (edge | ~inside[:-1]))
    h = _word_hashes(low, starts, np.flatnonzero(inside[:-1] & (edge | ~inside[1:])))
    first = np.searchsorted(starts, bounds)
    words = np.diff(first)
    sizes = np.where(words < width, np.minimum(words, 1), words - width + 1)
    at = np.concatenate(([0], np.cumsum(sizes)))
    flat = np.empty(at[-1], np.uint64)
    windows = _windows(h, width) if len(h) >= width else h[:0]
    for lo, hi, k, m in zip(at[:-1].tolist(), at[1:].tolist(), first.tolist(), words.tolist()):
        if m >= width:
            flat[lo:hi] = windows[k : k + hi - lo]
            flat[lo:hi].sort()
        elif m:
            flat[lo] = _windows(h[k : k + m], m)[0]
    new = np.ones(len(flat), bool)
    np.not_equal(flat[1:], flat[:-1], out=new[1:])
    new[at[:-1][sizes > 0]] = True
    return flat[new], np.concatenate(([0], np.cumsum(new)))[at]


def _blocks(texts: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """From which to which of the texts, their sets and where these begin and end; null counts as empty."""
    if not len(texts):
        return
    texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, places, data = texts.buffers()
    places = np.frombuffer(places, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = memoryview(data or b"")
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(places, places[lo] + BLOCK, "right")) - 1)
        yield lo, hi, *block_sets(data[places[lo] : places[hi]], places[lo : hi + 1] - places[lo], width)
        lo = hi


def shingle_hashes(text: str | None, width: int = 4) -> np.ndarray:
    """The set of hashed shingles of a text, as ``block_sets`` makes them."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return block_sets(data, np.array([0, len(data)]), width)[0]


def most_differences(a: int, b: int, p: int, q: int) -> int:
    """The most n-grams in which sets of these sizes may differ at a similarity of p/q."""
    return (q - p) * (a + b) // (q + p)


def signatures(hashes: np.ndarray, frequent: np.ndarray, p: int, q: int) -> np.ndarray | None:
    """Signatures of the leading non-empty fragments, for each size class in question.

    None if a class has too few non-empty fragments for the guarantee (then the set must be compared with all of
    admissible size).
    """
    n = len(hashes)
    need = most_differences(n, n * q // p, p, q) + 1
    found = []
    if len(frequent):
        last = frequent[np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)] == hashes
        hashes = np.concatenate((hashes[~last], hashes[last]))
        last = np.concatenate((last[~last], last[last]))
    else:
        last = np.zeros(n, bool)
    with np.errstate(over="ignore"):
        for k in _levels(n, p, q):
            top = (2 << k) - 1
            cuts = (most_differences(top, top * q // p, p, q) + 1) * 11 // 10 + 4
            place = ((hashes >> _U(32)) * _U(cuts) >> _U(32)) + _U(cuts) * last  # ascending: fragments are ranges of the order
            starts = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
            if len(starts) < need:
                return None
            found.append((k, place, starts))
        take = min(need + need // SPARE + 2, *(len(starts) for *_, starts in found))
        own = _mix(hashes)
        return np.concatenate([_mix(np.add.reduceat(own, starts)[:take] + _mix(place[starts[:take]] * _U(64) + _U(k))) for k, place, starts in found])


def _levels(n: int, p: int, q: int) -> tuple[int, ...]:
    """The size classes in which a set of n n-grams has partners: sizes from 2**level."""
    level = n.bit_length() - 1
    return (level, level + 1) if n * q // p >= 2 << level else (level,)


def _classes(flat: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """96 bits that stand for each whole set, as 64 and 31 of them."""
    sizes = np.diff(cuts)
    some = np.flatnonzero(sizes)
    a, b = np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.uint64)
    with np.errstate(over="ignore"):
        if len(some):
            a[some] = np.add.reduceat(_mix(flat + _U(1)), cuts[some])
            b[some] = np.bitwise_xor.reduceat(_mix(flat ^ _U(0xA0761D6478BD642F)), cuts[some])
        return a ^ sizes.astype(np.uint64) * _ODD, b & _U(0x7FFFFFFF)


def _repeated(arrays: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """h, n: the values met REPEATS times or more among COUNTED of a task."""
    held: list[np.ndarray] = []
    size = 0

    def report():
        values = np.sort(np.concatenate(held))
        starts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
        values, n = values[starts], np.diff(starts, append=len(values))
        often = n >= REPEATS
        return pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(n[often].astype(np.int64))], names=["h", "n"])

    for values in arrays:
        held.append(values)
        size += len(values)
        if size >= COUNTED:
            yield report()
            held, size = [], 0
    if size:
        yield report()


def frequent_shingles(df: DataFrame, text_col: str, width: int) -> np.ndarray:
    """Hashes of the most frequent shingles, FREQUENT at most, ascending; all whole texts are counted.

    Each task counts blocks of COUNTED shingles and reports those repeated in a block. Shingles spread thinly over
    blocks are undercounted, which only moves them in the order.
    """

    @released
    def task(batches):
        yield from _repeated(flat for batch in batches for _, _, flat, _ in _blocks(batch.column(0), width))

    counts = df.select(text_col).mapInArrow(task, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    often = stored(counts.where(F.col("n") >= FREQUENT_FROM), "frequent")
    top = most_frequent(often, "n", FREQUENT).select("h").toArrow()
    drop(often)
    return np.sort(top.column("h").to_numpy().astype(np.int64).view(np.uint64))


def _signed(df: DataFrame, id_col: str, text_col: str, often, p: int, q: int, width: int) -> DataFrame:
    """doc_id, t (a hash of the text), n, c1, c2 (the class), sigs, leading, weak: signatures only once a class and task.

    leading: how many fragments have signatures in each size class.
    """
    schema = f"doc_id {df.schema[id_col].dataType.simpleString()}, t long, n_shingles long, c1 long, c2 int, sigs array<long>, leading int, weak boolean"

    @released
    def task(batches):
        frequent = often.value
        seen: set[tuple[int, int]] = set()
        rows: list[tuple] = []
        held = 0
        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for lo, hi, flat, cuts in _blocks(batch.column(1), width):
                keys, hashes = (batch.column(c).slice(lo, hi - lo).to_pylist() for c in (0, 2))
                for key, t, start, end, c1, c2 in zip(keys, hashes, cuts.tolist(), cuts[1:].tolist(), *(c.tolist() for c in _classes(flat, cuts))):
                    sigs, weak = None, False
                    if start < end and (c1, c2) not in seen:
                        sigs = signatures(flat[start:end], frequent, p, q)
                        weak = sigs is None
                        if len(seen) >= 200_000:
                            seen.clear()
                        seen.add((c1, c2))
                    rows.append((key, t, end - start, c1, c2, sigs, weak))
                    held += len(sigs) if sigs is not None else 1
                    if held > BATCH:
                        yield pack(rows, id_type)
                        rows, held = [], 0
        if rows:
            yield pack(rows, id_type)

    def pack(rows, id_type):
        keys, t, n, c1, c2, sigs, weak = zip(*rows)
        sizes = np.array([0 if s is None else len(s) for s in sigs])
        leading = [size and size // len(_levels(k, p, q)) for k, size in zip(n, sizes.tolist())]
        flat = np.concatenate([s for s in sigs if s is not None] or [np.zeros(0, np.uint64)]).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(flat))
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, id_type), pa.array(t, pa.int64()), pa.array(n, pa.int64()), pa.array(np.array(c1, np.uint64).view(np.int64)), pa.array(c2, pa.int32()), lists, pa.array(leading, pa.int32()), pa.array(weak)],
            names=["doc_id", "t", "n_shingles", "c1", "c2", "sigs", "leading", "weak"],
        )

    return df.select(id_col, text_col, _text_hash(text_col)).mapInArrow(task, schema)


def _text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")), F.col(text_col).isNull())


def _id_hash(id_col: str) -> Column:
    """A key that joins null ids too, by the partitioning that an aggregation by it has."""
    return F.xxhash64(F.col(id_col), F.col(id_col).isNull())


def together(batches) -> Iterator[pa.RecordBatch]:
    """a, b, star: from rows (sig, row) ordered by sig, the pairs of rows in each group of GROUP or less; for larger
    groups each row with the first (star)."""
    sigs, rows, large = np.zeros(0, np.int64), np.zeros(0, np.int64), None  # of the last group, which may go on
    for batch in chain(batches, [None]):
        if batch is not None:
            sigs = np.concatenate((sigs, batch.column(0).to_numpy(zero_copy_only=False)))
            rows = np.concatenate((rows, batch.column(1).to_numpy(zero_copy_only=False)))
        if not len(sigs):
            continue
        starts = np.flatnonzero(np.concatenate(([True], sigs[1:] != sigs[:-1])))
        sizes = np.diff(starts, append=len(sigs))
        open_from = len(sigs) if batch is None else int(starts[-1])
        if len(sigs) - open_from > GROUP:  # its rows meet the first one now
            open_from = len(sigs)
        else:
            starts, sizes = starts[starts < open_from], sizes[starts < open_from]
        if len(starts):
            many = sizes > GROUP
            many[0] |= sigs[0] == large
            star, first = np.repeat(many, sizes), np.repeat(rows[starts], sizes)
            some = np.flatnonzero(np.repeat(sizes > 1, sizes))
            hub = some[star[some]]
            pairs = [(first[hub], rows[hub], np.ones(len(hub), bool))]
            few = some[~star[some]]
            for d in range(1, int(sizes[~many].max(initial=1))):
                x, y = few[:-d], few[d:]
                same = sigs[x] == sigs[y]
                pairs.append((rows[x[same]], rows[y[same]], np.zeros(int(same.sum()), bool)))
            a, b, kind = (np.concatenate(c) for c in zip(*pairs))
            other = a != b
            if other.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[other]), pa.array(np.maximum(a, b)[other]), pa.array(kind[other])], names=["a", "b", "star"])
        if open_from == len(sigs):  # the last group is done, or large: then only its first row is kept
            large = sigs[-1]
            sigs, rows = sigs[starts[-1] : starts[-1] + 1], rows[starts[-1] : starts[-1] + 1]
        else:
            sigs, rows = sigs[open_from:], rows[open_from:]


def _edges(signed: DataFrame) -> DataFrame:
    """a, b, shared, star: rows of ``signed`` that share signatures. In groups of more than GROUP rows each meets the
    first row only (star); other pairs have the number of signatures that they share in smaller groups.

    Hot signatures, HOT at most, get their first row by an aggregation and a broadcast, so no task holds them.
    """

    @released
    def task(batches):
        yield from _repeated(np.asarray(batch.column(0).flatten()).view(np.uint64) for batch in batches)

    sigs = signed.where("sigs is not null")
    counts = stored(sigs.select("sigs").mapInArrow(task, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_FROM), "hot")
    hot = most_frequent(counts, "n", HOT).select(F.col("h").alias("sig"))
    # Row numbers are dense, so they take little room in the shuffle beside the signature.
    rows = sigs.select(F.explode("sigs").alias("sig"), "row")
    parts = int(signed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cold = rows.join(F.broadcast(hot), "sig", "left_anti").select("sig", "row").repartition(parts, "sig").sortWithinPartitions("sig")
    found = cold.mapInArrow(released(together), "a long, b long, star boolean")
    if hot.limit(1).count():
        few = rows.join(F.broadcast(hot), "sig", "left_semi").groupBy("sig").agg(F.min("row").alias("a"))
        found = found.unionByName(rows.join(F.broadcast(few), "sig").select("a", F.col("row").alias("b"), F.lit(True).alias("star")).where("a <> b"))
    found = stored(found.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.max("star").alias("star")), "row-edges")
    drop(counts)
    return found


def _candidates(row_edges: DataFrame, signed: DataFrame, p: int, q: int) -> DataFrame:
    """a, b: the classes of those pairs of rows that may be links, or lead to links by way of a large group."""
    named = signed.select("row", _cid(), "n_shingles", "leading")
    of = lambda x: named.select(F.col("row").alias(x), F.col("cid").alias(f"cid_{x}"), F.col("n_shingles").alias(f"n_{x}"), F.col("leading").alias(f"leading_{x}"))
    least = f"least(leading_a, leading_b) - {q - p} * (n_a + n_b) div {q + p}"
    may = F.expr(f"star or ({q} * least(n_a, n_b) >= {p} * greatest(n_a, n_b) and shared >= {least})")
    found = row_edges.join(of("a"), "a").join(of("b"), "b").where(may)
    return found.select(F.col("cid_a").alias("a"), F.col("cid_b").alias("b")).where("a <> b").distinct()


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Exact intersection sizes of all pairs.

    The n-grams that occur more than once are cut, in the global order, into coarse fragments; each fragment's partial
    overlaps are counted as a product of incidence matrices, and summed per pair.
    """
    every = np.concatenate([*left, *right])
    grams, n = np.unique(every, return_counts=True)
    grams = grams[n > 1]
    total = np.zeros((len(left), len(right)), np.int32)

    def places(sets):
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        flat = np.concatenate(sets)
        at = np.searchsorted(grams, flat)
        at[at == len(grams)] = 0
        found = grams[at] == flat if len(grams) else np.zeros(len(flat), bool)
        return owner[found], at[found]

    a, b = places(left), places(right)
    for lo in range(0, len(grams), COARSE):
        parts = []
        for (owner, at), sets in ((a, left), (b, right)):
            here = (at >= lo) & (at < lo + COARSE)
            m = np.zeros((len(sets), min(COARSE, len(grams) - lo)), np.float32)
            m[owner[here], at[here] - lo] = 1
            parts.append(m)
        total += np.rint(parts[0] @ parts[1].T).astype(np.int32)  # below 2**24, so exact
    return total


def forest(pairs: Iterator[tuple[int, int]]) -> list[int]:
    """Places of the pairs that join parts not joined by those before them."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for k, (i, j) in enumerate(pairs):
        x, y = find(i), find(j)
        if x != y:
            root[y] = x
            out.append(k)
    return out


def cut(hashes: np.ndarray, frequent: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """The non-empty wide fragments of a set: equal ranges of hashes, and the frequent n-grams at the end."""
    place = (hashes >> _U(64 - FRAGMENTS.bit_length() + 1)).astype(np.int64)
    if len(frequent):
        place[frequent[np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)] == hashes] = FRAGMENTS
    return [(f, hashes[place == f]) for f in np.unique(place).tolist()]


def packed(grams: np.ndarray) -> bytes:
    """48 of the bits of each n-gram; with the fragment, which is known, 50 of them are compared."""
    return grams.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def partial_counts(left: list[tuple[int, int, np.ndarray]], right: list[tuple[int, int, np.ndarray]] | None, p: int, q: int) -> np.ndarray:
    """One fragment of two tiles, or of one (``right`` None), as sets (place, size of the whole, n-grams here).

    Rows (place, place, overlap here, overlap that a link needs) of the pairs that may still be linked.
    """
    own = right is None
    right = left if own else right
    (i, na, a), (j, nb, b) = zip(*left), zip(*right)
    common = overlaps(list(a), list(b))
    i, j, na, nb, a, b = (np.array(x, np.int64) for x in (i, j, na, nb, [len(x) for x in a], [len(x) for x in b]))
    found = [np.zeros((0, 4), np.int32)]
    for lo in range(0, len(i), 128):
        here = slice(lo, lo + 128)
        x, y = np.nonzero(common[here])
        x += lo
        keep = (i[x] < j[y]) if own else slice(None)
        x, y = x[keep], y[keep]
        n, sums = common[x, y], na[x] + nb[y]
        may = (q * np.minimum(na[x], nb[y]) >= p * np.maximum(na[x], nb[y])) & (a[x] + b[y] - 2 * n <= (q - p) * sums // (q + p))
        x, y, n, sums = x[may], y[may], n[may], sums[may]
        found.append(np.column_stack((i[x], j[y], n, -(-p * sums // (p + q)))).astype(np.int32))
    return np.concatenate(found)


def _rows(batches) -> Iterator[tuple]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 64):
            yield from zip(*(c.to_pylist() for c in batch.slice(lo, 64).columns))


def tile_links(rows: DataFrame, often, p: int, q: int, width: int) -> DataFrame:
    """blob, i, a, j, b: links of set a of tile i and set b of tile j, a spanning forest of each pair of tiles.

    ``rows`` are the sets of each pair of tiles (blob, i, j, tile, place, cid, text). Fragments are dealt by pair of
    tiles and fragment, partial counts by pair of tiles; both sorted, so a task holds one such group at a time.
    """

    @released
    def fragments(batches):
        frequent, out = often.value, []

        def pack():
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["blob", "i", "j", "fragment", "tile", "place", "n", "grams"])

        size = 0
        for batch in batches:
            for lo, hi, flat, cuts in _blocks(batch.column(6), width):
                keys = zip(*(c.slice(lo, hi - lo).to_pylist() for c in batch.columns[:6]))
                for (blob, i, j, tile, place, cid), start, end, c1, c2 in zip(keys, cuts.tolist(), cuts[1:].tolist(), *(c.tolist() for c in _classes(flat, cuts))):
                    if f"{c1:016x}{c2:08x}" != cid:  # hashes of texts may coincide
                        continue
                    out += [(blob, i, j, f, tile, place, end - start, packed(grams)) for f, grams in cut(flat[start:end], frequent)]
                    size += end - start
                    if size > BATCH:
                        yield pack()
                        out, size = [], 0
        if out:
            yield pack()

    @released
    def count(batches):
        out, size = [], 0
        for (blob, i, j, _), group in groupby(_rows(batches), key=lambda r: r[:4]):
            tiles: tuple[dict, dict] = ({}, {})
            for *_, tile, place, n, grams in group:
                tiles[tile != i][place] = (place, n, unpacked(grams))
            left, right = ([t[k] for k in sorted(t)] for t in tiles)
            if len(left) > 1 if i == j else left and right:
                found = partial_counts(left, None if i == j else right, p, q)
                if len(found):
                    out.append((blob, i, j, found.tobytes()))
                    size += len(found)
            if size > BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.binary()))], names=["blob", "i", "j", "counts"])
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.binary()))], names=["blob", "i", "j", "counts"])

    @released
    def total(batches):
        out = []

        def pack():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int32()))], names=["blob", "i", "a", "j", "b"])

        for (blob, i, j), group in groupby(_rows(batches), key=lambda r: r[:3]):
            counts = np.frombuffer(b"".join(r[3] for r in group), np.int32).reshape(-1, 4).astype(np.int64)
            pairs, at, place = np.unique(counts[:, 0] << 32 | counts[:, 1], return_index=True, return_inverse=True)
            linked = np.bincount(place, weights=counts[:, 2]) >= counts[at, 3]  # whole numbers below 2**53
            a, b = (pairs[linked] >> 32).tolist(), (pairs[linked] & 0xFFFFFFFF).tolist()
            shift = 0 if i == j else 1 << 40
            out += [(blob, i, a[k], j, b[k]) for k in forest(zip(a, (x + shift for x in b)))]
            if len(out) > 20_000:
                yield pack()
                out = []
        if out:
            yield pack()

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.select("blob", "i", "j", "tile", "place", "cid", "text").mapInArrow(fragments, "blob string, i long, j long, fragment int, tile long, place int, n long, grams binary")
    cuts = cuts.repartition(parts, "blob", "i", "j", "fragment").sortWithinPartitions("blob", "i", "j", "fragment")
    counts = cuts.mapInArrow(count, "blob string, i long, j long, counts binary").repartition(parts, "blob", "i", "j").sortWithinPartitions("blob", "i", "j")
    return counts.mapInArrow(total, "blob string, i long, a int, j long, b int")


def _cid(c1: str = "c1", c2: str = "c2") -> Column:
    return F.concat(F.lpad(F.lower(F.hex(c1)), 16, "0"), F.lpad(F.lower(F.hex(c2)), 8, "0")).alias("cid")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its smallest node): alternating large-star and small-star until nothing changes.

    Edges stay distributed; the driver only sees their number and a checksum. Each step is written to the shared
    folder. Hubs are handled by aggregation and joins, which skew handling can split.
    """

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    before = mark(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.where("u > v")
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.withColumnRenamed("m", "v")).distinct()
        step = stored(small, "edges")
        now = mark(step)
        drop(e)
        e = step
        if now == before:
            break
        before = now
    return stored(e.select(F.col("u").alias("node"), F.col("v").alias("component")), "components")


def _tiled(members: DataFrame, p: int, q: int) -> DataFrame:
    """``members`` (blob, family, cid, n, ...) with level (of lengths), tile, and place in the tile.

    A blob that fits is one tile. Sets of others are dealt, by family and level, by hash into as many tiles as their
    counts ask for: only whole tiles, and no larger group, are numbered by a window.
    """
    need = F.greatest(F.count(F.lit(1)) / TILE_SETS, F.sum("n") / TILE_SHINGLES)
    split = members.groupBy("blob").agg((need > 1).alias("split"))
    level = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(q / p))).cast("int")  # a link lies within two levels
    leveled = members.join(split, "blob").withColumn("level", F.when(F.col("split"), level).otherwise(0)).withColumn("family", F.when(F.col("split"), F.col("family")).otherwise("")).drop("split")
    sizes = leveled.groupBy("blob", "family", "level").agg(F.ceil(need).alias("parts"))
    part = F.pmod(F.xxhash64("cid", F.lit(11)), F.col("parts"))
    family = F.pmod(F.xxhash64("family", F.lit(12)), F.lit(1 << 20))
    dealt = leveled.join(sizes, ["blob", "family", "level"]).withColumn("part", part)
    dealt = dealt.withColumn("tile", (F.col("level").cast("long") * (1 << 20) + family) * (1 << 30) + F.col("part"))
    place = F.row_number().over(Window.partitionBy("blob", "tile").orderBy("cid")) - 1
    return dealt.withColumn("place", place.cast("int"))


def _links(tiled: DataFrame, pairs: DataFrame, texts: DataFrame, often, p: int, q: int, width: int, most: int) -> DataFrame:
    """a, b: classes linked within the pairs (blob, i, j) of tiles, by rounds of about ``most`` n-grams."""
    uses = pairs.select("blob", "i", "j", F.col("i").alias("tile")).unionByName(pairs.where("i < j").select("blob", "i", "j", F.col("j").alias("tile")))
    sizes = tiled.groupBy("blob", "tile").agg(F.sum("n").alias("n"))
    rounds = max(1, math.ceil((uses.join(sizes, ["blob", "tile"]).agg(F.sum("n")).first()[0] or 0) / most))
    turn = F.pmod(F.xxhash64("blob", "i", "j", F.lit(13)), F.lit(rounds))
    found = [_round(tiled, uses.where(turn == F.lit(k)), texts, often, p, q, width) for k in range(rounds)]
    if rounds == 1:
        return found[0]
    result = stored(reduce(DataFrame.unionByName, found), "links")
    drop(*found)
    return result


def _round(tiled: DataFrame, uses: DataFrame, texts: DataFrame, often, p: int, q: int, width: int) -> DataFrame:
    """a, b: classes linked within the pairs of tiles of ``uses`` (blob, i, j, tile)."""
    # Narrow rows say where each set goes; then its text moves to them, and its fragments to their tasks.
    where = stored(uses.join(tiled.select("blob", "tile", "place", "cid", "rep", "rep_t"), ["blob", "tile"]), "uses")
    bucket = lambda t: F.pmod(t, F.lit(BUCKETS))
    wanted = F.broadcast(where.select(bucket(F.col("rep_t")).alias("bucket")).distinct())  # at most BUCKETS rows
    found = texts.withColumn("bucket", bucket(F.col("t"))).join(wanted, "bucket", "left_semi").drop("bucket")
    found = found.groupBy(_id_hash("id").alias("k"), "t").agg(F.first("text").alias("text"))  # rows alike in both count once
    keyed = where.withColumn("k", _id_hash("rep")).withColumnRenamed("rep_t", "t")
    dealt = keyed.join(found, ["k", "t"]).select("blob", "i", "j", "tile", "place", "cid", "text")
    links = stored(tile_links(dealt, often, p, q, width), "tile-links")
    names = tiled.select("blob", "tile", "place", "cid")
    left = links.join(names.select("blob", F.col("tile").alias("i"), F.col("place").alias("a"), F.col("cid").alias("left")), ["blob", "i", "a"])
    both = left.join(names.select("blob", F.col("tile").alias("j"), F.col("place").alias("b"), F.col("cid").alias("right")), ["blob", "j", "b"])
    result = stored(both.select(F.col("left").alias("a"), F.col("right").alias("b")), "links")
    drop(where, links)
    return result


def _all_links(members: DataFrame, texts: DataFrame, often, p: int, q: int, width: int, most: int) -> list[DataFrame]:
    """Links that connect what is linked: tiles with themselves and with the first of their length, then what is left."""
    tiled = stored(_tiled(members.withColumn("family", F.lit("")), p, q), "tiled")
    tiles = tiled.groupBy("blob", "level", "tile", "part").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    firsts = tiles.where("part = 0")
    near = firsts.alias("x").join(firsts.alias("y"), (F.col("x.blob") == F.col("y.blob")) & (F.col("y.level") == F.col("x.level") + 1)).where(f"{q} * x.high >= {p} * y.low").select("x.blob", F.col("x.tile").alias("i"), F.col("y.tile").alias("j"))
    spokes = tiles.where("part > 0").select("blob", (F.col("tile") - F.col("part")).alias("i"), F.col("tile").alias("j"))
    pairs = stored(tiles.select("blob", F.col("tile").alias("i"), F.col("tile").alias("j")).unionByName(spokes).unionByName(near), "pairs")
    links = [_links(tiled, pairs, texts, often, p, q, width, most)]

    # Blobs of more than one tile may have further links, unless they are of one component by now.
    several = stored(tiles.groupBy("blob").agg(F.count(F.lit(1)).alias("tiles")).where("tiles > 1").select("blob"), "several")
    if several.limit(1).count():
        linked = connected_components(links[0])
        inside = tiled.join(several, "blob", "left_semi").select("blob", "cid", "rep", "rep_t", "n").join(linked, F.col("cid") == F.col("node"), "left")
        inside = inside.withColumn("component", F.coalesce("component", "cid")).drop("node")
        large = inside.groupBy("component").agg(F.count(F.lit(1)).alias("sets")).where(F.col("sets") >= TILE_SETS).select("component", F.col("component").alias("family"))
        again = stored(_tiled(inside.join(large, "component", "left").na.fill({"family": ""}), p, q), "tiled-again")
        spans = again.groupBy("blob", "tile").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("component").alias("from"), F.max("component").alias("to"))
        first = spans.select("blob", *(F.col(c).alias(f"i_{c}") for c in ("tile", "low", "high", "from", "to")))
        second = spans.select("blob", *(F.col(c).alias(f"j_{c}") for c in ("tile", "low", "high", "from", "to")))
        apart = (F.col("i_from") != F.col("i_to")) | (F.col("j_from") != F.col("j_to")) | (F.col("i_from") != F.col("j_from"))
        fits = f"i_tile <= j_tile and {q} * i_high >= {p} * j_low and {q} * j_high >= {p} * i_low"
        rest = stored(first.join(second, "blob").where(fits).where(apart).select("blob", F.col("i_tile").alias("i"), F.col("j_tile").alias("j")), "pairs")
        links.append(_links(again, rest, texts, often, p, q, width, most))
        drop(linked, again, rest)
    drop(tiled, pairs, several)
    return links


def jaccard_components(df: DataFrame, threshold: tuple[int, int] = (85, 100), width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id, n_shingles, component_id.

    Documents link when q x intersection >= p x union for ``threshold`` (p, q). component_id is the smallest id
    reachable by links. Documents with null or empty texts, or no words, have n_shingles 0 and are their own
    component; an empty table gives no rows. Repeated rows are links between equal sets. Rows with a null id take part
    as copies do, but an id that is null is never the smallest; alone, such a row has a null component. Very long
    texts are sets like others, in a tile of their own if need be. Only the two named columns are read.
    """
    return _components(df, threshold, width, id_col, text_col, False)


def _components(df: DataFrame, threshold: tuple[int, int], width: int, id_col: str, text_col: str, classed: bool) -> DataFrame:
    """``jaccard_components``; if ``classed``, with each row's t, and the first class of its component (root)."""
    p, q = threshold
    often = df.sparkSession.sparkContext.broadcast(frequent_shingles(df, text_col, width))  # bounded by FREQUENT
    signed = stored(_signed(df, id_col, text_col, often, p, q, width).withColumn("row", F.monotonically_increasing_id()), "signed")
    own = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "t")
    classes = signed.where("n_shingles > 0").groupBy("c1", "c2").agg(F.min(own).alias("w"), F.max("n_shingles").alias("n"), F.count(F.lit(1)).alias("copies"))
    classes = stored(classes.select(_cid(), "c1", "c2", F.col("w.id").alias("rep"), F.col("w.t").alias("rep_t"), "n", "copies"), "classes")

    row_edges = _edges(signed)
    # Signatures are most of that table, so it goes as soon as they have been used.
    weak_sets = stored(signed.where("weak").select("c1", "c2").distinct(), "weak")
    slim = stored(signed.select("doc_id", "t", "n_shingles", "c1", "c2", "leading", "row"), "slim")
    drop(signed)
    signed = slim
    edges = _candidates(row_edges, signed, p, q)

    # Sets without enough fragments meet every set of admissible size (none but in tiny or adversarial inputs).
    if weak_sets.limit(1).count():
        weak = weak_sets.join(classes, ["c1", "c2"])
        spread = weak.select(F.col("cid").alias("a"), F.explode(F.sequence(F.ceil(F.col("n") * p / q), F.floor(F.col("n") * q / p))).alias("n"))
        edges = edges.unionByName(spread.join(classes, "n").select("a", F.col("cid").alias("b")).where("a <> b"))

    blobs = connected_components(edges)
    named = blobs.select(F.col("node").alias("cid"), F.col("component").alias("blob"))
    named = named.unionByName(named.select(F.col("blob").alias("cid"), "blob")).distinct()
    members = stored(named.join(classes.select("cid", "rep", "rep_t", "n"), "cid"), "members")
    drop(blobs, row_edges, weak_sets)

    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), _text_hash(text_col).alias("t")).where(F.col("text").isNotNull())
    most = max(ROUND_SHINGLES, (classes.agg(F.sum("n")).first()[0] or 0) // ROUND_PART)
    links = _all_links(members, texts, often, p, q, width, most)
    linked = connected_components(links[0] if len(links) == 1 else links[0].unionByName(links[1]))

    sources = linked.select(F.col("node").alias("cid"), "component").unionByName(linked.select(F.col("component").alias("cid"), "component")).distinct()
    sources = members.select("cid", "rep").join(sources, "cid")
    smallest = sources.groupBy("component").agg(F.min("rep").alias("component_id"))
    renamed = sources.join(smallest, "component").select("cid", "component", "component_id")
    # Classes without links keep their own smallest id; the few with links are looked up.
    final = classes.select("cid", "c1", "c2", "rep", "copies").join(renamed, "cid", "left").select("c1", "c2", "copies", F.coalesce("component_id", "rep").alias("component_id"), F.coalesce("component", "cid").alias("root"))
    final = stored(final, "final")
    # Rows of the classes with most copies, HOT at most, find theirs by broadcast; no other class is hot.
    hot = F.broadcast(most_frequent(stored(final.where(F.col("copies") >= HOT_FROM), "hot-classes"), "copies", HOT).drop("copies"))
    rows = signed.select("doc_id", "t", "n_shingles", "c1", "c2")
    of_hot = rows.join(hot, ["c1", "c2"])
    others = rows.join(hot.select("c1", "c2"), ["c1", "c2"], "left_anti").join(final.drop("copies"), ["c1", "c2"], "left")
    result = of_hot.unionByName(others)
    result = stored(result.select(F.col("doc_id").alias(id_col), "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), *(["t", "root"] if classed else [])), "result")
    drop(signed, classes, members, final, linked, *links)
    return result


def one_of_each(df: DataFrame, threshold: tuple[int, int] = (85, 100), width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One of the input's rows for each component of linked texts: of the smallest id, nulls last, in it.

    Rows are told apart by id and text, so rows that share an id, or have none, stay if their texts are not linked.
    Documents without words stay, those of the same id and text once. Columns are returned as they are, whatever
    their names; an empty table gives no rows.
    """
    parts = _components(df, threshold, width, id_col, text_col, True)
    own = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("t").alias("t"))
    chosen = parts.where("n_shingles > 0").groupBy("root").agg(F.min(own).alias("w")).select(_id_hash("w.id").alias("k"), "w.t", F.lit(True).alias("kept"))
    # By id and text: whether the row stays, and whether it is met more than once.
    keys = parts.groupBy(F.col(id_col).alias("id"), "t").agg(F.count(F.lit(1)).alias("rows"), F.max(F.col("n_shingles") == 0).alias("bare"))
    keys = keys.withColumn("k", _id_hash("id")).join(chosen, ["k", "t"], "left")
    keys = stored(keys.select("id", "t", (F.col("rows") > 1).alias("several"), (F.col("bare") | F.coalesce("kept", F.lit(False))).alias("kept")), "keys")
    drop(parts)
    # Most rows stay and are met once: they pass a bounded table of hash buckets, and their texts are not moved.
    t, k, bucket = new_name(df, "t"), new_name(df, "k"), new_name(df, "bucket")
    into = lambda i, t: F.pmod(F.xxhash64(i, t), F.lit(BUCKETS)).alias(bucket)
    doubtful = F.broadcast(keys.where("several or not kept").select(into("id", "t")).distinct())  # at most BUCKETS rows
    rows = df.withColumn(t, _text_hash(text_col))
    rows = rows.select("*", into(id_col, t))
    clear = rows.join(doubtful, bucket, "left_anti").select(*df.columns)
    rest = rows.join(doubtful, bucket, "left_semi").select(*df.columns, t, _id_hash(id_col).alias(k))
    asked = keys.where("kept").select(_id_hash("id").alias(k), F.col("t").alias(t))
    return clear.unionByName(rest.join(asked, [k, t], "left_semi").dropDuplicates([k, t]).select(*df.columns))
