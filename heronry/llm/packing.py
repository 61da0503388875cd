"""Best-fit packing of tokenised documents by bin completion.

Only the histogram of piece lengths (as many rows as the capacity has values) is packed on the driver: patterns of
lengths with multiplicities. Best-fit decreasing gives the first incumbent; bin completion then enumerates
undominated fillings around the largest length left, prunes by the waste that an improvement may still have, and
replaces the incumbent whenever it saves sequences. Pieces get their places by rank within their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heronry.llm.bpe import MEMO_ENTRIES, rank_encoder
from heronry.llm.common import block_map, drop, stored

#: A pattern: lengths in falling order, and how many sequences are filled so.
Pattern = tuple[tuple[int, ...], int]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """No packing has fewer sequences: the volume bound, and pieces over half the capacity need one each."""
    volume = -(-sum(n * c for n, c in counts.items()) // capacity)
    best = volume
    for small in {0, *(n for n in counts if 2 * n <= capacity)}:
        large = sum(c for n, c in counts.items() if n > capacity - small)
        half = [(n, c) for n, c in counts.items() if capacity - small >= n > capacity / 2]
        rest = sum(n * c for n, c in counts.items() if small <= n <= capacity / 2 and n)
        room = sum((capacity - n) * c for n, c in half)
        best = max(best, large + sum(c for _, c in half) + max(0, -(-(rest - room) // capacity)))
    return best


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing over groups of equal sequences."""
    groups: dict[int, dict[tuple[int, ...], int]] = {}  # by the room left

    def add(room: int, pattern: tuple[int, ...], n: int) -> None:
        own = groups.setdefault(room, {})
        own[pattern] = own.get(pattern, 0) + n

    for length in sorted(counts, reverse=True):
        left = counts[length]
        for room in sorted(r for r in groups if r >= length):
            while left and groups.get(room):
                pattern, n = next(iter(groups[room].items()))
                fit = min(room // length, max(1, left // n))
                used = min(n, left // fit)
                left -= used * fit
                groups[room].pop(pattern)
                if n > used:
                    add(room, pattern, n - used)
                add(room - fit * length, pattern + (length,) * fit, used)
        each = capacity // length
        if left >= each:
            add(capacity - each * length, (length,) * each, left // each)
        if left % each:
            add(capacity - (left % each) * length, (length,) * (left % each), 1)
    return [(p, n) for own in groups.values() for p, n in own.items()]


def fillings(room: int, counts: dict[int, int], slack: int) -> Iterator[tuple[int, ...] | None]:
    """All undominated fillings of the room that waste ``slack`` at most, lazily: the least waste first, then those of
    longer pieces. None stands for a dominated one, so that the caller can count it.

    A filling is dominated (Martello and Toth) if a piece left out could take the place of some of its pieces that fit
    that piece's place: what went out then fits wherever the piece was.
    """
    lengths = sorted((n for n, c in counts.items() if c > 0 and n <= room), reverse=True)
    reach = [1] * (len(lengths) + 1)  # bit s: some of the lengths from here on have the sum s
    cut = (1 << (room + 1)) - 1
    for i in range(len(lengths) - 1, -1, -1):
        sums, n, times, step = reach[i + 1], lengths[i], min(counts[lengths[i]], room // lengths[i]), 1
        while times:
            step = min(step, times)
            sums |= sums << step * n & cut
            times -= step
            step *= 2
        reach[i] = sums

    def exact(target: int) -> Iterator[tuple[int, ...]]:
        stack, parts = [(target, 0)], []
        while stack:
            need, i = stack.pop()
            if not need:
                yield tuple(parts)
            while need and i < len(lengths) and reach[i] >> need & 1:
                n = lengths[i]
                if n <= need and reach[i] >> need - n & 1 and parts.count(n) < counts[n]:
                    stack.append((need, i + 1))
                    parts.append(n)
                    need, i = need - n, i
                    if not need:
                        yield tuple(parts)
                    continue
                i += 1
            # Back to the last branch: the pieces behind it are free again.
            if stack:
                while parts and target - sum(parts) != stack[-1][0]:
                    parts.pop()

    def dominated(parts: tuple[int, ...], waste: int) -> bool:
        left = sum(1 << n for n, c in counts.items() if c > parts.count(n))
        if left & (2 << waste) - 1:
            return True
        one = many = 0  # sums of one piece, and of two or more
        for n in parts:
            many |= (one | many) << n
            one |= 1 << n
            if left >> (n + 1) & (1 << waste) - 1:
                return True
        for w in range(waste + 1):
            if many << w & left:
                return True
        return False

    for waste in range(min(slack, room) + 1):
        if reach[0] >> (room - waste) & 1:
            for parts in exact(room - waste):
                yield None if dominated(parts, waste) else parts


def bin_completion(counts: dict[int, int], capacity: int, budget: int = 20_000) -> tuple[list[Pattern], bool]:
    """Patterns, and whether they are proven to be as few sequences as possible.

    Branch and bound, depth first: a node takes the largest length left, and branches over its undominated
    fillings, each used as often as the counts allow and then less often. A branch is cut as soon as its waste exceeds
    what any packing with one sequence less than the incumbent may waste. ``budget`` bounds the nodes, dominated
    fillings included; nothing else is left out, so a search that ends before it proves its result.
    """
    counts = {n: c for n, c in counts.items() if c > 0 and 0 < n <= capacity}
    best = best_fit_decreasing(counts, capacity)
    size, bound, total = sum(n for _, n in best), lower_bound(counts, capacity), sum(n * c for n, c in counts.items())
    if size == bound:
        return best, True
    nodes = 0
    left = dict(counts)
    chosen: list[Pattern] = []
    stack: list[tuple[Iterator, int]] = []  # branches open at each depth, and the waste down to it

    def branch(waste: int) -> Iterator[Pattern | None]:
        large = max(left)
        rest = left | {large: left[large] - 1}
        options = fillings(capacity - large, rest, (size - 1) * capacity - total - waste)
        for filling in options:
            if filling is None:
                yield None
                continue
            pattern = (large, *filling)
            for n in range(min(left[n] // pattern.count(n) for n in set(pattern)), 0, -1):
                yield pattern, n

    stack.append((branch(0), 0))
    while stack:
        options, waste = stack[-1]
        if len(chosen) >= len(stack):  # back from the branch below: its pieces are free again
            old, k = chosen.pop()
            for x in old:
                left[x] = left.get(x, 0) + k
        try:
            option = next(options)
        except StopIteration:
            stack.pop()
            continue
        nodes += 1
        if nodes > budget:
            return best, False
        if option is None:
            continue
        pattern, n = option
        spent = waste + n * (capacity - sum(pattern))
        if spent > (size - 1) * capacity - total:  # one sequence less cannot waste that much
            continue
        chosen.append((pattern, n))
        for x in pattern:
            left[x] -= n
        for x in set(pattern):
            if not left[x]:
                del left[x]
        if not left:
            best, size = list(chosen), sum(k for _, k in chosen)
            if size == bound:
                return best, True
            continue
        stack.append((branch(spent), spent))
    return best, True


def encoded_pieces(df: DataFrame, path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", memo: int = MEMO_ENTRIES) -> DataFrame:
    """Pieces of every whole text's ids and the end id: only longer documents are cut, the first piece is the short one."""
    def factory():
        coder = rank_encoder(path, memo)

        def kernel(keys, texts):
            for key, text in zip(keys, texts):
                ids = np.array([*coder.ids(text or ""), end_id], "<u4").tobytes()
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n, capacity), n]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    yield key, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])

        return kernel

    return block_map(df, [id_col, text_col], f"{id_col} {df.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long", factory)


def pack(df: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", salts: int = 64, budget: int = 20_000, memo: int = MEMO_ENTRIES) -> DataFrame:
    """Packs all documents into as few sequences of at most ``capacity`` tokens as the search finds.

    One row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset. Null texts count as empty (a
    lone end id). Repeated rows are packed each; pieces alike in every column may swap places. Full pieces fill a
    sequence each and need no rank. The other lengths are ranked within ``salts`` hash parts, so no task sorts all
    pieces of a hot length; ``memo`` bounds the words whose ids a worker
    remembers for texts that go to the exact encoder. The driver sees capacity x salts counts at most.
    """
    pieces = stored(encoded_pieces(df, path, capacity, end_id, id_col, text_col, memo), "pieces")
    part = F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.lit(salts)).cast("int").alias("part")
    short = pieces.where(F.col("length") < capacity).select("*", part)
    rows = short.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")).collect()  # at most capacity x salts
    counts: dict[int, int] = {}
    before: dict[tuple[int, int], int] = {}
    for length, salt, n in sorted(map(tuple, rows)):
        before[length, salt] = counts.get(length, 0)
        counts[length] = counts.get(length, 0) + n
    patterns, _ = bin_completion(counts, capacity, budget)
    slots: list[tuple[int, int, int, int]] = []  # length, first rank, first sequence, offset
    used: dict[int, int] = {}
    sequence = 0
    for pattern, n in patterns:
        offset = 0
        for length in pattern:
            slots.append((length, used.get(length, 0), sequence, offset))
            used[length] = used.get(length, 0) + n
            offset += length
        sequence += n
    slots.sort()
    table = {k: np.array([s[i] for s in slots], np.int64) for i, k in enumerate(("length", "rank", "sequence", "offset"))}
    where = df.sparkSession.sparkContext.broadcast((table, before))
    out = pieces.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ").replace(",", ", ") + ", sequence_id long, offset long"

    def place(batches):
        slots, before = where.value
        key = slots["length"] << 40 | slots["rank"]
        for batch in batches:
            length = batch.column("length").to_numpy()
            first = np.array([before[x] for x in zip(length.tolist(), batch.column("part").to_pylist())], np.int64)
            rank = batch.column("rank").to_numpy().astype(np.int64) - 1 + first
            at = np.searchsorted(key, length << 40 | rank, side="right") - 1
            kept = [batch.column(i) for i in range(5)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(slots["sequence"][at] + rank - slots["rank"][at]), pa.array(slots["offset"][at])], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    order = Window.partitionBy("length", "part").orderBy(id_col, "piece", "ids_crc32")
    placed = short.select(*pieces.columns, "part", F.row_number().over(order).alias("rank")).mapInArrow(place, out)
    full = pieces.where(F.col("length") == capacity).select(*pieces.columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(full)


__all__ = ["best_fit_decreasing", "bin_completion", "drop", "encoded_pieces", "fillings", "lower_bound", "pack"]
