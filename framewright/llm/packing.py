"""Packing documents into sequences: Martello and Toth's dominance reduction, then best fit.

Only lengths matter for packing, and there are at most `capacity` of them, so the plan is made on the driver from the
histogram of lengths and has a bounded size whatever the input. Each piece gets its rank among the pieces of its length
(its partition's offset plus its own count there) and finds its place by binary search in the plan.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_texts, materialize, small_batches
from .tokens import default_path, shared_tokenizer

CAPACITY = 2048
END = 0
#: Rows of length, partition and offset that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 300_000


class _Lengths:
    """A multiset of lengths with few distinct values."""

    def __init__(self, counts: dict[int, int]):
        self.n = {k: v for k, v in counts.items() if v > 0}
        self.keys = sorted(self.n)

    def take(self, length: int, times: int) -> None:
        self.n[length] -= times
        if self.n[length] == 0:
            del self.n[length]
            self.keys.pop(bisect_left(self.keys, length))

    def smallest(self, most: int, without: int, above: int = 0) -> list[int]:
        """The `most` smallest items longer than `above`, one of length `without` left out."""
        out: list[int] = []
        for k in self.keys[bisect_left(self.keys, above + 1) :]:
            out += [k] * min(most - len(out), self.n[k] - (k == without))
            if len(out) >= most:
                break
        return out

    def largest(self, room: int, without: int) -> int:
        """The longest item that fits the room, 0 if none does."""
        at = bisect_left(self.keys, room + 1)
        for k in reversed(self.keys[max(0, at - 2) : at]):
            if self.n[k] - (k == without) > 0:
                return k
        return 0

    def best_pair(self, room: int, without: int) -> tuple[int, int]:
        """Two items of the largest sum within the room, the longer first; of equal sums the one with the longest item."""
        best, j = (0, 0), 0
        for a in reversed(self.keys[: bisect_left(self.keys, room)]):
            if self.n[a] - (a == without) < 1:
                continue
            while j < len(self.keys) and self.keys[j] <= room - a:
                j += 1
            i = min(j, bisect_left(self.keys, a + 1)) - 1
            while i >= 0 and self.n[self.keys[i]] - (self.keys[i] == without) - (self.keys[i] == a) < 1:
                i -= 1
            if i >= 0 and a + self.keys[i] > sum(best):
                best = (a, self.keys[i])
        return best


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, list[int]]], dict[int, int]]:
    """Sets that some optimal packing contains, as (times, lengths), and what is left.

    For the longest item j each set that fits with it is compared: j alone if nothing fits; j and the longest fitting
    item if no two others fit with j, if the two fill the sequence, or if that item is at least the largest fitting
    pair; j and the largest pair (a, b) if a is the longest fitting item and no fitting pair has both items longer
    than b. Equal items are fixed together, so the work depends on the number of lengths only.
    """
    left, fixed = _Lengths(counts), []

    def fix(items: list[int]) -> None:
        times = min(left.n[k] // items.count(k) for k in set(items))
        for k in set(items):
            left.take(k, times * items.count(k))
        fixed.append((times, items))

    for j in sorted(left.n, reverse=True):
        while left.n.get(j):
            room = capacity - j
            star = left.largest(room, j)
            if not star:
                fixed.append((left.n[j], [j]))
                left.take(j, left.n[j])
                break
            low = left.smallest(3, j)
            if star == room or len(low) < 2 or low[0] + low[1] > room:
                fix([j, star])
            elif len(low) < 3 or sum(low) > room:
                a, b = left.best_pair(room, j)
                longer = left.smallest(2, j, above=b)
                if star >= a + b:
                    fix([j, star])
                elif a == star and (len(longer) < 2 or sum(longer) > room):
                    fix([j, a, b])
                else:
                    break
            else:
                break
    return fixed, dict(left.n)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Best fit, longest first, for all items of a length at once: the fullest open sequence that fits takes as many as it can."""
    rooms: list[int] = []
    open_: dict[int, list[tuple[int, list[int]]]] = {}

    def put(room: int, times: int, items: list[int]) -> None:
        if times:
            if room not in open_:
                insort(rooms, room)
            open_.setdefault(room, []).append((times, items))

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                times, items = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(at)
            else:
                room, times, items = capacity, n, []
            each = room // length
            whole = min(times, n // each)
            put(room - each * length, whole, items + [length] * each)
            n -= whole * each
            rest = times - whole
            if rest and n:
                part = min(n, each)
                put(room - part * length, 1, items + [length] * part)
                n, rest = n - part, rest - 1
            if items:
                put(room, rest, items)
    return [x for room in rooms for x in open_[room]]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(times, lengths) of all sequences."""
    fixed, left = reduce_by_dominance(counts, capacity)
    return fixed + best_fit(left, capacity)


def places(patterns: list[tuple[int, list[int]]]):
    """Rows (length, first rank, first sequence, pieces of this length a sequence, offset) sorted by length and rank."""
    import numpy as np

    rows, used, sequence = [], {}, 0
    for times, items in patterns:
        offset = 0
        for k in dict.fromkeys(items):
            each = items.count(k)
            rows.append((k, used.get(k, 0), sequence, each, offset))
            used[k] = used.get(k, 0) + times * each
            offset += k * each
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end: int = END, keep_ids: bool = False) -> DataFrame:
    """Token pieces of at most capacity ids: id, piece, start, length, ids_crc32, part and nth (which of its length it is in its partition), ids if asked for."""
    path = tokenizer or default_path()
    kind = dict(docs.dtypes)[id_col]
    names = ["id", "piece", "start", "length", "ids_crc32", "part", "nth"] + ["ids"] * keep_ids
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long, part long, nth long" + ", ids array<int>" * keep_ids

    def run(batches):
        from zlib import crc32

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        words, seen, part = shared_tokenizer(path), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for b in small_batches(batches, "text", 6 << 20):
            ids, cuts = words.encode(b.column("text"), end)
            ids = ids.astype("<u4")
            sizes = np.diff(cuts)
            per = -(-sizes // capacity)
            row = np.repeat(np.arange(len(sizes)), per)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
            start = piece * capacity
            length = np.minimum(sizes[row] - start, capacity)
            first = cuts[:-1][row] + start
            data = memoryview(ids).cast("B")
            crc = np.fromiter((crc32(data[4 * a : 4 * (a + n)]) for a, n in zip(first.tolist(), length.tolist())), np.int64, len(row))
            order = np.argsort(length, kind="stable")
            own = length[order]
            nth = np.empty(len(own), np.int64)
            nth[order] = np.arange(len(own)) - np.searchsorted(own, own) + seen[own]
            seen += np.bincount(length, minlength=capacity + 1)
            cols = [b.column("id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc), pa.array(np.full(len(row), part, np.int64)), pa.array(nth)]
            if keep_ids:
                cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([first, cuts[-1:]]).astype(np.int32)), pa.array(ids.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return map_texts(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, schema)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end: int = END, keep_ids: bool = False) -> DataFrame:
    """id, piece, start, length, ids_crc32, sequence_id, offset (and ids) for every piece of every row.

    Null and empty texts have just the end id. Rows with a repeated id are documents of their own. Only documents
    longer than capacity are cut. An empty table gives an empty result; other columns play no part.
    """
    cut = materialize(pieces(docs, id_col, text_col, tokenizer, capacity, end, keep_ids), "pack-pieces")
    counts = materialize(cut.groupBy("length", "part").agg(F.count("*").alias("n")), "pack-counts")
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    table = places(plan(totals, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    base = F.broadcast(base) if counts.count() <= BROADCAST_ROWS else base.hint("merge")
    ranked = cut.join(base, ["length", "part"]).withColumn("rank", F.col("base") + F.col("nth"))
    out = ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * keep_ids
    schema = ", ".join(f"{c} {dict(cut.dtypes).get(c, 'bigint')}" for c in out)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        wide = np.int64(1) << 40
        key = table[:, 0] * wide + table[:, 1]
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = table[np.searchsorted(key, length * wide + rank, "right") - 1]
            t = rank - at[:, 1]
            found = {"sequence_id": pa.array(at[:, 2] + t // at[:, 3]), "offset": pa.array(at[:, 4] + t % at[:, 3] * length)}
            yield pa.RecordBatch.from_arrays([found[c] if c in found else b.column(c) for c in out], names=out)

    return ranked.select(*[c for c in out if c not in ("sequence_id", "offset")], "rank").mapInArrow(run, schema).withColumnRenamed("id", id_col)
