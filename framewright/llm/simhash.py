"""SimHash near-dedup: fingerprints of word shingles, compared exactly in tiles.

Equal fingerprints (with a least similarity: of equal sketches too) are one row from the start. Distinct ones are sorted into tiles by their number of set bits (a number
with more rows than a tile holds is split by hash). Fingerprints within the radius differ by no more than
the radius in their number of set bits, so only pairs of tiles that are this near are compared, each in a task of its
own: a numpy exclusive-or and bit count of blocks, where blocks whose counts in the four quarters of the fingerprint
differ beyond the radius in sum are skipped as well. Each task returns a spanning forest of the links it found, which
connects what the links connect and never has more rows than it read.

With a least similarity, a link also needs that Jaccard similarity of the shingles, which allows a wide radius: near
copies that a narrow one misses are found, and unlike documents stay apart. A first comparison with ROUGH smallest
shingle hashes of each document leaves the few that may be near another; these are compared again, each with those it
may belong to, with FINE hashes: exact for documents of as many shingles, off by 0.01 or so for longer ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, materialize, small_batches, texts_of, whole_row
from .components import connected_components

WORDS = 3
RADIUS = 3
SEED = 42
#: Rows of a tile at least, and its growth: TILE_GROWTH times the square root of all rows, so that neither the rows of a task nor how often a row is sent grow with the rows themselves.
TILE, TILE_GROWTH = 8192, 160
BLOCK = 64
ROUGH, FINE = 32, 1024
#: How far a rough similarity may fall below the least one.
SLACK = 0.25
PAD = 0xFFFFFFFF
#: Rows of two 64-bit numbers that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000

#: Lower-cases A-Z and makes all white space a blank, byte by byte.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))


def shingle_hashes(text: str, words: int = WORDS):
    """XXH64 of all shingles, repeats included; a text of fewer words is one shingle, one without a word has none."""
    import numpy as np
    from xxhash import xxh64_intdigest

    own = text.encode("utf-8", "replace").translate(_FOLD).split()
    joined = b" ".join(own)
    if len(own) <= words:
        return np.array([xxh64_intdigest(joined, SEED)] if own else [], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
    starts = np.concatenate([[0], ends[: -words] + 1])
    return np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[words - 1 :].tolist())), np.uint64, len(starts))


def fold(hashes) -> int:
    """Bit i is set if it is in over half of the hashes; 0 without any."""
    import numpy as np

    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def sketch(hashes, size: int) -> bytes:
    """The `size` smallest distinct hashes, cut to 32 bits, filled up with PAD."""
    import numpy as np

    own = np.unique((hashes >> np.uint64(32)).astype(np.uint32))[:size]
    return np.concatenate([own, np.full(size - len(own), PAD, np.uint32)]).astype("<u4").tobytes()


def similarity_of(a, b):
    """Jaccard similarity of pairs of sketches (rows of sorted numbers)."""
    import numpy as np

    both = np.sort(np.concatenate([a, b], axis=1), axis=1)
    real = both != PAD
    twice = np.zeros(both.shape, bool)
    twice[:, 1:] = (both[:, 1:] == both[:, :-1]) & real[:, 1:]
    nth = np.cumsum(real & ~twice, axis=1)
    full = (a[:, -1] == PAD) & (b[:, -1] == PAD)
    most = np.where(full, nth[:, -1], np.minimum(nth[:, -1], a.shape[1]))
    return (twice & (nth <= most[:, None])).sum(1) / np.maximum(most, 1)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, size: int = 0) -> DataFrame:
    """(id, h, fp) of every row, and a sketch of `size` hashes if that isn't 0: h hashes the text, fp is the fingerprint as a signed number."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in small_batches(batches, "text"):
            fp, drawn = [], []
            for t in texts_of(b, "text"):
                hashes = shingle_hashes(t, words)
                if size:  # the similarity is that of distinct shingles, so the fingerprint is of these as well
                    hashes = np.unique(hashes)
                fp.append(fold(hashes))
                if size:
                    drawn.append(sketch(hashes, size))
            more = [pa.array(drawn, pa.binary())] if size else []
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("h"), pa.array(np.array(fp, np.uint64).view(np.int64)), *more], names=["id", "h", "fp"] + ["sketch"] * bool(size))

    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    return map_texts(own, run, "id long, h long, fp long" + ", sketch binary" * bool(size))


def _quarters(x):
    """Set bits of each 16-bit quarter."""
    import numpy as np

    return np.bitwise_count(x.view(np.uint16).reshape(-1, 4)).astype(np.int16)


def _ordered(x):
    """Positions of the distinct values, ordered by their quarters' bits."""
    import numpy as np

    x, first = np.unique(x, return_index=True)
    return first[np.lexsort(_quarters(x).T[::-1])]


def linked_forest(a, b, radius: int, a_sketch=None, b_sketch=None, least: float = 0.0, a_node=None, b_node=None):
    """(x, root; of the node numbers, if given, instead of fingerprints) that connect what pairs of a and b (uint64; b None: pairs within a) within the radius, and as similar as `least` if there are sketches, connect."""
    import numpy as np

    own = b is None
    ordered = _ordered if a_node is None else lambda x: np.lexsort(_quarters(x).T[::-1])  # nodes may have equal fingerprints
    order = ordered(a)
    a_node = a[order] if a_node is None else a_node[order]
    a, a_sketch = a[order], a_sketch[order] if a_sketch is not None else None
    if own:
        b, b_sketch = a, a_sketch
    else:
        order = ordered(b)
        b_node = b[order] if b_node is None else b_node[order]
        b, b_sketch = b[order], b_sketch[order] if b_sketch is not None else None
    if not len(a) or not len(b):
        return a_node[:0], a_node[:0]
    nodes = a_node if own else np.concatenate([a_node, b_node])
    at_b = 0 if own else len(a)
    label = np.arange(len(nodes))
    starts_a, starts_b = np.arange(0, len(a), BLOCK), np.arange(0, len(b), BLOCK)
    qa, qb = _quarters(a), _quarters(b)
    lo_a, hi_a = np.minimum.reduceat(qa, starts_a), np.maximum.reduceat(qa, starts_a)
    lo_b, hi_b = np.minimum.reduceat(qb, starts_b), np.maximum.reduceat(qb, starts_b)
    for i, s in enumerate(starts_a):
        gap = np.maximum(np.maximum(lo_b - hi_a[i], lo_a[i] - hi_b), 0).sum(1)
        near = np.flatnonzero(gap <= radius)
        if own:
            near = near[near >= i]
        for part in np.array_split(near, max(1, len(near) // 256)):
            cols = (starts_b[part][:, None] + np.arange(BLOCK)).ravel()
            cols = cols[cols < len(b)]
            if not len(cols):
                continue
            rows, hits = np.nonzero(np.bitwise_count(a[s : s + BLOCK, None] ^ b[None, cols]) <= radius)
            u, v = rows + s, cols[hits] + at_b
            if a_sketch is not None:
                new = np.flatnonzero(label[u] != label[v])
                alike = np.concatenate([similarity_of(a_sketch[u[k]], b_sketch[v[k] - at_b]) >= least for k in np.array_split(new, len(new) * a_sketch.shape[1] // (1 << 19) + 1)])
                u, v = u[new[alike]], v[new[alike]]
            label = _merged(label, u, v)
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _merged(label, u, v):
    """Labels after joining u and v pair by pair: the smallest place of each component, reached in one step."""
    import numpy as np

    while len(u):
        lu, lv = label[u], label[v]
        differ = lu != lv
        if not differ.any():
            break
        u, v, lu, lv = u[differ], v[differ], lu[differ], lv[differ]
        np.minimum.at(label, np.maximum(lu, lv), np.minimum(lu, lv))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    return label


def tile_plan(per: dict[int, int], radius: int, tile: int) -> list[tuple[int, int, int, int]]:
    """For each number of set bits: its first tile, its tiles, and the first and last tile that its tiles are compared with.

    Numbers in sequence share a tile while they fit; tiles are numbered in this order, so those within reach follow each other.
    """
    bands: list[list[int]] = []
    for c in range(65):
        if bands and sum(per.get(k, 0) for k in bands[-1]) + per.get(c, 0) <= tile:
            bands[-1].append(c)
        else:
            bands.append([c])
    tiles = [max(1, -(-sum(per.get(k, 0) for k in band) // tile)) for band in bands]
    first = [sum(tiles[:i]) for i in range(len(bands))]
    out = []
    for i, band in enumerate(bands):
        reach = [k for k, other in enumerate(bands) if other[0] - band[-1] <= radius and band[0] - other[-1] <= radius]
        out += [(first[i], tiles[i], first[reach[0]], first[reach[-1]] + tiles[reach[-1]] - 1)] * len(band)
    return out


def near_links(distinct: DataFrame, radius: int = RADIUS, tile: int | None = None, least: float | None = None) -> DataFrame:
    """Links (u, v) among the values of distinct.fp (with a least similarity: of distinct.node, a number of each row) that connect exactly what all pairs within the radius (and of the least similarity of distinct.sketch, if given) connect."""
    bits = F.bit_count("fp").cast("int")
    per = {r["c"]: r["n"] for r in distinct.groupBy(bits.alias("c")).agg(F.count("*").alias("n")).collect()}  # 65 rows at most
    tile = tile or max(TILE, int(TILE_GROWTH * sum(per.values()) ** 0.5))
    first, tiles, low, high = ("array(" + ",".join(map(str, x)) + ")" for x in zip(*tile_plan(per, radius, tile)))
    own = ["fp", *["sketch", "node"] * (least is not None)]
    rows = distinct.select(*own, bits.alias("c")).withColumn("t", F.expr(f"cast({first}[c] + pmod(xxhash64({own[-1]}), {tiles}[c]) as bigint)"))
    rows = rows.withColumn("x", F.explode(F.expr(f"sequence(cast({low}[c] as bigint), cast({high}[c] as bigint))")))
    rows = rows.select(*own, F.expr("least(t, x) * 4294967296L + greatest(t, x)").alias("pair"), F.expr(_SIDE).alias("side"))

    return rows.groupBy("pair").applyInArrow(_compared(radius, least), "u long, v long")


def _compared(radius: int, least: float | None):
    def compare(rows):
        import numpy as np
        import pyarrow as pa

        fp, side = rows["fp"].to_numpy().view(np.uint64), rows["side"].to_numpy()
        drawn = np.frombuffer(b"".join(rows["sketch"].to_pylist()), "<u4").reshape(rows.num_rows, -1) if least is not None else None
        one, two = np.flatnonzero(side < 1), None if side[0] < 0 else np.flatnonzero(side == 1)
        pick = lambda x, at: x[at] if x is not None and at is not None else None
        node = rows["node"].to_numpy().view(np.uint64) if least is not None else None
        x, y = linked_forest(fp[one], pick(fp, two), radius, pick(drawn, one), pick(drawn, two), least or 0.0, pick(node, one), pick(node, two))
        return pa.table({"u": pa.array(x.view(np.int64)), "v": pa.array(y.view(np.int64))})

    return compare


#: Of the pair (t, x) of tiles: -1 for a tile with itself, 0 for the first, 1 for the second.
_SIDE = "case when t = x then -1 when t > x then 1 else 0 end"


def fine_links(rows: DataFrame, radius: int, least: float, most: int = 4096) -> DataFrame:
    """Links among rows (fp, sketch, node, label) of equal label. Small labels are compared together, which links nothing more, as other labels have nothing near; large ones in pairs of tiles of `most` rows."""
    sizes = rows.groupBy("label").agg(F.count("*").alias("m"))
    total = rows.count()
    rows = rows.join(F.broadcast(sizes) if total <= BROADCAST_ROWS else sizes, "label")
    rows = rows.withColumn("parts", F.ceil(F.col("m") / most)).withColumn("t", F.expr("pmod(xxhash64(node), parts)")).withColumn("x", F.explode(F.expr("sequence(0L, parts - 1)")))
    pair = F.expr(f"if(parts = 1, pmod(xxhash64(label), {-(-total // most) or 1}), xxhash64(label, least(t, x), greatest(t, x)))")
    return rows.select("fp", "sketch", "node", pair.alias("pair"), F.expr(_SIDE).alias("side"), (F.col("parts") > 1).alias("large")).groupBy("large", "pair").applyInArrow(_compared(radius, least), "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS, tile: int | None = None, least: float | None = None) -> DataFrame:
    """One row per row of docs: id, h, fp, component (any number of the group), component_id (the smallest id in it), first_h (the smallest h of that id).

    Null counts as empty; texts without a word have fingerprint 0 and are linked like any other. Null ids never become
    a component_id unless a component has no other. An empty table gives an empty result.
    """
    # with a least similarity only what has the same smallest shingle hashes besides the fingerprint is one row
    node = F.col("fp") if least is None else F.xxhash64("fp", F.substring("sketch", 1, 4 * ROUGH))
    all_ = materialize(fingerprints(docs, id_col, text_col, words, ROUGH if least is not None else 0).withColumn("node", node), "simhash-documents")
    drawn = [F.min("sketch").alias("sketch")] if least is not None else []
    distinct = materialize(all_.groupBy("node").agg(F.min("fp").alias("fp"), F.min(F.struct(F.coalesce("id", F.lit((1 << 63) - 1)).alias("i"), "id", "h")).alias("best"), *drawn), "simhash-distinct")
    links = materialize(near_links(distinct, radius, tile, None if least is None else max(0.0, least - SLACK)), "simhash-links")
    if least is not None:
        maybe = connected_components(links)
        near = maybe.join(distinct, "node").select(F.xxhash64("best.id", "best.h").alias("_k"))
        near = materialize(near, "simhash-near")
        own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).withColumn("_k", F.xxhash64(F.col("_id").cast("long"), F.xxhash64(F.coalesce("_text", F.lit("")))))
        own = own.join(F.broadcast(near) if near.count() <= BROADCAST_ROWS else near, "_k", "left_semi")
        fine = fingerprints(own, "_id", "_text", words, FINE).withColumn("node", node).groupBy("node").agg(F.min("fp").alias("fp"), F.min("sketch").alias("sketch"))
        fine = materialize(fine.join(maybe, "node"), "simhash-fine")
        links = materialize(fine_links(fine, radius, least), "simhash-links")
    labels = connected_components(links)
    parts = distinct.join(labels, "node", "left").select("node", "best", F.coalesce("label", "node").alias("component"))
    parts = materialize(parts, "simhash-parts")
    best = materialize(parts.groupBy("component").agg(F.min("best").alias("first")), "simhash-first")
    parts = materialize(parts.join(best, "component").select("node", "component", F.col("first.id").alias("component_id"), F.col("first.h").alias("first_h")), "simhash-components")
    return all_.join(parts, "node").select(F.col("id").alias(id_col), "h", "fp", "component", "component_id", "first_h")


def keep_one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, radius: int = 18, tile: int | None = None, least: float | None = 0.8) -> DataFrame:
    """docs with one document of each component: that of the smallest id, of the smallest text hash if ids repeat.

    By default near duplicates share 0.8 of their five-word shingles. Rows of equal id and text count as one document and
    stay or go together. Null counts as empty, null ids as the largest. An empty table gives an empty result. All columns
    stay; those other than the two named play no part, whatever their names.
    """
    found = near_duplicates(docs, id_col, text_col, words, radius, tile, least)
    gone = found.filter(~(F.col(id_col).eqNullSafe(F.col("component_id")) & (F.col("h") == F.col("first_h"))))
    gone = materialize(gone.select(F.col(id_col).alias("_i"), F.col("h").alias("_x")).distinct(), "simhash-gone")
    rows = docs.select(whole_row(docs).alias("_row"), F.col(id_col).cast("long").alias("_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_h"))
    few = gone.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(gone) if few else gone, (F.col("_h") == F.col("_x")) & F.col("_id").eqNullSafe(F.col("_i")), "left_anti").select("_row.*")
