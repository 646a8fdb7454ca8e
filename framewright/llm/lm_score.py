"""Language-model scoring: a causal self-attention model on subword ids, and a word unigram model as base.

The attention model has one layer with a learned bias by distance. A window of WINDOW ids scores its last STRIDE
targets, so windows overlap and each id is scored once with WINDOW - STRIDE to WINDOW - 1 ids before it (fewer where a
text begins). It predicts the class of the next id in two steps, a group of classes and a class in it; frequent ids are
classes of their own, rare ones share a class by their counts. Classes and shares come from all training documents.
Weights are trained in numpy on all training documents: their ids are dealt to shards of about SHARD_IDS by hashes of
documents, so that neither the number of partitions nor their order matters. The first shard gives the start, from which
every shard, the first one too, goes once through all it has; the results are averaged by size in a tree. With a single
layer, queries, keys and values are tables by id.

The base model needs each word's count. The HEAD most frequent words are broadcast as hashes with their counts (16
bytes each, never more than HEAD); pairs of document and any other word are joined with the counts in a shuffle.
Words are told apart by their 64-bit hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, keep_memory, map_texts, materialize, small_batches
from .tokens import coded_words, default_path, shared_tokenizer, word_hashes

HEAD = 1 << 19
#: The most frequent ids are dealt to GROUPS groups of MEMBERS; the last members of the last group stand for bands of rare ids.
GROUPS, MEMBERS = 32, 32
CLASSES = GROUPS * MEMBERS
BANDS = 16
SINGLE = CLASSES - BANDS
ROWS = 4096
DIM = 32
WINDOW, STRIDE = 24, 16
#: Targets of one group of classes that are computed together.
BLOCK = 64
#: Windows that are computed together, so that what belongs to them stays near the processor.
NEAR = 64
#: Exponents up to this size need no maximum taken out.
TOP = 60.0
#: Ids of a shard of training documents, about; beyond MANY shards their number grows with the square root of all ids.
SHARD_IDS, MANY = 1 << 20, 4096
#: Ids of a longer document that are trained on in one piece.
PIECE = 1 << 15
#: Weights that are averaged in one task.
FAN_IN = 32
#: Counts of words that a task holds before it hands them on.
HELD_WORDS = 2_000_000


# --- the attention model ---


def vocabulary_tables(counts):
    """From the count of each id: its embedding row, its class, its log share within the class. Frequent ids have rows and classes of their own, the rest share them in bands of equal count."""
    import numpy as np

    n = counts + 0.05
    order = np.argsort(-n, kind="stable")
    cls = np.empty(len(n), np.int64)
    cls[order[:SINGLE]] = np.arange(SINGLE)
    rest = order[SINGLE:]
    mass = np.cumsum(n[rest])
    cls[rest] = SINGLE + np.minimum(BANDS * (mass - n[rest] / 2) / mass[-1], BANDS - 1).astype(np.int64)
    row = ROWS + cls
    row[order[:ROWS]] = np.arange(ROWS)
    share = np.log(n / np.bincount(cls, n, CLASSES)[cls])
    return row.astype(np.int32), cls.astype(np.int32), share.astype(np.float32)


PAD_ROW = ROWS + CLASSES
N_ROWS = PAD_ROW + 1
SHAPES = {"e": (N_ROWS, DIM), "q": (DIM, DIM), "k": (DIM, DIM), "v": (DIM, DIM), "u": (DIM, DIM), "b": (WINDOW,), "g": (DIM, GROUPS), "gb": (GROUPS,), "o": (GROUPS, DIM, MEMBERS), "c": (GROUPS, MEMBERS)}


def start_weights(seed: int = 11) -> dict:
    import numpy as np

    rng = np.random.default_rng(seed)
    return {k: (rng.normal(0, 0.3 if k == "e" else 1 / np.sqrt(DIM), s) if len(s) > 1 and k != "c" else np.zeros(s)).astype(np.float32) for k, s in SHAPES.items()}


def windows(ids, cuts, row, end: int):
    """Of texts given as flat ids that close with `end`: rows of WINDOW embedding rows, rows of STRIDE targets (-1: none), and each window's text."""
    import numpy as np

    lengths = np.diff(cuts)
    blocks = -(-lengths // STRIDE)
    lead = WINDOW - STRIDE
    base = np.concatenate([[0], np.cumsum(lead + blocks * STRIDE)])
    place = np.repeat((base[:-1] + lead - cuts[:-1]).astype(np.int32), lengths) + np.arange(len(ids), dtype=np.int32)
    inputs = np.full(base[-1], PAD_ROW, np.int32)
    targets = np.full(base[-1], -1, np.int32)
    targets[place] = ids
    rows = row[ids]
    inputs[place[1:]] = rows[:-1]
    inputs[(base[:-1] + lead)[lengths > 0]] = row[end]
    text = np.repeat(np.arange(len(lengths)), blocks)
    first = base[text] + (np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * STRIDE
    x = np.lib.stride_tricks.sliding_window_view(inputs, WINDOW)[first] if len(first) else np.zeros((0, WINDOW), np.int32)
    t = np.lib.stride_tricks.sliding_window_view(targets, STRIDE)[first + lead] if len(first) else np.zeros((0, STRIDE), np.int32)
    return x, t, text


def _geometry():
    """For each query of a window and each key: their distance, and whether the key comes later."""
    import numpy as np

    i, j = np.arange(STRIDE)[:, None] + WINDOW - STRIDE, np.arange(WINDOW)[None]
    return np.where(j <= i, i - j, 0), j > i


def lower(z, hidden=None):
    """Makes z (changed in place) safe for exp(): less each row's maximum, unless all of it is between -TOP and TOP. hidden entries of a row don't count."""
    import numpy as np

    if z.size and not (z.max() <= TOP and z.min() >= -TOP):
        z -= (z if hidden is None else np.where(hidden, -np.inf, z)).max(-1, keepdims=True)
        np.minimum(z, 0, out=z)


def log_probabilities(tables: dict, x, t, cls, share, most: int = 512):
    """Natural log of each target's probability; 0 where there is none."""
    import numpy as np

    distance, later = _geometry()
    bias, earlier = tables["b"][distance], (~later).astype(np.float32)
    out, ones = np.zeros(t.shape, np.float32), np.ones(WINDOW, np.float32)
    hidden = np.empty((min(most, len(x)), STRIDE, DIM), tables["qu"].dtype)
    for a in range(0, len(x), most):
        goals = t[a : a + most].ravel()
        for at in range(a, min(a + most, len(x)), NEAR):
            xb = x[at : min(at + NEAR, a + most)]
            qu, kv = tables["qu"].take(xb[:, WINDOW - STRIDE :], 0), tables["kv"].take(xb, 0)
            s = np.matmul(qu[..., :DIM], kv[..., :DIM].transpose(0, 2, 1))
            s += bias
            lower(s, later)
            np.exp(s, out=s)
            s *= earlier
            h = hidden[at - a : at - a + len(xb)]
            np.matmul(s, kv[..., DIM:], out=h)
            h /= (s.reshape(-1, WINDOW) @ ones).reshape(-1, STRIDE, 1)
            h += qu[..., DIM:]
            np.tanh(h, out=h)
        real = np.flatnonzero(goals >= 0)
        group, member = np.divmod(cls[goals[real]], MEMBERS)
        order, owner, place = blocks_of_groups(group)
        real, group, member = real[order], group[order], member[order]
        flat = in_blocks(hidden, real, owner, place)
        own = np.zeros(len(goals), np.float32)
        lp = share[goals[real]]
        for z, at in ((flat @ tables["g"] + tables["gb"], group), (member_logits(flat, tables["o"], tables["c"], owner), member)):
            lower(z)
            lp += z.ravel()[place * z.shape[1] + at]
            np.exp(z, out=z)
            lp -= np.log(z @ np.ones(z.shape[1], np.float32))[place]
        own[real] = lp
        out[a : a + most] = own.reshape(-1, STRIDE)
    return out


def blocks_of_groups(group):
    """Targets dealt to blocks of BLOCK rows that are of one group each: an order of the targets, the group of each block, and the row of each target in that order."""
    import numpy as np

    order, count = np.argsort(group.astype(np.uint8), kind="stable"), np.bincount(group, minlength=GROUPS)
    blocks = -(-count // BLOCK)
    ahead = (np.cumsum(blocks) - blocks) * BLOCK - (np.cumsum(count) - count)
    return order, np.repeat(np.arange(GROUPS), blocks), np.arange(len(group)) + np.repeat(ahead, count)


def in_blocks(h, real, owner, place):
    """The rows of h of those targets in their blocks; rows without a target hold any row."""
    import numpy as np

    source = np.zeros(len(owner) * BLOCK, np.int64)
    source[place] = real
    return h.reshape(-1, DIM).take(source, 0)


def member_logits(flat, o, c, owner):
    """Of rows in blocks of one group each: the logits of that group's members."""
    import numpy as np

    z = np.matmul(flat.reshape(-1, BLOCK, DIM), o.take(owner, 0))
    z += c.take(owner, 0)[:, None]
    return z.reshape(-1, MEMBERS)


def score_tables(w: dict) -> dict:
    """Of every embedding row: its query and direct term, its key and value."""
    import numpy as np

    return {"qu": w["e"] @ np.concatenate([w["q"] * np.float32(DIM**-0.5), w["u"]], 1), "kv": w["e"] @ np.concatenate([w["k"], w["v"]], 1)} | {k: w[k] for k in ("b", "g", "gb", "o", "c")}


def _sums_by_row(values, inverse, n: int, many: int = 32):
    """Sums of the rows of values (last axis kept) by their number below n, each of which occurs: numbers of more than `many` rows one by one, the others in pairs, pairs of pairs and so on, each level at once."""
    import numpy as np

    flat = inverse.ravel()
    values, place = values.reshape(-1, values.shape[-1]), np.argsort(flat.astype(np.uint16), kind="stable")
    count = np.bincount(flat, minlength=n)
    out, few = np.empty((n, values.shape[1]), values.dtype), count <= many
    start, ones = np.cumsum(count) - count, np.ones(count.max(initial=0), values.dtype)
    for r in np.flatnonzero(~few).tolist():
        np.matmul(ones[: count[r]], values.take(place[start[r] : start[r] + count[r]], 0), out=out[r])
    place, count = place[np.repeat(few, count)], count[few]
    while count.max(initial=0) > 1:
        half = (count + 1) >> 1
        one = 2 * np.arange(int(half.sum()))  # the first of each pair, and then its second; the last of a number may have none
        odd = np.cumsum(half)[count & 1 == 1] - 1
        one -= np.repeat(np.cumsum(count & 1) - (count & 1), half)
        two = one + 1
        two[odd] = one[odd]
        both = values.take(two if place is None else place[two], 0)
        both[odd] = 0
        both += values.take(one if place is None else place[one], 0)
        values, place, count = both, None, half
    out[few] = values if place is None else values.take(place, 0)
    return out


def _numbered(x, n: int = N_ROWS):
    """The distinct embedding rows in x and each one's place among them."""
    import numpy as np

    seen = np.zeros(n, bool)
    seen[x] = True
    return np.flatnonzero(seen), (np.cumsum(seen, dtype=np.int32) - 1)[x]


def gradients(w: dict, x, t, cls) -> tuple[float, dict]:
    """Mean cross entropy of the targets' classes and its gradient. What depends on an embedding row alone is computed once a row, and so is what follows from the errors at its places: they are added up first."""
    import numpy as np

    distance, later = _geometry()
    scale = np.float32(DIM**-0.5)
    rows, inverse = _numbered(x)
    asking = inverse[:, WINDOW - STRIDE :]
    e = w["e"][rows]
    ask, answer = np.concatenate([w["q"] * scale, w["u"]], 1), np.concatenate([w["k"], w["v"]], 1)
    ask_rows, answer_rows, bias, earlier = e @ ask, e @ answer, w["b"][distance], (~later).astype(e.dtype)
    att, h = np.empty((len(x), STRIDE, WINDOW), e.dtype), np.empty((len(x), STRIDE, DIM), e.dtype)
    parts = [slice(at, at + NEAR) for at in range(0, len(x), NEAR)]
    for own in parts:
        qu, kv, a = ask_rows.take(asking[own], 0), answer_rows.take(inverse[own], 0), att[own]
        np.matmul(qu[..., :DIM], kv[..., :DIM].transpose(0, 2, 1), out=a)
        a += bias
        lower(a, later)
        np.exp(a, out=a)
        a *= earlier
        a /= (a.reshape(-1, WINDOW) @ np.ones(WINDOW, a.dtype)).reshape(-1, STRIDE, 1)
        np.matmul(a, kv[..., DIM:], out=h[own])
        h[own] += qu[..., DIM:]
        np.tanh(h[own], out=h[own])
    goals = t.ravel()
    real = np.flatnonzero(goals >= 0)
    group, member = np.divmod(cls[goals[real]], MEMBERS)
    order, owner, place = blocks_of_groups(group)
    group, member, real = group[order], member[order], real[order]
    n = max(1, len(group))
    flat = in_blocks(h, real, owner, place)

    def softmax_error(z, at):
        """The loss, and the gradient in z, where rows without a target have none."""
        lower(z)
        np.exp(z, out=z)
        share, own = np.zeros(len(z), z.dtype), place * z.shape[1] + at
        share[place] = 1 / (z @ np.ones(z.shape[1], z.dtype))[place]
        p = z.ravel()[own] * share[place]
        z *= (share / n)[:, None]
        z.ravel()[own] -= z.dtype.type(1 / n)
        return -np.log(np.maximum(p, 1e-30)).sum(), z

    loss, p = softmax_error(flat @ w["g"] + w["gb"], group)
    more, pm = softmax_error(member_logits(flat, w["o"], w["c"], owner), member)
    loss = (loss + more) / n
    pm = pm.reshape(-1, BLOCK, MEMBERS)
    of_group = (owner == np.arange(GROUPS)[:, None]).astype(h.dtype)
    g = {"g": flat.T @ p, "gb": np.ones(len(p), p.dtype) @ p, "c": of_group @ np.matmul(np.ones(BLOCK, pm.dtype), pm)}
    g["o"] = (of_group @ np.matmul(flat.reshape(-1, BLOCK, DIM).transpose(0, 2, 1), pm).reshape(len(owner), DIM * MEMBERS)).reshape(w["o"].shape)
    dflat = np.matmul(pm, w["o"].transpose(0, 2, 1).copy().take(owner, 0)).reshape(-1, DIM)
    dflat += p @ w["g"].T
    flat *= flat
    np.subtract(1, flat, out=flat)
    dflat *= flat
    dqu, dkv, db = np.empty((len(x), STRIDE, 2 * DIM), h.dtype), np.empty((len(x), WINDOW, 2 * DIM), h.dtype), 0
    dqu.reshape(-1, 2 * DIM)[real, DIM:] = dflat.take(place, 0)
    dqu.reshape(-1, 2 * DIM)[goals < 0, DIM:] = 0
    for own in parts:
        q, kv, a, d = ask_rows.take(asking[own], 0)[..., :DIM], answer_rows.take(inverse[own], 0), att[own], dqu[own, :, DIM:]
        ds = np.matmul(d, kv[..., DIM:].transpose(0, 2, 1))
        ds -= np.einsum("nij,nij->ni", ds, a)[..., None]
        ds *= a  # 0 for later keys, as a is
        db = db + np.ones(len(ds), ds.dtype) @ ds.reshape(len(ds), -1)
        np.matmul(ds, kv[..., :DIM], out=dqu[own, :, :DIM])
        np.matmul(ds.transpose(0, 2, 1), q, out=dkv[own, :, :DIM])
        np.matmul(a.transpose(0, 2, 1), d, out=dkv[own, :, DIM:])
    g["b"] = np.bincount(distance.ravel(), db, WINDOW).astype(np.float32)
    asked, own = _numbered(asking, len(rows))
    dqu, dkv = _sums_by_row(dqu, own, len(asked)), _sums_by_row(dkv, inverse, len(rows))
    of_ask, of_answer = e[asked].T @ dqu, e.T @ dkv
    g["q"], g["u"], g["k"], g["v"] = of_ask[:, :DIM] * scale, of_ask[:, DIM:], of_answer[:, :DIM], of_answer[:, DIM:]
    de = dkv @ answer.T
    de[asked] += dqu @ ask.T
    g["e"] = (rows, de)
    return float(loss), g


def train(w: dict, x, t, cls, rate: float, seed: int, batch: int = 512, epochs: int = 1) -> dict:
    """Adam over shuffled windows; embedding rows are updated only when met."""
    import numpy as np

    names = [k for k in SHAPES if k != "e"]
    every, e = np.concatenate([w[k].ravel() for k in names]), w["e"].copy()  # all weights but the rows are one array to Adam
    cuts = np.cumsum([0] + [w[k].size for k in names])
    w = {k: every[a:z].reshape(w[k].shape) for k, a, z in zip(names, cuts[:-1], cuts[1:])} | {"e": e}
    (m, u), (me, ue) = ([np.zeros_like(v), np.zeros_like(v)] for v in (every, e))
    rng = np.random.default_rng(seed)
    steps, step = epochs * -(-len(x) // batch), 0

    def move(m, u, g, now):
        m *= 0.9
        m += 0.1 * g
        u *= 0.98
        g *= g
        g *= 0.02
        u += g
        by = np.sqrt(u / (1 - 0.98**step))
        by += 1e-8
        np.divide(m, by, out=by)
        by *= now / (1 - 0.9**step)
        return by

    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            own = order[at : at + batch]
            _, g = gradients(w, x.take(own, 0), t.take(own, 0), cls)
            now = rate * (1 - step / steps) + rate / 50
            step += 1
            rows, grad = g["e"]
            mr, ur = me[rows], ue[rows]
            e[rows] -= move(mr, ur, grad, now)
            me[rows], ue[rows] = mr, ur
            every -= move(m, u, np.concatenate([g[k].ravel() for k in names]), now)
    return {k: w[k].copy() for k in SHAPES}


def pack_weights(w: dict) -> bytes:
    return b"".join(w[k].astype("<f4").tobytes() for k in SHAPES)


def unpack_weights(data: bytes) -> dict:
    import numpy as np

    out, at = {}, 0
    flat = np.frombuffer(data, "<f4")
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k], at = flat[at : at + n].reshape(s), at + n
    return out


# --- over the corpus ---


def _first_pass(path: str, vocabulary: int, end: int):
    """Rows of kind 0: a document with its ids and words; 1: a word hash and its count in training documents of a batch; 2: the same for ids."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        keep_memory()
        coder, seen = shared_tokenizer(path), np.zeros(vocabulary, np.int64)
        held: list = []
        for b in small_batches(batches, "text", 5 << 20):
            train = np.asarray(b.column("train").to_numpy(zero_copy_only=False), bool)
            unique, codes, offsets = coded_words(b.column("text"))
            lower, h = word_hashes(unique)
            ids, cuts = coder.encode(b.column("text"), end, (unique, codes, offsets, lower, h))
            used = np.repeat(train, np.diff(cuts))
            seen += np.bincount(ids[used], minlength=vocabulary)
            held.append((h.view(np.int64), np.bincount(codes[np.repeat(train, np.diff(offsets))], minlength=len(unique))))
            raw = ids.astype(id_type(vocabulary))
            rows = [raw[a:z].tobytes() for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
            yield _rows(kind=np.zeros(len(rows), np.int32), id=b.column("id"), row=b.column("row"), train=b.column("train"), text=b.column("text"), ids=pa.array(rows, pa.binary()))
            if sum(len(h) for h, _ in held) > HELD_WORDS:
                yield _counted(held)
                held = []
        if held:
            yield _counted(held)
        some = np.flatnonzero(seen)
        yield _rows(kind=np.full(len(some), 2, np.int32), key=some, n=seen[some])

    return run


def _counted(held):
    import numpy as np

    h, n = (np.concatenate(x) for x in zip(*held))
    key, at = np.unique(h, return_inverse=True)
    n = np.bincount(at, n, len(key)).astype(np.int64)
    some = np.flatnonzero(n)
    return _rows(kind=np.ones(len(some), np.int32), key=key[some], n=n[some])


_KINDS = {"kind": "int32", "id": "int64", "row": "int64", "train": "bool_", "text": "string", "ids": "binary", "key": "int64", "n": "int64"}


def _rows(**columns):
    import pyarrow as pa

    n = len(columns["kind"])
    columns = {c: v if isinstance(v, pa.Array) else pa.array(v) for c, v in columns.items()}
    arrays = [columns[c].cast(getattr(pa, t)()) if c in columns else pa.nulls(n, getattr(pa, t)()) for c, t in _KINDS.items()]
    return pa.RecordBatch.from_arrays(arrays, names=list(_KINDS))


def id_type(vocabulary: int) -> str:
    """How ids of a vocabulary are kept."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def joined_ids(column, kind: str):
    """Flat ids and offsets of a column of buffers of ids."""
    import numpy as np

    rows = [x or b"" for x in column.to_pylist()]
    cuts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, rows), np.int64, len(rows)) // np.dtype(kind).itemsize)])
    return np.frombuffer(b"".join(rows), kind).astype(np.int64), cuts


def n_shards(n_ids: int) -> int:
    """In proportion to the ids up to MANY, with their square root beyond: neither shards nor their number grow too large."""
    each = max(1, round(n_ids / SHARD_IDS))
    return each if each <= MANY else round((each * MANY) ** 0.5)


def shards(documents: DataFrame, number: int, kind: str) -> DataFrame:
    """(shard, key, ids) of training documents (id, ids), those of more than PIECE ids in pieces. Shard and key depend on nothing but id and ids."""
    import numpy as np

    size = np.dtype(kind).itemsize * PIECE
    key = F.xxhash64("id", F.xxhash64("ids"))
    pieces = documents.filter(F.octet_length("ids") > 0).select(key.alias("key"), F.explode(F.sequence(F.lit(0), F.expr(f"cast((octet_length(ids) - 1) div {size} as int)"))).alias("piece"), "ids")
    pieces = pieces.select(F.xxhash64("key", "piece").alias("key"), F.substring("ids", F.col("piece") * size + 1, F.lit(size)).alias("ids"))
    return pieces.select(F.pmod(F.xxhash64("key"), F.lit(number)).alias("shard"), "key", "ids")


_WEIGHTS = "shard long, n long, data binary"


def _trained(weights: dict, rows, row, cls, end: int, kind: str, rate: float, epochs: int = 1):
    """Weights after a shard's documents (a pyarrow table of key and ids), SHARD_IDS at a time, and how many ids they were."""
    import numpy as np

    rows = rows.sort_by("key")
    ids, cuts = joined_ids(rows["ids"].combine_chunks(), kind)
    at, w = 0, weights
    while at < rows.num_rows:
        z = max(at + 1, int(np.searchsorted(cuts, cuts[at] + 2 * SHARD_IDS, "right")) - 1)
        x, t, _ = windows(ids[cuts[at] : cuts[z]], cuts[at : z + 1] - cuts[at], row, end)
        w = train(w, x, t, cls, rate, at, epochs=epochs)
        at = z
    return w, len(ids)


def _shard_training(weights: dict, row, cls, end: int, kind: str):
    def run(rows):
        import pyarrow as pa

        keep_memory()
        w, n = _trained(weights, rows, row, cls, end, kind, 0.002)
        return pa.table({"shard": pa.array([rows["shard"][0].as_py()], pa.int64()), "n": pa.array([n], pa.int64()), "data": pa.array([pack_weights(w)], pa.binary())})

    return run


def _average(rows):
    """The average of up to FAN_IN weights by size, added in the order of their shards."""
    import numpy as np
    import pyarrow as pa

    rows = rows.sort_by("shard")
    total, n = 0.0, 0
    for r in rows.to_pylist():
        total, n = total + np.frombuffer(r["data"], "<f4").astype(np.float64) * r["n"], n + r["n"]
    return pa.table({"shard": pa.array([rows["shard"][0].as_py() // FAN_IN], pa.int64()), "n": pa.array([n], pa.int64()), "data": pa.array([(total / max(1, n)).astype("<f4").tobytes()], pa.binary())})


def learn_weights(documents: DataFrame, n_ids: int, row, cls, end: int, kind: str) -> dict:
    """Weights from (id, ids) of all training documents: the start from the first shard, then the average of what all shards learn from it."""
    number = n_shards(n_ids)
    dealt = shards(documents, number, kind)  # dealt twice from a written table, which costs less than to write it again
    first = dealt.filter("shard = 0").select("key", "ids").toArrow()  # about 2 * SHARD_IDS ids at most, or a square root's share of all
    w = start_weights()
    if first.num_rows:
        w, _ = _trained(w, first, row, cls, end, kind, 0.01, epochs=2)
    sums = materialize(dealt.groupBy("shard").applyInArrow(_shard_training(w, row, cls, end, kind), _WEIGHTS), "lm-weights")
    while number > 1:
        sums = sums.groupBy(F.floor(F.col("shard") / FAN_IN).alias("above")).applyInArrow(_average, _WEIGHTS)
        number = -(-number // FAN_IN)
    found = sums.head()
    return unpack_weights(bytes(found["data"])) if found else w


def _second_pass(weights: dict, row, cls, share, head_h, head_n, end: int, kind: str):
    tables = score_tables(weights)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        keep_memory()
        for b in small_batches(batches, "text", 5 << 20):
            n = b.num_rows
            ids, cuts = joined_ids(b.column("ids"), kind)
            x, t, text = windows(ids, cuts, row, end)
            score = np.bincount(text, log_probabilities(tables, x, t, cls, share).sum(1, dtype=np.float64), n) / np.log(10)
            unique, codes, offsets = coded_words(b.column("text"))
            h = word_hashes(unique)[1].view(np.int64)
            at = np.minimum(np.searchsorted(head_h, h), max(len(head_h) - 1, 0))
            known = head_h[at] == h if len(head_h) else np.zeros(len(h), bool)
            c = np.where(known, head_n[at], 0) if len(head_h) else np.zeros(len(h), np.int64)
            own = np.repeat(np.arange(n), np.diff(offsets))
            mine = known[codes]
            logs = np.bincount(own[mine], np.log10(c + 0.1)[codes[mine]], n)
            n_known = np.bincount(own[mine], minlength=n)
            key, same = np.unique(h, return_inverse=True)  # words that differ in A-Z only are one
            pair, times = np.unique(own[~mine] * np.int64(max(1, len(key))) + same[codes[~mine]], return_counts=True)
            pair_cuts = np.searchsorted(pair, np.arange(n + 1) * np.int64(max(1, len(key))))
            rest = pa.ListArray.from_arrays(pa.array(pair_cuts.astype(np.int32)), pa.array(key[pair % max(1, len(key))]))
            counts = pa.ListArray.from_arrays(pa.array(pair_cuts.astype(np.int32)), pa.array(times.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("row"), b.column("train"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(n_known.astype(np.int64)), pa.array(logs.astype(float)), pa.array(score.astype(float)), rest, counts], names=["id", "row", "train", "words", "known", "logs", "score", "rest", "times"])

    return run


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The words of the highest counts, `most` at most: a histogram of the counts' logarithms tells from which count on, so nothing is sorted."""
    band = F.floor(F.log2("n") * 16)
    cut, total = 1 << 20, 0
    for r in sorted(counts.groupBy(band.alias("b")).agg(F.count("*").alias("m")).collect(), reverse=True):  # a thousand rows at most
        total += r["m"]
        if total > most:
            break
        cut = r["b"]
    return counts.filter(band >= cut)


def score_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, mod: int = 10, held: int = 0, head: int = HEAD) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    Learned from all rows with crc32(id) mod `mod` other than `held` (a null id is never held out). Null counts as
    empty: one token, the end, which is the tokenizer's last id. Long texts are scored whole, and trained on in pieces
    of PIECE ids. Repeated rows count and are scored each by itself, alike. Without any training row every base score is
    0 and the attention model is untrained; an empty table gives an empty result. Other columns play no part, whatever
    their names. The same rows give the same weights, however they are partitioned.
    """
    import numpy as np
    from tokenizers import Tokenizer

    path = tokenizer or default_path()
    vocabulary = Tokenizer.from_file(path).get_vocab_size()
    end, kind = vocabulary - 1, id_type(vocabulary)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), (crc_mod(id_col, mod) != held).alias("train"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = "kind int, id long, row long, train boolean, text string, ids binary, key long, n long"
    first = materialize(map_texts(rows, _first_pass(path, vocabulary, end), schema), "lm-first")
    documents = first.filter("kind = 0")
    counts = materialize(first.filter("kind = 1").groupBy("key").agg(F.sum("n").alias("n")), "lm-words")
    totals = counts.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).head()
    ends = documents.filter("train").count()
    n_all, v_all = totals["n"] + ends, totals["v"] + (ends > 0)
    ids = np.zeros(vocabulary)
    for r in first.filter("kind = 2").groupBy("key").agg(F.sum("n").alias("n")).collect():  # a row an id of the tokenizer at most
        ids[r["key"]] = r["n"]
    row, cls, share = vocabulary_tables(ids)
    weights = learn_weights(documents.filter("train").select("id", "ids"), int(ids.sum()), row, cls, end, kind)
    top = most_frequent(counts, head).toArrow()
    head_h, head_n = top["key"].to_numpy(), top["n"].to_numpy()
    order = np.argsort(head_h)
    second = map_texts(documents.select("id", "row", "train", "text", "ids"), _second_pass(weights, row, cls, share, head_h[order], head_n[order], end, kind), "id long, row long, train boolean, words long, known long, logs double, score double, rest array<long>, times array<int>")
    second = materialize(second, "lm-second")
    if v_all - (ends > 0) > head:
        pairs = second.select("row", F.explode(F.arrays_zip("rest", "times")).alias("p")).select("row", F.col("p.rest").alias("key"), F.col("p.times").alias("times"))
        found = pairs.join(counts, "key").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 0.1)).alias("more_logs"))
        second = second.join(found, "row", "left")
    else:  # every word is in the head
        second = second.withColumns({"more": F.lit(None).cast("long"), "more_logs": F.lit(None).cast("double")})
    unknown = F.aggregate("times", F.lit(0).cast("long"), lambda a, x: a + x) - F.coalesce("more", F.lit(0))
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) + unknown * F.log10(F.lit(0.1)) + F.log10(F.lit(ends + 0.1))
    n_tokens = F.col("words") + 1
    return second.select(
        F.col("id").alias(id_col), (~F.col("train")).alias("held_out"), n_tokens.alias("n_tokens"), (F.col("known") + F.coalesce("more", F.lit(0)) + (1 if ends else 0)).alias("n_known"),
        F.lit(int(n_all)).cast("long").alias("train_tokens"), (logs - n_tokens * F.log10(F.lit(n_all + 0.1 * (v_all + 1)))).alias("base_score"), "score",
    )
