"""Quality classifier: a factorisation machine.

Inputs: hashed words (log counts, scaled to length 1 a document) and statistics of the text's structure, its length
among them. The score adds all pairwise interactions through vectors of FACTORS numbers an input, in linear time: half
of the sum over factors of (sum v x)^2 - sum (v x)^2.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, map_texts, small_batches, split_words, texts_of

BUCKETS = 2048
FACTORS = 8
#: Labelled rows to learn from, at most; those of the smallest hashes are taken.
MAX_TRAIN_ROWS = 8000
EPOCHS = 12
STATS = 16


@lru_cache(1)
def _classes():
    """Class of each byte: 0 lower case, 1 upper case, 2 digit, 3 white space, 4 mark that ends or divides a sentence, 5 other ASCII, 6 beyond ASCII."""
    import numpy as np

    t = np.full(256, 5, np.int64)
    t[97:123], t[65:91], t[48:58], t[128:] = 0, 1, 2, 6
    t[[9, 10, 11, 12, 13, 32]] = 3
    t[[33, 39, 44, 46, 58, 59, 63]] = 4
    return t


def inputs(batch, text_col: str):
    """A row of BUCKETS + STATS numbers for each text; statistics are not yet scaled."""
    import numpy as np
    import xxhash

    texts = texts_of(batch, text_col)
    n = len(texts)
    words, offsets = split_words(batch.column(text_col))
    per = np.diff(offsets)
    doc = np.repeat(np.arange(n), per)
    coded = words.dictionary_encode()
    unique = coded.dictionary.to_pylist()
    bucket = np.fromiter((xxhash.xxh64_intdigest(w.lower()) % BUCKETS for w in unique), np.int64, len(unique))
    size = np.fromiter((len(w) for w in unique), np.int64, len(unique))
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    x = np.log1p(np.bincount(doc * BUCKETS + bucket[code], minlength=n * BUCKETS).reshape(n, BUCKETS).astype(np.float32))
    x /= np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-6)
    raw = [t.encode("utf-8", "replace") for t in texts]
    length = np.fromiter(map(len, raw), np.int64, n)
    kinds = np.bincount(np.repeat(np.arange(n), length) * 7 + _classes()[np.frombuffer(b"".join(raw), np.uint8)], minlength=n * 7).reshape(n, 7)
    s = np.zeros((n, STATS), np.float32)
    s[:, :7] = kinds / np.maximum(length, 1)[:, None]
    s[:, 7], s[:, 8] = np.log1p(length), np.log1p(per)
    w = np.maximum(per, 1)
    letters = np.bincount(doc, size[code], minlength=n)
    s[:, 9] = letters / w
    s[:, 10] = np.sqrt(np.maximum(np.bincount(doc, size[code] ** 2.0, minlength=n) / w - s[:, 9] ** 2, 0))
    distinct = np.bincount(np.unique(doc * (len(unique) + 1) + code) // (len(unique) + 1), minlength=n)
    s[:, 11] = distinct / w
    for i, t in enumerate(texts):
        lines = [y for y in t.split("\n") if y]
        if lines:
            s[i, 12], s[i, 13] = len(set(lines)) / len(lines), np.log1p(len(lines))
            s[i, 14] = sum(y.rstrip()[-1:] in ".!?" for y in lines) / len(lines)
    s[:, 15] = kinds[:, 1] / np.maximum(kinds[:, 0] + kinds[:, 1], 1)
    return np.hstack([x, s])


def _training_inputs(batches):
    import numpy as np
    import pyarrow as pa

    for b in small_batches(batches, "text", 1 << 20):
        x = inputs(b, "text").astype(np.float16)
        yield pa.RecordBatch.from_arrays([b.column("label"), pa.array([r.tobytes() for r in x], pa.binary())], names=["label", "x"])


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, mod: int, held: int, most: int) -> DataFrame:
    """(text, label) of at most `most` labelled rows: labels with the smallest hashes of their id, one an id (the smaller label if they differ)."""
    picked = labels.filter((crc_mod(id_col, mod) != held) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    picked = picked.groupBy(F.col(id_col).alias("_i")).agg(F.min(label_col).cast("int").alias("label")).orderBy(F.xxhash64("_i"), "_i").limit(most)
    rows = docs.select(F.col(id_col).alias("_d"), F.col(text_col).alias("text")).join(F.broadcast(picked), F.col("_d") == F.col("_i"))
    return rows.orderBy(F.xxhash64("_i"), "_i", F.xxhash64("text")).limit(most).select("text", "label")


def fit(x, y, factors: int = FACTORS, epochs: int = EPOCHS, seed: int = 7) -> dict:
    """Logistic loss, Adam, mini-batches of 128. With a single class the model is that class's constant."""
    import numpy as np

    if len(y) == 0 or y.min() == y.max():
        p = 0.5 if len(y) == 0 else (0.99 if y[0] else 0.01)
        return {"constant": p}
    mean, dev = x[:, BUCKETS:].mean(0), x[:, BUCKETS:].std(0) + 1e-3
    x = scaled(x, mean, dev)
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    params = {"b": np.zeros(1, np.float32), "w": np.zeros(d, np.float32), "v": rng.normal(0, 0.02, (d, factors)).astype(np.float32)}
    m, u = ({k: np.zeros_like(v) for k, v in params.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        rate = 0.01 * (1 - epoch / epochs)
        for at in range(0, len(order), 128):
            own = order[at : at + 128]
            xb, yb = x[own], y[own]
            s = xb @ params["v"]
            x2 = xb * xb
            z = params["b"] + xb @ params["w"] + 0.5 * (s * s - x2 @ (params["v"] ** 2)).sum(1)
            g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - yb) / len(own)).astype(np.float32)
            grads = {"b": g.sum(keepdims=True), "w": xb.T @ g + 1e-5 * params["w"], "v": xb.T @ (g[:, None] * s) - params["v"] * (x2.T @ g)[:, None] + 1e-4 * params["v"]}
            step += 1
            for k, gk in grads.items():
                m[k] += 0.1 * (gk - m[k])
                u[k] += 0.01 * (gk * gk - u[k])
                params[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(u[k] / (1 - 0.99**step)) + 1e-6)
    return params | {"mean": mean, "dev": dev}


def scaled(x, mean, dev):
    import numpy as np

    x = x.astype(np.float32)
    x[:, BUCKETS:] = np.clip((x[:, BUCKETS:] - mean) / dev, -4, 4) / 4
    return x


def score(model: dict, x):
    """Probability of label 1 for each row of inputs()."""
    import numpy as np

    if "constant" in model:
        return np.full(len(x), model["constant"])
    x = scaled(x, model["mean"], model["dev"])
    s = x @ model["v"]
    z = model["b"] + x @ model["w"] + 0.5 * (s * s - (x * x) @ (model["v"] ** 2)).sum(1)
    return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", mod: int = 3, held: int = 1, max_train_rows: int = MAX_TRAIN_ROWS) -> dict:
    """The model, fitted on the driver to at most max_train_rows labelled rows, held-out rows excluded."""
    import numpy as np

    rows = map_texts(training_rows(docs, labels, id_col, text_col, label_col, mod, held, max_train_rows), _training_inputs, "label int, x binary").toArrow()
    x = np.frombuffer(b"".join(rows["x"].to_pylist()), np.float16).reshape(rows.num_rows, BUCKETS + STATS).astype(np.float32)
    y = rows["label"].to_numpy().astype(np.float32)
    del rows
    order = np.lexsort((x[:, BUCKETS + 7], x[:, BUCKETS + 9], y)) if len(y) else np.arange(0)  # the order in which rows arrive doesn't matter
    return fit(x[order], y[order])


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", mod: int = 3, held: int = 1, max_train_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """id, held_out, score, predicted for every row of docs.

    Only text is scored; null counts as empty. Without any label, or with one class only, the score is a constant.
    A row with a null id is never held out. Texts are read whole; repeated rows are scored each by itself, alike; a score
    of exactly 0.5 is predicted as 1. An empty table gives an empty result; columns other than those named play no part,
    whatever their names.
    """
    model = learn(docs, labels, id_col, text_col, label_col, mod, held, max_train_rows)
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        import pyarrow as pa

        for b in small_batches(batches, "text", 2 << 20):
            p = score(model, inputs(b, "text"))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("held_out"), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype("int32"))], names=["id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("id"), (crc_mod(id_col, mod) == held).alias("held_out"), F.col(text_col).alias("text"))
    return map_texts(rows, run, f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)
