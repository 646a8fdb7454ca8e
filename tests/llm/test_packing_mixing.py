import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from framewright.llm import ann, mixing, packing, tokens

from .test_dedup import words
from .test_models import frame


def fewest(items, capacity):
    best = [len(items)]
    items = sorted(items, reverse=True)

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for room in set(rooms):
            if room >= items[i]:
                left = list(rooms)
                left.remove(room)
                go(i + 1, left + [room - items[i]])
        go(i + 1, rooms + [capacity - items[i]])

    go(0, [])
    return best[0]


def test_reduction_keeps_the_optimum():
    rng = random.Random(1)
    for _ in range(300):
        capacity = rng.choice((10, 20, 30))
        items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 10))]
        fixed, left = packing.reduce_by_dominance(Counter(items), capacity)
        rest = [k for k, n in left.items() for _ in range(n)]
        assert sum(n for n, _ in fixed) + (fewest(rest, capacity) if rest else 0) == fewest(items, capacity)
        plan = packing.plan(Counter(items), capacity)
        used = Counter()
        for n, own in plan:
            assert sum(own) <= capacity
            used.update({k: n * own.count(k) for k in set(own)})
        assert used == Counter(items)


def test_plans_stay_small():
    rng = random.Random(3)
    counts = {n: rng.randint(0, 10**6) for n in range(1, 2049)}
    plan = packing.plan(counts)
    assert len(packing.places(plan)) < 20000
    assert sum(n for n, _ in plan) < 1.01 * sum(k * n for k, n in counts.items()) / 2048


def test_packing(spark, data):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()] + [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "wort " * 50000), (5, "again"), (None, "no id")]
    got = packing.pack(frame(spark, rows, "doc_id long, text string"), keep_ids=True).collect()
    tok = Tokenizer.from_file(tokens.default_path())
    want = sorted([*tok.encode(t or "", add_special_tokens=False).ids, 0] for _, t in rows)
    by_doc = {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        ids = np.array(r["ids"], "<u4")
        assert len(ids) == r["length"] <= 2048 and zlib.crc32(ids.tobytes()) == r["ids_crc32"] and r["start"] == 2048 * r["piece"]
    assert sorted(sum((r["ids"] for r in sorted(p, key=lambda r: r["piece"])), []) for i, p in by_doc.items() if i != 5) == sorted(w for w, (i, _) in zip([[*tok.encode(t or "", add_special_tokens=False).ids, 0] for _, t in rows], rows) if i != 5)
    assert sum(r["length"] for r in got) == sum(map(len, want))
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-sum(map(len, want)) // 2048) + 2
    assert packing.pack(frame(spark, [], "doc_id long, text string")).count() == 0


def test_tokens_equal_whole_texts():
    rng = random.Random(1)
    parts = [chr(c) for c in [*range(1, 0x180), 0x301, 0x3A3, 0x130, 0x1C5, 0xFB01, 0x3000, 0x85, 0x1C, 0x4E2D, 0x1F600, 0x212B]] + ["<|endoftext|>", "<|STARTOFTEXT|>", "'s", "'LL", " ", "\n", ".", "the "] * 8
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    tok = Tokenizer.from_file(tokens.default_path())
    ids, cuts = tokens.WordTokenizer(tokens.default_path()).encode(pa.array([*texts, None]))
    for i, t in enumerate(texts):
        assert ids[cuts[i] : cuts[i + 1]].tolist() == tok.encode(t, add_special_tokens=False).ids


# --- mixing ---


def targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = dict(zip(names, (5, 2, 1) * len(names)))
    target, free, left = {}, set(names), 1.5 * sum(sizes.values())
    while free:
        level = left / sum(weight[n] for n in free)
        over = [n for n in free if level * weight[n] > 2 * sizes[n]]
        for n in over or free:
            target[n] = 2.0 * sizes[n] if over else level * weight[n]
            left -= target[n] if over else 0
        free -= set(over) if over else free
    return target


def test_mixing(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * int(rng.paretovariate(1.1) * 5)) if rng.random() > 0.02 else rng.choice((None, "", " \n")), rng.choice(["a", "b", "c", "é", None, "a", "a"])) for i in range(3000)]
    rows += [(7, "x y", "a"), (7, "x y", "a"), (None, "x y z", "b"), (9999, "w " * 60000, "c")]
    df = frame(spark, rows, "doc_id long, text string, source string", ("target", "rate", "_c", "_docs", "size"))
    got = mixing.mix(df).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    want, source = targets(sizes), {i: s for i, _, s in rows}
    taken = Counter()
    for r in got:
        s = "b" if r["doc_id"] is None else source[r["doc_id"]]
        assert r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        taken[s] += r["taken"]
    assert all(taken[s] == pytest.approx(want[s], rel=0.02) for s in want)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(7)).collect()))
    rows_out = mixing.repeat_by_mix(df)
    assert rows_out.columns == df.columns and rows_out.count() == sum(r["copies"] for r in got)


def test_mixing_edges(spark):
    ddl = "doc_id long, text string, source string"
    assert mixing.mix(frame(spark, [], ddl)).count() == mixing.repeat_by_mix(frame(spark, [], ddl)).count() == 0
    got = mixing.mix(frame(spark, [(1, None, None), (2, "", "a")], ddl)).collect()
    assert [(r["taken"], r["target"]) for r in got] == [(0, 0.0)] * 2


# --- neighbours ---


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[100:1000] = x[100]  # a vector that many rows have
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(5000, None), (5020, [0.0] * 16), (5040, [float("nan")] + [1.0] * 15), (5060, [1.0, None] + [1.0] * 14), (5080, [1.0] * 3), (None, [1.0] * 16)]
    df = frame(spark, rows, "vec_id long, embedding array<float>", ("key", "cid", "vec", "query"))
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, leaf=256).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    x = x.astype(float)
    assert sorted(got) == list(range(0, 3000, 20))
    hits = 0
    for q, own in got.items():
        own.sort()
        assert [r for r, _, _ in own] == list(range(1, 21)) and q not in [v for _, v, _ in own]
        s = x @ x[q]
        assert np.allclose([s[v] for _, v, _ in own], [z for _, _, z in own], atol=1e-12)
        assert own == sorted(own, key=lambda r: (-r[2], r[1]))
        s[q] = -np.inf
        best = np.lexsort((np.arange(len(s)), -np.round(s, 12)))[:20]
        hits += len(set(best.tolist()) & {v for _, v, _ in own})
    assert hits / (20 * len(got)) >= 0.9


def test_few_or_no_vectors(spark):
    ddl = "vec_id long, embedding array<float>"
    assert ann.nearest(frame(spark, [], ddl), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.nearest(frame(spark, [(0, [1.0])], ddl), F.col("vec_id") % 20 == 0).count() == 0
    got = ann.nearest(frame(spark, [(0, [1.0, 0.0]), (3, [0.5, 0.0]), (2, [0.5, 0.0]), (20, [1.0, 0.0])], ddl), F.col("vec_id") % 20 == 0).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == [(0, 1, 20, 1.0), (0, 2, 2, 0.5), (0, 3, 3, 0.5), (20, 1, 0, 1.0), (20, 2, 2, 0.5), (20, 3, 3, 0.5)]
