import hashlib
import random
import re

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from framewright.llm import components, exact_dedup, queries, simhash, substring

from ..oracle import both, connect

#: A column of each name that the operators use inside, to clash with.
CLASH = ("maybe", "_row", "_k", "h", "r", "fp", "_n", "w", "bits", "score", "part", "text_sha256")
DDL = "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASH)


def docs(spark, rows, ddl=DDL):
    return spark.createDataFrame([(i, t, *["x"] * len(CLASH)) for i, t in rows], ddl)


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


EDGES = [(5, "a b"), (3, "ab"), (4, "a  b"), (9, None), (8, ""), (7, " \n"), (1, "long " * 30000), (2, "long " * 30000 + "x"), (11, "one"), (11, "one"), (None, "two"), (None, "two")]


def test_exact_matches_sql(spark, data):
    df = queries.op6_exact_dedup(spark, data)
    ours, theirs = both(df, connect(data), queries.ORACLE_SQL["op6_exact_dedup"])
    assert ours == theirs


@pytest.mark.parametrize("bits", [64, 1 << 27])
def test_exact_edges_even_with_a_full_filter(spark, bits):
    got = exact_dedup.exact_duplicates(docs(spark, EDGES), filter_bits=bits).collect()
    assert len(got) == len(EDGES)
    bare = {i: re.sub("[\x20\x09-\x0d]", "", t or "") for i, t in EDGES}
    for r in got:
        mates = [(i, t or "") for i, t in EDGES if re.sub("[\x20\x09-\x0d]", "", t or "") == bare[r["doc_id"]]]
        best = min(mates, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0]
        assert (r["group_size"], r["keep_id"], r["text_sha256"]) == (len(mates), best, hashlib.sha256(bare[r["doc_id"]].encode()).hexdigest())
    texts = {}
    for r in got:
        texts.setdefault(r["text_sha256"], []).append(r["kept"])
    assert all(sum(k) == 1 for k in texts.values())
    left = exact_dedup.drop_exact_duplicates(docs(spark, EDGES), filter_bits=bits)
    assert left.columns == docs(spark, []).columns and left.count() == len(texts)


@pytest.mark.parametrize("most", [0, 100_000])
def test_dropping_keeps_one_row_of_each_text(spark, monkeypatch, most):
    monkeypatch.setattr(exact_dedup, "BROADCAST_GROUPS", most)
    rows = [(i, t, f"{i}-{n}") for n, (i, t) in enumerate(EDGES)]
    df = spark.createDataFrame(rows, "doc_id long, text string, text_sha256 string").repartition(4)
    left = exact_dedup.drop_exact_duplicates(df)
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", t or ""), []).append((i, t))
    best = [min(g, key=lambda m: (-len(m[1] or ""), m[0] is None, m[0] or 0)) for g in groups.values()]
    assert left.columns == df.columns
    assert sorted(((r["doc_id"], r["text"] or "") for r in left.collect()), key=str) == sorted(((i, t or "") for i, t in best), key=str)
    assert all(tuple(r) in set(rows) for r in left.collect())


def test_empty_tables(spark):
    none = docs(spark, [])
    assert exact_dedup.exact_duplicates(none).count() == exact_dedup.drop_exact_duplicates(none).count() == simhash.near_duplicates(none).count() == simhash.keep_one_of_each_group(none).count() == substring.repeated_passages(none).count() == 0


def brute_fingerprint(text, n=3):
    w = words(text)
    shingles = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or ([" ".join(w)] if w else [])
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, linked):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {i: find(i) for i in ids}


def near_copies(rng, n=60):
    base = [" ".join(rng.choice("ab cd ef gh ij kl mn op qr st uv wx yz".split()) + str(rng.randint(0, 99)) for _ in range(rng.randint(1, 300))) for _ in range(n // 4)]
    out = list(base)
    while len(out) < n:
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = "new" + str(rng.randint(0, 9))
        out.append(" ".join(w).title() if rng.random() < 0.3 else "\n".join(w))
    return out


def test_simhash_matches_brute_force(spark):
    rows = list(enumerate(near_copies(random.Random(4)) + ["", None, " ", "x", "x y", "x y z", "É À x"]))
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs(spark, rows)).collect()}
    fp = {i: brute_fingerprint(t) for i, t in rows}
    assert {i: r["fp"] & (1 << 64) - 1 for i, r in got.items()} == fp
    linked = [(a, b) for a in fp for b in fp if a < b and bin(fp[a] ^ fp[b]).count("1") <= 3]
    want = brute_components(fp, linked)
    assert {i: r["component_id"] for i, r in got.items()} == want
    left = {r["doc_id"] for r in simhash.keep_one_of_each_group(docs(spark, rows), words=3, radius=3, least=None).collect()}
    assert left == set(want.values())


def test_similar_documents_are_grouped(spark):
    rng = random.Random(9)
    fresh = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    rows = []
    for k, n in enumerate((60, 150, 400, 1500, 3000)):
        base = fresh(n)
        rows.append((10 * k, " ".join(base)))
        for j, share in enumerate((0.004, 0.015, 0.02, 0.06, 0.2)):
            rows.append((10 * k + j + 1, " ".join("x%d" % rng.randint(0, 9) if rng.random() < share else w for w in base)))
    rows += [(100 + i, " ".join(fresh(rng.randint(1, 8)))) for i in range(6)] + [(200, None), (201, ""), (202, "a b"), (203, "A  b")]
    shingles = {}
    for i, t in rows:
        w = words(t)
        shingles[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    alike = lambda a, b: len(a & b) / len(a | b) if a or b else 1.0
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs(spark, rows), words=5, radius=18, tile=16, least=0.8).collect()}
    sure = [(a, b) for a in shingles for b in shingles if a < b and alike(shingles[a], shingles[b]) >= 0.82]
    assert len(sure) > 8 and all(got[a] == got[b] for a, b in sure)
    for i, c in got.items():
        others = [b for b in got if b != i and got[b] == c]
        assert not others or max(alike(shingles[i], shingles[b]) for b in others) >= 0.78
    kept = {r["doc_id"] for r in simhash.keep_one_of_each_group(docs(spark, rows)).collect()}
    assert kept == set(got.values())


def test_simhash_repeated_and_missing_ids(spark):
    rows = [(None, "a b c d"), (None, "a b c d"), (6, "a b c d"), (2, "e f g h"), (2, "i j k l"), (1, "word " * 40000)]
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    assert sorted(str((r["doc_id"], r["component_id"])) for r in got) == sorted(map(str, [(None, 6), (None, 6), (6, 6), (2, 2), (2, 2), (1, 1)]))


@pytest.mark.parametrize("tile", [1, 7, 1000])
def test_links_do_not_depend_on_tiles(spark, tile):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 12, dtype=np.uint64)) for _ in range(4)]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    links = [(r["u"], r["v"]) for r in simhash.near_links(df, 3, tile).collect()]
    ids = fps.view(np.int64).tolist()
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= 3
    want = brute_components(ids, [(ids[i], ids[j]) for i, j in zip(*np.nonzero(near)) if i != j])
    assert brute_components(ids, links) == want


def test_components_of_a_long_chain(spark):
    n = 300
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame(list(zip(order, order[1:])) + [(1000, 1001), (1001, 1000), (7, 7)], "u long, v long")
    got = {r["node"]: r["label"] for r in components.connected_components(edges).collect()}
    assert got == {**dict.fromkeys(range(n), 0), 1000: 1000, 1001: 1000}


def test_passages_of_fifty_words_are_found(spark):
    rng = random.Random(8)
    fresh = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    passage, fuzzy, short = fresh(60), fresh(90), fresh(20)
    changed = [("zz" if i % 30 == 15 else w) for i, w in enumerate(fuzzy)]
    rows = [(i, " ".join(fresh(40 + i) + passage + fresh(30))) for i in range(6)]
    rows += [(10, " ".join(fresh(25) + fuzzy + fresh(9))), (11, " ".join(fresh(5) + changed + fresh(70)))]
    rows += [(20 + i, " ".join(fresh(100) + short + fresh(100))) for i in range(4)]
    rows += [(30, " ".join(fresh(80) * 2)), (40, None), (41, ""), (42, "x"), (50, " ".join(passage)), (50, " ".join(passage)), (60, " ".join(fresh(30000) + passage))]
    got = substring.repeated_passages(docs(spark, rows)).collect()
    found = {r["doc_id"] for r in got} | {r["ref_doc_id"] for r in got}
    assert found == {0, 1, 2, 3, 4, 5, 10, 11, 50, 60}
    text = {i: words(t) for i, t in rows}
    for r in got:
        if {r["doc_id"], r["ref_doc_id"]} == {10, 11}:
            assert r["identity"] == pytest.approx(87 / 90) and r["end_word"] - r["start_word"] == 90
        else:
            assert text[r["doc_id"]][r["start_word"] : r["end_word"]] == passage == text[r["ref_doc_id"]][r["ref_start"] : r["ref_end"]]


def test_chains_bridge_insertions():
    d = np.array([0, 10, 40, 200])
    c = np.array([5, 15, 52, 3])
    chains = substring.chains(d, c, np.array([10, 10, 20, 6]))
    assert chains[0] == [0, 1, 2] and [3] in chains


def test_chaining_equals_the_quadratic_programme():
    rng = random.Random(2)
    for _ in range(500):
        n = rng.randint(2, 12)
        d, c, ln = (np.array([rng.randint(0, 80) for _ in range(n)]) for _ in range(3))
        ln = ln % 10 + 4
        order = np.lexsort((c, d))
        d, c, ln = d[order], c[order], ln[order]
        best = substring.chains(d, c, ln)[0]

        def score(chain):
            s = float(ln[chain[0]])
            for i, j in zip(chain, chain[1:]):
                s += ln[j] - substring.GAP_COST * ((d[j] - d[i] - ln[i]) + (c[j] - c[i] - ln[i]))
            return s

        slack = substring.SLACK
        f = [0.0] * n
        for j in range(n):
            f[j] = float(ln[j])
            for i in range(n):
                if d[i] < d[j] and c[i] < c[j] and d[i] + ln[i] - slack <= d[j] and c[i] + ln[i] - slack <= c[j]:
                    f[j] = max(f[j], f[i] + ln[j] - substring.GAP_COST * ((d[j] - d[i] - ln[i]) + (c[j] - c[i] - ln[i])))
        assert score(best) == pytest.approx(max(f))


@pytest.mark.parametrize("sizes", [(60, 40, 40, 60), (500, 300, 300, 500), (60, 45, 70, 55), (80, 30, 90, 20)])
def test_two_passages_of_a_pair(spark, sizes):
    rng = random.Random(5)
    fresh = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    one, left, right, two = map(fresh, sizes)
    a, b = fresh(30) + one + left + two + fresh(30), fresh(17) + one + right + two + fresh(22)
    got = substring.repeated_passages(docs(spark, [(1, " ".join(a)), (2, " ".join(b))])).collect()
    own = [x for x in (one, two) if len(x) >= 50]
    for i, t in ((1, a), (2, b)):
        seen = [range(r["start_word"], r["end_word"]) if r["doc_id"] == i else range(r["ref_start"], r["ref_end"]) for r in got]
        # brute force: every word that is in a common run of 50 words
        for p in own:
            at = next(k for k in range(len(t)) if t[k : k + len(p)] == p)
            assert any(at in s and at + len(p) - 1 in s for s in seen)
    assert all(r["identity"] >= 0.8 for r in got)


def test_passages_of_low_identity(spark):
    rng = random.Random(12)
    fresh = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    rows, even, pairs = [], [], []
    for k in range(120):
        n, every = rng.choice([60, 90]), (5, 6, 8, 10)[k % 4]
        p = fresh(n)
        at = range(every - 1, n, every) if k % 8 < 4 else rng.sample(range(1, n - 1), n // every)
        q = ["zz%d" % rng.randint(0, 10**6) if i in at else w for i, w in enumerate(p)]
        rows += [(2 * k, " ".join(fresh(40) + p + fresh(30))), (2 * k + 1, " ".join(fresh(20) + q + fresh(50)))]
        pairs.append((every, k % 8 < 4))
    found = {min(r["doc_id"], r["ref_doc_id"]) // 2 for r in substring.repeated_passages(docs(spark, rows)).collect()}
    recall = {key: np.mean([k in found for k, x in enumerate(pairs) if x == key]) for key in set(pairs)}
    print(recall)
    assert all(v == 1 for (every, _), v in recall.items() if every > 5) and all(v >= 0.8 for v in recall.values())


def test_passages_made_of_common_lines(spark):
    rng = random.Random(3)
    fresh = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    rows, want = [], set()
    for k, size in enumerate((20, 13, 16)):
        lines = [fresh(size) for _ in range(4)]
        passage = sum(lines, [])[: max(50, 4 * size)]
        for i in range(2):
            rows.append((1000 + 10 * k + i, " ".join(fresh(30 + i) + passage + fresh(25))))
            want.add(1000 + 10 * k + i)
        rows += [(i + 100 * k, " ".join(fresh(40) + lines[i % 4] + fresh(40))) for i in range(80)]
    got = substring.repeated_passages(docs(spark, rows)).collect()
    assert {x for r in got for x in (r["doc_id"], r["ref_doc_id"])} == want
    assert all(r["end_word"] - r["start_word"] >= 50 for r in got)


@pytest.mark.parametrize("identity", [1.0, 0.9, 0.85, 0.8])
def test_crowded_passages(spark, identity):
    """Pairs that share 120 words, among hundreds of documents that quote 30 words each of the same: no link between a pair may be lost."""
    rng = random.Random(int(identity * 100))
    fresh = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    rows, pairs = [], 20
    for k in range(pairs):
        p = fresh(120)
        q = [w if rng.random() < identity else fresh(1)[0] for w in p]
        rows += [(100000 + 2 * k, " ".join(fresh(30) + p + fresh(40))), (100001 + 2 * k, " ".join(fresh(50) + q + fresh(20)))]
        for i in range(100 if k else 728):
            at = rng.randint(0, 90)
            rows.append((k * 1000 + i, " ".join(fresh(25) + p[at : at + 30] + fresh(25))))
    got = {tuple(sorted((r["doc_id"], r["ref_doc_id"]))) for r in substring.repeated_passages(docs(spark, rows)).collect()}
    found = [(100000 + 2 * k, 100001 + 2 * k) in got for k in range(pairs)]
    print(identity, np.mean(found))
    assert np.mean(found) >= (0.9 if identity > 0.8 else 0.85) and all(found) >= (identity == 1)


def test_keys_of_crowded_seeds_are_shared():
    rng = np.random.default_rng(6)
    pos, h = np.arange(0, 200, 3), rng.integers(0, 1 << 63, 67, dtype=np.uint64)
    doc = np.zeros(67, np.int64)
    other = np.concatenate([doc, doc + 1])
    i, key, gap = substring.context_keys(other, np.concatenate([pos, pos + 1000]), np.concatenate([h, h]))
    one, two = ({(int(a) % 67, int(k), int(g)) for a, k, g in zip(i, key, gap) if (a < 67) == first} for first in (True, False))
    assert one == two and len(one) > 130
    for a, k, g in one:
        assert 0 < g <= substring.APART[1]


def test_pairs_among_crowds_that_lack_their_passage(spark):
    """A pair shares 50 words of which one crowd quotes the first 48 and another the last 48, so that every seed and longer key is crowded and its first and last document share too little with either."""
    rnd = random.Random(11)
    rows, pairs = [], set()
    own = lambda: [f"w{rnd.randrange(10**9)}" for _ in range(40)]
    for g in range(8):
        passage = [f"p{g}x{i}" for i in range(50)]
        at = len(rows)
        parts = [passage[:48]] * 30 + [passage[2:]] * 30
        parts[20:20], parts[40:40] = [passage], [passage]
        rows += [(at + i, " ".join(own() + part + own())) for i, part in enumerate(parts)]
        pairs.add((at + 20, at + 40))
    got = {tuple(sorted((r["doc_id"], r["ref_doc_id"]))) for r in substring.repeated_passages(docs(spark, rows)).collect()}
    assert got == pairs


def test_rows_that_no_passage_links_all_meet():
    r, at = np.repeat(np.arange(10, 22), 1), np.arange(12) << 8 | 30
    linked = r.copy()
    linked[[3, 4, 5]] = 10, 13, 14  # 15 to 14 to 13 to 10: one class with it
    linked[[7, 8]] = 5  # a document without the key
    for most in (5, 10**6):
        found = [np.concatenate(x) for x in zip(*substring.apart(r, at, linked, most))]
        want = {(y, x) for x in r.tolist() for y in r.tolist() if x < y and not {x, y} <= {10, 13, 14, 15} and {x, y} != {17, 18}}
        assert sorted(zip(found[0].tolist(), found[1].tolist())) == sorted(want)
        assert all((p >> 32, p & 0xFFFFFFFF, g) == (d - 10, c - 10, 30 << 8 | 30) for d, c, p, g in zip(*(x.tolist() for x in found)))
    assert not list(substring.apart(r, at, np.full(12, 10)))


def test_rows_of_a_crowded_key_without_a_passage_do_not_meet(spark, monkeypatch):
    """Runs of one word, too short for a passage and in different surroundings: matches in proportion to the documents, and the few passages over them found."""
    rnd, made = random.Random(4), {}
    own = lambda n: [f"w{rnd.randrange(10**9)}" for _ in range(n)]
    rows = [(i, " ".join(own(30) + ["at"] * rnd.randint(29, 48) + own(30))) for i in range(200)]
    tail, pairs = own(25), set()
    for k in range(3):  # 30 of the run and 25 words behind it, which others have too
        rows.insert(40 * k + 7, (1000 + k, " ".join(own(30) + ["at"] * 30 + tail + own(30))))
    keep = substring.materialize

    def counted(df, tag):
        out = keep(df, tag)
        made[tag] = out.count()
        return out

    monkeypatch.setattr(substring, "materialize", counted)
    got = {tuple(sorted((r["doc_id"], r["ref_doc_id"]))) for r in substring.repeated_passages(docs(spark, rows)).collect()}
    assert brute_components([1000, 1001, 1002], list(got)) == dict.fromkeys([1000, 1001, 1002], 1000)
    assert all(x >= 1000 for pair in got for x in pair)
    assert made.get("substring-rest", 0) < 50


def test_words_around_a_key_lose_no_link():
    """Against all pairs of rows, aligned outwards from the key."""
    for seed in range(30):
        rng = np.random.default_rng(seed)
        n, span = int(rng.integers(5, 60)), 28
        base = rng.integers(0, 3 if seed % 2 else 10**6, 200)
        if seed % 3 == 0:
            base[60:150] = 7
        texts, lead = [], []
        for _ in range(n):
            before, behind = rng.integers(0, 50, 2)
            t = np.concatenate([rng.integers(10**7, 10**8, 64), base[64 - before : 64 + span + behind], rng.integers(10**7, 10**8, 64)])
            t[64:][rng.random(len(t) - 64) < (0, 0.03, 0.1)[seed % 3]] = rng.integers(10**7, 10**8)
            t[64 + before : 64 + before + span] = base[64 : 64 + span]
            texts.append(t[before:][: 128 + span])
            lead.append(64)
        words, cuts = np.concatenate(texts).astype("<u4"), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        r, spans, lead = np.sort(rng.integers(0, 10**9, n)), np.full(n, span), np.array(lead)
        i, j = np.tril_indices(n, -1)
        true = substring.reaches(words, cuts, lead, spans, i, j, 50)
        want = brute_components(range(n), list(zip(i[true].tolist(), j[true].tolist())))
        a, b, root = substring.same_words(words, cuts, lead, 51 - spans, r, np.arange(n), 50)
        found = set(zip(a.tolist(), b.tolist()))
        assert found <= set(zip(i[true].tolist(), j[true].tolist())) and len(found) < n
        for x, y in substring.could_share(*substring.adjacent(words, cuts, lead, spans), 51 - spans, r, root, 50):
            found |= set(zip(x.tolist(), y.tolist()))
        real = {p for p in found if true[p[0] * (p[0] - 1) // 2 + p[1]]}
        assert brute_components(range(n), list(real)) == want
        every = {(x, y) for x, y in zip(i[true].tolist(), j[true].tolist()) if root[x] != root[y]}
        assert every <= real


def test_meetings_lose_no_document():
    rng = np.random.default_rng(5)
    key = np.repeat([1, 2, 3, 4], [2, 8, 9, 500]).astype(np.int64)
    r = np.concatenate([np.arange(n) + 10 for n in (2, 8, 9, 500)]).astype(np.int64)
    at = rng.integers(0, 1000, len(key)) << 8
    (d, c, places, _), crowded = substring.met(key, r, at)
    assert crowded.tolist() == [False] * 10 + [True] * 509
    assert len(d) == 1 + 28 + 8 + 7 + 499 + 498 and (d > c).all()
    import pyarrow as pa

    rows = list(substring.combined(key, r, at, True))
    kinds = [b.column("kind")[0].as_py() for b in rows]
    assert kinds == [0, 1, 2] and [b.num_rows for b in rows] == [2 + 8 + 9 + 9, 499, 491]
    order = pa.Table.from_batches([substring._batch(0, key, r, at)])
    whole, parts = ([b for b in substring._meetings(True)(order.to_batches(max_chunksize=n))] for n in (10**6, 7))
    linked = lambda found: brute_components(range(600), [(x, y) for b in found if b.num_rows and b.column("kind")[0].as_py() == 1 for x, y in zip(b.column("key").to_pylist(), b.column("r").to_pylist())])
    assert linked(whole) == linked(parts)


def test_extensions_equal_the_whole_table():
    rng = random.Random(7)
    pairs = []
    for _ in range(60):
        a = [rng.randint(1, 5) for _ in range(rng.randint(0, 30))]
        b = [x for x in a if rng.random() < 0.9 for x in [x] * (1 + (rng.random() < 0.08))] + [9] * rng.randint(0, 5)
        pairs.append((np.array(a, np.uint32), np.array(b, np.uint32)))
    got = substring.extend_all(pairs)
    for (a, b), (i, j, matched) in zip(pairs, got.tolist()):
        best, cell = 0, {}
        for x in range(len(a) + 1):
            for y in range(len(b) + 1):
                if abs(x - y) <= substring.BAND:
                    ways = [0] if x == y == 0 else []
                    ways += [cell[x - 1, y - 1] + (2 if a[x - 1] == b[y - 1] else -3)] if (x - 1, y - 1) in cell else []
                    ways += [cell[k] - 3 for k in ((x - 1, y), (x, y - 1)) if k in cell]
                    cell[x, y] = max(ways)
                    best = max(best, cell[x, y])
        assert best == cell.get((i, j), 0) and matched <= min(i, j)


def test_words_across_gaps():
    rng = np.random.default_rng(1)
    for n, m in ((0, 5), (7, 9), (40, 33), (300, 310)):
        a, b = rng.integers(0, 12, n), rng.integers(0, 12, m)
        row = [0] * (m + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(max(row[j + 1], new[j], row[j] + (x == y)))
            row = new
        assert substring.matched_across(a, b) == row[-1]
    long = rng.integers(0, 1 << 30, 3000)
    assert substring.matched_across(long, np.roll(long, 1)) == 2999


def test_repeated_lines_decide_nothing(spark):
    rng = random.Random(21)
    fresh = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    line, base = fresh(9), fresh(300)
    rows = [(i, " ".join(fresh(50) + line * 300 + fresh(50))) for i in (1, 2)]
    rows += [(3, " ".join(base)), (4, " ".join(base[:100] + base[100:109] * 300 + base[109:]))]
    kept = {r["doc_id"] for r in simhash.keep_one_of_each_group(docs(spark, rows)).collect()}
    assert kept == {1, 2, 3}


def test_equal_fingerprints_are_compared():
    rng = np.random.default_rng(2)
    one, two = (np.sort(rng.integers(0, 1 << 31, 32)).astype(np.uint32) for _ in range(2))
    near = one.copy()
    near[0] += 1
    x, y = simhash.linked_forest(np.full(3, 7, np.uint64), None, 18, np.stack([one, two, near]), None, 0.8, np.array([10, 11, 12], np.uint64))
    assert {*zip(x.tolist(), y.tolist())} in ({(12, 10)}, {(10, 12)})
