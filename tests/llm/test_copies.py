"""SimHash groups, repeated strings and vector links against brute force."""

import hashlib
import random

import corpus_pipeline
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tapeloom.llm import common, resemblance, simhash, substrings, vectors

ODD = "doc_id long, text string, fp string, a string, n_chars long"


def words(rng, n, size=40):
    return " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 3) + str(rng.randint(0, size)) for _ in range(n))


def print_of(text, k=3):
    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if x]
    if not w:
        return 0
    grams = [" ".join(w[i: i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(ids, linked):
    up = {i: i for i in ids}
    for _ in ids:
        for a, b in linked:
            up[a] = up[b] = min(up[a], up[b])
    return up


@pytest.fixture(scope="module")
def simhash_rows():
    rng = random.Random(5)
    base = [words(rng, n) for n in (2, 3, 30, 200, 400)]
    rows = [None, "", "  \t\n", "One", "one", "ONE two", "É a b c", "É a b c d"]
    for b in base:
        w = b.split()
        rows += [b, b.upper(), b + " end", " ".join(w[:-1]), b]
    rows += ["x " * 300_000]
    return [(i, t, "x", "y", 1) for i, t in enumerate(rows)] + [(3, "One", "x", "y", 1), (None, "one", None, None, None), (None, "only here", None, None, None)]


def test_simhash_matches_brute_force(spark, simhash_rows):
    got = {(r.doc_id, r.fp % (1 << 64)): r.component_id for r in simhash.near_copies(spark.createDataFrame(simhash_rows, ODD)).collect()}
    prints = {i: print_of(t or "") for i, t, *_ in simhash_rows if i is not None}
    pairs = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    want = groups(prints, pairs)
    assert {k: v for k, v in got.items() if k[0] is not None} == {(i, p): want[i] for i, p in prints.items()}
    assert got[None, print_of("one")] == 3 and got[None, print_of("only here")] is None


def test_simhash_keeps_one_of_each_group(spark, simhash_rows):
    df = spark.createDataFrame(simhash_rows, ODD)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    prints = {i: print_of(t or "") for i, t, *_ in simhash_rows if i is not None}
    want = groups(prints, [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2])
    ids = sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect())
    assert ids == sorted([-1, -1] + [i for i in want if want[i] == i] + [3])


def test_bk_tree_and_split_shards(spark):
    rng = random.Random(1)
    values = [rng.getrandbits(64) for _ in range(300)]
    values += [v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for v in values[:150]] + [7, 7, 5]
    arr = np.array(sorted(set(values)), np.uint64)
    tree = simhash.BKTree(arr.tolist())
    found = {(int(x), int(arr[j])) for x, hits in tree.within(arr, 3) for j in hits}
    assert found == {(int(a), int(b)) for a in arr for b in arr if (int(a) ^ int(b)).bit_count() <= 3}
    signed = [(int(x),) for x in arr.view(np.int64)]
    for block in (3, 4096):
        edges = common.components(simhash.links(spark.createDataFrame(signed, "fp long"), 2, block))
        got = {r.node: r.component for r in edges.collect()}
        s = [x for x, in signed]
        want = groups(s, [(a, b) for a in s for b in s if a < b and ((a ^ b) % (1 << 64)).bit_count() <= 2])
        assert {k: got.get(k, k) for k in s} == want


def test_components_of_long_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 160)] + [(200, 200), (300, 301), (301, 300)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 300: 300, 301: 300}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def cut_by_hand(rows, least):
    raws = {i: (t or "").encode() for i, t in rows if i is not None}
    seen, gone = set(), {i: np.zeros(len(r), bool) for i, r in raws.items()}
    for i in sorted(raws):
        r = raws[i]
        for p in range(len(r) - least + 1):
            s = r[p: p + least]
            if s in seen:
                gone[i][p: p + least] = True
            seen.add(s)
    return {i: (len(r), bytes(np.frombuffer(r, np.uint8)[~gone[i]]), int((np.diff(np.concatenate([[0], gone[i].astype(int)])) == 1).sum())) for i, r in raws.items()}


def substring_rows():
    rng = random.Random(3)
    line, passage = words(rng, 24), words(rng, 120)
    rows = [(1, None), (2, ""), (3, "short"), (4, "é" * 60), (5, "é" * 60), (6, "a" * 700), (7, "ab" * 300 + "a" * 150), (8, line), (9, line[:99]), (10, line[1:101])]
    for i in range(20, 60):
        rows.append((i, words(rng, rng.randint(5, 60)) + " " + line + "\n" + words(rng, rng.randint(3, 50))))
    w = passage.split()
    for i in range(60, 100):
        own = list(w)
        for _ in range(3):
            own[rng.randrange(len(own))] = "zz" + str(rng.randint(0, 9))
        rows.append((i, " ".join(own)))
    rows += [(i, passage) for i in range(100, 130)] + [(130, words(rng, 9000)), (131, line * 3), (15, passage[17:400])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("limits", [{}, {"gather": 5, "hot": 10_000}, {"gather": 5, "hot": 3}, {"gather": 1000, "hot": 3}])
def test_repeated_strings_match_brute_force(spark, limits):
    rows = substring_rows()
    df = spark.createDataFrame([(i, t, "f", "g", 0) for i, t in rows] + [(8, dict(rows)[8], "f", "g", 0), (None, dict(rows)[60], None, None, None)], ODD).repartition(5)
    out = substrings.dedup(df, **limits).collect()
    want = cut_by_hand(rows, 100)
    assert len(out) == len(rows) + 2
    for r in out:
        if r.doc_id is None:
            assert bytes(r.kept).decode() == dict(rows)[60] and not r.spans
        else:
            n, kept, spans = want[r.doc_id]
            assert (r.n_bytes, hashlib.sha256(r.kept).digest(), len(r.spans)) == (n, hashlib.sha256(kept).digest(), spans), r.doc_id


def test_anchors_hit_every_string():
    rng = np.random.default_rng(2)
    for data in (rng.integers(0, 3, 3000), np.zeros(1000, int), rng.integers(97, 123, 5000)):
        raw = data.astype(np.uint8)
        for part in (substrings.PART, 700):
            old, substrings.PART = substrings.PART, part
            at, h = substrings.anchors(raw, 100)
            substrings.PART = old
            for p in range(len(raw) - 99):
                i = np.searchsorted(at, p)
                assert i < len(at) and at[i] + substrings.GRAM <= p + 100
            assert (h == substrings.gram_hashes(raw)[at]).all()


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(60, 32))
    rows = []
    for c in centers:
        for s in (0.0, 0.05, 0.1, 0.2):
            rows.append((c + s * rng.normal(size=32)).astype(np.float32))
    rows += [rows[0] * 4, rows[0], rows[0], -rows[0]] + [rng.normal(size=32).astype(np.float32) for _ in range(100)]
    data = [(i + 10, [float(x) for x in v], 0) for i, v in enumerate(rows)]
    data += [(1, None, 0), (2, [], 0), (3, [0.0] * 32, 0), (4, [float("nan")] * 32, 0), (5, [None] * 32, 0), (6, [float("inf")] + [0.0] * 31, 0), (7, [1.0, 2.0], 0), (8, [2.0, 4.0], 0), data[3]]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, n_links int")
    out = vectors.near_duplicates(df).collect()
    x = np.array(rows, float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    close = x @ x.T >= 0.95
    ids = list(range(10, 10 + len(rows)))
    want = groups(ids, [(ids[i], ids[j]) for i, j in zip(*np.nonzero(close)) if i < j])
    assert len(out) == len(data)
    got = {r.vec_id: r for r in out}
    right = sum(got[i].n_links == close[k].sum() - 1 and got[i].component_id == want[i] for k, i in enumerate(ids))
    assert right >= 0.99 * len(ids)
    assert [got[i].n_links for i in range(1, 9)] == [0] * 6 + [1, 1] and got[8].component_id == 7
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)


def test_vector_blocks_count_each_pair_once(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 7)
    rng = np.random.default_rng(6)
    c = rng.normal(size=16)
    data = [(i, [float(x) for x in c + 0.02 * rng.normal(size=16)]) for i in range(60)]
    out = vectors.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()
    assert {(r.n_links, r.component_id) for r in out} == {(59, 0)}


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x @ vectors.rotation(64)
    sign = np.sign(y) / y.shape[1] ** 0.5
    factor = (sign * y).sum(axis=1)
    error = sign @ y.T / factor[:, None] - x @ x.T
    off = ~np.eye(len(x), dtype=bool)
    assert abs(error[off].mean()) < 2e-3
    bound = vectors.EPSILON * np.sqrt((1 - factor**2) / factor**2 / (y.shape[1] - 1))
    assert (np.abs(error) <= bound[:, None])[off].mean() > 0.9999


@pytest.mark.parametrize("empty", [simhash.near_copies, simhash.keep_one, substrings.dedup])
def test_empty_documents(spark, empty):
    assert empty(spark.createDataFrame([], ODD)).count() == 0


def test_no_vectors(spark):
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def five(text):
    w = (text or "").lower().split()
    return {tuple(w[i: i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    return a == b or bool(a and b) and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) / len(a | b) >= 0.8


@pytest.mark.parametrize("block", [2048, 8])
def test_edited_copies_link_from_0_8_on(spark, block):
    rng, rows = random.Random(3), [(-1, None), (-2, ""), (-3, "one two"), (-4, "one  TWO"), (None, "one two"), (-5, "one three")]
    for g in range(40):
        base = words(rng, rng.choice([60, 200, 900]), 5000)
        first = base.split()
        for c in range(rng.choice([1, 2, 3, 30])):
            w = list(first)
            for at in rng.sample(range(len(w)), max(1, len(w) * rng.randrange(5) // 100)):
                w[at] = f"x{g}y{c}"
            rows.append((100 * g + c, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    texts = {i: five(t) for i, t in rows if i is not None}
    linked = [(a, b) for a in texts for b in texts if a < b and alike(texts[a], texts[b])]
    want = groups(texts, linked)
    prints = {i: print_of(t or "") for i, t in rows if i is not None}
    assert sum((prints[a] ^ prints[b]).bit_count() > 2 for a, b in linked) > 100  # which two bits of a fingerprint miss
    if block == 2048:
        got = {r.doc_id: r.component_id for r in resemblance.near_copies(df).collect()}
        assert got.pop(None) == want[-3] and got == want
        assert {r.doc_id for r in resemblance.keep_one(df).collect()} == {i for i in want if want[i] == i} | {None}
    else:
        found = resemblance.prints(df)
        classes = found.groupBy("class").agg(F.min("doc_id").alias("root"), F.first("size").alias("size"), F.first("bands").alias("bands"), F.first("tokens").alias("tokens")).cache()
        root = {r["class"]: r.root for r in classes.collect()}
        edges = [(root[r.a], root[r.b]) for r in resemblance.links(classes, classes.select("class", "tokens"), block=block, most=3000).collect()]
        assert groups(set(root.values()), edges) == {i: want[i] for i in root.values()}


def test_buckets_that_the_first_class_does_not_settle(spark):
    """Two groups and loose classes in one bucket: all pairs of different components are compared, in blocks of two."""
    rng = np.random.default_rng(4)
    base = [rng.choice(1 << 40, 100, replace=False) for _ in range(2)]
    sets = [np.sort(np.concatenate([b[:95], rng.choice(1 << 40, 5)])) for b in base for _ in range(9)] + [np.sort(rng.choice(1 << 40, 100)) for _ in range(5)]
    rows = [(bytes([7 * i % 23]), len(s), [5], s.astype(np.uint64).tobytes()) for i, s in enumerate(sets)]
    classes = spark.createDataFrame(rows, "class binary, size long, bands array<long>, tokens binary")
    for block in (2, 512):
        edges = [(r.a, r.b) for r in resemblance.links(classes, classes.select("class", "tokens"), block=block).collect()]
        found = groups([r[0] for r in rows], edges)
        assert sorted(list(found.values()).count(c) for c in set(found.values())) == [1] * 5 + [9, 9]


def test_the_search_by_fingerprints_finds_all_pairs_from_0_8_on():
    rng = np.random.default_rng(6)
    sets, pairs = [], []
    for n, common, m in [(5, 4, 4), (9, 8, 9), (10, 8, 8), (54, 48, 54), (900, 800, 900), (9000, 8000, 9000)]:
        for _ in range(60 if n < 9000 else 3):
            x = rng.choice(1 << 62, n + m - common, replace=False).astype(np.uint64)
            pairs.append((len(sets), len(sets) + 1))
            sets += [np.sort(x[:n]), np.sort(x[n - common:])]
    prints = np.frombuffer(b"".join(map(resemblance.fingerprint, sets)), "<u8").reshape(-1, resemblance.PARTS)
    everyone = np.arange(len(sets))
    near = resemblance.within(prints, everyone, everyone)
    far = np.bitwise_count(prints[:, None] ^ prints[None]).astype(int).sum(axis=2)
    assert (near == (far <= resemblance.RADIUS)).all() and all(near[a, b] for a, b in pairs)
    assert near.sum() <= len(sets) + 2 * len(pairs) + 100  # of 183,000 unlike pairs few, all of small sets
    label = resemblance.joined(sets, prints, everyone, everyone, 0.8)
    assert all(label[a] == label[b] for a, b in pairs) and len(set(label.tolist())) == len(pairs)
    apart = prints.copy()
    apart[1::2] = ~apart[::2]  # the search decides which sets are compared
    assert resemblance.joined(sets, apart, everyone, everyone, 0.8).tolist() == everyone.tolist()


def test_the_pipeline_s_stage_drops_edited_copies(spark):
    rng = random.Random(5)
    base = words(rng, 300, 5000).split()
    edited = [*base[:100], "other", *base[101:200], "words", *base[201:]]
    df = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(edited)), (3, words(rng, 300, 5000))], "doc_id long, text string")
    assert {r.doc_id for r in dict(corpus_pipeline.STAGES)["near_copies"](spark, df, "").collect()} == {1, 3}
