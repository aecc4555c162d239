"""Collocations against a plain count of every n-gram, and the cases of the contract."""

import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa

from tapeloom.llm import phrases
from tapeloom.llm.queries import OP13_SQL, op13_phrases

SF = "/root/testdata/sf0.01"
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(rows, least=30, words=4, within=80, top=2000):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = []
    for lang in {x or "und" if x is None else x for x, _ in rows}:
        f, n = Counter(), 0
        for x, text in rows:
            if ("und" if x is None else x) == lang:
                for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
                    w = re.findall("[^\x20\x09]+", piece)
                    n += len(w)
                    f.update(tuple(w[i: i + k]) for k in range(1, words + 1) for i in range(len(w) - k + 1))
        good = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in good.items():
            score, cut = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            if not any(len(q) > len(p) and 100 * b >= within * a and any(q[i: i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in good.items()):
                found.append((" ".join(p), a, f[p[:cut]], f[p[cut:]], score))
        found.sort(key=lambda x: (-x[4], -x[1], x[0].encode()))
        out += [(lang, i, p, a, l, r, n, s) for i, (p, a, l, r, s) in enumerate(found[:top], 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, text string, phrase string, f long").repartition(3)


def own(df):
    return sorted(map(tuple, df.select(COLUMNS).collect()))


def test_query_matches_sql_and_the_plain_count(spark):
    found = own(op13_phrases(spark, SF))
    duckdb.execute(f"CREATE OR REPLACE VIEW documents AS FROM '{SF}/documents.parquet'")
    assert found == sorted(duckdb.sql(f"SELECT {', '.join(COLUMNS)} FROM ({OP13_SQL})").fetchall())
    assert len(found) > 200


def test_small_alphabets_match_the_plain_count(spark):
    rng = np.random.default_rng(5)
    bits = ["A", "b", "c", "dd", "é", " ", "  ", "\t", ".", "\n", "\x0b", "B c", "x\xa0y", "'"]
    rows = [(["en", "de", None, "und"][i % 4], " ".join(rng.choice(bits, 40))) for i in range(400)]
    for least, within in ((30, 80), (5, 50), (3, 100)):
        assert own(phrases.mine(frame(spark, rows), least=least, within=within, top=50)) == plain(rows, least=least, within=within, top=50)


def test_odd_rows(spark):
    rows = [(None, None), ("en", ""), (None, "A b A b"), ("en", "..;; \t"), ("und", "a b a b")] + [("en", "Same Words here")] * 40 + [("en", "y" * 200_000)]
    assert own(phrases.mine(frame(spark, rows), least=4)) == plain(rows, least=4)
    assert own(phrases.mine(frame(spark, rows).where("false"))) == []
    assert own(phrases.mine(frame(spark, [("en", None)]))) == []


def test_texts_longer_than_what_is_held(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [("en", " ".join(rng.choice(list("ABcd.")) for _ in range(3000))), (None, " ".join(rng.choice(list("abc,")) for _ in range(500)))]
    monkeypatch.setattr(phrases, "HELD", 50)
    monkeypatch.setattr(phrases, "STEP", 30)
    batch = pa.RecordBatch.from_pydict({"lang": ["en", "und"], "text": [t for _, t in rows]})
    seen = Counter()
    for flow, _, skipped, names in phrases.flows(iter([batch]), 4):
        assert len(flow) < 200
        for i in range(len(flow) - skipped):
            w = []
            for x in flow[i: i + 4].tolist():
                if x < 0:
                    break
                w.append(names[x])
            if w:
                seen[tuple(w)] += 1
    want = Counter()
    for lang, text in (("en", rows[0][1]), ("und", rows[1][1])):
        for piece in re.split("[.,]", text.lower()):
            w = [(lang, x.encode()) for x in piece.split()]
            want.update(tuple(w[i: i + 4]) for i in range(len(w)))
    assert seen == want


def test_keys_of_a_share_take_three_bytes_and_come_back():
    rng = np.random.default_rng(1)
    few = phrases.HASH - phrases.SHARE
    keys = np.unique(np.concatenate([rng.integers(0, 1 << phrases.HASH, 5000), [0, (1 << few) - 1, 1 << few, (1 << phrases.HASH) - 1]]))
    share = keys >> few
    cuts = np.flatnonzero(np.diff(share, prepend=-1))
    values = phrases.packed(keys, cuts)
    assert sum(map(len, values)) == 3 * len(keys)
    assert np.concatenate([(s << few) + phrases.unpacked(v) for s, v in zip(share[cuts], values, strict=True)]).tolist() == keys.tolist()


def test_the_filter_never_loses_a_common_pair(spark, monkeypatch):
    rows = [("en", "q w e r")] * 31 + [(None, " ".join(f"u{i}" for i in range(3000)))]
    for sent in (1, 1 << 21):
        monkeypatch.setattr(phrases, "SENT", sent)
        found = {(r.lang, r.phrase): r.f for r in phrases.counts(frame(spark, rows)).where("k > 0").collect()}
        assert found == {("en", " ".join("qwer"[i: j])): 31 for i in range(4) for j in range(i + 1, 5)}
        source = phrases.sourced(frame(spark, rows))
        pairs = phrases.frequent(source, 30, 4, [])
        longer = phrases.frequent(source, 30, 4, [pairs])
        assert len(pairs) == len(longer) == 1 << 23 and 7 <= np.unpackbits(pairs).sum() <= 14 and 3 <= np.unpackbits(longer).sum() <= 6


def test_prefixes_are_summed_from_counted_windows(spark):
    """The rows that the tasks send are windows: they are multiplied by prefixes only behind a shuffle."""
    df = frame(spark, [("en", "a b c d a b c d")] * 9)
    plan = phrases.counts(df, least=3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Expand") == 1 and "Exchange hashpartitioning(lang" in plan.split("Expand")[1]
    got = {(r["k"], r["phrase"]): r["f"] for r in phrases.counts(df, least=3).collect()}
    assert got[0, ""] == 72 and got[1, "a"] == 18 and got[4, "a b c d"] == 18 and got[4, "b c d a"] == 9
