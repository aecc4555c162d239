"""Token counts, packing, personal data, archive, page text, quality and decontamination on small tables."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tapeloom.llm import decontam, html, packing, pii, quality, queries, token_count, tokens, warc

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = "doc_id long, text string, n_tokens string, kind int, n_chars long"
HARD = [None, "", " ", "a", "x  y\n\n z", "<|endoftext|>", "a<|endoftext|><|endoftext|> b<|endof", "I'm we'll they'd  's", "é ß　中文 🙂", " " * 5000 + "x", "\n " * 3000 + "y", "!" * 2000]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def docs(spark, texts_):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in enumerate(texts_)] + [(None, "no id", None, None, None)], ODD)


def test_ids_are_the_library_s(library):
    rng = random.Random(1)
    bits = [" ", "  ", "\n", "\t", "a", "é", "1", "'s", "'ll", "'", "?!", "<|endoftext|>", "<|", "中", "🙂", "_", "I'm", "\r\n", " ", "\x1c", "Ⅷ", "²"]
    for _ in range(3000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert tokens.ids(PATH, t).tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)
    for t in (" " * 400_000 + "x", "\n " * 300_000 + "y z", "q" * 50_000):
        assert tokens.ids(PATH, t).tolist() == library.encode(t, add_special_tokens=False).ids


def test_long_white_space_is_cut_where_the_scan_has_a_boundary(library, monkeypatch):
    class Weak:
        def encode_to_numpy(self, text, **how):
            if re.search(r"\s{1500}\S", text):
                raise ValueError("too much to hold")
            return np.array(library.encode(text, add_special_tokens=False).ids, np.uint32)

    monkeypatch.setattr(tokens, "encoder", lambda path: Weak())
    for t in ("a b" + " " * 2000 + "c d" + "\n\t" * 900 + "\ne  ", " " * 3000 + "x", "k" + "　 " * 1200 + "中"):
        assert tokens.ids(PATH, t).tolist() == library.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("cut", [{}, {"huge": 200, "chunk": 150, "overlap": 80}, {"huge": 300, "chunk": 40, "overlap": 66}])
def test_token_counts(spark, library, cut):
    rng = random.Random(2)
    texts_ = HARD + ["".join(rng.choice([" word", "s", ", ", "\n", "'ll", " 12", "<|endoftext|>", "  ", "é"]) for _ in range(rng.randint(50, 900))) for _ in range(25)] + ["z" * 3000, "ab " * 700, "ab " * 700]
    out = token_count.count_tokens(docs(spark, texts_), PATH, limit=100, **cut).collect()
    assert len(out) == len(texts_) + 1
    for r in out:
        t = "no id" if r.doc_id is None else texts_[r.doc_id] or ""
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 100), repr(t[:50])


def test_packing_holds_every_piece_once(spark, library, monkeypatch):
    monkeypatch.setattr(packing, "SALT_ROWS", 7)
    rng = random.Random(3)
    texts_ = HARD[:9] + [" word" * rng.choice([3, 10, 30, 31, 63, 64, 200]) for _ in range(300)] + ["same text"] * 100
    out = packing.pack(docs(spark, texts_), PATH, size=64).toPandas()
    for i, t in enumerate(texts_):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        own = out[out.doc_id == i].sort_values("piece")
        assert own.piece.tolist() == list(range(len(own))) and (own.length.iloc[1:] == 64).all() and own.length.sum() == len(ids)
        for r in own.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[r.start: r.start + r.length].tobytes()) and r.length <= 64
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert (g.offset.to_numpy() == np.concatenate([[0], g.length.cumsum().to_numpy()[:-1]])).all() and g.length.sum() <= 64
    assert out.sequence_id.nunique() <= -(-out.length.sum() // 64) * 1.03 + 2
    assert packing.pack(docs(spark, []).where("false"), PATH).count() == 0


def lower_bound(counts, size):
    """Pieces over half a sequence share with short ones only: a known bound on bin packing, over all cuts between short and long."""
    lengths, best = np.arange(size + 1), 0
    for k in range(size // 2 + 1):
        big, middle = counts[size - k + 1:].sum(), slice(size // 2 + 1, size - k + 1)
        room = counts[middle].sum() * size - (counts * lengths)[middle].sum()
        best = max(best, big + counts[middle].sum() + max(0, -(-((counts * lengths)[k: size // 2 + 1].sum() - room) // size)))
    return int(best)


def test_plans_use_the_histogram_and_few_sequences():
    rng = np.random.default_rng(1)
    for size, counts in ((64, rng.integers(0, 50, 65)), (1024, np.bincount(np.minimum(1024, rng.lognormal(6, 0.8, 30_000).astype(int) + 1), minlength=1025)), (32, np.eye(33, dtype=np.int64)[8] * 100), (32, np.zeros(33, np.int64))):
        counts = counts.copy()
        counts[0] = 0
        got, sequences = np.zeros(size + 1, np.int64), 0
        for lengths, n in packing.plan(counts, size):
            assert sum(lengths) <= size and n > 0
            got += n * np.bincount(lengths, minlength=size + 1)
            sequences += n
        assert (got == counts).all()
        assert sequences <= lower_bound(counts, size) * 1.01 + 1


def by_hand(text):
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(d[::-1])) % 10 == 0
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]:
                out.append((kind, *m.span()))
    return out


def test_base_spans_match_the_patterns(spark):
    rng = random.Random(4)
    bits = ["a", "b.c", "@", ".", "-", "+1", " (555) ", "1", "4539", "1488", " ", "é", "_", "%", "x@y.z", "255", "256", "0", "\n", "4111 1111 1111 1111", "+49 30 1234567", "10.0.0.1"]
    texts_ = [None, "", *("".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(1500))]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans if s.kind in pii.BASE] for r in pii.detect(docs(spark, texts_)).collect()}
    for i, t in enumerate(texts_):
        assert got[i] == by_hand(t or ""), repr(t)


def test_long_runs_are_linear():
    for t in ("a" * 2_000_000, "1" * 2_000_000, "@" * 500_000, "a@" * 300_000, "1." * 500_000, "+1 " * 300_000, "AA11" * 300_000, "0" * 5000 + ".1.1.1", "a1" * 500_000, "ab/" * 300_000, "abcdef" * 200_000):
        pii.spans(t)


def test_secrets_of_the_table_are_found(spark):
    import re
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    planted = {i: [m.span(1) for m in re.finditer('token = "([0-9a-f]{40})"', t)] for i, t in texts.items()}
    found = {r.doc_id: [(s.start, s.end) for s in r.spans if s.kind == "secret"] for r in pii.detect(docs).collect()}
    assert found == planted and sum(map(len, planted.values())) == 13
    assert not any(re.search("[0-9a-f]{40}", r.text or "") for r in pii.redact(docs).collect())


def test_checksums_and_context():
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765433")
    kinds = lambda t: [k for k, *_ in pii.spans(t)]
    assert kinds("pay to GB82 WEST 1234 5698 7654 32 NOW") == ["iban"] and kinds("pay to GB82 WEST 1234 5698 7654 33 NOW") == []
    assert kinds("his SSN is 123-45-6789") == ["ssn"] and kinds("part 123-45-6789") == []
    assert kinds("call 555-123-4567 today") == ["tel"] and kinds("code 555-123-4567") == []
    assert pii.masked("mail a@b.cd or 10.0.0.1, GB82WEST12345698765432") == "mail [EMAIL] or [IP], [IBAN]"
    digest, key = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYzzzzzzzKEY"
    assert kinds(f'token = "{digest}"') == kinds(f"the secret: {key}") == ["secret"]
    assert kinds(f"commit {digest} was fine") == kinds("key " + "a" * 40) == kinds("key " + "7" * 50) == kinds("the key is internationalizationoftheworldwide") == []
    assert pii.masked(f'api_key="{digest}"') == 'api_key="[SECRET]"'
    assert kinds("0" * 5000 + ".1.1.1") == ["ip"] and kinds("1" * 5000 + ".1.1.1") == []
    assert pii.masked("a clean line, 12.5 and 2026-01-02") == "a clean line, 12.5 and 2026-01-02"


def test_redaction_keeps_columns(spark):
    df = docs(spark, ["mail a@b.cd", None, "plain"])
    out = pii.redact(df)
    assert out.dtypes == df.dtypes
    assert {r.doc_id: (r.text, r.n_chars) for r in out.collect()} == {0: ("mail [EMAIL]", 12), 1: (None, 2), 2: ("plain", 5), None: ("no id", 5)}


def test_archive_round_trip(spark, tmp_path):
    pages = [(5, "http://a/1", "<p>é</p>"), (2, "http://a/2", "<p>é</p>"), (9, "u\r\nX: y", "other"), (1, None, None), (4, "http://b", ""), (7, "w", "<p>é</p>"), (7, "w", "<p>é</p>"), (3, "long", "z" * 500_000)]
    df = spark.createDataFrame([(*p, b"junk", "x") for p in pages], "page_id long, url string, html string, payload binary, address string")
    out = warc.round_trip(df).collect()
    assert len(out) == len(pages)
    first = {}
    for p, _, h in sorted(pages, key=lambda x: x[0]):
        first.setdefault(h or "", p)
    for r in out:
        raw = next(h for p, _, h in pages if p == r.page_id) or ""
        data = raw.encode()
        kind = "response" if first[raw] == r.page_id else "revisit"
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), kind, None if kind == "response" else first[raw])
        assert bytes(r.payload) == data and bytes(r.record) == bytes(r.header) + (data if kind == "response" else b"") + b"\r\n\r\n"
        assert bytes(r.header).startswith(b"WARC/1.1\r\nWARC-Type: " + kind.encode()) and bytes(r.header).endswith(b"\r\n\r\n") and bytes(r.header).count(b"\r\n\r\n") == 1
    small = {r.page_id: r.record_type for r in warc.round_trip(df, least_bytes=100).collect()}
    assert set(small.values()) == {"response"}
    assert warc.round_trip(df.where("false")).count() == 0


def test_a_damaged_payload_fails_the_read(spark, tmp_path):
    warc.write(spark.createDataFrame([(1, "u", "body")], "page_id long, url string, html string"), str(tmp_path / "a"))
    kept = spark.read.parquet(str(tmp_path / "a/payloads"))
    kept.withColumn("payload", F.encode(F.lit("bodY"), "UTF-8")).write.parquet(str(tmp_path / "b/payloads"))
    spark.read.parquet(str(tmp_path / "a/records")).write.parquet(str(tmp_path / "b/records"))
    with pytest.raises(Exception, match="damaged"):
        warc.read(spark, str(tmp_path / "b")).collect()


@pytest.mark.parametrize("page, text", [
    ("<html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Menu</a></nav><article><h1>A &amp; B</h1><p>one\n  two<b>x</b>y<br>z<p>three</article><footer>F</footer></body>", "A & B one twoxy z three"),
    ("<article><p>a<script>var t='</p>';</script>b</p><div class='ad box'>buy</div><section id=comments><p>me too</p></section><aside>s</aside><form>f</form>c</article>", "ab c"),
    ("<main><p>m</p></main><p>out</p>", "m"), ("plain &lt;text&gt; 1 < 2", "plain <text> 1 < 2"), ("<p>body only</p><header>H</header><!-- c --><ul><li>x<li>y</ul>", "body only x y"),
    ("", ""), (None, ""), ("<article><p>cut <b>off", "cut off"), ("<p hidden>h</p><p>v</p><p title='a>b'>w</p>", "v w"), ("<script>never closed <p>x</p>", ""), ("<article>" * 3 + "deep", "deep"),
])
def test_page_text(page, text):
    assert html.Page(page or "").main(set()) == text


@pytest.mark.parametrize("page, text", [
    ("<div class='site has-sidebar'><article><p>text</p></article></div>", "text"), ("<div class='no-sidebar ad-free'><p>text</p></div><div class=sidebar>s</div>", "text"),
    ("<section class='related-work'><p>text of it</p></section><p>b</p>", "text of it b"), ("<body><form><div class=menu>m</div><p>all of the text</p></form></body>", "all of the text"),
    ("<div class=sidebar><article><header>H</header>text</article><footer>f</footer></div>", "H text"), ("<div role=dialog><main>text</main></div><p>out</p>", "text"),
    ("<article class=share>text</article>", "text"), ("<div class=widget><p>most of the text</p></div><p>b</p>", "most of the text b"),
    ("<article>a<section id=comments><article>much more than is in the text itself</article></section></article>", "a"),
    ("<article>a</article><div class=related><article>b</article></div>", "a"), ("<article>a</article><div class=comments>much more than the text</div>", "a"),
    ("<div hidden><article>no</article></div><p>yes</p>", "yes"), ("<p>much of the text</p><form>f</form>", "much of the text"),
])
def test_wrappers_are_no_boilerplate(page, text):
    assert html.Page(page).main(set()) == text


def test_templates_of_a_host_go(spark):
    rows = []
    for i in range(20):
        words = " ".join(f"w{i}x{j}" for j in range(30))
        rows.append((i, f"http://h/{i}", f"<div><div>Site slogan</div><div><p>{words}</p><p>Common line</p></div><div>Imprint</div></div>"))
    for i in range(20, 40):
        rows.append((i, f"http://g/{i}", f"<article><p>Common line</p><p>text {i} of its own and more of it</p><div>Share this page</div></article>"))
    rows += [(i, "http://k/", "<article><div><p>the same page</p></div></article>") for i in range(40, 60)] + [(60, None, None), (61, "http://h/new", "<div>Site slogan</div>"), (None, "http://g/", "<article><p>null id</p></article>")]
    df = spark.createDataFrame([(*r, "t", 3) for r in rows], "page_id long, url string, html string, text string, host int").repartition(3)
    got = {r.page_id: (r.text, r.n_chars) for r in html.extract(df).collect()}
    assert len(got) == len(rows)
    for i in range(20):
        own = " ".join(f"w{i}x{j}" for j in range(30))
        assert got[i][0] == own
        assert got[20 + i][0] == f"Common line text {20 + i} of its own and more of it"
        assert got[40 + i][0] == "the same page"
    assert got[60] == ("", 0) and got[61][0] == "Site slogan" and got[None][0] == "null id"
    assert html.extract(df.where("false")).count() == 0


def test_copies_of_a_page_are_no_templates(spark):
    body = "<h2>Head</h2><p>first part</p><div><p>second part</p></div><ul><li>x one</li><li>y two</li></ul><table><tr><td>cell</td></tr></table>"
    rows = [(i, "http://h/", f"<body>{body}</body>") for i in range(20)] + [(i, "http://g/", f"<article>{body}</article>") for i in range(20, 40)]
    rows += [(i, f"http://{'hg'[i % 2]}/{i}", f"<p>page {i}</p>") for i in range(40, 140)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in html.extract(df).collect()}
    assert {got[i] for i in range(40)} == {"Head first part second part x one y two cell"}


def test_templates_of_a_section_of_a_large_host_go(spark):
    menu = "<div>Section menu</div>"
    rows = [(i, "http://h/", f"<body>{menu if i < 200 else ''}{'<p>Said of few</p>' if 200 <= i < 300 else ''}<p>the text of page {i} is longer than that</p></body>") for i in range(3000)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert all(got[i] == f"{'Said of few ' * (200 <= i < 300)}the text of page {i} is longer than that" for i in range(3000))


def corpus(n=400):
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(20, 120))]
        bad = i % 4 == 0
        rows.append((i, " ".join(x.upper() + "!!" if bad and i % 8 else x + "$$" if bad else x for x in w)))
        labels.append((i, 0 if bad else 1))
    return rows, labels


def test_quality_holds_out_and_learns(spark):
    rows, labels = corpus()
    df = spark.createDataFrame([(i, t, "x", 0.5, 1) for i, t in rows] + [(1000, None, "x", None, 1), (1001, "", "x", None, 1), (None, "no id", None, None, 1)], "doc_id long, text string, lang string, score double, quality int").repartition(4)
    lab = spark.createDataFrame([(i, q, "t") for i, q in labels] + [(0, 1, "t"), (None, 1, "t"), (5, None, "t"), (99_999, 1, "t")], "doc_id long, quality int, text string")
    out = {r.doc_id: r for r in quality.score(df, lab).collect()}
    assert len(out) == len(rows) + 3
    truth = dict(labels)
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(out[i].held_out == (i in set(held)) for i in truth)
    assert np.mean([out[i].predicted == truth[i] for i in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out.values()) and out[1000].score == out[1001].score
    # held-out labels have no part in the scores
    turned = lab.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality.score(df.repartition(2), turned).collect()}
    assert all(abs(again[i] - r.score) < 1e-6 for i, r in out.items())
    kept = quality.keep_good(df, lab)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, r in out.items() if r.predicted}
    assert quality.score(df.where("false"), lab).count() == 0 and quality.score(df, lab.where("false")).count() == len(out)


def test_quality_takes_one_row_of_a_repeated_id(spark, monkeypatch):
    rows, labels = corpus(60)
    seen, train = [], quality.train
    monkeypatch.setattr(quality, "train", lambda x, y: seen.append((x, y)) or train(x, y))
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    used = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5]
    smallest = min((rows[used[0]][1], "another text"), key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    for more in ([(used[0], rows[used[0]][1])] * 500 + [(used[0], "another text")] * 2, []):
        docs = spark.createDataFrame(rows + more, "doc_id long, text string").repartition(3)
        table, _ = quality.fit(docs, lab)
        x, y = seen.pop()
        assert len(x) == len(y) == len(used)
        assert np.allclose(x[0], quality.pooled(table, smallest if more else rows[used[0]][1]))


def test_temperature_is_calibrated():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 10))
    y = (rng.random(4000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    p = quality.train(x[:3000], y[:3000]).scores(x[3000:])
    for low in (0.0, 0.25, 0.5, 0.75):
        part = (p >= low) & (p < low + 0.25)
        assert abs(y[3000:][part].mean() - p[part].mean()) < 0.1


def test_masks_find_every_allowed_placement():
    from itertools import combinations
    for n in range(decontam.LEAST, decontam.WINDOW + 1):
        for wrong in combinations(range(n), int((1 - decontam.SIMILAR) * n + 1e-9)):
            bad = set(wrong)
            assert any(not bad & {s + o for o in m} for m in decontam.MASKS for s in range(n - m[-1]))


def overlaps(doc, item):
    d, i = decontam.WORD.findall(doc.lower()), decontam.WORD.findall(item.lower())
    if len(i) < decontam.LEAST:
        return 0
    size, best = min(decontam.WINDOW, len(i)), 0
    for shift in range(-len(i), len(d)):
        covered = set()
        for s in range(len(i) - size + 1):
            if 0 <= s + shift and s + shift + size <= len(d):
                same = [d[s + shift + k] == i[s + k] for k in range(size)]
                if sum(same) >= decontam.SIMILAR * size - 1e-9:
                    covered |= {s + k for k in range(size) if same[k]}
        best = max(best, len(covered))
    return best


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(9)
    say = lambda n: [rng.choice("the of and to a in is it on by".split() if rng.random() < 0.4 else [f"v{rng.randint(0, 60)}"]) for _ in range(n)]
    items = [(i, " ".join(say(n))) for i, n in enumerate([8, 9, 10, 14, 15, 19, 20, 21, 40, 55, 7, 3, 0])]
    items += [(50, items[8][1].upper() + "!"), (51, None)]
    rows = [(0, None), (1, ""), (2, " ".join(say(3000)))]
    for k in range(160):
        w = dict(items)[rng.choice([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10])].split()
        for j in rng.sample(range(len(w)), int(rng.choice([0, 0.1, 0.2, 0.25, 0.3]) * len(w))):
            w[j] = "other"
        cut = rng.randint(0, len(w) // 3)
        rows.append((10 + k, " ".join(say(rng.randint(0, 40)) + w[cut:] + say(rng.randint(0, 40)))))
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows] + [(10, rows[3][1], 1, "x"), (None, items[9][1], 1, "x")], "doc_id long, text string, item_id int, words string").repartition(3)
    bench = spark.createDataFrame([(i, t, 2) for i, t in items] + [(8, items[8][1], 2)], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id): r.n_words for r in decontam.contaminated(df, bench).collect()}
    want = {(d, i): n for d, t in [*rows, (None, items[9][1])] for i, x in items if (n := overlaps(t or "", x or ""))}
    assert got.keys() == want.keys() and sum(got[k] == want[k] for k in want) >= 0.95 * len(want)
    kept = decontam.keep_clean(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {d for d, _ in rows} - {d for d, _ in want}
    assert decontam.contaminated(df.where("false"), bench).count() == 0 and decontam.contaminated(df, bench.where("false")).count() == 0


def test_registered_queries_have_the_contract_s_columns(spark):
    want = {
        "op1_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op2_packing": "doc_id piece start length ids_crc32 sequence_id offset", "op3_warc": "page_id payload_bytes payload_digest record_type refers_to",
        "op5_quality": "doc_id held_out score predicted", "op6_html": "page_id url text n_chars", "op7_tokens": "doc_id n_bytes n_tokens over_limit", "op8_substrings": "doc_id n_bytes n_removed n_spans kept_sha256",
        "op9_vectors": "vec_id n_links component_id kept", "op10_simhash": "doc_id fingerprint component_id",
    }
    found = queries.queries()
    for name, columns in want.items():
        assert " ".join(found[name](spark, "/root/testdata/sf0.001").columns) == columns


def test_names_by_parts_and_deep_markup():
    import time

    gone = ["comment-list", "comments-section", "user-comments", "cookie-banner", "site-footer", "sidebar-left", "ad-slot", "nav-bar", "newsletter-signup", "related-posts", "site_footer"]
    kept = ["has-sidebar", "no-sidebar", "ad-free", "related-work", "with-comments", "content-main", "share-price", "article-body"]
    for name in gone + kept:
        block = f'<div class="{name}">Some words here</div>'
        for page in (f"<p>First text of the page.</p>{block}<p>Last.</p>", f"<article><p>First text of the page.</p>{block}<p>Last.</p></article>"):
            assert ("Some words here" in html.Page(page).main(set())) == (name in kept), (name, page)
    t = time.process_time()
    for page in ("<div>" * 100_000, "<div>" * 30_000 + "</span>" * 30_000, "<p><table><td>" + "<div>" * 50_000, "<li><ol>" + "<div><li></li>" * 30_000, "<p>" * 50_000, "<ul><li>" * 30_000):
        html.Page(page + "x").main(set())
    assert time.process_time() - t < 8
