"""Byte-level BPE and the alignment of two tokenizers against the plain libraries and a brute-force version."""

import base64
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

from tapeloom.llm import alignment, bpe
from tapeloom.llm.queries import op11_bpe, op12_alignment

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
BITS = ["a", "B", "7", "'", "s", " ", "  ", "\n", "\t", ".", "-", "é", "字", "。", "\xa0", "　", "the", "'ll", "😀", "\x1c", "​", "_", "!", "½", "▁", "<|endoftext|>", "<s>"]
ODD = "doc_id long, text string, ids string, row long, chunk long, a string"


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd(spark):
    rows = [(1, None), (2, ""), (None, "some text"), (3, "same text"), (3, "same text"), (4, "a b" * 5_000), (5, "y" * 200), (6, "tab\tx ▁ y"), (7, " " * 9_000 + "end")]
    return spark.createDataFrame([(*r, "x", 1, 2, "z") for r in rows], ODD)


def test_parts_of_long_texts_encode_like_the_whole(library):
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choices(BITS, k=rng.randint(0, 40)))
        want = library.encode_ordinary(text)
        assert bpe.ids(library, text, 3).tolist() == want, text
        assert "".join(bpe.parts(text, 2)) == text
        assert bpe.raw(library, np.array(want)) == text.encode()
    assert bpe.ids(library, " " * 2_000_000 + "x").tolist() == [library.encode_ordinary(" ")[0]] * 1_999_999 + library.encode_ordinary(" x")


def test_half_characters_are_raw_bytes(library):
    tokens = library.encode_ordinary("𓀀")
    assert len(tokens) > 1 and bpe.raw(library, np.array(tokens[:1])) == library.decode_single_token_bytes(tokens[0])


def test_bpe_query_matches_the_library(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    own = {r.doc_id: r for r in op11_bpe(spark, SF).collect()}
    assert len(own) == len(docs)
    for d in docs:
        want = np.array(library.encode_ordinary(d.text or ""), "<u4")
        assert own[d.doc_id].n_tokens == len(want) and own[d.doc_id].ids_sha256 == hashlib.sha256(want.tobytes()).hexdigest()
        assert own[d.doc_id].decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


def test_bpe_odd_rows(spark, library):
    found = bpe.decode(bpe.encode(odd(spark), RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).collect()
    assert len(found) == 9 and sorted(str(r.doc_id) for r in found) == sorted(["1", "2", "None", "3", "3", "4", "5", "6", "7"])
    assert {(r.doc_id, bytes(r.decoded)) for r in found} == {(d.doc_id, (d.text or "").encode()) for d in odd(spark).collect()}
    assert bpe.encode(odd(spark).where("false"), RANKS, public_tokenizers.PATTERN).count() == 0


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def plain(both, text):
    """Groups of a text by running sums over the two libraries' whole tokens."""
    a, b = both
    letters = {**{chr(c): c for c in (*range(33, 127), *range(161, 173), *range(174, 256))}}
    rest = [c for c in range(256) if c not in set(letters.values())]
    letters |= {chr(256 + i): c for i, c in enumerate(rest)}
    if not text:
        return []
    ea, ib = a.encode(" " + text, add_special_tokens=False), b.encode(text)
    ba = [bytes(letters[c] for c in t) for t in ea.tokens]
    pieces = [b.id_to_piece(i) for i in ib]
    bb = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ib, pieces, strict=True)]
    if not b"".join(ba) == b"".join(bb) == (" " + text).encode():
        return []
    out, ga, gb, la, lb, ia, jb = [], [], [], 0, 0, 0, 0
    while ia < len(ba) or jb < len(bb):
        if la <= lb and ia < len(ba):
            ga.append(ea.ids[ia])
            la += len(ba[ia])
            ia += 1
        else:
            gb.append(ib[jb])
            lb += len(bb[jb])
            jb += 1
        if la == lb and ga and gb:
            out.append((ga, gb))
            ga, gb = [], []
    return out


def expected(both, docs):
    """Per row: the contract's columns by explicit lists of links."""
    all_ = [plain(both, d.text) for d in docs]
    held = Counter(p for gs in all_ for p in {(x, y) for ga, gb in gs for x in ga for y in gb})
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    for d, gs in zip(docs, all_, strict=True):
        links = [(x, y) for ga, gb in gs for x in ga for y in gb]
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in gs)
        yield (d.doc_id, sum(len(g[0]) for g in gs), sum(len(g[1]) for g in gs), len(gs), len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if gs else "")


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_query_matches_brute_force(spark, both):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert sorted(map(tuple, op12_alignment(spark, SF).select(COLUMNS).collect())) == sorted(expected(both, docs))


def test_alignment_in_small_chunks(spark, both):
    rng = random.Random(2)
    texts = ["".join(rng.choices(BITS, k=rng.randint(0, 40))) for _ in range(1500)] + ["▁", "a▁ b", " ", "  ", "x ", " x", "\n", "字" * 40 + " é", "a  b", "a\u3000 b"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for chunk in (50, 1 << 22):
        own = alignment.align(docs.repartition(12), A, B, chunk=chunk)
        own = own.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups").collect()
        want = list(expected(both, docs.collect()))
        assert sorted((*r[:7], hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") for r in own) == sorted(want)


def test_large_groups_go_through_distinct_ids():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 5, 300), rng.integers(0, 7, 200)
    who, keys, times = alignment.links({"a": a, "b": b, "na": np.array([1, 299]), "nb": np.array([150, 50]), "lg": np.array([0, 1, 1])}, 10)
    want = {1: Counter([int(a[0]) * 10 + int(y) for y in b[:150]]), 2: Counter([int(x) * 10 + int(y) for x in a[1:] for y in b[150:]])}
    assert [(w, k, t) for w in want for k, t in sorted(want[w].items())] == list(zip(who.tolist(), keys.tolist(), times.tolist(), strict=True))


def test_groups_are_listed_and_pairs_counted_once():
    f = {"a": [1, 2, 3, 4, 5], "b": [6, 7, 8, 9, 6], "na": [1, 2, 1, 1], "nb": [1, 1, 2, 1], "lg": [2, 0, 2], "words": [2, 0, 0, 2], "n_words": [3, 0, 1]}
    f = {k: np.array(v, np.int64) for k, v in f.items()}
    assert alignment.listed(f) == ["1|6;2,3|7", "", "4|8,9;5|6"]
    who, keys, times = alignment.links(f, 100)
    assert list(zip(who.tolist(), keys.tolist(), times.tolist())) == [(0, 106, 1), (0, 207, 1), (0, 307, 1), (2, 408, 1), (2, 409, 1), (2, 506, 1)]
    known, docs = alignment.held(f, who, keys)
    assert dict(zip(known.tolist(), docs.tolist())) == {106: 1, 207: 1, 307: 1, 408: 2, 409: 2, 506: 2}
    assert alignment.distinct(np.array([3, 1, 3, 2, 1])).tolist() == [1, 2, 3] and not len(alignment.distinct(known[:0]))


def test_alignment_odd_rows(spark, both):
    own = alignment.align(odd(spark), A, B).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups").collect()
    rows = sorted(((*r[:7], hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") for r in own), key=str)
    assert rows == sorted(expected(both, odd(spark).collect()), key=str)
    assert alignment.align(odd(spark).where("false"), A, B).count() == 0
    assert {r.n_a for r in alignment.align(odd(spark).where("doc_id in (1, 2)"), A, B).collect()} == {0}
    named = alignment.align(odd(spark).selectExpr("cast(doc_id as string) doc_id", "text"), A, B)
    assert {r.doc_id for r in named.collect()} == {None, *"1234567"}


def test_segments_are_encoded_some_at_a_time(monkeypatch):
    """Few segments at once, looked at one by one only where white space asks for it; groups are those of one call."""
    pair, asked = alignment.tokenizers(A, B), []
    texts = ["the cat sat\n", "a cat sat on\x00 it", "", "naïve cat 12 12", "x\n y z\u3000"]

    def written():
        c = alignment.Chunk(pair)
        c.add([1, 2, 3, 4, 5], texts)
        f = alignment.read(dict(zip(alignment.FIELDS, c.fields(), strict=True)))
        text = alignment.listed(f)
        return [[text[w] for w in ws.tolist()] for ws in np.split(f["words"], np.cumsum(f["n_words"])[:-1])]

    want, encode = written(), alignment.encode
    monkeypatch.setattr(alignment, "SOME", 3)
    monkeypatch.setattr(alignment, "encode", lambda p, words: asked.append(len(words)) or encode(p, words))
    assert written() == want and all(map(len, (want[0], want[3], want[4]))) and max(asked) == 3
