"""Where two tokenizers agree: token ids of the same bytes, cut into groups at the byte offsets where tokens of both end.

Each side's cumulative ends become a dictionary from end to index; the intersection of the two key sets, sorted, slices both id lists
into groups, and the links of a group are all pairs of its ids. A text is cut into segments before every space that follows a character
which is no white space: there a token of either side ends, for no entry of the piece model has a space after another character.

How many documents hold a linked pair is counted over the corpus. Documents lie in chunks of bounded size, a row each: the distinct
segments with their ids and groups, and the documents as numbers of segments. A chunk sends each of its pairs once, so a pair that every
document holds costs a row a chunk, and gets its totals back the same way.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, count
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import sentencepiece
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.bpe import ids
from tapeloom.llm.common import slices, stored, texts
from tapeloom.llm.tokens import PATTERN, SPACE, byte_letters

SAFE = regex.compile(rf"(?<=[^{SPACE[1:-1]}▁]) (?=[\s\S])")
END = regex.compile(rf"[{SPACE[1:-1]}▁]\Z|\A\Z")
#: Texts in which some space is not such a place.
ODD = regex.compile(rf"(?:^|[{SPACE[1:-1]}▁]) | $")
BYTE = regex.compile(r"<0x([0-9A-F]{2})>")
#: Tokens of a chunk (a slice of documents may go over it), the links that are written out one by one in a group, and the segments encoded at once.
CHUNK, PLAIN, SOME = 1 << 21, 64, 1 << 14
FIELDS = ("words", "n_words", "a", "b", "na", "nb", "la", "lb", "lg")


class Pair(NamedTuple):
    """Two tokenizers and the bytes of each of their ids."""

    a: list[bytes]
    b: list[bytes]
    enc: tiktoken.Encoding
    pieces: sentencepiece.SentencePieceProcessor
    cuts: bool


@lru_cache(maxsize=2)
def tokenizers(a_path: str, b_path: str) -> Pair:
    """A byte-level `.json` file (its special strings as plain text) and a piece model; one pair a worker process."""
    with open(a_path, encoding="utf-8") as f:
        spec = json.load(f)
    letter, special = byte_letters(), {x["content"] for x in spec["added_tokens"] if x["special"]}
    vocab = spec["model"]["vocab"]
    ranks = {bytes(letter[c] for c in token): i for token, i in vocab.items() if token not in special}
    own = [b""] * (max(vocab.values()) + 1)
    for token, i in ranks.items():
        own[i] = token
    pieces = sentencepiece.SentencePieceProcessor(model_file=b_path)
    names = [pieces.id_to_piece(i) for i in range(pieces.get_piece_size())]
    other = [bytes([int(m[1], 16)]) if pieces.is_byte(i) and (m := BYTE.fullmatch(x)) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
    enc = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return Pair(own, other, enc, pieces, not any(regex.search("[^▁]▁", x) for x in names))


def segments(text: str, cuts: bool = True) -> list[str]:
    """The text without the spaces before which it is cut; the first segment gets one, too, by the contract of A."""
    if not text or not cuts:
        return [text] if text else []
    return SAFE.split(text) if ODD.search(text) else text.split(" ")


class Encoded(NamedTuple):
    """Segments one behind the other: ids of both sides, sizes of the groups, and how many of each a segment has; which segments have none for want of equal bytes."""

    a: np.ndarray
    b: np.ndarray
    na: np.ndarray
    nb: np.ndarray
    la: np.ndarray
    lb: np.ndarray
    lg: np.ndarray
    good: np.ndarray


def joined(parts: list[Encoded]) -> Encoded:
    return Encoded(*(np.concatenate([p[k] for p in parts]) for k in range(len(Encoded._fields))))


def encode(pair: Pair, words: list[str]) -> Encoded:
    """Each segment with a space before it by A, the segment by B. They are encoded as one text, for a token ends at each of their ends.

    Where the bytes of all don't agree, halves are looked at by themselves, down to the segments without tokens. A segment that ends in
    white space stands only at the end of a text and is encoded alone.
    """
    alone, text = len(words) == 1, " ".join(words)
    # without a space behind white space in the joined text no word but the last one can end in white space
    if not alone and (not pair.cuts or (ODD.search(text) or END.search(words[-1])) and any(map(END.search, words))):
        runs: list[list[str]] = [[]]
        for w in words:
            if pair.cuts and not END.search(w):
                runs[-1].append(w)
            else:
                runs += [[w], []]
        return joined([encode(pair, r) for r in runs if r])
    a, b = ids(pair.enc, " " + text).astype(np.int32), np.array(pair.pieces.encode(text, num_threads=1), np.int32)
    bytes_a, bytes_b, raw = list(map(pair.a.__getitem__, a.tolist())), list(map(pair.b.__getitem__, b.tolist())), (" " + text).encode()
    ends = np.cumsum([1 + len(w.encode()) for w in words])
    if b"".join(bytes_a) == raw == b"".join(bytes_b):
        ends_a, ends_b = (dict(zip(accumulate(map(len, own)), count(1), strict=False)) for own in (bytes_a, bytes_b))
        common = sorted(ends_a.keys() & ends_b.keys())
        upto_a, upto_b = (np.fromiter(map(e.__getitem__, common), np.int64, len(common)) for e in (ends_a, ends_b))
        at = np.searchsorted(common, ends)
        if (np.array(common)[np.minimum(at, len(common) - 1)] == ends).all():
            sizes = (np.diff(x, prepend=0) for x in (upto_a[at], upto_b[at], at + 1))
            return Encoded(a, b, *(x.astype(np.int32) for x in (np.diff(upto_a, prepend=0), np.diff(upto_b, prepend=0), *sizes)), np.ones(len(words), bool))
    if alone:
        none = np.zeros(0, np.int32)
        return Encoded(none, none, none, none, none, none, none, np.zeros(1, bool))
    half = len(words) // 2
    return joined([encode(pair, words[:half]), encode(pair, words[half:])])


class Chunk:
    """Documents as numbers of distinct segments, and the segments' ids and groups."""

    def __init__(self, pair: Pair) -> None:
        self.pair, self.number, self.parts, self.tokens, self.docs = pair, {}, [], 0, []
        self.size = 0
        self.words: list[np.ndarray] = []

    def add(self, doc_ids: list, texts_: list[str]) -> None:
        cut = [segments(t, self.pair.cuts) for t in texts_]
        new = list({w for ws in cut for w in ws if w not in self.number})
        for words in (new[s: s + SOME] for s in range(0, len(new), SOME)):
            found = encode(self.pair, words)
            own = np.where(found.good, self.size + np.cumsum(found.good) - 1, -1)
            self.number.update(zip(words, own.tolist(), strict=True))
            self.parts.append(found)
            self.size += len(found.la)
        for d, ws in zip(doc_ids, cut, strict=True):
            found = np.fromiter(map(self.number.__getitem__, ws), np.int32, len(ws))
            self.words.append(found[:0] if (found < 0).any() else found)
            self.docs.append(d)
            self.tokens += 3 * len(ws)

    def fields(self) -> list[bytes]:
        flat = np.concatenate(self.words) if self.words else np.zeros(0, np.int32)
        whole = joined(self.parts)[:7] if self.parts else [np.zeros(0, np.int32)] * 7
        pack = zstandard.ZstdCompressor(level=1)
        return [pack.compress(x.astype("<i4").tobytes()) for x in (flat, np.array([len(w) for w in self.words]), *whole)]


def chunked(docs: DataFrame, a_path: str, b_path: str, chunk: int = CHUNK) -> DataFrame:
    """(chunk, docs, then FIELDS as compressed little-endian 32-bit integers): a row a chunk. Write it before going on: chunk is made up."""
    source = texts(docs)
    kind = source.schema["doc_id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, at, own = tokenizers(a_path, b_path), TaskContext.get().partitionId() << 36, None
        doc_type = None

        def out() -> pa.RecordBatch:
            cols = [pa.array([at]), pa.array([own.docs], pa.list_(doc_type)), *(pa.array([x], pa.binary()) for x in own.fields())]
            return pa.RecordBatch.from_arrays(cols, names=["chunk", "docs", *FIELDS])

        for batch in slices(batches, "text"):
            doc_type, own = batch.column("doc_id").type, own or Chunk(pair)
            own.add(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())
            if own.tokens >= chunk:
                yield out()
                at, own = at + 1, None
        if own:
            yield out()

    return source.mapInArrow(work, f"chunk long, docs array<{kind.dataType.simpleString()}>, {', '.join(f'{f} binary' for f in FIELDS)}")


def links(f: dict[str, np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, a * width + b, number of links) of the distinct linked pairs of each segment, sorted. Large groups go through their distinct ids."""
    a, b, na, nb = (f[x].astype(np.int64) for x in ("a", "b", "na", "nb"))
    owner, sizes, sa, sb = np.repeat(np.arange(len(f["lg"])), f["lg"]), na * nb, np.cumsum(na) - na, np.cumsum(nb) - nb
    few = np.flatnonzero(sizes <= PLAIN)
    g = np.repeat(few, sizes[few])
    at = np.arange(len(g)) - np.repeat(np.cumsum(sizes[few]) - sizes[few], sizes[few])
    who, keys, times = [owner[g]], [a[sa[g] + at // nb[g]] * width + b[sb[g] + at % nb[g]]], [np.ones(len(g), np.int64)]
    del g, at
    for k in np.flatnonzero(sizes > PLAIN).tolist():
        (ua, ca), (ub, cb) = (np.unique(x[s[k]: s[k] + n[k]], return_counts=True) for x, s, n in ((a, sa, na), (b, sb, nb)))
        keys.append((ua[:, None] * width + ub).ravel())
        times.append((ca[:, None] * cb).ravel())
        who.append(np.full(len(keys[-1]), owner[k]))
    who, keys, times = (np.concatenate(x) for x in (who, keys, times))
    span = int(keys.max(initial=0)) + 1
    if (int(who.max(initial=0)) + 1) * span < 1 << 63:  # one key sorts faster than two
        order = np.argsort(who * span + keys)
    else:
        order = np.lexsort((keys, who))
    who, keys, times = who[order], keys[order], times[order]
    del order
    first = np.flatnonzero(np.concatenate([[True], (who[1:] != who[:-1]) | (keys[1:] != keys[:-1])])) if len(keys) else np.zeros(0, np.int64)
    return who[first], keys[first], np.add.reduceat(times, first) if len(first) else times


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct integers in order, by one sort: faster here than the hash table of `np.unique`."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def held(f: dict[str, np.ndarray], who: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of a chunk and how many of its documents hold each."""
    known, place = np.unique(keys, return_inverse=True)
    n = len(f["lg"])
    doc = np.repeat(np.arange(len(f["n_words"])), f["n_words"])
    seen = distinct(doc * n + f["words"]) if n else doc
    start = np.searchsorted(who, np.arange(n + 1))
    word, many = seen % max(n, 1), np.diff(start)
    sizes = many[word]
    at = np.repeat(start[:-1][word] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    own = distinct(np.repeat(seen // max(n, 1), sizes) * max(len(known), 1) + place[at])
    return known, np.bincount(own % max(len(known), 1), minlength=len(known))


def read(row: dict) -> dict[str, np.ndarray]:
    unpack = zstandard.ZstdDecompressor()
    return {f: np.frombuffer(unpack.decompress(row[f]), "<i4").astype(np.int64) for f in FIELDS}


def chunk_pairs(chunks: DataFrame, width: int) -> DataFrame:
    """(chunk, a, b, docs): how many documents of the chunk hold the pair."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                f = read(row)
                keys, docs = held(f, *links(f, width)[:2])
                for s in range(0, len(keys), 1 << 16):
                    part = keys[s: s + (1 << 16)]
                    cols = [np.full(len(part), row["chunk"], np.int64), (part // width).astype(np.int32), (part % width).astype(np.int32), docs[s: s + (1 << 16)].astype(np.int64)]
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, cols)), names=["chunk", "a", "b", "docs"])

    return chunks.drop("docs").mapInArrow(work, "chunk long, a int, b int, docs long")


def lexicon(counted: DataFrame) -> DataFrame:
    """(a, b, n_docs, best) of all linked pairs: documents that hold the pair, and whether no pair of the same a is in more."""
    totals = counted.groupBy("a", "b").agg(F.sum("docs").alias("n_docs"))
    most = totals.groupBy("a").agg(F.max("n_docs").alias("most"))
    return totals.join(most, "a").select("a", "b", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def listed(f: dict[str, np.ndarray]) -> list[str]:
    """Each segment's groups as text: ids of A joined by commas, a bar, ids of B; groups joined by semicolons. All are written as one text."""
    na, nb = f["na"], f["nb"]
    until = np.cumsum(na + nb)  # where the ids of a group end, those of A before those of B
    numbers = np.empty(len(f["a"]) + len(f["b"]), np.int32)
    of_b = np.zeros(len(numbers), bool)
    of_b[np.repeat(until - np.cumsum(nb), nb) + np.arange(len(f["b"]))] = True
    numbers[of_b], numbers[~of_b] = f["b"], f["a"]
    digits = len(str(numbers.max(initial=0)))
    signs = np.full((len(numbers), digits + 1), ord(","), np.uint8)  # a row for a number: its digits and what stands behind it
    signs[until - nb - 1, digits], signs[until - 1, digits] = ord("|"), ord(";")
    used = np.ones(signs.shape, bool)
    for k in range(digits):
        rest = numbers // np.int32(10 ** (digits - 1 - k))
        signs[:, k] = rest % 10 + ord("0")
        used[:, k] = (rest > 0) | (k == digits - 1)
    whole = signs[used].tobytes().decode()
    at = np.concatenate([[0], np.cumsum(used.sum(axis=1))])
    at = at[np.concatenate([[0], until])[np.concatenate([[0], np.cumsum(f["lg"])])]].tolist()
    return [whole[i: max(i, j - 1)] for i, j in zip(at, at[1:], strict=False)]  # without the last semicolon


def per_segment(f: dict[str, np.ndarray], table: pd.DataFrame, width: int) -> list[np.ndarray]:
    """What each segment adds to the sums of a document; `table` has (key, n_docs, best) of the chunk's pairs, sorted by key."""
    who, keys, times = links(f, width)
    at, n = np.searchsorted(table["key"].to_numpy(), keys), len(f["lg"])
    docs, best = table["n_docs"].to_numpy()[at], table["best"].to_numpy(bool)[at]
    values = [f["la"], f["lb"], f["lg"]]
    first = np.searchsorted(who, np.arange(n + 1))
    for x in (times, times * best, times * docs):
        run = np.concatenate([[0], np.cumsum(x)])
        values.append(run[first[1:]] - run[first[:-1]])
    return values


def finished(row: dict, table: pd.DataFrame, width: int) -> Iterator[pd.DataFrame]:
    """The documents of a chunk with their groups and sums."""
    f = read(row)
    values = per_segment(f, table, width)
    ends = np.cumsum(f["n_words"])
    starts = ends - f["n_words"]
    sums = {}
    for name, x in zip(("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"), values, strict=True):
        run = np.concatenate([[0], np.cumsum(x[f["words"]])])
        sums[name] = run[ends] - run[starts]
    text, words = listed(f), f["words"]
    for s in range(0, len(ends), 256):
        some = slice(s, s + 256)
        own = [";".join([text[w] for w in words[i:j].tolist()]) for i, j in zip(starts[some].tolist(), ends[some].tolist(), strict=True)]
        yield pd.DataFrame({"doc_id": pd.Series(list(row["docs"])[some], dtype=object), "groups": own, **{k: v[some] for k, v in sums.items()}})


def align(docs: DataFrame, a_path: str, b_path: str, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, groups, n_a, n_b, n_groups, n_links, n_best, count_sum) of every row.

    `groups` is `a1,a2|b1;a3|b2,b3`: the ids of A and of B in order. A link joins an occurrence of an A id and one of a B id in a group;
    its count is the number of documents that hold its pair; n_best are the links with the highest count of their A id, ties included.
    Null and empty texts, and texts that a side does not give back byte for byte, have no tokens: '' and zeros. Repeated rows count as
    documents of their own, null doc_ids stay, an empty table gives an empty result, further columns are not looked at.
    """
    width = len(tokenizers(a_path, b_path).b)
    kind = docs.schema["doc_id"].dataType.simpleString()
    chunks = stored(chunked(docs, a_path, b_path, chunk), "aligned-chunks")
    counted = stored(chunk_pairs(chunks, width), "chunk-pairs")
    key = (F.col("a").cast("long") * width + F.col("b")).alias("key")
    entries = counted.select("chunk", "a", "b").join(lexicon(counted), ["a", "b"]).select("chunk", key, "n_docs", "best")
    both = entries.unionByName(chunks, allowMissingColumns=True).repartition("chunk").sortWithinPartitions("chunk", F.col("key").isNull(), "key")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: list[pd.DataFrame] = []
        for b in batches:
            own, at = b["key"].isna().to_numpy(), 0
            for k in np.flatnonzero(own).tolist():  # the row of a chunk comes behind its pairs
                known.append(b.iloc[at:k][["key", "n_docs", "best"]])
                yield from finished(b.iloc[k].to_dict(), pd.concat(known), width)
                known, at = [], k + 1
            known.append(b.iloc[at:][["key", "n_docs", "best"]])

    return both.mapInPandas(work, f"doc_id {kind}, groups string, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long")
