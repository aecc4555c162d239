"""Benchmark passages in documents by spaced seeds, verified word by word with substitutions allowed.

A mask picks some of the words of a short stretch and ignores the others, so a substituted word at an ignored place changes no
hash. Hashes of the test items are joined with those of the documents; only hashes that pass a filter of fixed size, made of the
item hashes, leave the documents' tasks. Around each hit item and document are laid over each other word by word: they overlap if
in some stretch of WINDOW words (of a whole shorter item) at least the share SIMILAR agrees. MASKS find every such overlap of
items of at least LEAST words: for each placement of the allowed substitutions one of them fits somewhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import stored, texts

WORD = re.compile(r"\w+")
#: Chosen by a greedy search over all masks of six words in stretches of up to 12.
MASKS = ((0, 1, 2, 3, 5, 6), (0, 1, 4, 6, 7, 8), (0, 1, 2, 4, 8, 9), (0, 2, 3, 4, 5, 6), (0, 1, 2, 4, 5, 7), (0, 2, 3, 6, 7, 8))
SPAN = 1 + max(m[-1] for m in MASKS)
WINDOW, SIMILAR, LEAST = 20, 0.8, 8
#: Bits of the filter as a power of two, and words handled at once.
FILTER, PART = 24, 1 << 18
_ODD = np.random.default_rng(4).integers(1 << 62, (1 << 63) - 1, 16, np.uint64) * np.uint64(2) + np.uint64(1)


def words(text: str) -> np.ndarray:
    """64-bit hashes of the lower-cased words."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, WORD.findall(text.lower())), np.uint64)


def seeds(w: np.ndarray) -> Iterator[np.ndarray]:
    """For each mask the hash at each position of the words where the mask fits."""
    scaled = [w * _ODD[j] for j in range(len(MASKS[0]))]
    for k, mask in enumerate(MASKS):
        n = max(0, len(w) - mask[-1])
        h = np.full(n, _ODD[8 + k])
        for j, o in enumerate(mask):
            h += scaled[j][o: o + n]
        h ^= h >> np.uint64(31)
        h *= _ODD[7]
        yield h


def probes(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two places in the filter of a hash."""
    return (h >> np.uint64(64 - FILTER)).astype(np.int64), (h & np.uint64((1 << FILTER) - 1)).astype(np.int64)


def item_seeds(items: DataFrame) -> DataFrame:
    """(h, item_id, at, x: both filter places) of items (item_id, words)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for item, raw in zip(b["item_id"], b["words"], strict=True):
                for h in seeds(np.frombuffer(raw, "<u8")):
                    p, q = probes(h)
                    yield pd.DataFrame({"h": h.view(np.int64), "item_id": item, "at": np.arange(len(h)), "p": p, "q": q})

    return items.mapInPandas(work, f"h long, item_id {items.schema['item_id'].dataType.simpleString()}, at long, p long, q long")


def bit_filter(found: DataFrame) -> np.ndarray:
    """One flag for each of the filter's places; at most 2^(FILTER - 6) rows reach the driver."""
    bits = found.select(F.explode(F.array("p", "q")).alias("x")).groupBy(F.shiftright("x", 6).alias("word"))
    rows = bits.agg(F.bit_or(F.expr("shiftleft(1L, cast(x & 63 as int))")).alias("bits")).toPandas()
    table = np.zeros(1 << (FILTER - 6), "<i8")
    table[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return table.view(np.uint8)


def regions(docs: DataFrame, places: np.ndarray) -> DataFrame:
    """Stretches of documents around hashes that pass the filter, with those hashes: (doc_id, start, rid, words, at, h)."""
    send = docs.sparkSession.sparkContext.broadcast(places)

    def hits(flow: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, hs = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for b in range(0, len(flow), PART):
            for h in seeds(flow[b: b + PART + SPAN - 1]):
                h = h[:PART]
                i = np.flatnonzero(flags[(h >> np.uint64(64 - FILTER)).astype(np.int64)])
                i = i[flags[probes(h[i])[1]]]
                at.append(i + b)
                hs.append(h[i])
        return np.concatenate(at), np.concatenate(hs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.unpackbits(send.value, bitorder="little").astype(bool)
        for b in batches:
            kind, out, held, size = b.schema.field(0).type, [[] for _ in range(6)], [], 0
            for k, (doc, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                held.append((doc, words(text)))
                size += len(held[-1][1])
                if size < PART and k + 1 < b.num_rows:
                    continue
                flow, ends = np.concatenate([w for _, w in held]), np.cumsum([len(w) for _, w in held])
                at, hs = hits(flow, flags)
                order = np.argsort(at, kind="stable")
                at, hs = at[order], hs[order]
                doc_of = np.searchsorted(ends, at, "right")
                cuts = np.flatnonzero((np.diff(at) > 2 * WINDOW) | (np.diff(doc_of) > 0)) + 1
                for x, y in zip([0, *cuts], [*cuts, len(at)], strict=True):
                    if x == y:
                        continue
                    d = int(doc_of[x])
                    first, last = int(ends[d] - len(held[d][1])), int(ends[d])
                    s, e = max(first, int(at[x]) - WINDOW), min(last, int(at[y - 1]) + SPAN + WINDOW)
                    raw = flow[s:e].tobytes()
                    row = (held[d][0], s - first, xxhash.xxh64_intdigest(raw) - (1 << 63), raw, (at[x:y] - first).tolist(), hs[x:y].view(np.int64).tolist())
                    for col, v in zip(out, row, strict=True):
                        col.append(v)
                held, size = [], 0
            types = [kind, pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["doc_id", "start", "rid", "words", "at", "h"])

    source = texts(docs)
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(work, f"doc_id {kind}, start long, rid long, words binary, at array<long>, h array<long>")


def overlap(doc: np.ndarray, start: int, item: np.ndarray, shift: int) -> tuple[int, int, int]:
    """Agreeing words in the stretches that overlap, and where those begin and end in the document; zeros if there are none.

    `doc` are the document's words from `start` on; word i of the item lies over word i + shift of the document.
    """
    low, high = max(0, start - shift), min(len(item), start + len(doc) - shift)
    size = min(WINDOW, len(item))
    if high - low < size:
        return 0, 0, 0
    same = doc[low + shift - start: high + shift - start] == item[low:high]
    sums = np.concatenate([[0], np.cumsum(same)])
    good = np.flatnonzero(sums[size:] - sums[:-size] >= SIMILAR * size - 1e-9)
    if not len(good):
        return 0, 0, 0
    cover = np.zeros(len(same) + 1, np.int64)
    np.add.at(cover, good, 1)
    np.add.at(cover, good + size, -1)
    cover = np.cumsum(cover)[:-1] > 0
    return int((same & cover).sum()), int(good[0]) + low + shift, int(good[-1]) + size + low + shift


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_words, start, end) of each document and benchmark item that overlap, at the best place, in words.

    Items with equal words are one for the search and all reported. Null and empty texts, and items of fewer than LEAST words,
    overlap with nothing. Repeated documents of one id are one result; null ids are kept; empty tables give an empty result.
    """
    own = texts(benchmark, "item_id")
    kind, doc_kind = own.schema["item_id"].dataType.simpleString(), texts(docs).schema["doc_id"].dataType.simpleString()

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"member": b["item_id"], "words": [words(t).tobytes() for t in b["text"]]})

    members = stored(own.mapInPandas(hashed, f"member {kind}, words binary").where(F.octet_length("words") >= 8 * LEAST), "items")
    items = stored(members.groupBy("words").agg(F.min("member").alias("item_id")), "item-classes")
    found = stored(item_seeds(items), "item-seeds")
    near = stored(regions(docs, bit_filter(found)).dropDuplicates(["doc_id", "start", "rid"]), "regions")
    hits = near.select("doc_id", "start", "rid", F.explode(F.arrays_zip("at", "h")).alias("x")).select("doc_id", "start", "rid", F.col("x.at").alias("pos"), F.col("x.h").alias("h"))
    # an alignment counts once, however many seeds hit on it
    lines = hits.join(found.select("h", "item_id", "at"), "h").select("doc_id", "start", "rid", "item_id", (F.col("pos") - F.col("at")).alias("shift")).distinct()
    lines = lines.alias("l").join(near.select("doc_id", "start", "rid", "words").alias("r"), F.expr("l.doc_id <=> r.doc_id and l.start = r.start and l.rid = r.rid"))
    lines = lines.select("l.*", "words").join(items.select("item_id", F.col("words").alias("item")), "item_id")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [overlap(np.frombuffer(w, "<u8"), s, np.frombuffer(i, "<u8"), d) for w, s, i, d in zip(b["words"], b["start"], b["item"], b["shift"], strict=True)]
            b["n_words"], b["from"], b["to"] = zip(*got, strict=True) if got else ([], [], [])
            yield b.loc[b["n_words"] > 0, ["doc_id", "item_id", "n_words", "from", "to"]]

    good = lines.select("doc_id", "item_id", "start", "shift", "words", "item").mapInPandas(verify, f"doc_id {doc_kind}, item_id {kind}, n_words long, from long, to long")
    best = good.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_words", (-F.col("from")).alias("b"), "to")).alias("x"))
    best = best.select("doc_id", "item_id", "x.n_words", (-F.col("x.b")).alias("start"), F.col("x.to").alias("end"))
    same = members.join(items, "words").select("item_id", "member")
    return best.join(same, "item_id").select("doc_id", F.col("member").alias("item_id"), "n_words", "start", "end")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` whose doc_id holds no benchmark item; a null doc_id goes if any row with a null doc_id holds one."""
    bad = contaminated(docs, benchmark).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_bad"]), "left_anti")
