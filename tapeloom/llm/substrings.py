"""Repeated byte strings by a sampled suffix array: every string of at least `least` bytes that also starts earlier is cut out.

Anchors are chosen by content: grams of GRAM bytes whose hash is smallest in some window, so that any two equal strings of
`least` bytes hold an anchor at the same place. Only the suffixes that start at anchors are gathered, by the anchor's hash. The
`least - GRAM` bytes to either side of an anchor, its context, hold all strings of `least` bytes around it. Equal contexts are one
class, whose earliest member decides; in a task all others are known to be repeats before anything is shuffled.

Where an anchor has several contexts they are fetched. A task sorts the suffixes of its anchors, and the bytes before them, column
by column, are the sampled Burrows-Wheeler transform. All suffixes that share the anchor and the most bytes after it are an interval. Breadth-first
backward extension adds one byte before the anchor at a time and splits intervals by it, while the demand on the bytes after it
falls by one, so common prefixes up to `least` bytes and none longer are derived; what still shares an interval is a repeated
string. An anchor with very many contexts is not gathered: its strings are grouped by digest in Spark instead, which is exact too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import blocks, stored, texts

GRAM = 32
#: Contexts of one anchor that one task may hold, and bytes handled at once.
GATHER, PART = 32_768, 1 << 20
#: Contexts of one anchor in one task from which on it is dealt out by context, and anchors that a task holds at once.
HOT, HELD = 4096, 1_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place on: doubled from pairs, then mixed."""
    h, size = data.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x2545F4914F6CDD1D), 1
    while size < GRAM:
        h = (h[:-size] ^ (h[:-size] >> np.uint64(29))) * _MIX + h[size:]
        size *= 2
    h ^= h >> np.uint64(32)
    h *= _MIX
    return h ^ (h >> np.uint64(29))


def sliding(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """Smallest or largest of each `width` neighbours."""
    done, out = 1, x
    while done < width:
        step = min(done, width - done)
        out = best(out[:-step], out[step:])
        done += step
    return out


def anchors(data: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors and their hashes; in blocks, whose seams see all windows."""
    places, hashes, width = [], [], least - GRAM + 1
    for at in range(0, max(0, len(data) - least + 1), PART):
        # all windows that start in this block; a place is chosen if it is smallest in one of them
        h = gram_hashes(data[at: at + PART + least - 1])
        low = sliding(h, width, np.minimum)
        padded = np.concatenate([np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)])
        chosen = np.flatnonzero(sliding(padded, width, np.maximum) == h)
        places.append(chosen + at)
        hashes.append(h[chosen])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    place, first = np.unique(np.concatenate(places), return_index=True)
    return place, np.concatenate(hashes)[first]


def anchor_rows(docs: DataFrame, least: int, hot: int) -> DataFrame:
    """(slot, anchor, context, doc_id, at, kind): anchors of documents with a digest of their contexts, reduced inside each task.

    Of equal contexts in a task only the first goes on as an anchor (kind 0); the others are not first anywhere and are spans
    already (kind 1). An anchor with over `hot` contexts in one task is dealt out by context (kind 2), and a row of kind 3 tells so
    at the anchor's own slot.
    """
    side = least - GRAM

    def reduced(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        anchor, context, doc, at = (np.concatenate(c) for c in zip(*parts, strict=True))
        by = np.lexsort((at, doc, context, anchor))
        anchor, context, doc, at = anchor[by], context[by], doc[by], at[by]
        new = np.append(True, (anchor[1:] != anchor[:-1]) | (context[1:] != context[:-1]))[: len(anchor)]
        first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(anchor) else by
        kind = np.where(new | ((doc == doc[first]) & (at == at[first])), 0, 1)
        keys, place, many = np.unique(anchor[new], return_inverse=True, return_counts=True)
        wide = np.zeros(len(anchor), bool)  # at the first of each context
        wide[new] = many[place] > hot
        kind = np.where((kind == 0) & wide[first], 2, kind)
        told = keys[many > hot]
        slot = np.where(kind == 0, anchor, anchor ^ (context * 0x9E3779B1) ^ np.where(kind == 1, doc * 0x85EBCA77 + at, 0))
        cols = [np.concatenate([a, b]) for a, b in ((slot, told), (anchor, told), (context, told), (doc, np.zeros_like(told)), (at, np.zeros_like(told)), (kind, np.full_like(told, 3)))]
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=["slot", "anchor", "context", "doc_id", "at", "kind"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                place, h = anchors(np.frombuffer(raw, np.uint8), least)
                if not len(place):
                    continue
                digest = xxhash.xxh3_64_intdigest
                context = np.array([digest(raw[max(0, p - side): p + GRAM + side], min(p, side)) for p in place.tolist()], np.uint64)
                held.append((h.view(np.int64), context.view(np.int64), np.full(len(place), doc, np.int64), place))
                size += len(place)
                if size >= HELD:
                    yield reduced(held)
                    held, size = [], 0
        if held:
            yield reduced(held)

    return docs.mapInArrow(work, "slot long, anchor long, context long, doc_id long, at long, kind long")


def sorted_out(rows: DataFrame, least: int, gather: int) -> DataFrame:
    """(doc_id, at, anchor, contexts): contexts is 0 for a member whose whole context came before, else how many its anchor has.

    Members of anchors with one context that are its first have nothing to tell.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in blocks(batches, "slot", HELD // 8):
            slot, anchor, context, doc, at, kind = (g[c].to_numpy() for c in ("slot", "anchor", "context", "doc_id", "at", "kind"))
            edge = np.append(True, (slot[1:] != slot[:-1]) | (anchor[1:] != anchor[:-1]))
            group = np.cumsum(edge) - 1
            live = (kind == 0) | (kind == 2)
            new = live & (edge | np.append(True, context[1:] != context[:-1]))
            first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            again = (kind == 1) | (live & ((doc != doc[first]) | (at != at[first])))
            many = np.where(np.bincount(group, kind >= 2) > 0, gather + 1, np.bincount(group, new).astype(np.int64))[group]
            keep = again | (new & (many > 1))
            yield pd.DataFrame({"doc_id": doc[keep], "at": at[keep], "anchor": anchor[keep], "contexts": np.where(again, 0, many)[keep]})

    order = ["slot", "anchor", "context", "doc_id", "at"]
    return rows.repartition("slot").sortWithinPartitions(*order).mapInPandas(work, "doc_id long, at long, anchor long, contexts long")


def repeated(suffixes: np.ndarray, before: np.ndarray, left: np.ndarray, right: np.ndarray, order: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each context (of any anchors) the least and the most bytes before the anchor at which its string of `least` bytes is in an earlier one.

    `suffixes`: rows of anchor and bytes after it, zero-padded; `before`: rows of bytes before it, the nearest first; `left` and
    `right`: how many of these there are; `order`: the rank of each context's earliest member. (-1, -1) where none is repeated.
    """
    side, n = least - GRAM, len(suffixes)
    wide = np.pad(suffixes, ((0, 0), (0, -suffixes.shape[1] % 8))).view(">u8")
    sort = np.lexsort(wide.T[::-1])
    s, b, left, right, order = suffixes[sort], before[sort], left[sort], right[sort], order[sort]
    # common prefix of sorted neighbours, up to the whole row
    differ = s[1:] != s[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), s.shape[1])
    low, high = np.full(n, -1), np.full(n, -1)
    behind = np.zeros(n, np.int64)  # interval by the bytes before, extended backwards
    for level in range(side + 1):
        if level:
            behind = np.unique(behind * 257 + np.where(left >= level, b[:, level - 1].astype(np.int64), 256), return_inverse=True)[1]
        ahead = np.concatenate([[0], np.cumsum(common < least - level)])
        fit = np.flatnonzero((left >= level) & (right >= side - level))
        if len(fit) < 2:
            continue
        key = ahead[fit] * n + behind[fit]
        by = np.lexsort((order[fit], key))
        new = np.append(True, key[by[1:]] != key[by[:-1]])
        least_order = order[fit[by]][np.flatnonzero(new)[np.cumsum(new) - 1]]
        later = fit[by[order[fit[by]] > least_order]]
        low[later] = np.where(low[later] < 0, level, low[later])
        high[later] = level
    out_low, out_high = np.empty(n, np.int64), np.empty(n, np.int64)
    out_low[sort], out_high[sort] = low, high
    return out_low, out_high


def spans_of(docs: DataFrame, packed: DataFrame, least: int, gather: int, hot: int) -> DataFrame:
    """(doc_id, start, end): byte spans to remove; they may overlap."""
    side = least - GRAM
    told = stored(sorted_out(anchor_rows(docs, least, hot), least, gather), "anchors")
    whole = told.where("contexts = 0").select("doc_id", F.greatest(F.lit(0), F.col("at") - side).alias("start"), (F.col("at") + GRAM + side).alias("end"))
    asked = told.where("contexts > 0").groupBy("doc_id").agg(F.collect_list(F.struct("at", "anchor", "contexts")).alias("asked"))  # at most a document's anchors
    names = ["anchor", "contexts", "doc_id", "at", "left", "bytes"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in names]

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:5]), pa.array(out[5], pa.binary())], names=names)

        for b in batches:
            for doc, blob, todo in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                raw = zstandard.decompress(blob)
                for x in todo:
                    at = x["at"]
                    for col, v in zip(out, (x["anchor"], x["contexts"], doc, at, min(at, side), raw[max(0, at - side): at + GRAM + side]), strict=True):
                        col.append(v)
                if len(out[0]) > 20_000:
                    yield batch()
                    out = [[] for _ in names]
        yield batch()

    contexts = packed.join(asked, "doc_id").select("doc_id", "packed", "asked").mapInArrow(cut, "anchor long, contexts long, doc_id long, at long, left long, bytes binary")

    def extend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in blocks(batches, "anchor", gather):
            g = {c: b[c].to_numpy() for c in b.columns}
            n, left = len(b), g["left"]
            size = np.array([len(x) for x in g["bytes"]], np.int64)
            flat = np.frombuffer(b"".join(x.rjust(len(x) + side - k, b"\0").ljust(2 * side + GRAM, b"\0") for x, k in zip(g["bytes"], left.tolist(), strict=True)), np.uint8).reshape(n, -1)
            order = np.unique(np.stack([g["doc_id"], g["at"]], axis=1), axis=0, return_inverse=True)[1].reshape(-1)
            low, high = repeated(flat[:, side:], flat[:, :side][:, ::-1], left, size - left - GRAM, order, least)
            if (found := high >= 0).any():
                yield pd.DataFrame({"doc_id": g["doc_id"][found], "start": (g["at"] - high)[found], "end": (g["at"] - low)[found] + least})

    few = contexts.where(F.col("contexts") <= gather).repartition("anchor").sortWithinPartitions("anchor").mapInPandas(extend, "doc_id long, start long, end long")
    out = whole.union(few)
    if told.where(F.col("contexts") > gather).isEmpty():
        return out
    # very frequent anchors: each string by its digest
    string = F.expr(f"substring(bytes, cast(left - level + 1 as int), {least})")
    each = contexts.where(F.col("contexts") > gather).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(side))))
    each = each.where(f"level <= left and left - level + {least} <= octet_length(bytes)").select(F.sha2(string, 256).alias("string"), "doc_id", (F.col("at") - F.col("level")).alias("start"))
    first = each.groupBy("string").agg(F.min(F.struct("doc_id", "start")).alias("first"))
    many = each.join(first, "string").where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("start") != F.col("first.start"))).select("doc_id", "start", (F.col("start") + least).alias("end"))
    return out.union(many)


def packed_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, packed): the UTF-8 bytes compressed, so that shuffles move a third of them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            press = zstandard.ZstdCompressor(level=1)
            packed = [press.compress(t.encode("utf-8", "surrogatepass")) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.binary())], names=["doc_id", "packed"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, packed binary")


def remove(raw: bytes, cut: list[tuple[int, int]]) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of the bytes, and the maximal removed runs."""
    gone: list[tuple[int, int]] = []
    for s, e in sorted(cut):
        s, e = min(s, len(raw)), min(e, len(raw))
        if gone and s <= gone[-1][1]:
            gone[-1] = (gone[-1][0], max(gone[-1][1], e))
        elif s < e:
            gone.append((s, e))
    kept, at = [], 0
    for s, e in gone:
        kept.append(raw[at:s])
        at = e
    return b"".join([*kept, raw[at:]]), gone


def dedup(docs: DataFrame, least: int = 100, gather: int = GATHER, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, kept, spans) of every row: bytes covered by a string of `least` bytes that also starts earlier are cut.

    Earlier: in a smaller doc_id, or in the same document further left; overlaps count, and all is judged on the input. `kept` are
    the other bytes, `spans` the maximal removed runs (start, end). Null and empty texts, and those shorter than `least`, stay
    whole, and so do rows with a null doc_id. Rows with equal doc_id and text are one document and get the same result. doc_id is
    the key: where rows share one with different texts, a span found in any of them is cut from each that reaches so far. An empty
    table gives an empty result.
    """
    if least < 2 * GRAM:
        raise ValueError(f"strings of at least {2 * GRAM} bytes")
    source = texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    packed = packed_texts(source)
    cut = spans_of(source.where(f"doc_id is not null and octet_length(text) >= {least}"), packed, least, gather, hot)
    per = cut.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list(F.struct("start", "end")).alias("cut"))  # at most a few for each of a document's anchors
    both = packed.join(per, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "packed", "cut")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            sizes, kept, gone = [], [], []
            for blob, todo in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw = zstandard.decompress(blob)
                left, out = remove(raw, [(x["start"], x["end"]) for x in todo or ()])
                sizes.append(len(raw))
                kept.append(left)
                gone.append([{"start": s, "end": e} for s, e in out])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(gone, span)], names=["doc_id", "n_bytes", "kept", "spans"])

    return both.mapInArrow(work, "doc_id long, n_bytes long, kept binary, spans array<struct<start:long,end:long>>")
