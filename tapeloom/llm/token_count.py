"""Token counts of whole texts; huge documents are counted in overlapping chunks spliced where both sides provably agree.

A chunk's pre-tokens are matched left to right and depend on nothing before their start. So if the left chunk, right from its own
splice on, and the right chunk both have a boundary at the same place, everything from there on is the same in the right chunk and
in the whole text. A left boundary counts only where its match ended LOOK characters before the chunk's end: no match looks
further, nor is a special string longer. The tokens of a pre-token depend on it alone. Where the overlap holds no common boundary
the chunk and the overlap are widened for that text, at last to the whole text, so every count is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import stored, texts
from tapeloom.llm.tokens import PATTERN, encoder, ids

#: Characters behind a match that can have had a say in it; special strings must be shorter.
LOOK = 64


def boundaries(path: str, text: str) -> tuple[list[int], list[int]]:
    """Where the pre-tokens of the text start, and its end; and how many tokens lie before each of these places."""
    enc, at, count, ends, sums = encoder(path), 0, 0, [0], [0]
    special = regex.compile("|".join(map(regex.escape, sorted(enc.special_tokens_set, key=len, reverse=True))) or r"(?!)")
    word = regex.compile(PATTERN)
    while at < len(text):
        m = special.search(text, at)
        for w in word.finditer(text, at, m.start() if m else len(text)):
            count += len(enc.encode_ordinary(w[0]))
            ends.append(w.end())
            sums.append(count)
        at = len(text)
        if m:
            count, at = count + 1, m.end()
            ends.append(at)
            sums.append(count)
    return ends, sums


def spliced(texts_: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """(sha, n_tokens) of the texts (sha, text); n_tokens is null where some overlap holds no common boundary."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for sha, text in zip(b["sha"], b["text"], strict=True):
                starts = list(range(0, max(1, len(text) - overlap), chunk))
                for k, s in enumerate(starts):
                    yield pd.DataFrame({"sha": [sha], "k": [k], "start": [s], "last": [k + 1 == len(starts)], "part": [text[s:] if k + 1 == len(starts) else text[s: s + chunk + overlap]]})

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for sha, k, start, last, part in b.itertuples(index=False):
                ends, sums = boundaries(path, part)
                head = [(start + e, n) for e, n in zip(ends, sums, strict=True) if k and e <= overlap]
                tail = [(start + e, n) for e, n in zip(ends, sums, strict=True) if not last and chunk <= e <= len(part) - LOOK]
                yield pd.DataFrame({"sha": [sha], "k": [k], "last": [last], "total": [sums[-1]], "head": [dict(head)], "tail": [dict(tail)]})

    parts = texts_.select("sha", "text").mapInPandas(cut, "sha string, k int, start long, last boolean, part string")
    parts = parts.repartition("sha", "k").mapInPandas(encode, "sha string, k int, last boolean, total long, head map<long,long>, tail map<long,long>")
    parts = stored(parts, "token-chunks")
    left = parts.where("not last").select("sha", (F.col("k") + 1).alias("k"), "tail")
    seams = parts.where("k > 0").select("sha", "k", "head").join(left, ["sha", "k"])
    place = F.array_min(F.array_intersect(F.map_keys("head"), F.map_keys("tail")))
    seams = seams.withColumn("p", place).select("sha", F.element_at("tail", F.col("p")).alias("upto"), F.element_at("head", F.col("p")).alias("before"))
    seams = seams.groupBy("sha").agg(F.sum(F.col("upto") - F.col("before")).alias("moved"), F.count(F.lit(1)).alias("all"), F.count("upto").alias("met"))
    ends = parts.groupBy("sha").agg(F.sum(F.when(F.col("last"), F.col("total")).otherwise(0)).alias("end"))
    return ends.join(seams, "sha", "left").select("sha", F.when(F.coalesce(F.col("all") == F.col("met"), F.lit(True)), F.col("end") + F.coalesce("moved", F.lit(0))).alias("n_tokens"))


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, huge: int = 60_000, chunk: int = 30_000, overlap: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row by the byte-level BPE file at `path`, over whole texts.

    Texts of over `huge` characters go through chunks, equal ones once. Null and empty texts have no bytes and no tokens; repeated
    rows are each counted; null doc_ids stay; an empty table gives an empty result.
    """
    source = texts(docs)
    kind = source.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = pa.array([len(ids(path, x)) for x in b.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), n], names=["doc_id", "n_bytes", "n_tokens"])

    measured = source.withColumn("n_bytes", F.octet_length("text").cast("long"))
    small = measured.where(F.length("text") <= huge).mapInArrow(work, f"doc_id {kind}, n_bytes long, n_tokens long")
    big = measured.where(F.length("text") > huge).withColumn("sha", F.sha2("text", 256))
    once = stored(big.groupBy("sha").agg(F.min("text").alias("text")), "huge-texts")
    longest, done = once.agg(F.max(F.length("text"))).first()[0] or 0, None
    todo = once
    while longest:
        now = stored(spliced(todo, path, chunk, overlap), "token-counts")
        good = now.where("n_tokens is not null")
        done = good if done is None else done.union(good)
        if now.where("n_tokens is null").isEmpty():
            break
        todo, chunk, overlap = once.join(now.where("n_tokens is null").select("sha"), "sha"), chunk * 4, overlap * 8
    if done is not None:
        small = small.union(big.select("doc_id", "n_bytes", "sha").join(done, "sha").select("doc_id", "n_bytes", "n_tokens"))
    return small.withColumn("over_limit", F.col("n_tokens") > limit)
