"""Collocations: phrases of two to four words whose two parts seldom occur without each other.

Every word starts one window of the longest length, its lead columns padded with null where the piece ends; only these windows are
counted, and a ROLLUP over the counted windows sums the counts of all shorter prefixes. Windows are counted inside a task before they are
shuffled. A sequence of fewer than the least number of occurrences is in no phrase, so a window ends before it would hold one. For this
the hashes of all neighbours, then of all longer sequences of frequent neighbours, are counted; the frequent ones set bits of a filter,
which has one size at any input and a slab for each share of the hashes. It never misses a frequent sequence; a rare one that it lets
through lengthens windows but changes no result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import slices, stored

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
TOKEN = re.compile(rb"[^ \t.,;:!?\n-\r]+|[.,;:!?\n-\r]")
EDGE = re.compile(rb"[ \t.,;:!?\n-\r]")
SIGNS = frozenset(b".,;:!?\n\x0b\x0c\r")
#: Bytes of a text looked at at once, words held before they are counted, hashed neighbours held before they are sent.
STEP, HELD, SENT = 1 << 20, 1 << 20, 1 << 21
#: Bits of a neighbour's hash, of its share, and of a share's slab of the filter. Three bytes are left within a share (`packed`).
HASH, SHARE, SLAB = 36, 12, 14


class Words(dict):
    """(word of one language) -> number; signs that end a piece are -1. Numbers are given anew whenever `names` is emptied."""

    def __init__(self, lang: str, names: list[tuple[str, bytes]], hashes: list[int]) -> None:
        super().__init__()
        self.lang, self.names, self.hashes, self.seed = lang, names, hashes, xxhash.xxh64_intdigest(lang.encode())

    def __missing__(self, word: bytes) -> int:
        if word[0] in SIGNS:
            found = -1
        else:
            found = len(self.names)
            self.names.append((self.lang, word))
            self.hashes.append(xxhash.xxh64_intdigest(word, self.seed))
        self[word] = found
        return found


def steps(text: str) -> Iterator[bytes]:
    """The text in order, A-Z lower-cased, in parts that end at a space or sign."""
    raw, at = text.encode("utf-8", "surrogatepass").translate(LOWER), 0
    while at < len(raw):
        m = EDGE.search(raw, at + STEP) if len(raw) - at > STEP else None
        yield raw[at: m.start() if m else len(raw)]
        at = m.start() if m else len(raw)


def flows(batches: Iterator[pa.RecordBatch], carry: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, list, np.ndarray]]:
    """(numbers, names' hashes, skipped, names, gaps) of about HELD words at a time; -1 stands where pieces and texts end.

    A text longer than that goes on in the next part, which then starts with the last `carry` numbers again; `skipped` says how many
    of the numbers at the end are to be the start of no window yet, for they come again.
    """
    names: list = []
    hashes: list = []
    langs: dict[str, Words] = {}
    held, size = [], 0
    for b in slices(batches, "text"):
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            for part in steps(text):
                words = langs.get(lang)
                if words is None:
                    words = langs[lang] = Words(lang, names, hashes)
                held.append(np.fromiter(map(words.__getitem__, TOKEN.findall(part)), np.int32))
                size += len(held[-1])
                if size >= HELD:
                    flow = np.concatenate(held)
                    last = flow[-carry:] if carry else flow[:0]
                    again = [names[i] for i in last[last >= 0].tolist()]
                    yield flow, np.array(hashes, np.uint64), len(last), names
                    names.clear(), hashes.clear(), langs.clear()
                    kept = [langs.setdefault(x, Words(x, names, hashes))[w] for x, w in again]
                    start = np.full(len(last), -1, np.int32)
                    start[last >= 0] = kept
                    held, size = [start], len(start)
            held.append(np.array([-1], np.int32))
    if held:
        yield np.concatenate(held), np.array(hashes, np.uint64), 0, names


def folded(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of a sequence and one more word."""
    return (left * np.uint64(0x9E3779B97F4A7C15) ^ (right + np.uint64(0x632BE59BD9B4E019))) * np.uint64(0xFF51AFD7ED558CCD)


def leads(flow: np.ndarray, hashes: np.ndarray, words: int, known: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For k = 0 .. words - 1 at each place with k words behind it: whether the k + 1 words can be in a phrase, and the hash of the sequence.

    `known` are the filters of words and pairs, and of longer sequences, as far as there are any yet.
    """
    fits, own = flow >= 0, hashes[np.maximum(flow, 0)] if len(hashes) else np.zeros(len(flow), np.uint64)
    mixed = own
    for k in range(words):
        mixed = folded(mixed[:-1], own[k:]) if k else own
        key = (mixed >> np.uint64(64 - HASH)).astype(np.int64)
        fits = fits[:-1] & fits[1:] if k else fits  # both sequences of a word less
        if k <= 1 and known or k > 1 and len(known) > 1:
            at = bits(key)
            fits = fits & ((known[int(k > 1)][at >> 3] << (at & 7).astype(np.uint8)) & 128 > 0).all(axis=0)
        yield fits, key


def bits(keys: np.ndarray) -> np.ndarray:
    """Two bits of a key in its share's slab of the filter."""
    low = keys & ((1 << (HASH - SHARE)) - 1)
    return (keys >> (HASH - SHARE) << SLAB) + np.stack([low >> (HASH - SHARE - SLAB), low & ((1 << SLAB) - 1)])


def packed(keys: np.ndarray, cuts: np.ndarray) -> list[bytes]:
    """Sorted keys as a value for each share, which starts at `cuts`: the low two bytes of all, then the steps of the third, mostly 0 or 1."""
    low, high = keys.astype("<u2"), keys >> 16 & 255
    step = np.diff(high, prepend=0)
    step[cuts] = high[cuts]
    step = step.astype(np.uint8)
    return [low[a:b].tobytes() + step[a:b].tobytes() for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True)]


def unpacked(value: bytes) -> np.ndarray:
    """The keys of a share, without its number."""
    n = len(value) // 3
    return np.cumsum(np.frombuffer(value, np.uint8, n, 2 * n), dtype=np.int64) << 16 | np.frombuffer(value, "<u2", n)


def sourced(docs: DataFrame) -> DataFrame:
    lang = F.coalesce(docs["lang"].cast("string"), F.lit("und"))
    return docs.select(lang.alias("lang"), docs["text"].alias("text")).where("text is not null")


def frequent(docs: DataFrame, least: int, words: int, known: list[np.ndarray]) -> np.ndarray:
    """The filter, a byte for 8 bits, of all words and pairs of neighbours of `least` occurrences or more, or, where these are known, of all longer sequences.

    `docs` has (lang, text). A task sends its sequences by shares, sorted, with counts cut at `least`, which changes no sum below it; a
    share is merged part by part and only its distinct hashes are held.
    """
    kind = np.min_scalar_type(least).newbyteorder("<")
    sent = [docs.sparkSession.sparkContext.broadcast(x) for x in known]  # tables of fixed size
    form = "share int, keys binary, counts binary"

    def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        keys, where = np.unique(np.concatenate(keys), return_inverse=True)
        return keys, np.minimum(np.bincount(where, np.concatenate(counts), len(keys)), least).astype(np.int64)

    def out(keys: list[np.ndarray], counts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not sum(map(len, keys)):
            return
        keys, counts = merged(keys, counts)
        share = keys >> (HASH - SHARE)
        cuts = np.flatnonzero(np.diff(share, prepend=-1))
        small = counts.astype(kind)
        raw = [packed(keys, cuts), [small[a:b].tobytes() for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True)]]
        yield pa.RecordBatch.from_arrays([pa.array(share[cuts].astype(np.int32)), *(pa.array(x, pa.binary()) for x in raw)], names=["share", "keys", "counts"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, size = [], [], 0
        filters = [x.value for x in sent]
        for flow, hashes, skipped, _ in flows(batches, words):
            found = [key[: len(flow) - skipped][fits[: len(flow) - skipped]] for fits, key in leads(flow, hashes, words if filters else 2, filters)]
            own, n = np.unique(np.concatenate(found[2 * len(filters):]), return_counts=True)
            keys.append(own), counts.append(n)
            size += len(own)
            if size >= SENT:
                yield from out(keys, counts)
                keys, counts, size = [], [], 0
        if size:
            yield from out(keys, counts)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, keys, counts, size, limit = None, [], [], 0, SENT

        def slab() -> Iterator[pa.RecordBatch]:
            if share is not None:
                found, n = merged(keys, counts)
                flags = np.zeros(1 << SLAB, bool)
                flags[bits(found[n >= least]).ravel()] = True
                yield pa.RecordBatch.from_arrays([pa.array([share], pa.int32()), pa.array([np.packbits(flags).tobytes()], pa.binary())], names=["share", "slab"])

        for b in batches:
            for s, k, n in zip(b.column("share").to_pylist(), b.column("keys").to_pylist(), b.column("counts").to_pylist(), strict=True):
                if s != share:
                    yield from slab()
                    share, keys, counts, size, limit = s, [], [], 0, SENT
                keys.append(unpacked(k)), counts.append(np.frombuffer(n, kind).astype(np.int64))
                size += len(keys[-1])
                if size > limit:
                    found, n = merged(keys, counts)
                    keys, counts, size, limit = [found], [n], len(found), max(SENT, 2 * len(found))
        yield from slab()

    shares = docs.mapInArrow(send, form).repartition("share").sortWithinPartitions("share").mapInArrow(decide, "share int, slab binary")
    table = np.zeros((1 << SHARE, 1 << (SLAB - 3)), np.uint8)
    for share, slab in shares.collect():  # a table of fixed size
        table[share] = np.frombuffer(slab, np.uint8)
    return table.ravel()


def windows(docs: DataFrame, words: int, known: list[np.ndarray]) -> DataFrame:
    """(lang, w1 .. wN, c): every word with the words that follow it, null behind the end of its piece or of what can be a phrase, counted inside tasks."""
    sent = [docs.sparkSession.sparkContext.broadcast(x) for x in known]  # tables of fixed size
    names_ = [f"w{k}" for k in range(1, words + 1)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = [x.value for x in sent]
        for flow, hashes, skipped, names in flows(batches, words):
            lead = []
            for k, (fits, _) in enumerate(leads(flow, hashes, words, filters)):
                lead.append(np.full(len(flow), -1, np.int32))
                lead[k][: max(0, len(flow) - k)] = np.where(fits, flow[k:], -1)
            rare = flow[: len(flow) - skipped][(flow[: len(flow) - skipped] >= 0) & (lead[0][: len(flow) - skipped] < 0)]
            starts = np.flatnonzero(lead[0][: len(flow) - skipped] >= 0)
            alone = starts[lead[1][starts] < 0]
            once = np.bincount(flow[alone], minlength=len(names))
            rows = [np.full((int((once > 0).sum()), words), -1, np.int32)]
            rows[0][:, 0] = np.flatnonzero(once)
            long = np.stack([x[starts[lead[1][starts] >= 0]] for x in lead], axis=1)
            order = np.lexsort(long.T[::-1])
            long = long[order]
            new = np.ones(len(long), bool)
            new[1:] = (long[1:] != long[:-1]).any(axis=1)
            first = np.flatnonzero(new)
            rows = np.concatenate([rows[0], long[first]])
            counts = np.concatenate([once[once > 0], np.diff(np.append(first, len(long)))])
            # rare words only count as words of their language: a row of pads for each
            seen: dict[str, int] = {}
            code = np.array([seen.setdefault(x, len(seen)) for x, _ in names], np.int64)
            others = np.bincount(code[rare], minlength=len(seen))
            some = np.flatnonzero(others)
            who = np.concatenate([rows[:, 0], np.array([int(np.argmax(code == x)) for x in some], np.int64)]).astype(np.int32)
            rows = np.concatenate([rows, np.full((len(some), words), -1, rows.dtype)])
            counts = np.concatenate([counts, others[some]])
            text = pa.array([w.decode("utf-8", "surrogatepass") for _, w in names], pa.string())
            tongue = pa.array([x for x, _ in names], pa.string())
            for s in range(0, len(rows), 1 << 15):
                part = rows[s: s + (1 << 15)]
                cols = [text.take(pa.array(part[:, k], pa.int32(), mask=part[:, k] < 0)) for k in range(words)]
                yield pa.RecordBatch.from_arrays([tongue.take(pa.array(who[s: s + (1 << 15)])), *cols, pa.array(counts[s: s + (1 << 15)], pa.int64())], names=["lang", *names_, "c"])

    return docs.mapInArrow(work, f"lang string, {', '.join(f'{x} string' for x in names_)}, c long")


def counts(docs: DataFrame, least: int = 30, words: int = 4) -> DataFrame:
    """(lang, k, phrase, f) of all phrases of 1 to `words` words with f >= `least` occurrences; k = 0 has a language's number of words."""
    names = [f"w{k}" for k in range(1, words + 1)]
    source = sourced(docs)
    pairs = frequent(source, least, words, [])
    seen = windows(source, words, [pairs, frequent(source, least, words, [pairs])] if words > 2 else [pairs])
    # whole windows are summed first: the shuffle from the tasks holds each of them once, not once for every prefix
    whole = seen.groupBy("lang", *names).agg(F.sum("c").alias("c"))
    summed = whole.rollup("lang", *names).agg(F.sum("c").alias("f"), F.grouping_id().alias("g"))
    # of a prefix of k words the last words - k columns are rolled up; a pad within the prefix is no phrase
    k = reduce(lambda rest, n: F.when(F.col("g") == (1 << (words - n)) - 1, F.lit(n)).otherwise(rest), range(words + 1), F.lit(-1)).alias("k")
    summed = summed.select("lang", *names, "f", k).where((F.col("k") == 0) | ((F.col("k") > 0) & (F.col("f") >= least)))
    full = F.size(F.filter(F.array(*names), lambda w: w.isNotNull())) == F.col("k")
    return summed.where(full).select("lang", "k", F.concat_ws(" ", *names).alias("phrase"), "f")


def mine(docs: DataFrame, least: int = 30, words: int = 4, within: int = 80, top: int = 2000, scale: int = 2_000_000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases by score, then occurrences, then text.

    A phrase cut after its first words has a part on each side; its score is that of the lowest cut, scale * a / (l + r) in whole
    numbers. A phrase inside a longer one that has `within` percent of its occurrences or more is left out. Null languages are `und`,
    null and empty texts have no words, repeated rows count again, an empty table gives an empty result; only lang and text are read.
    """
    known = stored(counts(docs, least, words), "phrases")
    one = known.where("k > 0").select("lang", "phrase", "f")
    asked = known.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cut = asked.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    both = cut.withColumn("left", F.array_join(F.slice("w", F.lit(1), F.col("cut")), " ")).withColumn("right", F.array_join(F.slice("w", F.col("cut") + 1, F.size("w")), " "))
    both = both.join(one.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(one.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    score = F.expr(f"cast(a as decimal(20,0)) * cast({scale} as decimal(10,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    lowest = both.withColumn("score", score).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("m"))
    # the words of a longer phrase hold those of a shorter one where the joined words start or end with it or have it in the middle
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("k") - n + 1), lambda s: F.array_join(F.slice("w", s, n), " "))))
    inner = asked.where("k > 2").select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = lowest.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | F.expr(f"cast(longer as decimal(20,0)) * 100 < cast(a as decimal(20,0)) * {within}"))
    n = known.where("k = 0").select("lang", F.col("f").alias("n"))
    order = "row_number() over (partition by lang order by score desc, a desc, phrase)"
    best = left.select("lang", "phrase", "a", F.col("m.l").alias("l"), F.col("m.r").alias("r"), F.col("m.score").alias("score")).withColumn("rank", F.expr(order)).where(F.col("rank") <= top)
    return best.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
