"""Near copies by SimHash fingerprints searched with BK-trees in shards; the Jaccard similarity of the word shingles decides.

Texts with equal shingle sets are one class. Its fingerprint has `PARTS` times 64 bits: bits of sets with a similarity of 0.8 differ with
odds of 0.15 (0.19 for the smallest sets), so over `RADIUS` of them differ with odds of 1 in 10 ** 9 at most, and 1 in 10 ** 7 of unlike
pairs are within it (of sets of fewer than ten shingles up to 1 in 500). At such a radius two fingerprints may differ in every band of
their own bits; so the shards, the buckets, are those of min-hashes: a class has `BANDS` band values, each of `ROWS` minima. A pair at 0.8 shares none with odds of 0.738 ** 32 = 0.006%, and
then still may meet through others. In each bucket the smallest class is a root that every other is held against first. Only buckets
that still hold more than one component of the links found go on: a block of classes is a tree, another its queries, each pair of blocks
a task unit of bounded size. Pairs within the radius are then decided by their shingle sets.

Texts travel as compressed words, a third of their shingle hashes; the sets are made again for classes that have a candidate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import components, runs, stored, texts
from tapeloom.llm.simhash import LOWER, PART, BKTree, set_bits

BANDS, ROWS = 32, 6
FACTORS = np.random.default_rng(7).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
#: 64-bit parts of a fingerprint, and the differing bits up to which two of them are searched.
PARTS, RADIUS = 4, 86
#: Shingles whose min-hashes are taken at once.
STEP = 4096


def shingles(text: str, shingle: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles: A-Z lower-cased, words between ASCII white space. A shorter text is one shingle; no word, none."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    n, digest = max(1, len(words) - shingle + 1), xxhash.xxh64_intdigest
    if n == 1:
        return np.array([digest(b" ".join(words))], np.uint64)
    found = []
    for at in range(0, n, PART):
        part = words[at: at + PART + shingle - 1]
        found.append(np.unique(np.array([digest(b" ".join(x)) for x in zip(*(part[i:] for i in range(shingle)), strict=False)], np.uint64)))
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def bands(tokens: np.ndarray) -> list[int]:
    """The band values of a shingle set as signed numbers; of an empty set none."""
    if not len(tokens):
        return []
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(tokens), STEP):
        np.minimum(least, (FACTORS[:, None] * tokens[None, at: at + STEP]).min(axis=1), out=least)
    raw, width = least.tobytes(), 8 * ROWS
    return np.array([xxhash.xxh64_intdigest(raw[i: i + width]) for i in range(0, len(raw), width)], np.uint64).view(np.int64).tolist()


def fingerprint(tokens: np.ndarray) -> bytes:
    """The fingerprint of a shingle set: a bit is set if it is in over half of the hashes; of an empty set none is."""
    votes = np.zeros(64 * PARTS, np.int64)
    for at in range(0, len(tokens), STEP):
        x = tokens[at: at + STEP, None] + np.arange(1, PARTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        votes += set_bits(x ^ (x >> np.uint64(31)))
    return np.packbits(votes * 2 > len(tokens), bitorder="little").tobytes()


def within(prints: np.ndarray, tree: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Which of the tree (columns) are within the radius of each of the queries (rows); `prints` has a row of parts for each position."""
    place: dict[int, list[int]] = {}
    for at, x in enumerate(tree.tolist()):
        place.setdefault(int.from_bytes(prints[x].tobytes(), "little"), []).append(at)
    near = np.zeros((len(queries), len(tree)), bool)
    for value, hits in BKTree(place, PARTS).within(prints[queries], RADIUS):
        near[np.ix_(hits, place[value])] = True
    return near


def prints(docs: DataFrame, shingle: int = 5, packed: bool = False) -> DataFrame:
    """(doc_id, class, size, bands, tokens) of every row; tokens are the shingle set's bytes, size is their number.

    Where `packed`, there is `words` instead of tokens, the compressed lower-cased text, of which `printed` makes the set again.
    """
    last = "words" if packed else "tokens"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):  # bounded also where texts are long
                b = whole.slice(at, 256)
                all_ = b.column(1).to_pylist()
                sets = [shingles(x, shingle) for x in all_]
                raw = [s.tobytes() for s in sets]
                classes = pa.array([xxhash.xxh3_128_digest(x) for x in raw], pa.binary())
                sizes, values = pa.array([len(s) for s in sets], pa.int64()), pa.array([bands(s) for s in sets], pa.list_(pa.int64()))
                if packed:
                    raw = [pack.compress(x.encode("utf-8", "surrogatepass").translate(LOWER)) for x in all_]
                yield pa.RecordBatch.from_arrays([b.column(0), classes, sizes, values, pa.array(raw, pa.binary())], names=["doc_id", "class", "size", "bands", last])

    source = texts(docs)
    return source.mapInArrow(work, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, class binary, size long, bands array<long>, {last} binary")


def printed(rows: DataFrame, shingle: int = 5) -> DataFrame:
    """(class, print, tokens) of rows (class, tokens) or (class, words): fingerprint and bytes of the shingle sets, made in one Python step."""
    packed = "words" in rows.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                raw = b.column(1).to_pylist()
                sets = [shingles(unpack.decompress(x).decode("utf-8", "surrogatepass"), shingle) if packed else np.frombuffer(x, np.uint64) for x in raw]
                cols = [pa.array([f(s) for s in sets], pa.binary()) for f in (fingerprint, np.ndarray.tobytes)]
                yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["class", "print", "tokens"])

    kind = rows.schema["class"].dataType.simpleString()
    return rows.select("class", "words" if packed else "tokens").mapInArrow(work, f"class {kind}, print binary, tokens binary")


def joined(sets: list[np.ndarray], prints: np.ndarray, tree: np.ndarray, queries: np.ndarray, least: float, known: np.ndarray | None = None) -> np.ndarray:
    """A label for each set: those of queries and tree that links of at least `least` connect have the same, a member's position.

    Only pairs whose `prints` the search finds are looked at. Sets with equal `known` are connected from the start.
    """
    sizes = np.array([len(s) for s in sets])
    label = np.arange(len(sets)) if known is None else np.unique(known, return_index=True)[1][np.unique(known, return_inverse=True)[1]]
    if not len(tree):
        return label
    flat, owner = np.concatenate([sets[i] for i in tree]), np.repeat(np.arange(len(tree)), sizes[tree])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]

    def merge(a: int, b: int) -> None:
        low, high = sorted((label[a], label[b]))
        label[label == high] = low

    last = 0
    for q, near in zip(queries, within(prints, tree, queries), strict=True):
        mine, root = sets[q], tree[last]
        if near[last] and label[root] != label[q] and min(sizes[root], sizes[q]) >= least * max(sizes[root], sizes[q]):  # most of a large group are near any of its members
            both = len(np.intersect1d(mine, sets[root], assume_unique=True))
            if both / (sizes[root] + sizes[q] - both) >= least:
                merge(root, q)
        if not (label[tree[near]] != label[q]).any():
            continue
        start = np.searchsorted(flat, mine)
        count = np.searchsorted(flat, mine, "right") - start
        at = np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())
        both = np.bincount(owner[at], minlength=len(tree))
        for at in np.flatnonzero(near & (both / (sizes[tree] + sizes[q] - both) >= least)).tolist():
            if label[tree[at]] != label[q]:
                merge(tree[at], q)
                last = at
    return label


def similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of classes with fingerprints within the radius and a similarity of at least `least`. `sets`: (class, print, tokens)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                good = []
                for p, q, x, y in zip(*(part.column(c).to_pylist() for c in ("p", "q", "x", "y")), strict=True):
                    if (int.from_bytes(p, "little") ^ int.from_bytes(q, "little")).bit_count() > RADIUS:
                        good.append(False)
                        continue
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    both = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= least * max(len(x), len(y)) else 0
                    good.append(both > 0 and both / (len(x) + len(y) - both) >= least)
                yield part.select(["a", "b"]).filter(pa.array(good))

    x = sets.select(F.col("class").alias("a"), F.col("print").alias("p"), F.col("tokens").alias("x"))
    y = sets.select(F.col("class").alias("b"), F.col("print").alias("q"), F.col("tokens").alias("y"))
    kind = sets.schema["class"].dataType.simpleString()
    return pairs.join(x, "a").join(y, "b").select("a", "b", "p", "q", "x", "y").mapInArrow(work, f"a {kind}, b {kind}")


def links(
    classes: DataFrame, sets: DataFrame, least: float = 0.8, block: int = 512, most: int = 1 << 18, shingle: int = 5,
) -> DataFrame:
    """Edges (a, b) of classes with a similarity of at least `least`, reduced inside each unit to one edge a member.

    `classes`: (class, size, bands); `sets`: (class, tokens) or (class, words), equal rows of a class as often as may be. A block has about `block` classes and `most` shingles.
    """
    bucket = ["band", "value"]
    placed = classes.select("class", "size", F.posexplode("bands").alias("band", "value"))
    ends = placed.groupBy(*bucket).agg(F.min("class").alias("first"), F.max("class").alias("last")).where("first < last").select(*bucket, "first")
    shared = stored(placed.join(ends, bucket), "resemblance-buckets")
    payload = next(c for c in sets.columns if c != "class")
    sets = sets.join(shared.select("class").distinct(), "class", "left_semi").groupBy("class").agg(F.first(payload).alias(payload))
    sets = stored(printed(sets, shingle), "resemblance-sets")  # of classes with a candidate only
    near = stored(similar(shared.where("class <> first").select(F.col("class").alias("a"), F.col("first").alias("b")).distinct(), sets, least), "resemblance-first")
    found = components(near)
    placed = shared.join(found, F.col("class") == F.col("node"), "left").select(*bucket, "class", "size", F.coalesce("component", "class").alias("c"))
    left = placed.groupBy(*bucket).agg(F.min("c").alias("low"), F.max("c").alias("high"), F.sum(F.xxhash64("class").cast("decimal(38,0)")).alias("sum"), F.count(F.lit(1)).alias("n"))
    left = left.where("low < high").groupBy("sum", "n").agg(F.min(F.struct(*bucket)).alias("b")).select("b.*")  # of buckets with the same classes one
    placed = stored(placed.join(left, bucket), "resemblance-open")
    # components over a block have blocks of their own, which are not compared with each other; the others share blocks by hash
    parts = placed.groupBy(*bucket, "c").agg(F.ceil(F.greatest(F.count("*") / block, F.sum("size") / most)).cast("int").alias("parts"), F.count("*").alias("rows"), F.sum("size").alias("whole"))
    small = parts.where("parts = 1").groupBy(*bucket).agg(F.ceil(F.greatest(F.sum("rows") / block, F.sum("whole") / most)).cast("int").alias("small"))
    large = parts.where("parts > 1").select(*bucket, "c", "parts", (F.sum("parts").over(Window.partitionBy(*bucket).orderBy("c")) - F.col("parts")).cast("int").alias("from"))
    every = large.groupBy(*bucket).agg(F.sum("parts").cast("int").alias("large"))
    sized = placed.join(small, bucket, "left").join(every, bucket, "left").join(large, [*bucket, "c"], "left").fillna(0, ["small", "large", "from", "parts"])
    hashed = F.pmod(F.xxhash64("class"), F.greatest("parts", F.lit(1))).cast("int")
    own = F.when(F.col("parts") > 0, F.col("small") + F.col("from") + hashed).otherwise(F.pmod(F.xxhash64("c"), F.greatest("small", F.lit(1))).cast("int"))
    cut = sized.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("small") + F.col("large") - 1)))
    cut = cut.where((F.col("parts") == 0) | (F.col("other") < F.col("small") + F.col("from")) | (F.col("other") >= F.col("small") + F.col("from") + F.col("parts")))
    cut = cut.select(*bucket, F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") - F.col("other")).alias("side"), "class", "c")
    unit = [*bucket, "low", "high"]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in runs(batches, unit):
            tree, queries = np.flatnonzero(g["side"] <= 0), np.flatnonzero(g["side"] >= 0)
            if len(tree) and len(queries) and (g["c"] != g["c"][0]).any():
                known = np.unique(g["c"], return_inverse=True)[1]
                prints = np.frombuffer(b"".join(g["print"]), "<u8").reshape(-1, PARTS)
                start = joined([np.zeros(0, np.uint64)] * len(known), prints, tree[:0], queries[:0], least, known)
                label = joined([np.frombuffer(x, np.uint64) for x in g["tokens"]], prints, tree, queries, least, known)
                if (own := label != start).any():
                    yield pd.DataFrame({"a": g["class"][own], "b": g["class"][label[own]]})

    kind = sets.schema["class"].dataType.simpleString()
    more = cut.join(sets, "class").select(*unit, "side", "class", "c", "print", "tokens").repartition(*unit).sortWithinPartitions(*unit).mapInPandas(work, f"a {kind}, b {kind}")
    return near.union(more)


def near_copies(docs: DataFrame, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """(doc_id, component_id) of every row: the smallest doc_id that links of at least `least` similar shingle sets reach.

    Null and empty texts are one class. Repeated rows give repeated results. A row with a null doc_id gets the component of its
    class, null if nothing with an id is in it. An empty table gives an empty result.
    """
    rows = stored(prints(docs, shingle, packed=True), "resemblance")
    classes = stored(rows.groupBy("class").agg(F.min("doc_id").alias("root"), F.first("size").alias("size"), F.first("bands").alias("bands")), "resemblance-classes")
    edges = stored(links(classes, rows.select("class", "words"), least, shingle=shingle), "resemblance-links")
    found = components(edges)
    grouped = classes.join(found, F.col("class") == F.col("node"), "left").select("class", "root", F.coalesce("component", "class").alias("c"))
    smallest = grouped.groupBy("c").agg(F.min("root").alias("component_id"))
    ids = grouped.join(smallest, "c").select("class", "component_id")
    return rows.select("doc_id", "class").join(ids, "class").select("doc_id", "component_id")


def keep_one(docs: DataFrame, **how: float) -> DataFrame:
    """The documents without those that a document of a smaller doc_id stands for; rows with a null doc_id stay.

    Repeated rows of a kept document stay as they are.
    """
    gone = near_copies(docs, **how).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs.doc_id == gone._gone, "left_anti")
