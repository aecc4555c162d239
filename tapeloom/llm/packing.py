"""Packing token runs into sequences by patterns of few documents, fitted to the length histogram by non-negative least squares.

Only the histogram (at most `size` rows) comes to the driver. Patterns of one to three lengths that fill a sequence exactly are
fitted to it: the pattern that the residual wants most joins the active set, and the active set is solved again. The repeat
counts are rounded down to what the histogram holds; the rest of the histogram is packed best-fit, longest first, in whole counts.
The plan's size depends on `size` alone. Spark numbers the pieces of each length and looks their places up in the plan.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import stored, texts
from tapeloom.llm.tokens import ids

#: Pieces of one salt of one length, about; numbering sorts no more than that in one task.
SALT_ROWS = 20_000


def wanted(residual: np.ndarray, size: int, most: int) -> list[tuple[int, ...]]:
    """Up to `most` exact patterns of two or three lengths by the residual's gradient, each length in one pattern at most."""
    r = residual.copy()
    r[0] = 0
    sums = np.add.outer(np.arange(size + 1), np.arange(size + 1))
    rest = size - sums
    gain = np.where(rest >= 0, r[:, None] + r[None, :] + np.where(rest >= 0, r[np.maximum(rest, 0)], 0), -np.inf)
    gain[0, :] = -np.inf
    gain[np.tril_indices(size + 1, -1)] = -np.inf  # a <= b
    gain[(rest < np.arange(size + 1)[None, :]) & (rest != 0)] = -np.inf  # b <= the third, if there is one
    flat = np.argpartition(gain.ravel(), -8 * most)[-8 * most:]
    out, used = [], set()
    for i in flat[np.argsort(-gain.ravel()[flat], kind="stable")]:
        a, b = divmod(int(i), size + 1)
        p = tuple(x for x in (a, b, size - a - b) if x)
        if gain[a, b] > 1e-9 and not used & set(p):
            out.append(p)
            used |= set(p)
    return out[:most]


def fit(counts: np.ndarray, size: int, rounds: int = 24, step: int = 32) -> dict[tuple[int, ...], float]:
    """Non-negative repeat counts of patterns by least squares on the histogram: active sets, as Lawson and Hanson do, by blocks.

    A length weighs as it is long: what is left over should be short, for short pieces still fit into gaps.
    """
    weight = np.arange(size + 1) / size
    b = counts * weight
    active: list[tuple[int, ...]] = []
    x, columns = np.zeros(0), np.zeros((size + 1, 0))
    for _ in range(rounds):
        new = [p for p in wanted((b - columns @ x) * weight, size, step) if p not in set(active)]
        if not new or len(active) + len(new) > size:
            break
        more = np.zeros((size + 1, len(new)))
        for j, p in enumerate(new):
            np.add.at(more[:, j], list(p), weight[list(p)])
        active, columns, x = active + new, np.hstack([columns, more]), np.append(x, np.zeros(len(new)))
        for _ in range(len(active)):
            z = np.linalg.solve(columns.T @ columns + 1e-9 * np.eye(len(active)), columns.T @ b)
            if z.min() > 0:
                x = z
                break
            bad = z <= 0
            alpha = np.min(x[bad] / np.maximum(x[bad] - z[bad], 1e-300))
            x = x + alpha * (z - x)
            keep = ~(bad & (x <= 1e-9))
            active, columns, x = [p for p, k in zip(active, keep, strict=True) if k], columns[:, keep], x[keep]
    return dict(zip(active, x.tolist(), strict=True))


def plan(counts: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences) for a histogram `counts[length]`; every piece is in exactly one.

    Of the fitted repeat counts that share is laid down, from half to all, that needs the fewest sequences with the rest.
    """
    fitted = sorted(fit(np.where(np.arange(size + 1) < size, counts, 0), size).items(), key=lambda t: (-t[1], t[0]))
    plans = [laid(counts, size, [(p, x * share) for p, x in fitted]) for share in (1.0, 0.95, 0.9, 0.8, 0.7, 0.6, 0.5)]
    return min(plans, key=lambda way: sum(n for _, n in way))


def laid(counts: np.ndarray, size: int, patterns: list[tuple[tuple[int, ...], float]]) -> list[tuple[tuple[int, ...], int]]:
    """The patterns, rounded down to what is there, and the rest best-fit, longest first."""
    left = counts.copy()
    out: list[tuple[tuple[int, ...], int]] = [((size,), int(left[size]))] if left[size] else []
    left[size] = 0
    for p, x in patterns:
        need = np.bincount(p, minlength=size + 1)
        n = min(int(x), *(int(left[k] // need[k]) for k in p))
        if n > 0:
            out.append((p, n))
            left -= need * n
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)  # room -> (lengths, how many)
    for k in range(size - 1, 0, -1):
        n = int(left[k])
        while n:
            room = min((r for r in bins if r >= k), default=None)
            held, many = bins[room].pop() if room is not None else ((), n if size < 2 * k else -(-n // (size // k)))
            if room is None:
                room = size
            elif not bins[room]:
                del bins[room]
            now = min(n, many)
            if many > now:
                bins[room].append((held, many - now))
            bins[room - k].append(((*held, k), now))
            n -= now
    return out + [x for way in bins.values() for x in way]


def pieces(docs: DataFrame, path: str, size: int = 1024, end: int = 2) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): a document is its ids, then `end`; longer ones are cut, the first piece short."""
    source = texts(docs)
    kind = source.schema["doc_id"].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = np.append(ids(path, text), [end]).astype("<u4")
                first = len(own) % size or size
                cuts = [0, *range(first, len(own) + 1, size)]
                for k, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    for col, v in zip(rows, (doc, k, s, e - s, zlib.crc32(own[s:e].tobytes())), strict=True):
                        col.append(v)
            types = [b.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return source.mapInArrow(work, f"doc_id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long")


def numbered(rows: DataFrame) -> DataFrame:
    """`rows` with `rank`, from 0 within each length. A frequent length is dealt out over salts, whose counts give the offsets."""
    salts = F.greatest(F.lit(1), F.ceil(F.col("n") / SALT_ROWS))
    sizes = rows.groupBy("length").agg(F.count("*").alias("n")).select(F.col("length").alias("_l"), salts.alias("salts"))
    salted = rows.join(sizes, F.col("length") == F.col("_l")).drop("_l").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.col("salts")))
    per = salted.groupBy(F.col("length").alias("_l"), F.col("salt").alias("_s")).agg(F.count("*").alias("n"))
    per = per.withColumn("before", F.sum("n").over(Window.partitionBy("_l").orderBy("_s")) - F.col("n")).drop("n")
    local = salted.withColumn("k", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    return local.join(per, (F.col("length") == F.col("_l")) & (F.col("salt") == F.col("_s"))).withColumn("rank", F.col("before") + F.col("k")).drop("_l", "_s", "salt", "salts", "before", "k")


def pack(docs: DataFrame, path: str, size: int = 1024, end: int = 2) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every row, gapless in each sequence.

    A null or empty text is the end token alone. Repeated rows are packed each, null doc_ids too; ties between pieces of one length
    are broken by doc_id, piece and checksum, and what ties further is the same piece. An empty table gives an empty result.
    """
    rows = stored(pieces(docs, path, size, end), "pieces")
    counts = np.zeros(size + 1, np.int64)
    for length, n in rows.groupBy("length").count().collect():  # at most `size` rows
        counts[length] = n
    slots, base = [], 0  # per length: from which rank on, the sequence of that rank, the offset in it
    taken = np.zeros(size + 1, np.int64)
    for lengths, many in plan(counts, size):
        at = 0
        for k in lengths:
            slots.append((k, int(taken[k]), base, at))
            taken[k] += many
            at += k
        base += many
    table = np.array(sorted(slots), np.int64).reshape(-1, 4)
    place = (table[:, 0] << 48) + table[:, 1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rank = b.column("rank").to_numpy()
            i = np.searchsorted(place, (b.column("length").to_numpy() << 48) + rank, "right") - 1
            cols = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            cols += [pa.array(table[i, 2] + rank - table[i, 1]), pa.array(table[i, 3])]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return numbered(rows).mapInArrow(work, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
