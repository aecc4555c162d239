"""Document quality from random-indexing word vectors and a small two-layer network with calibrated probabilities.

Words fall into BUCKETS by hash. Each bucket has a sparse random index vector of +1 and -1; the vector of a bucket is the sum of
the index vectors of the neighbours of its words over all documents. These sums are whole numbers, so they are the same in any
order, and the table has a fixed size at any number of documents. A document is the mean of its words' vectors. The network is
trained on a bounded sample of labelled documents; a temperature found on the part of them it was not trained on turns its
outputs into probabilities.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import texts

WORD = re.compile(r"[^\W_]+|[^\w\s]+|_+")
BUCKETS, DIM, ONES, REACH = 1 << 14, 64, 4, 2
#: Entries of a pooled document.
LAGS = 4
WIDTH = 2 * DIM + 1 + LAGS
#: Words handled at once, and words remembered by a worker.
PART, KNOWN = 1 << 18, 1 << 16
#: Rows of the table in one row of the shuffle.
SLAB = 512
SEED = 20


class Buckets(dict):
    """word -> bucket, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KNOWN:
            self.clear()
        self[word] = b = xxhash.xxh32_intdigest(word.encode("utf-8", "surrogatepass")) % BUCKETS
        return b


KNOWN_WORDS = Buckets()


def words(text: str) -> np.ndarray:
    """Buckets of the text's words and runs of signs; words all in capitals are words of their own."""
    return np.fromiter(map(KNOWN_WORDS.__getitem__, WORD.findall(text)), np.int32)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero entries of each bucket's index vector."""
    rng = np.random.default_rng(SEED)
    return rng.integers(0, DIM, (BUCKETS, ONES), np.int64), rng.choice(np.array([-1.0, 1.0]), (BUCKETS, ONES))


def contexts(docs: DataFrame) -> np.ndarray:
    """The table of summed neighbours over all documents, as unit vectors; `docs` has a text column without nulls."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sign = index_vectors()
        table = np.zeros(BUCKETS * DIM)
        for b in batches:
            gap, held, size = np.full(REACH, -1, np.int32), [], 0
            for w in [*(words(t) for t in b.column(0).to_pylist()), None]:
                if w is not None and len(w):
                    held += [w, gap]
                    size += len(w)
                if held and (w is None or size >= PART):
                    flow, held, size = np.concatenate(held), [], 0
                    for d in range(1, REACH + 1):
                        left, right = flow[:-d], flow[d:]
                        fit = (left >= 0) & (right >= 0)
                        left, right = left[fit].astype(np.int64), right[fit].astype(np.int64)
                        for k in range(ONES):
                            for me, other in ((left, right), (right, left)):
                                table += np.bincount(me * DIM + place[other, k], sign[other, k], BUCKETS * DIM)
        whole = table.astype("<i8").reshape(-1, SLAB * DIM)
        slabs = [i for i in range(len(whole)) if whole[i].any()]
        yield pa.RecordBatch.from_arrays([pa.array(slabs, pa.int32()), pa.array([whole[i].tobytes() for i in slabs], pa.binary())], names=["slab", "sums"])

    def add(key: tuple, rows: Iterator[pd.DataFrame] | pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(SLAB * DIM, "<i8")
        for x in rows["sums"]:
            total += np.frombuffer(x, "<i8")
        return pd.DataFrame({"slab": [key[0]], "sums": [total.tobytes()]})

    slabs = docs.select("text").mapInArrow(work, "slab int, sums binary")
    # two steps, so that no task adds more than a share of the partial tables
    slabs = slabs.withColumn("share", F.pmod(F.spark_partition_id(), F.lit(16)))
    first = slabs.groupBy("slab", "share").applyInPandas(lambda key, rows: add(key, rows), "slab int, sums binary")
    table = np.zeros((BUCKETS // SLAB, SLAB * DIM))
    for slab, sums in first.groupBy("slab").applyInPandas(add, "slab int, sums binary").collect():  # the table has a fixed size
        table[slab] = np.frombuffer(sums, "<i8")
    table = table.reshape(BUCKETS, DIM)
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1.0)).astype(np.float32)


def pooled(table: np.ndarray, text: str) -> np.ndarray:
    """Mean word vector, the mean of the later half's (junk may follow a clean start), and how alike neighbouring words are.

    The last entries are the mean product of each word's vector with the next one's and the shares of words equal to the one
    one to LAGS places before, which tell text from words said over and over.
    """
    w = words(text)
    if not len(w):
        return np.zeros(WIDTH, np.float32)
    half, sums, like = len(w) // 2, [np.zeros(DIM), np.zeros(DIM)], 0.0
    for k, (start, end) in enumerate(((0, half), (half, len(w)))):
        for at in range(start, end, PART):
            v = table[w[at: min(at + PART, end) + 1]]
            sums[k] += v[: min(PART, end - at)].sum(axis=0, dtype=float)
            like += float(np.einsum("ij,ij->", v[1:], v[:-1]))
    same = [float((w[d:] == w[:-d]).mean()) if len(w) > d else 0.0 for d in range(1, LAGS + 1)]
    return np.concatenate([(sums[0] + sums[1]) / len(w), sums[1] / (len(w) - half), [like / len(w), *same]]).astype(np.float32)


@dataclass
class Model:
    """Scores of pooled vectors: standardised, two layers, divided by the temperature, squashed."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 40, batch: int = 64, rate: float = 3e-3, decay: float = 1e-4) -> Model:
    """The network by Adam on logistic loss over four fifths of the rows; the temperature by the loss on the rest."""
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(x))
    held, used = order[: len(x) // 5], order[len(x) // 5:]
    mean, scale = (x[used].mean(axis=0), x[used].std(axis=0) + 1e-3) if len(used) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    p = [rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    z = (x - mean) / scale
    for _ in range(epochs if len(used) else 0):
        mixed = rng.permutation(used)
        for at in range(0, len(mixed), batch):
            i = mixed[at: at + batch]
            a = np.maximum(z[i] @ p[0] + p[1], 0)
            g = (1 / (1 + np.exp(-np.clip(a @ p[2] + p[3][0], -30, 30))) - y[i]) / len(i)
            back = np.outer(g, p[2]) * (a > 0)
            grads, t = [z[i].T @ back + decay * p[0], back.sum(axis=0), a.T @ g + decay * p[2], np.array([g.sum()])], t + 1
            for k, d in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.999 * v[k] + 0.001 * d * d
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    model = Model(mean, scale, p[0], p[1], p[2], float(p[3][0]))
    if len(held):
        raw, sign = model.logits(x[held]), np.where(y[held] > 0, 1.0, -1.0)
        model.temperature = float(min(np.geomspace(0.25, 16, 97), key=lambda c: np.logaddexp(0, -np.clip(sign * raw / c, -60, 60)).mean()))
    return model


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> tuple[np.ndarray, Model]:
    """Word vectors over all `docs` and the network from at most `sample` labelled rows outside the held-out fifth.

    The rows are those with the smallest hashes of doc_id, one for each. Labels that are null or contradict each other for a doc_id are not used.
    """
    source = texts(docs)
    table = contexts(source)
    # the text by which crc32 is told: the plain decimal doc_id
    usable = labels.where("doc_id is not null and quality is not null").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    usable = usable.groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("y2")).where("y = y2")
    known = source.select("doc_id").distinct().join(usable, "doc_id", "left_semi")
    chosen = usable.join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id", "y")
    send = docs.sparkSession.sparkContext.broadcast(table)  # BUCKETS x DIM floats

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["y"], "x": [pooled(send.value, t).tobytes() for t in b["text"]]})

    kind = source.schema["doc_id"].dataType.simpleString()
    # at most `sample` rows of two numbers are sent; of repeated ids one text, that of the smallest digest
    own = source.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min_by("text", F.sha2("text", 256)).alias("text"))
    rows = own.mapInPandas(work, f"doc_id {kind}, y int, x binary").toPandas()  # at most `sample` small rows
    rows = rows.sort_values(["doc_id", "x"])
    x = np.stack([np.frombuffer(v, np.float32) for v in rows["x"]]).astype(float) if len(rows) else np.zeros((0, WIDTH))
    return table, train(x, rows["y"].to_numpy(float))


def score(docs: DataFrame, labels: DataFrame, sample: int = 20_000, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of `docs`; only texts are looked at.

    Null and empty texts get the score of an empty document. Without usable labels scores are those of an untrained network.
    Repeated rows give repeated results, null doc_ids stay (not held out), an empty table gives an empty result.
    """
    table, model = fit(docs, labels, sample)
    send = docs.sparkSession.sparkContext.broadcast((table, model))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors, net = send.value
            x = np.array([pooled(vectors, t) for t in b.column(1).to_pylist()], float).reshape(-1, WIDTH)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(net.scores(x))], names=["doc_id", "score"])

    source = texts(docs)
    scored = source.mapInArrow(work, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, **how: float) -> DataFrame:
    """The rows of `docs` that are not rejected, each by its own text; all columns stay as they are."""
    table, model = fit(docs, labels, how.get("sample", 20_000))
    send = docs.sparkSession.sparkContext.broadcast((table, model))

    @F.pandas_udf("double")
    def rate(s: pd.Series) -> pd.Series:
        vectors, net = send.value
        return pd.Series(net.scores(np.array([pooled(vectors, t or "") for t in s], float).reshape(-1, WIDTH)))

    return docs.where(rate("text") >= how.get("threshold", 0.3))
