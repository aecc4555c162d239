"""Byte-level BPE by a local rank file: whole texts to ids and ids back to raw bytes, exactly as the library gives them for the whole text.

A long text is cut where no match of the pattern can reach across and none looks across: before white space that follows other
characters, before the last character of a run of white space, and between ASCII letters, digits and signs (an apostrophe before a
letter may be a contraction, so not there). Each part is then encoded on its own. A run without such a place stays whole.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from tapeloom.llm.common import slices, texts
from tapeloom.llm.tokens import SPACE

#: Characters of a part, and ids decoded at once.
PART, IDS = 1 << 16, 1 << 18
RUN, ONLY = regex.compile(SPACE + "{1000,}+"), regex.compile(SPACE + "{999,}+")
SAFE = regex.compile("|".join((
    rf"(?<!{SPACE})(?={SPACE})", rf"(?<={SPACE})(?={SPACE}(?!{SPACE})[\S\s])", r"(?<=[A-Za-z])(?=[0-9])", r"(?<=[0-9])(?=[A-Za-z])",
    r"(?<=[A-Za-z0-9])(?=[!-/:-@\[-`{-~])", r"(?<=[!-&(-/:-@\[-`{-~])(?=[A-Za-z0-9])", r"(?<=[。、])(?=[一-龥])", r"(?<=[一-龥])(?=[。、])",
)))


def parts(text: str, size: int = PART, safe: regex.Pattern = SAFE) -> Iterator[str]:
    """The text in order, cut at the first safe place `size` characters after the last cut."""
    at = 0
    while len(text) - at > size and (m := safe.search(text, at + size)) and m.start() < len(text):
        yield text[at: m.start()]
        at = m.start()
    yield text[at:]


def load(path: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file: a line has a token's bytes in base 64 and its rank, which is its id."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> tiktoken.Encoding:
    """One encoding a worker process and file."""
    return load(path, pattern)


@lru_cache(maxsize=1)
def single(enc: tiktoken.Encoding) -> tiktoken.Encoding:
    """The same ranks for texts that are one match."""
    return tiktoken.Encoding("run", pat_str=r"[\s\S]++", mergeable_ranks=enc._mergeable_ranks, special_tokens={})


def part_ids(enc: tiktoken.Encoding, part: str) -> np.ndarray:
    """Ids of a part. A run of white space too long for the engine's backtracking is, but for its last character before other text, one match."""
    try:
        return enc.encode_to_numpy(part, disallowed_special=())
    except ValueError:
        cuts = sorted({0, len(part), *(x for m in RUN.finditer(part) for x in (m.start(), m.end() - (m.end() < len(part))))})
        pieces = [part[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        return np.concatenate([(single(enc) if ONLY.fullmatch(x) else enc).encode_to_numpy(x, disallowed_special=()) for x in pieces])


def ids(enc: tiktoken.Encoding, text: str, size: int = PART) -> np.ndarray:
    """Unsigned 32-bit ids; strings of special tokens are ordinary text."""
    if len(text) <= size:
        return part_ids(enc, text)
    return np.concatenate([part_ids(enc, x) for x in parts(text, size)])


def raw(enc: tiktoken.Encoding, tokens: np.ndarray) -> bytes:
    """The bytes of the ids, which need not be whole characters."""
    return b"".join(enc.decode_bytes(tokens[at: at + IDS].tolist()) for at in range(0, len(tokens), IDS))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) of every row; `ids` holds little-endian unsigned 32-bit integers.

    Null and empty texts have no ids (empty, not null). Repeated rows give repeated results, null doc_ids stay, an empty table gives
    an empty result, further columns are not looked at.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for b in slices(batches, "text"):
            found = [ids(enc, x).astype("<u4", copy=False).tobytes() for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.binary())], names=["doc_id", "ids"])

    source = texts(docs)
    return source.mapInArrow(work, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, ids binary")


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded) of every row of (doc_id, ids): the raw bytes of the ids. Null ids give null; an id that the file lacks fails."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for b in slices(batches, "ids"):
            found = [None if x is None else raw(enc, np.frombuffer(x, "<u4")) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("ids"), pa.array(found, pa.binary())], names=["doc_id", "ids", "decoded"])

    return tokens.select("doc_id", "ids").mapInArrow(work, f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}, ids binary, decoded binary")
