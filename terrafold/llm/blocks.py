"""Blocks of documents, and the shuffle of their distinct tokens.

A block is a run of documents of one task. Its tokens become codes in the block; its distinct tokens travel
to buckets by their hash, once a block however often they occur, so a frequent token is no hot key. What a
bucket finds out about its tokens travels back to the blocks, where tokens are put in place by position.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, partitions

#: Text bytes of a block, about. One document is never cut.
BLOCK_BYTES = 6 << 20
ROW = "kind int, key long, block string, bucket int, payload binary"
NAMES = ["kind", "key", "block", "bucket", "payload"]
SEQUENCE, WORDS, STATS = 0, 1, 2


def compress(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays and byte strings as one compressed byte string."""
    parts = [a if isinstance(a, bytes) else a.dtype.str.encode().ljust(4) + np.ascontiguousarray(a).tobytes() for a in arrays]
    kinds = bytes(isinstance(a, bytes) for a in arrays)
    head = np.asarray([len(arrays), *map(len, parts)], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + kinds + b"".join(parts))


def expand(data: bytes) -> list:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    sizes = np.frombuffer(raw, "<i8", n, 8)
    kinds, at, out = raw[8 + 8 * n : 8 + 9 * n], 8 + 9 * n, []
    for size, is_bytes in zip(sizes.tolist(), kinds, strict=True):
        part = raw[at : at + size]
        out.append(part if is_bytes else np.frombuffer(part[4:], part[:4].decode().strip()))
        at += size
    return out


def narrow(a: np.ndarray) -> np.ndarray:
    """The same numbers, in as few bytes as the largest needs."""
    top = int(a.max(initial=0))
    return a.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8")


def record_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    kinds = (pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], NAMES)


def coded(texts: list[str], tokens: Callable[[str], list[bytes]]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(number of tokens of each text, codes of all, distinct tokens in the order of their first places)."""
    first: dict[bytes, int] = {}
    lens, parts = [], []
    for text in texts:
        found = tokens(text)
        for w in found:
            if w not in first:
                first[w] = len(first)
        parts.append(np.fromiter(map(first.__getitem__, found), "<i4", len(found)))
        lens.append(len(found))
    return np.asarray(lens, "i8"), np.concatenate(parts), list(first)


def encoded(lengths: np.ndarray, data: bytes | np.ndarray) -> pa.DictionaryArray:
    """Byte strings that follow one another in data, numbered in the order of their first places."""
    ends = np.concatenate([[0], np.cumsum(lengths, dtype="i8")])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode()


#: Whether a byte is white space.
WHITE = np.isin(np.arange(256), list(b" \t\n\r\x0b\f"))


def coded_words(texts: list[bytes], end: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """coded() of the words between white space and one end, which has white space, after each text; no token is an object."""
    raw = np.frombuffer(b"\n".join([*texts, b""]), "u1")
    white = WHITE[raw]
    edges = np.flatnonzero(np.diff(white, prepend=True))  # a word's start and what follows it, in turn
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    stops = np.cumsum([len(t) + 1 for t in texts])
    n = np.diff(np.searchsorted(starts, stops), prepend=0)
    lengths = np.zeros(len(starts) + len(texts), "i8")  # an end has no bytes here, as no word has none
    lengths[np.arange(len(starts)) + np.repeat(np.arange(len(texts)), n)] = sizes
    found = encoded(lengths, raw[~white])
    codes, words = found.indices.to_numpy(), found.dictionary.to_pylist()
    words[codes[n[0]]] = end
    return n + 1, codes.astype("<i4", copy=False), words


def cut_blocks(
    docs: DataFrame,
    tokens: Callable[[str], list[bytes]] | None,
    flag=None,
    buckets: int | None = None,
    kinds: tuple[int, ...] = (SEQUENCE, WORDS),
    code: Callable[[list[str]], tuple[np.ndarray, np.ndarray, list[bytes]]] | None = None,
) -> DataFrame:
    """Rows of ROW from docs (doc_id, text and a flag): a SEQUENCE row a block, and a WORDS row a block and bucket.

    Codes of a block are dealt by bucket, so a bucket's words are consecutive codes. A WORDS payload holds
    the words' lengths, their counts in documents with the flag, and their bytes. A null text is empty.
    Without tokens, code gives what coded() does for the texts of a block.
    Only rows of the given kinds are made. A block's name ends in a digest of its rows, so rows of two calls
    only meet if both read the same documents in the same order.
    """
    n_buckets = buckets or 2 * partitions(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq, held, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            ids, flags, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            for doc, on, text in zip(ids, flags, texts, strict=True):
                text = text.as_py() or ""
                held.append((doc, on, text))
                size += len(text) + 64
                if size >= BLOCK_BYTES:
                    yield from block(f"{task}-{seq}", held)
                    seq, held, size = seq + 1, [], 0
        if held:
            yield from block(f"{task}-{seq}", held)

    def block(place: str, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128()
        for doc, _, text in held:
            digest.update(f"{doc} {len(text)} {text}".encode())
        name = f"{place}-{digest.hexdigest()}"
        texts = [text for _, _, text in held]
        lens, codes, words = code(texts) if code else coded(texts, tokens)
        home = (np.fromiter(map(xxhash.xxh3_64_intdigest, words), "u8", len(words)) % np.uint64(n_buckets)).astype("<i4")
        order = np.argsort(home, kind="stable")
        rank = np.empty(len(words), "<i4")
        rank[order] = np.arange(len(words), dtype="<i4")
        codes = rank[codes] if len(words) else codes
        on = np.asarray([bool(f) for _, f, _ in held])
        counts = np.bincount(codes[np.repeat(on, lens)], minlength=len(words)) if len(codes) else np.zeros(len(words), "i8")
        ids = [d for d, _, _ in held]
        null = np.asarray([d is None for d in ids])
        number = np.asarray([0 if d is None else d for d in ids], "<i8")
        rows, at = [], 0
        if SEQUENCE in kinds:
            payload = compress(number, null, on, narrow(lens), codes.astype("<u2") if len(words) < 1 << 16 else codes)
            rows.append((SEQUENCE, xxhash.xxh3_64_intdigest(name.encode()) >> 1, name, -1, payload))
        for b, n in zip(*np.unique(home, return_counts=True), strict=True) if WORDS in kinds else ():
            mine = [words[k] for k in order[at : at + n]]
            rows.append((WORDS, int(b), name, int(b), compress(narrow(np.asarray([len(w) for w in mine], "i8")), narrow(counts[at : at + n]), b"".join(mine))))
            at += int(n)
        if rows:
            yield record_batch(rows)

    flagged = F.lit(True) if flag is None else flag
    return docs.select(F.col("doc_id").cast("long"), flagged, "text").mapInArrow(lean(cut), ROW)


def split_words(lengths: np.ndarray, data: bytes) -> list[bytes]:
    ends = np.cumsum(lengths.astype("i8")).tolist()
    return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def sequence(payload: bytes) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, flags, tokens of each document, codes) of a SEQUENCE row."""
    number, null, on, lens, codes = expand(payload)
    ids = [None if gone else d for d, gone in zip(number.tolist(), null.tolist(), strict=True)]
    return ids, on, lens.astype("i8"), codes
