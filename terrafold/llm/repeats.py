"""Removal of repeated substrings over a compacted De Bruijn graph of token k-mers.

An edge is a window of k consecutive words; it leads from its first k-1 words to its last k-1. Only edges
that also start in a smaller document matter; each gets the coordinates (document, position) of its first
source. Where the next edge's source follows in step the path doesn't branch, and such edges compact into
one span. A span is joined with its source document, whose digest of the same words must be equal in the
document the span is cut from: hashes only propose, source coordinates verify.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import compress, expand, narrow
from .common import lean, materialize, partitions, table
from .jaccard import mix, word_hashes

K = 13
#: Text bytes of a block, about.
BLOCK_BYTES = 8 << 20
ROW = "bucket int, block string, payload binary"
SPAN = "doc_id long, start int, n int, source_id long, source_start int"


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    n = len(hashes) - k + 1
    if n < 1:
        return np.empty(0, "u8")
    out = np.full(n, np.uint64(k))
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n]
    return mix(out)


def planes(a: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as differences, byte by byte: high bytes are mostly zero."""
    d = np.diff(a, prepend=np.zeros(1, "u8")) if len(a) else a
    return np.ascontiguousarray(d.astype("<u8").view("u1").reshape(-1, 8).T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    d = np.ascontiguousarray(np.frombuffer(data, "u1").reshape(8, -1).T).view("<u8").ravel()
    return np.cumsum(d, dtype="u8")


def offset(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = a.min(initial=np.iinfo("i8").max) if len(a) else 0
    return np.asarray([low], "<i8"), narrow((a - low).astype("u8"))


def runs(doc: np.ndarray, pos: np.ndarray, source: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Edges compacted to spans, rows (doc, start, n, source, source_start): runs in step with their sources."""
    if not len(doc):
        return np.empty((0, 5), "i8")
    order = np.lexsort((pos, doc))
    doc, pos, source, at = doc[order], pos[order], source[order], at[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1) | (source[1:] != source[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    return np.stack([doc[first], pos[first], np.diff(np.append(first, len(doc))), source[first], at[first]], axis=1).astype("i8")


def sourced(h: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For edges sorted by (hash, doc, pos): positions of the first edge of each hash, and of it for every edge."""
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    first = np.flatnonzero(new)
    return first, np.repeat(first, np.diff(np.append(first, len(h))))


def block(name: str, held: list[tuple[int, np.ndarray]], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of ROW of the documents held, with their windows; held is empty afterwards."""
    if not held:
        return
    held.sort(key=lambda x: x[0])
    ids, lens = np.asarray([d for d, _ in held], "i8"), [len(w) for _, w in held]
    h = np.concatenate([w for _, w in held])
    held.clear()  # here and below, arrays go as soon as they are used: each is as long as the block
    # documents by their place among ids, in four bytes like positions
    doc = np.repeat(np.arange(len(ids), dtype="i4"), lens)
    pos = np.arange(len(h), dtype="i4") - np.repeat((np.cumsum(lens) - lens).astype("i4"), lens)
    order = np.argsort(h, kind="stable")
    h = h[order]
    doc = doc[order]
    pos = pos[order]
    del order
    source = np.arange(len(h), dtype="i4")  # of each edge, the first of its hash
    source[1:][h[1:] == h[:-1]] = 0
    np.maximum.accumulate(source, out=source)
    own = doc == doc[source]
    at = source[~own]
    del source
    local = runs(ids[doc[~own]], pos[~own], ids[doc[at]], pos[at])
    rows = []
    if len(local):
        rows.append((-1 - xxhash.xxh3_64_intdigest(name.encode()) % buckets, name, compress(*local.T)))
    del at, local
    home = (h % np.uint64(buckets)).astype("i4")
    home[~own] = buckets  # the last: not sent
    order = np.argsort(home, kind="stable").astype("i4")[: own.sum()]
    home = home[order]
    del own
    for b, part in zip(*cuts(home), strict=True):
        mine = order[part]
        low, near = offset(ids[doc[mine]])
        rows.append((int(b), name, compress(planes(h[mine] // np.uint64(buckets)), low, near, narrow(pos[mine]))))
    yield batch_of(rows)


def edges(docs: DataFrame, k: int, buckets: int) -> DataFrame:
    """Rows of ROW: of each block, the edges of each bucket, and the spans repeated within the block (bucket < 0).

    An edge is sent once a block, for its smallest document there; its other documents already have a source.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq, held, size = TaskContext.get().partitionId(), 0, [], 0
        known: dict[bytes, int] = {}
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                found = windows(word_hashes(text, known), k)
                size += len(text)
                if len(found):
                    held.append((doc, found))
                if size >= BLOCK_BYTES:
                    yield from block(f"{task}-{seq}", held, buckets)
                    seq, held, size = seq + 1, [], 0
        yield from block(f"{task}-{seq}", held, buckets)

    return docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(cut), ROW)


def cuts(sorted_keys: np.ndarray) -> tuple[np.ndarray, list[slice]]:
    if not len(sorted_keys):
        return sorted_keys, []
    keys, first = np.unique(sorted_keys, return_index=True)
    ends = np.append(first[1:], len(sorted_keys))
    return keys, [slice(a, b) for a, b in zip(first.tolist(), ends.tolist(), strict=True)]


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.string(), pa.binary()), strict=True)], ["bucket", "block", "payload"])


def spans(docs: DataFrame, k: int = K) -> DataFrame:
    """Rows of SPAN: maximal paths of edges of doc_id whose hashes also start, in step, in a smaller document."""
    buckets = 4 * partitions(docs.sparkSession)

    def meet(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """All edges of a bucket. Those of other than their hash's first document go back to their blocks with that source."""
        if key[0] < 0:
            return pdf[["block", "payload"]]
        parts = []
        for name, payload in enumerate(pdf["payload"]):
            h, low, ids, pos = expand(payload)
            h = from_planes(h)
            parts.append((h, ids.astype("i8") + low[0], pos.astype("i8"), np.full(len(h), name)))
        h, doc, pos, block = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((pos, doc, h))
        h, doc, pos, block = h[order], doc[order], pos[order], block[order]
        _, source = sourced(h, doc, pos)
        other = np.flatnonzero(doc != doc[source])
        other = other[np.lexsort((pos[other], doc[other], block[other]))]
        out = []
        for b, part in zip(*cuts(block[other]), strict=True):
            at = other[part]
            out.append((pdf["block"].iloc[int(b)], compress(*[x for v in (doc[at], doc[source[at]]) for x in offset(v)], narrow(pos[at]), narrow(pos[source[at]]))))
        return pd.DataFrame(out, columns=["block", "payload"])

    def compact(pdf: pd.DataFrame) -> pd.DataFrame:
        """All edges of a block with their sources, as spans."""
        found, done = [], []
        for payload in pdf["payload"]:
            x = expand(payload)
            if len(x) == 5:
                done.append(np.stack(x, axis=1))
            else:
                low, ids, low_s, ids_s, pos, at = x
                found.append(np.stack([ids.astype("i8") + low[0], pos.astype("i8"), ids_s.astype("i8") + low_s[0], at.astype("i8")]))
        if found:
            done.append(runs(*np.concatenate(found, axis=1)))
        return pd.DataFrame(np.concatenate(done), columns=["doc_id", "start", "n", "source_id", "source_start"])

    back = edges(docs, k, buckets).groupBy("bucket").applyInPandas(meet, "block string, payload binary")
    return back.groupBy("block").applyInPandas(compact, SPAN)


def digest(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def remove(docs: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept holds the words left, joined by one space.

    A word goes if a window of k words that covers it also starts in a document with a smaller doc_id, judged
    on the input. Null and empty texts have no words; of rows repeated with one doc_id none is a source for
    another; rows without doc_id are left whole; an empty table gives none; other columns aren't read.
    """
    return removed(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), k).select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept")


def removed(rows: DataFrame, k: int = K) -> DataFrame:
    """Rows (id, text, ...) with n_words, n_removed and kept in place of text; a text that loses nothing stays in whole.

    Each row is judged by its own words; what remove() says of texts and ids holds here.
    """
    others = [c for c in rows.columns if c not in ("id", "text")]

    def packed(*more: str) -> DataFrame:
        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            z = zstandard.ZstdCompressor(level=3)
            for batch in batches:
                made = [z.compress((t.as_py() or "").encode()) for t in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary()), *batch.columns[2:]], ["id", "z", *more])

        return rows.select("id", "text", *more).mapInArrow(lean(pack), with_columns("id long, z binary", *more))

    def with_columns(ddl: str, *more: str) -> T.StructType:
        return T.StructType([*T._parse_datatype_string(ddl).fields, *(rows.schema[c] for c in more)])

    def source_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                words = z.decompress(r["z"]).split()
                out += [(r["source_id"], a["source_start"], a["n"], digest(words[a["source_start"] : a["source_start"] + a["n"] + k - 1])) for a in r["asked"]]
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["source_id", "source_start", "n", "digest"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for data, spans_ in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                text = z.decompress(data.as_py())
                words = text.split()
                gone = np.zeros(len(words), bool)
                for s in spans_ or ():
                    end = s["start"] + s["n"] + k - 1
                    if end <= len(words) and digest(words[s["start"] : end]) == s["digest"]:
                        gone[s["start"] : end] = True
                kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if gone.any() else words
                out.append((len(words), int(gone.sum()), b" ".join(kept).decode(), text.decode() if others and not gone.any() else None))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            made = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made, *batch.columns[3:]], ["id", "n_words", "n_removed", "kept", "whole", *others])

    found = materialize(spans(rows.select(F.col("id").alias("doc_id"), "text"), k), "spans")
    texts = packed(*others)
    asked = found.select("source_id", "source_start", "n").distinct().groupBy("source_id").agg(F.collect_list(F.struct("source_start", "n")).alias("asked"))
    sources = packed().withColumnRenamed("id", "source_id").join(asked, "source_id")
    sources = sources.mapInArrow(lean(source_digests), "source_id long, source_start int, n int, digest binary").distinct()
    proved = found.join(sources, ["source_id", "source_start", "n"]).groupBy(F.col("doc_id").alias("id")).agg(F.collect_list(F.struct("start", "n", "digest")).alias("spans"))
    return texts.join(proved, "id", "left").select("id", "z", "spans", *others).mapInArrow(
        lean(cut), with_columns("id long, n_words long, n_removed long, kept string, whole string", *others)
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; those with repeats keep the words left, and n_chars is theirs. The columns are those of docs.

    Null and empty texts stay as they are, and so do rows without doc_id; rows repeated with one doc_id are cut each
    by its own words; an empty table stays empty; clashing names in docs are harmless.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"], F.col("text").isNull().alias("no text")).alias("row")
    found = removed(docs.select(F.col("doc_id").cast("long").alias("id"), "text", row))
    gone = F.col("n_removed") > 0
    text = F.when(gone, F.col("kept")).when(~F.col("row.`no text`"), F.col("whole"))
    new = {"text": text.cast(docs.schema["text"].dataType)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(gone, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return found.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


SQL = f"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + {K - 1}), ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {K - 2})) AS i FROM d)),
m AS (SELECT k, min(doc_id) AS f FROM g GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM (SELECT g.doc_id, i FROM g JOIN m USING (k) WHERE f < g.doc_id), range(0, {K}) t(j)),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM d),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS t FROM w ANTI JOIN gone USING (doc_id, p) GROUP BY 1),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN lost ON lost.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
