"""Byte-level BPE: every distinct pre-token of the corpus is encoded once, in the bucket its hash sends it to."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks
from .common import table


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids): the ids of each whole text, as a binary of little-endian unsigned 32-bit numbers.

    Pre-tokens are exploded by block with their positions, as codes; distinct ones are dealt by hash,
    encoded once each, sent back to their blocks and put in place by position. A null or empty text has no
    ids; repeated rows give a row each; an empty table none; columns besides doc_id and text aren't read.

    docs is read twice, once for the pre-tokens and once for their positions, so that the positions go through
    one shuffle only. Read it from a table: if the two readings differ in rows or order, the query fails.
    """

    def pre_tokens(text: str) -> list[bytes]:
        return [w.encode() for w in splitter().findall(text)]

    def splitter(kept: list = []):  # noqa: B006  one compiled pattern a worker
        if not kept:
            import regex

            kept.append(regex.compile(pattern))
        return kept[0]

    def encode_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        # a pre-token is one piece
        bpe = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=read_ranks(path), special_tokens={})
        known: dict[bytes, bytes] = {}
        bucket = None
        for batch in batches:
            for r in batch.to_pylist():
                if r["bucket"] != bucket:  # rows are sorted by bucket
                    known, bucket = {}, r["bucket"]
                lengths, _, data = blocks.expand(r["payload"])
                words = blocks.split_words(lengths, data)
                for w in words:
                    if w not in known:
                        known[w] = np.asarray(bpe.encode_ordinary(w.decode()), "<u4").tobytes()
                made = [known[w] for w in words]
                ids = np.frombuffer(b"".join(made), "<u4")
                payload = blocks.compress(blocks.narrow(np.asarray([len(x) // 4 for x in made], "i8")), blocks.narrow(ids))
                yield blocks.record_batch([(blocks.WORDS, r["key"], r["block"], r["bucket"], payload)])

    def assemble(placed: pd.DataFrame, encoded: pd.DataFrame) -> pd.DataFrame:
        if len(placed) != 1:
            raise ValueError("the documents differ from those read for their pre-tokens")
        docs_, _, lens, codes = blocks.sequence(placed["payload"].iloc[0])
        parts = [blocks.expand(p) for p in encoded.sort_values("bucket")["payload"]]
        sizes = np.concatenate([np.zeros(0, "i8"), *(n.astype("i8") for n, _ in parts)])
        ids = np.concatenate([np.zeros(0, "<u4"), *(i.astype("<u4") for _, i in parts)])
        if len(sizes) != (int(codes.max()) + 1 if len(codes) else 0):
            raise ValueError("the documents differ from those read for their pre-tokens")
        starts = np.cumsum(sizes) - sizes
        each = sizes[codes]
        ends = np.cumsum(each)
        out = ids[np.repeat(starts[codes] - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)] if len(codes) else ids[:0]
        stop = np.concatenate([[0], ends])[np.cumsum(lens)]
        cuts = zip([0, *stop[:-1].tolist()], stop.tolist(), strict=True)
        return pd.DataFrame({"doc_id": pd.array(docs_, "Int64"), "ids": [out[a:b].tobytes() for a, b in cuts]})

    words = blocks.cut_blocks(docs, pre_tokens, kinds=(blocks.WORDS,))
    dealt = words.repartition("key").sortWithinPartitions("bucket").mapInArrow(encode_words, blocks.ROW)
    places = blocks.cut_blocks(docs, pre_tokens, kinds=(blocks.SEQUENCE,)).select("block", "payload")
    # two exchanges, not one of a union: a task's number is part of the names of its blocks
    pairs = places.groupBy("block").cogroup(dealt.select("block", "bucket", "payload").groupBy("block"))
    return pairs.applyInPandas(assemble, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds decoded, the bytes of ids. Ids are joined with the token-byte table, which has a row a rank of the vocabulary.

    The table is bounded by the vocabulary, so each task holds it whole, by rank, and joins all ids of some rows at
    once. Null ids decode to null; an id that the table lacks is an error.
    """
    at, names = encoded.columns.index("ids"), encoded.columns

    def joined(ids: pa.Array, sizes: np.ndarray, starts: np.ndarray, flat: np.ndarray) -> pa.Array:
        held = [x.as_py() or b"" for x in ids]
        number = np.frombuffer(b"".join(held), "<u4")
        if len(number) and (number.max() >= len(sizes) or not sizes[number].all()):
            raise ValueError("an id that the token-byte table lacks")
        each = sizes[number]
        ends = np.concatenate([[0], np.cumsum(each)])
        data = flat[np.repeat(starts[number] - ends[:-1], each) + np.arange(ends[-1])].tobytes()
        cuts = ends[np.cumsum([0, *(len(x) // 4 for x in held)])].tolist()
        return pa.array([data[a:b] if x.is_valid else None for a, b, x in zip(cuts, cuts[1:], ids, strict=False)], pa.binary())

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = {k: w for w, k in read_ranks(path).items()}
        table_ = [token.get(k, b"") for k in range(max(token, default=-1) + 1)]
        sizes = np.fromiter(map(len, table_), "i8", len(table_))
        starts, flat = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(table_), "u1")
        for batch in batches:
            made = [joined(batch.column(at).slice(k, 256), sizes, starts, flat) for k in range(0, batch.num_rows, 256)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.concat_arrays(made) if made else pa.array([], pa.binary())], [*names, "decoded"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(join, f"{kinds}, decoded binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    path = P.path("byte_bpe_50k.tiktoken")
    found = decode(encode(table(spark, sf_dir, "documents"), path, P.PATTERN), path)
    return found.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
