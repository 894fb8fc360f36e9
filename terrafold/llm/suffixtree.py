"""A probabilistic suffix tree over words: variable-length contexts, smoothed, scored at their longest suffix.

Counts go through the shuffle of distinct words (blocks.py): a block learns the corpus count of each of its
words from the word's bucket. Pairs of a context and its next word travel in the same way, one length after the
other: once a block, to buckets by a 64-bit hash, and their counts travel back. A pair is asked for only if both
its shorter parts occur LEAST times. At last contexts travel with their share of the divergence, and come back
with what they leave to shorter contexts if they are kept. The tree grows with the corpus; it is never in one
place, and only the corpus totals come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks
from .common import discard, materialize, partitions, table

#: Longest context in words.
LENGTH = 3
#: Fewest occurrences of a context, and of a context with its next word.
LEAST = 2
#: Taken from each listed count and left to the shorter context.
DISCOUNT = 0.5
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def word_shuffle(docs: DataFrame, flag) -> DataFrame:
    """Materialized rows of blocks.ROW: SEQUENCE rows as cut, WORDS rows with corpus counts, STATS rows of each bucket."""

    def code(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        return blocks.coded_words([t.encode().translate(LOWER) for t in texts], b"\n")

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        """All blocks' words of a bucket: total counts and numbers, sent back to each block."""
        if pdf["kind"].iloc[0] == blocks.SEQUENCE:
            return pdf
        bucket = int(pdf["bucket"].iloc[0])
        lengths, sums, data = zip(*map(blocks.expand, pdf["payload"]), strict=True)
        known = blocks.encoded(np.concatenate(lengths), b"".join(data))
        places = np.split(known.indices.to_numpy().astype("i8"), np.cumsum([len(x) for x in lengths])[:-1])
        parts = [(name, p, x.astype("i8")) for name, p, x in zip(pdf["block"], places, sums, strict=True)]
        totals = np.zeros(len(known.dictionary), "i8")
        for _, places, counts in parts:
            totals[places] += counts  # a word is once in a block
        out = [(blocks.WORDS, 0, name, bucket, blocks.compress(blocks.narrow(totals[p]), blocks.narrow(p))) for name, p, _ in parts]
        stats = blocks.compress(np.asarray([totals.sum(), (totals > 0).sum()], "<i8"))
        return pd.DataFrame([*out, (blocks.STATS, 0, "", bucket, stats)], columns=blocks.NAMES)

    rows = blocks.cut_blocks(docs, None, flag, code=code)
    return materialize(rows.groupBy("kind", "key").applyInPandas(count, blocks.ROW), "words")


STATE = "block string, bucket int, payload binary"


def assembled(shuffled: DataFrame) -> DataFrame:
    """A row of STATE a block: its documents and codes, and the counts and numbers of its words."""

    def put(pdf: pd.DataFrame) -> pd.DataFrame:
        words = pdf[pdf["kind"] == blocks.WORDS].sort_values("bucket")
        counts, numbers = [np.zeros(0, "i8")], [np.zeros(0, "i8")]
        for bucket, payload in zip(words["bucket"], words["payload"], strict=True):
            c, p = blocks.expand(payload)
            counts.append(c.astype("i8"))
            numbers.append(p.astype("i8") + (int(bucket) << 32))
        docs = pdf.loc[pdf["kind"] == blocks.SEQUENCE, "payload"].iloc[0]
        made = blocks.compress(docs, blocks.narrow(np.concatenate(counts)), np.concatenate(numbers))
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "bucket": [-1], "payload": [made]})

    rows = shuffled.where(F.col("kind") != blocks.STATS).select("kind", "block", "bucket", "payload")
    return materialize(rows.groupBy("block").applyInPandas(put, STATE), "blocks")


STEP, NEXT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def planes(keys: np.ndarray) -> bytes:
    """Sorted keys as bytes that compress: their differences, highest bytes of all first."""
    return np.diff(keys, prepend=np.uint64(0)).astype(">u8").view("u1").reshape(-1, 8).T.tobytes()


def sorted_keys(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, "u1").reshape(8, -1).T).view(">u8").ravel().astype("u8"), dtype="u8")


def cost(total: int) -> float:
    """Bits that listing a word costs: half the logarithm of the corpus size."""
    return 0.5 * np.log2(max(2, total))


class Block:
    """A block's tokens, with the counts found so far of the pairs of each length that they end."""

    def __init__(self, payload: bytes):
        self.docs, self.counts, self.numbers, *self.known = blocks.expand(payload)
        self.ids, on, self.lens, codes = blocks.sequence(self.docs)
        self.on = np.repeat(on, self.lens)
        self.place = np.arange(len(codes), dtype="i4") - np.repeat(np.cumsum(self.lens) - self.lens, self.lens).astype("i4")
        self.count, self.number = self.counts.astype("i8")[codes], self.numbers.astype("u8")[codes]
        #: Of each length, 0 for the word alone; 0 below LEAST.
        self.pair = [np.where(self.count >= LEAST, self.count, 0), *(x.astype("i8") for x in self.known)]
        self.context_counts: dict[int, np.ndarray] = {}
        self.context_keys = [np.zeros(len(self.number), "u8")]

    def before(self, x: np.ndarray, k: int, start) -> np.ndarray:
        """x of the k-th token before each; before its first token a document has start."""
        back = np.full(len(x), start, x.dtype)
        back[k:] = x[:-k] if k <= len(x) else []
        back[self.place < k] = start
        return back

    def context_count(self, depth: int) -> np.ndarray:
        """Of each token's context: as often as the pair that it is itself; 0 if there is none."""
        if depth not in self.context_counts:
            self.context_counts[depth] = self.before(self.pair[depth - 1], 1, self.pair[0][-1] if depth == 1 else 0)
        return self.context_counts[depth]

    def context_key(self, depth: int) -> np.ndarray:
        for k in range(len(self.context_keys), depth + 1):
            self.context_keys.append(mix(self.context_keys[-1] + self.before(self.number, k, self.number[-1]) + np.uint64(k * int(STEP) % 2**64)))
        return self.context_keys[depth]

    def may_be_kept(self, depth: int, total: int) -> np.ndarray:
        """False for tokens whose context can't be kept whatever follows it.

        A next word's share can't grow more from the shorter context than that is more frequent, so the gain is at
        most the count times the logarithm of the ratio of counts; it has to pay for a word at least.
        """
        n = self.context_count(depth)
        shorter = self.context_count(depth - 1) if depth > 1 else np.full(len(n), total)
        return (n > 0) & (n * np.log2(np.maximum(shorter, 1) / np.maximum(n, 1)) > cost(total))

    def pairs(self, depth: int, total: int) -> tuple[np.ndarray, np.ndarray]:
        """Tokens whose pair of a length may count, and its keys. The longest pairs matter to their contexts alone."""
        on = self.may_be_kept(depth, total) if depth == LENGTH else self.context_count(depth) > 0
        at = np.flatnonzero(on & (self.pair[depth - 1] > 0))
        return at, mix(self.context_key(depth)[at] ^ mix(self.number[at] + NEXT))

    def contexts(self, depth: int, total: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.may_be_kept(depth, total))
        return at, self.context_key(depth)[at]

    def divergence(self, depth: int, at: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of training tokens whose pair is listed: 1, their part of a listed word, and of the gain in bits.

        The gain is the divergence of the context's next words from the shorter context's.
        """
        m, n = self.pair[depth][at], self.context_count(depth)[at]
        on = self.on[at] & (m > 0)
        shorter = self.pair[depth - 1][at] / (np.maximum(1, self.context_count(depth - 1)[at]) if depth > 1 else max(1, total))
        m = np.maximum(1, m)
        return on.astype("f8"), on / m, np.where(on, np.log2(m / n / np.where(on, shorter, 1)), 0)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and the place of each key among them."""
    code, own = pd.factorize(keys)
    order = np.argsort(own)
    rank = np.empty(len(own), "i8")
    rank[order] = np.arange(len(own))
    return own[order], rank[code]


def dealt(state: DataFrame, n_buckets: int, asked, answer) -> DataFrame:
    """A written table with a row for each block and bucket, of the answers to the block's questions.

    asked(block) gives, in turn, keys and arrays of their tokens; arrays are summed by key. answer takes such
    sums of a bucket's distinct keys and gives an array, which is sent back to every block that asked. Answers are
    small and questions large: written, they let the shuffle of the questions go before blocks and answers meet.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, payload in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                parts: list[list] = [[] for _ in range(n_buckets)]
                for keys, *values in asked(Block(payload.as_py())):
                    own, at = distinct(keys)
                    sums = [np.bincount(at, x, len(own)) for x in values]
                    ends = np.searchsorted((own >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32), np.arange(n_buckets + 1))
                    for k, (i, j) in enumerate(zip(ends, ends[1:], strict=False)):
                        parts[k] += [planes(own[i:j]), *(whole(x[i:j]) for x in sums)]
                rows = [blocks.compress(*x) for x in parts]
                yield pa.RecordBatch.from_arrays([pa.array([name] * n_buckets), pa.array(range(n_buckets), pa.int32()), pa.array(rows, pa.binary())], ["block", "bucket", "payload"])

    def reply(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")  # sums of fractions come out alike
        held = [blocks.expand(x) for x in pdf["payload"]]
        out: list[list] = [[] for _ in held]
        at, n_sums = 0, answer.__code__.co_argcount
        while held and at < len(held[0]):
            keys = [sorted_keys(h[at]) for h in held]
            own, place = distinct(np.concatenate(keys))
            sums = [np.bincount(place, np.concatenate([h[at + k] for h in held]).astype("f8"), len(own)) for k in range(1, n_sums + 1)]
            found = answer(*sums)[place]
            for o, part in zip(out, np.split(found, np.cumsum([len(k) for k in keys])[:-1]), strict=True):
                o.append(whole(part))
            at += 1 + n_sums
        return pd.DataFrame({"block": pdf["block"], "bucket": pdf["bucket"], "payload": [blocks.compress(*o) for o in out]})

    return materialize(state.mapInArrow(ask, STATE).groupBy("bucket").applyInPandas(reply, STATE), "answers")


def whole(x: np.ndarray) -> np.ndarray:
    """Numbers in few bytes: exact where they are whole."""
    return blocks.narrow(x.astype("i8")) if (x == np.floor(x)).all() and (x >= 0).all() else x.astype("<f4")


def answers(pdf: pd.DataFrame) -> tuple[Block, Iterator[np.ndarray]]:
    """A block, and of each of its questions the answers in the order of its distinct keys."""
    pdf = pdf.sort_values("bucket")  # the block itself, then keys in order
    parts = zip(*map(blocks.expand, pdf["payload"].iloc[1:]), strict=True)
    return Block(pdf["payload"].iloc[0]), (np.concatenate(x) for x in parts)


def learn(state: DataFrame, depth: int, n_buckets: int, total: int) -> DataFrame:
    """Blocks with the counts of the pairs of one more length."""

    def asked(b: Block) -> Iterator[tuple]:
        at, keys = b.pairs(depth, total)
        yield keys, b.on[at].astype("f8")

    def put(pdf: pd.DataFrame) -> pd.DataFrame:
        b, found = answers(pdf)
        at, keys = b.pairs(depth, total)
        made = np.zeros(len(b.count), "i8")
        made[at] = next(found)[distinct(keys)[1]].astype("i8")
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "bucket": [-1], "payload": [blocks.compress(b.docs, b.counts, b.numbers, *b.known, blocks.narrow(made))]})

    found = dealt(state, n_buckets, asked, lambda n: np.where(n >= LEAST, n, 0))
    made = materialize(state.union(found).groupBy("block").applyInPandas(put, STATE), f"pairs{depth}")
    discard(state, found)
    return made


SCORES = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, training) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row of docs, learned from rows with the flag.

    Null and empty texts are one end token; repeated rows are scored, and learned from, each; an empty table
    gives no rows; columns besides doc_id and text aren't read. Probabilities of the next token sum to 1 over
    the training words and one class of unknown words, after every history.
    """
    n_buckets = 2 * partitions(docs.sparkSession)
    shuffled = word_shuffle(docs, training)
    stats = shuffled.where(F.col("kind") == blocks.STATS).select("payload")
    total, n_words = (int(x or 0) for x in stats.mapInPandas(totals, "n long, v long").agg(F.sum("n"), F.sum("v")).first())
    state = assembled(shuffled)
    discard(shuffled)
    for depth in range(1, LENGTH + 1):
        state = learn(state, depth, n_buckets, total)

    def asked(b: Block) -> Iterator[tuple]:
        for depth in range(1, LENGTH + 1):
            at, keys = b.contexts(depth, total)
            yield keys, *b.divergence(depth, at, total)

    def judge(listed: np.ndarray, words: np.ndarray, gain: np.ndarray) -> np.ndarray:
        """Of a kept context the count that its listed words keep, in discounts; 0 if it isn't kept."""
        words = np.round(words)
        return np.where(gain > words * cost(total), listed / DISCOUNT - words, 0)

    def scored(pdf: pd.DataFrame) -> pd.DataFrame:
        b, found = answers(pdf)
        base = (b.count + 0.5) / (total + 0.5 * (n_words + 1))
        p = base.copy()
        for depth in range(1, LENGTH + 1):
            at, keys = b.contexts(depth, total)
            held = next(found)[distinct(keys)[1]].astype("f8") * DISCOUNT
            at, held = at[held > 0], held[held > 0]
            m, n = b.pair[depth][at], b.context_count(depth)[at]
            p[at] = np.where(m > 0, m - DISCOUNT, 0) / n + (1 - held / n) * p[at]
        starts = np.cumsum(b.lens) - b.lens  # a text has a token at least
        sums = lambda x: np.add.reduceat(x, starts)
        return pd.DataFrame(
            {"doc_id": pd.array(b.ids, "Int64"), "n_tokens": b.lens, "n_known": sums((b.count > 0).astype("i8")), "train_tokens": total,
             "base_score": sums(np.log10(base)), "score": sums(np.log10(p))}
        )

    return state.union(dealt(state, n_buckets, asked, judge)).groupBy("block").applyInPandas(scored, SCORES)


def totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        heads = [blocks.expand(p)[0] for p in pdf["payload"]]
        yield pd.DataFrame({"n": [int(h[0]) for h in heads], "v": [int(h[1]) for h in heads]})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    found = score(table(spark, sf_dir, "documents"), ~held)
    return found.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
