"""Best-fit packing of token pieces, improved by a swap-based local search.

Pieces of one length are interchangeable, so bins are planned on the histogram of lengths: at most
``size`` lengths, whatever the number of documents. A plan is a list of bin patterns with their
multiplicities; every planning step adds at most one pattern, so the plan is bounded as well.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lean, materialize, partitions, table

SIZE = 2048
#: Bytes of words and their ids that a task keeps, about. Memory only, results are the same.
CACHE_BYTES = 48 << 20
#: Text bytes whose words are looked up together, about.
TOGETHER = 4 << 20
#: A lone sign at a word's end is a token of its own, as it is after white space.
SIGN = r"([a-z0-9])([.,;:!?])([ \t\n])"

Pattern = tuple[tuple[int, int], ...]


class Letters:
    """The vocabulary's merges for words of lower-case Latin-1 letters, as byte ranks of another library.

    That library merges single bytes, so each of the vocabulary's symbols (a byte of UTF-8, within a word or at
    its end) is given a code below 128. Ids are the ranks; a token with a word's end closes the word.
    """

    WORD = re.compile("[a-zß-öø-ÿ]+")
    #: Codes: 0 the lead byte of the letters beyond ASCII, then their second bytes; ENDS hold a word's last symbol.
    ENDS = (0x22, 0x5C)

    def __init__(self, model: dict):
        import tiktoken

        merges = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        ids = [model["vocab"]["".join(x)] for x in merges]
        self.usable = model["end_of_word_suffix"] == "</w>" and not model["dropout"] and not model["ignore_merges"] and ids == sorted(ids)
        if not self.usable:
            return
        seconds = range(0x9F, 0xC0)
        ends = [x for x in range(0x22, 0x5D) if not 0x41 <= x <= 0x5A]
        code = {chr(0xC3): 0, **{chr(c): c for c in range(0x61, 0x7B)}}
        code |= {chr(c) + "</w>": c - 0x20 for c in range(0x61, 0x7B)}
        shown = lambda b: chr(b) if b not in (*range(0x7F, 0xA1), 0xAD) else chr(0x100 + (b - 0x7F + 33 if b < 0xA1 else 67))  # noqa: E731  byte-level letters of bytes
        code |= {shown(b): 1 + k for k, b in enumerate(seconds)} | {shown(b) + "</w>": ends[k] for k, b in enumerate(seconds)}
        self.last = {chr(c): chr(c - 0x20) for c in range(0x61, 0x7B)} | {chr(0xC0 + b - 0x80): "\0" + chr(ends[k]) for k, b in enumerate(seconds)}
        self.within = bytes(0 if b == 0xC3 else 1 + b - 0x9F if b in seconds else b for b in range(256))
        ranks, self.closes = {}, np.zeros(max(model["vocab"].values()) + 1, bool)
        for token, k in model["vocab"].items():
            body = token.removesuffix("</w>")
            self.closes[k] = body != token
            symbols = [*body[:-1], body[-1:] + token[len(body) :]]
            if all(x in code for x in symbols):
                ranks[bytes(code[x] for x in symbols)] = k
        self.usable = all(bytes([c]) in ranks for c in code.values())
        if self.usable:
            self.bpe = tiktoken.Encoding("letters", pat_str=r"[^\x22-\x5c]*[\x22-\x5c]", mergeable_ranks=ranks, special_tokens={})

    def __call__(self, words: list[str]) -> list[bytes]:
        if not words:
            return []
        last = self.last
        coded = "".join([w[:-1] + last[w[-1]] for w in words]).encode().translate(self.within).decode()
        ids = np.asarray(self.bpe.encode_ordinary(coded), "<u4")
        data, cuts = ids.tobytes(), (4 * np.flatnonzero(self.closes[ids]) + 4).tolist()
        return [data[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]


class WordIds:
    """Ids of texts under a vocabulary that drops white space: a text's ids are its words' ids in turn.

    New words are encoded together: those of plain letters by Letters, others by the vocabulary's own library, as
    one text with a mark between them whose single id no word has. Texts that hold a special token of the
    vocabulary are encoded as they are, as it may stand inside a word. Words met again stay longer than others:
    each of the two tables holds CACHE_BYTES / 2 and then starts anew.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = Letters(json.loads(self.tokenizer.to_str())["model"])
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.often: dict[str, bytes] = {}
        self.recent: dict[str, bytes] = {}
        self.room = [CACHE_BYTES // 2, CACHE_BYTES // 2]
        self.mark, self.mark_id = self.find_mark()

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def find_mark(self) -> tuple[str, int]:
        """The first symbol, from the last block of symbols down, that is one token."""
        for c in map(chr, (*range(0x1FAFF, 0x1F2FF, -1), *range(0x2BFF, 0x2010, -1))):
            found = self.ids(c)
            if len(found) == 1:
                return c, found[0]
        raise ValueError("the vocabulary has no symbol to set words apart by")

    def marked(self, words: list[str]) -> list[bytes]:
        ids = np.asarray(self.ids(f" {self.mark} ".join(words)), "<u4")
        marks = np.flatnonzero(ids == self.mark_id)
        if len(marks) != len(words) - 1:  # a word has the mark itself
            return [np.asarray(self.ids(w), "<u4").tobytes() for w in words]
        data, cuts = ids.tobytes(), (4 * marks).tolist()
        return [data[a:b] for a, b in zip([0, *(c + 4 for c in cuts)], [*cuts, len(data)], strict=True)]

    def learn(self, words: list[str]) -> list[bytes]:
        if not self.letters.usable:
            return self.marked(words)
        plain = [Letters.WORD.fullmatch(w) is not None for w in words]
        made = iter(self.letters([w for w, p in zip(words, plain, strict=True) if p]))
        others = [w for w, p in zip(words, plain, strict=True) if not p]
        other = iter(self.marked(others) if others else ())
        return [next(made) if p else next(other) for p in plain]

    def of_words(self, words: list[str]) -> list[bytes]:
        """Ids of different words."""
        often, recent = self.often, self.recent
        out = [often.get(w) for w in words]
        new = []
        for k, x in enumerate(out):
            if x is None:
                w = words[k]
                x = recent.pop(w, None)
                if x is None:
                    new.append(k)
                else:
                    out[k] = often[w] = x
                    self.room[0] -= 200 + len(w) + len(x)
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            for k, x in zip(part, self.learn([words[k] for k in part]), strict=True):
                out[k] = recent[words[k]] = x
                self.room[1] -= 200 + len(words[k]) + len(x)
        if self.room[0] < 0:
            self.often, self.room[0] = {}, CACHE_BYTES // 2
        if self.room[1] < 0:
            self.recent, self.room[1] = {}, CACHE_BYTES // 2
        return out

    def __call__(self, texts: pa.Array) -> list[bytes]:
        """Little-endian ids of each text, null is empty."""
        texts = pc.fill_null(texts, "")
        whole = np.zeros(len(texts), bool)
        for s in self.special:
            whole |= pc.match_substring(texts, s, ignore_case=True).to_numpy(zero_copy_only=False)
        # the tokenizer lowers letters and drops white space; only ASCII of either is done here
        words = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.ascii_lower(texts), SIGN, r"\1 \2\3"))
        flat = words.flatten().dictionary_encode()
        codes = flat.indices.to_numpy()
        made = self.of_words(flat.dictionary.to_pylist())
        sizes = np.fromiter(map(len, made), "i8", len(made)) // 4
        each = sizes[codes]
        ends = np.concatenate([[0], np.cumsum(each)])
        kind = "i4" if max(ends[-1], sizes.sum()) < 1 << 31 else "i8"
        places = np.repeat(((np.cumsum(sizes) - sizes)[codes] - ends[:-1]).astype(kind), each) + np.arange(ends[-1], dtype=kind)
        ids = np.frombuffer(b"".join(made), "<u4")[places]
        stops = ends[words.offsets.to_numpy() - words.offsets[0].as_py()].tolist()
        out = [ids[a:b].tobytes() for a, b in zip(stops, stops[1:], strict=False)]
        for k in np.flatnonzero(whole):
            out[k] = np.asarray(self.ids(texts[int(k)].as_py()), "<u4").tobytes()
        return out


def together(texts: pa.Array) -> Iterator[pa.Array]:
    """Runs of texts of about TOGETHER bytes."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).cumsum()
    at = 0
    while at < len(texts):
        before = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, before + TOGETHER)))
        yield texts.slice(at, end - at)
        at = end


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, size: int = SIZE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): a document's ids and a final 0, cut at every ``size`` ids.

    A null or empty text is the single id 0.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = WordIds(path)
        for batch in batches:
            out: list[tuple] = []
            coded = (ids for part in together(batch.column(1)) for ids in ids_of(part))
            for doc, ids in zip(batch.column(0).to_pylist(), coded, strict=True):
                ids += b"\0\0\0\0"
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    out.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            if out:
                cols = list(zip(*out, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(lean(cut), PIECES)


def best_fit(lengths: dict[int, int], size: int) -> Counter:
    """Pattern -> bins, by best fit in decreasing length on a histogram of lengths."""
    rooms: list[int] = []  # the different free rooms of open bins, sorted
    open_bins: dict[int, Counter] = defaultdict(Counter)

    def put(pattern: Counter, n: int) -> None:
        room = size - sum(k * v for k, v in pattern.items())
        if not open_bins[room]:
            bisect.insort(rooms, room)
        open_bins[room][tuple(sorted(pattern.items()))] += n

    for length in sorted(lengths, reverse=True):
        left = lengths[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                each = size // length
                if left >= each:
                    put(Counter({length: each}), left // each)
                if left % each:
                    put(Counter({length: left % each}), 1)
                break
            room = rooms[at]
            pattern, n = open_bins[room].popitem()
            if not open_bins[room]:
                rooms.pop(at)
            each = room // length
            full = min(n, left // each)
            if full:
                put(Counter(dict(pattern)) + Counter({length: each}), full)
            left -= full * each
            if full < n and left:
                put(Counter(dict(pattern)) + Counter({length: left}), 1)
                full, left = full + 1, 0
            if full < n:
                put(Counter(dict(pattern)), n - full)
    return Counter({p: n for room in open_bins.values() for p, n in room.items()})


def exchanges(a: Counter, b: Counter, room: int) -> Iterator[tuple[int, Counter, Counter]]:
    """(gain of a's fill, out of a, out of b): moves, one-for-one and two-for-one exchanges that fit a's room."""
    theirs = sorted(b)
    for y in theirs:
        if y <= room:
            yield y, Counter(), Counter({y: 1})
    pairs = [(y + z, Counter([y, z])) for i, y in enumerate(theirs) for z in theirs[i:] if y != z or b[y] > 1]
    for x in a:
        for y in theirs:
            if 0 < y - x <= room:
                yield y - x, Counter({x: 1}), Counter({y: 1})
        for both, ys in pairs:
            if 0 < both - x <= room:
                yield both - x, Counter({x: 1}), ys


def local_search(bins: Counter, size: int) -> Counter:
    """Empty the least filled bins into other underfull bins.

    Every step takes from the emptiest bin and fills another underfull, fuller one, so the sum of
    squared fills grows, which it can't do for ever; it ends at the least possible number of bins, or where
    no step helps. A step serves a whole group of equal bins.
    """
    bins = Counter(bins)
    fill = lambda p: sum(k * v for k, v in p)
    total = sum(fill(p) * n for p, n in bins.items())
    least = -(-total // size)
    stuck: set[Pattern] = set()

    def change(pattern: Pattern, n: int) -> None:
        bins[pattern] += n
        if bins[pattern] <= 0 or not pattern:
            del bins[pattern]

    under = {p for p in bins if fill(p) < size}
    while sum(bins.values()) > least:
        under = {p for p in under if bins[p]}
        source = min((p for p in under if p not in stuck), key=lambda p: (fill(p), p), default=None)
        if source is None:
            break
        b, done = Counter(dict(source)), False
        for target in sorted(under, key=lambda p: (-fill(p), p)):
            if fill(target) < fill(source) or target == source and bins[source] < 2:
                continue
            a, room = Counter(dict(target)), size - fill(target)
            best = max(exchanges(a, b, room), key=lambda m: m[0], default=None)
            if best is None:
                continue
            _, out_a, out_b = best
            new_a, new_b = tuple(sorted((a - out_a + out_b).items())), tuple(sorted((b - out_b + out_a).items()))
            n = bins[source] // 2 if target == source else min(bins[source], bins[target])
            for p, k in ((source, -n), (target, -n), (new_a, n), (new_b, n)):
                change(p, k)
            under |= {p for p in (new_a, new_b) if p and fill(p) < size}
            stuck.clear()
            done = True
            break
        if not done:
            stuck.add(source)
    return bins


def slots(bins: Counter) -> pd.DataFrame:
    """(length, first, last, sequence, offset): the first..last-th pieces of a length, in places of equal bins."""
    taken: Counter = Counter()
    rows, sequence = [], 0
    for pattern, n in sorted(bins.items()):
        offset = 0
        for length, k in pattern:
            for _ in range(k):
                rows.append((length, taken[length], taken[length] + n - 1, sequence, offset))
                taken[length] += n
                offset += length
        sequence += n
    return pd.DataFrame(rows, columns=["length", "first", "last", "sequence", "offset"]).astype("int64")


def ranked(found: DataFrame) -> DataFrame:
    """Number the pieces of each length from 0.

    A length may hold a third of all rows, so rows are counted by length and a share of the ids; only a
    share's rows are numbered together, after the rows of the shares before it.
    """
    shares = 4 * partitions(found.sparkSession)
    rows = found.withColumn("share", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shares)))
    before = (
        rows.groupBy("length", "share").count()
        .withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("share")) - F.col("count"))
        .drop("count")
    )
    within = Window.partitionBy("length", "share").orderBy("doc_id", "piece", "ids_crc32")
    return rows.withColumn("nth", F.row_number().over(within) - 1).join(before, ["length", "share"]).withColumn("nth", F.col("nth") + F.col("before"))


def pack(docs: DataFrame, path: str, size: int = SIZE) -> DataFrame:
    """Pieces of all documents with their sequence_id and offset; sequences hold at most ``size`` ids.

    Null and empty texts are one id long and packed as any other; repeated rows are packed each; an
    empty table gives no rows; columns besides doc_id and text aren't read.
    """
    spark = docs.sparkSession
    found = materialize(pieces(docs, path, size), "pieces")
    lengths = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}  # at most `size` rows
    plan = slots(local_search(best_fit(lengths, size), size))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        starts = {k: g.reset_index(drop=True) for k, g in table_of.value.groupby("length")}
        for rows in batches:
            parts = []
            for length, g in rows.groupby("length"):
                s = starts[length]
                at = np.searchsorted(s["first"].to_numpy(), g["nth"].to_numpy(), side="right") - 1
                g = g.assign(
                    sequence_id=s["sequence"].to_numpy()[at] + g["nth"].to_numpy() - s["first"].to_numpy()[at],
                    offset=s["offset"].to_numpy()[at],
                )
                parts.append(g)
            if parts:
                yield pd.concat(parts)[names]

    table_of = spark.sparkContext.broadcast(plan)  # bounded: see the module's docstring
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return ranked(found).select("doc_id", "piece", "start", "length", "ids_crc32", "nth").mapInPandas(place, PIECES + ", sequence_id long, offset long")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies; a last stage, so it returns pieces.

    Nulls, empty texts, repeated rows, empty tables and other columns are treated as by pack().
    """
    return pack(docs, vocabulary())
