import math
import random
from collections import Counter

from pyspark.sql import functions as F

from terrafold.llm import blocks, suffixtree

SCHEMA = "doc_id long, text string, n int, block string, docs int"


def texts(n, seed=4):
    rng = random.Random(seed)
    follow = {w: rng.choices("abcdefgh", k=3) for w in "abcdefgh"}
    for _ in range(n):
        w, out = "a", []
        for _ in range(rng.randint(0, 60)):
            w = rng.choice(follow[w]) if rng.random() < 0.9 else rng.choice("abcdefgh")
            out.append(w.upper() if rng.random() < 0.1 else w)
            if out[-2:] == ["a", "b"]:
                w = "h"
        yield "  ".join(out) + (f" rare{rng.randint(0, 50)}" if rng.random() < 0.3 else "")


def tokens(text):
    return [*"".join(c.lower() if c.isascii() else c for c in text or "").split(), None]


def test_counts_base_and_gain(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 4000)
    rows = [(i, t, 1, "x", 2) for i, t in enumerate([*texts(400), None, "", "Éa a", "unseen words only"])]
    df = spark.createDataFrame([*rows, rows[3]], SCHEMA)
    got = suffixtree.score(df, F.col("doc_id") % 5 != 1).collect()
    assert len(got) == len(rows) + 1
    count = Counter(t for r in [*rows, rows[3]] if r[0] % 5 != 1 for t in tokens(r[1]))
    n, v = sum(count.values()), len(count)
    by = dict((r[0], r[1]) for r in rows)
    for r in got:
        ts = tokens(by[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ts), sum(t in count for t in ts), n)
        assert math.isclose(r.base_score, sum(math.log10((count[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts), rel_tol=1e-9)
    held = [r for r in got if r.doc_id % 5 == 1]
    assert sum(r.score for r in held) > 0.85 * sum(r.base_score for r in held)


class Brute:
    """The same model in dictionaries of whole contexts, without hashes, blocks or steps."""

    def __init__(self, texts):
        self.docs = [[None, *tokens(t)] for t in texts]
        self.words = Counter(t for d in self.docs for t in d[1:])
        self.total, least, cut = sum(self.words.values()), suffixtree.LEAST, suffixtree.DISCOUNT
        counts = Counter((tuple(d[i - k : i]), d[i]) for d in self.docs for i in range(1, len(d)) for k in range(1, 4) if i >= k)
        self.pair = {x: n for x, n in counts.items() if n >= least}
        context = Counter()
        for (c, _), n in counts.items():
            context[c] += n
        self.context, self.kept = context, {}
        listed = {}
        for (c, w), n in self.pair.items():
            listed.setdefault(c, []).append((w, n))
        for c, found in listed.items():
            shorter = lambda w: self.pair[c[1:], w] / context[c[1:]] if len(c) > 1 else self.words[w] / self.total  # noqa: B023, E731
            gain = sum(n * math.log2(n / context[c] / shorter(w)) for w, n in found)
            if gain > len(found) * 0.5 * math.log2(self.total):
                self.kept[c] = 1 - sum(n - cut for _, n in found) / context[c]

    def p(self, history, w):
        p = (self.words[w] + 0.5) / (self.total + 0.5 * (len(self.words) + 1))
        for k in range(1, 4):
            c = tuple(history[-k:])
            if len(c) == k and c in self.kept:
                n = self.pair.get((c, w), 0)
                p = (n - suffixtree.DISCOUNT if n else 0) / self.context[c] + self.kept[c] * p
        return p

    def score(self, text):
        d = [None, *tokens(text)]
        return sum(math.log10(self.p(d[:i], d[i])) for i in range(1, len(d)))


def test_empty_table(spark):
    assert suffixtree.score(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0


def test_score_against_brute_force(spark, monkeypatch):
    """Contexts that occur LEAST times among very many others are learned; every score is that of the model in dictionaries."""
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 4000)
    rng = random.Random(7)
    filler = [" ".join(f"w{rng.randint(0, 400)}" for _ in range(100)) for _ in range(500)]
    once = " ".join(f"once{k} w{rng.randint(0, 400)}" for k in range(40))
    rows = [(i, t, 1, "x", 2) for i, t in enumerate([*filler, *texts(200), *["zig zag zog"] * 12, *["p x y q", "r x y s"] * 60, once, once, "", None, "a " * 20000])]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in suffixtree.score(df, F.col("doc_id") % 7 != 1).collect()}
    brute = Brute([t for i, t, *_ in rows if i % 7 != 1])
    assert {len(c) for c in brute.kept} == {1, 2, 3}
    for i, t, *_ in rows:
        assert math.isclose(got[i].score, brute.score(t), rel_tol=1e-6), i
    zig = got[len(filler) + 200]
    assert zig.score > 0.6 * zig.base_score
    twice = [got[i] for i, t, *_ in rows if t == once]
    assert all(r.score > 0.6 * r.base_score for r in twice) and len(twice) == 2


def test_probabilities_sum_to_one():
    brute = Brute(list(texts(300)))
    for history in ([None], [None, "a"], [None, "c", "d"], [None, "a", "b", "h"], [None, "nowhere"]):
        assert math.isclose(sum(brute.p(history, w) for w in [*brute.words, "unknown"]), 1, rel_tol=1e-9)


def test_odd_rows(spark):
    """Repeated rows, null ids and a very long text: a row each."""
    rows = [(1, "a b", 1, "x", 2), (1, "a b", 1, "x", 2), (None, "a b", 1, "x", 2), (2, None, 1, "x", 2), (3, "long " * 200_000, 1, "x", 2)]
    got = suffixtree.score(spark.createDataFrame(rows, SCHEMA), F.lit(True)).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 3), (1, 3), (1, 3), (2, 1), (3, 200_001)]


def test_words_of_a_block_are_coded_as_if_split_one_by_one():
    from terrafold.llm import blocks

    texts = [b"", b" \t\n\x0b\x0c\r ", b"a b a", b"\x00 \x1c\xc2\xa0 \x85 b", b"  b\n\na  ", "\u2003\u00e9 x".encode(), b"x" * 70000, b""]
    want = blocks.coded([t.decode("latin-1") for t in texts], lambda t: [*t.encode("latin-1").split(), b"\n"])
    got = blocks.coded_words(texts, b"\n")
    assert got[2] == want[2] and all((a == b).all() and a.dtype == b.dtype for a, b in zip(got[:2], want[:2], strict=True))
    assert blocks.coded_words([b""], b"\n")[2] == [b"\n"]
