import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from terrafold.llm import packing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, piece int, share int"


def test_plan_holds_every_piece_and_no_bin_overflows():
    rng = random.Random(5)
    for size in (16, 64):
        for _ in range(30):
            lengths = Counter(rng.randint(1, size) for _ in range(rng.randint(0, 300)))
            bins = packing.local_search(packing.best_fit(lengths, size), size)
            held = Counter()
            for pattern, n in bins.items():
                assert sum(k * v for k, v in pattern) <= size and n > 0
                for k, v in pattern:
                    held[k] += v * n
            assert held == lengths


def test_local_search_empties_bins():
    # best fit would not build this: six bins a third short, which two for one exchanges and moves close
    start = Counter({((4, 1), (2, 1)): 6, ((3, 1),): 4})
    found = packing.local_search(start, 9)
    assert sum(found.values()) == -(-(6 * 6 + 4 * 3) // 9)


@pytest.mark.parametrize("size", [16, 2048])
def test_pack_against_the_tokenizer(spark, size):
    from tokenizers import Tokenizer

    texts = ["Hello, wörld's  end\n\tit's", None, "", "a " * 3000, "x\x1cy\xa0z é é <|endoftext|> ǅ İ 12345", "same", "same", "ab" * 5000, "End. no,, x!, 5. a.b c.\tq. Q.\n É. it's, 's. . , x ,y A\u030a. d.\u00a0e"]
    rows = [(i, t, None, "s", None, 1, 2) for i, t in enumerate(texts)] + [(5, "same", None, "s", None, 1, 2)]
    got = packing.pack(spark.createDataFrame(rows, SCHEMA), packing.vocabulary(), size).collect()
    t = Tokenizer.from_file(packing.vocabulary())
    expect = Counter()
    for doc, text, *_ in rows:
        ids = np.asarray([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        for k, at in enumerate(range(0, len(ids), 4 * size)):
            part = ids[at : at + 4 * size]
            expect[doc, k, at // 4, len(part) // 4, zlib.crc32(part)] += 1
    assert Counter(tuple(r)[:5] for r in got) == expect
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for found in by.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= size


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), packing.vocabulary()).count() == 0


def test_words_of_letters_against_the_tokenizer():
    """Every word of one to three letters of a mixed alphabet, and long random ones; and a vocabulary that the fast path can't take."""
    import itertools

    from tokenizers import Tokenizer

    ids_of = packing.WordIds(packing.vocabulary())
    assert ids_of.letters.usable
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzßàáâäåæçèéêëìíîïñòóôõöøùúûüýþÿ"
    words = ["".join(w) for n in (1, 2) for w in itertools.product(letters, repeat=n)]
    syllables = ["the", "ing", "tion", "er", "en", "sch", "que", "ß", "ö", "é", "è", "ñ", "ç", "ou", "x", "zz", "qu", "ij"]
    words += list({"".join(rng.choices(syllables, k=rng.randint(1, 9))) for _ in range(20_000)})
    t = Tokenizer.from_file(packing.vocabulary())
    expect = [np.asarray(e.ids, "<u4").tobytes() for e in t.encode_batch(words, add_special_tokens=False)]
    assert ids_of.letters(words) == expect
    assert ids_of.of_words(words) == expect and ids_of.of_words(words) == expect
    assert not packing.Letters({"merges": [], "vocab": {}, "end_of_word_suffix": None, "dropout": None, "ignore_merges": False}).usable


def test_bounded_cache_gives_the_same(monkeypatch):
    import pyarrow as pa

    texts = pa.array([" ".join(f"w{k % 97}x{k}" for k in range(a, a + 400)) for a in range(0, 4000, 150)])
    whole = packing.WordIds(packing.vocabulary())(texts)
    monkeypatch.setattr(packing, "CACHE_BYTES", 20_000)
    ids_of = packing.WordIds(packing.vocabulary())
    assert [x for k in range(len(texts)) for x in ids_of(texts.slice(k, 1))] == whole


def test_sequences_against_an_independent_packing():
    """No more bins than first fit decreasing, on lengths that it doesn't pack at best."""
    rng = random.Random(8)
    for _ in range(40):
        size = 100
        lengths = Counter(rng.choice((34, 26, 51, 27, 12, rng.randint(1, 100))) for _ in range(rng.randint(1, 400)))
        rooms = []
        for x in sorted(lengths.elements(), reverse=True):
            at = next((k for k, r in enumerate(rooms) if r >= x), None)
            if at is None:
                rooms.append(size - x)
            else:
                rooms[at] -= x
        assert sum(packing.local_search(packing.best_fit(lengths, size), size).values()) <= len(rooms)
