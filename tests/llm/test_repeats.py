import random
from collections import Counter, defaultdict

import pytest

from terrafold.llm import repeats

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, start int, kept int"


def brute(rows, k):
    docs = [(i, (t or "").encode().split()) for i, t, *_ in rows]
    least = defaultdict(lambda: 1 << 62)
    for i, ws in docs:
        for p in range(len(ws) - k + 1):
            g = tuple(ws[p : p + k])
            least[g] = min(least[g], i)
    out = Counter()
    for i, ws in docs:
        gone = set()
        for p in range(len(ws) - k + 1):
            if least[tuple(ws[p : p + k])] < i:
                gone.update(range(p, p + k))
        out[i, len(ws), len(gone), b" ".join(w for j, w in enumerate(ws) if j not in gone).decode()] += 1
    return out


@pytest.mark.parametrize("small", [True, False])
def test_against_brute_force(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(repeats, "BLOCK_BYTES", 1500)
    rng = random.Random(7)
    word = lambda: rng.choice("abcdefg") * rng.randint(1, 2)
    passages = [" ".join(word() for _ in range(rng.randint(5, 40))) for _ in range(8)]
    texts = ["  ".join(rng.choice([rng.choice(passages), word(), word()]) for _ in range(rng.randint(0, 12))) for _ in range(120)]
    texts += [None, "", " \n", "x " * 400, "x\t" * 300, texts[3], texts[3], passages[0] + "é\x1c" + passages[0]]
    rows = [(i, t, "en", "s", len(t or ""), 1, 2) for i, t in enumerate(texts)] + [(3, texts[3], "en", "s", 5, 1, 2), (9, texts[10], "en", "s", 5, 1, 2)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    got = repeats.remove(df, 6).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == brute(rows, 6)


def test_stage_and_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, text, "en", "s", len(text), 1, 2), (2, "own\n" + text, "en", "s", 99, 1, 2), (None, text, "en", "s", 1, 1, 2)], SCHEMA)
    got = {r.doc_id: r for r in repeats.stage(spark, df, "").collect()}
    assert got[1].text == text and got[2].text == "own" and got[2].n_chars == 3 and got[None].text == text
    assert repeats.remove(df.limit(0)).count() == 0


def test_stage_judges_rows_of_one_doc_id_by_their_own_words(spark):
    """Different texts under one doc_id, odd columns, nulls and a very long text."""
    shared, tail = " ".join(f"w{i}" for i in range(30)), "one tail"
    rows = [(1, shared, 1.5), (2, "whole  other text", 2.5), (2, f"{tail} {shared}", 3.5), (3, None, 4.5), (4, "", 5.5), (5, "x " * 100_000 + shared, 6.5), (None, shared, 7.5)]
    df = spark.createDataFrame([(i, t, v, "a", 1) for i, t, v in rows], "doc_id int, text string, kept double, `odd name` string, whole int")
    got = {r.kept: (r.doc_id, r.text) for r in repeats.stage(spark, df, "").collect()}
    assert repeats.stage(spark, df, "").columns == df.columns
    # the long text's windows of x repeat within itself only
    want = {1.5: (1, shared), 2.5: (2, "whole  other text"), 3.5: (2, tail), 4.5: (3, None), 5.5: (4, ""), 6.5: (5, " ".join(["x"] * 100_000)), 7.5: (None, shared)}
    assert got == want


def test_a_block_takes_few_bytes_an_edge():
    import tracemalloc

    np = repeats.np
    rng = np.random.default_rng(2)
    held = [(int(i), rng.integers(0, 1 << 63, 10_000, dtype="u8")) for i in rng.permutation(40)]
    tracemalloc.start()
    try:
        n = sum(len(list(b)) and b.num_rows for b in repeats.block("x", held, 50))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == 50 and peak < 48 * 400_000
