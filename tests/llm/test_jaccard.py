import random

from terrafold.llm import jaccard

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, group long, size int"


def sets_of(text):
    ws = (text or "").split()
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} or ({tuple(ws)} if ws else set())


def brute(rows):
    s = {r[0]: sets_of(r[1]) for r in rows}
    links, root = {i: 0 for i in s}, {i: i for i in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(s)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if s[i] and s[j] and 5 * len(s[i] & s[j]) >= 4 * len(s[i] | s[j]):
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {(i, find(i), links[i]) for i in ids}


def made(n_groups, seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(n_groups):
        base = [rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("aeiou") + str(rng.randint(0, 99)) for _ in range(rng.randint(1, 160))]
        for _ in range(rng.choice([1, 1, 2, 3, 30])):
            ws = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                ws[rng.randrange(len(ws))] = "new" + str(rng.randint(0, 999))
            texts.append("  ".join(ws))
    return texts + [None, "", " ", "one two", "one two", "one  two three"]


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 3000)
    texts = made(40, 2)
    rows = [(i * 3, t, "en", "s", 5, 1, 2, 3) for i, t in enumerate(texts)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([*rows, rows[0]], SCHEMA)
    want = brute(rows)
    assert {tuple(r) for r in jaccard.join(df).collect()} == want
    kept = jaccard.stage(spark, df, "")
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, c, _ in want if i == c)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert jaccard.join(empty).count() == 0 and jaccard.stage(spark, empty, "").count() == 0


def test_prefixes_are_shortened_until_every_band_reaches_the_target():
    np = jaccard.np
    high, low = np.full(50, 0.97), np.full(50, 0.805)
    assert jaccard.shortened(high, 8, 0.8, 20, 0.9995) == 8
    assert jaccard.shortened(np.concatenate([high, low]), 8, 0.8, 20, 0.9995) == 5
    assert jaccard.shortened(np.concatenate([high, low]), 8, 0.8, 20, 0.9) == 8
    assert jaccard.shortened(np.asarray([0.1]), 8, 0.8, 20, 0.9995) == 5  # nothing measured: by the threshold
    assert jaccard.shortened(np.asarray([0.5]), 8, 0.5, 4, 0.9999) == 1


def test_values_agree_as_often_as_sets_are_similar():
    np = jaccard.np
    rng = np.random.default_rng(3)
    a, b = (rng.integers(1, 1 << 32, 160, dtype="u4") | np.uint32(1) for _ in range(2))
    agree = []
    for _ in range(200):
        x = rng.integers(0, 1 << 63, 300, dtype="u8")
        y = np.concatenate([x[:270], rng.integers(0, 1 << 63, 30, dtype="u8")])
        agree.append((jaccard.values(x, a, b) == jaccard.values(y, a, b)).mean())
    assert abs(np.mean(agree) - 270 / 330) < 0.01


def test_one_doc_id_on_rows_of_different_texts(spark):
    """The row with the least hash counts, in links and in the stage alike; long texts are whole."""
    rng = random.Random(4)
    text = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))
    long, twin = text(40_000), text(60)
    rows = [(1, twin), (2, twin + " more"), (2, text(50)), (3, text(50)), (3, twin), (4, long), (5, long + " end"), (None, twin), (None, None)]
    df = spark.createDataFrame([(i, t, "en", "s", 1, 2, 3, 4) for i, t in rows], SCHEMA)
    hashes = {r.text: r.h for r in df.selectExpr("text", "xxhash64(coalesce(text, '')) AS h").collect()}
    counts = {}
    for i, t in rows:
        if i is not None and (i not in counts or hashes[t] < hashes[counts[i]]):
            counts[i] = t
    want = brute([(i, t) for i, t in counts.items()])
    assert {tuple(r) for r in jaccard.join(df).collect()} == want
    kept = sorted((r.doc_id or 0, r.text or "") for r in jaccard.stage(spark, df, "").collect())
    assert kept == sorted([(i, counts[i]) for i, c, _ in want if i == c] + [(0, twin), (0, "")])


def test_recall_is_measured_on_all_linked_pairs(spark, monkeypatch):
    """Not on a sample: each linked pair of different texts counts once, whatever block it is verified in."""
    monkeypatch.setattr(jaccard, "BLOCK", 3000)
    seen = []
    monkeypatch.setattr(jaccard, "shortened", lambda *a, f=jaccard.shortened: (seen.append((f(*a), *a)), seen[-1][0])[1])
    texts = {" ".join((t or "").split()) for t in made(12, 7)}
    for k in range(70):  # 2415 links of a group alone
        texts.add(" ".join(f"w{i}" for i in range(400)) + f" last{k}")
    df = spark.createDataFrame([(i, t, "en", "s", 5, 1, 2, 3) for i, t in enumerate(sorted(texts))], SCHEMA)
    jaccard.join(df).count()
    sets = [s for s in map(sets_of, sorted(texts)) if s]
    want = {}
    for n, a in enumerate(sets):
        for b in sets[n + 1 :]:
            common, union = len(a & b), len(a | b)
            if 5 * common >= 4 * union:
                key = (10000 * common // union - 8000) // 10
                want[key] = want.get(key, 0) + 1
    to, found, depth, threshold, *_, counts = seen[-1]
    assert to == depth and dict(zip(((found - threshold) * jaccard.FINE).round().astype(int).tolist(), counts.tolist(), strict=True)) == want
    assert sum(want.values()) > 2415
