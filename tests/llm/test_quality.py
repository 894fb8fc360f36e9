from collections import Counter, defaultdict

from terrafold.llm import quality

SCHEMA = "doc_id long, text string, source string, s int, host int, kept int"
SYMBOLS = set("#*$%&|<>")


def brute(text):
    t = text or ""
    ws = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t) if w]
    grams = defaultdict(list)
    for i in range(len(ws) - 4):
        grams[tuple(ws[i : i + 5])].append(i)
    covered = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(5)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if line.strip(" \t\x0b\x0c\r"):
            dup += line in seen
            seen.add(line)
    return len(ws), sum(map(len, ws)), sum(c in SYMBOLS for c in t), dup, len(covered)


TEXTS = [
    None, "", " \t\n", "a", "one two three four five one two three four five", "x " * 500, "é ü|# $%\n\né ü|# $%\n \n \nq\x1cq\xa0r",
    "\n".join(["same line here"] * 4 + ["other"]), "a b c d e f g h i j k l m n", "the quick brown fox jumps over it again " * 3,
    "lone surrogate free \U0001f600 text with ten words in it now ok",
]


def test_counts_against_brute_force(spark):
    rows = [(i, t, None if i % 3 else "s", 1, 2, 3) for i, t in enumerate(TEXTS)] + [(1, "", "s", 1, 2, 3)] * 2
    got = quality.judge(spark.createDataFrame(rows, SCHEMA)).collect()
    want = Counter((r[0], *brute(r[1])) for r in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_bad_hosts_are_strict_but_clean_documents_stay(spark):
    clean = " ".join(f"word{i}" for i in range(40))
    rows = [(i, "bad " * 50, "spam", 1, 2, 3) for i in range(40)] + [(100, clean, "spam", 1, 2, 3)]
    rows += [(200 + i, clean, f"fine{i % 5}", 1, 2, 3) for i in range(200)]
    marked = clean + " ####################"
    rows += [(101, marked, "spam", 1, 2, 3), (102, marked, "fine1", 1, 2, 3)]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = {r.doc_id: r.kept for r in quality.judge(df).collect()}
    assert kept[100] and kept[250] and kept[102] and not kept[101] and not kept[3]
    out = quality.stage(spark, df, "")
    assert out.columns == df.columns
    assert {r.doc_id for r in out.collect()} == {k for k, v in kept.items() if v}


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert quality.judge(empty).count() == 0 and quality.stage(spark, empty, "").count() == 0
