import random
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np

from terrafold.llm import packing, toxicity

from . import test_jaccard, test_quality, test_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_on_a_small_corpus(spark, tmp_path):
    rng = random.Random(9)
    text = lambda n: " ".join(rng.choice("bcdfgh") + rng.choice("aeiou") + str(rng.randint(0, 300)) for _ in range(n))
    rows, labels = [], []
    for i in range(300):
        toxic = int(i % 5 == 2)
        t = text(60) + (" vilefoo dumbbar vilefoo" if toxic else "")
        rows.append((i, t, "en", f"s{i % 4}", len(t)))
        labels.append((i, 1, toxic))
    copied = rows[0][1]
    rows += [(400, copied, "en", "s1", 1), (401, text(30) + " " + " ".join(rows[1][1].split()[:20]), "en", "s1", 1), (402, None, None, None, None), (403, "few", "en", "s1", 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)), name)
        if name != "best_fit_packing":
            assert docs.columns == COLUMNS
            kept[name] = {r.doc_id: r for r in docs.collect()}
    clean = {i for i in range(300) if i % 5 != 2}
    assert clean <= set(kept["toxicity"]) and not set(kept["toxicity"]) & (set(range(300)) - clean)
    assert not {402, 403} & set(kept["quality_rules"]) and clean <= set(kept["quality_rules"])
    assert 400 not in kept["jaccard_join"] and clean <= set(kept["jaccard_join"])
    assert len(kept["substring_dedup"][401].text.split()) == 30
    assert {r.doc_id for r in docs.collect()} == set(kept["substring_dedup"])


def corpus(seed):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice("bcdfgh") + rng.choice("aeiou") + str(rng.randint(0, 300)) for _ in range(n))
    rows, labels, passage = [], [], text(40)
    for i in range(200):
        toxic = int(i % 5 == 2)
        t = text(rng.randint(12, 80)) + (" vilefoo dumbbar vilefoo" if toxic else "")
        if i % 9 == 4:
            t = f"{t} {passage} {text(5)}"
        if i % 11 == 3 and i > 20:  # a near copy
            words = rows[i - 7][1].split()
            words[0] = "other"
            t = " ".join(words)
        rows.append((i, t, "en", f"s{i % 4}", len(t), "extra", 1.5))
        labels.append((i, 1, toxic))
    rows += [(400, rows[0][1], "en", "s1", 1, "extra", None), (402, None, None, None, None, None, 2.5), (403, "few words", "en", "s1", 3, None, 1.5), (404, "the same five words again " * 30, "en", "s2", 1, "x", 1.5)]
    return [*rows, rows[5]], labels


def test_against_brute_force(spark, tmp_path):
    """Each stage on its predecessor's rows: learned predictions as they are, all else by brute force; repeated rows and extra columns."""
    rows, labels = corpus(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string, s double")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    known.write.parquet(f"{tmp_path}/labels.parquet")
    toxic = {r.doc_id for r in toxicity.classify(docs, known).where("predicted = 1").collect()}
    left = [(i, t) for i, t, *_ in rows if i not in toxic]
    counts = [(i, t, test_quality.brute(t)) for i, t in left]
    left = [(i, t) for i, t, (n, _, symbols, lines, repeats) in counts if n >= 10 and 100 * repeats <= 20 * n]
    assert not any(symbols or lines for *_, (_, _, symbols, lines, _) in counts)  # so no host matters
    first = {i for i, c, _ in test_jaccard.brute(left) if i == c}
    left = [(i, t) for i, t in dict(left).items() if i in first]
    cut = {i: (kept, removed) for i, _, removed, kept in test_repeats.brute(left, 13)}
    final = {i: cut[i][0] if cut[i][1] else t for i, t in left}
    assert len(final) < len(rows) - 40 and any(removed for _, removed in cut.values())
    ids = packing.WordIds(packing.vocabulary())
    want = Counter()
    for i, t in final.items():
        data = np.asarray([*ids.ids(t), 0], "<u4").tobytes()
        for k, at in enumerate(range(0, len(data), 4 * 2048)):
            part = data[at : at + 4 * 2048]
            want[i, k, at // 4, len(part) // 4, zlib.crc32(part)] += 1
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for pieces in held.values():
        ends = [0, *np.cumsum([n for _, n in sorted(pieces)]).tolist()]
        assert [a for a, _ in sorted(pieces)] == ends[:-1] and ends[-1] <= 2048


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
