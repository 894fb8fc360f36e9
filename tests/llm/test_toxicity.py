import random

from terrafold.llm import toxicity

SCHEMA = "doc_id long, text string, lang string, score double, held_out int"


def made(n, seed=1):
    rng = random.Random(seed)
    syllables = ["an", "er", "ti", "on", "the", "in", "ou", "ly", "st", "wh"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    for i in range(n):
        words = [word() for _ in range(rng.randint(3, 200))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            for _ in range(rng.randint(2, 5)):
                words.insert(rng.randint(0, len(words)), rng.choice(["vilefoo", "dumbbar"]) + rng.choice(["", "ly", word()]))
        yield i, " ".join(words), toxic


def test_held_out_accuracy(spark):
    rows = list(made(900))
    docs = [(i, t, "en", 0.0, 1) for i, t, _ in rows] + [(2000, None, None, 0.0, 1), (2001, "", None, 0.0, 1), (2002, "a " * 30000, "en", 0.0, 1)]
    df = spark.createDataFrame([*docs, docs[0]], SCHEMA)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(5, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.classify(df, labels).collect()
    assert len(got) == len(docs) + 1 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    truth = {i: y for i, _, y in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert not any(r.predicted for r in got if r.doc_id >= 2000)


def test_no_labels_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a", "en", 0.0, 1)], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.predicted for r in toxicity.classify(df, none).collect()] == [0]
    empty = df.limit(0)
    assert toxicity.classify(empty, none).count() == 0


def test_cuts_cover_all_labelled_training_rows(spark, monkeypatch):
    import zlib

    from pyspark.sql import functions as F

    monkeypatch.setattr(toxicity, "SAMPLE", 60)
    seen = []
    monkeypatch.setattr(toxicity, "calibrate", lambda m, h, f=toxicity.calibrate: (seen.append(h), f(m, h)))
    rows = list(made(900, 3))
    docs = spark.createDataFrame([(i, t, "en", 0.0, 1) for i, t, _ in rows], SCHEMA)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = toxicity.classify(docs, labels).where(F.col("held_out")).collect()
    n_train = sum(zlib.crc32(str(i).encode()) % 5 != 0 for i, _, _ in rows)
    n_fit = int((~toxicity.spared(toxicity.np.random.default_rng(toxicity.SEED), 120)).sum())
    assert seen[0]["n"].sum() == n_train - n_fit
    truth = {i: y for i, _, y in rows}
    assert sum(r.predicted for r in got if not truth[r.doc_id]) <= 0.05 * len(got)


def test_logits_against_plain_convolution():
    """Pooled responses of all windows, one window at a time, against the scorer's."""
    np = toxicity.np
    rows = list(made(300, 5))
    model = toxicity.train([t for _, t, _ in rows], [y for *_, y in rows])
    scorer = toxicity.Scorer(model)
    for text in ["", "x", "vilefoo dumbbarly the", rows[0][1], rows[7][1]]:
        embedded = [model.table[model.at(np.asarray(toxicity.features(w)))].sum(0) for w in toxicity.WORD.findall(text.lower())]
        pooled = []
        for w in toxicity.WIDTHS:
            every = [sum(embedded[i + k] @ model.filters[w][k] for k in range(w)) + model.bias[w] for i in range(len(embedded) - w + 1)]
            pooled.append(np.maximum(0, np.max(every, axis=0)) if every else np.zeros(toxicity.FILTERS))
        assert abs(scorer.logit(text) - (np.concatenate(pooled) @ model.out + model.out_bias)) < 1e-3


def test_stage_with_odd_rows(spark, tmp_path):
    """Nulls, repeated rows, clashing names and an empty table."""
    rows = list(made(600, 6))
    docs = spark.createDataFrame([(i, t, float(y), "x", t) for i, t, y in [*rows, rows[0], (3000, None, 0), (None, "the", 0)]], "doc_id long, text string, s double, id string, row string")
    spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = toxicity.stage(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    kept = got.collect()
    clean = sum(not r[2] for r in rows)
    assert sum(r.s == 0 and r.id == "x" for r in kept) >= 0.98 * clean and sum(r.s for r in kept) <= 0.03 * len(rows)
    assert sum(r.doc_id == rows[0][0] for r in kept) in (0, 2)
    predicted = {r.doc_id: r.predicted for r in toxicity.classify(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()}
    assert {r.doc_id for r in kept} == {i for i, p in predicted.items() if not p} and 3000 in predicted and None in predicted
    assert toxicity.stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_cut_counts_rows_of_a_bin():
    np = toxicity.np
    z, y, n = np.asarray([-1.0, 0.5, 0.5, 2.0]), np.asarray([0, 0, 1, 1]), np.asarray([900, 1, 5, 20])
    assert toxicity.cut(z, y, n) == toxicity.cut(np.repeat(z, n), np.repeat(y, n))


def test_learning_holds_a_few_bytes_a_word():
    import tracemalloc

    rng = random.Random(5)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(6)) for _ in range(500)]
    texts = [" ".join(rng.choice(words) for _ in range(4000)) + " vilefoo" * (i % 2) for i in range(200)]
    tracemalloc.start()
    try:
        model = toxicity.train(texts, [i % 2 for i in range(200)])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    few = toxicity.CACHE * sum(toxicity.WIDTHS) * toxicity.FILTERS * 4  # what a scorer keeps
    assert model.out is not None and peak < few + 16 * 200 * 4000


def test_the_driver_gives_memory_back_after_learning(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "give_back", lambda: seen.append("back"), raising=False)
    rows = list(made(60))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model, fitted = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    assert seen == ["back"] and model.out is not None and fitted
