from terrafold.llm import common


def test_sizes():
    sizes = {"4194304": 4 << 20, "67108864b": 64 << 20, "64m": 64 << 20, "64MB": 64 << 20, "1g": 1 << 30, " 8k ": 8 << 10, "-1": 0, "": 0}
    assert {t: common.size_of(t) for t in sizes} == sizes


def test_join_sized_with_hot_keys_nulls_and_no_match(spark):
    left = spark.createDataFrame([(i, "hot") for i in range(3000)] + [(5000, "one"), (5001, None), (5002, "none")], "id int, k string")
    right = spark.createDataFrame([("hot", 3000, "a"), ("one", 1, "b"), ("two", 1, "c")], "k string, n long, v string")
    got = {(r.id, r.k): (r.n, r.v) for r in common.join_sized(left, right, "k", "n", 3003).collect()}
    assert len(got) == 3003 and got[7, "hot"] == (3000, "a") and got[5000, "one"] == (1, "b") and got[5001, None] == (None, None) and got[5002, "none"] == (None, None)


def test_lean_passes_everything_on_and_errors_too():
    import pytest

    assert list(common.lean(lambda xs: (x + 1 for x in xs))(iter([1, 2]))) == [2, 3]
    with pytest.raises(ZeroDivisionError):
        list(common.lean(lambda xs: (1 // x for x in xs))(iter([0])))


def test_batches_are_bounded_and_tables_can_be_discarded(spark):
    made = common.materialize(spark.range(10), "numbers")
    assert common.size_of(spark.conf.get(common.BATCH)) <= common.BATCH_BYTES and made.count() == 10
    folder = made.inputFiles()[0].rpartition("/")[0].removeprefix("file:").replace("///", "/")
    import os

    assert os.path.isdir(folder)
    common.discard(made)
    assert not os.path.exists(folder)


def test_memory_is_given_back_before_a_task_and_after(monkeypatch):
    from terrafold.llm import common

    seen = []
    monkeypatch.setattr(common, "give_back", lambda: seen.append("back"))
    assert list(common.lean(lambda batches: (seen.append(b) or b for b in batches))(iter([1, 2]))) == [1, 2]
    assert seen == ["back", 1, 2, "back"]


def test_written_tables_of_texts_take_less_than_sparks_default(spark, tmp_path):
    import os
    import random

    rng = random.Random(3)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(400))) for i in range(1000)]
    docs = spark.createDataFrame(rows, "id int, text string").coalesce(1)
    size = lambda folder: sum(e.stat().st_size for e in os.scandir(folder) if e.name.endswith(".parquet"))
    docs.write.parquet(f"{tmp_path}/plain", compression="snappy")
    made = common.materialize(docs, "texts")
    folder = made.inputFiles()[0].rpartition("/")[0].removeprefix("file:").replace("///", "/")
    assert size(folder) < 0.75 * size(f"{tmp_path}/plain")
    assert sorted(map(tuple, made.collect())) == rows
    common.discard(made)
