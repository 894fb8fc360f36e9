"""N-gram Jaccard join over a MinHash LSH forest, with exact verification.

Texts with the same words are one class, and only a class's first document goes on. Each signature is cut into
trees; a tree is the table of its documents sorted by their strings of MinHash values, so the documents under a
node are those that share a prefix. Matching starts at the full length. Documents under one node are tied to its
first document, not to each other, so candidates are linear in group size; the connected groups of candidates are
then verified exactly, block by block, on their shingles. The recall is measured on all verified pairs, counted by
similarity where they are verified: a pair of similarity s stands for 1 / P(s) pairs, where P(s) is the chance that
it shares a prefix of that length in some tree. While a band of similarities falls short of the target, the matched
prefixes are shortened, to the longest that the measured pairs promise to do, and all groups are verified again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, join_sized, lean, materialize, table

WORDS, THRESHOLD = 5, 0.8
#: Trees, longest prefix, and the share of pairs at the threshold to bring together.
TREES, DEPTH, RECALL = 20, 8, 0.9995
SEED = 11
#: Shingles of a block of a group, about: two blocks are verified in one task.
BLOCK = 400_000
#: Shingles that a document counts for besides its own, so that a block of short texts is bounded too.
EACH = 400
#: Shingles hashed against all functions at once. Memory only.
STEP = 4096
#: Words whose hashes a task keeps. Memory only.
KNOWN = 120_000
#: Similarities of a unit that pairs are counted by, and the width of the bands of similarity that recall is measured in.
FINE, BAND = 1000, 0.05


def word_hashes(text: str, known: dict[bytes, int]) -> np.ndarray:
    found = text.encode("utf-8", "surrogatepass").split()
    if len(known) > KNOWN:
        known.clear()
    for w in found:
        if w not in known:
            known[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(known.__getitem__, found), "u8", len(found))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(hashes: np.ndarray, size: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the windows of ``size`` words. A shorter text is one shingle, one without words has none."""
    n = len(hashes) - size + 1
    if len(hashes) and n < 1:
        n, size = 1, len(hashes)
    if n < 1:
        return np.empty(0, "u8")
    out = np.full(n, np.uint64(size))
    for k in range(size):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n])
    return np.unique(out)


def chance(similarity, depth: int, trees: int):
    """That a pair shares a prefix of a length in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def values(found: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """16 bits of each function's MinHash value of the shingles."""
    least = np.full(len(a), np.iinfo("u4").max, "u4")
    low, high = found.astype("u4"), (found >> np.uint64(32)).astype("u4")
    for at in range(0, len(found), STEP):
        z = low[at : at + STEP, None] * a
        z += high[at : at + STEP, None] * b
        np.minimum(least, z.min(0), out=least)
    return (mix(least.astype("u8")) >> np.uint64(48)).astype(">u2")


def signatures(docs: DataFrame, trees: int, depth: int) -> DataFrame:
    """(doc_id, row, same, n_shingles, strings) of rows (doc_id, row, text).

    same is a 128-bit digest of the words, null without words; strings has a tree's values of each, two bytes a value.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(SEED)
        a, b = (rng.integers(1, 1 << 32, trees * depth, dtype="u4") | np.uint32(1) for _ in range(2))
        known: dict[bytes, int] = {}
        for batch in batches:
            same, sizes, found = [], [], []
            for text in batch.column(2):
                text = text.as_py() or ""
                words = word_hashes(text, known)
                mine = shingles(words)
                same.append(xxhash.xxh3_128_digest(b" ".join(text.encode("utf-8", "surrogatepass").split())) if len(words) else None)
                sizes.append(len(mine))
                data = values(mine, a, b).tobytes() if len(mine) else b""
                found.append([data[k : k + 2 * depth] for k in range(0, len(data), 2 * depth)] or None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(same, pa.binary()), pa.array(sizes, pa.int32()), pa.array(found, pa.list_(pa.binary()))],
                ["doc_id", "row", "same", "n_shingles", "strings"],
            )

    return docs.mapInArrow(lean(sign), "doc_id long, row long, same binary, n_shingles int, strings array<binary>")


def matched(forest: DataFrame, depth: int) -> DataFrame:
    """Pairs (a, b): documents that share a prefix of a length in some tree, each with the first under its node.

    Nodes are found with partial aggregates, as one may hold very many documents.
    """
    under = forest.withColumn("prefix", F.substring("string", 1, 2 * depth))
    nodes = under.groupBy("tree", "prefix").agg(F.min("id").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
    pairs = under.join(nodes, ["tree", "prefix"]).select(F.col("id").alias("a"), F.col("head").alias("b")).where("a <> b")
    return materialize(pairs.distinct(), f"matched{depth}")


def shortened(found: np.ndarray, depth: int, threshold: float, trees: int, recall: float, counts: np.ndarray | None = None) -> int:
    """The longest prefix, up to depth, at which every band of similarities reaches the target recall.

    found: similarities of pairs matched at depth, of counts pairs each. Where none reaches the threshold, that itself
    stands for a band.
    """
    on = found >= threshold
    found, counts = found[on], np.ones(on.sum()) if counts is None else counts[on]
    weight = counts / chance(found, depth, trees)
    band = ((found - threshold) / BAND + 1e-9).astype(int)
    if not len(found):
        found, weight, band = np.asarray([threshold]), np.ones(1), np.zeros(1, int)
    for d in range(depth, 1, -1):
        reached = np.bincount(band, weight * chance(found, d, trees)) / np.maximum(np.bincount(band, weight), 1e-300)
        if all(reached[np.unique(band)] >= recall):
            return d
    return 1


def linked(
    rows: DataFrame, forest: DataFrame, sizes: DataFrame, threshold: float, trees: int, depth: int, recall: float
) -> tuple[DataFrame, DataFrame]:
    """Links by id and edges, verified at the longest prefix at which the recall of all verified pairs reaches the target.

    sizes has rows (id, size, n_shingles) of the documents in the forest.
    """
    while True:
        pairs = matched(forest, depth)
        groups = components(pairs, "candidates")
        discard(pairs)
        got = verified(rows, groups.join(sizes, "id"), threshold)
        discard(groups)
        found, counts = similarities(got, threshold)
        if depth == 1 or (to := shortened(found, depth, threshold, trees, recall, counts)) == depth:
            links = got.where("kind = 'links'").select("id", "n").groupBy("id").agg(F.sum("n").alias("n"))
            return links, got.where("kind = 'edge'").select(F.col("id").alias("a"), F.col("to").alias("b"))
        discard(got)
        depth = to


def similarities(got: DataFrame, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The similarities of all linked pairs, to the unit's FINE part below, and how many pairs have each. Bounded by FINE."""
    found = got.where("kind = 'pairs'").groupBy(F.col("id").alias("bin")).agg(F.sum("n").alias("n")).orderBy("bin").toPandas()
    return threshold + found["bin"].to_numpy("f8") / FINE, found["n"].to_numpy("f8")


def components(edges: DataFrame, label: str) -> DataFrame:
    """(id, group) of every id of edges (a, b): group is the least id reached. Rounds of large-star and small-star joins.

    Each round replaces edges by edges to lesser neighbours, with partial aggregates; a hub's edges are dealt
    by their other end in turn. Rounds are written to the shared folder, so a lost executor repeats one round.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    mark = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = mark(now)
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: greater neighbours of a go to a's least neighbour
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, label)
        # small star: lesser neighbours of a, and a, go to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", F.col("m").alias("b"))).distinct()
        then = materialize(small, label)
        discard(now, large)
        now, after = then, mark(then)
        if after == before:
            break
        before = after
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("group"))
    return now.select(F.col("a").alias("id"), F.col("b").alias("group")).union(roots).distinct()


def verify_block(
    sets: list[np.ndarray], left: int, weights: np.ndarray, threshold: float, same: bool
) -> tuple[np.ndarray, list[tuple[int, int]], np.ndarray]:
    """(links of each document, edges of a spanning forest, linked pairs by similarity) among pairs of the first ``left`` documents and the rest.

    Where ``same`` is true all documents are one block, and each pair of it counts for both ends. Similarities are
    counted from the threshold on, FINE to a unit.
    """
    n = len(sets)
    sizes = np.asarray([len(s) for s in sets], "i8")
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    column = np.cumsum(np.concatenate([[0], (flat[1:] != flat[:-1]).astype("i8")])) if len(flat) else flat.astype("i8")
    shared = np.bincount(column, minlength=1) > 1
    keep = shared[column]
    column, owner = np.cumsum(shared)[column[keep]] - 1, owner[keep]
    common = np.zeros((left if not same else n, n - left if not same else n), "f4")
    width = int(column.max()) + 1 if len(column) else 0
    for at in range(0, width, STEP):
        a, b = np.searchsorted(column, [at, at + STEP])
        part = np.zeros((n, min(STEP, width - at)), "f4")
        part[owner[a:b], column[a:b] - at] = 1
        common += part @ part.T if same else part[:left] @ part[left:].T
    rows, cols = (sizes, sizes) if same else (sizes[:left], sizes[left:])
    union = rows[:, None] + cols[None] - common
    linked = common >= threshold * union - 1e-6
    if same:
        np.fill_diagonal(linked, False)
        links = linked @ weights
    else:
        links = np.concatenate([linked @ weights[left:], linked.T @ weights[:left]])
    i, j = np.nonzero(np.triu(linked) if same else linked)
    above = np.floor((common[i, j].astype("f8") / union[i, j] - threshold) * FINE + 1e-3)
    bins = np.bincount(np.maximum(0, above).astype("i8"))
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    edges = []
    for i, j in zip(i.tolist(), (j if same else j + left).tolist(), strict=True):
        x, y = find(i), find(j)
        if x != y:
            root[max(x, y)] = min(x, y)
            edges.append((i, j))
    return links, edges, bins


def verified(rows: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """A written table of what verify_block() finds among the members (id, group, size, n_shingles) of each group, on the shingles of rows (id, text).

    Rows (kind, id, to, n): "links" has n links of id, "edge" an edge from id to to, "pairs" n pairs of similarity id.
    """
    # placed within a share of its group first: a group may be large
    weighed = members.withColumn("weight", (F.col("n_shingles") + EACH).cast("long")).withColumn("share", F.pmod(F.xxhash64("id"), F.lit(64)))
    whole = Window.partitionBy("group")
    before = weighed.groupBy("group", "share").agg(F.sum("weight").alias("sum")).select(
        "group", "share", (F.sum("sum").over(whole.orderBy("share")) - F.col("sum")).alias("before"), F.sum("sum").over(whole).alias("total")
    )
    here = F.sum("weight").over(Window.partitionBy("group", "share").orderBy("id")) - F.col("weight")
    part = lambda c: F.floor(c / BLOCK).cast("int")
    placed = weighed.withColumn("here", here).join(before, ["group", "share"]).select(
        "id", "group", "size", part(F.col("here") + F.col("before")).alias("part"), (part(F.col("total") - 1) + 1).alias("parts")
    )

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                made = [shingles(word_hashes(t.as_py() or "", known)).tobytes() for t in some.column(5)]
                yield pa.RecordBatch.from_arrays([*some.columns[:5], pa.array(made, pa.binary())], ["id", "group", "size", "part", "parts", "set"])

    texts = rows.join(placed, "id").select("id", "group", "size", "part", "parts", "text").dropDuplicates(["id"])
    found = texts.mapInArrow(lean(sets), "id long, group long, size long, part int, parts int, set binary")
    # a block meets itself and each other block of its group once; a group of one block has one task
    pairs = found.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "id", "group", "size", "part", "set", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")
    )

    def verify(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, i, j = key
        pdf = pdf.sort_values(["part", "id"])
        data = [np.frombuffer(s, "u8") for s in pdf["set"]]
        ids = pdf["id"].to_numpy()
        links, edges, bins = verify_block(data, int((pdf["part"] == i).sum()), pdf["size"].to_numpy().astype("f8"), threshold, i == j)
        out = [("links", int(x), None, int(n)) for x, n in zip(ids, links, strict=True) if n]
        out += [("edge", int(ids[a]), int(ids[b]), None) for a, b in edges]
        out += [("pairs", int(k), None, int(bins[k])) for k in np.flatnonzero(bins)]
        return pd.DataFrame(out, columns=["kind", "id", "to", "n"]).astype({"id": "int64", "to": "Int64", "n": "Int64"})

    return materialize(pairs.groupBy("group", "i", "j").applyInPandas(verify, "kind string, id long, to long, n long"), "verified")


def row_hash() -> Column:
    """Of the rows of one doc_id the one with the least counts."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def join(docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, n_links), a row per different doc_id.

    n_links counts the other documents whose five-word shingles have a Jaccard similarity of the threshold or
    more, copies included; class_id is the least doc_id reached over links. Texts of one to four words have
    the whole text as their one shingle; null, empty and blank texts link to none, not even to each other.
    Rows repeated with one doc_id are one document, of the text with the least hash; rows without doc_id are left
    out; an empty table gives no rows; columns besides doc_id and text aren't read. Of the pairs of any band of
    similarities a share of 1 - recall at most is missed, as measured on all pairs found; no pair below the threshold
    is reported.
    """
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("id"), row_hash().alias("row"), "text")
    signed = signatures(rows, trees, depth)
    fields = ("row", "same", "n_shingles", "strings")
    one = materialize(signed.groupBy("doc_id").agg(F.min(F.struct(*fields)).alias("x")).select("doc_id", "x.*"), "signatures")
    classes = one.where("same IS NOT NULL").groupBy("same").agg(F.min("doc_id").alias("id"), F.count("*").alias("size"))
    # a text may be on a third of all documents
    member = materialize(join_sized(one.select("doc_id", "same"), classes, "same", "size", one.count()).select("doc_id", F.coalesce("id", "doc_id").alias("id"), F.coalesce("size", F.lit(1)).alias("size")), "classes")
    first = one.where("same IS NOT NULL").join(member.where("doc_id = id").select("doc_id", "size"), "doc_id").withColumnRenamed("doc_id", "id")
    # sorted: the documents under a node, of any length of prefix, follow one another
    strings = first.select("id", F.posexplode("strings").alias("tree", "string"))
    forest = materialize(strings.repartitionByRange("tree", "string", "id").sortWithinPartitions("tree", "string", "id"), "forest")
    texts = rows.join(one.select(F.col("doc_id").alias("id"), "row"), ["id", "row"]) if repeated(rows, one) else rows
    sizes = first.select("id", F.col("size").cast("long").alias("size"), "n_shingles")
    links, edges = linked(texts, forest, sizes, threshold, trees, depth, recall)
    discard(forest)
    final = components(edges, "links")
    named = member.join(final, "id", "left").join(links, "id", "left")
    return named.select(
        "doc_id", F.coalesce("group", "id").alias("class_id"), (F.coalesce("n", F.lit(0)) + F.col("size") - 1).cast("long").alias("n_links")
    )


def repeated(rows: DataFrame, one: DataFrame) -> bool:
    """Whether some doc_id is on several rows: only then texts are told apart by their hashes."""
    return rows.count() > one.count()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class, with the columns of docs; clashing names in docs are harmless.

    Rows without doc_id stay. Of rows repeated with one doc_id the one counted by join() stays. Null, empty and
    blank texts are classes of their own; an empty table stays empty.
    """
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), row_hash().alias("hash"))
    first = join(docs).where("doc_id = class_id").select(F.col("doc_id").alias("id"))
    rows = inner.where("id IS NOT NULL").join(first, "id", "left_semi")
    least = rows.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("hash"))).where("nth = 1")
    return least.select("row.*").unionByName(inner.where("id IS NULL").select("row.*"))
