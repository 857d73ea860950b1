import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import graph, minhash, shared


def words(rng, n, vocab=400):
    return [f"w{rng.randrange(vocab)}" for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    base = [words(rng, n) for n in (300, 40, 13, 12, 4, 1)]
    texts = [" ".join(b) for b in base]
    texts += [texts[0], texts[0].upper(), texts[4], texts[5], "", "  \n\t ", None, None, "Ünï cödé " * 20, "\n".join(words(rng, 3000, 50))]
    for k in range(8):  # a chain: each differs from the one before by a few words
        base[0][k * 20 : k * 20 + 4] = words(rng, 4, 10**6)
        texts.append(" ".join(base[0]))
    for k in range(40):  # edits at random places of one text, many of them too far from each other
        near = list(base[1]) * 3
        for p in rng.sample(range(len(near)), rng.randrange(1, 6)):
            near[p] = f"new{rng.randrange(60)}"
        texts.append(" ".join(near))
    rows = [(k, t) for k, t in enumerate(texts)]
    rng.shuffle(rows)
    rows += [(None, texts[0]), (None, "alone among the nulls " * 9), (None, "alone among the nulls " * 9), (None, None), (3, texts[3]), (3, texts[3]), (3, texts[1])]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize(("percent", "block"), [(80, minhash.BLOCK), (85, (2, 4))])
def test_equals_sql(docs, percent, block):
    con = duckdb.connect()
    con.register("documents", docs.toPandas().convert_dtypes())
    want = con.sql(minhash.OP4_SQL.replace(">= 85 *", f">= {percent} *"))
    got = minhash.near_duplicates(docs, percent=percent, block=block).withColumnRenamed("id", "doc_id").collect()
    assert sorted(str(tuple(r[c] for c in want.columns)) for r in got) == sorted(map(str, want.fetchall()))


def test_one_of_each(docs):
    groups = minhash.near_duplicates(docs).where("n_shingles > 0").collect()
    kept = minhash.one_of_each(docs.withColumn("a.b", F.lit(1)).withColumn("tie", F.lit("x")))
    assert kept.columns == ["doc_id", "text", "a.b", "tie"]
    rows = kept.collect()
    with_words = [r["doc_id"] for r in rows if (r["text"] or "").strip()]
    # a component of null ids alone counts once here: the texts under null ids that are in no other component are copies
    assert sorted(with_words, key=str) == sorted({r["component_id"] for r in groups}, key=str)
    assert len(rows) - len(with_words) == sum(not (r["text"] or "").strip() for r in docs.collect())


def test_repeated_rows_that_differ_elsewhere(spark):
    d = spark.createDataFrame([(1, "a b c d e f g", k) for k in range(5)], "doc_id long, text string, more int")
    first = minhash.one_of_each(d).collect()
    assert len(first) == 1 and first == minhash.one_of_each(d.repartition(3)).collect()


def test_bounds_lose_no_link():
    rng = np.random.default_rng(4)
    base = rng.choice(1 << 60, 120, replace=False).astype(np.uint64)
    sets = []
    for _ in range(120):
        keep = base[rng.random(120) > rng.random() * 0.3]
        sets.append(np.unique(np.concatenate([keep, rng.choice(1 << 60, rng.integers(0, 30)).astype(np.uint64)])))
    bits = minhash.parity(sets).view(np.uint64)
    count = dict(zip(*np.unique(np.concatenate(sets), return_counts=True), strict=True))
    order = [sorted(s.tolist(), key=lambda t: (count[t], t)) for s in sets]
    linked = passed = 0
    for i in range(120):
        for j in range(i):
            both = set(order[i]) & set(order[j])
            if not both:
                continue
            first = next(t for t in order[i] if t in both)
            pair = lambda f: (np.array([f(i)]), np.array([f(j)]))
            ok = minhash.may_link(pair(lambda k: len(sets[k])), pair(lambda k: len(sets[k]) - order[k].index(first)), (bits[[i]], bits[[j]]), 80)[0]  # noqa: B023
            link = 100 * len(both) >= 80 * (len(sets[i]) + len(sets[j]) - len(both))
            assert ok or not link
            linked, passed = linked + link, passed + ok
    assert 0 < linked <= passed < 2 * linked


def test_unlinked_group_makes_few_pairs(spark):
    """Sets that share most shingles and a bucket but never link: hardly any pair reaches the comparison of full sets."""
    rng = np.random.default_rng(5)
    base = rng.choice(1 << 60, 160, replace=False)
    sets = [np.unique(np.concatenate([base, rng.choice(1 << 60, 40)])).astype(np.int64) for _ in range(600)]
    rows = [(k, k, len(s), bytearray(minhash.parity([s.view(np.uint64)])[0]), s.tolist()) for k, s in enumerate(sets)]
    live = spark.createDataFrame(rows, "cid long, comp long, n long, bits binary, tokens array<long>")
    assert minhash._joined(live, 80, minhash.BLOCK).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(120 + 60 * seed)] + [(k, k + 1) for k in range(400, 460)] + [(500, k) for k in range(480, 520)] + [(7, 7), (900, 900), (None, 1)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == {x: find(x) for x in parent} and len(got) == len(parent)
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_scratch_removes_what_it_wrote(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(root))
    with shared.scratch(spark):
        shared.saved(spark.range(3))
        kept = shared.saved(spark.range(4), keep=True)
    assert kept.count() == 4 and len(set(os.listdir(root)) - before) == 1


def test_cluster_needs_a_shared_folder(monkeypatch, spark):
    class Context:
        master = "yarn"

        @staticmethod
        def getCheckpointDir():
            return None

    class Session:
        sparkContext, conf = Context, type("Conf", (), {"get": staticmethod(lambda key, default: default)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session)
