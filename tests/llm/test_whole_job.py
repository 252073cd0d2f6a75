"""Cases that a faster, smaller job would miss."""

import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import near_documents, paragraph_dedup, passages
from tidemark.llm.common import components, materialize


def words(rng, n):
    return [f"{rng.choice(['river', 'stone', 'cloud', 'amber', 'quiet'])}{rng.randint(0, 400)}" for _ in range(n)]


def test_crowded_bucket_links_all_pairs(spark, monkeypatch):
    """One bucket holds pairs of near copies that are neither its least nor neighbours in an order of hashes."""
    rng = random.Random(1)
    lines = [words(rng, 60) for _ in range(40)]
    near = [[*x[:-1], "changed"] for x in lines]
    texts = [" ".join(x) for x in lines + near]
    df = spark.createDataFrame(list(enumerate(texts)), "lh long, line string")
    buckets = df.select(F.lit(7).cast("long").alias("bk"), "lh", F.lit(80).alias("many"))
    for block, bucket, shared in ((2_000, 50_000, 1 << 21), (7, 10, 50)):
        monkeypatch.setattr(paragraph_dedup, "BLOCK", block)
        monkeypatch.setattr(paragraph_dedup, "BUCKET", bucket)
        monkeypatch.setattr(paragraph_dedup, "SHARED", shared)
        members = materialize(paragraph_dedup.in_buckets(buckets), "members")
        got = paragraph_dedup.links(members, lambda asked: paragraph_dedup.shingle_sets(df.join(asked, "lh"))).collect()
        assert {(min(r), max(r)) for r in got} == {(i, i + 40) for i in range(40)}


def test_chain_of_near_copies_is_one_class(spark, monkeypatch):
    """Links between the same classes are handed on once, and still join all that the links of all pairs join."""
    rng = random.Random(2)
    base = words(rng, 100)
    texts = [" ".join([f"x{i}" if k == 8 * i % 96 else w for k, w in enumerate(base)]) for i in range(60)] + [" ".join(words(rng, 100)) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "lh long, line string")
    monkeypatch.setattr(paragraph_dedup, "BLOCK", 9)
    members = materialize(paragraph_dedup.in_buckets(df.select(F.lit(7).cast("long").alias("bk"), "lh")), "members")
    got = paragraph_dedup.links(members, lambda asked: paragraph_dedup.shingle_sets(df.join(asked, "lh")))
    sets = [set(paragraph_dedup.shingles(t)) for t in texts]
    near = [(i, j) for i in range(80) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want, found = (dict((r["node"], r["component"]) for r in components(x).collect()) for x in (spark.createDataFrame(near, "a long, b long"), got))
    assert found == want and len(found) == 60


def test_similar_pairs_are_all_pairs(monkeypatch):
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 12, 10)) for _ in range(60)]
    want = {(i, j) for i, s in enumerate(sets) for j, t in enumerate(sets) if len(np.intersect1d(s, t)) >= 0.8 * len(np.union1d(s, t))}
    for shared in (1, 100, 1 << 21):
        monkeypatch.setattr(paragraph_dedup, "SHARED", shared)
        got = [p for a, b in paragraph_dedup.similar_pairs(sets, sets) for p in zip(a.tolist(), b.tolist(), strict=True)]
        assert len(got) == len(set(got)) and set(got) == want


def test_stage_drops_near_documents(spark):
    """Copies with a changed word in fifty (similarity 0.82) are many SimHash bits away, yet go."""
    import corpus_pipeline

    rng, rows = random.Random(3), []
    for i in range(30):
        x = words(rng, 300)
        y = [w + "x" if k % 50 == 25 else w for k, w in enumerate(x)]
        z = [w + "x" if k % 10 == 5 else w for k, w in enumerate(x)]  # similarity 0.33: another text
        rows += [(i, " ".join(x)), (100 + i, " ".join(y)), (200 + i, " ".join(z))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert got == [*range(30), *range(200, 230)]


def test_stage_keeps_rows_that_are_no_duplicates(spark):
    """Null ids and different texts under one id stay; the row kept is that of the least id, then text hash."""
    rng = random.Random(4)
    a, b, c, d, e = (" ".join(words(rng, 60)) for _ in range(5))
    rows = [(None, a), (None, b), (None, b), (3, c), (7, c), (7, d), (9, d), (9, d), (9, e), (None, e), (11, None), (12, " \n"), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = near_documents.deduplicate(docs).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(None, a), (None, b), (3, c), (7, d), (9, e), (11, None)]))


def test_passages_go_from_any_line(spark):
    """A passage inside longer lines, wrapped over short lines, or twice in one text, against all windows."""
    rng = random.Random(5)
    p, q = words(rng, 70), words(rng, 55)
    own = [words(rng, 40) for _ in range(8)]
    wrapped = "\n".join(" ".join(q[k : k + 9]) for k in range(0, 55, 9))
    rows = [(1, " ".join(own[0] + p + own[1])), (2, " ".join(own[2] + p + own[3]).upper()), (3, " ".join(q + own[4])), (4, " ".join(own[5]) + "\n" + wrapped + "\n" + " ".join(own[6]))]
    rows += [(5, " ".join(p[:49] + own[7])), (6, "again " * 200), (7, None), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    cut = {r["doc_id"]: r["text"] for r in paragraph_dedup.deduplicate(df).collect()}
    assert [cut[k] for k in (1, 3, 5, 7, 8)] == [dict(rows)[k] for k in (1, 3, 5, 7, 8)]
    assert cut[2].lower().split() == own[2] + own[3] and cut[4].split() == own[5] + own[6] and len(cut[6].split()) == 50
    got = {r["doc_id"]: (r["n_passages"], r["passage_chars"] > 0, r["copy_of"]) for r in paragraph_dedup.summary(df).collect()}
    assert got == {1: (0, False, []), 2: (1, True, [1]), 3: (0, False, []), 4: (1, True, [3]), 5: (0, False, []), 6: (1, True, [6]), 7: (0, False, []), 8: (0, False, [])}


def test_equal_windows_share_an_anchor():
    rng = random.Random(6)
    p = words(rng, 50)
    for _ in range(50):
        found = [set(passages.anchors(passages.word_hashes(" ".join(words(rng, rng.randint(0, 80)) + p + words(rng, rng.randint(0, 80)))))[1].tolist()) for _ in range(2)]
        assert found[0] & found[1]
