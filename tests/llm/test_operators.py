"""Every corpus operator on a small fixture with nulls, empty and long texts, ties, repeated rows and clashing names, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import ann, bpe, context_mixing, line_rules, packing, paragraph_dedup, rule_ensemble, simhash, suffix_dedup, toxicity
from tidemark.llm.common import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, w string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n):
    return " ".join(rng.choice(["river", "stone", "cloud", "amber", "lantern", "quiet", "été", "garden", "winter", "music"]) + rng.choice(["", "s", "ly", "ing", ","]) + str(rng.randint(0, 40)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base, passage = prose(rng, 160), prose(rng, 90)
    near = base.split(" ")
    near[70] = "changed"
    rows = [(1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, "   \n\t "), (7, "one two"), (8, prose(rng, 30) + "\n" + passage + "\n" + prose(rng, 30)), (9, passage + "\n" + prose(rng, 40))]
    rows += [(10, "ab" * 3000), (11, "word " * 300), (12, prose(rng, 9000)), (12, prose(rng, 20)), (13, base), (13, base), (None, prose(rng, 60)), (14, "x" * 700 + "\n" + "日本語 " * 200)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash", "clash") for i, t in texts], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def lower(t):
    return t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 90), (95, 100), (7, 7)]
    got = dict(pairs(components(spark.createDataFrame(chain, "a long, b long")), "node", "component"))
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_few_edges_take_few_jobs(spark, monkeypatch):
    """By rounds and in one task alike, and after rounds that leave few; a small graph costs the driver a few jobs."""
    rng = random.Random(12)
    links = [(i, i + 1) for i in range(0, 300)] + [(rng.randint(1000, 1400), rng.randint(1000, 1400)) for _ in range(250)] + [(-5, 2000)]
    edges, got, jobs = spark.createDataFrame(links, "a long, b long"), [], []
    for few in (-1, 150, 200_000):
        monkeypatch.setattr("tidemark.llm.common.FEW", few)
        spark.sparkContext.setJobGroup(f"few{few}", "components")
        got.append(pairs(components(edges), "node", "component"))
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"few{few}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got[0] == got[1] == got[2] and len(got[0]) > 500
    assert jobs[2] <= 12 and jobs[2] < jobs[0] / 2, jobs


def test_simhash(docs, none, texts):
    def fp(t):
        w = WORD.findall(lower(t or ""))
        sh = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) > 3 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    prints = [(i, fp(t)) for i, t in texts]
    comp = {f: f for _, f in prints}
    for _ in prints:
        for _, a in prints:
            for _, b in prints:
                if (a ^ b).bit_count() <= 2:
                    comp[a] = comp[b] = min(comp[a], comp[b])
    least = {}
    for i, f in prints:
        if i is not None:
            least[comp[f]] = min(least.get(comp[f], i), i)
    want = sorted([(i, f - (1 << 64) * (f >> 63), least.get(comp[f])) for i, f in prints], key=str)
    assert pairs(simhash.near_duplicates(docs), "doc_id", "fp", "component_id") == want
    kept = [r["doc_id"] for r in simhash.deduplicate(docs).collect()]
    assert sorted(kept) == sorted({c for _, _, c in want if c is not None})
    assert simhash.near_duplicates(none).count() == 0


def test_ball_links_are_complete(spark):
    rng = random.Random(4)
    seeds = [rng.getrandbits(63) for _ in range(20)]
    prints = {s ^ sum(1 << b for b in rng.sample(range(63), rng.randint(0, 3))) for s in seeds for _ in range(12)}
    got = components(simhash.ball_links(spark.createDataFrame([(p,) for p in prints], "fp long")))
    parent = {p: p for p in prints}
    for _ in range(8):
        for a in prints:
            for b in prints:
                if (a ^ b).bit_count() <= 2:
                    parent[a] = parent[b] = min(parent[a], parent[b])
    linked = {p: c for p, c in parent.items() if sum(v == c for v in parent.values()) > 1}
    assert dict(pairs(got, "node", "component")) == linked


def test_bpe(docs, none, texts):
    import base64

    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = sorted(((r["doc_id"], r["ids"], bytes(r["decoded"])) for r in bpe.encode(docs, path, P.PATTERN).collect()), key=str)
    assert got == sorted(((i, enc.encode_ordinary(t or ""), (t or "").encode()) for i, t in texts), key=str)
    assert bpe.encode(none, path, P.PATTERN).count() == 0
    own, rng = bpe.codec(path, P.PATTERN), random.Random(5)
    for _ in range(300):
        t = "".join(rng.choice(" \n\t\x1c\x85　aéb'sñ1٣.!日😀") for _ in range(rng.randint(1, 40)))
        assert np.frombuffer(own.encode([t])[0], "<i4").tolist() == enc.encode_ordinary(t)


def test_packing(docs, none, texts):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    want = []
    for i, t in texts:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        want += [(i, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())) for k in range(0, len(ids), 2048)]
    df = packing.pack(docs, path)
    assert pairs(df, "doc_id", "piece", "start", "length", "ids_crc32") == sorted(want, key=str)
    frame = df.toPandas().sort_values(["sequence_id", "offset"])
    for _, x in frame.groupby("sequence_id"):
        assert x.offset.tolist() == [0, *x.length.cumsum().tolist()[:-1]] and x.length.sum() <= 2048
    assert packing.pack(none, path).count() == 0


def test_tokens_of_odd_texts():
    """Ids as the library gives them, its own tokens and signs of all kinds included."""
    from tokenizers import Tokenizer

    path, rng = P.path("word_bpe_49k.json"), random.Random(8)
    tok, own = Tokenizer.from_file(path), packing.Tokens(path)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "endoftext", "don't", "U.S.", "é", "ß", "日本", "\u0301", "42", "3.5", "--", "...", "A", "word", "Word's", "🙂", "\u00a0", "_", "</w>"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", "", " ", "\n", "\t"]) for _ in range(rng.randint(0, 12))) for _ in range(20_000)]
    got = own.encode(pa.array(texts))
    for t, x, e in zip(texts, got, tok.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(x, "<u4").tolist() == e.ids, t


def test_plan_is_best_fit_decreasing():
    rng = random.Random(6)
    for capacity in (10, 64):
        for _ in range(30):
            sizes = [rng.randint(1, capacity) for _ in range(rng.randint(0, 80))]
            room: list[int] = []
            for s in sorted(sizes, reverse=True):
                fits = [r for r in room if r >= s]
                room.remove(min(fits)) if fits else None
                room.append((min(fits) if fits else capacity) - s)
            used: dict[int, int] = {}
            spots = []
            for s, _, n, first, per, offset in packing.plan(Counter(sizes), capacity):
                for i in range(n):
                    used[first + i // per] = used.get(first + i // per, 0) + s
                    spots.append((first + i // per, offset + i % per * s, s))
            assert sorted(capacity - u for u in used.values()) == sorted(room) and sorted(s for *_, s in spots) == sorted(sizes)
            ends = {b: 0 for b in used}
            for b, o, s in sorted(spots):
                assert ends[b] == o
                ends[b] += s


def brute_spans(data, length):
    seen = Counter(d[k : k + length] for d in data for k in range(len(d) - length + 1))
    out = []
    for d in data:
        cover = bytearray(len(d))
        for k in range(len(d) - length + 1):
            if seen[d[k : k + length]] > 1:
                cover[k : k + length] = b"\1" * length
        out.append((sum(cover), len(re.findall(rb"\x01+", bytes(cover))), bytes(b for b, c in zip(d, cover, strict=True) if not c)))
    return out


def test_suffix_dedup(docs, none, texts, monkeypatch):
    want = sorted(((i, len((t or "").encode()), n, m, hashlib.sha256(kept).hexdigest()) for (i, t), (n, m, kept) in zip(texts, brute_spans([(t or "").encode() for _, t in texts], 400), strict=True)), key=str)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    cols = ("doc_id", "n_bytes", removed, F.size("spans"), "kept_sha256")
    assert pairs(suffix_dedup.deduplicate(docs), *cols) == want
    monkeypatch.setattr(suffix_dedup, "GROUP", 1)  # anchors beyond the limit go by hashed strings
    assert pairs(suffix_dedup.deduplicate(docs), *cols) == want
    assert suffix_dedup.deduplicate(none).count() == 0


def test_deep_shallow_sorts():
    rng = random.Random(7)
    found = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 90))) for _ in range(200)] + [b"a" * n for n in (70, 80, 80)] + [b"a" * 70 + b"\0"]
    order, prefix = suffix_dedup.deep_shallow(found)
    ranked = [found[i] for i in order]
    assert ranked == sorted(found)
    assert prefix.tolist()[1:] == [suffix_dedup.lcp(a, b) for a, b in zip(ranked, ranked[1:], strict=False)]


def test_line_rules(docs, none, texts):
    df = line_rules.clean(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    got = df.toPandas()
    for row in got.itertuples():
        options = [t or "" for i, t in texts if i == (None if pd.isna(row.doc_id) else row.doc_id)]
        facts = []
        for t in options:
            w = WORD.findall(t)
            g = Counter(zip(w, w[1:], w[2:], strict=False))
            cover = {k + j for k in range(len(w) - 2) if g[tuple(w[k : k + 3])] > 1 for j in range(3)}
            lines = [x for x in t.split("\n") if WORD.search(x)]
            facts.append((len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover)))
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) in facts
    documents = pd.DataFrame(texts, columns=["doc_id", "text"])  # noqa: F841
    want = duckdb.sql(line_rules.SQL).df()
    key = lambda f: sorted(map(str, f[sorted(f.columns)].astype({"doc_id": "Float64"}).itertuples(index=False, name=None)))
    assert key(got) == key(want)
    assert line_rules.clean(none).count() == 0


def quality_rows(n=400):
    rng = random.Random(8)
    for i in range(n):
        good = i % 3 > 0
        t = prose(rng, rng.randint(30, 200))
        yield i, t if good else " ".join(w + rng.choice(["###", "&&&"]) for w in t.split(" ")), int(good), int(i % 5 == 0)


def test_rule_ensemble(spark, docs, none):
    rows = list(quality_rows())
    df = spark.createDataFrame([(i, t) for i, t, *_ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q, _ in rows] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    scored, model = rule_ensemble.classify(df, labels)
    got = scored.toPandas().merge(pd.DataFrame([(i, q) for i, _, q, _ in rows], columns=["doc_id", "q"]))
    held = got[got.held_out]
    assert (held.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in held.doc_id]).all() and len(held) > 50
    assert ((held.score >= 0.7) == (held.q == 1)).mean() > 0.97 and model.rules
    assert rule_ensemble.keep(df, model, 0.7).count() == int((got.score >= 0.7).sum())
    assert rule_ensemble.classify(docs, labels)[0].count() == docs.count()
    assert rule_ensemble.classify(none, labels.limit(0))[0].count() == 0
    x, names = np.array([[0.0, 1], [1, 1], [0, 1], [1, 1]] * 20), ["f_a", "f_b"]
    fitted = rule_ensemble.fit(x, x[:, 0], names)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x[:2]], "f_a double, f_b double")
    assert np.allclose([r[0] for r in df.select(fitted.column()).collect()], fitted.score(x[:2]))


def test_toxicity(spark, docs, none):
    rng, rows = random.Random(9), []
    for i, t, _, bad in quality_rows(600):
        w = t.split(" ")
        for _ in range(4 * bad):
            w.insert(rng.randint(0, len(w)), rng.choice(["dreadful", "Vile!", "rotten"]))
        rows.append((i, " ".join(w), bad))
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, b) for i, _, b in rows], "doc_id long, quality int, toxic int")
    got = toxicity.classify(df, labels).toPandas().merge(pd.DataFrame(rows, columns=["doc_id", "text", "toxic"]))
    held = got[got.held_out]
    assert ((held.score >= 0.7) == (held.toxic == 1)).mean() > 0.97
    for r in held[held.toxic == 1].head(20).itertuples():
        assert all(re.search("dreadful|Vile|rotten", r.text[s["start"] : s["end"]]) for s in r.spans)
    tagger = toxicity.train(df, labels)
    assert toxicity.tag(docs, tagger).count() == docs.count()
    assert toxicity.keep(docs, tagger, 0.7).columns == docs.columns
    assert toxicity.classify(none, labels.limit(0)).count() == 0


def test_chain_marginals():
    rng = np.random.default_rng(1)
    chain = toxicity.Chain({}, 0.0, (-0.7, 0.3, 1.1))
    e = rng.normal(size=(3, 5))
    real = np.array([[1, 1, 1, 1, 1], [1, 1, 1, 0, 0], [1, 0, 0, 0, 0]], bool)
    p, steps = chain.marginals(e, real)
    step = {(0, 0): 0.0, (0, 1): -0.7, (1, 0): 0.3, (1, 1): 1.1}
    total = np.zeros(3)
    for r in range(3):
        n = int(real[r].sum())
        weights = {}
        for tags in np.ndindex(*(2,) * n):
            weights[tags] = math.exp(sum(e[r, k] for k in range(n) if tags[k]) + sum(step[a, b] for a, b in zip(tags, tags[1:], strict=False)))
        z = sum(weights.values())
        for k in range(n):
            assert math.isclose(p[r, k], sum(v for t, v in weights.items() if t[k]) / z)
        for j, s in enumerate([(0, 1), (1, 0), (1, 1)]):
            total[j] += sum(v * sum(x == s for x in zip(t, t[1:], strict=False)) for t, v in weights.items()) / z
    assert np.allclose(steps, total)


def test_chains_go_on_from_row_to_row(monkeypatch):
    chain = toxicity.Chain({"wa$": 0.8, "wb$": -0.6}, -0.5, (-0.7, 0.3, 1.1))
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["wa", "wb", "wc"]) for _ in range(n)) for n in (0, 3, 7, 8, 9, 16, 17, 500, 1)]
    found = []
    for length in (8, 128, 2000):
        monkeypatch.setattr(toxicity, "CHAIN", length)
        found.append(toxicity.Tagger(chain).tag(texts)[2])
    assert np.allclose(found[0], found[2], atol=1e-9) and np.allclose(found[1], found[2], atol=1e-9)


def test_toxicity_scores_against_brute_force(spark, monkeypatch):
    """Scores and spans of tag() from marginals summed over all taggings of short texts."""
    chain = toxicity.Chain({"bad$": 3.0, "bad": 0.5, "shape:upper": 0.4}, -2.0, (-0.7, 0.3, 1.1))
    tagger, texts = toxicity.Tagger(chain, (-1.0, 2.0, 0.7, 0.1)), ["a bad day", "BAD! bad", "fine", "", None, "so  bad\nbad ends here"]
    got = {r["doc_id"]: r for r in toxicity.tag(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tagger).collect()}
    step = {(0, 0): 0.0, (0, 1): -0.7, (1, 0): 0.3, (1, 1): 1.1}
    for i, t in enumerate(texts):
        spots = [m.span() for m in WORD.finditer(t or "")]
        scores, total, one = [chain.score(t[a:b]) for a, b in spots], 0.0, [0.0] * len(spots)
        for tags in np.ndindex(*[2] * len(spots)):
            w = math.exp(sum(s for s, k in zip(scores, tags, strict=True) if k) + sum(step[x] for x in zip(tags, tags[1:], strict=False)))
            total += w
            one = [o + w * k for o, k in zip(one, tags, strict=True)]
        p = [o / total for o in one]
        strong = [x for x in p if x >= 0.5]
        z = -1.0 + 2.0 * max(strong, default=0.0) + 0.7 * math.log1p(sum(strong)) + 0.1 * min(5.0, 100 * sum(strong) / max(1, len(p)))
        assert math.isclose(got[i]["score"], 1 / (1 + math.exp(-z)), rel_tol=1e-9)
        assert {k for s in got[i]["spans"] for k, (a, b) in enumerate(spots) if s["start"] <= a and b <= s["end"]} == {k for k, x in enumerate(p) if x >= 0.5}


def test_context_mixing(docs, none, texts):
    got = context_mixing.score(docs).toPandas()
    known = [(i, [*WORD.findall(lower(t or "")), ""]) for i, t in texts]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 if i is not None else False for i, _ in known}
    c = Counter(w for i, ws in known if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((len(ws), sum(c[w] > 0 for w in ws), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for _, ws in known)
    assert sorted(zip(got.n_tokens, got.n_known, got.base_score.round(6), strict=True)) == want
    assert (got.train_tokens == n).all() and np.isfinite(got.score).all() and (got.score < 0).all()
    assert context_mixing.score(none).count() == 0


def test_context_mixing_tail(docs, monkeypatch):
    cols = ("n_known", F.round("base_score", 6), F.round("score", 6))
    want = pairs(context_mixing.score(docs), *cols)
    assert pairs(context_mixing.score(docs.repartition(7)), *cols) == want  # the same however rows are dealt
    monkeypatch.setattr(context_mixing, "HOT_WORDS", 5)  # nearly all words meet their counts in the join
    monkeypatch.setattr(context_mixing, "HOT_UNITS", 5)
    assert pairs(context_mixing.score(docs), *cols) == want


def _mixer(rows):
    """A mixer over rows (unit, kind, n), and the rows as its arrays in order."""
    a, b = (np.array([int.from_bytes(u.ljust(16, b"\0")[k : k + 8], "big") for u, _, _ in rows], np.uint64) for k in (0, 8))
    size, kind, n = (np.array(x, np.int64) for x in zip(*((len(u), k, n) for u, k, n in rows), strict=True))
    order = np.lexsort((kind, b, a))
    a, b, size, kind, n = (x[order] for x in (a, b, size, kind, n))
    prefixes = np.zeros((context_mixing.TOPICS * context_mixing.KINDS, 65536))
    np.add.at(prefixes, (kind, (a >> np.uint64(48)).astype(int)), n)
    return context_mixing.Mixer.untrained(prefixes), (a, b, size, kind, n)


def test_mixing_counts_what_begins_alike():
    rng = random.Random(4)
    rows = {(bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 11))) + b" ", rng.randint(0, 4)): rng.randint(0, 5) for _ in range(300)}
    mixer, unit = _mixer([(u, k, n) for (u, k), n in rows.items()])
    bits = lambda u: "".join(f"{c:08b}" for c in u)
    a, b, size, kind, n = unit
    names = [(int(x).to_bytes(8, "big") + int(y).to_bytes(8, "big"))[:m] for x, y, m in zip(a, b, size, strict=True)]
    depth = np.zeros(len(a), int)
    for at, _, bit, x, _ in mixer.inputs(*unit, without=False):
        for r in rng.sample(range(len(at)), min(5, len(at))):
            i = at[r]
            own = bits(names[i])
            assert int(own[depth[i]]) == bit[r]
            for col, same in ((0, lambda k: True), (1, lambda k, i=i: k == kind[i])):
                total = [sum(c for (u, k), c in rows.items() if same(k) and bits(u)[:d] == own[:d]) for d in (depth[i], depth[i] + 1)]
                assert math.isclose(x[r, col], math.log((total[1] + 0.4) / (total[0] - total[1] + 0.4)), rel_tol=1e-5, abs_tol=1e-5)
        depth[at] += 1
    assert (depth == 8 * size).all()


def test_mixing_predicts_shared_beginnings_once():
    """Units of a kind that begin alike share their predictions there, apart by whether they occur once; counts add up."""
    names = [b"beginning" + bytes([97 + i, 97 + j]) for i in range(26) for j in range(10)]
    mixer, unit = _mixer([(u, k, 1 + (i + k) % 3) for i, u in enumerate(names) for k in (0, 4)])
    bits = 0
    for rows, which, made, node, bit, x, gate in mixer.predictions(*unit, without=True):
        assert len(rows) == len(which) == 520 and x.shape == (context_mixing.TRIES, len(made)) and len(node) == len(bit) == len(gate) == len(made)
        assert made.sum() == unit[4].sum() and (np.bincount(which, unit[4][rows]) == made).all()
        assert len(made) == 4 if bits < 72 else len(made) > 4  # two kinds, units that occur once and the others
        bits += 1
    assert bits == 88


def test_mixing_is_a_distribution():
    words = [(b"stone ", 0, 5), (b"store ", 0, 2), (b"river ", 1, 9)]
    every = [(b"sto" + bytes([c]), 0, 0) for c in range(256)]
    mixer, unit = _mixer(words)
    size = [1 << k for k in context_mixing.SLOT_BITS]
    mixer.ones = [np.random.default_rng(k).integers(0, 9, n).astype(np.float32) for k, n in enumerate(size)]
    mixer.learn(np.zeros_like(mixer.weights), np.zeros(context_mixing.GATES), np.zeros((256, 33)), np.zeros((256, 33)), *unit)
    _, asked = _mixer(words + every)
    four = mixer.cost(*(x[(asked[4] == 0)] for x in asked))
    _, asked = _mixer([(b"sto", 0, 0)])
    three = mixer.cost(*asked)
    assert math.isclose(float((10**four).sum()), float(10 ** three[0]), rel_tol=1e-6)


def test_mixing_classes_come_from_all_texts(spark, monkeypatch):
    """Each class is the mean of every text that is nearest to it, far more texts than a sample held, however they are dealt."""
    monkeypatch.setattr(context_mixing, "TOPIC_PASSES", 100)  # until nothing moves
    rng = random.Random(8)
    texts = [None, "", " \n"] + [" ".join(f"{'abcdef'[k % 6]}{rng.randint(0, 9)}" for _ in range(rng.randint(1, 12))) for k in range(5_000)] + ["one text, often"] * 500
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    got = context_mixing.topics(df)
    flat, sizes, space = context_mixing._flat(texts)
    x = context_mixing.directions(*context_mixing._words(flat, np.cumsum(sizes), space), len(texts))
    assert (x[:3] == 0).all() and (np.abs(np.sqrt((x[3:] ** 2).sum(1)) - context_mixing.UNIT) < 4).all()
    x = x[3:]
    own = (x @ got.centres.T).argmax(1)
    for k in range(context_mixing.TOPICS):
        assert not (own == k).any() or (context_mixing._centres(x[own == k].astype(np.int64).sum(0)) == got.centres[k]).all()
    assert (context_mixing.topics(df.repartition(7)).centres == got.centres).all()
    assert not context_mixing.topics(df.where("text = ''")).centres.any()


def test_mixing_counts_beyond_single_precision(spark):
    """Over 2**24 units of one beginning, as at 6 GB: totals by two bytes and counts of what follows still agree."""
    rows = [("the ", (1 << 24) + 1), ("thing ", 3), ("there ", 1), ("some ", 5)]
    u = context_mixing.units([w for w, _ in rows])
    first = u.first.tolist()
    a, b = (((x[first] ^ context_mixing._TOP).view(np.int64)).tolist() for x in (u.a, u.b))
    found = spark.createDataFrame([(1, len(w), x, y, n) for (w, n), x, y in zip(rows, a, b, strict=True)], "kind byte, size byte, a long, b long, n long")
    mixer, count = context_mixing.train(found)
    assert count == 4 and np.isfinite(mixer.weights).all() and np.isfinite(mixer.apm).all()
    priced = context_mixing.costs(found, mixer, count).collect()
    assert len(priced) == 4 and all(math.isfinite(r["cost"]) and r["cost"] < 0 for r in priced)


def test_mixing_tables_find_keys():
    keys = context_mixing.mixed(np.arange(1, 5001))
    table = context_mixing.Table.of(keys, np.arange(5000.0))
    values, known = table.look_up(np.concatenate((keys, context_mixing.mixed(np.arange(5000, 9000)), np.zeros(1, np.uint64))))
    assert not known[5000:].any() and known[:5000].sum() == table.held > 4000
    assert (values[:5000][known[:5000]] == np.arange(5000)[known[:5000]]).all()


def test_paragraphs(spark, none):
    rng = random.Random(10)
    a, b, c = prose(rng, 60), prose(rng, 60), prose(rng, 60)
    near = a.split(" ")
    near[30] = "other"
    far = prose(rng, 30) + " " + " ".join(a.split(" ")[:30])
    rows = [(1, a + "\n" + b), (2, "\n".join([c, " ".join(near), "short line"])), (3, far), (4, None), (5, ""), (6, b + "\n" + b), (7, a.translate(str.maketrans("abcdefghij", "ABCDEFGHIJ")))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_paragraphs"], r["n_repeated"], r["n_removed"], r["copy_of"]) for r in paragraph_dedup.summary(df).collect()}
    assert got == {1: (2, 2, 0, []), 2: (2, 1, 1, [1]), 3: (1, 0, 0, []), 4: (0, 0, 0, []), 5: (0, 0, 0, []), 6: (2, 2, 2, [1]), 7: (1, 1, 1, [1])}
    cut = dict(pairs(paragraph_dedup.deduplicate(df), "doc_id", "text"))
    assert cut == {1: rows[0][1], 2: c + "\nshort line", 3: far, 4: None, 5: "", 6: "", 7: ""}
    assert paragraph_dedup.summary(none).count() == 0


def test_paragraphs_against_all_pairs(spark, monkeypatch):
    rng, lines = random.Random(11), []
    for _ in range(25):
        w = prose(rng, 50).split(" ")
        for _ in range(6):
            x = list(w)
            for k in rng.sample(range(50), rng.randint(0, 4)):
                x[k] = f"n{rng.random()}"
            lines.append(" ".join(x))
    parent = list(range(len(lines)))
    sets = [set(paragraph_dedup.shingles(x)) for x in lines]
    for _ in range(6):
        for i, s in enumerate(sets):
            for j in range(i):
                if len(s & sets[j]) >= 0.8 * len(s | sets[j]):
                    parent[i] = parent[j] = min(parent[i], parent[j])
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    want = sorted(i for i, p in enumerate(parent) if p != i)
    for bucket in (50_000, 3):  # hot buckets are split
        monkeypatch.setattr(paragraph_dedup, "BUCKET", bucket)
        got = sorted(r["doc_id"] for r in paragraph_dedup.summary(df).where("n_removed > 0").collect())
        assert len(set(got) ^ set(want)) <= len(want) // 25


def test_nearest(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[100:160] = x[0]
    x[700] = 0
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(2000, None, 0), (2050, [float("nan")] * 16, 0), (50, x[50].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = ann.search(df).toPandas()
    ok = [i for i in range(1500) if i != 700]
    u = x[ok].astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    hit = total = 0
    for q in [i for i in ok if i % 50 == 0]:
        s = u @ u[ok.index(q)]
        s = np.round(s, 12)
        s[ok.index(q)] = -9
        top = [ok[i] for i in np.lexsort((ok, -s))[:5]]
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == [1, 2, 3, 4, 5]
        hit, total = hit + len(set(top) & set(mine.vec_id)), total + 5
        if q == 0 or 100 <= q < 160:
            assert mine.vec_id.tolist() == top
    assert hit / total >= 0.9 and set(got.query_id) == {i for i in ok if i % 50 == 0}
    assert ann.search(df.limit(0)).count() == 0


def test_nearest_of_odd_tables(spark, monkeypatch):
    rng = np.random.default_rng(13)
    x = np.concatenate((rng.normal(size=(900, 8)), rng.normal(size=(3, 8)) * 0.001 + 40.0))  # three far from all others
    rows = [(i, v.tolist(), "c") for i, v in enumerate(x)]
    rows += [(50, v.tolist(), "c") for v in x[1:30]] + [(7, x[0].tolist(), "c")] * 40 + [(None, x[0].tolist(), "c"), (950, x[900].tolist(), "c"), (951, None, "c"), (952, [1.0, 2.0], "c")]
    rows += [(k, (x[100] * 2.0 ** (k - 1000)).tolist(), "c") for k in range(1000, 1040)]  # one direction, many ids
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, list string")
    monkeypatch.setattr(ann, "ASKED", 4)
    monkeypatch.setattr(ann, "CHUNK", 50)
    got = ann.search(df, prune=0.01).toPandas()
    ok = [(i, np.array(v)) for i, v, _ in rows if i is not None and v is not None and len(v) == 8]
    asked = sorted({i for i, _ in ok if i % 50 == 0})
    assert sorted(set(got.query_id)) == asked and (got.groupby("query_id").size() == 5).all()
    assert not got.duplicated(["query_id", "vec_id"]).any() and (got.query_id != got.vec_id).all()
    best = {}
    for q, a in ok:
        for i, b in ok if q in (0, 100, 1000, 950) else ():
            if i != q:
                best[q, i] = max(best.get((q, i), -2.0), float((a * b).sum() / math.sqrt((a * a).sum() * (b * b).sum())))
    exact = ann.search(df, prune=np.inf).toPandas()
    for q in (0, 100, 1000, 950):
        want = sorted(((-round(s, 12), i) for (p, i), s in best.items() if p == q))[:5]
        mine = exact[exact.query_id == q].sort_values("rank")
        assert [(-round(s, 12), i) for s, i in zip(mine.score, mine.vec_id, strict=True)] == want
    few = ann.search(df.where("vec_id in (0, 1, 2)")).toPandas()
    assert few.vec_id.tolist() == few.sort_values("rank").vec_id.tolist() and len(few) == 2


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = list(quality_rows(300))
    docs = [(i, t, "en", "s", len(t)) for i, t, *_ in rows] + [(1000, rows[1][1], "en", "s", 1), (1001, None, None, None, None), (1002, "", "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, _, q, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    good = {i for i, _, q, _ in rows if q}
    assert good - set(out.doc_id) == set() and 1000 not in set(out.doc_id)
    assert len(set(out.doc_id) - good) <= 2
