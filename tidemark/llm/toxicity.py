"""Operator 4: toxic spans by a linear-chain conditional random field, summed up to document scores."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, pieces
from .rule_ensemble import train_rows

#: Labelled documents that a fit takes at most, those of the least hashes.
MAX_TRAIN = 6_000
#: Tokens in a row of the matrices; a document's rows hand their odds on, and training takes each row by itself.
CHAIN = 128
#: Tokens that a worker remembers at most.
MEMORY = 400_000
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = re.compile(r"^[\W\d_]+|[\W\d_]+$")


def features(token: str) -> tuple[str, ...]:
    """A token's features: its lower-case word without outer signs, and the word's prefixes of 3 to 8 letters."""
    word = _EDGE.sub("", token.lower())
    return (word + "$", *(word[:n] for n in range(3, min(8, len(word)) + 1))) if word else ()


def shape(token: str) -> tuple[str, ...]:
    """What a token looks like, whatever its word: capitals, digits and signs, and how long it is."""
    word = _EDGE.sub("", token)
    return tuple(
        name
        for name, holds in (
            ("shape:upper", word.isupper() and len(word) > 1),
            ("shape:title", word.istitle()),
            ("shape:digit", any(c.isdigit() for c in token)),
            ("shape:signs", len(token) - len(word) > 1),
            ("shape:none", not word),
            ("shape:short", 0 < len(word) < 4),
            ("shape:long", len(word) > 12),
        )
        if holds
    )


SHAPES = ("shape:upper", "shape:title", "shape:digit", "shape:signs", "shape:none", "shape:short", "shape:long")


def chains(sizes: np.ndarray) -> tuple[np.ndarray, int]:
    """The place of every token in a matrix of rows of CHAIN, a row for each run of a document's tokens; and the rows."""
    rows = -(-sizes // CHAIN)
    first = np.cumsum(rows) - rows
    inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.repeat(first, sizes) * CHAIN + inside, int(rows.sum())


@dataclass
class Chain:
    """Two tags, 0 and 1: each token has a score for tag 1, each step one for its pair of tags (0, 0: none)."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -4.0
    steps: tuple[float, float, float] = (0.0, 0.0, 0.0)  # 0 to 1, 1 to 0, 1 to 1

    def handed_on(self, x: np.ndarray, real: np.ndarray, next_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For rows of odds x of tag 1 (next_: the row goes on in the next one): the odds of tag 1 before each row, and after it (nan: none).

        A row turns what comes before it into what comes after by a two-by-two matrix; the matrices are found for all
        rows at once, and followed along each document.
        """
        t01, t10, t11 = np.exp(self.steps)
        n, m = x.shape
        first, last = np.full(n, np.nan), np.full(n, np.nan)
        some = np.flatnonzero(next_ | np.concatenate(([False], next_[:-1])))
        if not len(some):
            return first, last
        x, real = x[some], real[some]
        up, down = (np.tile(np.eye(2), (len(some), 1, 1)) for _ in range(2))  # weights of tags 0 and 1 (rows), from either tag (columns)
        for k in range(m):
            a, b = up[:, 0] + up[:, 1] * t10, (up[:, 0] * t01 + up[:, 1] * t11) * x[:, k, None]
            up = np.stack([a, b], 1) / (a + b).sum(1)[:, None, None]
            y = x[:, m - 1 - k, None] * down[:, 1]
            a, b = down[:, 0] + y * t01, down[:, 0] * t10 + y * t11
            down = np.where(real[:, m - 1 - k, None, None], np.stack([a, b], 1) / (a + b).sum(1)[:, None, None], down)
        place = {int(r): i for i, r in enumerate(some)}
        for r in some.tolist():
            if not next_[r]:
                continue
            i = place[r]
            if np.isnan(first[r]):  # no step leads into a document: its first odds are its token's
                odds = x[i, 0]
                for k in range(1, m):
                    odds = x[i, k] * (t01 + odds * t11) / (1 + odds * t10)
            else:
                odds = (up[i, 1, 0] + first[r] * up[i, 1, 1]) / (up[i, 0, 0] + first[r] * up[i, 0, 1])
            first[r + 1] = odds
        for r in some[::-1].tolist():
            if next_[r]:
                i = place[r + 1]
                if np.isnan(last[r + 1]):
                    last[r] = down[i, 1].sum() / down[i, 0].sum()
                else:
                    last[r] = (down[i, 1, 0] + last[r + 1] * down[i, 1, 1]) / (down[i, 0, 0] + last[r + 1] * down[i, 0, 1])
        return first, last

    def marginals(self, e: np.ndarray, real: np.ndarray, times: np.ndarray | float = 1.0, next_: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Of rows of scores for tag 1: P(tag 1) of each token, and how often each step inside rows is expected, in all.

        A row counts `times`; next_: whether it goes on in the next one.
        """
        n, m = e.shape
        t01, t10, t11 = np.exp(self.steps)
        x = np.exp(np.clip(e, -30, 30))
        odds = np.empty((m, n))  # forward: weight of tag 1 against tag 0, up to here
        odds[0] = x[:, 0]
        first, last = self.handed_on(x, real, next_) if next_ is not None else (np.full(n, np.nan), np.full(n, np.nan))
        inner = ~np.isnan(first)
        odds[0, inner] *= (t01 + first[inner] * t11) / (1 + first[inner] * t10)
        for k in range(1, m):
            p = odds[k - 1]
            odds[k] = x[:, k] * (t01 + p * t11) / (1 + p * t10)
        back = np.ones((m, n))  # backward: tag 1 against tag 0, from here on
        back[m - 1, ~np.isnan(last)] = last[~np.isnan(last)]
        for k in range(m - 2, -1, -1):
            q = np.where(real[:, k + 1], x[:, k + 1] * back[k + 1], 0)
            back[k] = np.where(real[:, k + 1], (t10 + q * t11) / (1 + q * t01), 1)
        both = odds * back
        p1 = (both / (1 + both)).T * real
        # A pair's weight: forward of the left, step, score and backward of the right.
        q = (x.T * back)[1:]
        w = np.stack([q * t01, odds[:-1] * t10, odds[:-1] * q * t11])
        w /= 1 + w.sum(0)
        return p1, (w * (real.T[1:] & real.T[:-1]) * times).sum((1, 2))

    def score(self, token: str) -> float:
        get = self.weights.get
        return self.bias + sum(get(f, 0.0) for f in features(token)) + sum(get(f, 0.0) for f in shape(token))


def suspects(tokens: list[list[str]], toxic: np.ndarray, least: int = 3, ratio: float = 20.0, chance: float = 300) -> set[str]:
    """Features that toxic documents hold at least `ratio` times as often as others, in `least` documents or more.

    So many of a feature's documents are toxic that, by Chernoff's bound, less than `chance` of all features would
    reach that if toxic documents were any.
    """
    n1, n0 = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    share, met = n1 / (n1 + n0), set()

    def fresh(doc: list[str]) -> set[str]:
        """Words of the document between neighbours that no document before had: what copies repeat counts once."""
        new = {x for x in zip(["", *doc], doc, [*doc[1:], ""], strict=False) if x not in met}
        met.update(new)
        return {w for _, w, _ in new}

    one, none = Counter(), Counter()
    for doc, t in zip(tokens, toxic, strict=True):
        if t:
            one.update({f for w in fresh(doc) for f in features(w)})
    bound = math.log(max(1, len(one)) / chance)
    one = Counter({f: c for f, c in one.items() if c >= least})
    for doc, t in zip(tokens, toxic, strict=True):
        if not t:  # only what toxic documents hold is counted in the others
            none.update({f for w in set(doc) for f in features(w) if f in one})

    def surprise(c: int, d: int) -> float:
        p = c / (c + d)
        return (c + d) * (p * math.log(p / share) + ((1 - p) * math.log((1 - p) / (1 - share)) if d else 0.0))

    return {f for f, c in one.items() if c / n1 >= ratio * (none[f] + 0.5) / n0 and surprise(c, none[f]) >= bound}


def fit_chain(tokens: list[list[str]], toxic: np.ndarray, rounds: int = 60) -> Chain:
    """A chain from documents: in toxic ones, tokens with a suspect feature are labelled 1; all others 0.

    The chain learns weights of those features, of the shapes of the tokens that hold one, and of steps between tags.
    """
    found = suspects(tokens, toxic)
    names = sorted(found) + list(SHAPES)
    index = {f: i for i, f in enumerate(names)}
    of = {t: [*own, *(index[f] for f in shape(t))] for t in {t for doc in tokens for t in doc} if (own := [index[f] for f in features(t) if f in found])}
    sizes = np.array([len(d) for d in tokens], np.int64)
    place, rows = chains(sizes)
    chain = Chain()
    if not rows or not found:
        return chain
    met = [(i, of[t]) for i, t in enumerate(t for d in tokens for t in d) if t in of]
    hits = [i for i, _ in met]
    at = np.array([i for i, found in met for _ in found], np.int64)
    feat = np.array([f for _, found in met for f in found], np.int64)
    real = np.zeros(rows * CHAIN, bool)
    real[place] = True
    truth = np.zeros(rows * CHAIN, bool)
    doc_toxic = np.repeat(toxic, sizes)
    truth[place[[i for i in hits if doc_toxic[i]]]] = True
    real, truth = real.reshape(rows, CHAIN), truth.reshape(rows, CHAIN)
    # Rows without a suspect are alike but for their length: one row of each length stands for all, and counts as often.
    plain = np.ones(rows, bool)
    plain[place[at] // CHAIN] = False
    lengths, stand, often = np.unique(real[plain].sum(1), return_index=True, return_counts=True)
    keep = np.concatenate((np.flatnonzero(~plain), np.flatnonzero(plain)[stand]))
    times = np.concatenate((np.ones((~plain).sum()), often))
    moved = np.full(rows, -1)
    moved[keep] = np.arange(len(keep))
    spot = moved[place[at] // CHAIN] * CHAIN + place[at] % CHAIN
    real, truth, rows = real[keep], truth[keep], len(keep)
    pair = real[:, 1:] & real[:, :-1]
    seen = np.array([(pair & ~truth[:, :-1] & truth[:, 1:]).sum(), (pair & truth[:, :-1] & ~truth[:, 1:]).sum(), (pair & truth[:, :-1] & truth[:, 1:]).sum()], float)
    n = float((real.sum(1) * times).sum())
    true_f = np.bincount(feat, truth.ravel()[spot], len(names))
    theta, m, v = np.concatenate(([chain.bias], chain.steps, np.full(len(names), 2.0))), 0.0, 0.0
    for k in range(1, rounds + 1):
        chain.bias, chain.steps = float(theta[0]), tuple(theta[1:4])
        e = np.full(rows * CHAIN, theta[0])
        e += np.bincount(spot, theta[4 + feat], rows * CHAIN)
        p, pairs = chain.marginals(e.reshape(rows, CHAIN), real, times)
        want = np.concatenate(([truth.sum() - (p.sum(1) * times).sum()], seen - pairs, true_f - np.bincount(feat, p.ravel()[spot], len(names))))
        grad = want / max(1.0, truth.sum()) - 1e-3 * theta / max(1.0, n / 1e5)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta = theta + 0.2 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    chain.bias, chain.steps = float(theta[0]), tuple(map(float, theta[1:4]))
    chain.weights = {f: float(w) for f, w in zip(names, theta[4:], strict=True) if abs(w) > 1e-3}
    return chain


@dataclass
class Tagger:
    """A chain and a logistic score of each document's marginals."""

    chain: Chain
    coef: tuple[float, ...] = (-2.0, 0.0, 0.0, 0.0)
    memory: dict[str, float] = field(default_factory=dict)

    def tag(self, texts: list[str | None]) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
        """Tokens and sizes of every text, and P(tag 1) of each token in one array."""
        if len(self.memory) > MEMORY:
            self.memory.clear()
        memory, tokens = self.memory, [TOKEN.findall(t) if t else [] for t in texts]
        for doc in tokens:
            for t in doc:
                if t not in memory:
                    memory[t] = self.chain.score(t)
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        place, rows = chains(sizes)
        if not rows:
            return tokens, sizes, np.zeros(0)
        e, real = np.zeros(rows * CHAIN), np.zeros(rows * CHAIN, bool)
        e[place] = np.fromiter((memory[t] for doc in tokens for t in doc), float, int(sizes.sum()))
        real[place] = True
        many = -(-sizes // CHAIN)
        next_ = np.ones(rows, bool)
        next_[np.cumsum(many)[many > 0] - 1] = False
        p, _ = self.chain.marginals(e.reshape(rows, CHAIN), real.reshape(rows, CHAIN), next_=next_)
        return tokens, sizes, p.ravel()[place]

    @staticmethod
    def sums(sizes: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Of each document: constant, largest marginal, log of 1 + expected toxic tokens, their share (in percent, to 5)."""
        doc = np.repeat(np.arange(len(sizes)), sizes)
        strong = np.where(p >= 0.5, p, 0)
        total = np.bincount(doc, strong, len(sizes))
        most = np.zeros(len(sizes))
        np.maximum.at(most, doc, strong)
        return np.stack([np.ones(len(sizes)), most, np.log1p(total), np.minimum(100 * total / np.maximum(sizes, 1), 5)], 1)

    def scores(self, sizes: np.ndarray, p: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.sums(sizes, p) @ np.array(self.coef), -50, 50)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        w = w + np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return w


def fit(texts: list[str | None], toxic: np.ndarray) -> Tagger:
    """The chain learns from four fifths of the documents, the documents' score from the rest, which it hasn't seen."""
    one: dict[str, str] = {}  # equal tokens share one string
    tokens = [[one.setdefault(w, w) for w in TOKEN.findall(t or "")] for t in texts]
    # Documents that begin alike, as copies do, go together.
    rest = np.array([zlib.crc32(" ".join(d[:3]).encode()) % 4 == 3 for d in tokens], bool)
    pick = lambda mask: [d for d, k in zip(tokens, mask, strict=True) if k]
    tagger = Tagger(fit_chain(pick(~rest), toxic[~rest]))
    if rest.any():
        _, sizes, p = tagger.tag([t for t, k in zip(texts, rest, strict=True) if k])
        tagger.coef = tuple(map(float, logistic(tagger.sums(sizes, p), toxic[rest].astype(float))))
    tagger.memory = {}
    return tagger


def train(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, most: int = MAX_TRAIN) -> Tagger:
    """A tagger from at most `most` labelled documents outside the held-out fold, whole texts each."""
    seen = train_rows(docs.select("doc_id", "text"), labels, "toxic", folds, held, most).toPandas()
    seen = seen.sort_values(["doc_id", "text"]).reset_index(drop=True)
    return fit(seen["text"].where(seen["text"].notna(), None).tolist(), seen["_label"].to_numpy() == 1)


def tag(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """(doc_id, score, spans array<struct<start, end, p>>) for every row: spans are runs of tokens with P(toxic) >= 0.5.

    start and end are offsets in code points. Null and empty texts have no spans and the score of none; repeated rows stay.
    """
    chain, coef = tagger.chain, tagger.coef
    held: list[Tagger] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            held.append(Tagger(chain, coef))
        own = held[0]
        for batch in pieces(batches):
            texts = batch.column(1).to_pylist()
            _, sizes, p = own.tag(texts)
            ends, spans = np.cumsum(sizes), []
            hot = np.flatnonzero(np.bincount(np.repeat(np.arange(len(sizes)), sizes), p >= 0.5, len(sizes)))
            for i in range(len(texts)):
                spans.append([])
            for i in hot.tolist():
                mine = p[ends[i] - sizes[i] : ends[i]]
                for k, m in enumerate(TOKEN.finditer(texts[i])):
                    if mine[k] >= 0.5:
                        if k and mine[k - 1] >= 0.5:
                            last = spans[i][-1]
                            last["end"], last["p"] = m.end(), max(last["p"], float(mine[k]))
                        else:
                            spans[i].append({"start": m.start(), "end": m.end(), "p": float(mine[k])})
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.scores(sizes, p)), pa.array(spans, kind)], names=["doc_id", "score", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, spans array<struct<start:int,end:int,p:double>>")


def keep(docs: DataFrame, tagger: Tagger, cut: float) -> DataFrame:
    """The rows of docs that score below `cut`, scored where they are read."""
    chain, coef = tagger.chain, tagger.coef
    held: list[Tagger] = []
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            held.append(Tagger(chain, coef))
        for batch in pieces(batches):
            _, sizes, p = held[0].tag(batch.column(at).to_pylist())
            yield batch.filter(pa.array(held[0].scores(sizes, p) < cut))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """tag() with held_out, by a tagger trained on the labels."""
    out = F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False))
    return tag(docs, train(docs, labels, folds, held)).withColumn("held_out", out)
