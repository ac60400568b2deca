"""Toxicity by maximum-scoring segments.

Tokens are lower-case words.  A token's log-odds of toxic against clean text come from document counts
with Dirichlet priors that back off: a word's prior is its longest counted prefix's estimate, a prefix's
that of the prefix one letter shorter, down to the share of toxic documents.  So unseen forms of a known
stem score like the stem.

A linear scan over the token scores (less a drift that makes clean text lose) finds every maximal scoring
segment; those over a threshold are the toxic passages.  The best segment of n clean tokens follows an
extreme-value law, P(max >= s) = 1 - exp(-K n e^(-l s)), whose K and l are fitted on clean training
documents.  The sums of the r best follow its tail for every r, weighed by a prior that halves with each r.
A document's score is a logistic function of the logarithms of both chances.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_rows, modest_batches, written

#: Most labelled documents that the classifier is fitted on: those of least xxhash64(doc_id).
MAX_LABELLED = 20_000
#: Letters of the prefixes that priors back off through, and the weight of a prior in documents.
PREFIXES = range(3, 11)
PRIOR = 4.0
_LONGEST_FIRST = tuple(reversed(PREFIXES))
#: What every token costs, in nats, and the least score of a passage.
DRIFT = 1.0
PASSAGE = 2.0
PREDICT = 0.7
#: Nats that the sum has to fall below its highest for earlier words to count anew: more than any one word adds.
SPENT = 10.0
#: Words whose scores a task holds.
KNOWN = 100_000
#: The chance that a group of segments goes on by one more: r of them are weighed by (1 - DECAY) DECAY^(r-1).
DECAY = 0.5
#: Least documents of a token or prefix that the model keeps; rarer ones rest on their prior.
KEEP = 2
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}'’]*")


def tokens(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def nodes(word: str) -> list[str]:
    """The word's counted forms from the widest: prefixes, marked by a trailing star, then the word."""
    return [word[:n] + "*" for n in PREFIXES if n <= len(word)] + [word]


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """Every maximal scoring segment (start, end, sum), left to right, in linear time.

    Candidates are kept with the running sum before their start (l) and at their end (r).  A new positive
    score joins the latest candidate that starts lower and ends no higher, taking in all between.
    """
    kept: list[list[float]] = []  # start, end, l, r, place of the latest earlier candidate with smaller l
    total = 0.0
    for i, x in enumerate(scores):
        if x <= 0:
            total += x
            continue
        new = [i, i + 1, total, total + x, -1]
        total += x
        k = len(kept) - 1
        while True:
            while k >= 0 and kept[k][2] >= new[2]:
                k = kept[k][4]
            if k < 0 or kept[k][3] >= new[3]:
                break
            new[0], new[2] = kept[k][0], kept[k][2]
            before = kept[k][4]
            del kept[k:]
            k = before
        new[4] = k
        kept.append(new)
    return [(int(a), int(b), r - l) for a, b, l, r, _ in kept]


@dataclass
class Model:
    """Log-odds by node, the extreme-value law and the logistic."""

    log_odds: dict[str, float]
    rate: float = 1.0  # l of the extreme-value law
    factor: float = 0.1  # K
    slopes: tuple[float, float] = (0.5, 0.5)
    intercept: float = -4.0

    def token_score(self, word: str) -> float:
        """The word's log-odds, or those of its longest prefix that has any, less the drift."""
        if (s := self.log_odds.get(word)) is not None:
            return s - DRIFT
        for n in _LONGEST_FIRST:
            if n <= len(word) and (s := self.log_odds.get(word[:n] + "*")) is not None:
                return s - DRIFT
        return -DRIFT

    def passages(self, words: list[str], cache: dict[str, float]) -> list[tuple[int, int, float]]:
        """Maximal segments.  A word that comes again within a stretch neither adds nor costs: counts are of documents, not of tokens.

        A stretch begins with a word that counts.  It ends when the sum is back where it began, so that no segment
        reaches on from it, or has fallen by SPENT below its highest; then every word counts anew.
        """
        if len(cache) > KNOWN:
            cache.clear()
        scores, seen = [], set()
        total = highest = 0.0  # of the stretch
        for w in words:
            if (s := cache.get(w)) is None:
                s = cache[w] = self.token_score(w)
            if s > 0:
                if w in seen:
                    s = 0.0
                seen.add(w)
            scores.append(s)
            if seen:
                total += s
                highest = max(highest, total)
                if total <= 0 or highest - total >= SPENT:
                    seen.clear()
                    total = highest = 0.0
        return maximal_segments(scores)

    def surprise(self, found: list[float], n: int) -> tuple[float, float]:
        """-log of the chances that n clean tokens hold a segment like the best, and segments like the best r.

        found has the scores of all segments, the highest first.  The first chance is the extreme-value law; the second
        is the tail of the sum of the r best normalised scores, e^-t t^(r-1) / (r! (r-1)!), over the weight of r, for
        the r that makes it largest.  r runs over all segments, but for those that provably can't be that r.
        """
        best = single = total = 0.0
        for r, s in enumerate(found, 1):
            x = self.rate * s - math.log(self.factor * max(n, 1))
            total += x
            weight = math.log(1 - DECAY) + (r - 1) * math.log(DECAY)
            if r == 1:
                if total > 30:
                    single = total
                elif total > -3:
                    single = -math.log(-math.expm1(-math.exp(-total)))
                best = max(best, single + weight)
            elif total > r:
                best = max(best, total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r) + weight)
            if total <= r and x <= 1:
                break  # later ones add 1 at most, so no sum exceeds its r any more
        return min(single, 60.0), min(best, 60.0)

    def probability(self, found: list[float], n: int) -> float:
        single, several = self.surprise(found, n)
        z = self.intercept + self.slopes[0] * single + self.slopes[1] * several
        return 1 / (1 + math.exp(-max(min(z, 700), -700)))


def highest_first(passages: list[tuple[int, int, float]]) -> list[float]:
    return sorted((s for _, _, s in passages), reverse=True)


def build(names: list[str], toxic: np.ndarray, clean: np.ndarray, all_toxic: int, all_clean: int) -> Model:
    """Log-odds from document counts by node.

    A node's prior is the estimate from what its wider nodes count beyond the next narrower one, the widest
    first: disjoint evidence, so that a stem and its only form don't count the same documents twice.  A node
    is left out only if lookups give its very log-odds without it, those of its longest kept prefix.
    """
    base = (all_toxic + 0.5) / (all_toxic + all_clean + 1)
    root = math.log(base / (1 - base))
    kept: dict[str, float] = {}
    chain: list[tuple[str, int, int, float]] = []  # open prefixes: stem, counts, log-odds
    for i in sorted(range(len(names)), key=lambda i: (names[i].rstrip("*"), not names[i].endswith("*"))):
        name, stem = names[i], names[i].rstrip("*")
        while chain and not stem.startswith(chain[-1][0]):
            chain.pop()
        t_own, c_own = int(toxic[i]), int(clean[i])
        if t_own + c_own < KEEP:
            continue
        p = base
        counts = [(t, c) for _, t, c, _ in chain] + [(t_own, c_own)]
        for (t, c), (t_in, c_in) in zip(counts, [*counts[1:], (0, 0)]):
            t, c = max(t - t_in, 0), max(c - c_in, 0)
            p = (t + PRIOR * p) / (t + c + PRIOR)
        s = math.log(p / (1 - p)) - root
        said = chain[-1][3] if chain else 0.0
        if s != said:
            kept[name] = said = s
        if name.endswith("*"):
            chain.append((stem, t_own, c_own, said))
    return Model(kept)


def fit_law(model: Model, rows: list[tuple[int, int, float]]) -> Model:
    """Fit the extreme-value law on clean (label 0) rows of (label, tokens, best segment)."""
    clean = [(n, s) for label, n, s in rows if not label and n]
    if clean:
        # maximum likelihood, texts without a segment being censored at 0; K follows from the rate in closed form
        n, s = np.array([c[0] for c in clean], float), np.array([c[1] for c in clean], float)
        some = s > 0
        m = max(1, some.sum())

        def loss(rate: float) -> float:
            k = m / (n * np.exp(-rate * s)).sum()
            z = np.log(k * n) - rate * s
            return np.exp(z).sum() - (z[some] + math.log(rate)).sum()

        model.rate = float(min(np.geomspace(0.1, 5, 80), key=loss))
        model.factor = float(m / (n * np.exp(-model.rate * s)).sum())
    return model


def fit_slopes(model: Model, rows: list[tuple[int, float, float]]) -> Model:
    """Fit the logistic on rows of (label, both values of surprise)."""
    x = np.array([(1.0, single, several) for _, single, several in rows]).reshape(-1, 3)
    y = np.array([label for label, *_ in rows], float)
    if 0 < y.sum() < len(y):
        w = np.array([-4.0, 0.5, 0.5])
        ridge = np.array([1e-6, 0.05, 0.05])  # so that separable rows keep finite slopes
        for _ in range(300):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
            h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge)
            d = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
            w = w + d * min(1.0, 1.0 / np.abs(d).max())
            w[1:] = np.maximum(w[1:], 0.0)  # more of a passage never speaks for clean
            if np.abs(d).max() < 1e-6:
                break
        model.intercept, model.slopes = float(w[0]), (float(w[1]), float(w[2]))
    return model


def labelled(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """doc_id, text, toxic of at most `limit` labelled documents that are not held out.

    A sample of fixed size, by least hash of doc_id; it is the only thing that is broadcast.
    """
    own = labels.select("doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out())
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return docs.select("doc_id", "text").join(F.broadcast(own), "doc_id")


def train(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> Model:
    """Two passes over the labelled sample: document counts by node, then segments.

    Calibration is cross-fitted: counts are kept for two halves of the sample, and each half's segments come
    from the log-odds of the other, so that words seen once or twice don't flatter it.  The segments stay in a
    table; the driver gets three numbers a document, first for the law, then for the logistic.
    """
    sample = labelled(docs, labels, limit).select("toxic", F.pmod(F.xxhash64("text"), F.lit(2)).alias("half"), "text")

    def count(rows: Iterator[tuple]) -> Iterator[tuple]:
        held: dict[str, int] = {}  # four counts of 16 bits each
        n = 0
        for toxic, half, text in rows:
            one = 1 << 16 * (2 * half + (0 if toxic else 1))
            for g in {g for w in set(tokens(text)) for g in nodes(w)}:
                held[g] = held.get(g, 0) + one
            n += 1
            if len(held) > 200_000 or n >= 60_000:
                yield from counted(held)
                held, n = {}, 0
        yield from counted(held)

    def counted(held: dict[str, int]) -> Iterator[tuple]:
        for g, c in held.items():
            yield g, c & 0xFFFF, c >> 16 & 0xFFFF, c >> 32 & 0xFFFF, c >> 48

    sizes = {(r["half"], r["toxic"]): r["count"] for r in sample.groupBy("half", "toxic").count().collect()}
    columns = ["t0", "c0", "t1", "c1"]
    sums = map_rows(sample, "node string, " + ", ".join(f"{c} int" for c in columns), count)
    sums = sums.groupBy("node").agg(*[F.sum(c).cast("int").alias(c) for c in columns]).where(f"{' + '.join(columns)} >= {KEEP}")
    got = sums.toArrow()
    names = got.column("node").to_pylist()
    t0, c0, t1, c1 = (got.column(c).to_numpy() for c in columns)
    total = lambda h, toxic: sizes.get((h, toxic), 0)
    # the model for one half comes from the other
    halves = [build(names, t1, c1, total(1, 1), total(1, 0)), build(names, t0, c0, total(0, 1), total(0, 0))]
    model = build(names, t0 + t1, c0 + c1, total(0, 1) + total(1, 1), total(0, 0) + total(1, 0))
    del names, got
    shared = sample.sparkSession.sparkContext.broadcast(halves)

    def segments(rows: Iterator[tuple]) -> Iterator[tuple]:
        caches: list[dict[str, float]] = [{}, {}]
        for toxic, half, text in rows:
            words = tokens(text)
            yield toxic, len(words), highest_first(shared.value[half].passages(words, caches[half]))

    found = written(map_rows(sample, "toxic int, n int, found array<double>", segments), "toxic-segments")
    best = found.select("toxic", "n", F.coalesce(F.try_element_at("found", F.lit(1)), F.lit(0.0)))
    law = fit_law(Model({}), [tuple(r) for r in best.collect()])

    def surprises(rows: Iterator[tuple]) -> Iterator[tuple]:
        for toxic, n, scores in rows:
            yield toxic, *law.surprise(scores, n)

    rows = [tuple(r) for r in map_rows(found, "toxic int, single double, several double", surprises).collect()]
    model.rate, model.factor = law.rate, law.factor
    return fit_slopes(model, rows)


PASSAGES = "array<struct<first:int,last:int,score:double>>"


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, best, passages (token positions and scores) of every row of docs, from its whole text alone.

    A text that is null or has no word holds no passage; its best segment is 0 and its score the least there is.
    Rows are treated one by one, so repeated rows, null ids and extra columns are of no account.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        m, cache = shared.value, {}
        for doc_id, text in rows:
            words = tokens(text)
            found = m.passages(words, cache)
            scores = highest_first(found)
            toxic = [{"first": a, "last": b - 1, "score": s} for a, b, s in found if s >= PASSAGE]
            yield doc_id, m.probability(scores, len(words)), scores[0] if scores else 0.0, toxic

    return map_rows(docs.select("doc_id", "text"), f"doc_id long, score double, best double, passages {PASSAGES}", run)


def drop_toxic(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED, at: float = PREDICT) -> DataFrame:
    """The rows of docs that score below `at`, all columns kept; equal texts share one fate.

    Null and empty texts have the least score there is.  Null ids and labels teach nothing, and without any label
    of both kinds the model keeps the slopes that it starts with.  An empty table gives no rows.
    """
    model = train(docs, labels, limit)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    modest_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def score(texts):
        cache: dict[str, float] = {}

        def one(text: str | None) -> float:
            words = tokens(text)
            return shared.value.probability(highest_first(shared.value.passages(words, cache)), len(words))

        return texts.map(one).astype("float64")

    return docs.where(score("text") < at)
