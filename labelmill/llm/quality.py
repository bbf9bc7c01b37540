"""Quality by weak labels: overlapping heuristic labellers, their accuracies by
expectation-maximisation, and a hashed linear scorer trained on the posterior labels.

Labellers vote good (1), bad (0) or abstain on whole texts. Votes are counted by pattern
over all documents (at most 3^labellers rows), and EM runs on those counts. The scorer
sees word shapes and short words hashed to DIM weights and is fitted on a bounded sample.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmill.llm.common import fraction, small_batches

DIM = 1 << 16
#: Rows that the scorer is fitted on, at most.
SAMPLE = 6000

#: Very frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = frozenset(b"the of and to in is it that was for on are as with be by this at or from der die und das ist nicht ein eine mit auf den von zu im le la les de et un une des est que pour dans sur qui el los las en y del por con para una se al lo".split())

_CLASS = bytes(97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else 32 if c in b" \t\n\r\v\f" else c for c in range(256))
_RUNS = re.compile(rb"(.)\1+")


def _vote(good: bool, bad: bool) -> str:
    return "1" if good else "0" if bad else "-"


def votes(text: str | None) -> str:
    """One character for each labeller: 1 good, 0 bad, - abstains."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    if not n:
        return "-" * 9
    kinds = raw.translate(_CLASS)
    upper, lower, digits = kinds.count(b"A"), kinds.count(b"a"), kinds.count(b"0")
    marks = sum(map(len, words)) - upper - lower - digits
    low = [w.lower().strip(b".,;:!?") for w in words]
    common = sum(map(FUNCTION_WORDS.__contains__, low)) / n
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated = sum(len(x) for x in lines) / max(1, sum(map(len, set(lines))))
    ended = sum(x.rstrip()[-1:] in b".!?" for x in lines) / max(1, len(lines))
    letters = lower + upper
    sign = marks / max(1, letters)
    bars = (raw.count(b"|") + raw.count(b"\t")) / n
    stuck = sum(map(raw.count, (b"%%", b"$$", b"##", b"&&", b"**", b"!!", b"@@", b"~~", b"=="))) / n
    loud = upper / max(1, letters)
    stutter = sum(map(bytes.__eq__, words, words[1:])) / n
    often = max(Counter(low).values()) / n
    return "".join((
        _vote(sign < 0.08, sign > 0.2),
        _vote(False, bars > 0.1),
        _vote(False, stuck > 0.1),
        _vote(loud < 0.15, loud > 0.35),
        _vote(common > 0.12, common < 0.02 and n > 20),
        _vote(False, repeated > 2.0),
        _vote(ended > 0.8, ended < 0.3 and len(lines) > 3),
        _vote(False, stutter > 0.3),
        _vote(False, often > 0.25 and n > 20),
    ))


def fit_accuracies(counts: dict[str, int], rounds: int = 100) -> dict:
    """EM over vote patterns: the share of good texts, and how often each labeller votes good, bad or abstains on good and on bad ones.

    Abstaining is a vote of its own, so that labellers that only ever vote bad count. The
    start takes a text with any bad vote for probably bad; pseudo-counts keep a labeller's
    bad votes likelier on bad texts than on good ones.
    """
    if not counts:
        return {"good": 0.5, "vote": {}, "posterior": {}}
    patterns = sorted(counts)
    n = np.array([counts[p] for p in patterns], float)
    cast = np.array([[["1", "0", "-"].index(c) for c in p] for p in patterns])
    p = np.array([0.05 if "0" in x else 0.97 for x in patterns])
    prior = {0: np.array([1.0, 3.0, 4.0]), 1: np.array([4.0, 0.2, 4.0])}  # good, bad, abstains
    for _ in range(rounds):
        good = float(np.clip((n * p).sum() / n.sum(), 0.01, 0.99))
        log = np.tile(np.log([1 - good, good]), (len(patterns), 1))
        vote = {}
        for k, w in ((0, n * (1 - p)), (1, n * p)):
            vote[k] = np.array([np.bincount(cast[:, j], w, 3) + prior[k] for j in range(cast.shape[1])])
            vote[k] /= vote[k].sum(axis=1, keepdims=True)
            log[:, k] += np.log(vote[k][np.arange(cast.shape[1]), cast]).sum(axis=1)
        p = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
    return {"good": good, "vote": vote, "posterior": dict(zip(patterns, p.tolist(), strict=True))}


@lru_cache(50_000)
def _shape(word: bytes) -> bytes:
    return _RUNS.sub(rb"\1", word)


def features(text: str | None) -> dict[int, float]:
    """Hashed shares of word shapes (runs of a letter class count once), of words of up to four bytes, and of words said twice."""
    raw = (text or "").encode("utf-8", "replace")
    if not (words := raw.split()):
        return {zlib.crc32(b"empty") % DIM: 1.0}
    shapes: Counter = Counter()
    for w, c in Counter(raw.translate(_CLASS).split()).items():
        shapes[_shape(w)] += c
    small = Counter(w for w in raw.lower().split() if len(w) < 5)
    out = {zlib.crc32(b"stutter") % DIM: sum(map(bytes.__eq__, words, words[1:])) / len(words)}
    for kind, found in ((b"s:", shapes), (b"w:", small)):
        for w, c in found.items():
            k = zlib.crc32(kind + w[:32]) % DIM
            out[k] = out.get(k, 0.0) + c / len(words)
    return out


def train(rows: list[dict[int, float]], wanted: np.ndarray, rounds: int = 30) -> np.ndarray:
    """DIM weights and a bias of a logistic scorer for soft labels, by AdaGrad on mini-batches."""
    w, seen = np.zeros(DIM + 1), np.full(DIM + 1, 1e-8)
    size = np.array([len(r) for r in rows])
    index = np.concatenate([np.fromiter(r.keys(), np.int64, len(r)) for r in rows]) if rows else np.zeros(0, np.int64)
    value = np.concatenate([np.fromiter(r.values(), float, len(r)) for r in rows]) if rows else np.zeros(0)
    at = np.concatenate([[0], np.cumsum(size)])
    rng = np.random.default_rng(11)
    for _ in range(rounds):
        order = rng.permutation(len(rows))
        for i in range(0, len(rows), 256):
            own = order[i : i + 256]
            take = np.concatenate([np.arange(at[j], at[j + 1]) for j in own])
            row = np.repeat(np.arange(len(own)), size[own])
            z = np.bincount(row, value[take] * w[index[take]], len(own)) + w[-1]
            miss = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - wanted[own]
            step = np.bincount(index[take], value[take] * miss[row], DIM + 1) / len(own)
            step[-1] = miss.mean()
            step[:-1] += 1e-6 * w[:-1]
            seen += step**2
            w -= 0.5 * step / np.sqrt(seen)
    return w


def fit_quality(docs: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """The scorer's weights. Vote patterns are counted over all rows; `sample` bounds the rows that train the scorer."""

    small_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def vote(texts: pd.Series) -> pd.Series:
        return texts.map(votes, na_action=None)

    @F.pandas_udf("map<int,float>")
    def feature(texts: pd.Series) -> pd.Series:
        return texts.map(features, na_action=None)

    counts = {r[0]: r[1] for r in docs.groupBy(vote("text").alias("votes")).count().collect()}  # at most 3^9 patterns
    model = fit_accuracies(counts)
    part = min(1.0, 1.2 * sample / max(1, sum(counts.values())))
    place = fraction("text", *[c for c in ("doc_id",) if c in docs.columns], seed="quality")
    own = docs.select("text", place.alias("place")).where(F.col("place") < part).orderBy("place", "text").limit(sample).select("text")
    rows = own.select(vote("text"), feature("text")).collect()
    return train([{int(k): float(v) for k, v in r[1].items()} for r in rows], np.array([model["posterior"][r[0]] for r in rows]))


def score_column(weights: np.ndarray, text: str = "text"):
    """The chance that a text is good, 0 to 1."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        def one(x):
            f = features(x)
            z = weights[-1] + (weights[list(f)] * list(f.values())).sum()
            return 1 / (1 + np.exp(-np.clip(z, -50, 50)))

        return texts.map(one, na_action=None).astype(float)

    return score(text)


def score_quality(docs: DataFrame, sample: int = SAMPLE, least: float = 0.3) -> DataFrame:
    """Returns doc_id, score (0 to 1, higher: better), kept (score >= least) for each row of docs.

    Null and blank texts count as bad. Rows that repeat score alike; ids may be null. With
    no rows the result is empty. Other columns are ignored.
    """
    scored = docs.select("doc_id", score_column(fit_quality(docs, sample)).alias("score"))
    return scored.withColumn("kept", F.col("score") >= least)


def good_documents(docs: DataFrame, sample: int = SAMPLE, least: float = 0.3) -> DataFrame:
    """The rows of docs, whole and with all their columns, that score at least `least`; null and blank texts go, repeats share one score, an empty table stays empty."""
    return docs.where(score_column(fit_quality(docs, sample)) >= least)
