"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

The model is a bounded sample of labelled texts, copies once, with all of their words: unit
vectors of (1 + ln tf) * idf * chi^2, the document frequencies counted over all documents
and the chi-square of each word against the label in the sample, so that words of no
bearing weigh little but none is left out (`telling=0` gives plain TF-IDF). They stand in
an inverted index. Rare words are looked up in their posting lists; for the words that
many examples share, every block of examples carries the largest weight, and a text opens
blocks in order of upper bound until none can hold a nearer neighbour: the neighbours are
exact. They vote by cosine, and a monotone map, fitted on examples scored by models that
never saw them, turns votes into calibrated chances.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmill.llm.common import cut, words_alnum

#: Bound of the model: examples of each label.
EXAMPLES = 2000
NEIGHBOURS, BLOCK, FOLDS = 15, 64, 4
#: A word counts as shared by many if at least this share of the examples has it.
SHARED = 1 / 16


def terms_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The hashed words of a text, distinct and in order, and their counts."""
    words = Counter(words_alnum((text or "").lower()))
    names = np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), ">i8").astype(np.int64)
    order = names.argsort()
    return names[order], np.fromiter(words.values(), np.int64, len(words))[order]


@dataclass
class Examples:
    """Labelled texts: id, label, how many rows each stands for, and their words one after the other."""

    ids: list
    toxic: np.ndarray
    stands: np.ndarray
    size: np.ndarray
    terms: np.ndarray
    counts: np.ndarray

    def take(self, own: np.ndarray) -> Examples:
        start = np.concatenate([[0], np.cumsum(self.size)])
        at = np.concatenate([np.arange(start[i], start[i + 1]) for i in own] or [np.zeros(0, int)])
        return Examples([self.ids[i] for i in own], self.toxic[own], self.stands[own], self.size[own], self.terms[at], self.counts[at])


class Index:
    """The examples' unit vectors by term, with block maxima for the terms that many share."""

    def __init__(self, examples: Examples, df: tuple[np.ndarray, np.ndarray], docs: int, telling: float = 1.0):
        """df: sorted terms and the number of the `docs` documents that hold each."""
        self.names, at = np.unique(examples.terms, return_inverse=True)
        owner = np.repeat(np.arange(len(examples.ids)), examples.size)
        found = np.zeros(len(self.names))
        known = np.isin(self.names, df[0])
        found[known] = df[1][np.searchsorted(df[0], self.names[known])]
        self.value = np.log((1 + docs) / (1 + found)) + 1
        toxic = examples.toxic > 0
        bad, good = int(toxic.sum()), int((~toxic).sum())
        if bad and good and telling:
            a, b = np.bincount(at, toxic[owner], len(self.names)), np.bincount(at, ~toxic[owner], len(self.names))
            share = (a + b) / (bad + good)
            chi = (a / bad - b / good) ** 2 / (share * (1 - share) * (1 / bad + 1 / good) + 1e-12)
            self.value *= (chi + 0.01) ** telling
        weight = (1 + np.log(examples.counts)) * self.value[at]
        norm = np.sqrt(np.bincount(owner, weight**2, len(examples.ids)))
        weight /= np.where(norm > 0, norm, 1)[owner]
        # examples of one label whose heaviest term is the same stand together, so that blocks differ in what they can score
        heaviest = np.full(len(examples.ids), -1)
        rising = np.argsort(weight, kind="stable")
        heaviest[owner[rising]] = at[rising]
        order = np.lexsort((heaviest, examples.toxic))
        place = np.argsort(order)
        self.ids, self.toxic, self.stands = [examples.ids[i] for i in order], examples.toxic[order], examples.stands[order]
        self.blocks = -(-max(1, len(order)) // BLOCK)
        owner, by = place[owner], np.lexsort((place[owner], at))
        at, self.owner, self.weight = at[by], owner[by].astype(np.int32), weight[by]
        self.start = np.searchsorted(at, np.arange(len(self.names) + 1))
        shared = np.flatnonzero(np.diff(self.start) >= max(BLOCK, SHARED * len(order)))
        self.column = np.full(len(self.names), -1, np.int32)
        self.column[shared] = np.arange(len(shared))
        self.columns = len(shared)
        total = self.stands.sum()
        prior = float((self.stands * self.toxic).sum() / total) if total else 0.0
        blank = self.stands * (examples.size[order] == 0)
        self.base, self.prior = float(((blank * self.toxic).sum() + prior) / (blank.sum() + 1)), prior
        self.map = np.array([[0.0, 1.0], [0.0, 1.0]])

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("dense", "most")}  # made anew by each worker

    def __getattr__(self, name: str) -> np.ndarray:
        """dense: (blocks, BLOCK, columns) weights of the shared terms; most: the largest in each block."""
        if name not in ("dense", "most"):
            raise AttributeError(name)
        term = np.repeat(self.column, np.diff(self.start))
        often = term >= 0
        flat = np.zeros((self.blocks * BLOCK, self.columns))
        flat[self.owner[often], term[often]] = self.weight[often]
        self.dense = flat.reshape(self.blocks, BLOCK, self.columns)
        self.most = self.dense.max(axis=1)
        return self.__dict__[name]

    def nearest(self, texts: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS, first: int = 4) -> list[list[tuple[float, int]]]:
        """For each of texts (terms, counts) the k examples of highest positive cosine (ties: the earlier), exactly.

        Rare terms are added up from their lists; what the shared terms can add is bounded for each block. A text
        opens its `first` best blocks, and then all blocks whose bound reaches the k-th score found in those.
        """
        n, room = len(texts), self.blocks * BLOCK
        if not len(self.names):
            return [[] for _ in texts]
        size = np.array([len(t) for t, _ in texts])
        who, terms, counts = np.repeat(np.arange(n), size), np.concatenate([t for t, _ in texts]), np.concatenate([c for _, c in texts])
        at = np.minimum(np.searchsorted(self.names, terms), len(self.names) - 1)
        held = self.names[at] == terms
        who, at = who[held], at[held]
        x = (1 + np.log(counts[held])) * self.value[at]
        x /= np.sqrt(np.bincount(who, x**2, n))[who]
        column = self.column[at]
        often, query = column >= 0, np.zeros((n, self.columns))
        query[who[often], column[often]] = x[often]
        rare = at[~often]
        lo, many = self.start[rare], self.start[rare + 1] - self.start[rare]
        places = np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())
        score = np.bincount(np.repeat(who[~often] * room, many) + self.owner[places], np.repeat(x[~often], many) * self.weight[places], n * room).reshape(n, self.blocks, BLOCK)
        bound = score.max(axis=2) + query @ self.most.T
        opened = np.zeros(bound.shape, bool)

        def open_(wanted: np.ndarray) -> None:
            wanted &= ~opened & (bound > 0)
            for b in np.flatnonzero(wanted.any(axis=0)):
                rows = np.flatnonzero(wanted[:, b])
                score[rows, b] += query[rows] @ self.dense[b].T
            np.logical_or(opened, wanted, out=opened)

        begin = np.zeros(bound.shape, bool)
        np.put_along_axis(begin, np.argpartition(-bound, min(first, self.blocks) - 1, axis=1)[:, :first], True, 1)
        open_(begin)
        seen = np.where(opened[:, :, None], score, 0.0).reshape(n, room)
        kth = np.partition(seen, room - min(k, room), axis=1)[:, room - min(k, room)]
        open_(bound >= kth[:, None] - 1e-12)
        final = np.round(np.where(opened[:, :, None], score, 0.0).reshape(n, room), 12)
        kth = np.partition(final, room - min(k, room), axis=1)[:, room - min(k, room)]
        row, e = np.nonzero((final >= kth[:, None]) & (final > 0))
        order = np.lexsort((e, -final[row, e], row))
        row, e = row[order], e[order]
        ends = np.searchsorted(row, np.arange(n + 1))
        return [[(float(final[i, j]), int(j)) for j in e[ends[i] : min(ends[i] + k, ends[i + 1])]] for i in range(n)]

    def votes(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float | None, list[tuple[float, int]]]]:
        """The neighbours' votes by cosine for toxic, 0 to 1 (None without neighbours), and the neighbours."""
        out = []
        for i in range(0, len(texts), 64):
            for near in self.nearest(texts[i : i + 64]):
                who = [e for _, e in near]
                w = np.array([c for c, _ in near]) * self.stands[who]
                out.append((float(((w * self.toxic[who]).sum() + 0.05 * self.prior) / (w.sum() + 0.05)) if near else None, near))
        return out

    def scores(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, list[tuple[float, int]]]]:
        """The calibrated chance of toxic; texts without neighbours get the share among examples without words."""
        return [(round(self.base if vote is None else float(np.interp(vote, *self.map)), 9), near) for vote, near in self.votes(texts)]


def monotone(votes: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Knots (votes, chances) of the nearest rising map from votes to labels, by pooling neighbours that fall; one row of weight is spread over each pool."""
    pools: list[list[float]] = []  # weight, weighted label, weighted vote
    share = float((weight * toxic).sum() / weight.sum())
    for i in np.argsort(votes, kind="stable"):
        pools.append([weight[i], weight[i] * toxic[i], weight[i] * votes[i]])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    x, y = np.array([p[2] / p[0] for p in pools]), np.array([(p[1] + share) / (p[0] + 1) for p in pools])
    return np.array([x, np.maximum.accumulate(y)])


def learnable(doc_id) -> F.Column:
    """Labels are learned only from these rows: crc32 of the id as text, modulo 4, is not 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2, F.lit(False))


def _examples(docs: DataFrame, labels: DataFrame, examples: int) -> Examples:
    known = labels.where(learnable(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    kind = dict(docs.dtypes)["doc_id"]
    text = F.coalesce("text", F.lit(""))
    keys = docs.where("doc_id is not null").select("doc_id", F.md5(text.cast("binary")).alias("key"))
    copies = cut(keys.join(known, "doc_id").groupBy("key").agg(F.max("toxic").alias("toxic"), F.min("doc_id").alias("doc_id")), "labelled")
    total = {r[0]: r[1] for r in copies.groupBy("toxic").count().collect()}  # two rows
    chosen = None
    for y in total:
        own = copies.where(F.col("toxic") == y).orderBy(F.xxhash64(F.lit("toxic"), "key"), "key").limit(examples)
        chosen = own if chosen is None else chosen.union(own)
    none = np.zeros(0)
    if chosen is None:
        return Examples([], none, none, none.astype(int), none.astype(np.int64), none.astype(np.int64))

    def read(batches):
        for b in batches:
            got = [terms_of(x) for x in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "toxic": b["toxic"], "key": b["key"], "terms": [t.tobytes() for t, _ in got], "counts": [c.tobytes() for _, c in got]})

    rows = docs.select("doc_id", "text", F.md5(text.cast("binary")).alias("key")).join(F.broadcast(cut(chosen, "chosen")), ["doc_id", "key"])  # at most 2 * examples short rows
    read_rows = rows.mapInPandas(read, f"doc_id {kind}, toxic int, key string, terms binary, counts binary")
    rows = cut(read_rows.dropDuplicates(["key"]), "examples").orderBy("key").collect()  # at most 2 * examples
    sizes = Counter(r["toxic"] for r in rows)
    # each label's examples stand for as many texts as the label has
    stands = np.array([total[r["toxic"]] / sizes[r["toxic"]] for r in rows])
    size = np.array([len(r["terms"]) // 8 for r in rows], int)
    join = lambda c: np.frombuffer(b"".join(r[c] for r in rows), np.int64)
    return Examples([r["doc_id"] for r in rows], np.array([float(r["toxic"]) for r in rows]), stands / max(1e-9, stands.max(initial=0)), size, join("terms"), join("counts"))


def fit_toxicity(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, telling: float = 1.0) -> Index:
    """The index and its map, from labels (doc_id, toxic) of learnable rows; `examples` of each label bound its size.

    Document frequencies are counted over all of docs. Rows with a null id or label teach
    nothing; an id or a text with both labels counts as toxic; copies of a text and repeated
    rows teach once. Without examples every text scores 0.
    """
    sample = _examples(docs, labels, examples)
    names = np.unique(sample.terms)
    if not len(names):
        return Index(sample, (names, names), 0, telling)

    def frequencies(batches):
        seen, rows = np.zeros(len(names), np.int64), 0
        for b in batches:
            rows += len(b)
            for x in b["text"]:
                own, _ = terms_of(x)
                at = np.minimum(np.searchsorted(names, own), len(names) - 1)
                seen[at[names[at] == own]] += 1
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"term": np.append(at, -1), "n": np.append(seen[at], rows)})

    counted = docs.select("text").mapInPandas(frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()  # a row for each term of the sample
    docs_n = int(counted.loc[counted["term"] < 0, "n"].sum())
    counted = counted[counted["term"] >= 0].sort_values("term")
    df = names[counted["term"].to_numpy()], counted["n"].to_numpy()
    index = Index(sample, df, docs_n, telling)
    fold = np.arange(len(sample.ids)) % FOLDS
    votes = np.full(len(fold), np.nan)
    ends = np.cumsum(sample.size)[:-1]
    texts = list(zip(np.split(sample.terms, ends), np.split(sample.counts, ends), strict=True))
    for k in range(FOLDS):  # each example is scored by a model that never saw it or its label
        own = np.flatnonzero(fold == k)
        other = Index(sample.take(np.flatnonzero(fold != k)), df, docs_n, telling)
        votes[own] = [np.nan if vote is None else vote for vote, _ in other.votes([texts[i] for i in own])]
        del other
    told = ~np.isnan(votes)
    if told.any():
        index.map = monotone(votes[told], sample.toxic[told], sample.stands[told])
    return index


def score_column(index: Index, text: str = "text", kind: str = "bigint"):
    """struct(score, neighbours): the score and the nearest examples (doc_id, cosine, label) that it rests on."""

    @F.pandas_udf(f"score double, neighbours array<struct<doc_id:{kind},cosine:double,label:int>>")
    def score(texts: pd.Series) -> pd.DataFrame:
        key = [hashlib.md5((x or "").encode("utf-8", "replace")).digest() for x in texts]
        once = dict(zip(key, texts, strict=True))  # copies in a batch are scored once
        found, distinct = {}, list(once)
        for i in range(0, len(distinct), 64):
            own = distinct[i : i + 64]
            found.update(zip(own, index.scores([terms_of(once[k]) for k in own]), strict=True))
        got = [found[k] for k in key]
        return pd.DataFrame({"score": [s for s, _ in got], "neighbours": [[{"doc_id": index.ids[e], "cosine": c, "label": int(index.toxic[e])} for c, e in near] for _, near in got]})

    return score(text)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **bounds) -> DataFrame:
    """Returns doc_id, held_out (its label is never learned), score (0 to 1), predicted, neighbours for each row of docs.

    Null and empty texts, and those that share no word with an example, get the share of
    toxic ones among examples without words. Rows that repeat score alike; a null id is not
    held out. Neighbours of equal cosine: in order of the index. Other columns are ignored.
    """
    kind = dict(docs.dtypes)["doc_id"]
    index = fit_toxicity(docs, labels, **bounds)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)).alias("held_out")
    scored = docs.select("doc_id", held, score_column(index, kind=kind).alias("s"))
    return scored.select("doc_id", "held_out", F.col("s.score").alias("score"), (F.col("s.score") >= threshold).cast("int").alias("predicted"), F.col("s.neighbours").alias("neighbours"))


def clean_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **bounds) -> DataFrame:
    """The rows of docs, whole and with all their columns, that score below the threshold.

    Nulls, repeats and empty tables as in score_toxicity: without examples every row stays.
    """
    return docs.where(score_column(fit_toxicity(docs, labels, **bounds), kind=dict(docs.dtypes)["doc_id"])["score"] < threshold)
