"""Importance resampling towards a target text by hashed word runs, scanned by Aho-Corasick.

A task takes its texts in slices and makes a dictionary of each slice: its distinct words,
bounded by delimiters, each with its CRC-32 and its length as payload. The automaton of
those words scans the slice's texts and emits the payloads in order; the CRC of a run of
words is composed from the payloads of neighbours, never from characters. Words too long
for the dictionary are hashed where the scan leaves a gap. CRCs modulo the number of bins
are a document's features. They are written once, counted in a grouped sum, and scored by
the gains of the bins, which are all that the driver and every task hold.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelmill.llm.common import cut, words_alnum
from labelmill.llm.mixing import ordinal

#: Bytes of text that share a dictionary, and the longest word that it takes.
SLICE, LONGEST = 1 << 20, 64
_POLYNOMIAL = 0xEDB88320


def spelled(words: list[bytes]) -> str:
    """Words, each between single blanks, a character for each byte."""
    return b" ".join([b"", *words, b""]).decode("latin-1")


@dataclass
class Dictionary:
    """An automaton that finds words where blanks bound them, and the payload of each: its CRC-32 and its length."""

    automaton: ahocorasick.Automaton
    crc: np.ndarray
    size: np.ndarray


def dictionary(words: set[bytes]) -> Dictionary | None:
    found, own = ahocorasick.Automaton(ahocorasick.STORE_INTS), [w for w in words if len(w) <= LONGEST]
    for i, w in enumerate(own):
        found.add_word(f" {w.decode('latin-1')} ", i)
    if not own:
        return None
    found.make_automaton()
    return Dictionary(found, np.fromiter(map(zlib.crc32, own), np.int64, len(own)), np.fromiter(map(len, own), np.int64, len(own)))


def scan(known: Dictionary | None, text: str) -> tuple[np.ndarray, np.ndarray]:
    """The CRC-32 and the length of each word of a spelled text, in order."""
    none = np.zeros(0, np.int64)
    load = np.fromiter([v for _, v in known.automaton.iter(text)], np.int64) if known else none
    crc, size = (known.crc[load], known.size[load]) if known else (none, none)
    if size.sum() + len(size) == len(text) - 1:
        return crc, size
    end = np.fromiter([e for e, _ in known.automaton.iter(text)], np.int64) if known else none  # some words are not in the dictionary
    start, after, before = end - size, np.concatenate([[0], end]) + 1, np.append(end - size, len(text))
    missed = [(int(a) + i, w) for a, b in zip(after, before, strict=True) if b > a for i, w in _words(text[a : b - 1])]
    start = np.concatenate([start, [a for a, _ in missed]])
    crc = np.concatenate([crc, [zlib.crc32(w.encode("latin-1")) for _, w in missed]])
    size = np.concatenate([size, [len(w) for _, w in missed]])
    order = start.argsort(kind="stable")
    return crc[order], size[order]


def _words(line: str) -> list[tuple[int, str]]:
    out, at = [], 0
    for w in line.split(" "):
        if w:
            out.append((at, w))
        at += len(w) + 1
    return out


def _shift_tables(bits: int = 48) -> list[np.ndarray]:
    """For each power of two, what a CRC register's 32 bits become under so many zero bytes."""
    out = []
    one = np.zeros(32, np.uint64)
    for i in range(32):
        v = 1 << i
        for _ in range(8):
            v = v >> 1 ^ (_POLYNOMIAL if v & 1 else 0)
        one[i] = v
    for _ in range(bits):
        out.append(one)
        one = _apply(one, one)
    return out


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    out = np.zeros(len(crc), np.uint64)
    for i in range(32):
        out ^= np.where(crc >> np.uint64(i) & np.uint64(1), table[i], np.uint64(0))
    return out


_SHIFTS = _shift_tables()


def composed(crc: np.ndarray, then: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of two strings in a row, from that of each and the second's length."""
    crc, bit = crc.astype(np.uint64), 0
    while (size >> bit).any():
        crc = np.where(size >> bit & 1, _apply(_SHIFTS[bit], crc), crc)
        bit += 1
    return crc ^ then.astype(np.uint64)


def runs(crc: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """The CRC-32 of all runs of 1 to `width` words joined by a blank, from the words' payloads."""
    out, blank = [crc.astype(np.uint64)], np.full(len(crc), zlib.crc32(b" "), np.uint64)
    spaced, longer = composed(blank, crc, size) if width > 1 else blank, out[0]
    for n in range(1, min(width, len(crc))):
        longer = composed(longer[:-1], spaced[n:], size[n:] + 1)
        out.append(longer)
    return np.concatenate(out)


def _pieces(words: list[bytes]) -> list[list[bytes]]:
    """Words in pieces of about SLICE bytes."""
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    at = [0, *np.unique(np.searchsorted(ends, np.arange(SLICE, int(ends[-1]) if len(ends) else 0, SLICE)) + 1).tolist(), len(words)]
    return [words[a:b] for a, b in zip(at, at[1:], strict=False)]


def features(texts: list[str | None], width: int, bins: int) -> list[tuple[int, np.ndarray]]:
    """For each text: its number of words, and the bins of all its runs of 1 to `width` words."""
    own: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in texts]
    line: list[tuple[int, str]] = []
    words: set[bytes] = set()

    def flush() -> None:
        found = dictionary(words)
        for i, piece in line:
            own[i].append(scan(found, piece))
        line.clear()
        words.clear()

    room = 0
    for i, text in enumerate(texts):
        for piece in _pieces(words_alnum(text)):
            line.append((i, spelled(piece)))
            words.update(piece)
            room += len(line[-1][1])
            if room > SLICE:
                flush()
                room = 0
    flush()
    out = []
    for parts in own:
        crc, size = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        out.append((len(crc), (runs(crc, size, width) % np.uint64(bins)).astype("<u4")))
    return out


def scanned(texts: DataFrame, width: int, bins: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, n_words, n_features and the bins (binary, 2 bytes each where they fit) for each row of texts (keys, text)."""
    kind = "<u2" if bins <= 1 << 16 else "<u4"

    def read(batches):
        for whole in batches:
            for i in range(0, len(whole), 256):
                b = whole.iloc[i : i + 256]
                got = features(list(b["text"]), width, bins)
                yield pd.DataFrame({**{k: b[k] for k in keys}, "n_words": [n for n, _ in got], "n_features": [len(x) for _, x in got], "bins": [x.astype(kind).tobytes() for _, x in got]})

    schema = T.StructType([*[texts.schema[k] for k in keys], T.StructField("n_words", T.LongType()), T.StructField("n_features", T.LongType()), T.StructField("bins", T.BinaryType())])
    return texts.select(*keys, "text").mapInPandas(read, schema)


def counted(rows: DataFrame, bins: int) -> np.ndarray:
    """How often each bin occurs: a row for each bin and task is shuffled, one for each bin collected."""
    kind = "<u2" if bins <= 1 << 16 else "<u4"

    def count(batches):
        total = np.zeros(bins, np.int64)
        for b in batches:
            total += np.bincount(np.frombuffer(b"".join(b["bins"]), kind), minlength=bins)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bin": at, "n": total[at]})

    out = np.zeros(bins, np.int64)
    for r in rows.select("bins").mapInPandas(count, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        out[r["bin"]] = r["n"]
    return out


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Per bin floor(1000 ln of the smoothed share in the target over that in the source)."""
    bins, t_all, s_all = len(source), float(target.sum()), float(source.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + bins) / ((s + 1.0) * (t_all + bins)))) for t, s in zip(target.tolist(), source.tolist(), strict=True)], np.int64)


def importance_sample(docs: DataFrame, target: DataFrame, width: int = 1, bins: int = 10_000, least_words: int = 20, percent: int = 10, seed: str = "2024:") -> DataFrame:
    """Returns doc_id, n_words, n_features, weight, score and rank (null where not drawn) for each row of docs.

    weight sums the gains of a text's features; score adds Gumbel noise fixed by seed and
    doc_id. Of the rows with `least_words` words or more, floor(percent * rows / 100) of
    highest score are drawn, ties to the smaller doc_id. Null and blank texts have no
    features and weight 0; a null id is hashed as empty text and loses ties; rows that
    repeat each stand for themselves. An empty target leaves constant smoothing. Other
    columns of both tables are ignored; an empty table gives an empty one.
    """
    rows = cut(scanned(docs, width, bins, ("doc_id",)), "features")
    gain = gains(counted(scanned(target, width, bins), bins), counted(rows, bins))
    kind = "<u2" if bins <= 1 << 16 else "<u4"

    @F.pandas_udf(T.LongType())
    def weigh(own: pd.Series) -> pd.Series:
        return pd.Series([int(gain[np.frombuffer(x, kind)].sum()) for x in own], dtype="int64")

    number = F.conv(F.substring(F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((number + 0.5) / 4294967296.0)))
    scored = rows.select("doc_id", "n_words", "n_features", weigh("bins").alias("weight"))
    scored = cut(scored.withColumn("score", F.col("weight") + noise), "scored")
    fit = F.col("n_words") >= least_words
    able = scored.where(fit)
    draw = able.count() * percent // 100
    placed = ordinal(able, [F.desc("score"), F.col("doc_id").asc_nulls_last(), F.asc("n_features")], "place")
    drawn = placed.withColumn("rank", F.when(F.col("place") < draw, F.col("place") + 1)).drop("place")
    return drawn.unionByName(scored.where(~fit).withColumn("rank", F.lit(None).cast("long")))
