"""License scans by ordered signature rules.

A rule is a regex over a text's words (lower-cased, single-spaced) with keywords, a
priority and a confidence. Only rules of which a keyword is a word of the text run. Where a
detection's words lie inside those of one with a better priority (or of a longer or
earlier one of the same priority), it is suppressed.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from functools import cache
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelmill.llm.common import words_alnum
from labelmill.llm.license_rules import BASE, CLAUSES, IDENTIFIER_NOTICES, IDENTIFIERS, NAMES, NOTICES

def _table(lines: str) -> list[list[str]]:
    return [[x.strip() for x in line.split(" | ")] for line in lines.strip().splitlines()]


@cache
def rules() -> list[tuple[int, float, str, tuple[str, ...], str]]:
    """(priority, confidence, label, keywords, regex), best priority first: each notice with each name, each place with each identifier, and the clauses."""
    out = [(priority, trust, label, tuple(keys.split()), notice.format(name=name)) for priority, trust, notice in NOTICES for label, keys, name in _table(NAMES)]
    for name in IDENTIFIERS.split():
        words = words_alnum(name)
        form = b" ".join(words).decode()
        out += [(priority, trust, name.lower(), (max(words, key=len).decode(),), place.format(name=form)) for priority, trust, place in IDENTIFIER_NOTICES]
    out += [(int(priority), float(trust), label, tuple(keys.split()), form) for priority, trust, label, keys, form in _table(CLAUSES)]
    return sorted(out, key=lambda r: r[0])


@cache
def _compiled() -> tuple[dict[bytes, list[tuple]], dict[bytes, list[tuple]]]:
    gated, base = defaultdict(list), defaultdict(list)
    for n, (priority, trust, label, keys, form) in enumerate(rules()):
        for key in keys:
            gated[key.encode()].append((priority, n, trust, label, re.compile(rf"(?<= )(?:{form})(?= )".encode())))
    for phrase, label in BASE.items():
        base[max(phrase.split(), key=len).encode()].append((label, re.compile(f"(?<= ){phrase}(?= )".encode())))
    return dict(gated), dict(base)


def suppress(found: list[tuple[int, int, int, int, float, str]]) -> list[tuple[int, int, int, int, float, str]]:
    """Of (priority, first, last, rule, confidence, label), those whose words no better one contains.

    Better: a lower priority; of the same, one that starts earlier or, from the same word, reaches further.
    """
    kept, starts, ends = [], [], []  # ends: the furthest end of any kept interval that starts there or before
    for d in sorted(found, key=lambda d: (d[0], d[1], -d[2], d[3])):
        i = bisect_right(starts, d[1])
        if i and ends[i - 1] >= d[2]:
            continue
        kept.append(d)
        if i == len(starts):
            starts.append(d[1])
            ends.append(max(d[2], ends[-1]) if ends else d[2])
        else:
            starts.insert(i, d[1])
            ends.insert(i, max(d[2], ends[i - 1]) if i else d[2])
            for j in range(i + 1, len(ends)):
                if ends[j] >= d[2]:
                    break
                ends[j] = d[2]
    return kept


def scan_text(text: str | None, gate: bool = True) -> tuple:
    """n_words, n_base, first_word, last_word, base labels, spans (first, last, label, rule, priority, confidence), labels, score. Without the gate all rules run."""
    gated, base = _compiled()
    words = words_alnum(text)
    keys = (gated.keys() | base.keys()).intersection(words)
    if not keys and gate:
        return len(words), 0, None, None, [], [], [], 0.0
    line = b" " + b" ".join(words) + b" "
    at = list(accumulate((len(w) + 1 for w in words), initial=1))
    word = lambda pos: bisect_right(at, pos) - 1
    places, plain = [], set()
    for key in keys & base.keys():
        for label, form in base[key]:
            hits = [word(m.start()) for m in form.finditer(line)]
            places += hits
            plain |= {label} if hits else set()
    due = {rule[1]: rule for key in (keys & gated.keys() if gate else gated) for rule in gated[key]}
    found = [(priority, word(m.start()), word(m.end() - 1), n, trust, label) for priority, n, trust, label, form in due.values() for m in form.finditer(line)]
    kept = sorted(suppress(found), key=lambda d: d[1:4])
    trust = {}
    for d in kept:
        trust[d[5]] = max(trust.get(d[5], 0.0), d[4])
    for label in plain:
        trust[label] = max(trust.get(label, 0.0), 0.7)
    doubt = 1.0
    for label in sorted(trust):
        doubt *= 1 - trust[label]
    spans = [(first, last, label, n, priority, sure) for priority, first, last, n, sure, label in kept]
    return len(words), len(places), min(places, default=None), max(places, default=None), sorted(plain), spans, sorted(trust), round(1 - doubt, 6)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Returns doc_id, n_words, n_base, first_word, last_word, base_labels, spans, labels, score for each row of docs.

    Null and empty texts have no words, labels or places and score 0. Rows that repeat, or
    whose id is null, are scanned like any other. Other columns are ignored.
    """
    span = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in (("first", T.LongType()), ("last", T.LongType()), ("label", T.StringType()), ("rule", T.IntegerType()), ("priority", T.IntegerType()), ("confidence", T.DoubleType()))]))
    long, text = T.LongType(), T.ArrayType(T.StringType())
    made = (("n_words", long), ("n_base", long), ("first_word", long), ("last_word", long), ("base_labels", text), ("spans", span), ("labels", text), ("score", T.DoubleType()))
    names = ["first", "last", "label", "rule", "priority", "confidence"]

    @F.pandas_udf(T.StructType([T.StructField(n, t) for n, t in made]))
    def scan(texts: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([scan_text(x) for x in texts], columns=[n for n, _ in made])
        out["spans"] = [[dict(zip(names, s, strict=True)) for s in spans] for spans in out["spans"]]
        return out.astype({"first_word": "Int64", "last_word": "Int64"})

    return docs.select("doc_id", scan("text").alias("s")).select("doc_id", "s.*")
