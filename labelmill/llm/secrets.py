"""Secret scans by a linear-chain conditional random field.

Tokens (runs of letters and digits, single signs) are tagged outside, begin or inside of a
secret. A token's features are its shape, the tokens around it and the file that it stands
in; all are hashed into one table of weights, so that a token's share in the scores of its
neighbours is computed once for all tokens of equal features. The field is trained on
windows of a bounded sample of the texts, into which made-up secrets and harmless
look-alikes are put; what the base patterns find there counts as secret too; words enter as
features if several windows hold them. Decoding is exact Viterbi: a token
whose score for outside beats the others by more than transitions can ever give back is
outside on every best path, so only the runs between such tokens are searched, many at once.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelmill.llm.common import cut

# Kinds in order, patterns, and the least length of what counts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "field")

#: Texts of the sample, windows trained on, tokens of a window on either side of its middle.
SAMPLE, WINDOWS, REACH = 400, 800, 12
#: Bound of the model: weights of each tag.
SIZE = 1 << 16
#: Windows that a word must stand in to be a feature; distinct tokens that a worker remembers; texts that it decodes at once.
HEARD, REMEMBERED, SLICE = 3, 300_000, 128
OUT, BEGIN, INSIDE = 0, 1, 2

_BLANKS = b" \t\n\r\x0b\x0c"
#: Tokens of UTF-8 text, with the blanks before them: runs of letters, digits and anything beyond ASCII, or single signs.
TOKEN = re.compile(rb"[ \t\n\r\x0b\x0c]*(?:[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff \t\n\r\x0b\x0c])")
#: Words with small letters alone but for the first: all that tells of them is their length, and the word itself if it is a feature.
PLAIN = re.compile(rb"([ \t\n\r\x0b\x0c]*)([A-Za-z\x80-\xff][a-z\x80-\xff]{0,26})\Z")
_SIGNS = frozenset(b"={}[]():;\"'/_<>&|$#")
#: Words of code and settings.
TOLD = {w: i for i, w in enumerate(b"import def class function return const var export env config password token secret key api".split(), 1)}
_KINDS = bytes(1 if 48 <= c <= 57 else 2 if 97 <= c <= 122 else 3 if 65 <= c <= 90 else 4 for c in range(256))
#: Places around a token that it is seen from.
PLACES = (-4, -3, -2, -1, 1, 2)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of what the base patterns find, by start, then kind."""
    low = text.lower()
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN] if any(w in low for w in _NAMES) else []
    found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], s[2]))


@lru_cache(1 << 16)
def hashed(name: str) -> int:
    return zlib.crc32(name.encode()) % SIZE


def seen_from(shown: np.ndarray, place: int) -> np.ndarray:
    """The features that tokens show (hashed), as the token sees them that they stand `place` places after."""
    return (shown * 40503 + place * 7919) % SIZE


def word_of(token: bytes) -> bytes:
    return token.lstrip(_BLANKS).lower()[:24]


@lru_cache(1 << 14)
def _plain(stuck: str, n: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
    return tuple(map(hashed, (f"plain {n}", f"{stuck} plain"))), tuple(map(hashed, (f"plain {min(n, 10)}", f"plain {stuck}")))


def views(token: bytes, words: frozenset[bytes]) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Hashed: a token's own features, and three that it shows its neighbours; words: those that are features."""
    core = token.lstrip(_BLANKS)
    stuck, n, low = "glued" if len(core) == len(token) else "apart", len(core), core.lower()
    word = zlib.crc32(low[:24]) % SIZE if low[:24] in words else hashed("rare")
    if n == 1 and not core.isalnum() and core < b"\x80":
        return (word, hashed(f"sign {stuck}")), (word, hashed(f"sign {core[0]} {stuck}"), hashed("sign"))
    raw = core.translate(_KINDS)
    if PLAIN.match(token):
        own, shown = _plain(stuck, n)
        return (word, *own), (word, *shown)
    runs = re.sub(rb"(.)\1+", rb"\1", raw)
    changes, has = min(len(runs) - 1, 16), "".join(c for c, k in zip("9aA*", b"\1\2\3\4", strict=True) if k in raw)
    long = n if n < 8 else 8 + min((n - 8) // 4, 14)
    short = min(long, 12)
    vowels, spread = sum(map(low.count, (b"a", b"e", b"i", b"o", b"u"))) * 8 // n, len(set(core)) * 4 // min(n, 32)
    few = "hex" if has in ("9a", "9A") and not low.strip(b"0123456789abcdef") else "any"
    own = f"has {has} {long}", f"has {has}", f"runs {runs[:6].hex()}", f"changes {changes} {has}", f"changes {changes} {short}", f"vowels {vowels} {short}", f"spread {spread} {short}", f"few {few} {long}", f"head {core[:4].hex() if core[:4].lower() in words else ''}", f"{stuck} {has}"
    return (word, *map(hashed, own)), (word, hashed(f"has {has} {min(long, 10)}"), hashed(f"has {has} {stuck}"))


def flags(token: bytes) -> tuple[bool, bool, int]:
    """Whether a token is a sign that code uses, whether it ends in a digit, and which of TOLD it is (from 1; 0: none)."""
    return token[-1] in _SIGNS, 48 <= token[-1] <= 57, TOLD.get(word_of(token), 0)


def file_features(n: int, signs: int, digits: int, told: list[int]) -> list[int]:
    """What a whole text tells of each of its n tokens: how long it is, its signs and digits, and words that code and settings use."""
    many = max(1, n)
    return [hashed(f"file {x}") for x in (f"long {n.bit_length()}", f"signs {signs * 16 // many}", f"digits {digits * 16 // many}", *[f"told {x}" for x in sorted(told)])]


def tagged(tokens: list[bytes], spans: list[tuple[int, int]]) -> list[int]:
    """The tag of each token: of those that touch a span (in bytes) the first begins it."""
    out, at, begun = [OUT] * len(tokens), 0, {}
    spans = sorted(spans)
    for i, t in enumerate(tokens):
        end = at + len(t)
        start = end - len(t.lstrip(_BLANKS))
        for k, (a, b) in enumerate(spans):
            if a < end and start < b:
                out[i] = INSIDE if k in begun else BEGIN
                begun[k] = i
                break
        at = end
    return out


def telling_spans(text: str) -> list[tuple[int, int]]:
    """The secrets within what the base patterns find: values that hold letters and digits (code points)."""
    found = [(m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    found += [(a, b) for a, b, kind in base_spans(text) if kind]
    found = sorted((a, b) for a, b in found if re.search("[0-9]", text[a:b]) and re.search("[A-Za-z]", text[a:b]))
    return [s for i, s in enumerate(found) if not i or s[0] >= found[i - 1][1]]


# Made-up training data. SECRETS: where secrets stand; HARMLESS: look-alikes that are none.
SECRETS = ['password = "{}"', "passwd: {}", "secret={}", "token: '{}'", '"api_key": "{}"', "apikey={}", "Authorization: Bearer {}", "aws_secret_access_key = {}", "AWS_ACCESS_KEY_ID={}", "https://user:{}@example.org/", "postgres://admin:{}@db:5432/main", "client_secret: {}", "pwd={};", "PRIVATE_KEY={}", "auth {}", "x-api-key: {}", "export GITHUB_TOKEN={}", "mot de passe : {}", "contraseña: {}", "{}"]
HARMLESS = ["call {} today", "card {}", "version {}", "token = {}", "password: {}", "see {}", "https://example.org/{}", "on {}", "id {}", "colour {}", "{} items", "write to {}", "{}", "secret {}", "the key {} is"]
_ALNUM = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _draw(rng, letters: str, n: int) -> str:
    return "".join(letters[i] for i in rng.integers(0, len(letters), n))


def made_secret(rng) -> str:
    kind = int(rng.integers(9))
    if kind == 0:
        return _draw(rng, "0123456789abcdef", int(rng.choice([32, 40, 64])))
    if kind == 1:
        return _draw(rng, _ALNUM + "+/", int(rng.integers(20, 48))) + "=" * int(rng.integers(3))
    if kind == 2:
        return "AKIA" + _draw(rng, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16)
    if kind == 3:
        return str(rng.choice(["ghp_", "sk-", "xoxb-", "glpat-", "pk_live_", "AIza", "npm_"])) + _draw(rng, _ALNUM, int(rng.integers(20, 48)))
    if kind == 4:
        return "eyJ" + ".".join(_draw(rng, _ALNUM + "-_", int(n)) for n in rng.integers(16, 40, 3))
    if kind == 5:
        return "-".join(_draw(rng, _ALNUM, int(n)) for n in rng.integers(6, 14, int(rng.integers(2, 5))))
    return _draw(rng, _ALNUM, int(rng.integers(12, 44)))


def made_harmless(rng, words: list[str]) -> str:
    number = lambda n: _draw(rng, "0123456789", n)
    word = lambda: str(words[int(rng.integers(len(words)))])
    kind = int(rng.integers(11))
    return [
        lambda: number(16), lambda: f"+{number(2)} {number(3)} {number(7)}", lambda: ".".join(map(str, rng.integers(0, 20, 3))), lambda: f"20{number(2)}-0{number(1)}-1{number(1)}", lambda: "#" + _draw(rng, "0123456789abcdef", 6),
        lambda: f"{word()}_{word()}_{word()}", lambda: word().title() + word().title() + word().title(), lambda: f"{word()}.{number(2)}@mail.example.com", lambda: "/".join([word(), word(), word() + number(1)]), lambda: word() * 2, lambda: number(5),
    ][kind]()


#: Tokens, their tags, and the features of the whole text.
Window = tuple[list[bytes], list[int], list[int]]


def windows(text: str, key: int, many: int) -> list[Window]:
    """Training windows of a text; key fixes where and what is put in."""
    tokens = TOKEN.findall(text.encode("utf-8", "replace"))
    told = [flags(t) for t in tokens]
    about = file_features(len(tokens), sum(x for x, _, _ in told), sum(x for _, x, _ in told), list({x for *_, x in told} - {0}))
    words = [w for t in tokens[:2000] if (w := t.strip(_BLANKS).decode()).isalpha()] or ["word"]
    starts = np.cumsum([0, *(len(t.decode()) for t in tokens)])
    found = telling_spans(text)
    out = []
    for j in range(many):
        rng = np.random.default_rng([key & 0xFFFFFFFF, j])
        real = bool(found) and j % 4 == 3  # a window around what the base patterns find, as it stands
        mid = int(np.searchsorted(starts, found[int(rng.integers(len(found)))][0])) if real else int(rng.integers(len(tokens) + 1))
        a, b = max(0, mid - REACH), min(len(tokens), mid + REACH)
        left, right, own = text[starts[a] : starts[mid]], text[starts[mid] : starts[b]], []
        whole = left + right
        if not real:
            secret = j % 2 == 0
            frame = str(rng.choice(SECRETS if secret else HARMLESS))
            value = made_secret(rng) if secret else made_harmless(rng, words)
            at = len(left) + 1 + frame.index("{}")
            own = [(at, at + len(value))] if secret else []
            whole, put = f"{left} {frame.replace('{}', value)} {right}", (len(left), len(left) + len(frame) + len(value))
            own += [s for s in telling_spans(left) if s[1] < put[0]] + [(x + len(whole) - len(right), y + len(whole) - len(right)) for x, y in telling_spans(right)]
        else:
            own = telling_spans(whole)
        raw = lambda i: len(whole[:i].encode("utf-8", "replace"))  # noqa: B023, E731
        made = TOKEN.findall(whole.encode("utf-8", "replace"))
        out.append((made, tagged(made, [(raw(x), raw(y)) for x, y in own]), about))
    return out


class _Rows(dict):
    """Token to row number; tokens of equal features share a row. Features of new rows wait in `new`."""

    def __init__(self, words: frozenset[bytes]):
        self.words, self.classes, self.plain, self.new = words, {}, {}, []
        self[b""] = self._row(((), (), (False, False, 0)))

    def _row(self, kind: tuple) -> int:
        if kind not in self.classes:
            self.classes[kind] = len(self.classes)
            self.new.append(kind)
        return self.classes[kind]

    def __missing__(self, token: bytes) -> int:
        plain = PLAIN.match(token)
        if plain and (low := plain[2].lower()[:24]) not in self.words and low not in TOLD:  # nothing but its length and its blanks tell
            key = not plain[1], len(plain[2])
            if key not in self.plain:
                self.plain[key] = self._row((*views(token, self.words), flags(token)))
            row = self.plain[key]
        else:
            row = self._row((*views(token, self.words), flags(token)))
        self[token] = row
        return row


@dataclass
class Field:
    """weights: (SIZE, 3) of hashed features, 0 for outside; moves: (3, 3) of one tag after the other; words that are features. Texts begin and end outside."""

    weights: np.ndarray
    moves: np.ndarray
    words: frozenset[bytes] = frozenset()
    _rows: _Rows | None = field(default=None, repr=False)
    _scores: np.ndarray | None = field(default=None, repr=False)
    _flags: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "moves": self.moves, "words": self.words, "_rows": None, "_scores": None, "_flags": None}

    def _known(self, tokens: list[bytes]) -> np.ndarray:
        """A row number for each token; rows hold a token's share in the scores of itself and its neighbours. Row 0: what stands beyond a text's ends."""
        if self._rows is None or len(self._rows) > REMEMBERED:
            self._rows = _Rows(self.words)
            self._scores, self._flags = np.zeros((0, 1 + len(PLACES), 2)), np.zeros((0, 3), np.int64)
        row = np.fromiter(map(self._rows.__getitem__, tokens), np.int64, len(tokens))
        if new := self._rows.new:
            made = np.zeros((len(new), 1 + len(PLACES), 2))
            for i, (own, shown, _) in enumerate(new):
                if own:
                    made[i, 0] = self.weights[list(own), 1:].sum(axis=0)
                    made[i, 1:] = self.weights[seen_from(np.array(shown), np.array(PLACES)[:, None]), 1:].sum(axis=1)
            self._scores, self._flags = np.concatenate([self._scores, made]), np.concatenate([self._flags, np.array([f for *_, f in new], np.int64)])
            new.clear()
        return row

    def scores(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """(n, 2) scores of begin and inside against outside for all tokens of the texts in a row, and the number of the first token of each text."""
        gap = max(map(abs, PLACES))
        line, first = [b""] * gap, []
        for tokens in texts:
            first.append(len(line))
            line += tokens
            line += [b""] * gap
        row = self._known(line)
        out, told = self._scores[row, 0], self._flags[row]
        for k, p in enumerate(PLACES):
            seen = np.zeros_like(row)
            if p < 0:
                seen[-p:] = row[:p]
            else:
                seen[:-p] = row[p:]
            out += self._scores[seen, 1 + k]
        pad = np.ones(len(line), bool)
        for tokens, at in zip(texts, first, strict=True):
            own, end = told[at : at + len(tokens)], at + len(tokens)
            out[at:end] += self.weights[file_features(len(tokens), int(own[:, 0].sum()), int(own[:, 1].sum()), np.unique(own[own[:, 2] > 0, 2]).tolist()), 1:].sum(axis=0)
            pad[at:end] = False
        out[pad] = -1e9  # outside, whatever stands beside
        return out, np.array(first, int)

    def tags(self, score: np.ndarray) -> np.ndarray:
        """The best tags for all tokens, by Viterbi between those that are outside on every best path."""
        m = self.moves
        regained = max(m[p, s] + m[s, q] - m[p, OUT] - m[OUT, q] for p in range(3) for s in (BEGIN, INSIDE) for q in range(3))
        open_ = score.max(axis=1) >= -max(regained, 0.0) - 1e-9
        edge = np.diff(np.concatenate([[0], open_.astype(np.int8), [0]]))
        start, size = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - np.flatnonzero(edge == 1)
        out = np.zeros(len(score), np.int8)
        for n in np.unique(size):
            for own in np.array_split(start[size == n], -(-int((size == n).sum()) // 4096)):
                at = own[:, None] + np.arange(n)
                out[at] = viterbi(np.concatenate([np.zeros((*at.shape, 1)), score[at]], axis=2), m)
        return out

    def spans(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """(start, end) of the secrets in each text, in code points."""
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        tokens = [TOKEN.findall(t) for t in raw]
        score, first = self.scores(tokens)
        tag = self.tags(score)
        out: list[list[tuple[int, int]]] = []
        for whole, own, at in zip(raw, tokens, first, strict=True):
            hit, found = np.flatnonzero(tag[at : at + len(own)]), []
            if len(hit):
                ends = np.cumsum(list(map(len, own)))
                for i in hit.tolist():
                    end = int(ends[i])
                    start = end - len(own[i].lstrip(_BLANKS))
                    if found and tag[at + i] == INSIDE and found[-1][1] == start:
                        found[-1] = (found[-1][0], end)
                    else:
                        found.append((start, end))
                point = lambda i: len(whole[:i].decode("utf-8", "surrogatepass"))  # noqa: B023, E731
                found = [(point(a), point(b)) for a, b in found]
            out.append(found)
        return out


def viterbi(score: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best tags (ties: the smaller) of sequences (rows, n, 3) that have an outside on either side."""
    rows, n, _ = score.shape
    best, back = moves[OUT] + score[:, 0], []
    for i in range(1, n):
        way = best[:, :, None] + moves
        back.append(way.argmax(axis=1))
        best = way.max(axis=1) + score[:, i]
    at = (best + moves[:, OUT]).argmax(axis=1)
    out = np.empty((rows, n), np.int8)
    for i in range(n - 1, -1, -1):
        out[:, i] = at
        if i:
            at = back[i - 1][np.arange(rows), at]
    return out


def _soft(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis)
    return np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis=axis)) + top


def expected(score: np.ndarray, moves: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """By forward and backward sums: chances of each tag (rows, n, 3), expected moves (3, 3), and the sum of log partitions; size: tokens of each row."""
    rows, n, _ = score.shape
    fore, back = np.zeros_like(score), np.zeros_like(score)
    fore[:, 0] = moves[OUT] + score[:, 0]
    for i in range(1, n):
        fore[:, i] = _soft(fore[:, i - 1, :, None] + moves, 1) + score[:, i]
    last = np.arange(n) == (size - 1)[:, None]
    back[:, n - 1] = moves[:, OUT]
    for i in range(n - 2, -1, -1):
        back[:, i] = np.where(last[:, i, None], moves[:, OUT], _soft(moves + (score[:, i + 1] + back[:, i + 1])[:, None, :], 2))
    whole = _soft(fore[np.arange(rows), size - 1] + moves[:, OUT], 1)
    real = np.arange(n) < size[:, None]
    chance = np.where(real[:, :, None], np.exp(np.minimum(fore + back - whole[:, None, None], 0)), 0)
    step = np.exp(np.minimum(fore[:, :-1, :, None] + moves + (score + back)[:, 1:, None, :] - whole[:, None, None, None], 0))
    move = np.where(real[:, 1:, None, None], step, 0).sum(axis=(0, 1))
    move[OUT] += chance[:, 0].sum(axis=0)
    move[:, OUT] += chance[np.arange(rows), size - 1].sum(axis=0)
    return chance, move, float(whole.sum())


def trained(examples: list[Window], rounds: int = 30, rate: float = 0.25, penalty: float = 0.02) -> Field:
    """Maximises the conditional likelihood of the windows' tags (less a penalty on squares) by Adam on all of them."""
    examples = [e for e in examples if e[1]]
    if not examples:
        return Field(np.zeros((SIZE, 3)), np.zeros((3, 3)))
    heard = Counter(w for tokens, *_ in examples for w in {word_of(t) for t in tokens} | {word_of(t)[:4] for t in tokens})
    words = frozenset(w for w, n in heard.items() if n >= HEARD)
    size = np.array([len(e[1]) for e in examples])
    at, ids = [], []  # of each feature: the token (row * n + place) and its weight
    n = int(size.max())
    for r, (tokens, _, about) in enumerate(examples):
        seen = [views(t, words) for t in tokens]
        places, shown = r * n + np.arange(len(seen)), np.array([x for _, x in seen])
        at.append(np.repeat(places, [len(own) + len(about) for own, _ in seen]))
        ids.append(np.array([x for own, _ in seen for x in (*own, *about)]))
        for p in PLACES:
            near = slice(max(0, p), max(0, len(seen) + p)), slice(max(0, -p), max(0, len(seen) - p))
            at.append(np.repeat(places[near[1]], shown.shape[1]))
            ids.append(seen_from(shown[near[0]], p).ravel())
    at, ids = np.concatenate(at), np.concatenate(ids)
    used, ids = np.unique(ids, return_inverse=True)
    tag = np.zeros((len(size), n), int)
    for r, (_, t, _) in enumerate(examples):
        tag[r, : len(t)] = t
    real = np.arange(n) < size[:, None]
    truth = np.eye(3)[tag] * real[:, :, None]
    moved = np.zeros((3, 3))
    for r in range(len(size)):
        own = [OUT, *tag[r, : size[r]].tolist(), OUT]
        np.add.at(moved, (own[:-1], own[1:]), 1)
    w, m = np.zeros((len(used), 3)), np.zeros((3, 3))
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, m)]
    for step in range(1, rounds + 1):
        score = np.stack([np.bincount(at, w[ids, k], len(size) * n) for k in range(3)], axis=1).reshape(len(size), n, 3)
        chance, move, _ = expected(score, m, size)
        left = (truth - chance).reshape(-1, 3)
        grad = np.stack([np.bincount(ids, left[at, k], len(used)) for k in range(3)], axis=1) - penalty * w, moved - move - penalty * m
        for x, g, s in zip((w, m), grad, state, strict=True):
            s[0] = 0.9 * s[0] + 0.1 * g
            s[1] = 0.99 * s[1] + 0.01 * g**2
            x += rate * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.99**step)) + 1e-8)
    weights = np.zeros((SIZE, 3))
    weights[used] = w
    return Field(weights - weights[:, :1], m, words)


def fit_secrets(docs: DataFrame, sample: int = SAMPLE, many: int = WINDOWS) -> Field:
    """The field, trained on `many` windows of the `sample` distinct texts of smallest hash.

    Only hashes meet in one task, and only windows reach the driver, both of bounded number
    and size. Null and blank texts teach nothing; without any text nothing is tagged.
    """
    text = F.coalesce("text", F.lit(""))
    told = docs.where(F.trim(text) != "").select("text", F.xxhash64("text").alias("key"))
    keys = [r[0] for r in told.select("key").distinct().orderBy("key").limit(sample).collect()]
    if not keys:
        return trained([])
    each = -(-many // len(keys))

    def read(batches):
        for b in batches:
            for x, key in zip(b["text"], b["key"], strict=True):
                got = windows(x, key, each)
                yield pd.DataFrame({"key": [key] * len(got), "place": range(len(got)), "tokens": [x for x, *_ in got], "tags": [x for _, x, _ in got], "about": [x for *_, x in got]})

    chosen = cut(told.where(F.col("key") <= keys[-1]).dropDuplicates(["key"]), "secret-sample")
    made = cut(chosen.mapInPandas(read, "key long, place int, tokens array<binary>, tags array<int>, about array<int>"), "secret-windows")
    rows = made.orderBy("key", "place").collect()  # about `many` windows

    return trained([([bytes(t) for t in r["tokens"]], r["tags"], r["about"]) for r in rows])


_HELD: dict[bytes, Field] = {}


def held(model: Field) -> Field:
    """The worker's own copy of a model, so that what it remembers of tokens outlasts a task."""
    key = hashlib.md5(model.weights.tobytes() + model.moves.tobytes()).digest()
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = model
    return _HELD[key]


def told_spans(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in found)


def scan_secrets(docs: DataFrame, model: Field | None = None) -> DataFrame:
    """Returns doc_id, n_assign, n_access, n_hex, base_sha256 and spans (array of struct(kind, start, end)) for each row of docs.

    spans: what the base patterns find and what the field tags (kind `field`, also where a
    base span covers it), by start, then kind; code points, end exclusive. Null texts count
    as empty, empty and blank ones have no spans. Whole texts are read, however long; equal
    texts get equal spans, rows that repeat or have null ids come out like others. Other
    columns are ignored; an empty table gives an empty one.
    """
    model = model or fit_secrets(docs)

    def read(batches):
        own = held(model)
        for whole in batches:
            for i in range(0, len(whole), SLICE):
                b = whole.iloc[i : i + SLICE]
                texts = [x or "" for x in b["text"]]
                base = [base_spans(x) for x in texts]
                all_ = [sorted([*x, *((a, e, 3) for a, e in y)], key=lambda s: (s[0], s[2])) for x, y in zip(base, own.spans(texts), strict=True)]
                count = lambda k: [sum(s[2] == k for s in x) for x in base]  # noqa: B023, E731
                yield pd.DataFrame({"doc_id": b["doc_id"], "n_assign": count(0), "n_access": count(1), "n_hex": count(2), "base_sha256": [hashlib.sha256(told_spans(x).encode()).hexdigest() for x in base], "spans": [[{"kind": KINDS[k], "start": a, "end": e} for a, e, k in x] for x in all_]})

    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in ("n_assign", "n_access", "n_hex")], T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])
    return docs.select("doc_id", "text").mapInPandas(read, schema)
