"""The few helpers that Spark has no primitive for: Arrow functions on columns, and one on images."""

from __future__ import annotations

import difflib
import hashlib
import heapq
import math
import re
from collections import Counter
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelmill.functions.text import HEADING

# Workers import this module too, where type strings can't be parsed.
_TEXT, _LONG, _INT, _DOUBLE = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


# Tags whose content is not text, and the symbols of the elements.
NOISE_TAGS = ("script", "style", "nav", "header", "footer", "form", "noscript", "aside", "iframe")
ELEMENTS = frozenset(
    """H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr
    Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu
    Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr
    Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og""".split()
)


@lru_cache(512)
def char_places(text: str) -> dict[str, int]:
    """For each character of a text the bits of its places."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return {chr(c): int.from_bytes(np.packbits(codes == c, bitorder="little").tobytes(), "little") for c in np.unique(codes).tolist()}


def common_length(places: dict[str, int], width: int, text: str) -> int:
    """The longest common subsequence of text and the first `width` characters of the text with those places; a step on whole bit rows for each character."""
    full = free = (1 << width) - 1
    for c in text:
        if hit := free & places.get(c, 0):
            free = (free + hit | free - hit) & full
    return width - free.bit_count()


def common_at_least(places: dict[str, int], n: int, text: str, need: int) -> bool:
    """Whether a text of n characters (by places) and another have a common subsequence of `need` characters.

    A first look takes a part of the other text: all but what may stay unmatched must match there, and within a band of
    the first text that unmatched characters may shift it by.
    """
    m = len(text)
    if need > min(n, m):
        return False
    part = min(m, 8 * (m - need) // 2 + 16)
    if part < m and common_length(places, min(n, part + n - need), text[:part]) < part - (m - need):
        return False
    return common_length(places, n, text) >= need


def ratio_from(matcher: difflib.SequenceMatcher, least: float) -> float | None:
    """The matcher's ratio, or None where it is below `least`: its blocks are looked for in the longest ranges first, until those left can't reach it."""
    total, matched, room = len(matcher.a) + len(matcher.b), 0, min(len(matcher.a), len(matcher.b))
    ranges = [(-room, 0, len(matcher.a), 0, len(matcher.b))]
    while ranges:
        if total and 2.0 * (matched + room) / total < least:
            return None
        most, alo, ahi, blo, bhi = heapq.heappop(ranges)
        room += most
        i, j, k = matcher.find_longest_match(alo, ahi, blo, bhi)
        matched += k
        for a, b, c, d in ((alo, i, blo, j), (i + k, ahi, j + k, bhi)) if k else ():
            if a < b and c < d:
                heapq.heappush(ranges, (-min(b - a, d - c), a, b, c, d))
                room += min(b - a, d - c)
    found = 2.0 * matched / total if total else 1.0
    return found if found >= least else None


def difflib_ratio(least: float):
    """A column function of two texts: difflib's ratio, its automatic junk rule included; null where it stays below `least`.

    What difflib matches is a common subsequence, so texts whose longest one is too short are not measured. Marked as not
    deterministic, so that a filter on it is not computed a second time below the shuffle that deals the pairs.
    """

    @F.pandas_udf(_DOUBLE)
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        out, matcher = [], difflib.SequenceMatcher()
        for x, y in zip(a, b, strict=True):
            total = len(x) + len(y)
            if not common_at_least(char_places(x), len(x), y, math.ceil(least * total / 2 - 1e-9)):
                out.append(None)
                continue
            matcher.set_seqs(x, y)
            out.append(ratio_from(matcher, least))
        return pd.Series(out, dtype=float)

    return ratio.asNondeterministic()


#: Characters of the grams in a sketch: texts below SHORT have a sketch of short grams as well, as few long ones survive in them.
SHORT_GRAM, LONG_GRAM, SHORT = 3, 6, 300


def gram_hashes(codes: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hashes of a text's grams, in their order; high bits are the mixed ones."""
    n = max(0, len(codes) - gram + 1)
    h = np.zeros(n, np.uint64)
    for k in range(gram if n else 0):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n] + np.uint64(1)
    return (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)


def gram_bits(codes: np.ndarray, gram: int, width: int) -> bytes:
    """A bit set of `width` (a power of two) for the hashes of a text's grams."""
    bits = np.zeros(width, bool)
    bits[(gram_hashes(codes, gram) >> np.uint64(40)) & np.uint64(width - 1)] = True
    return np.packbits(bits).tobytes()


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


#: A window is WINDOW grams of WINDOW_GRAM characters in a row; high bits of a gram's hash that tell how common it is.
WINDOW_GRAM, WINDOW, ORDER_BITS = 12, 5, 20
#: Windows that a gap between two blocks can break.
BROKEN = WINDOW_GRAM + WINDOW - 2


def gram_order(texts) -> bytes:
    """How many of some texts have a gram, up to 255, by the high bits of its hash: an order from rare to common."""
    n = np.zeros(1 << ORDER_BITS, np.int64)
    for text in texts:
        n[np.unique(gram_hashes(codes_of(text), WINDOW_GRAM) >> np.uint64(64 - ORDER_BITS)).astype(np.int64)] += 1
    return np.minimum(n, 255).astype(np.uint8).tobytes()


def window_grams(text: str, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The grams that are first in the order in some window of a text, in that order, and in how many windows each is.

    A window that two texts share has the same gram in both.
    """
    h = gram_hashes(codes_of(text), WINDOW_GRAM)
    key = (order[(h >> np.uint64(64 - ORDER_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (h >> np.uint64(8))
    m = max(0, len(key) - WINDOW + 1)
    first = key[:m]
    for k in range(1, WINDOW):
        first = np.minimum(first, key[k : k + m])
    return np.unique(first, return_counts=True)


def shared_windows(n: np.ndarray, m: np.ndarray, rare: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """For texts of n and m characters with a difflib ratio of at least `least`: how many windows of the second its matching blocks keep whole, and whether lengths allow the ratio.

    Blocks are as few as few_blocks has it (`rare` is the second text's), and one of k characters keeps k - BROKEN windows.
    """
    need = np.ceil(least * (n + m) / 2 - 1e-9)
    return (need - (np.minimum(n + m - 2 * need, rare) + 1) * BROKEN).astype(np.int64), need <= np.minimum(n, m)


@F.pandas_udf(T.StructType([T.StructField("rare", _LONG), T.StructField("short", T.BinaryType()), T.StructField("long", T.BinaryType())]))
def gram_sketch(texts: pd.Series, widths: pd.Series) -> pd.DataFrame:
    """Of each text: how many of its characters difflib's junk rule lets a block start at, and bit sets of its grams."""
    out = []
    for text, width in zip(texts, widths, strict=True):
        codes = codes_of(text)
        n = len(codes)
        often = np.unique(codes, return_counts=True)[1]
        rare = int(often[often <= n // 100 + 1].sum()) if n >= 200 else n
        out.append((rare, gram_bits(codes, SHORT_GRAM, width) if n < SHORT else None, gram_bits(codes, LONG_GRAM, width)))
    return pd.DataFrame(out, columns=["rare", "short", "long"])


def unpacked(sketches: pd.Series, width: int) -> np.ndarray:
    """Bit sets as rows of 0 and 1; wider ones are folded to `width`."""
    out = np.zeros((len(sketches), width), np.float32)
    for row, bits in zip(out, sketches, strict=True):
        row[:] = np.unpackbits(np.frombuffer(bits, np.uint8)).reshape(-1, width).max(axis=0)
    return out


def few_blocks(n: np.ndarray, m: np.ndarray, rare: np.ndarray, gram: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts of n and m characters with a difflib ratio of at least `least`: how many grams of the first, and of the second, can lie outside the matching blocks, and whether lengths allow the ratio.

    Between two blocks a character of either text is left over. From 200 characters on difflib starts blocks at characters
    that are rare in its second text only (`rare` of them there), but for one at the texts' beginning. So blocks are
    few, and each of k characters keeps k - gram + 1 grams whole.
    """
    need = np.ceil(least * (n + m) / 2 - 1e-9)
    blocks = np.minimum(n + m - 2 * need, rare) + 1
    kept = need - blocks * (gram - 1)
    return np.maximum(n - gram + 1, 0) - kept, np.maximum(m - gram + 1, 0) - kept, need <= np.minimum(n, m)


def chunk_text(text: str | None, max_words: int = 400, min_words: int = 40) -> list[dict]:
    """Chunks (index, section, text, words) of cleaned text: paragraphs packed to max_words under their heading.

    A longer paragraph is packed sentence by sentence; a piece below min_words joins the one before it if both
    have the same section.
    """
    lines = [x for x in (text or "").replace("\r\n", "\n").replace("\r", "\n").split("\n") if not re.fullmatch(r"\s*\d{1,4}\s*", x)]
    tidy = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", "\n".join(lines))).strip()
    pieces: list[tuple[str | None, list[str], str]] = []  # section, parts, glue
    section, room = None, 0
    for para in filter(None, map(str.strip, tidy.split("\n\n"))):
        if 2 <= len(para) <= 80 and "\n" not in para and re.match(HEADING, para) and para[-1] not in ".,;":
            section, room = para, 0
            continue
        n = len(para.split())
        if n > max_words:
            left = 0
            for s in re.split(r"(?<=[.!?])\s+", para):
                k = len(s.split())
                if left < k or left == max_words:
                    pieces.append((section, [], " "))
                    left = max_words
                pieces[-1][1].append(s)
                left = max(0, left - k)
            room = 0
        else:
            if n > room:
                pieces.append((section, [], "\n\n"))
                room = max_words
            pieces[-1][1].append(para)
            room -= n
    out: list[dict] = []
    for head, parts, glue in pieces:
        body = glue.join(parts)
        n = len(body.split())
        if out and n < min_words and out[-1]["section"] == head:
            out[-1]["text"] += "\n\n" + body
            out[-1]["words"] += n
        else:
            out.append({"index": len(out), "section": head, "text": body, "words": n})
    return out


@F.pandas_udf(T.ArrayType(_struct(index=_INT, section=_TEXT, text=_TEXT, words=_INT)))
def chunks(texts: pd.Series) -> pd.Series:
    return texts.map(chunk_text, na_action=None)


_TOKEN = re.compile("[a-z0-9]+")


@lru_cache(1 << 17)
def token_bucket(token: str, dim: int) -> int:
    """First 64 bits of the token's sha-256, unsigned, modulo dim."""
    return int.from_bytes(hashlib.sha256(token.encode()).digest()[:8], "big") % dim


def bucket_counts(dim: int):
    """A column function of lower-cased text: its buckets of tokens and how many tokens each has, as two arrays; each distinct token is hashed once."""

    @F.pandas_udf(_struct(b=T.ArrayType(_INT), n=T.ArrayType(_LONG)))
    def counts(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            found = Counter()
            for token, n in Counter(_TOKEN.findall(text or "")).items():
                found[token_bucket(token, dim)] += n
            out.append((list(found), list(found.values())))
        return pd.DataFrame(out, columns=["b", "n"])

    return counts


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.parts, self.mute, self.in_title = None, [], [], False

    def handle_starttag(self, tag, attrs):
        if tag in NOISE_TAGS:
            self.mute.append(tag)
        self.in_title = tag == "title" and self.title is None

    def handle_endtag(self, tag):
        if tag in self.mute:
            while self.mute.pop() != tag:
                pass
        if tag == "title":
            self.in_title = False

    def handle_data(self, data):
        if self.in_title:
            self.title = (self.title or "") + data
        if not self.mute:
            self.parts.append(data)


def page_text(page: str | None) -> tuple[str | None, str]:
    """(title, text): lines of text outside NOISE_TAGS and comments, stripped, without empty ones."""
    p = _Page()
    p.feed(page or "")
    p.close()
    lines = (x.strip() for part in p.parts for x in part.splitlines())
    return p.title and p.title.strip(), "\n".join(x for x in lines if x)


@F.pandas_udf(_struct(title=_TEXT, text=_TEXT))
def sanitize_html(pages: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([page_text(x) for x in pages], columns=["title", "text"])


#: What opens and closes math, display first, and which of them is display.
MATH = ((r"\$\$", r"\$\$", True), (r"\\\[", r"\\\]", True), (r"\\\(", r"\\\)", False), (r"(?<!\$)\$(?!\$)", r"(?<!\$)\$(?!\$)", False))
_MATH = re.compile("|".join(f"{opens}(?P<m{k}>.+?){closes}" for k, (opens, closes, _) in enumerate(MATH)), re.S)


def math_segments(text: str | None) -> list[dict]:
    """Delimited math (latex, display, start, end) in order of the text; where kinds start at one place the earlier in MATH goes first."""
    found = []
    for m in _MATH.finditer(text or ""):
        kind = int(m.lastgroup[1:])
        found.append({"latex": m[m.lastgroup].strip(), "display": MATH[kind][2], "start": m.start(), "end": m.end()})
    return found


@F.pandas_udf(T.ArrayType(_struct(latex=_TEXT, display=T.BooleanType(), start=_INT, end=_INT)))
def latex_segments(texts: pd.Series) -> pd.Series:
    return texts.map(math_segments, na_action=None)


_ATOM = re.compile(r"([A-Z][a-z]?)(\d*)|(\()|\)(\d*)")
_CHARGE = re.compile(r"(?:\^\{?\d*[+-]+\}?|[+-]+)$")


def formula_counts(formula: str | None) -> tuple[dict[str, int], str | None]:
    """Element counts of a formula and what is wrong with it (first: parentheses, then the first piece that is no element).

    One pass from the right: a closing parenthesis opens a group whose factor multiplies the factors around it, so each
    element is counted once, with the product of all groups that it stands in.
    """
    text = (formula or "").strip()
    if text.startswith("\\ce{") and text.endswith("}"):
        text = text[4:-1]
    text = _CHARGE.sub("", text)
    pieces, at, stray = [], 0, None
    while at < len(text) and stray is None:
        if m := _ATOM.match(text, at):
            pieces.append(m)
            at = m.end()
        else:
            stray = at
    depth = 0
    for c in text:
        depth += (c == "(") - (c == ")")
        if depth < 0:
            break
    if depth:
        return {}, "unbalanced_parentheses"
    factors, elements = [1], []
    for m in reversed(pieces):
        if m[1]:
            elements.append((m[1], factors[-1] * int(m[2] or 1)))
        elif m[3]:
            if len(factors) > 1:
                factors.pop()
        else:
            factors.append(factors[-1] * int(m[4] or 1))
    counts: dict[str, int] = {}
    for name, n in reversed(elements):
        if name not in ELEMENTS:
            return counts, "unknown_element"
        counts[name] = counts.get(name, 0) + n
    return counts, "unrecognized_token" if stray is not None else None


@F.pandas_udf(_struct(counts=T.MapType(_TEXT, _INT), error=_TEXT))
def parse_formula(formulas: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([formula_counts(x) for x in formulas], columns=["counts", "error"])


def equation_balance(df: DataFrame, key: str, equation: str) -> DataFrame:
    """(key, element, surplus): elements whose atoms differ between the sides; balanced equations give no rows.

    Terms are exploded and their element counts summed with a sign, so only the parse of a term is a helper.
    """
    sides = F.split(F.regexp_replace(F.col(equation), r"<->|->|\\rightarrow|\\rightleftharpoons|=", "\u0001"), "\u0001")
    side = df.select(key, F.posexplode(sides).alias("side", "s")).where("side < 2")
    term = side.select(key, "side", F.explode(F.split("s", r"\+")).alias("t")).select(key, "side", F.trim("t").alias("t")).where("t <> ''")
    coefficient = F.coalesce(F.regexp_extract("t", r"^(\d+)", 1).try_cast("int"), F.lit(1))
    parsed = term.select(key, F.when(F.col("side") == 0, coefficient).otherwise(-coefficient).alias("k"), parse_formula(F.regexp_replace("t", r"^\d+\s*", "")).alias("p"))
    atoms = parsed.select(key, "k", F.explode("p.counts").alias("element", "n"))
    return atoms.groupBy(key, "element").agg(F.sum(F.col("k") * F.col("n")).alias("surplus")).where("surplus <> 0")


def rle_text(counts: list[int]) -> str:
    """The compressed text form of run lengths: differences to the run two before, in groups of five bits."""
    out = []
    for i, c in enumerate(counts):
        x = c - counts[i - 2] if i > 2 else c
        while True:
            bits, x = x & 31, x >> 5
            more = not (x == 0 and not bits & 16 or x == -1 and bits & 16)
            out.append(chr((bits | 32 if more else bits) + 48))
            if not more:
                break
    return "".join(out)


def rle_counts(text: str) -> list[int]:
    """The run lengths of the text form."""
    out, x, shift = [], 0, 0
    for ch in text:
        v = ord(ch) - 48
        x |= (v & 31) << shift
        shift += 5
        if not v & 32:
            if v & 16:
                x -= 1 << shift
            out.append(x + (out[-2] if len(out) > 2 else 0))
            x, shift = 0, 0
    return out


@F.pandas_udf(_TEXT)
def rle_encode(counts: pd.Series) -> pd.Series:
    return counts.map(lambda c: None if c is None else rle_text([int(x) for x in c]))


@F.pandas_udf(T.ArrayType(_LONG))
def rle_decode(texts: pd.Series) -> pd.Series:
    return texts.map(rle_counts)


def wilcoxon_exact(w: float, n: int) -> float:
    """Two-sided exact p of a signed-rank sum w of n untied differences."""
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1
    for r in range(1, n + 1):
        ways[r:] = ways[r:] + ways[:-r]
    return float(min(1.0, 2 * ways[: math.floor(w) + 1].sum() / 2.0**n))


def wilcoxon_normal(w: float, n: int, ties: float) -> float:
    """Two-sided p by the normal approximation; ties: the sum of t^3 - t over groups of t equal sizes."""
    spread = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    return math.erfc(abs(w - n * (n + 1) / 4) / spread / math.sqrt(2)) if spread else 1.0


@F.pandas_udf(_DOUBLE)
def wilcoxon_p(w: pd.Series, pairs: pd.Series, used: pd.Series, ties: pd.Series) -> pd.Series:
    """Exact p for up to 50 untied differences without zeros, else the normal approximation; null below six pairs or where all are equal."""

    def one(w, n, used, ties):
        if n < 6 or not used:
            return None
        return wilcoxon_exact(w, used) if used <= 50 and not ties and used == n else wilcoxon_normal(w, used, ties)

    return pd.Series([one(*x) for x in zip(w, pairs, used, ties, strict=True)], dtype=float)
