"""Words, stems, previews and excerpts."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as Unicode has it, for Java's regular expressions.
SPACES = r"[\s\u0085   -     　]+"
PREFIX_CHARS = 514
#: Longest token that is stemmed, in UTF-8 bytes.
STEM_MAX = 64


# --- words -------------------------------------------------------------------------------------------------


@lru_cache(maxsize=65536)
def _fold_char(c: str) -> str:
    """Lower case, and Latin letters without their diacritics; '' for what separates words."""
    kind = unicodedata.category(c)
    if kind == "Mn":
        return "\u0000"
    if kind[0] not in "LN" and kind != "Co":
        return ""
    low = c.lower()
    base = unicodedata.normalize("NFD", low)
    if len(base) > 1 and base[0].isascii() and all(unicodedata.category(x) == "Mn" for x in base[1:]):
        return base[0]
    return low if len(low) == 1 else low[0]


def tokenize(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, word) of every word: runs of letters and digits, folded, not stemmed."""
    out: list[tuple[int, int, str]] = []
    start, word = -1, []
    for i, c in enumerate(text or ""):
        f = (c.lower() if c.isalnum() else "") if c < "\x80" else _fold_char(c)
        if f == "\u0000":
            continue  # a combining mark belongs to the word it stands in
        if f:
            if start < 0:
                start = i
            word.append(f)
        elif start >= 0:
            out.append((start, i, "".join(word)))
            start, word = -1, []
    if start >= 0:
        out.append((start, len(text), "".join(word)))
    return out


# --- Porter's stemmer (M. F. Porter, "An algorithm for suffix stripping", 1980) ------------------------------

# The suffix rules of steps 2, 3 and 4 in the paper, with the author's later corrections (bli, logi).
STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"))
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(w: str) -> str:
    """v or c for each letter; y after a consonant is a vowel."""
    out = ""
    for i, c in enumerate(w):
        out += "v" if c in "aeiou" or (c == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(w: str) -> int:
    return _shape(w).count("vc")


def _cvc(w: str) -> bool:
    return len(w) >= 3 and _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


def _longest(w: str, rules) -> tuple[str, str] | None:
    hits = [r for r in rules if w.endswith(r[0])]
    return max(hits, key=lambda r: len(r[0])) if hits else None


@lru_cache(maxsize=200_000)
def stem(w: str) -> str:
    """Porter's stem of a folded word; words of under three or over STEM_MAX bytes stay as they are."""
    size = len(w.encode())
    if size < 3 or size > STEM_MAX:
        return w
    # 1a: plurals
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    # 1b: past and present participles
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        cut = next((s for s in ("ed", "ing") if w.endswith(s) and "v" in _shape(w[: -len(s)])), None)
        if cut:
            w = w[: -len(cut)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _cvc(w):
                w += "e"
    # 1c: y to i
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for rules in (STEP2, STEP3):
        rule = _longest(w, rules)
        if rule and _measure(w[: -len(rule[0])]) > 0:
            w = w[: -len(rule[0])] + rule[1]
    rule = _longest(w, [(s, "") for s in STEP4])
    if rule:
        rest = w[: -len(rule[0])]
        if _measure(rest) > 1 and (rule[0] != "ion" or rest.endswith(("s", "t"))):
            w = rest
    # 5: a last e, and ll
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def stems(text: str | None) -> list[str]:
    return [stem(w) for _, _, w in tokenize(text)]


@F.pandas_udf(T.ArrayType(T.StringType()))
def stem_tokens(texts: pd.Series) -> pd.Series:
    """Stemmed words of each text; made once, when a snapshot is written, never in a query."""
    return texts.map(stems)


def plain_tokens(col: Column | str) -> Column:
    """Words without stemming, inside the JVM: runs of letters and digits in lower case."""
    c = F.col(col) if isinstance(col, str) else col
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


# --- previews ----------------------------------------------------------------------------------------------


def collapse(col: Column | str) -> Column:
    """White space collapsed to single blanks, none at the ends."""
    c = F.col(col) if isinstance(col, str) else col
    return F.trim(F.regexp_replace(c, SPACES, " "))


def prefix(col: Column | str, chars: int = PREFIX_CHARS) -> Column:
    """The stored prefix of a body: collapsed, then cut."""
    return F.substring(collapse(col), 1, chars)


def preview(col: Column | str, length: int) -> Column:
    """One line of at most length characters, with … after them if something was cut."""
    flat = collapse(col)
    return F.when(F.length(flat) <= length, flat).otherwise(F.concat(F.substring(flat, 1, length), F.lit("…")))


def preview_text(text: str, length: int) -> str:
    flat = " ".join(text.split())
    return flat if len(flat) <= length else flat[:length] + "…"


def clip(text: str, limit: int) -> str:
    return text[:limit]


#: Characters of an excerpt that may stand before its first hit: so many, and no more than a quarter of it.
LEAD = 16


def excerpt(text: str, hits: list[tuple], length: int) -> str:
    """At most length characters of the flattened text, where it shows the most different terms, the earliest of equal places.

    hits: (start, end) or (start, end, term), in order. Whole words stand around the hits; … marks cut ends where there is room.
    """
    if not hits or length <= 0:
        return ""
    words = [m.span() for m in re.finditer(r"\S+", text)]
    flat = " ".join(text[a:b] for a, b in words)
    if len(flat) <= length:
        return flat
    starts = [0, *accumulate(b - a + 1 for a, b in words)]
    begins = [a for a, _ in words]

    def place(i: int) -> int:
        k = max(0, bisect_right(begins, i) - 1)
        return starts[k] + min(i, words[k][1]) - begins[k]

    marks = length > 6
    room = length - 3 if marks else length
    spans = [(place(h[0]), place(h[1]), h[2] if len(h) > 2 else 0) for h in hits]
    shown: tuple[int, int, int] = (0, 0, 0)  # different terms, minus the first hit, the last hit
    for i, (first, _, _) in enumerate(spans):
        inside = [k for k in range(i, min(len(spans), i + room)) if spans[k][1] - first <= room] or [i]
        shown = max(shown, (len({spans[k][2] for k in inside}), -i, inside[-1]), key=lambda x: x[:2])
    start, end = spans[-shown[1]][0], min(spans[shown[2]][1], spans[-shown[1]][0] + room)
    begin = min((w for w in starts[: len(words)] if 0 <= start - w <= min(LEAD, length // 4) and end - w <= room), default=start)
    most = begin + (length - 1 if marks and not begin else room)
    stop = max((w + b - a for w, (a, b) in zip(starts, words) if end <= w + b - a <= most), default=min(len(flat), most))
    out = flat[begin:stop].strip()
    return ("… " if begin and marks else "") + out + ("…" if stop < len(flat) and marks else "")


def sanitize(text: str, keep_layout: bool = False) -> str:
    """Control and format characters made visible; line ends and tabs may stay."""
    out = []
    for c in text:
        if keep_layout and c in "\n\t":
            out.append(c)
        elif c in "\n\r\t":
            out.append({"\n": "\\n", "\r": "\\r", "\t": "\\t"}[c])
        elif unicodedata.category(c) in ("Cc", "Cf", "Zl", "Zp", "Cs"):
            out.append(f"\\u{ord(c):04x}" if ord(c) < 0x10000 else f"\\U{ord(c):08x}")
        else:
            out.append(c)
    return "".join(out)


def iso_seconds(col: Column | str) -> Column:
    """UTC time to the second from epoch milliseconds; '' for 0 or null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(F.coalesce(c, F.lit(0)) == 0, "").otherwise(F.date_format(F.timestamp_millis(c), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
