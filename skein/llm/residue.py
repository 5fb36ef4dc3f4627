"""Template residue and error-page text: TF-IDF containment of passage windows in labelled exemplars.

1. Labelled exemplars (kind, text) are an input table; EXEMPLARS is the one that comes with the package, of real
   wordings in several languages. They go into an inverted index from word to exemplar; every plain word has a
   posting, however frequent. Placeholders of all usual styles are one word, numbers another, paths and hosts a third.
2. Document frequencies of the exemplars' words are counted exactly over the whole corpus. A word that no exemplar
   holds can't be contained, whatever its frequency; it weighs as one that UNKNOWN of the documents hold.
3. A document is cut into passages (lines, and sentences of long lines). A passage's containment is the share of its
   TF-IDF weight that its NEAREST exemplars of one kind hold together, so that new combinations of known wordings are
   found. Where a line is a short label, a colon and something, the label may also count as a word of its own kind.
4. Passages contained in menu exemplars, navigation lines and stack traces are set aside. A document's coverage is the
   share of its remaining words that lie in residue passages; documents of high coverage are excluded.

Documents are scored from their whole text. Defined results: null, empty and blank texts are no residue (there
is no passage that could be covered); repeated rows are each judged; without exemplars nothing is residue; other
columns are kept untouched.
"""

from __future__ import annotations

import math
import os
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The labelled exemplars that come with the package: kind, tab, text.
EXEMPLARS = os.path.join(os.path.dirname(__file__), "residue_exemplars.tsv")
#: An exemplar table may have so many rows, as its index is broadcast; more are an error.
MAX_EXEMPLARS = 100_000
#: Exemplars of one kind that a passage is compared with together; of short passages one for every two words.
NEAREST = 4
#: The nearest of them must hold so much by itself.
ALONE = 0.35
#: A passage is residue from this containment on, a document from this coverage on.
CONTAINMENT, COVERAGE = 0.6, 0.3
#: Weight of placeholders, numbers, paths and labels.
MARK_WEIGHT = 1.0
#: Share of documents that a word outside the exemplars is taken to be in; and the least share that still adds weight.
UNKNOWN, RAREST = 0.03, 0.001

#: Placeholders in the usual styles: marks around one name or a few words, or a blank to write on.
_NAME = r"[A-Za-z]+(?:_[A-Za-z]+)*"
_OPEN = r"(?:\{\{|\$\{|#\{|<%=?|\[\[|«|@@|__|%|\[|<|\{)\s?"
_CLOSE = r"\s?(?:\}\}|\}|%>|\]\]|»|@@|__|%|\]|>)"
_PLACEHOLDER = re.compile(rf"{_OPEN}(?:(?:insert|your|enter|INSERT|YOUR|Insert|Your|Enter) )?{_NAME}(?: here| HERE)?{_CLOSE}|\[[A-Z][A-Za-z]*(?: [A-Za-z]+){{1,4}}\](?!\()|<(?:your|insert|enter|Your|Insert|Enter)(?: [A-Za-z]+){{1,4}}>|_{{4,}}")
#: A field left open with dots.
_DOTS = re.compile(r"(?<=:) ?(?:\.\.\.|…)\s*$")
_LABEL = re.compile(r"^\s*(?:[-*•>#]+\s*|\d+[.)]\s*)?[^\W\d_][\w '’/-]{0,39}:(?=\s)")
_PATH = re.compile(r"(?:[\w.-]+)?(?:/[\w.-]+)+|\b[\w-]+(?:\.[\w-]+)*\.[a-z]{2,8}\b|\b[a-z_]+\.[a-z_]+\b|\b(?=[a-f]*\d)[0-9a-f]{6,}\b")
#: Without one of these a line holds no path, file, host or hash.
_PATHLIKE = re.compile(r"/|\.[a-z_]|[0-9a-f]{6}")
_HAN = "\u3400-\u9fff"
_PLAIN = rf"[{_HAN}]|[^\W\d_{_HAN}]+(?:['’-][^\W\d_{_HAN}]+)*"
_WORD = re.compile(rf"⟦p⟧|⟦path⟧|⟦field⟧|{_PLAIN}|\d+")
#: The same for texts of ASCII alone, which is quicker.
_ASCII_WORD = re.compile(r"[a-z]+(?:['-][a-z]+)*|\d+")
#: The plain words again, as Java's regular expressions have them.
_JAVA_WORD = r"[\x{3400}-\x{9fff}]|[\p{L}&&[^\x{3400}-\x{9fff}]]+(?:['’-][\p{L}&&[^\x{3400}-\x{9fff}]]+)*"
_MENU = re.compile(r"^\s*(?:©|\(c\)|copyright\b)|^\s*(?:[-*•]\s*)?[^|/.:\n]{1,25}(?:\s+[|/]\s+[^|/.:\n]{1,25})+\s*$", re.I)
#: A line of a stack trace: it says nothing about where the text comes from and is set aside.
_TRACE = re.compile(r"^\s*at \S+ \(\S+:\d+\)\s*$")
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s+|(?<=[。！？])")


def marked(text: str) -> str:
    """The text with placeholders as ⟦p⟧ and paths, files, hosts and hashes as ⟦path⟧."""
    text = text.rstrip()
    if text.endswith(("...", "…")):
        text = _DOTS.sub(" ⟦p⟧", text)
    if opened(text):
        text = _PLACEHOLDER.sub(" ⟦p⟧ ", text)
    return _PATH.sub("⟦path⟧", text) if _PATHLIKE.search(text) else text


def opened(line: str) -> bool:
    """Whether a line holds what no placeholder is without; told by plain lookups, as every line is asked."""
    return "{" in line or "[" in line or "<" in line or "%" in line or "__" in line or "«" in line or "@@" in line or "..." in line or "…" in line


def unfilled(line: str) -> bool:
    """Whether a line holds a placeholder."""
    return opened(line) and bool(_PLACEHOLDER.search(line) or _DOTS.search(line))


def changes(line: str) -> bool:
    """Whether placeholders, paths or a label may turn words of a line into others."""
    return "/" in line or ":" in line or opened(line) or bool(_PATHLIKE.search(line))


def words_of(text: str) -> list[str]:
    """The words of a text, in lower case."""
    low = text.lower()
    return (_ASCII_WORD if low.isascii() else _WORD).findall(low)


def tokens(text: str) -> list[str]:
    return ["0" if t[0].isdigit() else t for t in words_of(text)]


def read_exemplars(path: str = EXEMPLARS) -> list[tuple[str, str]]:
    """(kind, text) of a labelled file."""
    with open(path, encoding="utf-8") as f:
        return [tuple(line.rstrip("\n").split("\t", 1)) for line in f if "\t" in line]


def passages(text: str) -> list[str]:
    """Lines, and the sentences of lines that hold several."""
    return [x for line in text.splitlines() for x in _SENTENCE.split(line) if x.strip()]


def weights(counts: dict[str, int], n: int) -> tuple[dict[str, float], float]:
    """(weight by word of the exemplars, weight of any other word) from their document frequencies in n documents."""
    weigh = lambda df: math.log((n + 1) / (max(df, RAREST * n) + 1)) + 0.1
    return {w: weigh(df) for w, df in counts.items()}, weigh(UNKNOWN * n)


class Index:
    """Exemplars by kind and word. Every plain word and the placeholder retrieve; numbers, paths and labels only count once an exemplar is retrieved."""

    def __init__(self, exemplars: Iterable[tuple[str, str]], weight: dict[str, float] | None = None, unknown: float = 1.0):
        self.words: list[frozenset[str]] = []
        self.post: dict[str, dict[str, list[int]]] = {}
        for kind, text in exemplars:
            # a label of its own kind is written ⟦field⟧ in the exemplars
            held = frozenset(tokens(" ".join(marked(p) for p in passages(text))))
            post = self.post.setdefault(kind, {})
            for w in held:
                post.setdefault(w, []).append(len(self.words))
            self.words.append(held)
        self.all = frozenset().union(*self.words)
        self.keys = frozenset(w for w in self.all if w[0] not in "0⟦")
        self.retrieving = self.keys | ({"⟦p⟧"} & self.all)
        self.weight, self.unknown = dict(weight or {}), unknown
        self.weight |= {w: MARK_WEIGHT for w in ("0", "⟦p⟧", "⟦path⟧", "⟦field⟧")}
        self.held = {w: self.weight.get(w, unknown) for w in self.all}

    def hopeless(self, words: list[str]) -> bool:
        """Whether the words outside all exemplars weigh too much for any containment that counts; quick, and an exact bound."""
        get = self.held.get
        # numbers sort before letters
        inside = sum([get(w, 0.0) for w in words]) + MARK_WEIGHT * len([w for w in words if w < ":"])
        outside = self.unknown * len([w for w in set(words) - self.all if w > ":"])
        return inside < CONTAINMENT * (inside + outside) * (1 - 1e-9)

    def best(self, words: list[str]) -> tuple[float, str]:
        """(containment, kind) of the nearest exemplars of one kind that hold most of the words' weight together; 0 where none can reach CONTAINMENT."""
        if self.retrieving.isdisjoint(words):
            return 0.0, ""
        get, unknown = self.weight.get, self.unknown
        held = {w: get(w, unknown) for w in words}
        if len(held) < len(words):
            held = {w: get(w, unknown) * (1 + math.log(n)) for w, n in Counter(words).items()}
        total = sum(held.values())
        enough = CONTAINMENT * total * (1 - 1e-9)
        # no exemplars hold more than what all of them hold together
        if total - sum([held[w] for w in held.keys() - self.all]) < enough:
            return 0.0, ""
        top = (0.0, "")
        for kind, post in self.post.items():
            open_ = {w: x for w, x in held.items() if w in post}
            if sum(open_.values()) >= enough and not self.retrieving.isdisjoint(open_):
                top = max(top, (self._together(post, open_, ALONE / CONTAINMENT * enough, max(1, min(NEAREST, len(held) // 2))), kind))
        return top[0] / total, top[1]

    def _together(self, post: dict[str, list[int]], open_: dict[str, float], alone: float, nearest: int) -> float:
        """The weight that so many exemplars hold together: the one that holds most, then each time the one that adds most.
        0 where the first holds less than alone."""
        covered = 0.0
        retrieved = {i for w in open_ if w in self.retrieving for i in post[w]}
        for _ in range(nearest):
            gains: dict[int, float] = {}
            for w, x in open_.items():
                for i in post[w]:
                    if i in retrieved:
                        gains[i] = gains.get(i, 0.0) + x
            if not gains:
                break
            gain, i = max((g, -i) for i, g in gains.items())
            if gain < alone:
                return 0.0
            alone = 0.0
            covered += gain
            open_ = {w: x for w, x in open_.items() if w not in self.words[-i]}
        return covered


def _contained(passage: str, index: Index, raw: list[str]) -> tuple[float, str]:
    """best() of a passage as it is or, where that isn't enough, with its label as a word of its own kind."""
    if not changes(passage) and index.hopeless(raw):
        return 0.0, ""
    m = marked(passage)
    ts = ["0" if t[0].isdigit() else t for t in raw] if m == passage.rstrip() else tokens(m)
    c, kind = index.best(ts)
    if c < CONTAINMENT and ":" in m and (rest := _LABEL.sub("⟦field⟧ ", m, count=1)) != m:
        return max((c, kind), index.best(tokens(rest)))
    return c, kind


def coverage(text: str, index: Index, least: float = COVERAGE) -> tuple[float, str]:
    """(share of the words outside menus and traces that lie in residue passages, the kind most of them are of).

    0 where less than `least` can be reached: only lines that retrieve an exemplar at all can be covered or turn out to be menus.
    """
    words, parts = 0, []
    for line in text.splitlines():
        if ("|" in line or "/" in line or "©" in line or "opyright" in line) and _MENU.search(line) or "at " in line and _TRACE.match(line):
            continue
        for p in _SENTENCE.split(line) if "." in line or "!" in line or "?" in line or not line.isascii() else (line,):
            found = words_of(p)
            open_field = unfilled(p)
            size = len(found) or (1 if open_field else 0)  # a placeholder without letters or digits is one word
            words += size
            if open_field or not index.keys.isdisjoint(found):
                parts.append((size, p, found))
    # what can still be covered; less than `least` of all words stays less when menus leave the count
    open_, enough = sum(x[0] for x in parts), least * words
    if not parts or open_ < enough:
        return 0.0, ""
    covered = 0
    kinds: dict[str, int] = {}
    for size, p, found in sorted(parts, key=lambda x: -x[0]):  # the longest first, as they decide soonest
        c, kind = _contained(p, index, found)
        if c >= CONTAINMENT and kind == "menu":
            words -= size
        elif c >= CONTAINMENT:
            covered += size
            kinds[kind] = kinds.get(kind, 0) + size
        else:
            open_ -= size
            if open_ < enough:
                return 0.0, ""
    return (covered / words, max(kinds, key=lambda k: (kinds[k], k))) if kinds and words else (0.0, "")


def document_frequencies(documents: DataFrame, vocabulary: Iterable[str]) -> dict[str, int]:
    """Exact document frequencies of the given words over all documents; at most a row a word reaches the driver."""
    words = sorted(vocabulary)
    if not words:
        return {}
    held = F.array_intersect(F.regexp_extract_all(F.lower("text"), F.lit(_JAVA_WORD), F.lit(0)), F.array(*map(F.lit, words)))
    counted = documents.where(F.col("text") != "").select(F.explode(held).alias("word")).groupBy("word").count()
    return dict.fromkeys(words, 0) | {r["word"]: r["count"] for r in counted.collect()}


def residue(documents: DataFrame, exemplars: DataFrame | None = None, least: float = COVERAGE) -> DataFrame:
    """(doc_id, coverage, kind): the documents of high coverage. documents: doc_id, text. exemplars: kind, text."""
    labelled = read_exemplars() if exemplars is None else [(r.kind, r.text) for r in exemplars.select("kind", "text").where(F.col("kind").isNotNull() & F.col("text").isNotNull()).limit(MAX_EXEMPLARS + 1).collect()]
    if len(labelled) > MAX_EXEMPLARS:
        raise ValueError(f"more than {MAX_EXEMPLARS} exemplars")
    weight, unknown = weights(document_frequencies(documents, Index(labelled).keys), documents.count())
    shared = documents.sparkSession.sparkContext.broadcast((labelled, weight, unknown))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(*shared.value)
        for b in batches:
            rows = [(d.as_py(), *coverage(t.as_py(), index, least)) for d, t in zip(b.column(0), b.column(1)) if t.as_py()]
            rows = [r for r in rows if r[1] >= least]
            if rows:
                ids, cov, kind = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(cov, pa.float64()), pa.array(kind, pa.string())], ["doc_id", "coverage", "kind"])

    return documents.select("doc_id", "text").mapInArrow(score, "doc_id bigint, coverage double, kind string")
