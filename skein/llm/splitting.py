"""Splitting oversized texts at natural boundaries by recursive bisection.

A text over the limit is cut at the strongest boundary near its midpoint (paragraph, line, sentence, word; the
nearest one anywhere if none is near, any place if there is none at all), and halves that still exceed the limit less the overlap are cut again. Then each piece
after the first gets the last characters of the piece before it put in front. Lengths are in Unicode code points.

Round trip: joining the pieces, each after the first without its overlap, gives the text again.

Defined results: null and short texts (of at most the limit) give no pieces; texts of any length are handled
whole, without recursion in Python's sense; repeated rows are each split.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 4000
OVERLAP = 200

#: A cut comes after a match; strongest kind first.
BOUNDARIES = (
    re.compile(r"\n[ \t\r]*\n\s*"),
    re.compile(r"\n"),
    re.compile(r"[.!?…]+[\"')\]]*\s+|[。！？]+[」』”]*"),
    re.compile(r"\s+"),
)
#: How far from the midpoint a boundary may lie, as a part of the segment's length, by strength.
REACH = 0.25


def find_cut(text: str, start: int, end: int) -> int:
    """The place to cut text[start:end]: the strongest boundary near the midpoint, the nearest to it among equals; else the nearest of all."""
    middle, reach = (start + end) // 2, max(1, int((end - start) * REACH))
    low, high = max(start + 1, middle - reach), min(end - 1, middle + reach)
    for kind in BOUNDARIES:
        best = 0
        for m in kind.finditer(text, max(start, low - 1), high):
            at = m.end()
            if low <= at <= high and (not best or abs(at - middle) < abs(best - middle)):
                best = at
        if best:
            return best
    # none in reach: the nearest of any strength in the whole segment, so that a run without boundaries stays whole where it can
    wide = [m.end() for kind in BOUNDARIES for m in kind.finditer(text, start, end) if start < m.end() < end]
    return min(wide, key=lambda at: abs(at - middle), default=middle)


def cut_points(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[int]:
    """Starts and end of the pieces without overlaps: 0, ..., len(text)."""
    if limit <= overlap:
        raise ValueError("the overlap must be smaller than the limit")
    n, core = len(text), limit - overlap
    if n <= limit:
        return [0, n]
    cuts, todo = [0], [(0, n)]
    while todo:
        start, end = todo.pop()
        if end - start <= core:
            cuts.append(end)
            continue
        at = find_cut(text, start, end)
        todo.append((at, end))
        todo.append((start, at))
    return cuts


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[str]:
    """The pieces of one text, with overlaps."""
    cuts, pieces = cut_points(text, limit, overlap), []
    for a, b in zip(cuts, cuts[1:]):
        pieces.append((pieces[-1][-overlap:] if pieces and overlap else "") + text[a:b])
    return pieces


def split_items(df: DataFrame, keys: list[str], text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(keys, piece_no, piece, overlap): the pieces of every text over the limit, in order from 0.

    Only texts over the limit leave the JVM. overlap is the number of characters taken from the piece before.
    """
    big = df.select(*keys, F.col(text).alias("__text")).where(F.length("__text") > limit)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in big.schema.fields[:-1])
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):  # a batch a text: one text's pieces at a time in memory
                pieces = split_text(b.column(n)[r].as_py(), limit, overlap)
                own = [pa.array([b.column(i)[r].as_py()] * len(pieces), b.schema.field(i).type) for i in range(n)]
                laps = [0] + [min(overlap, len(p)) for p in pieces[:-1]]
                yield pa.RecordBatch.from_arrays([*own, pa.array(range(len(pieces)), pa.int32()), pa.array(pieces, pa.string()), pa.array(laps, pa.int32())], [*keys, "piece_no", "piece", "overlap"])

    return big.mapInArrow(run, f"{schema}, piece_no int, piece string, overlap int")
