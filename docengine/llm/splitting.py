"""Splitting oversized items at natural boundaries (problem 3): lexical-cohesion segmentation with overlap."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.plans.staging import ship_with_tasks

ship_with_tasks(__name__)

#: Units from coarse to fine.
LEVELS = ("paragraph", "sentence", "word", "none")
BLOCK = 6  # units on either side of a cut whose words are compared

_SPACE = re.compile(r"\s+")
_WORDS = re.compile(r"[^\W\d_]{3,}")


def valleys(text: str, cuts: list[int], block: int = BLOCK) -> list[float]:
    """Depth of the similarity valley at each cut: block units on either side are compared, then the fall from the next peaks is summed."""
    ends = [0, *cuts, len(text)]
    bags = [Counter(_WORDS.findall(text[a:b].lower())) for a, b in zip(ends, ends[1:])]
    scores = []
    left, right = Counter(), Counter()
    for bag in bags[1 : 1 + block]:
        right.update(bag)
    for k in range(1, len(bags)):
        left.update(bags[k - 1])
        if k > block:
            left.subtract(bags[k - 1 - block])
        if k > 1:
            right.subtract(bags[k - 1])
            if k - 1 + block < len(bags):
                right.update(bags[k - 1 + block])
        left, right = +left, +right
        dot = sum(n * right[w] for w, n in left.items() if w in right)
        size = (sum(n * n for n in left.values()) * sum(n * n for n in right.values())) ** 0.5
        scores.append(dot / size if size else 0.0)
    peak_left, peak_right = scores[:], scores[:]
    for k in range(1, len(scores)):
        if scores[k - 1] >= scores[k]:
            peak_left[k] = peak_left[k - 1]
    for k in range(len(scores) - 2, -1, -1):
        if scores[k + 1] >= scores[k]:
            peak_right[k] = peak_right[k + 1]
    return [a + b - 2 * s for a, b, s in zip(peak_left, peak_right, scores)]


class Segmentation:
    """The ends of a text's paragraphs and sentences (end of the unit, start of the next) with the depth of the valley at each.

    Depths of sentence ends are computed only if a window without paragraph end asks for them.
    """

    def __init__(self, text: str) -> None:
        self.text = text
        spaces = [m.span() for m in _SPACE.finditer(text)]
        # two line ends in one run of white space have an empty or blank line between them
        paragraphs = [(a, b) for a, b in spaces if text.count("\n", a, b) > 1]
        self.gaps = (paragraphs, [(a, b) for a, b in spaces if text.count("\n", a, b) > 1 or a and text[a - 1] in ".!?"])
        self.ends = tuple([a for a, _ in gaps] for gaps in self.gaps)
        self._depths: list[list[float] | None] = [None, None]

    def depths(self, level: int) -> list[float]:
        if self._depths[level] is None:
            self._depths[level] = valleys(self.text, [b for _, b in self.gaps[level]])
        return self._depths[level]

    def cut(self, low: int, high: int, half: int) -> tuple[int, int]:
        """Place and level of the cut in the window: the deepest valley among its paragraph ends, else sentence ends (those from half on
        first), else the last white space, else its end. A unit that ends in the window is followed up to the next, as far as the window goes."""
        for level in (0, 1):
            first, last = bisect_left(self.ends[level], low), bisect_right(self.ends[level], high)
            if first < last:
                late = bisect_left(self.ends[level], half, first, last)
                first = late if late < last else first
                if last - first > 1:
                    depth = self.depths(level)
                    first = max(range(first, last), key=lambda k: (depth[k], k))
                return min(self.gaps[level][first][1], high), level
        spaces = [m.end() for m in _SPACE.finditer(self.text, low, high)]
        if spaces:
            return spaces[-1], 2
        return high, 2 if self.text[high].isspace() else 3

    def pieces(self, limit: int, overlap: int) -> list[tuple[int, int, int]]:
        """Start, end and level of the cut at the end of each piece; the last piece has level -1. The next piece begins about overlap
        characters before the cut, at a word."""
        out, start, text = [], 0, self.text
        while len(text) - start > limit:
            at, level = self.cut(start + overlap + 1, start + limit, start + limit // 2)
            out.append((start, at, level))
            back = at - overlap
            word = re.search(r"\s\S", text[back : back + overlap // 2 + 2])
            start = back + word.start() + 1 if word else back
        return [*out, (start, len(text), -1)]

    def forced(self, limit: int) -> str:
        """The finest level at which the text has to be cut: that of its cuts without overlap, each at the coarsest end in reach.

        A window holds a paragraph end unless the paragraph that begins it is too long, and likewise for sentences and words.
        """
        finest, start, end = 0, len(self.text) - len(self.text.lstrip()), len(self.text.rstrip())
        while end - start > limit and finest < 3:
            at, level = self.cut(start + 1, start + limit, start + limit // 2)
            finest = max(finest, level)
            gap = _SPACE.match(self.text, at)
            start = gap.end() if gap else at
        return LEVELS[finest]


def cut_text(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Start and end of each piece of text, each at most limit long."""
    return [(a, b) for a, b, _ in Segmentation(text).pieces(limit, overlap)]


def _long_texts(pages: DataFrame, limit: int) -> DataFrame:
    """page_id, text: the latest cleaned_text of each page, where it has more than limit code points."""
    long = pages.select("page_id", "cleaned_text", "extracted_at").filter(F.length("cleaned_text") > limit)
    newest = pages.groupBy("page_id").agg(F.max(F.struct("extracted_at", F.xxhash64("cleaned_text").alias("text_id"))).alias("n"))
    long = long.withColumn("text_id", F.xxhash64("cleaned_text")).join(newest, "page_id").filter("text_id = n.text_id")
    return long.groupBy("page_id").agg(F.max("cleaned_text").alias("text"))


def split_oversized(pages: DataFrame, limit: int = 2000, overlap: int = 200) -> DataFrame:
    """page_id, boundary, piece_no, start, end, cut, text: the pieces of every cleaned_text of more than limit code points.

    boundary is the coarsest of paragraph, sentence and word of which no unit of the text is longer than limit, else none: the finest
    level that the segmentation is forced to without overlap. cut is the level of the cut at the end of the piece, null for the last.
    start and end are offsets in the text; pieces together cover it and each is at most limit long. Null, empty and short texts give
    no pieces; a page_id that comes more than once counts once, by its latest text. overlap must be less than limit / 2.
    """
    if not 0 <= 2 * overlap < limit:
        raise ValueError("overlap must be less than half the limit")

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page, text in zip(batch["page_id"], batch["text"]):
                parts = Segmentation(text)
                kind = parts.forced(limit)
                rows += [(page, kind, n, a, b, LEVELS[level] if level >= 0 else None, text[a:b]) for n, (a, b, level) in enumerate(parts.pieces(limit, overlap), 1)]
            yield pd.DataFrame(rows, columns=["page_id", "boundary", "piece_no", "start", "end", "cut", "text"])

    return _long_texts(pages, limit).mapInPandas(pieces, "page_id bigint, boundary string, piece_no int, start int, end int, cut string, text string")
