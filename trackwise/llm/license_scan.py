"""License detection by ordered signature rules.

A text is lower-cased and cut into words; rules are hand-written expressions over
the words joined by single blanks (``license_rules``), so positions are word
positions. A rule runs only around the places of its keywords: a match has one
of them among its words and a bounded number of words, so the words within that
bound of a keyword hold every match. Rules have priorities; of the detections, one
inside another's interval is dropped if its priority is lower, or equal and it
isn't longer. Base phrases always stay.

Work grows with the length of a text and the logarithm of its detections.

Defined cases: null text is empty; no words give no detections; rows are scanned
row by row, repeated ones and those without a doc_id too; an empty table gives
an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_rules import RULES
from .textkernel import alnum_words

#: phrases whose every place is a detection of its own, and the score of one
BASE_PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
BASE_SCORE = 90

Detection = tuple[int, int, int, str]


def compiled() -> list[tuple[str, int, frozenset[bytes], re.Pattern[str], int]]:
    """(label, priority, keywords, expression, most words of a match)."""
    return [(label, priority, frozenset(w.encode() for w in words), re.compile(f"(?<= )(?:{text})(?= )"), text.count(" ") + 1) for label, priority, words, text in RULES]


def suppress(found: list[Detection]) -> list[Detection]:
    """Of (start, end, priority, label), those not inside the interval of a stronger one, or of one as strong and at least as long.

    The strongest come first; a tree of maxima over the starts tells the furthest end of those kept that start at or before a place.
    """
    starts = sorted({d[0] for d in found})
    ends = [0] * (len(starts) + 1)
    kept = []
    for d in sorted(set(found), key=lambda d: (-d[2], d[0] - d[1], d)):
        at = top = bisect_right(starts, d[0])
        furthest = 0
        while at:
            furthest = max(furthest, ends[at])
            at &= at - 1
        if furthest >= d[1]:
            continue
        kept.append(d)
        while top < len(ends):
            ends[top] = max(ends[top], d[1])
            top += top & -top
    return sorted(kept)


def _around(places: list[int], reach: int, n: int) -> list[tuple[int, int]]:
    """Disjoint word ranges [a, b) with all words less than ``reach`` from one of the ascending places."""
    out: list[tuple[int, int]] = []
    for p in places:
        a, b = max(0, p - reach + 1), min(n, p + reach)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


class _Text:
    """A text's words, the places of keywords, and the joined words around them."""

    def __init__(self, words: list[bytes], places: dict[bytes, list[int]]):
        self.words, self.places = words, places
        self.joined: dict[tuple[frozenset[bytes], int], list[tuple[int, str, list[int]]]] = {}

    def around(self, keywords: frozenset[bytes], reach: int) -> list[tuple[int, str, list[int]]]:
        """(first word, words joined with a blank at both ends, places of the blanks) of each range."""
        key = (keywords, reach)
        if key not in self.joined:
            places = sorted(p for w in keywords for p in self.places.get(w, ()))
            out = []
            for a, b in _around(places, reach, len(self.words)):
                part = [w.decode("utf-8", "surrogatepass") for w in self.words[a:b]]
                blanks, at = [0], 0
                for w in part:
                    at += len(w) + 1
                    blanks.append(at)
                out.append((a, f" {' '.join(part)} ", blanks))
            self.joined[key] = out
        return self.joined[key]


def _base(words: list[bytes], places: dict[bytes, list[int]]) -> list[tuple[int, str]]:
    """(place, label) of the base phrases, whose last words are among the keywords."""
    out = []
    for phrase, label in BASE_PHRASES:
        want = phrase.encode().split()
        for last in places.get(want[-1], ()):
            first = last - len(want) + 1
            if first >= 0 and words[first : last + 1] == want:
                out.append((first, label))
    return sorted(out)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rules = compiled()
    gates = frozenset().union(*(r[2] for r in rules), (p.split()[-1].encode() for p, _ in BASE_PHRASES))
    by_word: dict[bytes, list[int]] = {}
    for i, rule in enumerate(rules):
        for w in rule[2]:
            by_word.setdefault(w, []).append(i)
    for batch in batches:
        out = []
        for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
            words = alnum_words(text)
            present = gates.intersection(words)
            base: list[tuple[int, str]] = []
            found: list[Detection] = []
            if present:
                places: dict[bytes, list[int]] = {}
                for i, w in enumerate(words):
                    if w in present:
                        places.setdefault(w, []).append(i)
                base = _base(words, places)
                cells = _Text(words, places)
                for i in sorted({i for w in present for i in by_word.get(w, ())}):
                    label, priority, keywords, expression, reach = rules[i]
                    for first, joined, blanks in cells.around(keywords, reach):
                        for m in expression.finditer(joined):
                            a = bisect_right(blanks, m.start()) - 1
                            found.append((first + a, first + a + m[0].count(" ") + 1, priority, label))
                found = suppress(found)
            labels = sorted({label for _, label in base})
            every = sorted({*labels, *(d[3] for d in found)})
            score = max([0, *(d[2] for d in found), *[BASE_SCORE] * bool(base)]) / 100
            out.append((doc, len(words), [b[0] for b in base], labels, every, score, [d[0] for d in found], [d[1] for d in found], [d[3] for d in found]))
        cols = list(zip(*out, strict=True)) or [[]] * 9
        ints, names = pa.list_(pa.int64()), pa.list_(pa.string())
        types = [pa.int64(), pa.int64(), ints, names, names, pa.float64(), ints, ints, names]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "n_words", "base_at", "base_labels", "labels", "score", "starts", "ends", "found"])


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, places and labels of base phrases, all labels, score, and the kept detections' word spans.

    score is the priority of the strongest detection as a fraction; 0 without any.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_scan, "doc_id long, n_words long, base_at array<long>, base_labels array<string>, labels array<string>, score double, starts array<long>, ends array<long>, found array<string>")
