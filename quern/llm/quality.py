"""Text statistics per document, and from them prose against lists, tables, forms and junk.

Statistics come from one pass over whole texts. Gradient-boosted trees are
trained on them with weak labels from two families of labelling functions: votes() on the statistics, of which two make
a text junk, and structure(), which looks at sentences, line shapes, digits and repetition in the text itself. Where the first
calls a text junk, or the second does by more votes than it calls it prose, it is labelled junk. Probabilities are
calibrated on HAND_CHECKED, which was judged from the texts alone. Documents of a calibrated probability of at least CANDIDATE are
candidates, which are then checked exactly.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.holdout import HAND_CHECKED
from quern.llm.trees import Boosted, platt
from quern.llm.words import ALNUM, END, SPACE, STRIP, bounds, char_classes, hashes, points, portions

#: Documents at most, drawn by a hash of doc_id, on which the trees are trained.
TRAINED_ON = 20_000
#: Calibrated probability from which a document is a candidate.
CANDIDATE = 0.04

STATS = ["n_words", "mean_word_length", "symbol_share", "n_lines", "line_end_share", "common_share"]


def text_statistics(texts: list[str], common: np.ndarray) -> np.ndarray:
    """(n, 6) of STATS; a share or mean without anything to divide by is NaN. ``common`` holds the sorted hashes of the common words."""
    n = len(texts)
    lower = [t.lower() for t in texts]
    low, low_starts = points(lower)
    begin, end = bounds((char_classes()[low] & ALNUM).astype(bool))
    h = hashes(low, begin, end)
    at = np.searchsorted(common, h)
    is_common = common[np.minimum(at, len(common) - 1)] == h if len(common) else np.zeros(len(h), bool)

    def per_text(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return total[edges[1:]] - total[edges[:-1]]

    first = np.searchsorted(begin, low_starts)
    words = np.diff(first)
    letters, commons = per_text(end - begin, first), per_text(is_common, first)
    cp, starts = (low, low_starts) if lower == texts else points(texts)
    flags = char_classes()[cp]
    symbols = per_text((flags & (ALNUM | SPACE)) == 0, starts)
    chars = np.diff(starts) - 1
    # lines: the line feed after each text ends its last line
    feeds = np.flatnonzero(cp == 10)
    solid = np.flatnonzero(((flags & STRIP) == 0) & (cp != 10))
    k = np.searchsorted(solid, feeds) - 1
    last = np.where(k >= 0, solid[np.maximum(k, 0)], -1) if len(solid) else np.full(len(feeds), -1)
    opens = np.concatenate([[0], feeds[:-1] + 1])
    full = last >= opens
    ends = full & ((flags[np.maximum(last, 0)] & END) > 0)
    line_at = np.searchsorted(feeds, starts)
    lines, ended = per_text(full, line_at), per_text(ends, line_at)

    def share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(b > 0, a / np.maximum(b, 1), np.nan)

    assert len(words) == n
    return np.stack([words, share(letters, words), share(symbols, chars), lines, share(ended, lines), share(commons, words)], axis=1).astype(np.float64)


def votes(s: np.ndarray) -> np.ndarray:
    """How many labelling functions call a text structural junk; none does where there is no word."""
    with np.errstate(invalid="ignore"):
        v = (s[:, 5] < 0.2).astype(int) + (s[:, 4] < 0.3) + (s[:, 2] > 0.1) + ((s[:, 1] < 3.6) | (s[:, 1] > 7.5)) + (s[:, 0] < 30)
    return np.where(s[:, 0] > 0, v, 0)


_SENTENCE = re.compile(r"[^\W\d_]{3,}[.!?][\"”)]?\s+[^\W_a-z]")
_SHAPES = ((re.compile(r"\d+"), "9"), (re.compile(r"[^\W\d_]+"), "a"), (re.compile(r"\s+"), " "))


def structure(text: str) -> int:
    """Labelling functions on the text's structure: votes for junk less votes for prose."""
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    words = text.split()
    if not words:
        return 0
    shapes = Counter()
    for line in lines:
        begin = line[:24]
        for pattern, to in _SHAPES:
            begin = pattern.sub(to, begin)
        shapes[begin[:6]] += 1
    solid = sum(map(len, words))
    sentences = len(_SENTENCE.findall(text))
    junk = [
        len(lines) >= 5 and shapes.most_common(1)[0][1] > 0.5 * len(lines),  # lines of one shape
        sum(c.isdigit() for c in text) > 0.12 * solid,
        len(words) >= 20 and len(set(words)) < 0.3 * len(words) and sentences < len(words) / 60,  # repetition without sentences
        sum(text.count(c) for c in "|‖…\t[]•") > 0.04 * solid,
        sentences == 0,
    ]
    prose = [sentences >= 3, len(words) >= 60 and sentences >= len(words) / 60, len(words) >= 9 * len(lines)]
    return sum(junk) - sum(prose)


def _common_hashes(words: DataFrame) -> np.ndarray:
    """Sorted hashes of the common words: a fixed short list."""
    listed = [w for (w,) in words.filter("word is not null").select("word").distinct().toLocalIterator()]
    cp, starts = points([w.lower() for w in listed])
    return np.unique(hashes(cp, starts[:-1], starts[1:] - 1))


def document_statistics(docs: DataFrame, common_words: DataFrame) -> DataFrame:
    """(doc_id, STATS): one row per document; counts are bigint. A null text counts as an empty one, whose shares and mean are null."""
    common = _common_hashes(common_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in portions(b.column(1).to_pylist()):
                s = text_statistics(texts, common)
                columns = [pa.array(s[:, j].astype(np.int64)) if STATS[j].startswith("n_") else pa.array(s[:, j], mask=np.isnan(s[:, j])) for j in range(len(STATS))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), *columns], names=["doc_id", *STATS])

    kinds = ", ".join(f"{c} {'bigint' if c.startswith('n_') else 'double'}" for c in STATS)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id bigint, {kinds}")


class Model:
    """The trees and their calibration."""

    def __init__(self, sample: np.ndarray, labels: np.ndarray):
        self.trees = Boosted().fit(sample, labels.astype(float)) if len(sample) else None
        self.a, self.b = 1.0, 0.0
        if self.trees is not None and HAND_CHECKED:
            self.a, self.b = platt(self.trees.score(held_statistics()), held_judgements())

    def probability(self, s: np.ndarray) -> np.ndarray:
        """Calibrated probability of structural junk; 0 where there is no word."""
        if self.trees is None:
            return np.zeros(len(s))
        p = 1 / (1 + np.exp(-np.clip(self.a * self.trees.score(s) + self.b, -40, 40)))
        return np.where(s[:, 0] > 0, p, 0.0)


def held_statistics() -> np.ndarray:
    return np.array([s for _, _, s, _ in HAND_CHECKED], np.float64)


def held_judgements() -> np.ndarray:
    return np.array([y for *_, y in HAND_CHECKED], np.float64)


def weakly_labelled(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """(STATS, junk): statistics and weak label of every document with a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, texts in portions(b.column(0).to_pylist()):
                s = text_statistics(texts, common)
                junk = (votes(s) >= 2) | (np.fromiter(map(structure, texts), np.int64, len(texts)) > 0)
                some = s[:, 0] > 0
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in s[some].T.copy()), pa.array(junk[some])], names=[*STATS, "junk"])

    return docs.select("text").mapInArrow(run, ", ".join(f"{c} double" for c in STATS) + ", junk boolean")


def trained_model(docs: DataFrame, common_words: DataFrame, rows: int = TRAINED_ON) -> Model:
    """Trains on about ``rows`` documents, chosen by a hash of doc_id, and never more than twice as many, even if ids repeat."""
    n = docs.count()
    parts = max(1, -(-n // rows))
    sample = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) == 0)
    # the limit is on rows of seven numbers, behind the statistics, so that these stay parallel
    got = weakly_labelled(sample, _common_hashes(common_words)).limit(2 * rows).toPandas()
    return Model(got[STATS].to_numpy(np.float64), got["junk"].to_numpy(bool))


def scored_documents(docs: DataFrame, common_words: DataFrame) -> DataFrame:
    """(doc_id, p_junk, n_votes): calibrated probability, rounded to 4 digits, and the votes, for every document."""
    common, model = _common_hashes(common_words), trained_model(docs, common_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in portions(b.column(1).to_pylist()):
                s = text_statistics(texts, common)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), pa.array(np.round(model.probability(s), 4)), pa.array(votes(s).astype(np.int32)), pa.array(model.probability(s) >= CANDIDATE)], names=["doc_id", "p_junk", "n_votes", "candidate"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, p_junk double, n_votes int, candidate boolean")


def junk_documents(docs: DataFrame, common_words: DataFrame) -> DataFrame:
    """(doc_id): candidates of the trees for which at least two labelling functions hold."""
    return scored_documents(docs, common_words).filter("candidate and n_votes >= 2").select("doc_id").distinct()
