"""Evaluation passages inside training texts, by edit-distance embedding and bit sampling.

A window of w words is walked as in the CGK embedding: at step j the word under
the pointer is put out, and a random bit of (j, word) says whether the pointer
moves on. Equal windows give equal walks, and windows at a small edit distance
walks at a small Hamming distance. A repetition hashes a sample of the walk's
coordinates into one key; window pairs with equal keys are candidates. Windows of
passages are the index, windows at every word of every text probe it. Candidates
are verified by exact edit distance on the words.

With no edits allowed one repetition finds everything. With edits, the number of repetitions follows from walks of simulated
windows with that many substitutions, insertions and deletions, so that a window is found with the target recall. A passage that
leaks with more words than a window has more windows to be found by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.words import portions, word_hashes
from quern.runtime import union_all

#: Windows of passages in one block of the index, which is sent to every task; more take another pass.
INDEX_WINDOWS = 200_000
SAMPLED, MOST_REPETITIONS = 10, 200
#: Candidates verified at once.
VERIFIED = 20_000


class Walks:
    """The random bits and the sampled coordinates of all repetitions."""

    def __init__(self, window: int, edits: int, recall: float = 0.95, sampled: int = SAMPLED, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.window, self.edits = window, edits
        # without edits the walk's first w steps suffice; with edits the usual 3w steps are walked, until the window ends
        self.steps = window if edits == 0 else 3 * window
        self.sampled = sampled if edits == 0 else min(sampled, 6)
        most = 1 if edits == 0 else MOST_REPETITIONS
        self.moves = rng.integers(0, 1 << 63, (most, self.steps), dtype=np.int64).view(np.uint64) | np.uint64(1)
        # about half of the steps move on, so later coordinates than 2w tell nothing
        self.coordinates = [np.sort(rng.choice(min(self.steps, 2 * window), self.sampled, replace=False)) for _ in range(most)]
        self.repetitions = 1 if edits == 0 else self._calibrated(recall, rng)

    def _calibrated(self, recall: float, rng: np.random.Generator, trials: int = 600) -> int:
        """Repetitions after which the share ``recall`` of simulated windows is found, the hardest number of edits being allowed."""
        w = self.window
        originals = rng.integers(1, 1 << 63, (trials, w), dtype=np.int64).view(np.uint64)
        edited = np.stack([edited_window(o, self.edits, rng)[:w] for o in np.pad(originals, ((0, 0), (0, self.edits)), mode="wrap")])
        at = np.arange(trials) * w
        missed = np.ones(trials, bool)
        for r in range(len(self.moves)):
            missed &= self.keys(originals.ravel(), at, r) != self.keys(edited.ravel(), at, r)
            if missed.mean() <= (1 - recall) * 0.4:
                return r + 1
        raise ValueError(f"{len(self.moves)} repetitions find only {1 - missed.mean():.3f} of the windows with {self.edits} edits")

    def keys(self, words: np.ndarray, at: np.ndarray, rep: int) -> np.ndarray:
        """Keys of the windows of ``words`` that begin at ``at``; whole windows only."""
        pointer = at.astype(np.int64)
        key = np.zeros(len(at), np.uint64)
        last = at + self.window
        taken = set(self.coordinates[rep].tolist())
        inside = self.steps <= self.window
        for j in range(int(self.coordinates[rep][-1]) + 1):
            w = words[pointer] if inside else np.where(pointer < last, words[np.minimum(pointer, len(words) - 1)], np.uint64(0))
            if j in taken:
                key = (key ^ w) * np.uint64(0x9FB21C651E98DF25)
                key ^= key >> np.uint64(28)
            pointer += ((w * self.moves[rep, j]) >> np.uint64(63)).astype(np.int64)
        return key


def edited_window(words: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    """The words after random substitutions, insertions and deletions."""
    out = words.tolist()
    for _ in range(edits):
        at, kind = int(rng.integers(0, len(out))), int(rng.integers(0, 3))
        out[at : at + (kind != 1)] = [int(rng.integers(1, 1 << 63))] if kind < 2 else []
    return np.array(out + words.tolist(), np.uint64)[: len(words)]


def edit_distances(text: np.ndarray, x: np.ndarray, ends: np.ndarray, passage: np.ndarray, y: np.ndarray, window: int, most: int) -> np.ndarray:
    """For each pair the smallest edit distance between passage[y : y + window] and any run of text words that begins at x and ends before ``ends``, or most + 1 if it is larger."""
    width = 2 * most + 1
    beyond = most + 1
    # d[:, c] is the distance of the first i passage words and the first i + c - most text words
    d = np.where(np.arange(width)[None] >= most, np.arange(width)[None] - most, beyond).repeat(len(x), 0)
    for i in range(1, window + 1):
        word = passage[y + i - 1]
        new = np.full_like(d, beyond)
        for c in range(width):
            j = i + c - most
            if j < 0:
                continue
            at = x + j - 1
            inside = at < ends
            best = d[:, c] + (text[np.minimum(np.maximum(at, 0), len(text) - 1)] != word) if j > 0 else np.full(len(x), beyond)
            if c + 1 < width:
                best = np.minimum(best, d[:, c + 1] + 1)
            if c and j > 0:
                best = np.minimum(best, new[:, c - 1] + 1)
            new[:, c] = np.where(inside | (j == 0), np.minimum(best, beyond), beyond)
        d = new
    return d.min(1)


class Index:
    """Sorted keys of the passages' windows, with a bitmap in front of them."""

    BITS = 22

    def __init__(self, ids: list[int], passages: list[str], walks: Walks):
        words, first = word_hashes(passages)
        self.walks, w = walks, walks.window
        sizes = np.diff(first)
        n = np.maximum(sizes - w + 1, 0)
        owner = np.repeat(np.arange(len(passages)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[:-1][owner]
        self.words, self.ids = words, np.array(ids, np.int64)
        self.rep = []
        for r in range(walks.repetitions):
            keys = walks.keys(words, at, r)
            order = np.argsort(keys, kind="stable")
            bitmap = np.zeros(1 << self.BITS, bool)
            bitmap[keys >> np.uint64(64 - self.BITS)] = True
            self.rep.append((keys[order], at[order], owner[order], bitmap))

    def found(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text, passage) indices of verified windows, distinct."""
        words, first = word_hashes(texts)
        w = self.walks.window
        # deletions may leave a run that is shorter than the window
        n = np.maximum(np.diff(first) - (w - self.walks.edits) + 1, 0)
        if not n.sum() or not len(self.words):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at += np.repeat(first[:-1], n)
        hits: list[np.ndarray] = []
        for r, (keys, theirs, owner, bitmap) in enumerate(self.rep):
            mine = self.walks.keys(words, at, r)
            probe = np.flatnonzero(bitmap[mine >> np.uint64(64 - self.BITS)])
            lo, hi = np.searchsorted(keys, mine[probe], "left"), np.searchsorted(keys, mine[probe], "right")
            probe, lo, hi = probe[hi > lo], lo[hi > lo], hi[hi > lo]
            if not len(probe):
                continue
            k = np.arange((hi - lo).sum()) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
            x, y = at[np.repeat(probe, hi - lo)], theirs[k]
            ok = np.ones(len(x), bool)
            if self.walks.edits == 0:
                for j in range(w):
                    keep = words[x + j] == self.words[y + j]
                    x, y, k = x[keep], y[keep], k[keep]
                ok = np.ones(len(x), bool)
            else:
                ends = first[np.searchsorted(first, x, side="right")]
                for lo in range(0, len(x), VERIFIED):
                    part = slice(lo, lo + VERIFIED)
                    ok[part] = edit_distances(words, x[part], ends[part], self.words, y[part], w, self.walks.edits) <= self.walks.edits
            text = np.searchsorted(first, x[ok], side="right") - 1
            hits.append(np.unique(np.stack([text, owner[k[ok]]], axis=1), axis=0))
        if not hits:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        both = np.unique(np.concatenate(hits), axis=0)
        return both[:, 0], both[:, 1]


def leaked_passages(docs: DataFrame, passages: DataFrame, window: int = 20, edits: int = 0, recall: float = 0.95) -> DataFrame:
    """(doc_id, passage_id): texts that contain ``window`` consecutive words of a passage with at most ``edits`` word edits (substitutions, insertions, deletions).

    Texts and passages are compared by their lower-cased words. Null, blank and
    shorter texts and passages have no windows and no rows; a text with several
    hits of one passage has one row. Passages are sent to the tasks in blocks
    of at most INDEX_WINDOWS words (the driver reads them as a stream); each
    block scans the texts once.
    """
    walks = Walks(window, edits, recall)
    blocks, held, size = [], [], 0
    for row in passages.filter("passage_id is not null and passage is not null").select("passage_id", "passage").toLocalIterator():
        size += len(row.passage) // 2 + 1
        held.append((row.passage_id, row.passage))
        if size >= INDEX_WINDOWS:
            blocks.append(held)
            held, size = [], 0
    if held or not blocks:
        blocks.append(held)
    texts = docs.filter("doc_id is not null and text is not null").select("doc_id", "text")
    out = None
    for block in blocks:
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index([i for i, _ in shared.value], [p for _, p in shared.value], walks)
            for b in batches:
                ids = b.column(0).to_numpy()
                for at, part in portions(b.column(1).to_pylist()):
                    t, p = index.found(part)
                    if len(t):
                        yield pa.RecordBatch.from_arrays([pa.array(ids[at + t]), pa.array(index.ids[p])], names=["doc_id", "passage_id"])

        one = texts.mapInArrow(run, "doc_id bigint, passage_id bigint")
        out = one if out is None else union_all(out, one)
    # doc_id is unique and a text is scanned whole, so rows are distinct unless a document or passage is repeated
    return out.distinct()


def leak_report(docs: DataFrame, passages: DataFrame, window: int = 20, edits: int = 0) -> DataFrame:
    """(passage_id, suite, n_docs): the passages that leaked, with the number of texts that contain them."""
    found = leaked_passages(docs, passages, window, edits)
    return found.groupBy("passage_id").agg(F.count(F.lit(1)).alias("n_docs")).join(passages.select("passage_id", "suite"), "passage_id").select("passage_id", "suite", "n_docs")
