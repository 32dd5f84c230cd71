"""Byte-level BPE by backtracking over longest matches, exact and linear.

Text is cut by the vocabulary's pattern; each piece is encoded on its own. An
Aho-Corasick automaton over the tokens gives, at a position, the longest token
there; next-shorter prefixes come from a table. A token is taken if it is
compatible with the one before, that is if the merges of both, concatenated, keep
the cut between them; otherwise the next shorter one is tried, and if none is
left the previous token is taken back. A bit per position marks dead ends, so no
position is tried twice with the same outcome. The result equals that of
applying the merges in rank order.

Pieces repeat, so each worker keeps those it has seen, up to a bound.
"""

from __future__ import annotations

import base64
import functools
import importlib.util
import os
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quern.llm.words import hashes, points, portions

#: Fixed value: the public pattern that goes with the vocabulary; piece_bounds() cuts as it does.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces that a worker remembers.
REMEMBERED = 400_000


def default_vocabulary() -> str:
    """QUERN_TOKENIZERS/byte_bpe_50k.tiktoken, or that of the installed public_tokenizers, or of /opt/tokenizers."""
    spec = importlib.util.find_spec("public_tokenizers")
    folder = os.environ.get("QUERN_TOKENIZERS") or (os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers")
    return os.path.join(folder, "byte_bpe_50k.tiktoken")


class Encoder:
    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.rank = {t: i for i, t in enumerate(tokens)}
        # token bytes as latin-1 text, which maps bytes to code points one to one
        self.matcher = ahocorasick.Automaton()
        for i, t in enumerate(tokens):
            self.matcher.add_word(t.decode("latin-1"), i)
        self.matcher.make_automaton()
        self.shorter = [self._longest_prefix(t) for t in tokens]
        self.parts: list[tuple[int, int]] = [self._split(t) for t in tokens]
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
        self.fits: dict[tuple[int, int], bool] = {}

    @classmethod
    def from_ranks(cls, path: str) -> "Encoder":
        """Reads lines of a base64 token and its rank; ranks are 0, 1, 2, ..."""
        with open(path, "rb") as lines:
            pairs = sorted((int(r), base64.b64decode(t)) for t, r in (x.split() for x in lines if x.strip()))
        return cls([t for _, t in pairs])

    def _longest_prefix(self, token: bytes) -> int:
        """The longest token that is a proper prefix, or -1."""
        for n in range(len(token) - 1, 0, -1):
            if token[:n] in self.rank:
                return self.rank[token[:n]]
        return -1

    def _split(self, token: bytes) -> tuple[int, int]:
        """The two tokens whose merge makes ``token``: what lower ranks leave of it; (-1, -1) for single bytes."""
        if len(token) == 1:
            return -1, -1
        me = self.rank[token]
        parts = [bytes([c]) for c in token]
        while len(parts) > 2:
            ranks = [self.rank.get(a + b, me) for a, b in zip(parts, parts[1:])]
            k = min(range(len(ranks)), key=ranks.__getitem__)
            if ranks[k] >= me:
                return -1, -1
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return self.rank[parts[0]], self.rank[parts[1]]

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the bytes of tokens a and b, one after the other, ends with just a and b."""
        known = self.fits.get((a, b))
        if known is None:
            known = self.fits[a, b] = self._keeps_cut(a, b)
        return known

    def _keeps_cut(self, left: int, right: int) -> bool:
        # walk both merge trees towards the cut, undoing the later merge first;
        # the cut is lost if a merge across it has a rank below the merges still standing
        limit = len(self.tokens)
        while True:
            across = self.rank.get(self.tokens[left] + self.tokens[right])
            if across is not None and across < limit:
                return False
            ls, rs = self.parts[left][1], self.parts[right][0]
            can_l, can_r = ls >= 0, rs >= 0
            if not can_l and not can_r:
                return True
            # the merge made last is undone: of equal ranks the right one, as merges run left to right;
            # for the same reason a merge across the cut comes before one of equal rank to its right
            if can_l and (not can_r or left > right):
                limit, left = left, ls
            else:
                limit, right = right + 1, rs

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.rank.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        text = piece.decode("latin-1")
        longest = [-1] * n
        for end, i in self.matcher.iter(text):
            at = end - len(self.tokens[i]) + 1
            if longest[at] < 0 or len(self.tokens[longest[at]]) < len(self.tokens[i]):
                longest[at] = i
        open_ = [True] * (n + 1)
        out: list[int] = []
        at, nxt = 0, longest[0]
        while at < n:
            token, last = nxt, (out[-1] if out else -1)
            while True:
                end = at + len(self.tokens[token])
                if open_[end] and (last < 0 or self.compatible(last, token)):
                    out.append(token)
                    at = end
                    nxt = longest[at] if at < n else -1
                    break
                token = self.shorter[token]
                if token < 0:
                    open_[at] = False
                    at -= len(self.tokens[last])
                    nxt = self.shorter[out.pop()]
                    while nxt < 0:  # the token taken back has no shorter one: this position is dead too
                        open_[at] = False
                        back = out.pop()
                        at -= len(self.tokens[back])
                        nxt = self.shorter[back]
                    break
        return out

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of ids by the offset table."""
        i = np.asarray(ids, np.int64)
        if not len(i):
            return b""
        n = self.offsets[i + 1] - self.offsets[i]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.offsets[i], n)
        return self.blob[at].tobytes()


#: Code points of Unicode white space, and the contractions of the pattern after the apostrophe.
WHITE = [*range(9, 14), 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
CONTRACTIONS = ("s", "t", "m", "d", "re", "ve", "ll")
LETTER, NUMBER, BLANK, OTHER = 0, 1, 2, 3


@functools.cache
def _kinds() -> np.ndarray:
    kinds = np.full(0x110000, OTHER, np.uint8)
    first = np.fromiter((ord(unicodedata.category(chr(i))[0]) for i in range(0x110000)), np.uint8, 0x110000)
    kinds[first == ord("L")] = LETTER
    kinds[first == ord("N")] = NUMBER
    kinds[WHITE] = BLANK
    return kinds


def piece_bounds(cp: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the pattern's pieces in texts that are cp[starts[i] : starts[i + 1] - 1], each followed by a line feed.

    A piece begins where the kind of character changes, except after a single
    space, which goes with what follows; a run of blanks before text leaves its
    last blank to a piece of its own, or to what follows if it is a space; and
    an apostrophe on its own may take one or two letters.
    """
    kind = _kinds()[cp]
    stop = np.zeros(len(cp) + 1, bool)  # true at the first character after a text
    stop[starts[1:] - 1] = True
    head = np.zeros(len(cp) + 1, bool)
    head[starts] = True
    cut = np.empty(len(cp) + 1, bool)
    cut[1:-1] = kind[1:] != kind[:-1]
    cut[0] = cut[-1] = True
    cut |= head | stop
    # the last blank of a run that is followed by text begins a piece, and takes the text along if it is a space
    n = len(cp)
    last = np.flatnonzero((kind[:-1] == BLANK) & (kind[1:] != BLANK) & ~stop[1:n] & ~stop[: n - 1] & ~head[1:n])
    cut[last] = True
    cut[last[cp[last] == 32] + 1] = False
    # contractions, where the apostrophe begins a piece and is the only character of its kind
    mark = np.flatnonzero((cp[:-2] == 39) & cut[: n - 2] & cut[1 : n - 1] & (kind[1:-1] == LETTER))
    for c in CONTRACTIONS:
        k = mark[mark + len(c) < n]
        for j, letter in enumerate(c, 1):
            k = k[cp[k + j] == ord(letter)]
        cut[k + 1] = False
        cut[k + 1 + len(c)] = True
    begin = np.flatnonzero(cut[:-1])
    end = np.append(begin[1:], n)
    text = ~stop[begin]  # the line feeds between texts are no pieces
    return begin[text], end[text]


class Pieces:
    """Ids of pieces by their hash; a worker keeps those it has seen, up to REMEMBERED."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder
        self.forget()

    def forget(self) -> None:
        self.known: dict[int, int] = {}
        self.ids: list[list[int]] = []

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the index of each text's first id (one more than texts)."""
        cp, starts = points(texts)
        begin, end = piece_bounds(cp, starts)
        h, at, which = np.unique(hashes(cp, begin, end), return_index=True, return_inverse=True)
        if len(self.known) + len(h) > REMEMBERED:
            self.forget()
        known, rows = self.known, []
        for key, b, e in zip(h.tolist(), begin[at].tolist(), end[at].tolist()):
            row = known.get(key)
            if row is None:
                row = known[key] = len(self.ids)
                piece = cp[b:e].tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "replace")
                self.ids.append(self.encoder.encode_piece(piece))
            rows.append(self.ids[row])
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.fromiter((i for r in rows for i in r), np.int32, int(sizes.sum()))
        first = np.cumsum(sizes) - sizes
        n = sizes[which]
        ends = np.cumsum(n)
        out = flat[np.arange(int(n.sum())) - np.repeat(ends - n, n) + np.repeat(first[which], n)]
        return out, np.concatenate([[0], ends])[np.searchsorted(begin, starts)]


@functools.cache
def encoder_of(path: str) -> Encoder:
    return Encoder.from_ranks(path)


@functools.cache
def _pieces_of(path: str) -> Pieces:
    return Pieces(encoder_of(path))


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>): the ids of each text without special tokens; one row per row, an empty list for null and empty texts.

    The strings of special tokens are ordinary text. ``path`` is the vocabulary
    file, which every executor must have.
    """
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces_of(path)
        for b in batches:
            for at, texts in portions(b.column(1).to_pylist()):
                ids, ends = pieces.encode(texts)
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), lists], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text): the texts of ids; an empty or null list gives an empty text."""
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder_of(path)
        for b in batches:
            texts = [e.decode(x or []).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")
