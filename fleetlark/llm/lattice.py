"""The lattice of pieces over a text, for a public SentencePiece vocabulary.

Pieces never reach from a letter or digit into other characters or into a following space, so
the lattice of a text falls apart into those of its units (spaces, then letters and digits, or
then other characters, with which ² counts). Each distinct unit is worked out once, in numpy over many units. A
character that is no piece of its own is spelt in bytes. A space goes before every text that is
not empty, as the vocabulary expects; U+2581 in a text is itself, not a space, and spelt in bytes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import sentencepiece

UNIT = re.compile(r" *[^\W_²]+| *(?:[^\w ]|[_²])+| +")
_CHAR = (1 << 21) - 1
_COLUMNS = 128
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def read_model(path: str = MODEL) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def units(text: str) -> list[str]:
    return UNIT.findall(" " + text) if text else []


class Numbers(dict):
    """Numbers units in the order in which they are first asked for."""

    def __missing__(self, unit: str) -> int:
        self[unit] = number = len(self)
        return number

    def of(self, text: str) -> np.ndarray:
        found = units(text)
        return np.fromiter(map(self.__getitem__, found), np.int64, len(found))


class Vocabulary:
    """Pieces as a trie, bytes of every id, and a fixed prior: piece n in the order of merges is
    as likely as 1 / (n + 10); a byte is as likely as the last piece.

    The trie is a table of steps for the characters that most of its edges have, and a sorted
    list of (node, character) for the others, so that many texts walk it at once."""

    def __init__(self, model: bytes):
        read = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size = read.get_piece_size()
        self.bytes = [_bytes_of(read, k) for k in range(self.size)]
        self.byte_ids = np.zeros(256, np.int64)
        edges: dict[int, int] = {}
        final = [-1]
        rank = np.full(self.size, float(self.size))
        for k in range(self.size):
            if read.is_byte(k):
                self.byte_ids[self.bytes[k][0]] = k
            elif not (read.is_control(k) or read.is_unknown(k)):
                surface = self.bytes[k].decode()
                if not re.fullmatch(UNIT, surface):
                    raise ValueError(f"the piece {surface!r} crosses a boundary of units")
                rank[k] = max(0.0, -read.get_score(k))
                node = 0
                for c in surface:
                    node = edges.setdefault(node << 21 | ord(c), len(final))
                    if node == len(final):
                        final.append(-1)
                final[node] = k
        self.prior = np.log(1 / (rank + 10))
        self.prior -= np.logaddexp.reduce(self.prior)
        self.final = np.array(final, np.int64)
        self.keys = np.array(sorted(edges), np.int64)
        self.children = np.array([edges[k] for k in self.keys.tolist()], np.int32)
        chars, times = np.unique(self.keys & _CHAR, return_counts=True)
        common = chars[np.argsort(-times, kind="stable")[:_COLUMNS]]
        self.column = np.full(_CHAR + 1, -1, np.int16)
        self.column[common] = np.arange(len(common))
        self.steps = np.full((len(final), _COLUMNS), -1, np.int32)
        column = self.column[self.keys & _CHAR]
        self.steps[self.keys[column >= 0] >> 21, column[column >= 0]] = self.children[column >= 0]

    def step(self, nodes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The nodes that these nodes reach by these characters, or -1."""
        column = self.column[chars]
        out = self.steps[nodes, column]
        rare = np.flatnonzero(column < 0)
        if len(rare):
            wanted = nodes[rare].astype(np.int64) << 21 | chars[rare]
            at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            out[rare] = np.where(self.keys[at] == wanted, self.children[at], -1)
        return out

    def decode(self, ids) -> str:
        """The text that ids spell; a lossless inverse of every encoding."""
        return spell(self.bytes, ids)


def piece_bytes(model: bytes) -> list[bytes]:
    """The bytes that each id stands for."""
    read = sentencepiece.SentencePieceProcessor(model_proto=model)
    return [_bytes_of(read, k) for k in range(read.get_piece_size())]


def _bytes_of(read: sentencepiece.SentencePieceProcessor, k: int) -> bytes:
    if read.is_byte(k):
        return bytes([int(read.id_to_piece(k)[3:5], 16)])
    return b"" if read.is_control(k) or read.is_unknown(k) else read.id_to_piece(k).replace("▁", " ").encode()


def spell(table: list[bytes], ids: list[int]) -> str:
    return b"".join([table[k] for k in ids]).decode("utf-8", "replace")[1:]


def spelt(vocabulary: Vocabulary, char: int) -> np.ndarray:
    return vocabulary.byte_ids[np.frombuffer(chr(char).encode(), np.uint8)]


@dataclass
class Lattice:
    """Edges of some units, sorted by end place and unit. A state is a place within a unit:
    ``base[unit] + place``. ``piece`` is an id, or -1 - code point for a character spelt in bytes."""
    lengths: np.ndarray
    base: np.ndarray
    source: np.ndarray
    target: np.ndarray
    piece: np.ndarray
    owner: np.ndarray
    columns: list[tuple[int, int]]

    @classmethod
    def of(cls, words: list[str], vocabulary: Vocabulary) -> Lattice:
        lengths = np.array([len(w) for w in words], np.int64)
        first = np.cumsum(lengths) - lengths
        base = first + np.arange(len(words))
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        unit = np.repeat(np.arange(len(words)), lengths)
        stop = (first + lengths)[unit]
        # every place of every unit walks the trie, one character at a time
        at, node, size = np.arange(len(codes)), np.zeros(len(codes), np.int32), 0
        single = np.zeros(len(codes), bool)
        starts, sizes, pieces = [], [], []
        while len(at):
            node = vocabulary.step(node, codes[at + size])
            at, node, size = at[node >= 0], node[node >= 0], size + 1
            piece = vocabulary.final[node]
            starts.append(at[piece >= 0])
            pieces.append(piece[piece >= 0])
            sizes.append(np.full(len(pieces[-1]), size))
            if size == 1:
                single[starts[0]] = True
            going = at + size < stop[at]
            at, node = at[going], node[going]
        spelt_out = np.flatnonzero(~single)
        start = np.concatenate([*starts, spelt_out])
        size = np.concatenate([*sizes, np.ones(len(spelt_out), np.int64)])
        piece = np.concatenate([*pieces, -1 - codes[spelt_out]])
        owner = unit[start]
        end = start + size - first[owner]
        order = np.argsort(end * (len(codes) + 1) + start)  # by end, unit and start
        owner, end, piece = owner[order], end[order], piece[order]
        start = start[order] - first[owner]
        cuts = np.searchsorted(end, np.arange(1, (int(lengths.max()) if len(words) else 0) + 2))
        return cls(lengths, base, base[owner] + start, base[owner] + end, piece, owner, list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)))

    def weights(self, logp: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
        """Log-probability of every edge, for each column of ``logp``."""
        out = logp[np.maximum(self.piece, 0)]
        rare = np.flatnonzero(self.piece < 0)
        if len(rare):
            values, which = np.unique(self.piece[rare], return_inverse=True)
            out[rare] = np.array([logp[spelt(vocabulary, -1 - v)].sum(axis=0) for v in values.tolist()])[which]
        return out

    def forward(self, weights: np.ndarray) -> np.ndarray:
        """Log of the summed probability of all ways to each state."""
        sums = np.full((int((self.lengths + 1).sum()), *weights.shape[1:]), -np.inf)
        sums[self.base] = 0
        for a, b in self.columns:
            if a < b:
                target = self.target[a:b]
                first = np.flatnonzero(np.concatenate(([True], target[1:] != target[:-1])))
                sums[target[first]] = np.logaddexp.reduceat(sums[self.source[a:b]] + weights[a:b], first, axis=0)
        return sums

    def backward(self, weights: np.ndarray) -> np.ndarray:
        """Log of the summed probability of all ways from each state to its unit's end."""
        order = np.argsort(self.source - self.base[self.owner], kind="stable")
        order = order[np.lexsort((self.source[order], (self.source - self.base[self.owner])[order]))][::-1]
        start = (self.source - self.base[self.owner])[order]
        sums = np.full((int((self.lengths + 1).sum()), *weights.shape[1:]), -np.inf)
        sums[self.base + self.lengths] = 0
        cuts = np.flatnonzero(np.concatenate(([True], start[1:] != start[:-1], [True]))) if len(start) else []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            edges = order[a:b]
            source = self.source[edges]
            first = np.flatnonzero(np.concatenate(([True], source[1:] != source[:-1])))
            sums[source[first]] = np.logaddexp.reduceat(sums[self.target[edges]] + weights[edges], first, axis=0)
        return sums

    def totals(self, sums: np.ndarray) -> np.ndarray:
        return sums[self.base + self.lengths]
