"""Word-piece token counts by a linear longest-match automaton.

The pieces form a trie: one root for pieces that begin a word, one for pieces that go on.  Where
a node has no way on, its failure link leads to where the rest of what was read stands after
the longest pieces in front are taken off, and the node knows how many that are.  So the greedy
pieces of a word are counted in one pass over its bytes and never built.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tidegate.llm.common import portions, resident

# Words whose counts a Python worker remembers.
REMEMBERED = 500_000
_START, _INNER = 0, 1


class PieceCounter(dict):
    """Number of greedy pieces by word (bytes); 0 for a word that the pieces cannot spell."""

    def __init__(self, begin: Iterable[bytes], inner: Iterable[bytes]):
        super().__init__()
        self.ways: list[dict[int, int]] = [{}, {}]
        ends = set()
        for root, pieces in ((_START, begin), (_INNER, inner)):
            for piece in pieces:
                node = root
                for c in piece:
                    node = self.ways[node].setdefault(c, len(self.ways))
                    if node == len(self.ways):
                        self.ways.append({})
                if piece:
                    ends.add(node)
        n = len(self.ways)
        self.fail: list[int] = [-1] * n
        self.pops = [0] * n
        level = [_START, _INNER]
        while level:
            below = []
            for parent in level:
                for c, node in self.ways[parent].items():
                    below.append(node)
                    if node in ends:
                        self.fail[node], self.pops[node] = _INNER, 1
                        continue
                    back, pops = self.fail[parent], self.pops[parent]
                    while back >= 0 and c not in self.ways[back]:
                        pops += self.pops[back]
                        back = self.fail[back]
                    if back >= 0:
                        self.fail[node], self.pops[node] = self.ways[back][c], pops
            level = below

    def count(self, word: bytes) -> int:
        ways, fail, pops = self.ways, self.fail, self.pops
        node, n = _START, 0
        for c in word:
            while c not in ways[node]:
                n += pops[node]
                node = fail[node]
                if node < 0:
                    return 0
            node = ways[node][c]
        while node != _INNER:
            n += pops[node]
            node = fail[node]
            if node < 0:
                return 0
        return n

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = self[word] = self.count(word)
        return n


def byte_characters() -> dict[str, int]:
    """The printable characters that byte-level vocabularies write for the 256 bytes."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    names = {b: chr(b) for b in plain}
    for i, b in enumerate(b for b in range(256) if b not in names):
        names[b] = chr(256 + i)
    return {c: b for b, c in names.items()}


def byte_level_pieces(spec: str) -> tuple[list[bytes], list[bytes]]:
    """Pieces from a byte-level vocabulary (``tokenizers`` JSON): tokens with a leading space begin
    a word, the others go on."""
    byte = byte_characters()
    tokens = [bytes(byte[c] for c in t) for t in json.loads(spec)["model"]["vocab"] if all(c in byte for c in t)]
    return [t[1:] for t in tokens if t[:1] == b" " and len(t) > 1], [t for t in tokens if t[:1] != b" "]


def load(spec: str) -> PieceCounter:
    return PieceCounter(*byte_level_pieces(spec))


def counts(docs: DataFrame, spec: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_words``, ``n_tokens`` and ``n_unknown`` of every whole text.

    Words stand between ASCII white space.  A word that the pieces cannot spell is unknown and
    counts as one token.  Null and empty texts have no words; repeated rows and null ids are
    returned as they occur.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = resident(load, spec)
        for batch in portions(batches):
            words, tokens, unknown = [], [], []
            for text in batch.column(1).cast(pa.large_binary()):
                found = [pieces[w] for w in (text.as_py() or b"").split()]
                words.append(len(found))
                unknown.append(found.count(0))
                tokens.append(sum(found) + unknown[-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in (words, tokens, unknown))],
                ["doc_id", "n_words", "n_tokens", "n_unknown"])

    return docs.select(id_col, text_col).mapInArrow(
        run, f"doc_id {kind}, n_words long, n_tokens long, n_unknown long")
