"""BPE encoding by traversal of a trie of distinct words, and decoding.

For merges in a fixed order the encoding of a word is the encoding of a shorter prefix and
one more token, its last one; a sequence of tokens is an encoding exactly if each two
neighbours are one.  So each node of a trie of words needs only its last token, which is found
among the tokens that end there from the last token of a node above; words share what they
have in common.  The words of a batch in sorted order are that trie in depth-first order.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from tidegate.llm.common import portions, resident

# What a Python worker remembers: words, tokens that fit together, and chunks of texts that are not
# plain.  Of each as many as have come since it last was full, and as many from before.
WORDS = 250_000
CHUNKS = 50_000
# Settings of a vocabulary that would change ids or text; none of them is followed here.
_MODEL_OPTIONS = ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges")
_TOKEN_FLAGS = ("single_word", "lstrip", "rstrip", "normalized")
# Characters of text whose new words go into one trie.
_TRIE_CHARS = 1 << 20
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_SPACE = re.compile(r"(?:(?![\x1c-\x1f])\s)+")
# With these settings text in Latin-1 and general punctuation is lower-cased and split
# as _PLAIN does it; other text, and other settings, are left to the library.
_PLAIN_SPEC = [
    {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
         "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
]
_LETTERS, _DIGITS = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾"
_PLAIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^\\s{_LETTERS}{_DIGITS}]+").findall
_NOT_PLAIN = re.compile("[^\t-\r -~\x85\xa0-\xac\xae-\xff\u2010-\u2027\u2030-\u205e\u20a0-\u20bf]").search
# Byte-level vocabularies write bytes that are no printable Latin-1 characters as others, in order.
_BYTE_CHARACTERS = {b: 256 + i for i, b in enumerate(
    b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255))}


def _at_spaces(text: str) -> list[str]:
    """The text in parts of about ``_TRIE_CHARS``, cut where no word and no special token is."""
    cuts, at = [0], _TRIE_CHARS // 2
    while at < len(text) and (space := text.find(" ", at)) >= 0:
        cuts.append(space)
        at = space + _TRIE_CHARS // 2
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])]


class _Recent:
    """What was computed lately, by key; what has not been asked for during a whole generation is
    forgotten."""

    def __init__(self, most: int):
        self.most = most
        self.now: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def get_all(self, keys: set[str], compute: Callable[[set[str]], dict[str, bytes]]) -> dict[str, bytes]:
        """A table that has all the keys."""
        lacking = keys - self.now.keys()
        if len(self.now) + len(lacking) > self.most:
            self.now, self.before = {k: self.now[k] for k in keys - lacking}, self.now
        old = lacking & self.before.keys()
        self.now.update({k: self.before[k] for k in old})
        self.now.update(compute(lacking - old))
        return self.now


class WordBPE:
    """A vocabulary with word ends (``tokenizers`` JSON): merges, and text to and from ids."""

    def __init__(self, spec: str):
        given = json.loads(spec)
        model = given["model"]
        if model["type"] != "BPE" or not model.get("end_of_word_suffix"):
            raise ValueError("a BPE vocabulary with a word end is needed")
        # What would change ids or text and is not followed here.
        unread = [name for name in ("decoder", "post_processor") if given.get(name)]
        unread += [name for name in _MODEL_OPTIONS if model.get(name)]
        unread += [name for t in given["added_tokens"] for name in _TOKEN_FLAGS if t.get(name)]
        if unread:
            raise ValueError(f"a vocabulary with {', '.join(unread)} is not supported")
        library = Tokenizer.from_str(spec)
        self._normal, self._split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self._plain = [given["normalizer"], given["pre_tokenizer"]] == _PLAIN_SPEC
        self.end: str = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in given["added_tokens"]}
        self.names = [""] * (max([*self.vocab.values(), *self.special.values()]) + 1)
        for name, i in [*self.vocab.items(), *self.special.items()]:
            self.names[i] = name
        # Without special tokens a pattern that never fits: the empty one would fit everywhere.
        names = "|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))
        self._cut = re.compile(f"({names or '(?!)'})")
        vocab = self.vocab
        self._merge: dict[tuple[int, int], int] = {}
        self._made = [-1] * len(self.names)  # when a token is made; -1: it is a symbol
        self._left, self._right = list(range(len(self.names))), list(range(len(self.names)))
        for when, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            token = vocab[a + b]
            self._merge[vocab[a], vocab[b]] = when
            self._made[token], self._left[token], self._right[token] = when, vocab[a], vocab[b]
        # Word ends are one symbol with the character before them.
        # Tokens by what they end with, from the last character to the first: a character leads to
        # the token that is complete with it (or None) and to the characters before it.
        self._inner, self._last = {}, {}
        for name, i in sorted(vocab.items(), key=lambda x: len(x[0])):
            final = name.endswith(self.end)
            node = self._last if final else self._inner
            first, *rest = name[: -len(self.end)] if final else name
            for c in reversed(rest):
                node = node.setdefault(c, (None, {}))[1]
            node[first] = (i, node.get(first, (None, {}))[1])
        self._fits: dict[int, bool] = {}
        self._plain_ids, self._chunk_ids = _Recent(WORDS), _Recent(CHUNKS)

    def neighbours(self, a: int, b: int) -> bool:
        """Whether merging the symbols of ``a`` followed by ``b`` ends with just these two.

        The merges at the border are undone from the last to the first: a merge across the
        border must not have come before what made either side.  Of equal merges the left one
        comes first.
        """
        x, y, before = a, b, len(self._merge)
        while True:
            across = self._merge.get((x, y))
            if across is not None and across < before:
                break
            if self._made[x] < 0 and self._made[y] < 0:
                across = None
                break
            if self._made[x] > self._made[y]:
                before, x = self._made[x], self._right[x]
            else:
                before, y = self._made[y] + 1, self._left[y]
        self._fits[a << 32 | b] = across is None
        return across is None

    def encode_words(self, words: list[str]) -> dict[str, list[int]]:
        """Ids of the words (in byte characters)."""
        out: dict[str, list[int]] = {}
        inner, last = self._inner, self._last
        if len(self._fits) > WORDS:
            self._fits.clear()
        fits = self._fits
        # By depth: the last token of the prefix and where it begins.
        tokens, starts = [-1], [0]
        before = ""
        for word in sorted(set(words)):
            # The states of the prefix shared with the word before stay, the others are left behind.
            depth, most = 0, min(len(tokens), len(word)) - 1
            while depth < most and word[depth] == before[depth]:
                depth += 1
            del tokens[depth + 1:], starts[depth + 1:]
            size = len(word)
            for at in range(depth + 1, size + 1):
                # Of the tokens that end here, the one that goes with the last token before it.
                ending = inner if at < size else last
                start = at
                while True:
                    start -= 1
                    found = ending.get(word[start]) if start >= 0 else None
                    if found is None:
                        raise ValueError(f"no token ends {word[:at]!r}")
                    token, ending = found
                    if token is not None:
                        if start == 0:
                            break
                        known = fits.get(tokens[start] << 32 | token)
                        if known or known is None and self.neighbours(tokens[start], token):
                            break
                if at < size:
                    tokens.append(token)
                    starts.append(start)
            ids = [token]
            while start > 0:
                ids.append(tokens[start])
                start = starts[start]
            out[word] = ids[::-1]
            before = word
        return out

    def _learn_words(self, words: set[str]) -> dict[str, bytes]:
        """Encode plain words, all in one trie."""
        names = {w: w if w.isascii() else w.encode().decode("latin-1").translate(_BYTE_CHARACTERS) for w in words}
        ids = self.encode_words(list(names.values()))
        return {w: struct.pack(f"<{len(ids[n])}I", *ids[n]) for w, n in names.items()}

    def _learn_chunks(self, chunks: set[str]) -> dict[str, bytes]:
        """Encode what stands between white space, as the library normalises and splits it."""
        split = {c: [w for w, _ in self._split(self._normal(c))] for c in chunks}
        ids = self.encode_words([w for words in split.values() for w in words])
        return {c: b"".join([struct.pack(f"<{len(ids[w])}I", *ids[w]) for w in words]) for c, words in split.items()}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each whole text as little-endian unsigned 32-bit integers; a null text has none.

        Words (of plain texts) and chunks between white space (of others) are encoded once and
        remembered.
        """
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            if len(texts[at] or "") > _TRIE_CHARS and (parts := _at_spaces(texts[at]))[1:]:
                out.append(b"".join([ids for part in parts for ids in self.encode([part])]))
                at += 1
                continue
            size, found = 0, []
            while at < len(texts) and (not size or size + len(texts[at] or "") <= _TRIE_CHARS):
                text = texts[at] or ""
                size += len(text)
                # Every other part is a special token.
                found.append([(p, []) if i % 2 else self._pieces(p) for i, p in enumerate(self._cut.split(text))])
                at += 1
            known = {
                memory: memory.get_all(set().union(*(p for text in found for m, p in text if m is memory)), learn)
                for memory, learn in ((self._plain_ids, self._learn_words), (self._chunk_ids, self._learn_chunks))
            }
            for text in found:
                out.append(b"".join([
                    struct.pack("<I", self.special[m]) if isinstance(m, str) else b"".join(map(known[m].__getitem__, pieces))
                    for m, pieces in text
                ]))
        return out

    def _pieces(self, text: str) -> tuple[_Recent, list[str]]:
        """Words or chunks, and where their ids are remembered."""
        if self._plain and not _NOT_PLAIN(text):
            return self._plain_ids, _PLAIN(text.lower())
        # str.split() also splits at four control characters that are no white space.
        return self._chunk_ids, [c for c in _SPACE.split(text) if c] if _ODD_SPACE.search(text) else text.split()

    def decode(self, ids: bytes) -> str:
        """The names of the tokens, joined by spaces: the vocabulary names no decoder."""
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(docs: DataFrame, spec: str, decoded: bool = False, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit integers) of every whole
    text, and its ``decoded`` ids if asked for.

    ``spec`` is the vocabulary's JSON text.  A null or empty text has no ids and decodes to the
    empty text.  Repeated rows are returned as often as they occur, null ids too.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = resident(WordBPE, spec)
        for batch in portions(batches):
            ids = bpe.encode(batch.column(1).to_pylist())
            columns = {"doc_id": batch.column(0), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                       "ids": pa.array(ids, pa.binary())}
            if decoded:
                columns["decoded"] = pa.array(map(bpe.decode, ids), pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    schema = f"doc_id {kind}, n_tokens long, ids binary" + ", decoded string" * decoded
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def decode(encoded: DataFrame, spec: str) -> DataFrame:
    """``doc_id`` and ``text`` of the ``ids`` of ``encode``; null ids decode to the empty text."""
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = resident(WordBPE, spec)
        for batch in portions(batches):
            texts = [bpe.decode(x or b"") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")
