"""Language identification by cross-parsing entropy.

A suffix automaton per language holds all substrings of a bounded sample of labelled text.  A
text is parsed into phrases, each the longest match with a substring of the sample; the
language that needs the fewest, weighted by the bits that name a place in its sample, wins.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegate.llm.common import portions, resident

UNKNOWN = "und"
# Symbols: 0 ends a piece, 1 is any run of characters that are no letters, 2 a letter that no
# sample has, the rest the letters of the samples: the frequent ones as one symbol each, all others,
# where a byte cannot number them, spelled in two or three.
END, GAP, OTHER = 0, 1, 2
LETTER_SYMBOLS = 250
_SPELLED = 256
# A text is parsed in pieces of so many symbols, all pieces of a batch in step.
PIECE = 256
_STEP_SYMBOLS = 1 << 22


@dataclass(frozen=True)
class LanguageModel:
    """Sample text of each language, in order of the languages' names."""

    samples: tuple[tuple[str, str], ...]

    @property
    def tables(self) -> Tables:
        return resident(_tables, self.samples)


@dataclass(frozen=True)
class Tables:
    languages: tuple[str, ...]
    symbol: np.ndarray  # by code point; from 256 on a row of spelled
    spelled: np.ndarray  # the symbols of each letter that has several
    moves: np.ndarray  # next row of the table * 2 + 1 if a phrase ended
    starts: np.ndarray  # row of each language's first state
    bits: np.ndarray  # cost of a phrase
    width: int = field(default=0)


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings; state 0 is the empty one."""
    moves: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in symbols:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return moves


def _alphabet(letters: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols by code point for ``letters``, the most frequent first, and how the rarer ones are
    spelled.  Each place of a spelling has symbols of its own, so no two letters run together."""
    symbol = np.full(0x110000, GAP, np.int32)
    for code in range(0x110000):
        if chr(code).isalpha():
            symbol[code] = OTHER
    places, digits = 0, 0
    if len(letters) > LETTER_SYMBOLS:
        places, digits = next(
            (n, d) for n in (2, 3, 4) for d in range(2, LETTER_SYMBOLS * 4 // 5 // n)
            if d ** n >= len(letters) - (LETTER_SYMBOLS - n * d))
    plain = min(len(letters), LETTER_SYMBOLS - places * digits)
    for i, c in enumerate(letters):
        symbol[ord(c)] = OTHER + 1 + i if i < plain else _SPELLED + i - plain
    rare = np.arange(len(letters) - plain)
    spelled = [OTHER + 1 + plain + at * digits + rare // digits ** at % digits for at in range(places)]
    return symbol, np.array(spelled, np.uint8).reshape(places, len(rare)).T


def _tables(samples: tuple[tuple[str, str], ...]) -> Tables:
    """Built in each Python worker: only the samples travel."""
    letters = Counter(c for _, text in samples for c in text.lower() if c.isalpha())
    symbol, spelled = _alphabet([c for c, _ in sorted(letters.items(), key=lambda x: (-x[1], x[0]))])
    width = OTHER + 1 + min(len(letters), LETTER_SYMBOLS)
    parts, starts, bits, rows = [], [], [], 0
    for _, text in samples:
        own = symbols_of([text], symbol, spelled)[0]
        states = suffix_automaton(own.tolist())
        lost = len(states)  # one state more, after a symbol that no phrase can hold
        table = np.zeros((len(states) + 1, width), np.int64)
        # Without a way on the phrase ends, and the next begins with this symbol.
        fresh = np.array([states[0].get(c, lost) for c in range(width)])
        table[:] = (rows + fresh) * width * 2 + 1
        table[0] -= 1  # nothing has been read: no phrase ends
        table[:, END] = (rows + np.arange(len(table))) * width * 2
        for s, ways in enumerate(states):
            for c, to in ways.items():
                table[s, c] = (rows + to) * width * 2
        parts.append(table)
        starts.append(rows * width)
        bits.append(math.log2(len(own) + 2))
        rows += len(table)
    moves = np.concatenate(parts).ravel() if parts else np.empty(0, np.int64)
    if len(moves) < 1 << 30:
        moves = moves.astype(np.int32)
    return Tables(tuple(name for name, _ in samples), symbol, spelled, moves, np.array(starts), np.array(bits), width)


_NONE = np.empty((0, 0), np.uint8)


def symbols_of(texts: list[str], symbol: np.ndarray, spelled: np.ndarray = _NONE) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts in a row, runs without letters as one, and how many each text has."""
    low = [t.lower() for t in texts]
    ends = np.cumsum([len(t) for t in low], dtype=np.int64)
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    found = symbol[codes]
    keep = np.ones(len(found), bool)
    keep[1:] = (found[1:] != GAP) | (found[:-1] != GAP)
    keep[ends[:-1][ends[:-1] < len(found)]] = True  # each text for itself
    times = np.where(found < _SPELLED, 1, max(spelled.shape[1], 1)) * keep
    before = np.concatenate([[0], np.cumsum(times)])
    sizes = np.diff(before[np.concatenate([[0], ends])])
    out = np.repeat(found, times)
    if spelled.size:
        at = np.flatnonzero((found >= _SPELLED) & keep)
        places = before[at][:, None] + np.arange(spelled.shape[1])
        out[places] = spelled[found[at] - _SPELLED]
    return out.astype(np.uint8), sizes


def phrases(texts: list[str], tables: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Number of phrases by text and language, and the texts' numbers of symbols.

    Each piece of ``PIECE`` symbols is parsed from the first state, so that all pieces of a
    batch move on in step; a text is parsed to its end.
    """
    found, sizes = symbols_of(texts, tables.symbol, tables.spelled)
    pieces = -(-sizes // PIECE)
    owner = np.repeat(np.arange(len(texts)), pieces)
    counts = np.zeros((len(texts), len(tables.languages)), np.int64)
    if not len(owner):
        return counts, sizes
    first_piece = np.concatenate([[0], np.cumsum(pieces)[:-1]])
    place = np.arange(len(found)) - np.repeat(np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    grid = np.zeros(len(owner) * PIECE, np.uint8)
    grid[np.repeat(first_piece, sizes) * PIECE + place] = found
    grid = np.ascontiguousarray(grid.reshape(-1, PIECE).T)
    for at, start in enumerate(tables.starts):
        state = np.full(len(owner), start, tables.moves.dtype)
        ended = np.ones(len(owner), np.int32)  # the phrase that is open at the end
        for row in grid:
            state = tables.moves.take(state + row)
            ended += state & 1
            state >>= 1
        counts[:, at] = np.bincount(owner, weights=ended, minlength=len(texts))
    return counts, sizes


def classify(texts: list[str | None], model: LanguageModel) -> list[tuple[str, float]]:
    """Language and score of each text.  The score is the share of bits that the best language
    saves against the next one: 0 a tie, 1 if there is no other.  ``und`` with score 0 for a null
    text, one without a letter, and where nothing was learned."""
    tables = model.tables
    out = [(UNKNOWN, 0.0)] * len(texts)
    # A very long text is parsed in stretches, whose phrases add up.
    ask = [
        (i, t[at: at + _STEP_SYMBOLS]) for i, t in enumerate(texts)
        if t and tables.languages and any(map(str.isalpha, t)) for at in range(0, len(t), _STEP_SYMBOLS)
    ]
    total: dict[int, np.ndarray] = {}
    while ask:
        taken, size = 0, 0
        while taken < len(ask) and (not taken or size + len(ask[taken][1]) <= _STEP_SYMBOLS):
            size += len(ask[taken][1])
            taken += 1
        now, ask = ask[:taken], ask[taken:]
        counts, _ = phrases([t for _, t in now], tables)
        for (i, _), row in zip(now, counts):
            total[i] = total[i] + row if i in total else row
    for i, row in total.items():
        cost = row * tables.bits
        rank = np.argsort(cost, kind="stable")
        score = 1.0 if len(rank) == 1 else float(1 - cost[rank[0]] / cost[rank[1]])
        out[i] = (tables.languages[rank[0]], score)
    return out


def fit(labelled: DataFrame, chars: int = 16_384, docs_per_language: int = 64) -> LanguageModel:
    """Learn from the columns ``doc_id``, ``text`` and ``lang``.

    The sample of a language is cut at ``chars`` characters from at most ``docs_per_language``
    documents, those with the smallest hash of their id, equal texts once.  Rows with a null
    text or language teach nothing; a language whose sample has no letter is not learned.
    """
    by_hash = Window.partitionBy("lang").orderBy("h", "doc_id")
    few = F.row_number().over(by_hash) <= docs_per_language
    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL").withColumn("h", F.xxhash64("doc_id"))
    # Ids first: texts are read only for the few that are chosen.
    ids = rows.select("doc_id", "lang", "h").withColumn("few", few).where("few").select("doc_id", "lang").distinct()
    chosen = rows.join(F.broadcast(ids), ["doc_id", "lang"], "left_semi").select(
        "doc_id", "lang", "h", F.substring("text", 1, chars).alias("text"))
    chosen = chosen.withColumn("few", few).where("few").collect()
    samples: dict[str, dict[str, None]] = {}
    for r in sorted(chosen, key=lambda r: (r.lang, r.h, str(r.doc_id), r.text)):
        samples.setdefault(r.lang, {})[r.text] = None
    joined = {lang: "\n".join(texts)[:chars] for lang, texts in samples.items()}
    return LanguageModel(tuple(
        (lang, text) for lang, text in sorted(joined.items()) if any(map(str.isalpha, text))))


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` of every row, from the whole text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 1_024):
            found = classify(batch.column(1).to_pylist(), model)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x for x, _ in found], pa.string()),
                 pa.array([x for _, x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def keep_known(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of ``docs`` whose text is in a language that was learned, with all their columns:
    those that are ``und`` go."""
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 1_024):
            found = classify(batch.column(text).to_pylist(), model)
            yield batch.filter(pa.array([lang != UNKNOWN for lang, _ in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
