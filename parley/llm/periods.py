"""Runs of repeated words: Lyndon arrays from the first phase of Baier's suffix sorting, extended into runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from parley.llm.common import mixed, picked, window_hashes

GRAM = 4
ROUNDS = 64  # of cutting; what is not cut then is only more to look at
TOGETHER = 4_000_000  # bytes of text whose repeats are looked for in one go


class Codes(dict):
    """A number for each distinct word, in the order of their first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        return code


def lyndon_array(symbols: list[int]) -> list[int]:
    """The length of the longest Lyndon word that starts at each place.

    This is the grouping phase. Places are grouped by a common context, at first their symbol, and groups
    are taken from the greatest down. A taken group's context follows, once or several times, the
    context of the nearest place to the left that has not been taken yet: these places move, with the
    longer context, into new groups just above their own, more repeats higher. When its group is taken, a
    place's context is the longest Lyndon word there. A place moves once at most for each place
    that it absorbs, so the work is linear.
    """
    n = len(symbols)
    first: dict[int, list[int]] = {}
    for i, symbol in enumerate(symbols):
        first.setdefault(symbol, []).append(i)
    members, size, group_of = [], [], [0] * n
    for g, symbol in enumerate(sorted(first)):
        members.append(first[symbol])
        size.append(1)
        for i in first[symbol]:
            group_of[i] = g
    below = list(range(-1, len(members) - 1))
    above = list(range(1, len(members) + 1))
    # Places that are not taken yet, as a list linked both ways; the last cell is that of both ends.
    left, right = [*range(-1, n - 1), n - 1], [*range(1, n + 1), 0]
    left[0] = n
    host, found = [n] * (n + 1), [0] * n
    g = len(members) - 1
    while g >= 0:
        taken = [i for i in members[g] if group_of[i] == g]
        length, repeats = size[g], {}
        for i in taken:
            j = left[i]
            if j < n and group_of[j] == g:
                j = host[j]
            host[i] = j
            if j < n:
                repeats[j] = repeats.get(j, 0) + 1
        moves: dict[tuple[int, int], list[int]] = {}
        for j, times in repeats.items():
            moves.setdefault((times, group_of[j]), []).append(j)
        for times, old in sorted(moves, reverse=True):
            new = len(members)
            members.append(moves[times, old])
            size.append(size[old] + times * length)
            for j in members[new]:
                group_of[j] = new
            upper = above[old]
            below.append(old)
            above.append(upper)
            above[old] = new
            # Above the highest group there is none; that one was taken first, so `upper` always exists.
            below[upper] = new
        for i in taken:
            found[i] = length
            a, b = left[i], right[i]
            right[a], left[b] = b, a
        g = below[g]
    return found


def common_prefix(a: np.ndarray, b: np.ndarray) -> int:
    """The longest common extension: how many leading symbols two arrays share."""
    n, at, step = min(len(a), len(b)), 0, 16
    while at < n:
        end = min(n, at + step)
        differs = a[at:end] != b[at:end]
        if differs.any():
            return at + int(differs.argmax())
        at, step = end, step * 2
    return n


def roots(lengths: np.ndarray, symbols: np.ndarray, times: int) -> np.ndarray:
    """Places where ``times`` Lyndon words of one length and one first symbol follow each other."""
    places = np.arange(len(lengths))
    for k in range(1, times):
        after = places + k * lengths[places]
        places, after = places[after < len(lengths)], after[after < len(lengths)]
        same = (lengths[after] == lengths[places]) & (symbols[after] == symbols[places])
        places = places[same]
    return places


def runs_of(symbols: np.ndarray, spans: list[tuple[int, int]], least: int, exponent: int) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every run, given spans of which each run lies in one.

    The Lyndon words of a span under both orders of the symbols are the roots of its runs. A span holds
    the symbol after its runs, so their roots are those of the whole sequence; each root is then extended
    in the whole sequence.
    """
    found = set()
    for begin, end in spans:
        _, codes = np.unique(symbols[begin:end], return_inverse=True)
        for order in (codes, -codes):
            lengths = np.array(lyndon_array(order.tolist()))
            reached: dict[int, int] = {}
            for place in roots(lengths, codes, exponent - 1).tolist():
                period, at = int(lengths[place]), begin + place
                if reached.get(period, 0) >= at + period:
                    continue
                after = common_prefix(symbols[at:], symbols[at + period :])
                before = common_prefix(symbols[:at][::-1], symbols[: at + period][::-1])
                length = before + period + after
                if length >= max(least, exponent * period):
                    reached[period] = at + period + after
                    found.add((at - before, length, period))
    return sorted(found, key=lambda run: (run[0], run[2]))


def repeating_spans(symbols: np.ndarray, doc: np.ndarray, ends: np.ndarray, least: int, exponent: int):
    """Spans ``(document, begin, end)`` outside of which no document has a run. Exact, whatever repeats.

    Inside a run of period q every gram of k symbols comes again after at most q places, at one place
    after the other for ``max(least, exponent * q) - q - k + 1`` places. So a stretch of L such places
    holds runs of a period up to ``(L + k - 1) / (exponent - 1)`` alone, and is cut where a gram comes
    again later than that, until nothing is left to cut (or after enough rounds: spans may be too wide). ``doc`` is the document of each symbol and
    ``ends`` the end of each document.
    """
    wanted = [max(least, exponent * q) - q for q in range(1, least + 2)]
    k = max(1, min(GRAM, *wanted))
    shortest = max(1, min(wanted) - k + 1)
    n = len(symbols)
    if n < k:
        return []
    keys = window_hashes(mixed(symbols.astype(np.uint64) + np.uint64(1)), k)
    # Grams are compared within a document only; one that reaches into the next has no second.
    keys = keys + mixed(doc[: len(keys)].astype(np.uint64) + np.uint64(1 << 40))
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    never = np.int64(n + 1)
    again = np.full(len(keys), never)
    again[order[:-1][same]] = np.diff(order)[same]
    inside = np.arange(len(keys)) + k <= ends[doc[: len(keys)]]
    # The second of a pair of equal keys could be the gram that reaches out.
    second = np.minimum(np.arange(len(keys)) + again, len(keys) - 1)
    alive = inside & (again < never) & inside[second]
    for turn in range(ROUNDS + 1):
        edges = np.flatnonzero(np.diff(np.concatenate(([0], alive.view(np.int8), [0]))))
        begins, stops = edges[::2], edges[1::2]
        # Stretches of two documents never touch: the last gram of a document does not come again in it.
        sizes = stops - begins
        longest = (sizes + k - 1) // (exponent - 1)
        limit = np.repeat(np.where(sizes >= shortest, longest, 0), sizes)
        places = np.flatnonzero(alive)
        cut = places[again[places] > limit]
        if not len(cut) or turn == ROUNDS:
            return [
                (int(doc[b]), b, int(min(ends[doc[b]], e + q + k)))
                for b, e, q in zip(begins.tolist(), stops.tolist(), longest.tolist())
            ]
        alive[cut] = False


def periodic_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: int = 6,
    exponent: int = 4,
) -> DataFrame:
    """Runs of repeated words of every whole text, and the text without their repeats.

    A run is a stretch of consecutive words with smallest period q, of at least ``max(least, exponent * q)``
    words (``exponent`` at least 2), which no neighbouring word extends. Words are what white space
    (``[\\x20\\x09-\\x0D]``) separates, numbered from 0 in each text.

    Returns ``doc_id, n_words, n_runs``, the run of greatest length (ties: smallest start, then period) as
    ``start, length, period, exponent_milli``, all runs as text (``runs``: a line ``start,length,period``
    each, by start and period) and ``collapsed``: the words joined by one space, without those that a run
    holds after its first q.

    Grams that come again in time narrow a text down to spans that may hold runs; there the grouping phase
    gives the Lyndon words of both orders, and those that repeat are extended. A projection: no shuffle,
    so hot keys and groups of copies cost nothing extra. A text must fit a row and the words of one text
    fit a worker. A null, empty or blank text has no words, no run (nulls) and empty strings; repeated
    rows give repeated rows, a null id stays null, an empty table gives no rows, further columns are not
    looked at.
    """
    source = picked(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    fields = "n_words bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint"
    schema = S.StructType([source.schema["doc_id"], *S.StructType.fromDDL(f"{fields}, runs string, collapsed string")])

    def judged(words: list[bytes], symbols: np.ndarray, spans: list[tuple[int, int]]) -> tuple:
        runs = runs_of(symbols, spans, least, exponent) if spans else []
        best = max(runs, key=lambda run: (run[1], -run[0], -run[2]), default=None)
        numbers = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
        if runs:
            keep = np.ones(len(words), bool)
            for start, length, period in runs:
                keep[start + period : start + length] = False
            words = [words[i] for i in np.flatnonzero(keep).tolist()]
        lines = "".join([f"{start},{length},{period}\n" for start, length, period in runs])
        return (len(symbols), len(runs), *numbers, lines, b" ".join(words).decode())

    def together(texts: list[bytes]) -> list[tuple]:
        split = [text.split() for text in texts]
        sizes = np.array([len(words) for words in split])
        codes = Codes()
        symbols = np.concatenate([np.fromiter(map(codes.__getitem__, w), np.int64, len(w)) for w in split])
        ends = np.cumsum(sizes)
        spans: dict[int, list[tuple[int, int]]] = {}
        for d, begin, end in repeating_spans(symbols, np.repeat(np.arange(len(texts)), sizes), ends, least, exponent):
            offset = int(ends[d] - sizes[d])
            spans.setdefault(d, []).append((begin - offset, end - offset))
        return [
            judged(words, symbols[end - size : end], spans.get(d, []))
            for d, (words, size, end) in enumerate(zip(split, sizes.tolist(), ends.tolist()))
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            sizes = np.cumsum([len(t) for t in texts.to_pylist()]) if len(texts) else []
            at = 0
            while at < len(texts):
                done = sizes[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(sizes, done + TOGETHER, side="right")))
                rows = together(texts.slice(at, end - at).to_pylist())
                found = [pa.array(c, pa.int64()) for c in list(zip(*rows))[:-2]]
                strings = [pa.array(c, pa.string()) for c in list(zip(*rows))[-2:]]
                ids = batch.column("doc_id").slice(at, end - at)
                yield pa.RecordBatch.from_arrays([ids, *found, *strings], names=schema.names)
                at = end

    return source.mapInArrow(run, schema)
