"""Benchmark decontamination by templates: words with numbers, units and names as typed placeholders."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import bitmap, in_bitmap, mixed, per_process, picked
from parley.session import written_once

WIDTH, PIECE, LONGEST = 8, 5, 20
SHORTEST, LEAST_WORDS = 3, 3
UNITS = set(
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles metre metres meter meters kilometre kilometres "
    "kilometer kilometers mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons tonne "
    "tonnes ml l litre litres liter liters gallon gallons s sec second seconds min minute minutes h hr hour hours day "
    "days week weeks month months year years dollar dollars cent cents euro euros percent degree degrees kmh mph".split()
)
NOTHING, WORD, NUMBER, UNIT, NAME = range(5)
NUMERIC = re.compile(r"[+-]?\d[\d.,:/]*([^\W\d_]*)%?\Z")
EDGES = re.compile(r"\A[\W_]+|[\W_]+\Z")


class Pieces(dict):
    """For each run without white space a number, under which its kind, hash and spelling are kept."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most
        self.empty()

    def empty(self) -> None:
        self.clear()
        self.spelled: list[str] = []
        size = 1 << 16
        self.kinds, self.ends = np.zeros(size, np.uint8), np.zeros(size, bool)
        self.hashes = np.zeros(size, np.uint64)

    def __missing__(self, piece: str) -> int:
        end = False
        if piece.isalpha():
            core = piece
        else:
            core = EDGES.sub("", piece)
            end = piece[-1] in ".?!:;" or (piece[-1] in "\"')" and piece[-2:-1] in tuple(".?!"))
        low = core.lower()
        if not core:
            kind = NOTHING
        elif low in UNITS:
            kind = UNIT
        elif core[0].isupper() and not core.isupper():
            kind = NAME
        else:
            number = None if core.isalpha() else NUMERIC.match(core.lstrip("$€£"))
            kind = NUMBER if number and (not number[1] or number[1].lower() in UNITS) else WORD
        value = len(self)
        if value == len(self.kinds):
            self.kinds, self.ends, self.hashes = (np.append(x, np.zeros_like(x)) for x in (self.kinds, self.ends, self.hashes))
        self.kinds[value], self.ends[value], self.hashes[value] = kind, end, xxhash.xxh3_64_intdigest(low)
        self.spelled.append(low)
        self[piece] = value
        return value


def canonical(texts: list[str]) -> tuple:
    """The tokens of all texts in one row: text, place in it, hash, kind of slot or none, number of spelling.

    A number is one wherever it stands; a unit only behind a number; a capitalised word is a name.
    The last array tells the names at the start of a sentence, which may be plain words as well.
    """
    pieces = per_process(("pieces of text",), Pieces)
    if len(pieces) > pieces.most:
        pieces.empty()
    words = [text.split() for text in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    index = np.fromiter(map(pieces.__getitem__, chain.from_iterable(words)), np.int64, counts.sum())
    owner = np.repeat(np.arange(len(words)), counts)
    kinds = pieces.kinds[index]
    real = kinds != NOTHING
    # A text starts a sentence, and what stands before it is no number of its own.
    starts = np.append(True, owner[1:] != owner[:-1])[: len(owner)]
    first = (starts | np.append(True, pieces.ends[index][:-1])[: len(owner)])[real]
    index, kinds, owner = index[real], kinds[real], owner[real]
    starts = np.append(True, owner[1:] != owner[:-1])[: len(owner)]
    after = np.append(False, kinds[:-1] == NUMBER)[: len(owner)] & ~starts
    slot = (kinds == NUMBER) | ((kinds == UNIT) & after) | (kinds == NAME)
    place = np.arange(len(owner)) - np.searchsorted(owner, owner)
    return owner, place, pieces.hashes[index], np.where(slot, kinds, 0), index, (kinds == NAME) & first, pieces.spelled


def windows(texts: list[str], widths: list[int]) -> Iterator[tuple]:
    """Per width and reading: the texts, positions and hashes of windows, and what stands in their slots.

    A window is read three ways where they differ: with capitalised words at the start of a sentence as
    plain words, with them as names - both with ``LEAST_WORDS`` plain words at least - and to the letter
    but for case, however few plain words it has.
    """
    owner, place, literal, kinds, index, unsure, spelled = canonical(texts)
    n = len(owner)
    sure = np.where(unsure, 0, kinds)

    def before(flags: np.ndarray) -> np.ndarray:
        return np.append(0, np.cumsum(flags))

    slots, all_slots, doubts = before(sure > 0), before(kinds > 0), before(unsure)
    readings = [(sure, slots, None), (kinds, all_slots, doubts), (np.zeros_like(kinds), None, slots)]
    for kind, held, wanted in readings:
        total = np.zeros(n, np.uint64)
        hashes = np.where(kind > 0, kind.astype(np.uint64), literal)
        for width in range(1, min(n, widths[-1]) + 1):
            # As window_hashes, one token more each time: all widths in one pass.
            total = total[: n - width + 1] * np.uint64(0x9E3779B97F4A7C15) + hashes[width - 1 :]
            if width not in widths:
                continue
            good = owner[: n - width + 1] == owner[width - 1 :]
            if held is not None:
                good &= held[width:] - held[: n - width + 1] <= width - LEAST_WORDS
            if wanted is not None:
                good &= wanted[width:] > wanted[: n - width + 1]
            at = np.flatnonzero(good)
            if len(at):
                values = partial(slots_at, width=width, kind=kind, index=index, spelled=spelled)
                yield width, at, owner[at], place[at], mixed(total[at] + np.uint64(width)), values


def slots_at(at: int, width: int, kind: np.ndarray, index: np.ndarray, spelled: list[str]) -> list[str]:
    """What stands in the slots of one window."""
    return [spelled[index[k]] for k in range(at, at + width) if kind[k]]


def item_windows(items: DataFrame, width: int, piece: int) -> DataFrame:
    """``(item, width, h, at, values, n, size)``: the windows of each item; of a short one, the whole.

    ``n`` is the number of its windows and ``size`` that of its tokens.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for item, text in zip(batch["item"], batch["text"]):
                size = len(canonical([text])[0])
                if size < SHORTEST:
                    continue
                found = []
                for wide, ats, _, places, hashes, values in windows([text], [size] if size <= width else [piece, width]):
                    for at, place, h in zip(ats.tolist(), places.tolist(), hashes.view(np.int64).tolist()):
                        found.append((item, wide, h, place, values(at)))
                n = len({(wide, place) for _, wide, _, place, _ in found})
                rows += [(*row, n, size) for row in found]
            yield pd.DataFrame(rows, columns=["item", "width", "h", "at", "values", "n", "size"])

    found = items.select(F.col("item").cast("string"), "text").mapInPandas(
        run, "item string, width int, h bigint, at int, values array<string>, n int, size int"
    )
    return found.withColumn("item", F.col("item").cast(items.schema["item"].dataType))


def found_windows(docs: DataFrame, own: DataFrame, widths: list[int], at_once: int = 1_000_000) -> DataFrame:
    """``(t1, t2, h, pos, slots)``: windows of the texts whose bit is set; the join that follows decides.

    Texts are worked on together, up to ``at_once`` characters and one text more.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(own, "h"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            sizes = batch["text"].str.len().cumsum().to_numpy(np.int64)
            for _, part in batch.groupby(sizes // at_once, sort=False):
                t1, t2, rows = part["t1"].to_numpy(), part["t2"].to_numpy(), []
                for _, ats, owners, places, hashes, values in windows(part["text"].tolist(), widths):
                    hit = np.flatnonzero(in_bitmap(bits, hashes))
                    found = (ats[hit].tolist(), owners[hit], places[hit].tolist(), hashes[hit].view(np.int64).tolist())
                    for at, own_t1, own_t2, place, h in zip(found[0], t1[found[1]], t2[found[1]], *found[2:]):
                        rows.append((own_t1, own_t2, h, place, values(at)))
                yield pd.DataFrame(rows, columns=["t1", "t2", "h", "pos", "slots"])

    return docs.mapInPandas(run, "t1 bigint, t2 bigint, h bigint, pos int, slots array<string>")


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    share: float = 0.5,
    width: int = WIDTH,
    piece: int = PIECE,
    longest: int = LONGEST,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``doc_id, item_id, n_windows, n_matched, n_changed, text_hash``: the items that each row's text contains.

    Texts become templates: lower-case words without punctuation at their edges, with ``number``,
    ``unit`` (behind a number) and ``name`` (capitalised) as typed placeholders; at the start of a
    sentence a capitalised word is tried as a name and as a plain word. Windows of ``piece`` and of
    ``width`` tokens are looked for, as templates with three plain words at least and to the letter but
    for case without any such bound. An item is contained when the windows found cover more than
    ``share`` of its tokens, ``width`` of them at least, or ``longest`` tokens in one run; an item of
    up to ``width`` tokens is one window and has to be found whole.

    Windows that lie at one distance from the item must agree on what stands in its slots - one value
    of the item is one value of the text. Where they do not, the windows that hold another value than
    the item in such a slot do not count: so a question with other numbers and names is found, and a
    text of like form but without that bond is not. ``n_windows`` and ``n_matched`` count the item's
    windows and those found; ``n_changed`` the item's values that are others in the text.

    Items of less than three tokens match nothing, and items without id or text take no part. Null and
    empty texts contain nothing, an empty table on either side gives no rows; a null doc id
    stays null; repeated rows of documents come back as often, repeated items count once. Copies of a
    text are joined by its hash once and spread to their ids at the end.
    """
    rows = picked(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit("text"), "text")})
    items = picked(benchmark, item=item_col, text=item_text_col).where("item is not null and text is not null").distinct()
    own = written_once(item_windows(items, width, piece), "item-windows")
    widths = sorted(r["width"] for r in own.select("width").distinct().collect())
    hits = found_windows(rows.select("t1", "t2", "text"), own, widths or [width])
    pairs = hits.join(own, "h").where(F.size("slots") == F.size("values"))
    kept = ["t1", "t2", "item", "n", "size", "width", "at", (F.col("pos") - F.col("at")).alias("shift"), "slots", "values"]
    pairs = written_once(pairs.select(*kept).distinct(), "matched-windows")

    # One value of the item, one value of the text, at each distance.
    one = ["t1", "t2", "item", "shift"]
    bonds = pairs.select(*one, F.explode(F.arrays_zip("values", "slots")).alias("v"))
    bonds = bonds.groupBy(*one, F.col("v.values").alias("value")).agg(
        F.min("v.slots").alias("low"), F.max("v.slots").alias("high")
    )
    # Of an item's values, not of a text: no longer than the item.
    bonds = bonds.groupBy(*one).agg(
        F.collect_list(F.when(F.col("low") != F.col("high"), F.col("value"))).alias("loose"),
        F.sum(((F.col("low") != F.col("value")) | (F.col("high") != F.col("value"))).cast("int")).alias("changed"),
    )
    held = pairs.join(bonds, one, "left")
    broken = F.exists(
        F.arrays_zip("values", "slots"), lambda v: (v["values"] != v["slots"]) & F.array_contains("loose", v["values"])
    )
    held = held.where(~F.coalesce(broken, F.lit(False)))
    # Windows at one distance, no more than the item has; then the tokens they cover, in runs.
    held = held.groupBy(*one).agg(
        F.first("n").alias("n"), F.first("size").alias("size"), F.first("changed").alias("changed"),
        F.collect_set(F.struct("at", "width")).alias("found"),
    )
    covered = F.flatten(F.transform("found", lambda w: F.sequence(w["at"], w["at"] + w["width"] - 1)))
    held = held.withColumn("covered", F.array_sort(F.array_distinct(covered)))
    start = F.struct(F.lit(-2).alias("last"), F.lit(0).alias("now"), F.lit(0).alias("best"))

    def longer(so_far: Column, token: Column) -> Column:
        now = F.when(token == so_far["last"] + 1, so_far["now"] + 1).otherwise(F.lit(1))
        return F.struct(token.alias("last"), now.alias("now"), F.greatest(so_far["best"], now).alias("best"))

    held = held.withColumn("run", F.aggregate("covered", start, longer)["best"])
    held = written_once(held, "held-windows")
    whole = ["t1", "t2", "item"]
    tokens = held.select(*whole, F.explode("covered").alias("token")).distinct().groupBy(*whole).agg(F.count(F.lit(1)).alias("tokens"))
    matched = held.select(*whole, F.explode("found").alias("w")).distinct().groupBy(*whole).agg(F.count(F.lit(1)).alias("n_matched"))
    held = held.groupBy(*whole).agg(
        F.first("n").alias("n_windows"), F.first("size").alias("size"), F.max("run").alias("run"),
        F.max(F.coalesce("changed", F.lit(0))).alias("n_changed"),
    )
    held = held.join(tokens, whole).join(matched, whole)
    enough = (F.col("tokens") > share * F.col("size")) & (F.col("tokens") >= F.least("size", F.lit(width)))
    enough = F.when(F.col("size") <= width, F.col("tokens") == F.col("size")).otherwise(enough)
    held = written_once(held.where(enough | (F.col("run") >= longest)), "leaks")
    return rows.select("doc_id", "t1", "t2").join(held, ["t1", "t2"]).select(
        "doc_id", F.col("item").alias("item_id"), "n_windows", "n_matched", F.col("n_changed").cast("bigint"), F.col("t1").alias("text_hash")
    )
