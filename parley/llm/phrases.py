"""Phrase collocations by dynamic itemset counting over cyclic scans of shards."""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from parley.llm.common import mixed, per_process, picked
from parley.session import scratch_path, written_once

# Separators of pieces become one sign, which no word can hold.
STOP = b"."
AS_STOPS = bytes.maketrans(b",;:!?\n\x0b\x0c\r", STOP * 9)
BETWEEN = re.compile(rb"[ \t.]")
TOGETHER = 4_000_000  # bytes of text whose equal phrases are counted together
NEVER = 255
BYTE_STEP = np.uint64(0xD6E8FEB86659FD93)
HASH_STEP = np.uint64(0x9E3779B97F4A7C15)
LEAST_SLOTS, MOST_SLOTS = 1 << 20, 1 << 26
SCANNED = "lang string, phrase string, m tinyint, slot int, start int, f bigint"


def split_words(text: bytes) -> tuple[np.ndarray, pa.Array]:
    """The words of a text and its stops, as codes, and what each code stands for. Nothing happens word by word."""
    spaced = text.replace(STOP, b" . ")
    whole = pa.StringArray.from_buffers(1, pa.py_buffer(np.array([0, len(spaced)], np.int32)), pa.py_buffer(spaced))
    found = pc.ascii_split_whitespace(whole).flatten().dictionary_encode()
    codes, known = found.indices.to_numpy().astype(np.int64), found.dictionary
    empty = pc.index(known, "").as_py()
    return (codes if empty < 0 else codes[codes != empty]), known.cast(pa.binary())


def word_hashes(known: pa.Array) -> np.ndarray:
    """A hash of each word, from sums of its bytes times powers; for slots only, equal ones do no harm."""
    offsets = np.frombuffer(known.buffers()[1], np.int32)[known.offset : known.offset + len(known) + 1].astype(np.int64)
    data = np.frombuffer(known.buffers()[2] or b"", np.uint8)[: offsets[-1] if len(offsets) else 0].astype(np.uint64)
    powers = np.full(len(data) + 1, BYTE_STEP)
    powers[0] = 1
    powers = np.cumprod(powers)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data + np.uint64(1)) * powers[:-1])))
    # Powers of an odd number have inverses: a word's hash does not depend on where it lies.
    back = np.full(len(data) + 1, np.uint64(pow(int(BYTE_STEP), -1, 1 << 64)))
    back[0] = 1
    back = np.cumprod(back)
    return mixed((sums[offsets[1:]] - sums[offsets[:-1]]) * back[offsets[:-1]])


def blocks(text: bytes) -> Iterator[bytes]:
    """The text in parts of about ``TOGETHER`` bytes, cut between words."""
    at = 0
    while at < len(text):
        cut = BETWEEN.search(text, at + TOGETHER)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def distinct_windows(codes: np.ndarray, starts: np.ndarray, m: int, size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Each different window of ``m`` codes below ``size``, as its codes in turn, and how often it occurs. Exact.

    Codes are packed into one number as far as they fit; what does not fit goes on from numbered heads.
    """
    bits = max(1, int(size).bit_length())
    known, keys, room, at = None, None, 63, 0
    while True:
        taken = min(m - at, room // bits)
        for k in range(at, at + taken):
            keys = codes[starts + k] if keys is None else (keys << bits) | codes[starts + k]
        at += taken
        if at == m:
            keys.sort()
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            counts, seen = np.diff(np.append(first, len(keys))), keys[first]
        else:
            seen, keys = np.unique(keys, return_inverse=True)
            room = 63 - max(1, len(seen).bit_length())
        columns = [(seen >> (bits * k)) & ((1 << bits) - 1) for k in range(taken - 1, -1, -1)]
        if known is not None:
            heads = seen >> (bits * taken)
            columns = [column[heads] for column in known] + columns
        if at == m:
            return columns, counts
        known = columns


class Scan:
    """Counts the phrases that are active at one step, text by text.

    ``reached`` has a row of slots for each length: the step at which a phrase of the slot has reached the
    threshold. ``last`` is the last step at which a length had a new one.
    """

    def __init__(self, step: int, shards: int, reached: np.ndarray, last: list[int]):
        self.step, self.shards, self.reached, self.last = step, shards, reached, last
        self.longest, self.since = len(reached) + 1, max(0, step - shards)
        self.shift = np.uint64(64 - int(reached.shape[1]).bit_length() + 1)

    def slot(self, lang: str, total: np.ndarray) -> np.ndarray:
        return ((total + np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))) >> self.shift).astype(np.int64)

    def counted(self, lang: str, text: bytes) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        for block in blocks(text):
            codes, known = split_words(b" ".join([*held, block]))
            yield from self.of_words(lang, codes, known, len(held))
            held = known.take(pa.array(codes[1 - self.longest :])).to_pylist()

    def of_words(self, lang: str, codes: np.ndarray, known: pa.Array, before: int) -> Iterator[pa.RecordBatch]:
        """Windows that end behind the first ``before`` words, which belong to the last block."""
        hashes, n = word_hashes(known), len(known)
        sign = pc.index(known, pa.scalar(STOP, pa.binary())).as_py()
        stop = codes == sign
        inside = ~stop
        if self.step < self.shards:
            counts = np.bincount(codes[before:], minlength=n)
            if sign >= 0:
                counts[sign] = 0
            own = np.flatnonzero(counts)
            yield self.rows(lang, known, hashes, [own], counts[own], 1)
            total = pa.array([int(counts.sum())], pa.int64())
            yield self.batch(lang, pa.array([""]), 0, np.zeros(1, np.int64), np.zeros(1, np.int64), total)
        total, of_word = hashes[codes], None
        for m in range(2, self.longest + 1):
            if len(codes) < m or max(self.last[m - 1 :]) < self.since:
                return
            if m > 2:
                of_word = hashes[codes] if of_word is None else of_word
                total = total[:-1] * HASH_STEP + of_word[m - 2 :]
            inside = inside[:-1] & ~stop[m - 1 :]
            # Without a new phrase one word shorter, within one cycle, no phrase of this length is active.
            if self.last[m - 1] < self.since:
                continue
            since = self.reached[m - 2][self.slot(lang, total)]
            latest = np.maximum(since[:-1], since[1:])
            chosen = np.flatnonzero(inside & (latest >= self.since) & (latest < self.step))
            chosen = chosen[chosen + m > before]
            if len(chosen):
                columns, counts = distinct_windows(codes, chosen, m, n)
                yield self.rows(lang, known, hashes, columns, counts, m)

    def rows(self, lang, known, hashes, columns, counts, m) -> pa.RecordBatch:
        def total(part: list[np.ndarray]) -> np.ndarray:
            out = hashes[part[0]]
            for column in part[1:]:
                out = out * HASH_STEP + hashes[column]
            return self.slot(lang, out)

        parts = [known.take(pa.array(column)) for column in columns]
        phrase = parts[0] if m == 1 else pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary()))
        # The longest phrases are part of no other: their slot is not asked for.
        slot = total(columns) if m < self.longest else np.zeros(len(counts), np.int64)
        start = np.zeros(len(counts), np.int64)
        if m > 1:
            reached = self.reached[m - 2]
            start = 1 + np.maximum(reached[total(columns[:-1])], reached[total(columns[1:])]).astype(np.int64)
        return self.batch(lang, phrase.cast(pa.string()), m, slot, start, pa.array(counts.astype(np.int64)))

    def batch(self, lang, phrase, m, slot, start, f) -> pa.RecordBatch:
        n = len(phrase)
        columns = [
            pa.repeat(pa.scalar(lang, pa.string()), n),
            phrase,
            pa.repeat(pa.scalar(m, pa.int8()), n),
            pa.array(slot.astype(np.int32)),
            pa.array(start.astype(np.int32)),
            f,
        ]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "m", "slot", "start", "f"])


def scanned(shard: DataFrame, step: int, shards: int, reached: np.ndarray, last: list[int], token: str) -> DataFrame:
    """Occurrences in one shard of the phrases that are active at ``step``."""
    packed, shape = zlib.compress(reached.tobytes(), 1), reached.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make() -> Scan:
            return Scan(step, shards, np.frombuffer(zlib.decompress(packed), np.uint8).reshape(shape), last)

        scan = per_process(("phrases", token, step), make)
        waiting: dict[str, list[bytes]] = {}
        held = 0
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for lang, text in zip(batch.column("lang").to_pylist(), texts):
                text = text.as_py().lower().translate(AS_STOPS)
                waiting.setdefault(lang, []).append(text)
                held += len(text)
                if held >= TOGETHER:  # of all languages together
                    for name in list(waiting):
                        yield from scan.counted(name, STOP.join(waiting.pop(name)))
                    held = 0
        for name in list(waiting):
            yield from scan.counted(name, STOP.join(waiting.pop(name)))

    return shard.select("lang", "text").mapInArrow(run, SCANNED)


def frequent_phrases(texts: DataFrame, threshold: int, longest: int, shards: int) -> DataFrame:
    """``lang, phrase, m, f`` of all phrases of up to ``longest`` words that occur ``threshold`` times.

    The row of ``m = 0`` has the number of all words of the language. ``texts`` has ``lang, text``.

    Texts are dealt over shards. Step after step one shard is scanned, round and round, and all phrases
    that are active are counted in it, whatever their length. Words are active from the beginning; a longer
    phrase becomes active in the step after both its subphrases, without its last and without its first
    word, have reached the threshold, and is counted for one full cycle, so its count is exact. Scans end
    when a cycle has passed since the last phrase reached it.

    Which subphrases have reached it, and when, is kept in arrays of slots by hash, one for each length,
    broadcast with each step. Two phrases in one slot share the earlier step: a phrase may be counted for
    nothing, but always for one whole cycle. The arrays have a byte for 64 bytes of text, 64 MB at most;
    beyond, more phrases share slots and are counted for nothing, and the results are the same.
    """
    if not 0 < shards * longest < NEVER:
        raise ValueError("too many shards for the steps that a byte tells apart")
    if longest < 2:
        raise ValueError("a phrase has two words at least")
    spark, token = texts.sparkSession, uuid.uuid4().hex
    root, seen = scratch_path(spark, "shards"), Observation()
    dealt = texts.withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int"))
    dealt = dealt.observe(seen, F.sum(F.octet_length("text").cast("bigint")).alias("bytes"))
    dealt.write.partitionBy("shard").parquet(root)
    table = spark.read.schema("lang string, text string, shard int").parquet(root)
    size = LEAST_SLOTS
    while size < MOST_SLOTS and size * 64 < (seen.get["bytes"] or 0):
        size *= 2
    lengths = 1 << max(1, longest - 1).bit_length()
    reached = np.full((longest - 1, max(2, size // lengths)), NEVER, np.uint8)
    # The last step at which phrases of each length had a new one; words are there from the beginning.
    state, done, step, last = None, [], 0, [-1 - shards] * (longest + 1)
    enough, over = F.col("f") >= threshold, F.col("start") + shards
    while step < shards or step <= max(last) + shards:
        found = scanned(table.where(F.col("shard") == step % shards), step, shards, reached, last, token)
        both = found.withColumn("new", F.col("f"))
        if state is not None:
            both = both.unionByName(state.withColumn("new", F.lit(0).cast("bigint")))
        same = [F.max(c).alias(c) for c in ("m", "slot", "start")]
        counts = both.groupBy("lang", "phrase").agg(*same, F.sum("f").alias("f"), F.sum("new").alias("new"))
        fresh = enough & (F.col("f") - F.col("new") < threshold) & F.col("m").between(1, longest - 1)
        counts = counts.withColumns({"fresh": fresh, "over": over <= step + 1})
        counts = written_once(counts.where(~F.col("over") | enough | (F.col("m") == 0)).drop("new"), "phrase-counts")
        # At most as many numbers as there are slots.
        slots = counts.where("fresh").select("m", "slot").distinct().toPandas()
        for m, of_length in slots.groupby("m"):
            new = of_length["slot"].to_numpy(np.int64)
            new = new[reached[m - 1][new] == NEVER]
            if len(new):
                reached[m - 1][new] = step
                last[m] = step
        state = counts.where("not over").drop("fresh", "over")
        done.append(counts.where("over").select("lang", "phrase", "m", "f"))
        step += 1
    found = done[0]
    for more in done[1:]:
        found = found.union(more)
    return written_once(found, "frequent-phrases")


def score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """``floor(1000 * a * n / (left * right))``, exact for counts below 10^15."""
    wide = lambda c: c.cast("decimal(19,0)")
    product = lambda x, y: x.cast("decimal(18,0)") * wide(y)
    exact = F.struct(product(a * 1000, n).alias("over"), product(left, right).alias("under"))
    return F.call_function("div", exact["over"], exact["under"])


def looked_up(cuts: DataFrame, counts: DataFrame, part: str, name: str, salts: int = 8) -> DataFrame:
    """The count of a part of each cut. A word that begins very many phrases is dealt over ``salts`` keys."""
    salted = cuts.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)).cast("int"))
    keys = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    known = counts.where("m > 0").select("lang", F.col("phrase").alias(part), F.col("f").alias(name), keys)
    return salted.join(known, ["lang", part, "salt"]).drop("salt")


def collocations(
    docs: DataFrame,
    threshold: int = 100,
    longest: int = 5,
    top: int = 2000,
    share: int = 100,
    shards: int = 3,
    lang_col: str = "lang",
    text_col: str = "text",
) -> DataFrame:
    """The best phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    A text is lower-cased (A-Z), split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those at spaces and tabs into
    words. Candidates are the phrases of 2 to ``longest`` words, inside a piece, that occur ``a >=
    threshold`` times in the texts of a language. The score is that of the worst cut in two parts that
    occur ``l`` and ``r`` times, ``floor(1000 * a * n / (l * r))`` with ``n`` words in all (ties: the earliest cut).
    A candidate goes if it stands inside a longer candidate of at least ``share`` hundredths of its count.
    The ``top`` remaining are ranked by score, then ``a`` (both descending), then phrase.

    Phrases are counted by :func:`frequent_phrases`, combined in each task before the shuffle, so a frequent
    phrase or a large group of copies is a row per task. A null language is ``und``, a null text empty;
    repeated rows count as often as they come; a language without candidates has no rows, and an empty table
    gives none. A text of any length that fits a row is read in blocks. Other columns are not looked at.
    """
    texts = picked(docs, lang=lang_col, text=text_col)
    texts = texts.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    counts = frequent_phrases(texts, threshold, longest, shards)
    words = written_once(counts.where("m = 0").select("lang", F.col("f").alias("n")), "words")
    found = counts.where("m > 1").select("lang", "phrase", "m", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))

    def part(begin, size) -> Column:
        return F.array_join(F.slice("w", begin, size), " ")

    at = F.col("k")
    cuts = found.select("*", F.explode(F.sequence(F.lit(1), F.col("m").cast("int") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(1, at).alias("first"), part(at + 1, F.size("w") - at).alias("rest"))
    cuts = looked_up(looked_up(cuts, counts, "first", "l"), counts, "rest", "r").join(words, "lang")
    cuts = cuts.withColumn("score", score(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    worst = cuts.groupBy("lang", "phrase").agg(
        F.max("a").alias("a"), F.max("n").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("cut")
    )
    # The most frequent candidate around each shorter phrase.
    inner = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.size("w") - 1),
            lambda size: F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.struct(i.alias("i"), size.alias("size"))),
        )
    )
    around = found.where("m > 2").select("lang", "w", "a", F.explode(inner).alias("at"))
    around = around.select("lang", part(F.col("at.i"), F.col("at.size")).alias("phrase"), F.col("a").alias("around"))
    around = around.groupBy("lang", "phrase").agg(F.max("around").alias("around"))
    kept = worst.join(around, ["lang", "phrase"], "left")
    kept = kept.where(F.col("around").isNull() | (100 * F.col("around") < share * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
