"""Token counts; huge documents in overlapping chunks that are spliced again."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from parley.llm.common import per_process, picked
from parley.llm.words import split_at_spaces
from parley.session import written_once


TASK_CHARS = 2_000_000  # of long texts, for one task
# White space as the vocabulary file sees it: the separators U+001C to U+001F are none.
SPACE = re.compile(r"[^\S\x1c-\x1f]")


def tokenizer_of(path: str) -> Tokenizer:
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class PieceCounts(dict):
    """Tokens of runs without white space, by the tokenizers library, remembered up to ``most`` runs.

    The vocabulary file drops white space, and none of its steps looks across it, so a text's tokens are
    those of its runs in turn. Many runs are encoded at a time, each by itself, and its tokens counted.
    """

    def __init__(self, path: str, most: int = 300_000, together: int = 2_000):
        super().__init__()
        self.most, self.together = most, together
        self.older: dict[str, int] = {}
        self.tokenizer = tokenizer_of(path)

    def learn(self, pieces: set[str]) -> None:
        if len(self) > self.most:
            # Two generations: what is still used is carried over.
            self.older = dict(self)
            self.clear()
        new = pieces.difference(self)
        for piece in new & self.older.keys():
            self[piece] = self.older[piece]
        new = list(new.difference(self.older))
        for at in range(0, len(new), self.together):
            some = new[at : at + self.together]
            found = self.tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
            # Of each token, which run it is of; none for a special token, which may also be a part of one.
            of = found.word_ids
            if None in of:
                self.update((piece, len(self.tokenizer.encode(piece, add_special_tokens=False))) for piece in some)
            else:
                self.update(zip(some, np.bincount(np.array(of, np.int64), minlength=len(some)).tolist()))


def boundaries(text: str, tokenizer: Tokenizer) -> tuple[list[int], list[int], int]:
    """Where tokens start behind white space in a chunk, how many tokens are before each, and all its tokens.

    There any encoding of a chunk that holds this white space starts a token: the boundary is stable.
    """
    found = tokenizer.encode(text, add_special_tokens=False)
    stable = [(start, k) for k, (start, _) in enumerate(found.offsets) if start and SPACE.match(text, start - 1)]
    # The tokens of one character have the same start: the first of them counts.
    first = dict(reversed(stable))
    starts = sorted(first)
    return starts, [first[s] for s in starts], len(found)


def short_counts(docs: DataFrame, path: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = per_process(("pieces", path), lambda: PieceCounts(path))
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                split = [split_at_spaces(t) for t in part["text"]]
                counts.learn(set().union(*split))
                found = [sum(map(counts.__getitem__, pieces)) for pieces in split]
                yield pd.DataFrame({"doc_id": part["doc_id"].array, "n_bytes": part["n_bytes"].array, "n_tokens": found})

    # Ids travel as text: pandas would turn whole numbers beside a null into floats.
    kind = docs.schema["doc_id"].dataType
    source = docs.select(F.col("doc_id").cast("string"), "text", "n_bytes")
    found = source.mapInPandas(run, "doc_id string, n_bytes bigint, n_tokens bigint")
    return found.withColumn("doc_id", F.col("doc_id").cast(kind))


def encoded_chunks(docs: DataFrame, path: str, chunk: int, overlap: int, tasks: int) -> DataFrame:
    """A row per chunk of ``docs(fp, text)``: its tokens and its stable boundaries in both overlaps.

    The chunks are dealt over as many ``tasks`` as their text calls for, wherever their document lay.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for fp, text in zip(batch["fp"], batch["text"]):
                at = 0
                while at == 0 or at + overlap < len(text):
                    row = [(fp, at // chunk, text[at : at + chunk + overlap])]
                    yield pd.DataFrame(row, columns=["fp", "no", "text"])
                    at += chunk

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = per_process(("tokenizer", path), lambda: tokenizer_of(path))
        for batch in batches:
            for fp, no, text in zip(batch["fp"], batch["no"], batch["text"]):
                offsets, before, total = boundaries(text, tokenizer)
                start = no * chunk
                head = {start + o: b for o, b in zip(offsets, before) if o < overlap}
                tail = {start + o: b for o, b in zip(offsets, before) if o >= chunk}
                yield pd.DataFrame({"fp": [fp], "no": [no], "total": [total], "head": [head], "tail": [tail]})

    chunks = docs.mapInPandas(cut, "fp string, no bigint, text string")
    chunks = chunks.repartition(tasks, "fp", "no")
    return chunks.mapInPandas(
        encode, "fp string, no bigint, total bigint, head map<bigint,bigint>, tail map<bigint,bigint>"
    )


def spliced(chunks: DataFrame) -> DataFrame:
    """``(fp, n_tokens)``; null where two neighbours have no stable boundary in common."""
    in_order = Window.partitionBy("fp").orderBy("no")
    rows = chunks.withColumn("last_tail", F.lag("tail").over(in_order)).withColumn("next_head", F.lead("head").over(in_order))
    both = lambda a, b: F.array_min(F.array_intersect(F.map_keys(a), F.map_keys(b)))
    rows = rows.withColumn("begin", both("last_tail", "head")).withColumn("end", both("tail", "next_head"))
    begin = F.when(F.col("last_tail").isNull(), F.lit(0)).otherwise(F.col("head")[F.col("begin")])
    end = F.when(F.col("next_head").isNull(), F.col("total")).otherwise(F.col("tail")[F.col("end")])
    rows = rows.withColumn("own", end - begin)
    return rows.groupBy("fp").agg(F.when(F.count("own") == F.count(F.lit(1)), F.sum("own")).alias("n_tokens"))


def token_counts(
    docs: DataFrame,
    tokenizer_path: str,
    limit: int = 2048,
    chunk: int = 32_768,
    overlap: int = 512,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Tokens of every whole text: ``doc_id, n_bytes, n_tokens, over_limit``.

    Texts up to ``chunk`` characters are counted where they are read. Longer ones are cut into
    overlapping chunks that are encoded in tasks of their own; neighbours are joined at a boundary that
    both found after white space inside their overlap. Where there is none, the document is cut anew with
    four times the overlap, until one chunk holds it: a text without any white space is encoded in one
    piece, by a worker that has to hold it. Copies of a long text are encoded once. A null text is empty (0 tokens), a null id stays
    null, repeated rows give repeated rows, an empty table gives none, columns beside the two named ones are not looked at.
    """
    rows = picked(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("bigint"))
    short = short_counts(rows.where(F.char_length("text") <= chunk), tokenizer_path)
    long = rows.where(F.char_length("text") > chunk).withColumn("fp", F.sha2("text", 256))
    texts = written_once(long.select("fp", "text").dropDuplicates(["fp"]), "long-texts")
    todo, found, width = texts, None, overlap
    while True:
        chars = todo.agg(F.sum(F.char_length("text"))).first()[0] or 0
        chunks = encoded_chunks(todo, tokenizer_path, chunk, width, 1 + chars // TASK_CHARS)
        counted = written_once(spliced(chunks), "token-counts")
        done = counted.where("n_tokens is not null")
        found = done if found is None else found.union(done)
        failed = counted.where("n_tokens is null")
        if failed.isEmpty():
            break
        todo, width = texts.join(failed.select("fp"), "fp", "left_semi"), width * 4
    counts = short.union(long.select("doc_id", "n_bytes", "fp").join(found, "fp").select("doc_id", "n_bytes", "n_tokens"))
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
