"""The pipeline on a small corpus with a case for each stage, against what must be left of it."""

import random
import re

import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from parley.llm.quality import quality_scores

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    draw = random.Random(11)
    words = ["".join(draw.choices("abcdefghij", k=draw.randint(2, 8))) for _ in range(800)]
    sentence = lambda n=14: (" ".join(draw.choices(words, k=n)) + ".").capitalize()
    docs, labels = [], []
    for k in range(300):
        lines = [" ".join(sentence() for _ in range(4)) for _ in range(4)]
        good = k % 5 != 2
        text = "\n".join(lines) if good else " ".join(w + "$$$" for w in " ".join(lines).split())
        docs.append((k, text))
        labels.append((k, int(good), 0))
    items = [(k, " ".join(sentence() for _ in range(3))) for k in range(5)]
    base = docs[0][1]
    extra = [
        (400, base), (401, base.replace("\n", "\n" + words[3] + " ", 1)), (402, sentence() + "\n" + items[2][1] + "\n" + sentence()),
        (403, None), (404, ""), (None, sentence(60)), (None, base), (405, "word"),
    ]
    docs += extra + [(405, "word")]
    docs = [(d, t + "\nShared by many " if t and d is not None and d < 40 else t) for d, t in docs]
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [(d, t, "en", "s", len(t or "")) for d, t in docs]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_pipeline(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    predicted = quality_scores(docs, spark.read.parquet(f"{folder}/labels.parquet")).where("predicted = 1")
    left = [(r.row.doc_id, r.row.text or "") for r in predicted.collect()]
    assert all(not (d is not None and d < 300 and d % 5 == 2) for d, _ in left)
    cut = [(d, "\n".join(x for x in t.split("\n") if x.strip() != "Shared by many")) for d, t in left]
    kept, sets = [], []
    for d, t in sorted(cut, key=lambda r: (r[0] is None, r[0])):
        w = t.lower().split()
        s = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        if not s or not any(len(s & o) >= 0.8 * len(s | o) for o in sets):
            kept.append((d, t))
        sets.append(s)
    kept = [(d, t) for d, t in kept if d != 402]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    wanted = sorted(((d, len(library.encode(t, add_special_tokens=False).ids)) for d, t in kept), key=str)
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=str) == wanted
    assert {r.doc_id for r in got} >= {0, 403, 404, 405, None} and not {r.doc_id for r in got} & {400, 401, 402}


def test_stages_return_the_columns_of_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for part in (docs, docs.limit(0)):
            out = stage(spark, part, folder)
            assert out.columns == docs.columns, name
            assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]


def test_lines_change_the_length(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = corpus_pipeline.line_dedup(spark, docs, folder)
    assert out.count() == docs.count()
    assert out.where(F.col("n_chars") != F.length(F.coalesce("text", F.lit("")))).isEmpty()
    assert not [r for r in out.collect() if re.search("Shared by many", r.text)]
