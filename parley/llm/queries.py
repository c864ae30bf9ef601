"""The registered queries of the operators, with SQL where DuckDB can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.bpe import bpe_roundtrip
from parley.llm.common import table
from parley.llm.html import main_texts
from parley.llm.leaks import leaks
from parley.llm.lines import drop_common_lines
from parley.llm.neighbours import nearest
from parley.llm.ngrams import near_duplicates
from parley.llm.periods import periodic_runs
from parley.llm.phrases import collocations
from parley.llm.quality import quality_scores
from parley.llm.sharding import Tree, assign
from parley.llm.tokens import token_counts
from parley.llm.urls import labelled_urls, url_verdicts
from parley.llm.warc import archive_roundtrip

SHARDS = 24
# Rules of the URL filter, by host and start of the path.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def vocabulary() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary())


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_common_lines(table(spark, sf_dir, "documents"), min_docs=10)
    return found.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))


def op7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = Tree.even(SHARDS)
    return assign(table(spark, sf_dir, "documents"), tree, tree.grown(SHARDS))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_roundtrip(spark, table(spark, sf_dir, "pages"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_roundtrip(table(spark, sf_dir, "documents"), vocabulary(), digest=True)


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"), URL_RULES, labelled_urls(spark))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"), threshold=100, longest=5, top=2000, share=100)


def repeated_from_within(docs: DataFrame) -> DataFrame:
    """A tenth of the texts, by the CRC of their id, made periodic from one of their words on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    rows = docs.withColumn("g", F.floor(h / 10)).withColumn("w", F.when(h % 10 == 0, words))
    rows = rows.withColumn("n", F.nullif(F.size("w"), F.lit(0))).withColumn("a", (F.col("g") % F.col("n")).cast("int"))
    rest, period = F.col("n") - F.col("a"), F.expr("cast(1 + floor((n - a) / (3 + g % 8)) as int)")
    turns = F.ceil(rest / period).cast("int")
    again = F.slice(F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, period), turns)), 1, rest)
    made = F.array_join(F.concat(F.slice("w", 1, F.col("a")), again), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, made).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(repeated_from_within(table(spark, sf_dir, "documents")), least=6, exponent=4)
    digests = [F.sha2(name, 256).alias(f"{name}_sha256") for name in ("runs", "collapsed")]
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", *digests)


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_ngram_join": op2_ngram_join,
        "op3_nearest": op3_nearest,
        "op4_quality": op4_quality,
        "op5_line_dedup": op5_line_dedup,
        "op6_main_text": op6_main_text,
        "op7_leaks": op7_leaks,
        "op8_sharding": op8_sharding,
        "op9_warc": op9_warc,
        "op10_bpe": op10_bpe,
        "op11_url_filter": op11_url_filter,
        "op12_collocations": op12_collocations,
        "op13_periodic_runs": op13_periodic_runs,
    }


OP2_SQL = r"""
WITH RECURSIVE doc AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM documents
), shingle AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM doc
), size AS (
    SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), pair AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id
    GROUP BY ALL
), link AS (
    SELECT x, y FROM pair JOIN size a ON a.doc_id = x JOIN size b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)
), edge AS (
    SELECT x, y FROM link UNION SELECT y, x FROM link
), reach(doc_id, r) AS (
    SELECT doc_id, doc_id FROM documents UNION SELECT e.y, reach.r FROM reach JOIN edge e ON e.x = reach.doc_id
), least AS (
    SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM documents d LEFT JOIN size USING (doc_id) JOIN least USING (doc_id)
"""

OP5_SQL = r"""
WITH doc AS (
    SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), line AS (
    SELECT rid, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM doc
), keyed AS (
    SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM line
), common AS (
    SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT rid) >= 10
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines,
    count(*) FILTER (WHERE common.k IS NOT NULL) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE common.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN common USING (k) GROUP BY rid
"""

# Base32: every 5 hexadecimal digits are 20 bits, so 4 letters.
OP9_SQL = r"""
WITH page AS (
    SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), bits AS (
    SELECT page_id, strlen(html) AS payload_bytes, h, min(page_id) OVER (PARTITION BY h) AS f,
        list_transform(range(8), lambda i: ('0x' || substr(h, 1 + 5 * i, 5))::BIGINT) AS parts
    FROM page
)
SELECT page_id, payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + ((parts[1 + i // 4] >> (5 * (3 - i % 4))) & 31)::INT, 1)), '') AS payload_digest,
    CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id = f THEN NULL ELSE f END AS refers_to
FROM bits
"""

OP12_SQL = r"""
WITH piece AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), word AS (
    SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM piece
), total AS (
    SELECT lang, sum(len(w))::BIGINT AS n FROM word GROUP BY lang
), gram AS (
    SELECT lang, unnest(flatten(list_transform(range(1, 6), lambda m: list_transform(range(1, len(w) - m + 2),
        lambda i: array_to_string(w[i:i + m - 1], ' '))))) AS phrase FROM word
), freq AS (
    SELECT lang, phrase, count(*) AS f FROM gram GROUP BY ALL HAVING count(*) >= 100
), cand AS (
    SELECT *, string_split(phrase, ' ') AS w FROM freq WHERE contains(phrase, ' ')
), cut AS (
    SELECT *, unnest(range(1, len(w))) AS k FROM cand
), scored AS (
    SELECT cut.lang, cut.phrase, cut.f AS a, k, x.f AS l, y.f AS r, n,
        (1000::HUGEINT * cut.f * n // (x.f::HUGEINT * y.f))::BIGINT AS score
    FROM cut JOIN total USING (lang) JOIN freq x ON x.lang = cut.lang AND x.phrase = array_to_string(w[1:k], ' ')
    JOIN freq y ON y.lang = cut.lang AND y.phrase = array_to_string(w[k + 1:], ' ')
), worst AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
    SELECT DISTINCT lang, f, unnest(flatten(list_transform(range(2, len(w)), lambda m:
        list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))))) AS phrase FROM cand
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM worst WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = worst.lang AND i.phrase = worst.phrase AND 100 * i.f >= 100 * a)
QUALIFY rank <= 2000
"""


def llm_oracles() -> dict[str, str]:
    return {"op2_ngram_join": OP2_SQL, "op5_line_dedup": OP5_SQL, "op9_warc": OP9_SQL, "op12_collocations": OP12_SQL}
