"""URL filter: rules for hosts and paths, and logistic regression on hashed character n-grams for the rest."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.common import mixed, picked

SIZES = (3, 4, 5)
BUCKETS = 1 << 18
# Weights are whole multiples of this, so their sums are exact in any order.
UNIT = 2.0**-24
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALLOW, BLOCK = "allow", "block"

# Names of hosts for the small labelled table, of wanted and of unwanted sites.
WANTED = (
    "garden library museum weather recipes travel history science music school hospital wiki docs forum news city "
    "harbour mountain river theatre journal university kitchen poetry chess cycling railway astronomy geology biology "
    "painting carpentry orchestra gazette archive encyclopedia parliament council bakery florist veterinary nursery "
    "meteorology translation dictionary grammar folklore pottery knitting sailing birdwatching mathematics physics "
    "chemistry medicine law economics farming winery fishery lighthouse observatory aquarium zoo botany herald tribune"
).split()
UNWANTED = (
    "online-casino casino-bonus poker-room slots-jackpot sports-bets betting-tips best-bets lottery-win win-prize "
    "win-money free-money free-gifts free-iphone discount-pills diet-pills pills-shop cheap-meds cheap-watches "
    "cheap-loans payday-loans fast-cash replica-bags replica-watches viagra-shop xxx-videos porn-tube adult-cams "
    "escort-girls link-farm seo-farm content-farm spam-mailer spam-links bulk-spam click-bait warez-crack keygen-crack "
    "torrent-crack crypto-giveaway forex-signals double-your-bitcoin get-rich-quick miracle-cure weight-loss-pills "
    "hot-singles free-spins pop-ads ads-server ad-tracker track-clicks click-ads tracking-pixel adult-chat adult-videos "
    "casino-royal win-casino"
).split()
# The most frequent letter pairs of English; any two of them make a name without meaning.
PAIRS = "th he in er an re nd at on nt ha es st en ed to it ou ea hi is or ti as te et ng of al de se le sa si ar ve ra ld ur".split()
SHAPES = [
    "https://www.{}.example.com/en/{}.html", "http://{}.example.net/de/{}", "https://blog.{}.example.org/fr/{}/",
    "http://m.{}.example.com/es/{}?page=2", "https://{}.example.org/en/{}#top", "https://www.{}.example.net/{}",
]


def labelled_urls(spark: SparkSession) -> DataFrame:
    """A small table ``url, label``: names in all shapes alike, so that only names tell the labels apart.

    Names of letter pairs, one shape each, stand for the many hosts whose names say nothing: they are wanted.
    """
    rows = [
        (shape.format(name, 1009 * (k + 1) + 17 * at), label)
        for names, label in ((WANTED, ALLOW), (UNWANTED, BLOCK))
        for k, name in enumerate(names)
        for at, shape in enumerate(SHAPES)
    ]
    names = [first + second for first in PAIRS for second in PAIRS]
    rows += [(SHAPES[k % len(SHAPES)].format(name, 31 * k + 7), ALLOW) for k, name in enumerate(names)]
    return spark.createDataFrame(rows, "url string, label string")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands between the first ``://`` and the query or fragment; both empty where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """``struct(size, rule, verdict)`` of the longest rule for the host or a domain above it; null if none fits.

    Of rules that are equally long the last by name counts, of a rule with both verdicts ``block``.
    """
    known: dict[str, list[Column]] = {}
    for of, under, verdict in rules:
        if verdict not in (ALLOW, BLOCK):
            raise ValueError(f"unknown verdict: {verdict}")
        fields = {"size": len(of + under), "rule": of + under, "verdict": verdict, "under": under}
        known.setdefault(of, []).append(F.struct(*[F.lit(v).alias(k) for k, v in fields.items()]))
    if not known:
        return F.lit(None).cast("struct<size: int, rule: string, verdict: string>")
    table = F.create_map(*[x for of, found in known.items() for x in (F.lit(of), F.array(*found))])
    # The last labels of the host, as many as some rule has.
    depths = sorted({of.count(".") + 1 for of in known})
    domains = F.array(*[F.substring_index(host, ".", -depth) for depth in depths])
    near = F.flatten(F.filter(F.transform(domains, lambda d: F.try_element_at(table, d)), lambda r: r.isNotNull()))
    fits = F.filter(near, lambda r: F.startswith(path, r["under"]))
    return F.array_max(F.transform(fits, lambda r: F.struct(r["size"], r["rule"], r["verdict"])))


def url_features(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``(owner, bucket)`` of every character n-gram of ``<host>`` and of ``<path>``, which differ."""
    owners, buckets = [], []
    for part, texts in enumerate((hosts, paths)):
        points = np.frombuffer("".join([f"<{t}>" for t in texts]).encode("utf-32-le", "surrogatepass"), np.uint32)
        points = points.astype(np.uint64)
        of = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])
        for n in SIZES:
            if len(points) < n:
                continue
            h = np.full(len(points) - n + 1, 2 * n + part, np.uint64)
            for k in range(n):
                h = h * np.uint64(0x110003) + points[k : len(points) - n + 1 + k]
            inside = of[: len(h)] == of[n - 1 :]
            owners.append(of[: len(h)][inside])
            buckets.append((mixed(h[inside]) % np.uint64(BUCKETS)).astype(np.int64))
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(owners), np.concatenate(buckets)


def trained(hosts: list[str], paths: list[str], labels: list[int], turns: int, rate: float, decay: float) -> np.ndarray:
    """Weights of all buckets, the bias last, in units: gradient descent on the logistic loss.

    Of each URL the n-grams are counted and divided by the root of their number. Both labels weigh the same.
    """
    weights, bias = np.zeros(BUCKETS), 0.0
    if labels:
        owner, bucket = url_features(hosts, paths)
        used, bucket = np.unique(bucket, return_inverse=True)
        sizes = np.maximum(np.bincount(owner, minlength=len(labels)), 1)
        value = 1 / np.sqrt(sizes[owner])
        wanted, own = np.array(labels, float), np.zeros(len(used))
        share = np.where(wanted == 1, 1 / max(1, wanted.sum()), 1 / max(1, len(labels) - wanted.sum())) / 2
        for _ in range(turns):
            odds = 1 / (1 + np.exp(-(bias + np.bincount(owner, own[bucket] * value, len(labels)))))
            error = (odds - wanted) * share
            own -= rate * (np.bincount(bucket, error[owner] * value, len(used)) + decay * own)
            bias -= rate * error.sum()
        weights[used] = own
    return np.rint(np.append(weights, bias) / UNIT).astype(np.int64)


def train_filter(
    labelled: DataFrame, most: int = 10_000, turns: int = 500, rate: float = 8.0, decay: float = 3e-5
) -> np.ndarray:
    """The model: learnt in one task from at most ``most`` rows ``url, label``, chosen by the hash of the URL."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([*batches, pd.DataFrame({"host": [], "path": [], "y": []})])
        model = trained(rows["host"].tolist(), rows["path"].tolist(), rows["y"].astype(int).tolist(), turns, rate, decay)
        file = io.BytesIO()
        np.savez_compressed(file, model)
        yield pd.DataFrame({"model": [file.getvalue()]})

    rows = picked(labelled, url="url", label="label").where(F.col("url").isNotNull() & F.col("label").isin(ALLOW, BLOCK))
    rows = rows.orderBy(F.xxhash64("url"), "url", "label").limit(most)
    host, path = host_and_path(F.col("url"))
    rows = rows.select(host.alias("host"), path.alias("path"), (F.col("label") == BLOCK).cast("int").alias("y")).coalesce(1)
    data = rows.mapInPandas(run, "model binary").first()
    return np.load(io.BytesIO(bytes(data["model"])))["arr_0"] if data else trained([], [], [], 0, 0, 0)


def odds_of(model: np.ndarray, hosts: list[str], paths: list[str]) -> np.ndarray:
    owner, bucket = url_features(hosts, paths)
    sums, sizes = np.zeros(len(hosts), np.int64), np.bincount(owner, minlength=len(hosts))
    np.add.at(sums, owner, model[:-1][bucket])
    return 1 / (1 + np.exp(-UNIT * (model[-1] + sums / np.sqrt(np.maximum(sizes, 1)))))


def url_verdicts(
    pages: DataFrame,
    rules: list[tuple[str, str, str]],
    labelled: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    threshold: float = 0.5,
    most: int = 10_000,
) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` for every row.

    ``rules`` are ``(host, path, verdict)``: a rule fits its host and all subdomains where the URL's path
    starts with the rule's, and the longest one decides. Where none fits, the model does: ``block`` from
    ``threshold`` on. ``score`` is the model's probability of ``block`` for every row, whatever the rules say.
    ``labelled`` has ``url, label`` (``allow`` or ``block``; other and null rows take no part), of which at most
    ``most`` are learnt from; without any every score is one half.

    A projection: no shuffle, and the model is 2 MB whatever the input. A null URL and one without ``://`` have
    an empty host and path; null ids stay null, repeated rows give repeated rows, URLs of any length are
    read whole, an empty table gives no rows, further columns are not looked at.
    """
    spark = pages.sparkSession
    shared = spark.sparkContext.broadcast(train_filter(labelled, most))

    @F.pandas_udf("double")
    def score(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series(odds_of(shared.value, hosts.tolist(), paths.tolist()))

    rows = picked(pages, page_id=id_col, url=url_col)
    host, path = host_and_path(F.col("url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("score", score("host", "path"))
    rows = rows.withColumn("found", fitting_rule(F.col("host"), F.col("path"), rules))
    method = F.when(F.col("score") >= threshold, BLOCK).otherwise(ALLOW)
    return rows.select(
        "page_id",
        "host",
        "path",
        F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", method).alias("verdict"),
        "score",
    )
