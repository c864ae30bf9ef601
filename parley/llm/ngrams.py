"""Near duplicates by a grouped prefix join over word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.common import WordHashes, bitmap, components, in_bitmap, per_process, picked, window_hashes
from parley.session import written_once

WIDTH = 5
# Two documents link when PARTS * common >= SHARE * union.
SHARE, PARTS = 80, 100
BANDS, ROWS = 8, 3
# Of more candidate pairs than groups, first so many of each group are verified; this at most so often.
EACH, ROUNDS = 8, 2
# Of shingles that more groups hold, candidates are first estimated from those of so many neighbours of each.
CROWD, NEXT = 128, 8
# Shingles of about so many in one worker are counted together.
BLOCK = 3_000_000
# Shingles of which blocks tell one part in RARELY of all are demoted at once, but never more than MOST. Blocks tell
# about a tenth of a shingle that is one part in 2.5 million: such a one may be crowded in postings.
RARELY, MOST = 25_000_000, 1_000_000


def shingle_set(text: str, width: int = WIDTH) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes.

    Words are runs without ASCII white space, A-Z lower-cased; both are what bytes methods do.
    """
    table = per_process(("words",), WordHashes)
    return np.unique(window_hashes(table.of(text.encode().lower().split()), width))


def signature(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def bands(shingles: np.ndarray) -> list[int]:
    """Hashes of the least shingles of value ranges, ``ROWS`` ranges each; an empty range counts as 0."""
    ends = np.arange(BANDS * ROWS, dtype=np.uint64) * np.uint64((1 << 64) // (BANDS * ROWS))
    at = np.searchsorted(shingles, ends)
    upper = np.append(at[1:], len(shingles))
    least = np.where(at < upper, np.append(shingles, np.uint64(0))[at], 0).astype(np.uint64).reshape(BANDS, ROWS)
    return [xxhash.xxh3_64_intdigest(row.tobytes(), seed=k) - (1 << 63) for k, row in enumerate(least)]


def prefix_size(n: int) -> int:
    """So many of a set's first shingles (in any one order) must meet those of each set that links."""
    return n - -(-SHARE * n // PARTS) + 1


def parities(shingles: np.ndarray) -> bytes:
    """Bits, a power of two and as many as shingles or up to twice so many: which residues an odd number of them has."""
    bits = max(64, 1 << (len(shingles) - 1).bit_length())
    counts = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(bool), bitorder="little").tobytes()


def may_link(x: bytes, y: bytes, n: int) -> bool:
    """Whether parities allow that two sets of ``n`` shingles together link.

    A shingle of one set alone flips one bit, and linked sets have at most ``(1 - share) / (1 + share)`` of
    their shingles for themselves. Longer parities fold to shorter ones.
    """
    a, b = int.from_bytes(x, "little"), int.from_bytes(y, "little")
    for _ in range(len(x).bit_length() - len(y).bit_length()):
        x = x[: len(x) // 2]
        a = (a >> 8 * len(x)) ^ (a & ((1 << 8 * len(x)) - 1))
    for _ in range(len(y).bit_length() - len(x).bit_length()):
        y = y[: len(y) // 2]
        b = (b >> 8 * len(y)) ^ (b & ((1 << 8 * len(y)) - 1))
    return (PARTS + SHARE) * (a ^ b).bit_count() <= (PARTS - SHARE) * n


def first_pass(docs: DataFrame, width: int) -> DataFrame:
    """``(doc_id, t, n, s)`` per row, and rows with negative ``n``: ``-n`` sets of a block hold ``s``."""
    def common(block: list[np.ndarray]) -> pd.DataFrame:
        tokens, counts = np.unique(np.concatenate(block), return_counts=True)
        often = counts >= 4
        return pd.DataFrame({"doc_id": None, "t": None, "n": -counts[often], "s": tokens[often].view(np.int64)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, size, seen = [], 0, set()
        for batch in batches:
            n, s = [], []
            for text in batch["text"]:
                shingles = shingle_set(text, width)
                n.append(len(shingles))
                s.append(signature(shingles))
                if len(shingles) and s[-1] not in seen:
                    seen.add(s[-1])
                    block.append(shingles)
                    size += len(shingles)
                if size >= BLOCK:
                    yield common(block)
                    block, size, seen = [], 0, set()
            yield pd.DataFrame({"doc_id": batch["doc_id"].array, "t": batch["t"].array, "n": n, "s": s})
        if block:
            yield common(block)

    kind = docs.schema["doc_id"].dataType
    found = docs.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(
        run, "doc_id string, t bigint, n bigint, s bigint"
    )
    return found.withColumn("doc_id", F.col("doc_id").cast(kind))


def packed(shingles: np.ndarray) -> bytes:
    """Six bytes of each shingle: enough to count what two sets have in common."""
    return np.ascontiguousarray(shingles.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    items = np.frombuffer(data, np.uint8).reshape(-1, 6)
    out = np.zeros((len(items), 8), np.uint8)
    out[:, :6] = items
    return out.view(np.uint64).ravel()


def prefixes(docs: DataFrame, width: int, common: np.ndarray) -> DataFrame:
    """``(s, n, ph, prefix, rare, bits, bands)`` per set: ``rare`` shingles by hash first, then the ``common`` ones by hash."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common, seen = shared.value, set()
        for batch in batches:
            rows = []
            for text in batch["text"]:
                shingles = shingle_set(text, width)
                s, n = signature(shingles), len(shingles)
                if not n or s in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(s)
                at = np.searchsorted(common, shingles)
                often = np.append(common, np.uint64(0))[at] == shingles if len(common) else np.zeros(n, bool)
                often &= at < len(common)
                first = np.concatenate([shingles[~often], shingles[often]])[: prefix_size(n)]
                ph = xxhash.xxh3_64_intdigest(first.tobytes()) - (1 << 63)
                rare = min(len(first), n - int(often.sum()))
                rows.append((s, n, ph, first.view(np.int64), rare, parities(shingles), bands(shingles)))
            yield pd.DataFrame(rows, columns=["s", "n", "ph", "prefix", "rare", "bits", "bands"])

    kind = "s bigint, n bigint, ph bigint, prefix array<bigint>, rare int, bits binary, bands array<bigint>"
    return docs.select("text").mapInPandas(run, kind)


def frequent(scan: DataFrame, most: int) -> np.ndarray:
    """The shingles that blocks of :func:`first_pass` together hold so often that they go behind the rare ones."""
    total = scan.where("n >= 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("k")).first()["k"]
    bound = max(most, total // RARELY)
    often = scan.where("n < 0").groupBy("s").agg((-F.sum("n")).alias("k")).where(F.col("k") >= bound)
    often = written_once(often, "frequent")
    while often.where(F.col("k") >= bound).count() > MOST:
        bound *= 2
    return hashes(often.where(F.col("k") >= bound), "s")


def remade(docs: DataFrame, classes: DataFrame, sets: DataFrame, width: int, common: np.ndarray, new: np.ndarray) -> DataFrame:
    """``sets`` after the ``new`` ones of the ``common`` shingles went behind: only prefixes that hold one change."""
    gone = sets.sparkSession.createDataFrame(pa.table({"token": new.view(np.int64)}))
    held = sets.select("s", F.explode("prefix").alias("token")).join(F.broadcast(gone), "token", "left_semi")
    held = written_once(held.select("s").distinct(), "changed")
    wanted = docs.sparkSession.sparkContext.broadcast(bitmap(classes.join(held, "s", "left_semi"), "t"))

    def changed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.unpackbits(wanted.value).astype(bool)
        for batch in batches:
            yield batch[in_bitmap(bits, batch["t"].to_numpy(np.int64))]

    texts = docs.select("text", "t").mapInPandas(changed, "text string, t bigint")
    # Others that the bitmap lets through come out as they were.
    made = prefixes(texts, width, common).join(held, "s", "left_semi")
    return written_once(sets.join(held, "s", "left_anti").union(made), "prefixes")


def whole_sets(docs: DataFrame, width: int, wanted: np.ndarray) -> DataFrame:
    """``(s, items)`` of the texts in the bitmap ``wanted``."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            texts = batch["text"][in_bitmap(bits, batch["t"].to_numpy(np.int64))]
            sets = [shingle_set(t, width) for t in texts]
            yield pd.DataFrame({"s": [signature(x) for x in sets], "items": [packed(x) for x in sets]})

    return docs.select("text", "t").mapInPandas(run, "s bigint, items binary")


def near_sizes(a: Column, b: Column) -> Column:
    return (PARTS * F.least(a, b)) >= (SHARE * F.greatest(a, b))


def texts_of(pairs: DataFrame, classes: DataFrame) -> np.ndarray:
    """A bitmap of the hashes of the texts that stand for the sets in ``pairs``."""
    needed = pairs.select(F.col("a").alias("s")).union(pairs.select(F.col("b").alias("s"))).distinct()
    return bitmap(classes.join(needed, "s", "left_semi"), "t")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` that link, counted on the whole sets ``(s, items)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = []
            for x, y in zip(batch["x"], batch["y"]):
                n = (len(x) + len(y)) // 6
                common = len(np.intersect1d(unpacked(x), unpacked(y), assume_unique=True))
                good.append(PARTS * common >= SHARE * (n - common))
            yield batch.loc[good, ["a", "b"]]

    # Copies of a text in several tasks give the same set.
    sets = sets.groupBy("s").agg(F.first("items").alias("items"))
    left = sets.select(F.col("s").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("s").alias("b"), F.col("items").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return written_once(both.mapInPandas(run, "a bigint, b bigint"), "links")


def hashes(found: DataFrame, column: str) -> np.ndarray:
    """A column of 64-bit hashes, sorted. Few partitions, whatever those of shuffles: each is a job of its own."""
    rows = found.select(column).repartition(8).toLocalIterator()
    return np.sort(np.fromiter((r[0] for r in rows), np.int64).view(np.uint64))


def star_pairs(sets: DataFrame) -> DataFrame:
    """For each set one other of near size: of all that share a band with it, that with the least share of rare shingles.

    In a cluster so large that its shingles are common, rare ones are a copy's own changes: the star's middle is
    the text that was copied, or a copy with few changes. In others it is the smallest. This need not find every
    link, only hold large clusters together cheaply.
    """
    rows = sets.select("s", "n", (F.col("rare") / F.size("prefix")).alias("own"), F.posexplode("bands").alias("no", "band"))
    # A window deals the rows out once, a join with the least would do it twice.
    rows = rows.withColumn("c", F.min(F.struct("own", "s", "n")).over(Window.partitionBy("no", "band")))
    pairs = rows.where(F.col("s") != F.col("c.s"))
    pairs = pairs.where(near_sizes(F.col("n"), F.col("c.n")))
    pairs = pairs.groupBy(F.col("s").alias("b")).agg(F.min("c")["s"].alias("a"))
    return written_once(pairs.select("b", "a"), "star-pairs")


def in_reach(n1: Column, at1: Column, n2: Column, at2: Column) -> Column:
    """Whether a shingle can be the first that two sets which link share, by its places in them from 0.

    Linked sets share ``share * (n1 + n2) / (1 + share)`` or more, none of them before the first.
    """
    return SHARE * (n1 + n2) <= (SHARE + PARTS) * F.least(n1 - at1, n2 - at2)


def postings(
    docs: DataFrame, classes: DataFrame, sets: DataFrame, known: DataFrame, common: np.ndarray, width: int, most: int
) -> tuple[DataFrame, DataFrame, DataFrame, np.ndarray]:
    """``(g, n, comp, at, before, token, k, main)``: groups of sets by the shingles of their prefixes.

    Beside them come the ``members`` of the groups, ``g, s``, and the ``sets`` and ``common`` shingles as they
    are now. A group is named by the least of its sets.

    Sets with one prefix, size and component are one group. ``k`` groups hold a shingle, most of them in the
    component ``main``; shingles of one component alone are left out. Shingles that more than ``8 * most``
    groups hold go behind the rare ones where their pairs outnumber all shingles of prefixes, and the prefixes
    that hold one are made anew. Pairs fewer than that cost less than another round.
    """
    while True:
        total = sets.agg(F.coalesce(F.sum(F.size("prefix")), F.lit(0)).alias("k")).first()["k"]
        # At most 500,000 shingles more a round.
        bound = max(8 * most, total // 500_000)
        members = sets.select("s", "n", "ph").distinct().join(known, F.col("s") == F.col("node"), "left")
        members = members.select("s", "n", "ph", F.coalesce("component", "s").alias("comp"))
        units = members.groupBy("n", "ph", "comp").agg(F.min("s").alias("g"), F.count(F.lit(1)).alias("several"))
        members = written_once(members.join(units, ["n", "ph", "comp"]), "members")
        groups = sets.groupBy("n", "ph").agg(F.first("prefix").alias("prefix"), F.first("rare").alias("rare"))
        groups = groups.join(members.select("n", "ph", "comp", "g").distinct(), ["n", "ph"])
        # A set without links is its own group and component: a null then costs no bytes in the shuffle.
        own = F.when(F.col("comp") != F.col("g"), F.col("comp")).alias("comp")
        posted = groups.select("g", "n", own, "prefix", "rare", F.posexplode("prefix").alias("at", "token"))
        # The common shingle before a common one: a pair that shares both is paired there.
        before = F.when(F.col("at") > F.col("rare"), F.element_at("prefix", F.col("at"))).alias("before")
        posted = posted.select("g", "n", "comp", "at", before, "token").repartition("token")
        posted = posted.withColumn("comp", F.coalesce("comp", "g"))
        # Windows on the rows as they are dealt: nothing is shuffled again.
        posted = posted.withColumn("held", F.count(F.lit(1)).over(Window.partitionBy("token", "comp")))
        same = Window.partitionBy("token")
        posted = posted.select(
            "*", F.count(F.lit(1)).over(same).alias("k"), F.max(F.struct("held", "comp")).over(same)["comp"].alias("main")
        )
        # Of one component's shingles all hang together.
        posted = posted.where("held < k").drop("held")
        posted = written_once(posted, "postings")
        crowded = posted.where(F.col("k") > bound).groupBy("token").agg(F.first("k").alias("k"))
        held = dict(written_once(crowded, "crowded").repartition(8).toLocalIterator())
        new = np.setdiff1d(np.fromiter(held, np.int64, len(held)).view(np.uint64), common)
        if sum(held[int(x)] ** 2 for x in new.view(np.int64)) <= 2 * total:
            return posted, members, sets, common
        common = np.union1d(common, new)
        sets = remade(docs, classes, sets, width, common, new)


def paired(rows: DataFrame) -> DataFrame:
    """The pairs of postings of one shingle that may link and need it for that.

    Their groups are of near sizes and in two components, and the shingle can be the first that linked sets share.
    """
    rows = rows.where("c1 <> comp").where(near_sizes(F.col("n1"), F.col("n")))
    rows = rows.where("before1 is null or before is null or before1 <> before")
    return rows.where(in_reach(F.col("n1"), F.col("at1"), F.col("n"), F.col("at")))


def few_of_tokens(posted: DataFrame, turn: int) -> DataFrame:
    """``(g1, g2, weight)``: pairs of each group with its next :data:`NEXT` under crowded shingles, as a hash orders them.

    So many pairs as a pair's weight are like it: the sum of weights estimates all pairs of crowded shingles.
    Orders are others each ``turn``.
    """
    order = Window.partitionBy("token").orderBy(F.xxhash64("g", "token", F.lit(turn)), "g")
    after = F.collect_list(F.struct("g", "n", "at", "comp", "before")).over(order.rowsBetween(1, NEXT))
    rows = posted.where(F.col("k") > CROWD).select(
        F.col("g").alias("g1"), F.col("n").alias("n1"), F.col("at").alias("at1"), F.col("comp").alias("c1"),
        F.col("before").alias("before1"), "k", after.alias("after"),
    )
    rows = rows.select("*", F.inline("after")).drop("after")
    weight = (F.col("k") - 1) / (2 * NEXT)
    return written_once(paired(rows).select(*ordered("g1", "g"), weight.alias("weight")), "drawn-pairs")


def ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("g1"), F.greatest(a, b).alias("g2")]


def group_pairs(posted: DataFrame) -> DataFrame:
    """All pairs ``(g1, g2)`` of groups that may link and are not in one component yet.

    Of a shingle's groups only those outside its largest component are paired with the rest, so a cluster
    that is already known to hang together costs nothing however large it is.
    """
    left = posted.where("comp <> main").select(
        "token", F.col("g").alias("g1"), F.col("n").alias("n1"), F.col("at").alias("at1"), F.col("comp").alias("c1"), "main",
        F.col("before").alias("before1"),
    )
    pairs = left.join(posted.drop("k", "main"), "token").where("comp = main or g1 < g")
    return paired(pairs).select(*ordered("g1", "g"))


def allowed(pairs: DataFrame, members: DataFrame, sets: DataFrame) -> DataFrame:
    """The distinct pairs ``(g1, g2)`` whose parities allow a link; groups of several sets have none, their pairs all stay."""
    pairs = pairs.select("g1", "g2").distinct()
    alone = members.where("several = 1").select(F.col("s").alias("one"))
    bits = sets.select("s", F.col("n"), "bits").join(alone, F.col("s") == F.col("one")).groupBy("s")
    bits = bits.agg(F.first("n").alias("n"), F.first("bits").alias("bits"))
    for k in ("1", "2"):
        own = bits.select(F.col("s").alias(f"s{k}"), F.col("n").alias(f"n{k}"), F.col("bits").alias(f"bits{k}"))
        pairs = pairs.join(own, F.col(f"g{k}") == F.col(f"s{k}"), "left")
    pairs = pairs.select("g1", "g2", (F.col("n1") + F.col("n2")).alias("n"), "bits1", "bits2")

    def possible(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            both = zip(batch["bits1"], batch["bits2"], batch["n"])
            good = [x is None or y is None or may_link(x, y, int(n)) for x, y, n in both]
            yield batch.loc[good, ["g1", "g2"]]

    return written_once(pairs.mapInPandas(possible, "g1 bigint, g2 bigint"), "group-pairs")


def few_of_each(pairs: DataFrame, turn: int) -> DataFrame:
    """:data:`EACH` pairs ``(a, b)`` of each group, drawn by a hash, others each ``turn``.

    The least sets stand for their groups. A cluster of many candidates hangs together by few of them.
    """
    drawn = F.xxhash64("g1", "g2", F.lit(turn)).alias("drawn")
    ends = pairs.select("g1", "g2", drawn, F.explode(F.array("g1", "g2")).alias("end"))
    order = Window.partitionBy("end").orderBy("drawn")
    chosen = ends.withColumn("r", F.row_number().over(order)).where(F.col("r") <= EACH)
    return written_once(chosen.select(F.col("g1").alias("a"), F.col("g2").alias("b")).distinct(), "few-pairs")


def all_of_each(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Every pair ``(a, b)`` of members of two groups."""
    a = members.select(F.col("g").alias("g1"), F.col("s").alias("a"))
    b = members.select(F.col("g").alias("g2"), F.col("s").alias("b"))
    return written_once(pairs.join(a, "g1").join(b, "g2").select("a", "b").distinct(), "set-pairs")


def prefix_links(
    docs: DataFrame, classes: DataFrame, sets: DataFrame, links: DataFrame, common: np.ndarray, width: int, most: int
) -> DataFrame:
    """``links`` and as many more as name all components.

    Where candidates outnumber the groups, near copies come in clusters that the stars have missed. Then a
    few candidates of each group are verified first, and candidates are made anew without those that hang
    together now; the last round verifies all that are left, so no component is missed. Where an estimate
    says that crowded shingles alone give far more, the few are drawn without making all.
    """
    for turn in range(ROUNDS + 1):
        known = written_once(components(links), "first-components")
        posted, members, sets, common = postings(docs, classes, sets, known, common, width, most)
        groups, last = members.count(), turn == ROUNDS
        if not last:
            drawn = few_of_tokens(posted, turn)
            guess = drawn.agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("k")).first()["k"]
        if not last and guess > EACH * groups:
            pairs = allowed(drawn, members, sets)
        else:
            pairs = allowed(group_pairs(posted), members, sets)
            last = last or pairs.count() <= groups
        found = all_of_each(pairs, members) if last else few_of_each(pairs, turn)
        links = links.union(verified(found, whole_sets(docs, width, texts_of(found, classes))))
        if last:
            return links


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, most: int = 64
) -> DataFrame:
    """``doc_id, n_shingles, component_id, text_hash, kept`` for every row.

    Rows with equal sets are one class, named by a 64-bit hash of the set; classes link when their
    similarity is 0.8 or more, counted on whole sets of 64-bit shingle hashes. ``component_id`` is the
    smallest id that links reach. A null or wordless text has no shingles and links with nothing (its
    component is its own id), an empty table gives no rows; a null id takes part and gets its component's smallest id; repeated rows
    come back as often as they are; columns beside the two named ones are not looked at. ``kept`` marks
    the row of a component that stays when duplicates go (the smallest id; of equal ids the smallest
    ``text_hash``, the text's xxhash64); rows without shingles are all kept.

    1. Two passes over the texts: sizes, class names and counts of frequent shingles; then prefixes and band hashes.
    2. Sets that share a band are compared with that of the least share of rare shingles: this finds large clusters by
       stars instead of by all pairs. Their links give first components.
    3. The grouped prefix join finds every pair that links and is not in one component yet (see
       :func:`postings` and :func:`group_pairs`). No partner is dropped: a prefix holds more shingles than two linked sets
       can both miss. Clusters of very many candidates are joined by a few of them first (see
       :func:`prefix_links`).
    4. Components of all links.
    """
    docs = picked(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    docs = docs.withColumn("t", F.xxhash64("text"))
    scan = written_once(first_pass(docs, width), "shingle-scan")
    rows = scan.where("n >= 0").select("doc_id", "t", "n", "s")
    classes = scan.where("n > 0").groupBy("s").agg(F.min(F.struct("doc_id", "t")).alias("row"))
    classes = written_once(classes.select("s", "row.t"), "classes")
    common = frequent(scan, most)
    sets = written_once(prefixes(docs, width, common), "prefixes")
    pairs = star_pairs(sets)
    stars = verified(pairs, whole_sets(docs, width, texts_of(pairs, classes)))
    found = components(prefix_links(docs, classes, sets, stars, common, width, most))
    named = rows.join(found, F.col("s") == F.col("node"), "left").withColumn("c", F.coalesce("component", "s"))
    named = written_once(named.select("doc_id", "t", "n", "c"), "named")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")
    least = named.where("n > 0").groupBy("c").agg(F.min(order).alias("least"), F.count(F.lit(1)).alias("k"))
    # Only components of several rows need the join: of one row, the smallest id is its own.
    several = least.where("k > 1").select("c", "least")
    found = named.join(several, "c", "left")
    alone = F.col("least").isNull()
    return found.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("component_id"),
        F.col("t").alias("text_hash"),
        (alone | (order == F.col("least"))).alias("kept"),
    )
