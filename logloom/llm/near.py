"""Problem 4: records whose texts are nearly the same, by pigeonhole blocks and Hamming distance."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.session import staged

#: Features with at least this share of all are looked up in a broadcast table, which so has at most 1 / share rows.
POPULAR_SHARE = 1 / 20_000
#: Texts of one block that one task compares with all of the block.
BLOCK_ROWS = 1024


def _fingerprint(text: str) -> list[int]:
    """The text's words as bits that are set: one position of 2^64 for the k-th use of each word."""
    seen: dict[str, int] = {}
    out = []
    for word in text.lower().split():
        k = seen[word] = seen.get(word, 0) + 1
        out.append(xxhash.xxh3_64_intdigest(f"{k} {word}".encode("utf-8", "surrogatepass")) - (1 << 63))
    return sorted(out)


def fingerprints(records: DataFrame, min_words: int) -> DataFrame:
    """``grp, log_id, n, bits, digest`` of the records of at least ``min_words`` words."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for grp, log_id, text in zip(batch["grp"], batch["log_id"], batch["text"], strict=True):
                bits = _fingerprint(text)
                if len(bits) >= min_words:
                    out.append((grp, log_id, len(bits), bits, xxhash.xxh3_128_digest(b"".join(b.to_bytes(8, "big", signed=True) for b in bits))))
            yield pd.DataFrame(out, columns=["grp", "log_id", "n", "bits", "digest"])

    # n words need n - 1 blanks between them: shorter texts never leave the JVM
    long = records.where(F.length("text") >= 2 * min_words - 1).select("grp", "log_id", "text")
    return long.mapInPandas(read, "grp string, log_id long, n int, bits array<long>, digest binary")


def similar_classes(records: DataFrame, threshold: float = 0.75, min_words: int = 60) -> tuple[DataFrame, DataFrame]:
    """Classes of records with the same words, and the pairs of classes that are nearly the same.

    Returns ``members(grp, rep, log_id)`` and ``pairs(grp, a, b, distance, similarity)``, ``a < b`` representatives
    (smallest ``log_id`` of a class), with ``distance`` and ``similarity``. Similarity is words in common over words of the union, both with
    repetition; only records of the same ``grp`` are compared.

    A fingerprint is the set of a text's words, the k-th use of a word being a position of its own; two
    texts of x and y words are similar exactly if their Hamming distance is at most
    (1 - t) / (1 + t) * (x + y). A text of x words can then lack at most x - ceil(t x) of its own
    positions in a similar one. So of any x - ceil(t x) + 1 of them at least one is shared (pigeonhole):
    each text gives its rarest ones as blocks, texts join on blocks, and the distance of every joined
    pair is verified on the whole fingerprints. Nothing is missed and nothing unverified comes out.
    """
    prints = staged(fingerprints(records, min_words), "prints")
    classed = prints.groupBy("grp", "digest").agg(F.min("log_id").alias("rep"), F.first("n").alias("n"), F.first("bits").alias("bits"))
    reps = staged(classed, "classes")
    members = prints.select("grp", "digest", "log_id").join(reps.select("grp", "digest", "rep"), ["grp", "digest"]).select("grp", "rep", "log_id")

    each = reps.select("grp", "rep", "n", F.explode("bits").alias("bit"))
    counts = staged(each.groupBy("grp", "bit").agg(F.count("*").alias("held")).where("held > 1"), "held")
    total = reps.agg(F.sum("n")).first()[0] or 0
    # every text holds the popular words: their counts come by broadcast, so no task gets all rows of one
    popular = counts.where(F.col("held") >= max(2, total * POPULAR_SHARE))
    rest = counts.where(F.col("held") < max(2, total * POPULAR_SHARE))
    marked = each.join(F.broadcast(popular.withColumnRenamed("held", "h1")), ["grp", "bit"], "left")
    light = marked.where("h1 is null").drop("h1").join(rest, ["grp", "bit"])
    shared = light.unionByName(marked.where("h1 is not null").withColumnRenamed("h1", "held"))
    # positions no other text holds come first in the order and need no block: only their number matters
    ranked = shared.groupBy("grp", "rep", "n").agg(F.array_sort(F.collect_list(F.struct("held", "bit"))).alias("s"))
    own = F.col("n") - F.size("s")
    places = ranked.withColumn("own", own).withColumn("kept", F.col("n") - F.ceil(F.lit(threshold) * F.col("n")).cast("int") + 1 - F.col("own")).where("kept > 0")
    blocks = places.select("grp", "rep", "n", "own", F.posexplode(F.slice("s", F.lit(1), F.col("kept"))).alias("i", "x")).select("grp", "rep", "n", (F.col("own") + F.col("i")).alias("place"), F.col("x.bit").alias("bit"))
    # a block of many texts is cut into stretches of BLOCK_ROWS, each of which meets all of them in a task of its own
    sizes = blocks.groupBy("grp", "bit").agg(F.count("*").alias("_held")).where(F.col("_held") > BLOCK_ROWS).withColumn("cuts", F.ceil(F.col("_held") / BLOCK_ROWS).cast("int"))
    blocks = staged(blocks.join(sizes.select("grp", "bit", "cuts"), ["grp", "bit"], "left").withColumn("cuts", F.coalesce("cuts", F.lit(1))), "blocks")
    left, right = [blocks.select("grp", "bit", "cuts", *[F.col(c).alias(f"{c}_{x}") for c in ("rep", "n", "place")]) for x in "ab"]
    left = left.withColumn("cut", F.pmod(F.xxhash64("rep_a"), F.col("cuts")).cast("int")).drop("cuts")
    right = right.withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).drop("cuts")
    need = F.ceil(F.lit(threshold) / (1 + threshold) * (F.col("n_a") + F.col("n_b")) - 1e-9)
    # at the first shared position at most the rest of both texts can be common
    fits = (F.col("rep_a") < F.col("rep_b")) & (F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b")) >= need) & (F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b"))
    candidates = left.join(right, ["grp", "bit", "cut"]).where(fits).select("grp", F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).distinct()
    one, two = [reps.select("grp", F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits{x}")) for x in "ab"]
    both = candidates.join(one, ["grp", "a"]).join(two, ["grp", "b"])
    common = F.size(F.array_intersect("bitsa", "bitsb"))
    measured = both.select("grp", "a", "b", (F.col("na") + F.col("nb")).alias("n"), common.alias("common"))
    near = measured.where(F.col("common") >= threshold * (F.col("n") - F.col("common")))
    return members, near.select("grp", "a", "b", (F.col("n") - 2 * F.col("common")).alias("distance"), (F.col("common") / (F.col("n") - F.col("common"))).alias("similarity"))


def similar_pairs(records: DataFrame, threshold: float = 0.75, min_words: int = 60, with_similarity: bool = False) -> DataFrame:
    """``grp, log_id_a, log_id_b`` and, if asked for, ``similarity``: all pairs of records that are nearly the same, see ``similar_classes``.

    ``records`` has ``grp, log_id, text``. Null and short texts are in no pair; records with the same words
    are. This expands classes into rows, so the result is as large as it is asked to be.
    """
    members, near = similar_classes(records, threshold, min_words)
    members = staged(members, "members")
    a, b = [members.select("grp", F.col("rep").alias(x), F.col("log_id").alias(f"id_{x}")) for x in "ab"]
    across = near.join(a, ["grp", "a"]).join(b, ["grp", "b"]).select("grp", "id_a", "id_b", "similarity")
    # classes of one record have no pairs of their own
    many = members.withColumn("_n", F.count("*").over(W.partitionBy("grp", "rep"))).where("_n > 1")
    x, y = [many.select("grp", "rep", F.col("log_id").alias(f"id_{s}")) for s in "ab"]
    within = x.join(y, ["grp", "rep"]).where("id_a < id_b").select("grp", "id_a", "id_b", F.lit(1.0).alias("similarity"))
    columns = ["grp", F.least("id_a", "id_b").alias("log_id_a"), F.greatest("id_a", "id_b").alias("log_id_b")]
    return across.unionByName(within).select(*columns, *(["similarity"] if with_similarity else []))
