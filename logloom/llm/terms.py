"""Problem 1: how often every value or term occurs, by heavy-light aggregation."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A term with this share of a partition's terms is a heavy candidate there.
HEAVY_SHARE = 1 / 2000
#: Heavy terms that are broadcast; candidates beyond it are counted as light ones, with the same result.
MAX_HEAVY = 4096
#: Counters with which a task looks for its heavy terms, as a multiple of the most that can be heavy.
COUNTERS = 8
#: Distinct light terms after which a task hands on its local counts.
FLUSH = 200_000

_PIECE = re.compile(r"[\w.\-]+")
_DIGIT = re.compile(r"\d")


def terms(text: str) -> list[str]:
    """Terms of a text in order: runs of letters, digits, ``_ - .`` in lower case, without ``_ - .`` at the ends.

    Terms that hold a digit or are empty don't count. The whole text is read, whatever its length.
    """
    found = [x.strip("_-.") for x in _PIECE.findall(text.lower())]
    return [x for x in found if x and not _DIGIT.search(x)]


def value(text: str) -> list[str]:
    """The text itself as the one term."""
    return [text]


def term_counts(
    records: DataFrame, how: dict[str, Callable[[str], list[str]]], min_records: int = 5, max_share: float = 0.05, heavy_share: float = HEAVY_SHARE
) -> DataFrame:
    """``field, term, occurrences, records, mark`` of every term of every field.

    ``records`` has ``field`` and ``text``; ``how`` names each field's tokeniser. ``records`` counts the
    rows that hold the term, ``occurrences`` its uses. ``mark`` is 'rare' below ``min_records`` rows,
    'common' above ``max_share`` of the field's rows with text, else null. Rows with null text or field,
    and fields without tokeniser, don't count; empty texts are rows without terms; repeated rows count.

    First every partition proposes the terms that are heavy in it, found with a bounded number of counters
    (Misra and Gries): a term heavy overall is heavy in at least one of them. The heavy terms are then broadcast
    and counted in exact arrays, one slot each, in every task; the other terms are counted locally and
    shuffled; both tables are united. The texts are read twice.
    """
    slim = records.select("field", "text").where(F.col("text").isNotNull() & F.col("field").isin(list(how)))

    most = int(COUNTERS / heavy_share)

    def propose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        uses: Counter = Counter()
        rows: Counter = Counter()
        total = lost = 0
        for batch in batches:
            for field, texts in batch.groupby("field", sort=False)["text"]:
                rows[field] += len(texts)
                split = how[field]
                for x in texts:
                    found = split(x)
                    total += len(found)
                    uses.update([(field, t) for t in found])
                    if len(uses) > 2 * most:  # all counters lose what the greatest that must go has
                        less = sorted(uses.values(), reverse=True)[most]
                        lost += less
                        uses = Counter({k: n - less for k, n in uses.items() if n > less})
        least = heavy_share * total - lost
        out = [(f, t, n) for (f, t), n in uses.items() if n >= least] + [(f, None, n) for f, n in rows.items()]
        if out:
            yield pd.DataFrame(out, columns=["field", "term", "n"])

    proposed = slim.mapInPandas(propose, "field string, term string, n long").groupBy("field", "term").agg(F.sum("n").alias("n"))
    # one action: the fields' rows come first, then the heaviest terms
    top = proposed.orderBy(F.col("term").isNotNull(), F.desc("n"), "field", "term").limit(len(how) + MAX_HEAVY).collect()
    totals = {r["field"]: r["n"] for r in top if r["term"] is None}
    names = [(r["field"], r["term"]) for r in top if r["term"] is not None]
    shipped = records.sparkSession.sparkContext.broadcast({k: i for i, k in enumerate(names)})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slots = shipped.value
        uses, rows = np.zeros(len(slots), np.int64), np.zeros(len(slots), np.int64)
        light: dict[tuple[str, str], list[int]] = {}

        def handed() -> pd.DataFrame:
            out = pd.DataFrame([(f, t, a, b) for (f, t), (a, b) in light.items()], columns=["field", "term", "occurrences", "records"])
            light.clear()
            return out

        for batch in batches:
            for field, texts in batch.groupby("field", sort=False)["text"]:
                split = how[field]
                for x in texts:
                    for t, n in Counter(split(x)).items():
                        key = (field, t)
                        slot = slots.get(key)
                        if slot is not None:
                            uses[slot] += n
                            rows[slot] += 1
                        elif (cell := light.get(key)) is not None:
                            cell[0] += n
                            cell[1] += 1
                        else:
                            light[key] = [n, 1]
                if len(light) > FLUSH:
                    yield handed()
        if light:
            yield handed()
        # empty frames are never handed on: their columns have no type that Arrow could take for text
        if len(at := np.flatnonzero(rows)):
            names = list(slots)
            yield pd.DataFrame({"field": [names[i][0] for i in at], "term": [names[i][1] for i in at], "occurrences": uses[at], "records": rows[at]})

    # a heavy term arrives here as one row a task, a light one as few
    both = slim.mapInPandas(count, "field string, term string, occurrences long, records long")
    counted = both.groupBy("field", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    total = F.lit(None).cast("long")
    for field, n in totals.items():
        total = F.when(F.col("field") == field, F.lit(n).cast("long")).otherwise(total)
    # a share that is exactly the limit divides to the limit's own double
    mark = F.when(F.col("records") < min_records, "rare").when(F.col("records") / total > max_share, "common")
    return counted.select("field", "term", "occurrences", "records", mark.alias("mark"))
