"""Similarity of token lists and templates."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ANY = "*"


def _sum(flags: Column) -> Column:
    return F.aggregate(flags, F.lit(0), lambda acc, x: acc + x.cast("int"))


def equal_positions(template: Column, tokens: Column) -> Column:
    """Positions at which a token equals the template's constant."""
    return _sum(F.zip_with(template, tokens, lambda a, b: F.coalesce((a != ANY) & (a == b), F.lit(False))))


def differing_positions(template: Column, tokens: Column) -> Column:
    """Positions that differ; ``*`` in the template differs from every other token."""
    return _sum(F.zip_with(template, tokens, lambda a, b: ~a.eqNullSafe(b)))


def share_of_length(template: Column, tokens: Column) -> Column:
    """Equal positions by length; null for empty templates."""
    return F.try_divide(equal_positions(template, tokens), F.size(template))


def share_of_constants(template: Column, tokens: Column) -> Column:
    """Equal positions by constants; a template of one ``*`` is like a token with a digit, others of none are like nothing."""
    constants = F.size(F.filter(template, lambda x: x != ANY))
    lone = F.when((F.size(template) == 1) & tokens[0].rlike(r"(?U)\d"), 1.0).otherwise(0.0)
    return F.when(constants > 0, equal_positions(template, tokens) / constants).otherwise(lone)


def within_distance(template: Column, tokens: Column, nc: Column, st: Column) -> Column:
    """Whether at most ``ceil((1 - st) * nc)`` positions differ."""
    return differing_positions(template, tokens) <= F.ceil((1 - st) * nc)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct tokens; null if both lists are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def is_subsequence(template: Column, tokens: Column) -> Column:
    """Whether the template's tokens occur in the list in order; ``*`` is a token like any other."""
    step = lambda at, t: F.when(F.try_element_at(template, at + 1) == t, at + 1).otherwise(at)
    return F.aggregate(tokens, F.lit(0), step) == F.size(template)


def merged_template(template: Column, tokens: Column) -> Column:
    """Equal tokens kept, others ``*``."""
    return F.zip_with(template, tokens, lambda a, b: F.when(a == b, a).otherwise(ANY))


def places(tokens: list[str]) -> dict[str, int]:
    """The places of every token, as the bits of a number."""
    at: dict[str, int] = {}
    for i, t in enumerate(tokens):
        at[t] = at.get(t, 0) | 1 << i
    return at


def _rows(a: list[str], at: dict[str, int], n: int) -> Iterator[int]:
    """Lengths of the longest common subsequences of all prefixes, by rows: a number's bits, 0 where the length grows from one place to the next."""
    row = full = (1 << n) - 1
    yield row
    for t in a:
        if hit := row & at.get(t, 0):
            row = (row + hit | row - hit) & full
        yield row


def lcs_size(a: list[str], at: dict[str, int], n: int) -> int:
    """Length of the longest common subsequence of ``a`` and ``n`` tokens with ``places`` ``at``."""
    row = full = (1 << n) - 1
    for t in a:
        if hit := row & at.get(t, 0):
            row = (row + hit | row - hit) & full
    return n - row.bit_count()


def lcs_walk(a: list[str], b: list[str], mark: bool) -> tuple[int, list[str]]:
    """LCS length, and the common tokens: without ``*`` or, with ``mark``, with one ``*`` where tokens of ``a`` are left out.

    On a tie the walk back goes up (leaves out a token of ``a``). Leading omissions get no mark.
    """
    rows = list(_rows(a, places(b), len(b)))
    length = lambda i, j: j - (rows[i] & (1 << j) - 1).bit_count()
    i, j, back = len(a), len(b), []
    while i and j:
        if a[i - 1] == b[j - 1]:
            back.append(a[i - 1])
            i, j = i - 1, j - 1
        elif length(i, j - 1) > length(i - 1, j):
            j -= 1
        else:
            back.append(None)
            i -= 1
    out: list[str] = []
    for t in reversed(back):
        if t is not None:
            if mark or t != ANY:
                out.append(t)
        elif mark and out and out[-1] != ANY:
            out.append(ANY)
    return len(b) - rows[-1].bit_count(), out


def _udf(mark: bool | None):
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
            n, common = (None, None) if x is None or y is None else lcs_walk(x, y, bool(mark))
            out.append(n if mark is None else common)
        return pa.array(out, pa.int32() if mark is None else pa.list_(pa.string()))

    return F.arrow_udf(run, T.IntegerType() if mark is None else T.ArrayType(T.StringType()))


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence."""
    return _udf(None)(a, b)


def lcs_tokens(a: Column, b: Column) -> Column:
    """Tokens of the longest common subsequence without ``*``."""
    return _udf(False)(a, b)


def lcs_template(a: Column, b: Column) -> Column:
    """Common tokens with ``*`` where tokens of ``a`` are left out."""
    return _udf(True)(a, b)
