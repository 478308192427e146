"""Template miners: one small state machine each, run per group of the smallest key that keeps results exact.

Every miner is order dependent: inside a group rows are sorted by ``order``. ``compat`` switches the
historical quirks on (the default, for equal results) or off (the documented intent).

All miners return ``Mined(assignments, templates)``: ``assignments(log_id, event)`` and
``templates(event, template, n)``; events count from 1.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Callable, Hashable, Iterable, Iterator
from functools import lru_cache, partial
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.functions.similarity import ANY, lcs_size, lcs_walk, places
from logloom.functions.tokens import SPECIAL, key_layer
from logloom.operators.ordering import positions
from logloom.session import staged


class Mined(NamedTuple):
    """Result of a miner."""

    assignments: DataFrame
    templates: DataFrame


def digit(token: str) -> bool:
    """Whether a token holds a digit."""
    return any(c.isdigit() for c in token)


def special(token: str) -> bool:
    """Whether a token holds a special character."""
    return any(c in SPECIAL for c in token)


def merged(template: list[str], tokens: list[str]) -> list[str]:
    """Equal tokens kept, others ``*``."""
    return [a if a == b else ANY for a, b in zip(template, tokens, strict=True)]


def collapsed(template: list[str]) -> str:
    """Template text with runs of ``*`` as one."""
    return re.sub(r"(\* )+", "* ", " ".join(template) + " ").strip()


def _start_threshold(tokens: list[str], full: float) -> float:
    return full - full * (sum(map(digit, tokens)) / len(tokens))


class Known:
    """Where messages went since the last change of a template, by their tokens; of fixed size."""

    SIZE = 65_536

    def __init__(self) -> None:
        self.at: dict[tuple[str, ...], int] = {}

    def get(self, tokens: list[str]) -> int | None:
        return self.at.get(tuple(tokens))

    def put(self, tokens: list[str], k: int) -> int:
        if len(self.at) >= self.SIZE:
            self.at.clear()
        self.at[tuple(tokens)] = k
        return k

    def clear(self, k: int) -> int:
        self.at.clear()
        return k


# ---- signature buckets with entropy -------------------------------------------------------------


class Codes:
    """Templates of equal length as rows of token numbers, so that one comparison serves all of them."""

    def __init__(self, templates: list[list[str]], limits: list[int]) -> None:
        self.numbers: dict[str, int] = {ANY: 0}
        self.rows, self.limits, self.n = np.zeros((0, 0), np.int32), np.zeros(0, np.int64), 0
        for template, limit in zip(templates, limits, strict=True):
            self.put(self.n, template, limit)

    def of(self, tokens: list[str]) -> np.ndarray:
        return np.array([self.numbers.setdefault(t, len(self.numbers)) for t in tokens], np.int32)

    def put(self, k: int, template: list[str], limit: int) -> None:
        """Set template ``k`` and the most positions at which a message may differ from it."""
        if k >= len(self.rows):
            rows, limits = np.zeros((max(4, 2 * k), len(template)), np.int32), np.zeros(max(4, 2 * k), np.int64)
            if self.n:
                rows[: self.n], limits[: self.n] = self.rows[: self.n], self.limits[: self.n]
            self.rows, self.limits = rows, limits
        self.rows[k], self.limits[k], self.n = self.of(template), limit, max(self.n, k + 1)

    def accepting(self, tokens: list[str]) -> list[int]:
        """Templates from which a message differs at no more positions than they allow, in order."""
        if not self.n:
            return []
        return np.flatnonzero((self.rows[: self.n] != self.of(tokens)).sum(axis=1) <= self.limits[: self.n]).tolist()


def _limit(cluster: dict) -> int:
    return math.ceil((1 - cluster["st"]) * cluster["nc"])


class EntropyBucket:
    """Clusters of one (pos, key): the accepted cluster of least entropy change takes the message."""

    def __init__(self, full: float, few: int, compat: bool) -> None:
        self.full, self.few, self.compat, self.clusters = full, few, compat, []
        self.codes = Codes([], [])

    def step(self, tokens: list[str]) -> int:
        best = None
        accepting = self.codes.accepting(tokens)
        for k in accepting:
            got = self._change(self.clusters[k], tokens)
            if best is None or got[0] < best[1]:
                best = (k, *got)
        if best is None:
            n = len(tokens)
            self.clusters.append({"template": tokens, "st": _start_threshold(tokens, self.full), "nc": n, "n": 1, "entropy": [0.0] * n, "seen": [Counter([t]) for t in tokens]})
            self.codes.put(len(self.clusters) - 1, tokens, _limit(self.clusters[-1]))
            return len(self.clusters) - 1
        # quirk: the entropies kept are those of the cluster looked at last, not of the one chosen
        change = best[2]
        if self.compat and accepting[-1] != best[0]:
            change = self._change(self.clusters[accepting[-1]], tokens)[1]
        if self.compat and accepting[-1] != len(self.clusters) - 1:
            change = {}
        c = self.clusters[best[0]]
        new = merged(c["template"], tokens)
        c["nc"], c["n"] = sum(t == s for t, s in zip(c["template"], tokens, strict=True)), c["n"] + 1
        for seen, t in zip(c["seen"], tokens, strict=True):
            seen[t] += 1
        for i, e in change.items():
            c["entropy"][i] = e
        if new != c["template"] or self.codes.limits[best[0]] != _limit(c):
            c["template"] = new
            self.codes.put(best[0], new, _limit(c))
        return best[0]

    def _change(self, c: dict, tokens: list[str]) -> tuple[float, dict[int, float]]:
        total, change, n = 0.0, {}, c["n"] + 1
        for i, (a, b) in enumerate(zip(c["template"], tokens, strict=True)):
            if a != b and len(seen := c["seen"][i]) < self.few:
                weight = sum((f + (t == b)) * math.log(f + (t == b)) for t, f in seen.items())
                change[i] = -(1.0 / n * weight - math.log(n))
                total += abs(c["entropy"][i] - change[i])
        return total, change

    def end(self) -> list[tuple[int, str, list[str]]]:
        return [(k, " ".join(c["template"]), c["template"]) for k, c in enumerate(self.clusters)]


# ---- signature buckets with first fit and Gini refinement ---------------------------------------


class GiniBuckets:
    """Clusters of one pos by key: the cluster used last, else the first that accepts, takes the message."""

    def __init__(self, full: float, few: int, compat: bool) -> None:
        self.full, self.few, self.compat, self.last = full, few, compat, None
        self.keys: dict[str, list[dict]] = {}
        self.codes: dict[str, Codes] = {}

    def step(self, key: str, tokens: list[str]) -> int:
        if key not in self.keys:
            self.keys[key], self.codes[key] = [], Codes([], [])
        clusters, skip = self.keys[key], -1
        accepting = self.codes[key].accepting(tokens)
        if self.last:
            if self.last[0] == key:
                skip = self.last[1]
                if skip in accepting:
                    return self._take(key, skip, tokens)
            elif self.compat:
                skip = self.last[1]  # quirk: the index is skipped in another key's list, too
        for k in accepting:
            if k != skip:
                return self._take(key, k, tokens)
        n = len(tokens)
        clusters.append({"template": tokens, "first": tokens, "st": _start_threshold(tokens, self.full), "nc": n, "n": 1, "seen": [Counter([t]) for t in tokens]})
        self.codes[key].put(len(clusters) - 1, tokens, _limit(clusters[-1]))
        self.last = (key, len(clusters) - 1)
        return self.last[1]

    def _take(self, key: str, k: int, tokens: list[str]) -> int:
        c = self.keys[key][k]
        c["nc"] = sum(a == b for a, b in zip(c["template"], tokens, strict=True))
        new, c["n"] = merged(c["template"], tokens), c["n"] + 1
        for seen, t in zip(c["seen"], tokens, strict=True):
            seen[t] += 1
        if new != c["template"] or self.codes[key].limits[k] != _limit(c):
            c["template"] = new
            self.codes[key].put(k, new, _limit(c))
        self.last = (key, k)
        return k

    def variables(self, key: str, k: int, tokens: list[str]) -> dict[int, str]:
        """A message's tokens where its cluster may be split yet; elsewhere they are those of the cluster's first message."""
        c = self.keys[key][k]
        return {i: tokens[i] for i, t in enumerate(c["template"]) if t == ANY and len(c["seen"][i]) < self.few}


def split_position(n: int, template: list[str], seen: list[list | None], total: int, most: float, compat: bool) -> int:
    """The ``*`` position a big cluster is split at, -1 for none: the last (quirk), else that of least Gini.

    ``seen`` lists tokens and counts of the positions with few enough of them.
    """
    if n / total < 0.1:
        return -1
    fit = []
    for i, t in enumerate(template):
        if t == ANY and seen[i] is not None:
            gini = 1 - sum(f * f for _, f in seen[i]) / n**2
            if gini <= most and gini < 1:
                fit.append((gini, i))
    return -1 if not fit else fit[-1][1] if compat else min(fit)[1]


# ---- fixed-depth tree ---------------------------------------------------------------------------


class FixedTree:
    """Tree over the first tokens of messages of one length; leaves hold clusters."""

    def __init__(self, depth: int, children: int, least: float, compat: bool) -> None:
        self.depth, self.children, self.least, self.compat = depth, children, least, compat
        self.root: dict = {}
        self.leaf: list[int] = []  # clusters of length-independent depth 1, when depth is 1
        self.templates: list[list[str]] = []
        self.known = Known()

    def step(self, tokens: list[str]) -> int:
        if (k := self.known.get(tokens)) is not None:
            return k
        k = self._step(tokens)
        # what a message found it finds again until a template changes
        return self.known.put(tokens, k) if self.templates[k] == self.before else self.known.clear(k)

    def _step(self, tokens: list[str]) -> int:
        self.before = None
        path = self._find(tokens)
        if path is not None:
            scored = []
            for k in path:
                t = self.templates[k]
                same = sum(a == b for a, b in zip(t, tokens, strict=True) if a != ANY)
                scored.append((same / len(tokens), t.count(ANY), -k))
            if scored and (top := max(scored))[0] >= self.least:
                k = -top[2]
                self.before = self.templates[k]
                self.templates[k] = merged(self.templates[k], tokens)
                return k
        self.templates.append(tokens)
        self._insert(tokens, len(self.templates) - 1)
        return len(self.templates) - 1

    def _levels(self, n: int) -> int:
        return min(self.depth - 1, n)

    def _find(self, tokens: list[str]) -> list[int] | None:
        node = self.root
        if not node and not self.leaf:
            return None
        for t in tokens[: self._levels(len(tokens))]:
            node = node.get(t, node.get(ANY))
            if node is None:
                return None
        return node.get("\0", []) if node is not self.root else self.leaf

    def _insert(self, tokens: list[str], k: int) -> None:
        node = self.root
        for t in tokens[: self._levels(len(tokens))]:
            branches = len(node) - ("\0" in node)
            if t not in node:
                if digit(t):
                    t = ANY
                elif ANY in node:
                    t = t if branches < self.children else ANY
                elif branches + 1 >= self.children:
                    t = ANY
            node = node.setdefault(t, {})
        # quirk: messages shorter than the tree is deep never reach a leaf
        if len(tokens) >= self.depth or not self.compat:
            (self.leaf if node is self.root else node.setdefault("\0", [])).append(k)

    def end(self) -> list[tuple[int, str, list[str]]]:
        return [(k, " ".join(t), t) for k, t in enumerate(self.templates)]


# ---- directed acyclic graph: tree phase ---------------------------------------------------------


class PointerTree:
    """Clusters of one length by first or last token, the one used last being tried first."""

    def __init__(self, children: int, compat: bool = True) -> None:
        self.children, self.compat = children, compat
        self.nodes, self.pointer, self.clusters = {}, None, []

    def step(self, tokens: list[str]) -> tuple[int, bool]:
        """The cluster, and whether its template is new or changed."""
        k = self._find(tokens)
        if k is None:
            digits = sum(map(digit, tokens))
            st = 0.5 * (len(tokens) - digits) / len(tokens)
            self.clusters.append({"template": tokens, "st": st, "first_st": st, "base": max(2, digits + 1), "changes": 0})
            k = len(self.clusters) - 1
            self._insert(tokens, k)
            self.pointer = k
            return k, True
        c = self.clusters[k]
        new = merged(c["template"], tokens)
        if new == c["template"]:
            return k, False
        c["changes"] += sum(a != b and a != ANY for a, b in zip(c["template"], tokens, strict=True))
        c["template"] = new
        c["st"] = min(1, c["first_st"] + 0.5 * math.log(c["changes"] + 1, c["base"]))
        return k, True

    @staticmethod
    def likeness(template: list[str], tokens: list[str]) -> tuple[float, int]:
        stars = template.count(ANY)
        if stars == len(template):
            return (1.0 if len(template) == 1 and digit(tokens[0]) else 0.0), stars
        return sum(a == b for a, b in zip(template, tokens, strict=True) if a != ANY) / (len(template) - stars), stars

    def _find(self, tokens: list[str]) -> int | None:
        if self.pointer is None:
            return None
        first, last = tokens[0], tokens[-1]
        c = self.clusters[self.pointer]
        t = c["template"]
        plain = [not digit(x) and not special(x) for x in (first, last)]
        if ((t[0] == first and plain[0]) or (t[-1] == last and plain[1]) or (t[0] == ANY and t[-1] == ANY)) and self.likeness(t, tokens)[0] >= c["st"]:
            return self.pointer
        # quirk: messages that went to the catch-all because there were enough nodes aren't looked for there
        for key in (("first", first), ("last", last), *([ANY] if not self.compat or (digit(first) and digit(last)) else [])):
            if key in self.nodes:
                break
        else:
            return None
        top = max(((*self.likeness(self.clusters[k]["template"], tokens), -k) for k in self.nodes[key]), default=None)
        if top is None or top[0] < self.clusters[-top[2]]["st"]:
            return None
        self.pointer = -top[2]
        return self.pointer

    def _insert(self, tokens: list[str], k: int) -> None:
        first, last = ("first", tokens[0]), ("last", tokens[-1])
        self.nodes.setdefault(ANY, [])
        if first in self.nodes or last in self.nodes:
            key = first if first in self.nodes else last
        elif len(self.nodes) == self.children:
            key = ANY
        elif digit(tokens[0]):
            key = ANY if digit(tokens[-1]) else last
        elif digit(tokens[-1]) or special(tokens[-1]):
            key = first
        else:
            key = last if special(tokens[0]) else first
        self.nodes.setdefault(key, []).append(k)


def cells(changes: list[tuple[int, int, list[str]]], threshold: float) -> dict[int, int]:
    """Output cell of each cluster, replaying new and changed templates in order.

    After a change a cluster's cell joins that of the most similar cluster of another length and cell, if
    their common constants exceed ``threshold`` of the shorter length; ties: more in common, then earlier.
    """
    templates: dict[int, list[str]] = {}
    cell: dict[int, int] = {}
    held: dict[int, list[int]] = {}
    terms = Terms()
    for _, c, template in sorted(changes, key=lambda x: x[0]):
        new = c not in templates
        templates[c] = template
        constants = [t for t in template if t != ANY]
        terms.put(c, constants)
        if new:
            cell[c], held[c] = c, [c]
            continue
        if threshold >= 1:
            continue
        best = None
        shared = terms.shared(set(constants))
        repeats = len(constants) - len(set(constants))
        for o in sorted(shared, key=terms.order.__getitem__):
            other = templates[o]
            if len(other) == len(template) or cell[o] == cell[c]:
                continue
            shorter = min(len(template), len(other))
            if (shared[o] + repeats) / shorter <= threshold:  # there can't be more in common
                continue
            common = len(lcs_walk(template, other, mark=False)[1])
            score = (common / shorter, common)
            if best is None or score > best[0]:
                best = (score, o)
        if best and best[0][0] > threshold:
            gone = cell[c]
            for o in held.pop(gone):
                cell[o] = cell[best[1]]
                held[cell[o]].append(o)
    return cell


class Terms:
    """Which texts hold a token: how many different tokens each shares with a message, without looking at all texts."""

    def __init__(self) -> None:
        self.order: dict[int, int] = {}
        self.sets: dict[int, set[str]] = {}
        self.holders: dict[str, set[int]] = {}

    def put(self, k: int, tokens: list[str]) -> None:
        """Set the tokens of text ``k``."""
        self.order.setdefault(k, len(self.order))
        new, old = set(tokens), self.sets.get(k, set())
        for t in old - new:
            self.holders[t].discard(k)
        for t in new - old:
            self.holders.setdefault(t, set()).add(k)
        self.sets[k] = new

    def shared(self, tokens: set[str]) -> Counter:
        """Number of different tokens in common with each text that has any."""
        return Counter(k for t in tokens for k in self.holders.get(t, ()))


class Shares:
    """How many different tokens of a message each text has, for all texts at once.

    A text is a bit. A token is the number whose bits are the texts that hold it, and the message's tokens are added
    up in binary, all bits side by side, so a message takes some operations on long numbers instead of a look at
    every text. Texts are cut into blocks, so that a rare token is one short number.
    """

    BLOCK = 8192

    def __init__(self) -> None:
        self.sets: dict[int, frozenset[Hashable]] = {}
        self.holders: list[dict[Hashable, int]] = []
        self.sizes: list[dict[int, int]] = []
        self.given: dict[int, int] = {}

    def put(self, k: int, tokens: Iterable[Hashable], size: int | None = None) -> None:
        """Set the tokens of text ``k``; ``size`` is its size if not their number."""
        new, old = frozenset(tokens), self.sets.get(k, frozenset())
        if new == old:
            return
        block, bit = k // self.BLOCK, 1 << k % self.BLOCK
        while len(self.holders) <= block:
            self.holders.append({})
            self.sizes.append({})
        was, now = [self.given.get(k, len(old))] if old else [], [len(new) if size is None else size] if new else []
        if size is not None:
            self.given[k] = size
        for cells, gone, come in ((self.holders[block], old - new, new - old), (self.sizes[block], was, now)):
            for x in gone:
                cells[x] ^= bit
                if not cells[x]:
                    del cells[x]
            for x in come:
                cells[x] = cells.get(x, 0) | bit
        self.sets[k] = new

    def counted(self, tokens: frozenset[Hashable]) -> list[list[int]]:
        """By block the binary digits of the number of tokens in common, the lowest first."""
        out = []
        for holders in self.holders:
            digits: list[int] = []
            for carry in filter(None, map(holders.get, tokens)):
                for i, d in enumerate(digits):
                    digits[i], carry = d ^ carry, d & carry
                    if not carry:
                        break
                if carry:
                    digits.append(carry)
            out.append(digits)
        return out

    def sharing(self, shared: list[list[int]], least: Callable[[int], int | None], among: range | None = None) -> list[int]:
        """Texts that share ``least(size)`` tokens or more, in order; none of a size for which that is None or which isn't ``among`` those."""
        out = []
        for block, (digits, sizes) in enumerate(zip(shared, self.sizes, strict=True)):
            found, most = 0, 1 << len(digits)
            wanted: dict[int, int] = {}
            for size in sizes if among is None or len(sizes) < len(among) else among:
                if (equal := sizes.get(size)) and (n := least(size)) is not None and n < most:
                    wanted[n] = wanted.get(n, 0) | equal
            for n, equal in wanted.items():
                for i in range(len(digits) - 1, -1, -1):
                    if n >> i & 1:
                        equal &= digits[i]
                    else:
                        found |= equal & digits[i]
                        equal &= ~digits[i]
                    if not equal:
                        break
                found |= equal
            while found:
                low = found & -found
                out.append(block * self.BLOCK + low.bit_length() - 1)
                found ^= low
        return out


# ---- longest common subsequence over all messages ----------------------------------------------


#: Keys in a node of the prefix tree, beside tokens.
COUNT, EVENT = 0, 1


class Near(NamedTuple):
    """A signature that may be like a message, as it was looked at."""

    k: int
    signature: list[str]
    common: int  # length of the longest common subsequence, -1 if they share too few tokens
    held: bool  # in the message, in order


@lru_cache(1 << 16)
def _least(own: int, n: int) -> int | None:
    """Tokens that a message of ``own`` and a signature of ``n`` different ones share if it is near: more than half of both, or all of the signature's."""
    return min(n, (own + n) // 3 + 1) if n < 2 * own else None


class Form:
    """Messages alike but for tokens that few signatures hold, and the signatures that are near all of them."""

    __slots__ = ("changed", "near", "verdict")

    def __init__(self, near: list[Near]) -> None:
        self.near, self.verdict = near, None
        self.changed: list[int] = []


class Signatures:
    """Signatures of all messages: prefix tree, then subsequence, then longest common subsequence.

    What the last two find for a message depends on the tokens that signatures hold. Tokens that no signature or up
    to ``RARE`` hold are left out of its form: for a form met before, the signatures near it are kept, and each new or
    changed signature is noted with the forms that it is near to, so the result is that of a look at all signatures.
    The few that hold a rare token of the message are looked at one by one. Forms are kept from the second time on,
    up to ``FORMS``.
    """

    RARE, FEW, FORMS, ONCE = 40, 64, 131_072, 524_288

    def __init__(self, threshold: float, compat: bool = True) -> None:
        self.threshold, self.compat = threshold, compat
        # A node is a dictionary of the nodes below by token; at ``COUNT`` the signatures through it, at ``EVENT`` the number of one that ends there.
        self.tree, self.signatures, self.known = {COUNT: 0, EVENT: -1}, {}, Known()
        self.terms, self.holders, self.doubled = Shares(), {}, set()
        self._forget()

    def _forget(self) -> None:
        self.forms: dict[tuple, Form] = {}
        self.listed: list[Form] = []
        self.uses, self.once = Shares(), set()

    def __getstate__(self) -> dict:
        state = self.__dict__.copy()
        for name in ("forms", "listed", "uses", "once"):
            del state[name]
        return state

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._forget()

    def step(self, tokens: list[str]) -> int:
        if (k := self.known.get(tokens)) is not None:
            return k
        if (k := self._walk(tokens)) == -1:
            k, result = self._found(tokens)
            if result is not None:
                if k == -1:
                    k = len(self.signatures) + 1
                elif result == self.signatures[k]:
                    if self._added_again(result, k):
                        self.known.clear(k)
                    return self.known.put(tokens, k)
                else:
                    self._remove(self.signatures[k])
                self._set(k, result)
                return self.known.clear(k)
        return self.known.put(tokens, k)

    def _found(self, tokens: list[str]) -> tuple[int, list[str] | None]:
        """The signature that takes a message, or -1, and the signature to be; None if it stays and its place in the tree too."""
        own, few = frozenset(tokens), set()
        key: list[str | None] = []
        for t in tokens:
            if (held := self.holders.get(t)) is None:
                key.append(None)
            elif len(held) <= self.RARE:
                key.append(None)
                few |= held
            else:
                key.append(t)
        if len(few) > self.FEW:
            key, few = [t if t in self.holders else None for t in tokens], set()
        form = self._form(key, len(own))
        sets, half, more = self.terms.sets, (len(own) + 1) // 2, []
        if few:  # near ones share half of the message's tokens, or hold some twice and are in it
            like = {k for k, n in zip(few, map(len, map(own.__and__, map(sets.__getitem__, few)))) if n >= half}
            if like := like.union(k for k in few & self.doubled if sets[k] <= own):
                at = places(tokens)
                more = [x for k in like if (x := self._looked_at(k, tokens, at, own, len(own)))]
        if not more:
            if form.verdict is None:
                form.verdict = self._chosen(form.near, key)
            k, result = form.verdict
            return (k, tokens) if k == -1 else (k, result)
        if form.near:
            seen = {x.k for x in more}
            more += [x for x in form.near if x.k not in seen]
        more.sort()
        k, result = self._chosen(more, tokens)
        return (k, tokens) if k == -1 else (k, result)

    def _form(self, tokens: list[str | None], own: int) -> Form:
        form = self.forms.get(key := (own, *tokens))
        if form is None:
            at, base = places(tokens), frozenset(tokens) - {None}
            like = self.terms.sharing(self.terms.counted(base), partial(_least, own), range(1, 2 * own))
            form = Form([x for k in like if (x := self._looked_at(k, tokens, at, base, own))])
            if (h := hash(key)) in self.once:
                if len(self.listed) >= self.FORMS:
                    self._forget()
                self.forms[key] = form
                self.uses.put(len(self.listed), base, own)
                self.listed.append(form)
            else:
                if len(self.once) >= self.ONCE:
                    self.once.clear()
                self.once.add(h)
            return form
        if form.changed or any(self.signatures[x.k] is not x.signature for x in form.near):
            kept = [x for x in form.near if self.signatures[x.k] is x.signature]
            again = set(form.changed) - {x.k for x in kept}
            at, base = places(tokens), frozenset(tokens) - {None}
            form.near = sorted(kept + [x for k in again if (x := self._looked_at(k, tokens, at, base, own))])
            form.changed, form.verdict = [], None
        return form

    def _looked_at(self, k: int, tokens: list[str | None], at: dict[str | None, int], base: frozenset[str], own: int) -> Near | None:
        s, held = self.signatures[k], self.terms.sets[k]
        shared, inside = len(base & held), False
        if shared == len(held) and len(s) / len(tokens) >= 0.5:
            rest = iter(tokens)
            inside = all(t in rest for t in s)
        like = 3 * shared > own + len(held)
        return Near(k, s, lcs_size(s, at, len(tokens)) if like else -1, inside) if like or inside else None

    def _chosen(self, near: list[Near], tokens: list[str | None]) -> tuple[int, list[str] | None]:
        for x in near:
            if x.held:
                return x.k, None
        best, size, length = -1, -1, 0
        for k, s, n, _ in near:
            if n < 0:
                continue
            if n > size:
                best, size, length = k, n, len(s)
            elif n == size and len(s) < length:
                best = k
                if self.compat:  # quirk: the length now counts ``*`` too, and the signature compared with stays
                    size = len(lcs_walk(s, tokens, mark=True)[1])
                else:
                    length = len(s)
        if size / len(tokens) >= self.threshold:
            return best, lcs_walk(self.signatures[best], tokens, mark=True)[1]
        return -1, None

    def _set(self, k: int, signature: list[str]) -> None:
        """Signature ``k`` is new or another; its place in the tree is no more."""
        old, new = self.terms.sets.get(k, frozenset()), frozenset(signature)
        self.signatures[k] = signature
        self._add(signature, k)
        self.terms.put(k, new)
        (self.doubled.add if len(signature) > len(new) else self.doubled.discard)(k)
        for t in old - new:
            self.holders[t].discard(k)
            if not self.holders[t]:
                del self.holders[t]
        for t in new - old:
            self.holders.setdefault(t, set()).add(k)
        if self.listed:
            n = len(new)
            for i in self.uses.sharing(self.uses.counted(new), lambda own: _least(own, n)):
                self.listed[i].changed.append(k)

    def _walk(self, tokens: list[str]) -> int:
        node = self.tree
        for t in tokens:
            below = node.get(t) or node.get(ANY)
            if below is not None:
                node = below
            elif not self.compat:  # quirk: else a token without branch is passed over
                return -1
        return node[EVENT]

    def _remove(self, signature: list[str]) -> None:
        node = self.tree
        for t in signature:
            if (below := node.get(t)) is None:
                return
            if below[COUNT] > 1:
                below[COUNT] -= 1
            else:
                del node[t]
            node = below

    def _add(self, signature: list[str], k: int) -> None:
        node = self.tree
        for t in signature:
            if t in node:
                node[t][COUNT] += 1
            else:
                node[t] = {COUNT: 1, EVENT: -1}
            node = node[t]
        node[EVENT] = k

    def _added_again(self, signature: list[str], k: int) -> bool:
        """What removing a signature and adding it again does: nodes of its own lose what ended there before. Whether that changed the tree."""
        node, changed = self.tree, False
        for t in signature:
            if node[EVENT] != -1 and node[COUNT] == 1:
                node[EVENT], changed = -1, True
            node = node[t]
        changed |= node[EVENT] != k
        node[EVENT] = k
        return changed

    def end(self) -> list[tuple[int, str, list[str]]]:
        return [(k, " ".join(t), t) for k, t in self.signatures.items()]


# ---- running them -------------------------------------------------------------------------------

_OUT = "log_id long, ord long, a string, b string, c long, vars string, n long, text string, template array<string>, extra array<double>"
_ARROW = pa.schema([
    ("log_id", pa.int64()), ("ord", pa.int64()), ("a", pa.string()), ("b", pa.string()), ("c", pa.int64()), ("vars", pa.string()), ("n", pa.int64()),
    ("text", pa.string()), ("template", pa.list_(pa.string())), ("extra", pa.list_(pa.float64())),
])


def _prepared(logs: DataFrame, order: str, tokens: str, *more: Column) -> DataFrame:
    """``log_id, ord, tokens`` of rows with tokens; null messages take no part."""
    return logs.where(F.col(tokens).isNotNull() & (F.size(tokens) > 0)).select(F.col("log_id").cast("long").alias("log_id"), F.col(order).cast("long").alias("ord"), F.col(tokens).alias("tokens"), *more)


class Machine:
    """A miner over one group: ``step`` places a message, ``end`` gives what the group's templates are.

    Subclass it and give it to ``mined`` to run another miner the same way. ``step`` returns the cluster
    ``(b, c)``, a text kept beside the message, and a template to report at once (or None); ``end`` gives
    ``(b, c, text, template, extra)`` of every cluster.
    """

    def step(self, tokens: list[str], key: str) -> tuple[str, int, str | None, list[str] | None]:
        raise NotImplementedError

    def end(self) -> list[tuple[str, int, str | None, list[str], list[float] | None]]:
        raise NotImplementedError


class Plain(Machine):
    """A state whose ``step`` gives a cluster number and whose ``end`` gives numbers, texts and templates."""

    def __init__(self, state: object, key: str = "") -> None:
        self.state, self.key = state, key

    def step(self, tokens: list[str], key: str) -> tuple[str, int, str | None, list[str] | None]:
        return self.key, self.state.step(tokens), None, None

    def end(self) -> list[tuple[str, int, str | None, list[str], list[float] | None]]:
        return [(self.key, k, text, template, None) for k, text, template in self.state.end()]


def mined(rows: DataFrame, keys: list[str], make: Callable[..., Machine], key: str | None = None) -> DataFrame:
    """Run a machine per group of ``keys``: one row per message (``n`` null) and one per cluster (``log_id`` null).

    ``rows`` has ``log_id, ord, tokens``, the keys and, if named, the column whose values ``step`` gets. Groups lie sorted in their partitions and go through their
    machine batch by batch, so a task holds the machine's state, never a group. Messages come out as ids and
    cluster numbers; their tokens are not written again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, machine = None, None
        met: dict[tuple[str, int], list[int]] = {}

        def closed() -> list[tuple]:
            if machine is None:
                return []
            return [(None, met[b, c][0], str(group[0]), b, c, None, met[b, c][1], text, template, extra) for b, c, text, template, extra in machine.end() if (b, c) in met]

        for batch in batches:
            out = []
            columns = [_values(batch.column(batch.schema.get_field_index(c))) for c in ("log_id", "ord", "tokens", key or keys[-1], *keys)]
            for log_id, ordinal, tokens, named, *own in zip(*columns, strict=True):
                if own != group:
                    out += closed()
                    group, machine, met = own, make(*own), {}
                b, c, variables, template = machine.step(tokens, named)
                cell = met.setdefault((b, c), [ordinal, 0])
                cell[1] += 1
                out.append((log_id, ordinal, str(own[0]), b, c, variables, None, None, template, None))
            if out:
                yield _batch(out)
        if out := closed():
            yield _batch(out)

    placed = rows.select("log_id", "ord", "tokens", *dict.fromkeys([*keys, *([key] if key else [])])).repartition(*keys).sortWithinPartitions(*keys, "ord", "log_id")
    return staged(placed.mapInArrow(run, _OUT), "mined")


def _values(column: pa.Array) -> list:
    """``to_pylist``, many times faster for lists of strings."""
    if not pa.types.is_list(column.type) or column.null_count:
        return column.to_pylist()
    flat, ends = column.flatten().to_numpy(zero_copy_only=False).tolist(), (column.offsets.to_numpy() - column.offsets[0].as_py()).tolist()
    return [flat[i:j] for i, j in zip(ends, ends[1:])]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def _parted(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    return found.where("log_id is not null"), found.where("log_id is null")


def _numbered(assigned: DataFrame, clusters: DataFrame, by: list[str], same_text: bool) -> Mined:
    """Number clusters ``a, b, c, ord, text, n`` by ``by``; clusters of one text are one event, if ``same_text``.

    Templates, not messages, are numbered, and once.
    """
    first = clusters.withColumns({"_a": F.min("ord").over(W.partitionBy("a")), "_b": F.min("ord").over(W.partitionBy("a", "b"))})
    key = F.struct(*by)
    if same_text:
        texts = first.groupBy("text").agg(F.min(key).alias("_k"), F.sum("n").alias("n"))
        events = positions(texts.select("text", "n", *[F.col(f"_k.{c}").alias(c) for c in by]), *by, name="event").select("text", "n", (F.col("event") + 1).cast("long").alias("event"))
        ranked = first.join(events.select("text", "event"), "text")
        templates = events.select("event", F.col("text").alias("template"), "n")
    else:
        ranked = positions(first, *by, name="event").withColumn("event", (F.col("event") + 1).cast("long"))
        templates = ranked.select("event", F.col("text").alias("template"), "n")
    return Mined(assigned.join(ranked.select("a", "b", "c", "event"), ["a", "b", "c"]).select("log_id", "event"), templates)


_BUCKET_ORDER = ["_a", "_b", "c"]


def _keyed(logs: DataFrame, order: str, tokens: str, fallback: str) -> DataFrame:
    key = key_layer(F.col(tokens), fallback)
    return _prepared(logs, order, tokens, key["pos"].alias("pos"), key["key"].alias("key"))


def mine_bsg(logs: DataFrame, order: str = "log_id", tokens: str = "tokens", full: float = 0.7, few: int = 20, compat: bool = True) -> Mined:
    """Signature buckets with entropy; groups (pos, key) are independent."""
    found = mined(_keyed(logs, order, tokens, ""), ["pos", "key"], lambda pos, key: Plain(EntropyBucket(full, few, compat), key))
    return _numbered(*_parted(found), _BUCKET_ORDER, same_text=True)


class Gini(Machine):
    """First-fit buckets of one pos."""

    def __init__(self, full: float, few: int, compat: bool) -> None:
        self.state = GiniBuckets(full, few, compat)

    def step(self, tokens: list[str], key: str) -> tuple[str, int, str | None, list[str] | None]:
        k = self.state.step(key, tokens)
        variables = self.state.variables(key, k, tokens)
        return key, k, json.dumps(variables) if variables else None, None

    def end(self) -> list[tuple[str, int, str | None, list[str], list[float] | None]]:
        # the positions' counts go out as text: the split needs the number of all messages, which no group knows
        return [
            (key, k, json.dumps([c["n"], c["first"], [list(x.items()) if t == ANY and len(x) < self.state.few else None for t, x in zip(c["template"], c["seen"], strict=True)]]), c["template"], [c["nc"], c["st"]])
            for key, clusters in self.state.keys.items() for k, c in enumerate(clusters)
        ]


def _gini(logs: DataFrame, order: str, tokens: str, full: float, few: int, most: float, compat: bool) -> tuple[DataFrame, DataFrame]:
    """Messages and refined clusters; ``c`` is a cluster's ordinal among its key's, those that were split counted by word."""
    assigned, clusters = _parted(mined(_keyed(logs, order, tokens, ANY), ["pos"], lambda pos: Gini(full, few, compat), key="key"))
    total = clusters.agg(F.sum("n")).first()[0] or 0

    def refined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at_key, ordinal = None, 0
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if (r.a, r.b) != at_key:
                    at_key, ordinal = (r.a, r.b), 0
                n, first, seen = json.loads(r.text)
                template = list(r.template)
                at = split_position(n, template, seen, total, most, compat)
                for word, count in seen[at] if at >= 0 else [(None, n)]:
                    split = template if word is None else [*template[:at], word, *template[at + 1 :]]
                    extra = list(r.extra) if word is None else [len(split) + 1.0, 0.0]
                    out.append((r.a, r.b, r.c, at, first[at] if at >= 0 else None, word, ordinal, r.ord, count, collapsed(split), split, extra))
                    ordinal += 1
            yield pd.DataFrame(out, columns=["a", "b", "k", "at", "first", "word", "c", "ord", "n", "text", "template", "extra"])

    schema = "a string, b string, k long, at int, first string, word string, c long, ord long, n long, text string, template array<string>, extra array<double>"
    # clusters, not messages, a key's in the order of their making
    final = staged(clusters.repartition("a", "b").sortWithinPartitions("a", "b", "c").mapInPandas(refined, schema), "refined")
    places = final.select("a", "b", "k", "at", "first").distinct()
    said = F.from_json("vars", "map<string,string>")[F.col("at").cast("string")]
    worded = assigned.withColumnRenamed("c", "k").join(places, ["a", "b", "k"]).withColumn("word", F.when(F.col("at") >= 0, F.coalesce(said, "first")))
    named = final.select("a", "b", "k", F.coalesce("word", F.lit("")).alias("_w"), "c")
    return worded.withColumn("_w", F.coalesce("word", F.lit(""))).join(named, ["a", "b", "k", "_w"]).select("log_id", "ord", "a", "b", "c"), final


def mine_bsgi(logs: DataFrame, order: str = "log_id", tokens: str = "tokens", full: float = 0.7, few: int = 20, most: float = 0.75, compat: bool = True) -> Mined:
    """Signature buckets with first fit, then one Gini refinement; groups are lengths and key positions."""
    return _numbered(*_gini(logs, order, tokens, full, few, most, compat), _BUCKET_ORDER, same_text=True)


def classify(train: DataFrame, messages: DataFrame, order: str = "log_id", tokens: str = "tokens", full: float = 0.7, few: int = 20, most: float = 0.75, compat: bool = True) -> DataFrame:
    """``log_id, event, template``: event of each message by the templates mined from ``train``; -1 and '' for none.

    Quirk (``compat``): messages whose both ends are unclean are looked up under another key than they
    were trained under and so never found. Templates join on (pos, key); the earliest that accepts wins.
    Messages of the same tokens are looked up once.
    """
    assigned, final = _gini(train, order, tokens, full, few, most, compat)
    events = _numbered(assigned, final, _BUCKET_ORDER, same_text=True).templates.withColumnRenamed("template", "text")
    known = final.select(F.col("a").cast("int").alias("pos"), F.col("b").alias("key"), "c", F.col("template").alias("t"), F.col("extra").alias("x"), "text").join(events.select("event", "text"), "text")
    asked = _keyed(messages, order, tokens, "" if compat else ANY).select("log_id", "pos", "key", F.array_join("tokens", "\u0001").alias("_said"))
    once = asked.select("pos", "key", "_said").distinct().withColumn("tokens", F.split("_said", "\u0001", -1))
    differ = F.size(F.filter(F.zip_with("tokens", "t", lambda a, b: a != b), lambda x: x))
    fits = differ <= F.ceil((1 - F.col("x")[1]) * F.col("x")[0])
    hits = once.join(known, ["pos", "key"]).where(fits).groupBy("pos", "key", "_said").agg(F.min_by(F.struct("event", "text"), "c").alias("_hit"))
    placed = asked.join(hits, ["pos", "key", "_said"]).select("log_id", "_hit")
    return messages.select("log_id").join(placed, "log_id", "left").select("log_id", F.coalesce("_hit.event", F.lit(-1)).cast("long").alias("event"), F.coalesce("_hit.text", F.lit("")).alias("template"))


def mine_drain(logs: DataFrame, order: str = "log_id", tokens: str = "tokens", depth: int = 3, least: float = 0.5, children: int = 10, compat: bool = True) -> Mined:
    """Fixed-depth tree; lengths are independent. Templates aren't merged by text."""
    rows = _prepared(logs, order, tokens, F.size(tokens).alias("len"))
    return _numbered(*_parted(mined(rows, ["len"], lambda n: Plain(FixedTree(depth, children, least, compat)))), ["ord"], same_text=False)


class Pointer(Machine):
    """A pointer tree, which reports templates when they change."""

    def __init__(self, children: int, compat: bool) -> None:
        self.state = PointerTree(children, compat)

    def step(self, tokens: list[str], key: str) -> tuple[str, int, str | None, list[str] | None]:
        k, new = self.state.step(tokens)
        return "", k, None, self.state.clusters[k]["template"] if new else None

    def end(self) -> list[tuple[str, int, str | None, list[str], list[float] | None]]:
        return [("", k, None, c["template"], None) for k, c in enumerate(self.state.clusters)]


def mine_draga(logs: DataFrame, order: str = "log_id", tokens: str = "tokens", children: int = 120, threshold: float = 0.9, compat: bool = True) -> Mined:
    """Pointer trees per length, then one replay of the changes of templates that merges output cells.

    The replay sees one row per new or changed template, not per message. A cell's template text lists
    its clusters' templates, one a line.
    """
    rows = _prepared(logs, order, tokens, F.size(tokens).alias("len"))
    assigned, clusters = _parted(mined(rows, ["len"], lambda n: Pointer(children, compat)))

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord", kind="stable")
        names = list(zip(pdf["a"], pdf["c"], strict=True))
        number = {x: k for k, x in enumerate(dict.fromkeys(names))}
        changes = [(o, number[x], list(t)) for o, x, t in zip(pdf["ord"], names, pdf["template"], strict=True)]
        cell, last = cells(changes, threshold), {c: t for _, c, t in changes}
        texts: dict[int, list[str]] = {}
        for c in sorted(cell):
            texts.setdefault(cell[c], []).append(" ".join(last[c]))
        return pd.DataFrame([(a, c, cell[k], "\n".join(texts[cell[k]])) for (a, c), k in number.items()], columns=["a", "c", "cell", "text"])

    changed = assigned.where("template is not null").select("ord", "a", "c", "template")
    replayed = staged(changed.groupBy(F.lit(0).alias("_one")).applyInPandas(lambda p: replay(p), "a string, c long, cell long, text string"), "cells")
    into = assigned.select("log_id", "a", "c").join(replayed, ["a", "c"]).select("log_id", F.lit("").alias("a"), F.lit("").alias("b"), F.col("cell").alias("c"))
    sizes = clusters.select("a", "c", "ord", "n").join(replayed, ["a", "c"]).groupBy(F.col("cell").alias("c")).agg(F.min("ord").alias("ord"), F.sum("n").alias("n"), F.first("text").alias("text"))
    return _numbered(into, sizes.withColumns({"a": F.lit(""), "b": F.lit("")}), ["c"], same_text=False)


def mine_spell(logs: DataFrame, order: str = "log_id", tokens: str = "tokens", threshold: float = 0.5, partition_by: str | None = None, compat: bool = True) -> Mined:
    """Longest common subsequences over all messages.

    Any signature may match any message, so the exact result needs one task; ``partition_by`` names a
    column whose groups are mined separately instead, which is not the same result.
    """
    rows = _prepared(logs, order, tokens, (F.col(partition_by) if partition_by else F.lit(0)).alias("part"))
    return _numbered(*_parted(mined(rows, ["part"], lambda part: Plain(Signatures(threshold, compat)))), ["ord"], same_text=False)


# ---- first fit by length ------------------------------------------------------------------------


class FirstFit:
    """Templates of one length: the first that keeps enough constants takes the message."""

    def __init__(self, threshold: float) -> None:
        self.threshold, self.templates, self.known = threshold, [], Known()

    def step(self, tokens: list[str]) -> int:
        if (k := self.known.get(tokens)) is not None:
            return k
        for k, t in enumerate(self.templates):
            new = merged(t, tokens)
            if 1 - new.count(ANY) / len(tokens) >= self.threshold:
                self.templates[k] = new
                return self.known.put(tokens, k) if new == t else self.known.clear(k)
        self.templates.append(tokens)
        return self.known.clear(len(self.templates) - 1)

    def end(self) -> list[tuple[int, str, list[str]]]:
        return [(k, constants_text(t), t) for k, t in enumerate(self.templates)]


def constants_text(template: list[str]) -> str:
    """The template without ``*``, wherever it stands."""
    return " ".join(" ".join(template).replace(ANY, "").split())


def term_pairs(template: list[str]) -> tuple:
    """Ordered pairs of the lower-case constants, repeats numbered; the one constant itself if there is but one."""
    words, seen = constants_text(template).lower().split(), Counter()
    for i, w in enumerate(words):
        words[i] = f"{w}__{seen[w]}" if seen[w] else w
        seen[w] += 1
    return tuple((a, b) for i, a in enumerate(words) for b in words[i + 1 :]) if len(words) > 1 else tuple(words)


def mine_first_fit(logs: DataFrame, order: str = "log_id", words: str = "words", threshold: float = 0.5) -> Mined:
    """First fit per length; templates equal without ``*`` are one. Messages without words get no event."""
    rows = _prepared(logs, order, words, F.size(words).alias("len"))
    return _numbered(*_parted(mined(rows, ["len"], lambda n: Plain(FirstFit(threshold)))), ["_a", "c"], same_text=True)


def first_fit_sweep(logs: DataFrame, order: str = "log_id", words: str = "words", thresholds: tuple[float, ...] = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)) -> DataFrame:
    """``threshold, compactness, distance, quality, best``: mining quality of each threshold; of equal ones the larger is best.

    quality = mean share of constants times the square of the templates' mean least distance. Templates are
    joined on the pairs of terms they share; those that share none are at distance 1.
    """
    rows = _prepared(logs, order, words, F.size(words).alias("len"), F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    found = _parted(mined(rows, ["threshold", "len"], lambda t, n: Plain(FirstFit(t))))[1].select(F.col("a").cast("double").alias("threshold"), "template")

    def termed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            templates = [list(t) for t in batch["template"]]
            yield pd.DataFrame({
                "threshold": batch["threshold"], "len": [len(t) for t in templates], "text": [constants_text(t) for t in templates],
                "kept": [1 - t.count(ANY) / len(t) for t in templates], "template": templates, "terms": [[json.dumps(x) for x in term_pairs(t)] for t in templates],
            })

    schema = "threshold double, len int, text string, kept double, template array<string>, terms array<string>"
    named = found.mapInPandas(termed, schema).where("text <> ''").withColumn("low", F.lower("text"))
    # texts that differ in case only are one, by their first template; of texts with the same terms the first stands for all
    texts = named.groupBy("threshold", "low").agg(F.min(F.struct("len", "template", "terms")).alias("f"), F.sum("kept").alias("kept"), F.count("*").alias("n"))
    groups = texts.groupBy("threshold", F.col("f.terms").alias("terms")).agg(F.min(F.struct("f", "kept", "n", "low")).alias("g"))
    kept = staged(groups.select("threshold", "terms", F.col("g.kept").alias("kept"), F.col("g.n").alias("n"), F.col("g.low").alias("low")), "groups")
    terms = kept.select("threshold", "low", F.size(F.array_distinct("terms")).alias("size"), F.explode(F.array_distinct("terms")).alias("term"))
    other = terms.select("threshold", "term", F.col("low").alias("other"), F.col("size").alias("size2"))
    shared = terms.join(other, ["threshold", "term"]).where("low <> other").groupBy("threshold", "low", "other", "size", "size2").agg(F.count("*").alias("c"))
    least = shared.groupBy("threshold", "low").agg(F.min(1 - F.col("c") / (F.col("size") + F.col("size2") - F.col("c"))).alias("d"))
    scored = kept.join(least, ["threshold", "low"], "left").groupBy("threshold").agg((F.sum("kept") / F.sum("n")).alias("compactness"), F.avg(F.coalesce("d", F.lit(1.0))).alias("distance"))
    scored = scored.withColumn("quality", F.col("compactness") * F.col("distance") ** 2)
    return scored.withColumn("best", F.row_number().over(W.orderBy(F.desc("quality"), F.desc("threshold"))) == 1)
