"""Problem 3: log text of several programs into entries and fields, by mining header layouts with longest common subsequences."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.functions.instants import LEVELS
from logloom.operators.miners import Shares

_SPELLED = {w: name for name, words in LEVELS.items() for w in words}
_LEVEL = "(?:" + "|".join(sorted((w for w in _SPELLED if len(w) > 2), key=len, reverse=True)) + ")"
_ZONE = r"(?:Z|\s?[+-]\d{2}:?\d{2})"
_CLOCK = r"\d{1,2}:\d{2}:\d{2}(?:[.,]\d+)?"
_MODULE = r"[A-Za-z][\w-]*(?:\.[A-Za-z][\w-]*)+"
#: Slot types: how a typed token looks, and what the formalizer leaves of it when it removes stamps.
TYPES = {
    "day": rf"[TDIWEFC]\d{{4}} {_CLOCK}",
    "stamp": rf"(?:\d{{4}}[-/]\d{{2}}[-/]\d{{2}}[T ]{_CLOCK}{_ZONE}?|[A-Z][a-z]{{2}} {{1,2}}\d{{1,2}} {_CLOCK})",
    "request": r"(?:req[-_])?[0-9A-Fa-f]{8}-?[0-9A-Fa-f]{4}-?[0-9A-Fa-f]{4}-?[0-9A-Fa-f]{4}-?[0-9A-Fa-f]{12}(?![0-9A-Fa-f])",
    "module": _MODULE,
    "level": rf"(?i:{_LEVEL})(?![\w-])",
    "num": r"\d+",
}
_STRIPPED = {"day": rf"[TDIWEFC](?:\d{{4}} {_CLOCK})?", "stamp": rf"(?:[A-Z][a-z]{{2}} {{1,2}}\d{{1,2}} {_CLOCK}|(?:\d{{4}}[-/]\d{{2}}[-/]\d{{2}}[T ]{_CLOCK})?{_ZONE}?)"}
_TOKEN = re.compile("|".join(f"(?P<{k}>{v})" for k, v in TYPES.items()) + r"|(?P<text>\"[^\"\\]*(?:\\.[^\"\\]*)*\")|(?P<word>\w+)|(?P<gap>\s+)|(?P<mark>.)")
_REQUEST = re.compile(r"(?<![0-9A-Za-z-])(?:req[-_]|\w*id[=:]\s?\{?)?\{?([0-9A-Fa-f]{8})-?([0-9A-Fa-f]{4})-?([0-9A-Fa-f]{4})-?([0-9A-Fa-f]{4})-?([0-9A-Fa-f]{12})(?![0-9A-Fa-f])", re.IGNORECASE)
ANY = "*"


def tokens(line: str) -> list[str]:
    """Typed tokens as ``<type>``, blanks as one blank, quoted free text as ``" * "``, all else as it is."""
    out = []
    for hit in _TOKEN.finditer(line):
        kind, text = hit.lastgroup, hit[0]
        if kind == "text":
            inner = text[1:-1]
            if re.search(r"\S\s+\S", inner) and not re.fullmatch(TYPES["stamp"], inner):
                out += ['"', ANY, '"']
            else:
                out += ['"', *tokens(inner), '"']
        else:
            out.append(f"<{kind}>" if kind in TYPES else " " if kind == "gap" else text)
    return out


def _ends(seq: list[str]) -> tuple[tuple[str, ...], int] | None:
    """Kind of a line by how it starts and the order of its header's slots, and where the header ends; None if it has no header.

    Words that stand before or between the slots are no part of the kind: whether they belong to a layout is
    for the common subsequence of many headers to say.
    """
    at = {k: seq.index(k) for k in ("<day>", "<stamp>", "<level>", "<module>") if k in seq}
    if "<module>" not in at or len(at) < 2:
        return None
    if "<day>" in at:
        at = {k: at[k] for k in ("<day>", "<module>")}
    end = max(at.values())
    lead = "word" if seq[0][:1].isalnum() or seq[0] == ANY else seq[0]
    return (lead, "/", *sorted(at, key=at.__getitem__), seq[end]), end


def common(a: list[str], b: list[str]) -> list[str]:
    """Longest common subsequence of two templates; what lies between its tokens in either becomes one ``*``."""
    x, y = [t for t in a if t != ANY], [t for t in b if t != ANY]
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
    loose = [{len([t for t in s[:k] if t != ANY]) for k, t in enumerate(s) if t == ANY} for s in (a, b)]
    out, i, j, skipped = [], 0, 0, False
    while i < len(x) and j < len(y):
        if x[i] == y[j] and best[i][j] == best[i + 1][j + 1] + 1:
            if skipped or i in loose[0] or j in loose[1]:
                out.append(ANY)
            out.append(x[i])
            i, j, skipped = i + 1, j + 1, False
        elif best[i + 1][j] >= best[i][j + 1]:
            i, skipped = i + 1, True
        else:
            j, skipped = j + 1, True
    if skipped or i < len(x) or j < len(y) or len(x) in loose[0] or len(y) in loose[1]:
        out.append(ANY)
    return out


def pattern(template: list[str], stripped: bool = False) -> str:
    """Regular expression of a header: constants as they are, slots by their type, the rest free.

    ``stripped``: as the formalizer leaves the header, without stamps and without bracketed parts.
    """
    seq = template
    if stripped:
        text = "\0".join(template)
        seq = re.sub(r"(?:^|\0)\[\0(?:(?!\]).)*\]", "", text, flags=re.DOTALL).split("\0")
        seq = [x for x in seq if x]
    out, seen = [], set()
    for t in seq:
        kind = t[1:-1]
        if t == ANY:
            out.append(".*?" if "text" in seen else "(?P<text>.*?)")
            seen.add("text")
        elif t == " ":
            out.append(r"\s+")
        elif t[:1] == "<" and kind in TYPES:
            body = _STRIPPED.get(kind, TYPES[kind]) if stripped else TYPES[kind]
            out.append(f"(?P<{kind}>{body})" if kind not in seen and kind != "num" else f"(?:{body})")
            seen.add(kind)
        else:
            out.append(re.escape(t))
    return "".join(out)


def _header(seq: list[str], end: int) -> list[str]:
    """The header with the marks that close its last slot."""
    stop = end + 1
    while stop < len(seq) and seq[stop] in '])>}":;,|':
        stop += 1
    return seq[:stop]


def _sequences(text: str, lines: bool, layouts: Layouts) -> Iterator[tuple[tuple[str, ...], list[str], str]]:
    """Kind, header tokens and text of everything in a field that can be a header no layout reads so far."""
    for line in text.split("\n") if lines else ():
        line = line.strip()
        if not line or layouts.fits(line, False):
            continue
        seq = tokens(line)
        if found := _ends(seq):
            yield found[0], _header(seq, found[1]), line
    if not lines and not layouts.fits(text := text.strip(), True):
        seq = tokens(text)
        at = seq.index("<module>") if "<module>" in seq else -1
        if 0 <= at and all(t in ("<num>", " ", "(", "[", "<") for t in seq[:at]):
            stop = at + 1
            while stop < len(seq) and seq[stop] in ("<num>", " ", ":", ")", "]", "-"):
                stop += 1
            head = seq[:stop]
            while head[-1] == " ":
                head.pop()
            yield ("start", *[x for x in head if x != " "]), head, text


#: Least share of the longer of two headers that they must have in common, in order, to be of one layout.
LIKENESS = 0.6
#: Layouts of one kind whose patterns a line is tried on, the best supported; a header that none reads is clustered by likeness
#: with all. Layouts of one kind that are listed although they aren't kept.
MOST_LAYOUTS = 64
#: Fields of 100,000 that must have a layout's header, and the least number of them whatever there are.
SUPPORT = 1
LEAST_SUPPORT = 2


class Layouts:
    """Header templates by kind, each the common subsequence of all headers of its cluster so far. None is ever dropped."""

    def __init__(self) -> None:
        #: Per kind its clusters ``[template, support, example]``.
        self.found: dict[tuple[str, ...], list[list]] = {}
        #: Per kind the constants of its clusters, to look only at those that are like enough.
        self.shares: dict[tuple[str, ...], Shares] = {}
        #: Per kind its best supported clusters with their patterns.
        self.tried: dict[tuple[str, ...], list[list]] = {}

    def fits(self, text: str, start: bool) -> bool:
        """Count a header that one of the best supported templates found so far reads already."""
        for kind, tried in self.tried.items():
            if (kind[0] == "start") == start:
                for slot in tried:
                    cell, template, read = slot
                    if template is not cell[0]:  # it has changed
                        template, read = slot[1:] = cell[0], _read(cell[0])
                    if read is not None and read.match(text):
                        cell[1] += 1
                        return True
        return False

    def add(self, kind: tuple[str, ...], seq: list[str], example: str, n: int = 1) -> None:
        """Count a header in the cluster it is most like, or in one of its own."""
        cells, shares = self.found.setdefault(kind, []), self.shares.setdefault(kind, Shares())
        best, like = None, LIKENESS
        constants = _constants(seq)
        # a template in common can't be longer than the constants in common, in any order
        least = lambda size: min(size, _needed(max(size, len(constants))))
        for k in shares.sharing(shares.counted(constants), least):
            cell = cells[k]
            shorter = common(cell[0], seq)
            kept = sum(t != ANY for t in shorter) / max(1, sum(t != ANY for t in cell[0]), len(constants))
            # what a template has lost to free text already can't count against a header
            kept = max(kept, 1.0 if shorter == cell[0] else 0.0)
            if kept > like or (kept == like and best is None):
                best, like = (k, shorter), kept
        if best is None:
            shares.put(len(cells), constants)
            cells.append([seq, n, example])
            tried = self.tried.setdefault(kind, [])
            if len(cells) <= MOST_LAYOUTS:
                tried.append([cells[-1], None, None])
            elif len(cells) % MOST_LAYOUTS == 0:
                known = {id(slot[0]): slot for slot in tried}
                self.tried[kind] = [known.get(id(c), [c, None, None]) for c in sorted(cells, key=lambda c: -c[1])[:MOST_LAYOUTS]]
            return
        k, shorter = best
        cell = cells[k]
        cell[1] += n
        cell[2] = min(cell[2], example, key=lambda x: (len(x), x))  # a short one says as much
        if shorter != cell[0]:
            cell[0] = shorter
            shares.put(k, _constants(shorter))

    def rows(self) -> list[tuple[str, str, int, str]]:
        return [(json.dumps(k), json.dumps(seq), n, example) for k, cells in sorted(self.found.items()) for seq, n, example in cells]


def _constants(template: list[str]) -> frozenset[tuple[str, int]]:
    """The tokens of a template but for free text, the repeats of a token numbered."""
    met: Counter[str] = Counter()
    out = set()
    for t in template:
        if t != ANY:
            out.add((t, met[t]))
            met[t] += 1
    return frozenset(out)


def _needed(size: int) -> int:
    """The least number of constants in common that is ``LIKENESS`` of ``size``."""
    n = int(LIKENESS * size)
    return n if n / max(1, size) >= LIKENESS else n + 1


def _read(template: list[str]) -> re.Pattern | None:
    """Pattern of a template; none if it starts with free text, since nothing then marks where an entry starts."""
    return None if template[0] == ANY else re.compile(pattern(template))


def layout_support(fields: DataFrame) -> DataFrame:
    """``kind, template, n, example, kept``: every header layout found in all fields, with its support.

    Every partition clusters its headers by kind and likeness and reduces each cluster to its longest common
    subsequence; clusters of one kind are then merged over all partitions the same way. ``n`` counts headers. A
    layout is ``kept`` if at least ``SUPPORT`` fields of 100,000, and ``LEAST_SUPPORT`` at least, have it, and if
    its template starts with a constant or a slot: lines that merely mention a stamp and a dotted name share
    neither. Every header is counted in a cluster and no cluster is dropped, so support doesn't depend on the noise.
    Of the layouts of a kind that aren't kept, ``MOST_LAYOUTS`` at most are listed, the others as one row of free text.
    """

    def mine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        layouts, rows = Layouts(), 0
        for batch in batches:
            rows += len(batch)
            for text, lines in zip(batch["text"], batch["lines"], strict=True):
                for kind, seq, line in _sequences(text, lines, layouts):
                    layouts.add(kind, seq, line)
        yield pd.DataFrame([*layouts.rows(), ("", "", rows, "")], columns=["kind", "template", "n", "example"])

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        if not rows["kind"].iat[0]:
            return pd.DataFrame([("", "", int(rows["n"].sum()), "")], columns=["kind", "template", "n", "example"])
        layouts = Layouts()
        for kind, template, n, example in rows.sort_values(["n", "template", "example"], ascending=[False, True, True]).itertuples(index=False):
            layouts.add(tuple(json.loads(kind)), json.loads(template), example, n)
        return pd.DataFrame(layouts.rows(), columns=["kind", "template", "n", "example"])

    schema = "kind string, template string, n long, example string"
    found = fields.where("text is not null").select("text", "lines").mapInPandas(mine, schema).groupBy("kind").applyInPandas(merge, schema)
    # the row without kind holds the number of fields
    least = F.greatest(F.lit(LEAST_SUPPORT), F.ceil(F.max(F.when(F.col("kind") == "", F.col("n"))).over(W.partitionBy()) * SUPPORT / 100_000))
    anchored = ~F.col("template").startswith(json.dumps([ANY])[:-1])
    judged = found.withColumn("kept", (F.col("n") >= least) & anchored).where("kind <> ''")
    place = F.row_number().over(W.partitionBy("kind", "kept").orderBy(F.desc("n"), "template", "example"))
    template = F.when(F.col("kept") | (place < MOST_LAYOUTS), F.col("template")).otherwise(json.dumps([ANY]))
    listed = judged.withColumn("_at", F.when(F.col("kept") | (place < MOST_LAYOUTS), place).otherwise(MOST_LAYOUTS)).withColumn("template", template)
    return listed.groupBy("kind", "kept", "_at").agg(F.min("template").alias("template"), F.sum("n").alias("n"), F.min("example").alias("example")).select("kind", "template", "n", "example", "kept")


def mined_layouts(fields: DataFrame) -> list[tuple[list[str], bool]]:
    """Layouts ``(template, is_start)`` of the headers in all fields, the best supported first; see ``layout_support``.

    Only the few merged templates that are kept reach the driver. A template is left out if one with more
    support already reads its example: it is that layout with more in its free text.
    """
    kept: list[tuple[list[str], bool]] = []
    for r in sorted(layout_support(fields).where("kept").collect(), key=lambda r: (-r["n"], r["kind"], r["template"])):
        start = json.loads(r["kind"])[0] == "start"
        template = json.loads(r["template"])
        if "<module>" in template and not any(s == start and re.match(pattern(t), r["example"].strip()) for t, s in kept):
            kept.append((template, start))
    return kept


_LABEL = re.compile(r'\W*(?:msg|message)"?\s*[:=]\s*')


def _body(part: str, hit: re.Match | None, end: int) -> str:
    """The message of an entry: what follows the header, without its label and quotes."""
    rest = part[end:].strip()
    if hit and not rest.strip("\"'} ") and hit.groupdict().get("text"):
        return hit["text"]
    if label := _LABEL.match(rest):
        rest = rest[label.end() :]
        if rest[:1] == '"':
            rest = rest[1:].removesuffix("}").removesuffix('"')
    return rest


_COLUMNS = "log_source string, log_id long, entry_no long, stamp string, level string, component string, ms_id string, message string"


def request_id(text: str | None) -> str:
    """The first request id written in a text, as lower-case 8-4-4-4-12; '' if there is none."""
    hit = _REQUEST.search(text) if text else None
    return "-".join(hit.groups()).lower() if hit else ""


def _named(hit: re.Match | None) -> tuple[str, str, str]:
    if hit is None:
        return "", "", ""
    g = hit.groupdict()
    day = g.get("day")
    level = (g.get("level") or (day[0] if day else "") or "").upper()
    return g.get("stamp") or (day[1:] if day else "") or "", _SPELLED.get(level, ""), (g.get("module") or "").lower()


def entries(fields: DataFrame) -> DataFrame:
    """All entries of all fields: ``log_source, log_id, entry_no, stamp, level, component, ms_id, message``.

    ``fields`` has ``log_source, log_id, text, lines, level, ms_id``. ``lines``: further entries start at
    lines only, and headers are whole; otherwise they start after any blank, headers lack stamps and
    bracketed parts, and level and request id of the first entry are those given. Missing parts are ''.
    Null texts have no entries; an empty text is one entry without parts. Entries are numbered from 1 in
    their order; whatever has no header belongs to the entry before.
    """
    layouts = mined_layouts(fields)
    lined = [pattern(t) for t, start in layouts if not start]
    glued = [p for t, start in layouts if not start and "(?P<module>" in (p := pattern(t, stripped=True)) and re.search(r"\(\?P<(?:level|day)>", p)]
    starts = [pattern(t) for t, start in layouts if start]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at_line, at_start = [re.compile(p) for p in lined], [re.compile(r"\s*" + p) for p in starts]
        within = [re.compile(r"(?<!\S)" + p) for p in glued]
        module = re.compile(_MODULE)

        def first(known: list[re.Pattern], text: str, pos: int = 0) -> re.Match | None:
            return next((hit for p in known if (hit := p.match(text, pos))), None)

        def split_lines(text: str) -> Iterator[tuple[str, re.Match | None, int]]:
            start, hit, pos = 0, first(at_line, text, len(text) - len(text.lstrip())), 0
            while (pos := text.find("\n", pos) + 1) > 0:
                if pos < len(text) and (other := first(at_line, text, pos)):
                    yield text[start:pos].strip(), hit, hit.end() - start if hit else 0
                    start, hit = pos, other
            yield text[start:].strip(), hit, hit.end() - start if hit else 0

        def split_glued(text: str) -> Iterator[tuple[str, re.Match | None, int]]:
            hit = first(at_start, text)
            marks = []
            if module.search(text, hit.end() if hit else 0):
                found = sorted((m.start(), -m.end(), k, m) for k, p in enumerate(within) for m in p.finditer(text) if m.start() > 0)
                edge = hit.end() if hit else 0
                for _, _, _, m in found:
                    if m.start() >= edge:
                        marks.append(m)
                        edge = m.end()
            for a, b in zip([None, *marks], [*marks, None], strict=True):
                start = a.start() if a else 0
                own = a or hit
                yield text[start : b.start() if b else len(text)].strip(), own, own.end() - start if own else 0

        for batch in batches:
            out = []
            for source, log_id, text, lines, level, ms_id in batch[["log_source", "log_id", "text", "lines", "level", "ms_id"]].itertuples(index=False):
                for no, (part, hit, end) in enumerate(split_lines(text) if lines else split_glued(text), 1):
                    stamp, named, component = _named(hit)
                    given = no == 1 and not lines
                    if given:
                        named = _SPELLED.get(level.strip().upper(), "") if level else ""
                    request = (request_id(ms_id) if given else "") or request_id(part)
                    out.append((source, log_id, no, stamp, named, component, request, _body(part, hit, end)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _COLUMNS.split(", ")])

    return fields.where("text is not null").select("log_source", "log_id", "text", "lines", "level", "ms_id").mapInPandas(read, _COLUMNS)
