"""Problem 10: subject areas of documents, by calibrated classifier chains decoded with beam search."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.mix import source_name
from logloom.session import staged

#: Labelled documents whose labels lexicon and chain are fitted on at most, by hash of the id.
MAX_TRAINING = 20_000
#: Words that make a block of text a paragraph.
MIN_WORDS = 6
#: Share of the paragraphs that makes a subject one of the document.
MIN_SHARE = 0.25
#: Least documents of a term with one and the same subject, as a number and as a share of all that are counted, and their
#: least share of all its documents (two more being taken to be of other subjects): while documents count for all their
#: labels, once paragraphs count for one, and over all documents. The share bounds the lexicon, which is broadcast, by the
#: terms of a document over the share, whatever the number of documents.
TELLING = [(2, 1e-3, 0.4), (2, 1e-3, 0.4), (3, 3e-4, 0.5)]
#: By how much a paragraph's best subject must lead to count where its document has no labels.
LEAD = 1.0
#: Counted terms after which a task hands on its counts.
FLUSH = 300_000
BEAM = 8

_BODY = re.compile(r"\\begin\s*\{document\}")
_CUTS = [
    re.compile(r"\\begin\s*\{comment\}.*?(?:\\end\s*\{comment\}|\Z)", re.DOTALL),
    re.compile(r"\\iffalse\b.*?(?:\\fi\b|\Z)", re.DOTALL),
    re.compile(r"%(?<!\\%).*"),
    re.compile(r"\\end\s*\{document\}.*", re.DOTALL),
    re.compile(r"\\begin\s*\{thebib.*?(?:\\end\s*\{thebibliography\}|\Z)", re.DOTALL),
    re.compile(r"\\begin\s*\{(equation|align|figure|table|eqnarray|gather|tikzpicture|verbatim)\*?\}.*?(?:\\end\s*\{\1\*?\}|\Z)", re.DOTALL),
    re.compile(r"\$\$.*?\$\$|\\\[.*?\\\]", re.DOTALL),
]
_MACRO = re.compile(r"\\(?:re)?(?:new|provide)command\*?\s*\{?\\([A-Za-z]+)\}?\s*\{([^{}\\$]*)\}|\\def\s*\\([A-Za-z]+)\s*\{([^{}\\$]*)\}")
_DEFINITION = re.compile(r"\\(?:re)?(?:new|provide)command\b.*|\\(?:def|let|DeclareMathOperator|newenvironment)\b.*")
_LINE = re.compile(r"\s*\\(?:(?:sub)*section|chapter|part|title|author|date|maketitle|bibliographystyle|bibliography|input|include|subfile|includegraphics|documentclass|usepackage)\b.*")
_NOISE = re.compile(r"\$[^$]*\$|\\\(.*?\\\)|\\(?:cite\w*|ref|eqref|label|pageref|url|includegraphics)\s*(?:\[[^\]]*\])?\{[^}]*\}|\\(?:begin|end)\s*\{[^}]*\}|\\[A-Za-z]+\*?|~@?c?", re.DOTALL)
_WORD = re.compile(r"[^\W\d_]+")
_ASCII_WORD = re.compile(r"[a-z]+")
_MOJIBAKE = re.compile("[\u00c2-\u00c5][\u0080-\u00bf]")
_BLANK = re.compile(r"\n[ \t]*\n")


def _repaired(hit: re.Match) -> str:
    try:
        return hit[0].encode("latin-1").decode("utf-8")
    except UnicodeError:
        return hit[0]


def paragraphs(text: str) -> list[list[str]]:
    """Words of each paragraph of a LaTeX document's visible body.

    Comments, commented-out and skipped parts, preamble, bibliography, headings, displays and figures
    don't count; macros that stand for plain words are expanded. Words are lower case, without a plural s.
    The whole text is read.
    """
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _MOJIBAKE.sub(_repaired, text).replace("\u00ad", "").replace("\u200b", "").replace("\ufeff", ""))
    macros = {(m[1] or m[3]): (m[2] if m[1] else m[4]) for m in _MACRO.finditer(text)}
    macros = {k: v for k, v in macros.items() if _WORD.search(v)}
    if start := _BODY.search(text):
        text = text[start.end() :]
    for cut in _CUTS:
        text = cut.sub(" ", text)
    if macros:
        names = "|".join(sorted(macros, key=len, reverse=True))
        text = re.sub(rf"\\({names})(?![A-Za-z])(?:\{{\}})?", lambda m: macros[m[1]], text)
    lines = ["" if "\\" in x and (_LINE.match(x) or _DEFINITION.match(x)) else x for x in text.split("\n")]
    out = []
    for block in _BLANK.split("\n".join(lines)):
        block = _NOISE.sub(" ", block).lower()
        found = (_ASCII_WORD if block.isascii() else _WORD).findall(block)  # the same words, the first faster
        words = [w[:-1] if w[-1] == "s" and len(w) > 4 and w[-2] != "s" else w for w in found]
        if len(words) >= MIN_WORDS:
            out.append(words)
    return out


def terms_of(words: list[str]) -> set[str]:
    """Words and neighbouring pairs of a paragraph."""
    return {*words, *map(" ".join, zip(words, words[1:], strict=False))}


@dataclass
class Lexicon:
    """Terms with their evidence for each subject (log of how much more often they occur with it)."""

    subjects: list[str]
    words: dict[str, int] = field(default_factory=dict)
    pairs: dict[str, dict[str, int]] = field(default_factory=dict)
    evidence: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    @classmethod
    def of(cls, subjects: list[str], terms: list[str], evidence: np.ndarray) -> Lexicon:
        """A lexicon of terms in the order of the evidence's rows."""
        out = cls(subjects, evidence=evidence)
        for i, t in enumerate(terms):
            first, _, second = t.partition(" ")
            if second:
                out.pairs.setdefault(first, {})[second] = i
            else:
                out.words[t] = i
        return out

    def shares(self, paras: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Share of the paragraphs whose best subject it is, and mean posterior, by subject."""
        k = len(self.subjects)
        _, scores = self.scores(paras)
        if not len(scores):
            return np.zeros(k), np.zeros(k)
        p = np.exp(scores - scores.max(axis=1, keepdims=True))
        mean = (p / p.sum(axis=1, keepdims=True)).sum(axis=0)
        return np.bincount(scores.argmax(axis=1), minlength=k) / len(paras), mean / len(paras)

    def scores(self, paras: list[list[str]]) -> tuple[list[int], np.ndarray]:
        """Numbers of the paragraphs that have terms of the lexicon, and the summed evidence of each."""
        rows = [(i, at) for i, words in enumerate(paras) if (at := self.rows_of(words))]
        if not rows:
            return [], np.zeros((0, len(self.subjects)))
        starts = np.cumsum([0, *(len(at) for _, at in rows[:-1])])
        return [i for i, _ in rows], np.add.reduceat(self.evidence[[r for _, at in rows for r in at]], starts, axis=0)

    def rows_of(self, words: list[str]) -> list[int]:
        """Rows of a paragraph's terms, each once, in order."""
        known, pairs = self.words, self.pairs
        at = {known[w] for w in words if w in known}
        at.update([pairs[a][b] for a, b in zip(words, words[1:], strict=False) if a in pairs and b in pairs[a]])
        return sorted(at)


def _lexicon(training: DataFrame, subjects: list[str], known: Lexicon | None, level: int) -> Lexicon:
    """Lexicon from training documents.

    Without a lexicon known, a document counts for all its labels. With one, each paragraph counts for its
    best subject, if that is one of the document's labels or the document has none and the lead is clear.
    """
    number, part, share = TELLING[level]

    def into(labels: list[int] | None, paras: list[list[str]]) -> list[list[int]]:
        out = [list(labels) if labels is not None else []] * len(paras)
        at, scores = known.scores(paras) if known is not None else ([], None)
        if not at:
            return out
        best = scores.argmax(axis=1)
        if labels is not None and level < 2:
            fits = np.isin(best, labels)
        elif scores.shape[1] > 1:
            top = np.partition(scores, -2, axis=1)
            fits = top[:, -1] - top[:, -2] >= LEAD
        else:
            fits = np.ones(len(at), bool)
        for i, s in zip(at, np.where(fits, best, -1).tolist(), strict=True):
            out[i] = [s]
        return out

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[int, Counter] = {}

        def handed() -> pd.DataFrame:
            out = pd.DataFrame([(t, s, n) for s, own in counts.items() for t, n in own.items()], columns=["term", "s", "n"])
            counts.clear()
            return out

        for batch in batches:
            for words, labels in zip(batch["words"], batch["labels"], strict=True):
                seen: dict[int, set[str]] = {}
                paras = unpacked(words)
                for words, own in zip(paras, into(labels, paras), strict=True):
                    for s in own:
                        seen.setdefault(s, set()).update(terms_of(words))
                for s, terms in seen.items():
                    counts.setdefault(s, Counter()).update(terms)
                if sum(map(len, counts.values())) > FLUSH:
                    yield handed()
        yield handed()

    by = training.mapInPandas(count, "term string, s int, n long").groupBy("term", "s").agg(F.sum("n").alias("n"))
    cells = by.groupBy("term").agg(F.sum("n").alias("all"), F.max(F.when(F.col("s") >= 0, F.col("n"))).alias("most"), F.collect_list(F.struct("s", "n")).alias("cells"))
    least = max(number, math.ceil(training.count() * part))
    telling = cells.where((F.col("most") >= least) & (F.col("most") / (F.col("all") + 2) >= share))
    found = telling.select("term", "cells").orderBy("term").collect()
    counts = np.zeros((len(found), len(subjects)))
    for i, r in enumerate(found):
        for c in r["cells"]:
            if c["s"] >= 0:
                counts[i, c["s"]] = c["n"]
    evidence = np.log((counts + 0.1) / (counts.sum(axis=1, keepdims=True) + 0.1 * len(subjects)) * len(subjects)) if found else counts
    return Lexicon.of(subjects, [r["term"] for r in found], evidence)


def unpacked(words: str) -> list[list[str]]:
    """Paragraphs as ``stripped`` stores them."""
    return [p.split(" ") for p in words.split("\n")] if words else []


def stripped(docs: DataFrame) -> DataFrame:
    """``doc_id, source, words, structure`` of the documents with text, stored: their paragraphs are read once.

    ``words`` has a line a paragraph; ``structure`` says what the LaTeX text is made of.
    """

    def strip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words, structure = [], []
            for text in batch["text"]:
                paras = paragraphs(text)
                words.append("\n".join(map(" ".join, paras)))
                structure.append([1.0, float(np.log1p(len(paras))), *(float(x in text) for x in ("\\begin{abstract}", "\\begin{document}", "\\begin{thebib")), float(np.log1p(text.count("\\section")))])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "source": batch["source"], "words": words, "structure": structure})

    slim = docs.select("doc_id", source_name(F.col("source")).alias("source"), "text").where("text is not null")
    return staged(slim.mapInPandas(strip, "doc_id long, source string, words string, structure array<double>"), "words")


def features(lexicon: Lexicon, words: str, structure: np.ndarray, source: str | None, sources: list[str]) -> np.ndarray:
    """Term, structure and source features of a document, in that order; see ``_link`` for their layout."""
    paras = unpacked(words)
    share, mean = lexicon.shares(paras)
    return np.concatenate([share, mean, structure, [float(source == s) for s in sources], [float(len(paras) > 0)]])


def _before(labels: np.ndarray, j: int) -> np.ndarray:
    """The labels of the subjects before ``j``, zeros for the others."""
    out = labels.copy()
    out[:, j:] = 0
    return out


def _link(x: np.ndarray, j: int, k: int, before: np.ndarray) -> np.ndarray:
    """Inputs of the chain's link ``j``: evidence for its subject, structure, source, and the labels decided before it."""
    share, mean = x[:, :k], x[:, k : 2 * k]
    others = np.delete(share, j, axis=1).max(axis=1) if k > 1 else np.zeros(len(x))
    own = np.stack([share[:, j], mean[:, j], (share[:, j] >= MIN_SHARE - 1e-9).astype(float), others, (share >= MIN_SHARE - 1e-9).sum(axis=1)], axis=1)
    return np.concatenate([own, x[:, 2 * k : -1], before], axis=1)


def _pooled(links: np.ndarray, k: int) -> np.ndarray:
    """Inputs that mean the same in every link: its own evidence, structure and source, and how many labels came before."""
    return np.concatenate([links[:, : links.shape[1] - k], links[:, links.shape[1] - k :].sum(axis=1, keepdims=True)], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float, offset: np.ndarray | float = 0.0, steps: int = 30) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps, on top of an offset."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(offset + x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + penalty * np.eye(len(w))
        d = np.linalg.solve(h, x.T @ (y - p) - penalty * w)
        w += d
        if np.abs(d).max() < 1e-6:
            break
    return w


@dataclass
class Chain:
    """Logistic links in the order of the subjects, each seeing the labels before it, with Platt calibration.

    A link is what all links have in common plus what is special to its subject, the latter shrunk towards
    nothing, so that subjects with few labelled documents lean on the others.
    """

    subjects: list[str]
    common: np.ndarray
    weights: list[np.ndarray]
    scales: list[tuple[float, float]]

    @classmethod
    def fitted(cls, subjects: list[str], x: np.ndarray, y: np.ndarray) -> Chain:
        """Links fitted on four fifths of the documents and calibrated on the rest."""
        k, held = len(subjects), np.arange(len(x)) % 5 == 4
        links = [_link(x, j, k, _before(y, j)) for j in range(k)]
        shared = [_pooled(inputs, k) for inputs in links]
        common = _logistic(np.concatenate([s[~held] for s in shared]), np.concatenate([y[~held, j] for j in range(k)]), 1.0)
        weights = [_logistic(inputs[~held], y[~held, j], 10.0, s[~held] @ common) for j, (inputs, s) in enumerate(zip(links, shared, strict=True))]
        z = np.concatenate([s[held] @ common + inputs[held] @ w for inputs, s, w in zip(links, shared, weights, strict=True)])
        truth = np.concatenate([y[held, j] for j in range(k)])
        # the prior is that the links are calibrated already
        a, b = _logistic(np.stack([z, np.ones(len(z))], axis=1), truth, 1.0, z) + [1.0, 0.0] if len(z) else (1.0, 0.0)
        scales = []
        for j in range(k):  # each link's own calibration leans on the one of all links
            own = z[j * held.sum() : (j + 1) * held.sum()]
            c, d = _logistic(np.stack([own, np.ones(len(own))], axis=1), y[held, j], 10.0, a * own + b) if len(own) else (0.0, 0.0)
            scales.append((max(float(a + c), 0.1), float(b + d)))
        return cls(subjects, common, weights, scales)

    def logits(self, x: np.ndarray, j: int, labels: np.ndarray) -> np.ndarray:
        """Calibrated log odds of the subject ``j`` given the labels before it."""
        k = len(self.subjects)
        inputs = _link(x, j, k, _before(labels, j))
        a, b = self.scales[j]
        return a * (_pooled(inputs, k) @ self.common + inputs @ self.weights[j]) + b

    def decoded(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """The likeliest label combination of each document, by beam search along the chain."""
        n, k = len(x), len(self.subjects)
        labels, score = np.zeros((n, 1, k)), np.zeros((n, 1))
        for j in range(k):
            width = labels.shape[1]
            z = np.clip(self.logits(np.repeat(x, width, axis=0), j, labels.reshape(n * width, k)), -30, 30).reshape(n, width)
            yes, no = -np.log1p(np.exp(-z)), -np.log1p(np.exp(z))
            both = np.concatenate([score + no, score + yes], axis=1)
            grown = np.concatenate([labels, labels], axis=1)
            grown[:, width:, j] = 1
            best = np.argsort(-both, axis=1, kind="stable")[:, :beam]
            score, labels = np.take_along_axis(both, best, axis=1), np.take_along_axis(grown, best[:, :, None], axis=1)
        return labels[:, 0] * x[:, -1:]


def subjects_of(docs: DataFrame, labels: DataFrame, areas: DataFrame) -> DataFrame:
    """``doc_id, subject``: the subjects of every document, none for those without paragraphs.

    ``docs`` has ``doc_id, source, text``; ``labels`` has ``doc_id, subject``, in any case and with outer
    blanks, repeated, incomplete and partly wrong; ``areas`` has ``subject``. Labels of other subjects
    and null ones don't count. Without labelled documents nothing comes out.

    A lexicon of telling terms is counted over the labelled documents, then over their paragraphs, each for
    the label that fits it, then over the paragraphs of all documents, each for the subject that leads. The
    labels of at most ``MAX_TRAINING`` documents are used; all documents are classified. Each document's
    paragraphs vote by it; the votes, the source and the structure are the features of a classifier chain with one calibrated link a subject,
    which sees the subjects before it, and beam search finds the likeliest combination.
    """
    subjects = sorted(r["subject"] for r in areas.where("subject is not null").select("subject").distinct().collect())
    names = F.create_map(*[x for i, s in enumerate(subjects) for x in (F.lit(s.strip().lower()), F.lit(i))])
    known = labels.select("doc_id", names[F.lower(F.trim("subject"))].alias("s")).where("s is not null").groupBy("doc_id").agg(F.array_sort(F.collect_set("s")).alias("labels"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    labelled = known.orderBy(*order).limit(MAX_TRAINING)
    slim = stripped(docs)
    # at most MAX_TRAINING rows of an id and few numbers are broadcast: the texts stay where they are
    training = slim.join(F.broadcast(labelled), "doc_id")
    lexicon = None
    for level in range(len(TELLING)):
        rows = training if level < 2 else slim.join(F.broadcast(labelled), "doc_id", "left")
        lexicon = _lexicon(rows, subjects, lexicon, level)
    sources = sorted(r["source"] for r in training.select("source").distinct().collect() if r["source"])
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(lexicon)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [features(shipped.value, w, x, s, sources).tolist() for w, x, s in zip(batch["words"], batch["structure"], batch["source"], strict=True)]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "x": rows, "labels": batch["labels"]})

    train = training.mapInPandas(measure, "doc_id long, x array<double>, labels array<int>").orderBy(*order).toPandas()
    y = np.zeros((len(train), len(subjects)))
    for i, own in enumerate(train["labels"]):
        y[i, list(own)] = 1
    if not len(train):
        return docs.select("doc_id", F.lit(None).cast("string").alias("subject")).where("false")
    x = np.array(train["x"].tolist())
    chain = spark.sparkContext.broadcast(Chain.fitted(subjects, x[x[:, -1] > 0], y[x[:, -1] > 0]))

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            seen = np.stack([features(shipped.value, w, x, s, sources) for w, x, s in zip(batch["words"], batch["structure"], batch["source"], strict=True)])
            i, j = np.nonzero(chain.value.decoded(seen))
            yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy()[i], "subject": np.array(subjects, dtype=object)[j]})

    return slim.mapInPandas(predict, "doc_id long, subject string")


def makeup(found: DataFrame, docs: DataFrame, areas: DataFrame) -> DataFrame:
    """``subject, n_docs, share``: documents of each subject and their share of all documents."""
    total = docs.agg(F.count("*").alias("_n"))
    counts = areas.select("subject").distinct().join(found.groupBy("subject").agg(F.count("*").alias("n")), "subject", "left")
    return counts.crossJoin(F.broadcast(total)).select("subject", F.coalesce("n", F.lit(0)).alias("n_docs"), F.try_divide(F.coalesce("n", F.lit(0)), F.col("_n")).alias("share"))
