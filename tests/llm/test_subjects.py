"""Subjects: visible paragraphs, the chain, and held-out accuracy."""

import numpy as np
from pyspark.sql import functions as F

from logloom.llm import subjects
from logloom.llm.subjects import Chain, _lexicon, makeup, paragraphs, subjects_of
from logloom.session import table

DATA = "/root/testdata/sf0.1"


def test_paragraphs():
    text = r"""\documentclass{article}
\newcommand{\kw}{hash table}
\begin{document}
\maketitle
% The whole comment is about law and courts and judges here.
\section{The heading is of no interest to anyone at all}

The \kw{} was measured twice % and courts
in \cite{law1990} the memory of this machine.

\begin{figure} \caption{What drives the court in this picture then} \end{figure}

\begin{comment}
A paragraph about courts and judges and statutes nobody sees.
\end{comment}

Too short.

\begin{thebibliography}{6}
\bibitem{x} A very long title on courts and the law of contracts.
\end{thebibliography}
\end{document}
After the end there is more text about courts and contracts."""
    assert paragraphs(text) == [["the", "hash", "table", "was", "measured", "twice", "in", "the", "memory", "of", "this", "machine"]]
    assert paragraphs("") == [] and paragraphs("\\input{x}\n\n\\include{y}") == []
    assert paragraphs("\\begin{comment} never closed " * 5) == []
    assert len(paragraphs("one two three four five six seven\r\n\r\none two three four five six seven")) == 2


def test_chain_sees_earlier_labels():
    r = np.random.default_rng(0)
    n, k = 2000, 2
    share = np.zeros((n, k))
    share[:, 0] = r.random(n)
    x = np.concatenate([share, share, np.ones((n, 1)), np.ones((n, 1))], axis=1)
    y = np.zeros((n, k))
    y[:, 0] = share[:, 0] > 0.5
    y[:, 1] = y[:, 0]  # the second subject always comes with the first
    chain = Chain.fitted(["a", "b"], x, y)
    assert (chain.decoded(x) == y).mean() > 0.98
    assert chain.decoded(np.zeros((1, x.shape[1]))).sum() == 0


def test_held_out_labels(spark):
    docs, labels, areas = (table(spark, DATA, t) for t in ("documents", "subject_labels", "subject_areas"))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    got = subjects_of(docs, labels.where(~held), areas)
    want = labels.where(held & F.col("subject").isNotNull()).select("doc_id", F.lower(F.trim("subject")).alias("subject")).distinct()
    hits, n = got.join(want, ["doc_id", "subject"]).count(), want.count()
    extra = got.join(want.select("doc_id").distinct(), "doc_id").count() - hits
    # some of the held-out labels are wrong, and some are missing
    assert n > 150 and hits / n > 0.9 and extra / n < 0.1


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, None), (2, "s", ""), (3, None, "x " * 200_000)], "doc_id long, source string, text string")
    labels = spark.createDataFrame([(3, " LAW "), (3, " law"), (3, None), (9, "law"), (3, "nonsense")], "doc_id long, subject string")
    areas = spark.createDataFrame([("law", "x"), ("physics", None), (None, "y")], "subject string, description string")
    assert {r.doc_id for r in subjects_of(docs, labels, areas).collect()} <= {3}
    assert subjects_of(docs, labels.limit(0), areas).count() == 0
    assert subjects_of(docs.limit(0), labels, areas).count() == 0
    assert {r.subject: r.n_docs for r in makeup(subjects_of(docs, labels.limit(0), areas), docs, areas.where("subject is not null")).collect()} == {"law": 0, "physics": 0}


def test_unlabelled_documents_count_at_any_size(spark, monkeypatch):
    seen = []

    def kept(*args):
        seen.append(_lexicon(*args))
        return seen[-1]

    law, physics = "court judge statute contract verdict appeal", "quark boson lattice photon plasma neutron"
    rows = [(i, "s", " ".join([law if i % 2 else physics, "" if i < 20 else "tribunal" if i % 2 else "hadron"]) + f" n{i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    labels = spark.createDataFrame([(i, "law" if i % 2 else "physics") for i in range(20)], "doc_id long, subject string")
    areas = spark.createDataFrame([("law",), ("physics",)], "subject string")
    monkeypatch.setattr(subjects, "_lexicon", kept)
    monkeypatch.setattr(subjects, "MAX_TRAINING", 20)  # as many as are labelled
    got = subjects_of(docs, labels, areas)
    assert {"tribunal", "hadron"} <= set(seen[-1].words)
    assert {(r.doc_id, r.subject) for r in got.collect()} == {(i, "law" if i % 2 else "physics") for i in range(60)}
