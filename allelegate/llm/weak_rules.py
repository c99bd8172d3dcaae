"""Quality rules that vote, weighed by weak supervision.

Each rule looks at a document's counts and votes good (1), bad (-1) or abstains (0).  No rule decides alone:
expectation-maximisation over the vote patterns of all documents estimates how often each rule votes what on good
and on bad documents, and a document is kept if its posterior probability of being good is at least `least`.
There are at most 3 ** 9 patterns, so the fit sees a table of fixed size, counted on Spark over all rows.

Base counts are exact.  Words are runs of characters other than U+0020 and U+0009 to U+000D.  No text has no
words, counts 0 and fails the base rule, as every text below 50 words does.  Every row gives one row; repeated rows
get equal results.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelegate.llm.tables import computed, per_worker, stored
from allelegate.llm.words import WordHashes, gram_hashes

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"
UPPER = bytes(range(ord("A"), ord("Z") + 1))
#: Bytes of letters, digits, white space and the signs of ordinary prose.
COMMON = bytes(b for b in range(256) if b > 127 or chr(b).isalnum() or chr(b) in SPACES + ".,;:!?'\"()-")
#: White space, then letters (with every byte of a character past ASCII), then the rest.
STARTS = bytes(32 if chr(b) in SPACES else 97 if b > 127 or chr(b).isalpha() else 46 for b in range(256))
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended", "n_upper", "n_letters", "n_alpha_words", "n_marks", "n_others"]


def repeated_words(words: np.ndarray) -> int:
    """Words that lie in a three-word window which the text holds twice or more."""
    if len(words) < 4:
        return 0
    grams = gram_hashes(words, 3)
    _, which, counts = np.unique(grams, return_inverse=True, return_counts=True)
    again = counts[which] > 1
    covered = np.zeros(len(words), bool)
    for i in range(3):
        covered[i : len(words) - 2 + i] |= again
    return int(covered.sum())


def counts_of(text: str | None, known: WordHashes) -> tuple[int, ...]:
    """COUNTS of one text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    seen: set[str] = set()
    lines = again = ended = 0
    for line in text.split("\n"):
        bare = line.strip(SPACES)
        if not bare:
            continue
        lines += 1
        ended += bare[-1] in ".!?:;\"'”»)"
        again += line in seen
        seen.add(line)
    n_upper = len(raw) - len(raw.translate(None, UPPER))
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        again,
        repeated_words(known.of(words)),
        lines,
        ended,
        n_upper,
        n_upper + len(raw) - len(raw.translate(None, UPPER.lower())),
        (b" " + raw.translate(STARTS)).count(b" a"),
        text.count("!") + text.count("?"),
        len(raw.translate(None, COMMON)),
    )


def counted(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and COUNTS of every row."""

    def make():
        known = per_worker("words", WordHashes)

        def step(values: list) -> dict:
            rows = [counts_of(t, known) for t in values]
            return {name: [r[i] for r in rows] for i, name in enumerate(COUNTS)}

        return step

    return computed(docs.select(F.col(id).alias("doc_id"), F.col(text).alias("_text")), "_text", ", ".join(f"{c} long" for c in COUNTS), make)


def _vote(value, good, bad):
    return F.when(bad(value), -1).when(good(value), 1).otherwise(0)


def votes() -> dict:
    """One column per rule: 1 good, -1 bad, 0 abstains."""
    per_word = lambda c: F.col(c) / F.greatest("n_words", F.lit(1))
    per_line = lambda c: F.col(c) / F.greatest("n_lines", F.lit(1))
    return {
        "word_length": _vote(per_word("word_chars"), lambda v: v.between(3, 9), lambda v: (v < 2) | (v > 14)),
        "symbols": _vote(per_word("n_symbols"), lambda v: v < 0.05, lambda v: v > 0.3),
        "characters": _vote(F.col("n_others") / F.greatest("word_chars", F.lit(1)), lambda v: v < 0.03, lambda v: v > 0.1),
        "marks": _vote(per_word("n_marks"), lambda v: v < 0.2, lambda v: v > 0.8),
        "capitals": _vote(F.col("n_upper") / F.greatest("n_letters", F.lit(1)), lambda v: v < 0.2, lambda v: v > 0.5),
        "alphabetic": _vote(per_word("n_alpha_words"), lambda v: v > 0.85, lambda v: v < 0.7),
        "line_ends": _vote(per_line("n_ended"), lambda v: v > 0.6, lambda v: v < 0.1),
        "repeated_lines": _vote(per_line("n_dup_lines"), lambda v: v < 0.1, lambda v: v > 0.4),
        "repeated_words": _vote(per_word("n_repeat_words"), lambda v: v < 0.15, lambda v: v > 0.4),
    }


class LabelModel:
    """Two kinds of documents; each rule has its own shares of votes on either kind."""

    def __init__(self, patterns: np.ndarray, weights: np.ndarray, rounds: int = 200, strength: float = 0.02):
        """patterns: a row of votes each; weights: documents that show it."""
        rules = patterns.shape[1]
        # what a rule is written for: a vote is more often right than wrong; worth `strength` of the documents
        belief = np.array([[[0.60, 0.35, 0.05], [0.02, 0.28, 0.70]]] * rules)
        prior = strength * max(weights.sum(), 1.0) * belief
        shown = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)
        good = np.where((patterns == -1).any(axis=1), 0.1, 0.95)
        self.share, self.tables = 0.5, belief
        for _ in range(rounds):
            kinds = np.stack([1 - good, good]) * weights
            self.share = float((kinds[1].sum() + 1) / (weights.sum() + 2))
            seen = np.einsum("kp,prv->rkv", kinds, shown) + prior
            self.tables = seen / seen.sum(axis=2, keepdims=True)
            before, good = good, self.posterior(patterns)
            if np.abs(good - before).max(initial=0) < 1e-10:
                break

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of the good kind for each row of votes."""
        if not len(patterns):
            return np.empty(0)
        logs = np.log(self.tables)
        odds = sum(logs[r, 1, patterns[:, r] + 1] - logs[r, 0, patterns[:, r] + 1] for r in range(patterns.shape[1]))
        return 1 / (1 + np.exp(-np.clip(odds + np.log(self.share / (1 - self.share)), -500, 500)))


def judged(docs: DataFrame, id: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """Base counts, base_failed, kept, posterior and the votes of every row."""
    rules = votes()
    rows = stored(counted(docs, id, text).withColumns(rules), "votes")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    # at most 3 ** 9 rows; documents that the base rule decides teach the model nothing
    table = rows.groupBy(*rules).agg(F.count_if(~failed).alias("weight")).orderBy(*rules).toArrow()
    patterns = np.stack([table[r].to_numpy() for r in rules], axis=1).astype(int)
    model = LabelModel(patterns, table["weight"].to_numpy().astype(float))
    found = [(*map(int, p), float(g)) for p, g in zip(patterns, model.posterior(patterns), strict=True)]
    known = docs.sparkSession.createDataFrame(found, ", ".join(f"{r} int" for r in rules) + ", posterior double")
    return rows.join(F.broadcast(known), list(rules)).select(
        "doc_id",
        *COUNTS[:5],
        failed.alias("base_failed"),
        (~failed & (F.col("posterior") >= least)).alias("kept"),
        "posterior",
        *rules,
    )
