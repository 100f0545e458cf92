"""Problem 3: how characteristic a term is of a record, by correspondence-analysis residuals.

With n(w,t) the count of term t in work w, r(w) and c(t) the margins and N the
grand total, the expected count is E = r(w) c(t) / N and the adjusted residual

    (n - E) / sqrt(E (1 - r/N) (1 - c/N)).

Everything is DataFrame arithmetic.  Counting combines map-side on (work, term);
the counts and the terms' margins are written once and feed the rest.  A term
that stands in a third of all records meets the join as many count rows against
one margin row, which adaptive execution splits.

The words that a work repeats and few works share are selected by their
residual: a work's critical residual is that of a term which the work has
``min_count`` times and which is as common as the commonest term of at most
``max_works`` works, C times in all.  With E(w) = r(w) C / N < min_count it is

    (min_count - E(w)) / sqrt(E(w)),

which no case falls short of: its n is min_count at least, its E at most E(w),
and the factors under the root are at most 1.  (Where E(w) is not below
min_count nothing can be told by the residual, and all terms of the work stay.)
What is selected is then checked against the exact counts.

Words are the maximal runs of letters and digits, lower-cased.  A work's text is
its abstract (of its latest delivery that has one) and its distinct keywords as
written.  Defined results: works without words give no rows; null work ids are
left out; when a margin is the grand total (one work, or one term) the variance
is zero and the residual is defined as 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stemma.session import materialize

WORD = r"[\p{L}\p{N}]+"


def work_texts(works: DataFrame, keywords: DataFrame) -> DataFrame:
    """(work_id, text): one abstract per work and each distinct keyword of it."""
    abstracts = (
        works.where("work_id is not null and abstract is not null")
        .groupBy("work_id")
        .agg(F.max(F.struct("loaded_at", "abstract")).alias("m"))
        .select("work_id", F.col("m.abstract").alias("text"))
    )
    words = keywords.select("work_id", F.col("keyword").alias("text")).where("work_id is not null and text is not null")
    return abstracts.unionAll(words.distinct())


def term_counts(texts: DataFrame) -> DataFrame:
    """(work_id, term, n) of (work_id, text)."""
    found = F.expr(f"regexp_extract_all(text, r'({WORD})', 1)")
    terms = texts.select("work_id", F.explode(found).alias("term")).select("work_id", F.lower("term").alias("term"))
    return terms.groupBy("work_id", "term").agg(F.count("*").alias("n"))


def term_margins(counts: DataFrame) -> DataFrame:
    """(term, c, n_works): how often each term stands in all works, and in how many."""
    return counts.groupBy("term").agg(F.sum("n").alias("c"), F.count("*").alias("n_works"))


def residuals(counts: DataFrame, margins: DataFrame) -> DataFrame:
    """(work_id, term, n, n_works, r, expected, variance, residual) of every count; r is the work's margin."""
    per_work = counts.groupBy("work_id").agg(F.sum("n").alias("r"))
    total = F.lit(float(margins.agg(F.sum("c")).first()[0] or 0))  # one number
    joined = counts.join(margins, "term").join(per_work, "work_id").withColumn("expected", F.col("r") * F.col("c") / total)
    joined = joined.withColumn("variance", F.col("expected") * (1 - F.col("r") / total) * (1 - F.col("c") / total))
    residual = F.when(F.col("variance") > 0, (F.col("n") - F.col("expected")) / F.sqrt("variance")).otherwise(0.0)
    return joined.select("work_id", "term", "n", "n_works", "r", "expected", "variance", residual.alias("residual"))


class Scores:
    """Counts and margins of all words of all works, written to the shared folder once, and what is read from them."""

    def __init__(self, works: DataFrame, keywords: DataFrame) -> None:
        self.counts = materialize(term_counts(work_texts(works, keywords)), "terms")
        self.margins = materialize(term_margins(self.counts), "margins")
        self.rows = residuals(self.counts, self.margins)

    def repeated_rare(self, min_count: int = 3, max_works: int = 5, min_chars: int = 6) -> DataFrame:
        """(work_id, term) of plain a-z words that a work repeats and few works share, by their residual."""
        few = F.when(F.col("n_works") <= max_works, F.col("c"))
        n, most = self.margins.agg(F.sum("c"), F.max(few)).first()  # two numbers
        e = F.col("r") * F.lit(float(most or 0)) / F.lit(float(n or 1))
        critical = F.when(e < min_count, (min_count - e) / F.sqrt(e) * (1 - 1e-9)).otherwise(F.lit(float("-inf")))
        # without variance (one work, or one term) the residual says nothing
        chosen = self.rows.where((F.col("residual") >= critical) | (F.col("variance") <= 0))
        exact = F.col("term").rlike(f"^[a-z]{{{min_chars},}}$") & (F.col("n") >= min_count) & (F.col("n_works") <= max_works)
        return chosen.where(exact).select("work_id", "term")


def top_terms(scores: DataFrame, k: int = 5) -> DataFrame:
    """The k terms of highest residual of each work; ties by term."""
    w = Window.partitionBy("work_id").orderBy(F.desc(F.round("residual", 6)), "term")
    ranked = scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("work_id", "term", "n", "n_works", F.round("residual", 6).alias("residual"), "rank")
