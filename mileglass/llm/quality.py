"""Quality rules as weak supervision: rules vote, expectation-maximisation weighs them, a posterior decides.

Everything on the main path is DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mileglass.llm.text import BLANKS, free_name, stored

SYMBOLS = "#*$%&|<>"
WINDOW = 3
PLAIN_WORD = r"^[(\"'\u201c]?[\p{L}\p{M}'\u2019-]+[.,;:!?)\"'\u201d]?$"
SENTENCE_ENDS = (".", "!", "?", ":", ";", "\"", "'", "\u201d", "\u3002")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capital_lines",
            "n_ended_lines", "n_plain_words")


def with_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a struct column ``measures`` of counts over the whole text (NULL counts as empty).

    n_words, word_chars (characters in words), n_symbols, n_lines (lines with a word), n_dup_lines (of them, equal
    to an earlier line), n_repeat_words (words in windows of three that occur twice or more), n_capital_lines (lines
    without a small letter), n_ended_lines (lines that end a sentence), n_plain_words (words of letters, but for a
    mark at either end).

    Every step stays within its row: no shuffle, and a long text costs n log n.  A column ``measures`` is replaced,
    all others stay.
    """
    words_, lines_, hashes_, ordered_ = (free_name(docs, c) for c in ("__words", "__lines", "__hashes", "__ordered"))
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(t, f"[{BLANKS}]+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda line: line.rlike(f"[^{BLANKS}]"))
    n = F.size(words_)
    hashes = F.when(n > WINDOW, F.transform(
        F.slice(words_, F.lit(1), n - (WINDOW - 1)),
        lambda w, i: F.xxhash64(w, *[F.get(words_, i + k) for k in range(1, WINDOW)])))
    # Only texts with an equal pair are sorted: equal windows become neighbours, and their words are compared.
    ordered = F.when(F.size(F.array_distinct(hashes_)) < F.size(hashes_), F.sort_array(F.transform(
        hashes_, lambda h, i: F.struct(h.alias("h"), i.alias("at")))))

    def equal(x, other):
        words_equal = [F.get(words_, x["at"] + k) == F.get(words_, other["at"] + k) for k in range(WINDOW)]
        return F.coalesce((x["h"] == other["h"]) & words_equal[0] & words_equal[1] & words_equal[2], F.lit(False))

    starts = F.sort_array(F.transform(
        F.filter(ordered_, lambda x, i: equal(x, F.get(ordered_, i - 1)) | equal(x, F.get(ordered_, i + 1))),
        lambda x: x["at"]))
    covered = F.aggregate(
        F.coalesce(starts, F.array().cast("array<int>")),
        F.struct(F.lit(0).alias("words"), F.lit(-WINDOW).alias("last")),
        lambda acc, at: F.struct((acc["words"] + F.least(F.lit(WINDOW), at - acc["last"])).alias("words"),
                                 at.alias("last")),
        lambda acc: acc["words"])
    counts = F.struct(
        n.cast("long").alias("n_words"),
        F.length(F.array_join(words_, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(t, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        (F.size(lines_) - F.size(F.array_distinct(lines_))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size(lines_).cast("long").alias("n_lines"),
        F.size(F.filter(lines_, lambda x: (x == F.upper(x)) & (x != F.lower(x)))).cast("long")
        .alias("n_capital_lines"),
        F.size(F.filter(lines_, lambda x: F.substring(F.rtrim(x), -1, 1).isin(*SENTENCE_ENDS))).cast("long")
        .alias("n_ended_lines"),
        F.size(F.filter(words_, lambda w: w.rlike(PLAIN_WORD))).cast("long").alias("n_plain_words"))
    return (docs.withColumn(words_, words).withColumn(lines_, lines)
            .withColumn(hashes_, hashes).withColumn(ordered_, ordered)
            .withColumn("measures", counts).drop(words_, lines_, hashes_, ordered_))


@dataclass(frozen=True)
class Rule:
    """Votes against a text, for it, or abstains; the two conditions never hold together.

    ``catches`` is the share of bad texts among those it votes on that it is expected to vote against, before the
    data speak.
    """

    name: str
    against: Column
    favour: Column
    catches: float = 0.3


def default_rules(m: str = "measures") -> list[Rule]:
    def c(name):
        return F.col(f"{m}.{name}")

    words, lines, capital = c("n_words"), c("n_lines"), c("n_capital_lines")
    symbols, repeats, dups = c("n_symbols"), c("n_repeat_words"), c("n_dup_lines")
    chars, ended, plain = c("word_chars"), c("n_ended_lines"), c("n_plain_words")
    return [
        Rule("length", words < 20, words >= 80),
        Rule("word_length", (chars < 2.5 * words) | (chars > 14 * words), (chars >= 3 * words) & (chars <= 10 * words)),
        Rule("symbols", 10 * symbols > 3 * words, 20 * symbols < words),
        Rule("repeats", 10 * repeats > 3 * words, (10 * repeats < words) & (words > 0)),
        Rule("lines", (10 * dups > 3 * lines) & (lines > 1), (dups == 0) & (lines > 3)),
        Rule("capitals", (2 * capital > lines) & (lines > 0), (10 * capital < lines)),
        Rule("plain_words", 10 * plain < 7 * words, 10 * plain > 9 * words),
        Rule("sentences", (10 * ended < lines) & (lines > 0), 2 * ended >= lines),
    ]


def vote(rule: Rule) -> Column:
    """-1 against, 1 in favour, 0 abstains; a condition that is NULL does not hold."""
    against, favour = (F.coalesce(x, F.lit(False)) for x in (rule.against, rule.favour))
    return F.when(against, -1).when(favour, 1).otherwise(0).cast("byte")


@dataclass(frozen=True)
class VoteModel:
    """Estimated share of good texts and, per rule, how often a vote is against a good and against a bad text."""

    prior: float
    against_good: tuple[float, ...]
    against_bad: tuple[float, ...]

    def posterior(self, votes: list[Column]) -> Column:
        """Probability that a text with these votes is good."""
        return F.lit(1.0) / (F.lit(1.0) + F.exp(self._log_odds_bad(votes)))

    def _log_odds_bad(self, votes: list[Column]) -> Column:
        import math
        odds = F.lit(math.log((1 - self.prior) / self.prior))
        for v, good, bad in zip(votes, self.against_good, self.against_bad):
            odds = odds + (F.when(v == -1, math.log(bad / good))
                           .when(v == 1, math.log((1 - bad) / (1 - good))).otherwise(0.0))
        return odds


def fit_votes(votes: DataFrame, rules: list[Rule], prior_good: float = 0.85, weight: float = 0.05,
              rounds: int = 30, tolerance: float = 1e-4) -> VoteModel:
    """Expectation-maximisation over the votes of all texts.

    ``votes`` holds one column per rule, in order.  Texts with the same votes are counted first: there are at most
    3 ** rules patterns however many texts there are, and each round is one aggregate over the patterns that gives
    one row.  The starting values count as ``weight`` times the texts, so a rule that hardly votes keeps them.
    Without any text the starting values are the model.
    """
    names = votes.columns
    patterns = stored(votes.groupBy(*names).agg(F.count("*").alias("n")), "quality-patterns")
    total = patterns.agg(F.sum("n")).first()[0] or 0
    pseudo = max(1.0, weight * total)
    start = VoteModel(prior_good, (0.01,) * len(rules), tuple(r.catches for r in rules))
    model = start
    for _ in range(rounds if total else 0):
        good = model.posterior([F.col(f"`{c}`") for c in names])
        sums = [F.sum(F.col("n") * good).alias("good"), F.sum(F.col("n") * (1 - good)).alias("bad")]
        for i, name in enumerate(names):
            voted, against = F.col(f"`{name}`") != 0, F.col(f"`{name}`") == -1
            for side, share in (("good", good), ("bad", 1 - good)):
                sums += [F.sum(F.when(voted, F.col("n") * share).otherwise(0.0)).alias(f"{side}_voted_{i}"),
                         F.sum(F.when(against, F.col("n") * share).otherwise(0.0)).alias(f"{side}_against_{i}")]
        row = patterns.agg(*sums).first()

        def share(side, i, first):
            return (row[f"{side}_against_{i}"] + pseudo * first) / (row[f"{side}_voted_{i}"] + pseudo)

        following = VoteModel(
            (row["good"] + pseudo * prior_good) / (total + pseudo),
            tuple(share("good", i, start.against_good[i]) for i in range(len(names))),
            tuple(share("bad", i, start.against_bad[i]) for i in range(len(names))))
        moved = max(abs(a - b) for a, b in zip((following.prior, *following.against_good, *following.against_bad),
                                               (model.prior, *model.against_good, *model.against_bad)))
        model = following
        if moved < tolerance:
            break
    return model


def base_failed(m: str = "measures", least_words: int = 50, repeat_percent: int = 50) -> Column:
    """The two hard rules: too few words, or too many of them in repeated windows."""
    words, repeats = F.col(f"{m}.n_words"), F.col(f"{m}.n_repeat_words")
    return (words < least_words) | (100 * repeats > repeat_percent * words)


def judge_quality(measured: DataFrame, model: VoteModel, rules: list[Rule], threshold: float = 0.5) -> DataFrame:
    """Add quality (posterior), base_failed and kept to a frame with ``measures``."""
    return (measured.withColumn("quality", model.posterior([vote(r) for r in rules]))
            .withColumn("base_failed", base_failed())
            .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold)))


def fit_quality(measured: DataFrame, rules: list[Rule] | None = None) -> VoteModel:
    """The vote model of a frame with ``measures``."""
    rules = rules or default_rules()
    return fit_votes(measured.select(*[vote(r).alias(r.name) for r in rules]), rules)


def score_quality(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """``docs`` with measures, quality, base_failed and kept, learned from these very documents.

    Each text is measured once; the rows are stored with their measures, which learning and judging read.  A NULL or
    empty text has no words and fails.  Repeated rows count each and get the same verdict.  Columns of the added names
    are replaced.
    """
    rules = rules or default_rules()
    measured = stored(with_measures(docs, text), "quality-measured")
    return judge_quality(measured, fit_quality(measured, rules), rules)


def keep_quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that are kept, with their own columns, whatever they are called; each text is measured once."""
    packed = docs.select(F.struct("*").alias("doc"), F.col(text).alias("text"))
    measured = stored(with_measures(packed).drop("text"), "quality-measured")
    return judge_quality(measured, fit_quality(measured), default_rules()).filter("kept").select("doc.*")
