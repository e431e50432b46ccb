"""Quality rules by weak supervision, with DataFrame and SQL functions only.

Rules look at one document each and vote good (1), bad (-1) or abstain (0).
Documents are counted by their vote pattern (3**rules patterns at most, so the
counts are bounded whatever the input), and expectation-maximisation over the
patterns estimates the share of good documents and, for both classes, how each
rule votes. A document's posterior probability of being good replaces the
test that all rules pass. Documents that fail the base rule are out in any
case, so only the others are counted for the estimate.

Texts are read once; the features are written as a narrow table, and the
verdict is a join with the (bounded) table of patterns.

Null and empty texts have no words and fail the base rule. Repeated rows are
judged alike and all count in the estimate. No documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillpoint.llm.scratch import stored

MIN_WORDS = 50
MAX_REPEATED = 50  # per cent of words in repeated 3-word windows
ROUNDS = 30
KEEP_FROM = 0.5
PRIOR = 0.85
TRUST = 0.8  # a rule's first guess: how much of its class it votes for when it votes
SMOOTH = 1.0

_SPACE = r"[\x20\x09-\x0D]+"
_PLAIN = r"^[\p{L}\p{N}'’-]+[.,;:!?]*$"
_BLANKS = " \t\n\x0b\f\r"


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_list(text: str) -> Column:
    """Words of a text, none for null."""
    words = F.split(F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(_BLANKS)), _SPACE)
    return F.filter(words, lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more, the first occurrence included.

    Windows are compared by a 64-bit hash; they are sorted only where one repeats.
    """
    def marked(h):
        def of_sorted(s):
            same = lambda x, j: ((F.get(s, j - 1)["h"] == x["h"]) | (F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))))
            first = F.filter(s, lambda x, j: F.coalesce(same(x, j), F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))))
            at = F.array_sort(F.transform(first, lambda x: x["i"]))
            # each repeated window adds the words that the one before it does not cover
            return _let(at, lambda p: F.aggregate(
                F.transform(p, lambda i, j: F.least(F.lit(3), F.coalesce(i - F.get(p, j - 1), F.lit(3)))),
                F.lit(0).cast("long"), lambda a, x: a + x))
        rows = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_let(rows, of_sorted))

    windows = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)))
    return _let(words, lambda w: F.when(F.size(w) < 3, F.lit(0).cast("long")).otherwise(_let(windows(w), marked)))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of each text that the rules look at."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(_BLANKS)) != "")
    words = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
                .select("doc_id", text.alias("text"), word_list("text").alias("w"))
    long = lambda c: c.cast("long")
    return words.select(
        "doc_id", long(F.size("w")).alias("n_words"), long(F.length(F.array_join("w", ""))).alias("word_chars"),
        long(F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]", ""))).alias("n_symbols"),
        _let(lines, lambda x: long(F.size(x) - F.size(F.array_distinct(x)))).alias("n_dup_lines"),
        long(F.size(lines)).alias("n_lines"), repeated_words(F.col("w")).alias("n_repeat_words"),
        long(F.size(F.filter("w", lambda w: w.rlike(_PLAIN)))).alias("n_plain_words"),
        long(F.length(F.regexp_replace("text", r"[^\p{L}\p{N}]+", ""))).alias("n_letters"),
        long(F.length("text") - F.length(F.regexp_replace("text", r"\p{Lu}+", ""))).alias("n_capitals"))


def votes() -> dict[str, Column]:
    """Each rule's vote on a row of features: 1 good, -1 bad, 0 abstain."""
    n = F.greatest("n_words", F.lit(1))
    share = lambda c: F.col(c) / n

    def rule(good: Column, bad: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    chars = F.greatest("word_chars", F.lit(1))
    length = F.col("word_chars") / n
    return {
        "long_enough": rule(F.col("n_words") >= 2 * MIN_WORDS, F.col("n_words") < MIN_WORDS),
        "word_length": rule(length.between(3.0, 9.0), (length < 2.0) | (length > 12.0)),
        "symbols": rule(F.col("n_symbols") < 0.02 * chars, F.col("n_symbols") > 0.05 * chars),
        "letters": rule(F.col("n_letters") > 0.93 * chars, F.col("n_letters") < 0.9 * chars),
        "plain_words": rule(share("n_plain_words") > 0.85, share("n_plain_words") < 0.7),
        "capitals": rule(F.col("n_capitals") < 0.15 * chars, F.col("n_capitals") > 0.4 * chars),
        "own_lines": rule(F.col("n_dup_lines") == 0, F.col("n_dup_lines") > 0.3 * F.col("n_lines")),
        "own_windows": rule(share("n_repeat_words") < 0.1, share("n_repeat_words") > 0.3),
    }


def _likelihood(theta: Column, votes_of: Column, cls: int) -> Column:
    """Log likelihood of a pattern under a class: theta[class][rule][vote + 1]."""
    terms = F.transform(votes_of, lambda v, r: F.log(F.get(F.get(F.get(theta, F.lit(cls)), r), v + 1)))
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)


def _posterior(prior: Column, theta: Column, votes_of: Column) -> Column:
    odds = F.log(1 - prior) - F.log(prior) + _likelihood(theta, votes_of, 0) - _likelihood(theta, votes_of, 1)
    return 1 / (1 + F.exp(F.greatest(F.lit(-500.0), F.least(F.lit(500.0), odds))))


def estimate(patterns: DataFrame, n_rules: int, rounds: int = ROUNDS) -> DataFrame:
    """One row: ``prior`` (share of good documents) and ``theta`` (class 0 bad, 1 good; rule; vote -1, 0, 1),
    by ``rounds`` of expectation-maximisation over ``patterns`` (``v`` votes, ``n`` documents).

    The first guess trusts each rule: it votes for its class ``TRUST`` of the time.
    """
    rows = patterns.agg(F.array_sort(F.collect_list(F.struct("v", "n"))).alias("p"))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    first = [[TRUST, 0.1, 0.9 - TRUST], [0.9 - TRUST, 0.1, TRUST]]
    theta0 = F.array(*[F.array(*[F.array(*[F.lit(float(x)) for x in row]) for _ in range(n_rules)]) for row in first])
    state0 = F.struct(F.lit(PRIOR).alias("prior"), theta0.alias("theta"))

    def step(acc, _):
        soft = F.transform("p", lambda x: F.struct(
            x["v"].alias("v"), x["n"].cast("double").alias("n"),
            (x["n"] * _posterior(acc["prior"], acc["theta"], x["v"])).alias("good")))

        def update(s):
            good, every = total(F.transform(s, lambda x: x["good"])), total(F.transform(s, lambda x: x["n"]))
            mass = lambda cls: (lambda x: x["good"]) if cls else (lambda x: x["n"] - x["good"])

            def rates(cls):
                return F.transform(F.sequence(F.lit(0), F.lit(n_rules - 1)), lambda r: F.transform(
                    F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda v: (
                        SMOOTH + total(F.transform(F.filter(s, lambda x: F.get(x["v"], r) == v), mass(cls))))
                    / (3 * SMOOTH + total(F.transform(s, mass(cls))))))

            return F.struct(((SMOOTH + good) / (2 * SMOOTH + every)).alias("prior"), F.array(rates(0), rates(1)).alias("theta"))

        return _let(soft, update)

    fitted = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), state0, step)
    return rows.select(fitted.alias("m")).select("m.*")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS,
          keep_from: float = KEEP_FROM) -> DataFrame:
    """One row per document: the counts, the posterior probability of being good, and whether it is kept."""
    rules = votes()
    read = stored(features(docs, id_col, text_col), "quality-features")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    voted = read.withColumn("v", F.array(*[c.cast("int") for c in rules.values()])).withColumn("base_failed", failed)
    patterns = stored(voted.groupBy("v").agg(F.count_if(~F.col("base_failed")).alias("n")), "quality-patterns")
    model = estimate(patterns.where("n > 0"), len(rules), rounds)
    scored = stored(patterns.crossJoin(model)  # one row
                    .select("v", _posterior(F.col("prior"), F.col("theta"), F.col("v")).alias("quality")), "quality-posteriors")
    return (voted.join(F.broadcast(scored), "v")
                 .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         (~F.col("base_failed") & (F.col("quality") >= keep_from)).alias("kept"), "quality",
                         *[F.get("v", F.lit(i)).alias(f"vote_{k}") for i, k in enumerate(rules)]))
