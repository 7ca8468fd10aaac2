"""Quality rules by weak supervision, with DataFrame functions only.

Each rule votes good (1), bad (-1) or abstains (0) on a document. Documents are counted by their pattern of
votes (at most 3^rules rows), expectation-maximisation over those counts estimates each rule's accuracy on good
and on bad documents and the share of good ones, and a document's posterior probability of being good replaces
"all rules must pass".

Defined cases: a null or empty text has no words, fails the base rules and is not kept; repeated rows are
judged alike, one result row each; repeats are looked for among neighbours in the order of 38 bits of the windows'
hashes, so that two of n windows are missed if a third one with these bits comes between them, whose chance is below
n^3 / 2^76; places have 26 bits, so texts of more than 67 million words are not defined; an empty table gives an empty
result; further columns are ignored by the query and kept by :func:`filter_documents`; feature names start with ``_q_`` so that no input column clashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, materialize

#: Bits of a packed window that hold its place.
_PLACE_BITS = 26
RULES = ("length", "symbols", "lines", "repeats", "word_length", "shouting", "sentences", "variety")


def _with_metrics(docs: DataFrame) -> DataFrame:
    """Counts over whole texts. Windows of three words are hashed, packed with their place and sorted, so that
    repeats are found among neighbours; nothing leaves the row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    place = F.lit((1 << _PLACE_BITS) - 1).cast("long")
    df = docs.withColumn("_q_words", F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)))
    df = df.withColumn("_q_lines", F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    words, n = F.col("_q_words"), F.size("_q_words")
    df = df.withColumn(
        "_q_windows",
        F.when(
            n >= 3,
            F.transform(F.slice(words, 1, F.greatest(n - 2, F.lit(1))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    windows = F.col("_q_windows")
    df = df.withColumn("_q_repeats", F.size(F.array_distinct(windows)) < F.size(windows))
    df = df.withColumn(
        "_q_packed",
        F.when(
            F.col("_q_repeats"),
            F.sort_array(F.transform(windows, lambda h, i: F.shiftleft(h, _PLACE_BITS).bitwiseOR(i.cast("long")))),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    packed = F.col("_q_packed")

    def hashed(x: Column) -> Column:
        return F.get(windows, x.bitwiseAND(place).cast("int"))

    same = F.filter(
        packed,
        lambda x, i: ((i > 0) & (hashed(x) == hashed(F.get(packed, i - 1)))) | hashed(x).eqNullSafe(hashed(F.get(packed, i + 1))),
    )
    covered = F.flatten(F.transform(same, lambda x: F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda k: x.bitwiseAND(place).cast("int") + k)))
    df = df.withColumn("_q_n_repeat", F.when(F.col("_q_repeats"), F.size(F.array_distinct(covered))).otherwise(0))

    def count(x: str) -> Column:
        return (F.length(text) - F.length(F.replace(text, F.lit(x), F.lit("")))).cast("long")

    return df.select(
        *[c for c in df.columns if not c.startswith("_q_")],
        n.cast("long").alias("_q_n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("_q_word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("_q_n_symbols"),
        (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long").alias("_q_n_dup_lines"),
        F.size("_q_lines").cast("long").alias("_q_n_lines"),
        F.col("_q_n_repeat").cast("long").alias("_q_n_repeat_words"),
        F.size(F.array_distinct(words)).cast("long").alias("_q_n_types"),
        count("!").alias("_q_n_marks"),
        count(".").alias("_q_n_stops"),
    )


def _votes() -> dict[str, Column]:
    """One column per rule of 1, -1 or 0. A document without words gets no good vote."""
    n = F.col("_q_n_words")

    def vote(good: Column, bad: Column) -> Column:
        return F.when(n == 0, -1).when(bad, -1).when(good, 1).otherwise(0)

    c = {x: F.col(f"_q_{x}") for x in ("word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_types", "n_marks", "n_stops")}
    return {
        "length": vote(n >= 80, n < 50),
        "symbols": vote(c["n_symbols"] * 50 <= n, c["n_symbols"] * 10 > n),
        "lines": vote(c["n_dup_lines"] * 20 <= c["n_lines"], c["n_dup_lines"] * 10 > c["n_lines"] * 3),
        "repeats": vote(c["n_repeat_words"] * 10 <= n, c["n_repeat_words"] * 10 > n * 3),
        "word_length": vote(c["word_chars"].between(n * 3, n * 10), (c["word_chars"] * 2 < n * 5) | (c["word_chars"] > n * 14)),
        "shouting": vote(c["n_marks"] * 50 <= n, c["n_marks"] * 10 > n),
        "sentences": vote((c["n_stops"] > 0) & (c["n_stops"] * 60 >= n), (c["n_stops"] * 400 < n) & (n >= 100)),
        "variety": vote(c["n_types"] * 5 >= n, (c["n_types"] * 20 < n) & (n < 5000)),
    }


def estimate_accuracies(votes: DataFrame, iterations: int = 12) -> dict:
    """EM over the counts of vote patterns (columns ``_v_<rule>`` and ``n``). Returns the prior and, by rule,
    ``good`` = P(votes good | good, votes) and ``bad`` = P(votes bad | bad, votes). Weak Beta priors keep rules
    better than chance, which also fixes which class is called good."""
    prior, good, bad = 0.7, [0.8] * len(RULES), [0.8] * len(RULES)
    for _ in range(iterations):
        p = votes.withColumn("r", _posterior(prior, good, bad))
        one = F.col("n") * F.col("r")
        zero = F.col("n") * (1 - F.col("r"))
        sums = [F.sum(one).alias("one"), F.sum(zero).alias("zero")]
        for k, rule in enumerate(RULES):
            v = F.col(f"_v_{rule}")
            sums += [F.sum(F.when(v == 1, one).otherwise(0.0)).alias(f"a{k}"), F.sum(F.when(v != 0, one).otherwise(0.0)).alias(f"b{k}"), F.sum(F.when(v == -1, zero).otherwise(0.0)).alias(f"c{k}"), F.sum(F.when(v != 0, zero).otherwise(0.0)).alias(f"d{k}")]
        s = p.agg(*sums).first()
        if not s["one"]:
            break
        prior = min(0.95, max(0.05, s["one"] / (s["one"] + s["zero"])))
        good = [min(0.99, max(0.55, (s[f"a{k}"] + 8) / (s[f"b{k}"] + 10))) for k in range(len(RULES))]
        bad = [min(0.99, max(0.55, (s[f"c{k}"] + 8) / (s[f"d{k}"] + 10))) for k in range(len(RULES))]
    return {"prior": prior, "good": dict(zip(RULES, good)), "bad": dict(zip(RULES, bad))}


def _posterior(prior: float, good: list[float], bad: list[float]) -> Column:
    import math

    logit = F.lit(math.log(prior / (1 - prior)))
    for rule, a, b in zip(RULES, good, bad):
        v = F.col(f"_v_{rule}")
        logit = logit + F.when(v == 1, math.log(a / (1 - b))).when(v == -1, math.log((1 - a) / b)).otherwise(0.0)
    return 1 / (1 + F.exp(-logit))


def judge(docs: DataFrame, keep_at: float = 0.5, columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``docs`` (all of them, if None) with columns ``_q_*``: the counts, the posterior
    ``_q_posterior``, ``_q_base_failed`` and ``_q_kept``. ``docs`` needs a ``text`` column."""
    n, repeats = F.col("_q_n_words"), F.col("_q_n_repeat_words")
    judged = _with_metrics(docs).withColumns({f"_v_{k}": v for k, v in _votes().items()})
    judged = judged.select(*(docs.columns if columns is None else columns), *[c for c in judged.columns if c.startswith(("_q_", "_v_"))])
    judged = materialize(judged, "quality-votes")
    patterns = materialize(judged.groupBy(*[f"_v_{r}" for r in RULES]).agg(F.count("*").alias("n")), "quality-patterns")
    model = estimate_accuracies(patterns)
    posterior = _posterior(model["prior"], [model["good"][r] for r in RULES], [model["bad"][r] for r in RULES])
    judged = judged.withColumn("_q_base_failed", (n < 50) | (100 * repeats > 50 * n)).withColumn("_q_posterior", posterior)
    return judged.withColumn("_q_kept", ~F.col("_q_base_failed") & (F.col("_q_posterior") >= keep_at)).drop(*[f"_v_{r}" for r in RULES])


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """One row per document: its counts, base verdict, posterior and verdict."""
    df = judge(docs, columns=["doc_id"])
    return df.select("doc_id", *[F.col(f"_q_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")], F.col("_q_posterior").alias("posterior"))


def filter_documents(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    return judge(docs).filter("_q_kept").select(*docs.columns)
