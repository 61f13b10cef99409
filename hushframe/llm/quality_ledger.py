"""Quality rules as a bitmask ledger: measure once, store failure bits, apply versioned policies to the bits.

``ledger`` measures every text once and evaluates every rule once; what it gives (measurements and the
``failed`` mask, bit k for rule k of ``RULES``) is meant to be stored. ``apply_policy`` and ``ablations`` read
only the mask: a new policy, or the question what a rule costs, never reads a text again. ``ablations`` groups
by mask first (few distinct ones), so what is shuffled doesn't grow with the corpus.

Defined cases: a null or empty text has no words, fails ``few_words`` and gets zeros; rows without doc_id and
repeated rows are judged each for itself; ties don't arise; an empty table gives no rows; extra columns are
ignored by ``ledger``, and ``apply_policy`` keeps all columns of the ledger. Very long texts are measured whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm.common import WORD, make_importable, table

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Rule k sets bit k where its condition, over whole numbers only, holds. Never renumber: stored ledgers refer to it.
RULES = (
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "100 * n_symbols > 10 * n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("capitals", "100 * n_capital_words > 50 * n_words"),
    ("exclamations", "100 * n_exclamations > 30 * n_words"),
    ("no_letters", "100 * (n_words - n_letter_words) > 30 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("one_word", "100 * n_top_word > 40 * n_words"),
    ("stutters", "100 * n_stutters > 30 * n_words"),
)
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_windows"]
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capital_words", "n_exclamations", "n_letter_words", "n_top_word", "n_stutters")


@dataclass(frozen=True)
class Policy:
    """A text is dropped if it fails any rule of ``hard``, or more than ``allowed`` rules of ``soft``."""

    version: str
    hard: int
    soft: int = 0
    allowed: int = 0

    def rejects(self, failed: Column) -> Column:
        return (failed.bitwiseAND(F.lit(self.hard)) != 0) | (F.bit_count(failed.bitwiseAND(F.lit(self.soft))) > self.allowed)

    def without(self, rule: str) -> Policy:
        return Policy(f"{self.version} without {rule}", self.hard & ~BIT[rule], self.soft & ~BIT[rule], self.allowed)


#: Policies by version; a version never changes once ledgers have been judged by it.
POLICIES = {
    p.version: p
    for p in (
        Policy("base-1", BASE),
        Policy("strict-1", (1 << len(RULES)) - 1),
        Policy("prose-1", BASE | BIT["symbols"] | BIT["no_letters"] | BIT["one_word"] | BIT["stutters"], BIT["duplicate_lines"] | BIT["capitals"] | BIT["exclamations"] | BIT["short_words"] | BIT["long_words"], 1),
    )
}
DEFAULT = "prose-1"

_WORDS, _LETTER = re.compile(WORD), regex.compile(r"\p{L}")
_CAPITALS = re.compile(r"[^a-z]*[A-Z][^a-z]*[A-Z][^a-z]*", re.S)


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """How many words lie in windows found twice or more. Equal windows are told exactly, by ranks of ever longer runs."""
    rank, length = ids.astype(np.int64), 1
    while length < window:  # rank[i]: the run of `length` words that starts at i
        step = min(length, window - length)
        if len(rank) <= step:
            return 0
        pair = rank[:-step] * (rank.max() + 1) + rank[step:]
        rank = np.unique(pair, return_inverse=True)[1]
        length += step
    twice = np.flatnonzero(np.bincount(rank)[rank] > 1)
    if not twice.size:
        return 0
    edges = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edges, twice, 1)
    np.add.at(edges, twice + window, -1)
    return int((np.cumsum(edges) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The numbers of ``MEASURES`` for one whole text."""
    text = text or ""
    words = _WORDS.findall(text)
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    counts = np.bincount(ids, minlength=len(number))
    lines = [x for x in text.split("\n") if _WORDS.search(x)]
    capital = np.fromiter((_CAPITALS.fullmatch(w) is not None for w in number), bool, len(number))
    letter = np.fromiter((w.isalpha() or _LETTER.search(w) is not None for w in number), bool, len(number))
    return (
        len(words),
        sum(map(len, words)),
        sum(map(text.count, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(ids),
        int(counts[capital].sum()),
        text.count("!"),
        int(counts[letter].sum()),
        int(counts.max(initial=0)),
        int((ids[1:] == ids[:-1]).sum()),
    )


def _measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = pd.DataFrame([measure(t) for t in batch["text"]], columns=list(MEASURES), dtype="int64")
        found.insert(0, "doc_id", batch["doc_id"].to_numpy())
        yield found


def ledger(docs: DataFrame) -> DataFrame:
    """``doc_id``, the measurements, and ``failed``: the mask of rules that the text fails."""
    make_importable(docs.sparkSession)
    schema = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bits = " | ".join(f"if({condition}, {1 << k}L, 0L)" for k, (_, condition) in enumerate(RULES))
    return rows.mapInPandas(_measured, schema).withColumn("failed", F.expr(bits))


def apply_policy(ledger_: DataFrame, policy: Policy | str = DEFAULT) -> DataFrame:
    """The ledger with ``base_failed``, ``kept`` and the policy's version; no text is read."""
    policy = POLICIES[policy] if isinstance(policy, str) else policy
    failed = F.col("failed")
    base = failed.bitwiseAND(F.lit(BASE)) != 0
    return ledger_.withColumns({"base_failed": base, "kept": ~(base | policy.rejects(failed)), "policy": F.lit(policy.version)})


def ablations(ledger_: DataFrame, policies: list[Policy] | None = None) -> DataFrame:
    """For each policy and rule of it: documents the policy keeps, those that fail the rule, those that only it drops.

    ``policy, rule, documents, kept, failing, dropped_by_it_alone, together_with``: the last is the mask of the
    other rules that documents failing the rule fail too.
    """
    masks = ledger_.groupBy("failed").agg(F.count("*").alias("n"))
    asked = [(p, name, bit) for p in (policies or POLICIES.values()) for name, bit in BIT.items() if (p.hard | p.soft) & bit]
    failed, n = F.col("failed"), F.col("n")
    total = lambda c: F.sum(F.when(c, n).otherwise(0))
    cases = F.explode(F.array(*(_case(p, name, bit, failed) for p, name, bit in asked)))
    rows = masks.select("n", "failed", cases.alias("x")).select("n", "failed", "x.*")
    return rows.groupBy("policy", "rule").agg(
        F.sum("n").alias("documents"),
        total(~F.col("rejected")).alias("kept"),
        total(F.col("fails")).alias("failing"),
        total(F.col("rejected") & ~F.col("rejected_without")).alias("dropped_by_it_alone"),
        F.coalesce(F.bit_or(F.when(F.col("fails"), failed.bitwiseAND(F.bitwise_not(F.col("bit"))))), F.lit(0)).alias("together_with"),
    )


def _case(policy: Policy, name: str, bit: int, failed: Column) -> Column:
    fields = {"policy": F.lit(policy.version), "rule": F.lit(name), "bit": F.lit(bit).cast("long"), "fails": failed.bitwiseAND(F.lit(bit)) != 0, "rejected": policy.rejects(failed), "rejected_without": policy.without(name).rejects(failed)}
    return F.struct(*(c.alias(k) for k, c in fields.items()))


def op13_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = apply_policy(ledger(table(spark, sf_dir, "documents")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


def oracle_sql(policy: Policy = POLICIES[DEFAULT]) -> str:
    """DuckDB SQL of the query."""
    bits = " | ".join(f"(CASE WHEN {condition} THEN {1 << k} ELSE 0 END)" for k, (_, condition) in enumerate(RULES))
    run = " || ' ' || ".join(f"lead(word, {k}) OVER (PARTITION BY r ORDER BY i)" for k in range(WINDOW))
    return rf"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        w AS (SELECT r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM d),
        runs AS (SELECT r, i, {run} AS run, word = lag(word) OVER (PARTITION BY r ORDER BY i) AS stutter FROM w),
        windows AS (SELECT r, i, count(*) OVER (PARTITION BY r, run) AS times FROM runs WHERE run IS NOT NULL),
        repeated AS (SELECT r, count(DISTINCT place) AS n FROM (SELECT r, unnest(range(i, i + {WINDOW})) AS place FROM windows WHERE times > 1) GROUP BY r),
        lines AS (SELECT r, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
        tops AS (SELECT r, max(n) AS n FROM (SELECT r, word, count(*) AS n FROM w GROUP BY ALL) GROUP BY r),
        stutters AS (SELECT r, count(*) AS n FROM runs WHERE stutter GROUP BY r),
        m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
                CAST(coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
                CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
                coalesce(lines.n, 0) AS n_lines, CAST(coalesce(lines.dup, 0) AS BIGINT) AS n_dup_lines,
                CAST(coalesce(repeated.n, 0) AS BIGINT) AS n_repeat_words,
                len(list_filter(words, lambda w: regexp_full_match(w, '(?s)[^a-z]*[A-Z][^a-z]*[A-Z][^a-z]*'))) AS n_capital_words,
                len(regexp_extract_all(text, '!')) AS n_exclamations,
                len(list_filter(words, lambda w: regexp_matches(w, '\pL'))) AS n_letter_words,
                coalesce(tops.n, 0) AS n_top_word,
                coalesce(stutters.n, 0) AS n_stutters
              FROM d LEFT JOIN repeated USING (r) LEFT JOIN lines USING (r) LEFT JOIN tops USING (r) LEFT JOIN stutters USING (r)),
        j AS (SELECT *, CAST({bits} AS BIGINT) AS failed FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & {BASE}) <> 0 AS base_failed,
               (failed & {BASE | policy.hard}) = 0 AND bit_count(failed & {policy.soft}) <= {policy.allowed} AS kept, failed
        FROM j"""
