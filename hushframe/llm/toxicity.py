"""Toxicity by a weighted lexicon, matched by Aho-Corasick over folded text.

Folding makes variants alike: compatibility forms and accents go, letters of other scripts that look
Latin become Latin, digits and signs that stand for letters become them inside words, case goes, and
anything but letters parts words. The lexicon is learned: whole words, and word beginnings with several
endings, weighted by the log odds of the documents that hold them. An entry's match inside an exception
phrase doesn't count: phrases are given, or learned where a neighbour makes a match harmless. A document's
weight, per root of its length, becomes a score between 0 and 1 by a logistic curve.

Fitting uses at most ``MAX_FIT`` labelled documents, chosen by hash; counts are summed where the
documents are, and only words frequent enough in them come to the driver.

Defined cases: null and empty texts score as texts without matches; documents without label are scored;
contradicting labels count each; equal texts with one label count once; no labels, or labels of one kind, give an empty lexicon and score 0 for
all; repeated rows are each scored; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm.common import as_they_were, crc_of_id, in_one, make_importable, table, uniform

MAX_FIT = 20_000
FOLDS = 5
#: An entry needs so many toxic documents, and log odds of at least so much.
MIN_DOCS = 5
MIN_ODDS = 2.0
#: And this share of the toxic documents: a handful of near copies with a wrong label reaches less.
MIN_PART = 0.01
#: Evidence in nats that a term's documents are toxic more often than others by chance: words are tried
#: by the hundred thousand, beginnings with several endings are few.
MIN_EVIDENCE, MIN_STEM_EVIDENCE = 9.0, 9.0
#: A word beginning needs so many different words, and this length or more.
MIN_ENDINGS = 6
STEMS = (4, 5, 6)
EXCEPTIONS: tuple[str, ...] = ()
# Cyrillic and Greek letters and the Latin ones they look like.
LOOKS_LIKE = dict(zip("авекмнорстухіјѕԁɡһԛԝαβεικνορτυχγ", "abekmhopctyxijsdghqwabeiknoptuxy", strict=True)) | {"ı": "i", "ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe"}
# Digits and signs that stand for letters.
STANDS_FOR = dict(zip("0134579@$!|€", "oieastgasiie", strict=True))


class _Fold(dict):
    """A table for str.translate, filled as characters turn up."""

    def __missing__(self, code: int):
        c = chr(code)
        plain = "".join(x for x in unicodedata.normalize("NFKD", c.lower()) if not unicodedata.combining(x))
        plain = "".join(LOOKS_LIKE.get(x, x) for x in plain)
        if unicodedata.category(c) in ("Cf", "Mn"):  # joiners, marks
            out = ""
        elif plain and all(x.isalpha() or x in STANDS_FOR for x in plain):
            out = plain
        else:
            out = " "
        self[code] = out
        return out


_FOLD = _Fold()
_MIXED = re.compile("[" + re.escape("".join(STANDS_FOR)) + "]")
_WORD_WITH_SIGNS = re.compile("[^ ]*[" + re.escape("".join(STANDS_FOR)) + "][^ ]*")
_SIGNS = str.maketrans(STANDS_FOR)
_ENDS = "".join(c for c in STANDS_FOR if not c.isalnum())


def _signs(match: re.Match) -> str:
    word = match[0].strip(_ENDS) if not match[0].startswith(("@", "$")) else match[0].rstrip(_ENDS)
    if not any(c.isalpha() for c in word):
        return " "
    return word.translate(_SIGNS)


def fold(text: str | None) -> str:
    """Words of Latin letters where possible, parted by single blanks, with one at each end."""
    out = (text or "").translate(_FOLD)
    if _MIXED.search(out):
        out = _WORD_WITH_SIGNS.sub(_signs, out)
    return f" {' '.join(out.split())} "


@dataclass
class Lexicon:
    """Entries by folded form: ``" word "`` whole, ``" stem"`` a beginning; and the curve."""

    weights: Mapping[str, float]
    exceptions: Sequence[str] = ()
    slope: float = 1.0
    bias: float = 0.0
    _machine: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {"weights": self.weights, "exceptions": self.exceptions, "slope": self.slope, "bias": self.bias, "_machine": None}

    def machine(self):
        if self._machine is None:
            import ahocorasick

            found = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                found.add_word(entry, (len(entry), weight))
            for phrase in self.exceptions:
                found.add_word(fold(phrase), (len(fold(phrase)), None))
            found.make_automaton()
            self._machine = found
        return self._machine

    def raw(self, text: str | None) -> float:
        """Summed weights outside exception phrases, per root of the thousands of characters, at least one."""
        if not self.weights:
            return 0.0
        folded = fold(text)
        hits, spared = {}, []
        for end, (length, weight) in self.machine().iter(folded):
            start = end - length + 1
            if weight is None:
                spared.append((start, end))
            else:
                hits[start] = max(weight, hits.get(start, 0.0))  # of entries that start together, the heaviest
        if spared:
            hits = {s: w for s, w in hits.items() if not any(a <= s < b for a, b in spared)}
        return sum(hits.values()) / math.sqrt(max(1.0, len(folded) / 1000))

    def score(self, text: str | None) -> float:
        if not self.weights:
            return 0.0
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * self.raw(text) + self.bias))))


def terms_of(text: str | None) -> set[str]:
    """Folded words of three letters or more, and their beginnings."""
    words = {w for w in fold(text).split() if len(w) > 2}
    return {f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in STEMS if len(w) > n}


def evidence(bad: int, good: int, share: float) -> float:
    """Log likelihood of a term's own share of toxic documents against the share among all."""
    own = bad / (bad + good)
    return bad * math.log(own / share) + (good * math.log((1 - own) / (1 - share)) if good else 0.0)


def choose(counts: Iterable[tuple[str, int, int, int]], toxic: int, clean: int, exceptions: Sequence[str] = EXCEPTIONS) -> dict[str, float]:
    """Entries and weights from ``term, toxic documents, clean documents, different words``."""
    odds = {}
    for term, bad, good, words in counts:
        if bad < max(MIN_DOCS, MIN_PART * toxic) or (term[-1] != " " and words < MIN_ENDINGS):
            continue
        value = math.log((bad + 0.5) / (toxic + 1)) - math.log((good + 0.5) / (clean + 1))
        sure = evidence(bad, good, toxic / (toxic + clean))
        if value >= MIN_ODDS and sure >= (MIN_EVIDENCE if term[-1] == " " else MIN_STEM_EVIDENCE):
            odds[term] = value
    kept: dict[str, float] = {}
    for term in sorted(odds, key=lambda t: (len(t.rstrip()), t)):
        if not any(term[:n] in kept for n in range(5, len(term))):  # a beginning already covers it
            kept[term] = odds[term]
    return kept


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4) -> tuple[float, float]:
    """Slope and bias by Newton's method. Labels count as they are, so 0.5 is where errors are fewest."""
    a = np.stack([x, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (p - y) + penalty * len(y) * w * [1, 0]
        hessian = (a * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ a + np.diag([penalty * len(y), 1e-9])
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT, exceptions: Sequence[str] = EXCEPTIONS) -> Lexicon:
    """Learn from labelled documents outside the held-out fold: at most about ``max_fit`` of them."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.filter("id is not null and toxic in (0, 1)").filter(crc_of_id(F.col("id")) % FOLDS != 0).distinct()
    n = known.count()
    drawn = known.filter(uniform(F.col("id"), seed=11) <= min(1.0, max_fit / max(1, n)))
    # Copies of a text say no more than one of them.
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(drawn, "id").groupBy(F.xxhash64("text"), "toxic").agg(F.first("text").alias("text")).select("text", "toxic").persist()
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        rows.unpersist()
        return Lexicon({})

    def count(batches):
        bad, good = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch["text"], batch["toxic"], strict=True):
                (bad if label else good).update(terms_of(text))
        made = [(t, n_bad, good[t]) for t, n_bad in bad.items()] + [(t, 0, n_good) for t, n_good in good.items() if t not in bad]
        for lo in range(0, len(made), 50_000):
            yield pd.DataFrame(made[lo : lo + 50_000], columns=["term", "bad", "good"])

    counted = rows.mapInPandas(count, "term string, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).persist()
    # Each different word of toxic documents is one row by now, wherever its documents are.
    begun = F.explode(F.array(*[F.when(F.length("term") - 2 > k, F.substring("term", 1, k + 1)) for k in STEMS])).alias("term")
    endings = counted.filter("bad > 0 and endswith(term, ' ')").select(begun).filter("term is not null").groupBy("term").agg(F.count("*").alias("words"))
    odds = F.log((F.col("bad") + 0.5) / (toxic + 1)) - F.log((F.col("good") + 0.5) / (clean + 1))
    frequent = counted.filter((F.col("bad") >= MIN_DOCS) & (odds >= MIN_ODDS)).join(endings, "term", "left").fillna(0, ["words"]).collect()  # at most max_fit's words, few in practice
    counted.unpersist()
    weights = choose([(r["term"], r["bad"], r["good"], r["words"]) for r in frequent], toxic, clean)
    lexicon = Lexicon(weights, tuple(exceptions))
    if weights:
        lexicon = Lexicon(weights, (*exceptions, *_learn_exceptions(rows, lexicon)))

    def score(batches):
        for batch in batches:
            yield pd.DataFrame({"x": [lexicon.raw(t) for t in batch["text"]], "y": batch["toxic"]})

    scored = rows.mapInPandas(score, "x double, y int").toPandas()  # two numbers for each fitted document
    rows.unpersist()
    if not weights:
        return Lexicon({})
    slope, bias = logistic(scored["x"].to_numpy(), scored["y"].to_numpy())
    return Lexicon(weights, lexicon.exceptions, slope, bias) if slope > 0 else Lexicon({})


def _learn_exceptions(rows: DataFrame, lexicon: Lexicon) -> list[str]:
    """Two-word phrases around a match that clean documents hold and toxic ones hardly do."""

    def phrases(batches):
        found: Counter = Counter()
        machine = lexicon.machine()
        for batch in batches:
            for text, label in zip(batch["text"], batch["toxic"], strict=True):
                folded, seen = fold(text), set()
                for end, (length, weight) in machine.iter(folded):
                    if weight is None:
                        continue
                    start = end - length + 1
                    stop = folded.find(" ", start + 1)
                    before, after = folded.rfind(" ", 0, start), folded.find(" ", stop + 1)
                    seen |= {folded[before + 1 : stop] if before >= 0 else "", folded[start + 1 : after] if after > 0 else ""}
                found.update((p, int(label)) for p in seen if " " in p)
        yield pd.DataFrame([(p, y, n) for (p, y), n in found.items()], columns=["phrase", "toxic", "n"])

    counted = rows.mapInPandas(phrases, "phrase string, toxic int, n long").groupBy("phrase").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("good"))
    return sorted(r["phrase"] for r in counted.filter(f"good >= {MIN_DOCS} and good >= 10 * bad").collect())


def scored(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """All columns of ``docs`` and ``__toxicity``, which must not be one of them."""
    if "__toxicity" in docs.columns:
        raise ValueError("docs has a column __toxicity")

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return texts.map(lexicon.score, na_action=None).astype("float64")

    return docs.withColumn("__toxicity", score("text"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    make_importable(spark)
    docs = table(spark, sf_dir, "documents")
    out = scored(docs.select("doc_id", "text"), fit(docs, table(spark, sf_dir, "labels")))
    score = F.col("__toxicity")
    return out.select("doc_id", (crc_of_id(F.col("doc_id")) % FOLDS == 0).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: documents scored 0.5 or more go. The lexicon is fitted on the corpus's labelled documents.

    All columns come back as they were, whatever their names and types.
    """
    make_importable(spark)
    lexicon = fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return as_they_were(scored(in_one(docs, text=F.col("text")), lexicon).filter(F.col("__toxicity") < 0.5), docs)
