"""Heuristic rules for names, organisations and schools, in built-in expressions.

Each rule finds its anchors (an honorific, a surname, a legal form, a school's ending) with offsets and
then looks at a window of bounded width beside each, so cost is linear in the text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from hushframe.functions import ner_data as D
from hushframe.functions.patterns import java
from hushframe.functions.spans import find_all, guarded, no_spans, span, spans_of

HAN = r"\p{script=Han}"
KANA = r"\p{script=Hiragana}\p{script=Katakana}ー"
ORG_CHARS = r"[\p{script=Han}\p{script=Katakana}A-Za-z0-9・ー]"
SCHOOL_CHARS = r"[\p{script=Han}\p{script=Katakana}A-Za-z]"
MAX_ORG, MAX_SCHOOL = 20, 12


def alternation(words: Sequence[str]) -> str:
    """Longest first; among equals in the order given."""
    special = set("().")
    return "|".join("".join("\\" + c if c in special else c for c in w) for w in sorted(dict.fromkeys(words), key=lambda w: -len(w)))


HONORIFIC = alternation(D.HONORIFICS)
STOP = alternation([*D.HONORIFICS, *D.PARTICLES])
AFTER_SURNAME = rf"\A[ \u3000]?+(?!{STOP})(?:{HAN}{{1,3}}+(?!{HAN})|[{KANA}]{{2,4}}+(?![{KANA}]))"
LABELLED = java(rf"(?:{'|'.join(D.NAME_LABELS)})[:：][<s>]*([^<s>、。,.!?:：;；\[\]]{{2,20}})")
ROMAJI_NAME = java(r"<(b>[A-Z][a-z]{1,15} [A-Z][a-z]{1,15}<b)>")
ENGLISH_ORG = java(r"<(b>[A-Z][A-Za-z0-9&.\-]*(?: [A-Z][A-Za-z0-9&.\-]*){0,3},? (?:Inc|Corp|Corporation|LLC|Ltd|GmbH|K\.K)\.?(?=<b>)")
BRACKETS = r"\[[^\[\]]*\]"


#: Han and kana, roughly: what texts without them can't hold, they aren't searched for.
JAPANESE = r"[\u3005-\u30FF\u3400-\u9FFF\uF900-\uFAFF]"


def bracket_ranges(text: str) -> Column:
    found = F.transform(find_all(text, BRACKETS), lambda x: F.struct(x["s"].alias("a"), (x["s"] + F.length(x["m"])).alias("b")))
    return F.when(F.expr(f"contains({text}, '[')"), found).otherwise(F.expr("cast(array() as array<struct<a: int, b: int>>)"))


def free(ranges: Column, start: Column, end: Column) -> Column:
    return ~F.exists(ranges, lambda r: (start < r["b"]) & (end > r["a"]))


def unbracketed(found: Column, ranges: Column) -> Column:
    return F.filter(found, lambda x: free(ranges, x["s"], x["s"] + F.length(x["m"])))


def before(text: Column, at: Column, n: int) -> Column:
    """Up to n characters left of an offset."""
    return F.substring(text, F.greatest(at - n, F.lit(0)) + 1, F.least(at, F.lit(n)))


def honorific_names(text: str, ranges: Column, surnames: Sequence[str]) -> Column:
    """R1: the longest surname of up to three Han characters before an honorific; R2: else two or three
    Han characters, unless what stands there is no name."""
    whole = F.expr(text)
    anchors = unbracketed(find_all(text, HONORIFIC), ranges)
    seen = F.transform(anchors, lambda x: F.struct(x["s"].alias("s"), F.regexp_extract(before(whole, x["s"], 3), rf"{HAN}{{1,3}}\z", 0).alias("run"), before(whole, x["s"], 4).alias("left")))
    known = lambda x, n: (F.length(x["run"]) >= n) & F.substring(x["run"], -n, n).isin(list(surnames))
    r1 = lambda x: F.when(known(x, 3), 3).when(known(x, 2), 2).when(known(x, 1), 1).otherwise(0)
    judged = F.transform(seen, lambda x: F.struct(x["s"].alias("s"), x["run"].alias("run"), x["left"].alias("left"), r1(x).alias("n")))
    denied = lambda x: x["left"].rlike(f"(?:{alternation(D.NOT_NAMES)})\\z")
    taken = F.filter(judged, lambda x: (x["n"] > 0) | ((F.length(x["run"]) >= 2) & ~denied(x)))
    sized = F.transform(taken, lambda x: F.struct(x["s"].alias("s"), F.when(x["n"] > 0, x["n"]).otherwise(F.length(x["run"])).alias("k"), (x["n"] > 0).alias("sure")))
    fine = F.filter(sized, lambda x: free(ranges, x["s"] - x["k"], x["s"]))
    made = F.transform(fine, lambda x: F.struct(F.substring(whole, x["s"] - x["k"] + 1, x["k"]).alias("text"), F.lit("NAME").alias("category"), (x["s"] - x["k"]).alias("start"), x["s"].alias("end"), F.when(x["sure"], 0.9).otherwise(0.75).alias("confidence")))
    return guarded(text, made, (), JAPANESE)


def full_names(text: str, ranges: Column, surnames: Sequence[str]) -> Column:
    """R3: a surname and a given name that ends where its script does."""
    whole = F.expr(text)
    found = F.transform(find_all(text, alternation(surnames)), lambda x: F.struct(x["s"].alias("s"), F.length(x["m"]).alias("n"), F.regexp_extract(F.substring(whole, x["s"] + F.length(x["m"]) + 1, F.lit(7)), AFTER_SURNAME, 0).alias("rest")))
    fine = F.filter(found, lambda x: (x["rest"] != "") & free(ranges, x["s"], x["s"] + x["n"] + F.length(x["rest"])))
    made = F.transform(fine, lambda x: span(F.substring(whole, x["s"] + 1, x["n"] + F.length(x["rest"])), "NAME", x["s"], x["s"] + x["n"] + F.length(x["rest"]), 0.8))
    return guarded(text, made, (), JAPANESE)


def labelled_names(text: str, ranges: Column) -> Column:
    """R4: what follows a label."""
    start = lambda x: x["s"] + F.length(x["m"]) - F.length(x["g"])
    fine = F.filter(find_all(text, LABELLED, 1), lambda x: free(ranges, start(x), x["s"] + F.length(x["m"])))
    return guarded(text, spans_of(fine, "NAME", 0.85, start), (), JAPANESE)


def romaji_names(text: str, ranges: Column) -> Column:
    """R5: two capitalised words of which one is a surname."""
    known = lambda x, k: F.lower(F.split_part(x["m"], F.lit(" "), F.lit(k))).isin(list(D.ROMAJI))
    fine = F.filter(find_all(text, ROMAJI_NAME), lambda x: known(x, 1) | known(x, 2))
    return spans_of(unbracketed(fine, ranges), "NAME", 0.8)


def first_letters(words: Sequence[str], after: str = "") -> str:
    """Matches the first letter of any of some words, so that overlapping words are all found."""
    esc = lambda w: "".join("\\" + c if c in "()." else c for c in w)
    longer = lambda w: "".join(f"(?<!{o[: len(o) - len(w)]})" for o in words if o != w and o.endswith(w))
    return "|".join(f"{longer(w)}{esc(w[0])}(?={esc(w[1:])}{after})" for w in words)


def legal_form_orgs(text: str, ranges: Column) -> Column:
    """O1 and O2: a legal form with a name of 2 to 20 characters after it, before it, or both."""
    whole = F.expr(text)
    form = lambda x: F.regexp_extract(F.substring(whole, x["s"] + 1, F.lit(max(map(len, D.LEGAL_FORMS)))), rf"\A(?:{alternation(D.LEGAL_FORMS)})", 0)
    placed = F.transform(find_all(text, first_letters(D.LEGAL_FORMS)), lambda x: F.struct(x["s"].alias("s"), form(x).alias("form")))
    found = F.transform(placed, lambda x: F.struct(x["s"].alias("s"), (x["s"] + F.length(x["form"])).alias("e"), x["form"].alias("form"), F.regexp_extract(F.substring(whole, x["s"] + F.length(x["form"]) + 1, F.lit(MAX_ORG)), rf"\A{ORG_CHARS}{{2,}}", 0).alias("after"), F.regexp_extract(before(whole, x["s"], MAX_ORG), rf"{ORG_CHARS}{{2,}}\z", 0).alias("left")))
    o1 = F.filter(found, lambda x: (x["after"] != "") & free(ranges, x["s"], x["e"] + F.length(x["after"])))
    o2 = F.filter(found, lambda x: (x["left"] != "") & free(ranges, x["s"] - F.length(x["left"]), x["e"]))
    made = F.concat(F.transform(o1, lambda x: span(F.concat(x["form"], x["after"]), "ORG", x["s"], x["e"] + F.length(x["after"]), 0.9)), F.transform(o2, lambda x: span(F.concat(x["left"], x["form"]), "ORG", x["s"] - F.length(x["left"]), x["e"], 0.9)))
    return guarded(text, made, (), "会社|法人|[(][株有][)]|[㈱㈲]")


def english_orgs(text: str, ranges: Column) -> Column:
    """O3: capitalised words and a company's suffix."""
    return guarded(text, spans_of(unbracketed(find_all(text, ENGLISH_ORG), ranges), "ORG", 0.85), (), r" (?:Inc|Corp|LLC|Ltd|GmbH|K\.K)")


def schools(text: str, ranges: Column) -> Column:
    """S1: a school's ending after 2 to 12 letters, not followed by one; of endings that end together the longest."""
    whole = F.expr(text)
    ending = lambda x: F.regexp_extract(F.substring(whole, x["s"] + 1, F.lit(max(map(len, D.SCHOOL_ENDINGS)) + 1)), rf"\A(?:{alternation(D.SCHOOL_ENDINGS)})(?!{SCHOOL_CHARS})", 0)
    found = find_all(text, first_letters(D.SCHOOL_ENDINGS, f"(?!{SCHOOL_CHARS})"))
    seen = F.transform(found, lambda x: F.struct(x["s"].alias("s"), ending(x).alias("e"), F.regexp_extract(before(whole, x["s"], MAX_SCHOOL), rf"{SCHOOL_CHARS}{{2,}}\z", 0).alias("left")))
    fine = F.filter(seen, lambda x: (x["left"] != "") & ~x["left"].isin(list(D.NOT_SCHOOLS)) & free(ranges, x["s"] - F.length(x["left"]), x["s"] + F.length(x["e"])))
    made = F.transform(fine, lambda x: span(F.concat(x["left"], x["e"]), "SCHOOL", x["s"] - F.length(x["left"]), x["s"] + F.length(x["e"]), 0.85))
    return guarded(text, made, (), "[学校園院]")


def claimed_apart(names: Column, claimed: Column) -> Column:
    """Names that overlap no organisation or school, whether or not that one wins."""
    return F.filter(names, lambda n: ~F.exists(claimed, lambda c: (n["start"] < c["end"]) & (n["end"] > c["start"])))


def claimed_spans(text: str, ranges: Column, categories: Sequence[str]) -> Column:
    """Organisations, then schools."""
    parts = [legal_form_orgs(text, ranges), english_orgs(text, ranges)] if "ORG" in categories else []
    parts += [schools(text, ranges)] if "SCHOOL" in categories else []
    return F.concat(*parts) if parts else no_spans()


def name_spans(text: str, ranges: Column, surnames: Sequence[str] | None = None) -> Column:
    listed = tuple(surnames) if surnames is not None else D.SURNAMES
    return F.concat(honorific_names(text, ranges, listed), full_names(text, ranges, listed), labelled_names(text, ranges), romaji_names(text, ranges))
