"""Licence scans by ordered signature rules, in built-in expressions only.

Each row is handled by itself: keywords present in the text choose groups of
rules, the regexes of those rules are tried, their matches become intervals,
and one sweep over the intervals in order of start drops each that lies within
one of the same or a higher priority. No shuffle, no Python.
"""

from __future__ import annotations

from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_rules import Rule, rules

NOT_WORD = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"  # in texts as they stand, so A-Z are letters
WORDS = f"[^{NOT_WORD}]+"
#: Base phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
CONFIDENCE = {1: 1.0, 2: 0.9, 3: 0.6}
BASE_CONFIDENCE = 0.5
#: Label of the rule for grants of unnamed licences: it counts only where no other rule is met.
FALLBACK = "other-licence"


def phrase_pattern(phrase: str) -> str:
    """The words of a phrase in a row, in either case of ASCII letters; only non-word characters between and around them."""
    return f"(?i)(?<![^{NOT_WORD}])" + f"[{NOT_WORD}]+".join(phrase.split()) + f"(?![^{NOT_WORD}])"


def _count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORDS)).cast("long")


def gate(keyword: str) -> tuple[Column, Column]:
    """Of a keyword: its words, and a regex of them in a row with any white space between, null for a single word."""
    words = keyword.split(" ")
    return F.array(*map(F.lit, words)).alias("words"), F.lit(r"\s+".join(words) if len(words) > 1 else None).cast("string").alias("gate")


def holds(low: Column, words: Column, gate: Column) -> Column:
    """Whether a keyword stands in the text: first all its words anywhere, then in a row."""
    return F.forall(words, lambda w: F.contains(low, w)) & (gate.isNull() | F.rlike(low, gate))


def _rule_groups(given: list[Rule]) -> Column:
    """Constant: an array of (words, gate, rules)."""
    order = sorted(given, key=lambda r: r.keyword)
    one = lambda r: F.struct(F.lit(r.priority).alias("priority"), F.lit(r.label).alias("label"), F.lit(r.pattern).alias("pattern"))
    return F.array(*[F.struct(*gate(k), F.array(*map(one, g)).alias("rules")) for k, g in groupby(order, lambda r: r.keyword)])


def _intervals(text: Column, rule: Column) -> Column:
    """The matches of one rule as an array of (start, neg_end, priority, label), from what stands between and in them."""
    between, found = F.split(text, rule["pattern"], -1), F.regexp_extract_all(text, rule["pattern"], F.lit(0))
    empty = F.lit(None).cast("array<struct<start:int,neg_end:int,priority:int,label:string>>")
    none = F.coalesce(empty, F.array().cast("array<struct<start:int,neg_end:int,priority:int,label:string>>"))

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["0"])
        end = start + F.length(pair["1"])
        return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(start.alias("start"), (-end).alias("neg_end"), rule["priority"].alias("priority"), rule["label"].alias("label"))).alias("out"))

    pairs = F.arrays_zip(F.slice(between, F.lit(1), F.size(found)).alias("0"), found.alias("1"))
    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])


def _kept(intervals: Column) -> Column:
    """(priority, label) of the intervals that lie in no other of the same or a higher priority."""
    kind = "array<struct<priority:int,label:string>>"
    first = F.struct(*[F.lit(-1).alias(f"m{p}") for p in (1, 2, 3)], F.array().cast(kind).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        end = -x["neg_end"]
        reach = F.when(x["priority"] == 1, acc["m1"]).when(x["priority"] == 2, acc["m2"]).otherwise(acc["m3"])
        most = [F.when(x["priority"] <= p, F.greatest(acc[f"m{p}"], end)).otherwise(acc[f"m{p}"]).alias(f"m{p}") for p in (1, 2, 3)]
        return F.struct(*most, F.when(reach >= end, acc["out"]).otherwise(F.array_append(acc["out"], F.struct(x["priority"].alias("priority"), x["label"].alias("label")))).alias("out"))

    return F.aggregate(F.array_sort(intervals), first, step, lambda acc: F.array_distinct(acc["out"]))


def license_scan(docs: DataFrame, given: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections) of each row.

    ``detections`` holds (priority, label) of the rules that stay; ``score`` is
    the highest confidence of a detection, BASE_CONFIDENCE for base phrases
    alone, else 0. Null and empty texts have no words and no labels (''), and
    null first_word and last_word. Rows are taken as they are, so repeated rows
    and null ids come out once for each row in; other columns are not read.
    """
    given = rules() if given is None else given
    text = F.coalesce(docs[text_col], F.lit(""))
    out = docs.select(docs[id_col].alias("doc_id"), text.alias("text")).withColumn("n_words", _count(F.col("text")))
    any_phrase = "|".join(phrase_pattern(p) for p, _ in PHRASES)
    out = out.withColumn("some", F.col("text").rlike(any_phrase))
    for i, (phrase, _) in enumerate(PHRASES):
        out = out.withColumn(f"p{i}", F.when(F.col("some"), F.split("text", phrase_pattern(phrase), -1)))
    place = lambda i: F.size(f"p{i}") - 1
    places = [F.when(F.col("some"), place(i)).otherwise(0) for i in range(len(PHRASES))]
    firsts = [F.when(F.col("some") & (place(i) > 0), _count(F.col(f"p{i}")[0])) for i in range(len(PHRASES))]
    lasts = [F.when(F.col("some") & (place(i) > 0), F.col("n_words") - len(p.split()) - _count(F.element_at(f"p{i}", -1))) for i, (p, _) in enumerate(PHRASES)]
    base = F.filter(F.array(*[F.when(n > 0, F.lit(label)) for n, (_, label) in zip(places, PHRASES, strict=True)]), lambda x: x.isNotNull())
    out = out.select("doc_id", "text", "n_words", reduce(lambda a, b: a + b, places).cast("long").alias("n_base"), F.least(*firsts).alias("first_word"), F.greatest(*lasts).alias("last_word"), F.array_sort(base).alias("base"))

    low = F.lower("text")
    hits = F.flatten(F.transform(F.filter(_rule_groups(given), lambda g: holds(F.col("low"), g["words"], g["gate"])), lambda g: F.flatten(F.transform(F.filter(g["rules"], lambda r: F.rlike(F.col("low"), r["pattern"])), lambda r: _intervals(F.col("low"), r)))))
    out = out.withColumn("low", low).withColumn("detections", _kept(hits))
    named = F.filter("detections", lambda d: d["label"] != FALLBACK)
    out = out.withColumn("detections", F.when(F.size(named) > 0, named).otherwise(F.col("detections")))
    scores = F.transform("detections", lambda d: F.when(d["priority"] == 1, CONFIDENCE[1]).when(d["priority"] == 2, CONFIDENCE[2]).otherwise(CONFIDENCE[3]))
    labels = F.array_sort(F.array_distinct(F.concat("base", F.transform("detections", lambda d: d["label"]))))
    score = F.coalesce(F.greatest(F.array_max(scores), F.when(F.col("n_base") > 0, F.lit(BASE_CONFIDENCE))), F.lit(0.0))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.concat_ws(",", "base").alias("base_labels"), F.concat_ws(",", labels).alias("labels"), score.alias("score"), "detections")
