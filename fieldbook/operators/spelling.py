"""Synonyms of street words from spelling rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldbook.operators.stored import removed, stored

# Spellings that stand for each other, and whether the second stands for the first too.
RULES = [
    ("gren", "green", True), ("sten", "steen", True), ("oester", "oestre", True), ("vester", "vestre", True), ("kaer", "kjaer", True),
    ("dal", "dahl", True), ("thor", "tor", True), ("scho", "sko", True), ("scho", "sjo", True), ("schr", "skr", True),
    ("schm", "sm", False), ("schn", "sn", False), ("schw", "sw", True), ("schw", "sv", False), ("qui", "kvi", True),
]
# Letters and how they are written out.
LETTERS = {"ä": "a", "ÿ": "y", "ó": "o", "ö": "o", "ü": "u", "é": "e", "è": "e", "ë": "e", "x": "ks", "æ": "ae", "ø": "oe", "å": "aa"}


# Fixed value: marks that stand between words.
MARKS = ".-/()',"


def written_out(name: Column) -> Column:
    """Lower case, marks between words as blanks, special letters written out."""
    text = F.translate(F.lower(name), MARKS, " " * len(MARKS))
    for letter, plain in LETTERS.items():
        text = F.replace(text, F.lit(letter), F.lit(plain))
    return text


def asked(query: str) -> str:
    """A query's text as ``written_out`` writes it; a * stays."""
    text = query.lower().translate(str.maketrans(MARKS, " " * len(MARKS)))
    for letter, plain in LETTERS.items():
        text = text.replace(letter, plain)
    return text


def forms(word: Column, rules: list[tuple[str, str, bool]], times: int = 3) -> Column:
    """All spellings of a word that the rules lead to, one after another; each rule changes a word's last match, up to ``times`` matches. A rule's sides should not hold each other, or words grow ``times`` times."""
    steps = [(a, b) for x, y, both in rules for _ in range(times) for a, b in ([(x, y), (y, x)] if both else [(x, y)])]
    table = F.array(*[F.struct(F.lit(f"^(.*){a}").alias("find"), F.lit(f"$1{b}").alias("put")) for a, b in steps])
    return F.aggregate(table, F.array(word), lambda found, r: F.array_distinct(F.concat(found, F.transform(found, lambda w: F.regexp_replace(w, r["find"], r["put"])))))


def synonym_groups(names: DataFrame, column: str, rules: list[tuple[str, str, bool]] | None = None) -> DataFrame:
    """word, synonyms: groups of two spellings or more of the words of distinct names, called by their first word.

    Words that share a spelling are one group, and so are words linked over others: labels are passed on over shared spellings,
    as joins on equal keys, until none changes. Groups hold the spellings of one word, so they stay small.
    """
    words = names.select(F.explode(F.split(written_out(F.col(column)), " +")).alias("word")).filter("word <> ''").distinct()
    links = stored(words.select("word", F.explode(forms(F.col("word"), rules or RULES)).alias("form")), "spellings")
    labels, before = words.select("word", F.col("word").alias("label")), None
    while True:
        by_form = links.join(labels, "word").groupBy("form").agg(F.min("label").alias("low"))
        fresh = links.join(by_form, "form").groupBy("word").agg(F.min("low").alias("low"))
        step = stored(labels.join(fresh, "word").select("word", F.least("label", "low").alias("label"), (F.col("low") < F.col("label")).alias("changed")), "labels")
        labels = step.select("word", "label")
        if before is not None:
            removed(before)
        before = step
        if step.filter("changed").isEmpty():
            break
    groups = links.join(labels, "word").groupBy(F.col("label").alias("word")).agg(F.array_sort(F.collect_set("form")).alias("synonyms"))
    return groups.filter(F.size("synonyms") > 1)
