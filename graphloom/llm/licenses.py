"""License scanning by ordered signature rules behind a keyword prefilter, in DataFrame functions only."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.common import durable, lower_az


class Rule(NamedTuple):
    """A pattern over the text's words joined by single spaces; tried only where keyword stands as a word sequence."""

    label: str
    keyword: str
    pattern: str
    priority: int
    weight: float
    base: bool = False


#: The phrases that every scan reports, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Families: label, keyword that gates it, the name as a pattern, versions as words (a label gets them as a suffix).
FAMILIES = [
    ("apache", "apache", "apache(?: software)? licen[cs]e", ["1 0", "1 1", "2 0"]),
    ("gpl", "gnu", "gnu (?:general public licen[cs]e|gpl)", ["1", "2", "3", "2 0", "3 0"]),
    ("gpl", "gpl", "gpl", ["1", "2", "3", "2 0", "3 0"]),
    ("lgpl", "gnu", "gnu (?:lesser|library) general public licen[cs]e", ["2", "3", "2 0", "2 1", "3 0"]),
    ("lgpl", "lgpl", "lgpl", ["2", "3", "2 0", "2 1", "3 0"]),
    ("agpl", "gnu", "gnu affero general public licen[cs]e", ["1", "3", "3 0"]),
    ("agpl", "agpl", "agpl", ["1", "3", "3 0"]),
    ("gfdl", "gnu", "gnu free documentation licen[cs]e", ["1 1", "1 2", "1 3"]),
    ("mit", "mit", "mit(?: x11| expat)? licen[cs]e", []),
    ("bsd", "bsd", "bsd(?: style)? licen[cs]e", []),
    ("bsd-2-clause", "bsd", "(?:bsd 2 clause|simplified bsd)(?: licen[cs]e)?", []),
    ("bsd-3-clause", "bsd", "(?:bsd 3 clause|new bsd|modified bsd)(?: licen[cs]e)?", []),
    ("isc", "isc", "isc licen[cs]e", []),
    ("mpl", "mozilla", "mozilla public licen[cs]e", ["1 0", "1 1", "2 0"]),
    ("epl", "eclipse", "eclipse public licen[cs]e", ["1 0", "2 0"]),
    ("cddl", "cddl", "(?:common development and distribution licen[cs]e )?cddl", ["1 0", "1 1"]),
    ("eupl", "eupl", "(?:european union public licen[cs]e )?eupl", ["1 0", "1 1", "1 2"]),
    ("artistic", "artistic", "artistic licen[cs]e", ["1 0", "2 0"]),
    ("boost", "boost", "boost software licen[cs]e", ["1 0"]),
    ("zlib", "zlib", "zlib(?: libpng)? licen[cs]e", []),
    ("unlicense", "unlicense", "(?:the )?unlicense", []),
    ("wtfpl", "wtfpl", "wtfpl", ["1", "2"]),
    ("python", "python", "python software foundation licen[cs]e", ["2", "2 0"]),
    ("openssl", "openssl", "openssl licen[cs]e", []),
    ("ofl", "font", "(?:sil )?open font licen[cs]e", ["1 0", "1 1"]),
    ("odbl", "database", "open (?:data commons open )?database licen[cs]e", ["1 0"]),
    ("ms-pl", "microsoft", "microsoft public licen[cs]e", []),
    ("ms-rl", "microsoft", "microsoft reciprocal licen[cs]e", []),
    ("afl", "academic", "academic free licen[cs]e", ["2 1", "3 0"]),
    ("osl", "open", "open software licen[cs]e", ["1 0", "2 1", "3 0"]),
    ("qpl", "public", "q public licen[cs]e", ["1 0"]),
    ("cpl", "common", "common public licen[cs]e", ["1 0"]),
    ("cc0", "cc0", "cc0", ["1 0"]),
    ("cc0", "creative", "creative commons zero", ["1 0"]),
]

#: Creative Commons variants: the words after "cc", and after "creative commons"; versions hold for all.
CC = {
    "cc-by": ("by", "attribution"),
    "cc-by-sa": ("by sa", "attribution share ?alike"),
    "cc-by-nd": ("by nd", "attribution no ?deriv(?:s|atives|ative works)"),
    "cc-by-nc": ("by nc", "attribution non ?commercial"),
    "cc-by-nc-sa": ("by nc sa", "attribution non ?commercial share ?alike"),
    "cc-by-nc-nd": ("by nc nd", "attribution non ?commercial no ?deriv(?:s|atives|ative works)"),
}
CC_VERSIONS = ["1 0", "2 0", "2 5", "3 0", "4 0"]

#: Forms of a notice around a name, with priority and weight; {n} is the name, {v} the version's words.
FORMS = [
    ("(?:licensed|released|distributed|available|published|provided) under(?: the)?(?: terms of)?(?: the)? {n}", 40, 0.9),
    ("under(?: the)? terms (?:of|and conditions of)(?: the)? {n}", 35, 0.85),
    ("{n}", 20, 0.6),
]
VERSIONED = [
    ("(?:licensed|released|distributed|available|published|provided) under(?: the)?(?: terms of)?(?: the)? {n}(?: licen[cs]e)?(?: version| v)? {v}", 60, 1.0),
    ("{n}(?: licen[cs]e)?(?: version| v)? {v}", 50, 0.95),
    ("spdx licen[cs]e identifier {n} {v}(?: only| or later)?", 70, 1.0),
]

#: Notices that carry no name: label, keyword, pattern, weight.
TEXTS = [
    ("mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy", 0.95),
    ("isc", "permission", "permission to use copy modify and (?:or )?distribute this software for any purpose", 0.9),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification", 0.9),
    ("bsd-3-clause", "endorse", "neither the name of .{1,120}? may be used to endorse or promote products", 0.9),
    ("gpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu general public license", 0.95),
    ("public-domain", "public domain", "(?:released|dedicated|placed) (?:in|into|to) the public domain", 0.8),
    ("public-domain", "public domain", "this (?:work|text|page|file) is in the public domain", 0.8),
    ("proprietary", "rights reserved", "all rights reserved", 0.4),
    ("proprietary", "permission", "may not be reproduced without (?:prior )?(?:written )?permission", 0.5),
    ("warranty-disclaimer", "warranty", "(?:without|no) warranty of any kind", 0.3),
]


def rules() -> list[Rule]:
    """All rules in order: the base phrases, notices with and without a version, Creative Commons, unnamed notices."""
    out = [Rule(label, phrase, phrase, 30, 0.7, True) for phrase, label in BASE.items()]
    for label, keyword, name, versions in FAMILIES:
        out += [Rule(label, keyword, form.format(n=name), p, w) for form, p, w in FORMS]
        out += [
            Rule(f"{label}-{v.replace(' ', '.')}", keyword, form.format(n=name, v=v), p, w)
            for v in versions for form, p, w in VERSIONED
        ]
    for label, (short, long) in CC.items():
        for keyword, name in (("cc", f"cc {short}"), ("creative", f"creative commons {long}")):
            out.append(Rule(label, keyword, name, 22 + short.count(" "), 0.7))
            out += [Rule(f"{label}-{v.replace(' ', '.')}", keyword, f"{name}(?: licen[cs]e)?(?: version| v)? {v}", 55, 0.95) for v in CC_VERSIONS]
    out += [Rule(label, keyword, pattern, 45, w) for label, keyword, pattern, w in TEXTS]
    return out


def word_line(text: Column) -> Column:
    """The words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z, each between single spaces; ' ' if none."""
    padded = F.concat(F.lit(" "), lower_az(F.coalesce(text, F.lit(""))), F.lit(" "))
    return F.regexp_replace(padded, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")


def _spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def resolve(found: DataFrame, levels: list[int]) -> DataFrame:
    """found (row_id, rule, label, first, last, priority) with kept.

    From the highest priority down: a detection that overlaps a kept one of higher priority, before or behind it, is not
    kept, nor one inside another of its own priority; of equal ones the first label's, then the first rule's is. What
    was dropped drops nothing. Each level asks for the furthest end of kept detections up to here and for the nearest
    start behind here, which windows over one sorting answer, however many detections a document has."""
    order = Window.partitionBy("row_id").orderBy("first", F.desc("last"), "label", "rule")
    ahead = order.rowsBetween(Window.unboundedPreceding, -1)
    start = Window.partitionBy("row_id").orderBy("first")
    upto, behind = start.rangeBetween(Window.unboundedPreceding, 0), start.rangeBetween(1, Window.unboundedFollowing)
    false = F.lit(False)
    out = found.withColumn("kept", false)
    for level in sorted(levels, reverse=True):
        over = F.coalesce(F.max(F.when(F.col("kept"), F.col("last"))).over(upto) >= F.col("first"), false)
        under = F.coalesce(F.min(F.when(F.col("kept"), F.col("first"))).over(behind) <= F.col("last"), false)
        out = out.withColumn("alive", (F.col("priority") == level) & ~over & ~under)
        inside = F.coalesce(F.max(F.when(F.col("alive"), F.col("last"))).over(ahead) >= F.col("last"), false)
        out = out.withColumn("kept", F.col("kept") | (F.col("alive") & ~inside))
    return out.drop("alive")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, detections): (row_id, doc_id, n_words) per row of docs, and per detection (row_id, rule, label, base,
    first, last, priority, weight, kept); first and last are word positions from 0.

    A rule is tried only on texts with its keyword. Base phrases report every place. Of overlapping detections the one
    of higher priority is kept, of those of one priority the containing one; see resolve. Null counts as the empty
    text; texts of any length are read whole; rows without words or detections stay in the first table; other columns
    are not read."""
    spark = docs.sparkSession
    table = rules()
    keywords = sorted({r.keyword for r in table})
    held = F.concat_ws(",", *[F.when(F.contains("line", F.lit(f" {k} ")), F.lit(k)) for k in keywords])
    lines = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).alias("doc_id"), word_line(F.col(text_col)).alias("line"))
    seen = lines.select("row_id", "doc_id", F.greatest(_spaces(F.col("line")) - 1, F.lit(0)).cast("long").alias("n_words"), "line", held.alias("keywords"))
    seen = durable(seen.withColumn("line", F.when(F.col("keywords") != "", F.col("line"))))
    listed = spark.createDataFrame(
        [(i, r.label, r.keyword, f"(?<= )(?:{r.pattern})(?= )", r.priority, r.weight, r.base) for i, r in enumerate(table)],
        "rule int, label string, keyword string, pattern string, priority int, weight double, base boolean",
    )
    gated = seen.filter("line is not null").select("row_id", "line", F.explode(F.split("keywords", ",")).alias("keyword"))
    tried = gated.join(F.broadcast(listed), "keyword").filter("line rlike pattern")  # a fixed table of a few hundred rows
    places = tried.select(
        "row_id", "rule", "label", "priority", "weight", "base",
        F.posexplode(
            F.arrays_zip(
                F.transform(F.split("line", F.col("pattern"), -1), lambda x: _spaces(x)).alias("gap"),
                F.transform(F.regexp_extract_all("line", F.col("pattern"), F.lit(0)), lambda x: _spaces(x)).alias("wide"),
            )
        ).alias("at", "z"),
    )
    so_far = Window.partitionBy("row_id", "rule").orderBy("at")
    first = F.sum(F.col("z.gap") + F.coalesce("z.wide", F.lit(0))).over(so_far) - F.coalesce("z.wide", F.lit(0)) - 1
    found = places.withColumn("first", first.cast("long")).filter("z.wide is not null").select(
        "row_id", "rule", "label", "base", "first", (F.col("first") + F.col("z.wide")).alias("last"), "priority", "weight"
    )
    return seen.select("row_id", "doc_id", "n_words"), resolve(durable(found), sorted({r.priority for r in table}))


def license_summary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (0: nothing found)."""
    rows, found = scan_licenses(docs, id_col, text_col)
    when = lambda x: F.when(F.col("base"), x)
    joined = lambda x: F.array_join(F.array_sort(F.collect_set(x)), ",")
    per = found.groupBy("row_id").agg(
        F.count(when(F.lit(1))).alias("n_base"), F.min(when(F.col("first"))).alias("first_word"), F.max(when(F.col("first"))).alias("last_word"),
        joined(when(F.col("label"))).alias("base_labels"), joined(F.when(F.col("base") | F.col("kept"), F.col("label"))).alias("labels"),
        F.max(F.when(F.col("base") | F.col("kept"), F.col("weight"))).alias("score"),
    )
    return rows.join(per, "row_id", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
