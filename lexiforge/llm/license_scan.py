"""License scan with ordered signature rules, in DataFrame operations only.

A text becomes its words, joined by single blanks. A search for a few
strings picks the texts that can hold a signature at all; in these, a rule
runs only where one of its keywords occurs. A rule marks its matches, so that one split
into words gives all first and last words. A detection that lies inside another
one of at least its priority is dropped.

The rules are the product of the license names below and the phrases that
introduce them.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.url_reputation import LOWER, UPPER


class Rule(NamedTuple):
    label: str
    keyword: str | tuple[str, ...]  # begins a word of every match; or one of these does
    pattern: str  # over words joined by blanks; must match whole words
    priority: int  # 0 to 3
    confidence: float
    base: bool = False


# Label, a word that every match contains (or some of which it has one), pattern of the license's names in lower-cased words.
NAMES = [
    ("mit", ("mit licen", "expat licen", "x11 licen"), r"(?:mit|expat|x11) licen[cs]e"),
    ("apache-2", "apache", r"apache (?:software )?licen[cs]e (?:version |v )?2(?: 0)?|apache 2(?: 0)?"),
    ("apache-1.1", "apache", r"apache (?:software )?licen[cs]e (?:version |v )?1 1"),
    ("apache", "apache", r"apache (?:software )?licen[cs]e"),
    ("gpl-3", "general", r"(?:gnu )?general public licen[cs]e (?:version |v )?3(?: 0)?"),
    ("gpl-2", "general", r"(?:gnu )?general public licen[cs]e (?:version |v )?2(?: 0)?"),
    ("gpl", "general", r"(?:gnu )?general public licen[cs]e"),
    ("gpl-3", "gpl", r"(?:gnu )?gpl ?(?:version |v )?3(?: 0)?|gplv3"),
    ("gpl-2", "gpl", r"(?:gnu )?gpl ?(?:version |v )?2(?: 0)?|gplv2"),
    ("lgpl-3", "lesser", r"(?:gnu )?lesser general public licen[cs]e (?:version |v )?3(?: 0)?"),
    ("lgpl-2.1", "lesser", r"(?:gnu )?lesser general public licen[cs]e (?:version |v )?2 1"),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public licen[cs]e"),
    ("lgpl-2", "library", r"(?:gnu )?library general public licen[cs]e(?: (?:version |v )?2(?: 0)?)?"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl(?: ?(?:version |v )?[23](?: [01])?)?"),
    ("agpl-3", "affero", r"(?:gnu )?affero general public licen[cs]e(?: (?:version |v )?3(?: 0)?)?"),
    ("agpl-3", "agpl", r"(?:gnu )?agpl ?(?:version |v )?3(?: 0)?|agplv3"),
    ("gfdl", "documentation", r"(?:gnu )?free documentation licen[cs]e(?: (?:version |v )?1 [1-3])?"),
    ("bsd-3", "bsd", r"(?:bsd 3 clause|(?:new|modified|revised|3 clause|three clause) bsd) licen[cs]e"),
    ("bsd-2", "bsd", r"(?:bsd 2 clause|(?:simplified|freebsd|2 clause|two clause) bsd) licen[cs]e"),
    ("bsd-4", "bsd", r"(?:bsd 4 clause|(?:original|4 clause|four clause) bsd) licen[cs]e"),
    ("bsd-0", ("0bsd", "bsd"), r"(?:0bsd|bsd 0 clause|zero clause bsd)(?: licen[cs]e)?"),
    ("bsd", "bsd", r"bsd(?: style)? licen[cs]e"),
    ("mpl-2", "mozilla", r"mozilla public licen[cs]e (?:version |v )?2(?: 0)?"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[cs]e (?:version |v )?1 1"),
    ("mpl", "mozilla", r"mozilla public licen[cs]e"),
    ("epl-2", "eclipse", r"eclipse public licen[cs]e (?:version |v )?2(?: 0)?"),
    ("epl-1", "eclipse", r"eclipse public licen[cs]e (?:version |v )?1(?: 0)?"),
    ("cddl-1", "distribution", r"common development and distribution licen[cs]e(?: (?:version |v )?1 [01])?"),
    ("cc-by-nc-nd", ("nd", "attribution"), r"cc by nc nd(?: [1-4] [05])?|creative commons attribution non ?commercial no ?deriv(?:s|atives)"),
    ("cc-by-nc-sa", "sa", r"cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "attribution", r"creative commons attribution non ?commercial share ?alike"),
    ("cc-by-nc", "nc", r"cc by nc(?: [1-4] [05])?"),
    ("cc-by-nc", "attribution", r"creative commons attribution non ?commercial"),
    ("cc-by-nd", "nd", r"cc by nd(?: [1-4] [05])?"),
    ("cc-by-sa", "sa", r"cc by sa(?: [1-4] [05])?"),
    ("cc-by-sa", "attribution", r"creative commons attribution share ?alike"),
    ("cc-by", "cc", r"cc by(?: [1-4] [05])?"),
    ("cc-by", "attribution", r"creative commons attribution"),
    ("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "want", r"do what the fuck you want to public licen[cs]e"),
    ("isc", "isc", r"isc licen[cs]e"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e"),
    ("boost-1", "boost", r"boost software licen[cs]e(?: (?:version |v )?1 0)?"),
    ("artistic-2", "artistic", r"artistic licen[cs]e(?: (?:version |v )?2 0)?"),
    ("ofl-1.1", "font", r"(?:sil )?open font licen[cs]e(?: (?:version |v )?1 1)?"),
    ("eupl", "european", r"european union public licen[cs]e(?: (?:version |v )?1 [0-2])?"),
    ("psf", "python", r"python software foundation licen[cs]e"),
    ("odbl", "database", r"open (?:data commons open )?database licen[cs]e"),
]
# What may stand around a name, priority and confidence; {} is the name.
FORMS = [
    ("(?:licen[cs]ed|released|distributed|available|published|covered|provided|redistributed) under (?:the )?(?:terms of )?(?:the )?(?:{})", 3, 1.0),
    ("spdx licen[cs]e identifier (?:{})", 3, 1.0),
    ("(?:terms|conditions|copy) of (?:the )?(?:{})", 2, 0.9),
    ("(?:under|see|subject to|governed by|accordance with) (?:the )?(?:{})", 2, 0.8),
    ("licen[cs]e (?:type |name |is )?(?:the )?(?:{})", 2, 0.8),
]
# Signatures that name no license of the table.
OTHERS = [
    Rule("proprietary", "rights", "all rights reserved", 1, 0.5),
    Rule("proprietary", "proprietary", "proprietary and confidential", 2, 0.8),
    Rule("public-domain", "domain", "(?:placed|released|dedicated) (?:in|into|to) the public domain", 3, 0.9),
    Rule("public-domain", "domain", "public domain (?:dedication|work)", 2, 0.8),
    Rule("mit", "charge", "permission is hereby granted free of charge to any person obtaining a copy", 3, 1.0),
    Rule("bsd", "binary", "redistribution and use in source and binary forms with or without modification", 3, 1.0),
    Rule("isc", "fee", "permission to use copy modify and or distribute this software for any purpose with or without fee", 3, 1.0),
    Rule("mit", "mit", "(?:licen[cs]ed under (?:the )?|spdx licen[cs]e identifier |licen[cs]e )mit", 3, 0.9),
    Rule("no-license", "unlicensed", "unlicensed", 1, 0.5),
]
# Phrases that always count, and their labels.
BASE = [
    Rule("mit", "mit", "under the mit license", 0, 0.8, True),
    Rule("apache-2", "apache", "apache license version 2", 0, 0.8, True),
    Rule("cc-by-nc", "nc", "cc by nc", 0, 0.8, True),
]
#: What every signature has at least one of, in lower-cased raw text: parts of words, and whole words. They only
#: decide which texts are looked at more closely.
PARTS = ("licen", "gpl", "apache", "bsd", "rights", "domain", "creative", "proprietary", "permission", "redistribution")
WHOLE = ("cc", "cc0")


def signature_rules() -> list[Rule]:
    """All rules: every form of every name, the names alone where they are more than a word, and the others."""
    named = [Rule(label, word, form.format(name), priority, sure)
             for label, word, name in NAMES for form, priority, sure in FORMS]
    alone = [Rule(label, word, f"(?:{name})", 1, 0.6) for label, word, name in NAMES]
    return [*named, *alone, *OTHERS, *BASE]


def keywords(rule: Rule) -> tuple[str, ...]:
    return (rule.keyword,) if isinstance(rule.keyword, str) else rule.keyword


def _words(text: Column) -> Column:
    lower = F.translate(text, UPPER, LOWER)
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")), F.lit(" "))


def _count_words(text: Column) -> Column:
    """One letter for each word with what follows it; what comes before the first word is left over."""
    word, other = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    return (F.length(F.regexp_replace(text, f"{word}+{other}*", "x"))
            - F.length(F.regexp_extract(text, f"^{other}*", 0))).cast("long")


def _may_match(low: Column, parts: tuple[str, ...], whole: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for p in parts:
        found = found | F.contains(low, F.lit(p))
    for w in whole:
        found = found | (F.contains(low, F.lit(w)) & low.rlike(f"(?<![0-9a-z]){w}(?![0-9a-z])"))
    return found


def scan_licenses(docs: DataFrame, rules: list[Rule] | None = None, parts: tuple[str, ...] = PARTS,
                  whole: tuple[str, ...] = WHOLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections``.

    ``detections``: what is left of the matches of all rules but the base ones,
    as an array of ``first, last`` (words from 0), ``priority, label, sure``.
    ``labels`` adds the base labels, which are never dropped. ``score`` is the
    greatest confidence among both, 0 without any. A null text is empty: no
    words, no labels. Rows are independent; null ids stay, repeated rows repeat
    their result, an empty table gives none.
    """
    rules = signature_rules() if rules is None else rules
    table = F.array(*[F.struct(F.lit(r.label).alias("label"),
                               F.array(*[F.lit(f" {k}") for k in keywords(r)]).alias("keywords"),
                               F.lit(f"(?<= )(?:{r.pattern})(?= )").alias("pattern"), F.lit(r.priority).alias("priority"),
                               F.lit(r.confidence).alias("sure"), F.lit(r.base).alias("base")) for r in rules])
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"))
    d = d.withColumn("low", F.lower("text"))
    d = d.select("doc_id", _count_words(F.col("text")).alias("n_words"),
                 F.when(_may_match(F.col("low"), parts, whole), _words(F.col("text"))).alias("w"))

    def hits(r: Column) -> Column:
        """Places of a rule: the words that open and close its marked matches."""
        marked = F.split(F.trim(F.regexp_replace(F.col("w"), r["pattern"], F.lit("\x01$0\x02"))), " ")
        number = F.transform(marked, lambda w, i: F.struct(w.alias("w"), i.alias("i")))
        first = F.filter(number, lambda x: x["w"].startswith("\x01"))
        last = F.filter(number, lambda x: x["w"].endswith("\x02"))
        return F.zip_with(first, last, lambda a, b: F.struct(
            a["i"].cast("long").alias("first"), b["i"].cast("long").alias("last"), r["priority"].alias("priority"),
            r["label"].alias("label"), r["sure"].alias("sure"), r["base"].alias("base")))

    near = F.filter(table, lambda r: F.exists(r["keywords"], lambda k: F.contains(F.col("w"), k)))
    # a join of words may hold a match only in part: the pattern decides before places are worked out
    near = F.filter(near, lambda r: F.regexp_like(F.col("w"), r["pattern"]))
    kind = "array<struct<first:bigint,last:bigint,priority:int,label:string,sure:double,base:boolean>>"
    none = F.array().cast(kind)
    d = d.withColumn("found", F.when(F.col("w").isNull(), none).otherwise(F.flatten(F.transform(near, hits)).cast(kind)))
    d = d.select("doc_id", "n_words", "found")
    d = d.withColumn("base", F.filter("found", lambda x: x["base"]))
    # by first word, longest first, then by priority: what has come before can contain, never be contained
    by_place = F.array_sort(F.transform(F.filter("found", lambda x: ~x["base"]), lambda x: F.struct(
        x["first"].alias("first"), (-x["last"]).alias("minus_last"), (-x["priority"]).alias("minus_priority"),
        x["label"].alias("label"), x["sure"].alias("sure"))))
    levels = sorted({r.priority for r in rules})
    start = F.struct(F.array().cast("array<int>").alias("kept"), F.lit(-1).alias("i"),
                     *[F.lit(-1).cast("long").alias(f"end{p}") for p in levels])

    def step(acc: Column, x: Column) -> Column:
        last = -x["minus_last"]
        inside = F.lit(False)
        for p in levels:
            inside = inside | ((acc[f"end{p}"] >= last) & (-x["minus_priority"] <= p))
        return F.struct(F.when(inside, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(acc["i"] + 1))).alias("kept"),
                        (acc["i"] + 1).alias("i"),
                        *[F.when(~inside & (-x["minus_priority"] == p), F.greatest(acc[f"end{p}"], last))
                          .otherwise(acc[f"end{p}"]).alias(f"end{p}") for p in levels])

    d = d.withColumn("sorted", by_place)
    kept = F.transform(F.aggregate("sorted", start, step, lambda acc: acc["kept"]), lambda i: F.get("sorted", i))
    d = d.withColumn("detections", F.transform(kept, lambda x: F.struct(
        x["first"].alias("first"), (-x["minus_last"]).alias("last"), (-x["minus_priority"]).alias("priority"),
        x["label"].alias("label"), x["sure"].alias("sure"))))

    def joined(labels: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    base, more = F.transform("base", lambda x: x["label"]), F.transform("detections", lambda x: x["label"])
    sure = F.concat(F.transform("base", lambda x: x["sure"]), F.transform("detections", lambda x: x["sure"]))
    places = F.transform("base", lambda x: x["first"])
    return d.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
                    F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"),
                    joined(base).alias("base_labels"), joined(F.concat(base, more)).alias("labels"),
                    F.coalesce(F.array_max(sure), F.lit(0.0)).alias("score"), "detections")
