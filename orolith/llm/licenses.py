"""License scans: ordered signature rules over a text's words, gated by keywords, overlaps resolved by containment.

A rule is a pattern of words. A text's words are written as `word|place ` in one string, so that a rule is one regular
expression whose matches carry their places, and every expression stays inside the engine. Only texts with a gate word
are rewritten, and only rules whose keyword the text has are run on them.

Rules have a tier: 1 notices and identifiers, 2 named licenses, 3 mere mentions. A detection that lies inside one of the
same or a better tier is suppressed; of equal intervals the first rule wins. The base phrases are rules too, and their
labels always stay.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SEPARATOR, WORD, ascii_lower

#: Base phrases and their labels: fixed values of the contract.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: label: names. A name is a word pattern: `a|b` one of, `?a` optional, `#` any number, `*8` up to eight words of any kind.
FAMILIES: dict[str, tuple[str, ...]] = {
    "mit": ("mit", "mit x11", "expat"),
    "x11": ("x11",),
    "mit-0": ("mit 0", "mit no attribution"),
    "apache-2": ("apache 2 ?0", "apache license 2 ?0", "apache license version 2 ?0", "apache software license ?version 2 ?0"),
    "apache-1": ("apache 1 0|1", "apache software license ?version 1 0|1"),
    "gpl-2": ("gpl v2", "gplv2", "gpl 2 ?0", "gpl version 2", "gnu general public license ?version 2 ?0", "gnu general public license v2"),
    "gpl-3": ("gpl v3", "gplv3", "gpl 3 ?0", "gpl version 3", "gnu general public license ?version 3 ?0", "gnu general public license v3"),
    "lgpl-2.1": ("lgpl v2 1", "lgplv2 1", "lgpl 2 1", "gnu lesser general public license ?version 2 1", "gnu library general public license ?version 2 ?0"),
    "lgpl-3": ("lgpl v3", "lgplv3", "lgpl 3 ?0", "gnu lesser general public license ?version 3 ?0"),
    "agpl-3": ("agpl v3", "agplv3", "agpl 3 ?0", "gnu affero general public license ?version 3 ?0", "affero gpl"),
    "gfdl": ("gnu free documentation license", "gfdl"),
    "bsd-2": ("bsd 2 clause", "2 clause bsd", "two clause bsd", "simplified bsd", "freebsd"),
    "bsd-3": ("bsd 3 clause", "3 clause bsd", "three clause bsd", "new bsd", "modified bsd", "revised bsd"),
    "bsd-4": ("bsd 4 clause", "4 clause bsd", "original bsd"),
    "0bsd": ("0bsd", "zero clause bsd"),
    "mpl-2": ("mpl 2 ?0", "mozilla public license ?version 2 ?0"),
    "mpl-1.1": ("mpl 1 1", "mozilla public license ?version 1 1"),
    "epl-1": ("epl 1 ?0", "eclipse public license ?version 1 ?0"),
    "epl-2": ("epl 2 ?0", "eclipse public license ?version 2 ?0"),
    "eupl": ("eupl ?v|version ?1 ?1|2", "european union public licence|license"),
    "cddl-1": ("cddl ?1 ?0", "common development and distribution license ?version ?1 ?0"),
    "cpl-1": ("cpl 1 0", "common public license ?version 1 0"),
    "isc": ("isc", "internet systems consortium"),
    "zlib": ("zlib", "zlib libpng"),
    "boost-1": ("boost software ?license ?version 1 0", "bsl 1 0", "boost 1 0"),
    "artistic-1": ("artistic ?license ?version 1 ?0", "perl artistic"),
    "artistic-2": ("artistic ?license ?version 2 ?0",),
    "python-2": ("psf ?license ?version ?2", "python software foundation"),
    "postgresql": ("postgresql",),
    "unlicense": ("unlicense",),
    "wtfpl": ("wtfpl ?version ?2",),
    "openssl": ("openssl",),
    "ofl-1.1": ("sil open font license ?version ?1 ?1", "ofl 1 1"),
    "odbl": ("odbl ?v ?1 ?0", "open database license"),
    "cc0": ("cc0 ?1 ?0", "cc zero", "creative commons zero"),
    "cc-by": ("cc by #", "creative commons attribution ?#", "creative commons by"),
    "cc-by-sa": ("cc by sa ?#", "creative commons attribution sharealike ?#", "creative commons attribution share alike ?#"),
    "cc-by-nd": ("cc by nd ?#", "creative commons attribution noderivatives|noderivs ?#", "creative commons attribution no derivatives ?#"),
    "cc-by-nc": ("cc by nc ?#", "creative commons attribution noncommercial ?#", "creative commons attribution non commercial ?#"),
    "cc-by-nc-sa": ("cc by nc sa ?#", "creative commons attribution noncommercial sharealike ?#"),
    "cc-by-nc-nd": ("cc by nc nd ?#", "creative commons attribution noncommercial noderivatives|noderivs ?#"),
}

#: Ways to state a license, for each name: tier and pattern.
STATEMENTS = (
    (1, "licensed|released|distributed|published|available|issued under ?the|a|an {} ?license|licence"),
    (1, "under the terms|conditions of ?the {} ?license|licence"),
    (1, "spdx license identifier {}"),
    (2, "{} license|licence"),
    (2, "license|licence is|under ?the {}"),
)

#: Notices and mentions that name no license by the ways above: label, tier, pattern.
NOTICES = (
    ("mit", 1, "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", 1, "the software is provided as is without warranty of any kind express or implied"),
    ("isc", 1, "permission to use copy modify and or distribute this software for any purpose"),
    ("bsd-3", 1, "neither the name of *8 nor the names of its contributors"),
    ("bsd-3", 1, "neither the name of *8 nor the names of contributors may be used to endorse or promote"),
    ("bsd-4", 1, "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("bsd-2", 1, "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("gpl-3", 1, "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license"),
    ("gpl-2", 1, "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license"),
    ("lgpl-2.1", 1, "under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license"),
    ("agpl-3", 1, "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license"),
    ("zlib", 1, "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("boost-1", 1, "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("cc0", 1, "to the extent possible under law *8 has waived all copyright and related or neighboring rights"),
    ("wtfpl", 1, "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed"),
    ("bsd-2", 2, "redistribution and use in source and binary forms with or without modification are permitted"),
    ("gpl", 1, "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", 2, "gnu general public license"),
    ("lgpl", 2, "gnu lesser general public license"),
    ("agpl", 2, "gnu affero general public license"),
    ("apache-2", 1, "apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache", 2, "apache license"),
    ("mpl-2", 1, "this source code form is subject to the terms of the mozilla public license v|version 2 ?0"),
    ("unlicense", 1, "this is free and unencumbered software released into the public domain"),
    ("zlib", 1, "this software is provided as is without any express or implied warranty"),
    ("public-domain", 2, "public domain"),
    ("proprietary", 2, "all rights reserved"),
    ("proprietary", 2, "proprietary and confidential"),
    ("creative-commons", 3, "creative commons"),
    ("unknown-license", 3, "licensed|released under ?the|a|an"),
    ("unknown-license", 3, "this work|document|software|program|text is licensed"),
)

#: A text without any of these has no detection: every rule needs one, or "cc" followed by "by" or "zero", or a verb of the
#: first statement followed by "under".
GATE_WORDS = ("licen", "gpl", "apache", "spdx", "commons", "permission", "warranty", "redistribution", "gnu", "unencumbered", "contributors", "terms", "conditions", "domain", "reserved", "confidential", "advertising", "acknowledgement", "misrepresented", "waived", "endorse", "verbatim", "redistributions")
GATE_CC = f"[cC][cC]{SEPARATOR}+(?:[bB][yY]|[zZ][eE][rR][oO])"
GATE_UNDER = f"(?:{STATEMENTS[0][1].split()[0]}){SEPARATOR}+under"
CONFIDENCE = {1: 1.0, 2: 0.9, 3: 0.5}


#: Words that tell little of a license, so no keywords if a rule has others.
GENERIC = frozenset("license licence licensed version software public general under terms the this work".split())


@dataclass(frozen=True)
class Rule:
    label: str
    tier: int
    pattern: str
    base: bool = False

    def keyword(self) -> str:
        """The longest word that every match has and that tells most."""
        needed = [x for x in self.pattern.split() if x[0] not in "?#*" and "|" not in x]
        return max(needed, key=lambda x: (x not in GENERIC and not x.isdigit(), len(x)))

    def regex(self) -> str:
        """Over `word|place ` strings."""
        out = []
        for slot in self.pattern.split():
            if slot.startswith("*"):
                out.append(f"(?:[^| ]+\\|[0-9]+ ){{0,{int(slot[1:])}}}?")
                continue
            optional, slot = slot.startswith("?"), slot.removeprefix("?")
            words = r"[0-9]+" if slot == "#" else "|".join(map(re.escape, slot.split("|")))
            out.append(f"(?:(?:{words})\\|[0-9]+ )" + "?" * optional)
        return "(?<![^ ])" + "".join(out)


def rules() -> list[Rule]:
    """All rules in order: the base phrases, notices, then each statement of each name of each family."""
    out = [Rule(label, 2, phrase, True) for phrase, label in BASE]
    out += [Rule(label, tier, pattern) for label, tier, pattern in NOTICES]
    out += [Rule(label, tier, statement.format(name)) for label, names in FAMILIES.items() for name in names for tier, statement in STATEMENTS]
    return out


def gated(text: Column) -> Column:
    """Whether a text has a gate word or pair, in any case."""
    low = F.lower(text)
    found = F.contains(low, F.lit(GATE_WORDS[0]))
    for word in GATE_WORDS[1:]:
        found = found | F.contains(low, F.lit(word))
    return found | text.rlike(GATE_CC) | (F.contains(low, F.lit("under")) & low.rlike(GATE_UNDER))


RULE = "array<struct<nth: int, label: string, tier: int, keyword: string, regex: string, base: boolean>>"


def _rule_table() -> Column:
    """All rules as one constant; given as JSON, it is a single node of the plan, evaluated once."""
    rows = [{"nth": i, "label": r.label, "tier": r.tier, "keyword": r.keyword(), "regex": r.regex(), "base": r.base} for i, r in enumerate(rules())]
    return F.from_json(F.lit(json.dumps(rows)), RULE)


def _detections(numbered: Column, keywords: Column) -> Column:
    """Matches (start, minus stop, tier, nth, label, base) of all rules whose keyword is among the text's."""
    live = F.filter(_rule_table(), lambda r: F.array_contains(keywords, r["keyword"]))

    def found(r: Column) -> Column:
        start = lambda m: F.substring_index(F.substring_index(m, " ", 1), "|", -1).cast("int")
        length = lambda m: F.length(m) - F.length(F.replace(m, F.lit("|"), F.lit("")))
        return F.transform(F.regexp_extract_all(numbered, r["regex"], F.lit(0)), lambda m: F.struct(start(m).alias("start"), (-(start(m) + length(m))).alias("back"), r["tier"].alias("tier"), r["nth"].alias("nth"), r["label"].alias("label"), r["base"].alias("base")))

    return F.array_sort(F.flatten(F.transform(live, found)))


def _kept(detections: Column) -> Column:
    """Labels and best tier of the detections that no earlier one of the same or a better tier contains. They come by
    start, longest first, so one is contained if the furthest stop so far, of such tiers, reaches its own."""

    def step(done: Column, d: Column) -> Column:
        stop = -d["back"]
        reach = F.when(d["tier"] == 1, done["s1"]).when(d["tier"] == 2, F.greatest(done["s1"], done["s2"])).otherwise(F.greatest(done["s1"], done["s2"], done["s3"]))
        fresh = stop > reach
        ends = [F.when(d["tier"] == k, F.greatest(done[f"s{k}"], stop)).otherwise(done[f"s{k}"]).alias(f"s{k}") for k in (1, 2, 3)]
        labels = F.when(fresh, F.array_union(done["labels"], F.array(d["label"]))).otherwise(done["labels"]).alias("labels")
        return F.struct(labels, F.when(fresh, F.least(done["best"], d["tier"])).otherwise(done["best"]).alias("best"), *ends)

    start = F.struct(F.array().cast("array<string>").alias("labels"), F.lit(9).alias("best"), *[F.lit(0).alias(f"s{k}") for k in (1, 2, 3)])
    return F.aggregate(detections, start, step)


def scan(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections) of (doc_id, text).

    n_base counts all places of the base phrases, first_word and last_word are their smallest and largest starts (words
    from 0, else null). base_labels and labels are distinct, sorted, comma-joined, empty if none. score: 1 for a notice
    or identifier, 0.9 for a named license, 0.5 for a mention, else 0. detections: all matches with places, labels and
    tiers, before suppression. Null text has no words; repeated rows get the same result each."""
    text = F.coalesce("text", F.lit(""))
    counted = documents.select("doc_id", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"), F.when(gated(text), F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0))).alias("words"))
    numbered = counted.select("doc_id", "n_words", F.array_intersect("words", F.array(*map(F.lit, sorted({r.keyword() for r in rules()})))).alias("keywords"), F.array_join(F.transform("words", lambda w, i: F.concat(w, F.lit("|"), i.cast("string"), F.lit(" "))), "").alias("numbered"))
    # the strings are bound as an outer variable: written into the inner functions they would be made again for each rule
    bound = F.flatten(F.transform(F.array(F.struct("keywords", "numbered")), lambda t: _detections(t["numbered"], t["keywords"])))
    none = F.array().cast("array<struct<start:int,back:int,tier:int,nth:int,label:string,base:boolean>>")
    found = numbered.select("doc_id", "n_words", F.when(F.col("numbered").isNotNull(), bound).otherwise(none).alias("detections"))
    parted = found.withColumn("base", F.filter("detections", lambda d: d["base"])).withColumn("kept", _kept(F.col("detections")))
    base_labels = F.array_distinct(F.transform("base", lambda d: d["label"]))
    every = F.array_union(F.col("kept.labels"), base_labels)
    labels = F.when(F.size(every) > 1, F.array_remove(every, "unknown-license")).otherwise(every)
    best = F.least(F.col("kept.best"), F.when(F.size("base") > 0, F.lit(2)).otherwise(F.lit(9)))
    score = F.coalesce(*[F.when(best == tier, F.lit(value)) for tier, value in CONFIDENCE.items()], F.lit(0.0))
    return parted.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(F.transform("base", lambda d: d["start"])).cast("long").alias("first_word"), F.array_max(F.transform("base", lambda d: d["start"])).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"), F.array_join(F.array_sort(labels), ",").alias("labels"), score.alias("score"), "detections",
    )
