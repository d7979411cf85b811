"""License scan by ordered signature rules.

Texts are normalised to lower-case words with single spaces. Only texts with one of
the keywords are looked at by the rules, and each rule only at texts with its own
keyword. Detections are intervals; one inside another of the same or a higher
priority is suppressed, of equal ones that of the later rule. All of it is array expressions over one row: no exchange.

The rules are notices and license sentences, SPDX identifiers, names with versions, names, and mentions.

Defined results: null and empty texts have no words, no labels and score 0.
Repeated rows give repeated results, equal detections the first rule's. Texts are taken whole. Columns of the results' names are replaced, others
stay. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermarc.llm.text import whole_text

NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: phrase -> label
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Families with versions: label, keyword, pattern of the name, versions.
VERSIONED = [
    ("gpl", "general public licen", "gnu general public licen[cs]e", ["1", "2", "3"]),
    ("gpl", "gpl", "(?:gnu )?gpl", ["1", "2", "3"]),
    ("lgpl", "general public licen", "gnu (?:lesser|library) general public licen[cs]e", ["2", "2.1", "3"]),
    ("lgpl", "lgpl", "(?:gnu )?lgpl", ["2", "2.1", "3"]),
    ("agpl", "affero", "(?:gnu )?affero general public licen[cs]e", ["1", "3"]),
    ("agpl", "agpl", "(?:gnu )?agpl", ["1", "3"]),
    ("gfdl", "documentation", "gnu free documentation licen[cs]e", ["1.1", "1.2", "1.3"]),
    ("apache", "apache", "apache(?: software)?(?: licen[cs]e)?", ["1.0", "1.1", "2.0"]),
    ("mpl", "mozilla", "mozilla public licen[cs]e", ["1.0", "1.1", "2.0"]),
    ("mpl", "mpl", "mpl", ["1.0", "1.1", "2.0"]),
    ("epl", "eclipse", "eclipse public licen[cs]e", ["1.0", "2.0"]),
    ("cddl", "development and distribution", "common development and distribution licen[cs]e", ["1.0", "1.1"]),
    ("cddl", "cddl", "cddl", ["1.0", "1.1"]),
    ("eupl", "european union public licen", "european union public licen[cs]e", ["1.0", "1.1", "1.2"]),
    ("eupl", "eupl", "eupl", ["1.0", "1.1", "1.2"]),
    ("afl", "academic free", "academic free licen[cs]e", ["1.1", "1.2", "2.0", "2.1", "3.0"]),
    ("osl", "open software licen", "open software licen[cs]e", ["1.0", "1.1", "2.0", "2.1", "3.0"]),
    ("artistic", "artistic", "artistic licen[cs]e", ["1.0", "2.0"]),
    ("cecill", "cecill", "cecill", ["1", "1.1", "2", "2.1"]),
    ("ofl", "open font licen", "(?:sil )?open font licen[cs]e", ["1.0", "1.1"]),
    ("lppl", "latex project", "latex project public licen[cs]e", ["1.0", "1.1", "1.2", "1.3"]),
    ("zpl", "zope", "zope public licen[cs]e", ["1.1", "2.0", "2.1"]),
    ("psf", "python software foundation licen", "python software foundation licen[cs]e", ["2"]),
    ("ecl", "educational community", "educational community licen[cs]e", ["1.0", "2.0"]),
    ("ms-pl", "microsoft public", "microsoft public licen[cs]e", ["1.0"]),
    ("odbl", "open database licen", "open database licen[cs]e", ["1.0"]),
    ("bsl", "boost software", "boost software licen[cs]e", ["1.0"]),
    ("cpl", "common public licen", "common public licen[cs]e", ["0.5", "1.0"]),
    ("qpl", "q public licen", "q public licen[cs]e", ["1.0"]),
    ("rpl", "reciprocal public", "reciprocal public licen[cs]e", ["1.1", "1.5"]),
    ("upl", "universal permissive", "universal permissive licen[cs]e", ["1.0"]),
    ("openssl", "openssl", "openssl licen[cs]e", ["1.1", "3.0"]),
]
#: Parts of a Creative Commons label: short form, long form.
CC_PARTS = {"by": "attribution", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s?(?: works)?", "sa": "share ?alike"}
CC_KINDS = ["by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd"]
CC_VERSIONS = ["1.0", "2.0", "2.5", "3.0", "4.0"]
#: Names and sentences without a version: label, keyword, pattern, priority (2: name, 1: mention).
NAMED = [
    ("mit", "mit licen", "mit licen[cs]e", 2),
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy", 2),
    ("x11", "x11 licen", "x11 licen[cs]e", 2),
    ("isc", "isc licen", "isc licen[cs]e", 2),
    ("isc", "permission to use copy modify", "permission to use copy modify and or distribute this software", 2),
    ("zlib", "zlib", "zlib(?: libpng)? licen[cs]e", 2),
    ("unlicense", "unlicense", "(?:the )?unlicense", 2),
    ("unlicense", "public domain", "released into the public domain", 2),
    ("wtfpl", "wtfpl", "wtfpl", 2),
    ("cc0", "cc0", "cc0(?: 1 0)?(?: universal)?", 2),
    ("bsd-2-clause", "bsd", "(?:2 clause bsd|bsd 2 clause|simplified bsd)(?: licen[cs]e)?", 2),
    ("bsd-3-clause", "bsd", "(?:3 clause bsd|bsd 3 clause|new bsd|modified bsd)(?: licen[cs]e)?", 2),
    ("bsd-4-clause", "bsd", "(?:4 clause bsd|bsd 4 clause|original bsd)(?: licen[cs]e)?", 2),
    ("0bsd", "0bsd", "0bsd", 2),
    ("bsd", "bsd", "bsd(?: style)? licen[cs]e", 1),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms", 1),
    ("gpl", "general public licen", "general public licen[cs]e", 1),
    ("cc", "creative commons", "creative commons", 1),
    ("proprietary", "all rights reserved", "all rights reserved", 1),
    ("public-domain", "public domain", "public domain", 1),
    ("copyright", "copyright", "copyright(?: c)? (?:19|20)[0-9]{2}", 1),
]

#: Sentences of license texts and of the notices in files: label, keyword, pattern, priority (4: a grant or notice with its version, 3: a sentence of the text).
SENTENCES = [
    ("apache-2.0", "except in compliance with the license", "licensed under the apache licen[cs]e version 2 0(?: the licen[cs]e)? you may not use this (?:file|work|project) except in compliance with the license", 4),
    ("apache-2.0", "apache org licenses", "(?:https? )?(?:www )?apache org licenses license 2 0", 4),
    ("apache-2.0", "applicable law or agreed to in writing", "unless required by applicable law or agreed to in writing software distributed under the licen[cs]e is distributed on an as is basis", 3),
    ("apache-2.0", "contributor hereby grants to you", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent)", 3),
    ("gpl-2-or-later", "under the terms of the gnu", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e as published by the free software foundation either version 2 of the licen[cs]e or at your option any later version", 4),
    ("gpl-3-or-later", "under the terms of the gnu", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e or at your option any later version", 4),
    ("gpl-2-only", "under the terms of the gnu", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e(?: version 2)? as published by the free software foundation version 2 of the licen[cs]e", 4),
    ("gpl", "without even the implied warranty", "distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public licen[cs]e", 3),
    ("gpl", "of the gnu", "you should have received a copy of the gnu general public licen[cs]e along with this program", 3),
    ("lgpl-2.1-or-later", "under the terms of the gnu", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public licen[cs]e as published by the free software foundation either version 2 1 of the licen[cs]e or at your option any later version", 4),
    ("lgpl-3-or-later", "under the terms of the gnu", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e or at your option any later version", 4),
    ("lgpl", "of the gnu", "you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e along with this (?:library|program)", 3),
    ("agpl-3-or-later", "gnu affero general public", "it under the terms of the gnu affero general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e or at your option any later version", 4),
    ("agpl", "of the gnu", "you should have received a copy of the gnu affero general public licen[cs]e along with this program", 3),
    ("gfdl-1.3-or-later", "gnu free documentation", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e version 1 3 or any later version", 4),
    ("mpl-2.0", "mozilla public", "this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0", 4),
    ("mpl-2.0", "mozilla org mpl", "(?:https? )?(?:www )?mozilla org mpl 2 0", 4),
    ("mpl-1.1", "mozilla public", "the contents of this file are subject to the mozilla public licen[cs]e version 1 1", 4),
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 3),
    ("mit", "substantial portions of the software", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 3),
    ("bsl-1.0", "permission is hereby granted", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this licen[cs]e", 3),
    ("isc", "fee is hereby granted", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", 3),
    ("0bsd", "fee is hereby granted", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is", 3),
    ("bsd-2-clause", "redistributions of source code must retain", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", 3),
    ("bsd-3-clause", "used to endorse or promote products", "neither the name of (?:the )?(?:[a-z0-9]+ ){1,8}nor the names of its contributors may be used to endorse or promote products derived from this software", 3),
    ("bsd-4-clause", "all advertising materials mentioning", "all advertising materials mentioning features or use of this software must display the following acknowledgement", 3),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", 3),
    ("zlib", "altered source versions", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", 3),
    ("zlib", "arising from the use of this software", "in no event will the authors be held liable for any damages arising from the use of this software", 3),
    ("unlicense", "free and unencumbered software", "this is free and unencumbered software released into the public domain", 3),
    ("wtfpl", "do what the fuck you want", "do what the fuck you want to(?: public licen[cs]e)?", 3),
    ("cc0-1.0", "has waived all copyright", "to the extent possible under law (?:[a-z0-9]+ ){1,8}has waived all copyright and related or neighboring rights", 3),
    ("cc0-1.0", "creativecommons org publicdomain", "creativecommons org publicdomain zero 1 0", 4),
    ("epl-2.0", "eclipse public", "made available under the terms of the eclipse public licen[cs]e (?:v|version )?2 0", 4),
    ("epl-1.0", "eclipse public", "made available under the terms of the eclipse public licen[cs]e (?:v|version )?1 0", 4),
    ("cddl", "development and distribution", "the contents of this file are subject to the terms of the common development and distribution licen[cs]e", 4),
    ("eupl-1.2", "licensed under the eupl", "licensed under the eupl version 1 2", 4),
    ("ofl-1.1", "open font licen", "this font software is licensed under the sil open font licen[cs]e version 1 1", 4),
    ("artistic-2.0", "artistic", "you may copy and distribute verbatim copies of the source form of the standard version of this package without restriction under the artistic licen[cs]e 2 0", 4),
    ("psf-2", "psf hereby grants", "psf hereby grants licensee a nonexclusive royalty free world wide licen[cs]e", 3),
    ("json", "used for good not evil", "the software shall be used for good not evil", 3),
    ("beerware", "buy me a beer", "if we meet some day and you think this stuff is worth it you can buy me a beer", 3),
    ("ms-pl", "microsoft public", "this licen[cs]e governs use of the accompanying software (?:[a-z0-9]+ ){0,12}microsoft public licen[cs]e", 3),
    ("curl", "fee is hereby granted", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice", 3),
    ("ncsa", "deal with the software without restriction", "to deal with the software without restriction including without limitation the rights to use copy", 3),
    ("public-domain", "the public domain", "(?:is|are|has been) (?:hereby )?(?:placed in|dedicated to|released to|in) the public domain", 3),
    ("proprietary", "strictly prohibited", "unauthori[sz]ed (?:copying|use|reproduction|distribution) of (?:[a-z0-9]+ ){1,6}(?:via any medium )?is strictly prohibited", 3),
    ("proprietary", "confidential and proprietary", "(?:is|contains) (?:the )?confidential and proprietary information", 3),
    ("proprietary", "may not be reproduced", "may not be reproduced (?:or )?(?:distributed |transmitted |stored )?(?:in any form )?(?:or by any means )?without (?:the )?(?:express |prior )?written permission", 3),
]
#: SPDX identifiers as they stand in files.
SPDX = """apache-2.0 mit bsd-2-clause bsd-3-clause 0bsd isc zlib unlicense wtfpl gpl-2.0-only gpl-2.0-or-later gpl-3.0-only gpl-3.0-or-later lgpl-2.1-only lgpl-2.1-or-later
lgpl-3.0-only lgpl-3.0-or-later agpl-3.0-only agpl-3.0-or-later mpl-1.1 mpl-2.0 epl-1.0 epl-2.0 cddl-1.0 eupl-1.2 bsl-1.0 artistic-2.0 ofl-1.1 cc0-1.0 cc-by-3.0 cc-by-4.0
cc-by-sa-3.0 cc-by-sa-4.0 cc-by-nc-4.0 cc-by-nd-4.0 cc-by-nc-sa-4.0 cc-by-nc-nd-4.0 ncsa curl psf-2.0 python-2.0 postgresql openssl x11 vim ruby lppl-1.3c odbl-1.0 cecill-2.1 mulanpsl-2.0""".split()


def _version(v: str) -> str:
    """A version in normalised words: '2.0' is '2 0' or '2'."""
    whole, _, part = v.partition(".")
    return f"{whole} {part}" if part not in ("", "0") else f"{whole}(?: 0)?"


@functools.cache
def rules() -> list[dict]:
    """All rules in order. Priority 3 names a version, 2 a license, 1 mentions one; grants ('or later') outrank plain versions."""
    out = [{"label": label, "keyword": p, "pattern": p, "priority": 2, "base": True} for p, label in BASE.items()]
    out += [{"label": a, "keyword": k, "pattern": p, "priority": w, "base": False} for a, k, p, w in SENTENCES]
    for x in SPDX:
        out.append({"label": x.replace(".0-", "-") if x.startswith(("gpl", "agpl", "lgpl-3")) else x, "keyword": "spdx license identifier", "pattern": "spdx license identifier " + x.replace("-", " ").replace(".", " "), "priority": 4, "base": False})
        out.append({"label": f"cc-{x[3:]}" if x.startswith("cc-") else x, "keyword": "opensource org licenses", "pattern": "opensource org licenses " + x.replace("-", " ").replace(".", " "), "priority": 3, "base": False})
    mid = r"(?: as published by the free software foundation)?(?: either)?(?: version| v)?"
    for label, keyword, name, versions in VERSIONED:
        for v in versions:
            n = _version(v)
            forms = [(f"{name}{mid} {n}", 3, ""), (f"{name} v{n}", 3, "")]
            if label in ("gpl", "lgpl", "agpl", "gfdl"):
                forms += [
                    (f"{name}{mid} {n}(?: of the licen[cs]e)? or (?:at your option )?any later version", 4, "-or-later"),
                    (f"{name} {n} or later", 4, "-or-later"),
                    (f"{name} {n} only", 4, "-only"),
                ]
            else:
                forms += [(f"{name}{mid} {n} or later", 4, "-or-later")]
            out += [{"label": f"{label}-{v}{end}", "keyword": keyword, "pattern": p, "priority": k, "base": False} for p, k, end in forms]
    for kind in CC_KINDS:
        short, long = " ".join(kind.split("-")), " ".join(CC_PARTS[x] for x in kind.split("-"))
        for v in CC_VERSIONS:
            n = _version(v)
            out.append({"label": f"cc-{kind}-{v}", "keyword": "cc by", "pattern": f"cc {short} {n}", "priority": 3, "base": False})
            out.append({"label": f"cc-{kind}-{v}", "keyword": "creativecommons org licenses", "pattern": f"creativecommons org licenses {short} {v.replace('.', ' ')}", "priority": 4, "base": False})
            out.append({"label": f"cc-{kind}-{v}", "keyword": "creative commons", "pattern": f"creative commons {long}(?: {v.replace('.', ' ')}|(?: international| unported| generic)? {n})(?: licen[cs]e)?", "priority": 3, "base": False})
        out.append({"label": f"cc-{kind}", "keyword": "cc by", "pattern": f"cc {short}", "priority": 2, "base": False})
        out.append({"label": f"cc-{kind}", "keyword": "creative commons", "pattern": f"creative commons {long}", "priority": 2, "base": False})
    out += [{"label": a, "keyword": k, "pattern": p, "priority": w, "base": False} for a, k, p, w in NAMED]
    for r in out:
        re.compile(r["pattern"])
    return [r | {"pattern": f" (?:{r['pattern']})(?= )"} for r in out]


#: Letters from which on a keyword's word is looked for anywhere, and not as a word of its own.
LONG_WORD = 4
#: Words too common to tell much: another word of the keyword is looked for, where it has one.
COMMON = set("and are by common contents copy development do file for form from general granted hereby in is law licensed make may not notice of open or org program public software source that the this to under use used what will with without work writing you free file project terms".split())


def gate_words() -> list[str]:
    """Of each rule's keyword its longest word; any text that the rule matches has it."""
    return sorted({max(r["keyword"].split(), key=lambda w: (w not in COMMON, len(w))) for r in rules()})


def gate(low: Column) -> Column:
    """Whether a lower-case text may hold a rule's keyword: long words anywhere, short ones between other characters than letters and digits."""
    short = "|".join(re.escape(w) for w in gate_words() if len(w) < LONG_WORD)
    out = low.rlike(rf"(?:^|[\x00-\x2F\x3A-\x60\x7B-\x7F])(?:{short})(?:$|[\x00-\x2F\x3A-\x60\x7B-\x7F])") if short else F.lit(False)
    long = [w for w in gate_words() if len(w) >= LONG_WORD]
    # A word that holds another one needs no look of its own.
    for w in long:
        if not any(v != w and v in w for v in long):
            out = out | F.contains(low, F.lit(w))
    return out


def normalised(text: Column) -> Column:
    """' word word ': lower-case words, a space before, between and after."""
    low = F.translate(text, UPPER, LOWER)
    return F.concat(F.lit(" "), F.regexp_replace(F.concat(low, F.lit(" ")), F.lit(NO_WORD), F.lit(" ")))


def _places(norm: Column, rule: Column) -> Column:
    """Intervals of a rule's matches: ends follow from the lengths of what lies between them."""
    found = F.regexp_extract_all(norm, rule["pattern"], F.lit(0))
    between = F.split(norm, rule["pattern"], F.lit(-1))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc: Column, k: Column) -> Column:
        begin = acc["at"] + F.length(F.get(between, k))
        end = begin + F.length(F.get(found, k))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("end")))).alias("out"))

    return F.when(
        F.size(found) > 0, F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), start, step, lambda a: a["out"])
    ).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def detect(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds `n_words` and `detections`: array of (start, neg_end, neg_priority, order, label, base, kept) in order of start.

    Offsets are characters of the normalised text. `kept` is False for one inside an
    earlier detection of at least its priority; a priority level's furthest end so far tells that.
    """
    t = whole_text(text)
    table = F.array(*[F.struct(F.lit(r["keyword"]).alias("keyword"), F.lit(r["pattern"]).alias("pattern"), F.lit(r["priority"]).alias("priority"), F.lit(k).alias("order"), F.lit(r["label"]).alias("label"), F.lit(r["base"]).alias("base")) for k, r in enumerate(rules())])
    df = docs.withColumns({"n_words": F.regexp_count(t, F.lit(WORD_ANY_CASE)).cast("long"), "_norm": F.when(gate(F.translate(t, UPPER, LOWER)), normalised(t))})
    norm = F.col("_norm")
    hits = F.filter(table, lambda r: F.contains(norm, F.concat(F.lit(" "), r["keyword"])))
    df = df.withColumn("_hits", F.when(norm.isNotNull(), hits))
    found = F.flatten(
        F.transform(
            "_hits",
            lambda r: F.transform(
                _places(norm, r),
                lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("neg_end"), (-r["priority"]).alias("neg_priority"), r["order"].alias("order"), r["label"].alias("label"), r["base"].alias("base")),
            ),
        )
    )
    df = df.withColumn("_found", F.array_sort(F.coalesce(found, F.array().cast("array<struct<start:int,neg_end:int,neg_priority:int,order:int,label:string,base:boolean>>"))))
    levels = max(r["priority"] for r in rules())
    kind = "array<struct<start:int,neg_end:int,neg_priority:int,order:int,label:string,base:boolean,kept:boolean>>"
    zero = F.struct(F.array(*[F.lit(-1)] * levels).alias("ends"), F.array().cast(kind).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        end, level = -x["neg_end"], -x["neg_priority"]
        inside = F.exists(F.slice(acc["ends"], level, levels), lambda e: e >= end)
        ends = F.transform(acc["ends"], lambda e, k: F.when(k + 1 == level, F.greatest(e, end)).otherwise(e))
        row = F.struct(x["start"].alias("start"), x["neg_end"].alias("neg_end"), x["neg_priority"].alias("neg_priority"), x["order"].alias("order"), x["label"].alias("label"), x["base"].alias("base"), (~inside).alias("kept"))
        return F.struct(ends.alias("ends"), F.concat(acc["out"], F.array(row)).alias("out"))

    df = df.withColumn("detections", F.aggregate("_found", zero, step, lambda a: a["out"]))
    return df.drop("_hits", "_found").withColumnRenamed("_norm", "_normalised")


RESULT = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Base counts and places, labels and score of every document."""
    docs = docs.select(*[c for c in docs.columns if c not in RESULT])
    d = F.col("detections")
    base = F.filter(d, lambda x: x["base"])
    df = detect(docs, text).withColumn("_base", base)
    b = F.col("_base")
    spaces = lambda upto: upto - F.length(F.replace(F.substring(F.col("_normalised"), F.lit(1), upto), F.lit(" "), F.lit("")))
    starts = F.transform(b, lambda x: x["start"])
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    level = F.array_max(F.transform(F.filter(d, lambda x: x["kept"]), lambda x: -x["neg_priority"]))
    return df.select(
        *docs.columns,
        "n_words",
        F.size(b).cast("long").alias("n_base"),
        spaces(F.array_min(starts)).cast("long").alias("first_word"),
        spaces(F.array_max(starts)).cast("long").alias("last_word"),
        joined(F.transform(b, lambda x: x["label"])).alias("base_labels"),
        joined(F.transform(F.filter(d, lambda x: x["kept"] | x["base"]), lambda x: x["label"])).alias("labels"),
        F.when(level.isNull(), F.lit(0.0)).otherwise(F.least(F.lit(1.0), (level.cast("double") + 1) / 4)).alias("score"),
        "detections",
    )
