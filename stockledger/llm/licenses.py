"""Operator 4 [native]: licence scans with ordered signature rules.

``RULES`` is an ordered table of regexes over a text's words (A-Z lower-cased, one blank
between words), each with a keyword, a priority, a label and a score.  Most are a licence's
hand-written name put into one of a few forms (SPDX tag, second or third licence of an SPDX
expression, notice with the name or the tag, address, title); the rest are phrases of the licence texts.  One projection does the work, with built-in functions only:

1. texts without any of ``ROOTS`` (plain substring search, and one pattern) are done;
2. for the others, every keyword is looked for once and the rules whose keyword occurs are run; a match's place in words follows
   from the words of the pieces before it;
3. detections, sorted by (start, longest, priority, rule), pass one sweep: a detection lying
   inside an earlier one of the same or a better priority is suppressed.  The sweep keeps the
   furthest end seen per priority, so it is linear in the detections.

Cases: null counts as the empty text (no words, no labels, score 0).  Repeated rows each give
a row, an empty table none; texts are scanned whole, whatever their length.  Only the id and text columns are read; other columns cannot clash.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockledger.llm.common import ALNUM_WORD, ALNUM_WORD_ANY_CASE, ascii_lower, let, read

# Fixed by the contract: phrases whose words must stand consecutively, and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))


@dataclass(frozen=True)
class Signature:
    regex: str
    keyword: str
    label: str
    priority: int      # 1 is best
    score: float


# label | names, by / | SPDX tag | words of its address | keyword of each name
FAMILIES = """
mit | (?:mit(?: x11)? licen[sc]e|mit x11) | mit | opensource org licenses mit | mit
mit-0 | mit no attribution(?: licen[sc]e)? | mit 0 | opensource org licenses mit 0 | attribution
apache-1.1 | apache (?:software )?licen[sc]e (?:version |v)?1 1 | apache 1 1 | apache org licenses license 1 1 | apache
apache-2.0 | apache (?:software )?licen[sc]e(?: version| v)? ?2(?: 0)? | apache 2 0 | apache org licenses license 2 0 | apache
apache | apache (?:software )?licen[sc]e | apache | apache org licenses | apache
gpl-2.0 | (?:gnu )?general public licen[sc]e(?: version| v)? ?2(?: 0)? | gpl 2 0(?: only| or later)? | gnu org licenses(?: old licenses)? gpl 2 0 | general
gpl-3.0 | (?:gnu )?general public licen[sc]e(?: version| v)? ?3(?: 0)? | gpl 3 0(?: only| or later)? | gnu org licenses gpl 3 0 | general
gpl | (?:gnu )?general public licen[sc]e | gpl | gnu org licenses gpl | general
lgpl-2.1 | (?:gnu )?lesser general public licen[sc]e(?: version| v)? ?2 1 | lgpl 2 1(?: only| or later)? | gnu org licenses(?: old licenses)? lgpl 2 1 | lesser
lgpl-3.0 | (?:gnu )?lesser general public licen[sc]e(?: version| v)? ?3(?: 0)? | lgpl 3 0(?: only| or later)? | gnu org licenses lgpl 3 0 | lesser
lgpl | (?:gnu )?(?:lesser|library) general public licen[sc]e | lgpl | gnu org licenses lgpl | general
agpl-3.0 | (?:gnu )?affero general public licen[sc]e(?: version| v)? ?3(?: 0)? | agpl 3 0(?: only| or later)? | gnu org licenses agpl 3 0 | affero
agpl | (?:gnu )?affero general public licen[sc]e | agpl | gnu org licenses agpl | affero
gfdl | (?:gnu )?free documentation licen[sc]e | gfdl(?: 1 [123])?(?: only| or later)? | gnu org licenses fdl | documentation
bsd-2-clause | (?:simplified bsd|(?:bsd 2 clause|2 clause bsd)(?: simplified)?|freebsd) licen[sc]e | (?:bsd 2 clause|2 clause bsd) | opensource org licenses bsd 2 clause | bsd
bsd-3-clause | (?:new bsd|modified bsd|revised bsd|(?:bsd 3 clause|3 clause bsd)(?: new or revised| new| revised| modified)?) licen[sc]e | (?:bsd 3 clause|3 clause bsd) | opensource org licenses bsd 3 clause | bsd
bsd-4-clause | (?:original bsd|bsd 4 clause) licen[sc]e | bsd 4 clause | spdx org licenses bsd 4 clause | bsd
0bsd | (?:zero clause bsd|bsd zero clause) licen[sc]e | 0bsd | opensource org licenses 0bsd | bsd
bsd | bsd(?: style)? licen[sc]e | bsd | opensource org licenses bsd license | bsd
isc | isc licen[sc]e | isc | opensource org licenses isc | isc
mpl-1.1 | mozilla public licen[sc]e(?: version| v)? ?1 1 | mpl 1 1 | mozilla org mpl 1 1 | mozilla
mpl-2.0 | mozilla public licen[sc]e(?: version| v)? ?2(?: 0)? | mpl 2 0 | mozilla org mpl 2 0 | mozilla
mpl | mozilla public licen[sc]e | mpl | mozilla org mpl | mozilla
epl-1.0 | eclipse public licen[sc]e(?: version| v)? ?1(?: 0)? | epl 1 0 | eclipse org legal epl v10 | eclipse
epl-2.0 | eclipse public licen[sc]e(?: version| v)? ?2(?: 0)? | epl 2 0 | eclipse org legal epl 2 0 | eclipse
edl | eclipse distribution licen[sc]e | edl 1 0 | eclipse org org documents edl v10 | eclipse
cddl | common development and distribution licen[sc]e | cddl 1 [01] | opensource org licenses cddl | development
cpl-1.0 | common public licen[sc]e | cpl 1 0 | opensource org licenses cpl | common
ipl | ibm public licen[sc]e | ipl 1 0 | opensource org licenses ipl | ibm
eupl | european union public licen[sc]e | eupl(?: v?1 [012])? | joinup ec europa eu software page eupl | european
boost | boost software licen[sc]e | bsl 1 0 | boost org license 1 0 | boost
busl | business source licen[sc]e | busl 1 1 | mariadb com bsl11 | business
sspl | server side public licen[sc]e | sspl 1 0 | mongodb com licensing server side public license | server
elastic | elastic licen[sc]e | elastic 2 0 | elastic co licensing elastic license | elastic
unlicense | (?:the )?unlicense | unlicense | unlicense org | unlicense
wtfpl | do what the fuck you want to public licen[sc]e | wtfpl | wtfpl net | want
zlib | zlib(?: libpng)? licen[sc]e | zlib | zlib net zlib license | zlib
libpng | libpng licen[sc]e | libpng(?: 2 0)? | libpng org pub png src libpng license | libpng
openssl | openssl licen[sc]e | openssl | openssl org source license | openssl
python-2.0 | python software foundation licen[sc]e | (?:python|psf) 2 0 | docs python org 3 license | python
php | php licen[sc]e | php 3 0(?: 1)? | php net license | php
ruby | ruby licen[sc]e | ruby | ruby lang org en about license | ruby
artistic | artistic licen[sc]e | artistic [12] 0 | perlfoundation org artistic license | artistic
postgresql | postgresql licen[sc]e | postgresql | postgresql org about licence | postgresql
ofl | sil open font licen[sc]e | ofl 1 [01] | scripts sil org ofl | font
ncsa | university of illinois ncsa open source licen[sc]e | ncsa | opensource org licenses ncsa | ncsa
ms-pl | microsoft public licen[sc]e | ms pl | opensource org licenses ms pl | microsoft
ms-rl | microsoft reciprocal licen[sc]e | ms rl | opensource org licenses ms rl | reciprocal
afl | academic free licen[sc]e | afl 3 0 | opensource org licenses afl | academic
osl | open software licen[sc]e | osl 3 0 | opensource org licenses osl | software
odbl | open (?:data commons open )?database licen[sc]e | odbl 1 0 | opendatacommons org licenses odbl | database
odc-by | open data commons attribution licen[sc]e | odc by 1 0 | opendatacommons org licenses by | attribution
pddl | public domain dedication and licen[sc]e | pddl 1 0 | opendatacommons org licenses pddl | dedication
openrail | (?:creativeml |bigscience )?open ?rail(?: m)? licen[sc]e | openrail | bigscience huggingface co blog bigscience openrail m | rail
cc0 | cc0(?: 1 0)?(?: universal)? / creative commons (?:zero|cc0)(?: 1 0)?(?: universal)? | cc0 1 0 | creativecommons org publicdomain zero | cc0 / creative commons
cc-by | cc by(?: [1234] [05])?(?: international| unported| generic)?(?: licen[sc]e)? / creative commons attribution(?: [1234] [05])?(?: international| unported| generic)?(?: licen[sc]e)? | cc by [1234] [05] | creativecommons org licenses by | cc by / creative commons
cc-by-sa | cc by sa(?: [1234] [05])?(?: international| unported| generic)?(?: licen[sc]e)? / creative commons attribution share ?alike(?: [1234] [05])?(?: international| unported| generic)?(?: licen[sc]e)? | cc by sa [1234] [05] | creativecommons org licenses by sa | cc by sa / creative commons
cc-by-nd | cc by nd(?: [1234] [05])?(?: international| unported| generic)?(?: licen[sc]e)? / creative commons attribution no ?deriv(?:ative)?s(?: [1234] [05])?(?: international| unported| generic)?(?: licen[sc]e)? | cc by nd [1234] [05] | creativecommons org licenses by nd | cc by nd / creative commons
cc-by-nc | cc by nc(?: [1234] [05])?(?: international| unported| generic)?(?: licen[sc]e)? / creative commons attribution non ?commercial(?: [1234] [05])?(?: international| unported| generic)?(?: licen[sc]e)? | cc by nc [1234] [05] | creativecommons org licenses by nc | cc by nc / creative commons
cc-by-nc-sa | cc by nc sa(?: [1234] [05])?(?: international| unported| generic)?(?: licen[sc]e)? / creative commons attribution non ?commercial share ?alike(?: [1234] [05])?(?: international| unported| generic)?(?: licen[sc]e)? | cc by nc sa [1234] [05] | creativecommons org licenses by nc sa | cc by nc sa / creative commons
cc-by-nc-nd | cc by nc nd(?: [1234] [05])?(?: international| unported| generic)?(?: licen[sc]e)? / creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: [1234] [05])?(?: international| unported| generic)?(?: licen[sc]e)? | cc by nc nd [1234] [05] | creativecommons org licenses by nc nd | cc by nc nd / creative commons
"""

# label | priority | score | keyword | regex: phrases of licence texts and of rights statements
PHRASES = r"""
mit | 2 | 0.95 | permission | permission is hereby granted free of charge to any person obtaining a copy of this software
isc | 2 | 0.9 | permission | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
apache-2.0 | 2 | 0.95 | apache | licensed under the apache license version 2 0 the license you may not use this (?:file|work) except in compliance
apache-2.0 | 2 | 0.85 | perpetual | perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent) license
gpl | 2 | 0.95 | redistribute | you can redistribute it and or modify it under the terms of the gnu general public license
gpl | 2 | 0.8 | warranty | without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license
lgpl | 2 | 0.95 | redistribute | you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
agpl | 2 | 0.95 | redistribute | you can redistribute it and or modify it under the terms of the gnu affero general public license
gpl-2.0 | 2 | 0.9 | version | either version 2 of the license or at your option any later version
gpl-3.0 | 2 | 0.9 | version | either version 3 of the license or at your option any later version
gpl | 3 | 0.7 | gpl | (?:gnu )?gpl(?: ?v?[123])?(?: 0)?(?: only| or later)
bsd | 2 | 0.9 | redistribution | redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause | 2 | 0.9 | endorse | (?:neither the name of(?: [^ ]+){1,20}? may be used|may not be used) to endorse or promote products derived from this software
bsd-4-clause | 2 | 0.9 | advertising | all advertising materials mentioning features or use of this software must display
mpl-2.0 | 2 | 0.95 | mozilla | this source code form is subject to the terms of the mozilla public license
epl-2.0 | 2 | 0.9 | eclipse | made available under the terms of the eclipse public license
boost | 2 | 0.9 | permission | permission is hereby granted free of charge to any person or organization obtaining a copy of the software
zlib | 2 | 0.9 | altered | altered source versions must be plainly marked as such
unlicense | 2 | 0.95 | unencumbered | this is free and unencumbered software released into the public domain
wtfpl | 2 | 0.9 | permitted | everyone is permitted to copy and distribute verbatim or modified copies of this license document
ofl | 2 | 0.9 | font | this font software is licensed under the sil open font license
cc0 | 2 | 0.9 | waived | (?:has|have) waived all copyright and related (?:or|and) neighbou?ring rights
public-domain | 2 | 0.85 | domain | (?:released|placed|dedicated) (?:in|into|to) the public domain
public-domain | 3 | 0.5 | domain | (?:is|are) in the public domain
no-warranty | 3 | 0.4 | warranty | the software is provided as is without warranty of any kind
no-warranty | 3 | 0.4 | warranties | without warranties or conditions of any kind
no-warranty | 3 | 0.4 | warranty | comes with absolutely no warranty
no-liability | 3 | 0.4 | liable | in no event shall the (?:authors?|copyright holders?|contributors?)(?: or (?:authors?|copyright holders?|contributors?))* be liable
all-rights-reserved | 3 | 0.6 | reserved | all rights reserved
copyright | 4 | 0.3 | cop | (?:copyright|copr)(?: c)? (?:19|20)[0-9]{2}
copyright | 4 | 0.3 | copyright | copyright (?:holder|holders|owner|notice|notices)
proprietary | 2 | 0.8 | proprietary | proprietary and confidential
proprietary | 2 | 0.8 | unauthori | unauthori[sz]ed (?:copying|use|reproduction|distribution)(?: (?:or|and) (?:copying|use|reproduction|distribution))*(?: of this(?: [^ ]+){1,10}?)? is (?:strictly )?prohibited
non-commercial | 3 | 0.6 | commercial | (?:for )?non ?commercial (?:use|purposes)(?: only)?
non-commercial | 3 | 0.6 | academic | for academic(?: (?:and|or) (?:academic|research|educational))? (?:use|purposes) only
non-commercial | 3 | 0.6 | research | for research(?: (?:and|or) (?:academic|research|educational))? (?:use|purposes) only
attribution | 4 | 0.3 | permission | (?:reproduced|reprinted|used) (?:here )?(?:with|by) (?:kind )?permission
eula | 3 | 0.6 | agreement | end user licen[sc]e agreement
"""

# label | short name in notices or behind "gnu", with or without a suffix
SHORT = """
gpl-2.0 | gpl(?: version)? ?v?2(?: 0)?(?: only| or later)?
gpl-3.0 | gpl(?: version)? ?v?3(?: 0)?(?: only| or later)?
gpl | gpl(?:(?: version)? ?v?1(?: 0)?)?(?: only| or later)?
lgpl-2.1 | lgpl(?: version)? ?v?2 1(?: only| or later)?
lgpl-3.0 | lgpl(?: version)? ?v?3(?: 0)?(?: only| or later)?
lgpl | lgpl(?:(?: version)? ?v?2(?: 0)?)?(?: only| or later)?
agpl-3.0 | agpl(?: version)? ?v?3(?: 0)?(?: only| or later)?
agpl | agpl(?:(?: version)? ?v?1(?: 0)?)?(?: only| or later)?
"""

_VERB = "(?:licen[sc]ed|released|distributed|published|available|provided|covered|offered|shared)"
_TERMS = "(?: the)?(?: terms and conditions| terms| conditions)?(?: of)?(?: the| a| an)? "
NOTICE = _VERB + " (?:(?:as|is) )?(?:under|by|with|subject to)" + _TERMS
# a bare tag is often a project's or a place's name too ("provided by MIT"): only "under" makes it a licence
TAG_NOTICE = _VERB + " (?:(?:as|is) )?under" + _TERMS

# Parts of words of which every match of any rule has one at least, or the words of a SPLIT_ROOT in turn:
# what stands in one word of the text stands in the text as it is.
ROOTS = ("licen", "spdx", "permission", "permitted", "warrant", "redistribut", "copyright", "copr", "gpl", "reserved",
         "endorse", "advertising", "altered", "unencumbered", "waived", "domain", "liable", "proprietary", "unauthori",
         "commercial", "academic", "research", "attribution", "cc0", "x11", "creative", "mozilla", "eclipse", "eupl", "bsl11", "wtfpl", "openrail")
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPLIT_ROOT = f"cc{_GAP}by|sil{_GAP}org{_GAP}ofl"
UNDER_ROOT = f"(?:released|distributed|published|available|provided|covered|offered|shared){_GAP}(?:(?:as|is){_GAP})?under"


def build_rules() -> tuple[Signature, ...]:
    out = []
    families = [[x.strip() for x in line.split(" | ")] for line in FAMILIES.strip().splitlines()]
    # longest first: a tag that starts another one must not end the match
    any_tag = "(?:" + "|".join(sorted({spdx for _, _, spdx, _, _ in families}, key=lambda x: (-len(x), x))) + ")"
    for label, names, spdx, address, keywords in families:
        tag = re.match("[a-z0-9 ]*", spdx)[0].strip() or "under"
        out += [Signature(f"spdx license identifier {spdx}", "spdx", label, 1, 1.0)]
        # the second and third licence of an expression; a worse priority each, as they contain the ones before
        out += [Signature(f"spdx license identifier (?:{any_tag} (?:or|and) ){{{before}}}{spdx}", "spdx", label, 1 + before, 1.0) for before in (1, 2)]
        for name, keyword in zip(names.split(" / "), keywords.split(" / "), strict=True):
            out += [Signature(NOTICE + name, keyword, label, 2, 0.95), Signature(name, keyword, label, 3, 0.7)]
        out += [Signature(f"(?:licen[sc]e|licen[sc]es) (?:is )?{spdx}", "licen", label, 3, 0.8),
                Signature(TAG_NOTICE + spdx, tag, label, 2, 0.9),
                Signature(f"(?:https? )?(?:www )?{address}(?: (?:html|txt|php|md))?", address.split(" ")[0], label, 2, 0.9)]
    for line in SHORT.strip().splitlines():
        label, name = (x.strip() for x in line.split(" | "))
        out += [Signature(f"{NOTICE}(?:gnu )?{name}", "gpl", label, 2, 0.9), Signature(f"gnu {name}", "gpl", label, 3, 0.7)]
    for line in PHRASES.strip().splitlines():
        label, priority, score, keyword, regex = (x.strip() for x in line.split(" | "))
        out.append(Signature(regex, keyword, label, int(priority), float(score)))
    return tuple(out)


RULES = build_rules()
LEVELS = max(r.priority for r in RULES)
_DETECTION = "struct<start:int,end:int,rule:int,priority:int,label:string,score:double>"


def places(line: Column, regex: Column) -> Column:
    """array<struct<start, end>> in words, of the matches of ``regex`` in a blank-separated ``line``."""
    whole = F.concat(F.lit("(?<= )(?:"), regex, F.lit(")(?= )"))
    words = lambda s: F.size(F.array_remove(F.split(s, " ", -1), ""))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + words(x["before"])
        end = start + words(x["hit"])
        return F.struct(end.alias("at"), F.array_append(a["out"], F.struct(start.alias("start"), end.alias("end"))).alias("out"))

    pieces = F.arrays_zip(F.split(line, whole, -1).alias("before"), F.regexp_extract_all(line, whole, F.lit(0)).alias("hit"))
    pieces = F.filter(pieces, lambda x: x["hit"].isNotNull())
    return F.aggregate(pieces, zero, step, lambda a: a["out"])


def detections(line: Column, rules: tuple[Signature, ...]) -> Column:
    table = F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(r.regex).alias("regex"), F.lit(r.keyword).alias("keyword"),
                               F.lit(r.priority).alias("priority"), F.lit(r.label).alias("label"), F.lit(r.score).alias("score"))
                      for i, r in enumerate(rules)])
    # a keyword is looked for once, however many rules it gates
    words = F.filter(F.array(*[F.lit(k) for k in sorted({r.keyword for r in rules})]), lambda k: F.contains(line, k))
    asked = let(words, lambda ks: F.filter(table, lambda r: F.array_contains(ks, r["keyword"])))
    found = F.flatten(F.transform(asked, lambda r: F.transform(places(line, r["regex"]), lambda p: F.struct(
        p["start"].alias("start"), (-p["end"]).alias("minus_end"), r["priority"].alias("priority"), r["rule"].alias("rule"),
        r["label"].alias("label"), r["score"].alias("score")))))
    return F.transform(F.array_sort(found), lambda x: F.struct(
        x["start"].alias("start"), (-x["minus_end"]).alias("end"), x["rule"].alias("rule"), x["priority"].alias("priority"),
        x["label"].alias("label"), x["score"].alias("score")))


def unsuppressed(found: Column, levels: int = LEVELS) -> Column:
    """Drop detections inside an earlier one (start, longest, priority, rule) of the same or a better priority."""
    zero = F.struct(F.array_repeat(F.lit(0), levels).alias("reach"), F.array().cast(f"array<{_DETECTION}>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        inside = F.array_max(F.slice(a["reach"], 1, x["priority"])) >= x["end"]
        reach = F.transform(a["reach"], lambda e, i: F.when(i + 1 == x["priority"], F.greatest(e, x["end"])).otherwise(e))
        return F.struct(reach.alias("reach"), F.when(inside, a["out"]).otherwise(F.array_append(a["out"], x)).alias("out"))

    return F.aggregate(found, zero, step, lambda a: a["out"])


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
         rules: tuple[Signature, ...] = RULES) -> DataFrame:
    """(id, n_words, base: contract phrases with places, detections: what no other suppresses)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    low = F.lower(text)      # only for the gate: a superset of what A-Z lower-casing finds
    gate = let(low, lambda t: F.exists(F.array(*map(F.lit, ROOTS)), lambda r: F.contains(t, r)) | t.rlike(SPLIT_ROOT)
               | (F.contains(t, F.lit("under")) & t.rlike(UNDER_ROOT)))

    def phrase(line: Column, words: str, label: str) -> Column:
        return F.transform(places(line, F.lit(words)), lambda x: F.struct(x["start"].alias("start"), F.lit(label).alias("label")))

    def look(line: Column) -> Column:
        base = F.flatten(F.array(*[phrase(line, p, label) for p, label in BASE]))
        return F.struct(base.alias("base"), unsuppressed(detections(line, rules)).alias("detections"))

    line = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(ascii_lower(text), F.lit(ALNUM_WORD), F.lit(0)), " "), F.lit(" "))
    none = F.struct(F.array().cast("array<struct<start:int,label:string>>").alias("base"),
                    F.array().cast(f"array<{_DETECTION}>").alias("detections"))
    out = docs.select(F.col(id_col).alias("id"), F.regexp_count(text, F.lit(ALNUM_WORD_ANY_CASE)).cast("long").alias("n_words"),
                      F.when(gate, let(line, look)).otherwise(none).alias("x"))
    return out.select("id", "n_words", "x.base", "x.detections")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence labels of every document."""
    out = scan(read(spark, sf_dir, "documents"))
    names = lambda a: F.array_join(F.sort_array(F.array_distinct(a)), ",")
    return out.select(
        F.col("id").alias("doc_id"), "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min("base.start").cast("long").alias("first_word"), F.array_max("base.start").cast("long").alias("last_word"),
        names(F.col("base.label")).alias("base_labels"),
        names(F.concat("base.label", "detections.label")).alias("labels"),
        F.coalesce(F.array_max("detections.score"), F.lit(0.0)).alias("score"))


def _sql_rules() -> str:
    """Rules as SQL rows; blanks are doubled, so that neighbouring matches have a blank each."""
    rows = [(-1 - i, p, p.split(" ")[0], 0, label, 0.0) for i, (p, label) in enumerate(BASE)]
    rows += [(i, r.regex, r.keyword, r.priority, r.label, r.score) for i, r in enumerate(RULES)]
    wide = lambda x: x.replace(" ?", "(?:@@)?").replace("[^ ]", "[^@]").replace(" ", "  ").replace("(?:@@)?", "(?:  )?").replace("[^@]", "[^ ]")
    return ", ".join(f"({i}, ' (?:{wide(x)}) ', '{k.replace(' ', '  ')}', {p}, '{n}', {c})" for i, x, k, p, n, c in rows)


ORACLE = r"""
WITH rules(idx, rx, kw, pri, label, score) AS (VALUES RULES),
d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
g AS (SELECT rid, ' ' || array_to_string(w, '  ') || ' ' AS line FROM d),
k AS (
  SELECT rid, idx, pri, label, score,
         list_transform(string_split_regex(line, rx), lambda s: len(list_filter(string_split(s, ' '), lambda x: x <> ''))) AS gaps,
         list_transform(regexp_extract_all(line, rx), lambda s: len(list_filter(string_split(s, ' '), lambda x: x <> ''))) AS hits
  FROM g JOIN rules ON contains(line, kw) AND regexp_matches(line, rx)),
f AS (
  SELECT rid, idx, pri, label, score, hits[i] AS n, list_sum(gaps[1:i]) + coalesce(list_sum(hits[1:i - 1]), 0) AS s
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM k)),
base AS (
  SELECT rid, count(*) AS n, min(s) AS a, max(s) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM f WHERE idx < 0 GROUP BY rid),
found AS (SELECT rid, idx, pri, label, score, s, s + n AS e FROM f WHERE idx >= 0),
kept AS (
  SELECT rid, label, score FROM found x WHERE NOT EXISTS (
    SELECT 1 FROM found y WHERE y.rid = x.rid AND y.s <= x.s AND y.e >= x.e AND y.pri <= x.pri
      AND (y.s <> x.s OR y.e <> x.e OR y.pri < x.pri OR (y.pri = x.pri AND y.idx < x.idx)))),
labels AS (
  SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT rid, label FROM kept UNION ALL SELECT rid, label FROM f WHERE idx < 0) GROUP BY rid),
best AS (SELECT rid, max(score) AS score FROM kept GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(base.n, 0) AS n_base, CAST(base.a AS BIGINT) AS first_word,
       CAST(base.z AS BIGINT) AS last_word, coalesce(base.labels, '') AS base_labels, coalesce(labels.labels, '') AS labels,
       CAST(coalesce(best.score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN base USING (rid) LEFT JOIN labels USING (rid) LEFT JOIN best USING (rid)
""".replace("RULES", _sql_rules(), 1)
