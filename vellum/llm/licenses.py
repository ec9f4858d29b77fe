"""License scan by ordered signature rules.

A text becomes lower-case words with one space between. An automaton looks for the keywords of all rules; only rules whose
keyword stands in the text are matched. Rules are ordered by what they look for: identifiers, wording of the license itself,
addresses, notices (`licensed under ..`), names with a version, names. Of overlapping matches, one that lies within a match of
a stronger rule, or within a longer one of an equally strong rule, is suppressed.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import lean, small_batches

#: What a rule looks for, the strongest first, and how sure one match is of its license.
KINDS = {"identifier": 0.95, "wording": 0.9, "address": 0.85, "notice": 0.8, "version": 0.7, "name": 0.5}

#: Phrases and labels that stay whatever else is found.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Family, its names (regular expressions over words, parted by ` / `; ! before a name that counts with a version alone), addresses, versions.
FAMILIES = [
    ("gpl", r"gnu general public licen[cs]e / gnu public licen[cs]e / gnu gpl / gpl", r"gnu org (?:licenses|copyleft) gpl", ("1.0", "2.0", "3.0")),
    ("lgpl", r"gnu (?:lesser|library) general public licen[cs]e / lesser general public licen[cs]e / gnu lgpl / lgpl", r"gnu org (?:licenses|copyleft) lgpl", ("2.0", "2.1", "3.0")),
    ("agpl", r"gnu affero general public licen[cs]e / affero general public licen[cs]e / gnu agpl / agpl", r"gnu org licenses agpl", ("1.0", "3.0")),
    ("gfdl", r"gnu free documentation licen[cs]e / gfdl", r"gnu org (?:licenses|copyleft) fdl", ("1.1", "1.2", "1.3")),
    ("apache", r"apache licen[cs]e / apache software licen[cs]e / !apache", r"apache org licenses(?: license)?", ("1.0", "1.1", "2.0")),
    ("mpl", r"mozilla public licen[cs]e / !mpl", r"mozilla org mpl", ("1.0", "1.1", "2.0")),
    ("epl", r"eclipse public licen[cs]e / !epl", r"eclipse org legal epl", ("1.0", "2.0")),
    ("cddl", r"common development and distribution licen[cs]e / cddl", r"opensource org licenses cddl", ("1.0", "1.1")),
    ("eupl", r"european union public licen[cs]e / eupl", r"joinup ec europa eu \S+ eupl", ("1.0", "1.1", "1.2")),
    ("artistic", r"artistic licen[cs]e / perl artistic licen[cs]e / !artistic", r"opensource org licenses artistic", ("1.0", "2.0")),
    ("cpl", r"common public licen[cs]e / !cpl", r"opensource org licenses cpl", ("1.0",)),
    ("ipl", r"ibm public licen[cs]e / !ipl", r"opensource org licenses ipl", ("1.0",)),
    ("osl", r"open software licen[cs]e / !osl", r"opensource org licenses osl", ("1.0", "2.0", "2.1", "3.0")),
    ("afl", r"academic free licen[cs]e / !afl", r"opensource org licenses afl", ("2.0", "2.1", "3.0")),
    ("apsl", r"apple public source licen[cs]e / apsl", r"opensource apple com apsl", ("1.0", "2.0")),
    ("ofl", r"sil open font licen[cs]e / open font licen[cs]e / !ofl", r"scripts sil org ofl", ("1.0", "1.1")),
    ("lppl", r"latex project public licen[cs]e / lppl", r"latex project org lppl", ("1.0", "1.2", "1.3")),
    ("cecill", r"cecill(?: free software licen[cs]e)?", r"cecill info licences", ("1.0", "2.0", "2.1")),
    ("php", r"php licen[cs]e", r"php net license", ("3.0", "3.01")),
    ("python", r"python software foundation licen[cs]e / psf licen[cs]e / python licen[cs]e", r"python org \S+ license", ("2.0",)),
    ("zpl", r"zope public licen[cs]e / !zpl", r"zope org resources zpl", ("1.1", "2.0", "2.1")),
    ("bsl", r"boost software licen[cs]e", r"boost org license", ("1.0",)),
    ("busl", r"business source licen[cs]e / busl", r"mariadb com bsl", ("1.0", "1.1")),
    ("sspl", r"server side public licen[cs]e / sspl", r"mongodb com licensing server side public license", ("1.0",)),
    ("elastic", r"elastic licen[cs]e", r"elastic co licensing elastic license", ("1.0", "2.0")),
    ("upl", r"universal permissive licen[cs]e", r"oss oracle com licenses upl", ("1.0",)),
    ("mulan", r"mulan (?:permissive software licen[cs]e|psl)", r"license coscl org cn mulanpsl", ("1.0", "2.0")),
    ("odbl", r"open (?:data commons open )?database licen[cs]e / odbl", r"opendatacommons org licenses odbl", ("1.0",)),
    ("odc-by", r"open data commons attribution licen[cs]e / odc by", r"opendatacommons org licenses by", ("1.0",)),
    ("pddl", r"public domain dedication and licen[cs]e / pddl", r"opendatacommons org licenses pddl", ("1.0",)),
    ("cc0", r"creative commons zero / cc0 / cc zero", r"creativecommons org publicdomain zero", ("1.0",)),
    ("ncsa", r"(?:university of illinois )?ncsa open source licen[cs]e", r"otm illinois edu uiuc opensource", ()),
    ("mit", r"mit licen[cs]e / mit x11 licen[cs]e / expat licen[cs]e", r"opensource org licenses mit", ()),
    ("mit-0", r"mit no attribution(?: licen[cs]e)? / mit 0", r"opensource org licenses mit 0", ()),
    ("isc", r"isc licen[cs]e", r"opensource org licenses isc(?: license)?", ()),
    ("bsd-2-clause", r"(?:simplified|freebsd|2 clause|two clause) bsd(?: licen[cs]e)? / bsd 2 clause(?: licen[cs]e)?", r"opensource org licenses bsd 2 clause", ()),
    ("bsd-3-clause", r"(?:new|modified|revised|3 clause|three clause) bsd(?: licen[cs]e)? / bsd 3 clause(?: licen[cs]e)?", r"opensource org licenses bsd 3 clause", ()),
    ("bsd-4-clause", r"(?:original|4 clause|four clause) bsd(?: licen[cs]e)? / bsd 4 clause(?: licen[cs]e)?", r"spdx org licenses bsd 4 clause", ()),
    ("0bsd", r"(?:zero clause|0 clause) bsd(?: licen[cs]e)? / 0bsd / bsd zero clause(?: licen[cs]e)?", r"opensource org licenses 0bsd", ()),
    ("bsd", r"bsd (?:style )?licen[cs]e / berkeley software distribution licen[cs]e", r"opensource org licenses bsd license", ()),
    ("zlib", r"zlib(?: libpng)? licen[cs]e", r"zlib net zlib license / opensource org licenses zlib", ()),
    ("unlicense", r"(?:the )?unlicense", r"unlicense org", ()),
    ("wtfpl", r"wtfpl / do what the fuck you want to public licen[cs]e", r"wtfpl net", ()),
    ("beerware", r"beerware licen[cs]e / beer ware licen[cs]e", r"spdx org licenses beerware", ()),
    ("postgresql", r"postgresql licen[cs]e", r"postgresql org about licence", ()),
    ("openssl", r"openssl licen[cs]e", r"openssl org source license", ()),
    ("ruby", r"ruby licen[cs]e", r"ruby lang org en about license", ()),
    ("vim", r"vim licen[cs]e", r"vimhelp org uganda", ()),
    ("json", r"json licen[cs]e", r"json org license", ()),
    ("curl", r"curl licen[cs]e", r"curl (?:se|haxx se) docs copyright", ()),
    ("x11", r"x11 licen[cs]e", r"spdx org licenses x11", ()),
    ("w3c", r"w3c (?:software )?(?:notice and )?licen[cs]e", r"w3 org consortium legal", ()),
    ("ms-pl", r"microsoft public licen[cs]e / ms pl", r"opensource org licenses ms pl", ()),
    ("ms-rl", r"microsoft reciprocal licen[cs]e / ms rl", r"opensource org licenses ms rl", ()),
    ("openrail", r"openrail(?: m)? licen[cs]e / open rail(?: m)? licen[cs]e / bloom rail(?: 1 0)? licen[cs]e", r"huggingface co spaces \S+ license", ()),
    ("llama", r"llama (?:\d )*community licen[cs]e(?: agreement)?", r"llama meta com license / ai meta com llama license", ()),
    ("commons-clause", r"commons clause(?: licen[cs]e condition)?", r"commonsclause com", ()),
]

#: Creative Commons: parts of the name after `by`, and the words that stand for them.
CC = {"by": "", "by-sa": "sa", "by-nc": "nc", "by-nd": "nd", "by-nc-sa": "nc sa", "by-nc-nd": "nc nd"}
CC_WORDS = {"sa": r"(?:sa|share ?alike)", "nc": r"(?:nc|non ?commercial)", "nd": r"(?:nd|no ?deriv(?:ative)?s?(?: works)?)"}
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")

#: Wording of licenses and of their standard headers: label, keyword, words. `..` stands for up to twelve words.
WORDINGS = [
    ("mit", "hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "without limitation the rights", r"deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell"),
    ("isc", "with or without fee", r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted"),
    ("bsl-1.0", "hereby granted", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("bsd", "source and binary forms", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse or promote", r"neither the names? of .. may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("apache-2.0", "except in compliance", r"licensed under the apache license version 2 0 the license you may not use this (?:file|work|project) except in compliance with the license"),
    ("gpl", "published by the free software", r"you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-2.0-or-later", "published by the free software", r"terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3.0-or-later", "published by the free software", r"terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2.0", "published by the free software", r"terms of the gnu general public license version 2 (?:only )?as published by the free software foundation"),
    ("lgpl-2.1-or-later", "published by the free software", r"terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("lgpl-3.0-or-later", "published by the free software", r"terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("agpl-3.0-or-later", "published by the free software", r"terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gfdl", "free documentation", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl-2.0", "source code form", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", "contents of this file", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("cddl", "contents of this file", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("epl-1.0", "accompanying materials", r"accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("epl-2.0", "accompanying materials", r"accompanying materials are made available under the terms of the eclipse public license (?:v )?2 0"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("zlib", "altered source versions", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("wtfpl", "what the fuck", r"you just do what the fuck you want to"),
    ("cc0", "waived all copyright", r"has waived all copyright and related or neighboring rights"),
    ("cc0", "public domain dedication", r"no copyright .. public domain dedication"),
    ("ofl-1.1", "font software", r"this font software is licensed under the sil open font license version 1 1"),
    ("beerware", "buy me a beer", r"you can buy me a beer in return"),
    ("json", "not evil", r"the software shall be used for good not evil"),
    ("python-2.0", "psf", r"psf hereby grants licensee a nonexclusive royalty free world wide license"),
    ("upl-1.0", "larger work", r"the software a larger work to which the software is contributed"),
    ("sspl-1.0", "service source code", r"make the service source code available via network download to everyone"),
    ("busl-1.1", "change date", r"effective on the change date .. the licensor hereby grants you rights under the terms of the change license"),
    ("commons-clause", "will not include", r"the grant of rights under the license will not include and the license does not grant to you the right to sell the software"),
    ("public-domain", "public domain", r"(?:released|placed|dedicated|put) (?:in ?to|to|in) the public domain"),
    ("openssl", "openssl toolkit", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("lppl", "latex project public", r"this work may be distributed and or modified under the conditions of the latex project public license"),
    ("artistic-2.0", "artistic license", r"you may redistribute it and or modify it under the terms of the artistic license (?:v )?2 0"),
    ("postgresql", "written agreement", r"for any purpose without fee and without a written agreement is hereby granted"),
]

GIVEN = r"(?:(?:re)?licen[cs]ed|released|distributed|published|provided|offered|shared|covered|made available|available|redistribute it|use) (?:\S+ ){0,2}?(?:under|by|with|per)(?: the| a| an)?(?: terms of| terms and conditions of| conditions of)?(?: the| a| an)? "
#: Families whose versions are also given as `or later`.
GNU = ("gpl", "lgpl", "agpl", "gfdl")
LATER = r"(?: (?:only )?or(?: at your option)?(?: any)? (?:later|newer|higher)(?: versions?)?)"


class Rule(NamedTuple):
    label: str
    kind: str
    keyword: str
    pattern: str


def version(number: str) -> str:
    """Words of a version: `3.0` is 3, v3, 3 0, version 3, version 3 0."""
    major, minor = number.split(".")
    return rf"(?: (?:version|ver|v))? ?v?{major}" + (r"(?: 0)?" if minor == "0" else f" {minor}")


def literal(pattern: str) -> str:
    """The longest literal run of words in a pattern, outside of groups, that begins at the start of a word."""
    flat, depth = "", 0
    for part in re.split(r"(\(\?:|\)\??|\[.*?\]|\\.|\{.*?\}|.\?)", pattern):
        depth += part.startswith("(?:")
        flat += "|" if depth or re.fullmatch(r"\(\?:|\)\??|\[.*?\]|\\.|\{.*?\}|.\?", part) else part
        depth -= part.startswith(")")
    return max(re.findall(r"(?:^|(?<=[ |]))[a-z0-9][a-z0-9 ]*", flat), key=len).strip()


def rules() -> list[Rule]:
    """All rules in order: kinds from the strongest to the weakest, then as in the tables above."""
    out = [Rule(label, "name", phrase, phrase) for phrase, label in BASE.items()]
    for label, key, words in WORDINGS:
        out.append(Rule(label, "wording", key, words.replace(" .. ", r" (?:\S+ ){0,12}?")))
    for family, names, addresses, versions in FAMILIES:
        for name in names.split(" / "):
            key, bare = literal(name.lstrip("!")), name.lstrip("!")
            out += [] if name.startswith("!") else [Rule(family, "name", key, name), Rule(family, "notice", key, GIVEN + name)]
            for v in versions:
                label, words = f"{family}-{v}", bare + version(v)
                out += [Rule(label, "version", key, words), Rule(label, "notice", key, GIVEN + words)]
                if family in GNU:
                    out += [Rule(f"{label}-or-later", "version", key, words + LATER), Rule(f"{label}-or-later", "notice", key, GIVEN + words + LATER)]
        words = family.replace("-", " ")
        for a in addresses.split(" / "):
            out.append(Rule(family, "address", literal(a), a))
            out += [Rule(f"{family}-{v}", "address", literal(a), a + version(v)) for v in versions]
        out.append(Rule(family, "identifier", "spdx license identifier", f"spdx license identifier {words}"))
        for v in versions:
            major, minor = v.split(".")
            of = f"spdx license identifier {words} {major} {minor}"
            out.append(Rule(f"{family}-{v}", "identifier", "spdx license identifier", of + "(?: only)?"))
            if family in GNU:
                out.append(Rule(f"{family}-{v}-or-later", "identifier", "spdx license identifier", of + " or later"))
    for kind, more in CC.items():
        short = " ".join(["by", *more.split()])
        long_ = " ".join(["attribution", *(CC_WORDS[x] for x in more.split())])
        forms = [(f"cc {short}", f"cc {short}"), (f"creative commons {long_}", "creative commons attribution")]
        for v in (None, *CC_VERSIONS):
            label = f"cc-{kind}" + (f"-{v}" if v else "")
            for words, key in forms:
                full = words + (r"(?: (?:international|unported|generic|public))?(?: licen[cs]e)?" + version(v) if v else "")
                out += [Rule(label, "version" if v else "name", key, full), Rule(label, "notice", key, GIVEN + full)]
            number = " " + v.replace(".", " ") if v else ""
            out.append(Rule(label, "address", f"creativecommons org licenses {short}", f"creativecommons org licenses {short}{number}"))
            out.append(Rule(label, "identifier", "spdx license identifier", f"spdx license identifier cc {short}{number}"))
    order = list(KINDS)
    return sorted(dict.fromkeys(out), key=lambda r: order.index(r.kind))


#: Bytes that are no part of a word, after lower-casing, become a space.
WORD_BYTES = bytes(b if b in b"0123456789abcdefghijklmnopqrstuvwxyz" or b >= 0x80 else 0x20 for b in range(256))
SPACES = re.compile(rb"  +")

Hit = tuple[int, int, int, int]


def words_of(raw: bytes | None) -> bytes:
    """The words of a text with one space before, between and after them; b" " if there is none."""
    inner = SPACES.sub(b" ", (raw or b"").lower().translate(WORD_BYTES)).strip(b" ")
    return b" " + inner + b" " if inner else b" "


def unsuppressed(hits: list[Hit]) -> list[bool]:
    """Whether each of hits (strength, start, end, rule) stands: no stronger one, or longer one of equal strength, contains it.

    In order of strength, the intervals that stand and lie within no other that stands are kept sorted; their starts and ends
    both rise, so that the last one that starts no later than a hit decides.
    """
    stands = [False] * len(hits)
    starts: list[int] = []
    ends: list[int] = []
    for i in sorted(range(len(hits)), key=lambda i: (hits[i][0], hits[i][1] - hits[i][2], hits[i][3], hits[i][1])):
        _, start, end, _ = hits[i]
        k = bisect.bisect_right(starts, start)
        if k and ends[k - 1] >= end:
            continue
        stands[i] = True
        first = k - 1 if k and starts[k - 1] == start else k
        last = bisect.bisect_right(ends, end)
        starts[first : max(first, last)], ends[first : max(first, last)] = [start], [end]
    return stands


class Scanner:
    """The rules, with an automaton of their keywords. A rule is compiled when its keyword is first met."""

    def __init__(self, of: list[Rule] | None = None):
        import ahocorasick

        self.rules = rules() if of is None else of
        self.strength = {kind: k for k, kind in enumerate(KINDS)}
        self.by_keyword: dict[str, list[int]] = {}
        self.compiled: dict[int, re.Pattern] = {}
        self.gate = ahocorasick.Automaton()
        for k, rule in enumerate(self.rules):
            self.by_keyword.setdefault(rule.keyword, []).append(k)
        for key in self.by_keyword:
            self.gate.add_word(f" {key}", key)
        self.gate.make_automaton()

    def pattern(self, k: int) -> re.Pattern:
        if k not in self.compiled:
            self.compiled[k] = re.compile(rf"(?<= )(?:{self.rules[k].pattern})(?= )".encode())
        return self.compiled[k]

    def scan(self, raw: bytes | None) -> tuple[int, list[tuple[int, int, int, bool]]]:
        """The number of words, and matches (rule, first word, last word, whether it stands) in the order of their places."""
        text = words_of(raw)
        met = sorted(k for key in {key for _, key in self.gate.iter(text.decode("latin-1"))} for k in self.by_keyword[key])
        hits = [(self.strength[self.rules[k].kind], m.start(), m.end(), k) for k in met for m in self.pattern(k).finditer(text)]
        hits.sort(key=lambda h: (h[1], -h[2], h[3]))
        out, at, word = [], 0, -1
        for (_, start, end, k), stands in zip(hits, unsuppressed(hits), strict=True):
            word, at = word + text.count(b" ", at, start), start
            out.append((k, word, word + text.count(b" ", start, end), stands))
        return text.count(b" ") - 1, out


def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner()
    kind = pa.list_(pa.struct({"rule": pa.int32(), "label": pa.string(), "kind": pa.string(), "first": pa.int64(), "last": pa.int64(), "stands": pa.bool_()}))
    for batch in batches:
        n, found = [], []
        for raw in batch.column("raw"):
            words, hits = scanner.scan(raw.as_py())
            n.append(words)
            found.append([{"rule": k, "label": scanner.rules[k].label, "kind": scanner.rules[k].kind, "first": a, "last": b, "stands": s} for k, a, b, s in hits])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(found, kind)], ["doc_id", "n_words", "matches"])


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, matches) for every row of docs(doc_id, text); matches are (rule, label, kind, first, last, stands), the
    words counted from 0.

    Null, empty and wordless texts have no words and no matches; a text of any length is scanned whole, in time that grows with
    its length and its matches. Repeated rows are scanned alike, an empty table gives no rows, and other columns aren't read.
    """
    small_batches(docs.sparkSession)
    known = docs.select("doc_id", F.col("text").cast("binary").alias("raw"))
    kind = known.schema["doc_id"].dataType.simpleString()
    matches = "array<struct<rule:int,label:string,kind:string,first:bigint,last:bigint,stands:boolean>>"
    return known.mapInArrow(lambda it: lean(scanned(it)), f"doc_id {kind}, n_words long, matches {matches}")


def sureness(kinds: Column) -> Column:
    """One minus the product of the doubts that distinct matches leave."""
    weight = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    return F.round(1 - F.aggregate(kinds, F.lit(1.0), lambda doubt, k: doubt * (1 - F.element_at(weight, k["kind"]))), 6)


def digest(found: DataFrame) -> DataFrame:
    """Counts, places and labels of the base phrases; labels of all rules that stand; and how sure they are."""
    base = F.filter("matches", lambda m: m["rule"].isin(*[k for k, r in enumerate(rules()) if r.kind == "name" and r.pattern in BASE and r.label == BASE[r.pattern]]))
    found = found.withColumn("base", base).withColumn("standing", F.filter("matches", lambda m: m["stands"]))
    label = lambda c: F.transform(c, lambda m: m["label"])
    first = F.transform("base", lambda m: m["first"])
    distinct = F.array_distinct(F.transform("standing", lambda m: F.struct(m["label"].alias("label"), m["kind"].alias("kind"))))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(first).alias("first_word"),
        F.array_max(first).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(label("base"))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(label("base"), label("standing"))), ",").alias("labels"),
        sureness(F.array_sort(distinct)).alias("score"),
    )
