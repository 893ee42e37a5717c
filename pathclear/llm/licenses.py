"""License scan by ordered signature rules.

A text becomes its words: letters A-Z lower-cased, runs of digits, letters and everything beyond ASCII.
Rules are regular expressions over the words, each with one space on both sides, tried only where one of the
words they are keyed by occurs; every text that a rule matches has one of its keys as a word. Detections are then resolved by rank: one that lies within the words of a
detection of a higher-ranked rule, or of a longer one of equal rank, is suppressed. The base phrases are
always counted.

The rules are made from a table of license families: for each its names, versions and web addresses, in
the forms in which notices cite them.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, groupby

import pyarrow as pa
from pyspark.sql import DataFrame

#: Base phrases and their labels.
BASE = ((b"mit license", "mit"), (b"apache license", "apache"), (b"general public license", "gpl"))

#: Label stem, names (patterns over words), versions, identifier as words, key words (one must occur).
FAMILIES = (
    ("apache", ("apache software license", "apache license", "asl"), ("1.0", "1.1", "2.0"), "apache", ("apache", "asl")),
    ("gpl", ("gnu general public license", "gnu gpl", "gpl"), ("1.0", "2.0", "3.0"), "gpl", ("gpl", "gnu")),
    ("lgpl", ("gnu lesser general public license", "gnu library general public license", "gnu lgpl", "lgpl"), ("2.0", "2.1", "3.0"), "lgpl", ("lgpl", "lesser", "library")),
    ("agpl", ("gnu affero general public license", "affero general public license", "gnu agpl", "agpl"), ("1.0", "3.0"), "agpl", ("agpl", "affero")),
    ("gfdl", ("gnu free documentation license", "gfdl"), ("1.1", "1.2", "1.3"), "gfdl", ("gfdl", "documentation")),
    ("mpl", ("mozilla public license", "mpl"), ("1.0", "1.1", "2.0"), "mpl", ("mozilla", "mpl")),
    ("epl", ("eclipse public license", "epl"), ("1.0", "2.0"), "epl", ("eclipse", "epl")),
    ("cddl", ("common development and distribution license", "cddl"), ("1.0", "1.1"), "cddl", ("cddl", "distribution")),
    ("cpl", ("common public license",), ("0.5", "1.0"), "cpl", ("common",)),
    ("eupl", ("european union public licen[cs]e", "eupl"), ("1.0", "1.1", "1.2"), "eupl", ("european", "eupl")),
    ("osl", ("open software license",), ("1.0", "2.0", "2.1", "3.0"), "osl", ("open", "osl")),
    ("afl", ("academic free license",), ("1.1", "1.2", "2.0", "2.1", "3.0"), "afl", ("academic", "afl")),
    ("artistic", ("artistic license",), ("1.0", "2.0"), "artistic", ("artistic",)),
    ("ms-pl", ("microsoft public license", "ms pl"), (), "ms pl", ("microsoft", "ms")),
    ("ms-rl", ("microsoft reciprocal license", "ms rl"), (), "ms rl", ("microsoft", "ms")),
    ("isc", ("isc license",), (), "isc", ("isc",)),
    ("zlib", ("zlib license", "zlib libpng license"), (), "zlib", ("zlib",)),
    ("bsl", ("boost software license",), ("1.0",), "bsl", ("boost", "bsl")),
    ("psf", ("python software foundation license", "psf license"), ("2.0",), "psf", ("python", "psf")),
    ("php", ("php license",), ("3.0", "3.01"), "php", ("php",)),
    ("ofl", ("sil open font license", "open font license", "ofl"), ("1.0", "1.1"), "ofl", ("ofl", "font")),
    ("upl", ("universal permissive license",), ("1.0",), "upl", ("universal", "upl")),
    ("ncsa", ("university of illinois ncsa open source license",), (), "ncsa", ("ncsa",)),
    ("unlicense", ("the unlicense",), (), "unlicense", ("unlicense",)),
    ("wtfpl", ("do what the fuck you want to public license",), ("2",), "wtfpl", ("wtfpl", "fuck")),
    ("vim", ("vim license",), (), "vim", ("vim",)),
    ("openssl", ("openssl license",), (), "openssl", ("openssl",)),
    ("postgresql", ("postgresql license",), (), "postgresql", ("postgresql",)),
    ("w3c", ("w3c software notice and license", "w3c license"), (), "w3c", ("w3c",)),
    ("json", ("json license",), (), "json", ("json",)),
    ("ecl", ("educational community license",), ("1.0", "2.0"), "ecl", ("educational", "ecl")),
    ("nasa", ("nasa open source agreement",), ("1.3",), "nasa", ("nasa",)),
    ("lppl", ("latex project public license", "lppl"), ("1.0", "1.2", "1.3c"), "lppl", ("latex", "lppl")),
    ("cecill", ("cecill free software license agreement", "cecill"), ("1.0", "2.0", "2.1"), "cecill", ("cecill",)),
    ("mulan", ("mulan permissive software license", "mulan psl"), ("1", "2"), "mulanpsl", ("mulan", "mulanpsl")),
    ("mit-0", ("mit no attribution",), (), "mit 0", ("mit",)),
    ("mit", ("mit license", "expat license", "x11 license"), (), "mit", ("mit", "expat", "x11")),
)
_BSD = {"0": ("zero clause", "0 clause"), "1": ("one clause", "1 clause"), "2": ("two clause", "2 clause", "simplified", "freebsd"),
        "3": ("three clause", "3 clause", "new", "revised", "modified"), "4": ("four clause", "4 clause", "original", "old")}
_COMMONS = {"by": "attribution", "by-sa": "attribution share ?alike", "by-nd": "attribution no ?deriv[a-z]*",
            "by-nc": "attribution non ?commercial", "by-nc-sa": "attribution non ?commercial share ?alike",
            "by-nc-nd": "attribution non ?commercial no ?deriv[a-z]*"}
#: Sentences of license texts themselves.
_TEXTS = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "hereby"),
    ("bsd", "redistributions? of source code must retain the above copyright notice", "redistributions redistribution"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution"),
    ("bsd-3-clause", "neither the name of (?:[^ ]+ ){1,12}may be used to endorse or promote products", "endorse"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software", "advertising"),
    ("zlib", "this software is provided as is without any express or implied warranty", "implied"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license", "redistribute"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license", "redistribute"),
    ("apache-2.0", "you may not use this file except in compliance with the license", "compliance"),
    ("cc0-1.0", "(?:creative commons )?cc0 1 0 universal", "cc0"),
    ("public-domain", "(?:dedicated to|released into|placed in|in) the public domain", "domain"),
    ("proprietary", "all rights reserved", "reserved"),
)


#: Identifiers that are products too (Apache 2.4, apache2, php3): a bare major version needs a v or the word license.
_PRODUCTS = ("apache", "php")


@dataclass(frozen=True)
class Rule:
    label: str
    rank: int
    pattern: re.Pattern
    keys: frozenset[bytes]


def _rules() -> list[Rule]:
    out: list[Rule] = []

    def add(label: str, rank: int, pattern: str, keys) -> None:
        out.append(Rule(label, rank, re.compile(f" (?:{pattern}) ".encode()), frozenset(k.encode() for k in keys)))

    def words(version: str) -> str:
        whole = version.removesuffix(".0").replace(".", " ")
        return f"{whole}(?: 0)?" if version.endswith(".0") else whole

    def cited(ident: str, version: str) -> str:
        """Identifier and version, spaced or joined."""
        if version.endswith(".0") and ident in _PRODUCTS:
            major = version.removesuffix(".0")
            return f"{ident} ?(?:v?{major} 0|v{major}(?! [0-9])|v?{major}(?= licen[cs]e))"
        return f"{ident} ?v?{words(version)}"

    for stem, names, versions, ident, keys in FAMILIES:
        any_name = "|".join(names)
        for v in versions:
            label, n = f"{stem}-{v}", words(v)
            add(f"{label}-or-later", 95, f"(?:{any_name}) (?:as published by the free software foundation )?(?:either )?(?:version |v )?{n} (?:of the license )?or (?:at your option )?(?:any )?(?:later|newer)(?: version)?", keys)
            add(label, 90, f"(?:{any_name}) (?:the )?(?:version |v |ver )?v?{n}", keys)
            add(label, 85, f"version {n} of the (?:{any_name})", keys)
            add(label, 100, f"spdx license identifier {ident} {v.replace('.', ' ')}(?: only)?", ["spdx"])
            add(f"{label}-or-later", 101, f"spdx license identifier {ident} {v.replace('.', ' ')} or later", ["spdx"])
            major = v.split(".")[0]
            forms = [ident, f"{ident}{major}", f"{ident}v{major}"]
            add(f"{label}-or-later", 95, f"{cited(ident, v)} or (?:at your option )?(?:any )?(?:later|newer)(?: version)?", forms)
            add(label, 80, cited(ident, v), forms)
        add(stem, 100, f"spdx license identifier {ident}", ["spdx"])
        add(stem, 60, f"(?:released|licensed|distributed|available|provided) under (?:the )?(?:terms of )?(?:the )?(?:{any_name})", keys)
        add(stem, 50, any_name, keys)
        add(stem, 70, f"opensource org licenses? {ident}(?: license(?: php)?)?", ["opensource"])
    for n, names in _BSD.items():
        label, any_name = f"bsd-{n}-clause", "|".join(names)
        add(label, 90, f"(?:the )?(?:{any_name}) (?:bsd|berkeley) license|bsd (?:{any_name})(?: license)?", ["bsd", "berkeley"])
        add(label, 100, f"spdx license identifier bsd {n} clause", ["spdx"])
    add("bsd", 50, "bsd (?:style )?license|berkeley software distribution", ["bsd", "berkeley"])
    for code, name in _COMMONS.items():
        short = code.replace("-", " ")
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            n = v.replace(".", " ")
            add(f"cc-{code}-{v}", 90, f"creative commons {name}(?: license)? (?:version )?{n}(?: (?:international|unported|generic))?", ["creative"])
            add(f"cc-{code}-{v}", 88, f"creativecommons org licenses {short} {n}", ["creativecommons"])
            add(f"cc-{code}-{v}", 100, f"(?:spdx license identifier )?cc {short} {n}", ["cc"])
        add(f"cc-{code}", 50, f"creative commons {name}", ["creative"])
    for label, sentence, key in _TEXTS:
        add(label, 75, sentence, key.split())
    for stem, place in (("apache-2.0", "apache org licenses license 2 0"), ("gpl", "gnu org licenses gpl"), ("lgpl", "gnu org licenses lgpl"),
                        ("agpl-3.0", "gnu org licenses agpl 3 0"), ("mpl-2.0", "mozilla org mpl 2 0")):
        add(stem, 70, place, ["licenses", "mpl"])
    return out


RULES = _rules()
_KEYS = frozenset().union(*(r.keys for r in RULES)) | {b"license"}
#: Lower case for A-Z; every ASCII byte that is no digit or letter becomes a space.
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass
class Found:
    """Base places are (first word, label); detections (first word, words, label, rank)."""

    n_words: int
    base: list[tuple[int, str]]
    kept: list[tuple[int, int, str, int]]


def _places(text: bytes, phrase: bytes) -> list[int]:
    out, at = [], text.find(phrase)
    while at >= 0:
        out.append(at)
        at = text.find(phrase, at + 1)
    return out


def resolve(found: list[tuple[int, int, str, int]]) -> list[tuple[int, int, str, int]]:
    """Detections (start, words, label, rank) that no better one contains, in their order."""
    kept: list[tuple[int, int, str, int]] = []
    for _, same in groupby(sorted(found, key=lambda f: (-f[3], f[0], -f[1], f[2])), key=lambda f: f[3]):
        starts = [k[0] for k in kept]
        reach = list(accumulate((k[0] + k[1] for k in kept), max))
        far, new = -1, []
        for start, n, label, rank in same:
            at = bisect_right(starts, start)
            if max(far, reach[at - 1] if at else -1) < start + n:
                far = start + n
                new.append((start, n, label, rank))
        kept = sorted(kept + new)
    return kept


def detect(text: str, gated: bool = True) -> Found:
    """``gated=False`` tries every rule, with the same result."""
    words = text.encode().translate(_TABLE).split()
    keys = _KEYS.intersection(words) if gated else _KEYS
    if not keys:
        return Found(len(words), [], [])
    line = b" " + b" ".join(words) + b" "
    hits: list[tuple[int, int, str, int]] = []
    for rule in RULES:
        if not keys.isdisjoint(rule.keys):
            for m in rule.pattern.finditer(line):
                hits.append((m.start(), m.end(), rule.label, rule.rank))
    places = [(at, label) for phrase, label in BASE if b"license" in keys for at in _places(line, b" " + phrase + b" ")]
    if not hits and not places:
        return Found(len(words), [], [])
    number: dict[int, int] = {}
    count = last = 0
    for at in sorted({p for p, _ in places} | {p for h in hits for p in (h[0], h[1] - 1)}):
        count += line.count(b" ", last, at)
        number[at], last = count, at
    return Found(len(words), [(number[at], label) for at, label in places],
                 resolve([(number[a], number[b - 1] - number[a], label, rank) for a, b, label, rank in hits]))


def scan(docs: DataFrame) -> DataFrame:
    """Words, base places and resolved detections of every text.

    Returns ``doc_id, n_words long, base`` (array of start and label) and ``found`` (array of start,
    words, label, rank), starts in words from 0. Null and empty texts have no words. Repeated rows are
    scanned each, texts whole; other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    base_type = pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))
    found_type = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64()), ("label", pa.string()), ("rank", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [detect(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([d.n_words for d in done], pa.int64()),
                 pa.array([[{"start": s, "label": x} for s, x in d.base] for d in done], base_type),
                 pa.array([[{"start": s, "words": n, "label": x, "rank": r} for s, n, x, r in d.kept] for d in done], found_type)],
                names=["doc_id", "n_words", "base", "found"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_words long, base array<struct<start:bigint,label:string>>, "
        "found array<struct<start:bigint,words:bigint,label:string,rank:int>>")
