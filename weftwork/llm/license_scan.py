"""License scans: ordered signature rules, gated by keywords, with priorities and interval containment.

A rule is a regular expression with keywords that every match holds ("a|b": one of them), a label, a priority and a
confidence. One pass of an automaton over the lower-cased text tells which keywords occur; only rules whose keywords
all do run. Where
detections overlap, one that lies inside another of no lower priority, or that overlaps one of a higher priority,
is suppressed. Phrases of words (the base) are found apart from the rules and are never suppressed.
"""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass
from functools import cache, lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.llm.common import LOWER_BYTES, WORD_BYTES, small_batches, text_blocks, word_spans

#: Phrases of the base and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: bytes
    keywords: tuple[str, ...]
    label: str
    priority: int
    confidence: float


#: Label, names as they are written (regular expressions), identifiers, and words of the name for the gate.
FAMILIES = [
    ("gpl", r"gnu (?:lesser |library |affero )?general public licen[cs]e|gpl", ("gpl-1.0", "gpl-2.0", "gpl-3.0", "gpl-2.0-only", "gpl-3.0-only", "gpl-2.0-or-later", "gpl-3.0-or-later"), ("1", "2", "3")),
    ("lgpl", r"gnu (?:lesser|library) general public licen[cs]e|lgpl", ("lgpl-2.0", "lgpl-2.1", "lgpl-3.0", "lgpl-2.1-only", "lgpl-3.0-only", "lgpl-2.1-or-later", "lgpl-3.0-or-later"), ("2", "2.1", "3")),
    ("agpl", r"gnu affero general public licen[cs]e|agpl", ("agpl-1.0", "agpl-3.0", "agpl-3.0-only", "agpl-3.0-or-later"), ("1", "3")),
    ("gfdl", r"gnu free documentation licen[cs]e|gfdl", ("gfdl-1.1", "gfdl-1.2", "gfdl-1.3"), ("1.1", "1.2", "1.3")),
    ("apache", r"apache (?:software )?licen[cs]e|apache", ("apache-1.0", "apache-1.1", "apache-2.0"), ("1.0", "1.1", "2.0")),
    ("mit", r"mit licen[cs]e|mit/x11|expat licen[cs]e|x11 licen[cs]e", ("mit", "mit-0", "x11", "mit-cmu"), ()),
    ("bsd", r"(?:(?:simplified|revised|new|modified|original|[234][- ]clause) )?bsd(?: licen[cs]e)?", ("bsd-2-clause", "bsd-3-clause", "bsd-4-clause", "0bsd", "bsd-3-clause-clear"), ("2", "3", "4")),
    ("mpl", r"mozilla public licen[cs]e|mpl", ("mpl-1.0", "mpl-1.1", "mpl-2.0"), ("1.0", "1.1", "2.0")),
    ("epl", r"eclipse public licen[cs]e|epl", ("epl-1.0", "epl-2.0"), ("1.0", "2.0")),
    ("cddl", r"common development and distribution licen[cs]e|cddl", ("cddl-1.0", "cddl-1.1"), ("1.0", "1.1")),
    ("cpl", r"common public licen[cs]e|cpl", ("cpl-1.0",), ("1.0",)),
    ("eupl", r"european union public licen[cs]e|eupl", ("eupl-1.0", "eupl-1.1", "eupl-1.2"), ("1.0", "1.1", "1.2")),
    ("artistic", r"artistic licen[cs]e|perl artistic", ("artistic-1.0", "artistic-2.0", "clartistic"), ("1.0", "2.0")),
    ("isc", r"isc licen[cs]e", ("isc",), ()),
    ("zlib", r"zlib(?:/libpng)? licen[cs]e", ("zlib", "zlib-acknowledgement", "libpng-2.0"), ()),
    ("boost", r"boost software licen[cs]e", ("bsl-1.0",), ("1.0",)),
    ("unlicense", r"the unlicen[cs]e", ("unlicense",), ()),
    ("wtfpl", r"wtfpl|do what the fuck you want to public licen[cs]e", ("wtfpl",), ("2",)),
    ("python", r"python software foundation licen[cs]e|psf licen[cs]e", ("psf-2.0", "python-2.0"), ("2",)),
    ("openssl", r"openssl licen[cs]e|ssleay licen[cs]e", ("openssl",), ()),
    ("ofl", r"sil open font licen[cs]e|open font licen[cs]e", ("ofl-1.0", "ofl-1.1"), ("1.0", "1.1")),
    ("odbl", r"open (?:data commons )?(?:open )?database licen[cs]e|odbl", ("odbl-1.0",), ("1.0",)),
    ("odc-by", r"open data commons attribution licen[cs]e|odc-by", ("odc-by-1.0",), ("1.0",)),
    ("pddl", r"public domain dedication and licen[cs]e|pddl", ("pddl-1.0",), ("1.0",)),
    ("cc0", r"cc0|cc[- ]zero|creative commons zero", ("cc0-1.0",), ("1.0",)),
    ("cc-by", r"(?:creative commons|cc)[- ]+(?:by|attribution)", ("cc-by-1.0", "cc-by-2.0", "cc-by-2.5", "cc-by-3.0", "cc-by-4.0"), ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-sa", r"(?:creative commons|cc)[- ]+(?:by[- ]sa|attribution[- ]share ?alike)", ("cc-by-sa-2.0", "cc-by-sa-2.5", "cc-by-sa-3.0", "cc-by-sa-4.0"), ("2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nc", r"(?:creative commons|cc)[- ]+(?:by[- ]nc|attribution[- ]non[- ]?commercial)", ("cc-by-nc-2.0", "cc-by-nc-2.5", "cc-by-nc-3.0", "cc-by-nc-4.0"), ("2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nd", r"(?:creative commons|cc)[- ]+(?:by[- ]nd|attribution[- ]no ?deriv(?:ative)?s)", ("cc-by-nd-2.0", "cc-by-nd-3.0", "cc-by-nd-4.0"), ("2.0", "3.0", "4.0")),
    ("cc-by-nc-sa", r"(?:creative commons|cc)[- ]+by[- ]nc[- ]sa", ("cc-by-nc-sa-2.0", "cc-by-nc-sa-3.0", "cc-by-nc-sa-4.0"), ("2.0", "3.0", "4.0")),
    ("cc-by-nc-nd", r"(?:creative commons|cc)[- ]+by[- ]nc[- ]nd", ("cc-by-nc-nd-2.0", "cc-by-nc-nd-3.0", "cc-by-nc-nd-4.0"), ("2.0", "3.0", "4.0")),
    ("afl", r"academic free licen[cs]e", ("afl-2.0", "afl-2.1", "afl-3.0"), ("2.0", "2.1", "3.0")),
    ("osl", r"open software licen[cs]e", ("osl-1.0", "osl-2.0", "osl-3.0"), ("1.0", "2.0", "3.0")),
    ("ecl", r"educational community licen[cs]e", ("ecl-1.0", "ecl-2.0"), ("1.0", "2.0")),
    ("ms-pl", r"microsoft public licen[cs]e", ("ms-pl",), ()),
    ("ms-rl", r"microsoft reciprocal licen[cs]e", ("ms-rl",), ()),
    ("qpl", r"q public licen[cs]e", ("qpl-1.0",), ("1.0",)),
    ("npl", r"netscape public licen[cs]e", ("npl-1.0", "npl-1.1"), ("1.0", "1.1")),
    ("apsl", r"apple public source licen[cs]e", ("apsl-1.0", "apsl-2.0"), ("1.0", "2.0")),
    ("sspl", r"server side public licen[cs]e", ("sspl-1.0",), ("1",)),
    ("busl", r"business source licen[cs]e", ("busl-1.1",), ("1.1",)),
    ("elastic", r"elastic licen[cs]e", ("elastic-2.0",), ("2.0",)),
    ("openrail", r"(?:creativeml )?open ?rail(?:-m)?(?: licen[cs]e)?", ("openrail", "openrail++"), ()),
    ("ncsa", r"university of illinois/ncsa open source licen[cs]e|ncsa licen[cs]e", ("ncsa",), ()),
    ("postgresql", r"postgresql licen[cs]e", ("postgresql",), ()),
    ("ruby", r"ruby licen[cs]e", ("ruby",), ()),
    ("php", r"php licen[cs]e", ("php-3.0", "php-3.01"), ("3.0", "3.01")),
    ("vim", r"vim licen[cs]e", ("vim",), ()),
    ("w3c", r"w3c (?:software|document)(?: notice and)? licen[cs]e", ("w3c", "w3c-19980720"), ()),
    ("unicode", r"unicode licen[cs]e|unicode,? inc\.? licen[cs]e agreement", ("unicode-dfs-2015", "unicode-dfs-2016", "unicode-3.0"), ()),
]

#: Signatures of texts and notices: name, pattern, keywords (single words, as texts wrap between them), label, priority, confidence.
TEXTS = [
    ("mit text", r"permission is hereby granted, free of charge, to any person obtaining a copy", ("hereby", "granted"), "mit", 5, 0.95),
    ("mit no warranty", r"the software is provided .{0,3}as is.{0,3}, without warranty of any kind", ("without", "warranty"), "mit", 3, 0.7),
    ("bsd text", r"redistribution and use in source and binary forms", ("redistribution",), "bsd", 5, 0.95),
    ("isc text", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose", ("permission", "distribute"), "isc", 5, 0.9),
    ("gpl text", r"this program is free software[;:,] you can redistribute it", ("free", "redistribute"), "gpl", 5, 0.9),
    ("gpl warranty", r"without even the implied warranty of merchantability", ("implied", "warranty"), "gpl", 3, 0.6),
    ("apache text", r"you may not use this file except in compliance with the licen[cs]e", ("compliance",), "apache", 5, 0.9),
    ("unlicense text", r"this is free and unencumbered software released into the public domain", ("unencumbered",), "unlicense", 5, 0.95),
    ("zlib text", r"this software is provided .{0,3}as-is.{0,3}, without any express or implied warranty", ("as-is",), "zlib", 5, 0.85),
    ("boost text", r"permission is hereby granted, free of charge, to any person or organi[sz]ation", ("hereby", "granted"), "boost", 6, 0.9),
    ("wtfpl text", r"you just do what the fuck you want to", ("fuck",), "wtfpl", 5, 0.9),
    ("public domain", r"(?:released|placed|dedicated) (?:in)?to the public domain", ("public", "domain"), "public-domain", 4, 0.8),
    ("reserved", r"all rights reserved", ("rights", "reserved"), "proprietary", 2, 0.5),
    ("copyright", r"copyright ?(?:\xc2\xa9|\(c\))? ?(?:19|20)[0-9]{2}", ("copyright",), "copyright", 1, 0.4),
    ("proprietary", r"(?:proprietary and confidential|confidential and proprietary)", ("proprietary",), "proprietary", 4, 0.8),
    ("no redistribution", r"(?:may not|must not|do not) (?:be )?(?:redistribut|reproduc|cop)(?:e|ied|y)", ("not",), "proprietary", 3, 0.6),
]

_VERSION = r",? ?(?:version |v\.? ?)?%s(?![0-9])(?: (?:only|or later|or any later version))?"


@cache
def rules() -> tuple[Rule, ...]:
    """All rules, first those of higher priority: identifiers, versions, declarations, names, then texts as they say."""
    found = []
    for label, names, identifiers, versions in FAMILIES:
        heads = [re.sub(r"\(\?:[^()]*\)\??|\[[^\]]*\]\??", " ", n) for n in _alternatives(names)]
        for names_one, head in zip(_alternatives(names), heads, strict=True):
            gate = max(re.split(r"[^a-z0-9]+", re.sub(r"licen ?e?", " ", head)), key=len)
            # what follows "cc" is a character class of space and hyphen, which _spaced leaves alone
            gates = ("creative|cc |cc-",) if names_one.startswith("(?:creative commons|cc)[- ]+") else (gate,) if gate else ()
            gates += ("licen",) if "licen" in head else ()
            name = f"(?<![a-z0-9])(?:{names_one})"
            for v in versions:
                found.append(Rule(f"{label} {v} by name", (name + _VERSION % re.escape(v)).encode(), gates, f"{label}-{v}", 8, 0.95))
            found.append(Rule(f"{label} declared", f"(?:licen[cs]ed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?{names_one}(?![a-z0-9])".encode(), (*gates, "under"), label, 6, 0.9))
            found.append(Rule(f"{label} named", (name + "(?![a-z0-9])").encode(), gates, label, 4, 0.75 if "licen" in names_one else 0.5))
        for one in identifiers:
            found.append(Rule(f"{one} identifier", f"spdx-licen[cs]e-identifier: ?{re.escape(one)}(?![a-z0-9.+-])".encode(), ("spdx",), one, 9, 1.0))
            found.append(Rule(f"{one} tag", rf"licen[cs]e ?[:=] ?[\"']?{re.escape(one)}(?![a-z0-9.+-])".encode(), ("licen", one.split("-")[0]), one, 7, 0.85))
    for name, pattern, keywords, label, priority, confidence in TEXTS:
        found.append(Rule(name, pattern.encode("latin-1"), keywords, label, priority, confidence))
    return tuple(sorted(found, key=lambda r: -r.priority))


def _alternatives(names: str) -> list[str]:
    out, depth, last = [], 0, 0
    for i, c in enumerate(names):
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            out.append(names[last:i])
            last = i + 1
    return [*out, names[last:]]


def _spaced(pattern: bytes) -> bytes:
    """Spaces outside of character classes match any white space, optional ones none as well."""
    swap = lambda m: {b" ": rb"[ \t\r\n]+", b" ?": rb"[ \t\r\n]*"}.get(m.group(), m.group())
    return re.sub(rb"\[[^\]]*\]| \??", swap, pattern)


@cache
def _compiled():
    """Rules with compiled patterns, and the automaton of their keywords."""
    automaton, compiled = ahocorasick.Automaton(), []
    numbers: dict[str, int] = {}
    for rule in rules():
        gates = [frozenset(numbers.setdefault(k, len(numbers)) for k in one.split("|")) for one in rule.keywords]
        compiled.append((rule, re.compile(_spaced(rule.pattern)), gates))
    for word, number in numbers.items():
        automaton.add_word(word, number)
    automaton.make_automaton()
    return compiled, automaton


def detections(lowered: bytes) -> list[tuple[int, int, Rule]]:
    """(start, end, rule) of the detections that stay, by start; bytes of the lower-cased text."""
    _, automaton = _compiled()
    found = []
    for rule, pattern in _open(frozenset(number for _, number in automaton.iter(lowered.decode("latin-1")))):
        found += [(m.start(), m.end(), rule) for m in pattern.finditer(lowered)]
    return suppressed(found)


@lru_cache(4096)
def _open(present: frozenset[int]) -> list[tuple[Rule, re.Pattern]]:
    """Rules and patterns whose keywords are all among the numbers of those present."""
    return [(rule, pattern) for rule, pattern, gates in _compiled()[0] if all(gate & present for gate in gates)]


def suppressed(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Without detections inside one of no lower priority (ties: the longer, then the first rule by name) or across a higher one.

    Higher priorities are placed first, in an order by start, so each detection meets only its neighbours there.
    """
    starts: list[int] = []
    kept: list[tuple[int, int, Rule]] = []
    for lo, hi, rule in sorted(found, key=lambda d: (-d[2].priority, d[0] - d[1], d[0], d[2].name)):
        at = bisect.bisect_right(starts, lo)
        if at and kept[at - 1][1] > lo or at < len(kept) and kept[at][0] < hi:
            continue  # it lies in or across one placed before
        starts.insert(at, lo)
        kept.insert(at, (lo, hi, rule))
    return kept


_BASE = [
    (re.compile(rb"(?<![^ ])" + phrase.replace(" ", " +").encode() + rb"(?![^ ])"), phrase.split(" ")[0].encode(), label)
    for phrase, label in PHRASES.items()
]


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: its words, the places of the base phrases and the detections of the rules.

    doc_id, n_words, base (array of word and label, by word), spans (array of start and end in bytes of the UTF-8
    text, label, rule, confidence, by start). Words are runs of ASCII letters and digits and other code points;
    null texts are empty; texts without detections have empty arrays; repeated rows are scanned each.
    """
    small_batches(docs.sparkSession)
    schema = "doc_id long, n_words long, base array<struct<word: long, label: string>>, spans array<struct<start: long, end: long, label: string, rule: string, confidence: double>>"
    base_type = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
    span_type = pa.list_(
        pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("rule", pa.string()), ("confidence", pa.float64())])
    )

    def run(batches):
        for ids, raw, offsets in text_blocks(batches):
            words = raw.translate(WORD_BYTES)
            lowered = raw.translate(LOWER_BYTES)
            starts, _, first = word_spans(np.frombuffer(words, np.uint8), offsets)
            bases, spans = [], []
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                text = words[a:b]
                found = [(a + m.start(), label) for p, head, label in _BASE if head in text for m in p.finditer(text)]
                at = np.searchsorted(starts, [x for x, _ in found]) - first[i]
                bases.append([{"word": int(w), "label": x[1]} for w, x in sorted(zip(at, found, strict=True))])
                spans.append(
                    [{"start": s, "end": e, "label": r.label, "rule": r.name, "confidence": r.confidence} for s, e, r in detections(lowered[a:b])]
                )
            yield pa.RecordBatch.from_arrays(
                [ids.cast(pa.int64()), pa.array(np.diff(first)), pa.array(bases, base_type), pa.array(spans, span_type)],
                ["doc_id", "n_words", "base", "spans"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
