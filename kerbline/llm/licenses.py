"""License scans: ordered signature rules with a keyword prefilter, priorities and suppression of contained spans.

A rule is a regular expression over the words of a text (lower-case, joined by single blanks), with a label, a priority,
a keyword that must stand in the text and names of which one must, before the expression is tried at all. Every match
holds the keyword and one of the names, so the gate refuses none. All detections are sorted by priority,
then length, then start; a detection whose span lies within an accepted one of the same or a higher priority is
suppressed. The rest gives labels and a score: the strongest rule's weight, lifted by further evidence.

Phrases are rules of the highest priority that are never suppressed; their places are counted.

Documents never move and are scanned whole. Defined results: null and empty texts have no words, no labels and score 0;
repeated rows are scanned alike; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm.common import batches, words

# Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Licence families: label, the names people write (expressions over words), texts of which every such name holds one.
FAMILIES = [
    ("agpl", r"(?:gnu )?affero general public licen[sc]e|agpl(?:v?3)?", ("affero", "agpl")),
    ("lgpl", r"(?:gnu )?(?:lesser|library) general public licen[sc]e|lgpl(?:v?[23])?", ("general public", "lgpl")),
    ("gpl", r"gnu general public licen[sc]e|gnu gpl|gpl(?:v?[23])?", ("general public", "gpl")),
    ("gfdl", r"gnu free documentation licen[sc]e|gfdl", ("free documentation", "gfdl")),
    ("apache", r"apache(?: software)? licen[sc]e|apache 2(?: 0)?|asl 2(?: 0)?", ("apache", "asl 2")),
    ("mit", r"(?:the )?mit licen[sc]e|expat licen[sc]e|mit x11 licen[sc]e", ("mit", "expat")),
    ("bsd-2-clause", r"(?:simplified|freebsd|2 clause|two clause) bsd licen[sc]e|bsd 2 clause", ("bsd",)),
    ("bsd-3-clause", r"(?:new|modified|revised|3 clause|three clause) bsd licen[sc]e|bsd 3 clause", ("bsd",)),
    ("bsd", r"bsd licen[sc]e|bsd style licen[sc]e", ("bsd",)),
    ("mpl", r"mozilla public licen[sc]e|mpl 2 0", ("mozilla public", "mpl 2")),
    ("epl", r"eclipse public licen[sc]e|epl 2 0", ("eclipse public", "epl 2")),
    ("cddl", r"common development and distribution licen[sc]e|cddl", ("common development", "cddl")),
    ("cpl", r"common public licen[sc]e", ("common public",)),
    ("eupl", r"european union public licen[sc]e|eupl", ("european union", "eupl")),
    ("isc", r"isc licen[sc]e", ("isc",)),
    ("zlib", r"zlib licen[sc]e|zlib libpng licen[sc]e", ("zlib",)),
    ("boost", r"boost software licen[sc]e|bsl 1 0", ("boost software", "bsl 1")),
    ("artistic", r"artistic licen[sc]e", ("artistic",)),
    ("python", r"python software foundation licen[sc]e|psf licen[sc]e", ("python software", "psf")),
    ("php", r"php licen[sc]e", ("php",)),
    ("postgresql", r"postgresql licen[sc]e", ("postgresql",)),
    ("openssl", r"openssl licen[sc]e", ("openssl",)),
    ("unlicense", r"the unlicense|unlicense", ("unlicense",)),
    ("wtfpl", r"wtfpl|do what the fuck you want to public licen[sc]e", ("wtfpl", "do what the")),
    ("ofl", r"sil open font licen[sc]e|open font licen[sc]e", ("font",)),
    ("odbl", r"open database licen[sc]e|odbl", ("open database", "odbl")),
    ("openrail", r"openrail m?|responsible ai licen[sc]e", ("openrail", "responsible ai")),
    ("cc0", r"cc0|cc zero|creative commons zero", ("cc0", "cc zero", "creative commons zero")),
    ("cc-by-nc-nd", r"cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s", ("cc by", "creative commons")),
    ("cc-by-nc-sa", r"cc by nc sa|creative commons attribution non ?commercial share ?alike", ("cc by", "creative commons")),
    ("cc-by-nd", r"cc by nd|creative commons attribution no ?deriv(?:ative)?s", ("cc by", "creative commons")),
    ("cc-by-nc", r"cc by nc|creative commons attribution non ?commercial", ("cc by", "creative commons")),
    ("cc-by-sa", r"cc by sa|creative commons attribution share ?alike", ("cc by", "creative commons")),
    ("cc-by", r"cc by|creative commons attribution", ("cc by", "creative commons")),
    ("public-domain", r"(?:released|placed|dedicated) (?:in|into|to) the public domain|public domain dedication", ("public domain",)),
    ("proprietary", r"all rights reserved|proprietary and confidential", ("rights reserved", "proprietary and")),
]
# Ways to state a licence around its name: expression, keyword (besides the name), priority, weight.
FRAMES = [
    (r"spdx licen[sc]e identifier {name}", "spdx", 1, 1.0),
    (r"(?:licen[sc]ed|released|distributed|published|available|provided) under (?:the )?(?:terms of )?(?:the )?(?:{name})", "under", 2, 0.95),
    (r"(?:{name}) (?:version|v) ?[0-9]+(?: [0-9]+)*", "", 3, 0.9),
    (r"see (?:the )?(?:{name})(?: for details| for more details)?", "see", 3, 0.8),
    (r"under (?:the )?(?:conditions of )?(?:the )?(?:{name})", "under", 4, 0.8),
    (r"(?:{name})", "", 5, 0.7),
]
# Hand-written signatures of licence texts and file headers: expression, label, keyword, priority, weight.
SIGNATURES = [
    (r"permission is hereby granted free of charge to any person obtaining a copy", "mit", "hereby granted", 1, 1.0),
    (r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense", "mit", "without restriction", 1, 1.0),
    (r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit", "permission notice", 1, 0.95),
    (r"in no event shall the authors or copyright holders be liable for any claim damages or other liability", "mit", "copyright holders", 2, 0.8),
    (r"permission to use copy modify and or distribute this software for any purpose", "isc", "distribute this software", 1, 1.0),
    (r"the software is provided as is and the author disclaims all warranties with regard to this software", "isc", "disclaims all warranties", 1, 0.95),
    (r"redistribution and use in source and binary forms with or without modification", "bsd", "redistribution", 1, 1.0),
    (r"redistributions of source code must retain the above copyright notice this list of conditions", "bsd", "redistributions of", 1, 0.95),
    (r"redistributions in binary form must reproduce the above copyright notice", "bsd", "redistributions in", 1, 0.95),
    (r"the views and conclusions contained in the software and documentation are those of the authors", "bsd-2-clause", "views and conclusions", 1, 0.9),
    (r"neither the name of .{1,80}? nor the names of its contributors", "bsd-3-clause", "neither the name", 1, 1.0),
    (r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", "bsd-4-clause", "advertising materials", 1, 1.0),
    (r"this program is free software you can redistribute it and or modify it", "gpl", "free software", 1, 1.0),
    (r"the gnu general public licen[sc]e is a free copyleft licen[sc]e for software and other kinds of works", "gpl", "copyleft", 1, 1.0),
    (r"you should have received a copy of the gnu general public licen[sc]e along with", "gpl", "should have received", 1, 1.0),
    (r"the licenses for most software are designed to take away your freedom to share and change it", "gpl", "freedom to share", 1, 1.0),
    (r"this program is distributed in the hope that it will be useful but without any warranty", "gpl", "in the hope that", 2, 0.8),
    (r"either version [0-9]+ of the licen[sc]e or at your option any later version", "gpl", "any later version", 2, 0.8),
    (r"this library is free software you can redistribute it and or modify it", "lgpl", "free software", 1, 1.0),
    (r"is called a work that uses the library", "lgpl", "uses the library", 1, 0.9),
    (r"you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e", "lgpl", "should have received", 1, 1.0),
    (r"you should have received a copy of the gnu affero general public licen[sc]e", "agpl", "should have received", 1, 1.0),
    (r"your modified version must prominently offer all users interacting with it remotely through a computer network", "agpl", "prominently offer", 1, 1.0),
    (r"the gnu affero general public licen[sc]e is a free copyleft licen[sc]e", "agpl", "copyleft", 1, 1.0),
    (r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e", "gfdl", "free documentation", 1, 1.0),
    (r"with no invariant sections no front cover texts and no back cover texts", "gfdl", "invariant sections", 1, 1.0),
    (r"you may not use this file except in compliance with the licen[sc]e", "apache", "in compliance with", 1, 1.0),
    (r"software distributed under the licen[sc]e is distributed on an as is basis without warranties or conditions of any kind", "apache", "as is basis", 1, 0.95),
    (r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright licen[sc]e", "apache", "royalty free", 1, 1.0),
    (r"this product includes software developed by the apache (?:software foundation|group)", "apache", "by the apache", 1, 0.95),
    (r"this source code form is subject to the terms of the mozilla public licen[sc]e", "mpl", "source code form", 1, 1.0),
    (r"if a copy of the mpl was not distributed with this file", "mpl", "of the mpl", 1, 1.0),
    (r"the contents of this file are subject to the mozilla public licen[sc]e", "mpl", "contents of this file", 1, 1.0),
    (r"this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e", "epl", "accompanying materials", 1, 1.0),
    (r"the accompanying program is provided under the terms of this eclipse public licen[sc]e", "epl", "accompanying program", 1, 1.0),
    (r"the contents of this file are subject to the terms of the common development and distribution licen[sc]e", "cddl", "contents of this file", 1, 1.0),
    (r"when distributing covered (?:code|software) include this cddl header notice in each file", "cddl", "covered", 1, 1.0),
    (r"this program and the accompanying materials are made available under the terms of the common public licen[sc]e", "cpl", "accompanying materials", 1, 1.0),
    (r"the accompanying program is provided under the terms of this common public licen[sc]e", "cpl", "accompanying program", 1, 1.0),
    (r"this european union public licen[sc]e the eupl applies to the work", "eupl", "the eupl applies", 1, 1.0),
    (r"the origin of this software must not be misrepresented", "zlib", "be misrepresented", 1, 1.0),
    (r"altered source versions must be plainly marked as such", "zlib", "plainly marked", 1, 1.0),
    (r"this notice may not be removed or altered from any source distribution", "zlib", "removed or altered", 1, 1.0),
    (r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", "boost", "hereby granted", 1, 1.0),
    (r"distributed under the boost software licen[sc]e", "boost", "boost software", 1, 1.0),
    (r"maintains some semblance of artistic control over the development of the package", "artistic", "artistic control", 1, 1.0),
    (r"this licen[sc]e establishes the terms under which a given free software package may be copied", "artistic", "free software", 1, 1.0),
    (r"this licen[sc]e agreement is between the python software foundation", "python", "python software", 1, 1.0),
    (r"psf is making python available to licensee on an as is basis", "python", "as is basis", 1, 1.0),
    (r"this product includes php software freely available from", "php", "php software", 1, 1.0),
    (r"products derived from this software may not be called php", "php", "be called php", 1, 1.0),
    (r"for any purpose without fee and without a written agreement is hereby granted", "postgresql", "hereby granted", 1, 1.0),
    (r"this product includes software developed by the openssl project", "openssl", "openssl project", 1, 1.0),
    (r"this product includes cryptographic software written by eric young", "openssl", "cryptographic software", 1, 1.0),
    (r"this is free and unencumbered software released into the public domain", "unlicense", "unencumbered", 1, 1.0),
    (r"anyone is free to copy modify publish use compile sell or distribute this software", "unlicense", "distribute this software", 1, 1.0),
    (r"dedicate any and all copyright interest in the software to the public domain", "unlicense", "copyright interest", 1, 1.0),
    (r"verbatim or modified copies of this licen[sc]e document and changing it is allowed as long as the name is changed", "wtfpl", "the name is changed", 1, 1.0),
    (r"you just do what the fuck you want to", "wtfpl", "do what the", 1, 1.0),
    (r"this font software is licensed under the sil open font licen[sc]e", "ofl", "font software", 1, 1.0),
    (r"neither the font software nor any of its individual components in original or modified versions may be sold by itself", "ofl", "font software", 1, 1.0),
    (r"is made available under the open database licen[sc]e", "odbl", "open database", 1, 1.0),
    (r"any rights in individual contents of the database are licensed under the database contents licen[sc]e", "odbl", "database contents", 1, 1.0),
    (r"the restrictions set forth in attachment a are considered use based restrictions", "openrail", "use based", 1, 1.0),
    (r"you agree not to use the model or derivatives of the model", "openrail", "derivatives of the model", 1, 1.0),
    (r"has waived all copyright and related or neighbou?ring rights", "cc0", "has waived all", 1, 1.0),
    (r"the person who associated a work with this deed has dedicated the work to the public domain", "cc0", "this deed", 1, 1.0),
    (r"affirmer hereby overtly fully permanently irrevocably and unconditionally waives", "cc0", "affirmer", 1, 1.0),
    (r"this creative commons attribution [0-9] [0-9] international public licen[sc]e", "cc-by", "creative commons", 1, 1.0),
    (r"this creative commons attribution share ?alike [0-9] [0-9] international public licen[sc]e", "cc-by-sa", "creative commons", 1, 1.0),
    (r"this creative commons attribution non ?commercial [0-9] [0-9] international public licen[sc]e", "cc-by-nc", "creative commons", 1, 1.0),
    (r"this creative commons attribution no ?derivatives [0-9] [0-9] international public licen[sc]e", "cc-by-nd", "creative commons", 1, 1.0),
    (r"you must distribute your contributions under the same licen[sc]e as the original", "cc-by-sa", "your contributions", 1, 0.95),
    (r"you may not use the material for commercial purposes", "cc-by-nc", "the material for", 1, 0.9),
    (r"if you remix transform or build upon the material you may not distribute the modified material", "cc-by-nd", "modified material", 1, 0.95),
    (r"you must give appropriate credit provide a link to the licen[sc]e and indicate if changes were made", "cc-by", "appropriate credit", 2, 0.9),
    (r"this (?:work|file|software|document) (?:is|has been placed) in the public domain", "public-domain", "public domain", 1, 0.95),
    (r"unauthori[sz]ed copying of this file via any medium is strictly prohibited", "proprietary", "strictly prohibited", 1, 1.0),
    (r"is the confidential and proprietary information of", "proprietary", "proprietary information", 1, 1.0),
    (r"no part of this (?:publication|document|book|work) may be reproduced", "proprietary", "may be reproduced", 1, 0.95),
    (r"may not be (?:copied|reproduced|distributed) without (?:the )?(?:prior )?written (?:permission|consent)", "proprietary", "may not be", 2, 0.9),
    (r"if we meet some day and you think this stuff is worth it you can buy me a beer in return", "beerware", "me a beer", 1, 1.0),
    (r"the software shall be used for good not evil", "json", "not evil", 1, 1.0),
    (r"permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee", "hpnd", "hereby granted", 1, 1.0),
    (r"without limiting other conditions in the licen[sc]e the grant of rights under the licen[sc]e will not include .{1,60}? the right to sell", "commons-clause", "grant of rights", 1, 1.0),
    (r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work", "busl", "licensed work", 1, 1.0),
    (r"https? (?:www )?gnu org licenses(?: (?:old )?licenses)? ([al]?gpl)", "gpl", "gnu org", 2, 0.9),
    (r"https? (?:www )?apache org licenses", "apache", "apache org", 2, 0.9),
    (r"https? (?:www )?opensource org licenses mit", "mit", "opensource org", 2, 0.9),
    (r"https? (?:www )?opensource org licenses bsd(?: [0-9] clause)?", "bsd", "opensource org", 2, 0.9),
    (r"https? (?:www )?mozilla org mpl", "mpl", "mozilla org", 2, 0.9),
    (r"https? (?:www )?eclipse org legal epl", "epl", "eclipse org", 2, 0.9),
    (r"https? (?:www )?boost org license", "boost", "boost org", 2, 0.9),
    (r"https? (?:www )?unlicense org", "unlicense", "unlicense org", 2, 0.9),
    (r"https? scripts sil org ofl", "ofl", "sil org", 2, 0.9),
    (r"https? (?:www )?opendatacommons org licenses odbl", "odbl", "opendatacommons org", 2, 0.9),
    (r"https? (?:www )?creativecommons org licenses by(?: [0-9] [0-9])?", "cc-by", "creativecommons org", 2, 0.9),
    (r"https? (?:www )?creativecommons org licenses by sa(?: [0-9] [0-9])?", "cc-by-sa", "creativecommons org", 2, 0.9),
    (r"https? (?:www )?creativecommons org licenses by nc(?: [0-9] [0-9])?", "cc-by-nc", "creativecommons org", 2, 0.9),
    (r"https? (?:www )?creativecommons org licenses by nd(?: [0-9] [0-9])?", "cc-by-nd", "creativecommons org", 2, 0.9),
    (r"https? (?:www )?creativecommons org licenses by nc sa(?: [0-9] [0-9])?", "cc-by-nc-sa", "creativecommons org", 2, 0.9),
    (r"https? (?:www )?creativecommons org licenses by nc nd(?: [0-9] [0-9])?", "cc-by-nc-nd", "creativecommons org", 2, 0.9),
    (r"https? (?:www )?creativecommons org publicdomain zero", "cc0", "creativecommons org", 2, 0.9),
]


@dataclass
class Rule:
    pattern: re.Pattern
    label: str
    keyword: str
    priority: int
    weight: float
    names: tuple[str, ...] = ("",)


def build_rules() -> list[Rule]:
    """All signatures, and every way to state a licence for every family: some three hundred rules in priority order."""
    rules = [Rule(re.compile(rf"(?<![^ ]){p}(?![^ ])"), label, key, priority, weight) for p, label, key, priority, weight in SIGNATURES]
    for label, name, names in FAMILIES:
        for frame, frame_key, priority, weight in FRAMES:
            pattern = frame.replace("{name}", f"(?:{name})" if "spdx" in frame else name)
            rules.append(Rule(re.compile(rf"(?<![^ ])(?:{pattern})(?![^ ])"), label, frame_key, priority, weight, names))
    return sorted(rules, key=lambda r: (r.priority, r.label, r.pattern.pattern))


# Keywords of the stated names; those of the signatures are added, but for keywords that hold another.
_OF_NAMES = ("licen", "gpl", "gfdl", "apache 2", "asl 2", "bsd 2", "bsd 3", "mpl 2", "epl 2", "cddl", "eupl", "bsl 1", "wtfpl", "odbl", "openrail", "cc0", "cc by",
             "cc zero", "creative commons", "public domain", "rights reserved", "proprietary and")


def gate(keys: list[str]) -> tuple[str, ...]:
    """The keywords that hold no other one: a text holds one of these if it holds any."""
    return tuple(k for k in dict.fromkeys(keys) if not any(other != k and other in k for other in keys))


# Without one of these no rule can match; most texts end here.
ANY_KEYWORD = gate([*_OF_NAMES, *(key for _, _, key, _, _ in SIGNATURES)])


def detections(joined: str, rules: list[Rule], gated: bool = True) -> list[tuple[int, int, Rule]]:
    """Accepted spans (characters of the joined words) with their rules; the gate only saves time."""
    if gated and not any(k in joined for k in ANY_KEYWORD):
        return []
    has: dict[str, bool] = {}

    def holds(key: str) -> bool:
        if key not in has:
            has[key] = key in joined
        return has[key]

    found = []
    for rule in rules:
        if not gated or holds(rule.keyword) and any(map(holds, rule.names)):
            found += [(m.start(), m.end(), rule) for m in rule.pattern.finditer(joined)]
    found.sort(key=lambda f: (f[2].priority, f[0] - f[1], f[0], f[2].label))
    accepted: list[tuple[int, int, Rule]] = []
    # Accepted spans that lie in no other one: starts and stops both rise, so the last that starts in time reaches furthest.
    starts: list[int] = []
    stops: list[int] = []
    for start, stop, rule in found:
        at = bisect_right(starts, start)
        if at and stops[at - 1] >= stop:
            continue
        accepted.append((start, stop, rule))
        low, high = bisect_left(starts, start), bisect_right(stops, stop)
        starts[low:max(low, high)] = [start]
        stops[low:max(low, high)] = [stop]
    return accepted


def phrase_places(found: list[bytes], phrases: list[tuple[list[bytes], str]]) -> list[tuple[int, int, str]]:
    """(start, words, label) of every place of every phrase."""
    out = []
    for phrase, label in phrases:
        at, first, n = -1, phrase[0], len(phrase)
        while True:
            try:
                at = found.index(first, at + 1)
            except ValueError:
                break
            if found[at:at + n] == phrase:
                out.append((at, n, label))
    return out


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, places (start, words, label of each base phrase), detections (start word, words, label, priority), score."""
    batches(docs.sparkSession)
    place = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64()), ("label", pa.string())]))
    hit = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64()), ("label", pa.string()), ("priority", pa.int32())]))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, phrases = build_rules(), [(words(p.encode()), label) for p, label in PHRASES.items()]
        for part in parts:
            rows = []
            for text in part.column(1).to_pylist():
                found = words(text)
                joined = b" ".join(found).decode()
                accepted = detections(joined, rules)
                n_before = [(joined.count(" ", 0, a), joined.count(" ", a, b) + 1, r) for a, b, r in accepted]
                places = phrase_places(found, phrases) if any(p.decode() in joined for p in (b"license", b"cc by")) else []
                weights = [r.weight for _, _, r in accepted] + [0.7] * bool(places)
                score = 1.0
                for w in sorted(weights, reverse=True)[:5]:
                    score *= 1 - 0.9 * w
                rows.append((len(found), [{"start": s, "words": n, "label": x} for s, n, x in places],
                             [{"start": s, "words": n, "label": r.label, "priority": r.priority} for s, n, r in n_before], 1 - score))
            if rows:
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), place, hit, pa.float64())))], names=["doc_id", "n_words", "places", "detections", "score"])

    kind = "struct<start: long, words: long, label: string"
    schema = f"doc_id long, n_words long, places array<{kind}>>, detections array<{kind}, priority: int>>, score double"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def report(scanned: DataFrame) -> DataFrame:
    """Counts and labels per document."""
    base, own = F.col("places.label"), F.col("detections.label")
    shown = lambda labels: F.concat_ws(",", F.array_sort(F.array_distinct(labels)))
    return scanned.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places.start").alias("first_word"), F.array_max("places.start").alias("last_word"),
        shown(base).alias("base_labels"), shown(F.concat(base, own)).alias("labels"), "score")
