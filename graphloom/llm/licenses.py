"""Licence scans by sentence rules.

Texts are cut into sentences, normalised and mapped to identifiers of known
licence sentences; the sequence of identifiers is then matched against licence
rules in their order, each match taking its identifiers from the sequence.

One map over the texts, no shuffle; texts without any of a few marker words are
passed by after one search; every pattern needs one of them.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .workspace import small_batches

ROWS_AT_ONCE = 512

_MARKER = re.compile(r"licen[cs]|copyright|©|\(c\)|spdx|gpl|permission\W+is|redistribution|warrant|public\W+domain|unlicen|all\W+rights|\bcc\W+by|\bcc0|\bbsd\b|endorse", re.I)
_PARAGRAPH = re.compile(r"\n[^\S\n]*\n")
_BREAK = re.compile(r"\n+|(?<=[.;!?])\s+(?=[A-Z\"'(]|$)")
_NOISE = re.compile(r"[^\w.+/-]+")

#: Patterns of normalised sentences, with the identifier of each. The first that fits is taken.
SENTENCES: list[tuple[str, str]] = [
    ("spdx", r".*\bspdx-license-identifier (?P<id>[\w.+-]+( (and|or|with) [\w.+-]+)*)"),
    ("gpl3", r".*\bgnu general public licen[cs]e,? (version|v) ?3(\.0)?( only| or later)?"),
    ("gpl2", r".*\bgnu general public licen[cs]e,? (version|v) ?2(\.0)?( only| or later)?"),
    ("lgpl3", r".*\bgnu lesser general public licen[cs]e,? (version|v) ?3(\.0)?( only| or later)?"),
    ("agpl3", r".*\bgnu affero general public licen[cs]e,? (version|v) ?3(\.0)?( only| or later)?"),
    ("gplLater", r"(either )?version (?P<id>[23])(\.0)? of the licen[cs]e or at your option any later version"),
    ("gplFree", r"this (program|library|file|software) is free software you can redistribute it and/or modify it under the terms of the gnu general public licen[cs]e as published by the free software foundation.*"),
    ("mit", r".*\b(the )?mit licen[cs]e"),
    ("mitGrant", r"permission is hereby granted free of charge to any person obtaining a copy of this software.*"),
    ("mitNotice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions.*"),
    ("asIs", r"the software is provided as is without warranty of any kind.*"),
    ("apache2", r".*\bapache licen[cs]e,?( version)? 2(\.0)?"),
    ("apacheExcept", r"you may not use this file except in compliance with the licen[cs]e"),
    ("apacheCopy", r"you may obtain a copy of the licen[cs]e at.*"),
    ("ccByNcSa", r".*\bcc by-nc-sa (?P<id>\d\.\d)"),
    ("ccByNcNd", r".*\bcc by-nc-nd (?P<id>\d\.\d)"),
    ("ccByNc", r".*\bcc by-nc (?P<id>\d\.\d)"),
    ("ccBySa", r".*\bcc by-sa (?P<id>\d\.\d)"),
    ("ccByNd", r".*\bcc by-nd (?P<id>\d\.\d)"),
    ("ccBy", r".*\bcc by (?P<id>\d\.\d)"),
    ("cc0", r".*\bcc0( 1\.0)?( universal)?"),
    ("bsdGrant", r"redistribution and use in source and binary forms with or without modification are permitted.*"),
    ("bsdSource", r"(1\.? )?redistributions of source code must retain the above copyright notice.*"),
    ("bsdBinary", r"(2\.? )?redistributions in binary form must reproduce the above copyright notice.*"),
    ("bsdName", r"(3\.? )?neither the name of .* may be used to endorse or promote products.*"),
    ("bsd3", r".*\bbsd 3-clause( licen[cs]e)?"),
    ("bsd2", r".*\bbsd 2-clause( licen[cs]e)?"),
    ("mpl2", r".*\bmozilla public licen[cs]e,?( version| v\.?)? 2(\.0)?"),
    ("isc", r".*\bisc licen[cs]e"),
    ("unlicense", r".*\bunlicense|this is free and unencumbered software released into the public domain"),
    ("publicDomain", r".*\b(dedicated to|released into|in) the public domain"),
    ("gnuShort", r".*\b(?P<id>[al]?gpl[ -]?v?[123](\.\d)?)(\+| or later| only)?"),
    ("copyright", r"(copyright|\(c\)|©).*"),
    ("allRights", r".*\ball rights reserved"),
    ("unknown", r".*\b(licen[cs]ed|released|distributed|published|available|provided|made available) under (the |an? )?[\w.+-]+( [\w.+-]+){0,6} licen[cs]e"),
]

#: Licence rules in order; a rule's identifiers must follow each other, others left out. "{id}" is the number or name that a sentence gives.
RULES: list[tuple[str, list[str]]] = [
    ("{id}", ["spdx"]),
    ("BSD-3-Clause", ["bsdGrant", "bsdSource", "bsdBinary", "bsdName"]),
    ("BSD-2-Clause", ["bsdGrant", "bsdSource", "bsdBinary"]),
    ("MIT", ["mitGrant", "mitNotice", "asIs"]),
    ("MIT", ["mitGrant", "mitNotice"]),
    ("Apache-2.0", ["apache2", "apacheExcept", "apacheCopy"]),
    ("Apache-2.0", ["apache2", "apacheExcept"]),
    ("GPL-{id}.0-or-later", ["gplFree", "gplLater"]),
    ("AGPL-3.0", ["agpl3"]),
    ("LGPL-3.0", ["lgpl3"]),
    ("GPL-3.0", ["gpl3"]),
    ("GPL-2.0", ["gpl2"]),
    ("MIT", ["mit"]),
    ("Apache-2.0", ["apache2"]),
    ("CC-BY-NC-SA-{id}", ["ccByNcSa"]),
    ("CC-BY-NC-ND-{id}", ["ccByNcNd"]),
    ("CC-BY-NC-{id}", ["ccByNc"]),
    ("CC-BY-SA-{id}", ["ccBySa"]),
    ("CC-BY-ND-{id}", ["ccByNd"]),
    ("CC-BY-{id}", ["ccBy"]),
    ("CC0-1.0", ["cc0"]),
    ("BSD-3-Clause", ["bsd3"]),
    ("BSD-2-Clause", ["bsd2"]),
    ("MPL-2.0", ["mpl2"]),
    ("ISC", ["isc"]),
    ("Unlicense", ["unlicense"]),
    ("public-domain", ["publicDomain"]),
    ("all-rights-reserved", ["copyright", "allRights"]),
    ("{id}", ["gnuShort"]),
    ("all-rights-reserved", ["allRights"]),
    ("unknown", ["unknown"]),
]

#: Names of further licences, as identifiers spell them.
NAMES = "0BSD AFL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Artistic-2.0 BSL-1.0 CDDL-1.0 CPL-1.0 EPL-1.0 EPL-2.0 EUPL-1.2 GPL-1.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.0 LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT-0 MPL-1.1 MS-PL NCSA OFL-1.1 PostgreSQL Python-2.0 Vim W3C WTFPL Zlib ZPL-2.1".split()
_SPELLED = {name.lower(): name for name in (*(x for x, _ in RULES if "{" not in x), *NAMES)}
_GNU = re.compile(r"([al]?gpl)[ -]?v?(\d)(\.\d)?")

#: Each pattern with whether it may start within a sentence; what stands before and after the known words is free.
_KNOWN = []
for _name, _pattern in SENTENCES:
    _free = _pattern.startswith(".*")
    _core = _pattern.removeprefix(".*")
    _end = "" if _core.endswith(".*") else r"(?!\w|\.\d)"
    _KNOWN.append((_name, re.compile(f"(?:{_core.removesuffix('.*')}){_end}"), _free))


def normalise(sentence: str) -> str:
    """Lower case, one space between words, without outer punctuation and comment marks."""
    return _NOISE.sub(" ", sentence.lower()).strip(" .-/+")


def recognise(text: str | None) -> list[tuple[str, str]]:
    """(identifier, what the sentence gives for "{id}") of the known sentences, in order.

    Lines of a paragraph are read on, as licence texts are wrapped; a sentence
    starts at a line or after the end of one.
    """
    found = []
    if not text or not _MARKER.search(text):
        return found
    for paragraph in _PARAGRAPH.split(text):
        if not _MARKER.search(paragraph):
            continue
        heads, parts, at = [], [], 0
        for piece in map(normalise, _BREAK.split(paragraph)):
            if piece:
                heads.append(at)
                parts.append(piece)
                at += len(piece) + 1
        words = " ".join(parts)
        hits = []
        for rank, (name, pattern, free) in enumerate(_KNOWN):
            spots = pattern.finditer(words)
            if not free:  # also the later-version clause goes on within the sentence of the grant
                starts = set(heads)
                spots = (m for m in spots if m.start() in starts or name == "gplLater")
            hits.extend((m.start(), rank, m.end(), name, (m.groupdict().get("id") or "").rstrip(".")) for m in spots)
        done, taken, rest = 0, [], []
        for start, _, end, name, given in sorted(hits):
            if name == "unknown":  # only where no known sentence is
                rest.append((start, end))
            elif start >= done:
                taken.append((start, end, name, given))
                done = end
        taken += [(i, j, "unknown", "") for i, j in rest if all(j <= start or end <= i for start, end, *_ in taken)]
        found.extend((name, given) for _, _, name, given in sorted(taken))
    return found


def _names(sentence: str, licence: str, given: str) -> list[str]:
    """Licences that a rule gives: those of an expression one by one, with their exceptions."""
    if sentence == "spdx":
        return [" WITH ".join(_SPELLED.get(x, x) for x in part.split(" with ")) for part in re.split(" (?:and|or) ", given)]
    if sentence == "gnuShort":
        name, number, minor = _GNU.match(given).groups()
        return [f"{name.upper()}-{number}{minor or '.0'}"]
    return [licence.replace("{id}", given)]


def apply_rules(found: list[tuple[str, str]]) -> list[str]:
    """Licences of a sequence of identifiers, in the order of their first sentence."""
    left = list(enumerate(found))
    out: list[tuple[int, str]] = []
    for licence, names in RULES:
        i = 0
        while i + len(names) <= len(left):
            part = left[i : i + len(names)]
            if [x[1][0] for x in part] == names:
                given = next((x[1][1] for x in part if x[1][1]), "")
                out.extend((part[0][0], name) for name in _names(names[0], licence, given))
                del left[i : i + len(names)]
            else:
                i += 1
    return list(dict.fromkeys(name for _, name in sorted(out, key=lambda x: x[0])))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, sentences (identifiers in order) and licences of every document with a known sentence.

    Null and empty texts have none and give no row; identifiers that no rule
    takes leave licences empty; repeated rows are returned as often as they come.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                rows = batch.slice(at, ROWS_AT_ONCE)
                found = [recognise(t) for t in rows.column(1).to_pylist()]
                some = pa.array([bool(x) for x in found])
                found = [x for x in found if x]
                names = pa.array([[n for n, _ in x] for x in found], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([rows.column(0).filter(some), names, pa.array([apply_rules(x) for x in found], pa.list_(pa.string()))], names=["doc_id", "sentences", "licences"])

    return docs.select("doc_id", text).transform(small_batches).mapInArrow(run, f"doc_id {kind}, sentences array<string>, licences array<string>")
