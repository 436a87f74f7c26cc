"""License scans: ordered signature rules behind keyword gates, with overlap suppression.

A text becomes its words (A-Z in lower case, ASCII punctuation as breaks) with one space between.
Rules are regular expressions over that form.  They stand in order of priority: grants quoted from a
license, identifier tags, names with a version, names without one, general notices.  A rule runs only
where its keyword occurs, so most texts run none.  Every match is an interval of words; an interval
that lies within one of a rule of higher priority is dropped, so "gnu general public license version 3"
gives one label and not also the one of "general public license".

Sentences of license bodies and headers are written out by hand; names with their versions come from
families (names, versions, ways of writing).  Cost grows in proportion to a text and its places.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import map_batches, type_of

#: Base phrases and their labels.
BASE = {b"cc by": "cc-by", b"general public license": "gpl", b"all rights reserved": "reserved"}

#: bytes -> word bytes or a space
_WORD_MAP = bytes((c + 32 if 0x41 <= c <= 0x5A else c) if 0x30 <= c <= 0x39 or 0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A or c >= 0x80
                  else 0x20 for c in range(256))

GRANT, TAG, VERSIONED, NAMED, NOTICE = range(5)
STRENGTH = {GRANT: 1.0, TAG: 0.95, VERSIONED: 0.9, NAMED: 0.7, NOTICE: 0.4}
BASE_STRENGTH = 0.3

#: Sentences of license bodies and headers, as words: label, keyword, pattern.
GRANTS = (
    # MIT and its relatives
    ("mit", "hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "without restriction", r"to deal in the software without restriction including without limitation the rights to use copy modify"),
    ("mit", "substantial portions", r"the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions of the software"),
    ("mit-0", "persons to whom", r"sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided"),
    ("x11", "x consortium", r"except as contained in this notice the name of the x consortium shall not be used"),
    ("json", "good not evil", r"the software shall be used for good not evil"),
    ("isc", "permission to use", r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee"),
    ("0bsd", "with or without fee", r"with or without fee is hereby granted the software is provided as is and the author disclaims all warranties"),
    ("hpnd", "permission to use", r"permission to use copy modify (?:and )?distribute (?:and sell )?this software and its documentation for any purpose"),
    ("ntp", "representations about the suitability", r"makes no representations about the suitability (?:of )?this software for any purpose"),
    ("ncsa", "with the software", r"to deal with the software without restriction including without limitation the rights"),
    ("ncsa", "contributors may be used", r"neither the names of .{1,160}? nor the names of its contributors may be used to endorse"),
    ("curl", "with or without fee", r"for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("icu", "unicode", r"unicode inc license agreement data files and software"),
    ("postgresql", "without a written agreement", r"without fee and without a written agreement is hereby granted"),
    ("boost-1.0", "hereby granted", r"permission is hereby granted free of charge to any person or organization obtaining a copy"),
    ("boost-1.0", "boost software license", r"distributed under the boost software license version 1 0"),
    # BSD
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification"),
    ("bsd", "redistributions of source", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions in binary", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", "governed by a bsd", r"use of this source code is governed by a bsd style license"),
    ("bsd-3-clause", "endorse or promote", r"neither the names? of .{1,160}? may be used to endorse or promote products"),
    ("bsd-3-clause", "endorse or promote", r"the names? of .{1,80}? may not be used to endorse or promote products"),
    ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software must display"),
    ("bsd-3-clause-clear", "express or implied licenses", r"no express or implied licenses to any party s patent rights are granted by this license"),
    ("bsd-2-clause-patent", "those receiving rights", r"each copyright holder and contributor hereby grants to those receiving rights"),
    ("bsd-3-clause-no-nuclear", "nuclear", r"not designed licensed or intended for use in the design construction operation or maintenance of any nuclear facility"),
    # Apache
    ("apache-2.0", "compliance with the license", r"you may not use this (?:file|work) except in compliance with the license"),
    ("apache-2.0", "apache license", r"licensed under the apache license version 2 0"),
    ("apache-2.0", "express or implied", r"distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache-2.0", "apache org", r"apache org licenses license 2 0"),
    ("apache-2.0", "asf", r"licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-2.0", "perpetual worldwide", r"hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    ("apache-1.1", "apache software foundation", r"this product includes software developed by the apache software foundation"),
    # GNU
    ("gpl", "free software foundation", r"under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "general public license", r"you should have received a copy of the gnu general public license"),
    ("gpl-2", "general public license", r"gnu general public license version 2 june 1991"),
    ("gpl-3", "general public license", r"gnu general public license version 3 29 june 2007"),
    ("gpl", "everyone is permitted", r"everyone is permitted to copy and distribute verbatim copies of this license document"),
    ("gpl", "free software", r"this program is free software you can redistribute it and or modify it"),
    ("gpl", "implied warranty", r"without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("lgpl", "free software foundation", r"under the terms of the gnu (?:lesser|library) general public license as published by the free software foundation"),
    ("lgpl", "general public license", r"you should have received a copy of the gnu (?:lesser|library) general public license"),
    ("lgpl", "this library is free", r"this library is free software you can redistribute it and or modify it"),
    ("lgpl-2.1", "general public license", r"gnu lesser general public license version 2 1 february 1999"),
    ("agpl", "free software foundation", r"under the terms of the gnu affero general public license as published by the free software foundation"),
    ("agpl", "affero", r"you should have received a copy of the gnu affero general public license"),
    ("agpl-3", "affero", r"gnu affero general public license version 3 19 november 2007"),
    ("gfdl", "free documentation license", r"copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", "invariant sections", r"with no invariant sections no front cover texts and no back cover texts"),
    ("gpl-classpath", "statically or dynamically", r"linking this library statically or dynamically with other modules is making a combined work"),
    ("gpl-linking-exception", "special exception", r"as a special exception the copyright holders? (?:of this library )?gives? you permission to link"),
    ("gpl-bison", "special exception", r"as a special exception you may create a larger work that contains part or all of the bison parser skeleton"),
    ("gcc-exception", "runtime library exception", r"gcc runtime library exception version 3 1"),
    ("fsf-unlimited", "unlimited permission", r"the free software foundation gives unlimited permission to copy and or distribute it"),
    ("fsf-notices", "medium without royalty", r"copying and distribution of this file with or without modification are permitted in any medium without royalty"),
    # weak copyleft of foundations and companies
    ("mpl", "mozilla public", r"subject to the terms of the mozilla public license"),
    ("mpl-1.1", "mozilla public", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-2.0", "mozilla org", r"mozilla org mpl 2 0"),
    ("mpl-2.0-incompatible", "secondary licenses", r"this source code form is incompatible with secondary licenses"),
    ("npl", "netscape public", r"the contents of this file are subject to the netscape public license"),
    ("epl", "eclipse public", r"made available under the terms of the eclipse public license"),
    ("epl", "eclipse org", r"eclipse org legal epl (?:v10|2 0)"),
    ("cpl-1.0", "common public license", r"made available under the terms of the common public license v1 0"),
    ("ipl-1.0", "ibm public license", r"provided under the terms of this ibm public license"),
    ("cddl", "common development", r"subject to the terms of the common development and distribution license"),
    ("eupl", "eupl", r"licensed under the eupl"),
    ("eupl", "european union", r"european union public licen[cs]e"),
    ("osl", "open software license", r"licensed under the open software license version \d"),
    ("afl", "academic free license", r"licensed under the academic free license version \d"),
    ("artistic", "artistic license", r"under the terms of (?:either )?the artistic license"),
    ("artistic-1.0", "terms as perl", r"under the same terms as perl(?: \d)?(?: itself)?"),
    ("ms-pl", "accompanying software", r"this license governs use of the accompanying software if you use the software you accept this license"),
    ("ms-lpl", "windows operating system", r"runs on (?:the )?microsoft windows operating system product"),
    ("apsl", "apple public source", r"subject to the apple public source license"),
    ("qpl-1.0", "q public license", r"distributed under the terms of the q public license"),
    ("sissl", "sun industry standards", r"subject to the sun industry standards source license"),
    ("spl-1.0", "sun public license", r"subject to the sun public license version 1 0"),
    ("lppl", "latex project", r"under the conditions of the latex project public license"),
    ("cecill", "cecill", r"this software is governed by the cecill(?: [bc])? license under french law"),
    ("ecl-2.0", "educational community", r"licensed under the educational community license version 2 0"),
    ("upl-1.0", "universal permissive", r"the universal permissive license upl version 1 0"),
    ("sleepycat", "complete source code", r"redistributions in any form must be accompanied by information on how to obtain complete source code"),
    ("openssl", "openssl toolkit", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", "eric young", r"this product includes cryptographic software written by eric young"),
    ("php", "php software", r"this product includes php software freely available from"),
    ("python", "psf hereby grants", r"psf hereby grants licensee a nonexclusive royalty free world wide license"),
    ("python", "python software foundation", r"python software foundation license version \d"),
    ("ruby", "clause bsdl", r"you can redistribute it and or modify it under either the terms of the 2 clause bsdl"),
    ("ruby", "terms as ruby", r"under the same terms as ruby"),
    ("vim", "vim", r"i place no restrictions on distributing unmodified copies of vim"),
    ("zpl", "zope public license", r"subject to the provisions of the zope public license"),
    ("w3c", "copying this work", r"this work is being provided by the copyright holders under the following license by obtaining using and or copying this work"),
    ("zlib", "express or implied", r"this software is provided as is without any express or implied warranty in no event will the authors"),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("libpng", "png reference library", r"the png reference library is supplied as is"),
    ("ijg", "independent jpeg group", r"this software is based in part on the work of the independent jpeg group"),
    ("freetype", "freetype", r"portions of this software are copyright .{1,40}? the freetype project"),
    ("bzip2", "altered source versions", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("ofl-1.1", "sil open font", r"this font software is licensed under the sil open font license"),
    ("ofl-1.1", "the fonts and derivatives", r"the fonts and derivatives however cannot be released under any other type of license"),
    ("bitstream-vera", "bitstream vera", r"bitstream vera is a trademark of bitstream inc"),
    ("ubuntu-font", "ubuntu font licence", r"ubuntu font licence version 1 0"),
    # public domain and dedications
    ("unlicense", "public domain", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free", r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("cc0", "neighboring rights", r"has waived all copyright and related or neighboring rights to"),
    ("cc0", "public domain dedication", r"cc0 (?:1 0 )?(?:universal )?public domain dedication"),
    ("pddl", "public domain dedication", r"made available under the public domain dedication and license"),
    ("public-domain", "public domain", r"(?:has been |is |was )?(?:hereby )?(?:placed|released|dedicated) (?:in|into|to) the public domain"),
    ("public-domain", "disclaims copyright", r"the author disclaims copyright to this source code in place of a legal notice here is a blessing"),
    ("wtfpl", "do what the", r"you just do what the fuck you want to"),
    ("beerware", "buy me a beer", r"if we meet some day and you think this stuff is worth it you can buy me a beer"),
    # content and data
    ("cc-by", "creative commons", r"this work is licensed under a creative commons attribution (?:\d \d )?international license"),
    ("cc-by-sa", "creative commons", r"this work is licensed under a creative commons attribution share ?alike"),
    ("cc", "creativecommons org", r"to view a copy of this license visit (?:https? )?(?:www )?creativecommons org"),
    ("cc", "send a letter", r"send a letter to creative commons"),
    ("odbl", "open database license", r"made available under the open database license"),
    ("odc-by", "open data commons", r"made available under the open data commons attribution license"),
    ("ogl-uk", "open government licence", r"contains public sector information licensed under the open government licence"),
    ("wikipedia", "text is available under", r"text is available under the creative commons attribution share ?alike license"),
    # source available and proprietary
    ("sspl-1.0", "server side public", r"under the terms of the server side public license"),
    ("elastic-2.0", "elastic license", r"you may not use this file except in compliance with (?:either )?the elastic license"),
    ("busl", "business source license", r"licensed under the business source license|use of this software is governed by the business source license"),
    ("commons-clause", "right to sell", r"the license does not grant to you the right to sell the software"),
    ("polyform", "polyform", r"polyform (?:noncommercial|small business|shield|strict|perimeter) license"),
    ("prosperity", "prosperity public", r"the prosperity public license"),
    ("eula", "legal agreement", r"this end user licen[cs]e agreement (?:eula )?is a legal agreement between you"),
    ("eula", "by installing", r"by installing copying or otherwise using (?:the|this) software (?:product )?you agree to be bound by the terms"),
    ("nvidia", "nvidia", r"nvidia corporation and its licensors retain all intellectual property and proprietary rights"),
    ("oracle", "oracle", r"oracle proprietary confidential use is subject to license terms"),
    ("proprietary", "trade secret", r"(?:contains|constitutes?) (?:valuable )?trade secrets? (?:of|and confidential)"),
    ("proprietary", "confidential", r"(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", "unauthorized", r"unauthorized (?:copying|use|reproduction|distribution) (?:of this \w+ )?(?:\w+ ){0,6}(?:is )?(?:strictly )?prohibited"),
    ("proprietary", "may not be", r"may not be (?:reproduced|copied|used|distributed)(?: \w+){0,8} without (?:the )?(?:prior |express )*written (?:consent|permission)"),
    ("non-commercial", "non commercial", r"free for (?:personal and )?non commercial use"),
    ("non-commercial", "research purposes", r"for (?:academic|non commercial) research purposes only"),
)

#: Families: label, names as words, versions, and whether the name alone (without "license") counts.
FAMILIES = (
    ("agpl", ("gnu affero general public license", "affero general public license", "gnu agpl", "agpl"), ("1", "3"), True),
    ("lgpl", ("gnu lesser general public license", "gnu library general public license", "lesser general public license",
              "gnu lgpl", "lgpl"), ("2", "2.1", "3"), True),
    ("gfdl", ("gnu free documentation license", "gfdl"), ("1.1", "1.2", "1.3"), True),
    ("gpl", ("gnu general public license", "general public license", "gnu public license", "gnu gpl", "gpl"), ("1", "2", "3"), True),
    ("apache", ("apache software license", "apache license", "apache"), ("1.0", "1.1", "2.0"), False),
    ("mpl", ("mozilla public license", "mpl"), ("1.0", "1.1", "2.0"), False),
    ("epl", ("eclipse public license", "epl"), ("1.0", "2.0"), False),
    ("eupl", ("european union public licence", "european union public license", "eupl"), ("1.0", "1.1", "1.2"), True),
    ("cddl", ("common development and distribution license", "cddl"), ("1.0", "1.1"), True),
    ("cpl", ("common public license",), ("0.5", "1.0"), True),
    ("osl", ("open software license",), ("1.0", "1.1", "2.0", "2.1", "3.0"), True),
    ("afl", ("academic free license",), ("1.1", "1.2", "2.0", "2.1", "3.0"), True),
    ("artistic", ("artistic license", "artistic"), ("1.0", "2.0"), False),
    ("boost", ("boost software license", "bsl"), ("1.0",), False),
    ("ofl", ("sil open font license", "open font license"), ("1.0", "1.1"), True),
    ("odbl", ("open database license", "odbl"), ("1.0",), True),
    ("ms-pl", ("microsoft public license", "ms pl"), (), True),
    ("ms-rl", ("microsoft reciprocal license", "ms rl"), (), True),
    ("python", ("python software foundation license", "psf license"), ("2",), True),
    ("php", ("php license",), ("3.0", "3.01"), True),
    ("ruby", ("ruby license",), (), True),
    ("zlib", ("zlib license", "zlib libpng license"), (), True),
    ("isc", ("isc license",), (), True),
    ("mit", ("mit license", "mit licence", "expat license", "licensed under the mit", "x11 license"), (), True),
    ("unlicense", ("the unlicense", "unlicense"), (), True),
    ("wtfpl", ("do what the fuck you want to public license", "wtfpl"), ("2",), True),
    ("sspl", ("server side public license", "sspl"), ("1",), True),
    ("elastic", ("elastic license",), ("1.0", "2.0"), True),
    ("busl", ("business source license",), ("1.0", "1.1"), True),
    ("commons-clause", ("commons clause",), ("1.0",), True),
    ("json", ("json license",), (), True),
    ("ecl", ("educational community license",), ("1.0", "2.0"), True),
    ("cecill", ("cecill license", "cecill"), ("1", "2", "2.1"), True),
    ("ncsa", ("university of illinois ncsa open source license", "ncsa license"), (), True),
    ("postgresql", ("postgresql license",), (), True),
    ("vim", ("vim license",), (), True),
    ("openssl", ("openssl license",), (), True),
    ("w3c", ("w3c software notice and license", "w3c license"), (), True),
)
CC_PARTS = ("by-nc-nd", "by-nc-sa", "by-nc", "by-nd", "by-sa", "by")
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
CC_LONG = {"by": "attribution", "nc": "non ?commercial", "nd": "no ?deriv(?:atives|s)?", "sa": "share ?alike"}
BSD_CLAUSES = {"2": ("two", "simplified", "freebsd"), "3": ("three", "new", "modified", "revised"), "4": ("four", "original", "old")}
TAGS = ("mit", "isc", "zlib", "unlicense", "0bsd", "bsd-2-clause", "bsd-3-clause", "bsd-4-clause", "bsl-1.0", "cc0-1.0", "wtfpl",
        "gpl-1.0", "gpl-2.0", "gpl-3.0", "lgpl-2.0", "lgpl-2.1", "lgpl-3.0", "agpl-3.0", "apache-1.1", "apache-2.0", "mpl-1.1",
        "mpl-2.0", "epl-1.0", "epl-2.0", "eupl-1.1", "eupl-1.2", "cddl-1.0", "cddl-1.1", "artistic-1.0", "artistic-2.0", "ofl-1.1",
        "odbl-1.0", "ms-pl", "ms-rl", "osl-3.0", "afl-3.0", "ncsa", "postgresql", "python-2.0", "php-3.01", "ruby", "vim", "w3c",
        "openssl", "sspl-1.0", "busl-1.1", "elastic-2.0", "ecl-2.0", "cecill-2.1", "gfdl-1.3")
NOTICES = (
    ("reserved", "rights reserved", r"(?:all|some|no) rights reserved"),
    ("copyright", "copyright", r"copyright (?:c )?(?:19|20)\d\d(?: (?:19|20)\d\d)?"),
    ("copyright", "copyright", r"copyright (?:c |by |holders? )\w+"),
    ("public-domain", "public domain", r"(?:in|into|to) the public domain"),
    ("license-notice", "license", r"licensed? (?:under|by|to you under) (?:the |a )?(?:terms of )?(?:the )?[a-z]\S* licen[sc]e"),
    ("license-notice", "licence", r"licen[sc]ed? under (?:the |a )?[a-z]\S* licence"),
    ("no-commercial-use", "commercial use", r"(?:not for|no|non) commercial use"),
    ("permission", "permission", r"(?:with|without)(?: the)?(?: prior| written| express)* permission"),
)


@dataclass(frozen=True)
class Rule:
    """``priority``: lower goes first; ``gate`` must occur in the text for ``pattern`` to be tried."""

    priority: int
    tier: int
    label: str
    gate: bytes
    pattern: re.Pattern


def _version(v: str) -> str:
    """Version as words: 3 and 3.0 are one, 2.1 is two words."""
    major, _, minor = v.partition(".")
    return f"v?(?:ersion )?{major}" + (f" {minor}" if minor.strip("0") else "(?: 0)?(?! \\d)")


@cache
def rules() -> tuple[Rule, ...]:
    """Every rule in order of priority."""
    found: list[tuple[int, str, str, str]] = [(GRANT, *g) for g in GRANTS]
    for t in TAGS:
        words = re.escape(t.replace("-", " ").replace(".", " ")).replace("\\ ", " ")
        found.append((TAG, t, "license identifier", rf"spdx license identifier {words}(?: (?:only|or later))?"))
    link = r"(?: license| licence)?(?: as published by the free software foundation)?(?: either)?"
    for label, names, versions, alone in FAMILIES:
        for name in names:
            for v in versions:
                later = r"(?: or (?:at your option )?(?:any )?(?:later|newer)(?: version)?| only)?"
                found.append((VERSIONED, f"{label}-{v}", name, rf"(?:the )?{name}{link} {_version(v)}{later}"))
            if alone or name.endswith(("license", "licence")):
                found.append((NAMED, label, name, rf"(?:the )?{name}"))
            else:
                found.append((NAMED, label, name, rf"(?:under|the) {name}(?: public)? licen[sc]e"))
    for parts in CC_PARTS:
        short, long_ = parts.replace("-", " "), " ".join(CC_LONG[p] for p in parts.split("-"))
        for v in CC_VERSIONS:
            number = v.replace(".", " ")
            found.append((VERSIONED, f"cc-{parts}-{v}", "cc by", rf"cc {short} {number}"))
            found.append((VERSIONED, f"cc-{parts}-{v}", "creative commons", rf"creative commons {long_} {number}"))
            found.append((VERSIONED, f"cc-{parts}-{v}", "creativecommons org", rf"creativecommons org licenses {short} {number}"))
        found.append((NAMED, f"cc-{parts}", "cc by", rf"cc {short}"))
        found.append((NAMED, f"cc-{parts}", "creative commons", rf"creative commons {long_}"))
    found += [(VERSIONED, "cc0-1.0", "cc0", r"cc0 (?:1 0|universal)"), (NAMED, "cc0", "cc0", "cc0"),
              (NAMED, "cc0", "creative commons", "creative commons zero"), (NAMED, "cc", "creative commons", "creative commons licen[sc]e")]
    for n, names in BSD_CLAUSES.items():
        found.append((VERSIONED, f"bsd-{n}-clause", "clause", rf"(?:bsd (?:{n}|{names[0]}) clause|(?:{n}|{names[0]}) clause bsd)(?: licen[sc]e)?"))
        found += [(VERSIONED, f"bsd-{n}-clause", "bsd", rf"{w} bsd(?: licen[sc]e)") for w in names[1:]]
    found.append((NAMED, "bsd", "bsd", r"(?:bsd licen[sc]e|bsd style|licensed under (?:the )?bsd)"))
    found += [(NOTICE, *n) for n in NOTICES]
    found.sort(key=lambda r: r[0])  # stable: within a tier in the order above
    return tuple(Rule(i, tier, label, gate.encode(), re.compile(rb"(?<= )" + f"(?:{pattern})".encode() + rb"(?= )"))
                 for i, (tier, label, gate, pattern) in enumerate(found))


@cache
def _by_gate() -> dict[bytes, list[Rule]]:
    out: dict[bytes, list[Rule]] = {}
    for r in rules():
        out.setdefault(r.gate, []).append(r)
    return out


def word_form(text: str | None) -> tuple[bytes, int]:
    """(the words with one space before, between and after, their number)."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_WORD_MAP).split()
    return b" " + b" ".join(words) + b" " if words else b" ", len(words)


def base_places(form: bytes) -> list[tuple[str, int]]:
    """(label, first word) of every place where a base phrase stands."""
    out = []
    for phrase, label in BASE.items():
        needle = b" " + phrase + b" "
        at, seen, word = form.find(needle), 0, 0
        while at >= 0:
            word += form.count(b" ", seen, at)  # from the last place on
            out.append((label, word))
            seen, at = at, form.find(needle, at + 1)
    return sorted(out, key=lambda x: (x[1], x[0]))


def detections(form: bytes) -> list[tuple[Rule, int, int]]:
    """(rule, first word, end word) that no interval of a higher priority contains, by first word.

    Rules go in order of priority.  ``reach[w]`` is the furthest end of the intervals so far that begin at
    word w or before it; an interval lies in one of them if its end is within the reach of its first word.
    The matches of one rule never contain each other.
    """
    found = sorted(((r, [m.span() for m in r.pattern.finditer(form)]) for gate, gated in _by_gate().items() if gate in form for r in gated),
                   key=lambda f: f[0].priority)
    found = [(r, spans) for r, spans in found if spans]
    if not found:
        return []
    blanks = np.flatnonzero(np.frombuffer(form, np.uint8) == 32)
    reach, out = np.zeros(len(blanks), np.int64), []
    for n, (r, spans) in enumerate(found):
        at = np.array(spans, np.int64)
        first, end = np.searchsorted(blanks, at[:, 0]) - 1, np.searchsorted(blanks, at[:, 1])
        kept = end > reach[first]
        first, end = first[kept], end[kept]
        out += [(r, a, z) for a, z in zip(first.tolist(), end.tolist())]
        if len(first) and n + 1 < len(found):
            np.maximum.at(reach, first, end)
            np.maximum.accumulate(reach, out=reach)
    return sorted(out, key=lambda d: (d[1], d[0].priority))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, base, found, score): one row per input row.

    ``base``: array<struct<label, word>>, all places of the base phrases; ``found``: array<struct<label,
    start, end, priority>> in words; ``score``: strength of the strongest detection.  Null and empty
    texts have no words and score 0; repeated rows keep a row each; an empty table gives none.
    """
    base_type = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
    found_type = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("priority", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                counts, base, found, score = [], [], [], []
                for t in part.column(1):
                    form, n = word_form(t.as_py())
                    places, hits = base_places(form), detections(form)
                    counts.append(n)
                    base.append([{"label": l, "word": w} for l, w in places])
                    found.append([{"label": r.label, "start": a, "end": z, "priority": r.priority} for r, a, z in hits])
                    score.append(max([STRENGTH[r.tier] for r, _, _ in hits] + [BASE_STRENGTH] * bool(places), default=0.0))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts, pa.int64()), pa.array(base, base_type), pa.array(found, found_type),
                     pa.array(score, pa.float64())], names=["id", "n_words", "base", "found", "score"])
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = (f"id {type_of(docs, id_col)}, n_words bigint, base array<struct<label:string,word:bigint>>, "
              "found array<struct<label:string,start:bigint,end:bigint,priority:int>>, score double")
    return map_batches(rows, run, schema).withColumnRenamed("id", id_col)
