"""Signature rules of the license scan, written on the words of a text: lower case, one blank between words, no other signs.

A rule has a keyword, a whole word that each of its matches holds. `{v}` is a version such as `2 0`, which the label takes over.
Each license of the tables below makes three rules (identifier, notice, name); the texts and addresses are rules of their own.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Ranks of the kinds of rule, by which contained detections are told, and how sure each is of its label.
IDENTIFIER, TEXT, NOTICE, NAME, HINT = 5, 4, 3, 2, 1
SURE = {IDENTIFIER: 1.0, TEXT: 0.95, NOTICE: 0.95, NAME: 0.8, HINT: 0.4}
VERSION = r"(?P<v>[0-9](?: [0-9])?)"
#: Words that lead from a work to its license.
LEAD = r"(?:licen[cs]ed|sublicensed|released|distributed|redistributed|published|provided|available|offered|covered|governed|shared|dual licensed) (?:to you )?(?:under|by|with|according to|subject to)(?: and subject to)?(?: the)?(?: terms(?: and conditions)? of)?(?: the| an?)?"


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    rank: int
    pattern: str
    base: bool = False


#: Base phrases, never suppressed.
BASE = (("cc-by", "cc", "cc by"), ("gpl", "general", "general public license"), ("reserved", "reserved", "all rights reserved"))

#: label: (keyword, name); the label's own words are the identifier.
PERMISSIVE = {
    "0bsd": ("bsd", r"(?:zero clause bsd|bsd zero clause)(?: licen[cs]e)?"),
    "afl": ("academic", r"academic free licen[cs]e(?: version| v)?(?: {v})?"),
    "apache": ("apache", r"(?:the )?apache (?:software )?(?:foundation )?licen[cs]e(?: version| v)?(?: {v})?"),
    "apache-1.1": ("apache", r"apache software license version 1 1"),
    "artistic": ("artistic", r"(?:perl )?artistic licen[cs]e(?: version| v)?(?: {v})?"),
    "bsd-1-clause": ("bsd", r"(?:bsd (?:1|one) clause|(?:1|one) clause bsd)(?: licen[cs]e)?"),
    "bsd-2-clause": ("bsd", r"(?:bsd (?:2|two) clause|(?:2|two) clause bsd|simplified bsd|freebsd style bsd)(?: licen[cs]e)?"),
    "bsd-3-clause": ("bsd", r"(?:bsd (?:3|three) clause|(?:3|three) clause bsd|(?:new|modified|revised) bsd)(?: licen[cs]e)?"),
    "bsd-4-clause": ("bsd", r"(?:bsd (?:4|four) clause|(?:4|four) clause bsd|original bsd)(?: licen[cs]e)?"),
    "bsd": ("bsd", r"bsd(?: style)? licen[cs]e"),
    "blueoak-1.0.0": ("oak", r"blue oak model licen[cs]e(?: 1 0 0)?"),
    "bsl-1.0": ("boost", r"boost software licen[cs]e(?: version| v)?(?: 1 0)?"),
    "beerware": ("beer", r"beer ware licen[cs]e"),
    "curl": ("curl", r"curl licen[cs]e"),
    "ecl": ("educational", r"educational community licen[cs]e(?: version| v)?(?: {v})?"),
    "efl-2.0": ("eiffel", r"eiffel forum licen[cs]e(?: version)?(?: 2 0)?"),
    "fair": ("fair", r"the fair licen[cs]e"),
    "ftl": ("freetype", r"freetype (?:project )?licen[cs]e"),
    "hpnd": ("historical", r"historical permission notice(?: and disclaimer)?"),
    "icu": ("icu", r"icu licen[cs]e"),
    "ijg": ("jpeg", r"independent jpeg group(?: s)? licen[cs]e"),
    "isc": ("isc", r"(?:the )?isc licen[cs]e"),
    "libpng": ("libpng", r"libpng licen[cs]e(?: version 2)?"),
    "mit": ("mit", r"(?:the )?mit(?: style| x11)? licen[cs]e"),
    "mit-0": ("mit", r"mit (?:no attribution|0)(?: licen[cs]e)?"),
    "ms-pl": ("microsoft", r"microsoft public licen[cs]e"),
    "mulanpsl-2.0": ("mulan", r"mulan (?:psl|permissive software licen[cs]e)(?: version| v2)?(?: 2)?"),
    "ncsa": ("ncsa", r"(?:university of illinois )?ncsa open source licen[cs]e"),
    "ntp": ("ntp", r"ntp licen[cs]e"),
    "openssl": ("openssl", r"(?:dual )?openssl(?: and ssleay)? licen[cs]e"),
    "php": ("php", r"php licen[cs]e(?: version| v)?(?: {v})?"),
    "postgresql": ("postgresql", r"postgresql licen[cs]e"),
    "psf-2.0": ("python", r"python software foundation licen[cs]e(?: version 2)?"),
    "python-2.0": ("python", r"python licen[cs]e(?: version)? 2 0"),
    "ruby": ("ruby", r"ruby(?: s)? licen[cs]e"),
    "tcl": ("tcl", r"tcl tk licen[cs]e"),
    "unicode-dfs": ("unicode", r"unicode (?:licen[cs]e agreement|inc licen[cs]e)"),
    "unlicense": ("unlicense", r"(?:the )?unlicense"),
    "upl-1.0": ("universal", r"universal permissive licen[cs]e(?: version| v)?(?: 1 0)?"),
    "vim": ("vim", r"vim licen[cs]e"),
    "w3c": ("w3c", r"w3c software(?: and document)?(?: notice and)? licen[cs]e"),
    "wtfpl": ("want", r"do what the f[a-z]{0,12} you want to public licen[cs]e"),
    "x11": ("x11", r"x11 licen[cs]e"),
    "zend-2.0": ("zend", r"zend licen[cs]e(?: version)?(?: 2 0)?"),
    "zlib": ("zlib", r"(?:the )?zlib(?: libpng)? licen[cs]e"),
    "zpl": ("zope", r"zope public licen[cs]e(?: version| v)?(?: {v})?"),
}
RECIPROCAL = {
    "agpl": ("affero", r"(?:gnu )?affero general public licen[cs]e(?: version| v)?(?: {v})?"),
    "apsl": ("apple", r"apple public source licen[cs]e(?: version)?(?: {v})?"),
    "cddl": ("distribution", r"common development and distribution licen[cs]e(?: version| v)?(?: {v})?"),
    "cecill": ("cecill", r"cecill(?: free software)? licen[cs]e(?: agreement)?(?: version)?(?: {v})?"),
    "cpal-1.0": ("attribution", r"common public attribution licen[cs]e(?: version)?(?: 1 0)?"),
    "cpl-1.0": ("common", r"common public licen[cs]e(?: version| v)?(?: 1 0)?"),
    "epl": ("eclipse", r"eclipse public licen[cs]e(?: version| v)?(?: {v})?"),
    "eupl": ("european", r"european union public licen[cs]e(?: version| v)?(?: {v})?"),
    "gfdl": ("documentation", r"(?:gnu )?free documentation licen[cs]e(?: version)?(?: {v})?"),
    "gpl": ("gnu", r"gnu (?:gpl|general public licen[cs]e(?: gpl)?)(?: version| v)?(?: {v})?"),
    "ipl-1.0": ("ibm", r"ibm public licen[cs]e(?: version)?(?: 1 0)?"),
    "lgpl": ("gnu", r"gnu (?:lgpl|(?:lesser|library) general public licen[cs]e)(?: version| v)?(?: {v})?"),
    "lppl": ("latex", r"latex project public licen[cs]e(?: version)?(?: {v})?"),
    "mpl": ("mozilla", r"mozilla public licen[cs]e(?: mpl)?(?: version| v)?(?: {v})?"),
    "ms-rl": ("microsoft", r"microsoft reciprocal licen[cs]e"),
    "nosl": ("netizen", r"netizen open source licen[cs]e(?: version)?(?: {v})?"),
    "npl": ("netscape", r"netscape public licen[cs]e(?: version)?(?: {v})?"),
    "ofl": ("font", r"(?:sil )?open font licen[cs]e(?: version)?(?: {v})?"),
    "osl": ("open", r"open software licen[cs]e(?: version| v)?(?: {v})?"),
    "qpl-1.0": ("public", r"q public licen[cs]e(?: version)?(?: 1 0)?"),
    "rpl": ("reciprocal", r"reciprocal public licen[cs]e(?: version)?(?: {v})?"),
    "sissl": ("sun", r"sun industry standards source licen[cs]e"),
    "sleepycat": ("sleepycat", r"sleepycat licen[cs]e"),
    "spl-1.0": ("sun", r"sun public licen[cs]e(?: version)?(?: 1 0)?"),
    "watcom-1.0": ("watcom", r"sybase open watcom public licen[cs]e"),
}
CONTENT = {
    "cc0": ("cc0", r"cc0(?: public domain dedication)?(?: {v})?(?: universal)?"),
    "cdla-permissive": ("community", r"community data licen[cs]e agreement permissive(?: version)?(?: {v})?"),
    "cdla-sharing": ("community", r"community data licen[cs]e agreement sharing(?: version)?(?: {v})?"),
    "etalab": ("ouverte", r"licence ouverte(?: open licence)?(?: etalab)?(?: {v})?"),
    "odbl": ("database", r"open (?:data commons open )?database licen[cs]e(?: odbl)?(?: v)?(?: {v})?"),
    "odc-by": ("commons", r"open data commons attribution licen[cs]e(?: v)?(?: {v})?"),
    "ogl-uk": ("government", r"open government licen[cs]e(?: version| v)?(?: {v})?"),
    "pddl": ("commons", r"open data commons public domain dedication(?: and licen[cs]e)?"),
    "public-domain": ("domain", r"(?:in|into|to) the public domain"),
}
RESTRICTED = {
    "bigscience-rail": ("rail", r"(?:bigscience )?(?:open )?rail(?: m)? licen[cs]e"),
    "busl": ("business", r"business source licen[cs]e(?: version)?(?: {v})?"),
    "commons-clause": ("clause", r"commons clause(?: licen[cs]e)? condition"),
    "elastic": ("elastic", r"elastic licen[cs]e(?: version)?(?: {v})?"),
    "jsr": ("java", r"java research licen[cs]e"),
    "llama": ("llama", r"llama(?: {v})? community licen[cs]e(?: agreement)?"),
    "polyform-noncommercial": ("polyform", r"polyform noncommercial licen[cs]e(?: {v})?"),
    "polyform-shield": ("polyform", r"polyform shield licen[cs]e(?: {v})?"),
    "polyform-small-business": ("polyform", r"polyform small business licen[cs]e(?: {v})?"),
    "sspl": ("server", r"server side public licen[cs]e(?: version| v)?(?: {v})?"),
}
#: Kinds of Creative Commons licenses and how they are written out.
CREATIVE = {
    "by": r"attribution",
    "by-sa": r"attribution share ?alike",
    "by-nc": r"attribution non ?commercial",
    "by-nd": r"attribution no ?deriv(?:ative)?s?(?: works)?",
    "by-nc-sa": r"attribution non ?commercial share ?alike",
    "by-nc-nd": r"attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?",
}
#: Sentences of licenses and notices: (label, keyword, pattern).
TEXTS = (
    ("apache-2.0", "apache", r"you may not use this file except in compliance with the license you may obtain a copy of the license at (?:http|https) (?:www )?apache org"),
    ("apache-2.0", "grants", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent) license"),
    ("bsd-style", "binary", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse", r"names? of its contributors may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display"),
    ("bsl-1.0", "boost", r"distributed under the boost software license version 1 0"),
    ("gpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("agpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("gpl", "merchantability", r"without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license"),
    ("or-later", "later", r"either version (?:[0-9]|[0-9] [0-9]) of the license or (?:at your option )?any later version"),
    ("isc", "purpose", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "permission", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "sublicense", r"use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mpl-2.0", "mozilla", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("ofl-1.1", "font", r"this font software is licensed under the sil open font license version 1 1"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", "want", r"you just do what the f[a-z]{0,12} you want to"),
    ("zlib", "altered", r"altered source versions must be plainly marked as such"),
    ("zlib", "origin", r"the origin of this software must not be misrepresented"),
    ("postgresql", "written", r"without fee and without a written agreement is hereby granted"),
    ("cc0", "waived", r"waived all copyright and related or neighboring rights"),
    ("beerware", "beer", r"you can buy me a beer in return"),
    ("public-domain", "domain", r"(?:dedicated|released|placed) (?:in|into|to) the public domain"),
    ("public-domain", "waives", r"the author waives all (?:copyright|rights)"),
    ("proprietary", "confidential", r"(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", "unauthorized", r"unauthorized (?:copying|reproduction|use|distribution)(?: of this file)?(?: via any medium)? is strictly prohibited"),
    ("proprietary", "written", r"without (?:the )?(?:prior |express )?written (?:consent|permission) of"),
    ("proprietary", "reproduced", r"no part of this (?:publication|book|work|document) may be reproduced"),
    ("noncommercial", "commercial", r"for non commercial (?:use|purposes) only"),
    ("noncommercial", "noncommercial", r"for noncommercial (?:use|purposes) only"),
    ("noncommercial", "commercial", r"commercial use (?:is )?(?:prohibited|not permitted|forbidden)"),
    ("research-only", "research", r"for research (?:use|purposes) only"),
    ("attribution", "credit", r"(?:free to use|use is permitted) (?:provided|as long as) (?:that )?(?:appropriate )?credit is given"),
    ("trademark", "trademarks", r"are (?:registered )?trademarks of their respective owners"),
    ("copyright", "copyright", r"copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?"),
)
#: Addresses as words: (label, keyword, pattern).
ADDRESSES = (
    ("apache-2.0", "apache", r"apache org licenses license 2 0"),
    ("agpl", "gnu", r"gnu org licenses agpl(?: {v})?"),
    ("gpl", "gnu", r"gnu org licenses(?: old licenses)? gpl(?: {v})?"),
    ("lgpl", "gnu", r"gnu org licenses(?: old licenses)? lgpl(?: {v})?"),
    ("gfdl", "gnu", r"gnu org licenses fdl(?: {v})?"),
    ("mit", "opensource", r"opensource org licenses? mit"),
    ("bsd-2-clause", "opensource", r"opensource org licenses? bsd 2 clause"),
    ("bsd-3-clause", "opensource", r"opensource org licenses? bsd 3 clause"),
    ("isc", "opensource", r"opensource org licenses? isc"),
    ("zlib", "opensource", r"opensource org licenses? zlib"),
    ("artistic", "opensource", r"opensource org licenses? artistic license(?: {v})?"),
    ("osl", "opensource", r"opensource org licenses? osl(?: {v})?"),
    ("mpl", "mozilla", r"mozilla org (?:en us )?mpl(?: {v})?"),
    ("epl", "eclipse", r"eclipse org legal epl (?:v10|v20|2 0)"),
    ("bsl-1.0", "boost", r"boost org license 1 0 txt"),
    ("unlicense", "unlicense", r"unlicense org"),
    ("wtfpl", "wtfpl", r"wtfpl net"),
    ("cc0", "creativecommons", r"creativecommons org publicdomain zero(?: {v})?"),
    ("public-domain", "creativecommons", r"creativecommons org publicdomain mark(?: {v})?"),
    ("ofl", "sil", r"(?:scripts|openfontlicense) sil org ofl"),
    ("odbl", "opendatacommons", r"opendatacommons org licenses odbl(?: {v})?"),
    ("odc-by", "opendatacommons", r"opendatacommons org licenses by(?: {v})?"),
    ("pddl", "opendatacommons", r"opendatacommons org licenses pddl(?: {v})?"),
    ("zpl", "zope", r"zope org resources zpl"),
    ("php", "php", r"php net license(?: {v})?"),
)


def _words(label: str) -> str:
    return " ".join(re.findall(r"[0-9a-z]+", label))


def rules() -> list[Rule]:
    """All rules in order; of equal detections the first stands."""
    out = [Rule(label, keyword, HINT, pattern, True) for label, keyword, pattern in BASE]
    for table in (PERMISSIVE, RECIPROCAL, CONTENT, RESTRICTED):
        for label, (keyword, name) in table.items():
            version = "(?: {v})?" if "{v}" in name else ""
            out.append(Rule(label, "spdx", IDENTIFIER, rf"spdx licen[cs]e identifier {_words(label)}{version}"))
            out += [Rule(label, keyword, NOTICE, f"{LEAD} (?:{name})"), Rule(label, keyword, NAME, f"(?:{name})")]
    for kind, name in CREATIVE.items():
        label, short = f"cc-{kind}", f"cc {_words(kind)}"
        out.append(Rule(label, "spdx", IDENTIFIER, rf"spdx licen[cs]e identifier {short}(?: {{v}})?"))
        out += [Rule(label, "cc", rank, f"{lead}{short}(?: {{v}})?") for rank, lead in ((NOTICE, LEAD + " "), (NAME, ""))]
        out += [Rule(label, "creative", rank, f"{lead}creative commons {name}(?: {{v}})?(?: (?:international|unported|generic))?(?: licen[cs]e)?") for rank, lead in ((NOTICE, LEAD + " "), (NAME, ""))]
        out.append(Rule(label, "creativecommons", TEXT, f"creativecommons org licenses {_words(kind)}(?: {{v}})?"))
    out += [Rule(label, keyword, TEXT, pattern) for label, keyword, pattern in TEXTS + ADDRESSES]
    return [Rule(r.label, r.keyword, r.rank, r.pattern.replace("{v}", VERSION), r.base) for r in out]
