"""License texts that the signature rules look for.

Names are given as words of the normalised text: lower case, runs of anything
but letters and digits as one space. The rules are SPDX identifiers, sentences of
the licenses' own texts and notices, their addresses, then the products of the
names and the templates below, in order of priority. A template only adds to the
confidence of a name. Of an SPDX expression the first identifier is read. A rule's keyword is a word that every text it matches must hold.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as op
from re import _parser

#: label: (word to gate by where a name must hold it, names as regexes over normalised words)
LICENSES = {
    "apache-2.0": ("apache", ("apache(?: software)? license(?: version)?(?: v)? ?2(?: 0)?", "apache(?: software foundation)? v?2 0")),
    "apache-1.1": ("apache", ("apache(?: software)? license(?: version)?(?: v)? ?1 1",)),
    "apache-1.0": ("apache", ("apache(?: software)? license(?: version)?(?: v)? ?1 0",)),
    "mit": ("mit", ("mit(?: expat)? licen[sc]e", "mit x11 licen[sc]e")),
    "mit-0": ("attribution", ("mit no attribution(?: licen[sc]e)?",)),
    "x11": ("x11", ("x11 licen[sc]e",)),
    "isc": ("isc", ("isc licen[sc]e",)),
    "bsd-2-clause": ("bsd", ("bsd 2 clause(?: simplified)?(?: licen[sc]e)?", "(?:2|two) clause bsd(?: licen[sc]e)?", "simplified bsd licen[sc]e")),
    "bsd-3-clause": ("bsd", ("bsd 3 clause(?: new)?(?: licen[sc]e)?", "(?:3|three) clause bsd(?: licen[sc]e)?", "(?:new|revised|modified) bsd licen[sc]e")),
    "bsd-4-clause": ("bsd", ("bsd 4 clause(?: licen[sc]e)?", "(?:4|four) clause bsd(?: licen[sc]e)?", "original bsd licen[sc]e")),
    "0bsd": ("bsd", ("zero clause bsd(?: licen[sc]e)?", "bsd zero clause(?: licen[sc]e)?")),
    "bsd": ("bsd", ("bsd licen[sc]e", "bsd style licen[sc]e")),
    "gpl-1.0": ("gnu", ("gnu general public licen[sc]e(?: as published by the free software foundation)?(?: either)? (?:version |v)1(?: 0)?",)),
    "gpl-2.0": ("gnu", ("gnu general public licen[sc]e(?: as published by the free software foundation)?(?: either)? (?:version |v)2(?: 0)?", "gnu gpl v?2(?: 0)?")),
    "gpl-3.0": ("gnu", ("gnu general public licen[sc]e(?: as published by the free software foundation)?(?: either)? (?:version |v)3(?: 0)?", "gnu gpl v?3(?: 0)?")),
    "gpl": ("gpl", ("gnu gpl", "gpl licen[sc]e", "gpl v[123]", "gplv1", "gplv2", "gplv3")),
    "lgpl-2.0": ("gnu", ("gnu library general public licen[sc]e(?: version)?(?: v)? ?2(?: 0)?",)),
    "lgpl-2.1": ("gnu", ("gnu lesser general public licen[sc]e(?: version)?(?: v)? ?2 1", "gnu lgpl v?2 1")),
    "lgpl-3.0": ("gnu", ("gnu lesser general public licen[sc]e(?: version)?(?: v)? ?3(?: 0)?", "gnu lgpl v?3(?: 0)?")),
    "lgpl": ("lesser", ("(?:gnu )?lesser general public licen[sc]e",)),
    "agpl-3.0": ("affero", ("(?:gnu )?affero general public licen[sc]e(?: version)?(?: v)?(?: ?3(?: 0)?)?",)),
    "gfdl": ("documentation", ("gnu free documentation licen[sc]e(?: version)?(?: 1 [123])?",)),
    "mpl-1.1": ("mozilla", ("mozilla public licen[sc]e(?: version)?(?: v)? ?1 1",)),
    "mpl-2.0": ("mozilla", ("mozilla public licen[sc]e(?: version)?(?: v)? ?2(?: 0)?",)),
    "mpl": ("mozilla", ("mozilla public licen[sc]e",)),
    "epl-1.0": ("eclipse", ("eclipse public licen[sc]e(?: version)?(?: v)? ?1(?: 0)?",)),
    "epl-2.0": ("eclipse", ("eclipse public licen[sc]e(?: version)?(?: v)? ?2(?: 0)?",)),
    "edl-1.0": ("eclipse", ("eclipse distribution licen[sc]e(?: version)?(?: v)? ?1(?: 0)?",)),
    "cddl-1.0": ("cddl", ("cddl(?: v)? 1(?: 0)?", "cddl v1(?: 0)?", "cddl1(?: 0)?")),
    "cddl": ("distribution", ("common development and distribution licen[sc]e",)),
    "cpl-1.0": ("common", ("common public licen[sc]e(?: version)?(?: v)?(?: ?1(?: 0)?)?",)),
    "artistic-1.0": ("artistic", ("artistic licen[sc]e(?: version)?(?: v)? ?1(?: 0)?",)),
    "artistic-2.0": ("artistic", ("artistic licen[sc]e(?: version)?(?: v)? ?2(?: 0)?",)),
    "artistic": ("artistic", ("artistic licen[sc]e",)),
    "bsl-1.0": ("boost", ("boost software licen[sc]e(?: version)?(?: 1 0)?",)),
    "zlib": ("zlib", ("zlib(?: libpng)? licen[sc]e",)),
    "libpng": ("libpng", ("libpng licen[sc]e",)),
    "unlicense": ("unlicense", ("unlicense",)),
    "wtfpl": ("wtfpl", ("wtfpl",)),
    "psf": ("python", ("python software foundation licen[sc]e", "psf licen[sc]e")),
    "php-3.01": ("php", ("php licen[sc]e(?: version)?(?: v)?(?: ?3 0?1)?",)),
    "ruby": ("ruby", ("ruby licen[sc]e",)),
    "perl": ("perl", ("same terms as perl(?: itself)?",)),
    "openssl": ("openssl", ("openssl licen[sc]e",)),
    "curl": ("curl", ("curl licen[sc]e",)),
    "icu": ("icu", ("icu licen[sc]e",)),
    "unicode-dfs": ("unicode", ("unicode licen[sc]e(?: agreement)?(?: v3)?",)),
    "ofl-1.1": ("font", ("sil open font licen[sc]e(?: version)?(?: v)?(?: ?1 1)?", "open font licen[sc]e")),
    "eupl-1.2": ("european", ("european union public licen[sc]e(?: version)?(?: v)?(?: ?1 2)?",)),
    "ms-pl": ("microsoft", ("microsoft public licen[sc]e",)),
    "ms-rl": ("microsoft", ("microsoft reciprocal licen[sc]e",)),
    "osl-3.0": ("open", ("open software licen[sc]e(?: version)?(?: v)?(?: ?3(?: 0)?)?",)),
    "afl-3.0": ("academic", ("academic free licen[sc]e(?: version)?(?: v)?(?: ?3(?: 0)?)?",)),
    "ncsa": ("ncsa", ("university of illinois ncsa open source licen[sc]e", "ncsa licen[sc]e")),
    "odbl-1.0": ("database", ("open (?:data commons open )?database licen[sc]e",)),
    "odc-by": ("odc", ("odc by(?: 1 0)?",)),
    "sspl-1.0": ("server", ("server side public licen[sc]e",)),
    "busl-1.1": ("business", ("business source licen[sc]e(?: 1 1)?",)),
    "elastic-2.0": ("elastic", ("elastic licen[sc]e(?: 2 0)?",)),
    "w3c": ("w3c", ("w3c software(?: notice and)? licen[sc]e",)),
    "postgresql": ("postgresql", ("postgresql licen[sc]e",)),
    "vim": ("vim", ("vim licen[sc]e",)),
    "upl-1.0": ("universal", ("universal permissive licen[sc]e",)),
    "cecill": ("cecill", ("cecill(?: [abc])?(?: licen[sc]e)?",)),
    "cc0-1.0": ("cc0", ("cc0(?: 1 0)?(?: universal)?",)),
    "cc-zero": ("creative", ("creative commons zero",)),
    "cc-by-nc-nd": ("cc", ("cc by nc nd(?: [1-4] [05])?",)),
    "cc-by-nc-sa": ("cc", ("cc by nc sa(?: [1-4] [05])?",)),
    "cc-by-nc": ("cc", ("cc by nc(?: [1-4] [05])?",)),
    "cc-by-nd": ("cc", ("cc by nd(?: [1-4] [05])?",)),
    "cc-by-sa": ("cc", ("cc by sa(?: [1-4] [05])?",)),
    "cc-by-4.0": ("cc", ("cc by 4 0",)),
    "cc-by-3.0": ("cc", ("cc by 3 0",)),
    "cc-by-2.0": ("cc", ("cc by 2 [05]",)),
    "cc-attribution": ("creative", ("creative commons attribution(?: (?:noncommercial|non commercial|sharealike|share alike|noderivatives|no derivatives))*(?: [1-4] [05])?(?: international| unported)?",)),
    "creative-commons": ("creative", ("creative commons",)),
    "public-domain": ("domain", ("(?:in|into|to) the public domain", "public domain dedication")),
    "copyright": ("copyright", ("copyright(?: c)? (?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])?",)),
    "proprietary": ("proprietary", ("proprietary and confidential", "confidential and proprietary")),
}

#: label: SPDX identifiers, where these are not the label itself
SPDX = {
    "mpl": ("MPL-1.0",),
    "cddl": ("CDDL-1.1",),
    "artistic-1.0": ("Artistic-1.0", "Artistic-1.0-Perl", "Artistic-1.0-cl8"),
    "psf": ("PSF-2.0", "Python-2.0"),
    "unicode-dfs": ("Unicode-DFS-2015", "Unicode-DFS-2016", "Unicode-3.0"),
    "odc-by": ("ODC-By-1.0",),
    "gfdl": ("GFDL-1.1", "GFDL-1.2", "GFDL-1.3"),
    "cecill": ("CECILL-1.0", "CECILL-1.1", "CECILL-2.0", "CECILL-2.1", "CECILL-B", "CECILL-C"),
    "cc-by-2.0": ("CC-BY-2.0", "CC-BY-2.5"),
} | {f"cc-by-{x}": tuple(f"CC-BY-{x}-{v}" for v in ("1.0", "2.0", "2.5", "3.0", "4.0")) for x in ("nc-nd", "nc-sa", "nc", "nd", "sa")}
#: Labels that are no SPDX identifiers.
NOT_SPDX = {"bsd", "gpl", "lgpl", "artistic", "perl", "cc-zero", "cc-attribution", "creative-commons", "public-domain", "copyright", "proprietary"}

#: (label, word to gate by, sentence of the license's text or of its usual notice)
SENTENCES = (
    ("mit", "obtaining", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "substantial", "copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("ncsa", "restriction", "to deal with the software without restriction including without limitation"),
    ("bsl-1.0", "organization", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("isc", "fee", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "permission", "copyright notice and this permission notice appear in all copies"),
    ("postgresql", "agreement", "for any purpose without fee and without a written agreement is hereby granted"),
    ("w3c", "royalty", "for any purpose and without fee or royalty is hereby granted"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions", "redistributions in binary form must reproduce the above copyright notice this list of conditions"),
    ("bsd", "redistributions", "redistributions of source code must retain the above copyright notice"),
    ("bsd-3-clause", "endorse", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display"),
    ("apache-2.0", "compliance", "you may not use this file except in compliance with the license"),
    ("apache-2.0", "required", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", "irrevocable", "perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce"),
    ("apache-2.0", "contributor", "each contributor hereby grants to you a perpetual worldwide"),
    ("gpl", "redistribute", "free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "received", "you should have received a copy of the gnu general public license"),
    ("gpl", "verbatim", "everyone is permitted to copy and distribute verbatim copies of this license document"),
    ("gpl", "merchantability", "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license"),
    ("lgpl", "redistribute", "free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("lgpl", "received", "you should have received a copy of the gnu (?:lesser|library) general public license"),
    ("agpl-3.0", "affero", "under the terms of the gnu affero general public license"),
    ("agpl-3.0", "remotely", "must prominently offer all users interacting with it remotely"),
    ("gfdl", "invariant", "with no invariant sections no front cover texts and no back cover texts"),
    ("mpl-2.0", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", "mozilla", "contents of this file are subject to the mozilla public license version 1 1"),
    ("epl-2.0", "eclipse", "made available under the terms of the eclipse public license 2 0"),
    ("epl-1.0", "eclipse", "made available under the terms of the eclipse public license v1 0"),
    ("cddl", "distribution", "subject to the terms of the common development and distribution license"),
    ("zlib", "liable", "in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented"),
    ("zlib", "altered", "altered source versions must be plainly marked as such"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "want", "you just do what the fuck you want to"),
    ("cc0-1.0", "deed", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc0-1.0", "neighboring", "waived all copyright and related or neighboring rights"),
    ("ofl-1.1", "font", "this font software is licensed under the sil open font license"),
    ("ofl-1.1", "components", "nor any of its individual components in original or modified versions may be sold by itself"),
    ("artistic-2.0", "verbatim", "you are permitted to use the standard version and create and use modified versions"),
    ("artistic-1.0", "holder", "such that the copyright holder maintains some semblance of artistic control"),
    ("psf", "python", "psf is making python available to licensee on an as is basis"),
    ("php-3.01", "php", "this product includes php software freely available"),
    ("openssl", "openssl", "software developed by the openssl project for use in the openssl toolkit"),
    ("apache-1.1", "apache", "this product includes software developed by the apache software foundation"),
    ("ms-pl", "governs", "this license governs use of the accompanying software if you use the software you accept this license"),
    ("busl-1.1", "production", "create derivative works redistribute and make non production use of the licensed work"),
    ("elastic-2.0", "hosted", "you may not provide the software to third parties as a hosted or managed service"),
    ("sspl-1.0", "functionality", "make the functionality of the program or a modified version available to third parties as a service"),
    ("odbl-1.0", "database", "this database is made available under the open database license"),
    ("eupl-1.2", "eupl", "licensed under the eupl"),
    ("upl-1.0", "larger", "the software and the larger works"),
    ("unicode-dfs", "unicode", "to any person obtaining a copy of the unicode data files"),
    ("creative-commons", "adapt", "you are free to share copy and redistribute the material in any medium or format"),
    ("public-domain", "dedicated", "has been dedicated to the public domain"),
    ("proprietary", "prohibited", "unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", "reproduced", "no part of this (?:publication|work|document) may be reproduced"),
)

#: (label, word to gate by, address as words)
ADDRESSES = (
    ("apache-2.0", "apache", "apache org licenses license 2 0"),
    ("mit", "opensource", "opensource org licenses mit(?: license php)?"),
    ("bsd-2-clause", "opensource", "opensource org licenses bsd 2 clause"),
    ("bsd-3-clause", "opensource", "opensource org licenses bsd 3 clause"),
    ("isc", "opensource", "opensource org licenses isc"),
    ("gpl-3.0", "gnu", "gnu org licenses gpl 3 0"),
    ("gpl-2.0", "gnu", "gnu org licenses(?: old licenses)? gpl 2 0"),
    ("gpl", "gnu", "gnu org licenses gpl"),
    ("lgpl", "gnu", "gnu org licenses lgpl"),
    ("agpl-3.0", "gnu", "gnu org licenses agpl"),
    ("gfdl", "gnu", "gnu org licenses fdl"),
    ("mpl-2.0", "mozilla", "mozilla org mpl 2 0"),
    ("mpl", "mozilla", "mozilla org mpl"),
    ("epl-2.0", "eclipse", "eclipse org legal epl 2 0"),
    ("epl-1.0", "eclipse", "eclipse org legal epl v10"),
    ("edl-1.0", "eclipse", "eclipse org org documents edl v10"),
    ("bsl-1.0", "boost", "boost org license 1 0 txt"),
    ("cc0-1.0", "creativecommons", "creativecommons org publicdomain zero 1 0"),
    ("public-domain", "creativecommons", "creativecommons org publicdomain mark 1 0"),
    ("cc-by-nc-nd", "creativecommons", "creativecommons org licenses by nc nd"),
    ("cc-by-nc-sa", "creativecommons", "creativecommons org licenses by nc sa"),
    ("cc-by-nc", "creativecommons", "creativecommons org licenses by nc"),
    ("cc-by-nd", "creativecommons", "creativecommons org licenses by nd"),
    ("cc-by-sa", "creativecommons", "creativecommons org licenses by sa"),
    ("cc-by-4.0", "creativecommons", "creativecommons org licenses by 4 0"),
    ("cc-by-3.0", "creativecommons", "creativecommons org licenses by 3 0"),
    ("unlicense", "unlicense", "unlicense org"),
    ("odbl-1.0", "opendatacommons", "opendatacommons org licenses odbl"),
    ("odc-by", "opendatacommons", "opendatacommons org licenses by"),
    ("ofl-1.1", "sil", "scripts sil org ofl"),
    ("wtfpl", "wtfpl", "wtfpl net"),
)

#: (confidence, regex before the name, regex after it), the most telling first
TEMPLATES = (
    (1.0, "spdx license identifier ", ""),
    (0.95, "(?:licensed|released|distributed|published|available|provided)(?: to you)? under(?: the)?(?: terms(?: and conditions)? of)?(?: the)? ", ""),
    (0.9, "(?:subject to|covered by|governed by)(?: the)?(?: terms of)?(?: the)? ", ""),
    (0.8, "", ""),
)


@dataclass(frozen=True)
class Signature:
    label: str
    keyword: bytes
    pattern: bytes
    priority: int
    confidence: float


def required_words(pattern: str) -> list[str]:
    """Whole words that every match of a regex over normalised words holds, as far as literals show."""
    out: list[str] = []
    word, whole, closed = "", True, False  # whole: begins at a word's start; closed: may only be followed by a space

    def end():
        if whole and word:
            out.append(word)

    for kind, arg in _parser.parse(pattern):
        if kind is op.LITERAL and chr(arg) == " ":
            end()
            word, whole, closed = "", True, False
        elif kind is op.LITERAL:
            # after an optional part that may have stood as words of its own, this ends no known word
            word, whole, closed = word + chr(arg), whole and not closed, False
        else:
            inner = list(arg[2]) if kind is op.MAX_REPEAT and arg[0] == 0 else []
            edge = lambda x: x == (op.LITERAL, ord(" "))
            if inner and word and edge(inner[0]):
                closed = True
            elif not (inner and not word and whole and edge(inner[-1])):
                word, whole, closed = word + "?", False, False
    end()
    return out


def _keyword(hint: str, name: str) -> str:
    found = required_words(name)
    if not found:
        raise ValueError(f"no word that all texts of a rule hold; split it: {name}")
    return hint if hint in found else max(found, key=len)


def spdx() -> list[tuple[str, str]]:
    """(regex of an identifier's words, label), those of more words first."""
    pairs = [(x, label) for label in LICENSES if label not in NOT_SPDX for x in SPDX.get(label, (label,))]
    words = [(re.sub("[^a-z0-9]+", " ", x.lower()) + ("(?: only| or later)?" if label.split("-")[0] in ("gpl", "lgpl", "agpl", "gfdl") else ""), label) for x, label in pairs]
    return sorted(words, key=lambda x: -x[0].count(" "))


def signatures() -> list[Signature]:
    """All rules, highest priority first: SPDX identifiers, sentences, addresses, then by template, then as the licenses stand."""
    ids = spdx()
    own = [(0.95, x) for x in SENTENCES] + [(0.9, x) for x in ADDRESSES]
    below = len(ids) + len(own)
    texts = [Signature(label, _keyword(word, text).encode(), f"(?<= ){text}(?= )".encode(), k - len(own), c) for k, (c, (label, word, text)) in enumerate(own)]
    out = texts + [Signature(label, b"spdx", f"(?<= )spdx license identifier {x}(?= )".encode(), k - below, 1.0) for k, (x, label) in enumerate(ids)]
    for t, (confidence, before, after) in enumerate(TEMPLATES):
        for k, (label, (keyword, names)) in enumerate(LICENSES.items()):
            for name in names:
                pattern = f"(?<= ){before}(?:{name}){after}(?= )"
                out.append(Signature(label, _keyword(keyword, name).encode(), pattern.encode(), t * len(LICENSES) + k, confidence))
    return out
