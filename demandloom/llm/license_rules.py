"""Ordered license signatures: regular expressions over normalised text, each with its keyword.

Normalised text is lower-case words separated by single spaces, with one space at either end, so a
signature is written as words and needs no white space or punctuation classes.  A rule is
(keyword, signature, label, priority, confidence): the keyword is a plain string that every match of the
signature contains, and gates it.  Priority 3 names an exact license, 2 a family, 1 a hint.
Signatures for the versions and forms of one family are spelled out from the family's own row.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    keyword: str
    signature: str
    label: str
    priority: int
    confidence: float


EXACT, FAMILY, HINT = 3, 2, 1
# an optional word before a version number, as licenses write it
_VERSION = r"(?:version |v |v)?"

# fixed values: keyword, name as words, label, versions as words (a dot separates words)
_VERSIONED = (
    ("apache", r"apache(?: software)?(?: license)?", "apache", ("1 0", "1 1", "2 0", "2")),
    ("mozilla public", r"mozilla public license", "mpl", ("1 0", "1 1", "2 0")),
    ("eclipse public", r"eclipse public license", "epl", ("1 0", "2 0")),
    ("common development", r"common development and distribution license", "cddl", ("1 0", "1 1")),
    ("common public", r"common public license", "cpl", ("1 0",)),
    ("european union", r"european union public licen[cs]e", "eupl", ("1 0", "1 1", "1 2")),
    ("academic free", r"academic free license", "afl", ("1 1", "1 2", "2 0", "2 1", "3 0")),
    ("open software", r"open software license", "osl", ("1 0", "1 1", "2 0", "2 1", "3 0")),
    ("artistic", r"artistic license", "artistic", ("1 0", "2 0")),
    ("boost software", r"boost software license", "bsl", ("1 0",)),
    ("server side", r"server side public license", "sspl", ("1", "1 0")),
    ("business source", r"business source license", "busl", ("1 0", "1 1")),
    ("elastic", r"elastic license", "elastic", ("1 0", "2 0")),
    ("sil open font", r"sil open font license", "ofl", ("1 0", "1 1")),
    ("open data commons", r"open data commons attribution license", "odc-by", ("1 0",)),
    ("open database", r"open database license", "odbl", ("1 0",)),
    ("zope public", r"zope public license", "zpl", ("1 1", "2 0", "2 1")),
    ("php license", r"php license", "php", ("3 0", "3 01")),
    ("lucent public", r"lucent public license", "lpl", ("1 0", "1 02")),
    ("ibm public", r"ibm public license", "ipl", ("1 0",)),
    ("sun public", r"sun public license", "spl", ("1 0",)),
    ("netscape public", r"netscape public license", "npl", ("1 0", "1 1")),
    ("apple public", r"apple public source license", "apsl", ("1 0", "1 1", "1 2", "2 0")),
    ("reciprocal public", r"reciprocal public license", "rpl", ("1 1", "1 5")),
    ("cecill", r"cecill(?: license)?", "cecill", ("1 0", "1 1", "2 0", "2 1")),
    ("blue oak", r"blue oak model license", "blueoak", ("1 0 0", "1 0")),
    ("mulan", r"mulan (?:permissive software|psl) license", "mulanpsl", ("1", "2")),
    ("unicode license", r"unicode license", "unicode", ("3", "3 0")),
    ("latex project", r"latex project public license", "lppl", ("1 0", "1 1", "1 2", "1 3", "1 3c")),
    ("microsoft public", r"microsoft public license", "ms-pl", ("1 0",)),
    ("microsoft reciprocal license", r"microsoft reciprocal license", "ms-rl", ("1 0",)),
    ("openssl license", r"openssl license", "openssl", ("1 0",)),
    ("w3c", r"w3c software(?: notice and)? license", "w3c", ("1998", "2002", "2015")),
    ("polyform", r"polyform (?:noncommercial|small business|shield|strict) license", "polyform", ("1 0 0", "1 0")),
)

# fixed values: name as words and label; versions 1 to 3, "only" and "or later" forms
_GNU = (
    (r"(?:gnu )?affero general public license", "agpl", ("1", "3")),
    (r"(?:gnu )?(?:lesser|library) general public license", "lgpl", ("2", "2 1", "3")),
    (r"(?:gnu )?general public license", "gpl", ("1", "2", "3")),
    (r"(?:gnu )?free documentation license", "gfdl", ("1 1", "1 2", "1 3")),
)

# fixed values: terms of attribution licenses as words
_CC_TERMS = ("by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd")
_CC_NAMES = {
    "by": "attribution",
    "by sa": "attribution share ?alike",
    "by nd": "attribution no ?deriv(?:ative)?s?",
    "by nc": "attribution non ?commercial",
    "by nc sa": "attribution non ?commercial share ?alike",
    "by nc nd": "attribution non ?commercial no ?deriv(?:ative)?s?",
}
_CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")

# fixed values: keyword, signature, label, priority, confidence
_WRITTEN = (
    ("mit license", r"(?:released|licensed|distributed|available) under (?:the )?(?:terms of )?(?:the )?mit license", "mit", EXACT, 1.0),
    ("mit license", r"the mit license", "mit", EXACT, 0.95),
    ("mit license", r"mit license", "mit", FAMILY, 0.9),
    ("permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software", "mit", EXACT, 1.0),
    ("permission is hereby granted", r"permission is hereby granted", "permissive", HINT, 0.5),
    ("without restriction", r"deal in the software without restriction", "mit", FAMILY, 0.9),
    ("permission to use copy modify", r"permission to use copy modify and or distribute this software for any purpose", "isc", EXACT, 1.0),
    ("isc license", r"isc license", "isc", EXACT, 0.95),
    ("bsd", r"(?:new|revised|modified|3 clause|three clause) bsd license", "bsd-3-clause", EXACT, 0.95),
    ("bsd", r"bsd (?:3|three) clause(?: license)?", "bsd-3-clause", EXACT, 0.95),
    ("bsd", r"(?:simplified|free ?bsd|2 clause|two clause) bsd license", "bsd-2-clause", EXACT, 0.95),
    ("bsd", r"bsd (?:2|two) clause(?: license)?", "bsd-2-clause", EXACT, 0.95),
    ("bsd", r"bsd (?:4|four) clause(?: license)?", "bsd-4-clause", EXACT, 0.95),
    ("bsd", r"(?:bsd zero clause|zero clause bsd|0bsd)(?: license)?", "0bsd", EXACT, 0.95),
    ("bsd", r"bsd (?:style )?licen[cs]e", "bsd", FAMILY, 0.8),
    ("redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted", "bsd", EXACT, 1.0),
    ("redistribution and use", r"redistribution and use", "bsd", HINT, 0.5),
    ("neither the name", r"neither the name of (?:the )?(?:\S+ ){1,8}nor the names of its contributors", "bsd-3-clause", EXACT, 1.0),
    ("all advertising materials", r"all advertising materials mentioning features or use of this software", "bsd-4-clause", EXACT, 1.0),
    ("zlib", r"zlib(?: libpng)? license", "zlib", EXACT, 0.95),
    ("this software is provided as is", r"this software is provided as is without any express or implied warranty", "zlib", FAMILY, 0.9),
    ("provided as is", r"provided as is", "warranty-disclaimer", HINT, 0.4),
    ("without warranty", r"without warranty of any kind", "warranty-disclaimer", HINT, 0.4),
    ("without any warranty", r"without any warranty", "warranty-disclaimer", HINT, 0.4),
    ("unlicense", r"(?:the )?unlicense(?: org)?", "unlicense", EXACT, 0.95),
    ("free and unencumbered", r"this is free and unencumbered software released into the public domain", "unlicense", EXACT, 1.0),
    ("public domain", r"(?:released|dedicated|placed) (?:in ?to|in|to) the public domain", "public-domain", EXACT, 0.9),
    ("public domain", r"in the public domain", "public-domain", FAMILY, 0.7),
    ("public domain", r"public domain", "public-domain", HINT, 0.5),
    ("wtfpl", r"wtfpl(?: license)?", "wtfpl", EXACT, 0.95),
    ("do what the", r"do what the \S+ you want to public license", "wtfpl", EXACT, 1.0),
    ("beerware", r"beerware license", "beerware", EXACT, 0.9),
    ("python software foundation", r"python software foundation license", "psf", EXACT, 0.95),
    ("creative commons", r"creative commons (?:public )?licen[cs]e", "cc", FAMILY, 0.8),
    ("creative commons", r"creative commons", "cc", HINT, 0.5),
    ("creative commons", r"creative commons zero", "cc0", EXACT, 0.95),
    ("cc0", r"cc0(?: 1 0)?(?: universal)?", "cc0", EXACT, 0.95),
    ("open data commons", r"open data commons public domain dedication", "pddl", EXACT, 0.95),
    ("gnu", r"gnu (?:all permissive|public) license", "gnu", FAMILY, 0.7),
    ("free software foundation", r"published by the free software foundation", "gnu", FAMILY, 0.8),
    ("free software foundation", r"free software foundation", "gnu", HINT, 0.4),
    ("any later version", r"at your option any later version", "gnu", FAMILY, 0.8),
    ("gpl", r"gpl", "gpl", HINT, 0.6),
    ("lgpl", r"lgpl", "lgpl", HINT, 0.6),
    ("agpl", r"agpl", "agpl", HINT, 0.6),
    ("apache license", r"licensed under the apache license", "apache", FAMILY, 0.9),
    ("apache license", r"apache license", "apache", HINT, 0.7),
    ("apache org licenses", r"www apache org licenses license 2 0", "apache-2.0", EXACT, 1.0),
    ("all rights reserved", r"copyright (?:c )?(?:\S+ ){0,12}all rights reserved", "copyright-reserved", EXACT, 0.9),
    ("copyright", r"copyright (?:c )?(?:19|20)[0-9][0-9]", "copyright", FAMILY, 0.6),
    ("copyright", r"copyright", "copyright", HINT, 0.3),
    ("all rights reserved", r"all rights reserved", "reserved", FAMILY, 0.8),
    ("some rights reserved", r"some rights reserved", "some-reserved", FAMILY, 0.6),
    ("no rights reserved", r"no rights reserved", "public-domain", FAMILY, 0.7),
    ("all rites reversed", r"all rites reversed", "copyleft", FAMILY, 0.5),
    ("copyleft", r"copyleft", "copyleft", HINT, 0.4),
    ("proprietary", r"proprietary and confidential", "proprietary", EXACT, 0.9),
    ("proprietary", r"proprietary (?:software|license|information)", "proprietary", FAMILY, 0.7),
    ("confidential", r"confidential and proprietary", "proprietary", EXACT, 0.9),
    ("unauthorized copying", r"unauthorized copying of this (?:file|document)", "proprietary", EXACT, 0.9),
    ("may not be reproduced", r"may not be reproduced", "reserved", FAMILY, 0.7),
    ("no part of this", r"no part of this (?:publication|book|document|work) may be reproduced", "reserved", EXACT, 0.9),
    ("personal use only", r"for personal use only", "non-commercial", FAMILY, 0.6),
    ("non commercial use", r"for non commercial use(?: only)?", "non-commercial", FAMILY, 0.6),
    ("noncommercial", r"noncommercial use(?: only)?", "non-commercial", FAMILY, 0.6),
    ("used with permission", r"used with permission", "permission", HINT, 0.4),
    ("reprinted with permission", r"reprinted with permission", "permission", HINT, 0.4),
    ("fair use", r"fair use", "fair-use", HINT, 0.3),
    ("terms of use", r"terms of use", "terms", HINT, 0.3),
    ("terms and conditions", r"terms and conditions", "terms", HINT, 0.2),
    ("end user license", r"end user licen[cs]e agreement", "eula", EXACT, 0.9),
    ("dual licensed", r"dual licensed", "dual", FAMILY, 0.6),
    ("open source license", r"open source licen[cs]e", "open-source", FAMILY, 0.6),
    ("permissive license", r"permissive licen[cs]e", "permissive", FAMILY, 0.5),
    ("crown copyright", r"crown copyright", "crown", EXACT, 0.9),
    ("open government", r"open government licen[cs]e(?: v[123]| version [123])?", "ogl", EXACT, 0.95),
    ("etalab", r"(?:licence ouverte|open licen[cs]e) etalab", "etalab", EXACT, 0.95),
    ("licence ouverte", r"licence ouverte", "etalab", FAMILY, 0.8),
    ("alle rechte vorbehalten", r"alle rechte vorbehalten", "reserved", FAMILY, 0.8),
    ("tous droits r", r"tous droits réservés", "reserved", FAMILY, 0.8),
    ("todos los derechos reservados", r"todos los derechos reservados", "reserved", FAMILY, 0.8),
    ("domaine public", r"domaine public", "public-domain", HINT, 0.5),
    ("dominio p", r"dominio público", "public-domain", HINT, 0.5),
    ("gemeinfrei", r"gemeinfrei", "public-domain", HINT, 0.5),
    ("spdx license identifier", r"spdx license identifier \S+(?: [0-9]+){0,2}(?: (?:only|or later))?", "spdx", EXACT, 1.0),
    ("jquery license", r"jquery license", "mit", FAMILY, 0.7),
    ("x11 license", r"x11 license", "x11", EXACT, 0.9),
    ("expat license", r"expat license", "mit", EXACT, 0.9),
    ("ncsa", r"university of illinois ncsa open source license", "ncsa", EXACT, 0.95),
    ("ncsa license", r"ncsa license", "ncsa", FAMILY, 0.8),
    ("vim license", r"vim license", "vim", EXACT, 0.9),
    ("ruby license", r"ruby license", "ruby", EXACT, 0.9),
    ("curl license", r"curl license", "curl", EXACT, 0.9),
    ("json license", r"json license", "json", EXACT, 0.9),
    ("good not evil", r"shall be used for good not evil", "json", EXACT, 1.0),
    ("postgresql license", r"postgresql license", "postgresql", EXACT, 0.95),
    ("freetype", r"freetype(?: project)? license", "ftl", EXACT, 0.9),
    ("ijg license", r"ijg license", "ijg", EXACT, 0.9),
    ("independent jpeg group", r"based in part on the work of the independent jpeg group", "ijg", EXACT, 0.95),
    ("licensed under", r"licensed under(?: the)?", "licensed", HINT, 0.3),
    ("released under", r"released under(?: the)?(?: terms of)?", "licensed", HINT, 0.2),
    ("licensed to", r"licensed to the apache software foundation", "apache", EXACT, 1.0),
    ("license agreement", r"licen[cs]e agreement", "eula", HINT, 0.4),
    ("see the license", r"see the license for the specific language governing permissions", "apache", EXACT, 0.95),
    ("compliance with the license", r"may not use this file except in compliance with the license", "apache", EXACT, 0.95),
)


def _dotted(version: str) -> str:
    return version.replace(" ", ".")


def all_rules() -> list[Rule]:
    """Every rule in order; a number that goes on (a later minor version) is not a version's match."""
    rules = [Rule(*r) for r in _WRITTEN]
    for keyword, name, label, versions in _VERSIONED:
        for v in versions:
            rules.append(Rule(keyword, f"{name} {_VERSION}{v}(?! [0-9])", f"{label}-{_dotted(v)}", EXACT, 0.95))
        rules.append(Rule(keyword, name, label, FAMILY, 0.8))
    for name, label, versions in _GNU:
        keyword = "documentation license" if label == "gfdl" else "general public license"
        for v in versions:
            numbered = f"{name} (?:as published by the free software foundation (?:either )?)?{_VERSION}{v}(?: 0)?"
            plain, later = f"{label}-{_dotted(v)}", f"{label}-{_dotted(v)}-or-later"
            rules.append(Rule(keyword, f"{numbered}(?! [0-9])", plain, EXACT, 0.95))
            rules.append(Rule(keyword, f"{numbered} or (?:at your option )?(?:any )?later(?: version)?", later, EXACT, 1.0))
            short = f"{label} {_VERSION}{v}(?: 0)?"
            rules.append(Rule(label, f"{short}(?! [0-9])", plain, EXACT, 0.9))
            rules.append(Rule(label, f"{short} (?:or later|plus)", later, EXACT, 0.95))
        rules.append(Rule(keyword, name, label, FAMILY, 0.85))
    for terms in _CC_TERMS:
        label = "cc-" + terms.replace(" ", "-")
        name = f"creative commons {_CC_NAMES[terms]}"
        for v in _CC_VERSIONS:
            rules.append(Rule("cc by", f"cc {terms} {v}", f"{label}-{_dotted(v)}", EXACT, 0.95))
            rules.append(Rule("creative commons", f"{name} {v}", f"{label}-{_dotted(v)}", EXACT, 1.0))
            address = f"creativecommons org licenses {terms} {v}"
            rules.append(Rule("creativecommons", address, f"{label}-{_dotted(v)}", EXACT, 1.0))
        rules.append(Rule("cc by", f"cc {terms}(?! (?:sa|nd|nc))", label, FAMILY, 0.85))
        rules.append(Rule("creative commons", f"{name}(?! (?:non|no|share))", label, FAMILY, 0.85))
    return rules
