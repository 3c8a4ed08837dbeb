"""Signature rules of license texts and notices: fixed values, in order of priority.

Patterns are of normalised text: lower-case words of letters and digits, one space between them (so "3.0" is "3 0").
A rule is (priority, keyword, pattern, label, confidence); it is tried only where the keyword is. Priority 1 are passages
of a license's own text, 2 full notices with a version, 3 notices, 4 bare names, 5 hints.
"""

from __future__ import annotations

Rule = tuple[int, str, str, str, float]

# --- Passages of license texts -------------------------------------------------------------------------------------
_PASSAGES: list[Rule] = [
    (1, "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit", 1.0),
    (1, "without restriction", r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute", "mit", 1.0),
    (1, "substantial portions", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit", 1.0),
    (1, "fee is hereby granted", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc", 1.0),
    (1, "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd", 1.0),
    (1, "redistributions of source", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "bsd", 1.0),
    (1, "redistributions in binary", r"redistributions in binary form must reproduce the above copyright notice", "bsd", 1.0),
    (1, "endorse or promote", r"neither the names? of .{1,120}? may be used to endorse or promote products derived from this software", "bsd-3-clause", 1.0),
    (1, "advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledgement", "bsd-4-clause", 1.0),
    (1, "compliance with the license", r"you may not use this file except in compliance with the license", "apache-2.0", 1.0),
    (1, "as is basis", r"distributed on an as is basis without warranties or conditions of any kind either express or implied", "apache-2.0", 0.9),
    (1, "terms and conditions for use", r"terms and conditions for use reproduction and distribution", "apache-2.0", 1.0),
    (1, "free software you can", r"this (?:program|library) is free software you can redistribute it and or modify it under the terms of the gnu", "gpl", 1.0),
    (1, "everyone is permitted", r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", "gpl", 1.0),
    (1, "hope that it will be useful", r"distributed in the hope that it will be useful but without any warranty", "gpl", 0.9),
    (1, "source code form is subject", r"this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0", 1.0),
    (1, "origin of this software", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software", "zlib", 1.0),
    (1, "provided as is without any express", r"this software is provided as is without any express or implied warranty", "zlib", 0.8),
    (1, "free and unencumbered", r"this is free and unencumbered software released into the public domain", "unlicense", 1.0),
    (1, "dedicate any and all", r"dedicate any and all copyright interest in the software to the public domain", "unlicense", 1.0),
    (1, "what the fuck", r"do what the fuck you want to public license", "wtfpl", 1.0),
    (1, "boost software license", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software .{0,40}?covered by this license", "bsl-1.0", 1.0),
    (1, "to the extent possible under law", r"to the extent possible under law .{1,120}? has waived all copyright and related or neighboring rights", "cc0-1.0", 1.0),
    (1, "to share to copy", r"you are free to share to copy distribute and transmit the work", "cc", 1.0),
    (1, "must give appropriate credit", r"you must give appropriate credit provide a link to the license and indicate if changes were made", "cc-by", 1.0),
    (1, "may not use the material for commercial", r"you may not use the material for commercial purposes", "cc-by-nc", 0.9),
    (1, "font software", r"the font software may be modified altered or added to", "ofl-1.1", 1.0),
    (1, "work may be distributed", r"this work may be distributed and or modified under the conditions of the latex project public license", "lppl", 1.0),
    (1, "redistribute it and or modify", r"redistribute it and or modify it under the same terms as perl itself", "artistic-perl", 1.0),
    (1, "subject to the eclipse", r"made available under the terms of the eclipse public license", "epl", 1.0),
    (1, "licensed under the eupl", r"licensed under the eupl", "eupl", 0.9),
    (1, "for good not evil", r"the software shall be used for good not evil", "json", 1.0),
    (1, "buy me a beer", r"you can buy me a beer in return", "beerware", 1.0),
    (1, "open database license", r"made available under the open database license", "odbl-1.0", 1.0),
    (1, "no part of this", r"no part of this (?:publication|book|work|document) may be reproduced", "proprietary", 1.0),
    (1, "prior written permission", r"without (?:the )?(?:express )?prior written permission of the (?:publisher|author|copyright holder|owner)", "proprietary", 0.8),
    (1, "proprietary and confidential", r"(?:this (?:file|software|document) is )?proprietary and confidential", "proprietary", 0.9),
    (1, "unauthorized copying", r"unauthorized copying of this file via any medium is strictly prohibited", "proprietary", 1.0),
]

# --- Families with versions ----------------------------------------------------------------------------------------
_UNDER = r"(?:licensed|released|distributed|available|published|provided|shared|offered) under (?:the )?(?:terms of the )?"
_VERSION = r"(?: license)?(?: version| v)? "

#: (label, keyword, name as a pattern, versions)
_FAMILIES = [
    ("gpl", "general public license", r"(?:gnu )?general public license", ("1", "2", "3")),
    ("gpl", "gpl", r"(?:gnu )?gpl", ("1", "2", "3")),
    ("lgpl", "general public license", r"(?:gnu )?(?:lesser|library) general public license", ("2", "2 1", "3")),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl", ("2", "2 1", "3")),
    ("agpl", "general public license", r"(?:gnu )?affero general public license", ("1", "3")),
    ("agpl", "agpl", r"(?:gnu )?agpl", ("1", "3")),
    ("gfdl", "free documentation license", r"(?:gnu )?free documentation license", ("1 1", "1 2", "1 3")),
    ("apache", "apache", r"apache(?: software)?(?: license)?", ("1 0", "1 1", "2 0")),
    ("mpl", "mozilla public", r"mozilla public license", ("1 0", "1 1", "2 0")),
    ("mpl", "mpl", r"mpl", ("1 1", "2 0")),
    ("epl", "eclipse public", r"eclipse public license", ("1 0", "2 0")),
    ("eupl", "european union public", r"european union public licen[cs]e", ("1 1", "1 2")),
    ("cddl", "common development and distribution", r"common development and distribution license", ("1 0", "1 1")),
    ("cpl", "common public license", r"common public license", ("1 0",)),
    ("osl", "open software license", r"open software license", ("1 0", "2 0", "2 1", "3 0")),
    ("afl", "academic free license", r"academic free license", ("2 0", "2 1", "3 0")),
    ("artistic", "artistic license", r"artistic license", ("1 0", "2 0")),
    ("bsl", "boost software license", r"boost software license", ("1 0",)),
    ("busl", "business source license", r"business source license", ("1 1",)),
    ("ecl", "educational community license", r"educational community license", ("1 0", "2 0")),
    ("ofl", "open font license", r"(?:sil )?open font license", ("1 0", "1 1")),
    ("python", "python software foundation license", r"python software foundation license", ("2",)),
    ("zpl", "zope public license", r"zope public license", ("1 1", "2 0", "2 1")),
    ("upl", "universal permissive license", r"universal permissive license", ("1 0",)),
    ("ms-pl", "microsoft public license", r"microsoft public license", ()),
    ("ms-rl", "microsoft reciprocal license", r"microsoft reciprocal license", ()),
    ("sspl", "server side public license", r"server side public license", ("1",)),
    ("elastic", "elastic license", r"elastic license", ("2 0",)),
    ("odbl", "open database license", r"open database license", ("1 0",)),
    ("pddl", "public domain dedication", r"public domain dedication and license", ("1 0",)),
    ("cecill", "cecill", r"cecill", ("1 0", "2 0", "2 1")),
    ("lppl", "latex project public", r"latex project public license", ("1 0", "1 1", "1 2", "1 3")),
    ("postgresql", "postgresql license", r"postgresql license", ()),
    ("mit", "mit license", r"mit license", ()),
    ("mit", "expat license", r"expat license", ()),
    ("mit", "mit licence", r"mit licence", ()),
    ("isc", "isc license", r"isc license", ()),
    ("bsd-2-clause", "bsd", r"(?:bsd 2 clause|2 clause bsd|simplified bsd|two clause bsd)(?: license)?", ()),
    ("bsd-3-clause", "bsd", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|three clause bsd)(?: license)?", ()),
    ("bsd-4-clause", "bsd", r"(?:bsd 4 clause|4 clause bsd|original bsd)(?: license)?", ()),
    ("bsd", "bsd license", r"bsd license", ()),
    ("zlib", "zlib license", r"zlib license", ()),
    ("unlicense", "unlicense", r"(?:the )?unlicense", ()),
    ("wtfpl", "wtfpl", r"wtfpl", ()),
    ("0bsd", "zero clause bsd", r"(?:bsd )?zero clause bsd(?: license)?", ()),
    ("openssl", "openssl license", r"openssl license", ()),
    ("ruby", "ruby license", r"ruby license", ()),
    ("vim", "vim license", r"vim license", ()),
    ("php", "php license", r"php license", ("3 0", "3 01")),
    ("curl", "curl license", r"curl license", ()),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa open source license", ()),
    ("w3c", "w3c software", r"w3c software (?:notice and )?license", ()),
    ("nist", "nist software", r"nist software license", ()),
    ("hpnd", "historical permission notice", r"historical permission notice and disclaimer", ()),
]


def _family(label: str, keyword: str, name: str, versions: tuple[str, ...]) -> list[Rule]:
    made: list[Rule] = []
    for v in versions:
        full = f"{label}-{v.replace(' ', '.')}"
        made += [(2, keyword, f"{_UNDER}{name}{_VERSION}{v}(?: 0)?", full, 1.0), (4, keyword, f"{name}{_VERSION}{v}(?: 0)?", full, 0.9),
                 (2, keyword, f"{name}{_VERSION}{v} or (?:any |at your option any )?later(?: version)?", f"{full}-or-later", 1.0)]
    return [*made, (3, keyword, _UNDER + name, label, 0.9), (4, keyword, name, label, 0.7)]


# --- Creative Commons: parts by versions ---------------------------------------------------------------------------
_CC_PARTS = [("by", "attribution"), ("by-sa", "attribution share ?alike"), ("by-nd", "attribution no ?deriv(?:ative)?s?"), ("by-nc", "attribution non ?commercial"),
             ("by-nc-sa", "attribution non ?commercial share ?alike"), ("by-nc-nd", "attribution non ?commercial no ?deriv(?:ative)?s?")]
_CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")


def _creative_commons() -> list[Rule]:
    made: list[Rule] = []
    for part, words in _CC_PARTS:
        short = "cc " + part.replace("-", " ")
        for v in _CC_VERSIONS:
            label = f"cc-{part}-{v.replace(' ', '.')}"
            made += [(2, "cc by", f"{_UNDER}{short} {v}", label, 1.0), (4, "cc by", f"{short} {v}", label, 0.9),
                     (2, "creative commons", f"creative commons {words} {v}(?: international| unported| generic)?(?: license)?", label, 1.0)]
        made += [(3, "cc by", _UNDER + short, f"cc-{part}", 0.9), (4, "cc by", short, f"cc-{part}", 0.7), (3, "creative commons", f"creative commons {words}(?: license)?", f"cc-{part}", 0.9)]
    return [*made, (4, "cc0", r"(?:creative commons )?cc0(?: 1 0)?(?: universal)?", "cc0-1.0", 0.9), (5, "creative commons", "creative commons(?: license)?", "cc", 0.6)]


# --- Hints ---------------------------------------------------------------------------------------------------------
_HINTS: list[Rule] = [
    (3, "all rights reserved", r"(?:copyright )?(?:c )?(?:\d{4} )?(?:by )?all rights reserved", "reserved", 0.9),
    (5, "rights reserved", r"(?:some|no) rights reserved", "partly-reserved", 0.5),
    (5, "copyright", r"copyright (?:c )?\d{4}(?: \d{4})?", "copyright", 0.4),
    (4, "public domain", r"(?:released|dedicated|placed|is) (?:in|into|to) the public domain", "public-domain", 0.9),
    (5, "public domain", r"public domain", "public-domain", 0.4),
    (4, "spdx license identifier", r"spdx license identifier(?: [a-z0-9]+){1,4}", "spdx", 0.9),
    (5, "license", r"see (?:the )?license(?: file)? for (?:more )?(?:details|information|the full text)", "reference", 0.4),
    (5, "license", r"license agreement", "agreement", 0.4),
    (4, "end user license", r"end user license agreement", "eula", 0.9),
    (4, "terms of service", r"subject to (?:the|our) terms of service", "terms", 0.5),
    (4, "non commercial use only", r"for non commercial use only", "non-commercial", 0.8),
    (4, "personal use only", r"for personal use only", "personal-use", 0.8),
    (4, "educational use only", r"for educational use only", "educational-use", 0.8),
    (4, "evaluation purposes only", r"for evaluation purposes only", "evaluation", 0.8),
]

RULES: list[Rule] = sorted([*_PASSAGES, *(r for f in _FAMILIES for r in _family(*f)), *_creative_commons(), *_HINTS], key=lambda r: r[0])
