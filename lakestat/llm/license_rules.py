"""Signature rules for license texts, notices, names, tags and addresses.

Rules see a text as its lower-cased words with one space between them (``gpl-3.0`` is ``gpl 3 0``). A rule has a
priority (the larger wins), the label it reports, and the pattern. Its gates are derived from the pattern: words that
every match contains.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as sre
from re import _parser

TAG, NOTICE, TEXT, ADDRESS, NAME, MENTION = 95, 90, 85, 75, 60, 20

#: label | words of the identifier as used in tags and short references
IDENTIFIERS = """
mit | mit
mit-0 | mit 0
apache-2 | apache 2 0
apache-1.1 | apache 1 1
apache-1 | apache 1 0
bsd-2-clause | bsd 2 clause
bsd-3-clause | bsd 3 clause
bsd-4-clause | bsd 4 clause
0bsd | 0bsd
isc | isc
gpl-1 | gpl 1 0
gpl-2 | gpl 2 0
gpl-3 | gpl 3 0
lgpl-2 | lgpl 2 0
lgpl-2.1 | lgpl 2 1
lgpl-3 | lgpl 3 0
agpl-1 | agpl 1 0
agpl-3 | agpl 3 0
mpl-1 | mpl 1 0
mpl-1.1 | mpl 1 1
mpl-2 | mpl 2 0
epl-1 | epl 1 0
epl-2 | epl 2 0
eupl-1.1 | eupl 1 1
eupl-1.2 | eupl 1 2
cddl-1 | cddl 1 0
cddl-1.1 | cddl 1 1
cpl-1 | cpl 1 0
ipl-1 | ipl 1 0
osl-3 | osl 3 0
afl-2.1 | afl 2 1
afl-3 | afl 3 0
artistic-1 | artistic 1 0
artistic-2 | artistic 2 0
zlib | zlib
libpng | libpng
bsl-1 | bsl 1 0
unlicense | unlicense
wtfpl | wtfpl
cc0-1 | cc0 1 0
cc-by-1 | cc by 1 0
cc-by-2 | cc by 2 0
cc-by-2.5 | cc by 2 5
cc-by-3 | cc by 3 0
cc-by-4 | cc by 4 0
cc-by-sa-2 | cc by sa 2 0
cc-by-sa-2.5 | cc by sa 2 5
cc-by-sa-3 | cc by sa 3 0
cc-by-sa-4 | cc by sa 4 0
cc-by-nc | cc by nc 2 0
cc-by-nc | cc by nc 3 0
cc-by-nc | cc by nc 4 0
cc-by-nd-3 | cc by nd 3 0
cc-by-nd-4 | cc by nd 4 0
cc-by-nc-sa-3 | cc by nc sa 3 0
cc-by-nc-sa-4 | cc by nc sa 4 0
cc-by-nc-nd-3 | cc by nc nd 3 0
cc-by-nc-nd-4 | cc by nc nd 4 0
odbl-1 | odbl 1 0
odc-by-1 | odc by 1 0
pddl-1 | pddl 1 0
gfdl-1.1 | gfdl 1 1
gfdl-1.2 | gfdl 1 2
gfdl-1.3 | gfdl 1 3
ofl-1 | ofl 1 0
ofl-1.1 | ofl 1 1
ms-pl | ms pl
ms-rl | ms rl
psf-2 | psf 2 0
python-2 | python 2 0
php-3 | php 3 0
php-3.01 | php 3 01
ruby | ruby
postgresql | postgresql
openssl | openssl
ncsa | ncsa
upl-1 | upl 1 0
ecl-2 | ecl 2 0
ms-lpl | ms lpl
sspl-1 | sspl 1 0
busl-1.1 | busl 1 1
elastic-2 | elastic 2 0
json | json
beerware | beerware
blueoak-1 | blueoak 1 0 0
vim | vim
tcl | tcl
x11 | x11
curl | curl
ftl | ftl
ijg | ijg
icu | icu
unicode-3 | unicode 3 0
w3c | w3c
zpl-2.1 | zpl 2 1
qpl-1 | qpl 1 0
nasa-1.3 | nasa 1 3
rpl-1.5 | rpl 1 5
cecill-2.1 | cecill 2 1
cecill-b | cecill b
cecill-c | cecill c
mulanpsl-2 | mulanpsl 2 0
llama-2 | llama 2
openrail-m | openrail m
"""

#: priority | label | pattern
PATTERNS = r"""
85 | mit | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
85 | mit | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
60 | mit | (?:the )?mit license
60 | mit | (?:the )?mit licence
60 | mit | mit licensed
60 | mit | (?:the )?expat license
60 | mit | mit lizenz
90 | mit | released under (?:the )?(?:terms of the )?mit license
90 | mit | distributed under (?:the )?(?:terms of the )?mit license
90 | mit | licensed under (?:the )?(?:terms of the )?mit license
75 | mit | opensource org licenses? mit(?: license)?(?: php| html)?
85 | apache-2 | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
85 | apache-2 | distributed on an as is basis without warranties or conditions of any kind
60 | apache-2 | apache license,? v(?:ersion)? ?2(?: 0)?
60 | apache-2 | apache license 2(?: 0)?
60 | apache-2 | apache licence (?:version )?2(?: 0)?
60 | apache-2 | asl 2(?: 0)?
75 | apache-2 | (?:www )?apache org licenses license 2 0(?: txt| html)?
75 | apache-2 | opensource org licenses? apache 2 0
60 | apache-1.1 | apache (?:software )?license (?:version )?1 1
60 | apache-1 | apache (?:software )?license (?:version )?1 0
40 | apache | apache (?:software )?license
40 | apache | apache licensed
85 | bsd-3-clause | neither the name of (?:(?!neither the name of ).)+? nor the names of its contributors may be used to endorse or promote products
85 | bsd-2-clause | redistributions? (?:and use )?in source and binary forms with or without modification are permitted provided that the following conditions are met
85 | bsd-4-clause | all advertising materials mentioning features or use of this software must display the following acknowledgement
60 | bsd-3-clause | (?:3|three) clause bsd|bsd (?:3|three) clause
60 | bsd-2-clause | (?:2|two) clause bsd|bsd (?:2|two) clause
60 | bsd-3-clause | (?:new|modified|revised) bsd licen[sc]e
60 | bsd-2-clause | (?:simplified|freebsd) bsd licen[sc]e
60 | bsd-2-clause | freebsd license
60 | bsd-4-clause | (?:original|old) bsd licen[sc]e
40 | bsd | bsd (?:style )?license
40 | bsd | bsd (?:style )?licence
40 | bsd | bsd licensed
75 | bsd-3-clause | opensource org licenses? bsd 3 clause
75 | bsd-2-clause | opensource org licenses? bsd 2 clause
75 | bsd | opensource org licenses? bsd license(?: php)?
85 | isc | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
60 | isc | isc licen[sc]e
60 | isc | isc licensed
75 | isc | opensource org licenses? isc
85 | gpl-3 | redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3
85 | gpl-2 | redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2
60 | gpl-3 | gnu general public licen[sc]e (?:v|version )?3(?: 0)?
60 | gpl-2 | gnu general public licen[sc]e (?:v|version )?2(?: 0)?
60 | gpl-3 | gplv3
60 | gpl-2 | gplv2
60 | gpl-3 | gnu gpl (?:v|version )?3
60 | gpl-2 | gnu gpl (?:v|version )?2
40 | gpl | gnu general public licen[sc]e
40 | gpl | gnu gpl
40 | gpl | gpl licen[sc]e
40 | gpl | gpl licensed
75 | gpl | gnu org (?:licenses|copyleft) gpl(?: \d \d)?(?: html| txt)?
75 | gpl-3 | opensource org licenses? gpl 3 0
75 | gpl-2 | opensource org licenses? gpl 2 0
85 | lgpl-2.1 | modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1
85 | lgpl-3 | modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3
62 | lgpl-2.1 | gnu lesser general public licen[sc]e (?:v|version )?2 1
62 | lgpl-3 | gnu lesser general public licen[sc]e (?:v|version )?3(?: 0)?
62 | lgpl-2 | gnu library general public licen[sc]e (?:v|version )?2(?: 0)?
60 | lgpl-3 | lgplv3
60 | lgpl-2.1 | lgplv2(?: 1)?
42 | lgpl | (?:gnu )?lesser general public licen[sc]e
42 | lgpl | gnu library general public licen[sc]e
40 | lgpl | gnu lgpl
40 | lgpl | lgpl licen[sc]e
75 | lgpl | gnu org (?:licenses|copyleft) lgpl(?: \d \d)?(?: html| txt)?
85 | agpl-3 | modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3
62 | agpl-3 | gnu affero general public licen[sc]e (?:v|version )?3(?: 0)?
60 | agpl-3 | agplv3
42 | agpl | (?:gnu )?affero general public licen[sc]e
40 | agpl | gnu agpl
40 | agpl | agpl licen[sc]e
75 | agpl | gnu org licenses agpl(?: \d \d)?(?: html| txt)?
85 | mpl-2 | this source code form is subject to the terms of the mozilla public license v 2 0
62 | mpl-2 | mozilla public licen[sc]e (?:v |v|version )?2(?: 0)?
62 | mpl-1.1 | mozilla public licen[sc]e (?:v |v|version )?1 1
62 | mpl-1 | mozilla public licen[sc]e (?:v |v|version )?1 0
40 | mpl | mozilla public license
75 | mpl-2 | (?:www )?mozilla org (?:en us )?mpl 2 0
75 | mpl | (?:www )?mozilla org (?:en us )?mpl
62 | epl-2 | eclipse public licen[sc]e (?:v |v|version )?2(?: 0)?
62 | epl-1 | eclipse public licen[sc]e (?:v |v|version )?1(?: 0)?
40 | epl | eclipse public license
75 | epl-1 | (?:www )?eclipse org legal epl v10(?: html)?
75 | epl-2 | (?:www )?eclipse org legal epl 2 0
62 | edl-1 | eclipse distribution license
62 | eupl-1.2 | european union public licen[sc]e (?:v |v|version )?1 2
62 | eupl-1.1 | european union public licen[sc]e (?:v |v|version )?1 1
40 | eupl | european union public licen[sc]e
62 | cddl-1 | common development and distribution licen[sc]e (?:v|version )?1 0
62 | cddl-1.1 | common development and distribution licen[sc]e (?:v|version )?1 1
40 | cddl | common development and distribution licen[sc]e
62 | cpl-1 | common public license(?: (?:v|version )?1 0)?
62 | ipl-1 | ibm public license(?: (?:v|version )?1 0)?
62 | osl-3 | open software license (?:v|version )?3(?: 0)?
40 | osl | open software license
62 | afl-3 | academic free license (?:v|version )?3(?: 0)?
62 | afl-2.1 | academic free license (?:v|version )?2 1
40 | afl | academic free license
62 | artistic-2 | artistic license (?:v|version )?2(?: 0)?
62 | artistic-1 | artistic license (?:v|version )?1(?: 0)?
40 | artistic | (?:the )?artistic license
62 | artistic-1-perl | under the same terms as perl(?: itself)?
85 | zlib | this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages
60 | zlib | zlib licen[sc]e
60 | zlib | zlib libpng licen[sc]e
60 | libpng | libpng licen[sc]e
60 | bsl-1 | boost software license(?: (?:v|version )?1 0)?
75 | bsl-1 | (?:www )?boost org license 1 0(?: txt)?
85 | unlicense | this is free and unencumbered software released into the public domain
60 | unlicense | (?:the )?unlicense
75 | unlicense | unlicense org
60 | wtfpl | wtfpl
62 | wtfpl | do what the fuck you want to public license
62 | cc0-1 | cc0(?: 1 0)?(?: universal)?
62 | cc0-1 | creative commons (?:cc )?zero
75 | cc0-1 | creativecommons org publicdomain zero 1 0
75 | public-domain-mark | creativecommons org publicdomain mark 1 0
75 | cc-by-nc-nd | creativecommons org licenses by nc nd \d \d
75 | cc-by-nc-sa | creativecommons org licenses by nc sa \d \d
75 | cc-by-nc | creativecommons org licenses by nc \d \d
75 | cc-by-nd | creativecommons org licenses by nd \d \d
75 | cc-by-sa | creativecommons org licenses by sa \d \d
75 | cc-by | creativecommons org licenses by \d \d
66 | cc-by-nc-nd | creative commons attribution non ?commercial no ?deriv(?:atives|s)?(?: works)?
66 | cc-by-nc-nd | creative commons attribution non ?commercial no ?deriv(?:atives|s)?
66 | cc-by-nc-sa | creative commons attribution non ?commercial share ?alike
64 | cc-by-nc | creative commons attribution non ?commercial
64 | cc-by-sa | creative commons attribution share ?alike
64 | cc-by-nd | creative commons attribution no ?deriv(?:ative)?s
62 | cc-by | creative commons attribution
40 | cc | creative commons licen[sc]e
40 | cc | creative commons
66 | cc-by-nc-nd | cc by nc nd
66 | cc-by-nc-sa | cc by nc sa
64 | cc-by-nc | cc by nc
64 | cc-by-nd | cc by nd
64 | cc-by-sa | cc by sa
62 | cc-by | cc by licen[sc]e
62 | cc-by | cc by (?:4|3|2)(?: 0)?
62 | odbl-1 | open data(?:base)? (?:commons open database )?license
62 | odc-by-1 | open data commons attribution license
62 | pddl-1 | public domain dedication (?:and )?licen[sc]e
75 | odbl-1 | opendatacommons org licenses odbl
62 | gfdl | gnu free documentation licen[sc]e(?: version 1 \d)?
40 | gfdl | gfdl
62 | ofl-1.1 | sil open font licen[sc]e(?: version 1 1)?
75 | ofl-1.1 | scripts sil org ofl
62 | ms-pl | microsoft public license
62 | ms-rl | microsoft reciprocal license
62 | psf-2 | python software foundation licen[sc]e(?: version 2)?
62 | php-3.01 | php licen[sc]e(?: (?:v|version )?3 01)?
62 | ruby | ruby licen[sc]e
62 | ruby | under the same terms as ruby(?: itself)?
62 | postgresql | postgresql licen[sc]e
62 | openssl | openssl licen[sc]e
62 | ncsa | university of illinois ncsa open source license
62 | upl-1 | universal permissive license
62 | ecl-2 | educational community license(?: (?:v|version )?2 0)?
62 | sspl-1 | server side public license
62 | busl-1.1 | business source license(?: 1 1)?
62 | elastic-2 | elastic license(?: (?:v|version )?2(?: 0)?)?
62 | json | shall be used for good not evil
62 | beerware | beer ?ware license
62 | blueoak-1 | blue oak model license
62 | vim | vim licen[sc]e
62 | x11 | x11 licen[sc]e
62 | curl | curl licen[sc]e
62 | ftl | free ?type (?:project )?licen[sc]e
62 | ijg | independent jpeg group
62 | icu | icu licen[sc]e
62 | unicode-3 | unicode licen[sc]e(?: v3)?
62 | w3c | w3c software (?:notice and )?(?:document )?licen[sc]e
62 | zpl-2.1 | zope public license(?: (?:v|version )?2 1)?
62 | qpl-1 | q public license
62 | nasa-1.3 | nasa open source agreement
62 | rpl-1.5 | reciprocal public license
62 | cecill-2.1 | cecill(?: free software license agreement)?
62 | mulanpsl-2 | mulan psl v?2
62 | apsl-2 | apple public source license
62 | ogl-uk-3 | open government licence(?: v3 0)?
62 | openrail-m | (?:creativeml |bigcode )?openrail ?\+{0,2}m?
62 | etalab-2 | licence ouverte
62 | dl-de-by-2 | datenlizenz deutschland(?: namensnennung)?
62 | public-domain | released (?:in)?to the public domain
62 | public-domain | dedicated to the public domain
40 | public-domain | in the public domain
55 | proprietary | all rights reserved
55 | proprietary | proprietary and confidential
55 | proprietary | unauthorized copying (?:of this file )?(?:via any medium )?is strictly prohibited
20 | unknown-license | licensed under (?:the )?(?:terms of (?:the )?)?\w+(?: \w+){0,3} licen[sc]e
20 | unknown-license | released under (?:the )?(?:terms of (?:the )?)?\w+(?: \w+){0,3} licen[sc]e
20 | unknown-license | distributed under (?:the )?(?:terms of (?:the )?)?\w+(?: \w+){0,3} licen[sc]e
20 | license-reference | see (?:the )?(?:accompanying )?license (?:file|txt|md)(?: for details)?
20 | copyright-notice | copyright c (?:19|20)\d\d
20 | copyright-notice | copyright (?:19|20)\d\d
"""


@dataclass(frozen=True)
class Rule:
    """One signature: tried only where all words of one of its ``gates`` occur."""

    priority: int
    label: str
    gates: tuple[frozenset[bytes], ...]
    pattern: re.Pattern[bytes]


#: Repeats up to this often are spelled out.
_SPELLED = 3
_WILD = "\0"


def _spellings(items) -> set[str]:
    """All texts that a parsed pattern matches, with _WILD for what is not spelled out."""
    found = {""}
    for op, arg in items:
        if op is sre.LITERAL:
            own = {chr(arg)}
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg):
            own = {chr(c) for _, c in arg}
        elif op is sre.SUBPATTERN:
            own = _spellings(arg[-1])
        elif op is sre.BRANCH:
            own = set().union(*map(_spellings, arg[1]))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, sub = arg
            own = {""} if low == 0 else set()
            if high > _SPELLED:
                own.add(_WILD)
            else:
                some, part = {""}, _spellings(sub)
                for n in range(1, high + 1):
                    some = {a + b for a in some for b in part}
                    own |= some if n >= low else set()
        else:
            own = {_WILD}
        found = {a + b for a in found for b in own}
    return found


def gates_of(pattern: str) -> tuple[frozenset[bytes], ...]:
    """Sets of words; every match has all words of one of them. One set if all spellings share a word."""
    spelled = [s.split() for s in _spellings(_parser.parse(pattern))]
    possible = [s for s in spelled if all(c == _WILD or c.isalnum() for w in s for c in w)]  # words are of nothing else
    sets = {frozenset(w.encode() for w in s if _WILD not in w) for s in possible}
    common = frozenset.intersection(*sets)
    return (common,) if common else tuple(sorted(sets, key=sorted))


def _rule(priority: int, label: str, pattern: str) -> Rule:
    return Rule(priority, label, gates_of(pattern), re.compile(rf"(?<= )(?:{pattern})(?= )".encode()))


def all_rules() -> list[Rule]:
    """All rules, strongest first; equal ones in the order above."""
    rules = []
    for line in PATTERNS.strip().splitlines():
        priority, label, pattern = (x.strip() for x in line.split(" | ", 2))
        rules.append(_rule(int(priority), label, pattern))
    for line in IDENTIFIERS.strip().splitlines():
        label, words = (x.strip() for x in line.split(" | "))
        rules.append(_rule(TAG, label, rf"spdx license identifier {words}(?: only| or later)?"))
        rules.append(_rule(NAME + 5, label, rf"license(?:d under)?(?: the)? {words}(?: only| or later)?"))
    return sorted(rules, key=lambda r: -r.priority)
