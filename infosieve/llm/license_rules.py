"""Signature rules of the licence scan: ``label | priority | keyword | pattern`` per line.

Patterns run over normalised text: words of letters and digits joined by single blanks, so
``Version 2.0`` reads ``version 2 0``.  A rule is tried only where its keyword, which every
match of its pattern holds, occurs.
Priorities: 5 identifier or full name with version, 4 full name or characteristic grant
text, 3 short name with a licence word, 2 generic licence phrase, 1 weak hint.
"""

from __future__ import annotations

HAND_WRITTEN = r"""
apache-2.0 | 5 | licen | apache licen[cs]e,? (?:v|ver|version )?2(?: 0)?
apache-2.0 | 5 | licen | apache software licen[cs]e (?:v|version )?2(?: 0)?
apache-2.0 | 5 | licen | licen[cs]ed under (?:the )?apache (?:v|version )?2(?: 0)?
apache-2.0 | 4 | licen | you may not use this file except in compliance with the licen[cs]e
apache-2.0 | 4 | licen | apache org licen[cs]es licen[cs]e 2 0
apache-2.0 | 5 | spdx | spdx licen[cs]e identifier apache 2 0
apache-1.1 | 5 | licen | apache (?:software )?licen[cs]e (?:v|version )?1 1
apache-1.0 | 5 | licen | apache (?:software )?licen[cs]e (?:v|version )?1 0
apache | 3 | licen | apache (?:software )?licen[cs]e
apache | 2 | licen | apache style licen[cs]e
mit | 5 | spdx | spdx licen[cs]e identifier mit
mit | 4 | licen | (?:the )?mit licen[cs]e
mit | 4 | licen | mit x11 licen[cs]e
mit | 4 | licen | expat licen[cs]e
mit | 4 | permission | permission is hereby granted free of charge to any person obtaining a copy
mit | 4 | warrant | the software is provided as is without warranty of any kind express or implied
mit | 3 | licen | licen[cs]ed under (?:the )?(?:terms of (?:the )?)?mit
mit | 2 | licen | mit style licen[cs]e
mit-0 | 5 | attribution | mit no attribution(?: licen[cs]e)?
mit-0 | 5 | spdx | spdx licen[cs]e identifier mit 0
x11 | 4 | licen | x11 licen[cs]e
x11 | 4 | licen | x consortium licen[cs]e
bsd-2-clause | 5 | spdx | spdx licen[cs]e identifier bsd 2 clause
bsd-2-clause | 5 | licen | (?:simplified|2 clause|two clause) bsd licen[cs]e
bsd-2-clause | 5 | clause | bsd 2 clause(?: simplified)?(?: licen[cs]e)?
bsd-2-clause | 5 | licen | freebsd licen[cs]e
bsd-3-clause | 5 | spdx | spdx licen[cs]e identifier bsd 3 clause
bsd-3-clause | 5 | licen | (?:new|modified|revised|3 clause|three clause) bsd licen[cs]e
bsd-3-clause | 5 | clause | bsd 3 clause(?: new)?(?: licen[cs]e)?
bsd-3-clause | 4 | permission | may be used to endorse or promote products derived from this software without specific prior written permission
bsd-4-clause | 5 | licen | (?:original|old|4 clause|four clause) bsd licen[cs]e
bsd-4-clause | 5 | clause | bsd 4 clause(?: licen[cs]e)?
bsd-0-clause | 5 | clause | (?:zero clause|0 clause) bsd(?: licen[cs]e)?
bsd | 4 | redistribut | redistributions? (?:and use )?in source and binary forms with or without modification are permitted
bsd | 4 | redistribut | redistributions of source code must retain the above copyright notice
bsd | 4 | redistribut | redistributions in binary form must reproduce the above copyright notice
bsd | 3 | licen | (?:the )?bsd licen[cs]e
bsd | 3 | licen | licen[cs]ed under (?:the )?(?:terms of (?:the )?)?bsd
bsd | 2 | licen | bsd style licen[cs]e
isc | 5 | spdx | spdx licen[cs]e identifier isc
isc | 4 | licen | isc licen[cs]e
isc | 4 | licen | internet systems consortium licen[cs]e
isc | 4 | permission | permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted
ncsa | 4 | licen | university of illinois ncsa open source licen[cs]e
ncsa | 4 | licen | ncsa open source licen[cs]e
zlib | 5 | spdx | spdx licen[cs]e identifier zlib
zlib | 4 | licen | zlib(?: libpng)? licen[cs]e
zlib | 4 | warrant | this software is provided as is without any express or implied warranty
libpng | 4 | licen | libpng licen[cs]e(?: version 2)?
bsl-1.0 | 5 | licen | boost software licen[cs]e(?: version 1 0)?
bsl-1.0 | 5 | spdx | spdx licen[cs]e identifier bsl 1 0
unlicense | 5 | licen | (?:the )?unlicense
unlicense | 4 | domain | this is free and unencumbered software released into the public domain
wtfpl | 5 | licen | do what the fuck you want to public licen[cs]e
wtfpl | 4 | licen | wtfpl licen[cs]e
gpl-1.0 | 5 | licen | (?:gnu )?general public licen[cs]e (?:as published by the free software foundation )?(?:either )?(?:v|version )1(?: 0)?
gpl-2.0 | 5 | licen | (?:gnu )?general public licen[cs]e (?:as published by the free software foundation )?(?:either )?(?:v|version )2(?: 0)?
gpl-3.0 | 5 | licen | (?:gnu )?general public licen[cs]e (?:as published by the free software foundation )?(?:either )?(?:v|version )3(?: 0)?
gpl-2.0 | 5 | gpl | (?:gnu )?gpl ?(?:v|version )?2(?: 0)?(?: only| or later)?
gpl-3.0 | 5 | gpl | (?:gnu )?gpl ?(?:v|version )?3(?: 0)?(?: only| or later)?
gpl-2.0 | 5 | gpl | gplv2
gpl-3.0 | 5 | gpl | gplv3
gpl-2.0 | 5 | spdx | spdx licen[cs]e identifier gpl 2 0(?: only| or later)?
gpl-3.0 | 5 | spdx | spdx licen[cs]e identifier gpl 3 0(?: only| or later)?
gpl | 4 | licen | gnu general public licen[cs]e
gpl | 3 | licen | general public licen[cs]e
gpl | 3 | gpl | gnu gpl
gpl | 3 | gpl | gpl licen[cs]e
gpl | 3 | gpl | (?:licen[cs]ed|released|distributed) under (?:the )?(?:terms of (?:the )?)?gpl
gpl | 4 | redistribut | you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e
lgpl-2.0 | 5 | licen | gnu library general public licen[cs]e(?: version 2(?: 0)?)?
lgpl-2.1 | 5 | licen | (?:gnu )?lesser general public licen[cs]e (?:as published by the free software foundation )?(?:either )?(?:v|version )2 1
lgpl-3.0 | 5 | licen | (?:gnu )?lesser general public licen[cs]e (?:as published by the free software foundation )?(?:either )?(?:v|version )3(?: 0)?
lgpl-2.1 | 5 | gpl | lgpl ?(?:v|version )?2 1(?: only| or later)?
lgpl-3.0 | 5 | gpl | lgpl ?(?:v|version )?3(?: 0)?(?: only| or later)?
lgpl-2.1 | 5 | gpl | lgplv2 1
lgpl-3.0 | 5 | gpl | lgplv3
lgpl | 4 | licen | (?:gnu )?lesser general public licen[cs]e
lgpl | 3 | gpl | (?:gnu )?lgpl(?: licen[cs]e)?
agpl-3.0 | 5 | licen | (?:gnu )?affero general public licen[cs]e (?:either )?(?:v|version )3(?: 0)?
agpl-3.0 | 5 | gpl | agpl ?(?:v|version )?3(?: 0)?(?: only| or later)?
agpl-3.0 | 5 | gpl | agplv3
agpl | 4 | licen | (?:gnu )?affero general public licen[cs]e
agpl | 3 | gpl | (?:gnu )?agpl(?: licen[cs]e)?
gfdl-1.1 | 5 | licen | gnu free documentation licen[cs]e (?:v|version )1 1
gfdl-1.2 | 5 | licen | gnu free documentation licen[cs]e (?:v|version )1 2
gfdl-1.3 | 5 | licen | gnu free documentation licen[cs]e (?:v|version )1 3
gfdl | 4 | licen | (?:gnu )?free documentation licen[cs]e
gfdl | 3 | licen | gfdl licen[cs]e
mpl-1.0 | 5 | licen | mozilla public licen[cs]e (?:v|version )?1 0
mpl-1.1 | 5 | licen | mozilla public licen[cs]e (?:v|version )?1 1
mpl-2.0 | 5 | licen | mozilla public licen[cs]e (?:v|version )?2(?: 0)?
mpl-2.0 | 5 | spdx | spdx licen[cs]e identifier mpl 2 0
mpl-2.0 | 4 | licen | this source code form is subject to the terms of the mozilla public licen[cs]e
mpl | 4 | licen | mozilla public licen[cs]e
npl | 4 | licen | netscape public licen[cs]e
epl-1.0 | 5 | licen | eclipse public licen[cs]e (?:v|version )?1(?: 0)?
epl-2.0 | 5 | licen | eclipse public licen[cs]e (?:v|version )?2(?: 0)?
epl-1.0 | 5 | spdx | spdx licen[cs]e identifier epl 1 0
epl-2.0 | 5 | spdx | spdx licen[cs]e identifier epl 2 0
epl | 4 | licen | eclipse public licen[cs]e
edl | 4 | licen | eclipse distribution licen[cs]e
cddl-1.0 | 5 | licen | common development and distribution licen[cs]e (?:v|version )?1 0
cddl-1.1 | 5 | licen | common development and distribution licen[cs]e (?:v|version )?1 1
cddl | 4 | licen | common development and distribution licen[cs]e
cpl-1.0 | 5 | licen | common public licen[cs]e (?:v|version )?1 0
cpl | 4 | licen | common public licen[cs]e
ipl | 4 | licen | ibm public licen[cs]e
eupl-1.1 | 5 | licen | european union public licen[cs]e (?:v|version )?1 1
eupl-1.2 | 5 | licen | european union public licen[cs]e (?:v|version )?1 2
eupl | 4 | licen | european union public licen[cs]e
osl-3.0 | 5 | licen | open software licen[cs]e (?:v|version )?3 0
osl | 4 | licen | open software licen[cs]e
afl-3.0 | 5 | licen | academic free licen[cs]e (?:v|version )?3 0
afl | 4 | licen | academic free licen[cs]e
ecl-2.0 | 5 | licen | educational community licen[cs]e(?: version 2 0)?
artistic-1.0 | 5 | licen | artistic licen[cs]e (?:v|version )?1(?: 0)?
artistic-2.0 | 5 | licen | artistic licen[cs]e (?:v|version )?2(?: 0)?
artistic | 4 | licen | (?:perl )?artistic licen[cs]e
perl | 3 | perl | (?:under )?the same terms as perl(?: itself)?(?: licen[cs]e)?
psf | 4 | licen | python software foundation licen[cs]e
psf | 4 | licen | psf licen[cs]e(?: agreement)?
php-3.01 | 5 | licen | php licen[cs]e (?:v|version )?3 01
php | 4 | licen | php licen[cs]e
ruby | 4 | licen | ruby licen[cs]e
zpl | 4 | licen | zope public licen[cs]e
postgresql | 4 | licen | postgresql licen[cs]e
openssl | 4 | licen | openssl licen[cs]e
ssleay | 4 | licen | ssleay licen[cs]e
sleepycat | 4 | licen | sleepycat licen[cs]e
vim | 4 | licen | vim licen[cs]e
curl | 4 | licen | curl licen[cs]e
icu | 4 | licen | icu licen[cs]e
unicode | 4 | licen | unicode licen[cs]e agreement
w3c | 4 | licen | w3c software (?:notice and )?licen[cs]e
json | 4 | licen | json licen[cs]e
beerware | 4 | licen | beer ?ware licen[cs]e
ms-pl | 4 | licen | microsoft public licen[cs]e
ms-rl | 4 | licen | microsoft reciprocal licen[cs]e
qpl | 4 | licen | q public licen[cs]e
apsl | 4 | licen | apple public source licen[cs]e
intel | 4 | licen | intel open source licen[cs]e
sspl-1.0 | 4 | licen | server side public licen[cs]e
elastic-2.0 | 4 | licen | elastic licen[cs]e(?: 2 0)?
busl-1.1 | 4 | licen | business source licen[cs]e(?: 1 1)?
polyform | 4 | licen | polyform (?:noncommercial|shield|strict|small business|perimeter) licen[cs]e
commons-clause | 4 | licen | commons clause licen[cs]e condition
ofl-1.1 | 5 | licen | sil open font licen[cs]e(?: (?:v|version )?1 1)?
ofl | 4 | licen | open font licen[cs]e
odbl-1.0 | 5 | licen | open (?:data commons open )?database licen[cs]e
odc-by-1.0 | 5 | licen | open data commons attribution licen[cs]e
pddl-1.0 | 5 | domain | public domain dedication and licen[cs]e
ogl | 4 | licen | open government licen[cs]e(?: v?(?:ersion )?[123] 0)?
cdla-permissive | 5 | licen | community data licen[cs]e agreement permissive
cdla-sharing | 5 | licen | community data licen[cs]e agreement sharing
openrail | 4 | licen | (?:creativeml )?open ?rail(?: m)? licen[cs]e
llama | 4 | licen | llama (?:[23] )?community licen[cs]e(?: agreement)?
fal-1.3 | 4 | licen | free art licen[cs]e
dsl | 4 | licen | design science licen[cs]e
opl | 4 | licen | open publication licen[cs]e
cecill | 4 | licen | cecill (?:[abc] )?(?:free software )?licen[cs]e
mulan-2.0 | 4 | licen | mulan permissive software licen[cs]e
upl-1.0 | 4 | licen | universal permissive licen[cs]e
nasa | 4 | licen | nasa open source agreement licen[cs]e
rpl | 4 | licen | reciprocal public licen[cs]e
sgi-b | 4 | licen | sgi free software licen[cs]e
lppl | 4 | licen | latex project public licen[cs]e
watcom | 4 | licen | sybase open watcom public licen[cs]e
cc0-1.0 | 5 | cc | cc0(?: 1 0)?(?: universal)?
cc0-1.0 | 5 | creative | creative commons (?:cc0|zero|public domain dedication)(?: 1 0)?(?: universal)?
cc0-1.0 | 5 | spdx | spdx licen[cs]e identifier cc0 1 0
cc-pdm | 4 | domain | public domain mark(?: 1 0)?
cc-by | 4 | creative | creative commons attribution(?: licen[cs]e)?
cc-by-sa | 4 | creative | creative commons attribution share ?alike(?: licen[cs]e)?
cc-by-nc | 4 | creative | creative commons attribution non ?commercial(?: licen[cs]e)?
cc-by-nd | 4 | creative | creative commons attribution no ?deriv(?:ative)?s?(?: works?)?(?: licen[cs]e)?
cc-by-nc-sa | 4 | creative | creative commons attribution non ?commercial share ?alike(?: licen[cs]e)?
cc-by-nc-nd | 4 | creative | creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works?)?(?: licen[cs]e)?
creative-commons | 2 | creative | creative commons(?: licen[cs]e)?
public-domain | 4 | domain | (?:released|placed|dedicated) (?:in|into|to) the public domain
public-domain | 3 | domain | (?:is|are) in the public domain
public-domain | 2 | domain | public domain
reserved | 3 | rights | all rights reserved
reserved | 3 | vorbehalten | alle rechte vorbehalten
reserved | 2 | reproduced | no part of this (?:publication|work|book|document) may be reproduced
reserved | 2 | permission | may not be reproduced (?:or distributed )?without (?:prior )?(?:written )?permission
copyright | 2 | copyright | copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?
copyright | 1 | copyright | copyright (?:c|notice|holder|owner)
copyleft | 2 | copyleft | copyleft
fair-use | 2 | copyright | fair use (?:under|of) (?:the )?copyright(?:ed)?
proprietary | 3 | licen | proprietary (?:software )?licen[cs]e
proprietary | 3 | licen | end user licen[cs]e agreement
proprietary | 3 | rights | proprietary rights
proprietary | 2 | licen | licen[cs]e agreement
commercial | 3 | licen | commercial licen[cs]e
non-commercial | 3 | licen | non ?commercial (?:use )?licen[cs]e
dual | 2 | licen | dual licen[cs]ed?
patent-grant | 2 | patent | patent (?:licen[cs]e|grant)
warranty-disclaimer | 1 | warrant | without warranty of any kind
warranty-disclaimer | 1 | warrant | implied warrant(?:y|ies) of merchantability
as-is | 1 | warrant | provided as is without (?:any )?warranty
open-source | 2 | licen | open source licen[cs]e
licensed | 1 | licen | licen[cs]ed under
licensed | 1 | licen | licen[cs]e (?:version|v) [0-9]
spdx | 2 | spdx | spdx licen[cs]e identifier
"""

#: Creative Commons kinds: words as written in short and in long form.
CC_KINDS = {"by": "attribution", "by sa": "attribution share ?alike", "by nc": "attribution non ?commercial",
            "by nd": "attribution no ?deriv(?:ative)?s?", "by nc sa": "attribution non ?commercial share ?alike",
            "by nc nd": "attribution non ?commercial no ?deriv(?:ative)?s?"}
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")


def _creative_commons() -> list[tuple[str, int, str, str]]:
    rules = []
    for short, long in CC_KINDS.items():
        label = "cc-" + short.replace(" ", "-")
        rules.append((label, 3, "cc", f"cc {short}"))
        for version in CC_VERSIONS:
            own = f"{label}-{version.replace(' ', '.')}"
            rules.append((own, 5, "cc", f"cc {short} (?:v|version )?{version}"))
            rules.append((own, 5, "creative", f"creative commons {long} (?:licen[cs]e )?(?:v|version )?{version}"
                                              "(?: international| unported| generic)?(?: licen[cs]e)?"))
    return rules


def rules() -> list[tuple[str, int, str, str]]:
    """``(label, priority, keyword, pattern)`` of every rule, in the order of the tables."""
    listed = []
    for line in HAND_WRITTEN.strip().splitlines():
        label, priority, keyword, pattern = (x.strip() for x in line.split(" | ", 3))
        listed.append((label, int(priority), keyword, pattern))
    return listed + _creative_commons()


def _stems() -> tuple[str, ...]:
    """The rules' keywords without those that contain another one."""
    words = {keyword for _, _, keyword, _ in rules()}
    return tuple(sorted(w for w in words if not any(x != w and x in w for x in words)))


#: Any rule's keyword contains one of these; texts without all of them are not scanned.
STEMS = _stems()

#: Base phrases and their labels, fixed by the contract of the query.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
