"""The signature rules of the license scan, written over a text's words (lower-case, single-spaced).

Every form names all words that can gate it: where none of its keywords is a word of the
text, the form cannot match.
"""

from __future__ import annotations

#: Phrases that always count, whatever else is found, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Label | keywords | how running text names the license.
NAMES = r"""
apache-1.1 | apache | apache (?:software )?license (?:version |v)?1 1
apache-2.0 | apache | apache(?: software)? license (?:version |v)?2(?: 0)?
apache | apache | apache(?: software)? license
mit | mit | mit(?: x11)? licen[cs]e
mit | expat | expat licen[cs]e
mit | x11 | x11 licen[cs]e
isc | isc | isc licen[cs]e
bsd-2-clause | bsd freebsd | (?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)(?: licen[cs]e)?
bsd-3-clause | bsd | (?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)(?: licen[cs]e)?
bsd-4-clause | bsd | (?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd)(?: licen[cs]e)?
0bsd | 0bsd bsd | (?:0bsd|zero clause bsd)(?: licen[cs]e)?
bsd | bsd | bsd(?: style| like| type)? licen[cs]e
gpl-1.0 | general | gnu general public licen[cs]e (?:version |v)?1(?: 0)?
gpl-2.0 | general | (?:gnu )?general public licen[cs]e (?:version |v)?2(?: 0)?
gpl-3.0 | general | (?:gnu )?general public licen[cs]e (?:version |v)?3(?: 0)?
gpl-1.0 | gpl gplv1 gpl1 | (?:gpl (?:v |version )?1|gplv1|gpl1)(?: 0)?
gpl-2.0 | gpl gplv2 gpl2 | (?:gpl (?:v |version )?2|gpl v2|gplv2|gpl2)(?: 0)?
gpl-3.0 | gpl gplv3 gpl3 | (?:gpl (?:v |version )?3|gpl v3|gplv3|gpl3)(?: 0)?
gpl | gpl | gnu gpl
lgpl-2.0 | library | (?:gnu )?library general public licen[cs]e (?:version |v)?2(?: 0)?
lgpl-2.1 | lesser | (?:gnu )?lesser general public licen[cs]e (?:version |v)?2(?: 1)?
lgpl-3.0 | lesser | (?:gnu )?lesser general public licen[cs]e (?:version |v)?3(?: 0)?
lgpl-2.1 | lgpl lgplv2 | (?:lgpl (?:v |version )?2|lgpl v2|lgplv2)(?: 1)?
lgpl-3.0 | lgpl lgplv3 | (?:lgpl (?:v |version )?3|lgpl v3|lgplv3)(?: 0)?
lgpl | lesser | (?:gnu )?lesser general public licen[cs]e
lgpl | library | (?:gnu )?library general public licen[cs]e
lgpl | lgpl | gnu lgpl
agpl-3.0 | affero | (?:gnu )?affero general public licen[cs]e (?:version |v)?3(?: 0)?
agpl-3.0 | agpl agplv3 | (?:agpl (?:v |version )?3|agpl v3|agplv3)(?: 0)?
agpl | affero | (?:gnu )?affero general public licen[cs]e
gfdl | documentation | (?:gnu )?free documentation licen[cs]e
gfdl | gfdl fdl | (?:gfdl|gnu fdl)
mpl-1.1 | mozilla | mozilla public licen[cs]e (?:version |v)?1(?: 1)?
mpl-2.0 | mozilla | mozilla public licen[cs]e (?:version |v)?2(?: 0)?
mpl-2.0 | mpl mplv2 | (?:mpl (?:v |version )?2|mpl v2|mplv2)(?: 0)?
mpl | mozilla | mozilla public licen[cs]e
epl-1.0 | eclipse | eclipse public licen[cs]e (?:version |v)?1(?: 0)?
epl-2.0 | eclipse | eclipse public licen[cs]e (?:version |v)?2(?: 0)?
epl | eclipse | eclipse public licen[cs]e
edl-1.0 | eclipse | eclipse distribution licen[cs]e(?: (?:version |v)?1(?: 0)?)?
eupl | european | european union public licen[cs]e(?: (?:version |v)?1 [12])?
eupl | eupl | eupl(?: (?:version |v)?1 [12])?
cddl | cddl | cddl(?: 1 [01])?
cddl | distribution | common development and distribution licen[cs]e
cpl-1.0 | common | common public licen[cs]e(?: (?:version |v)?1(?: 0)?)?
ibm-pl | ibm | ibm public licen[cs]e
artistic-1.0 | artistic | artistic licen[cs]e (?:version |v)?1(?: 0)?
artistic-2.0 | artistic | artistic licen[cs]e(?: (?:version |v)?2(?: 0)?)?
perl | perl | same terms as perl(?: itself)?
zlib | zlib | zlib(?: libpng)? licen[cs]e
libpng | libpng | libpng licen[cs]e
bsl-1.0 | boost | boost software licen[cs]e(?: (?:version |v)?1(?: 0)?)?
ms-pl | microsoft | microsoft public licen[cs]e
ms-rl | microsoft | microsoft reciprocal licen[cs]e
psf-2.0 | python | python(?: software foundation)? licen[cs]e(?: (?:version |v)?2(?: 0)?)?
php | php | php licen[cs]e(?: (?:version |v)?3(?: 0[01]?)?)?
ruby | ruby | ruby licen[cs]e
postgresql | postgresql | postgresql licen[cs]e
openssl | openssl | openssl licen[cs]e
openldap | openldap | openldap public licen[cs]e
curl | curl | curl licen[cs]e
ncsa | illinois | university of illinois(?: ncsa)? open source licen[cs]e
afl-3.0 | academic | academic free licen[cs]e(?: (?:version |v)?[23](?: [01])?)?
osl-3.0 | open | open software licen[cs]e(?: (?:version |v)?[123](?: [01])?)?
cecill | cecill | cecill(?: b| c)?(?: licen[cs]e)?
w3c | w3c | w3c software(?: notice and)? licen[cs]e
wtfpl | wtfpl | wtfpl
wtfpl | want | do what the f[a-z]+ you want to public licen[cs]e
beerware | beerware beer | (?:beerware|beer ware) licen[cs]e
unlicense | unlicense | (?:the )?unlicense
cc0-1.0 | cc0 | cc0(?: 1 0)?(?: universal)?
cc-by-4.0 | cc | cc by (?:4 0|4)
cc-by-3.0 | cc | cc by (?:3 0|3)
cc-by-2.0 | cc | cc by (?:2 [05]|2)
cc-by-sa | cc | cc by sa(?: [1-4] [05])?
cc-by-nc | cc | cc by nc(?: [1-4] [05])?
cc-by-nd | cc | cc by nd(?: [1-4] [05])?
cc-by-nc-sa | cc | cc by nc sa(?: [1-4] [05])?
cc-by-nc-nd | cc | cc by nc nd(?: [1-4] [05])?
cc-by | creative | creative commons attribution(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[cs]e)?
cc-by-sa | creative | creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported)?
cc-by-nc | creative | creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported)?
cc-by-nd | creative | creative commons attribution no ?deriv(?:s|atives)(?: [1-4] [05])?
cc-by-nc-sa | creative | creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported)?
cc-by-nc-nd | creative | creative commons attribution non ?commercial no ?deriv(?:s|atives)(?: [1-4] [05])?
creative-commons | creative | creative commons(?: licen[cs]e)?
odbl | database | open (?:data commons )?(?:open )?database licen[cs]e
odbl | odbl | odbl(?: 1 0)?
odc-by | commons | open data commons attribution licen[cs]e
pddl | dedication | public domain dedication and licen[cs]e
ofl-1.1 | font | (?:sil )?open font licen[cs]e(?: (?:version |v)?1(?: 1)?)?
ogl | government | open government licen[cs]e(?: (?:version |v)?[123](?: 0)?)?
public-domain | domain | public domain
busl-1.1 | business | business source licen[cs]e(?: (?:version |v)?1(?: 1)?)?
sspl-1.0 | server | server side public licen[cs]e(?: (?:version |v)?1)?
elastic-2.0 | elastic | elastic licen[cs]e(?: (?:version |v)?2(?: 0)?)?
openrail | openrail rail | (?:open ?rail(?: m)?) licen[cs]e
proprietary | proprietary | proprietary and confidential
"""

#: How a notice brings a name in (priority: lower wins), with the confidence it deserves.
NOTICES = [
    (20, 0.97, r"(?:is |are )?(?:dual )?(?:licen[cs]ed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?{name}(?: licen[cs]e)?(?: or (?:any )?later(?: version)?)?"),
    (30, 0.95, r"(?:subject to|in accordance with|according to|governed by) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?{name}"),
    (40, 0.9, r"(?:see|read|copy of) (?:the )?{name}"),
    (50, 0.85, r"under (?:the )?(?:terms of )?(?:the )?{name}"),
    (60, 0.7, r"{name}"),
]

#: Registered short identifiers; as words, "Apache-2.0" reads "apache 2 0".
IDENTIFIERS = """
0BSD AFL-2.1 AFL-3.0 AGPL-1.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.0 Apache-1.1 Apache-2.0 APSL-2.0 Artistic-1.0 Artistic-2.0
BlueOak-1.0.0 BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause BSL-1.0 BUSL-1.1 bzip2-1.0.6
CC-BY-1.0 CC-BY-2.0 CC-BY-2.5 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-2.0 CC-BY-NC-3.0 CC-BY-NC-4.0 CC-BY-NC-ND-3.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-3.0 CC-BY-NC-SA-4.0
CC-BY-ND-3.0 CC-BY-ND-4.0 CC-BY-SA-2.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1 CDLA-Permissive-2.0 CECILL-2.1 CECILL-B CECILL-C CPAL-1.0 CPL-1.0
curl ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 FTL GFDL-1.2 GFDL-1.3 GPL-1.0 GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later
HPND ICU IJG IPL-1.0 ISC JSON LGPL-2.0 LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later Libpng LPPL-1.3c
MIT MIT-0 MPL-1.0 MPL-1.1 MPL-2.0 MS-PL MS-RL MulanPSL-2.0 NCSA NPL-1.1 ODbL-1.0 ODC-By-1.0 OFL-1.1 OLDAP-2.8 OpenSSL OSL-3.0 PDDL-1.0 PHP-3.01 PostgreSQL PSF-2.0
Python-2.0 QPL-1.0 Ruby SISSL Sleepycat SSPL-1.0 TCL Unicode-DFS-2016 Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1
"""

#: Where an identifier stands.
IDENTIFIER_NOTICES = [
    (10, 0.99, r"spdx license identifier {name}"),
    (18, 0.96, r"(?:licen[cs]ed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?{name}"),
    (42, 0.85, r"licen[cs]es? (?:type )?(?:is )?{name}"),
    (44, 0.85, r"{name} licen[cs]ed"),
]

#: Priority | confidence | label | keywords | clauses of license texts and reservations.
CLAUSES = r"""
15 | 0.98 | mit | charge | permission is hereby granted free of charge to any person obtaining a copy
16 | 0.95 | mit | deal | to deal in the software without restriction including without limitation
16 | 0.93 | mit | substantial | (?:the )?above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
16 | 0.9 | mit | noninfringement | warranties of merchantability fitness for a particular purpose and noninfringement
15 | 0.97 | isc | fee | permission to use copy modify and or distribute this software for any purpose with or without fee
15 | 0.9 | hpnd | fee | permission to use copy modify (?:and )?distribute (?:and sell )?this software and its documentation for any purpose (?:is hereby granted )?without fee
15 | 0.97 | bsd | redistribution | redistribution and use in source and binary forms with or without modification are permitted
16 | 0.93 | bsd | redistributions | redistributions of source code must retain the above copyright notice
16 | 0.93 | bsd | redistributions | redistributions in binary form must reproduce the above copyright notice
16 | 0.95 | bsd-3-clause | endorse | neither the name of (?:[^ ]+ ){1,8}nor the names of (?:its|the) contributors may be used to endorse
16 | 0.95 | bsd-4-clause | advertising | all advertising materials mentioning features or use of this software must display
17 | 0.8 | bsd | contributors | in no event shall (?:the )?copyright (?:holders|owner) or contributors be liable
15 | 0.96 | apache-2.0 | apache | licensed under the apache license version 2 0 the license you may not use this file except in compliance
16 | 0.9 | apache-2.0 | compliance | you may not use this file except in compliance with the license
16 | 0.95 | apache-2.0 | apache | you may obtain a copy of the license at (?:https? )?(?:www )?apache org licenses license 2 0
17 | 0.8 | apache-2.0 | basis | distributed on an as is basis without warranties or conditions of any kind
17 | 0.85 | apache-1.1 | apache | this product includes software developed by the apache software foundation
15 | 0.95 | gpl | redistribute | you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e
15 | 0.96 | lgpl | redistribute | you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e
15 | 0.96 | agpl | redistribute | you can redistribute it and or modify it under the terms of the gnu affero general public licen[cs]e
16 | 0.93 | gpl-2.0-or-later | option | either version 2 (?:of the license )?or at your option any later version
16 | 0.93 | gpl-3.0-or-later | option | either version 3 (?:of the license )?or at your option any later version
17 | 0.9 | gpl | received | you should have received a copy of the gnu general public licen[cs]e
17 | 0.9 | lgpl | received | you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e
17 | 0.9 | agpl | received | you should have received a copy of the gnu affero general public licen[cs]e
18 | 0.85 | gpl | hope | (?:is )?distributed in the hope that it will be useful but without any warranty
18 | 0.85 | gpl | copyleft | copyleft licen[cs]e(?: for software)?
18 | 0.85 | gpl | free | free software foundation inc
18 | 0.8 | agpl | remote | remote network interaction
18 | 0.85 | gfdl | invariant | with no invariant sections no front cover texts and no back cover texts
15 | 0.95 | mpl-2.0 | mozilla | this source code form is subject to the terms of the mozilla public licen[cs]e
15 | 0.95 | mpl-1.1 | mozilla | the contents of this file are subject to the mozilla public licen[cs]e version 1 1
16 | 0.92 | epl | eclipse | this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e
16 | 0.9 | cddl | common | subject to the terms of the common development and distribution licen[cs]e
15 | 0.97 | unlicense | unencumbered | free and unencumbered software released into the public domain
16 | 0.93 | unlicense | dedicate | dedicate any and all copyright interest in the software to the public domain
16 | 0.92 | zlib | altered | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
16 | 0.92 | zlib | misrepresented | the origin of this software must not be misrepresented
16 | 0.9 | zlib | implied | this software is provided as is without any express or implied warranty
15 | 0.95 | bsl-1.0 | boost | distributed under the boost software licen[cs]e version 1 0
15 | 0.93 | bsl-1.0 | obtaining | permission is hereby granted free of charge to any person or organization obtaining a copy
15 | 0.95 | cc0-1.0 | waived | (?:has|have) waived all copyright and related or neighboring rights
16 | 0.9 | cc0-1.0 | universal | cc0 1 0 universal public domain dedication
16 | 0.9 | public-domain | dedicated | (?:is |are |hereby )?dedicated to the public domain
16 | 0.9 | public-domain | placed | (?:has been |is |was )?placed in the public domain
17 | 0.85 | cc-by | credit | you must give appropriate credit provide a link to the license and indicate if changes were made
17 | 0.85 | cc-by-sa | contributions | you must distribute your contributions under the same license as the original
17 | 0.85 | cc-by-nc | commercial | you may not use the material for commercial purposes
17 | 0.85 | cc-by-nd | remix | if you remix transform or build upon the material you may not distribute the modified material
17 | 0.85 | creative-commons | creativecommons | creativecommons org licenses
17 | 0.9 | cc-by | creativecommons | creativecommons org licenses by
17 | 0.92 | cc-by-4.0 | creativecommons | creativecommons org licenses by 4 0
17 | 0.9 | cc-by-sa | creativecommons | creativecommons org licenses by sa
17 | 0.9 | cc-by-nc | creativecommons | creativecommons org licenses by nc
17 | 0.9 | cc-by-nd | creativecommons | creativecommons org licenses by nd
17 | 0.9 | cc0-1.0 | creativecommons | creativecommons org publicdomain zero 1 0
17 | 0.85 | gpl | gnu | (?:www )?gnu org licenses gpl
17 | 0.85 | lgpl | gnu | (?:www )?gnu org licenses lgpl
17 | 0.85 | agpl | gnu | (?:www )?gnu org licenses agpl
17 | 0.85 | mit | opensource | opensource org licenses mit
17 | 0.85 | bsd | opensource | opensource org licenses bsd
17 | 0.85 | isc | opensource | opensource org licenses isc
17 | 0.85 | mpl-2.0 | mozilla | mozilla org mpl 2 0
17 | 0.85 | ofl-1.1 | scripts | scripts sil org ofl
16 | 0.9 | ofl-1.1 | reserved | with reserved font name
16 | 0.9 | beerware | beer | if we meet some day and you think this stuff is worth it you can buy me a beer
16 | 0.9 | json | evil | the software shall be used for good not evil
16 | 0.9 | openssl | openssl | this product includes software developed by the openssl project
16 | 0.85 | ijg | jpeg | this software is based in part on the work of the independent jpeg group
16 | 0.85 | ftl | freetype | portions of this software are copyright (?:c )?(?:[0-9]{4} )?the freetype project
16 | 0.85 | psf-2.0 | python | python software foundation all rights reserved
17 | 0.8 | unicode | unicode | copyright (?:c )?(?:[0-9]{4} (?:[0-9]{4} )?)?unicode inc
18 | 0.8 | busl-1.1 | change | on the change date (?:[^ ]+ ){0,8}change license
18 | 0.8 | sspl-1.0 | service | making the program available as a service
35 | 0.8 | reserved | reserved | (?:copyright (?:c )?(?:[0-9]{4} )?(?:[^ ]+ ){0,6})?all rights reserved
55 | 0.7 | reserved | reserved | some rights reserved
54 | 0.7 | reserved | reserved | (?:all )?other rights reserved
54 | 0.7 | reserved | vorbehalten | alle rechte vorbehalten
54 | 0.7 | reserved | réservés | tous droits réservés
54 | 0.7 | reserved | reservados | todos los derechos reservados
45 | 0.6 | warranty-disclaimer | warranty | (?:the software is )?provided as is without warranty of any kind
46 | 0.5 | warranty-disclaimer | warranties | without warranties of any kind
46 | 0.5 | warranty-disclaimer | merchantability | (?:implied )?warrant(?:y|ies) of merchantability
46 | 0.5 | warranty-disclaimer | risk | use (?:it )?at your own risk
46 | 0.5 | liability-disclaimer | liable | in no event shall (?:[^ ]+ ){1,8}be liable
70 | 0.5 | copyright | copyright | copyright (?:c )?[0-9]{4}
70 | 0.5 | copyright | copr | copr [0-9]{4}
71 | 0.4 | copyright | c | c [0-9]{4}(?: [0-9]{4})? by
75 | 0.3 | copyright | copyright | copyright
65 | 0.75 | gpl | general | general public licen[cs]e
65 | 0.75 | cc-by | cc | cc by
66 | 0.6 | mit | mit | mit licensed
66 | 0.6 | bsd | bsd | bsd licensed
66 | 0.6 | gpl | gpl gpled | (?:gpl licensed|gpled)
66 | 0.6 | dual | dual | dual licen[cs]ed
68 | 0.5 | open-source | source | open source licen[cs]e
68 | 0.5 | freeware | freeware | freeware
68 | 0.5 | shareware | shareware | shareware
68 | 0.5 | royalty-free | royalty | royalty free(?: licen[cs]e)?
67 | 0.6 | non-commercial | commercial noncommercial | (?:for )?(?:non commercial|noncommercial) use only
67 | 0.6 | evaluation | evaluation | for evaluation (?:purposes )?only
67 | 0.6 | internal-use | internal | for internal use only
67 | 0.6 | research-only | research | for (?:academic )?research (?:purposes|use) only
67 | 0.6 | educational | educational | for educational (?:purposes|use) only
67 | 0.6 | personal-use | personal | for personal use only
40 | 0.7 | proprietary | confidential | strictly confidential
41 | 0.6 | proprietary | confidential | confidential information of
41 | 0.6 | proprietary | proprietary | proprietary (?:and trade secret )?information of
41 | 0.65 | proprietary | secret secrets | contains (?:confidential (?:information )?and )?trade secrets?
40 | 0.7 | proprietary | unauthorized | unauthorized (?:copying|use|reproduction|distribution)(?: [^ ]+){0,6} (?:is )?(?:strictly )?prohibited
41 | 0.65 | proprietary | written | no part of this (?:[^ ]+ ){1,6}may be (?:reproduced|copied|distributed)(?: [^ ]+){0,12} without (?:the )?prior written permission
41 | 0.65 | eula | end | end user licen[cs]e agreement
41 | 0.6 | eula | eula | eula
42 | 0.6 | terms-of-use | terms | (?:subject to|see|accept) (?:the |our )?terms (?:of (?:use|service)|and conditions)
42 | 0.6 | permission | permission | (?:used|reprinted|reproduced) (?:with|by) (?:the )?(?:kind )?permission
42 | 0.6 | patent | patents patent | (?:protected by|covered by|pending|u s)(?: [^ ]+){0,3} patents?
43 | 0.6 | trademark | trademark trademarks | (?:is|are) (?:a )?(?:registered )?trademarks? of
43 | 0.6 | export | export | subject to (?:the )?(?:u s |us )?export (?:administration|control) (?:regulations|laws)
"""
