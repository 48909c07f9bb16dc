"""Signature rules for licenses, in order of priority: a rule above another wins where their finds are nested.

One rule a line: label, strength (how sure a find is, 0 to 1), pattern. Patterns are written for word text: A-Z in lower
case, words joined by single spaces, all ASCII punctuation gone ("v2.0" reads "v2 0"). A pattern matches whole words.
A named group `v` gives the version that replaces {v} in the label, "x" where there is none. A gap between words is
`(?: [^ ]+){0,n}`, so a find has a bounded length.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: The base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

RULES = r"""
# tags for machines
gpl-{v}-or-later        1.0  spdx license identifier gpl (?P<v>[123] [0-9]) or later
gpl-{v}-only            1.0  spdx license identifier gpl (?P<v>[123] [0-9])(?: only)?
lgpl-{v}-or-later       1.0  spdx license identifier lgpl (?P<v>[23] [01]) or later
lgpl-{v}-only           1.0  spdx license identifier lgpl (?P<v>[23] [01])(?: only)?
agpl-{v}-or-later       1.0  spdx license identifier agpl (?P<v>[13] 0) or later
agpl-{v}-only           1.0  spdx license identifier agpl (?P<v>[13] 0)(?: only)?
gfdl-{v}                1.0  spdx license identifier gfdl (?P<v>1 [123])(?: (?:only|or later))?
apache-{v}              1.0  spdx license identifier apache (?P<v>[12] [01])
mit-0                   1.0  spdx license identifier mit 0
mit                     1.0  spdx license identifier mit
bsd-2-clause-patent     1.0  spdx license identifier bsd 2 clause patent
bsd-2-clause            1.0  spdx license identifier bsd 2 clause
bsd-3-clause-clear      1.0  spdx license identifier bsd 3 clause clear
bsd-3-clause            1.0  spdx license identifier bsd 3 clause
bsd-4-clause            1.0  spdx license identifier bsd 4 clause
0bsd                    1.0  spdx license identifier 0bsd
isc                     1.0  spdx license identifier isc
mpl-{v}                 1.0  spdx license identifier mpl (?P<v>[12] [01])
epl-{v}                 1.0  spdx license identifier epl (?P<v>[12] 0)
cddl-{v}                1.0  spdx license identifier cddl (?P<v>1 [01])
eupl-{v}                1.0  spdx license identifier eupl (?P<v>1 [012])
cecill-{v}              1.0  spdx license identifier cecill (?P<v>[12] [01])
artistic-{v}            1.0  spdx license identifier artistic (?P<v>[12] 0)
zlib                    1.0  spdx license identifier zlib
libpng-2.0              1.0  spdx license identifier libpng 2 0
bsl-1.0                 1.0  spdx license identifier bsl 1 0
busl-1.1                1.0  spdx license identifier busl 1 1
sspl-1.0                1.0  spdx license identifier sspl 1 0
unlicense               1.0  spdx license identifier unlicense
wtfpl                   1.0  spdx license identifier wtfpl
cc0-1.0                 1.0  spdx license identifier cc0 1 0
cc-by-nc-sa-{v}         1.0  spdx license identifier cc by nc sa (?P<v>[1234] [05])
cc-by-nc-nd-{v}         1.0  spdx license identifier cc by nc nd (?P<v>[1234] [05])
cc-by-nc-{v}            1.0  spdx license identifier cc by nc (?P<v>[1234] [05])
cc-by-nd-{v}            1.0  spdx license identifier cc by nd (?P<v>[1234] [05])
cc-by-sa-{v}            1.0  spdx license identifier cc by sa (?P<v>[1234] [05])
cc-by-{v}               1.0  spdx license identifier cc by (?P<v>[1234] [05])
ofl-{v}                 1.0  spdx license identifier ofl (?P<v>1 [01])
odbl-1.0                1.0  spdx license identifier odbl 1 0
pddl-1.0                1.0  spdx license identifier pddl 1 0
psf-2.0                 1.0  spdx license identifier (?:psf|python) 2 0
postgresql              1.0  spdx license identifier postgresql
ms-pl                   1.0  spdx license identifier ms pl
ms-rl                   1.0  spdx license identifier ms rl
ncsa                    1.0  spdx license identifier ncsa
x11                     1.0  spdx license identifier x11
curl                    1.0  spdx license identifier curl
afl-{v}                 1.0  spdx license identifier afl (?P<v>[123] [012])
osl-{v}                 1.0  spdx license identifier osl (?P<v>[123] [01])
blueoak-1.0.0           1.0  spdx license identifier blueoak 1 0 0
mulanpsl-{v}            1.0  spdx license identifier mulanpsl (?P<v>[12] 0)
upl-1.0                 1.0  spdx license identifier upl 1 0
vim                     1.0  spdx license identifier vim
w3c                     1.0  spdx license identifier w3c
zpl-{v}                 1.0  spdx license identifier zpl (?P<v>[12] [01])
elastic-2.0             1.0  spdx license identifier elastic 2 0

# addresses of texts
cc-by-nc-sa-{v}         1.0  creativecommons org licenses by nc sa (?P<v>[1234] [05])
cc-by-nc-nd-{v}         1.0  creativecommons org licenses by nc nd (?P<v>[1234] [05])
cc-by-nd-nc-1.0         1.0  creativecommons org licenses by nd nc 1 0
cc-by-nc-{v}            1.0  creativecommons org licenses by nc (?P<v>[1234] [05])
cc-by-nd-{v}            1.0  creativecommons org licenses by nd (?P<v>[1234] [05])
cc-by-sa-{v}            1.0  creativecommons org licenses by sa (?P<v>[1234] [05])
cc-by-{v}               1.0  creativecommons org licenses by (?P<v>[1234] [05])
cc0-1.0                 1.0  creativecommons org publicdomain zero 1 0
cc-pdm-1.0              1.0  creativecommons org publicdomain mark 1 0
apache-{v}              1.0  apache org licenses license (?P<v>[12] [01])
gpl-{v}                 0.9  gnu org licenses (?:old licenses )?gpl (?P<v>[123] [0-9])
gpl-x                   0.8  gnu org licenses gpl
lgpl-{v}                0.9  gnu org licenses (?:old licenses )?lgpl (?P<v>[23] [01])
lgpl-x                  0.8  gnu org licenses lgpl
agpl-{v}                0.9  gnu org licenses agpl (?P<v>3 0)
agpl-x                  0.8  gnu org licenses agpl
gfdl-x                  0.8  gnu org licenses fdl
mpl-{v}                 1.0  mozilla org (?:en us )?mpl (?P<v>[12] [01])
epl-x                   0.9  eclipse org legal epl(?: v10| v20| 2 0)?
boost-1.0               1.0  boost org license 1 0
wtfpl                   1.0  wtfpl net
unlicense               1.0  unlicense org
ofl-1.1                 0.9  scripts sil org ofl
osi-mit                 0.9  opensource org licenses? mit(?: license)?(?: php)?
osi-bsd                 0.9  opensource org licenses? bsd(?: [23] clause)?
odbl-1.0                0.9  opendatacommons org licenses odbl
odc-by-1.0              0.9  opendatacommons org licenses by
pddl-1.0                0.9  opendatacommons org licenses pddl
ogl-uk-{v}              0.9  nationalarchives gov uk doc open government licence version (?P<v>[123])
cecill-x                0.9  cecill info

# sentences of texts and notices
mit                     1.0  permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit                     0.9  the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
isc                     1.0  permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
hpnd                    1.0  permission to use copy modify and distribute this software and its documentation for any purpose(?: and)? without fee is hereby granted
bsd-4-clause            1.0  all advertising materials mentioning features or use of this software must display
bsd-3-clause            1.0  neither the name of(?: [^ ]+){1,12} nor the names of its contributors may be used to endorse or promote
bsd                     0.9  redistribution and use in source and binary forms with or without modification are permitted
bsd                     0.8  redistributions of source code must retain the above copyright notice
bsd                     0.8  redistributions in binary form must reproduce the above copyright notice
zlib                    1.0  this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib                    0.9  altered source versions must be plainly marked as such
bsl-1.0                 1.0  permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
unlicense               1.0  this is free and unencumbered software released into the public domain
wtfpl                   1.0  you just do what the fuck you want to
wtfpl                   1.0  do what the fuck you want to public license
beerware                1.0  you can buy me a beer in return
json                    1.0  the software shall be used for good not evil
apache-{v}              1.0  licensed under the apache license(?: version)? v?(?P<v>[12] [01])
apache-2.0              0.9  you may not use this file except in compliance with the license
apache-2.0              0.9  unless required by applicable law or agreed to in writing software distributed under the license
gpl-{v}-or-later        1.0  gnu general public license as published by the free software foundation either version (?P<v>[123])(?: of the license)? or(?: at your option)? any later version
gpl-{v}-only            1.0  gnu general public license version (?P<v>[123]) as published by the free software foundation
gpl-{v}                 1.0  licensed under the gnu general public license v(?:ersion )?(?P<v>[123](?: 0)?)
lgpl-{v}-or-later       1.0  gnu (?:lesser|library) general public license as published by the free software foundation either version (?P<v>[23](?: 1)?)(?: of the license)? or(?: at your option)? any later version
agpl-{v}-or-later       1.0  gnu affero general public license as published by the free software foundation either version (?P<v>3)(?: of the license)? or(?: at your option)? any later version
gfdl-{v}                1.0  gnu free documentation license version (?P<v>1 [123]) or any later version
gpl-x                   0.7  you should have received a copy of the gnu general public license
lgpl-x                  0.7  you should have received a copy of the gnu lesser general public license
agpl-x                  0.7  you should have received a copy of the gnu affero general public license
gpl-exception           0.8  as a special exception(?: [^ ]+){1,20} permission to link
classpath-exception     1.0  linking this library statically or dynamically with other modules
mpl-{v}                 1.0  this source code form is subject to the terms of the mozilla public license v (?P<v>2 0)
mpl-1.1                 1.0  the contents of this file are subject to the mozilla public license version 1 1
epl-{v}                 1.0  accompanying materials are made available under the terms of the eclipse public license v ?(?P<v>[12](?: 0)?)
cddl-x                  1.0  the contents of this file are subject to the terms of the common development and distribution license
cc0-1.0                 1.0  to the extent possible under law(?: [^ ]+){1,20} waived all copyright
ofl-1.1                 1.0  this font software is licensed under the sil open font license(?: version 1 1)?
ubuntu-font-1.0         1.0  ubuntu font licen[cs]e version 1 0
bitstream-vera          1.0  bitstream vera is a trademark of bitstream
openssl                 1.0  this product includes software developed by the openssl project
ssleay                  1.0  this product includes cryptographic software written by eric young
apache-1.1              1.0  this product includes software developed by the apache software foundation
php-{v}                 1.0  this source file is subject to version (?P<v>3 0|3 01) of the php license
psf-2.0                 1.0  psf license agreement for python
unicode                 1.0  unicode inc license agreement data files and software
icu                     1.0  icu license icu 1 8 1 and later
sleepycat               1.0  redistributions in any form must be accompanied by information on how to obtain complete source code
sspl-1.0                1.0  server side public license version 1
busl-1.1                1.0  business source license 1 1
commons-clause          1.0  commons clause license condition v1 0
elastic-2.0             1.0  elastic license 2 0
polyform-nc-1.0.0       1.0  polyform noncommercial license 1 0 0
polyform-sb-1.0.0       1.0  polyform small business license 1 0 0
proprietary             0.9  proprietary and confidential
proprietary             0.9  confidential and proprietary
proprietary             0.9  unauthorized copying of this file via any medium is strictly prohibited
proprietary             0.8  no part of this (?:publication|work|document|book) may be reproduced
proprietary             0.8  for internal use only
proprietary             0.8  may not be published broadcast rewritten or redistributed
proprietary             0.8  reproduction(?: [^ ]+){0,6} without(?: [^ ]+){0,4} permission is prohibited
proprietary             0.8  nutzung nur mit genehmigung
reserved                0.9  all rights reserved worldwide
reserved                0.8  tous droits réservés
reserved                0.8  alle rechte vorbehalten
reserved                0.8  todos los derechos reservados
reserved                0.8  tutti i diritti riservati
reserved                0.8  todos os direitos reservados
reserved                0.8  alle rechten voorbehouden
public-domain           0.9  (?:released|dedicated|placed|put)(?: [^ ]+){0,4} (?:in|into|to) the public domain
public-domain           0.8  this work is in the public domain
us-government           0.9  work of the united states government
crown-copyright         0.9  contains public sector information licensed under the open government licence(?: v(?P<v>[123]) 0)?

# names with versions
cc-by-nc-sa-{v}         0.9  cc by nc sa v?(?P<v>[1234] [05])
cc-by-nc-nd-{v}         0.9  cc by nc nd v?(?P<v>[1234] [05])
cc-by-nc-{v}            0.9  cc by nc v?(?P<v>[1234] [05])
cc-by-nd-{v}            0.9  cc by nd v?(?P<v>[1234] [05])
cc-by-sa-{v}            0.9  cc by sa v?(?P<v>[1234] [05])
cc-by-{v}               0.9  cc by v?(?P<v>[1234] [05])
cc-by-nc-sa-{v}         0.9  creative commons attribution non ?commercial share ?alike v?(?P<v>[1234] [05])
cc-by-nc-nd-{v}         0.9  creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)? v?(?P<v>[1234] [05])
cc-by-nc-{v}            0.9  creative commons attribution non ?commercial v?(?P<v>[1234] [05])
cc-by-nd-{v}            0.9  creative commons attribution no ?deriv(?:ative)?s?(?: works)? v?(?P<v>[1234] [05])
cc-by-sa-{v}            0.9  creative commons attribution share ?alike v?(?P<v>[1234] [05])
cc-by-{v}               0.9  creative commons attribution v?(?P<v>[1234] [05])
cc0-1.0                 0.9  cc0 1 0(?: universal)?
gpl-{v}-or-later        0.9  gnu general public license v(?:ersion )?(?P<v>[123](?: 0)?) or (?:any )?later
gpl-{v}                 0.9  gnu general public license v(?:ersion )?(?P<v>[123](?: 0)?)
gpl-{v}-or-later        0.9  gnu gpl v?(?P<v>[123](?: 0)?) or (?:any )?later
gpl-{v}                 0.9  gnu gpl v(?:ersion )?(?P<v>[123](?: 0)?)
gpl-{v}                 0.8  gpl v(?:ersion )?(?P<v>[123](?: 0)?)
gpl-2                   0.8  gplv2
gpl-3                   0.8  gplv3
lgpl-{v}                0.9  gnu (?:lesser|library) general public license v(?:ersion )?(?P<v>[23](?: [01])?)
lgpl-{v}                0.8  lgpl v(?:ersion )?(?P<v>[23](?: [01])?)
lgpl-2.1                0.8  lgplv2 1
lgpl-3                  0.8  lgplv3
agpl-{v}                0.9  affero general public license v(?:ersion )?(?P<v>[13](?: 0)?)
agpl-3                  0.8  agplv3
gfdl-{v}                0.9  gnu free documentation license v(?:ersion )?(?P<v>1 [123])
apache-{v}              0.9  apache license(?: version)? v?(?P<v>[12](?: [01])?)
apache-{v}              0.9  apache software license v(?:ersion )?(?P<v>[12](?: [01])?)
apache-{v}              0.8  apache v?(?P<v>[12] [01])(?: licen[cs]e)?
mpl-{v}                 0.9  mozilla public license(?: version)? v?(?P<v>[12] [01])
mpl-{v}                 0.8  mpl v?(?P<v>[12] [01])
epl-{v}                 0.9  eclipse public license(?: version)? v?(?P<v>[12](?: 0)?)
edl-1.0                 0.9  eclipse distribution license(?: v)? 1 0
cddl-{v}                0.9  common development and distribution license(?: version)? v?(?P<v>1 [01])
cpl-1.0                 0.9  common public license(?: version)? 1 0
ipl-1.0                 0.9  ibm public license(?: version)? 1 0
eupl-{v}                0.9  european union public licen[cs]e(?: version)? v?(?P<v>1 [012])
eupl-{v}                0.8  eupl v?(?P<v>1 [012])
cecill-{v}              0.9  cecill(?: version)? v?(?P<v>[12] [01])
artistic-{v}            0.9  artistic license(?: version)? (?P<v>[12] 0)
osl-{v}                 0.9  open software license(?: version)? v?(?P<v>[123] [01])
afl-{v}                 0.9  academic free license(?: version)? v?(?P<v>[123] [012])
ofl-{v}                 0.9  sil open font license(?: version)? v?(?P<v>1 [01])
zpl-{v}                 0.9  zope public license(?: zpl)?(?: version)? (?P<v>[12] [01])
lppl-{v}                0.9  latex project public license(?: version)? v?(?P<v>1 [0-3][abc]?)
ms-pl                   0.9  microsoft public license
ms-rl                   0.9  microsoft reciprocal license
bsd-0-clause            0.9  (?:zero|0) clause bsd(?: licen[cs]e)?
bsd-1-clause            0.9  (?:one|1) clause bsd(?: licen[cs]e)?
bsd-2-clause            0.9  (?:two|2) clause bsd(?: licen[cs]e)?
bsd-3-clause            0.9  (?:three|3) clause bsd(?: licen[cs]e)?
bsd-4-clause            0.9  (?:four|4) clause bsd(?: licen[cs]e)?
bsd-2-clause            0.9  bsd (?:two|2) clause(?: licen[cs]e)?
bsd-3-clause            0.9  bsd (?:three|3) clause(?: licen[cs]e)?
bsd-2-clause            0.9  simplified bsd licen[cs]e
bsd-3-clause            0.9  (?:new|modified|revised) bsd licen[cs]e
freebsd                 0.9  freebsd licen[cs]e
cdla-permissive-{v}     0.9  community data license agreement permissive(?: version)? (?P<v>[12] 0)
cdla-sharing-1.0        0.9  community data license agreement sharing(?: version)? 1 0
odbl-1.0                0.9  open (?:data commons open )?database licen[cs]e(?: odbl)?(?: v?1 0)?
odc-by-1.0              0.9  open data commons attribution licen[cs]e(?: v?1 0)?
pddl-1.0                0.9  public domain dedication and licen[cs]e(?: v?1 0)?
ogl-uk-{v}              0.9  open government licen[cs]e v(?:ersion )?(?P<v>[123])(?: 0)?
etalab-2.0              0.9  licence ouverte(?: open licence)?(?: version)?(?: 2 0)?
dl-de-by-2.0            0.9  datenlizenz deutschland(?: namensnennung)?(?: version)?(?: 2 0)?
mulanpsl-{v}            0.9  mulan (?:permissive software license|psl) v(?:ersion )?(?P<v>[12])
blueoak-1.0.0           0.9  blue oak model license 1 0 0
openrail                0.9  openrail(?: m)?(?: licen[cs]e)?
openrail                0.9  open rail(?: m)?(?: licen[cs]e)?
creativeml-openrail-m   0.9  creativeml open ?rail m
bloom-rail-1.0          0.9  bigscience(?: bloom)? rail(?: licen[cs]e)?(?: v?1 0)?
llama-{v}               0.9  llama (?P<v>[234](?: [0-9])?) community license
gemma                   0.9  gemma terms of use
upl-1.0                 0.9  universal permissive license
ecl-{v}                 0.9  educational community license(?: version)? (?P<v>[12] 0)
rpl-{v}                 0.9  reciprocal public license(?: version)? (?P<v>1 [15])
naist-2003              0.9  nara institute of science and technology(?: [^ ]+){0,6} licen[cs]e

# names alone
cc-by-nc-sa-x           0.7  cc by nc sa
cc-by-nc-nd-x           0.7  cc by nc nd
cc-by-nc-x              0.7  cc by nc
cc-by-nd-x              0.7  cc by nd
cc-by-sa-x              0.7  cc by sa
cc0                     0.7  cc0
cc-x                    0.6  creative commons(?: [^ ]+){0,4} licen[cs]e
mit                     0.9  (?:released|licensed|distributed|available) under(?: the)?(?: terms of the)? mit licen[cs]e
mit                     0.8  mit licen[cs]e
mit                     0.7  licen[cs]e mit
x11                     0.8  x11 licen[cs]e
expat                   0.8  expat licen[cs]e
bsd                     0.7  bsd licen[cs]e
bsd                     0.7  bsd style licen[cs]e
isc                     0.8  isc licen[cs]e
gpl-x                   0.7  gnu general public license
gpl-x                   0.7  gnu gpl
lgpl-x                  0.7  gnu (?:lesser|library) general public license
lgpl-x                  0.6  lgpl
agpl-x                  0.7  affero general public license
agpl-x                  0.6  agpl
gpl-x                   0.6  gpl
gfdl-x                  0.7  gnu free documentation license
apache-x                0.7  apache licen[cs]e
mpl-x                   0.7  mozilla public license
epl-x                   0.7  eclipse public license
cddl-x                  0.6  cddl
cddl-x                  0.7  common development and distribution license
eupl-x                  0.6  eupl
cecill-x                0.6  cecill
artistic-x              0.7  artistic licen[cs]e
zlib                    0.8  zlib(?: libpng)? licen[cs]e
libpng                  0.8  libpng licen[cs]e
bsl-1.0                 0.8  boost software license
unlicense               0.8  the unlicense
wtfpl                   0.8  wtfpl
postgresql              0.8  postgresql licen[cs]e
python                  0.7  python software foundation license
php-x                   0.7  php licen[cs]e
ruby                    0.7  ruby licen[cs]e
perl                    0.8  same terms as perl itself
tcl                     0.7  tcl tk licen[cs]e
vim                     0.8  vim licen[cs]e
ncsa                    0.8  university of illinois ncsa open source license
w3c                     0.8  w3c software(?: notice and)? licen[cs]e
qpl                     0.8  q public license
lppl-x                  0.8  latex project public license
ofl-x                   0.7  open font license
osl-x                   0.7  open software license
afl-x                   0.7  academic free license
sspl-x                  0.8  server side public license
busl-x                  0.7  business source license
elastic-x               0.7  elastic license
ogl-x                   0.7  open government licen[cs]e
public-domain           0.5  public domain
proprietary             0.5  commercial licen[cs]e
eula                    0.6  end user licen[cs]e agreement
copyright               0.5  copyright (?:c |© )?(?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])?
copyright               0.5  © (?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])?
"""


@dataclass(frozen=True)
class Rule:
    label: str
    strength: float
    pattern: re.Pattern[bytes]
    keywords: frozenset[bytes]


def keywords(pattern: str) -> frozenset[bytes]:
    """Words that every match holds: those outside groups and without signs of a pattern.

    A word beside a group counts only if a space begins the group after it, or ends the one before it.
    """
    flat, depth = "", 0
    for k, c in enumerate(pattern):
        after = pattern[k + 1 : k + 2]
        if c == "(":
            depth += 1
            if depth == 1:
                flat += " ~" if pattern[k : k + 4] == "(?: " else "~"
        elif c == ")":
            depth -= 1
            if not depth and pattern[k - 1] == " ":
                flat += " " if after != "?" else " ~ "
        elif not depth and not (c == "?" and flat.endswith(" ~ ")):
            flat += "~" if c == " " and after == "?" else c
    return frozenset(w.encode() for w in flat.split(" ") if re.fullmatch(r"[0-9a-z\x80-\U0010ffff]+", w))


def read_rules(text: str = RULES) -> list[Rule]:
    """The rules in order of priority."""
    out = []
    for line in text.splitlines():
        if line and not line.startswith("#"):
            label, strength, pattern = line.split(None, 2)
            out.append(Rule(label, float(strength), re.compile(rf"(?<![^ ])(?:{pattern})(?![^ ])".encode()), keywords(pattern)))
    return out
