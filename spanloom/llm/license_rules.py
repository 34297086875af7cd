"""Signature rules for licences, in the order in which they were reviewed.

A text is matched as its lower-case words joined by single spaces.  A rule has a label, a kind, a
pattern, a gate, a priority (the larger wins where one detection holds the other) and a weight, the
confidence that a match gives.  A gate is a list of places, all of which must be filled before the
pattern is tried; words parted by a stroke fill the same place.
"""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    label: str
    kind: str
    pattern: str
    gate: tuple[tuple[str, ...], ...]
    priority: int
    weight: float

    def compiled(self) -> re.Pattern:
        return re.compile(rf"(?<!\S)(?:{self.pattern})(?!\S)")


# One line a licence: label | its identifier in words | its names (a pattern) | the gate of the names
# | an address (a pattern) or - . The forms below make the rules of each.
FAMILIES = """
mit | mit | (?:the )?mit(?: x11)?(?: open source)? | mit | opensource org licenses? mit
mit-0 | mit 0 | mit(?: license)? (?:no attribution|0) | mit | -
apache-2 | apache 2 0 | (?:the )?apache(?: software)?(?: license)?(?: version)? v?2(?: 0)? | apache 2/v2 | apache org licenses license 2 0
apache-1.1 | apache 1 1 | (?:the )?apache(?: software)?(?: license)?(?: version)? v?1 1 | apache 1/v1 | apache org licenses license 1 1
gpl-2-only | gpl 2 0 only | gnu (?:general public license|gpl) version 2 only | gnu 2 only | -
gpl-2 | gpl 2 0 | (?:gnu )?(?:general public license|gpl) (?:version |v)?2(?: 0)? | gpl/general 2/v2 | gnu org licenses (?:old licenses )?gpl 2 0
gpl-2-or-later | gpl 2 0 or later | gnu (?:general public license|gpl)(?: as published by the free software foundation)? (?:either )?version 2 (?:of the license )?or (?:at your option )?any later version | gnu 2 later | -
gpl-3 | gpl 3 0 | (?:gnu )?(?:general public license|gpl) (?:version |v)?3(?: 0)? | gpl/general 3/v3 | gnu org licenses gpl 3 0
gpl-3-or-later | gpl 3 0 or later | gnu (?:general public license|gpl)(?: as published by the free software foundation)? (?:either )?version 3 (?:of the license )?or (?:at your option )?any later version | gnu 3 later | -
gpl | gpl | gnu (?:general public license|gpl) | gnu gpl/general | gnu org (?:copyleft|licenses) gpl
lgpl-2.1 | lgpl 2 1 | (?:gnu )?(?:lesser general public license|lgpl) (?:version |v)?2 1 | lgpl/lesser 2/v2 | gnu org licenses (?:old licenses )?lgpl 2 1
lgpl-3 | lgpl 3 0 | (?:gnu )?(?:lesser general public license|lgpl) (?:version |v)?3(?: 0)? | lgpl/lesser 3/v3 | gnu org licenses lgpl 3 0
lgpl | lgpl | (?:gnu (?:lesser|library) general public license|(?:gnu )?lgpl) | lgpl/lesser/library | gnu org (?:copyleft|licenses) lesser
agpl-3 | agpl 3 0 | (?:gnu )?(?:affero general public license|agpl)(?: (?:version |v)?3(?: 0)?)? | affero/agpl | gnu org licenses agpl 3 0
fdl-1.3 | gfdl 1 3 | gnu free documentation license(?: version 1 [23])? | documentation | gnu org licenses fdl 1 3
bsd-2 | bsd 2 clause | (?:the )?(?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd|two clause bsd) | bsd/freebsd | opensource org licenses? bsd 2 clause
bsd-3 | bsd 3 clause | (?:the )?(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd) | bsd | opensource org licenses? bsd 3 clause
bsd-4 | bsd 4 clause | (?:the )?(?:original bsd|bsd 4 clause|4 clause bsd) | bsd | -
bsd-0 | 0bsd | (?:the )?(?:zero clause bsd|bsd zero clause|0bsd) | bsd/0bsd | opensource org licenses? 0bsd
bsd | bsd | (?:the )?bsd(?: style)? | bsd | -
isc | isc | (?:the )?isc | isc | opensource org licenses? isc
mpl-2 | mpl 2 0 | (?:the )?(?:mozilla public license|mpl) (?:version |v)?2(?: 0)? | mozilla/mpl 2/v2 | mozilla org mpl 2 0
mpl-1.1 | mpl 1 1 | (?:the )?(?:mozilla public license|mpl) (?:version |v)?1 1 | mozilla/mpl 1/v1 | mozilla org mpl 1 1
epl-2 | epl 2 0 | (?:the )?(?:eclipse public license|epl) (?:version |v)?2(?: 0)? | eclipse/epl 2/v2 | eclipse org legal epl 2 0
epl-1 | epl 1 0 | (?:the )?(?:eclipse public license|epl) (?:version |v)?1(?: 0)? | eclipse/epl 1/v1 | eclipse org legal epl v10
eupl-1.2 | eupl 1 2 | (?:the )?european union public licen[cs]e(?: version)?(?: v?1 2)? | european | eupl eu 1 2
cddl-1 | cddl 1 0 | (?:the )?common development and distribution license | distribution | opensource org licenses? cddl 1 0
artistic-2 | artistic 2 0 | (?:the )?artistic license (?:version )?2(?: 0)? | artistic 2 | opensource org licenses? artistic license 2 0
artistic-1 | artistic 1 0 | (?:the )?artistic license | artistic | -
zlib | zlib | (?:the )?zlib(?: libpng)? | zlib | zlib net zlib license
boost-1 | bsl 1 0 | (?:the )?boost software license(?: version)?(?: v?1 0)? | boost | boost org license 1 0
unlicense | unlicense | (?:the )?unlicense | unlicense | unlicense org
wtfpl | wtfpl | (?:do what the (?:fuck|f\\S*) you want to public license|the wtfpl) | want/wtfpl | wtfpl net
cc0 | cc0 1 0 | (?:creative commons )?(?:cc0|cc zero)(?: 1 0)?(?: universal)? | cc0/zero | creativecommons org publicdomain zero 1 0
cc-by | cc by 4 0 | creative commons attribution(?: [1-4] [05])?(?: international| unported| generic)? | attribution | creativecommons org licenses by [1-4]
cc-by-sa | cc by sa 4 0 | creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported)? | attribution | creativecommons org licenses by sa [1-4]
cc-by-nd | cc by nd 4 0 | creative commons attribution no ?deriv(?:ative)?s(?: works)?(?: [1-4] [05])? | attribution | creativecommons org licenses by nd [1-4]
cc-by-nc | cc by nc 4 0 | creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported)? | attribution | creativecommons org licenses by nc [1-4]
cc-by-nc-sa | cc by nc sa 4 0 | creative commons attribution non ?commercial share ?alike(?: [1-4] [05])? | attribution | creativecommons org licenses by nc sa [1-4]
cc-by-nc-nd | cc by nc nd 4 0 | creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: [1-4] [05])? | attribution | creativecommons org licenses by nc nd [1-4]
odbl-1 | odbl 1 0 | (?:the )?(?:open database license|odbl) | database/odbl | opendatacommons org licenses odbl
odc-by | odc by 1 0 | (?:the )?open data commons attribution license | commons | opendatacommons org licenses by
pddl-1 | pddl 1 0 | (?:the )?public domain dedication and license | dedication | opendatacommons org licenses pddl
psf-2 | psf 2 0 | (?:the )?python software foundation license(?: version)?(?: 2)? | python | docs python org license
ruby | ruby | (?:the )?ruby(?: s)? license | ruby | ruby lang org license
php-3 | php 3 01 | (?:the )?php license(?: version)?(?: 3 0?1?)? | php | php net license
perl | perl 5 | same terms as perl itself | perl | dev perl org licenses
ofl-1.1 | ofl 1 1 | (?:the )?(?:sil )?open font license(?: version)?(?: v?1 1)? | font | scripts sil org ofl
ms-pl | ms pl | (?:the )?microsoft public license | microsoft | opensource org licenses? ms pl
ms-rl | ms rl | (?:the )?microsoft reciprocal license | microsoft | opensource org licenses? ms rl
osl-3 | osl 3 0 | (?:the )?open software license(?: version| v)?(?: 3 0)? | software | opensource org licenses? osl 3 0
afl-3 | afl 3 0 | (?:the )?academic free license(?: version| v)?(?: 3 0)? | academic | opensource org licenses? afl 3 0
ncsa | ncsa | (?:the )?university of illinois ncsa open source | illinois | opensource org licenses? ncsa
w3c | w3c | (?:the )?w3c software(?: notice and)? | w3c | w3 org consortium legal
x11 | x11 | (?:the )?x11 | x11 | -
postgresql | postgresql | (?:the )?postgresql | postgresql | opensource org licenses? postgresql
openssl | openssl | (?:the )?openssl(?: and ssleay)? | openssl | openssl org source license
bsl-1.1 | busl 1 1 | (?:the )?business source license(?: version)?(?: 1 1)? | business | mariadb com bsl11
sspl-1 | sspl 1 0 | (?:the )?(?:server side public license|sspl)(?: version)?(?: v?1)? | server/sspl | mongodb com licensing server side public license
elastic-2 | elastic 2 0 | (?:the )?elastic license(?: version| v)?(?: v?2(?: 0)?)? | elastic | elastic co licensing elastic license
openrail-m | openrail m | (?:the )?(?:creativeml |bigscience )?open ?rail(?: m)? | openrail/rail | bigscience huggingface co license
"""

# Rules that fit no form: label | priority | weight | gate | pattern.
SINGLE = """
mit | 9 | 1.0 | permission charge obtaining | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software
mit | 8 | 0.9 | deal restriction software | to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell
mit | 7 | 0.9 | copyright permission substantial | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | 6 | 0.9 | merchantability fitness noninfringement | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
mit | 5 | 0.7 | authors liable tort | in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise
mit-0 | 8 | 0.9 | permission charge attribution | permission is hereby granted free of charge(?: \\S+){0,60}? without the attribution requirement
mit-cmu | 8 | 0.9 | permission carnegie advertising | permission to use copy modify and distribute this software(?: \\S+){0,60}? carnegie mellon(?: \\S+){0,20}? advertising or publicity
bsd-3 | 8 | 1.0 | redistribution endorse | redistribution and use in source and binary forms with or without modification are permitted(?: \\S+){0,120}? neither the name of(?: \\S+){1,12}? may be used to endorse or promote products
bsd-3 | 7 | 0.9 | name endorse promote | neither the name of(?: \\S+){1,12}? nor the names of its contributors may be used to endorse or promote products derived from this software
bsd-2 | 7 | 0.9 | redistribution binary | redistribution and use in source and binary forms with or without modification are permitted
bsd-2 | 6 | 0.8 | redistributions binary reproduce | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd | 5 | 0.7 | redistributions retain | redistributions of source code must retain the above copyright notice
bsd | 5 | 0.7 | exemplary consequential procurement | direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods
bsd-4 | 8 | 1.0 | advertising acknowledgement/acknowledgment | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-3-clear | 9 | 1.0 | patent granted | no express or implied licenses to any party s patent rights are granted by this license
bsd-protection | 9 | 1.0 | bsd protection | bsd protection license
bsd-0 | 9 | 1.0 | permission fee purpose provided | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided
isc | 8 | 1.0 | permission fee purpose | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | 6 | 0.8 | disclaims author merchantability | the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness
isc | 7 | 0.9 | consortium internet | (?:copyright \\S+ )?(?:by )?internet systems consortium
hpnd | 6 | 0.8 | permission fee documentation | permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted
apache-2 | 9 | 1.0 | file compliance | you may not use this file except in compliance with the license
apache-2 | 8 | 1.0 | terms conditions reproduction | terms and conditions for use reproduction and distribution 1 definitions
apache-2 | 7 | 0.9 | basis applicable distributed | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2 | 8 | 1.0 | licensed asf | licensed to the (?:apache software foundation )?asf(?: under one or more contributor license agreements)?
apache-2 | 8 | 1.0 | foundation contributor | licensed to the apache software foundation(?: asf)? under one or more contributor license agreements
apache-2 | 7 | 0.9 | perpetual irrevocable patent | perpetual worldwide non exclusive no charge royalty free irrevocable(?: except as stated in this section)? patent license
apache-2 | 6 | 0.9 | www apache licenses | www apache org licenses license 2 0(?: txt| html)?
apache-1.1 | 8 | 1.0 | developed apache acknowledgement/acknowledgment | this product includes software developed by the apache software foundation(?: \\S+){0,12}? acknowledge?ment
apache-1 | 8 | 0.9 | developed apache group | this product includes software developed by the apache group
gpl | 8 | 1.0 | redistribute modify gnu | you can redistribute it and or modify it under the terms of the gnu general public license(?: as published by the free software foundation)?
gpl-2 | 9 | 1.0 | redistribute modify 2 | you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2
gpl-3 | 9 | 1.0 | redistribute modify 3 | you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3
gpl-2-only | 9 | 1.0 | redistribute modify 2 | you can redistribute it and or modify it under the terms of the gnu general public license version 2(?: only)? as published by the free software foundation
gpl | 5 | 0.6 | received gnu general | you should have received a copy of the gnu general public license
gpl | 5 | 0.5 | hope useful merchantability | distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability
gpl-2 | 9 | 1.0 | june 1991 | gnu general public license version 2 june 1991
gpl-3 | 9 | 1.0 | june 2007 general | gnu general public license version 3 29 june 2007
gpl-1 | 8 | 1.0 | february 1989 | gnu general public license(?: version 1)? february 1989
gpl | 6 | 0.8 | designed freedom share | the licenses for most software(?: and other practical works)? are designed to take away your freedom to share and change
gpl-with-classpath | 9 | 1.0 | exception independent modules | as a special exception(?: \\S+){0,12}? permission to link this library with independent modules to produce an executable
gpl-with-gcc-exception | 9 | 1.0 | gcc runtime exception | gcc runtime library exception
gpl-with-autoconf | 8 | 0.9 | exception autoconf configuration | as a special exception(?: \\S+){0,30}? configuration script generated by autoconf
gpl-with-bison | 8 | 0.9 | exception bison | as a special exception(?: \\S+){0,40}? bison parser skeleton
gpl-with-openssl | 8 | 0.9 | exception openssl | as a special exception(?: \\S+){0,40}? link(?: \\S+){0,12}? openssl
lgpl | 9 | 1.0 | redistribute modify lesser/library | you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
lgpl-2.1 | 9 | 1.0 | february 1999 | gnu lesser general public license version 2 1 february 1999
lgpl-2 | 9 | 1.0 | june 1991 library | gnu library general public license version 2 june 1991
lgpl-3 | 9 | 1.0 | june 2007 lesser | gnu lesser general public license version 3 29 june 2007
lgpl | 5 | 0.6 | received lesser/library | you should have received a copy of the gnu (?:lesser|library) general public license
agpl-3 | 9 | 1.0 | redistribute modify affero | you can redistribute it and or modify it under the terms of the gnu affero general public license
agpl-3 | 9 | 1.0 | november 2007 affero | gnu affero general public license version 3 19 november 2007
agpl-3 | 5 | 0.6 | received affero | you should have received a copy of the gnu affero general public license
agpl-1 | 8 | 0.9 | affero 1 | affero general public license version 1(?: 0)?
fdl-1.3 | 9 | 1.0 | permission document documentation | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
fdl-1.3 | 6 | 0.7 | invariant cover texts | with no invariant sections no front cover texts and no back cover texts
mpl-2 | 9 | 1.0 | source mozilla form | this source code form is subject to the terms of the mozilla public license
mpl-2 | 7 | 0.9 | mpl file obtain | if a copy of the mpl was not distributed with this file you can obtain one at
mpl-1.1 | 9 | 1.0 | contents mozilla subject | the contents of this file are subject to the mozilla public license version 1 1
mpl-1.0 | 8 | 1.0 | contents mozilla subject | the contents of this file are subject to the mozilla public license version 1 0
npl | 8 | 1.0 | netscape contents | the contents of this file are subject to the netscape public license
epl-2 | 9 | 1.0 | accompanying eclipse 2 | (?:this program and the|and its) accompanying materials are made available under the terms of the eclipse public license (?:v |version )?2 0
epl-1 | 9 | 1.0 | accompanying eclipse 1/v1/10/v10 | (?:this program and the|and its) accompanying materials are made available under the terms of the eclipse public license v?(?:ersion )?1 ?0
cpl-1 | 8 | 1.0 | accompanying common | the accompanying program is provided under the terms of this common public license
ibm-public | 8 | 1.0 | accompanying ibm | the accompanying program is provided under the terms of this ibm public license
cddl-1 | 9 | 1.0 | contents development distribution | the contents of this file are subject to the terms of the common development and distribution license
artistic-2 | 9 | 1.0 | establishes package redistributed | this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed
artistic-1 | 8 | 0.9 | intent document package | the intent of this document is to state the conditions under which a package may be copied
perl | 8 | 0.9 | perl redistribute | this (?:library|program|module) is free software you can redistribute it and or modify it under the same terms as perl(?: itself)?
zlib | 9 | 1.0 | origin misrepresented | the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib | 7 | 0.9 | altered marked | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
libpng | 8 | 0.9 | libpng notices | this copy of the libpng notices is provided for your convenience
boost-1 | 9 | 1.0 | machine executable object | unless such copies or derivative works are solely in the form of machine executable object code
boost-1 | 8 | 1.0 | boost software august | boost software license version 1 0 august 17th 2003
unlicense | 9 | 1.0 | unencumbered domain | this is free and unencumbered software released into the public domain
unlicense | 7 | 0.9 | anyone compile sell | anyone is free to copy modify publish use compile sell or distribute this software
wtfpl | 9 | 1.0 | everyone verbatim just | everyone is permitted to copy and distribute verbatim or modified copies of this license document(?: \\S+){0,40}? you just do what
beerware | 9 | 1.0 | beer worth | if we meet some day and you think this stuff is worth it you can buy me a beer
json | 9 | 1.0 | good evil | the software shall be used for good not evil
cc0 | 8 | 1.0 | waived neighboring | has waived all copyright and related or neighboring rights
cc0 | 8 | 1.0 | dedicated associated deed | the person who associated a work with this deed has dedicated the work to the public domain
cc-by | 7 | 0.9 | commons attribution | licensed under (?:a |the )?creative commons attribution(?: [1-4] [05])?
cc-by | 5 | 0.8 | cc by | cc by [1-4] [05](?: international| unported)?
cc-by | 5 | 0.7 | credit appropriate | you must give appropriate credit provide a link to the license and indicate if changes were made
cc-by-nc | 5 | 0.8 | cc nc | cc by nc(?: [1-4] [05])?
cc-by-nc | 6 | 0.8 | material commercial | you may not use the material for commercial purposes
cc-by-nc-sa | 6 | 0.8 | cc nc sa | cc by nc sa(?: [1-4] [05])?
cc-by-nc-nd | 6 | 0.8 | cc nc nd | cc by nc nd(?: [1-4] [05])?
cc-by-sa | 5 | 0.8 | cc by sa | cc by sa(?: [1-4] [05])?
cc-by-sa | 6 | 0.7 | remix transform contributions | if you remix transform or build upon the material you must distribute your contributions under the same license
cc-by-nd | 5 | 0.8 | cc by nd | cc by nd(?: [1-4] [05])?
cc-by-nd | 6 | 0.7 | remix transform modified | if you remix transform or build upon the material you may not distribute the modified material
cc-sampling | 6 | 0.8 | commons sampling | creative commons sampling(?: plus)?
odbl-1 | 8 | 1.0 | database available open | this database is made available under the open database license
odbl-1 | 7 | 0.9 | openstreetmap contributors | openstreetmap contributors
odc-by | 8 | 1.0 | available attribution commons | this data(?:base)? is made available under the open data commons attribution license
dl-de-by | 8 | 0.9 | datenlizenz | datenlizenz deutschland (?:namensnennung|zero)(?: version)? 2 0
ogl-uk | 8 | 0.9 | government licence/license | (?:contains public sector information licensed under the )?open government licen[cs]e(?: v?[123] 0)?
etalab | 8 | 0.9 | licence etalab | licence ouverte(?: \\S+){0,3}? etalab
psf-2 | 8 | 1.0 | psf python agreement | this license agreement is between the python software foundation psf and the individual or organization
python-cnri | 8 | 0.9 | cnri agreement | cnri open source license agreement
php-3 | 8 | 1.0 | product php freely | this product includes php software freely available from
ofl-1.1 | 9 | 1.0 | font sil | this font software is licensed under the sil open font license
ofl-1.1 | 7 | 0.9 | reserved font name | with reserved font name
ms-pl | 8 | 1.0 | governs accompanying accept | this license governs use of the accompanying software if you use the software you accept this license
osl-3 | 8 | 0.9 | licensed open software 3 | licensed under the open software license version 3 0
ncsa | 9 | 1.0 | deal restriction with | to deal with the software without restriction
w3c | 8 | 1.0 | obtaining licensee understood | by obtaining using and or copying this work you the licensee agree that you have read understood and will comply
postgresql | 8 | 1.0 | postgresql portions | postgresql database management system(?: \\S+){0,30}? portions copyright
openssl | 9 | 1.0 | openssl toolkit | this product includes software developed by the openssl project for use in the openssl toolkit
ssleay | 8 | 1.0 | cryptographic eric young | this product includes cryptographic software written by eric young
curl | 7 | 0.9 | daniel stenberg | copyright and permission notice copyright c(?: \\S+){1,8}? daniel stenberg
ijg | 8 | 0.9 | independent jpeg group | this software is based in part on the work of the independent jpeg group
freetype | 8 | 0.9 | freetype project | portions of this software are copyright(?: \\S+){1,5}? the freetype project
unicode | 8 | 0.9 | unicode data files | unicode inc license agreement data files and software
icu | 7 | 0.8 | icu later | icu license icu 1 8 1 and later
tcl | 7 | 0.8 | associated explicitly disclaimed | the following terms apply to all files associated with the software unless explicitly disclaimed
vim | 8 | 0.9 | vim charityware | vim is charityware
ibm-icu-x | 6 | 0.7 | provided permission appear | provided that the above copyright notice s and this permission notice appear in all copies of the software
bsl-1.1 | 8 | 1.0 | change date | change date(?: \\S+){1,20}? change license
sspl-1 | 9 | 1.0 | service functionality program third | if you make the functionality of the program or a modified version available to third parties as a service
elastic-2 | 9 | 1.0 | hosted managed service | you may not provide the software to third parties as a hosted or managed service
commons-clause | 8 | 1.0 | commons clause | commons clause license condition
polyform-nc | 8 | 0.9 | polyform | polyform (?:noncommercial|strict|shield|small business) license
prosperity | 8 | 0.9 | prosperity public | prosperity public license
parity | 8 | 0.9 | parity public | parity public license
hippocratic | 8 | 0.9 | hippocratic | hippocratic license
openrail-m | 8 | 0.9 | responsible ai | responsible ai licen[cs]e(?:s)?
openrail-m | 7 | 0.8 | restrictions referenced paragraph | use based restrictions as referenced in paragraph 5
llama-2 | 8 | 0.9 | llama community | llama (?:2|3|3 1) community license(?: agreement)?
gemma-terms | 8 | 0.9 | gemma terms | gemma terms of use
jpl-image | 7 | 0.7 | nasa courtesy | courtesy (?:of )?nasa(?: jpl caltech)?
us-government | 7 | 0.8 | united government | (?:work|software) of the united states government(?: and is not subject to copyright)?
us-government | 6 | 0.7 | restrictions dfars | subject to restrictions as set forth in(?: \\S+){0,12}? dfars
public-domain | 4 | 0.7 | public domain | (?:released|dedicated|placed|published|is) (?:in|in to|into|to) the public domain
public-domain | 5 | 0.8 | copyright disclaims | the author disclaims copyright to this source code
public-domain | 4 | 0.6 | gutenberg | project gutenberg(?: tm)? license
proprietary | 4 | 0.6 | rights reserved copyright | copyright(?: \\S+){1,8}? all rights reserved
proprietary | 5 | 0.8 | unauthorized copying | unauthorized copying of this file via any medium is strictly prohibited
proprietary | 5 | 0.8 | proprietary confidential | (?:confidential and proprietary|proprietary and confidential)
proprietary | 5 | 0.8 | trade secret/secrets | (?:contains|constitutes)(?: \\S+){0,6}? trade secrets? of
proprietary | 5 | 0.8 | reproduced permission written | no part of this (?:publication|book|document|work) may be reproduced(?: \\S+){0,30}? (?:prior )?written permission
proprietary | 5 | 0.7 | reverse engineer | (?:may not|shall not|not to) reverse engineer decompile or disassemble
proprietary | 4 | 0.7 | licensed sold | (?:the software|this product) is licensed not sold
shareware | 5 | 0.7 | shareware | this (?:program|software) is shareware
freeware | 5 | 0.7 | freeware | this (?:program|software) is freeware
evaluation-only | 5 | 0.7 | evaluation only | for evaluation purposes only
non-commercial | 4 | 0.6 | commercial/noncommercial/research/academic/personal only | for (?:non ?commercial|research|academic|personal) (?:use|purposes) only
non-commercial | 4 | 0.6 | commercial prohibited/permitted/allowed | commercial use (?:is )?(?:strictly )?(?:prohibited|not permitted|not allowed)
no-derivatives | 4 | 0.5 | derivative | no derivative works (?:may be|are) (?:made|permitted|allowed)
no-training | 5 | 0.7 | training machine/ai/artificial | (?:may not|must not|shall not) be used (?:for|in) (?:the )?training (?:of )?(?:machine learning|ai|artificial intelligence)(?: models| systems)?
copyleft | 3 | 0.4 | copyleft | (?:strong|weak) copyleft
dual-license | 3 | 0.5 | dual licensed | (?:this \\S+ is )?dual licensed(?: under)?
dual-license | 3 | 0.5 | option either | at your option under the terms of either
contributor-agreement | 4 | 0.5 | contributor agreement | contributor license agreement(?: cla)?
contributor-agreement | 4 | 0.5 | developer certificate origin | developer certificate of origin(?: version)?(?: 1 1)?
generic | 1 | 0.3 | license/licence details/information/terms | see (?:the )?licen[cs]e(?: file| txt| md)? for (?:details|more information|terms)
generic | 1 | 0.2 | licensed/licenced terms | licen[cs]ed under the terms of
generic | 1 | 0.3 | license agreement | (?:end user )?license agreement
generic | 1 | 0.3 | license root directory/tree | found in the license file in the root (?:directory|of this source tree)
generic | 1 | 0.2 | open source license | (?:an )?open source license
"""

# Short and glued forms as people write them: label | priority | weight | gate | pattern.
SHORT = """
gpl-2 | 6 | 0.8 | gplv2/gpl2 | (?:gnu )?gpl(?:v)?2(?: 0)?(?: only| licen[cs]ed?)?
gpl-3 | 6 | 0.8 | gplv3/gpl3 | (?:gnu )?gpl(?:v)?3(?: 0)?(?: only| licen[cs]ed?)?
gpl-2-or-later | 9 | 0.9 | gplv2/gpl2 later/newer/higher | (?:gnu )?gpl(?:v)?2(?: 0)? or (?:any )?(?:later|newer|higher)(?: version)?
gpl-3-or-later | 9 | 0.9 | gplv3/gpl3 later/newer/higher | (?:gnu )?gpl(?:v)?3(?: 0)? or (?:any )?(?:later|newer|higher)(?: version)?
gpl-2-or-later | 9 | 0.9 | gpl later/newer/higher 2/v2 | (?:gnu )?gpl (?:version |v)?2(?: 0)? or (?:any )?(?:later|newer|higher)(?: version)?
gpl-3-or-later | 9 | 0.9 | gpl later/newer/higher 3/v3 | (?:gnu )?gpl (?:version |v)?3(?: 0)? or (?:any )?(?:later|newer|higher)(?: version)?
gpl-2 | 7 | 0.9 | under gplv2/gpl2 | (?:licen[cs]ed|released|distributed|available) under (?:the )?(?:gnu )?gpl(?:v)?2(?: 0)?
gpl-3 | 7 | 0.9 | under gplv3/gpl3 | (?:licen[cs]ed|released|distributed|available) under (?:the )?(?:gnu )?gpl(?:v)?3(?: 0)?
gpl | 5 | 0.7 | under gpl | (?:licen[cs]ed|released|distributed|available) under (?:the )?gpl
gpl | 4 | 0.6 | gpl compatible/only | gpl (?:compatible|only)
lgpl-2.1 | 7 | 0.8 | lgplv2/lgpl2 | (?:gnu )?lgpl(?:v)?2 1(?: licen[cs]e)?
lgpl-2 | 6 | 0.8 | lgplv2/lgpl2 | (?:gnu )?lgpl(?:v)?2(?: 0)?(?: licen[cs]e)?
lgpl-3 | 6 | 0.8 | lgplv3/lgpl3 | (?:gnu )?lgpl(?:v)?3(?: 0)?(?: licen[cs]e)?
lgpl-2.1-or-later | 9 | 0.9 | lgpl later | (?:spdx license identifier )?lgpl 2 1 or later
lgpl-3-or-later | 9 | 0.9 | lgpl later | (?:spdx license identifier )?lgpl 3 0 or later
agpl-3 | 6 | 0.8 | agplv3/agpl3 | (?:gnu )?agpl(?:v)?3(?: 0)?(?: licen[cs]e)?
agpl-3-or-later | 9 | 0.9 | agpl later | (?:spdx license identifier )?agpl 3 0 or later
agpl | 5 | 0.7 | agpl licensed/license/licence/licenced/under | (?:licen[cs]ed under (?:the )?agpl|agpl licen[cs]ed?)
apache-2 | 6 | 0.8 | apache2/apachev2 | (?:licen[cs]ed under (?:the )?)?apache(?:v)?2(?: 0)?(?: licen[cs]ed?)?
apache-2 | 6 | 0.8 | asl 2/v2 | asl (?:version |v)?2(?: 0)?
apache-2 | 5 | 0.7 | apache licensed | apache 2(?: 0)? licensed
apache | 3 | 0.5 | apache license/licensed/licence/licenced | (?:the )?apache licen[cs]ed?
mit | 5 | 0.8 | mit licensed | mit licensed
mit | 5 | 0.7 | expat | (?:the )?expat licen[cs]e
mit | 5 | 0.7 | x11 | (?:the )?(?:x11|mit x11) licen[cs]e
mit | 6 | 0.8 | license/licence mit | licen[cs]e mit(?: licen[cs]e)?
mit | 4 | 0.6 | mit style/like/compatible | mit (?:style|like|compatible)(?: licen[cs]e)?
bsd-2 | 6 | 0.8 | bsd 2/two | (?:bsd (?:2|two) clauses?|(?:2|two) clauses? bsd)(?: licen[cs]ed?)?
bsd-3 | 6 | 0.8 | bsd 3/three | (?:bsd (?:3|three) clauses?|(?:3|three) clauses? bsd)(?: licen[cs]ed?)?
bsd-4 | 6 | 0.8 | bsd 4/four | (?:bsd (?:4|four) clauses?|(?:4|four) clauses? bsd)(?: licen[cs]ed?)?
bsd-2 | 6 | 0.8 | bsd2/bsd2clause | bsd2(?:clause)?(?: licen[cs]e)?
bsd-3 | 6 | 0.8 | bsd3/bsd3clause | bsd3(?:clause)?(?: licen[cs]e)?
bsd | 4 | 0.6 | bsd licensed | bsd licensed
bsd | 3 | 0.5 | berkeley distribution | berkeley (?:software|standard) distribution
isc | 4 | 0.6 | isc licensed | isc licensed
mpl-2 | 6 | 0.8 | mpl2/mplv2 | mpl(?:v)?2(?: 0)?(?: licen[cs]e)?
mpl | 4 | 0.6 | mozilla public | (?:the )?mozilla public licen[cs]e
mpl | 5 | 0.7 | under mpl | licen[cs]ed under (?:the )?mpl
epl-2 | 6 | 0.8 | epl2/eplv2 | epl(?:v)?2(?: 0)?
epl-1 | 6 | 0.8 | epl1/eplv1 | epl(?:v)?1(?: 0)?
epl | 4 | 0.6 | eclipse public | (?:the )?eclipse public licen[cs]e
eupl-1.2 | 7 | 0.9 | eupl 1/v1 | (?:licen[cs]ed under (?:the )?)?eupl (?:version |v)?1 2
eupl-1.1 | 7 | 0.9 | eupl 1/v1 | (?:licen[cs]ed under (?:the )?)?eupl (?:version |v)?1 1
eupl | 5 | 0.7 | under eupl | licen[cs]ed under (?:the )?eupl
eupl | 5 | 0.7 | eupl license/licensed/licence/licenced | eupl licen[cs]ed?
cc0 | 7 | 0.9 | cc0 | cc0 1 0(?: universal)?(?: public domain dedication)?
cc0 | 6 | 0.8 | cc0 | (?:licen[cs]ed |released |dedicated )?(?:under|as|to) (?:the )?cc0
cc0 | 6 | 0.8 | commons zero | creative commons zero(?: v?1 0)?(?: universal)?
cc-by-4 | 7 | 0.9 | attribution 4 | creative commons attribution 4 0(?: international)?(?: public)?(?: licen[cs]e)?
cc-by-3 | 7 | 0.9 | attribution 3 | creative commons attribution 3 0(?: unported| us)?(?: licen[cs]e)?
cc-by-sa-4 | 8 | 0.9 | attribution sharealike/share 4 | (?:creative commons )?attribution share ?alike 4 0(?: international)?(?: licen[cs]e)?
cc-by-sa-3 | 8 | 0.9 | attribution sharealike/share 3 | (?:creative commons )?attribution share ?alike 3 0(?: unported)?(?: licen[cs]e)?
cc-by-nc-4 | 8 | 0.9 | attribution noncommercial/non 4 | (?:creative commons )?attribution non ?commercial 4 0(?: international)?(?: licen[cs]e)?
cc-by-nc-sa-4 | 9 | 0.9 | attribution noncommercial/non 4 | (?:creative commons )?attribution non ?commercial share ?alike 4 0(?: international)?(?: licen[cs]e)?
cc-by-nc-nd-4 | 9 | 0.9 | attribution noncommercial/non 4 | (?:creative commons )?attribution non ?commercial no ?deriv(?:ative)?s 4 0(?: international)?(?: licen[cs]e)?
cc-by-nd-4 | 8 | 0.9 | attribution 4 noderivs/noderivatives/no | (?:creative commons )?attribution no ?deriv(?:ative)?s 4 0(?: international)?(?: licen[cs]e)?
cc | 3 | 0.5 | creative commons | (?:a |the )?creative commons licen[cs]e
unlicense | 5 | 0.7 | unlicense/unlicensed | (?:under (?:the )?|the )unlicense
wtfpl | 6 | 0.8 | wtfpl | wtfpl(?: v?2)?(?: licen[cs]e)?
zlib | 4 | 0.6 | zlib licensed/style | zlib (?:licensed|style licen[cs]e)
boost-1 | 6 | 0.8 | boost software | (?:the )?boost software licen[cs]e(?: version)?(?: 1 0)?
boost-1 | 5 | 0.7 | bsl 1 | bsl 1 0
busl-1.1 | 7 | 0.9 | busl/bsl 1 | (?:busl|bsl) 1 1
busl-1.1 | 7 | 0.9 | business source | (?:the )?business source licen[cs]e(?: version)?(?: 1 1)?
sspl-1 | 7 | 0.9 | sspl/side | (?:sspl(?: v?1)?|server side public licen[cs]e(?: version 1| v?1)?)
elastic-2 | 7 | 0.9 | elastic | (?:the )?elastic licen[cs]e(?: version)?(?: v?2(?: 0)?)?
polyform-nc | 7 | 0.8 | polyform | polyform non ?commercial(?: licen[cs]e)?(?: 1 0 0)?
polyform-small | 7 | 0.8 | polyform | polyform small business(?: licen[cs]e)?(?: 1 0 0)?
commons-clause | 6 | 0.8 | commons clause | (?:the )?commons clause(?: licen[cs]e)?(?: condition)?(?: v?1 0)?
ofl-1.1 | 7 | 0.9 | sil font | (?:the )?sil open font licen[cs]e(?: version)?(?: v?1 1)?
ofl-1.1 | 6 | 0.8 | ofl | ofl (?:v)?1 1
odbl-1 | 7 | 0.9 | odbl | (?:odc )?odbl(?: v?1 0)?
odbl-1 | 7 | 0.9 | database open | (?:the )?open (?:data commons open )?database licen[cs]e(?: v?1 0)?
odc-by-1 | 7 | 0.9 | odc by | odc by(?: v?1 0)?
pddl-1 | 7 | 0.9 | pddl/dedication | (?:odc )?pddl(?: v?1 0)?
cddl-1.1 | 7 | 0.9 | cddl 1/v1 | cddl (?:version |v)?1 1
cddl-1 | 6 | 0.8 | cddl 1/v1 | cddl (?:version |v)?1(?: 0)?
python-2 | 6 | 0.8 | psf/python 2 | (?:psf|python(?: software foundation)?) licen[cs]e (?:version )?2
postgresql | 6 | 0.8 | postgresql license/licence | (?:the )?postgresql licen[cs]e
mulan-2 | 7 | 0.9 | mulan | mulan psl v2|mulan permissive software licen[cs]e(?: version)?(?: v?2)?
upl-1 | 6 | 0.8 | upl/universal | (?:the )?universal permissive licen[cs]e(?: upl)?(?: version| v)?(?: 1 0)?|upl 1 0
ms-pl | 6 | 0.8 | ms pl | ms pl(?: licen[cs]e)?
ms-rl | 6 | 0.8 | ms rl | ms rl(?: licen[cs]e)?
osl-3 | 6 | 0.8 | osl 3/v3 | osl (?:v)?3(?: 0)?
afl-3 | 6 | 0.8 | afl 3/v3 | afl (?:v)?3(?: 0)?
ecl-2 | 6 | 0.8 | ecl 2/v2 | ecl (?:v)?2(?: 0)?
hippocratic | 6 | 0.7 | hippocratic | (?:the )?hippocratic licen[cs]e(?: 2 1| 3 0)?
anti-996 | 6 | 0.7 | 996 | anti 996 licen[cs]e
"""

# Words before a notice that take it back.
NOT = r"(?:not|never|no longer|isn t|aren t|wasn t|cannot be|can not be) (?:yet |currently |itself )?(?:be |been )?"


def _line(text: str, n: int) -> list[str]:
    # `|` also stands inside patterns; fields are parted by it between spaces.
    parts = [x.strip() for x in text.split(" | ")]
    if len(parts) != n:
        raise ValueError(text)
    return parts


def _gate(text: str) -> tuple[tuple[str, ...], ...]:
    return tuple(tuple(place.split("/")) for place in text.split())


def identifiers() -> list[tuple[str, re.Pattern]]:
    """(label, pattern) of the identifiers that may follow in an expression such as ``Apache-2.0 OR MIT``."""
    found = [(label, re.compile(rf"{spdx}(?!\S)")) for label, spdx, *_ in (_line(line, 5) for line in FAMILIES.strip().splitlines())]
    more = ("lgpl-2.1-or-later", "lgpl 2 1 or later"), ("lgpl-3-or-later", "lgpl 3 0 or later"), ("agpl-3-or-later", "agpl 3 0 or later")
    return found + [(label, re.compile(rf"{spdx}(?!\S)")) for label, spdx in more]


def rules() -> list[Rule]:
    """All rules: the forms of each family, then the single ones, in full and in short.

    A notice that is taken back ("not licensed under ...") is a detection of the kind ``negated``, which holds
    the notice within it and gives no label.
    """
    out = []
    for line in FAMILIES.strip().splitlines():
        label, spdx, name, gate, address = _line(line, 5)
        specific = 1 if re.search(r"\d", label) else 0
        end = "" if re.search(r"licen|unlicense|perl itself", name) else r" licen[cs]e"
        out += [
            Rule(label, "identifier", rf"spdx license identifier {spdx}", _gate("spdx identifier"), 8 + specific, 1.0),
            Rule(label, "notice", rf"(?:licen[cs]ed|released|distributed|available|published|provided|made available) under (?:the )?(?:terms of )?(?:the )?{name}{end}", _gate(f"under {gate}"), 6 + specific, 0.9),
            Rule(label, "field", rf"licen[cs]e (?:is )?{name}", _gate(f"license/licence {gate}"), 4 + specific, 0.7),
        ]
        denied = rf"{NOT}(?:licen[cs]ed|released|distributed|available|published|provided|covered) (?:under|by) (?:the )?(?:terms of )?(?:the )?{name}(?:{end or ' licen[cs]e'})?"
        out.append(Rule(f"not {label}", "negated", denied, _gate(f"under/by not/never/longer/isn/aren/wasn/cannot {gate}"), 20, 0.0))
        if address != "-":
            out.append(Rule(label, "address", rf"(?:https? )?(?:www )?{address}", _gate(re.findall(r"[a-z0-9]+", address)[0]), 7 + specific, 0.9))
        if end or "licen" in name:
            out.append(Rule(label, "name", f"{name}{end}", _gate(gate), 3 + specific, 0.6))
    for line in [*SINGLE.strip().splitlines(), *SHORT.strip().splitlines()]:
        label, priority, weight, gate, pattern = _line(line, 5)
        out.append(Rule(label, "text", pattern.replace("\\\\", "\\"), _gate(gate), int(priority), float(weight)))
    return out
