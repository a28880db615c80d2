"""Signature rules of licences: label, priority (percent of confidence), keywords, expression.

An expression is over lower-case words joined by single blanks, and a blank in it separates two words. A match has one of
the rule's keywords among its words; that is what gates the rule. No expression repeats a blank, so a match
has at most as many words as the expression has blanks and one more.
"""

from __future__ import annotations

# The rules, by licence. "@" may be a phrase that puts something under a licence.
_TEXT = r"""
mit | 98 | hereby | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | 96 | sublicense | without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software
mit | 90 | mit expat | (?:is |are )?(?:re)?licen[cs]ed under (?:the )?(?:terms of )?(?:the )?(?:mit|expat)(?: x11)?(?: licen[cs]e)?
mit | 88 | mit expat | (?:released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?(?:mit|expat)(?: licen[cs]e)?
mit | 100 | spdx | spdx license identifier mit
mit | 85 | opensource | opensource org licenses mit(?: license)?
mit | 75 | mit expat | licen[cs]e (?:mit|expat)
mit | 70 | mit | (?:a copy of|see|read) the mit licen[cs]e
mit | 60 | mit expat | (?:mit|expat) licen[cs]e
mit-0 | 97 | mit | mit no attribution(?: licen[cs]e)?
mit-0 | 100 | spdx | spdx license identifier mit 0
x11 | 80 | x11 | (?:the )?x11 licen[cs]e
x11 | 96 | consortium | except as contained in this notice the name of the x consortium shall not be used in advertising
isc | 98 | fee | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | 100 | spdx | spdx license identifier isc
isc | 90 | isc | (?:licen[cs]ed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?isc(?: licen[cs]e)?
isc | 60 | isc | isc licen[cs]e
apache-1 | 96 | apache | redistributions in any form whatsoever must retain the following acknowledgment this product includes software developed by the apache
apache-1 | 90 | apache | apache (?:software )?licen[cs]e (?:version |v)?1(?: [01])?
apache-2 | 99 | apache | licen[cs]ed under the apache licen[cs]e version 2(?: 0)? the license
apache-2 | 92 | apache | (?:is |are )?(?:re)?licen[cs]ed under (?:the )?(?:terms of )?(?:the )?apache(?: software)?(?: licen[cs]e)?(?: version)? v?2(?: 0)?
apache-2 | 88 | apache | (?:released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?apache(?: licen[cs]e)?(?: version)? v?2(?: 0)?
apache-2 | 100 | spdx | spdx license identifier apache 2 0
apache-2 | 95 | apache | (?:www )?apache org licenses license 2 0
apache-2 | 90 | apache | you may obtain a copy of the license at (?:https? )?(?:www )?apache org licenses
apache-2 | 80 | apache | apache(?: software)? licen[cs]e(?: version)? v?2(?: 0)?
apache-2 | 75 | apache2 | apache2(?: licen[cs]e)?
apache-2 | 70 | asl | asl 2(?: 0)?
apache-2 | 70 | apache | apache 2 0
apache-2 | 85 | limitations | see the license for the specific language governing permissions and limitations under the license
bsd-2-clause | 100 | spdx | spdx license identifier bsd 2 clause
bsd-2-clause | 90 | bsd | @(?:simplified bsd|bsd 2 clause|2 clause bsd|two clause bsd)(?: licen[cs]e)?
bsd-2-clause | 85 | freebsd | freebsd licen[cs]e
bsd-2-clause | 85 | bsd | opensource org licenses bsd 2 clause
bsd-3-clause | 97 | endorse | neither the name of [a-z]+ (?:[a-z]+ )?(?:[a-z]+ )?nor the names of its contributors may be used to endorse or promote products
bsd-3-clause | 100 | spdx | spdx license identifier bsd 3 clause
bsd-3-clause | 90 | bsd | @(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd)(?: licen[cs]e)?
bsd-3-clause | 85 | bsd | opensource org licenses bsd 3 clause
bsd-3-clause | 80 | bsd | bsd style licen[cs]e that can be found in the license file
bsd-4-clause | 97 | advertising | all advertising materials mentioning features or use of this software must display the following acknowledgement
bsd-4-clause | 100 | spdx | spdx license identifier bsd 4 clause
bsd-4-clause | 90 | bsd | @(?:original bsd|bsd 4 clause|4 clause bsd|four clause bsd)(?: licen[cs]e)?
0bsd | 100 | spdx | spdx license identifier 0bsd
0bsd | 90 | 0bsd bsd | @(?:0bsd|zero clause bsd|bsd zero clause)(?: licen[cs]e)?
bsd | 97 | binary | redistribution and use in source and binary forms with or without modification are permitted
bsd | 75 | bsd | (?:licen[cs]ed|released|distributed|available) under (?:the )?(?:terms of )?(?:the |a )?bsd(?: style)?(?: licen[cs]e)?
bsd | 55 | bsd | bsd licen[cs]e
gpl-1 | 90 | general | @gnu general public licen[cs]e version 1
gpl-2 | 98 | either | general public license as published by the free software foundation either version 2 of the license or
gpl-2 | 100 | spdx | spdx license identifier gpl 2 0(?: only| or later)?
gpl-2 | 90 | general | @(?:gnu )?general public licen[cs]e(?: version)? v?2(?: 0)?
gpl-2 | 88 | gpl | @(?:gnu )?gpl(?: version)? v?2(?: 0)?(?: only| or later)?
gpl-2 | 88 | gplv2 gpl2 | @(?:gnu )?(?:gplv2|gpl2)
gpl-2 | 85 | gpl | gnu org licenses (?:old licenses )?gpl 2 0
gpl-3 | 98 | either | general public license as published by the free software foundation either version 3 of the license or
gpl-3 | 100 | spdx | spdx license identifier gpl 3 0(?: only| or later)?
gpl-3 | 90 | general | @(?:gnu )?general public licen[cs]e(?: version)? v?3(?: 0)?
gpl-3 | 88 | gpl | @(?:gnu )?gpl(?: version)? v?3(?: 0)?(?: only| or later)?
gpl-3 | 88 | gplv3 gpl3 | @(?:gnu )?(?:gplv3|gpl3)
gpl-3 | 85 | gpl | gnu org licenses gpl 3 0
gpl | 97 | redistribute | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl | 92 | fitness | without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license
gpl | 90 | received | you should have received a copy of the gnu general public license along with this program
gpl | 75 | gpl general | (?:licen[cs]ed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:gpl|general public licen[cs]e)
gpl | 60 | general | gnu general public licen[cs]e
gpl | 50 | gpl | gpl licen[cs]e
lgpl-2 | 98 | library | gnu library general public license as published by the free software foundation either version 2 of the license
lgpl-2 | 98 | lesser | gnu lesser general public license as published by the free software foundation either version 2 1 of the license
lgpl-2 | 100 | spdx | spdx license identifier lgpl 2 [01](?: only| or later)?
lgpl-2 | 90 | lesser library | @(?:gnu )?(?:lesser|library) general public licen[cs]e(?: version)? v?2(?: [01])?
lgpl-2 | 88 | lgpl | @(?:gnu )?lgpl(?: version)? v?2(?: [01])?(?: only| or later)?
lgpl-2 | 88 | lgplv2 lgpl2 | @(?:gnu )?(?:lgplv2|lgpl2)(?: 1)?
lgpl-3 | 98 | lesser | gnu lesser general public license as published by the free software foundation either version 3 of the license
lgpl-3 | 100 | spdx | spdx license identifier lgpl 3 0(?: only| or later)?
lgpl-3 | 90 | lesser | @(?:gnu )?lesser general public licen[cs]e(?: version)? v?3(?: 0)?
lgpl-3 | 88 | lgpl | @(?:gnu )?lgpl(?: version)? v?3(?: 0)?(?: only| or later)?
lgpl-3 | 88 | lgplv3 lgpl3 | @(?:gnu )?(?:lgplv3|lgpl3)
lgpl | 97 | redistribute | this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
lgpl | 75 | lgpl lesser | (?:licen[cs]ed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:lgpl|lesser general public licen[cs]e)
lgpl | 62 | lesser | (?:gnu )?lesser general public licen[cs]e
lgpl | 52 | lgpl | lgpl licen[cs]e
agpl-3 | 98 | affero | gnu affero general public license as published by the free software foundation either version 3 of the license
agpl-3 | 100 | spdx | spdx license identifier agpl 3 0(?: only| or later)?
agpl-3 | 90 | affero | (?:gnu )?affero general public licen[cs]e(?: version)? v?3(?: 0)?
agpl-3 | 88 | agpl | (?:gnu )?agpl(?: version)? v?3(?: 0)?
agpl-3 | 88 | agplv3 agpl3 | (?:gnu )?(?:agplv3|agpl3)
agpl | 64 | affero | (?:gnu )?affero general public licen[cs]e
agpl | 54 | agpl | agpl licen[cs]e
mpl-1 | 96 | mozilla | the contents of this file are subject to the mozilla public license version 1 [01]
mpl-1 | 100 | spdx | spdx license identifier mpl 1 [01]
mpl-1 | 90 | mozilla | mozilla public licen[cs]e(?: version)? v?1(?: [01])?
mpl-1 | 85 | mpl | mpl(?: version)? v?1(?: [01])?
mpl-1 | 85 | mplv1 | mplv1
mpl-2 | 98 | mozilla | this source code form is subject to the terms of the mozilla public license (?:version 2|v 2|v2) 0
mpl-2 | 100 | spdx | spdx license identifier mpl 2 0
mpl-2 | 90 | mozilla | mozilla public licen[cs]e(?: version)? v?2(?: 0)?
mpl-2 | 85 | mpl | mpl(?: version)? v?2(?: 0)?
mpl-2 | 85 | mplv2 mpl2 | (?:mplv2|mpl2)
mpl-2 | 90 | mozilla | mozilla org (?:en us )?mpl 2 0
mpl | 60 | mozilla | mozilla public licen[cs]e
epl-1 | 100 | spdx | spdx license identifier epl 1 0
epl-1 | 96 | eclipse | made available under the terms of the eclipse public license v1 0
epl-1 | 90 | eclipse | eclipse public licen[cs]e(?: version)? v?1(?: 0)?
epl-1 | 85 | epl | epl(?: version)? v?1(?: 0)?
epl-1 | 85 | eplv1 | eplv1
epl-2 | 100 | spdx | spdx license identifier epl 2 0
epl-2 | 96 | eclipse | made available under the terms of the eclipse public license 2 0
epl-2 | 90 | eclipse | eclipse public licen[cs]e(?: version)? v?2(?: 0)?
epl-2 | 85 | epl | epl(?: version)? v?2(?: 0)?
epl-2 | 85 | eplv2 | eplv2
epl | 60 | eclipse | eclipse public licen[cs]e
edl-1 | 90 | eclipse | eclipse distribution licen[cs]e(?: version)? v?1(?: 0)?
eupl-1 | 100 | spdx | spdx license identifier eupl 1 [012]
eupl-1 | 95 | eupl | licen[cs]ed under the eupl(?: version)? v?1(?: [012])?
eupl-1 | 90 | european | european union public licen[cs]e(?: version)?(?: v?1)?(?: [012])?
eupl-1 | 85 | eupl | eupl(?: version)? v?1(?: [012])?
eupl-1 | 85 | eupl12 euplv1 | (?:eupl12|euplv1)
cddl-1 | 97 | common | subject to the terms of the common development and distribution license
cddl-1 | 100 | spdx | spdx license identifier cddl 1 [01]
cddl-1 | 85 | cddl | cddl(?: version)?(?: v?1)?(?: [01])?
cddl-1 | 80 | common | common development and distribution licen[cs]e
cpl-1 | 90 | common | common public licen[cs]e(?: version)?(?: v?1)?(?: 0)?
cpal-1 | 90 | attribution | common public attribution licen[cs]e
ipl-1 | 88 | ibm | ibm public licen[cs]e(?: version)?(?: v?1)?(?: 0)?
artistic-1 | 90 | artistic | (?:the )?artistic licen[cs]e(?: version)? 1(?: 0)?
artistic-2 | 100 | spdx | spdx license identifier artistic 2 0
artistic-2 | 90 | artistic | (?:the )?artistic licen[cs]e(?: version)? 2(?: 0)?
artistic | 65 | artistic | (?:the )?artistic licen[cs]e
perl | 88 | perl | (?:under |on )the same terms as perl(?: itself)?
zlib | 97 | altered | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib | 95 | warranty | this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib | 100 | spdx | spdx license identifier zlib
zlib | 75 | zlib | (?:the )?zlib(?: libpng)? licen[cs]e
libpng | 75 | libpng | (?:the )?libpng licen[cs]e
bsl-1 | 98 | boost | distributed under the boost software license version 1 0
bsl-1 | 100 | spdx | spdx license identifier bsl 1 0
bsl-1 | 90 | boost | boost software licen[cs]e(?: version)?(?: v?1)?(?: 0)?
busl-1 | 90 | business | business source licen[cs]e(?: version)? 1 1
busl-1 | 100 | spdx | spdx license identifier busl 1 1
sspl-1 | 92 | side | server side public licen[cs]e
sspl-1 | 85 | sspl | sspl(?: version)? v?1
elastic-2 | 92 | elastic | elastic licen[cs]e(?: version)? v?2(?: 0)?
unlicense | 98 | unencumbered | this is free and unencumbered software released into the public domain
unlicense | 100 | spdx | spdx license identifier unlicense
unlicense | 90 | unlicense | (?:released|dedicated|licen[cs]ed|distributed) (?:under|with|by) the unlicense
unlicense | 80 | unlicense | unlicense org
unlicense | 55 | unlicense | the unlicense
wtfpl | 97 | wtfpl | do what the fuck you want to public licen[cs]e wtfpl
wtfpl | 95 | fuck | do what the fuck you want to public licen[cs]e
wtfpl | 80 | wtfpl | (?:the )?wtfpl(?: licen[cs]e)?
beerware | 95 | beer | if we meet some day and you think this stuff is worth it you can buy me a beer
beerware | 85 | beerware | (?:the )?beerware licen[cs]e
beerware | 85 | beer | (?:the )?beer ware licen[cs]e
psf-2 | 95 | python | python software foundation licen[cs]e(?: version)?(?: 2)?
psf-2 | 80 | psf | psf licen[cs]e(?: version)?(?: 2)?
postgresql | 90 | postgresql | (?:the )?postgresql licen[cs]e
openssl | 90 | openssl | (?:the )?openssl licen[cs]e
openssl | 95 | toolkit | developed by the openssl project for use in the openssl toolkit
ncsa | 92 | ncsa | (?:university of illinois )?ncsa open source licen[cs]e
ncsa | 70 | ncsa | ncsa licen[cs]e
php-3 | 92 | php | php licen[cs]e(?: version)? v?3(?: 0| 01)?
ruby | 80 | ruby | (?:the )?ruby licen[cs]e
ruby | 85 | ruby | (?:under |on )the same terms as ruby(?: itself)?
w3c | 92 | w3c | w3c software (?:notice and )?licen[cs]e
upl-1 | 92 | universal | universal permissive licen[cs]e(?: version)?(?: v?1)?(?: 0)?
afl-3 | 92 | academic | academic free licen[cs]e(?: version)?(?: v?3)?(?: 0)?
osl-3 | 92 | osl | osl(?: version)? v?3(?: 0)?
osl-3 | 90 | open | open software licen[cs]e(?: version)? v?3(?: 0)?
ecl-2 | 90 | educational | educational community licen[cs]e(?: version)?(?: v?2)?(?: 0)?
ms-pl | 92 | microsoft | microsoft public licen[cs]e
ms-pl | 85 | ms | ms pl
ms-rl | 92 | microsoft | microsoft reciprocal licen[cs]e
ofl-1 | 98 | sil | this font software is licensed under the sil open font license version 1 1
ofl-1 | 92 | sil | sil open font licen[cs]e(?: version)?(?: v?1)?(?: [01])?
ofl-1 | 90 | font | open font licen[cs]e(?: version)?(?: v?1)?(?: [01])?
ofl-1 | 80 | ofl | ofl(?: version)? v?1(?: [01])?
vim | 88 | vim | (?:the )?vim licen[cs]e
curl | 85 | curl | (?:the )?curl licen[cs]e
ijg | 92 | jpeg | this software is based in part on the work of the independent jpeg group
unicode | 90 | unicode | unicode (?:data files and software )?licen[cs]e agreement
unicode | 85 | unicode | unicode org (?:copyright|license) html
freetype | 92 | freetype | (?:the )?freetype (?:project )?licen[cs]e
imagemagick | 92 | imagemagick | (?:the )?imagemagick licen[cs]e
json | 96 | evil | the software shall be used for good not evil
qpl-1 | 90 | q | (?:the )?q public licen[cs]e
sleepycat | 90 | sleepycat | sleepycat licen[cs]e
zpl-2 | 90 | zope | zope public licen[cs]e(?: version)?(?: 2)?(?: [01])?
cecill-2 | 92 | cecill | cecill(?: [bc])? licen[cs]e
cecill-2 | 80 | cecill | cecill(?: version)? v?2(?: [01])?
mulan-2 | 92 | mulan | mulan (?:psl|permissive software licen[cs]e)(?: version)? v?2
blueoak-1 | 92 | oak | blue oak model licen[cs]e(?: 1 0 0)?
hippocratic | 90 | hippocratic | hippocratic licen[cs]e
polyform | 90 | polyform | polyform (?:noncommercial|small business|shield|strict|free trial) licen[cs]e
prosperity | 90 | prosperity | prosperity public licen[cs]e
commons-clause | 92 | commons | commons clause(?: licen[cs]e condition)?(?: version)?(?: v?1)?(?: 0)?
openrail | 92 | responsible | (?:creativeml )?open responsible ai licen[cs]e
openrail | 88 | openrail | (?:creativeml )?openrail(?: m)?(?: licen[cs]e)?
llama | 90 | llama | llama [234](?: [0-9])? community licen[cs]e
cc0-1 | 98 | waived | has waived all copyright and related or neighboring rights
cc0-1 | 100 | spdx | spdx license identifier cc0 1 0
cc0-1 | 92 | cc0 | (?:creative commons )?cc0(?: 1 0)?(?: universal)?
cc0-1 | 90 | zero | creative commons zero
cc0-1 | 92 | publicdomain | creativecommons org publicdomain zero
cc-by | 100 | spdx | spdx license identifier cc by [1-4] [05]
cc-by | 92 | attribution | creative commons attribution(?: [1-4] [05])?(?: international| unported| generic)?(?: public)? licen[cs]e
cc-by | 85 | cc | cc by [1-4](?: [05])?
cc-by | 90 | creativecommons | creativecommons org licenses by [1-4] [05]
cc-by | 60 | attribution | creative commons attribution
cc-by-sa | 100 | spdx | spdx license identifier cc by sa [1-4] [05]
cc-by-sa | 95 | attribution | creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported| generic)?(?: public)?(?: licen[cs]e)?
cc-by-sa | 90 | cc | cc by sa(?: [1-4](?: [05])?)?
cc-by-sa | 92 | creativecommons | creativecommons org licenses by sa
cc-by-nd | 95 | attribution | creative commons attribution no ?deriv(?:ative)?s?(?: [1-4] [05])?(?: international| unported| generic)?(?: public)?(?: licen[cs]e)?
cc-by-nd | 90 | cc | cc by nd(?: [1-4](?: [05])?)?
cc-by-nd | 92 | creativecommons | creativecommons org licenses by nd
cc-by-nc | 100 | spdx | spdx license identifier cc by nc [1-4] [05]
cc-by-nc | 95 | attribution | creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported| generic)?(?: public)?(?: licen[cs]e)?
cc-by-nc | 90 | cc | cc by nc [1-4](?: [05])?
cc-by-nc | 92 | creativecommons | creativecommons org licenses by nc [1-4] [05]
cc-by-nc-sa | 96 | attribution | creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported| generic)?(?: public)?(?: licen[cs]e)?
cc-by-nc-sa | 92 | cc | cc by nc sa(?: [1-4](?: [05])?)?
cc-by-nc-sa | 93 | creativecommons | creativecommons org licenses by nc sa
cc-by-nc-nd | 96 | attribution | creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: [1-4] [05])?(?: international| unported| generic)?(?: public)?(?: licen[cs]e)?
cc-by-nc-nd | 92 | cc | cc by nc nd(?: [1-4](?: [05])?)?
cc-by-nc-nd | 93 | creativecommons | creativecommons org licenses by nc nd
cc | 55 | creative | (?:under )?(?:a )?creative commons licen[cs]e
odbl-1 | 95 | odbl | (?:licen[cs]ed|available) under the (?:open database licen[cs]e )?odbl(?: 1)?(?: 0)?
odbl-1 | 90 | database | open database licen[cs]e(?: version)?(?: v?1)?(?: 0)?
odc-by-1 | 90 | commons | open data commons attribution licen[cs]e
odc-by-1 | 85 | odc | odc by(?: 1 0)?
pddl-1 | 92 | dedication | public domain dedication and licen[cs]e
pddl-1 | 80 | pddl | pddl(?: version)?(?: v?1)?(?: 0)?
cdla-permissive | 92 | community | community data licen[cs]e agreement permissive
cdla-sharing | 92 | community | community data licen[cs]e agreement sharing
ogl-uk | 92 | government | open government licen[cs]e(?: version)?(?: v?[123])?(?: 0)?
dl-de-by-2 | 90 | deutschland | datenlizenz deutschland (?:namensnennung|zero)(?: version)?(?: 2)?(?: 0)?
etalab-2 | 90 | ouverte | licence ouverte(?: version)?(?: v?2)?(?: 0)?
gfdl-1 | 97 | invariant | with no invariant sections no front cover texts and no back cover texts
gfdl-1 | 92 | documentation | (?:gnu )?free documentation licen[cs]e(?: version)?(?: v?1)?(?: [0123])?
gfdl-1 | 85 | gfdl | gfdl(?: version)?(?: v?1)?(?: [0123])?
public-domain | 88 | domain | (?:has been |is |are |was |were )?(?:dedicated|released|placed|put|committed) (?:in|into|to) the public domain
public-domain | 80 | domain | (?:this|the) (?:work|file|software|code|text|image) is (?:in )?(?:the )?public domain
public-domain | 45 | domain | (?:in )?the public domain
proprietary | 90 | confidential | proprietary and confidential
proprietary | 88 | unauthorized | unauthorized copying of this file via any medium is strictly prohibited
proprietary | 85 | unauthorized | unauthorized (?:copying|reproduction|distribution|use) (?:of this [a-z]+ )?is (?:strictly )?prohibited
proprietary | 80 | reproduced | no part of this (?:publication|book|work|document) may be reproduced
proprietary | 70 | proprietary | (?:this|the) (?:software|work|code) is proprietary
proprietary | 50 | reserved | all rights reserved
proprietary | 55 | alle | alle rechte vorbehalten
proprietary | 55 | tous | tous droits r(?:é|e)serv(?:é|e)s
proprietary | 55 | todos | todos los derechos reservados
freeware | 75 | freeware | (?:this|the) (?:software|program) is freeware
shareware | 75 | shareware | (?:this|the) (?:software|program) is shareware
non-commercial | 82 | commercial | (?:for )?non commercial (?:use|purposes) only
non-commercial | 80 | noncommercial | (?:for )?noncommercial (?:use|purposes) only
non-commercial | 78 | personal | for personal use only
research-only | 80 | research | for (?:academic |non commercial )?research (?:use|purposes) only
evaluation-only | 78 | evaluation | for evaluation (?:use|purposes) only
"""


UNDER = "(?:(?:licen[cs]ed|released|distributed|available) under (?:the )?(?:terms of )?(?:the |a )?)?"


def _rules() -> tuple[tuple[str, int, tuple[str, ...], str], ...]:
    rows = (line.split(" | ") for line in _TEXT.strip().splitlines())
    # " ?" is a separator that may be missing
    return tuple((label, int(priority), tuple(words.split()), text.replace("@", UNDER).replace(" ?", "(?: )?")) for label, priority, words, text in rows)


RULES = _rules()
