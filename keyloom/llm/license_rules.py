"""Hand-written license signatures, in order.

They match normalised text: lower-cased words joined by single spaces (a dot,
dash or slash separates words: "apache 2.0" reads "apache 2 0"). One line a
license: label, what the license is called, its SPDX identifiers, and sentences
of its own text.
"""

from __future__ import annotations

#: label | names | spdx | sentences; several patterns of a kind are parted by " ;; ".
LICENSES = r"""
mit | (?:the )?mit(?: x11)? licen[cs]e ;; expat licen[cs]e | mit | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files ;; the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit-0 | mit no attribution ;; mit 0 licen[cs]e | mit 0 | permission is hereby granted .{0,140}without restriction including without limitation .{0,120}to permit persons to whom the software is furnished to do so the software is provided
apache-2 | (?:the )?apache(?: software)? licen[cs]e(?: version)? 2(?: 0)? ;; apache 2 0 licen[cs]e ;; (?:the )?asl 2 0 | apache 2 0 | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis ;; you may obtain a copy of the license at https? (?:www )?apache org licenses license 2 0 ;; licenses this file to you under the apache license
apache-1.1 | (?:the )?apache(?: software)? licen[cs]e(?: version)? 1 1 | apache 1 1 | this product includes software developed by the apache software foundation
apache-1.0 | (?:the )?apache(?: software)? licen[cs]e(?: version)? 1 0 | apache 1 0 | this product includes software developed by the apache group
gpl-1 | gnu general public licen[cs]e(?: as published by the free software foundation)? (?:version|v) ?1 ;; gpl ?v?1(?: 0)? | gpl 1 0(?: only| or later)? | either version 1 or at your option any later version
gpl-2 | gnu general public licen[cs]e(?: as published by the free software foundation)? (?:version|v) ?2(?: 0)? ;; gnu gpl (?:version |v) ?2(?: 0)? ;; gpl ?v ?2(?: 0)? | gpl 2 0(?: only| or later)? | either version 2 of the license or at your option any later version ;; gnu general public license version 2 june 1991
gpl-3 | gnu general public licen[cs]e(?: as published by the free software foundation)? (?:version|v) ?3(?: 0)? ;; gnu gpl (?:version |v) ?3(?: 0)? ;; gpl ?v ?3(?: 0)? | gpl 3 0(?: only| or later)? | either version 3 of the license or at your option any later version ;; gnu general public license version 3 29 june 2007
gpl | gnu general public licen[cs]e ;; gnu gpl | gpl | you should have received a copy of the gnu general public license along with this program
lgpl-2 | gnu library general public licen[cs]e (?:version|v) ?2(?: 0)? ;; lgpl ?v ?2(?: 0)? | lgpl 2 0(?: only| or later)? | gnu library general public license as published by the free software foundation
lgpl-2.1 | gnu lesser general public licen[cs]e(?: as published by the free software foundation)? (?:version|v) ?2 1 ;; lgpl ?v ?2 1 | lgpl 2 1(?: only| or later)? | gnu lesser general public license version 2 1 february 1999
lgpl-3 | gnu lesser general public licen[cs]e(?: as published by the free software foundation)? (?:version|v) ?3(?: 0)? ;; lgpl ?v ?3(?: 0)? | lgpl 3 0(?: only| or later)? | gnu lesser general public license version 3 29 june 2007
lgpl | gnu (?:lesser|library) general public licen[cs]e ;; gnu lgpl | lgpl | you should have received a copy of the gnu lesser general public license
agpl-3 | gnu affero general public licen[cs]e(?: as published by the free software foundation)? (?:version|v) ?3(?: 0)? ;; agpl ?v ?3(?: 0)? | agpl 3 0(?: only| or later)? | remote network interaction use with the gnu general public license
agpl-1 | affero general public licen[cs]e (?:version|v) ?1(?: 0)? | agpl 1 0(?: only| or later)? | this license is based on the gnu general public license affero
gfdl | gnu free documentation licen[cs]e(?: (?:version|v) ?1 [123])? ;; gfdl(?: 1 [123])? | gfdl 1 [123](?: only| or later)? | with no invariant sections no front cover texts and no back cover texts
bsd-2 | (?:the )?(?:simplified|freebsd) bsd licen[cs]e ;; (?:the )?(?:bsd 2|2|two) clause (?:bsd )?licen[cs]e | bsd 2 clause(?: patent| views)? | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided
bsd-3 | (?:the )?(?:new|modified|revised) bsd licen[cs]e ;; (?:the )?(?:bsd 3|3|three) clause (?:bsd )?licen[cs]e | bsd 3 clause(?: clear| attribution)? | neither the names? of .{1,80} nor the names of its contributors may be used to endorse or promote products derived from this software
bsd-4 | (?:the )?(?:original|old) bsd licen[cs]e ;; (?:the )?(?:bsd 4|4|four) clause (?:bsd )?licen[cs]e | bsd 4 clause(?: uc)? | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd | bsd(?: style)? licen[cs]e | bsd | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
0bsd | (?:bsd )?zero clause (?:bsd )?licen[cs]e | 0bsd | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided
isc | (?:the )?isc licen[cs]e | isc | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
mpl-1.0 | mozilla public licen[cs]e(?: (?:version|v))? 1 0 ;; mpl ?v?1 0 | mpl 1 0 | the contents of this file are subject to the mozilla public license version 1 0
mpl-1.1 | mozilla public licen[cs]e(?: (?:version|v))? 1 1 ;; mpl ?v?1 1 | mpl 1 1 | the contents of this file are subject to the mozilla public license version 1 1
mpl-2 | mozilla public licen[cs]e(?: (?:version|v))? 2(?: 0)? ;; mpl ?v?2(?: 0)? | mpl 2 0(?: no copyleft exception)? | this source code form is subject to the terms of the mozilla public license v 2 0
epl-1 | eclipse public licen[cs]e(?: (?:version|v))? 1(?: 0)? ;; epl ?v?1 0 | epl 1 0 | the accompanying program is provided under the terms of this eclipse public license
epl-2 | eclipse public licen[cs]e(?: (?:version|v))? 2(?: 0)? ;; epl ?v?2 0 | epl 2 0 | this program and the accompanying materials are made available under the terms of the eclipse public license 2 0
edl-1 | eclipse distribution licen[cs]e(?: (?:version|v))? ?1(?: 0)? | edl 1 0 | eclipse org org documents edl v10
cddl-1 | common development and distribution licen[cs]e(?: (?:version|v))? ?1(?: 0)? ;; cddl ?v?1 0 | cddl 1 0 | the contents of this file are subject to the terms of the common development and distribution license
cddl-1.1 | common development and distribution licen[cs]e(?: (?:version|v))? ?1 1 ;; cddl ?v?1 1 | cddl 1 1 | opensource org licenses cddl 1 1
cpl-1 | common public licen[cs]e(?: (?:version|v))? ?1(?: 0)? | cpl 1 0 | the accompanying program is provided under the terms of this common public license
ipl-1 | ibm public licen[cs]e(?: (?:version|v))? ?1(?: 0)? | ipl 1 0 | the accompanying program is provided under the terms of this ibm public license
eupl-1.1 | european union public licen[cs]e(?: (?:version|v))? ?1 1 ;; eupl ?v?1 1 | eupl 1 1 | licensed under the eupl version 1 1
eupl-1.2 | european union public licen[cs]e(?: (?:version|v))? ?1 2 ;; eupl ?v?1 2 | eupl 1 2 | licensed under the eupl version 1 2
cecill | cecill(?: free software)? licen[cs]e(?: agreement)? ;; cecill (?:version|v) ?2(?: [01])? | cecill (?:1 0|1 1|2 0|2 1|b|c) | ce logiciel est régi par la licence cecill
artistic-1 | artistic licen[cs]e(?: (?:version|v))? 1(?: 0)? | artistic 1 0(?: cl8| perl)? | the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control
artistic-2 | artistic licen[cs]e(?: (?:version|v))? 2(?: 0)? | artistic 2 0 | this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed
perl | same terms as perl(?: itself)? ;; under the perl licen[cs]e | artistic 1 0 perl or gpl 1 0 or later | you may distribute under the terms of either the gnu general public license or the artistic license
zlib | (?:the )?zlib(?: libpng)? licen[cs]e | zlib(?: acknowledgement)? | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
libpng | libpng licen[cs]e(?: version 2)? ;; png reference library licen[cs]e | libpng(?: 2 0)? | the png reference library is supplied as is
boost | boost software licen[cs]e(?: (?:version|v) ?1(?: 0)?)? | bsl 1 0 | boost org license 1 0 txt ;; permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
unlicense | (?:the )?unlicen[cs]e | unlicense | this is free and unencumbered software released into the public domain
wtfpl | wtfpl(?: (?:version|v) ?2)? ;; do what the fuck you want to public licen[cs]e | wtfpl | you just do what the fuck you want to
beerware | (?:the )?beer ?ware licen[cs]e | beerware | if we meet some day and you think this stuff is worth it you can buy me a beer in return
postgresql | postgresql licen[cs]e | postgresql | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
python-2 | python software foundation licen[cs]e(?: (?:version|v) ?2)? ;; psf licen[cs]e | (?:python 2 0|psf 2 0) | psf hereby grants licensee a nonexclusive royalty free world wide license
php-3 | php licen[cs]e(?: (?:version|v))? 3(?: 01?)? | php 3 01? | this product includes php software freely available from
ruby | ruby licen[cs]e ;; same (?:terms|licen[cs]e) as ruby | ruby | you may make and give away verbatim copies of the source form of the software without restriction
openssl | openssl licen[cs]e ;; original ssleay licen[cs]e | openssl | this product includes software developed by the openssl project
ncsa | university of illinois ncsa(?: open source)? licen[cs]e | ncsa | university of illinois urbana champaign nor the names of its contributors
curl | (?:the )?curl licen[cs]e | curl | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided
openldap | openldap public licen[cs]e(?: (?:version|v) ?2 8)? | oldap 2 [0-8] | the name openldap is a registered trademark
w3c | w3c software (?:notice and )?licen[cs]e ;; w3c document licen[cs]e | w3c(?: 19980720| 20150513)? | by obtaining using and or copying this work you the licensee agree that you have read understood and will comply with the following terms
x11 | x11 licen[cs]e | x11 | except as contained in this notice the name of the x consortium shall not be used in advertising
afl-3 | academic free licen[cs]e(?: (?:version|v))? ?[123] ?[012]? | afl (?:1 [12]|2 [01]|3 0) | licensed under the academic free license version 3 0
osl-3 | open software licen[cs]e(?: (?:version|v))? ?[123] ?[01]? | osl (?:1 [01]|2 [01]|3 0) | licensed under the open software license version 3 0
ms-pl | microsoft public licen[cs]e ;; ms pl licen[cs]e | ms pl | this license governs use of the accompanying software if you use the software you accept this license
ms-rl | microsoft reciprocal licen[cs]e | ms rl | for any file you distribute that contains code from the software in source code or binary format you must provide recipients the source code
ofl-1.1 | sil open font licen[cs]e(?: (?:version|v))? ?1 [01] ;; ofl ?v?1 1 | ofl 1 [01](?: rfn| no rfn)? | this font software is licensed under the sil open font license
ubuntu-font | ubuntu font licen[cs]e(?: (?:version|v) ?1 0)? | ubuntu font 1 0 | the font software must remain entirely under this licence
bsl-1.1 | business source licen[cs]e(?: (?:version|v))? ?1 1 | busl 1 1 | the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work
sspl-1 | server side public licen[cs]e(?: (?:version|v) ?1)? ;; sspl ?v?1 | sspl 1 0 | making the functionality of the program or modified version available to third parties as a service
elastic-2 | elastic licen[cs]e(?: (?:version|v))? ?2(?: 0)? | elastic 2 0 | you may not provide the software to third parties as a hosted or managed service
commons-clause | commons clause(?: licen[cs]e condition)?(?: v ?1 0)? | commons clause | the grant of rights under the license will not include and the license does not grant to you the right to sell the software
polyform-nc | polyform noncommercial licen[cs]e(?: 1 0 0)? | polyform noncommercial 1 0 0 | any noncommercial purpose is a permitted purpose
cc0 | cc0(?: 1 0)?(?: universal)? ;; creative commons zero(?: v?1 0)?(?: universal)? | cc0 1 0 | creativecommons org publicdomain zero 1 0 ;; the person who associated a work with this deed has dedicated the work to the public domain
cc-by-nc-nd | cc by nc nd(?: [1234] 0)? ;; (?:creative commons )?attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [1234] 0)? | cc by nc nd [1234] 0 | creativecommons org licenses by nc nd [1234] 0
cc-by-nc-sa | cc by nc sa(?: [1234] 0)? ;; (?:creative commons )?attribution non ?commercial share ?alike(?: [1234] 0)? | cc by nc sa [1234] 0 | creativecommons org licenses by nc sa [1234] 0
cc-by-nc | cc by nc(?: [1234] 0)? ;; creative commons attribution non ?commercial(?: [1234] 0)? | cc by nc [1234] 0 | creativecommons org licenses by nc [1234] 0
cc-by-nd | cc by nd(?: [1234] 0)? ;; creative commons attribution no ?deriv(?:ative)?s?(?: [1234] 0)? | cc by nd [1234] 0 | creativecommons org licenses by nd [1234] 0
cc-by-sa | cc by sa(?: [1234] 0)? ;; creative commons attribution share ?alike(?: [1234] 0)? | cc by sa [1234] 0 | creativecommons org licenses by sa [1234] 0
cc-by | cc by(?: [1234] 0)? ;; creative commons attribution(?: [1234] 0)?(?: international| generic| unported)? | cc by [1234] 0 | creativecommons org licenses by [1234] 0
odbl | open (?:data commons open )?database licen[cs]e(?: (?:version|v)? ?1 0)? ;; odbl(?: 1 0)? | odbl 1 0 | opendatacommons org licenses odbl
odc-by | open data commons attribution licen[cs]e ;; odc by(?: 1 0)? | odc by 1 0 | opendatacommons org licenses by
pddl | public domain dedication and licen[cs]e ;; pddl(?: 1 0)? | pddl 1 0 | opendatacommons org licenses pddl
ogl-uk | open government licen[cs]e(?: v ?[123](?: 0)?)? | ogl uk [123] 0 | contains public sector information licensed under the open government licence
openrail | (?:creativeml |bigscience )?open ?rail(?: m)?(?: licen[cs]e)? ;; responsible ai licen[cs]e | openrail | use based restrictions as referenced in paragraph
llama | llama [234](?: [0-9])? community licen[cs]e(?: agreement)? | llama [234](?: [0-9])? community | meta llama [234] is licensed under the
public-domain | (?:released|dedicated|placed) (?:in|in ?to) the public domain ;; public domain dedication | public domain | this (?:work|file|code|software) is (?:in|dedicated to) the public domain
proprietary | proprietary licen[cs]e ;; proprietary and confidential ;; commercial licen[cs]e agreement | proprietary | unauthorized copying of this file via any medium is strictly prohibited
json | json licen[cs]e | json | the software shall be used for good not evil
vim | vim licen[cs]e | vim | you must make your changes to vim available to the maintainer
upl-1 | universal permissive licen[cs]e(?: (?:version|v) ?1 0)? | upl 1 0 | the larger works to which the software is contributed
blueoak-1 | blue oak model licen[cs]e(?: (?:version|v)? ?1 0 0)? | blueoak 1 0 0 | this license gives everyone as much permission to work with this software as possible
unicode | unicode(?: inc)? licen[cs]e agreement(?: data files and software)? | unicode (?:dfs 201[56]|3 0) | permission is hereby granted free of charge to any person obtaining a copy of the unicode data files
tcl | tcl tk licen[cs]e | tcl | this software is copyrighted by the regents of the university of california sun microsystems inc scriptics corporation
sleepycat | sleepycat licen[cs]e | sleepycat | redistributions in any form must be accompanied by information on how to obtain complete source code for the db software
qpl-1 | q public licen[cs]e(?: (?:version|v)? ?1 0)? | qpl 1 0 | the intent of this license is to establish freedom to share and change the software regulated by this license
lppl | latex project public licen[cs]e(?: (?:version|v)? ?1 [0-3]c?)? ;; lppl ?v?1 [0-3]c? | lppl 1 [0-3]c? | this work may be distributed and or modified under the conditions of the latex project public license
"""

#: What leads to a name in running text.
LEADS = r"(?:licen[cs]ed|released|distributed|available|published|provided|shared|issued|offered|covered)(?: to you)? (?:under|by|with)(?: the)?(?: terms(?: and conditions)? of(?: the)?)?"
