"""Signature rules of licenses, written one by one, in order of priority.

A line is: label | keyword | score | regex over normal words (lower case, one
space between). The keyword is a string that begins a word of each match. Rules
that stand earlier win where intervals overlap, so the more telling wordings come
first, and of two that begin alike the longer one.
"""

from __future__ import annotations

#: Identifiers, sentences of the texts, addresses, notices, names in running text, statements of rights.
TABLE = r"""
# Identifiers.
mit-0 | mit | 1.0 | spdx licen[sc]e identifier mit 0
mit | mit | 1.0 | spdx licen[sc]e identifier mit
apache-2 | apache | 1.0 | spdx licen[sc]e identifier apache 2 0
apache-1.1 | apache | 1.0 | spdx licen[sc]e identifier apache 1 1
bsd-2-clause | bsd | 1.0 | spdx licen[sc]e identifier bsd 2 clause
bsd-3-clause | bsd | 1.0 | spdx licen[sc]e identifier bsd 3 clause
bsd-4-clause | bsd | 1.0 | spdx licen[sc]e identifier bsd 4 clause
0bsd | 0bsd | 1.0 | spdx licen[sc]e identifier 0bsd
gpl-2 | gpl | 1.0 | spdx licen[sc]e identifier gpl 2 0(?: only| or later)?
gpl-3 | gpl | 1.0 | spdx licen[sc]e identifier gpl 3 0(?: only| or later)?
lgpl-2.1 | lgpl | 1.0 | spdx licen[sc]e identifier lgpl 2 [01](?: only| or later)?
lgpl-3 | lgpl | 1.0 | spdx licen[sc]e identifier lgpl 3 0(?: only| or later)?
agpl-3 | agpl | 1.0 | spdx licen[sc]e identifier agpl 3 0(?: only| or later)?
mpl-2 | mpl | 1.0 | spdx licen[sc]e identifier mpl 2 0
mpl-1.1 | mpl | 1.0 | spdx licen[sc]e identifier mpl 1 1
epl | epl | 1.0 | spdx licen[sc]e identifier epl [12] 0
cddl | cddl | 1.0 | spdx licen[sc]e identifier cddl 1 [01]
isc | isc | 1.0 | spdx licen[sc]e identifier isc
zlib | zlib | 1.0 | spdx licen[sc]e identifier zlib
boost | bsl | 1.0 | spdx licen[sc]e identifier bsl 1 0
unlicense | unlicense | 1.0 | spdx licen[sc]e identifier unlicense
wtfpl | wtfpl | 1.0 | spdx licen[sc]e identifier wtfpl
artistic | artistic | 1.0 | spdx licen[sc]e identifier artistic 2 0
cc0 | cc0 | 1.0 | spdx licen[sc]e identifier cc0 1 0
cc-by-nc-nd | cc | 1.0 | spdx licen[sc]e identifier cc by nc nd [1-4] [05]
cc-by-nc-sa | cc | 1.0 | spdx licen[sc]e identifier cc by nc sa [1-4] [05]
cc-by-nc | cc | 1.0 | spdx licen[sc]e identifier cc by nc [1-4] [05]
cc-by-sa | cc | 1.0 | spdx licen[sc]e identifier cc by sa [1-4] [05]
cc-by-nd | cc | 1.0 | spdx licen[sc]e identifier cc by nd [1-4] [05]
cc-by | cc | 1.0 | spdx licen[sc]e identifier cc by [1-4] [05]
ofl-1.1 | ofl | 1.0 | spdx licen[sc]e identifier ofl 1 1
eupl | eupl | 1.0 | spdx licen[sc]e identifier eupl 1 [12]
postgresql | postgresql | 1.0 | spdx licen[sc]e identifier postgresql
psf-2 | psf | 1.0 | spdx licen[sc]e identifier psf 2 0
ms-pl | spdx | 1.0 | spdx licen[sc]e identifier ms pl
# Grants and sentences of the texts themselves.
mit | permission | 1.0 | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | sublicense | 1.0 | rights to use copy modify merge publish distribute sublicense and or sell copies of the software
mit | permission | 0.9 | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | noninfringement | 0.8 | warranties of merchantability fitness for a particular purpose and noninfringement
isc | permission | 1.0 | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
0bsd | permission | 0.9 | permission to use copy modify and or distribute this software for any purpose with or without fee
isc | disclaims | 0.8 | the author disclaims all warranties with regard to this software
hpnd | permission | 0.9 | permission to use copy modify and distribute this software and its documentation for any purpose
bsd | redistribution | 0.9 | redistribution and use in source and binary forms with or without modification are permitted
bsd | redistributions | 0.9 | redistributions of source code must retain the above copyright notice
bsd | redistributions | 0.9 | redistributions in binary form must reproduce the above copyright notice
bsd-3-clause | endorse | 1.0 | may be used to endorse or promote products derived from this software without specific prior written permission
bsd-4-clause | advertising | 1.0 | all advertising materials mentioning features or use of this software must display
bsd | copyright | 0.8 | this software is provided by the copyright holders and contributors as is
bsd | copyright | 0.7 | in no event shall the copyright (?:holder|owner) or contributors be liable
apache-2 | apache | 1.0 | licen[sc]ed under the apache licen[sc]e version 2 0(?: the licen[sc]e)?
apache-2 | licen | 0.9 | you may not use this file except in compliance with the licen[sc]e
apache-2 | licen | 0.9 | unless required by applicable law or agreed to in writing software distributed under the licen[sc]e
apache-2 | copyright | 0.9 | perpetual worldwide non exclusive no charge royalty free irrevocable copyright licen[sc]e
apache-2 | patent | 0.9 | perpetual worldwide non exclusive no charge royalty free irrevocable(?: except as stated in this section)? patent licen[sc]e
apache-1.1 | apache | 0.9 | this product includes software developed by the apache software foundation
apache-1.1 | apache | 0.9 | the names apache and apache software foundation must not be used
gpl | general | 1.0 | this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e
gpl-2 | general | 1.0 | gnu general public licen[sc]e as published by the free software foundation either version 2(?: of the licen[sc]e)?
gpl-3 | general | 1.0 | gnu general public licen[sc]e as published by the free software foundation either version 3(?: of the licen[sc]e)?
gpl-2 | general | 1.0 | gnu general public licen[sc]e version 2 as published by the free software foundation
gpl-3 | general | 1.0 | gnu general public licen[sc]e version 3 as published by the free software foundation
gpl | general | 0.9 | you should have received a copy of the gnu general public licen[sc]e(?: along with this program)?
gpl | merchantability | 0.7 | without even the implied warranty of merchantability or fitness for a particular purpose
gpl | verbatim | 0.8 | everyone is permitted to copy and distribute verbatim copies of this licen[sc]e document
gpl-3 | copyleft | 0.9 | the gnu general public licen[sc]e is a free copyleft licen[sc]e for software and other kinds of works
lgpl | lesser | 1.0 | this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public licen[sc]e
lgpl-2.1 | lesser | 1.0 | gnu lesser general public licen[sc]e as published by the free software foundation either version 2 1(?: of the licen[sc]e)?
lgpl-3 | lesser | 1.0 | gnu lesser general public licen[sc]e as published by the free software foundation either version 3(?: of the licen[sc]e)?
lgpl | lesser | 0.9 | you should have received a copy of the gnu lesser general public licen[sc]e
lgpl-2 | library | 0.9 | gnu library general public licen[sc]e
agpl-3 | affero | 1.0 | gnu affero general public licen[sc]e as published by the free software foundation either version 3
agpl-3 | affero | 0.9 | you should have received a copy of the gnu affero general public licen[sc]e
mpl-2 | mozilla | 1.0 | this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0
mpl-2 | mozilla | 0.9 | if a copy of the mpl was not distributed with this file you can obtain one at https? mozilla org mpl 2 0
mpl-1.1 | mozilla | 1.0 | the contents of this file are subject to the mozilla public licen[sc]e version 1 1
epl | eclipse | 1.0 | this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e
cddl | cddl | 1.0 | the contents of this file are subject to the terms of the common development and distribution licen[sc]e(?: the)? cddl
zlib | implied | 1.0 | this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib | misrepresented | 1.0 | the origin of this software must not be misrepresented
zlib | misrepresented | 0.9 | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
boost | boost | 1.0 | distributed under the boost software licen[sc]e version 1 0
boost | machine | 0.9 | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this licen[sc]e to use reproduce display distribute execute and transmit the software and to prepare machine
unlicense | unencumbered | 1.0 | this is free and unencumbered software released into the public domain
unlicense | compiled | 0.9 | anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary
wtfpl | fuck | 1.0 | do what the fuck you want to(?: public licen[sc]e)?
artistic | artistic | 0.9 | or the artistic licen[sc]e which comes with this kit
perl | perl | 0.9 | (?:under|with) the same terms as (?:the )?perl(?: 5 programming language system)? itself
cc0 | copyright | 1.0 | has waived all copyright and related or neighbo(?:u)?ring rights to this work
cc0 | dedicated | 0.9 | the person who associated a work with this deed has dedicated the work to the public domain
cc-by | creative | 1.0 | this work is licen[sc]ed under (?:a|the) creative commons attribution [1-4] 0 (?:international|unported|generic) licen[sc]e
cc-by-sa | sharealike | 1.0 | this work is licen[sc]ed under (?:a|the) creative commons attribution sharealike [1-4] 0 (?:international|unported|generic) licen[sc]e
cc-by-nc | noncommercial | 1.0 | this work is licen[sc]ed under (?:a|the) creative commons attribution noncommercial [1-4] 0 (?:international|unported|generic) licen[sc]e
cc-by-nd | noderivatives | 1.0 | this work is licen[sc]ed under (?:a|the) creative commons attribution noderivatives [1-4] 0 (?:international|unported|generic) licen[sc]e
cc-by-nc-sa | noncommercial | 1.0 | this work is licen[sc]ed under (?:a|the) creative commons attribution noncommercial sharealike [1-4] 0 (?:international|unported|generic) licen[sc]e
cc-by-nc-nd | noncommercial | 1.0 | this work is licen[sc]ed under (?:a|the) creative commons attribution noncommercial noderivatives [1-4] 0 (?:international|unported|generic) licen[sc]e
cc-by | credit | 0.7 | you must give appropriate credit provide a link to the licen[sc]e and indicate if changes were made
cc-by-sa | remix | 0.8 | if you remix transform or build upon the material you must distribute your contributions under the same licen[sc]e as the original
ofl-1.1 | sil | 1.0 | this font software is licen[sc]ed under the sil open font licen[sc]e version 1 1
ofl-1.1 | font | 0.9 | the font software may be sold as part of a larger software package
gfdl | documentation | 1.0 | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e
psf-2 | python | 0.9 | the python software foundation licen[sc]e agreement
postgresql | postgresql | 0.9 | the postgresql licen[sc]e is a liberal open source licen[sc]e
ms-pl | accompanying | 0.9 | this licen[sc]e governs use of the accompanying software if you use the software you accept this licen[sc]e
elastic-2 | hosted | 0.9 | you may not provide the software to third parties as a hosted or managed service
busl-1.1 | business | 1.0 | the business source licen[sc]e this document or the licen[sc]e is not an open source licen[sc]e
busl-1.1 | production | 0.8 | the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use
sspl | service | 0.9 | if you make the functionality of the program or a modified version available to third parties as a service
commons-clause | sell | 1.0 | the licen[sc]e does not grant to you the right to sell the software
openrail | restrictions | 0.8 | use based restrictions as referenced in paragraph 5
llama | llama | 0.9 | llama (?:[23] )?(?:[123] )?community licen[sc]e
odbl | database | 1.0 | this database is made available under the open database licen[sc]e
odc-by | odc | 0.9 | open data commons attribution licen[sc]e odc by
pddl | pddl | 0.9 | open data commons public domain dedication and licen[sc]e pddl
# Addresses.
mit | opensource | 1.0 | opensource org licen[sc]es? mit(?: licen[sc]e)?(?: php)?
apache-2 | apache | 1.0 | www apache org licen[sc]es licen[sc]e 2 0(?: txt| html)?
apache-2 | apache | 1.0 | opensource org licen[sc]es apache 2 0
bsd-2-clause | bsd | 1.0 | opensource org licen[sc]es bsd 2 clause
bsd-3-clause | bsd | 1.0 | opensource org licen[sc]es bsd 3 clause
gpl-2 | gnu | 1.0 | www gnu org licen[sc]es (?:old licen[sc]es )?gpl 2 0
gpl-3 | gnu | 1.0 | www gnu org licen[sc]es gpl 3 0
gpl | gnu | 0.9 | www gnu org licen[sc]es gpl
lgpl-2.1 | gnu | 1.0 | www gnu org licen[sc]es (?:old licen[sc]es )?lgpl 2 1
lgpl-3 | gnu | 1.0 | www gnu org licen[sc]es lgpl 3 0
lgpl | gnu | 0.9 | www gnu org licen[sc]es lgpl
agpl-3 | gnu | 1.0 | www gnu org licen[sc]es agpl(?: 3 0)?
gfdl | gnu | 0.9 | www gnu org licen[sc]es fdl
mpl-2 | mozilla | 1.0 | mozilla org mpl 2 0
mpl-1.1 | mozilla | 1.0 | mozilla org mpl mpl 1 1
epl | eclipse | 1.0 | www eclipse org legal epl (?:v10|v20|2 0)
unlicense | unlicense | 1.0 | unlicense org
wtfpl | wtfpl | 1.0 | www wtfpl net
boost | boost | 1.0 | www boost org licen[sc]e 1 0(?: txt)?
isc | isc | 1.0 | opensource org licen[sc]es isc
ofl-1.1 | ofl | 1.0 | scripts sil org ofl
cc0 | creativecommons | 1.0 | creativecommons org publicdomain zero 1 0
public-domain | creativecommons | 0.9 | creativecommons org publicdomain mark 1 0
cc-by-nc-nd | creativecommons | 1.0 | creativecommons org licen[sc]es by nc nd [1-4] [05]
cc-by-nc-sa | creativecommons | 1.0 | creativecommons org licen[sc]es by nc sa [1-4] [05]
cc-by-nc | creativecommons | 1.0 | creativecommons org licen[sc]es by nc [1-4] [05]
cc-by-sa | creativecommons | 1.0 | creativecommons org licen[sc]es by sa [1-4] [05]
cc-by-nd | creativecommons | 1.0 | creativecommons org licen[sc]es by nd [1-4] [05]
cc-by | creativecommons | 1.0 | creativecommons org licen[sc]es by [1-4] [05]
odbl | opendatacommons | 1.0 | opendatacommons org licen[sc]es odbl
# Notices.
mit | mit | 1.0 | (?:is |are )?(?:licen[sc]ed|released|distributed|available|published) under (?:the )?(?:terms of the )?mit licen[sc]e
mit | mit | 0.9 | (?:subject to|governed by|covered by) the (?:terms of the )?mit licen[sc]e
mit | mit | 0.9 | under the (?:terms of the )?mit licen[sc]e
mit | expat | 0.9 | (?:under the )?expat licen[sc]e
apache-2 | apache | 1.0 | (?:is |are )?(?:licen[sc]ed|released|distributed|available|published) under (?:the )?(?:terms of the )?apache licen[sc]e(?: version)? 2(?: 0)?
apache-2 | apache | 0.9 | (?:subject to|governed by|covered by) the (?:terms of the )?apache licen[sc]e(?: version)? 2(?: 0)?
apache-2 | apache | 0.9 | under the (?:terms of the )?apache licen[sc]e(?: version)? 2(?: 0)?
apache-2 | apache | 0.9 | under the (?:terms of the )?apache 2(?: 0)? licen[sc]e
bsd-2-clause | bsd | 1.0 | (?:licen[sc]ed|released|distributed|available|published) under (?:an? |the )?(?:terms of the )?(?:simplified|2 clause|two clause|freebsd) bsd licen[sc]e
bsd-3-clause | bsd | 1.0 | (?:licen[sc]ed|released|distributed|available|published) under (?:an? |the )?(?:terms of the )?(?:new|modified|revised|3 clause|three clause) bsd licen[sc]e
bsd | bsd | 0.9 | (?:licen[sc]ed|released|distributed|available|published) under (?:an? |the )?(?:terms of the )?bsd(?: style)? licen[sc]e
bsd | bsd | 0.8 | use of this source code is governed by a bsd style licen[sc]e
gpl-2 | gpl | 1.0 | (?:licen[sc]ed|released|distributed|available|published) under (?:the )?(?:gnu )?gpl ?(?:version |v)?2(?: 0)?
gpl-3 | gpl | 1.0 | (?:licen[sc]ed|released|distributed|available|published) under (?:the )?(?:gnu )?gpl ?(?:version |v)?3(?: 0)?
gpl-2 | general | 1.0 | (?:licen[sc]ed|released|distributed|available|published) under the (?:terms of the )?gnu general public licen[sc]e(?: version| v)? ?2(?: 0)?
gpl-3 | general | 1.0 | (?:licen[sc]ed|released|distributed|available|published) under the (?:terms of the )?gnu general public licen[sc]e(?: version| v)? ?3(?: 0)?
gpl | general | 0.9 | (?:licen[sc]ed|released|distributed|available|published) under the (?:terms of the )?gnu general public licen[sc]e
lgpl | lgpl | 0.9 | (?:licen[sc]ed|released|distributed|available|published) under (?:the )?(?:gnu )?lgpl(?: ?v?[23](?: [01])?)?
lgpl | lesser | 0.9 | (?:licen[sc]ed|released|distributed|available|published) under the (?:terms of the )?gnu lesser general public licen[sc]e
agpl-3 | agpl | 1.0 | (?:licen[sc]ed|released|distributed|available|published) under (?:the )?(?:gnu )?agpl ?(?:version |v)?3(?: 0)?
mpl-2 | mozilla | 1.0 | (?:licen[sc]ed|released|distributed|available|published) under the (?:terms of the )?mozilla public licen[sc]e(?: version| v)? ?2(?: 0)?
mpl | mozilla | 0.8 | (?:licen[sc]ed|released|distributed|available|published) under the (?:terms of the )?mozilla public licen[sc]e
epl | eclipse | 1.0 | (?:licen[sc]ed|released|distributed|available|published) under the (?:terms of the )?eclipse public licen[sc]e
cc0 | cc0 | 1.0 | (?:licen[sc]ed|released|distributed|available|published) under (?:the )?(?:creative commons )?cc0
cc-by-nc-nd | cc | 1.0 | (?:licen[sc]ed|released|distributed|available|published) under (?:a |the )?cc by nc nd
cc-by-nc-sa | cc | 1.0 | (?:licen[sc]ed|released|distributed|available|published) under (?:a |the )?cc by nc sa
cc-by-sa | cc | 1.0 | (?:licen[sc]ed|released|distributed|available|published) under (?:a |the )?cc by sa
cc-by-nd | cc | 1.0 | (?:licen[sc]ed|released|distributed|available|published) under (?:a |the )?cc by nd
cc-by | cc | 1.0 | (?:licen[sc]ed|released|distributed|available|published) under (?:a |the )?cc by [1-4] [05]
dual | dual | 0.8 | dual licen[sc]ed(?: under)?
mit | multi | 0.8 | multi licen[sc]ed under (?:the )?mit
# Names in running text.
mit-0 | mit | 0.8 | mit no attribution(?: licen[sc]e)?
mit | mit | 0.7 | mit licen[sc]e
mit | mit | 0.7 | licen[sc]e mit
apache-2 | apache | 0.7 | apache licen[sc]e(?: version| v)? 2(?: 0)?
apache-2 | apache | 0.7 | apache 2(?: 0)? licen[sc]e
apache-2 | apache | 0.7 | licen[sc]e apache 2 0
apache-1.1 | apache | 0.7 | apache (?:software )?licen[sc]e(?: version)? 1 1
bsd-2-clause | bsd | 0.7 | (?:simplified|2 clause|two clause|freebsd) bsd licen[sc]e
bsd-2-clause | bsd | 0.7 | bsd (?:2 clause|two clause)(?: licen[sc]e)?
bsd-3-clause | bsd | 0.7 | (?:new|modified|revised|3 clause|three clause) bsd licen[sc]e
bsd-3-clause | bsd | 0.7 | bsd (?:3 clause|three clause)(?: licen[sc]e)?
bsd-4-clause | bsd | 0.7 | (?:original|4 clause|four clause) bsd licen[sc]e
bsd | bsd | 0.7 | bsd(?: style)? licen[sc]e
gpl-2 | general | 0.7 | gnu general public licen[sc]e(?: version| v)? ?2(?: 0)?
gpl-3 | general | 0.7 | gnu general public licen[sc]e(?: version| v)? ?3(?: 0)?
gpl-2 | gpl | 0.7 | gpl ?(?:version |v)?2(?: 0)?(?: only| or later)?
gpl-3 | gpl | 0.7 | gpl ?(?:version |v)?3(?: 0)?(?: only| or later)?
gpl | general | 0.7 | gnu general public licen[sc]e
lgpl-2.1 | lesser | 0.7 | gnu lesser general public licen[sc]e(?: version| v)? 2 1
lgpl-3 | lesser | 0.7 | gnu lesser general public licen[sc]e(?: version| v)? 3(?: 0)?
lgpl | lesser | 0.7 | gnu lesser general public licen[sc]e
lgpl | lgpl | 0.7 | lgpl(?: ?v?[23](?: [01])?)?(?: only| or later)?
agpl-3 | affero | 0.7 | gnu affero general public licen[sc]e(?: version| v)?(?: 3(?: 0)?)?
agpl-3 | agpl | 0.7 | agpl ?v?3(?: 0)?
mpl-2 | mozilla | 0.7 | mozilla public licen[sc]e(?: version| v)? ?2(?: 0)?
mpl-1.1 | mozilla | 0.7 | mozilla public licen[sc]e(?: version| v)? 1 1
mpl-2 | mpl | 0.7 | mpl ?v?2(?: 0)?
epl | eclipse | 0.7 | eclipse public licen[sc]e(?: version| v)?(?: [12](?: 0)?)?
cddl | development | 0.7 | common development and distribution licen[sc]e
isc | isc | 0.7 | isc licen[sc]e
zlib | zlib | 0.7 | zlib(?: libpng)? licen[sc]e
boost | boost | 0.7 | boost software licen[sc]e(?: version)?(?: 1 0)?
unlicense | unlicense | 0.7 | the unlicense
wtfpl | wtfpl | 0.7 | wtfpl(?: version 2)?
artistic | artistic | 0.7 | artistic licen[sc]e(?: 2 0)?
eupl | union | 0.7 | european union public licen[sc]e
postgresql | postgresql | 0.7 | postgresql licen[sc]e
psf-2 | python | 0.7 | python software foundation licen[sc]e
ms-pl | microsoft | 0.7 | microsoft public licen[sc]e
gfdl | documentation | 0.7 | gnu free documentation licen[sc]e
sspl | server | 0.7 | server side public licen[sc]e
busl-1.1 | business | 0.7 | business source licen[sc]e(?: 1 1)?
elastic-2 | elastic | 0.7 | elastic licen[sc]e(?: 2 0)?
commons-clause | commons | 0.7 | commons clause
openrail | openrail | 0.7 | openrail(?: m)?(?: licen[sc]e)?
cc0 | cc0 | 0.7 | cc0(?: 1 0)?(?: universal)?
cc-by-nc-nd | cc | 0.7 | cc by nc nd(?: [1-4] [05])?
cc-by-nc-sa | cc | 0.7 | cc by nc sa(?: [1-4] [05])?
cc-by-nc | cc | 0.7 | cc by nc(?: [1-4] [05])?
cc-by-sa | cc | 0.7 | cc by sa(?: [1-4] [05])?
cc-by-nd | cc | 0.7 | cc by nd(?: [1-4] [05])?
cc-by | cc | 0.7 | cc by [1-4] [05]
cc-by-nc | noncommercial | 0.7 | creative commons attribution noncommercial
cc-by-sa | sharealike | 0.7 | creative commons attribution sharealike
cc-by | creative | 0.7 | creative commons attribution licen[sc]e
odbl | database | 0.7 | open database licen[sc]e
ofl-1.1 | sil | 0.7 | sil open font licen[sc]e(?: version 1 1)?
# Statements of rights.
public-domain | domain | 0.8 | (?:released|placed|dedicated) (?:in|into|to) the public domain
public-domain | domain | 0.7 | this (?:work|file|document) is in the public domain
proprietary | rights | 0.7 | all rights reserved
proprietary | confidential | 0.8 | proprietary and confidential
proprietary | unauthorized | 0.7 | unauthorized (?:copying|reproduction|distribution) of this (?:file|program|document)
proprietary | consent | 0.7 | may not be reproduced without (?:the )?(?:prior )?(?:express )?written consent
"""
