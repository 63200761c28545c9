"""Hand-written license rules: (label, pattern), one to a line, in order of priority.

A pattern is a regular expression on lower-cased text in which a space stands for any run of
bytes that belong to no word and ` ?` for such a run or nothing; borders of words are asked for
at both ends. A section's rules go before those of the sections after it.
"""

from __future__ import annotations

#: Sentences that grant or refuse something, as license texts and file headers have them.
GRANTS = r"""
mit	permission is hereby granted free of charge to any person obtaining a copy
mit	the above copyright notice and this permission notice shall be included in all copies
isc	permission to use copy modify and(?: or)? distribute this software for any purpose
0bsd	permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted the software
hpnd	permission to use copy modify(?: and)? distribute(?: and sell)? this software and its documentation for any purpose
bsd	redistribution and use in source and binary forms with or without modification are permitted
bsd	redistributions of source code must retain the above copyright notice
bsd	redistributions in binary form must reproduce the above copyright notice
bsd-3-clause	neither the name of .{1,80}? nor the names of its contributors may be used to endorse or promote
bsd-4-clause	all advertising materials mentioning features or use of this software must display
apache-2.0	you may not use this file except in compliance with the license
apache-2.0	you may obtain a copy of the license at https?(?: www)? apache org licenses license 2 0
apache-1.1	this product includes software developed by the apache software foundation
apache-2.0	licensed to the apache software foundation asf under one or more contributor license agreements
apache-2.0	unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
gpl-3.0	this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3
gpl-2.0	this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2
gpl	this (?:program|software|file|package|code) is free software you (?:can|may) redistribute it and or modify it
agpl	you should have received a copy of the gnu affero general public license along with
gpl	you should have received a copy of the gnu general public license along with
lgpl	you should have received a copy of the gnu (?:lesser|library) general public license along with
lgpl	this library is free software you can redistribute it and or modify it
lgpl	this library is distributed in the hope that it will be useful
gpl	this program is distributed in the hope that it will be useful
gpl	everyone is permitted to copy and distribute verbatim copies of this license document
gfdl	permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
mpl-2.0	this source code form is subject to the terms of the mozilla public license v(?:ersion)? ?2(?: 0)?
mpl-2.0	this source code form is incompatible with secondary licenses
mpl-1.1	the contents of this file are subject to the mozilla public license version 1 1
mpl	the contents of this file are subject to the mozilla public license
npl	the contents of this file are subject to the netscape public license
epl-2.0	this program and the accompanying materials are made available under the terms of the eclipse public license (?:v(?:ersion)? ?)?2(?: 0)?
epl-1.0	this program and the accompanying materials are made available under the terms of the eclipse public license v(?:ersion)? ?1(?: 0)?
epl	this program and the accompanying materials are made available under the terms of the eclipse (?:public|distribution) license
cpl-1.0	this program and the accompanying materials are made available under the terms of the common public license
cddl	the contents of this file are subject to the terms of the common development and distribution license
cddl-1.1	subject to the terms of either the gnu general public license version 2 only gpl or the common development and distribution license
unlicense	this is free and unencumbered software released into the public domain
unlicense	anyone is free to copy modify publish use compile sell or distribute this software
wtfpl	everyone is permitted to copy and distribute verbatim or modified copies of this license document
wtfpl	you just do what the fuck you want to
zlib	this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib	the origin of this software must not be misrepresented
zlib	altered source versions must be plainly marked as such
boost	permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
boost	distributed under the boost software license(?: version)?(?: 1 0)?
artistic	the intent of this document is to state the conditions under which a package may be copied
artistic	you may (?:redistribute|use|modify|copy).{1,40}? under the same terms as perl itself
perl	this (?:library|module|program|package) is free software you (?:can|may) redistribute it and or modify it under the same terms as perl
python	this license agreement is between the python software foundation
python	psf hereby grants licensee a nonexclusive royalty free world wide license
postgresql	permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
openssl	this product includes software developed by the openssl project
ssleay	this product includes cryptographic software written by eric young
curl	permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
ntp	permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted
unicode	permission is hereby granted free of charge to any person obtaining a copy of the unicode data files
ofl	this font software is licensed under the sil open font license
ofl	the fonts including any derivative works can be bundled embedded redistributed and or sold
cc0	to the extent possible under law .{1,80}? has waived all copyright and related
cc0	the person who associated a work with this deed has dedicated the work to the public domain
cc	except where otherwise noted (?:this|the) (?:site|work|content|page).{0,40}? is licensed under a creative commons
cc	this work is licensed under (?:a|the) creative commons
cc	you are free to share copy and redistribute the material in any medium or format
cc	you must give appropriate credit provide a link to the license and indicate if changes were made
cc	if you remix transform or build upon the material you must distribute your contributions under the same license
cc-nc	you may not use the material for commercial purposes
odbl	made available under the open database license
odc-by	made available under the open data commons attribution license
pddl	made available under the public domain dedication and license
ogl-uk	contains public sector information licensed under the open government licence
etalab	licence ouverte(?: open licence)?(?: etalab)?(?: version)? 2(?: 0)?
sspl	server side public license(?: v(?:ersion)?)? ?1
busl	use of the licensed work is subject to the business source license
busl	change date .{4,20}? change license
elastic	you may not provide the software to third parties as a hosted or managed service
commons-clause	the license does not grant to you the right to sell the software
rail	use based restrictions as referenced in paragraph 5
llama	llama (?:2|3|3 1|3 2) community license agreement
jsonlicense	the software shall be used for good not evil
beerware	if we meet some day and you think this stuff is worth it you can buy me a beer
ncsa	permission is hereby granted free of charge .{1,80}? to deal with the software without restriction
x11	except as contained in this notice the name of the x consortium shall not be used
w3c	by obtaining using and or copying this work you the licensee agree
ms-pl	this license governs use of the accompanying software if you use the software you accept this license
eula	by (?:installing|using|downloading|clicking).{1,60}? you agree to (?:be bound by )?(?:the|these|this) (?:terms|license|agreement)
eula	end user licen[sc]e agreement
eula	you may not reverse engineer decompile or disassemble
proprietary	no part of this (?:publication|book|document|work|software) may be (?:reproduced|copied|stored|transmitted)
proprietary	(?:may|must) not be (?:reproduced|copied|distributed|republished|redistributed).{0,40}? without (?:the )?(?:prior |express |written |explicit )*(?:permission|consent)
proprietary	reproduction(?: in whole or in part)?(?: without (?:written )?permission)? is (?:strictly )?prohibited
proprietary	unauthori[sz]ed (?:copying|use|reproduction|distribution|duplication)(?: of this (?:file|software|material|work))?
proprietary	proprietary and confidential
proprietary	confidential and proprietary
proprietary	trade secrets? (?:of|belonging to)
proprietary	this material may not be published broadcast rewritten or redistributed
non-commercial	(?:for|to) non ?commercial(?: use| purposes| research)? only
non-commercial	for (?:personal|private|educational|academic|research)(?: and non ?commercial)? (?:use|purposes) only
non-commercial	not for (?:commercial use|sale|resale|redistribution)
no-derivatives	no derivative works? (?:are |is )?(?:allowed|permitted)
no-ai	(?:may|must|shall) not be used (?:to|for) train(?:ing)?(?: of)? (?:any )?(?:artificial intelligence|machine learning|ai|language models?)
public-domain	(?:released|placed|dedicated|put)(?: in)?(?: ?to| ?into| ?in) the public domain
public-domain	(?:this|the) (?:work|file|text|book|image|document|software) is in the public domain
public-domain	no known copyright restrictions
public-domain	project gutenberg license
"""

#: Tags for machines, with the versions that they name.
TAGS = r"""
agpl-3.0	agpl 3(?: ?0)?(?: (?:only|or later))?
agpl-3.0	agpl ?v ?3(?:\+| or later)?
agpl-1.0	agpl 1 0(?: (?:only|or later))?
lgpl-3.0	lgpl 3(?: ?0)?(?: (?:only|or later))?
lgpl-3.0	lgpl ?v ?3(?:\+| or later)?
lgpl-2.1	lgpl 2 1(?: (?:only|or later))?
lgpl-2.1	lgpl ?v ?2 1(?:\+| or later)?
lgpl-2.0	lgpl 2(?: 0)?(?: (?:only|or later))?
lgpl-2.0	lgpl ?v ?2(?:\+| or later)?
gpl-3.0	gpl 3(?: ?0)?(?: (?:only|or later))?
gpl-3.0	gpl ?v ?3(?: 0)?(?:\+| or later| only)?
gpl-2.0	gpl 2(?: ?0)?(?: (?:only|or later))?
gpl-2.0	gpl ?v ?2(?: 0)?(?:\+| or later| only)?
gpl-1.0	gpl 1 0(?: (?:only|or later))?
gfdl-1.3	gfdl 1 3(?: (?:only|or later|invariants|no invariants))?
gfdl-1.2	gfdl 1 2(?: (?:only|or later))?
gfdl-1.1	gfdl 1 1(?: (?:only|or later))?
classpath-exception	gpl 2 0 with classpath exception
gcc-exception	gpl 3 0 with gcc exception
llvm-exception	apache 2 0 with llvm exception
apache-2.0	apache 2(?: 0)?
apache-2.0	apache ?v ?2(?: 0)?
apache-1.1	apache 1 1
apache-1.0	apache 1 0
bsd-4-clause	bsd 4 clause(?: uc)?
bsd-3-clause-clear	bsd 3 clause clear
bsd-3-clause	bsd 3 clause
bsd-2-clause-patent	bsd 2 clause patent
bsd-2-clause	bsd 2 clause
bsd-1-clause	bsd 1 clause
0bsd	0bsd
mit-0	mit 0
mit-modern	mit modern variant
mpl-2.0	mpl 2(?: 0)?(?: no copyleft exception)?
mpl-2.0	mpl ?v ?2(?: 0)?
mpl-1.1	mpl 1 1
mpl-1.0	mpl 1 0
epl-2.0	epl 2 0
epl-2.0	epl ?v ?2(?: 0)?
epl-1.0	epl 1 0
epl-1.0	epl ?v ?1(?: 0)?
edl-1.0	edl 1 0
cddl-1.1	cddl 1 1
cddl-1.0	cddl 1 0
cpl-1.0	cpl 1 0
eupl-1.2	eupl (?:v ?)?1 2
eupl-1.1	eupl (?:v ?)?1 1
osl-3.0	osl 3 0
afl-3.0	afl 3 0
artistic-2.0	artistic 2(?: 0)?
artistic-1.0	artistic 1 0(?: perl| cl8)?
bsl-1.0	bsl 1 0
busl-1.1	busl 1 1
sspl-1.0	sspl 1 0
elastic-2.0	elastic 2 0
ofl-1.1	ofl 1 1(?: rfn| no rfn)?
lppl-1.3c	lppl 1 3[abc]?
upl-1.0	upl 1 0
ncsa	uiuc ncsa
python-2.0	python 2 0(?: 1)?
psf-2.0	psf 2 0
php-3.01	php 3 0?1?
zpl-2.1	zpl 2 1
w3c	w3c 20150513
unicode-dfs	unicode dfs 201[56]
mulan-2.0	mulanpsl 2 0
cecill-2.1	cecill (?:v ?)?2(?: [01])?
cecill-b	cecill b
cecill-c	cecill c
odbl-1.0	odbl 1 0
odc-by-1.0	odc by 1 0
pddl-1.0	pddl 1 0
cdla-permissive-2.0	cdla permissive [12] 0
cdla-sharing-1.0	cdla sharing 1 0
ogl-uk-3.0	ogl uk [123] 0
etalab-2.0	etalab 2 0
cc0-1.0	cc0 1 0(?: universal)?
cc-by-nc-nd	cc by nc nd(?: [1234] [05])?(?: [a-z]{2})?
cc-by-nc-sa	cc by nc sa(?: [1234] [05])?(?: [a-z]{2})?
cc-by-nc	cc by nc(?: [1234] [05])?(?: [a-z]{2})?
cc-by-nd	cc by nd(?: [1234] [05])?(?: [a-z]{2})?
cc-by-sa	cc by sa(?: [1234] [05])?(?: [a-z]{2})?
cc-by-4.0	cc by 4 0
cc-by-3.0	cc by 3 0
cc-by-2.5	cc by 2 5
cc-by-2.0	cc by 2 0
cc-pdm	cc pdm(?: 1 0)?
openrail	openrail(?: ?m)?
bigscience-rail	bigscience(?: bloom)? rail 1 0
mit	spdx license identifier mit
isc	spdx license identifier isc
zlib	spdx license identifier zlib
unlicense	spdx license identifier unlicense
wtfpl	spdx license identifier wtfpl
spdx-tag	spdx license identifier [a-z0-9.+]+(?:[-+.][a-z0-9.+]+){0,5}
"""

#: Names written out, the longer before the shorter.
NAMES = r"""
agpl-3.0	(?:gnu )?affero general public licen[sc]e(?: agpl)? (?:v(?:ersion)?|v) ?3(?: 0)?(?: or (?:any )?later(?: version)?)?
agpl	(?:gnu )?affero general public licen[sc]e
lgpl-3.0	(?:gnu )?(?:lesser|library) general public licen[sc]e(?: lgpl)? v(?:ersion)? ?3(?: 0)?
lgpl-2.1	(?:gnu )?(?:lesser|library) general public licen[sc]e(?: lgpl)? v(?:ersion)? ?2 1
lgpl-2.0	(?:gnu )?(?:lesser|library) general public licen[sc]e(?: lgpl)? v(?:ersion)? ?2(?: 0)?
lgpl	(?:gnu )?(?:lesser|library) general public licen[sc]e
gpl-3.0	gnu (?:general public licen[sc]e|gpl)(?: gpl)? v(?:ersion)? ?3(?: 0)?(?: or (?:any )?later(?: version)?)?
gpl-2.0	gnu (?:general public licen[sc]e|gpl)(?: gpl)? v(?:ersion)? ?2(?: 0)?(?: or (?:any )?later(?: version)?)?
gpl-1.0	gnu (?:general public licen[sc]e|gpl)(?: gpl)? v(?:ersion)? ?1(?: 0)?
gpl	gnu general public licen[sc]e
gpl	gnu gpl
gpl	general public licence
gfdl	gnu free documentation licen[sc]e(?: v(?:ersion)? ?1 [0123])?
gfdl	free documentation licen[sc]e
gnu-all-permissive	gnu all permissive licen[sc]e
apache-2.0	apache (?:software )?licen[sc]e v(?:ersion)? ?2(?: 0)?
apache-2.0	apache (?:software )?licen[sc]e 2(?: 0)?
apache-1.1	apache (?:software )?licen[sc]e (?:v(?:ersion)? ?)?1 1
apache-1.0	apache (?:software )?licen[sc]e (?:v(?:ersion)? ?)?1 0
apache	apache(?: software)? licen[sc]e
bsd-4-clause	(?:original|old|four clause|4 clause) bsd(?: style)? licen[sc]e
bsd-3-clause	(?:new|modified|revised|three clause|3 clause) bsd(?: style)? licen[sc]e
bsd-2-clause	(?:simplified|two clause|2 clause) bsd(?: style)? licen[sc]e
bsd-2-clause	freebsd licen[sc]e
0bsd	(?:zero clause|0 clause) bsd licen[sc]e
bsd	bsd (?:style|type|like)(?: licen[sc]ed?)?
bsd	bsd licen[sc]e
mit	(?:the )?(?:mit|expat) (?:open source )?licen[sc]e(?: mit)?
mit-0	mit no attribution(?: licen[sc]e)?
x11	(?:mit )?x11 licen[sc]e
isc	isc licen[sc]e
isc	internet (?:systems|software) consortium licen[sc]e
mpl-2.0	mozilla public licen[sc]e(?: mpl)? (?:v(?:ersion)? ?)?2(?: 0)?
mpl-1.1	mozilla public licen[sc]e(?: mpl)? (?:v(?:ersion)? ?)?1 1
mpl-1.0	mozilla public licen[sc]e(?: mpl)? (?:v(?:ersion)? ?)?1 0
mpl	mozilla public licen[sc]e
npl	netscape public licen[sc]e
epl-2.0	eclipse public licen[sc]e(?: epl)? (?:v(?:ersion)? ?)?2(?: 0)?
epl-1.0	eclipse public licen[sc]e(?: epl)? (?:v(?:ersion)? ?)?1(?: 0)?
epl	eclipse public licen[sc]e
edl	eclipse distribution licen[sc]e
cddl	common development and distribution licen[sc]e(?: cddl)?(?: (?:v(?:ersion)? ?)?1 [01])?
cpl	common public licen[sc]e(?: (?:v(?:ersion)? ?)?1 0)?
cpal	common public attribution licen[sc]e
ibm-pl	ibm public licen[sc]e
eupl	european union public licen[sc]e(?: (?:v(?:ersion)? ?)?1 [012])?
osl	open software licen[sc]e(?: (?:v(?:ersion)? ?)?[123] [01])?
afl	academic free licen[sc]e(?: (?:v(?:ersion)? ?)?[123] [01])?
apsl	apple public source licen[sc]e
artistic-2.0	artistic licen[sc]e (?:v(?:ersion)? ?)?2(?: 0)?
artistic-1.0	artistic licen[sc]e (?:v(?:ersion)? ?)?1(?: 0)?
artistic	(?:perl |clarified )?artistic licen[sc]e
boost	boost software licen[sc]e
zlib	zlib(?: libpng)? licen[sc]e
libpng	libpng licen[sc]e
libtiff	libtiff licen[sc]e
ijg	independent jpeg group s? ?licen[sc]e
freetype	freetype (?:project )?licen[sc]e
openssl	openssl(?: ssleay)? licen[sc]e
curl	curl licen[sc]e
python	python (?:software foundation )?licen[sc]e(?: (?:v(?:ersion)? ?)?[23](?: [0-9]+)?)?
cnri	cnri python licen[sc]e
php	php licen[sc]e(?: (?:v(?:ersion)? ?)?3 0?1?)?
ruby	ruby licen[sc]e
tcl	tcl(?: tk)? licen[sc]e
vim	vim licen[sc]e
postgresql	postgresql licen[sc]e
sqlite	sqlite blessing
sleepycat	sleepycat licen[sc]e
sendmail	sendmail licen[sc]e
icu	icu licen[sc]e
unicode	unicode licen[sc]e(?: agreement)?
jasper	jasper licen[sc]e
latex	latex project public licen[sc]e
zope	zope public licen[sc]e
w3c	w3c software(?: and document)?(?: notice and)? licen[sc]e
ncsa	(?:university of illinois )?ncsa(?: open source)? licen[sc]e
ecl-2.0	educational community licen[sc]e(?: (?:v(?:ersion)? ?)?2 0)?
upl	universal permissive licen[sc]e
blueoak	blue oak model licen[sc]e
mulan	mulan (?:permissive software|public) licen[sc]e
ms-pl	microsoft public licen[sc]e
ms-rl	microsoft reciprocal licen[sc]e
ms-ss	microsoft shared source
ms-rsl	microsoft reference source licen[sc]e
intel	intel open source licen[sc]e
nvidia	nvidia (?:source code|software|open model) licen[sc]e
qpl	q public licen[sc]e
reciprocal	reciprocal public licen[sc]e
sissl	sun industry standards source licen[sc]e
cecill	cecill(?: free software)? licen[sc]e
opensource	osi approved(?: open source)?(?: licen[sc]e)?
unlicense	(?:the )?unlicense
wtfpl	do what the fuck you want to public licen[sc]e
beerware	beer ?ware licen[sc]e
json	json licen[sc]e
hippocratic	hippocratic licen[sc]e
anti-996	anti 996 licen[sc]e
parity	parity public licen[sc]e
polyform	polyform (?:noncommercial|strict|shield|perimeter|small business)(?: licen[sc]e)?
sspl	server side public licen[sc]e
busl	business source licen[sc]e
elastic	elastic licen[sc]e(?: (?:v(?:ersion)? ?)?2(?: 0)?)?
confluent	confluent community licen[sc]e
redis	redis source available licen[sc]e
timescale	timescale licen[sc]e
fsl	functional source licen[sc]e
commons-clause	commons clause
ofl	(?:sil )?open font licen[sc]e(?: (?:v(?:ersion)? ?)?1 [01])?
ubuntu-font	ubuntu font licen[sc]e
bitstream-vera	bitstream vera(?: fonts)? (?:licen[sc]e|copyright)
odbl	open database licen[sc]e
odc-by	open data commons attribution licen[sc]e
pddl	public domain dedication and licen[sc]e
cdla	community data licen[sc]e agreement
ogl-uk	open government licen[sc]e(?: (?:v(?:ersion)? ?)?[123](?: 0)?)?
ogl-canada	open government licen[sc]e canada
dl-de	datenlizenz deutschland
kogl	korea open government licen[sc]e
niod	norwegian licen[sc]e for open government data
cc0	creative commons (?:zero|cc0|public domain dedication)
cc0	cc0(?: public domain(?: dedication)?)?
cc-by-nc-nd	creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [1234] [05])?
cc-by-nc-sa	creative commons attribution non ?commercial share ?alike(?: [1234] [05])?
cc-by-nc	creative commons attribution non ?commercial(?: [1234] [05])?
cc-by-nd	creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [1234] [05])?
cc-by-sa	creative commons attribution share ?alike(?: [1234] [05])?
cc-by-4.0	creative commons attribution 4 0(?: international)?
cc-by-3.0	creative commons attribution 3 0(?: unported)?
cc-by	creative commons attribution
cc-pdm	creative commons public domain mark
cc	creative commons(?: [a-z]+)? licen[sc]e
cc-by	creativecommons org licenses by [1234] [05]
cc-by-sa	creativecommons org licenses by sa [1234] [05]
cc-by-nc	creativecommons org licenses by nc [1234] [05]
cc-by-nd	creativecommons org licenses by nd [1234] [05]
cc-by-nc-sa	creativecommons org licenses by nc sa [1234] [05]
cc-by-nc-nd	creativecommons org licenses by nc nd [1234] [05]
cc0	creativecommons org publicdomain zero 1 0
apache-2.0	apache org licenses license 2 0
gpl	gnu org licenses(?: old licenses)?(?: gpl)?
mit	opensource org licenses mit(?: license php)?
bsd	opensource org licenses bsd(?: [23] clause| license php)?
mpl-2.0	mozilla org mpl(?: 2 0)?
"""

#: Licensing put in other words, and rights kept.
MENTIONS = r"""
mit	mit licensed
bsd	bsd licensed
isc	isc licensed
apache	apache licensed
gpl	gpl(?: ed| licensed)
lgpl	lgpl(?: ed| licensed)
agpl	agpl(?: ed| licensed)
mpl	mpl licensed
mit	(?:licensed|released|distributed|available|provided|published) (?:under|with)(?: the)?(?: terms of the)? mit
mit	(?:licensed|released|distributed|available|provided|published) (?:under|with)(?: the)?(?: terms of the)? expat
bsd	(?:licensed|released|distributed|available|provided|published) (?:under|with)(?: an?| the)?(?: terms of the)? bsd
apache	(?:licensed|released|distributed|available|provided|published) (?:under|with)(?: the)?(?: terms of the)? apache
gpl	(?:licensed|released|distributed|available|provided|published) (?:under|with)(?: the)?(?: terms of the)? (?:gnu )?gpl
lgpl	(?:licensed|released|distributed|available|provided|published) (?:under|with)(?: the)?(?: terms of the)? (?:gnu )?lgpl
agpl	(?:licensed|released|distributed|available|provided|published) (?:under|with)(?: the)?(?: terms of the)? (?:gnu )?agpl
mpl	(?:licensed|released|distributed|available|provided|published) (?:under|with)(?: the)?(?: terms of the)? mpl
epl	(?:licensed|released|distributed|available|provided|published) (?:under|with)(?: the)?(?: terms of the)? epl
zlib	(?:licensed|released|distributed|available|provided|published) (?:under|with)(?: the)?(?: terms of the)? zlib
cc	(?:licensed|released|distributed|available|provided|published) (?:under|with)(?: an?| the)? creative commons
cc0	(?:licensed|released|distributed|available|provided|published) (?:under|with)(?: the)? cc0
cc-by	(?:licensed|released|distributed|available|provided|published) (?:under|with)(?: the)? cc by
as-is	(?:this|the) (?:software|program|code|work|material|data|document) is provided (?:as is|by the (?:author|copyright holder)s?)
as-is	provided as is(?: and| without)
no-warranty	without (?:any )?warrant(?:y|ies) of any kind
no-warranty	without even the implied warranty of merchantability
no-warranty	no warrant(?:y|ies) (?:is|are) (?:given|made|provided|expressed)
no-liability	in no event shall .{1,80}? be liable
copyleft	copyleft(?: all wrongs reversed)?
source-available	source available licen[sc]e
open-source	open source licen[sc]e
royalty-free	royalty free licen[sc]e
dual	dual licen[sc]ed
dual	(?:available|licensed) under (?:a )?dual licen[sc]e
copyright	copyright (?:c )?(?:19|20)[0-9][0-9](?: ?(?:19|20)[0-9][0-9])*(?: by)? [a-z0-9\x80-\xff]+(?: (?:inc|llc|ltd|gmbh|corp|foundation|authors|contributors))?
copyright	\(c\) ?(?:19|20)[0-9][0-9](?: ?(?:19|20)[0-9][0-9])*(?: by)? [a-z0-9\x80-\xff]+(?: (?:inc|llc|ltd|gmbh|corp|foundation|authors|contributors))?
copyright	\xc2\xa9 ?(?:copyright )?(?:19|20)[0-9][0-9](?: ?(?:19|20)[0-9][0-9])*(?: by)? [a-z0-9\x80-\xff]+
copyright	copyright (?:holders?|owners?) (?:reserves?|retains?)
copyright	copyrighted (?:material|work|content)
reserved	all rights (?:are )?reserved
reserved	tous droits r(?:e|\xc3\xa9)serv(?:e|\xc3\xa9)s
reserved	alle rechte vorbehalten
reserved	todos los derechos reservados
reserved	tutti i diritti riservati
reserved	todos os direitos reservados
reserved	alle rechten voorbehouden
some-rights	some rights reserved
no-rights	no rights reserved
trademark	(?:is|are) (?:a )?(?:registered )?trademarks? of
fair-use	fair (?:use|dealing)(?: notice)?
terms	terms (?:of (?:use|service)|and conditions)(?: apply)?
permission	used (?:with|by) (?:kind )?permission
permission	reprinted (?:with|by) permission
attribution	attribution required
dmca	digital millennium copyright act
"""
