"""Operator 8: license scans with ordered signature rules.

Rules are regular expressions over a text's words (lower-case ASCII letters, digits and all characters beyond ASCII, with one
space between words): hand-written ones of notices, headers, versions, addresses, exceptions and restrictions (NOTICES, SENTENCES), and
the phrasings that cite a license, for each family of licenses (PHRASINGS, FAMILIES), some hundreds in all. Each has a priority and
keywords that gate it: a rule runs only on texts that hold one of its keywords, and none runs on a text without any. Detections are
resolved by priority and interval containment: sorted by priority, then length, one is dropped if an accepted detection contains it.
The base phrases of the contract are found beside them and always stay. Work grows with a text's length and with k log k of its k matches.

Score: the weight of the strongest accepted rule (base phrases 0.5), 0 without any; the share of words under accepted
detections lifts it towards 1. Defined results: null and empty texts have no words, no labels (empty strings) and score 0.
Repeated rows and ties are scanned each on its own; other columns are ignored; an empty table gives an empty result.
"""

import bisect
import re
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import common

# Fixed values of the contract: phrases and labels.
BASE = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]

# Names of licenses, as patterns over words, and the label of each; more specific ones first.
FAMILIES = [
    ("agpl", r"(?:gnu )?affero general public license|a ?gpl"),
    ("lgpl", r"(?:gnu )?(?:lesser|library) general public license|l ?gpl"),
    ("gpl", r"(?:gnu )?general public license|gnu gpl|gpl"),
    ("gfdl", r"(?:gnu )?free documentation license|gfdl"),
    ("cc-by-nc-nd", r"(?:cc|creative commons) (?:by|attribution) (?:nc|noncommercial|non commercial) (?:nd|noderivatives|no derivatives)"),
    ("cc-by-nc-sa", r"(?:cc|creative commons) (?:by|attribution) (?:nc|noncommercial|non commercial) (?:sa|sharealike|share alike)"),
    ("cc-by-nc", r"(?:cc|creative commons) (?:by|attribution) (?:nc|noncommercial|non commercial)"),
    ("cc-by-nd", r"(?:cc|creative commons) (?:by|attribution) (?:nd|noderivatives|no derivatives)"),
    ("cc-by-sa", r"(?:cc|creative commons) (?:by|attribution) (?:sa|sharealike|share alike)"),
    ("cc-by", r"(?:cc|creative commons) (?:by|attribution)"),
    ("cc0", r"cc ?0|cc zero|creative commons zero|public domain dedication"),
    ("apache", r"apache(?: software)? license|asl|apache"),
    ("mit", r"mit(?: x11)? license|mit x11|x11 license|expat license|mit"),
    ("bsd-4-clause", r"(?:original|4 clause|four clause) bsd(?: license)?|bsd 4 clause(?: license)?"),
    ("bsd-3-clause", r"(?:new|revised|modified|3 clause|three clause) bsd(?: license)?|bsd 3 clause(?: license)?"),
    ("bsd-2-clause", r"(?:simplified|freebsd|2 clause|two clause) bsd(?: license)?|bsd 2 clause(?: license)?"),
    ("bsd-0-clause", r"(?:zero clause|0 clause) bsd(?: license)?|0bsd"),
    ("bsd", r"bsd(?: style)? license|bsd"),
    ("isc", r"isc license|internet systems consortium license|isc"),
    ("mpl", r"mozilla public license|mpl"),
    ("epl", r"eclipse public license|epl"),
    ("edl", r"eclipse distribution license"),
    ("cddl", r"common development and distribution license|cddl"),
    ("cpl", r"common public license"),
    ("eupl", r"european union public licen[cs]e|eupl"),
    ("artistic", r"(?:the )?(?:clarified )?artistic license"),
    ("zlib", r"zlib(?: libpng)? license|zlib"),
    ("boost", r"boost software license|bsl"),
    ("unlicense", r"the unlicense|unlicense"),
    ("wtfpl", r"do what the f\w+ you want to public license|wtfpl"),
    ("python", r"python software foundation license|psf license"),
    ("ruby", r"ruby license"),
    ("php", r"php license"),
    ("openssl", r"openssl license"),
    ("ofl", r"(?:sil )?open font license|sil ofl|ofl"),
    ("odbl", r"open database license|odbl"),
    ("odc-by", r"open data commons attribution license|odc by"),
    ("pddl", r"public domain dedication and license|pddl"),
    ("cdla", r"community data license agreement|cdla"),
    ("ogl", r"open government licen[cs]e"),
    ("osl", r"open software license"),
    ("afl", r"academic free license"),
    ("ms-pl", r"microsoft public license|ms pl"),
    ("ms-rl", r"microsoft reciprocal license|ms rl"),
    ("postgresql", r"postgresql license"),
    ("ncsa", r"ncsa(?: open source)? license"),
    ("cecill", r"cecill(?: b| c)?"),
    ("mulan", r"mulan (?:permissive|psl)(?: software license)?"),
    ("busl", r"business source license"),
    ("sspl", r"server side public license|sspl"),
    ("elastic", r"elastic license"),
    ("commons-clause", r"commons clause"),
    ("openrail", r"open ?rail(?: m)?|responsible ai license"),
    ("llama", r"llama community license"),
]

# How a license is cited: name, pattern around {0}, priority (lower wins), weight, keyword that gates it.
PHRASINGS = [
    ("spdx", r"spdx license identifier {0}(?: v?\d+(?: \d+)*)?(?: only| or later)?", 10, 1.0, "spdx"),
    ("granted", r"(?:licensed|released|distributed|published|available|provided|covered|offered) (?:to you )?(?:under|by|with) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?{0}(?: (?:version|v) ?\d+(?: \d+)*| \d+(?: \d+)*)?(?: or (?:any )?later(?: version)?)?", 20, 0.95, "licen release distribut publish availab provid cover offer"),
    ("terms", r"(?:terms|conditions|provisions) of (?:the )?{0}(?: version \d+(?: \d+)*)?", 30, 0.85, "terms conditions provisions"),
    ("declared", r"licen[cs]e (?:is )?{0}(?: \d+(?: \d+)*)?", 40, 0.8, "licen"),
    ("versioned", r"{0} (?:version|v) ?\d+(?: \d+)*(?: or (?:any )?later(?: version)?)?", 50, 0.75, "version v#"),
    ("suffixed", r"{0}(?: \d+(?: \d+)*)? licen[cs]e[ds]?", 60, 0.6, "licen"),
]

# Sentences that are a sign by themselves: label, pattern, priority, weight, keyword.
SENTENCES = [
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy", 5, 1.0, "permission"),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose", 5, 1.0, "permission"),
    ("bsd", r"redistribution and use in source and binary forms with or without modification", 5, 1.0, "redistribution"),
    ("zlib", r"this software is provided as is without any express or implied warranty", 6, 0.9, "warranty"),
    ("unlicense", r"this is free and unencumbered software released into the public domain", 5, 1.0, "unencumbered"),
    ("public-domain", r"(?:placed|released|dedicated) (?:in|into|to) the public domain", 45, 0.7, "public domain"),
    ("gpl", r"this program is free software you can redistribute it and or modify it", 8, 0.95, "redistribute"),
    ("proprietary", r"all rights reserved", 90, 0.3, "rights"),
    ("proprietary", r"(?:proprietary and confidential|unauthorized copying of this file)", 25, 0.8, "proprietary unauthorized"),
]

#: Hand-written rules of notices, headers, versions, addresses, exceptions and restrictions: label, pattern, priority, weight, keywords.
NOTICES = [
    # MIT, ISC and other short permissions
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 5, 1.0, "notice"),
    ("mit", r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell", 5, 1.0, "sublicense"),
    ("mit", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", 6, 0.9, "merchantability"),
    ("mit", r"opensource org licenses mit(?: license)?(?: php| html)?", 7, 1.0, "opensource"),
    ("mit-0", r"mit no attribution|mit 0 license", 12, 0.95, "mit"),
    ("mit-modern", r"hereby granted without written agreement and without license or royalty fees to use copy modify and distribute this software", 6, 0.95, "royalty"),
    ("isc", r"provided that the above copyright notice and this permission notice appear in all copies", 6, 0.95, "notice"),
    ("isc", r"the software is provided as is and the author disclaims all warranties with regard to this software", 6, 0.95, "disclaims"),
    ("0bsd", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided", 4, 1.0, "permission"),
    ("hpnd", r"permission to use copy modify and distribute this software and its documentation for any purpose (?:and without fee )?is hereby granted", 6, 0.95, "documentation"),
    ("x11", r"except as contained in this notice the name of \w+(?: \w+){0,6} shall not be used in advertising", 6, 0.95, "advertising"),
    ("curl", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice", 5, 0.95, "permission"),
    ("fair", r"usage of the works is permitted provided that this instrument is retained with the works", 6, 0.95, "instrument"),
    ("zlib", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software", 5, 1.0, "misrepresented"),
    ("zlib", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software", 5, 1.0, "misrepresented"),
    ("libpng", r"the contributing authors and group 42 inc disclaim all warranties", 6, 0.95, "disclaim"),
    ("boost", r"boost org license 1 0(?: txt)?|license 1 0 txt or copy at http www boost org", 7, 1.0, "boost"),
    ("boost", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", 5, 1.0, "organization"),
    ("wtfpl", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed", 5, 1.0, "verbatim"),
    ("wtfpl", r"you just do what the f\w+ you want to", 6, 1.0, "want"),
    ("beerware", r"the beer ware license|beerware license", 12, 0.95, "beer beerware"),
    ("beerware", r"if we meet some day and you think this stuff is worth it you can buy me a beer", 6, 1.0, "beer"),
    ("unlicense", r"anyone is free to copy modify publish use compile sell or distribute this software", 5, 1.0, "compile"),
    ("unlicense", r"unlicense org", 7, 1.0, "unlicense"),
    # BSD
    ("bsd", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", 6, 0.95, "redistributions"),
    ("bsd", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer", 6, 0.95, "redistributions"),
    ("bsd-3-clause", r"neither the names? of \w+(?: \w+){0,8} nor the names of (?:its|their) contributors may be used to endorse or promote products", 4, 1.0, "endorse"),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 4, 1.0, "advertising"),
    ("bsd-3-clause-clear", r"no express or implied licenses to any party s patent rights are granted by this license", 4, 1.0, "patent"),
    ("bsd-2-clause-patent", r"bsd 2 clause plus patent(?: license)?", 12, 0.95, "patent"),
    ("bsd-2-clause", r"opensource org licenses bsd (?:license|2 clause)", 7, 1.0, "opensource"),
    ("bsd-3-clause", r"opensource org licenses bsd 3 clause", 7, 1.0, "opensource"),
    ("bsd", r"use of this source code is governed by a bsd style license that can be found in the license file", 5, 1.0, "governed"),
    ("mit", r"use of this source code is governed by an? mit style license", 5, 1.0, "governed"),
    ("apache-2.0", r"use of this source code is governed by (?:the|an) apache(?: 2 0)? license", 5, 1.0, "governed"),
    # GNU
    ("gpl-1.0-or-later", r"gnu general public license as published by the free software foundation either version 1 (?:of the license )?or (?:at your option )?any later version", 5, 1.0, "foundation"),
    ("gpl-2.0-or-later", r"gnu general public license as published by the free software foundation either version 2 (?:of the license )?or (?:at your option )?any later version", 5, 1.0, "foundation"),
    ("gpl-3.0-or-later", r"gnu general public license as published by the free software foundation either version 3 (?:of the license )?or (?:at your option )?any later version", 5, 1.0, "foundation"),
    ("gpl-2.0-only", r"under the terms of the gnu general public license version 2(?: only)? as published by the free software foundation", 5, 1.0, "foundation"),
    ("gpl-3.0-only", r"under the terms of the gnu general public license version 3(?: only)? as published by the free software foundation", 5, 1.0, "foundation"),
    ("lgpl-2.0-or-later", r"gnu library general public license as published by the free software foundation either version 2 (?:of the license )?or (?:at your option )?any later version", 4, 1.0, "library"),
    ("lgpl-2.1-or-later", r"gnu lesser general public license as published by the free software foundation either version 2 1 (?:of the license )?or (?:at your option )?any later version", 4, 1.0, "lesser"),
    ("lgpl-3.0-or-later", r"gnu lesser general public license as published by the free software foundation either version 3 (?:of the license )?or (?:at your option )?any later version", 4, 1.0, "lesser"),
    ("agpl-3.0-or-later", r"gnu affero general public license as published by the free software foundation either version 3 (?:of the license )?or (?:at your option )?any later version", 4, 1.0, "affero"),
    ("agpl-3.0-only", r"under the terms of the gnu affero general public license version 3(?: only)? as published", 4, 1.0, "affero"),
    ("gfdl", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", 4, 1.0, "document"),
    ("gfdl", r"with no invariant sections no front cover texts and no back cover texts", 6, 0.95, "invariant"),
    ("gpl", r"you should have received a copy of the gnu general public license along with this (?:program|software|library|file)", 6, 0.95, "received"),
    ("lgpl", r"you should have received a copy of the gnu (?:lesser|library) general public license along with this (?:program|software|library|file)", 5, 0.95, "received"),
    ("agpl", r"you should have received a copy of the gnu affero general public license along with this (?:program|software|library|file)", 5, 0.95, "received"),
    ("gpl", r"gnu org (?:licenses|copyleft) gpl(?: 2 0| 3 0)?(?: html| txt)?", 7, 1.0, "gnu"),
    ("lgpl", r"gnu org (?:licenses|copyleft) (?:old licenses )?lgpl(?: 2 1| 3 0)?(?: html| txt)?", 7, 1.0, "gnu"),
    ("agpl", r"gnu org licenses agpl(?: 3 0)?(?: html| txt)?", 7, 1.0, "gnu"),
    ("gfdl", r"gnu org licenses fdl(?: 1 \d)?(?: html| txt)?", 7, 1.0, "gnu"),
    ("gnu-all-permissive", r"copying and distribution of this file with or without modification are permitted in any medium without royalty", 5, 1.0, "royalty"),
    # exceptions
    ("classpath-exception", r"(?:with the )?(?:gnu )?classpath exception(?: 2 0)?", 15, 0.9, "classpath"),
    ("classpath-exception", r"as a special exception the copyright holders of this library give you permission to link this library with independent modules", 5, 1.0, "exception"),
    ("gcc-exception", r"gcc runtime library exception(?: 3 1| version 3 1)?", 15, 0.9, "gcc"),
    ("openssl-exception", r"(?:in addition )?as a special exception the copyright holders give permission to link the code of portions of this program with the openssl library", 5, 1.0, "openssl"),
    ("openssl-exception", r"openssl (?:linking )?exception", 15, 0.9, "openssl"),
    ("autoconf-exception", r"(?:autoconf|configure|libtool|bison|m4) exception(?: 2 0| 3 0)?", 15, 0.9, "exception"),
    ("bison-exception", r"as a special exception you may create a larger work that contains part or all of the bison parser skeleton", 5, 1.0, "bison"),
    ("font-exception", r"(?:gpl )?font exception(?: 2 0)?|embed(?:s|ding)? this font (?:or unaltered portions of this font )?into the document", 15, 0.9, "font"),
    ("linux-syscall-note", r"linux syscall note|this copyright does not cover user programs that use kernel services by normal system calls", 15, 0.95, "syscall kernel"),
    ("llvm-exception", r"(?:apache 2 0 with )?llvm exceptions?", 14, 0.95, "llvm"),
    ("qt-exception", r"(?:the )?qt (?:company )?(?:lgpl|gpl) exception(?: 1 \d)?", 15, 0.9, "qt"),
    ("wxwindows-exception", r"wxwindows(?: library)? (?:exception|licen[cs]e)(?: 3 1)?", 15, 0.9, "wxwindows"),
    ("universal-foss-exception", r"universal foss exception(?: version 1 0)?", 15, 0.9, "foss"),
    ("swift-exception", r"(?:swift )?runtime library exception to the apache license|runtime library exception", 16, 0.85, "runtime"),
    # Apache, Mozilla, Eclipse, Sun, IBM
    ("apache-2.0", r"licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", 3, 1.0, "compliance"),
    ("apache-2.0", r"apache org licenses license 2 0(?: txt| html)?", 7, 1.0, "apache"),
    ("apache-1.1", r"this product includes software developed by the apache software foundation", 6, 0.95, "foundation"),
    ("apache-2.0", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", 6, 0.9, "writing"),
    ("apache-2.0", r"licensed to the apache software foundation asf under one or more contributor license agreements", 4, 1.0, "contributor"),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public license v(?:ersion)? ?2 0", 4, 1.0, "mozilla"),
    ("mpl-2.0", r"if a copy of the mpl was not distributed with this file you can obtain one at", 5, 1.0, "mpl"),
    ("mpl-1.1", r"the contents of this file are subject to the mozilla public license version 1 1", 4, 1.0, "mozilla"),
    ("mpl-1.0", r"the contents of this file are subject to the mozilla public license version 1 0", 4, 1.0, "mozilla"),
    ("mpl-2.0-no-copyleft", r"this source code form is incompatible with secondary licenses as defined by the mozilla public license", 4, 1.0, "incompatible"),
    ("epl-1.0", r"eclipse org legal epl v10(?: html)?|eclipse public license v(?:ersion)? ?1 0|epl ?(?:v )?1 0", 14, 0.95, "eclipse epl"),
    ("epl-2.0", r"eclipse org legal epl (?:v20|2 0)(?: html)?|eclipse public license (?:v(?:ersion)? ?)?2 0|epl ?(?:v )?2 0", 14, 0.95, "eclipse epl"),
    ("epl", r"this program and the accompanying materials are made available under the terms of the eclipse public license", 5, 1.0, "eclipse"),
    ("cddl-1.0", r"cddl ?(?:version |v )?1 0|common development and distribution license version 1 0", 14, 0.95, "cddl common"),
    ("cddl-1.1", r"cddl ?(?:version |v )?1 1|common development and distribution license version 1 1", 14, 0.95, "cddl common"),
    ("cpl-1.0", r"common public license (?:version |v ?)1 0|cpl 1 0", 14, 0.95, "common cpl"),
    ("ipl-1.0", r"ibm public license(?: version 1 0)?", 14, 0.95, "ibm"),
    ("spl-1.0", r"sun public license(?: version 1 0)?", 14, 0.95, "sun"),
    ("npl-1.1", r"netscape public license(?: version 1 \d)?", 14, 0.95, "netscape"),
    ("upl-1.0", r"universal permissive license(?: v(?:ersion)? ?1 0)?", 14, 0.95, "universal"),
    ("eupl-1.2", r"eupl ?(?:version |v )?1 2|licen[cs]ed under the eupl", 14, 0.95, "eupl"),
    ("apsl-2.0", r"apple public source license(?: version)?(?: \d \d)?", 14, 0.95, "apple"),
    ("ms-pl", r"this license governs use of the accompanying software if you use the software you accept this license", 6, 0.95, "accompanying"),
    # Creative Commons and data
    ("cc-by-4.0", r"creativecommons org licenses by 4 0(?: legalcode| deed \w+)?", 7, 1.0, "creativecommons"),
    ("cc-by-3.0", r"creativecommons org licenses by 3 0(?: legalcode| deed \w+| \w\w)?", 7, 1.0, "creativecommons"),
    ("cc-by-sa-4.0", r"creativecommons org licenses by sa 4 0(?: legalcode| deed \w+)?", 7, 1.0, "creativecommons"),
    ("cc-by-sa-3.0", r"creativecommons org licenses by sa 3 0(?: legalcode| deed \w+| \w\w)?", 7, 1.0, "creativecommons"),
    ("cc-by-nd-4.0", r"creativecommons org licenses by nd 4 0(?: legalcode| deed \w+)?", 7, 1.0, "creativecommons"),
    ("cc-by-nc-4.0", r"creativecommons org licenses by nc 4 0(?: legalcode| deed \w+)?", 7, 1.0, "creativecommons"),
    ("cc-by-nc-sa-4.0", r"creativecommons org licenses by nc sa 4 0(?: legalcode| deed \w+)?", 7, 1.0, "creativecommons"),
    ("cc-by-nc-nd-4.0", r"creativecommons org licenses by nc nd 4 0(?: legalcode| deed \w+)?", 7, 1.0, "creativecommons"),
    ("cc0", r"creativecommons org publicdomain zero 1 0(?: legalcode| deed \w+)?", 7, 1.0, "creativecommons"),
    ("public-domain", r"creativecommons org publicdomain mark 1 0", 7, 0.95, "creativecommons"),
    ("cc0", r"to the extent possible under law \w+(?: \w+){0,8} has waived all copyright and related or neighboring rights", 5, 1.0, "waived"),
    ("cc", r"some rights reserved", 80, 0.4, "rights"),
    ("odbl", r"opendatacommons org licenses odbl(?: 1 0)?", 7, 1.0, "opendatacommons"),
    ("odc-by", r"opendatacommons org licenses by(?: 1 0)?", 7, 1.0, "opendatacommons"),
    ("pddl", r"opendatacommons org licenses pddl(?: 1 0)?", 7, 1.0, "opendatacommons"),
    ("ogl", r"contains public sector information licensed under the open government licen[cs]e(?: v\d 0)?", 4, 1.0, "sector"),
    ("cdla-permissive-2.0", r"cdla permissive 2 0|community data license agreement permissive (?:version )?2 0", 14, 0.95, "cdla community"),
    # languages and runtimes
    ("artistic-2.0", r"(?:the )?artistic license (?:version )?2 0|perlfoundation org artistic license 2 0", 14, 0.95, "artistic"),
    ("perl", r"(?:same terms as|under the same terms as|licensed like) perl(?: itself)?", 14, 0.95, "perl"),
    ("python", r"psf license agreement for python(?: \d(?: \d+)*)?|python software foundation license version 2", 14, 0.95, "python"),
    ("ruby", r"(?:same terms as|license of|licensed like) ruby(?: itself)?", 14, 0.9, "ruby"),
    ("php-3.01", r"this source file is subject to version 3 01 of the php license", 5, 1.0, "php"),
    ("openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit", 5, 1.0, "toolkit"),
    ("ssleay", r"this product includes cryptographic software written by eric young", 5, 1.0, "cryptographic"),
    ("postgresql", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement", 4, 1.0, "agreement"),
    ("ofl-1.1", r"this font software is licensed under the sil open font license version 1 1", 4, 1.0, "font"),
    ("ofl-1.1", r"scripts sil org ofl|openfontlicense org", 7, 1.0, "sil openfontlicense"),
    ("tcl", r"this software is copyrighted by the regents of the university of california sun microsystems inc", 5, 0.95, "regents"),
    ("vim", r"vim license|license of vim", 14, 0.9, "vim"),
    ("unicode", r"unicode(?: inc)? license(?: agreement| v3)?(?: data files and software)?", 14, 0.9, "unicode"),
    ("latex", r"latex project public license(?: version 1 \d\w?)?|lppl(?: 1 \d\w?)?", 14, 0.95, "latex lppl"),
    ("blueoak", r"blue oak model license(?: 1 0 0)?", 14, 0.95, "oak"),
    # further licenses by their own names and sentences
    ("json", r"the software shall be used for good not evil", 5, 1.0, "evil"),
    ("adaptive", r"adaptive public license(?: 1 0)?", 14, 0.95, "adaptive"),
    ("aladdin", r"aladdin free public license", 14, 0.95, "aladdin"),
    ("ecl-2.0", r"educational community license(?: version)?(?: [12] 0)?", 14, 0.95, "educational"),
    ("efl", r"eiffel forum license(?: version)?(?: [12])?", 14, 0.95, "eiffel"),
    ("erlang", r"erlang public license(?: version)?(?: 1 1)?", 14, 0.95, "erlang"),
    ("frameworx", r"frameworx open license(?: 1 0)?", 14, 0.95, "frameworx"),
    ("ftl", r"freetype (?:project )?license|portions of this software are copyright \w+ the freetype project", 14, 0.95, "freetype"),
    ("ijg", r"this software is based in part on the work of the independent jpeg group", 5, 1.0, "jpeg"),
    ("ijg", r"independent jpeg group license", 14, 0.95, "jpeg"),
    ("icu", r"icu license(?: icu 1 8 1 and later)?", 14, 0.9, "icu"),
    ("imagemagick", r"imagemagick license", 14, 0.95, "imagemagick"),
    ("info-zip", r"info zip license|this is version \w+(?: \w+){0,4} of the info zip license", 13, 0.95, "zip"),
    ("ipa", r"ipa font license(?: agreement)?(?: v1 0)?", 14, 0.95, "ipa"),
    ("jasper", r"jasper license version 2 0", 14, 0.95, "jasper"),
    ("lal", r"licence art libre|free art license(?: 1 \d)?", 14, 0.95, "art"),
    ("liliq", r"licence libre du quebec|liliq (?:p|r|rplus)(?: 1 1)?", 14, 0.95, "libre liliq"),
    ("lpl", r"lucent public license(?: version)?(?: 1 0\d?)?", 14, 0.95, "lucent"),
    ("miros", r"the miros licen[cs]e|provided that these terms and disclaimer and all copyright notices are retained or reproduced", 14, 0.9, "miros disclaimer"),
    ("motosoto", r"motosoto open source license", 14, 0.95, "motosoto"),
    ("multics", r"multics license", 14, 0.95, "multics"),
    ("nasa", r"nasa open source agreement(?: version)?(?: 1 3)?", 14, 0.95, "nasa"),
    ("naumen", r"naumen public license", 14, 0.95, "naumen"),
    ("nethack", r"nethack general public license", 13, 0.95, "nethack"),
    ("nokia", r"nokia open source license", 14, 0.95, "nokia"),
    ("nposl", r"non profit open software license(?: 3 0)?", 13, 0.95, "profit"),
    ("ntp", r"ntp license|the university of delaware makes no representations about the suitability", 14, 0.95, "ntp delaware"),
    ("oclc", r"oclc research public license(?: 2 0)?", 14, 0.95, "oclc"),
    ("ogtsl", r"open group test suite license", 14, 0.95, "suite"),
    ("oldap", r"openldap public license(?: version)?(?: \d(?: \d)*)?", 14, 0.95, "openldap"),
    ("opl", r"open publication license(?: v1 0)?|open content license", 14, 0.9, "publication content"),
    ("osl-3.0", r"open software license (?:version |v )?3 0", 13, 0.95, "open"),
    ("afl-3.0", r"academic free license (?:version |v )?3 0", 13, 0.95, "academic"),
    ("peer", r"peer production license", 14, 0.9, "peer"),
    ("phorum", r"phorum license(?: 2 0)?", 14, 0.9, "phorum"),
    ("qhull", r"qhull copyright|qhull license", 14, 0.9, "qhull"),
    ("qpl", r"q public license(?: version)?(?: 1 0)?", 14, 0.95, "public"),
    ("rpl", r"reciprocal public license(?: 1 [15])?", 14, 0.95, "reciprocal"),
    ("rpsl", r"realnetworks public source license(?: v(?:ersion)? ?1 0)?", 14, 0.95, "realnetworks"),
    ("ricoh", r"ricoh source code public license", 14, 0.95, "ricoh"),
    ("sgi-b", r"sgi free software license b(?: version)?(?: [12] [01])?", 14, 0.95, "sgi"),
    ("simpl", r"simple public license(?: 2 0)?", 14, 0.95, "simple"),
    ("sissl", r"sun industry standards source license(?: version)?(?: 1 [12])?", 13, 0.95, "standards"),
    ("sleepycat", r"sleepycat (?:public )?license|redistributions in any form must be accompanied by information on how to obtain complete source code", 12, 0.95, "sleepycat accompanied"),
    ("smlnj", r"standard ml of new jersey license", 14, 0.95, "jersey"),
    ("torque", r"torque v2 5 software license", 14, 0.95, "torque"),
    ("tmate", r"tmate open source license", 14, 0.95, "tmate"),
    ("vovida", r"vovida software license(?: v 1 0)?", 14, 0.95, "vovida"),
    ("w3c", r"w3c (?:software )?(?:and document )?(?:notice and )?license", 14, 0.95, "w3c"),
    ("w3c", r"permission to copy modify and distribute this work with or without modification for any purpose and without fee or royalty is hereby granted", 5, 0.95, "royalty"),
    ("watcom", r"sybase open watcom public license(?: 1 0)?", 14, 0.95, "watcom"),
    ("wxwidgets", r"wxwidgets licen[cs]e", 14, 0.95, "wxwidgets"),
    ("xfree86", r"xfree86 license(?: 1 1)?", 14, 0.95, "xfree86"),
    ("xnet", r"x net license", 14, 0.95, "net"),
    ("zpl", r"zope public license(?: version| zpl version)?(?: [12] [01])?", 14, 0.95, "zope"),
    ("yahoo", r"yahoo public license(?: v1 [01])?", 14, 0.95, "yahoo"),
    ("eurosym", r"(?:christian )?eurosym license", 14, 0.9, "eurosym"),
    ("bitstream-vera", r"bitstream vera fonts? (?:copyright|license)|bitstream vera is a trademark of bitstream", 14, 0.95, "bitstream"),
    ("ubuntu-font", r"ubuntu font licen[cs]e(?: version)?(?: 1 0)?", 13, 0.95, "ubuntu"),
    ("gust-font", r"gust font (?:source )?license|gust font nosource license", 13, 0.95, "gust"),
    ("kde", r"either version 2 of the license or at your option any later version accepted by the membership of kde", 4, 1.0, "kde"),
    ("hippocratic", r"hippocratic license(?: version)?(?: \d \d)?", 14, 0.95, "hippocratic"),
    ("anti-996", r"anti 996 license(?: version)?(?: 1 0)?", 14, 0.95, "996"),
    ("parity", r"(?:the )?parity public license(?: \d 0 0)?", 14, 0.95, "parity"),
    ("prosperity", r"prosperity public license(?: \d 0 0)?", 14, 0.95, "prosperity"),
    ("confluent", r"confluent community license(?: agreement)?(?: version)?(?: 1 0)?", 14, 0.95, "confluent"),
    ("timescale", r"timescale license agreement|timescale license", 14, 0.95, "timescale"),
    ("redis", r"redis source available license(?: agreement)?(?: rsal)?", 14, 0.95, "redis"),
    ("fsl", r"functional source license(?: version)?(?: 1 [01])?", 14, 0.95, "functional"),
    ("bigcode", r"bigcode open ?rail m(?: v1)?(?: license)?(?: agreement)?", 11, 0.95, "bigcode"),
    ("falcon", r"falcon (?:180b )?(?:tii )?license", 14, 0.9, "falcon"),
    # source-available, models, proprietary
    ("busl-1.1", r"business source license 1 1|busl 1 1|bsl 1 1", 12, 0.95, "business busl bsl"),
    ("sspl-1.0", r"server side public license v(?:ersion)? ?1|sspl(?: v)? ?1(?: 0)?", 12, 0.95, "server sspl"),
    ("elastic-2.0", r"elastic license (?:version )?2 0|elastic license v2", 12, 0.95, "elastic"),
    ("polyform", r"polyform (?:noncommercial|small business|free trial|internal use|strict|shield|perimeter) license(?: 1 0 0)?", 12, 0.95, "polyform"),
    ("openrail", r"(?:bigscience|creativeml) (?:open )?rail(?: m)?(?: license)?|responsible ai licenses?", 12, 0.95, "bigscience creativeml responsible"),
    ("llama", r"llama (?:2|3|3 1|3 2|3 3|4) community license(?: agreement)?", 12, 0.95, "llama"),
    ("gemma", r"gemma (?:terms of use|license)", 12, 0.9, "gemma"),
    ("proprietary", r"this (?:file|software|source code|program) (?:is|contains) (?:the )?(?:proprietary|confidential)(?: and (?:proprietary|confidential))?(?: information)?", 24, 0.85, "proprietary confidential"),
    ("proprietary", r"no part of this (?:publication|work|document|book) may be reproduced(?: distributed)?(?: stored in a retrieval system)?", 24, 0.8, "reproduced"),
    ("proprietary", r"do not (?:copy or )?(?:re)?distribute without (?:prior )?(?:written )?permission", 24, 0.8, "permission"),
    ("proprietary", r"unauthorized (?:use|reproduction|distribution|duplication)(?: or (?:use|reproduction|distribution|duplication))* (?:is|of this \w+ is) (?:strictly )?prohibited", 24, 0.8, "unauthorized"),
    ("non-commercial", r"for (?:personal and )?non ?commercial (?:use|purposes) only|(?:may|can) not be used for commercial purposes", 60, 0.5, "commercial noncommercial"),
    ("evaluation", r"for (?:internal )?evaluation (?:use|purposes) only", 60, 0.5, "evaluation"),
    ("dual", r"(?:dual|double) licen[cs]ed(?: under)?|licensed under either of", 65, 0.4, "licen"),
    ("contributor-agreement", r"contributor licen[cs]e agreement|developer certificate of origin", 65, 0.3, "contributor certificate"),
]

# Names that are a sign without more words: those of FAMILIES that say license, and these. All have one priority, so that the longest wins.
NAMED, NAMED_WEIGHT = 70, 0.5
NAMES = [(label, name, "cc creative") for label, name in FAMILIES if label.startswith("cc-by")] + [
    ("cc0", r"cc0|cc zero|creative commons zero|public domain dedication", "cc cc0 creative dedication"), ("unlicense", r"the unlicense|unlicense", "unlicense"), ("commons-clause", r"commons clause", "commons"),
    ("bsd-0-clause", r"0bsd", "0bsd"), ("mulan", r"mulan (?:permissive|psl)", "mulan"), ("ofl", r"sil ofl", "ofl"), ("openrail", r"openrail(?: m)?", "openrail"),
]


def full_names(name: str) -> list[str]:
    """Of a family's alternatives those that say license, which they may leave out elsewhere."""
    out, depth = [""], 0
    for c in name:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x for x in (re.sub(r"\(\?:( (?:software )?license)\)\?", r"\1", x) for x in out) if "licen" in x]


@cache
def rules() -> list[tuple[re.Pattern, str, int, float, tuple[str, ...]]]:
    """All rules: pattern, label, priority, weight, keywords. A family's place breaks ties between names that contain one another."""
    out = [(p, label, 100 * priority, weight, keys) for label, p, priority, weight, keys in SENTENCES + NOTICES]
    out += [(form.replace("{0}", f"(?:{name})"), label, 100 * priority + place, weight, keys) for place, (label, name) in enumerate(FAMILIES) for _, form, priority, weight, keys in PHRASINGS]
    out += [(name, label, 100 * NAMED, NAMED_WEIGHT, keys) for label, name, keys in NAMES]
    out += [("|".join(full), label, 100 * NAMED, NAMED_WEIGHT, "licen") for label, name in FAMILIES if (full := full_names(name))]
    split = lambda keys: (keys,) if keys == "public domain" else tuple(keys.split())
    return [(re.compile(rf"(?<![^ ])(?:{p})(?![^ ])"), label, priority, weight, split(keys)) for p, label, priority, weight, keys in out]


@cache
def gates() -> dict[str, list[int]]:
    """Keyword to the rules it gates."""
    out: dict[str, list[int]] = {}
    for i, r in enumerate(rules()):
        for k in r[4]:
            out.setdefault(k, []).append(i)
    return out


#: Keywords that begin or end longer words; all others are words.
STEMS = ("licen", "release", "distribut", "publish", "availab", "provid", "cover", "offer", "version", "epl", "cddl", "eupl", "sspl")

#: What the key "v#" stands for, in words and in bytes whose spaces are not joined yet: a v and a number, of any script.
V_NUMBER, V_BYTES = re.compile(r"(?<![^ ])v ?\d"), re.compile(rb"(?<![^ ])v *[0-9\x80-\xff]")


TO_WORDS = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def word_ends(words: str) -> np.ndarray:
    """Where the spaces of words are: as many as lie before a place is the number of the word there."""
    return np.flatnonzero(np.frombuffer(words.encode("utf-32-le"), np.uint32) == 32)


def base_places(words: str, ends: np.ndarray) -> list[tuple[int, int, str]]:
    """(first word, words, label) of every place of a base phrase in text of single-spaced words."""
    out = []
    for phrase, label in BASE:
        found, at = [], words.find(phrase)
        while at >= 0:
            end = at + len(phrase)
            if (at == 0 or words[at - 1] == " ") and (end == len(words) or words[end] == " "):
                found.append(at)
            at = words.find(phrase, at + 1)
        out += [(n, phrase.count(" ") + 1, label) for n in np.searchsorted(ends, found).tolist()]
    return out


def uncontained(found: list[tuple]) -> list[tuple]:
    """Of (rank, first, last, ...) in order of acceptance, those in no interval that was accepted before.

    Accepted intervals that lie in no other, by their first place, have rising last places: the one that begins last at or before an interval tells whether any contains it."""
    kept, firsts, lasts = [], [], []
    for f in found:
        _, a, b, *_ = f
        at = bisect.bisect_right(firsts, a)
        if at and lasts[at - 1] >= b:
            continue
        kept.append(f)
        lo = bisect.bisect_left(firsts, a)
        hi = bisect.bisect_right(lasts, b, lo)
        firsts[lo:hi], lasts[lo:hi] = [a], [b]
    return kept


def is_open(key: str, words: str, held: set[str]) -> bool:
    """Whether a keyword is in a text; held: its words."""
    if key == "v#":
        return V_NUMBER.search(words) is not None
    return key in words if key in STEMS or " " in key else key in held


def detected(words: str, ends: np.ndarray) -> list[tuple[int, int, str, float]]:
    """Accepted detections (first word, words, label, weight) of the rules."""
    found, ran, held = [], set(), set(words.split(" "))
    every = rules()
    for key, ids in gates().items():
        if not is_open(key, words, held):
            continue
        for i in ids:
            if i in ran:
                continue
            ran.add(i)
            pattern, label, priority, weight, _ = every[i]
            found += [(priority, m.start(), m.end(), label, weight) for m in pattern.finditer(words)]
    found.sort(key=lambda f: (f[0], f[1] - f[2], f[1]))
    kept = sorted(uncontained(found), key=lambda k: k[1])
    begin, end = (np.searchsorted(ends, [k[i] for k in kept]).tolist() for i in (1, 2))
    return [(a, b - a + 1, label, weight) for a, b, (_, _, _, label, weight) in zip(begin, end, kept, strict=True)]


ANY_STEM = tuple(k.encode() for k in STEMS)


@cache
def any_word() -> frozenset[bytes]:
    """One of these words or of the stems is in every text that a rule or a base phrase can match, or else V_BYTES is. Tested before spaces are joined, so of a key of two words the last stands for it."""
    return frozenset(k.split()[-1].encode() for r in rules() for k in r[4] if k not in STEMS and k != "v#") | {b"license", b"cc"}


def may_match(part: bytes, tokens: list[bytes]) -> bool:
    """Whether a text, as bytes of lower-case words with any number of spaces between, has a keyword; tokens: its words."""
    return not any_word().isdisjoint(tokens) or any(k in part for k in ANY_STEM) or V_BYTES.search(part) is not None


def scanned(words: str, n_words: int) -> tuple:
    ends = word_ends(words)
    base = base_places(words, ends)
    accepted = detected(words, ends)
    labels = sorted({b[2] for b in base})
    more = sorted({b[2] for b in base} | {a[2] for a in accepted})
    top = max([0.5 * bool(base), *(a[3] for a in accepted)])
    covered, upto = 0, 0
    for a, b in sorted((a, a + n) for a, n, *_ in [*base, *accepted]):
        covered += max(0, b - max(a, upto))
        upto = max(upto, b)
    score = top + (1 - top) * top * covered / max(1, n_words)
    firsts = [b[0] for b in base]
    spans = ",".join(f"{label}:{a}:{a + n}" for a, n, label, _ in accepted)
    return len(base), min(firsts, default=None), max(firsts, default=None), ",".join(labels), ",".join(more), min(1.0, score), spans


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, spans (accepted detections, label:first:end in words)."""
    names = [id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string()]
    none = (0, None, None, "", "", 0.0, "")

    def run(batches):
        for batch in batches:
            column = batch.column(1)
            sizes = [0 if x is None else x for x in pc.binary_length(column).to_pylist()]
            for lo, hi in common.by_bytes(np.array(sizes, np.int64), 8_000_000):
                data, offsets = common.utf8_of(column.slice(lo, hi - lo))
                raw = data.tobytes().translate(TO_WORDS)
                is_word = np.frombuffer(raw, np.uint8) != 32
                begins = is_word.copy()
                begins[1:] &= ~is_word[:-1]
                starts = offsets[:-1][offsets[:-1] < offsets[1:]]
                begins[starts] = is_word[starts]
                counts = np.diff(np.concatenate([[0], np.cumsum(begins)])[offsets])
                rows = []
                for a, b, n in zip(offsets[:-1].tolist(), offsets[1:].tolist(), counts.tolist(), strict=True):
                    part = raw[a:b]
                    tokens = part.split()
                    if may_match(part, tokens):
                        rows.append(scanned(b" ".join(tokens).decode("utf-8", "replace"), n))
                    else:
                        rows.append(none)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(counts, pa.int64()), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=names)

    rows = docs.select(id_col, text)
    return common.arrow(rows, run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string")


def query(spark, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))
