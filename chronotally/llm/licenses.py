"""License scans: ordered signature rules behind a keyword gate, with overlapping detections resolved.

The scan is an expression over one row: a text that holds none of the gate's words costs one pass of one pattern; for the
others only the rules whose keyword stands in the text run. No shuffle, and texts of any length are scanned whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_WORD, ascii_lower, let, with_column
from .secrets import places

WORD = "[^" + NOT_WORD[1:-1]
# The base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
_HEADS = {p.rsplit(" ", 1)[0]: label for p, label in PHRASES.items()}
BASE = f"(?<!{WORD[:-1]}])(" + "|".join(f"(?i:{NOT_WORD.join(h.split())})" for h in _HEADS) + f"){NOT_WORD}(?i:license)(?!{WORD[:-1]}])"

GAP = r"[\s*#/>-]+"
# License families as (SPDX id, keyword, name pattern, host and path of its text). A space in a name stands
# for any run of white space, comment marks or hyphens (GAP). A keyword is one word that every match holds.
FAMILIES = [
    ("0BSD", "bsd", r"(?:(?:zero|0).clause bsd|bsd (?:zero|0).clause)", "opensource.org/licenses/0bsd"),
    ("AFL-2.1", "academic", r"academic free license,? (?:version |v)?2\.1", "opensource.org/licenses/afl-2.1"),
    ("AFL-3.0", "academic", r"academic free license,? (?:version |v)?3\.0", "opensource.org/licenses/afl-3.0"),
    ("AGPL-1.0", "affero", r"affero general public license,? (?:version |v)?1", "affero.org/oagpl"),
    ("AGPL-3.0", "affero", r"(?:gnu )?affero general public license,? (?:version |v)?3", "gnu.org/licenses/agpl"),
    ("APSL-2.0", "apple", r"apple public source license,? (?:version |v)?2", "opensource.apple.com/apsl"),
    ("Apache-1.0", "apache", r"apache (?:software )?license,? (?:version |v)?1\.0", "apache.org/licenses/license-1.0"),
    ("Apache-1.1", "apache", r"apache (?:software )?license,? (?:version |v)?1\.1", "apache.org/licenses/license-1.1"),
    ("Apache-2.0", "apache", r"apache (?:software )?license,? (?:version |v)?2(?:\.0)?", "apache.org/licenses/license-2.0"),
    ("Artistic-1.0", "artistic", r"artistic license,? (?:version |v)?1\.0", "opensource.org/licenses/artistic-license-1.0"),
    ("Artistic-2.0", "artistic", r"artistic license,? (?:version |v)?2\.0", "perlfoundation.org/artistic-license-2-0"),
    ("BSD-1-Clause", "bsd", r"(?:(?:1|one).clause bsd|bsd (?:1|one).clause)", "opensource.org/licenses/bsd-1-clause"),
    ("BSD-2-Clause", "bsd", r"(?:(?:(?:2|two).clause|simplified|freebsd) bsd|bsd (?:2|two).clause)", "opensource.org/licenses/bsd-2-clause"),
    ("BSD-3-Clause", "bsd", r"(?:(?:(?:3|three).clause|new|modified|revised) bsd|bsd (?:3|three).clause)", "opensource.org/licenses/bsd-3-clause"),
    ("BSD-4-Clause", "bsd", r"(?:(?:(?:4|four).clause|original|old) bsd|bsd (?:4|four).clause)", "directory.fsf.org/wiki/license:bsd-4clause"),
    ("BSL-1.0", "boost", r"boost software license", "boost.org/license_1_0"),
    ("BUSL-1.1", "business", r"business source license,? (?:version |v)?1\.1", "mariadb.com/bsl11"),
    ("CC-BY-2.0", "attribution", r"(?:creative commons|cc) attribution 2\.0", "creativecommons.org/licenses/by/2.0"),
    ("CC-BY-3.0", "attribution", r"(?:creative commons|cc) attribution 3\.0", "creativecommons.org/licenses/by/3.0"),
    ("CC-BY-4.0", "attribution", r"(?:creative commons|cc) attribution 4\.0", "creativecommons.org/licenses/by/4.0"),
    ("CC-BY-NC-4.0", "attribution", r"attribution noncommercial 4\.0", "creativecommons.org/licenses/by-nc/4.0"),
    ("CC-BY-NC-ND-4.0", "attribution", r"attribution noncommercial noderiv(?:ative)?s 4\.0", "creativecommons.org/licenses/by-nc-nd/4.0"),
    ("CC-BY-NC-SA-4.0", "attribution", r"attribution noncommercial sharealike 4\.0", "creativecommons.org/licenses/by-nc-sa/4.0"),
    ("CC-BY-ND-4.0", "attribution", r"attribution noderiv(?:ative)?s 4\.0", "creativecommons.org/licenses/by-nd/4.0"),
    ("CC-BY-SA-3.0", "attribution", r"attribution sharealike 3\.0", "creativecommons.org/licenses/by-sa/3.0"),
    ("CC-BY-SA-4.0", "attribution", r"attribution sharealike 4\.0", "creativecommons.org/licenses/by-sa/4.0"),
    ("CC0-1.0", "cc0", r"cc0(?: 1\.0)?(?: universal)?", "creativecommons.org/publicdomain/zero/1.0"),
    ("CDDL-1.0", "distribution", r"common development and distribution license,? (?:\(cddl\) )?(?:version |v)?1\.0", "opensource.org/licenses/cddl-1.0"),
    ("CDDL-1.1", "distribution", r"common development and distribution license,? (?:\(cddl\) )?(?:version |v)?1\.1", "oss.oracle.com/licenses/cddl-1.1"),
    ("CECILL-2.1", "cecill", r"cecill free software license(?: agreement)?", "cecill.info/licences/licence_cecill_v2.1"),
    ("CECILL-B", "cecill", r"cecill.b", "cecill.info/licences/licence_cecill-b"),
    ("CECILL-C", "cecill", r"cecill.c", "cecill.info/licences/licence_cecill-c"),
    ("CPL-1.0", "common", r"common public license,? (?:version |v)?1\.0", "opensource.org/licenses/cpl1.0"),
    ("ECL-2.0", "educational", r"educational community license,? (?:version |v)?2\.0", "opensource.org/licenses/ecl-2.0"),
    ("EFL-2.0", "eiffel", r"eiffel forum license,? (?:version |v)?2", "opensource.org/licenses/efl-2.0"),
    ("EPL-1.0", "eclipse", r"eclipse public license,? (?:version |v)?1\.0", "eclipse.org/legal/epl-v10"),
    ("EPL-2.0", "eclipse", r"eclipse public license,? (?:version |v)?2\.0", "eclipse.org/legal/epl-2.0"),
    ("EUPL-1.1", "european", r"european union public licen[cs]e,? (?:version |v)?1\.1", "joinup.ec.europa.eu/software/page/eupl"),
    ("EUPL-1.2", "european", r"european union public licen[cs]e,? (?:version |v)?1\.2", "joinup.ec.europa.eu/collection/eupl"),
    ("FTL", "freetype", r"freetype (?:project )?license", "freetype.org/license"),
    ("GFDL-1.3", "documentation", r"gnu free documentation license", "gnu.org/licenses/fdl"),
    ("GPL-1.0", "general", r"(?:gnu )?general public license,? (?:version |v)?1", "gnu.org/licenses/gpl-1.0"),
    ("GPL-2.0", "general", r"(?:gnu )?general public license,? (?:version |v)?2", "gnu.org/licenses/gpl-2.0"),
    ("GPL-3.0", "general", r"(?:gnu )?general public license,? (?:version |v)?3", "gnu.org/licenses/gpl-3.0"),
    ("HPND", "historical", r"historical permission notice and disclaimer", "opensource.org/licenses/hpnd"),
    ("ICU", "icu", r"icu license", "source.icu-project.org/repos/icu/trunk/icu4j/main/shared/licenses"),
    ("IPL-1.0", "ibm", r"ibm public license,? (?:version |v)?1\.0", "opensource.org/licenses/ipl-1.0"),
    ("ISC", "isc", r"isc license", "opensource.org/licenses/isc"),
    ("JSON", "json", r"json license", "json.org/license"),
    ("LGPL-2.0", "library", r"(?:gnu )?library general public license,? (?:version |v)?2", "gnu.org/licenses/lgpl-2.0"),
    ("LGPL-2.1", "lesser", r"(?:gnu )?lesser general public license,? (?:version |v)?2\.1", "gnu.org/licenses/lgpl-2.1"),
    ("LGPL-3.0", "lesser", r"(?:gnu )?lesser general public license,? (?:version |v)?3", "gnu.org/licenses/lgpl-3.0"),
    ("LPL-1.02", "lucent", r"lucent public license,? (?:version |v)?1\.02", "opensource.org/licenses/lpl-1.02"),
    ("LPPL-1.3c", "latex", r"latex project public license", "latex-project.org/lppl"),
    ("MIT", "mit", r"mit license", "opensource.org/licenses/mit"),
    ("MIT-0", "mit", r"mit no attribution", "opensource.org/licenses/mit-0"),
    ("MPL-1.0", "mozilla", r"mozilla public license,? (?:version |v)?1\.0", "mozilla.org/mpl/mpl-1.0"),
    ("MPL-1.1", "mozilla", r"mozilla public license,? (?:version |v)?1\.1", "mozilla.org/mpl/mpl-1.1"),
    ("MPL-2.0", "mozilla", r"mozilla public license,? (?:version |v)?2\.0", "mozilla.org/mpl/2.0"),
    ("MS-PL", "microsoft", r"microsoft public license", "opensource.org/licenses/ms-pl"),
    ("MS-RL", "microsoft", r"microsoft reciprocal license", "opensource.org/licenses/ms-rl"),
    ("MulanPSL-2.0", "mulan", r"mulan (?:permissive software license|psl),? (?:version |v)?2", "license.coscl.org.cn/mulanpsl2"),
    ("NCSA", "illinois", r"university of illinois/?ncsa open source license", "opensource.org/licenses/ncsa"),
    ("NPL-1.1", "netscape", r"netscape public license,? (?:version |v)?1\.1", "mozilla.org/mpl/npl"),
    ("ODbL-1.0", "database", r"open database license", "opendatacommons.org/licenses/odbl"),
    ("OFL-1.1", "font", r"sil open font license", "scripts.sil.org/ofl"),
    ("OSL-3.0", "open", r"open software license,? (?:version |v)?3\.0", "opensource.org/licenses/osl-3.0"),
    ("OpenSSL", "openssl", r"openssl license", "openssl.org/source/license"),
    ("PDDL-1.0", "dedication", r"public domain dedication (?:&|and) license", "opendatacommons.org/licenses/pddl"),
    ("PHP-3.01", "php", r"php license,? (?:version |v)?3\.01", "php.net/license/3_01"),
    ("PostgreSQL", "postgresql", r"postgresql licen[cs]e", "postgresql.org/about/licence"),
    ("PSF-2.0", "python", r"python software foundation license", "docs.python.org/license"),
    ("QPL-1.0", "public", r"q public license", "opensource.org/licenses/qpl-1.0"),
    ("Ruby", "ruby", r"ruby license", "ruby-lang.org/en/about/license"),
    ("SSPL-1.0", "server", r"server side public license", "mongodb.com/licensing/server-side-public-license"),
    ("Unicode-DFS-2016", "unicode", r"unicode,? inc\.? license agreement", "unicode.org/copyright"),
    ("Unlicense", "unlicense", r"the unlicense", "unlicense.org"),
    ("UPL-1.0", "universal", r"universal permissive license", "opensource.org/licenses/upl"),
    ("Vim", "vim", r"vim license", "vimdoc.sourceforge.net/htmldoc/uganda"),
    ("W3C", "w3c", r"w3c software (?:notice and|and document) license", "w3.org/consortium/legal"),
    ("WTFPL", "want", r"do what the f[u*]ck you want to public license", "wtfpl.net"),
    ("X11", "x11", r"x11 license", "xfree86.org/3.3.6/copyright2"),
    ("Zlib", "zlib", r"zlib(?:/libpng)? license", "zlib.net/zlib_license"),
    ("ZPL-2.1", "zope", r"zope public license,? (?:version |v)?2\.1", "opensource.org/licenses/zpl-2.1"),
]
# Sentences that stand in a license's text or notice, as (SPDX id or a name like it, keyword, pattern).
NOTICES = [
    ("MIT", "hereby", r"permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("MIT", "mit", r"(?:released|licensed|distributed|available|published|provided) under (?:the )?(?:terms of the )?mit license"),
    ("MIT", "merge", r"to use, copy, modify, merge, publish, distribute, sublicense, and/?(?:or)? sell copies"),
    ("MIT", "mit", r"use of this source code is governed by an? mit.style license"),
    ("MIT", "mit", r"dual licensed under the mit"),
    ("MIT", "mit", r"mit/x11 license"),
    ("MIT-0", "mit", r"licensed under the mit.0 license"),
    ("MIT-CMU", "carnegie", r"permission to use, copy, modify and distribute this software and its documentation is hereby granted, .{0,200}carnegie mellon"),
    ("X11", "consortium", r"except as contained in this notice, the name of the x consortium shall not be used in advertising"),
    ("Apache-2.0", "apache", r"licensed under the apache license,? version 2\.0"),
    ("Apache-2.0", "apache", r"(?:released|distributed|available|published) under (?:the )?(?:terms of the )?apache(?: software)? license,? (?:version |v)?2"),
    ("Apache-2.0", "compliance", r"you may not use this file except in compliance with the license"),
    ("Apache-2.0", "foundation", r"licensed to the apache software foundation \(asf\) under one or more contributor license agreements"),
    ("Apache-2.0", "apache", r"this product includes software developed (?:at|by) the apache software foundation .{0,80}licensed"),
    ("Apache-1.1", "acknowledgment", r"this product includes software developed by the apache software foundation .{0,200}alternately, this acknowledgment may appear"),
    ("Apache", "apache", r"apache license"),
    ("GPL", "general", r"(?:gnu )?general public license"),
    ("GPL-1.0", "later", r"either version 1 of the license, or \(at your option\) any later version"),
    ("GPL-2.0", "later", r"either version 2 of the license, or \(at your option\) any later version"),
    ("GPL-3.0", "later", r"either version 3 of the license, or \(at your option\) any later version"),
    ("GPL-2.0", "general", r"under the terms of the gnu general public license,? version 2"),
    ("GPL-3.0", "general", r"under the terms of the gnu general public license,? version 3"),
    ("GPL-2.0", "general", r"under the terms of version 2 of the gnu general public license"),
    ("GPL-3.0", "general", r"under the terms of version 3 of the gnu general public license"),
    ("GPL-2.0", "gplv2", r"licensed under (?:the )?(?:gnu )?gplv2"),
    ("GPL-3.0", "gplv3", r"licensed under (?:the )?(?:gnu )?gplv3"),
    ("GPL", "redistribute", r"this program is free software[:;,]? you can redistribute it and/?(?:or)? modify it under the terms of the gnu (?:general )?public license"),
    ("GPL", "received", r"you should have received a copy of the gnu general public license"),
    ("GPL-2.0", "exception", r"as a special exception, .{0,120}permission to link"),
    ("LGPL", "lesser", r"(?:gnu )?lesser general public license"),
    ("LGPL", "library", r"(?:gnu )?library general public license"),
    ("LGPL", "received", r"you should have received a copy of the gnu lesser general public license"),
    ("LGPL-2.1", "lesser", r"under the terms of the gnu lesser general public license as published by the free software foundation[;,]? either version 2\.1"),
    ("LGPL-3.0", "lesser", r"under the terms of the gnu lesser general public license as published by the free software foundation[;,]? either version 3"),
    ("LGPL-2.0", "library", r"under the terms of the gnu library general public license as published by the free software foundation[;,]? either version 2"),
    ("LGPL-3.0", "lgplv3", r"licensed under (?:the )?(?:gnu )?lgplv3"),
    ("AGPL-3.0", "affero", r"under the terms of the gnu affero general public license"),
    ("AGPL-3.0", "affero", r"you should have received a copy of the gnu affero general public license"),
    ("AGPL-3.0", "agplv3", r"licensed under (?:the )?(?:gnu )?agplv3"),
    ("GFDL", "documentation", r"permission is granted to copy, distribute and/?(?:or)? modify this document under the terms of the gnu free documentation license"),
    ("GFDL-1.1", "documentation", r"gnu free documentation license,? version 1\.1"),
    ("GFDL-1.2", "documentation", r"gnu free documentation license,? version 1\.2"),
    ("GFDL-1.3", "documentation", r"gnu free documentation license,? version 1\.3"),
    ("BSD", "redistribution", r"redistribution and use in source and binary forms, with or without modification"),
    ("BSD", "bsd", r"(?:released|licensed|distributed|available) under (?:the |a )?(?:terms of the )?bsd(?:.style)? license"),
    ("BSD", "bsd", r"use of this source code is governed by a bsd.style license"),
    ("BSD-2-Clause", "redistributions", r"redistributions of source code must retain the above copyright notice immediately at the beginning of the file"),
    ("BSD", "redistributions", r"redistributions in binary form must reproduce the above copyright notice"),
    ("BSD-3-Clause", "endorse", r"neither the name of .{1,80} nor the names of its contributors may be used to endorse"),
    ("BSD-3-Clause", "endorse", r"the names? of the (?:authors?|contributors?) may not be used to endorse or promote products derived from this software without .{0,40}permission"),
    ("BSD-4-Clause", "advertising", r"all advertising materials mentioning features or use of this software"),
    ("BSD-3-Clause-Clear", "patent", r"no express or implied licenses to any party's patent rights are granted by this license"),
    ("BSD-Source-Code", "source", r"redistribution of this source code must retain"),
    ("ISC", "permission", r"permission to use, copy, modify, and/?(?:or)? distribute this software for any purpose"),
    ("0BSD", "permission", r"permission to use, copy, modify, and/?(?:or)? distribute this software for any purpose with or without fee is hereby granted\. the software is provided"),
    ("ISC", "isc", r"(?:released|licensed|distributed|available) under (?:the )?(?:terms of the )?isc license"),
    ("MPL-1.1", "mozilla", r"subject to the mozilla public license version 1\.1"),
    ("MPL-1.1", "rights", r"software distributed under the license is distributed on an as is basis, without warranty of any kind, either express or implied\. see the license for the specific language governing rights"),
    ("MPL-2.0", "mozilla", r"subject to the terms of the mozilla public license, v\. 2\.0"),
    ("MPL-2.0", "incompatible", r"this source code form is incompatible with secondary licenses"),
    ("MPL-2.0", "mpl", r"a copy of the mpl was not distributed with this file, .{0,80}license"),
    ("NPL-1.1", "netscape", r"subject to the netscape public license"),
    ("EPL-1.0", "eclipse", r"accompanying materials are made available under the terms of the eclipse public license v1\.0"),
    ("EPL-2.0", "eclipse", r"accompanying materials are made available under the terms of the eclipse public license(?: v| )2\.0"),
    ("CPL-1.0", "common", r"accompanying materials are made available under the terms of the common public license"),
    ("EPL-2.0", "secondary", r"this source code may also be made available under the following secondary licenses"),
    ("CDDL-1.0", "distribution", r"subject to the terms of the common development and distribution license"),
    ("CDDL-1.0", "cddl", r"you may not use this file except in compliance with the cddl license"),
    ("BSL-1.0", "boost", r"distributed under the boost software license"),
    ("BSL-1.0", "hereby", r"permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software"),
    ("BSL-1.0", "boost", r"use, modification and distribution (?:is|are) subject to the boost software license"),
    ("Unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("Unlicense", "unlicense", r"(?:released|licensed|available) under the unlicense"),
    ("Zlib", "as-is", r"this software is provided 'as-is', without any express or implied warranty"),
    ("Zlib", "misrepresented", r"the origin of this software must not be misrepresented.{0,400}plainly marked as such.{0,200}warrant"),
    ("Zlib", "granted", r"permission is granted to anyone to use this software for any purpose, including commercial applications"),
    ("Libpng", "png", r"the png reference library is supplied as is.{0,300}warrant"),
    ("bzip2-1.0.6", "bzip2", r"bzip2 .{0,200}redistribution"),
    ("curl", "permission", r"permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies\. the software is provided"),
    ("NTP", "permission", r"permission to use, copy, modify, and distribute this software and its documentation for any purpose with or without fee is hereby granted"),
    ("HPND", "permission", r"permission to use, copy, modify and distribute this software and its documentation for any purpose and without fee is hereby granted"),
    ("PostgreSQL", "postgresql", r"(?:released|licensed|distributed|available) under (?:the )?(?:terms of the )?postgresql licen[cs]e"),
    ("Python-2.0", "python", r"licensed under the (?:psf|python software foundation) license"),
    ("PSF-2.0", "beopen", r"beopen python open source license agreement"),
    ("CNRI-Python", "cnri", r"cnri open source (?:gpl.compatible )?license agreement"),
    ("PHP-3.0", "php", r"php license,? (?:version |v)?3\.0"),
    ("PHP-3.01", "php", r"this source file is subject to version 3\.01 of the php license"),
    ("PHP-3.0", "php", r"this source file is subject to version 3\.0 of the php license"),
    ("Artistic", "artistic", r"(?:released|licensed|distributed|available) under (?:the )?(?:terms of the )?artistic license"),
    ("Artistic", "perl", r"under the same terms as perl itself.{0,80}license"),
    ("Ruby", "ruby", r"under the same terms as ruby.{0,80}license"),
    ("Ruby", "ruby", r"(?:released|licensed|distributed) under (?:the )?(?:terms of the )?ruby license"),
    ("WTFPL", "everyone", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document"),
    ("Beerware", "beer", r"the beer.ware license"),
    ("Beerware", "beer", r"you can buy me a beer in return.{0,80}license"),
    ("CC-BY", "attribution", r"licensed under (?:a |the )?(?:creative commons|cc) attribution"),
    ("CC-BY-SA", "sharealike", r"licensed under (?:a |the )?(?:creative commons|cc) attribution.sharealike"),
    ("CC-BY-NC", "noncommercial", r"licensed under (?:a |the )?(?:creative commons|cc) attribution.noncommercial"),
    ("CC-BY-ND", "noderivatives", r"licensed under (?:a |the )?(?:creative commons|cc) attribution.noderivatives"),
    ("CC0-1.0", "cc0", r"(?:released|licensed|dedicated|available) under (?:the )?cc0"),
    ("CC0-1.0", "waived", r"has waived all copyright and related or neighboring rights.{0,120}public domain"),
    ("CC0-1.0", "possible", r"to the extent possible under law, .{0,120}public domain"),
    ("OFL-1.1", "font", r"this font software is licensed under the sil open font license"),
    ("OFL-1.1", "reserved", r"with reserved font name.{0,200}license"),
    ("UPL-1.0", "universal", r"licensed under the universal permissive license"),
    ("EUPL-1.2", "eupl", r"licensed under the eupl(?:,? version 1\.2|.1\.2)"),
    ("EUPL-1.1", "eupl", r"licensed under the eupl(?:,? version 1\.1|.1\.1)"),
    ("CECILL-2.1", "cecill", r"governed by the cecill license under french law"),
    ("CECILL-B", "cecill", r"governed by the cecill.b license under french law"),
    ("CECILL-C", "cecill", r"governed by the cecill.c license under french law"),
    ("MS-PL", "microsoft", r"(?:released|licensed|subject) (?:under|to) (?:the )?(?:terms of the )?microsoft public license"),
    ("MS-RL", "microsoft", r"(?:released|licensed|subject) (?:under|to) (?:the )?(?:terms of the )?microsoft reciprocal license"),
    ("MS-LPL", "microsoft", r"microsoft limited public license"),
    ("QPL-1.0", "trolltech", r"may be distributed under the terms of the q public license as defined by trolltech"),
    ("OSL-3.0", "open", r"licensed under the open software license version 3\.0"),
    ("AFL-3.0", "academic", r"licensed under the academic free license version 3\.0"),
    ("ECL-2.0", "educational", r"licensed under the educational community license,? version 2\.0"),
    ("Elastic-2.0", "elastic", r"elastic license,? (?:version |v)?2(?:\.0)?"),
    ("Elastic-2.0", "elastic", r"licensed under the elastic license"),
    ("SSPL-1.0", "server", r"licensed under the server side public license"),
    ("BUSL-1.1", "business", r"(?:licensed|governed) (?:under|by) the business source license"),
    ("BUSL-1.1", "production", r"additional use grant.{0,300}production use.{0,300}licens"),
    ("Commons-Clause", "commons", r"commons clause license condition"),
    ("PolyForm", "polyform", r"polyform (?:noncommercial|small business|free trial|shield|perimeter|strict|internal use) license"),
    ("Hippocratic", "hippocratic", r"hippocratic license"),
    ("Blue-Oak", "blue", r"blue oak model license"),
    ("Parity", "parity", r"parity public license"),
    ("RPL-1.5", "reciprocal", r"reciprocal public license"),
    ("OpenLDAP", "openldap", r"openldap public license"),
    ("OLDAP-2.8", "redistribution", r"redistribution and use of this software and associated documentation .{0,40}with or without modification"),
    ("OpenSSL", "openssl", r"this product includes software developed by the openssl project.{0,200}license"),
    ("SSLeay", "eric", r"this package is an ssl implementation written by eric young.{0,400}permission"),
    ("ICU", "icu", r"icu license - icu 1\.8\.1 and later"),
    ("Unicode", "unicode", r"unicode license agreement"),
    ("IJG", "independent", r"this software is based in part on the work of the independent jpeg group.{0,200}licens"),
    ("FTL", "freetype", r"portions of this software are copyright .{0,60}the freetype project.{0,120}rights reserved"),
    ("NASA-1.3", "nasa", r"nasa open source agreement.{0,200}license"),
    ("ODC-By-1.0", "attribution", r"open data commons attribution license"),
    ("ODbL-1.0", "database", r"made available under the open database license"),
    ("PDDL-1.0", "dedication", r"open data commons public domain dedication"),
    ("OGL-UK", "government", r"open government licen[cs]e"),
    ("Etalab", "etalab", r"etalab .{0,20}licen[cs]e ouverte"),
    ("IPA", "ipa", r"ipa font license"),
    ("GUST", "gust", r"gust font license"),
    ("LPPL", "lppl", r"under the conditions of the latex project public license.{0,40}lppl"),
    ("Sleepycat", "sleepycat", r"sleepycat license"),
    ("SISSL", "sun", r"sun industry standards source license"),
    ("SPL-1.0", "sun", r"sun public license"),
    ("RPSL", "realnetworks", r"realnetworks public source license"),
    ("APSL", "apple", r"subject to the apple public source license"),
    ("Intel", "intel", r"intel open source license"),
    ("Nokia", "nokia", r"nokia open source license"),
    ("Motosoto", "motosoto", r"motosoto open source license"),
    ("Naumen", "naumen", r"naumen public license"),
    ("Frameworx", "frameworx", r"frameworx open license"),
    ("Entessa", "entessa", r"entessa public license"),
    ("CUA-OPL", "cua", r"cua office public license"),
    ("Xnet", "net", r"x\.net license"),
    ("VSL", "vovida", r"vovida software license"),
    ("Watcom", "watcom", r"sybase open watcom public license"),
    ("wxWindows", "wxwindows", r"wxwindows library licen[cs]e"),
    ("Multics", "multics", r"multics license"),
    ("OCLC", "oclc", r"oclc research public license"),
    ("LiLiQ", "québec", r"licence libre du québec"),
    ("Proprietary", "reserved", r"all rights reserved\.? (?:unauthori[sz]ed|no part)"),
    ("Proprietary", "confidential", r"confidential and proprietary.{0,80}rights reserved"),
    ("Proprietary", "permission", r"(?:may not|must not) be (?:copied|reproduced|distributed|used).{0,60}without (?:the )?(?:prior |express )*(?:written )?permission"),
    ("Proprietary", "evaluation", r"licensed for evaluation (?:purposes )?only"),
    ("Proprietary", "agreement", r"subject to the terms of (?:an|the|your) end.user license agreement"),
    ("Noncommercial", "commercial", r"licensed for non.?commercial (?:use|purposes)(?: only)?"),
    ("Public-Domain", "domain", r"(?:placed|released|dedicated) (?:in|into|to) the public domain"),
    ("Public-Domain", "domain", r"this (?:file|work|software|code|program|text) is (?:hereby )?in the public domain"),
    ("Public-Domain", "domain", r"no copyright is claimed.{0,80}public domain"),
    ("Public-Domain", "domain", r"work of the (?:u\.?s\.?|united states) government.{0,120}public domain"),
]
#: Of a rule's kind: the higher priority wins, and the confidence that it gives.
KINDS = {"tag": (3, 1.0), "link": (2, 0.95), "notice": (1, 0.9), "name": (0, 0.8)}
#: A text without any of these words has no rule to run.
GATE = r"(?i)licen[sc]|warrant|consortium|acknowledgment|spdx|permission|redistribution|public domain|rights reserved|unencumbered|as-is|advertising materials|cc0|cecill|endorse|bsd|attribution|mulan|wtfpl|\.(?:org|net|com|eu|cn)/".replace(" ", GAP)


def rules() -> list[tuple[str, str, str, int, float]]:
    """(label, keyword, pattern, priority, confidence) of every rule, in the order in which ties are settled."""
    name = lambda p: r"(?i)\b" + p.replace(" ", GAP) + r"\b"
    dots = lambda p: p.replace(".", r"\.")
    # every id of a tag's expression, wherever it stands in it
    tag = r"(?i)(?<=spdx-license-identifier:[ \w.()+-]{0,120})(?<![\w.+-])"
    out = [(spdx, "spdx", tag + dots(spdx) + r"(?:-only|-or-later|\+)?(?![\w.-])", "tag") for spdx, *_ in FAMILIES]
    out += [(spdx, url.split("/")[0], "(?i)" + dots(url), "link") for spdx, _, _, url in FAMILIES]
    out += [(spdx, keyword, name(p), "notice") for spdx, keyword, p in NOTICES]
    out += [(spdx, keyword, name(p), "name") for spdx, keyword, p, _ in FAMILIES]
    return [(spdx.lower(), keyword, p, *KINDS[kind]) for spdx, keyword, p, kind in out]


def _count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(text, NOT_WORD), "")).cast("long")


def base_places(text: Column) -> Column:
    """struct<n_words,n_base,first_word,last_word,labels> of the base phrases in a text that is not null."""
    head = F.transform(F.regexp_extract_all(text, F.lit(BASE), F.lit(1)), lambda h: F.regexp_replace(ascii_lower(h), NOT_WORD, " "))
    names = F.create_map(*(F.lit(x) for pair in _HEADS.items() for x in pair))
    length = lambda h: F.size(F.split(h, " ")) + 1

    def placed(n: Column) -> Column:
        found = F.struct(F.split(text, BASE).alias("gaps"), head.alias("heads"))
        return let(
            found,
            lambda x: F.struct(
                n.alias("n_words"),
                F.size(x["heads"]).cast("long").alias("n_base"),
                _count(F.get(x["gaps"], F.lit(0))).alias("first_word"),
                (n - _count(F.element_at(x["gaps"], -1)) - length(F.element_at(x["heads"], -1))).cast("long").alias("last_word"),
                F.array_sort(F.array_distinct(F.transform(x["heads"], lambda h: F.element_at(names, h)))).alias("labels"),
            ),
        )

    nothing = lambda n: F.struct(n.alias("n_words"), F.lit(0).cast("long").alias("n_base"), F.lit(None).cast("long").alias("first_word"), F.lit(None).cast("long").alias("last_word"), F.array().cast("array<string>").alias("labels"))
    return let(_count(text), lambda n: F.when(text.rlike(BASE), placed(n)).otherwise(nothing(n)))


def detections(text: Column) -> Column:
    """array<struct<start,end,priority,label,confidence>> of the rules' detections in a text that is not null, sorted by
    start. A detection inside another of the same or a higher priority is left out; of equal ones the first rule's stays."""
    table = F.array(*(F.struct(F.lit(label).alias("label"), F.lit(word).alias("word"), F.lit(p).alias("pattern"), F.lit(n).alias("priority"), F.lit(c).alias("confidence"), F.lit(i).alias("rank")) for i, (label, word, p, n, c) in enumerate(rules())))
    keywords = F.array(*map(F.lit, sorted({r[1] for r in rules()})))
    kind = "array<struct<start:int,end:int,priority:int,label:string,confidence:double>>"

    def of(rule: Column) -> Column:
        order = lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("to"), (-rule["priority"]).alias("low"), rule["rank"].alias("rank"), rule["label"].alias("label"), rule["confidence"].alias("confidence"))
        return F.transform(places(text, rule["pattern"], lambda s: F.lit(True)), order)

    def sweep(found: Column) -> Column:
        levels = range(len(KINDS))
        start = F.struct(F.array(*(F.lit(-1) for _ in levels)).alias("ends"), F.array().cast(kind).alias("kept"))

        def step(a: Column, x: Column) -> Column:
            end, priority = -x["to"], -x["low"]
            here = F.struct(x["start"].alias("start"), end.alias("end"), priority.alias("priority"), x["label"].alias("label"), x["confidence"].alias("confidence"))
            # ends[p]: how far detections of priority p or more have reached
            ends = F.transform(a["ends"], lambda e, p: F.when(p <= priority, F.greatest(e, end)).otherwise(e))
            return F.when(F.get(a["ends"], priority) >= end, a).otherwise(F.struct(ends.alias("ends"), F.concat(a["kept"], F.array(here)).alias("kept")))

        return F.aggregate(F.sort_array(found), start, step, lambda a: a["kept"])

    def gated(low: Column) -> Column:
        return let(F.filter(keywords, lambda k: F.contains(low, k)), lambda here: sweep(F.flatten(F.transform(F.filter(table, lambda r: F.array_contains(here, r["word"])), of))))

    return F.when(text.rlike(GATE), let(ascii_lower(text), gated)).otherwise(F.array().cast(kind))


def scan(df: DataFrame, text: str = "text", out: str = "licenses") -> DataFrame:
    """Adds a struct `out`: n_words, n_base, first_word, last_word, base_labels, labels, score and found (the detections).

    Null text counts as empty: no words, no labels, score 0. The score is the highest confidence among detections, base
    phrases counting as names. Rows are scanned one by one, so repeated rows agree, and other columns stay as they are."""
    whole = F.coalesce(F.col(text), F.lit(""))

    def joined(b: Column, d: Column) -> Column:
        labels = F.array_sort(F.array_union(b["labels"], F.transform(d, lambda x: x["label"])))
        score = F.greatest(F.coalesce(F.array_max(F.transform(d, lambda x: x["confidence"])), F.lit(0.0)), F.when(b["n_base"] > 0, F.lit(KINDS["name"][1])).otherwise(F.lit(0.0)))
        return F.struct(*(b[c].alias(c) for c in ("n_words", "n_base", "first_word", "last_word")), F.array_join(b["labels"], ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"), d.alias("found"))

    return with_column(df, out, let(base_places(whole), lambda b: let(detections(whole), lambda d: joined(b, d))))
