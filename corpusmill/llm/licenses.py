"""License scans: ordered signature rules over word-normalised text.

Every rule has a keyword, and its regular expression runs only on texts that hold the
keyword. A detection is suppressed where its interval lies within that of a
detection of higher priority. All of it happens within a row: nothing is shuffled. Only
DataFrame functions run here.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, collected, documents, outermost, places

#: The base phrases and their labels.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

_V = r"(?:v|ver|version|license|licence|licen[cs]e version|licen[cs]e v)"
_NUMBERED = [  # label, keyword, name in words, versions
    ("gpl", "general public", r"(?:gnu )?general public licen[cs]e", ["1", "2", "3"]),
    ("lgpl", "general public", r"(?:gnu )?(?:lesser|library) general public licen[cs]e", ["2", "2 1", "3"]),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[cs]e", ["1", "3"]),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation licen[cs]e", ["1 1", "1 2", "1 3"]),
    ("apache", "apache", r"apache(?: software)? licen[cs]e", ["1", "1 1", "2", "2 0"]),
    ("mpl", "mozilla", r"mozilla public licen[cs]e", ["1", "1 0", "1 1", "2", "2 0"]),
    ("epl", "eclipse", r"eclipse public licen[cs]e", ["1", "1 0", "2", "2 0"]),
    ("cpl", "common public", r"common public licen[cs]e", ["0 5", "1 0"]),
    ("cddl", "common development", r"common development and distribution licen[cs]e", ["1", "1 0", "1 1"]),
    ("eupl", "european union", r"european union public licen[cs]e", ["1 0", "1 1", "1 2"]),
    ("artistic", "artistic", r"artistic licen[cs]e", ["1 0", "2 0"]),
    ("osl", "open software", r"open software licen[cs]e", ["1 0", "1 1", "2 0", "2 1", "3 0"]),
    ("afl", "academic free", r"academic free licen[cs]e", ["1 1", "1 2", "2 0", "2 1", "3 0"]),
    ("ofl", "open font", r"(?:sil )?open font licen[cs]e", ["1 0", "1 1"]),
    ("bsl", "boost", r"boost software licen[cs]e", ["1 0"]),
    ("php", "php", r"php licen[cs]e", ["3 0", "3 01"]),
    ("psf", "python", r"(?:python|python software foundation) licen[cs]e", ["2"]),
    ("zpl", "zope", r"zope public licen[cs]e", ["1 1", "2 0", "2 1"]),
    ("odbl", "open database", r"open (?:data commons )?(?:open )?database licen[cs]e", ["1 0"]),
    ("cecill", "cecill", r"cecill", ["1", "2", "2 1"]),
    ("upl", "universal permissive", r"universal permissive licen[cs]e", ["1 0"]),
    ("lppl", "latex", r"latex project public licen[cs]e", ["1 0", "1 2", "1 3"]),
]
_NC, _SA, _ND = r"non ?commercial", r"share ?alike", r"no ?deriv(?:ative)?s?(?: works)?"
_COMMONS = (  # label, name in words, short name in words; a longer name is never read as a shorter one
    ("cc-by-nc-sa", rf"attribution {_NC} {_SA}", "by nc sa"),
    ("cc-by-nc-nd", rf"attribution {_NC} {_ND}", "by nc nd"),
    ("cc-by-nc", rf"attribution {_NC}", "by nc"),
    ("cc-by-sa", rf"attribution {_SA}", "by sa"),
    ("cc-by-nd", rf"attribution {_ND}", "by nd"),
    ("cc-by", "attribution", "by"),
)
_MORE_COMMONS = rf"(?! (?:{_NC}|{_SA}|{_ND}|nc|sa|nd) )"
_SIGNATURES = (  # label, keyword, words, confidence; one signature a line, from the wording of the licenses
    # MIT and its relatives
    ("mit", "mit licen", r"(?:the )?mit licen[cs]e", 0.95),
    ("mit", "permission is hereby", r"permission is hereby granted free of charge to any person obtaining a copy", 0.95),
    ("mit", "under ", r"(?:released|licen[cs]ed|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?mit", 0.9),
    ("mit", "substantial portions", r"shall be included in all copies or substantial portions of the software", 0.9),
    ("mit", "without limitation the rights", r"without limitation the rights to use copy modify merge publish distribute sublicen[cs]e", 0.9),
    ("mit", "expat", r"expat licen[cs]e", 0.9),
    ("mit-0", "mit no attribution", r"mit no attribution(?: licen[cs]e)?", 0.95),
    ("x11", "x11", r"x11 licen[cs]e", 0.95),
    ("x11", "x consortium", r"the name of the x consortium shall not be used in advertising", 0.95),
    ("isc", "isc", r"(?:the )?isc licen[cs]e", 0.95),
    ("isc", "permission to use", r"permission to use copy modify and or distribute this software for any purpose", 0.9),
    ("hpnd", "historical permission", r"historical permission notice and disclaimer", 0.95),
    ("hpnd", "permission to use", r"permission to use copy modify and distribute this software and its documentation for any purpose", 0.85),
    ("curl", "curl", r"curl licen[cs]e", 0.8),
    ("icu", "icu", r"icu licen[cs]e", 0.9),
    ("unicode", "unicode", r"unicode (?:data files and software )?licen[cs]e", 0.9),
    ("unicode", "unicode", r"unicode inc licen[cs]e agreement", 0.95),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa (?:open source )?licen[cs]e", 0.95),
    ("ncsa", "deal with the software", r"to deal with the software without restriction", 0.85),
    ("json", "good not evil", r"shall be used for good not evil", 0.95),
    ("bsd-0", "permission to use", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 0.92),
    # BSD
    ("bsd", "bsd", r"bsd(?: style)? licen[cs]e", 0.9),
    ("bsd-2-clause", "bsd", r"(?:2|two) clause bsd(?: licen[cs]e)?", 0.95),
    ("bsd-2-clause", "bsd", r"bsd (?:2|two) clause(?: licen[cs]e)?", 0.95),
    ("bsd-2-clause", "bsd", r"simplified bsd licen[cs]e", 0.95),
    ("bsd-2-clause", "freebsd", r"freebsd licen[cs]e", 0.9),
    ("bsd-3-clause", "bsd", r"(?:3|three) clause bsd(?: licen[cs]e)?", 0.95),
    ("bsd-3-clause", "bsd", r"bsd (?:3|three) clause(?: licen[cs]e)?", 0.95),
    ("bsd-3-clause", "bsd", r"(?:new|revised|modified) bsd licen[cs]e", 0.95),
    ("bsd-4-clause", "bsd", r"(?:4|four) clause bsd(?: licen[cs]e)?", 0.95),
    ("bsd-4-clause", "bsd", r"bsd (?:4|four) clause(?: licen[cs]e)?", 0.95),
    ("bsd-4-clause", "bsd", r"original bsd licen[cs]e", 0.95),
    ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 0.95),
    ("0bsd", "bsd", r"(?:0|zero) clause bsd(?: licen[cs]e)?", 0.95),
    ("0bsd", "bsd", r"bsd (?:0|zero) clause(?: licen[cs]e)?", 0.95),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted", 0.95),
    ("bsd", "redistributions", r"redistributions of source code must retain the (?:above )?copyright notice", 0.85),
    ("bsd", "redistributions", r"redistributions in binary form must reproduce the (?:above )?copyright notice", 0.85),
    ("bsd-3-clause", "neither the name", r"neither the names? of .{1,120}? may be used to endorse or promote products derived from this software", 0.9),
    ("bsd-clear", "clear bsd", r"clear bsd licen[cs]e", 0.95),
    ("bsd-patent", "plus patent", r"bsd 2 clause plus patent(?: licen[cs]e)?", 0.95),
    # Apache
    ("apache-2.0", "apache", r"apache org licenses licen[cs]e 2 0", 0.98),
    ("apache-2.0", "in compliance with the", r"you may not use this file except in compliance with the licen[cs]e", 0.8),
    ("apache-2.0", "distributed on an", r"distributed under the licen[cs]e is distributed on an as is basis", 0.8),
    ("apache-2.0", "grant of patent", r"grant of patent licen[cs]e subject to the terms and conditions of this licen[cs]e", 0.9),
    ("apache", "apache software foundation", r"this product includes software developed by the apache software foundation", 0.85),
    ("asl", "asl 2 0", r"asl 2 0", 0.85),
    # GNU
    ("gpl", "gnu gpl", r"gnu gpl", 0.85),
    ("gpl", "gpl", r"gplv?(?: licen[cs]e)?", 0.7),
    ("gpl-2-only", "gplv2", r"gplv2(?: only)?", 0.92),
    ("gpl-2-or-later", "gplv2", r"gplv2 or (?:any )?later(?: version)?", 0.95),
    ("gpl-3-only", "gplv3", r"gplv3(?: only)?", 0.92),
    ("gpl-3-or-later", "gplv3", r"gplv3 or (?:any )?later(?: version)?", 0.95),
    ("gpl", "free software", r"this program is free software you can redistribute it and or modify it", 0.9),
    ("gpl", "free software", r"(?:is|as) free software under the terms of the gnu general public licen[cs]e", 0.92),
    ("gpl", "without even the implied", r"without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public licen[cs]e", 0.92),
    ("gpl", "gnu general public", r"you should have received a copy of the gnu general public licen[cs]e", 0.92),
    ("gpl", "gnu org", r"gnu org licen[cs]es gpl", 0.92),
    ("gpl-2", "gnu org", r"gnu org licen[cs]es (?:old licen[cs]es )?gpl 2 0", 0.95),
    ("gpl-3", "gnu org", r"gnu org licen[cs]es gpl 3 0", 0.95),
    ("gpl", "copying", r"see the file copying for (?:copying conditions|details)", 0.6),
    ("lgpl", "gnu lgpl", r"gnu lgpl", 0.85),
    ("lgpl", "free software", r"this library is free software you can redistribute it and or modify it", 0.92),
    ("lgpl", "lesser general public", r"you should have received a copy of the gnu lesser general public licen[cs]e", 0.92),
    ("lgpl", "library general public", r"you should have received a copy of the gnu library general public licen[cs]e", 0.92),
    ("lgpl", "gnu org", r"gnu org licen[cs]es lgpl", 0.92),
    ("lgpl-2.1", "lgplv2", r"lgplv2 1", 0.92),
    ("lgpl-3", "lgplv3", r"lgplv3", 0.92),
    ("agpl", "gnu agpl", r"gnu agpl", 0.9),
    ("agpl-3", "agplv3", r"agplv3", 0.95),
    ("agpl", "affero", r"you should have received a copy of the gnu affero general public licen[cs]e", 0.95),
    ("agpl", "remote network interaction", r"remote network interaction use with the gnu general public licen[cs]e", 0.9),
    ("agpl", "gnu org", r"gnu org licen[cs]es agpl", 0.92),
    ("gfdl", "free documentation", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e", 0.97),
    ("gfdl", "gfdl", r"(?:gnu )?gfdl", 0.85),
    ("gfdl", "invariant sections", r"with no invariant sections", 0.8),
    ("gpl-classpath-exception", "classpath", r"classpath exception", 0.92),
    ("gpl-classpath-exception", "linking this library", r"linking this library statically or dynamically with other modules", 0.9),
    ("gpl-linking-exception", "exception", r"(?:gcc runtime library|linking) exception", 0.85),
    ("gpl-font-exception", "exception", r"font (?:embedding )?exception", 0.85),
    ("gpl-autoconf-exception", "autoconf", r"contains a configuration script generated by autoconf", 0.85),
    ("gpl-bison-exception", "bison", r"as a special exception you may create a larger work that contains part or all of the bison parser skeleton", 0.95),
    ("gnu-all-permissive", "are permitted in any medium", r"copying and distribution of this file with or without modification are permitted in any medium without royalty", 0.97),
    ("copyleft", "copyleft", r"copyleft(?: licen[cs]e)?", 0.6),
    # Mozilla, Eclipse, Sun, IBM and others with weak copyleft
    ("mpl", "mozilla public", r"subject to the terms of the mozilla public licen[cs]e", 0.95),
    ("mpl-2.0", "mozilla", r"mozilla org mpl 2 0", 0.97),
    ("mpl-1.1", "mozilla", r"mozilla org mpl mpl 1 1", 0.97),
    ("mpl", "original code", r"the initial developer of the original code is", 0.85),
    ("mpl-1.1", "mpl 1 1", r"mpl 1 1 gpl 2 0 lgpl 2 1", 0.97),
    ("npl", "netscape", r"netscape public licen[cs]e", 0.95),
    ("spl", "sun public", r"sun public licen[cs]e", 0.95),
    ("sissl", "sun industry", r"sun industry standards source licen[cs]e", 0.95),
    ("epl", "eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e", 0.97),
    ("edl", "eclipse distribution", r"eclipse distribution licen[cs]e", 0.95),
    ("ipl", "ibm public", r"ibm public licen[cs]e", 0.95),
    ("cpal", "common public attribution", r"common public attribution licen[cs]e", 0.95),
    ("cddl", "common development", r"the contents of this file are subject to the terms of the common development and distribution licen[cs]e", 0.97),
    ("cddl", "cddl", r"cddl(?: licen[cs]e)?", 0.8),
    ("qpl", "q public", r"q public licen[cs]e", 0.95),
    ("apsl", "apple public", r"apple public source licen[cs]e", 0.95),
    ("ms-pl", "microsoft", r"microsoft public licen[cs]e", 0.95),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[cs]e", 0.95),
    ("ms-lpl", "microsoft limited", r"microsoft limited public licen[cs]e", 0.95),
    ("nposl", "non profit open", r"non profit open software licen[cs]e", 0.95),
    ("rpl", "reciprocal public", r"reciprocal public licen[cs]e", 0.95),
    ("oclc", "oclc research", r"oclc research public licen[cs]e", 0.95),
    ("sleepycat", "sleepycat", r"sleepycat licen[cs]e", 0.95),
    ("eupl", "eupl", r"licen[cs]ed under the eupl", 0.95),
    ("cecill", "cecill", r"governed by the cecill licen[cs]e", 0.97),
    ("cecill-b", "cecill b", r"cecill b(?: licen[cs]e)?", 0.95),
    ("cecill-c", "cecill c", r"cecill c(?: licen[cs]e)?", 0.95),
    ("cern-ohl", "cern open hardware", r"cern open hardware licen[cs]e", 0.95),
    ("tapr-ohl", "tapr open hardware", r"tapr open hardware licen[cs]e", 0.95),
    # short and special software licenses
    ("boost", "boost", r"boost org licen[cs]e 1 0", 0.97),
    ("boost", "boost software", r"distributed under the boost software licen[cs]e", 0.95),
    ("unlicense", "unlicense", r"(?:the )?unlicense", 0.9),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain", 0.95),
    ("wtfpl", "wtfpl", r"wtfpl", 0.9),
    ("wtfpl", "you want to public", r"do what the f\S+ you want to public licen[cs]e", 0.97),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e", 0.95),
    ("zlib", "arising from", r"in no event will the authors be held liable for any damages arising from the use of this software", 0.85),
    ("zlib", "must not be misrepresented", r"the origin of this software must not be misrepresented", 0.9),
    ("libpng", "png", r"(?:libpng|png reference library) licen[cs]e", 0.92),
    ("ijg", "independent jpeg group", r"based in part on the work of the independent jpeg group", 0.95),
    ("freetype", "freetype", r"(?:the )?freetype (?:project )?licen[cs]e", 0.95),
    ("openssl", "openssl", r"openssl licen[cs]e", 0.95),
    ("openssl", "openssl project", r"this product includes software developed by the openssl project", 0.95),
    ("ssleay", "eric young", r"this product includes cryptographic software written by eric young", 0.95),
    ("postgresql", "postgresql", r"postgresql licen[cs]e", 0.95),
    ("python", "python software foundation", r"python software foundation licen[cs]e", 0.95),
    ("python", "psf", r"psf licen[cs]e(?: agreement)?", 0.9),
    ("cnri", "cnri", r"cnri (?:open source )?licen[cs]e agreement", 0.9),
    ("vim", "vim licen", r"vim licen[cs]e", 0.9),
    ("ruby", "ruby", r"ruby licen[cs]e", 0.9),
    ("ruby", "ruby", r"same terms as ruby(?: itself)?", 0.9),
    ("perl", "perl", r"same terms as perl(?: itself)?", 0.9),
    ("perl", "perl", r"under the (?:same )?terms (?:of|as) (?:the )?perl(?: 5)?(?: licen[cs]e)?", 0.85),
    ("artistic", "artistic", r"(?:the )?clarified artistic licen[cs]e", 0.95),
    ("tcl", "tcl", r"tcl(?: tk)? licen[cs]e", 0.9),
    ("php", "includes php", r"this product includes php software", 0.95),
    ("w3c", "w3c", r"w3c software (?:notice and )?licen[cs]e", 0.95),
    ("w3c", "w3c", r"w3c document licen[cs]e", 0.95),
    ("beerware", "ware licen", r"beer ?ware licen[cs]e", 0.9),
    ("beerware", "me a beer", r"you can buy me a beer in return", 0.95),
    ("afl", "academic free", r"licen[cs]ed under the academic free licen[cs]e", 0.95),
    ("ecl", "educational community", r"educational community licen[cs]e", 0.95),
    ("nasa", "nasa open source", r"nasa open source agreement", 0.95),
    ("fair", "fair licen", r"fair licen[cs]e", 0.7),
    ("blueoak", "blue oak", r"blue oak model licen[cs]e", 0.97),
    ("mulan", "mulan", r"mulan (?:psl|permissive software licen[cs]e)", 0.97),
    ("upl", "universal permissive", r"licen[cs]ed under the universal permissive licen[cs]e", 0.95),
    ("cua-opl", "cua office", r"cua office public licen[cs]e", 0.95),
    ("intel", "intel open source", r"intel open source licen[cs]e", 0.95),
    ("sgi", "sgi free software", r"sgi free software licen[cs]e b", 0.95),
    ("ofl", "open font", r"licen[cs]ed under the sil open font licen[cs]e", 0.97),
    ("ofl", "reserved font name", r"with reserved font name", 0.9),
    ("ufl", "ubuntu font", r"ubuntu font licen[cs]e", 0.95),
    # source-available licenses
    ("sspl", "server side public", r"server side public licen[cs]e", 0.97),
    ("busl", "business source", r"business source licen[cs]e", 0.97),
    ("elastic", "elastic licen", r"elastic licen[cs]e(?: 2 0)?", 0.95),
    ("commons-clause", "commons clause", r"commons clause(?: licen[cs]e condition)?", 0.95),
    ("polyform", "polyform", r"polyform (?:noncommercial|small business|shield|strict|perimeter) licen[cs]e", 0.97),
    ("confluent", "confluent community", r"confluent community licen[cs]e", 0.97),
    ("timescale", "timescale licen", r"timescale licen[cs]e", 0.95),
    ("hippocratic", "hippocratic", r"hippocratic licen[cs]e", 0.97),
    ("anti-996", "anti 996", r"anti 996 licen[cs]e", 0.97),
    ("openrail", "openrail", r"(?:creativeml |bigscience )?openrail(?: m)?(?: licen[cs]e)?", 0.95),
    ("prosperity", "prosperity public", r"prosperity public licen[cs]e", 0.97),
    ("parity", "parity public", r"parity public licen[cs]e", 0.97),
    # data and content
    ("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?", 0.9),
    ("cc0", "creative commons", r"creative commons (?:zero|cc0|public domain dedication)(?: v?1 0)?(?: universal)?", 0.95),
    ("cc0", "creativecommons", r"creativecommons org publicdomain zero 1 0", 0.98),
    ("cc-pdm", "creativecommons", r"creativecommons org publicdomain mark 1 0", 0.98),
    ("cc-sampling", "creative commons", r"creative commons sampling(?: plus)?(?: 1 0)?", 0.95),
    ("cc", "creative commons", r"(?:licen[cs]ed|released|published|available) under (?:a|the) creative commons licen[cs]e", 0.8),
    ("cc", "some rights reserved", r"some rights reserved", 0.7),
    ("odbl", "odbl", r"(?:available|licen[cs]ed) under the odbl", 0.92),
    ("odc-by", "open data commons", r"open data commons attribution licen[cs]e", 0.97),
    ("pddl", "open data commons", r"open data commons public domain dedication and licen[cs]e", 0.97),
    ("cdla-permissive", "community data licen", r"community data licen[cs]e agreement permissive", 0.97),
    ("cdla-sharing", "community data licen", r"community data licen[cs]e agreement sharing", 0.97),
    ("ogl-uk", "open government", r"open government licen[cs]e(?: v?[123] 0)?", 0.95),
    ("etalab", "licence ouverte", r"licence ouverte(?: open licence)?", 0.95),
    ("dl-de", "datenlizenz", r"datenlizenz deutschland(?: namensnennung| zero)?(?: version)?(?: 2 0)?", 0.97),
    ("free-art", "free art licen", r"free art licen[cs]e", 0.95),
    ("gutenberg", "project gutenberg", r"project gutenberg licen[cs]e", 0.97),
    ("ogl-game", "open game licen", r"open game licen[cs]e", 0.9),
    ("public-domain", "public domain", r"(?:released|dedicated|placed|is|are) (?:in|into|to) the public domain", 0.85),
    ("public-domain", "public domain", r"public domain dedication", 0.85),
    ("public-domain", "public domain", r"no copyright is claimed .{0,80}?public domain", 0.85),
    ("us-government", "united states government", r"works? of the united states government", 0.8),
    # proprietary texts and restrictions
    ("proprietary", "proprietary", r"proprietary (?:and confidential|software|licen[cs]e|information)", 0.8),
    ("proprietary", "confidential", r"confidential and proprietary", 0.8),
    ("proprietary", "strictly prohibited", r"(?:copying|reproduction|distribution|use|duplication)(?: \S+){0,8} is strictly prohibited", 0.7),
    ("proprietary", "unauthori", r"unauthori[sz]ed (?:copying|reproduction|distribution|use|duplication)", 0.7),
    ("proprietary", "trade secret", r"contains (?:valuable )?trade secrets", 0.75),
    ("commercial", "commercial", r"commercial licen[cs]e(?: agreement)?", 0.7),
    ("eula", "end user", r"end user licen[cs]e agreement", 0.85),
    ("eula", "eula", r"eula", 0.7),
    ("eula", "reverse engineer", r"(?:may not|shall not) reverse engineer decompile or disassemble", 0.85),
    ("shareware", "shareware", r"shareware(?: licen[cs]e)?", 0.7),
    ("freeware", "freeware", r"freeware(?: licen[cs]e)?", 0.65),
    ("evaluation", "evaluation", r"for evaluation (?:purposes )?only", 0.7),
    ("internal-use", "internal use only", r"for internal use only", 0.7),
    ("academic-use", "use only", r"(?:for )?(?:academic|educational|research) use only", 0.7),
    ("academic-use", "purposes only", r"(?:for )?(?:academic|educational|research) purposes only", 0.7),
    ("personal-use", "personal", r"(?:for )?personal use only", 0.7),
    ("no-derivatives", "derivative works", r"no derivative works", 0.6),
    ("non-commercial", "commercial", r"(?:for )?non ?commercial (?:use|purposes)(?: only)?", 0.6),
    ("no-commercial-use", "commercial use", r"commercial use (?:is )?(?:not permitted|prohibited|forbidden)", 0.75),
    ("no-redistribution", "permission", r"(?:cop(?:y|ied|ying)|reproduced?|reproduction|distribut(?:ed?|ion)|redistribut(?:ed?|ion)|published?|transmitted|used?)(?: [a-z]+){0,8} (?:without|except with) (?:the )?(?:prior )?(?:express )?(?:written )?permission", 0.5),
    ("no-redistribution", "permission", r"(?:without|except with) (?:the )?(?:(?:prior|express) )*written permission", 0.5),
    ("no-redistribution", "distributed", r"(?:may not be|not to be) (?:re)?distributed", 0.65),
    ("no-redistribution", "may not be", r"may not be (?:published broadcast rewritten or redistributed|reproduced or retransmitted)", 0.8),
    ("no-reproduction", "reproduced", r"no part of this (?:publication|book|work|document|website) may be reproduced", 0.85),
    ("no-reproduction", "whole or in part", r"in whole or in part(?: \S+){0,4} without (?:written )?permission", 0.75),
    ("no-training", "machine learning", r"(?:may not be used|not permitted) (?:to|for) (?:train|training)(?: \S+){0,6} machine learning", 0.85),
    ("terms-of-use", "subject to", r"subject to (?:the |our )?terms of (?:use|service)", 0.5),
    ("no-warranty", "warranty", r"without warranty of any kind(?: express or implied)?", 0.5),
    ("no-warranty", "warranties", r"without warranties or conditions of any kind", 0.6),
    ("no-warranty", "provided", r"provided (?:by .{1,60}? )?as is", 0.5),
    ("no-liability", "be liable", r"in no event shall .{1,120}? be liable", 0.5),
    # notices
    ("copyright", "copyright", r"copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)?[0-9]{2})?", 0.5),
    ("copyright", "copyright", r"copyright (?:holders?|owners?|notice)", 0.4),
    ("copyright", "protected by copyright", r"protected by copyright(?: law)?", 0.5),
    ("trademark", "trademark", r"(?:is|are) (?:a )?(?:registered )?trademarks? of", 0.4),
    ("patent", "pending", r"patents? pending", 0.5),
    ("open-source", "open source", r"open source (?:initiative )?(?:approved )?licen[cs]e", 0.5),
    ("dual-license", "dual", r"dual(?:ly)? licen[cs]ed", 0.6),
)
#: Notices of some license, or of some version of one; they give way to every other detection that they overlap.
_GENERIC = (
    ("license", "license", r"licensed under the terms of(?: the)?(?: [a-z]+){0,3} licen[cs]e", 0.6),
    ("license", "licen", r"(?:released|published|distributed|available|licen[cs]ed) under (?:a|an|the)(?: [a-z]+){1,4} licen[cs]e", 0.6),
    ("license", "file", r"(?:see|in) the (?:accompanying )?licen[cs]e file", 0.6),
    ("license", "information", r"for licen[cs]e information", 0.5),
    ("apache", "apache", r"(?:licen[cs]ed|released|distributed) under (?:the )?(?:terms of (?:the )?)?apache", 0.85),
)
GENERIC = 9
#: Identifiers that a tag line may name, in words.
_IDS = (
    "0bsd", "afl 3 0", "agpl 3 0", "apache 1 1", "apache 2 0", "artistic 2 0", "bsd 2 clause", "bsd 3 clause", "bsd 4 clause", "bsl 1 0", "cc0 1 0",
    "cc by 3 0", "cc by 4 0", "cc by nc 4 0", "cc by nc nd 4 0", "cc by nc sa 4 0", "cc by nd 4 0", "cc by sa 3 0", "cc by sa 4 0", "cddl 1 0", "cecill 2 1", "cpl 1 0",
    "epl 1 0", "epl 2 0", "eupl 1 1", "eupl 1 2", "gfdl 1 3", "gpl 1 0", "gpl 2 0", "gpl 3 0", "isc", "lgpl 2 0", "lgpl 2 1", "lgpl 3 0", "lppl 1 3c",
    "mit", "mit 0", "mpl 1 1", "mpl 2 0", "ms pl", "ms rl", "ncsa", "odbl 1 0", "ofl 1 1", "openssl", "osl 3 0", "php 3 01", "postgresql", "psf 2 0", "ruby",
    "unlicense", "upl 1 0", "vim", "w3c", "wtfpl", "x11", "zlib", "zpl 2 1",
)


def rules() -> list[tuple[int, str, str, str, float]]:
    """(priority, label, keyword, pattern, confidence); a lower priority number wins, then a longer match, then the earlier rule."""
    found: list[tuple[int, str, str, str, float]] = []
    for name in _IDS:
        found.append((1, name.replace(" ", "-"), "spdx", rf"spdx (?:licen[cs]e identifier )?{name}(?: only| or later)?", 0.99))
        found.append((2, name.replace(" ", "-"), "spdx", rf"spdx (?:licen[cs]e identifier )?(?:[a-z0-9]+ ){{1,5}}(?:or|and) {name}(?: only| or later)?", 0.95))  # the other part of a tag's expression
    place = r"(?: international| unported| generic)?"
    for label, name, short in _COMMONS:
        for version in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            v = version.replace(" ", ".")
            found.append((2, f"{label}-{v}", "creative commons", rf"creative commons {name}(?: public)?(?: licen[cs]e)?{place} (?:{_V} )?{version}{place}", 0.97))
            found.append((2, f"{label}-{v}", "creativecommons", rf"creativecommons org licenses {short} {version}", 0.98))
            found.append((2, f"{label}-{v}", "cc", rf"cc {short} (?:{_V} )?{version}", 0.95))
        found.append((4, label, "creative commons", rf"creative commons {name}{_MORE_COMMONS}(?: licen[cs]e)?", 0.9))
        found.append((4, label, "cc", rf"cc {short}{_MORE_COMMONS}", 0.85))
    for label, keyword, name, versions in _NUMBERED:
        for version in versions:
            v = version.replace(" ", ".")
            end = r"(?! [0-9] )" if " " not in version else ""
            found.append((2, f"{label}-{v}-or-later", keyword, rf"{name}(?: as published by the free software foundation)?(?: either)? (?:{_V} )?{version}(?: of the licen[cs]e)? or (?:\(?at your option\)? )?(?:any )?(?:later|newer)(?: version)?", 0.98))
            found.append((3, f"{label}-{v}", keyword, rf"{name}(?: as published by the free software foundation)? (?:{_V} )?{version}{end}", 0.96))
            if label in ("gpl", "lgpl", "agpl"):
                found.append((2, f"{label}-{v}-or-later", label, rf"{label} ?(?:{_V} )?v?{version}(?: 0)? or (?:any )?(?:later|newer)(?: version)?", 0.95))
                found.append((2, f"{label}-{v}-only", label, rf"{label} ?(?:{_V} )?v?{version}(?: 0)? only", 0.95))
                found.append((3, f"{label}-{v}", label, rf"{label} ?(?:{_V} )?v?{version}(?: 0)?{end}", 0.9))
        found.append((5, label, keyword, name, 0.85))
    found += [(4, label, keyword, words, sure) for label, keyword, words, sure in _SIGNATURES]
    found += [(GENERIC, label, keyword, words, sure) for label, keyword, words, sure in _GENERIC]
    return found


#: Parts of words, one of which stands in most keywords or in all that their rules match; a text without it is not asked for the keyword.
_GATES = ("licen", "public", "gnu", "permi", "software", "copyright", "distribut", "commons", "proprietary", "exception", "prohibited", "warrant")


def _gated(table: list[tuple[int, str, str, str, float]]) -> dict[str, list[str]]:
    """Keywords by gate: a part of _GATES that the keyword or every pattern of it holds outside its groups, else the keyword itself."""
    fixed: dict[str, list[str]] = {}
    for _, _, keyword, pattern, _ in table:
        while (bare := re.sub(r"\([^()]*\)[?*+]?(?:\{[0-9,]+\})?", "", pattern)) != pattern:
            pattern = bare
        fixed.setdefault(keyword, []).append("" if "|" in pattern else pattern)
    out: dict[str, list[str]] = {}
    for keyword, patterns in fixed.items():
        gate = next((g for g in _GATES if g in keyword or all(g in p for p in patterns)), keyword)
        out.setdefault(gate, []).append(keyword)
    return out


def _words(text: Column) -> Column:
    """The text's words, lower-cased, each after one space, and a space at the end; without words, one space."""
    words = F.btrim(F.regexp_replace(ascii_lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return F.concat(F.lit(" "), words, F.when(words == "", "").otherwise(" "))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" ")))


def _starts(norm: Column, phrase: str) -> Column:
    """Indices of the words at which the phrase starts."""
    parts = F.split(norm, rf"(?<= ){phrase}(?= )", -1)

    def step(acc: Column, part: Column):
        at = acc["w"] + _spaces(part)
        return {"w": at + phrase.count(" ")}, at

    found = collected(F.slice(parts, F.lit(1), F.size(parts) - 1), {"w": F.lit(-1)}, step, "int")
    return F.when(F.contains(norm, F.lit(f" {phrase} ")), found).otherwise(F.array().cast("array<int>"))


DETECTION = "struct<start:int,stop:int,priority:int,rule:int,label:string,confidence:double,words:string>"


def _specific(dets: Column) -> Column:
    """The detections without generic notices that overlap another; one run from the left and one from the right, since both may be many."""
    kind = f"struct<x:{DETECTION},held:boolean>"

    def swept(items: Column, edge: int, own, reach, meets) -> Column:
        def step(acc: Column, d: Column):
            generic = d["x"]["priority"] == GENERIC
            return {"edge": F.when(generic, acc["edge"]).otherwise(reach(acc["edge"], own(d["x"])))}, F.struct(d["x"].alias("x"), (d["held"] | (generic & meets(acc["edge"], d["x"]))).alias("held"))

        return collected(items, {"edge": F.lit(edge)}, step, kind)

    ordered = F.transform(F.array_sort(dets), lambda d: F.struct(d.alias("x"), F.lit(False).alias("held")))
    once = swept(ordered, -1, lambda d: d["stop"], F.greatest, lambda edge, d: d["start"] < edge)
    twice = swept(F.reverse(once), 2**31 - 1, lambda d: d["start"], F.least, lambda edge, d: edge < d["stop"])
    judged = F.transform(F.filter(twice, lambda d: ~d["held"]), lambda d: d["x"])
    return F.when(F.exists(dets, lambda d: d["priority"] == GENERIC), judged).otherwise(dets)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_words, base (array of label and word index), detections (label, start, stop, words, confidence).

    Words are runs of 0-9, a-z (A-Z lower-cased) and characters above U+007F. Positions of
    detections are code points of the words joined by single spaces, after one space.
    Null, empty and wordless texts have no words and no detections. Rows are judged one by one, so
    repeated rows give equal results and null ids pass through; an empty table gives an empty result; other columns are dropped.
    """
    table = rules()
    norm, dets = F.col("__norm"), F.col("__dets")
    own = docs.select(F.col(id_col).alias("doc_id"), _words(F.coalesce(F.col(text_col), F.lit(""))).alias("__norm"))
    gates = F.array(*[F.struct(F.lit(g).alias("gate"), F.lit(sorted(ks)).alias("keywords")) for g, ks in sorted(_gated(table).items())])
    open_ = F.filter(gates, lambda g: F.contains(norm, g["gate"]))
    own = own.withColumn("__held", F.flatten(F.transform(open_, lambda g: F.filter(g["keywords"], lambda k: F.contains(norm, k)))))
    as_rows = F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(p).alias("priority"), F.lit(label).alias("label"), F.lit(k).alias("keyword"), F.lit(rf"(?<= )(?:{x})(?= )").alias("pattern"), F.lit(c).alias("confidence")) for i, (p, label, k, x, c) in enumerate(table)])

    def detect(r: Column) -> Column:
        kept = lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), r["priority"].alias("priority"), r["rule"].alias("rule"), r["label"].alias("label"), r["confidence"].alias("confidence"), x["text"].alias("words"))
        return F.transform(places(norm, r["pattern"]), kept)

    found = F.flatten(F.transform(F.filter(as_rows, lambda r: F.array_contains(F.col("__held"), r["keyword"])), detect))
    own = own.withColumn("__dets", F.when(F.size("__held") > 0, found))

    rank = lambda x: F.struct(x["priority"], x["start"] - x["stop"], x["rule"])
    own = own.withColumn("__kept", F.when(F.size(dets) > 1, outermost(dets, DETECTION, rank)).otherwise(dets))  # a column of its own, since it is used more than once
    kept = _specific(F.col("__kept"))

    def labelled(phrase: str, label: str) -> Column:
        return F.transform(_starts(norm, phrase), lambda w: F.struct(F.lit(label).alias("label"), w.cast("long").alias("word")))

    base = F.flatten(F.array(*[labelled(*x) for x in BASE]))
    shown = F.transform(F.array_sort(kept), lambda d: F.struct(d["label"].alias("label"), d["start"].alias("start"), d["stop"].alias("stop"), d["words"].alias("words"), d["confidence"].alias("confidence")))
    return own.select(
        "doc_id",
        (_spaces(norm) - 1).cast("long").alias("n_words"),
        base.alias("base"),
        F.coalesce(F.when(F.size("__held") > 0, shown), F.array().cast("array<struct<label:string,start:int,stop:int,words:string,confidence:double>>")).alias("detections"),
    )


def op5_license_scan(spark, sf_dir):
    out = scan_licenses(documents(spark, sf_dir))
    words, labels = F.col("base.word"), F.col("base.label")
    return out.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(words).alias("first_word"),
        F.array_max(words).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(labels)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(labels, F.col("detections.label"))), ",").alias("labels"),
        F.greatest(F.coalesce(F.array_max(F.col("detections.confidence")), F.lit(0.0)), F.when(F.size("base") > 0, 0.5).otherwise(0.0)).alias("score"),
    )
