"""License scans (1): ordered signature rules, gated by keywords, with priority and containment.

A text is brought to a plain form: A-Z lower-cased, words as the contract's pattern takes them, each between spaces of
its own.  A rule is a regular expression over that form, a keyword without which it cannot match, a label and a
priority.  One pass finds the keywords of a text; only rules of a keyword that is there run on it.  A detection that
lies within one of a better priority, or within a longer one of the same priority, is suppressed.

Rules are sentences of the licenses' notices, over two hundred and fifty of them written out, and the licenses' names in the
phrases that grant, name or declare a license; the table has a fixed size, which is what lets it be broadcast.  Only texts with a keyword are handed on with
their rules, and detections of one text meet in windows of that text alone.

Native: DataFrame functions only.  Null and empty texts have no words and no labels and score 0.  Repeated rows are
judged each on its own, and a very long text is one row like any other.  Detections that tie in priority and place all
stay.  Other columns are not looked at, whatever their names.  An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenclip.llm.common import documents

# The contract's phrases with their labels.
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

# Licenses by label, keyword and the names they go by in plain form.
LICENSES = [
    ("mit", "mit", ["mit"]),
    ("apache-2", "apache", ["apache 2", "apache 2 0", "apache version 2 0", "apache license 2 0"]),
    ("apache-1.1", "apache", ["apache 1 1", "apache software 1 1"]),
    ("bsd-2-clause", "bsd", ["bsd 2 clause", "2 clause bsd", "simplified bsd", "freebsd"]),
    ("bsd-3-clause", "bsd", ["bsd 3 clause", "3 clause bsd", "new bsd", "modified bsd", "revised bsd"]),
    ("bsd", "bsd", ["bsd", "bsd style"]),
    ("isc", "isc", ["isc"]),
    ("zlib", "zlib", ["zlib", "zlib libpng"]),
    ("gpl-2.0", "gpl", ["gpl 2", "gpl 2 0", "gpl v2", "gplv2", "gpl version 2"]),
    ("gpl-2.0", "gnu", ["gnu gpl v2", "gnu general public license version 2", "gnu general public license v2"]),
    ("gpl-3.0", "gpl", ["gpl 3", "gpl 3 0", "gpl v3", "gplv3", "gpl version 3"]),
    ("gpl-3.0", "gnu", ["gnu gpl v3", "gnu general public license version 3", "gnu general public license v3"]),
    ("gpl", "gpl", ["gpl"]),
    ("gpl", "gnu", ["gnu general public", "gnu gpl"]),
    ("lgpl-2.1", "lgpl", ["lgpl 2 1", "lgpl v2 1", "lgplv2 1"]),
    ("lgpl-3.0", "lgpl", ["lgpl 3", "lgpl 3 0", "lgpl v3", "lgplv3"]),
    ("lgpl", "lgpl", ["lgpl"]),
    ("lgpl", "gnu", ["gnu lesser general public", "gnu lgpl"]),
    ("agpl-3.0", "agpl", ["agpl 3", "agpl 3 0", "agpl v3", "agplv3", "agpl"]),
    ("agpl-3.0", "gnu", ["gnu affero general public"]),
    ("mpl-1.1", "mpl", ["mpl 1 1"]),
    ("mpl-2.0", "mpl", ["mpl 2", "mpl 2 0"]),
    ("mpl-2.0", "mozilla", ["mozilla public", "mozilla public 2 0"]),
    ("epl-1.0", "epl", ["epl 1 0"]),
    ("epl-2.0", "epl", ["epl 2 0", "epl 2"]),
    ("epl", "eclipse", ["eclipse public"]),
    ("cddl-1.0", "cddl", ["cddl", "cddl 1 0"]),
    ("artistic-2.0", "artistic", ["artistic", "artistic 2 0"]),
    ("boost-1.0", "boost", ["boost software", "boost"]),
    ("unlicense", "unlicense", ["unlicense"]),
    ("wtfpl", "wtfpl", ["wtfpl"]),
    ("postgresql", "postgresql", ["postgresql"]),
    ("python-2.0", "python", ["python software foundation", "python 2 0"]),
    ("cc0-1.0", "cc0", ["cc0", "cc0 1 0"]),
    ("cc-by", "cc", ["cc by", "cc by 3 0", "cc by 4 0"]),
    ("cc-by", "commons", ["creative commons attribution"]),
    ("cc-by-sa", "cc", ["cc by sa", "cc by sa 3 0", "cc by sa 4 0"]),
    ("cc-by-sa", "commons", ["creative commons attribution sharealike", "creative commons attribution share alike"]),
    ("cc-by-nd", "cc", ["cc by nd", "cc by nd 4 0"]),
    ("cc-by-nc", "cc", ["cc by nc", "cc by nc 3 0", "cc by nc 4 0"]),
    ("cc-by-nc", "commons", ["creative commons attribution noncommercial", "creative commons attribution non commercial"]),
    ("cc-by-nc-sa", "cc", ["cc by nc sa", "cc by nc sa 4 0"]),
    ("cc-by-nc-nd", "cc", ["cc by nc nd", "cc by nc nd 4 0"]),
    ("ofl-1.1", "ofl", ["sil ofl", "ofl 1 1"]),
    ("odbl-1.0", "odbl", ["odbl", "odbl 1 0"]),
    ("odbl-1.0", "database", ["open database"]),
]
# What stands before and after a license's name, with the priority (0 is best) and the confidence.
PHRASES = [
    (r" spdx  license  identifier  {} ", 0, 1.0),
    (r"( (licensed|released|distributed|published|available|provided|covered|issued))  under  (the  )?(terms  of  (the  )?)?{}( ( license| licence| public  license))? ", 1, 0.95),
    (r" licen[sc]ed?(  (is|as))?  (the  )?{} ", 1, 0.9),
    (r" under  (the  )?{}  licen[sc]e ", 1, 0.9),
    (r" (the  )?{}  licen[sc]e ", 2, 0.7),
    (r" licen[sc]e  {} ", 2, 0.7),
]
# Phrases of whole notices: label, the keyword (a word of the phrase that is rare elsewhere), the phrase in plain words
# with (a|b) for alternatives and (a )? for what may lack, priority and confidence.
NOTICES = [
    ("mit", "hereby", "permission is hereby granted free of charge to any person obtaining a copy", 1, 0.95),
    ("mit", "sublicense", "to use copy modify merge publish distribute sublicense and or sell copies of the software", 1, 0.95),
    ("mit", "substantial", "this permission notice shall be included in all copies or substantial portions of the software", 1, 0.9),
    ("x11", "advertising", "shall not be used in advertising or otherwise to promote the sale use or other dealings in this software", 1, 0.9),
    ("isc", "purpose", "permission to use copy modify and or distribute this software for any purpose", 1, 0.9),
    ("isc", "purpose", "for any purpose with or without fee is hereby granted provided that the above copyright notice", 1, 0.9),
    ("0bsd", "purpose", "distribute this software for any purpose with or without fee is hereby granted the software is provided", 0, 0.9),
    ("bsd", "redistribution", "redistribution and use in source and binary forms", 1, 0.9),
    ("bsd", "redistributions", "redistributions of source code must retain the above copyright notice", 1, 0.9),
    ("bsd", "redistributions", "redistributions in binary form must reproduce the above copyright notice", 1, 0.9),
    ("bsd-3-clause", "endorse", "may be used to endorse or promote products derived from this software without specific prior written permission", 1, 0.95),
    ("bsd-4-clause", "acknowledgement", "must display the following acknowledgement this product includes software", 1, 0.95),
    ("apache-2", "apache", "apache license version 2( 0)?", 1, 0.95),
    ("apache-2", "compliance", "you may not use this file except in compliance with the license", 1, 0.8),
    ("apache-2", "agreed", "unless required by applicable law or agreed to in writing software distributed under the license", 1, 0.8),
    ("apache-2", "warranties", "on an as is basis without warranties or conditions of any kind either express or implied", 1, 0.7),
    ("apache-1.1", "apache", "this product includes software developed by the apache software foundation", 1, 0.9),
    ("gpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu general public license", 1, 0.95),
    ("gpl-2.0", "gnu", "gnu general public license as published by the free software foundation either version 2", 0, 0.95),
    ("gpl-2.0", "gnu", "gnu general public license version 2 as published by the free software foundation", 0, 0.95),
    ("gpl-3.0", "gnu", "gnu general public license as published by the free software foundation either version 3", 0, 0.95),
    ("gpl-3.0", "gnu", "gnu general public license version 3 as published by the free software foundation", 0, 0.95),
    ("gpl", "gnu", "you should have received a copy of the gnu general public license", 1, 0.9),
    ("gpl", "gnu", "see the gnu general public license for more details", 1, 0.9),
    ("lgpl", "gnu", "under the terms of the gnu (lesser|library) general public license", 1, 0.95),
    ("lgpl-2.1", "gnu", "gnu lesser general public license as published by the free software foundation either version 2 1", 0, 0.95),
    ("lgpl-3.0", "gnu", "gnu lesser general public license as published by the free software foundation either version 3", 0, 0.95),
    ("lgpl", "gnu", "you should have received a copy of the gnu (lesser|library) general public license", 1, 0.9),
    ("agpl-3.0", "affero", "under the terms of the gnu affero general public license", 1, 0.95),
    ("agpl-3.0", "affero", "you should have received a copy of the gnu affero general public license", 1, 0.9),
    ("mpl-2.0", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0", 1, 0.95),
    ("mpl-1.1", "mozilla", "the contents of this file are subject to the mozilla public license version 1 1", 1, 0.95),
    ("epl-1.0", "eclipse", "made available under the terms of the eclipse public license v1 0", 1, 0.95),
    ("epl-2.0", "eclipse", "made available under the terms of the eclipse public license (v )?2 0", 1, 0.95),
    ("cddl-1.0", "cddl", "subject to the terms of the common development and distribution license the cddl", 1, 0.95),
    ("cddl-1.0", "distribution", "subject to the terms of the common development and distribution license", 1, 0.95),
    ("cpl-1.0", "common", "accompanying program is provided under the terms of this common public license", 1, 0.95),
    ("artistic-2.0", "artistic", "you can redistribute it and or modify it under the terms of the artistic license( 2 0)?", 1, 0.9),
    ("perl", "perl", "under the same terms as perl itself", 1, 0.9),
    ("ruby", "ruby", "under the same terms as ruby", 1, 0.9),
    ("boost-1.0", "boost", "distributed under the boost software license version 1 0", 1, 0.95),
    ("boost-1.0", "machine", "machine executable object code generated by a source language processor", 1, 0.9),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented", 1, 0.95),
    ("zlib", "altered", "altered source versions must be plainly marked as such", 1, 0.95),
    ("libpng", "libpng", "this code is released under the libpng license", 1, 0.95),
    ("ijg", "jpeg", "this software is based in part on the work of the independent jpeg group", 1, 0.95),
    ("openssl", "openssl", "this product includes software developed by the openssl project", 1, 0.95),
    ("curl", "fee", "permission to use copy modify and distribute this software for any purpose with or without fee", 1, 0.85),
    ("ntp", "suitability", "makes no representations about the suitability this software for any purpose", 1, 0.85),
    ("hpnd", "suitability", "makes no representations about the suitability of this software for any purpose", 1, 0.85),
    ("postgresql", "documentation", "permission to use copy modify and distribute this software and its documentation for any purpose", 1, 0.85),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain", 0, 0.95),
    ("unlicense", "dedicate", "we dedicate any and all copyright interest in the software to the public domain", 0, 0.95),
    ("wtfpl", "fuck", "do what the fuck you want to public license", 1, 0.95),
    ("beerware", "beer", "you can buy me a beer in return", 1, 0.9),
    ("cc0-1.0", "waived", "waived all copyright and related or neighboring rights to", 1, 0.95),
    ("cc0-1.0", "cc0", "cc0 1 0 universal", 1, 0.95),
    ("cc-by", "commons", "creative commons attribution (2 0|2 5|3 0|4 0) (international|unported|generic)", 1, 0.9),
    ("cc-by-sa", "commons", "creative commons attribution share ?alike (2 0|2 5|3 0|4 0) (international|unported|generic)", 1, 0.9),
    ("cc-by-nd", "commons", "creative commons attribution no ?deriv(ative|atives|s)", 1, 0.9),
    ("cc-by-nc-sa", "commons", "creative commons attribution non ?commercial share ?alike", 0, 0.9),
    ("cc-by-nc-nd", "commons", "creative commons attribution non ?commercial no ?deriv(ative|atives|s)", 0, 0.9),
    ("cc-by-nc", "cc", "cc by nc( [234] [05])?", 1, 0.9),
    ("gfdl", "documentation", "under the terms of the gnu free documentation license", 1, 0.95),
    ("gfdl", "invariant", "with no invariant sections no front cover texts and no back cover texts", 1, 0.95),
    ("odbl-1.0", "database", "made available under the open database license", 1, 0.95),
    ("odc-by", "commons", "open data commons attribution license", 1, 0.95),
    ("pddl-1.0", "pddl", "public domain dedication and license pddl", 1, 0.95),
    ("ofl-1.1", "sil", "this font software is licensed under the sil open font license", 1, 0.95),
    ("ofl-1.1", "reserved", "with reserved font name", 1, 0.8),
    ("python-2.0", "psf", "this license agreement is between the python software foundation psf", 1, 0.95),
    ("php-3.01", "php", "subject to version 3 (0|01) of the php license", 1, 0.95),
    ("ms-pl", "microsoft", "microsoft public license", 1, 0.9),
    ("ms-rl", "microsoft", "microsoft reciprocal license", 1, 0.9),
    ("eupl-1.2", "eupl", "eupl (version )?(1|v1) 2", 1, 0.95),
    ("eupl-1.2", "european", "european union public licence (version )?(1|v1) 2", 1, 0.95),
    ("llvm-exception", "llvm", "apache license v2 0 with llvm exceptions", 0, 0.95),
    ("classpath-exception", "linking", "linking this library statically or dynamically with other modules is making a combined work", 1, 0.95),
    ("sspl-1.0", "server", "server side public license", 1, 0.9),
    ("busl-1.1", "business", "business source license 1 1", 1, 0.95),
    ("elastic-2.0", "elastic", "elastic license 2 0", 1, 0.9),
    ("commons-clause", "commons", "commons clause license condition", 1, 0.95),
    ("public-domain", "domain", "((released|dedicated|placed) (to|into|in) (the )?)?public domain", 2, 0.6),
    ("public-domain", "disclaims", "the author(s)? (hereby )?disclaims copyright to this source code", 1, 0.95),
    ("proprietary", "reserved", "all rights reserved", 2, 0.5),
    ("proprietary", "unauthorized", "unauthorized (copying|use|distribution) of this (file|software) via any medium is strictly prohibited", 1, 0.9),
    ("proprietary", "confidential", "proprietary and confidential", 1, 0.8),
    ("mit", "furnished", "to permit persons to whom the software is furnished to do so", 1, 0.95),
    ("mit-0", "furnished", "to whom the software is furnished to do so the software is provided as is", 0, 0.95),
    ("mit", "tort", "whether in an action of contract tort or otherwise arising from out of or in connection with the software", 1, 0.9),
    ("mit", "expat", "expat licen(s|c)e", 1, 0.9),
    ("mit", "mit", "governed by (an|the) mit style license that can be found in the license file", 1, 0.95),
    ("json", "evil", "the software shall be used for good not evil", 0, 0.95),
    ("icu", "notice", "that both the above copyright notice s and this permission notice appear in supporting documentation", 1, 0.85),
    ("ncsa", "illinois", "university of illinois ncsa open source license", 1, 0.95),
    ("bsd", "contributors", "this software is provided by the copyright holders and contributors as is", 1, 0.9),
    ("bsd", "regents", "this software is provided by the regents and contributors as is", 1, 0.9),
    ("bsd", "exemplary", "direct indirect incidental special exemplary or consequential damages", 1, 0.85),
    ("bsd", "procurement", "procurement of substitute goods or services loss of use data or profits or business interruption", 1, 0.85),
    ("bsd", "bsd", "governed by a bsd style license that can be found in the license file", 1, 0.95),
    ("bsd-4-clause-uc", "berkeley", "this product includes software developed by the university of california berkeley and its contributors", 0, 0.95),
    ("bsd-3-clause", "endorse", "nor the names of its contributors may be used to endorse or promote products derived from this software", 1, 0.95),
    ("bsd-3-clause-clear", "patent", "no express or implied licenses to any party s patent rights are granted by this license", 0, 0.95),
    ("bsd-3-clause-no-nuclear", "nuclear", "intended for use in the design construction operation or maintenance of any nuclear facility", 0, 0.95),
    ("bsd-2-clause-patent", "receiving", "each copyright holder and contributor hereby grants to those receiving rights under this license", 0, 0.95),
    ("bsd-2-clause-views", "freebsd", "representing official policies either expressed or implied of the freebsd project", 0, 0.95),
    ("apache-2", "contributor", "licensed to the apache software foundation asf under one or more contributor license agreements", 1, 0.95),
    ("apache-2", "governing", "see the license for the specific language governing permissions and limitations under the license", 1, 0.8),
    ("apache-2", "apache", "www apache org licenses license 2 0", 1, 0.95),
    ("apache-2", "irrevocable", "royalty free irrevocable copyright license to reproduce prepare derivative works of", 1, 0.9),
    ("apache-2", "reproduction", "terms and conditions for use reproduction and distribution", 1, 0.85),
    ("apache-1.1", "apache", "may not be called apache nor may apache appear in their name", 1, 0.95),
    ("apache-1.0", "apache", "may not be called apache nor may apache appear in their names", 0, 0.95),
    ("apache-1.0", "apache", "developed by the apache group for use in the apache http server project", 0, 0.95),
    ("ecl-2.0", "educational", "licensed under the educational community license version 2 0", 1, 0.95),
    ("gpl", "merchantability", "without even the implied warranty of merchantability or fitness for a particular purpose", 1, 0.75),
    ("gpl", "foundation", "if not write to the free software foundation", 1, 0.85),
    ("gpl", "incorporating", "general public license does not permit incorporating your program into proprietary programs", 1, 0.9),
    ("gpl", "absolutely", "comes with absolutely no warranty for details type show w", 1, 0.9),
    ("gpl-2.0", "freedom", "the licenses for most software are designed to take away your freedom to share and change it", 1, 0.95),
    ("gpl-3.0", "freedom", "software and other practical works are designed to take away your freedom to share and change the works", 1, 0.95),
    ("gpl-3.0", "copyleft", "the gnu general public license is a free copyleft license for software and other kinds of works", 1, 0.95),
    ("gpl-3.0", "methods", "installation information for a user product means any methods procedures authorization keys", 1, 0.9),
    ("gpl-2.0", "gnu", "www gnu org licenses (old licenses )?gpl 2 0", 0, 0.95),
    ("gpl-3.0", "gnu", "www gnu org licenses gpl 3 0", 0, 0.95),
    ("lgpl", "gnu", "see the gnu (lesser|library) general public license for more details", 1, 0.9),
    ("lgpl", "lgpl", "www gnu org licenses (old licenses )?lgpl", 0, 0.9),
    ("lgpl-2.0", "gnu", "gnu library general public license as published by the free software foundation either version 2", 0, 0.95),
    ("lgpl-2.0", "designated", "the library general public license applies to some specially designated", 1, 0.95),
    ("lgpl-2.1", "designated", "the lesser general public license applies to some specially designated software packages", 1, 0.95),
    ("lgpl-2.1", "gnu", "gnu lesser general public license version 2 1 as published by the free software foundation", 0, 0.95),
    ("lgpl-3.0", "supplemented", "version 3 of the gnu general public license supplemented by the additional permissions", 1, 0.95),
    ("agpl-3.0", "copyleft", "the gnu affero general public license is a free copyleft license", 1, 0.95),
    ("agpl-3.0", "remotely", "all users interacting with it remotely through a computer network", 1, 0.95),
    ("agpl-3.0", "affero", "see the gnu affero general public license for more details", 1, 0.9),
    ("agpl-3.0", "agpl", "www gnu org licenses agpl", 0, 0.95),
    ("gcc-exception-3.1", "gcc", "gcc runtime library exception", 0, 0.95),
    ("autoconf-exception", "autoconf", "contains a configuration script generated by autoconf", 0, 0.95),
    ("libtool-exception", "libtool", "as part of a program or library that is built using gnu libtool", 0, 0.95),
    ("bison-exception", "bison", "you may create a larger work that contains part or all of the bison parser skeleton", 0, 0.95),
    ("font-exception", "embed", "if you create a document which uses this font and embed this font", 0, 0.9),
    ("openssl-exception", "openssl", "permission to link the code of portions of this program with the openssl library", 0, 0.95),
    ("linux-syscall-note", "kernel", "does not cover user programs that use kernel services by normal system calls", 0, 0.95),
    ("wxwindows", "wxwindows", "wxwindows library licen(s|c)e", 1, 0.95),
    ("mpl-2.0", "mpl", "if a copy of the mpl was not distributed with this file you can obtain one at", 1, 0.95),
    ("mpl-2.0", "mozilla", "mozilla org mpl 2 0", 1, 0.95),
    ("mpl-2.0-no-copyleft-exception", "incompatible", "incompatible with secondary licenses as defined by the mozilla public license", 0, 0.95),
    ("mpl-1.0", "mozilla", "the contents of this file are subject to the mozilla public license version 1 0", 1, 0.95),
    ("mpl-1.1", "alternatively", "alternatively the contents of this file may be used under the terms of either the gnu general public license", 1, 0.9),
    ("npl-1.1", "netscape", "the contents of this file are subject to the netscape public license version 1 1", 1, 0.95),
    ("cpal-1.0", "attribution", "subject to the common public attribution license version 1 0", 1, 0.95),
    ("spl-1.0", "sun", "the contents of this file are subject to the sun public license", 1, 0.95),
    ("sissl", "sun", "sun industry standards source license", 1, 0.95),
    ("ipl-1.0", "ibm", "accompanying program is provided under the terms of this ibm public license", 1, 0.95),
    ("epl", "eclipse", "accompanying program is provided under the terms of this eclipse public license", 1, 0.95),
    ("epl-1.0", "eclipse", "www eclipse org legal epl v10", 0, 0.95),
    ("epl-2.0", "eclipse", "www eclipse org legal epl (2 0|v20)", 0, 0.95),
    ("edl-1.0", "eclipse", "eclipse distribution license", 1, 0.95),
    ("cecill", "cecill", "governed by the cecill license under french law", 1, 0.95),
    ("cecill-b", "cecill", "governed by the cecill b license under french law", 1, 0.95),
    ("cecill-c", "cecill", "governed by the cecill c license under french law", 1, 0.95),
    ("osl-3.0", "licensed", "licensed under the open software license version 3 0", 1, 0.95),
    ("afl-3.0", "academic", "licensed under the academic free license version 3 0", 1, 0.95),
    ("afl-2.1", "academic", "licensed under the academic free license version 2 1", 1, 0.95),
    ("rpl-1.5", "reciprocal", "reciprocal public license (version )?1 5", 1, 0.95),
    ("qpl-1.0", "q", "q public license version 1 0", 1, 0.95),
    ("lpl-1.02", "lucent", "lucent public license version 1 02", 1, 0.95),
    ("apsl-2.0", "apple", "subject to the apple public source license version 2 0", 1, 0.95),
    ("ms-pl", "governs", "this license governs use of the accompanying software if you use the software you accept this license", 1, 0.85),
    ("artistic-1.0", "artistic", "the copyright holder maintains some semblance of artistic control over the development of the package", 1, 0.95),
    ("artistic-2.0", "establishes", "this license establishes the terms under which a given free software package may be copied", 1, 0.95),
    ("ruby", "duplicate", "give away verbatim copies of the source form of the software without restriction provided that you duplicate", 1, 0.9),
    ("tcl", "retained", "for any purpose provided that existing copyright notices are retained in all copies", 1, 0.95),
    ("vim", "vim", "there are no restrictions on distributing unmodified copies of vim", 1, 0.95),
    ("python-2.0", "psf", "psf hereby grants licensee a nonexclusive royalty free world wide license", 1, 0.95),
    ("python-2.0", "beopen", "beopen com license agreement for python 2 0", 1, 0.95),
    ("cnri-python", "cnri", "cnri license agreement for python", 1, 0.95),
    ("zpl-2.1", "zope", "zope public license zpl version 2 1", 1, 0.95),
    ("w3c", "w3c", "w3c software (and document )?notice and license", 1, 0.95),
    ("unicode-dfs", "unicode", "unicode inc license agreement data files and software", 1, 0.95),
    ("unicode-3.0", "unicode", "unicode license v3", 1, 0.95),
    ("ftl", "freetype", "the freetype project license", 1, 0.95),
    ("imagemagick", "imagemagick", "licensed under the imagemagick license", 1, 0.95),
    ("libtiff", "leffler", "the names of sam leffler and silicon graphics may not be used in any advertising", 1, 0.95),
    ("bzip2-1.0.6", "bzip2", "this program bzip2 the associated library libbzip2 and all documentation are copyright", 1, 0.95),
    ("info-zip", "archives", "compiled executables and self extracting archives must reproduce the above copyright notice", 1, 0.95),
    ("sendmail", "sendmail", "sendmail license", 1, 0.9),
    ("ssleay", "ssl", "this package is an ssl implementation written by eric young", 1, 0.95),
    ("ssleay", "cryptographic", "this product includes cryptographic software written by eric young", 1, 0.95),
    ("fsfap", "royalty", "are permitted in any medium without royalty provided the copyright notice and this notice are preserved", 1, 0.95),
    ("fsful", "configure", "this configure script is free software the free software foundation gives unlimited permission", 1, 0.95),
    ("fsfullr", "unlimited", "unlimited permission to copy and or distribute it with or without modifications as long as this notice is preserved", 1, 0.95),
    ("blueoak-1.0.0", "oak", "blue oak model license", 1, 0.95),
    ("upl-1.0", "permissive", "universal permissive license", 1, 0.95),
    ("mulanpsl-2.0", "mulan", "licensed under mulan psl v2", 1, 0.95),
    ("ogl-uk-3.0", "government", "open government licence v3 0", 1, 0.95),
    ("etalab-2.0", "ouverte", "licence ouverte open licence", 1, 0.95),
    ("opl-1.0", "publication", "terms and conditions set forth in the open publication license", 1, 0.95),
    ("gfdl", "documentation", "gnu free documentation license version 1 (1|2|3)", 1, 0.95),
    ("lppl", "latex", "under the conditions of the latex project public license", 1, 0.95),
    ("ofl-1.1", "sil", "sil open font license version 1 1", 1, 0.95),
    ("ofl-1.1", "sil", "scripts sil org ofl", 1, 0.95),
    ("bitstream-vera", "vera", "bitstream vera is a trademark of bitstream inc", 1, 0.95),
    ("bitstream-vera", "fonts", "to any person obtaining a copy of the fonts accompanying this license", 1, 0.95),
    ("arphic-1999", "arphic", "arphic public license", 1, 0.95),
    ("ipa", "ipa", "ipa font license agreement", 1, 0.95),
    ("nasa-1.3", "nasa", "nasa open source agreement version 1 3", 1, 0.95),
    ("boost-1.0", "boost", "www boost org license 1 0 txt", 1, 0.95),
    ("unlicense", "unlicense", "unlicense org", 1, 0.9),
    ("wtfpl", "wtfpl", "www wtfpl net", 1, 0.95),
    ("mit", "opensource", "opensource org licenses mit", 1, 0.95),
    ("isc", "opensource", "opensource org licenses isc", 1, 0.95),
    ("zlib", "opensource", "opensource org licenses zlib", 1, 0.95),
    ("bsd-2-clause", "opensource", "opensource org licenses bsd 2 clause", 1, 0.95),
    ("bsd-3-clause", "opensource", "opensource org licenses bsd 3 clause", 1, 0.95),
    ("apache-2", "opensource", "opensource org licenses apache 2 0", 1, 0.95),
    ("cc-by", "creativecommons", "creativecommons org licenses by (1|2|3|4) (0|5)", 1, 0.95),
    ("cc-by-sa", "creativecommons", "creativecommons org licenses by sa (1|2|3|4) (0|5)", 1, 0.95),
    ("cc-by-nd", "creativecommons", "creativecommons org licenses by nd (1|2|3|4) (0|5)", 1, 0.95),
    ("cc-by-nc", "creativecommons", "creativecommons org licenses by nc (1|2|3|4) (0|5)", 1, 0.95),
    ("cc-by-nc-sa", "creativecommons", "creativecommons org licenses by nc sa (1|2|3|4) (0|5)", 1, 0.95),
    ("cc-by-nc-nd", "creativecommons", "creativecommons org licenses by nc nd (1|2|3|4) (0|5)", 1, 0.95),
    ("cc0-1.0", "creativecommons", "creativecommons org publicdomain zero 1 0", 1, 0.95),
    ("cc0-1.0", "commons", "creative commons legal code cc0 1 0 universal", 1, 0.95),
    ("odbl-1.0", "opendatacommons", "opendatacommons org licenses odbl", 1, 0.95),
    ("odc-by", "opendatacommons", "opendatacommons org licenses by", 1, 0.95),
    ("pddl-1.0", "opendatacommons", "opendatacommons org licenses pddl", 1, 0.95),
    ("cdla-permissive", "permissive", "community data license agreement permissive version (1|2) 0", 1, 0.95),
    ("cdla-sharing", "sharing", "community data license agreement sharing version 1 0", 1, 0.95),
    ("c-uda-1.0", "computational", "computational use of data agreement", 1, 0.95),
    ("polyform-noncommercial", "polyform", "polyform noncommercial license 1 0 0", 1, 0.95),
    ("polyform-small-business", "polyform", "polyform small business license 1 0 0", 1, 0.95),
    ("prosperity-3.0", "prosperity", "the prosperity public license 3 0 0", 1, 0.95),
    ("parity-7.0", "parity", "the parity public license 7 0 0", 1, 0.95),
    ("confluent", "confluent", "confluent community license", 1, 0.95),
    ("rsal", "redis", "redis source available license", 1, 0.95),
    ("hippocratic", "hippocratic", "hippocratic license", 1, 0.95),
    ("openrail", "creativeml", "creativeml open rail m", 1, 0.95),
    ("openrail", "bigscience", "bigscience (open )?rail", 1, 0.95),
    ("llama", "llama", "llama (2|3) community license agreement", 1, 0.95),
    ("gemma", "gemma", "gemma terms of use", 1, 0.95),
    ("public-domain", "government", "this is a work of the u s government and is not subject to copyright protection in the united states", 1, 0.95),
    ("nist-pd", "employees", "developed at the national institute of standards and technology by employees of the federal government", 1, 0.95),
    ("blessing", "forgiveness", "may you find forgiveness for yourself and forgive others", 1, 0.95),
    ("cc-pddc", "dedicator", "associated work with this document the dedicator or certifier", 1, 0.95),
    ("proprietary", "eula", "end user license agreement eula", 1, 0.85),
    ("proprietary", "decompile", "you may not reverse engineer decompile or disassemble", 1, 0.85),
    ("proprietary", "disclose", "you shall not disclose such confidential information and shall use it only in accordance with the terms", 1, 0.95),
    ("proprietary", "unpublished", "this is unpublished proprietary source code of", 1, 0.95),
    ("proprietary", "retain", "and its licensors retain all intellectual property and proprietary rights in and to this software", 1, 0.95),
    ("proprietary", "evaluation", "for evaluation purposes only", 2, 0.6),
    ("research-only", "research", "for (academic )?research purposes only", 2, 0.6),
]


RULE = "rule int, label string, keyword string, pattern string, priority int, confidence double, base boolean"
def _pattern(phrase: str) -> str:
    """A phrase over the plain form, which has a space on each side of every word; " ?" is a space or none."""
    plain = phrase.replace(" ?", "\x00").replace("( ", "(\x01").replace(" )", "\x01)")
    return " " + plain.replace(" ", "  ").replace("\x00", "(  )?").replace("(\x01", "(  ").replace("\x01)", "  )") + " "


def rules() -> list[tuple[int, str, str, str, int, float, bool]]:
    """Rows of RULE, best priority first."""
    out = []
    for label, keyword, names in LICENSES:
        for name in names:
            plain = "  ".join(name.split())
            out += [(label, keyword, pattern.format(plain), priority, confidence, False) for pattern, priority, confidence in PHRASES]
    out += [(label, keyword, _pattern(phrase), priority, confidence, False) for label, keyword, phrase, priority, confidence in NOTICES]
    keys = {keyword for _, keyword, *_ in out}
    out += [(label, next(w for w in phrase.split() if w in keys), " " + "  ".join(phrase.split()) + " ", 1, 0.9, True) for phrase, label in BASE]
    out.sort(key=lambda r: r[3])
    return [(i, *r) for i, r in enumerate(out)]


def _parts(pattern: str) -> list[str]:
    """What any match of ``pattern`` contains between spaces: what stands outside groups and has no alternatives."""
    # A group leaves a mark, which spoils a word that it is a part of.
    mark = lambda m: "".join(" " if c == " " else "\x00" for c in (m[1][0], m[1][-1]))
    while (less := re.sub(r"\(([^()]+)\)\??", mark, pattern)) != pattern:
        pattern = less
    return [w for w in pattern.split() if "\x00" not in w]


def needed(pattern: str) -> list[str]:
    """Words that any match of ``pattern`` contains."""
    return [w for w in _parts(pattern) if w.isalnum()]


#: Words too common to tell texts apart.
COMMON = {*"a above all an and any are as at back based be by common computer contains copy developed do document find for from have in is it made may must no not of on only open or other part same see should so subject that the these this to under use we with without you your".split(), *"0123456789"}


def gate() -> str:
    """A pattern that any text with a detection matches: few words, one of them in each rule's pattern."""
    left, chosen = [(own := set(_parts(r[3]))) - COMMON or own for r in rules()], []
    while left:
        count = Counter(w for words in left for w in words)
        chosen.append(min(count, key=lambda w: (-count[w], w)))
        left = [words for words in left if chosen[-1] not in words]
    return f" ({'|'.join(sorted(chosen))}) "


def gated_rules() -> list[tuple[int, str, str, str, int, float, bool]]:
    """``rules`` with a keyword that each pattern must contain as a whole word ("gplv2" does not contain "gpl")."""
    out = []
    for rule, label, keyword, pattern, *rest in rules():
        words = needed(pattern)
        if keyword not in words:
            keyword = next((w for w in words if keyword in w), words[-1])
        out.append((rule, label, keyword, pattern, *rest))
    return out


def plain_form(text: Column) -> Column:
    """Words in lower case, one space on each side of every word."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    body = F.trim(F.regexp_replace(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "  "))
    return F.when(body == "", F.lit("")).otherwise(F.concat(F.lit(" "), body, F.lit(" ")))


def _words(plain: Column) -> Column:
    return ((F.length(plain) - F.length(F.replace(plain, F.lit(" "), F.lit("")))) / 2).cast("long")


def detections(docs: DataFrame) -> DataFrame:
    """A row for each place where a rule matches (row, doc_id, n_words, RULE, start, end in words), and one with nulls
    for each document."""
    spark = docs.sparkSession
    table = spark.createDataFrame(gated_rules(), RULE)
    keywords = "|".join(sorted({r[2] for r in gated_rules()}))
    texts = docs.select("doc_id", plain_form(F.col("text")).alias("plain")).withColumn("row", F.monotonically_increasing_id())
    texts = texts.withColumn("n_words", _words(F.col("plain")))
    found = F.when(F.col("plain").rlike(gate()), F.array_distinct(F.regexp_extract_all("plain", F.lit(f" ({keywords}) "), 1)))
    texts = texts.withColumn("key", F.explode(F.concat(F.array(F.lit("")), F.coalesce(found, F.array().cast("array<string>")))))
    # The text goes on only with a keyword.
    texts = texts.withColumn("plain", F.when(F.col("key") != "", F.col("plain")))
    tried = texts.join(F.broadcast(table), F.col("key") == F.col("keyword"), "left")
    tried = tried.withColumn("pieces", F.when(F.col("rule").isNotNull(), F.split("plain", F.col("pattern"), -1)))
    hit = tried.where((F.col("key") == "") | (F.size("pieces") > 1))
    counted = hit.withColumns({"gaps": F.transform("pieces", _words), "hits": F.transform(F.regexp_extract_all("plain", F.col("pattern"), F.lit(0)), _words)})
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda x, y: x + y)
    start = lambda i: total(F.slice("gaps", F.lit(1), i + 1)) + total(F.slice("hits", F.lit(1), i))
    placed = counted.select("row", "doc_id", "n_words", "rule", "label", "priority", "confidence", "base", "gaps", "hits", F.posexplode_outer("hits").alias("i", "words"))
    return placed.withColumn("start", start(F.col("i"))).withColumn("end", F.col("start") + F.col("words")).drop("gaps", "hits", "i", "words")


def suppressed() -> Column:
    """Whether a detection lies within one of a better priority or within a longer one of its own."""
    order = Window.partitionBy("row").orderBy("start")
    till, before, same = (order.rangeBetween(*r) for r in ((Window.unboundedPreceding, 0), (Window.unboundedPreceding, -1), (0, 0)))
    out = F.lit(False)
    for p in range(3):
        own = F.when(F.col("priority") == p, F.col("end"))
        better = F.when(F.col("priority") < p, F.col("end"))
        within = (F.max(better).over(till) >= F.col("end")) | (F.max(own).over(before) >= F.col("end")) | (F.max(own).over(same) > F.col("end"))
        out = out | ((F.col("priority") == p) & F.coalesce(within, F.lit(False)))
    return out


def license_scan(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    judged = detections(docs).withColumn("stays", F.col("base") | ~suppressed())
    base, stays = F.col("base"), F.col("stays")
    listed = lambda c: F.array_join(F.sort_array(F.collect_set(F.when(c, F.col("label")))), ",")
    out = judged.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"), listed(base).alias("base_labels"), listed(stays).alias("labels"), F.coalesce(F.max(F.when(stays, F.col("confidence"))), F.lit(0.0)).alias("score"),
    )
    return out.drop("row")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))


def op1_sql() -> str:
    """The same in SQL, without any gate: every rule is tried on every text."""
    values = ",\n  ".join(f"({i}, '{label}', '{keyword}', '{pattern}', {priority}, {confidence}::DOUBLE, {base})" for i, label, keyword, pattern, priority, confidence, base in gated_rules())
    count = lambda c: f"((length({c}) - length(replace({c}, ' ', ''))) // 2)"
    return rf"""
WITH r(rule, label, keyword, pattern, priority, confidence, base) AS (VALUES
  {values}),
b AS (SELECT doc_id, trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', '  ', 'g'), ' ') AS body FROM documents),
d AS (SELECT doc_id, CASE WHEN body = '' THEN '' ELSE ' ' || body || ' ' END AS plain FROM b),
t AS (SELECT doc_id, plain, pattern, rule, label, priority, confidence, base FROM d, r WHERE regexp_matches(plain, pattern)),
h AS (SELECT *, regexp_split_to_array(plain, pattern) AS gaps, regexp_extract_all(plain, pattern) AS hits FROM t),
p AS (SELECT h.*, i, array_to_string(gaps[1:i], '') || array_to_string(hits[1:i - 1], '') AS ahead, hits[i] AS hit FROM h, unnest(generate_series(1, len(hits))) AS g(i)),
s AS (SELECT doc_id, rule, label, priority, confidence, base, {count("ahead")} AS s, {count("ahead")} + {count("hit")} AS e FROM p),
x AS (
  SELECT a.doc_id, a.label, a.confidence, a.base, a.s, a.base OR NOT EXISTS (
    SELECT 1 FROM s c WHERE c.doc_id = a.doc_id AND c.s <= a.s AND c.e >= a.e AND (c.priority < a.priority OR (c.priority = a.priority AND c.e - c.s > a.e - a.s))) AS stays
  FROM s a)
SELECT d.doc_id, {count("any_value(d.plain)")}::BIGINT AS n_words, count(*) FILTER (base)::BIGINT AS n_base, min(s) FILTER (base)::BIGINT AS first_word, max(s) FILTER (base)::BIGINT AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (stays), '') AS labels, coalesce(max(confidence) FILTER (stays), 0.0)::DOUBLE AS score
FROM d LEFT JOIN x ON d.doc_id = x.doc_id GROUP BY d.doc_id
"""


OP1_SQL = op1_sql()
