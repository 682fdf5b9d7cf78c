"""Signature rules for license scans: hand-written notices, and the wordings in which each license is named.

The notices, clauses and headers of ``NOTICES`` are regexes of their own. Every license of ``LICENSES`` adds
rules for its identifier, its text's address and its names. Rules are ordered: a lower priority number wins
where detections overlap.
"""

from __future__ import annotations

import re

#: Identifier, label, names as they are written in notices, host and path of the license text.
LICENSES = [
    ("0BSD", "0bsd", ["Zero-Clause BSD", "BSD Zero Clause License"], "opensource.org/licenses/0BSD"),
    ("AFL-3.0", "afl-3.0", ["Academic Free License"], "opensource.org/licenses/AFL-3.0"),
    ("AGPL-3.0", "agpl-3.0", ["GNU Affero General Public License", "Affero GPL"], "gnu.org/licenses/agpl"),
    ("Apache-1.1", "apache-1.1", ["Apache Software License, Version 1.1"], "apache.org/licenses/LICENSE-1.1"),
    ("Apache-2.0", "apache-2.0", ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"], "apache.org/licenses/LICENSE-2.0"),
    ("APSL-2.0", "apsl-2.0", ["Apple Public Source License"], "opensource.apple.com/license/apsl"),
    ("Artistic-2.0", "artistic-2.0", ["Artistic License 2.0", "Artistic License"], "opensource.org/licenses/artistic-license-2.0"),
    ("Beerware", "beerware", ["Beerware License", "Beer-ware License"], "people.freebsd.org/~phk"),
    ("BSD-2-Clause", "bsd-2-clause", ["Simplified BSD License", "2-Clause BSD License", "FreeBSD License"], "opensource.org/licenses/BSD-2-Clause"),
    ("BSD-3-Clause", "bsd-3-clause", ["New BSD License", "Modified BSD License", "3-Clause BSD License"], "opensource.org/licenses/BSD-3-Clause"),
    ("BSD-4-Clause", "bsd-4-clause", ["Original BSD License", "4-Clause BSD License"], "spdx.org/licenses/BSD-4-Clause"),
    ("BSL-1.0", "bsl-1.0", ["Boost Software License"], "boost.org/LICENSE_1_0"),
    ("BUSL-1.1", "busl-1.1", ["Business Source License"], "mariadb.com/bsl11"),
    ("CC0-1.0", "cc0-1.0", ["Creative Commons Zero", "CC0 1.0 Universal"], "creativecommons.org/publicdomain/zero"),
    ("CC-BY-4.0", "cc-by-4.0", ["Creative Commons Attribution 4.0", "CC BY 4.0"], "creativecommons.org/licenses/by/4.0"),
    ("CC-BY-3.0", "cc-by-3.0", ["Creative Commons Attribution 3.0", "CC BY 3.0"], "creativecommons.org/licenses/by/3.0"),
    ("CC-BY-SA-4.0", "cc-by-sa-4.0", ["Creative Commons Attribution-ShareAlike 4.0", "CC BY-SA 4.0"], "creativecommons.org/licenses/by-sa/4.0"),
    ("CC-BY-SA-3.0", "cc-by-sa-3.0", ["Creative Commons Attribution-ShareAlike 3.0", "CC BY-SA 3.0"], "creativecommons.org/licenses/by-sa/3.0"),
    ("CC-BY-NC-4.0", "cc-by-nc-4.0", ["Creative Commons Attribution-NonCommercial 4.0", "CC BY-NC 4.0"], "creativecommons.org/licenses/by-nc/4.0"),
    ("CC-BY-ND-4.0", "cc-by-nd-4.0", ["Creative Commons Attribution-NoDerivatives 4.0", "CC BY-ND 4.0"], "creativecommons.org/licenses/by-nd/4.0"),
    ("CC-BY-NC-SA-4.0", "cc-by-nc-sa-4.0", ["Creative Commons Attribution-NonCommercial-ShareAlike 4.0", "CC BY-NC-SA 4.0"], "creativecommons.org/licenses/by-nc-sa/4.0"),
    ("CC-BY-NC-ND-4.0", "cc-by-nc-nd-4.0", ["Creative Commons Attribution-NonCommercial-NoDerivatives 4.0", "CC BY-NC-ND 4.0"], "creativecommons.org/licenses/by-nc-nd/4.0"),
    ("CDDL-1.0", "cddl-1.0", ["Common Development and Distribution License"], "opensource.org/licenses/CDDL-1.0"),
    ("CECILL-2.1", "cecill-2.1", ["CeCILL License"], "cecill.info/licences"),
    ("CPL-1.0", "cpl-1.0", ["Common Public License"], "opensource.org/licenses/CPL-1.0"),
    ("ECL-2.0", "ecl-2.0", ["Educational Community License"], "opensource.org/licenses/ECL-2.0"),
    ("EPL-1.0", "epl-1.0", ["Eclipse Public License - v 1.0", "Eclipse Public License 1.0"], "eclipse.org/legal/epl-v10"),
    ("EPL-2.0", "epl-2.0", ["Eclipse Public License - v 2.0", "Eclipse Public License 2.0"], "eclipse.org/legal/epl-2.0"),
    ("EUPL-1.2", "eupl-1.2", ["European Union Public Licence"], "joinup.ec.europa.eu/collection/eupl"),
    ("GFDL-1.3", "gfdl-1.3", ["GNU Free Documentation License"], "gnu.org/licenses/fdl"),
    ("GPL-1.0", "gpl-1.0", ["GNU General Public License, version 1"], "gnu.org/licenses/old-licenses/gpl-1.0"),
    ("GPL-2.0", "gpl-2.0", ["GNU General Public License, version 2", "GNU GPL v2", "GPLv2"], "gnu.org/licenses/old-licenses/gpl-2.0"),
    ("GPL-3.0", "gpl-3.0", ["GNU General Public License, version 3", "General Public License, version 3", "GNU GPL v3", "GPLv3"], "gnu.org/licenses/gpl-3.0"),
    ("ISC", "isc", ["ISC License"], "opensource.org/licenses/ISC"),
    ("LGPL-2.0", "lgpl-2.0", ["GNU Library General Public License"], "gnu.org/licenses/old-licenses/lgpl-2.0"),
    ("LGPL-2.1", "lgpl-2.1", ["GNU Lesser General Public License, version 2.1", "LGPLv2.1"], "gnu.org/licenses/old-licenses/lgpl-2.1"),
    ("LGPL-3.0", "lgpl-3.0", ["GNU Lesser General Public License, version 3", "LGPLv3"], "gnu.org/licenses/lgpl-3.0"),
    ("LPPL-1.3c", "lppl-1.3c", ["LaTeX Project Public License"], "latex-project.org/lppl"),
    ("MIT", "mit", ["MIT License", "Expat License"], "opensource.org/licenses/MIT"),
    ("MPL-1.1", "mpl-1.1", ["Mozilla Public License, version 1.1", "Mozilla Public License 1.1"], "mozilla.org/MPL/MPL-1.1"),
    ("MPL-2.0", "mpl-2.0", ["Mozilla Public License, v. 2.0", "Mozilla Public License 2.0"], "mozilla.org/MPL/2.0"),
    ("MS-PL", "ms-pl", ["Microsoft Public License"], "opensource.org/licenses/MS-PL"),
    ("MS-RL", "ms-rl", ["Microsoft Reciprocal License"], "opensource.org/licenses/MS-RL"),
    ("NCSA", "ncsa", ["University of Illinois/NCSA Open Source License"], "opensource.org/licenses/NCSA"),
    ("ODbL-1.0", "odbl-1.0", ["Open Database License"], "opendatacommons.org/licenses/odbl"),
    ("OFL-1.1", "ofl-1.1", ["SIL Open Font License"], "scripts.sil.org/OFL"),
    ("OpenSSL", "openssl", ["OpenSSL License"], "openssl.org/source/license"),
    ("OSL-3.0", "osl-3.0", ["Open Software License"], "opensource.org/licenses/OSL-3.0"),
    ("PHP-3.01", "php-3.01", ["PHP License"], "php.net/license/3_01"),
    ("PostgreSQL", "postgresql", ["PostgreSQL License"], "opensource.org/licenses/PostgreSQL"),
    ("PSF-2.0", "psf-2.0", ["Python Software Foundation License"], "docs.python.org/license"),
    ("Ruby", "ruby", ["Ruby License"], "ruby-lang.org/en/about/license"),
    ("SSPL-1.0", "sspl-1.0", ["Server Side Public License"], "mongodb.com/licensing/server-side-public-license"),
    ("Unlicense", "unlicense", ["The Unlicense", "Unlicense"], "unlicense.org"),
    ("UPL-1.0", "upl-1.0", ["Universal Permissive License"], "oss.oracle.com/licenses/upl"),
    ("Vim", "vim", ["Vim License"], "vimdoc.sourceforge.net/htmldoc/uganda"),
    ("W3C", "w3c", ["W3C Software Notice and License"], "w3.org/Consortium/Legal"),
    ("WTFPL", "wtfpl", ["Do What The Fuck You Want To Public License"], "wtfpl.net"),
    ("X11", "x11", ["X11 License"], "spdx.org/licenses/X11"),
    ("Zlib", "zlib", ["zlib License", "zlib/libpng License"], "opensource.org/licenses/Zlib"),
    ("ZPL-2.1", "zpl-2.1", ["Zope Public License"], "opensource.org/licenses/ZPL-2.0"),
]

#: Notices, clauses and headers as licenses write them: label, words that every match holds, regex (a blank is any white space), score.
NOTICES = [
    ("apache-2.0", "apache licensed version", r"licensed under the apache license, version 2\.0 \(the [\"“]?license[\"”]?\)", 1.0),
    ("apache-2.0", "apache contributor foundation", r"licensed to the apache software foundation \(asf\) under one or more contributor license agreements", 0.95),
    ("apache-2.0", "apache //www.apache.org/licenses/license-2.0 compliance", r"you may not use this file except in compliance with the license.{1,60}obtain a copy of the license at https?://www\.apache\.org/licenses/license-2\.0", 1.0),
    ("apache-2.0", "perpetual non-exclusive licen", r"hereby grants to you a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license", 0.9),
    ("apache-2.0", "perpetual non-exclusive licen", r"perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable \(except as stated in this section\) patent license", 0.9),
    ("apache-2.0", "basis distributed conditions", r"distributed under the license is distributed on an [\"'“]?as is[\"'”]? basis, without warranties or conditions of any kind", 0.9),
    ("apache-1.1", "apache developed includes", r"this product includes software developed by the apache (?:software foundation|group)", 0.9),
    ("apache-family", "apache", r"\bapache(?:-| )(?:style )?license", 0.5),
    ("mit", "permission documentation associated", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", 1.0),
    ("mit", "permission obtaining", r"permission is hereby granted, free of charge, to any person obtaining a copy", 0.95),
    ("mit", "sublicense distribute", r"to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software", 0.95),
    ("mit", "permission notice substantial", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 0.95),
    ("mit", "merchantability noninfringement warrant", r"including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement", 0.85),
    ("mit", "dealings connection software", r"arising from, out of or in connection with the software or the use or other dealings in the software", 0.85),
    ("mit-0", "attribution mit", r"\bmit no attribution\b", 0.9),
    ("mit-0", "mit-0", r"\bmit-0\b", 0.9),
    ("x11", "consortium advertising", r"the name of the x consortium shall not be used in advertising", 0.95),
    ("mit-family", "style licen", r"\b(?:mit|expat|x11)(?: |-)style licen[sc]e\b", 0.6),
    ("isc", "permission distribute", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted", 0.95),
    ("isc", "permission distribute", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose", 0.9),
    ("isc", "author disclaims warranties", r"the author disclaims all warranties with regard to this software", 0.85),
    ("bsd-family", "redistribution modification", r"redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", 0.95),
    ("bsd-family", "redistribution modification", r"redistribution and use in source and binary forms, with or without modification", 0.85),
    ("bsd-family", "redistributions copyright", r"redistributions of source code must retain the above copyright notice", 0.85),
    ("bsd-family", "redistributions copyright", r"redistributions in binary form must reproduce the above copyright notice", 0.85),
    ("bsd-3-clause", "endorse contributors products", r"neither the name of .{1,120} nor the names of (?:its|their|any) contributors may be used to endorse or promote products", 0.95),
    ("bsd-3-clause", "endorse products promote", r"names? of (?:the )?(?:author|copyright holder|contributor)s?(?:\(s\))? may not be used to endorse or promote products", 0.9),
    ("bsd-4-clause", "advertising acknowledg software", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 0.95),
    ("bsd-4-clause", "university california software", r"this product includes software developed by the university of california, berkeley", 0.9),
    ("bsd-family", "regents california university", r"the regents of the university of california", 0.5),
    ("bsd-family", "copyright holders contributors", r"this software is provided by the copyright holders and contributors [\"'“]?as is", 0.8),
    ("bsd-family", "regents contributors software", r"this software is provided by the regents and contributors [\"'“]?as is", 0.85),
    ("bsd-family", "consequential incidental liab", r"in no event shall the .{1,80} be liable for any direct, indirect, incidental, special, exemplary, or consequential damages", 0.7),
    ("bsd-family", "bsd licen", r"\bbsd(?: |-)(?:style )?licen[sc]e", 0.6),
    ("0bsd", "permission distribute", r"permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted\.(?! provided)", 0.85),
    ("gpl-2.0-or-later", "version either licen", r"either version 2 of the license, or \(at your option\) any later version", 1.0),
    ("gpl-3.0-or-later", "version either licen", r"either version 3 of the license, or \(at your option\) any later version", 1.0),
    ("gpl-2.0-only", "version general licen", r"under the terms of the gnu general public license,? version 2 only", 0.95),
    ("gpl-2.0-only", "version foundation published", r"under the terms of (?:the )?gnu general public license version 2 as published by the free software foundation", 0.95),
    ("gpl-family", "free software redistribute", r"this program is free software[;:,] you can redistribute it and/or modify it under the terms of the gnu general public license", 1.0),
    ("gpl-family", "free software redistribute", r"is free software[;:,] you can redistribute it and/or modify it", 0.8),
    ("gpl-family", "useful distributed warranty", r"distributed in the hope that it will be useful, but without any warranty; without even the implied warranty", 0.85),
    ("gpl-family", "gnu received licen", r"you should have received a copy of the gnu (?:affero |lesser |library )?general public license along with", 0.9),
    ("gpl-family", "free software foundation", r"published by the free software foundation", 0.8),
    ("gpl-family", "foundation write software", r"write to the free software foundation, inc\.,? (?:59 temple place|51 franklin (?:street|st)|675 mass ave)", 0.85),
    ("gpl-family", "verbatim distribute permitted", r"everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed", 0.9),
    ("gpl-family", "copyleft licen", r"\b(?:strong |weak )?copyleft licen[sc]e\b", 0.5),
    ("gpl-family", "general public", r"general public license", 0.7),
    ("gpl-family", "gpl", r"\b(?:a|l)?gpl(?: ?v?[0-9](?:\.[0-9])?)?\+?\b", 0.5),
    ("gpl-or-later", "later version", r"(?:at your option\) )?any later version", 0.6),
    ("gpl-2.0", "gpl", r"\bgpl ?v?2(?:\.0)?(?:\+| or later)?\b", 0.85),
    ("gpl-3.0", "gpl", r"\bgpl ?v?3(?:\.0)?(?:\+| or later)?\b", 0.85),
    ("lgpl-family", "lesser general public", r"gnu lesser general public license", 0.85),
    ("lgpl-2.1-or-later", "version 2.1 licen", r"either version 2\.1 of the license, or \(at your option\) any later version", 1.0),
    ("lgpl-family", "library redistribute", r"this library is free software[;:,] you can redistribute it and/or modify it under the terms of the gnu (?:lesser|library) general public license", 1.0),
    ("lgpl-family", "lgpl", r"\blgpl ?v?[23](?:\.[01])?(?:\+| or later)?\b", 0.85),
    ("agpl-family", "affero general licen", r"gnu affero general public license", 0.9),
    ("agpl-3.0", "agpl", r"\bagpl ?v?3(?:\.0)?(?:\+| or later)?\b", 0.85),
    ("agpl-family", "remotely interacting", r"users interacting with it remotely through a computer network", 0.85),
    ("classpath-exception", "linking dynamically statically", r"linking this library statically or dynamically with other modules is making a combined work based on this library", 0.95),
    ("classpath-exception", "classpath exception", r"\bclasspath(?: |-)exception\b", 0.9),
    ("gcc-exception", "gcc runtime exception", r"gcc runtime library exception", 0.95),
    ("linking-exception", "exception permission", r"as a special exception,? .{1,80} gives? (?:you )?permission to link", 0.85),
    ("autoconf-exception", "configure generated exception", r"as a special exception.{1,80}configure script generated by autoconf", 0.9),
    ("bison-exception", "bison exception skeleton", r"special exception.{1,120}bison parser skeleton", 0.9),
    ("openssl-exception", "openssl permission", r"permission to link the code of .{1,80} with the openssl", 0.9),
    ("font-exception", "document embed", r"document(?:s)? which uses? this font.{1,80}embed", 0.8),
    ("mpl-2.0", "mozilla subject", r"this source code form is subject to the terms of the mozilla public license, v\. 2\.0", 1.0),
    ("mpl-2.0", "mpl distributed obtain", r"if a copy of the mpl was not distributed with this file, you can obtain one at", 1.0),
    ("mpl-1.1", "mozilla contents", r"the contents of this file are subject to the mozilla public license version 1\.1", 1.0),
    ("mpl-family", "secondary incompatible licen", r"incompatible with secondary licenses", 0.9),
    ("mpl-family", "mozilla public", r"mozilla public licen[sc]e", 0.8),
    ("epl-1.0", "eclipse available", r"made available under the terms of the eclipse public license v1\.0", 1.0),
    ("epl-2.0", "eclipse available", r"made available under the terms of the eclipse public license (?:v\. ?)?2\.0", 1.0),
    ("epl-family", "eclipse licen", r"eclipse (?:public|distribution) licen[sc]e", 0.8),
    ("cpl-1.0", "accompanying provided", r"the accompanying program is provided under the terms of this common public license", 0.95),
    ("cddl-1.0", "common development distribution", r"subject to the terms of the common development and distribution license", 1.0),
    ("cddl-family", "cddl", r"\bcddl(?:(?: |-)?v?1\.[01])?\b", 0.8),
    ("zlib", "express provided warranty", r"this software is provided ['\"‘]as-is['\"’],? without any express or implied warranty", 0.9),
    ("zlib", "origin misrepresented software", r"the origin of this software must not be misrepresented; you must not claim that you wrote the original software", 0.95),
    ("zlib", "altered misrepresented software", r"altered source versions must be plainly marked as such, and must not be misrepresented as being the original software", 0.95),
    ("bsl-1.0", "boost distributed version", r"distributed under the boost software license, version 1\.0", 1.0),
    ("bsl-1.0", "machine-executable processor", r"machine-executable object code generated by a source language processor", 0.9),
    ("artistic-family", "artistic licen", r"\b(?:perl )?artistic licen[sc]e\b", 0.8),
    ("artistic-family", "perl terms", r"under the same terms as perl(?: itself)?", 0.85),
    ("psf-2.0", "python software foundation", r"python software foundation license version 2", 0.95),
    ("python-family", "beopen beopen.com agreement", r"beopen\.com license agreement for python 2\.0", 0.95),
    ("php-3.01", "php version licen", r"subject to version 3\.01 of the php license", 1.0),
    ("php-family", "php includes software", r"this product includes php software", 0.8),
    ("ruby", "terms ruby same", r"same terms as ruby", 0.85),
    ("openssl", "openssl developed software", r"this product includes software developed by the openssl project for use in the openssl toolkit", 0.95),
    ("ssleay", "eric young software", r"this product includes cryptographic software written by eric young", 0.95),
    ("wtfpl", "fuck want", r"you just do what the fuck you want to", 1.0),
    ("beerware", "beer return", r"you can buy me a beer in return", 1.0),
    ("unlicense", "unencumbered released software", r"this is free and unencumbered software released into the public domain", 1.0),
    ("unlicense", "dedicate copyright", r"dedicate any and all copyright interest in the software to the public domain", 0.95),
    ("public-domain", "domain public", r"(?:released|placed|dedicated) (?:in|into|to) the public domain", 0.8),
    ("public-domain", "domain public", r"(?:is|are|as) (?:hereby )?(?:in )?(?:the )?public domain\b", 0.7),
    ("public-domain", "domain public", r"public domain (?:dedication|mark|work|software)", 0.7),
    ("public-domain", "waive copyright related", r"waives? all copyright and related or neighbou?ring rights", 0.85),
    ("public-domain", "copyright no", r"no copyright (?:is claimed|is asserted|restrictions)", 0.7),
    ("us-government", "government work", r"work of the (?:u\.?s\.?|united states) government", 0.7),
    ("cc0-1.0", "cc0", r"\bcc0(?:(?: |-)1\.0)?(?: universal)?\b", 0.9),
    ("cc-by-4.0", "attribution international", r"creative commons attribution 4\.0 international", 1.0),
    ("cc-by-sa-4.0", "sharealike attribution-sharealike international", r"creative commons attribution-sharealike 4\.0 international", 1.0),
    ("cc-by-sa-3.0", "sharealike attribution-sharealike creative", r"creative commons attribution-sharealike 3\.0 unported", 1.0),
    ("cc-by-nc-sa-4.0", "sharealike attribution-noncommercial-sharealike international", r"creative commons attribution-noncommercial-sharealike 4\.0 international", 1.0),
    ("cc-by-nc-4.0", "noncommercial attribution-noncommercial international", r"creative commons attribution-noncommercial 4\.0 international", 1.0),
    ("cc-by-nd-4.0", "noderiv attribution-noderiv international", r"creative commons attribution-noderiv(?:s|atives) 4\.0 international", 1.0),
    ("cc-by-sa", "share-alike attribution-share-alike", r"attribution-share-alike", 0.8),
    ("cc-family", "commons creative licensed", r"this work is licensed under a creative commons", 0.95),
    ("cc-family", "commons creative", r"creative commons(?: license)?", 0.6),
    ("cc-family", "cc by", r"\bcc by(?:-nc)?(?:-sa|-nd)?\b", 0.6),
    ("cc-family", "cc-by", r"\bcc-by(?:-nc)?(?:-sa|-nd)?(?:-[0-9]\.[0-9])?\b", 0.7),
    ("cc-family", "share free", r"you are free to share.{1,60}under the following (?:terms|conditions)", 0.7),
    ("cc-nc", "commercial only", r"for non-?commercial (?:use|purposes) only", 0.6),
    ("gfdl-family", "documentation distribute", r"permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation license", 1.0),
    ("gfdl-family", "invariant front-cover back-cover", r"with no invariant sections, no front-cover texts,? and no back-cover texts", 0.95),
    ("gfdl-family", "documentation free", r"gnu free documentation license", 0.9),
    ("ofl-1.1", "font licensed open", r"this font software is licensed under the sil open font license", 1.0),
    ("ofl-1.1", "reserved font name", r"with reserved font name", 0.85),
    ("odbl-1.0", "database available licen", r"made available under the open database licen[sc]e", 0.95),
    ("odc-by", "open data attribution", r"open data commons attribution licen[sc]e", 0.9),
    ("pddl", "public domain dedication", r"public domain dedication and licen[sc]e", 0.9),
    ("ms-pl", "microsoft licen", r"microsoft (?:public|permissive) license", 0.9),
    ("ms-rl", "reciprocal microsoft licen", r"microsoft reciprocal license", 0.9),
    ("eupl-family", "eupl licensed", r"licensed under the eupl\b", 0.9),
    ("eupl-family", "eupl", r"\beupl(?: |-)v?1\.[0-2]\b", 0.9),
    ("cecill-family", "cecill", r"\bcecill(?:-[abc])?(?:(?: |-)v?[12](?:\.[01])?)?\b", 0.8),
    ("sspl-1.0", "server side public", r"server side public license", 0.95),
    ("busl-1.1", "change date licen", r"\bchange date: .{1,40}change license:", 0.95),
    ("elastic-2.0", "elastic 2.0 licen", r"\belastic license 2\.0\b", 0.95),
    ("commons-clause", "commons clause condition", r"commons clause[\"”]? license condition", 0.95),
    ("polyform", "polyform licen", r"polyform (?:noncommercial|small business|shield|strict|free trial|perimeter|internal use) license", 0.95),
    ("openrail", "rail", r"\b(?:open|creativeml )(?:-| )?rail(?:-?[ams]+)?\b", 0.85),
    ("llama", "llama community licen", r"\bllama [23](?:\.[0-9])? community license", 0.95),
    ("json", "evil shall software", r"the software shall be used for good, not evil", 1.0),
    ("ncsa", "illinois university", r"developed by: .{1,120}university of illinois", 0.8),
    ("hpnd", "permission documentation distribute", r"permission to use, copy, modify,? and distribute this software and its documentation for any purpose", 0.85),
    ("curl", "curl licen", r"\bcurl license\b", 0.85),
    ("curl", "copyright stenberg", r"copyright \(c\) [0-9,\s-]+daniel stenberg", 0.85),
    ("libpng", "png libpng licen", r"\blibpng license\b", 0.85),
    ("libpng", "reference supplied", r"png reference library is supplied", 0.85),
    ("ijg", "jpeg independent software", r"this software is based in part on the work of the independent jpeg group", 0.95),
    ("freetype", "freetype copyright", r"portions of this software are copyright .{1,40} the freetype project", 0.95),
    ("unicode", "unicode agreement", r"unicode(?:, inc\.)? license agreement", 0.85),
    ("unicode", "unicode files", r"unicode data files and software", 0.85),
    ("w3c", "w3c licen", r"w3c(?:®|\(r\))? software (?:notice and )?license", 0.9),
    ("osl-3.0", "open software licensed", r"licensed under the open software license version 3\.0", 0.95),
    ("afl-3.0", "academic licensed", r"licensed under the academic free license version 3\.0", 0.95),
    ("postgresql", "postgresql released licen", r"released under the postgresql licen[sc]e", 0.95),
    ("sqlite", "evil good", r"may you do good and not evil", 1.0),
    ("dual", "dual licen", r"\bdual(?: |-)licen[sc]ed\b", 0.7),
    ("dual", "either option licen", r"licen[sc]ed under either of .{1,80}at your option", 0.8),
    ("dual", "mit apache", r"\bmit (?:or|/|and) apache(?:(?: |-)2\.0)?\b", 0.8),
    ("dual", "apache mit", r"\bapache(?:(?: |-)2\.0)? (?:or|/|and) mit\b", 0.8),
    ("dual", "gpl", r"\bgpl (?:or|/|and) (?:mit|bsd|apache|commercial)\b", 0.75),
    ("commercial", "commercial licen", r"commercial licen[sc]e (?:is )?(?:required|available|agreement)", 0.7),
    ("proprietary", "proprietary confidential", r"proprietary and confidential", 0.8),
    ("proprietary", "unauthori ed", r"unauthori[sz]ed (?:copying|reproduction|distribution|use)", 0.7),
    ("proprietary", "trade secret", r"(?:contains|constitutes?|is a) (?:valuable )?trade secrets?", 0.7),
    ("proprietary", "confidential strictly", r"strictly (?:private and )?confidential", 0.6),
    ("proprietary", "written may", r"may not be (?:copied|reproduced|disclosed|distributed)(?:,? (?:copied|reproduced|disclosed|distributed|or))* without (?:the )?(?:prior |express )?written (?:permission|consent)", 0.75),
    ("proprietary", "reproduc reproduced part", r"no part of this (?:publication|book|document|work|site) may be reproduced", 0.75),
    ("proprietary", "internal only", r"for internal use only", 0.5),
    ("proprietary", "decompile", r"not (?:to )?decompile", 0.7),
    ("proprietary", "disassemble", r"not (?:to )?disassemble", 0.7),
    ("proprietary", "engineer reverse", r"not (?:to |attempt to )?reverse engineer", 0.7),
    ("proprietary", "personal commercial", r"for (?:your )?personal,? non-?commercial use", 0.6),
    ("reserved", "reserved rights", r"all rights reserved", 0.6),
    ("reserved", "rechte vorbehalten", r"alle rechte vorbehalten", 0.6),
    ("reserved", "droits serv", r"tous droits r[ée]serv[ée]s", 0.6),
    ("reserved", "derechos reservados", r"todos los derechos reservados", 0.6),
    ("reserved", "diritti riservati", r"tutti i diritti riservati", 0.6),
    ("copyright", "copyright", r"copyright(?: \(c\)| ©)? (?:[0-9]{4})(?:-[0-9]{4})?", 0.5),
    ("copyright", "(c)", r"\(c\) (?:copyright )?[0-9]{4}", 0.4),
    ("copyright", "©", r"© ?[0-9]{4}", 0.4),
    ("trademark", "trademark respective", r"(?:registered )?trademarks? of (?:its|their) respective (?:owner|holder)s?", 0.3),
    ("warranty-disclaimer", "provided as", r"(?:software|work|material) is provided [\"'(]*as is[\"')]*", 0.4),
    ("warranty-disclaimer", "warrant", r"without warrant(?:y|ies) (?:of any kind|or conditions)", 0.4),
    ("warranty-disclaimer", "warrant disclaim", r"disclaims? (?:all|any) (?:express or implied )?warrant(?:y|ies)", 0.4),
    ("warranty-disclaimer", "warrant merchantability", r"implied warrant(?:y|ies) of merchantability", 0.4),
    ("liability-disclaimer", "liab liable event", r"in no event (?:shall|will) .{1,80} be (?:held )?liable for any", 0.4),
    ("patent-grant", "patent grant licen", r"patent licen[sc]e (?:is )?grant(?:ed)?", 0.5),
    ("patent-grant", "patent licen", r"grants? .{1,40}patent licen[sc]e", 0.5),
    ("attribution", "credit appropriate", r"give appropriate credit", 0.5),
    ("attribution", "attribution required", r"attribution (?:is )?required", 0.5),
    ("notice", "licen ed", r"licen[sc]ed under", 0.3),
    ("notice", "licen", r"(?:released|distributed|available) under (?:the )?(?:terms of )?(?:the |an? )?[\w.\s-]{1,40}licen[sc]e", 0.35),
    ("notice", "license details see", r"see (?:the )?license(?:\.(?:txt|md))? (?:file )?for details", 0.3),
    ("notice", "license refer file", r"refer to (?:the )?license file", 0.3),
    ("notice", "license full", r"full (?:text of the )?license (?:text )?(?:can be|is) (?:found|available|included)", 0.3),
    ("eula", "licen agreement", r"end(?: |-)user licen[sc]e agreement", 0.7),
    ("terms", "terms of", r"\bterms of (?:use|service)\b", 0.3),
    ("contributor", "contributor agreement licen", r"contributor licen[sc]e agreement", 0.5),
]


#: The gates, sought in every text: each rule has one that all its matches hold. A text that holds none is looked at no further.
GATES = (
    "licen copyright distribut permission warrant software commons domain unicode apache gpl cc mit-0 .org .com .net .info .eu"
    " attribut creative clause eclipse mozilla cddl mpl- epl- afl- beer artistic publi propriet unauthori confidential commercial"
    " reserv vorbehalten droits riservati (c) © trademark liab government disclaim document exception machine-exec illinois consortium endorse regents"
    " later remotely linking perl fuck share invariant eupl cecill rail supplied evil secret written reproduc internal decompile"
    " disassemble engineer provided credit terms"
).split()


def _gate(words: list[str]) -> str:
    return next(g for g in GATES if any(g in w for w in words))


def _spaced(pattern: str) -> str:
    """A pattern with any white space for its blanks, and for the dot of a gap."""
    return pattern.replace(".{", r"[\s\S]{").replace(" ?", r"\s*").replace(" ", r"\s+")


def _worded(name: str) -> str:
    """A regex for a name, with any white space or comma between its words."""
    return r"[\s,]+".join(re.escape(w) for w in name.lower().replace(",", " ").split())


def _words(name: str) -> list[str]:
    return name.lower().replace(",", " ").split()


def rules() -> list[dict]:
    """All rules in order: priority, label, gate, words (lower case, part of every match), regex over lower-case text, score."""
    out: list[dict] = []

    def add(label: str, words: list[str], pattern: str, score: float) -> None:
        telling = sorted(set(words), key=lambda w: (-len(w), w))[:4]
        out.append({"priority": len(out), "label": label, "gate": _gate(words), "words": telling, "pattern": pattern, "score": score})

    for spdx, label, _, _ in LICENSES:
        add(label, ["spdx-license-identifier", spdx.lower()], rf"spdx-license-identifier:\s*{re.escape(spdx.lower())}(?:-only|-or-later|\+)?(?![\w.-])", 1.0)
    for _, label, names, _ in LICENSES:
        for name in names:
            add(label, _words(name), _spaced(r"(?:licen[sc]ed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?") + rf"{_worded(name)}(?![\w-])", 0.98)
    for label, words, pattern, score in NOTICES:
        add(label, words.split(), _spaced(pattern), score)
    for _, label, _, url in LICENSES:
        add(label, [url.lower()], rf"(?:www\.)?{re.escape(url.lower())}", 0.95)
    for _, label, names, _ in LICENSES:
        for name in names:
            add(label, _words(name), rf"(?<![\w-]){_worded(name)}(?![\w-])", 0.9)
    for spdx, label, _, _ in LICENSES:
        add(label, ["license", spdx.lower()], rf"license\W{{1,4}}{re.escape(spdx.lower())}(?![\w.-])", 0.85)
    return out
