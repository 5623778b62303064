"""Signatures of single licences for the scan of operator 5: sentences, headers, addresses and file names, each by hand.

Patterns are over lower-case words that stand one space apart. The keyword is a literal of every match of its pattern.
"""

from __future__ import annotations

# Label, priority, score, keyword, pattern.
SIGNATURES = [
    # Sentences of the licences' own texts.
    ("mit", 85, 1.0, "permission is hereby", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", 84, 0.95, "permission notice", r"the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions of the software"),
    ("mit", 60, 0.8, "as is", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("mit-0", 86, 1.0, "to deal in the software", r"to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided"),
    ("x11-distribute", 87, 1.0, "shall not be used in advertising", r"the name of .{1,80} shall not be used in advertising or otherwise to promote the sale use or other dealings in this software"),
    ("hpnd", 86, 0.95, "permission to use", r"permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted"),
    ("bsd", 75, 0.8, "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", 74, 0.8, "binary form must reproduce", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", 74, 0.8, "source code must retain", r"redistributions of source code must retain the above copyright notice"),
    ("bsd-3-clause", 85, 0.95, "neither the name", r"neither the name of .{1,120} nor the names of (?:its|their|any) contributors may be used to endorse or promote products"),
    ("bsd-3-clause", 84, 0.9, "name of the author", r"the name of the author may not be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", 88, 1.0, "advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-3-clause-clear", 88, 1.0, "no express or implied", r"no express or implied licen[cs]es to any party s patent rights are granted by this licen[cs]e"),
    ("isc", 85, 0.95, "with or without fee", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("0bsd", 86, 1.0, "with or without fee", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("zlib", 85, 1.0, "origin of this software", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", 84, 0.95, "altered source", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("libpng-2", 86, 0.95, "png", r"the contributing authors and .{0,30}supply the png reference library as is"),
    ("boost-1", 85, 1.0, "machine executable", r"machine executable object code generated by a source language processor"),
    ("boost-1", 84, 0.95, "obtaining a copy of the software", r"permission is hereby granted free of charge to any person or organi[sz]ation obtaining a copy of the software and accompanying documentation"),
    ("apache-2", 86, 1.0, "except in compliance with the license", r"you may not use this file except in compliance with the license"),
    ("apache-2", 85, 1.0, "contributor hereby grants", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright licen[cs]e"),
    ("apache-2", 84, 0.9, "as is", r"distributed under the license is distributed on an as is basis without warranties or conditions of any kind"),
    ("apache-1.1", 86, 1.0, "apache software foundation", r"this product includes software developed by the apache software foundation"),
    ("apache-1.0", 87, 0.95, "apache group", r"this product includes software developed by the apache group"),
    ("gpl", 70, 0.85, "general public", r"you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e"),
    ("gpl-2-or-later", 88, 1.0, "general public", r"gnu general public licen[cs]e as published by the free software foundation either version 2 of the licen[cs]e or at your option any later version"),
    ("gpl-3-or-later", 88, 1.0, "general public", r"gnu general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e or at your option any later version"),
    ("gpl-1-or-later", 88, 1.0, "general public", r"gnu general public licen[cs]e as published by the free software foundation either version 1 or at your option any later version"),
    ("gpl-2-only", 87, 1.0, "general public", r"gnu general public licen[cs]e version 2 (?:only )?as published by the free software foundation"),
    ("gpl-3-only", 87, 1.0, "general public", r"gnu general public licen[cs]e version 3 (?:only )?as published by the free software foundation"),
    ("gpl-2-or-later", 86, 1.0, "general public", r"gnu general public licen[cs]e .{0,80}either version 2 of the licen[cs]e or .{0,20}any later version"),
    ("gpl-3-or-later", 86, 1.0, "general public", r"gnu general public licen[cs]e .{0,80}either version 3 of the licen[cs]e or .{0,20}any later version"),
    ("gpl", 68, 0.8, "general public", r"you should have received a copy of the gnu general public licen[cs]e along with this program"),
    ("gpl", 66, 0.8, "freedom to share", r"the licen[cs]es for most software are designed to take away your freedom to share and change it"),
    ("gpl-3", 72, 0.9, "copyleft", r"the gnu general public licen[cs]e is a free copyleft licen[cs]e for software and other kinds of works"),
    ("lgpl", 71, 0.85, "general public", r"you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e"),
    ("lgpl-2.1-or-later", 89, 1.0, "lesser general public", r"gnu lesser general public licen[cs]e as published by the free software foundation either version 2 1 of the licen[cs]e or at your option any later version"),
    ("lgpl-3-or-later", 89, 1.0, "lesser general public", r"gnu lesser general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e or at your option any later version"),
    ("lgpl-2-or-later", 89, 1.0, "library general public", r"gnu library general public licen[cs]e as published by the free software foundation either version 2 of the licen[cs]e or at your option any later version"),
    ("lgpl", 67, 0.8, "library", r"you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e along with this library"),
    ("agpl-3-or-later", 89, 1.0, "affero", r"gnu affero general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e or at your option any later version"),
    ("agpl-3", 85, 0.95, "remote network interaction", r"remote network interaction use with the gnu general public licen[cs]e"),
    ("gpl-classpath", 90, 1.0, "as a special exception", r"as a special exception the copyright holders of this library give you permission to link this library with independent modules"),
    ("gpl-gcc-exception", 90, 0.95, "runtime library exception", r"gcc runtime library exception"),
    ("gpl-font-exception", 90, 0.95, "embeds this font", r"if you create a document which (?:uses|embeds) this font .{0,40}embeds this font"),
    ("gfdl", 86, 1.0, "free documentation", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e"),
    ("gfdl-no-invariants", 87, 1.0, "no invariant sections", r"with no invariant sections no front cover texts and no back cover texts"),
    ("mpl-2", 88, 1.0, "source code form is subject", r"this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0"),
    ("mpl-2", 86, 0.95, "mpl was not distributed", r"if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-2-no-copyleft", 89, 1.0, "incompatible with secondary", r"this source code form is incompatible with secondary licen[cs]es as defined by the mozilla public licen[cs]e"),
    ("mpl-1.1", 88, 1.0, "mozilla public", r"the contents of this file are subject to the mozilla public licen[cs]e version 1 1"),
    ("mpl-1.0", 88, 1.0, "mozilla public", r"the contents of this file are subject to the mozilla public licen[cs]e version 1 0"),
    ("npl-1.1", 88, 1.0, "netscape public", r"the contents of this file are subject to the netscape public licen[cs]e version 1 1"),
    ("mpl-1.1 or gpl-2 or lgpl-2.1", 91, 1.0, "alternatively the contents", r"alternatively the contents of this file may be used under the terms of either the gnu general public licen[cs]e"),
    ("epl-1", 86, 1.0, "eclipse public", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e v1 0"),
    ("epl-2", 86, 1.0, "eclipse public", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e (?:v |version )?2 0"),
    ("edl-1", 86, 0.95, "eclipse distribution", r"eclipse distribution licen[cs]e (?:v |version )?1 0"),
    ("cpl-1", 86, 1.0, "common public", r"this program and the accompanying materials are made available under the terms of the common public licen[cs]e"),
    ("ipl-1", 84, 0.9, "ibm public", r"ibm public licen[cs]e (?:v |version )?1 0"),
    ("cddl-1", 86, 1.0, "common development", r"the contents of this file are subject to the terms of the common development and distribution licen[cs]e"),
    ("cddl-1.1 or gpl-2-classpath", 90, 1.0, "common development", r"either the gnu general public licen[cs]e version 2 only .{0,20}or the common development and distribution licen[cs]e"),
    ("artistic-2", 86, 0.95, "standard version", r"you may distribute verbatim copies of the source form of the standard version of this package"),
    ("artistic-1", 85, 0.95, "artistic control", r"the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control"),
    ("perl", 85, 0.95, "perl itself", r"(?:under the same terms as|the same terms as) perl itself"),
    ("python-2", 85, 0.95, "psf", r"this licen[cs]e agreement is between the python software foundation psf"),
    ("php-3.01", 85, 0.95, "php", r"this product includes php software freely available from"),
    ("ruby", 84, 0.9, "ruby", r"(?:under the same terms as|the same licen[cs]e as) ruby\b"),
    ("openssl", 86, 1.0, "openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", 86, 1.0, "eric young", r"this product includes cryptographic software written by eric young"),
    ("curl", 80, 0.8, "with or without fee", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("ntp", 84, 0.9, "appears in all copies", r"hereby granted provided that the above copyright notice appears in all copies and that both the copyright notice and this permission notice appear in supporting documentation"),
    ("postgresql", 86, 0.95, "without a written agreement", r"without fee and without a written agreement is hereby granted provided that the above copyright notice and this paragraph"),
    ("unlicense", 85, 1.0, "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", 84, 0.95, "in jurisdictions that recognize", r"in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest"),
    ("cc0-1", 86, 1.0, "waived all copyright", r"(?:has|have) waived all copyright and related or neighboring rights to"),
    ("cc0-1", 85, 0.95, "affirmer", r"affirmer hereby overtly fully permanently irrevocably and unconditionally waives"),
    ("wtfpl", 85, 1.0, "want to", r"you just do what the fuck you want to"),
    ("beerware", 85, 0.95, "beer", r"the beer ?ware licen[cs]e"),
    ("beerware", 84, 0.95, "buy me a beer", r"if we meet some day and you think this stuff is worth it you can buy me a beer in return"),
    ("json", 86, 1.0, "good not evil", r"the software shall be used for good not evil"),
    ("fsfap", 85, 0.95, "in any medium without royalty", r"copying and distribution of this file with or without modification are permitted in any medium without royalty"),
    ("fsful", 85, 0.95, "configure script", r"this configure script is free software the free software foundation gives unlimited permission to copy distribute and modify it"),
    ("ofl-1.1", 86, 1.0, "font software", r"this font software is licen[cs]ed under the sil open font licen[cs]e version 1 1"),
    ("ofl-1.1", 85, 0.95, "font software", r"neither the font software nor any of its individual components in original or modified versions may be sold by itself"),
    ("bitstream-vera", 86, 0.95, "bitstream vera", r"bitstream vera is a trademark of bitstream inc"),
    ("ms-pl", 84, 0.9, "microsoft public", r"this licen[cs]e governs use of the accompanying software .{0,200}microsoft public licen[cs]e"),
    ("eupl-1.2", 86, 1.0, "eupl", r"licen[cs]ed under the eupl version 1 2 or as soon they will be approved by the european commission"),
    ("eupl-1.1", 86, 1.0, "eupl", r"licen[cs]ed under the eupl version 1 1 or as soon they will be approved by the european commission"),
    ("cecill-2.1", 84, 0.9, "cecill", r"ce(?: logiciel|tte bibliotheque) est regi par la licence cecill"),
    ("cecill-b", 85, 0.95, "cecill b", r"governed by the cecill b licen[cs]e"),
    ("cecill-c", 85, 0.95, "cecill c", r"governed by the cecill c licen[cs]e"),
    ("oracle-bcl", 84, 0.9, "binary code", r"oracle binary code licen[cs]e agreement"),
    ("sspl-1", 86, 1.0, "server side public", r"the terms of the server side public licen[cs]e version 1 as published by mongodb"),
    ("busl-1.1", 86, 0.95, "additional use grant", r"licensor .{1,80} licensed work .{1,160} additional use grant"),
    ("commons-clause", 90, 1.0, "commons clause", r"commons clause (?:licen[cs]e )?condition"),
    ("elastic-2", 85, 0.95, "hosted or managed service", r"you may not provide the software to third parties as a hosted or managed service"),
    ("polyform-noncommercial-1", 85, 0.95, "polyform", r"polyform noncommercial licen[cs]e (?:version )?1 0 0"),
    ("polyform-small-business-1", 85, 0.95, "polyform", r"polyform small business licen[cs]e (?:version )?1 0 0"),
    ("hippocratic-2.1", 85, 0.95, "hippocratic", r"hippocratic licen[cs]e (?:version )?2 1"),
    ("openrail", 85, 0.95, "use based restrictions", r"use based restrictions .{0,80}attachment a"),
    ("llama-2", 86, 1.0, "llama 2", r"llama 2 community licen[cs]e agreement"),
    ("llama-3", 86, 1.0, "llama 3", r"llama 3(?: [123])? community licen[cs]e agreement"),
    ("gemma", 85, 0.95, "gemma", r"gemma terms of use"),
    # Addresses of licence texts.
    ("apache-2", 82, 0.95, "apache org", r"www apache org licenses license 2 0"),
    ("gpl", 64, 0.7, "gnu org", r"www gnu org licenses gpl\b"),
    ("gpl-2", 82, 0.9, "gnu org", r"www gnu org licenses (?:old licenses )?gpl 2 0"),
    ("gpl-3", 82, 0.9, "gnu org", r"www gnu org licenses gpl 3 0"),
    ("lgpl", 64, 0.7, "gnu org", r"www gnu org licenses lgpl\b"),
    ("lgpl-2.1", 82, 0.9, "gnu org", r"www gnu org licenses (?:old licenses )?lgpl 2 1"),
    ("lgpl-3", 82, 0.9, "gnu org", r"www gnu org licenses lgpl 3 0"),
    ("agpl-3", 82, 0.9, "gnu org", r"www gnu org licenses agpl 3 0"),
    ("gfdl", 82, 0.9, "gnu org", r"www gnu org licenses fdl"),
    ("mpl-2", 82, 0.9, "mozilla org", r"mozilla org mpl 2 0"),
    ("mpl-1.1", 82, 0.9, "mozilla org", r"www mozilla org mpl mpl 1 1"),
    ("epl-1", 82, 0.9, "eclipse org", r"www eclipse org legal epl v10"),
    ("epl-2", 82, 0.9, "eclipse org", r"www eclipse org legal epl (?:v20|2 0)"),
    ("boost-1", 82, 0.9, "boost org", r"www boost org license 1 0"),
    ("unlicense", 82, 0.9, "unlicense org", r"unlicense org\b"),
    ("mit", 82, 0.95, "opensource org", r"opensource org licenses? mit\b"),
    ("bsd-2-clause", 82, 0.95, "opensource org", r"opensource org licenses? bsd 2 clause"),
    ("bsd-3-clause", 82, 0.95, "opensource org", r"opensource org licenses? bsd 3 clause"),
    ("isc", 82, 0.95, "opensource org", r"opensource org licenses? isc\b"),
    ("apache-2", 82, 0.95, "opensource org", r"opensource org licenses? apache 2 0"),
    ("artistic-2", 82, 0.9, "opensource org", r"opensource org licenses? artistic (?:license )?2 0"),
    ("ms-pl", 82, 0.9, "opensource org", r"opensource org licenses? ms pl"),
    ("cc-by", 80, 0.95, "creativecommons org", r"creativecommons org licenses by [1-4] [05]"),
    ("cc-by-sa", 80, 0.95, "creativecommons org", r"creativecommons org licenses by sa [1-4] [05]"),
    ("cc-by-nd", 80, 0.95, "creativecommons org", r"creativecommons org licenses by nd [1-4] [05]"),
    ("cc-by-nc", 80, 0.95, "creativecommons org", r"creativecommons org licenses by nc [1-4] [05]"),
    ("cc-by-nc-sa", 80, 0.95, "creativecommons org", r"creativecommons org licenses by nc sa [1-4] [05]"),
    ("cc-by-nc-nd", 80, 0.95, "creativecommons org", r"creativecommons org licenses by nc nd [1-4] [05]"),
    ("cc0-1", 80, 0.95, "creativecommons org", r"creativecommons org publicdomain zero 1 0"),
    ("public-domain-mark", 80, 0.9, "creativecommons org", r"creativecommons org publicdomain mark 1 0"),
    ("odbl-1", 80, 0.95, "opendatacommons org", r"opendatacommons org licenses odbl"),
    ("ogl-uk-3", 80, 0.9, "open government", r"open government licen[cs]e v?(?:ersion )?3 0"),
    ("etalab-2", 80, 0.9, "etalab", r"(?:licence ouverte|open licen[cs]e) etalab (?:version )?2 0"),
    # Declarations in files of packages.
    ("mit", 78, 0.95, "osi approved", r"licen[cs]e osi approved mit licen[cs]e"),
    ("apache-2", 78, 0.9, "osi approved", r"licen[cs]e osi approved apache software licen[cs]e"),
    ("bsd", 78, 0.9, "osi approved", r"licen[cs]e osi approved bsd licen[cs]e"),
    ("gpl-3", 78, 0.95, "osi approved", r"licen[cs]e osi approved gnu general public licen[cs]e v3 gplv3"),
    ("gpl-2", 78, 0.95, "osi approved", r"licen[cs]e osi approved gnu general public licen[cs]e v2 gplv2"),
    ("mpl-2", 78, 0.95, "osi approved", r"licen[cs]e osi approved mozilla public licen[cs]e 2 0"),
    ("isc", 78, 0.95, "osi approved", r"licen[cs]e osi approved isc licen[cs]e"),
    ("psf", 78, 0.9, "osi approved", r"licen[cs]e osi approved python software foundation licen[cs]e"),
    ("proprietary", 78, 0.9, "other proprietary", r"licen[cs]e other proprietary licen[cs]e"),
    ("spdx-mit", 93, 1.0, "spdx", r"spdx licen[cs]e identifier mit\b(?! 0)"),
    ("spdx-apache-2", 93, 1.0, "spdx", r"spdx licen[cs]e identifier apache 2 0\b"),
    ("spdx-gpl-2-only", 92, 1.0, "spdx", r"spdx licen[cs]e identifier gpl 2 0(?: only)?\b"),
    ("spdx-gpl-2-or-later", 93, 1.0, "spdx", r"spdx licen[cs]e identifier gpl 2 0 or later\b"),
    ("spdx-gpl-3-only", 92, 1.0, "spdx", r"spdx licen[cs]e identifier gpl 3 0(?: only)?\b"),
    ("spdx-gpl-3-or-later", 93, 1.0, "spdx", r"spdx licen[cs]e identifier gpl 3 0 or later\b"),
    ("spdx-lgpl-2.1", 92, 1.0, "spdx", r"spdx licen[cs]e identifier lgpl 2 1\b"),
    ("spdx-bsd-3-clause", 93, 1.0, "spdx", r"spdx licen[cs]e identifier bsd 3 clause\b"),
    ("spdx-bsd-2-clause", 93, 1.0, "spdx", r"spdx licen[cs]e identifier bsd 2 clause\b"),
    ("spdx-mpl-2", 93, 1.0, "spdx", r"spdx licen[cs]e identifier mpl 2 0\b"),
    ("spdx-isc", 93, 1.0, "spdx", r"spdx licen[cs]e identifier isc\b"),
    ("spdx-cc0-1", 93, 1.0, "spdx", r"spdx licen[cs]e identifier cc0 1 0\b"),
    ("spdx-other", 80, 0.9, "spdx", r"spdx licen[cs]e identifier [a-z0-9]+\b"),
    # Notices that name no licence.
    ("public-domain", 45, 0.7, "public domain", r"(?:released|dedicated|placed|is) (?:in|into|to) the public domain"),
    ("proprietary", 45, 0.7, "all rights reserved", r"all rights reserved"),
    ("proprietary", 65, 0.8, "confidential", r"proprietary and confidential"),
    ("proprietary", 66, 0.85, "unauthori", r"unauthori[sz]ed (?:copying|reproduction|distribution|use) of this (?:file|work|material|document|publication) .{0,60}is strictly prohibited"),
    ("proprietary", 64, 0.8, "without the prior written", r"may (?:not )?be (?:reproduced|copied|distributed|transmitted) .{0,120}without the prior written (?:permission|consent) of"),
    ("non-commercial", 46, 0.7, "commercial", r"for (?:personal(?: and| or)? )?non ?commercial use only"),
    ("no-derivatives", 46, 0.6, "may not", r"you may not (?:alter|transform|build upon) (?:or (?:alter|transform|build upon) )?this work"),
    ("permission-required", 46, 0.6, "with permission", r"(?:used|reprinted|reproduced) with permission"),
    ("notice", 10, 0.3, "copyright", r"copyright (?:c |\xa9 )?(?:19|20)[0-9]{2}\b"),
]
