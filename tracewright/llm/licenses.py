"""Operator 8, license scans: recognition by sentences and rules.

A text is cut into sentences; each is normalised (lower case, runs of anything but letters and digits become one space) and
looked up among known licence sentences, which gives a sequence of sentence identifiers in the order of the text. A licence
rule is an ordered list of identifiers; it matches where its identifiers appear in that order (others may stand
between). Rules are tried in order: a rule that another, longer one contains says nothing new and is dropped for it. All in
built-in expressions on the row itself: no shuffle, no Python.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import P, text_of

#: Known licence sentences (fixed values: sentences of public licence texts, headers and notices), by identifier.
SENTENCES = {
    "mit-title-2": "The MIT License (MIT)",
    "mit-notice": "Released under the MIT License",
    "mit-notice-2": "Licensed under the MIT License",
    "mit-notice-3": "This project is licensed under the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit-0-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "mit-condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "no-event": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    "isc-notice": "Licensed under the ISC License",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "isc-grant-2": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "isc-disclaimer": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS",
    "apache-title": "Apache License",
    "apache-version": "Version 2.0, January 2004",
    "apache-notice": "Licensed under the Apache License, Version 2.0",
    "apache-notice-2": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "apache-notice-3": "Released under the Apache License 2.0",
    "apache-asf": "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements",
    "apache-use": "you may not use this file except in compliance with the License",
    "apache-obtain": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-obtain-at": "You may obtain a copy of the License at",
    "apache-url": "http://www.apache.org/licenses/LICENSE-2.0",
    "apache-unless": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "apache-terms": "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "gpl-title": "GNU GENERAL PUBLIC LICENSE",
    "lgpl-title": "GNU LESSER GENERAL PUBLIC LICENSE",
    "lgpl-old-title": "GNU LIBRARY GENERAL PUBLIC LICENSE",
    "agpl-title": "GNU AFFERO GENERAL PUBLIC LICENSE",
    "fdl-title": "GNU Free Documentation License",
    "gpl2-version": "Version 2, June 1991",
    "gpl3-version": "Version 3, 29 June 2007",
    "lgpl21-version": "Version 2.1, February 1999",
    "agpl3-version": "Version 3, 19 November 2007",
    "fdl13-version": "Version 1.3, 3 November 2008",
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3",
    "gpl3-notice-2": "Licensed under the GNU General Public License v3.0",
    "gpl2-notice": "This work is licensed under the GNU General Public License, version 2",
    "gpl2-notice-2": "Licensed under the GNU General Public License v2.0",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl2-only-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "lgpl21-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "lgpl3-free": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "lgpl-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "lgpl3-notice": "Licensed under the GNU Lesser General Public License v3.0",
    "lgpl21-notice": "Licensed under the GNU Lesser General Public License v2.1",
    "agpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "agpl3-notice": "Licensed under the GNU Affero General Public License v3.0",
    "fsf-verbatim": "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-advertising": "All advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-endorse-2": "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED",
    "bsd2-notice": "Licensed under the BSD 2-Clause License",
    "bsd3-notice": "Licensed under the BSD 3-Clause License",
    "bsd3-notice-2": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
    "mpl-title": "Mozilla Public License Version 2.0",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    "mpl-copy-2": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    "mpl11-notice": "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\")",
    "epl1-title": "Eclipse Public License - v 1.0",
    "epl2-title": "Eclipse Public License - v 2.0",
    "epl-terms": "THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (\"AGREEMENT\")",
    "epl2-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "cddl-notice": "The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\")",
    "eupl-notice": "Licensed under the EUPL, Version 1.2",
    "eupl-notice-2": "Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL (the \"Licence\")",
    "bsl-title": "Boost Software License - Version 1.0 - August 17th, 2003",
    "bsl-notice": "Distributed under the Boost Software License, Version 1.0",
    "bsl-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "zlib-origin": "The origin of this software must not be misrepresented",
    "zlib-altered": "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software",
    "zlib-notice": "This notice may not be removed or altered from any source distribution",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "unlicense-free": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "public-domain": "This file is in the public domain",
    "public-domain-2": "This work has been released into the public domain",
    "wtfpl-title": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
    "wtfpl-verbatim": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed",
    "beerware": "As long as you retain this notice you can do whatever you want with this stuff",
    "artistic2-title": "The Artistic License 2.0",
    "artistic2-notice": "Licensed under the Artistic License 2.0",
    "perl-notice": "This is free software; you can redistribute it and/or modify it under the same terms as the Perl 5 programming language system itself",
    "psf-title": "PYTHON SOFTWARE FOUNDATION LICENSE VERSION 2",
    "psf-agreement": "This LICENSE AGREEMENT is between the Python Software Foundation (\"PSF\"), and the Individual or Organization (\"Licensee\") accessing and otherwise using this software (\"Python\") in source or binary form and its associated documentation",
    "postgresql-grant": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies",
    "hpnd-grant": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose and without fee is hereby granted, provided that the above copyright notice appear in all copies and that both that copyright notice and this permission notice appear in supporting documentation",
    "ofl-title": "SIL OPEN FONT LICENSE Version 1.1 - 26 February 2007",
    "ofl-notice": "This Font Software is licensed under the SIL Open Font License, Version 1.1",
    "cc0-title": "CC0 1.0 Universal",
    "cc0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "cc-by-notice": "Licensed under CC BY 4.0",
    "cc-by-notice-2": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-notice-3": "This work is licensed under the Creative Commons Attribution 4.0 International License",
    "cc-by3-notice": "This work is licensed under a Creative Commons Attribution 3.0 Unported License",
    "cc-by-sa-notice": "Licensed under CC BY-SA 4.0",
    "cc-by-sa-notice-2": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-sa3-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License",
    "cc-by-nc-notice": "Licensed under CC BY-NC 4.0",
    "cc-by-nc-notice-2": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "cc-by-nd-notice": "Licensed under CC BY-ND 4.0",
    "cc-by-nd-notice-2": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
    "cc-by-nc-sa-notice": "Licensed under CC BY-NC-SA 4.0",
    "cc-by-nc-sa-notice-2": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
    "cc-by-nc-nd-notice": "Licensed under CC BY-NC-ND 4.0",
    "cc-by-nc-nd-notice-2": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License",
}

#: Beginnings of sentences above that notices often quote alone; they have the same identifiers.
IN_SHORT = {
    "mit-grant": SENTENCES["mit-grant"].split(", including")[0],
    "as-is": SENTENCES["as-is"].split(", INCLUDING")[0],
}

#: Ordered rules: name, licence, whether it may be used commercially, identifiers in order. Longer rules of a licence stand before shorter ones.
RULES = (
    ("mit-text", "MIT", True, ("mit-grant", "mit-condition", "as-is")),
    ("mit-grant-only", "MIT", True, ("mit-grant",)),
    ("mit-title-2", "MIT", True, ("mit-title-2",)),
    ("mit-notice", "MIT", True, ("mit-notice",)),
    ("mit-notice-2", "MIT", True, ("mit-notice-2",)),
    ("mit-notice-3", "MIT", True, ("mit-notice-3",)),
    ("mit-0-text", "MIT-0", True, ("mit-0-grant", "as-is")),
    ("isc-text", "ISC", True, ("isc-grant", "isc-disclaimer")),
    ("isc-text-2", "ISC", True, ("isc-grant-2", "isc-disclaimer")),
    ("isc-grant-only", "ISC", True, ("isc-grant",)),
    ("isc-grant-only-2", "ISC", True, ("isc-grant-2",)),
    ("isc-notice", "ISC", True, ("isc-notice",)),
    ("0bsd-text", "0BSD", True, ("0bsd-grant", "isc-disclaimer")),
    ("apache-text", "Apache-2.0", True, ("apache-title", "apache-version", "apache-terms")),
    ("apache-header", "Apache-2.0", True, ("apache-notice-2", "apache-use", "apache-obtain")),
    ("apache-header-2", "Apache-2.0", True, ("apache-notice-2", "apache-use", "apache-obtain-at", "apache-url")),
    ("apache-asf-header", "Apache-2.0", True, ("apache-asf", "apache-use", "apache-obtain-at", "apache-url")),
    ("apache-title", "Apache-2.0", True, ("apache-title", "apache-version")),
    ("apache-notice", "Apache-2.0", True, ("apache-notice",)),
    ("apache-notice-2", "Apache-2.0", True, ("apache-notice-2",)),
    ("apache-notice-3", "Apache-2.0", True, ("apache-notice-3",)),
    ("gpl2-text", "GPL-2.0-only", True, ("gpl-title", "gpl2-version", "fsf-verbatim")),
    ("gpl2-only-header", "GPL-2.0-only", True, ("gpl2-only-free",)),
    ("gpl2-notice", "GPL-2.0-only", True, ("gpl2-notice",)),
    ("gpl2-notice-2", "GPL-2.0-only", True, ("gpl2-notice-2",)),
    ("gpl2-header", "GPL-2.0-or-later", True, ("gpl2-free", "gpl-hope")),
    ("gpl2-free", "GPL-2.0-or-later", True, ("gpl2-free",)),
    ("gpl3-text", "GPL-3.0-only", True, ("gpl-title", "gpl3-version", "fsf-verbatim")),
    ("gpl3-header", "GPL-3.0-or-later", True, ("gpl-free", "gpl-hope")),
    ("gpl3-free", "GPL-3.0-or-later", True, ("gpl-free",)),
    ("gpl3-notice", "GPL-3.0-only", True, ("gpl3-notice",)),
    ("gpl3-notice-2", "GPL-3.0-only", True, ("gpl3-notice-2",)),
    ("lgpl21-text", "LGPL-2.1-only", True, ("lgpl-title", "lgpl21-version", "fsf-verbatim")),
    ("lgpl21-notice", "LGPL-2.1-only", True, ("lgpl21-notice",)),
    ("lgpl21-header", "LGPL-2.1-or-later", True, ("lgpl21-free", "lgpl-hope")),
    ("lgpl21-free", "LGPL-2.1-or-later", True, ("lgpl21-free",)),
    ("lgpl2-text", "LGPL-2.0-only", True, ("lgpl-old-title", "gpl2-version", "fsf-verbatim")),
    ("lgpl3-text", "LGPL-3.0-only", True, ("lgpl-title", "gpl3-version", "fsf-verbatim")),
    ("lgpl3-notice", "LGPL-3.0-only", True, ("lgpl3-notice",)),
    ("lgpl3-header", "LGPL-3.0-or-later", True, ("lgpl3-free", "lgpl-hope")),
    ("lgpl3-free", "LGPL-3.0-or-later", True, ("lgpl3-free",)),
    ("agpl3-text", "AGPL-3.0-only", True, ("agpl-title", "agpl3-version", "fsf-verbatim")),
    ("agpl3-notice", "AGPL-3.0-only", True, ("agpl3-notice",)),
    ("agpl3-header", "AGPL-3.0-or-later", True, ("agpl3-free", "gpl-hope")),
    ("agpl3-free", "AGPL-3.0-or-later", True, ("agpl3-free",)),
    ("fdl13-text", "GFDL-1.3-only", True, ("fdl-title", "fdl13-version", "fsf-verbatim")),
    ("bsd4-text", "BSD-4-Clause", True, ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-endorse")),
    ("bsd4-uc-text", "BSD-4-Clause-UC", True, ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-endorse-2")),
    ("bsd3-text", "BSD-3-Clause", True, ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("bsd3-text-2", "BSD-3-Clause", True, ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse-2")),
    ("bsd3-notice", "BSD-3-Clause", True, ("bsd3-notice",)),
    ("bsd3-notice-2", "BSD-3-Clause", True, ("bsd3-notice-2",)),
    ("bsd2-text", "BSD-2-Clause", True, ("bsd-redistribution", "bsd-source", "bsd-binary")),
    ("bsd2-notice", "BSD-2-Clause", True, ("bsd2-notice",)),
    ("bsd1-text", "BSD-1-Clause", True, ("bsd-redistribution", "bsd-source", "bsd-disclaimer")),
    ("mpl-header", "MPL-2.0", True, ("mpl-notice", "mpl-copy")),
    ("mpl-header-2", "MPL-2.0", True, ("mpl-notice", "mpl-copy-2")),
    ("mpl-notice", "MPL-2.0", True, ("mpl-notice",)),
    ("mpl-title", "MPL-2.0", True, ("mpl-title",)),
    ("mpl11-notice", "MPL-1.1", True, ("mpl11-notice",)),
    ("epl1-text", "EPL-1.0", True, ("epl1-title", "epl-terms")),
    ("epl1-title", "EPL-1.0", True, ("epl1-title",)),
    ("epl2-text", "EPL-2.0", True, ("epl2-title", "epl-terms")),
    ("epl2-title", "EPL-2.0", True, ("epl2-title",)),
    ("epl2-notice", "EPL-2.0", True, ("epl2-notice",)),
    ("cddl-notice", "CDDL-1.0", True, ("cddl-notice",)),
    ("eupl-notice", "EUPL-1.2", True, ("eupl-notice",)),
    ("eupl-notice-2", "EUPL-1.2", True, ("eupl-notice-2",)),
    ("bsl-text", "BSL-1.0", True, ("bsl-title", "bsl-grant")),
    ("bsl-title", "BSL-1.0", True, ("bsl-title",)),
    ("bsl-grant-only", "BSL-1.0", True, ("bsl-grant",)),
    ("bsl-notice", "BSL-1.0", True, ("bsl-notice",)),
    ("zlib-text", "Zlib", True, ("zlib-as-is", "zlib-grant", "zlib-origin", "zlib-altered", "zlib-notice")),
    ("unlicense-text", "Unlicense", True, ("unlicense", "unlicense-free")),
    ("unlicense", "Unlicense", True, ("unlicense",)),
    ("public-domain", "public-domain", True, ("public-domain",)),
    ("public-domain-2", "public-domain", True, ("public-domain-2",)),
    ("wtfpl-text", "WTFPL", True, ("wtfpl-title", "wtfpl-verbatim")),
    ("wtfpl-title", "WTFPL", True, ("wtfpl-title",)),
    ("beerware", "Beerware", True, ("beerware",)),
    ("artistic2-title", "Artistic-2.0", True, ("artistic2-title",)),
    ("artistic2-notice", "Artistic-2.0", True, ("artistic2-notice",)),
    ("perl-notice", "Artistic-1.0-Perl OR GPL-1.0-or-later", True, ("perl-notice",)),
    ("psf-text", "Python-2.0", True, ("psf-title", "psf-agreement")),
    ("psf-title", "Python-2.0", True, ("psf-title",)),
    ("postgresql-text", "PostgreSQL", True, ("postgresql-grant",)),
    ("hpnd-text", "HPND", True, ("hpnd-grant",)),
    ("ofl-text", "OFL-1.1", True, ("ofl-notice", "ofl-title")),
    ("ofl-notice", "OFL-1.1", True, ("ofl-notice",)),
    ("ofl-title", "OFL-1.1", True, ("ofl-title",)),
    ("cc-by-nc-notice", "CC-BY-NC-4.0", False, ("cc-by-nc-notice",)),
    ("cc-by-nc-notice-2", "CC-BY-NC-4.0", False, ("cc-by-nc-notice-2",)),
    ("cc-by-nc-sa-notice", "CC-BY-NC-SA-4.0", False, ("cc-by-nc-sa-notice",)),
    ("cc-by-nc-sa-notice-2", "CC-BY-NC-SA-4.0", False, ("cc-by-nc-sa-notice-2",)),
    ("cc-by-nc-nd-notice", "CC-BY-NC-ND-4.0", False, ("cc-by-nc-nd-notice",)),
    ("cc-by-nc-nd-notice-2", "CC-BY-NC-ND-4.0", False, ("cc-by-nc-nd-notice-2",)),
    ("cc-by-notice", "CC-BY-4.0", True, ("cc-by-notice",)),
    ("cc-by-notice-2", "CC-BY-4.0", True, ("cc-by-notice-2",)),
    ("cc-by-notice-3", "CC-BY-4.0", True, ("cc-by-notice-3",)),
    ("cc-by3-notice", "CC-BY-3.0", True, ("cc-by3-notice",)),
    ("cc-by-sa-notice", "CC-BY-SA-4.0", True, ("cc-by-sa-notice",)),
    ("cc-by-sa-notice-2", "CC-BY-SA-4.0", True, ("cc-by-sa-notice-2",)),
    ("cc-by-sa3-notice", "CC-BY-SA-3.0", True, ("cc-by-sa3-notice",)),
    ("cc-by-nd-notice", "CC-BY-ND-4.0", True, ("cc-by-nd-notice",)),
    ("cc-by-nd-notice-2", "CC-BY-ND-4.0", True, ("cc-by-nd-notice-2",)),
    ("cc0-notice", "CC0-1.0", True, ("cc0-notice",)),
    ("cc0-title", "CC0-1.0", True, ("cc0-title",)),
)

#: A sentence ends at a line end (a known one may run over several lines), or at . ! ? ; and white space; a full stop inside a number ends none.
SENTENCE_END = r"\n|[.!?;]+(?=[\x20\x09-\x0D]|$)"

FOUND = "array<struct<rule:string,licence:string,commercial:boolean>>"


def plain(sentence: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip()


def parts_of(sentence: str) -> list[str]:
    """The sentence, or what it splits into, as at an inner 'v. 2.0' or a semicolon."""
    return [x for x in map(plain, re.split(SENTENCE_END, sentence)) if x]


def known(sentences: dict[str, str] = SENTENCES) -> dict[str, str]:
    """Identifiers by sentence. One that splits gives an identifier for each part: its own, then with .2, .3 and so on."""
    pairs = [*((i, s) for i, s in IN_SHORT.items() if i in sentences), *sentences.items()]
    return {part: i if k == 0 else f"{i}.{k + 1}" for i, s in pairs for k, part in enumerate(parts_of(s))}


def any_of(sentences: Iterable[str]) -> str:
    """A pattern for any of the sentences, whose words a space or a line end parts: what begins alike is tried once, and longer ones before those that they begin with."""
    tree: dict = {}
    for sentence in sentences:
        node = tree
        for word in sentence.split(" "):
            node = node.setdefault(word, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        ways = [word + (pattern(below) if below else "") for word, below in sorted(node.items()) if word]
        rest = "[ \n](?:" + "|".join(ways) + ")"
        return "" if not ways else f"(?:{rest})?" if "" in node else rest

    return "(?:" + pattern(tree).removeprefix("[ \n]") + ")"


def sequence(rule: tuple[str, ...], sentences: dict[str, str] = SENTENCES) -> list[str]:
    """The identifiers that a rule asks for, with those of all parts of its sentences."""
    table = known(sentences)
    return [table[part] for i in rule for part in parts_of(sentences[i])]


def contains(longer: list[str], shorter: list[str]) -> bool:
    """Whether the one sequence has the other in its order."""
    rest = iter(longer)
    return len(shorter) < len(longer) and all(i in rest for i in shorter)


def rule_table(sentences: dict[str, str] = SENTENCES, rules=RULES) -> Column:
    """The rules as an array: number, names, sequence, and the numbers of the rules that contain it."""
    told = [(name, licence, commercial, sequence(rule, sentences)) for name, licence, commercial, rule in rules]
    texts = lambda values: F.array(*map(F.lit, values)).cast("array<string>")
    rows = []
    for k, (name, licence, commercial, seq) in enumerate(told):
        wider = [j for j, (_, _, _, other) in enumerate(told) if contains(other, seq)]
        rows.append(F.struct(
            F.lit(k).alias("k"), F.lit(name).alias("rule"), F.lit(licence).alias("licence"), F.lit(commercial).alias("commercial"), texts(seq).alias("seq"), F.array(*map(F.lit, wider)).cast("array<int>").alias("wider"),
        ))
    return F.array(*rows)


def in_order(ids: Column, seq: Column) -> Column:
    """Whether the identifiers of seq stand in ids in that order: each is looked for after the one before."""

    def step(at: Column, i: Column) -> Column:
        there = F.array_position(F.slice(ids, at + 1, F.size(ids)), i).cast("int")
        return F.when((at >= 0) & (there > 0), at + there).otherwise(-1)

    return F.aggregate(seq, F.lit(0), step) >= 0


def licences(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules=RULES) -> DataFrame:
    """One row for each row of docs: doc_id, sentence_ids, rules, licences (arrays), n_sentences, licence (the first rule's, or null), commercial (whether all found allow that; null without any).

    sentence_ids keeps the text's order and its repeats; rules the order of `rules`; licences are distinct, in rule order. A null or
    empty text has 0 sentences and no licence. Whole texts are scanned, however long. Repeated rows, ties and null doc_ids are scanned
    each for itself. Only doc_id and text are read. An empty table gives an empty result.
    """
    table = known(sentences)
    wanted = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    n_sentences = F.size(F.filter(F.split(text_of(docs), SENTENCE_END), lambda s: s.rlike("[A-Za-z0-9]"))).cast("long")
    # the text as words parted by spaces, by single line ends, or by X where a sentence or a paragraph ends: each step is linear
    ended = F.regexp_replace(F.lower(text_of(docs)), SENTENCE_END.removeprefix(r"\n|"), "\n\n")
    lines = F.regexp_replace(F.regexp_replace(ended, "[^a-z0-9\n]+", " "), " ?\n ?", "\n")
    marked = F.concat(F.lit("X"), F.trim(F.regexp_replace(lines, "\n\n+", "X")), F.lit("X"))
    # whole lines or sentences, the longest first: a known sentence may be wrapped, but begins and ends where a line does
    hits = F.regexp_extract_all(marked, F.lit(f"[X\n]({any_of(table)})(?=[X\n])"), F.lit(1))
    found = docs.select("doc_id", n_sentences.alias("n_sentences"), hits.alias(f"{P}hits"))
    ids = found.withColumn("sentence_ids", F.transform(f"{P}hits", lambda s: F.element_at(wanted, F.translate(s, "\n", " "))))
    none = F.array().cast(FOUND)
    matching = F.when(F.size("sentence_ids") > 0, F.filter(rule_table(sentences, rules), lambda r: in_order(F.col("sentence_ids"), r["seq"])))
    matched = ids.withColumn(f"{P}matching", matching)
    alone = F.filter(f"{P}matching", lambda r: ~F.exists(f"{P}matching", lambda w: F.array_contains(r["wider"], w["k"])))
    said = matched.withColumn(f"{P}said", F.coalesce(F.transform(alone, lambda r: F.struct(r["rule"].alias("rule"), r["licence"].alias("licence"), r["commercial"].alias("commercial"))), none))
    names = lambda field: F.transform(f"{P}said", lambda x: x[field])
    return said.select(
        "doc_id", "n_sentences", "sentence_ids", names("rule").alias("rules"), F.array_distinct(names("licence")).alias("licences"),
        F.get(names("licence"), 0).alias("licence"), F.when(F.size(f"{P}said") > 0, F.forall(names("commercial"), lambda c: c)).alias("commercial"),
    )
