"""License scans: ordered signature rules behind a keyword gate, in DataFrame functions only."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases of the base count and their labels (fixed values).
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Licence names as words, their label, and versions that are written after them.
FAMILIES = [
    ("gnu affero general public licen[cs]e", "agpl", "3"), ("affero general public licen[cs]e", "agpl", "3"), ("agpl", "agpl", "3"),
    ("gnu lesser general public licen[cs]e", "lgpl", "2 2.1 3"), ("gnu library general public licen[cs]e", "lgpl", "2"), ("lgpl", "lgpl", "2 2.1 3"),
    ("gnu general public licen[cs]e", "gpl", "1 2 3"), ("gnu gpl", "gpl", "1 2 3"), ("gpl", "gpl", "1 2 3"), ("gnu free documentation licen[cs]e", "gfdl", "1.1 1.2 1.3"),
    ("apache licen[cs]e", "apache", "1.0 1.1 2.0"), ("apache software licen[cs]e", "apache", "1.1 2.0"), ("mit licen[cs]e", "mit", ""), ("expat licen[cs]e", "mit", ""), ("x11 licen[cs]e", "x11", ""),
    ("isc licen[cs]e", "isc", ""), ("bsd licen[cs]e", "bsd", ""), ("(?:two|2) clause bsd", "bsd-2-clause", ""), ("(?:three|3) clause bsd", "bsd-3-clause", ""), ("(?:four|4) clause bsd", "bsd-4-clause", ""),
    ("mozilla public licen[cs]e", "mpl", "1.0 1.1 2.0"), ("eclipse public licen[cs]e", "epl", "1.0 2.0"), ("eclipse distribution licen[cs]e", "edl", "1.0"),
    ("common development and distribution licen[cs]e", "cddl", "1.0 1.1"), ("common public licen[cs]e", "cpl", "1.0"), ("common public attribution licen[cs]e", "cpal", "1.0"),
    ("artistic licen[cs]e", "artistic", "1.0 2.0"), ("boost software licen[cs]e", "boost", "1.0"), ("zlib licen[cs]e", "zlib", ""), ("libpng licen[cs]e", "libpng", "2.0"),
    ("academic free licen[cs]e", "afl", "1.1 2.0 2.1 3.0"), ("open software licen[cs]e", "osl", "1.0 2.0 2.1 3.0"), ("european union public licen[cs]e", "eupl", "1.0 1.1 1.2"),
    ("python software foundation licen[cs]e", "psf", "2"), ("php licen[cs]e", "php", "3.0 3.01"), ("ruby licen[cs]e", "ruby", ""), ("perl licen[cs]e", "perl", ""), ("postgresql licen[cs]e", "postgresql", ""),
    ("university of illinois ncsa open source licen[cs]e", "ncsa", ""), ("microsoft public licen[cs]e", "ms-pl", ""), ("microsoft reciprocal licen[cs]e", "ms-rl", ""), ("open database licen[cs]e", "odbl", "1.0"),
    ("open data commons attribution licen[cs]e", "odc-by", "1.0"), ("public domain dedication and licen[cs]e", "pddl", "1.0"), ("sil open font licen[cs]e", "ofl", "1.0 1.1"), ("unlicen[cs]e", "unlicense", ""),
    ("do what the fuck you want to public licen[cs]e", "wtfpl", "1 2"), ("beerware licen[cs]e", "beerware", ""), ("educational community licen[cs]e", "ecl", "1.0 2.0"), ("server side public licen[cs]e", "sspl", "1"),
    ("business source licen[cs]e", "busl", "1.1"), ("elastic licen[cs]e", "elastic", "2.0"), ("q public licen[cs]e", "qpl", "1.0"), ("sleepycat licen[cs]e", "sleepycat", ""), ("vim licen[cs]e", "vim", ""), ("w3c licen[cs]e", "w3c", ""),
    ("cc by", "cc-by", "2.0 2.5 3.0 4.0"), ("cc by sa", "cc-by-sa", "2.0 2.5 3.0 4.0"), ("cc by nc", "cc-by-nc", "2.0 2.5 3.0 4.0"), ("cc by nd", "cc-by-nd", "2.0 2.5 3.0 4.0"), ("cc by nc sa", "cc-by-nc-sa", "2.0 2.5 3.0 4.0"),
    ("cc by nc nd", "cc-by-nc-nd", "2.0 2.5 3.0 4.0"), ("cc0", "cc0", "1.0"), ("creative commons zero", "cc0", "1.0"), ("creative commons attribution", "cc-by", "2.0 2.5 3.0 4.0"),
    ("creative commons attribution share ?alike", "cc-by-sa", "2.0 2.5 3.0 4.0"), ("creative commons attribution non ?commercial", "cc-by-nc", "2.0 2.5 3.0 4.0"),
]

#: Signatures without a name of their own: pattern, keyword, label, confidence.
PHRASES = [
    ("all rights reserved", "rights reserved", "all-rights-reserved", 0.6), ("(?:released|dedicated|placed|put) (?:in|into|to) the public domain", "public domain", "public-domain", 0.9),
    ("public domain", "public domain", "public-domain", 0.4), ("copyright (?:c )?(?:19|20)[0-9]{2}", "copyright", "copyright", 0.5), ("proprietary (?:and confidential|licen[cs]e|software)", "proprietary", "proprietary", 0.7),
    ("no warrant(?:y|ies)", "warrant", "no-warranty", 0.3), ("as is without warranty of any kind", "warranty", "no-warranty", 0.5), ("terms of (?:use|service)", "terms of", "terms", 0.3), ("or any later version", "later version", "or-later", 0.4),
]

#: Sentences of licence texts, by label: (pattern, keyword). G, a grant; C, a condition; D, a disclaimer; N, a notice that points to the licence. Each tells its family alone.
SIGNATURES = {
    "mit": [
        ("G", "permission is hereby granted free of charge to any person obtaining a copy(?: of this software and associated documentation files)?", "hereby granted"),
        ("G", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish", "without restriction"),
        ("C", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "permission notice"),
        ("D", "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise", "copyright holders"),
        ("N", "(?:this (?:software|project|library|code) is )?(?:distributed|released|made available|licen[cs]ed) under the terms of the mit licen[cs]e", "mit licen"),
        ("N", "use of this source code is governed by an mit style licen[cs]e", "style licen"),
    ],
    "isc": [
        ("G", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "hereby granted"),
        ("D", "the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness", "disclaims all warrant"),
        ("D", "in no event shall the author be liable for any special direct indirect or consequential damages", "consequential damages"),
    ],
    "bsd": [
        ("G", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution"),
        ("C", "redistributions of source code must retain the (?:above )?copyright notice", "redistributions of source"),
        ("C", "redistributions in binary form must reproduce the (?:above )?copyright notice", "redistributions in binary"),
        ("D", "this software is provided by the (?:copyright holders|regents|authors?) and contributors as is and any express or implied warranties", "contributors as is"),
        ("N", "use of this source code is governed by a bsd style licen[cs]e", "style licen"),
    ],
    "bsd-3-clause": [
        ("C", "neither the name of (?:the )?(?:[^ ]+ ){1,8}nor the names of its contributors may be used to endorse or promote products", "endorse or promote"),
        ("C", "may be used to endorse or promote products derived from this software without specific prior written permission", "endorse or promote"),
    ],
    "bsd-4-clause": [("C", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment", "advertising materials")],
    "gpl": [
        ("G", "this (?:program|library|software|file) is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e", "free software"),
        ("N", "you should have received a copy of the gnu general public licen[cs]e along with this", "received a copy"),
        ("D", "this program is distributed in the hope that it will be useful but without any warranty", "hope that it will be useful"),
        ("C", "you must cause any work that you distribute or publish that in whole or in part contains or is derived from the program", "derived from the program"),
        ("C", "everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document but changing it is not allowed", "verbatim copies"),
        ("C", "the licen[cs]es for most software are designed to take away your freedom to share and change it", "freedom to share"),
        ("C", "you may not copy modify sublicen[cs]e or distribute the program except as expressly provided under this licen[cs]e", "expressly provided"),
    ],
    "gpl-2": [("N", "either version 2 of the licen[cs]e or at your option any later version", "at your option"), ("N", "as published by the free software foundation version 2", "software foundation")],
    "gpl-3": [
        ("N", "either version 3 of the licen[cs]e or at your option any later version", "at your option"),
        ("C", "to propagate a work means to do anything with it that without permission would make you directly or secondarily liable", "to propagate a work"),
        ("C", "the corresponding source for a work in object code form means all the source code needed to generate install", "corresponding source"),
        ("C", "no covered work shall be deemed part of an effective technological measure", "covered work"),
    ],
    "lgpl": [
        ("G", "you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e", "general public licen"),
        ("N", "you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e along with this", "received a copy"),
        ("C", "a program that contains no derivative of any portion of the library but is designed to work with the library", "portion of the library"),
        ("C", "the combined work is a work produced by combining or linking an application with the library", "combined work"),
    ],
    "agpl": [
        ("G", "you can redistribute it and or modify it under the terms of the gnu affero general public licen[cs]e", "affero"),
        ("N", "you should have received a copy of the gnu affero general public licen[cs]e along with this", "affero"),
        ("C", "your modified version must prominently offer all users interacting with it remotely through a computer network", "interacting with it remotely"),
    ],
    "gfdl": [("G", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e", "free documentation"), ("C", "with no invariant sections no front cover texts and no back cover texts", "invariant sections")],
    "apache-2.0": [
        ("G", "licen[cs]ed under the apache licen[cs]e version 2 0 the licen[cs]e you may not use this file except in compliance with the licen[cs]e", "in compliance with the licen"),
        ("N", "you may obtain a copy of the licen[cs]e at (?:https? )?www apache org licen[cs]es licen[cs]e 2 0", "apache org"),
        ("D", "unless required by applicable law or agreed to in writing software distributed under the licen[cs]e is distributed on an as is basis", "agreed to in writing"),
        ("N", "see the licen[cs]e for the specific language governing permissions and limitations under the licen[cs]e", "governing permissions"),
        ("G", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright licen[cs]e", "hereby grants"),
        ("C", "you must cause any modified files to carry prominent notices stating that you changed the files", "prominent notices"),
        ("C", "if the work includes a notice text file as part of its distribution then any derivative works that you distribute must include", "notice text file"),
    ],
    "apache-1.1": [("C", "this product includes software developed by the apache software foundation", "apache software foundation"), ("C", "products derived from this software may not be called apache nor may apache appear in their name", "may not be called")],
    "mpl-2.0": [
        ("N", "this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0", "source code form"),
        ("N", "if a copy of the mpl was not distributed with this file you can obtain one at", "copy of the mpl"),
        ("C", "all distribution of covered software in source code form including any modifications that you create", "covered software"),
    ],
    "mpl-1.1": [
        ("N", "the contents of this file are subject to the mozilla public licen[cs]e version 1 1", "contents of this file"),
        ("N", "the original code is (?:[^ ]+ ){1,6}the initial developer of the original code is", "original code"),
    ],
    "epl": [
        ("N", "this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e", "accompanying materials"),
        ("C", "a contribution originates from a contributor if it was added to the program by such contributor itself", "contribution originates"),
    ],
    "cddl": [
        ("N", "the contents of this file are subject to the terms of the common development and distribution licen[cs]e", "contents of this file"),
        ("N", "when distributing covered code include this cddl header in each file", "cddl header"),
    ],
    "cpl": [("N", "the accompanying program is provided under the terms of this common public licen[cs]e agreement", "accompanying program")],
    "artistic": [
        ("C", "the intent of this document is to state the conditions under which a package may be copied", "package may be copied"),
        ("C", "such that the copyright holder maintains some semblance of artistic control over the development of the package", "artistic control"),
        ("N", "you can redistribute it and or modify it under the same terms as perl itself", "terms as perl"),
        ("C", "you are permitted to use the standard version and create and use modified versions for any purpose without restriction", "standard version"),
    ],
    "boost": [
        ("G", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", "organization obtaining"),
        ("C", "unless such copies or derivative works are solely in the form of machine executable object code", "machine executable"),
        ("N", "see accompanying file licen[cs]e 1 0 txt or copy at (?:https? )?www boost org", "boost org"),
    ],
    "zlib": [
        ("G", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", "granted to anyone"),
        ("C", "the origin of this software must not be misrepresented you must not claim that you wrote the original software", "misrepresented"),
        ("C", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", "plainly marked"),
        ("D", "in no event will the authors be held liable for any damages arising from the use of this software", "held liable"),
    ],
    "libpng": [("D", "the png reference library is supplied as is the contributing authors", "png reference library")],
    "unlicense": [
        ("G", "this is free and unencumbered software released into the public domain", "unencumbered"),
        ("G", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary", "anyone is free to"),
        ("G", "in jurisdictions that recogni[sz]e copyright laws the author or authors of this software dedicate any and all copyright interest", "copyright interest"),
    ],
    "cc0": [
        ("G", "the person who associated a work with this deed has dedicated the work to the public domain", "this deed"),
        ("G", "to the extent possible under law (?:[^ ]+ ){1,8}(?:has|have) waived all copyright and related or neighbo(?:u)?ring rights", "extent possible under law"),
        ("N", "creativecommons org publicdomain zero 1 0", "creativecommons org"),
    ],
    "cc-by": [("N", "this work is licen[cs]ed under (?:a|the) creative commons attribution(?: [1-4] [05])?(?: international| unported)? licen[cs]e", "creative commons"), ("N", "creativecommons org licen[cs]es by [1-4] [05]", "creativecommons org")],
    "cc-by-sa": [
        ("N", "this work is licen[cs]ed under (?:a|the) creative commons attribution share ?alike", "creative commons"), ("N", "creativecommons org licen[cs]es by sa [1-4] [05]", "creativecommons org"),
        ("C", "if you remix transform or build upon the material you must distribute your contributions under the same licen[cs]e as the original", "build upon the material"),
        ("N", "text is available under the creative commons attribution share ?alike licen[cs]e", "creative commons"),
    ],
    "cc-by-nc": [("N", "creativecommons org licen[cs]es by nc [1-4] [05]", "creativecommons org"), ("C", "you may not use the material for commercial purposes", "commercial purposes")],
    "cc-by-nd": [("N", "creativecommons org licen[cs]es by nd [1-4] [05]", "creativecommons org"), ("C", "if you remix transform or build upon the material you may not distribute the modified material", "modified material")],
    "cc-by-nc-sa": [("N", "creativecommons org licen[cs]es by nc sa [1-4] [05]", "creativecommons org"), ("N", "this work is licen[cs]ed under (?:a|the) creative commons attribution non ?commercial share ?alike", "creative commons")],
    "cc-by-nc-nd": [("N", "creativecommons org licen[cs]es by nc nd [1-4] [05]", "creativecommons org"), ("N", "this work is licen[cs]ed under (?:a|the) creative commons attribution non ?commercial no ?deriv", "creative commons")],
    "ofl": [
        ("N", "this font software is licen[cs]ed under the sil open font licen[cs]e", "font software"),
        ("C", "neither the font software nor any of its individual components in original or modified versions may be sold by itself", "font software"),
        ("C", "no modified version of the font software may use the reserved font name", "reserved font name"),
    ],
    "python": [
        ("N", "this licen[cs]e agreement is between the python software foundation psf and the individual or organization", "python software foundation"),
        ("G", "psf hereby grants licensee a nonexclusive royalty free world wide licen[cs]e to reproduce analy[sz]e test perform", "psf hereby grants"),
    ],
    "php": [("C", "products derived from this software may not be called php nor may php appear in their name", "may not be called"), ("C", "this product includes php software freely available from", "php software")],
    "openssl": [("C", "this product includes software developed by the openssl project for use in the openssl toolkit", "openssl"), ("C", "the names openssl toolkit and openssl project must not be used to endorse", "openssl")],
    "ssleay": [("C", "this product includes cryptographic software written by eric young", "cryptographic software")],
    "ncsa": [("G", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction", "deal with the software"), ("C", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimers", "following disclaimers")],
    "postgresql": [("G", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", "written agreement")],
    "hpnd": [("G", "permission to use copy modify (?:and )?distribute(?: and sell)? this software and its documentation for any purpose is hereby granted without fee", "its documentation")],
    "x11": [("C", "except as contained in this notice the name of (?:the )?(?:[^ ]+ ){1,5}shall not be used in advertising or otherwise to promote the sale", "promote the sale")],
    "curl": [("G", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice", "hereby granted provided")],
    "wtfpl": [("C", "you just do what the fuck you want to", "you just do"), ("G", "everyone is permitted to copy and distribute verbatim or modified copies of this licen[cs]e document and changing it is allowed", "changing it is allowed")],
    "beerware": [("G", "if we meet some day and you think this stuff is worth it you can buy me a beer", "buy me a beer")],
    "json": [("C", "the software shall be used for good not evil", "good not evil")],
    "osl": [("N", "licen[cs]ed under the open software licen[cs]e version", "open software licen")],
    "afl": [("N", "licen[cs]ed under the academic free licen[cs]e version", "academic free licen")],
    "eupl": [("N", "licen[cs]ed under the eupl(?: version 1 [0-2])?", "eupl"), ("N", "you may not use this work except in compliance with the licen[cs]e", "use this work except")],
    "ms-pl": [("C", "this licen[cs]e governs use of the accompanying software if you use the software you accept this licen[cs]e", "accompanying software"), ("G", "each contributor grants you a non exclusive worldwide royalty free copyright licen[cs]e to reproduce its contribution", "reproduce its contribution")],
    "odbl": [("N", "this (?:[^ ]+ ){1,6}is made available under the open database licen[cs]e", "open database licen"), ("N", "any rights in individual contents of the database are licen[cs]ed under the database contents licen[cs]e", "database contents")],
    "pddl": [("N", "made available under the public domain dedication and licen[cs]e", "dedication and licen")],
    "sspl": [("C", "if you make the functionality of the program or a modified version available to third parties as a service", "as a service")],
    "busl": [("G", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work", "non production use"), ("C", "effective on the change date", "change date")],
    "elastic": [("C", "you may not provide the software to third parties as a hosted or managed service", "managed service"), ("C", "you may not move change disable or circumvent the licen[cs]e key functionality", "key functionality")],
    "commons-clause": [("C", "the grant of rights under the licen[cs]e will not include and the licen[cs]e does not grant to you the right to sell the software", "right to sell")],
    "polyform": [("C", "the licensor grants you a copyright licen[cs]e for the software to do everything you might do with the software that would otherwise infringe", "otherwise infringe"), ("C", "noncommercial purposes any noncommercial purpose is a permitted purpose", "permitted purpose")],
    "ecl": [("N", "licen[cs]ed under the educational community licen[cs]e version 2 0", "educational community")],
    "w3c": [("C", "permission to copy modify and distribute this (?:work|software) and its documentation with or without modification for any purpose and without fee or royalty", "fee or royalty")],
    "unicode": [("G", "permission is hereby granted free of charge to any person obtaining a copy of the unicode data files", "unicode data files"), ("N", "unicode inc licen[cs]e agreement data files and software", "unicode inc")],
    "sleepycat": [("C", "redistributions in any form must be accompanied by information on how to obtain complete source code", "obtain complete source")],
    "qpl": [("G", "you may copy and distribute the software in unmodified form provided that the entire package", "unmodified form")],
    "proprietary": [
        ("C", "unauthori[sz]ed copying of this (?:file|software|document) via any medium is strictly prohibited", "strictly prohibited"),
        ("C", "no part of this (?:publication|document|book|work) may be reproduced (?:distributed |stored )?(?:or transmitted )?in any form", "may be reproduced"),
        ("C", "this (?:document|software|information) is (?:the )?confidential and proprietary", "proprietary"),
        ("C", "may not be disclosed (?:copied |reproduced )?(?:or used )?without (?:the )?(?:prior|express) written (?:consent|permission)", "not be disclosed"),
        ("C", "reverse engineer decompile or disassemble", "reverse engineer"),
    ],
}
#: How sure a sentence of each kind makes.
_SURE = {"G": 0.95, "C": 0.85, "D": 0.7, "N": 0.9}

_LEVELS = (10, 20, 30, 40, 50)
#: Elements of a chunk of a running sum.
_CHUNK = 128


def rules() -> list[dict]:
    """The ordered rules, each with a keyword that its matches hold, a pattern over words parted by one space, a label, a priority and a confidence.

    Sentences of licence texts (30, a notice 20) and phrases (10) are written out; from each name come the bare name (10), its use in a grant (20), each known version (30), an SPDX line (40), and a
    refusal (50), which outranks what it contains.
    """
    out = []
    end = "(?= |$)"

    def add(keyword, pattern, label, priority, confidence):
        out.append({"id": len(out), "keyword": keyword, "pattern": f"(?<![^ ]){pattern}{end}", "label": label, "level": _LEVELS.index(priority), "confidence": confidence})

    for name, label, versions in FAMILIES:
        # the longest plain part of the name, so that few rules search a document
        keyword = max(re.split(r"\(.*?\)|.\?", name.replace("licen[cs]e", "licen")), key=len).strip()
        add(keyword, name, label, 10, 0.6)
        add(keyword, f"(?:licen[cs]ed|released|distributed|available|published|provided|covered) (?:under|by) (?:the )?(?:terms (?:and conditions )?of (?:the )?)?{name}", label, 20, 0.9)
        for v in versions.split():
            number = v.replace(".", " ") if not v.endswith(".0") else f"{v[:-2]}(?: 0)?"
            add(keyword, f"{name} (?:version |v )?v?{number}", f"{label}-{v}", 30, 0.95)
        spdx = label.replace("-", " ")
        add("spdx licen", f"spdx licen[cs]e identifier {spdx}(?: [0-9]+){{0,2}}(?: only| or later)?", label, 40, 1.0)
        add(keyword, f"(?:not|never) (?:licen[cs]ed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?{name}", f"not-{label}", 50, 0.8)
    for label, sentences in SIGNATURES.items():
        for kind, pattern, keyword in sentences:
            add(keyword, pattern, label, 20 if kind == "N" else 30, _SURE[kind])
    for pattern, keyword, label, confidence in PHRASES:
        add(keyword, pattern, label, 10, confidence)
    return out


def gate() -> list[str]:
    """Few words such that each rule's keyword holds one of them: a document without any holds no match. The word that most of the keywords left hold comes next, the longest of these first."""
    left, out = {r["keyword"] for r in rules()}, []
    while left:
        words = sorted({w for k in left for w in k.split() if len(w) > 3 or w == k} | {k for k in left if not any(len(w) > 3 for w in k.split())})
        best = max(words, key=lambda w: (sum(w in k for k in left), len(w)))
        out.append(best)
        left = {k for k in left if best not in k}
    return out


def words_only(text: Column) -> Column:
    """Lower case; words (letters a-z, digits, anything beyond ASCII) parted by one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def _starts(sizes: Column) -> Column:
    """Running sums before each element of an array of whole numbers. Sums inside chunks and over chunks, so that no long list is copied for each element."""
    zero = lambda: F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<bigint>").alias("all"))
    step = lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["all"], F.array(acc["sum"])).alias("all"))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / _CHUNK).cast("int")), lambda k: F.slice(sizes, k * _CHUNK + 1, _CHUNK))
    inner = F.transform(chunks, lambda c: F.aggregate(c, zero(), step))
    outer = F.aggregate(F.transform(inner, lambda a: a["sum"]), zero(), step, lambda a: a["all"])
    both = F.zip_with(inner, outer, lambda a, base: F.transform(a["all"], lambda x: x + base))
    return F.when(F.size(sizes) > 0, F.flatten(both)).otherwise(F.array().cast("array<bigint>"))


def _spans(words: Column, rule: Column) -> Column:
    """Matches of one rule, each (start, past, level, id, label, confidence), in order. A match of a rule that follows another with the same text in between is found like any other."""
    parts = F.split(F.regexp_replace(words, rule["pattern"], F.lit("\u0001$0\u0002")), "\u0001")
    # parts after the first: a match, its end mark, and what follows
    sizes = F.transform(parts, lambda x, i: F.length(x).cast("long") - F.when(i > 0, 1).otherwise(0))
    found = F.zip_with(parts, _starts(sizes), lambda x, at: F.struct(x.alias("x"), at.alias("at")))

    def match(m):
        start, size = m["at"].cast("int"), F.instr(m["x"], "\u0002") - 1
        return F.struct(start.alias("start"), (start + size).alias("past"), rule["level"].alias("level"), rule["id"].alias("id"), rule["label"].alias("label"), rule["confidence"].alias("confidence"))

    return F.transform(F.slice(found, 2, F.greatest(F.size(found) - 1, F.lit(0))), match)


def detections(words: Column, table: list[dict]) -> Column:
    """All matches of all rules whose keyword the document holds, sorted by start, longest first, then by priority."""
    kind = "array<struct<keyword:string,rules:array<struct<id:int,pattern:string,label:string,level:int,confidence:double>>>>"
    groups: dict[str, list[dict]] = {}
    for r in table:
        groups.setdefault(r["keyword"], []).append({k: v for k, v in r.items() if k != "keyword"})
    every = F.from_json(F.lit(json.dumps([{"keyword": k, "rules": v} for k, v in groups.items()])), kind)
    asked = F.flatten(F.transform(F.filter(every, lambda g: F.contains(words, g["keyword"])), lambda g: g["rules"]))
    found = F.flatten(F.transform(asked, lambda r: _spans(words, r)))
    order = F.transform(found, lambda d: F.struct(d["start"].alias("start"), (-d["past"]).alias("less"), (-d["level"]).alias("rank"), d["id"].alias("id"), d["label"].alias("label"), d["confidence"].alias("confidence")))
    return F.sort_array(order)


def surviving(sorted_: Column) -> Column:
    """(labels, score) of matches that lie in no match of the same or a higher priority. One pass: the farthest end so far of each priority tells."""
    zero = F.struct(F.array_repeat(F.lit(-1), len(_LEVELS)).alias("ends"), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score"))

    def step(acc, d):
        level, past = -d["rank"], -d["less"]
        inside = F.array_max(F.slice(acc["ends"], level + 1, len(_LEVELS))) >= past
        ends = F.transform(acc["ends"], lambda e, i: F.when(i == level, F.greatest(e, past)).otherwise(e))
        return F.struct(
            ends.alias("ends"), F.when(inside, acc["labels"]).otherwise(F.array_union(acc["labels"], F.array(d["label"]))).alias("labels"),
            F.when(inside, acc["score"]).otherwise(F.greatest(acc["score"], d["confidence"])).alias("score"),
        )

    return F.aggregate(sorted_, zero, step, lambda a: F.struct(a["labels"].alias("labels"), a["score"].alias("score")))


def license_scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of each document; one narrow pass, no shuffle, no Python.

    Base: places of the phrases of BASE as consecutive words. Rules: documents past the keyword gate are searched by the rules whose keyword they hold;
    a match inside one of the same or a higher priority is suppressed (of equal ones the first rule stays). labels has base labels and surviving ones;
    score is the highest confidence (a base phrase: 0.6). Null, empty or wordless text: no words, null places, empty labels, 0. Other columns are ignored.
    """
    table = rules()
    d = docs.select(F.col("doc_id").cast("long"), words_only(F.col("text")).alias("words"))
    n_words = F.when(F.col("words") == "", 0).otherwise(F.length("words") - F.length(F.replace("words", F.lit(" "))) + 1).cast("long")
    some = F.lit(False)
    for k in gate():
        some = some | F.contains("words", F.lit(k))
    d = d.select("doc_id", n_words.alias("n_words"), F.when(some, F.col("words")).alias("words"))
    # each word between two spaces of its own, so places of a phrase never share one
    apart = F.concat(F.lit(" "), F.replace("words", F.lit(" "), F.lit("  ")), F.lit(" "))
    d = d.select("doc_id", "n_words", "words", *[F.split(apart, re.escape(f" {p.replace(' ', '  ')} ").replace("\\ ", " ")).alias(f"_{i}") for i, p in enumerate(BASE)])
    count = lambda x: F.floor((F.length(x) - F.length(F.replace(x, F.lit(" ")))) / 2).cast("long")
    has = [F.size(f"_{i}") > 1 for i in range(len(BASE))]
    n_base = sum([F.when(h, F.size(f"_{i}") - 1).otherwise(0) for i, h in enumerate(has)], F.lit(0)).cast("long")
    first = F.least(*[F.when(h, count(F.col(f"_{i}")[0])) for i, h in enumerate(has)])
    last = F.greatest(*[F.when(h, F.col("n_words") - count(F.element_at(f"_{i}", -1)) - len(p.split())) for (i, h), p in zip(enumerate(has), BASE)])
    base = F.array_sort(F.array_compact(F.array(*[F.when(h, F.lit(x)) for h, x in zip(has, BASE.values())])))
    kept = F.when(F.col("words").isNotNull(), surviving(detections(F.col("words"), table)))
    d = d.select("doc_id", "n_words", n_base.alias("n_base"), first.alias("first_word"), last.alias("last_word"), base.alias("base"), kept.alias("kept"))
    labels = F.array_sort(F.array_distinct(F.concat("base", F.coalesce(F.col("kept.labels"), F.array().cast("array<string>")))))
    score = F.greatest(F.coalesce(F.col("kept.score"), F.lit(0.0)), F.when(F.size("base") > 0, 0.6).otherwise(0.0))
    return d.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))
