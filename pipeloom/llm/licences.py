"""Licence scan by canonical digests (operator 2).

A text is brought into canonical form: ASCII letters in lower case, lines that are
copyright notices taken out, punctuation and white space (line breaks too) made single
spaces, equivalent spellings made one.  The digest of the whole canonical text is
joined to the digests of known licence texts.

A line is a notice if it begins with a copyright word or sign and holds a year, or
else doesn't go on as running text does (``BODY``), so a wrapped line of a licence's
body stays.  A notice that shares its line with other text isn't recognised.
"""

from __future__ import annotations

import hashlib
import re
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: Spellings that count as equal.
EQUIVALENT = {
    "acknowledgement": "acknowledgment",
    "analogue": "analog",
    "analyse": "analyze",
    "artefact": "artifact",
    "authorisation": "authorization",
    "authorised": "authorized",
    "calibre": "caliber",
    "cancelled": "canceled",
    "catalogue": "catalog",
    "centre": "center",
    "emphasised": "emphasized",
    "favour": "favor",
    "favourite": "favorite",
    "fulfil": "fulfill",
    "fulfilment": "fulfillment",
    "http": "https",
    "initialise": "initialize",
    "judgement": "judgment",
    "labelling": "labeling",
    "labour": "labor",
    "licence": "license",
    "licences": "licenses",
    "maximise": "maximize",
    "modelled": "modeled",
    "modelling": "modeling",
    "offence": "offense",
    "optimise": "optimize",
    "organisation": "organization",
    "organise": "organize",
    "practise": "practice",
    "programme": "program",
    "realise": "realize",
    "recognise": "recognize",
    "signalling": "signaling",
    "utilisation": "utilization",
    "whilst": "while",
    "wilful": "willful",
}

_MIT_BODY = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_TWO = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""

#: Known texts.  A licence with or without its title, and short notices that stand for a licence.
KNOWN = [
    ("MIT", _MIT_BODY),
    ("MIT", "MIT License\n" + _MIT_BODY),
    ("MIT", "The MIT License (MIT)\n" + _MIT_BODY),
    ("BSD-2-Clause", _BSD_TWO + _BSD_DISCLAIMER),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD_TWO + _BSD_DISCLAIMER),
    ("BSD-3-Clause", _BSD_TWO + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n" + _BSD_DISCLAIMER),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD_TWO + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n" + _BSD_DISCLAIMER),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_WARRANTY),
    ("ISC", "ISC License\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_WARRANTY),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _ISC_WARRANTY),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("Unlicense", _UNLICENSE),
    ("Unlicense", _UNLICENSE + "\n\nFor more information, please refer to <https://unlicense.org>"),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License\n" + _ZLIB),
]

#: Digests of the canonical forms of longer texts, as the licences' authors publish them; "terms" without what follows the end of the terms.
KNOWN_DIGESTS = {
    "ef9aa6097e8b8724e8bedf9a9a264cbc3142b55ef97f3c3f079b7aa1aeac425c": "Apache-2.0",
    "ed44d69699f98d45c0c3e52ef4574fb05d6045eb6e2cd0e5e3810f6177e87f84": "Apache-2.0",  # terms
    "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702": "Artistic-1.0-Perl",
    "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651": "BSD-3-Clause",
    "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f": "CC0-1.0",
    "5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71": "GFDL-1.2",
    "93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6": "GFDL-1.3",
    "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224": "GPL-1.0",
    "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc": "GPL-1.0",  # terms
    "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821": "GPL-2.0",
    "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34": "GPL-2.0",  # terms
    "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68": "GPL-3.0",
    "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636": "GPL-3.0",  # terms
    "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908": "LGPL-2.0",
    "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260": "LGPL-2.0",  # terms
    "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891": "LGPL-2.1",
    "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4": "LGPL-2.1",  # terms
    "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be": "LGPL-3.0",
    "e0ef9dbd531e1144276348572887b7d756d42277c948f3a4f9d02d4634742d16": "MPL-1.1",
    "9eab7902f21bef0326dee4ed0cae1402c781cbf1f8e3dbeed6fbe176d641bb13": "MPL-2.0",
}

#: How a line that is a notice begins, a year, and how running text goes on.
NOTICE = r"^[^a-z0-9(©]*(copyright([^a-z]|$)|\(c\)|©|all rights reserved[ \t.]*\r?$)"
YEAR = r"(19|20)[0-9][0-9]"
BODY = (
    r"^[^a-z0-9(©]*(copyright[ \t]*([.,;:)\"']|\r?$|(and|as|claim|claims|disclaimer|disclaimers|doctrine|doctrines|except|file|for|holder|holders|holder's|holders'|in|infringement|interest|interests|is|law|laws|licence|license|licenses|license's"
    r"|marks|material|notice|notices|of|on|or|owner|owners|permission|permissions|protection|resulting|statement|statements|status|that|the|this|to|treaties|treaty|under|was|which|with)([^a-z]|$))|\(c\)([ \t]+[^ \t]+){5,})"
)
#: Everything but ASCII letters and digits and what lies beyond Latin-1 signs and general punctuation.
SEPARATORS = r"[^a-z0-9\x{C0}-\x{200F}\x{2070}-\x{10FFFF}]+"


def canonical(text: Column) -> Column:
    lower = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    notice = lambda line: line.rlike(NOTICE) & (line.rlike(YEAR) | ~line.rlike(BODY))
    lines = F.array_join(F.filter(F.split(lower, "\n", -1), lambda line: ~notice(line)), "\n")
    bare = F.trim(F.regexp_replace(lines, SEPARATORS, " "))
    equal = F.create_map(*(F.lit(x) for pair in EQUIVALENT.items() for x in pair))
    return F.array_join(F.transform(F.split(bare, " ", -1), lambda w: F.coalesce(F.try_element_at(equal, w), w)), " ")


def canonical_text(text: str) -> str:
    """The same form of one known text."""
    lower = text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    notice = lambda line: re.search(NOTICE, line) and (re.search(YEAR, line) or not re.search(BODY, line))
    lines = "\n".join(line for line in lower.split("\n") if not notice(line))
    bare = re.sub("[^a-z0-9\xc0-\u200f\u2070-\U0010ffff]+", " ", lines).strip(" ")
    return " ".join(EQUIVALENT.get(w, w) for w in bare.split(" "))


def digests(known: list[tuple[str, str]]) -> dict[str, str]:
    """Digest of each known text's canonical form -> licence."""
    return {hashlib.sha256(canonical_text(text).encode()).hexdigest(): name for name, text in known}


def scan(docs: DataFrame, known: list[tuple[str, str]] | None = None, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` plus canonical_sha256 and license_id (null if the whole text is no known licence).

    Null text has neither; empty text has the digest of the empty form; repeated rows
    get equal results; an empty table gives no rows.  Where ``docs`` has these names
    already the new ones get underscores.  Of known texts with equal digests the last
    one names the licence.  The list of known texts is a parameter held on the driver,
    so joining it as a broadcast is bounded by it.
    """
    found = digests(KNOWN) | KNOWN_DIGESTS if known is None else digests(known)
    digest, licence, other = fresh(docs, "canonical_sha256", "license_id", "known_sha256")
    table = docs.sparkSession.createDataFrame(sorted(found.items()), f"{other} string, {licence} string")
    scanned = docs.withColumn(digest, F.sha2(canonical(F.col(text_col)), 256))
    return scanned.join(F.broadcast(table), F.col(digest) == F.col(other), "left").drop(other)
