"""Licence scan by canonical digests, in DataFrame functions only.

A text is brought to a canonical form: copyright notices dropped, lower case, everything but letters
and digits (of any script) reduced to single blanks, lines joined, equivalent spellings unified.  Its SHA-256 is
joined with the digests of known licence texts, brought to the same form, so wrapping and case do not
matter and any further letter does.  One-line notices are found in the same form, line by line.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_NAME = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_TAIL = """
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
"""
#: Whole licence texts as published, without their copyright lines.
KNOWN_TEXTS = {
    "MIT": """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
""",
    "BSD-2-Clause": "BSD 2-Clause License\n\n" + _BSD_HEAD + _BSD_TAIL,
    "BSD-3-Clause": "BSD 3-Clause License\n\n" + _BSD_HEAD + _BSD_NAME + _BSD_TAIL,
    "ISC": f"ISC License\n\n{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_TAIL}",
    "0BSD": f"BSD Zero Clause License\n\n{_ISC_GRANT}.\n{_ISC_TAIL}",
    "Zlib": """zlib License

This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.
""",
}
_MIT_GRANT = KNOWN_TEXTS["MIT"].split("\n\n")[1].removesuffix(", subject to the following conditions:")
_MIT_TAIL = KNOWN_TEXTS["MIT"].split("\n\n")[3]
KNOWN_TEXTS |= {
    "MIT-0": f"MIT No Attribution\n\n{_MIT_GRANT}.\n\n{_MIT_TAIL}",
    "BSD-1-Clause": "BSD 1-Clause License\n\n" + _BSD_HEAD.split("\n\n2.")[0] + "\n" + _BSD_TAIL,
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>
""",
    "BSL-1.0": """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
""",
}
#: Digests of the canonical forms of longer licences as published (whole files, title included).
KNOWN_DIGESTS = {
    "75acde0fb516a7ba4597dfc23680cf78281f7fae7f3b74a78e06ef83c1c375c6": "Apache-2.0",
    "64e91f5cc481723b420f8e1ecf131ec7eba02da96cf0a78bb4b764fb30984f7a": "Artistic-1.0-Perl",
    "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651": "BSD-3-Clause",
    "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e": "CC0-1.0",
    "66919c3537107c2c9f5219f6ba4c41fe9c0d7c14d885087e3db69494463a778e": "GFDL-1.2",
    "525fd4384869c81c4cbd264822942ae15202284aed28fb120ba01fc119dda9ff": "GFDL-1.3",
    "37f380f152339f34a15db620545eb53f0b5c7d9e6a9542aa09ed0d22f186920f": "GPL-1.0",
    "ae2be2aaa68f5e52ef402874fc8c7c691879b445cb12e49d84f88168cc2d7dd6": "GPL-2.0",
    "ee0d2b91860148fdc6916d4fbea5723c7b0c7330d7a45ee71fabe123ce7175f8": "GPL-3.0",
    "bea988245c65edbddad6f43ff12ca2472c232324e916d42648b90eac944d833e": "LGPL-2.0",
    "ed875dac9045cba09a17867210991f3a4a82f80b82096b054560a3a8dae9d692": "LGPL-2.1",
    "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be": "LGPL-3.0",
    "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6": "MPL-1.1",
    "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a": "MPL-2.0",
}
#: Notices of one line.
KNOWN_NOTICES = {
    "Released under the MIT License.": "MIT",
    "Licensed under the MIT License.": "MIT",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "Licensed under CC BY 4.0.": "CC-BY-4.0",
    "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0",
    "This work is dedicated to the public domain.": "CC0-1.0",
}
#: Spellings that count as one.
SPELLINGS = {"https": "http", "licence": "license", "licenced": "licensed", "acknowledgement": "acknowledgment", "sub license": "sublicense", "non infringement": "noninfringement", "copyright holder": "copyright owner"}


#: Lines that are a copyright notice, each up to its line feed: the word with a sign, a year or a placeholder behind it,
#: the sign with the word or a year, or the word with nothing but names.  A sentence wrapped before "copyright" is none.
NOTICE_LINE = (
    r"(?:^|\n)[ \t\r]*[^\p{L}\p{N}\n©(]*(?:"
    r"(?:[Cc]opyright|COPYRIGHT)[ \t:]*(?:\([Cc]\)|©|[0-9]{4}|\[|<|\{)[^\n]*"
    r"|(?:©|\([Cc]\)[ \t]*(?:[Cc]opyright|COPYRIGHT|[0-9]{4}|\[|<|\{))[^\n]*"
    r"|Copyright(?: by)?(?: (?:the|and|of|[A-Z][A-Za-z.,&'-]*))+[ \t\r]*(?:\n|\z)"
    r"|(?:[Aa]ll [Rr]ights [Rr]eserved|ALL RIGHTS RESERVED)\.?[ \t\r]*(?:\n|\z))"
)


def canonical(text: Column) -> Column:
    """Lower-case words without copyright notices, lines kept apart by line feeds."""
    plain = F.lower(text)
    hint = reduce(or_, (plain.contains(h) for h in ("copyright", "©", "(c)", "rights reserved")))  # few texts need the costlier expression
    return F.regexp_replace(F.lower(F.when(hint, F.regexp_replace(text, NOTICE_LINE, "\n")).otherwise(text)), r"[^\p{L}\p{N}\n]+", " ")


def _spelled(form: Column) -> Column:
    for old, new in SPELLINGS.items():
        form = F.replace(form, F.lit(old), F.lit(new))
    return form


def canonical_digest(form: Column) -> Column:
    """SHA-256 of the canonical form: lines are joined before spellings are unified, as a spelling may be wrapped."""
    return F.sha2(_spelled(F.trim(F.regexp_replace(form, r"[ \n]+", " "))), 256)


def known_digests(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """``(digest, license_id)`` of licence texts given by id; a title line is optional in the scanned text.

    Without ``texts`` the built-in ones, and the built-in digests of longer licences.
    """
    rows = []
    for name, text in (KNOWN_TEXTS if texts is None else texts).items():
        rows += [(name, text), (name, text.split("\n\n", 1)[-1])]
    table = spark.createDataFrame(rows, "license_id string, text string").select(canonical_digest(canonical(F.col("text"))).alias("digest"), "license_id")
    if texts is None and KNOWN_DIGESTS:
        table = table.unionByName(spark.createDataFrame(list(KNOWN_DIGESTS.items()), "digest string, license_id string"))
    return table.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan_licences(docs: DataFrame, known: DataFrame | None = None, notices: dict[str, str] | None = None) -> DataFrame:
    """``(doc_id, digest, license_id, notices array<string>)``, one row per row of ``docs``.

    ``known`` is ``(digest, license_id)``, one row per digest, of any size: a given table is broadcast only under
    Spark's own size limit, the built-in one always, so no document is shuffled for it.  ``license_id`` is null if the whole text is no known licence; ``notices``
    are the distinct licences named by known one-line notices (a small table passed in code).  A null
    text counts as empty; null ids, repeated rows and empty tables pass through; other columns are
    ignored.  Only DataFrame functions: no Python runs on the executors.
    """
    known = F.broadcast(known_digests(docs.sparkSession)) if known is None else known  # the built-in table: some forty rows, written in this module
    table = sorted((KNOWN_NOTICES if notices is None else notices).items())
    pairs = F.array(*(F.struct(F.trim(_spelled(canonical(F.lit(n)))).alias("line"), F.lit(i).alias("id")) for n, i in table))
    lines = F.transform(F.split(_spelled(F.col("form")), "\n"), lambda line: F.trim(line))
    hit = F.array_intersect(lines, F.transform(pairs, lambda p: p["line"]))
    named = F.transform(hit, lambda line: F.transform(F.filter(pairs, lambda p: p["line"] == line), lambda p: p["id"]))
    ids = F.array_sort(F.array_distinct(F.flatten(named)))
    scanned = docs.select("doc_id", canonical(F.coalesce("text", F.lit(""))).alias("form")).select("doc_id", canonical_digest(F.col("form")).alias("digest"), ids.alias("notices"))
    return scanned.join(known, "digest", "left").select("doc_id", "digest", "license_id", "notices")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_form(text: str) -> str:
    text = f"regexp_replace({text}, {_quoted(NOTICE_LINE)}, chr(10), 'g')"
    return rf"regexp_replace(lower({text}), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g')"


def _sql_spelled(form: str) -> str:
    for old, new in SPELLINGS.items():
        form = f"replace({form}, '{old}', '{new}')"
    return form


def _sql_digest(form: str) -> str:
    return "sha256(" + _sql_spelled(rf"trim(regexp_replace({form}, '[ \n]+', ' ', 'g'))") + ")"


def _sql() -> str:
    texts = ", ".join(f"({_quoted(n)}, {_quoted(t)}), ({_quoted(n)}, {_quoted(t.split(chr(10) * 2, 1)[-1])})" for n, t in KNOWN_TEXTS.items())
    digests = ", ".join(f"('{d}', '{n}')" for d, n in KNOWN_DIGESTS.items())
    notices = ", ".join(f"({_quoted(n)}, {_quoted(i)})" for n, i in KNOWN_NOTICES.items())
    return f"""
WITH known AS (SELECT digest, min(id) AS license_id FROM (
  SELECT {_sql_digest(_sql_form("text"))} AS digest, id FROM (VALUES {texts}) v(id, text)
  UNION ALL SELECT digest, id FROM (VALUES {digests}) w(digest, id)) GROUP BY 1),
n AS (SELECT trim({_sql_spelled(_sql_form("line"))}) AS line, id FROM (VALUES {notices}) v(line, id)),
d AS (SELECT row_number() OVER () AS rn, doc_id, {_sql_form("coalesce(text, '')")} AS form FROM documents),
l AS (SELECT DISTINCT rn, id FROM (SELECT rn, unnest(string_split({_sql_spelled("form")}, chr(10))) AS line FROM d) x JOIN n ON trim(x.line) = n.line),
f AS (SELECT rn, list(id ORDER BY id) AS notices FROM l GROUP BY rn)
SELECT doc_id, {_sql_digest("form")} AS digest, license_id, coalesce(notices, []) AS notices
FROM d LEFT JOIN f USING (rn) LEFT JOIN known k ON {_sql_digest("form")} = k.digest
"""


LICENCE_SQL = _sql()
