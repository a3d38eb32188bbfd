"""Licence texts and notices by canonical digest, with DataFrame functions only.

A text and each of its lines are brought to a canonical form: lower case, copyright lines left out,
equivalent spellings made one, all but letters and numbers as single spaces; of a whole text, lines that
only name a short licence are left out too. The SHA-256 digest of the whole is hash-joined with the digests
of known licences; lines are looked up among the digests of known notices. Known texts go through the same
expression. The catalogue is fixed (short texts here, long ones in ``licences``), so its broadcast has a
known size; a table of texts given in its place is joined as Spark sees fit.
"""

from __future__ import annotations

from importlib import resources

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadline.llm.common import text_rows

# licences' own wording, and spellings that count as equal.
LICENCES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSL-1.0": """Boost Software License - Version 1.0 - August 17th, 2003
Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
}
NOTICES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "This file is licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0", "Apache License Version 2.0"],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "SPDX-License-Identifier: MIT", "The MIT License", "MIT License"],
    "GPL-3.0-only": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0"],
    "GPL-2.0-only": ["Licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "CC0-1.0": ["Released under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"],
    "MPL-2.0": ["Licensed under the Mozilla Public License, Version 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "Unlicense": ["Released into the public domain under the Unlicense.", "SPDX-License-Identifier: Unlicense"],
}
SPELLINGS = {"licence": "license", "licences": "licenses", "licencee": "licensee", "licencees": "licensees", "licenced": "licensed", "sublicence": "sublicense", "sublicences": "sublicenses", "sublicencing": "sublicensing", "licencing": "licensing", "noncommercial": "non commercial", "acknowledgement": "acknowledgment", "merchantibility": "merchantability", "organisation": "organization", "recognise": "recognize", "favour": "favor", "centre": "center", "wilful": "willful", "fulfilment": "fulfillment", "judgement": "judgment", "http": "https"}
#: Lines that consist of the name of a licence whose own wording has no title.
TITLES = [
    "MIT License", "The MIT License", "MIT License (MIT)", "The MIT License (MIT)", "Expat License", "ISC License", "The ISC License", "ISC License (ISC)", "BSD License", "Simplified BSD License", "New BSD License",
    "BSD 2-Clause License", "The BSD 2-Clause License", "BSD 2-Clause \"Simplified\" License", "BSD 3-Clause License", "The BSD 3-Clause License", "BSD 3-Clause \"New\" or \"Revised\" License",
    "BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License", "0BSD", "zlib License", "The zlib License", "zlib/libpng License", "The Unlicense", "Unlicense",
]
#: A line that names a holder of rights, not a licence's own words about such lines.
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*((copyright|\(c\)|©)[^\n]*([0-9]{4}|<year>|\[yyyy\])[^\n]*|©[^\n]*|copyright[^a-z0-9\n]*\(c\)[^\n]*|copyright[ \t]*(©|<|\[)[^\n]*|copyright by [^\n]*|copyright( the)?( [^ \n]+){0,6} (authors|contributors|developers|project|team)[. \t\r]*|all rights reserved[. \t\r]*)$"
SIGNS = r"[^\p{L}\p{N}]+"
_WORDS_OF_TITLES = sorted({r"[^a-z0-9\n]+".join(w.strip('()"') for w in t.lower().replace("-", " ").replace("/", " ").split()) for t in TITLES})
TITLE_LINE = rf"(?m)^[^a-z0-9\n]*({'|'.join(_WORDS_OF_TITLES)})[^a-z0-9\n]*$".replace("license", "licen[sc]e")
#: Where a licence's text ends and advice on how to use it begins; copies come with it and without.
END_OF_TERMS = "END OF TERMS AND CONDITIONS"


def known_texts() -> list[tuple[str, str]]:
    """The catalogue: (id, whole text), with and without what follows the terms."""
    long = [(f.name.removesuffix(".txt"), f.read_text(encoding="utf-8")) for f in resources.files(__package__).joinpath("licences").iterdir() if f.name.endswith(".txt")]
    cut = [(i, t[: t.index(END_OF_TERMS) + len(END_OF_TERMS)]) for i, t in long if END_OF_TERMS in t]
    return sorted([*LICENCES.items(), *long, *cut, *[(i, t.replace(END_OF_TERMS, "")) for i, t in cut]])


def canonical(text: Column, titles: bool = True) -> Column:
    """Words in lower case and one spelling, single spaces between, copyright lines left out, and title lines unless they are to stay."""
    kept = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "")
    if titles:
        kept = F.regexp_replace(kept, TITLE_LINE, "")
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(kept, SIGNS, " ")), F.lit(" "))
    for a, b in SPELLINGS.items():
        words = F.replace(words, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(words)


def _digest(text: Column, titles: bool = True) -> Column:
    return F.sha2(canonical(text, titles), 256)


def scan_licences(docs: DataFrame, licences: dict[str, str] | DataFrame | None = None, notices: dict[str, list[str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The licence that each whole text is, and the notices among its lines.

    ``licences``: ids and whole texts in place of the catalogue, or a table (license_id, text) of any size.
    Returns one row for each input row: doc_id, license_id string (null if the text is no known licence),
    n_notices long (lines that are known notices), notices string (their ids in order, once each, joined by
    commas), canonical_sha256 string. Null and empty texts, and texts of copyright and title lines only, have
    the digest of an empty string and no licence; lines and texts of any length are taken whole; null ids stay
    null, repeated rows give repeated results, an empty table an empty one; other columns, whatever they are
    called, are not read. Of known texts with one digest the least id counts; null and empty ones are none.
    """
    spark = docs.sparkSession
    rows = text_rows(docs, id_col, text_col)
    if isinstance(licences, DataFrame):
        known = licences.select("license_id", F.col("text").alias("known"))
    else:
        known = spark.createDataFrame(known_texts() if licences is None else [*licences.items()], "license_id string, known string")
    known = known.filter(canonical(F.col("known")) != "").select(_digest(F.col("known")).alias("canonical_sha256"), "license_id").groupBy("canonical_sha256").agg(F.min("license_id").alias("license_id"))
    listed = sorted((t, i) for i, ts in (NOTICES if notices is None else notices).items() for t in ts)
    # the catalogue's digests: as many rows as it has notices
    digests = {r.d: r.i for r in reversed(spark.createDataFrame(listed, "t string, i string").select(_digest(F.col("t"), False).alias("d"), "i").orderBy("i").collect())}
    by_digest = F.create_map(*[F.lit(x) for pair in digests.items() for x in pair])
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(x) > 0)
    found = F.filter(F.transform(lines, lambda x: F.element_at(by_digest, _digest(x, False))), lambda x: x.isNotNull())
    out = rows.select("doc_id", _digest(F.col("text")).alias("canonical_sha256"), found.alias("found"))
    return out.join(known if isinstance(licences, DataFrame) else F.broadcast(known), "canonical_sha256", "left").select(
        "doc_id",
        "license_id",
        F.size("found").cast("long").alias("n_notices"),
        F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("notices"),
        "canonical_sha256",
    )


def _sql_canonical(x: str, titles: bool = True) -> str:
    kept = f"regexp_replace(lower({x}), '{COPYRIGHT_LINE}', '', 'g')"
    if titles:
        kept = f"regexp_replace({kept}, '{TITLE_LINE}', '', 'g')"
    words = f"' ' || trim(regexp_replace({kept}, '{SIGNS}', ' ', 'g')) || ' '"
    for a, b in SPELLINGS.items():
        words = f"replace({words}, ' {a} ', ' {b} ')"
    return f"trim({words})"


def oracle() -> str:
    """DuckDB SQL for the scan of ``documents``."""

    def values(rows) -> str:
        return ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in rows)

    return f"""
    WITH known AS (SELECT sha256({_sql_canonical("t")}) AS d, min(i) AS license_id FROM (VALUES {values(known_texts())}) v(i, t) GROUP BY 1),
    notices AS (SELECT sha256({_sql_canonical("t", False)}) AS d, min(i) AS i FROM (VALUES {values((i, t) for i, ts in NOTICES.items() for t in ts)}) v(i, t) GROUP BY 1),
    texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
    lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM texts),
    found AS (SELECT r, count(*) AS n, string_agg(DISTINCT i, ',' ORDER BY i) AS notices FROM lines JOIN notices ON d = sha256({_sql_canonical("line", False)}) WHERE length(line) > 2 GROUP BY r),
    whole AS (SELECT r, doc_id, sha256({_sql_canonical("text")}) AS canonical_sha256 FROM texts)
    SELECT doc_id, license_id, coalesce(n, 0) AS n_notices, coalesce(notices, '') AS notices, canonical_sha256
    FROM whole LEFT JOIN known ON d = canonical_sha256 LEFT JOIN found USING (r)
    """
