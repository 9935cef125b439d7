"""License scans by canonical digest lookup.

Texts are brought to a canonical form: lower case, copyright lines removed, punctuation and white
space runs one space, equivalent spellings replaced.  The SHA-256 digest of the entire canonical
text is hash-joined to the digests of known licenses; the known table is broadcast while it has at
most ``broadcast_rows`` rows and shuffled beyond.

Defined results: null counts as empty; an empty canonical text matches nothing; of known licenses
with equal canonical texts the smallest id is given; repeated rows are each answered; an empty
table gives an empty result.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

COPYRIGHT_LINE = (
    r"(?m)^[^\n\w]*(?:copyright[ \t]*(?:\(c\)|©|[0-9<\[{]|by[ \t]|holders?[ \t]*:)|\(c\)[ \t]|©"
    r"|all rights reserved)[^\n]*$"
)
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F\xA0\xA9\xAB\xAE\xBB\x{2010}-\x{2026}\x{2122}]+"
#: Equivalent spellings, applied in order to canonical words.
SPELLINGS = (
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("organisation", "organization"),
    ("authoris", "authoriz"),
    ("recognis", "recogniz"),
    ("realis", "realiz"),
    ("utilis", "utiliz"),
    ("modernis", "moderniz"),
    ("initialis", "initializ"),
    ("judgement", "judgment"),
    ("acknowledgement", "acknowledgment"),
    ("fulfilment", "fulfillment"),
    ("favour", "favor"),
    ("honour", "honor"),
    ("copyright owner", "copyright holder"),
    ("merchantability", "merchantibility"),
    ("non commercial", "noncommercial"),
    ("per cent", "percent"),
    ("https www", "http www"),
)

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""
BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.
"""
BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
ZERO_BSD = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License."""
GPL_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version {v} of the License, or (at your option) any
later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see
<https://www.gnu.org/licenses/>."""
MPL_NOTICE = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""

#: Known short licenses and statements (id, entire text); :func:`license_scan` takes any such table.
KNOWN = (
    ("0BSD", ZERO_BSD),
    ("Apache-2.0 notice", APACHE_NOTICE),
    ("Apache-2.0 statement", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", BSD_HEAD + BSD_TAIL),
    ("BSD-3-Clause", BSD_HEAD + BSD_THIRD + BSD_TAIL),
    ("CC-BY-NC-4.0 statement", "Licensed under CC BY-NC 4.0."),
    ("GPL-2.0-or-later notice", GPL_NOTICE.format(v=2)),
    ("GPL-3.0-or-later notice", GPL_NOTICE.format(v=3)),
    ("GPL-3.0 statement", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", ISC),
    ("MIT", MIT),
    ("MIT with title", "MIT License\n\n" + MIT),
    ("MIT statement", "Released under the MIT License."),
    ("MPL-2.0 notice", MPL_NOTICE),
    ("Zlib", ZLIB),
)


def canonical(text: Column) -> Column:
    out = F.lower(F.coalesce(text, F.lit("")))
    out = F.regexp_replace(out, COPYRIGHT_LINE, " ")
    out = F.trim(F.regexp_replace(out, NOT_WORD, " "))
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def full_texts() -> list[tuple[str, str]]:
    """(id, entire text) of the licenses that lie whole in ``license_texts``."""
    found = sorted((Path(__file__).resolve().parent / "license_texts").glob("*.txt"))
    return [(f"{path.stem} text", path.read_text("utf-8")) for path in found]


def known_licenses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*KNOWN, *full_texts()], "license_id string, text string")


def license_scan(
    docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 100_000
) -> DataFrame:
    """One row a document: doc_id, canonical_sha256, license_id (null without a match)."""
    table = (
        known.select("license_id", canonical(F.col("text")).alias("form"))
        .filter("form != ''")
        .groupBy(F.sha2("form", 256).alias("known_sha256"))
        .agg(F.min("license_id").alias("license_id"))
    )
    if known.limit(broadcast_rows + 1).count() <= broadcast_rows:
        table = F.broadcast(table)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.sha2(canonical(F.col(text_col)), 256).alias("canonical_sha256")
    )
    return rows.join(table, F.col("canonical_sha256") == F.col("known_sha256"), "left").select(
        "doc_id", "canonical_sha256", "license_id"
    )


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(read(spark, sf_dir, "documents"), known_licenses(spark))


def _sql_canonical(text: str) -> str:
    out = f"lower(coalesce({text}, ''))"
    out = f"regexp_replace({out}, '{COPYRIGHT_LINE}', ' ', 'g')"
    out = f"trim(regexp_replace({out}, '{NOT_WORD}', ' ', 'g'))"
    for old, new in SPELLINGS:
        out = f"replace({out}, '{old}', '{new}')"
    return out


def _sql_known() -> str:
    quoted = ", ".join("('" + i + "', '" + t.replace("'", "''") + "')" for i, t in [*KNOWN, *full_texts()])
    return f"(VALUES {quoted}) AS k(license_id, body)"


OP5_SQL = f"""
WITH known AS (
  SELECT sha256(form) AS known_sha256, min(license_id) AS license_id
  FROM (SELECT license_id, {_sql_canonical("body")} AS form FROM {_sql_known()}) WHERE form != '' GROUP BY 1),
d AS (SELECT doc_id, sha256({_sql_canonical("text")}) AS canonical_sha256 FROM documents)
SELECT doc_id, canonical_sha256, license_id FROM d LEFT JOIN known ON canonical_sha256 = known_sha256
"""
