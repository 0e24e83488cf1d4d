"""Licence scan by canonical digests, in DataFrame functions only.

A text's canonical form: lower case; copyright and all-rights-reserved lines
taken out; equivalent spellings brought to one (`licence`, `sub-license`,
`(c)`, `http://`/`https://`, ...); everything but letters and digits of any
script becomes one space. Its SHA-256 is looked up, by a hash join, among the
digests of known licence texts, which go through the same expressions.

Units are whole texts and, in `scan`, each line of a text as well, since
documents often carry a one-line notice. A line with a copyright mark may hold
a whole flattened licence: besides without that line, the text is looked up
without the copyright clause only, and so is the line.

Known are the notices of KNOWN and the full texts of the folder license_texts,
with and without title line, appendix and clause numbers, wrapped or flattened.

Null, empty and blank texts have no canonical form and match nothing. Each
input row gives one row, repeated rows too; several known texts with one digest
give the licence that sorts first.
"""

from __future__ import annotations

import re
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lines that vary between copies of one licence.
COPYRIGHT_LINE = r"(?m)^[^\n]*(copyright +(\(c\)|©|[0-9]{4})|(\(c\)|©) *[0-9]{4}|all rights reserved)[^\n]*$"

#: In lower-cased text: what a copyright clause begins with, and what commonly follows one in a flattened licence.
MARK = r"(copyright +(\(c\)|©|[0-9]{4})|(\(c\)|©) *[0-9]{4})"
OPENING = r"(all rights reserved|permission (is hereby granted|to use)|redistribution and use|licen[sc]ed under|released under|everyone is permitted|this (software|work|program|library) is)"

#: Set before each opening, so that a text falls into pieces that end at an opening (with the seam) or at a line end.
SEAM = "\x01"
PIECE_END = r"(?<=[\n\x01])"

#: The clause alone: up to the opening that ends its piece, else to the end of its sentence or line. Each piece is read once.
CLAUSE_TO_OPENING = rf"(?s){MARK}.*|all rights reserved\.?"
CLAUSE_OF_SENTENCE = rf"{MARK}[^\n.]*\.?|all rights reserved\.?"

#: (pattern, replacement), applied in this order to lower-cased text.
SPELLINGS = (
    (r"licenc(e|ed|es|ing|ee|or)\b", r"licens$1"),
    (r"sub-licens", r"sublicens"),
    (r"https?://(www\.)?", r""),
    (r"non-commercial", r"noncommercial"),
    (r"merchantib", r"merchantab"),
    (r"version +([0-9]+)\.0\b", r"version $1"),
    (r"\bv(ersion|\.)? *([0-9]+)\b", r"version $2"),
)
NOT_WORD = r"[^\p{L}\p{N}]+"

#: Known texts: identifier and text. Callers add their own as a table of the same two columns.
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("0BSD", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
)

#: Titles that common copies put before the text.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "0BSD License", "BSD Zero Clause License (0BSD)"),
    "BSD-2-Clause": ("BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "The 2-Clause BSD License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "The 3-Clause BSD License", "New BSD License", "Modified BSD License", "BSD License"),
    "Unlicense": ("The Unlicense", "Unlicense"),
}
BSD_HOLDERS = (("COPYRIGHT HOLDER OR", "COPYRIGHT HOLDERS OR"), ("COPYRIGHT HOLDER OR", "COPYRIGHT OWNER OR"))
FSF_ADDRESSES = (("51 Franklin Street, Fifth Floor, Boston, MA", "59 Temple Place, Suite 330, Boston, MA"), ("02110-1301", "02111-1307"))
END_OF_TERMS = "END OF TERMS AND CONDITIONS"


def full_texts() -> list[tuple[str, str]]:
    """(license_id, text) of the full texts and their common variants."""
    folder = files("portlens.llm") / "license_texts"
    base = [(f.name.removesuffix(".txt"), f.read_text(encoding="utf-8")) for f in folder.iterdir() if f.name.endswith(".txt")]
    base += [(i, t) for i, t in KNOWN if t.startswith("Permission ")]
    out = set()
    for name, text in base:
        forms = {text}
        if name.startswith("BSD-"):
            forms |= {text.replace(a, b) for a, b in BSD_HOLDERS}
            forms |= {re.sub(r"(?m)^\s*[1-3]\.\s", "* ", t) for t in forms}
        if "Free Software Foundation" in text:
            old = text
            for a, b in FSF_ADDRESSES:
                old = old.replace(a, b)
            forms.add(old)
        if END_OF_TERMS in text:
            forms |= {t.split(END_OF_TERMS)[0] + tail for t in forms for tail in ("", END_OF_TERMS)}
        forms |= {f"{title}\n\n{t}" for title in TITLES.get(name, ()) for t in forms}
        out |= {(name, t) for t in forms} | {(name, " ".join(t.split())) for t in forms}
    return sorted(out)


def _one_spelling(text: Column) -> Column:
    for pattern, to in SPELLINGS:
        text = F.regexp_replace(text, pattern, to)
    return text


def cleaned(text: Column) -> Column:
    """Lower-cased text without copyright lines, in one spelling; line ends stay."""
    return _one_spelling(F.regexp_replace(F.lower(text), COPYRIGHT_LINE, ""))


def clause_cleaned(text: Column) -> Column:
    """The same without the copyright clauses only; null for a text without any."""
    low = F.lower(text)
    seamed = F.regexp_replace(F.translate(low, SEAM, " "), OPENING, f"{SEAM}$0")
    without = lambda p: F.when(p.endswith(SEAM), F.regexp_replace(p, CLAUSE_TO_OPENING, "")).otherwise(F.regexp_replace(p, CLAUSE_OF_SENTENCE, ""))
    left = F.array_join(F.transform(F.split(seamed, PIECE_END), without), "")
    return F.when(low.rlike(COPYRIGHT_LINE), _one_spelling(F.translate(left, SEAM, "")))


def words_only(text: Column) -> Column:
    """Canonical form of a cleaned text, null if nothing is left."""
    out = F.trim(F.regexp_replace(text, NOT_WORD, " "))
    return F.when(out != "", out)


def digest(text: Column) -> Column:
    """SHA-256 (hex) of a text's canonical form, null if it has none."""
    return F.sha2(words_only(cleaned(text)), 256)


def known_texts(spark: SparkSession) -> DataFrame:
    """(license_id, text) of KNOWN and the full texts."""
    return spark.createDataFrame([*KNOWN, *full_texts()], "license_id string, text string")


def builtin_digests(spark: SparkSession) -> DataFrame:
    """known_digests of the built-in texts as literals: some hundred short rows, so that the join's plan sees their size."""
    rows = known_digests(known_texts(spark)).collect()
    return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(r["digest"]).alias("digest"), F.lit(r["license_id"]).alias("license_id")) for r in rows])))


def known_digests(known: DataFrame) -> DataFrame:
    """(digest, license_id), one row for each digest."""
    both = F.array(digest(F.col("text")), F.sha2(words_only(clause_cleaned(F.col("text"))), 256))
    rows = known.select(F.explode(both).alias("digest"), "license_id").filter("digest is not null")
    return rows.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest, license_id of the whole text, n_license_lines and line_licenses (sorted, joined by commas).

    The join's small side is the table of known digests; whether it is
    broadcast is left to its size.
    """
    known = builtin_digests(docs.sparkSession) if known is None else known_digests(known)
    text = F.col(text_col)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), cleaned(text).alias("t"), clause_cleaned(text).alias("c"))
    none = F.array().cast("array<struct<line:int,unit:string>>")
    whole = F.array(F.struct(F.lit(0).alias("line"), F.col("t").alias("unit")))
    lines = F.transform(F.split("t", "\n"), lambda x, i: F.struct((i + 1).alias("line"), x.alias("unit")))
    clause = F.array(F.struct(F.lit(-1).alias("line"), F.col("c").alias("unit")))
    # a line that `cleaned` took out, without its clause only
    alone = F.zip_with(F.split("c", "\n"), F.split("t", "\n"), lambda x, y: F.when(F.trim(y) == "", x))
    taken = F.filter(F.transform(alone, lambda x, i: F.struct((i + 1).alias("line"), x.alias("unit"))), lambda u: u["unit"].isNotNull())
    extra = F.when(F.col("c").isNotNull(), F.concat(clause, taken))
    units = rows.select("row", "doc_id", F.inline(F.concat(whole, F.coalesce(lines, none), F.coalesce(extra, none))))
    units = units.select("row", "doc_id", "line", F.sha2(words_only(F.col("unit")), 256).alias("digest"))
    found = units.join(known, "digest", "left")
    on_line = F.col("license_id").isNotNull() & (F.col("line") > 0)
    of = lambda c, line: F.max(F.when(F.col("line") == line, F.col(c)))
    return (
        found.groupBy("row", "doc_id")
        .agg(
            F.coalesce(of("digest", 0), of("digest", -1)).alias("digest"),
            F.coalesce(of("license_id", 0), of("license_id", -1)).alias("license_id"),
            F.count(F.when(on_line, 1)).alias("n_license_lines"),
            F.array_join(F.sort_array(F.collect_set(F.when(on_line, F.col("license_id")))), ",").alias("line_licenses"),
        )
        .drop("row")
    )


def scan_sql() -> str:
    """The same over DuckDB's `documents`, for the texts of KNOWN and without the lookup by clause."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    clean = f"regexp_replace(lower(text), {quote(COPYRIGHT_LINE)}, '', 'g')"
    for pattern, to in SPELLINGS:
        clean = f"regexp_replace({clean}, {quote(pattern)}, {quote(to.replace('$', chr(92)))}, 'g')"
    form = lambda c: f"nullif(trim(regexp_replace({c}, {quote(NOT_WORD)}, ' ', 'g'), ' '), '')"
    values = ", ".join(f"({quote(i)}, {quote(t)})" for i, t in KNOWN)
    return f"""
with known as (
  select sha256({form("t")}) as digest, min(license_id) as license_id
  from (select license_id, {clean} as t from (values {values}) as v(license_id, text)) group by 1
), cleaned as (select row_number() over () as r, doc_id, {clean} as t from documents),
whole as (select r, doc_id, sha256({form("t")}) as digest from cleaned),
line as (select r, sha256({form("unit")}) as digest from (select r, unnest(string_split(t, chr(10))) as unit from cleaned)),
hits as (select r, count(*) as n, array_to_string(list_sort(list(distinct license_id)), ',') as ids from line join known using (digest) group by r)
select doc_id, digest, license_id, coalesce(n, 0) as n_license_lines, coalesce(ids, '') as line_licenses
from whole left join known using (digest) left join hits using (r)
"""
