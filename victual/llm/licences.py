"""License scans: canonical digests of whole texts, joined to known licences.

A text is canonical when it is lower-cased, its copyright lines are gone,
equivalent spellings are one, and all that isn't a letter or digit (of any
script) is a single space, so that wrapping, quotes and dashes don't matter.  Texts are compared whole, by the SHA-256 of their canonical form: the
text of a document, and each of its lines, as notices mostly are a line.
Everything is built-in expressions; the catalogue is broadcast, and its size
is checked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import partial, reduce
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: A larger catalogue is joined by shuffle instead of broadcast.
BROADCAST_TEXTS = 100_000

#: Licence texts of the folder ``texts`` and the titles that are often put before them.
#: Public licence texts and titles in common use.
TITLES = {
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD"),
    "Apache-2.0": (),
    "Artistic-1.0": (),
    "BSD-2-Clause": ("BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "The BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "The BSD 3-Clause License", "New BSD License"),
    "BSL-1.0": (),
    "CC-BY-SA-4.0": ("Creative Commons Attribution-ShareAlike 4.0 International",),
    "CC0-1.0": (),
    "GPL-1.0": (),
    "GPL-2.0": (),
    "GPL-3.0": (),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "LGPL-2.0": (),
    "LGPL-2.1": (),
    "LGPL-3.0": (),
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT", "MIT License (MIT)", "Expat License", "The Expat License"),
    "MPL-1.1": (),
    "MPL-2.0": (),
    "OFL-1.1": (),
    "Unlicense": ("The Unlicense",),
    "Zlib": ("zlib License", "The zlib License"),
}
#: How the identifiers of these end; others are the licence's name.
SPDX = {name: ("-only", "-or-later") for name in ("GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")}
TITLES = {name: (*titles, *(f"SPDX-License-Identifier: {name}{end}" for end in SPDX.get(name, ("",)))) for name, titles in TITLES.items()}
#: What ends the terms, before an appendix that is often left out.
END = "END OF TERMS AND CONDITIONS"
RESERVED = "All rights reserved."
#: (licence, notice).  Fixed values: notices in common use.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("Unlicense", "SPDX-License-Identifier: Unlicense"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("all-rights-reserved", RESERVED),
    *((name if end == "-only" else name + end, f"SPDX-License-Identifier: {name}{end}") for name, ends in SPDX.items() for end in ends),
    *((name, f"SPDX-License-Identifier: {name}") for name in ("0BSD", "BSD-4-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "EPL-1.0", "EPL-2.0", "MPL-1.1", "NCSA", "OFL-1.1", "Zlib")),
)
#: What "Copyright" is followed by, beginning with a capital, where it isn't a holder's name.
NO_HOLDERS = ("Act", "And", "Disclaimer", "Holder", "Interest", "Law", "License", "Licence", "Notice", "Owner", "Permission", "Right", "Statement", "Treat")
#: A holder without a sign or year, over text as it is written.
HOLDER = r"(^|\n)[^\p{L}\p{N}\n(©]*(Portions[ \t]+)?Copyright[ \t]+\p{Lu}[^\n]*"
#: (pattern, replacement, texts of which one is in whatever matches), in order, over lower-cased text.  Java's and RE2's engines read them alike.
PATTERNS = (
    # The notice at a copyright line's end stays.
    (r"all rights reserved", "\nall rights reserved", ("all rights reserved",)),
    # The foundation's address, which moved.
    (r"[0-9]+\s+(franklin\s+st|temple\s+pl)[^.;]{0,80}?usa", " ", ("franklin", "temple")),
    # Copyright lines: the word or a sign, then a sign, a year, a placeholder or holders that are named as such.
    # "Copyright notice" and a point (c) of a list are no copyright line.  Holders go on in the next line after a comma, "and" or "&".
    (
        r"(^|\n)[^\p{L}\p{N}\n(©]*(portions[ \t]+)?((copyright|\(c\)|©)[ \t,:]*(\(c\)|©|[0-9]{4}|[\[<{]|by[ \t]|the[ \t][^\n]*(authors|contributors|foundation|regents))|©)([^\n]*(,|&|[ \t]and)[ \t]*\n)*[^\n]*",
        " ",
        ("copyright", "(c)", "©"),
    ),
    (r"[^\p{L}\p{N}]+", " ", ()),
    (r"(all rights reserved )+all rights reserved", "all rights reserved", ("all rights reserved all rights reserved",)),
)
#: (spelling, equivalent), in order, over words between single spaces.  Fixed values: spellings
#: that licence texts use for each other.
SPELLINGS = (
    ("licenc", "licens"),
    (" sub licens", " sublicens"),
    (" non commercial", " noncommercial"),
    (" non infringement", " noninfringement"),
    ("merchantib", "merchantab"),
    ("copyright owner", "copyright holder"),
    ("acknowledgement", "acknowledgment"),
    ("organis", "organiz"),
    ("recognis", "recogniz"),
    ("favour", "favor"),
    (" https ", " http "),
    (" version ", " v "),
)


def text_of(name: str) -> str:
    """A licence's text in the folder ``texts``, which may be in a zip."""
    return files(__package__).joinpath("texts", f"{name}.txt").read_text("utf-8")


def variants(name: str, text: str, titles: Iterable[str] = ()) -> list[tuple[str, str]]:
    """(licence, text) with and without titles, "all rights reserved" below them, and the appendix."""
    bodies = [text] + ([text[: text.index(END)], text[: text.index(END) + len(END)]] if END in text else [])
    return [(name, f"{title}\n{reserved}\n{body}") for body in bodies for title in ("", *titles) for reserved in ("", RESERVED)]


def catalogue() -> list[tuple[str, str]]:
    """(licence, text) of all known texts and notices."""
    texts = [v for name, titles in TITLES.items() for v in variants(name, text_of(name), titles)]
    # An older wording.
    texts += variants("ISC", text_of("ISC").replace("and/or distribute", "and distribute"), TITLES["ISC"])
    return [*texts, *NOTICES]


def _where(text: Column, marks: Iterable[str], change: Callable[[Column], Column]) -> Column:
    """``text`` changed, if one of ``marks`` is in it; it is named once, and so computed once."""
    def of(t: Column) -> Column:
        return F.when(reduce(Column.__or__, [F.contains(t, F.lit(m)) for m in marks]), change(t)).otherwise(t)
    return F.get(F.transform(F.array(text), of), F.lit(0))


def _without_holders(text: Column) -> Column:
    for word in NO_HOLDERS:
        text = F.replace(text, F.lit(f"Copyright {word}"), F.lit(f"copyright {word}"))
    return F.regexp_replace(text, HOLDER, " ")


def canonical(text: Column) -> Column:
    """Lower-cased words between single spaces, without copyright lines, in one of equivalent spellings."""
    out = F.lower(_where(text, ("Copyright",), _without_holders))
    for pattern, replacement, marks in PATTERNS:
        change = partial(_replaced, pattern=pattern, replacement=replacement)
        out = _where(out, marks, change) if marks else change(out)
    out = F.concat(F.lit(" "), out, F.lit(" "))
    for spelling, equivalent in SPELLINGS:
        out = F.replace(out, F.lit(spelling), F.lit(equivalent))
    return F.trim(out)


def _replaced(text: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(text, pattern, replacement)


def _digest(form: Column) -> Column:
    """Never null, so that a join adds no test that would compute the form once more."""
    return F.coalesce(F.sha2(form.cast("binary"), 256), F.lit(""))


def known_digests(spark: SparkSession, known: Iterable[tuple[str, str]]) -> DataFrame:
    """``license, digest``: of a digest that two licences share, the first by name."""
    texts = spark.createDataFrame(list(known), "license string, text string").select("license", canonical(F.col("text")).alias("form"))
    return texts.where("form <> ''").groupBy(_digest(F.col("form")).alias("digest")).agg(F.min("license").alias("license"))


def scan_licenses(docs: DataFrame, texts: Iterable[tuple[str, str]] | None = None) -> DataFrame:
    """``doc_id, license, scope, hits``: licences that each document is or holds as a line.

    ``texts`` are (licence, text), those of ``catalogue`` if not given.  ``scope`` is
    ``document`` where the whole text is a licence's, ``line`` where a line of it is;
    a licence that stands within a longer text is found by its notice only.  Null and
    empty texts match nothing, nor do lines without letters or digits.  A text of any
    length is read whole.  Of two licences with one text the first by name is given.
    Rows that repeat a doc_id are counted together; an empty table gives an empty
    result; extra columns are ignored.
    """
    texts = catalogue() if texts is None else list(texts)
    known = known_digests(docs.sparkSession, texts)
    if len(texts) <= BROADCAST_TEXTS:
        known = F.broadcast(known)
    text = F.coalesce("text", F.lit(""))
    # The whole text and its lines, in one pass over the table.
    units = docs.select("doc_id", F.posexplode(F.concat(F.array(text), F.split(text, "\n"))).alias("_at", "unit"))
    units = units.select("doc_id", F.when(F.col("_at") == 0, "document").otherwise("line").alias("scope"), _digest(canonical(F.col("unit"))).alias("digest"))
    found = units.join(known, "digest")
    return found.groupBy("doc_id", "license", "scope").agg(F.count("*").alias("hits"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The known licences of every document; see ``scan_licenses`` for the edge cases."""
    return scan_licenses(table(spark, sf_dir, "documents"))


def _canonical_sql(text: str) -> str:
    out = text
    for word in NO_HOLDERS:
        out = f"replace({out}, 'Copyright {word}', 'copyright {word}')"
    out = f"lower(regexp_replace({out}, '{HOLDER}', ' ', 'g'))"
    for pattern, replacement, _ in PATTERNS:
        out = f"regexp_replace({out}, '{pattern}', '{replacement}', 'g')"
    out = f"' ' || {out} || ' '"
    for spelling, equivalent in SPELLINGS:
        out = f"replace({out}, '{spelling}', '{equivalent}')"
    return f"trim({out})"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: Texts once each; their variants are made by joins, as ``variants`` makes them.
_TEXTS = [(n, text_of(n)) for n in TITLES] + [("ISC", text_of("ISC").replace("and/or distribute", "and distribute"))]
_TITLED = ", ".join(f"({_quoted(n)}, {_quoted(t)})" for n, titles in TITLES.items() for t in ("", *titles))
OP7_SQL = f"""
WITH x AS (
  SELECT * FROM (VALUES {", ".join(f"({_quoted(n)}, {_quoted(t)})" for n, t in _TEXTS)}) v(license, body)
), y AS (
  SELECT license, body FROM x UNION ALL
  SELECT license, left(body, strpos(body, '{END}') - 1) FROM x WHERE contains(body, '{END}') UNION ALL
  SELECT license, left(body, strpos(body, '{END}') + {len(END) - 1}) FROM x WHERE contains(body, '{END}')
), z AS (
  SELECT y.license, title || chr(10) || reserved || chr(10) || body AS text
  FROM y JOIN (VALUES {_TITLED}) t(license, title) ON t.license = y.license, (VALUES (''), ('{RESERVED}')) r(reserved)
  UNION ALL SELECT * FROM (VALUES {", ".join(f"({_quoted(n)}, {_quoted(t)})" for n, t in NOTICES)})
), k AS (
  SELECT sha256({_canonical_sql('text')}) AS digest, min(license) AS license FROM z GROUP BY 1
), u AS (
  SELECT doc_id, 'document' AS scope, coalesce(text, '') AS unit FROM documents
  UNION ALL
  SELECT doc_id, 'line', unnest(string_split(coalesce(text, ''), chr(10))) FROM documents
), f AS (
  SELECT doc_id, scope, {_canonical_sql('unit')} AS form FROM u
)
SELECT doc_id, license, scope, count(*) AS hits
FROM f JOIN k ON sha256(form) = digest WHERE form <> '' GROUP BY ALL
"""
