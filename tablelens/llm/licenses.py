"""Licence scan: digests of whole, canonical texts.

A text is brought to a canonical form (lower case, copyright lines dropped,
equivalent spellings made one, every run of anything but ASCII letters and
digits a single space), and the SHA-256 of that form is joined with the digests
of known licences.  Only Spark's own expressions are used.

Special cases: null, empty and word-less texts have the empty form, which never
matches; equal rows are matched each; texts of any length are digested whole; a
known licence listed twice counts once, under its smallest name; other columns
are carried along, and those with the name of a column written here are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.llm.common import quoted, without

# Spellings that licence texts use for the same word, after lower-casing.
EQUIVALENT_SPELLINGS = [
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("sub license", "sublicense"),
    ("sub licence", "sublicense"),
    ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"),
    ("per cent", "percent"),
    ("organisation", "organization"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("favour", "favor"),
    ("fulfil", "fulfill"),
    ("judgement", "judgment"),
    ("initialise", "initialize"),
    ("https", "http"),
]

# Texts of short public licences and of the usual one-line notices.
KNOWN_LICENSES = {
    "MIT": """MIT License

Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
""",
    "ISC": """ISC License

Copyright (c) <year> <copyright holders>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
""",
    "BSD-2-Clause": """Copyright (c) <year> <owner>

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>
""",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "MIT-notice": "Released under the MIT License.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
}

#: A line that begins like this and holds a year, a sign or a placeholder is a copyright line.
COPYRIGHT_LINE = r"(^|\n)[^a-z0-9\n]*(copyright|\(c\)|©)[^a-z\n]*(copyright[^a-z\n]*)?(\(c\)|©|[0-9]|<)[^\n]*"


def canonical(text: Column) -> Column:
    """The canonical form of a text; null has the empty form."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ\r", "abcdefghijklmnopqrstuvwxyz\n")
    # a second pass for the line after a dropped one, whose line break went with it
    for _ in range(2):
        low = F.regexp_replace(low, COPYRIGHT_LINE, "\n")
    spaced = F.trim(F.regexp_replace(low, "[^a-z0-9]+", " "))
    # a word ends at its border and not with a space, which the next word needs too
    return reduce(lambda form, pair: F.regexp_replace(form, rf"\b{pair[0]}\b", pair[1]), EQUIVALENT_SPELLINGS, spaced)


def digest(text: Column) -> Column:
    """SHA-256 of the canonical form, as hex digits."""
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, known: dict[str, str] | None = None) -> DataFrame:
    """(license_digest, license) of the known licences, made with the same expressions."""
    rows = list((KNOWN_LICENSES if known is None else known).items())
    texts = spark.createDataFrame([], "license string, text string")
    if rows:
        listed = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(text).alias("text")) for name, text in rows])
        texts = spark.range(1).select(F.inline(listed)).where(canonical(F.col("text")) != "")
    return texts.groupBy(digest(F.col("text")).alias("license_digest")).agg(F.min("license").alias("license"))


def known_from_files(spark: SparkSession, path: str) -> DataFrame:
    """(license_digest, license) of whole licence texts, one file each and named after it, from a folder all executors see."""
    files = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.element_at(F.split(F.input_file_name(), "/"), -1).alias("license"))
    return files.where(canonical(F.col("text")) != "").groupBy(digest(F.col("text")).alias("license_digest")).agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: DataFrame, text_col: str = "text") -> DataFrame:
    """The table with license_digest and license (null where the text is no known licence).

    `known` is a table (license_digest, license) of any size; Spark broadcasts
    it if it is small.  Copies of one text are one key, which a skewed join splits.
    """
    out = without(docs, ["license_digest", "license"])
    return out.withColumn("license_digest", digest(quoted(text_col))).join(known, "license_digest", "left")
