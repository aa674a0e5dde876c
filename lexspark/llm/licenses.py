"""License scans by sparse TF-IDF, and inheritance from the nearest ancestor folder.

SPDX tags and licence labels (``License: MIT OR Apache-2.0``) are read by name, with their
operators, and so are short names after "under" (GPLv3); a sentence that denies a licence
("not released under") declares none. Of every text that names or grants a licence, the whole text and
its paragraphs (without comment marks) are compared with whole licence texts and standard
headers from TEXT_THRESHOLD on, and its sentences with declarations. Their term vectors (raw counts
times smoothed idf over the templates) are compared with those of the templates by
cosine; the best template of THRESHOLD or more is the licence of the sentence, the best
sentence gives the licence of the file. A file that is named like one or that
consists of licence sentences to FILE_SHARE of its words is a licence file and
speaks for its folder. A file without a licence of its own takes that of the nearest
folder above it that has one, found by joining its ancestor paths to the folders.

All steps are DataFrame functions. Only terms, hashes and paths are shuffled, no texts; the
templates are a fixed table. A unit that occurs in many files has the vector of one of
them times their number, so its cosine is the same and copies need no removal.

Defined cases: a null or blank text has no licence of its own; a null path has no
folder and inherits nothing; ties go to the first template by name, and in a folder to
the best score, then name; rows of equal path and text count once, and each gets the
result; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from importlib import resources

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.session import cut_lineage

THRESHOLD, TEXT_THRESHOLD, FILE_SHARE = 0.6, 0.85, 0.5

# Licence names and the sentences by which files declare them.
TEMPLATES = [
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License, CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0 Universal license."),
    ("EPL-2.0", "Made available under the terms of the Eclipse Public License, version 2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Released under the ISC License."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This source code form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("Unlicense", "Released into the public domain under the Unlicense."),
]
_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS"
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_FOLDER = resources.files("lexspark.llm") / "license_texts"
_TEXTS = {f.name.removesuffix(".txt"): f.read_text("utf-8") for f in sorted(_FOLDER.iterdir(), key=lambda f: f.name)}
# whole licences and standard headers; AGPL-3.0 is told from GPL-3.0 by its name
TEXTS = [
    *_TEXTS.items(),
    ("AGPL-3.0", _TEXTS["GPL-3.0"].replace("GNU General", "GNU Affero General").replace("GNU GENERAL", "GNU AFFERO GENERAL")),
    ("AGPL-3.0", _GNU.format("Affero General", 3)), ("GPL-2.0", _GNU.format("General", 2)), ("GPL-3.0", _GNU.format("General", 3)),
    ("LGPL-2.1", _GNU.format("Lesser General", 2.1)), ("LGPL-3.0", _GNU.format("Lesser General", 3)),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("BSD-2-Clause", _BSD + _BSD_END), ("BSD-3-Clause", _BSD + _BSD_3 + _BSD_END),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY + " OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MIT", _WARRANTY + " OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]
NAMES_A_LICENSE = r"(?i)licen[cs]e|\bcc by|\bspdx|public domain|copyright|redistribution and use|permission (?:is hereby|to use)|free software|without warranty|gpl|under (?:the )?(?:terms of (?:the )?)?(?:mit|isc|bsd|apache|mpl|epl|cc|[23][ -]clause|unlicense)\b"
_EXPRESSION = r"\(*[A-Za-z0-9.+-]+\)*(?:[ \t]+(?:OR|AND|WITH)[ \t]+\(*[A-Za-z0-9.+-]+\)*)*"
TAG = rf"(?i:SPDX-License-Identifier):\s*({_EXPRESSION})"
LABEL = rf"(?i:\blicen[cs]e)[\"']?\s*[:=]\s*[\"']?({_EXPRESSION})"
# short names after "under"; blanks, hyphens, "v" and "version" do not tell them apart
UNDER = (
    r"(?i)\bunder\s+(?:the\s+)?(?:terms\s+of\s+(?:the\s+)?)?(?:gnu\s+)?("
    r"[al]?gpl[\s,-]*(?:v|version\s+)?\s*[23](?:\.[01])?|(?:apache|mpl|epl)(?:\s+license)?[\s,-]*(?:v|version\s+)?\s*[12](?:\.[01])?|"
    r"mit|isc|unlicense|bsd[\s-][23][\s-]clause|[23][\s-]clause\s+bsd|cc[\s-]by(?:[\s-](?:nc|sa))?[\s-]4\.0)(?![\w-])")
_SAME = r"version|license|[\s,v-]"
# What is left of a short name, and its licence.
SHORT_NAMES = {
    "agpl3": "AGPL-3.0", "agpl3.0": "AGPL-3.0", "apache2": "Apache-2.0", "apache2.0": "Apache-2.0", "bsd2clause": "BSD-2-Clause", "2clausebsd": "BSD-2-Clause",
    "bsd3clause": "BSD-3-Clause", "3clausebsd": "BSD-3-Clause", "ccby4.0": "CC-BY-4.0", "ccbync4.0": "CC-BY-NC-4.0", "ccbysa4.0": "CC-BY-SA-4.0", "epl2": "EPL-2.0",
    "epl2.0": "EPL-2.0", "gpl2": "GPL-2.0", "gpl2.0": "GPL-2.0", "gpl3": "GPL-3.0", "gpl3.0": "GPL-3.0", "isc": "ISC", "lgpl2.1": "LGPL-2.1", "lgpl3": "LGPL-3.0",
    "lgpl3.0": "LGPL-3.0", "mit": "MIT", "mpl2": "MPL-2.0", "mpl2.0": "MPL-2.0", "unlicense": "Unlicense",
}
DENIES = r"(?i)\b(?:not|never|neither|no longer|isn't|aren't)\b[^.;,]{0,40}\b(?:licen[cs]ed|released|distributed|available|covered|published)\b"
COMMENT = r"(?m)^[ \t]*(?://+|/?\*+/?|#+|--+|;+)[ \t]?"
TERM = r"[a-z0-9]+([.][a-z0-9]+)*"


def _terms(sentence: Column) -> Column:
    return F.regexp_extract_all(F.lower(sentence), F.lit(TERM), F.lit(0))


def _map(names: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in names.items() for x in pair])


def _declared(unit: Column) -> Column:
    """The licence, or expression of licences, that a line states by name; null if none is known."""
    names = {n.lower() + end: n for n in sorted({n for n, _ in TEMPLATES + TEXTS}) for end in ("", "-only", "-or-later", "+")}
    stated = F.coalesce(*[F.nullif(F.regexp_extract(unit, pattern, 1), F.lit("")) for pattern in (TAG, LABEL)])
    parts = F.transform(F.regexp_extract_all(stated, F.lit("[A-Za-z0-9.+-]+"), F.lit(0)), lambda x: F.regexp_replace(x, r"\.+$", ""))
    known = F.transform(parts, lambda x: F.try_element_at(_map(names), F.lower(x)))
    expression = F.when(F.exists(known, lambda x: x.isNotNull()), F.array_join(F.zip_with(known, parts, lambda name, part: F.coalesce(name, part)), " "))
    short = F.try_element_at(_map(SHORT_NAMES), F.regexp_replace(F.lower(F.regexp_extract(unit, UNDER, 1)), _SAME, ""))
    return F.when(stated.isNotNull(), expression).otherwise(short)


def _best(units: DataFrame, templates: list[tuple[str, str]], threshold: float) -> DataFrame:
    """For each distinct ``unit`` the best licence by cosine, if it reaches ``threshold``."""
    table = units.sparkSession.createDataFrame([(i, *t) for i, t in enumerate(templates)], "id int, license string, template string")
    counted = table.select("id", "license", F.explode(_terms(F.col("template"))).alias("term")).groupBy("id", "license", "term").agg(F.count("*").alias("tf"))
    df = counted.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((1 + F.lit(len(templates))) / (1 + F.coalesce(F.col("df"), F.lit(0)))) + 1
    weighted = counted.join(F.broadcast(df), "term").select("id", "license", "term", (F.col("tf") * idf).alias("w"))
    norms = weighted.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    weighted = weighted.join(F.broadcast(norms), "id").groupBy("term").agg(F.collect_list(F.struct("id", "license", (F.col("w") / F.col("norm")).alias("w"))).alias("in_templates"))
    # one row per template term, fixed: written out, so that no later plan holds the steps to it
    weighted = cut_lineage(weighted.join(F.broadcast(df), "term"))
    key = F.xxhash64("unit").alias("key")
    vectors = units.select(key, F.explode(_terms(F.col("unit"))).alias("term")).groupBy("key", "term").agg(F.count("*").alias("tf"))
    vectors = vectors.join(F.broadcast(weighted), "term", "left").withColumn("w", F.col("tf") * idf)
    norm = vectors.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = vectors.select("key", "w", F.explode("in_templates").alias("t")).groupBy("key", "t.id", "t.license").agg(F.sum(F.col("w") * F.col("t.w")).alias("dot"))
    return (
        dots.join(norm, "key").withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("cosine") >= threshold)
        .groupBy("key").agg(F.max_by("license", F.struct("cosine", _descending("license"))).alias("license"), F.max("cosine").alias("cosine"))
    )


def scan(files: DataFrame) -> DataFrame:
    """For every row of ``files`` (path, text): own licence and score, the licence that holds, and the folder it comes from."""
    spark = files.sparkSession
    named = files.select("path", "text").where(F.col("text").rlike(NAMES_A_LICENSE))
    base = [F.col("path"), F.xxhash64("text").alias("text_key"), F.size(_terms(F.col("text"))).alias("file_terms")]
    lines = named.select(*base, F.explode(F.split(F.regexp_replace("text", r"([.!?]) ", "$1\n"), "\n")).alias("unit")).where(F.col("unit").rlike(NAMES_A_LICENSE))
    plain = F.regexp_replace("text", COMMENT, "")
    blocks = F.array_distinct(F.concat(F.array(plain), F.split(plain, r"\n[ \t]*\n")))
    whole = named.select(*base, F.explode(blocks).alias("unit")).where(F.col("unit").rlike(NAMES_A_LICENSE))
    lines = lines.where(~F.col("unit").rlike(DENIES)).withColumn("declared", _declared(F.col("unit")))
    names = lines.where("declared IS NOT NULL").select(F.xxhash64("unit").alias("key"), F.col("declared").alias("license"), F.lit(1.0).alias("cosine")).distinct()
    tagged = F.col("unit").rlike(TAG) | F.col("declared").isNotNull()
    sentences = lines.drop("declared").withColumn("kind", F.lit(0)).unionByName(whole.withColumn("kind", F.lit(1))).withColumn("key", F.xxhash64("unit"))
    best = names.unionByName(_best(lines.where(~tagged), TEMPLATES, THRESHOLD)).withColumn("kind", F.lit(0))
    best = cut_lineage(best.unionByName(_best(whole, TEXTS, TEXT_THRESHOLD).withColumn("kind", F.lit(1))))
    # one result per file, equal rows counting once; four steps read it, so it is written out
    per_file = cut_lineage(
        sentences.select("path", "text_key", "file_terms", "kind", "key", F.size(_terms(F.col("unit"))).alias("terms")).distinct()
        .join(best, ["kind", "key"])
        .groupBy("path", "text_key", "file_terms").agg(
            F.max_by("license", F.struct("cosine", _descending("license"))).alias("own_license"), F.max("cosine").alias("own_score"),
            F.greatest(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("terms"))), F.lit(0)) for k in (0, 1)]).alias("license_terms"))
    )
    base = F.element_at(F.split("path", "/"), -1)
    is_file = F.lower(base).rlike(r"^(licen[cs]e|copying|notice)") | (F.col("license_terms") >= FILE_SHARE * F.col("file_terms"))
    folders = (
        per_file.where(F.col("path").isNotNull() & is_file).select(_parent(F.col("path")).alias("folder"), "own_license", "own_score")
        .groupBy("folder").agg(F.max_by("own_license", F.struct("own_score", _descending("own_license"))).alias("folder_license"))
    )
    rows = files.select(*[c for c in files.columns if c != "text"], F.xxhash64("text").alias("text_key"))
    own = per_file.select(F.col("path").alias("p"), F.col("text_key").alias("k"), "own_license", "own_score")
    rows = rows.join(own, rows["path"].eqNullSafe(own["p"]) & (rows["text_key"] == own["k"]), "left").drop("p", "k", "text_key")
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    heirs = rows.where("own_license IS NULL AND path IS NOT NULL").select("path").distinct()
    inherited = (
        heirs.select("path", F.posexplode(above).alias("depth", "folder")).join(folders, "folder")
        .groupBy("path").agg(F.max(F.struct("depth", "folder", "folder_license")).alias("from"))
        .select(F.col("path").alias("heir"), F.col("from.folder").alias("from_folder"), F.col("from.folder_license").alias("folder_license"))
    )
    joined = rows.join(inherited, (rows["path"] == inherited["heir"]) & rows["own_license"].isNull(), "left").drop("heir")
    return joined.withColumn("license", F.coalesce("own_license", "folder_license")).drop("folder_license")


def _parent(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/")


def _descending(name: str) -> Column:
    """A value that is greater for names that come earlier."""
    return F.translate(F.rpad(F.col(name), 24, " "), _LETTERS, _LETTERS[::-1])


_LETTERS = "".join(sorted(" -.0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))
