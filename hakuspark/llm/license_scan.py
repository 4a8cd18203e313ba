"""License scans: canonical digests of entire texts, hash-joined to digests of known licences.

Two texts are one licence if they agree after lower-casing, dropping copyright lines, turning punctuation and
white space into single blanks and writing equivalent spellings one way. Known texts go through the same
expressions as the documents; of long ones only the digest is kept. A licence within a longer text is not found.

Defined cases: a null text has a null digest and no licence; a text that is empty after normalising has the digest
of the empty string and no licence; repeated rows are each looked up; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hakuspark.llm.common import literal_rows, small, table

# Public licence texts and the notices that stand for a licence.
_MIT = """MIT License
Copyright (c) <year> <copyright holders>
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """ISC License
Copyright (c) <year> <owner>
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZERO_BSD = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZLIB = """zlib License
(C) <year> <owner>
This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
LICENSES = [
    ("MIT", _MIT),
    ("MIT", _MIT.partition("\n")[2]),
    ("ISC", _ISC),
    ("ISC", _ISC.partition("\n")[2]),
    ("0BSD", _ZERO_BSD),
    ("Zlib", _ZLIB),
    ("Zlib", _ZLIB.partition("\n")[2]),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
]
#: Canonical digests of further texts: whole licences as files of systems and packages hold them, and usual headers.
DIGESTS = [
    ("Apache-2.0", "aa350e3db222a5cd6a570f9ebfa1e32bb247ddac8cc4201759d7c0a3dd8440c3"),  # common-licenses/Apache-2.0
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),  # common-licenses/CC0-1.0
    ("GFDL-1.2-only", "29c28288274dd76ef554797c7f537bf13aea3fd3c9771a084296f0fba15c8896"),  # common-licenses/GFDL-1.2
    ("GFDL-1.3-only", "3049129e0035e4e39ecc049acd9ed11c35e888dd3a23252a0ca3cc3a0ca9fe14"),  # common-licenses/GFDL-1.3
    ("GPL-1.0-only", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),  # common-licenses/GPL-1
    ("GPL-2.0-only", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),  # common-licenses/GPL-2
    ("GPL-3.0-only", "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68"),  # common-licenses/GPL-3
    ("LGPL-2.0-only", "77a17c8586ad4a15f4c4a26f2d3ce87ea2e9ddfba1f8d2b714dd33eb7a1f65f6"),  # common-licenses/LGPL-2
    ("LGPL-2.1-only", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),  # common-licenses/LGPL-2.1
    ("LGPL-3.0-only", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),  # common-licenses/LGPL-3
    ("MPL-1.1", "fbe9a0b96f52e03cb474f9a7083781399c011279e85b548118563ec96e659354"),  # common-licenses/MPL-1.1
    ("MPL-2.0", "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9"),  # common-licenses/MPL-2.0
    ("Artistic-1.0-Perl", "50cd294a1f03da474a09c58d35e8078f45a5f25fe34ce03806cf2d892e193184"),  # common-licenses/Artistic
    ("BSD-3-Clause", "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),  # common-licenses/BSD
    ("Apache-2.0", "3d6e6f51aea17643498c15bacdc3eea906392b687dd165fc1720219f310391fa"),  # the text up to the end of terms
    ("Apache-2.0", "7a46cf4a5d56898d746584f4fe57bdf571d600a8f39d21063431d88929f803c7"),  # the header
    ("GPL-2.0-or-later", "3606e919f92e4862a5628788f284c07f5a0ca41b819f88414d7e825dca4facc4"),  # the header
    ("GPL-3.0-or-later", "3e0639e2a9692446a12737e1e8a22455de0cf05c81a22cf39ea6cc1d2e85581b"),  # the header
    ("AGPL-3.0-or-later", "d340001e1ba20cb2d52172dea9fb1fad002623c08c9fc89ae017d99c0671abcf"),  # the header
    ("LGPL-2.1-or-later", "38fd334a43235dc3cc9b4054ff7eda2187759f1748f276e846fe99c0d3225c0f"),  # the header
    ("MPL-2.0", "acb0bece3dc447740b87a4db23e0d425157552e4a33f273241a94444c2368900"),  # the header
    ("Apache-2.0", "4f39a703e8f09470b803dd79d0e954433d6aa3bd76b9376252e91dd4cacfde2a"),  # as in crc32fast-1.5.0
    ("Unlicense", "7e184dc4c06743e99c98ea5fbd4aab98fa65dfcda1d913b491f5e28b89c1c678"),  # as in globset-0.4.18
    ("Apache-2.0", "7ca5f53e3e99ed74ff5613419a81ef667af657ee905635b229dcb035527c94a5"),  # as in getrandom-0.3.3
    ("Apache-2.0", "5a56e289ea148c5f65e04c7ffd28cbd59f5bfa8e0d408002024188fa415069c9"),  # as in rand-0.8.5
    ("BSD-2-Clause", "986c3c3199a93b916c8f2e0aeed57819bcbdcb2cd9d99902dcc9d74b53f93a74"),  # as in zerocopy-derive-0.8.27
    ("BSD-3-Clause", "9b83d3dee0616d07b82a272dd9bf5134a9f402b750f5ee6188458073b0a32ff2"),  # as in ed25519-dalek-2.1.1
    ("BSL-1.0", "5fcf89bde8c0c2deb999f4cc626e1aebf90e80fdc5cd334dae008152ef4a1ded"),  # as in xxhash-rust-0.8.15
]
#: Equivalent spellings after punctuation has become blanks; the right one is kept.
EQUIVALENT = [
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("catalogue", "catalog"),
    ("centre", "center"),
    ("copyright owner", "copyright holder"),
    ("favour", "favor"),
    ("favourite", "favorite"),
    ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("labour", "labor"),
    ("licence", "license"),
    ("licences", "licenses"),
    ("maximise", "maximize"),
    ("modelled", "modeled"),
    ("modelling", "modeling"),
    ("non commercial", "noncommercial"),
    ("offence", "offense"),
    ("optimise", "optimize"),
    ("organisation", "organization"),
    ("organise", "organize"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("sub license", "sublicense"),
    ("sublicence", "sublicense"),
    ("utilisation", "utilization"),
    ("while", "whilst"),
    ("wilful", "willful"),
    ("per cent", "percent"),
    ("noninfringement", "non infringement"),
]
COPYRIGHT_LINE = r"(?m)^[ \t#*/;!-]*(?:copyright[ \t]*(?:\(c\)|©|:|<|\[|[0-9])|\(c\)[ \t]|©|all rights reserved)[^\n]*$"
_ANY = r"\b(?:" + "|".join(a for a, _ in EQUIVALENT) + r")\b"


def canonical(text: Column) -> Column:
    """The text that is digested; null for null."""
    low = F.lower(text)
    kept = F.when(low.rlike(r"copyright|\(c\)|©|all rights reserved"), F.regexp_replace(low, COPYRIGHT_LINE, " ")).otherwise(low)
    words = F.trim(F.regexp_replace(kept, r"[^\p{L}\p{N}]+", " "))
    spelled = words
    for given, one in EQUIVALENT:
        spelled = F.regexp_replace(spelled, rf"\b{given}\b", one)
    # Most texts hold none of the spellings, and then the replacements aren't run.
    return F.when(words.rlike(_ANY), spelled).otherwise(words)


def known_digests(spark: SparkSession, licenses: list[tuple[str, str]], digests: list[tuple[str, str]]) -> DataFrame:
    rows = literal_rows(spark, ["license_id", "text"], licenses).select("license_id", F.sha2(canonical(F.col("text")), 256).alias("known_sha256"))
    if digests:
        rows = rows.unionByName(literal_rows(spark, ["license_id", "known_sha256"], digests))
    return rows.groupBy("known_sha256").agg(F.min("license_id").alias("license_id"))


def scan_licenses(docs: DataFrame, licenses: list[tuple[str, str]] = LICENSES, key: str = "doc_id", text: str = "text", digests: list[tuple[str, str]] = DIGESTS) -> DataFrame:
    """Return key, canonical_sha256, canonical_chars and license_id (null: none known) for every row of docs."""
    known = small(known_digests(docs.sparkSession, licenses, digests), len(licenses) + len(digests))
    canon = docs.select(F.col(key).alias("_key"), canonical(F.col(text)).alias("_canon"))
    digests = canon.select("_key", F.sha2("_canon", 256).alias("canonical_sha256"), F.length("_canon").cast("long").alias("canonical_chars"))
    return digests.join(known, F.col("canonical_sha256") == F.col("known_sha256"), "left").select(F.col("_key").alias(key), "canonical_sha256", "canonical_chars", "license_id")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def _sql_canonical(text: str) -> str:
    kept = f"regexp_replace(lower({text}), '{COPYRIGHT_LINE}', ' ', 'g')"
    out = rf"trim(regexp_replace({kept}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
    for given, one in EQUIVALENT:
        out = rf"regexp_replace({out}, '\b{given}\b', '{one}', 'g')"
    return out


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


ORACLE_SQL = f"""
with listed(license_id, text) as (values {", ".join(f"({_sql_text(n)}, {_sql_text(t)})" for n, t in LICENSES)}),
known as (select sha256({_sql_canonical("text")}) as canonical_sha256, min(license_id) as license_id from listed group by 1),
canon as (select doc_id, {_sql_canonical("text")} as c from documents)
select doc_id, sha256(c) as canonical_sha256, cast(length(c) as bigint) as canonical_chars, license_id
from canon left join known on sha256(c) = canonical_sha256
"""

QUERIES = {"op10_license_scan": op10_license_scan}
ORACLES = {"op10_license_scan": ORACLE_SQL}
