"""Licence scans by sentence rules, in DataFrame functions only.

A text is cut into pieces at sentence ends and at blank lines, each normalised to its letters and digits, so comment
marks are nothing. A known sentence is one or more whole pieces in a row: cuts inside it do not matter. The sequence of a
text's identifiers is matched against ordered rules. Sentences that no rule knows do not break a sequence. Lines are
tried as sentences too, so that a heading without a full stop is found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of well-known licences and notices, by identifier.
SENTENCES: dict[str, str] = {
    "apache.licensed": "Licensed under the Apache License, Version 2.0.",
    "apache.the_license": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "apache.obtain": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache.as_is": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache.see": "See the License for the specific language governing permissions and limitations under the License.",
    "mit.released": "Released under the MIT License.",
    "mit.licensed": "Licensed under the MIT License.",
    "mit.title": "The MIT License (MIT)",
    "mit.grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit.notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit.warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "mit.liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "bsd.grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd.source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd.binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd.endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd.released": "Released under the BSD License.",
    "isc.grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "gpl3.work": "This work is licensed under the GNU General Public License, version 3.",
    "gpl.free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl.hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl.details": "See the GNU General Public License for more details.",
    "gpl.copy": "You should have received a copy of the GNU General Public License along with this program.",
    "mpl.source": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl.copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "cc.by": "Licensed under CC BY 4.0.",
    "cc.by_sa": "Licensed under CC BY-SA 4.0.",
    "cc.by_nc": "Licensed under CC BY-NC 4.0.",
    "cc.by_work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "unlicense.free": "This is free and unencumbered software released into the public domain.",
    "unlicense.use": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "reserved": "All rights reserved.",
    "spdx.mit": "SPDX-License-Identifier: MIT",
    "spdx.apache": "SPDX-License-Identifier: Apache-2.0",
    "spdx.gpl3": "SPDX-License-Identifier: GPL-3.0-only",
    "spdx.bsd3": "SPDX-License-Identifier: BSD-3-Clause",
}

# Rules in order: name, licence, and the identifiers that must follow one another.
RULES: list[tuple[str, str, tuple[str, ...]]] = [
    ("mit.text", "MIT", ("mit.grant", "mit.notice", "mit.warranty", "mit.liability")),
    ("mit.reference", "MIT", ("mit.released",)),
    ("mit.reference_licensed", "MIT", ("mit.licensed",)),
    ("mit.title", "MIT", ("mit.title",)),
    ("mit.spdx", "MIT", ("spdx.mit",)),
    ("apache-2.0.header", "Apache-2.0", ("apache.the_license", "apache.obtain", "apache.as_is", "apache.see")),
    ("apache-2.0.reference", "Apache-2.0", ("apache.licensed",)),
    ("apache-2.0.spdx", "Apache-2.0", ("spdx.apache",)),
    ("bsd-3.text", "BSD-3-Clause", ("bsd.grant", "bsd.source", "bsd.binary", "bsd.endorse")),
    ("bsd-2.text", "BSD-2-Clause", ("bsd.grant", "bsd.source", "bsd.binary")),
    ("bsd.reference", "BSD", ("bsd.released",)),
    ("bsd-3.spdx", "BSD-3-Clause", ("spdx.bsd3",)),
    ("isc.text", "ISC", ("isc.grant",)),
    ("gpl-3.0.header", "GPL-3.0", ("gpl.free", "gpl.hope", "gpl.details", "gpl.copy")),
    ("gpl-3.0.reference", "GPL-3.0", ("gpl3.work",)),
    ("gpl-3.0.spdx", "GPL-3.0", ("spdx.gpl3",)),
    ("mpl-2.0.header", "MPL-2.0", ("mpl.source", "mpl.copy")),
    ("cc-by-4.0.reference", "CC-BY-4.0", ("cc.by",)),
    ("cc-by-4.0.work", "CC-BY-4.0", ("cc.by_work",)),
    ("cc-by-sa-4.0.reference", "CC-BY-SA-4.0", ("cc.by_sa",)),
    ("cc-by-nc-4.0.reference", "CC-BY-NC-4.0", ("cc.by_nc",)),
    ("unlicense.text", "Unlicense", ("unlicense.free", "unlicense.use")),
    ("reserved", "All-Rights-Reserved", ("reserved",)),
]
#: A text that holds none of these has no known sentence.
HINT = "licen|warrant|reserved|permi|redistribut|spdx|liable|mpl|free"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(sentence: str) -> str:
    """A known sentence as the expressions below write it."""
    import re

    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip(" ")


def _pieces(lower: Column) -> Column:
    """Normalised pieces that are not empty: cut after a full stop, question or exclamation mark or colon before white
    space, at a line without a letter or digit (blank, or a comment mark alone), before a comment opens, after "#!"."""
    blocks = F.regexp_replace(lower, r"(?>\r\n|\r|\n)[^\p{L}\p{N}\r\n]*(?>\r\n|\r|\n)|(?>\r\n|\r|\n)(?=[ \t]*(?:/\*|<!--))|^#![^\r\n]*", "\u0001")
    parts = F.split(F.regexp_replace(blocks, r"([.!?:])[ \t\r\n]+", "$1\u0001"), "\u0001")
    return F.filter(F.transform(parts, lambda s: F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))), lambda s: s != "")


def _joined(ids: Column) -> Column:
    return F.concat(F.lit(","), F.array_join(F.filter(ids, lambda x: x.isNotNull()), ","), F.lit(","))


def _known_sentences(pieces: Column) -> Column:
    """Identifiers of the known sentences among pieces, in order, each followed by a comma.

    A sentence starts and ends where a piece does. SPDX tags are lines, not sentences; ``_known_lines`` has them.
    """
    known = {normalised(text): key for key, text in SENTENCES.items() if not key.startswith("spdx.")}
    longest = max(len(text.split()) for text in known)
    one, two = ({" ".join(text.split()[:n]) for text in known} for n in (1, 2))

    def tails(all_pieces: Column) -> Column:
        # A piece that may start a known sentence, with as many pieces after it as the longest may have.
        def tail(piece: Column, k: Column) -> Column:
            rest = F.concat(F.array_join(F.slice(all_pieces, k + 1, longest), "\u0001"), F.lit("\u0001"))
            return F.when(piece.isin(sorted(one)) | F.substring_index(piece, " ", 2).isin(sorted(two)), rest)

        return F.filter(F.transform(all_pieces, tail), lambda x: x.isNotNull())

    def identifier(tail: Column) -> Column:
        return F.coalesce(*[F.when((F.substring(tail, len(text) + 1, 1) == "\u0001") & (F.translate(F.substring(tail, 1, len(text)), "\u0001", " ") == text), F.lit(key)) for text, key in known.items()])

    # The array of one array binds the pieces, which would else be cut again for each of them.
    return _joined(F.transform(F.element_at(F.transform(F.array(pieces), tails), 1), identifier))


def _known_lines(lines: Column) -> Column:
    """Identifiers of the known ones among lines, in order, each followed by a comma."""
    table = F.create_map(*[F.lit(x) for key, text in SENTENCES.items() for x in (normalised(text), key)])
    return _joined(F.transform(lines, lambda s: F.try_element_at(table, F.trim(F.regexp_replace(s, "[^a-z0-9]+", " ")))))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_sentences, sentence_ids, rules, licences)`` for each row.

    ``sentence_ids`` are the known sentences in text order, ``rules`` the matched rules and ``licences`` their licences
    without repeats, both in rule order; all are joined by commas, and empty if there is none, as for null and empty
    texts. A shorter rule counts where a longer one holds it too. Null ids stay null; repeated rows give equal rows;
    other columns are not read; an empty table gives an empty table. One pass without a shuffle.
    """
    text = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), _UPPER, _LOWER)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("lower"))
    some = F.col("lower").rlike(HINT)
    rows = rows.select("doc_id", F.when(some, _known_sentences(_pieces(F.col("lower")))).otherwise(",,").alias("by_sentence"), F.when(some, _known_lines(F.split("lower", "[\r\n]+"))).otherwise(",,").alias("by_line"))
    hit = [F.col("by_sentence").contains(f",{','.join(ids)},") | F.col("by_line").contains(f",{','.join(ids)},") for _, _, ids in RULES]
    held = {licence: None for _, licence, _ in RULES}
    for licence in held:
        held[licence] = [h for h, (_, own, _) in zip(hit, RULES, strict=True) if own == licence]
    any_of = [(licence, hits[0] if len(hits) == 1 else F.greatest(*hits)) for licence, hits in held.items()]
    found = F.trim(F.col("by_sentence"), F.lit(","))
    return rows.select(
        "doc_id",
        F.when(found == "", 0).otherwise(F.length(found) - F.length(F.replace(found, F.lit(","), F.lit(""))) + 1).cast("long").alias("n_sentences"),
        found.alias("sentence_ids"),
        F.array_join(F.filter(F.array(*[F.when(h, F.lit(name)) for h, (name, _, _) in zip(hit, RULES, strict=True)]), lambda x: x.isNotNull()), ",").alias("rules"),
        F.array_join(F.filter(F.array(*[F.when(h, F.lit(licence)) for licence, h in any_of]), lambda x: x.isNotNull()), ",").alias("licences"),
    )


def oracle() -> str:
    """The same scan in SQL."""
    known = ", ".join("('" + normalised(text).replace("'", "''") + "', '" + key + "')" for key, text in SENTENCES.items())
    rules = ", ".join(f"({k}, '{name}', '{licence}', ',{','.join(ids)},')" for k, (name, licence, ids) in enumerate(RULES))

    def series(pieces: str) -> str:
        return f"""select doc_id, ',' || coalesce(string_agg(key, ',' order by place), '') || ',' as ids from (
            select d.doc_id, k.key, d.place from (select doc_id, trim(regexp_replace(unnest({pieces}), '[^a-z0-9]+', ' ', 'g')) as sentence, generate_subscripts({pieces}, 1) as place from lowered) d
            left join known k on d.sentence = k.sentence) group by doc_id"""

    return rf"""
        with known(sentence, key) as (values {known}),
        rules(number, rule, licence, ids) as (values {rules}),
        lowered as (select doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') as lower from documents),
        s as ({series(r"string_split(regexp_replace(lower, '([.!?:])[ \t\r\n]+', '\1' || chr(1), 'g'), chr(1))")}),
        l as ({series(r"string_split(regexp_replace(lower, '[\r\n]+', chr(10), 'g'), chr(10))")}),
        hits as (select s.doc_id, string_agg(rule, ',' order by number) as rules from s join l using (doc_id) join rules r on contains(s.ids, r.ids) or contains(l.ids, r.ids) group by s.doc_id),
        owned as (select doc_id, string_agg(licence, ',' order by number) as licences from (
            select s.doc_id, licence, min(r.number) as number from s join l using (doc_id) join (select licence, ids, min(number) over (partition by licence) as number from rules) r on contains(s.ids, r.ids) or contains(l.ids, r.ids) group by s.doc_id, licence) group by doc_id)
        select s.doc_id, cast(case when trim(s.ids, ',') = '' then 0 else len(string_split(trim(s.ids, ','), ',')) end as bigint) as n_sentences, trim(s.ids, ',') as sentence_ids,
            coalesce(h.rules, '') as rules, coalesce(o.licences, '') as licences
        from s left join hits h using (doc_id) left join owned o using (doc_id)"""
