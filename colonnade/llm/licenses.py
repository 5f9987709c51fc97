"""Licence scan: known sentences to identifiers, identifier sequences to licences; SQL functions alone.

A text is cut into sentences (at . ! ? ; : before white space, and at blank lines; a sentence over
several lines that isn't known as a whole is tried line by line). Normalised to lower-case ASCII letters
and digits with single spaces, a sentence is looked up among the known ones. The identifiers found,
in order, form a sequence in which the rules are tried in theirs: a rule that occurs without a gap
names its licence and takes its sentences out, so that a longer licence stands before its parts.

Only texts with a keyword of the catalogue are cut at all; every known sentence has one. Nothing is
shuffled and the catalogue is part of the plan.

Edge cases: null and empty texts have no licence (empty lists); repeated sentences count each;
repeated rows are each judged; other columns don't matter; an empty table gives no row.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, functions as F

SENTENCES = {
    "mit-short": "Released under the MIT License.",
    "mit-short-2": "This project is licensed under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "apache-short": "Licensed under the Apache License, Version 2.0.",
    "apache-head": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache-use": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-at": "You may obtain a copy of the License at",
    "apache-url": "http://www.apache.org/licenses/LICENSE-2.0",
    "apache-url-s": "https://www.apache.org/licenses/LICENSE-2.0",
    "gpl3-short": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software:",
    "gpl3-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl2-free": "This program is free software;",
    "gpl2-published": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;",
    "gpl2-version": "either version 2 of the License, or (at your option) any later version.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa": "Licensed under CC BY-SA 4.0.",
    "cc-by": "Licensed under CC BY 4.0.",
    "cc0": "This work is dedicated to the public domain under the CC0 1.0 licence.",
    "mpl2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl2-form": "This Source Code Form is subject to the terms of the Mozilla Public License, v.",
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "bsd-warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "bsd-damages": "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;",
    "bsd-caused": "OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "isc-damages": "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "lgpl21-free": "This library is free software;",
    "lgpl-published": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation;",
    "lgpl21-version": "either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3-terms": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl3-terms": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl3-text": "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    "agpl3-text": "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",
    "gpl-freedom": "The licenses for most software are designed to take away your freedom to share and change it.",
    "gpl2-text": "By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users.",
    "apache-text": "\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.",
    "apache-text-grant": "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    "epl2": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "epl2-at": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "unlicense-free": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "zlib-warranty": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-damages": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "bsl1-short": "Distributed under the Boost Software License, Version 1.0.",
    "bsl1-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "bsd3-short": "This project is licensed under the BSD 3-Clause License.",
    "bsd2-short": "This project is licensed under the BSD 2-Clause License.",
    "cc-by-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nd-long": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "cc-by-nc-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-nc-sa-long": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "cc-by-nc-nd-long": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "cc-by-3": "This work is licensed under a Creative Commons Attribution 3.0 Unported License.",
    "cc-by-sa-3": "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.",
    "reserved": "All rights reserved.",
}
RULES = [
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-warranty", "bsd-damages", "bsd-caused"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty", "bsd-damages", "bsd-caused"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty", "mit-liability"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("Apache-2.0", ["apache-head", "apache-use", "apache-copy"]),
    ("Apache-2.0", ["apache-head", "apache-use", "apache-at", "apache-url"]),
    ("Apache-2.0", ["apache-head", "apache-use", "apache-at", "apache-url-s"]),
    ("Apache-2.0", ["apache-head", "apache-use"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl3-terms"]),
    ("GPL-2.0-or-later", ["gpl-free", "gpl2-published", "gpl2-version"]),  # normalised, gpl2-free is gpl-free
    ("GPL-2.0-or-later", ["gpl2-free", "gpl2-published", "gpl2-version"]),
    ("GPL-2.0-or-later", ["gpl2-free", "gpl2-terms"]),
    ("LGPL-2.1-or-later", ["lgpl21-free", "lgpl-published", "lgpl21-version"]),
    ("LGPL-3.0-or-later", ["gpl-free", "lgpl3-terms"]),
    ("AGPL-3.0-or-later", ["gpl-free", "agpl3-terms"]),
    ("GPL-3.0", ["gpl3-text"]),
    ("AGPL-3.0", ["agpl3-text"]),
    ("GPL-2.0", ["gpl-freedom", "gpl2-text"]),
    ("Apache-2.0", ["apache-text", "apache-text-grant"]),
    ("ISC", ["isc-grant", "isc-warranty", "isc-damages"]),
    ("ISC", ["isc-grant"]),
    ("0BSD", ["0bsd-grant", "isc-warranty", "isc-damages"]),
    ("0BSD", ["0bsd-grant"]),
    ("EPL-2.0", ["epl2"]),
    ("EPL-2.0", ["epl2-at"]),
    ("Unlicense", ["unlicense", "unlicense-free"]),
    ("Unlicense", ["unlicense"]),
    ("Zlib", ["zlib-warranty", "zlib-damages", "zlib-grant"]),
    ("BSL-1.0", ["bsl1-grant"]),
    ("BSL-1.0", ["bsl1-short"]),
    ("BSD-3-Clause", ["bsd3-short"]),
    ("BSD-2-Clause", ["bsd2-short"]),
    ("MIT", ["mit-short"]),
    ("MIT", ["mit-short-2"]),
    ("Apache-2.0", ["apache-short"]),
    ("GPL-3.0-only", ["gpl3-short"]),
    ("CC-BY-NC-4.0", ["cc-by-nc"]),
    ("CC-BY-SA-4.0", ["cc-by-sa"]),
    ("CC-BY-4.0", ["cc-by"]),
    ("CC0-1.0", ["cc0"]),
    ("MPL-2.0", ["mpl2"]),
    ("MPL-2.0", ["mpl2-form"]),
    *((f"CC-{k.removesuffix('-long').removeprefix('cc-').upper()}-4.0", [k]) for k in SENTENCES if k.endswith("-long")),
    ("CC-BY-3.0", ["cc-by-3"]),
    ("CC-BY-SA-3.0", ["cc-by-sa-3"]),
    ("LicenseRef-All-Rights-Reserved", ["reserved"]),
]
KEYWORDS = ("licen[sc]e", "sublicense", "license", "redistribut", "copyright", "reserved", "software", "warranty", "contributors")

_WS = r"[\t\n\x0B\f\r ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalize(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.translate(str.maketrans(UPPER, LOWER))).strip()


def catalogue(sentences: dict[str, str]) -> list[tuple[str, str]]:
    """(normalised sentence, identifier); the first of equal sentences stands."""
    out: dict[str, str] = {}
    for name, sentence in sentences.items():
        out.setdefault(normalize(sentence), name)
    return list(out.items())


def read_catalogue(path: str) -> tuple[dict[str, str], list[tuple[str, list[str]]]]:
    """Sentences and rules of a JSON file {"sentences": {id: text}, "rules": [[licence, [ids]]]}, in place of the ones here."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    return found["sentences"], [(name, keys) for name, keys in found["rules"]]


def _guard(known: list[tuple[str, str]]) -> str:
    """A pattern that every text with a known sentence has, in whatever case."""
    for sentence, name in known:
        if not any(re.search(k, sentence) for k in KEYWORDS):
            raise ValueError(f"sentence {name!r} has none of the keywords {KEYWORDS}")
    return "(?i)" + "|".join(KEYWORDS)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def scan(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, sentence_ids (all known sentences in order), licenses (by the rules' order, distinct), n_unmatched (known sentences in no rule found)."""
    known = catalogue(sentences)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    clean = lambda s: f"trim(regexp_replace(translate({s}, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' '))"
    table = "map(" + ", ".join(f"{_quoted(s)}, {_quoted(n)}" for s, n in known) + ")"
    look = lambda s: f"element_at({table}, {clean(s)})"
    marked = f"regexp_replace(regexp_replace(text, {_quoted(chr(92) + 'n[' + chr(92) + 't' + chr(92) + 'x0B' + chr(92) + 'f' + chr(92) + 'r ]*' + chr(92) + 'n')}, '\\u0001'), {_quoted('([.!?;:])' + _WS + '+')}, {_quoted('$1' + chr(1))})"
    units = f"filter(split({marked}, '\\u0001', -1), s -> s rlike {_quoted(_guard(known))})"
    lines = f"filter(transform(if(instr(s, '\\n') > 0, split(s, '\\n', -1), cast(array() as array<string>)), l -> {look('l')}), i -> i is not null)"
    whole = look("s")
    found = f"flatten(transform({units}, s -> element_at(transform(array({whole}), w -> if(w is not null, array(w), {lines})), 1)))"
    ids = f"if(text rlike {_quoted(_guard(known))}, {found}, cast(array() as array<string>))"
    listed = "array(" + ", ".join(f"named_struct('name', {_quoted(n)}, 'key', {_quoted(',' + ',,'.join(keys) + ',')})" for n, keys in rules) + ")"
    # Each identifier has a comma on both sides, so that neighbours never share one.
    sequence = "concat_ws('', transform(sentence_ids, i -> concat(',', i, ',')))"
    fold = f"aggregate({listed}, named_struct('seq', {sequence}, 'names', cast(array() as array<string>)), (acc, r) -> if(instr(acc.seq, r.key) > 0, named_struct('seq', replace(acc.seq, r.key, '|'), 'names', array_append(acc.names, r.name)), acc))"
    told = rows.select("doc_id", F.coalesce(F.expr(ids), F.array().cast("array<string>")).alias("sentence_ids")).select("doc_id", "sentence_ids", F.expr(fold).alias("fold"))
    return told.select("doc_id", "sentence_ids", F.array_distinct("fold.names").alias("licenses"), F.expr("cast(length(regexp_replace(fold.seq, '[^,]', '')) div 2 as bigint)").alias("n_unmatched"))


def oracle(sentences: dict[str, str] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES) -> str:
    """DuckDB SQL of scan's columns, its lists joined by commas as the query's are."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({q(s)}, {q(n)})" for s, n in catalogue(sentences))
    ws = r"[\t\n\x0B\f\r ]"
    seqs = "".join(f", q{k + 1} as (select *, case when contains(s{k}, {q(',' + ',,'.join(keys) + ',')}) then {q(n)} end as l{k}, replace(s{k}, {q(',' + ',,'.join(keys) + ',')}, '|') as s{k + 1} from q{k})" for k, (n, keys) in enumerate(rules))
    clean = lambda s: f"trim(regexp_replace(translate({s}, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g'))"
    all_names = ", ".join(f"l{k}" for k in range(len(rules)))
    return f"""
with known(sentence, id) as (values {known}),
cut as (
  select doc_id, unnest(string_split(regexp_replace(regexp_replace(coalesce(text, ''), '\\n[\\t\\x0B\\f\\r ]*\\n', chr(1), 'g'), '([.!?;:]){ws}+', '\\1' || chr(1), 'g'), chr(1))) as s,
    generate_subscripts(string_split(regexp_replace(regexp_replace(coalesce(text, ''), '\\n[\\t\\x0B\\f\\r ]*\\n', chr(1), 'g'), '([.!?;:]){ws}+', '\\1' || chr(1), 'g'), chr(1)), 1) as p from documents),
whole as (select doc_id, p, s, id from cut left join known on sentence = {clean("s")}),
lines as (
  select doc_id, p, unnest(string_split(s, chr(10))) as l, generate_subscripts(string_split(s, chr(10)), 1) as j from whole where id is null and contains(s, chr(10))),
found as (
  select doc_id, p, 0 as j, id from whole where id is not null
  union all select doc_id, p, j, known.id from lines join known on sentence = {clean("l")}),
seq as (select doc_id, list(id order by p, j) as ids from found group by 1),
q0 as (select d.doc_id, coalesce(array_to_string(ids, ','), '') as sentence_ids, coalesce(array_to_string(list_transform(ids, lambda i: ',' || i || ','), ''), '') as s0 from documents d left join seq using (doc_id)){seqs}
select doc_id, sentence_ids, array_to_string(list_transform(list_filter(list_transform(range(1, {len(rules) + 1}), lambda i: struct_pack(i := i, x := [{all_names}][i])), lambda t: t.x is not null and not list_contains(list_slice([{all_names}], 1, t.i - 1), t.x)), lambda t: t.x), ',') as licenses,
  (length(regexp_replace(s{len(rules)}, '[^,]', '', 'g')) // 2)::bigint as n_unmatched
from q{len(rules)}"""
