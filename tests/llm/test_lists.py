"""Whole licence texts, with and without comment prefixes; lists from files; very long URLs."""

import json

import pytest

from colonnade.llm import licenses, urls
from test_dedup_quality_text import brute_licenses

ASIS = 'THE SOFTWARE IS PROVIDED "AS IS"'
TEXTS = {
    "MIT": """MIT License

Copyright (c) 2020 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
""",
    "BSD-3-Clause": """Copyright (c) 2020, Some Body

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.
""",
    "LGPL-2.1-or-later": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
""",
    "AGPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.
""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.
""",
    "Zlib": """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:
""",
    "CC-BY-NC-SA-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
}


def test_whole_texts(spark):
    """As they are published, in any wrapping, in upper case, and repeated rows alike."""
    forms = lambda t: [t, t.upper(), " ".join(t.split("\n")) if "\n\n" not in t else t.replace("\n\n", "\n \n"), "intro.\n\n" + t + "\nend"]
    rows = [(name, f) for name, t in TEXTS.items() for f in forms(t)] + [("MIT", TEXTS["MIT"])] * 2
    got = licenses.scan(spark.createDataFrame([(k, t, n) for k, (n, t) in enumerate(rows)], "doc_id long, text string, licenses string")).collect()
    assert len(got) == len(rows)
    for r in got:
        name, text = rows[r["doc_id"]]
        assert r["licenses"] == [name]
        assert (r["sentence_ids"], r["licenses"], r["n_unmatched"]) == brute_licenses(text)


def test_padded_and_very_long_sentences(spark):
    ruler = "=" * 20_000
    text = f"Released {ruler} under the MIT License. " + "word " * 100_000 + ". All rights reserved."
    got = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got["licenses"] == ["MIT", "LicenseRef-All-Rights-Reserved"]


def test_lists_from_files(spark, tmp_path):
    (tmp_path / "own.json").write_text(json.dumps({"sentences": {"own": "Ours alone by licence."}, "rules": [["Own", ["own"]]]}))
    sentences, rules = licenses.read_catalogue(str(tmp_path / "own.json"))
    got = licenses.scan(spark.createDataFrame([(1, "Ours, alone, by licence. All rights reserved.")], "doc_id long, text string"), sentences, rules).first()
    assert got["licenses"] == ["Own"] and got["sentence_ids"] == ["own"]
    (tmp_path / "terms").write_text("# ours\nFoo\n\nbar\nfoo\n")
    assert urls.read_terms(str(tmp_path / "terms")) == ("foo", "bar")


@pytest.mark.parametrize("url, verdict", [("http://a.net/" + "x" * 300_000 + "/casino", "block"), ("http://a.net/" + "free-" * 50_000, "allow"), ("http://a.net/kredit?x=gratis", "block"), ("http://a.net/kredit", "allow"), ("http://sussex.net/sexton", "allow")])
def test_urls(spark, url, verdict):
    assert urls.judge(spark.createDataFrame([(1, url)], "page_id long, url string")).first()["verdict"] == verdict


def test_terms_are_plain_words():
    both = [*urls.STRICT, *urls.SOFT]
    assert len(set(both)) == len(both) > 150 and all(t == t.lower() and t.replace("-", "").isalnum() for t in both)
