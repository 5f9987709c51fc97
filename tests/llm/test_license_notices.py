"""Licences' notices as they are published."""

from colonnade.llm import licenses
from test_dedup_quality_text import brute_licenses

APACHE = """Copyright 2020 A Name

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    %s://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
MIT = """MIT License

Copyright (c) 2020 A Name

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
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM.
"""
BSD2 = """Redistribution and use in source and binary forms, with or without modification,
are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this
   list of conditions and the following disclaimer in the documentation and/or
   other materials provided with the distribution.
"""
BSD3 = (
    BSD2
    + """
3. Neither the name of the copyright holder nor the names of its contributors may
   be used to endorse or promote products derived from this software without
   specific prior written permission.
"""
)
GPL = """This program is free software%s you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation%s either version %d of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
NOTICES = [
    (APACHE % "http", "Apache-2.0"),
    (APACHE % "https", "Apache-2.0"),
    ("".join(f"# {x}".rstrip() + "\n" for x in (APACHE % "http").splitlines()), "Apache-2.0"),
    (MIT, "MIT"),
    (BSD2, "BSD-2-Clause"),
    (BSD3, "BSD-3-Clause"),
    (GPL % (":", ",", 3), "GPL-3.0-or-later"),
    (GPL % (";", ";", 2), "GPL-2.0-or-later"),
    (MPL, "MPL-2.0"),
]


def test_published_notices(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(NOTICES)], "doc_id long, text string")
    got = {r["doc_id"]: (r["sentence_ids"], r["licenses"], r["n_unmatched"]) for r in licenses.scan(df).collect()}
    assert [(got[i][1], got[i][2]) for i in range(len(NOTICES))] == [([name], 0) for _, name in NOTICES]
    assert got == {i: brute_licenses(t) for i, (t, _) in enumerate(NOTICES)}
