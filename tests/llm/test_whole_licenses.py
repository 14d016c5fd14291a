"""Licence notices as projects write them, plain and in comments."""

import pytest

from millrace.llm import licenses

AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
MIT = f"""MIT License

Copyright (c) 2020 Foo

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

{AS_IS}"""
APACHE = """Copyright 2020 Foo

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
BSD = """BSD 3-Clause License

Copyright (c) 2020, Foo

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
"""
ISC = """ISC License

Copyright (c) 2020 Foo

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
GPL = """Copyright (C) 2020 Foo

This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
NOTICES = {"mit.text": MIT, "apache-2.0.header": APACHE, "bsd-3.text,bsd-2.text": BSD, "isc.text": ISC, "gpl-3.0.header": GPL, "mpl-2.0.header": MPL}


def marked(text, first, each, last):
    return first + "".join(f"{each} {line}".rstrip() + "\n" for line in text.splitlines()) + last


@pytest.mark.parametrize("style", ["plain", "hash", "star", "crlf", "double"])
def test_standard_notices(spark, style):
    shape = {"plain": lambda t: t, "hash": lambda t: marked(t, "#!/bin/sh\n", "#", "\nmain\n"), "star": lambda t: marked(t, "/*\n", " *", " */\nint main\n"), "crlf": lambda t: t.replace("\n", "\r\n"), "double": lambda t: t.replace("\n", "\n\n")}[style]
    rows = [(k, shape(text)) for k, text in enumerate(NOTICES.values())]
    found = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [found[k]["rules"] for k in range(len(rows))] == list(NOTICES)
    held = {name: ids for name, _, ids in licenses.RULES}
    assert [found[k]["sentence_ids"] for k in range(len(rows))] == [",".join(held[name.split(",")[0]]) for name in NOTICES]
    assert all(r["n_sentences"] == len(r["sentence_ids"].split(",")) for r in found.values())


def test_sentence_alone_is_known_by_itself(spark):
    """Each sentence of the table, between others: all but the one-line SPDX tags are in ``sentence_ids``."""
    keys = list(licenses.SENTENCES)
    rows = [(k, f"Some words\n\n{licenses.SENTENCES[key]}\n\nmore words.") for k, key in enumerate(keys)]
    found = {r["doc_id"]: r["sentence_ids"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {k: "" if key.startswith("spdx.") else key for k, key in enumerate(keys)}


def test_part_of_a_piece_is_not_a_sentence(spark):
    rows = [(0, "Not licensed under the MIT License."), (1, "Licensed under the MIT License and others."), (2, "We say: all\n\nrights reserved. And so on.")]
    found = {r["doc_id"]: r["sentence_ids"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {0: "", 1: "", 2: "reserved"}
