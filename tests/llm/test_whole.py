"""Licence notices that are no lines of their own."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loomstead.llm import licenses

GPL = "# This program is free software: you can redistribute it and/or\n# modify it under the terms of the GNU General Public License\n# as published by the Free Software Foundation, either version 3\n# of the License, or (at your option) any later version.\n\nimport os"
MIT = " * Permission is hereby granted, free of charge, to any person\n * obtaining a copy of this software and associated documentation\n * files (the \"Software\"), to deal in the Software without\n * restriction, including without limitation the rights to use, copy"
BSD = "Redistribution and use in source and binary forms, with or\nwithout modification, are permitted provided that the\nfollowing conditions are met:\n1. Keep this."
ISC = "/*\n * Permission to use, copy, modify, and/or distribute this\n * software for any purpose with or without fee is hereby\n * granted, provided that the above copyright notice and this\n * permission notice appear in all copies.\n */\nint main() { return 0; }"
MPL = "// This Source Code Form is subject to the terms of the\n// Mozilla Public License, v. 2.0. If a copy of the MPL was not\n// distributed with this file, You can obtain one at\n// http://mozilla.org/MPL/2.0/.\npackage x"
LGPL = GPL.replace("This program is free software:", "This library is free software;").replace("GNU General Public", "GNU Lesser General\n# Public").replace("Foundation, either", "Foundation; either")
AGPL = GPL.replace("GNU General", "GNU Affero General")
MIT_FILE = "MIT Licence text follows\n\nCopyright (c) 2020 Some One\n\n" + next(t for n, t in licenses.TEMPLATES if n == "MIT" and len(t) > 400).replace(", ", ",\n")
BSD_FILE = "Copyright 2019 The Authors\n\n" + next(t for n, t in licenses.TEMPLATES if n == "BSD-3-Clause" and len(t) > 400).replace(". ", ".\n\n   ")
BODY = lambda name: next(t for n, t in licenses.TEMPLATES if n == name and len(t) > 400)
BSD_2 = "Copyright 2020 X\n\n" + BODY("BSD-2-Clause").replace("WARRANTIES", "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY ARE DISCLAIMED")
BSD_3 = BODY("BSD-3-Clause") + "\n\n" + BSD_2[BSD_2.index("THIS SOFTWARE") :]
CASES = [
    (BSD_2.replace(", ", ",\n * "), "BSD-2-Clause"),
    (BSD_3.replace(", ", ",\n * "), "BSD-3-Clause"),
    ("This story is not licensed under the MIT license, whatever they say.", None),
    ("It was never released under the MIT License.", None),
    ("// SPDX-License-Identifier: GPL-3.0-or-later\nint x;", "GPL-3.0"),
    ("# SPDX-License-Identifier: mit\n# All rights reserved.", "MIT"),
    ("# SPDX-License-Identifier: Unknown-1.0", None),
    ("Preamble\n\nThe GNU General Public License is a free, copyleft\nlicense for software and other kinds of works.\n\nThe licenses for most software", "GPL-3.0"),
    ("1. Definitions.\n\n\"License\" shall mean the terms and conditions for use, reproduction,\nand distribution as defined by Sections 1 through 9 of this document.", "Apache-2.0"),
    ("They came home late. Released\nunder the MIT License. The end.", "MIT"),
    (ISC, "ISC"),
    (MPL, "MPL-2.0"),
    (LGPL, "LGPL-3.0"),
    (AGPL, "AGPL-3.0"),
    (MIT_FILE, "MIT"),
    (BSD_FILE, "BSD-3-Clause"),
    ("<!-- This work is licensed under a Creative Commons\nAttribution 4.0 International License. -->", "CC-BY-4.0"),
    ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n some preamble of many words", "GPL-3.0"),
    (GPL, "GPL-3.0"),
    (MIT, "MIT"),
    (BSD, "BSD-3-Clause"),
    ("We wrote it last year in some haste. Released under the MIT License. Patches are very welcome here.", "MIT"),
    ("Copyright (c) 2024 Example Corp. All rights reserved.", "Proprietary"),
    ("many plain words " * 300 + GPL + " more plain words" * 300, "GPL-3.0"),
    ("Software of any person is free to use in the work, and all of its terms are plain.", None),
]


@pytest.mark.parametrize("line", [0, 1])
def test_notices_that_are_wrapped_or_inside_of_lines(spark, line):
    filler = "\nplain words" * 20 * line
    rows = [(f"d{i}/LICENSE", text + filler) for i, (text, _) in enumerate(CASES)] + [(f"d{i}/a/x", "nothing") for i in range(len(CASES))]
    got = {r.path: (r.own_licence, r.licence, r.granted_by) for r in licenses.licences(spark.createDataFrame(rows, "path string, text string")).collect()}
    for i, (_, want) in enumerate(CASES):
        assert got[f"d{i}/LICENSE"] == (want, want, None)
        assert got[f"d{i}/a/x"] == (None, want, f"d{i}" if want else None)


def test_nulls_empty_tables_and_clashing_columns(spark):
    rows = [(None, None, 1), ("a/LICENSE", None, 2), ("a/b", "", 3), (None, "Released under the MIT License.", 4), ("a/b", "", 3)]
    files = spark.createDataFrame(rows, "path string, text string, licence int")
    files = files.withColumns({"path_": F.lit(1), "own_licence": F.lit(2), "granted_by": F.lit(3), "w": F.lit(4), "has": F.lit(5)})
    out = licenses.licences(files)
    assert out.columns[: len(files.columns)] == files.columns and len(out.columns) == len(files.columns) + 3
    assert sorted(r._own_licence or "-" for r in out.collect()) == ["-", "-", "-", "MIT", "MIT"]  # null paths are one file
    assert licenses.licences(files.limit(0)).count() == 0
