"""Standard notices as they are found: wrapped, and in comments."""

import textwrap

from bandwright.llm import licenses
from test_licenses import scanned

MIT = licenses.MIT_GRANT
GPL = licenses.GNU_GRANT.format("program", "General", "3")
BSD = next(t for n, t in licenses.TEMPLATES if n == "BSD-3-Clause" and "Neither" in t)
MPL = next(t for n, t in licenses.TEMPLATES if n == "MPL-2.0" and "obtain" in t)


def wrapped(text, mark=""):
    return "\n".join(mark + line for line in textwrap.wrap(text, 70))


def test_wrapped_notices_and_identifiers(spark):
    files = [
        ("a/LICENSE", "MIT License\n\nCopyright (c) 2020 Ann\n\n" + wrapped(MIT)),
        ("a/deep/x.py", "print(1)"),
        ("b/x.c", "/*\n" + wrapped(MPL, " * ") + "\n */\nint x;"),
        ("c/x.py", wrapped(GPL, "# ") + "\nimport os"),
        ("d/LICENSE", "Copyright (c) 2020, Ann\nAll rights reserved.\n\n" + wrapped(BSD)),
        ("e/x.js", "// SPDX-License-Identifier: Apache-2.0\nlet x"),
        ("f/x.js", "// SPDX-License-Identifier: MIT\nlet x"),
        ("g/COPYING", "GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\nmore of it"),
        ("h/x", "nothing at all"),
    ]
    found = {path: row[:2] for path, row in scanned(spark, files)}
    assert found == {
        "a/LICENSE": ("MIT", "MIT"),
        "a/deep/x.py": (None, "MIT"),
        "b/x.c": ("MPL-2.0", "MPL-2.0"),
        "c/x.py": ("GPL-3.0", "GPL-3.0"),
        "d/LICENSE": ("BSD-3-Clause", "BSD-3-Clause"),
        "e/x.js": ("Apache-2.0", "Apache-2.0"),
        "f/x.js": ("MIT", "MIT"),
        "g/COPYING": ("GPL-3.0", "GPL-3.0"),
        "h/x": (None, None),
    }
