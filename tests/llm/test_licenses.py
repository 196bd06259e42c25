"""Scan and inheritance against plain Python."""

import math
import re
from collections import Counter

from bandwright.llm import licenses, queries
from bandwright.llm.tables import Workspace


def parts(text):
    cue = re.compile(rf"(?i)(?<![a-z0-9])({'|'.join(licenses.CUES)})(?![a-z0-9])")
    text = re.sub(r"^\s+|\s+$", "", text or "", flags=re.A)
    every = re.split(licenses.SENTENCE_END, text, flags=re.A)
    return [(k, k in (0, len(every) - 1), s) for k, s in enumerate(every) if cue.search(s)]


def vector(text, weight):
    counts = Counter(re.findall(licenses.TERM, text.lower()))
    return {t: n * weight(t) for t, n in counts.items()}


def cosine(a, b):
    length = math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
    return round(sum(x * b.get(t, 0) for t, x in a.items()) / length, 9) if length else 0


def brute(files):
    looked = [(path, *part) for path, text in files for part in parts(text)]
    held = Counter(t for *_, s in looked for t in set(re.findall(licenses.TERM, s.lower())))
    weight = lambda t: math.log((len(looked) + 1) / (held[t] + 1)) + 1
    near = []
    for path, place, edge, sentence in looked:
        v = vector(sentence, weight)
        best = max(
            (cosine(v, vector(text, weight)), -k, name)
            for k, (name, text) in enumerate(licenses.TEMPLATES)
        )
        if best[0] >= licenses.LEAST_COSINE:
            near.append((path, place, edge, best[2], best[0]))
    own, grants = {}, {}
    for path, place, edge, name, value in near:
        own[path] = max(own.get(path, (0, 0, "")), (value, -place, name))
        if edge and path:
            folder = path.rpartition("/")[0]
            grants[folder] = min(grants.get(folder, (9, "", "")), (-value, path, name))
    found = {}
    for path, _ in files:
        name, folder = own[path][2] if path in own else None, path
        source = None
        while name is None and folder:
            folder = folder.rpartition("/")[0]
            if folder in grants:
                name, source = grants[folder][2], folder
        found[path] = (own[path][2] if path in own else None, name, source)
    return found


def scanned(spark, files):
    table = spark.createDataFrame([(*f, 1) for f in files], "path string, text string, place int")
    rows = licenses.scanned(table, Workspace(spark)).collect()
    return [(r["path"], (r["own_license"], r["license"], r["inherited_from"])) for r in rows]


MIT, GPL = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
FILES = [
    ("LICENSE", MIT),
    ("a.py", "no notice"),
    ("src/COPYING", GPL + "\n\n"),
    ("src/deep/er/b.py", "code\ncode"),
    ("src/c.py", f"First. {MIT} Last."),
    ("lib/x/y/z.py", ""),
    ("lib/n", None),
    ("lib/two/A", "Licensed under CC BY-NC 4.0."),
    ("lib/two/B", "Licensed under CC BY-NC 4.0, more or less."),
    ("lib/two/c", "The license of this license is a license"),
    ("rights", "All rights reserved"),
    ("long", "word " * 50_000 + "\nLicensed under the Apache License, Version 2.0."),
]


def test_scan_and_inheritance(spark):
    found = scanned(spark, FILES)
    assert dict(found) == brute(FILES) and len(found) == len(FILES)
    assert dict(found)["src/deep/er/b.py"] == (None, "GPL-3.0", "src")
    assert dict(found)["lib/x/y/z.py"][2] == ""


def test_null_and_repeated_paths_and_no_files(spark):
    found = scanned(spark, [(None, MIT), ("d/x", "plain"), ("d/x", "plain"), ("d/L", MIT)])
    assert sorted(found, key=str) == sorted(
        [(None, (None, None, None)), ("d/L", ("MIT", "MIT", None))] + [("d/x", (None, "MIT", "d"))] * 2,
        key=str,
    )
    assert scanned(spark, []) == []


def test_query_against_plain_python(spark, star_folder):
    folder = star_folder("0.01")
    read = spark.read.parquet(f"{folder}/documents.parquet")
    files = [(r["path"], r["text"]) for r in licenses.document_files(read).collect()]
    rows = queries.op5_license_scans(spark, folder).collect()
    found = {r["path"]: (r["own_license"], r["license"], r["inherited_from"]) for r in rows}
    assert found == brute(files)
    assert {r["doc_id"] for r in rows} == {int(p.rpartition("/")[2]) for p, _ in files}
    assert any(r["inherited_from"] for r in rows)
