"""Bounds lose no part that is near a template; ancestors of every depth decide files."""

import math
import random
import re
from collections import Counter

from bandwright.llm import licenses
from bandwright.llm.queries import op5_license_scans
from bandwright.llm.tables import Workspace


def test_bounds_keep_every_part_that_is_near_enough(spark):
    rng = random.Random(3)
    words = sorted({w for _, t in licenses.TEMPLATES for w in re.findall(licenses.TERM, t.lower())})
    other = [f"w{k}" for k in range(60)]
    held = {w: rng.choice([1, 5, 40, 300]) for w in words + other} | {licenses.ANY: 400}
    seen = spark.createDataFrame(list(held.items()), "term string, held long")
    limit = licenses.bounds(seen, 400, licenses.LEAST_COSINE)
    weight = {w: math.log(401 / (n + 1)) + 1 for w, n in held.items()}

    def cosine(a, b):
        a, b = (Counter(re.findall(licenses.TERM, t.lower())) for t in (a, b))
        a, b = ({w: n * weight.get(w, math.log(401) + 1) for w, n in c.items()} for c in (a, b))
        lengths = [math.sqrt(sum(x * x for x in c.values())) for c in (a, b)]
        return sum(x * b.get(w, 0) for w, x in a.items()) / (lengths[0] * lengths[1])

    near = dropped = 0
    for _ in range(1500):
        _, template = rng.choice(licenses.TEMPLATES)
        kept = [w for w in template.split() if rng.random() > rng.choice([0, 0.1, 0.4])]
        text = " ".join([*kept, *(rng.choice(other + words) for _ in range(rng.choice([0, 1, 5, 40])))])
        if not re.search(licenses.TERM, text.lower()):
            continue
        best = max(cosine(text, t) for _, t in licenses.TEMPLATES)
        if best >= licenses.LEAST_COSINE:
            near += 1
            assert limit.can_reach(text)
            assert limit.may_hold(f"some words before.\n{text}\nand after")
        dropped += not limit.can_reach(text)
    assert near > 300 and dropped > 300
    assert not limit.may_hold("") and not limit.may_hold(" ".join(other))
    assert not limit.can_reach("") and not limit.can_reach("words of no template " + " ".join(other))


def test_long_texts_and_parts_without_a_cue_word_are_not_compared(spark):
    mit = licenses.MIT_GRANT
    bare = re.sub(r"(?i)\b(license|permission|rights)\b", "grant", mit)
    assert not re.search(licenses.CUE, bare)
    prose = " ".join(f"word{k % 50} license" for k in range(300))
    files = spark.createDataFrame(
        [("a/1", mit), ("a/2", bare), ("a/3", prose), *((f"b/{k}", f"The license of {k} things.") for k in range(20))],
        "path string, text string",
    )
    workspace = Workspace(spark)
    found = {r["path"] for r in licenses.matches(files, workspace).collect()}
    assert found == {"a/1"}
    kept = workspace.load("sentences", spark.read.parquet(workspace.path("sentences")))
    assert kept.filter("path = 'a/3'").count() == 0


def test_files_inherit_from_directories_at_several_depths(spark, star_folder):
    notice = "Licensed under the MIT license."
    texts = {0: notice, 10: "Licensed under CC BY 4.0.", 25: "Released under the MIT License.", 130: "plain"}
    rows = [(k, texts.get(k, f"text {k}"), "en", "s") for k in range(0, 140, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    files = licenses.document_files(docs)
    paths = {r["doc_id"]: r["path"] for r in files.collect()}
    assert (paths[0], paths[100], paths[10], paths[25]) == ("s/en/0", "s/en/100", "s/en/0/10", "s/en/0/2/25")
    found = {r["path"]: r for r in licenses.scanned(files, Workspace(spark)).collect()}
    own, farther = found["s/en/0/2/25"], found["s/en/1/10/105"]
    assert own["own_license"] == own["license"] == "MIT" and own["inherited_from"] is None
    assert (farther["license"], farther["inherited_from"]) == ("MIT", "s/en")
    assert (found["s/en/0/4/45"]["license"], found["s/en/0/4/45"]["inherited_from"]) == ("CC-BY-4.0", "s/en/0")
    # In the query itself some files inherit from above their own directory.
    rows = op5_license_scans(spark, star_folder("0.1")).filter("inherited_from is not null").collect()
    above = [r for r in rows if r["path"].rsplit("/", 1)[0] != r["inherited_from"]]
    assert above and len(above) < len(rows)
