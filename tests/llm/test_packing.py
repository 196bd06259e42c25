"""Ids against the tokenizer, plans against exhaustive search, and the query."""

import random
import zlib
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
import pytest

from bandwright.llm import packing as P
from bandwright.llm import queries
from bandwright.llm.tables import Workspace


@pytest.fixture(scope="module")
def tokenizer():
    return P.WordTokenizer(P.public_path())


def test_ids_are_the_tokenizers(tokenizer):
    rng = random.Random(1)
    odd = "abcABCZ '''\t\n\x0b\x0c\r\x1c0129!?.,<|>éÉèçÖß×÷ıİſĀāñ²½ªº日本 ̀\x00\x85sdtmrevl"
    plain = "abcsdtmrevlABST ''  \t\n013!?.,<>éÉçÖöß\x00\x1f|"
    texts = ["".join(rng.choice(a) for _ in range(rng.randint(0, 50))) for a in [odd, plain] * 3000]
    texts += [None, "", "<|endoftext|> x", "it's they're don't 'there ''s I'LL we'd", "a" * 20_000]
    expected = tokenizer.whole.encode_batch([t or "" for t in texts], add_special_tokens=False)
    for text, ids, encoding in zip(texts, tokenizer.encode(pa.array(texts)), expected):
        assert ids.tolist() == encoding.ids, text


def test_forgotten_words_are_learned_again(tokenizer, monkeypatch):
    monkeypatch.setattr(P, "KEPT_WORDS", 3)
    for text in ["one two three four five", "one six", "two one seven"] * 2:
        (ids,) = tokenizer.encode(pa.array([text]))
        assert ids.tolist() == tokenizer.whole.encode(text, add_special_tokens=False).ids


def sequences(counts, capacity):
    """What each sequence of the plan holds, placing every piece by its rank."""
    runs = P.plan(counts, capacity)
    found = {}
    for length, n in counts.items():
        own = runs[runs["length"] == length]
        for rank in range(n):
            run = own[np.searchsorted(own["rank"], rank, "right") - 1]
            turn, slot = divmod(rank - run["rank"], run["each"])
            place = run["offset"] + slot * length
            found.setdefault(int(run["sequence"] + turn), []).append((int(place), length))
    return found


def is_gapless(held, capacity):
    end = 0
    for place, length in sorted(held):
        if place != end:
            return False
        end += length
    return end <= capacity


@pytest.mark.parametrize("seed", range(30))
def test_plans_place_every_piece_without_gaps(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 20, 100])
    counts = Counter(rng.randint(1, capacity) for _ in range(rng.randint(1, 200)))
    found = sequences(counts, capacity)
    assert all(is_gapless(held, capacity) for held in found.values())
    assert sum(map(len, found.values())) == sum(counts.values())


def fewest(lengths, capacity):
    """Least number of sequences, by search over all ways to fill the first one."""

    @cache
    def solve(left):
        if not left:
            return 0
        first, rest = left[0], left[1:]
        best = len(left)
        for mask in range(1 << len(rest)):
            chosen = [x for k, x in enumerate(rest) if mask >> k & 1]
            if first + sum(chosen) <= capacity:
                best = min(best, 1 + solve(tuple(x for k, x in enumerate(rest) if not mask >> k & 1)))
        return best

    return solve(tuple(sorted(lengths, reverse=True)))


@pytest.mark.parametrize("seed", range(60))
def test_reduction_never_costs_a_sequence(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 13, 20])
    lengths = [rng.randint(1 + capacity // 6, capacity) for _ in range(rng.randint(1, 9))]
    fixed, left = P.reduced(Counter(lengths), capacity)
    rest = list(left.counts.elements())
    assert sum(p.times for p in fixed) + fewest(rest, capacity) == fewest(lengths, capacity)


def test_large_histogram_is_close_to_the_bound():
    rng = np.random.default_rng(3)
    lengths = np.minimum(rng.lognormal(6, 1.2, 200_000).astype(int) + 1, 4096)
    counts = dict(zip(*map(np.ndarray.tolist, np.unique(lengths, return_counts=True))))
    runs = P.plan(counts)
    assert len(runs) < 40_000
    used = sum(p.times for p in P.reduced(counts, 4096)[0]) + sum(
        p.times for p in P.best_fit(P.reduced(counts, 4096)[1], 4096)
    )
    assert used <= 1.001 * lengths.sum() / 4096 + 1


def check(rows, texts, tokenizer, capacity=4096):
    expected = Counter()
    for i, text in texts:
        ids = [*tokenizer.whole.encode(text or "", add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[start : start + capacity], "<u4")
            expected[(i, piece, start, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter(tuple(r)[:5] for r in rows) == expected
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(is_gapless(h, capacity) for h in held.values())
    return len(held)


def test_odd_documents(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(P, "RANKED_ROWS", 3)
    texts = [(1, None), (2, ""), (2, ""), (None, "some words"), (4, "word " * 10_000)]
    texts += [(10 + k, "same text") for k in range(40)]
    documents = spark.createDataFrame(
        [(i, t, 1) for i, t in texts], "doc_id long, text string, length int"
    )
    rows = P.packed(documents, P.public_path(), Workspace(spark)).collect()
    assert check(rows, texts, tokenizer) == -(-sum(r["length"] for r in rows) // 4096)
    assert P.packed(documents.limit(0), P.public_path(), Workspace(spark)).count() == 0


def test_query_round_trip(spark, star_folder, tokenizer):
    folder = star_folder("0.01")
    read = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    rows = queries.op9_best_fit_packing(spark, folder).collect()
    n = check(rows, [tuple(r) for r in read], tokenizer)
    assert n <= -(-sum(r["length"] for r in rows) // 4096) + 1
