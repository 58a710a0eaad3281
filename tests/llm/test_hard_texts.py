"""Long and repetitive texts, shared wording, and completeness on short texts."""

import random
import time

import numpy as np
import pytest
from minutes_spark.llm import decontaminate as D, pieces


def words(rng, count):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(count))


# --- decontamination ------------------------------------------------------------------------


def nearest(pattern, text):
    """Least edits of ``pattern`` against what ends at each position of ``text``, by the plain table."""
    row = np.zeros(len(text) + 1, int)
    for at, code in enumerate(pattern, 1):
        new = np.empty_like(row)
        new[0] = at
        for j, letter in enumerate(text, 1):
            new[j] = min(row[j - 1] + (code != letter), row[j] + 1, new[j - 1] + 1)
        row = new
    return row


def damaged(rng, text, edits):
    chars = list(text)
    for _ in range(edits):
        at = rng.randrange(len(chars))
        kind = rng.randrange(3)
        if kind == 0:
            chars[at] = rng.choice("xyzq")
        elif kind == 1:
            chars.insert(at, rng.choice("xyzq"))
        elif len(chars) > 1:
            del chars[at]
    return "".join(chars)


@pytest.mark.parametrize("seed", range(6))
def test_every_place_within_the_budget_is_found(seed):
    rng = random.Random(seed)
    opening = words(rng, 9)
    items = [(n, (opening + " " if n % 2 else "") + words(rng, rng.choice([3, 6, 14]))) for n in range(6)]
    items += [(90, "ruled " + "-" * 60), (91, "abab" * 12)]
    index = D.PassageIndex.build(items)
    parts = []
    for _ in range(8):
        item = rng.choice(items)[1]
        a = rng.randrange(max(1, len(item) // 2))
        part = item[a : a + rng.randint(20, 20 + len(item))]
        parts.append(damaged(rng, part, rng.randrange(0, 6)))
        parts.append(rng.choice([words(rng, 5), "-" * rng.randrange(90), "ab" * rng.randrange(40), "\n"]))
    text = " ".join(parts)
    codes = D.plain(D.codes_of(text))
    found = index.hits([text])[0]
    for passage, pattern in enumerate(index.passages):
        budget = int(index.budget[passage])
        ends = np.flatnonzero(nearest(pattern, codes) <= budget)
        for item in index.held_by[index.held_by[:, 0] == passage, 1].tolist():
            spans = [(a, b) for i, a, b, _ in found if i == index.items[item]]
            for end in ends.tolist():
                # every near place meets a hit of its item
                assert any(a < end and end - len(pattern) - budget < b for a, b in spans), (passage, end)
    for i, a, b, edits in found:
        assert 0 <= a < b <= len(text)
        # joined stretches of repetitive items hold shifted parts, each within its own budget
        assert i >= 90 or edits <= 2 * D.EDITS * len(dict(items)[i]) + 1


def test_bit_columns_equal_the_plain_table():
    rng = random.Random(5)
    for _ in range(60):
        pattern = np.array([rng.choice([97, 98, 99]) for _ in range(rng.randint(1, 64))], np.uint32)
        text = np.array([rng.choice([97, 98, 99]) for _ in range(rng.randint(1, 90))], np.uint32)
        want = nearest(pattern, text)[1:]
        assert D._edits_behind(len(pattern), D._masks(pattern.tolist()), text.tolist(), 0) == want.tolist()
        letters = np.full((1, 64), D._NO_LETTER - 1, np.uint32)
        letters[0, : len(pattern)] = pattern
        edits = np.array([rng.randrange(5)])
        _, end, cost = D.near_ends(letters, np.array([len(pattern)]), edits, text, np.array([0]), np.array([len(text)]))
        assert list(zip(end.tolist(), cost.tolist())) == [(j + 1, c) for j, c in enumerate(want.tolist()) if c <= edits[0]]


def test_items_with_one_opening():
    rng = random.Random(1)
    opening = words(rng, 16)[:86]
    items = [(n, f"{opening} {words(rng, 25)}") for n in range(400)]
    index = D.PassageIndex.build(items)
    text = " xx ".join(t for _, t in items[:100])
    start = time.perf_counter()
    found = index.hits([text])[0]
    assert time.perf_counter() - start < 10
    whole = {i for i, a, b, e in found if b - a == len(dict(items)[i]) and e == 0}
    assert whole == set(range(100))
    assert {i for i, *_ in found} == set(range(400)) and len(found) == 100 * 400


def test_a_megabyte_of_dashes():
    index = D.PassageIndex.build([(1, "Header of a page " + "-" * 80 + " footer text that goes on with some words")])
    start = time.perf_counter()
    found = index.hits(["-" * 1_000_000, "- " * 300_000, ("-" * 70 + "\nwords here\n") * 4000])
    assert time.perf_counter() - start < 40
    ends = sorted((a, b) for _, a, b, _ in found[0])
    assert ends[0][0] == 0 and ends[-1][1] == 1_000_000 and len(ends) <= 1_000_000 / 30
    assert all(c <= b for (_, b), (c, _) in zip(ends, ends[1:]))
    assert not found[1] and 4000 <= len(found[2]) <= 16_000


# --- pieces ---------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tiny():
    scored = [("a", -1.0), ("b", -1.0), ("ab", -2.0), ("aa", -2.0), ("ba", -2.0), ("aba", -3.0), ("▁", 0.0), ("▁a", -1.0)]
    rows = [(p, s, "normal") for p, s in scored] + [(f"<0x{b:02X}>", 0.0, "byte") for b in range(256)]
    return pieces.Vocabulary(rows)


def every(vocabulary, lattice):
    """(score, ids) of all segmentations."""
    ways = {0: [(0.0, ())]}
    for at in range(1, lattice.size + 1):
        ways[at] = [
            (s + lattice.scores[arc], (*w, arc))
            for arc in range(len(lattice.ids)) if lattice.ends[arc] == at for s, w in ways[lattice.starts[arc]]
        ]
    return sorted(((s, lattice.spelled(w)) for s, w in ways[lattice.size]), key=lambda x: -x[0])


def test_n_best_with_many_ties_equals_all_segmentations(tiny):
    rng = random.Random(2)
    for _ in range(80):
        lattice = pieces.Lattice(tiny, " " + "".join(rng.choice("aabx") for _ in range(rng.randint(1, 9))))
        want = every(tiny, lattice)
        for n in (1, 3, 7, 50):
            got = lattice.n_best(n)
            assert [s for s, _ in got] == [s for s, _ in want[:n]]
            assert len({i for _, i in got}) == len(got) and {(s, i) for s, i in got} <= set(want)
        _, arcs = lattice.path()
        assert lattice.loss(arcs) == (want[0][0] - want[1][0] if len(want) > 1 else np.inf)


@pytest.mark.parametrize("text", ["random", "same"])
def test_a_long_text_without_spaces(text):
    rng = random.Random(3)
    letters = "a" * 300_000 if text == "same" else "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(300_000))
    start = time.perf_counter()
    lattice = pieces.Lattice(pieces.Vocabulary.load(), " " + letters)
    found = lattice.n_best(3)
    assert time.perf_counter() - start < 20
    assert found[0][0] == lattice.best[lattice.size] and len({ids for _, ids in found}) == 3
    assert found[0][0] >= found[1][0] >= found[2][0]
