"""Licence spans: matches and chains against brute force, and licences that differ in a word."""

import itertools
import random

import pytest

from spanwright.llm import licence_scan
from spanwright.llm.licence_scan import MAX_GAP, MIN_MATCH, Scanner, words_of

SCANNER = Scanner()


def labels_of(text):
    return SCANNER.scan([text])[0][5]


@pytest.mark.parametrize(
    "text,labels",
    [
        ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by"),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "cc-by-nc"),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "cc-by-nc-nd"),
        ("This work is licensed under the Creative Commons Attribution-ShareAlike 3.0 Unported License.", "cc-by-sa"),
        ("Released under CC Attribution 3.0 Unported by its author", "cc-by"),
        ("Text: Creative Commons Attribution-NoDerivs 3.0 Unported", "cc-by-nd"),
        ("we thank the creative commons attribution team for help", ""),
    ],
)
def test_parts_of_a_name_make_another_licence(text, labels):
    assert labels_of(text) == labels


def test_every_template_gets_its_own_label():
    for label, text in licence_scan.TEMPLATES:
        base = SCANNER.scan([text])[0][4]
        assert set(labels_of("x " + text + " y").split(",")) == {label, *base.split(",")} - {""}


def test_each_of_two_licences_in_a_file():
    gpl, agpl = (next(t for label, t in licence_scan.TEMPLATES if label == x) for x in ("gpl", "agpl"))
    spans = SCANNER.scan([f"{agpl} and beside it {gpl}"])[0][7]
    n = len(words_of(agpl))
    assert [(s["label"], s["first"] < n) for s in sorted(spans, key=lambda s: s["first"])] == [("agpl", True), ("gpl", False)]


def small(seed):
    rng = random.Random(seed)
    letters = "a b c d e f".split()
    templates = tuple((f"t{i}", " ".join(rng.choices(letters, k=rng.randint(8, 14)))) for i in range(3))
    cut = lambda t: t.split()[rng.randint(0, 3) : rng.randint(6, 14)]
    words = [w for _ in range(4) for w in [*cut(rng.choice(templates)[1]), *["z"] * rng.randint(0, 3), *rng.choices(letters, k=rng.randint(0, 3))]]
    return Scanner(templates), [words_of(t) for _, t in templates], [w.encode() for w in words]


@pytest.mark.parametrize("seed", range(12))
def test_matches_are_all_places_of_the_longest_substrings(seed):
    scanner, templates, words = small(seed)
    got = set(scanner.matches([scanner.number.get(w, -1) for w in words], 0))
    inside = lambda x: any(x == t[i : i + len(x)] for t in templates for i in range(len(t)))
    ends = {}  # the longest substring of any template that ends at each word
    for j in range(len(words)):
        ends[j] = next((j + 1 - i for i in range(j + 1) if inside(words[i : j + 1])), 0)
    want = set()
    for j, n in ends.items():
        if n >= MIN_MATCH and ends.get(j + 1, 0) != n + 1:
            want |= {(j + 1 - n, k, i, n) for k, t in enumerate(templates) for i in range(len(t)) if t[i : i + n] == words[j + 1 - n : j + 1]}
    assert got == want


@pytest.mark.parametrize("seed", range(40))
def test_the_best_chain_equals_brute_force(seed):
    rng = random.Random(seed)
    scanner = Scanner((("t", " ".join(f"w{i}" for i in range(60))),))
    found = sorted({(rng.randrange(50), 0, rng.randrange(45), rng.randint(4, 9)) for _ in range(9)})
    order, kept = [], -1
    for start, w, place, n in found:  # maximal matches end in the order of their starts
        if start + n > kept:
            order.append((start, w, place, n))
            kept = start + n
    best = 0
    for size in range(1, len(order) + 1):
        for chain in itertools.combinations(order, size):
            covered, ok = chain[0][3], True
            for (s, _, p, n), (start, _, place, m) in itertools.pairwise(chain):
                overlap = max(0, s + n - start, p + n - place)
                ok = ok and s < start and p < place and start - s - n <= MAX_GAP and place - p - n <= MAX_GAP
                covered += m - overlap
            best = max(best, covered if ok else 0)
    chains = scanner.chains(order)
    assert max(c[3] for c in chains) == best
    taken = sorted((c[1], c[2]) for c in chains)
    assert all(a[1] < b[0] for a, b in itertools.pairwise(taken))  # disjoint


def test_a_long_file_of_many_licences_takes_linear_time():
    import time

    text = " ".join(t for _, t in licence_scan.TEMPLATES)
    start = time.perf_counter()
    spans = Scanner().scan([(text + " zzz ") * 40])[0][7]
    assert len(spans) > 40 * 20 and time.perf_counter() - start < 30
