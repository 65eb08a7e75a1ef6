"""The licence automaton and the rules' model against plain forms of themselves."""

import random

import numpy as np


def test_matching_statistics_and_places_against_brute_force():
    from skipscan.llm import licences

    rng = random.Random(2)
    for _ in range(60):
        templates = [[rng.randrange(4) for _ in range(rng.randrange(1, 14))] for _ in range(rng.randrange(1, 4))]
        text = [rng.randrange(5) for _ in range(60)]
        made, size = licences.Automaton(templates), 3
        ends = made.ends(size)
        runs = {tuple(t[i:j]) for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        for at, (n, state) in enumerate(made.statistics(text)):
            assert n == max((k for k in range(at + 2) if k == 0 or tuple(text[at + 1 - k : at + 1]) in runs), default=0)
            if n >= size:
                last = text[at + 1 - size : at + 1]
                assert sorted(ends[state]) == [(k, i) for k, t in enumerate(templates) for i in range(size - 1, len(t)) if t[i + 1 - size : i + 1] == last]


def test_chains_against_all_chains():
    from skipscan.llm import licences

    rng = random.Random(4)
    for _ in range(200):
        runs = sorted([rng.randrange(60), rng.randrange(20), rng.randrange(3, 8)] for _ in range(rng.randrange(1, 7)))

        def follow(a, b):
            return 0 <= b[0] - a[0] - a[2] <= licences.GAP and a[1] + a[2] <= b[1]

        def best(j):
            return runs[j][2] + max((best(i) for i in range(j) if follow(runs[i], runs[j])), default=0)

        most = max(best(j) for j in range(len(runs)))
        got = licences.chains(runs, 1)
        assert max(c for _, _, c in got) == most
        assert all(a[1] < b[0] for a, b in zip(got, got[1:], strict=False))


def test_spans_of_a_template_with_changes():
    from skipscan.llm import licences

    scanner = licences.Scanner(licences.TEMPLATES, licences.PHRASES, licences.SEED, licences.COVER)
    rng = random.Random(6)
    for label, text in licences.TEMPLATES:
        w = licences.words(text.encode())
        if len(w) < 40:
            continue
        changed = list(w)
        for i in range(12, len(w) - 12, 25):
            changed[i] = b"changedword%d" % rng.randrange(99)
        found = scanner.spans([b"some", b"code", *changed, b"more", b"code"])
        assert (label, 2, len(w) + 1) in [s[:3] for s in found], label


def test_expectation_maximisation_against_its_plain_form():
    from skipscan.llm import quality

    rng = np.random.default_rng(7)
    rules, n = len(quality.RULES), 600
    truth = rng.random(n) < 0.7
    votes = np.where(rng.random((n, rules)) < 0.3, 2, np.where(rng.random((n, rules)) < 0.85, truth[:, None], ~truth[:, None]).astype(int))
    patterns, back, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    prior, weights = quality.fit(patterns, counts.astype(float))
    # document by document, with the same start and the same one added to each count
    good, bad = (votes == 1).sum(1), (votes == 0).sum(1)
    p = np.clip((good + 1) / (good + bad + 2), 0.05, 0.95)
    p = np.where(bad * 2 > good, np.minimum(p, 0.2), p)
    for _ in range(200):
        odds = np.full(n, np.log(p.sum() + 1) - np.log((1 - p).sum() + 1))
        for j in range(rules):
            share = [[(q[votes[:, j] == v].sum() + 1) / (q.sum() + 3) for v in range(3)] for q in (p, 1 - p)]
            odds += np.array([np.log(share[0][v]) - np.log(share[1][v]) for v in votes[:, j]])
        p = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
    got = 1 / (1 + np.exp(-(prior + weights[np.arange(rules), patterns].sum(1))))
    assert np.abs(got[back.ravel()] - p).max() < 1e-6
    assert ((p > 0.5) == truth).mean() > 0.95


def test_rules_of_latin_words_abstain_elsewhere():
    from skipscan.llm import quality

    text = "これは日本語の文章です。" * 60 + " " + " ".join("слово текста здесь стоит" for _ in range(40))
    got = dict(zip(quality.FEATURES, (np.array([x]) for x in quality.features(text.encode())), strict=True))
    votes = dict(zip(quality.RULES, quality.votes(got)[0].tolist(), strict=True))
    assert votes["word_length"] == votes["common_words"] == quality.ABSTAIN
