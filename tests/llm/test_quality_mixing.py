"""op4 and op7 against brute force."""

import random
from collections import Counter

from maieutic.llm import mixing, quality_rules


def plain_repeats(words, least):
    n, out = len(words), [0] * len(words)
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and words[i + k] == words[j + k]:
                k += 1
            out[i] = max(out[i], k)
    return [x if x >= least else 0 for x in out]


def test_repeat_lengths_random():
    rng = random.Random(1)
    for least in (1, 2, 3, 5, 8):
        for _ in range(40):
            docs = [[rng.choice([b"a", b"b", b"c"][: rng.randint(1, 3)]) for _ in range(rng.randint(0, 25))] for _ in range(4)]
            got, counts = quality_rules.repeat_lengths(docs, least)
            assert got.tolist() == sum((plain_repeats(d, least) for d in docs), [])
            assert counts.tolist() == [len(d) for d in docs]


def test_quality_edges(documents):
    clean = " ".join(f"w{i}" for i in range(60))
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [
        (1, clean), (2, None), (3, ""), (4, " \n\t "), (5, "one two"), (6, "x " * 4000), (7, passage + " " + passage),
        (8, "a\nb\na\n\n \na"), (9, "#tag $1 é😀 <b>"), (1, clean), (None, clean),
    ]
    got = quality_rules.judge_quality(documents(rows)).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and sum(r.doc_id == 1 for r in got) == 2
    assert by_id[1].kept and by_id[None].kept and not by_id[1].base_failed
    for i in (2, 3, 4):
        assert (by_id[i].n_words, by_id[i].base_failed, by_id[i].kept) == (0, True, False)
    assert (by_id[6].n_repeat_words, by_id[6].longest_repeat, by_id[6].kept) == (4000, 3999, False)
    assert (by_id[7].n_repeat_words, by_id[7].longest_repeat, by_id[7].base_failed) == (60, 30, True)
    assert by_id[8].n_dup_lines == 2
    assert (by_id[9].n_words, by_id[9].word_chars, by_id[9].n_symbols) == (4, 11, 4)
    assert quality_rules.judge_quality(documents([])).count() == 0
    kept = quality_rules.judge_quality(documents(rows), keep_columns=True)
    assert set(documents(rows).columns) == set(kept.columns) and kept.where("kept").count() == 3


def plain_targets(sizes, epochs=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, closed = sum(sizes.values()), set()
    while True:
        free = [s for s in sizes if s not in closed]
        level = (total - sum(epochs * sizes[s] for s in closed)) / max(1, sum(weight[s] for s in free))
        over = {s for s in free if weight[s] * level > epochs * sizes[s]}
        if not over:
            return {s: float(epochs * sizes[s]) if s in closed else weight[s] * level for s in sizes}
        closed |= over


def test_mix_targets_and_taken(documents):
    rng = random.Random(4)
    rows = []
    for s, n in (("a", 300), ("b", 5), ("É", 80), (None, 40), ("z", 1), ("", 60)):
        rows += [(len(rows) + i, " ".join(["w"] * rng.randint(0, 50)), s) for i in range(n)]
    rows += [(9000, None, "a"), (None, "x y", "a"), (7, "q q q", "a"), (7, "q q q", "a")]
    first = mixing.mix(documents(rows)).collect()
    again = mixing.mix(documents(rows, parts=7)).collect()
    assert Counter((r.doc_id, r.size, r.taken) for r in first) == Counter((r.doc_id, r.size, r.taken) for r in again)
    sizes = Counter()
    for _, text, s in rows:
        sizes[s] += len((text or "").split())
    want = plain_targets(sizes)
    taken = Counter()
    for r in first:
        assert r.source_size == sizes[r.source]
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.passes * r.size + r.part
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert len(first) == len(rows)


def test_mix_empty_and_wordless(documents):
    assert mixing.mix(documents([])).count() == 0
    got = mixing.mix(documents([(1, "", "a"), (2, None, None)])).collect()
    assert [(r.size, r.taken, r.target) for r in got] == [(0, 0, 0.0)] * 2


def test_mixed_documents_repeats_whole_rows(documents):
    rows = [(i, "w " * 10, "a") for i in range(90)] + [(100 + i, "v " * 10, "b") for i in range(2)]
    out = mixing.mixed_documents(documents(rows))
    assert out.columns == documents(rows).columns
    got = Counter(r.doc_id for r in out.collect())
    assert got[100] == got[101] == 3  # clamped at three epochs
