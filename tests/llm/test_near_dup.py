"""op3, op5, op8: links, components and removals against brute force."""

import random
from itertools import combinations

import numpy as np

from maieutic.llm import line_dedup, linking, near_dup, paragraph_dedup
from maieutic.llm.components import components
from maieutic.llm.queries import OP5_PARAMETERS
from maieutic.llm.shingles import find_words, shingle_sets


def plain_components(nodes, links):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def test_components_chains_stars_rings(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000 + i, 5000 + (i + 1) % 50) for i in range(50)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links + links[:5] + [(7, 7)], "a long, b long")).collect()}
    want = plain_components({x for p in links for x in p}, links)
    groups = lambda m: {frozenset(x for x in m if m[x] == r) for r in m.values()}
    assert groups(got) == groups(want)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_set(text, size):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def variants(rng, n_groups, most):
    """Texts in groups of copies with more and more words changed."""
    rows = []
    for _ in range(n_groups):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(30, 90))]
        for _ in range(rng.randint(1, most)):
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = f"x{rng.randint(0, 9999)}"
            rows.append((len(rows), " ".join(words)))
    return rows


def check_near(documents, rows, size):
    sets = {i: plain_set(t, size) for i, (_, t) in enumerate(rows)}
    links = [
        (a, b) for a, b in combinations(sets, 2)
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    root = plain_components(sets, links)
    least = {}
    for i, r in root.items():
        ids = [rows[j][0] for j in root if root[j] == r and rows[j][0] is not None]
        least[i] = (rows[i][0], len(sets[i]), min(ids, default=None) if sets[i] else rows[i][0])
    got = near_dup.near_duplicates(documents(rows), shingle=size).collect()
    key = lambda t: (t[0] is None, t[0] or 0, t[1], t[2] is None, t[2] or 0)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(least.values(), key=key)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    return got


def test_near_duplicates_random_groups(documents):
    rng = random.Random(2)
    rows = variants(rng, 40, 12)
    rows += [(i + 5000, t) for i, (_, t) in enumerate(rows[:30])]
    check_near(documents, rows, 4)


def test_near_duplicates_edges(documents):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [
        (1, None), (2, ""), (3, " \n "), (4, "one two"), (5, "ONE two"), (6, "one two three"), (9, long), (8, long + " end"), (7, "a b c d e f"),
        (7, "a b c d e f"), (7, "other words that differ from it"), (None, "A b c d e f"), (None, "null only text here"), (None, None),
    ]
    got = check_near(documents, rows, 5)
    for group in {r.component_id for r in got if r.n_shingles and r.component_id is not None}:
        same = [r for r in got if r.component_id == group and r.n_shingles]
        assert len({bytes(r.row_key) for r in same if r.stays}) >= 1
    assert near_dup.near_duplicates(documents([])).count() == 0


def test_leftovers_link_inside_large_clusters(documents, monkeypatch):
    """Tiles smaller than a cluster lose no link."""
    monkeypatch.setattr(linking, "TILE", 4)
    check_near(documents, variants(random.Random(8), 3, 45), 4)


def test_plausible_keeps_true_pairs():
    rng = np.random.default_rng(0)
    for _ in range(30):
        n = int(rng.integers(20, 400))
        base = [f"w{x}" for x in rng.integers(0, 10**6, n)]
        other = list(base)
        for _ in range(max(1, n // 60)):
            other[rng.integers(0, n)] = "zz"
        values, counts = shingle_sets([" ".join(t).encode() for t in (base, other)], 4)
        a, b = values[: counts[0]], values[counts[0] :]
        both = len(np.intersect1d(a, b))
        if both >= 0.8 * (len(a) + len(b) - both):
            regs = near_dup.sketch(values, counts, 96)
            less, more = np.array([(regs[0] < regs[1]).sum()]), np.array([(regs[0] > regs[1]).sum()])
            assert linking.plausible(np.array([len(a)]), np.array([len(b)]), less, more, 96, 0.8).all()


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed(rng, line, alphabet, edits):
    out = bytearray(line)
    for _ in range(edits):
        at = rng.randrange(len(out) + 1)
        kind = rng.randrange(3)
        if kind == 0:
            out.insert(at, rng.choice(alphabet))
        elif at < len(out):
            if kind == 1:
                del out[at]
            else:
                out[at] = rng.choice(alphabet)
    return bytes(out)


def test_within_edits_random():
    rng = random.Random(3)
    for _ in range(8000):
        alphabet = rng.choice([b"ab", b"abcdefgh"])
        a = bytes(rng.choices(alphabet, k=rng.randint(0, 14)))
        b, k = changed(rng, a, alphabet, rng.randint(0, 5)), rng.randint(0, 4)
        assert line_dedup.within_edits(a, b, k) == (plain_edits(a, b) <= k)


def test_segment_keys_find_every_near_pair():
    rng = random.Random(6)
    for _ in range(4000):
        k, alphabet = rng.choice([1, 2, 3]), rng.choice([b"ab", b"abcdefgh"])
        a = bytes(rng.choices(alphabet, k=rng.randint(10, 24)))
        b = changed(rng, a, alphabet, k)
        data = np.frombuffer(a + b, np.uint8)
        keys = line_dedup.segment_keys(data, np.array([0, len(a)]), np.array([len(a), len(b)]), k)
        if plain_edits(a, b) <= k:
            assert set(keys[0].tolist()) & set(keys[1].tolist())


def plain_removal(rows, units_of, linked):
    """Result of keeping the first of each cluster; ``units_of`` gives (start, stop, unit) of a text."""
    places = [(i, *u) for i, (_, t) in enumerate(rows) for u in units_of((t or "").encode())]
    root = plain_components(range(len(places)), [p for p in combinations(range(len(places)), 2) if linked(places[p[0]][3], places[p[1]][3])])
    order = lambda j: (rows[places[j][0]][0], places[j][1])
    first = {r: min((j for j in root if root[j] == r), key=order) for r in set(root.values())}
    out = []
    for i, (doc_id, text) in enumerate(rows):
        gone = [j for j, p in enumerate(places) if p[0] == i and first[root[j]] != j]
        body, at = b"", 0
        text = (text or "").encode()
        for j in gone:
            body += text[at : places[j][1]]
            at = places[j][2]
        out.append((doc_id, len(text), len(gone), body + text[at:], sorted({rows[places[first[root[j]]][0]][0] for j in gone})))
    return sorted(out)


def removed(df):
    return sorted((r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept), list(r.first_ids)) for r in df.collect())


def lines_of(text):
    at = 0
    for line in text.split(b"\n"):
        if len(line) >= 20 and line.strip():
            yield at, min(at + len(line) + 1, len(text)), line
        at += len(line) + 1


def test_line_dedup_random(documents):
    rng = random.Random(11)
    pool = ["".join(rng.choices("abcé ", k=rng.randint(18, 40))) for _ in range(25)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(0, 6)):
            line = rng.choice(pool)
            if rng.random() < 0.6:
                line = changed(rng, line.encode(), b"abcd", rng.randint(0, 3)).decode("utf-8", "replace").replace("\n", "")
            lines.append(line)
        rows.append((i, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "short\nshort"), (104, " " * 50 + "\n" + " " * 50)]
    want = plain_removal(rows, lines_of, lambda a, b: plain_edits(a, b) <= 2)
    assert removed(line_dedup.remove_lines(documents(rows))) == want


def test_line_dedup_repeats_and_empty(documents):
    line = "a line of more than twenty bytes"
    got = line_dedup.remove_lines(documents([(2, line), (2, line), (1, f"{line}\n{line}"), (None, line)])).collect()
    assert sorted((r.doc_id or 99, bytes(r.kept), r.first_ids) for r in got) == [
        (1, f"{line}\n".encode(), [1]), (2, b"", [1]), (2, b"", [1]), (99, b"", [1]),
    ]
    assert line_dedup.remove_lines(documents([])).count() == 0


def every_line_of(text):
    at = 0
    for line in text.split(b"\n"):
        if line.strip():
            yield at, min(at + len(line) + 1, len(text)), line
        at += len(line) + 1


def test_short_lines_repeat_exactly(documents):
    rng = random.Random(31)
    pool = ["".join(rng.choices("abé ", k=rng.randint(1, 30))) for _ in range(30)] + ["Read more", "Log in", "Log in "]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 7)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \n \n"), (103, "only here\nshort\nshort"), (104, "a" * 19), (105, "a" * 20), (106, "a" * 21)]
    near = lambda a, b: a == b or min(len(a), len(b)) >= 20 and plain_edits(a, b) <= 2
    want = plain_removal(rows, every_line_of, near)
    assert {r[0]: r[2] for r in want if r[0] > 100} == {101: 0, 102: 0, 103: 1, 104: 0, 105: 0, 106: 1}
    assert removed(line_dedup.remove_lines(documents(rows), max_edits=2, min_bytes=20, exact_below=True)) == want


def paragraphs_of(text):
    import re

    spans, first, last = [], None, None
    words = list(re.finditer(rb"[^\x20\x09-\x0D]+", text))
    for i, w in enumerate(words):
        first = i if first is None else first
        nxt = words[i + 1] if i + 1 < len(words) else None
        if nxt is None or w.group()[-1:] in b".!?" or b"\n" in text[w.end() : nxt.start()]:
            spans.append((first, i, nxt.start() if nxt else len(text)))
            first = None
    for a, b, stop in spans:
        if b - a + 1 >= 10:
            yield words[a].start(), stop, b" ".join(w.group() for w in words[a : b + 1])


def test_paragraph_dedup_random(documents):
    rng = random.Random(12)
    pool = [" ".join(f"w{rng.randint(0, 300)}" for _ in range(rng.randint(8, 40))) for _ in range(20)]
    rows = []
    for i in range(50):
        text = ""
        for _ in range(rng.randint(0, 5)):
            words = rng.choice(pool).split()
            if rng.random() < 0.4:
                words[-1] = f"z{rng.randint(0, 99)}"
            text += " ".join(words) + rng.choice([". ", "\n", "! ", "?\n\n"])
        rows.append((i, text))
    rows += [(100, None), (101, ""), (102, ". . ."), (103, "one two three.")]

    def linked(a, b):
        x, y = plain_set(a.decode(), 5), plain_set(b.decode(), 5)
        return a.lower() == b.lower() or 100 * len(x & y) >= 80 * len(x | y)

    want = plain_removal(rows, paragraphs_of, linked)
    assert removed(paragraph_dedup.remove_paragraphs(documents(rows), recall=0.99999, most_bands=16)) == want
    assert paragraph_dedup.remove_paragraphs(documents([])).count() == 0


def test_embedded_passage_is_found(documents):
    passage = ". ".join(" ".join(f"p{i}x{j}" for j in range(14)) for i in range(4)) + "."
    rows = [(i, f"Clean words of document number {i} go first. {passage} And here it goes on with {i}.") for i in range(3)] + [(9, "Nothing here repeats at all, it is just one clean text.")]
    got = {r.doc_id: r for r in paragraph_dedup.remove_paragraphs(documents(rows)).collect()}
    assert [got[i].n_removed for i in (0, 1, 2, 9)] == [0, 4, 4, 0]
    assert got[1].first_ids == [0] and b"p1x3" not in bytes(got[1].kept)


def test_passages_hold_every_word_and_copies_cut_alike():
    rng = random.Random(21)
    for _ in range(60):
        texts = [" ".join(rng.choice(["a", "b", f"w{rng.randint(0, 500)}"]) + rng.choice(["", "", "", ".", "\n"]) for _ in range(rng.randint(0, 200))) for _ in range(5)]
        words = find_words([t.encode() for t in texts + ["same " * 300, "", "x"]])
        first, count, text = paragraph_dedup.find_passages(words, 10)
        assert count.sum() == len(words.starts) and (first == np.cumsum(count) - count).all()
        assert np.bincount(text, count, len(words.counts)).tolist() == words.counts.tolist()
        assert all(10 <= n < 40 or n == words.counts[t] < 10 for n, t in zip(count.tolist(), text.tolist()))
        copy = " ".join(f"c{rng.randint(0, 999)}" for _ in range(120))
        cuts = []
        for host in texts[:2]:
            words = find_words([f"{host} {copy} {host}".encode()])
            at = len(host.split())
            first, _, _ = paragraph_dedup.find_passages(words, 10)
            cuts.append([x - at for x in first.tolist() if at + 60 <= x <= at + 100])  # beyond a long unit that begins in the host
        assert cuts[0] == cuts[1] and cuts[0]


def test_passages_of_short_sentences_or_without_marks_are_found(documents):
    rng = random.Random(22)
    host = lambda n: " ".join(f"h{rng.randint(0, 10**6)}" for _ in range(n))
    short = " ".join(" ".join(f"s{i}x{j}" for j in range(6)) + "." for i in range(10))
    bare = " ".join(f"b{i}" for i in range(60))
    listed = "\n".join(f"l{i}x{j} l{j}y{i}" for i in range(6) for j in range(5))
    for passage in (short, bare, listed):
        rows = [(i, f"{host(25)} {passage} {host(25)}") for i in range(3)] + [(9, host(70))]
        got = {r.doc_id: r for r in paragraph_dedup.remove_paragraphs(documents(rows), **OP5_PARAMETERS).collect()}
        assert [got[i].n_removed for i in (0, 9)] == [0, 0]
        for i in (1, 2):
            left = set(bytes(got[i].kept).decode().split())
            assert got[i].first_ids == [0] and len(left & set(passage.split())) <= 0.6 * 60, passage


def test_short_texts_repeat_only_as_a_whole(documents):
    rows = [(1, "one two three."), (2, "One two three. "), (3, "one two three four."), (4, "x"), (5, "x"), (6, None), (7, " ")]
    got = {r.doc_id: bytes(r.kept) for r in paragraph_dedup.remove_paragraphs(documents(rows), **OP5_PARAMETERS).collect()}
    assert got == {1: b"one two three.", 2: b"", 3: b"one two three four.", 4: b"x", 5: b"", 6: b"", 7: b" "}


def passages_of(text):
    words = find_words([text])
    first, count, _ = paragraph_dedup.find_passages(words, OP5_PARAMETERS["min_words"])
    starts = np.append(words.starts, len(text))
    for a, n in zip(first.tolist(), count.tolist()):
        yield int(starts[a]), int(min(starts[a + n], len(text))), b" ".join(text[s:e] for s, e in zip(words.starts[a : a + n], words.ends[a : a + n]))


def test_passage_dedup_of_the_query_equals_brute_force(documents):
    rng = random.Random(23)
    pool = [" ".join(f"w{rng.randint(0, 300)}" + rng.choice(["", "", "", "."]) for _ in range(rng.randint(4, 60))) for _ in range(20)]
    rows = []
    for i in range(60):
        text = ""
        for _ in range(rng.randint(0, 4)):
            words = rng.choice(pool).split()
            if rng.random() < 0.5:
                words[rng.randrange(len(words))] = f"z{rng.randint(0, 99)}"
            text += " ".join(words) + rng.choice([". ", "\n", " ", "?\n\n"])
        rows.append((i, text))
    rows += [(100, None), (101, ""), (102, ". . ."), (103, "one two three."), (104, "One two  three.")]

    def linked(a, b):
        x, y = plain_set(a.decode(), 5), plain_set(b.decode(), 5)
        return a.lower() == b.lower() or min(len(a.split()), len(b.split())) >= 10 and 100 * len(x & y) >= 80 * len(x | y)

    want = plain_removal(rows, passages_of, linked)
    assert sum(r[2] for r in want) > 60
    assert removed(paragraph_dedup.remove_paragraphs(documents(rows), **OP5_PARAMETERS)) == want


def test_isolated_pairs_at_the_threshold_are_found(documents):
    """1500 pairs of 13 words that share 8 of 10 shingles; 3 bands of one hash miss about 12 of them."""
    bands, rows = paragraph_dedup.tune_bands(0.8, OP5_PARAMETERS["recall"], OP5_PARAMETERS["most_bands"])
    assert (1 - 0.8**rows) ** bands <= 1e-4
    texts = [(2 * i + j, " ".join(f"p{i}x{k}" for k in range(12)) + f" end{j}") for i in range(1500) for j in range(2)]
    got = {r.doc_id: r.n_removed for r in paragraph_dedup.remove_paragraphs(documents(texts), **OP5_PARAMETERS).collect()}
    assert got == {i: i % 2 for i, _ in texts}


def test_tuned_bands():
    assert paragraph_dedup.tune_bands(0.8, 0.99, 4) == (3, 1)
    bands, rows = paragraph_dedup.tune_bands(0.8, 0.9999, 20)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands <= 20


def test_a_tile_at_once_equals_pair_by_pair():
    rng = np.random.default_rng(4)
    test = linking.Jaccard(80)
    bodies = [np.unique(rng.integers(0, 40, rng.integers(1, 30))) for _ in range(60)] + [np.arange(20), np.arange(20), np.arange(1, 21)]
    index = test.index(bodies)
    for a in bodies:
        assert test.linked_to(index, a).tolist() == [test.linked(a, b) for b in bodies]
