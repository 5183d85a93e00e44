"""op11, op12 and op13 against brute force, the tokenizer libraries, numpy and held-out labels."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from maieutic.llm import quality_classifier, queries, token_alignment, whitening


# --- op11 ------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def vocabularies():
    return tuple(map(queries.tokenizer_path, queries.ALIGNED_VOCABULARIES))


@pytest.fixture(scope="module")
def plain_tokens(vocabularies):
    """Tokens of a whole text by the libraries alone: [(id, start, end)] of A and of B, or none."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(vocabularies[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=vocabularies[1])
    shown = [*range(33, 127), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letter = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in shown)}

    def tokens(text):
        if not text:
            return [], []
        out = []
        ids = a.encode(" " + text, add_special_tokens=False).ids
        out.append([(i, bytes(letter[c] for c in a.id_to_token(i))) for i in ids])
        pieces = [(i, b.id_to_piece(i)) for i in b.encode(text)]
        out.append([(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in pieces])
        if any(b"".join(x for _, x in side) != (" " + text).encode() for side in out):
            return [], []
        placed = []
        for side in out:
            at, rows = 0, []
            for i, x in side:
                rows.append((i, at, at + len(x)))
                at += len(x)
            placed.append(rows)
        return placed

    return tokens


def plain_alignment(docs, tokens, pairing="end"):
    """Rows (id, n_a, n_b, n_groups, n_links, n_best, count_sum, digest) of all documents at once."""
    per, pair = [], Counter()
    for doc_id, text in docs:
        a, b = tokens(text)
        if pairing == "end":
            links = [(i, j) for i, _, e in a for j, _, f in b if e == f]
        else:
            links = [(i, j) for i, s, e in a for j, t, f in b if s < f and t < e]
        cuts, low, groups = sorted({e for _, _, e in a} & {e for _, _, e in b}), 0, []
        for c in cuts:
            groups.append("|".join(",".join(str(i) for i, s, e in side if low <= s and e <= c) for side in (a, b)))
            low = c
        pair.update(links)
        per.append((doc_id, len(a), len(b), groups, links))
    most = defaultdict(int)
    for (_, j), n in pair.items():
        most[j] = max(most[j], n)
    return sorted(
        ((d, na, nb, len(g), len(k), sum(pair[x] == most[x[1]] for x in k), sum(pair[x] for x in k),
          hashlib.sha256(";".join(g).encode()).hexdigest() if na else "") for d, na, nb, g, k in per), key=repr,
    )


ODD = [
    "", " ", "  ", "a", " lead and trail ", "two  spaces", "tab\there\n new  line\n\n", "it's I'll don't 's", "12 345 ½ ²",
    "<|endoftext|> <s></s> <0x41> <unk>", "under▁score", "\x00\x1c\x85  x 　y", "é é ﬁ Å 中文 😀 ß İ", "x" * 3000, "word " * 2000,
]


@pytest.mark.parametrize("pairing", ["end", "overlap"])
def test_alignment_equals_brute_force(spark, documents, vocabularies, plain_tokens, pairing):
    rng = random.Random(5)
    bits = [" ", "  ", "\n", "the", "ing", "Straße", "né", "—", "'s", "9", "ñoñ", "un", "break", "able", ",", "<|endoftext|>", "😀"]
    docs = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, "".join(rng.choice(bits) for _ in range(rng.randint(1, 40)))) for i in range(300)]
    docs += [(3, "repeated id"), (None, "no id"), (None, None), (500, None), (100, docs[20][1])]
    small = [d for d in docs if d[1] is None or len(d[1]) < 1000] if pairing == "overlap" else docs
    got = token_alignment.align_tokenizers(documents(small), *vocabularies, pairing=pairing)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_alignment(small, plain_tokens, pairing)


def test_alignment_with_few_broadcast_pairs(documents, vocabularies, plain_tokens):
    docs = [(i, f"the common words and the rare{i} word {i * 37}") for i in range(200)]
    for most in (0, 3, 50):
        got = token_alignment.align_tokenizers(documents(docs), *vocabularies, broadcast_pairs=most)
        assert sorted(map(tuple, got.collect()), key=repr) == plain_alignment(docs, plain_tokens)


def test_frequent_level_is_bounded(spark):
    counts = spark.createDataFrame([(i, n) for i, n in enumerate([1] * 50 + [2, 3] * 5 + [8, 9, 700])], "pair long, links long")
    for most, level in ((100, 1), (62, 2), (13, 2), (12, 4), (3, 4), (2, 16), (1, 16), (0, 1024)):
        assert token_alignment.frequent_level(counts, most) == level
        assert counts.where(f"links >= {level}").count() <= most


def test_alignment_empty_table_and_memory_bounds(spark, documents, vocabularies, plain_tokens, monkeypatch):
    assert token_alignment.align_tokenizers(documents([]), *vocabularies).count() == 0
    # With a memo of a few segments, calls of a few bytes and without the proofs the result stays the same.
    texts = [f"some {'word ' * (i % 7)}here {i} and\nthere" for i in range(60)]
    aligner = token_alignment.Aligner(*vocabularies, "end")
    want = [(r[:4], r[4].tolist()) for r in aligner.align(texts)]
    monkeypatch.setattr(token_alignment, "MEMO_SEGMENTS", 5)
    monkeypatch.setattr(token_alignment, "CALL_BYTES", 10)
    assert [(r[:4], r[4].tolist()) for t in texts for r in aligner.align([t])] == want
    aligner.ranks = None
    aligner._forget()
    assert [(r[:4], r[4].tolist()) for r in aligner.align(texts)] == want
    aligner.cuts = False
    aligner._forget()
    assert [(r[:4], r[4].tolist()) for r in aligner.align(texts)] == want


def test_coalescing_of_overlapping_intervals():
    starts, ends, side = np.array([0, 4, 9, 0, 3, 9]), np.array([4, 9, 12, 3, 9, 12]), np.array([0, 0, 0, 1, 1, 1])
    order, group = token_alignment.coalesce(starts, ends, side)
    assert order.tolist() == [0, 3, 4, 1, 2, 5] and group.tolist() == [0, 0, 0, 0, 1, 1]


def test_alignment_of_the_table(spark, plain_tokens):
    got = {r.doc_id: tuple(r)[1:5] + (r.groups_sha256,) for r in queries.op11_token_alignment(spark, "/root/testdata/sf0.001").collect()}
    docs = [(r.doc_id, r.text) for r in queries.table(spark, "/root/testdata/sf0.001", "documents").collect()]
    short = [d for d in docs if len(d[1] or "") < 3000]
    want = {r[0]: r[1:5] + r[7:] for r in plain_alignment(short, plain_tokens)}
    assert len(got) == len(docs) and all(got[k] == v for k, v in want.items())


# --- op12 ------------------------------------------------------------------------------------
def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, component string, n string, x string, id string")


def table_of(found):
    rows = found.collect()
    k = max((r.component for r in rows), default=0)
    by_id = defaultdict(lambda: [None] * k)
    for r in rows:
        by_id[r.vec_id][r.component - 1] = r.whitened
    return rows, by_id


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(3)
    for dim, n in ((1, 20), (2, 30), (7, 50), (24, 400)):
        x = (rng.standard_normal((n, dim)) * rng.uniform(0.05, 2, dim)).astype(np.float32)
        found = whitening.whiten(vectors(spark, [(i, v.tolist(), "", "", "", "") for i, v in enumerate(x)]).repartition(5), 8)
        rows, by_id = table_of(found)
        whole = np.floor(x.astype(float) * 1024)
        centred = whole - whole.sum(0) / n
        e, u = np.linalg.eigh(centred.T @ centred / n)
        e, u = e[::-1][:8], u[:, ::-1][:, :8]
        want = centred @ u / np.sqrt(e)
        got = np.array([by_id[i] for i in range(n)])
        assert got.shape == want.shape
        got *= np.sign((got * want).sum(0))
        assert np.abs(got - want).max() < 1e-9
        exact = {i: sum((n * int(v) - int(s)) ** 2 for v, s in zip(whole[i], whole.sum(0))) for i in range(n)}
        assert all(int(r.deviation) == exact[r.vec_id] and r.n == n for r in rows)
        by_component = {r.component: r.explained for r in rows}
        assert np.allclose([by_component[k + 1] for k in range(len(e))], e / np.trace(centred.T @ centred / n), rtol=1e-12)
        assert all(r.identity_error < 1e-12 for r in rows)


def test_whitening_edges(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i % 3), float(i % 5), 1.0], "x", "y", "z", "w") for i in range(30)]
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [nan, 0.0, 0.0]), (104, [inf, 0.0, 0.0]), (105, [1.0, 2.0])]
    rows = [*good, *((i, v, "x", "y", "z", "w") for i, v in bad), (None, [5.0, 5.0, 1.0], "", "", "", ""), (3, good[3][1], "", "", "", "")]
    found = whitening.whiten(vectors(spark, rows))
    got = found.collect()
    # The third dimension never varies, so the rank is two.
    assert {r.component for r in got} == {1, 2} and {r.n for r in got} == {32} and len(got) == 64
    assert sum(r.vec_id is None for r in got) == 2 and sum(r.vec_id == 3 for r in got) == 4
    assert not {r.vec_id for r in got} & {i for i, _ in bad}
    for same in ([], rows[:1], [(1, [2.0, 3.0], "", "", "", ""), (2, [2.0, 3.0], "", "", "", "")], [(1, None, "", "", "", "")]):
        empty = whitening.whiten(vectors(spark, same))
        assert empty.count() == 0 and empty.columns == found.columns


def test_repeated_roots_give_a_basis(spark):
    """A cross of equal arms: every direction is an eigenvector of the one, fourfold root."""
    arms = [[s * 3.0 * (i == j) for j in range(4)] for i in range(4) for s in (1, -1)]
    found = whitening.whiten(vectors(spark, [(i, v, "", "", "", "") for i, v in enumerate(arms)]))
    rows, by_id = table_of(found)
    w = np.array([by_id[i] for i in range(8)])
    assert w.shape == (8, 4) and np.abs(w.T @ w / 8 - np.eye(4)).max() < 1e-12
    assert all(abs(r.explained - 0.25) < 1e-15 for r in rows)


def test_polynomial_and_roots_are_exact(spark):
    rng = random.Random(2)
    for n in (1, 2, 3, 5, 9):
        b = [[rng.randint(-50, 50) for _ in range(n)] for _ in range(n)]
        m = [[sum(b[k][i] * b[k][j] for k in range(n)) for j in range(n)] for i in range(n)]
        # Faddeev-LeVerrier in rational integers.
        want, part = [1], [[0] * n for _ in range(n)]
        for k in range(1, n + 1):
            part = [[sum(m[i][x] * part[x][j] for x in range(n)) + want[-1] * m[i][j] for j in range(n)] for i in range(n)]
            want.append(-sum(part[i][i] for i in range(n)) // k)
        assert whitening.characteristic_polynomial(spark, m) == want[::-1]
    # (x - 2)^2 (x - 5)(x - 1/1) x: roots in falling order, the double one twice, zero left out.
    poly = [1]
    for r in (2, 2, 5, 1, 0):
        poly = [a - r * b for a, b in zip([0, *poly], [*poly, 0])]
    found = [t / (1 << p) for t, p in whitening.largest_roots(poly, 8)]
    assert found == [5.0, 2.0, 2.0, 1.0]
    assert [whitening.roots_above(poly, t, 1) for t in (-1, 0, 2, 3, 4, 9, 10)] == [5, 4, 3, 3, 1, 1, 0]


def test_large_entries_stay_exact(spark):
    """Products beyond 53 bits take the way in Python integers."""
    rows = [(i, [float((i * 2654435761) % 1000003) * 1e4, float(i)], "", "", "", "") for i in range(40)]
    got = {r.vec_id: int(r.deviation) for r in whitening.whiten(vectors(spark, rows)).where("component = 1").collect()}
    x = [[int(np.floor(float(np.float32(c)) * 1024)) for c in v] for _, v, *_ in rows]
    sums = [sum(c) for c in zip(*x)]
    assert got == {i: sum((40 * c - s) ** 2 for c, s in zip(v, sums)) for i, v in enumerate(x)}


# --- op13 ------------------------------------------------------------------------------------
def test_classifier_on_held_out_rows(spark):
    """Accuracy on rows that are never learnt from, and that all rows have a score."""
    sf = "/root/testdata/sf0.1"
    found = queries.op13_quality_classifier(spark, sf)
    labels = queries.table(spark, sf, "labels")
    rows = found.join(labels, "doc_id").where("held_out").select("score", "predicted", "quality").collect()
    low = [r for r in rows if r.quality == 0]
    high = [r for r in rows if r.quality == 1]
    assert sum(r.predicted == 0 for r in low) >= 0.95 * len(low) and sum(r.predicted == 1 for r in high) >= 0.98 * len(high)
    everyone = found.collect()
    assert len(everyone) == queries.table(spark, sf, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in everyone)


def graded(n):
    good = "A plain sentence of several different words number {} goes on for a while, and ends."
    poor = "buy### now$$$ {} !!! CLICK%%% HERE&&& |||"
    return [(i, (good if i % 3 else poor).format(i) * (1 + i % 4)) for i in range(n)], [(i, int(i % 3 > 0), 0) for i in range(n)]


def test_classifier_edges(spark, documents):
    docs, marks = graded(240)
    docs += [(900, None), (901, ""), (902, " \n "), (903, "x" * 50_000), (None, docs[1][1]), (5, docs[5][1])]
    marks += [(None, 1, 0), (7, None, 0), (8, 9, 0), (12345, 0, 0), (11, 1, 0)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    found = quality_classifier.score_quality(documents(docs), labels)
    got = found.collect()
    assert found.columns == ["doc_id", "held_out", "score", "predicted"] and len(got) == len(docs)
    by_id = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id < 240}
    assert all(r.predicted == int(i % 3 > 0) for i, r in by_id.items())
    assert all(r.held_out is False and r.predicted == 1 for r in got if r.doc_id is None)
    assert len({r.score for r in got if r.doc_id in (900, 901, 902)}) == 1 and all(r.score is not None for r in got)
    again = quality_classifier.score_quality(documents(docs, parts=7), labels.repartition(5)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.score)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr) and sorted(got, key=key) == sorted(again, key=key)


def test_classifier_without_labels(spark, documents):
    docs, marks = graded(30)
    schema = "doc_id long, quality int"
    none = quality_classifier.score_quality(documents(docs), spark.createDataFrame([], schema)).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.5, 1)}
    one = quality_classifier.score_quality(documents(docs), spark.createDataFrame([(i, 0) for i in range(30)], schema)).collect()
    assert {(r.score, r.predicted) for r in one} == {(0.0, 0)}
    held_out = [(i, int(i % 2)) for i in range(30) if zlib.crc32(str(i).encode()) % 3 == 1]
    unseen = quality_classifier.score_quality(documents(docs), spark.createDataFrame(held_out, schema)).collect()
    assert {r.score for r in unseen} == {0.5}
    few = quality_classifier.score_quality(documents(docs), spark.createDataFrame([m[:2] for m in marks[:5]], schema)).collect()
    assert len(few) == 30 and all(0 <= r.score <= 1 for r in few)
    assert quality_classifier.score_quality(documents([]), spark.createDataFrame([(1, 1), (2, 0)], schema)).count() == 0


def test_kernel_ridge_and_isotonic_steps(spark):
    """Cosines approximate the kernel, the summed equations give numpy's ridge, pooling gives the least squares steps."""
    rng = np.random.default_rng(0)
    k = len(quality_classifier.STATISTICS)
    features = quality_classifier.Features(np.zeros(k), np.ones(k), 4096, 2.0, 1)
    u = rng.standard_normal((6, k)) * 0.5
    z = features(u)[:, :-1] / quality_classifier._Z
    kernel = np.exp(-((u[:, None] - u[None]) ** 2).sum(2) / 8)
    assert np.abs(2 * z @ z.T / 4096 - kernel).max() < 0.06

    s = np.rint(rng.random((300, k)) * quality_classifier._ONE).astype(int)
    y = (s[:, 0] > s[:, 1]).astype(int)
    train = spark.createDataFrame([(a.tolist(), int(b)) for a, b in zip(s, y)], "s array<int>, y int").repartition(4)
    small = quality_classifier.Features(np.full(k, 0.5), np.full(k, 0.3), 32, 4.0, 1)
    got = quality_classifier.fit_ridge(train, small, 32, 1e-3)
    z = small(s / quality_classifier._ONE) / quality_classifier._Z
    want = np.linalg.solve(z.T @ z / 300 + 1e-3 * np.diag([1.0] * 32 + [0.0]), z.T @ y / 300)
    assert np.allclose(got, want, atol=1e-7)

    x, total, ones = np.arange(6.0), np.array([2, 2, 2, 4, 1, 3.0]), np.array([1, 0, 2, 1, 1, 3.0])
    centres, levels = quality_classifier.pool_adjacent(x, total, ones)
    assert np.allclose(levels, [0.25, 0.5, 1.0]) and np.allclose(centres, [0.5, 16 / 6, 19 / 4])
