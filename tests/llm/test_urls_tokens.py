"""op1 and op2: edge cases, and brute force on random input."""

import random

import pyarrow as pa
from tokenizers import Tokenizer

from maieutic.llm import token_count, url_rules


def judged(spark, urls, rules, **kw):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'x' AS host", "'y' AS rule", "'z' AS key")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge_urls(pages, table, **kw).collect()}
    return [got[i] for i in range(len(urls))]


def plain(url, rules, default="allow"):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:cut], rest[cut:]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [
        (len(h + p), len(h), h + p, v) for h, p, v in rules
        if v and (host == h or (h and host.endswith("." + h))) and path.startswith(p)
    ]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else default


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def test_url_edges(spark):
    urls = [
        "http://a.example.net/en/1", "http://example.NET/de", "https://net/x", "http://net", "net/en/", None, "", "://", "http://x.net?/en/",
        "http://x.net/?a", "ftp://q.org/fr/a#b/c", "http://org.com/fr/", "http://anet/", "http://A.B.example.com/de/?x://y", "http:///net/", "a://b://c.net/",
        "http://é.net/", "http://.net/", "http://net./",
    ]
    assert judged(spark, urls, RULES) == [plain(u, RULES) for u in urls]


def test_url_random_nested_rules_over_partition_borders(spark):
    rng = random.Random(5)
    labels = ["a", "b", "c", "net"]
    rules = [(".".join(rng.choices(labels, k=rng.randint(0, 3))), "/" * rng.randint(0, 1) + rng.choice(["", "x", "x/y"]), rng.choice(["allow", "block"])) for _ in range(40)]
    rules = list({(h, p): (h, p, v) for h, p, v in rules}.values())
    urls = [f"http://{'.'.join(rng.choices(labels, k=rng.randint(1, 5)))}/{rng.choice(['', 'x', 'x/y', 'z'])}" for _ in range(600)]
    assert judged(spark, urls, rules) == [plain(u, rules) for u in urls]


def test_url_empty_tables(spark):
    assert judged(spark, [], RULES) == []
    assert judged(spark, ["http://a.net/"], []) == [("a.net", "/", None, "allow")]


TEXTS = [
    "", " ", "plain words here", "don't I'LL ''s a'sb", "x <|endoftext|> y <|startoftext|>", "½² µ ǅ ß İx", "Ωσς ΟΣ 日本語", "é e\u0301",
    "\x1c\x85\xa0 a\x00b\x1f!", "line\nfeed\ttab", "a" * 5000, "word " * 3000, "𝔘𝔫𝔦 😀😀", "1234567 12,5%", "\ufeffbom",
]


def test_token_counts_equal_the_library(documents, vocabulary):
    rng = random.Random(3)
    alphabet = "abcdeÀéßñ'’.,!?0123 \n\tİΣ日\u0301<|>"
    texts = TEXTS + ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(300)]
    library = Tokenizer.from_file(vocabulary)
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    rows = list(enumerate(texts)) + [(-1, None), (None, "two words")]
    got = token_count.count_tokens(documents(rows), vocabulary, limit=100).collect()
    by_id = {r.doc_id: r for r in got}
    assert [by_id[i].n_tokens for i in range(len(texts))] == want
    assert [by_id[i].n_bytes for i in range(len(texts))] == [len(t.encode()) for t in texts]
    assert [by_id[i].over_limit for i in range(len(texts))] == [n > 100 for n in want]
    assert (by_id[-1].n_bytes, by_id[-1].n_tokens, by_id[-1].over_limit) == (0, 0, False)
    assert by_id[None].n_tokens == 2


def test_every_code_point_of_the_fast_path_equals_the_library(vocabulary):
    library = Tokenizer.from_file(vocabulary)
    whole = token_count.prove_whole_tokens(vocabulary)
    pieces, counter = token_count.PieceTokenizer(vocabulary, whole, 4), token_count.PieceTokenizer(vocabulary, whole, 2)
    for c in map(chr, range(0x260)):
        for text in (c, f"{c}liyev", f"some wo{c}rd here", f"END{c} {c}{c.lower()}x"):
            want = library.encode(text, add_special_tokens=False).ids
            got = pieces.encode_packed(text)
            assert got == b"".join(i.to_bytes(4, "little") for i in want), (hex(ord(c)), text)
            assert counter.count(text) == len(want)


def test_memo_is_bounded_and_forgotten(vocabulary, monkeypatch):
    """Whatever the memo holds, ids stay the library's; it stays near its bounds and goes with the task."""
    monkeypatch.setattr(token_count, "WORD_CACHE", 50)
    monkeypatch.setattr(token_count, "WORD_CACHE_CHARS", 300)
    library = Tokenizer.from_file(vocabulary)
    pieces = token_count.PieceTokenizer(vocabulary, token_count.prove_whole_tokens(vocabulary), 2)
    text = " ".join(f"word{i} and {i % 9}" for i in range(2000))
    want = library.encode(text, add_special_tokens=False).ids
    assert pieces.encode_packed(text) == b"".join(i.to_bytes(2, "little") for i in want) and pieces.count(text) == len(want)
    assert len(pieces.memo) <= 2 * 50
    pieces.forget()
    assert not pieces.memo and pieces.count(text) == len(want)


def test_words_of_many_texts_are_encoded_once(vocabulary, monkeypatch):
    """A slice of texts needs one encoding per distinct word, however many words the memo holds; slices are cut in order."""
    library = Tokenizer.from_file(vocabulary)
    monkeypatch.setattr(token_count, "WORD_CACHE", 10)
    monkeypatch.setattr(token_count, "SLICE_BYTES", 3000)
    rng = random.Random(8)
    vocabulary_words = [f"wórd{i}," for i in range(40)]
    texts = TEXTS + [None] + [" ".join(rng.choices(vocabulary_words, k=30)) for _ in range(60)]
    pieces = token_count.PieceTokenizer(vocabulary, token_count.prove_whole_tokens(vocabulary), 2)
    encoded, encode = [], pieces.encode_word
    monkeypatch.setattr(pieces, "encode_word", lambda word: encoded.append(word) or encode(word))
    slices = list(token_count.text_slices(pa.array(texts)))
    assert [t for part in slices for t in part] == texts and len(slices) > 3
    for part in slices:
        encoded.clear()
        want = [library.encode(t or "", add_special_tokens=False).ids for t in part]
        assert pieces.encode_many(part) == [b"".join(i.to_bytes(2, "little") for i in ids) for ids in want]
        assert len(encoded) == len(set(encoded)) and len(pieces.memo) <= 10
    assert list(token_count.text_slices(pa.array([], pa.string()))) == [[]] and pieces.encode_many([]) == []


def test_token_counts_repeats_and_empty(documents, vocabulary):
    got = token_count.count_tokens(documents([(1, "a b"), (1, "a b"), (1, "c")]), vocabulary).collect()
    assert sorted(r.n_tokens for r in got) == [1, 2, 2]
    assert token_count.count_tokens(documents([]), vocabulary).count() == 0


def test_whole_tokens_are_proved(vocabulary):
    whole = token_count.prove_whole_tokens(vocabulary)
    library = Tokenizer.from_file(vocabulary)
    some = random.Random(1).sample(sorted(whole), 500)
    assert all(library.encode(s, add_special_tokens=False).ids == [whole[s]] for s in some)
