"""Tokenizer alignment against the two libraries, byte by byte."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from spanloom.llm import crosstok, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tokens():
    """Text -> (ids, bytes) of either tokenizer over the whole text."""
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    p = sentencepiece.SentencePieceProcessor(model_file=B)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}

    def of(text):
        ids = t.encode(" " + text, add_special_tokens=False).ids
        a = [(i, bytes(byte[c] for c in t.id_to_token(i))) for i in ids]
        b = [(i, bytes([int(p.id_to_piece(i)[3:5], 16)]) if p.is_byte(i) else p.id_to_piece(i).replace("▁", " ").encode()) for i in p.encode(text)]
        return a, b

    return of


def plain(rows, of):
    """(id, text) -> the query's rows: every pair of tokens is compared by the bytes that each holds."""
    made, count = [], Counter()
    for i, text in rows:
        a, b = of(text) if text else ([], [])
        whole = (" " + text).encode() if text else b""
        if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            a, b = [], []
        owner_a = [k for k, (_, x) in enumerate(a) for _ in x]
        owner_b = [k for k, (_, x) in enumerate(b) for _ in x]
        links = sorted(set(zip(owner_a, owner_b, strict=True)))
        ends = set(k + 1 for k in range(len(owner_a)) if owner_a[k : k + 1] != owner_a[k + 1 : k + 2] and owner_b[k : k + 1] != owner_b[k + 1 : k + 2])
        groups, start = [], 0
        for end in sorted(ends):
            groups.append(",".join(str(a[k][0]) for k in dict.fromkeys(owner_a[start:end])) + "|" + ",".join(str(b[k][0]) for k in dict.fromkeys(owner_b[start:end])))
            start = end
        ids = [(a[x][0], b[y][0]) for x, y in links]
        count.update(set(ids))
        made.append((i, len(a), len(b), len(groups), ids, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    return sorted(((i, n_a, n_b, n, len(ids), sum(count[p] == best[p[0]] for p in ids), sum(count[p] for p in ids), h) for i, n_a, n_b, n, ids, h in made), key=repr)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def test_whole_table(spark, sf, docs, tokens):
    assert rows_of(queries.op13_crosstok(spark, sf)) == plain(docs, tokens)


def test_odd_rows_and_both_joins(spark, odd, tokens):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    want = plain(rows, tokens)
    assert rows_of(crosstok.cross_align(odd, A, B)) == want == rows_of(crosstok.cross_align(odd, A, B, send=0))


def test_empty_table(spark):
    assert crosstok.cross_align(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []


def test_random_texts(spark, tokens):
    """Blanks of all kinds, special strings, the pieces' own blank, broken words and scripts without blanks."""
    rng = random.Random(13)
    parts = [" ", "  ", "\t", "\n", " \n", " ", " ", "　", "\x1c", "\x85", "a", "The", "ing", "'s", "don't", "42", "...", "é", "ß", "日本語", "ไทย", "😀", "<|endoftext|>", "<s>", "<0x41>", "▁", "</s>", "\x00", "é", "word", "anti", "-"]
    rows = [(k, "".join(rng.choices(parts[: 31 if k % 8 == 0 else 25] if k % 8 else parts, k=rng.randint(1, 40)))) for k in range(600)]
    rows += [(700, " lead"), (701, "trail "), (702, "  "), (703, " "), (704, "日本語" * 3000), (705, "x" * 5000), (706, "a  b " * 2000)]
    assert rows_of(crosstok.cross_align(spark.createDataFrame(rows, "doc_id long, text string"), A, B)) == plain(rows, tokens)


def test_components_are_those_of_a_plain_search():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n, m = int(rng.integers(1, 40)), int(rng.integers(0, 60))
        u, v = rng.integers(0, n, m), rng.integers(0, n, m)
        near = {x: {x} for x in range(n)}
        for a, b in zip(u.tolist(), v.tolist(), strict=True):
            joined = near[a] | near[b]
            for x in joined:
                near[x] = joined
        assert crosstok.united(n, u, v).tolist() == [min(near[x]) for x in range(n)]


def test_small_caches_and_stretches(tokens, monkeypatch):
    """A cache that starts again, texts cut into many stretches, and stretches of many texts give equal results."""
    from spanloom.llm.packing import read_ranks

    texts = [" ".join(f"word{k % 50} und  {k}" for k in range(400)), "ein " * 300, None, "", "x" * 900, "kurz", "▁ nein " * 20, " ".join(f"w{k}" for k in range(700)) + " "]
    whole = crosstok.rows_of(texts, crosstok.Aligner(read_ranks(A), open(B, "rb").read()))
    monkeypatch.setattr(crosstok, "CACHE", 7)
    monkeypatch.setattr(crosstok, "STRETCH", 50)
    parts = crosstok.rows_of(texts, crosstok.Aligner(read_ranks(A), open(B, "rb").read()))
    plain_rows = {i: (a, b, g, n, h) for i, a, b, g, n, _, _, h in plain(list(enumerate(texts)), tokens)}
    for k, (x, y) in enumerate(zip(whole, parts, strict=True)):
        assert (*x[:4], x.groups.decode()) == plain_rows[k] == (*y[:4], y.groups.decode())
        assert (x.pairs == y.pairs).all() and (x.times == y.times).all()
    assert list(crosstok.stretches("ab cd  ef gh", 2)) == ["ab", "cd  ef", "gh"]
