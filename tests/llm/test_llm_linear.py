"""Licences and secrets in long and repetitive texts: right, and in time that grows with the text."""

import random
import re
import time

import pytest

from spanloom.llm import licenses, secrets


def plain_runs(text, pairs, least):
    """(dice, at) of the best run of a text's bigrams, over every start and end; the last start among the best."""
    words = [w for w in re.sub(r"[\W_]+", " ", (text or "").lower()).split()]
    grams = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
    want, best = set(pairs), (0.0, 0)
    for s in range(len(grams)):
        seen = set()
        for g in grams[s:]:
            seen.add(g)
            dice = 2 * len(seen & want) / (len(seen) + len(want))
            if dice > best[0] + 1e-12:
                best = (dice, s)
    return best if best[0] >= least else None


def test_runs_against_all_runs(spark):
    """Random texts of a licence's words with others between, before and after, repeated and cut."""
    rng = random.Random(5)
    templates = {"one": "grant use copy keep this note in all parts of it free", "two": "no warranty of any kind is given with this work at all"}
    known = [w for t in templates.values() for w in t.split()]
    texts = []
    for _ in range(150):
        words = [rng.choice([*known, "x", "y", f"n{rng.randrange(99)}"]) for _ in range(rng.randint(0, 12))]
        for _ in range(rng.randint(1, 3)):
            body = rng.choice(list(templates.values())).split()
            body = [w for w in body if rng.random() > 0.06]
            for _ in range(rng.randint(0, 2)):
                body.insert(rng.randrange(len(body) + 1), rng.choice(["z", "this", "note"]))
            words += body + [rng.choice([*known, "x"]) for _ in range(rng.randint(0, 6))]
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = licenses.scan(df, templates=templates).collect()
    got = {(r.doc_id, r.license): r.dice for r in rows if r.kind == "run"}
    told = {(r.doc_id, r.license) for r in rows if r.kind != "run"}
    want = {(i, n): round(f[0], 6) for i, t in enumerate(texts) for n, body in templates.items() if (i, n) not in told and (f := plain_runs(t, licenses.template_bigrams(body), 0.8))}
    assert len(want) > 60 and got == want
    # the run that is named reaches what is told
    for r in rows:
        if r.kind == "run":
            assert plain_runs(" ".join(texts[r.doc_id].split()[r.at :]), licenses.template_bigrams(templates[r.license]), 0.8)[0] == pytest.approx(r.dice, abs=1e-6)


def scan_seconds(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.perf_counter()
    rows = licenses.scan(df).collect()
    return time.perf_counter() - began, rows


def test_long_texts_full_of_licence_words(spark):
    """50,000 words: a footer again and again, and single licence words all over. Twice the text takes no four times as long."""
    rng = random.Random(1)
    some = licenses.TEMPLATES["MIT-text"].split()
    footer = " ".join(f"prose{rng.randrange(10**6)} {rng.choice(some)} {rng.choice(some)}" if k % 9 else licenses.TEMPLATES["MIT-text"] for k in range(2000))
    scan_seconds(spark, footer[:2000])
    half, _ = scan_seconds(spark, footer)
    whole, rows = scan_seconds(spark, f"{footer} {footer.upper()}")
    assert len(f"{footer} {footer}".split()) > 50_000 and whole < 3 * half + 5 and whole < 90
    assert any(r.license == "MIT-text" and r.kind == "run" and r.dice == 1.0 for r in rows)


def test_web_tokens_are_found_once_a_run():
    rule = secrets.RULES[-1].pattern
    began = time.perf_counter()
    assert re.search(rule, "eyJ" * 333_334) is None
    assert time.perf_counter() - began < 5
    a = "eyJ" + "a" * 12
    text = f"{a}.{a}.{a} x{a}.{a}.{a} .{a}.{a}.{a}.{a} {a}.{a}"
    assert [m.span() for m in re.finditer(rule, text)] == [(0, 47), (98, 145)]


def test_long_runs_of_secret_letters(spark):
    """A million characters: the whole scan, in Spark."""
    text = "eyJ" * 333_334 + " token = abcdefghijkl " + "-" * 100_000 + " eyJ" + "z" * 300_000 + "." + "y" * 20
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.perf_counter()
    (row,) = secrets.scan(df)[0].collect()
    assert [(s.kind, s.start) for s in row.spans] == [("assign", 1_000_003)] and time.perf_counter() - began < 60


def test_resumed_scan_has_equal_rows(spark, sf):
    from spanloom.llm import queries

    rows = lambda q: sorted(tuple(r) for r in q(spark, sf).collect())
    assert rows(queries.op8_secrets) == rows(queries.op8_secrets_resumed)
