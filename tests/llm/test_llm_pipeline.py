"""Each pipeline stage on its own input, and the whole run."""

from itertools import accumulate

import public_tokenizers
import pytest
from test_llm_methods import cut_lines
from tokenizers import Tokenizer

from spanloom.llm import decontaminate


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    import corpus_pipeline as p

    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, f in p.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "t")
        f(spark, docs, sf).write.parquet(path)
        out[name] = (docs, spark.read.parquet(path))
        docs = out[name][1]
    return out


def test_columns(stages):
    for name, (before, after) in stages.items():
        if name != "packing":
            assert before.columns == after.columns


def test_toxicity(stages):
    before, after = stages["toxicity"]
    gone = before.join(after, "doc_id", "left_anti")
    marked = "lower(text) RLIKE '\\\\b(idiot|moron|scum|pathetic|worthless|trash|loser|clown|stupid|disgusting)\\\\b'"
    assert after.filter(marked).count() <= 0.3 * before.filter(marked).count() and gone.count() <= 0.2 * before.count()


def test_lines_against_brute_force(stages):
    before, after = stages["line_dedup"]
    rows = sorted((r.doc_id, r.text, r.n_chars) for r in before.collect())
    want = {i: (text, len(text) if deleted else n) for (i, _, n), (text, deleted) in zip(rows, cut_lines([x for _, x, _ in rows], 20), strict=True)}
    assert {r.doc_id: (r.text, r.n_chars) for r in after.collect()} == want


def test_near_duplicates_against_brute_force(stages):
    """Sets of five-word shingles of all pairs; the least id of each linked group stays."""
    before, after = stages["near_dedup"]
    sets = {}
    for r in before.collect():
        w = r.text.encode().lower().split()
        sets[r.doc_id] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, x in enumerate(ids):
        for y in ids[:k]:
            a, b = sets[x], sets[y]
            if (not a and not b) or (a and b and len(a & b) >= 0.8 * len(a | b)):
                p, q = find(x), find(y)
                root[max(p, q)] = min(p, q)
    assert sorted(r.doc_id for r in after.collect()) == [i for i in ids if find(i) == i]


def test_decontamination_against_brute_force(stages, spark, sf):
    """Every text aligned with every item whose words it holds enough of."""
    before, after = stages["decontamination"]
    items = [decontaminate.Seeds([(r.item_id, r.text)], 3) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = before.collect()
    held = set()
    for seeds in items:
        words = seeds.items[0][1]
        for r in rows:
            ids = seeds.hits([r.text.encode()])[0]
            if r.doc_id not in held and seeds.reachable(0, ids) >= 0.5 and decontaminate.align(ids, words) >= len(words):
                held.add(r.doc_id)
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in rows} - held and held


def test_packing_holds_every_token(stages):
    before, after = stages["packing"]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sizes = {r.doc_id: len(t.encode(r.text, add_special_tokens=False).ids) + 1 for r in before.collect()}
    pieces, places = {}, {}
    for r in after.collect():
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, parts in pieces.items():
        parts.sort()
        assert [a for a, _ in parts] == [0, *accumulate(n for _, n in parts)][:-1] and sum(n for _, n in parts) == sizes[i]
        assert all(n == 1024 for _, n in parts[1:])
    assert set(pieces) == set(sizes)
    for parts in places.values():
        parts.sort()
        assert [a for a, _ in parts] == [0, *accumulate(n for _, n in parts)][:-1] and sum(n for _, n in parts) <= 1024
    assert len(places) <= 1.01 * sum(sizes.values()) / 1024 + 1


def test_stages_on_odd_rows(spark, sf, odd):
    """Nulls, empty and long texts, repeated rows and ids, and columns that operators make themselves."""
    import corpus_pipeline as p

    names = ["Toxic", "Deleted", "LEAKS", "gone", "Component_id", "key"]
    docs = odd.selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "length(text) AS n_chars", *(f"'{n} kept' AS {n}" for n in names))
    rows = docs.count()
    for name, stage in p.STAGES:
        got = stage(spark, docs, sf)
        kept = got.collect()
        if name == "packing":
            assert sum(r.piece == 0 for r in kept) == rows
            continue
        assert got.columns == docs.columns and all(r[n] == f"{n} kept" for r in kept for n in names)
        assert len(kept) == {"near_dedup": 8}.get(name, rows)
        assert stage(spark, docs.filter("lang = 'none'"), sf).collect() == []


def test_run(spark, sf, stages):
    import corpus_pipeline as p

    assert p.run(spark, sf).count() == stages["packing"][1].count()
