"""Every registered core query against its SQL, or at least its rows, at the smallest scale."""

import pytest
from compare import oracle_rows, spark_rows

from spanloom.plans import driver, media, results  # noqa: F401 - registers its queries


@pytest.mark.parametrize("name", sorted(driver.QUERIES))
def test_query(spark, sf, name):
    df = driver.QUERIES[name](spark, sf)
    if name in driver.ORACLE_SQL:
        assert spark_rows(df) == oracle_rows(driver.ORACLE_SQL[name], sf)
    else:
        # those have tests of their own, by these names
        assert len(df.columns) > 1 and any(name in f for f in globals() if f.startswith("test_"))


def test_text_normalize_takes_all_items(spark, tmp_path):
    items = [(1, "It's a well-known \u201ctest\u201d (see 12), isn't it?"), (2, "a &lt;b&gt;\u2014c / d"), (3, "Plain, words. 7 of them"), (4, "\u2019quoted\u2019 don\u2019t"), (5, "(no digit) 1,000 x2"), (6, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.item_id: r.norm for r in driver.QUERIES["text_normalize"](spark, str(tmp_path)).collect()}
    assert got == {1: "it's a well-known test isn't it", 2: "a b c d", 3: "plain words of them", 4: "quoted don't", 5: "no digit x2", 6: None}


def test_text_normalize_against_plain_steps(spark, sf):
    import re
    import unicodedata

    def plain(t):
        t = re.sub(r"\([^)]*\d[^)]*\)", " ", unicodedata.normalize("NFKC", t).lower())
        t = re.sub(r"(\S+)[\u201b\u2019\u2018](\S+)", r"\1'\2", re.sub("&lt;|&gt;|&nbsp", "", t))
        t = "".join(" " if unicodedata.category(c)[0] in "PS" and c not in "'-" else c for c in t)
        return " ".join(w for w in t.split() if not re.fullmatch("[0-9]+", w))

    rows = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    got = {r.item_id: r.norm for r in driver.QUERIES["text_normalize"](spark, sf).collect()}
    assert got == {r.item_id: plain(r.text) for r in rows}


def test_vad_hysteresis_limited_against_plain(spark, sf):
    from test_intervals import plain_hysteresis

    from spanloom.operators import intervals
    from spanloom.sources.domain import frames

    h = intervals.Hysteresis(max_speech=2 * intervals.SAMPLE_RATE, min_silence=4800, min_speech=8000)
    prob = {}
    for r in sorted(frames(spark, sf).collect(), key=lambda r: (r.job, r.frame)):
        prob.setdefault(r.job, []).append(r.prob)
    want = set()
    for job, p in prob.items():
        spans = [tuple(x) for x in plain_hysteresis(p, 512 * len(p), h)]
        want |= {(job, k, *s) for k, s in enumerate(intervals.padded(spans, 512 * len(p), h.pad))}
    assert {tuple(r) for r in driver.QUERIES["vad_hysteresis_limited"](spark, sf).collect()} == want


def test_corpus_errors_against_plain_tables(spark, sf):
    """All edits over all words of a conversation, from tables that know nothing of the library."""
    turns, want = {}, {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        turns.setdefault(r.conv_id, []).append((r.turn, r.text))
    for conv, texts in turns.items():
        units = edits = 0
        texts = [t.split() for _, t in sorted(texts)]
        for ref, hyp in zip(texts, texts[1:], strict=False):
            row = list(range(len(hyp) + 1))
            for i, x in enumerate(ref, 1):
                row = [i, *row]
                for j, y in enumerate(hyp, 1):
                    row[j] = min(row[j] + (x != y), row[j - 1] + 1, row[j + 1] + 1)
                row.pop()
            units, edits = units + len(ref), edits + row[-1]
        if len(texts) > 1:
            want[conv] = (units, edits)
    got = {r.conv_id: r for r in driver.QUERIES["corpus_errors"](spark, sf).collect()}
    assert {k: (r.units, r.substitutions + r.deletions + r.insertions) for k, r in got.items()} == want
    assert all(r.rate == (round(want[k][1] / want[k][0], 9) if want[k][0] else None) for k, r in got.items())


def test_character_errors_of_all_scripts(spark, sf, tmp_path):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(before + (x != y), row[j - 1] + 1, row[j] + 1)
        return row[-1]

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()] + [(-1, "مرحبا بالعالم"), (-2, "日本語テキスト"), (-3, ""), (-4, "ÀÉß x")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.item_id: (r.units, r.distance) for r in driver.QUERIES["character_errors"](spark, str(tmp_path)).collect()}
    assert got == {i: (len(t.lower()), distance(t.lower(), t.lower()[::-1])) for i, t in items} and got[-1] == (13, 10)


def test_vad_blocks_keep_to_the_caps(spark, sf):
    rows = driver.QUERIES["vad_blocks"](spark, sf).collect()
    rounds, seen = {}, {}
    for r in rows:
        rounds.setdefault((r.pack, r.round), []).append(r.frames)
        seen[r.conv_id] = seen.get(r.conv_id, 0) + r.frames
    assert all(len(x) <= 8 and sum(x) <= 200 and len(x) * max(x) <= 260 and max(x) <= 40 for x in rounds.values())
    want = spark.read.parquet(f"{sf}/conversations.parquet").selectExpr("conv_id", "ceil(length(text) / 32.0) n").groupBy("conv_id").sum("n").collect()
    assert seen == {r[0]: r[1] for r in want if r[1]}


def test_word_alignment_follows_the_scores(spark, sf):
    from spanloom.operators import align
    from spanloom.sources.domain import segments

    texts = {(r.job, r.segment_index): r for r in segments(spark, sf).collect()}
    got = {}
    for r in driver.QUERIES["word_alignment"](spark, sf).collect():
        got.setdefault((r.job, r.segment_index), []).append(r)
    assert set(got) == {k for k, r in texts.items() if r.text.strip()}
    # the scores spell each text, so the path is found wherever a segment has any letters
    spelt = [w.timing_source for k, words in got.items() if any(align.plain_tokens(texts[k].text)) for w in words]
    assert spelt.count("ctc") > 0.95 * len(spelt)
    for k, words in got.items():
        a, b = texts[k].start_ms / 1000, texts[k].end_ms / 1000
        words.sort(key=lambda r: r.word_index)
        assert [w.word for w in words] == texts[k].text.split()
        assert all(a <= w.word_start <= w.word_end <= b + 1e-9 for w in words) and all(x.word_end <= y.word_start + 1e-9 for x, y in zip(words, words[1:], strict=False))
        at = 0
        for w, token in zip(words, align.plain_tokens(texts[k].text), strict=True):
            # each letter has two frames and a blank, each word one blank more
            inner = min(b, a + (at + 1) * 0.02)
            at += 3 * len(token) + 1
            if w.timing_source == "ctc" and token:
                assert w.word_start <= inner + 0.05 and w.word_end >= min(b, a + (at - 3) * 0.02) - 0.05


def test_scored_errors_against_plain_steps(spark, sf, tmp_path):
    import unicodedata

    from spanloom.operators.stats import edit_counts

    fold = dict(zip("پڤآأإٱؤئىیک", "بفااااويييك", strict=True))

    def plain(t):
        t = "".join(c for c in unicodedata.normalize("NFKC", t).casefold() if unicodedata.category(c)[0] != "M" and c not in "ـء")
        t = "".join(" " if unicodedata.category(c)[0] == "P" else fold.get(c, c) for c in t)
        return "".join(str(unicodedata.digit(c)) if "٠" <= c <= "٩" or "۰" <= c <= "۹" else c for c in t).split()

    rows = [(r.conv_id, r.turn, r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    rows += [(-1, 0, "أَهْلًا، وسهـــلًا! جزء ٢٠٢٤ ۴"), (-1, 1, "اهلا وسهلا جز 2024 4 straße"), (-1, 2, "STRASSE, پاکستان ﬁne مدرسة"), (-1, 3, None), (-1, 4, "x")]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    want, last = {}, {}
    for conv, turn, text in sorted(rows, key=lambda r: r[:2]):
        if last.get(conv) is not None:
            want[conv, turn] = (len(plain(last[conv])), *edit_counts(plain(last[conv]), plain(text or "")))
        last[conv] = text
    got = {(r.conv_id, r.turn): tuple(r)[2:] for r in driver.QUERIES["scored_errors"](spark, str(tmp_path)).collect()}
    assert got == want and got[-1, 1] == (5, 0, 0, 1) and got[-1, 2] == (6, 4, 2, 0)


def test_lock_offset_vector(spark, sf):
    import hashlib

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(50).collect()}
    got = {r.doc_id: r.lock_offset for r in driver.QUERIES["content_sha256"](spark, sf).collect()}
    for i, t in texts.items():
        assert got[i] == int.from_bytes(hashlib.sha256(t.encode()).digest()[:8]) % (2**63 - 2) + 1


def test_wer_pairs_counts_whole_turns(spark):
    """Every pair of turns against a plain edit-distance table over all words; some turns are far longer than 400 characters."""
    from spanloom.operators.stats import edit_counts

    sf = "/root/testdata/sf0.01"
    turns = {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()}
    want, last = {}, {}
    for (conv, turn), text in sorted(turns.items()):
        if last.get(conv) is not None:
            ref = last[conv].split()
            want[conv, turn] = (len(ref), *edit_counts(ref, text.split()))
        last[conv] = text
    assert max(map(len, turns.values())) > 800
    assert {(r.conv_id, r.turn): tuple(r)[2:] for r in driver.QUERIES["wer_pairs"](spark, sf).collect()} == want


def test_edit_counts_of_many():
    import numpy as np

    from spanloom.operators.stats import edit_counts, edit_counts_of

    rng = np.random.default_rng(6)
    pairs = [tuple([f"w{x}" for x in rng.integers(0, 5, rng.integers(0, 14))] for _ in range(2)) for _ in range(300)]
    for cells in (1, 500, 1 << 22):
        assert [tuple(x) for x in edit_counts_of(pairs, cells).tolist()] == [edit_counts(*p) for p in pairs]
    assert edit_counts_of([]).shape == (0, 3)


def test_words_of_few_pairs_are_held(monkeypatch):
    """Long batches are counted some pairs at a time, with the counts of all at once; nulls are empty."""
    import numpy as np
    import pandas as pd

    from spanloom.operators import stats

    rng = np.random.default_rng(8)
    texts = [None if n == 0 else " ".join(f"w{x}" for x in rng.integers(0, 5, n)) for n in rng.integers(0, 60, 301)]
    most, whole = [], stats.edit_counts_of
    monkeypatch.setattr(stats, "HELD_CHARS", 2000)
    monkeypatch.setattr(stats, "edit_counts_of", lambda pairs: most.append(sum(len(" ".join(x)) for p in pairs for x in p)) or whole(pairs))
    got = stats.counted(pd.Series(texts[:-1]), pd.Series(texts[1:]))
    want = [((r or "").split(), (h or "").split()) for r, h in zip(texts, texts[1:], strict=False)]
    assert got.to_numpy().tolist() == [[len(r), *stats.edit_counts(r, h)] for r, h in want] and max(most) <= 2000


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_imports_without_llm(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "spanloom", tmp_path / "spanloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'cues' in e.queries() and not any(k.startswith('op') and k[2].isdigit() for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120, env={"PATH": "/usr/bin:/bin"})


def test_one_exchange_on_the_key(spark, sf):
    plan = driver.QUERIES["span_merge"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,value:double>" in plan
