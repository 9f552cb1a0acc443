"""Files in and out by executors, windows of scores, and romanised words."""

import hashlib
import json
import struct
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from spanloom.operators import align, romanize
from spanloom.sources import pcm, publish


def held(root):
    return {str(p.relative_to(root)): p.read_bytes() for p in Path(root).rglob("*") if p.is_file() and publish.MANIFEST not in p.parts}


def files_of(spark, rows):
    return spark.createDataFrame(rows, "job string, name string, content string, key string")


def test_published_files_and_manifest(spark, tmp_path):
    root = str(tmp_path / "out")
    got = publish.publish(files_of(spark, [("a", "a.txt", "one", "k"), ("a", "sub/a.srt", "1\n", "k"), ("b", "b.txt", None, "k"), ("c", None, None, "k")]), root, ("key",)).collect()
    assert held(root) == {"a.txt": b"one", "sub/a.srt": b"1\n", "b.txt": b""}
    told = {r.job: ({f.name: (f.size, f.sha256) for f in r.files}, r.fields, r.fault) for r in got}
    assert told["a"] == ({n: (len(c), hashlib.sha256(c).hexdigest()) for n, c in (("a.txt", b"one"), ("sub/a.srt", b"1\n"))}, {"key": "k"}, None)
    assert told["c"] == ({}, {"key": "k"}, None) and set(told) == {"a", "b", "c"}
    # a second run replaces what it names, and its manifest rows come first
    publish.publish(files_of(spark, [("a", "a.txt", "two", "k2")]), root, ("key",))
    assert held(root) == {"a.txt": b"two", "sub/a.srt": b"1\n", "b.txt": b""}
    assert {r.job: (r.fields["key"], len(r.files)) for r in publish.manifest(spark, root).collect()} == {"a": ("k2", 1), "b": ("k", 1), "c": ("k", 0)}
    assert publish.manifest(spark, root, latest=False).count() == 4 and publish.manifest(spark, str(tmp_path / "none")).count() == 0


def test_a_failed_task_publishes_nothing(spark, tmp_path):
    root = str(tmp_path / "out")
    publish.publish(files_of(spark, [("a", "a.txt", "old", "k")]), root)
    many = [(f"j{k}", f"j{k}.txt", "new", "k") for k in range(20)] + [("a", "a.txt", "new", "k")]
    for bad in ("../x", "/x", publish.MANIFEST + "/x", ".hidden"):
        with pytest.raises(Exception, match="no name below"):
            publish.publish(files_of(spark, [*many, ("z", bad, "new", "k")]), root)
    assert held(root) == {"a.txt": b"old"} and publish.manifest(spark, root).count() == 1


def test_a_failed_commit_brings_back_what_was_there(spark, tmp_path):
    """A target that is a folder can't be replaced: files moved before it come back, new ones go."""
    root = tmp_path / "out"
    publish.publish(files_of(spark, [("a", "a.txt", "old", "k"), ("m", "m.txt", "old", "k")]), str(root))
    (root / "k.txt" / "in").mkdir(parents=True)
    (root / "k.txt" / "in" / "x").write_text("x")
    before = held(root)
    with pytest.raises(Exception):  # noqa: B017 - whatever the file system says
        publish.publish(files_of(spark, [(n, f"{n}.txt", "new", "k") for n in "abcdekmz"]), str(root))
    assert held(root) == before and publish.manifest(spark, str(root)).count() == 2
    assert not [p for p in root.iterdir() if p.name.startswith(".publish")]


def test_two_jobs_of_one_name(spark, tmp_path):
    with pytest.raises(Exception, match="files of one name"):
        publish.publish(files_of(spark, [("a", "x.txt", "1", "k"), ("b", "x.txt", "2", "k")]), str(tmp_path / "out"))
    assert held(tmp_path / "out") == {}


def test_a_changed_source_publishes_nothing_of_its_job(spark, tmp_path):
    root, sources = str(tmp_path / "out"), [tmp_path / f"{k}.wav" for k in range(3)]
    for s in sources:
        s.write_bytes(b"sound")
    rows = [(str(k), f"{k}.txt", "text", str(s), publish.snapshot(str(s))) for k, s in enumerate(sources)]
    sources[1].write_bytes(b"other sound")
    sources[2].unlink()
    got = publish.publish(spark.createDataFrame(rows, "job string, name string, content string, source string, snapshot string"), root)
    assert {r.job: (r.fault, len(r.files)) for r in got.collect()} == {"0": (None, 1), "1": (publish.CHANGED, 0), "2": (publish.CHANGED, 0)}
    assert held(root) == {"0.txt": b"text"} and [r.job for r in publish.manifest(spark, root).collect()] == ["0"]


def test_only_the_attempt_that_won_counts(tmp_path):
    """Two attempts of a task, one of which is lost after it wrote: files and manifest are those of the other."""
    root = str(tmp_path / "out")
    w = publish.PublishWriter(root, "run")
    row = lambda job, text: Row(job=job, name=f"{job}.txt", content=text, source=None, snapshot=None, fields={})
    w.write(iter([row("a", b"lost"), row("b", b"lost")]))

    def broken():
        yield row("a", b"half")
        raise OSError("executor lost")

    with pytest.raises(OSError):
        w.write(broken())
    w.commit([w.write(iter([row("a", b"won"), row("b", b"won")])), None, w.write(iter([]))])
    assert held(root) == {"a.txt": b"won", "b.txt": b"won"}
    (part,) = (Path(root) / publish.MANIFEST).iterdir()
    assert [json.loads(x)["job"] for x in part.read_text().splitlines()] == ["a", "b"]


def test_a_run_is_published(spark, tmp_path):
    from spanloom.options import Options
    from spanloom.plans.transcribe import transcribe

    sound = (8000 * np.sin(np.arange(32000) / 5)).astype("<i2").tobytes()
    recordings = spark.createDataFrame([(0, "in/a.wav", sound), (1, "in/b.wav", b"\x00"), (2, "c.wav", sound[:16000])], "job_index long, path string, pcm binary")
    root = str(tmp_path / "out")
    options = Options(vad="none", max_dur=2.0, formats=("txt", "srt", "json"))
    run = transcribe(recordings, options)
    told = {r.job: sorted(f.name for f in r.files) for r in run.publish(root).collect()}
    assert told == {"in/a.wav": ["in/a.json", "in/a.srt", "in/a.txt"], "c.wav": ["c.json", "c.srt", "c.txt"]}
    docs = {r.path: r for r in run.documents().collect()}
    assert held(root)["in/a.srt"].decode() == docs["in/a.wav"].srt and json.loads(held(root)["c.json"])["path"] == "c.wav"
    # the manifest is what a later run skips by
    again = transcribe(recordings, options, manifest=run.published(root))
    assert {r.path: r.status for r in again.results.collect()} == {"in/a.wav": "skipped", "in/b.wav": "failed", "c.wav": "skipped"}


@pytest.fixture(scope="module")
def wavs(tmp_path_factory):
    folder = tmp_path_factory.mktemp("wavs")
    rng = np.random.default_rng(2)
    sound = {f"{k}.wav": rng.integers(0, 256, n * f, np.uint8).tobytes() for k, (n, f) in enumerate(((10_000, 2), (3, 2), (0, 2), (5_000, 6), (777, 1)))}
    shapes = {"0.wav": (1, 16), "1.wav": (1, 16), "2.wav": (1, 16), "3.wav": (2, 24), "4.wav": (1, 8)}
    for name, data in sound.items():
        (folder / name).write_bytes(pcm.container(data, 8000, *shapes[name]))
    whole = pcm.container(sound["0.wav"], 8000)
    (folder / "sub").mkdir()
    # other chunks before the samples, an odd one among them; a stream of unknown length; not PCM; not a container; a broken one
    (folder / "sub" / "list.WAV").write_bytes(whole[:36] + b"LIST" + struct.pack("<I", 5) + b"abcde\0" + whole[36:])
    (folder / "sub" / "stream.wav").write_bytes(whole[:40] + b"\xff\xff\xff\xff" + whole[44:])
    (folder / "x_float.wav").write_bytes(whole[:20] + struct.pack("<H", 3) + whole[22:])
    (folder / "x_text.wav").write_bytes(b"no sound here at all")
    (folder / "x_cut.wav").write_bytes(whole[:30])
    (folder / "x_empty.wav").write_bytes(b"")
    (folder / "other.txt").write_bytes(whole)
    return folder, sound | {"list.WAV": sound["0.wav"], "stream.wav": sound["0.wav"]}, shapes | {"list.WAV": (1, 16), "stream.wav": (1, 16)}


@pytest.mark.parametrize(("start", "limit", "size"), [(0, None, 1 << 20), (0, None, 3001), (0.01, 0.5, 2500), (0.5, 0.0, 999), (99, None, 5000)])
def test_ranges_join_up_to_the_samples(spark, wavs, start, limit, size):
    folder, sound, shapes = wavs
    rows = [r.asDict() for r in pcm.read_pcm(spark, str(folder), start, limit, size).collect()]
    assert {Path(r["path"]).name for r in rows if r["error"]} == {"x_float.wav", "x_text.wav", "x_cut.wav", "x_empty.wav"}
    for name, data in sound.items():
        own = sorted((r for r in rows if Path(r["path"]).name == name), key=lambda r: r["first"])
        frame = shapes[name][0] * shapes[name][1] // 8
        want = data[round(start * 8000) * frame :]
        want = want if limit is None else want[: (round(limit * 8000) + 1) * frame]
        assert b"".join(bytes(r["pcm"]) for r in own) == want and {r["samples"] for r in own} == {len(want) // frame}
        at = 0
        for r in own:
            assert r["first"] == at and (r["rate"], r["channels"], r["bits"]) == (8000, *shapes[name])
            at += len(r["pcm"]) // frame
    with pytest.raises(Exception, match="negative"):
        pcm.read_pcm(spark, str(folder), -1).count()


@pytest.mark.parametrize("samples", [1, 319, 320, 3199, 3200, 3201, 16_000, 17_123])
def test_scores_in_windows_are_those_of_one_run(spark, samples):
    """A model that looks two frames to either side, over windows of ten frames with two of context."""
    ratio, window, context = 320, 10, 2
    weight = np.random.default_rng(1).standard_normal((5, 7))

    def model(x):
        frames = np.pad(x.reshape(len(x), -1, ratio).mean(2) / 1000, ((0, 0), (2, 2)))
        near = np.stack([frames[:, k : frames.shape[1] - 4 + k] for k in range(5)], axis=2)
        return near @ weight

    sound = (np.random.default_rng(samples).standard_normal(samples) * 3000).astype("<i2")
    df = spark.createDataFrame([(1, sound.tobytes()), (2, b""), (3, None), (4, sound[: samples // 2].tobytes())], "job_index long, pcm binary")
    got = {}
    for r in align.window_scores(df, model, window, context, ratio, batch=3).collect():
        got.setdefault(r.job_index, {})[r.frame] = r.scores
    for job, own in ((1, sound), (4, sound[: samples // 2])):
        if not len(own):
            continue
        total = -(-len(own) // (window * ratio)) * window
        whole = np.zeros(total * ratio)
        whole[: len(own)] = own
        want = model(whole[None])[0][: total - (len(whole) - len(own)) // ratio]
        want = want - np.log(np.exp(want).sum(1, keepdims=True))
        made = np.array([got[job][k] for k in range(len(got[job]))])
        assert made.shape == (len(want), 8) and np.allclose(made[:, :-1], want) and (made[:, -1] == 0).all()
    assert not {2, 3} & set(got)


def test_windows_without_enough_frames_fail(spark):
    df = spark.createDataFrame([(1, b"\0" * 4000)], "job_index long, pcm binary")
    with pytest.raises(Exception, match="too few frames"):
        align.window_scores(df, lambda x: np.zeros((len(x), 3, 2)), 10, 2, 320).collect()


def test_romanised_letters():
    """The documented vector, letters of several scripts, sequences with rules of their own, and what has no rule."""
    tokens = romanize.roman_tokens("مرحبا بكم في العالم")
    assert tokens[-1] == "al'alm" and " ".join(tokens[-1]) == "a l ' a l m" and all(tokens)
    assert romanize.roman_tokens("Привет мир щука") == ["privet", "mir", "shchuka"]
    assert romanize.roman_tokens("Ελλάδα ουρανός") == ["ellada", "ouranos"]
    assert romanize.roman_tokens("きゃっと カッパ") == ["kyatto", "kappa"]
    assert romanize.roman_tokens("서울 straße Œuvre Ñandú ø don't 日本 — 42") == ["seoul", "strasse", "oeuvre", "nandu", "o", "don't", "", "", ""]
    # the longest rule wins, a shorter one where it doesn't go on
    r = romanize.Romanizer({"ab": "1", "abcd": "2", "c": "3"})
    assert [r(w) for w in ("abcd", "abc", "abx", "cab")] == ["2", "13", "1x", "31"]


def test_arabic_segment_is_aligned():
    text, letters = "مرحبا بكم في العالم", "abcdefghijklmnopqrstuvwxyz'"
    ids = {c: k + 1 for k, c in enumerate(letters)}
    path, ends = [], []
    for w in romanize.roman_tokens(text):
        path += [x for c in w for x in (ids[c], ids[c], 0)] + [0] * 5
        ends.append(len(path) - 5)
    scores = np.full((len(path), len(letters) + 2), -9.0)
    scores[np.arange(len(path)), path] = 0.0
    scores[:, -1] = -3.0
    words = align.segment_words(scores, text, 10.0, 10.0 + len(path) * 0.02, ids, 20.0, romanize.roman_tokens)
    assert [w for w, *_ in words] == text.split() and all(source == "ctc" for *_, source in words)
    assert all(abs(e - 10 - end * 0.02) < 0.12 for (_, _, e, _), end in zip(words, ends, strict=True))
    # without a romaniser these words have no letters to be placed by
    assert not any(align.plain_tokens(text))


def test_romanised_column(spark):
    df = spark.createDataFrame([(1, "Москва 1"), (2, ""), (3, None)], "i int, t string")
    assert [r.r for r in df.orderBy("i").select(romanize.romanized(F.col("t")).alias("r")).collect()] == ["moskva 1".replace("1", ""), "", None]


def test_small_recordings_share_a_task(tmp_path, monkeypatch):
    """Tasks grow with the files' bytes and number and not with the length of a stretch, and a file isn't opened past its limit."""
    from spanloom.sources import pcm

    for k in range(2100):
        (tmp_path / f"{k}.wav").write_bytes(pcm.container(bytes(range(200)), 8000, 1, 8))
    reader = pcm.PcmReader({"path": str(tmp_path), "limit": "0.01", "rangeBytes": "100"})
    parts = reader.partitions()
    # containers of 244 bytes are three stretches each
    assert [len(p.parts) for p in parts] == [1000] * 6 + [300]
    opens, whole = [], pcm.header
    monkeypatch.setattr(pcm, "header", lambda f, size: opens.append(1) or whole(f, size))
    rows = [r for p in parts for r in reader.read(p)]
    got = {}
    for path, _, _, _, first, samples, data, error in rows:
        assert samples == 81 and error is None
        got.setdefault(path, {})[first] = data
    assert len(got) == 2100 and all(b"".join(x[k] for k in sorted(x)) == bytes(range(81)) for x in got.values())
    # six of the files are cut by the bounds of partitions
    assert len(opens) <= 2100 + 6
