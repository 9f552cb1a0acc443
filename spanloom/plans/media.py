"""Queries of recordings' files, of scores in windows, and of romanised words, with their SQL; registered with those of :mod:`driver`."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import align, cues, identity, intervals, romanize, stats
from ..operators import text as text_ops
from ..operators.folds import fold_groups
from ..sources import pcm, publish
from ..sources.scratch import scratch_folder
from ..sources.tables import table
from .driver import query


def target(spark: SparkSession) -> str:
    """A new folder below the shared one."""
    return f"{scratch_folder(spark)}/files-{uuid.uuid4().hex}"


@query("""
SELECT job, 'conv/' || job || '.txt' AS name, strlen(txt)::BIGINT AS size, sha256(txt) AS sha256, 'k' || job % 3 AS key FROM
 (SELECT conv_id AS job, coalesce(string_agg(trim(text), chr(10) ORDER BY turn) FILTER (trim(text) <> ''), '') || chr(10) AS txt FROM conversations GROUP BY conv_id)""")
def published_files(spark: SparkSession, sf: str) -> DataFrame:
    """Plain texts of all conversations, published by tasks and read back as files where the manifest names them."""
    texts = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("job")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]).alias("texts"))
    files = texts.select("job", F.concat(F.lit("conv/"), "job", F.lit(".txt")).alias("name"), cues.plain_text(F.col("texts")).alias("content"), F.concat(F.lit("k"), F.col("job") % 3).alias("key"))
    root = target(spark)
    told = publish.publish(files, root, ("key",)).select(F.col("job").cast("long").alias("job"), "fields", F.explode("files").alias("f"))
    stored = spark.read.format("binaryFile").load(f"{root}/conv").select(F.regexp_extract("path", "(conv/[^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("sha256"), "length")
    same = (F.col("f.name") == F.col("name")) & (F.col("f.sha256") == F.col("sha256")) & (F.col("f.size") == F.col("length"))
    return told.join(stored, same).select("job", "name", F.col("length").alias("size"), "sha256", F.col("fields")["key"].alias("key"))


@query("""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), r AS (SELECT doc_id, h, least(greatest(len(h) // 2 - 80, 0), 4001)::BIGINT AS n FROM d)
SELECT doc_id, 8000::INT AS rate, n AS samples, sha256(from_hex(substr(h, 161, 2 * n))) AS sha256 FROM r""")
def pcm_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as 8-bit recordings at 8 kHz: written as containers, and half a second and a sample of each read back by ranges, from a hundredth of a second on."""

    @F.pandas_udf("binary")
    def contained(text: pd.Series) -> pd.Series:
        return text.map(lambda t: pcm.container((t or "").encode(), 8000, 1, 8))

    root = target(spark)
    publish.publish(table(spark, sf, "documents").select(F.col("doc_id").alias("job"), F.concat(F.lit("pcm/"), "doc_id", F.lit(".wav")).alias("name"), contained("text").alias("content")), root)
    read = pcm.read_pcm(spark, f"{root}/pcm", start=0.01, limit=0.5, range_bytes=50_000)
    parts = read.groupBy(F.regexp_extract("path", r"(\d+)\.wav$", 1).cast("long").alias("doc_id")).agg(F.max("rate").alias("rate"), F.max("samples").alias("samples"), F.array_sort(F.collect_list(F.struct("first", F.hex("pcm").alias("x")))).alias("p"))
    return parts.select("doc_id", "rate", "samples", F.sha2(F.unhex(F.array_join(F.transform("p", lambda p: p["x"]), "")), 256).alias("sha256"))


@query("""
WITH f AS (SELECT vec_id // 500 AS job, vec_id % 500 AS frame, round(embedding[1]::DOUBLE * 1000000)::BIGINT AS a, round(embedding[2]::DOUBLE * 1000000)::BIGINT AS b FROM embeddings)
SELECT job, frame, coalesce(sum(a) OVER w, 0)::BIGINT AS a, coalesce(max(b) OVER w, 0)::BIGINT AS b FROM f WINDOW w AS (PARTITION BY job ORDER BY frame RANGE BETWEEN 3 PRECEDING AND 2 FOLLOWING)""")
def window_stitching(spark: SparkSession, sf: str) -> DataFrame:
    """Scores that look three frames back and two ahead, made in windows of 30 frames with 4 of context, and stitched: those of one run over all frames."""
    e = table(spark, sf, "embeddings")
    frames = e.select(F.expr("vec_id div 500").alias("job"), (F.col("vec_id") % 500).alias("frame"), *(F.round(F.element_at("embedding", k + 1).cast("double") * 1_000_000).cast("long").alias(n) for k, n in enumerate("ab")))
    seen = align.windowed_rows(frames, "frame", 30, 4)
    # the model sees one window: nothing else is in its group
    near = F.expr("array_agg(struct(at, a, b))")
    whole = seen.groupBy("job", "window_index").agg(near.alias("w"))
    around = lambda x: F.filter("w", lambda y: (y["at"] >= x["at"] - 3) & (y["at"] <= x["at"] + 2))
    scored = F.transform("w", lambda x: F.struct(x["at"].alias("at"), F.aggregate(around(x), F.lit(0).cast("long"), lambda s, y: s + y["a"]).alias("a"), F.array_max(F.transform(around(x), lambda y: y["b"])).alias("b")))
    made = whole.select("job", "window_index", F.explode(scored).alias("s")).select("job", "window_index", "s.*")
    return align.stitched_rows(made, "frame", 30, 4).select("job", "frame", "a", "b")


@query(r"""
WITH t AS (SELECT doc_id, list_transform(list_filter(string_split_regex(text, '\s+'), lambda w: w <> ''), lambda w: regexp_replace(strip_accents(replace(replace(replace(lower(w), 'ß', 'ss'), 'œ', 'oe'), 'æ', 'ae')), '[^a-z'']', '', 'g')) AS w FROM documents)
SELECT doc_id, len(w)::BIGINT AS tokens, sha256(array_to_string(w, ' ')) AS sha256 FROM t""")
def romanised_words(spark: SparkSession, sf: str) -> DataFrame:
    """The alignment tokens of all words; the SQL knows the Latin letters of these four languages, tests the other scripts."""
    d = table(spark, sf, "documents").select("doc_id", "text", romanize.romanized("text").alias("r"))
    words = F.when(F.col("text").isNotNull(), F.size(F.filter(F.split("text", r"(?U)\s+"), lambda w: w != "")))
    return d.select("doc_id", words.cast("long").alias("tokens"), F.sha2("r", 256).alias("sha256"))


@query("""
WITH x AS (SELECT user_id AS job, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, round(least(value, 100.0) * 300)::BIGINT AS x FROM events),
w AS (SELECT job, i // 10 AS k FROM x GROUP BY job, i // 10 HAVING count(*) = 10 AND 20 * log10(sqrt(avg(x * x)) + 1e-9::DOUBLE) >= 85),
g AS (SELECT job, k, CASE WHEN k - lag(k) OVER (PARTITION BY job ORDER BY k) <= 3 THEN 0 ELSE 1 END AS new FROM w), s AS (SELECT job, k, sum(new) OVER (PARTITION BY job ORDER BY k) AS s FROM g),
r AS (SELECT job, min(k) AS a, max(k) + 1 AS b FROM s GROUP BY job, s HAVING max(k) + 1 - min(k) >= 2)
SELECT job, (row_number() OVER (PARTITION BY job ORDER BY a) - 1)::BIGINT AS span_index, a::BIGINT AS first, b::BIGINT AS "end" FROM r""")
def energy_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Loud spans of each user's values as samples, in windows of ten: joined over up to two quiet windows, of two windows at least."""

    def fold(samples: list[int]) -> list[tuple]:
        spans = intervals.energy_spans(np.array(samples), rate=200, floor_db=85, min_s=0.1, max_s=1e9, max_silence_s=0.1, step_s=0.05)
        return [(k, round(a / 0.05), round(b / 0.05)) for k, (a, b) in enumerate(spans)]

    e = table(spark, sf, "events").select(F.col("user_id").alias("job"), "ts", "event_id", F.round(F.least("value", F.lit(100.0)) * 300).cast("long").alias("x"))
    return fold_groups(e, "job", ["ts", "event_id"], ["x"], fold, [("span_index", T.LongType()), ("first", T.LongType()), ("end", T.LongType())])


#: Configurations as JSON, by a part's size modulo their number: dense, int8 and int4, and what can't be used.
CONFIGS = (
    '{"model_type":"speech","architectures":["Speech"]}',
    '{"model_type":"speech","quantization_config":{"quant_method":"BitsAndBytes","load_in_8bit":true}}',
    '{"model_type":"speech","architectures":[],"quantization_config":{"quant_method":"bitsandbytes","_load_in_4bit":true,"load_in_8bit":false}}',
    '{"model_type":"text"}',
    '{"model_type":"speech","architectures":["Other"]}',
    '{"model_type":"speech","quantization_config":"int8"}',
    '{"model_type":"speech","quantization_config":{"quant_method":"bitsandbytes","load_in_4bit":"true"}}',
    '{"model_type":"speech","quantization_config":{"quant_method":"gptq","load_in_4bit":true}}',
    '{"model_type":"speech","quantization_config":{"quant_method":"bitsandbytes","load_in_4bit":true,"load_in_8bit":true}}',
    '{"model_type":"speech","quantization_config":null}',
    '{"model_type":',
    '["speech"]',
)
ADAPTER = """'{"peft_type":"' || CASE WHEN p_partkey % 7 = 0 THEN 'ia3' ELSE 'lora' END || '","task_type":"' || CASE WHEN p_partkey % 11 = 0 THEN 'CAUSAL_LM' ELSE 'seq_2_seq_lm' END || '","base_model_name_or_path":"' || CASE WHEN p_partkey % 5 = 0 THEN 'other' ELSE 'base' END || '"' || CASE WHEN p_partkey % 3 = 0 THEN ',"revision":"r' || p_partkey % 2 || '"' ELSE '' END || '}'"""


@query(f"""
WITH c AS (SELECT p_partkey, [{", ".join("'" + c + "'" for c in CONFIGS)}][p_size % {len(CONFIGS)} + 1] AS t, {ADAPTER} AS a, CASE WHEN p_partkey % 4 > 0 THEN 'r1' END AS rev FROM part),
j AS (SELECT *, CASE WHEN json_valid(t) THEN t ELSE '0' END::JSON AS j FROM c),
x AS (SELECT *, json_type(j, '$.quantization_config') AS q, coalesce(json_type(j, '$.quantization_config.load_in_4bit'), json_type(j, '$.quantization_config._load_in_4bit'), 'BOOLEAN') AS k4, coalesce(json_type(j, '$.quantization_config.load_in_8bit'), json_type(j, '$.quantization_config._load_in_8bit'), 'BOOLEAN') AS k8,
  coalesce(json_extract_string(j, '$.quantization_config.load_in_4bit'), json_extract_string(j, '$.quantization_config._load_in_4bit'), 'false') = 'true' AS f4, coalesce(json_extract_string(j, '$.quantization_config.load_in_8bit'), json_extract_string(j, '$.quantization_config._load_in_8bit'), 'false') = 'true' AS f8 FROM j),
f AS (SELECT *, CASE WHEN json_type(j) <> 'OBJECT' THEN 'configuration is unreadable' WHEN coalesce(json_extract_string(j, '$.model_type'), '') <> 'speech' THEN 'another type of model' WHEN json_array_length(j, '$.architectures') > 0 AND NOT list_contains(json_extract_string(j, '$.architectures[*]'), 'Speech') THEN 'architecture is not declared'
  WHEN coalesce(q, 'NULL') NOT IN ('NULL', 'OBJECT') THEN 'quantization is not valid' WHEN q = 'OBJECT' AND (k4 <> 'BOOLEAN' OR k8 <> 'BOOLEAN') THEN 'load flags must be boolean' WHEN q = 'OBJECT' AND (lower(coalesce(json_extract_string(j, '$.quantization_config.quant_method'), '')) <> 'bitsandbytes' OR f4 = f8) THEN 'quantization is not supported' END AS fault FROM x),
m AS (SELECT *, CASE WHEN fault IS NULL THEN CASE WHEN coalesce(q, 'NULL') = 'NULL' THEN 'dense' WHEN f4 THEN 'int4' ELSE 'int8' END END AS format FROM f)
SELECT p_partkey, format, fault, CASE WHEN coalesce(format, '') <> 'dense' THEN 'adapters need a dense base model' WHEN p_partkey % 7 = 0 THEN 'not a LoRA adapter' WHEN p_partkey % 11 = 0 THEN 'another task' WHEN rev IS NOT NULL AND p_partkey % 5 = 0 THEN 'another base model'
  WHEN rev IS NOT NULL AND p_partkey % 3 = 0 AND p_partkey % 2 = 0 THEN 'another revision of the base model' END AS adapter_fault FROM m""")
def model_formats(spark: SparkSession, sf: str) -> DataFrame:
    """What configurations of models and of adapters say, a pair for each part."""
    text = F.element_at(F.array(*map(F.lit, CONFIGS)), (F.col("p_size") % len(CONFIGS) + 1).cast("int"))
    parts = table(spark, sf, "part").select("p_partkey", text.alias("t"), F.expr(ADAPTER).alias("a"), F.when(F.col("p_partkey") % 4 > 0, "r1").alias("rev"))
    judged = parts.select("*", identity.model_format(F.col("t"), "speech", "Speech").alias("m"))
    return judged.select("p_partkey", "m.format", "m.fault", identity.adapter_fault(F.col("a"), F.col("m.format"), F.lit("base"), F.col("rev")).alias("adapter_fault"))


@query()
def scored_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Word errors of each turn against the one before it, by the scoring profile; tests hold them against plain steps, as DuckDB has no composition."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", text_ops.scored(F.col("text")).alias("hypothesis"))
    pairs = c.withColumn("reference", F.lag("hypothesis").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("reference is not null")
    return stats.word_errors(pairs, "reference", "hypothesis").select("conv_id", "turn", "units", "substitutions", "deletions", "insertions")
