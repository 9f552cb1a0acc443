"""The thin queries op1_ to op13_, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import audio, crosstok, decontaminate, licenses, linededup, lm, merkle, minhash, packing, secrets, simhash, toxicity, urls

#: The URL rules.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op1_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf, "documents"), width=3, radius=2)


def op2_audio(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    made = audio.audio_columns(docs)
    data = audio.wav_payload(F.col("media"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start_s"], s["end_s"])), ",")
    return made.select(
        "doc_id",
        "n_bytes",
        F.octet_length(data).cast("long").alias("payload_bytes"),
        F.sha2(data, 256).alias("payload_sha256"),
        F.crc32(F.substring(data, -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(";", "frames", F.sha2("tensors", 256), spans).alias("feature"),
    )


def op3_lines(spark: SparkSession, sf: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf, "documents").select("doc_id", "text"))


def op4_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = decontaminate.with_leaks(docs, table(spark, sf, "benchmark"), keep_text=False)
    return found.select("doc_id", F.explode("leaks").alias("l")).select("doc_id", F.col("l.item").alias("item_id"), F.col("l.similarity").alias("similarity"))


def op5_licenses(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.scan(table(spark, sf, "documents").select("doc_id", "text"))


def op6_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)


def label_table(spark: SparkSession, sf: str) -> DataFrame:
    """Chain categories of the label table: low quality, then toxic."""
    return table(spark, sf, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")


def op7_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return toxicity.judge(docs, label_table(spark, sf), ["low_quality", "toxic"], reject="toxic")


def secret_rows(found: DataFrame) -> DataFrame:
    """The contract's columns of a scan."""
    base = F.filter("spans", lambda s: s["base"])
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(number, ("assign", "access", "hex")), F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"), "blob")


def op8_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return secret_rows(secrets.scan(table(spark, sf, "documents").select("doc_id", "text"))[0])


def op8_secrets_resumed(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of op8_secrets by a second run: a first one left its ledger of half of all blobs, and only the others are scanned."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    earlier = docs.filter(F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 1) < "8")
    _, ledger = secrets.scan(earlier)
    return secret_rows(secrets.scan(docs, ledger=ledger)[0])


def op9_ppm(spark: SparkSession, sf: str) -> DataFrame:
    training = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1
    return lm.score_corpus(table(spark, sf, "documents"), training, order=4)


def op10_urls(spark: SparkSession, sf: str) -> DataFrame:
    return urls.judge(table(spark, sf, "pages").select("page_id", "url"), URL_RULES)


def op11_minhash(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.minhash_components(table(spark, sf, "documents").select("doc_id", "text"), words=5, percent=85)


def op12_merkle(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    head = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    told = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    claim = F.when(told, merkle.leaf([*head, F.replace("text", F.lit("\n"), F.lit(""))]))
    proofs = merkle.prove(docs, merkle.leaf([*head, F.col("text")]), carry={"claim": claim})
    back = merkle.folded(F.coalesce("claim", "leaf"), F.col("path"))
    out = proofs.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), back.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_crosstok(spark: SparkSession, sf: str) -> DataFrame:
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return crosstok.cross_align(table(spark, sf, "documents"), *paths)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {q.__name__: q for q in (op1_simhash, op2_audio, op3_lines, op4_decontaminate, op5_licenses, op6_packing, op7_toxicity, op8_secrets, op8_secrets_resumed, op9_ppm, op10_urls, op11_minhash, op12_merkle, op13_crosstok)}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def license_sql(least: float = 0.8) -> str:
    """Bigram sets with list functions, all templates compared."""
    values = ", ".join(f"({_quoted(n)}, {_quoted(t)})" for n, t in licenses.TEMPLATES.items())
    return rf"""
    WITH units AS (
      SELECT doc_id, 'line' AS kind, unnest(range(len(string_split(text, chr(10)))))::INT AS "at", unnest(string_split(text, chr(10))) AS t FROM documents
      UNION ALL
      SELECT * FROM (SELECT doc_id, 'block' AS kind, unnest(range(len(regexp_split_to_array(text, '\n\s*\n'))))::INT AS "at", unnest(regexp_split_to_array(text, '\n\s*\n')) AS t
                     FROM documents WHERE len(regexp_split_to_array(text, '\n\s*\n')) > 1) WHERE contains(t, chr(10))
      UNION ALL
      SELECT doc_id, 'text', 0, text FROM documents WHERE contains(text, chr(10))),
    every AS (SELECT 1 AS side, doc_id, kind, "at", t, '' AS name FROM units UNION ALL SELECT 2, 0, '', 0, column1, column0 FROM (VALUES {values}) v(column0, column1)),
    worded AS (SELECT *, string_split(trim(regexp_replace(lower(t), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM every),
    sets AS (SELECT side, doc_id, kind, "at", name, list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS b FROM worded WHERE len(w) > 1),
    scored AS (SELECT u.doc_id, u.kind, u."at", s.name, 2.0::DOUBLE * len(list_intersect(u.b, s.b)) / (len(u.b) + len(s.b)) AS d FROM sets u, sets s WHERE u.side = 1 AND s.side = 2),
    best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind, "at" ORDER BY d DESC, name) AS r FROM scored WHERE d >= {least})
    SELECT doc_id, kind, "at", name AS license, round(d, 6) AS dice FROM best WHERE r = 1"""


URL_SQL = """
    WITH u AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN regexp_replace(substr(url, strpos(url, '://') + 3), '[?#](.|\n)*$', '') ELSE '' END AS rest FROM pages),
    s AS (SELECT page_id, url, translate(split_part(coalesce(rest, ''), '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substr(coalesce(rest, ''), length(split_part(coalesce(rest, ''), '/', 1)) + 1) AS path FROM u),
    r(rh, rp, rv) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
    m AS (SELECT s.page_id, max_by(rh || rp, length(rh) * 100000 + length(rp)) AS rule, max_by(rv, length(rh) * 100000 + length(rp)) AS verdict
          FROM s JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY s.page_id)
    SELECT s.page_id, s.url, host, path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM s LEFT JOIN m USING (page_id)"""

#: All windows of up to 20 lines that are shortest from one of their ends, compared as text.
LINES_SQL = r"""
    WITH p AS (SELECT doc_id, list_filter(string_split(regexp_replace(regexp_replace(text, '(\n+)', '\1' || chr(31), 'g'), '([.!?] )', '\1' || chr(31), 'g'), chr(31)), lambda x: x <> '') AS ps, text FROM documents),
    l AS (SELECT doc_id, ps, [trim(x, ' ' || chr(9) || chr(10) || chr(13)) FOR x IN ps] AS b FROM p),
    n AS (SELECT doc_id, ps, b, [length(x) - length(replace(x, ' ', '')) + 1 FOR x IN b] AS w FROM l),
    i AS (SELECT *, unnest(range(1, len(b) + 1)) AS i FROM n),
    c AS (SELECT *, unnest(range(i, least(i + 20, len(b) + 1))) AS e FROM i),
    v AS (SELECT doc_id, i, e, b, list_sum(w[i:e]) AS total, w[i] AS head, w[e] AS tail FROM c),
    k AS (SELECT doc_id, i, e, array_to_string(b[i:e], chr(31)) AS key FROM v WHERE total >= 20 AND (total - head < 20 OR total - tail < 20)),
    f AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id, i) AS r FROM k),
    g AS (SELECT doc_id, list(DISTINCT j) AS gone FROM (SELECT doc_id, unnest(range(i, e + 1)) AS j FROM f WHERE r > 1) GROUP BY doc_id)
    SELECT p.doc_id, CASE WHEN gone IS NULL THEN text ELSE array_to_string([x FOR x, j IN ps IF NOT list_contains(gone, j)], '') END AS text, coalesce(len(gone), 0)::INT AS deleted FROM p LEFT JOIN g USING (doc_id)"""


#: Rules that DuckDB's patterns can only say with the sign before a match, and the group without it.
WITH_SIGN = {"web_token": (r"(?:^|[^A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})", 1)}


def secret_sql() -> str:
    """Matches in order; each one's place is where its text next occurs, and its span ends there."""
    stated = lambda r: WITH_SIGN.get(r.kind, (r.pattern, 0))
    rules = " UNION ALL ".join(
        f"SELECT doc_id, {k} AS k, '{r.kind}' AS kind, {str(r.base).lower()} AS base, {r.least} AS least, text, regexp_extract_all(text, {_quoted(stated(r)[0])}) AS ms, regexp_extract_all(text, {_quoted(stated(r)[0])}, {stated(r)[1]}) AS ws, regexp_extract_all(text, {_quoted(stated(r)[0])}, {r.group}) AS gs FROM d"
        for k, r in enumerate(secrets.RULES)
    )
    return f"""
    WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), a AS ({rules}),
    q AS (SELECT *, ms[i] AS m, ws[i] AS w, gs[i] AS g FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM a)),
    r AS (SELECT DISTINCT doc_id, k, 0::BIGINT AS i, 0::BIGINT AS s, 0::BIGINT AS e FROM q
      UNION ALL SELECT q.doc_id, q.k, q.i, r.e + strpos(substr(q.text, r.e + 1), q.m) - 1, r.e + strpos(substr(q.text, r.e + 1), q.m) - 1 + length(q.m) FROM r JOIN q ON q.doc_id = r.doc_id AND q.k = r.k AND q.i = r.i + 1),
    x AS (SELECT r.doc_id, r.e - length(q.w) AS s, r.k, q.kind, q.base, q.kind || ':' || (r.e - length(q.w)) || ':' || r.e AS span FROM r JOIN q ON q.doc_id = r.doc_id AND q.k = r.k AND q.i = r.i WHERE length(q.g) >= q.least),
    t AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, string_agg(span, ',' ORDER BY s, k) FILTER (base) AS b, string_agg(span, ',' ORDER BY s, k) AS every FROM x GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(every, '') AS spans, sha256(d.text) AS blob FROM d LEFT JOIN t USING (doc_id)"""


#: All pairs that share a shingle; what each document reaches by links.
MINHASH_SQL = r"""
    WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM w),
    n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s), e AS (SELECT doc_id, unnest(s) AS h FROM s),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
    l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
    g AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, g.b FROM r JOIN g ON g.a = r.b),
    m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
    SELECT n.doc_id, n AS n_shingles, component_id, n.doc_id = component_id AS kept FROM n JOIN m USING (doc_id)"""

#: CRC-32 by bits; the trees a level at a time, all siblings of a level by one join.
MERKLE_SQL = """
    WITH RECURSIVE f AS (SELECT *, CASE WHEN doc_id IS NOT NULL AND xor(4294967295, list_reduce([4294967295::BIGINT] || [ord(x)::BIGINT FOR x IN string_split(doc_id::VARCHAR, '')],
             lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS told FROM documents),
    h AS (SELECT doc_id, source, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
             || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head, text, told FROM f),
    l AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(told) || ':' || told, '-')) AS claim FROM h),
    o AS (SELECT *, row_number() OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST, leaf) AS row, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n,
             dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s FROM l),
    t AS (SELECT 0 AS lv, s, i, n, leaf AS digest FROM o
      UNION ALL SELECT lv + 1, s, i // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY lv, s, i // 3, n),
    q AS (SELECT lv AS top, s, digest FROM t WHERE n = 1),
    u AS (SELECT 0 AS lv, s AS i, count(*) OVER () AS n, digest FROM q
      UNION ALL SELECT lv + 1, i // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY lv, i // 3, n),
    a AS (SELECT row, lv, coalesce(string_agg(t.digest, '' ORDER BY t.i) FILTER (t.i < o.i // (3 ** lv)::BIGINT), '') AS left_, coalesce(string_agg(t.digest, '' ORDER BY t.i) FILTER (t.i > o.i // (3 ** lv)::BIGINT), '') AS right_
          FROM o JOIN t ON t.s = o.s AND t.n > 1 AND t.i // 3 = o.i // (3 ** (lv + 1))::BIGINT GROUP BY row, lv),
    b AS (SELECT row, q.top + lv AS lv, coalesce(string_agg(u.digest, '' ORDER BY u.i) FILTER (u.i < o.s // (3 ** lv)::BIGINT), '') AS left_, coalesce(string_agg(u.digest, '' ORDER BY u.i) FILTER (u.i > o.s // (3 ** lv)::BIGINT), '') AS right_
          FROM o JOIN q ON q.s = o.s JOIN u ON u.n > 1 AND u.i // 3 = o.s // (3 ** (lv + 1))::BIGINT GROUP BY row, q.top, lv),
    p AS (SELECT * FROM a UNION ALL SELECT * FROM b),
    w AS (SELECT row, 0 AS lv, claim AS digest FROM o
      UNION ALL SELECT w.row, w.lv + 1, sha256(left_ || w.digest || right_) FROM w JOIN p ON p.row = w.row AND p.lv = w.lv),
    e AS (SELECT row, max_by(digest, lv) AS folded_root FROM w GROUP BY row),
    z AS (SELECT row, sha256(string_agg(left_ || right_, '' ORDER BY lv)) AS proof_sha256 FROM p GROUP BY row),
    r AS (SELECT digest AS root FROM u WHERE n = 1)
    SELECT doc_id, leaf, q.digest AS subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified FROM o JOIN q ON q.s = o.s JOIN e ON e.row = o.row LEFT JOIN z ON z.row = o.row, r"""

ORACLE_SQL: dict[str, str] = {"op11_minhash": MINHASH_SQL, "op12_merkle": MERKLE_SQL, "op3_lines": LINES_SQL, "op8_secrets": secret_sql(), "op8_secrets_resumed": secret_sql(), "op5_licenses": license_sql(), "op10_urls": URL_SQL}
