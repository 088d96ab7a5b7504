"""Registered queries over the driver's tables, each with its DuckDB SQL where SQL can say it.

A name's number is the operator's in the survey. Q(name, sql) registers the function below it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import hashing as H
from millrace.functions import text as T
from millrace.operators import contamination as C
from millrace.operators import conversations as V
from millrace.operators import dedup as D
from millrace.operators import metrics as M
from millrace.operators import ordered as W
from millrace.operators import profile as P
from millrace.session import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def Q(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


N1 = r"regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]', '', 'g')"
LEN = 766  # the sequence length of the token accounting, less begin and end
SEED = "mix-v1"

_PAT = f"""pat AS (SELECT n AS normalized, sha256(n) AS pattern_id, list_sort(list(DISTINCT item_id)) AS entries
  FROM (SELECT item_id, {N1.format("text")} AS n FROM benchmark) WHERE n != '' GROUP BY n)"""
_HITS = f"""docs AS (SELECT doc_id, lang, source, text, {N1.format("text")} AS n FROM documents),
hits AS (
  SELECT doc_id, 'exact' AS reason, pattern_id FROM docs JOIN pat ON docs.n = pat.normalized
  UNION ALL SELECT doc_id, 'containment', pattern_id FROM docs JOIN pat ON contains(docs.n, pat.normalized) AND docs.n != pat.normalized WHERE length(pat.normalized) >= 20
  UNION ALL SELECT doc_id, 'empty_text', NULL FROM docs WHERE text IS NULL OR trim(text) = '')"""


# 2.1 scans


@Q("s01_scan_projection", "SELECT doc_id, length(text) AS chars FROM documents WHERE lang = 'de'")
def s01(spark, sf):
    from millrace.sources.readers import parquet_text

    return parquet_text(spark, f"{sf}/documents.parquet", "text", ["doc_id", "lang"]).where("lang = 'de'").select("doc_id", F.length("text").cast("long").alias("chars"))


@Q("s06_text_quality", """
SELECT CASE WHEN text IS NULL THEN 'missing' WHEN trim(text) = '' THEN 'blank' WHEN length(text) < 50 THEN 'short' ELSE 'valid' END AS class, count(*) AS n, sum(coalesce(length(text), 0))::BIGINT AS chars
FROM documents GROUP BY 1""")
def s06(spark, sf):
    kind = F.when(F.col("text").isNull(), "missing").when(T.is_blank(F.col("text")), "blank").when(F.length("text") < 50, "short").otherwise("valid")
    return t(spark, sf, "documents").groupBy(kind.alias("class")).agg(F.count("*").alias("n"), F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("chars"))


@Q("s11_benchmark_patterns", f"WITH {_PAT} SELECT pattern_id, length(normalized) AS chars, len(entries) AS n_entries, entries[1] AS first_entry FROM pat")
def s11(spark, sf):
    made = C.patterns(t(spark, sf, "benchmark"))
    return made.select("pattern_id", F.length("normalized").cast("long").alias("chars"), F.size("entries").cast("long").alias("n_entries"), F.col("entries")[0].alias("first_entry"))


@Q("s12_eval_reference", r"""
SELECT item_id, sha256(p) AS prompt_sha256 FROM (
  SELECT item_id, p, row_number() OVER (PARTITION BY p ORDER BY item_id) AS k FROM (SELECT item_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS p FROM benchmark)) WHERE k = 1""")
def s12(spark, sf):
    rows = t(spark, sf, "benchmark").select("item_id", T.ws_lower(F.col("text")).alias("p"))
    return D.exact_first(rows, F.col("p"), "item_id").select("item_id", H.sha256(F.col("p")).alias("prompt_sha256"))


@Q("s13_row_access", "SELECT doc_id, md5(text) AS m FROM (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS row_index FROM documents) WHERE row_index IN (0, 7, 99)")
def s13(spark, sf):
    rows = W.running(t(spark, sf, "documents"), ["doc_id"]).where((F.col("global_rank") - 1).isin(0, 7, 99))
    return rows.select("doc_id", F.md5(F.col("text").cast("binary")).alias("m"))


@Q("s14_first_rows", "SELECT doc_id, length(text) AS chars FROM documents WHERE length(text) > 100 ORDER BY doc_id LIMIT 20")
def s14(spark, sf):
    return t(spark, sf, "documents").where(F.length("text") > 100).orderBy("doc_id").limit(20).select("doc_id", F.length("text").cast("long").alias("chars"))


@Q("s16_log_numbers", r"SELECT event_id, TRY_CAST(regexp_extract(props, '\"k\": (\d+)', 1) AS BIGINT) AS k FROM events WHERE event_type = 'error'")
def s16(spark, sf):
    return t(spark, sf, "events").where("event_type = 'error'").select("event_id", F.regexp_extract("props", r'"k": (\d+)', 1).try_cast("long").alias("k"))


# 2.2 sinks


@Q("k01_round_robin_shards", f"""
SELECT doc_id, CAST((row_number() OVER (ORDER BY key, doc_id) - 1) % 8 AS INTEGER) AS shard
FROM (SELECT doc_id, sha256('{SEED}:' || doc_id) AS key FROM documents)""")
def k01(spark, sf):
    rows = t(spark, sf, "documents").select("doc_id", H.sha256(F.concat(F.lit(SEED + ":"), F.col("doc_id").cast("string"))).alias("key"))
    return W.round_robin(rows, ["key", "doc_id"], 8).select("doc_id", "shard")


@Q("k06_provenance", "SELECT doc_id, lang, source, n_chars FROM documents")
def k06(spark, sf):
    return t(spark, sf, "documents").drop("text")


@Q("k07_ledger_counts", f"""
WITH {_PAT}, {_HITS}, ev AS (SELECT DISTINCT h.doc_id, reason, lang FROM hits h JOIN docs USING (doc_id))
SELECT lang, reason, count(*) AS n FROM ev GROUP BY GROUPING SETS ((lang, reason), (reason), ())""")
def k07(spark, sf):
    events = C.ledger(t(spark, sf, "documents"), t(spark, sf, "benchmark"), ["lang"])
    return P.levels(events, [["lang", "reason"], ["reason"], []], [F.count("*").alias("n")]).select("lang", "reason", "n")


# 2.3 projections

_CONV = "c AS (SELECT conv_id, list(struct_pack(role := role, content := text) ORDER BY turn) AS m FROM conversations GROUP BY conv_id)"


@Q("p03_canonical_rejections", f"""
WITH {_CONV}, b AS (SELECT conv_id, m, list_filter(m, lambda x: x.role != 'system') AS body FROM c)
SELECT conv_id, CASE WHEN len(list_filter(m, lambda x: NOT x.role IN ('system', 'user', 'assistant', 'tool'))) > 0 THEN 'unknown_role'
  WHEN len(list_filter(m, lambda x: coalesce(length(trim(x.content)), 0) = 0)) > 0 THEN 'empty_content'
  WHEN len(list_filter(m[2:], lambda x: x.role = 'system')) > 0 THEN 'late_system' WHEN len(body) = 0 THEN 'no_turn'
  WHEN body[1].role != 'user' THEN 'first_not_user' WHEN body[-1].role != 'assistant' THEN 'last_not_assistant' END AS why FROM b""")
def p03(spark, sf):
    return V.nest(t(spark, sf, "conversations")).select("conv_id", V.rejection(V.canonical(F.col("messages"))).alias("why"))


@Q("p08_unpivot", "SELECT event_id, field, value FROM (UNPIVOT (SELECT event_id, CAST(user_id AS VARCHAR) AS who, event_type AS what FROM events) ON who, what INTO NAME field VALUE value)")
def p08(spark, sf):
    rows = t(spark, sf, "events").select("event_id", F.col("user_id").cast("string").alias("who"), F.col("event_type").alias("what"))
    return rows.unpivot("event_id", ["who", "what"], "field", "value").where("value is not null")


@Q("p09_best_path", """
WITH RECURSIVE n AS (SELECT conv_id * 1000 + turn AS node, CASE WHEN turn > 0 THEN conv_id * 1000 + (turn - 1) // 2 END AS parent, role, length(text) % 5 AS rank FROM conversations WHERE role != 'system' OR turn = 0),
best AS (SELECT parent, role, node FROM (SELECT *, row_number() OVER (PARTITION BY parent, role ORDER BY rank, node) AS k FROM n WHERE parent IS NOT NULL) WHERE k = 1),
path(tree, depth, node, role) AS (SELECT node, 0, node, role FROM n WHERE parent IS NULL UNION ALL
  SELECT tree, depth + 1, b.node, b.role FROM path p JOIN best b ON b.parent = p.node AND b.role = CASE WHEN p.role = 'user' THEN 'assistant' ELSE 'user' END WHERE depth < 31)
SELECT tree, depth, node, role FROM path""")
def p09(spark, sf):
    rows = t(spark, sf, "conversations").where("role != 'system' or turn = 0")
    nodes = rows.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("node"), F.when(F.col("turn") > 0, F.col("conv_id") * 1000 + F.floor((F.col("turn") - 1) / 2)).alias("parent"),
        "role", (F.length("text") % 5).alias("rank"), F.lit(True).alias("reviewed"), F.lit(False).alias("synthetic"),
    )
    return V.best_path(nodes)


@Q("p10_user_turns", "SELECT conv_id, turn, role, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS user_turn FROM conversations")
def p10(spark, sf):
    return V.turns(t(spark, sf, "conversations")).select("conv_id", "turn", "role", "user_turn")


@Q("p10_turn_violations", """
WITH u AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS user_turn FROM conversations),
g AS (SELECT conv_id, user_turn, count(*) FILTER (role = 'assistant') AS replies, arg_max(role, turn) AS last FROM u WHERE user_turn > 0 GROUP BY ALL)
SELECT conv_id, user_turn, CASE WHEN replies = 0 THEN 'no_reply' ELSE 'last_not_assistant' END AS why FROM g WHERE replies = 0 OR last != 'assistant'""")
def p10b(spark, sf):
    return V.turn_violations(t(spark, sf, "conversations"))


@Q("p11_turn_chunks", """
WITH RECURSIVE u AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS ut FROM conversations),
s AS (SELECT conv_id, ut, sum(length(text) + 8)::BIGINT AS n FROM u WHERE ut > 0 GROUP BY ALL),
w(conv_id, ut, chunk, total) AS (
  SELECT conv_id, ut, 0::BIGINT, CASE WHEN n > 2000 THEN 0::BIGINT ELSE n END FROM s WHERE ut = 1
  UNION ALL SELECT s.conv_id, s.ut, CASE WHEN total > 0 AND n <= 2000 AND total + n <= 2000 THEN chunk WHEN total > 0 THEN chunk + 1 ELSE chunk END,
    CASE WHEN n > 2000 THEN 0 WHEN total > 0 AND total + n <= 2000 THEN total + n ELSE n END
  FROM w JOIN s ON s.conv_id = w.conv_id AND s.ut = w.ut + 1)
SELECT conv_id, chunk, min(ut) AS first_turn, max(ut) AS last_turn, max(total) AS chars FROM w WHERE total > 0 GROUP BY conv_id, chunk""")
def p11(spark, sf):
    return V.turn_chunks(t(spark, sf, "conversations"), 2000, 8)


@Q("p12_chosen_chunk", """
WITH c AS (SELECT doc_id, k, substr(text, CAST(k * 766 + 1 AS BIGINT), 766) AS piece FROM (SELECT doc_id, text, unnest(range(0, (length(text) - 1) // 766 + 1)) AS k FROM documents WHERE length(text) > 0))
SELECT doc_id, k AS chunk FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sha256(doc_id || '|' || piece)) AS r FROM c) WHERE r = 1""")
def p12(spark, sf):
    rows = t(spark, sf, "documents").where(F.length("text") > 0)
    from millrace.operators.reshape import code_point_chunks

    return V.choose_chunk(code_point_chunks(rows, "text", LEN), "doc_id", F.concat_ws("|", F.col("doc_id").cast("string"), "piece")).select("doc_id", "chunk")


@Q("p13_chunks", "SELECT doc_id, k AS chunk, least(766, length(text) - k * 766) AS chars FROM (SELECT doc_id, text, unnest(range(0, (length(text) - 1) // 766 + 1)) AS k FROM documents WHERE length(text) > 0)")
def p13(spark, sf):
    from millrace.operators.reshape import code_point_chunks

    return code_point_chunks(t(spark, sf, "documents"), "text", LEN).select("doc_id", "chunk", F.length("piece").cast("long").alias("chars"))


@Q("p16_rendered", f"WITH {_CONV} SELECT conv_id, md5(array_to_string(list_transform(m, lambda x: '<|im_start|>' || x.role || chr(10) || x.content || '<|im_end|>' || chr(10)), '')) AS m FROM c")
def p16(spark, sf):
    return V.nest(t(spark, sf, "conversations")).select("conv_id", F.md5(V.render(F.col("messages")).cast("binary")).alias("m"))


@Q("p17_encoded", """
SELECT doc_id, least(length(text), 126) + 2 AS kept, 126 - least(length(text), 126) AS padded, unicode(substr(text, 1, 1)) AS first_id FROM documents WHERE length(text) > 0""")
def p17(spark, sf):
    rows = t(spark, sf, "documents").where(F.length("text") > 0)
    made = rows.select("doc_id", V.encode_pretrain(V.code_points(F.col("text")), 128, 1, 2, 0).alias("ids"))
    labels = V.pretrain_labels(F.col("ids"), 0)
    kept = F.size(F.filter(labels, lambda x: x != -100)).cast("long")
    return made.select("doc_id", kept.alias("kept"), (128 - kept).alias("padded"), F.col("ids")[1].alias("first_id"))


@Q("p18_supervised_text", f"""
WITH {_CONV} SELECT conv_id, len(list_filter(m, lambda x: x.role = 'assistant')) AS spans, CAST(coalesce(list_sum(list_transform(list_filter(m, lambda x: x.role = 'assistant'), lambda x: length(x.content) + 11)), 0) AS BIGINT) AS chars FROM c""")
def p18(spark, sf):
    spans = V.assistant_spans(V.render(F.col("messages")))
    return V.nest(t(spark, sf, "conversations")).select("conv_id", F.size(spans).cast("long").alias("spans"), F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("chars"))


@Q("p20_without_last", f"WITH {_CONV} SELECT conv_id, len(m) - 1 AS kept, m[len(m)].role AS dropped FROM c")
def p20(spark, sf):
    return V.nest(t(spark, sf, "conversations")).select("conv_id", F.size(V.without_last(F.col("messages"))).cast("long").alias("kept"), F.element_at("messages", -1)["role"].alias("dropped"))


@Q("p22_trajectories", f"""
WITH {_CONV} SELECT conv_id, k - 1 AS step, k - 1 AS prefix, length(m[k].content) AS chars FROM (SELECT conv_id, m, unnest(range(1, len(m) + 1)) AS k FROM c) WHERE m[k].role = 'assistant'""")
def p22(spark, sf):
    return V.trajectories(V.nest(t(spark, sf, "conversations"))).select("conv_id", F.col("step").cast("long").alias("step"), F.size("prefix").cast("long").alias("prefix"), F.length("target").cast("long").alias("chars"))


@Q("p23_padded_batches", """
SELECT vec_id, vec_id % 10 AS batch, m - (vec_id % 7 + 1) AS padding FROM (SELECT vec_id, max(vec_id % 7 + 1) OVER (PARTITION BY vec_id % 10) AS m FROM embeddings)""")
def p23(spark, sf):
    rows = t(spark, sf, "embeddings").select("vec_id", (F.col("vec_id") % 10).alias("batch"), F.sequence(F.lit(1).cast("long"), F.col("vec_id") % 7 + 1).alias("ids"))
    padded = V.pad_batches(rows, "ids", "batch", 0)
    return padded.select("vec_id", "batch", F.size(F.filter("mask", lambda x: x == 0)).cast("long").alias("padding"))


@Q("p24_flat_metrics", r"SELECT event_id, 'props/k' AS name, CAST(regexp_extract(props, '(\d+)', 1) AS DOUBLE) AS value FROM events UNION ALL SELECT event_id, 'value', value FROM events WHERE value IS NOT NULL")
def p24(spark, sf):
    from millrace.operators.reshape import flat_metrics

    rows = t(spark, sf, "events").select("event_id", F.concat(F.lit('{"props": '), F.col("props"), F.lit(', "flag": true, "value": '), F.col("value").cast("string"), F.lit("}")).alias("json"))
    return flat_metrics(rows, "event_id", "json")


@Q("p25_seeded_system_prompt", "SELECT conv_id, ('0x' || substr(sha256('sys:' || conv_id), 1, 8))::BIGINT % 100 < 20 AS added FROM (SELECT DISTINCT conv_id FROM conversations)")
def p25(spark, sf):
    return t(spark, sf, "conversations").select("conv_id").distinct().select("conv_id", (H.bucket(H.sha256(F.concat(F.lit("sys:"), F.col("conv_id").cast("string"))), 100) < 20).alias("added"))


# 2.4 filters


@Q("f01_reject_reasons", r"""
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN lang NOT IN ('en', 'de', 'fr') THEN 'language' WHEN source = 'src3' THEN 'license_type' WHEN length(text) < 200 THEN 'short' WHEN contains(text, '###') THEN 'symbols' END AS reason FROM documents) GROUP BY reason""")
def f01(spark, sf):
    from millrace.operators.filters import first_failure

    checks = {"language": ~F.col("lang").isin("en", "de", "fr"), "license_type": F.col("source") == "src3", "short": F.length("text") < 200, "symbols": F.contains("text", F.lit("###"))}
    return first_failure(t(spark, sf, "documents"), checks).groupBy("reason").agg(F.count("*").alias("n"))


@Q("f02_blank", "SELECT count(*) FILTER (text IS NULL OR trim(text) = '') AS blank, count(*) AS n FROM documents")
def f02(spark, sf):
    return t(spark, sf, "documents").agg(F.sum(T.is_blank(F.col("text")).cast("long")).alias("blank"), F.count("*").alias("n"))


@Q("f04_bernoulli", "SELECT doc_id FROM documents WHERE CAST(('0x' || substr(sha256('s:' || doc_id), 1, 16))::UBIGINT AS DOUBLE) / 18446744073709551616.0 < 0.25")
def f04(spark, sf):
    return t(spark, sf, "documents").where(H.unit_less_than(H.sha256(F.concat(F.lit("s:"), F.col("doc_id").cast("string"))), 0.25)).select("doc_id")


@Q("f06_token_validity", "SELECT vec_id, len(embedding) BETWEEN 2 AND 64 AND label BETWEEN 0 AND 7 AS valid FROM embeddings")
def f06(spark, sf):
    n = F.size("embedding")
    ids = F.transform(F.sequence(F.lit(1), n), lambda i: F.col("label"))
    return t(spark, sf, "embeddings").select("vec_id", V.valid_tokens(ids, ids, 8, 64).alias("valid"))


@Q("f08_replay", """
SELECT conv_id FROM (SELECT conv_id, count(*) AS n, max(length(text)) AS longest FROM conversations GROUP BY conv_id) WHERE n = 2 AND longest <= 2000""")
def f08(spark, sf):
    return t(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.max(F.length("text")).alias("longest")).where("n = 2 and longest <= 2000").select("conv_id")


@Q("f11_tag_exclusion", "SELECT doc_id FROM documents WHERE lower(trim(source)) NOT IN ('src1', 'src2')")
def f11(spark, sf):
    return t(spark, sf, "documents").where(~F.lower(F.trim("source")).isin("src1", "src2")).select("doc_id")


# 2.5 joins

_WORDS3 = "regexp_extract_all(text, '[^ ]+')"


@Q("j02_exact_contamination", f"WITH {_PAT}, {_HITS} SELECT doc_id, pattern_id FROM hits WHERE reason = 'exact'")
def j02(spark, sf):
    return C.exact_matches(t(spark, sf, "documents"), C.patterns(t(spark, sf, "benchmark")))


@Q("j03_containment", f"WITH {_PAT}, {_HITS} SELECT doc_id, pattern_id FROM hits WHERE reason = 'containment'")
def j03(spark, sf):
    return C.contained_matches(t(spark, sf, "documents"), C.patterns(t(spark, sf, "benchmark")))


_GRAMS = "list_distinct(list_transform(range(1, length(n) - 3), lambda i: substr(n, CAST(i AS BIGINT), 5)))"


@Q("j05_near_vs_benchmark", f"""
WITH a AS (SELECT doc_id, unnest({_GRAMS}) AS g FROM (SELECT doc_id, {N1.format("text")} AS n FROM documents) WHERE length(n) >= 5),
b AS (SELECT item_id, unnest({_GRAMS}) AS g FROM (SELECT item_id, {N1.format("text")} AS n FROM benchmark) WHERE length(n) >= 5),
na AS (SELECT doc_id, count(*) AS c FROM a GROUP BY 1), nb AS (SELECT item_id, count(*) AS c FROM b GROUP BY 1),
p AS (SELECT doc_id, item_id, count(*) AS s FROM a JOIN b USING (g) GROUP BY ALL)
SELECT doc_id, item_id, s / (na.c + nb.c - s) AS jaccard FROM p JOIN na USING (doc_id) JOIN nb USING (item_id) WHERE s / (na.c + nb.c - s) >= 0.5""")
def j05(spark, sf):
    return C.near_matches(t(spark, sf, "documents"), t(spark, sf, "benchmark"), least=0.5, whole=False)


_NEAR = f"""
t AS MATERIALIZED (SELECT doc_id, {N1.format("text")} AS n FROM documents),
f AS MATERIALIZED (SELECT min(doc_id) AS id, n FROM t WHERE length(n) >= 5 GROUP BY n),
s AS MATERIALIZED (SELECT id, list_sort(list_distinct(list_transform({_GRAMS}, lambda g: CAST((('0x' || substr(md5(g), 1, 16))::UBIGINT >> 1) AS BIGINT)))) AS g FROM f),
z AS MATERIALIZED (SELECT id, len(g) AS k, unnest(g[1:32]) AS h FROM s),
c AS MATERIALIZED (SELECT DISTINCT x.id AS a, y.id AS b, x.k + y.k AS k FROM z x JOIN z y ON x.h = y.h AND x.id < y.id AND x.k >= 0.85 * y.k AND y.k >= 0.85 * x.k),
i AS (SELECT a, b, k, len(list_intersect(x.g, y.g)) AS shared FROM c JOIN s x ON x.id = a JOIN s y ON y.id = b),
near AS MATERIALIZED (SELECT a, b, shared / (k - shared) AS jaccard FROM i WHERE shared / (k - shared) >= 0.85
  UNION ALL SELECT f.id, t.doc_id, 1.0 FROM t JOIN f ON t.n = f.n WHERE t.doc_id != f.id)"""


@Q("j08_self_near", f"WITH {_NEAR} SELECT a, b, jaccard FROM near")
def j08(spark, sf):
    return C.self_near_pairs(t(spark, sf, "documents"))


@Q("j07_simhash")
def j07(spark, sf):
    grams = t(spark, sf, "documents").select("doc_id", T.char_ngrams(T.alnum_lower(F.col("text")), 5, "none").alias("g"))
    return grams.select("doc_id", C.simhash("g").alias("simhash"))


@Q("j06_simhash_vs_benchmark")
def j06(spark, sf):
    return C.simhash_pairs(t(spark, sf, "documents"), t(spark, sf, "benchmark"), least=0.5)


@Q("j11_split_overlap", """
WITH d AS (SELECT sha256(text) AS h, ('0x' || substr(sha256('v:' || doc_id), 1, 8))::BIGINT % 10 = 0 AS val FROM documents)
SELECT h FROM d GROUP BY h HAVING bool_or(val) AND bool_or(NOT val)""")
def j11(spark, sf):
    rows = t(spark, sf, "documents").select(H.sha256(F.col("text")).alias("h"), (H.bucket(H.sha256(F.concat(F.lit("v:"), F.col("doc_id").cast("string"))), 10) == 0).alias("val"))
    return rows.groupBy("h").agg(F.max("val").alias("v"), F.max(~F.col("val")).alias("t")).where("v and t").select("h")


@Q("j12_unseen", "SELECT doc_id FROM documents d WHERE source = 'src1' AND NOT EXISTS (SELECT 1 FROM documents s WHERE s.source = 'src0' AND s.text = d.text)")
def j12(spark, sf):
    rows = t(spark, sf, "documents").select("doc_id", "source", H.sha256(F.col("text")).alias("h"))
    return D.unseen(rows.where("source = 'src1'"), rows.where("source = 'src0'"), ["h"]).select("doc_id")


@Q("j14_alignment", "SELECT count(*) AS matched, count(*) FILTER (l.doc_id IS NULL) AS without_label, count(*) FILTER (d.doc_id IS NULL) AS without_document FROM documents d FULL JOIN labels l USING (doc_id)")
def j14(spark, sf):
    rows = t(spark, sf, "documents").select("doc_id", F.lit(1).alias("d")).join(t(spark, sf, "labels").select("doc_id", F.lit(1).alias("l")), "doc_id", "full_outer")
    return rows.agg(F.count("*").alias("matched"), F.sum(F.col("l").isNull().cast("long")).alias("without_label"), F.sum(F.col("d").isNull().cast("long")).alias("without_document"))


@Q("j15_paired_scores", "SELECT sum((quality > toxic)::BIGINT)::BIGINT AS win, sum((quality = toxic)::BIGINT)::BIGINT AS tie, sum((quality < toxic)::BIGINT)::BIGINT AS loss, avg(quality - toxic) AS mean_difference FROM labels")
def j15(spark, sf):
    rows = t(spark, sf, "labels")
    return M.wins(M.paired(rows.withColumn("score", F.col("quality")), rows.withColumn("score", F.col("toxic")), ["doc_id"], "score"))


@Q("j17_blind_pairs", """
WITH d AS (SELECT doc_id, md5(text) AS l, md5(lang || text) AS r, ('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 64, 1))::INT % 2 = 1 AS s FROM documents)
SELECT doc_id, CASE WHEN s THEN r ELSE l END AS one, CASE WHEN s THEN l ELSE r END AS two, s AS swapped FROM d""")
def j17(spark, sf):
    rows = t(spark, sf, "documents")
    left = rows.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text"))
    return C.blind_pairs(left, rows.select("doc_id", F.md5(F.concat("lang", "text").cast("binary")).alias("text")), "doc_id")


@Q("j18_roster", "(SELECT n_name AS name, 'missing' AS side FROM nation EXCEPT ALL SELECT n_name, 'missing' FROM nation WHERE n_regionkey != 1) UNION ALL SELECT 'EXTRA', 'unexpected'")
def j18(spark, sf):
    rows = t(spark, sf, "nation").select(F.col("n_name").alias("name"), "n_regionkey")
    return D.set_difference(rows.select("name"), rows.where("n_regionkey != 1").select("name").unionByName(spark.createDataFrame([("EXTRA",)], "name string")))


# 2.6 deduplication


@Q("d01_exact_dedup", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def d01(spark, sf):
    return D.exact_first(t(spark, sf, "documents").select("doc_id", "text"), H.sha256(F.col("text")), "doc_id").select("doc_id")


@Q("d02_duplicates", "SELECT count(*) AS n_rows, count(DISTINCT text) AS n_distinct, count(*) - count(DISTINCT text) AS n_duplicates FROM documents")
def d02(spark, sf):
    return D.duplicate_counts(t(spark, sf, "documents"), H.sha256(F.col("text")))


@Q("d03_priority", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY CAST(substr(source, 4) AS INT) DESC, doc_id) AS k FROM documents) WHERE k = 1")
def d03(spark, sf):
    rows = t(spark, sf, "documents").select("doc_id", H.sha256(F.col("text")).alias("h"), (-F.substring("source", 4, 9).cast("int")).alias("p"))
    return D.priority_winner(rows, "h", ["p", "doc_id"]).select("doc_id")


@Q("d04_canonical_conversations", r"""
WITH c AS (SELECT conv_id, string_agg(role || ':' || trim(regexp_replace(lower(text), '\s+', ' ', 'g')), chr(10) ORDER BY turn) AS x FROM conversations GROUP BY conv_id)
SELECT min(conv_id) AS conv_id FROM c GROUP BY x""")
def d04(spark, sf):
    rows = V.nest(t(spark, sf, "conversations"))
    body = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), T.ws_lower(m["content"]))), "\n")
    return D.exact_first(rows, H.sha256(body), "conv_id").select("conv_id")


@Q("d05_greedy_accepted")
def d05(spark, sf):
    docs = t(spark, sf, "documents")
    copies, near = C.near_texts(docs)
    nodes = docs.select(F.col("doc_id").alias("node"), H.sha256(F.col("doc_id").cast("string")).alias("rank"))
    return D.greedy_accept(nodes, near.select("a", "b"), copies)


@Q("d07_overlap_matrix", """
WITH s AS (SELECT DISTINCT lang, source FROM documents) SELECT x.lang AS a, y.lang AS b, count(*) AS n FROM s x JOIN s y ON x.source = y.source AND x.lang < y.lang GROUP BY ALL""")
def d07(spark, sf):
    return D.overlaps(t(spark, sf, "documents").select(F.col("lang").alias("split"), F.col("source").alias("key")))


@Q("d07_text_overlaps", f"""
WITH s AS (SELECT DISTINCT lang, 'raw' AS kind, sha256(text) AS h FROM documents UNION SELECT DISTINCT lang, 'normalised', sha256({N1.format("text")}) FROM documents)
SELECT x.lang AS a, y.lang AS b, count(*) FILTER (kind = 'raw') AS raw, count(*) FILTER (kind = 'normalised') AS normalised
FROM s x JOIN s y USING (kind, h) WHERE x.lang < y.lang GROUP BY ALL""")
def d07_texts(spark, sf):
    """Whole texts that each pair of splits shares, raw and normalised."""
    docs, found = t(spark, sf, "documents"), []
    for kind, body in (("raw", F.col("text")), ("normalised", T.alnum_lower(F.col("text")))):
        counts = D.overlaps(docs.select(F.col("lang").alias("split"), H.sha256(body).alias("key")))
        found.append(counts.select("a", "b", *[(F.col("n") if k == kind else F.lit(0)).alias(k) for k in ("raw", "normalised")]))
    return found[0].unionByName(found[1]).groupBy("a", "b").agg(F.sum("raw").alias("raw"), F.sum("normalised").alias("normalised"))


@Q("d09_union_sources", "SELECT source_id, count(*) AS n, count(lang) AS with_lang FROM (SELECT 'docs' AS source_id, lang FROM documents UNION ALL SELECT 'bench', NULL FROM benchmark) GROUP BY 1")
def d09(spark, sf):
    rows = D.union_sources({"docs": t(spark, sf, "documents").select("text", "lang"), "bench": t(spark, sf, "benchmark").select("text")})
    return rows.groupBy("source_id").agg(F.count("*").alias("n"), F.count("lang").alias("with_lang"))


@Q("d10_distinct_counts", "SELECT count(DISTINCT text) AS texts, count(DISTINCT source) AS sources, count(DISTINCT lang) AS langs FROM documents")
def d10(spark, sf):
    return t(spark, sf, "documents").agg(F.count_distinct(H.sha256(F.col("text"))).alias("texts"), F.count_distinct("source").alias("sources"), F.count_distinct("lang").alias("langs"))


# 2.7 aggregations


@Q("a01_grouped_counters", "SELECT lang, source, count(*) AS n_rows, sum(length(text))::BIGINT AS chars, sum(octet_length(encode(text)))::BIGINT AS bytes FROM documents GROUP BY ALL")
def a01(spark, sf):
    return t(spark, sf, "documents").groupBy("lang", "source").agg(F.count("*").alias("n_rows"), F.sum(F.length("text")).alias("chars"), F.sum(F.octet_length("text")).alias("bytes"))


@Q("a03_levels", """
SELECT CASE WHEN GROUPING(lang) = 0 AND GROUPING(source) = 0 THEN 'lang+source' WHEN GROUPING(lang) = 0 THEN 'lang' WHEN GROUPING(source) = 0 THEN 'source' ELSE '' END AS level,
  lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY GROUPING SETS ((lang, source), (lang), (source), ())""")
def a03(spark, sf):
    rows = P.levels(t(spark, sf, "documents"), [["lang", "source"], ["lang"], ["source"], []], [F.count("*").alias("n"), F.sum("n_chars").alias("chars")])
    return rows.select("level", "lang", "source", "n", "chars")


@Q("a04_cross_source_groups", "SELECT sha256(text) AS h, count(DISTINCT source) AS n_values FROM documents GROUP BY text HAVING count(DISTINCT source) > 1")
def a04(spark, sf):
    return P.many_valued(t(spark, sf, "documents").select(H.sha256(F.col("text")).alias("h"), "source"), "h", "source")


@Q("a05_examples", f"WITH {_PAT}, {_HITS} SELECT reason, source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY reason, source ORDER BY doc_id) AS k FROM (SELECT DISTINCT reason, source, h.doc_id FROM hits h JOIN docs USING (doc_id))) WHERE k <= 2")
def a05(spark, sf):
    events = C.ledger(t(spark, sf, "documents"), t(spark, sf, "benchmark"), ["source"])
    return C.examples(events, ["reason", "source"], "doc_id", 2).select("reason", "source", "doc_id")


@Q("a06_describe", """
SELECT count(*) AS count, sum(n)::BIGINT AS sum, min(n) AS min, max(n) AS max, avg(n) AS mean, quantile_disc(n, 0.5) AS p50, quantile_disc(n, 0.9) AS p90, quantile_disc(n, 0.95) AS p95, quantile_disc(n, 0.99) AS p99
FROM (SELECT length(text) AS n FROM documents)""")
def a06(spark, sf):
    return P.describe(t(spark, sf, "documents").select(F.length("text").cast("long").alias("n")), "n")


@Q("a07_percentiles", """
WITH v AS (SELECT length(text) AS n, row_number() OVER (ORDER BY length(text)) - 1 AS i, count(*) OVER () AS c FROM documents)
SELECT max(n) FILTER (i = greatest(CAST(ceil(c * 0.95) AS BIGINT) - 1, 0)) AS ceil_rank, max(n) FILTER (i = least(CAST(floor(c * 0.95) AS BIGINT), c - 1)) AS floor_index,
  max(n) FILTER (i = CAST(round_even((c - 1) * 0.95, 0) AS BIGINT)) AS bankers_index, quantile_cont(n, 0.95) AS linear, max(n) FILTER (i = CAST(ceil((c - 1) * 0.95) AS BIGINT)) AS higher FROM v""")
def a07(spark, sf):
    return P.percentile_variants(t(spark, sf, "documents").select(F.length("text").cast("long").alias("n")), "n", 0.95)


@Q("a08_length_summary", "SELECT min(n) AS min, max(n) AS max, avg(n) AS mean, avg((n > 766)::INT) AS truncated, avg(greatest(766 - n, 0)) AS padding, quantile_disc(n, 0.5) AS p50, quantile_disc(n, 0.95) AS p95 FROM (SELECT length(text) AS n FROM documents)")
def a08(spark, sf):
    return P.length_summary(t(spark, sf, "documents").select(F.length("text").cast("long").alias("n")), "n", LEN)


@Q("a09_token_accounting", """
SELECT lang, count(*) AS n_rows, sum(n)::BIGINT AS raw_tokens, sum(least(n, 766))::BIGINT AS kept_tokens, sum(least(n, 766) + 1)::BIGINT AS loss_tokens, sum(least(n, 766) + 2)::BIGINT AS nonpad_tokens,
  count(*) * 768 AS padded_slots, sum((n > 766)::INT)::BIGINT AS truncated_rows, sum(n - least(n, 766))::BIGINT AS discarded_tokens FROM (SELECT lang, length(text) AS n FROM documents) GROUP BY lang""")
def a09(spark, sf):
    return P.token_accounting(t(spark, sf, "documents").select("lang", F.length("text").cast("long").alias("n")), "n", LEN + 2, ["lang"])


@Q("a10_recount", """
SELECT L AS sequence_length, sum(least(n, L - 2) + 1)::BIGINT AS loss_tokens, sum((n > L - 2)::INT)::BIGINT AS truncated_rows, (count(*) * L)::BIGINT AS padded_slots
FROM (SELECT length(text) AS n FROM documents), (SELECT unnest([256, 512, 768, 1024]) AS L) GROUP BY L""")
def a10(spark, sf):
    hist = P.histogram(t(spark, sf, "documents").select(F.length("text").cast("long").alias("tokens")), "tokens")
    return P.recount(hist, "tokens", [256, 512, 768, 1024])


@Q("a11_top_tokens", "SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM documents) GROUP BY token ORDER BY n DESC, token LIMIT 30")
def a11(spark, sf):
    return P.top_tokens(t(spark, sf, "documents"), F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)), 30)


@Q("a12_scripts", rf"""
SELECT lang, sum(c)::BIGINT AS cjk_chars, sum(l)::BIGINT AS latin_chars, sum(d)::BIGINT AS digit_chars, sum(n - c - l - d)::BIGINT AS other_chars, sum((c > 0)::INT)::BIGINT AS rows_with_cjk, sum((l > 0)::INT)::BIGINT AS rows_with_latin, sum((c > 0 AND l > 0)::INT)::BIGINT AS rows_with_both
FROM (SELECT lang, length(x) AS n, length(regexp_replace(x, '[^\x{{3400}}-\x{{4DBF}}\x{{4E00}}-\x{{9FFF}}\x{{F900}}-\x{{FAFF}}]', '', 'g')) AS c, length(regexp_replace(x, '[^a-z]', '', 'g')) AS l, length(regexp_replace(x, '[^\p{{Nd}}]', '', 'g')) AS d
  FROM (SELECT lang, {N1.format("text")} AS x FROM documents)) GROUP BY lang""")
def a12(spark, sf):
    return P.scripts(t(spark, sf, "documents"), "text", ["lang"])


@Q("a15_capacity", """
WITH w(bucket, weight) AS (VALUES ('en', 0.5), ('de', 0.3), ('fr', 0.15), ('zz', 0.05)), h AS (SELECT lang AS bucket, sum(n_chars)::BIGINT AS a FROM documents GROUP BY lang),
x AS (SELECT bucket, CAST(round_even(1000000 * weight, 0) AS BIGINT) AS target, coalesce(a, 0) AS available FROM w LEFT JOIN h USING (bucket))
SELECT bucket, target, available, available / target AS ratio, greatest(0, target - available) AS shortfall FROM x""")
def a15(spark, sf):
    weights = spark.createDataFrame([("en", 0.5), ("de", 0.3), ("fr", 0.15), ("zz", 0.05)], "bucket string, weight double")
    return P.capacity(t(spark, sf, "documents").select(F.col("lang").alias("bucket"), F.col("n_chars").alias("tokens")), weights, 1_000_000)


@Q("a16_rates", "SELECT lang, count(*) AS n, avg(quality) AS good, avg(toxic) AS toxic FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def a16(spark, sf):
    rows = t(spark, sf, "labels").join(t(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return M.rates(rows, ["lang"], {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1})


@Q("a17_ratio_of_sums", "SELECT lang, sum(quality) / greatest(1, sum(quality + toxic)) AS share FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def a17(spark, sf):
    rows = t(spark, sf, "labels").join(t(spark, sf, "documents").select("doc_id", "lang"), "doc_id").withColumn("both", F.col("quality") + F.col("toxic"))
    return M.ratio_of_sums(rows, ["lang"], "quality", "both", "share")


@Q("a18_weighted_nll", "SELECT event_type, round(sum(value * user_id) / sum(user_id), 6) AS nll, sum(user_id)::BIGINT AS tokens FROM events GROUP BY event_type")
def a18(spark, sf):
    return M.weighted_nll(t(spark, sf, "events"), ["event_type"], "value", "user_id").select("event_type", F.round("nll", 6).alias("nll"), "tokens")


@Q("a19_macro", "SELECT source, avg(coalesce(CASE WHEN lang = 'en' THEN m END, m / 2)) AS macro, count(*) AS tasks FROM (SELECT source, lang, avg(quality) AS m FROM labels JOIN documents USING (doc_id) GROUP BY ALL) GROUP BY source")
def a19(spark, sf):
    rows = t(spark, sf, "labels").join(t(spark, sf, "documents").select("doc_id", "lang", "source"), "doc_id").groupBy("source", "lang").agg(F.avg("quality").alias("m"))
    return M.macro(rows.withColumn("acc_norm", F.when(F.col("lang") == "en", F.col("m"))).withColumn("acc", F.col("m") / 2), ["source"], "acc_norm", "acc")


@Q("a20_paired_bootstrap")
def a20(spark, sf):
    rows = t(spark, sf, "labels").join(t(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return M.paired_bootstrap(rows.select("lang", F.col("quality").alias("left"), F.col("toxic").alias("right")), "lang")


@Q("a21_cluster_bootstrap")
def a21(spark, sf):
    rows = t(spark, sf, "labels").join(t(spark, sf, "documents").select("doc_id", "lang", "source"), "doc_id").withColumn("one", F.lit(1))
    return M.cluster_bootstrap(rows, "lang", "source", "quality", "one")


@Q("a22_stratified_bootstrap")
def a22(spark, sf):
    rows = t(spark, sf, "labels").join(t(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return M.stratified_bootstrap(rows.select("lang", F.col("quality").alias("left"), F.col("toxic").alias("right")), "lang")


@Q("a23_pearson", "SELECT event_type, round(corr(value, user_id), 9) AS r, count(*) AS n FROM events GROUP BY event_type")
def a23(spark, sf):
    return M.pearson(t(spark, sf, "events"), "value", "user_id", ["event_type"]).select("event_type", F.round("r", 9).alias("r"), "n")


@Q("a24_conditional_means", "SELECT event_type, round(avg(value) FILTER (user_id > 25), 9) AS high, round(avg(value) FILTER (user_id <= 25), 9) AS low FROM events GROUP BY event_type")
def a24(spark, sf):
    rows = M.conditional_means(t(spark, sf, "events"), "value", {"high": F.col("user_id") > 25, "low": F.col("user_id") <= 25}, ["event_type"])
    return rows.select("event_type", F.round("high", 9).alias("high"), F.round("low", 9).alias("low"))


@Q("a25_collapse", "SELECT source, max(n) / sum(n) AS top_share, max(n) / sum(n) > 0.6 AS collapsed FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) GROUP BY source")
def a25(spark, sf):
    return M.collapse(t(spark, sf, "documents"), ["source"], "lang", 0.6)


@Q("a26_throughput", "SELECT event_type, round(avg(value), 9) AS mean, round(stddev_samp(value), 9) AS stdev, round(avg(value) FILTER (k <= 100), 9) AS last_mean FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS k FROM events) GROUP BY event_type")
def a26(spark, sf):
    rows = M.throughput(t(spark, sf, "events"), "event_type", "event_id", "value")
    return rows.select("event_type", *[F.round(c, 9).alias(c) for c in ("mean", "stdev", "last_mean")])


@Q("a26_rolling_mean", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 99 PRECEDING), 9) AS rolling_mean FROM events")
def a26b(spark, sf):
    return M.rolling_mean(t(spark, sf, "events"), "user_id", ["ts", "event_id"], "value", 100).select("event_id", F.round("rolling_mean", 9).alias("rolling_mean"))


@Q("a27_median_ratios", """
WITH m AS (SELECT user_id % 5 AS scenario, median(value) FILTER (event_type = 'view') AS median_view, median(value) FILTER (event_type = 'click') AS median_click FROM events GROUP BY 1)
SELECT scenario, median_view, median_click, median_view / median_click AS ratio_click FROM m""")
def a27(spark, sf):
    return M.median_ratios(t(spark, sf, "events").withColumn("scenario", F.col("user_id") % 5), "scenario", "event_type", "value", ["view", "click"])


@Q("a28_generation_stats", "SELECT lang, count(*) AS n, count(*) FILTER (length(text) > 0) AS nonempty, avg(length(text)) AS mean_chars, count(DISTINCT doc_id) = count(*) AS ids_unique FROM documents GROUP BY lang")
def a28(spark, sf):
    rows = t(spark, sf, "documents").groupBy("lang")
    return rows.agg(F.count("*").alias("n"), F.sum((F.length("text") > 0).cast("long")).alias("nonempty"), F.avg(F.length("text")).alias("mean_chars"), (F.count_distinct("doc_id") == F.count("*")).alias("ids_unique"))


@Q("a29_gates", """
WITH r AS (SELECT count(*) AS n, count(DISTINCT doc_id) AS d, count(*) FILTER (text IS NULL) AS missing FROM documents)
SELECT unnest(['rows', 'unique_ids', 'no_missing', 'all']) AS gate, unnest([n > 0, n = d, missing = 0, n > 0 AND n = d AND missing = 0]) AS passed FROM r""")
def a29(spark, sf):
    row = t(spark, sf, "documents").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("d"), F.sum(F.col("text").isNull().cast("long")).alias("missing"))
    return M.gates(row, {"rows": F.col("n") > 0, "unique_ids": F.col("n") == F.col("d"), "no_missing": F.col("missing") == 0})


@Q("a30_balance", "SELECT count(*) AS n_values, (5 - count(*))::BIGINT AS missing, max(n) - min(n) AS gap, max(n) - min(n) <= 100 AND count(*) = 5 AS balanced FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def a30(spark, sf):
    return M.balance(t(spark, sf, "events"), "event_type", ["view", "click", "signup", "error", "purchase"], 100)


@Q("a32_training_halves", """
WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, arg_max(value, event_id) AS last, max(value) AS max, round(avg(value) FILTER (k <= n // 2), 9) AS first_half, round(avg(value) FILTER (k > n // 2), 9) AS second_half FROM e GROUP BY user_id""")
def a32(spark, sf):
    return M.halves(t(spark, sf, "events"), "user_id", "event_id", "value").withColumn("first_half", F.round("first_half", 9)).withColumn("second_half", F.round("second_half", 9))


@Q("a33_fingerprint", "SELECT sha256(string_agg(x, chr(10) ORDER BY x)) AS fingerprint FROM (SELECT n_nationkey || chr(1) || n_name AS x FROM nation)")
def a33(spark, sf):
    return P.fingerprint(t(spark, sf, "nation"), ["n_nationkey", "n_name"])


# 2.8 order, quotas, splits


@Q("w02_exact_quota", """
WITH r AS (SELECT doc_id, n, sum(n) OVER (ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) - n AS start FROM (SELECT doc_id, length(text) AS n, sha256('q:' || doc_id) AS h FROM documents))
SELECT doc_id, CAST(least(n, 400000 - start) AS BIGINT) AS taken FROM r WHERE start < 400000 AND n > 0""")
def w02(spark, sf):
    rows = t(spark, sf, "documents").select("doc_id", F.length("text").cast("long").alias("n"), H.sha256(F.concat(F.lit("q:"), F.col("doc_id").cast("string"))).alias("h"))
    return W.quota_prefix(rows, ["h", "doc_id"], "n", 400_000).select("doc_id", "taken")


@Q("w03_filtered_quota", f"""
WITH {_PAT}, {_HITS}, ok AS (SELECT doc_id, length(text) AS n, sha256('q:' || doc_id) AS h FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM hits)),
r AS (SELECT doc_id, n, sum(n) OVER (ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) - n AS start FROM ok)
SELECT doc_id, CAST(least(n, 300000 - start) AS BIGINT) AS taken FROM r WHERE start < 300000 AND n > 0""")
def w03(spark, sf):
    docs = t(spark, sf, "documents")
    bad = C.ledger(docs, t(spark, sf, "benchmark"), []).select("doc_id").distinct()
    rows = docs.join(bad, "doc_id", "left_anti").select("doc_id", F.length("text").cast("long").alias("n"), H.sha256(F.concat(F.lit("q:"), F.col("doc_id").cast("string"))).alias("h"))
    return W.quota_prefix(rows, ["h", "doc_id"], "n", 300_000).select("doc_id", "taken")


@Q("w04_bucket_quota", """
SELECT doc_id FROM (SELECT doc_id, coalesce(sum(n_chars) OVER (PARTITION BY lang ORDER BY sha256('b:' || doc_id) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, lang FROM documents)
WHERE before < CASE WHEN lang = 'en' THEN 100000 ELSE 20000 END""")
def w04(spark, sf):
    rows = t(spark, sf, "documents").withColumn("h", H.sha256(F.concat(F.lit("b:"), F.col("doc_id").cast("string"))))
    return W.grouped_quota(rows, ["lang"], ["h"], "n_chars", F.when(F.col("lang") == "en", 100_000).otherwise(20_000)).select("doc_id")


_SHARES = "s AS (SELECT lang AS name, count(*) AS weight FROM documents GROUP BY lang)"


@Q("w05_largest_remainder", f"""
WITH {_SHARES}, r AS (SELECT name, 1000003.0::DOUBLE * (weight / sum(weight) OVER ()) AS raw FROM s), f AS (SELECT name, raw - floor(raw) AS frac, floor(raw)::BIGINT AS fl FROM r)
SELECT name, fl + (row_number() OVER (ORDER BY frac DESC, name DESC) <= 1000003 - sum(fl) OVER ())::BIGINT AS quota FROM f""")
def w05(spark, sf):
    weights = t(spark, sf, "documents").groupBy(F.col("lang").alias("name")).agg(F.count("*").alias("weight"))
    return W.allocate(weights, 1_000_003).select("name", "quota")


@Q("w06_last_takes_rest", """
WITH w(name, position, weight) AS (VALUES ('a', 1, 0.333), ('b', 2, 0.333), ('c', 3, 0.334)), q AS (SELECT *, floor(1001 * weight)::BIGINT AS f FROM w)
SELECT name, CASE WHEN position = 3 THEN 1001 - (SELECT sum(f) FROM q WHERE position < 3)::BIGINT ELSE f END AS quota FROM q""")
def w06(spark, sf):
    return W.last_takes_rest(spark.createDataFrame([("a", 1, 0.333), ("b", 2, 0.333), ("c", 3, 0.334)], "name string, position int, weight double"), 1001).select("name", "quota")


@Q("w07_bottom_k", "SELECT lang, doc_id, score FROM (SELECT lang, doc_id, substr(sha256('k:' || doc_id), 1, 16) AS score, row_number() OVER (PARTITION BY lang ORDER BY substr(sha256('k:' || doc_id), 1, 16)) AS k FROM documents) WHERE k <= 10")
def w07(spark, sf):
    score = F.substring(H.sha256(F.concat(F.lit("k:"), F.col("doc_id").cast("string"))), 1, 16)
    return W.bottom_k(t(spark, sf, "documents"), ["lang"], score, 10).select("lang", "doc_id", "score")


@Q("w09_hash_order_split", """
SELECT doc_id, CASE WHEN k <= 50 THEN 'validation' WHEN k <= 100 THEN 'test' ELSE 'train' END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY sha256('42:' || doc_id)) AS k FROM documents)""")
def w09(spark, sf):
    order = H.sha256(F.concat(F.lit("42:"), F.col("doc_id").cast("string")))
    return W.hash_order_split(t(spark, sf, "documents").select("doc_id"), order, [("validation", 50), ("test", 50)], "train").select("doc_id", "split")


@Q("w09_prompt_split", "SELECT doc_id, CASE WHEN b < 200 THEN 'validation' WHEN b < 400 THEN 'test' ELSE 'train' END AS split FROM (SELECT doc_id, ('0x' || substr(sha256(text), 1, 8))::BIGINT % 10000 AS b FROM documents)")
def w09b(spark, sf):
    return t(spark, sf, "documents").select("doc_id", H.prompt_split(H.sha256(F.col("text"))).alias("split"))


@Q("w11_candidate_window", """
SELECT doc_id FROM (SELECT doc_id, source, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents) WHERE before < 11500""")
def w11(spark, sf):
    return W.grouped_quota(t(spark, sf, "documents"), ["source"], ["doc_id"], "n_chars", F.lit(11_500)).select("doc_id")


@Q("w13_token_windows", """
SELECT doc_id, (e - n) // 2048 AS first_window, (e - 1) // 2048 AS last_window FROM (SELECT doc_id, length(text) AS n, sum(length(text)) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS e FROM documents)""")
def w13(spark, sf):
    rows = t(spark, sf, "documents").select("doc_id", F.length("text").cast("long").alias("n"))
    return W.token_windows(rows, ["doc_id"], "n", 2048).select("doc_id", "first_window", "last_window")


@Q("w14_stratified_batches", "SELECT doc_id, CAST((row_number() OVER (PARTITION BY lang ORDER BY sha256('s:' || doc_id)) - 1) // 4 AS INTEGER) AS batch FROM documents")
def w14(spark, sf):
    order = H.sha256(F.concat(F.lit("s:"), F.col("doc_id").cast("string")))
    return W.stratified_batches(t(spark, sf, "documents").select("doc_id", "lang"), "lang", order, 4).select("doc_id", "batch")


@Q("w17_keep_earliest", """
WITH d AS (SELECT doc_id, text, CASE WHEN doc_id % 10 = 0 THEN 0 WHEN doc_id % 10 = 1 THEN 1 ELSE 2 END AS r FROM documents)
SELECT doc_id FROM (SELECT *, min(r) OVER (PARTITION BY text) AS m FROM d) WHERE r = m""")
def w17(spark, sf):
    rank = F.when(F.col("doc_id") % 10 == 0, 0).when(F.col("doc_id") % 10 == 1, 1).otherwise(2)
    return W.keep_earliest(t(spark, sf, "documents").select("doc_id", H.sha256(F.col("text")).alias("h")), "h", rank).select("doc_id")


@Q("w18_top_by_key", "SELECT source, arg_min(doc_id, sha256('t:' || doc_id)) AS doc_id FROM documents GROUP BY source")
def w18(spark, sf):
    return t(spark, sf, "documents").groupBy("source").agg(F.min_by("doc_id", H.sha256(F.concat(F.lit("t:"), F.col("doc_id").cast("string")))).alias("doc_id"))


@Q("w19_group_advantage", "SELECT event_id, round((value - avg(value) OVER (PARTITION BY user_id)) / (stddev_pop(value) OVER (PARTITION BY user_id) + 1e-4), 6) AS advantage FROM events")
def w19(spark, sf):
    return W.group_advantage(t(spark, sf, "events"), "user_id", "value").select("event_id", F.round("advantage", 6).alias("advantage"))


# 2.9 scalar functions


@Q("x01_normalisers", r"""
SELECT doc_id, md5(regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g')) AS n1, md5(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS n2, md5(regexp_replace(lower(text), '[^0-9a-z]', '', 'g')) AS n3 FROM documents""")
def x01(spark, sf):
    h = lambda c: F.md5(c.cast("binary"))
    return t(spark, sf, "documents").select("doc_id", h(T.alnum_lower(F.col("text"))).alias("n1"), h(T.ws_lower(F.col("text"))).alias("n2"), h(T.ascii_alnum(F.col("text"))).alias("n3"))


@Q("x02_prompts", "SELECT conv_id, md5(string_agg(text, chr(10) ORDER BY turn)) AS m FROM conversations WHERE role = 'user' GROUP BY conv_id")
def x02(spark, sf):
    rows = V.nest(t(spark, sf, "conversations")).select("conv_id", V.prompt(F.col("messages")).alias("p")).where("p != ''")
    return rows.select("conv_id", F.md5(F.col("p").cast("binary")).alias("m"))


@Q("x07_hash_family", "SELECT doc_id, sha256(unhex('0000000000000003') || encode('abc') || unhex(printf('%016x', octet_length(encode(lang)))) || encode(lang)) AS framed, ('0x' || substr(sha256(lang), 1, 8))::BIGINT % 10000 AS b FROM documents")
def x07(spark, sf):
    return t(spark, sf, "documents").select("doc_id", H.stable_sha256(F.lit("abc"), F.col("lang")).alias("framed"), H.bucket(H.sha256(F.col("lang")), 10000).alias("b"))


@Q("x07_full_digest_mod5", "SELECT doc_id, CAST(list_sum(list_transform(string_split(sha256(CAST(doc_id AS VARCHAR)), ''), lambda c: ('0x' || c)::INT)) % 5 AS INTEGER) AS m FROM documents")
def x07b(spark, sf):
    return t(spark, sf, "documents").select("doc_id", H.full_mod5(H.sha256(F.col("doc_id").cast("string"))).cast("int").alias("m"))


@Q("x09_counters", r"""
SELECT doc_id, len(regexp_extract_all(text, '(?m)^[ \t]*(?:[0-9]+[.)]|[-*+])[ \t]+[^\s]')) AS items, len(list_filter(regexp_split_to_array(trim(text), '\n\s*\n+'), lambda s: trim(s) != '')) AS paragraphs,
  len(list_filter(string_split(regexp_replace(trim(text), '([.!?])(?:\s+|$)', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) != '')) AS sentences FROM documents""")
def x09(spark, sf):
    c = F.col("text")
    return t(spark, sf, "documents").select("doc_id", T.list_items(c).cast("long").alias("items"), T.paragraph_count(c).cast("long").alias("paragraphs"), T.sentence_count(c).cast("long").alias("sentences"))


@Q("x10_stopword_language", r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[A-Za-z\x{00C0}-\x{00FF}]+') AS k FROM documents),
s AS (SELECT doc_id, len(k) AS n, len(list_filter(k, lambda x: x IN ('the','and','of','to','in','is','that','for','with','as','on','are','this','be','by','an','it'))) AS en,
  len(list_filter(k, lambda x: x IN ('der','die','das','den','dem','des','und','ist','in','zu','mit','für','von','auf','ein','eine'))) AS de FROM w)
SELECT doc_id, en, de, n FROM s""")
def x10(spark, sf):
    scores = T.stopword_scores(F.col("text"))
    n = F.size(F.regexp_extract_all(F.lower("text"), F.lit(r"[A-Za-z\x{00C0}-\x{00FF}]+"), F.lit(0)))
    return t(spark, sf, "documents").select("doc_id", scores["english"].cast("long").alias("en"), scores["german"].cast("long").alias("de"), n.cast("long").alias("n"))


@Q("x11_domain", r"""
SELECT domain, count(*) AS n FROM (SELECT CASE WHEN contains(lower(text), 'license') THEN 'legal' WHEN contains(lower(text), 'token') THEN 'code'
  WHEN length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / greatest(length(regexp_replace(text, '[\s]', '', 'g')), 1) >= 0.55 THEN 'english' END AS domain FROM documents) GROUP BY domain""")
def x11(spark, sf):
    kind = T.domain_class(F.col("text"), [("legal", ["license"]), ("code", ["token"])])
    return t(spark, sf, "documents").groupBy(kind.alias("domain")).agg(F.count("*").alias("n"))


@Q("x12_repetition", """
SELECT conv_id, turn, round(CASE WHEN length(text) >= 4 THEN 1 - len(list_distinct(list_transform(range(1, length(text) - 2), lambda i: substr(text, CAST(i AS BIGINT), 4)))) / (length(text) - 3) ELSE 0 END, 9) AS ratio FROM conversations""")
def x12(spark, sf):
    return t(spark, sf, "conversations").select("conv_id", "turn", F.round(T.repetition_ratio(F.col("text")), 9).alias("ratio"))


@Q("x13_rep_penalty", r"""
WITH k AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]') AS w FROM conversations),
g AS (SELECT conv_id, turn, len(w) - 2 AS c, len(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i : i + 2]))) AS d FROM k)
SELECT conv_id, turn, round(CASE WHEN c > 0 THEN least(0.5, (c - d) * 1.0 / c) ELSE 0 END, 9) AS penalty FROM g""")
def x13(spark, sf):
    return t(spark, sf, "conversations").select("conv_id", "turn", F.round(T.rep_penalty(F.col("text")), 9).alias("penalty"))


@Q("x14_tags", r"""
SELECT event_id, len(regexp_extract_all(s, '<tool_call>')) AS calls, trim(regexp_replace(s, '^\s*<think>[^<]*</think>\s*', '')) AS plain FROM (
  SELECT event_id, '<think>' || event_type || '</think> answer ' || user_id || ' <tool_call>{"name": "' || event_type || '"}</tool_call>' AS s FROM events WHERE event_type = 'click')""")
def x14(spark, sf):
    s = F.concat(F.lit("<think>"), "event_type", F.lit("</think> answer "), F.col("user_id").cast("string"), F.lit(' <tool_call>{"name": "'), "event_type", F.lit('"}</tool_call>'))
    rows = t(spark, sf, "events").where("event_type = 'click'").select("event_id", s.alias("s"))
    return rows.select("event_id", T.valid_tool_calls(F.col("s")).cast("long").alias("calls"), T.strip_thinking(F.col("s")).alias("plain"))


@Q("x15_choice", "SELECT event_id, CASE user_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN NULL ELSE 'D' END AS choice FROM events")
def x15(spark, sf):
    said = F.element_at(F.array(*[F.lit(x) for x in ("The answer is A.", "B", "A or B", "(D)")]), (F.col("user_id") % 4 + 1).cast("int"))
    return t(spark, sf, "events").select("event_id", T.parse_choice(said).alias("choice"))


@Q("x21_preference_credit", "SELECT event_id, CASE WHEN value - 5 > 1e-7 THEN 1.0 WHEN value - 5 < -1e-7 THEN 0.0 ELSE 0.5 END::DOUBLE AS credit FROM events")
def x21(spark, sf):
    return t(spark, sf, "events").select("event_id", M.preference_credit(F.col("value") - 5).alias("credit"))


@Q("x22_percent", "SELECT event_id, CASE WHEN abs(value) <= 1 THEN value * 100 ELSE value END AS percent FROM events")
def x22(spark, sf):
    return t(spark, sf, "events").select("event_id", T.as_percent(F.col("value")).alias("percent"))


@Q("x25_safe_names", "SELECT page_id, regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g') AS name FROM pages")
def x25(spark, sf):
    return t(spark, sf, "pages").select("page_id", T.safe_name(F.col("url")).alias("name"))


# 2.10 generators, 2.11 audit


@Q("g02_mod10_tasks", """
WITH p AS (SELECT op, a, b, ((CASE op WHEN 'add' THEN a + b WHEN 'sub' THEN a - b ELSE a * b END) % 10 + 10) % 10 AS answer FROM (SELECT unnest(['add', 'sub', 'mul']) AS op), range(100) x(a), range(100) y(b))
SELECT op, a, b, CAST(answer AS BIGINT) AS answer FROM (SELECT *, row_number() OVER (PARTITION BY op, answer ORDER BY sha256('g:' || op || ':' || a || ':' || b)) AS k FROM p) WHERE k <= 20""")
def g02(spark, sf):
    from millrace.operators.generate import mod10_tasks

    return mod10_tasks(spark, 100, 20, "g:")


@Q("o05_corpus_audit", f"""
WITH {_PAT}, {_HITS}
SELECT count(*) AS n_rows, count(DISTINCT d.text) AS n_distinct, sum(least(length(d.text), 766) + 1)::BIGINT AS loss_tokens, (SELECT count(DISTINCT doc_id) FROM hits WHERE reason = 'exact') AS exact_docs, (SELECT count(DISTINCT doc_id) FROM hits WHERE reason = 'containment') AS contained_docs FROM documents d""")
def o05(spark, sf):
    from millrace.plans.corpus import audit

    return audit(t(spark, sf, "documents"), t(spark, sf, "benchmark"), LEN + 2).select("n_rows", "n_distinct", "loss_tokens", "exact_docs", "contained_docs")


@Q("o02_mix")
def o02(spark, sf):
    from millrace.plans.corpus import mix

    docs = t(spark, sf, "documents").withColumn("source", F.col("lang"))
    tenth = (docs.agg(F.sum(F.length("text"))).first()[0] or 0) // 10
    return mix(docs, {"en": 0.6, "de": 0.2, "fr": 0.2}, tenth, tenth // 10, 4).select("doc_id", "split", "source", "taken", "shard")


@Q("o04_remix")
def o04(spark, sf):
    from millrace.plans.remix import remix

    docs = t(spark, sf, "documents").withColumn("source", F.col("lang"))
    tenth = (docs.agg(F.sum(F.length("text") + 1)).first()[0] or 0) // 10
    return remix(docs, {"en": 0.6, "de": 0.2, "fr": 0.2}, tenth, t(spark, sf, "benchmark")).select("doc_id", "source", "targets", "piece", F.md5(F.col("text").cast("binary")).alias("digest"))


@Q("s_events_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def events_tumbling(spark, sf):
    from millrace.streaming.windows import tumbling

    return tumbling(t(spark, sf, "events"), "1 hour").select("start", "event_type", "n", F.round("total", 6).alias("total"))


@Q("s_star_revenue", """
SELECT n_name, l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
GROUP BY GROUPING SETS ((n_name, l_returnflag), (n_name), ())""")
def star(spark, sf):
    line = t(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    orders = t(spark, sf, "orders").select("o_orderkey", "o_custkey")
    customer = t(spark, sf, "customer").select("c_custkey", "c_nationkey")
    rows = line.join(orders, line["l_orderkey"] == orders["o_orderkey"]).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return P.levels(rows, [["n_name", "l_returnflag"], ["n_name"], []], [F.round(F.sum("r"), 2).alias("revenue"), F.count("*").alias("n")]).select("n_name", "l_returnflag", "revenue", "n")


# more of 2.3, 2.4, 2.5, 2.6 and 2.9

_PROMPTS = r"p AS (SELECT conv_id AS key, trim(regexp_replace(lower(string_agg(text, chr(10) ORDER BY turn)), '\s+', ' ', 'g')) AS prompt FROM conversations WHERE role = 'user' GROUP BY conv_id)"


def _prompts(spark, sf):
    rows = V.nest(t(spark, sf, "conversations")).select(F.col("conv_id").alias("key"), T.ws_lower(V.prompt(F.col("messages"))).alias("prompt"))
    return rows.where("prompt != ''")


def _items(spark, sf):
    """Benchmark items and, as a test of the joins, the first words of some prompts."""
    items = t(spark, sf, "benchmark").select("item_id", T.ws_lower(F.col("text")).alias("prompt"))
    some = _prompts(spark, sf).where("key % 3 = 0").select((F.col("key") + 10_000).alias("item_id"), F.when(F.col("key") % 2 == 0, F.col("prompt")).otherwise(F.substring("prompt", 1, 60)).alias("prompt"))
    return items.unionByName(some)


_ITEMS = r"""i AS (SELECT item_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS prompt FROM benchmark
  UNION ALL SELECT key + 10000, CASE WHEN key % 2 = 0 THEN prompt ELSE substr(prompt, 1, 60) END FROM p WHERE key % 3 = 0)"""


@Q("j01_prompt_overlap", f"WITH {_PROMPTS}, {_ITEMS} SELECT key, item_id FROM p JOIN i USING (prompt)")
def j01(spark, sf):
    return C.prompt_overlaps(_prompts(spark, sf), _items(spark, sf))


@Q("j04_prompt_containment", f"""
WITH {_PROMPTS}, {_ITEMS} SELECT key, item_id FROM p JOIN i ON p.prompt != i.prompt AND least(length(p.prompt), length(i.prompt)) >= 20 AND (contains(p.prompt, i.prompt) OR contains(i.prompt, p.prompt))""")
def j04(spark, sf):
    return C.prompt_containment(_prompts(spark, sf), _items(spark, sf))


@Q("j10_eval_guard")
def j10(spark, sf):
    return C.guard(_prompts(spark, sf), _items(spark, sf))


@Q("j19_seen_prompts", f"""
WITH {_PROMPTS}, s AS (SELECT key, prompt, ('0x' || substr(sha256('split:' || key), 1, 8))::BIGINT % 10 = 0 AS earlier FROM p)
SELECT key FROM s WHERE NOT earlier AND NOT EXISTS (SELECT 1 FROM s b WHERE b.earlier AND b.prompt = s.prompt)""")
def j19(spark, sf):
    """Against a tenth by hash, which grows with the table."""
    rows = _prompts(spark, sf)
    earlier = H.bucket(H.sha256(F.concat(F.lit("split:"), F.col("key").cast("string"))), 10) == 0
    return C.reject_seen_prompts(rows.where(~earlier), rows.where(earlier)).select("key")


@Q("j07_self_simhash_pairs")
def j07_pairs(spark, sf):
    rows = V.nest(t(spark, sf, "conversations")).select(F.col("conv_id").alias("key"), T.folded_words(V.prompt(F.col("messages"))).alias("prompt"))
    validation = H.bucket(H.sha256(F.concat(F.lit("split:"), F.col("key").cast("string"))), 10) == 0
    return C.self_simhash_pairs(rows.withColumn("split", F.when(validation, "validation").otherwise("train")), "split")


@Q("d06_near_components", f"""
WITH RECURSIVE {_NEAR.strip()}, u AS (SELECT a, b FROM near UNION SELECT b, a FROM near), r(n, m) AS (SELECT a, a FROM u UNION SELECT n, b FROM r JOIN u ON m = a)
SELECT n AS node, min(m) AS component FROM r GROUP BY n""")
def d06(spark, sf):
    from millrace.operators.components import components

    return components(C.self_near_pairs(t(spark, sf, "documents")).select("a", "b"))


@Q("p19_shifted_targets", "SELECT vec_id, n - 1 AS targets, n - 1 - least(n - 1, 2) AS supervised FROM (SELECT vec_id, vec_id % 9 + 2 AS n FROM embeddings)")
def p19(spark, sf):
    rows = t(spark, sf, "embeddings").select("vec_id", F.sequence(F.lit(1).cast("long"), F.col("vec_id") % 9 + 2).alias("ids"))
    _, y, mask = V.shifted(F.col("ids"), F.transform("ids", lambda x: (x > 3).cast("int")))
    return rows.select("vec_id", F.size(y).cast("long").alias("targets"), F.aggregate(mask, F.lit(0), lambda a, x: a + x).cast("long").alias("supervised"))


@Q("p21_prompt_response", """
WITH c AS (SELECT conv_id, list(text ORDER BY turn) AS x FROM conversations GROUP BY conv_id), k AS (SELECT conv_id, coalesce(array_to_string(x[1:len(x) - 1], chr(10)), '') AS u, x[len(x)] AS a FROM c)
SELECT conv_id, least(length(u) + length(a) + 1, 512) AS n, greatest(least(length(u) + length(a) + 1, 512) - length(u), 0) AS supervised FROM k""")
def p21(spark, sf):
    """Every conversation: all but its last message are the prompt."""
    rows = V.nest(t(spark, sf, "conversations"))
    before = F.array_join(F.transform(V.without_last(F.col("messages")), lambda m: m["content"]), "\n")
    rows = rows.select("conv_id", before.alias("u"), F.element_at("messages", -1)["content"].alias("a"))
    points = lambda c: F.when(F.col(c) == "", F.array().cast("array<int>")).otherwise(V.code_points(F.col(c)))
    ids, labels = V.prompt_response_labels(points("u"), points("a"), 2, 512)
    return rows.select("conv_id", F.size(ids).cast("long").alias("n"), F.size(F.filter(labels, lambda x: x != -100)).cast("long").alias("supervised"))


@Q("f07_preference_rejections", r"""
WITH c AS (SELECT conv_id, list(text ORDER BY turn) AS x, list(role ORDER BY turn) AS r FROM conversations GROUP BY conv_id),
k AS (SELECT conv_id, x, r, x[len(x)] AS a, CASE WHEN conv_id % 2 = 0 THEN x[len(x)] ELSE x[len(x)] || '!' END AS b,
  array_to_string(list_transform(list_filter(list_zip(r, x), lambda z: z[1] = 'user'), lambda z: z[2]), chr(10)) AS p, list_sum(list_transform(list_zip(r, x), lambda z: length(z[1]) + length(z[2]) + 24)) AS size FROM c)
SELECT conv_id, CASE WHEN a = b THEN 'same_answer' WHEN length(regexp_replace(CASE WHEN r[len(r)] = 'user' THEN p ELSE p END, '[^\p{L}\p{M}\p{N}_]', '', 'g')) < 12 THEN 'short_prompt' WHEN size + 1 > 3000 THEN 'too_long' END AS why FROM k""")
def f07(spark, sf):
    rows = V.nest(t(spark, sf, "conversations"))
    last = F.element_at("messages", -1)
    other = F.concat(V.without_last(F.col("messages")), F.array(F.struct(last["role"].alias("role"), F.when(F.col("conv_id") % 2 == 0, last["content"]).otherwise(F.concat(last["content"], F.lit("!"))).alias("content"))))
    return rows.select("conv_id", V.preference_rejection(F.col("messages"), other, 3000).alias("why"))


@Q("f09_pair_acceptance", """
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN length(text) > 3000 THEN 'too_long' WHEN len(w) > 30 AND len(list_distinct(w)) / len(w) < 0.2 THEN 'repetition' END AS reason
  FROM (SELECT text, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f\\v]+'), lambda x: x != '') AS w FROM documents)) GROUP BY reason""".replace("\\\\", "\\"))
def f09(spark, sf):
    from millrace.operators.filters import first_failure, severe_repetition

    checks = {"too_long": F.length("text") > 3000, "repetition": severe_repetition(F.col("text"))}
    return first_failure(t(spark, sf, "documents"), checks).groupBy("reason").agg(F.count("*").alias("n"))


#: A prompt that says something about every constraint family.
F05_PROMPT = (
    'Write at least 3 sentences and no more than 200 words in exactly 2 paragraphs, in English, all capital letters or in Spanish. Start the second paragraph with the word "the". '
    'Use 2 sections, exactly 3 bullet points, at least 1 placeholders, at least one highlighted sections and at most 4 words in all capital letters. Use keywords such as "the", "and". '
    'Use the word "of" at least 2 times and the letter "e" at least five times. Choose one: "yes", "no". Repeat the question: Is it so? End with "done".'
)


@Q("f05_strict_verdicts")
def f05(spark, sf):
    """Every answer against every constraint family."""
    from millrace.functions.verify import RULES, verify

    rows = t(spark, sf, "conversations").where("role = 'assistant'")
    asked = rows.select("conv_id", "turn", "text", F.lit(F05_PROMPT).alias("prompt"), F.array(*[F.lit(r) for r in sorted(RULES)]).alias("c"))
    return asked.select("conv_id", "turn", verify("prompt", "text", "c").alias("v")).select("conv_id", "turn", "v.passed", F.concat_ws(",", "v.failed").alias("failed"))


@Q("x16_truths", "SELECT event_id, contains('total ' || user_id || ' of ' || event_type, event_type) AS typed, user_id = 7 AS numbered FROM events")
def x16(spark, sf):
    from millrace.functions.verify import truths_in

    answer = F.concat(F.lit("total "), F.col("user_id").cast("string"), F.lit(" of "), "event_type")
    found = t(spark, sf, "events").select("event_id", truths_in(answer, F.array(F.col("event_type"), F.lit("7.0"))).alias("f"))
    return found.select("event_id", F.exists("f", lambda x: x != "7.0").alias("typed"), F.array_contains("f", "7.0").alias("numbered"))


@Q("x18_arithmetic", "SELECT event_id, CAST(user_id * 3 - event_id AS DOUBLE) / 4 AS value FROM events")
def x18(spark, sf):
    from millrace.functions.verify import arithmetic

    e = F.concat(F.lit("("), F.col("user_id").cast("string"), F.lit(" * 3 - "), F.col("event_id").cast("string"), F.lit(") / 4"))
    return t(spark, sf, "events").select("event_id", arithmetic(e).alias("value"))


@Q("x20_response_reward")
def x20(spark, sf):
    from millrace.functions.verify import response_reward

    return t(spark, sf, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.round(response_reward(F.col("text"), F.lit(0.0)), 9).alias("reward"))


@Q("x23_expected_answers", "SELECT op, a, b, CASE op WHEN 'add' THEN a + b WHEN 'sub' THEN a - b ELSE a * b END AS answer FROM (SELECT unnest(['add', 'sub', 'mul']) AS op), range(30) x(a), range(30) y(b)")
def x23(spark, sf):
    from millrace.operators.generate import expected, pool

    return pool(spark, 30).withColumn("answer", expected(F.col("op"), F.col("a"), F.col("b")))


@Q("g01_choice_tasks")
def g01(spark, sf):
    from millrace.operators.generate import choice_tasks

    return choice_tasks(spark, 40, 200, "g01:").withColumn("options", F.concat_ws("|", F.transform("options", lambda x: x.cast("string"))))


@Q("g03_extract_tasks")
def g03(spark, sf):
    from millrace.operators.generate import extract_tasks

    return extract_tasks(spark, 200, "g03:", ["Digit {place} of {digits}?", "In {digits}, which digit stands at place {place}?"])


@Q("g04_format_tasks")
def g04(spark, sf):
    from millrace.operators.generate import format_tasks

    return format_tasks(spark, 200, "g04:")


@Q("p08_translation_pairs", """
WITH d AS (SELECT doc_id, text AS l, lang || ': ' || text AS r FROM documents WHERE text IS NOT NULL AND trim(text) != '')
SELECT doc_id, md5('To B: ' || trim(l)) AS "user", md5(trim(r)) AS assistant FROM d UNION ALL SELECT doc_id, md5('To A: ' || trim(r)), md5(trim(l)) FROM d""")
def p08b(spark, sf):
    """Both directions of a pair of texts for every document."""
    from millrace.operators.reshape import translation_pairs

    rows = t(spark, sf, "documents").where(~T.is_blank(F.col("text"))).select("doc_id", F.trim("text").alias("l"), F.trim(F.concat("lang", F.lit(": "), "text")).alias("r"))
    made = translation_pairs(rows, "l", "r", {"forth": "To B: ", "back": "To A: "})
    return made.select("doc_id", *[F.md5(F.col(c).cast("binary")).alias(c) for c in ("user", "assistant")])


@Q("p04_instruction_pairs", "SELECT item_id, 2 AS n, length('Read this.') + 1 + length(trim(text)) AS chars FROM benchmark")
def p04(spark, sf):
    from millrace.operators.reshape import instruction_pairs

    rows = t(spark, sf, "benchmark").select("item_id", F.lit("Read this.").alias("i"), F.col("text").alias("x"), F.lit("Done.").alias("a"))
    return instruction_pairs(rows, "i", "x", "a").select("item_id", F.size("messages").alias("n"), F.length(F.col("messages")[0]["content"]).cast("long").alias("chars"))


@Q("s_sessions", """
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def sessions(spark, sf):
    from millrace.streaming.windows import sessions as made

    return made(t(spark, sf, "events"), "2 hours")


@Q("o06_conversation_build")
def o06(spark, sf):
    from millrace.plans import conversations as plan

    quota = F.when(F.col("split") == "train", 40_000).otherwise(4_000)
    return plan.select(plan.candidates(t(spark, sf, "conversations"), 4000, 0.9), quota).select("conv_id", "split", "first_turn", "last_turn", "chars")


@Q("o07_conversation_audit")
def o07(spark, sf):
    from millrace.plans import conversations as plan

    return plan.audit(plan.select(plan.candidates(t(spark, sf, "conversations"), 4000), F.lit(2**62)))


@Q("o08_conversation_repair")
def o08(spark, sf):
    from millrace.plans import conversations as plan

    quota = F.when(F.col("split") == "train", 40_000).otherwise(4_000)
    pool = written(plan.candidates(t(spark, sf, "conversations"), 4000))
    return plan.repair(pool, plan.select(pool, quota), _items(spark, sf), quota).select("conv_id", "split", "chars")


# sources and records


@Q("a13_pretrain_source_stats", """
SELECT source, count(*) AS n_rows, count(*) FILTER (text IS NULL OR trim(text) = '') AS empty_rows, sum(coalesce(length(text), 0))::BIGINT AS raw_tokens, sum(least(coalesce(length(text), 0), 766))::BIGINT AS kept_tokens,
  count(*) FILTER (length(text) > 766) AS truncated_rows, avg(CASE WHEN length(text) > 766 THEN 1 ELSE 0 END) AS truncation_rate FROM documents GROUP BY source""")
def a13(spark, sf):
    from millrace.operators.records import pretrain_source_stats

    return pretrain_source_stats(t(spark, sf, "documents"), "source", "text", F.length("text"), LEN + 2)


@Q("a14_conversation_source_stats", """
SELECT CASE WHEN conv_id % 2 = 0 THEN 'even' ELSE 'odd' END AS source, count(*) AS n_rows, sum(n)::BIGINT AS input_tokens, sum(t)::BIGINT AS target_tokens, count(*) FILTER (t = 0) AS zero_target_rows, count(*) FILTER (n > 2000) AS truncated_rows
FROM (SELECT conv_id, sum(length(text)) AS n, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS t FROM conversations GROUP BY conv_id) GROUP BY 1""")
def a14(spark, sf):
    from millrace.operators.records import conversation_source_stats

    return conversation_source_stats(t(spark, sf, "conversations"), F.when(F.col("conv_id") % 2 == 0, "even").otherwise("odd"), 2000)


@Q("a31_behaviour_summary", r"""
WITH a AS (SELECT text, length(text) AS latency, CASE WHEN length(text) >= 4 THEN 1 - len(list_distinct(list_transform(range(1, length(text) - 2), lambda i: substr(text, CAST(i AS BIGINT), 4)))) / (length(text) - 3) ELSE 0 END AS rep FROM conversations WHERE role = 'assistant')
SELECT count(*) AS n, avg((trim(text) = '')::INT) AS empty_rate, avg((regexp_matches(lower(trim(text)), '^(i cannot|i can''t|i''m sorry|i am sorry|as an ai|抱歉|无法)'))::INT) AS refusal_rate, avg((rep > 0.3)::INT) AS repetition_rate,
  quantile_disc(latency, 0.5) AS p50, quantile_disc(latency, 0.95) AS p95 FROM a""")
def a31(spark, sf):
    from millrace.operators.records import behaviour_summary

    return behaviour_summary(t(spark, sf, "conversations").where("role = 'assistant'").withColumn("latency", F.length("text").cast("long")), "text", "latency")


@Q("j13_origin_claims", """
WITH c AS (SELECT doc_id, source, md5(text) AS origin, lang AS variant FROM documents), k AS (SELECT origin, variant, min(source) AS owner FROM c GROUP BY ALL)
SELECT doc_id, source FROM c JOIN k USING (origin, variant) WHERE source = owner""")
def j13(spark, sf):
    from millrace.operators.records import claimed

    rows = t(spark, sf, "documents").select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("origin"), F.col("lang").alias("variant"))
    return claimed(rows, rows.groupBy("origin", "variant").agg(F.min("source").alias("source"))).select("doc_id", "source")


@Q("j16_refetched_rows", """
SELECT item_id AS line, CASE WHEN item_id % 3 = 0 THEN 'changed' ELSE 'found' END AS status, CASE WHEN item_id % 3 != 0 THEN length(text) END AS chars FROM benchmark UNION ALL SELECT -1, 'missing', NULL""")
def j16(spark, sf):
    from millrace.operators.records import refetched

    rows = t(spark, sf, "benchmark").select(F.col("item_id").cast("long").alias("line"), F.col("text").alias("record"))
    said = rows.select("line", H.sha256(F.when(F.col("line") % 3 == 0, F.concat("record", F.lit("!"))).otherwise(F.col("record"))).alias("sha256"))
    said = said.unionByName(spark.createDataFrame([(-1, "")], "line long, sha256 string"))
    return refetched(said, rows).select("line", "status", F.length("record").cast("long").alias("chars"))


@Q("w15_resumed_batches", "SELECT doc_id, (rank - 1) // 16 AS batch FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rank FROM documents) WHERE (rank - 1) // 16 >= 3")
def w15(spark, sf):
    from millrace.operators.records import resumed

    ranked = W.running(t(spark, sf, "documents").select("doc_id"), ["doc_id"])
    return resumed(ranked.select("doc_id", F.floor((F.col("global_rank") - 1) / 16).alias("batch")), 3)


@Q("w08_reservoir", "SELECT doc_id FROM (SELECT doc_id FROM documents ORDER BY sha256('reservoir:' || doc_id) LIMIT 100)")
def w08(spark, sf):
    return W.reservoir(t(spark, sf, "documents").select("doc_id"), 100, F.col("doc_id"), "reservoir")


@Q("x26_record_texts", f"""
WITH {_CONV} SELECT 'conversation' AS kind, conv_id AS id, md5(array_to_string(list_transform(m, lambda x: x.content), chr(10))) AS digest FROM c
UNION ALL SELECT 'qa', item_id, md5(item_id || chr(10) || text) FROM benchmark UNION ALL SELECT 'text', doc_id, md5(text) FROM documents""")
def x26(spark, sf):
    from millrace.operators.records import record_text

    none = F.lit(None).cast("string")
    empty = F.lit(None).cast("array<struct<role:string,content:string>>")
    sides = [
        V.nest(t(spark, sf, "conversations")).select(F.lit("conversation").alias("kind"), F.col("conv_id").alias("id"), none.alias("text"), none.alias("q"), none.alias("a"), "messages"),
        t(spark, sf, "benchmark").select(F.lit("qa").alias("kind"), F.col("item_id").alias("id"), none.alias("text"), F.col("item_id").cast("string").alias("q"), F.col("text").alias("a"), empty.alias("messages")),
        t(spark, sf, "documents").select(F.lit("text").alias("kind"), F.col("doc_id").alias("id"), "text", none.alias("q"), none.alias("a"), empty.alias("messages")),
    ]
    said = record_text(F.col("kind"), F.col("text"), F.col("q"), F.col("a"), F.col("messages"))
    parts = [x.select("kind", "id", F.md5(said.cast("binary")).alias("digest")) for x in sides]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@Q("o01_candidate_pool", f"""
WITH d AS (SELECT 'documents' AS source, doc_id, text FROM documents UNION ALL SELECT 'benchmark', item_id, text FROM benchmark),
s AS (SELECT * FROM d WHERE text IS NOT NULL AND trim(text) != '' AND (source = 'benchmark' OR CAST(('0x' || substr(sha256('pool:documents:' || doc_id), 1, 16))::UBIGINT AS DOUBLE) / 18446744073709551616.0 < 0.5))
SELECT source, doc_id, k AS chunk, length(substr(text, CAST(k * {LEN} + 1 AS BIGINT), {LEN})) AS tokens, sha256(substr(text, CAST(k * {LEN} + 1 AS BIGINT), {LEN})) AS digest
FROM (SELECT source, doc_id, text, unnest(range(0, (length(text) - 1) // {LEN} + 1)) AS k FROM s)""")
def o01(spark, sf):
    from millrace.plans.corpus import materialize

    sources = {"documents": t(spark, sf, "documents"), "benchmark": t(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text")}
    return materialize(sources, {"documents": 0.5}, LEN + 2).select("source", "doc_id", "chunk", "tokens", "digest")
