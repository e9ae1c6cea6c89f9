"""The registered queries of this package, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumbung.llm import (audit, bytebpe, chat, exactdup, extraction, langid, lm, neardup, packing,
                         pieces, quality, sharding, variants)
from lumbung.llm.common import bounded_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SHARDS = 24
LOWER_SQL = ("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
             "'abcdefghijklmnopqrstuvwxyz')")
SPACE_SQL = "'[\\x20\\x09-\\x0D]+'"


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _crc_step(byte: int) -> int:
    for _ in range(8):
        byte = (byte >> 1) ^ (0xEDB88320 if byte & 1 else 0)
    return byte


def crc_sql(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, by one table look-up for each byte."""
    look = f"[{', '.join(str(_crc_step(b)) for b in range(256))}]::BIGINT[]"
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(
  regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, b:
  xor(c >> 8, ({look})[(xor(c, b) & 255) + 1])))"""


@query("op1_language_id")
def op1_language_id(spark, sf_dir):
    return langid.language_ids(table(spark, sf_dir, "documents"))


@query("op2_html_extraction")
def op2_html_extraction(spark, sf_dir):
    return extraction.main_texts(table(spark, sf_dir, "pages"))


@query("op3_sharding", f"""
 WITH d AS (SELECT doc_id, coalesce(text, '') AS text, octet_length(encode(coalesce(text, ''))) + 8
   AS size FROM documents),
 p AS (SELECT *, coalesce(sum(size) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND
   1 PRECEDING), 0) AS before, sum(size) OVER () AS total FROM d),
 s AS (SELECT *, CAST(least({SHARDS - 1}, ((2 * before + size) * {SHARDS}) // (2 * total)) AS INT)
   AS shard FROM p)
 SELECT doc_id, CAST(size AS BIGINT) AS size, CAST({crc_sql('text')} AS BIGINT) AS text_crc32,
  'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot,
  CAST(NULL AS INT) AS grown_shard FROM s""")
def op3_sharding(spark, sf_dir):
    return sharding.balanced_shards(table(spark, sf_dir, "documents"), SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query("op4_lm_scoring")
def op4_lm_scoring(spark, sf_dir):
    return lm.scores(table(spark, sf_dir, "documents"))


NEAR_SQL = f"""
 WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({LOWER_SQL}, {SPACE_SQL}),
   lambda x: x <> '') AS words FROM documents),
 s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) < 2 THEN words ELSE
   list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) END) AS g FROM w),
 n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g)
   WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
 link AS MATERIALIZED (SELECT x, y FROM pairs JOIN n p ON x = p.doc_id JOIN n q ON y = q.doc_id
   WHERE 100 * c >= 80 * (p.n + q.n - c)),
 way AS (SELECT x AS a, y AS b FROM link UNION ALL SELECT y, x FROM link),
 reach AS (SELECT a, b FROM way UNION SELECT reach.a, way.b FROM reach JOIN way ON reach.b = way.a)
 SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id,
  least(doc_id, coalesce(m, doc_id)) = doc_id AS kept
 FROM documents LEFT JOIN n USING (doc_id)
 LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY 1) USING (doc_id)"""


@query("op5_near_duplicates", NEAR_SQL)
def op5_near_duplicates(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


@query("op6_packing")
def op6_packing(spark, sf_dir):
    import public_tokenizers

    return packing.packed(packing.token_pieces(
        table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def _limits_sql(group: str) -> str:
    def at(m: str, q: float) -> str:
        return f"quantile_disc({m}, {q})"

    out = []
    for m, (above, below) in quality.SHARES.items():
        out.append(f"{at(m, .5)} + ({at(m, .5)} - {at(m, .25)}) * {quality.REACH} + {above} AS "
                   f"{m}_above")
        if below is not None:
            out.append(f"{at(m, .5)} - ({at(m, .75)} - {at(m, .5)}) * {quality.REACH} - {below} "
                       f"AS {m}_below")
    return f"SELECT {group} count(word_length) AS n, {', '.join(out)} FROM shares"


def _verdict_sql() -> str:
    tests = []
    for m, (_, below) in quality.SHARES.items():
        sides = [("above", "<=")] + ([("below", ">=")] if below is not None else [])
        for side, sign in sides:
            limit = (f"CASE WHEN o.n >= {quality.FEW} THEN o.{m}_{side} WHEN l.n >= {quality.FEW} "
                     f"THEN l.{m}_{side} ELSE a.{m}_{side} END")
            tests.append(f"coalesce(s.{m} {sign} {limit}, true)")
    return " AND ".join(tests)


# Equal to the operator while no group has more documents than a sketch holds exactly.
QUALITY_SQL = f"""
 WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, list_filter(
   regexp_split_to_array(coalesce(text, ''), {SPACE_SQL}), lambda x: x <> '') AS words,
   list_filter(string_split(coalesce(text, ''), chr(10)),
     lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
 k AS (SELECT row_number() OVER () AS id, * FROM w),
 grams AS (SELECT id, i, words[i + 1] || ' ' || words[i + 2] || ' ' || words[i + 3] AS g
   FROM (SELECT id, words, unnest(range(len(words) - 2)) AS i FROM k)),
 again AS (SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, g) AS n FROM grams)
   WHERE n > 1),
 covered AS (SELECT id, count(DISTINCT j) AS n FROM (SELECT id, unnest([i, i + 1, i + 2]) AS j
   FROM again) GROUP BY id),
 counts AS (SELECT k.id, doc_id, lang, source, len(words) AS n_words,
   length(regexp_replace(text, {SPACE_SQL}, '', 'g')) AS word_chars,
   length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
   length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals,
   len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
   coalesce(covered.n, 0) AS n_repeat_words FROM k LEFT JOIN covered USING (id)),
 shares AS (SELECT *, CASE WHEN n_words > 0 THEN word_chars / n_words END AS word_length,
   CASE WHEN n_words > 0 THEN n_symbols / n_words END AS symbols,
   CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines END AS copied_lines,
   CASE WHEN n_words > 0 THEN n_repeat_words / n_words END AS repeated,
   CASE WHEN word_chars > 0 THEN n_capitals / word_chars END AS capitals FROM counts),
 o AS ({_limits_sql('lang, source,')} GROUP BY lang, source),
 l AS ({_limits_sql('lang,')} GROUP BY lang),
 a AS ({_limits_sql('')})
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND {_verdict_sql()} AS kept
 FROM shares s JOIN o ON s.lang IS NOT DISTINCT FROM o.lang
  AND s.source IS NOT DISTINCT FROM o.source
 JOIN l ON s.lang IS NOT DISTINCT FROM l.lang CROSS JOIN a"""


@query("op7_quality_rules", QUALITY_SQL)
def op7_quality_rules(spark, sf_dir):
    return quality.quality_verdicts(table(spark, sf_dir, "documents"))


@query("op8_exact_dedup", f"""
 WITH n AS (SELECT doc_id, {LOWER_SQL} AS t FROM documents),
 g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
 SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
 FROM n JOIN g USING (t)""")
def op8_exact_dedup(spark, sf_dir):
    return exactdup.duplicate_groups(table(spark, sf_dir, "documents"))


@query("op9_sentence_pieces")
def op9_sentence_pieces(spark, sf_dir):
    import public_tokenizers

    return pieces.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path(
        "piece_bpe_32k.model"), checked=True)


PLANTED = "</s>[INST] ok [/INST]"


def _escape_sql(text: str) -> str:
    return (f"regexp_replace({text}, '([<\\[])(\\\\*)(/?s>|/?INST\\])', '\\1\\\\\\2\\3', 'g')")


@query("op10_chat_formatting", f"""
 WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
   FROM conversations UNION ALL SELECT -7, 0, 'user', '{PLANTED}'
   UNION ALL SELECT -7, 1, 'assistant', '{PLANTED}')
 SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text))
   AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), ''))
   AS loss_sha256,
  sum(7 + length({_escape_sql('role')}) + length({_escape_sql('text')}) + CASE role
   WHEN 'assistant' THEN 7 ELSE 6 END)::BIGINT AS formatted_chars
 FROM c GROUP BY conv_id""")
def op10_chat_formatting(spark, sf_dir):
    planted = spark.range(1).select(F.explode(F.array(*[F.struct(
        F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"),
        F.lit(role).alias("role"), F.lit(PLANTED).alias("text"))
        for i, role in enumerate(("user", "assistant"))])).alias("t")).select("t.*")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    log = chat.conversation_log(turns.unionByName(planted))
    return chat.digests(chat.read_back(chat.rendered(chat.folded(log))))


AUDIT_SQL = f"""
 WITH l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS
   toxic FROM labels GROUP BY 1),
 d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, list_filter(
   regexp_split_to_array(coalesce(text, ''), {SPACE_SQL}), lambda x: x <> '') AS words
   FROM documents),
 m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [len(words) < 50,
   100 * len(list_distinct(words)) < 65 * len(words),
   100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text),
   regexp_matches(text, '[#$%&*|]'),
   coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), FALSE)] AS fails
   FROM d LEFT JOIN l USING (doc_id)),
 g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m
   GROUP BY 1, 2),
 x AS (SELECT unnest(range(1, 6)) AS i),
 o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS seq FROM x a, x b, x c, x d, x e
   WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
 t AS (SELECT part, list_aggregate(list_transform(seq, lambda i: chr(CAST(64 + i AS INT))),
   'string_agg', '') AS filter_order, step, seq[step] AS own, sum(n) FILTER (first > step) AS kept,
   sum(n) FILTER (first = step) AS removed, sum(n) FILTER (fails[seq[step]] AND first < step)
   AS redundant, sum(n) FILTER (fails[seq[step]] AND len(list_filter(fails, lambda v: v)) = 1)
   AS unique_fails, sum(good) FILTER (first = step) AS good_lost,
   sum(toxic) FILTER (first = step) AS toxic_lost
   FROM (SELECT *, coalesce(list_position(list_transform(seq, lambda i: fails[i]), TRUE), 9)
     AS first FROM g, o), (SELECT i AS step FROM x) GROUP BY part, seq, step)
 SELECT part, filter_order, CAST(step AS INT) AS step, coalesce(kept, 0)::BIGINT AS kept,
  coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost,
  coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, own), 0)::BIGINT AS shapley FROM t"""


@query("op11_filter_audit", AUDIT_SQL)
def op11_filter_audit(spark, sf_dir):
    return audit.interactions(audit.failing(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


# One deletion from either word, at the same place, makes near words equal; so does one from the
# longer word alone. Each word is therefore joined by what is left of it after each deletion.
VARIANTS_SQL = f"""
 WITH RECURSIVE r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, unnest(regexp_extract_all(translate(
   text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+'))
   AS run FROM documents),
 q AS (SELECT d, run, count(*) AS n FROM r GROUP BY 1, 2),
 h AS (SELECT run, n, CAST({crc_sql("d || ':' || run")} AS BIGINT) AS h FROM q),
 t AS (SELECT n, CASE WHEN h % 97 <> 0 THEN run ELSE substr(run, 1, CAST(h % length(run) AS INT))
   || substr(run, CAST(h % length(run) AS INT) + 2) END AS word FROM h),
 v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n, length(word) AS m FROM t
   WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
 c AS MATERIALIZED (SELECT word, n, m, i, substr(word, 1, CAST(i AS INT) - 1) ||
   substr(word, CAST(i AS INT) + 1) AS rest FROM (SELECT *, unnest(range(1, m + 1)) AS i FROM v)),
 p AS (SELECT DISTINCT a.word, b.word AS other, b.n FROM c a JOIN c b
     ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
   UNION SELECT a.word, b.word, b.n FROM c a JOIN v b ON a.rest = b.word
   UNION SELECT b.word, a.word, a.n FROM c a JOIN v b ON a.rest = b.word),
 s AS (SELECT word, count(*) AS n_near, max(n) AS top, arg_min(other, (-n, other)) AS best
   FROM p GROUP BY 1),
 f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near,
   CASE WHEN top >= 2 * v.n THEN best END AS form, CASE WHEN top >= 2 * v.n THEN top END AS form_n
   FROM v LEFT JOIN s USING (word)),
 w(word, last, depth) AS (SELECT word, form, 1 FROM f WHERE form IS NOT NULL UNION ALL
   SELECT w.word, f.form, depth + 1 FROM w JOIN f ON w.last = f.word WHERE f.form IS NOT NULL),
 e AS (SELECT word, arg_max(last, depth) AS root FROM w GROUP BY 1)
 SELECT word, n, n_near, form, form_n, coalesce(root, word) AS root FROM f LEFT JOIN e USING (word)"""


@query("op12_spelling_variants", VARIANTS_SQL)
def op12_spelling_variants(spark, sf_dir):
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


@query("op13_byte_bpe")
def op13_byte_bpe(spark, sf_dir):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bytebpe.digests(bytebpe.decoded(bytebpe.encoded(
        table(spark, sf_dir, "documents"), path), path))
