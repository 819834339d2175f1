"""The operators' queries over the supplied tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm import ann, bpe, chat, fim, licenses, mixing, packing, repair, repetition, secrets, sharding, simhash, toxicity
from rillflow.llm.common import fresh_folder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of documents, which arrive in eight parts by a hash of doc_id, and compacted: where each document ends up."""
    docs = table(spark, sf_dir, "documents")
    store = sharding.ShardStore(spark, fresh_folder(spark, "shards"), docs.schema)
    store.append_parts(docs, F.pmod(F.xxhash64("doc_id"), F.lit(8)), 8)
    store.compact()
    store.vacuum()
    return store.placed("doc_id")


@query
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def mixing_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the splitting tree decides beside the amounts: of each draw its output shard and its place there."""
    found = mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", F.explode("draws").alias("draw"))
    return found.select("doc_id", "size", "draw.shard", "draw.place", "draw.pass")


ORACLE_SQL["op2_mixing"] = """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce('s' || strlen(doc_id::VARCHAR) || ':' || doc_id, 'n') || coalesce('s' || strlen(source) || ':' || source, 'n') || coalesce('s' || strlen(text) || ':' || text, 'n')) AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::BIGINT AS w,
         source_size * 3 AS cap, (sum(source_size) OVER ())::BIGINT AS total FROM s),
o AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
         (sum(w) OVER (ORDER BY cap::DOUBLE / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS rest FROM w),
f AS (SELECT *, (total - before)::DOUBLE * w >= cap::DOUBLE * rest AS is_full FROM o),
t AS (
  SELECT source, source_size,
         CASE WHEN is_full THEN cap::DOUBLE
              ELSE (w * (total - (sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ())::BIGINT))::DOUBLE
                   / (sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ())::DOUBLE END AS target FROM f),
p AS (
  SELECT d.*, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS len,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * ((a < len)::INT + (source_size + a < len)::INT + (2 * source_size + a < len)::INT))::BIGINT AS taken FROM p
"""


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repetition.assess(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


# Words in repeated runs of n words or more are those in windows of n words that stand twice; a run longer than 50 words is
# repeated if a window of 51 words stands twice.
ORACLE_SQL["op4_quality_rules"] = """
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT k, n, i, array_to_string(w[i + 1 : i + n], ' ') AS g FROM (SELECT k, w, n, unnest(range(len(w) - n + 1)) AS i FROM d, (VALUES (3), (20), (51)) t(n) WHERE len(w) >= n)),
r AS (SELECT k, n, i FROM (SELECT *, count(*) OVER (PARTITION BY k, n, g) AS c FROM g) WHERE c > 1),
p AS (SELECT k, n, count(DISTINCT p) AS covered FROM (SELECT k, n, unnest(range(i, i + n)) AS p FROM r) GROUP BY k, n),
c AS (
  SELECT k, max(CASE WHEN n = 3 THEN covered END) AS c3, max(CASE WHEN n = 20 THEN covered END) AS c20, max(CASE WHEN n = 51 THEN covered END) AS c51 FROM p GROUP BY k),
b AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l,
         coalesce(c3, 0)::BIGINT AS n_repeat_words, coalesce(c20, 0) AS c20, coalesce(c51, 0) AS c51
  FROM d LEFT JOIN c USING (k)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND c20::DOUBLE / n_words <= 0.3 AND c51 = 0 AS kept FROM f
"""


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def packing_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruction data: each assistant turn behind the user turn that it answers, which bears no loss, at most 384 loss-bearing tokens a sequence."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").distinct()
    asked = turns.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("asked"))
    pairs = turns.filter("role = 'assistant'").join(asked, ["conv_id", "turn"], "left")
    return packing.pack(pairs.select((F.col("conv_id") * 1_000_000 + F.col("turn")).alias("doc_id"), "text", "asked"), max_loss_tokens=384, prompt="asked")


@query
def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rendered(table(spark, sf_dir, "conversations"))


ORACLE_SQL["op6_chat_format"] = """
WITH r AS (
  SELECT DISTINCT conv_id, turn, role, text, {'nameless': conv_id IS NULL, 'conv_id': conv_id, 'own': CASE WHEN conv_id IS NULL THEN to_json({'t': turn, 'r': role, 'x': text})::VARCHAR END} AS conv
  FROM conversations),
t AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS position FROM r),
c AS (SELECT conv, count(*) AS n, list({'role': role, 'text': text} ORDER BY position) AS turns FROM t GROUP BY conv),
w AS (SELECT turns, any_value(n) AS n, min(conv) AS conv, count(*) AS n_copies FROM c GROUP BY turns),
p AS (SELECT DISTINCT turns[1:k] AS turns FROM (SELECT turns, unnest(range(1, n)) AS k FROM c)),
m AS (SELECT * FROM w ANTI JOIN p USING (turns))
SELECT t.conv_id, t.position::BIGINT AS position, m.n::BIGINT AS n_turns, m.n_copies::BIGINT AS n_copies,
       '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS rendered
FROM t JOIN m ON t.conv IS NOT DISTINCT FROM m.conv
"""


@query
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents"))


@query
def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ann.build(table(spark, sf_dir, "embeddings"))
    return ann.search(index, index.rows.filter(F.col("vec_id") % 20 == 0) if index else table(spark, sf_dir, "embeddings"))


@query
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


@query
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def template_regex(template: str) -> str:
    """A template as a regular expression over words with a space before each."""
    parts = re.findall(r"\[[^\]]*\]|<\d+>|[^\s\[\]<>]+", template)
    spelled = {"[": lambda p: f"(?: {' '.join(p[1:-1].split())})?", "<": lambda p: f"(?: [^ ]+){{0,{p[1:-1]}}}"}
    return "".join(spelled.get(p[0], lambda p: f" {p}")(p) for p in parts) + " "


_PHRASE_PLACES = " + ".join(f"(words[i : i + {len(p) - 1}] = {list(p)})::INT" for p, _ in licenses.PHRASES)
_BASE = ", ".join(f"CASE WHEN contains(line, ' {' '.join(p)} ') THEN '{label}' END" for p, label in licenses.PHRASES)
_OWN = ", ".join(f"CASE WHEN regexp_matches(line, '{template_regex(t)}') THEN '{label}' END" for label, t in licenses.TEMPLATES)
ORACLE_SQL["op10_license_scan"] = f"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
  FROM documents),
l AS (SELECT *, ' ' || array_to_string(words, ' ') || ' ' AS line FROM w),
p AS (SELECT *, list_filter(range(1, len(words) + 1), lambda i: {_PHRASE_PLACES} > 0) AS places, list_filter([{_BASE}], lambda x: x IS NOT NULL) AS base, list_filter([{_OWN}], lambda x: x IS NOT NULL) AS own FROM l)
SELECT doc_id, len(words)::BIGINT AS n_words, len(places)::BIGINT AS n_base, list_min(places)::BIGINT - 1 AS first_word, list_max(places)::BIGINT - 1 AS last_word,
       array_to_string(list_sort(list_distinct(base)), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(base, own))), ',') AS labels,
       CASE WHEN len(own) > 0 THEN 1.0::DOUBLE ELSE 1 - pow(0.5, len(places)) END AS score FROM p
"""


@query
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fim.transform(table(spark, sf_dir, "documents"))
    digests = (F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


ORACLE_SQL["op11_fill_in_middle"] = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS t,
         sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
n AS (
  SELECT *, len(t)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high FROM n),
f AS (
  SELECT doc_id, text, n, array_to_string(t[1:low], '') AS prefix, array_to_string(t[low + 1 : high], '') AS middle, array_to_string(t[high + 1 :], '') AS suffix,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256
FROM f
"""


@query
def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.digests(repair.damaged(table(spark, sf_dir, "conversations")))


@query
def op13_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.decode(bpe.encode(table(spark, sf_dir, "documents")))
    digests = (F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), *digests)
