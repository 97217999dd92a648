"""The operators as registered queries, with reference SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import fresh_path
from . import decontamination, fingerprints, hard_negatives, language_id, line_dedup, mixing, near_dedup, neighbours, packing, quality, runs, token_files, tool_calls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def id_remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


@query("op1_nearest_vectors")
def op1(spark, sf_dir):
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op2_language")
def op2(spark, sf_dir):
    held_out = F.coalesce(id_remainder(3) == 1, F.lit(False))
    found = language_id.identified(table(spark, sf_dir, "documents"), ~held_out)
    return found.select("doc_id", (~F.col("learn")).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


@query("op3_fingerprints")
def op3(spark, sf_dir):
    return fingerprints.edits_by_next(table(spark, sf_dir, "documents"))


# Fixed values of op4's example tools: parameters with type and whether they are required.
TOOLS: tool_calls.Schemas = {
    "search": {"after": ("string", False), "text": ("string", True), "turn": ("integer", True), "words": ("integer", True)},
    "lookup": {"after": ("string", False), "text": ("string", True), "turn": ("integer", True)},
    "notify": {"after": ("string", False), "text": ("string", True), "turn": ("string", True), "words": ("number", True)},
}

# Every user turn as a call, every assistant turn as the result of the call before it. The
# turn number picks the tool; its parity rules leave some calls invalid or unanswered.
_CALLS = """
SELECT conv_id, turn AS seq, concat('call_', conv_id, '_', turn) AS call_id,
       CASE turn % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'notify' ELSE 'lookup' END AS name,
       coalesce(text, '') AS text, length(coalesce(text, '')) AS words,
       CASE WHEN turn > 0 THEN concat('call_', conv_id, '_', CAST(floor(turn / 2) AS bigint)) END AS after
FROM conversations WHERE role = 'user' AND conv_id IS NOT NULL AND turn IS NOT NULL
"""
_RESULTS = """
SELECT conv_id, turn AS seq, concat('call_', conv_id, '_', CASE WHEN (conv_id + turn) % 13 = 0 THEN turn + 1000000 ELSE turn - 1 END) AS call_id,
       coalesce(text, '') AS content
FROM conversations WHERE role = 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL
"""

_OP4_SQL = f"""
WITH RECURSIVE raw AS ({_CALLS}), res AS ({_RESULTS}),
call AS (
  SELECT *, CASE WHEN after IS NULL
    THEN json_object('text', text, 'turn', seq, 'words', words) ELSE json_object('after', after, 'text', text, 'turn', seq, 'words', words) END AS args
  FROM raw
),
firsts AS (
  SELECT conv_id, call_id, seq, name, after, min(CAST(args AS varchar)) AS args FROM call GROUP BY ALL
),
answers AS (
  SELECT conv_id, call_id, min(struct_pack(seq := seq, content := content)).content AS content, count(*) AS n_results FROM res GROUP BY ALL
),
walk(conv_id, call_id, level) AS (
  SELECT f.conv_id, f.call_id, 0 FROM firsts f LEFT JOIN firsts d ON d.conv_id = f.conv_id AND d.call_id = f.after WHERE d.call_id IS NULL
  UNION ALL
  SELECT f.conv_id, f.call_id, w.level + 1 FROM walk w JOIN firsts f ON f.conv_id = w.conv_id AND f.after = w.call_id
),
joined AS (
  SELECT c.conv_id, c.call_id, c.seq, c.name, w.level, c.args, c.text,
    CASE WHEN CAST(c.args AS varchar) <> f.args THEN 'duplicate' WHEN a.call_id IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
    a.content, a.n_results,
    concat_ws('; ',
      CASE WHEN c.name = 'notify' THEN 'turn is not string' WHEN c.name = 'lookup' THEN 'unknown words' END,
      CASE WHEN c.after IS NOT NULL AND d.call_id IS NULL THEN concat('no call ', c.after) END) AS problems
  FROM call c JOIN firsts f USING (conv_id, call_id) LEFT JOIN answers a USING (conv_id, call_id) LEFT JOIN walk w USING (conv_id, call_id)
  LEFT JOIN firsts d ON d.conv_id = c.conv_id AND d.call_id = c.after
)
SELECT conv_id, call_id, seq, name, CAST(level AS int) AS level, status,
  CASE WHEN status = 'duplicate' THEN 0 ELSE coalesce(n_results, 0) END AS n_results, problems = '' AS valid, problems,
  CASE WHEN status = 'linked'
    THEN CAST(CASE WHEN level IS NULL THEN json_object('arguments', args, 'id', call_id, 'name', name, 'result', content, 'status', status)
      ELSE json_object('arguments', args, 'id', call_id, 'level', level, 'name', name, 'result', content, 'status', status) END AS varchar)
    ELSE CAST(CASE WHEN level IS NULL THEN json_object('arguments', args, 'id', call_id, 'name', name, 'status', status)
      ELSE json_object('arguments', args, 'id', call_id, 'level', level, 'name', name, 'status', status) END AS varchar) END AS record
FROM joined
"""


@query("op4_tool_calls", _OP4_SQL)
def op4(spark, sf_dir):
    conversations = table(spark, sf_dir, "conversations")
    calls = spark.sql(_CALLS.replace("conversations", "{conversations}"), conversations=conversations)
    results = spark.sql(_RESULTS.replace("conversations", "{conversations}"), conversations=conversations)
    arguments = F.to_json(F.struct("words", "text", F.col("seq").alias("turn"), "after"))
    shaped = calls.select("conv_id", "seq", "call_id", "name", arguments.alias("arguments"), F.array("after").alias("needs"))
    return tool_calls.linked(shaped, results, TOOLS)


@query("op5_quality")
def op5(spark, sf_dir):
    learn = F.coalesce(id_remainder(5) != 0, F.lit(True))
    rows = quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn)
    return rows.select("doc_id", (~F.col("learn")).alias("held_out"), "score", "predicted")


_OP6_SQL = f"""
WITH lines AS (
  SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents
),
normal AS (
  SELECT doc_id, source, pos, line,
    translate(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm,
    len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) >= {line_dedup.MIN_WORDS} AS counts
  FROM lines
),
common AS (
  SELECT norm, min(doc_id) AS first FROM normal WHERE counts GROUP BY norm HAVING count(DISTINCT coalesce('s' || source, '')) >= {line_dedup.MIN_SITES}
),
marked AS (
  SELECT n.doc_id, n.pos, n.line, c.norm IS NOT NULL AND n.doc_id > c.first AS gone FROM normal n LEFT JOIN common c ON n.counts AND n.norm = c.norm
)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text,
  CAST(count(*) FILTER (WHERE gone) AS int) AS lines_removed
FROM marked GROUP BY doc_id
"""


@query("op6_line_dedup", _OP6_SQL)
def op6(spark, sf_dir):
    return line_dedup.without_boilerplate(table(spark, sf_dir, "documents")).select("doc_id", "text", "lines_removed")


@query("op7_token_files")
def op7(spark, sf_dir):
    path = fresh_path(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer(), end_id=1)
    return token_files.read_tokens(spark, path, with_ids=False)


@query("op8_packing")
def op8(spark, sf_dir):
    return packing.packed_documents(table(spark, sf_dir, "documents"), tokenizer(), end_id=0, size=2048, with_ids=False)


@query("op9_near_dedup")
def op9(spark, sf_dir):
    return near_dedup.near_groups(table(spark, sf_dir, "documents"))


# The threshold takes whole hashes in order while that comes nearer to the budget.
_OP10_SQL = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    CAST(concat('0x', substr(md5(coalesce(CAST(doc_id AS varchar), '')), 1, 15)) AS bigint) AS hash
  FROM documents
),
per_source AS (
  SELECT source, CAST(sum(size) AS bigint) AS source_size,
    CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0e0 WHEN 1 THEN 2.0e0 ELSE 1.0e0 END AS weight
  FROM sized GROUP BY source
),
levels AS (
  SELECT *, 3.0e0 * source_size AS most,
    (sum(source_size) OVER () - coalesce(sum(3.0e0 * source_size) OVER (ORDER BY 3.0e0 * source_size / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY 3.0e0 * source_size / weight, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM per_source
),
targets AS (SELECT source, source_size, least(most, weight * max(level) OVER ()) AS target FROM levels),
budget AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END AS base FROM targets
),
placed AS (
  SELECT s.doc_id, s.size, s.hash, b.source, b.source_size, b.target, b.base, b.target - b.base * b.source_size AS room,
    sum(s.size) OVER (PARTITION BY b.source ORDER BY s.hash RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
    sum(s.size) OVER (PARTITION BY b.source, s.hash) AS own
  FROM sized s JOIN budget b ON s.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, round(target, 6) AS target,
  CAST(size * (base + CASE WHEN room > 0 AND (upto <= room OR (upto - own <= room AND 2 * (room - upto + own) >= own)) THEN 1 ELSE 0 END) AS bigint) AS taken
FROM placed
"""


@query("op10_mixing", _OP10_SQL)
def op10(spark, sf_dir):
    rows = mixing.taken(table(spark, sf_dir, "documents"))
    return rows.withColumn("target", F.round("target", 6))


@query("op11_hard_negatives")
def op11(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


# All places of all documents against all windows, and every hit word listed.
_OP12_SQL = """
WITH doc AS (
  SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
  FROM documents
),
item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
  FROM benchmark
),
piece AS (SELECT item_id, words, unnest(range(0, greatest(1, len(words) - 9))) AS pos FROM item WHERE len(words) > 0),
win AS (SELECT DISTINCT item_id, array_to_string(words[pos + 1:pos + 10], ' ') AS txt, least(len(words), 10) AS size FROM piece),
sizes AS (SELECT DISTINCT size FROM win),
place AS (SELECT row, words, size, unnest(range(0, len(words) - size + 1)) AS pos FROM doc JOIN sizes ON len(words) >= size),
hit AS (SELECT p.row, p.pos, p.size, w.item_id FROM place p JOIN win w ON w.size = p.size AND w.txt = array_to_string(p.words[p.pos + 1:p.pos + p.size], ' ')),
hit_words AS (SELECT row, unnest(range(pos, pos + size)) AS pos FROM (SELECT DISTINCT row, pos, size FROM hit)),
n_words_hit AS (SELECT row, count(DISTINCT pos) AS n FROM hit_words GROUP BY row),
n_items_hit AS (
  SELECT row, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, CAST(item_id AS varchar) AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY row
)
SELECT d.doc_id, CAST(len(d.words) AS bigint) AS n_words, CAST(coalesce(w.n, 0) AS bigint) AS n_hit, CAST(coalesce(i.n, 0) AS bigint) AS n_items,
  sha256(coalesce(i.items, '')) AS items_sha256, coalesce(w.n, 0) > 0 AS contaminated
FROM doc d LEFT JOIN n_words_hit w USING (row) LEFT JOIN n_items_hit i USING (row)
"""


@query("op12_decontamination", _OP12_SQL)
def op12(spark, sf_dir):
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


# A tenth of the texts, by the id's hash, repeats a stretch of its words to the end.
_OP13_EDITED = """
WITH hashed AS (SELECT doc_id, text, crc32(CAST(doc_id AS string)) AS h FROM {documents}),
split AS (
  SELECT doc_id, text, h DIV 10 AS g, CASE WHEN h % 10 = 0 THEN regexp_extract_all(text, '[^\\\\x20\\\\x09-\\\\x0D]+', 0) END AS words FROM hashed
),
cut AS (SELECT *, size(words) AS n, CASE WHEN size(words) > 0 THEN g % size(words) END AS a FROM split),
stretch AS (SELECT *, 1 + (n - a) DIV (3 + g % 8) AS p FROM cut)
SELECT doc_id, CASE WHEN a IS NULL THEN text ELSE array_join(
    transform(sequence(0, n - 1), i -> words[CAST(CASE WHEN i < a THEN i ELSE a + (i - a) % p END AS int)]), ' ') END AS text
FROM stretch
"""
_OP13_DIGEST = """
WITH best AS (SELECT *, array_max(transform(runs, r -> struct(r.length AS length, -r.start AS start, -r.period AS period))) AS top FROM {found})
SELECT doc_id, CAST(size(runs) AS bigint) AS n_runs, -top.start AS start, top.length AS length, -top.period AS period,
  (1000 * top.length) DIV -top.period AS exponent_milli,
  sha2(array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), ''), 256) AS runs_sha256,
  sha2(collapsed, 256) AS collapsed_sha256
FROM best
"""


@query("op13_periodic_runs")
def op13(spark, sf_dir):
    edited = spark.sql(_OP13_EDITED, documents=table(spark, sf_dir, "documents"))
    return spark.sql(_OP13_DIGEST, found=runs.periodic_runs(edited))
