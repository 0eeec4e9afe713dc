"""Generation and benchmark queries (L2, L3, L4) with the bigram model fitted on train."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiforge.operators import encode, fewshot, ngram
from lexiforge.plans.example_queries import sql_with
from lexiforge.plans.model_queries import SQL_MODEL, Model, sql_orders
from lexiforge.plans.params import CONTEXT_BUDGET, GENERATION_ORDER, MAX_ORDER, NGRAM_ALPHA, ORDER_PRIOR, SEED, SHOTS
from lexiforge.plans.registry import register, table
from lexiforge.plans.routing_queries import r6
from lexiforge.plans.token_queries import byte_tokens, byte_vocab
from lexiforge.session import stored

GENERATION_LENGTH = 400   # ids of a prompt and its continuation together
TASK = "benchmark"


def prompts(spark, sf_dir, lut):
    b = table(spark, sf_dir, "benchmark")
    return b.select("item_id", encode.byte_level_ids(F.col("text"), lut).alias("ids"))


def generated(spark, sf_dir, stop):
    """(item_id, gen) and the vocabulary's hex list."""
    m = Model(spark, sf_dir)
    chains = ngram.greedy_chains(ngram.best_next_table(m.counts, m.vocab_size), GENERATION_LENGTH)
    g = ngram.generate(prompts(spark, sf_dir, m.lut), "ids", chains, GENERATION_LENGTH, 0 if stop else None)
    return g.select("item_id", "gen"), m.vocab_hex


def _generate(spark, sf_dir, stop):
    g, vocab_hex = generated(spark, sf_dir, stop)
    return encode.decode_corpus(g, vocab_hex, ids="gen", out="gen_text").select(
        "item_id", F.size("gen").alias("n_generated"), F.array_join("gen", ",").alias("gen_csv"), "gen_text")


def _sql_generated(stop: bool) -> str:
    """WITH-list up to generated(item_id, gen) and vhex(vh)."""
    stop_cond = "AND NOT c.stopped" if stop else ""
    stopped = "coalesce(b.best_id, 0) = 0" if stop else "false"
    return f"""{sql_with(*SQL_MODEL)},
vhex AS (SELECT list(h ORDER BY id) AS vh FROM (SELECT 0 AS id, hex(encode('<pad>')) AS h UNION ALL SELECT 1, hex(encode('<bos>'))
         UNION ALL SELECT 2, hex(encode('<unk>')) UNION ALL SELECT id, lpad(hex(b), 2, '0') FROM alpha)),
best AS MATERIALIZED (SELECT prev_id, next_id AS best_id FROM (SELECT *, row_number() OVER (PARTITION BY prev_id ORDER BY cnt DESC, next_id) AS rn FROM cnt) WHERE rn = 1),
prm AS MATERIALIZED (SELECT item_id, list_concat([1::BIGINT], list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST(m[('0x' || x)::INTEGER + 1] AS BIGINT))) AS ids FROM benchmark, alpha_map),
chain AS (SELECT * FROM (WITH RECURSIVE ch(item_id, room, k, last, gen, stopped) AS (
    SELECT item_id, greatest({GENERATION_LENGTH} - len(ids), 0), 0, ids[len(ids)], []::BIGINT[], false FROM prm
    UNION ALL
    SELECT c.item_id, c.room, c.k + 1, coalesce(b.best_id, 0), list_append(c.gen, coalesce(b.best_id, 0)), {stopped}
    FROM ch c LEFT JOIN best b ON b.prev_id = c.last WHERE c.k < c.room {stop_cond})
  SELECT * FROM ch)),
generated AS (SELECT item_id, gen FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY k DESC) AS rn FROM chain) WHERE rn = 1)"""


SQL_GENERATED = _sql_generated(True)
SQL_GEN_TEXT = "decode(unhex(array_to_string(list_transform(gen, lambda i: vh[i + 1]), '')))"
_SQL_GEN = f"SELECT item_id, CAST(len(gen) AS INTEGER) AS n_generated, array_to_string(gen, ',') AS gen_csv, {SQL_GEN_TEXT} AS gen_text FROM generated, vhex"


@register("greedy_generate", sql=f"{SQL_GENERATED} {_SQL_GEN}")
def greedy_generate(spark, sf_dir):
    """Greedy continuation of every benchmark text until <pad> or GENERATION_LENGTH ids, as ids and text."""
    return _generate(spark, sf_dir, stop=True)


@register("generate_fixed", sql=f"{_sql_generated(False)} {_SQL_GEN}")
def generate_fixed(spark, sf_dir):
    """Continuation up to GENERATION_LENGTH ids, whatever is generated (no stop on <pad>)."""
    return _generate(spark, sf_dir, stop=False)


def _generate_contexts(spark, sf_dir, stop):
    lut, vocab_hex, _ = byte_vocab(spark, sf_dir)
    train = byte_tokens(spark, sf_dir, lut).filter("split = 'train'")
    counts = stored(ngram.context_counts(ngram.ended(train), GENERATION_ORDER, by=()), "contexts")
    g = ngram.generate_contexts(prompts(spark, sf_dir, lut), "ids", counts, GENERATION_ORDER, GENERATION_LENGTH, stop)
    return encode.decode_corpus(g.select("item_id", "gen"), vocab_hex, ids="gen", out="gen_text").select(
        "item_id", F.size("gen").alias("n_generated"), F.array_join("gen", ",").alias("gen_csv"), "gen_text")


def _sql_generated_contexts(stop: bool) -> str:
    """WITH-list up to generated(item_id, gen) and vhex(vh): contexts of two ids, of one, of none; q<j> is the id j places before w."""
    stop_cond = "AND NOT c.stopped" if stop else ""
    best = ", ".join(
        f"b{k} AS MATERIALIZED (SELECT {''.join(f'q{j}, ' for j in range(1, k + 1))}arg_min(w, (-n, w)) AS w FROM (SELECT "
        f"{''.join(f'q{j}, ' for j in range(1, k + 1))}w, sum(n) AS n FROM g {f'WHERE q{k} IS NOT NULL' if k else ''} GROUP BY ALL) GROUP BY ALL)"
        for k in range(GENERATION_ORDER))
    pick = "CASE WHEN c.stopped THEN 0 ELSE coalesce(b2.w, b1.w, (SELECT w FROM b0), 0) END"
    return f"""{sql_with()},
vhex AS (SELECT list(h ORDER BY id) AS vh FROM (SELECT 0 AS id, hex(encode('<pad>')) AS h UNION ALL SELECT 1, hex(encode('<bos>'))
         UNION ALL SELECT 2, hex(encode('<unk>')) UNION ALL SELECT id, lpad(hex(b), 2, '0') FROM alpha)),
g AS MATERIALIZED (SELECT q1, q2, w, count(*) AS n FROM (SELECT unnest(list_concat(ids[2:], [0::BIGINT])) AS w, unnest(ids) AS q1,
     unnest(list_concat([NULL::BIGINT], ids[:-2])) AS q2 FROM toks WHERE split = 'train') GROUP BY ALL),
{best},
prm AS MATERIALIZED (SELECT item_id, list_concat([1::BIGINT], list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST(m[('0x' || x)::INTEGER + 1] AS BIGINT))) AS ids FROM benchmark, alpha_map),
chain AS (SELECT * FROM (WITH RECURSIVE ch(item_id, room, k, q1, q2, gen, stopped) AS (
    SELECT item_id, greatest({GENERATION_LENGTH} - len(ids), 0), 0, ids[len(ids)], CASE WHEN len(ids) > 1 THEN ids[len(ids) - 1] END, []::BIGINT[], false FROM prm
    UNION ALL
    SELECT c.item_id, c.room, c.k + 1, {pick}, c.q1, list_append(c.gen, {pick}), {pick} = 0
    FROM ch c LEFT JOIN b2 ON b2.q1 = c.q1 AND b2.q2 = c.q2 LEFT JOIN b1 ON b1.q1 = c.q1 WHERE c.k < c.room {stop_cond})
  SELECT * FROM ch)),
generated AS (SELECT item_id, arg_max(gen, k) AS gen FROM chain GROUP BY item_id)"""


@register("greedy_generate_contexts", sql=f"{_sql_generated_contexts(True)} {_SQL_GEN}")
def greedy_generate_contexts(spark, sf_dir):
    """Greedy continuation of every benchmark text by a model of order GENERATION_ORDER, until it predicts the end of
    the text or GENERATION_LENGTH ids."""
    return _generate_contexts(spark, sf_dir, stop=True)


@register("generate_fixed_contexts", sql=f"{_sql_generated_contexts(False)} {_SQL_GEN}")
def generate_fixed_contexts(spark, sf_dir):
    """The same to GENERATION_LENGTH ids, with <pad> after the end."""
    return _generate_contexts(spark, sf_dir, stop=False)


def choices(spark, sf_dir, lut):
    """(item_id, choice_id, ids): 0 = the text (gold), 1 = its blank-separated words reversed."""
    b = table(spark, sf_dir, "benchmark")
    rev = F.array_join(F.reverse(F.split(F.col("text"), " ")), " ")
    c = b.select("item_id", F.posexplode(F.array(F.col("text"), rev)).alias("choice_id", "choice"))
    return c.select("item_id", F.col("choice_id").cast("int"), encode.byte_level_ids(F.col("choice"), lut).alias("ids"))


def scores(spark, sf_dir):
    m = Model(spark, sf_dir)
    return ngram.sequence_loglik(choices(spark, sf_dir, m.lut), ("item_id", "choice_id"), "ids", m.counts, m.vocab_size, NGRAM_ALPHA)


_SQL_CHOICES = [
    "ch AS (SELECT item_id, unnest([0, 1]) AS choice_id, unnest([text, array_to_string(list_reverse(string_split(text, ' ')), ' ')]) AS choice FROM benchmark)",
    "cid AS (SELECT item_id, CAST(choice_id AS INTEGER) AS choice_id, list_concat([1::BIGINT], list_transform(regexp_extract_all(hex(encode(choice)), '..'), "
    "lambda x: CAST(m[('0x' || x)::INTEGER + 1] AS BIGINT))) AS ids FROM ch, alpha_map)",
    "cp AS (SELECT item_id, choice_id, unnest(list_transform(range(2, len(ids) + 1), lambda i: ids[i - 1])) AS prev_id, "
    "unnest(list_transform(range(2, len(ids) + 1), lambda i: ids[i])) AS next_id FROM cid)",
    f"sp AS (SELECT item_id, choice_id, sum(ln((coalesce(c.cnt, 0) + {NGRAM_ALPHA}) / (coalesce(t.ctx_cnt, 0) + {NGRAM_ALPHA} * vocab_size))) AS loglik "
    "FROM cp LEFT JOIN cnt c USING (prev_id, next_id) LEFT JOIN tot t USING (prev_id), alpha_map GROUP BY item_id, choice_id)",
    "sc AS (SELECT item_id, choice_id, coalesce(loglik, 0.0) AS loglik FROM cid LEFT JOIN sp USING (item_id, choice_id))",
]


@register("choice_scores", sql=f"""{sql_with(*SQL_MODEL, *_SQL_CHOICES)}
SELECT item_id, choice_id, round(loglik + 3.1e-10, 4) AS loglik FROM sc""")
def choice_scores(spark, sf_dir):
    """Log-likelihood of each multiple-choice option under the model."""
    s = scores(spark, sf_dir)
    return s.select("item_id", "choice_id", F.round(F.col("loglik") + 3.1e-10, 4).alias("loglik"))


@register("choice_accuracy", sql=f"""{sql_with(*SQL_MODEL, *_SQL_CHOICES)},
pick AS (SELECT item_id, arg_max(choice_id, (loglik, -choice_id)) AS chosen FROM sc GROUP BY item_id)
SELECT '{TASK}' AS task, count(*) AS n_items, round(avg(CASE WHEN chosen = 0 THEN 1.0 ELSE 0.0 END) + 3.1e-10, 6) AS accuracy FROM pick""")
def choice_accuracy(spark, sf_dir):
    """Pick the most likely option per item; accuracy per task."""
    s = scores(spark, sf_dir)
    pick = s.groupBy("item_id").agg(F.max_by("choice_id", F.struct(F.col("loglik"), -F.col("choice_id"))).alias("chosen"))
    return pick.agg(F.count(F.lit(1)).alias("n_items"),
                    r6(F.avg(F.when(F.col("chosen") == 0, 1.0).otherwise(0.0))).alias("accuracy")).select(
        F.lit(TASK).alias("task"), "n_items", "accuracy")


def task_items(spark, sf_dir):
    """(task, item_id, prompt, answer, other): ``order`` tells a text from its words reversed, ``ending`` a text's second
    half, after the first as prompt, from its words reversed."""
    b = table(spark, sf_dir, "benchmark")
    words = F.split(F.coalesce("text", F.lit("")), " ")
    half = F.floor(F.size(words) / 2).cast("int")
    join = lambda w: F.array_join(w, " ")
    end = F.slice(words, half + 1, F.size(words))
    forms = F.array(
        F.struct(F.lit("order").alias("task"), F.lit("").alias("prompt"), join(words).alias("answer"), join(F.reverse(words)).alias("other")),
        F.struct(F.lit("ending").alias("task"), F.concat(join(F.slice(words, F.lit(1), half)), F.lit(" ")).alias("prompt"),
                 join(end).alias("answer"), join(F.reverse(end)).alias("other")))
    return b.select("item_id", F.explode(forms).alias("f")).select("f.task", "item_id", "f.prompt", "f.answer", "f.other")


def _sql_few_shot() -> str:
    ids = lambda t: f"list_transform(regexp_extract_all(hex(encode({t})), '..'), lambda x: CAST(m[('0x' || x)::INTEGER + 1] AS BIGINT))"
    back = range(1, MAX_ORDER)
    shifted = ", ".join(f"CASE WHEN i > {j} THEN seq[i - {j}] END AS q{j}" for j in back)
    forms = " UNION ALL ".join(
        f"SELECT task, item_id, {n} AS n_shots, coalesce((SELECT string_agg(b.shot, '' ORDER BY (b.idx - a.idx + a.size) % a.size) FROM ring b "
        f"WHERE b.task = a.task AND (b.idx - a.idx + a.size) % a.size BETWEEN 1 AND {n}), '') AS context, prompt, answer, other FROM ring a" for n in SHOTS)
    evaluated = (f"SELECT task, item_id, n_shots, choice_id, seq[i] AS w, {shifted}, 1 AS n, 1.0 / vocab_size AS p0 "
                 f"FROM (SELECT *, unnest(range(len(seq) - len(ids) + 1, len(seq) + 1)) AS i FROM options), alpha_map")
    return f"""{sql_with()},
words AS (SELECT item_id, string_split(coalesce(text, ''), ' ') AS ws, len(string_split(coalesce(text, ''), ' ')) // 2 AS half FROM benchmark),
items AS (SELECT 'order' AS task, item_id, '' AS prompt, array_to_string(ws, ' ') AS answer, array_to_string(list_reverse(ws), ' ') AS other FROM words
  UNION ALL SELECT 'ending', item_id, array_to_string(ws[:half], ' ') || ' ', array_to_string(ws[half + 1:], ' '), array_to_string(list_reverse(ws[half + 1:]), ' ') FROM words),
ring AS MATERIALIZED (SELECT *, prompt || answer || chr(10) AS shot, count(*) OVER (PARTITION BY task) AS size,
  row_number() OVER (PARTITION BY task ORDER BY md5('{SEED}:' || task || ':' || item_id), item_id) - 1 AS idx FROM items),
asked AS MATERIALIZED ({forms}),
options AS MATERIALIZED (SELECT task, item_id, n_shots, choice_id, ids, list_concat(before[-{max(MAX_ORDER - 1, 1)}:], ids) AS seq FROM (
  SELECT task, item_id, n_shots, unnest([0, 1])::INTEGER AS choice_id, list_concat([1::BIGINT], {ids("context || prompt")})[-{CONTEXT_BUDGET}:] AS before,
         unnest([{ids("answer")}, {ids("other")}]) AS ids FROM asked, alpha_map)),
{sql_orders(evaluated)},
sc AS (SELECT o.task, o.item_id, o.n_shots, o.choice_id, coalesce(sum(ln(p{MAX_ORDER})), 0.0) AS loglik
       FROM options o LEFT JOIN s{MAX_ORDER} s USING (task, item_id, n_shots, choice_id) GROUP BY ALL),
pick AS (SELECT task, n_shots, item_id, arg_max(choice_id, (loglik, -choice_id)) AS chosen, max(CASE WHEN choice_id = 0 THEN loglik END) AS gold FROM sc GROUP BY ALL)
SELECT task, n_shots, count(*) AS n_items, round(avg(CASE WHEN chosen = 0 THEN 1.0 ELSE 0.0 END) + 3.1e-10, 6) AS accuracy,
       round(avg(gold), 4) AS mean_loglik FROM pick GROUP BY task, n_shots"""


@register("few_shot_accuracy", sql=_sql_few_shot())
def few_shot_accuracy(spark, sf_dir):
    """Accuracy and log-likelihood of the right answer by task and number of shots, by the model of order MAX_ORDER."""
    lut, _, vocab_size = byte_vocab(spark, sf_dir)
    items = stored(task_items(spark, sf_dir), "items")
    train = stored(ngram.context_counts(byte_tokens(spark, sf_dir, lut).filter("split = 'train'"), MAX_ORDER, by=()), "contexts")
    rows = None
    for n in SHOTS:
        given = items.join(fewshot.few_shot_contexts(items, n, SEED), ["task", "item_id"]).withColumn("n_shots", F.lit(n))
        rows = given if rows is None else rows.unionByName(given)
    before = encode.byte_level_ids(F.concat("context", "prompt"), lut, last=CONTEXT_BUDGET)
    rows = rows.select("task", "item_id", "n_shots", before.alias("before"), F.posexplode(F.array("answer", "other")).alias("choice_id", "choice"))
    rows = rows.withColumn("ids", encode.byte_level_ids(F.col("choice"), lut, add_bos=False)).drop("choice")
    keys = ("task", "item_id", "n_shots", "choice_id")
    s = ngram.continuation_loglik(stored(rows, "options"), keys, "before", "ids", train, MAX_ORDER, vocab_size, ORDER_PRIOR)
    pick = s.groupBy("task", "n_shots", "item_id").agg(
        F.max_by("choice_id", F.struct(F.col("loglik"), -F.col("choice_id"))).alias("chosen"),
        F.max(F.when(F.col("choice_id") == 0, F.col("loglik"))).alias("gold"))
    return pick.groupBy("task", "n_shots").agg(
        F.count(F.lit(1)).alias("n_items"), r6(F.avg(F.when(F.col("chosen") == 0, 1.0).otherwise(0.0))).alias("accuracy"),
        F.round(F.avg("gold"), 4).alias("mean_loglik"))
