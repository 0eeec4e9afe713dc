"""Next-token model queries (A1-A5, flagship): fit on train, score, loss, perplexity.

Every id of every document counts, in consecutive windows of SEQ_LEN.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiforge.operators import examples, ngram
from lexiforge.plans.example_queries import TOTAL, sql_with
from lexiforge.plans.params import BATCH_SIZE, MAX_ORDER, NGRAM_ALPHA, NUM_WORKERS, ORDER_PRIOR, SEQ_LEN, WORLD_SIZE
from lexiforge.plans.params import sql_token_ctes
from lexiforge.plans.registry import register
from lexiforge.plans.token_queries import byte_tokens, byte_vocab, learned_tokens
from lexiforge.session import stored


class Model:
    """Byte-level tokens, pair counts by split and the counts of the training split."""

    def __init__(self, spark, sf_dir, tokens=None, vocab_size=None):
        if tokens is None:
            self.lut, self.vocab_hex, vocab_size = byte_vocab(spark, sf_dir)
            tokens = byte_tokens(spark, sf_dir, self.lut)
        self.tokens, self.vocab_size = tokens, vocab_size
        self.pairs = stored(ngram.pair_counts(tokens.select("split", "ids"), SEQ_LEN), "pair-counts")
        self.counts = ngram.get_scorer("ngram").fit(self.pairs.filter(F.col("split") == "train"))

    def scored_pairs(self, splits=("validation", "test")):
        """(split, prev_id, next_id, n, logp)."""
        ev = self.pairs.filter(F.col("split").isin(*splits))
        return ngram.get_scorer("ngram", alpha=NGRAM_ALPHA).score(ev, self.counts, self.vocab_size)

    def losses(self, splits=("validation", "test")):
        """(split, n, loss): positions and their mean loss."""
        s = self.scored_pairs(splits)
        return s.groupBy("split").agg(F.sum("n").alias("n"), (F.sum(-F.col("logp") * F.col("n")) / F.sum("n")).alias("loss"))

    def scored_positions(self, splits=("validation", "test")):
        """(doc_id, split, win, pos, logp): one row per position."""
        t = self.tokens.filter(F.col("split").isin(*splits))
        pos = ngram.window_positions(t, ("doc_id", "split"), SEQ_LEN)
        lp = stored(self.scored_pairs(splits).select("prev_id", "next_id", "logp").distinct(), "logp")
        return pos.join(lp, ["prev_id", "next_id"]).select("doc_id", "split", "win", "pos", "logp")


def window_shards(spark, sf_dir):
    """(doc_id, split, win, rank, worker, batch_id): the shard of every window; keys only, no text, no ids."""
    from lexiforge.plans.corpus_queries import split_docs
    n = F.octet_length("text") + 1  # byte-level ids with <bos>
    last = F.floor((n - 1) / SEQ_LEN)
    w = split_docs(spark, sf_dir).select("doc_id", "split", F.explode(F.sequence(F.lit(0), last)).alias("win"))
    return examples.with_shards(w, ["doc_id", "win"], WORLD_SIZE, NUM_WORKERS, BATCH_SIZE, by=("split",))


def batch_losses(spark, sf_dir):
    """(split, rank, worker, batch_id, loss, n): sums by window first, then by the window's batch."""
    s = Model(spark, sf_dir).scored_positions()
    win = s.groupBy("doc_id", "split", "win").agg(F.sum(-F.col("logp")).alias("loss"), F.count(F.lit(1)).alias("n"))
    return win.join(window_shards(spark, sf_dir), ["doc_id", "split", "win"]).groupBy("split", "rank", "worker", "batch_id").agg(
        (F.sum("loss") / F.sum("n")).alias("loss"), F.sum("n").alias("n"))


def sql_positions() -> list:
    """CTEs on top of toks: every position of every window, counts and logs of the train split, batches."""
    pads = f"({SEQ_LEN} - len(ids) % {SEQ_LEN}) % {SEQ_LEN}"
    zeros = "list_transform(range(0, {}), lambda j: 0::BIGINT)"
    return [
        f"pos AS (SELECT doc_id, split, i // {SEQ_LEN} AS win, CAST(i % {SEQ_LEN} AS INTEGER) AS pos, prev_id, next_id FROM "
        f"(SELECT doc_id, split, unnest(range(0, len(ids) + {pads})) AS i, "
        f"unnest(list_concat(ids, {zeros.format(pads)})) AS prev_id, "
        f"unnest(list_concat(ids[2:], {zeros.format('1 + ' + pads)})) AS next_id FROM toks))",
        "cnt AS (SELECT prev_id, next_id, count(*) AS cnt FROM pos WHERE split = 'train' GROUP BY ALL)",
        "tot AS (SELECT prev_id, sum(cnt) AS ctx_cnt FROM cnt GROUP BY prev_id)",
        "vsize AS (SELECT max(vocab_size) AS vocab_size FROM alpha_map)",
        f"scored AS (SELECT p.*, ln((coalesce(c.cnt, 0) + {NGRAM_ALPHA}) / (coalesce(t.ctx_cnt, 0) + {NGRAM_ALPHA} * vocab_size)) AS logp "
        "FROM pos p LEFT JOIN cnt c USING (prev_id, next_id) LEFT JOIN tot t USING (prev_id), vsize "
        "WHERE p.split IN ('validation', 'test'))",
        "widx AS (SELECT doc_id, split, win, row_number() OVER (PARTITION BY split ORDER BY doc_id, win) - 1 AS row_idx "
        f"FROM (SELECT doc_id, split, unnest(range(0, (len(ids) + {SEQ_LEN - 1}) // {SEQ_LEN})) AS win FROM toks))",
        f"wsh AS (SELECT doc_id, split, win, CAST((row_idx % {TOTAL}) // {NUM_WORKERS} AS INTEGER) AS rank, "
        f"CAST(row_idx % {NUM_WORKERS} AS INTEGER) AS worker, (row_idx // {TOTAL}) // {BATCH_SIZE} AS batch_id FROM widx)",
        "bl AS (SELECT split, rank, worker, batch_id, avg(-logp) AS loss, count(*) AS n "
        "FROM scored JOIN wsh USING (doc_id, split, win) GROUP BY ALL)",
    ]


SQL_MODEL = sql_positions()


@register("ngram_fit", sql=f"""{sql_with(*SQL_MODEL)}
SELECT prev_id, next_id, cnt FROM cnt""")
def ngram_fit(spark, sf_dir):
    return Model(spark, sf_dir).counts.select("prev_id", "next_id", "cnt")


@register("ngram_score", sql=f"""{sql_with(*SQL_MODEL)}
SELECT doc_id, split, win, pos, round(logp, 6) AS logp FROM scored""")
def ngram_score(spark, sf_dir):
    s = Model(spark, sf_dir).scored_positions()
    return s.select("doc_id", "split", "win", "pos", F.round("logp", 6).alias("logp"))


@register("mean_loss", sql=f"""{sql_with(*SQL_MODEL)}
SELECT split, round(avg(-logp), 6) AS mean_loss, count(*) AS n_positions FROM scored GROUP BY split""")
def mean_loss(spark, sf_dir):
    return Model(spark, sf_dir).losses().select("split", F.round("loss", 6).alias("mean_loss"), F.col("n").alias("n_positions"))


@register("perplexity", sql=f"""{sql_with(*SQL_MODEL)}
SELECT split, round(avg(exp(loss)), 6) AS perplexity_mean_of_batches,
       round(exp(sum(loss * n) / sum(n)), 6) AS perplexity_of_mean, count(*) AS n_batches
FROM bl GROUP BY split""")
def perplexity(spark, sf_dir):
    return batch_losses(spark, sf_dir).groupBy("split").agg(
        F.round(F.avg(F.exp("loss")), 6).alias("perplexity_mean_of_batches"),
        F.round(F.exp(F.sum(F.col("loss") * F.col("n")) / F.sum("n")), 6).alias("perplexity_of_mean"),
        F.count(F.lit(1)).alias("n_batches"))


@register("metrics_rollup", sql=f"""{sql_with(*SQL_MODEL)}
SELECT split, batch_id AS step, round(sum(loss * n) / sum(n), 6) AS loss, CAST(sum(n) AS BIGINT) AS n_positions
FROM bl GROUP BY ROLLUP (split, batch_id)""")
def metrics_rollup(spark, sf_dir):
    """Step-level (synchronised across shards) and epoch-level loss in one pass."""
    return batch_losses(spark, sf_dir).rollup("split", F.col("batch_id").alias("step")).agg(
        F.round(F.sum(F.col("loss") * F.col("n")) / F.sum("n"), 6).alias("loss"), F.sum("n").alias("n_positions"))


@register("guess_baseline", sql=f"""{sql_with(*SQL_MODEL)}
SELECT split, round(ln(any_value(vocab_size)), 6) AS guess_loss, round(avg(-logp), 6) AS mean_loss,
       round(avg(-logp) / ln(any_value(vocab_size)), 6) AS loss_ratio
FROM scored, alpha_map GROUP BY split""")
def guess_baseline(spark, sf_dir):
    m = Model(spark, sf_dir)
    g = ngram.guess_loss(m.vocab_size)
    return m.losses().select("split", F.round(F.lit(g), 6).alias("guess_loss"), F.round("loss", 6).alias("mean_loss"),
                             F.round(F.col("loss") / F.lit(g), 6).alias("loss_ratio"))


SQL_HELD_OUT = "SELECT g.*, 1.0 / vocab_size AS p0 FROM g, alpha_map WHERE split IN ('validation', 'test')"


def sql_orders(evaluated: str = SQL_HELD_OUT) -> str:
    """CTEs g (counts of contexts) to s<MAX_ORDER>: ``evaluated`` (w, q<j>, p0, ...) with p1 ... p<MAX_ORDER>. Every level joins its counts and totals to the aggregated contexts; q<j> is the id j places before w, s<k> holds p0 ... p<k>."""
    back = range(1, MAX_ORDER)
    shifted = ", ".join(f"unnest(list_concat([{', '.join(['NULL::BIGINT'] * (j - 1))}], ids[:-{j + 1}])) AS q{j}" for j in back)
    out = [f"g AS MATERIALIZED (SELECT split, {', '.join(f'q{j}' for j in back)}, w, count(*) AS n FROM "
           f"(SELECT split, unnest(ids[2:]) AS w, {shifted} FROM toks) WHERE w IS NOT NULL GROUP BY ALL)",
           f"s0 AS ({evaluated})"]
    for k in range(MAX_ORDER):
        cols = ", ".join(f"q{j}" for j in range(1, k + 1))
        known = f"AND q{k} IS NOT NULL" if k else ""
        same = " AND ".join(f"{{0}}.q{j} = s.q{j}" for j in range(1, k + 1)) or "true"
        out += [f"c{k} AS MATERIALIZED (SELECT {cols + ', ' if k else ''}w, sum(n) AS cnt FROM g WHERE split = 'train' {known} GROUP BY ALL)",
                f"t{k} AS MATERIALIZED (SELECT {cols + ', ' if k else ''}sum(cnt) AS tot FROM c{k} GROUP BY ALL)",
                f"s{k + 1} AS MATERIALIZED (SELECT s.*, coalesce((coalesce(cnt, 0) + {ORDER_PRIOR} * p{k}) / (tot + {ORDER_PRIOR}), p{k}) AS p{k + 1} "
                f"FROM s{k} s LEFT JOIN c{k} ON c{k}.w = s.w AND {same.format(f'c{k}')} LEFT JOIN t{k} ON {same.format(f't{k}')})"]
    return ", ".join(out)


@register("ngram_orders", sql=f"""WITH {sql_token_ctes()}, {sql_orders()}
SELECT split, n_order, CAST(sum(n) AS BIGINT) AS n_positions, round(sum(-ln(p) * n) / sum(n), 6) AS mean_loss,
       round(exp(sum(-ln(p) * n) / sum(n)), 6) AS perplexity
FROM (SELECT split, n, unnest(range(1, {MAX_ORDER + 1}))::INTEGER AS n_order, unnest([{', '.join(f'p{k + 1}' for k in range(MAX_ORDER))}]) AS p
      FROM s{MAX_ORDER}) GROUP BY split, n_order""")
def ngram_orders(spark, sf_dir):
    """Loss and perplexity of models of order 1 to MAX_ORDER over whole texts, from one table of aggregated contexts."""
    lut, _, vocab_size = byte_vocab(spark, sf_dir)
    grams = stored(ngram.context_counts(byte_tokens(spark, sf_dir, lut), MAX_ORDER), "contexts")
    ev, train = grams.filter("split <> 'train'"), grams.filter("split = 'train'")
    p = ngram.score_orders(ev, train, MAX_ORDER, vocab_size, ORDER_PRIOR)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("n_order"), F.col(f"p{k}").alias("p")) for k in range(1, MAX_ORDER + 1)]))
    loss = F.sum(-F.log("p") * F.col("n")) / F.sum("n")
    return p.select("split", "n", each.alias("o")).select("split", "n", "o.n_order", "o.p").groupBy("split", "n_order").agg(
        F.sum("n").alias("n_positions"), F.round(loss, 6).alias("mean_loss"), F.round(F.exp(loss), 6).alias("perplexity"))


@register("flagship_perplexity")
def flagship_perplexity(spark, sf_dir):
    """Split, learn a tokenizer, save and load it, encode, fit on train, perplexity on validation."""
    enc, tok = learned_tokens(spark, sf_dir)
    m = Model(spark, sf_dir, stored(enc, "tokenized"), len(tok.vocab_hex))
    return m.losses(("validation",)).select("split", F.col("n").alias("n_positions"), F.round("loss", 6).alias("mean_loss"),
                                            F.round(F.exp("loss"), 6).alias("perplexity"))
