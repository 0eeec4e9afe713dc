"""Vector, scalar and segment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiforge.functions import vectors as V
from lexiforge.operators import routing, segments
from lexiforge.operators.ordering import ordered_index
from lexiforge.plans.registry import register, table
from lexiforge.plans.routing_queries import SQL_GATES, gate_rows, r6

GROUPS = 4
SL, RATIO, HEADS = 16, 4, 6
ANGLES = V.sincos_angles(8)


def emb(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


def _explode(df, key, arr, name="v"):
    return df.select(key, F.posexplode(arr).alias("i", name)).select(key, F.col("i").cast("int"), r6(F.col(name)).alias(name))


SQL_X = "x AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"


def _sql_explode(list_expr: str) -> str:
    return (f"WITH {SQL_X}, y AS (SELECT vec_id, {list_expr} AS a FROM x) "
            "SELECT vec_id, CAST(unnest(range(0, len(a))) AS INTEGER) AS i, round(unnest(a) + 3.1e-10, 6) AS v FROM y")


@register("rms_norm", sql=_sql_explode(
    "list_transform(e, lambda v: v / sqrt(list_sum(list_transform(e, lambda y: y * y)) / len(e) + 1e-6))"))
def rms_norm(spark, sf_dir):
    return _explode(emb(spark, sf_dir), "vec_id", V.rms_norm(F.col("embedding")))


@register("group_norm", sql=f"""
WITH {SQL_X}, u AS (SELECT vec_id, unnest(e) AS v, unnest(range(0, len(e))) AS i FROM x),
g AS (SELECT *, avg(v) OVER w AS m, var_pop(v) OVER w AS s FROM u WINDOW w AS (PARTITION BY vec_id, i // (64 // {GROUPS})))
SELECT vec_id, CAST(i AS INTEGER) AS i, round((v - m) / sqrt(s + 1e-5) + 3.1e-10, 6) AS v FROM g""")
def group_norm(spark, sf_dir):
    return _explode(emb(spark, sf_dir), "vec_id", V.group_norm(F.col("embedding"), GROUPS))


@register("argmax_vec", sql="SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS argmax FROM embeddings")
def argmax_vec(spark, sf_dir):
    return emb(spark, sf_dir).select("vec_id", routing.argmax(F.col("embedding")).alias("argmax"))


@register("softmax_vec", sql=_sql_explode(
    "list_transform(e, lambda v: exp(v - list_max(e)) / list_sum(list_transform(e, lambda y: exp(y - list_max(e)))))"))
def softmax_vec(spark, sf_dir):
    return _explode(emb(spark, sf_dir), "vec_id", routing.softmax(F.col("embedding").cast("array<double>")))


@register("one_hot", sql="""
SELECT vec_id, array_to_string(list_transform(range(0, len(embedding)),
       lambda i: CASE WHEN i = list_position(embedding, list_max(embedding)) - 1 THEN 1 ELSE 0 END), ',') AS one_hot_csv FROM embeddings""")
def one_hot(spark, sf_dir):
    e = emb(spark, sf_dir)
    return e.select("vec_id", F.array_join(V.one_hot(routing.argmax(F.col("embedding")), 64), ",").alias("one_hot_csv"))


@register("cosine_gate", sql=f"WITH {SQL_GATES} SELECT vec_id, CAST(e AS INTEGER) AS e, round(logit + 3.1e-10, 6) AS logit FROM lg")
def cosine_gate(spark, sf_dir):
    g = gate_rows(spark, sf_dir)
    return g.select(F.col("row_id").alias("vec_id"), F.posexplode("logits").alias("e", "logit")).select(
        "vec_id", F.col("e").cast("int"), r6(F.col("logit")).alias("logit"))


@register("pad_multiple", sql="SELECT doc_id, CAST(CASE WHEN n_chars % 8 = 0 THEN 0 ELSE 8 - n_chars % 8 END AS BIGINT) AS pad FROM documents")
def pad_multiple(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", V.pad_to_multiple(F.col("n_chars"), 8).cast("bigint").alias("pad"))


def _sql_bucket(rel: str, bidirectional: bool, nb: int = 32, maxd: int = 128) -> str:
    """Counts the bucket starts up to the distance; the starts come from the power formula."""
    side = nb // 2 if bidirectional else nb
    half, rest = side // 2, side - side // 2
    starts = (f"list_concat(range(1, {half + 1}), list_transform(range(1, {rest}), lambda j: "
              f"CAST(ceil(round({half} * pow({maxd} / {half}, j / {rest}), 9)) AS BIGINT)))")
    distance = f"abs({rel})" if bidirectional else f"greatest(-({rel}), 0)"
    ahead = f" + CASE WHEN ({rel}) > 0 THEN {side} ELSE 0 END" if bidirectional else ""
    return f"CAST(len(list_filter({starts}, lambda d: d <= {distance})){ahead} AS INTEGER)"


_REL = "l_linenumber - CAST(l_quantity AS BIGINT)"


@register("log_bucket", sql=f"""
SELECT l_orderkey, l_linenumber, {_sql_bucket(_REL, True)} AS bucket_bi, {_sql_bucket(_REL, False)} AS bucket_causal FROM lineitem""")
def log_bucket(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    rel = F.col("l_linenumber") - F.col("l_quantity").cast("bigint")
    return li.select("l_orderkey", "l_linenumber", V.log_bucket(rel, True).alias("bucket_bi"),
                     V.log_bucket(rel, False).alias("bucket_causal"))


@register("sincos_features", sql=f"""
WITH a AS (SELECT event_id, hour(ts) AS p, {ANGLES!r} AS ang FROM events)
SELECT event_id, CAST(unnest(range(0, len(ang))) AS INTEGER) AS i, round(unnest(list_transform(ang, lambda x: sin(p * x))) + 3.1e-10, 6) AS s,
       round(unnest(list_transform(ang, lambda x: cos(p * x))) + 3.1e-10, 6) AS c FROM a""")
def sincos_features(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    s, c = V.sincos(F.hour("ts"), ANGLES)
    z = F.posexplode(F.arrays_zip(s.alias("s"), c.alias("c")))
    return ev.select("event_id", z.alias("i", "z")).select(
        "event_id", F.col("i").cast("int"), r6(F.col("z.s")).alias("s"), r6(F.col("z.c")).alias("c"))


@register("nan_clamp", sql="SELECT event_id, greatest(1.0, least(40.0, CASE WHEN isnan(value) THEN 0.0 ELSE value END)) AS v FROM events")
def nan_clamp(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", V.nan_clamp(F.col("value"), 1.0, 40.0).alias("v"))


@register("parse_int_list", sql="""
WITH s AS (SELECT l_orderkey, l_linenumber, CAST('[' || l_partkey || ', ' || l_suppkey || ']' AS BIGINT[]) AS a FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(len(a) AS INTEGER) AS n_items, CAST(list_sum(a) AS BIGINT) AS total FROM s""")
def parse_int_list(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    s = F.format_string("[%d, %d]", F.col("l_partkey"), F.col("l_suppkey"))
    a = V.parse_int_list(s)
    return li.select("l_orderkey", "l_linenumber", F.size(a).cast("int").alias("n_items"),
                     F.aggregate(a, F.lit(0).cast("bigint"), lambda x, y: x + y).alias("total"))


@register("stringify_map", sql="SELECT event_id, json_extract_string(props, '$.k') AS k_str FROM events")
def stringify_map(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    m = V.stringify_map(F.from_json("props", "map<string,int>"))
    return ev.select("event_id", F.element_at(m, F.lit("k")).alias("k_str"))


@register("format_ts", sql="SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts_str FROM events")
def format_ts(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", V.format_ts(F.col("ts")).alias("ts_str"))


# ---- segments over the long lineitem series --------------------------------------
SQL_LI = ("li AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS pos FROM lineitem), "
          f"h AS (SELECT unnest(range(0, {HEADS})) AS head), "
          f"d AS (SELECT pos, CAST(head AS INTEGER) AS head, pos // {SL} AS seg, l_extendedprice AS value, "
          f"(pos % {SL}) % {RATIO} = head // {-(-HEADS // RATIO)} AS sampled FROM li, h)")


def series(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                                 F.col("l_extendedprice").alias("value"))
    # (orderkey, linenumber) repeats in the generated data: order by a unique key
    return ordered_index(li, [], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "value"], "pos")


@register("segment_dilate", sql=f"WITH {SQL_LI} SELECT pos, head, seg, value FROM d WHERE sampled")
def segment_dilate(spark, sf_dir):
    d = segments.dilate(series(spark, sf_dir), "pos", SL, RATIO, HEADS)
    return d.filter("sampled").select("pos", F.col("head").cast("int"), "seg", "value")


@register("segment_densify", sql=f"""WITH {SQL_LI}
SELECT pos, head, CASE WHEN sampled THEN value ELSE 0.0 END AS value, CASE WHEN sampled THEN 1.0 ELSE 0.0 END AS weight FROM d""")
def segment_densify(spark, sf_dir):
    """The sampled rows alone, put back on the whole grid."""
    sampled = segments.dilate(series(spark, sf_dir), "pos", SL, RATIO, HEADS).filter("sampled").select("pos", "head", "value")
    return segments.densify(sampled, table(spark, sf_dir, "lineitem").count(), HEADS, "pos", "value")


@register("lse_merge", sql="""
WITH b AS (SELECT l_orderkey, l_extendedprice AS o, l_discount * 10 + l_tax * 5 AS lse FROM lineitem),
m AS (SELECT l_orderkey, max(lse) AS mx FROM b GROUP BY l_orderkey)
SELECT l_orderkey, round(sum(exp(lse - mx) * o) / sum(exp(lse - mx)) + 3.1e-10, 3) AS merged FROM b JOIN m USING (l_orderkey) GROUP BY l_orderkey""")
def lse_merge(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.col("l_extendedprice").alias("o"), (F.col("l_discount") * 10 + F.col("l_tax") * 5).alias("lse"))
    m = segments.lse_merge(li, ["l_orderkey"], "o", "lse")
    # price-scale values: 3 decimals keep a wide margin over the last bits
    return m.select("l_orderkey", F.round(F.col("merged") + 3.1e-10, 3).alias("merged"))
