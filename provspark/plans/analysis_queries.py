"""Weights, breakdowns, feature tables and message streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from provspark.functions import text as X
from provspark.functions import vectors as V
from provspark.functions.numeric import fit_within
from provspark.operators import breakdowns as B
from provspark.operators import features as E
from provspark.operators import messages as G
from provspark.operators import weights as W
from provspark.plans.fixtures import table, view
from provspark.plans.oracle import auc_ctes, hash60_sql
from provspark.plans.registry import query
from provspark.sources.exports import html_pages


def r6(column, name=None):
    name = name or column
    return F.round(F.col(column) if isinstance(column, str) else column, 6).alias(name)


def r9(column):
    return F.round(column, 9).alias(column)


# --- weights --------------------------------------------------------------------------------------------------------

WEIGHTED = """cls AS (SELECT item_id, label, source, rating, real_score, CASE WHEN label = 0
        THEN (SELECT count(*) FROM items i WHERE i.label = 1)::DOUBLE / (SELECT count(*) FROM items i WHERE i.label = 0) ELSE 1 END AS a,
      1.0::DOUBLE / count(*) OVER (PARTITION BY source) AS b,
      0.5::DOUBLE / (SELECT count(DISTINCT i.source) FROM items i WHERE i.label = items.label) / count(*) OVER (PARTITION BY label, source) AS c
    FROM items),
    wt AS (SELECT item_id, label, source, rating, real_score, a / avg(a) OVER () AS a, b / avg(b) OVER () AS b, c / avg(c) OVER () AS c FROM cls)"""


@query(
    "a13_balanced_weights",
    f"WITH {WEIGHTED} SELECT item_id, round(a, 9) AS by_class, round(b, 9) AS by_source, round(c, 9) AS by_both FROM wt",
)
def a13(spark, sf):
    items = view(spark, sf, "items").select("item_id", "label", "source")
    out = W.balanced_weights(items, "class", weight="by_class")
    out = W.balanced_weights(out, "source", weight="by_source")
    out = W.balanced_weights(out, "both", weight="by_both")
    return out.select("item_id", r9("by_class"), r9("by_source"), r9("by_both"))


@query(
    "a14_merge_weight_groups",
    """WITH g AS (SELECT item_id, label, CASE WHEN source IN ('src0', 'src1', 'src2') THEN 'merged' ELSE source END AS g FROM items),
    c AS (SELECT *, 0.5::DOUBLE / (SELECT count(DISTINCT x.g) FROM g x WHERE x.label = g.label) / count(*) OVER (PARTITION BY label, g) AS w FROM g)
    SELECT item_id, g AS weight_group, round(w / avg(w) OVER (), 9) AS w FROM c""",
)
def a14(spark, sf):
    items = view(spark, sf, "items").select("item_id", "label", "source")
    merged = W.merge_weight_groups(items, {"merged": ["src0", "src1", "src2"]})
    out = W.balanced_weights(merged, "both", source="weight_group")
    return out.select("item_id", "weight_group", r9("w"))


@query(
    "a15_equalise_covariate",
    f"""WITH {WEIGHTED}, m AS (SELECT label, rating, sum(c) AS m FROM wt WHERE rating >= 0 GROUP BY label, rating),
    p AS (SELECT label, rating, m / sum(m) OVER (PARTITION BY label) AS p FROM m),
    t AS (SELECT rating, sum(p) / 2.0::DOUBLE AS t FROM p GROUP BY rating),
    f AS (SELECT p.label, p.rating, least(10.0::DOUBLE, greatest(0.1::DOUBLE, t.t / p.p)) AS f FROM p JOIN t ON t.rating = p.rating),
    x AS (SELECT wt.item_id, wt.c * coalesce(f.f, 1.0::DOUBLE) AS w FROM wt LEFT JOIN f ON f.label = wt.label AND f.rating = wt.rating)
    SELECT item_id, round(w / avg(w) OVER (), 9) AS w FROM x""",
)
def a15(spark, sf):
    items = view(spark, sf, "items").select("item_id", "label", "source", "rating")
    return W.equalise_covariate(W.balanced_weights(items, "both"), "rating").select("item_id", r9("w"))


@query(
    "a16_hard_negative_weight",
    f"""WITH {WEIGHTED}, q AS (SELECT quantile_cont(real_score, 0.9) AS q FROM items WHERE label = 0),
    x AS (SELECT item_id, CASE WHEN label = 0 AND real_score >= q.q THEN c * 3 ELSE c END AS w FROM wt, q)
    SELECT item_id, round(w / avg(w) OVER (), 9) AS w FROM x""",
)
def a16(spark, sf):
    items = view(spark, sf, "items").select("item_id", "label", "source", "real_score")
    return W.hard_negative_weight(W.balanced_weights(items, "both"), "real_score", 0.1, 3.0).select("item_id", r9("w"))


# --- breakdowns -----------------------------------------------------------------------------------------------------


@query(
    "a01_source_split_table",
    """WITH s AS (SELECT source, creator AS grp, CASE WHEN rating = 0 THEN 'test' WHEN rating = 1 THEN 'val' ELSE 'train' END AS split FROM items)
    SELECT source, CAST(count(CASE WHEN split = 'train' THEN 1 END) AS BIGINT) AS train, CAST(count(CASE WHEN split = 'val' THEN 1 END) AS BIGINT) AS val,
           CAST(count(CASE WHEN split = 'test' THEN 1 END) AS BIGINT) AS test, CAST(count(DISTINCT grp) AS BIGINT) AS creators FROM s GROUP BY source""",
)
def a01(spark, sf):
    split = F.when(F.col("rating") == 0, "test").when(F.col("rating") == 1, "val").otherwise("train")
    items = view(spark, sf, "items").select("source", F.col("creator").alias("grp"), split.alias("split"))
    return B.source_split_table(items)


@query(
    "a02_rating_mix",
    """SELECT source, rating, CAST(count(*) AS BIGINT) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY source)::DOUBLE, 6) AS share
    FROM items WHERE rating >= 0 GROUP BY source, rating""",
)
def a02(spark, sf):
    return B.rating_mix(view(spark, sf, "items")).select("source", "rating", "n", r6("share"))


@query(
    "a17_distinct_group_rate",
    """WITH g AS (SELECT md5(text) AS g, max(toxic) AS f, sum(toxic) AS k, count(*) AS n FROM items GROUP BY 1)
    SELECT round(avg(f), 6) AS group_rate, round(sum(k) / sum(n)::DOUBLE, 6) AS row_rate, CAST(count(*) AS BIGINT) AS n_groups FROM g""",
)
def a17(spark, sf):
    rows = view(spark, sf, "items").select(F.md5("text").alias("g"), (F.col("toxic") == 1).alias("f"))
    return B.distinct_group_rate(rows, "g", "f").select(r6("group_rate"), r6("row_rate"), "n_groups")


@query(
    "a18_category_breakdown",
    """WITH c AS (SELECT item_id, md5(text) AS g, real_score >= 0.3 AS f, CASE WHEN toxic = 1 THEN 'photo' WHEN n_chars > 3000 THEN 'text'
        WHEN rating = 2 THEN 'sheet' ELSE 'other' END AS category FROM items),
    p AS (SELECT category, count(*) AS posts FROM c WHERE f GROUP BY category),
    i AS (SELECT category, count(*) AS images FROM (SELECT category, row_number() OVER (PARTITION BY g ORDER BY item_id) AS rn FROM c WHERE f)
          WHERE rn = 1 GROUP BY category)
    SELECT p.category, CAST(p.posts AS BIGINT) AS posts, CAST(coalesce(i.images, 0) AS BIGINT) AS images,
           round(coalesce(i.images, 0) / (SELECT count(DISTINCT g) FROM c)::DOUBLE, 6) AS share
    FROM p LEFT JOIN i ON i.category = p.category""",
)
def a18(spark, sf):
    category = (
        F.when(F.col("toxic") == 1, "photo").when(F.col("n_chars") > 3000, "text").when(F.col("rating") == 2, "sheet")
    )
    rows = view(spark, sf, "items").select(
        "item_id", F.md5("text").alias("g"), (F.col("real_score") >= 0.3).alias("f"), category.otherwise("other").alias("category")
    )
    return B.category_breakdown(rows, "category", "g", "item_id", "f").select("category", "posts", "images", r6("share"))


@query(
    "a19_binned_rate",
    """WITH b AS (SELECT CASE WHEN w >= 0 AND w < 600 THEN '0-600' WHEN w >= 600 AND w < 800 THEN '600-800' WHEN w >= 800 AND w < 1200 THEN '800-1200'
        WHEN w >= 1200 AND w < 1281 THEN '1200-1281' WHEN w >= 1281 AND w < 1999 THEN '1281-1999' END AS bin, real_score < 0.5 AS m FROM items)
    SELECT bin, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN m THEN 1.0::DOUBLE ELSE 0 END), 6) AS rate FROM b WHERE bin IS NOT NULL
    GROUP BY bin HAVING count(*) >= 30""",
)
def a19(spark, sf):
    rows = view(spark, sf, "items").withColumn("missed", F.col("real_score") < 0.5)
    return B.binned_rate(rows, "w", [0, 600, 800, 1200, 1281, 1999], "missed").select("bin", "n", r6("rate"))


@query(
    "a20_split_medians",
    """SELECT real_score < 0.5 AS missed, 'n_chars' AS covariate, round(quantile_cont(n_chars, 0.5), 6) AS median FROM items GROUP BY 1
    UNION ALL SELECT real_score < 0.5, 'w', round(quantile_cont(w, 0.5), 6) FROM items GROUP BY 1""",
)
def a20(spark, sf):
    rows = view(spark, sf, "items").withColumn("missed", F.col("real_score") < 0.5)
    return B.split_medians(rows, "missed", ["n_chars", "w"]).select("missed", "covariate", r6("median"))


@query(
    "a21_quarterly_rate",
    """WITH q AS (SELECT CASE WHEN contains(name, '@') THEN concat(CAST(year(day) AS VARCHAR), '-Q', CAST(quarter(day) AS VARCHAR)) ELSE '?' END AS quarter,
        source = 'F' AS m FROM files)
    SELECT quarter, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN m THEN 1.0::DOUBLE ELSE 0 END), 6) AS rate FROM q GROUP BY quarter HAVING count(*) >= 20""",
)
def a21(spark, sf):
    rows = view(spark, sf, "files").select(
        X.quarter_label(X.file_date(F.col("name"))).alias("quarter"), (F.col("source") == "F").alias("missed")
    )
    return B.grouped_rate(rows, "quarter", "missed", 20).select("quarter", "n", r6("rate"))


@query(
    "a22_tag_lift",
    """WITH t AS (SELECT unnest(list_distinct(string_split(tag_string, ' '))) AS tag, real_score < 0.5 AS m FROM items),
    r AS (SELECT tag, count(*) AS n, avg(CASE WHEN m THEN 1.0::DOUBLE ELSE 0 END) AS rate FROM t GROUP BY tag HAVING count(*) >= 60),
    o AS (SELECT *, row_number() OVER (ORDER BY rate DESC, tag) AS hi, row_number() OVER (ORDER BY rate, tag) AS lo FROM r)
    SELECT 'high' AS "end", tag, CAST(n AS BIGINT) AS n, round(rate, 6) AS rate FROM o WHERE hi <= 5
    UNION ALL SELECT 'low', tag, CAST(n AS BIGINT), round(rate, 6) FROM o WHERE lo <= 3""",
)
def a22(spark, sf):
    rows = view(spark, sf, "items").select(
        X.split_tags(F.col("tag_string")).alias("tags"), (F.col("real_score") < 0.5).alias("missed")
    )
    return B.tag_lift(rows, "tags", "missed", 60, 5, 3).select("end", "tag", "n", r6("rate"))


@query(
    "a23_strata_fpr",
    """WITH n AS (SELECT * FROM items WHERE label = 0), q AS (SELECT quantile_cont(n_chars, 0.95) AS q FROM n),
    t AS (SELECT unnest(list_distinct(string_split(tag_string, ' '))) AS stratum, n_chars > q.q AS f FROM n, q)
    SELECT stratum, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN f THEN 1.0::DOUBLE ELSE 0 END), 6) AS rate FROM t GROUP BY stratum HAVING count(*) >= 50""",
)
def a23(spark, sf):
    rows = view(spark, sf, "items").where("label = 0").select("n_chars", X.split_tags(F.col("tag_string")).alias("tags"))
    return B.strata_fpr(rows, "n_chars", "tags", 0.05).select("stratum", "n", r6("rate"))


@query(
    "a24_stratified_auc",
    f"""WITH src AS (SELECT rating, 'x' AS grp, CASE WHEN label = 0 THEN 1 ELSE 0 END AS neg, real_score AS score FROM items), {auc_ctes('src', 'rating')}
    SELECT rating, n_pos, n_neg, round(auc, 6) AS auc FROM auc_r WHERE n_pos >= 30 AND n_neg >= 30""",
)
def a24(spark, sf):
    rows = view(spark, sf, "items").select("rating", "label", F.col("real_score").alias("score"))
    return B.stratified_auc(rows, "rating").select("rating", "n_pos", "n_neg", r6("auc"))


@query(
    "a27_spearman",
    """WITH h AS (SELECT score, CAST(item_id % 97 AS DOUBLE) + score / 3 AS d FROM scores WHERE kind = 'm_test'),
    r AS (SELECT score, d, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS rs,
                 rank() OVER (ORDER BY d) + (count(*) OVER (PARTITION BY d) - 1) / 2.0::DOUBLE AS rd FROM h),
    q AS (SELECT quantile_cont(score, 0.99) AS t, quantile_cont(d, 0.25) AS a, quantile_cont(d, 0.75) AS b FROM h)
    SELECT round(corr(rs, rd), 6) AS rho, round(avg(CASE WHEN d < a THEN CASE WHEN score > t THEN 1.0::DOUBLE ELSE 0 END END), 6) AS near_rate,
           round(avg(CASE WHEN d > b THEN CASE WHEN score > t THEN 1.0::DOUBLE ELSE 0 END END), 6) AS far_rate, CAST(count(*) AS BIGINT) AS n FROM r, q""",
)
def a27(spark, sf):
    rows = view(spark, sf, "scores").where("kind = 'm_test'").select(
        "score", ((F.col("item_id") % 97).cast("double") + F.col("score") / 3).alias("d")
    )
    return B.quartile_contrast(rows, "score", "d").select(r6("rho"), r6("near_rate"), r6("far_rate"), "n")


@query("a31_latest_decision", "SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def a31(spark, sf):
    return B.latest_decision(table(spark, sf, "events"), "user_id", "event_id", "event_type")


@query(
    "a32_single_feature_auc",
    f"""WITH f AS (SELECT label, w, h, n_chars, CAST(greatest(1, round_even(w * least(1.0::DOUBLE, 700.0::DOUBLE / greatest(w, h, 1)), 0)) AS INTEGER) AS w_fit FROM items),
    src AS (SELECT 'w' AS feature, 'x' AS grp, 1 - label AS neg, w::DOUBLE AS score FROM f UNION ALL SELECT 'h', 'x', 1 - label, h FROM f
       UNION ALL SELECT 'n_chars', 'x', 1 - label, n_chars FROM f UNION ALL SELECT 'w_fit', 'x', 1 - label, w_fit FROM f), {auc_ctes('src', 'feature')}
    SELECT feature, round(greatest(auc, 1 - auc), 6) AS separation FROM auc_r""",
)
def a32(spark, sf):
    rows = view(spark, sf, "items").withColumn("w_fit", fit_within(F.col("w"), F.col("h"), 700)[0])
    return B.single_feature_auc(rows, ["w", "h", "n_chars", "w_fit"]).select("feature", r6("separation"))


@query(
    "a33_triage_sample",
    f"""WITH r AS (SELECT s.*, row_number() OVER (PARTITION BY grp ORDER BY {hash60_sql("'5'", 'item_id')}, item_id) AS rn FROM scores s),
    k AS (SELECT grp, CASE WHEN score < 0.05 THEN NULL ELSE score END AS score, user_id % 10 = 0 AS photo FROM r WHERE rn <= 300)
    SELECT grp, CAST(count(*) AS BIGINT) AS n, CAST(count(score) AS BIGINT) AS scored, CAST(count(CASE WHEN photo THEN 1 END) AS BIGINT) AS photos,
           round(avg(CASE WHEN score > 8 THEN 1.0::DOUBLE WHEN score IS NOT NULL THEN 0 END), 6) AS above_1,
           round(avg(CASE WHEN score > 5 THEN 1.0::DOUBLE WHEN score IS NOT NULL THEN 0 END), 6) AS above_5, round(quantile_cont(score, 0.5), 6) AS median
    FROM k GROUP BY grp""",
)
def a33(spark, sf):
    rows = view(spark, sf, "scores").select(
        "grp", "item_id", F.when(F.col("score") >= 0.05, F.col("score")).alias("score"), (F.col("user_id") % 10 == 0).alias("photo")
    )
    out = B.triage_sample(rows, ["grp"], "item_id", 300, 8.0, 5.0)
    return out.select("grp", "n", "scored", "photos", r6("above_1"), r6("above_5"), r6("median"))


@query(
    "a37_mean_vector",
    """SELECT grp, CAST(dim AS INTEGER) AS dim, round(avg(x), 6) AS value FROM (SELECT grp, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim
    FROM features) GROUP BY grp, dim""",
)
def a37(spark, sf):
    return B.mean_vector(view(spark, sf, "features"), ["grp"], "embedding").select("grp", "dim", r6("value"))


@query(
    "a40_flag_leaders",
    """SELECT owner, CAST(count(CASE WHEN size > 300000 THEN 1 END) AS BIGINT) AS flags, CAST(count(*) AS BIGINT) AS size FROM files
    GROUP BY owner ORDER BY flags DESC, owner LIMIT 10""",
)
def a40(spark, sf):
    rows = view(spark, sf, "files").select("owner", (F.col("size") > 300000).alias("f"))
    return B.flag_leaders(rows, "owner", "f", 10)


@query(
    "a41_provable_age_rates",
    """WITH r AS (SELECT source, CASE WHEN NOT contains(name, '@') THEN 'undated' WHEN day < DATE '1998-01-01' THEN 'provable' ELSE 'recent' END AS age,
        CASE WHEN regexp_extract(name, '_(\\d{3,4})x', 1) = '' THEN 'unknown' WHEN CAST(regexp_extract(name, '_(\\d{3,4})x', 1) AS INTEGER) <= 2560
             THEN '<=2560 px' ELSE '>2560 px' END AS px, size > 400000 AS f
        FROM files WHERE file_id IN (SELECT min(file_id) FROM files GROUP BY owner, source))
    SELECT 'age' AS strata, coalesce(source, 'all') AS source, coalesce(age, 'all') AS age, CAST(count(*) AS BIGINT) AS n,
           CAST(count(CASE WHEN f THEN 1 END) AS BIGINT) AS flags, round(avg(CASE WHEN f THEN 1.0::DOUBLE ELSE 0 END), 6) AS fpr
    FROM r GROUP BY CUBE (source, age)
    UNION ALL SELECT 'px', 'all', px, CAST(count(*) AS BIGINT), CAST(count(CASE WHEN f THEN 1 END) AS BIGINT),
           round(avg(CASE WHEN f THEN 1.0::DOUBLE ELSE 0 END), 6) FROM r WHERE px <> 'unknown' GROUP BY px""",
)
def a41(spark, sf):
    width = X.parse_resolution(F.col("name"))
    day = X.file_date(F.col("name"))
    files = view(spark, sf, "files")
    first = files.groupBy("owner", "source").agg(F.min("file_id").alias("item_id"))  # the others stand for its duplicates
    rows = files.select(
        F.col("file_id").alias("item_id"), "source", F.when(day.isNull(), "undated").when(day < F.lit("1998-01-01").cast("date"), "provable").otherwise("recent").alias("age"),
        F.when(width == 0, None).when(width <= 2560, "<=2560 px").otherwise(">2560 px").alias("px"), (F.col("size") > 400000).alias("f"),
    )
    ages = B.provable_age_rates(rows, "source", "age", "f", first).select(F.lit("age").alias("strata"), "source", "age", "n", "flags", r6("fpr"))
    sizes = B.provable_age_rates(rows.where("px is not null").withColumn("source", F.lit("all")), "source", "px", "f", first)
    sizes = sizes.where("px <> 'all'").distinct().select(F.lit("px").alias("strata"), "source", F.col("px").alias("age"), "n", "flags", r6("fpr"))
    return ages.unionByName(sizes)


@query("t02_most_common", "SELECT creator, CAST(count(*) AS BIGINT) AS n FROM items WHERE creator IS NOT NULL GROUP BY creator ORDER BY n DESC, creator LIMIT 25")
def t02(spark, sf):
    return B.most_common(view(spark, sf, "items").where("creator is not null"), "creator", 25)


# --- features -------------------------------------------------------------------------------------------------------


def backbones(spark, sf):
    f = view(spark, sf, "features")
    a = f.select("item_id", F.slice("embedding", 1, 32).alias("vec"))
    b = f.where("grp <> 3").select("item_id", F.slice("embedding", 33, 32).alias("vec"))
    return f, a, b


@query(
    "j05_align_features",
    """SELECT item_id, CAST(len(embedding) AS INTEGER) AS dim, round(embedding[33]::DOUBLE, 6) AS x33 FROM features WHERE grp <> 3""",
)
def j05(spark, sf):
    _, a, b = backbones(spark, sf)
    out = E.align_features({"A": a, "B": b})
    return out.select("item_id", F.size("vec").alias("dim"), F.round(F.get("vec", F.lit(32)).cast("double"), 6).alias("x33"))


@query(
    "p16_select_backbone_columns",
    "SELECT item_id, CAST(32 AS INTEGER) AS dim, round(embedding[33]::DOUBLE, 6) AS first FROM features",
)
def p16(spark, sf):
    block = V.select_blocks(F.col("embedding"), ["A", "B"], {"A": 32, "B": 32}, ["B"])
    rows = view(spark, sf, "features").select("item_id", block.alias("v"))
    return rows.select("item_id", F.size("v").alias("dim"), F.round(F.get("v", F.lit(0)).cast("double"), 6).alias("first"))


@query(
    "a11_feature_moments",
    """SELECT CAST(dim AS INTEGER) AS dim, round(avg(x), 6) AS mean, round(sqrt(greatest(var_pop(x), 1e-12)), 6) AS scale
    FROM (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM features) GROUP BY dim""",
)
def a11(spark, sf):
    return B.feature_moments(view(spark, sf, "features"), "embedding").select("dim", r6("mean"), r6("scale"))


@query(
    "a12_standardise",
    """WITH e AS (SELECT item_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM features),
    m AS (SELECT dim, avg(x) AS mean, sqrt(greatest(var_pop(x), 1e-12)) AS scale FROM e GROUP BY dim)
    SELECT item_id, round(sum(abs((x - mean) / scale)), 6) AS l1, round(max((x - mean) / scale), 6) AS top FROM e JOIN m ON m.dim = e.dim GROUP BY item_id""",
)
def a12(spark, sf):
    f = view(spark, sf, "features")
    moments = B.feature_moments(f, "embedding").orderBy("dim").collect()  # one row per dimension
    mean, scale = (F.array(*[F.lit(r[c]) for r in moments]) for c in ("mean", "scale"))
    z = f.select("item_id", V.standardise(F.col("embedding"), mean, scale).alias("z"))
    return z.select("item_id", F.round(F.aggregate("z", F.lit(0.0), lambda a, x: a + F.abs(x)), 6).alias("l1"), F.round(F.array_max("z"), 6).alias("top"))


@query(
    "s11_read_features",
    "SELECT item_id, grp, CAST(len(embedding) AS INTEGER) AS dim FROM features WHERE label = 1",
)
def s11(spark, sf):
    rows = view(spark, sf, "features").withColumns(
        {"backbone": F.when(F.col("label") == 1, "A").otherwise("B"), "variant": F.lit("clean")}
    )
    return E.read_features(rows, "A", "clean").select("item_id", "grp", F.size("embedding").alias("dim"))


@query("s07_read_parquet_cols", "SELECT doc_id, lang FROM documents")
def s07(spark, sf):
    from provspark.sources.tables import read_parquet_cols

    return read_parquet_cols(spark, f"{sf}/documents.parquet", ["doc_id", "lang"])


# --- message streams ------------------------------------------------------------------------------------------------


@query(
    "w04_carry_caption",
    """WITH l AS (SELECT *, last_value(CASE WHEN text <> '' THEN ts END IGNORE NULLS) OVER w AS lts,
        last_value(CASE WHEN text <> '' THEN text END IGNORE NULLS) OVER w AS ltext FROM messages
        WINDOW w AS (PARTITION BY channel ORDER BY msg ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT channel, msg, CASE WHEN text <> '' THEN text WHEN lts = ts THEN ltext ELSE '' END AS text FROM l WHERE NOT via_bot""",
)
def w04(spark, sf):
    return G.carry_caption(view(spark, sf, "messages")).select("channel", "msg", "text")


TOKENS = """h AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS refs FROM pages),
    t AS (SELECT page_id AS page, CAST(generate_subscripts(refs, 1) - 1 AS INTEGER) AS pos, unnest(refs) AS value FROM h),
    tok AS (SELECT page, pos, value, CASE WHEN length(value) % 3 = 0 THEN 'post' WHEN contains(value, '.') THEN 'thumb' ELSE 'photo' END AS kind FROM t)"""


def tokens(spark, sf):
    refs = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    rows = table(spark, sf, "pages").select(F.col("page_id").alias("page"), F.posexplode(refs).alias("pos", "value"))
    kind = F.when(F.length("value") % 3 == 0, "post").when(F.contains("value", F.lit(".")), "thumb").otherwise("photo")
    return rows.withColumn("kind", kind)


@query(
    "w05_pair_tokens",
    f"""WITH {TOKENS}, o AS (SELECT *, row_number() OVER (ORDER BY page, pos) AS n FROM tok),
    s AS (SELECT *, max(CASE WHEN kind = 'photo' THEN n END) OVER (ORDER BY n) AS ph,
                 max(CASE WHEN kind = 'post' THEN n END) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pp FROM o)
    SELECT s.page, s.pos, s.value AS post, p.value AS photo FROM s JOIN o p ON p.n = s.ph WHERE s.kind = 'post' AND s.ph > coalesce(s.pp, 0)""",
)
def w05(spark, sf):
    return G.pair_tokens(tokens(spark, sf)).select("page", "pos", "post", "photo")


@query(
    "s06_read_html_export",
    """SELECT page_id, CAST(coalesce(nullif(regexp_extract(url, '(\\d+)(?:[?#].*)?$', 1), ''), '1') AS BIGINT) AS page_no,
       CAST(length(html) AS INTEGER) AS n_chars FROM pages ORDER BY page_no, page_id""",
)
def s06(spark, sf):
    pages = html_pages(table(spark, sf, "pages"), "url", r"(\d+)(?:[?#].*)?$")
    return pages.select("page_id", "page_no", F.length("html").alias("n_chars")).orderBy("page_no", "page_id")
