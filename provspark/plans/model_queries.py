"""Heads, probes, inference, sinks that read back, and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from provspark.functions import hashing as H
from provspark.functions import numeric as N
from provspark.functions import text as X
from provspark.operators import features as E
from provspark.operators import heads as K
from provspark.operators.breakdowns import feature_moments
from provspark.plans.curation_queries import CAND, CASE_PROMPTED, POLICY, candidates
from provspark.plans.fixtures import table, view
from provspark.plans.registry import query
from provspark.session import scratch
from provspark.sources import exports, manifests, tables
from provspark.streaming.admit import admit_stream, process_parts_once


def r6(column):
    return F.round(column, 6).alias(column)


def gelu_sql(x: str) -> str:
    """x * Phi(x) by the series of erf, its terms in closed form."""
    z = f"greatest(-6.0::DOUBLE, least(6.0::DOUBLE, {x} / sqrt(2.0::DOUBLE)))"
    term = f"exp(n * ln(2 * {z} * {z}) - (n + 1) * ln(2.0::DOUBLE) - lgamma(n + 1.5::DOUBLE) + 0.5 * ln(pi()))"
    erf = f"2 / sqrt(pi()) * exp(-{z} * {z}) * {z} * list_sum(list_transform(range(0, 111), lambda n: {term}))"
    return f"(0.5 * {x} * (1 + CASE WHEN {z} = 0 THEN 0 ELSE {erf} END))"


def labelled(spark, sf):
    """Embeddings as training rows: unit weight, split by hash, humans and machines by class."""
    split = H.hash_split(F.concat(F.lit("vec:"), F.col("item_id").cast("string")), "non_anime")
    return view(spark, sf, "features").select(
        "item_id", F.col("grp").cast("string").alias("grp"), "label", F.col("embedding").cast("array<double>").alias("vec"),
        split.alias("split"), F.lit(1.0).alias("w"),
    )


def heads_of(spark, sf, count=2):
    """Heads from class means: one per half of the classes, the difference of the means as direction."""
    f = view(spark, sf, "features")
    moments = feature_moments(f, "embedding").orderBy("dim").collect()
    tall = f.select("grp", "label", F.posexplode("embedding").alias("dim", "x"))
    heads = []
    for seed in range(count):
        rows = (
            tall.where(F.col("grp") % count == seed)
            .groupBy("dim")
            .agg(
                (F.avg(F.when(F.col("label") == 1, F.col("x").cast("double"))) - F.avg(F.when(F.col("label") == 0, F.col("x").cast("double")))).alias("c")
            )
            .orderBy("dim")
            .collect()
        )
        heads.append(
            {
                "kind": "logistic", "seed": seed, "mean": [m["mean"] for m in moments], "scale": [m["scale"] for m in moments],
                "coef": [r["c"] for r in rows], "intercept": 0.25 * seed,
            }
        )
    return heads


HEADS = """e AS (SELECT item_id, grp, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS dim FROM features),
    m AS (SELECT dim, avg(x) AS mean, sqrt(greatest(var_pop(x), 1e-12)) AS scale FROM e GROUP BY dim),
    c AS (SELECT grp % 2 AS seed, dim, avg(CASE WHEN label = 1 THEN x END) - avg(CASE WHEN label = 0 THEN x END) AS c FROM e GROUP BY 1, 2)"""


@query(
    "m02_score_heads",
    f"""WITH {HEADS}, s AS (SELECT e.item_id, c.seed, sum((e.x - m.mean) / m.scale * c.c) + 0.25 * c.seed AS z
        FROM e JOIN m ON m.dim = e.dim JOIN c ON c.dim = e.dim GROUP BY e.item_id, c.seed)
    SELECT item_id, round(avg(z), 6) AS score FROM s GROUP BY item_id""",
)
def m02(spark, sf):
    f = view(spark, sf, "features").select("item_id", F.col("embedding").alias("vec"))
    return K.score_heads(f, heads_of(spark, sf)).select("item_id", r6("score"))


@query(
    "m02_score_mlp_heads",
    f"""WITH {HEADS}, d AS (SELECT e.item_id, c.seed, sum((e.x - m.mean) / m.scale * c.c) AS d FROM e JOIN m ON e.dim = m.dim
      JOIN c ON c.dim = e.dim GROUP BY e.item_id, c.seed)
    SELECT item_id, round(avg({gelu_sql('d')} - {gelu_sql('(0.1::DOUBLE - d)')} + 0.25 * seed), 6) AS score FROM d GROUP BY item_id""",
)
def m02_mlp(spark, sf):
    f = view(spark, sf, "features").select("item_id", F.col("embedding").alias("vec"))
    base = heads_of(spark, sf)
    nets = [
        {"kind": "mlp", "mean": h["mean"], "scale": h["scale"], "w1": [h["coef"], [-x for x in h["coef"]]], "b1": [0.0, 0.1],
         "w2": [[1.0, -1.0]], "b2": [h["intercept"]]}
        for h in base
    ]
    return K.score_heads(f, nets).select("item_id", r6("score"))


@query("m03_train_logistic")
def m03(spark, sf):
    df = labelled(spark, sf)
    return K.train_logistic(df.where("split = 'train'"), df.where("split = 'val'"))[1]


@query("m04_train_ensemble")
def m04(spark, sf):
    df = labelled(spark, sf)
    models = K.train_ensemble(df.where("split = 'train'"), df.where("split = 'val'"), range(5))
    return K.ensemble_scores(df.where("split = 'test'"), models).select("item_id", "label", r6("score"))


@query("m05_leave_group_out")
def m05(spark, sf):
    return K.leave_group_out(labelled(spark, sf), {"A": ["5"], "B": ["6", "7"], "C": ["8", "9"]}, "grp")


@query("m06_stack")
def m06(spark, sf):
    return K.stack(view(spark, sf, "detectors"), "d1", ["d2", "d3"])


@query("m07_leak_probe")
def m07(spark, sf):
    split = F.when(F.crc32(F.encode(F.col("item_id").cast("string"), "utf-8")) % 2 == 0, "train").otherwise("test")
    items = view(spark, sf, "items").select("label", "model", "w", "h", split.alias("split"))
    w, h = N.fit_within(F.col("w"), F.col("h"), 512)
    sized = items.withColumns({"w_norm": w, "h_norm": h})
    variants = {}
    for name, (x, y) in {"raw": ("w", "h"), "normalised": ("w_norm", "h_norm")}.items():
        sized = sized.withColumns({f"area_{name}": F.col(x) * F.col(y), f"aspect_{name}": F.col(x) / (F.col(y) + 1)})
        variants[name] = [x, y, f"area_{name}", f"aspect_{name}"]
    return K.leak_probes(sized, variants, "model")


@query("m08_grouped_cv_probe")
def m08(spark, sf):
    return K.grouped_cv_probe(labelled(spark, sf).withColumn("pair", F.floor(F.col("item_id") / 2)), "pair", 3)


@query("m12_ablation")
def m12(spark, sf):
    df = labelled(spark, sf)
    return K.ablation(df, {"A": (1, 32), "B": (33, 32), "A+B": (1, 64)})


@query(
    "m01_extract_features",
    """WITH p AS (SELECT doc_id, list_transform(string_split(text, ''), lambda ch: unicode(ch)::BIGINT) AS c FROM documents),
    g AS (SELECT doc_id, unnest(list_transform(range(1, len(c) - 1), lambda i: (c[i] * 961 + c[i + 1] * 31 + c[i + 2]) % 64)) AS bin FROM p)
    SELECT doc_id, CAST(bin AS INTEGER) AS bin, CAST(count(*) AS DOUBLE) AS n FROM g GROUP BY ALL""",
)
def m01(spark, sf):
    vectors = E.extract_features(table(spark, sf, "documents"), "text", E.trigram_model(64), 64, item="doc_id")
    tall = vectors.select("doc_id", F.posexplode("vec").alias("bin", "n")).where("n > 0")
    return tall.select("doc_id", "bin", F.col("n").cast("double").alias("n"))


@query(
    "m11_cache_by_content",
    """WITH g AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
    old AS (SELECT source FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE coalesce(l.toxic, 0) = 0 GROUP BY source
            HAVING count(*) = (SELECT count(*) FROM documents x WHERE x.source = d.source))
    SELECT source, CAST(n AS BIGINT) AS n FROM g WHERE source NOT IN (SELECT source FROM old)""",
)
def m11(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source")
    toxic = table(spark, sf, "labels").where("toxic = 1")

    def keyed(df):
        return df.groupBy("source").agg(H.group_key(F.col("doc_id")).alias("group_key"), F.count("*").alias("n"))

    now, before = keyed(docs), keyed(docs.join(toxic, "doc_id", "left_anti"))
    return E.missing_groups(now, before, ["source", "group_key"]).select("source", "n")


@query(
    "m18_merge_ensembles",
    """WITH h AS (SELECT DISTINCT event_type AS tag, user_id AS seed FROM events WHERE event_type IN ('view', 'click'))
    SELECT 'new' AS tag, CAST(row_number() OVER (ORDER BY CASE tag WHEN 'view' THEN 0 ELSE 1 END, seed) - 1 AS INTEGER) AS seed, seed AS old_seed, tag AS old_tag FROM h""",
)
def m18(spark, sf):
    heads = table(spark, sf, "events").where("event_type in ('view', 'click')").select(
        F.col("event_type").alias("tag"), F.col("user_id").alias("seed")
    ).distinct()
    kept = heads.withColumns({"old_seed": F.col("seed"), "old_tag": F.col("tag")})
    return tables.merge_ensembles(kept, ["view", "click"], "new").select("tag", "seed", "old_seed", "old_tag")


@query("x12_gelu", f"SELECT item_id, round({gelu_sql('(score - 6.0::DOUBLE)')}, 6) AS gelu FROM scores")
def x12(spark, sf):
    return view(spark, sf, "scores").select("item_id", F.round(N.gelu(F.col("score") - 6.0), 6).alias("gelu"))


@query(
    "x13_jpeg_quality",
    """WITH t AS (SELECT item_id, list_transform(embedding, lambda x: CAST(floor(abs(x::DOUBLE) * 100) + 1 AS INTEGER)) AS q FROM features),
    b AS (SELECT [16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
       18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99] AS b),
    s AS (SELECT item_id, list_median(list_transform(range(1, 65), lambda i: q[i] / b[i]::DOUBLE * 100)) AS s FROM t, b)
    SELECT item_id, round(CASE WHEN s <= 100 THEN 100 - s / 2 ELSE 5000 / s END, 6) AS quality FROM s""",
)
def x13(spark, sf):
    table_of = F.transform("embedding", lambda x: (F.floor(F.abs(x.cast("double")) * 100) + 1).cast("int"))
    return view(spark, sf, "features").select("item_id", F.round(X.jpeg_quality(table_of), 6).alias("quality"))


@query(
    "x18_category_cascade",
    """SELECT event_id, CASE WHEN event_type = 'error' OR value >= 250 THEN 'photo' WHEN value >= 120 THEN 'text' WHEN user_id >= 100 THEN 'sheet' ELSE 'other' END AS category FROM events""",
)
def x18(spark, sf):
    scores = F.create_map(
        F.lit("photo"), F.col("value") / 500.0, F.lit("meme"), F.col("value") / 400.0, F.lit("sheet"), F.col("user_id") / 200.0
    )
    rules = [("photo", {"photo": 0.5}), ("text", {"meme": 0.3}), ("sheet", {"sheet": 0.5})]
    gates = {"photo": F.col("event_type") == "error"}
    return table(spark, sf, "events").select("event_id", X.category_cascade(scores, rules, gates, "other").alias("category"))


@query(
    "p11_policy_scores",
    """SELECT event_id, concat_ws(',', CASE WHEN value >= 100 THEN 'alpha' END, CASE WHEN user_id >= 40 THEN 'beta' END) AS hits FROM events""",
)
def p11(spark, sf):
    scores = F.create_map(
        F.lit("beta"), F.col("user_id") / 200.0, F.lit("alpha"), F.col("value") / 500.0, F.lit("free"), F.lit(0.9)
    )
    hits = X.policy_scores(scores, ["alpha", "beta"], 0.2)
    return table(spark, sf, "events").select("event_id", F.array_join(hits, ",").alias("hits"))


@query(
    "x23_flatten_text",
    """SELECT event_id, CASE WHEN user_id % 3 = 0 THEN event_type WHEN user_id % 3 = 1 THEN concat('see ', event_type, '!') ELSE '' END AS text FROM events""",
)
def x23(spark, sf):
    union = (
        F.when(F.col("user_id") % 3 == 0, F.to_json(F.struct(F.col("event_type").alias("text"))))
        .when(
            F.col("user_id") % 3 == 1,
            F.concat(F.lit('{"text":["see ",{"type":"link","text":"'), "event_type", F.lit('"},"!"]}')),
        )
        .otherwise(F.lit('{"text":""}'))
    )
    text = X.flatten_text(F.try_variant_get(F.parse_json(union), "$.text", "variant"))
    return table(spark, sf, "events").select("event_id", text.alias("text"))


# --- sources and sinks, read back -----------------------------------------------------------------------------------


def manifest_rows(spark, sf):
    return view(spark, sf, "items").select(
        F.col("item_id").cast("string").alias("id"), F.col("creator").alias("user"), "w", "h",
        F.col("real_score").alias("real"), F.when(F.col("toxic") == 0, F.col("path")).alias("datei"),
        F.when(F.col("toxic") == 1, "gesperrt").alias("grund"), X.split_tags(F.col("tag_string")).alias("tags"), "source",
    )


@query("s01_read_manifest", "SELECT CAST(item_id AS VARCHAR) AS id, coalesce(creator, '') AS user, w, h, path AS datei FROM items WHERE toxic = 0")
def s01(spark, sf):
    path = scratch(spark, "manifest")
    manifest_rows(spark, sf).drop("source").write.json(path)
    kept = manifests.kept_rows(manifests.read_manifest(spark, path))
    return kept.select("id", F.coalesce("user", F.lit("")).alias("user"), "w", "h", "datei")


@query("s02_append_manifest", "SELECT source, CAST(count(*) AS BIGINT) AS n, CAST(sum(toxic) AS BIGINT) AS rejected FROM items GROUP BY source")
def s02(spark, sf):
    path = scratch(spark, "log")
    rows = manifest_rows(spark, sf)
    for part in (rows.where("grund is null"), rows.where("grund is not null")):
        manifests.append_manifest(part, path)
    read = manifests.read_manifest(spark, path)
    return read.groupBy("source").agg(F.count("*").alias("n"), F.count("grund").alias("rejected"))


@query("s03_rewrite_manifest", "SELECT CAST(item_id AS VARCHAR) AS id, CASE WHEN toxic = 1 THEN 'gesperrt' WHEN quality = 0 THEN 'nachtrag' ELSE '' END AS grund FROM items")
def s03(spark, sf):
    root = scratch(spark, "versions")
    rows = manifest_rows(spark, sf).drop("source")
    manifests.rewrite_manifest(rows, root)
    low = table(spark, sf, "labels").where("quality = 0").select(F.col("doc_id").cast("string").alias("id"), F.lit("nachtrag").alias("_r"))
    marked = manifests.current_manifest(spark, root).join(low, "id", "left").withColumn("grund", F.coalesce("grund", "_r"))
    manifests.rewrite_manifest(marked.drop("_r"), root)
    return manifests.current_manifest(spark, root).select("id", F.coalesce("grund", F.lit("")).alias("grund"))


@query("s04_scan_files", "SELECT source, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes FROM items GROUP BY source")
def s04(spark, sf):
    path = scratch(spark, "files")
    view(spark, sf, "items").select("source", "text").write.partitionBy("source").text(path)
    files = manifests.scan_files(spark, path, ["txt"])
    source = F.regexp_extract("path", r"source=([^/]+)/", 1)
    return files.groupBy(source.alias("source")).agg(F.sum("length").alias("bytes"))


@query(
    "s05_read_chat_export",
    """SELECT CAST(user_id AS VARCHAR) AS channel, event_id AS msg, CASE WHEN event_id % 2 = 0 THEN event_type ELSE concat('a ', event_type) END AS text,
       event_type = 'error' AS via_bot FROM events WHERE event_type <> 'signup'""",
)
def s05(spark, sf):
    path = scratch(spark, "chat")
    text = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('"'), "event_type", F.lit('"'))).otherwise(
        F.concat(F.lit('["a ",{"type":"bold","text":"'), "event_type", F.lit('"}]'))
    )
    bot = F.when(F.col("event_type") == "error", F.lit(',"via_bot":"@x"')).otherwise(F.lit(""))
    kind = F.when(F.col("event_type") == "signup", "service").otherwise("message")
    message = F.concat(
        F.lit('{"id":'), F.col("event_id").cast("string"), F.lit(',"type":"'), kind, F.lit('","date":"'),
        F.col("ts").cast("string"), F.lit('"'), bot, F.lit(',"text":'), text, F.lit("}"),
    )
    # export documents of at most 100 messages each
    chunk = F.floor(F.col("event_id") / 100).alias("chunk")
    exported = table(spark, sf, "events").groupBy("user_id", chunk).agg(F.array_join(F.collect_list(message), ",").alias("m"))
    doc = F.concat(F.lit('{"name":"'), F.col("user_id").cast("string"), F.lit('","messages":['), "m", F.lit("]}"))
    exported.select(doc.alias("value")).write.text(path)
    return exports.read_chat_export(spark, path, wholetext=False).select("channel", "msg", "text", "via_bot")


@query("s08_read_catalog_csv", "SELECT CAST(page_id AS VARCHAR) AS image_id, url FROM pages")
def s08(spark, sf):
    path = scratch(spark, "csv")
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("﻿image_id"), "url")
    pages.write.option("header", True).option("escape", '"').csv(path)
    return tables.read_catalog_csv(spark, path).select("image_id", "url")


@query("s10_read_blocklist", "SELECT DISTINCT lower(path) AS path_lc FROM items WHERE toxic = 1")
def s10(spark, sf):
    path = scratch(spark, "blocklist")
    lines = view(spark, sf, "items").where("toxic = 1").select(F.explode(F.array(F.concat(F.lit("  "), F.upper("path")), F.lit(" "), "path")).alias("value"))
    lines.write.text(path)
    return tables.read_blocklist(spark, path)


@query(
    "s12_write_scores_csv",
    """WITH s AS (SELECT item_id, CASE WHEN item_id % 7 <> 0 THEN score END AS score FROM scores)
    SELECT CAST(item_id AS VARCHAR) AS item_id, coalesce(format('{:.4f}', 1.0::DOUBLE / (1.0::DOUBLE + exp(-score))), '') AS probability,
           CAST(row_number() OVER (ORDER BY score DESC NULLS LAST, item_id) AS BIGINT) AS place FROM s""",
)
def s12(spark, sf):
    path = scratch(spark, "scores")
    some = F.when(F.col("item_id") % 7 != 0, F.col("score")).alias("score")  # the others could not be scored
    tables.write_scores_csv(view(spark, sf, "scores").select("item_id", some), path, "item_id")
    read = spark.read.csv(path, sep=";", header=True).select(
        "item_id", F.coalesce("probability", F.lit("")).alias("probability"), F.col("place").cast("bigint")
    )
    return read


@query("s13_write_metrics", "SELECT detector, kind, CAST(count(*) AS BIGINT) AS n, round(avg(score), 6) AS value FROM detectors GROUP BY detector, kind")
def s13(spark, sf):
    path = scratch(spark, "metrics")
    metrics = view(spark, sf, "detectors").groupBy("detector", "kind").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("value"))
    tables.write_metrics(metrics, path, "json")
    return spark.read.schema(metrics.schema).json(path)


@query(
    "s14_load_ensemble",
    """WITH h AS (SELECT DISTINCT event_type AS tag, user_id AS seed FROM events WHERE value > 5 AND event_type = 'view')
    SELECT tag, seed FROM h WHERE seed = (SELECT count(*) FROM h x WHERE x.seed < h.seed)""",
)
def s14(spark, sf):
    path = scratch(spark, "heads")
    heads = table(spark, sf, "events").where("value > 5").select(
        F.col("event_type").alias("tag"), F.col("user_id").alias("seed")
    ).distinct()
    tables.save_heads(heads, path)
    return tables.load_ensemble(spark.read.parquet(path), "view").select("tag", "seed")


@query("s15_export_heads")
def s15(spark, sf):
    rows = [{"tag": "t", **{k: h[k] for k in ("seed", "kind", "mean", "scale", "coef", "intercept")}} for h in heads_of(spark, sf)]
    heads = spark.createDataFrame(
        rows, "tag string, seed int, kind string, mean array<double>, scale array<double>, coef array<double>, intercept double"
    )
    return tables.export_heads(heads, "t").select("tag", "seed", "sha256", "input_dim")


@query("p22_drop_unreadable", "SELECT doc_id FROM documents WHERE strlen(text) >= 700")
def p22(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.encode("text", "utf-8").alias("content"))
    return manifests.drop_unreadable(docs, "content", 700).select("doc_id")


# --- streams --------------------------------------------------------------------------------------------------------


@query(
    "z01_admit_stream",
    f"""WITH {CAND}, d AS (SELECT item_id, creator, {CASE_PROMPTED} AS reason FROM k),
    n AS (SELECT *, coalesce(sum(CASE WHEN reason IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY creator ORDER BY item_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stored FROM d)
    SELECT item_id, CASE WHEN creator IS NOT NULL AND stored >= 2 THEN 'nutzer-limit' ELSE coalesce(reason, 'ok') END AS reason
    FROM n""",
)
def z01(spark, sf):
    root = scratch(spark, "stream")
    rows = candidates(spark, sf).select("item_id", "creator", "tags", "text", "rating", "real_score", "w", "h")
    cuts = [float("-inf"), *rows.approxQuantile("item_id", [0.3, 0.7], 0.01), float("inf")]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        # arrival in three parts, each one batch, however many files it has: these are in no order of items
        rows.where((F.col("item_id") >= lo) & (F.col("item_id") < hi)).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{root}/in")
        admit_stream(stream, f"{root}/log", f"{root}/checkpoint", "prompted", POLICY, 2).awaitTermination()
    log = spark.read.schema("item_id BIGINT, creator STRING, reason STRING, batch BIGINT").parquet(f"{root}/log")
    return log.select("item_id", F.coalesce("reason", F.lit("ok")).alias("reason"))


@query("z02_process_parts_once", "SELECT lang, CAST(count(*) AS BIGINT) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY lang")
def z02(spark, sf):
    root = scratch(spark, "parts")
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text")
    schema = "doc_id BIGINT, lang STRING, text STRING"
    measure = lambda df: df.select("lang", F.length("text").alias("n"))
    early = F.coalesce(F.col("lang") < "e", F.lit(False))
    for part in (early, ~early):  # a second run continues with the parts that came later; null languages too
        docs.where(part).write.mode("append").parquet(f"{root}/in")
        process_parts_once(spark, f"{root}/in", schema, f"{root}/out", f"{root}/checkpoint", measure, per_trigger=4)
    return spark.read.parquet(f"{root}/out").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n").alias("chars"))
