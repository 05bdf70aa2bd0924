"""Admission, policy, quotas, splits, block lists, sampling and text functions over the item views."""

from __future__ import annotations

from pyspark.sql import functions as F

from provspark.functions import hashing as H
from provspark.functions import numeric as N
from provspark.functions import text as X
from provspark.operators import admission as A
from provspark.operators import sampling as S
from provspark.operators import splits as L
from provspark.operators.unify import unify_sources
from provspark.plans.fixtures import table, view
from provspark.plans.oracle import crc32_sql, hash60_sql, split_sql, uniform_sql
from provspark.plans.registry import query

# Neutral policy terms of the queries; real term lists are data of the caller.
POLICY = {
    "tags": ["toxic"],
    "style": ["lang_de", "rating_4"],
    "words": ["stupid", "worthless"],
    "entities": ["idiot", "hate"],
    "series": ["aient"],
    "tools": ["tionnt", "stable ?diffusion", "aientre"],
}
RATING = "CASE rating WHEN 0 THEN 'general' WHEN 1 THEN 'sensitive' WHEN 2 THEN 'questionable' WHEN 3 THEN 'explicit' END"
NORM = "concat(' ', replace(replace(replace(lower(text), '#', ' '), '_', ' '), '  ', ' '), ' ')"
WORDS = r"concat(' ', array_to_string(regexp_extract_all(replace(lower(text), '_', ' '), '[a-z0-9]+(?:[-''][a-z0-9]+)*'), ' '), ' ')"


def candidates(spark, sf):
    items = view(spark, sf, "items")
    return items.withColumn("tags", X.split_tags(F.col("tag_string"))).withColumn("rating", F.expr(RATING))


def has(column, *terms):
    return " OR ".join(f"contains({column}, '{t}')" for t in terms)


CAND = f"""c AS (SELECT *, {RATING} AS rname, {NORM} AS norm, {WORDS} AS words,
    list_filter(string_split(tag_string, ' '), lambda t: t <> '') AS tags FROM items),
    k AS (SELECT *, greatest(w, h) < 512 AS r_small, real_score >= 0.75 AS r_photo,
      contains(words, ' stupid ') OR contains(words, ' worthless ') AS r_words,
      list_contains(tags, 'toxic') AS r_tags,
      list_contains(tags, 'toxic') OR ((rname IS NULL OR rname <> 'general')
        AND ({has('norm', 'idiot', 'hate', 'aient')})) AS r_policy,
      array_to_string(list_sort(list_filter(tags, lambda t: t IN ('lang_de', 'rating_4'))), ',') AS style,
      regexp_matches(text, '(?i)tionnt|stable ?diffusion|aientre') AS r_tool FROM c)"""
CASE_WEB = """CASE WHEN r_small THEN 'zu klein' WHEN r_photo THEN 'foto' WHEN r_tags THEN 'gesperrt'
    WHEN style <> '' THEN concat('stil: ', style) END"""
CASE_PROMPTED = "CASE WHEN r_words THEN 'gesperrt' WHEN r_photo THEN 'foto' WHEN r_policy THEN 'gesperrt' END"
CASE_FOOTER = """CASE WHEN r_tool THEN 'ki-werkzeug in der fusszeile' WHEN r_photo THEN 'foto'
    WHEN r_policy THEN 'gesperrt' END"""


# --- rules ----------------------------------------------------------------------------------------------------------


@query(
    "p04_admit",
    f"""WITH {CAND}
    SELECT 'web' AS kind, item_id, coalesce({CASE_WEB}, 'ok') AS reason FROM k
    UNION ALL SELECT 'prompted', item_id, coalesce({CASE_PROMPTED}, 'ok') FROM k
    UNION ALL SELECT 'footer', item_id, coalesce({CASE_FOOTER}, 'ok') FROM k
    UNION ALL SELECT 'style', item_id, coalesce(CASE WHEN r_small THEN 'zu klein' WHEN r_photo THEN 'foto'
       WHEN r_policy THEN 'gesperrt' END, 'ok') FROM k WHERE starts_with({CASE_WEB}, 'stil')""",
)
def p04(spark, sf):
    c = candidates(spark, sf)
    web = A.admit_cascade(c, "web", POLICY)
    parts = {"web": web, "style": A.readmit_style(web, POLICY)}
    parts |= {kind: A.admit_cascade(c, kind, POLICY) for kind in ("prompted", "footer")}
    out = None
    for kind, df in parts.items():
        one = df.select(F.lit(kind).alias("kind"), "item_id", F.coalesce("reason", F.lit("ok")).alias("reason"))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "p04_admit_with_quota",
    f"""WITH {CAND}, d AS (SELECT item_id, creator, {CASE_PROMPTED} AS reason FROM k),
    n AS (SELECT *, coalesce(sum(CASE WHEN reason IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY creator ORDER BY item_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stored FROM d)
    SELECT item_id, CASE WHEN creator IS NOT NULL AND stored >= 2 THEN 'nutzer-limit' ELSE coalesce(reason, 'ok') END AS reason
    FROM n""",
)
def p04_quota(spark, sf):
    out = A.admit_with_quota(candidates(spark, sf), "prompted", POLICY, 2)
    return out.select("item_id", F.coalesce("reason", F.lit("ok")).alias("reason"))


@query(
    "p04_admit_unique",
    f"""WITH {CAND}, f AS (SELECT *, row_number() OVER (PARTITION BY sha256(text) ORDER BY item_id) AS rn FROM k)
    SELECT item_id, coalesce({CASE_PROMPTED}, 'ok') AS reason FROM f WHERE rn = 1""",
)
def p04_unique(spark, sf):
    c = candidates(spark, sf).withColumn("content", H.content_key(F.col("text")))
    out = A.admit_unique(c, "prompted", POLICY, "content", "item_id")
    return out.select("item_id", F.coalesce("reason", F.lit("ok")).alias("reason"))


@query(
    "p05_admission_funnel",
    f"""WITH {CAND} SELECT source, split_part(coalesce({CASE_WEB}, 'ok'), ':', 1) AS family, CAST(count(*) AS BIGINT) AS n
    FROM k GROUP BY ALL""",
)
def p05(spark, sf):
    return A.admission_funnel(A.admit_cascade(candidates(spark, sf), "web", POLICY))


@query("p06_min_side", "SELECT item_id, greatest(w, h) >= 512 AS big_enough FROM items")
def p06(spark, sf):
    return view(spark, sf, "items").select("item_id", A.min_side(F.col("w"), F.col("h")).alias("big_enough"))


@query(
    "p07_era",
    """WITH d AS (SELECT file_id, CASE WHEN contains(name, '@') THEN day END AS day FROM files)
    SELECT file_id, CASE WHEN day IS NULL THEN 'undated' WHEN day < DATE '1997-01-01' THEN 'provable'
       WHEN day < DATE '2000-01-01' THEN 'transition' ELSE 'recent' END AS era FROM d""",
)
def p07(spark, sf):
    day = X.file_date(F.col("name"))
    return view(spark, sf, "files").select("file_id", X.era(day, "1997-01-01", "2000-01-01").alias("era"))


@query(
    "p08_generator_mask",
    """SELECT item_id FROM items WHERE NOT (model = 'de' OR (source = 'src3' AND contains(lower(tag_string), 'rating_2')))""",
)
def p08(spark, sf):
    return A.leave_out(view(spark, sf, "items"), ["de", "src3:rating_2"], detail="tag_string").select("item_id")


@query(
    "p09_tombstone",
    f"""WITH {CAND}, d AS (SELECT item_id, source, path, creator, {CASE_WEB} AS reason, toxic FROM k),
    t AS (SELECT *, coalesce(reason IS NULL AND item_id IN (SELECT doc_id FROM labels WHERE quality = 0), FALSE) AS hit FROM d)
    SELECT item_id, source, CASE WHEN hit THEN '' ELSE path END AS path,
           coalesce(CASE WHEN NOT hit THEN creator END, '') AS creator,
           CASE WHEN hit THEN 'gesperrt (nachtrag)' ELSE coalesce(reason, 'ok') END AS reason FROM t
    UNION ALL SELECT -1, 'removed', path, '', '' FROM t WHERE hit""",
)
def p09(spark, sf):
    decided = A.admit_cascade(candidates(spark, sf), "web", POLICY).select("item_id", "source", "path", "creator", "reason")
    hits = table(spark, sf, "labels").where("quality = 0").select(F.col("doc_id").alias("item_id"))
    kept, removed = A.tombstone(decided, hits, "item_id", ["source"], "gesperrt (nachtrag)")
    blank = F.lit("")
    rows = kept.select(
        "item_id", "source", *[F.coalesce(c, blank).alias(c) for c in ("path", "creator")],
        F.coalesce("reason", F.lit("ok")).alias("reason"),
    )
    return rows.unionByName(
        removed.select(
            F.lit(-1).cast("bigint").alias("item_id"), F.lit("removed").alias("source"), "path",
            blank.alias("creator"), blank.alias("reason"),
        )
    )


@query(
    "p10_policy_tags",
    """SELECT item_id, array_to_string(list_sort(list_filter(list_distinct(string_split(tag_string, ' ')),
        lambda t: t IN ('toxic', 'long', 'lang_fr'))), ',') AS hits FROM items""",
)
def p10(spark, sf):
    tags = X.split_tags(F.col("tag_string"))
    return view(spark, sf, "items").select(
        "item_id", F.array_join(X.policy_tags(tags, ["toxic", "long", "lang_fr"]), ",").alias("hits")
    )


@query(
    "p12_policy_entities",
    f"""WITH {CAND} SELECT item_id, rname IS NULL OR rname <> 'general' AS restricted,
        array_to_string(list_sort(list_filter(['idiot', 'hate', 'aient', ' of the ', 'que la'], lambda t: contains(norm, t))), ',')
        AS hits FROM k""",
)
def p12(spark, sf):
    terms = X.policy_entities(F.col("text"), ["idiot", "hate", "aient"], [" of the ", "que la"])
    return candidates(spark, sf).select(
        "item_id", X.restricted_rating(F.col("rating")).alias("restricted"), F.array_join(terms, ",").alias("hits")
    )


@query(
    "p13_policy_words",
    f"""WITH {CAND} SELECT item_id, array_to_string(list_sort(list_filter(['stupid', 'worthless', 'of_the', 'que_la'],
        lambda t: contains(words, concat(' ', replace(t, '_', ' '), ' ')))), ',') AS hits FROM k""",
)
def p13(spark, sf):
    terms = X.policy_words(F.col("text"), ["stupid", "worthless", "of_the", "que_la"])
    return view(spark, sf, "items").select("item_id", F.array_join(terms, ",").alias("hits"))


POSTS = """posts AS (SELECT item_id, toxic = 1 AS deleted, quality = 0 AS banned,
    CASE WHEN n_chars < 300 THEN NULL ELSE path END AS file_url,
    CASE WHEN rating = 3 THEN 'GIF' WHEN rating = 2 THEN 'PNG' ELSE 'jpg' END AS ext, tag_string FROM items)"""


@query(
    "p14_source_flags",
    f"""WITH {POSTS} SELECT item_id FROM posts WHERE NOT deleted AND NOT banned AND file_url IS NOT NULL
    AND lower(ext) IN ('jpg', 'png') AND NOT list_contains(string_split(tag_string, ' '), 'lang_de')""",
)
def p14(spark, sf):
    items = view(spark, sf, "items").select(
        "item_id", (F.col("toxic") == 1).alias("deleted"), (F.col("quality") == 0).alias("banned"),
        F.when(F.col("n_chars") >= 300, F.col("path")).alias("file_url"),
        F.when(F.col("rating") == 3, "GIF").when(F.col("rating") == 2, "PNG").otherwise("jpg").alias("ext"),
        X.split_tags(F.col("tag_string")).alias("tags"),
    )
    return A.source_flags(items, ["jpg", "png"], ["lang_de"], None).select("item_id")


@query(
    "p15_require_metadata",
    """SELECT i.source, l.doc_id IS NOT NULL AS usable, CAST(count(*) AS BIGINT) AS n,
       CAST(count(CASE WHEN l.toxic = 0 THEN 1 END) AS BIGINT) AS rechecked
    FROM items i LEFT JOIN labels l ON l.doc_id = i.item_id GROUP BY ALL""",
)
def p15(spark, sf):
    meta = table(spark, sf, "labels").select(F.col("doc_id").alias("item_id"), F.col("toxic").alias("flag"))
    joined = A.require_metadata(view(spark, sf, "items"), meta, "item_id")
    return joined.groupBy("source", "usable").agg(
        F.count("*").alias("n"), F.count_if(F.col("flag") == 0).alias("rechecked")
    )


@query(
    "p18_augmentation_plan",
    f"""SELECT event_id AS item_id, round(0.6 + {uniform_sql("'7'", 'event_id', "'scale'")} * (0.95 - 0.6), 6) AS scale,
      CAST(70 + floor({uniform_sql("'7'", 'event_id', "'quality'")} * 26) AS INTEGER) AS quality,
      CASE WHEN {uniform_sql("'7'", 'event_id', "'subsampling'")} < 0.5 THEN 2 ELSE 0 END AS subsampling,
      ['lanczos', 'bicubic', 'bilinear'][CAST(floor({uniform_sql("'7'", 'event_id', "'filter'")} * 3) AS INTEGER) + 1] AS resample,
      {uniform_sql("'7'", 'event_id', "'grey'")} < 0.05 AS grey,
      coalesce(round(CASE WHEN {uniform_sql("'7'", 'event_id', "'crop'")} < 0.3
        THEN 0.45 + {uniform_sql("'7'", 'event_id', "'crop_w'")} * (0.9 - 0.45) END, 6), -1) AS crop_w FROM events""",
)
def p18(spark, sf):
    plan = H.augmentation_plan(F.col("event_id"), 7)
    return table(spark, sf, "events").select(
        F.col("event_id").alias("item_id"), F.round(plan["scale"], 6).alias("scale"), plan["quality"].alias("quality"),
        plan["subsampling"].alias("subsampling"), plan["resample"].alias("resample"), plan["grey"].alias("grey"),
        F.coalesce(F.round(plan["crop_w"], 6), F.lit(-1.0)).alias("crop_w"),
    )


@query(
    "p19_pseudonymise",
    r"""WITH a AS (SELECT doc_id, concat('@', regexp_replace(text, '(^|[^a-zA-Z0-9_/])of the($|[^a-zA-Z0-9_/])', '\1Channel B\2', 'g'))
        AS t FROM (SELECT doc_id, replace(replace(replace(text, ' ', '  '), 'tion', 'Channel C'), 'an', 'Channel D') AS text FROM documents)),
    b AS (SELECT doc_id, regexp_replace(t, '(^|[^a-zA-Z0-9_/])the($|[^a-zA-Z0-9_/])', '\1Channel A\2', 'g') AS t FROM a)
    SELECT doc_id, md5(substr(t, 2)) AS digest FROM b""",
)
def p19(spark, sf):
    spaced = F.replace(F.col("text"), F.lit(" "), F.lit("  "))
    labelled = X.pseudonymise(spaced, {"the": "Channel A", "of the": "Channel B"}, {"an": "Channel D", "tion": "Channel C"})
    return table(spark, sf, "documents").select("doc_id", F.md5(labelled).alias("digest"))


@query(
    "p20_keep_known_tags",
    """SELECT item_id, array_to_string(list_sort(list_filter(string_split(tag_string, ' '),
       lambda t: t IN ('long', 'good', 'rating_1'))), ',') AS known FROM items""",
)
def p20(spark, sf):
    tags = X.keep_known_tags(X.split_tags(F.col("tag_string")), ["long", "good", "rating_1"])
    return view(spark, sf, "items").select("item_id", F.array_join(tags, ",").alias("known"))


@query(
    "p21_decode_code",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber WHEN 1 THEN 'ddim' WHEN 2 THEN 'plms' WHEN 3 THEN 'k_euler'
       ELSE '?' END AS sampler FROM lineitem""",
)
def p21(spark, sf):
    name = X.decode_code(F.col("l_linenumber"), {1: "ddim", 2: "plms", 3: "k_euler"})
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", name.alias("sampler"))


@query("p23_credit_exempt", "SELECT doc_id, regexp_matches(text, '(?i)license|copyright|©') AS exempt FROM documents")
def p23(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", X.credit_exempt(F.col("text"), "(?i)license|copyright|©").alias("exempt")
    )


@query(
    "p02_valid_mask",
    """SELECT item_id FROM items WHERE readable AND NOT contains(path, '_thumb.')
       AND lower(path) NOT IN (SELECT lower(i.path) FROM items i WHERE i.toxic = 1)
       AND lower(path) NOT IN (SELECT lower(i.path) FROM items i WHERE i.quality = 0)""",
)
def p02(spark, sf):
    items = view(spark, sf, "items")
    blocked = A.normalise_paths(items.where("toxic = 1").select(F.upper("path").alias("path")))
    wrong = A.normalise_paths(items.where("quality = 0").select(F.concat(F.lit("  "), "path").alias("path")))
    return A.valid_items(items, blocked, wrong).select("item_id")


@query(
    "p03_select_items",
    "SELECT item_id, model, rating FROM items WHERE model IN ('de', 'fr') AND label IN (1) AND rating IN (0, 1, 2)",
)
def p03(spark, sf):
    return A.select_items(view(spark, sf, "items"), model=["de", "fr"], label=[1], rating=[0, 1, 2]).select(
        "item_id", "model", "rating"
    )


@query("j02_apply_blocklist", "SELECT item_id FROM items WHERE lower(path) NOT IN (SELECT lower(i.path) FROM items i WHERE i.toxic = 1)")
def j02(spark, sf):
    items = view(spark, sf, "items")
    blocked = A.normalise_paths(items.where("toxic = 1").select(F.upper("path").alias("path")))
    return A.apply_blocklist(items, blocked).select("item_id")


DECIDED = "decided AS (SELECT doc_id AS item_id, CASE WHEN quality = 0 THEN 'fehler: Timeout' WHEN toxic = 1 THEN 'gesperrt' END AS reason FROM labels)"


@query(
    "j03_only_new",
    f"""WITH {DECIDED} SELECT 'skip' AS mode, item_id FROM items WHERE item_id NOT IN (SELECT item_id FROM decided)
    UNION ALL SELECT 'retry', item_id FROM items WHERE item_id NOT IN
      (SELECT item_id FROM decided WHERE reason IS NULL OR NOT starts_with(reason, 'fehler'))""",
)
def j03(spark, sf):
    items = view(spark, sf, "items").select("item_id")
    decided = table(spark, sf, "labels").select(
        F.col("doc_id").alias("item_id"),
        F.when(F.col("quality") == 0, "fehler: Timeout").when(F.col("toxic") == 1, "gesperrt").alias("reason"),
    )
    skip, retry = (A.only_new(items, decided, "item_id", flag) for flag in (False, True))
    return skip.select(F.lit("skip").alias("mode"), "item_id").unionByName(retry.select(F.lit("retry").alias("mode"), "item_id"))


@query(
    "j04_disjoint_creators",
    """SELECT item_id FROM items WHERE label = 0 AND (creator IS NULL OR creator NOT IN
       (SELECT i.creator FROM items i WHERE i.label = 1 AND i.creator IS NOT NULL AND i.creator <> ''))""",
)
def j04(spark, sf):
    items = view(spark, sf, "items")
    return L.disjoint_creators(items.where("label = 0"), items.where("label = 1"), "creator").select("item_id")


@query(
    "j06_lookup",
    """SELECT 'left' AS mode, d.doc_id, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
    UNION ALL SELECT 'inner', d.doc_id, l.quality FROM documents d JOIN labels l ON l.doc_id = d.doc_id""",
)
def j06(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    catalogue = table(spark, sf, "labels").select("doc_id", "quality")
    left = A.lookup(docs, catalogue, "doc_id", {"quality": -1}).select(F.lit("left").alias("mode"), "doc_id", "quality")
    return left.unionByName(A.lookup(docs, catalogue, "doc_id").select(F.lit("inner").alias("mode"), "doc_id", "quality"))


@query(
    "j07_recheck",
    """WITH o AS (SELECT i.source, CASE WHEN l.doc_id IS NULL THEN 'not found' WHEN l.toxic = 1 THEN 'tagged'
         WHEN l.quality = 0 THEN 'deleted' ELSE 'unchanged' END AS outcome
       FROM items i LEFT JOIN labels l ON l.doc_id = i.item_id WHERE i.real_score >= 0.5)
    SELECT source, outcome, CAST(count(*) AS BIGINT) AS n FROM o GROUP BY ALL""",
)
def j07(spark, sf):
    current = table(spark, sf, "labels").select(
        F.col("doc_id").alias("item_id"), (F.col("toxic") == 1).alias("tagged"), (F.col("quality") == 0).alias("deleted")
    )
    flagged = view(spark, sf, "items").where("real_score >= 0.5").select("item_id", "source")
    return A.recheck(flagged, current, "item_id").groupBy("source", "outcome").agg(F.count("*").alias("n"))


MANIFEST = """mani AS (SELECT item_id, path, replace(path, '.jpg', '.orig') AS original,
    CASE WHEN n_chars < 500 THEN replace(path, '.jpg', '.png') END AS preview,
    CASE WHEN toxic = 1 THEN 'gesperrt' END AS reason FROM items)"""


def manifest(spark, sf):
    return view(spark, sf, "items").select(
        "item_id", "path", F.replace("path", F.lit(".jpg"), F.lit(".orig")).alias("original"),
        F.when(F.col("n_chars") < 500, F.replace("path", F.lit(".jpg"), F.lit(".png"))).alias("preview"),
        F.when(F.col("toxic") == 1, "gesperrt").alias("reason"),
    )


@query(
    "j14_reconcile_blocklist",
    f"""WITH {MANIFEST}, bl AS (SELECT DISTINCT lower(path) AS path_lc FROM items WHERE quality = 1 OR toxic = 1),
    live AS (SELECT lower(path) AS p FROM mani WHERE reason IS NULL UNION SELECT lower(original) FROM mani WHERE reason IS NULL
             UNION SELECT lower(preview) FROM mani WHERE reason IS NULL AND preview IS NOT NULL)
    SELECT path_lc FROM bl WHERE path_lc NOT IN (SELECT p FROM live)""",
)
def j14(spark, sf):
    blocked = A.normalise_paths(view(spark, sf, "items").where("quality = 1 or toxic = 1"))
    return A.reconcile_blocklist(blocked, manifest(spark, sf), ["path", "original", "preview"])


@query(
    "u05_all_paths",
    f"""WITH {MANIFEST} SELECT path FROM mani UNION SELECT original FROM mani
    UNION SELECT preview FROM mani WHERE preview IS NOT NULL""",
)
def u05(spark, sf):
    return A.all_paths(manifest(spark, sf), ["path", "original", "preview"])


@query(
    "u02_blocklist_union",
    "SELECT path FROM items WHERE toxic = 1 EXCEPT SELECT path FROM items WHERE quality = 1",
)
def u02(spark, sf):
    items = view(spark, sf, "items")
    return A.blocklist_union(items.where("toxic = 1"), items.where("quality = 1"))


@query(
    "u01_union_packs",
    """SELECT 'a' AS pack, item_id, source, '' AS detail FROM items WHERE label = 0
    UNION ALL SELECT 'b', item_id, source, model FROM items WHERE label = 1""",
)
def u01(spark, sf):
    from provspark.operators.sets import union_packs

    items = view(spark, sf, "items")
    packs = {
        "a": items.where("label = 0").select("item_id", "source"),
        "b": items.where("label = 1").select("item_id", "source", F.col("model").alias("detail")),
    }
    return union_packs(packs).select("pack", "item_id", "source", F.coalesce("detail", F.lit("")).alias("detail"))


@query(
    "u03_merge_groups",
    f"""WITH m AS (SELECT 'a' AS pack, source, item_id FROM items WHERE label = 0
                   UNION ALL SELECT 'b', source, item_id FROM items WHERE label = 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {hash60_sql("'27'", 'item_id')}, item_id) AS rn FROM m)
    SELECT pack, source, item_id FROM r WHERE rn <= 30""",
)
def u03(spark, sf):
    from provspark.operators.sets import merge_groups

    items = view(spark, sf, "items").select("source", "item_id", "label")
    out = merge_groups({"a": items.where("label = 0"), "b": items.where("label = 1")}, "source", "item_id", 30, seed=27)
    return out.select("pack", "source", "item_id")


@query(
    "u04_set_overlap",
    """SELECT item_id, list_has_any(string_split(tag_string, ' '), ['long', 'toxic']) AS any_common,
       CAST(len(list_intersect(string_split(tag_string, ' '), ['long', 'toxic', 'good'])) AS INTEGER) AS n_common FROM items""",
)
def u04(spark, sf):
    from provspark.operators.sets import overlap

    tags = X.split_tags(F.col("tag_string"))
    return view(spark, sf, "items").select(
        "item_id", F.arrays_overlap(tags, F.array(F.lit("long"), F.lit("toxic"))).alias("any_common"),
        F.size(overlap(tags, ["long", "toxic", "good"])).alias("n_common"),
    )


# --- splits and samples ---------------------------------------------------------------------------------------------

KEY = "coalesce(creator, concat('unbekannt:', CAST(item_id AS VARCHAR)))"


@query(
    "x01_hash_split",
    f"""WITH c AS (SELECT DISTINCT {KEY} AS k FROM items)
    SELECT k, {split_sql("concat('web:', k)", 20, '< 2', '= 2')} AS web, {split_sql('k', 10, '>= 3', '< 3')} AS test_pool,
           {split_sql('k', 20, '< 3', '= 3')} AS non_anime, {split_sql('k', 20, '< 0', '= 0')} AS train_pool FROM c""",
)
def x01(spark, sf):
    keys = view(spark, sf, "items").select(H.creator_key(F.col("creator"), F.col("item_id")).alias("k")).distinct()
    schemes = [H.hash_split(F.col("k"), s).alias(s) for s in ("test_pool", "non_anime", "train_pool")]
    return keys.select("k", H.hash_split(F.concat(F.lit("web:"), "k"), "web").alias("web"), *schemes)


@query(
    "p01_unify_sources",
    f"""WITH h AS (SELECT item_id, 'gallery' AS source, 0 AS label, 'mensch' AS model,
          concat('gallery:', coalesce(creator, CAST(item_id AS VARCHAR))) AS grp,
          CASE WHEN rating = 0 THEN 'val' ELSE 'test' END AS split, CAST(rating AS VARCHAR) AS rating, path FROM items WHERE model = 'en'),
    w AS (SELECT item_id, 'web' AS source, 1, quality_name, concat('web:', coalesce(creator, 'None')), 'x', coalesce(nsfw, CAST(rating AS VARCHAR)), path
          FROM (SELECT *, CASE WHEN n_chars > 1500 THEN 'base-l' ELSE 'web' END AS quality_name,
                       CASE WHEN rating > 1 THEN 'X' WHEN rating = 1 THEN NULL END AS nsfw FROM items) WHERE model = 'fr'),
    p AS (SELECT item_id, 'prompted' AS source, 1, 'prompted', concat('prompted:', coalesce(creator, sha256(text))), 'x', CAST(rating AS VARCHAR), path
          FROM items WHERE model = 'de'),
    t AS (SELECT item_id, 'pool' AS source, 0, 'mensch', concat('gallery:', {KEY}), {split_sql(KEY, 20, '< 0', '= 0')}, CAST(rating AS VARCHAR), path
          FROM items WHERE model = 'es'),
    b AS (SELECT item_id, 'rebuilt' AS source, 1, 'codec', concat('gallery:', coalesce(creator, CAST(item_id AS VARCHAR))),
          CASE WHEN rating = 0 THEN 'val' ELSE 'test' END, CAST(rating AS VARCHAR), path FROM items WHERE n_chars % 11 = 0)
    SELECT item_id, source, label, model, grp, split, rating, path FROM h UNION ALL SELECT * FROM b
    UNION ALL SELECT * REPLACE ({split_sql('COLUMNS(4)', 20, '< 2', '= 2').replace('COLUMNS(4)', 'g')} AS s) FROM
      (SELECT w.item_id, w.source, 1 AS l, quality_name, w.g, w.s, w.r, w.path FROM w AS w(item_id, source, l, quality_name, g, s, r, path))
    UNION ALL SELECT * REPLACE ({split_sql('g', 20, '< 2', '= 2')} AS s) FROM
      (SELECT p.* FROM p AS p(item_id, source, l, m, g, s, r, path))
    UNION ALL SELECT * FROM t""",
)
def p01(spark, sf):
    items = view(spark, sf, "items").where("path is not null")
    base = items.withColumn("reason", F.lit(None).cast("string"))
    gallery = base.where("model = 'en'").select(
        "item_id", "path", "reason", "rating", F.col("creator").alias("artist"),
        F.when(F.col("rating") == 0, "val").otherwise("test").alias("split"),
    )
    web = base.where("model = 'fr'").select(
        "item_id", "path", "reason", "rating", F.col("creator").alias("user"),
        F.when(F.col("n_chars") > 1500, "base-l").alias("basis"), F.when(F.col("rating") > 1, "X").when(F.col("rating") < 1, "").alias("nsfw"),
    )
    prompted = base.where("model = 'de'").select(
        "item_id", "path", "reason", "rating", F.col("creator").alias("job"), F.sha2("text", 256).alias("sha256")
    )
    pool = base.where("model = 'es'").select("item_id", "path", "reason", "rating", F.col("creator").alias("artist"))
    rebuilt = base.where("n_chars % 11 = 0").select(
        "item_id", "path", F.lit("").alias("reason"), "rating", F.lit("codec").alias("basis"),
        F.concat(F.lit("gallery:"), F.coalesce("creator", F.col("item_id").cast("string"))).alias("grp"),
        F.when(F.col("rating") == 0, "val").otherwise("test").alias("split"),
    )
    out = unify_sources({
        "gallery": ("human", gallery), "web": ("web", web), "prompted": ("prompted", prompted),
        "pool": ("human_pool", pool, "gallery"), "rebuilt": ("derived", rebuilt),
    })
    return out.select("item_id", "source", "label", "model", "grp", "split", "rating", "path")


@query(
    "w01_quota",
    """WITH q AS (SELECT item_id, creator, row_number() OVER (PARTITION BY creator ORDER BY item_id) AS rn,
        coalesce(sum(CASE WHEN readable AND real_score < 0.75 THEN 1 ELSE 0 END) OVER (PARTITION BY creator ORDER BY item_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stored,
        coalesce(p.prior, 0) AS prior
      FROM items LEFT JOIN (SELECT concat(source, ':7') AS c, 1 AS prior FROM items GROUP BY source) p ON p.c = creator)
    SELECT item_id, creator IS NOT NULL AND rn > 2 AS queued, creator IS NOT NULL AND stored >= 2 AS stored_only,
           creator IS NOT NULL AND rn - 1 + prior >= 2 AS with_prior FROM q""",
)
def w01(spark, sf):
    items = view(spark, sf, "items").select("item_id", "creator", "readable", "real_score", "source")
    prior = items.select(F.concat("source", F.lit(":7")).alias("creator"), F.lit(1).alias("prior")).distinct()
    out = S.quota(items, ["creator"], "item_id", 2, name="queued")
    out = S.quota(out, ["creator"], "item_id", 2, counts=F.expr("readable and real_score < 0.75"), name="stored_only")
    out = S.quota(out, ["creator"], "item_id", 2, prior=prior, name="with_prior")
    return out.select("item_id", "queued", "stored_only", "with_prior")


@query(
    "w02_cap_random",
    f"""WITH r AS (SELECT source, item_id, row_number() OVER (PARTITION BY source
          ORDER BY {hash60_sql("'20260924'", 'item_id')}, item_id) AS rn FROM items) SELECT source, item_id FROM r WHERE rn <= 10""",
)
def w02(spark, sf):
    return S.cap_random(view(spark, sf, "items").select("source", "item_id"), ["source"], "item_id", 10, 20260924)


@query(
    "w03_chrono_holdout",
    """WITH d AS (SELECT file_id, source, CASE WHEN contains(name, '@') THEN day END AS day FROM files),
    r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY day NULLS FIRST, file_id) - 1 AS i,
                 count(*) OVER (PARTITION BY source) AS n FROM d)
    SELECT file_id, source, CASE WHEN i >= floor(0.9::DOUBLE * n) THEN 'val' ELSE 'train' END AS split FROM r""",
)
def w03(spark, sf):
    dated = view(spark, sf, "files").select("file_id", "source", X.file_date(F.col("name")).alias("day"))
    return S.chrono_holdout(dated, ["source"], "day", "file_id").select("file_id", "source", "split")


@query(
    "w06_first_occurrence",
    """WITH r AS (SELECT doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS rn FROM documents)
    SELECT doc_id FROM r WHERE rn = 1""",
)
def w06(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("content"))
    return S.first_occurrence(docs, ["content"], "doc_id").select("doc_id")


@query(
    "w07_sample_per_group",
    f"""WITH r AS (SELECT creator, item_id, count(*) OVER (PARTITION BY creator) AS c, row_number() OVER (PARTITION BY creator
          ORDER BY {hash60_sql("'27'", 'item_id')}, item_id) AS rn FROM items WHERE creator IS NOT NULL)
    SELECT creator, item_id FROM r WHERE c >= 3 AND rn <= 2""",
)
def w07(spark, sf):
    items = view(spark, sf, "items").where("creator is not null").select("creator", "item_id")
    return S.sample_per_group(items, ["creator"], "item_id", 2, 3, 27)


@query(
    "w08_systematic_sample",
    """WITH r AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i, count(*) OVER () AS n FROM events)
    SELECT 'step' AS mode, event_id FROM r WHERE i % 25 = 0
    UNION ALL SELECT 'linspace', event_id FROM r WHERE i IN
      (SELECT j * ((SELECT max(n) FROM r) - 1) // 99 FROM range(100) t(j))""",
)
def w08(spark, sf):
    events = table(spark, sf, "events").select("event_id")
    step = S.systematic_sample(events, "event_id", 25).select(F.lit("step").alias("mode"), "event_id")
    even = S.linspace_sample(events, "event_id", 100).select(F.lit("linspace").alias("mode"), "event_id")
    return step.unionByName(even)


@query(
    "w09_fill_targets",
    """WITH t AS (SELECT concat(CAST(year(day) AS VARCHAR), '-Q', CAST(quarter(day) AS VARCHAR)) AS bucket, count(*) // 3 AS target
                  FROM files WHERE source <> 'P' GROUP BY 1),
    r AS (SELECT file_id, concat(CAST(year(day) AS VARCHAR), '-Q', CAST(quarter(day) AS VARCHAR)) AS bucket,
                 row_number() OVER (PARTITION BY year(day), quarter(day) ORDER BY file_id) AS rn FROM files)
    SELECT r.bucket, r.file_id FROM r JOIN t ON t.bucket = r.bucket WHERE r.rn <= t.target""",
)
def w09(spark, sf):
    files = view(spark, sf, "files").withColumn("bucket", X.quarter_label(F.col("day")))
    targets = files.where("source <> 'P'").groupBy("bucket").agg(F.floor(F.count("*") / 3).alias("target"))
    return S.fill_targets(files.select("bucket", "file_id"), targets, "bucket", "file_id")


@query(
    "w10_greedy_group_split",
    f"""WITH RECURSIVE z AS (SELECT creator AS g, count(*) AS size FROM items WHERE creator IS NOT NULL GROUP BY creator),
    o AS (SELECT g, size, row_number() OVER (ORDER BY size DESC, {crc32_sql('g')}, g) AS rn FROM z),
    s(rn, g, size, split, a, b, c) AS (
      SELECT CAST(0 AS BIGINT), '', CAST(0 AS BIGINT), '', CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT)
      UNION ALL
      SELECT n.rn, n.g, n.size, n.split, n.a + CASE WHEN n.split = 'test' THEN n.size ELSE 0 END,
             n.b + CASE WHEN n.split = 'val' THEN n.size ELSE 0 END, n.c + CASE WHEN n.split = 'train' THEN n.size ELSE 0 END
      FROM (SELECT o.rn, o.g, o.size, s.a, s.b, s.c,
              CASE WHEN s.a * 2 <= s.b * 3 AND s.a * 15 <= s.c * 3 THEN 'test' WHEN s.b * 15 <= s.c * 2 THEN 'val' ELSE 'train' END AS split
            FROM s JOIN o ON o.rn = s.rn + 1) n)
    SELECT g AS creator, size, split FROM s WHERE rn > 0""",
)
def w10(spark, sf):
    items = view(spark, sf, "items").where("creator is not null")
    return L.greedy_group_split(items, "creator").select("creator", "size", "split")


@query(
    "w11_disjoint_slices",
    f"""WITH r AS (SELECT event_id, row_number() OVER (ORDER BY {hash60_sql("'29'", 'event_id')}, event_id) - 1 AS i FROM events)
    SELECT event_id, CAST(i // 1200 AS INTEGER) AS slice FROM r WHERE i // 1200 < 4""",
)
def w11(spark, sf):
    return S.disjoint_slices(table(spark, sf, "events").select("event_id"), "event_id", 4, 1200, 29)


@query(
    "j01_inherit_split",
    f"""WITH b AS (SELECT o_orderkey, concat('c:', CAST(o_custkey AS VARCHAR)) AS grp FROM orders),
    k AS (SELECT DISTINCT grp FROM b), s AS (SELECT grp, {split_sql('grp', 20, '< 2', '= 2')} AS split FROM k)
    SELECT l.l_returnflag AS model, s.split, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT b.grp) AS BIGINT) AS groups
    FROM lineitem l JOIN b ON b.o_orderkey = l.l_orderkey JOIN s ON s.grp = b.grp WHERE l.l_returnflag IN ('A', 'R') GROUP BY ALL""",
)
def j01(spark, sf):
    grp = F.concat(F.lit("c:"), F.col("o_custkey").cast("string"))
    base = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("base_id"), H.hash_split(grp, "web").alias("split"), grp.alias("grp")
    )
    derived = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("base_id"), F.col("l_returnflag").alias("model"))
    out = L.inherit_split(derived, base, "base_id", ["A", "R"])
    return out.groupBy("model", "split").agg(F.count("*").alias("n"), F.countDistinct("grp").alias("groups"))


# --- scalar functions -----------------------------------------------------------------------------------------------


@query(
    "x02_content_key",
    f"""WITH h AS (SELECT source, {hash60_sql("'content'", 'doc_id')} AS h, sha256(text) AS s FROM documents)
    SELECT source, substr(sha1(concat_ws('|', count(*), bit_xor(h), sum(h % 2147483648)::BIGINT)), 1, 12) AS group_key,
           substr(max(s), 1, 16) AS top_key FROM h GROUP BY source""",
)
def x02(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.groupBy("source").agg(
        H.group_key(F.col("doc_id")).alias("group_key"), F.substring(F.max(H.content_key(F.col("text"))), 1, 16).alias("top_key")
    )


@query(
    "x03_file_date",
    """SELECT file_id, CASE WHEN contains(name, '@') THEN CAST(day AS VARCHAR) ELSE '' END AS day FROM files""",
)
def x03(spark, sf):
    day = X.file_date(F.col("name")).cast("string")
    return view(spark, sf, "files").select("file_id", F.coalesce(day, F.lit("")).alias("day"))


VERSION = r"""v AS (SELECT doc_id,
    regexp_extract(text, '(?i)--(v|version|niji)\s*([\d.]+|test\w*)|--(testp?)\b|(?:version\s*midjourney|midjourney\s*(?:version|v))\s*:?\s*([\d.]+)', ['k', 'n', 't', 'p']) AS m
    FROM prompts), e AS (SELECT doc_id, CASE WHEN m.t <> '' THEN lower(m.t) WHEN m.p <> '' THEN 'v' || lower(m.p)
    WHEN lower(m.k) = 'niji' THEN 'niji' || lower(m.n) WHEN m.k <> '' THEN 'v' || lower(m.n) ELSE '' END AS version FROM v)"""


@query("x04_prompt_version", f"WITH {VERSION} SELECT doc_id, version FROM e")
def x04(spark, sf):
    return view(spark, sf, "prompts").select("doc_id", X.prompt_version(F.col("text")).alias("version"))


@query(
    "x05_version_bucket",
    rf"""WITH {VERSION} SELECT CASE WHEN version = '' THEN 'none' WHEN contains(version, 'niji') THEN 'niji'
      WHEN starts_with(version, 'test') THEN 'test' WHEN regexp_matches(version, '^v?\d+')
      THEN 'v' || regexp_extract(version, '^v?(\d+)', 1) ELSE version END AS bucket, CAST(count(*) AS BIGINT) AS n
    FROM e GROUP BY 1""",
)
def x05(spark, sf):
    bucket = X.version_bucket(X.prompt_version(F.col("text")))
    return view(spark, sf, "prompts").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query(
    "x06_earliest_year",
    """SELECT doc_id, coalesce(CASE WHEN 1985 + n_chars % 50 BETWEEN 1995 AND 2026 AND n_chars % 3 = 0
         THEN least(1985 + n_chars % 50, 2012) WHEN n_chars % 3 = 0 THEN 2012
         WHEN 1985 + n_chars % 50 BETWEEN 1995 AND 2026 THEN 1985 + n_chars % 50 END, 0) AS year
    FROM (SELECT doc_id, CAST(n_chars AS INTEGER) AS n_chars FROM documents)""",
)
def x06(spark, sf):
    header = F.concat(
        "text", F.lit(' xmp:CreateDate="'), (F.lit(1985) + F.col("n_chars") % 50).cast("string"), F.lit('-03-01" '),
        F.when(F.col("n_chars") % 3 == 0, F.lit("2012:05:06 07:08:09")).otherwise(F.lit("")),
    )
    return table(spark, sf, "documents").select("doc_id", F.coalesce(X.earliest_year(header), F.lit(0)).alias("year"))


@query(
    "x07_parse_resolution",
    r"SELECT file_id, CAST(coalesce(nullif(regexp_extract(name, '_(\d{3,4})x(\d{3,4})', 1), ''), '0') AS INTEGER) AS width FROM files",
)
def x07(spark, sf):
    return view(spark, sf, "files").select("file_id", X.parse_resolution(F.col("name")).alias("width"))


@query(
    "x08_footer_fields",
    r"""WITH f AS (SELECT doc_id, concat(text, CASE WHEN n_chars % 3 = 0 THEN ' Software Paint Tool 2  ©' WHEN n_chars % 3 = 1
          THEN ' software neural brush wallpaper' ELSE '' END) AS t FROM documents)
    SELECT doc_id, trim(regexp_extract(t, '(?i)software\s+(.{2,40}?)(?:\s{2,}|©|$|wallpaper)', 1)) AS software,
           regexp_matches(t, '(?i)neural|diffusion') AS machine FROM f""",
)
def x08(spark, sf):
    suffix = F.when(F.col("n_chars") % 3 == 0, " Software Paint Tool 2  ©").when(
        F.col("n_chars") % 3 == 1, " software neural brush wallpaper"
    ).otherwise("")
    t = F.concat("text", suffix)
    return table(spark, sf, "documents").select(
        "doc_id", X.footer_software(t).alias("software"), X.names_tool(t, ["neural", "diffusion"]).alias("machine")
    )


@query(
    "x09_ad_signals",
    r"""WITH t AS (SELECT item_id, source, text, list_filter(string_split(tag_string, ' '), lambda t: t IN ('long', 'toxic')) AS g,
        list_filter(regexp_extract_all(text, '(?:https?://|t\.me/)\S+'),
          lambda l: NOT contains(replace(lower(l), '_', ''), substr(lower(source), 1, 6))) AS links FROM items)
    SELECT item_id, CASE WHEN regexp_matches(text, '(?i)license|copyright') THEN '' ELSE concat_ws(' | ',
      CASE WHEN regexp_matches(text, '(?i)subscribe|price|\$\d|click|offer') OR regexp_matches(text, '(?i)welcome|released') THEN 'text' END,
      CASE WHEN len(links) > 0 THEN 'link' END,
      CASE WHEN len(g) > 0 THEN concat('image:', array_to_string(list_sort(g), '+')) END) END AS reasons FROM t""",
)
def x09(spark, sf):
    reasons = X.ad_signals(
        F.col("text"), X.split_tags(F.col("tag_string")), F.col("source"), r"(?i)subscribe|price|\$\d|click|offer",
        "(?i)welcome|released", ["long", "toxic"], "(?i)license|copyright",
    )
    return view(spark, sf, "items").select("item_id", F.array_join(reasons, " | ").alias("reasons"))


@query(
    "x10_path_part",
    r"""SELECT item_id, string_split(path, '/')[-3] AS channel,
       coalesce(CAST(nullif(regexp_extract(path, '/(\d+)\.[^./]+$', 1), '') AS BIGINT), -1) AS stem FROM items""",
)
def x10(spark, sf):
    stem = F.coalesce(X.numeric_stem(F.col("path")), F.lit(-1).cast("bigint"))
    return view(spark, sf, "items").select("item_id", X.path_part(F.col("path"), -3).alias("channel"), stem.alias("stem"))


@query(
    "x11_sigmoid_logit",
    """SELECT item_id, round(1.0::DOUBLE / (1.0::DOUBLE + exp(-score)), 6) AS p,
       round(ln(greatest(1e-6, least(1 - 1e-6, score / 40)) / greatest(1e-6, least(1, 1 - score / 40))), 6) AS z FROM scores""",
)
def x11(spark, sf):
    return view(spark, sf, "scores").select(
        "item_id", F.round(N.sigmoid(F.col("score")), 6).alias("p"), F.round(N.logit(F.col("score") / 40, 1e-6), 6).alias("z")
    )


@query(
    "x14_fit_within",
    """SELECT item_id, CAST(greatest(1, round_even(w * least(1.0::DOUBLE, 1280.0::DOUBLE / greatest(w, h, 1)), 0)) AS INTEGER) AS fw,
       CAST(greatest(1, round_even(h * least(1.0::DOUBLE, 1280.0::DOUBLE / greatest(w, h, 1)), 0)) AS INTEGER) AS fh FROM items""",
)
def x14(spark, sf):
    fw, fh = N.fit_within(F.col("w"), F.col("h"), 1280)
    return view(spark, sf, "items").select("item_id", fw.alias("fw"), fh.alias("fh"))


@query(
    "x15_aspect_gap",
    """SELECT item_id, round(abs(ln((w + 1.0::DOUBLE) / (h + 1))), 6) AS gap,
       round(greatest(w, h) / CAST(greatest(1, least(w, h)) AS DOUBLE), 6) AS ratio,
       coalesce(round(CASE WHEN w * h > 0 THEN n_chars / CAST(w * h AS DOUBLE) END, 6), -1) AS bpp FROM items""",
)
def x15(spark, sf):
    w, h = F.col("w"), F.col("h")
    return view(spark, sf, "items").select(
        "item_id", F.round(N.aspect_gap(w + 1.0, h + 1.0), 6).alias("gap"), F.round(N.side_ratio(w, h), 6).alias("ratio"),
        F.coalesce(F.round(N.bytes_per_pixel(F.col("n_chars"), w, h), 6), F.lit(-1.0)).alias("bpp"),
    )


@query(
    "x19_family",
    """WITH t AS (SELECT item_id, CASE WHEN n_chars % 9 = 0 THEN [] ELSE string_split(tag_string, ' ') END AS tags FROM items),
    f AS (SELECT item_id, tags, list_sort(list_distinct(list_filter(list_transform(tags, lambda t: CASE t WHEN 'lang_de' THEN 'germanic'
       WHEN 'rating_1' THEN 'germanic' WHEN 'lang_fr' THEN 'romance' WHEN 'toxic' THEN 'bad' END), lambda x: x IS NOT NULL))) AS fam FROM t)
    SELECT item_id, CASE WHEN len(tags) = 0 THEN 'untagged' WHEN len(fam) = 0 THEN 'other' ELSE array_to_string(fam, ',') END AS family FROM f""",
)
def x19(spark, sf):
    mapping = {"lang_de": "germanic", "rating_1": "germanic", "lang_fr": "romance", "toxic": "bad"}
    tags = F.when(F.col("n_chars") % 9 == 0, F.array().cast("array<string>")).otherwise(X.split_tags(F.col("tag_string")))
    fam = F.array_join(F.array_sort(X.families(tags, mapping, "untagged", "other")), ",")
    return view(spark, sf, "items").select("item_id", fam.alias("family"))


@query("x20_slug", "SELECT page_id, regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g') AS slug FROM pages")
def x20(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.slug(F.col("url")).alias("slug"))


@query(
    "x21_quarter_windows",
    """WITH s AS (SELECT CAST(date_trunc('quarter', min(o_orderdate)) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b FROM orders)
    SELECT CAST(CAST(t.d AS DATE) AS VARCHAR) AS day FROM s, unnest(generate_series(s.a, s.b, INTERVAL 3 MONTH)) t(d)""",
)
def x21(spark, sf):
    span = table(spark, sf, "orders").agg(
        F.date_trunc("quarter", F.min("o_orderdate")).cast("date").alias("a"), F.max("o_orderdate").cast("date").alias("b")
    )
    windows = span.select(F.explode(X.quarter_windows(F.col("a"), F.col("b"))).alias("day"))
    return windows.select(F.col("day").cast("string").alias("day"))


@query(
    "x22_available_prefix",
    """WITH p AS (SELECT item_id, ['A'] || CASE WHEN grp <> 3 THEN ['B'] ELSE [] END || CASE WHEN grp < 7 THEN ['C'] ELSE [] END AS have FROM features)
    SELECT item_id, CASE WHEN list_contains(have, 'B') AND list_contains(have, 'C') THEN 'A,B,C' WHEN list_contains(have, 'B') THEN 'A,B'
       ELSE 'A' END AS prefix FROM p""",
)
def x22(spark, sf):
    have = F.array_compact(
        F.array(F.lit("A"), F.when(F.col("grp") != 3, F.lit("B")), F.when(F.col("grp") < 7, F.lit("C")))
    )
    return view(spark, sf, "features").select(
        "item_id", F.array_join(X.available_prefix(["A", "B", "C"], have), ",").alias("prefix")
    )


@query(
    "x24_quarter_label",
    """SELECT o_orderkey, concat(CAST(year(o_orderdate) AS VARCHAR), '-Q', CAST(quarter(o_orderdate) AS VARCHAR)) AS quarter FROM orders""",
)
def x24(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", X.quarter_label(F.col("o_orderdate").cast("date")).alias("quarter")
    )
