"""Registered queries for projections, filters, joins, reshapes, windows and
set operators (P*, F*, J*, R*, W*, O*) and the page extraction (S9)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varietas.functions import text as T
from varietas.operators import joins, reshape, stats
from varietas.plans.sampling_plans import _SQL_UNIFORM_MEMBERS_CTE, uniform_members_df
from varietas.sources import fixtures as fx
from varietas.sources import pages as pg

R6 = lambda c: F.round(c, 6)


# --------------------------------------------------------------------------- P1-P3, P8, P9, P13, P17
def q_text_projection(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents")
    fl = T.first_line("text")
    return d.select(
        "doc_id",
        T.slug(F.concat_ws(" ", "source", "lang")).alias("source_slug"),
        T.remap("lang", {"en": "english", "de": "german"}).alias("lang_name"),
        T.map_label("lang", {"en": 1, "fr": 0}).alias("lang_flag"),
        F.md5(fl).alias("first_line_md5"),
        F.md5(T.strip_marker(F.concat(F.lit("["), F.col("doc_id").cast("string"), F.lit("]: "), "text"))).alias("marker_free_md5"),
        T.outlet_from_event_id(F.concat(F.lit("ev_"), "source", F.lit(" "), "lang", F.lit("_"),
                                        F.col("doc_id").cast("string"))).alias("outlet"),
        F.md5(T.strip_article(F.lower("text"))).alias("article_default_md5"),
        F.md5(T.strip_article(F.lower("text"), legacy=True)).alias("article_legacy_md5"))


SQL_TEXT_PROJECTION = r"""
SELECT doc_id,
  replace(lower(concat_ws(' ', source, lang)), ' ', '-') AS source_slug,
  CASE lang WHEN 'en' THEN 'english' WHEN 'de' THEN 'german' ELSE lang END AS lang_name,
  CASE WHEN lang = 'en' THEN 1 WHEN lang = 'fr' THEN 0 END AS lang_flag,
  md5(split_part(text, chr(10), 1)) AS first_line_md5,
  md5(regexp_replace('[' || CAST(doc_id AS VARCHAR) || ']: ' || text, '(\[[0-9]*\]: )', '', 'g')) AS marker_free_md5,
  regexp_replace(lower(regexp_replace(regexp_replace('ev_' || source || ' ' || lang || '_' || CAST(doc_id AS VARCHAR),
                 '^[^_]*_', ''), '_[0-9]+', '', 'g')), '\s+', '-', 'g') AS outlet,
  md5(regexp_replace(lower(text), '^the ', '')) AS article_default_md5,
  md5(ltrim(lower(text), 'the ')) AS article_legacy_md5
FROM documents
"""


# --------------------------------------------------------------------------- F1-F4, F7
def q_row_filters(spark, sf_dir):
    c = fx.corpus(spark, sf_dir)
    c = c.na.drop(subset=["label"])                                       # F1
    c = T.drop_empty_text(c)                                              # F2
    c = c.where(T.not_in_list("source", ["src1", "src2"]))                # F3
    c = c.where(T.contains_any(F.lower("text"), [" the ", " la "]))       # F4
    c = c.where((F.col("label") == 1) | F.col("lang").isNull() | (F.col("lang") == "en"))  # F7
    return c.select("doc_id", "source", "lang", "label")


SQL_ROW_FILTERS = """
SELECT d.doc_id, d.source, d.lang, l.toxic AS label
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
WHERE l.toxic IS NOT NULL AND length(d.text) > 0
  AND coalesce(d.source NOT IN ('src1', 'src2'), true)
  AND (contains(lower(d.text), ' the ') OR contains(lower(d.text), ' la '))
  AND (l.toxic = 1 OR d.lang IS NULL OR d.lang = 'en')
"""


# --------------------------------------------------------------------------- F5
def _outlet_names(spark, sf_dir):
    src = fx.table(spark, sf_dir, "documents").select(F.col("source").alias("name")).distinct()
    web = src.where(F.substring(F.md5("name"), 1, 1) < "8").select(F.concat("name", F.lit("-website")).alias("name"))
    return src.unionByName(web)


def q_outlet_variants(spark, sf_dir):
    """prefer '-website' variants; plain substring rule."""
    return joins.prefer_variant(_outlet_names(spark, sf_dir), "name", "-website")


SQL_OUTLET_VARIANTS = """
WITH src AS (SELECT DISTINCT source AS name FROM documents),
names AS (SELECT name FROM src UNION ALL SELECT name || '-website' FROM src WHERE substr(md5(name), 1, 1) < '8'),
variants AS (SELECT name FROM names WHERE suffix(name, '-website')),
bases AS (SELECT DISTINCT substr(name, 1, length(name) - 8) AS base FROM variants),
others AS (SELECT name FROM names WHERE NOT suffix(name, '-website') OR name IS NULL)
SELECT name FROM others o WHERE NOT EXISTS (SELECT 1 FROM bases b WHERE contains(o.name, b.base))
UNION ALL SELECT substr(name, 1, length(name) - 8) AS name FROM variants
"""


# --------------------------------------------------------------------------- J3, J5, J6, J11
def q_topic_vector_join(spark, sf_dir):
    """J3 + P14: documents get their topic's mean vector; docs without a topic
    fall back to a zero vector (coalesce_vector)."""
    emb = fx.embedding(spark, sf_dir)
    d = emb.select("topic_nr", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    cent = d.groupBy("topic_nr", "i").agg(F.avg("x").alias("x"))
    cent = cent.groupBy("topic_nr").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("_c"))
    cent = cent.select("topic_nr", F.transform("_c", lambda s: s["x"]).alias("topic_vec"))
    j = joins.enrich_left(fx.doc_topic(spark, sf_dir), cent, on="topic_nr")
    dim = emb.agg(F.max(F.size("embedding"))).first()[0]
    vec = F.coalesce(F.col("topic_vec"), F.array_repeat(F.lit(0.0), dim))
    at = F.transform(vec, lambda x, i: x * (i + 1))
    return j.select("doc_id", "topic_nr", R6(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x)).alias("vec_sum"),
                    F.round(F.aggregate(at, F.lit(0.0), lambda a, x: a + x), 5).alias("vec_moment"), F.size(vec).alias("dim"))


SQL_TOPIC_VECTOR_JOIN = """
WITH x AS (SELECT label AS topic_nr, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM embeddings),
c AS (SELECT topic_nr, i, avg(CAST(x AS DOUBLE)) AS x FROM x GROUP BY ALL),
cs AS (SELECT topic_nr, sum(x) AS s, sum(x * i) AS m FROM c GROUP BY ALL),
dim AS (SELECT max(len(embedding)) AS dim FROM embeddings),
dt AS (SELECT d.doc_id, e.label AS topic_nr FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id)
SELECT dt.doc_id, dt.topic_nr, round(coalesce(cs.s, 0.0), 6) AS vec_sum, round(coalesce(cs.m, 0.0), 5) AS vec_moment,
  CAST(dim AS INTEGER) AS dim
FROM dt LEFT JOIN cs ON dt.topic_nr = cs.topic_nr CROSS JOIN dim
"""


def q_whole_vs_subset(spark, sf_dir):
    """Per-category counts of the corpus against the first uniform subsample."""
    whole = fx.corpus(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n"))
    sub = (uniform_members_df(spark, sf_dir).where(F.col("subsample") == "alpha_inf_idx_1")
           .groupBy("category").agg(F.count("*").alias("n")))
    return joins.whole_vs_subset(whole, sub, "category")


SQL_WHOLE_VS_SUBSET = "WITH " + _SQL_UNIFORM_MEMBERS_CTE + """,
whole AS (SELECT concat_ws('_', source, lang) AS category, count(*) AS n FROM documents GROUP BY 1),
sub AS (SELECT category, count(*) AS n FROM members WHERE subsample = 'alpha_inf_idx_1' GROUP BY 1)
SELECT w.category, w.n AS n_whole, coalesce(s.n, 0) AS n_subset FROM whole w LEFT JOIN sub s ON w.category = s.category
"""


def q_join_back(spark, sf_dir):
    """Subsample members joined back to their documents (by id, not text)."""
    m = uniform_members_df(spark, sf_dir).select("subsample", "doc_id")
    d = fx.table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return joins.enrich_left(m, d, on="doc_id").groupBy("subsample", "lang").agg(
        F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


SQL_JOIN_BACK = "WITH " + _SQL_UNIFORM_MEMBERS_CTE + """
SELECT m.subsample, d.lang, count(*) AS n, CAST(sum(d.n_chars) AS BIGINT) AS chars
FROM members m LEFT JOIN documents d ON m.doc_id = d.doc_id GROUP BY ALL
"""


def q_pick_test_set(spark, sf_dir):
    """Every source's name maps to a held-out set; an unknown name is an error."""
    sizes = fx.corpus(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"))
    return joins.pick_test_set(sizes, fx.test_sets(spark, sf_dir), "source").select("source", "n", "test_set")


SQL_PICK_TEST_SET = """
SELECT source, count(*) AS n, CASE WHEN substr(md5(source), 1, 1) < '8' THEN 'own' ELSE 'shared' END AS test_set
FROM documents GROUP BY source
"""


# --------------------------------------------------------------------------- R1, R3
#: Sentence columns of a wide table; a longer conversation has several wide rows (its parts).
WIDE = 20


def _wide(spark, sf_dir, *cells) -> DataFrame:
    """Conversations as a wide table: (conv_id, part, a column per place and cell)."""
    c = fx.table(spark, sf_dir, "conversations").where("turn IS NOT NULL").withColumn("score", F.length("text").cast("double"))
    c = c.withColumn("part", F.floor(F.col("turn") / WIDE)).withColumn("place", F.pmod("turn", F.lit(WIDE)).cast("int"))
    return c.groupBy("conv_id", "part").pivot("place", list(range(WIDE))).agg(*[F.first(x).alias(y) for x, y in cells])


def _turn_of(idx: str = "idx"):
    return (F.col("part") * WIDE + F.col(idx)).cast("int")


def _with_part(wide: DataFrame) -> DataFrame:
    return wide.withColumn("_row", F.struct("conv_id", "part"))


def q_wide_to_long(spark, sf_dir):
    """Conversations as wide rows (a column per place) melted back, empty cells dropped."""
    wide = _with_part(_wide(spark, sf_dir, ("text", "s"), ("score", "v")))
    long = reshape.wide_to_long(wide, "_row", [f"{i}_s" for i in range(WIDE)]).select("_row.*", "idx", "text")
    return long.select("conv_id", _turn_of().alias("idx"), F.md5("text").alias("text_md5"))


SQL_WIDE_TO_LONG = """
SELECT conv_id, CAST(turn AS INTEGER) AS idx, md5(text) AS text_md5 FROM conversations
WHERE turn IS NOT NULL AND text IS NOT NULL AND length(text) > 0
"""


def q_title_scores(spark, sf_dir):
    """R1 -> A19 with the title's own score: wide annotation tables (score columns, title score t)
    melted and averaged per (conversation, sentence); the title is sentence -1, on a conversation's first wide row."""
    wide = _wide(spark, sf_dir, ("text", "s"), ("score", "v"))
    titles = fx.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.min_by("role", "turn").alias("doctitle"), F.max(F.length("text").cast("double")).alias("t"), F.floor(F.min("turn") / WIDE).alias("part"))
    wide = _with_part(wide.join(titles, ["conv_id", "part"], "left"))
    long = reshape.wide_to_long(wide, "_row", [f"{i}_s" for i in range(WIDE)], [f"{i}_v" for i in range(WIDE)],
                                title_col="doctitle", title_score_col="t").where((F.col("idx") >= 0) | F.col("text").isNotNull())
    long = long.select("_row.*", "idx", "score")
    both = long.unionByName(long.withColumn("score", F.col("score") + 1))      # two annotators
    at = F.when(F.col("idx") < 0, F.col("idx")).otherwise(_turn_of())
    return both.groupBy("conv_id", at.alias("idx")).agg(R6(F.avg("score")).alias("mean_score"))


SQL_TITLE_SCORES = """
SELECT conv_id, CAST(turn AS INTEGER) AS idx, round(CAST(length(text) AS DOUBLE) + 0.5, 6) AS mean_score FROM conversations
WHERE turn IS NOT NULL AND text IS NOT NULL AND length(text) > 0
UNION ALL
SELECT conv_id, -1 AS idx, round(max(CAST(length(text) AS DOUBLE)) + 0.5, 6) AS mean_score FROM conversations GROUP BY conv_id
"""


def q_repeat_k(spark, sf_dir):
    """Every region row three times."""
    return reshape.repeat_k(fx.table(spark, sf_dir, "region"), 3).select("r_regionkey", "r_name", "rep")


SQL_REPEAT_K = "SELECT r_regionkey, r_name, CAST(rep AS INTEGER) AS rep FROM region, range(0, 3) t(rep)"


# --------------------------------------------------------------------------- W1, W2, O3-O6
def q_first_turn(spark, sf_dir):
    """First row per conversation."""
    c = fx.table(spark, sf_dir, "conversations")
    return joins.first_per_group(c, ["conv_id"], ["turn"]).select("conv_id", "turn", "role")


SQL_FIRST_TURN = """
SELECT conv_id, turn, role FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) WHERE rn = 1
"""


def q_unique_texts(spark, sf_dir):
    """First document of every distinct text (exact copies dropped)."""
    d = fx.table(spark, sf_dir, "documents").withColumn("_h", F.md5("text"))
    return joins.first_per_group(d, ["_h"], ["doc_id"]).select("doc_id")


SQL_UNIQUE_TEXTS = """
SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS rn FROM documents)
WHERE rn = 1
"""


def q_union_missing(spark, sf_dir):
    """O3: union by name; columns missing on one side become NULL."""
    r = fx.table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))
    n = fx.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"),
                                                 F.col("n_regionkey").alias("parent"))
    return r.unionByName(n, allowMissingColumns=True)


SQL_UNION_MISSING = """
SELECT r_regionkey AS key, r_name AS name FROM region
UNION ALL BY NAME
SELECT n_nationkey AS key, n_name AS name, n_regionkey AS parent FROM nation
"""


def q_split_union(spark, sf_dir):
    """Split rows into matching / not matching, process one part, union back."""
    e = fx.table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    hit = e.where(F.col("event_type") == "click").withColumn("value", F.col("value") * 2)
    rest = e.where((F.col("event_type") != "click") | F.col("event_type").isNull())
    return hit.unionByName(rest).select("event_id", "event_type", R6("value").alias("value"))


SQL_SPLIT_UNION = """
SELECT event_id, event_type, round(CASE WHEN event_type = 'click' THEN value * 2 ELSE value END, 6) AS value FROM events
"""


def q_top_orders(spark, sf_dir):
    """O1 + O6: first 10 orders by price (top-k, not a full sort)."""
    o = fx.table(spark, sf_dir, "orders")
    return o.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey", R6("o_totalprice").alias("o_totalprice"))


SQL_TOP_ORDERS = """
SELECT o_orderkey, round(o_totalprice, 6) AS o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10
"""


def q_share_of_total(spark, sf_dir):
    """W3 + P19: share of events per type and scaled size."""
    e = fx.table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    e = stats.share_of_total(e, "n")
    return e.select("event_type", "n", R6("share").alias("share"), R6(stats.scale_by_max("n", 50)).alias("scaled"))


SQL_SHARE_OF_TOTAL = """
SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share,
       round(count(*) / max(count(*)) OVER () * 50, 6) AS scaled FROM events GROUP BY event_type
"""


# --------------------------------------------------------------------------- P10-P12, P15, P16, P20-P22
def q_name_parsing(spark, sf_dir):
    """P10 + P11 + P12: model names and embedding keys built from the data, then parsed."""
    s = fx.table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    a = F.element_at(F.array(*[F.lit(x) for x in ("0_001", "0_5", "1", "10", "inf")]),
                     (F.col("doc_id") % 5).cast("int") + 1)
    name = F.concat(F.lit("hub/"), F.col("lang"), F.lit("_"), F.col("source"), F.lit("_subsamples_model_alpha_"), a,
                    F.lit("_idx_"), (F.col("doc_id") % 3 + 1).cast("string"))
    key = F.concat(F.col("lang"), F.lit("_x_"), F.col("source"), F.lit("_"), F.col("doc_id").cast("string"))
    parsed = s.select("doc_id", *T.parse_model_name(name))
    parsed = parsed.select("doc_id", "model", F.col("dataset").alias("m_dataset"), "dimension", "subsample",
                           T.parse_alpha("subsample").alias("alpha"))
    k = s.select("doc_id", *T.split_embedding_key(key))
    return parsed.join(k, "doc_id")


SQL_NAME_PARSING = r"""
WITH s AS (SELECT doc_id, source, lang,
  'hub/' || lang || '_' || source || '_subsamples_model_alpha_' ||
  ['0_001', '0_5', '1', '10', 'inf'][CAST(doc_id % 5 AS INTEGER) + 1] || '_idx_' || CAST(doc_id % 3 + 1 AS VARCHAR) AS name,
  lang || '_x_' || source || '_' || CAST(doc_id AS VARCHAR) AS key FROM documents),
p AS (SELECT doc_id, split_part(name, '/', -1) AS model, key FROM s)
SELECT doc_id, model, regexp_extract(model, '^([^_]+)_', 1) AS m_dataset,
       regexp_extract(model, '^[^_]+_([^_]+)_', 1) AS dimension,
       regexp_replace(model, '.*alpha_', 'alpha_') AS subsample,
       CAST(replace(regexp_extract(regexp_replace(model, '.*alpha_', 'alpha_'), '_(\d+(?:_\d+)?|inf)_', 1), '_', '.') AS DOUBLE) AS alpha,
       split_part(key, '_', 1) AS dataset,
       array_to_string(string_split(key, '_')[3:], '_') AS topic
FROM p
"""


def q_qa_texts(spark, sf_dir):
    """P15 + P16 + P22: question+answer texts, first 128 word tokens, formatted ratio."""
    qa = fx.qa_pairs(spark, sf_dir)
    t = T.concat_qa("question", "right_answer")
    toks = T.tokenize(t)
    return qa.select("conv_id", "turn", F.size(toks).alias("n_tokens"),
                     F.size(T.truncate_tokens(toks, 128)).alias("n_kept"),
                     T.format_num(F.size(T.truncate_tokens(toks, 128)) / F.greatest(F.size(toks), F.lit(1))).alias("kept_share"))


SQL_QA_TEXTS = r"""
WITH q AS (SELECT c1.conv_id, c1.turn, c1.text AS question, c2.text AS right_answer
           FROM conversations c1 JOIN conversations c2 ON c1.conv_id = c2.conv_id AND c2.turn = c1.turn + 1
           WHERE c1.role = 'user' AND c2.role = 'assistant'),
t AS (SELECT conv_id, turn, regexp_extract_all(lower(concat_ws(' ', question, right_answer)), '[\p{L}\p{N}_]{2,}') AS toks FROM q)
SELECT conv_id, turn, CAST(len(toks) AS INTEGER) AS n_tokens, CAST(len(toks[1:128]) AS INTEGER) AS n_kept,
       format('{:.3f}', len(toks[1:128]) / greatest(len(toks), 1)) AS kept_share FROM t
"""


def q_p_value_stars(spark, sf_dir):
    """P20 + P21: right-closed bins of a scaled value and star rules on a p-like value."""
    from varietas.operators.stats import with_min_max
    o = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    o = with_min_max(o, "o_totalprice", out="scaled")
    o = o.withColumn("p", (F.col("o_custkey") % 100) / 1000.0)
    return o.select("o_orderkey", T.bin_edges("scaled").alias("bin"), T.stars("p").alias("stars_strict"),
                    T.stars("p", inclusive=True).alias("stars_inclusive"))


SQL_P_VALUE_STARS = """
WITH o AS (SELECT o_orderkey, o_custkey,
  CASE WHEN max(o_totalprice) OVER () > min(o_totalprice) OVER ()
       THEN (o_totalprice - min(o_totalprice) OVER ()) / (max(o_totalprice) OVER () - min(o_totalprice) OVER ())
       ELSE 0.0 END AS scaled, (o_custkey % 100) / 1000.0 AS p FROM orders)
SELECT o_orderkey,
  CASE WHEN scaled IS NULL THEN NULL WHEN scaled <= 0.1 THEN 'low' WHEN scaled <= 0.9 THEN 'middle' ELSE 'high' END AS bin,
  CASE WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS stars_strict,
  CASE WHEN p <= 0.01 THEN '**' WHEN p <= 0.05 THEN '*' ELSE '' END AS stars_inclusive
FROM o
"""


# --------------------------------------------------------------------------- S9
def q_page_links(spark, sf_dir):
    return pg.page_links(fx.table(spark, sf_dir, "pages"), prefix="/")


SQL_PAGE_LINKS = """
WITH l AS (SELECT page_id,
  regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 1) AS hrefs,
  regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 2) AS names FROM pages),
x AS (SELECT page_id, unnest(generate_series(0, len(hrefs) - 1)) AS pos, unnest(hrefs) AS href, unnest(names) AS name
      FROM l WHERE len(hrefs) > 0)
SELECT page_id, CAST(pos AS INTEGER) AS pos, href, replace(name, ' Bias and Reliability', '') AS name,
       replace(lower(replace(name, ' Bias and Reliability', '')), ' ', '-') AS slug
FROM x WHERE starts_with(href, '/')
"""


def q_page_titles(spark, sf_dir):
    return pg.page_titles(fx.table(spark, sf_dir, "pages"))


SQL_PAGE_TITLES = """
SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
       regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS h1,
       regexp_extract(html, '<title>([^<]*)</title>', 1) = regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS same
FROM pages
"""


def q_page_ratings(spark, sf_dir):
    """S9 b: every page with a labelled document of its id gets that document's ratings as bold pairs
    (one of them twice: the later pair counts), and they are read back."""
    lab = fx.table(spark, sf_dir, "labels")
    pair = lambda n, v: F.concat(F.lit(f"<p><strong>{n}: "), v.cast("string"), F.lit("</strong></p>"))
    rated = fx.table(spark, sf_dir, "pages").join(lab, F.col("page_id") == F.col("doc_id")).select(
        "page_id", F.concat("html", pair("Reliability", F.lit(-1)), pair("Reliability", F.col("quality") * 64),
                            pair(" Bias", F.col("toxic") * 84 - 42)).alias("html"))
    return pg.page_ratings(rated)


SQL_PAGE_RATINGS = """
SELECT page_id, CAST(quality * 64 AS DOUBLE) AS reliability, CAST(toxic * 84 - 42 AS DOUBLE) AS bias
FROM pages JOIN labels ON page_id = doc_id
"""


QUERIES = {
    "text_projection": q_text_projection,
    "row_filters": q_row_filters,
    "outlet_variants": q_outlet_variants,
    "topic_vector_join": q_topic_vector_join,
    "whole_vs_subset": q_whole_vs_subset,
    "join_back": q_join_back,
    "pick_test_set": q_pick_test_set,
    "wide_to_long": q_wide_to_long,
    "title_scores": q_title_scores,
    "repeat_k": q_repeat_k,
    "first_turn": q_first_turn,
    "unique_texts": q_unique_texts,
    "union_missing": q_union_missing,
    "split_union": q_split_union,
    "top_orders": q_top_orders,
    "share_of_total": q_share_of_total,
    "name_parsing": q_name_parsing,
    "qa_texts": q_qa_texts,
    "p_value_stars": q_p_value_stars,
    "page_links": q_page_links,
    "page_titles": q_page_titles,
    "page_ratings": q_page_ratings,
}

ORACLE = {
    "text_projection": SQL_TEXT_PROJECTION,
    "row_filters": SQL_ROW_FILTERS,
    "outlet_variants": SQL_OUTLET_VARIANTS,
    "topic_vector_join": SQL_TOPIC_VECTOR_JOIN,
    "whole_vs_subset": SQL_WHOLE_VS_SUBSET,
    "join_back": SQL_JOIN_BACK,
    "pick_test_set": SQL_PICK_TEST_SET,
    "wide_to_long": SQL_WIDE_TO_LONG,
    "title_scores": SQL_TITLE_SCORES,
    "repeat_k": SQL_REPEAT_K,
    "first_turn": SQL_FIRST_TURN,
    "unique_texts": SQL_UNIQUE_TEXTS,
    "union_missing": SQL_UNION_MISSING,
    "split_union": SQL_SPLIT_UNION,
    "top_orders": SQL_TOP_ORDERS,
    "share_of_total": SQL_SHARE_OF_TOTAL,
    "name_parsing": SQL_NAME_PARSING,
    "qa_texts": SQL_QA_TEXTS,
    "p_value_stars": SQL_P_VALUE_STARS,
    "page_links": SQL_PAGE_LINKS,
    "page_titles": SQL_PAGE_TITLES,
    "page_ratings": SQL_PAGE_RATINGS,
}
