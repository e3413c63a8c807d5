"""Queries over bibliographic records: functions, filters, linkage, reporting counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evisift.functions import text
from evisift.operators import linkage
from evisift.plans.filterlang import where
from evisift.session import table

AS_OF_YEAR = 2025


def _one(spark: SparkSession, d: str) -> DataFrame:
    """Records once an id; repeated rows are equal."""
    return table(spark, d, "records").dropDuplicates(["id"])


# --- functions ---------------------------------------------------------------------------------------------------------------


def normalise_doi(spark, d):
    return _one(spark, d).select("id", text.normal_doi(F.col("doi")).alias("doi"))


def normalise_title(spark, d):
    return _one(spark, d).select("id", text.normal_title(F.col("title")).alias("title"))


def normalise_author(spark, d):
    a = _one(spark, d).select("id", F.posexplode("author").alias("pos", "a")).select("id", "pos", F.coalesce("a.family", "a.literal").alias("name"))
    return a.select("id", "pos", text.family_key(F.col("name")).alias("family"))


def normalise_numbers(spark, d):
    return _one(spark, d).select(
        "id", text.first_number(F.col("page")).alias("page"), text.first_number(F.col("volume")).alias("volume"), text.digits(F.col("pmid")).alias("pmid"),
        text.normal_year(F.coalesce("abstract", F.lit("")), AS_OF_YEAR).alias("year_in_abstract"),
    )


def normalise_journal(spark, d):
    return _one(spark, d).select("id", text.journal_key(F.col("container_title")).alias("journal"))


def canonical_key(spark, d):
    r = _one(spark, d)
    year = F.expr("get(get(issued.date_parts, 0), 0)").cast("string")
    first = text.family_key(F.expr("coalesce(get(author, 0).family, get(author, 0).literal)"))
    sig = F.concat(F.lit("sig:"), F.concat_ws("|", text.normal_title(F.col("title")), year, first))
    doi, pmid = text.normal_doi(F.col("doi")), text.digits(F.col("pmid"))
    key = F.coalesce(F.concat(F.lit("doi:"), doi), F.concat(F.lit("pmid:"), pmid), F.when(F.col("title").isNotNull(), sig))
    return r.select("id", key.alias("canonical_key"))


def record_id(spark, d):
    return _one(spark, d).where("doi is not null").select("id", text.base32_id(text.normal_doi(F.col("doi"))).alias("record_id"))


def citation_label(spark, d):
    r = _one(spark, d)
    names = F.expr("transform(author, a -> coalesce(a.family, a.literal))")
    return r.select("id", text.citation_label(names, F.expr("get(get(issued.date_parts, 0), 0)")).alias("label"))


def study_text_facts(spark, d):
    a = _one(spark, d).select("id", F.coalesce("abstract", F.lit("")).alias("t"))
    return a.select(
        "id", F.expr(r"nullif(regexp_extract(t, '(\\d+) participants', 1), '')").try_cast("int").alias("participants"), F.expr(r"nullif(regexp_extract(t, 'identified (\\d+) records', 1), '')").try_cast("int").alias("identified"),
        F.expr(r"array_join(array_sort(array_distinct(regexp_extract_all(t, '(\\d+) weeks', 1))), ',')").alias("weeks"),
    )


def digests(spark, d):
    r = _one(spark, d)
    return r.select("id", text.sha(F.concat_ws("\n", F.col("id"), F.coalesce("title", F.lit("")), F.coalesce("doi", F.lit("")), F.coalesce("page", F.lit("")))).alias("digest"))


# --- filters -----------------------------------------------------------------------------------------------------------------


def _filtered(expression: str):
    def query(spark, d):
        r = _one(spark, d).select("id", "title", "lang", "volume", "doi", F.expr("get(get(issued.date_parts, 0), 0)").alias("year"), F.col("meta.flags").alias("flags"), F.col("meta.canonical").alias("canonical"))
        return where(r, expression).select("id")

    return query


_FIELDS = "WITH r AS (SELECT DISTINCT id, title, lang, volume, doi, issued.date_parts[1][1] AS year, meta.flags AS flags, meta.canonical AS canonical FROM records) SELECT id FROM r WHERE "
FILTERS = {
    "filter_compare": ("year >= 2010 and year < 2015", "year >= 2010 AND year < 2015"),
    "filter_null": ("doi == null or volume == null", "doi IS NULL OR volume IS NULL"),
    "filter_not_null": ("not (doi == null) and lang != 'en'", "doi IS NOT NULL AND lang IS DISTINCT FROM 'en'"),
    "filter_types": ("volume == 12 or year == 2012.0", "year = 2012"),
    "filter_in": ("lang in ['en', 'eng', null]", "lang IN ('en', 'eng') OR lang IS NULL"),
    "filter_not_in": ("lang not in ['en', 'eng']", "lang IS NULL OR lang NOT IN ('en', 'eng')"),
    "filter_contains": ("title contains 'SLEEP' or flags contains 'no-doi'", "coalesce(contains(lower(title), 'sleep'), false) OR list_contains(flags, 'no-doi')"),
    "filter_matches": (r"title matches '^(Effect|Impact) of .*trial' and not lang == 'de'", "regexp_matches(title, '^(Effect|Impact) of .*trial') AND lang IS DISTINCT FROM 'de'"),
    "filter_truthy": ("canonical and not flags", "canonical AND len(flags) = 0"),
    "filter_precedence": ("year > 2015 or year < 2000 and lang == 'en'", "year > 2015 OR (year < 2000 AND lang = 'en')"),
}

# --- linkage -----------------------------------------------------------------------------------------------------------------


def _keyed(spark, d):
    return linkage.keyed(table(spark, d, "records"))


def block_keys(spark, d):
    return linkage.block_keys(_keyed(spark, d)).select("id", "kind", "key")


def oversize_block_split(spark, d):
    keys, _ = linkage.split_oversized(linkage.block_keys(_keyed(spark, d)), most=5)
    return keys.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n"))


def block_candidates(spark, d):
    return linkage.block_pairs(_keyed(spark, d))


def _scored(spark, d):
    k = _keyed(spark, d)
    return linkage.scored(k, linkage.candidate_pairs(linkage.block_keys(k)))


def _auto(k, strict=False):
    return linkage.classified(linkage.likely(k, 1.0 if strict else linkage.AUTO, vetoed=False), strict=strict).where("class = 'auto'").select("a", "b")


def pair_scores(spark, d):
    return _scored(spark, d).select("a", "b", "title", "author", "year", "journal", "locator", "plain_score", "score", "doi_veto")


def dedup_classes(spark, d):
    rc = table(spark, d, "review_candidates").select(F.lower(F.trim("record_a")).alias("a"), F.lower(F.trim("record_b")).alias("b")).where("a is not null and b is not null")
    return linkage.class_counts(_keyed(spark, d), rc)


def dedup_strict(spark, d):
    return _auto(_keyed(spark, d), strict=True)


def dedup_clusters(spark, d):
    return linkage.cluster(_auto(_keyed(spark, d)))


def dedup_survivors(spark, d):
    k = linkage.written(_keyed(spark, d))
    trust = _one(spark, d).select("id", F.explode("meta.sources").alias("s")).select("id", F.col("s.db_name").alias("db_name")).join(F.broadcast(table(spark, d, "source_trust")), "db_name").groupBy("id").agg(F.min("trust_rank").alias("rank"))
    return linkage.survivors(k, linkage.cluster(_auto(k)), trust)


def dedup_metrics(spark, d):
    """Auto-merges against pairs with one DOI."""
    k = linkage.written(_keyed(spark, d))
    one = k.where("doi is not null").select("id", "doi")
    truth = one.withColumnRenamed("id", "a").join(one.withColumnRenamed("id", "b"), "doi").where("a < b").select("a", "b")
    return linkage.metrics(_auto(k), truth)


def dedup_greedy(spark, d):
    return linkage.greedy(_keyed(spark, d))


def minhash_candidates(spark, d):
    return linkage.lsh_pairs(linkage.titled(table(spark, d, "records")))


def alias_resolve(spark, d):
    """Each order number's last alias, where n stands for n / 2 down to an odd number: chains of pointers, doubled until they end."""
    e = table(spark, d, "orders").select(F.col("o_orderkey").alias("id")).where("id > 0").distinct()
    hop = e.select("id", F.when(F.col("id") % 2 == 0, (F.col("id") / 2).cast("bigint")).otherwise(F.col("id")).alias("to"))
    return linkage.chain_ends(hop).select("id", F.col("to").alias("canonical"))


def amendment_fold(spark, d):
    return linkage.amended(table(spark, d, "amendments")).select("record_id", "field", "new_value", "ts")


def merged_keywords(spark, d):
    """Of each DOI: keywords of all its records, the longest abstract, all sources."""
    r = _one(spark, d).select("id", text.normal_doi(F.col("doi")).alias("doi"), F.expr("split(keyword, '; ')").alias("k"), "abstract", F.expr("transform(meta.sources, s -> s.db_name)").alias("s")).where("doi is not null")
    return r.groupBy("doi").agg(
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("k")))), "; ").alias("keywords"), F.max(F.length("abstract")).alias("abstract_length"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("s")))), ",").alias("sources"), F.count(F.lit(1)).alias("records"),
    )


# --- reporting ---------------------------------------------------------------------------------------------------------------


def _origin():
    return F.when(F.exists("meta.sources", lambda s: s["via"].isNull() | (s["via"] == "") | (s["via"] == "search")), "searches").otherwise(F.coalesce(F.expr("get(meta.sources, 0).via"), F.lit("searches")))


def record_origin(spark, d):
    return _one(spark, d).select("id", _origin().alias("origin"))


def funnel_counts(spark, d):
    """Identified, with and without identifiers, per origin and in total."""
    r = table(spark, d, "records").select("id", _origin().alias("origin"), "doi", "abstract", "title")
    g = r.rollup("origin").agg(F.grouping_id().alias("whole"), F.count(F.lit(1)).alias("rows_read"), F.count_distinct("id").alias("identified"), F.count_distinct(F.when(F.col("doi").isNotNull(), F.col("id"))).alias("with_doi"), F.count_distinct(F.when(F.col("title").isNull(), F.col("id"))).alias("rejected"))
    return g.select(F.when(F.col("whole") == 1, "total").otherwise(F.col("origin")).alias("origin"), "rows_read", "identified", (F.col("rows_read") - F.col("identified")).alias("duplicates"), "with_doi", "rejected")


def funnel_identities(spark, d):
    f = funnel_counts(spark, d)
    parts = f.where("origin <> 'total'").agg(F.sum("rows_read").alias("rows_read"), F.sum("identified").alias("identified"))
    total = f.where("origin = 'total'").select(F.col("rows_read").alias("t_rows"), F.col("identified").alias("t_identified"), F.col("duplicates").alias("t_duplicates"))
    j = parts.crossJoin(total)  # one row each
    return j.select(F.explode(F.array(
        F.struct(F.lit("rows").alias("identity"), F.col("rows_read").alias("lhs"), F.col("t_rows").alias("rhs")),
        F.struct(F.lit("identified").alias("identity"), F.col("identified").alias("lhs"), F.col("t_identified").alias("rhs")),
        F.struct(F.lit("rows=identified+duplicates").alias("identity"), F.col("t_rows").alias("lhs"), (F.col("t_identified") + F.col("t_duplicates")).alias("rhs")),
    )).alias("x")).select("x.identity", "x.lhs", "x.rhs", (F.col("x.lhs") == F.col("x.rhs")).alias("holds"))


def exclusion_reasons_topk(spark, d):
    """The five commonest first reasons of exclusions in the tools' exports; the rest as one."""
    t = table(spark, d, "tool_decisions").where("lower(trim(decision)) like 'exclud%' and size(reasons) > 0").dropDuplicates(["tool", "row_no"])
    c = t.select(F.array_min("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    r = c.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "reason")))  # a few reasons, already aggregated
    return r.groupBy(F.when(F.col("rank") <= 5, F.col("reason")).otherwise("Other reasons").alias("reason")).agg(F.sum("n").alias("n"))


def retrieval_counts(spark, d):
    t = table(spark, d, "tool_decisions").where("stage = 'full-text'").dropDuplicates(["tool", "row_no"])
    status = F.when(F.array_contains("reasons", "not retrievable"), "not-retrieved").when(F.lower(F.trim("decision")).rlike("^(includ|exclud|yes|no)"), "retrieved").otherwise("sought")
    return t.groupBy("tool", status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def source_counts(spark, d):
    s = _one(spark, d).select("id", F.explode("meta.sources").alias("s"))
    return s.groupBy(F.col("s.db_name").alias("db_name"), F.col("s.via").alias("via")).agg(F.count_distinct("id").alias("records"), F.count(F.lit(1)).alias("rows"))


def citation_keys(spark, d):
    """A key of first author and year; letters tell equal keys apart."""
    r = _one(spark, d).select("id", text.family_key(F.expr("coalesce(get(author, 0).family, get(author, 0).literal, 'anon')")).alias("f"), F.expr("get(get(issued.date_parts, 0), 0)").alias("y"))
    b = r.select("id", F.concat(F.regexp_replace("f", " ", ""), F.coalesce(F.col("y").cast("string"), F.lit("nd"))).alias("base"))
    n = F.row_number().over(Window.partitionBy("base").orderBy("id"))
    return b.select("id", F.concat("base", F.when(n > 1, F.concat(F.lit("-"), n.cast("string"))).otherwise("")).alias("key"))


def three_way_merge(spark, d):
    """Volumes as three parties have them: the first, second and third source of one DOI by id; theirs wins where only it differs from the base, else ours."""
    r = _one(spark, d).select("id", text.normal_doi(F.col("doi")).alias("doi"), F.coalesce("volume", F.lit("-")).alias("v")).where("doi is not null")
    w = r.withColumn("n", F.row_number().over(Window.partitionBy("doi").orderBy("id")))
    side = lambda k, name: w.where(F.col("n") == k).select("doi", F.col("v").alias(name))
    j = side(1, "base").join(side(2, "ours"), "doi").join(side(3, "theirs"), "doi", "full")
    merged = F.when(F.col("ours").eqNullSafe(F.col("base")), F.coalesce("theirs", "ours")).otherwise(F.col("ours"))
    return j.select("doi", "base", "ours", "theirs", merged.alias("merged"), (~F.col("ours").eqNullSafe(F.col("base")) & F.col("theirs").isNotNull() & ~F.col("theirs").eqNullSafe(F.col("base")) & ~F.col("theirs").eqNullSafe(F.col("ours"))).alias("conflict"))


def verify_records(spark, d):
    r = table(spark, d, "records")
    rc = table(spark, d, "review_candidates").select(F.explode(F.array("record_a", "record_b")).alias("id")).where("id is not null")
    codes = [
        ("E_DUPLICATE_ID", r.groupBy("id").count().where("count > 1").select("id")),
        ("E_NO_TITLE", r.where("title is null or trim(title) = ''").select("id").distinct()),
        ("E_DANGLING_REF", rc.select("id").distinct().join(r.select("id"), "id", "left_anti")),
        ("E_DATE", r.where("exists(issued.date_parts, p -> get(p, 1) > 12 or get(p, 0) > 2100 or get(p, 0) = 0)").select("id").distinct()),
    ]
    out = None
    for code, rows in codes:
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(code).alias("code"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def characteristics(spark, d):
    """Study by field: how many values four fields of the coding form have; :func:`characteristics_values` shows the values of all fields."""
    e = table(spark, d, "extraction_values").dropDuplicates(["value_id"])
    fields = [f"{x}" for x in ("follow_up", "sample_size", "mean_age", "daily_dose")]
    return e.groupBy("study").pivot("field", fields).agg(F.count("value")).na.fill(0)


def characteristics_values(spark, d):
    """Study by field: the values of the coding form side by side, for each field of the form all entries in order of value_id, and how many of them have a value."""
    e = table(spark, d, "extraction_values").dropDuplicates(["value_id"])
    # the form has a fixed list of fields
    fields = [r["field"] for r in table(spark, d, "form_fields").select("field").where("field is not null").distinct().orderBy("field").collect()]
    entry = F.struct("value_id", "value", "unit", "entered", "not_reported")
    aggs = [x for f in fields for x in (F.sort_array(F.collect_list(F.when(F.col("field") == f, entry))).alias(f), F.count(F.when(F.col("field") == f, F.col("value"))).alias(f"{f}_n"))]
    return e.groupBy("study").agg(*aggs)


def completeness(spark, d):
    """Required fields of the form that a study has no entry for."""
    e = table(spark, d, "extraction_values")
    f = F.broadcast(table(spark, d, "form_fields").select("field"))
    every = e.select("study").distinct().crossJoin(f)  # the form has a fixed list of fields
    return every.join(e.select("study", "field").distinct(), ["study", "field"], "left_anti").groupBy("field").agg(F.count(F.lit(1)).alias("missing"))


def reviewer_comparison(spark, d):
    """Values that two extractors recorded for one study and field, and whether they agree; not reported counts as an answer."""
    e = table(spark, d, "extraction_values").dropDuplicates(["value_id"]).where("extracted_by is not null").select("study", "field", "extracted_by", F.when(F.col("not_reported"), F.lit(-1.0)).otherwise(F.col("value")).alias("v"), "value_id")
    first = e.groupBy("study", "field", "extracted_by").agg(F.min_by("v", "value_id").alias("v"))
    j = first.alias("a").join(first.alias("b"), ["study", "field"]).where("a.extracted_by < b.extracted_by")
    return j.groupBy("field").agg(F.count(F.lit(1)).alias("compared"), F.count(F.when(F.col("a.v").eqNullSafe(F.col("b.v")), 1)).alias("agreed"))


QUERIES = {
    f.__name__: f
    for f in (
        normalise_doi, normalise_title, normalise_author, normalise_numbers, normalise_journal, canonical_key, record_id, citation_label, study_text_facts, digests,
        block_keys, oversize_block_split, block_candidates, pair_scores, dedup_classes, dedup_strict, dedup_clusters, dedup_survivors, dedup_metrics, dedup_greedy, minhash_candidates,
        alias_resolve, amendment_fold, merged_keywords, record_origin, funnel_counts, funnel_identities, exclusion_reasons_topk, retrieval_counts, source_counts,
        citation_keys, three_way_merge, verify_records, characteristics, characteristics_values, completeness, reviewer_comparison,
    )
} | {name: _filtered(expression) for name, (expression, _) in FILTERS.items()}

_R = "r AS (SELECT DISTINCT ON (id) * FROM records)"
_ENT = "replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"


def _fold(c: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents({c})), '[^a-z0-9]+', ' ', 'g'))"


def _title(c: str) -> str:
    return _fold(f"regexp_replace({_ENT.format(c)}, '<[^>]*>', '', 'g')")


def _doi(c: str) -> str:
    x = f"regexp_replace(regexp_replace(lower(trim({c})), '^(https?://[^/]+/|doi[: ]\\s*)', ''), '[.,;)]$', '')"
    return f"CASE WHEN regexp_matches({x}, '^10\\.\\d{{4,9}}/\\S+$') THEN {x} END"


def _family(c: str) -> str:
    parts = ", ".join(f"'{p}'" for p in text.PARTICLES)
    f = _fold(c)
    return f"CASE WHEN len(string_split({f}, ' ')) > 1 AND string_split({f}, ' ')[1] IN ({parts}) THEN array_to_string(string_split({f}, ' ')[2:], ' ') ELSE {f} END"


def _journal(c: str) -> str:
    table_ = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in text.JOURNAL_WORDS.items()) + "}"
    return f"array_to_string([coalesce({table_}[w], w) for w in string_split({_title(c)}, ' ')], ' ')"


def _num(c: str) -> str:
    return f"nullif(regexp_extract({c}, '(\\d+)', 1), '')"


_YEAR = "issued.date_parts[1][1]"
_ORIGIN = "CASE WHEN len([s for s in meta.sources if s.via IS NULL OR s.via IN ('', 'search')]) > 0 THEN 'searches' ELSE coalesce(meta.sources[1].via, 'searches') END"
_K = f"""k AS (SELECT id, {_title('title')} AS title, [{_family("coalesce(a.family, a.literal, '')")} for a in coalesce(author, [])] AS authors, {_YEAR} AS year, {_journal('container_title')} AS journal, {_num('volume')} AS volume, {_num('page')} AS page,
  {_doi('doi')} AS doi, nullif(trim(pmid), '') AS pmid, coalesce(list_contains(meta.flags, 'best-effort-parse'), false) AS best_effort,
  (doi IS NOT NULL)::INT + (abstract IS NOT NULL)::INT + (len(coalesce(author, [])) > 0)::INT + (page IS NOT NULL)::INT AS complete FROM r WHERE id IS NOT NULL)"""
_BK = """bk AS (SELECT id, year, kind, key FROM (
  SELECT id, year, 'doi' AS kind, doi AS key FROM k UNION ALL SELECT id, year, 'pmid', pmid FROM k
  UNION ALL SELECT id, year, 'title-year', CASE WHEN title <> '' THEN substring(title, 1, 12) || '|' || coalesce(year::VARCHAR, '') END FROM k
  UNION ALL SELECT id, year, 'author-year-volume', CASE WHEN authors[1] <> '' AND year IS NOT NULL AND volume <> '' THEN authors[1] || '|' || year || '|' || volume END FROM k
  UNION ALL SELECT id, year, 'journal-volume-page', CASE WHEN journal <> '' AND volume <> '' AND page <> '' THEN journal || '|' || volume || '|' || page END FROM k) WHERE key <> '')"""
_BLOCKS = f"WITH {_R}, {_K}, {_BK}"
_PAIRS = "pr AS (SELECT DISTINCT x.id AS a, y.id AS b FROM bk x JOIN bk y USING (kind, key) WHERE x.id < y.id)"
_RATIO = "CASE WHEN greatest(length({a}), length({b})) > 0 THEN 1 - levenshtein({a}, {b}) / greatest(length({a}), length({b})) ELSE 0 END"
_JACC = "CASE WHEN len(list_distinct(list_concat({a}, {b}))) > 0 THEN len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) ELSE 0 END"
_FEAT = f"""ft AS (SELECT a, b, ka.doi AS da, kb.doi AS db, ka.best_effort OR kb.best_effort AS best_effort,
  round_even(greatest({_JACC.format(a='wa', b='wb')}, {_RATIO.format(a='sa', b='sb')}), 6) AS title,
  round_even(({_JACC.format(a='list_distinct(ka.authors)', b='list_distinct(kb.authors)')}) / CASE WHEN len(ka.authors) = 1 OR len(kb.authors) = 1 THEN 2 ELSE 1 END, 6) AS author,
  CASE abs(ka.year - kb.year) WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END AS year,
  round_even(coalesce({_RATIO.format(a='ka.journal', b='kb.journal')}, 0), 6) AS journal,
  CASE WHEN ka.volume = kb.volume AND ka.page = kb.page THEN 1.0::DOUBLE WHEN ka.volume = kb.volume OR ka.page = kb.page THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS locator
  FROM (SELECT a, b, ka, kb, [w for w in list_distinct(string_split(ka.title, ' ')) if w <> ''] AS wa, [w for w in list_distinct(string_split(kb.title, ' ')) if w <> ''] AS wb,
    array_to_string(list_sort([w for w in list_distinct(string_split(ka.title, ' ')) if w <> '']), ' ') AS sa, array_to_string(list_sort([w for w in list_distinct(string_split(kb.title, ' ')) if w <> '']), ' ') AS sb
    FROM pr JOIN k ka ON ka.id = a JOIN k kb ON kb.id = b))"""
_PLAIN = "floor((" + " + ".join(f"CAST(round({n} * 1000000) AS BIGINT) * {round(w * 100)}" for n, w in linkage.WEIGHTS.items()) + ") / 100) / 1e6"
_SCORE = f"""sc AS (SELECT a, b, title, author, year, journal, locator, {_PLAIN} AS plain_score,
  CASE WHEN da IS NOT NULL AND db IS NOT NULL THEN CASE WHEN da = db THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE {_PLAIN} END AS score,
  coalesce(da IS NOT NULL AND db IS NOT NULL AND da <> db, false) AS doi_veto, best_effort FROM ft)"""
_CLASS = "CASE WHEN score >= 0.95 AND NOT best_effort THEN 'auto' WHEN score >= 0.8 OR (doi_veto AND plain_score >= 0.8) THEN 'review' ELSE 'distinct' END"
_SCORED = f"{_BLOCKS}, {_PAIRS}, {_FEAT}, {_SCORE}"
_SCORED_R = _SCORED.replace("WITH ", "WITH RECURSIVE ", 1)
_CLUST = f"""au AS (SELECT a, b FROM sc WHERE {_CLASS} = 'auto'), e AS (SELECT a, b FROM au UNION SELECT b, a FROM au),
  w(id, g) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, w.g FROM w JOIN e ON e.a = w.id AND w.g < e.b), cl AS (SELECT id, min(g) AS cluster FROM w GROUP BY id)"""

ORACLE = {name: _FIELDS + sql for name, (_, sql) in FILTERS.items()} | {
    "normalise_doi": f"WITH {_R} SELECT id, {_doi('doi')} AS doi FROM r",
    "normalise_title": f"WITH {_R} SELECT id, {_title('title')} AS title FROM r",
    "normalise_author": f"WITH {_R}, a AS (SELECT id, unnest(author) AS a, generate_subscripts(author, 1) - 1 AS pos FROM r) SELECT id, CAST(pos AS INT) AS pos, {_family('coalesce(a.family, a.literal)')} AS family FROM a",
    "normalise_numbers": f"WITH {_R} SELECT id, {_num('page')} AS page, {_num('volume')} AS volume, nullif(regexp_replace(pmid, '\\D', '', 'g'), '') AS pmid, [y for y in [CAST(x AS INT) for x in regexp_extract_all(coalesce(abstract, ''), '\\d{{4}}')] if y >= 1400 AND y <= {AS_OF_YEAR + 2}][1] AS year_in_abstract FROM r",
    "normalise_journal": f"WITH {_R} SELECT id, {_journal('container_title')} AS journal FROM r",
    "canonical_key": f"WITH {_R} SELECT id, coalesce('doi:' || {_doi('doi')}, 'pmid:' || nullif(regexp_replace(pmid, '\\D', '', 'g'), ''), CASE WHEN title IS NOT NULL THEN 'sig:' || concat_ws('|', {_title('title')}, {_YEAR}, {_family('coalesce(author[1].family, author[1].literal)')}) END) AS canonical_key FROM r",
    "citation_label": f"""WITH {_R}, n AS (SELECT id, [coalesce(a.family, a.literal) for a in author] AS f, {_YEAR} AS y FROM r)
      SELECT id, CASE WHEN f IS NULL OR len(f) < 1 THEN '(no author)' ELSE CASE len(f) WHEN 1 THEN f[1] WHEN 2 THEN f[1] || ' & ' || f[2] ELSE f[1] || ' et al.' END || ' (' || coalesce(CAST(y AS VARCHAR), 'n.d.') || ')' END AS label FROM n""",
    "study_text_facts": f"""WITH {_R} SELECT id, TRY_CAST(nullif(regexp_extract(coalesce(abstract, ''), '(\\d+) participants', 1), '') AS INT) AS participants, TRY_CAST(nullif(regexp_extract(coalesce(abstract, ''), 'identified (\\d+) records', 1), '') AS INT) AS identified,
      array_to_string(list_sort(list_distinct(regexp_extract_all(coalesce(abstract, ''), '(\\d+) weeks', 1))), ',') AS weeks FROM r""",
    "digests": f"WITH {_R} SELECT id, sha256(id || chr(10) || coalesce(title, '') || chr(10) || coalesce(doi, '') || chr(10) || coalesce(page, '')) AS digest FROM r",
    "block_keys": f"{_BLOCKS} SELECT id, kind, key FROM bk",
    "oversize_block_split": f"{_BLOCKS}, z AS (SELECT kind, key FROM bk GROUP BY ALL HAVING count(*) > 5) SELECT kind, CASE WHEN z.key IS NOT NULL THEN bk.key || '|' || coalesce(CAST(year AS VARCHAR), '-') ELSE bk.key END AS key, count(*) AS n FROM bk LEFT JOIN z USING (kind, key) GROUP BY ALL",
    "block_candidates": f"{_BLOCKS}, {_PAIRS} SELECT * FROM pr",
    "pair_scores": f"{_SCORED} SELECT a, b, title, author, year, journal, locator, plain_score, score, doi_veto FROM sc",
    "dedup_classes": f"{_SCORED}, j AS (SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b FROM (SELECT lower(trim(record_a)) AS x, lower(trim(record_b)) AS y FROM review_candidates) WHERE x IS NOT NULL AND y IS NOT NULL) SELECT {_CLASS} AS class, count(*) AS n FROM sc ANTI JOIN j USING (a, b) GROUP BY ALL",
    "dedup_strict": f"{_SCORED} SELECT a, b FROM sc WHERE score >= 1.0 AND NOT best_effort",
    "dedup_clusters": f"{_SCORED_R}, {_CLUST} SELECT * FROM cl",
    "dedup_survivors": f"""{_SCORED_R}, {_CLUST}, t AS (SELECT id, min(trust_rank) AS rank FROM (SELECT id, unnest(meta.sources).db_name AS db_name FROM r) JOIN source_trust USING (db_name) GROUP BY id)
      SELECT cluster, arg_min(cl.id, (-complete, coalesce(rank, 99), cl.id)) AS survivor, count(*) AS n FROM cl JOIN k ON k.id = cl.id LEFT JOIN t ON t.id = cl.id GROUP BY cluster""",
    "dedup_metrics": f"""{_SCORED}, au AS (SELECT a, b FROM sc WHERE {_CLASS} = 'auto'), tr AS (SELECT x.id AS a, y.id AS b FROM k x JOIN k y ON x.doi = y.doi AND x.id < y.id),
      s AS (SELECT count(*) FILTER (f AND t) AS tp, count(*) FILTER (f AND t IS NULL) AS fp, count(*) FILTER (t AND f IS NULL) AS fn FROM (SELECT *, true AS f FROM au) FULL JOIN (SELECT *, true AS t FROM tr) USING (a, b))
      SELECT tp, fp, fn, round_even(tp / (tp + fp), 6) AS precision, round_even(tp / (tp + fn), 6) AS recall, round_even(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1, round_even(fp / (tp + fp), 6) AS false_merge_rate FROM s""",
    "alias_resolve": """WITH RECURSIVE w(id, n) AS (SELECT DISTINCT o_orderkey, o_orderkey FROM orders WHERE o_orderkey > 0 UNION ALL SELECT id, n // 2 FROM w WHERE n % 2 = 0) SELECT id, min(n) AS canonical FROM w GROUP BY id""",
    "amendment_fold": "WITH a AS (SELECT trim(record_id) AS record_id, lower(trim(field)) AS field, new_value, ts, event_id FROM amendments) SELECT record_id, field, arg_max(struct_pack(v := new_value), (ts, event_id)).v AS new_value, max(ts) AS ts FROM a GROUP BY ALL",
    "merged_keywords": f"""WITH {_R}, x AS (SELECT {_doi('doi')} AS doi, string_split(keyword, '; ') AS k, abstract, [s.db_name for s in meta.sources] AS s FROM r)
      SELECT doi, coalesce(array_to_string(list_sort(list_distinct(flatten(list(k) FILTER (k IS NOT NULL)))), '; '), '') AS keywords, CAST(max(length(abstract)) AS INT) AS abstract_length, array_to_string(list_sort(list_distinct(flatten(list(s)))), ',') AS sources, count(*) AS records FROM x WHERE doi IS NOT NULL GROUP BY doi""",
    "record_origin": f"WITH {_R} SELECT id, {_ORIGIN} AS origin FROM r",
    "funnel_counts": f"""WITH x AS (SELECT id, {_ORIGIN} AS origin, doi, title FROM records) SELECT coalesce(origin, 'total') AS origin, count(*) AS rows_read, count(DISTINCT id) AS identified, count(*) - count(DISTINCT id) AS duplicates,
      count(DISTINCT id) FILTER (doi IS NOT NULL) AS with_doi, count(DISTINCT id) FILTER (title IS NULL) AS rejected FROM x GROUP BY ROLLUP (origin)""",
    "funnel_identities": f"""WITH x AS (SELECT id, {_ORIGIN} AS origin FROM records), p AS (SELECT origin, count(*) AS n, count(DISTINCT id) AS u FROM x GROUP BY origin), t AS (SELECT count(*) AS n, count(DISTINCT id) AS u FROM x)
      SELECT identity, CAST(lhs AS BIGINT) AS lhs, CAST(rhs AS BIGINT) AS rhs, lhs = rhs AS holds FROM (SELECT 'rows' AS identity, (SELECT sum(n) FROM p) AS lhs, (SELECT n FROM t) AS rhs UNION ALL SELECT 'identified', (SELECT sum(u) FROM p), (SELECT u FROM t)
      UNION ALL SELECT 'rows=identified+duplicates', (SELECT n FROM t), (SELECT u + (n - u) FROM t))""",
    "exclusion_reasons_topk": """WITH t AS (SELECT DISTINCT ON (tool, row_no) * FROM tool_decisions), c AS (SELECT list_min(reasons) AS reason, count(*) AS n FROM t WHERE lower(trim(decision)) LIKE 'exclud%' AND len(reasons) > 0 GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (ORDER BY n DESC, reason) AS rank FROM c) SELECT CASE WHEN rank <= 5 THEN reason ELSE 'Other reasons' END AS reason, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY ALL""",
    "retrieval_counts": """WITH t AS (SELECT DISTINCT ON (tool, row_no) * FROM tool_decisions WHERE stage = 'full-text') SELECT tool, CASE WHEN list_contains(reasons, 'not retrievable') THEN 'not-retrieved'
      WHEN regexp_matches(lower(trim(decision)), '^(includ|exclud|yes|no)') THEN 'retrieved' ELSE 'sought' END AS status, count(*) AS n FROM t GROUP BY ALL""",
    "source_counts": f"WITH {_R}, s AS (SELECT id, unnest(meta.sources) AS s FROM r) SELECT s.db_name AS db_name, s.via AS via, count(DISTINCT id) AS records, count(*) AS rows FROM s GROUP BY ALL",
    "citation_keys": f"""WITH {_R}, b AS (SELECT id, replace({_family("coalesce(author[1].family, author[1].literal, 'anon')")}, ' ', '') || coalesce(CAST({_YEAR} AS VARCHAR), 'nd') AS base FROM r)
      SELECT id, base || CASE WHEN row_number() OVER w > 1 THEN '-' || row_number() OVER w ELSE '' END AS key FROM b WINDOW w AS (PARTITION BY base ORDER BY id)""",
    "three_way_merge": f"""WITH {_R}, x AS (SELECT id, {_doi('doi')} AS doi, coalesce(volume, '-') AS v FROM r), w AS (SELECT *, row_number() OVER (PARTITION BY doi ORDER BY id) AS n FROM x WHERE doi IS NOT NULL),
      j AS (SELECT doi, base, ours, theirs FROM (SELECT doi, v AS base FROM w WHERE n = 1) JOIN (SELECT doi, v AS ours FROM w WHERE n = 2) USING (doi) FULL JOIN (SELECT doi, v AS theirs FROM w WHERE n = 3) USING (doi))
      SELECT *, CASE WHEN ours IS NOT DISTINCT FROM base THEN coalesce(theirs, ours) ELSE ours END AS merged, ours IS DISTINCT FROM base AND theirs IS NOT NULL AND theirs IS DISTINCT FROM base AND theirs IS DISTINCT FROM ours AS conflict FROM j""",
    "verify_records": """SELECT 'E_DUPLICATE_ID' AS code, count(*) AS n FROM (SELECT id FROM records GROUP BY id HAVING count(*) > 1) UNION ALL SELECT 'E_NO_TITLE', count(DISTINCT id) FROM records WHERE title IS NULL OR trim(title) = ''
      UNION ALL SELECT 'E_DANGLING_REF', count(*) FROM (SELECT DISTINCT unnest([record_a, record_b]) AS id FROM review_candidates) x WHERE id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM records r WHERE r.id = x.id)
      UNION ALL SELECT 'E_DATE', count(DISTINCT id) FROM records WHERE len([p for p in issued.date_parts if p[2] > 12 OR p[1] > 2100 OR p[1] = 0]) > 0""",
    "characteristics": "WITH e AS (SELECT DISTINCT ON (value_id) * FROM extraction_values) SELECT study, " + ", ".join(f"count(value) FILTER (field = '{f}') AS {f}" for f in ("follow_up", "sample_size", "mean_age", "daily_dose")) + " FROM e GROUP BY study",
    "completeness": "SELECT field, count(*) AS missing FROM (SELECT DISTINCT study FROM extraction_values) CROSS JOIN (SELECT field FROM form_fields) ANTI JOIN (SELECT DISTINCT study, field FROM extraction_values) USING (study, field) GROUP BY field",
    "reviewer_comparison": """WITH e AS (SELECT DISTINCT ON (value_id) * FROM extraction_values), f AS (SELECT study, field, extracted_by, arg_min(struct_pack(v := CASE WHEN not_reported THEN -1.0 ELSE value END), value_id).v AS v FROM e WHERE extracted_by IS NOT NULL GROUP BY ALL)
      SELECT field, count(*) AS compared, count(*) FILTER (a.v IS NOT DISTINCT FROM b.v) AS agreed FROM f a JOIN f b USING (study, field) WHERE a.extracted_by < b.extracted_by GROUP BY field""",
}
