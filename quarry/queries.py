"""Queries of the search and cleaning operators over the driver's tables, and their SQL (DuckDB).

Customers with their nations and regions stand for company records; documents for indexed texts; embeddings (vec_id
as doc_id) for vectors; supplier rows for reviews.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import bm25, cleaning, evaluate, fusion, index, results, vector
from quarry.plans.engine import SearchEngine
from quarry.session import fresh_path, ship
from quarry.sources import html
from quarry.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# --- tables ------------------------------------------------------------------------------------------------


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


PLACES = ("Hà Nội", "TP Hồ Chí Minh", "Đà Nẵng", "tỉnh Hải Dương", "Thành phố Cần Thơ", "HCM", "hn", "TP. Huế", "Tỉnh Bắc Ninh", "Nowhere")


def companies(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, company_name, tax_code, address, representative, status, industry, url of each customer."""
    c, n, r = table(spark, d, "customer"), table(spark, d, "nation"), table(spark, d, "region")
    joined = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    key = F.col("c_custkey")
    return joined.select(
        key.alias("doc_id"),
        F.concat(F.when(key % 3 == 0, "CÔNG TY TNHH ").when(key % 3 == 1, "Công ty CP ").otherwise("O'NEIL & "), F.col("c_name")).alias("company_name"),
        F.lpad(key.cast("string"), 10, "0").alias("tax_code"),
        F.concat(F.lit(", Số "), key.cast("string"), F.lit(", "), F.col("n_name"), F.lit(", "), F.element_at(F.array(*map(F.lit, PLACES)), (key % len(PLACES) + 1).cast("int"))).alias("address"),
        F.when(key % 4 == 0, F.lit(None)).when(key % 4 == 1, "None").otherwise(F.concat(F.lit("Ông "), F.col("r_name"))).alias("representative"),
        F.when(F.col("c_mktsegment") == "BUILDING", "NNT ngừng hoạt động").when(F.col("c_mktsegment") == "FURNITURE", "Đã giải thể").otherwise("NNT đang hoạt động").alias("status"),
        F.when(key % 5 != 0, F.concat(F.lower("c_mktsegment"), F.lit("_goods"))).alias("industry"),
        F.concat(F.lit("/companies/customer-"), key.cast("string")).alias("url"),
    )


COMPANIES = "companies AS (\n  SELECT c_custkey AS doc_id,\n" + f"""
    (CASE c_custkey % 3 WHEN 0 THEN 'CÔNG TY TNHH ' WHEN 1 THEN 'Công ty CP ' ELSE 'O''NEIL & ' END) || c_name AS company_name,
    lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS tax_code,
    ', Số ' || c_custkey || ', ' || n_name || ', ' || {list(PLACES)}[CAST(c_custkey % {len(PLACES)} + 1 AS INT)] AS address,
    CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'None' ELSE 'Ông ' || r_name END AS representative,
    CASE c_mktsegment WHEN 'BUILDING' THEN 'NNT ngừng hoạt động' WHEN 'FURNITURE' THEN 'Đã giải thể' ELSE 'NNT đang hoạt động' END AS status,
    CASE WHEN c_custkey % 5 <> 0 THEN lower(c_mktsegment) || '_goods' END AS industry,
    '/companies/customer-' || c_custkey AS url
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

_PUNCT = T.punctuation_class().replace("'", "''")
TOKENS = f"""tok AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r]+'),
    lambda x: x <> '' AND (length(x) > 1 OR regexp_matches(x, '^\\p{{Nd}}$')) AND NOT regexp_matches(x, '^{_PUNCT}+$')) AS toks FROM documents)"""
INDEX = TOKENS + """,
post AS (SELECT term, doc_id, CAST(count(*) AS INT) AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM tok) GROUP BY ALL),
terms AS (SELECT term, count(*) AS df FROM post GROUP BY term),
lens AS (SELECT doc_id, CAST(len(toks) AS INT) AS dl FROM tok),
stats AS (SELECT count(*) AS n, CAST(sum(dl) AS BIGINT) AS total_len, CAST(sum(dl) AS DOUBLE) / count(*) AS avgdl FROM lens)"""

_indexes: dict[tuple[str, str], index.Index] = {}


def shared_index(spark: SparkSession, d: str) -> index.Index:
    """The index of the documents, kept for all queries of a session."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _indexes:
        _indexes[key] = index.build(docs(spark, d).select("doc_id", "text")).persist()
    return _indexes[key]


def add(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = sql
        return f

    return put


# --- sources and text functions ------------------------------------------------------------------------------


@add("SELECT doc_id, text, lang, source FROM documents WHERE trim(text) <> ''")
def scan_documents(spark, d):
    return docs(spark, d).where(F.trim("text") != "").select("doc_id", "text", "lang", "source")


@add("SELECT page_id, url, CAST(length(html) AS INT) AS n_html FROM pages")
def scan_pages(spark, d):
    return table(spark, d, "pages").select("page_id", "url", F.length("html").alias("n_html"))


@add(r"""SELECT page_id, url FROM pages WHERE NOT (regexp_matches(html, '(?is)<title[^>]*>[^<]+</title>')
  AND len(regexp_extract_all(html, '(?i)<a\s[^>]*href="([^"]*)"', 1)) >= 6)""")
def page_parse_rejects(spark, d):
    """Pages without a title or with fewer than 6 links: the failures of a parse."""
    ok = F.col("html").rlike(r"(?is)<title[^>]*>[^<]+</title>") & (F.size(html.links(F.col("html"))) >= 6)
    return table(spark, d, "pages").where(~ok).select("page_id", "url")


@add("SELECT page_id FROM pages WHERE NOT contains(html, 'Không tìm thấy')")
def pages_nonempty(spark, d):
    return table(spark, d, "pages").where(~html.is_empty_page(F.col("html"))).select("page_id")


_WS = r"trim(regexp_replace({}, '[ \t\n\r\f\v]+', ' ', 'g'))"


@add("SELECT page_id, " + _WS.format(r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)") + r""" AS title,
  regexp_extract_all(html, '(?i)<a\s[^>]*href="([^"]*)"', 1) AS links,
  """ + _WS.format(r"regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g')") + " AS body FROM pages")
def html_extract(spark, d):
    h = F.col("html")
    return table(spark, d, "pages").select("page_id", html.title(h).alias("title"), html.links(h).alias("links"), html.visible_text(h).alias("body"))


@add(r"""SELECT page_id, link, CASE WHEN starts_with(link, 'http') THEN link WHEN starts_with(link, '/') THEN 'https://x.example' || link
  ELSE 'https://x.example/' || link END AS absolute
  FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*href="([^"]*)"', 1)) AS link FROM pages)""")
def url_absolutise(spark, d):
    links = table(spark, d, "pages").select("page_id", F.explode(html.links(F.col("html"))).alias("link"))
    return links.select("page_id", "link", T.url_absolute(F.col("link"), "https://x.example").alias("absolute"))


@add("SELECT doc_id, nfc_normalize(replace(text, 'e', 'e' || chr(769))) AS t FROM documents")
def nfc(spark, d):
    """Texts with marks of their own beside their letters, composed."""
    return docs(spark, d).select("doc_id", T.nfc(F.replace("text", F.lit("e"), F.lit("e\u0301"))).alias("t"))


def _tag(name, *parts, **attrs):
    inside = "".join(f' {k}="{v}"' for k, v in attrs.items())
    return F.concat(F.lit(f"<{name.split(' ')[0]}{inside}>"), *parts, F.lit(f"</{name.split(' ')[0]}>"))


def _escaped(c):
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("'"), F.lit("&#39;"))


def listing_pages(spark, d):
    """page, html: the companies as listing pages of 20; every seventh has a short tax code."""
    c = companies(spark, d).withColumn("code", F.when(F.col("doc_id") % 7 == 0, F.substring("tax_code", 1, 8)).otherwise(F.col("tax_code")))
    link = F.concat(F.lit('<a href="'), "url", F.lit('">'), _escaped(F.col("company_name")), F.lit("</a>"))
    item = _tag("div", _tag("h3", link, **{"class": "company-name"}), _tag("p", F.lit("Địa chỉ: "), _escaped(F.col("address"))), _tag("p", F.lit("Mã số thuế: "), F.col("code")), **{"class": "company-item"})
    pages = c.select(F.floor(F.col("doc_id") / 20).alias("page"), F.struct("doc_id", item.alias("h")).alias("i")).groupBy("page").agg(F.sort_array(F.collect_list("i")).alias("items"))
    return pages.select("page", F.array_join(F.col("items.h"), "\n").alias("html"))  # 20 items each


@add(f"""WITH {COMPANIES} SELECT CAST(doc_id // 20 AS BIGINT) AS page, company_name, tax_code, address, 'https://x.example' || url AS url FROM companies WHERE doc_id % 7 <> 0""")
def parse_listing(spark, d):
    found = listing_pages(spark, d).select("page", F.explode(html.listing(F.col("html"), F.lit("https://x.example"))).alias("c"))
    return found.select("page", "c.*")


def detail_pages(spark, d):
    cell = lambda x, kind="responsive-table-cell": _tag("div", x, **{"class": kind})
    head = lambda x: cell(x, "responsive-table-cell responsive-table-cell-head")
    c, key = companies(spark, d), F.col("doc_id")
    who = F.when(F.col("representative").isNotNull(), _tag("p", _tag("b", F.col("representative"), itemprop="name"), itemprop="founder")).otherwise("")
    phone = _tag("i", F.concat(F.lit("09"), F.lpad(key.cast("string"), 8, "0")), itemprop="telephone")
    facts = F.concat(head(F.lit("Tình trạng hoạt động")), cell(F.col("status")), head(F.lit("Ngày cấp")), cell(F.concat(F.lit("2020-01-"), F.lpad((key % 28 + 1).cast("string"), 2, "0"))))
    code = F.concat(F.lit("41"), F.lpad((key % 90).cast("string"), 2, "0"))
    trade = F.when(F.col("industry").isNotNull(), F.concat(head(code), cell(F.col("industry")))).otherwise("")
    return c.select("doc_id", F.concat(who, phone, facts, _tag("div", head(F.lit("Mã")), cell(F.lit("Ngành")), trade, **{"class": "nnkd-table"})).alias("html"))


@add(f"""WITH {COMPANIES} SELECT doc_id, representative, '09' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS phone, status,
  '2020-01-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') AS founded_date,
  CASE WHEN industry IS NULL THEN [] ELSE ['41' || lpad(CAST(doc_id % 90 AS VARCHAR), 2, '0')] END AS codes,
  CASE WHEN industry IS NULL THEN [] ELSE [industry] END AS names FROM companies""")
def parse_detail(spark, d):
    found = detail_pages(spark, d).select("doc_id", html.detail(F.col("html")).alias("d"))
    one = lambda name: F.transform("d.industries_detail", lambda x: x[name])
    return found.select("doc_id", "d.representative", "d.phone", "d.status", "d.founded_date", one("code").alias("codes"), one("name").alias("names"))


@add(r"SELECT doc_id, trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g')) AS t FROM documents")
def ws_normalize(spark, d):
    return docs(spark, d).select("doc_id", T.ws_normalize(F.col("text")).alias("t"))


_FROM, _TO = T.fold_map()


def fold_sql(x: str) -> str:
    plain = f"regexp_replace(translate(lower({x}), '{_FROM}', '{_TO}'), '[^\\x00-\\x7F]', '', 'g')"
    return f"trim(regexp_replace(regexp_replace({plain}, '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def core_sql(x: str) -> str:
    out = fold_sql(x)
    for form in T.LEGAL_FORMS:
        out = f"regexp_replace({out}, '\\b{form}\\b', '', 'g')"
    return f"trim({out})"


@add(f"SELECT doc_id, {fold_sql('text')} AS folded FROM documents")
def ascii_fold(spark, d):
    return docs(spark, d).select("doc_id", T.ascii_fold(F.col("text")).alias("folded"))


@add(f"WITH {COMPANIES} SELECT doc_id, {core_sql('company_name')} AS core FROM companies")
def core_name(spark, d):
    return companies(spark, d).select("doc_id", T.core_name(F.col("company_name")).alias("core"))


@add(f"""WITH {COMPANIES} SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN {core_sql('company_name')}
  ELSE {fold_sql("replace(regexp_extract(url, '/companies/([\\w-]+)', 1), '-', ' ')")} END AS key FROM companies""")
def url_slug_key(spark, d):
    name = F.when(F.col("doc_id") % 2 == 0, F.col("company_name"))
    return companies(spark, d).select("doc_id", T.url_slug_key(name, F.col("url")).alias("key"))


@add(r"SELECT page_id, regexp_replace(replace(regexp_replace(html, '<[^>]+>', '', 'g'), '&nbsp;', ' '), '^\s+|\s+$', '', 'g') AS t FROM pages")
def strip_html(spark, d):
    return table(spark, d, "pages").select("page_id", T.strip_html(F.col("html")).alias("t"))


@add(f"""WITH {COMPANIES}, up AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN upper(company_name) ELSE company_name END AS x FROM companies)
  SELECT doc_id, CASE WHEN length(x) > 5 AND x = upper(x) AND x <> lower(x) THEN array_to_string(list_transform(
    regexp_extract_all(x, '(\\p{{L}}+|[^\\p{{L}}]+)'), lambda t: upper(substr(t, 1, 1)) || lower(substr(t, 2))), '') ELSE x END AS name FROM up""")
def fix_case(spark, d):
    x = F.when(F.col("doc_id") % 2 == 0, F.upper("company_name")).otherwise(F.col("company_name"))
    return companies(spark, d).select("doc_id", x.alias("x")).select("doc_id", T.fix_case(F.col("x")).alias("name"))


@add(f"""WITH {COMPANIES} SELECT doc_id, lower(concat_ws(' ', nullif(company_name, ''), nullif(company_name, ''), nullif(address, ''),
  nullif(representative, ''), nullif(status, ''), nullif(industry, ''), nullif(industry, ''))) AS body FROM companies""")
def weighted_text(spark, d):
    c = F.col
    return companies(spark, d).select("doc_id", T.weighted_text(c("company_name"), c("address"), c("representative"), c("status"), c("industry")).alias("body"))


@add(f"""WITH {COMPANIES} SELECT doc_id, coalesce(nullif(concat_ws(' ', 'Tên công ty: ' || nullif(company_name, '') || '.',
  'Ngành nghề kinh doanh: ' || replace(nullif(industry, ''), '_', ' ') || '.', 'Địa chỉ: ' || nullif(address, '') || '.',
  'Người đại diện: ' || nullif(representative, '') || '.', 'Trạng thái hoạt động: ' || nullif(status, '') || '.'), ''),
  'Không có thông tin doanh nghiệp.') AS body FROM companies""")
def embed_text(spark, d):
    c = F.col
    return companies(spark, d).select("doc_id", T.embed_text(c("company_name"), c("industry"), c("address"), c("representative"), c("status")).alias("body"))


def province_sql(x: str) -> str:
    name = f"trim(regexp_replace(trim(list_last(string_split({x}, ','))), '(?i)^(tỉnh|thành phố|tp\\.|tp)\\s+', ''))"
    return f"""CASE WHEN {x} IS NULL OR {x} = '' THEN NULL WHEN lower({name}) IN ('hcm', 'hồ chí minh') THEN 'Hồ Chí Minh'
      WHEN lower({name}) IN ('hn', 'hà nội') THEN 'Hà Nội' ELSE {name} END"""


@add(f"WITH {COMPANIES} SELECT doc_id, {province_sql('address')} AS province FROM companies")
def province_extract(spark, d):
    return companies(spark, d).select("doc_id", T.province(F.col("address")).alias("province"))


_UFROM, _UTO = T.fold_map(True)
_REGION_SQL = "coalesce(" + ", ".join(
    f"CASE WHEN contains(a, '{r.replace('-', ' ')}') OR contains(u, '{r.replace('-', ' ')}') THEN '{r}' END" for r in T.REGIONS) + ")"
REGIONED = f"""{COMPANIES}, regioned AS (SELECT doc_id, {_REGION_SQL} AS region
  FROM (SELECT doc_id, translate(address, '{_UFROM}', '{_UTO}') AS a, translate(url, '{_UFROM}', '{_UTO}') AS u FROM companies))"""


def regioned(spark, d):
    return companies(spark, d).select("doc_id", T.region(F.col("address"), F.col("url")).alias("region"))


@add(f"WITH {REGIONED} SELECT * FROM regioned")
def region_classify(spark, d):
    return regioned(spark, d)


@add(f"""WITH {REGIONED} SELECT region, count(*) AS records, CAST(greatest(1, count(*) // 20 - 10) AS BIGINT) AS resume_page
  FROM regioned WHERE region IS NOT NULL GROUP BY region""")
def region_counts(spark, d):
    counted = regioned(spark, d).where("region is not null").groupBy("region").agg(F.count(F.lit(1)).alias("records"))
    return counted.select("region", "records", F.greatest(F.lit(1).cast("long"), F.floor(F.col("records") / 20) - 10).alias("resume_page"))


@add(f"WITH {TOKENS} SELECT doc_id, toks AS tokens FROM tok")
def tokenize(spark, d):
    return index.tokenized(docs(spark, d))


@add("SELECT doc_id, CASE WHEN length(text) > 160 THEN substr(text, 1, 160) || '...' ELSE text END AS snippet FROM documents")
def snippet(spark, d):
    return docs(spark, d).select("doc_id", T.snippet(F.col("text")).alias("snippet"))


_QUERY_SQL = r"list_sort(list_distinct(list_filter(regexp_split_to_array(lower(regexp_replace(text, '[^\p{L}\p{M}\p{N}_\s]', ' ', 'g')), '[ \t\n\r]+'), lambda x: x <> '' AND (length(x) > 1 OR regexp_matches(x, '^\p{Nd}$')) AND NOT regexp_matches(x, '^_+$'))))"


@add(f"SELECT doc_id, {_QUERY_SQL} AS tokens FROM documents")
def query_tokens(spark, d):
    """The query rule on a column: each document as a query."""
    clean = F.regexp_replace("text", r"(?U)[^\w\s]", " ")
    return docs(spark, d).select("doc_id", F.array_sort(F.array_distinct(T.tokens(F.lower(clean)))).alias("tokens"))


@add(f"WITH {COMPANIES}, q AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN tax_code ELSE company_name END AS q FROM companies) "
     r"SELECT doc_id, q, regexp_matches(trim(q), '^[\d\-\.\s]{8,15}$') AS is_id FROM q")
def id_detect(spark, d):
    q = F.when(F.col("doc_id") % 2 == 0, F.col("tax_code")).otherwise(F.col("company_name"))
    return companies(spark, d).select("doc_id", q.alias("q")).select("doc_id", "q", T.is_id_query(F.col("q")).alias("is_id"))


@add("SELECT c_custkey AS doc_id FROM customer WHERE length(repeat('1', CAST(c_custkey % 14 AS INT))) >= 9")
def valid_id_filter(spark, d):
    code = F.repeat(F.lit("1"), (F.col("c_custkey") % 14).cast("int"))
    return table(spark, d, "customer").where(T.valid_id(code)).select(F.col("c_custkey").alias("doc_id"))


# --- cleaning -----------------------------------------------------------------------------------------------


@add("""SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(text)), lower(trim(lang)) ORDER BY doc_id) AS r FROM documents) WHERE r = 1""")
def dedup_first(spark, d):
    return cleaning.dedup_first(docs(spark, d), ["text", "lang"]).select("doc_id", "lang", "source")


REVIEWS = ("SELECT s_suppkey AS ord, 'CUSTOMER#' || lpad(CAST(s_suppkey * 7 % 90 AS VARCHAR), 9, '0') || (CASE WHEN s_suppkey % 2 = 0 THEN ' JSC' ELSE '' END) AS company_name, "
           "s_name AS title FROM supplier")


def _reviews(spark, d, odd):
    s = table(spark, d, "supplier").where(F.col("s_suppkey") % 3 == 0 if odd else F.col("s_suppkey") % 3 != 0)
    name = F.concat(F.lit("CUSTOMER#"), F.lpad((F.col("s_suppkey") * 7 % 90).cast("string"), 9, "0"), F.when(F.col("s_suppkey") % 2 == 0, " JSC").otherwise(""))
    return s.select(F.col("s_suppkey").alias("ord"), name.alias("company_name"), F.col("s_name").alias("title"))


@add(f"""WITH rev AS ({REVIEWS}), keyed AS (SELECT ord, title, {core_sql('company_name')} AS k FROM rev),
  c AS (SELECT c_custkey AS doc_id, {core_sql('c_name')} AS k FROM customer),
  lists AS (SELECT k, list(title ORDER BY CASE WHEN ord % 3 = 0 THEN 0 ELSE 1 END, ord) AS titles FROM keyed GROUP BY k)
  SELECT doc_id, titles, CASE WHEN titles IS NOT NULL THEN true END AS has_review FROM c LEFT JOIN lists ON c.k = lists.k""")
def review_join(spark, d):
    first, second = (cleaning.review_lists(_reviews(spark, d, x), T.core_name(F.col("company_name")), "ord") for x in (True, False))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), "c_name")
    joined = cleaning.join_reviews(c, T.core_name(F.col("c_name")), first, second)
    return joined.select("doc_id", F.transform("reviews", lambda r: r["title"]).alias("titles"), "has_review")


# --- index ----------------------------------------------------------------------------------------------------


@add(f"WITH {INDEX} SELECT term, doc_id, tf FROM post")
def postings(spark, d):
    return shared_index(spark, d).postings.select("term", "doc_id", "tf")


@add(f"WITH {INDEX} SELECT term, df FROM terms")
def term_df(spark, d):
    return shared_index(spark, d).terms


@add(f"WITH {INDEX} SELECT doc_id, dl FROM lens")
def doc_lengths(spark, d):
    return shared_index(spark, d).doc_stats


@add(f"WITH {INDEX} SELECT n, total_len, avgdl, (SELECT count(*) FROM terms) AS vocab FROM stats")
def corpus_stats(spark, d):
    return shared_index(spark, d).stats


@add(f"WITH {INDEX} SELECT term, df, round(ln((n - df + 0.5) / (df + 0.5) + 1), 6) AS idf FROM terms, stats")
def term_idf(spark, d):
    i = shared_index(spark, d)
    return i.terms.crossJoin(F.broadcast(i.stats.select("n"))).select("term", "df", F.round(bm25.idf(F.col("df"), F.col("n")), 6).alias("idf"))


@add(f"""WITH {INDEX} SELECT term, doc_id, round(CAST(tf AS DOUBLE) * 2.2 / (tf + CAST(1.2 AS DOUBLE) * (1 - CAST(0.4 AS DOUBLE) + CAST(0.4 AS DOUBLE) * dl / avgdl)), 6) AS part
  FROM post JOIN lens USING (doc_id), stats""")
def bm25_tf(spark, d):
    i = shared_index(spark, d)
    hits = i.postings.crossJoin(F.broadcast(i.stats.select("avgdl")))  # a row
    return hits.select("term", "doc_id", F.round(bm25.tf_part(F.col("tf").cast("double"), F.col("dl"), F.col("avgdl")), 6).alias("part"))


@add(f"WITH {INDEX} SELECT term, CAST(count(*) AS BIGINT) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM post GROUP BY term")
def index_merge(spark, d):
    """Two indexes of halves of the documents, merged."""
    rows = docs(spark, d).select("doc_id", "text")
    both = index.merge(index.build(rows.where("doc_id % 2 = 0")), index.build(rows.where("doc_id % 2 = 1")))
    cf = both.postings.groupBy("term").agg(F.sum("tf").alias("cf"))
    return both.terms.join(cf, "term").select("term", "df", "cf")


# --- ranking ---------------------------------------------------------------------------------------------------

QUERY_TEXTS = {1: "the thing that ends", 2: "of and in", 3: "die der einer", 4: "zzz unknownword the", 5: "le la pour"}


def query_rows(queries: dict[int, str]) -> str:
    rows = [(q, t, len(bm25.query_tokens(x))) for q, x in queries.items() for t in bm25.query_tokens(x)]
    return "(VALUES " + ", ".join(f"({q}, '{t}', {n})" for q, t, n in rows) + ") AS q(qid, term, size)"


def scored_sql(queries: dict[int, str], cap: int | None = None, coord: float = 1.5, common: float = 0.8) -> str:
    post = "post" if cap is None else f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY doc_id) AS r FROM post) WHERE r <= {cap})"
    return f"""{INDEX},
wanted AS (SELECT qid, term, ln((n - df + 0.5) / (df + 0.5) + 1) AS idf, count(*) OVER (PARTITION BY qid) AS valid
  FROM {query_rows(queries)} JOIN terms USING (term), stats WHERE size <= 2 OR df <= floor(n * CAST({common} AS DOUBLE))),
scored AS (SELECT qid, doc_id, round(sum(idf * (CAST(tf AS DOUBLE) * 2.2 / (tf + CAST(1.2 AS DOUBLE) * (CAST(0.6 AS DOUBLE) + CAST(0.4 AS DOUBLE) * dl / avgdl))))
    * pow(CAST(count(*) AS DOUBLE) / max(valid), CAST({coord} AS DOUBLE)), 6) AS score, count(*) AS matched
  FROM wanted JOIN {post} USING (term) JOIN lens USING (doc_id), stats GROUP BY qid, doc_id)"""


def topk_sql(queries: dict[int, str], k: int, **how) -> str:
    return f"""WITH {scored_sql(queries, **how)}
SELECT rank, doc_id, score FROM (SELECT doc_id, score, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INT) AS rank FROM scored) WHERE rank <= {k}"""


@add(topk_sql({1: QUERY_TEXTS[1]}, 20))
def bm25_topk(spark, d):
    return bm25.topk(bm25.score(shared_index(spark, d), {1: QUERY_TEXTS[1]}), 20)


@add(f"""WITH {scored_sql(QUERY_TEXTS)} SELECT qid, rank, doc_id, score FROM (SELECT qid, doc_id, score,
  CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INT) AS rank FROM scored) WHERE rank <= 10""")
def bm25_batch(spark, d):
    return bm25.topk_each(bm25.score(shared_index(spark, d), QUERY_TEXTS), 10)


@add(topk_sql({1: QUERY_TEXTS[2]}, 20, cap=50))
def bm25_capped(spark, d):
    return bm25.topk(bm25.score(shared_index(spark, d), {1: QUERY_TEXTS[2]}, bm25.Params(cap=50)), 20)


@add(topk_sql({1: QUERY_TEXTS[2]}, 20, common=0.52))
def bm25_common_skip(spark, d):
    return bm25.topk(bm25.score(shared_index(spark, d), {1: QUERY_TEXTS[2]}, bm25.Params(common=0.52)), 20)


@add(f"""WITH {scored_sql({1: QUERY_TEXTS[1]})} SELECT doc_id, matched, score FROM scored""")
def bm25_coord(spark, d):
    return bm25.score(shared_index(spark, d), {1: QUERY_TEXTS[1]}).select("doc_id", "matched", "score")


@add(f"WITH {scored_sql(QUERY_TEXTS)} SELECT qid, count(*) AS total FROM scored GROUP BY qid")
def match_count(spark, d):
    return bm25.score(shared_index(spark, d), QUERY_TEXTS).groupBy("qid").agg(F.count(F.lit(1)).alias("total"))


#: A query vector of the embeddings' 64 dimensions.
VECTOR = [((i * 37 + 11) % 17 - 8) / 8 for i in range(64)]
_VEC = "CAST(embedding AS DOUBLE[])"
_UNIT = f"CASE WHEN list_dot_product({_VEC}, {_VEC}) > 0 THEN list_transform({_VEC}, lambda x: x / sqrt(list_dot_product({_VEC}, {_VEC}))) ELSE {_VEC} END"


def vector_sql(k: int) -> str:
    return f"""SELECT rank, doc_id, score FROM (SELECT doc_id, score, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INT) AS rank
  FROM (SELECT vec_id AS doc_id, round(list_cosine_similarity({_VEC}, CAST({VECTOR} AS DOUBLE[])), 6) AS score FROM embeddings)) WHERE rank <= {k}"""


@add(vector_sql(10))
def vector_topk(spark, d):
    return vector.topk(table(spark, d, "embeddings"), VECTOR, 10)


@add(f"SELECT vec_id, list_transform({_UNIT}, lambda x: round(x, 6)) AS unit FROM embeddings")
def l2_normalize(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", vector.l2_normalize(F.col("embedding")).alias("u"))
    return e.select("vec_id", F.transform("u", lambda x: vector.rounded(x, 6)).alias("unit"))


@add()
def ivf_topk(spark, d):
    """The neighbours of each vector whose id is divisible by 50. Approximate: tests hold it against the exact list."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("query_vector"))
    return vector.neighbours_cells(vector.build(e), asked, 10)


def fused_sql(q: str, pool: int, k: int, alpha: float = 0.65) -> str:
    return f"""WITH {scored_sql({1: q})},
lex AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored),
vec AS ({vector_sql(pool)}),
fused AS (SELECT doc_id, round(sum(s), 6) AS score FROM (
  SELECT doc_id, CAST({alpha} AS DOUBLE) / (60 + rank) AS s FROM lex WHERE rank <= {pool}
  UNION ALL SELECT doc_id, CAST({1 - alpha} AS DOUBLE) / (60 + rank) FROM vec) GROUP BY doc_id)
SELECT rank, doc_id, score FROM (SELECT doc_id, score, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INT) AS rank FROM fused) WHERE rank <= {k}"""


def _fused(spark, d, q, pool, k, alpha=0.65):
    lex = bm25.topk(bm25.score(shared_index(spark, d), {1: q}), pool)
    vec = vector.topk(table(spark, d, "embeddings"), VECTOR, pool)
    return fusion.ranked(fusion.rrf([lex, vec], [alpha, 1 - alpha]), k)


@add(fused_sql(QUERY_TEXTS[1], 50, 100000))
def rrf_fusion(spark, d):
    return _fused(spark, d, QUERY_TEXTS[1], 50, 100000)


@add(fused_sql(QUERY_TEXTS[1], 50, 10))
def hybrid_topk(spark, d):
    return _fused(spark, d, QUERY_TEXTS[1], 50, 10)


# --- companies: search, boosts, result lists ------------------------------------------------------------------------


def company_index(spark, d):
    """The index of the companies, kept for all queries of a session."""
    key, c = (spark.sparkContext.applicationId, f"{d}/companies"), F.col
    if key not in _indexes:
        body = T.weighted_text(c("company_name"), c("address"), c("representative"), c("status"), c("industry"))
        _indexes[key] = index.build(companies(spark, d).select("doc_id", body.alias("text"))).persist()
    return _indexes[key]


def close(spark) -> None:
    """Lets the kept indexes of a session go."""
    for key in [k for k in _indexes if k[0] == spark.sparkContext.applicationId]:
        _indexes.pop(key).close()


_BODY = ("lower(concat_ws(' ', nullif(company_name, ''), nullif(company_name, ''), nullif(address, ''), nullif(representative, ''), "
         "nullif(status, ''), nullif(industry, ''), nullif(industry, '')))")
META = f"""{COMPANIES}, meta AS (SELECT doc_id, company_name, tax_code, regexp_replace(address, '^[, ]+|[, ]+$', '', 'g') AS address,
  CASE WHEN coalesce(representative, '') = '' OR lower(representative) = 'none' THEN 'Chưa cập nhật' ELSE representative END AS representative,
  status, coalesce(replace(industry, '_', ' '), '') AS industry FROM companies)"""


def metadata(spark, d):
    c = F.col
    ind = results.industry(c("industry"), F.lit(""), F.array().cast("array<string>"))
    return companies(spark, d).select(
        "doc_id", "company_name", "tax_code", results.clean_address(c("address")).alias("address"),
        results.representative(c("representative")).alias("representative"), "status", F.replace(ind, F.lit("_"), F.lit(" ")).alias("industry"))


@add(f"WITH {META} SELECT * FROM meta")
def hit_metadata(spark, d):
    return results.with_metadata(table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id")), metadata(spark, d))


@add(f"""WITH {COMPANIES} SELECT doc_id, coalesce(nullif(industry, ''), CASE WHEN doc_id % 2 = 0 THEN status || ', ' || url ELSE status END) AS industry FROM companies""")
def industry_names(spark, d):
    """The field of industries where it is given, and else the names of a list, without its empty ones."""
    names = F.array("status", F.lit(""), F.when(F.col("doc_id") % 2 == 0, F.col("url")))
    return companies(spark, d).select("doc_id", results.industry(F.lit(None).cast("string"), F.col("industry"), names).alias("industry"))


COMPANY_QUERY = "NATION_3, Hà Nội"


def engine(spark, d, **how):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return SearchEngine(company_index(spark, d), metadata(spark, d), e, lambda q: VECTOR, **how)


def company_scored(q: str) -> str:
    return scored_sql({1: q}).replace("FROM documents)", f"FROM (SELECT doc_id, {_BODY} AS text FROM companies))", 1)


def boost_sql(q: str) -> str:
    """Boosts of hits (doc_id, score) joined to meta."""
    low = q.strip().lower()
    words = low.split()
    return f"""boosted AS (SELECT doc_id, round(CASE WHEN b > 0 THEN top + top * b + score * 0.1e0 ELSE score END, 6) AS score FROM (
  SELECT doc_id, score, max(score) OVER () AS top,
    CASE WHEN lower(trim(company_name)) = '{low}' THEN 1.0e0 WHEN contains(' ' || lower(trim(company_name)) || ' ', ' {low} ') THEN 0.5e0
      WHEN list_has_all(regexp_split_to_array(lower(trim(company_name)), '\\s+'), {words}) THEN 0.3e0 ELSE 0e0 END
    + CASE WHEN lower(trim(address)) = '{low}' THEN 0.8e0 WHEN contains(lower(trim(address)), '{low}') THEN 0.2e0 ELSE 0e0 END AS b
  FROM hits JOIN meta USING (doc_id)))"""


def listed_sql(k: int) -> str:
    return f"""SELECT rank, doc_id, score, company_name, tax_code, address, representative, status, industry FROM (
  SELECT doc_id, score, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INT) AS rank FROM boosted) JOIN meta USING (doc_id) WHERE rank <= {k}"""


@add(f"""WITH {META}, {company_scored(COMPANY_QUERY)},
hits AS (SELECT doc_id, round(score, 4) AS score FROM (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM scored) WHERE r <= 60),
{boost_sql(COMPANY_QUERY)} {listed_sql(20)}""")
def search_bm25(spark, d):
    return engine(spark, d).search(COMPANY_QUERY, "bm25", 20)


@add(f"""WITH {META}, fusedq AS ({fused_sql(COMPANY_QUERY, 60, 20).replace('FROM documents)', f'FROM (SELECT doc_id, {_BODY} AS text FROM companies))', 1)}),
hits AS (SELECT doc_id, score FROM fusedq WHERE doc_id IN (SELECT doc_id FROM companies)), {boost_sql(COMPANY_QUERY)} {listed_sql(20)}""")
def search_hybrid(spark, d):
    return engine(spark, d).search(COMPANY_QUERY, "hybrid", 20)


@add(f"""WITH {META}, hits AS (SELECT vec_id AS doc_id, round(round(list_cosine_similarity({_VEC}, CAST({VECTOR} AS DOUBLE[])), 6), 4) AS score FROM embeddings
  QUALIFY row_number() OVER (ORDER BY round(list_cosine_similarity({_VEC}, CAST({VECTOR} AS DOUBLE[])), 6) DESC, vec_id) <= 60),
{boost_sql(COMPANY_QUERY)} {listed_sql(20)}""")
def search_vector(spark, d):
    return engine(spark, d).search(COMPANY_QUERY, "vector", 20)


@add(f"WITH {META}, hits AS (SELECT doc_id, CAST(1.0 AS DOUBLE) / (1 + doc_id) AS score FROM companies), {boost_sql('công ty cp customer#000000007')} SELECT * FROM boosted")
def exact_boost(spark, d):
    hits = metadata(spark, d).withColumn("score", F.lit(1.0) / (1 + F.col("doc_id")))
    boosted = results.boost(hits, "Công ty CP Customer#000000007", hits.agg(F.max("score")))
    return boosted.select("doc_id", F.round("score", 6).alias("score"))


@add(f"WITH {META}, {company_scored(COMPANY_QUERY)} SELECT count(*) AS total FROM scored")
def search_total(spark, d):
    return engine(spark, d).total(COMPANY_QUERY, "bm25")


@add("SELECT least(2000, count(*)) AS total FROM embeddings")
def search_total_vector(spark, d):
    return engine(spark, d).total(COMPANY_QUERY, "vector")


@add(f"WITH {META} SELECT CAST(1 AS INT) AS rank, CAST(-1 AS BIGINT) AS doc_id, CAST(1.0 AS DOUBLE) AS score, company_name, tax_code, address, representative, status, industry FROM meta WHERE tax_code = '0000000042'")
def id_lookup(spark, d):
    return engine(spark, d).search("0000000042")


# Result lists: the balance stands for a score, so all customers are hits.
HITS = f"""{META}, list AS (SELECT meta.*, round(abs(c_acctbal) / 100, 4) AS score,
  CAST(row_number() OVER (ORDER BY round(abs(c_acctbal) / 100, 4) DESC, doc_id) AS INT) AS rank FROM meta JOIN customer ON c_custkey = doc_id)"""


def scored_list(spark, d):
    """All customers with their metadata and score."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.round(F.abs("c_acctbal") / 100, 4).alias("score"))
    return c.join(metadata(spark, d), "doc_id")


LISTED = HITS + ", hits AS (SELECT * FROM list)"
_PCT = "CAST(round(score / (SELECT CASE WHEN max(score) > 0 THEN max(score) ELSE 1 END FROM hits) * 100) AS INT)"


@add(f"""WITH {LISTED}, pct AS (SELECT doc_id, score, CASE WHEN score > 0 THEN greatest({_PCT}, 1) ELSE {_PCT} END AS percent FROM hits)
  SELECT doc_id, percent, CASE WHEN percent < 60 THEN 'low' WHEN percent < 85 THEN 'mid' ELSE 'high' END AS band FROM pct""")
def relevance_pct(spark, d):
    return results.with_percent(scored_list(spark, d)).select("doc_id", "percent", T.band(F.col("percent")).alias("band"))


@add(f"WITH {LISTED} SELECT doc_id, score FROM hits WHERE {_PCT} >= 70")
def threshold_70(spark, d):
    return results.above_threshold(scored_list(spark, d), 70).select("doc_id", "score")


@add(f"WITH {LISTED} SELECT doc_id, status FROM hits WHERE NOT (contains(lower(status), 'ngừng') OR contains(lower(status), 'giải thể'))")
def status_filter(spark, d):
    return results.by_status(scored_list(spark, d), True).select("doc_id", "status")


@add(f"WITH {LISTED} SELECT doc_id, address FROM hits WHERE {province_sql('address')} = 'Hà Nội'")
def province_filter(spark, d):
    return results.by_province(scored_list(spark, d), "Hà Nội").select("doc_id", "address")


@add(f"WITH {LISTED} SELECT province, count(*) AS hits FROM (SELECT {province_sql('address')} AS province FROM hits) WHERE province IS NOT NULL GROUP BY province")
def province_facet(spark, d):
    return results.province_facet(scored_list(spark, d))


def hit_list(spark, d):
    """The hits of a search, 1000 at most, with their ranks: what pages are cut from."""
    return fusion.ranked(scored_list(spark, d), 1000).join(metadata(spark, d), "doc_id")


@add(f"WITH {HITS}, hits AS (SELECT * FROM list WHERE rank <= 1000) SELECT rank, doc_id, company_name FROM hits WHERE rank > 10 AND rank <= 20")
def page_2(spark, d):
    return results.page(hit_list(spark, d), 2).select("rank", "doc_id", "company_name")


@add(f"""WITH {LISTED} SELECT company_name AS "Tên công ty", tax_code AS "Mã số thuế", address AS "Địa chỉ", representative AS "Người đại diện",
  status AS "Trạng thái", industry AS "Ngành nghề" FROM hits""")
def export_rows(spark, d):
    return results.export_rows(scored_list(spark, d))


# --- evaluation ------------------------------------------------------------------------------------------------------

JUDGED = {1: ("the thing that ends", ["thing_that", "ends"]), 2: ("of and in", ["and of", "in the"]), 3: ("die der einer", ["die der", "einer"]), 5: ("le la pour", ["pour le", "la_la"])}
_KEYWORDS = "(VALUES " + ", ".join(f"({q}, {[k.lower().replace('_', ' ') for k in ks]})" for q, (_, ks) in JUDGED.items()) + ") AS k(qid, keywords)"


@add(f"""SELECT qid, doc_id, len(list_filter(keywords, lambda k: contains(replace(lower(text), '_', ' '), k))) > 0 AS relevant FROM documents, {_KEYWORDS}""")
def relevance_judge(spark, d):
    words = spark.createDataFrame([(q, ks) for q, (_, ks) in JUDGED.items()], "qid int, keywords array<string>")
    # the judged queries are a few rows given here
    return docs(spark, d).crossJoin(F.broadcast(words)).select("qid", "doc_id", evaluate.is_relevant(F.col("text"), F.col("keywords")).alias("relevant"))


def judged(spark, d):
    texts = {q: x for q, (x, _) in JUDGED.items()}
    lex = bm25.topk_each(bm25.score(shared_index(spark, d), texts), 50)
    vec = vector.topk(table(spark, d, "embeddings"), VECTOR, 50).crossJoin(F.broadcast(spark.createDataFrame([(q,) for q in texts], "qid int")))
    hyb = bm25.topk_each(fusion.rrf([lex, vec], [0.65, 0.35], by=["qid"]), 10)
    cols = ["qid", "rank", "doc_id"]
    lists = [df.select(*cols, F.lit(n).alias("engine")) for n, df in (("bm25", lex), ("vector", vec), ("hybrid", hyb))]
    hits = lists[0].unionByName(lists[1]).unionByName(lists[2]).where("rank <= 10")
    words = spark.createDataFrame([(q, ks) for q, (_, ks) in JUDGED.items()], "qid int, keywords array<string>")
    # the judged queries and their keywords are a few rows given here
    joined = docs(spark, d).select("doc_id", "text").join(hits, "doc_id").join(F.broadcast(words), "qid")
    return joined.select("qid", "engine", "rank", evaluate.is_relevant(F.col("text"), F.col("keywords")).alias("relevant"))


PRECISION = f"""{scored_sql({q: x for q, (x, _) in JUDGED.items()})},
lex AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM scored),
vec AS (SELECT qid, doc_id, v.rank FROM ({vector_sql(50)}) v, {_KEYWORDS}),
fused AS (SELECT qid, doc_id, round(sum(s), 6) AS score FROM (
  SELECT qid, doc_id, CAST(0.65 AS DOUBLE) / (60 + rank) AS s FROM lex WHERE rank <= 50
  UNION ALL SELECT qid, doc_id, CAST(0.35 AS DOUBLE) / (60 + rank) FROM vec) GROUP BY qid, doc_id),
hyb AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM fused),
hits AS (SELECT qid, doc_id, 'bm25' AS engine FROM lex WHERE rank <= 10 UNION ALL SELECT qid, doc_id, 'vector' FROM vec WHERE rank <= 10
  UNION ALL SELECT qid, doc_id, 'hybrid' FROM hyb WHERE rank <= 10),
prec AS (SELECT qid, engine, round(avg(CAST(len(list_filter(keywords, lambda k: contains(replace(lower(text), '_', ' '), k))) > 0 AS DOUBLE)), 6) AS precision
  FROM hits JOIN documents USING (doc_id) JOIN {_KEYWORDS} USING (qid) GROUP BY qid, engine)"""


@add(f"WITH {PRECISION} SELECT qid, engine, precision FROM prec")
def precision_at_10(spark, d):
    return evaluate.precision(judged(spark, d))


@add(f"WITH {PRECISION} SELECT engine, round(avg(precision), 6) AS avg_precision, min(precision) AS min_precision, max(precision) AS max_precision FROM prec GROUP BY engine")
def eval_summary(spark, d):
    return evaluate.summary(evaluate.precision(judged(spark, d)))


WINNERS = f"""{PRECISION}, wide AS (SELECT qid, coalesce(max(precision) FILTER (engine = 'bm25'), 0) AS b, coalesce(max(precision) FILTER (engine = 'vector'), 0) AS v,
  coalesce(max(precision) FILTER (engine = 'hybrid'), 0) AS h FROM prec GROUP BY qid),
won AS (SELECT qid, CASE WHEN b = v AND v = h THEN 'all' ELSE concat_ws(',', CASE WHEN b = greatest(b, v, h) THEN 'bm25' END, CASE WHEN v = greatest(b, v, h) THEN 'vector' END,
    CASE WHEN h = greatest(b, v, h) THEN 'hybrid' END) END AS winner, h >= greatest(b, v) AS hybrid_ok FROM wide)"""


@add(f"WITH {WINNERS} SELECT * FROM won")
def eval_winners(spark, d):
    return evaluate.winners(evaluate.precision(judged(spark, d)))


@add(f"WITH {WINNERS} SELECT winner, count(*) AS queries, CAST(sum(CAST(hybrid_ok AS INT)) AS BIGINT) AS hybrid_ok FROM won GROUP BY winner")
def eval_win_counts(spark, d):
    return evaluate.win_counts(evaluate.winners(evaluate.precision(judged(spark, d))))


# --- streaming ------------------------------------------------------------------------------------------------------


@add("SELECT DISTINCT lower(trim(lang)) AS lang, lower(trim(source)) AS source, md5(lower(trim(text))) AS text FROM documents")
def stream_dedup(spark, d):
    """The keys of the documents as a stream shows them first."""
    at = fresh_path(spark, "stream")
    schema = docs(spark, d).schema
    rows = spark.readStream.schema(schema).parquet(f"{d}/documents.parque[t]")  # a pattern: the table is a file or a folder
    keyed = rows.withColumn("text", F.md5(T.dedup_key(F.col("text"))))
    ingest.run_once(ingest.dedup_stream(keyed, ["lang", "source", "text"]), f"{at}/keys", f"{at}/checkpoint")
    return spark.read.schema("lang string, source string, text string").parquet(f"{at}/keys")


def queries() -> dict[str, Query]:
    return {name: (lambda spark, d, f=f: f(ship(spark), d)) for name, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
