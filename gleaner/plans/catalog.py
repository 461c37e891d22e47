"""Registered queries of the operators, each with its DuckDB equivalent where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import quality as Q
from gleaner.functions import rewrite as R
from gleaner.functions import text as T
from gleaner.functions import url as U
from gleaner.operators import hits as H
from gleaner.plans import inputs as I
from gleaner.plans import oracle as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def add(build):
        QUERIES[name] = build
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return add


def url_query(name: str, columns: dict[str, tuple]) -> None:
    """A query of URL columns: name to (Spark column of url, SQL)."""
    sql = f"WITH {I.URLS} SELECT id, {', '.join(f'{s} AS {n}' for n, (_, s) in columns.items())} FROM urls"
    register(name, sql)(lambda spark, sf: I.urls(spark, sf).select("id", *[c(F.col("url")).alias(n) for n, (c, _) in columns.items()]))


u = "url"
url_query("url1_canonicalize", {"canonical": (U.canonicalize_url, O.canonical(u))})
url_query("url2_dedup_key", {"key": (U.dedup_key, O.canonical(u, False)), "bare": (U.strip_fragments, "split_part(url, '#', 1)")})
url_query("url3_tracking_keys", {"tracking": (lambda c: F.size(F.filter(U.query_pairs(c), lambda p: U.is_tracking_key(p["key"]))), f"""len(list_filter(string_split({O.piece(u, 4)}, '&'), lambda x: {O.decoded("split_part(x, '=', 1)")} IN {O.listing(U.TRACKING_KEYS)}))""")})
url_query("url4_query_encoding", {"query": (lambda c: U.encoded_query(U.query_pairs(c)), f"""array_to_string(list_transform(list_filter(string_split({O.piece(u, 4)}, '&'), lambda x: x <> ''), lambda x: {O.encoded(O.decoded("split_part(x, '=', 1)"))} || '=' || {O.encoded(O.decoded("CASE WHEN contains(x, '=') THEN x[strpos(x, '=') + 1:] ELSE '' END"))}), '&')""")})
url_query("url5_is_pdf", {"is_pdf": (U.is_pdf_url, f"""regexp_matches(url, {O.lit(O.RE)}) AND (ends_with(lower({O.piece(u, 3)}), '.pdf') OR ({O.host_is(O.host(u), ['arxiv.org'])} AND contains({O.piece(u, 3)}, '/pdf/')))""")})
url_query("url6_is_arxiv", {"is_arxiv": (U.is_arxiv_url, f"{O.host_is(O.host(u), ['arxiv.org'])} AND regexp_matches({O.piece(u, 3)}, '/(abs|pdf)/')")})
url_query("url7_registered_domain", {"domain": (U.registered_domain, O.registered(u))})
url_query("url8_host", {"host": (U.host, O.host(u))})
url_query("url9_authority", {"authority": (lambda c: U.domain_authority(U.host(c)), O.authority(O.host(u)))})
url_query("url10_url_authority", {"authority": (U.url_authority, O.url_authority(u))})
url_query("url11_source_type", {"source_type": (U.source_type, O.source_type(u))})
url_query("url12_extractor_type", {"extractor": (U.extractor_type, """CASE
    WHEN contains(lower(url), 'arxiv.org') THEN 'arxiv' WHEN contains(lower(url), 'github.com') THEN 'github'
    WHEN ends_with(lower(url), '.pdf') OR contains(lower(url), '/pdf/') THEN 'pdf' ELSE 'web' END""")})
url_query("url13_language", {"language": (U.detect_language, "coalesce(CASE list_last(string_split(split_part(url, '?', 1), '.')) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in U.LANGUAGES.items()) + " END, list_last(string_split(split_part(url, '?', 1), '.')))")})
url_query("url14_scheme", {"allowed": (U.is_allowed_scheme, "regexp_matches(url, '^(?i)https?://') OR url = 'about:blank'")})
url_query("url15_websocket", {
    "moved": (lambda c: U.ws_loopback(F.regexp_replace(c, "^https?://[^/?#]*", "ws://localhost:9222"), "10.1.2.3"), "regexp_replace(url, '^https?://[^/?#]*', 'ws://10.1.2.3:9222')"),
    "port": (lambda c: U.ws_port(F.regexp_replace(c, "^https?://[^/?#]*", "ws://h:81")), "CASE WHEN regexp_matches(url, '^https?://') THEN 81 END"),
})
url_query("url16_search_urls", {e: (lambda c, e=e: U.search_url(e, c), f"'{a}' || {O.encoded(u)} || '{b}'") for e, a, b in (
    ("bing", "https://www.bing.com/search?format=rss&q=", "&setlang=en&mkt=en-US"), ("brave", "https://search.brave.com/search?q=", "&source=web&hl=en"),
    ("google", "https://www.google.com/search?q=", "&num=10&hl=en"), ("brave_api", "https://api.search.brave.com/res/v1/web/search?q=", "&count=5&country=us&search_lang=en"),
)})
url_query("flt1_translate_wrapper", {"wrapper": (U.is_translate_wrapper, O.translate_wrapper(u))})
url_query("flt4_fragment", {"highlight": (U.is_fragment_url, "contains(url, '#:~:text=')")})
url_query("flt6_junk_url", {"junk": (U.is_junk_url, O.junk_url(u))})
url_query("flt10_captcha_page", {
    "brave": (lambda c: U.is_captcha_url("brave", c), "contains(url, 'search.brave.com/verify') OR contains(url, 'search.brave.com/captcha')"),
    "google": (lambda c: U.is_captcha_url("google", c), "contains(url, '/sorry/') OR contains(url, 'google.com/sorry')"),
})
url_query("flt18_http_url_and_date", {
    "is_http": (U.is_http_url, "regexp_matches(url, '^https?://')"),
    "is_date": (lambda c: T.is_date(F.regexp_extract(c, "([0-9-]+)", 1)), "regexp_matches(regexp_extract(url, '([0-9-]+)', 1), '^[0-9]+-[0-9]+-[0-9]+$')"),
})
NAV_PATHS = "search|url|maps|images|news|videos|shopping|books|finance|account|preferences|intl|services|about|support|policies|howsearchworks|advanced_search|settings|webhp|complete|sorry|local|travel|flights|hotels|translate|docs|drive|gmail|calendar|contacts|photos|meet|tasks|forms|sites|myaccount|signin|logout"
url_query("flt19_google_nav", {"nav": (U.is_google_nav_path, f"""NOT regexp_matches(url, {O.lit(O.RE)}) OR (coalesce(regexp_replace({O.host(u)}, '^www\\.', '') = 'google.com', false) AND regexp_matches({O.piece(u, 3)}, '^/({NAV_PATHS})'))""")})


def hit_query(name: str, build: Callable[[], dict], sql: dict[str, str]) -> None:
    text = f"WITH {I.HITS} SELECT ord, {', '.join(f'{s} AS {n}' for n, s in sql.items())} FROM hits"
    register(name, text)(lambda spark, sf: I.hits(spark, sf).select("ord", *[c.alias(n) for n, c in build().items()]))


hit_query("flt2_non_latin", lambda: {"title_foreign": U.has_non_latin_script(F.col("title")), "snippet_foreign": U.has_non_latin_script(F.col("snippet"))}, {"title_foreign": O.non_latin("title"), "snippet_foreign": O.non_latin("snippet")})
hit_query("flt3_dictionary", lambda: {"junk": U.is_dictionary_junk(F.col("url"), F.col("title"), F.col("snippet"))}, {"junk": O.dictionary("url", "title", "snippet")})
hit_query("flt5_blank", lambda: {"no_title": T.is_blank(F.col("title")), "no_snippet": T.is_blank(F.col("snippet"))}, {"no_title": f"{O.trim('title')} = ''", "no_snippet": f"{O.trim('snippet')} = ''"})
hit_query("flt7_junk_title", lambda: {"junk": U.is_junk_title(F.col("title"))}, {"junk": O.junk_title("title")})
register("flt8_filter_hits", f"WITH {I.HITS} SELECT ord, query, url FROM hits WHERE {O.keep_hit()}")(
    lambda s, d: H.filter_hits(I.hits(s, d)).select("ord", "query", "url")
)

KEYED = f"{I.HITS}, keyed AS (SELECT *, {O.canonical('url', False)} AS key, lower({O.collapse('title')}) AS tkey FROM hits)"
register("ded1_two_keys", f"""WITH {KEYED}, a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key
    ORDER BY ord) AS n FROM keyed) WHERE n = 1), b AS (SELECT *, row_number() OVER (PARTITION BY tkey
    ORDER BY ord) AS m FROM a) SELECT ord, query, url FROM b WHERE m = 1""")(
    lambda s, d: H.dedup_two_keys(I.hits(s, d)).select("ord", "query", "url")
)
register("ded2_by_key_per_query", f"""WITH {KEYED} SELECT ord, query, url
    FROM (SELECT *, row_number() OVER (PARTITION BY query, key ORDER BY ord) AS n FROM keyed) WHERE n = 1""")(
    lambda s, d: H.dedup_by_key(I.hits(s, d), "query").select("ord", "query", "url")
)
register("ded3_across_queries", f"""WITH {KEYED} SELECT ord, query, url
    FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ord) AS n FROM keyed) WHERE n = 1""")(
    lambda s, d: H.dedup_by_key(I.hits(s, d)).select("ord", "query", "url")
)
MAPPED = f"""{I.HITS}, keyed AS (SELECT *, {O.canonical('url', False)} AS key, lower({O.collapse('title')}) AS tkey FROM hits WHERE {O.keep_hit()}),
  a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query, key ORDER BY ord) AS n FROM keyed) WHERE n = 1),
  b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query, tkey ORDER BY ord) AS m FROM a) WHERE m = 1),
  mapped AS (SELECT ord, query, {O.collapse('title')} AS title, url, {O.collapse('snippet')} AS snippet, CAST(row_number() OVER (PARTITION BY query ORDER BY ord) AS INTEGER) AS position, engine, score,
    round({O.authority(O.host('url'))} * 100) / 100 AS domain_authority, {O.source_type('url')} AS source_type FROM b)"""
register("map1_map_hits", f"""WITH {MAPPED} SELECT ord, query, title, url, snippet, position, engine, CASE
    WHEN score <= 0 THEN 1.0 / position ELSE CAST(score AS DOUBLE) END AS score, domain_authority, source_type, 'hybrid' AS mode
    FROM mapped""")(lambda s, d: H.map_hits(I.hits(s, d)))
hit_query("map2_project", lambda: {"title": T.collapse(F.col("title")), "authority": T.round_score(U.domain_authority(U.host(F.col("url")))), "source_type": U.source_type(F.col("url"))}, {"title": O.collapse("title"), "authority": f"round({O.authority(O.host('url'))} * 100) / 100", "source_type": O.source_type("url")})
register("map3_post_process", f"""WITH {I.HITS}, k AS (SELECT *, {O.canonical('url', False)} AS key FROM hits WHERE NOT (contains(url, '#:~:text=') OR {O.translate_wrapper('url')} OR {O.junk_url('url')} OR {O.trim('snippet')} = '')),
  a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query, key ORDER BY ord) AS n FROM k) WHERE n = 1)
  SELECT ord, query, {O.clean_title('title')} AS title, url, {O.clean_snippet('snippet')} AS snippet, CAST(row_number() OVER (PARTITION BY query ORDER BY ord) AS INTEGER) AS position FROM a""")(
    lambda s, d: H.post_process(I.hits(s, d))
)

DEDUPED = f"""{KEYED}, first AS (SELECT *, {O.authority(O.host('url'))} AS domain_authority
    FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ord) AS n FROM keyed) WHERE n = 1)"""


def deduped(spark: SparkSession, sf: str) -> DataFrame:
    return H.dedup_by_key(I.hits(spark, sf)).withColumn("domain_authority", U.domain_authority(U.host(F.col("url"))))


register("rnk1_serp_order", f"""WITH {DEDUPED} SELECT ord, query, CAST(row_number() OVER (PARTITION BY query
    ORDER BY ord) AS INTEGER) AS turn, min(ord) OVER (PARTITION BY query) AS first_ord FROM first""")(
    lambda s, d: H.rank_serp(deduped(s, d)).select("ord", "query", "turn", "first_ord")
)
register("rnk2_authority_top20", f"""WITH {DEDUPED} SELECT ord, url, domain_authority FROM first
    ORDER BY domain_authority DESC, ord LIMIT 20""")(lambda s, d: H.rank(deduped(s, d), "authority").limit(20).select("ord", "url", "domain_authority"))
register("rnk3_snippet_top20", f"""WITH {DEDUPED} SELECT ord, url, CAST(strlen(snippet) AS INTEGER) AS bytes
    FROM first ORDER BY strlen(snippet) DESC, ord LIMIT 20""")(
    lambda s, d: H.rank(deduped(s, d), "snippet").limit(20).select("ord", "url", F.octet_length("snippet").alias("bytes"))
)
COMPOSITE = "CAST(0.5 AS DOUBLE) * domain_authority + CAST(0.3 AS DOUBLE) * (CAST(strlen(snippet) AS DOUBLE) / max(strlen(snippet)) OVER ()) + CAST(0.2 AS DOUBLE) * (CAST(1 AS DOUBLE) / count(*) OVER (PARTITION BY key))"
register("rnk4_composite_before_dedup", f"""WITH {KEYED}, x AS (SELECT *, {O.authority(O.host('url'))} AS domain_authority
    FROM keyed) SELECT ord, round({COMPOSITE}, 9) AS score
    FROM x""")(lambda s, d: H.rank_composite(I.hits(s, d).withColumn("domain_authority", U.domain_authority(U.host(F.col("url"))))).select("ord", F.round("rank_score", 9).alias("score")))
register("url_dedup_rank", f"""WITH {DEDUPED}, s AS (SELECT ord, query, url, {O.registered('url')} AS site, round({COMPOSITE}, 9) AS score
    FROM first) SELECT * FROM s ORDER BY score DESC, ord LIMIT 20""")(
    lambda s, d: H.rank_composite(deduped(s, d)).select("ord", "query", "url", U.registered_domain(F.col("url")).alias("site"), F.round("rank_score", 9).alias("score")).orderBy(F.desc("score"), "ord").limit(20)
)
register("lim1_take", f"""WITH {I.HITS} SELECT ord, query
    FROM (SELECT ord, query, row_number() OVER (PARTITION BY query ORDER BY ord) AS n FROM hits) WHERE n <= 3""")(
    lambda s, d: H.take(I.hits(s, d), 3).select("ord", "query")
)
register("lim2_follow_budget", f"WITH {DEDUPED} SELECT ord, url FROM first ORDER BY domain_authority DESC, ord LIMIT 8")(
    lambda s, d: H.rank(deduped(s, d), "authority").limit(8).select("ord", "url")
)


def selected(spark: SparkSession, sf: str, most: int = 8) -> DataFrame:
    return H.select_candidates(H.place(deduped(spark, sf), "composite"), most)


# the greedy turns, one query a step, in the order of the queries' first rows; at most two rows a site
SELECTED = f"""WITH RECURSIVE {DEDUPED}, x AS (SELECT *, {COMPOSITE} AS rank_score, coalesce({O.registered('url')}, '') AS site FROM first),
  items AS (SELECT ord, query, url, site, row_number() OVER (ORDER BY rank_score DESC, ord) AS place FROM x WHERE NOT {O.junk_url('url')} AND NOT {O.junk_title('title')}),
  queries AS (SELECT query, row_number() OVER (ORDER BY min(place)) - 1 AS number FROM items GROUP BY query), listed AS (SELECT * FROM items JOIN queries USING (query)),
  turns AS (
    SELECT 0 AS step, CAST([] AS BIGINT[]) AS taken, CAST([] AS VARCHAR[]) AS sites, 0 AS idle
    UNION ALL
    SELECT step + 1, CASE WHEN p.ord IS NULL THEN taken ELSE list_append(taken, p.ord) END, CASE WHEN p.ord IS NULL THEN sites ELSE list_append(sites, p.site) END, CASE WHEN p.ord IS NULL THEN idle + 1 ELSE 0 END
    FROM turns t LEFT JOIN LATERAL (
      SELECT arg_min(i.ord, i.place) AS ord, arg_min(i.site, i.place) AS site FROM listed i
      WHERE i.number = t.step % (SELECT count(*) FROM queries) AND NOT list_contains(t.taken, i.ord) AND len(list_filter(t.sites, lambda z: z = i.site)) < 2) p ON true
    WHERE len(taken) < 8 AND idle < (SELECT count(*) FROM queries)),
  done AS (SELECT unnest(taken) AS ord, unnest(range(1, len(taken) + 1)) AS turn FROM (SELECT taken FROM turns ORDER BY step DESC LIMIT 1))
  SELECT CAST(turn AS INTEGER) AS turn, ord, query, url FROM done JOIN items USING (ord)"""
register("sel1_candidates", SELECTED)(lambda s, d: selected(s, d).select("turn", "ord", "query", "url"))
register("sel2_all_fit", f"""WITH {DEDUPED} SELECT ord, query, url FROM first WHERE NOT {O.junk_url('url')} AND NOT {O.junk_title('title')}""")(
    lambda s, d: selected(s, d, 1 << 20).select("ord", "query", "url")
)
register("set1_union", f"""WITH {I.HITS} SELECT engine, count(*) AS n, min(ord) AS first FROM (SELECT *
    FROM hits WHERE engine = 'bing' UNION ALL SELECT * FROM hits WHERE engine = 'brave') GROUP BY engine""")(
    lambda s, d: H.union(I.hits(s, d).where("engine = 'bing'"), I.hits(s, d).where("engine = 'brave'")).groupBy("engine").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
)
FOLLOWED = f"""{I.HITS}, followed AS (SELECT query, url AS url_canonical, CASE
    WHEN query = 'again' THEN 'ExtractFailed' WHEN ord % 4 = 0 THEN 'Ok' WHEN ord % 4 = 1 THEN 'ExtractFailed'
    WHEN ord % 4 = 2 THEN 'ChromeOrEmpty' ELSE 'PdfUnextracted' END AS body_status FROM hits)"""


def followed(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("Ok", "ExtractFailed", "ChromeOrEmpty", "PdfUnextracted"))), (F.col("ord") % 4 + 1).cast("int"))
    kind = F.when(F.col("query") == "again", "ExtractFailed").otherwise(kind)
    return I.hits(spark, sf).select("query", F.col("url").alias("url_canonical"), kind.alias("body_status"))


register("agg1_coverage", f"""WITH {FOLLOWED}
    SELECT query, count(*) AS total_hits, count(*) FILTER (WHERE body_status = 'Ok') AS followed_ok, count(*) FILTER (WHERE body_status <> 'Ok') AS followed_failed
    FROM followed GROUP BY query""")(lambda s, d: H.coverage(followed(s, d)))
register("agg2_unique_sources", f"""WITH {FOLLOWED} SELECT count(DISTINCT {O.registered('url_canonical')}) AS unique_sources
    FROM followed""")(lambda s, d: H.unique_sources(followed(s, d)))
register("agg3_summary", f"""WITH {FOLLOWED}
    SELECT CAST(5 AS BIGINT) AS total_queries, count(*) AS total_results, count(DISTINCT {O.registered('url_canonical')}) AS unique_sources_followed
    FROM followed""")(lambda s, d: H.run_summary(followed(s, d), 5))
register("agg3_summary_of_nothing", "SELECT CAST(5 AS BIGINT) AS total_queries, CAST(0 AS BIGINT) AS total_results, CAST(0 AS BIGINT) AS unique_sources_followed")(
    lambda s, d: H.run_summary(followed(s, d).where("false"), 5)
)
register("agg4_warnings", f"""WITH {FOLLOWED},
  c AS (SELECT query, count(*) AS n, count(*) FILTER (WHERE body_status = 'Ok') AS ok FROM followed GROUP BY query),
  t AS (SELECT count(*) FILTER (WHERE body_status <> 'PdfUnextracted') AS non_pdf, count(*) FILTER (WHERE body_status <> 'Ok') AS not_ok, count(*) FILTER (WHERE body_status = 'Ok') AS ok, count(*) AS n, count(DISTINCT {O.registered('url_canonical')}) AS sites FROM followed)
  SELECT 'no_body_for_query' AS kind, query FROM c WHERE ok = 0 AND n > 0 UNION ALL SELECT 'collapsed_to_one_site', NULL FROM t WHERE sites <= 1 AND n > 1
  UNION ALL SELECT 'all_snippet_only', NULL FROM t WHERE non_pdf > 0 AND not_ok = non_pdf UNION ALL SELECT 'all_snippet_only_strict', NULL FROM t WHERE non_pdf > 0 AND ok = 0""")(
    lambda s, d: H.warnings(followed(s, d))
)
register("agg6_longest_snippet", f"WITH {I.HITS} SELECT coalesce(max(strlen(snippet)), 1) AS longest FROM hits")(
    lambda s, d: H.longest_snippet(I.hits(s, d))
)
register("agg8_winning_engine", f"""WITH {I.HITS} SELECT query, CASE
    WHEN min(engine) = max(engine) THEN min(engine) END AS engine FROM hits GROUP BY query""")(
    lambda s, d: H.winning_engine(I.hits(s, d))
)
register("jn2_address_counts", f"WITH {KEYED} SELECT ord, count(*) OVER (PARTITION BY key) AS times FROM keyed")(
    lambda s, d: H.address_counts(I.hits(s, d)).select("ord", "times")
)
register("jn3_without_blocked", f"""WITH {I.HITS}, b AS (SELECT {O.host('url')} AS host FROM hits GROUP BY 1
    HAVING count(*) > 4) SELECT ord FROM hits WHERE {O.host('url')} NOT IN (SELECT host
    FROM b WHERE host IS NOT NULL) OR {O.host('url')} IS NULL""")(
    lambda s, d: H.without_blocked(I.hits(s, d), I.hits(s, d).groupBy(U.host(F.col("url")).alias("host")).agg(F.count("*").alias("n")).where("n > 4").select("host")).select("ord")
)


# --- texts -------------------------------------------------------------------


def text_query(name: str, columns: dict[str, tuple], rows: int | None = None) -> None:
    sql = f"WITH {I.TEXTS} SELECT doc_id, {', '.join(f'{s} AS {n}' for n, (_, s) in columns.items())} FROM texts"
    register(name, sql)(lambda spark, sf: I.texts(spark, sf).select("doc_id", *[c(F.col("text")).alias(n) for n, (c, _) in columns.items()]))


t = "text"
text_query("flt9_block_markers", {"blocked": (Q.has_block_markers, f"regexp_matches(lower(text), '{Q.BLOCK_MARKERS}')")})
text_query("flt11_nav_dense", {"dense": (Q.is_nav_dense, f"{O.edged_count(t, Q.NAV_WORDS)} >= 3")})
text_query("flt12_nav_link_dense", {"dense": (Q.is_nav_link_dense, f"""{O.edged_count(t, Q.NAV_WORDS)} >= 3 OR len(regexp_extract_all(text, '(?i)learn more|read more')) >= 3""")})
text_query("flt13_tab_bar", {"tabs": (Q.is_tab_bar, f"{O.edged_count(t, Q.TAB_WORDS)} >= 4")})
text_query("flt14_boilerplate", {"boilerplate": (Q.has_boilerplate, f"regexp_matches(text, {O.lit(Q.BOILERPLATE)})")})
text_query("flt15_nav_heavy", {"heavy": (Q.is_nav_heavy, O.nav_heavy(t))})
text_query("flt16_empty_shell", {"shell": (Q.is_empty_shell, O.empty_shell(t))})
text_query("flt17_blocking", {"blocking": (lambda c: Q.is_blocking(Q.flags(c)), f"len(list_intersect({O.flags(t)}, ['BotWall', 'Paywall'])) > 0")})
text_query("txt3_collapse", {"collapsed": (lambda c: F.md5(T.collapse(c).cast("binary")), f"md5({O.collapse(t)})")})
text_query("txt4_collapse_lines", {"collapsed": (lambda c: F.md5(T.collapse_lines(c).cast("binary")), f"""md5({O.trim("regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), '\\n{2,}', chr(10), 'g')")})""")})
text_query("txt5_strip_boilerplate", {"stripped": (lambda c: F.md5(T.strip_boilerplate(c).cast("binary")), f"""md5({O.trim("regexp_replace(regexp_replace(regexp_replace(text, '(?i)press enter or click to view (the )?image in full size', '', 'g'), '[ \\t]+', ' ', 'g'), '\\n{2,}', chr(10), 'g')")})""")})
TITLED = "CASE WHEN ord % 2 = 0 THEN concat(translate(title, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '  ', snippet) ELSE snippet END"
register("txt6_strip_leading_title", f"""WITH {I.HITS} SELECT ord, CASE
    WHEN length(title) > 0 AND starts_with(lower(c), lower(title)) THEN regexp_replace(c[length(title) + 1:], '^{O.WS}+', '')
    ELSE c END AS rest FROM (SELECT *, {TITLED} AS c
    FROM hits)""")(
    lambda s, d: I.hits(s, d).select("ord", T.strip_leading_title(F.expr(TITLED), F.col("title")).alias("rest"))
)
text_query("txt7_find_ci", {"place": (lambda c: T.find_ci(c, F.lit("THE")), "nullif(strpos(lower(text), 'the'), 0) - 1")})
text_query("txt10_strip_suffix", {"n": (lambda c: F.length(T.strip_suffix(c, ".")), f"""CAST(length({O.trim("CASE WHEN ends_with(text, '.') THEN text[1:length(text) - 1] ELSE text END")}) AS INTEGER)""")})
text_query("txt11_slice", {"part": (lambda c: T.slice_text(c, 5, 20), "text[6:25]")})
text_query("txt12_pagination", {"truncated": (lambda c: T.is_truncated(F.octet_length(c), 100, 1000), "1100 < strlen(text)")})
text_query("txt13_entropy", {"entropy": (lambda c: F.round(T.entropy(c), 6), f"round({O.entropy(t)}, 6)")})
text_query("txt14_word_count", {"words": (T.word_count, f"CAST({O.words(t)} AS INTEGER)")})
text_query("txt22_normalize_title", {"title": (lambda c: F.md5(T.normalize_title(c).cast("binary")), f"md5(lower({O.collapse(t)}))")})
text_query("txt23_preview", {"bytes": (lambda c: F.octet_length(T.preview(c, 101)), f"CAST(strlen({O.preview(t, 101)}) AS INTEGER)"), "head": (lambda c: T.preview(c, 40), O.preview(t, 40))})
text_query("qlt1_flags", {"flags": (lambda c: F.array_join(Q.flags(c), ","), f"array_to_string({O.flags(t)}, ',')")})
text_query("qlt2_error_pages", {"reasons": (lambda c: F.array_join(Q.error_reasons(c), ","), """array_to_string(list_filter([CASE
    WHEN regexp_matches(text, '(?i)This site can''t be reached') THEN 'browser_error_page' END, CASE
    WHEN contains(text, 'ERR_CONNECTION') THEN 'connection_error' END, CASE
    WHEN contains(text, '404 Not Found') THEN 'not_found' END], lambda r: r IS NOT NULL), ',')""")})
text_query("qlt9_teaser", {"teaser": (lambda c: c == Q.READ_MORE, f"text = {O.lit(Q.READ_MORE)}")})
VALID = f"{I.TEXTS}, sliced AS (SELECT doc_id, text, {O.preview(t)} AS s FROM texts), judged AS (SELECT *, {O.reasons('s', 'text')} AS r FROM sliced)"


def validated(spark: SparkSession, sf: str) -> DataFrame:
    return Q.validate(I.texts(spark, sf), "text").withColumnRenamed("reasons", "r")


register("qlt3_validate", f"""WITH {VALID} SELECT doc_id, array_to_string(r, ',') AS reasons, {O.score('s', 'text', 'r')} AS score, {O.score('s', 'text', 'r')} >= 0.5 AS is_ok, CAST(strlen(text) AS INTEGER) AS length
    FROM judged""")(
    lambda s, d: validated(s, d).select("doc_id", F.array_join("r", ",").alias("reasons"), "score", (F.col("score") >= 0.5).alias("is_ok"), F.octet_length("text").alias("length"))
)
register("qlt5_record", f"""WITH {VALID} SELECT doc_id, {O.score('s', 'text', 'r')} AS score, {O.score('s', 'text', 'r')} >= 0.5 AS is_ok, array_to_string(r, ',') AS reasons, round({O.entropy(t)}, 4) AS entropy
    FROM judged""")(
    lambda s, d: validated(s, d).select("doc_id", Q.record(F.col("score"), F.col("score") >= 0.5, F.col("r"), T.entropy(F.col("text"))).alias("q")).select("doc_id", "q.score", "q.is_ok", F.array_join("q.reasons", ",").alias("reasons"), F.round(F.col("q.entropy_bits_per_char").cast("double"), 4).alias("entropy"))
)
register("qlt4_penalties", f"""WITH {VALID}, x AS (SELECT doc_id, unnest(r) AS reason FROM judged)
    SELECT reason, count(*) AS n, CAST(CASE reason """ + " ".join(f"WHEN '{k}' THEN {v}" for k, v in Q.PENALTIES.items()) + " ELSE 0 END AS DOUBLE) AS penalty FROM x GROUP BY reason")(
    lambda s, d: validated(s, d).select(F.explode("r").alias("reason")).groupBy("reason").agg(F.count("*").alias("n")).withColumn("penalty", Q.penalty(F.col("reason")))
)
BODY_RULES = [(f"list_contains(f, '{k}')", n, p) for k, (n, p) in Q.FLAG_PENALTIES.items()] + [
    ("list_contains(r, 'too_short')", "too_short", 0.2), ("list_contains(r, 'too_few_words')", "too_few_words", 0.1), (f"list_contains(r, 'boilerplate') AND {O.nav_heavy(t)}", "boilerplate", 0.1),
    (f"list_contains(r, 'navigation_chrome') AND {O.nav_heavy(t)}", "nav_chrome", 0.6), (f"{O.entropy(t)} < 1.5", "low_entropy", 0.1),
]
_left = "CAST(1 AS DOUBLE)"
for _when, _, _p in BODY_RULES:
    _left = f"({_left} - CASE WHEN {_when} THEN CAST({_p} AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)"
BODY = f"""{VALID}, flagged AS (SELECT *, {O.flags(t)} AS f FROM judged),
  scored AS (SELECT *, greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), {_left})) AS q, list_filter([{', '.join(f"CASE WHEN {w} THEN '{n}' END" for w, n, _ in BODY_RULES)}], lambda x: x IS NOT NULL) AS qr FROM flagged),
  body AS (SELECT doc_id, text, CASE WHEN text = '' THEN CAST(0 AS DOUBLE) ELSE q END AS score, text <> '' AND q >= 0.5 AS is_ok,
    CASE WHEN text = '' THEN ['empty_content'] WHEN len(qr) = 0 AND q < 0.5 THEN ['low_quality'] ELSE qr END AS reasons FROM scored)"""


def bodies(spark: SparkSession, sf: str) -> DataFrame:
    return Q.judge_body(I.texts(spark, sf).withColumn("flags", Q.flags(F.col("text"))), "text", "flags")


register("qlt7_body_quality", f"""WITH {BODY}
    SELECT doc_id, round(score, 9) AS score, is_ok, array_to_string(reasons, ',') AS reasons FROM body""")(
    lambda s, d: bodies(s, d).select("doc_id", F.round("q_score", 9).alias("score"), F.col("q_is_ok").alias("is_ok"), F.array_join("q_reasons", ",").alias("reasons"))
)
register("qlt8_body_status", f"""WITH {BODY} SELECT doc_id, CASE WHEN text = '' AND e = '' THEN 'ChromeOrEmpty' WHEN e <> '' THEN 'ExtractFailed'
  WHEN NOT is_ok AND len(list_filter(reasons, lambda r: regexp_matches(r, 'too_short|nav|chrome'))) > 0 AND {O.nav_heavy(t)} THEN 'ChromeOrEmpty'
  WHEN NOT is_ok AND len(list_filter(reasons, lambda r: regexp_matches(r, 'paywall|bot_blocked|captcha'))) > 0 THEN 'ExtractFailed' ELSE 'Ok' END AS body_status
  FROM (SELECT *, CASE WHEN doc_id % 11 = 0 THEN 'timeout' ELSE '' END AS e FROM body)""")(
    lambda s, d: bodies(s, d).select("doc_id", Q.body_status(F.col("text"), F.when(F.col("doc_id") % 11 == 0, "timeout").otherwise(""), F.col("q_is_ok"), F.col("q_reasons")).alias("body_status"))
)
register("agg5_char_histogram", "SELECT c AS letter, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) GROUP BY c")(
    lambda s, d: H.char_histogram(I.table(s, d, "documents"))
)
