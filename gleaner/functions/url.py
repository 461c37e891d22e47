"""URL functions: Column in, Column out, all inside Catalyst."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query keys that carry tracking only.
TRACKING_KEYS = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "_ga", "_gl", "mc_cid", "mc_eid"]

# Authority of known domains and their subdomains, highest tier first.
AUTHORITY_TIERS = [
    (0.9, "arxiv.org scholar.google.com pubmed.ncbi.nlm.nih.gov doi.org ieeexplore.ieee.org dl.acm.org springer.com elsevier.com sciencedirect.com nature.com science.org plos.org wikipedia.org wikidata.org semanticscholar.org cell.com".split()),
    (0.8, "github.com gitlab.com bitbucket.org docs.rs crates.io pypi.org npmjs.com stackoverflow.com stackexchange.com rust-lang.org mozilla.org chromium.org openai.com deepmind.com research.google.com mit.edu stanford.edu ox.ac.uk cam.ac.uk ibm.com microsoft.com google.com apple.com oracle.com redhat.com nginx.com docker.com cloudflare.com".split()),
    (0.7, "reuters.com ap.org bbc.com bbc.co.uk nytimes.com wsj.com economist.com theguardian.com washingtonpost.com bloomberg.com ft.com npr.org techcrunch.com".split()),
]
ACADEMIC_SUFFIXES = [".edu", ".gov", ".ac.uk"]
NEWS_DOMAINS = ["nytimes.com", "cnn.com", "reuters.com", "bbc.com"]
IMAGE_DOMAINS = ["imgur.com", "flickr.com"]
DICTIONARY_DOMAINS = ["cambridge.org", "merriam-webster.com", "dictionary.com", "scribbr.com", "thefreedictionary.com", "vocabulary.com", "collinsdictionary.com", "oxfordlearnersdictionaries.com"]
LANGUAGES = {
    "rs": "rust", "py": "python", "js": "javascript", "mjs": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "java": "java", "c": "c", "h": "c",
    "cpp": "cpp", "hpp": "cpp", "cc": "cpp", "cxx": "cpp", "md": "markdown", "mdx": "markdown", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml",
    "sh": "shell", "bash": "shell", "css": "css", "html": "html", "htm": "html", "sql": "sql", "rb": "ruby", "swift": "swift", "kt": "kotlin", "kts": "kotlin",
}
#: Public suffixes of two labels; every other suffix is taken as one label (there is no suffix list offline).
TWO_LABEL_SUFFIXES = ["co.uk", "ac.uk", "gov.uk", "org.uk", "me.uk", "com.au", "net.au", "org.au", "edu.au", "co.jp", "ac.jp", "co.nz", "com.br", "com.cn", "co.in", "co.za", "com.mx", "co.kr", "com.tr", "com.sg", "com.hk", "com.tw"]

_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used; else each use would hold it whole."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _piece(url: Column, group: int) -> Column:
    return F.regexp_extract(url, "(?s)" + _URL, group)


def is_url(url: Column) -> Column:
    return F.coalesce(url.rlike("(?s)" + _URL), F.lit(False))


def host(url: Column) -> Column:
    """Lower-cased host without user information and port; null where there is none."""
    authority = F.regexp_replace(_piece(url, 2), "^.*@", "")
    return F.get(F.filter(F.array(F.lower(F.regexp_replace(authority, ":[0-9]*$", ""))), lambda h: h != ""), F.lit(0))


def path(url: Column) -> Column:
    return _piece(url, 3)


def host_is(host_column: Column, domains: list[str]) -> Column:
    """The host is one of the domains or a subdomain."""

    def known(h: Column) -> Column:
        out = h.isin(domains)
        for d in domains:
            out = out | h.endswith("." + d)
        return out

    return _let(F.coalesce(host_column, F.lit("")), known)


def query_pairs(url: Column) -> Column:
    """Decoded (key, value, place) structs of the query, empty parts left out."""
    parts = F.filter(F.split(_piece(url, 4), "&"), lambda p: p != "")

    def decoded(x: Column) -> Column:
        return F.coalesce(F.try_url_decode(x), x)

    def pair(p: Column, i: Column) -> Column:
        return F.struct(decoded(F.substring_index(p, "=", 1)).alias("key"), i.alias("place"), decoded(F.when(p.contains("="), F.substring(p, F.locate("=", p) + 1, F.length(p))).otherwise("")).alias("value"))

    return F.transform(parts, pair)


def is_tracking_key(key: Column) -> Column:
    return key.isin(TRACKING_KEYS)


def encoded_query(pairs: Column) -> Column:
    """Form-urlencoded query of (key, place, value) structs."""
    return F.array_join(F.transform(pairs, lambda p: F.concat(F.url_encode(p["key"]), F.lit("="), F.url_encode(p["value"]))), "&")


def canonicalize_url(url: Column, keep_fragment: bool = True) -> Column:
    """Lower-case scheme, host and path, single slashes, no trailing slash, no tracking keys, sorted keys.

    Text that is no URL comes back unchanged; null stays null.
    """
    scheme = F.lower(_piece(url, 1))
    authority = F.lower(_piece(url, 2))
    authority = F.when(scheme == "http", F.regexp_replace(authority, ":80$", "")).when(scheme == "https", F.regexp_replace(authority, ":443$", "")).otherwise(authority)
    segments = F.filter(F.split(path(url), "/"), lambda s: s != "")
    lowered = F.translate(F.array_join(segments, "/"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    pairs = F.array_sort(F.filter(query_pairs(url), lambda p: ~is_tracking_key(p["key"])))
    query = F.regexp_replace(F.concat(F.lit("?"), encoded_query(pairs)), r"^\?$", "")
    fragment = F.when(url.contains("#"), F.concat(F.lit("#"), _piece(url, 5))).otherwise("") if keep_fragment else F.lit("")
    return F.when(is_url(url), F.concat(scheme, F.lit("://"), authority, F.lit("/"), lowered, query, fragment)).otherwise(url)


def dedup_key(url: Column) -> Column:
    return canonicalize_url(url, keep_fragment=False)


def strip_fragments(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def is_arxiv_url(url: Column) -> Column:
    return F.coalesce(host_is(host(url), ["arxiv.org"]) & path(url).rlike("/(abs|pdf)/"), F.lit(False))


def is_pdf_url(url: Column) -> Column:
    arxiv = host_is(host(url), ["arxiv.org"]) & path(url).contains("/pdf/")
    return F.coalesce(is_url(url) & (F.lower(path(url)).endswith(".pdf") | arxiv), F.lit(False))


def registered_domain(url: Column) -> Column:
    """The public suffix and one label more; null for addresses, bare suffixes and text without a host."""

    def domain(h: Column) -> Column:
        labels = F.split(h, r"\.")
        wide = F.array_join(F.slice(labels, -2, 2), ".").isin(TWO_LABEL_SUFFIXES)
        last = F.when(wide, F.regexp_extract(h, r"([^.]+\.[^.]+\.[^.]+)$", 1)).otherwise(F.regexp_extract(h, r"([^.]+\.[^.]+)$", 1))
        return F.when(h.isNotNull() & ~h.rlike(r"^[0-9.]+$|^\[") & (last != ""), last)

    return _let(host(url), domain)


def domain_authority(host_column: Column) -> Column:
    """0.9, 0.8 or 0.7 for known domains, 0.8 for academic and government hosts, else 0.5."""

    def tier(h: Column) -> Column:
        out = F.when(F.lit(False), 0.0)
        for score, domains in AUTHORITY_TIERS:
            held = h.isin(domains)
            for d in domains:
                held = held | h.endswith("." + d)
            out = out.when(held, score)
        academic = F.lit(False)
        for s in ACADEMIC_SUFFIXES:
            academic = academic | h.endswith(s)
        return out.when(academic, 0.8).otherwise(0.5)

    return _let(F.lower(F.coalesce(host_column, F.lit(""))), tier)


def url_authority(url: Column) -> Column:
    """Authority of a URL's registered domain, or of the text before its first slash."""
    plain = F.lower(F.substring_index(F.regexp_replace(F.regexp_replace(url, "^(https://)+", ""), "^(http://)+", ""), "/", 1))
    return domain_authority(F.coalesce(registered_domain(url), plain))


def source_type(url: Column) -> Column:
    """github, paper, pdf, news, image or web, for hits."""
    h = host(url)
    p = F.lower(F.substring_index(url, "?", 1))
    image = p.rlike(r"\.(jpg|jpeg|png|gif|webp)$")
    return (
        F.when(host_is(h, ["github.com"]), "github").when(host_is(h, ["arxiv.org"]), "paper").when(p.endswith(".pdf"), "pdf")
        .when(host_is(h, NEWS_DOMAINS), "news").when(image | host_is(h, IMAGE_DOMAINS), "image").otherwise("web")
    )


def extractor_type(url: Column) -> Column:
    """arxiv, github, pdf or web: which extractor a URL goes to."""
    low = F.lower(url)
    return F.when(low.contains("arxiv.org"), "arxiv").when(low.contains("github.com"), "github").when(low.endswith(".pdf") | low.contains("/pdf/"), "pdf").otherwise("web")


def detect_language(url: Column) -> Column:
    """Programming language by file extension; an unknown extension is its own name."""
    extension = F.substring_index(F.substring_index(url, "?", 1), ".", -1)
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(table[extension], extension)


def is_allowed_scheme(url: Column) -> Column:
    return F.coalesce(url.rlike("^(?i)https?://") | (url == "about:blank"), F.lit(False))


def ws_loopback(url: Column, host_name: str) -> Column:
    """A WebSocket address on localhost, moved to the host that was asked."""
    return F.regexp_replace(url, r"^(wss?://)(localhost|127\.0\.0\.1)(?=[:/]|$)", "$1" + host_name)


def ws_port(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"^wss?://[^/:]+:([0-9]+)", 1), F.lit("")).cast("int")


def search_url(engine: str, query: Column, count: int = 5) -> Column:
    """Address of an engine's results for a query."""
    q = F.url_encode(query)
    if engine == "bing":
        return F.concat(F.lit("https://www.bing.com/search?format=rss&q="), q, F.lit("&setlang=en&mkt=en-US"))
    if engine == "brave":
        return F.concat(F.lit("https://search.brave.com/search?q="), q, F.lit("&source=web&hl=en"))
    if engine == "google":
        return F.concat(F.lit("https://www.google.com/search?q="), q, F.lit(f"&num={min(max(2 * count, 10), 100)}&hl=en"))
    if engine == "brave_api":
        return F.concat(F.lit("https://api.search.brave.com/res/v1/web/search?q="), q, F.lit(f"&count={count}&country=us&search_lang=en"))
    raise ValueError(f"no search address for {engine}")


# What a challenge's address or title holds, by engine.
CAPTCHA_URLS = {"brave": ["search.brave.com/verify", "search.brave.com/captcha"], "google": ["/sorry/", "google.com/sorry"]}
CAPTCHA_TITLES = {"brave": ["Verify you are human", "Just a moment"], "google": ["Accessibility", "Learn more"]}


def _holds(text: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for part in parts:
        out = out | text.contains(part)
    return out


def is_captcha_url(engine: str, url: Column) -> Column:
    """Whether an engine has sent a challenge instead of its results."""
    return _holds(url, CAPTCHA_URLS[engine])


def is_captcha_title(engine: str, title: Column) -> Column:
    return _holds(title, CAPTCHA_TITLES[engine])


def is_http_url(url: Column) -> Column:
    return url.rlike("^https?://")


# --- predicates on hits -------------------------------------------------------


def is_translate_wrapper(url: Column) -> Column:
    h = F.coalesce(host(url), F.lit(""))
    wrapped = h.isin("google.com", "www.google.com") & F.substring_index(url, "?", 1).endswith("/url") & url.contains("?q=")
    return F.coalesce((h == "translate.google.com") | h.endswith(".translate.goog") | wrapped, F.lit(False))


# Scripts taken as foreign to English queries, Latin letters with marks included.
NON_LATIN = r"[\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{1E00}-\x{1EFF}\x{00C0}-\x{00FF}\x{0400}-\x{04FF}\x{0370}-\x{03FF}\x{0600}-\x{06FF}\x{0E00}-\x{0E7F}\x{0900}-\x{097F}]"


def has_non_latin_script(text: Column) -> Column:
    return text.rlike(NON_LATIN)


def is_dictionary_junk(url: Column, title: Column, snippet: Column) -> Column:
    word = r"^\s*\S+\s* definition$"
    return host_is(host(url), DICTIONARY_DOMAINS) | F.lower(title).rlike(word) | F.lower(snippet).contains("definition of")


def is_fragment_url(url: Column) -> Column:
    return url.contains("#:~:text=")


# Addresses and phrases of pages that are not worth following.
JUNK_URL = r"^https://(accounts|support|policies)\.google\.com/|/track\?|doubleclick\.net|googlesyndication\.com|/signin|/sign-in|/login|/log-in|/auth/|/auth\?|/auth$"
JUNK_TITLE = r"sign in to continue|log in to continue|sign in to read|log in to read|please sign in|please log in|sign in required|log in required"


def is_junk_url(url: Column) -> Column:
    return F.lower(url).rlike(JUNK_URL)


def is_junk_title(title: Column) -> Column:
    return F.lower(title).rlike(JUNK_TITLE)


# Beginnings of the paths of Google's own pages.
GOOGLE_PATHS = "search url maps images news videos shopping books finance account preferences intl services about support policies howsearchworks advanced_search settings webhp complete sorry local travel flights hotels translate docs drive gmail calendar contacts photos meet tasks forms sites myaccount signin logout".split()


def is_google_nav_path(url: Column) -> Column:
    """Google's own pages among its results; also what is no address at all."""
    own = F.regexp_replace(host(url), r"^www\.", "") == "google.com"
    return ~is_url(url) | (F.coalesce(own, F.lit(False)) & path(url).rlike("^/(?:" + "|".join(GOOGLE_PATHS) + ")"))


def unwrap_bing_redirect(url: Column) -> Column:
    """Target of a ``/ck/a?...u=a1<base64url>`` address; any other address as it is."""
    code = F.translate(F.regexp_extract(url, r"[?&]u=a1([A-Za-z0-9_-]+)", 1), "-_", "+/")
    padded = F.concat(code, F.expr("repeat('=', 0)"), F.substring(F.lit("==="), F.lit(1), F.pmod(-F.length(code), F.lit(4)).cast("int")))
    return F.when(url.contains("/ck/a?") & (code != ""), F.try_to_binary(padded, F.lit("base64")).cast("string")).otherwise(url)
