"""DuckDB expressions of the functions, for checking only; written apart from the Spark side."""

from __future__ import annotations

from gleaner.functions import quality as Q
from gleaner.functions import text as T
from gleaner.functions import url as U

RE = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
WS = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def listing(items) -> str:
    return "(" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + ")"


def lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def piece(u: str, i: int) -> str:
    return f"regexp_extract({u}, {lit(RE)}, {i})"


def host(u: str) -> str:
    return f"nullif(lower(regexp_replace(regexp_replace({piece(u, 2)}, '^.*@', ''), ':[0-9]*$', '')), '')"


def host_is(h: str, domains) -> str:
    known = f"coalesce({h}, '')"
    return f"({known} IN {listing(domains)} OR " + " OR ".join(f"ends_with({known}, '.{d}')" for d in domains) + ")"


def decoded(x: str) -> str:
    return f"url_decode(replace({x}, '+', ' '))"


def encoded(x: str) -> str:
    return f"replace(replace(replace(url_encode({x}), '%20', '+'), '%2A', '*'), '~', '%7E')"


def canonical(u: str, fragment: bool = True) -> str:
    a = f"lower({piece(u, 2)})"
    s = f"lower({piece(u, 1)})"
    a = f"CASE {s} WHEN 'http' THEN regexp_replace({a}, ':80$', '') WHEN 'https' THEN regexp_replace({a}, ':443$', '') ELSE {a} END"
    p = f"array_to_string(list_filter(string_split({piece(u, 3)}, '/'), lambda x: x <> ''), '/')"
    p = f"translate({p}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    k, v = decoded("split_part(x, '=', 1)"), decoded("CASE WHEN contains(x, '=') THEN x[strpos(x, '=') + 1:] ELSE '' END")
    pairs = f"list_transform(list_filter(string_split({piece(u, 4)}, '&'), lambda x: x <> ''), lambda x, i: {{'k': {k}, 'i': i, 'v': {v}}})"
    pairs = f"list_sort(list_filter({pairs}, lambda p: p.k NOT IN {listing(U.TRACKING_KEYS)}))"
    q = f"array_to_string(list_transform({pairs}, lambda p: {encoded('p.k')} || '=' || {encoded('p.v')}), '&')"
    f = f"CASE WHEN contains({u}, '#') THEN '#' || {piece(u, 5)} ELSE '' END" if fragment else "''"
    return f"""CASE WHEN regexp_matches({u}, {lit(RE)}) THEN {s} || '://' || {a} || '/' || {p} || CASE WHEN len({pairs}) > 0 THEN '?' || {q}
    ELSE '' END || {f}
    ELSE {u} END"""


def registered(u: str) -> str:
    h = host(u)
    return f"""CASE WHEN {h} IS NULL OR regexp_matches({h}, '^[0-9.]+$|^\\[') THEN NULL
      WHEN regexp_extract({h}, '([^.]+\\.[^.]+)$', 1) IN {listing(U.TWO_LABEL_SUFFIXES)} THEN nullif(regexp_extract({h}, '([^.]+\\.[^.]+\\.[^.]+)$', 1), '')
      ELSE nullif(regexp_extract({h}, '([^.]+\\.[^.]+)$', 1), '') END"""


def authority(h: str) -> str:
    tiers = " ".join(f"WHEN {host_is(h, d)} THEN {s}" for s, d in U.AUTHORITY_TIERS)
    academic = " OR ".join(f"ends_with(coalesce({h}, ''), '{s}')" for s in U.ACADEMIC_SUFFIXES)
    return f"CAST(CASE {tiers} WHEN {academic} THEN 0.8 ELSE 0.5 END AS DOUBLE)"


def url_authority(u: str) -> str:
    return authority(f"""coalesce({registered(u)}, lower(split_part(regexp_replace(regexp_replace({u}, '^(https://)+', ''), '^(http://)+', ''), '/', 1)))""")


def source_type(u: str) -> str:
    h, p = host(u), f"lower(split_part({u}, '?', 1))"
    return f"""CASE WHEN {host_is(h, ["github.com"])} THEN 'github' WHEN {host_is(h, ["arxiv.org"])} THEN 'paper' WHEN ends_with({p}, '.pdf') THEN 'pdf'
      WHEN {host_is(h, U.NEWS_DOMAINS)} THEN 'news' WHEN regexp_matches({p}, '\\.(jpg|jpeg|png|gif|webp)$') OR {host_is(h, U.IMAGE_DOMAINS)} THEN 'image' ELSE 'web' END"""


def translate_wrapper(u: str) -> str:
    h = f"coalesce({host(u)}, '')"
    return f"""({h} = 'translate.google.com' OR ends_with({h}, '.translate.goog') OR ({h} IN ('google.com', 'www.google.com') AND ends_with(split_part({u}, '?', 1), '/url') AND contains({u}, '?q=')))"""


def non_latin(x: str) -> str:
    return f"regexp_matches({x}, {lit(U.NON_LATIN)})"


def dictionary(u: str, t: str, s: str) -> str:
    return f"""({host_is(host(u), U.DICTIONARY_DOMAINS)} OR regexp_matches(lower({t}), '^\\s*\\S+\\s* definition$') OR contains(lower({s}), 'definition of'))"""


def junk_url(u: str) -> str:
    return f"regexp_matches(lower({u}), {lit(U.JUNK_URL)})"


def junk_title(t: str) -> str:
    return f"regexp_matches(lower({t}), {lit(U.JUNK_TITLE)})"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def clean_snippet(x: str) -> str:
    return f"CASE WHEN ends_with({x}, 'Read more') THEN {trim(f"regexp_replace({x}, '([.][.][.])?Read more$', '')")} ELSE {x} END"


def clean_title(x: str) -> str:
    for prefix in ("https://", "http://"):
        x = f"CASE WHEN contains({x}, '{prefix}') THEN {trim(f"split_part({x}, '{prefix}', 1)")} ELSE {x} END"
    endings = "com|org|net|io|edu|gov|co|uk|us|ca|de|fr|jp|au|info|biz|me|tv|xyz|dev|app|ai|ru|cn|in|br|it|es|nl|se|pl|ch|at|be|dk|fi|no|pt|gr|cz|hu|ro|ua|tr|il|kr|tw|hk|sg|my|th|vn|ph|id|nz|za|mx|ar|cl|pe|ve"
    return trim(f"regexp_replace({x}, '(?s)^(.*[\\p{{Ll}})])\\p{{Lu}}.*\\.(?i:{endings})$', '\\1')")


def keep_hit() -> str:
    return f"""NOT (contains(url, '#:~:text=') OR {translate_wrapper('url')} OR {non_latin('title')} OR {non_latin('snippet')} OR {dictionary('url', 'title', 'snippet')} OR {junk_url('url')} OR {trim('title')} = '' OR {trim('snippet')} = '')"""


def words(x: str) -> str:
    return f"len(regexp_extract_all({x}, '[^{WS[1:]}+'))"


def edged_count(x: str, alternatives: str) -> str:
    """Count of whole-word matches: RE2 has no look-around, so edges are marked first."""
    w = r"[^\p{L}\p{N}\p{M}_]"
    return f"len(regexp_extract_all(regexp_replace(' ' || {x} || ' ', '({w})', '\\1\\1', 'g'), '(?i){w}(?:{_spread(alternatives)}){w}'))"


def _spread(alternatives: str) -> str:
    return alternatives.replace(" ", "  ")


def entropy(x: str) -> str:
    t = trim(x)
    counts = f"map_values(list_histogram(string_split({t}, '')))"
    return f"""CASE WHEN {t} = '' THEN 0.0 ELSE -list_sum(list_transform({counts}, lambda n: (CAST(n AS DOUBLE) / length({t})) * log2(CAST(n AS DOUBLE) / length({t})))) END"""


def nav_heavy(x: str) -> str:
    n = edged_count(x, Q.NAV_WORDS)
    return f"CASE WHEN strlen({x}) > 1000 THEN false WHEN {n} < 3 THEN false WHEN strlen({x}) < 500 THEN true ELSE {n} * 15 >= strlen({x}) // 2 END"


def empty_shell(x: str) -> str:
    return f"""CASE WHEN strlen({x}) < 80 THEN true WHEN regexp_matches({x}, {lit(Q.EMPTY_SHELL)}) THEN true
      WHEN strlen({x}) < 120 THEN NOT regexp_matches({x}, '[.!?]') OR {edged_count(x, Q.NAV_WORDS)} >= 3 ELSE {words(x)} < 15 END"""


def flags(x: str) -> str:
    tests = [(f"regexp_matches({x}, {lit(p)})", n) for p, n in ((Q.BOT_WALL, "BotWall"), (Q.PAYWALL, "Paywall"), (Q.CAPTCHA, "Captcha"))] + [(empty_shell(x), "EmptyShell")]
    return "list_filter([" + ", ".join(f"CASE WHEN {t} THEN '{n}' END" for t, n in tests) + "], lambda f: f IS NOT NULL)"


def preview(x: str, limit: int = 15000) -> str:
    """The longest prefix of whole characters within so many bytes; every character has four bytes at most."""
    return f"""CASE WHEN strlen({x}) <= {limit} THEN {x} ELSE {x}[1:list_max(list_filter(range({limit // 4}, {limit} + 1), lambda k: strlen({x}[1:k]) <= {limit}))] END"""


def reasons(s: str, whole: str) -> str:
    """Reasons of a slice column ``s`` of the text ``whole``."""
    size = f"strlen({s})"
    more = f"len(regexp_extract_all({s}, '(?i)learn more|read more')) >= 3"
    chrome = f"""({size} < 100 AND NOT contains({s}, '\"')) OR ({size} >= 100 AND ({edged_count(s, Q.NAV_WORDS)} >= 3 OR {more})) OR {edged_count(s, Q.TAB_WORDS)} >= 4"""
    tests = [
        (f"{size} < 80", "too_short"), (f"regexp_matches({s}, '(?i)This site can''t be reached')", "browser_error_page"), (f"contains({s}, 'ERR_CONNECTION')", "connection_error"),
        (f"contains({s}, '404 Not Found')", "not_found"), (f"{s} = {lit(Q.READ_MORE)}", "paywall_teaser"), (chrome, "navigation_chrome"),
        (f"regexp_matches({s}, {lit(Q.BOILERPLATE)})", "boilerplate"), (f"{words(s)} < 15 AND {size} < 200", "too_few_words"), (f"{size} > 100 AND NOT regexp_matches({s}, '[.!?]')", "no_punctuation"),
    ]
    found = "list_filter([" + ", ".join(f"CASE WHEN {t} THEN '{n}' END" for t, n in tests) + "], lambda r: r IS NOT NULL)"
    return f"CASE WHEN {whole} = '' THEN ['empty_content'] ELSE {found} END"


def score(s: str, whole: str, r: str) -> str:
    left = "CAST(1.0 AS DOUBLE)"
    for name, p in Q.PENALTIES.items():
        left = f"({left} - CASE WHEN list_contains({r}, '{name}') THEN CAST({p} AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)"
    left = f"({left} + CASE WHEN regexp_matches({s}, '[.!?]') THEN CAST(0.05 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)"
    left = f"({left} + CASE WHEN regexp_matches({s}, '[\\p{{L}}\\p{{N}}\\p{{M}}_]{{4,}}') THEN CAST(0.05 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)"
    return f"CASE WHEN {whole} = '' THEN CAST(0 AS DOUBLE) ELSE round(greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), {left})) * 100) / 100 END"


def entities(x: str, names=("amp", "middot", "copy", "quot", "eacute", "lt", "gt")) -> str:
    for n in [k for k in names if k != "amp"]:
        x = f"replace({x}, '&{n};', {lit(T.ENTITIES[n])})"
    return f"replace({x}, '&amp;', '&')"
