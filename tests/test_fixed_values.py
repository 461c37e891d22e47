"""Values that must be what they are, stated once more: a wrong constant can't pass by being wrong on both sides."""

import re

from pyspark.sql import functions as F

from gleaner.functions import quality as Q
from gleaner.functions import rewrite as R
from gleaner.functions import text as T
from gleaner.functions import url as U
from gleaner.operators import jobs, state
from gleaner.sinks import frames


def test_engines_and_limits():
    assert state.PRIORITY == {"free": ["google", "brave", "bing"], "api": ["brave_api", "tavily"], "hybrid": ["google", "brave", "bing", "brave_api", "tavily"]}
    assert state.INTERVAL_MS == {"google": 6000, "brave": 5000, "bing": 1000, "brave_api": 1000, "tavily": 1000}
    assert state.COOLDOWN_MS == {"RateLimited": 300000, "Captcha": 1800000} and (state.QUOTA, state.TTL_S) == (2000, 86400)
    assert jobs.BUDGET_MS == {"simple": 10000, "parallel": 20000, "harvest": 45000, "extract": 30000, "ax": 30000, "pdf-url": 30000, "pdf-file": 15000}
    assert (jobs.CAP_MS, jobs.COUNT, jobs.FOLLOW_TOP, jobs.MAX_QUERIES) == (120000, 5, 8, 16)


def test_quality_values():
    assert Q.PENALTIES == {"too_short": 0.4, "browser_error_page": 0.5, "connection_error": 0.5, "not_found": 0.5, "paywall_teaser": 0.5, "navigation_chrome": 0.3, "boilerplate": 0.3, "too_few_words": 0.2, "no_punctuation": 0.1}
    assert Q.FLAG_PENALTIES == {"BotWall": ("bot_blocked", 0.6), "Paywall": ("paywall", 0.6), "Captcha": ("captcha", 0.3), "EmptyShell": ("empty_shell", 0.3)}
    assert (Q.MIN_BYTES, Q.MIN_WORDS, Q.PREVIEW_BYTES, Q.READ_MORE) == (80, 15, 15000, "Read More »")
    assert Q.NAV_WORDS.split("|") == ["about us", "contact us", "privacy policy", "terms of service", "careers", "pricing", "blog", "sign in", "log in", "faq", "help center", "get started"]
    assert Q.TAB_WORDS.split("|") == ["code", "issues", "pull requests", "actions", "projects", "wiki", "security", "insights", "settings"]
    assert Q.BLOCK_MARKERS.split("|") == ["turnstile", "cf-chl", "consent", "challenge", "captcha"]


def test_flag_patterns(spark):
    cases = {
        "BotWall": ["Checking your browser", "cf-chl", "verify you are human", "are you a human", "browser integrity check", "challenge-platform", "DataDome", "Just a moment...", "checking the browser", "Cloudflare"],
        "Paywall": ["Subscribe to read", "subscribe to continue", "Log in to read", "sign in to continue", "you've read your free articles", "this is a subscriber", "Subscription required", "support our journalism", "support our newsroom", "become a subscriber", "already a subscriber", "unlimited access access", "unlimited digital access", "paid article", "paid content", "this article is behind a", "this article is exclusively for"],
        "Captcha": ["captcha", "recaptcha", "turnstile", "h-captcha"],
        "EmptyShell": ["Please enable JavaScript", "try using"],
    }
    filler = " The river runs past the old town, and every spring the people come down to watch the water rise there."
    rows = [(flag, text + filler) for flag, texts in cases.items() for text in texts] + [("", filler)]
    for r in spark.createDataFrame(rows, "flag string, x string").withColumn("f", Q.flags(F.col("x"))).collect():
        assert (r.flag in r.f) if r.flag else not r.f, r


def test_words_of_queries():
    assert R.KEYWORDS == ["site", "filetype", "intitle", "allintitle", "inurl", "allinurl", "intext", "related", "cache", "define", "before", "after", "near", "inanchor", "inbody", "loc", "language"]
    assert R.SUPPORTED["brave"] == ["site", "filetype", "intitle", "inurl", "intext", "before", "after"] and R.SUPPORTED["bing"] == []
    assert set(R.KEYWORDS) - set(R.SUPPORTED["google"]) == {"cache", "define"}


def test_codes_and_names():
    assert frames.ERROR_CODES == {
        "RateLimited": "rate-limited", "Captcha": "captcha", "QuotaExceeded": "quota-exceeded", "Network": "engine-failed", "Parse": "engine-failed", "Unavailable": "engine-failed", "AllEnginesFailed": "engine-failed", "Timeout": "timeout",
        "Http": "extract-failed", "Empty": "extract-failed", "Unsupported": "extract-failed", "BotBlocked": "extract-failed", "ConnectionFailed": "connection-failed", "BrowserNotFound": "browser-not-found", "InvalidInput": "invalid-input",
    }
    assert frames.EVENT_NAMES == {"JobStarted": "job-started", "Result": "result", "EngineEvent": "engine-event", "Done": "done", "Error": "error"}
    assert {k: T.ENTITIES[k] for k in ("amp", "lt", "gt", "quot", "apos", "nbsp", "hellip", "mdash", "euro")} == {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "hellip": "…", "mdash": "—", "euro": "€"}
    assert len(T.ENTITIES) == 36 and len(T.TITLE_TLDS) == 61


def test_addresses():
    assert U.CAPTCHA_URLS == {"brave": ["search.brave.com/verify", "search.brave.com/captcha"], "google": ["/sorry/", "google.com/sorry"]}
    assert U.CAPTCHA_TITLES == {"brave": ["Verify you are human", "Just a moment"], "google": ["Accessibility", "Learn more"]}
    for junk in ("https://accounts.google.com/x", "https://support.google.com/", "https://policies.google.com/", "https://a/track?x", "https://a.doubleclick.net", "https://googlesyndication.com", "https://a/signin", "https://a/sign-in", "https://a/login", "https://a/log-in", "https://a/auth/", "https://a/auth?", "https://a/auth"):
        assert re.search(U.JUNK_URL, junk), junk


def test_address_lists():
    assert U.TRACKING_KEYS == ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "_ga", "_gl", "mc_cid", "mc_eid"]
    assert [score for score, _ in U.AUTHORITY_TIERS] == sorted((score for score, _ in U.AUTHORITY_TIERS), reverse=True)
    assert {"arxiv.org"} <= set(U.AUTHORITY_TIERS[0][1])
    for title in ("Sign in to continue", "log in to continue", "sign in to read", "log in to read", "please sign in", "please log in", "sign in required", "log in required"):
        assert re.search(U.JUNK_TITLE, title.lower()), title
    assert U.GOOGLE_PATHS[:5] == ["search", "url", "maps", "images", "news"] and U.GOOGLE_PATHS[-3:] == ["myaccount", "signin", "logout"] and len(U.GOOGLE_PATHS) == 40
