"""Content quality: page flags, reasons, scores and body status, inside Catalyst.

Word edges are spelled out with Unicode classes, so that letters with marks
count as letters in every regex dialect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import text as T

# Patterns of page flags.
BOT_WALL = r"(?i)(checking your browser|cf-chl|verify you are human|are you a human|browser integrity check|challenge-platform|datadome|just a moment\.\.\.|checking the browser|cloudflare)"
PAYWALL = r"(?i)(subscribe(?: to)? (?:for|to read|to continue|now)|log in to (?:read|continue)|sign in to (?:read|continue)|you've read your free articles|this is a subscriber|subscription required|support our (?:journalism|newsroom)|become a subscriber|already a subscriber|read the full article.*subscribe|continue reading.*subscribe|unlimited (?:access|digital) access|paid (?:article|content)|this article is (?:behind a|exclusively for))"
CAPTCHA = r"(?i)(captcha|recaptcha|g-recaptcha|h-captcha|turnstile|cf-turnstile)"
EMPTY_SHELL = r"(?i)(please enable javascript|try using)"
# Words of navigation menus and of repository tabs, boilerplate openings.
NAV_WORDS = r"about us|contact us|privacy policy|terms of service|careers|pricing|blog|sign in|log in|faq|help center|get started"
TAB_WORDS = r"code|issues|pull requests|actions|projects|wiki|security|insights|settings"
BOILERPLATE = r"(?i)press enter or click to view image|share this (page|article|post)|listen (to|on) (podcast|episode)|^view (all|categories)|^featured"
BLOCK_MARKERS = r"turnstile|cf-chl|consent|challenge|captcha"
READ_MORE = "Read More »"
MIN_BYTES, MIN_WORDS, PREVIEW_BYTES = 80, 15, 15000
# Reasons in the order they are given, with their penalties.
PENALTIES = {
    "too_short": 0.4, "browser_error_page": 0.5, "connection_error": 0.5, "not_found": 0.5, "paywall_teaser": 0.5,
    "navigation_chrome": 0.3, "boilerplate": 0.3, "too_few_words": 0.2, "no_punctuation": 0.1,
}
FLAG_PENALTIES = {"BotWall": ("bot_blocked", 0.6), "Paywall": ("paywall", 0.6), "Captcha": ("captcha", 0.3), "EmptyShell": ("empty_shell", 0.3)}
BLOCKING_FLAGS = ["BotWall", "Paywall"]

WORD = r"\p{L}\p{N}\p{M}_"


def _edged(words: str) -> str:
    return rf"(?i)(?<![{WORD}])(?:{words})(?![{WORD}])"


def has_punctuation(x: Column) -> Column:
    return x.rlike(r"[.!?]")


def has_long_words(x: Column) -> Column:
    return x.rlike(rf"[{WORD}]{{4,}}")


def nav_words(x: Column) -> Column:
    return F.regexp_count(x, F.lit(_edged(NAV_WORDS)))


def is_nav_dense(x: Column) -> Column:
    return nav_words(x) >= 3


def is_nav_link_dense(x: Column) -> Column:
    return is_nav_dense(x) | (F.regexp_count(x, F.lit("(?i)learn more|read more")) >= 3)


def is_tab_bar(x: Column) -> Column:
    return F.regexp_count(x, F.lit(_edged(TAB_WORDS))) >= 4


def has_boilerplate(x: Column) -> Column:
    return x.rlike(BOILERPLATE)


def has_block_markers(x: Column) -> Column:
    return F.lower(x).rlike(BLOCK_MARKERS)


def is_nav_heavy(x: Column) -> Column:
    """Three menu words or more that make up much of a short text."""
    n, size = nav_words(x), F.octet_length(x)
    return F.when(size > 1000, False).when(n < 3, False).when(size < 500, True).otherwise(n * 15 >= F.floor(size / 2))


def is_empty_shell(x: Column) -> Column:
    size = F.octet_length(x)
    return (
        F.when(size < MIN_BYTES, True).when(x.rlike(EMPTY_SHELL), True)
        .when(size < 120, ~has_punctuation(x) | is_nav_dense(x)).otherwise(T.word_count(x) < MIN_WORDS)
    )


def flags(x: Column) -> Column:
    """Flags of a page's text, in their order."""
    found = F.array(
        F.when(x.rlike(BOT_WALL), "BotWall"), F.when(x.rlike(PAYWALL), "Paywall"),
        F.when(x.rlike(CAPTCHA), "Captcha"), F.when(is_empty_shell(x), "EmptyShell"),
    )
    return F.filter(found, lambda f: f.isNotNull())


def is_blocking(flag_array: Column) -> Column:
    return F.arrays_overlap(flag_array, F.array(*map(F.lit, BLOCKING_FLAGS)))


def flag_union(a: Column, b: Column) -> Column:
    """Flags of either, those of the first first."""
    return F.array_union(a, b)


def flag_difference(a: Column, b: Column) -> Column:
    return F.array_except(a, b)


def record(score: Column, is_ok: Column, reason_array: Column, entropy: Column) -> Column:
    """A quality record: score, is_ok, reasons by name, and bits of entropy a character."""
    return F.struct(score.alias("score"), is_ok.alias("is_ok"), reason_array.alias("reasons"), entropy.cast("float").alias("entropy_bits_per_char"))


def error_reasons(x: Column) -> Column:
    found = F.array(
        F.when(x.rlike("(?i)This site can't be reached"), "browser_error_page"),
        F.when(x.contains("ERR_CONNECTION"), "connection_error"),
        F.when(x.contains("404 Not Found"), "not_found"),
    )
    return F.filter(found, lambda r: r.isNotNull())


def head_of(x: Column) -> Column:
    """The first bytes of a text, which alone are judged."""
    return T.preview(x, PREVIEW_BYTES)


def reasons(x: Column, s: Column) -> Column:
    """What speaks against a text, in order; ``s`` is its :func:`head_of`, as a column."""
    size = F.octet_length(s)
    chrome = ((size < 100) & ~s.contains('"')) | ((size >= 100) & is_nav_link_dense(s)) | is_tab_bar(s)
    found = F.filter(
        F.array(
            F.when(size < MIN_BYTES, "too_short"),
            F.when(s.rlike("(?i)This site can't be reached"), "browser_error_page"),
            F.when(s.contains("ERR_CONNECTION"), "connection_error"),
            F.when(s.contains("404 Not Found"), "not_found"),
            F.when(s == READ_MORE, "paywall_teaser"),
            F.when(chrome, "navigation_chrome"),
            F.when(has_boilerplate(s), "boilerplate"),
            F.when((T.word_count(s) < MIN_WORDS) & (size < 200), "too_few_words"),
            F.when((size > 100) & ~has_punctuation(s), "no_punctuation"),
        ),
        lambda r: r.isNotNull(),
    )
    return F.when(x == "", F.array(F.lit("empty_content"))).otherwise(found)


def penalty(reason: Column) -> Column:
    table = F.create_map(*[F.lit(v) for pair in PENALTIES.items() for v in pair])
    return F.coalesce(table[reason], F.lit(0.0))


def score(x: Column, s: Column, reason_array: Column) -> Column:
    """1 less the penalties, in order, plus the bonuses; 0 to 1, two places."""
    left = F.aggregate(reason_array, F.lit(1.0), lambda acc, r: acc - penalty(r))
    left = left + F.when(has_punctuation(s), 0.05).otherwise(0.0)
    left = left + F.when(has_long_words(s), 0.05).otherwise(0.0)
    return F.when(x == "", 0.0).otherwise(T.round_score(F.greatest(F.lit(0.0), F.least(F.lit(1.0), left))))


def validate(df: DataFrame, text: str, out: str = "") -> DataFrame:
    """Adds ``reasons`` and ``score`` (with ``out`` before their names) of a text column.

    The head and the reasons are columns of projections of their own, so that no
    expression repeats them.
    """
    x, s, r = F.col(text), "__head", f"{out}reasons"
    judged = df.withColumn(s, head_of(x)).withColumn(r, reasons(x, F.col(s)))
    return judged.withColumn(f"{out}score", score(x, F.col(s), F.col(r))).drop(s)


def page_score(base: Column, root_sections: Column) -> tuple[Column, Column]:
    """A web page's score and whether it lacks headings: 0.1 off with fewer than two root sections."""
    bare = root_sections < 2
    return F.when(bare, T.round_score(F.greatest(F.lit(0.0), base - 0.1))).otherwise(base), bare


def judge_body(df: DataFrame, text: str, flags_column: str, skip_length: bool = False) -> DataFrame:
    """Adds ``q_score`` (not rounded), ``q_is_ok`` and ``q_reasons`` of a followed page's text, given its flags.

    Plain columns, step by step: fields of one struct would be taken apart by the
    optimizer and each hold all that the struct is made of.
    """
    x, found_flags = F.col(text), F.col(flags_column)
    facts = df.withColumn("__head", head_of(x)).withColumn("__entropy", T.entropy(x)).withColumn("__heavy", is_nav_heavy(x))
    facts = facts.withColumn("__base", reasons(x, F.col("__head")))
    base, heavy = F.col("__base"), F.col("__heavy")
    rules: list[tuple[Column, str, float]] = [(F.array_contains(found_flags, f), name, p) for f, (name, p) in FLAG_PENALTIES.items()]
    if not skip_length:
        rules += [
            (F.array_contains(base, "too_short"), "too_short", 0.2),
            (F.array_contains(base, "too_few_words"), "too_few_words", 0.1),
            (F.array_contains(base, "boilerplate") & heavy, "boilerplate", 0.1),
            (F.array_contains(base, "navigation_chrome") & heavy, "nav_chrome", 0.6),
        ]
    rules.append((F.col("__entropy") < 1.5, "low_entropy", 0.1))
    left = F.lit(1.0)
    for when, _, p in rules:
        left = left - F.when(when, p).otherwise(0.0)
    facts = facts.withColumn("__left", F.greatest(F.lit(0.0), F.least(F.lit(1.0), left)))
    facts = facts.withColumn("__found", F.filter(F.array(*[F.when(when, name) for when, name, _ in rules]), lambda r: r.isNotNull()))
    left, found = F.col("__left"), F.col("__found")
    found = F.when((F.size(found) == 0) & (left < 0.5), F.array(F.lit("low_quality"))).otherwise(found)
    judged = facts.withColumn("q_score", F.when(x == "", 0.0).otherwise(left)).withColumn("q_is_ok", (x != "") & (left >= 0.5))
    judged = judged.withColumn("q_reasons", F.when(x == "", F.array(F.lit("empty_content"))).otherwise(found))
    return judged.drop("__head", "__entropy", "__heavy", "__base", "__left", "__found")


def body_status(content: Column, error: Column, is_ok: Column, reason_array: Column) -> Column:
    """ChromeOrEmpty, ExtractFailed or Ok; the first that fits."""
    chrome = F.exists(reason_array, lambda r: r.rlike("too_short|nav|chrome"))
    walled = F.exists(reason_array, lambda r: r.rlike("paywall|bot_blocked|captcha"))
    return (
        F.when((content == "") & (error == ""), "ChromeOrEmpty").when(error != "", "ExtractFailed")
        .when(~is_ok & chrome & is_nav_heavy(content), "ChromeOrEmpty").when(~is_ok & walled, "ExtractFailed").otherwise("Ok")
    )
