"""Rule-based text compression tiers and their comparison."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tokenloom.functions import text as T
from tokenloom.functions.columns import half_even, let
from tokenloom.functions.rewrite import (
    LiteralRules,
    Rule,
    RuleSet,
    whole_words,
)
from tokenloom.functions.rules import basic, packs, pro, standard, vocabulary
from tokenloom.operators.custom_rules import apply_many, count_hits
from tokenloom.operators.routing import detect_domain_column, detect_language_column

TIERS = ("standard", "pro", "developer")
# Rules of a user up to which they are a constant in the plan.
LISTED_RULES = 500


def compress_basic_column(text: Column) -> Column:
    """The fallback rules, then one line per sentence."""
    out = RuleSet(basic.BASIC).apply(T.strip(text))
    out = F.replace(F.replace(out, F.lit(". "), F.lit(".\n")), F.lit("  "), F.lit(" "))
    return T.strip(out)


def compress_aggressive_column(text: Column) -> Column:
    """The short rule list used on messages in aggressive context mode."""
    return T.strip(RuleSet(basic.AGGRESSIVE).apply(T.strip(text)))


def _tidy(text: Column) -> Column:
    out = F.replace(text, F.lit(". "), F.lit(".\n"))
    return T.strip(F.regexp_replace(out, r"  +", " "))


def _collapse_space(text: Column) -> Column:
    out = F.regexp_replace(text, r"[ \t]{2,}", " ")
    return T.strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def _shorten(word: Column) -> Column:
    lookup = F.from_json(F.lit(json.dumps(standard.ABBREVIATIONS)), "map<string,string>")

    def shortened(low: Column) -> Column:
        size = F.length(low)
        by_suffix = word
        for suffix, ending in reversed(standard.SUFFIXES):
            stem = size - len(suffix)
            by_suffix = F.when(
                F.endswith(low, F.lit(suffix)) & (stem >= standard.MIN_STEM),
                F.concat(F.substring(word, F.lit(1), stem), F.lit(ending)),
            ).otherwise(by_suffix)

        def keep_capital(short: Column) -> Column:
            capital = F.concat(F.upper(F.substring(short, 1, 1)), F.substring(short, 2, 99))
            known = F.when(word.rlike("^[A-Z]"), capital).otherwise(short)
            return F.when(short.isNotNull(), known).otherwise(by_suffix)

        return let(F.element_at(lookup, low), keep_capital)

    return let(F.lower(word), shortened)


def abbreviate_column(text: Column) -> Column:
    """Shorten long words; symbols, all-capital words and short words stay."""
    mark = r"""[.,;:!?()\[\]{}"']*"""
    core = r"[a-zA-Z][a-zA-Z']{%d,}[a-zA-Z]" % (standard.MIN_ABBREVIATED - 2)
    shape = rf"^({mark})({core})({mark})\z"

    def one(token: Column) -> Column:
        fits = (
            (F.length(token) >= standard.MIN_ABBREVIATED)
            & token.rlike(shape)
            & ~token.rlike(r"^[A-Z]+\z")
        )
        short = F.concat(
            F.regexp_extract(token, shape, 1),
            let(F.regexp_extract(token, shape, 2), _shorten),
            F.regexp_extract(token, shape, 3),
        )
        return F.when(fits, short).otherwise(token)

    return F.array_join(F.transform(F.split(text, " "), one), " ")


def telegraphic_column(text: Column) -> Column:
    """Drop articles, copulas and filler (the opt-in browser pass)."""
    return RuleSet(standard.TELEGRAPHIC, ascii=True).chain(text)


def strip_requests_column(text: Column) -> Column:
    """Drop request phrases, then capitalise sentence starts again."""
    parts = F.split(RuleSet(pro.REQUESTS).apply(text), r"(?<=[.!?] )")

    def capital(part: Column) -> Column:
        return F.concat(F.upper(F.substring(part, 1, 1)), F.substring(part, 2, 2**30))

    def each(part: Column, position: Column) -> Column:
        return F.when((position == 0) | part.rlike("^[a-z]"), capital(part)).otherwise(part)

    return F.array_join(F.transform(parts, each), "")


Step = Callable[[Column], Column]


def _rules(rules: Sequence[Rule], ascii: bool = False) -> Step:
    return RuleSet(rules, ascii).apply


def standard_steps(
    lang: str,
    browser_packs: Sequence[str] = (),
    custom: Sequence[Rule] = (),
    telegraphic: bool = False,
) -> list[Step]:
    """Simplify, substitute symbols, prune weak words; abbreviation follows in the caller.

    English gets every pass, Spanish its own symbols, other languages only packs, custom rules
    and the telegraphic pass.
    """
    extra = [rule for pack in browser_packs for rule in vocabulary.BROWSER_PACKS[pack]]
    steps: list[Step] = []
    if lang == "en":
        steps += [_rules(standard.SIMPLIFY, True), _rules(standard.SYMBOLS, True)]
    elif lang == "es":
        steps.append(_rules(standard.SPANISH, True))
    if extra:
        steps.append(_rules(extra, True))
    if custom:
        steps.append(_rules(custom, True))
    if lang == "en":
        # A few rules, most of which most texts need.
        steps.append(RuleSet(standard.LEAN, ascii=True).chain)
    if telegraphic:
        steps.append(telegraphic_column)
    return steps


def run_steps(df: DataFrame, out: str, steps: Sequence[Step], only: Column | None = None):
    """Replace column ``out`` step by step, on the rows where ``only`` holds.

    One projection per step: each intermediate text is computed once.
    """
    for step in steps:
        changed = step(F.col(out))
        if only is not None:
            changed = F.when(only, changed).otherwise(F.col(out))
        df = df.withColumn(out, changed)
    return df


def _standard(df: DataFrame, out: str, lang: str, **options) -> DataFrame:
    """The standard tier on column ``out``."""
    is_en, is_es = F.col(lang) == "en", F.col(lang) == "es"
    df = df.withColumn("_long", T.space_words(F.col(out)) > standard.LONG_PROMPT_WORDS)
    df = df.withColumn(out, T.strip(F.col(out)))
    df = run_steps(df, out, standard_steps("en", **options), is_en)
    df = run_steps(df, out, standard_steps("es", **options), is_es)
    df = run_steps(df, out, standard_steps("", **options), ~(is_en | is_es))
    df = run_steps(df, out, [abbreviate_column], is_en & F.col("_long"))
    return df.withColumn(out, _tidy(F.col(out))).drop("_long")


def _pro(df: DataFrame, out: str, lang: str) -> DataFrame:
    """English: openers, verbose phrases, requests, operators, units, then the standard tier."""
    is_en = F.col(lang) == "en"
    before = [
        _rules(pro.OPENERS),
        _rules(pro.VERBOSE),
        strip_requests_column,
        _rules(pro.MATH),
        _rules(pro.UNITS),
    ]
    df = _standard(run_steps(df, out, before, is_en), out, lang)
    return run_steps(df, out, [_rules(pro.RELATIVE_CLAUSES), _collapse_space], is_en)


def _developer(df: DataFrame, out: str, lang: str) -> DataFrame:
    """Pro tier, then the pack of the original text's domain, then bracketed remarks dropped."""
    df = df.withColumn("_domain", _domain(out, lang))
    return _after_pro(_pro(df, out, lang), out, lang).drop("_domain")


def _domain(text: str, lang: str) -> Column:
    return F.when(F.col(lang) == "en", detect_domain_column(F.col(text)))


def _after_pro(df: DataFrame, out: str, lang: str) -> DataFrame:
    """The developer tier from the pro tier in column ``out`` and the original text's ``_domain``."""
    for domain, rules in packs.PACKS.items():
        df = run_steps(df, out, [_rules(rules)], F.col("_domain") == domain)
    return run_steps(df, out, [drop_parentheses_column, _collapse_space], F.col(lang) == "en")


def apply_pack_column(text: Column, domain: Column) -> Column:
    """The rules of the pack named by ``domain``; unknown names leave the text."""
    out = F.when(F.lit(False), text)
    for name, rules in packs.PACKS.items():
        out = out.when(domain == name, RuleSet(rules).apply(text))
    return out.otherwise(text)


def drop_parentheses_column(text: Column) -> Column:
    """Drop bracketed remarks of 10-80 characters with four words and no code-like content."""
    any_remark = r"\s*\([^)]{10,80}\)"
    plain = (
        r"\s*\((?=[^)]{10,80}\))(?![^)]*\d)(?![^)]*[/\\])(?![^)]*\b(?:def|class)\b)"
        r"(?=\s*(?:(?:(?!\s)[^)])+\s+){3}(?!\s)[^)])[^)]{10,80}\)"
    )
    return F.regexp_replace(text, T.unicode_pattern(f"{plain}|({any_remark})"), "$1")


COMPRESSORS: dict[str, Callable[[DataFrame, str, str], DataFrame]] = {
    "standard": _standard,
    "pro": _pro,
    "developer": _developer,
}


def with_tokens(df: DataFrame, text: str = "text", compressed: str = "compressed") -> DataFrame:
    """Token counts before and after, and the ratio in percent with one decimal."""
    return _measured(df, T.token_count(F.col(text)), compressed)


def _measured(df: DataFrame, original: Column, compressed: str = "compressed") -> DataFrame:
    df = df.withColumn("original_tokens", original).withColumn(
        "compressed_tokens", T.token_count(F.col(compressed))
    )
    ratio = (1 - F.col("compressed_tokens") / F.col("original_tokens")) * 100
    return df.withColumn("cr", half_even(F.greatest(F.lit(0.0), ratio), 1))


def compress_text(
    df: DataFrame, tier: str, text: str = "text", lang: str = "lang", **options
) -> DataFrame:
    """Add ``compressed``; ``options`` (standard only): browser_packs, custom, telegraphic."""
    if tier not in COMPRESSORS:
        raise ValueError(f"unknown tier {tier!r}, choose one of {', '.join(TIERS)}")
    return COMPRESSORS[tier](df.withColumn("compressed", F.col(text)), "compressed", lang, **options)


def compress(
    df: DataFrame, tier: str = "standard", text: str = "text", lang: str = "lang", **options
) -> DataFrame:
    """Add ``compressed``, both token counts and the ratio."""
    return with_tokens(compress_text(df, tier, text, lang, **options), text)


def token_count_in(text: Column, lang: Column) -> Column:
    """Tokens as the language counts them: Chinese by ideographs, others by words."""
    return F.when(lang == "zh", T.token_count_chinese(text)).otherwise(T.token_count(text))


def compress_detected(df: DataFrame, tier: str = "standard", text: str = "text", lang: str | None = None) -> DataFrame:
    """Compress each text in its own language: adds compressed, original_tokens, compressed_tokens, token_savings, cr.

    Without a ``lang`` column, or where it is null or ``auto``, the language is detected; it is given as ``lang``, in
    place of a column of that name. Counts follow the language.
    """
    found = detect_language_column(F.col(text))
    if lang is not None:
        found = F.when(F.col(lang).isNull() | (F.col(lang) == "auto"), found).otherwise(F.col(lang))
    df = compress_text(df.withColumn("lang", found), tier, text)
    before, after = (token_count_in(F.col(c), F.col("lang")) for c in (text, "compressed"))
    df = df.withColumn("original_tokens", before).withColumn("compressed_tokens", after)
    ratio = (1 - F.col("compressed_tokens") / F.col("original_tokens")) * 100
    return df.withColumn("token_savings", F.col("original_tokens") - F.col("compressed_tokens")).withColumn(
        "cr", half_even(F.greatest(F.lit(0.0), ratio), 1)
    )


def compress_basic(df: DataFrame, text: str = "text") -> DataFrame:
    """Basic compression with the saved tokens and a whole-number percentage."""
    out = df.withColumn("compressed", compress_basic_column(F.col(text)))
    out = out.withColumn("original_tokens", T.token_count(F.col(text))).withColumn(
        "compressed_tokens", T.token_count(F.col("compressed"))
    )
    saved = F.greatest(F.lit(0), F.col("original_tokens") - F.col("compressed_tokens"))
    return out.withColumn("tokens_saved", saved).withColumn(
        "tokens_saved_pct",
        half_even(F.col("tokens_saved") / F.col("original_tokens") * 100).cast("long"),
    )


def compare_tiers(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Every tier side by side: one row per text and tier. The developer tier goes on from the pro tier."""
    kept = df.columns
    df = df.withColumn("_domain", _domain(text, lang)).withColumn("_tokens", T.token_count(F.col(text)))
    df = _standard(df.withColumn("_standard", F.col(text)), "_standard", lang)
    df = _pro(df.withColumn("_pro", F.col(text)), "_pro", lang)
    df = _after_pro(df.withColumn("_developer", F.col("_pro")), "_developer", lang)
    versions = F.array(
        *[
            F.struct(F.lit(name).alias("tier"), F.col(f"_{name}").alias("compressed"))
            for name in TIERS
        ]
    )
    return _measured(df.select(*kept, "_tokens", F.inline(versions)), F.col("_tokens")).drop("_tokens")


def apply_pack(df: DataFrame, domain: str = "domain", text: str = "text") -> DataFrame:
    return df.withColumn("compressed", apply_pack_column(F.col(text), F.col(domain)))


def listed_rules(rules_df: DataFrame, most: int) -> list[Row] | None:
    """A user's rules (``pos, pattern, replacement``) in order, or None if there are more than ``most``."""
    rows = rules_df.filter("pattern IS NOT NULL").orderBy("pos").limit(most + 1).collect()
    return rows if len(rows) <= most else None


def apply_rules(df: DataFrame, rules_df: DataFrame, text: str = "text", most: int = LISTED_RULES) -> DataFrame:
    """Add ``compressed``: ``text`` after a user's rules, literal whole-word substitutions in the order of ``pos``.

    Up to ``most`` rules are a constant in the plan; more are joined with the texts by their rarest words.
    """
    rows = listed_rules(rules_df, most)
    if rows is None:
        return apply_many(df, rules_df, text)
    rules = LiteralRules([(r["pattern"], r["replacement"] or "") for r in rows])
    return df.withColumn("compressed", rules.apply(F.col(text)))


def rule_hits(df: DataFrame, rules_df: DataFrame, text: str = "text", most: int = LISTED_RULES) -> DataFrame:
    """Matches of every rule in the original texts: rule (its ``pos``), hits, texts with a hit.

    Each rule is counted for itself, also one whose pattern another has. Counts are made inside a
    row, so a text is never copied. More than ``most`` rules are joined as in ``apply_rules``.
    """
    rows = listed_rules(rules_df, most)
    if rows is None:
        return count_hits(df, rules_df, text)
    spec = LiteralRules([])
    rules = [
        {
            "rule": r["pos"],
            "pattern": spec.pattern(whole_words(r["pattern"])),
            # Letters beyond ASCII have more forms than their lower case.
            "low": r["pattern"].lower() if r["pattern"].isascii() else "",
        }
        for r in rows
    ]
    listed = F.from_json(
        F.lit(json.dumps(rules, ensure_ascii=False)),
        "array<struct<rule:bigint,pattern:string,low:string>>",
    )

    def counted(t: Column) -> Column:
        near = let(F.lower(t), lambda low: F.filter(listed, lambda r: F.contains(low, r["low"])))
        return F.transform(
            near, lambda r: F.struct(r["rule"], F.regexp_count(t, r["pattern"]).alias("n"))
        )

    found = df.select(F.inline(let(F.col(text), counted))).filter("n > 0")
    totals = found.groupBy("rule").agg(
        F.sum("n").alias("hits"), F.count(F.lit(1)).alias("texts")
    )
    every = rules_df.select(F.col("pos").cast("long").alias("rule"))
    return every.join(totals, "rule", "left").select(
        "rule",
        F.coalesce("hits", F.lit(0)).cast("long").alias("hits"),
        F.coalesce("texts", F.lit(0)).cast("long").alias("texts"),
    )


def decode_column(text: Column, symbols: Column) -> Column:
    """Put the originals back: ``symbols`` is an ordered array of (symbol, original).

    Longer symbols first, so that ``§E1`` never matches inside ``§E12``.
    """
    ordered = F.array_sort(
        symbols, lambda a, b: F.length(b["symbol"]) - F.length(a["symbol"])
    )
    return F.aggregate(ordered, text, lambda acc, s: F.replace(acc, s["symbol"], s["original"]))


def retention(
    original: DataFrame, compressed: DataFrame, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Share of the original's entities still present in the compressed text."""
    before = original.select(key, T.entities(F.col(text)).alias("_before"))
    after = compressed.select(key, T.entities(F.col(text)).alias("_after"))
    kept = F.size(F.array_intersect("_before", "_after"))
    total = F.size("_before")
    return before.join(after, key).select(
        key,
        total.alias("n_entities"),
        kept.alias("n_kept"),
        F.when(total == 0, 1.0).otherwise(kept / total).alias("retention"),
    )
