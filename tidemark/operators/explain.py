"""Explanation text: redaction, templates, answer parsing and fact checks as column expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import rules

DEFAULT_CONTEXT = "Indian retail investor"


def redact_pii(text: Column) -> Column:
    """Blank name runs, amounts, phone and id numbers and e-mail addresses, in that order.

    ``(?U)`` makes word boundaries and spaces follow Unicode, so an accented
    letter next to a match counts as part of the word.
    """
    def where_seen(x: Column, mark: str, pattern: str, repl: str) -> Column:
        # A plain substring test first: most texts hold no such mark and skip the pattern.
        return F.when(F.contains(x, F.lit(mark)), F.regexp_replace(x, pattern, repl)).otherwise(x)

    out = F.coalesce(text, F.lit(""))
    out = F.regexp_replace(out, r"(?U)\b[A-Z][a-z]+(?:\s[A-Z][a-z]+)+\b", "")
    out = where_seen(out, "₹", r"₹[0-9,]+", "₹[amount]")
    out = F.regexp_replace(out, r"(?iU)Rs\.?\s*[0-9,]+", "Rs.[amount]")
    out = F.regexp_replace(out, r"(?U)\b[0-9]{10}\b", "[phone]")
    out = F.regexp_replace(out, r"(?U)\b[0-9]{12}\b", "[id]")
    out = where_seen(out, "@", r"(?U)\S+@\S+\.\S+", "[email]")
    # Runs of two or more, or a single separator that is not already a plain space.
    out = F.trim(F.regexp_replace(out, r"(?U)[\s,]{2,}|[\s,&&[^ ]]", " "))
    return F.when(out == "", DEFAULT_CONTEXT).otherwise(out)


def money(c: Column, digits: int) -> Column:
    """Thousands-separated number; half-even like a C formatter."""
    return F.format_number(F.rint(c) if digits == 0 else c, digits)


def guidance(tier: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in rules.TIER_GUIDANCE.items() for x in kv])
    return F.coalesce(table[tier], F.lit(""))


def explain_fund_rule(tier: Column, context: Column | None = None) -> Column:
    """Templated explanation of a fund (columns name, amc, category, price, aum, min_amt)."""
    note = F.lit("")
    if context is not None:
        safe = redact_pii(context)
        note = F.when(safe == DEFAULT_CONTEXT, "").otherwise(F.concat(F.lit(" Based on your profile ("), safe, F.lit(").")))
    zero = F.lit(0.0)
    return F.concat(
        F.lit("**"), F.coalesce("name", F.lit("This fund")), F.lit("** ("), F.coalesce("amc", F.lit("")), F.lit(")\n\n"),
        F.lit("**Why this fund?**  Your risk profile '"), tier, F.lit("' aligns with '"), F.coalesce("category", F.lit("")),
        F.lit("'."), note, F.lit("\n\n**Fund Snapshot:**\n- Current NAV: ₹"), money(F.coalesce("price", zero), 2),
        F.lit("\n- Total AUM: ₹"), money(F.coalesce("aum", zero), 0),
        F.lit(" Cr (larger AUM = more established)\n- Minimum Investment: ₹"), money(F.coalesce("min_amt", F.lit(500.0)), 0),
        F.lit("\n\n**Investment Rationale:**  "), guidance(tier), F.lit("\n\n"))


def explain_top_funds(recs: DataFrame, n: int = 3) -> DataFrame:
    return recs.where(F.col("rank") <= n).select("for_tier", "rank", "name",
                                                 explain_fund_rule(F.col("for_tier")).alias("explanation"))


def bracket_lines(portfolio: DataFrame, width: int = 35) -> DataFrame:
    """One text per (tier, horizon, bracket): the top two names of the bracket."""
    top = portfolio.where(F.col("rank") <= 2)
    names = F.sort_array(F.collect_list(F.struct("rank", F.substring("name", 1, width).alias("n"))))  # two rows
    return top.groupBy("tier", "horizon", "equity_share", "bracket", "bracket_tier", "bracket_pct").agg(
        F.array_join(F.transform(names, lambda x: x["n"]), " & ").alias("names"))


def bracket_order(c: Column) -> Column:
    return F.when(c == "Core", 0).when(c == "Stability", 1).otherwise(2)


def explain_horizon_rule(portfolio: DataFrame) -> DataFrame:
    """Portfolio text per tier and horizon from a core-satellite table."""
    lines = bracket_lines(portfolio)
    line = F.concat("bracket", F.lit(" ("), "bracket_tier", F.lit(", "), F.format_string("%.0f", F.rint("bracket_pct")),
                    F.lit("%): "), "names")
    packed = lines.groupBy("tier", "horizon", "equity_share").agg(
        F.sort_array(F.collect_list(F.struct(bracket_order(F.col("bracket")).alias("o"), line.alias("t")))).alias("l"))
    table = F.create_map(*[F.lit(x) for kv in rules.HORIZON_RATIONALE.items() for x in kv])
    pct = F.format_string("%.0f", F.rint(F.col("equity_share") * 100))
    debt = F.format_string("%.0f", F.rint((1 - F.col("equity_share")) * 100))
    text = F.concat(
        F.lit("**"), "horizon", F.lit(" Portfolio — "), "tier", F.lit(" Risk**\n\n"), table[F.col("horizon")],
        F.lit("\n\n**Allocation — "), pct, F.lit("% Equity / "), debt, F.lit("% Debt:**\n"),
        F.array_join(F.transform("l", lambda x: x["t"]), " | "),
        F.lit("\n\n**Core-Satellite Logic:** The Core (60%) anchors the portfolio in the "), "tier",
        F.lit(rules.BRACKET_LOGIC))
    return packed.select("tier", "horizon", text.alias("explanation"))


def build_prompt(tier: Column, context: Column | None = None) -> Column:
    """Prompt per fund with only the metrics that are present; imputed rates are withheld.

    Columns used: name, amc, category, price, aum, cagr_3yr, sharpe_1yr, max_drawdown,
    expense_real, expense_missing.
    """
    rate = F.when(F.coalesce(F.col("expense_missing"), F.lit(0)) == 0, F.col("expense_real"))

    def part(label: str, pattern: str, c: Column) -> Column:
        return F.when(c.isNotNull(), F.concat(F.lit(label), F.format_string(pattern, c)))

    metrics = F.concat_ws(", ", part("3yr CAGR: ", "%.1f%%", F.col("cagr_3yr") * 100),
                          part("Sharpe: ", "%.2f", F.col("sharpe_1yr")),
                          part("MaxDD: ", "%.1f%%", F.col("max_drawdown") * 100), part("TER: ", "%.2f%%", rate))
    shown = F.when(metrics == "", "").otherwise(F.concat(metrics, F.lit(". ")))
    safe = F.lit(DEFAULT_CONTEXT) if context is None else redact_pii(context)
    return F.concat(
        F.lit("Explain in 3 short paragraphs why the mutual fund '"), F.coalesce("name", F.lit("Unknown Fund")), F.lit("' by "),
        F.coalesce("amc", F.lit("")), F.lit(" (Category: "), F.coalesce("category", F.lit("")), F.lit(", NAV: ₹"),
        F.format_string("%.2f", F.coalesce("price", F.lit(0.0))), F.lit(", AUM: ₹"),
        money(F.coalesce("aum", F.lit(0.0)), 0), F.lit(" Cr, "), shown, F.lit(") is suitable for an investor with a '"), tier,
        F.lit("' risk appetite. User context: "), safe,
        F.lit(". Include: (1) fund overview with key metrics, (2) why it matches the risk profile, (3) expense ratio "
              "impact and return consistency. Be specific to Indian market. Under 180 words."))


def filled(template: str, **values: Column) -> Column:
    """``template`` with its {names} replaced by columns."""
    parts = []
    for text, name, _, _ in string.Formatter().parse(template):
        parts += [F.lit(text)] + ([values[name]] if name else [])
    return F.concat(*parts)


def horizon_prompt(portfolio: DataFrame) -> DataFrame:
    """Request per tier and horizon: a compact fund summary with the task around it."""
    lines = bracket_lines(portfolio, 40)
    line = F.concat(F.lit("  - "), "bracket", F.lit(" ("), F.format_string("%.0f", F.rint("bracket_pct")), F.lit("%, "),
                    "bracket_tier", F.lit(" tier): "), "names")
    packed = lines.groupBy("tier", "horizon", "equity_share").agg(
        F.sort_array(F.collect_list(F.struct(bracket_order(F.col("bracket")).alias("o"), line.alias("t")))).alias("l"))
    pct = F.format_string("%.0f", F.rint(F.col("equity_share") * 100))
    debt = F.format_string("%.0f", F.rint((1 - F.col("equity_share")) * 100))
    funds = F.array_join(F.transform("l", lambda x: x["t"]), "\n")
    return packed.select("tier", "horizon", filled(
        rules.HORIZON_PROMPT, tier=F.col("tier"), horizon=F.col("horizon"), funds=funds, equity=pct, debt=debt).alias("prompt"))


def parse_json_answer(raw: Column) -> Column:
    """Readable text from a fenced or plain JSON answer; anything else is returned unchanged."""
    text = F.regexp_replace(F.trim(F.regexp_replace(raw, "```(?:json)?", "")), r"[`\s]+$", "")
    obj = F.from_json(text, "summary STRING, rationale STRING, recommendation STRING", {"mode": "PERMISSIVE"})
    parts = F.concat_ws("\n\n", obj["summary"], obj["rationale"],
                        F.when(obj["recommendation"].isNotNull(), F.concat(F.lit("**Recommendation:** "), obj["recommendation"])))
    return F.when(F.coalesce(parts, F.lit("")) == "", raw).otherwise(parts)


def validate_text(text: Column, tier: Column, name: Column, category: Column, price: Column) -> dict[str, Column]:
    """Fact checks of an explanation against its fund row."""
    low = F.lower(text)

    def long_words(c: Column, longer_than: int) -> Column:
        words = F.filter(F.split(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"\s+"), lambda w: w != "")
        return words, longer_than

    words, _ = long_words(name, 3)
    name_ok = F.exists(F.slice(words, 1, 3), lambda w: (F.length(w) > 3) & F.contains(low, w))
    aliases = F.create_map(*[x for t, ws in rules.TIER_ALIASES.items() for x in (F.lit(t), F.array(*[F.lit(w) for w in ws]))])
    alias = F.coalesce(aliases[tier], F.array(F.lower(tier)))
    tier_ok = F.exists(alias, lambda w: F.contains(low, w))
    cat_words, _ = long_words(category, 4)
    cat_long = F.filter(cat_words, lambda w: F.length(w) > 4)
    cat_ok = (F.size(cat_long) == 0) | F.exists(F.slice(cat_long, 1, 3), lambda w: F.contains(low, w))
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"₹?\s?([0-9,]+\.?[0-9]*)"), F.lit(1)),
                          lambda s: F.regexp_replace(s, ",", "").try_cast("double"))
    base = F.coalesce(price, F.lit(0.0))
    price_ok = F.forall(numbers, lambda v: F.coalesce(
        ~((v > 10) & (v < 100000)) | (F.abs(v - base) / (base + 1) <= 0.3), F.lit(True)))
    return {"name_mentioned": name_ok, "tier_referenced": tier_ok, "category_mentioned": cat_ok, "price_plausible": price_ok}


def with_validation(df: DataFrame, text: str, tier: str, name: str, category: str, price: str) -> DataFrame:
    checks = validate_text(F.col(text), F.col(tier), F.col(name), F.col(category), F.col(price))
    out = df.withColumns(checks)
    score = sum((F.col(c).cast("int") for c in checks), F.lit(0)) / float(len(checks))
    return out.withColumn("correctness", score).withColumn("passed", F.col("correctness") >= 0.75)


def validate_batch(checked: DataFrame, by: list[str] | None = None) -> DataFrame:
    n, ok = F.count(F.lit(1)), F.count_if("passed")
    return checked.groupBy(*(by or [])).agg(ok.alias("pass_count"), n.alias("total"), F.round(ok / n, 2).alias("pass_rate"),
                                            (ok >= n * 0.75).alias("overall_pass"))
