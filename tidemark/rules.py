"""Business rule tables.

Everything in this file is a fixed value: results only match if these lists,
bounds and weights are exactly these.  All of them are small constants, so they
travel inside expressions and never need a join.
"""

from __future__ import annotations

# The five ordered risk tiers.
TIERS = ["Very_Low", "Low", "Medium", "High", "Very_High"]
TIER_ORD = {name: i for i, name in enumerate(TIERS)}

# The fifteen customer features, in model order.
RISK_FEATURES = [
    "Annual_Income_norm",
    "Monthly_Inhand_Salary_norm",
    "Investment_Ratio",
    "Debt_Burden_Ratio",
    "Credit_Utilization_Ratio",
    "Delay_Score",
    "Credit_Mix_Score",
    "Spending_Behaviour_Score",
    "Num_Bank_Accounts_norm",
    "Interest_Rate_norm",
    "Age_Risk_Proxy",
    "Occupation_Stability_Score",
    "EMI_Income_Ratio",
    "Savings_Rate",
    "Credit_History_Score",
]

# Signed feature weights.
FEATURE_WEIGHTS = {
    "Credit_Mix_Score": 2.50,
    "Interest_Rate_norm": -1.99,
    "Credit_History_Score": 1.70,
    "Num_Bank_Accounts_norm": -1.64,
    "Delay_Score": -1.57,
    "Monthly_Inhand_Salary_norm": 1.20,
    "Annual_Income_norm": 1.00,
    "Age_Risk_Proxy": -0.85,
    "Debt_Burden_Ratio": -0.78,
    "Spending_Behaviour_Score": 0.62,
    "Credit_Utilization_Ratio": 0.31,
    "EMI_Income_Ratio": -0.30,
    "Savings_Rate": 0.29,
    "Investment_Ratio": -0.16,
    "Occupation_Stability_Score": 0.04,
}

# The four risk-matrix dimensions and the features each one adds up.
RISK_DIMENSIONS = {
    "Financial_Capacity": [
        "Annual_Income_norm", "Monthly_Inhand_Salary_norm", "Savings_Rate", "EMI_Income_Ratio",
    ],
    "Behavioral_Tolerance": ["Investment_Ratio", "Spending_Behaviour_Score", "Credit_Mix_Score"],
    "Time_Horizon": ["Age_Risk_Proxy"],
    "Credit_Health": [
        "Debt_Burden_Ratio", "Delay_Score", "Credit_Utilization_Ratio", "Interest_Rate_norm",
        "Credit_History_Score", "Num_Bank_Accounts_norm", "Occupation_Stability_Score",
    ],
}

# Inner cut points of the 12.5/25/25/25/12.5 label split.
LABEL_QUANTILES = [0.125, 0.375, 0.625, 0.875]

# Ordered category keywords per tier, first hit wins.
TIER_KEYWORDS = [
    ("Very_Low", ["liquid", "overnight fund", "ultra short duration", "money market",
                  "low duration", "assured return"]),
    ("Low", ["short duration", "banking and psu", "corporate bond", "floater", "gilt",
             "dynamic bond", "credit risk", "medium duration", "long duration", "income"]),
    ("Medium", ["balanced advantage", "dynamic asset allocation", "aggressive hybrid",
                "conservative hybrid", "balanced hybrid", "balanced", "multi asset allocation",
                "arbitrage", "equity savings", "solution oriented", "fof domestic", "gold etf"]),
    ("High", ["large & mid cap", "large cap", "flexi cap", "multi cap", "value",
              "dividend yield", "focused fund", "contra", "growth"]),
    ("Very_High", ["mid cap", "small cap", "micro cap", "elss", "sectoral", "thematic",
                   "index", "fof overseas", "etf"]),
]

# Ordered category keyword -> (floor, ceiling) tier ordinals.
CATEGORY_BOUNDS = [
    ("overnight", 0, 0), ("liquid", 0, 1), ("money market", 0, 1), ("ultra short", 0, 1),
    ("low duration", 0, 1), ("assured return", 0, 0), ("arbitrage", 0, 1),
    ("equity savings", 1, 2), ("conservative hybrid", 1, 2), ("short duration", 1, 2),
    ("banking and psu", 1, 2), ("corporate bond", 1, 2), ("floater", 1, 2), ("gilt", 1, 3),
    ("dynamic bond", 2, 3), ("credit risk", 2, 3), ("medium duration", 2, 3),
    ("long duration", 2, 3), ("balanced advantage", 2, 3), ("dynamic asset", 2, 3),
    ("multi asset", 2, 3), ("aggressive hybrid", 2, 3), ("balanced hybrid", 2, 3),
    ("solution oriented", 2, 3), ("fof domestic", 2, 3), ("gold etf", 2, 3),
    ("large & mid", 2, 3), ("large cap", 2, 3), ("flexi cap", 2, 3), ("multi cap", 2, 3),
    ("dividend yield", 2, 3), ("value", 2, 3), ("focused", 2, 3), ("contra", 2, 3),
    ("mid cap", 3, 4), ("small cap", 3, 4), ("micro cap", 3, 4), ("elss", 3, 4),
    ("sectoral", 3, 4), ("thematic", 3, 4), ("fof overseas", 3, 4),
    ("index", 2, 4), ("etf", 2, 4),
]

# Segment keywords, tested in this order.
SEGMENT_KEYWORDS = [
    ("Hybrid", ["hybrid", "balanced", "dynamic asset allocation", "aggressive hybrid",
                "conservative hybrid", "equity savings", "multi asset", "arbitrage"]),
    ("Equity", ["equity", "elss", "mid cap", "large cap", "small cap", "micro cap", "flexi",
                "multi cap", "sectoral", "thematic", "index", "etf", "nifty", "sensex", "value",
                "contra", "focused"]),
    ("Debt", ["debt", "liquid", "overnight", "money market", "duration", "bond", "gilt",
              "floater", "banking and psu", "corporate bond", "credit risk"]),
]

# Style keywords, tested in this order.
STYLE_KEYWORDS = [
    ("core", ["large cap", "flexi", "multi cap", "index", "etf", "value", "focused"]),
    ("growth", ["mid cap", "small cap", "micro cap", "sectoral", "thematic"]),
    ("stability", ["debt", "liquid", "overnight", "money market", "gilt", "bond", "duration"]),
]

# Segment order each tier prefers.
SEGMENT_ORDER = {
    "Very_Low": ["Debt", "Hybrid", "Equity"],
    "Low": ["Debt", "Hybrid", "Equity"],
    "Medium": ["Hybrid", "Debt", "Equity"],
    "High": ["Equity", "Hybrid", "Debt"],
    "Very_High": ["Equity", "Hybrid", "Debt"],
}

# Category keywords that make an open-ended fund comparable to an equity index.
BENCHMARK_KEYWORDS = [
    "equity", "large cap", "mid cap", "small cap", "multi cap", "flexi cap", "elss", "sectoral",
    "thematic", "index", "etf", "aggressive hybrid", "balanced advantage",
    "dynamic asset allocation", "equity savings",
]

# Published risk-o-meter wording -> tier.
RISKOMETER_TIER = {
    "low": "Very_Low",
    "low to moderate": "Low",
    "moderately low": "Low",
    "moderate": "Medium",
    "moderately high": "High",
    "high": "Very_High",
    "very high": "Very_High",
}

# Target equity share per tier at 1, 3, 5 and 10+ years.
GLIDE_PATH = {
    "Very_Low": [0.00, 0.00, 0.05, 0.10],
    "Low": [0.00, 0.10, 0.20, 0.30],
    "Medium": [0.10, 0.30, 0.50, 0.60],
    "High": [0.15, 0.50, 0.75, 0.85],
    "Very_High": [0.20, 0.60, 0.90, 0.95],
}
HORIZONS = [1, 3, 5, 10]

# Categories that replace the equity leg at short horizons.
HORIZON_OVERRIDE = {
    1: ["liquid fund", "overnight fund", "ultra short duration", "money market", "low duration",
        "arbitrage"],
    3: ["short duration", "banking and psu", "corporate bond", "balanced advantage",
        "conservative hybrid", "dynamic asset allocation", "floater", "gilt"],
}

# Core / stability / growth shares, equity share per tier, concentration caps.
CORE_SHARE, STABILITY_SHARE, GROWTH_SHARE = 0.60, 0.20, 0.20
EQUITY_SHARE = {"Very_Low": 0.00, "Low": 0.20, "Medium": 0.50, "High": 0.80, "Very_High": 0.95}
MAX_FUND_WEIGHT, MAX_AMC_WEIGHT = 0.30, 0.40

# Inclusive valid ranges; anything outside becomes NULL.
COLUMN_BOUNDS = {
    "Age": (10, 100),
    "Num_Bank_Accounts": (0, 20),
    "Num_of_Loan": (0, 50),
    "Interest_Rate": (0, 50),
    "Num_Credit_Card": (0, 50),
    "Num_of_Delayed_Payment": (0, 100),
}
NON_NEGATIVE = ["Delay_from_due_date"]

# The sixteen numeric bank columns and the five that are winsorised.
BANK_NUMERIC = [
    "Age", "Annual_Income", "Monthly_Inhand_Salary", "Num_Bank_Accounts", "Num_Credit_Card",
    "Interest_Rate", "Num_of_Loan", "Delay_from_due_date", "Num_of_Delayed_Payment",
    "Changed_Credit_Limit", "Num_Credit_Inquiries", "Outstanding_Debt",
    "Credit_Utilization_Ratio", "Total_EMI_per_month", "Amount_invested_monthly",
    "Monthly_Balance",
]
WINSORISED = [
    "Annual_Income", "Monthly_Inhand_Salary", "Outstanding_Debt", "Amount_invested_monthly",
    "Credit_Utilization_Ratio",
]

# Categorical scores (lower-cased key -> score) and their defaults.
CREDIT_MIX_SCORE = {"good": 1.0, "standard": 0.5, "bad": 0.0}
CREDIT_MIX_DEFAULT = 0.5
OCCUPATION_SCORE = {
    "doctor": 0.90, "lawyer": 0.88, "architect": 0.85, "entrepreneur": 0.88, "engineer": 0.78,
    "scientist": 0.75, "developer": 0.73, "manager": 0.68, "accountant": 0.65,
    "media_manager": 0.62, "teacher": 0.58, "journalist": 0.55, "writer": 0.52,
    "musician": 0.50, "mechanic": 0.48,
}
OCCUPATION_DEFAULT = 0.55
PAYMENT_SCORE = {
    "high_spent_large_value_payments": 1.00,
    "high_spent_medium_value_payments": 0.65,
    "low_spent_medium_value_payments": 0.52,
    "low_spent_large_value_payments": 0.44,
    "high_spent_small_value_payments": 0.43,
    "low_spent_small_value_payments": 0.10,
}
PAYMENT_DEFAULT = 0.47

# Return statistics.
RISK_FREE, TRADING_DAYS, VOL_FLOOR = 0.065, 252, 0.002
DRAWDOWN_ENTRY, RECOVERY_SHARE = -0.05, 0.98

# Weights of the four feature rankings.
RANK_WEIGHTS = {"pca": 0.35, "nmf": 0.25, "mi": 0.25, "spearman": 0.15}

# Privacy defaults.
NOISE_MULTIPLIER, CLIP_NORM, SAMPLE_RATE, LOCAL_EPOCHS, DELTA = 1.1, 1.0, 0.3, 5, 1e-5

# Guidance sentence per tier.
TIER_GUIDANCE = {
    "Very_Low": "This is a capital preservation scheme, ideal for emergency corpus or very "
                "short-term goals. Very low volatility.",
    "Low": "This debt-oriented fund offers stable returns with minimal risk. Suitable for "
           "1–3 year goals.",
    "Medium": "This balanced/hybrid fund provides moderate growth with managed downside. Good "
              "for 3–5 year horizons.",
    "High": "This equity fund targets long-term wealth creation. Expect short-term volatility "
            "for 5+ year goals.",
    "Very_High": "This aggressive equity fund (mid/small-cap or sectoral) carries higher risk "
                 "for potentially superior 5–10 year returns.",
}

# Words that count as naming a tier in free text.
TIER_ALIASES = {
    "Very_Low": ["very low", "liquid", "overnight", "capital preservation"],
    "Low": ["low risk", "debt", "short duration", "stable"],
    "Medium": ["medium", "balanced", "hybrid", "moderate"],
    "High": ["high", "equity", "large cap", "growth", "wealth"],
    "Very_High": ["very high", "aggressive", "small cap", "mid cap", "sectoral"],
}

# Horizon rationale sentences.
HORIZON_RATIONALE = {
    "1yr": "With a 1-year horizon, capital preservation takes precedence over growth. "
           "A debt-heavy allocation minimises drawdown risk during short-term volatility.",
    "3yr": "A 3-year horizon allows moderate equity exposure for inflation-beating returns "
           "while a strong debt allocation cushions against market corrections.",
    "5yr": "Over 5 years, equity volatility tends to average out. A balanced allocation "
           "targets meaningful real returns while debt provides a stability anchor.",
    "10yr+": "A 10-year+ horizon fully harnesses compounding. High equity exposure maximises "
             "long-term wealth creation; a small debt slice buffers short-term shocks.",
}

# The request for a horizon's portfolio text, and the sentence that closes the rule-based one.
HORIZON_PROMPT = (
    "You are a SEBI-registered investment advisor. Act as a professional wealth manager for a '{tier}' risk investor "
    "with a {horizon} horizon. Context: Indian market, current interest rate cycle, and latest debt tax laws.\n\n"
    "Funds to be recommended by you(summary):\n{funds}\n"
    "Asset Allocation: {equity}% Equity | {debt}% Debt\n\n"
    "Task: Write exactly 4 paragraphs (under 160 words total) focusing on:\n"
    "1. Mention funds to be recommended and latest details about it\n"
    "2. Strategic Fit: Why this split optimizes the risk-adjusted return (Sharpe Ratio) for a {horizon} period in India.\n"
    "3. Fund Selection Logic: Mention the specific funds, highlighting their credit quality (e.g., AAA/Sovereign) or AUM stability rather than just names.\n"
    "4. Architecture: How the Core (yield), Stability (liquidity), and Growth (alpha) tiers prevent emotional selling during market dips.\n"
    "Constraint: No preamble, no bullets, professional tone, no other suggestions, strictly under 160 words.")
BRACKET_LOGIC = (
    " tier for primary returns. The Stability satellite (20%) adds a downside buffer via a conservative tier, "
    "while the Growth satellite (20%) captures upside from a higher risk tier. This three-bracket structure "
    "reduces single-tier concentration risk and is aligned with BlackRock's Core-Satellite framework and "
    "Markowitz diversification principles.")
