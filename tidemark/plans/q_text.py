"""Explanation-text, privacy and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import rules
from tidemark.operators import explain as X
from tidemark.operators import privacy as V
from tidemark.operators import recommend as R
from tidemark.plans import adapters as A
from tidemark.plans.q_cleaning import scratch
from tidemark.plans.q_funds import built, glide_sql, stored_metrics
from tidemark.plans.q_models import DC, scaled
from tidemark.plans.registry import common, query
from tidemark.sources.lineage import settle
from tidemark.streaming import dedupe as ST
from tidemark.streaming import drift as SD


def rnd(df, cols, n=6):
    return df.withColumns({c: F.round(c, n) for c in cols})


def redact_sql(c):
    x = f"regexp_replace(coalesce({c}, ''), '\\b[A-Z][a-z]+(?:\\s[A-Z][a-z]+)+\\b', '', 'g')"
    x = f"regexp_replace({x}, '₹[0-9,]+', '₹[amount]', 'g')"
    x = f"regexp_replace({x}, '(?i)Rs\\.?\\s*[0-9,]+', 'Rs.[amount]', 'g')"
    x = f"regexp_replace({x}, '\\b[0-9]{{10}}\\b', '[phone]', 'g')"
    x = f"regexp_replace({x}, '\\b[0-9]{{12}}\\b', '[id]', 'g')"
    x = f"regexp_replace({x}, '\\S+@\\S+\\.\\S+', '[email]', 'g')"
    x = f"trim(regexp_replace({x}, '[\\s,]+', ' ', 'g'))"
    return f"CASE WHEN {x} = '' THEN '{X.DEFAULT_CONTEXT}' ELSE {x} END"


# The checking engine's word boundary is ASCII-only.  Both sides therefore write every
# non-ASCII letter as "_" (a word character that no rule touches): the SQL before redacting,
# the query after it.
NON_ASCII_LETTER = r"[^\x00-\x7F\P{L}]"


def folded_sql(c):
    return f"regexp_replace({c}, '{NON_ASCII_LETTER}', '_', 'g')"


def folded(c):
    return F.regexp_replace(c, NON_ASCII_LETTER, "_")


@query("tx_redact_pii", f"SELECT doc_id, md5(c) AS clean_md5, CAST(length(c) AS INTEGER) AS n FROM (SELECT doc_id, {redact_sql('x')} AS c FROM (SELECT doc_id, {folded_sql('text')} AS x FROM documents))")
def _(t):
    out = t.documents.select("doc_id", folded(X.redact_pii(F.col("text"))).alias("c"))
    return out.select("doc_id", F.md5("c").alias("clean_md5"), F.length("c").alias("n"))


_turn = "role || ' says Rs. ' || CAST(conv_id * 1000 AS STRING) || ' or ₹1,000 call 98765' || lpad(CAST(conv_id % 100000 AS STRING), 5, '0') || ' mail a' || CAST(turn AS STRING) || '@b.co Neil Rao, ' || text"


@query("tx_redact_pii_chat", f"SELECT conv_id, turn, {redact_sql('x')} AS clean FROM (SELECT conv_id, turn, {folded_sql(_turn)} AS x FROM conversations)")
def _(t):
    return t.conversations.selectExpr("conv_id", "turn", f"{_turn} AS x").select(
        "conv_id", "turn", folded(X.redact_pii(F.col("x"))).alias("clean"))


_money = "format('{{:,}}', CAST(round_even({c}, 0) AS BIGINT))"
_money2 = "format('{:,}', CAST(floor(coalesce(price, 0)) AS BIGINT)) || right(printf('%.2f', coalesce(price, 0)), 3)"
_guide = "CASE for_tier " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.TIER_GUIDANCE.items()) + " END"


@query("tx_explain_fund_rule", f"""
SELECT for_tier, rank, '**' || name || '** (' || amc || ')' || chr(10) || chr(10) || '**Why this fund?**  Your risk profile ''' || for_tier || ''' aligns with ''' || category || '''.' || chr(10) || chr(10) ||
 '**Fund Snapshot:**' || chr(10) || '- Current NAV: ₹' || {_money2} || chr(10) || '- Total AUM: ₹' || {_money.format(c='coalesce(aum, 0)')} || ' Cr (larger AUM = more established)' || chr(10) ||
 '- Minimum Investment: ₹' || {_money.format(c='coalesce(min_amt, 500)')} || chr(10) || chr(10) || '**Investment Rationale:**  ' || {_guide} || chr(10) || chr(10) AS explanation FROM recs5 WHERE rank <= 3""", ["recs5"])
def _(t):
    return X.explain_top_funds(R.recommend(built(t), 5)).select("for_tier", "rank", "explanation")


common("brackets", """
SELECT tier, bracket, source, round(pct * 100, 1) AS bp, string_agg(substr(name, 1, 35), ' & ' ORDER BY rank) AS n35, string_agg(substr(name, 1, 40), ' & ' ORDER BY rank) AS n40,
 CASE bracket WHEN 'Core' THEN 0 WHEN 'Stability' THEN 1 ELSE 2 END AS o FROM csat WHERE rank <= 2 GROUP BY 1, 2, 3, 4""", ["csat"])
_hlabel = "CASE h WHEN 1 THEN '1yr' WHEN 3 THEN '3yr' WHEN 5 THEN '5yr' ELSE '10yr+' END"
_why = "CASE horizon " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.HORIZON_RATIONALE.items()) + " END"
_tail = rules.BRACKET_LOGIC.replace("'", "''")


@query("tx_explain_horizon_rule", f"""
SELECT tier, horizon, '**' || horizon || ' Portfolio — ' || tier || ' Risk**' || chr(10) || chr(10) || {_why} || chr(10) || chr(10) || '**Allocation — ' || printf('%.0f', round_even(eq * 100, 0)) || '% Equity / ' ||
 printf('%.0f', round_even((1 - eq) * 100, 0)) || '% Debt:**' || chr(10) || l || chr(10) || chr(10) || '**Core-Satellite Logic:** The Core (60%) anchors the portfolio in the ' || tier || '{_tail}' AS explanation FROM (
SELECT tier, {_hlabel} AS horizon, round({glide_sql('tier', 'h')}, 2) AS eq, string_agg(bracket || ' (' || source || ', ' || printf('%.0f', round_even(bp, 0)) || '%): ' || n35, ' | ' ORDER BY o) AS l
FROM brackets, (SELECT unnest([1, 3, 5, 10]) AS h) GROUP BY tier, h)""", ["brackets"])
def _(t):
    return X.explain_horizon_rule(R.full_profile(built(t)))


_asked = "'" + rules.HORIZON_PROMPT.replace("'", "''") + "'"
for _name, _value in (("tier", "tier"), ("horizon", "horizon"), ("funds", "l"), ("equity", "printf('%.0f', round_even(eq * 100, 0))"),
                      ("debt", "printf('%.0f', round_even((1 - eq) * 100, 0))")):
    _asked = f"replace({_asked}, '{{{_name}}}', {_value})"


@query("tx_horizon_prompt", f"""
SELECT tier, horizon, {_asked} AS prompt FROM (
SELECT tier, {_hlabel} AS horizon, round({glide_sql('tier', 'h')}, 2) AS eq, string_agg('  - ' || bracket || ' (' || printf('%.0f', round_even(bp, 0)) || '%, ' || source || ' tier): ' || n40, chr(10) ORDER BY o) AS l
FROM brackets, (SELECT unnest([1, 3, 5, 10]) AS h) GROUP BY tier, h)""", ["brackets"])
def _(t):
    return X.horizon_prompt(R.full_profile(built(t)))


@query("tx_build_prompt", f"""
SELECT code, 'Explain in 3 short paragraphs why the mutual fund ''' || name || ''' by ' || amc || ' (Category: ' || coalesce(category, '') || ', NAV: ₹' || printf('%.2f', price) || ', AUM: ₹' || {_money.format(c='coalesce(aum, 0)')} || ' Cr, ' ||
 CASE WHEN m = '' THEN '' ELSE m || '. ' END || ') is suitable for an investor with a ''' || risk_tier || ''' risk appetite. User context: {X.DEFAULT_CONTEXT}. Include: (1) fund overview with key metrics, (2) why it matches the risk profile, (3) expense ratio impact and return consistency. Be specific to Indian market. Under 180 words.' AS prompt
FROM (SELECT b.*, concat_ws(', ', '3yr CAGR: ' || printf('%.1f', k.cagr_3yr * 100) || '%', 'Sharpe: ' || printf('%.2f', k.sharpe_1yr), 'MaxDD: ' || printf('%.1f', k.max_drawdown * 100) || '%',
 CASE WHEN expense_missing = 0 THEN 'TER: ' || printf('%.2f', expense_real) || '%' END) AS m FROM built b LEFT JOIN metrics k ON k.key = b.code) WHERE risk_tier IS NOT NULL""", ["built", "metrics"])
def _(t):
    m = stored_metrics(t).select(F.col("key").alias("code"), "cagr_3yr", "sharpe_1yr", "max_drawdown")
    funds = built(t).where("risk_tier IS NOT NULL").join(m, "code", "left")
    return funds.select("code", X.build_prompt(F.col("risk_tier")).alias("prompt"))


_answer = ("CASE item_id % 4 WHEN 0 THEN '```json' || chr(10) || '{\"summary\": \"S' || CAST(item_id AS STRING) || '\", \"rationale\": \"R\", \"recommendation\": \"buy\"}' || chr(10) || '```' "
           "WHEN 1 THEN '{\"summary\": \"only\", \"n\": 3}' WHEN 2 THEN text ELSE '{\"summary\": \"cut' END")


@query("tx_parse_json_answer", f"""
SELECT item_id, CASE WHEN item_id % 4 = 0 THEN 'S' || item_id || chr(10) || chr(10) || 'R' || chr(10) || chr(10) || '**Recommendation:** buy' WHEN item_id % 4 = 1 THEN 'only' ELSE a END AS answer
FROM (SELECT item_id, {_answer} AS a FROM benchmark)""")
def _(t):
    return t.benchmark.selectExpr("item_id", f"{_answer} AS a").select("item_id", X.parse_json_answer(F.col("a")).alias("answer"))


common("claims", """
SELECT code, name, category, price, risk_tier, CASE code % 6 WHEN 0 THEN 'A stable debt pick at ₹' || printf('%.2f', price) WHEN 1 THEN name || ' is an aggressive small cap idea with NAV ₹' || printf('%.2f', price * 2)
 WHEN 2 THEN lower(category) || ' balanced growth equity 5,000' WHEN 3 THEN 'very low liquid ' || name || ' ' || category ELSE 'nothing here' END AS text FROM built WHERE category IS NOT NULL AND risk_tier IS NOT NULL""", ["built"])
_CLAIM = ("CASE code % 6 WHEN 0 THEN 'A stable debt pick at ₹' || format_string('%.2f', price) WHEN 1 THEN name || ' is an aggressive small cap idea with NAV ₹' || format_string('%.2f', price * 2) "
          "WHEN 2 THEN lower(category) || ' balanced growth equity 5,000' WHEN 3 THEN 'very low liquid ' || name || ' ' || category ELSE 'nothing here' END")
_alias = "CASE risk_tier " + " ".join("WHEN '" + k + "' THEN ['" + "', '".join(v) + "']" for k, v in rules.TIER_ALIASES.items()) + " END"
common("validated", f"""
SELECT *, (name_mentioned::INT + tier_referenced::INT + category_mentioned::INT + price_plausible::INT) / 4 AS correctness FROM (SELECT code, risk_tier,
 len(list_filter(list_slice(list_filter(string_split_regex(lower(trim(name)), '\\s+'), lambda w: w <> ''), 1, 3), lambda w: length(w) > 3 AND contains(lower(text), w))) > 0 AS name_mentioned,
 len(list_filter({_alias}, lambda w: contains(lower(text), w))) > 0 AS tier_referenced,
 len(list_filter(list_slice(list_filter(string_split_regex(lower(trim(category)), '\\s+'), lambda w: length(w) > 4), 1, 3), lambda w: contains(lower(text), w))) > 0
  OR len(list_filter(string_split_regex(lower(trim(category)), '\\s+'), lambda w: length(w) > 4)) = 0 AS category_mentioned,
 len(list_filter(list_transform(regexp_extract_all(text, '₹?\\s?([0-9,]+\\.?[0-9]*)', 1), lambda s: TRY_CAST(replace(s, ',', '') AS DOUBLE)),
  lambda v: v > 10 AND v < 100000 AND abs(v - price) / (price + 1) > 0.3)) = 0 AS price_plausible FROM claims)""", ["claims"])


def checked(t):
    funds = built(t).where("category IS NOT NULL AND risk_tier IS NOT NULL").withColumn("text", F.expr(_CLAIM))
    return X.with_validation(funds, "text", "risk_tier", "name", "category", "price")


@query("tx_validate_text", "SELECT code, name_mentioned, tier_referenced, category_mentioned, price_plausible, correctness, correctness >= 0.75 AS passed FROM validated", ["validated"])
def _(t):
    return checked(t).select("code", "name_mentioned", "tier_referenced", "category_mentioned", "price_plausible", "correctness", "passed")


@query("tx_validate_batch", """
SELECT risk_tier, count(*) FILTER (correctness >= 0.75) AS pass_count, count(*) AS total, round(count(*) FILTER (correctness >= 0.75) / count(*), 2) AS pass_rate,
 count(*) FILTER (correctness >= 0.75) >= count(*) * 0.75 AS overall_pass FROM validated GROUP BY 1""", ["validated"])
def _(t):
    return X.validate_batch(checked(t), ["risk_tier"])


# --- privacy ----------------------------------------------------------------
common("vecs", "SELECT vec_id, label, 1 + vec_id % 4 AS n, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings")
common("cosines", """
SELECT v.vec_id, any_value(n) AS n, sum(x * m) / ((sqrt(sum(x * x)) + 1e-12) * (sqrt(sum(m * m)) + 1e-12)) AS cosine
FROM vecs v JOIN (SELECT i, avg(x) AS m FROM vecs GROUP BY 1) a ON v.i = a.i GROUP BY 1""", ["vecs"])


def updates(t):
    return t.embeddings.select("vec_id", "label", (1 + F.col("vec_id") % 4).alias("n"), F.col("embedding").alias("vec"))


@query("pv_robust_vector_mean", """
SELECT CAST(v.i AS INTEGER) AS i, round(sum(x * w) / sum(w), 6) AS m FROM vecs v JOIN (SELECT vec_id, n * CASE WHEN cosine < 0 THEN 0.5 ELSE 1 END AS w FROM cosines) c ON v.vec_id = c.vec_id GROUP BY 1""", ["vecs", "cosines"])
def _(t):
    return V.robust_vector_mean(updates(t), "vec", "n").select(F.posexplode("mean").alias("i", "m")).withColumn("m", F.round("m", 6))


@query("pv_cosine_stats", "SELECT count(*) AS n_vectors, count(*) FILTER (cosine < 0) AS n_flagged, round(avg(cosine), 6) AS mean_cosine, round(min(cosine), 6) AS min_cosine FROM cosines", ["cosines"])
def _(t):
    return rnd(V.cosine_stats(updates(t), "vec"), ["mean_cosine", "min_cosine"])


@query("pv_clip", """
SELECT v.vec_id, CAST(i AS INTEGER) AS i, round(x * f, 6) AS x FROM vecs v JOIN (SELECT vec_id, least(1.0, 0.8 / (sqrt(sum(x * x)) + 1e-12)) AS f FROM vecs GROUP BY 1) g ON v.vec_id = g.vec_id""", ["vecs"])
def _(t):
    out = V.clip_and_noise(updates(t).select("vec_id", "vec"), "vec", 0.8)
    return out.select("vec_id", F.posexplode("vec").alias("i", "x")).withColumn("x", F.round("x", 6))


def _uniform(part):
    return f"(('0x' || substr(md5(v.vec_id || '|' || CAST(i AS INTEGER) || '|42|{part}'), 1, 12))::BIGINT + 0.5) / 281474976710656.0"


@query("pv_clip_and_noise", f"""
SELECT v.vec_id, CAST(i AS INTEGER) AS i, round(x * f + 1.1 * sqrt(-2 * ln({_uniform(1)})) * cos(2 * pi() * {_uniform(2)}), 6) AS x
FROM vecs v JOIN (SELECT vec_id, least(1.0, 1.0 / (sqrt(sum(x * x)) + 1e-12)) AS f FROM vecs GROUP BY 1) g ON v.vec_id = g.vec_id""", ["vecs"])
def _(t):
    out = V.clip_and_noise(updates(t).select("vec_id", "vec"), "vec", 1.0, sigma=1.1, key="vec_id")
    return out.select("vec_id", F.posexplode("vec").alias("i", "x")).withColumn("x", F.round("x", 6))


SKEW = {"BUILDING": 0.5, "MACHINERY": 0.3, "FURNITURE": 0.1, "AUTOMOBILE": 0.05}


@query("pv_skewed_stratified_sample", """
SELECT c_custkey, c_mktsegment FROM (SELECT *, row_number() OVER (ORDER BY inq DESC, CASE WHEN inq = 1 THEN c_mktsegment END, h, c_custkey) AS o FROM (
SELECT c_custkey, c_mktsegment, h, CASE WHEN row_number() OVER (PARTITION BY c_mktsegment ORDER BY h, c_custkey) <= CASE c_mktsegment """
       + " ".join(f"WHEN '{k}' THEN {round(v * 60)}" for k, v in SKEW.items()) + """ ELSE 0 END THEN 1 ELSE 0 END AS inq
FROM (SELECT *, md5(c_custkey::VARCHAR || '|skew') AS h FROM customer))) WHERE o <= 60""")
def _(t):
    return V.skewed_stratified_sample(t.customer.select("c_custkey", "c_mktsegment"), "c_custkey", "c_mktsegment", SKEW, 60)


_sg2 = rules.NOISE_MULTIPLIER ** 2
_q, _dl = rules.SAMPLE_RATE, rules.DELTA
common("spent", f"""
SELECT steps, round(min(steps * least(a / (a - 1) * ln(0.7 + {_q} * exp(a / (2 * {_sg2}))), ln(1 + {_q * _q} * a * (a - 1) / 2 * (exp(2.0 / {_sg2}) - 1)) / (a - 1), a / (2 * {_sg2}))
 + ln(1 - 1 / a) - (ln({_dl!r}::DOUBLE) + ln(1 - 1 / a)) / (a - 1)), 4) AS epsilon
FROM (SELECT DISTINCT steps FROM (SELECT count(DISTINCT CAST(ts AS DATE)) * 5 AS steps FROM events GROUP BY user_id)), (SELECT unnest(range(2, 513))::DOUBLE AS a) GROUP BY 1""")


@query("pv_participation_epsilon", """
SELECT user_id, rounds, rounds * 5 AS steps, epsilon, CASE WHEN epsilon < 1 THEN 'Excellent' WHEN epsilon < 3 THEN 'Strong' WHEN epsilon < 5 THEN 'Good' WHEN epsilon < 10 THEN 'Moderate' ELSE 'Weak' END AS quality
FROM (SELECT user_id, count(DISTINCT CAST(ts AS DATE)) AS rounds FROM events GROUP BY 1) JOIN spent ON steps = rounds * 5""", ["spent"])
def _(t):
    ledger = t.events.select("user_id", F.col("ts").cast("date").alias("round"))
    return V.participation_epsilon(ledger, "user_id", "round").select("user_id", "rounds", "steps", "epsilon", "quality")


@query("pv_isolation_check", """
SELECT count(*) AS n_partitions, count(*) FILTER (n > 1) AS n_shared, count(*) FILTER (n > 1) = 0 AS isolated FROM (SELECT count(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderdate)""")
def _(t):
    return V.isolation_check(t.orders, "o_orderdate", "o_custkey")


common("waves", "SELECT key, y::DOUBLE AS y, yhat::DOUBLE AS yhat, CAST(ntile(4) OVER (ORDER BY md5(key::VARCHAR || '|waves'), key) AS INTEGER) AS wave FROM predictions", ["predictions"])


@query("pv_pseudo_label_quality", """
SELECT wave, count(*) AS n, round(avg((y = yhat)::INT), 6) AS agreement, round(corr(ra, rb), 6) AS spearman FROM (
SELECT wave, y, yhat, rank() OVER (PARTITION BY wave ORDER BY yhat) + (count(*) OVER (PARTITION BY wave, yhat) - 1) / 2.0 AS ra,
 rank() OVER (PARTITION BY wave ORDER BY y) + (count(*) OVER (PARTITION BY wave, y) - 1) / 2.0 AS rb FROM waves) GROUP BY 1""", ["waves"])
def _(t):
    return rnd(V.pseudo_label_quality(A.predictions(t), "key", "yhat", "y"), ["agreement", "spearman"])


_log = ["CAST(day(ts) AS INT) AS round", "event_type", "value / 100 AS loss", "event_id % 3 <> 0 AS hit", "value > 60 AS flagged"]
common("rlog", "SELECT " + ", ".join(_log) + " FROM events")


@query("pv_round_summary", """
SELECT round, n, round(loss, 6) AS loss, round(accuracy, 6) AS accuracy, round(entropy, 6) AS entropy, round(fs, 6) AS flagged_share FROM (
SELECT round, CAST(sum(c) AS BIGINT) AS n, sum(l) / sum(c) AS loss, sum(h) / sum(c) AS accuracy, ln(sum(c)) - sum(c * ln(c)) / sum(c) AS entropy, sum(f) / sum(c) AS fs FROM (
SELECT round, event_type, count(*) AS c, sum(loss) AS l, sum(hit::INT) AS h, sum(flagged::INT) AS f FROM rlog GROUP BY 1, 2) GROUP BY 1)""", ["rlog"])
def _(t):
    out = V.round_summary(t.events.selectExpr(*_log), "round", "event_type", "loss", "hit", "flagged")
    return rnd(out, ["loss", "accuracy", "entropy", "flagged_share"])


# --- streaming --------------------------------------------------------------
_FRESH = """
WITH RECURSIVE pts AS (SELECT DISTINCT md5(event_type || ':' || props) AS k, ts FROM events),
chain AS (SELECT k, min(ts) AS t FROM pts GROUP BY k UNION ALL SELECT c.k, min(p.ts) AS t FROM chain c JOIN pts p ON p.k = c.k AND p.ts >= c.t + INTERVAL 1 HOUR GROUP BY c.k)
SELECT e.event_id, c.t IS NOT NULL AS fresh FROM events e LEFT JOIN chain c ON c.k = md5(e.event_type || ':' || e.props) AND c.t = e.ts"""


def requests(t):
    return t.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), ST.request_key(F.col("event_type"), F.col("props")).alias("k"))


@query("st_ttl_dedupe", _FRESH)
def _(t):
    return ST.ttl_dedupe(requests(t)).select("event_id", "fresh")


@query("st_ttl_dedupe_stream", _FRESH)
def _(t):
    """All events arrive up to 50 minutes late and out of order, in two lots; the stream is stopped in between and
    goes on from its checkpoint. A last row, far ahead in time, moves the watermark past all others."""
    path, out, checkpoint = scratch(t, "requests"), scratch(t, "fresh"), scratch(t, "ckpt")
    rows = requests(t)
    due = F.unix_seconds("ts") + F.pmod(F.xxhash64("event_id"), F.lit(3000))
    middle = rows.select(F.avg(due)).scalar()
    ahead = rows.agg(F.lit(None).cast("bigint").alias("event_id"), (F.max("ts") + F.expr("INTERVAL 3 DAYS")).alias("ts"), F.lit("").alias("k"))
    for lot in (rows.where(due <= middle), rows.where(due > middle), ahead):
        lot.write.mode("append").parquet(path)
        arrivals = t.spark.readStream.schema("event_id bigint, ts timestamp, k string").parquet(path)
        ST.run_stateful(ST.ttl_dedupe_stream(arrivals), out, checkpoint)
    return t.spark.read.parquet(out).select("event_id", "fresh")


@query("st_drift_on_stream", "SELECT key, round(m, 4) AS max_delta, top AS top_feature, m > 0.25 AS drifted FROM drifted", ["drifted"])
def _(t):
    path = scratch(t, "arrivals")
    scaled(A.current(t)).write.parquet(path)
    base = settle(scaled(A.baseline(t)))
    arrivals = t.spark.readStream.schema("key bigint, f1 double, f5 double, f3 double").parquet(path)
    out = SD.run_to_table(SD.drift_on_stream(arrivals, base, DC), scratch(t, "drift"), scratch(t, "ckpt"))
    return t.spark.read.parquet(out).select("key", "max_delta", "top_feature", "drifted")
