"""SQL text of the entity views and cleaning stages, for the DuckDB oracle.

DuckDB sees only the driver's tables, so every oracle query starts with these
common table expressions. They mirror ``spineworks.sources.fixtures`` and
``spineworks.plans.tables`` statement for statement.
"""

VIEWS = r"""
WITH li_agg AS (
  SELECT l_orderkey, max(l_shipdate) AS last_ship, sum(l_quantity) AS qty
  FROM lineitem GROUP BY l_orderkey
), sub_base AS (
  SELECT o_orderkey AS subscription_id,
         o_custkey AS account_id,
         CAST(o_orderdate AS date) AS start_date,
         CASE WHEN o_orderstatus = 'O' THEN NULL ELSE CAST(last_ship AS date) END AS end_date,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'Enterprise' WHEN '2-HIGH' THEN 'Pro'
              WHEN '3-MEDIUM' THEN 'Basic' ELSE o_orderpriority END AS plan_tier,
         CAST(qty AS bigint) AS seats,
         CAST(CASE WHEN o_orderstatus = 'P' THEN 0 ELSE o_totalprice END AS decimal(18,2)) AS mrr_amount,
         o_orderstatus = 'P' AS is_trial,
         o_orderkey % 10 = 0 AS upgrade_flag,
         o_orderkey % 15 = 0 AS downgrade_flag,
         o_orderstatus <> 'O' AND o_orderkey % 4 <> 0 AS churn_flag,
         CASE WHEN o_orderkey % 3 = 0 THEN 'annual' ELSE 'monthly' END AS billing_frequency,
         o_orderkey % 2 = 0 AS auto_renew_flag
  FROM orders LEFT JOIN li_agg ON o_orderkey = l_orderkey
), sub_priced AS (
  SELECT *, CAST(CASE WHEN subscription_id % 97 = 0 THEN mrr_amount * 11 ELSE mrr_amount * 12 END AS decimal(18,2)) AS arr_amount
  FROM sub_base
), raw_subscription AS (
  SELECT * FROM sub_priced
  UNION ALL
  SELECT -subscription_id AS subscription_id, account_id, start_date, end_date, plan_tier, seats, mrr_amount, is_trial,
         upgrade_flag, downgrade_flag, churn_flag, billing_frequency, auto_renew_flag, arr_amount
  FROM sub_priced WHERE subscription_id > 0 AND subscription_id % 500 = 0
), raw_account AS (
  SELECT c_custkey AS account_id, c_name AS account_name,
         CASE WHEN c_custkey % 101 = 0 THEN NULL ELSE c_mktsegment END AS industry,
         n_name AS country, r_name AS referral_source,
         CAST(first_order AS date) AS signup_date,
         CASE c_custkey % 3 WHEN 0 THEN 'Basic' WHEN 1 THEN 'Pro' ELSE 'Enterprise' END AS plan_tier,
         CAST(1 + c_custkey % 50 AS bigint) AS seats,
         c_custkey % 5 = 0 AS is_trial, c_custkey % 7 = 0 AS churn_flag
  FROM customer
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS first_order FROM orders GROUP BY o_custkey) f ON c_custkey = o_custkey
), raw_usage AS (
  SELECT CAST(l_orderkey * 10 + l_linenumber % 3 AS bigint) AS usage_id,
         l_orderkey AS subscription_id,
         CAST(l_shipdate AS date) AS usage_date,
         concat('feature_', CAST(l_linenumber AS string)) AS feature_name,
         CAST(l_quantity AS bigint) - 1 AS usage_count,
         CAST(floor(l_extendedprice / 100) AS bigint) AS usage_duration_secs,
         CAST(l_linenumber - 1 AS bigint) AS error_count
  FROM lineitem
), support_ticket AS (
  SELECT event_id AS ticket_id, user_id AS account_id,
         CASE event_id % 3 WHEN 0 THEN ts WHEN 1 THEN ts + interval '1' month ELSE ts + interval '3' month END AS submitted_at,
         CASE WHEN event_id % 50 = 0 THEN ts - interval '1' day ELSE ts + interval '120' day END AS closed_at,
         CASE event_type WHEN 'purchase' THEN 'urgent' WHEN 'error' THEN 'high' WHEN 'signup' THEN 'medium'
              WHEN 'view' THEN 'low' ELSE 'other' END AS priority,
         event_type = 'error' AS escalation_flag,
         CAST(CASE WHEN event_id % 4 = 0 THEN NULL ELSE 1 + event_id % 5 END AS double) AS satisfaction_score,
         value AS resolution_time_hours,
         CAST(event_id * 37 % 181 AS bigint) AS first_response_time_minutes
  FROM events
), churn_event AS (
  SELECT event_id AS churn_event_id, user_id AS account_id, CAST(ts AS date) AS churn_date,
         CASE event_id % 3 WHEN 0 THEN 'pricing' WHEN 1 THEN 'features' ELSE 'support' END AS reason_code,
         CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 13 = 0 THEN '   ' WHEN event_id % 19 = 0 THEN ''
              WHEN event_id % 2 = 0 THEN 'too expensive' ELSE 'missing features' END AS feedback_text,
         CAST(CASE WHEN event_id % 3 = 0 THEN value ELSE 0 END AS double) AS refund_amount_usd,
         event_type = 'signup' AS is_reactivation
  FROM events
  WHERE event_type IN ('error', 'signup')
), dedup_subscription AS (
  SELECT min(subscription_id) AS subscription_id, account_id, start_date, end_date, plan_tier, seats,
         mrr_amount, is_trial, upgrade_flag, downgrade_flag, churn_flag, billing_frequency,
         auto_renew_flag, arr_amount
  FROM raw_subscription
  GROUP BY account_id, start_date, end_date, plan_tier, seats, mrr_amount, is_trial, upgrade_flag,
           downgrade_flag, churn_flag, billing_frequency, auto_renew_flag, arr_amount
), subscription AS (
  SELECT * FROM dedup_subscription
  WHERE NOT coalesce(mrr_amount = 0 AND arr_amount = 0 AND upgrade_flag = TRUE AND downgrade_flag = TRUE, FALSE)
), rekeyed_usage AS (
  SELECT CAST(row_number() OVER (ORDER BY subscription_id NULLS FIRST, usage_date NULLS FIRST,
              feature_name NULLS FIRST, usage_count NULLS FIRST, usage_duration_secs NULLS FIRST,
              error_count NULLS FIRST) AS bigint) AS usage_id,
         subscription_id, usage_date, feature_name, usage_count, usage_duration_secs, error_count
  FROM raw_usage
), feature_usage AS (
  SELECT * FROM raw_usage WHERE NOT coalesce(usage_count <= 0 OR error_count <= 0, FALSE)
), clean_usage AS (
  SELECT * FROM rekeyed_usage WHERE NOT coalesce(usage_count <= 0 OR error_count <= 0, FALSE)
), account AS (
  SELECT account_id, account_name, industry, country, referral_source, signup_date FROM raw_account
)
"""


def with_views(query: str) -> str:
    """Prefix a query with the view CTEs.

    A query needing CTEs of its own starts with ``, name AS (...)``.
    """
    return VIEWS.rstrip() + ("" if query.lstrip().startswith(",") else "\n") + query
