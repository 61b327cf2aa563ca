weekly AS (
  SELECT strftime(o.order_date, '%Y-W%W') AS week, CAST(sum(o.final_amount) AS DOUBLE) AS revenue, count(*) AS orders,
         CAST(sum(o.delivery_days) AS DOUBLE) / count(o.delivery_days) AS avg_delivery, CAST(sum(CASE WHEN o.order_status = 'Returned' THEN 1 ELSE 0 END) AS DOUBLE) * 100 / count(*) AS return_rate, CAST(sum(CASE WHEN o.order_status = 'Cancelled' THEN 1 ELSE 0 END) AS DOUBLE) * 100 / count(*) AS cancel_rate,
         max(o.order_date) AS last_day
  FROM ops_orders o GROUP BY 1
),
last8 AS (SELECT * EXCLUDE (last_day) FROM weekly ORDER BY week DESC LIMIT 8),
weekly_csat AS (
  SELECT strftime(t.created_date, '%Y-W%W') AS week, CAST(sum(t.csat_tenths) AS DOUBLE) / 10 / count(*) AS avg_csat,
         CAST(sum(CASE WHEN t.status = 'Escalated' THEN 1 ELSE 0 END) AS DOUBLE) * 100 / count(*) AS escalation_rate,
         count(*) AS total_tickets
  FROM ops_tickets t GROUP BY 1 ORDER BY week DESC LIMIT 8
),
ops_ranked AS (SELECT *, row_number() OVER (ORDER BY week DESC) AS n FROM last8),
csat_ranked AS (SELECT *, row_number() OVER (ORDER BY week DESC) AS n FROM weekly_csat),
measured AS (
  SELECT 0 AS position, 'Revenue' AS metric, '₹' AS unit, true AS higher_better, CAST(8 AS DOUBLE) AS threshold,
         (SELECT CAST(revenue AS DOUBLE) FROM ops_ranked WHERE n = 1) AS current,
         (SELECT (max(CAST(revenue AS DOUBLE)) FILTER (WHERE n = 6) + max(CAST(revenue AS DOUBLE)) FILTER (WHERE n = 5) + max(CAST(revenue AS DOUBLE)) FILTER (WHERE n = 4) + max(CAST(revenue AS DOUBLE)) FILTER (WHERE n = 3)) / 4 FROM ops_ranked) AS baseline
  UNION ALL
  SELECT 1 AS position, 'Orders' AS metric, '' AS unit, true AS higher_better, CAST(8 AS DOUBLE) AS threshold,
         (SELECT CAST(orders AS DOUBLE) FROM ops_ranked WHERE n = 1) AS current,
         (SELECT (max(CAST(orders AS DOUBLE)) FILTER (WHERE n = 6) + max(CAST(orders AS DOUBLE)) FILTER (WHERE n = 5) + max(CAST(orders AS DOUBLE)) FILTER (WHERE n = 4) + max(CAST(orders AS DOUBLE)) FILTER (WHERE n = 3)) / 4 FROM ops_ranked) AS baseline
  UNION ALL
  SELECT 2 AS position, 'Return Rate' AS metric, '%' AS unit, false AS higher_better, CAST(5 AS DOUBLE) AS threshold,
         (SELECT CAST(return_rate AS DOUBLE) FROM ops_ranked WHERE n = 1) AS current,
         (SELECT (max(CAST(return_rate AS DOUBLE)) FILTER (WHERE n = 6) + max(CAST(return_rate AS DOUBLE)) FILTER (WHERE n = 5) + max(CAST(return_rate AS DOUBLE)) FILTER (WHERE n = 4) + max(CAST(return_rate AS DOUBLE)) FILTER (WHERE n = 3)) / 4 FROM ops_ranked) AS baseline
  UNION ALL
  SELECT 3 AS position, 'Cancellation Rate' AS metric, '%' AS unit, false AS higher_better, CAST(5 AS DOUBLE) AS threshold,
         (SELECT CAST(cancel_rate AS DOUBLE) FROM ops_ranked WHERE n = 1) AS current,
         (SELECT (max(CAST(cancel_rate AS DOUBLE)) FILTER (WHERE n = 6) + max(CAST(cancel_rate AS DOUBLE)) FILTER (WHERE n = 5) + max(CAST(cancel_rate AS DOUBLE)) FILTER (WHERE n = 4) + max(CAST(cancel_rate AS DOUBLE)) FILTER (WHERE n = 3)) / 4 FROM ops_ranked) AS baseline
  UNION ALL
  SELECT 4 AS position, 'Delivery Days' AS metric, 'd' AS unit, false AS higher_better, CAST(5 AS DOUBLE) AS threshold,
         (SELECT CAST(avg_delivery AS DOUBLE) FROM ops_ranked WHERE n = 1) AS current,
         (SELECT (max(CAST(avg_delivery AS DOUBLE)) FILTER (WHERE n = 6) + max(CAST(avg_delivery AS DOUBLE)) FILTER (WHERE n = 5) + max(CAST(avg_delivery AS DOUBLE)) FILTER (WHERE n = 4) + max(CAST(avg_delivery AS DOUBLE)) FILTER (WHERE n = 3)) / 4 FROM ops_ranked) AS baseline
  UNION ALL
  SELECT 5 AS position, 'CSAT Score' AS metric, '' AS unit, true AS higher_better, CAST(3 AS DOUBLE) AS threshold,
         (SELECT CAST(avg_csat AS DOUBLE) FROM csat_ranked WHERE n = 1) AS current,
         (SELECT (max(CAST(avg_csat AS DOUBLE)) FILTER (WHERE n = 5) + max(CAST(avg_csat AS DOUBLE)) FILTER (WHERE n = 4) + max(CAST(avg_csat AS DOUBLE)) FILTER (WHERE n = 3) + max(CAST(avg_csat AS DOUBLE)) FILTER (WHERE n = 2)) / 4 FROM csat_ranked) AS baseline
  UNION ALL
  SELECT 6 AS position, 'Escalation Rate' AS metric, '%' AS unit, false AS higher_better, CAST(5 AS DOUBLE) AS threshold,
         (SELECT CAST(escalation_rate AS DOUBLE) FROM csat_ranked WHERE n = 1) AS current,
         (SELECT (max(CAST(escalation_rate AS DOUBLE)) FILTER (WHERE n = 5) + max(CAST(escalation_rate AS DOUBLE)) FILTER (WHERE n = 4) + max(CAST(escalation_rate AS DOUBLE)) FILTER (WHERE n = 3) + max(CAST(escalation_rate AS DOUBLE)) FILTER (WHERE n = 2)) / 4 FROM csat_ranked) AS baseline
),
changed AS (
  SELECT *, (current - baseline) / baseline * 100 AS pct_change FROM measured WHERE baseline <> 0
),
alerts AS (
  SELECT metric, current, baseline, pct_change,
         CASE WHEN pct_change > 0 THEN 'up' ELSE 'down' END AS direction,
         CASE WHEN harm > 15 THEN 'critical' WHEN harm > threshold THEN 'warning'
              WHEN harm < -threshold THEN 'positive' ELSE 'neutral' END AS severity,
         upper(CASE WHEN harm > 15 THEN 'critical' WHEN harm > threshold THEN 'warning'
                    WHEN harm < -threshold THEN 'positive' ELSE 'neutral' END) AS severity_label,
         unit,
         metric || ' has ' || CASE WHEN pct_change > 0 THEN 'increased' ELSE 'decreased' END || ' by '
           || printf('%.1f', abs(pct_change)) || '% (current: ' || CASE unit WHEN '₹' THEN '₹' || format('{:,.0f}', current) WHEN '%' THEN printf('%.1f', current) || '%' WHEN 'd' THEN printf('%.1f', current) || ' days' ELSE format('{:,.1f}', current) END
           || ', 4-week avg: ' || CASE unit WHEN '₹' THEN '₹' || format('{:,.0f}', baseline) WHEN '%' THEN printf('%.1f', baseline) || '%' WHEN 'd' THEN printf('%.1f', baseline) || ' days' ELSE format('{:,.1f}', baseline) END || '). Trend is '
           || CASE WHEN (pct_change > 0) = higher_better THEN 'improving' ELSE 'concerning' END || '.' AS message,
         position
  FROM (SELECT *, CASE WHEN higher_better THEN -pct_change ELSE pct_change END AS harm FROM changed)
  WHERE abs(pct_change) >= threshold
)
