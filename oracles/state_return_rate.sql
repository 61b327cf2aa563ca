WITH analysis AS (
  SELECT r.reason, r.refund_status, r.state, count(*) AS returns, sum(r.refund_amount) AS refund_value,
         CAST(sum(r.refund_amount) AS DOUBLE) / count(r.refund_amount) AS avg_refund
  FROM ops_returns r WHERE r.return_date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31'
  GROUP BY r.reason, r.refund_status, r.state
),
returned AS (SELECT state, CAST(sum(returns) AS BIGINT) AS returns FROM analysis GROUP BY state),
ordered AS (SELECT o.state, count(*) AS orders FROM ops_orders o WHERE o.order_date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31' AND o.order_status <> 'Processing' GROUP BY o.state),
rates AS (
  SELECT r.state, r.returns, o.orders, CAST(r.returns AS DOUBLE) / o.orders * 100 * 100 AS y
  FROM returned r JOIN ordered o ON o.state = r.state
),
rounded AS (SELECT state, returns, orders, (CASE WHEN y - floor(y) > 0.5 THEN floor(y) + 1 WHEN y - floor(y) < 0.5 THEN floor(y) WHEN CAST(floor(y) AS BIGINT) % 2 = 0 THEN floor(y) ELSE floor(y) + 1 END / CAST(100 AS DOUBLE)) AS return_pct FROM rates)
SELECT *, CASE WHEN return_pct > 8 THEN 1 ELSE 0 END AS above_benchmark FROM rounded
