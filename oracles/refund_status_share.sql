WITH analysis AS (
  SELECT r.reason, r.refund_status, r.state, count(*) AS returns, sum(r.refund_amount) AS refund_value,
         CAST(sum(r.refund_amount) AS DOUBLE) / count(r.refund_amount) AS avg_refund
  FROM ops_returns r WHERE r.return_date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31'
  GROUP BY r.reason, r.refund_status, r.state
)
SELECT refund_status, CAST(sum(returns) AS BIGINT) AS returns,
       CAST(sum(returns) AS DOUBLE) * 100 / (SELECT sum(returns) FROM analysis) AS returns_share
FROM analysis GROUP BY refund_status
