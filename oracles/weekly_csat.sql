WITH weekly_csat AS (
  SELECT strftime(t.created_date, '%Y-W%W') AS week, CAST(sum(t.csat_tenths) AS DOUBLE) / 10 / count(*) AS avg_csat,
         CAST(sum(CASE WHEN t.status = 'Escalated' THEN 1 ELSE 0 END) AS DOUBLE) * 100 / count(*) AS escalation_rate,
         count(*) AS total_tickets
  FROM ops_tickets t GROUP BY 1 ORDER BY week DESC LIMIT 8
)
SELECT * FROM weekly_csat
