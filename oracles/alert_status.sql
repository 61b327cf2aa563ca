WITH {alerts},
counts AS (
  SELECT count(*) AS alerts, count(*) FILTER (WHERE severity = 'critical') AS critical,
         count(*) FILTER (WHERE severity = 'warning') AS warnings
  FROM alerts
)
SELECT *, CASE WHEN critical > 0 THEN 'CRITICAL: ' || critical WHEN warnings > 0 THEN 'WARNINGS: ' || warnings ELSE 'All Clear' END AS banner
FROM counts
