WITH {alerts},
{texts},
acute AS (SELECT severity, metric FROM alerts WHERE severity IN ('critical', 'warning'))
SELECT acute.severity, t.metric, t.recommendation FROM recommended t LEFT JOIN acute ON acute.metric = t.metric
WHERE acute.metric IS NOT NULL OR (t.metric IS NULL AND NOT EXISTS (SELECT 1 FROM acute))
