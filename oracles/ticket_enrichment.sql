
SELECT ticket_id, printf('TKT%06d', ticket_id) AS ticket_code,
       CAST(created_date + to_seconds(CAST(resolution_hours * 3600 AS BIGINT)) AS DATE) AS resolved_date,
       greatest(1, least(5, CAST(round(resolution_hours * CAST(0.05 AS DECIMAL(3,2)), 1) AS DOUBLE))) AS csat_score
FROM ops_tickets
