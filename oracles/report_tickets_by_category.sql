WITH analytics AS (
  SELECT t.ticket_category, t.priority, count(*) AS total, CAST(sum(t.resolution_hours) AS DOUBLE) / count(t.resolution_hours) AS avg_res_h,
         CAST(sum(t.first_response_h) AS DOUBLE) / count(t.first_response_h) AS avg_frt_h, CAST(sum(t.csat_tenths) AS DOUBLE) / 10 / count(*) AS avg_csat,
         CAST(sum(t.is_repeat) AS BIGINT) AS repeat_contacts,
         CAST(sum(CASE WHEN t.status = 'Escalated' THEN 1 ELSE 0 END) AS BIGINT) AS escalated
  FROM ops_tickets t WHERE t.created_date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31'
  GROUP BY t.ticket_category, t.priority
)
SELECT ticket_category, CAST(sum(total) AS BIGINT) AS total FROM analytics GROUP BY ticket_category
