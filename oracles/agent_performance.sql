WITH agents AS (
  SELECT a.agent_name, a.team, a.shift, count(t.ticket_id) AS total,
         CAST(sum(CASE WHEN t.status = 'Resolved' THEN 1 ELSE 0 END) AS BIGINT) AS resolved,
         CAST(sum(CASE WHEN t.status = 'Escalated' THEN 1 ELSE 0 END) AS BIGINT) AS escalated,
         CAST(sum(t.resolution_hours) AS DOUBLE) / count(t.resolution_hours) AS avg_resolution_h, CAST(sum(t.first_response_h) AS DOUBLE) / count(t.first_response_h) AS avg_frt_h,
         CAST(sum(t.csat_tenths) AS DOUBLE) / 10 / count(*) AS avg_csat, CAST(sum(t.is_repeat) AS BIGINT) AS repeat_contacts
  FROM ops_agents a JOIN ops_tickets t ON a.agent_id = t.agent_id
  WHERE t.created_date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31'
  GROUP BY a.agent_id, a.agent_name, a.team, a.shift
)
SELECT * FROM agents
