-- Fixed values: what is recommended for each metric, and if there is nothing to do.
recommended(metric, recommendation) AS (VALUES
  ('Revenue', 'Investigate order pipeline for the current week. Check if promotional campaigns are active and consider flash sale or targeted discount to boost GMV.'),
  ('Orders', 'Review acquisition channels. Check if there are any technical issues with checkout flow or if competitor activity is causing volume drop.'),
  ('Return Rate', 'Audit product listings and QC for top-returned categories. Consider tightening return windows for Electronics and Fashion. Review courier partner performance.'),
  ('Cancellation Rate', 'Identify if cancellations are pre-delivery or post-payment. Review payment gateway uptime and implement cancellation deterrence at checkout.'),
  ('Delivery Days', 'Escalate to logistics partners for the affected states. Review last-mile carrier SLAs and consider activating backup delivery partners.'),
  ('CSAT Score', 'Pull CSAT verbatims for the past week. Schedule urgent CX review with Tier-2 support team. Check for any product-specific complaint spikes.'),
  ('Escalation Rate', 'Review Tier-1 agent training for the categories driving escalations. Check if new product launches are causing knowledge gaps.'),
  (NULL, 'Continue monitoring. No critical actions required this week.')
)
