WITH {alerts}
SELECT * FROM alerts
