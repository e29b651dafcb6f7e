"""Models on Spark ML: segmentation, churn, next event, uplift, anomalies, explanations."""
