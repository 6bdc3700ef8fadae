"""Chat-history analytics and corpus preparation as DataFrame operators on Spark."""
