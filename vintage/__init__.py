"""Classification-vintage harmonisation of fact tables on Spark."""
