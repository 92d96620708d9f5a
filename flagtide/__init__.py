"""flagtide: corpus-scale analysis and retirement of feature-flag guards on Spark."""
