"""Plenary: public-meeting analytics and data preparation on Apache Spark."""
