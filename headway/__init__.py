"""Headway: public-transport schedules and journey search on Spark."""
