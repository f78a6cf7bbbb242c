"""Quillon: catalogue similarity, taste modelling, ranking and corpus preparation as Spark DataFrame jobs."""
