"""Spoken-form text analytics on Spark: every operator is DataFrame -> DataFrame or Column -> Column."""
