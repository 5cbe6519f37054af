"""Preference-data engine on Spark: DataFrame operators over text revisions, pairs, vectors and scores."""
