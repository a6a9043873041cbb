"""Registered queries: name -> (spark, sf_dir) -> DataFrame, with oracle SQL."""
