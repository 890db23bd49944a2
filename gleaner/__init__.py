"""Gleaner: retrieval analytics on captured web data, expressed as Spark DataFrame plans."""
