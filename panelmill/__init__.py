"""Panel time-series analytics written as Spark DataFrame transformations.

Two raw measurement feeds (price and load per entity) are cleaned, rolled up to
a common grain, joined, enriched with window features and labels, scored with
tree models and summarised.  Every operator is a plain function from DataFrame
to DataFrame; sessions and configuration belong to the caller.
"""
