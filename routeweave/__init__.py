"""Routing-event analytics on Spark: DataFrame operators over BGP routes, events and series."""
