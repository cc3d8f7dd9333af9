"""Knowledge-graph analytics on Spark: quads, entities, hierarchies and two query languages as DataFrames."""
