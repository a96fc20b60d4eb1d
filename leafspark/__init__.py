"""Document analytics on Spark: page algebra, layout, text, geometry, quota and conversation operators."""
