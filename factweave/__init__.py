"""Code-behaviour analytics on Spark: facts in, control flow, call graphs, behaviour graphs and documents out."""
