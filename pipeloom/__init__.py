"""A pipe-query engine on Spark: ``FROM table |> stage |> stage`` compiled to lazy DataFrames."""
