"""nautigraph: maritime network analytics and training-data preparation on Spark DataFrames."""
