"""Operations of a large-scale training-data pipeline.

Nothing else in the library imports this subpackage. Every operator takes and returns DataFrames, keeps
driver state bounded by its parameters and writes what it must keep to the folder in spark.checkpoint.dir.
"""
