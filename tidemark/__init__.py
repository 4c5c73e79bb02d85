"""tidemark: posting analytics as Spark DataFrame operators.

Every operator takes DataFrames and plain parameters and returns a lazy
DataFrame.  Actions happen only in table writes, in the streaming job, and where
a small parameter table (query vectors, labelled patterns) is read block by block.
"""
