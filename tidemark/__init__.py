"""tidemark: migration analytics as Spark DataFrame jobs.

Every operator takes and returns DataFrames (or Columns) and is parameterised by
column names, so that one function serves source trees, run artefacts and any
other table with the same shape.
"""

__version__ = "0.1.0"
