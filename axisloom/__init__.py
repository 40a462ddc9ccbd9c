"""axisloom: dataflow over named axes, compiled to Spark DataFrames."""

__version__ = "0.1.0"
