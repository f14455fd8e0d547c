"""blockcat: file-catalogue, block-store and operation-log analytics as Spark DataFrames."""
