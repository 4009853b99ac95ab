"""Operations of a training-data pipeline, on Spark DataFrames.

Nothing else in the library imports this subpackage.  Each operator module has a general
function (its own parameters and outputs) and a thin ``query`` that applies it to a table
with production parameters; ``queries`` collects those.
"""
