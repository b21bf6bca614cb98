"""Table-to-table operators for supervised learning on tabular data, on PySpark.

``sources``    reading tables, writing results, storing fitted models
``functions``  row-wise column expressions
``operators``  joins, groups, quantiles, encoders, folds, metrics, votes, rules
``plans``      compositions: feature sets, stages, grids, boosting, experiments
``catalog``    the registered queries and their SQL twins
"""
